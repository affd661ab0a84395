"""Documents packed into containers of several fixed capacities (problem 6).

Documents are measured in tokens of a public tokenizer and routed to the smallest capacity that holds them; only texts longer
than the largest container are split. Each tier is packed from its histogram of lengths: as lengths are whole numbers up to
the capacity, the histogram is of bounded size however many documents there are, and one packing of it is the packing of the
whole corpus. Containers are filled with the longest pieces first, and the gaps that long documents leave are filled with the
longest pieces of the shorter tiers that fit. Documents take their places by rank among those of equal length.

Containers are dealt to steps of ``group`` containers in serpentine order of fill, so all steps hold about as many tokens.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from heddle.session import local_file, put_file, stage

#: Fixed value: how the tokenizer's vocabulary splits texts into words before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict = {}


def encoder(path: str):
    """The byte-level BPE of a vocabulary file in tiktoken's format; read once a process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(documents: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, n_tokens)`` for every document that has tokens; null and empty texts have none.

    The driver reads the file ``vocabulary`` and gives it to every executor through the shared folder.
    """
    with open(vocabulary, "rb") as f:
        shipped = put_file(documents.sparkSession, "vocabulary", f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(local_file(shipped))
        for p in batches:
            yield pd.DataFrame({"doc_id": p["doc_id"], "n_tokens": [len(e.encode_ordinary(t)) for t in p["text"]]})

    return documents.select("doc_id", "text").where("text != '' and doc_id is not null").mapInPandas(run, "doc_id long, n_tokens long")


class Patterns:
    """Groups of equal containers: ``(capacity, first container, copies, {length: pieces in each})``."""

    def __init__(self, histogram: dict[int, int], capacities: list[int]) -> None:
        self.left = {n: c for n, c in histogram.items() if n > 0 and c > 0}
        self.sizes = sorted(self.left)
        self.groups: list[tuple[int, int, int, dict]] = []
        self.next = 0
        for low, high in reversed(list(zip([0, *capacities], capacities))):
            while self.sizes and (n := self.longest(high)) > low:
                self.fill(high, n)

    def longest(self, most: int) -> int:
        at = bisect.bisect_right(self.sizes, most)
        return self.sizes[at - 1] if at else 0

    def fill(self, capacity: int, n: int) -> None:
        """One pattern that starts with length ``n``, used as often as the lengths in it last."""
        room, held = capacity - n, {n: 1}
        while room > 0:
            n = next((s for s in self.downward(room) if self.left[s] > held.get(s, 0)), 0)
            if not n:
                break
            last = self.exact(room, held)
            n = last or n
            held[n] = held.get(n, 0) + 1
            room -= n
        copies = min(self.left[s] // k for s, k in held.items())
        self.groups.append((capacity, self.next, copies, held))
        self.next += copies
        for s, k in held.items():
            self.left[s] -= copies * k
            if not self.left[s]:
                del self.left[s]
                self.sizes.pop(bisect.bisect_left(self.sizes, s))

    def downward(self, most: int) -> Iterator[int]:
        for at in range(bisect.bisect_right(self.sizes, most) - 1, -1, -1):
            yield self.sizes[at]

    def exact(self, room: int, held: dict) -> int:
        """A length that fills ``room`` by itself or with one more piece; 0 if there is none."""
        free = lambda s: self.left.get(s, 0) - held.get(s, 0)
        if free(room) > 0:
            return room
        for s in self.downward(room):
            if s < room - s:
                break
            if free(s) > 0 and free(room - s) > (s == room - s):
                return s
        return 0


def pack(documents: DataFrame, limits: DataFrame, vocabulary: str, *, group: int = 8, per_rank_task: int = 1_000_000, most_slots: int = 2_000_000, max_limits: int = 1_000, max_capacity: int = 10_000_000) -> DataFrame:
    """``(limit_id, container_id, step_id, doc_id, piece_no, first_token, n_tokens)``: every piece in one container.

    ``limits`` has ``limit_id, capacity_tokens`` (at most ``max_limits`` rows up to ``max_capacity``, checked: the histogram
    has one entry per length up to the capacity). Of equal capacities the least id is used. A text longer than the largest
    container is cut into full containers and a rest that is packed like a document. Equal lengths are ranked by a hash of
    the document, then its id. The table of slots is broadcast up to ``most_slots`` rows and joined by length beyond. Documents without tokens are in no container; an empty corpus gives no rows. Without limits
    a ValueError is raised.
    """
    spark = documents.sparkSession
    rows = limits.where("capacity_tokens > 0").groupBy("capacity_tokens").agg(F.min("limit_id").alias("limit_id")).orderBy("capacity_tokens").limit(max_limits + 1).collect()
    if not rows or len(rows) > max_limits or rows[-1].capacity_tokens > max_capacity:
        raise ValueError(f"pack needs 1 to {max_limits} capacities up to {max_capacity}")
    ids = {r.capacity_tokens: r.limit_id for r in rows}
    capacities = sorted(ids)
    most = capacities[-1]

    counts = token_counts(documents, vocabulary).where("n_tokens > 0")
    whole = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / most) - 1)
    pieces = counts.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), whole)).alias("piece_no")).select(
        "doc_id", "piece_no", (F.col("piece_no") * most).alias("first_token"), F.least(F.lit(most).cast("long"), F.col("n_tokens") - F.col("piece_no") * most).alias("n")
    )
    pieces = stage(pieces, "pieces")
    histogram = {r.n: r.c for r in pieces.groupBy("n").agg(F.count("*").alias("c")).collect()}  # one row per length up to the capacity
    patterns = Patterns(histogram, capacities)

    filled, slots, used = {}, [], {}
    for capacity, first, copies, held in patterns.groups:
        filled.setdefault(capacity, []).append((sum(s * k for s, k in held.items()), first, copies))
        for s, k in held.items():
            slots.append((s, used.get(s, 0), used.get(s, 0) + copies * k, capacity, first, k))
            used[s] = used.get(s, 0) + copies * k
    order = []  # containers of each tier by fill, as runs of equal ones
    for capacity, runs in filled.items():
        at, n_steps = 0, -(-sum(c for *_, c in runs) // group)
        for _, first, copies in sorted(runs, key=lambda r: (-r[0], r[1])):
            order.append((first, at, n_steps))
            at += copies
    place = {first: (at, n_steps) for first, at, n_steps in order}
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("n", "lo", "hi", "capacity", "first", "each", "at", "n_steps")])
    table = spark.createDataFrame([(*s, *place[s[4]]) for s in slots], schema)

    salts = max(1, -(-max(histogram.values(), default=0) // per_rank_task))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(salts)).cast("int"))
    per_salt = salted.groupBy("n", "salt").agg(F.count("*").alias("c"))
    before = per_salt.withColumn("base", F.sum("c").over(Window.partitionBy("n").orderBy("salt")) - F.col("c")).select("n", "salt", "base")
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("n", "salt").orderBy(F.xxhash64("doc_id"), "doc_id", "piece_no")) - 1)
    ranked = ranked.join(before, ["n", "salt"]).withColumn("r", F.col("r") + F.col("base"))
    placed = ranked.join(F.broadcast(table) if len(slots) <= most_slots else table, "n").where("r >= lo and r < hi")
    copy = F.floor((F.col("r") - F.col("lo")) / F.col("each"))
    position = F.col("at") + copy
    turn, spot = F.floor(position / F.col("n_steps")), F.pmod(position, F.col("n_steps"))
    step = F.when(F.pmod(turn, F.lit(2)) == 0, spot).otherwise(F.col("n_steps") - 1 - spot)
    limit = F.create_map(*(F.lit(x) for c in capacities for x in (c, ids[c])))
    return placed.select(limit[F.col("capacity").cast("int")].alias("limit_id"), (F.col("first") + copy).alias("container_id"), step.alias("step_id"), "doc_id", "piece_no", "first_token", F.col("n").alias("n_tokens"))


def fill_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """Containers, tokens and the share of room used per limit."""
    boxes = packed.groupBy("limit_id", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("pieces"))
    by = boxes.groupBy("limit_id").agg(F.count("*").alias("n_containers"), F.sum("tokens").alias("n_tokens"), F.sum("pieces").alias("n_pieces"))
    return by.join(limits, "limit_id").select("limit_id", "n_containers", "n_tokens", "n_pieces", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill"))


def audit(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """One row: documents placed, containers over their capacity, documents cut though they fit, documents with tokens missing."""
    most = limits.agg(F.max("capacity_tokens").alias("most"))
    boxes = packed.groupBy("limit_id", "container_id").agg(F.sum("n_tokens").alias("tokens")).join(F.broadcast(limits.select("limit_id", "capacity_tokens")), "limit_id")
    docs = packed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end")).join(F.broadcast(most))
    by_doc = docs.agg(F.count("*").alias("n_documents"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("most"))).cast("int").alias("n_needless_cuts"), F.count_if(F.col("tokens") != F.col("end")).cast("int").alias("n_gaps"))
    over = boxes.agg(F.count_if(F.col("tokens") > F.col("capacity_tokens")).cast("int").alias("n_overfull"))
    return by_doc.join(F.broadcast(over)).select("n_documents", "n_overfull", "n_needless_cuts", "n_gaps")  # one row each
