"""Splits that keep related records together (problem 4).

Rows are related by source video or uploader. Components are found by alternating large-star and small-star rounds over
one node per video; then component weights are balanced by largest differencing: within blocks of bounded size a heap
repeatedly combines the two most uneven partial solutions into ``bins`` equal bins, the blocks' solutions are combined the
same way in a tree of tasks, and whole bins go to the splits by target proportion. The driver sees the last ``fan`` partial
solutions at most, whatever the number of components.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm.common import BLANK, clean_dataset
from heddle.session import drop_stage, stage

VIDEO_ID = r"^(?:ytb_|v_)?([A-Za-z0-9_\-]{11})(?:_clip\d+|_\d+_\d+)?(?:\.[A-Za-z0-9]{2,4})?$"
NUMBER_ID = r"^(\d{7})(?:[_\-]?p\d+)?(?:\.[A-Za-z0-9]{2,4})?$"


def source_key(video_id: Column, dataset: Column, path: Column) -> Column:
    """What names the source video: the 11-character id, or the dataset with its running number.

    A missing dataset of a running number is taken from the folder in ``path``; ids of any other form stand for themselves
    within their dataset. Null and blank ids give null.
    """
    v = F.regexp_replace(video_id, rf"^{BLANK}+|{BLANK}+$", "")
    whole, number = F.regexp_extract(v, VIDEO_ID, 1), F.regexp_extract(v, NUMBER_ID, 1)
    folder = F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"([^/]+)/+[^/]*$", 1)
    own = F.coalesce(clean_dataset(dataset), clean_dataset(folder), F.lit(""))
    return F.when(number != "", F.concat_ws("|", F.lit("n"), own, number)).when(whole != "", F.concat_ws("|", F.lit("v"), whole)).when(v != "", F.concat_ws("|", F.lit("o"), own, v))


def uploader_key(c: Column) -> Column:
    """The uploader's name without case, blanks and a leading @; null for blanks and filler words."""
    x = F.regexp_replace(F.lower(F.regexp_replace(c, rf"{BLANK}+", "")), "^@+", "")
    return F.when(~x.isin("", "-", "--", "?", "n/a", "na", "none", "null", "unknown", "nan", "anonymous"), x)


def star_components(edges: DataFrame, *, max_rounds: int = 50) -> DataFrame:
    """``(node, root)`` with the least node of each component, for nodes in ``edges(a, b)`` that are not roots themselves.

    Large-star and small-star rounds, each written to the shared folder, until nothing changes. A node's least neighbour is
    pre-aggregated; the join back has one row per node on one side, so adaptive execution can split a hot node.
    """

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    now = stage(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = least(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(m, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            now.join(m.select(F.col("u"), "m"), "u").where("m = u").select("u", "v")
        )
        large = large.distinct()
        low = least(large)
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = stage(small.select("e.*").where("u != v").distinct(), "edges")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_stage(now)
        now, done, before = after, tuple(mark) == before, tuple(mark)
        if done or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components not found in {max_rounds} rounds")


def related_rows(registry: DataFrame) -> DataFrame:
    """``(reg_id, group_reg_id)`` for every row: the smallest ``reg_id`` of the rows related to it.

    Rows without source video are related by their uploader alone, rows with neither to nothing. A null ``reg_id`` is left
    out; other columns are not read.
    """
    rows = registry.where(F.col("reg_id").isNotNull()).select(
        "reg_id", F.coalesce(source_key(F.col("video_id"), F.col("dataset"), F.col("video_path")), F.concat_ws("|", F.lit("r"), F.col("reg_id"))).alias("source"), uploader_key(F.col("uploader")).alias("uploader")
    )
    rows = stage(rows, "registry")
    nodes = rows.groupBy("source").agg(F.min("reg_id").alias("node"))
    held = rows.join(nodes, "source").select("reg_id", "node", "uploader")
    held = stage(held, "registry-nodes")
    pairs = held.where("uploader is not null").select("uploader", "node").distinct()
    hubs = pairs.groupBy("uploader").agg(F.min("node").alias("hub"))
    edges = pairs.join(hubs, "uploader").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    roots = star_components(edges)
    return held.join(roots, "node", "left").select("reg_id", F.coalesce("root", "node").alias("group_reg_id"))


def combine(solutions: list[tuple[np.ndarray, list]]) -> tuple[np.ndarray, list]:
    """Largest differencing over partial solutions ``(weights of k bins, members of k bins)``.

    The two with the greatest spread are combined, the heaviest bin of one with the lightest of the other, until one is left.
    """
    tie, heap = count(), []

    def push(w: np.ndarray, members: list) -> None:
        order = np.argsort(-w, kind="stable")
        w, members = w[order], [members[i] for i in order]
        heapq.heappush(heap, (-int(w[0] - w[-1]), next(tie), w, members))

    for w, members in solutions:
        push(w, members)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        push(a + b[::-1], [p + q if p and q else p or q for p, q in zip(x, y[::-1], strict=True)])
    return (heap[0][2], heap[0][3]) if heap else (np.zeros(0, dtype=np.int64), [])


def block_bins(bins: int, block: int):
    """The function for ``mapInPandas``: ``(group_reg_id, weight)`` to ``(part, bin, group_reg_id, weight)``, in blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), count()

        def solve(p: pd.DataFrame) -> pd.DataFrame:
            zero = [(np.concatenate([[w], np.zeros(bins - 1, dtype=np.int64)]), [[i], *[[]] * (bins - 1)]) for i, w in enumerate(p["weight"])]
            _, members = combine(zero)
            at = np.empty(len(p), dtype=np.int64)
            for k, m in enumerate(members):
                at[m] = k
            return pd.DataFrame({"part": f"{task}-{next(number)}", "bin": at, "group_reg_id": p["group_reg_id"], "weight": p["weight"]})

        held: list[pd.DataFrame] = []
        for p in batches:
            while len(p):
                room = block - sum(map(len, held))
                held.append(p.iloc[:room])
                p = p.iloc[room:]
                if sum(map(len, held)) == block:
                    yield solve(pd.concat(held, ignore_index=True))
                    held = []
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    return run


def combine_level(bins: int, level: int):
    """The function for ``applyInPandas``: partial solutions ``(part, bin, w)`` of a group to ``(part, bin, up, up_bin, w)``."""

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        solutions = []
        for _, q in p.sort_values(["part", "bin"]).groupby("part"):
            w, members = np.zeros(bins, dtype=np.int64), [[] for _ in range(bins)]
            for i, k, x in zip(q.index, q["bin"], q["w"], strict=True):
                w[k], members[k] = x, [i]
            solutions.append((w, members))
        _, members = combine(solutions)
        at = pd.Series(0, index=p.index)
        for k, m in enumerate(members):
            at[m] = k
        return pd.DataFrame({"part": p["part"], "bin": p["bin"], "up": f"{level}-{key[0]}", "up_bin": at, "w": p["w"]})

    return run


def place_bins(weight: np.ndarray, members: list, shares: list[tuple[str, int]]) -> list[tuple]:
    """``(part, bin, split)``: bins go, heaviest first, to the split that lacks most of its share, ties to the lesser name."""
    whole = sum(s for _, s in shares) or 1
    lack, placed = {name: float(weight.sum()) * s / whole for name, s in shares}, []
    for k in np.argsort(-weight, kind="stable"):
        name = max(sorted(lack), key=lambda x: lack[x]) if lack else None
        if lack:
            lack[name] -= float(weight[k])
        placed += [(part, int(b), name) for part, b in members[k]]
    return placed


def assign_splits(registry: DataFrame, targets: DataFrame, *, bins: int = 100, block: int = 20_000, fan: int = 64, max_splits: int = 1_000) -> DataFrame:
    """``(reg_id, group_reg_id, split_name)``: every row in exactly one split, related rows in the same one.

    ``targets`` has ``split_name, target_pct`` (at most ``max_splits`` rows, checked). Bins go, heaviest first, to the split
    that lacks most of its share, ties to the lesser name; a group heavier than a bin fills one by itself. Shares are taken
    relative to their sum. Blocks of ``block`` components are solved in tasks; their solutions are combined ``fan`` at a time,
    level by level, until at most ``fan`` are left for the driver. Without targets the split is null; an empty registry
    gives no rows.
    """
    spark = registry.sparkSession
    rows = stage(related_rows(registry), "related")
    weights = rows.groupBy("group_reg_id").agg(F.count("*").alias("weight"))
    parts = stage(weights.mapInPandas(block_bins(bins, block), "part string, bin long, group_reg_id long, weight long"), "bins")
    now = stage(parts.groupBy("part", "bin").agg(F.sum("weight").alias("w")), "solutions")
    links: list[DataFrame] = []
    n = now.select("part").distinct().count()
    while n > fan:
        n = -(-n // fan)
        group = F.pmod(F.xxhash64("part"), F.lit(n)).cast("long").alias("g")
        linked = stage(now.select("*", group).groupBy("g").applyInPandas(combine_level(bins, len(links)), "part string, bin long, up string, up_bin long, w long"), "links")
        links.append(linked)
        now = stage(linked.groupBy(F.col("up").alias("part"), F.col("up_bin").alias("bin")).agg(F.sum("w").alias("w")), "solutions")
        n = now.select("part").distinct().count()
    solved: dict[str, tuple] = {}
    for r in now.collect():  # at most fan x bins rows
        w, m = solved.setdefault(r.part, (np.zeros(bins, dtype=np.int64), [[] for _ in range(bins)]))
        w[r.bin], m[r.bin] = r.w, [(r.part, r.bin)]
    weight, members = combine([solved[k] for k in sorted(solved)])
    shares = sorted((r.split_name, max(0, r.target_pct or 0)) for r in targets.select("split_name", "target_pct").where("split_name is not null").limit(max_splits + 1).collect())
    if len(shares) > max_splits:
        raise ValueError(f"more than {max_splits} splits")
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("bin", T.LongType()), T.StructField("split_name", T.StringType())])
    placed = spark.createDataFrame(place_bins(weight, members, shares), schema)
    for linked in reversed(links):
        up = placed.select(F.col("part").alias("up"), F.col("bin").alias("up_bin"), "split_name")
        placed = linked.join(up, ["up", "up_bin"]).select("part", "bin", "split_name")
    groups = parts.join(placed, ["part", "bin"], "left").select("group_reg_id", "split_name")
    return rows.join(groups, "group_reg_id").select("reg_id", "group_reg_id", "split_name")


def split_report(splits: DataFrame, targets: DataFrame) -> DataFrame:
    """Per split its target, its rows and groups, and how many of its groups are in another split too (always 0)."""
    by_group = splits.groupBy("group_reg_id").agg(F.min("split_name").alias("split_name"), F.max("split_name").alias("other"), F.count("*").alias("c"))
    got = by_group.groupBy("split_name").agg(F.sum("c").alias("n_rows"), F.count("*").alias("n_groups"), F.count_if(F.col("split_name") != F.col("other")).alias("n_torn"))
    return targets.where("split_name is not null").join(got, "split_name", "left").select("split_name", "target_pct", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "n_groups", "n_torn")))


def reached(splits: DataFrame, targets: DataFrame) -> DataFrame:
    """``split_name, target_pct, reached_pct, n_torn, n_all``: the share of rows each split reached, to the percent."""
    report = split_report(splits, targets)
    total = report.agg(F.sum("n_rows").alias("n_all"))
    share = F.round(100 * F.col("n_rows") / F.col("n_all")).cast("int").alias("reached_pct")
    return report.join(F.broadcast(total)).select("split_name", "target_pct", share, F.col("n_torn").cast("int").alias("n_torn"), "n_all")  # total: one row


def related_pairs(registry: DataFrame) -> DataFrame:
    """``(group_reg_id, reg_id)`` for each row of a group except its smallest ``reg_id``."""
    return related_rows(registry).where("reg_id != group_reg_id").select("group_reg_id", "reg_id")
