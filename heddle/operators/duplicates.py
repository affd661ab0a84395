"""Near duplicates within an origin and the decisions that follow from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.session import stage

#: 64-bit words of a fingerprint.
WORDS = 4
#: Sets above this size saturate a fingerprint and also carry the hashes of their words.
LONG = 256
#: Sets of a group and band that one task compares with the others.
PART = 2000
#: Hash values of candidates' keys, and so the rows of the table of them that is broadcast.
SLOTS = 1 << 20
#: Shares of the difference that candidates may have, by which the nearest of a class is told.
NEAR = (0.25, 0.5, 0.75)


def profiles(df: DataFrame, group: str, key: str, words: Column, rank: Column | None = None) -> DataFrame:
    """``group, id, h, n, f0.., hs`` per row: digest, size, fingerprint and, above ``LONG`` words, word hashes of its set; ``r`` if
    ``rank`` is given.

    Bit i of the fingerprint is the parity of how many words hash to i, so two fingerprints differ in no more bits than their sets
    differ in words. Null groups are left out. Words stay behind, so what later steps shuffle is small.
    """
    own = [] if rank is None else ["r"]
    rows = df.where(F.col(group).isNotNull()).select(group, F.col(key).alias("id"), F.array_sort(F.array_distinct(words)).alias("words"), *(rank.alias(c) for c in own))
    rows = rows.select(group, "id", *own, F.unhex(F.sha2(F.array_join("words", "\0"), 256)).alias("h"), F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("x"))

    def part(j: int) -> Column:
        flip = lambda acc, x: F.when(F.shiftrightunsigned(x, 6).bitwiseAND(WORDS - 1) == j, acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int")))).otherwise(acc)
        return F.aggregate("x", F.lit(0).cast("long"), flip)

    return rows.select(group, "id", *own, "h", "n", *(part(j).alias(f"f{j}") for j in range(WORDS)), F.when(F.col("n") > LONG, F.array_distinct("x")).alias("hs"))


def set_classes(rows: DataFrame, group: str) -> DataFrame:
    """``profiles`` with ``class_id``: the least id among the group's rows with an equal set; ``r``, if there, is the greatest of them.

    Empty sets are left out.
    """
    rows, top = rows.where("n > 0"), [F.max("r").alias("r")] * ("r" in rows.columns)
    return rows.drop("r").join(rows.groupBy(group, "h").agg(F.min("id").alias("class_id"), *top), [group, "h"]).drop("h")


def _paired(classes: DataFrame, group: str, least: float, *more: str) -> DataFrame:
    """``group, l_id, id, share, l_(more), (more)``: each pair of a group's classes that may have a Jaccard similarity of ``least``, once.

    ``share`` is how much of the difference that such sets may have their fingerprints show. Sets that similar differ in
    (1 - least) / (1 + least) of their summed sizes at most, so no pair is lost. Sizes fall into bands so wide that such sets lie
    in one band or in two neighbouring ones, and only these are compared. Within a band work grows with the square of its sets,
    at a few machine instructions a pair; a band of over ``PART`` sets is cut into parts for tasks.
    """
    fp = [f"f{j}" for j in range(WORDS)]
    band = F.floor(F.log("n") / math.log(1.001 / least)).cast("int")
    one = classes.where("class_id = id").select(group, "id", "n", *fp, "hs", *more, band.alias("k"))
    hot = one.groupBy(group, "k").agg(F.count("*").alias("m")).where(F.col("m") > PART).select(group, "k", F.ceil(F.col("m") / PART).cast("int").alias("parts"))  # at most rows / PART
    tasks = int(one.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = F.coalesce("parts", F.lit(1))
    cut = lambda x, part: x.join(F.broadcast(hot), [group, "k"], "left").withColumn("p", part).drop("parts").repartition(tasks, group, "k", "p")
    left = cut(one, F.pmod(F.xxhash64("id"), parts).cast("int")).select(group, "k", "p", *(F.col(c).alias(f"l_{c}") for c in ("id", "n", *fp, "hs", *more)))
    right = cut(one.withColumn("k", F.explode(F.array(F.col("k"), F.col("k") - 1))), F.explode(F.sequence(F.lit(0), parts - 1)))
    n, ln = F.col("n"), F.col("l_n")
    ordered = (ln < n) | ((ln == n) & (F.col("l_id") < F.col("id")))
    apart = sum((F.bit_count(F.col(f"l_{c}").bitwiseXOR(F.col(c))) for c in fp), F.lit(0))
    most = (1 - least) / (1 + least) * (n + ln) + 1e-6
    may = (ln >= least * n - 1e-6) & (apart <= most)
    # words that share a hash take from what two lists of hashes have in common no more than the longer list lacks
    long = F.size(F.array_intersect("l_hs", "hs")) + (n - F.size("hs")) + 1e-6 >= least / (1 + least) * (n + ln) - 1e-6
    found = left.join(right, [group, "k", "p"]).where(ordered & may & F.when(ln > LONG, long).otherwise(True))
    return found.select(group, "l_id", "id", (apart / most).alias("share"), *(f"l_{c}" for c in more), *more)


def candidates(classes: DataFrame, group: str, least: float) -> DataFrame:
    """``group, a, b``: pairs of a group's classes whose sizes and fingerprints allow a Jaccard similarity of ``least``."""
    return _paired(classes, group, least).select(group, F.least("l_id", "id").alias("a"), F.greatest("l_id", "id").alias("b"))


def _compared(found: DataFrame, df: DataFrame, group: str, key: str, words: Column, least: float) -> DataFrame:
    """``found`` (a table with ``a, b``) with ``sim``, where that is ``least`` or more.

    Only rows whose key hashes to a slot of their side of ``found`` are cut into words and shuffled, each set as one text.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).alias("slot")

    def sets(x: str) -> DataFrame:
        asked = df.where(F.col(group).isNotNull()).withColumn("slot", slot(key)).join(F.broadcast(found.select(slot(x)).distinct()), "slot", "left_semi")
        return asked.select(F.col(key).alias(x), F.array_join(F.array_distinct(words), "\0").alias(f"w{x}"))

    both = found.join(sets("a"), "a").join(sets("b"), "b")
    wa, wb = (F.split(c, "\0") for c in ("wa", "wb"))
    same = F.size(F.array_intersect(wa, wb))
    return both.withColumn("sim", same / (F.size(wa) + F.size(wb) - same)).where(F.col("sim") >= least - 1e-9).drop("wa", "wb")


def similar_sets(df: DataFrame, group: str, key: str, words: Column, least: float = 0.8, *, classes: DataFrame | None = None) -> DataFrame:
    """``group, a, b, sim`` for each pair of different word sets of a group with Jaccard similarity ``least`` or more.

    Equal sets of a group are one class, named by its least ``key``; ``classes`` takes those of ``set_classes`` if they are there
    already. Candidates are found by their fingerprints, then their word sets are compared exactly.
    """
    found = stage(candidates(set_classes(profiles(df, group, key, words), group) if classes is None else classes, group, least), "candidates")
    return _compared(found, df, group, key, words, least).select(group, "a", "b", "sim")


def links(pairs: DataFrame, classes: DataFrame, group: str) -> DataFrame:
    """``id, class_id, n_links, best, partner`` per row: how many other classes its class is like, and the most similar one."""
    side = lambda x, y: F.struct(F.col(x).alias("class_id"), F.col(y).alias("other"))
    both = pairs.select(group, "sim", F.explode(F.array(side("a", "b"), side("b", "a"))).alias("p")).select(group, "p.*", "sim")
    best = both.groupBy(group, "class_id").agg(F.count("*").alias("n_links"), F.max(F.struct("sim", (-F.col("other")).alias("p"))).alias("m"))
    out = classes.join(best, [group, "class_id"], "left")
    return out.select("id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("m.sim", F.lit(0.0)).alias("best"), (-F.col("m.p")).alias("partner"))


def losers(df: DataFrame, group: str, key: str, words: Column, classes: DataFrame, least: float = 0.8) -> DataFrame:
    """``class_id`` of the classes that are like a better one of their group, by the greatest ``r``, ties to the lesser id.

    ``classes`` is a staged table of ``set_classes`` with ``r``. That a class loses takes one better class, so pairs are not listed:
    each class is first compared with the nearest of its better candidates. Only those that this leaves open, of more than
    one candidate, are compared with all of them, in a second search.
    """
    r, lr, i, li = (F.col(c) for c in ("r", "l_r", "id", "l_id"))
    lost = (lr > r) | ((lr == r) & (li < i))  # the right one
    side = lambda x, y: F.when(lost, x).otherwise(y)
    near = _paired(classes, group, least, "r").select(side(i, li).alias("a"), side(li, i).alias("b"), "share")
    nearest = F.coalesce(*(f"b{j}" for j in range(len(NEAR))), "b")  # no struct: its minimum would sort all pairs
    first = near.groupBy("a").agg(F.count("*").alias("m"), F.min("b").alias("b"), *(F.min(F.when(F.col("share") <= v, F.col("b"))).alias(f"b{j}") for j, v in enumerate(NEAR)))
    first = stage(first.select("a", nearest.alias("b"), "m"), "nearest")
    done = stage(_compared(first, df, group, key, words, least).select(F.col("a").alias("class_id")), "losers")
    left = stage(first.where("m > 1").join(done, F.col("a") == F.col("class_id"), "left_anti").select("a", F.col("b").alias("tried")), "open")
    if left.isEmpty():
        return done
    flagged = classes.where("class_id = id").join(left, F.col("id") == F.col("a"), "left").drop("a")
    flagged = flagged.join(flagged.where("tried is not null").select(group).distinct(), group, "left_semi")
    rest = _paired(flagged, group, least, "r", "tried").select(side(i, li).alias("a"), side(li, i).alias("b"), side(F.col("tried"), F.col("l_tried")).alias("tried")).where("tried is not null and tried != b")
    rest = stage(rest.select("a", "b"), "candidates")
    return done.union(stage(_compared(rest, df, group, key, words, least).select(F.col("a").alias("class_id")).distinct(), "losers"))


def decide(rows: DataFrame, lost: DataFrame, origin: str, key: str, order: list, *, cap: int = 12) -> DataFrame:
    """``key, decision``: drop_copy for all of a class but its best row, drop_similar for classes in ``lost``, over_cap, keep.

    ``rows`` has ``key, origin, class_id`` (null: no class) and what ``order`` (best first) needs. Of the rows that are left, ``cap``
    per origin are kept; a null origin has no cap. Row numbers stop at the cap, so a hot origin is cut before it is shuffled.
    """
    own = F.row_number().over(Window.partitionBy("class_id").orderBy(*order, key))
    classed = rows.where("class_id is not null").withColumn("_own", own).join(lost.withColumn("_lost", F.lit(True)), "class_id", "left")
    first = classed.select(key, F.when(F.col("_own") > 1, "drop_copy").when(F.col("_lost"), "drop_similar").alias("_d")).where("_d is not null")
    marked = rows.join(first, key, "left")
    kept = marked.where(F.col("_d").isNull() & F.col(origin).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(origin).orderBy(*order, key))).where(F.col("_r") <= cap).select(key, F.lit(True).alias("_in"))
    out = marked.join(kept, key, "left")
    return out.select(key, F.coalesce("_d", F.when(F.col("_in") | F.col(origin).isNull(), "keep").otherwise("over_cap")).alias("decision"))
