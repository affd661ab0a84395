"""Choosing chunks for cards and placing questions: families of evidence, ranges to compress, availability and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The share of keywords that must stay, by how well a family is retained; and for summaries.
RETAINED = {"low": 0.5, "medium": 0.35, "high": 0.2}
RETAINED_SUMMARY = 0.3


def diverse(df: DataFrame, keys: list[str], at: str, items: str, most: int = 8) -> DataFrame:
    """``keys, picks``: positions in order that hold an item which the last pick does not, ``most`` at most.

    What is picked depends on the pick before, so a timeline's item sets are folded in order; positions without items and
    those that repeat their predecessor exactly can't be picked and are left out first.
    """
    w = Window.partitionBy(*keys).orderBy(at)
    sets = df.select(*keys, at, F.array_sort(F.array_distinct(items)).alias("_s")).where(F.size("_s") > 0)
    sets = sets.withColumn("_b", F.lag("_s").over(w)).where(F.col("_b").isNull() | (F.col("_b") != F.col("_s"))).drop("_b")
    ordered = sets.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(at, "_s"))).alias("_o"))
    kind = sets.schema
    start = F.struct(F.array().cast(f"array<{kind[at].dataType.simpleString()}>").alias("picks"), F.array().cast(kind["_s"].dataType).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        take = (F.size(acc["picks"]) < most) & (F.size(F.array_except(x["_s"], acc["last"])) > 0)
        return F.struct(F.when(take, F.concat(acc["picks"], F.array(x[at]))).otherwise(acc["picks"]).alias("picks"), F.when(take, x["_s"]).otherwise(acc["last"]).alias("last"))

    return ordered.select(*keys, F.aggregate("_o", start, step)["picks"].alias("picks"))


def best_range(df: DataFrame, keys: list[str], at: str, gain: str, least: int, most: int) -> DataFrame:
    """``keys, first, size, mean``: the run of ``least`` to ``most`` rows in sequence with the greatest mean gain.

    Sums of all runs come from running sums, looked up at each size by lag: one sort, no join. Ties go to the longer, then to
    the earlier run; timelines under ``least`` rows have none.
    """
    w = Window.partitionBy(*keys).orderBy(at)
    run = df.withColumn("_c", F.sum(gain).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_r", F.row_number().over(w))
    sized = [F.when(F.col("_r") >= n, F.struct(((F.col("_c") - F.coalesce(F.lag("_c", n).over(w), F.lit(0.0))) / n).alias("mean"), F.lit(n).alias("size"), (-F.lag(at, n - 1).over(w) if n > 1 else -F.col(at)).alias("first"))) for n in range(least, most + 1)]
    best = run.select(*keys, F.array_max(F.array_compact(F.array(*sized))).alias("_m")).where("_m is not null")
    return best.groupBy(*keys).agg(F.max("_m").alias("_m")).select(*keys, (-F.col("_m.first")).alias("first"), F.col("_m.size").alias("size"), F.col("_m.mean").alias("mean"))


def availability(ask: Column, first: Column, last: Column, recent: Column, compressed: Column, window: int = 16) -> Column:
    """Where the answer to a question asked at ``ask`` can be seen, from its support's first and last chunk.

    in_future, in_visual (within the last ``window`` chunks), in_recent (a kept think), in_compressed (a kept summary),
    in_history, else unavailable.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(first > ask), "in_future").when(yes((last >= ask - window + 1) & (first <= ask)), "in_visual").when(yes(recent), "in_recent").when(yes(compressed), "in_compressed").when(yes(last < ask), "in_history").otherwise("unavailable")


def contained(text: Column, words: Column) -> Column:
    """The share of ``words`` that ``text`` holds; null without words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.try_divide(F.size(F.filter(words, lambda w: F.contains(low, w))), F.size(words))


def gold_captions(df: DataFrame, keys: list[str], facts: str, least: float = 0.75, most: int = 12) -> DataFrame:
    """``keys, captions``: the surest facts of each key, most confident first, ties by text, ``most`` at most."""
    rows = df.select(*keys, F.explode(facts).alias("f")).where((F.col("f.confidence") >= least) & F.col("f.fact").isNotNull())
    rows = rows.select(*keys, F.col("f.confidence").alias("s"), F.col("f.fact").alias("t")).distinct()
    w = Window.partitionBy(*keys).orderBy(F.desc("s"), "t")
    top = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]).alias("captions"))


def last_marks(df: DataFrame, keys: list[str], at: str, is_mark: Column, n: int = 2) -> DataFrame:
    """The last ``n`` marked positions of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at))
    rows = df.where(is_mark).select(*keys, at).distinct()
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def nearest(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Each position with the distance to its nearest neighbour and the gap to the next; null where there is none."""
    w = Window.partitionBy(*keys).orderBy(at)
    rows = df.select(*keys, at).distinct()
    gap = F.lead(at).over(w) - F.col(at)
    return rows.withColumn("gap", gap).withColumn("nearest", F.least(F.col("gap"), F.col(at) - F.lag(at).over(w)))


def frame_names(chunk: Column, per_chunk: int = 2, pattern: str = "frame_%06d.jpg") -> Column:
    """The frame files of a chunk: ``per_chunk`` numbers from one on."""
    return F.transform(F.sequence(chunk * per_chunk + 1, chunk * per_chunk + per_chunk), lambda i: F.format_string(pattern, i))
