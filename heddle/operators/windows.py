"""Windows over timelines: runs, changes, gaps, bins, sliding views and as-of lookups.

``keys`` name a timeline, ``at`` its integer position; rows of equal position are ordered by ``tie``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def runs(df: DataFrame, keys: list[str], order: list[str], value: str, least: int) -> DataFrame:
    """Runs of ``least`` or more equal consecutive values: first and last position and length."""
    w = Window.partitionBy(*keys).orderBy(*order)
    v = Window.partitionBy(*keys, value).orderBy(*order)
    island = df.withColumn("_i", F.row_number().over(w) - F.row_number().over(v))
    return island.groupBy(*keys, value, "_i").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("length")).where(F.col("length") >= least).drop("_i")


def changes(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before, with that one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("before", F.lag(value).over(w)).where(F.col("before").isNotNull() & (F.col("before") != F.col(value)))


def reappearances(df: DataFrame, keys: list[str], at: str, gap: int) -> DataFrame:
    """Positions that come ``gap`` or more after the previous one of the same keys."""
    rows = df.select(*keys, at).distinct()
    w = Window.partitionBy(*keys).orderBy(at)
    return rows.withColumn("gap", F.col(at) - F.lag(at).over(w)).where(F.col("gap") >= gap)


def first_seen(df: DataFrame, keys: list[str], item: str, at: str) -> DataFrame:
    """The first position of each item, and how many items each position sees first."""
    return df.where(F.col(item).isNotNull()).groupBy(*keys, item).agg(F.min(at).alias(at)).groupBy(*keys, at).agg(F.count("*").alias("n_new"))


def best_per_bin(df: DataFrame, keys: list[str], at: str, score: str, item: str, bins: int) -> DataFrame:
    """The row of the highest score in each of ``bins`` equal stretches of a timeline; ties go to the lesser item."""
    span = df.groupBy(*keys).agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    rows = df.join(span, keys)
    width = F.greatest(F.lit(1), F.col("_b") - F.col("_a"))
    rows = rows.withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col(at) - F.col("_a")) * bins / width)).cast("int"))
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(item)).alias("i")))
    return rows.where(F.col(score).isNotNull()).groupBy(*keys, "bin").agg(best.alias("m")).select(*keys, "bin", (-F.col("m.i")).alias(item), F.col("m.s").alias(score))


def evenly(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """At most ``k`` rows of each timeline at even steps, its first and last among them (k > 1)."""
    w, g = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys)
    rows = df.withColumn("_r", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(g))
    # r is chosen if it is floor(i * (n - 1) / (k - 1)) of some i
    i = F.ceil(F.col("_r") * (k - 1) / F.greatest(F.lit(1), F.col("_n") - 1))
    chosen = (F.col("_n") <= k) | ((i < k) & (F.floor(i * (F.col("_n") - 1) / (k - 1)) == F.col("_r")))
    return rows.where(chosen).drop("_r", "_n")


def leading(df: DataFrame, keys: list[str], order: list[str], share: float) -> DataFrame:
    """The first ``share`` of each timeline's rows, one at least."""
    w, g = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys)
    return df.withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count("*").over(g)).where(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))).drop("_r", "_n")


def sliding(df: DataFrame, keys: list[str], at: str, back: int, **aggs: Column) -> DataFrame:
    """Aggregates over the last ``back`` positions and the row's own."""
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(-back, 0)
    return df.select("*", *(a.over(w).alias(k) for k, a in aggs.items()))


def budget_cut(df: DataFrame, keys: list[str], order: list[str], cost: str, target: int, least: int, most: int) -> DataFrame:
    """How many of a timeline's oldest rows reach ``target`` cost, at least ``least`` and at most ``most``; null if they never do."""
    w = Window.partitionBy(*keys).orderBy(*order)
    run = df.withColumn("_c", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_r", F.row_number().over(w))
    hit = F.min(F.when((F.col("_c") >= target) & (F.col("_r") >= least) & (F.col("_r") <= most), F.col("_r")))
    return run.groupBy(*keys).agg(F.max("_r").cast("long").alias("n_rows"), hit.cast("long").alias("n_cut"))


def last_before(df: DataFrame, keys: list[str], order: list[str], is_fact: Column, value: str, out: str) -> DataFrame:
    """As-of lookup backwards: the last fact at or before each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(F.when(is_fact, F.col(value)), ignorenulls=True).over(w))


def next_after(df: DataFrame, keys: list[str], order: list[str], is_fact: Column, value: str, out: str) -> DataFrame:
    """As-of lookup forwards: the first fact after each row, as the last one before it in reverse order (a growing frame)."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(o).desc() for o in order)).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.last(F.when(is_fact, F.col(value)), ignorenulls=True).over(w))


def answered_in_window(asks: DataFrame, answers: DataFrame, keys: list[str], at: str, wait: int) -> DataFrame:
    """The first answer of each ask before the next ask and within ``wait``: both sides as one ordered timeline, no join.

    ``asks`` and ``answers`` have ``keys`` and ``at``; several at one position count once, an answer follows an ask there.
    """
    rows = asks.select(*keys, at, F.lit(0).alias("_k")).distinct().unionByName(answers.select(*keys, at, F.lit(1).alias("_k")).distinct())
    for k, out in ((1, "_a"), (0, "_n")):
        rows = rows.withColumn("_p", F.col(at))
        rows = next_after(rows, keys, [at, "_k"], F.col("_k") == k, "_p", out)
    upto = F.least(F.col(at) + wait, F.coalesce(F.col("_n") - 1, F.col(at) + wait))
    return rows.where("_k = 0").select(*keys, F.col(at).alias("ask"), F.when(F.col("_a") <= upto, F.col("_a")).alias("answer"))


def open_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """How many intervals are open after each start, from a running sum of starts and ends; ends come first at a tie."""
    events = df.select(*keys, F.col(start).alias("at"), F.lit(1).alias("d")).unionByName(df.select(*keys, F.col(end).alias("at"), F.lit(-1).alias("d")))
    steps = events.where("at is not null").groupBy(*keys, "at").agg(F.sum("d").alias("d"))
    return steps.select(*keys, "at", F.sum("d").over(Window.partitionBy(*keys).orderBy("at")).alias("n_open"))


def quiet_share(df: DataFrame, keys: list[str], at: str, is_ask: Column, radius: int) -> DataFrame:
    """The share of a timeline's positions, first to last, that lie farther than ``radius`` from any ask.

    Each ask covers what the one before has not, so the covered stretches are summed without listing positions.
    """
    span = df.groupBy(*keys).agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    asks = df.where(is_ask).select(*keys, at).distinct().join(span, keys)
    w = Window.partitionBy(*keys).orderBy(at)
    start = F.greatest(F.col("_a"), F.col(at) - radius, F.coalesce(F.lag(at).over(w) + radius + 1, F.col("_a")))
    covered = asks.withColumn("_c", F.greatest(F.lit(0), F.least(F.col("_b"), F.col(at) + radius) - start + 1)).groupBy(*keys).agg(F.sum("_c").alias("_c"))
    n = F.col("_b") - F.col("_a") + 1
    return span.join(covered, keys, "left").select(*keys, ((n - F.coalesce("_c", F.lit(0))) / n).alias("quiet"))


def roles(df: DataFrame, keys: list[str], at: str, spreads: dict[str, tuple[Column, int, int]]) -> DataFrame:
    """``keys, at, role``: each marked row gives its role to the positions from ``before`` to ``after`` it.

    ``spreads`` is ``{role: (mark, before, after)}`` in order of priority; the foremost role of a position wins.
    """
    marked = [F.when(m, F.struct(F.lit(i).alias("p"), F.lit(r).alias("role"), F.lit(-b).alias("lo"), F.lit(a).alias("hi"))) for i, (r, (m, b, a)) in enumerate(spreads.items())]
    rows = df.select(*keys, at, F.inline(F.array_compact(F.array(*marked))))
    wide = rows.select(*keys, F.explode(F.sequence(F.col(at) + F.col("lo"), F.col(at) + F.col("hi"))).alias(at), "p", "role")
    return wide.groupBy(*keys, at).agg(F.min_by("role", "p").alias("role"))
