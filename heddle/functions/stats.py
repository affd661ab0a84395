"""Ranks, percentiles and group-normalised values as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nearest_rank_by(df: DataFrame, keys: list[str], value: str, points: dict[str, float], *, steps: int = 256) -> DataFrame:
    """Nearest-rank percentiles of ``value`` per key, with ``n``: the element at index floor(n p) of the sorted values.

    Bounds of ``steps`` spans per key come from a sketch; the spans are counted exactly, and only the span that holds a
    percentile is ordered by value. So few keys with very many values are spread over tasks. Nulls don't count.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("_v", [i / steps for i in range(1, steps)], 10_000).alias("_b"))
    spans = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_c")).join(cuts, keys).withColumn("_s", F.size(F.filter("_b", lambda x: x < F.col("_v")))).drop("_b")
    totals = spans.groupBy(*keys, "_s").agg(F.sum("_c").alias("_t"))
    run = totals.withColumn("_to", F.sum("_t").over(Window.partitionBy(*keys).orderBy("_s"))).withColumn("n", F.sum("_t").over(Window.partitionBy(*keys)))  # steps rows a key
    at = [F.struct(F.lit(k).alias("k"), F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p))).alias("i")) for k, p in points.items()]
    edges = run.select(*keys, "_s", "n", (F.col("_to") - F.col("_t")).alias("_from"), "_to", F.explode(F.array(*at)).alias("p")).where("p.i < _to and p.i >= _from")
    w = Window.partitionBy(*keys, "_s", "p.k").orderBy("_v")
    inside = spans.join(edges, [*keys, "_s"]).withColumn("_u", F.sum("_c").over(w) + F.col("_from"))
    return inside.groupBy(*keys).agg(F.max("n").alias("n"), *(F.min(F.when((F.col("p.k") == k) & (F.col("_u") > F.col("p.i")), F.col("_v"))).alias(k) for k in points))


def centred(x: Column, mask: Column, keys: list[str]) -> Column:
    """``x`` less the mean of its group's unmasked values; 0 where masked or without any."""
    m = F.avg(F.when(mask, x)).over(Window.partitionBy(*keys))
    return F.when(mask, x - m).otherwise(0.0)


def z_population(x: Column, keys: list[str], eps: float = 1e-4) -> Column:
    w = Window.partitionBy(*keys)
    return (x - F.avg(x).over(w)) / (F.stddev_pop(x).over(w) + eps)


def z_sample(x: Column, keys: list[str], eps: float = 1e-6) -> Column:
    """Standard score with the sample deviation; a single value stays as it is."""
    w = Window.partitionBy(*keys)
    return F.when(F.count(x).over(w) == 1, x).otherwise((x - F.avg(x).over(w)) / (F.stddev_samp(x).over(w) + eps))


def whitened(df: DataFrame, x: str, out: str, eps: float = 1e-4) -> DataFrame:
    """``x`` less its mean over its sample deviation, over the whole table; the two figures are one broadcast row."""
    s = df.agg(F.avg(x).alias("_m"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("_s"))
    return df.join(F.broadcast(s)).withColumn(out, (F.col(x) - F.col("_m")) / (F.col("_s") + eps)).drop("_m", "_s")


def mixed(outcome: Column, state: Column, keys: list[str], more: list[str], alpha: float = 0.7) -> Column:
    """alpha times the advantage of ``outcome`` within ``keys`` plus the rest times that of ``state`` within ``keys`` and ``more``."""
    return alpha * z_sample(outcome, keys) + (1 - alpha) * z_sample(state, [*keys, *more])


def group_metrics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: the mean of all values, the mean of the groups' sample variances (single values have none), the groups."""
    g = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"), F.var_samp(value).alias("_v"))
    return g.agg((F.sum("_s") / F.sum("_n")).alias("mean"), F.avg("_v").alias("mean_variance"), F.count("*").alias("n_groups"))
