"""Evaluation tables: accuracies, gates, confusion, timing rewards and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def macro_accuracy(df: DataFrame, task: str, category: str, correct: Column) -> DataFrame:
    """Per category the mean of its tasks' accuracies, and their mean as ``OVERALL``."""
    by_task = df.groupBy(category, task).agg(F.avg(correct.cast("double")).alias("acc"), F.count("*").alias("n"))
    by = by_task.groupBy(F.col(category).alias("category")).agg(F.avg("acc").alias("acc"), F.sum("n").alias("n"))
    return by.unionByName(by.agg(F.lit("OVERALL").alias("category"), F.avg("acc").alias("acc"), F.sum("n").alias("n")))


def gates(df: DataFrame, rates: dict[str, tuple[Column, Column, float]]) -> DataFrame:
    """``name, value, passed`` of each rate (numerator, denominator, least value); without a denominator it passes."""
    row = df.agg(*(F.try_divide(F.count_if(a & b), F.count_if(b)).alias(k) for k, (a, b, _) in rates.items()))
    items = [F.struct(F.lit(k).alias("name"), F.col(k).alias("value"), F.coalesce(F.col(k) >= least, F.lit(True)).alias("passed")) for k, (*_, least) in rates.items()]
    return row.select(F.inline(F.array(*items)))


def confusion(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of ``column`` values per ``row``, one column each."""
    return df.groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values))


def last_n_mean(df: DataFrame, keys: list[str], step: str, value: str, n: int) -> DataFrame:
    """The mean of the last ``n`` values of each key, the mean of all its values, and their difference.

    All values are averaged by partial aggregation; only ``n`` rows a key and task are ordered.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(step).desc())
    last = df.select(*keys, step, value).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).groupBy(*keys).agg(F.avg(value).alias("last_mean"))
    out = df.groupBy(*keys).agg(F.avg(value).alias("mean")).join(last, keys, "left")
    return out.withColumn("delta", F.col("last_mean") - F.col("mean"))


def per_class(df: DataFrame, cls: str, loss: str, weight: str) -> DataFrame:
    """Rows, mean loss, mean weight and share of all rows per class, and for ``_all`` together."""
    out = df.rollup(cls).agg(F.grouping(cls).alias("_g"), F.count("*").alias("n"), F.avg(loss).alias("mean_loss"), F.avg(weight).alias("mean_weight"))
    total = F.max(F.when(F.col("_g") == 1, F.col("n"))).over(Window.partitionBy())  # one row a class
    return out.select(F.when(F.col("_g") == 1, "_all").otherwise(F.col(cls)).alias(cls), "n", "mean_loss", "mean_weight", (F.col("n") / total).alias("fraction"))


def profile(df: DataFrame, dims: list[str], value: str) -> DataFrame:
    """Counts and sums by each dimension alone: one pass over rows that stand once per dimension."""
    rows = df.select(F.inline(F.array(*(F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d).cast("string"), F.lit("(none)")).alias("name")) for d in dims))), F.col(value).alias("_v"))
    return rows.groupBy("dim", "name").agg(F.count("*").alias("n"), F.sum("_v").alias("total"))
