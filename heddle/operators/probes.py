"""Scoring of benchmark probes against the answers of a stream.

Asks and answers meet by key and chunk; each function pre-aggregates to one row per probe, so no conversation is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_answers(asks: DataFrame, answers: DataFrame, keys: list[str], wait: int) -> DataFrame:
    """``keys, ask, chunk, answer, n_early``: the first non-empty answer from ``ask`` to ``wait`` chunks after it.

    ``asks`` has ``keys, ask`` (one row per key), ``answers`` has ``keys, c, a, tie``. ``n_early`` counts answers before the ask.
    """
    both = answers.join(asks, keys)
    said = F.coalesce(F.col("a") != "", F.lit(False))
    inside = said & F.col("c").between(F.col("ask"), F.col("ask") + wait)
    best = both.groupBy(*keys).agg(F.min(F.when(inside, F.struct("c", "tie", "a"))).alias("f"), F.count_if(F.col("c") < F.col("ask")).alias("n_early"))
    return asks.join(best, keys, "left").select(*keys, "ask", F.col("f.c").alias("chunk"), F.col("f.a").alias("answer"), F.coalesce("n_early", F.lit(0)).alias("n_early"))


def count_at(probes: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, probe, chunk, answer``: the answer at the probe's chunk or the last one before it, as one ordered timeline.

    ``probes`` has ``keys, c``; ``answers`` has ``keys, c, a``, one a chunk; empty ones don't count.
    """
    rows = answers.where("a != ''").select(*keys, "c", F.lit(0).alias("_k"), F.struct("c", "a").alias("_f")).unionByName(probes.select(*keys, "c").distinct().select(*keys, "c", F.lit(1).alias("_k"), F.lit(None).alias("_f")))
    w = Window.partitionBy(*keys).orderBy("c", "_k").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_l", F.last("_f", ignorenulls=True).over(w)).where("_k = 1")
    return out.select(*keys, F.col("c").alias("probe"), F.col("_l.c").alias("chunk"), F.col("_l.a").alias("answer"))


def yes_no_at(probe_type: Column, answered: Column, silent: Column, yes: Column, no: Column) -> Column:
    """A struct of ``strict, lenient, false_positive``: type 0 expects a no (silence counts leniently), type 1 a yes."""
    said_yes, said_no = answered & yes, answered & no
    return F.struct(
        F.when(probe_type == 0, said_no).otherwise(said_yes).alias("strict"),
        F.when(probe_type == 0, silent | said_no).otherwise(said_yes).alias("lenient"),
        ((probe_type == 0) & said_yes).alias("false_positive"),
    )


def by_span(df: DataFrame, at: str, width: int, correct: Column) -> DataFrame:
    """Counts and accuracy by spans of ``width`` chunks."""
    span = (F.floor(F.col(at) / width) * width).cast("long")
    return df.groupBy(span.alias("span")).agg(F.count("*").alias("n"), F.avg(correct.cast("double")).alias("accuracy"))


def worst(df: DataFrame, keys: list[str], correct: Column, k: int) -> DataFrame:
    """The ``k`` keys with most wrong probes; ties go to the lesser key."""
    wrong = df.groupBy(*keys).agg(F.count_if(~correct).alias("n_wrong"), F.count("*").alias("n"))
    return wrong.orderBy(F.desc("n_wrong"), *keys).limit(k)


def overall_of(by_category: DataFrame, parts: int) -> DataFrame:
    """The sum of the categories' accuracies over a fixed number of them, present or not."""
    return by_category.agg((F.sum("acc") / parts).alias("overall"), F.count("*").alias("n_categories"))
