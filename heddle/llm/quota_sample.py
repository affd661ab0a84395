"""Samples that match target category proportions (problem 1).

Categories are counted, integer quotas are allocated by largest remainder between minimum floors and availability caps,
and each category gives its rows with the smallest random keys. The quota-th smallest key of a category is found in a
histogram of key prefixes, so only the rows that share one prefix with it are ever ranked: no category, however large,
is sorted or gathered in a task.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from heddle.llm.common import clean_type, random_key
from heddle.session import stage

PREFIX_BITS = 16
KEY_BITS = 60

REPORT = T.StructType(
    [T.StructField(n, t) for n, t in (("plan_id", T.IntegerType()), ("sample_type", T.StringType()), ("draw_rows", T.LongType()), ("asked", T.LongType()), ("available", T.LongType()), ("quota", T.LongType()), ("short_by", T.LongType()), ("under_by", T.LongType()), ("overdrawn", T.LongType()))]
)


def latest_rows(samples: DataFrame) -> DataFrame:
    """One row per ``sample_id`` with its latest version's usable type; ids whose latest type is unusable are left out.

    Ties in ``logged_at`` are decided by the greater type, exact copies count once, a null ``sample_id`` is no sample.
    """
    return (
        samples.select("sample_id", F.struct(F.col("logged_at"), clean_type(F.col("sample_type")).alias("sample_type")).alias("v"))
        .where(F.col("sample_id").isNotNull())
        .groupBy("sample_id")
        .agg(F.max("v").alias("v"))
        .select("sample_id", F.col("v.sample_type").alias("sample_type"))
        .where(F.col("sample_type").isNotNull())
    )


def largest_remainder(total: int, shares: dict, floors: dict, caps: dict) -> dict:
    """Whole quotas that sum to ``total`` as far as floors and caps allow, in proportion to ``shares``.

    A category whose proportional part lies outside [floor, cap] is set to the bound; the rest is shared out anew among the
    others until none lies outside. Equal remainders go to the lesser name. A floor above its cap gives the cap.
    """
    low = {k: min(floors[k], caps[k]) for k in shares}
    fixed: dict = {}
    while True:
        free = [k for k in shares if k not in fixed]
        rest, whole = total - sum(fixed.values()), sum(shares[k] for k in free)
        part = {k: Fraction(max(0, rest)) * shares[k] / whole if whole else Fraction(0) for k in free}
        over = {k: caps[k] for k in free if part[k] > caps[k]}
        under = {k: low[k] for k in free if part[k] < low[k]}
        gain, loss = sum(part[k] - v for k, v in over.items()), sum(v - part[k] for k, v in under.items())
        if not over and not under:
            break
        fixed |= over if gain >= loss and over else under
    quota = {k: int(part[k]) for k in free}
    left = min(max(0, rest), math.floor(sum(part.values()))) - sum(quota.values())
    for k in sorted(free, key=lambda k: (quota[k] - part[k], str(k))):
        if left > 0 and quota[k] < caps[k]:
            quota[k], left = quota[k] + 1, left - 1
    return quota | fixed


def allocate(counts: dict, plans: list, targets: list) -> list:
    """Rows of REPORT. ``plans``: (plan_id, draw_pct); ``targets``: (plan_id, sample_type, target_pct, min_rows).

    A plan draws floor(draw_pct * N / 100) rows; shares of over 100 in all are scaled down to it, a sum under 100 draws less.
    A target asks for the greater of its minimum and its share, rounded up; nulls count as 0. ``short_by`` is what the rows
    lack of it, ``under_by`` what the quota lacks of it for whatever reason, ``overdrawn`` by how many rows the minimums take the
    plan's sample over its size. Of several targets for one type the greatest share and minimum hold. Targets of a plan that
    is not given are reported without numbers.
    """
    n_all, rows = sum(counts.values()), []
    for plan, pct in sorted(set(plans), key=str):
        n = (pct or 0) * n_all // 100
        mine: dict = {}
        for p, t, share, least in targets:
            if p == plan:
                was = mine.get(t, (0, 0))
                mine[t] = max(share or 0, was[0]), max(least or 0, was[1])
        shares = {t: Fraction(share) for t, (share, _) in mine.items()}
        total = n * min(100, sum(shares.values(), Fraction(0))) / 100
        quota = largest_remainder(int(total), shares, {t: least for t, (_, least) in mine.items()}, {t: counts.get(t, 0) for t in mine})
        for t, (share, least) in sorted(mine.items(), key=lambda x: str(x[0])):
            asked, there = max(least, -(-share * n // 100)), counts.get(t, 0)
            rows.append((plan, t, n, asked, there, quota[t], max(0, asked - there), max(0, asked - quota[t]), max(0, sum(quota.values()) - int(total))))
    known = {p for p, _ in plans}
    return rows + [(p, t, *[None] * 7) for p, t in sorted({(p, t) for p, t, *_ in targets if p not in known}, key=str)]


def sample_by_targets(samples: DataFrame, plans: DataFrame, targets: DataFrame, *, seed: int = 42, max_targets: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """``(sample, report)``: the rows drawn for each plan (``plan_id, sample_type, sample_id``) and what each target got.

    ``report`` has ``plan_id, sample_type, draw_rows, asked, available, quota, short_by, under_by, overdrawn`` (see ``allocate``);
    ``short_by`` is positive where the rows do not suffice. The sizes of ``plans`` and ``targets`` are checked against ``max_targets`` before they are gathered;
    the counts are one row per category that a target may name. Empty tables give an empty sample and full shortfalls.
    """
    spark = samples.sparkSession
    rows = stage(latest_rows(samples).withColumn("key", random_key(seed, F.col("sample_id"))), "quota-rows")
    prefix = F.shiftright("key", KEY_BITS - PREFIX_BITS)
    histogram = rows.groupBy("sample_type", prefix.alias("prefix")).agg(F.count("*").alias("n"))
    counts = {r.sample_type: r.n for r in rows.groupBy("sample_type").agg(F.count("*").alias("n")).collect()}
    small = [plans.select("plan_id", "draw_pct"), targets.select("plan_id", "sample_type", "target_pct", "min_rows")]
    plan_rows, target_rows = ([tuple(r) for r in x.limit(max_targets + 1).collect()] for x in small)
    if max(len(plan_rows), len(target_rows)) > max_targets:
        raise ValueError(f"more than {max_targets} plans or targets; raise max_targets if the driver can hold them")
    report_rows = allocate(counts, plan_rows, target_rows)
    report = spark.createDataFrame(report_rows, REPORT)

    quotas = F.broadcast(report.where("quota > 0").select("plan_id", "sample_type", "quota"))  # at most max_targets rows
    running = F.sum("n").over(Window.partitionBy("sample_type").orderBy("prefix"))  # 2^PREFIX_BITS rows a category
    edge = (
        histogram.withColumn("upto", running)
        .join(quotas, "sample_type")
        .where((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota")))
        .select("plan_id", "sample_type", F.col("prefix").alias("edge"), (F.col("quota") - F.col("upto") + F.col("n")).alias("need"))
    )
    near = rows.withColumn("prefix", prefix).join(F.broadcast(edge), "sample_type").where("prefix <= edge")  # edge: as few rows as quotas
    order = Window.partitionBy("plan_id", "sample_type").orderBy("key", "sample_id")
    ranked = near.where("prefix = edge").withColumn("rank", F.row_number().over(order)).where("rank <= need")
    out = ["plan_id", "sample_type", "sample_id"]
    return near.where("prefix < edge").select(*out).unionByName(ranked.select(*out)), report


def unmet_targets(samples: DataFrame, plans: DataFrame, targets: DataFrame) -> DataFrame:
    """``(plan_id, sample_type)`` of the targets for which the rows do not suffice."""
    return sample_by_targets(samples, plans, targets)[1].where("short_by > 0").select("plan_id", "sample_type")
