"""Asset audit: registry overview, duplicate marks, predicates, decisions and report tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions.text import cosine, jaccard, trigrams


def overview(df: DataFrame, key: str, item: str, value: str) -> DataFrame:
    """Rows, distinct items, share of rows without a usable value, mean value; per key and in all (``TOTAL``)."""
    usable = F.when(F.col(value) > 0, F.col(value))
    return (
        df.withColumn(key, F.coalesce(key, F.lit("(none)")))
        .rollup(key)
        .agg(F.count("*").alias("n_rows"), F.count_distinct(item).alias("n_items"), (100.0 * F.count_if(usable.isNull()) / F.count("*")).alias("missing_pct"), F.avg(usable).alias("mean_value"), F.grouping(key).alias("_g"))
        .select(F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(key)).alias(key), "n_rows", "n_items", "missing_pct", "mean_value")
    )


def in_several(df: DataFrame, item: str, key: str) -> DataFrame:
    """The items that occur under more than one key; nulls count as neither. Only least and greatest key are compared."""
    return df.where(F.col(item).isNotNull()).groupBy(item).agg(F.min(key).alias("_a"), F.max(key).alias("_b")).where("_a != _b").select(item)


def group_ids(df: DataFrame, key: Column, row: Column) -> DataFrame:
    """Adds ``group_id`` (``grp_`` and the rank of the key's MD5), ``group_size`` to each row; null keys are groups of their own.

    Ranks are the counts of smaller MD5 prefixes plus the rank within the prefix, so no window spans all keys.
    """
    hashed = df.withColumn("_k", F.md5(F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.concat(F.lit("r"), row.cast("string")))))
    sizes = hashed.groupBy("_k").agg(F.count("*").alias("group_size")).withColumn("_p", F.substring("_k", 1, 4))
    before = sizes.groupBy("_p").agg(F.count("*").alias("_c"))
    before = before.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_base"))  # at most 65,536 rows
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_k")) + F.col("_base") - 1
    numbered = sizes.join(F.broadcast(before), "_p").select("_k", "group_size", F.format_string("grp_%06d", rank).alias("group_id"))
    return hashed.join(numbered, "_k").drop("_k")


def band_match(left: DataFrame, right: DataFrame, value: str, width: float, least: float) -> DataFrame:
    """For each left ``(id, name, value)`` the right row within ``width`` of its value with the most similar name.

    Rows meet in buckets of ``width``; each left row looks into its own bucket and the two beside it.
    """
    bucket = F.floor(F.col(value) / width)
    a = left.select(F.col("id").alias("left_id"), F.col("name").alias("left_name"), F.col(value).alias("left_value"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    b = right.select(F.col("id").alias("right_id"), F.col("name").alias("right_name"), F.col(value).alias("right_value"), bucket.alias("_b"))
    pairs = a.join(b, "_b").where(F.abs(F.col("left_value") - F.col("right_value")) < width).withColumn("score", jaccard(trigrams(F.col("left_name")), trigrams(F.col("right_name"))))
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("right_id")))
    return pairs.where(F.col("score") >= least).groupBy("left_id").agg(best.alias("m")).select("left_id", F.col("m.right_id").alias("right_id"), (-F.col("m.s")).alias("score"))


def nearest_of(queries: DataFrame, rows: DataFrame, group: str, item: str, vector: str) -> DataFrame:
    """For each query row the most similar other row of its group by cosine; ties go to the lesser id."""
    q = queries.select(F.col(item).alias("q"), group, F.col(vector).alias("_v"))
    found = q.join(rows.select(item, group, vector), group).where(F.col("q") != F.col(item)).withColumn("sim", F.round(cosine(F.col("_v"), F.col(vector)), 6))
    return found.groupBy("q").agg(F.max(F.struct("sim", (-F.col(item)).alias("i"))).alias("m")).select(F.col("q").alias(item), (-F.col("m.i")).alias("partner"), F.col("m.sim").alias("sim"))


def _best_of_blocks(item: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The function for ``applyInPandas``: each row of block ``_a`` with the most similar row of ``_b``, and the other way round."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(item)  # the first of equals is the least id
        a, b = p[p["_block"] == p["_a"]], p[p["_block"] == p["_b"]]
        if a.empty or b.empty:
            return pd.DataFrame({"item": p[item][:0], "partner": p[item][:0], "sim": pd.Series(dtype=float)})

        def unit(rows: pd.DataFrame) -> np.ndarray:
            v = np.stack(rows["_v"].to_numpy()).astype(np.float64)
            norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
            return np.where(norm < 1e-8, 0.0, v / np.maximum(norm, 1e-8))

        left, right = a[item].to_numpy(), b[item].to_numpy()
        sims = np.round(unit(a) @ unit(b).T, 6)
        sims[left[:, None] == right[None, :]] = -np.inf  # a row is no partner of itself
        j, i = sims.argmax(axis=1), sims.argmax(axis=0)
        out = pd.DataFrame({"item": left, "partner": right[j], "sim": sims[np.arange(len(left)), j]})
        if p["_a"].iloc[0] != p["_b"].iloc[0]:
            out = pd.concat([out, pd.DataFrame({"item": right, "partner": left[i], "sim": sims[i, np.arange(len(right))]})])
        return out[out["sim"] > 0]

    return run


def near_marks(rows: DataFrame, group: str, item: str, vector: str, least: float, *, block: int = 1000) -> DataFrame:
    """Every row with its most similar other row of its group by cosine: ``item, partner, sim, near_dup``.

    ``near_dup`` holds over similarity ``least``; ties go to the lesser id. Without a similarity over 0, a group or a vector
    the partner is null and ``sim`` 0. Groups are hashed into blocks of about ``block`` rows and each pair of blocks is one
    product of matrices, so no pair is left out and a task holds two blocks; the work grows with the square of a group.
    """
    some = rows.where(F.col(group).isNotNull() & F.col(vector).isNotNull()).select(item, group, F.col(vector).alias("_v"))
    blocks = some.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    placed = some.join(blocks, group).withColumn("_block", F.pmod(F.xxhash64(item), "_n").cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    met = placed.select(item, group, "_v", "_block", F.least("_block", "_o").alias("_a"), F.greatest("_block", "_o").alias("_b"))
    kind = rows.schema[item].dataType.simpleString()
    best = met.groupBy(group, "_a", "_b").applyInPandas(_best_of_blocks(item), f"item {kind}, partner {kind}, sim double")
    first = best.groupBy(F.col("item").alias(item)).agg(F.min(F.struct((-F.col("sim")).alias("s"), "partner")).alias("m"))
    out = rows.select(item).join(first, item, "left").select(item, F.col("m.partner").alias("partner"), F.coalesce(-F.col("m.s"), F.lit(0.0)).alias("sim"))
    return out.withColumn("near_dup", F.col("partner").isNotNull() & (F.col("sim") > least))


_TESTS = {
    "min": lambda c, v: F.coalesce(c >= v, F.lit(False)),
    "lower": lambda c, v: F.coalesce(F.lower(F.trim(c)) == v.lower(), F.lit(False)),
    "in": lambda c, v: F.coalesce(c.isin(*v), F.lit(False)),
    "eq": lambda c, v: F.coalesce(c == v, F.lit(False)),
}


def predicate(any_of: list[dict]) -> Column:
    """``any_of`` groups of conditions ``{column or column__test: value}`` as one column; missing values fail every test."""

    def one(key: str, value) -> Column:
        column, _, test = key.partition("__")
        return _TESTS[test or "eq"](F.col(column), value)

    groups = [reduce(lambda a, b: a & b, (one(k, v) for k, v in g.items()), F.lit(True)) for g in any_of]
    return reduce(lambda a, b: a | b, groups, F.lit(False))


def levels(df: DataFrame, rules: dict[str, list[dict]], otherwise: str, out: str = "level") -> DataFrame:
    """The first rule that holds names the row's level."""
    c = None
    for name, any_of in rules.items():
        c = F.when(predicate(any_of), name) if c is None else c.when(predicate(any_of), name)
    return df.withColumn(out, c.otherwise(otherwise) if c is not None else F.lit(otherwise))


def keep_first(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; Spark limits each group before the shuffle as well as after."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def most_common(df: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """``keys, value, n, rank``: the ``k`` most frequent values of each key; ties go to the lesser value."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), value)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    """One row that describes how large the groups of ``key`` are; null is no group."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    return g.agg(F.count("*").alias("n_groups"), F.avg("_n").alias("mean"), F.stddev_samp("_n").alias("std"), F.min("_n").alias("least"), F.max("_n").alias("most"), F.median("_n").alias("median"))


def flags(df: DataFrame, rates: dict) -> DataFrame:
    """``name, value, flagged`` of each aggregate in ``rates`` (``{name: (aggregate, bound)}``): flagged where it is over its bound."""
    row = df.agg(*(a.alias(k) for k, (a, _) in rates.items()))
    return row.select(F.inline(F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("value"), (F.col(k) > b).alias("flagged")) for k, (_, b) in rates.items()))))


def last_steps(df: DataFrame, step: str, n: int) -> DataFrame:
    """The rows of the last ``n`` steps, by a broadcast maximum (one row)."""
    top = df.agg((F.max(step) - n).alias("_lo"))
    return df.join(F.broadcast(top), F.col(step) > F.col("_lo")).drop("_lo")
