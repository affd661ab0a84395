"""Deterministic samples and splits: order is by MD5 of a seed and the key, alike in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shuffled(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), key.cast("string")))


def split_keys(df: DataFrame, key: str, shares: dict[str, float], seed: str = "split-") -> DataFrame:
    """``(key, split)``: distinct keys in shuffled order cut at floor(n * cumulated share); the last split takes the rest.

    A key's rank is the count of smaller hash prefixes plus the rank within its prefix, so nothing is sorted in one task.
    """
    keys = df.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_h", shuffled(F.col(key), seed)).withColumn("_p", F.substring("_h", 1, 4))
    counts = keys.groupBy("_p").agg(F.count("*").alias("_c"))
    all_rows = F.sum("_c").over(Window.partitionBy())
    base = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_base"), all_rows.alias("_n"))  # at most 65,536 rows
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_h", key)) + F.col("_base")
    ranked = keys.join(F.broadcast(base), "_p").withColumn("_r", rank)
    split, total = None, 0.0
    names = list(shares)
    for name in names[:-1]:
        total += shares[name]
        cond = F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(round(total, 9))))
        split = F.when(cond, name) if split is None else split.when(cond, name)
    return ranked.select(key, (split.otherwise(names[-1]) if split is not None else F.lit(names[-1])).alias("split"))


def round_robin(df: DataFrame, key: str, bucket: str, order: Column, n: int, tie: str) -> DataFrame:
    """At most ``n`` rows of each key, taken in turns from its buckets; a bucket's rows come in ``order``, then ``tie``."""
    turn = F.row_number().over(Window.partitionBy(key, bucket).orderBy(order, tie))
    place = F.row_number().over(Window.partitionBy(key).orderBy("turn", bucket, tie))
    return df.withColumn("turn", turn).where(F.col("turn") <= n).withColumn("place", place).where(F.col("place") <= n)


def stratified(df: DataFrame, stratum: str, quotas: dict, key: str, seed: str = "pick-") -> DataFrame:
    """The ``quotas[s]`` rows of each stratum with the smallest shuffled keys."""
    most = F.create_map(*(x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))))
    w = Window.partitionBy(stratum).orderBy(shuffled(F.col(key), seed), key)
    rows = df.where(F.col(stratum).isin(*quotas)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(quotas.values()))
    return rows.where(F.col("_r") <= F.try_element_at(most, F.col(stratum))).drop("_r")


def shared_between(splits: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that occur in more than one split; empty if the splits are disjoint."""
    return splits.groupBy(key).agg(F.min(split).alias("_a"), F.max(split).alias("_b")).where("_a != _b").select(key)


def ranked(df: DataFrame, key: str, seed: str) -> DataFrame:
    """``df`` with ``_rank``, from 1 on, of its rows in shuffled order, and ``_total``. ``key`` is unique.

    A rank is the count of smaller hash prefixes plus the rank within its prefix, so nothing is sorted in one task.
    """
    rows = df.withColumn("_h", shuffled(F.col(key), seed)).withColumn("_p", F.substring("_h", 1, 4))
    counts = rows.groupBy("_p").agg(F.count("*").alias("_c"))
    base = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_base"), F.sum("_c").over(Window.partitionBy()).alias("_total"))  # at most 65,536 rows
    own = F.row_number().over(Window.partitionBy("_p").orderBy("_h", key))
    return rows.join(F.broadcast(base), "_p").withColumn("_rank", own + F.col("_base")).drop("_h", "_p", "_base")


def shards(df: DataFrame, key: str, world: int, seed: str) -> DataFrame:
    """``df`` with ``shard``: shuffled rows dealt to ``world`` shards in turn, without padding."""
    return ranked(df, key, seed).withColumn("shard", ((F.col("_rank") - 1) % world).cast("int")).drop("_rank", "_total")


def examples(df: DataFrame, bucket: str, key: str, k: int, seed: str) -> DataFrame:
    """``bucket, n, ids``: the rows of each bucket and ``k`` of them in shuffled order."""
    n = df.groupBy(bucket).agg(F.count("*").alias("n"))
    w = Window.partitionBy(bucket).orderBy("_h", key)
    few = df.select(bucket, key, shuffled(F.col(key), seed).alias("_h")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    ids = few.groupBy(bucket).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", key))), lambda x: x[key]).alias("ids"))
    return n.join(ids, bucket)
