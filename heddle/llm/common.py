"""Columns that several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sample types of fork_samples.
SAMPLE_TYPES = ("silent", "response", "recall_query", "recall_response", "recall_silent", "compress")

BLANK = r"[\s ​　﻿]"


def clean_type(c: Column) -> Column:
    """``c`` in its usual spelling (case, surrounding blanks, separators aside); null where it is none of SAMPLE_TYPES."""
    x = F.regexp_replace(F.regexp_replace(F.lower(c), rf"^{BLANK}+|{BLANK}+$", ""), r"[\s_\-]+", "_")
    return F.when(x.isin(*SAMPLE_TYPES), x)


def not_blank(c: Column) -> Column:
    """True where ``c`` holds a character that shows; false for null."""
    return F.coalesce(F.length(F.regexp_replace(c, rf"{BLANK}+", "")) > 0, F.lit(False))


def random_key(seed: int, *columns: Column) -> Column:
    """A uniform number under 2^60 from MD5, alike in every engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *(c.cast("string") for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def clean_dataset(c: Column) -> Column:
    """A dataset's name in its usual spelling; null for blanks and filler words."""
    x = F.lower(F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", ""))
    return F.when(~x.isin("", "-", "n/a", "na", "none", "null", "unknown", "nan", "?"), x)


def spread_lookup(df: DataFrame, dim: DataFrame, key: str, salt: Column, *, keys: DataFrame | None = None, share: float = 0.001) -> DataFrame:
    """``df`` left-joined to ``dim`` (one row per ``key``), with the rows of hot keys spread over all tasks.

    Hot is a key with more than ``share`` of the rows, so there are under 1 / share of them: their rows of ``dim`` are
    broadcast, and in the shuffle each hot row goes where the hash of ``salt`` sends it. The keys are counted with partial
    aggregation, in ``keys`` if that holds them more cheaply (it may count some rows more often). Rows whose key is null are spread likewise and kept without a match.
    """
    keys = df.select(key) if keys is None else keys
    counts = keys.groupBy(key).agg(F.count("*").alias("_n"))
    n = keys.count()
    hot = counts.where((F.col("_n") > share * n) & F.col(key).isNotNull()).select(key)
    values = [c for c in dim.columns if c != key]
    by_hot = dim.join(F.broadcast(hot), key, "left_semi").select(F.col(key), F.lit(True).alias("_hot"), *(F.col(c).alias(f"_{c}") for c in values))
    rows = df.join(F.broadcast(by_hot), key, "left")
    away = F.concat(F.lit("\0"), F.xxhash64(salt).cast("string"))  # equals no key
    rows = rows.withColumn("_key", F.when(F.col("_hot") | F.col(key).isNull(), away).otherwise(F.col(key)))
    joined = rows.join(dim.withColumnRenamed(key, "_key"), "_key", "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in values}).drop("_key", "_hot", *(f"_{c}" for c in values))
