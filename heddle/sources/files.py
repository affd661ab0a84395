"""Readers and writers for the file layouts of datasets, logs and policies."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A file or folder of Parquet, JSON lines (also gzipped) or JSON, in this order of preference."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    names = [path] if fs.getFileStatus(at).isFile() else [s.getPath().getName() for s in fs.listStatus(at)]
    reader = spark.read.option("recursiveFileLookup", True)
    reader = reader.schema(schema) if schema else reader
    for ends, read in (((".parquet",), "parquet"), ((".jsonl", ".jsonl.gz"), "json"), ((".json",), "json")):
        if any(n.endswith(ends) for n in names):
            whole = reader.option("multiLine", ends == (".json",)) if read == "json" else reader
            return getattr(whole.option("pathGlobFilter", "*" if names == [path] else "*{" + ",".join(ends) + "}"), read)(path)
    raise ValueError(f"no data files in {path}")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All frames by column name, with nulls for missing columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_catalog(spark: SparkSession, path: str, casts: dict[str, str]) -> DataFrame:
    """A CSV with header; columns in ``casts`` become null where they can't be cast."""
    df = spark.read.option("header", True).csv(path)
    return df.withColumns({k: F.col(k).try_cast(v) for k, v in casts.items()})


def read_policy(path: str | None, default: dict) -> dict:
    """A JSON policy over the defaults."""
    if path is None:
        return dict(default)
    with open(path) as f:
        return default | json.load(f)


def sampled(df: DataFrame, key: str, spec: str, seed: str = "rate-") -> DataFrame:
    """``name%NN`` keeps floor(n * NN / 100) rows of smallest shuffled key; without a suffix all.

    Ranks come from counts of hash prefixes, so the sample is drawn in all tasks alike. ``key`` is unique.
    """
    from heddle.operators.sampling import ranked

    if "%" not in spec:
        return df
    return ranked(df, key, seed).where(F.col("_rank") <= F.floor(F.col("_total") * int(spec.rpartition("%")[2]) / 100)).drop("_rank", "_total")


def skip_reason(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with ``skip``: the first of ``rules`` (``{reason: condition to skip}``) that holds, else null. Null conditions don't hold."""
    return df.withColumn("skip", F.coalesce(*(F.when(c, k) for k, c in rules.items()), F.lit(None)))


def skip_counts(df: DataFrame) -> DataFrame:
    """How many rows ``skip_reason`` leaves out for each reason, and how many it keeps."""
    return df.groupBy(F.coalesce("skip", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def cached(keys: DataFrame, path: str, on: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The values of ``keys``, from the keyed Parquet table at ``path``; only missing ones are computed, and appended to it.

    ``compute`` gives ``on`` and the values for the keys it gets, once each. ``on`` may hold a hash of the content.
    """
    spark = keys.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    wanted = keys.select(*on).distinct()
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        missing = wanted.join(spark.read.parquet(path).select(*on), on, "left_anti")
    else:
        missing = wanted
    compute(missing).write.mode("append").parquet(path)
    return wanted.join(spark.read.parquet(path).dropDuplicates(on), on, "left")


class Stages:
    """Versions of a pipeline's stages beside their tables: a stage is current while its mark has the expected version.

    ``names`` are in order of dependence; ``invalidate`` deletes a stage and all after it.
    """

    def __init__(self, spark: SparkSession, root: str, names: list[str]) -> None:
        self.root, self.names = root.rstrip("/"), names
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def mark(self, name: str, version: str) -> None:
        out = self._fs.create(self._path(f"{self.path(name)}/_version"), True)
        out.write(bytearray(version.encode()))
        out.close()

    def current(self, name: str, version: str) -> bool:
        at = self._path(f"{self.path(name)}/_version")
        if not self._fs.exists(at):
            return False
        opened = self._fs.open(at)
        try:
            return bytes(opened.readAllBytes()).decode() == version
        finally:
            opened.close()

    def invalidate(self, name: str) -> list[str]:
        gone = self.names[self.names.index(name) :]
        for n in gone:
            self._fs.delete(self._path(self.path(n)), True)
        return gone


def write_splits(df: DataFrame, path: str, split: str = "split", form: str = "json") -> None:
    """One folder per split."""
    df.write.mode("overwrite").partitionBy(split).format(form).save(path)


def write_preview(df: DataFrame, path: str, n: int = 100) -> None:
    """The table as Parquet with the first rows as CSV beside it."""
    df.write.mode("overwrite").parquet(f"{path}/table")
    df.limit(n).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/preview")


def replace_keys(df: DataFrame, path: str, key: str) -> None:
    """Overwrites the partitions of the keys in ``df`` only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def log_metrics(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Numbers found in the text lines of logs, one column per pattern."""
    return lines.select(*(F.regexp_extract("value", p, 1).try_cast("double").alias(k) for k, p in patterns.items()))


def with_responses(requests: DataFrame, responses: DataFrame, key: str, attempt: str, ok: str) -> DataFrame:
    """Requests with their first successful response; model calls are tables here."""
    first = responses.where(F.col(ok)).groupBy(key).agg(F.min_by(F.struct(*[c for c in responses.columns if c != key]), attempt).alias("response"))
    return requests.join(first, key, "left")
