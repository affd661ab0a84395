"""Retrieval over archives: keyword overlap, BM25, time filters, blends and ranking metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions.text import keywords


def overlap_scores(queries: DataFrame, archive: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, q, doc, score``: distinct keywords a query shares with each entry of its archive not after it.

    Both sides are exploded to keywords and meet in an equi-join on archive and keyword, then are counted.
    """
    q = queries.select(*keys, "q", F.col("at").alias("_qa"), F.explode(keywords(F.col("text"))).alias("word"))
    d = archive.select(*keys, "doc", F.col("at").alias("_da"), F.explode(keywords(F.col("text"))).alias("word"))
    return q.join(d, [*keys, "word"]).where(F.col("_da") <= F.col("_qa")).groupBy(*keys, "q", "doc", "_da").agg(F.count("*").alias("score")).withColumnRenamed("_da", "at")


def bm25_scores(queries: DataFrame, archive: DataFrame, keys: list[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Okapi BM25 over the entries of a query's archive that are not after it, idf = ln(1 + (N - df + 0.5) / (df + 0.5)).

    N and the mean length as of a query are running sums along the archive, and a word's df is the number of its hits.
    """
    d = archive.select(*keys, "doc", F.col("at").alias("_da"), F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z0-9]+)"), 1)).alias("word"))
    tf = d.groupBy(*keys, "doc", "_da", "word").agg(F.count("*").alias("tf"))
    size = tf.groupBy(*keys, "doc", "_da").agg(F.sum("tf").alias("len"))
    line = size.select(*keys, F.col("_da").alias("_p"), "len", F.lit(None).cast(queries.schema["q"].dataType).alias("q"), F.lit(0).alias("_k")).unionByName(queries.select(*keys, F.col("at").alias("_p"), F.lit(None).cast("long").alias("len"), "q", F.lit(1).alias("_k")))
    so_far = Window.partitionBy(*keys).orderBy("_p", "_k").rowsBetween(Window.unboundedPreceding, 0)
    whole = line.select(*keys, "q", "_k", F.count("len").over(so_far).alias("n_docs"), (F.sum("len").over(so_far) / F.count("len").over(so_far)).alias("mean_len")).where("_k = 1 and n_docs > 0").drop("_k")
    q = queries.select(*keys, "q", F.col("at").alias("_qa"), F.explode(keywords(F.col("text"))).alias("word"))
    hit = q.join(tf, [*keys, "word"]).where("_da <= _qa").withColumn("df", F.count("*").over(Window.partitionBy(*keys, "q", "word")))
    hit = hit.join(size.drop("_da"), [*keys, "doc"]).join(whole, [*keys, "q"])
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean_len")))
    return hit.groupBy(*keys, "q", "doc").agg(F.sum(part).alias("score"))


def dense_top_k(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, *, block: int = 10_000) -> DataFrame:
    """``q, doc, cosine, rank``: the ``k`` most similar other rows of each query, exactly, by matrix products.

    Queries are taken ``block`` at a time; each block is one scan of ``rows`` whose tasks keep their own ``k`` best of every
    query, so no pairs are written. Null, empty and zero vectors are similar to nothing (0); ties go to the lesser ``key``.
    """
    kind = rows.schema[key].dataType.simpleString()

    def unit(v: pd.Series) -> np.ndarray:
        x = np.array(v.tolist(), dtype=np.float64)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.where(n < 1e-8, 0.0, x / np.maximum(n, 1e-8))

    def scan(part: pd.DataFrame):
        ids, vectors = part[key].to_numpy(), unit(part[vector])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                if not len(p):
                    continue
                docs, found = p[key].to_numpy(), np.round(vectors @ unit(p[vector]).T, 6)
                found[ids[:, None] == docs[None, :]] = -2.0
                order = np.lexsort((np.broadcast_to(docs, found.shape), -found), axis=1)[:, :k]
                q = np.repeat(ids, order.shape[1])
                got = np.take_along_axis(found, order, axis=1).ravel()
                out = pd.DataFrame({"q": q, "doc": docs[order].ravel(), "cosine": got})
                yield out[out["cosine"] > -2.0]

        return rows.select(key, vector).where(F.size(vector) > 0).mapInPandas(run, f"q {kind}, doc {kind}, cosine double")

    held, out = [], None
    for r in queries.select(key, vector).where(F.size(vector) > 0).toLocalIterator():
        held.append((r[0], r[1]))
        if len(held) == block:
            got = scan(pd.DataFrame(held, columns=[key, vector]))
            held, out = [], got if out is None else out.unionByName(got)
    if held or out is None:
        got = scan(pd.DataFrame(held, columns=[key, vector])) if held else queries.sparkSession.createDataFrame([], f"q {kind}, doc {kind}, cosine double")
        out = got if out is None else out.unionByName(got)
    w = Window.partitionBy("q").orderBy(F.desc("cosine"), "doc")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def in_window(scores: DataFrame, at: Column, start: Column, end: Column) -> DataFrame:
    """The scored entries whose unit ``[at, at + 1)`` overlaps ``[start, end)``."""
    return scores.where((at + 1 > start) & (at < end))


def blended(scores: DataFrame, q: list[str], first: str, second: str, alpha: float) -> DataFrame:
    """alpha times min-max scaled ``first`` (flat: 0) plus (1 - alpha) times (``second`` + 1) / 2."""
    w = Window.partitionBy(*q)
    lo, hi = F.min(first).over(w), F.max(first).over(w)
    scaled = F.coalesce(F.try_divide(F.col(first) - lo, hi - lo), F.lit(0.0))
    return scores.withColumn("score", alpha * scaled + (1 - alpha) * (F.col(second) + 1) / 2)


def top_k(scores: DataFrame, q: list[str], k: int, tie: str) -> DataFrame:
    """The ``k`` best entries of each query; ties go to the lesser ``tie``."""
    w = Window.partitionBy(*q).orderBy(F.col("score").desc(), tie)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def metrics(ranked: DataFrame, gold: DataFrame, q: list[str], doc: str, k: int) -> DataFrame:
    """Hit rate at ``k``, mean reciprocal rank and mean share of union, over the queries that have gold entries."""
    hits = ranked.join(gold.select(*q, doc).distinct().withColumn("_g", F.lit(1)), [*q, doc], "left")
    per = hits.groupBy(*q).agg(F.min(F.when(F.col("_g") == 1, F.col("rank"))).alias("best"), F.count("*").alias("n"), F.count("_g").alias("both"))
    wanted = gold.select(*q, doc).distinct().groupBy(*q).agg(F.count("*").alias("n_gold"))
    rows = wanted.join(per, q, "left").fillna(0, ["n", "both"])
    return rows.agg(F.count("*").alias("n_queries"), F.avg(F.coalesce((F.col("best") <= k).cast("double"), F.lit(0.0))).alias("hit"), F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))).alias("mrr"), F.avg(F.col("both") / (F.col("n") + F.col("n_gold") - F.col("both"))).alias("iou"))
