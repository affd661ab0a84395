"""The registry of named queries and the tables that several of them start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import text
from heddle.session import table as t

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def r6(c) -> Column:
    return F.round(c, 6)


CONV = ["video_id", "trajectory_id", "card_id"]
KIND = "regexp_replace(lower(trim(sample_type)), '[ -]', '_', 'g')"


def tag_sql(name: str, column: str = "output") -> str:
    return f"CASE WHEN regexp_matches({column}, '(?s)<{name}>.*?</{name}>') THEN regexp_extract({column}, '(?s)<{name}>(.*?)</{name}>', 1) END"


def conversation_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows of conversations with chunk ``c``, ``kind``, question ``q``, answer ``a``, ``think`` and ``call``, without copies."""
    kind = F.regexp_replace(F.lower(F.trim("sample_type")), "[ -]", "_")
    df = t(s, d, "fork_samples", "sample_id", *CONV, "chunk_idx", "sample_type", "user_input", "output", "recall_result").where("trajectory_id != '' and card_id != '' and chunk_idx is not null and video_id is not null")
    o = F.col("output")
    return df.select("sample_id", *CONV, F.col("chunk_idx").alias("c"), kind.alias("kind"), F.col("user_input").alias("q"), F.trim(text.tag(o, "answer")).alias("a"), text.tag(o, "think").alias("think"), text.tag(o, "tool_call").alias("call"), "output", "recall_result").distinct()


#: ``conversation_rows`` for DuckDB, as the common table expression ``cv``.
CV = f"""cv AS (SELECT DISTINCT sample_id, video_id, trajectory_id, card_id, chunk_idx AS c, {KIND} AS kind, user_input AS q, trim({tag_sql("answer")}) AS a, {tag_sql("think")} AS think, {tag_sql("tool_call")} AS call,
output, recall_result FROM fork_samples WHERE trajectory_id <> '' AND card_id <> '' AND chunk_idx IS NOT NULL AND video_id IS NOT NULL)"""
