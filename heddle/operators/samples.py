"""Samples, trajectories and messages: merging, nesting, flattening and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trajectories(samples: DataFrame, keys: list[str], at: str, item: str, kind: str, priority: dict[str, int]) -> DataFrame:
    """One row per trajectory: ordered samples, distinct items in order of first use, the foremost kind at each position."""
    rank = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in priority.items() for x in (F.lit(k), F.lit(v)))), F.col(kind)), F.lit(len(priority)))
    per = samples.withColumn("_p", rank).groupBy(*keys, at).agg(F.min(F.struct("_p", kind)).alias("m"), F.array_sort(F.collect_list(F.struct(at, "_p", "sample_id", item, kind))).alias("s"))
    return per.groupBy(*keys).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at), F.col("s")))), lambda x: x["s"])).alias("samples"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(at), F.col(f"m.{kind}").alias("kind")))), lambda x: F.concat_ws(":", x[at].cast("string"), x["kind"])).alias("kinds"),
    )


def flattened(records: DataFrame, keys: list[str]) -> DataFrame:
    """Trajectory rows back to sample rows."""
    return records.select(*keys, F.posexplode("samples").alias("place", "s")).select(*keys, "place", "s.*").drop("_p")


def merged_recalls(samples: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """A recall query and its response or silence at one place become one ``recall`` row; a lone response a ``response``."""
    g = samples.groupBy(*keys).agg(F.count_if(F.col(kind) == "recall_query").alias("nq"), F.count_if(F.col(kind) == "recall_response").alias("nr"), F.count_if(F.col(kind) == "recall_silent").alias("ns"), F.count("*").alias("n"))
    both = (F.col("nq") > 0) & (F.col("nr") + F.col("ns") > 0)
    return g.where("nq + nr + ns > 0").select(*keys, F.when(both, "recall").when(F.col("nr") > 0, "response").otherwise("lone").alias("merged"), (both & (F.col("nr") == 0)).alias("was_silent"), "n")


def chat(samples: DataFrame, prompt: Column, tool: Column, answer: Column) -> DataFrame:
    """Sample rows as message arrays: system, user, tool if any, assistant."""
    m = lambda role, c: F.when(c.isNotNull(), F.struct(F.lit(role).alias("role"), c.alias("content")))
    return samples.withColumn("messages", F.array_compact(F.array(m("system", F.lit("Answer from the visible chunks only.")), m("user", prompt), m("tool", tool), m("assistant", answer))))


def shapes(rows: DataFrame, place: list[str]) -> DataFrame:
    """``place, shape, call, tool, final, messages``: sample rows as chats of three shapes.

    A recall query and the recall response or silence at one place are one ``recall`` chat (system, user, call, tool, answer);
    a compression is a ``compress`` chat and any other row a ``single`` one (system, user, answer). Missing turns are left out.
    """
    system = F.lit("Answer from the visible chunks only.")
    turn = lambda role, c: F.when(c.isNotNull(), F.struct(F.lit(role).alias("role"), c.alias("content")))
    kind, parts = F.col("kind"), F.col("kind").isin("recall_query", "recall_response", "recall_silent")
    last = F.col("kind").isin("recall_response", "recall_silent")
    g = rows.where(parts).groupBy(*place).agg(F.max("q").alias("q"), F.max("recall_result").alias("tool"), F.max(F.when(kind == "recall_query", F.col("output"))).alias("call"), F.max(F.when(last, F.col("output"))).alias("final"))
    merged = g.where("call is not null and final is not null")
    recall = merged.select(*place, F.lit("recall").alias("shape"), "call", "tool", "final", F.array_compact(F.array(turn("system", system), turn("user", F.col("q")), turn("assistant", F.col("call")), turn("tool", F.col("tool")), turn("assistant", F.col("final")))).alias("messages"))
    rest = rows.where(parts).join(merged.select(*place), place, "left_anti").unionByName(rows.where(~F.coalesce(parts, F.lit(False))))
    none = F.lit(None).cast("string")
    single = rest.select(*place, F.when(kind == "compress", "compress").otherwise("single").alias("shape"), none.alias("call"), none.alias("tool"), F.col("output").alias("final"), F.array_compact(F.array(turn("system", system), turn("user", F.col("q")), turn("assistant", F.col("output")))).alias("messages"))
    return recall.unionByName(single)


def first_trajectory(rows: DataFrame, key: str, trajectory: str) -> DataFrame:
    """The rows of each key's first trajectory, and those of none. The first ids are one row a key."""
    none = F.coalesce(F.col(trajectory), F.lit("")) == ""
    first = rows.where(~none).groupBy(key).agg(F.min(trajectory).alias("_t"))
    return rows.join(first, key, "left").where(none | (F.col(trajectory) == F.col("_t"))).drop("_t")


def probes(df: DataFrame, keys: list[str], options: str) -> DataFrame:
    """One row per option, lettered."""
    return df.select(*keys, F.posexplode(options).alias("i", "option")).withColumn("label", F.concat(F.char(F.lit(65) + F.col("i")), F.lit(". "), F.col("option")))


def verified(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """All rows with the names of the checks they fail; a check that is null counts as failed."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items())))
    return df.withColumn("reasons", failed).withColumn("passed", F.size("reasons") == 0)


def fail_reasons(verified_rows: DataFrame) -> DataFrame:
    return verified_rows.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
