"""Named queries over whole tables, each beside SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions import rewards, stats, text
from heddle.operators import audit, evaluate, retrieval, samples, sampling, windows
from heddle.plans.registry import oracle_sql, queries, query, r6
from heddle.session import table as t
from heddle.streaming import memory

def _timeline(s: SparkSession, d: str) -> DataFrame:
    """events with ``chunk``, the hour since the epoch."""
    e = t(s, d, "events", "event_id", "ts", "user_id", "event_type", "value")
    return e.withColumn("chunk", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600))


TIMELINE = "tl AS (SELECT event_id, ts, user_id, event_type, value, (epoch_us(ts) // 3600000000) AS chunk FROM events)"


def _turns(s: SparkSession, d: str) -> DataFrame:
    """messages without copies."""
    return t(s, d, "messages", "sample_id", "msg_idx", "role", "content").distinct()


# Registry and duplicates


@query("""SELECT CASE WHEN grouping(ds) = 1 THEN 'TOTAL' ELSE ds END AS dataset, count(*)::BIGINT AS n_rows, count(DISTINCT video_id)::BIGINT AS n_items,
round(100.0::DOUBLE * count(*) FILTER (WHERE NOT coalesce(duration_sec > 0, false)) / count(*), 6) AS missing_pct, round(avg(CASE WHEN duration_sec > 0 THEN duration_sec END), 4) AS mean_value
FROM (SELECT *, coalesce(lower(trim(dataset)), '(none)') AS ds FROM video_registry) GROUP BY ROLLUP (ds)""")
def registry_overview(s, d):
    df = t(s, d, "video_registry", "dataset", "video_id", "duration_sec").withColumn("dataset", F.lower(F.trim("dataset")))
    out = audit.overview(df, "dataset", "video_id", "duration_sec")
    return out.withColumns({"missing_pct": r6("missing_pct"), "mean_value": F.round("mean_value", 4)})


@query("""WITH s AS (SELECT video_id FROM documents WHERE video_id IS NOT NULL GROUP BY 1 HAVING min(source) <> max(source))
SELECT coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, count(*)::BIGINT AS n_rows, count(s.video_id)::BIGINT AS n_shared
FROM documents LEFT JOIN s USING (video_id) GROUP BY 1, 2""")
def source_distribution_overlap(s, d):
    df = t(s, d, "documents", "source", "lang", "video_id")
    shared = audit.in_several(df, "video_id", "source").withColumn("_s", F.lit(1))
    keys = [F.coalesce(k, F.lit("(none)")).alias(k) for k in ("source", "lang")]
    return df.join(shared, "video_id", "left").groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count("_s").alias("n_shared"))


@query("""SELECT video_id, count(*)::BIGINT AS n_rows, round(avg(n_chars), 4) AS mean_chars, round(stddev_samp(n_chars), 4) AS std_chars,
array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs FROM documents WHERE video_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 2""")
def origin_length_stats(s, d):
    df = t(s, d, "documents", "video_id", "n_chars", "lang").where("video_id is not null")
    return df.groupBy("video_id").agg(F.count("*").alias("n_rows"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.round(F.stddev_samp("n_chars"), 4).alias("std_chars"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs")).where("n_rows >= 2")


@query("""SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*)::BIGINT AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS share,
arg_min(o_custkey, o_orderkey) AS first_customer FROM orders GROUP BY 1, 2""")
def task_share_first_value(s, d):
    g = t(s, d, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.min_by("o_custkey", "o_orderkey").alias("first_customer"))
    return g.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("status"))))


@query("""SELECT attempt, count(*)::BIGINT AS n, round(100 * avg(parse_success::INT), 6) AS parsed_pct, round(100 * avg((len(visible_entities) > 0)::INT), 6) AS entities_pct,
round(100 * avg((coalesce(trim(spatial), '') <> '')::INT), 6) AS spatial_pct FROM chunk_evidence GROUP BY 1""")
def flag_rates(s, d):
    rate = lambda c, n: r6(100 * F.avg(c.cast("int"))).alias(n)
    df = t(s, d, "chunk_evidence", "attempt", "parse_success", "visible_entities", "spatial")
    return df.groupBy("attempt").agg(F.count("*").alias("n"), rate(F.col("parse_success"), "parsed_pct"), rate(F.size("visible_entities") > 0, "entities_pct"), rate(F.coalesce(F.trim("spatial"), F.lit("")) != "", "spatial_pct"))


@query("""WITH m AS (SELECT count(*) AS n, count(DISTINCT text) + max((text IS NULL)::INT) AS u, count(video_id) AS v, count(DISTINCT video_id) AS dv FROM documents)
SELECT metric, value::BIGINT AS value, round(100.0::DOUBLE * value / n, 6) AS pct FROM (
SELECT 'exact_copies' AS metric, n - u AS value, n FROM m UNION ALL SELECT 'with_origin', v, n FROM m UNION ALL SELECT 'origin_repeats', v - dv, n FROM m)""")
def dedup_risk_metrics(s, d):
    m = t(s, d, "documents", "text", "video_id").agg(F.count("*").alias("n"), (F.count_distinct(F.sha2("text", 256)) + F.max(F.col("text").isNull().cast("int"))).alias("u"), F.count("video_id").alias("v"), F.count_distinct("video_id").alias("dv"))
    row = lambda k, v: F.struct(F.lit(k).alias("metric"), v.alias("value"), r6(100.0 * v / F.col("n")).alias("pct"))
    return m.select(F.inline(F.array(row("exact_copies", F.col("n") - F.col("u")), row("with_origin", F.col("v")), row("origin_repeats", F.col("v") - F.col("dv")))))


@query("""WITH k AS (SELECT doc_id, md5(coalesce('k' || text, 'r' || doc_id::VARCHAR)) AS k FROM documents)
SELECT doc_id, 'grp_' || lpad((dense_rank() OVER (ORDER BY k) - 1)::VARCHAR, 6, '0') AS group_id, count(*) OVER (PARTITION BY k)::BIGINT AS group_size FROM k""")
def dedup_groups(s, d):
    return audit.group_ids(t(s, d, "documents", "doc_id", "text"), F.col("text"), F.col("doc_id")).select("doc_id", "group_id", "group_size")


@query("""SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING min(source) <> max(source))""")
def cross_dataset_overlap(s, d):
    df = t(s, d, "documents", "doc_id", "text", "source").withColumn("h", F.sha2("text", 256))
    return df.join(audit.in_several(df, "h", "source"), "h", "left_semi").select("doc_id")


def _tri(c: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({c}) - 1, 1)::BIGINT), lambda i: substr({c}, i, 3)))"


@query(f"""WITH c AS (SELECT c_custkey, c_acctbal, {_tri("regexp_replace(lower(c_name), '[_-]', '', 'g')")} AS g FROM customer),
s AS (SELECT s_suppkey, s_acctbal, {_tri("regexp_replace(lower(s_name), '[_-]', '', 'g')")} AS g FROM supplier),
p AS (SELECT c_custkey AS left_id, s_suppkey AS right_id, len(list_intersect(c.g, s.g))::DOUBLE / len(list_distinct(list_concat(c.g, s.g))) AS score FROM c JOIN s ON abs(c_acctbal - s_acctbal) < 1.0)
SELECT left_id, right_id, round(score, 6) AS score FROM p WHERE score >= 0.05 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) = 1""")
def metadata_band_match(s, d):
    a = t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("v"))
    b = t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("v"))
    return audit.band_match(a, b, "v", 1.0, 0.05).withColumn("score", r6("score"))


@query("""WITH p AS (SELECT q.vec_id, e.vec_id AS partner, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 6) AS sim
FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0)
SELECT vec_id, partner, sim FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, partner) = 1""")
def visual_nearest(s, d):
    e = t(s, d, "embeddings")
    return audit.nearest_of(e.where("vec_id % 50 = 0"), e, "label", "vec_id", "embedding")


@query("""WITH p AS (SELECT q.vec_id, e.vec_id AS partner, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 6) AS sim
FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id), b AS (SELECT * FROM p WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, partner) = 1)
SELECT vec_id, partner, coalesce(sim, 0)::DOUBLE AS sim, coalesce(sim > 0.3, false) AS near_dup FROM embeddings LEFT JOIN b USING (vec_id)""")
def visual_near_dup(s, d):
    return audit.near_marks(t(s, d, "embeddings", "vec_id", "label", "embedding"), "label", "vec_id", "embedding", 0.3)


@query("""SELECT doc_id, CASE WHEN n_chars >= 500 AND lower(trim(lang)) = 'en' OR doc_kind IN ('cards', 'notes') AND n_chars >= 100 THEN 'A' WHEN n_chars >= 60 THEN 'B' ELSE 'C' END AS level FROM documents""")
def usability_levels(s, d):
    rules = {"A": [{"n_chars__min": 500, "lang__lower": "en"}, {"doc_kind__in": ["cards", "notes"], "n_chars__min": 100}], "B": [{"n_chars__min": 60}]}
    return audit.levels(t(s, d, "documents", "doc_id", "n_chars", "lang", "doc_kind"), rules, "C").select("doc_id", "level")


@query("""SELECT doc_id, video_id FROM documents WHERE video_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY n_chars DESC NULLS LAST, doc_id) <= 12""")
def richest_per_origin(s, d):
    df = t(s, d, "documents", "doc_id", "video_id", "n_chars").where("video_id is not null")
    return audit.keep_first(df, ["video_id"], [F.col("n_chars").desc_nulls_last(), "doc_id"], 12).select("doc_id", "video_id")


@query("""SELECT sample_id, video_id, sample_type, logged_at FROM fork_samples QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY logged_at DESC, output DESC NULLS LAST) = 1""")
def keep_first_dedupe(s, d):
    df = t(s, d, "fork_samples", "sample_id", "video_id", "sample_type", "logged_at", "output")
    return audit.keep_first(df, ["sample_id"], [F.col("logged_at").desc(), F.col("output").desc_nulls_last()]).drop("output")


@query("""SELECT video_id, CASE WHEN p LIKE '%/ytb\\_%' ESCAPE '\\' THEN 'channel' WHEN regexp_matches(p, '/v_[^/]+$') THEN 'news' WHEN regexp_matches(p, '_clip[0-9]+\\.[a-z0-9]+$') THEN 'clip'
WHEN regexp_matches(p, '_[0-9]+_[0-9]+\\.[a-z0-9]+$') THEN 'segment' WHEN p IS NOT NULL THEN 'file' ELSE 'none' END AS kind, regexp_extract(p, '([^/]+)\\.[a-z0-9]+$', 1) AS stem
FROM (SELECT video_id, lower(replace(video_path, '\\', '/')) AS p FROM video_registry)""")
def path_origin_parse(s, d):
    p = F.lower(F.regexp_replace("video_path", r"\\", "/"))
    return t(s, d, "video_registry", "video_id", "video_path").select("video_id", text.source_ladder(F.col("video_path")).alias("kind"), F.regexp_extract(p, r"([^/]+)\.[a-z0-9]+$", 1).alias("stem"))


# Samples and splits

_SHARES = {"train": 0.7, "val": 0.15, "test": 0.15}


@query("""WITH k AS (SELECT DISTINCT video_id FROM documents WHERE video_id IS NOT NULL), r AS (SELECT video_id, row_number() OVER (ORDER BY md5('split-' || video_id), video_id) AS r, count(*) OVER () AS n FROM k)
SELECT video_id, CASE WHEN r <= greatest(1, floor(n * 0.7::DOUBLE)) THEN 'train' WHEN r <= greatest(1, floor(n * 0.85::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM r""")
def origin_split(s, d):
    return sampling.split_keys(t(s, d, "documents", "video_id"), "video_id", _SHARES)


@query("""WITH k AS (SELECT DISTINCT doc_id, video_id FROM documents WHERE video_id IS NOT NULL), r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('rows-' || doc_id::VARCHAR), doc_id) AS r, count(*) OVER () AS n FROM k),
s AS (SELECT doc_id, CASE WHEN r <= greatest(1, floor(n * 0.8::DOUBLE)) THEN 'train' ELSE 'val' END AS split FROM r) SELECT video_id FROM s JOIN documents USING (doc_id) GROUP BY 1 HAVING min(split) <> max(split)""")
def split_disjointness(s, d):
    """The origins that a split of single documents tears apart: what a split by origin must not have."""
    docs = t(s, d, "documents", "doc_id", "video_id").where("video_id is not null")
    by_row = sampling.split_keys(docs, "doc_id", {"train": 0.8, "val": 0.2}, "rows-")
    return sampling.shared_between(docs.join(by_row, "doc_id"), "video_id", "split").select("video_id")


@query("""SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view', 'error') QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('pick-' || event_id::VARCHAR), event_id) <= CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 100 ELSE 50 END""")
def stratified_quota(s, d):
    return sampling.stratified(t(s, d, "events", "event_id", "event_type"), "event_type", {"click": 200, "view": 100, "error": 50}, "event_id")


@query("""WITH a AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC NULLS LAST, event_id) AS turn FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY turn, event_type, event_id) AS place FROM a WHERE turn <= 15) SELECT event_id, user_id, turn::INT AS turn, place::INT AS place FROM b WHERE place <= 15""")
def round_robin_cap(s, d):
    df = t(s, d, "events", "event_id", "user_id", "event_type", "value")
    return sampling.round_robin(df, "user_id", "event_type", F.col("value").desc_nulls_last(), 15, "event_id").select("event_id", "user_id", "turn", "place")


# Messages, tags and answers


@query("""SELECT sample_id, count(*)::BIGINT AS n, count(*) FILTER (WHERE lower(trim(role)) IN ('user', 'human'))::BIGINT AS n_user, count(*) FILTER (WHERE lower(trim(role)) = 'tool')::BIGINT AS n_tool,
sum(length(content))::BIGINT AS chars, arg_min(content, msg_idx) FILTER (WHERE lower(trim(role)) IN ('user', 'human')) AS first_question FROM (SELECT DISTINCT sample_id, msg_idx, role, content FROM messages) GROUP BY 1""")
def conversation_features(s, d):
    role = F.lower(F.trim("role"))
    user = role.isin("user", "human")
    first = F.min(F.when(user, F.struct("msg_idx", F.coalesce("content", F.lit("")).alias("c"))))["c"]
    return _turns(s, d).groupBy("sample_id").agg(F.count("*").alias("n"), F.count_if(user).alias("n_user"), F.count_if(role == "tool").alias("n_tool"), F.sum(F.length("content")).alias("chars"), first.alias("first_question"))


@query("""SELECT sample_id, msg_idx, nullif(regexp_extract(content, '(?s)<think>(.*?)</think>', 1), '') AS think, nullif(regexp_extract(content, '(?s)<answer>(.*?)</answer>', 1), '') AS answer,
json_extract_string(nullif(regexp_extract(content, '(?s)<tool_call>(.*?)</tool_call>', 1), ''), '$.name') AS tool FROM (SELECT DISTINCT sample_id, msg_idx, content FROM messages) WHERE content LIKE '%<%'""")
def tag_extract(s, d):
    c = F.col("content")
    none = lambda x: F.nullif(x, F.lit(""))
    df = t(s, d, "messages", "sample_id", "msg_idx", "content").distinct().where(c.contains("<"))
    return df.select("sample_id", "msg_idx", none(text.tag(c, "think")).alias("think"), none(text.tag(c, "answer")).alias("answer"), F.get_json_object(text.tag(c, "tool_call"), "$.name").alias("tool"))


@query("""SELECT event_type, count(*)::BIGINT AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k_sum, max(json_extract(props, '$.k')::BIGINT) AS k_max FROM events GROUP BY 1""")
def json_props_metrics(s, d):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return t(s, d, "events", "event_type", "props").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


@query("""WITH a AS (SELECT sample_id, trim(regexp_extract(output, '(?s)<answer>(.*?)</answer>', 1)) AS x FROM (SELECT DISTINCT sample_id, output FROM fork_samples WHERE output IS NOT NULL))
SELECT yes_no, letter, number, count(*)::BIGINT AS n FROM (SELECT CASE WHEN regexp_matches(x, '(?i)^(yes|true)\\b') THEN 'Yes' WHEN regexp_matches(x, '(?i)^(no|false)\\b') THEN 'No' ELSE '' END AS yes_no,
upper(regexp_extract(x, '^\\(?([A-Da-d])\\)?(?:[.):\\s]|$)', 1)) AS letter, CASE WHEN regexp_matches(x, '^-?[0-9]+(?:[^0-9A-Za-z_]|$)') THEN regexp_extract(x, '^(-?[0-9]+)', 1) ELSE '' END AS number FROM a) GROUP BY ALL""")
def answer_forms(s, d):
    df = t(s, d, "fork_samples", "sample_id", "output").where("output is not null").distinct()
    x = F.trim(F.coalesce(text.tag(F.col("output"), "answer"), F.lit("")))
    forms = {"yes_no": "binary", "letter": "choice", "number": "number"}
    return df.groupBy(*(text.normal_answer(x, f).alias(k) for k, f in forms.items())).agg(F.count("*").alias("n"))


@query("""SELECT item_id, (i - 1)::INT AS i, chr((64 + i)::INT) || '. ' || option_list[i] AS label FROM (SELECT item_id, option_list, unnest(range(1, len(option_list) + 1)) AS i FROM eval_items)""")
def probe_explode(s, d):
    return samples.probes(t(s, d, "eval_items", "item_id", "option_list"), ["item_id"], "option_list").select("item_id", "i", "label")


_KIND = "regexp_replace(lower(trim(sample_type)), '[ -]', '_', 'g')"
_CONV = ["video_id", "trajectory_id", "card_id"]


def _samples(s: SparkSession, d: str) -> DataFrame:
    kind = F.regexp_replace(F.lower(F.trim("sample_type")), "[ -]", "_")
    df = t(s, d, "fork_samples", "sample_id", *_CONV, "chunk_idx", "sample_type").where("trajectory_id != '' and card_id != ''")
    return df.select("sample_id", *_CONV, "chunk_idx", kind.alias("kind")).distinct()


SAMPLES = f"sm AS (SELECT DISTINCT sample_id, video_id, trajectory_id, card_id, chunk_idx, {_KIND} AS kind FROM fork_samples WHERE trajectory_id <> '' AND card_id <> '')"


@query(f"""WITH {SAMPLES}, g AS (SELECT video_id, trajectory_id, card_id, chunk_idx, count(*) FILTER (WHERE kind = 'recall_query') AS nq, count(*) FILTER (WHERE kind = 'recall_response') AS nr,
count(*) FILTER (WHERE kind = 'recall_silent') AS ns, count(*)::BIGINT AS n FROM sm GROUP BY ALL)
SELECT video_id, trajectory_id, card_id, chunk_idx, CASE WHEN nq > 0 AND nr + ns > 0 THEN 'recall' WHEN nr > 0 THEN 'response' ELSE 'lone' END AS merged, (nq > 0 AND nr + ns > 0 AND nr = 0) AS was_silent, n FROM g WHERE nq + nr + ns > 0""")
def recall_pair_merge(s, d):
    return samples.merged_recalls(_samples(s, d), [*_CONV, "chunk_idx"], "kind")


_PRIORITY = {"compress": 0, "recall_query": 1, "recall_response": 2, "response": 3, "recall_silent": 4, "silent": 5}


@query(f"""WITH {SAMPLES}, p AS (SELECT *, CASE kind WHEN 'compress' THEN 0 WHEN 'recall_query' THEN 1 WHEN 'recall_response' THEN 2 WHEN 'response' THEN 3 WHEN 'recall_silent' THEN 4 WHEN 'silent' THEN 5 ELSE 6 END AS pr FROM sm WHERE chunk_idx IS NOT NULL AND kind IS NOT NULL),
c AS (SELECT video_id, trajectory_id, card_id, chunk_idx, min(kind) FILTER (WHERE pr = m) AS kind, count(*) AS n FROM (SELECT *, min(pr) OVER (PARTITION BY video_id, trajectory_id, card_id, chunk_idx) AS m FROM p) GROUP BY ALL)
SELECT video_id, trajectory_id, card_id, sum(n)::BIGINT AS n_samples, string_agg(chunk_idx || ':' || kind, ',' ORDER BY chunk_idx) AS kinds FROM c GROUP BY ALL""")
def trajectory_records(s, d):
    df = _samples(s, d).where("chunk_idx is not null and kind is not null")
    out = samples.trajectories(df.withColumn("item", F.col("card_id")), _CONV, "chunk_idx", "item", "kind", _PRIORITY)
    return out.select(*_CONV, F.size("samples").cast("long").alias("n_samples"), F.array_join("kinds", ",").alias("kinds"))


@query(f"""WITH {SAMPLES} SELECT video_id, trajectory_id, card_id, count(*)::BIGINT AS n, count(DISTINCT chunk_idx)::BIGINT AS n_chunks, max(chunk_idx) - min(chunk_idx) AS span FROM sm WHERE chunk_idx IS NOT NULL AND kind IS NOT NULL GROUP BY ALL""")
def flatten_samples(s, d):
    df = _samples(s, d).where("chunk_idx is not null and kind is not null").withColumn("item", F.col("card_id"))
    flat = samples.flattened(samples.trajectories(df, _CONV, "chunk_idx", "item", "kind", _PRIORITY), _CONV)
    return flat.groupBy(*_CONV).agg(F.count("*").alias("n"), F.count_distinct("chunk_idx").alias("n_chunks"), (F.max("chunk_idx") - F.min("chunk_idx")).alias("span"))


@query("""SELECT DISTINCT sample_id, CASE WHEN user_input IS NOT NULL THEN 'system,user' ELSE 'system' END || CASE WHEN recall_result IS NOT NULL THEN ',tool' ELSE '' END || CASE WHEN output IS NOT NULL THEN ',assistant' ELSE '' END AS roles FROM fork_samples""")
def chat_messages(s, d):
    df = samples.chat(t(s, d, "fork_samples", "sample_id", "user_input", "output", "recall_result"), F.col("user_input"), F.col("recall_result"), F.col("output"))
    return df.select("sample_id", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles")).distinct()


def _checked(s: SparkSession, d: str) -> DataFrame:
    df = t(s, d, "fork_samples", "sample_id", "chunk_idx", "sample_type", "user_input", "output").distinct()
    kind = F.regexp_replace(F.lower(F.trim("sample_type")), "[ -]", "_")
    answer = text.tag(F.col("output"), "answer")
    think = F.coalesce(text.estimated_tokens(text.tag(F.col("output"), "think")), F.lit(0))
    checks = {
        "answer_present": ~kind.isin("response", "recall_response") | (F.trim(answer) != ""),
        "chunk_known": F.col("chunk_idx") >= 0,
        "format": F.col("output").rlike(r"(?s)</answer>\s*$|</tool_call>\s*$"),
        "no_leak": ~F.coalesce(F.length(answer) >= 3, F.lit(False)) | F.col("user_input").isNull() | ~F.contains(F.lower("user_input"), F.lower(answer)),
        "think_length": think <= 30,
    }
    return samples.verified(df, checks)


CHECKED = f"""ck AS (SELECT sample_id, {_KIND} AS kind, chunk_idx, user_input, output, CASE WHEN regexp_matches(output, '(?s)<answer>.*?</answer>') THEN regexp_extract(output, '(?s)<answer>(.*?)</answer>', 1) END AS answer,
CASE WHEN regexp_matches(output, '(?s)<think>.*?</think>') THEN regexp_extract(output, '(?s)<think>(.*?)</think>', 1) END AS think FROM (SELECT DISTINCT sample_id, chunk_idx, sample_type, user_input, output FROM fork_samples)),
cf AS (SELECT sample_id, unnest(['answer_present', 'chunk_known', 'format', 'no_leak', 'think_length']) AS reason, unnest([
coalesce(kind NOT IN ('response', 'recall_response') OR trim(answer) <> '', false), coalesce(chunk_idx >= 0, false), coalesce(regexp_matches(output, '(?s)</answer>\\s*$|</tool_call>\\s*$'), false),
coalesce(NOT coalesce(length(answer) >= 3, false) OR user_input IS NULL OR NOT contains(lower(user_input), lower(answer)), false), coalesce(length(think) // 4, 0) <= 30]) AS ok FROM ck)"""


@query(f"WITH {CHECKED} SELECT reason, count(*)::BIGINT AS n FROM cf WHERE NOT ok GROUP BY 1")
def fail_reason_counts(s, d):
    return samples.fail_reasons(_checked(s, d))


@query(f"""WITH {SAMPLES}, g AS (SELECT video_id, trajectory_id, count(*)::BIGINT AS n, count(*) FILTER (WHERE kind LIKE '%silent') AS n_silent FROM sm GROUP BY ALL) SELECT video_id, trajectory_id, n, (n >= 5 AND n_silent::DOUBLE / n > 0.95) AS too_silent FROM g""")
def group_check(s, d):
    g = _samples(s, d).groupBy("video_id", "trajectory_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind").endswith("silent")).alias("ns"))
    return g.select("video_id", "trajectory_id", "n", ((F.col("n") >= 5) & (F.col("ns") / F.col("n") > 0.95)).alias("too_silent"))


# Timelines


@query(f"""WITH {TIMELINE}, i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM tl)
SELECT user_id, event_type, min(ts) AS first, max(ts) AS last, count(*)::BIGINT AS length FROM i GROUP BY user_id, event_type, g HAVING count(*) >= 3""")
def action_runs(s, d):
    return windows.runs(_timeline(s, d), ["user_id"], ["ts", "event_id"], "event_type", 3)


@query(f"""WITH {TIMELINE}, l AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM tl) SELECT event_type, before, count(*)::BIGINT AS n FROM l WHERE before <> event_type GROUP BY 1, 2""")
def state_change_lag(s, d):
    return windows.changes(_timeline(s, d), ["user_id"], ["ts", "event_id"], "event_type").groupBy("event_type", "before").agg(F.count("*").alias("n"))


@query(f"""WITH {TIMELINE}, x AS (SELECT DISTINCT user_id, event_type, chunk FROM tl), l AS (SELECT *, chunk - lag(chunk) OVER (PARTITION BY user_id, event_type ORDER BY chunk) AS gap FROM x) SELECT user_id, event_type, chunk, gap FROM l WHERE gap >= 5""")
def reappearance_gap(s, d):
    return windows.reappearances(_timeline(s, d), ["user_id", "event_type"], "chunk", 5)


@query("""WITH e AS (SELECT DISTINCT video_id, chunk_idx, unnest(visible_entities).id AS id FROM chunk_evidence), f AS (SELECT video_id, id, min(chunk_idx) AS chunk_idx FROM e WHERE id IS NOT NULL GROUP BY 1, 2) SELECT video_id, chunk_idx, count(*)::BIGINT AS n_new FROM f GROUP BY 1, 2""")
def first_appearance(s, d):
    e = t(s, d, "chunk_evidence", "video_id", "chunk_idx", "visible_entities").select("video_id", "chunk_idx", F.explode("visible_entities.id").alias("id"))
    return windows.first_seen(e, ["video_id"], "id", "chunk_idx")


@query(f"""WITH {TIMELINE}, s AS (SELECT *, min(chunk) OVER (PARTITION BY user_id) AS a, max(chunk) OVER (PARTITION BY user_id) AS b FROM tl), x AS (SELECT user_id, event_id, value, least(7, ((chunk - a) * 8) // greatest(1, b - a))::INT AS bin FROM s WHERE value IS NOT NULL)
SELECT user_id, bin, event_id, value FROM x QUALIFY row_number() OVER (PARTITION BY user_id, bin ORDER BY value DESC, event_id) = 1""")
def time_bin_top1(s, d):
    return windows.best_per_bin(_timeline(s, d), ["user_id"], "chunk", "value", "event_id", 8)


@query(f"""WITH {TIMELINE}, r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM tl), k AS (SELECT unnest(range(0, 12)) AS i)
SELECT DISTINCT event_id, user_id FROM r WHERE n <= 12 OR r IN (SELECT (i * (n - 1)) // 11 FROM k)""")
def even_stride_sample(s, d):
    return windows.evenly(_timeline(s, d), ["user_id"], ["ts", "event_id"], 12).select("event_id", "user_id")


@query(f"""WITH {TIMELINE}, r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM tl) SELECT event_id FROM r WHERE r <= greatest(1, floor(n * 0.65::DOUBLE))""")
def early_fraction(s, d):
    return windows.leading(_timeline(s, d), ["user_id"], ["ts", "event_id"], 0.65).select("event_id")


@query(f"""WITH {TIMELINE}, h AS (SELECT user_id, chunk, count(*)::BIGINT AS n, sum(value) AS v FROM tl GROUP BY 1, 2) SELECT user_id, chunk, n, (sum(n) OVER w)::BIGINT AS n16, round(sum(v) OVER w, 4) AS v16 FROM h WINDOW w AS (PARTITION BY user_id ORDER BY chunk RANGE BETWEEN 15 PRECEDING AND CURRENT ROW)""")
def sliding_window_16(s, d):
    h = _timeline(s, d).groupBy("user_id", "chunk").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    out = windows.sliding(h, ["user_id"], "chunk", 15, n16=F.sum("n"), v16=F.sum("v"))
    return out.select("user_id", "chunk", "n", "n16", F.round("v16", 4).alias("v16"))


@query("""WITH m AS (SELECT DISTINCT sample_id, msg_idx, content FROM messages), c AS (SELECT sample_id, row_number() OVER w AS r, sum(length(coalesce(content, '')) // 4) OVER w AS c FROM m WINDOW w AS (PARTITION BY sample_id ORDER BY msg_idx, content NULLS FIRST ROWS UNBOUNDED PRECEDING))
SELECT sample_id, max(r)::BIGINT AS n_rows, min(CASE WHEN c >= 40 AND r BETWEEN 2 AND 6 THEN r END)::BIGINT AS n_cut FROM c GROUP BY 1""")
def cumulative_budget_cut(s, d):
    m = t(s, d, "messages", "sample_id", "msg_idx", "content").distinct().withColumn("cost", text.estimated_tokens(F.col("content")))
    return windows.budget_cut(m, ["sample_id"], ["msg_idx", "content"], "cost", 40, 2, 6)


@query("""WITH e AS (SELECT o_custkey, o_orderdate AS pos, 1 AS d FROM orders UNION ALL SELECT o_custkey, l.ship, -1 FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS ship FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey),
s AS (SELECT o_custkey, pos, sum(d) AS d FROM e WHERE pos IS NOT NULL GROUP BY 1, 2), r AS (SELECT o_custkey, sum(d) OVER (PARTITION BY o_custkey ORDER BY pos ROWS UNBOUNDED PRECEDING) AS n FROM s) SELECT o_custkey, max(n)::BIGINT AS most_open FROM r GROUP BY 1""")
def pending_overlap(s, d):
    ship = t(s, d, "lineitem", "l_orderkey", "l_shipdate").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("ship"))
    rows = t(s, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").join(ship, "o_orderkey", "left")
    return windows.open_intervals(rows, ["o_custkey"], "o_orderdate", "ship").groupBy("o_custkey").agg(F.max("n_open").alias("most_open"))


@query(f"""WITH {TIMELINE} SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS last_purchase, first_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER v AS next_error FROM tl
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""")
def asof_both_ways(s, d):
    o = (["user_id"], ["ts", "event_id"])
    df = windows.last_before(_timeline(s, d), *o, F.col("event_type") == "purchase", "event_id", "last_purchase")
    return windows.next_after(df, *o, F.col("event_type") == "error", "event_id", "next_error").select("event_id", "last_purchase", "next_error")


ANSWERED = f"""{TIMELINE}, a AS (SELECT DISTINCT user_id, chunk AS ask FROM tl WHERE event_type = 'signup'), b AS (SELECT *, lead(ask) OVER (PARTITION BY user_id ORDER BY ask) AS nxt FROM a), x AS (SELECT DISTINCT user_id, chunk FROM tl WHERE event_type = 'purchase'),
wa AS (SELECT b.user_id, b.ask, min(x.chunk) AS answer FROM b LEFT JOIN x ON x.user_id = b.user_id AND x.chunk >= b.ask AND x.chunk <= least(b.ask + 24, coalesce(b.nxt - 1, b.ask + 24)) GROUP BY 1, 2)"""


def _answered(s: SparkSession, d: str) -> DataFrame:
    e = _timeline(s, d)
    return windows.answered_in_window(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"), ["user_id"], "chunk", 24)


@query(f"WITH {ANSWERED} SELECT user_id, ask, answer FROM wa")
def windowed_answers(s, d):
    return _answered(s, d)


@query(f"""WITH {ANSWERED} SELECT user_id, count(*)::BIGINT AS n, round(avg(CASE WHEN answer IS NULL THEN -0.5 WHEN answer < ask THEN -1 WHEN answer <= ask + 6 THEN 1 WHEN answer <= ask + 10 THEN 1 - 0.5::DOUBLE * (answer - ask - 6) / 4 ELSE 0 END), 6) AS reward FROM wa GROUP BY 1""")
def timing_reward(s, d):
    r = rewards.timing(F.col("answer"), F.col("ask"), F.col("ask") + 6, 4)
    return _answered(s, d).groupBy("user_id").agg(F.count("*").alias("n"), r6(F.avg(r)).alias("reward"))


@query(f"""WITH {TIMELINE}, s AS (SELECT user_id, min(chunk) AS a, max(chunk) AS b FROM tl GROUP BY 1), c AS (SELECT s.user_id, unnest(range(a, b + 1)) AS c FROM s), q AS (SELECT DISTINCT user_id, unnest(range(chunk - 6, chunk + 7)) AS c FROM tl WHERE event_type = 'signup')
SELECT c.user_id, round(count(*) FILTER (WHERE q.c IS NULL)::DOUBLE / count(*), 6) AS quiet FROM c LEFT JOIN q ON q.user_id = c.user_id AND q.c = c.c GROUP BY 1""")
def silent_fraction(s, d):
    return windows.quiet_share(_timeline(s, d), ["user_id"], "chunk", F.col("event_type") == "signup", 6).withColumn("quiet", r6("quiet"))


@query(f"""WITH {TIMELINE}, w AS (SELECT user_id, unnest(range(chunk - 1, chunk + 2)) AS chunk, 0 AS p, 'evidence' AS role FROM tl WHERE event_type = 'purchase' UNION ALL SELECT user_id, unnest(range(chunk - 2, chunk + 1)), 1, 'before_ask' FROM tl WHERE event_type = 'signup'
UNION ALL SELECT user_id, unnest(range(chunk, chunk + 3)), 2, 'patrol' FROM tl WHERE event_type = 'error') SELECT user_id, chunk, arg_min(role, p) AS role FROM w GROUP BY 1, 2""")
def role_priority(s, d):
    e = F.col("event_type")
    return windows.roles(_timeline(s, d), ["user_id"], "chunk", {"evidence": (e == "purchase", 1, 1), "before_ask": (e == "signup", 2, 0), "patrol": (e == "error", 0, 2)})


# Normalised values and report figures


@query("""SELECT o_orderkey, round(CASE WHEN ok THEN x - avg(CASE WHEN ok THEN x END) OVER w ELSE 0 END, 4) AS centred, round((x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-4), 6) AS z_pop,
round(CASE WHEN count(x) OVER w = 1 THEN x ELSE (x - avg(x) OVER w) / (stddev_samp(x) OVER w + 1e-6) END, 6) AS z_samp
FROM (SELECT o_orderkey, o_custkey, o_totalprice AS x, o_orderstatus <> 'P' AS ok FROM orders) WINDOW w AS (PARTITION BY o_custkey)""")
def group_advantages(s, d):
    x, g = F.col("o_totalprice"), ["o_custkey"]
    df = t(s, d, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return df.select("o_orderkey", F.round(stats.centred(x, F.col("o_orderstatus") != "P", g), 4).alias("centred"), r6(stats.z_population(x, g)).alias("z_pop"), r6(stats.z_sample(x, g)).alias("z_samp"))


@query("""SELECT o_orderkey, round((o_totalprice - m) / (s + 1e-4), 6) AS z FROM orders, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders)""")
def batch_whitening(s, d):
    return stats.whitened(t(s, d, "orders", "o_orderkey", "o_totalprice"), "o_totalprice", "z").select("o_orderkey", r6("z").alias("z"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n)::BIGINT AS n, max(value) FILTER (WHERE i = least(n - 1, floor(n * 0.5::DOUBLE))) AS p50, max(value) FILTER (WHERE i = least(n - 1, floor(n * 0.9::DOUBLE))) AS p90 FROM r GROUP BY 1""")
def nearest_rank_percentiles(s, d):
    return stats.nearest_rank_by(t(s, d, "events", "event_type", "value"), ["event_type"], "value", {"p50": 0.5, "p90": 0.9})


@query("""WITH k AS (SELECT o_orderpriority AS task, CASE WHEN o_orderpriority < '3' THEN 'high' ELSE 'low' END AS category, (o_orderstatus = 'F')::INT AS ok FROM orders), a AS (SELECT category, task, avg(ok) AS acc, count(*) AS n FROM k GROUP BY 1, 2), c AS (SELECT category, avg(acc) AS acc, sum(n) AS n FROM a GROUP BY 1)
SELECT category, round(acc, 6) AS acc, n::BIGINT AS n FROM c UNION ALL SELECT 'OVERALL', round(avg(acc), 6), sum(n)::BIGINT FROM c""")
def task_macro_accuracy(s, d):
    df = t(s, d, "orders", "o_orderpriority", "o_orderstatus").withColumn("category", F.when(F.col("o_orderpriority") < "3", "high").otherwise("low"))
    return evaluate.macro_accuracy(df, "o_orderpriority", "category", F.col("o_orderstatus") == "F").withColumn("acc", r6("acc"))


@query("""SELECT name, round(value, 6) AS value, coalesce(value >= least, true) AS passed FROM (SELECT 'paid_errors' AS name, count(*) FILTER (WHERE event_type = 'error' AND value > 10)::DOUBLE / nullif(count(*) FILTER (WHERE event_type = 'error'), 0) AS value, 0.3 AS least FROM events
UNION ALL SELECT 'big_purchases', count(*) FILTER (WHERE event_type = 'purchase' AND value > 20)::DOUBLE / nullif(count(*) FILTER (WHERE event_type = 'purchase'), 0), 0.9 FROM events UNION ALL SELECT 'absent', count(*) FILTER (WHERE event_type = 'none')::DOUBLE / nullif(count(*) FILTER (WHERE event_type = 'none'), 0), 0.5 FROM events)""")
def emission_gates(s, d):
    e, v = F.col("event_type"), F.col("value")
    rates = {"paid_errors": (v > 10, e == "error", 0.3), "big_purchases": (v > 20, e == "purchase", 0.9), "absent": (e == "none", e == "none", 0.5)}
    return evaluate.gates(t(s, d, "events", "event_type", "value"), rates).withColumn("value", r6("value"))


@query("""SELECT o_orderpriority AS priority, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS "n_F", count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS "n_O", count(*) FILTER (WHERE o_orderstatus = 'P')::BIGINT AS "n_P" FROM orders GROUP BY 1""")
def confusion_pivot(s, d):
    return evaluate.confusion(t(s, d, "orders", "o_orderpriority", "o_orderstatus").withColumnRenamed("o_orderpriority", "priority"), "priority", "o_orderstatus", ["F", "O", "P"])


@query("""WITH j AS (SELECT o_orderpriority, c_mktsegment, n_name, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT dim, name, count(*)::BIGINT AS n, round(sum(v), 2) AS total FROM (SELECT 'o_orderpriority' AS dim, o_orderpriority AS name, o_totalprice AS v FROM j UNION ALL SELECT 'c_mktsegment', c_mktsegment, o_totalprice FROM j UNION ALL SELECT 'n_name', n_name, o_totalprice FROM j) GROUP BY 1, 2""")
def grouping_sets_profile(s, d):
    c = t(s, d, "customer", "c_custkey", "c_mktsegment", "c_nationkey").join(t(s, d, "nation", "n_nationkey", "n_name"), F.col("n_nationkey") == F.col("c_nationkey"))
    j = t(s, d, "orders", "o_custkey", "o_orderpriority", "o_totalprice").join(c, F.col("c_custkey") == F.col("o_custkey"))
    return evaluate.profile(j, ["o_orderpriority", "c_mktsegment", "n_name"], "o_totalprice").withColumn("total", F.round("total", 2))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) SELECT event_type, round(avg(value) FILTER (WHERE r <= 10), 6) AS last_mean, round(avg(value), 4) AS mean, round(avg(value) FILTER (WHERE r <= 10) - avg(value), 4) AS delta FROM r GROUP BY 1""")
def last_n_mean_delta(s, d):
    out = evaluate.last_n_mean(t(s, d, "events", "event_id", "event_type", "value"), ["event_type"], "event_id", "value", 10)
    return out.select("event_type", r6("last_mean").alias("last_mean"), F.round("mean", 4).alias("mean"), F.round("delta", 4).alias("delta"))


# Retrieval

_ARCHIVE = ["video_id"]


def _archive(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Recall queries of a video, its chunks' thinks as archive, and the rows both come from."""
    f = t(s, d, "fork_samples", "sample_id", "video_id", "chunk_idx", "sample_type", "output", "recall_result").distinct()
    call = text.tag(F.col("output"), "tool_call")
    q = f.where(F.get_json_object(call, "$.name") == "recall").groupBy("video_id", F.col("sample_id").alias("q")).agg(F.max("chunk_idx").alias("at"), F.max(F.get_json_object(call, "$.arguments.query")).alias("text")).where("at is not null and text is not null")
    think = F.trim(text.tag(F.col("output"), "think"))
    a = f.where((think != "") & F.col("chunk_idx").isNotNull()).groupBy("video_id", F.col("chunk_idx").alias("doc")).agg(F.max(think).alias("text")).withColumn("at", F.col("doc"))
    return q, a, f


ARCHIVE = """fs AS (SELECT DISTINCT sample_id, video_id, chunk_idx, output FROM fork_samples),
qs AS (SELECT video_id, sample_id AS q, max(chunk_idx) AS pos, max(json_extract_string(c, '$.arguments.query')) AS text FROM (SELECT *, CASE WHEN regexp_matches(output, '(?s)<tool_call>.*?</tool_call>') THEN regexp_extract(output, '(?s)<tool_call>(.*?)</tool_call>', 1) END AS c FROM fs) WHERE json_valid(c) AND json_extract_string(c, '$.name') = 'recall' GROUP BY 1, 2 HAVING max(chunk_idx) IS NOT NULL),
ar AS (SELECT video_id, chunk_idx AS doc, max(th) AS text FROM (SELECT *, trim(regexp_extract(output, '(?s)<think>(.*?)</think>', 1)) AS th FROM fs) WHERE th <> '' AND chunk_idx IS NOT NULL GROUP BY 1, 2),
qw AS (SELECT video_id, q, pos, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS word FROM qs),
dw AS (SELECT video_id, doc, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS word FROM ar),
sc AS (SELECT video_id, q, doc, count(*)::BIGINT AS score FROM qw JOIN dw USING (video_id, word) WHERE doc <= pos AND word NOT IN ({stop}) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY video_id, q ORDER BY score DESC, doc) AS rank FROM sc)""".replace("{stop}", ", ".join(f"'{w}'" for w in text.STOP_WORDS))


@query(f"WITH {ARCHIVE} SELECT q, doc, score, rank::INT AS rank FROM rk WHERE rank <= 4")
def keyword_overlap_retrieval(s, d):
    q, a, _ = _archive(s, d)
    return retrieval.top_k(retrieval.overlap_scores(q, a, _ARCHIVE), ["video_id", "q"], 4, "doc").select("q", "doc", "score", "rank")


@query(f"WITH {ARCHIVE}, w AS (SELECT *, row_number() OVER (PARTITION BY video_id, q ORDER BY score DESC, doc) AS r2 FROM (SELECT sc.* FROM sc JOIN (SELECT DISTINCT video_id, q, pos FROM qs) USING (video_id, q) WHERE doc + 1 > pos - 40 AND doc < pos - 5)) SELECT q, doc, score, r2::INT AS rank FROM w WHERE r2 <= 4")
def time_filtered_retrieval(s, d):
    q, a, _ = _archive(s, d)
    scores = retrieval.overlap_scores(q, a, _ARCHIVE).join(q.select("video_id", "q", F.col("at").alias("qa")), ["video_id", "q"])
    near = retrieval.in_window(scores, F.col("doc"), F.col("qa") - 40, F.col("qa") - 5)
    return retrieval.top_k(near, ["video_id", "q"], 4, "doc").select("q", "doc", "score", "rank")


GOLD = """tr AS (SELECT DISTINCT video_id, trajectory_id, card_id, chunk_idx, recall_result FROM fork_samples WHERE recall_result IS NOT NULL AND trajectory_id IS NOT NULL AND card_id IS NOT NULL),
gold AS (SELECT DISTINCT qs.video_id, q, unnest(regexp_extract_all(tr.recall_result, '\\[(\\d+)\\]', 1))::INT AS doc FROM qs JOIN fork_samples f ON f.sample_id = qs.q AND f.video_id = qs.video_id JOIN tr ON tr.video_id = f.video_id AND tr.trajectory_id = f.trajectory_id AND tr.card_id = f.card_id AND tr.chunk_idx = f.chunk_idx)"""


@query(f"""WITH {ARCHIVE}, {GOLD}, g AS (SELECT video_id, q, count(*) AS n_gold FROM gold GROUP BY 1, 2), h AS (SELECT video_id, q, min(CASE WHEN gold.doc IS NOT NULL THEN rank END) AS best, count(*) AS n, count(gold.doc) AS n_both FROM (SELECT * FROM rk WHERE rank <= 4) LEFT JOIN gold USING (video_id, q, doc) GROUP BY 1, 2)
SELECT count(*)::BIGINT AS n_queries, round(avg(coalesce((best <= 4)::INT, 0)), 6) AS hit, round(avg(coalesce(1.0::DOUBLE / best, 0)), 6) AS mrr, round(avg(coalesce(n_both, 0)::DOUBLE / (coalesce(n, 0) + n_gold - coalesce(n_both, 0))), 6) AS iou FROM g LEFT JOIN h USING (video_id, q)""")
def retrieval_metrics(s, d):
    q, a, _ = _archive(s, d)
    scores = retrieval.overlap_scores(q, a, _ARCHIVE)
    at = ["video_id", "trajectory_id", "card_id", "chunk_idx"]
    returned = t(s, d, "fork_samples", *at, "recall_result").where("recall_result is not null").distinct()
    asked = t(s, d, "fork_samples", "sample_id", *at).withColumnRenamed("sample_id", "q").distinct().join(q.select("video_id", "q"), ["video_id", "q"], "left_semi")
    gold = asked.join(returned, at).select("video_id", "q", F.explode(F.regexp_extract_all("recall_result", F.lit(r"\[(\d+)\]"), 1)).alias("doc")).withColumn("doc", F.col("doc").cast("int")).distinct()
    m = retrieval.metrics(retrieval.top_k(scores, ["video_id", "q"], 4, "doc"), gold, ["video_id", "q"], "doc", 4)
    return m.select("n_queries", *(r6(c).alias(c) for c in ("hit", "mrr", "iou")))


_COS = "round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 6)"


@query(f"""SELECT q.vec_id AS q, e.vec_id AS doc, {_COS} AS cosine, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id)::INT AS rank FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0 QUALIFY rank <= 4""")
def dense_retrieval(s, d):
    e = t(s, d, "embeddings", "vec_id", "embedding")
    return retrieval.dense_top_k(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 4)


BM25 = f"""{ARCHIVE}, tk AS (SELECT video_id, doc, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM ar), tf AS (SELECT video_id, doc, word, count(*) AS tf FROM tk GROUP BY ALL), ln AS (SELECT video_id, doc, sum(tf) AS len FROM tf GROUP BY ALL),
wh AS (SELECT qs.video_id, q, count(*) AS n, avg(len) AS m FROM qs JOIN ln ON ln.video_id = qs.video_id AND ln.doc <= qs.pos GROUP BY ALL),
hi AS (SELECT qw.video_id, q, doc, word, tf, count(*) OVER (PARTITION BY qw.video_id, q, word) AS df FROM qw JOIN tf USING (video_id, word) WHERE doc <= pos AND word NOT IN ({", ".join(f"'{w}'" for w in text.STOP_WORDS)})),
bm AS (SELECT video_id, q, doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / m))) AS score FROM hi JOIN ln USING (video_id, doc) JOIN wh USING (video_id, q) GROUP BY ALL)"""


@query(f"WITH {BM25} SELECT q, count(*)::BIGINT AS n, round(max(score), 6) AS best, round(sum(score), 4) AS total FROM bm GROUP BY 1")
def bm25_retrieval(s, d):
    q, a, _ = _archive(s, d)
    return retrieval.bm25_scores(q, a, _ARCHIVE).groupBy("q").agg(F.count("*").alias("n"), r6(F.max("score")).alias("best"), F.round(F.sum("score"), 4).alias("total"))


@query(f"""WITH {BM25}, j AS (SELECT video_id, q, doc, bm.score AS a, coalesce(sc.score, 0) / 10.0::DOUBLE AS b FROM bm LEFT JOIN sc USING (video_id, q, doc)), k AS (SELECT *, min(a) OVER w AS lo, max(a) OVER w AS hi FROM j WINDOW w AS (PARTITION BY video_id, q))
SELECT q, count(*)::BIGINT AS n, round(sum(0.5::DOUBLE * coalesce((a - lo) / nullif(hi - lo, 0), 0) + 0.5::DOUBLE * (b + 1) / 2), 4) AS total FROM k GROUP BY 1""")
def hybrid_retrieval(s, d):
    q, a, _ = _archive(s, d)
    keys = ["video_id", "q", "doc"]
    both = retrieval.bm25_scores(q, a, _ARCHIVE).join(retrieval.overlap_scores(q, a, _ARCHIVE).select(*keys, F.col("score").alias("o")), keys, "left")
    both = both.select(*keys, F.col("score").alias("a"), (F.coalesce("o", F.lit(0)) / 10.0).alias("b"))
    return retrieval.blended(both, ["video_id", "q"], "a", "b", 0.5).groupBy("q").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


# Joins and streams


@query("""SELECT n_name, r_name, count(*)::BIGINT AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2""")
def star_join_revenue(s, d):
    geo = t(s, d, "nation").join(t(s, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    c = t(s, d, "customer", "c_custkey", "c_nationkey").join(geo, F.col("n_nationkey") == F.col("c_nationkey"))
    o = t(s, d, "orders", "o_orderkey", "o_custkey").join(c, F.col("c_custkey") == F.col("o_custkey"))
    li = t(s, d, "lineitem", "l_orderkey", "l_extendedprice", "l_discount")
    return li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("n_name", "r_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_join_customers(s, d):
    return t(s, d, "customer", "c_custkey").join(t(s, d, "orders", "o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def semi_join_parts(s, d):
    return t(s, d, "part", "p_partkey").join(t(s, d, "lineitem", "l_partkey", "l_quantity").where("l_quantity >= 45"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def tumbling_counts(s, d):
    return memory.tumbling(t(s, d, "events", "ts", "event_type"), "ts", "1 hour", "event_type")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), i AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM i GROUP BY user_id, k""")
def session_counts(s, d):
    return memory.sessions(t(s, d, "events", "ts", "user_id"), "ts", "6 hours", "user_id")


@query()
def agent_memory_batch(s, d):
    m = t(s, d, "fork_samples", *_CONV, "chunk_idx", "output").where("trajectory_id != '' and chunk_idx is not null")
    think = text.estimated_tokens(text.tag(F.col("output"), "think"))
    chunks = m.groupBy(F.concat_ws("/", "video_id", "trajectory_id").alias("key"), F.col("chunk_idx").cast("long").alias("at")).agg(F.max(F.coalesce(think, F.lit(0))).cast("long").alias("tokens"))
    return memory.memory_batch(chunks, trigger=60, target=40, summary=4)


from heddle.plans import checks, curation, scoring, shaping  # noqa: E402, F401  the other modules of the catalogue register themselves
