"""Queries that shape samples for training and report on selections."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions import protocol, stats, text
from heddle.operators import retrieval, samples, sampling
from heddle.plans.catalogue import ARCHIVE, _archive
from heddle.plans.registry import CONV, CV, conversation_rows, query, r6
from heddle.session import table as t
from heddle.sources import files

K = ", ".join(CONV)


@query(f"""WITH {CV}, g AS (SELECT {K}, c, max(q) AS q, max(recall_result) AS tool, max(output) FILTER (WHERE kind = 'recall_query') AS call, max(output) FILTER (WHERE kind IN ('recall_response', 'recall_silent')) AS fin FROM cv WHERE kind IN ('recall_query', 'recall_response', 'recall_silent') GROUP BY ALL),
m AS (SELECT * FROM g WHERE call IS NOT NULL AND fin IS NOT NULL), o AS (SELECT cv.* FROM cv LEFT JOIN m ON m.video_id = cv.video_id AND m.trajectory_id = cv.trajectory_id AND m.card_id = cv.card_id AND m.c = cv.c WHERE m.c IS NULL OR cv.kind IS NULL OR cv.kind NOT IN ('recall_query', 'recall_response', 'recall_silent'))
SELECT {K}, c AS chunk, 'recall' AS shape, array_to_string(list_filter(['system', CASE WHEN q IS NOT NULL THEN 'user' END, 'assistant', CASE WHEN tool IS NOT NULL THEN 'tool' END, 'assistant'], lambda x: x IS NOT NULL), ',') AS roles, md5(call || '|' || coalesce(tool, '') || '|' || fin) AS said FROM m
UNION ALL SELECT {K}, c, CASE WHEN kind = 'compress' THEN 'compress' ELSE 'single' END, array_to_string(list_filter(['system', CASE WHEN q IS NOT NULL THEN 'user' END, CASE WHEN output IS NOT NULL THEN 'assistant' END], lambda x: x IS NOT NULL), ','), md5(coalesce(output, '')) FROM o""")
def chat_shapes(s, d):
    rows = samples.shapes(conversation_rows(s, d), [*CONV, "c"])
    said = F.when(F.col("shape") == "recall", F.concat_ws("|", "call", F.coalesce("tool", F.lit("")), "final")).otherwise(F.coalesce("final", F.lit("")))
    return rows.select(*CONV, F.col("c").alias("chunk"), "shape", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), F.md5(said).alias("said"))


@query(f"""WITH {CV} SELECT video_id, trajectory_id, count(*)::BIGINT AS n, count(DISTINCT card_id)::BIGINT AS n_cards, min(c) AS first_chunk, max(c) AS last_chunk, array_to_string(list_sort(list_distinct(list(c) FILTER (WHERE kind <> 'compress' AND q <> ''))), ',') AS ask_chunks FROM cv GROUP BY 1, 2""")
def trajectory_stats(s, d):
    asked = F.coalesce((F.col("kind") != "compress") & (F.col("q") != ""), F.lit(False))
    g = conversation_rows(s, d).groupBy("video_id", "trajectory_id").agg(F.count("*").alias("n"), F.count_distinct("card_id").alias("n_cards"), F.min("c").alias("first_chunk"), F.max("c").alias("last_chunk"), F.array_sort(F.collect_set(F.when(asked, F.col("c")))).alias("a"))
    return g.withColumn("ask_chunks", F.when(F.size("a") > 0, F.array_join("a", ","))).drop("a")


@query(f"""WITH {CV}, g AS (SELECT sample_id, c, list_transform(regexp_extract_all(recall_result, '\\[(\\d+)\\]', 1), lambda x: x::INT) AS e FROM cv WHERE recall_result IS NOT NULL) SELECT sample_id, c AS chunk, greatest(0, list_min(e) - 2) AS lo, list_max(e) + 2 AS hi FROM g WHERE len(e) > 0""")
def recall_ranges(s, d):
    e = F.transform(F.regexp_extract_all("recall_result", F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("int"))
    rows = conversation_rows(s, d).where("recall_result is not null").withColumn("e", e).where(F.size("e") > 0)
    return rows.select("sample_id", F.col("c").alias("chunk"), F.greatest(F.lit(0), F.array_min("e") - 2).alias("lo"), (F.array_max("e") + 2).alias("hi"))


@query(f"""WITH {ARCHIVE}, tr AS (SELECT sample_id AS q, video_id, max(json_extract_string(c, '$.arguments.time_range')) AS r FROM (SELECT *, CASE WHEN regexp_matches(output, '(?s)<tool_call>.*?</tool_call>') THEN regexp_extract(output, '(?s)<tool_call>(.*?)</tool_call>', 1) END AS c FROM fs) WHERE json_valid(c) GROUP BY 1, 2),
w AS (SELECT sc.*, row_number() OVER (PARTITION BY video_id, q ORDER BY score DESC, doc) AS r2 FROM sc JOIN tr USING (video_id, q) WHERE regexp_matches(r, '^\\d+-\\d+$') AND doc + 1 > string_split(r, '-')[1]::INT AND doc < string_split(r, '-')[2]::INT) SELECT q, doc, score, r2::INT AS rank FROM w WHERE r2 <= 4""")
def ranged_retrieval(s, d):
    q, a, f = _archive(s, d)
    span = F.get_json_object(text.tag(F.col("output"), "tool_call"), "$.arguments.time_range")
    ranges = f.groupBy("video_id", F.col("sample_id").alias("q")).agg(F.max(span).alias("r")).where(r"r rlike '^\\d+-\\d+$'")
    lo, hi = (F.split("r", "-")[i].cast("int") for i in (0, 1))
    near = retrieval.in_window(retrieval.overlap_scores(q, a, ["video_id"]).join(ranges, ["video_id", "q"]), F.col("doc"), lo, hi)
    return retrieval.top_k(near, ["video_id", "q"], 4, "doc").select("q", "doc", "score", "rank")


@query("""WITH b AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY reg_id) AS r FROM video_registry WHERE video_id IS NOT NULL) SELECT reason, count(*)::BIGINT AS n FROM (SELECT CASE WHEN r > 1 THEN 'duplicate' WHEN duration_sec IS NULL THEN 'no_duration' WHEN duration_sec < 30 THEN 'too_short' WHEN duration_sec > 1800 THEN 'too_long' ELSE 'kept' END AS reason FROM b) GROUP BY 1""")
def catalog_admission(s, d):
    v = t(s, d, "video_registry", "video_id", "reg_id", "duration_sec").where("video_id is not null")
    first = v.groupBy("video_id").agg(F.min("reg_id").alias("_first"))  # one row a video: no window over a hot one
    x = F.col("duration_sec")
    rules = {"duplicate": F.col("reg_id") > F.col("_first"), "no_duration": x.isNull(), "too_short": x < 30, "too_long": x > 1800}
    return files.skip_counts(files.skip_reason(v.join(first, "video_id"), rules))


@query("""WITH f AS (SELECT video_id, min(trajectory_id) AS t FROM fork_samples WHERE trajectory_id <> '' GROUP BY 1) SELECT video_id, count(*)::BIGINT AS n, count(*) FILTER (WHERE trajectory_id <> '')::BIGINT AS n_first FROM (SELECT DISTINCT sample_id, video_id, trajectory_id FROM fork_samples WHERE video_id IS NOT NULL) LEFT JOIN f USING (video_id) WHERE coalesce(trajectory_id, '') = '' OR trajectory_id = t GROUP BY 1""")
def first_trajectories(s, d):
    rows = t(s, d, "fork_samples", "sample_id", "video_id", "trajectory_id").where("video_id is not null").distinct()
    return samples.first_trajectory(rows, "video_id", "trajectory_id").groupBy("video_id").agg(F.count("*").alias("n"), F.count_if(F.col("trajectory_id") != "").alias("n_first"))


@query("""WITH v AS (SELECT DISTINCT sample_id, msg_idx, lower(trim(role)) AS r, content FROM messages), g AS (SELECT sample_id, bool_or(r IN ('assistant', 'gpt', 'bot', 'model')) AS ok, sum(length(coalesce(content, '')) // 3) AS cost FROM v GROUP BY 1) SELECT sample_id, cost::BIGINT AS cost, cost > 120 AS overlong FROM g WHERE ok""")
def scorable_messages(s, d):
    m = t(s, d, "messages", "sample_id", "msg_idx", "role", "content").distinct()
    g = m.groupBy("sample_id").agg(F.bool_or(F.lower(F.trim("role")).isin("assistant", "gpt", "bot", "model")).alias("ok"), F.sum(F.floor(F.length(F.coalesce("content", F.lit(""))) / 3)).alias("cost"))
    return g.where("ok").select("sample_id", "cost", (F.col("cost") > 120).alias("overlong"))


@query("""WITH m AS (SELECT unnest(['click', 'view', 'error', 'click']) AS event_type, unnest(['browse', 'browse', 'fault', 'act']) AS task) SELECT task, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events JOIN m USING (event_type) GROUP BY 1""")
def mapped_tasks(s, d):
    tasks = {"click": ["browse", "act"], "view": ["browse"], "error": ["fault"]}
    by_type = t(s, d, "events", "event_type", "value").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    mapped = F.create_map(*(x for k, v in tasks.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return by_type.select(F.explode(F.try_element_at(mapped, F.col("event_type"))).alias("task"), "n", "v").groupBy("task").agg(F.sum("n").alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query("""WITH x AS (SELECT lower(trim(dataset)) AS dataset, duration_sec AS v FROM video_registry WHERE dataset IS NOT NULL AND duration_sec > 0), r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY dataset) AS n FROM x)
SELECT dataset, max(n)::BIGINT AS n, min(v) AS least, max(v) FILTER (WHERE i = least(n - 1, floor(n * 0.5::DOUBLE))) AS p50, max(v) FILTER (WHERE i = least(n - 1, floor(n * 0.95::DOUBLE))) AS p95, max(v) AS most FROM r GROUP BY 1""")
def selection_report(s, d):
    x = t(s, d, "video_registry", "dataset", "duration_sec").where("dataset is not null and duration_sec > 0").select(F.lower(F.trim("dataset")).alias("dataset"), "duration_sec")
    ends = x.groupBy("dataset").agg(F.min("duration_sec").alias("least"), F.max("duration_sec").alias("most"))
    return stats.nearest_rank_by(x, ["dataset"], "duration_sec", {"p50": 0.5, "p95": 0.95}).join(ends, "dataset").select("dataset", "n", "least", "p50", "p95", "most")


@query("""SELECT source, count(DISTINCT substr(sha1(text), 1, 8))::BIGINT AS n_keys, min(substr(sha1(text), 1, 8)) AS first_key FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY 1""")
def content_keys(s, d):
    x = t(s, d, "documents", "source", "text").where("text is not null and source is not null").select("source", F.substring(F.sha1("text"), 1, 8).alias("k"))
    return x.groupBy("source").agg(F.count_distinct("k").alias("n_keys"), F.min("k").alias("first_key"))


@query("""SELECT event_id, round(coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 0), 6) AS scaled FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id)""")
def min_max_scaled(s, d):
    e = t(s, d, "events", "event_id", "user_id", "value").where("value is not null")
    return e.select("event_id", r6(protocol.min_max(F.col("value"), Window.partitionBy("user_id"))).alias("scaled"))


@query("""SELECT event_type, count(*)::BIGINT AS n, round(count(*)::DOUBLE * 3600 / greatest(1, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000), 6) AS per_hour FROM events GROUP BY 1""")
def request_rates(s, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    g = t(s, d, "events", "event_type", "ts").groupBy("event_type").agg(F.count("*").alias("n"), ((F.max(us) - F.min(us)) / 1_000_000).alias("span"))
    return g.select("event_type", "n", r6(F.col("n") * 3600 / F.greatest(F.lit(1.0), F.col("span"))).alias("per_hour"))


@query("""SELECT doc_id, (r // 8)::BIGINT AS batch, (r % 8)::INT AS slot FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('batch-' || doc_id::VARCHAR), doc_id) - 1 AS r FROM documents)""")
def micro_batches(s, d):
    rows = sampling.ranked(t(s, d, "documents", "doc_id"), "doc_id", "batch-")
    return rows.select("doc_id", F.floor((F.col("_rank") - 1) / 8).alias("batch"), ((F.col("_rank") - 1) % 8).cast("int").alias("slot"))


@query(f"""WITH {CV}, x AS (SELECT CASE WHEN a IS NULL THEN 'missing' WHEN a = '' THEN 'empty' WHEN regexp_full_match(a, '-?[0-9]+') THEN 'number' WHEN regexp_matches(a, '(?i)^(yes|no)\\b') THEN 'yes_no' WHEN regexp_full_match(a, '\\(?[A-Da-d]\\)?[.)]?') THEN 'letter' WHEN length(a) <= 24 THEN 'short' ELSE 'long' END AS form, kind FROM cv) SELECT kind, form, count(*)::BIGINT AS n FROM x GROUP BY 1, 2""")
def answer_text_classes(s, d):
    a = F.col("a")
    form = F.when(a.isNull(), "missing").when(a == "", "empty").when(a.rlike("^-?[0-9]+$"), "number").when(a.rlike(r"(?i)^(yes|no)\b"), "yes_no").when(a.rlike(r"^\(?[A-Da-d]\)?[.)]?$"), "letter").when(F.length(a) <= 24, "short").otherwise("long")
    return conversation_rows(s, d).groupBy("kind", form.alias("form")).agg(F.count("*").alias("n"))


@query(f"""WITH {CV}, x AS (SELECT kind, length(think) AS v FROM cv WHERE think IS NOT NULL AND kind IS NOT NULL), y AS (SELECT kind, v FROM x UNION ALL SELECT '_all', v FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM y)
SELECT kind, max(n)::BIGINT AS n, round(avg(v), 6) AS mean, max(v) FILTER (WHERE i = least(n - 1, floor(n * 0.5::DOUBLE))) AS p50, max(v) FILTER (WHERE i = least(n - 1, floor(n * 0.95::DOUBLE))) AS p95, max(v) AS most FROM r GROUP BY 1""")
def think_telemetry(s, d):
    x = conversation_rows(s, d).where("think is not null and kind is not null").select(F.explode(F.array("kind", F.lit("_all"))).alias("kind"), F.length("think").alias("v"))
    m = x.groupBy("kind").agg(r6(F.avg("v")).alias("mean"), F.max("v").alias("most"))
    return stats.nearest_rank_by(x, ["kind"], "v", {"p50": 0.5, "p95": 0.95}).join(m, "kind").select("kind", "n", "mean", "p50", "p95", "most")


@query(f"""WITH {CV}, g AS (SELECT video_id, kind, count(*) AS n FROM cv WHERE kind IS NOT NULL GROUP BY 1, 2) SELECT video_id, kind, n::BIGINT AS n, round(n::DOUBLE / sum(n) OVER (PARTITION BY video_id), 6) AS share, n::DOUBLE / sum(n) OVER (PARTITION BY video_id) < 0.05 AS rare FROM g""")
def kind_distribution(s, d):
    g = conversation_rows(s, d).where("kind is not null").groupBy("video_id", "kind").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("video_id"))
    return g.withColumn("s", share).select("video_id", "kind", "n", r6("s").alias("share"), (F.col("s") < 0.05).alias("rare"))
