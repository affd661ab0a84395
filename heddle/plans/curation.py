"""Queries that curate: near duplicates and decisions, chunks for cards, availability, reports and layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions import text
from heddle.operators import audit, cards, duplicates, sampling
from heddle.plans.registry import CONV, CV, conversation_rows, query, r6
from heddle.session import drop_stage, stage
from heddle.session import table as t

K = ", ".join(CONV)

# Duplicates

SETS = """ds AS (SELECT doc_id, video_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS w FROM documents WHERE video_id IS NOT NULL AND text IS NOT NULL),
dc AS (SELECT doc_id, video_id, w, min(doc_id) OVER (PARTITION BY video_id, w) AS class_id FROM ds WHERE len(w) > 0), rp AS (SELECT DISTINCT video_id, class_id, w FROM dc),
pr AS (SELECT * FROM (SELECT a.video_id, a.class_id AS a, b.class_id AS b, len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) AS sim FROM rp a JOIN rp b ON a.video_id = b.video_id AND a.class_id <> b.class_id AND least(len(a.w), len(b.w)) >= 0.8 * greatest(len(a.w), len(b.w)) - 1e-9) WHERE sim >= 0.8 - 1e-9)"""


def _classes(s: SparkSession, d: str, rank: Column | None = None) -> tuple[DataFrame, tuple]:
    """The classes of documents with equal word sets, and what to compare sets by."""
    docs = t(s, d, "documents", "doc_id", "video_id", "text", "n_chars").where("text is not null")
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1)
    rows = stage(duplicates.profiles(docs, "video_id", "doc_id", words, rank), "profiles")
    classes = stage(duplicates.set_classes(rows, "video_id"), "classes")
    drop_stage(rows)
    return classes, (docs, "video_id", "doc_id", words)


@query(f"""WITH {SETS}, m AS (SELECT a, count(*) AS n, max(sim) AS best FROM pr GROUP BY 1) SELECT doc_id, class_id, coalesce(n, 0)::BIGINT AS n_links, round(coalesce(best, 0), 6) AS best FROM dc LEFT JOIN m ON a = class_id""")
def semantic_near_dup(s, d):
    classes, by = _classes(s, d)
    return duplicates.links(duplicates.similar_sets(*by, 0.8, classes=classes), classes, "video_id").select(F.col("id").alias("doc_id"), "class_id", "n_links", r6("best").alias("best"))


DECIDED = f"""{SETS}, ra AS (SELECT d.doc_id, d.video_id, coalesce(n_chars, -1) AS n, class_id FROM documents d LEFT JOIN dc USING (doc_id)), cr AS (SELECT class_id, max(n) AS r FROM ra WHERE class_id IS NOT NULL GROUP BY 1),
lo AS (SELECT DISTINCT CASE WHEN x.r >= y.r THEN b ELSE a END AS class_id FROM pr JOIN cr x ON x.class_id = a JOIN cr y ON y.class_id = b WHERE a < b),
mk AS (SELECT ra.*, CASE WHEN ra.class_id IS NULL THEN NULL WHEN row_number() OVER (PARTITION BY ra.class_id ORDER BY n DESC, doc_id) > 1 THEN 'drop_copy' WHEN lo.class_id IS NOT NULL THEN 'drop_similar' END AS dd FROM ra LEFT JOIN lo USING (class_id)),
de AS (SELECT doc_id, coalesce(dd, CASE WHEN video_id IS NULL OR row_number() OVER (PARTITION BY video_id, dd IS NULL ORDER BY n DESC, doc_id) <= 12 THEN 'keep' ELSE 'over_cap' END) AS decision FROM mk)"""


def _decided(s: SparkSession, d: str) -> DataFrame:
    n = F.coalesce("n_chars", F.lit(-1).cast("long"))
    classes, by = _classes(s, d, n)
    rows = t(s, d, "documents", "doc_id", "video_id", "n_chars").withColumn("n", n).join(classes.select(F.col("id").alias("doc_id"), "class_id"), "doc_id", "left")
    return duplicates.decide(rows, duplicates.losers(*by, classes), "video_id", "doc_id", [F.desc("n")])


@query(f"WITH {DECIDED} SELECT doc_id, decision FROM de")
def dedup_decision_richest(s, d):
    return _decided(s, d)


@query(f"""WITH {DECIDED}, j AS (SELECT coalesce(lower(trim(source)), '(none)') AS source, decision, n_chars FROM documents JOIN de USING (doc_id)) SELECT source, decision, count(*)::BIGINT AS n_documents, coalesce(sum(n_chars), 0)::BIGINT AS n_chars, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM j GROUP BY 1, 2""")
def curation_report(s, d):
    """From documents over classes, similar texts and caps to the report of what is kept of each source."""
    src = t(s, d, "documents", "doc_id", "source", "n_chars").withColumn("source", F.coalesce(F.lower(F.trim("source")), F.lit("(none)")))
    g = src.join(_decided(s, d), "doc_id").groupBy("source", "decision").agg(F.count("*").alias("n_documents"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n_chars"))
    return g.withColumn("share", r6(F.col("n_documents") / F.sum("n_documents").over(Window.partitionBy("source"))))


# Chunks for cards


def _evidence(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "chunk_evidence", "video_id", "chunk_idx", "visible_entities", "state_changes", "atomic_facts").distinct()


EV = "ev AS (SELECT DISTINCT video_id, chunk_idx, visible_entities, state_changes, atomic_facts FROM chunk_evidence)"


@query()
def diverse_chunks(s, d):
    e = _evidence(s, d).select("video_id", "chunk_idx", F.explode("visible_entities.description").alias("x")).groupBy("video_id", "chunk_idx").agg(F.collect_set("x").alias("items"))
    out = cards.diverse(e, ["video_id"], "chunk_idx", "items")
    return out.select("video_id", F.size("picks").alias("n"), F.array_join("picks", ",").alias("picks"))


@query(f"""WITH {EV}, m AS (SELECT DISTINCT video_id, chunk_idx FROM ev WHERE len(state_changes) > 0) SELECT video_id, chunk_idx, row_number() OVER (PARTITION BY video_id ORDER BY chunk_idx DESC)::INT AS place FROM m QUALIFY place <= 2""")
def last_state_changes(s, d):
    return cards.last_marks(_evidence(s, d), ["video_id"], "chunk_idx", F.size("state_changes") > 0, 2)


_RUNS = " UNION ALL ".join(f"SELECT user_id, chunk, {n} AS size, lag(chunk, {n - 1}) OVER w AS first, (c - coalesce(lag(c, {n}) OVER w, 0)) / {n} AS mean, row_number() OVER w AS r FROM rc WINDOW w AS (PARTITION BY user_id ORDER BY chunk)" for n in range(8, 25))


@query(f"""WITH tl AS (SELECT user_id, (epoch_us(ts) // 3600000000) AS chunk, sum(coalesce(value, 0)) AS v FROM events GROUP BY 1, 2), rc AS (SELECT user_id, chunk, sum(v) OVER (PARTITION BY user_id ORDER BY chunk ROWS UNBOUNDED PRECEDING) AS c FROM tl), ru AS ({_RUNS})
SELECT user_id, round(max(mean), 4) AS mean FROM ru WHERE r >= size GROUP BY 1""")
def best_compress_range(s, d):
    e = t(s, d, "events", "user_id", "ts", "value").withColumn("chunk", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600))
    h = e.groupBy("user_id", "chunk").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("v"))
    return cards.best_range(h, ["user_id"], "chunk", "v", 8, 24).select("user_id", F.round("mean", 4).alias("mean"))


@query(f"""WITH {CV}, asks AS (SELECT {K}, min(c) AS ask FROM cv WHERE kind <> 'compress' AND q <> '' GROUP BY ALL), su AS (SELECT {K}, min(c) AS f, max(c) AS l, bool_or(length(trim(think)) > 40) AS recent FROM cv WHERE kind IN ('response', 'recall_response') GROUP BY ALL)
SELECT status, count(*)::BIGINT AS n FROM (SELECT CASE WHEN f > ask THEN 'in_future' WHEN l >= ask - 15 AND f <= ask THEN 'in_visual' WHEN recent THEN 'in_recent' WHEN l < ask THEN 'in_history' ELSE 'unavailable' END AS status FROM asks LEFT JOIN su USING ({K})) GROUP BY 1""")
def answer_availability(s, d):
    rows = conversation_rows(s, d)
    asks = rows.where(F.coalesce((F.col("kind") != "compress") & (F.col("q") != ""), F.lit(False))).groupBy(*CONV).agg(F.min("c").alias("ask"))
    support = rows.where("kind in ('response', 'recall_response')").groupBy(*CONV).agg(F.min("c").alias("f"), F.max("c").alias("l"), F.max(F.length(F.trim("think")) > 40).alias("recent"))
    status = cards.availability(F.col("ask"), F.col("f"), F.col("l"), F.col("recent"), F.lit(False))
    return asks.join(support, CONV, "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"


@query(f"""WITH {CV}, k AS (SELECT sample_id, c, think, list_filter(list_distinct(regexp_extract_all(lower(q), '[a-z0-9]+')), lambda w: NOT list_contains({_STOP}, w)) AS w FROM cv WHERE q <> '' AND think IS NOT NULL), s AS (SELECT sample_id, c, len(list_filter(w, lambda x: contains(lower(think), x)))::DOUBLE / len(w) AS share FROM k WHERE len(w) > 0)
SELECT sample_id, c AS chunk, round(share, 6) AS share, share > 0.5 AS low, share > 0.35 AS medium, share > 0.2 AS high FROM s""")
def retention_bitmap(s, d):
    rows = conversation_rows(s, d).where("q != '' and think is not null").withColumn("share", cards.contained(F.col("think"), text.keywords(F.col("q")))).where("share is not null")
    return rows.select("sample_id", F.col("c").alias("chunk"), r6("share").alias("share"), *((F.col("share") > v).alias(k) for k, v in cards.RETAINED.items()))


@query(f"""WITH {EV}, f AS (SELECT DISTINCT video_id, x.fact AS fact, x.confidence AS s FROM (SELECT video_id, unnest(atomic_facts) AS x FROM ev) WHERE x.confidence >= 0.75 AND x.fact IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY s DESC, fact) AS r FROM f)
SELECT video_id, string_agg(fact, '|' ORDER BY r) AS captions FROM r WHERE r <= 12 GROUP BY 1""")
def gold_captions(s, d):
    return cards.gold_captions(_evidence(s, d), ["video_id"], "atomic_facts").select("video_id", F.array_join("captions", "|").alias("captions"))


@query(f"""WITH {CV}, a AS (SELECT DISTINCT video_id, c FROM cv WHERE kind <> 'compress' AND q <> ''), g AS (SELECT video_id, c, lead(c) OVER w - c AS gap, c - lag(c) OVER w AS before FROM a WINDOW w AS (PARTITION BY video_id ORDER BY c)) SELECT video_id, c AS chunk, gap, least(gap, before) AS nearest FROM g""")
def ask_gaps(s, d):
    rows = conversation_rows(s, d).where(F.coalesce((F.col("kind") != "compress") & (F.col("q") != ""), F.lit(False)))
    return cards.nearest(rows, ["video_id"], "c").withColumnRenamed("c", "chunk")


@query("""SELECT DISTINCT video_id, chunk_idx, array_to_string(list_transform(range(chunk_idx * 2 + 1, chunk_idx * 2 + 3), lambda i: printf('frame_%06d.jpg', i)), ',') AS frames FROM chunk_evidence""")
def chunk_frames(s, d):
    e = t(s, d, "chunk_evidence", "video_id", "chunk_idx").distinct()
    return e.select("video_id", "chunk_idx", F.array_join(cards.frame_names(F.col("chunk_idx")), ",").alias("frames"))


# Reports and layouts


@query("""WITH b AS (SELECT reg_id, CASE WHEN duration_sec IS NULL OR duration_sec <= 0 THEN 'unknown' WHEN duration_sec < 60 THEN 'short' WHEN duration_sec < 600 THEN 'medium' ELSE 'long' END AS bucket FROM video_registry), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('bucket-' || reg_id::VARCHAR), reg_id) AS r, count(*) OVER (PARTITION BY bucket) AS n FROM b)
SELECT bucket, max(n)::BIGINT AS n, string_agg(reg_id::VARCHAR, ',' ORDER BY r) AS ids FROM r WHERE r <= 50 GROUP BY 1""")
def bucket_samples(s, d):
    v = F.col("duration_sec")
    b = t(s, d, "video_registry", "reg_id", "duration_sec").withColumn("bucket", F.when(v.isNull() | (v <= 0), "unknown").when(v < 60, "short").when(v < 600, "medium").otherwise("long"))
    return sampling.examples(b, "bucket", "reg_id", 50, "bucket-").select("bucket", "n", F.array_join("ids", ",").alias("ids"))


@query("""WITH c AS (SELECT lower(trim(dataset)) AS dataset, lower(trim(uploader)) AS uploader, count(*) AS n FROM video_registry WHERE uploader IS NOT NULL AND dataset IS NOT NULL GROUP BY 1, 2) SELECT dataset, uploader, n::BIGINT AS n, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, uploader)::INT AS rank FROM c QUALIFY rank <= 3""")
def top_uploaders(s, d):
    v = t(s, d, "video_registry", "dataset", "uploader").where("uploader is not null and dataset is not null").select(*(F.lower(F.trim(c)).alias(c) for c in ("dataset", "uploader")))
    return audit.most_common(v, ["dataset"], "uploader", 3)


@query("""WITH g AS (SELECT count(*) AS n FROM documents WHERE video_id IS NOT NULL GROUP BY video_id) SELECT count(*)::BIGINT AS n_groups, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n)::BIGINT AS least, max(n)::BIGINT AS most, round(quantile_cont(n, 0.5), 6) AS median FROM g""")
def group_size_summary(s, d):
    return audit.group_sizes(t(s, d, "documents", "video_id"), "video_id").select("n_groups", r6("mean").alias("mean"), r6("std").alias("std"), "least", "most", r6("median").alias("median"))


@query("""WITH m AS (SELECT avg((text IS NULL)::INT) AS a, avg((n_chars < 40)::INT) AS b, count(DISTINCT source)::DOUBLE AS c FROM documents) SELECT name, round(value, 6) AS value, value > bound AS flagged FROM (SELECT 'null_texts' AS name, a AS value, 0.001 AS bound FROM m UNION ALL SELECT 'short_texts', b, 0.5 FROM m UNION ALL SELECT 'sources', c, 3 FROM m)""")
def threshold_flags(s, d):
    m = t(s, d, "documents", "text", "n_chars", "source")
    rates = {"null_texts": (F.avg(F.col("text").isNull().cast("int")), 0.001), "short_texts": (F.avg((F.col("n_chars") < 40).cast("int")), 0.5), "sources": (F.count_distinct("source").cast("double"), 3)}
    return audit.flags(m, rates).withColumn("value", r6("value"))


@query("""WITH x AS (SELECT o_orderpriority AS cls, o_orderkey AS step, o_totalprice AS loss FROM orders), c AS (SELECT *, max(step) OVER () - 5000 AS lo FROM x) SELECT cls, count(*)::BIGINT AS n, round(avg(loss), 4) AS mean FROM c WHERE step > lo GROUP BY 1""")
def last_steps_loss(s, d):
    x = t(s, d, "orders", "o_orderpriority", "o_orderkey", "o_totalprice").select(F.col("o_orderpriority").alias("cls"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("loss"))
    return audit.last_steps(x, "step", 5000).groupBy("cls").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 4).alias("mean"))


@query("""SELECT shard, count(*)::BIGINT AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, ((row_number() OVER (ORDER BY md5('shard-' || doc_id::VARCHAR), doc_id) - 1) % 4)::INT AS shard FROM documents) GROUP BY 1""")
def shard_rows(s, d):
    return sampling.shards(t(s, d, "documents", "doc_id"), "doc_id", 4, "shard-").groupBy("shard").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("""SELECT doc_id FROM documents WHERE lower(trim(lang)) = 'en' EXCEPT SELECT doc_id FROM review_labels WHERE abusive = 1""")
def set_difference(s, d):
    return t(s, d, "documents", "doc_id", "lang").where(F.lower(F.trim("lang")) == "en").select("doc_id").distinct().exceptAll(t(s, d, "review_labels", "doc_id", "abusive").where("abusive = 1").select("doc_id").distinct())


@query(f"""WITH {CV} SELECT DISTINCT card_id, list_extract(string_split(card_id, '_'), -2) AS family FROM cv WHERE contains(card_id, '_')""")
def card_families(s, d):
    cards_ = conversation_rows(s, d).select("card_id").distinct().where(F.contains("card_id", F.lit("_")))
    return cards_.select("card_id", F.try_element_at(F.split("card_id", "_"), F.lit(-2)).alias("family"))


@query("""WITH e AS (SELECT DISTINCT video_id, chunk_idx, attempt, time_span FROM chunk_evidence WHERE len(time_span) = 2) SELECT video_id, chunk_idx * 2 + k AS chunk, attempt, time_span[1] // 2 AS lo, time_span[2] // 2 AS hi FROM e, (SELECT unnest([0, 1]) AS k)""")
def halved_chunks(s, d):
    e = t(s, d, "chunk_evidence", "video_id", "chunk_idx", "attempt", "time_span").distinct().where(F.size("time_span") == 2)
    half = F.transform("time_span", lambda x: F.floor(x / 2).cast("int"))
    return e.select("video_id", "attempt", half.alias("h"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "chunk_idx").select("video_id", (F.col("chunk_idx") * 2 + F.col("k")).alias("chunk"), "attempt", F.col("h")[0].alias("lo"), F.col("h")[1].alias("hi"))


@query(f"""WITH {CV}, fq AS (SELECT {K}, arg_min(q, (c, sample_id)) AS question FROM cv WHERE kind <> 'compress' AND q <> '' GROUP BY ALL), k AS (SELECT DISTINCT {K} FROM cv) SELECT {K}, coalesce(question, '<implicit>') AS question FROM k LEFT JOIN fq USING ({K})""".replace("arg_min(q, (c, sample_id))", "arg_min(q, {'c': c, 's': sample_id, 'q': q})"))
def question_backfill(s, d):
    rows = conversation_rows(s, d)
    asked = F.coalesce((F.col("kind") != "compress") & (F.col("q") != ""), F.lit(False))
    first = F.min(F.when(asked, F.struct("c", "sample_id", "q")))["q"]
    return rows.groupBy(*CONV).agg(F.coalesce(first, F.lit("<implicit>")).alias("question"))


@query("""WITH v AS (SELECT DISTINCT sample_id, msg_idx, role, content FROM messages), g AS (SELECT sample_id, lower(trim(role)) AS r, msg_idx, content FROM v)
SELECT sample_id, count(*) FILTER (WHERE r IN ('user', 'human'))::BIGINT AS n_asks, min(msg_idx) FILTER (WHERE r IN ('user', 'human')) AS first_ask, max(msg_idx) AS last_at, coalesce(bool_or(contains(content, '<answer>')), false) AS answers, coalesce(bool_or(contains(content, '<tool_call>')), false) AS calls FROM g GROUP BY 1""")
def registry_features(s, d):
    role, c = F.lower(F.trim("role")), F.col("content")
    user = role.isin("user", "human")
    m = t(s, d, "messages", "sample_id", "msg_idx", "role", "content").distinct()
    some = lambda x: F.coalesce(F.bool_or(F.contains(c, F.lit(x))), F.lit(False))
    return m.groupBy("sample_id").agg(F.count_if(user).alias("n_asks"), F.min(F.when(user, F.col("msg_idx"))).alias("first_ask"), F.max("msg_idx").alias("last_at"), some("<answer>").alias("answers"), some("<tool_call>").alias("calls"))

