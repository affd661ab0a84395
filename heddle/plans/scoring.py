"""Queries that score answers: probes, rewards and advantages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import rewards, stats, text
from heddle.operators import evaluate, probes
from heddle.plans.registry import CONV, CV, conversation_rows, query, r6
from heddle.session import table as t

K = ", ".join(CONV)


def _asks(rows: DataFrame) -> DataFrame:
    asked = F.coalesce((F.col("kind") != "compress") & (F.col("q") != ""), F.lit(False))
    return rows.where(asked).groupBy(*CONV).agg(F.min("c").alias("ask"))


def _answers(rows: DataFrame) -> DataFrame:
    return rows.where("kind in ('response', 'recall_response')").select(*CONV, "c", "a", F.col("sample_id").alias("tie"))


ASKS = f"""{CV}, asks AS (SELECT {K}, min(c) AS ask FROM cv WHERE kind <> 'compress' AND q <> '' GROUP BY ALL), ans AS (SELECT {K}, c, a, sample_id FROM cv WHERE kind IN ('response', 'recall_response')),
early AS (SELECT {K}, count(*) AS n_early FROM ans JOIN asks USING ({K}) WHERE c < ask GROUP BY ALL)"""


def _first(wait: int) -> str:
    return f"SELECT {K}, ask, c AS chunk, a AS answer FROM ans JOIN asks USING ({K}) WHERE a <> '' AND c BETWEEN ask AND ask + {wait} QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY c, sample_id, a) = 1"


@query(f"""WITH {ASKS}, strict AS ({_first(2)}), lenient AS ({_first(60)})
SELECT {K}, asks.ask, strict.chunk AS chunk, lenient.chunk AS late_chunk, upper(regexp_extract(coalesce(lenient.answer, ''), '^\\(?([A-Da-d])\\)?(?:[.):\\s]|$)', 1)) AS letter, coalesce(n_early, 0)::BIGINT AS n_early
FROM asks LEFT JOIN strict USING ({K}) LEFT JOIN lenient USING ({K}) LEFT JOIN early USING ({K})""")
def probe_scoring_mcq(s, d):
    rows = conversation_rows(s, d)
    strict = probes.first_answers(_asks(rows), _answers(rows), CONV, 2)
    lenient = probes.first_answers(_asks(rows), _answers(rows), CONV, 60).select(*CONV, F.col("chunk").alias("late_chunk"), text.normal_answer(F.col("answer"), "choice").alias("letter"))
    return strict.join(lenient, CONV).select(*CONV, "ask", "chunk", "late_chunk", "letter", "n_early")


@query(f"""WITH {CV}, p AS (SELECT DISTINCT {K}, c AS probe FROM cv WHERE kind = 'recall_query'), f AS (SELECT {K}, c, max(a) AS a FROM cv WHERE kind IN ('response', 'recall_response') AND a <> '' GROUP BY ALL)
SELECT {K}, probe, max(f.c) AS chunk, nullif(regexp_extract(coalesce(arg_max(f.a, f.c), ''), '(-?[0-9]+)', 1), '') AS number FROM p LEFT JOIN f ON f.video_id = p.video_id AND f.trajectory_id = p.trajectory_id AND f.card_id = p.card_id AND f.c <= p.probe GROUP BY ALL""".replace(f"SELECT {K}, probe, max", "SELECT p.video_id, p.trajectory_id, p.card_id, probe, max"))
def probe_scoring_count(s, d):
    rows = conversation_rows(s, d)
    said = rows.where("kind in ('response', 'recall_response') and a != ''").groupBy(*CONV, "c").agg(F.max("a").alias("a"))
    out = probes.count_at(rows.where("kind = 'recall_query'"), said, CONV)
    return out.select(*CONV, "probe", "chunk", F.nullif(F.regexp_extract(F.coalesce("answer", F.lit("")), r"(-?[0-9]+)", 1), F.lit("")).alias("number"))


@query(f"""WITH {CV}, p AS (SELECT c % 2 AS type, kind IN ('response', 'recall_response') AS r, kind IN ('silent', 'recall_silent') AS quiet, coalesce(regexp_matches(a, '(?i)^yes\\b'), false) AS y, coalesce(regexp_matches(a, '(?i)^no\\b'), false) AS n FROM cv WHERE kind IN ('response', 'recall_response', 'silent', 'recall_silent')),
x AS (SELECT type, CASE WHEN type = 0 THEN r AND n ELSE r AND y END AS strict, CASE WHEN type = 0 THEN quiet OR (r AND n) ELSE r AND y END AS lenient, type = 0 AND r AND y AS fp FROM p)
SELECT type, count(*)::BIGINT AS n, count(*) FILTER (WHERE strict)::BIGINT AS n_strict, count(*) FILTER (WHERE lenient)::BIGINT AS n_lenient, count(*) FILTER (WHERE fp)::BIGINT AS n_false FROM x GROUP BY 1""")
def probe_scoring_yes_no(s, d):
    kind, a = F.col("kind"), F.coalesce("a", F.lit(""))
    rows = conversation_rows(s, d).where("kind in ('response', 'recall_response', 'silent', 'recall_silent')").withColumn("type", F.col("c") % 2)
    v = probes.yes_no_at(F.col("type"), kind.isin("response", "recall_response"), kind.isin("silent", "recall_silent"), a.rlike(r"(?i)^yes\b"), a.rlike(r"(?i)^no\b"))
    return rows.withColumn("v", v).groupBy("type").agg(F.count("*").alias("n"), F.count_if("v.strict").alias("n_strict"), F.count_if("v.lenient").alias("n_lenient"), F.count_if("v.false_positive").alias("n_false"))


@query(f"""WITH {ASKS}, first AS ({_first(100000)}), gold AS (SELECT {K}, arg_max(a, c) AS gold FROM (SELECT {K}, c, max(a) AS a FROM ans WHERE a <> '' GROUP BY ALL) GROUP BY ALL)
SELECT {K}, chunk, coalesce(contains(lower(answer), lower(gold)) OR contains(lower(gold), lower(answer)), false) AS correct, coalesce(chunk <= asks.ask + 5, false) AS in_window FROM asks LEFT JOIN first USING ({K}) LEFT JOIN gold USING ({K})""")
def adapter_scores(s, d):
    rows = conversation_rows(s, d)
    said = _answers(rows).where("a != ''").groupBy(*CONV, "c").agg(F.max("a").alias("a"))
    gold = said.groupBy(*CONV).agg(F.max_by("a", "c").alias("gold"))
    first = probes.first_answers(_asks(rows), _answers(rows), CONV, 100_000).join(gold, CONV, "left")
    right = rewards.outcome(F.col("answer"), F.col("gold"), F.lit("descriptive")) == 1
    return first.select(*CONV, "chunk", right.alias("correct"), F.coalesce(F.col("chunk") <= F.col("ask") + 5, F.lit(False)).alias("in_window"))


@query("""SELECT item_id, task, floor(realtime)::INT AS ask_chunk, (floor(realtime) + 60)::INT AS last_chunk, chr(65 + gt) AS letter, option_list[gt + 1] AS gold,
question || ' ' || array_to_string(list_transform(range(1, len(option_list) + 1), lambda i: chr((64 + i)::INT) || '. ' || option_list[i]), ' ') AS prompt FROM eval_items WHERE len(option_list) > 0""")
def question_chunks(s, d):
    e = t(s, d, "eval_items").where(F.size("option_list") > 0)
    options = F.array_join(F.transform("option_list", lambda o, i: F.concat(F.chr(i + 65), F.lit(". "), o)), " ")
    at = F.floor("realtime").cast("int")
    return e.select("item_id", "task", at.alias("ask_chunk"), (at + 60).alias("last_chunk"), F.chr(F.col("gt") + 65).alias("letter"), F.get("option_list", F.col("gt")).alias("gold"), F.concat_ws(" ", "question", options).alias("prompt"))


SCORED = f"""{ASKS}, first AS ({_first(60)}), sc AS (SELECT {K}, asks.ask, chunk, coalesce(regexp_matches(answer, '(?i)^(yes|true)\\b'), false) AS ok FROM asks LEFT JOIN first USING ({K}))"""


def _scored(s: SparkSession, d: str) -> DataFrame:
    rows = conversation_rows(s, d)
    return probes.first_answers(_asks(rows), _answers(rows), CONV, 60).withColumn("ok", F.coalesce(F.col("answer").rlike(r"(?i)^(yes|true)\b"), F.lit(False)))


@query(f"""WITH {SCORED}, r AS (SELECT chunk - ask AS delay, row_number() OVER (ORDER BY chunk - ask) - 1 AS i, count(*) OVER () AS n FROM sc WHERE chunk IS NOT NULL)
SELECT (SELECT round(avg(ok::INT), 6) FROM sc) AS accuracy, (SELECT round(avg((chunk IS NULL)::INT), 6) FROM sc) AS no_answer, max(delay) FILTER (WHERE i = least(n - 1, floor(n * 0.5::DOUBLE))) AS p50, max(delay) FILTER (WHERE i = least(n - 1, floor(n * 0.9::DOUBLE))) AS p90, max(delay) AS most, round(avg(delay), 6) AS mean FROM r""")
def accuracy_delay(s, d):
    rows = _scored(s, d).withColumn("delay", F.col("chunk") - F.col("ask")).withColumn("one", F.lit(1))
    p = stats.nearest_rank_by(rows, ["one"], "delay", {"p50": 0.5, "p90": 0.9}).select("p50", "p90")
    m = rows.agg(r6(F.avg(F.col("ok").cast("int"))).alias("accuracy"), r6(F.avg(F.col("chunk").isNull().cast("int"))).alias("no_answer"), F.max("delay").alias("most"), r6(F.avg("delay")).alias("mean"))
    return m.join(F.broadcast(p))  # one row each


@query(f"WITH {SCORED} SELECT ((ask // 25) * 25)::BIGINT AS span, count(*)::BIGINT AS n, round(avg(ok::INT), 6) AS accuracy FROM sc GROUP BY 1")
def chunk_bucket_accuracy(s, d):
    return probes.by_span(_scored(s, d), "ask", 25, F.col("ok")).withColumn("accuracy", r6("accuracy"))


@query(f"WITH {SCORED} SELECT video_id, count(*) FILTER (WHERE NOT ok)::BIGINT AS n_wrong, count(*)::BIGINT AS n FROM sc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def worst_videos(s, d):
    return probes.worst(_scored(s, d), ["video_id"], F.col("ok"), 10)


@query("""WITH k AS (SELECT o_orderpriority AS task, CASE WHEN o_orderpriority < '3' THEN 'high' ELSE 'low' END AS category, (o_orderstatus = 'F')::INT AS ok FROM orders), a AS (SELECT category, task, avg(ok) AS acc FROM k GROUP BY 1, 2), c AS (SELECT category, avg(acc) AS acc FROM a GROUP BY 1) SELECT round(sum(acc) / 3, 6) AS overall, count(*)::BIGINT AS n_categories FROM c""")
def overall_of_three(s, d):
    df = t(s, d, "orders", "o_orderpriority", "o_orderstatus").withColumn("category", F.when(F.col("o_orderpriority") < "3", "high").otherwise("low"))
    by = evaluate.macro_accuracy(df, "o_orderpriority", "category", F.col("o_orderstatus") == "F").where("category != 'OVERALL'")
    return probes.overall_of(by, 3).withColumn("overall", r6("overall"))


REWARDED = f"""{CV}, rw AS (SELECT sample_id, video_id, trajectory_id, c, kind, a, output, CASE WHEN kind IN ('response', 'recall_response') THEN q END AS gold, sum(CASE WHEN kind = 'recall_query' THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, trajectory_id) AS nr, sum(CASE WHEN kind = 'compress' THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, trajectory_id) AS nc FROM cv),
rp AS (SELECT sample_id, video_id, trajectory_id, c,
CASE WHEN length(a) <= 1000 AND trim(gold) <> '' AND (contains(lower(a), lower(trim(gold))) OR contains(lower(trim(gold)), lower(a))) THEN 1.0::DOUBLE ELSE 0 END AS outcome,
0.5::DOUBLE * greatest(nr - 1, 0) + 0.3::DOUBLE * greatest(nc - 1, 0) AS spam,
CASE WHEN kind = 'silent' OR (coalesce(kind, '') IN ('', 'none') AND coalesce(trim(gold), '') = '') THEN CASE WHEN coalesce(a, '') <> '' THEN -0.6::DOUBLE ELSE 0.3 END WHEN kind IN ('response', 'recall_response') AND coalesce(trim(gold), '') <> '' AND coalesce(a, '') = '' THEN -0.6 ELSE 0 END AS silent,
CASE WHEN len(regexp_extract_all(output, '<think>')) = len(regexp_extract_all(output, '</think>')) AND len(regexp_extract_all(output, '(?s)<answer>.*?</answer>')) + len(regexp_extract_all(output, '(?s)<tool_call>.*?</tool_call>')) = 1
 AND (NOT regexp_matches(output, '(?s)<tool_call>.*?</tool_call>') OR (json_valid(regexp_extract(output, '(?s)<tool_call>(.*?)</tool_call>', 1)) AND json_extract_string(regexp_extract(output, '(?s)<tool_call>(.*?)</tool_call>', 1), '$.name') IS NOT NULL)) THEN 1.0::DOUBLE ELSE 0 END AS fmt FROM rw)"""


def _rewarded(s: SparkSession, d: str) -> DataFrame:
    rows = conversation_rows(s, d)
    calls = rows.groupBy("video_id", "trajectory_id").agg(F.count_if(F.col("kind") == "recall_query").alias("nr"), F.count_if(F.col("kind") == "compress").alias("nc"))
    gold = F.when(F.col("kind").isin("response", "recall_response"), F.col("q"))
    parts = {"outcome": rewards.outcome(F.col("a"), gold, F.lit("descriptive")), "spam": rewards.spam(F.col("nr"), F.col("nc")), "silent": rewards.silent_quality(F.col("a"), F.col("kind"), gold), "fmt": rewards.well_formed(F.col("output"))}
    return rows.join(calls, ["video_id", "trajectory_id"]).select("sample_id", "video_id", "trajectory_id", "c", *(v.alias(k) for k, v in parts.items()))


@query(f"WITH {REWARDED} SELECT video_id, trajectory_id, count(*)::BIGINT AS n, round(avg(outcome), 6) AS outcome, round(avg(spam), 6) AS spam, round(avg(silent), 6) AS silent, round(avg(fmt), 6) AS fmt, round(avg(outcome + 0.1 * fmt - 0.2 * spam + 0.2 * silent), 6) AS total FROM rp GROUP BY 1, 2")
def reward_components(s, d):
    rows = _rewarded(s, d)
    total = rewards.total({"outcome": F.col("outcome"), "format": F.col("fmt"), "spam": F.col("spam"), "silent": F.col("silent")}, {"format": 0.1, "spam": -0.2, "silent": 0.2})
    return rows.groupBy("video_id", "trajectory_id").agg(F.count("*").alias("n"), *(r6(F.avg(c)).alias(c) for c in ("outcome", "spam", "silent", "fmt")), r6(F.avg(total)).alias("total"))


def _z(x: str, by: str) -> str:
    return f"CASE WHEN count({x}) OVER (PARTITION BY {by}) = 1 THEN {x} ELSE ({x} - avg({x}) OVER (PARTITION BY {by})) / (stddev_samp({x}) OVER (PARTITION BY {by}) + 1e-6) END"


@query(f"WITH e AS (SELECT event_id, event_type, user_id, value AS o, value * (event_id % 7) AS s FROM events WHERE value IS NOT NULL) SELECT event_id, round(0.7::DOUBLE * ({_z('o', 'user_id')}) + 0.3::DOUBLE * ({_z('s', 'user_id, event_type')}), 4) AS advantage FROM e")
def mixed_advantage(s, d):
    e = t(s, d, "events", "event_id", "event_type", "user_id", "value").where("value is not null")
    a = stats.mixed(F.col("value"), F.col("value") * (F.col("event_id") % 7), ["user_id"], ["event_type"], 0.7)
    return e.select("event_id", F.round(a, 4).alias("advantage"))


@query("""WITH g AS (SELECT user_id, avg(value) AS m, var_samp(value) AS v FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT (SELECT round(avg(value), 4) FROM events) AS mean, round(avg(v), 4) AS mean_variance, count(*)::BIGINT AS n_groups FROM g""")
def group_reward_metrics(s, d):
    return stats.group_metrics(t(s, d, "events", "user_id", "value"), ["user_id"], "value").select(F.round("mean", 4).alias("mean"), F.round("mean_variance", 4).alias("mean_variance"), "n_groups")


@query(f"""WITH {CV}, asks AS (SELECT DISTINCT {K}, c AS ask, max(q) AS q FROM cv WHERE kind <> 'compress' AND q <> '' GROUP BY {K}, c), nx AS (SELECT *, lead(ask) OVER (PARTITION BY {K} ORDER BY ask) AS nxt FROM asks),
an AS (SELECT {K}, c, max(a) AS a FROM cv WHERE kind IN ('response', 'recall_response') AND a <> '' GROUP BY ALL),
w AS (SELECT nx.video_id, nx.trajectory_id, nx.card_id, ask, min(c) AS c FROM nx LEFT JOIN an ON an.video_id = nx.video_id AND an.trajectory_id = nx.trajectory_id AND an.card_id = nx.card_id AND c BETWEEN ask AND least(ask + 5, coalesce(nxt - 1, ask + 5)) GROUP BY ALL),
q AS (SELECT {K}, count(*) AS n_asks, count(c) AS n_answered, avg((c IS NOT NULL)::INT) AS outcome FROM w GROUP BY ALL)
SELECT video_id, trajectory_id, count(*)::BIGINT AS n_questions, sum(n_asks)::BIGINT AS n_asks, sum(n_answered)::BIGINT AS n_answered, round(avg(outcome), 6) AS outcome FROM q GROUP BY 1, 2""")
def trajectory_outcome(s, d):
    from heddle.operators import windows

    rows = conversation_rows(s, d)
    asked = F.coalesce((F.col("kind") != "compress") & (F.col("q") != ""), F.lit(False))
    w = windows.answered_in_window(rows.where(asked), rows.where("kind in ('response', 'recall_response') and a != ''"), CONV, "c", 5)
    per = w.groupBy(*CONV).agg(F.count("*").alias("n_asks"), F.count("answer").alias("n_answered"), F.avg(F.col("answer").isNotNull().cast("int")).alias("outcome"))
    return per.groupBy("video_id", "trajectory_id").agg(F.count("*").alias("n_questions"), F.sum("n_asks").alias("n_asks"), F.sum("n_answered").alias("n_answered"), r6(F.avg("outcome")).alias("outcome"))


@query("""WITH x AS (SELECT o_orderpriority AS cls, o_totalprice AS loss, o_custkey % 5 AS w FROM orders) SELECT CASE WHEN grouping(cls) = 1 THEN '_all' ELSE cls END AS cls, count(*)::BIGINT AS n, round(avg(loss), 4) AS mean_loss, round(avg(w), 6) AS mean_weight, round(count(*)::DOUBLE / (SELECT count(*) FROM x), 6) AS fraction FROM x GROUP BY ROLLUP (cls)""")
def class_losses(s, d):
    x = t(s, d, "orders", "o_orderpriority", "o_totalprice", "o_custkey").select(F.col("o_orderpriority").alias("cls"), F.col("o_totalprice").alias("loss"), (F.col("o_custkey") % 5).alias("w"))
    out = evaluate.per_class(x, "cls", "loss", "w")
    return out.select("cls", "n", F.round("mean_loss", 4).alias("mean_loss"), r6("mean_weight").alias("mean_weight"), r6("fraction").alias("fraction"))
