"""Queries that check samples, summaries and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import protocol, text
from heddle.operators import verify
from heddle.plans.registry import CV, conversation_rows, query, r6
from heddle.session import table as t

_NOT_SEEN = "[" + ", ".join(f"'{p}'" for p in verify.NOT_SEEN) + "]"

VERIFIED = f"""{CV}, vt AS (SELECT sample_id, kind, array_to_string(list_filter([
CASE WHEN NOT coalesce(regexp_matches(output, '(?s)<think>.*?</think>'), false) THEN 'no_think' WHEN list_bool_or(list_transform({_NOT_SEEN}, lambda p: contains(lower(array_to_string(regexp_extract_all(output, '(?s)<think>(.*?)</think>', 1), chr(10))), p))) THEN 'not_seen' END,
CASE WHEN regexp_matches(q, '(?i)^(is|are|does|do|did|was|were|has|have|can) ') AND kind IN ('response', 'recall_response') AND NOT coalesce(regexp_full_match(trim(a), 'Yes|No'), false) THEN 'answer_form' END,
CASE WHEN NOT (length(coalesce(think, '')) // 4 BETWEEN 0 AND 30) THEN 'think_length' END,
CASE WHEN kind IN ('response', 'recall_response') AND coalesce(trim(a), '') = '' THEN 'no_answer' END,
CASE WHEN kind LIKE '%silent' AND a <> '' THEN 'answer_in_silence' END,
CASE WHEN list_bool_or(list_transform(regexp_extract_all(coalesce(recall_result, ''), '\\[(\\d+)\\]', 1), lambda x: x::INT > c)) THEN 'future_evidence' END
], lambda x: x IS NOT NULL), ',') AS reasons FROM cv)"""


def _verified(s: SparkSession, d: str) -> DataFrame:
    rows, kind, a = conversation_rows(s, d), F.col("kind"), F.col("a")
    answers = kind.isin("response", "recall_response")
    binary = F.when(F.col("q").rlike(r"(?i)^(is|are|does|do|did|was|were|has|have|can) ") & answers, "binary")
    evidence = F.transform(F.regexp_extract_all(F.coalesce("recall_result", F.lit("")), F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("int"))
    checks = {
        "grounded": verify.grounded(F.col("output")),
        "form": verify.strict_answer(a, binary),
        "think": verify.think_length(F.col("think")),
        "answer": F.when(answers & (F.coalesce(F.trim(a), F.lit("")) == ""), "no_answer"),
        "silence": F.when(kind.endswith("silent") & (a != ""), "answer_in_silence"),
        "past": verify.in_past(F.col("c"), evidence),
    }
    return rows.select("sample_id", "kind", F.array_join(verify.reasons(checks), ",").alias("reasons"))


@query(f"WITH {VERIFIED} SELECT sample_id, kind, reasons FROM vt WHERE reasons <> ''")
def verification_tags(s, d):
    return _verified(s, d).where("reasons != ''")


@query(f"WITH {VERIFIED} SELECT kind, count(*)::BIGINT AS n, count(*) FILTER (WHERE reasons = '')::BIGINT AS n_passed, round(avg((reasons = '')::INT), 6) AS pass_rate FROM vt GROUP BY 1")
def pass_rates(s, d):
    ok = F.col("reasons") == ""
    return _verified(s, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_passed"), r6(F.avg(ok.cast("int"))).alias("pass_rate"))


_RANGE = r"range='(\d+)-(\d+)'"

#: Compress rows with their range, and the thinks of their trajectory that lie in it (interval containment).
COMPRESSED = f"""{CV}, cp AS (SELECT sample_id, video_id, trajectory_id, c, think, regexp_extract(q, $$range='(\\d+)-(\\d+)'$$, 1)::INT AS lo, regexp_extract(q, $$range='(\\d+)-(\\d+)'$$, 2)::INT AS hi, json_extract_string(CASE WHEN json_valid(call) THEN call END, '$.arguments.text') AS summary
FROM cv WHERE kind = 'compress' AND regexp_matches(q, $$range='(\\d+)-(\\d+)'$$)), th AS (SELECT video_id, trajectory_id, c, max(trim(think)) AS think FROM cv WHERE trim(think) <> '' GROUP BY ALL),
so AS (SELECT cp.sample_id, any_value(cp.think) AS think, any_value(cp.c) AS c, any_value(lo) AS lo, any_value(hi) AS hi, any_value(summary) AS summary, coalesce(string_agg(th.think, ' ' ORDER BY th.c, th.think), '') AS source, count(th.c) AS n FROM cp LEFT JOIN th ON th.video_id = cp.video_id AND th.trajectory_id = cp.trajectory_id AND th.c >= lo AND th.c <= hi GROUP BY cp.sample_id, cp.c, lo, hi)"""


def _compressed(s: SparkSession, d: str) -> DataFrame:
    rows, by = conversation_rows(s, d), ["video_id", "trajectory_id"]
    summary = F.get_json_object("call", "$.arguments.text")
    lo, hi = (F.regexp_extract("q", _RANGE, i).try_cast("int").alias(n) for i, n in ((1, "lo"), (2, "hi")))
    cp = rows.where((F.col("kind") == "compress") & F.col("q").rlike(_RANGE)).select("sample_id", *by, F.col("c").alias("at"), "think", lo, hi, summary.alias("summary"))
    thinks = rows.where(F.trim("think") != "").groupBy(*by, "c").agg(F.max(F.trim("think")).alias("t"))
    return verify.with_sources(cp, thinks, by)


@query(f"WITH {COMPRESSED} SELECT sample_id, c AS chunk, n::BIGINT AS n_thinks, length(source) AS source_letters, length(trim(coalesce(summary, ''))) AS summary_letters FROM so")
def compress_sources(s, d):
    return _compressed(s, d).select("sample_id", F.col("at").alias("chunk"), F.col("n").alias("n_thinks"), F.length("source").alias("source_letters"), F.length(F.trim(F.coalesce("summary", F.lit("")))).alias("summary_letters"))


_ITEMS = r"list_distinct(list_concat(list_transform(list_filter(regexp_extract_all(source, '\b([A-Z][a-zA-Z0-9_]{2,})\b', 1), lambda w: w <> upper(w)), lambda w: lower(w)), regexp_extract_all(source, '\b(\d+\.?\d*)\b', 1)))"


@query(f"""WITH {COMPRESSED}, k AS (SELECT sample_id, c, summary, {_ITEMS} AS items FROM so WHERE summary <> ''), r AS (SELECT sample_id, c, len(items) AS n, len(list_filter(items, lambda w: contains(lower(summary), w)))::DOUBLE / len(items) AS share FROM k WHERE len(items) > 0)
SELECT sample_id, c AS chunk, n::INT AS n_items, round(share, 6) AS share, share < CASE WHEN n <= 3 THEN 0.34 WHEN n <= 8 THEN 0.5 WHEN n <= 15 THEN 0.45 ELSE 0.4 END AS too_low FROM r""")
def summary_retention(s, d):
    rows = _compressed(s, d).where("summary != ''")
    n = F.size(verify.key_items(F.col("source")))
    share = verify.retained_share(F.col("summary"), F.col("source"))
    return rows.where(n > 0).select("sample_id", F.col("at").alias("chunk"), n.alias("n_items"), r6(share).alias("share"), verify.retention(F.col("summary"), F.col("source")).isNotNull().alias("too_low"))


_NAMES = r"list_filter(regexp_extract_all(summary, '\b([a-zA-Z0-9_]+)\b', 1), lambda w: length(w) > 2 AND regexp_matches(w, '^[A-Z]|_'))"


@query(f"""WITH {COMPRESSED}, k AS (SELECT sample_id, c, {_NAMES} AS said, regexp_extract_all(lower(source), '\\b([a-zA-Z0-9_]+)\\b', 1) AS known FROM so WHERE summary <> '')
SELECT sample_id, c AS chunk, len(said)::INT AS n_names, len(list_filter(said, lambda w: NOT list_contains(known, lower(w))))::INT AS n_unsupported, coalesce(len(known) > 0 AND len(list_filter(said, lambda w: NOT list_contains(known, lower(w))))::DOUBLE / nullif(len(said), 0) > 0.3, false) AS violated FROM k""")
def summary_provenance(s, d):
    rows = _compressed(s, d).where("summary != ''")
    said = verify.names(F.col("summary"))
    known = F.regexp_extract_all(F.lower("source"), F.lit(r"\b([a-zA-Z0-9_]+)\b"), 1)
    strange = F.size(F.filter(said, lambda w: ~F.array_contains(known, F.lower(w))))
    return rows.select("sample_id", F.col("at").alias("chunk"), F.size(said).alias("n_names"), strange.alias("n_unsupported"), verify.provenance(F.col("summary"), F.col("source"), F.lit(False)).isNotNull().alias("violated"))


@query(f"""WITH {COMPRESSED}, x AS (SELECT length(source) AS l, length(trim(coalesce(summary, ''))) AS n FROM so WHERE n > 0), y AS (SELECT CASE WHEN n = 0 THEN 'empty_summary' WHEN l::DOUBLE / n < 2.5 THEN 'ratio' ELSE 'ok' END AS verdict, CASE WHEN n > 0 THEN l::DOUBLE / n END AS ratio FROM x)
SELECT verdict, count(*)::BIGINT AS n, round(min(ratio), 6) AS least, round(max(ratio), 6) AS most, round(avg(ratio), 6) AS mean FROM y GROUP BY 1""")
def compression_ratios(s, d):
    rows = _compressed(s, d).where("n > 0").withColumn("m", F.length(F.trim(F.coalesce("summary", F.lit("")))))
    ratio = F.try_divide(F.length("source"), F.col("m"))
    v = F.coalesce(verify.ratio(F.col("summary"), F.length("source")), F.lit("ok"))
    return rows.groupBy(v.alias("verdict")).agg(F.count("*").alias("n"), r6(F.min(ratio)).alias("least"), r6(F.max(ratio)).alias("most"), r6(F.avg(ratio)).alias("mean"))


@query(f"""WITH {CV} SELECT CASE WHEN regexp_matches(output, '(?s)<answer>.*?</answer>') AND regexp_matches(output, '(?s)<tool_call>.*?</tool_call>') THEN 'both' WHEN regexp_matches(output, '(?s)<answer>.*?</answer>') THEN 'answer' WHEN regexp_matches(output, '(?s)<tool_call>.*?</tool_call>') THEN 'tool_call' ELSE 'none' END AS terminal,
kind, count(*)::BIGINT AS n FROM cv GROUP BY 1, 2""")
def turn_terminals(s, d):
    return conversation_rows(s, d).groupBy(protocol.terminal(F.col("output")).alias("terminal"), "kind").agg(F.count("*").alias("n"))


@query(f"""WITH {CV} SELECT sample_id, c AS chunk, md5('<think>' || trim(coalesce(think, '')) || '</think>' || CASE WHEN trim(call) <> '' THEN '<tool_call>' || trim(call) || '</tool_call>' ELSE '<answer>' || coalesce(a, '') || '</answer>' END) AS turn FROM cv""")
def rebuilt_turns(s, d):
    turn = protocol.assistant_turn(F.col("think"), F.col("a"), F.col("call"))
    return conversation_rows(s, d).select("sample_id", F.col("c").alias("chunk"), F.md5(turn).alias("turn"))


@query("""WITH e AS (SELECT DISTINCT lower(trim(unnest(visible_entities).act)) AS act FROM chunk_evidence), h AS (SELECT act, regexp_extract(act, '^([a-z]+)', 1) AS head FROM e WHERE act <> ''),
c AS (SELECT act, head, CASE WHEN head LIKE '%ing' AND length(head) > 5 THEN left(head, -3) WHEN head LIKE '%ed' AND length(head) > 4 THEN left(head, -2) END AS cut FROM h)
SELECT act, CASE WHEN head = '' THEN act WHEN cut IS NOT NULL THEN CASE WHEN right(cut, 1) = left(right(cut, 2), 1) AND length(cut) > 1 AND right(cut, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN left(cut, -1) ELSE cut END WHEN head LIKE '%s' AND length(head) > 3 THEN left(head, -1) ELSE head END AS stem FROM c""")
def action_stems(s, d):
    acts = t(s, d, "chunk_evidence", "visible_entities").select(F.explode("visible_entities.act").alias("act")).select(F.lower(F.trim("act")).alias("act")).where("act != ''").distinct()
    return acts.select("act", protocol.stem(F.col("act")).alias("stem"))


@query()
def json_rescue_modes(s, d):
    raw = t(s, d, "chunk_evidence", "_raw").where(r"_raw rlike '^\\s*(```|\\{|\\[)'").withColumn("j", protocol.robust_json(F.col("_raw")))
    return raw.groupBy("j.mode").agg(F.count("*").alias("n"), F.sum(F.length("j.json")).alias("letters"))


@query("""SELECT video_id, chunk_idx, attempt, coalesce(len(visible_entities) > 0, false) OR coalesce(len(list_filter(atomic_facts, lambda f: f.confidence >= 0.7)) > 0, false) OR coalesce(len(state_changes) > 0, false) OR coalesce(len(ocr) > 0, false) OR coalesce(trim(spatial), '') <> '' AS usable,
coalesce(len(list_filter(atomic_facts, lambda f: f.confidence >= 0.7)), 0)::INT AS n_sure FROM (SELECT DISTINCT video_id, chunk_idx, attempt, visible_entities, atomic_facts, state_changes, ocr, spatial FROM chunk_evidence)""")
def usable_evidence(s, d):
    e = t(s, d, "chunk_evidence", "video_id", "chunk_idx", "attempt", "visible_entities", "atomic_facts", "state_changes", "ocr", "spatial").distinct()
    sure = F.coalesce(F.size(F.filter("atomic_facts", lambda f: f["confidence"] >= 0.7)), F.lit(0))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    usable = some("visible_entities") | (sure > 0) | some("state_changes") | some("ocr") | (F.coalesce(F.trim("spatial"), F.lit("")) != "")
    return e.select("video_id", "chunk_idx", "attempt", usable.alias("usable"), sure.alias("n_sure"))


@query("""SELECT sample_id, msg_idx, CASE WHEN content LIKE '%<visual_window>%' THEN -1 ELSE 1 END * len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> ''))::INT AS length FROM (SELECT DISTINCT sample_id, msg_idx, content FROM messages WHERE content IS NOT NULL)""")
def modality_lengths(s, d):
    m = t(s, d, "messages", "sample_id", "msg_idx", "content").where("content is not null").distinct()
    return m.select("sample_id", "msg_idx", text.signed_length(F.col("content"), F.col("content").contains("<visual_window>")).alias("length"))


@query("""SELECT sample_id, msg_idx, len(regexp_extract_all(content, '(?s)<tool_call>.*?</tool_call>'))::INT AS n_calls, len(list_filter(regexp_extract_all(content, '(?s)<tool_call>(.*?)</tool_call>', 1), lambda x: contains(x, '"recall"')))::INT AS n_recalls FROM (SELECT DISTINCT sample_id, msg_idx, content FROM messages WHERE content LIKE '%<tool_call>%')""")
def tool_call_counts(s, d):
    m = t(s, d, "messages", "sample_id", "msg_idx", "content").where("content like '%<tool_call>%'").distinct()
    calls = F.regexp_extract_all("content", F.lit("(?s)<tool_call>(.*?)</tool_call>"), 1)
    return m.select("sample_id", "msg_idx", F.size(calls).alias("n_calls"), F.size(F.filter(calls, lambda x: F.contains(x, F.lit('"recall"')))).alias("n_recalls"))
