"""Named queries of this package, each over its whole tables, and SQL that DuckDB can run to the same result."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heddle.llm import abuse, conversations, group_split, leakage, packing, pair_defects, quota_sample, truncation
from heddle.session import table


def default_vocabulary() -> str:
    """The vocabulary file used by the queries; operators take its path as a parameter."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return f"{folder}/byte_bpe_multi_50k.tiktoken"


def _fork(f: Callable) -> Callable:
    return lambda s, d: f(*(table(s, d, n) for n in ("fork_samples", "draw_plans", "draw_targets")))


def _pack(s: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(s, d, "documents"), table(s, d, "pack_limits"), default_vocabulary())


def _parts(s: SparkSession, d: str) -> DataFrame:
    table(s, d, "fork_samples", "sample_id")  # gives the package to the executors
    return conversations.closed_parts(s, f"{d}/fork_samples.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    t = table
    return {
        "p1_found": _fork(quota_sample.unmet_targets),
        "p1_sample": _fork(lambda *x: quota_sample.sample_by_targets(*x)[0]),
        "p1_report": _fork(lambda *x: quota_sample.sample_by_targets(*x)[1]),
        "p2_found": lambda s, d: conversations.left_out(_parts(s, d)),
        "p2_conversations": lambda s, d: conversations.rebuild(_parts(s, d)).where("reason is null").drop("reason"),
        "p2_turns": lambda s, d: conversations.turn_counts(_parts(s, d)),
        "p3_found": lambda s, d: truncation.truncated_replies(t(s, d, "chunk_evidence"), t(s, d, "video_registry")),
        "p3_rates": lambda s, d: truncation.truncation_rates(t(s, d, "chunk_evidence"), t(s, d, "video_registry")),
        "p3_limits": lambda s, d: truncation.judge(t(s, d, "chunk_evidence"), t(s, d, "video_registry"))[1],
        "p4_found": lambda s, d: group_split.related_pairs(t(s, d, "video_registry")),
        "p4_splits": lambda s, d: group_split.assign_splits(t(s, d, "video_registry"), t(s, d, "split_targets")),
        "p4_report": lambda s, d: group_split.split_report(group_split.assign_splits(t(s, d, "video_registry"), t(s, d, "split_targets")), t(s, d, "split_targets")),
        "p4_reached": lambda s, d: group_split.reached(group_split.assign_splits(t(s, d, "video_registry"), t(s, d, "split_targets")), t(s, d, "split_targets")),
        "p5_found": lambda s, d: pair_defects.defective_pairs(t(s, d, "messages")),
        "p6_pack": _pack,
        "p6_fill": lambda s, d: packing.fill_report(_pack(s, d), t(s, d, "pack_limits")),
        "p6_audit": lambda s, d: packing.audit(_pack(s, d), t(s, d, "pack_limits")),
        "p7_found": lambda s, d: leakage.leaked_pairs(t(s, d, "documents"), t(s, d, "eval_items")),
        "p7_items": lambda s, d: leakage.leaked_items(t(s, d, "documents"), t(s, d, "eval_items")),
        "p8_found": lambda s, d: abuse.abusive_documents(t(s, d, "documents"), t(s, d, "review_labels")),
        "p8_scores": lambda s, d: abuse.score_documents(t(s, d, "documents"), t(s, d, "review_labels")),
        "p8_rates": lambda s, d: abuse.abuse_rates(t(s, d, "documents"), t(s, d, "review_labels")),
    }


_CLEAN = r"regexp_replace(regexp_replace(lower(sample_type), '^\s+|\s+$', '', 'g'), '[\s_\-]+', '_', 'g')"
_TYPES = "('silent', 'response', 'recall_query', 'recall_response', 'recall_silent', 'compress')"

P1 = rf"""
WITH latest AS (
  SELECT sample_id, {_CLEAN} AS t FROM fork_samples WHERE sample_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY logged_at DESC, sample_type DESC) = 1),
usable AS (SELECT t, count(*) AS c FROM latest WHERE t IN {_TYPES} GROUP BY t),
drawn AS (SELECT plan_id, (draw_pct * (SELECT sum(c) FROM usable)) // 100 AS n FROM draw_plans)
SELECT g.plan_id, g.sample_type FROM draw_targets g JOIN drawn USING (plan_id) LEFT JOIN usable u ON u.t = g.sample_type
WHERE greatest(g.min_rows, (g.target_pct * n + 99) // 100) > coalesce(u.c, 0)
"""

_P2 = rf"""
WITH raw AS (
  SELECT sample_id, video_id, trajectory_id, card_id, chunk_idx, logged_at, output, recall_result, {_CLEAN} AS t, user_input
  FROM fork_samples WHERE trajectory_id <> '' AND card_id <> '' AND video_id IS NOT NULL),
v AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY logged_at DESC, output DESC) = 1),
r AS (SELECT *, t IN {_TYPES} AS usable,
    CASE WHEN t IS DISTINCT FROM 'compress' AND regexp_replace(user_input, '\s+', '', 'g') <> '' THEN 1 END AS q,
    CASE WHEN t IN ('response', 'recall_response')
      AND regexp_replace(regexp_extract(output, '(?s)<answer>(.*?)</answer>', 1), '\s+', '', 'g') <> '' THEN 1 END AS a FROM v),
k AS (SELECT video_id, trajectory_id, card_id, bool_or(chunk_idx IS NULL OR usable IS NOT TRUE) AS broken,
    min(CASE WHEN q = 1 THEN chunk_idx END) AS q, max(CASE WHEN a = 1 THEN chunk_idx END) AS a FROM r GROUP BY ALL),
o AS (SELECT DISTINCT video_id, trajectory_id, card_id FROM (
    SELECT video_id, trajectory_id, card_id, chunk_idx FROM r GROUP BY ALL
    HAVING bool_or(t = 'recall_query') AND NOT coalesce(bool_or(t IN ('recall_response', 'recall_silent')), false)))
"""

_OUT = "(k.broken OR k.q IS NULL OR k.a IS NULL OR k.a < k.q OR o.video_id IS NOT NULL)"

P2 = rf"""{_P2}
SELECT k.video_id, k.trajectory_id, k.card_id FROM k LEFT JOIN o USING (video_id, trajectory_id, card_id) WHERE {_OUT}
"""

P2_TURNS = rf"""{_P2},
sound AS (SELECT k.video_id, k.trajectory_id, k.card_id FROM k LEFT JOIN o USING (video_id, trajectory_id, card_id) WHERE NOT coalesce({_OUT}, true)),
said AS (SELECT video_id, trajectory_id, card_id, chunk_idx, coalesce(q, 0) AS u,
    CASE WHEN regexp_replace(recall_result, '\s+', '', 'g') <> '' THEN 1 ELSE 0 END AS tool,
    CASE WHEN regexp_replace(output, '\s+', '', 'g') <> '' THEN 1 ELSE 0 END AS said FROM r JOIN sound USING (video_id, trajectory_id, card_id))
SELECT video_id, trajectory_id, card_id, sum(u)::BIGINT AS n_user, sum(tool)::BIGINT AS n_tool, sum(said)::BIGINT AS n_assistant,
  min(chunk_idx) AS first_chunk, max(chunk_idx) AS last_chunk
FROM said WHERE u + tool + said > 0 GROUP BY ALL
"""

P4 = r"""
WITH RECURSIVE r AS (
  SELECT reg_id, trim(video_id) AS v,
    regexp_extract(replace(video_path, '\', '/'), '([^/]+)/+[^/]*$', 1) AS folder, lower(trim(dataset)) AS d,
    regexp_replace(lower(regexp_replace(uploader, '\s+', '', 'g')), '^@+', '') AS u
  FROM video_registry WHERE reg_id IS NOT NULL),
k AS (
  SELECT reg_id, CASE WHEN u NOT IN ('', '-', '--', '?', 'n/a', 'na', 'none', 'null', 'unknown', 'nan', 'anonymous') THEN 'u|' || u END AS u,
    CASE WHEN regexp_extract(v, '^(\d{7})(?:[_\-]?p\d+)?(?:\.[A-Za-z0-9]{2,4})?$', 1) <> ''
      THEN 'n|' || coalesce(CASE WHEN d NOT IN ('', '-', 'n/a', 'na', 'none', 'null', 'unknown', 'nan', '?') THEN d END, lower(folder), '')
        || '|' || regexp_extract(v, '^(\d{7})(?:[_\-]?p\d+)?(?:\.[A-Za-z0-9]{2,4})?$', 1)
    WHEN regexp_full_match(v, '(?:ytb_|v_)?([A-Za-z0-9_\-]{11})(?:_clip\d+|_\d+_\d+)?(?:\.[A-Za-z0-9]{2,4})?')
      THEN 'v|' || regexp_extract(v, '^(?:ytb_|v_)?([A-Za-z0-9_\-]{11})(?:_clip\d+|_\d+_\d+)?(?:\.[A-Za-z0-9]{2,4})?$', 1)
    ELSE 'r|' || reg_id END AS s FROM r),
e AS (SELECT reg_id, s AS key FROM k UNION ALL SELECT reg_id, u FROM k WHERE u IS NOT NULL),
near AS (SELECT DISTINCT a.reg_id AS a, b.reg_id AS b FROM e a JOIN e b USING (key)),
reach(a, b) AS (SELECT a, b FROM near UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b)
SELECT min(b) AS group_reg_id, a AS reg_id FROM reach GROUP BY a HAVING min(b) <> a
"""


#: What balanced splits must show: every target met to the percent, no group in two splits, every row in one.
P4_REACHED = """
SELECT split_name, target_pct, target_pct AS reached_pct, 0 AS n_torn, (SELECT count(*) FROM video_registry WHERE reg_id IS NOT NULL) AS n_all FROM split_targets
"""

#: What a packing must show: all documents with tokens placed whole or cut where they must be, no container over its capacity.
P6_AUDIT = """
SELECT (SELECT count(*) FROM documents WHERE text <> '' AND doc_id IS NOT NULL) AS n_documents, 0 AS n_overfull, 0 AS n_needless_cuts, 0 AS n_gaps
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1, "p2_found": P2, "p2_turns": P2_TURNS, "p4_found": P4, "p4_reached": P4_REACHED, "p6_audit": P6_AUDIT}
