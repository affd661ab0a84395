"""Problems 1 to 8 on small tables: brute force, nulls, ties, repeats, empty tables and extra columns."""

import contextlib
import datetime as dt
import os
import random
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heddle.llm import abuse, conversations, group_split, leakage, packing, pair_defects, quota_sample, truncation
from heddle.llm.queries import default_vocabulary
from heddle.session import shared_dir

NOW = dt.datetime(2024, 5, 1)
SAMPLES = "sample_id long, video_id string, trajectory_id string, card_id string, chunk_idx int, sample_type string, user_input string, output string, recall_result string, logged_at timestamp_ntz, key string"


def sample(i, chunk=0, kind="silent", q=None, out=None, at=0, card="c", video="v"):
    return (i, video, "t", card, chunk, kind, q, out, None, NOW + dt.timedelta(seconds=at), "clash")


# 1


def plans(spark):
    return spark.createDataFrame([(1, 50)], "plan_id int, draw_pct int"), spark.createDataFrame([(1, "silent", 60, 0), (1, "response", 40, 3), (1, "clarify", 1, 2)], "plan_id int, sample_type string, target_pct int, min_rows int")


def test_quota_sample(spark):
    rows = [sample(i, kind=" Silent") for i in range(90)] + [sample(100 + i, kind="RESPONSE") for i in range(10)] + [sample(5, kind="silent"), sample(None), sample(200, kind=None), sample(201, kind="tbd")]
    p, t = plans(spark)
    drawn, report = quota_sample.sample_by_targets(spark.createDataFrame(rows, SAMPLES), p, t)
    got = {r.sample_type: (r.draw_rows, r.asked, r.available, r.short_by) for r in report.collect()}
    assert got == {"silent": (50, 30, 90, 0), "response": (50, 20, 10, 10), "clarify": (50, 2, 0, 2)}
    counts = {r.sample_type: r["count"] for r in drawn.groupBy("sample_type").count().collect()}
    quotas = {r.sample_type: r.quota for r in report.collect() if r.quota}
    assert counts == quotas and drawn.count() == drawn.select("plan_id", "sample_id").distinct().count()
    keys = {i: k for i, k in spark.createDataFrame([(i,) for i in range(90)], "i long").select("i", quota_sample.random_key(42, F.col("i"))).collect()}
    assert {r.sample_id for r in drawn.where("sample_type = 'silent'").collect()} == set(sorted(keys, key=keys.get)[: quotas["silent"]])


def test_quotas_report_overdraw_and_repeats():
    rows = quota_sample.allocate({"a": 50, "b": 50}, [(1, 10)], [(1, "a", 50, 8), (1, "b", 50, 8), (1, "b", 40, 2), (9, "a", 1, 1)])
    got = {(r[0], r[1]): r[5:] for r in rows}
    assert got == {(1, "a"): (8, 0, 0, 6), (1, "b"): (8, 0, 0, 6), (9, "a"): (None,) * 4}


def test_quota_sample_empty(spark):
    p, t = plans(spark)
    drawn, report = quota_sample.sample_by_targets(spark.createDataFrame([], SAMPLES), p, t)
    assert drawn.count() == 0 and {r.sample_type: r.short_by for r in report.collect()} == {"silent": 0, "response": 3, "clarify": 2}


def test_largest_remainder_bounds():
    rng = random.Random(1)
    for _ in range(200):
        k = [f"k{i}" for i in range(rng.randint(1, 6))]
        caps = {x: rng.randint(0, 30) for x in k}
        q = quota_sample.largest_remainder(rng.randint(0, 60), {x: rng.randint(1, 9) for x in k}, {x: rng.randint(0, 5) for x in k}, caps)
        assert all(0 <= q[x] <= caps[x] for x in k)


# 2


def test_conversations(spark, tmp_path):
    yes = "<think>x</think><answer>yes</answer>"
    rows = [
        *[sample(1, 3, "silent", "Q?", "", card="ok"), sample(2, 5, "Response", None, yes, at=-99, card="ok"), sample(2, 5, "response", None, yes, at=-99, card="ok")],
        *[sample(3, 3, "response", "Q?", "<answer> </answer>", at=0, card="late"), sample(3, 3, "response", "Q?", yes, at=200_000, card="late")],
        *[sample(4, 3, "response", "Q?", yes, card="lost"), sample(4, 3, "response", "Q?", "", at=90, card="lost")],
        *[sample(5, 9, "silent", "Q?", "", card="early"), sample(6, 1, "response", None, yes, card="early")],
        *[sample(7, None, "response", "Q?", yes, card="nochunk"), sample(8, 1, "tbd", "Q?", yes, card="notype"), sample(8, 1, "response", "Q?", yes, at=-5, card="notype")],
        *[sample(9, 1, "response", "  ", yes, card="noq"), sample(10, 1, "compress", "<t/>", yes, card="trig")],
        *[sample(11, 1, "recall_query", "Q?", None, card="open"), sample(12, 200, "recall_response", None, yes, card="open")],
        *[sample(13, 1, "recall-query", "Q?", None, card="shut"), sample(14, 1, "recall silent", None, "", card="shut"), sample(15, 300, "recall_response", None, yes, card="shut")],
        *[sample(20, 2, "response", "Q?", yes, card="far"), sample(20, 300, "response", "Q?", "", at=9, card="far")],  # the newer version is in another block
        *[sample(21, 2, "response", "Q?", yes, card="undated"), (*sample(22, None, card="undated")[:9], None, "clash")],
        *[sample(23, 2, "response", "Q?", yes, card="twice"), sample(24, 2, "silent", "Q?", yes, card="twice"), sample(24, 900, "silent", "Q?", yes, at=1, card="twice")],
        sample(16, 1, "response", "Q?", yes, card=""),
        sample(17, 1, "response", "Q?", yes, card=None),
    ]
    path = str(tmp_path / "s.parquet")
    spark.createDataFrame(rows, SAMPLES).repartition(3).write.parquet(path)
    found = conversations.closed_parts(spark, path)
    out = conversations.rebuild(found)
    assert {r.card_id: r.reason for r in out.select("card_id", "reason").distinct().collect()} == {"ok": None, "late": None, "lost": "unanswered", "early": "unanswered", "nochunk": "broken", "notype": "broken", "noq": "empty", "trig": "empty", "open": "open_recall", "shut": None, "far": "unanswered", "undated": "broken", "twice": None}
    turns = out.where("card_id = 'ok'").first().turns
    assert [(t.chunk_idx, t.role) for t in turns] == [(3, "user"), (5, "assistant")]
    assert conversations.left_out(found).count() == 9 and out.count() == len(set(KEYS(out)))


def KEYS(df):
    return [tuple(r) for r in df.select(*conversations.KEY).collect()]


def test_live_conversations_and_late_rows(spark, tmp_path):
    """Sessions close on their own; a row and a version that come after closing are reconciled."""
    yes, day, path = "<answer>yes</answer>", 86_400, str(tmp_path / "s.parquet")
    batches = [
        [sample(1, 1, "response", "Q?", yes, card="a"), sample(2, 1, "silent", "Q?", "", card="b"), sample(6, 70, "recall_query", None, None, card="a")],
        [sample(3, 1, "response", "Q?", yes, at=30 * day, card="c")],
        [sample(4, 2, "response", None, yes, at=60, card="b"), sample(1, 1, "response", "Q?", "", at=120, card="a"), sample(7, 70, "recall_silent", None, None, at=9, card="a"), sample(5, 1, "silent", "Q?", "", at=60 * day, card="c")],
    ]
    stream = conversations.ConversationStream(spark, "1 hour", "2 hours")
    for rows in batches:
        spark.createDataFrame(rows, SAMPLES).coalesce(1).write.mode("append").parquet(path)
        stream.run(path, files_per_batch=1)
    closed = stream.parts()
    assert {k[2] for k in KEYS(closed)} >= {"a", "b"}  # before the input ends
    stream.run(path, closed=True)
    reason = lambda found: {r.card_id: r.reason for r in conversations.verdicts(found).collect()}
    assert reason(stream.parts()) == {"a": "open_recall", "b": "unanswered", "c": None}
    late = stream.late_rows(path)
    assert late.count() == 3
    assert reason(conversations.reconcile(stream.parts(), late)) == {"a": "unanswered", "b": None, "c": None}


def test_long_conversations_continue_in_numbered_rows(spark, tmp_path):
    path = str(tmp_path / "l.parquet")
    spark.createDataFrame([sample(i, i, "response", "Q?", "<answer>a</answer>") for i in range(300)], SAMPLES).write.parquet(path)
    found = conversations.closed_parts(spark, path)
    rows = sorted(conversations.rebuild(found, most_rows=100).collect(), key=lambda r: r.part_no)
    assert len(rows) > 1 and [t.chunk_idx for r in rows for t in r.turns] == sorted(t for t in range(300) for _ in (0, 1))
    assert conversations.rebuild(found).count() == 1


def test_no_conversations(spark, tmp_path):
    path = str(tmp_path / "e.parquet")
    spark.createDataFrame([], SAMPLES).coalesce(1).write.parquet(path)
    assert conversations.rebuild(conversations.closed_parts(spark, path)).count() == 0


def test_replay_keeps_little_on_disk(spark, tmp_path):
    """State and parts at their peak, shuffles aside; afterwards only the parts are left."""
    rng, path, folder = random.Random(3), str(tmp_path / "s.parquet"), f"{shared_dir(spark)}/heddle".removeprefix("file:")
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(300)]
    said = lambda: f"<answer>{' '.join(rng.choices(words, k=9))}</answer>"
    rows = [sample(i, i % 40, "response", "Q?", said(), at=rng.randint(0, 9_000_000), card=f"c{i % 997}") for i in range(60_000)]
    spark.createDataFrame(rows, SAMPLES).coalesce(3).write.parquet(path)
    size = lambda at, part="": sum(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(at) if part in d for f in fs if os.path.exists(f"{d}/{f}"))
    before, peak, over = set(os.listdir(folder)) if os.path.exists(folder) else set(), [0], threading.Event()
    own = lambda: [f"{folder}/{x}" for x in (os.listdir(folder) if os.path.exists(folder) else []) if x not in before and x.startswith("conversations")]

    def watch():
        while not over.wait(0.02):
            with contextlib.suppress(OSError):
                peak[0] = max(peak[0], sum(map(size, own())))

    thread = threading.Thread(target=watch)
    thread.start()
    try:
        found = conversations.closed_parts(spark, path)
    finally:
        over.set()
        thread.join()
    assert found.selectExpr("sum(size(rows))").first()[0] == 60_000
    left = {k: sum(size(x, k) for x in own()) / size(path) for k in ("/state", "/parts")}
    assert (left["/state"], left["/parts"] < 1, peak[0] / size(path) < 2) == (0, True, True), (left, peak[0] / size(path))


def test_replay_takes_any_clock(spark, tmp_path):
    """One row logged in 9999 or before 1970 keeps no session open and loses none."""
    for year in (9999, 1801):
        path = str(tmp_path / f"{year}.parquet")
        odd = (*sample(3, 1, "response", "Q?", "<answer>yes</answer>", card="odd")[:9], dt.datetime(year, 12, 30), "clash")
        spark.createDataFrame([sample(1, 1, "silent", "Q?", "", card="usual"), odd], SAMPLES).write.parquet(path)
        got = conversations.verdicts(conversations.closed_parts(spark, path)).collect()
        assert {r.card_id: r.reason for r in got} == {"usual": "unanswered", "odd": None}


def test_mark_of_the_end_waits_for_all_batches(spark, tmp_path):
    path = str(tmp_path / "s.parquet")
    for i in range(4):
        spark.createDataFrame([sample(i, i, "silent" if i < 3 else "response", "Q?", "<answer>yes</answer>", at=9 * i)], SAMPLES).coalesce(1).write.mode("append").parquet(path)
    stream = conversations.ConversationStream(spark, "1 hour", "1 hour")
    stream.run(path, files_per_batch=1, closed=True)
    assert stream.parts().selectExpr("sum(size(rows))").first()[0] == 4 and stream.late_rows(path).count() == 0


# 3

EVIDENCE = "video_id string, chunk_idx int, attempt int, _raw string, source string, n int"


def test_truncation(spark):
    ends = ["Done!", "(rest unchanged)", "Overall: usable"]
    rng = random.Random(2)
    body = lambda: " ".join(rng.choice(["the cook", "folds a map", "near it", "lifts one", "then waits"]) for _ in range(rng.randint(20, 60))) + ". "
    rows = [("a", i, 0, body() + ends[i % 3], "x", 1) for i in range(200)]
    rows += [("a", 1000 + i, 0, (body() + body())[:240], "x", 1) for i in range(40)]
    cases = {1: '{"a": [1, 2], "b": "x"}', 2: '{"a": [1, 2], "b": "x', 3: "none", 4: None, 5: "  ", 6: body() + "the coo…", 7: body() + "the co</", 8: '```json\n{"a": 1}\n```', 9: '```json\n{"a": 1}\n', 10: "x" * 100_000 + " end."}
    rows += [("b", k, 1, v, "x", 1) for k, v in cases.items()] + [("b", 30 + i, 1, "none", "x", 1) for i in range(6)] + [("b", 2, 1, cases[2], "x", 1)]
    reg = spark.createDataFrame([("a", "Cook "), ("a", None)], "video_id string, dataset string")
    r, limits = truncation.judge(spark.createDataFrame(rows, EVIDENCE), reg)
    got = {(x.video_id, x.chunk_idx): x.truncated for x in r.collect()}
    assert {k for (v, k), t in got.items() if v == "b" and t} == {2, 6, 7, 9}
    assert sum(t for (v, k), t in got.items() if k >= 1000) >= 38 and not any(t for (v, k), t in got.items() if v == "a" and k < 1000)
    top = max(limits.collect(), key=lambda x: x["count"])
    assert (top.source, top.n) == ("cook", 240) and top.posterior > 0.9
    empty = spark.createDataFrame([], EVIDENCE)
    assert truncation.truncated_replies(empty, reg).count() == 0


def test_posterior_decides_where_the_ending_shows_nothing(spark):
    rng = random.Random(7)
    body = lambda k: " ".join(rng.choice(["the cook", "folds a map", "near it", "lifts one", "then waits"]) for _ in range(k))
    rows = [("a", i, 0, body(rng.randint(20, 60)) + ". Done!", "x", 1) for i in range(300)]
    rows += [("a", 1000 + i, 0, body(60)[:240], "x", 1) for i in range(60)]
    for k, end in enumerate([" the map (left)", " fig.", " about 3.", " is over."]):
        rows += [("a", 2000 + 2 * k + j, 0, body(60)[: n - len(end)] + end, "x", 1) for j, n in enumerate((240, 777))]
    reg = spark.createDataFrame([("a", "cook")], "video_id string, dataset string")
    got = {r.chunk_idx: (r.posterior > 0.9, r.truncated) for r in truncation.judge(spark.createDataFrame(rows, EVIDENCE), reg)[0].where("chunk_idx >= 2000").collect()}
    assert got == {2000 + 2 * k + j: (j == 0, j == 0 and k < 3) for k in range(4) for j in (0, 1)}


def test_fit_decides_beside_the_ending(spark):
    """Notes end without a mark in one source and replies are cut at 240 in the other: lengths alone tell the two apart."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("bdglmnprstvaeiou") for _ in range(rng.randint(2, 8)))
    text = lambda k: "The " + " ".join(word() for _ in range(k))
    rows = [("a", i, 0, text(rng.randint(20, 60)) + ".", "x", 1) for i in range(400)] + [("a", 1000 + i, 0, text(90)[:239] + "k", "x", 1) for i in range(120)]
    rows += [("b", 3000 + i, 0, text(rng.randint(10, 70)), "x", 1) for i in range(500)]  # whole, though without a mark
    reg = spark.createDataFrame([("a", "cook"), ("b", "notes")], "video_id string, dataset string")
    found = {}
    for fitted in (True, False):
        r = truncation.judge(spark.createDataFrame(rows, EVIDENCE), reg, fitted=fitted)[0].where("truncated").collect()
        found[fitted] = ({x.chunk_idx for x in r if x.video_id == "a"}, sum(x.video_id == "b" for x in r))
    assert found[True][0] == set(range(1000, 1120)) and found[True][1] <= 25
    with_fit, without = (len(a) / max(1, len(a) + b) * (len(a & set(range(1000, 1120))) / 120) for a, b in (found[True], found[False]))
    assert with_fit > 0.8 and without < 0.5  # precision times recall


def test_long_endings_are_told_apart(spark):
    line = "and the host then shows the following items one after another " * 4
    rows = [("a", i, 0, f"It is dark. {line}{'x' * (i % 37)}k{chr(97 + i % 26)}{chr(97 + i // 26)}q", "x", 1) for i in range(60)] + [("a", 100 + i, 0, f"Seen {i} times. It is over.", "x", 1) for i in range(60)]
    rows += [("a", 200 + i, 0, f"Chunk {chr(97 + i)}. {line}", "x", 1) for i in range(9)]
    got = {r.chunk_idx for r in truncation.truncated_replies(spark.createDataFrame(rows, EVIDENCE), spark.createDataFrame([("a", "cook")], "video_id string, dataset string")).collect()}
    assert got == set(range(60))  # the same whole line nine times is usual


def test_censored_fit_recovers_the_distribution():
    x = np.round(np.exp(np.random.default_rng(3).normal(5, 0.5, 50_000)))
    cut = x > 200
    n, c = np.unique(np.minimum(x, 200), return_counts=True)
    mu, sigma = truncation.fit_censored(n, c.astype(float), np.where(n == 200, cut.sum(), 0.0))
    assert abs(mu - 5) < 0.05 and abs(sigma - 0.5) < 0.05


# 4

REGISTRY = "reg_id long, video_id string, video_path string, duration_sec double, dataset string, uploader string, label string"


def registry(spark):
    a, b, c = "abcdefghij1", "ABCDEFGHIJ1", "v_cdefghij1"
    rows = [(1, a, "", None, "x", None, ""), (2, f"ytb_{a}", "", 0.0, None, "@Bob", ""), (3, b, "", 1.0, "x", " bob ", ""), (4, f"{c}_clip01", "", 1.0, "x", "unknown", ""), (5, f"v_{c}", "", 1.0, "x", "-", "")]
    rows += [(6, "0000001", "/d/ego/0000001.mp4", 1.0, "ego", None, ""), (7, "0000001_p2", "", 1.0, "lab", None, ""), (8, "0000001p3", "\\d\\ego\\0000001p3.mp4", 1.0, None, None, ""), (9, None, None, None, None, None, ""), (10, None, None, None, None, "N/A", "")]
    return spark.createDataFrame(rows, REGISTRY)


def test_groups_and_splits(spark):
    assert {tuple(r) for r in group_split.related_pairs(registry(spark)).collect()} == {(1, 2), (1, 3), (4, 5), (6, 8)}
    targets = spark.createDataFrame([("train", 80), ("test", 20)], "split_name string, target_pct int")
    out = group_split.assign_splits(registry(spark), targets, bins=5, block=3).collect()
    assert len(out) == 10 and len({(r.group_reg_id, r.split_name) for r in out}) == len({r.group_reg_id for r in out})
    assert group_split.assign_splits(spark.createDataFrame([], REGISTRY), targets).count() == 0


def test_components_against_brute_force(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in group_split.star_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_blocks_are_combined_in_levels(spark):
    rng = random.Random(14)
    rows = [(i, f"{i:011d}".replace("0", "a"), "", 1.0, "x", f"u{rng.randrange(60)}" if i % 3 else None, "") for i in range(400)]
    targets = spark.createDataFrame([("train", 70), ("test", 30)], "split_name string, target_pct int")
    splits = group_split.assign_splits(spark.createDataFrame(rows, REGISTRY).repartition(6), targets, bins=20, block=5, fan=2)
    got = {r.split_name: r for r in group_split.reached(splits, targets).collect()}
    assert abs(got["train"].reached_pct - 70) <= 2 and all(r.n_torn == 0 and r.n_all == 400 for r in got.values())


def test_differencing_balances():
    rng = np.random.default_rng(5)
    w = rng.integers(1, 50, 500)
    total, members = group_split.combine([(np.concatenate([[x], np.zeros(9, dtype=np.int64)]), [[i], *[[]] * 9]) for i, x in enumerate(w)])
    assert sorted(i for m in members for i in m) == list(range(500)) and total.max() - total.min() <= 2
    assert all(total[k] == w[m].sum() for k, m in enumerate(members))


# 5


def test_pair_defects(spark):
    m = lambda s, i, role, c: (i, s, i, role, c, NOW, "clash")
    q = "What colour is the wooden crate near the door?"
    answers = {1: "", 2: "(no output)", 3: "I'm sorry, but I can't help with that request.", 4: q.upper(), 5: "What colour is the crate wooden near the door?", 6: "<think>No new evid", 7: "The crate that stands next to the old door loo", 8: "Die Kiste ist vor der Tür und hat die Farbe rot.", 9: "blue", 10: "The crate is blue.", 11: "The crate is bl", 12: None, 13: 'The sign says "sorry, we cannot serve you".', 14: "N/A"}
    rows = [x for s, a in answers.items() for x in (m(s, 0, "User ", q), m(s, 1, "GPT", a))]
    rows += [m(10, 1, "gpt", answers[10])] + [m(20, 0, "user", "Describe it. Answer in German."), m(20, 1, "assistant", "Die Kiste ist vor der Tür und hat die Farbe rot.")]
    rows += [m(21, 0, "user", q), m(21, 1, "assistant", "<tool_call>{}</tool_call>"), m(21, 2, "tool", "x"), m(21, 3, "assistant", "blue"), m(22, 0, "assistant", "Hello."), m(None, 0, "user", q), m(23, 0, None, None)]
    got = {(r.sample_id, r.msg_idx): r.defect for r in pair_defects.defective_pairs(spark.createDataFrame(rows, "message_id long, sample_id long, msg_idx int, role string, content string, logged_at timestamp_ntz, answer string")).collect()}
    want = {1: "empty", 2: "empty", 3: "refusal", 4: "copied", 5: "copied", 6: "truncated", 7: "truncated", 8: "language", 11: "truncated", 12: "empty", 14: "empty"}
    assert got == {(k, 1): v for k, v in want.items()}


def test_copies_are_compared_whole(spark):
    rng = random.Random(8)
    long = " ".join(rng.choice(["crate", "door", "lamp", "shelf", "bench"]) + str(rng.randint(1, 99)) for _ in range(90))
    mid = long[:360].rsplit(" ", 1)[0]
    said = {1: (long + "?", long.replace("crate", "box", 1) + "?"), 2: (mid + "?", mid.replace("door", "gate", 1) + " and this is the answer it asked for, said in many other words?"), 3: (mid + "?", mid.replace("door", "gate", 1) + "?"), 4: (long + "?", long[::-1] + "?")}
    rows = [(i, i, k, r, c, NOW) for i, qa in said.items() for k, (r, c) in enumerate(zip(("user", "gpt"), qa))]
    rows = spark.createDataFrame(rows, "message_id long, sample_id long, msg_idx int, role string, content string, logged_at timestamp_ntz")
    assert len(long) > 400 and 340 <= len(mid) <= 400
    assert {r.sample_id: r.defect for r in pair_defects.defective_pairs(rows).collect()} == {1: "copied", 3: "copied"}


def test_usual_is_a_share_of_the_answers(spark):
    short, k = "The crate is bl", F.col("id")
    for n, want in ((24_000, 6), (300, 0)):  # six of 24,000 are few, six of 300 are usual
        said = F.when(k < 6, short).when(k < 100, "The crate is blue.").otherwise("Yes, it is.")
        rows = spark.range(n).select(k.alias("sample_id"), F.posexplode(F.array(F.lit("What colour is the crate?"), said)).alias("msg_idx", "content"))
        rows = rows.withColumns({"role": F.when(F.col("msg_idx") == 0, "user").otherwise("gpt"), "logged_at": F.lit(NOW)})
        assert pair_defects.defective_pairs(rows).where("defect = 'truncated'").count() == want


def test_neighbours_find_short_cut_answers(spark):
    """Answers too short for the other rules, cut inside a word: only the sorted search tells them from whole ones."""
    whole = ["The wooden crate stands there.", "Near the yellow thermometer.", "She lifts the copper pipe."]
    said = [whole[i % 3] for i in range(60)] + ["The wooden cra", "Near the yellow therm", "on the top shelf", "by the copper"]
    rows = [x for i, a in enumerate(said) for x in ((i, 0, "user", "What is there in the picture now?"), (i, 1, "gpt", a))]
    table = spark.createDataFrame([(*x, NOW) for x in rows], "sample_id long, msg_idx int, role string, content string, logged_at timestamp_ntz")
    found = {n: {r.sample_id for r in pair_defects.flag_pairs(table, neighbours=n).where("defect = 'truncated'").collect()} for n in (True, False)}
    assert found == {True: {60, 61}, False: set()}


def test_shortened_against_brute_force(spark):
    rng = random.Random(6)
    texts = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(300)}
    got = {r.answer for r in pair_defects.shortened(spark.createDataFrame([(t,) for t in texts], "answer string").repartition(7)).collect()}
    assert got == {a for a in texts if any(b != a and b.startswith(a) for b in texts)}


# 6

DOCS = "doc_id long, text string, source string, n_tokens long, score double"


def test_packing(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["map", "red", "door", "the", "cook"]) for _ in range(int(rng.expovariate(1 / 40)) + 1)) for _ in range(300)]
    rows = [(i, t, "s", 1, 0.0) for i, t in enumerate(texts)] + [(900, None, "s", 1, 0.0), (901, "", "s", 1, 0.0), (902, "door " * 700, "s", 1, 0.0), (903, texts[0], "s", 1, 0.0)]
    docs = spark.createDataFrame(rows, DOCS)
    limits = spark.createDataFrame([(1, 64), (2, 256), (3, 256)], "limit_id int, capacity_tokens int")
    out = packing.pack(docs, limits, default_vocabulary(), group=4).collect()
    sizes = {r.doc_id: r.n_tokens for r in packing.token_counts(docs, default_vocabulary()).collect()}
    held, used = {}, {}
    for r in out:
        held.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
        used[r.limit_id, r.container_id] = used.get((r.limit_id, r.container_id), 0) + r.n_tokens
    assert set(held) == set(sizes) and {r.limit_id for r in out} == {1, 2}
    for d, spans in held.items():
        assert sum(n for _, n in spans) == sizes[d] and sorted(spans)[0][0] == 0 and (len(spans) == 1 or sizes[d] > 256)
    assert all(n <= {1: 64, 2: 256}[k] for (k, _), n in used.items())
    assert sum(used.values()) / sum({1: 64, 2: 256}[k] for k, _ in used) > 0.95
    with pytest.raises(ValueError):
        packing.pack(docs, limits.where("false"), default_vocabulary())
    assert packing.pack(docs.where("false"), limits, default_vocabulary()).count() == 0


# 7


def items(n):
    rng = random.Random(8)
    name = lambda: "".join(rng.choice("bdglmnprstv") + rng.choice("aeiou") for _ in range(3)).capitalize()
    tail = "Answer with one letter only, without any explanation."
    out = []
    for i in range(n):
        a, b, c = name(), name(), name()
        p = f"The label {a} {rng.randrange(999)} belongs to {b}, who folds the map while {c} waits. Without a word {b} lifts the red drum; the {a} crate marked {rng.randrange(999)} is left with {c}."
        out.append((i, p, f"How long does {b} wait in the far corner until {c} returns from {a} with box {rng.randrange(999)}? {tail}"))
    return out


def test_leaks(spark):
    rows = items(60)
    noise = "We hear wind while the cook lifts the map near the door and the red drum stays in the far corner. "
    p = rows[3][1]
    w = p.split()
    texts = [noise + p, noise + " ".join(w[:14]), " ".join(w[:4]), noise * 3, p.replace("a", "а").replace("label", "la​bel"), " ".join(f"<b>{x}</b>" if i % 3 == 0 else x for i, x in enumerate(w)), rows[5][2].split("?")[0], "Answer with one letter only, without any explanation.", None, "", " ".join(x + (" um" if i % 9 == 4 else "") for i, x in enumerate(w)), f"I think {w[2]} and {w[6]} appear again."]
    docs = spark.createDataFrame([(i, t, "s", 1, 0.0) for i, t in enumerate(texts)], DOCS)
    table = spark.createDataFrame([(*r, "x") for r in [*rows, (99, p, "Other?"), (98, None, None)]], "item_id long, passage string, question string, text string")
    got = {tuple(r) for r in leakage.leaked_pairs(docs, table).collect()}
    assert got == {(d, i) for d in (0, 1, 4, 5, 10) for i in (3, 99)} | {(6, 5)}
    assert leakage.leaked_pairs(docs, table.where("false")).count() == 0 and leakage.leaked_pairs(docs.where("false"), table).count() == 0


def test_long_exact_run_needs_no_rare_words(spark):
    common = "the cook lifts the map near the door and then the host folds it again"
    rows = [(i, f"{p} {common}" if i < 30 else p, q) for i, p, q in items(60)]
    docs = spark.createDataFrame([(0, common, "s", 1, 0.0), (1, " ".join(common.split()[:11]), "s", 1, 0.0)], DOCS)
    got = {tuple(r) for r in leakage.leaked_pairs(docs, spark.createDataFrame(rows, "item_id long, passage string, question string")).collect()}
    assert got == {(0, i) for i in range(30)}


def test_blocks_of_items_change_nothing(spark):
    said = "Please reply with exactly one capital letter and give no explanation of any kind whatsoever."
    rows = [(i, p, f"{q.split('?')[0]}? {said}") for i, p, q in items(24)]
    docs = spark.createDataFrame([(k, x, "s", 1, 0.0) for k, x in enumerate([said, rows[3][1], rows[9][2], " ".join(rows[7][1].split()[:12])])], DOCS)
    table = spark.createDataFrame(rows, "item_id long, passage string, question string")
    whole, *blocks = (sorted(map(tuple, leakage.find_leaks(docs, table, block=b).collect())) for b in (5_000, 10, 2))
    assert all(whole == b for b in blocks) and not any(d == 0 for d, *_ in whole) and {(d, i) for d, i, *_ in whole} >= {(1, 3)}


def index(rows):
    common = leakage.Common(lambda: rows, leakage.PIECE)
    return common, leakage.Segment(rows, common)


def test_no_pair_in_the_radius_is_missed():
    _, it = index(items(40))
    rng = np.random.default_rng(9)
    prints = it.prints[rng.integers(0, len(it.prints), 300)].copy()
    for k in range(len(prints)):
        for bit in rng.choice(64, rng.integers(0, 9), replace=False):
            prints[k] ^= np.uint64(1) << np.uint64(bit)
    a, b = it.neighbours(prints)
    want = {(i, j) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(prints[i] ^ it.prints) <= leakage.RADIUS).tolist()}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_shingle_similarity_against_brute_force():
    rows = items(12)
    common, s = index(rows)
    t = leakage.Texts([leakage.words(p.replace("folds", "lifts")) for _, p, _ in rows], common)
    rng = np.random.default_rng(13)
    x, y = (np.array([rng.integers(a, b - 7) for a, b in zip(v.starts[:12], v.starts[1:13])]) for v in (t, s))
    y[:6] = s.starts[:12:2] if len(s.starts) > 12 else y[:6]
    got = leakage.shingle_similarity(t, x, s, y, 8)
    for k in range(12):
        (ca, wa), (cb, wb) = ((v.codes[i : i + 8].tolist(), v.weights[i : i + 8].tolist()) for v, i in ((t, x[k]), (s, y[k])))
        sa, sb = (([(c[j], c[j + 1]) for j in range(7)], [w[j] + w[j + 1] for j in range(7)]) for c, w in ((ca, wa), (cb, wb)))
        both = (sum(w for g, w in zip(*sa) if g in sb[0]) + sum(w for g, w in zip(*sb) if g in sa[0])) / 2
        assert abs(got[k] - both / (sum(sa[1]) + sum(sb[1]) - both)) < 1e-5


def test_changed_texts_need_the_radius(monkeypatch):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(24)), None) for i in range(60)]  # words of equal weight, every fourth changed
    said = pd.DataFrame([(i, " ".join(f"um{i}" if k % 4 == 3 else w for k, w in enumerate(p.split()))) for i, p, _ in rows], columns=["doc_id", "text"])
    found = {}
    for radius in (0, leakage.RADIUS):
        monkeypatch.setattr(leakage, "RADIUS", radius)
        common, s = index(rows)
        monkeypatch.setattr(leakage.Search, "held", {"c": common, "leak-segment": s})
        found[radius] = {r.doc_id for p in leakage.Search("c", ["leak-segment"], 10, 0.4, 2, 12, 0.25)(iter([said])) for r in p.itertuples() if r.doc_id == r.item_id}
    assert not found[0] and len(found[leakage.RADIUS]) >= 5


# 8


def test_abuse(spark):
    rng = random.Random(10)
    calm = lambda: f"The {rng.choice(['cook', 'host', 'nurse'])} {rng.choice(['folds', 'lifts', 'cuts'])} the {rng.choice(['map', 'drum', 'door'])} near the {rng.choice(['fence', 'lens', 'sink'])}."
    bad = lambda: f"You are a {rng.choice(['filthy', 'stupid', 'useless'])} {rng.choice(['moron', 'idiot', 'cretin'])} and nobody wants you."
    nice = lambda: f"The {rng.choice(['women', 'refugees', 'foreigners'])} teach the pottery course."
    hate = lambda: f"Those {rng.choice(['women', 'refugees', 'foreigners'])} breed like rats."
    rows, labels = [], []
    for i in range(600):
        y = i % 3 == 0
        s = [calm() for _ in range(4)] + [rng.choice([bad, hate])() if y else rng.choice([nice, calm])()]
        rng.shuffle(s)
        rows.append((i, " ".join(s), "s", 1, 0.0))
        if i < 400:
            labels.append((i, "r", int(y) if rng.random() > 0.05 else int(not y)))
    rows += [(900, None, None, 1, 0.0), (901, " ", "s", 1, 0.0), (902, "You are a f​ilthy m0ron and nobody wants you.", "s", 1, 0.0), (903, calm() * 4000, "s", 1, 0.0)]
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (1, "x", None), (None, "x", 1)], "doc_id long, reviewer string, abusive int")
    got = {r.doc_id for r in abuse.abusive_documents(docs, lab).collect()}
    want = {i for i in range(600) if i % 3 == 0} | {902}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.03 * 403  # a twentieth of the labels is wrong
    assert not got & {900, 901, 903} and 902 in got
    assert abuse.abusive_documents(docs, lab.where("false")).count() == 0
    assert abuse.score_documents(docs.where("false"), lab).count() == 0


def test_window_scores_match_a_plain_sum():
    rng = random.Random(11)
    texts = [[rng.choice(["map", "drum", "folds", "near", "cook", "7"]) for _ in range(n)] for n in (0, 1, 2, 5, 12, 13, 40)]
    w = np.random.default_rng(12).normal(size=2**abuse.BITS).astype(np.float32)
    model = abuse.AbuseModel(abuse.Words({}), w, -1.0, 0.5)
    e = abuse.Encoder(texts)
    doc, a, b = e.windows(1)
    rows, ids, values = e.matrix(a, b)
    z = np.bincount(rows, values * w[ids], len(a)) - 1.0
    want = [max([1 / (1 + np.exp(-z[i])) for i in range(len(a)) if doc[i] == d], default=0.0) for d in range(len(texts))]
    assert np.allclose(model.score(texts), want, atol=1e-5)
