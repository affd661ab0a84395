"""Operators on small literal tables."""

import math
import random

from pyspark.sql import functions as F

from heddle.functions import protocol, rewards, stats, text
from heddle.operators import audit, cards, duplicates, retrieval, sampling, verify, windows
from heddle.plans import catalogue
from heddle.sources import files
from heddle.streaming import memory


def col(spark, expr, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_answers(spark):
    assert col(spark, lambda c: text.normal_answer(c, "binary"), "YES, definitely", "true", "yeah probably", None) == ["Yes", "Yes", "", ""]
    assert col(spark, lambda c: text.normal_answer(c, "choice"), "A. eggplant", "(C)", "E", "") == ["A", "C", "", ""]
    assert col(spark, lambda c: text.normal_answer(c, "number"), "3 times", "3rd", "three") == ["3", "", ""]
    assert col(spark, text.seconds, "01:02:03", "02:03", "7.5", "x", None) == [3723.0, 123.0, 7.5, None, None]


def test_similarity(spark):
    df = spark.createDataFrame([("kitchen_cam.mp4", "kitchen-cam", [1.0, 0.0], [0.0, 0.0])], "a string, b string, u array<double>, v array<double>")
    r = df.select(text.jaccard(text.trigrams(F.col("a")), text.trigrams(F.col("b"))), text.cosine(F.col("u"), F.col("v")), text.cosine(F.col("u"), F.col("u")), F.size(text.trigrams(F.lit("ab")))).first()
    assert tuple(r) == (1.0, 0.0, 1.0, 0)


def test_group_centring(spark):
    rows = [("a", x, True) for x in (1.0, 2.0, 3.0, 4.0)] + [("b", 1.0, True), ("b", 99.0, False), ("b", 99.0, False), ("b", 4.0, True), ("c", 5.0, False)]
    df = spark.createDataFrame(rows, "g string, x double, m boolean")
    out = sorted((r.g, r.y) for r in df.select("g", stats.centred(F.col("x"), F.col("m"), ["g"]).alias("y")).collect())
    assert out == sorted([("a", -1.5), ("a", -0.5), ("a", 0.5), ("a", 1.5), ("b", -1.5), ("b", 0.0), ("b", 0.0), ("b", 1.5), ("c", 0.0)])


def test_timing_reward(spark):
    df = spark.createDataFrame([(7,), (3,), (11,), (None,)], "a int")
    reward = lambda c, *w: [r[0] for r in df.select(rewards.timing(c, F.lit(5), F.lit(10), *w)).collect()]
    assert reward(F.col("a")) == [1.0, -1.0, 0.5, -0.5] and reward(F.col("a") + 1) == [1.0, -1.0, 0.0, -0.5] and reward(F.col("a"), 2) == [1.0, -1.0, 0.75, -0.5]
    assert df.select(rewards.timing(F.col("a"), F.lit(None), F.lit(None))).distinct().collect()[0][0] == 0.0


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 11)] + [("b", 1.0), ("b", None)], "g string, x double")
    out = {r.g: (r.n, r.p50, r.p90) for r in stats.nearest_rank_by(df, ["g"], "x", {"p50": 0.5, "p90": 0.9}).collect()}
    assert out == {"a": (10, 6.0, 10.0), "b": (1, 1.0, 1.0)}


def test_predicates_fail_on_nulls(spark):
    df = spark.createDataFrame([(40.0, "X"), (None, "x"), (10.0, None)], "d double, k string")
    assert [r.level for r in audit.levels(df, {"A": [{"d__min": 32, "k__lower": "x"}]}, "C").collect()] == ["A", "C", "C"]


def test_group_ids_of_nulls_are_their_own(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id long, k string")
    out = {r.id: (r.group_id, r.group_size) for r in audit.group_ids(df, F.col("k"), F.col("id")).collect()}
    assert out[1] == out[2] and out[1][1] == 2 and out[3][0] != out[4][0] and out[3][1] == 1


def test_every_row_gets_a_near_mark(spark):
    rng = random.Random(1)
    rows = [(i, "ab"[i % 2], [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)] + [(200, "c", [1.0, 0.0]), (201, None, [1.0, 0.0]), (202, "a", None), (203, "d", [0.0, 0.0]), (204, "d", [0.0, 1.0])]
    rows += [(300 + i, "e", [1.0, 1.0]) for i in range(3)]

    def cosine(u, v):
        norm = math.sqrt(sum(x * x for x in u)) * math.sqrt(sum(x * x for x in v))
        return round(sum(x * y for x, y in zip(u, v)) / norm, 6) if norm else 0.0

    want = {}
    for i, g, v in rows:
        others = [(-cosine(v, w), j) for j, h, w in rows if i != j and g is not None and g == h and v and w]
        s, j = min((x for x in others if x[0] < 0), default=(0.0, None))
        want[i] = (j, -s, j is not None and -s > 0.7)
    df = spark.createDataFrame(rows, "i long, g string, v array<float>")
    for block in (7, 1000):
        got = {r.i: (r.partner, r.sim, r.near_dup) for r in audit.near_marks(df, "g", "i", "v", 0.7, block=block).collect()}
        assert set(got) == set(want) and all(got[i][::2] == want[i][::2] and abs(got[i][1] - want[i][1]) < 3e-6 for i in want)
    assert 0 < sum(x[2] for x in want.values()) < len(want)


def test_visual_near_dup_is_registered_for_every_row(spark, tmp_path):
    rows = [(i, i % 2, [1.0, float(i)]) for i in range(1, 9)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert catalogue.queries()["visual_near_dup"](spark, str(tmp_path)).where("near_dup").count() == 8


def test_split_is_whole_and_disjoint(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(40)] * 2, "k string")
    s = sampling.split_keys(df, "k", {"train": 0.7, "val": 0.15, "test": 0.15})
    assert {r.split: r["count"] for r in s.groupBy("split").count().collect()} == {"train": 28, "val": 6, "test": 6}
    assert sampling.shared_between(s, "k", "split").count() == 0


def test_answers_before_the_next_ask(spark):
    asks = spark.createDataFrame([("u", 0), ("u", 10), ("u", 50)], "k string, at long")
    answers = spark.createDataFrame([("u", 12), ("u", 90)], "k string, at long")
    out = {r.ask: r.answer for r in windows.answered_in_window(asks, answers, ["k"], "at", 24).collect()}
    assert out == {0: None, 10: 12, 50: None}


def test_memory_stream_equals_batch(spark, tmp_path):
    rows = [("a", i, 30 + i % 7) for i in range(40)] + [("b", i, 90) for i in range(6)]
    df = spark.createDataFrame(rows, "key string, at long, tokens long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = {tuple(r) for r in memory.memory_batch(df).collect()}
    q = memory.memory_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("mem").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("mem").collect()} == want and len(want) == 46
    assert max(r[4] for r in want) <= 12


def test_memory_merges_the_oldest_ranges(spark):
    df = spark.createDataFrame([("a", i, 60) for i in range(60)], "key string, at long, tokens long")
    rows = sorted(memory.memory_batch(df, trigger=320, target=220, summary=10, most=3).collect(), key=lambda r: r.at)
    ranges = [tuple(map(int, x.split("-"))) for x in rows[-1].ranges.split(",")]
    assert len(ranges) == 3 and ranges[0][0] == 0 and all(b + 1 == c for (_, b), (c, _) in zip(ranges, ranges[1:])) and ranges[-1][1] + 1 == rows[-1].first_held


def test_percentiles_of_one_large_key(spark):
    df = spark.range(20_000).select(F.lit("k").alias("g"), ((F.col("id") * 7919) % 20_000 / 8.0).alias("x"))
    df = df.unionByName(spark.createDataFrame([("e", 1.0)] * 9 + [("e", 5.0)], "g string, x double"))
    out = {r.g: tuple(r)[1:] for r in stats.nearest_rank_by(df, ["g"], "x", {"lo": 0.0, "p50": 0.5, "p95": 0.95, "hi": 1.0}).collect()}
    assert out == {"k": (20_000, 0.0, 1250.0, 2375.0, 19_999 / 8.0), "e": (10, 1.0, 1.0, 5.0, 5.0)}


def test_rewards_of_null_and_long_answers(spark):
    df = spark.createDataFrame([("Yes", "yes", "binary"), ("Yes it is", "yes", "binary"), ("Yes it is", "yes", "descriptive"), ("y" * 1001, "y", "descriptive"), (None, "yes", "binary"), ("a", None, "binary"), ("a", " ", "")], "a string, g string, f string")
    assert [r[0] for r in df.select(rewards.outcome(F.col("a"), F.col("g"), F.col("f"))).collect()] == [1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    q = spark.createDataFrame([("", "silent", ""), ("x", "silent", ""), (None, "response", "g"), ("x", "response", "g"), (None, "compress", None), (None, None, None)], "a string, k string, g string")
    assert [r[0] for r in q.select(rewards.silent_quality(F.col("a"), F.col("k"), F.col("g"))).collect()] == [0.3, -0.6, -0.6, 0.0, 0.0, 0.3]
    assert col(spark, rewards.well_formed, "<think>a</think><answer>b</answer>", "<think>a<answer>b</answer>", '<think></think><tool_call>{"name": "x"}</tool_call>', "<think></think><tool_call>{</tool_call>", "<answer></answer><answer></answer>", None) == [1.0, 0.0, 1.0, 0.0, 0.0, 0.0]


def test_stems(spark):
    assert col(spark, protocol.stem, "stirring the pot", "Stirs slowly", "stirred", "cut", "sees", "", None, "3 steps") == ["stir", "stir", "stir", "cut", "see", "", "", "3 steps"]


def test_broken_json_is_rescued(spark):
    texts = ['{"a": 1}', '```json\n{"a": [1, 2]}\n```', 'Here: {"a": [{"b": 1}, {"b": "x}"}, {"b": ', "[1, 2", "none", None, '{"a": "' + "x" * 10_000 + '"}']
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", protocol.robust_json(F.col("x")).alias("j")).collect()
    got = {r.i: (r.j.mode, r.j.json) for r in rows}
    assert [got[i][0] for i in range(7)] == ["direct", "fenced", "rescued", "failed", "failed", "failed", "direct"] and got[2][1] == '{"a": [{"b": 1}, {"b": "x}"}]}'


def test_checks(spark):
    df = spark.createDataFrame([("Bob lifts 3 MAPS near Ann_2.", "Bob and Carol lift a map.", "Carol saw Dave")], "source string, summary string, think string")
    r = df.select(verify.key_items(F.col("source")), verify.provenance(F.col("summary"), F.col("source"), F.lit(False)), verify.provenance(F.col("summary"), F.col("source"), F.lit(True)), verify.leak(F.col("summary"), F.col("think"), F.col("source")), verify.ratio(F.col("summary"), F.lit(100)), verify.ratio(F.lit(" "), F.lit(9)), verify.leak(F.lit(None), F.lit(None), F.lit(None))).first()
    assert set(r[0]) == {"bob", "ann_2", "3"} and tuple(r)[1:] == ("provenance", None, "think_leak", None, "empty_summary", None)
    assert col(spark, verify.grounded, "<think>I hear music</think>", "<think>a map</think>", "x", None) == ["not_seen", None, "no_think", "no_think"]


def test_similar_sets_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), [rng.choice("cdefghij") for _ in range(rng.randint(0, 9))]) for i in range(150)] + [(500, None, ["c"]), (501, "a", None)]
    df = spark.createDataFrame(rows, "k long, g string, w array<string>")
    for least in (0.5, 0.8):
        got = {(r.g, r.a, r.b) for r in duplicates.similar_sets(df, "g", "k", F.col("w"), least).collect()}
        reps = {}
        for i, g, w in rows:
            if g and w:
                reps.setdefault((g, frozenset(w)), i)
        items = [(g, w, i) for (g, w), i in reps.items()]
        want = {(g, min(i, j), max(i, j)) for g, w, i in items for h, v, j in items if g == h and i != j and len(w & v) / len(w | v) >= least}
        assert got == want


def test_diverse_picks_against_a_loop(spark):
    rng = random.Random(6)
    rows = [(k, c, [rng.choice("abcde") for _ in range(rng.randint(0, 3))]) for k in "xyz" for c in range(40)]
    want = {}
    for k, c, items in rows:
        picks, last = want.setdefault(k, ([], [set()]))
        if items and set(items) - last[0] and len(picks) < 8:
            picks.append(c)
            last[0] = set(items)
    got = {r.k: r.picks for r in cards.diverse(spark.createDataFrame(rows, "k string, c long, i array<string>"), ["k"], "c", "i").collect()}
    assert got == {k: p for k, (p, _) in want.items()}


def test_best_range_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(k, c, float(rng.randint(0, 9))) for k in "xy" for c in range(20)] + [("z", 0, 1.0)]
    got = {r.k: (r.first, r.size, round(r.mean, 6)) for r in cards.best_range(spark.createDataFrame(rows, "k string, c long, g double"), ["k"], "c", "g", 3, 6).collect()}
    for k in "xy":
        g = [x for a, _, x in rows if a == k]
        want = max((sum(g[i : i + n]) / n, n, -i) for n in range(3, 7) for i in range(20 - n + 1))
        assert got[k] == (-want[2], want[1], round(want[0], 6))
    assert set(got) == {"x", "y"}


def test_dense_top_k_in_blocks(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(90, None), (91, []), (92, [0.0] * 4)]
    df = spark.createDataFrame(rows, "i long, v array<float>")
    q = df.where("i % 7 = 0")
    a, b = ({(r.q, r.doc, r.rank) for r in retrieval.dense_top_k(q, df, "i", "v", 3, block=n).collect()} for n in (2, 1_000))
    assert a == b and len(a) == 27 and retrieval.dense_top_k(q.where("false"), df, "i", "v", 3).count() == 0


def test_stages_and_cache(spark, tmp_path):
    st = files.Stages(spark, str(tmp_path), ["1a", "1b", "2"])
    for n in st.names:
        spark.range(1).write.parquet(f"{st.path(n)}/table")
        st.mark(n, "v1")
    assert st.current("1b", "v1") and not st.current("1b", "v2") and st.invalidate("1b") == ["1b", "2"]
    assert st.current("1a", "v1") and not st.current("1b", "v1")
    asked = []

    def compute(keys):
        asked.append(keys.count())
        return keys.withColumn("v", F.col("k") * 2)

    for ids in ([1, 2, 2], [2, 3]):
        out = files.cached(spark.createDataFrame([(i,) for i in ids], "k long"), str(tmp_path / "cache"), ["k"], compute)
        assert {tuple(r) for r in out.collect()} == {(i, i * 2) for i in ids}
    assert asked == [2, 1]


def test_writers_logs_and_responses(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(1, "train", "x"), (2, "val", "y")], "id long, split string, t string")
    files.write_splits(df, str(tmp_path / "s"))
    files.write_preview(df, str(tmp_path / "p"), 1)
    assert spark.read.json(str(tmp_path / "s/split=val")).count() == 1 and spark.read.option("header", True).csv(str(tmp_path / "p/preview")).count() == 1
    files.replace_keys(df, str(tmp_path / "k"), "split")
    files.replace_keys(df.where("id = 2").withColumn("t", F.lit("z")), str(tmp_path / "k"), "split")
    assert {(r.id, r.t) for r in spark.read.parquet(str(tmp_path / "k")).collect()} == {(1, "x"), (2, "z")}
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"a": 1}\n{"a": 2}\n')
    assert files.read_any(spark, str(tmp_path / "a.jsonl.gz"), "a long").count() == 2
    logs = files.log_metrics(spark.createDataFrame([("step 3 loss=0.5",), ("none",)], "value string"), {"loss": r"loss=([\d.]+)"})
    assert [r.loss for r in logs.collect()] == [0.5, None]
    answers = spark.createDataFrame([(1, 0, False, "bad"), (1, 1, True, "good")], "id long, attempt int, ok boolean, body string")
    assert {r.id: r.response and r.response.body for r in files.with_responses(df, answers, "id", "attempt", "ok").collect()} == {1: "good", 2: None}
    skipped = files.skip_reason(spark.createDataFrame([(10.0,), (None,), (5000.0,)], "d double"), {"no_duration": F.col("d").isNull(), "too_short": F.col("d") < 30, "too_long": F.col("d") > 1800})
    assert {r.reason: r.n for r in files.skip_counts(skipped).collect()} == {"too_short": 1, "no_duration": 1, "too_long": 1}
    assert files.read_policy(None, {"a": 1}) == {"a": 1}


def test_frames_grow_backwards_only():
    """No window of the library is evaluated over all following rows anew for each row."""
    import pathlib

    import heddle

    root = pathlib.Path(heddle.__file__).parent
    assert not [p for p in root.rglob("*.py") if "unboundedFollowing" in p.read_text()]


def test_reading(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.jsonl").write_text('{"a": 1}\n{"a": null}\n')
    assert files.read_any(spark, str(tmp_path / "d"), "a long").count() == 2
    (tmp_path / "c.csv").write_text("p,d\nx,1.5\ny,no\n")
    assert [r.d for r in files.read_catalog(spark, str(tmp_path / "c.csv"), {"d": "double"}).collect()] == [1.5, None]
    assert files.sampled(spark.range(10).toDF("id"), "id", "name%30").count() == 3
