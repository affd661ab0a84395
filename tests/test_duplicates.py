"""Near duplicates of tables with one large origin: the same rows as SQL, and far less shuffled than pairs would take."""

import random

import pytest

from heddle.operators import duplicates
from heddle.plans import catalogue


def written(spark):
    """Bytes shuffled so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    x = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(x.apply(i).totalShuffleWrite() for i in range(x.size()))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of 40 of 200 words, 500 of one video; every tenth comes again with one or two words changed."""
    rng, rows = random.Random(11), []
    for i in range(600):
        words = rng.sample(range(200), 40)
        if i % 10 == 1:
            words = rows[-1][1][: 40 - rng.randint(1, 2)] + [200 + i]
        rows.append((i, words, "v" if i < 500 else f"v{i // 3}"))
    at = tmp_path_factory.mktemp("large-origin")
    texts = [(i, " ".join(f"w{x}" for x in w), v, rng.choice("ab"), 1 + i % 7) for i, w, v in rows]
    spark.createDataFrame(texts, "doc_id long, text string, video_id string, source string, n_chars long").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["curation_report", "dedup_decision_richest", "semantic_near_dup"])
def test_large_origin(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    before = written(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        df = catalogue.queries()[name](spark, folder)
        got = sorted(map(tuple, df.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert written(spark) - before < 2e6
    assert got == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall())


def test_long_sets_and_parts(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "PART", 7)
    rng, rows = random.Random(12), []
    for i in range(60):
        rows.append((i, "g", rng.sample(range(900), rng.randint(240, 420))))
        rows.append((100 + i, "g", rng.sample(rows[-1][2], int(len(rows[-1][2]) * rng.uniform(0.76, 0.84)))))
        rows.append((200 + i, "gh"[i % 2], rng.sample(range(12), rng.randint(1, 12))))
    df = spark.createDataFrame([(i, g, [str(x) for x in w]) for i, g, w in rows], "k long, g string, w array<string>")
    reps = {}
    for i, g, w in sorted(rows):
        reps.setdefault((g, frozenset(w)), i)
    items = [(i, g, w) for (g, w), i in reps.items()]
    for least in (0.8, 1.0):
        got = {(r.g, r.a, r.b) for r in duplicates.similar_sets(df, "g", "k", df.w, least).collect()}
        assert got == {(g, i, j) for i, g, w in items for j, h, v in items if g == h and i < j and len(w & v) / len(w | v) >= least - 1e-9}
    rows = duplicates.set_classes(duplicates.profiles(df, "g", "k", df.w), "g")
    assert duplicates.candidates(rows, "g", 0.8).count() < 2 * duplicates.similar_sets(df, "g", "k", df.w, 0.8).count()


def test_many_similar_pairs(spark, tmp_path):
    """Of 800 documents of one video each has 39 near copies: decisions take one of them, not the words of all pairs."""
    import duckdb

    rng, rows = random.Random(13), []
    for i in range(20):
        words = [f"word{x}" for x in rng.sample(range(400), 60 + i)]
        for j in range(40):
            rng.shuffle(words)
            rows.append((40 * i + j, " ".join([*words, f"own{i}x{j}"]), "v", rng.choice("ab"), 1 + rng.randrange(5)))
    spark.createDataFrame(rows, "doc_id long, text string, video_id string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    before = written(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        got = sorted(map(tuple, catalogue.queries()["dedup_decision_richest"](spark, str(tmp_path)).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert written(spark) - before < 1.2e6
    assert got == sorted(con.execute(f"SELECT doc_id, decision FROM ({catalogue.oracle_sql()['dedup_decision_richest']})").fetchall())


@pytest.mark.parametrize("near", [duplicates.NEAR, ()])
def test_losers(spark, monkeypatch, near):
    """Without NEAR the candidate of the least id is first, which is often not similar, so the second search decides."""
    made, stage = [], duplicates.stage
    monkeypatch.setattr(duplicates, "stage", lambda df, name: made.append(name) or stage(df, name))
    monkeypatch.setattr(duplicates, "NEAR", near)
    monkeypatch.setattr(duplicates, "PART", 11)
    rng, rows = random.Random(14), []
    for i in range(12):
        base = rng.sample(range(5000), rng.choice([8, 40, 200, 240, 300]))
        for j in range(8):
            words = [x if rng.random() > 0.06 * (j > 2) else 5000 + rng.randrange(9000) for x in base]
            rows.append((rng.randrange(1 << 40) * (-1) ** j, "gh"[i % 2], words, rng.randrange(3)))
    df = spark.createDataFrame([(i, g, [str(x) for x in w], n) for i, g, w, n in rows], "k long, g string, w array<string>, v long")
    classes = stage(duplicates.set_classes(duplicates.profiles(df, "g", "k", df.w, df.v), "g"), "classes")
    best = {}
    for i, g, w, n in rows:
        c = best.setdefault((g, frozenset(w)), [i, n])
        c[:] = min(c[0], i), max(c[1], n)
    lost = {i for (g, w), (i, n) in best.items() for (h, v), (j, m) in best.items() if g == h and i != j and len(w & v) / len(w | v) >= 0.8 - 1e-9 and (-m, j) < (-n, i)}
    got = [r.class_id for r in duplicates.losers(df, "g", "k", df.w, classes).collect()]
    assert near or "candidates" in made
    assert sorted(got) == sorted(lost) and 10 < len(lost) < len(best) - 10
