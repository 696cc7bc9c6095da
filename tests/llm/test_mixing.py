import random

from brute import mixture

from runnel.llm import mixing


def mixed(spark, rows, schema="doc_id bigint, text string, source string"):
    df = mixing.mix(spark.createDataFrame(rows, schema))
    return df, [(r.doc_id, r.size, r.source_size, r.target, r.copies) for r in df.collect()]


def near(got, want):
    key = lambda r: (str(r[0]), r[1], r[2])
    got, want = sorted(got, key=key), sorted(want, key=key)
    return len(got) == len(want) and all(g[:3] == w[:3] and abs(g[3] - w[3]) <= 1e-9 * max(1, w[3]) and g[4] == w[4] for g, w in zip(got, want))


def test_against_brute_force(spark):
    rng = random.Random(1)
    for n, sources in ((300, ["hot"] * 8 + ["b", "c", "Ä", "é", None]), (40, ["a", "b"]), (30, [None])):
        rows = [(k, rng.choice(("x " * rng.randint(0, 40), None, "", "a\tb\nc")), rng.choice(sources)) for k in range(n)]
        _, got = mixed(spark, rows)
        assert near(got, mixture(rows))
        assert all(g[4] <= 3 for g in got)


def test_taken_words_come_near_the_targets(spark):
    rows = [(k, "w " * (k % 7 + 1), f"s{min(k % 10, 3)}") for k in range(4000)]
    _, got = mixed(spark, rows)
    for size, target in {(g[2], g[3]) for g in got}:
        taken = sum(g[1] * g[4] for g in got if g[2] == size)
        assert abs(taken - target) < 0.1 * target


def test_many_sources_by_shuffle(spark, monkeypatch):
    rows = [(k, "w " * (k % 5), f"s{k % 40}") for k in range(200)]
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert near(mixed(spark, rows)[1], mixture(rows))


def test_copies_edges_and_plan(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, "c", "y"), (None, "d", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r[4] for r in mixture(rows))
    assert mixed(spark, [])[1] == []
    df, got = mixed(spark, [(1, "a", "x", 7, "t", 9)], "doc_id bigint, text string, source string, size int, target string, copies int")
    assert got == [(1, 1, 1, 1.0, 1)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
