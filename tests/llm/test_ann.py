import numpy as np

from runnel.llm import additive_ann
from runnel.llm.additive_ann import nearest

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(rows, k=5):
    good = [(i, np.array(v, np.float64)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % 50 == 0:
            s = [(-sum(q * v) / (np.sqrt(sum(q * q)) * np.sqrt(sum(v * v))), j) for j, v in good if j != i]
            out[i] = [j for _, j in sorted(s)[:k]]
    return out


def found(spark, rows, schema=SCHEMA, **options):
    df = spark.createDataFrame(rows, schema)
    out = {}
    for r in sorted(nearest(df, df.where("vec_id % 50 = 0"), **options).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 32))
    rows = [(k, (centres[k % 30] + 0.4 * rng.normal(size=32)).astype(np.float32).tolist()) for k in range(3000)]
    got, want = found(spark, rows), brute(rows)
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[i]) & set(want[i])) / 5 for i in want]) >= 0.9
    narrow = additive_ann.Settings(block=7, sample=500)
    assert np.mean([len(set(v) & set(want[i])) / 5 for i, v in found(spark, rows, settings=narrow).items()]) >= 0.9


def test_recall_in_a_group_of_thousands_of_near_copies(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(9000, 32))
    hot = np.arange(9000) % 3 == 0
    x[hot] = x[0] + 1e-3 * rng.normal(size=(hot.sum(), 32))
    x[hot] *= rng.uniform(0.2, 5, size=(hot.sum(), 1))
    x = x.astype(np.float32)
    unit = x.astype(np.float64) / np.sqrt((x.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    got = found(spark, list(enumerate(x.tolist())))
    shared = {"hot": [], "other": []}
    for i in range(0, 9000, 50):
        score = unit @ unit[i]
        score[i] = -2
        shared["hot" if hot[i] else "other"].append(len(set(got[i]) & set(np.argsort(-score)[:5])) / 5)
    assert np.mean(shared["hot"]) >= 0.999 and np.mean(shared["other"]) >= 0.999


def test_scores_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (3, [2.0, 0.0]), (2, [5.0, 0.0]), (4, [0.0, 1.0]), (1, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in nearest(df, df.where("vec_id = 0")).collect()), key=lambda r: r[1])
    assert got == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 4, 0.0), (0, 4, 1, -1.0)]


def test_edges(spark):
    bad = [(50, None), (51, [0.0, 0.0]), (52, [float("nan"), 1.0]), (53, [None, 1.0]), (54, [float("inf"), 1.0]), (None, [1.0, 1.0]), (100, [])]
    assert found(spark, [(0, [1.0, 1.0]), (1, [1.0, 0.5]), *bad]) == {0: [1]}
    assert found(spark, bad) == {} and found(spark, []) == {}
    assert found(spark, [(0, [1.0, 1.0])]) == {}
    assert found(spark, [(0, [1.0, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 1.0])]) == {0: [7]}
    assert found(spark, [(0, [1.0, 1.0], 4, "v"), (2, [1.0, 0.0], 5, "w")], SCHEMA + ", id int, vector string") == {0: [2]}
