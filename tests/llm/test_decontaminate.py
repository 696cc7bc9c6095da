import random

import numpy as np
import pytest
from brute import contamination

from runnel.llm import decontaminate

BOTH = [decontaminate.Settings(), decontaminate.Settings(broadcast_words=0)]


def judged(spark, docs, items, s=BOTH[0]):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((tuple(r) for r in decontaminate.decontaminate(d, b, s).collect()), key=lambda r: (str(r[0]), r))


@pytest.mark.parametrize("s", BOTH)
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, s, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Ünï", "7"]
    items = [(k, " ".join(rng.choices(words, k=rng.choice((0, 1, 3, 12, 13, 14, 40))))) for k in range(25)]
    docs = []
    for k in range(60):
        own = rng.choices(words, k=rng.randint(0, 150))
        for _ in range(rng.randint(0, 2)):
            part = items[rng.randrange(25)][1].split()
            cut = rng.randint(0, max(0, len(part) - 13))
            at = rng.randint(0, len(own))
            own[at:at] = [w.upper() + rng.choice(("", ",", "\n.")) for w in part[cut:]]
        docs.append((k, " ".join(own)))
    assert judged(spark, docs, items, s) == sorted(contamination(docs, items), key=lambda r: (str(r[0]), r))


@pytest.mark.parametrize("s", BOTH)
def test_edges(spark, s):
    text = " ".join(f"b{k}" for k in range(20))
    docs = [(1, None), (2, ""), (3, "..."), (4, text), (4, text), (None, text), (6, "x " * 50_000 + text)]
    items = [(1, text), (1, text), (2, None), (3, "!"), (None, text)]
    got = judged(spark, docs, items, s)
    assert [r[1:4] for r in got if r[0] in (1, 2, 3)] == [(0, 0, 0)] * 3
    assert [r[1:3] + r[5:] for r in got if r[0] == 4] == [(20, 20, True)] * 2
    assert [r[1:3] + r[5:] for r in got if r[0] is None] == [(20, 20, True)]
    assert [r[1:3] + r[5:] for r in got if r[0] == 6] == [(50_020, 20, False)]


@pytest.mark.parametrize("s", BOTH)
def test_empty_tables_and_clashing_columns(spark, s):
    assert judged(spark, [], [(1, "a")], s) == []
    assert [r[1:4] for r in judged(spark, [(1, "a b")], [], s)] == [(2, 0, 0)]
    d = spark.createDataFrame([(1, "a b c", "q", 2)], "doc_id bigint, text string, item string, length int")
    b = spark.createDataFrame([(1, "b", 5, "r")], "item_id bigint, text string, doc_id int, runs string")
    assert decontaminate.decontaminate(d, b, s).first()[1:4] == (3, 1, 1)


def test_winnowing_never_misses_a_shared_span():
    rng, s = np.random.default_rng(5), BOTH[0]
    for _ in range(200):
        shared = rng.integers(0, 50, s.window, dtype=np.uint64)
        a = np.concatenate([rng.integers(0, 50, rng.integers(0, 30), dtype=np.uint64), shared, rng.integers(0, 50, 9, dtype=np.uint64)])
        b = np.concatenate([rng.integers(0, 50, rng.integers(0, 30), dtype=np.uint64), shared])
        fa, fb = a[decontaminate.fingerprints(a, s.window)], b[decontaminate.fingerprints(b, s.window)]
        assert set(fa) & set(fb)


def test_clean_documents_keep_their_columns(spark):
    item = " ".join(f"q{k}" for k in range(20))
    rows = [(None, 7, item, "a"), (1, 8, "x " + item, "b"), (1, 9, "a clean text", "c"), (None, None, None, None), (2, 1, "", "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, n_words int, text string, key string")
    bench = spark.createDataFrame([("i", item)], "item_id string, text string")
    for most in (4_000_000, 0):
        got = decontaminate.clean_documents(docs, bench, decontaminate.Settings(broadcast_words=most))
        assert got.columns == docs.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rows[2:]))
