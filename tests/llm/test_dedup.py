import random

import pytest
from brute import components, near_duplicates

from runnel.llm import minhash_dedup
from runnel.llm.components import connected_components

WORDS = [f"w{k}" for k in range(500)]


def judged(spark, rows, schema="doc_id bigint, text string"):
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in got}, got


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    while len(rows) < n:
        words = rng.choices(WORDS, k=rng.randint(1, 120))
        rows.append(" ".join(words))
        for _ in range(rng.choice((0, 0, 1, 4))):
            other = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 25)):
                other[rng.randrange(len(other))] = rng.choice(WORDS)
            rows.append(" ".join(other))
            if rng.random() < 0.3:
                words = other
    return list(enumerate(rows[:n]))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed, 220)
    got, full = judged(spark, rows)
    assert got == near_duplicates(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in full)


def test_hot_group_in_blocks(spark):
    rng = random.Random(3)
    base = rng.choices(WORDS, k=60)
    rows = []
    for k in range(120):
        own = list(base)
        own[rng.randrange(60)] = f"x{k}"
        rows.append((k, " ".join(own)))
    rows += [(200 + k, " ".join(base)) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = minhash_dedup.near_duplicates(docs, settings=minhash_dedup.Settings(block=32, broadcast_ids=0)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_duplicates(rows)


def test_linked_pairs_that_meet_beside_another_pivot(spark):
    rng = random.Random(6)
    base, rows = [f"b{k}" for k in range(400)], []

    def changed(words, n, mark):
        own = list(words)
        for at in rng.sample(range(len(own)), n):
            own[at] = f"{mark}-{at}"
        return own

    for k in range(60):
        one = changed(base, 8, f"x{k}")
        rows += [one, changed(one, 10, f"y{k}")]
    rows = [(k, " ".join(words)) for k, words in enumerate(rows)]
    want = near_duplicates(rows)
    assert len({c for _, c in want.values()}) > 30
    assert judged(spark, rows)[0] == want


def test_pairs_of_a_group_and_its_outliers_stay_in_tasks(spark, monkeypatch):
    """Outliers are near to all of a group and linked with few of it: their pairs grow with outliers times group."""
    rng = random.Random(8)
    base, rows = [f"b{k}" for k in range(120)], []
    for k in range(300):
        own = list(base)
        for at in rng.sample(range(120), 1 + 3 * (k % 2)):
            own[at] = f"x{k}-{at}"
        rows.append((k, " ".join(own)))
    pairs, confirmed = [], minhash_dedup.confirmed

    def counted(given, *rest):
        pairs.append(given.count())
        return confirmed(given, *rest)

    monkeypatch.setattr(minhash_dedup, "confirmed", counted)
    assert judged(spark, rows)[0] == near_duplicates(rows)
    assert sum(pairs) < 32 * len(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    small = minhash_dedup.Settings(block=32, held=1000, broadcast_ids=0)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(docs, settings=small).collect()} == near_duplicates(rows)


def test_edges(spark):
    long = " ".join(f"v{k % 9000}" for k in range(30_000))
    rows = [(5, "A b  C"), (3, "a B\tc"), (9, None), (8, ""), (7, " \n "), (20, long), (21, long + " end"), (None, "a b c"), (4, "a b c d")]
    got, full = judged(spark, rows)
    assert got[5] == (1, 3) and got[3] == (1, 3) and got[4] == (1, 4)
    assert got[9] == (0, 9) and got[8] == (0, 8) and got[7] == (0, 7)
    assert got[20][1] == got[21][1] == 20
    assert [(r.component_id, r.kept) for r in full if r.doc_id is None] == [(None, True)]


def test_repeated_ids_and_rows(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    got, full = judged(spark, [(1, a), (1, a), (2, b), (3, a), (3, b)])
    assert len(full) == 5
    assert {r.component_id for r in full} == {1}


def test_empty_table_and_clashing_columns(spark):
    assert judged(spark, [])[1] == []
    rows = [(1, "a b c", "x", 2, 3), (2, "a b c", "y", 1, 1)]
    got, _ = judged(spark, rows, "doc_id bigint, text string, print string, bucket int, component int")
    assert got == {1: (1, 1), 2: (1, 1)}


def test_sketch_tells_similar_from_less_similar():
    import numpy as np

    s = minhash_dedup.Settings()
    signer, rng = minhash_dedup.Signer(s), np.random.default_rng(1)
    bits = lambda a, b: int(np.bitwise_count(signer.sketch(a).view(np.uint64) ^ signer.sketch(b).view(np.uint64)).sum())
    for _ in range(20):
        x = rng.integers(1, 2**63, 400, dtype=np.uint64)
        near, far = x.copy(), x.copy()
        near[:40], far[:200] = rng.integers(1, 2**63, 40, dtype=np.uint64), rng.integers(1, 2**63, 200, dtype=np.uint64)
        assert bits(np.sort(x), np.sort(near)) <= s.differing_bits() < bits(np.sort(x), np.sort(far))


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 180)] + [(200, k) for k in range(201, 240)] + [(None, 1), (3, None)]
    got = connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    want = components(real, {x for p in real for x in p})
    assert {r.id: r.component for r in got} == want and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
