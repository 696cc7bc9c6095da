"""Language, quality, toxicity: held-out accuracy, and the edges."""

import pytest
from pyspark.sql import functions as F

from runnel.llm import language_id, license_scan, quality_rules, toxicity
from runnel.llm import queries as Q

DATA = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = Q.op6_language_id(spark, DATA).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred != 'und'")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right / n > 0.95


def test_language_edges(spark):
    rows = [(k, "the house and the garden are green", "en") for k in range(30)] + [(100 + k, "das Haus und der Garten sind grün", "de") for k in range(30)] + [(200 + k, "la maison et le jardin sont verts", "fr") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(docs, F.lit(True))
    ask = [(1, None, 0.5), (2, "", 0.5), (3, "12 34 !?", 0.5), (4, "der Garten und das Haus", 0.5), (5, "le jardin et la maison " * 20_000, 0.5), (6, "the garden", 0.5), (6, "the garden", 0.5), (None, "Привет", 0.5)]
    got = language_id.identify(spark.createDataFrame(ask, "doc_id bigint, text string, score double"), model).collect()
    pred = {r.doc_id: r.lang_pred for r in got}
    assert len(got) == len(ask) and all(0 <= r.score <= 1 for r in got)
    assert [pred[k] for k in (1, 2, 3, 4, 5, 6)] == ["und", "und", "und", "de", "fr", "en"]
    nothing = language_id.fit(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}
    single = language_id.fit(docs.where("lang = 'de'"), F.lit(True))
    assert {r.lang_pred for r in language_id.identify(docs, single).collect()} == {"de"}


@pytest.mark.parametrize("query, label", [(Q.op7_quality_rules, "quality"), (Q.op9_toxicity, "toxic")])
def test_labels_held_out(spark, query, label):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", F.col(label).alias("label"))
    got = query(spark, DATA).where("held_out").join(labels, "doc_id").where("label is not null")
    right, n, low, high = got.agg(F.sum((F.col("label") == F.col("predicted")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 50 and right / n > 0.9 and 0 <= low <= high <= 1


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (5, "word " * 60_000)], "doc_id bigint, text string")
    measured = quality_rules.statistics(docs)
    for labels in ([], [(1, 1)], [(1, 0), (3, 1), (None, 1), (3, 0)]):
        model = quality_rules.fit(measured, spark.createDataFrame(labels, "doc_id bigint, label int"))
        got = quality_rules.score(measured, model).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert quality_rules.statistics(docs.limit(0)).collect() == []


def test_quality_model_is_a_column_of_rules(spark):
    r = quality_rules.Rule((("n_words", True, 3.0), ("n_words", False, 9.0)))
    rows = spark.createDataFrame([(3.0,), (4.0,), (9.0,), (9.5,)], "n_words double")
    assert [x[0] for x in rows.select(r.column()).collect()] == [False, True, True, False]


def test_toxicity_learns_from_bags_and_points_at_sentences(spark):
    calm = "the sun is warm today. we walk by the river. bread is on the table."
    rows = [(k, f"{calm} item {k} is here.", 0) for k in range(60)] + [(100 + k, f"{calm} you are a vile grunk number {k}. good night.", 1) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "label"))
    ask = [(1, calm), (2, "we walk by the river. you are a vile grunk! bread."), (3, None), (4, ""), (5, "1 2 3"), (6, calm * 3000 + " vile grunk."), (None, calm), (1, calm)]
    asked = spark.createDataFrame(ask, "doc_id bigint, text string")
    got = toxicity.score(asked, model).collect()
    assert len(got) == 8
    by = {r.doc_id: r.predicted for r in got}
    assert [by[k] for k in (1, 2, 3, 4, 5, 6, None)] == [0, 1, 0, 0, 0, 1, 0]
    told = toxicity.offending_sentences(asked.where("doc_id = 2"), model).collect()
    assert [(r.sentence, r.words) for r in told] == [(1, "you are a vile grunk")]


def test_toxicity_of_long_documents(spark):
    import random

    rng = random.Random(5)
    words = [f"w{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}" for a in range(12) for b in range(12) for c in range(12)]

    def prose(n):
        return " ".join(" ".join(rng.choices(words, k=10)) + "." for _ in range(n // 10))

    lengths = [60, 200, 600, 60, 200, 600, 4000, 20_000]
    rows = [(k, prose(lengths[k % 8]) + (" you are a vile grunk. " if k % 2 else "") + prose(50), k % 2) for k in range(0, 320)]
    rows += [(1000 + k, prose(n), 0) for k, n in enumerate((30_000, 60_000, 100_000, 200_000) * 2)]  # clean
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "label"))
    ask = [(n + k, prose(n)) for n in (20_000, 50_000) for k in range(3)] + [(k, prose(n) + " such a vile grunk. " + prose(100)) for k, n in ((1, 100), (2, 20_000), (3, 100_000))]
    got = {r.doc_id: (r.predicted, r.score) for r in toxicity.score(spark.createDataFrame(ask, "doc_id bigint, text string"), model).collect()}
    assert {k: v for k, v in got.items() if v[0] != (k < 10)} == {}


def test_harmless_sentences_do_not_add_up(spark):
    import random

    rng = random.Random(6)
    words = [f"w{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}" for a in range(12) for b in range(12) for c in range(12)]

    def prose(n):
        return " ".join(" ".join(rng.choices(words, k=10)) + "." for _ in range(n // 10))

    rows = [(k, prose((60, 200, 600)[k % 3]) + (" you are a vile grunk. " if k % 2 else "") + prose(50), k % 2) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    s = toxicity.Settings(least=Q.TOXIC_LEAST)
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "label"), s)
    ask = [(n, prose(n)) for n in (20_000, 100_000, 200_000)] + [(k, prose(n) + " you are a vile grunk. " + prose(100)) for k, n in ((1, 100), (2, 200_000))]
    asked = spark.createDataFrame(ask, "doc_id bigint, text string")
    got = {r.doc_id: (r.predicted, r.score) for r in toxicity.score(asked, model, s).collect()}
    assert {k: v for k, v in got.items() if v[0] != (k < 10)} == {}
    assert {r.words for r in toxicity.offending_sentences(asked, model, s).collect()} == {"you are a vile grunk"}


def test_noisy_or_against_plain_products():
    import math
    import random

    import numpy as np

    rng = random.Random(3)
    z, owner = [rng.uniform(-9, 4) for _ in range(200)], sorted(rng.randrange(20) for _ in range(200))
    for least in (0.0, 0.01, 0.5):
        got = -np.expm1(toxicity._noisy_or(np.array(z), np.array(owner), 20, least))
        for d in range(20):
            clean = 1.0
            for x, o in zip(z, owner):
                p = 1 / (1 + math.exp(-x))
                clean *= 1 - p if o == d and p >= least else 1
            assert math.isclose(got[d], 1 - clean, abs_tol=1e-12)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    for labels in ([], [(1, 1)], [(2, 1), (1, 0)], [(9, 1), (8, 0)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, label int"))
        assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(docs.limit(0), model).collect() == []


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_patience_alignment():
    import random

    rng = random.Random(2)
    for _ in range(60):
        a = [rng.randrange(40) for _ in range(rng.randint(0, 30))]
        b = [x for x in a if rng.random() < 0.8] + [rng.randrange(40) for _ in range(rng.randint(0, 6))]
        pairs = license_scan.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert 0.6 * longest_common(a, b) <= len(pairs) <= longest_common(a, b)
    once = list(range(50))
    assert len(license_scan.patience(once, once[10:] + [99])) == 40


def test_license_scan(spark):
    name, text = next(iter(license_scan.TEMPLATES.items()))
    words = text.split()
    noisy = " ".join(w + (" extra" if k % 6 == 0 else "") for k, w in enumerate(words))
    rows = [(1, text), (2, "intro words " * 500 + noisy.upper() + " tail" * 300), (3, " ".join(words[: len(words) // 3])), (4, None), (5, ""), (6, "nothing of the kind " * 200), (1, text), (None, text)]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id bigint, text string, license string")
    got = license_scan.scan(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert by[1].license == by[2].license == by[None].license == name
    assert by[1].coverage == 1.0 and by[2].first_word >= 990
    assert [by[k].license for k in (3, 4, 5, 6)] == [None] * 4
    assert license_scan.scan(docs.limit(0)).collect() == []


def test_license_scan_tells_every_match(spark):
    t = license_scan.TEMPLATES
    parts = ["MIT", "BSD-2-Clause", "Apache-2.0 notice", "MIT", "GPL-3.0-or-later notice"]
    gap = " some words of another kind in between" * 60
    got = license_scan.scan(spark.createDataFrame([(1, gap.join(t[p] for p in parts)), (2, "none"), (3, None)], "doc_id bigint, text string")).collect()
    by = {r.doc_id: r for r in got}
    assert [m.license for m in by[1].matches] == parts, by[1].matches
    assert all(m.coverage >= 0.95 for m in by[1].matches), by[1].matches
    assert by[1].license == "MIT" and by[1].first_word == 0
    assert by[2].matches == by[3].matches == []


def test_alignment_of_gaps_without_anchors_is_a_longest_common_subsequence():
    import random

    rng = random.Random(7)
    for n in (0, 1, 5, 40, 400):
        for _ in range(4):
            a, b = ([rng.randrange(4) for _ in range(rng.randint(n // 2, n))] for _ in range(2))
            pairs = license_scan._common(a, b, 0, len(a), 0, len(b))[::-1]
            assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
            assert len(pairs) == longest_common(a, b)
    # every word twice, so nothing is an anchor, and far more pairs of words than any small table has
    twice = [rng.randrange(10_000) for _ in range(2_000)] * 2
    near = twice[:1_000] + [-1] + twice[1_001:3_000] + [-2, -3] + twice[3_002:]
    assert len(license_scan.patience([-9] + near + [-9], [-8] + twice + [-8])) >= 3_990


def test_license_scan_against_all_alignments(spark):
    """Every stretch of whole texts aligned with every template, without the bound on words that scan uses."""
    import random

    from brute import plain_words

    rng = random.Random(11)
    templates = {"t0": "a b c d e f g h", "t1": " ".join(f"w{k % 7}" for k in range(30)), "t2": "only these five words count", "t3": " ".join(f"v{k}" for k in range(25))}
    noise = [f"n{k}" for k in range(5)] + ["a", "w1", "w2", "v3", "only"]
    rows = []
    for k in range(60):
        text = rng.choices(noise, k=rng.randint(0, 40))
        for name in rng.sample(list(templates), rng.randint(0, 3)):
            for w in templates[name].split():
                text += [w] * (rng.random() > 0.1) + rng.choices(noise, k=1) * (rng.random() < 0.8)
            text += rng.choices(noise, k=rng.randint(0, 60))
        rows.append((k, " ".join(text).upper() if k % 3 else " ".join(text)))
    number: dict[str, int] = {}
    code = lambda text: [number.setdefault(w, len(number)) for w in plain_words(text)]
    s, names = license_scan.Settings(), list(templates)
    want = {}
    for k, text in rows:
        found = []
        for t, name in enumerate(names):
            n = len(code(templates[name]))
            length, step = s.stretch(n)
            words = code(text)
            for at in range(0, max(1, len(words)), step):
                pairs = license_scan.patience(words[at : at + length], code(templates[name]))
                if len(pairs) >= s.coverage * n and len(pairs) >= s.density * (pairs[-1][0] + 1 - pairs[0][0]):
                    found.append((len(pairs), len(pairs) / n, -t, at + pairs[0][0], at + pairs[-1][0] + 1))
        best = max(found, key=lambda m: (m[0], m[1], m[2]), default=None)
        want[k] = (names[-best[2]], best[0]) if best else (None, 0)
    got = {r.doc_id: (r.license, r.n_matched) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), templates).collect()}
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 20
