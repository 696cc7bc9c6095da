"""The corpus pipeline against plain Python, on whole small tables."""

import brute
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("tokenizers")


def test_run_against_brute_force(spark, data):
    from runnel.llm.queries import tokenizer_path

    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [d for d in docs if d[1] and any(c.isalpha() for c in d[1])]
    groups = brute.near_duplicates([d[:2] for d in docs])
    docs = [d for d in docs if groups[d[0]][1] == d[0]]
    dirty = {r[0] for r in brute.contamination([d[:2] for d in docs], items) if r[5]}
    docs = [d for d in docs if d[0] not in dirty]
    copies = {r[0]: r[4] for r in brute.mixture(docs)}
    taken = [d[:2] for d in docs for _ in range(copies[d[0]])]
    want = brute.token_rows(taken, tokenizers.Tokenizer.from_file(tokenizer_path()))
    got = corpus_pipeline.run(spark, data)
    assert sorted((tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1]) == want


def test_stages_keep_the_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns


def test_stages_with_nulls_repeats_and_no_rows(spark, data):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, "the red house", "en", "a", 1), (1, "the red house", "en", "a", 1), (2, None, None, None, None), (None, "a small garden here", "en", None, 3)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, data).collect()
            assert bool(out) == bool(given)
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, schema), data).collect()
    assert len(kept) == 3


def test_stages_with_clashing_columns_and_no_languages(spark, data):
    """Columns with the names that operators give theirs come out as they went in."""
    schema = "doc_id bigint, text string, lang string, source string, score double, lang_pred string, size bigint, target string, copies bigint, contaminated boolean, row string, component string"
    rows = [(k, f"a house number {k} by the sea and the old town", None, "ab"[k % 2], 0.5, "mine", 7, "t", 9, True, "r", "c") for k in range(12)]
    docs = spark.createDataFrame(rows + [(99, "12 34 ½", None, "a", 0.5, "mine", 7, "t", 9, True, "r", "c")], schema)
    kept = corpus_pipeline.identify_language(spark, docs, data)
    assert sorted(map(tuple, kept.collect())) == rows
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_contaminated, corpus_pipeline.mix_sources):
        out = stage(spark, docs, data)
        assert out.columns == docs.columns
        assert {tuple(r)[4:] for r in out.collect()} == {rows[0][4:]}


def test_wanted_languages(spark, data):
    rows = [(k, ["the house and the garden are green", "das Haus und der Garten sind grün"][k % 2], ["en", "de"][k % 2]) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r.lang for r in corpus_pipeline.identify_language(spark, docs, data, frozenset({"de"})).collect()} == {"de"}


def test_contamination_is_judged_row_by_row(spark, data):
    item = spark.read.parquet(f"{data}/benchmark.parquet").where("text is not null").first().text
    rows = [(None, item), (1, item), (1, "a clean text"), (None, "another clean text")]
    kept = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), data).collect()
    assert sorted(r.text for r in kept) == ["a clean text", "another clean text"]
