import random

import pyarrow as pa
import pytest
from brute import token_rows

from runnel.llm import token_shards
from runnel.llm.core import fresh_path

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def path():
    from runnel.llm.queries import tokenizer_path

    return tokenizer_path()


def written(spark, rows, path, settings=token_shards.Settings(), schema="doc_id bigint, text string"):
    folder = fresh_path(spark, "test-shards")
    manifest = token_shards.write_shards(spark.createDataFrame(rows, schema), folder, path, settings)
    return folder, manifest, token_shards.read_shards(spark, folder, manifest)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


def test_round_trip_in_many_small_shards(spark, data, path):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(-5, "below zero"), (10**15, "far\u00a0 out \u2003x"), (10**15 + 1, "a" * 5000), (10**15 + 2, " \n\n  \t x\r\n ")]
    small = token_shards.Settings(block_bytes=1 << 10, shard_bytes=1 << 14)
    folder, manifest, got = written(spark, rows, path, small)
    assert rows_of(got) == token_rows(rows, tokenizers.Tokenizer.from_file(path))
    assert manifest.count() > 3


def test_lookup(spark, path):
    rows = [(k * 3, f"text number {k} " * (k % 50)) for k in range(300)]
    folder, manifest, _ = written(spark, rows, path, token_shards.Settings(block_bytes=512))
    tok = tokenizers.Tokenizer.from_file(path)
    shards = [r.shard for r in manifest.collect()]
    for doc, text in (rows[0], rows[123], rows[299]):
        found = [list(x) for s in shards for x in token_shards.lookup(folder, s, doc)]
        assert found == [[*tok.encode(text, add_special_tokens=False).ids, 2]]
    assert [x for s in shards for x in token_shards.lookup(folder, s, 4)] == []


def test_edges(spark, path):
    tok = tokenizers.Tokenizer.from_file(path)
    rows = [(2, None), (1, ""), (2, "b"), (2, "b"), (None, "n"), (7, "long word " * 40_000)]
    _, _, got = written(spark, rows, path)
    assert rows_of(got) == token_rows(rows, tok)
    assert rows_of(written(spark, [], path)[2]) == []
    _, _, got = written(spark, [(1, "x", "y", 3)], path, schema="doc_id bigint, text string, start string, key int")
    assert rows_of(got) == token_rows([(1, "x")], tok)


@pytest.mark.parametrize("step", [5, 1 << 20])
def test_cut_texts_have_the_ids_of_whole_texts(path, step):
    parts = ["a", "B", " ", "  ", "\n", "\t", "\r", "1", "42", ".", ",", "'", "'s", "'ll", "don't", "é", "ß", "“", " ", " ", "　", "\x1c", "\x00", "中", "²", "٣", "$", "<|endoftext|>", "́", "😀", "_", "-"]
    draw = random.Random(11)
    texts = ["".join(draw.choices(parts[: draw.choice((18, len(parts)))], k=draw.randint(0, 30))) for _ in range(3000)] + [None, "", "x" * 3000]
    encode = token_shards.Encoder(path, 500)
    got = [list(ids) for ids in encode(pa.array(texts, pa.string()), step)]
    assert got == [encode.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert list(encode(pa.array([], pa.string()))) == []
