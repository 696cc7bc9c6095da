"""One query for each operator over its whole table, with production parameters, and DuckDB SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_ann, decontaminate, language_id, license_scan, minhash_dedup, mixing, quality_rules, token_shards, toxicity, url_filter
from .core import fresh_path, held_out_mod, kept, read

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-shards")
    manifest = token_shards.write_shards(read(spark, sf_dir, "documents"), folder, tokenizer_path())
    return token_shards.read_shards(spark, folder, manifest)


def op4_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return additive_ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = held_out_mod("doc_id", 4) == 2
    model = language_id.fit(docs, ~held_out)
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = held_out_mod("doc_id", 4) == 2
    measured = kept(quality_rules.statistics(read(spark, sf_dir, "documents")))
    labels = read(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    model = quality_rules.fit(measured, labels)
    return quality_rules.score(measured, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: Sentences that score less are harmless: some 30 times the score of a sentence whose words tell nothing.
TOXIC_LEAST = 0.01


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = held_out_mod("doc_id", 5) == 0
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("toxic").alias("label"))
    settings = toxicity.Settings(least=TOXIC_LEAST)
    scored = toxicity.score(docs, toxicity.fit(docs, labels, settings), settings)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_minhash_dedup, op2_url_filter, op3_token_shards, op4_additive_ann, op5_decontaminate, op6_language_id,
        op7_quality_rules, op8_mixing, op9_toxicity, op10_license_scan,
    )
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
sized AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
parts AS (SELECT doc_id, hash(unnest(s)) AS g FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM parts a JOIN parts b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
reach AS (
  SELECT doc_id, doc_id AS pos FROM sized UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.pos),
least AS (SELECT doc_id, min(pos) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN least USING (doc_id)
""",
    "op4_additive_ann": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS norm FROM v),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) / (q.norm * c.norm) AS score
  FROM n q JOIN n c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op5_decontaminate": rf"""
WITH docs AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
items AS (
  SELECT item_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
runs AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS run
  FROM items WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM runs),
places AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS pos FROM docs, lengths WHERE len(w) >= n),
hits AS (SELECT p.doc_id, p.n, p.pos, r.item_id FROM places p JOIN runs r ON r.n = p.n AND r.run = array_to_string(p.w[p.pos:p.pos + p.n - 1], ' ')),
hit_words AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS word FROM hits),
n_hits AS (SELECT doc_id, count(*) AS n_hit FROM hit_words GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN n_hits USING (doc_id) LEFT JOIN found USING (doc_id)
""",
    "op8_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3 * source_size AS cap FROM sums),
ordered AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    sum(source_size) OVER () AS total FROM weighed),
level AS (SELECT min_by((total - full_)::DOUBLE / rest, cap / weight) AS level FROM ordered WHERE weight * ((total - full_)::DOUBLE / rest) <= cap),
plan AS (SELECT source, source_size, least(weight * level, cap::DOUBLE) AS target FROM weighed, level),
rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0 END AS rate,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':17'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS coin
  FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size)::BIGINT AS taken FROM rated
""",
}
