"""A training corpus from raw documents: language, near duplicates, benchmark passages, mix, token shards.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before has kept, and gives documents back with
their columns; the last writes token shards and returns what they hold. Between stages the rows are written as Parquet to
the shared folder and read again, so a lost executor costs no finished stage; a stage's rows are deleted when the next
stage has written its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runnel.llm import decontaminate, language_id, minhash_dedup, mixing, token_shards
from runnel.llm.core import fresh_path, held_out_mod, read, remove, unused
from runnel.llm.queries import tokenizer_path


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in gone; rows without a doc_id stay."""
    return docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


#: Predicted languages whose documents stay; None for all that the documents themselves teach.
WANTED: frozenset[str] | None = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str, wanted: frozenset[str] | None = WANTED) -> DataFrame:
    """Documents whose predicted language is wanted. Those with a null text or without any letter have none and go; with
    `wanted` None all others stay. Where no row tells its language, nothing can be predicted and all documents with a
    letter stay. Very long texts are looked at whole; repeated rows share a prediction; columns pass unchanged, whatever
    their names; no rows give no rows."""
    model = language_id.fit(docs, held_out_mod("doc_id", 4) != 2)
    lang = unused("lang_pred", docs.columns)
    names = (lang, unused("score", [*docs.columns, lang]))
    if not model.families:
        # any language will do to tell texts with letters from others
        model = language_id.Model(["any"], {"any": ["any"]})
        wanted = None
    judged = language_id.identify(docs, model, names=names)
    told = F.col(lang) != language_id.UNDETERMINED
    return judged.where(told if wanted is None else told & F.col(lang).isin(*wanted)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates. Rows that share a doc_id are one document: the row with the least
    text hash stays. Rows without a doc_id, and those without words, have no duplicates and stay. Very long texts are
    compared whole; other columns pass unchanged."""
    judged = minhash_dedup.near_duplicates(docs)
    left = _without(docs, judged.where("not kept"))
    repeated = judged.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.limit(1).count():
        row = F.struct(*docs.columns)
        again = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct(F.xxhash64("text"), "text")).alias("row")).select("row.*")
        left = _without(left, repeated).unionByName(again)
    return left


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not made up of benchmark passages. Each row is judged by its own text, whatever its doc_id;
    null and wordless texts stay; repeated rows share a verdict; other columns pass unchanged, whatever their names."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. A null source is a source of its own; null and empty texts add no words;
    rows that share a doc_id share a coin; columns pass unchanged, whatever their names; no rows give no rows."""
    return mixing.mixed_documents(docs)


def write_token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token shards of all documents hold: (doc_id, start, n_tokens, ids_crc32). Null texts are empty documents;
    rows without a doc_id come first; repeated rows are all written; other columns are not looked at. The shards stay."""
    folder = fresh_path(spark, "corpus-shards")
    return token_shards.read_shards(spark, folder, token_shards.write_shards(docs, folder, tokenizer_path()))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_token_shards),
]

#: Token ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
