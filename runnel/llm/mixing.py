"""Mixing sources to target weights, with DataFrame operations only.

Words are added up for each source; targets share all words by weight, stop at a multiple of what a source has and pass
the excess on; a document is then taken floor(rate) times, and once more by a coin that is seeded by its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import kept

#: Up to so many sources (about 5 MB) are sent to all executors; more are joined by a shuffle with salted keys.
BROADCAST_SOURCES = 50_000


def words_of(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null. Bigint."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sizes (source, source_size), a row for each source: with weight and target added.

    Sources in code point order, null last, weigh `weights` in turn. They share the sum of sizes by weight; a target
    stops at `most` times its source's size and the excess is shared by weight among the rest until none is above. The
    level at which that ends is found by rounds of one small aggregate; no round looks at documents.
    """
    # places in code point order without one task that sorts all: ranges, then each range's count
    ranged = kept(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    weighed = kept(ranged.join(F.broadcast(before), "range").select("source", "source_size", weight.alias("weight")))
    cap, w = F.col("source_size") * most, F.col("weight")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        # capped so far: sources whose share at this level is above their cap
        open_ = F.lit(True) if level is None else w * F.lit(level) <= cap
        full, rest = weighed.agg(F.coalesce(F.sum(F.when(~open_, cap)), F.lit(0)), F.coalesce(F.sum(F.when(open_, w)), F.lit(0.0))).first()
        if not rest:
            break
        higher = (total - full) / rest
        if level is not None and higher <= level:
            break
        level = higher
    share = cap.cast("double") if level is None else F.least(w * F.lit(level), cap.cast("double"))
    return weighed.withColumn("target", share)


def coin(id_column: Column, seed: int) -> Column:
    """A number from 0 to under 1 that depends on the id and the seed alone."""
    text = F.concat(F.coalesce(id_column.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with size, source_size, target and copies added under these names (columns of docs that are called so are
    replaced). copies is floor(target / source_size), plus one when the document's coin falls under the rest.

    Null and empty texts have size 0; they are taken like others of their source and add no words. A source without
    words has target 0 and its documents are taken once, as they have no words. A null source is a source of its own.
    Very long texts are counted whole.
    Rows that share an id share a coin. An empty table gives no rows. Reruns agree.
    """
    added = ("size", "source_size", "target", "copies")
    docs = docs.drop(*added).withColumn("size", words_of(F.col(text_col)))
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"))
    plan = kept(source_targets(sizes, weights, most)).select(F.col("source").alias("_source"), "source_size", "target")
    if plan.count() <= BROADCAST_SOURCES:
        mixed = docs.join(F.broadcast(plan), F.col(source_col).eqNullSafe(F.col("_source")), "left")
    else:
        salts = 64
        salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        dealt = docs.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int"))
        same = F.col(source_col).eqNullSafe(F.col("_source")) & (dealt["_salt"] == salted["_salt"])
        mixed = dealt.join(salted, same, "left").drop("_salt")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0)
    extra = (coin(F.col(id_col), seed) < rate - F.floor(rate)).cast("bigint")
    return mixed.drop("_source").withColumn("copies", F.floor(rate).cast("bigint") + extra)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs, each row as often as the mix takes it, with the columns of docs as they are, whatever their names. Nulls,
    repeats and empty tables are as in mix(). Names of options are those of mix()."""
    asked = [options.setdefault(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *asked)
    mixed = mix(rows, **options).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")).select("row.*")
