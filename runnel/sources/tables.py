"""Sources: record streams on disk, JSON Lines, CSV and Parquet imports, and events seen as records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import RECORD


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Inputs between these sizes in bytes, the second for each core, are dealt out before heavy work on their rows.
SPREAD_FROM, SPREAD_TO = 1 << 20, 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt out over all cores where it is too small for Spark's splits of files to occupy them. A larger input, which
    has splits enough, and a stream stay as they are, so nothing is shuffled at scale."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if SPREAD_FROM <= size < cores * SPREAD_TO else df


def stored_records(spark: SparkSession, path: str) -> DataFrame:
    """A stream written by write_partitioned, with its partition columns."""
    return spark.read.parquet(path)


def event_records(spark: SparkSession, folder: str, stream: str = "events") -> DataFrame:
    """The events table as records; the payload holds user_id, event_type, value and props."""
    return as_records(table(spark, folder, "events"), stream)


def event_stream(spark: SparkSession, folder: str, stream: str = "events") -> DataFrame:
    """The events table as a streaming read of records."""
    path = f"{folder}/events.parquet"
    return as_records(spark.readStream.schema(spark.read.parquet(path).schema).option("recursiveFileLookup", "true").parquet(path), stream)


def as_records(events: DataFrame, stream: str) -> DataFrame:
    body = F.to_json(F.struct("user_id", "event_type", "value"))
    payload = F.concat(F.substring(body, 1, F.length(body) - 1), F.lit(',"props":'), F.coalesce("props", F.lit("null")), F.lit("}"))
    return events.select(
        F.concat(F.lit("rec_"), F.col("event_id").cast("string")).alias("_record_id"), F.lit(stream).alias("_stream_id"), (F.col("event_id") + 1).alias("_sequence"), F.col("ts").alias("_ingested_at"), payload.alias("payload"),
    )


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, text) of text files; numbers count within a file, from 1. Files are read in splits: a line's
    number is its place in its split and the lines of the splits before, of which there is one row each."""
    rows = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"),
        F.regexp_replace("value", "\r$", "").alias("text"),
    )
    splits = rows.groupBy("file", "split").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.join(splits.select("file", "split", "first", before.alias("before")), ["file", "split"])
    return numbered.select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line_number"), "text")


def csv_payloads(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True)
    return rows.select(F.to_json(F.struct("*")).alias("payload"))


def parquet_payloads(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select(F.to_json(F.struct("*")).alias("payload"))


def tail(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A streaming read of a stream's folder: what is there, then what comes, each record once."""
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(path)
