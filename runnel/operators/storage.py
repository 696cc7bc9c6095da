"""Hour-partitioned Parquet: writing, manifests, compaction, retention, orphans, additive upserts."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.times import partition_columns
from ..model import PARTITIONS


def write_partitioned(records: DataFrame, path: str, mode: str = "append", records_per_file: int = 1_000_000, salts: int = 1) -> None:
    """Writes records below year=/month=/day=/hour=. Rows of an hour go to `salts` tasks, so a hot hour need not be one."""
    hours = records.withColumns({k: v for k, v in partition_columns(F.col("_ingested_at")).items()})
    keys = [*PARTITIONS] + ([F.pmod(F.xxhash64("_sequence"), F.lit(salts))] if salts > 1 else [])
    hours.repartition(*keys).sortWithinPartitions(*PARTITIONS, "_sequence").write.mode(mode).option("maxRecordsPerFile", records_per_file).option("parquet.bloom.filter.enabled#_record_id", "true").partitionBy(*PARTITIONS).parquet(path)


def manifest(records: DataFrame) -> DataFrame:
    """A row for each hour: records, payload bytes, first and last sequence and time."""
    hours = records if set(PARTITIONS) <= set(records.columns) else records.withColumns(partition_columns(F.col("_ingested_at")))
    return hours.groupBy(*PARTITIONS).agg(
        F.count("*").alias("record_count"), F.sum(F.octet_length("payload")).alias("total_bytes"), F.min("_sequence").alias("min_sequence"), F.max("_sequence").alias("max_sequence"),
        F.min("_ingested_at").alias("min_timestamp"), F.max("_ingested_at").alias("max_timestamp"),
    )


def file_stats(records: DataFrame) -> DataFrame:
    return records.groupBy(F.input_file_name().alias("file")).agg(F.min("_sequence").alias("min_sequence"), F.max("_sequence").alias("max_sequence"), F.count("*").alias("record_count"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, bytes) of the data files below path, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def compaction_candidates(files: DataFrame, min_files: int = 10) -> DataFrame:
    """Partitions (columns year, month, day, hour of files) with at least min_files files."""
    return files.groupBy(*PARTITIONS).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).where(F.col("files") >= min_files)


def compact(spark: SparkSession, path: str, target: str, min_files: int = 10, target_bytes: int = 128 << 20) -> DataFrame:
    """Writes the crowded partitions of path anew to target, which must not be there yet, in files of about target_bytes,
    as one Spark job, and returns the log (partition, files, bytes). Readers then go to `generation`, which has the other
    partitions too: files under a running streaming source are never overwritten."""
    files = list_files(spark, path)
    parts = files.select("bytes", *[F.regexp_extract("path", rf"{p}=(\d+)", 1).cast("int").alias(p) for p in PARTITIONS])
    log = compaction_candidates(parts, min_files)
    split = log.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("bytes") / target_bytes)).cast("int"))
    rows = spark.read.parquet(path).join(split.select(*PARTITIONS, "pieces"), list(PARTITIONS))
    piece = F.pmod(F.xxhash64("_sequence"), F.col("pieces"))
    rows.withColumn("_piece", piece).repartition(*PARTITIONS, "_piece").drop("_piece", "pieces").write.mode("error").partitionBy(*PARTITIONS).parquet(target)
    return log


def generation(spark: SparkSession, path: str, target: str) -> DataFrame:
    """All records after compact(path, target): those of the partitions that target has from there, the others from path.
    The partitions of target come from its listing, a row an hour."""
    done = list_files(spark, target).select(*[F.regexp_extract("path", rf"{p}=(\d+)", 1).cast("int").alias(p) for p in PARTITIONS]).distinct()
    old = spark.read.parquet(path)
    return old.join(done, list(PARTITIONS), "left_anti").select(*old.columns).unionByName(spark.read.parquet(target))


def log_compaction(log: DataFrame, at: Column, path: str) -> None:
    """Appends what compact returned to the compaction log: time, partition, files and bytes."""
    log.select(at.alias("at"), *PARTITIONS, "files", "bytes").write.mode("append").parquet(path)


def stream_snapshot(records: DataFrame, stream: str = "_stream_id") -> DataFrame:
    """A row for each stream: records, payload bytes, last sequence, first and last time, hours with records."""
    hour = F.date_trunc("hour", "_ingested_at")
    by_hour = records.groupBy(stream, hour.alias("_hour")).agg(
        F.count("*").alias("n"), F.sum(F.octet_length("payload")).alias("b"), F.max("_sequence").alias("s"), F.min("_ingested_at").alias("t0"), F.max("_ingested_at").alias("t1")
    )
    return by_hour.groupBy(stream).agg(
        F.sum("n").alias("record_count"), F.sum("b").alias("total_bytes"), F.max("s").alias("last_sequence"), F.min("t0").alias("first_timestamp"), F.max("t1").alias("last_timestamp"), F.count("*").alias("partitions")
    )


def expired_by_age(partitions: DataFrame, now: datetime, days: int) -> DataFrame:
    """Hours that end before now - days."""
    start = F.make_timestamp_ntz("year", "month", "day", "hour", F.lit(0), F.lit(0)) if hasattr(F, "make_timestamp_ntz") else F.make_timestamp("year", "month", "day", "hour", F.lit(0), F.lit(0))
    return partitions.where(start < F.date_trunc("hour", F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days")).cast("timestamp_ntz"))


def expired_by_size(partitions: DataFrame, max_bytes: int, min_records: int = 0) -> DataFrame:
    """The oldest hours beyond max_bytes counted from the newest; the newest hours that together hold min_records stay.
    partitions has a row for each hour, so one ordered pass over it is small."""
    newest = Window.orderBy(*[F.desc(p) for p in PARTITIONS])
    sums = partitions.withColumns({"_bytes": F.sum("total_bytes").over(newest), "_before": F.coalesce(F.sum("record_count").over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return sums.where((F.col("_bytes") > max_bytes) & (F.col("_before") >= min_records)).drop("_bytes", "_before")


def orphans(listed: DataFrame, referenced: DataFrame, older_than: Column | None = None) -> DataFrame:
    """Listed files that nothing refers to and that are old enough."""
    left = listed.join(referenced, "path", "left_anti")
    return left if older_than is None else left.where(F.col("modified") < older_than)


def add_up(table: DataFrame, delta: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """table with the counts of delta added; new keys are new rows."""
    return table.select(*keys, *sums).unionByName(delta.select(*keys, *sums)).groupBy(*keys).agg(*[F.sum(F.coalesce(s, F.lit(0))).alias(s) for s in sums])


def replace_rows(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows of the same keys replaced by those of new."""
    return table.join(new.select(*keys), keys, "left_anti").select(*table.columns).unionByName(new)
