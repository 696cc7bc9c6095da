"""Counts, histograms, quantiles and alert conditions over time windows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of histogram buckets, in seconds.
LATENCY_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def bucket_of(ts: Column, minutes: int) -> Column:
    """Start of the fixed window that a time without zone falls in."""
    return F.window(ts, f"{minutes} minutes")["start"]


def daily_stats(records: DataFrame) -> DataFrame:
    return records.groupBy(F.to_date("_ingested_at").alias("date")).agg(F.count("*").alias("records_ingested"), F.sum(F.octet_length("payload")).alias("bytes_ingested"))


def counters(rows: DataFrame, labels: list[str]) -> DataFrame:
    return rows.groupBy(*labels).agg(F.count("*").alias("total"))


def histogram(rows: DataFrame, value: str, bounds: tuple[float, ...], labels: list[str] | None = None) -> DataFrame:
    """Cumulative counts (le, bucket_count) by label in one partial aggregate; the last bucket is infinite."""
    labels = labels or []
    sums = rows.groupBy(*labels).agg(*[F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"b{k}") for k, b in enumerate(bounds)], F.count(value).alias("b_inf"))
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{k}").alias("bucket_count")) for k, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("b_inf").alias("bucket_count")))
    return sums.select(*labels, F.explode(pairs).alias("p")).select(*labels, "p.le", "p.bucket_count")


def quantile(buckets: DataFrame, q: float, labels: list[str] | None = None) -> DataFrame:
    """Linear interpolation in the bucket that the q-th part of the counts falls in; beyond the last finite bound, it."""
    labels = labels or []
    order = Window.partitionBy(*labels).orderBy("le") if labels else Window.partitionBy(F.lit(1)).orderBy("le")
    every = Window.partitionBy(*labels) if labels else Window.partitionBy(F.lit(1))
    rows = buckets.withColumns(
        {"_low": F.coalesce(F.lag("le").over(order), F.lit(0.0)), "_below": F.coalesce(F.lag("bucket_count").over(order), F.lit(0)), "_rank": F.max("bucket_count").over(every) * F.lit(q)}
    )
    hit = rows.where((F.col("bucket_count") >= F.col("_rank")) & ((F.col("_below") < F.col("_rank")) | (F.col("_low") == 0.0) & (F.col("_rank") == 0)))
    inner = F.col("_low") + (F.col("le") - F.col("_low")) * (F.col("_rank") - F.col("_below")) / (F.col("bucket_count") - F.col("_below"))
    return hit.select(*labels, F.when(F.col("le") == float("inf"), F.col("_low")).otherwise(inner).alias("quantile"))


def error_ratio(rows: DataFrame, ts: str, bad: Column, minutes: int, threshold: float) -> DataFrame:
    out = rows.groupBy(bucket_of(F.col(ts), minutes).alias("bucket")).agg(F.count("*").alias("n"), F.sum(bad.cast("bigint")).alias("errors"))
    return out.withColumn("ratio", F.col("errors") / F.col("n")).withColumn("firing", F.col("ratio") > threshold)


def windows_between(spark, start: datetime, end: datetime, minutes: int) -> DataFrame:
    """All windows from start on, before end, with or without rows."""
    n = int((end - start).total_seconds() // (60 * minutes))
    base = F.lit(start).cast("timestamp_ntz")
    return spark.range(n).select(F.expr(f"timestampadd(MINUTE, cast(id * {minutes} as int), {_literal(start)})").alias("bucket")) if n > 0 else spark.range(0).select(base.alias("bucket"))


def _literal(t: datetime) -> str:
    return f"timestamp_ntz'{t:%Y-%m-%d %H:%M:%S}'"


def silent_windows(rows: DataFrame, ts: str, start: datetime, end: datetime, minutes: int) -> DataFrame:
    """Windows without a row."""
    busy = rows.select(bucket_of(F.col(ts), minutes).alias("bucket")).distinct()
    return windows_between(rows.sparkSession, start, end, minutes).join(busy, "bucket", "left_anti")


def silent_while_connected(rows: DataFrame, ts: str, gauge: DataFrame, gauge_ts: str, value: str, start: datetime, end: datetime, minutes: int) -> DataFrame:
    """Windows without a row of rows in which the gauge of active connections was above 0."""
    connected = gauge.where(F.col(value) > 0).select(bucket_of(F.col(gauge_ts), minutes).alias("bucket")).distinct()
    return silent_windows(rows, ts, start, end, minutes).join(connected, "bucket", "left_semi")


def slow_windows(rows: DataFrame, ts: str, value: str, bounds: tuple[float, ...], q: float, minutes: int, threshold: float) -> DataFrame:
    """Windows whose q-quantile, read off the histogram, is above the threshold: (bucket, quantile)."""
    windows = rows.withColumn("bucket", bucket_of(F.col(ts), minutes))
    return quantile(histogram(windows, value, bounds, ["bucket"]), q, ["bucket"]).where(F.col("quantile") > threshold)


def over_threshold(rows: DataFrame, ts: str, minutes: int, threshold: float) -> DataFrame:
    out = rows.groupBy(bucket_of(F.col(ts), minutes).alias("bucket")).agg(F.count("*").alias("n"))
    return out.where(F.col("n") / (60.0 * minutes) > threshold)


def held(firing: DataFrame, bucket: str, minutes: int, at_least: int, labels: list[str] | None = None) -> DataFrame:
    """Stretches in which windows (rows of firing) follow without a gap, at least so many of them: (from, to, windows)."""
    labels = labels or []
    number = F.floor(F.unix_micros(F.col(bucket).cast("timestamp")) / (minutes * 60_000_000))
    order = Window.partitionBy(*labels).orderBy(bucket) if labels else Window.partitionBy(F.lit(1)).orderBy(bucket)
    runs = firing.withColumn("_island", number - F.row_number().over(order))
    return runs.groupBy(*labels, "_island").agg(F.min(bucket).alias("since"), F.max(bucket).alias("until"), F.count("*").alias("windows")).where(F.col("windows") >= at_least).drop("_island")


def latest_gauge(rows: DataFrame, ts: str, value: str, labels: list[str]) -> DataFrame:
    return rows.groupBy(*labels).agg(F.max_by(value, ts).alias("value"))


def low_gauges(rows: DataFrame, order: list[str], value: str, labels: list[str], least: float) -> DataFrame:
    """Labels whose latest value, by the columns of order, is below least. A latest value that is null is not below."""
    latest = rows.groupBy(*labels).agg(F.max_by(F.struct(value), F.struct(*order)).alias("r")).select(*labels, f"r.{value}")
    return latest.where(F.col(value) < least)


def health(components: DataFrame) -> DataFrame:
    """The worst of (component, status)."""
    rank = F.when(F.col("status") == "unhealthy", 2).when(F.col("status") == "degraded", 1).otherwise(0)
    return components.agg(F.element_at(F.array(F.lit("healthy"), F.lit("degraded"), F.lit("unhealthy")), F.coalesce(F.max(rank), F.lit(0)) + 1).alias("status"))
