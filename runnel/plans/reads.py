"""Reads of a stream: time ranges with pages, key lookups, replays. A time range becomes predicates on the timestamp and,
where the table has hour partitions, on these, so files of other hours are never listed into tasks."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.names import decode_cursor, encode_cursor
from ..model import DEFAULT_LIMIT, MAX_LIMIT, MAX_RANGE_DAYS, PARTITIONS, ValidationError


def clamp_limit(limit: int | None) -> int:
    return DEFAULT_LIMIT if not limit or limit <= 0 else min(limit, MAX_LIMIT)


def check_range(start: datetime, end: datetime, max_days: int = MAX_RANGE_DAYS) -> None:
    if end < start:
        raise ValidationError("the end is before the start")
    if end - start > timedelta(days=max_days):
        raise ValidationError(f"the range is longer than {max_days} days")


def hours(start: datetime, end: datetime) -> list[datetime]:
    """The hours that a closed range touches."""
    at = start.replace(minute=0, second=0, microsecond=0)
    return [at + timedelta(hours=k) for k in range(int((end - at).total_seconds() // 3600) + 1)] if end >= start else []


def partition_predicate(start: datetime, end: datetime) -> Column:
    """The hours as a predicate on year, month, day and hour that partition pruning understands: whole days between, and
    hour bounds on the first and last day."""
    out, day = None, start.replace(hour=0, minute=0, second=0, microsecond=0)
    while day <= end:
        one = (F.col("year") == day.year) & (F.col("month") == day.month) & (F.col("day") == day.day)
        if day.date() == start.date():
            one = one & (F.col("hour") >= start.hour)
        if day.date() == end.date():
            one = one & (F.col("hour") <= end.hour)
        out = one if out is None else out | one
        day += timedelta(days=1)
    return out if out is not None else F.lit(False)


def in_range(records: DataFrame, start: datetime, end: datetime, stream: str | None = None) -> DataFrame:
    """Records of the closed range, of one stream if it is named."""
    if stream:
        records = records.where(F.col("_stream_id") == stream)
    if set(PARTITIONS) <= set(records.columns):
        records = records.where(partition_predicate(start, end))
    return records.where(F.col("_ingested_at").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def wire(records: DataFrame) -> DataFrame:
    return records.select(
        F.col("_record_id").alias("record_id"), F.col("_stream_id").alias("stream_id"), F.col("_sequence").alias("sequence_number"),
        F.unix_micros(F.col("_ingested_at").cast("timestamp")).alias("timestamp_unix_micros"), "payload",
    )


def wire_text(records: DataFrame) -> DataFrame:
    """Records as they go out as JSON: the time as RFC 3339 text in UTC, without zeros at the end of the fraction."""
    time = F.date_format("_ingested_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return records.select(
        F.col("_record_id").alias("record_id"), F.col("_sequence").alias("sequence_number"),
        F.concat(F.regexp_replace(time, r"\.?0+$", ""), F.lit("Z")).alias("ingested_at"), "payload",
    )


def range_metadata(records: DataFrame, start: datetime, end: datetime, stream: str | None = None) -> DataFrame:
    """What a range read has to look at, in one row: partitions_scanned (hours that the range touches and that have
    records), records_scanned (all records of these hours) and records_matched. Only time columns are read."""
    check_range(start, end)
    first = start.replace(minute=0, second=0, microsecond=0)
    last = end.replace(minute=0, second=0, microsecond=0) + timedelta(hours=1) - timedelta(microseconds=1)
    touched = in_range(records, first, last, stream)
    hit = F.col("_ingested_at").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    by_hour = touched.groupBy(F.date_trunc("hour", "_ingested_at").alias("hour")).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return by_hour.agg(F.count("*").alias("partitions_scanned"), total("n").alias("records_scanned"), total("hits").alias("records_matched"))


def range_rows(records: DataFrame, start: datetime, end: datetime, limit: int | None = None, cursor: str | None = None, more: int = 0, stream: str | None = None) -> DataFrame:
    """A page of a range in order of time, then sequence: what follows the cursor, at most limit rows (plus `more`). A cursor
    names the last record that was seen by its sequence; where the range has it, its time is looked up, so records whose
    times and sequences are in different order are all met once."""
    check_range(start, end)
    page = in_range(records, start, end, stream)
    after = decode_cursor(cursor)
    if after is not None:
        seen = page.where(F.col("_sequence") == after).agg(F.max("_ingested_at")).first()[0]
        at, later = F.col("_ingested_at"), F.col("_sequence") > after
        if seen is not None:
            seen = F.lit(seen).cast("timestamp_ntz")
            later = (at > seen) | ((at == seen) & later)
        page = page.where(later)
    return page.orderBy("_ingested_at", "_sequence").limit(clamp_limit(limit) + more)


@dataclass(frozen=True)
class Page:
    rows: list
    next_cursor: str | None


def query_time_range(records: DataFrame, start: datetime, end: datetime, limit: int | None = None, cursor: str | None = None, stream: str | None = None) -> Page:
    """A page for a caller: at most 10,000 rows, and a cursor if rows are left."""
    n = clamp_limit(limit)
    rows = wire(range_rows(records, start, end, limit, cursor, more=1, stream=stream)).collect()
    return Page(rows[:n], encode_cursor(rows[n - 1]["sequence_number"]) if len(rows) > n else None)


def key_predicate(field: str, value: str) -> Column:
    """Equality on the record id, the stream, or the text of a top-level field of the payload; missing never matches."""
    if field in ("_record_id", "_stream_id"):
        return F.col(field) == value
    x = F.try_variant_get(V.parse(F.col("payload")), V.json_path([field]), "variant")
    return ~V.missing(x) & (V.text_of(x) == value)


def lookup(records: DataFrame, field: str, value: str, as_of: datetime, window: timedelta = timedelta(hours=24)) -> DataFrame:
    """The latest record within the window before as_of whose key matches: one row or none."""
    recent = in_range(records, as_of - window, as_of)
    return recent.where(key_predicate(field, value)).orderBy(F.desc("_ingested_at"), F.desc("_sequence")).limit(1)


def latest_by(records: DataFrame, key: Column, name: str) -> DataFrame:
    """The latest record of each key, by partial aggregation."""
    row = F.struct(*records.columns)
    order = F.struct("_ingested_at", "_sequence")
    return records.groupBy(key.alias(name)).agg(F.max_by(row, order).alias("r")).select(name, "r.*")


def replay(records: DataFrame, start_sequence: int | None = None, start: datetime | None = None) -> DataFrame:
    """History from a sequence (inclusive) or a time on, flagged as such; order it where it is used."""
    if start is not None:
        records = records.where(F.col("_ingested_at") >= F.lit(start).cast("timestamp_ntz"))
    if start_sequence is not None:
        records = records.where(F.col("_sequence") >= start_sequence)
    return records.withColumn("is_historical", F.lit(True))
