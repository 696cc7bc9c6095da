"""Timestamps in payloads, and the hour partitions of a stream. The session's time zone is to be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .variants import Value

#: Accepted formats, in the order that is tried when none is given.
FORMATS = ("unix_seconds", "unix_millis", "unix_micros", "iso8601", "rfc3339")
_ISO = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})?| \d{2}:\d{2}:\d{2}([.,]\d+)?)$"
_FIRST, _LAST = -62135596800000000, 253402300799999999


def _number(v: Value) -> Column:
    return F.coalesce(v.digits.try_cast("decimal(38,9)"), v.real.try_cast("decimal(38,9)"))


def _at(micros: Column) -> Column:
    """Null outside the years 1 to 9999."""
    return F.when(micros.between(_FIRST, _LAST), F.timestamp_micros(micros.cast("bigint")))


def parsed(v: Value, form: str) -> Column:
    """A value read in one format; null if it is not of that format."""
    if form == "unix_seconds":
        return _at(F.floor(_number(v) * F.lit(1_000_000).cast("decimal(7,0)")))
    if form == "unix_millis":
        n = _number(v)
        return _at(F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)) * 1000)
    if form == "unix_micros":
        n = _number(v)
        return _at(F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)))
    if form in ("iso8601", "rfc3339"):
        return F.when((v.kind == "string") & v.text.rlike(_ISO), F.translate(v.text, ",", ".").try_cast("timestamp"))
    raise ValueError(f"unknown timestamp format {form!r}")


def normal_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def partition_columns(ts: Column) -> dict[str, Column]:
    return {"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts)}


def partition_path(stream: Column, ts: Column, every: str = "hourly") -> Column:
    """The folder of a record in a stream that is kept by the hour, or with every="daily" by the day."""
    form = "'year='yyyy'/month='MM'/day='dd" + {"hourly": "'/hour='HH", "daily": ""}[every]
    return F.concat(F.lit("streams/"), stream, F.lit("/partitions/"), F.date_format(ts, form))


def partition_of_path(path: Column) -> dict[str, Column]:
    return {"stream_id": F.regexp_extract(path, r"streams/([^/]+)/", 1)} | {p: F.regexp_extract(path, rf"{p}=(\d+)", 1).try_cast("int") for p in ("year", "month", "day", "hour")}
