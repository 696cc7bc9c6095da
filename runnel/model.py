"""Records, limits and errors."""

from __future__ import annotations

from pyspark.sql import types as T

#: Limits of the record-stream contract.
DEFAULT_LIMIT, MAX_LIMIT = 1000, 10_000
MAX_RANGE_DAYS = 7
MAX_PAYLOAD_BYTES = 1 << 20
DEDUP_HOURS = 24
RETENTION_DAYS = 365
MAX_STAGES = 10

RECORD = T.StructType(
    [
        T.StructField("_record_id", T.StringType()),
        T.StructField("_stream_id", T.StringType()),
        T.StructField("_sequence", T.LongType()),
        T.StructField("_ingested_at", T.TimestampNTZType()),
        T.StructField("payload", T.StringType()),
    ]
)
PARTITIONS = ("year", "month", "day", "hour")


class EngineError(ValueError):
    """Anything the engine refuses."""


class ValidationError(EngineError):
    pass


class NotFound(EngineError):
    pass


class Conflict(EngineError):
    pass


class InvalidState(EngineError):
    pass
