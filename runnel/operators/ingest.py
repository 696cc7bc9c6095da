"""Admission of records: message checks, idempotency, sequences, rate limits, batch import."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import variants as V
from ..model import DEDUP_HOURS, MAX_PAYLOAD_BYTES
from . import schemas


def message_problem(stream: Column, schema: Column, payload: Column, most: int = MAX_PAYLOAD_BYTES) -> Column:
    """Why a message is refused; null if it is not."""
    empty = lambda c: c.isNull() | (c == "")
    return (
        F.when(empty(stream), "stream_id is required").when(empty(schema), "schema_id is required").when(empty(payload), "payload is required")
        .when(F.octet_length(payload) > most, f"payload is larger than {most} bytes")
    )


def acknowledge(records: DataFrame, key: list[str], ts: str = "_ingested_at", sequence: str = "_sequence", hours: int = DEDUP_HOURS) -> DataFrame:
    """records with `repeat` and `original`: a row is a repeat if a kept row of its key is less than `hours` older; original
    is then the kept row's sequence, which is what the sender is told, else the row's own. Time runs from the last kept
    row, so the rule is a walk over a key's rows in order of time, then sequence. Sequences may repeat between keys. Rows
    with a null or empty key are no repeats.

    Rows are sorted by key and time in Spark, which spills; the walk holds the last kept time of one key only and jumps
    from kept row to kept row, so no key's rows are gathered. A key's walk is one task, as each decision needs the one
    before.
    """
    limit = hours * 3_600_000_000
    no_key = F.lit(False)
    for k in key:
        no_key = no_key | F.col(k).isNull() | (F.col(k).cast("string") == "")
    keyed = records.where(~no_key).withColumns({"_name": F.to_json(F.struct(*key)), "_micros": F.unix_micros(F.col(ts).cast("timestamp"))})
    ordered = keyed.repartition("_name").sortWithinPartitions("_name", "_micros", sequence)

    def walk(batches):
        name, last, told = None, 0, 0
        for batch in batches:
            t, number = batch.column("_micros").to_numpy(), batch.column(sequence).to_numpy(zero_copy_only=False)
            coded = batch.column("_name").dictionary_encode()
            codes = coded.indices.to_numpy()
            repeat, original = np.ones(len(t), bool), np.empty(len(t), np.int64)
            edges = np.r_[0, np.flatnonzero(np.diff(codes)) + 1, len(t)]
            for first, end in zip(edges[:-1], edges[1:]):
                at = first
                if (own := coded.dictionary[codes[first]].as_py()) != name:
                    name, last, told, repeat[at] = own, t[at], number[at], False
                while at < end:
                    to = first + int(np.searchsorted(t[first:end], last + limit))
                    original[at:to] = told
                    at = to
                    if at < end:
                        last, told, repeat[at] = t[at], number[at], False
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(repeat), pa.array(original)], [*batch.schema.names[:-2], "repeat", "original"])

    schema = T.StructType([*records.schema, T.StructField("repeat", T.BooleanType()), T.StructField("original", T.LongType())])
    walked = ordered.select(*records.columns, "_name", "_micros").mapInArrow(walk, schema)
    return walked.unionByName(records.where(no_key).withColumns({"repeat": F.lit(False), "original": F.col(sequence).cast("bigint")}))


def dedup(records: DataFrame, key: list[str], ts: str = "_ingested_at", sequence: str = "_sequence", hours: int = DEDUP_HOURS) -> DataFrame:
    """The rows that acknowledge() does not call repeats."""
    return acknowledge(records, key, ts, sequence, hours).where("not repeat").select(*records.columns)


def admit(requests: DataFrame, schema: dict | str, last: DataFrame | None = None, hours: int = DEDUP_HOURS, known: DataFrame | None = None) -> DataFrame:
    """What becomes of each request (stream_id, schema_id, payload, idempotency_key, ts, arrival; arrival orders requests
    of one time): its columns with status (OK, VALIDATION_ERROR), error_message, repeat, record_id, sequence_number and
    timestamp_unix_micros.

    Message checks, then the schema, then idempotency within a stream, then sequences for what is new, on from `last`
    (stream_id, last_sequence). A repeat gets the record id, sequence and time of the original; a refused request gets
    none. Records are the rows with status OK that are no repeats (see records_of).

    known is what earlier batches were told: for each stream and key the latest record (stream_id, idempotency_key, ts,
    record_id, sequence_number, timestamp_unix_micros). Requests less than `hours` after it are repeats of it.
    """
    checked = schemas.validate(requests.withColumn("problem", message_problem(F.col("stream_id"), F.col("schema_id"), F.col("payload"))), schema)
    first = F.element_at("errors", 1)
    wrong = F.when(F.size("errors") > 0, F.concat(first["path"], F.lit(": "), first["message"]))
    judged = checked.withColumn("error_message", F.coalesce("problem", wrong)).drop("problem", "errors")
    good, bad = judged.where("error_message is null"), judged.where("error_message is not null")
    no_key = F.col("idempotency_key").isNull() | (F.col("idempotency_key") == "")
    before = None
    if known is not None:
        told = known.select(F.col("stream_id").alias("_stream"), F.col("idempotency_key").alias("_idem"), F.col("ts").alias("_at"), "record_id", "sequence_number", "timestamp_unix_micros")
        met = good.join(told, (F.col("stream_id") == F.col("_stream")) & (F.col("idempotency_key") == F.col("_idem")), "left")
        early = F.coalesce(~no_key & (F.col("ts") < F.col("_at") + F.expr(f"interval {hours} hours")), F.lit(False))
        before = met.where(early).drop("_stream", "_idem", "_at").withColumns({"status": F.lit("OK"), "repeat": F.lit(True)})
        good = met.where(~early).select(*good.columns)
    key = F.when(~no_key, F.to_json(F.struct("stream_id", "idempotency_key")))
    told = acknowledge(good.withColumn("_key", key), ["_key"], "ts", "arrival", hours).drop("_key")
    new = assign_sequences(told.where("not repeat").withColumnRenamed("sequence", "_s") if "sequence" in told.columns else told.where("not repeat"), "stream_id", ["ts", "arrival"], last)
    new = new.withColumns({
        "sequence_number": F.col("sequence"), "timestamp_unix_micros": F.unix_micros(F.col("ts").cast("timestamp")),
        "record_id": record_id(F.col("stream_id"), F.col("sequence")),
    }).drop("sequence")
    kept = new.select(F.col("stream_id").alias("_stream"), F.col("idempotency_key").alias("_idem"), F.col("arrival").alias("original"), "record_id", "sequence_number", "timestamp_unix_micros")
    same = (F.col("stream_id") == F.col("_stream")) & (F.col("idempotency_key") == F.col("_idem"))
    again = told.where("repeat").join(kept, [told["original"] == kept["original"], same], "left").drop(kept["original"]).drop("_stream", "_idem")
    out = new.unionByName(again).withColumn("status", F.lit("OK")).drop("original")
    if before is not None:
        out = out.unionByName(before)
    return out.unionByName(bad.withColumns({"status": F.lit("VALIDATION_ERROR"), "repeat": F.lit(False)}), allowMissingColumns=True)


def record_id(stream: Column, sequence: Column) -> Column:
    """An id in the form of a UUID that a rerun gives again: a digest of stream and sequence."""
    h = F.md5(F.concat_ws("\0", stream, sequence.cast("string")).cast("binary"))
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def records_of(admitted: DataFrame) -> DataFrame:
    """The records of what admit() let in, with the CRC-32 of the payload as stored."""
    new = admitted.where("status = 'OK' and not repeat")
    return new.select(
        F.col("record_id").alias("_record_id"), F.col("stream_id").alias("_stream_id"), F.col("sequence_number").alias("_sequence"),
        F.col("ts").alias("_ingested_at"), "payload", F.crc32(F.col("payload").cast("binary")).alias("_crc32"),
    )


def assign_sequences(records: DataFrame, stream: str, order: list[str], last: DataFrame | None = None, slice_seconds: int = 60) -> DataFrame:
    """Adds `sequence`: 1, 2, 3 ... in each stream, on from last (stream, last_sequence) if given. A null stream is one too.

    Where order begins with a time, rows are numbered within slices of that time and the counts of a stream's earlier
    slices are added: a row a slice, so one busy stream is dealt to as many tasks as it has slices. Other orders number a
    stream in one task.
    """
    if not isinstance(records.schema[order[0]].dataType, (T.TimestampType, T.TimestampNTZType)):
        n = F.row_number().over(Window.partitionBy(stream).orderBy(*order)).cast("bigint")
        numbered = records.withColumn("sequence", n)
    else:
        # nulls have values of their own, so that equal keys join; a null time sorts first, as in the order itself
        at = F.coalesce(F.floor(F.unix_micros(F.col(order[0]).cast("timestamp")) / (slice_seconds * 1_000_000)), F.lit(-(1 << 62)))
        keyed = records.withColumns({"_none": F.col(stream).isNull(), "_name": F.coalesce(F.col(stream).cast("string"), F.lit("")), "_slice": at})
        keys = ["_none", "_name", "_slice"]
        counts = keyed.groupBy(*keys).agg(F.count("*").alias("_n"))
        earlier = F.sum("_n").over(Window.partitionBy("_none", "_name").orderBy("_slice")) - F.col("_n")
        before = counts.select(*keys, earlier.alias("_before"))
        n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        numbered = keyed.withColumn("_place", n).join(before, keys).withColumn("sequence", F.col("_place") + F.col("_before")).select(*records.columns, "sequence")
    if last is None:
        return numbered
    both = numbered.withColumnRenamed("sequence", "_n").join(last.select(stream, "last_sequence"), stream, "left")
    return both.withColumn("sequence", F.col("_n") + F.coalesce("last_sequence", F.lit(0))).drop("_n", "last_sequence")


def backpressure(records: Column, max_records: int, size: Column, max_bytes: int) -> Column:
    used = F.greatest(records / max_records, size / max_bytes)
    return F.when(used < 0.70, "healthy").when(used < 0.90, "warning").when(used < 1.0, "critical").otherwise("overload")


#: Calls a second and burst of each category of calls.
RATES = {"ingestion": (10_000, 15_000), "query": (1_000, 2_000), "admin": (100, 200)}


def rate_limit(calls: DataFrame, client: str, ts: str, order: list[str], burst: int, seconds: int = 1) -> DataFrame:
    """calls with allowed and remaining: the first `burst` calls of a client in each fixed window pass."""
    window = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))
    n = F.row_number().over(Window.partitionBy(client, window).orderBy(*order))
    return calls.withColumn("allowed", n <= burst).withColumn("remaining", F.greatest(F.lit(burst) - n, F.lit(0)))


def category_limits(calls: DataFrame, client: str, category: str, ts: str, order: list[str], rates: dict[str, tuple[int, int]] = RATES, seconds: int = 1) -> DataFrame:
    """calls with call_limit, allowed and remaining: each client has a window of its own for each category; a call of an
    unknown category passes, with a limit and rest of 0."""
    known = F.create_map(*[F.lit(x) for name, (limit, burst) in rates.items() for x in (name, limit)])
    bursts = F.create_map(*[F.lit(x) for name, (limit, burst) in rates.items() for x in (name, burst)])
    window = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))
    n = F.row_number().over(Window.partitionBy(client, category, window).orderBy(*order))
    burst = bursts[F.col(category)]
    return calls.withColumns({
        "call_limit": F.coalesce(known[F.col(category)], F.lit(0)), "allowed": burst.isNull() | (n <= burst),
        "remaining": F.when(burst.isNull(), 0).otherwise(F.greatest(burst - n, F.lit(0))),
    })


def import_lines(lines: DataFrame, line: str, text: str) -> tuple[DataFrame, DataFrame]:
    """JSON Lines with their numbers. (records (line_number, payload), verdict): one bad line fails the whole job and no
    record is let through. Blank lines are passed over. The verdict is one row: processed, succeeded, failed, status,
    error_line."""
    rows = lines.select(F.col(line).cast("bigint").alias("line_number"), F.trim(text).alias("payload")).where("payload != ''")
    rows = rows.withColumn("_bad", V.parse(F.col("payload")).isNull() | (F.octet_length("payload") > MAX_PAYLOAD_BYTES))
    total = rows.agg(F.count("*").alias("processed"), F.coalesce(F.sum(F.col("_bad").cast("bigint")), F.lit(0)).alias("bad"), F.min(F.when(F.col("_bad"), F.col("line_number"))).alias("error_line"))
    verdict = total.select(
        "processed", F.when(F.col("bad") == 0, F.col("processed")).otherwise(0).alias("succeeded"), F.when(F.col("bad") == 0, 0).otherwise(F.col("processed")).cast("bigint").alias("failed"),
        F.when(F.col("bad") == 0, "COMPLETED").otherwise("FAILED").alias("status"), "error_line",
    )
    records = rows.drop("_bad").join(F.broadcast(verdict.where("status = 'COMPLETED'").select("status")), F.lit(True)).drop("status")
    return records, verdict


def import_jobs(lines: DataFrame, job: str, line: str, text: str) -> tuple[DataFrame, DataFrame]:
    """import_lines for many jobs at once: the column job tells each line's. (records (job, line_number, payload),
    verdicts): one bad line fails its own job only. A verdict is a row of job, processed, succeeded, failed, status,
    error_line; a job of blank lines only has none."""
    rows = lines.select(F.col(job).alias("job"), F.col(line).cast("bigint").alias("line_number"), F.trim(text).alias("payload")).where("payload != ''")
    rows = rows.withColumn("_bad", V.parse(F.col("payload")).isNull() | (F.octet_length("payload") > MAX_PAYLOAD_BYTES))
    total = rows.groupBy("job").agg(F.count("*").alias("processed"), F.max("_bad").alias("bad"), F.min(F.when(F.col("_bad"), F.col("line_number"))).alias("error_line"))
    verdict = total.select(
        "job", "processed", F.when(F.col("bad"), 0).otherwise(F.col("processed")).cast("bigint").alias("succeeded"), F.when(F.col("bad"), F.col("processed")).otherwise(0).cast("bigint").alias("failed"),
        F.when(F.col("bad"), "FAILED").otherwise("COMPLETED").alias("status"), "error_line",
    )
    failed = verdict.where("status = 'FAILED'").select(F.col("job").alias("_job"))
    return rows.drop("_bad").join(failed, F.col("job").eqNullSafe(F.col("_job")), "left_anti"), verdict
