"""Named queries over the driver's tables, one or more for each operator of the record-stream engine."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names, times
from .functions import variants as V
from .functions.names import encode_cursor
from .operators import control, ingest, metrics, schemas, storage
from .operators.transforms import Coercion, Pipeline, Projection, Rename, Rule, TimestampNormalisation
from .plans import reads
from .sources.tables import event_records, event_stream, table
from .streaming import streams

START, END = datetime(2024, 1, 5, 3), datetime(2024, 1, 5, 6, 30)
AS_OF = datetime(2024, 1, 20, 12)

USER_EVENT_SCHEMA = {
    "type": "object", "required": ["user_id", "event_type", "value"],
    "properties": {
        "user_id": {"type": "integer", "minimum": 20}, "event_type": {"type": "string", "enum": ["click", "view", "purchase", "signup"], "maxLength": 7},
        "value": {"type": "number", "maximum": 150}, "props": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 90}}},
    },
}


def _shown(rows: DataFrame) -> DataFrame:
    v = V.parse(F.col("payload"))
    return reads.wire(rows).select("record_id", "sequence_number", "timestamp_unix_micros", V.get(v, "user_id", "bigint").alias("user_id"), V.get(v, "event_type", "string").alias("event_type"))


def time_range(spark, d):
    return _shown(reads.range_rows(event_records(spark, d), START, END, 25))


def time_range_inclusive_bounds(spark, d):
    r = event_records(spark, d)
    bounds = r.where("_sequence in (101, 140)").agg(F.min("_ingested_at"), F.max("_ingested_at")).first()
    return _shown(reads.range_rows(r, bounds[0], bounds[1]))


def time_range_page2(spark, d):
    r = event_records(spark, d)
    first = reads.query_time_range(r, START, START + timedelta(days=6), 20)
    return _shown(reads.range_rows(r, START, START + timedelta(days=6), 20, first.next_cursor))


def time_range_cursors(spark, d):
    """Sequence and cursor of each record of a range, as pages hand them out."""
    rows = reads.in_range(event_records(spark, d), START, END)
    return rows.select("_sequence", names.cursor_of(F.col("_sequence")).alias("cursor"))


def partition_prune_hours(spark, d):
    r = event_records(spark, d)
    r = r.withColumns(times.partition_columns(F.col("_ingested_at"))).withColumn("path", times.partition_path(F.lit("events"), F.col("_ingested_at")))
    return reads.in_range(r, START, START + timedelta(days=2)).select("_sequence", "year", "month", "day", "hour", "path")


def lookup_record_id(spark, d):
    return _shown(reads.lookup(event_records(spark, d), "_record_id", "rec_150", AS_OF, timedelta(days=30)))


def lookup_payload_field(spark, d):
    return _shown(reads.lookup(event_records(spark, d), "event_type", "error", AS_OF))


def lookup_latest_per_key(spark, d):
    rows = reads.latest_by(event_records(spark, d), V.get(V.parse(F.col("payload")), "user_id", "bigint"), "user")
    return rows.select("user", "_record_id", "_sequence", "_ingested_at")


def replay_from_sequence(spark, d):
    return reads.replay(event_records(spark, d), start_sequence=900).select("_sequence", "_ingested_at", "is_historical")


def replay_from_time(spark, d):
    return reads.replay(event_records(spark, d), start=AS_OF).select("_sequence", "_ingested_at", "is_historical")


def _piped(spark, d, *stages) -> DataFrame:
    return Pipeline(stages).run(event_records(spark, d))


def project_include(spark, d):
    v = F.parse_json("transformed")
    run = _piped(spark, d, Projection(include=("user_id", "props.k")))
    return run.select("_sequence", V.get(v, "user_id", "bigint").alias("user_id"), V.get(v, "props.k", "bigint").alias("k"), F.array_join(F.array_sort(F.map_keys(V.members(v))), ",").alias("keys"))


def project_include_missing_null(spark, d):
    run = _piped(spark, d, Projection(include=("event_type", "absent.deep")))
    v = F.parse_json("transformed")
    return run.select("_sequence", F.col("transformed").contains('"absent":{"deep":null}').alias("explicit_null"), V.get(v, "event_type", "string").alias("event_type"))


def project_wildcard(spark, d):
    run = _piped(spark, d, Projection(include=("props.*", "nothing.*")))
    v = F.parse_json("transformed")
    return run.select("_sequence", V.get(v, "props.k", "bigint").alias("k"), F.size(F.map_keys(V.members(v))).alias("n_keys"))


def project_exclude(spark, d):
    run = _piped(spark, d, Projection(exclude=("value", "props.k", "absent.x")))
    v = F.parse_json("transformed")
    return run.select("_sequence", F.array_join(F.array_sort(F.map_keys(V.members(v))), ",").alias("keys"), F.size(F.map_keys(V.members(V.get(v, "props")))).alias("n_props"))


def _texts(spark, d):
    """Records whose payload's x takes awkward forms, by the sequence."""
    forms = ['"12"', '"12.7"', "-2.7", '"1e3"', "true", "null", '"yes"', "1", '"NaN"', "9223372036854775808", '"FALSE"', "0", "[1]", '{"a":1}', "2.0", '"abc"']
    n = len(forms)
    pick = F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("_sequence") % n + 1).cast("int"))
    return event_records(spark, d).withColumn("payload", F.concat(F.lit('{"x":'), pick, F.lit("}")))


def _coerced(spark, d, target, kind, **options):
    run = Pipeline((Coercion((Rule("x", target, **options),)),)).run(_texts(spark, d))
    return run.select("_sequence", V.get(F.parse_json("transformed"), "x", kind).alias("x"), F.col("error.message").alias("message"))


def coerce_int(spark, d):
    return _coerced(spark, d, "int64", "bigint")


def coerce_float(spark, d):
    return _coerced(spark, d, "float64", "double")


def coerce_bool(spark, d):
    return _coerced(spark, d, "bool", "boolean")


def coerce_string(spark, d):
    return _coerced(spark, d, "string", "string")


def coerce_on_error_null(spark, d):
    return _coerced(spark, d, "int64", "bigint", on_error="use_null")


def coerce_on_error_default(spark, d):
    return _coerced(spark, d, "int64", "bigint", on_error="use_default", default=-1)


def _timed(spark, d, form: str, *formats: str):
    r = event_records(spark, d)
    micros = F.unix_micros(F.col("_ingested_at").cast("timestamp"))
    value = {
        "seconds": (F.floor(micros / 1_000_000)).cast("string"), "millis": F.floor(micros / 1000).cast("string"), "micros": micros.cast("string"),
        "iso": F.concat(F.lit('"'), F.date_format("_ingested_at", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("_sequence") % 3 == 0, "+02:00").when(F.col("_sequence") % 3 == 1, "Z").otherwise(""), F.lit('"')),
        "mixed": F.when(F.col("_sequence") % 4 == 0, '"2024-01-01"').when(F.col("_sequence") % 4 == 1, "null").when(F.col("_sequence") % 4 == 2, F.floor(micros / 1_000_000).cast("string")).otherwise('"2024-03-01 10:00:00.5"'),
    }[form]
    run = Pipeline((TimestampNormalisation("t", formats or times.FORMATS),)).run(r.withColumn("payload", F.concat(F.lit('{"t":'), value, F.lit("}"))))
    return run.select("_sequence", V.get(F.parse_json("transformed"), "t", "string").alias("t"), F.col("error.message").alias("message"))


def ts_norm_seconds(spark, d):
    return _timed(spark, d, "seconds", "unix_seconds")


def ts_norm_millis(spark, d):
    return _timed(spark, d, "millis", "unix_millis")


def ts_norm_micros(spark, d):
    return _timed(spark, d, "micros", "unix_micros")


def ts_norm_iso(spark, d):
    return _timed(spark, d, "iso", "rfc3339")


def ts_norm_default_order(spark, d):
    return _timed(spark, d, "mixed")


_PIPELINE = Pipeline((Projection(include=("user_id", "event_type", "value")), Coercion((Rule("value", "int64"), Rule("user_id", "string"), Rule("event_type", "bool", on_error="use_null")))))


def _bad_every_seventh(spark, d):
    broken = F.when(F.col("_sequence") % 7 == 0, F.concat(F.col("payload"), F.lit(" trailing"))).when(F.col("_sequence") % 7 == 1, F.lit("[1]")).otherwise(F.col("payload"))
    return event_records(spark, d).withColumn("payload", broken)


def pipeline_good(spark, d):
    run = _PIPELINE.run(_bad_every_seventh(spark, d)).where("error is null")
    v = F.parse_json("transformed")
    return run.select("_sequence", V.get(v, "user_id", "string").alias("user_id"), V.get(v, "value", "bigint").alias("value"))


def pipeline_dlq(spark, d):
    from .operators.transforms import split

    _, bad = split(_PIPELINE.run(_bad_every_seventh(spark, d)))
    return bad.select("_sequence", "error.stage", "error.message", "origin.source_stream", "origin.original_ts", "origin.retry_count")


def pipeline_counts(spark, d):
    run = _PIPELINE.run(_bad_every_seventh(spark, d))
    return run.groupBy(F.coalesce("error.stage", F.lit("none")).alias("stage")).agg(F.count("*").alias("n"))


def validate_ok(spark, d):
    return schemas.validate(event_records(spark, d), USER_EVENT_SCHEMA).where("size(errors) = 0").select("_sequence")


def validate_errors_by_path(spark, d):
    bad = schemas.validate(event_records(spark, d), USER_EVENT_SCHEMA).select(F.explode("errors").alias("e"))
    return bad.groupBy("e.path", "e.schema_path").agg(F.count("*").alias("n"))


def schema_fingerprint(spark, d):
    return event_records(spark, d).select("_sequence", names.fingerprint(F.col("_record_id")).alias("fingerprint"))


def schema_latest_version(spark, d):
    versions = table(spark, d, "events").select(F.col("user_id").alias("schema"), F.col("event_id").alias("version"), F.when(F.col("event_type") == "error", "deprecated").otherwise("active").alias("status"))
    return schemas.latest_versions(versions)


def dedup_24h(spark, d):
    r = table(spark, d, "events").select("user_id", "event_type", F.col("ts").alias("_ingested_at"), F.col("event_id").alias("_sequence"))
    return ingest.dedup(r, ["user_id", "event_type"]).select("_sequence", "user_id", "event_type")


def assign_sequence(spark, d):
    return ingest.assign_sequences(table(spark, d, "events"), "event_type", ["ts", "event_id"]).select("event_id", "event_type", "sequence")


def rate_limit_fixed_window(spark, d):
    calls = table(spark, d, "events").select("event_id", "user_id", "ts")
    return ingest.rate_limit(calls, "user_id", "ts", ["ts", "event_id"], 2, 3600).select("event_id", "allowed", "remaining")


def backpressure_levels(spark, d):
    return table(spark, d, "events").select("event_id", ingest.backpressure(F.col("event_id") % 1000, 900, F.col("event_id") % 500, 600).alias("level"))


def message_checks(spark, d):
    docs = table(spark, d, "documents")
    problem = ingest.message_problem(F.when(F.col("doc_id") % 5 != 0, "s"), F.when(F.col("doc_id") % 3 == 0, "").otherwise("x"), F.col("text"), 4000)
    return docs.select("doc_id", problem.alias("problem"))


def daily_stats(spark, d):
    r = table(spark, d, "events").select(F.col("ts").alias("_ingested_at"), F.col("props").alias("payload"))
    return metrics.daily_stats(r)


def _hours(spark, d):
    return storage.manifest(table(spark, d, "events").select(F.col("ts").alias("_ingested_at"), F.col("props").alias("payload"), (F.col("event_id") + 1).alias("_sequence")))


def partition_manifest(spark, d):
    return _hours(spark, d)


def compaction_candidates(spark, d):
    files = _hours(spark, d).select("year", "month", "day", F.lit(0).alias("hour"), F.col("total_bytes").alias("bytes"))
    return storage.compaction_candidates(files, 24).select("year", "month", "day", "files", "bytes")


def retention_time(spark, d):
    return storage.expired_by_age(_hours(spark, d), AS_OF, 10).select("year", "month", "day", "hour", "record_count")


def retention_size(spark, d):
    total = 20_000
    return storage.expired_by_size(_hours(spark, d), total, 1000).select("year", "month", "day", "hour", "record_count")


def orphans(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    listed = orders.select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderdate").alias("modified"))
    referenced = lines.where("l_quantity > 25").select(F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("path"))
    return storage.orphans(listed, referenced, F.lit(datetime(1997, 1, 1)).cast("timestamp_ntz")).select("path")


def upsert_additive(spark, d):
    e = table(spark, d, "events")
    count = lambda rows: rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("s"))
    return storage.add_up(count(e.where("event_type = 'click'")), count(e.where("event_type in ('view', 'error')")), ["user_id"], ["n", "s"])


def upsert_replace(spark, d):
    e = table(spark, d, "events")
    one = lambda kind: e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.max("event_id").alias("last_event"))
    return storage.replace_rows(one("click"), one("purchase"), ["user_id"])


def metric_counters(spark, d):
    return metrics.counters(table(spark, d, "events"), ["event_type", "user_id"])


_BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 200.0)


def histogram_value(spark, d):
    out = metrics.histogram(table(spark, d, "events"), "value", _BOUNDS, ["event_type"])
    return out.select("event_type", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")).alias("le"), "bucket_count")


def histogram_quantile(spark, d):
    out = metrics.quantile(metrics.histogram(table(spark, d, "events"), "value", _BOUNDS, ["event_type"]), 0.9, ["event_type"])
    return out.select("event_type", F.round("quantile", 6).alias("p90"))


def alert_error_ratio(spark, d):
    out = metrics.error_ratio(table(spark, d, "events"), "ts", F.col("event_type") == "error", 60, 0.3)
    return out.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "n", "errors", "firing")


def alert_no_traffic(spark, d):
    return metrics.silent_windows(table(spark, d, "events"), "ts", datetime(2024, 1, 2), datetime(2024, 1, 4), 5).select(F.col("bucket").cast("timestamp_ntz").alias("bucket"))


def alert_rate_threshold(spark, d):
    return metrics.over_threshold(table(spark, d, "events"), "ts", 60, 16 / 3600).select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "n")


def alert_hold_for(spark, d):
    firing = metrics.silent_windows(table(spark, d, "events"), "ts", datetime(2024, 1, 2), datetime(2024, 1, 4), 5)
    return metrics.held(firing, "bucket", 5, 2).select(F.col("since").cast("timestamp_ntz").alias("since"), F.col("until").cast("timestamp_ntz").alias("until"), "windows")


def latest_gauge(spark, d):
    return metrics.latest_gauge(table(spark, d, "events"), "ts", "value", ["user_id"])


def health_rollup(spark, d):
    c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("component"), F.when(F.col("s_suppkey") % 7 == 0, "degraded").otherwise("healthy").alias("status"))
    return metrics.health(c)


def batch_jsonl_import(spark, d):
    """All conversations as JSON Lines, a line a turn, every conversation a job of its own; a line is broken where the
    length of its text is a multiple of 97."""
    turns = table(spark, d, "conversations").where("conv_id is not null").withColumn("line", F.col("turn") + 1)
    payload = F.when(F.length("text") % 97 == 0, "{oops").otherwise(F.to_json(F.struct("role", "text")))
    records, verdict = ingest.import_jobs(turns.withColumn("payload", payload), "conv_id", "line", "payload")
    let = records.groupBy("job").agg(F.count("*").alias("let_through"))
    return verdict.join(let, "job", "left").withColumn("let_through", F.coalesce("let_through", F.lit(0)))


def batch_jsonl_import_daily(spark, d):
    """All events as JSON Lines, every day a job of its own; on odd days each line whose number 77 divides is broken."""
    e = event_records(spark, d).withColumn("job", F.to_date("_ingested_at"))
    broken = (F.dayofmonth("job") % 2 == 1) & (F.col("_sequence") % 77 == 0)
    records, verdict = ingest.import_jobs(e.withColumn("payload", F.when(broken, "{oops").otherwise(F.col("payload"))), "job", "_sequence", "payload")
    let = records.groupBy(F.col("job").alias("_job")).agg(F.count("*").alias("let_through"))
    both = verdict.join(let, F.col("job").eqNullSafe(F.col("_job")), "left")
    return both.select("job", "processed", "succeeded", "failed", "status", "error_line", F.coalesce("let_through", F.lit(0)).alias("let_through"))


def time_range_last_page(spark, d):
    """What is left of a range after the cursor of its row number 100: the page that has no next one."""
    r, end = event_records(spark, d), START + timedelta(hours=12)
    at, cursor = 0, None
    while at < 2 and (page := reads.query_time_range(r, START, end, 50, cursor)).next_cursor:
        at, cursor = at + 1, page.next_cursor
    return _shown(reads.range_rows(r, START, end, 10_000, cursor))


def time_range_metadata(spark, d):
    return reads.range_metadata(event_records(spark, d), START, START + timedelta(days=2, minutes=17))


def time_range_text(spark, d):
    """A range of one stream, times as RFC 3339 text."""
    return reads.wire_text(reads.in_range(event_records(spark, d), START, START + timedelta(days=3), "events")).drop("payload")


def rename_fields(spark, d):
    """value and user_id change places, event_type becomes kind; a field that is not there is not made."""
    run = _piped(spark, d, Rename((("value", "user_id"), ("user_id", "value"), ("event_type", "kind"), ("absent", "props"))))
    v = F.parse_json("transformed")
    names_ = F.array_join(F.array_sort(F.map_keys(V.members(v))), ",")
    return run.select("_sequence", V.get(v, "value", "bigint").alias("value"), V.get(v, "user_id", "double").alias("user_id"), V.get(v, "kind", "string").alias("kind"), names_.alias("keys"))


def stream_snapshot(spark, d):
    """Event types as streams."""
    e = table(spark, d, "events").select(F.col("event_type").alias("_stream_id"), F.col("ts").alias("_ingested_at"), F.col("props").alias("payload"), (F.col("event_id") + 1).alias("_sequence"))
    return storage.stream_snapshot(e)


def alert_silent_connected(spark, d):
    """Windows without a purchase in which the gauge, here the events' value, was above 0."""
    e = table(spark, d, "events")
    out = metrics.silent_while_connected(e.where("event_type = 'purchase'"), "ts", e, "ts", "value", datetime(2024, 1, 1), datetime(2024, 2, 1), 5)
    return out.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"))


def alert_slow_windows(spark, d):
    out = metrics.slow_windows(table(spark, d, "events"), "ts", "value", _BOUNDS, 0.9, 60, 95)
    return out.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), F.round("quantile", 6).alias("p90"))


def alert_low_gauges(spark, d):
    return metrics.low_gauges(table(spark, d, "events"), ["ts", "event_id"], "value", ["user_id"], 20)


def stream_tail_available_now(spark, d):
    """History, then what is live, from a sequence on, each record once, as a stream that takes what is there."""
    live = streams.replay_then_tail(event_stream(spark, d), start_sequence=200, live_from=AS_OF)
    return streams.run_available(live.select("_sequence", "_ingested_at", "is_historical"), "tail")


def stream_dedup(spark, d):
    """dedup_24h as a stream: state by user and kind."""
    setting, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(setting)
    v = V.parse(F.col("payload"))
    rows = event_stream(spark, d).select("_sequence", "_ingested_at", V.get(v, "user_id", "bigint").alias("user_id"), V.get(v, "event_type", "string").alias("event_type"))
    spark.conf.set(setting, rocks)
    try:
        return streams.run_available(streams.dedup_stream(rows, ["user_id", "event_type"]), "dedup").select("_sequence", "user_id", "event_type")
    finally:
        spark.conf.set(setting, before)


def lifecycle_transitions(spark, d):
    states = spark.createDataFrame([(s,) for s in control.TRANSITIONS], "state string")
    pairs = states.join(states.withColumnRenamed("state", "next"))
    return pairs.select("state", "next", control.may_move(F.col("state"), F.col("next")).alias("allowed"))


def rbac_matrix(spark, d):
    """Each role, action and kind of thing, for all things of the kind."""
    some = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    cases = some("role", [*control.ROLES, "guest"]).join(some("action", ["read", "write", "admin"])).join(some("kind", ["stream", "schema", "pipeline", "config", "api_key"]))
    none = F.lit(None).cast(control.PERMISSIONS)
    return cases.select("role", "action", "kind", control.may(F.col("role"), F.col("kind"), F.lit(""), F.col("action"), none).alias("allowed"))


def _pick(values: list[str], number) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def rbac_requests(spark, d):
    """Each event as a request: roles by user, streams by event; some users have permissions for one stream, some for all."""
    e, user = F.col("event_id"), F.col("user_id")
    name = F.when(e % 3 == 0, "").otherwise(F.concat(F.lit("s"), (e % 4).cast("string")))
    actions = F.when(user % 5 == 0, F.array(F.lit("admin"))).otherwise(F.array(F.lit("read")))
    own = F.struct(F.lit("stream").alias("resource_type"), F.when(user % 3 == 0, "*").otherwise(F.concat(F.lit("s"), (user % 4).cast("string"))).alias("resource_id"), actions.alias("actions"))
    permissions = F.when(user % 7 != 0, F.array(own).cast(control.PERMISSIONS))
    role, action, kind = _pick(["admin", "operator", "schema_admin", "writer", "reader", "guest"], user), _pick(["read", "write", "admin"], F.floor(e / 4)), _pick(["stream", "schema", "pipeline", "config", "api_key"], F.floor(e / 12))
    return table(spark, d, "events").select("event_id", control.may(role, kind, name, action, permissions).alias("allowed"))


def dedup_streams(spark, d):
    """Sequences count within each event type, so they repeat between keys; every row tells what its sender is told."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").alias("_ingested_at"))
    numbered = ingest.assign_sequences(e, "event_type", ["_ingested_at", "event_id"]).withColumnRenamed("sequence", "_sequence")
    return ingest.acknowledge(numbered, ["event_type", "user_id"]).select("event_id", "event_type", "_sequence", "repeat", "original")


def ingest_admit(spark, d):
    """Events as requests to three streams: some without a schema, some with a payload that breaks it, keys by user."""
    e, r = table(spark, d, "events"), F.col("event_id")
    payload = F.when(r % 11 == 0, "{oops").otherwise(F.to_json(F.struct("user_id", "event_type", "value")))
    requests = e.select(
        "event_id", F.concat(F.lit("s"), (r % 3).cast("string")).alias("stream_id"), F.when(r % 13 == 0, "").otherwise("clicks").alias("schema_id"), payload.alias("payload"),
        F.when(r % 2 == 0, F.col("user_id").cast("string")).alias("idempotency_key"), "ts", r.alias("arrival"),
    )
    schema = {"type": "object", "required": ["user_id"], "properties": {"value": {"maximum": 150}}}
    return ingest.admit(requests, schema).select("event_id", "status", "error_message", "repeat", "sequence_number", "timestamp_unix_micros")


def payload_crc32(spark, d):
    """CRC-32 of stored payloads, here the events' properties as text, by known digits of their own: two equal payloads
    have equal sums."""
    sums = table(spark, d, "events").select(F.crc32(F.col("props").cast("binary")).alias("crc32"), "props")
    return sums.groupBy("props").agg(F.count("*").alias("n"), F.count_distinct("crc32").alias("sums"))


def rate_limit_categories(spark, d):
    calls = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    rates = {"click": (1, 3), "view": (1, 2), "error": (1, 1)}
    return ingest.category_limits(calls, "user_id", "event_type", "ts", ["ts", "event_id"], rates, 86_400).select("event_id", "call_limit", "allowed", "remaining")


def time_range_page1(spark, d):
    page = reads.range_rows(event_records(spark, d), START, START + timedelta(days=6), 20)
    return _shown(page)


def coerce_errors_to_dlq(spark, d):
    from .operators.transforms import split

    _, bad = split(Pipeline((Coercion((Rule("x", "int64"),)),)).run(_texts(spark, d)))
    return bad.select("_sequence", "payload", "error.stage", "error.message")


def daily_partition_paths(spark, d):
    """Paths of daily partitions, for streams that are kept by the day."""
    return event_records(spark, d).select("_sequence", times.partition_path(F.lit("events"), F.col("_ingested_at"), "daily").alias("path"))


def name_validation(spark, d):
    texts = names.SAMPLES
    rows = spark.createDataFrame([(t,) for t in texts], "name string")
    n = F.col("name")
    return rows.select("name", names.valid_name(n).alias("is_name"), names.valid_namespace(n).alias("is_namespace"), names.valid_field_path(n).alias("is_path"))


def catalog_listing(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return control.listed(rows.where("o_orderdate is not null"), F.col("o_orderkey"), 100, o_orderstatus="F")


def payload_checksums(spark, d):
    return event_records(spark, d).select("_sequence", F.sha2(F.col("_record_id"), 256).alias("key_hash"), F.md5(F.col("_record_id")).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        time_range, time_range_page1, time_range_inclusive_bounds, dedup_streams, ingest_admit, rbac_requests, payload_crc32, rate_limit_categories, coerce_errors_to_dlq, daily_partition_paths, time_range_page2, time_range_cursors, partition_prune_hours, lookup_record_id, lookup_payload_field, lookup_latest_per_key,
        replay_from_sequence, replay_from_time, project_include, project_include_missing_null, project_wildcard, project_exclude, coerce_int, coerce_float, coerce_bool, coerce_string,
        coerce_on_error_null, coerce_on_error_default, ts_norm_seconds, ts_norm_millis, ts_norm_micros, ts_norm_iso, ts_norm_default_order, pipeline_good, pipeline_dlq, pipeline_counts,
        validate_ok, validate_errors_by_path, schema_fingerprint, schema_latest_version, dedup_24h, assign_sequence, rate_limit_fixed_window, backpressure_levels, message_checks,
        daily_stats, partition_manifest, compaction_candidates, retention_time, retention_size, orphans, upsert_additive, upsert_replace, metric_counters, histogram_value, histogram_quantile,
        alert_error_ratio, alert_no_traffic, alert_rate_threshold, alert_hold_for, latest_gauge, health_rollup, batch_jsonl_import, batch_jsonl_import_daily, lifecycle_transitions, rbac_matrix, name_validation,
        catalog_listing, payload_checksums, time_range_last_page, time_range_metadata, time_range_text, rename_fields, stream_snapshot, alert_silent_connected, alert_slow_windows, alert_low_gauges,
        stream_tail_available_now, stream_dedup,
    )
}
