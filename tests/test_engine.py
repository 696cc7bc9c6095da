"""Reads, transforms, schemas, ingest, storage, control on hand-made rows."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runnel.functions import names, times
from runnel.functions import variants as V
from runnel.model import Conflict, InvalidState, NotFound, ValidationError
from runnel.operators import control, ingest, metrics, schemas, storage
from runnel.operators.transforms import Coercion, Pipeline, Projection, Rename, Rule, TimestampNormalisation, split, stage
from runnel.plans import reads
from runnel.sources import tables

T0 = datetime(2024, 1, 5, 3)
SCHEMA = "_record_id string, _stream_id string, _sequence bigint, _ingested_at timestamp_ntz, payload string"


def records(spark, n=60, minutes=7):
    return spark.createDataFrame([(f"rec_{k}", "s", k + 1, T0 + timedelta(minutes=minutes * k), json.dumps({"id": k, "kind": "ab"[k % 2]})) for k in range(n)], SCHEMA)


def run(spark, payloads, *stages):
    rows = spark.createDataFrame([(k, p, T0) for k, p in enumerate(payloads)], "k int, payload string, _ingested_at timestamp_ntz")
    return [(r.transformed, r.error.message if r.error else None) for r in Pipeline(stages).run(rows).orderBy("k").collect()]


# ---------------------------------------------------------------- reads


def test_pages_cover_a_range_once(spark):
    rows, cursor, seen = records(spark), None, []
    while True:
        page = reads.query_time_range(rows, T0, T0 + timedelta(hours=4), 10, cursor)
        seen += [r.sequence_number for r in page.rows]
        cursor = page.next_cursor
        if cursor is None:
            break
    assert seen == [k + 1 for k in range(60) if 7 * k <= 240]


def test_range_rules(spark):
    assert reads.clamp_limit(0) == 1000 and reads.clamp_limit(99_999) == 10_000 and reads.clamp_limit(5) == 5
    with pytest.raises(ValidationError):
        reads.check_range(T0, T0 - timedelta(seconds=1))
    with pytest.raises(ValidationError):
        reads.check_range(T0, T0 + timedelta(days=7, seconds=1))
    reads.check_range(T0, T0)
    assert names.decode_cursor(names.encode_cursor(42)) == 42
    assert names.decode_cursor("?") is None and names.decode_cursor(None) is None


def test_lookup_takes_the_latest_within_the_window(spark):
    rows = records(spark)
    now = T0 + timedelta(hours=8)
    assert reads.lookup(rows, "kind", "a", now).first()._sequence == 59
    assert reads.lookup(rows, "_record_id", "rec_3", now).first()._sequence == 4
    assert reads.lookup(rows, "id", "3", now).first()._sequence == 4
    assert reads.lookup(rows, "absent", "null", now).first() is None
    assert reads.lookup(rows, "kind", "a", now + timedelta(days=2)).first() is None


def test_partitions_are_written_pruned_and_compacted(spark, tmp_path):
    path, rows = str(tmp_path / "s"), records(spark)
    for part in range(3):
        storage.write_partitioned(rows.where(F.col("_sequence") % 3 == part), path)
    stored = tables.stored_records(spark, path)
    found = reads.in_range(stored, T0 + timedelta(hours=1), T0 + timedelta(hours=2))
    assert {r._sequence for r in found.collect()} == {k + 1 for k in range(60) if 60 <= 7 * k <= 120}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "hour" in plan.split("PartitionFilters: [")[1].split("]")[0]
    target = str(tmp_path / "t")
    log = storage.compact(spark, path, target, min_files=3)
    assert log.count() == 7
    assert sorted(r._sequence for r in spark.read.parquet(target).collect()) == list(range(1, 61))
    assert storage.list_files(spark, target).count() == 7
    assert storage.manifest(stored).agg(F.sum("record_count")).first()[0] == 60


# ---------------------------------------------------------------- transforms


def test_projection(spark):
    p = '{"a":{"b":1,"c":[2]},"d":null,"e":"x"}'
    got = run(spark, [p, "[1]", "null", "{} x", "{}"], Projection(include=("a.b", "d", "zz", "q.*")))
    assert json.loads(got[0][0]) == {"a": {"b": 1}, "d": None, "zz": None}
    assert [g[0] for g in got[1:4]] == [None] * 3 and all(g[1] for g in got[1:4])
    assert json.loads(run(spark, [p], Projection(include=("a.*",)))[0][0]) == {"a": {"b": 1, "c": [2]}}
    assert json.loads(run(spark, [p], Projection(exclude=("a.c", "e", "no.pe")))[0][0]) == {"a": {"b": 1}, "d": None}
    with pytest.raises(ValidationError):
        Projection()


def test_coercion(spark):
    values = ['"12"', '"12.7"', "-2.7", '"1e3"', "true", "null", '"yes"', "9223372036854775808", "[1]"]
    payloads = [f'{{"x":{v}}}' for v in values] + ["{}"]
    got = run(spark, payloads, Coercion((Rule("x", "int64"),)))
    assert [json.loads(t)["x"] if t and t != "{}" else t for t, _ in got] == [12, 12, -2, 1000, 1, None, None, None, None, "{}"]
    assert [m for _, m in got if m] == ["coerce field x to int64"] * 3
    got = run(spark, payloads, Coercion((Rule("x", "bool", on_error="use_default", default=False),)))
    assert json.loads(got[4][0])["x"] is True and json.loads(got[6][0])["x"] is False
    with pytest.raises(ValidationError):
        Coercion((Rule("x", "date"),))


def test_timestamps(spark):
    values = ["1705312200", '"1705312200.5"', '"2024-01-15T10:30:00+02:00"', '"2024-01-15 10:30:00"', '"2024-01-15"', '"junk"', "null"]
    got = run(spark, [f'{{"t":{v}}}' for v in values] + ["{}"], TimestampNormalisation("t"))
    texts = [json.loads(t)["t"] if t else None for t, _ in got]
    assert texts == ["2024-01-15T09:50:00.000000Z", "2024-01-15T09:50:00.500000Z", "2024-01-15T08:30:00.000000Z", "2024-01-15T10:30:00.000000Z", None, None, "2024-01-05T03:00:00.000000Z", "2024-01-05T03:00:00.000000Z"]
    assert run(spark, ['{"t":1705312200123}'], TimestampNormalisation("t", ("unix_millis",)))[0][0] == '{"t":"2024-01-15T09:50:00.123000Z"}'


def test_first_error_stays_and_good_rows_go_on(spark):
    both = Pipeline((Projection(include=("x",)), Coercion((Rule("x", "int64"), Rule("x", "bool")))))
    rows = spark.createDataFrame([(1, '{"x":"1"}'), (2, '{"x":"q"}'), (3, "no json")], "k int, payload string").withColumn("_stream_id", F.lit("s")).withColumn("_ingested_at", F.lit(T0))
    good, bad = split(both.run(rows))
    assert [(r.k, r.payload) for r in good.collect()] == [(1, '{"x":true}')]
    assert sorted((r.k, r.payload, r.error.stage, r.origin.retry_count) for r in bad.collect()) == [(2, '{"x":"q"}', "coercion", 0), (3, "no json", "projection", 0)]


def test_pipeline_configs():
    p = Pipeline.of([{"type": "coercion", "order": 2, "config": {"rules": [{"field": "a", "target_type": "bool"}]}}, {"type": "projection", "order": 1, "config": {"include": ["a"]}}])
    assert [s.kind for s in p.stages] == ["projection", "coercion"]
    for bad in (lambda: Pipeline(()), lambda: stage("nope", {}), lambda: Pipeline.of([{"type": "projection", "order": 2, "config": {"include": ["a"]}}])):
        with pytest.raises(ValidationError):
            bad()


# ---------------------------------------------------------------- schemas


def wrong(spark, schema, *payloads):
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(payloads)], "k int, payload string")
    return [sorted({e.path for e in r.errors}) for r in schemas.validate(rows, schema).orderBy("k").collect()]


def test_validation(spark):
    parcel = {
        "type": "object", "required": ["code", "state", "sent"],
        "properties": {
            "code": {"type": "string", "minLength": 2, "maxLength": 9}, "state": {"type": "string", "enum": ["open", "lost"]}, "sent": {"type": "string", "format": "date-time"},
            "weight": {"type": "number", "exclusiveMinimum": 0}, "box": {"type": "object", "properties": {"kind": {"enum": ["crate"]}}},
        },
    }
    good = '{"code":"k7","state":"lost","sent":"2023-07-01T00:00:00+02:00","weight":0.5,"box":{"kind":"crate","deep":[1]}}'
    bad = '{"code":"k","state":"gone","weight":0,"box":{"kind":"bag"}}'
    got = wrong(spark, parcel, good, bad, "{", "[]")
    assert got == [[], ["$", "$.box.kind", "$.code", "$.state", "$.weight"], ["$"], ["$"]]


def test_other_keywords(spark):
    cases = [
        ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ['"a"', "7"], ["3"]), ({"not": {"type": "null"}}, ["1"], ["null"]), ({"oneOf": [{"minimum": 5}, {"maximum": 9}]}, ["3", "12"], ["7"]),
        ({"items": {"type": "integer"}, "minItems": 1, "uniqueItems": True}, ["[1,2]"], ["[]", "[1,1]", '[1,"a"]']), ({"additionalProperties": False, "properties": {"a": {}}}, ['{"a":1}'], ['{"b":1}']),
        ({"if": {"required": ["a"]}, "then": {"required": ["b"]}}, ['{"a":1,"b":1}', "{}"], ['{"a":1}']), ({"$ref": "#/definitions/p", "definitions": {"p": {"multipleOf": 3}}}, ["6"], ["7"]),
        ({"type": ["integer", "null"]}, ["1", "2.0", "null"], ["1.5", "true"]), ({"const": {"a": 1}}, ['{"a":1}'], ['{"a":2}']), ({"pattern": "^a+$"}, ['"aa"'], ['"b"']),
    ]
    for schema, good, bad in cases:
        got = wrong(spark, schema, *good, *bad)
        assert [bool(g) for g in got] == [False] * len(good) + [True] * len(bad), schema


def test_registry(spark):
    r, text = schemas.Registry(), '{"type":"object","required":["a"],"properties":{"a":{}}}'
    one = r.register("clicks", text)
    assert one.id == "default.clicks.v1" and r.register("clicks", text) is one
    with pytest.raises(Conflict):
        r.register("clicks", '{"required":["a","b"],"properties":{"a":{},"b":{}}}')
    assert r.register("clicks", '{"required":["a"],"properties":{"a":{},"b":{}}}').version == 2
    assert r.get("clicks").version == 2 and r.get("clicks", 1) == one and len(r.list()) == 2
    with pytest.raises(NotFound):
        r.get("nope")
    with pytest.raises(ValidationError):
        r.register("x", "{")
    old, new = {"required": ["a"], "properties": {"a": {}}}, {"properties": {"a": {}}}
    assert not schemas.compatibility_problems(old, new, "backward") and schemas.compatibility_problems(old, new, "forward")
    assert schemas.compatibility_problems(old, new, "full") and not schemas.compatibility_problems(old, {}, "none")


# ---------------------------------------------------------------- ingest, control, metrics


def test_dedup_window_runs_from_the_last_kept(spark):
    hours = [0, 10, 23, 24, 30, 47, 48, 100]
    rows = [(k, "k", T0 + timedelta(hours=h)) for k, h in enumerate(hours)] + [(50, None, T0), (51, None, T0), (52, "", T0), (53, "", T0)]
    df = spark.createDataFrame(rows, "_sequence bigint, key string, _ingested_at timestamp_ntz")
    assert sorted(r._sequence for r in ingest.dedup(df, ["key"]).collect()) == [0, 3, 6, 7, 50, 51, 52, 53]


def test_sequences_go_on(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "s string, o int")
    last = spark.createDataFrame([("a", 7)], "s string, last_sequence bigint")
    assert sorted((r.s, r.sequence) for r in ingest.assign_sequences(df, "s", ["o"], last).collect()) == [("a", 8), ("a", 9), ("b", 1)]


def test_import_is_all_or_nothing(spark, tmp_path):
    for name, text, n, status in (("good", '{"a":1}\n\n [2] \n', 2, "COMPLETED"), ("bad", '{"a":1}\n{oops\n3\n', 0, "FAILED")):
        (tmp_path / name).write_text(text)
        rows, verdict = ingest.import_lines(tables.json_lines(spark, str(tmp_path / name)), "line_number", "text")
        v = verdict.first()
        assert rows.count() == n and v.status == status and v.error_line == (None if n else 2)


def test_import_jobs_fail_one_by_one_at_any_line(spark):
    rows = [(k, "a" if k % 2 else "b", "{oops" if k in (901, 1903) else '{"a":1}') for k in range(1, 2001)] + [(1, None, "3"), (2, None, " ")]
    records, verdict = ingest.import_jobs(spark.createDataFrame(rows, "n bigint, day string, text string"), "day", "n", "text")
    got = {r.job: (r.processed, r.succeeded, r.failed, r.status, r.error_line) for r in verdict.collect()}
    assert got == {"a": (1000, 0, 1000, "FAILED", 901), "b": (1000, 1000, 0, "COMPLETED", None), None: (1, 1, 0, "COMPLETED", None)}
    assert {r.job: r["count"] for r in records.groupBy("job").count().collect()} == {"b": 1000, None: 1}


def test_other_imports(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "a int, b string").write.parquet(str(tmp_path / "p"))
    (tmp_path / "c.csv").write_text("a,b\n1,x\n")
    assert json.loads(tables.parquet_payloads(spark, str(tmp_path / "p")).first().payload) == {"a": 1, "b": "x"}
    assert json.loads(tables.csv_payloads(spark, str(tmp_path / "c.csv")).first().payload) == {"a": "1", "b": "x"}


def test_names_and_states(spark):
    good = ["qzt", "q" * 63, "q-z", "qz-", "q--z", "q7z", "qz7"]
    bad = ["q", "qz", "q" * 64, "-qz", "7qz", "Qzt", "qZt", "qzT", "_qz", "q_z", " qz", "qz ", "", "qzt\n", "left.right"]
    df = spark.createDataFrame([(x,) for x in good + bad], "x string")
    assert sorted(r.x for r in df.where(names.valid_name(F.col("x"))).collect()) == sorted(good)
    assert control.move("active", "paused") == "paused"
    with pytest.raises(InvalidState):
        control.move("deleted", "active")


def test_visible(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "_stream_id string, x int")
    allow = lambda *p: control.visible(rows, spark.createDataFrame(list(p), "stream_id string, action string")).count()
    assert allow(("a", "read")) == 1 and allow(("*", "read")) == 2 and allow(("*", "write")) == 0


def test_quantile(spark):
    rows = spark.createDataFrame([(0.5,), (1.5,), (1.6,), (9.0,)], "v double")
    assert metrics.quantile(metrics.histogram(rows, "v", (1.0, 2.0)), 0.5).first()[0] == 1.5
    assert metrics.quantile(metrics.histogram(rows, "v", (1.0, 2.0)), 0.99).first()[0] == 2.0


def test_partition_paths(spark):
    df = spark.createDataFrame([(datetime(2024, 3, 9, 4, 5),)], "t timestamp_ntz")
    hourly, daily = df.select(times.partition_path(F.lit("s"), F.col("t")), times.partition_path(F.lit("s"), F.col("t"), "daily")).first()
    assert hourly == "streams/s/partitions/year=2024/month=03/day=09/hour=04" and daily == "streams/s/partitions/year=2024/month=03/day=09"


def test_payloads_are_one_value(spark):
    whole = ['{"a":1}', "1", "null", '"x"', "[]", ' {"a":{}} ']
    broken = ["", " ", "1,2", "1 2", "{", "1],[2", '{"a":1}}', "nul", None]
    rows = spark.createDataFrame([(p,) for p in whole + broken], "p string")
    assert [r[0] for r in rows.select(V.parse(F.col("p")).isNotNull()).collect()] == [True] * len(whole) + [False] * len(broken)


def test_dedup_where_sequences_repeat_between_keys(spark):
    """a1 and b2 are first; a2 and b1 follow them within the day and are told so."""
    rows = [("a", 1, 0), ("a", 2, 1), ("b", 2, 0), ("b", 1, 2)]
    df = spark.createDataFrame([(k, n, T0 + timedelta(hours=h)) for k, n, h in rows], "key string, _sequence bigint, _ingested_at timestamp_ntz")
    got = {(r.key, r._sequence): (r.repeat, r.original) for r in ingest.acknowledge(df, ["key"]).collect()}
    assert got == {("a", 1): (False, 1), ("a", 2): (True, 1), ("b", 2): (False, 2), ("b", 1): (True, 2)}
    assert sorted(tuple(r)[:2] for r in ingest.dedup(df, ["key"]).collect()) == [("a", 1), ("b", 2)]
    assert ingest.dedup(df.limit(0), ["key"]).collect() == []


def test_dedup_of_a_key_that_never_rests(spark):
    import random

    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.5 else rng.choice("xyz"), k, T0 + timedelta(minutes=rng.randrange(60 * 24 * 9))) for k in range(30_000)]
    df = spark.createDataFrame(rows, "key string, _sequence bigint, _ingested_at timestamp_ntz")
    want, last = set(), {}
    for key, n, t in sorted(rows, key=lambda r: (r[2], r[1])):
        if key not in last or t - last[key] >= timedelta(hours=24):
            last[key] = t
            want.add(n)
    assert {r._sequence for r in ingest.dedup(df, ["key"]).collect()} == want


def test_pages_where_time_and_sequence_differ_in_order(spark):
    rows = spark.createDataFrame([(f"r{n}", "s", n, T0 + timedelta(minutes=m), "{}") for n, m in ((5, 0), (1, 1), (9, 1), (2, 2), (3, 2), (8, 3))], SCHEMA)
    cursor, seen = None, []
    while True:
        page = reads.query_time_range(rows, T0, T0 + timedelta(hours=1), 2, cursor)
        seen += [r.sequence_number for r in page.rows]
        cursor = page.next_cursor
        if cursor is None:
            break
    assert seen == [5, 1, 9, 2, 3, 8]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    for name, n in (("a", 5_000), ("b", 3)):
        (tmp_path / name).write_bytes(b"".join(f"line {k}".encode() + (b"\r\n" if k % 2 else b"\n") for k in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = tables.json_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = rows.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 5_003 and all(r.text == f"line {r.line_number}" for r in got)


def test_access(spark):
    list_ = lambda *p: [(kind, name, list(actions)) for kind, name, actions in p]
    cases = [
        ("admin", "api_key", "k", "admin", None, True), (None, "stream", "", "read", None, False), ("operator", "pipeline", "", "admin", None, False),
        ("reader", "stream", "s1", "read", list_(("stream", "s1", ["read"])), True), ("reader", "stream", "s2", "read", list_(("stream", "s1", ["read"])), False),
        ("reader", "stream", "s2", "read", list_(("stream", "*", ["admin"])), True), ("reader", "stream", "s1", "write", list_(("stream", "*", ["admin"])), False),
        ("writer", "stream", "s1", "write", list_(("schema", "s1", ["write"])), False), ("writer", "stream", "s1", "write", None, False), ("writer", "schema", "x", "write", None, True),
        ("reader", "schema", "", "write", None, False), ("schema_admin", "config", "", "read", None, False), ("operator", "config", "", "read", None, True), ("operator", "config", "", "write", None, False),
        ("guest", "pipeline", "", "read", None, True), ("guest", "schema", "", "read", None, False),
    ]
    df = spark.createDataFrame(cases, f"role string, kind string, name string, action string, permissions {control.PERMISSIONS}, want boolean")
    got = df.select("*", control.may(*[F.col(c) for c in ("role", "kind", "name", "action", "permissions")]).alias("got")).where("got is distinct from want").collect()
    assert got == []


def test_audit_and_listing(spark, tmp_path):
    path, events = str(tmp_path / "audit"), [(T0 + timedelta(hours=k), "ann", "create" if k % 2 else "delete", "stream", f"s{k}", None) for k in range(40)]
    for part in (events[:20], events[20:]):
        control.audit(spark.createDataFrame(part, control.AUDIT), path)
    got = control.audited(spark.read.parquet(path), 3, action="create").collect()
    assert [r.resource_id for r in got] == ["s39", "s37", "s35"]
    streams = spark.createDataFrame([("a", "active"), ("b", "deleted"), ("c", None)], "name string, status string")
    assert [r.name for r in control.listed(streams, F.col("name")).collect()] == ["a", "c"]
    assert [r.name for r in control.listed(streams, F.col("name"), status="deleted").collect()] == ["b"]


def test_requests_become_records_on_disk(spark, tmp_path):
    asked = [
        ("s", "v1", '{"a":1}', "k", 0), ("s", "v1", '{"a":2}', "k", 1), ("s", "v1", '{"a":3}', None, 2), ("t", "v1", '{"a":4}', "k", 3), ("s", "", '{"a":5}', None, 4),
        ("s", "v1", '{"a":"x"}', None, 5), ("s", "v1", '{"a":6}', "k", 25),
    ]
    requests = spark.createDataFrame([(*r[:4], T0 + timedelta(hours=r[4]), k) for k, r in enumerate(asked)], "stream_id string, schema_id string, payload string, idempotency_key string, ts timestamp_ntz, arrival bigint")
    last = spark.createDataFrame([("t", 100)], "stream_id string, last_sequence bigint")
    told = ingest.admit(requests, {"properties": {"a": {"type": "integer"}}}, last)
    got = {r.arrival: (r.status, r.repeat, r.sequence_number) for r in told.collect()}
    assert got == {0: ("OK", False, 1), 1: ("OK", True, 1), 2: ("OK", False, 2), 3: ("OK", False, 101), 4: ("VALIDATION_ERROR", False, None), 5: ("VALIDATION_ERROR", False, None), 6: ("OK", False, 3)}
    ids = {r.arrival: r.record_id for r in told.collect()}
    assert ids[0] == ids[1] and len(set(ids.values())) == 5
    storage.write_partitioned(ingest.records_of(told), str(tmp_path / "s"))
    stored = tables.stored_records(spark, str(tmp_path / "s"))
    assert sorted((r._stream_id, r._sequence) for r in stored.collect()) == [("s", 1), ("s", 2), ("s", 3), ("t", 101)]
    import zlib

    assert all(r._crc32 == zlib.crc32(r.payload.encode()) for r in stored.collect())


def test_small_inputs_only_are_dealt_out(spark):
    cores = spark.sparkContext.defaultParallelism
    assert tables.spread(spark.range(10)).rdd.getNumPartitions() == spark.range(10).rdd.getNumPartitions()
    assert tables.spread(spark.range(0, 1_000_000, 1, 2)).rdd.getNumPartitions() == cores
    assert tables.spread(spark.range(0, 10**12, 1, 3)).rdd.getNumPartitions() == 3


def test_generation_after_compaction_has_every_partition_and_the_log_grows(spark, tmp_path):
    path, target, log_path = (str(tmp_path / x) for x in ("old", "new", "log"))
    t = datetime(2024, 1, 5, 3)
    rows = [(f"r{k}", "s", k, t if k < 3 else t.replace(hour=7), "{}") for k in range(5)]
    for row in rows:
        storage.write_partitioned(spark.createDataFrame([row], SCHEMA), path)
    for _ in range(2):
        log = storage.compact(spark, path, f"{target}{_}", min_files=3)
        storage.log_compaction(log, F.lit(t).cast("timestamp_ntz"), log_path)
    whole = storage.generation(spark, path, f"{target}0")
    assert sorted((r._record_id, r.hour) for r in whole.collect()) == [("r0", 3), ("r1", 3), ("r2", 3), ("r3", 7), ("r4", 7)]
    assert [(r.hour, r.files) for r in spark.read.parquet(log_path).collect()] == [(3, 3)] * 2
    assert storage.list_files(spark, f"{target}0").count() == 1


def test_rename_moves_members_of_the_payload_as_it_came(spark):
    swap = Pipeline.of([{"type": "rename", "order": 1, "config": {"fields": {"a": "b", "b": "a", "gone": "c"}}}])
    rows = spark.createDataFrame([(1, '{"a":1,"b":[2],"c":3}'), (2, '{"a":null}'), (3, "{}"), (4, "[1]"), (5, None)], "_sequence bigint, payload string")
    got = {r._sequence: r.transformed or r.error.message for r in swap.run(rows).collect()}
    assert got == {1: '{"a":[2],"b":1,"c":3}', 2: '{"b":null}', 3: "{}", 4: "payload is not an object", 5: "payload is not valid JSON"}
    for bad in ((), (("a", "b"), ("a", "c")), (("a", "c"), ("b", "c"))):
        with pytest.raises(ValidationError):
            Rename(bad)


def test_range_of_one_stream_its_metadata_and_times_as_text(spark):
    t = datetime(2024, 1, 5, 3, 10)
    at = [("a", t), ("a", t.replace(minute=50, microsecond=500000)), ("b", t.replace(minute=20, microsecond=1)), ("a", t.replace(hour=9))]
    rows = spark.createDataFrame([(f"r{k}", s, k, x, "{}") for k, (s, x) in enumerate(at)], SCHEMA)
    assert [r._sequence for r in reads.range_rows(rows, t, t.replace(hour=10), stream="a").collect()] == [0, 1, 3]
    assert reads.query_time_range(rows, t, t.replace(hour=10), 1, stream="b").next_cursor is None
    assert tuple(reads.range_metadata(rows, t, t.replace(minute=30)).first()) == (1, 3, 2)
    assert tuple(reads.range_metadata(rows, t, t.replace(hour=10), "a").first()) == (2, 3, 3)
    assert tuple(reads.range_metadata(rows.where("false"), t, t).first()) == (0, 0, 0)
    assert [r.ingested_at for r in reads.wire_text(rows).orderBy("sequence_number").collect()] == ["2024-01-05T03:10:00Z", "2024-01-05T03:50:00.5Z", "2024-01-05T03:20:00.000001Z", "2024-01-05T09:10:00Z"]


def test_low_gauges_and_silent_windows_of_the_connected(spark):
    t = datetime(2024, 1, 5)
    rows = spark.createDataFrame([("a", t, 1, 5.0), ("a", t, 2, 50.0), ("b", t, 1, 50.0), ("b", t, 2, 5.0), ("c", t, 1, 5.0), ("c", t, 2, None)], "who string, ts timestamp_ntz, n int, v double")
    assert [r.who for r in metrics.low_gauges(rows, ["ts", "n"], "v", ["who"], 20).collect()] == ["b"]
    gauge = spark.createDataFrame([(t.replace(minute=m), float(v)) for m, v in ((0, 1), (5, 1), (10, 0))], "ts timestamp_ntz, v double")
    calls = spark.createDataFrame([(t.replace(minute=6),)], "ts timestamp_ntz")
    silent = metrics.silent_while_connected(calls, "ts", gauge, "ts", "v", t, t.replace(hour=1), 5)
    assert [str(r.bucket) for r in silent.collect()] == [str(t)]
