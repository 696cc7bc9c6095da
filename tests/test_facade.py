"""The engine over stored tables, reopened between steps."""

from datetime import datetime, timedelta

import pytest

from runnel.engine import Engine
from runnel.model import Conflict, InvalidState, NotFound, ValidationError

NOW = datetime(2024, 5, 1, 10, 30)
TEXT = '{"type": "object", "required": ["who"], "properties": {"who": {"type": "string"}}}'
REQUESTS = "payload string, idempotency_key string, ts timestamp_ntz, arrival bigint"


def requests(spark, *rows):
    return spark.createDataFrame([(p, k, NOW + timedelta(hours=h), n) for n, (p, k, h) in enumerate(rows)], REQUESTS)


def told(df):
    return [(r.arrival, r.status, r.repeat, r.sequence_number) for r in sorted(df.collect(), key=lambda r: r.arrival)]


def test_streams_schemas_records(spark, tmp_path):
    root = f"file://{tmp_path}/engine"
    engine = Engine(spark, root)
    assert engine.streams().collect() == []
    with pytest.raises(NotFound):
        engine.create_stream("visits", "default.visit.v1", NOW)
    schema = engine.register_schema("visit", TEXT)
    assert schema == "default.visit.v1" == Engine(spark, root).register_schema("visit", TEXT)
    with pytest.raises(Conflict):
        engine.register_schema("visit", '{"type": "object", "required": ["who", "when"]}')
    with pytest.raises(ValidationError):
        engine.create_stream("No Name", schema, NOW)
    engine.create_stream("visits", schema, NOW)
    with pytest.raises(Conflict):
        engine.create_stream("visits", schema, NOW)

    one = requests(spark, ('{"who": "ann"}', "k1", 0), ('{"who": 7}', "k2", 0), ('{"who": "bob"}', "k1", 1), ('{"who": "cyd"}', None, 1))
    want = [(0, "OK", False, 1), (1, "VALIDATION_ERROR", False, None), (2, "OK", True, 1), (3, "OK", False, 2)]
    assert told(engine.ingest("visits", one, 0)) == want
    engine = Engine(spark, root)
    # the batch before told about k1, 23 and 25 hours earlier
    two = requests(spark, ('{"who": "dan"}', "k1", 23), ('{"who": "eve"}', "k1", 25), ("oops", "k1", 23), ('{"who": "fay"}', "k2", 23))
    again = [(0, "OK", True, 1), (1, "OK", False, 4), (2, "VALIDATION_ERROR", False, None), (3, "OK", False, 3)]
    assert told(engine.ingest("visits", two, 1)) == again
    assert told(engine.ingest("visits", two, 1)) == again  # sent again
    rows = sorted((r._sequence, r.payload[9:12]) for r in engine.records("visits").collect())
    assert rows == [(1, "ann"), (2, "cyd"), (3, "fay"), (4, "eve")]
    assert sorted(r.payload for r in engine.dead_letters("visits").collect()) == ["oops", '{"who": 7}']

    page = engine.query_time_range("visits", NOW, NOW + timedelta(hours=24), limit=2)
    assert [r["sequence_number"] for r in page.rows] == [1, 2] and page.next_cursor
    assert [r["sequence_number"] for r in engine.query_time_range("visits", NOW, NOW + timedelta(hours=24), cursor=page.next_cursor).rows] == [3]
    assert [r._sequence for r in engine.lookup_by_key("visits", "who", "eve", NOW + timedelta(hours=26)).collect()] == [4]
    assert engine.stats("visits").first().record_count == 4
    assert engine.expired("visits", NOW + timedelta(days=400)).count() == 4 and engine.expired("visits", NOW).count() == 0

    engine.create_pipeline("names", "visits", [{"type": "projection", "order": 1, "config": {"include": ["who"]}}], NOW)
    good, bad = Engine(spark, root).transform("names")
    assert good.count() == 4 and bad.count() == 0

    engine.move_stream("visits", "paused", NOW)
    with pytest.raises(InvalidState):
        engine.ingest("visits", one, 2)
    with pytest.raises(InvalidState):
        engine.move_stream("visits", "creating", NOW)
    assert Engine(spark, root).stream("visits").status == "paused"
    assert [r.action for r in engine.audited(resource_type="stream").orderBy("action").collect()] == ["create", "to paused"]


def test_micro_batches(spark, tmp_path):
    root = f"file://{tmp_path}/engine"
    engine = Engine(spark, root)
    engine.create_stream("visits", engine.register_schema("visit", TEXT), NOW)
    for k in range(2):
        requests(spark, ('{"who": "ann"}', "k1", k), ('{"who": "bob"}', f"b{k}", k)).coalesce(1).write.mode("append").parquet(f"{root}-requests")
    source = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(f"{root}-requests")
    engine.ingest_stream("visits", source, f"{root}-mark").awaitTermination()
    assert sorted(r._sequence for r in engine.records("visits").collect()) == [1, 2, 3]
    tail = engine.streaming_read("visits", start_sequence=2)
    run = tail.writeStream.format("memory").queryName("facade_tail").option("checkpointLocation", f"{root}-tail").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r._sequence for r in spark.table("facade_tail").collect()) == [2, 3]
