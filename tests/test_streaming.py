from datetime import datetime, timedelta

from pyspark.sql import functions as F

from runnel.operators import ingest
from runnel.sources import tables
from runnel.streaming import streams

T0 = datetime(2024, 1, 5, 3)
SCHEMA = "_record_id string, _stream_id string, _sequence bigint, _ingested_at timestamp_ntz, payload string"


def put(spark, path, rows):
    spark.createDataFrame([(f"r{k}", key, k, T0 + timedelta(hours=h), "{}") for k, key, h in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_tail_delivers_each_record_once(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for part in ([(1, "a", 0), (2, "a", 1)], [(3, "b", 2)]):
        put(spark, source, part)
        live = streams.replay_then_tail(tables.tail(spark, source), start_sequence=2, live_from=T0 + timedelta(hours=2))
        streams.write_batches(live, mark, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).awaitTermination(120)
    got = sorted((r._sequence, r.is_historical) for r in spark.read.parquet(out).collect())
    assert got == [(2, True), (3, False)]


def test_streaming_dedup_agrees_with_batch(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    parts = [[(1, "a", 0), (2, "a", 10), (3, "b", 11)], [(4, "a", 23), (5, "a", 25), (6, "b", 36)], [(7, "a", 48), (8, "a", 49), (9, None, 48), (10, None, 48), (11, "", 48), (12, "", 48)]]
    for part in parts:
        put(spark, source, part)
        kept = streams.dedup_stream(tables.tail(spark, source), ["_stream_id"])
        streams.write_batches(kept, mark, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).awaitTermination(180)
    want = {r._sequence for r in ingest.dedup(spark.read.parquet(source), ["_stream_id"]).collect()}
    assert {r._sequence for r in spark.read.parquet(out).select(F.col("_sequence")).collect()} == want == {1, 3, 5, 6, 8, 9, 10, 11, 12}


def test_streaming_dedup_with_state_that_expires(spark, tmp_path):
    import time

    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    put(spark, source, [(1, "a", 0), (2, "a", 10), (3, "a", 24), (4, "b", 1)])
    kept = streams.dedup_stream(tables.tail(spark, source), ["_stream_id"], expire=True)
    running = kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).start()
    try:
        got, until = set(), time.time() + 60
        while len(got) < 3 and time.time() < until:
            time.sleep(1)
            try:
                got = {r._sequence for r in spark.read.schema(SCHEMA).parquet(out).collect()}
            except Exception:  # nothing is written yet
                assert running.exception() is None
    finally:
        running.stop()
    assert got == {1, 3, 4}


def test_streaming_dedup_of_keys_that_share_slots(spark, tmp_path):
    import random

    rng, schema = random.Random(5), "_sequence bigint, _ingested_at timestamp_ntz, user bigint, kind string, rate double"
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = []
    for k in range(3000):
        user = None if k % 50 == 0 else rng.randrange(150) - 5
        kind, rate = rng.choice(("a", 'a"', "a,", "", None, "b")), rng.choice((0.0, -0.0, 1.5, float("nan")))
        rows.append((k, T0 + timedelta(hours=k / 3000 * 120, microseconds=rng.randrange(3)), user, kind, rate))
    rows += [(3000 + k, T0 + timedelta(hours=60 + k), 2, "b", 1.5) for k in range(60)]
    rows.sort(key=lambda r: r[1])
    for part in (rows[:1000], rows[1000:1100], rows[1100:]):
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        kept = streams.dedup_stream(spark.readStream.schema(schema).parquet(source), ["user", "kind", "rate"], slots=3)
        streams.write_batches(kept, mark, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).awaitTermination(180)
    want, last = [], {}
    for number, t, user, kind, rate in sorted(rows, key=lambda r: (r[1], r[0])):
        key = (user, kind, rate)
        if None in key or kind == "" or rate != rate or key not in last or t - last[key] >= timedelta(hours=24):
            last[key] = t
            want.append((number, t, user, kind))
    got = [(r._sequence, r._ingested_at, r.user, r.kind) for r in spark.read.parquet(out).collect()]
    assert sorted(got, key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])


def test_streaming_dedup_takes_a_slot_of_keys_in_one_call():
    import pandas as pd

    class Held(dict):
        exists, getValue, updateValue = dict.__len__, dict.get, dict.__setitem__

    one = streams._LastKept(24, "ts", "n", "name", ["n", "ts"], False)
    one.last = Held({("b",): ((T0 - datetime(1970, 1, 1)) // timedelta(microseconds=1),)})
    batch = pd.DataFrame([(3, T0 + timedelta(hours=25), "a"), (1, T0, "a"), (2, T0 + timedelta(hours=23), "a"), (4, T0 + timedelta(hours=1), "b"), (5, T0, None), (6, T0, None)], columns=["n", "ts", "name"])
    assert [n for part in one.handleInputRows((0,), iter([batch[:3], batch[3:]]), None) for n in part["n"]] == [1, 5, 6, 3]
    assert set(one.last) == {("a",), ("b",)}
