"""Sequences over slices of time."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from runnel.operators import ingest

SCHEMA = "stream string, at timestamp_ntz, id bigint, sequence_of string"


def rows_of(n):
    rng = random.Random(8)
    start = datetime(2024, 5, 1)
    # one stream has most rows, some times are equal or null, one stream is null
    return [(rng.choice(["hot"] * 6 + ["b", None]), None if k % 40 == 0 else start + timedelta(seconds=rng.randrange(900)), k, "mine") for k in range(n)]


def test_slices_number_as_one_walk(spark):
    rows = rows_of(600)
    want, n = {}, {}
    for s, t, i, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or datetime.min, r[2])):
        want[i] = n[s] = n.get(s, 0) + 1
    df = spark.createDataFrame(rows, SCHEMA)
    for seconds in (1, 60, 10_000):
        got = ingest.assign_sequences(df, "stream", ["at", "id"], slice_seconds=seconds)
        assert got.columns == [*df.columns, "sequence"]
        assert {r.id: r.sequence for r in got.collect()} == want
    assert {r.id: r.sequence for r in ingest.assign_sequences(df.where("at is not null"), "stream", ["id"]).where("stream = 'b'").collect()} == {
        i: k + 1 for k, i in enumerate(sorted(i for s, t, i, _ in rows if s == "b" and t))
    }
    assert ingest.assign_sequences(df.limit(0), "stream", ["at", "id"]).collect() == []


def test_slices_go_on_from_the_last_sequence(spark):
    df = spark.createDataFrame(rows_of(100), SCHEMA)
    last = spark.createDataFrame([("hot", 1000)], "stream string, last_sequence bigint")
    got = ingest.assign_sequences(df, "stream", ["at", "id"], last).groupBy("stream").agg(F.min("sequence").alias("lo"), F.count("*").alias("n"), F.max("sequence").alias("hi")).collect()
    assert {r.stream: (r.lo, r.hi) for r in got} == {r.stream: (1001, 1000 + r.n) if r.stream == "hot" else (1, r.n) for r in got}
