"""Structured Streaming: idempotent ingest, replay then tail, and running totals."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..model import DEDUP_HOURS


class _LastKept(StatefulProcessor):
    """Holds the time of each key's last kept row, for as long as it can matter. Rows come in slots of many keys, with
    their key as text in `name` (null: no key); those of a batch are taken in order of time and sequence."""

    def __init__(self, hours: int, ts: str, sequence: str, name: str, columns: list[str], expire: bool):
        self.gap, self.ts, self.sequence, self.name, self.columns, self.expire = hours * 3_600_000_000, ts, sequence, name, columns, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "name string", "micros bigint", self.gap // 1000 if self.expire else None)

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows), ignore_index=True).sort_values([self.ts, self.sequence], kind="stable")
        codes, names = pd.factorize(batch[self.name])
        t = pd.to_datetime(batch[self.ts]).astype("datetime64[us]").astype("int64")
        # a slot without state, as all are in a first batch, is not asked for each key
        held = [self.last.getValue((n,)) for n in names] if self.last.exists() else [None] * len(names)
        last = [None if x is None else x[0] for x in held]
        keep, changed = np.ones(len(batch), bool), set()
        for at, (code, micros) in enumerate(zip(codes.tolist(), t.tolist())):
            if code < 0:
                continue
            if last[code] is None or micros - last[code] >= self.gap:
                last[code] = micros
                changed.add(code)
            else:
                keep[at] = False
        for code in changed:
            self.last.updateValue((names[code],), (last[code],))
        if keep.any():
            yield batch.loc[keep, self.columns]

    def close(self) -> None:
        pass


def dedup_stream(records: DataFrame, key: list[str], hours: int = DEDUP_HOURS, ts: str = "_ingested_at", sequence: str = "_sequence", expire: bool = False, slots: int = 4096) -> DataFrame:
    """The streaming form of operators.ingest.dedup; needs the RocksDB state store.

    With expire, for queries that run on and on, the state of a key is dropped once it was not renewed for `hours` by the
    clock; a repeat that comes that late, though its own time is earlier, then passes. Without it, for queries that take
    what is there and stop (Spark never finds such a query done while it has a clock), state lasts as long as the query.

    Keys are dealt over slots, and a slot's rows of a micro-batch go through Python at once, as calls for single keys cost
    more than their rows. State is by key, in the slot's map; a checkpoint holds for one number of slots.
    """
    # rows come to the processor by way of named tuples, whose fields must not begin with an underscore
    plain = {c: f"c{k}" for k, c in enumerate(records.columns)}
    renamed = records.withColumnsRenamed(plain)
    no_key, parts = F.lit(False), []
    for c in (plain[k] for k in key):
        real = renamed.schema[c].dataType.typeName() in ("double", "float")
        no_key = no_key | F.col(c).isNull() | (F.isnan(c) if real else F.col(c).cast("string") == "")
        parts.append((F.col(c) + 0 if real else F.col(c)).cast("string"))  # no negative zero
    named = renamed.withColumn("name", F.when(~no_key, F.to_json(F.array(*parts))))
    slotted = named.withColumn("slot", F.pmod(F.xxhash64(F.coalesce("name", F.col(plain[sequence]).cast("string"))), F.lit(slots)))
    kept = slotted.groupBy("slot").transformWithStateInPandas(
        _LastKept(hours, plain[ts], plain[sequence], "name", renamed.columns, expire), outputStructType=renamed.schema, outputMode="Append", timeMode="ProcessingTime" if expire else "None"
    )
    return kept.withColumnsRenamed({v: k for k, v in plain.items()})


def replay_then_tail(records: DataFrame, start: datetime | None = None, start_sequence: int | None = None, live_from: datetime | None = None) -> DataFrame:
    """A streaming read of a stream from a time or sequence on; is_historical says whether a row is from before live_from."""
    if start is not None:
        records = records.where(F.col("_ingested_at") >= F.lit(start).cast("timestamp_ntz"))
    if start_sequence is not None:
        records = records.where(F.col("_sequence") >= start_sequence)
    historical = F.lit(True) if live_from is None else F.col("_ingested_at") < F.lit(live_from).cast("timestamp_ntz")
    return records.withColumn("is_historical", historical)


def write_batches(records: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], **options: str):
    """Runs write on each micro-batch of what is there and stops; batch numbers let write be idempotent."""
    return records.writeStream.option("checkpointLocation", checkpoint).options(**options).foreachBatch(write).trigger(availableNow=True).start()


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in spark.checkpoint.dir, which driver and executors share; on a local master without it, below /tmp."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file:///tmp/checkpoints/runnel"
    return f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def run_available(records: DataFrame, what: str) -> DataFrame:
    """Runs a stream over what is there, to Parquet in the shared folder, and reads that: a batch's rows are in place once,
    however often it is tried."""
    spark = records.sparkSession
    path = shared_path(spark, what)
    run = records.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/mark").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(records.schema).parquet(f"{path}/rows")
