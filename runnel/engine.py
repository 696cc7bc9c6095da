"""The engine over stored tables: streams, schemas, pipelines, records, dead letters and audit below one folder.

Catalog tables are append-only: a change is a new row with the next revision, and the latest revision of a name is what
holds. One writer at a time changes a catalog or ingests into a stream; readers need no care.
"""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions.names import valid_name
from .model import DEDUP_HOURS, PARTITIONS, RETENTION_DAYS, Conflict, InvalidState, NotFound, ValidationError
from .operators import control, ingest, schemas, storage, transforms
from .plans import reads
from .streaming import streams

STREAMS = "stream_id string, schema_id string, status string, retention_days int, revision bigint, at timestamp_ntz"
SCHEMAS = "namespace string, name string, version int, text string, fingerprint string, status string"
PIPELINES = "pipeline_id string, source_stream string, stages string, status string, revision bigint, at timestamp_ntz"
ACKS = (
    "stream_id string, schema_id string, payload string, idempotency_key string, ts timestamp_ntz, arrival bigint, error_message string, "
    "repeat boolean, record_id string, sequence_number bigint, timestamp_unix_micros bigint, status string"
)
RECORDS = "_record_id string, _stream_id string, _sequence bigint, _ingested_at timestamp_ntz, payload string, _crc32 bigint"
#: Folders that rows of a batch lie in, below the table.
BATCH, HOURS = "stream string, batch bigint", ", ".join(f"{p} int" for p in PARTITIONS)


class Engine:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self._path(name))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, table: str, schema: str, /, **row) -> None:
        self.spark.createDataFrame([Row(**row)], schema).coalesce(1).write.mode("append").parquet(self._path(table))

    def _latest(self, name: str, schema: str, key: str) -> DataFrame:
        rows = self._table(name, schema)
        return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "revision").alias("r")).select("r.*")

    def _one(self, name: str, schema: str, key: str, value: str) -> Row | None:
        return self._latest(name, schema, key).where(F.col(key) == value).first()

    def _note(self, at: datetime, actor: str, action: str, kind: str, name: str, detail: str = "") -> None:
        control.audit(self.spark.createDataFrame([(at, actor, action, kind, name, detail)], control.AUDIT).coalesce(1), self._path("audit"))

    # streams

    def create_stream(self, stream_id: str, schema_id: str, at: datetime, retention_days: int = RETENTION_DAYS, actor: str = "system") -> None:
        """A new active stream of records that fit a registered schema. A deleted stream's name may be taken again."""
        if not self.spark.range(1).select(valid_name(F.lit(stream_id))).first()[0]:
            raise ValidationError(f"not a name of a stream: {stream_id!r}")
        self.schema(schema_id)
        known = self._one("streams", STREAMS, "stream_id", stream_id)
        if known and known.status != "deleted":
            raise Conflict(f"stream {stream_id} is there")
        self._append("streams", STREAMS, stream_id=stream_id, schema_id=schema_id, status="active", retention_days=retention_days, revision=(known.revision if known else 0) + 1, at=at)
        self._note(at, actor, "create", "stream", stream_id)

    def stream(self, stream_id: str) -> Row:
        known = self._one("streams", STREAMS, "stream_id", stream_id)
        if not known:
            raise NotFound(f"stream {stream_id}")
        return known

    def streams(self, limit: int = 100, status: str | None = None) -> DataFrame:
        return control.listed(self._latest("streams", STREAMS, "stream_id"), F.col("stream_id"), limit, status=status)

    def move_stream(self, stream_id: str, to: str, at: datetime, actor: str = "system") -> None:
        known = self.stream(stream_id)
        status = control.move(known.status, to)
        self._append("streams", STREAMS, **known.asDict() | {"status": status, "revision": known.revision + 1, "at": at})
        self._note(at, actor, f"to {to}", "stream", stream_id)

    # schemas

    def _registry(self) -> schemas.Registry:
        registry = schemas.Registry()
        for r in sorted(self._table("schemas", SCHEMAS).collect(), key=lambda r: r.version):
            registry.versions.setdefault((r.namespace, r.name), []).append(schemas.Version(**r.asDict()))
        return registry

    def register_schema(self, name: str, text: str, namespace: str = "default", compatibility: str = "backward") -> str:
        """The id of the stored version; a text that is known is not stored again."""
        registry = self._registry()
        known = set(registry.list())
        v = registry.register(name, text, namespace, compatibility)
        if v not in known:
            self._append("schemas", SCHEMAS, namespace=v.namespace, name=v.name, version=v.version, text=v.text, fingerprint=v.fingerprint, status=v.status)
        return v.id

    def schema(self, schema_id: str) -> schemas.Version:
        for v in self._registry().list():
            if v.id == schema_id:
                return v
        raise NotFound(f"schema {schema_id}")

    # records

    def acks(self, stream_id: str) -> DataFrame:
        """What became of each request, with the number of its batch."""
        return self._table("acks", f"{ACKS}, {BATCH}").where(F.col("stream") == stream_id).drop("stream")

    def dead_letters(self, stream_id: str) -> DataFrame:
        """Refused requests with their reason."""
        return self.acks(stream_id).where("status != 'OK'").select("payload", "error_message", "ts", "arrival", "batch")

    def records(self, stream_id: str) -> DataFrame:
        self.stream(stream_id)
        return self._table("records", f"{RECORDS}, {BATCH}, {HOURS}").where(F.col("stream") == stream_id).drop("stream", "batch")

    def ingest(self, stream_id: str, requests: DataFrame, batch: int, hours: int = DEDUP_HOURS, salts: int = 1) -> DataFrame:
        """Lets a batch of requests (payload, idempotency_key, ts, arrival) into an active stream and returns what became of
        each (see ingest.admit). Batches come in order of time; repeats are found across batches, and sequences go on. An
        hour's rows go to `salts` tasks.

        A batch that is sent again under its number, such as after a failure, replaces what it had written and gives the
        same records, as long as no later batch came between.
        """
        known = self.stream(stream_id)
        if known.status != "active":
            raise InvalidState(f"stream {stream_id} is {known.status}")
        asked = requests.select("payload", "idempotency_key", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("arrival").cast("bigint").alias("arrival"))
        asked = asked.withColumns({"stream_id": F.lit(stream_id), "schema_id": F.lit(known.schema_id)})
        old = self.acks(stream_id).where((F.col("batch") < batch) & (F.col("status") == "OK") & ~F.col("repeat"))
        last = old.groupBy("stream_id").agg(F.max("sequence_number").alias("last_sequence"))
        recent, first = old.where("idempotency_key != ''"), asked.agg(F.min("ts")).first()[0]
        if first is not None:
            recent = recent.where(F.col("ts") > F.lit(first - timedelta(hours=hours)).cast("timestamp_ntz"))
        told = F.struct("ts", "record_id", "sequence_number", "timestamp_unix_micros")
        recent = recent.groupBy("stream_id", "idempotency_key").agg(F.max_by(told, "ts").alias("r")).select("stream_id", "idempotency_key", "r.*")
        admitted = ingest.admit(asked, self.schema(known.schema_id).text, last, hours, recent)
        where = f"stream={stream_id}/batch={batch}"
        admitted.select(*[f.split()[0] for f in ACKS.split(", ")]).write.mode("overwrite").parquet(self._path(f"acks/{where}"))
        done = self.spark.read.schema(ACKS).parquet(self._path(f"acks/{where}"))
        storage.write_partitioned(ingest.records_of(done), self._path(f"records/{where}"), "overwrite", salts=salts)
        return done

    def ingest_stream(self, stream_id: str, requests: DataFrame, checkpoint: str, **options: str):
        """ingest() for each micro-batch of a streaming frame of requests; batch numbers are those of the stream."""

        def take(batch: DataFrame, number: int) -> None:
            Engine(batch.sparkSession, self.root).ingest(stream_id, batch, number)

        return streams.write_batches(requests, checkpoint, take, **options)

    def query_time_range(self, stream_id: str, start: datetime, end: datetime, limit: int | None = None, cursor: str | None = None) -> reads.Page:
        return reads.query_time_range(self.records(stream_id), start, end, limit, cursor)

    def lookup_by_key(self, stream_id: str, field: str, value: str, as_of: datetime) -> DataFrame:
        return reads.lookup(self.records(stream_id), field, value, as_of)

    def streaming_read(self, stream_id: str, start: datetime | None = None, start_sequence: int | None = None, live_from: datetime | None = None) -> DataFrame:
        """A streaming frame of the stream's records from a time or sequence on; there must have been a batch."""
        self.stream(stream_id)
        tail = self.spark.readStream.schema(f"{RECORDS}, batch bigint, {HOURS}").parquet(self._path(f"records/stream={stream_id}"))
        return streams.replay_then_tail(tail.select(*[f.split()[0] for f in RECORDS.split(", ")]), start, start_sequence, live_from)

    def stats(self, stream_id: str) -> DataFrame:
        return storage.stream_snapshot(self.records(stream_id))

    def expired(self, stream_id: str, now: datetime) -> DataFrame:
        """The hours of the stream that its retention lets go."""
        return storage.expired_by_age(storage.manifest(self.records(stream_id)), now, self.stream(stream_id).retention_days)

    def audited(self, limit: int = 100, **equal: str | None) -> DataFrame:
        return control.audited(self._table("audit", control.AUDIT), limit, **equal)

    # pipelines

    def create_pipeline(self, pipeline_id: str, source_stream: str, stages: list[dict], at: datetime, actor: str = "system") -> None:
        """A pipeline of 1 to 10 stages {type, order, config}; the same name again is its next revision."""
        transforms.Pipeline.of(stages)
        self.stream(source_stream)
        known = self._one("pipelines", PIPELINES, "pipeline_id", pipeline_id)
        self._append("pipelines", PIPELINES, pipeline_id=pipeline_id, source_stream=source_stream, stages=json.dumps(stages), status="active", revision=(known.revision if known else 0) + 1, at=at)
        self._note(at, actor, "create" if not known else "update", "pipeline", pipeline_id)

    def transform(self, pipeline_id: str) -> tuple[DataFrame, DataFrame]:
        """The records of the pipeline's stream after its stages, and the dead letters."""
        known = self._one("pipelines", PIPELINES, "pipeline_id", pipeline_id)
        if not known:
            raise NotFound(f"pipeline {pipeline_id}")
        return transforms.split(transforms.Pipeline.of(json.loads(known.stages)).run(self.records(known.source_stream)))
