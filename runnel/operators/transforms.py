"""Transform stages over JSON payloads, and pipelines that split good records from dead letters.

A payload is parsed once into a VARIANT and serialised once. A stage is a row of steps; a step puts what it reads from the
payload into columns, which generated code computes once, and gives a new value and, where the record is bad, an error.
Steps never fail. The first error of a record stays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..functions import variants as V
from ..model import MAX_STAGES, ValidationError
from ..sources.tables import spread


@dataclass(frozen=True)
class Outcome:
    value: Column
    error: Column | None = None


#: Takes the records and their payload, gives them with columns of its own, and the outcome over these.
Step = Callable[[DataFrame, Column], tuple[DataFrame, Outcome]]


class Stage:
    kind = ""

    def steps(self, now: Column) -> list[Step]:
        """What is done one after the other. A step may add columns; they are dropped after it."""
        raise NotImplementedError


@dataclass(frozen=True)
class Projection(Stage):
    """Keeps the fields of include, or drops those of exclude; include wins. `a.*` keeps all of a where there is one;
    any other missing field becomes null."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    kind = "projection"

    def __post_init__(self):
        if not self.include and not self.exclude:
            raise ValidationError("a projection needs include or exclude")

    def steps(self, now):
        def step(df, v):
            not_object = F.when(V.members(v).isNull(), F.lit("payload is not an object"))
            return df, Outcome(self._kept(v) if self.include else self._dropped(v), not_object)

        return [step]

    def _kept(self, v: Column) -> Column:
        tree: dict = {}
        for path in self.include:
            whole = path.endswith(".*")
            parts = V.split_path(path[:-2] if whole else path)
            at = tree
            for p in parts[:-1]:
                at = at.setdefault(p, {})
                if not isinstance(at, dict):
                    break
            else:
                at[parts[-1]] = whole

        def build(node: dict, above: list[str]) -> Column:
            entries = []
            for name, what in node.items():
                x = F.try_variant_get(v, V.json_path([*above, name]), "variant")
                if isinstance(what, dict):
                    entries.append((name, build(what, [*above, name]), None))
                elif what:
                    entries.append((name, x, ~V.missing(x)))
                else:
                    entries.append((name, F.coalesce(x, V.json_null()), None))
            return V.object_of(entries)

        return build(tree, [])

    def _dropped(self, v: Column) -> Column:
        for path in self.exclude:
            v = V.without_path(v, V.split_path(path))
        return v


@dataclass(frozen=True)
class Rename(Stage):
    """Moves top-level fields to other names, pairs of (from, to); a missing field is not moved, and a field that had the
    new name gives way. All moves are of the payload as it came, so names may be swapped. Members come out in order of
    their names, as in any object here."""

    fields: tuple[tuple[str, str], ...]
    kind = "rename"

    def __post_init__(self):
        if not self.fields or len({a for a, _ in self.fields}) < len(self.fields) or len({b for _, b in self.fields}) < len(self.fields):
            raise ValidationError("a rename needs pairs of names that differ from each other")

    def steps(self, now):
        def step(df, v):
            df = df.withColumn("_members", V.members(v))
            own = F.col("_members")
            to = F.create_map(*[F.lit(x) for pair in self.fields for x in pair])
            taken = F.filter(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in self.fields]), lambda p: F.map_contains_key(own, p["a"]))
            gone = F.transform(taken, lambda p: p["b"])
            left = F.map_filter(own, lambda k, _: to[k].isNotNull() | ~F.array_contains(gone, k))
            return df, Outcome(F.to_variant_object(F.transform_keys(left, lambda k, _: F.coalesce(to[k], k))), F.when(own.isNull(), F.lit("payload is not an object")))

        return [step]


@dataclass(frozen=True)
class Rule:
    """on_error: fail (dead letter), use_null or use_default."""

    field: str
    target: str
    on_error: str = "fail"
    default: object = None


@dataclass(frozen=True)
class Coercion(Stage):
    """Turns fields into string, int64, float64 or bool, rule by rule. Missing and null fields are left alone."""

    rules: tuple[Rule, ...]
    kind = "coercion"

    def __post_init__(self):
        for r in self.rules:
            if r.target not in V.COERCIONS:
                raise ValidationError(f"unsupported target type {r.target!r}")
            if r.on_error not in ("fail", "use_null", "use_default"):
                raise ValidationError(f"unknown error behaviour {r.on_error!r}")

    def steps(self, now):
        def step(rule: Rule):
            def take(df, v):
                df, values = V.with_values(df, {"_in": V.get(v, rule.field)}, rule.target in ("int64", "float64"))
                df = df.withColumn("_made", V.COERCIONS[rule.target](values["_in"]))
                made = F.col("_made")
                there, failed = ~V.missing(F.col("_in")), made.isNull()
                value = made.cast("variant")
                if rule.on_error == "use_null":
                    value = F.when(failed, V.json_null()).otherwise(value)
                elif rule.on_error == "use_default":
                    value = F.when(failed, F.lit(rule.default).cast("variant")).otherwise(value)
                changed = F.when(there, V.with_path(v, V.split_path(rule.field), value)).otherwise(v)
                error = F.when(there & failed, F.lit(f"coerce field {rule.field} to {rule.target}")) if rule.on_error == "fail" else None
                return df, Outcome(changed, error)

            return take

        return [step(r) for r in self.rules]


@dataclass(frozen=True)
class TimestampNormalisation(Stage):
    """Writes a field's time as YYYY-MM-DDTHH:MM:SS.ffffffZ. The first format that fits counts; a missing or null field
    gets the record's ingest time. target defaults to the field itself."""

    field: str
    formats: tuple[str, ...] = times.FORMATS
    target: str | None = None
    kind = "timestamp_normalization"

    def steps(self, now):
        def step(df, v):
            df, values = V.with_values(df, {"_in": V.get(v, self.field)})
            read = F.coalesce(*[times.parsed(values["_in"], f) for f in self.formats])
            df = df.withColumn("_time", F.when(V.missing(F.col("_in")), now.cast("timestamp")).otherwise(read))
            ts = F.col("_time")
            changed = V.with_path(v, V.split_path(self.target or self.field), times.normal_text(ts).cast("variant"))
            return df, Outcome(changed, F.when(ts.isNull(), F.lit(f"normalise field {self.field}")))

        return [step]


STAGES: dict[str, Callable[[dict], Stage]] = {
    "rename": lambda c: Rename(tuple(c["fields"].items())),
    "projection": lambda c: Projection(tuple(c.get("include", ())), tuple(c.get("exclude", ()))),
    "coercion": lambda c: Coercion(tuple(Rule(r["field"], r["target_type"], r.get("on_error", "fail"), r.get("default")) for r in c["rules"])),
    "timestamp_normalization": lambda c: TimestampNormalisation(c["field"], tuple(c.get("formats") or times.FORMATS), c.get("target")),
}


def register_stage(kind: str, make: Callable[[dict], Stage]) -> None:
    """Makes a stage type of the caller's own known to pipelines."""
    STAGES[kind] = make


def stage(kind: str, config: dict) -> Stage:
    if kind not in STAGES:
        raise ValidationError(f"unknown stage type {kind!r}")
    return STAGES[kind](config)


@dataclass(frozen=True)
class Pipeline:
    """1 to 10 stages in order."""

    stages: tuple[Stage, ...]

    def __post_init__(self):
        if not 1 <= len(self.stages) <= MAX_STAGES:
            raise ValidationError(f"a pipeline has 1 to {MAX_STAGES} stages")

    @staticmethod
    def of(configs: list[dict]) -> Pipeline:
        """From configs {type, order, config}; orders are 1, 2, 3 without a gap."""
        ordered = sorted(configs, key=lambda c: c["order"])
        if [c["order"] for c in ordered] != list(range(1, len(ordered) + 1)):
            raise ValidationError("stage orders are to run from 1 without a gap")
        return Pipeline(tuple(stage(c["type"], c.get("config", {})) for c in ordered))

    def run(self, records: DataFrame, payload: str = "payload", ingested_at: str = "_ingested_at") -> DataFrame:
        """records with `transformed` (JSON; null if bad) and `error` (stage, message, field; null if good) added."""
        now = F.col(ingested_at) if ingested_at in records.columns else F.current_timestamp()
        kind = "struct<stage:string,message:string,field:string>"

        def told(stage: str, message: Column) -> Column:
            return F.struct(F.lit(stage).alias("stage"), message.alias("message"), F.lit(None).cast("string").alias("field")).cast(kind)

        df = V.with_parsed(spread(records), payload, "_value")
        df = df.withColumn("_error", F.when(F.col("_value").isNull(), told(self.stages[0].kind, F.lit("payload is not valid JSON"))))
        for s in self.stages:
            for step in s.steps(now):
                df, out = step(df, F.col("_value"))
                new = {"_value": out.value}
                if out.error is not None:
                    new["_error"] = F.coalesce("_error", F.when(out.error.isNotNull(), told(s.kind, out.error)))
                df = df.withColumns(new).select(*records.columns, "_value", "_error")
        df = df.select(*records.columns, F.when(F.col("_error").isNull(), F.to_json("_value")).alias("transformed"), F.col("_error").alias("error"))
        return V.counted(df, "pipeline", dead_letters=F.count("error"))


def split(run: DataFrame, payload: str = "payload", stream: str = "_stream_id", ingested_at: str = "_ingested_at") -> tuple[DataFrame, DataFrame]:
    """(good records with the new payload, dead letters with the original payload)."""
    good = run.where("error is null").withColumn(payload, F.col("transformed")).drop("transformed", "error")
    bad = run.where("error is not null").drop("transformed")
    source = F.struct(F.col(stream).alias("source_stream"), F.col(ingested_at).alias("original_ts"), F.lit(0).alias("retry_count")) if stream in run.columns else F.struct(F.lit(0).alias("retry_count"))
    return good, bad.withColumn("origin", source)
