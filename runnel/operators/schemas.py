"""JSON Schema draft-07 compiled into columns, a versioned registry, and compatibility checks."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants as V
from ..model import Conflict, NotFound, ValidationError
from ..sources.tables import spread

ERROR = "struct<path:string,message:string,schema_path:string>"


def _error(path: str, message: str, where: str) -> Column:
    return F.struct(F.lit(path).alias("path"), F.lit(message).alias("message"), F.lit(where).alias("schema_path"))


def _resolve(schema, root, seen=()):
    if isinstance(schema, dict) and "$ref" in schema:
        ref = schema["$ref"]
        if ref in seen or not ref.startswith("#"):
            raise ValidationError(f"$ref {ref!r} is recursive or not local")
        at = root
        for p in ref.lstrip("#/").split("/") if ref != "#" else ():
            at = at[p.replace("~1", "/").replace("~0", "~")]
        return _resolve(at, root, (*seen, ref))
    return schema


_DATE_TIME = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def checks(schema, value: V.Value, path: str = "$", where: str = "#", root=None) -> list[tuple[Column, Column]]:
    """(violated, error) of each rule that schema sets for a value; null is a missing value and breaks none."""
    x = value.x
    root = schema if root is None else root
    schema = _resolve(schema, root)
    there = x.isNotNull()
    if schema is True or schema == {}:
        return []
    if schema is False:
        return [(there, _error(path, "nothing is allowed here", where))]
    kind, text = value.kind, value.text
    number = F.when(kind == "number", value.real)
    out: list[tuple[Column, Column]] = []

    def rule(violated: Column, message: str, key: str) -> None:
        out.append((F.coalesce(there & violated, F.lit(False)), _error(path, message, f"{where}/{key}")))

    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        ok = kind.isin([k for k in kinds if k != "integer"])
        if "integer" in kinds:
            ok = ok | ((kind == "number") & (number == F.floor(number)))
        rule(~ok, f"expected {' or '.join(kinds)}", "type")
    if "enum" in schema or "const" in schema:
        key = "enum" if "enum" in schema else "const"
        allowed = schema["enum"] if key == "enum" else [schema["const"]]
        literal = [json.dumps(a, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for a in allowed]
        rule(~F.to_json(x).isin(literal), "not one of the allowed values", key)
    for key, bad in (("minimum", lambda n, m: n < m), ("maximum", lambda n, m: n > m), ("exclusiveMinimum", lambda n, m: n <= m), ("exclusiveMaximum", lambda n, m: n >= m)):
        if key in schema:
            rule(bad(number, float(schema[key])), f"{key} {schema[key]}", key)
    if "multipleOf" in schema:
        q = number / float(schema["multipleOf"])
        rule(q != F.round(q), f"multipleOf {schema['multipleOf']}", "multipleOf")
    string = F.when(kind == "string", text)
    if "minLength" in schema:
        rule(F.char_length(string) < schema["minLength"], f"minLength {schema['minLength']}", "minLength")
    if "maxLength" in schema:
        rule(F.char_length(string) > schema["maxLength"], f"maxLength {schema['maxLength']}", "maxLength")
    if "pattern" in schema:
        rule(~string.rlike(schema["pattern"]), "pattern does not match", "pattern")
    if schema.get("format") == "date-time":
        rule(~(string.rlike(_DATE_TIME) & string.try_cast("timestamp").isNotNull()), "not a date-time", "format")
    if schema.get("format") == "date":
        rule(~(string.rlike(r"^\d{4}-\d{2}-\d{2}$") & string.try_cast("date").isNotNull()), "not a date", "format")
    own = V.members(x)
    for name in schema.get("required", ()):
        rule((kind == "object") & value.member(name).x.isNull(), f"{name} is required", "required")
    known = schema.get("properties", {})
    for name, sub in known.items():
        out += checks(sub, value.member(name), f"{path}.{name}", f"{where}/properties/{name}", root)
    if schema.get("additionalProperties") is False:
        rule(F.size(F.array_except(F.map_keys(own), F.array(*[F.lit(k) for k in known]).cast("array<string>"))) > 0, "additional properties", "additionalProperties")
    if "minProperties" in schema:
        rule(F.size(F.map_keys(own)) < schema["minProperties"], "minProperties", "minProperties")
    if "maxProperties" in schema:
        rule(F.size(F.map_keys(own)) > schema["maxProperties"], "maxProperties", "maxProperties")
    items = F.try_variant_get(x, "$", "array<variant>")
    if "minItems" in schema:
        rule(F.size(items) < schema["minItems"], f"minItems {schema['minItems']}", "minItems")
    if "maxItems" in schema:
        rule(F.size(items) > schema["maxItems"], f"maxItems {schema['maxItems']}", "maxItems")
    if schema.get("uniqueItems"):
        texts = F.transform(items, lambda e: F.to_json(e))
        rule(F.size(F.array_distinct(texts)) < F.size(texts), "items are not unique", "uniqueItems")
    if isinstance(schema.get("items"), (dict, bool)):
        rule(F.exists(items, lambda e: ~valid(schema["items"], e, root)), "an item does not match", "items")
    for key, deps in schema.get("dependencies", {}).items():
        has = F.try_variant_get(x, V.json_path([key]), "variant").isNotNull()
        if isinstance(deps, list):
            for d in deps:
                rule(has & F.try_variant_get(x, V.json_path([d]), "variant").isNull(), f"{key} needs {d}", "dependencies")
        else:
            rule(has & ~valid(deps, x, root), f"{key} needs more", "dependencies")
    for key, need in (("allOf", lambda n, all_: n == all_), ("anyOf", lambda n, _: n >= 1), ("oneOf", lambda n, _: n == 1)):
        if key in schema:
            fits = sum((valid(s, x, root).cast("int") for s in schema[key]), F.lit(0))
            rule(~need(fits, len(schema[key])), f"{key} does not hold", key)
    if "not" in schema:
        rule(valid(schema["not"], x, root), "matches what it must not", "not")
    if "if" in schema:
        then, other = valid(schema.get("then", True), x, root), valid(schema.get("else", True), x, root)
        rule(~F.when(valid(schema["if"], x, root), then).otherwise(other), "if/then/else does not hold", "if")
    return out


def valid(schema, x: Column, root=None) -> Column:
    bad = F.lit(False)
    for violated, _ in checks(schema, V.Value.of(x), root=schema if root is None else root):
        bad = bad | violated
    return ~bad


def _members(schema, root) -> dict:
    """The members of an object that schema mentions by name, with their schemas."""
    schema = _resolve(schema, root)
    if not isinstance(schema, dict):
        return {}
    return {n: True for n in schema.get("required", ())} | dict(schema.get("properties", {}))


def _with_members(df: DataFrame, schema, top: str) -> tuple[DataFrame, V.Value]:
    """df with columns for the payload's VARIANT in column `top` and all members that schema mentions, level by level, and
    the payload's Value over these columns."""
    df, made = V.with_values(df, {f"{top}_0": F.col(top)})
    whole = made[f"{top}_0"]
    level, n = [(whole, schema)], 1
    while level:
        inner = [(v, name, sub) for v, own in level for name, sub in _members(own, schema).items()]
        if not inner:
            break
        names = [f"{top}_{n + k}" for k in range(len(inner))]
        df, made = V.with_values(df, {c: F.try_variant_get(v.x, V.json_path([name]), "variant") for c, (v, name, _) in zip(names, inner)})
        for c, (v, name, _) in zip(names, inner):
            v.members[name] = made[c]
        level, n = [(made[c], sub) for c, (_, _, sub) in zip(names, inner)], n + len(inner)
    return df, whole


def validate(records: DataFrame, schema: dict | str, payload: str = "payload") -> DataFrame:
    """records with `errors` added: array<struct<path, message, schema_path>>, empty where the payload is valid. A payload
    is parsed once, and each member that the schema mentions is read once."""
    schema = json.loads(schema) if isinstance(schema, str) else schema
    df = V.with_parsed(spread(records), payload, "_value")
    df, value = _with_members(df, schema, "_value")
    broken = F.when(F.col("_value").isNull(), _error("$", "invalid JSON", "#"))
    found = F.array(broken, *[F.when(bad, e) for bad, e in checks(schema, value)]).cast(f"array<{ERROR}>")
    df = df.select(*records.columns, F.array_compact(found).alias("errors"))
    return V.counted(df, "validation", invalid=F.count_if(F.size("errors") > 0))


def backward_problems(old: dict, new: dict) -> list[str]:
    """What keeps readers of new from reading what was written under old."""
    had, has = set(old.get("required", ())), set(new.get("required", ()))
    return [f"required field {f} is gone" for f in sorted(had - set(new.get("properties", {})))] + [f"field {f} is newly required" for f in sorted(has - had)]


def compatibility_problems(old: dict, new: dict, mode: str) -> list[str]:
    mode = mode.lower()
    if mode == "none":
        return []
    if mode not in ("backward", "forward", "full"):
        raise ValidationError(f"unknown compatibility mode {mode!r}")
    out = backward_problems(old, new) if mode in ("backward", "full") else []
    return out + (backward_problems(new, old) if mode in ("forward", "full") else [])


@dataclass(frozen=True)
class Version:
    namespace: str
    name: str
    version: int
    text: str
    fingerprint: str
    status: str = "active"

    @property
    def id(self) -> str:
        return f"{self.namespace}.{self.name}.v{self.version}"


@dataclass
class Registry:
    """Schema versions by namespace and name. A text that is known is not stored again."""

    versions: dict[tuple[str, str], list[Version]] = field(default_factory=dict)

    def register(self, name: str, text: str, namespace: str = "default", compatibility: str = "backward") -> Version:
        try:
            schema = json.loads(text)
        except ValueError as e:
            raise ValidationError(f"not JSON: {e}") from None
        checks(schema, V.Value.of(F.try_parse_json(F.lit("{}"))))
        known = self.versions.setdefault((namespace or "default", name), [])
        print_ = "sha256:" + hashlib.sha256(text.encode()).hexdigest()
        for v in known:
            if v.fingerprint == print_:
                return v
        latest = next((v for v in reversed(known) if v.status == "active"), None)
        if latest and (problems := compatibility_problems(json.loads(latest.text), schema, compatibility)):
            raise Conflict("; ".join(problems))
        known.append(Version(namespace or "default", name, max([0, *(v.version for v in known)]) + 1, text, print_))
        return known[-1]

    def get(self, name: str, version: int | None = None, namespace: str = "default") -> Version:
        for v in reversed(self.versions.get((namespace or "default", name), [])):
            if v.version == version or version is None and v.status == "active":
                return v
        raise NotFound(f"schema {namespace}.{name} version {version or 'latest'}")

    def list(self) -> list[Version]:
        return [v for known in self.versions.values() for v in known]


def latest_versions(versions: DataFrame) -> DataFrame:
    """versions (schema, version, status, ...): the active row with the largest version of each schema."""
    row = F.struct(*versions.columns)
    return versions.where("status = 'active'").groupBy("schema").agg(F.max_by(row, "version").alias("r")).select("r.*")
