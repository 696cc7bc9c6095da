"""JSON payloads as VARIANT columns: paths, objects, coercion. All functions are total: bad input gives null."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_path(path: str) -> list[str]:
    parts = path.split(".")
    if not path or any(not p for p in parts):
        raise ValueError(f"empty segment in field path {path!r}")
    return parts


def json_path(parts: list[str]) -> str:
    return "$" + "".join('["' + p.replace("\\", "\\\\").replace('"', '\\"') + '"]' for p in parts)


#: A text behind the payload, by which a payload is told from one that ends the array around it.
_END = "end of payload"


def _around(payload: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), payload, F.lit(f',"{_END}"]')))


def _first(around: Column) -> Column:
    # the parser stops at the end of the first value; a second value or other text after it makes the payload invalid
    ends = (F.try_variant_get(around, "$[1]", "string") == _END) & F.try_variant_get(around, "$[2]", "variant").isNull()
    return F.when(ends, F.try_variant_get(around, "$[0]", "variant"))


def parse(payload: Column) -> Column:
    """The payload as VARIANT; null unless it is one JSON value."""
    return _first(_around(payload))


def with_parsed(df: DataFrame, payload: str, name: str) -> DataFrame:
    """df with the parsed payload as column name; each payload is parsed once."""
    around = f"{name}_around"
    return df.withColumn(around, _around(F.col(payload))).withColumn(name, _first(F.col(around))).drop(around)


def counted(df: DataFrame, what: str, **counts: Column) -> DataFrame:
    """df, with counts for listeners of the query's metrics. Filters that follow are not moved below this: above steps that
    build on each other's columns, a filter would be written out in terms of the first, with all steps in it many times."""
    return df.observe(f"{what}-{uuid.uuid4().hex}", F.count("*").alias("records"), *[c.alias(n) for n, c in counts.items()])


def members(v: Column) -> Column:
    """The members of an object; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, json_path(split_path(path)), kind)


def missing(x: Column) -> Column:
    """Missing or JSON null."""
    return x.isNull() | F.is_variant_null(x)


def json_null() -> Column:
    return F.parse_json(F.lit("null"))


def object_of(entries: list[tuple[str, Column, Column | None]]) -> Column:
    """An object of (name, VARIANT, condition or None); members whose condition fails are left out."""
    items = [F.when(F.lit(True) if c is None else c, F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v, c in entries]
    return F.to_variant_object(F.map_from_entries(F.filter(F.array(*items), lambda x: x.isNotNull())))


def with_path(v: Column, parts: list[str], value: Column) -> Column:
    """v with value at the path; parents that are not objects become objects."""
    own = F.coalesce(members(v), F.from_json(F.lit("{}"), "map<string,string>").cast("map<string,variant>"))
    inner = value if len(parts) == 1 else with_path(get(v, parts[0]), parts[1:], value)
    rest = F.map_filter(own, lambda k, _: k != parts[0])
    return F.to_variant_object(F.map_concat(rest, F.create_map(F.lit(parts[0]), inner)))


def without_path(v: Column, parts: list[str]) -> Column:
    """v without what is at the path; unchanged where a parent is missing or no object."""
    own = members(v)
    rest = F.map_filter(own, lambda k, _: k != parts[0])
    if len(parts) == 1:
        return F.when(own.isNull(), v).otherwise(F.to_variant_object(rest))
    inner = get(v, parts[0])
    changed = F.to_variant_object(F.map_concat(rest, F.create_map(F.lit(parts[0]), without_path(inner, parts[1:]))))
    return F.when(own.isNull() | members(inner).isNull(), v).otherwise(changed)


def _kind(schema: Column) -> Column:
    return (
        F.when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean").when(schema == "VOID", "null")
        .when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(schema.isNotNull(), "number")
    )


def text_of(x: Column) -> Column:
    return F.try_variant_get(x, "$", "string")


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _digits(text: Column, kind: Column) -> Column:
    return F.when((kind == "number") | ((kind == "string") & text.rlike(_NUMBER)), text)


def _real(digits: Column) -> Column:
    n = digits.try_cast("double")
    return F.when(F.abs(n) < float("inf"), n)


@dataclass(frozen=True)
class Value:
    """A VARIANT x with what is read from it: text, kind (string, number, boolean, object, array or null), and for numbers
    and texts of numbers digits (the text) and real (a finite double)."""

    x: Column
    text: Column
    kind: Column
    digits: Column
    real: Column
    members: dict[str, Value] = field(default_factory=dict)

    @staticmethod
    def of(x: Column) -> Value:
        """As expressions over x, for use inside lambdas."""
        text, kind = text_of(x), _kind(F.schema_of_variant(x))
        digits = _digits(text, kind)
        return Value(x, text, kind, digits, _real(digits))

    def member(self, name: str) -> Value:
        return self.members.get(name) or Value.of(F.try_variant_get(self.x, json_path([name]), "variant"))


def with_values(df: DataFrame, values: dict[str, Column], numbers: bool = True) -> tuple[DataFrame, dict[str, Value]]:
    """df with columns for each of values (name: VARIANT), and these columns as Values. What is read from a VARIANT is read
    once, in generated code, however often expressions mention it."""
    df = df.withColumns({n: x for n, x in values.items()})
    df = df.withColumns({f"{n}_text": text_of(F.col(n)) for n in values} | {f"{n}_schema": F.schema_of_variant(F.col(n)) for n in values})
    df = df.withColumns({f"{n}_kind": _kind(F.col(f"{n}_schema")) for n in values})
    if numbers:
        df = df.withColumns({f"{n}_digits": _digits(F.col(f"{n}_text"), F.col(f"{n}_kind")) for n in values})
        df = df.withColumns({f"{n}_real": _real(F.col(f"{n}_digits")) for n in values})
    made = {}
    for n in values:
        text, kind = F.col(f"{n}_text"), F.col(f"{n}_kind")
        digits = F.col(f"{n}_digits") if numbers else _digits(text, kind)
        made[n] = Value(F.col(n), text, kind, digits, F.col(f"{n}_real") if numbers else _real(digits))
    return df, made


def to_string(v: Value) -> Column:
    return v.text


def to_float64(v: Value) -> Column:
    return F.when(v.kind == "boolean", F.when(v.text == "true", 1.0).otherwise(0.0)).otherwise(v.real)


def to_int64(v: Value) -> Column:
    """Whole numbers exactly, others cut towards zero; out of range is null."""
    whole = F.when(~v.digits.contains(".") & ~F.lower(v.digits).contains("e"), v.digits.try_cast("bigint"))
    cut = F.when((v.real >= -(2.0**63)) & (v.real < 2.0**63), v.real.cast("bigint"))
    return F.when(v.kind == "boolean", (v.text == "true").cast("bigint")).otherwise(F.coalesce(whole, cut))


def to_bool(v: Value) -> Column:
    low = F.lower(v.text)
    return (
        F.when(v.kind == "boolean", v.text == "true")
        .when((v.kind == "string") & low.isin("true", "1"), True).when((v.kind == "string") & low.isin("false", "0"), False)
        .when((v.kind == "number") & (v.text == "1"), True).when((v.kind == "number") & (v.text == "0"), False)
    )


COERCIONS: dict[str, Callable[[Value], Column]] = {"string": to_string, "int64": to_int64, "float64": to_float64, "bool": to_bool}
