"""Control plane: stream life cycle, access rules, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import InvalidState

#: States a stream may go to.
TRANSITIONS = {"creating": ("active",), "active": ("paused", "deleting"), "paused": ("active", "deleting"), "deleting": ("deleted",), "deleted": ()}
#: Roles by rank.
ROLES = {"admin": 100, "operator": 80, "schema_admin": 60, "writer": 40, "reader": 20}
#: The least rank that may take an action on a kind of thing; None is for admins alone. Kinds that are not
#: named here, such as pipelines, are open to every role but for the action admin.
NEEDED = {
    ("write", "stream"): "writer", ("write", "schema"): "writer", ("write", "config"): None, ("write", "api_key"): None,
    ("read", "stream"): "reader", ("read", "schema"): "reader", ("read", "config"): "operator",
}
PERMISSIONS = "array<struct<resource_type:string,resource_id:string,actions:array<string>>>"


def move(state: str, to: str) -> str:
    if to not in TRANSITIONS.get(state, ()):
        raise InvalidState(f"a stream cannot go from {state} to {to}")
    return to


def may_move(state: Column, to: Column) -> Column:
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]).cast("array<string>"))])
    return F.coalesce(F.array_contains(allowed[state], to), F.lit(False))


def rank(role: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[role], F.lit(0))


def outranks(role: Column, other: Column) -> Column:
    return rank(role) >= rank(other)


def granted(permissions: Column, kind: Column, name: Column, action: Column) -> Column:
    """Whether a list of PERMISSIONS has the action, or `admin`, for the thing or for `*`; a null list has nothing."""
    fits = lambda p: (p["resource_type"] == kind) & ((p["resource_id"] == "*") | (p["resource_id"] == name)) & (F.array_contains(p["actions"], action) | F.array_contains(p["actions"], "admin"))
    return F.coalesce(F.exists(permissions, fits), F.lit(False))


def may(role: Column, kind: Column, name: Column, action: Column, permissions: Column) -> Column:
    """Whether a principal may take an action (read, write, admin) on a thing: its kind (stream, schema, pipeline, config,
    api_key) and name, or an empty name for all of the kind. Admins may do anything, nobody else the action admin. Others
    need the rank of NEEDED and, on a stream with a name, a permission. Without a role nobody may do anything."""
    need = F.lit(0)
    for (what, where), least in NEEDED.items():
        need = F.when((action == what) & (kind == where), ROLES[least] if least else 1_000).otherwise(need)
    single = (kind == "stream") & (F.coalesce(name, F.lit("")) != "")
    others = (action != "admin") & (rank(role) >= need) & (~single | granted(permissions, kind, name, action))
    return F.coalesce(F.when(role == "admin", True).when(role.isNotNull(), others), F.lit(False))


def visible(rows: DataFrame, permissions: DataFrame, stream: str = "_stream_id") -> DataFrame:
    """Rows of streams that permissions (stream_id, action) let be read, by `read` or `admin`; `*` stands for all."""
    read = permissions.where("action in ('read', 'admin')").select("stream_id").distinct()
    if read.where("stream_id = '*'").limit(1).count():
        return rows
    return rows.join(read.withColumnRenamed("stream_id", stream), stream, "left_semi")


AUDIT = "at timestamp_ntz, actor string, action string, resource_type string, resource_id string, detail string"


def audit(events: DataFrame, path: str) -> None:
    """Appends events (columns of AUDIT; others are left out) to the audit table, a folder for each day. Nothing is ever
    changed or removed there."""
    names = [f.split()[0] for f in AUDIT.split(", ")]
    events.select(*names, F.to_date("at").alias("day")).write.mode("append").partitionBy("day").parquet(path)


def audited(table: DataFrame, limit: int = 100, **equal: str | None) -> DataFrame:
    """The latest audit events that fit, newest first."""
    for column, value in equal.items():
        if value:
            table = table.where(F.col(column) == value)
    return table.orderBy(F.desc("at"), "actor", "action", "resource_id").limit(limit)


def listed(table: DataFrame, order: Column, limit: int = 100, **equal: str | None) -> DataFrame:
    """Catalog rows in order; an empty filter lets all through, but for rows whose status is `deleted`: they are listed
    only when asked for."""
    if "status" in table.columns and not equal.get("status"):
        table = table.where("status is distinct from 'deleted'")
    for column, value in equal.items():
        if value:
            table = table.where(F.col(column) == value)
    return table.orderBy(order).limit(limit)
