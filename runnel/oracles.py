"""DuckDB SQL with the results that the named queries are to have."""

from __future__ import annotations

from .functions.names import SAMPLES


_R = "WITH r AS (SELECT event_id + 1 AS _sequence, 'rec_' || event_id AS _record_id, ts AS _ingested_at, * FROM events) "
_SHOW = "SELECT _record_id AS record_id, _sequence AS sequence_number, epoch_us(_ingested_at) AS timestamp_unix_micros, user_id, event_type FROM "
_K = "CAST(props->>'$.k' AS BIGINT)"


def _by_form(values: list, kind: str, messages: list, name: str) -> str:
    rows = ", ".join(f"({k}, {v}, {m})" for k, (v, m) in enumerate(zip(values, messages)))
    return f"SELECT event_id + 1 AS _sequence, CAST(f.x AS {kind}) AS x, CAST(f.m AS VARCHAR) AS message FROM events JOIN (VALUES {rows}) f(k, x, m) ON (event_id + 1) % {len(values)} = f.k"


def _coerced(target: str, kind: str, values: list, instead: str | None = None) -> str:
    """values: SQL of each form's result, '!' where it fails."""
    bad = f"'coerce field x to {target}'"
    return _by_form([(instead or "NULL") if v == "!" else v for v in values], kind, [bad if v == "!" and instead is None else "NULL" for v in values], target)


_INT = ["12", "12", "-2", "1000", "1", "NULL", "!", "1", "!", "!", "!", "0", "!", "!", "2", "!"]
_FLOAT = ["12", "12.7", "-2.7", "1000", "1", "NULL", "!", "1", "!", "9223372036854775808", "!", "0", "!", "!", "2", "!"]
_BOOL = ["!", "!", "!", "!", "true", "NULL", "!", "true", "!", "!", "false", "false", "!", "!", "!", "!"]
_TEXT = ["'12'", "'12.7'", "'-2.7'", "'1e3'", "'true'", "NULL", "'yes'", "'1'", "'NaN'", "'9223372036854775808'", "'FALSE'", "'0'", "'[1]'", "'{\"a\":1}'", "'2'", "'abc'"]
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'"
_BAD = "CASE WHEN _sequence % 7 = 0 THEN 'projection' WHEN _sequence % 7 = 1 THEN 'projection' END"
_HOURS = (
    "SELECT year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour, count(*) AS record_count, sum(strlen(props))::BIGINT AS total_bytes, "
    "min(event_id) + 1 AS min_sequence, max(event_id) + 1 AS max_sequence, min(ts) AS min_timestamp, max(ts) AS max_timestamp FROM events GROUP BY 1, 2, 3, 4"
)
_BOUNDS = "(VALUES (1.0::DOUBLE), (5.0), (10.0), (25.0), (50.0), (75.0), (100.0), (200.0), ('inf'::DOUBLE)) b(le)"
_HIST = f"SELECT event_type, le, count(*) FILTER (value <= le) AS bucket_count FROM events, {_BOUNDS} WHERE value IS NOT NULL GROUP BY 1, 2"
_SILENT = (
    "w AS (SELECT TIMESTAMP '2024-01-02' + INTERVAL (5 * i) MINUTE AS bucket FROM range(576) t(i)), "
    "silent AS (SELECT bucket FROM w WHERE NOT EXISTS (SELECT 1 FROM events WHERE ts >= bucket AND ts < bucket + INTERVAL 5 MINUTE)) "
)
_STATES = {"creating": ["active"], "active": ["paused", "deleting"], "paused": ["active", "deleting"], "deleting": ["deleted"], "deleted": []}
#: Who may do what, in words of SQL: columns role, action, kind, name, and grants for permissions.
_MAY = """CASE WHEN role IS NULL THEN false WHEN role = 'admin' THEN true WHEN action = 'admin' THEN false
      WHEN action = 'write' AND kind IN ('config', 'api_key') THEN false
      WHEN action = 'write' AND kind IN ('stream', 'schema') AND role NOT IN ('operator', 'schema_admin', 'writer') THEN false
      WHEN action = 'read' AND kind IN ('stream', 'schema') AND role NOT IN ('operator', 'schema_admin', 'writer', 'reader') THEN false
      WHEN action = 'read' AND kind = 'config' AND role <> 'operator' THEN false
      WHEN kind = 'stream' AND name <> '' THEN grants ELSE true END"""


def _values(rows: list[tuple]) -> str:
    show = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + ")"


ORACLE_SQL: dict[str, str] = {
    "time_range": _R + _SHOW + "r WHERE ts BETWEEN TIMESTAMP '2024-01-05 03:00:00' AND TIMESTAMP '2024-01-05 06:30:00' ORDER BY ts, _sequence LIMIT 25",
    "time_range_inclusive_bounds": _R + _SHOW + "r WHERE ts BETWEEN (SELECT min(ts) FROM r WHERE _sequence IN (101, 140)) AND (SELECT max(ts) FROM r WHERE _sequence IN (101, 140)) ORDER BY ts LIMIT 1000",
    "time_range_page2": _R + _SHOW + "(SELECT * FROM r WHERE ts BETWEEN TIMESTAMP '2024-01-05 03:00:00' AND TIMESTAMP '2024-01-11 03:00:00' ORDER BY ts, _sequence LIMIT 20 OFFSET 20)",
    "time_range_cursors": _R + "SELECT _sequence, translate(to_base64(encode('{\"seq\":' || _sequence || '}')), '+/', '-_') AS cursor FROM r WHERE ts BETWEEN TIMESTAMP '2024-01-05 03:00:00' AND TIMESTAMP '2024-01-05 06:30:00'",
    "partition_prune_hours": _R + "SELECT _sequence, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour, 'streams/events/partitions/' || strftime(ts, 'year=%Y/month=%m/day=%d/hour=%H') AS path FROM r WHERE ts BETWEEN TIMESTAMP '2024-01-05 03:00:00' AND TIMESTAMP '2024-01-07 03:00:00'",
    "lookup_record_id": _R + _SHOW + "r WHERE _record_id = 'rec_150' AND ts BETWEEN TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 30 DAY AND TIMESTAMP '2024-01-20 12:00:00' ORDER BY ts DESC LIMIT 1",
    "lookup_payload_field": _R + _SHOW + "r WHERE event_type = 'error' AND ts BETWEEN TIMESTAMP '2024-01-19 12:00:00' AND TIMESTAMP '2024-01-20 12:00:00' ORDER BY ts DESC, _sequence DESC LIMIT 1",
    "lookup_latest_per_key": _R + "SELECT user_id AS user, _record_id, _sequence, _ingested_at FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, _sequence DESC) = 1",
    "replay_from_sequence": _R + "SELECT _sequence, _ingested_at, true AS is_historical FROM r WHERE _sequence >= 900",
    "replay_from_time": _R + "SELECT _sequence, _ingested_at, true AS is_historical FROM r WHERE ts >= TIMESTAMP '2024-01-20 12:00:00'",
    "project_include": _R + f"SELECT _sequence, user_id, {_K} AS k, 'props,user_id' AS keys FROM r",
    "project_include_missing_null": _R + "SELECT _sequence, true AS explicit_null, event_type FROM r",
    "project_wildcard": _R + f"SELECT _sequence, {_K} AS k, 1::INT AS n_keys FROM r",
    "project_exclude": _R + "SELECT _sequence, 'event_type,props,user_id' AS keys, 0::INT AS n_props FROM r",
    "coerce_int": _coerced("int64", "BIGINT", _INT),
    "coerce_errors_to_dlq": _R
    + """SELECT _sequence, '{"x":' || f.form || '}' AS payload, 'coercion' AS stage, 'coerce field x to int64' AS message FROM r
      JOIN (VALUES (6, '"yes"'), (8, '"NaN"'), (9, '9223372036854775808'), (10, '"FALSE"'), (12, '[1]'), (13, '{"a":1}'), (15, '"abc"')) f(k, form) ON _sequence % 16 = f.k""",
    "coerce_float": _coerced("float64", "DOUBLE", _FLOAT),
    "coerce_bool": _coerced("bool", "BOOLEAN", _BOOL),
    "coerce_string": _coerced("string", "VARCHAR", _TEXT),
    "coerce_on_error_null": _coerced("int64", "BIGINT", _INT, "NULL"),
    "coerce_on_error_default": _coerced("int64", "BIGINT", _INT, "-1"),
    "ts_norm_seconds": "SELECT event_id + 1 AS _sequence, " + _ISO.format("date_trunc('second', ts)") + " AS t, NULL::VARCHAR AS message FROM events",
    "ts_norm_millis": "SELECT event_id + 1 AS _sequence, " + _ISO.format("date_trunc('millisecond', ts)") + " AS t, NULL::VARCHAR AS message FROM events",
    "ts_norm_micros": "SELECT event_id + 1 AS _sequence, " + _ISO.format("ts") + " AS t, NULL::VARCHAR AS message FROM events",
    "ts_norm_iso": "SELECT event_id + 1 AS _sequence, " + _ISO.format("date_trunc('second', ts) - INTERVAL (CASE WHEN (event_id + 1) % 3 = 0 THEN 2 ELSE 0 END) HOUR") + " AS t, NULL::VARCHAR AS message FROM events",
    "ts_norm_default_order": "SELECT event_id + 1 AS _sequence, CASE (event_id + 1) % 4 WHEN 0 THEN NULL WHEN 1 THEN " + _ISO.format("ts") + " WHEN 2 THEN " + _ISO.format("date_trunc('second', ts)") + " ELSE '2024-03-01T10:00:00.500000Z' END AS t, CASE WHEN (event_id + 1) % 4 = 0 THEN 'normalise field t' END AS message FROM events",
    "pipeline_good": _R + "SELECT _sequence, user_id::VARCHAR AS user_id, trunc(value)::BIGINT AS value FROM r WHERE _sequence % 7 > 1",
    "pipeline_dlq": _R + f"SELECT _sequence, {_BAD} AS stage, CASE WHEN _sequence % 7 = 0 THEN 'payload is not valid JSON' ELSE 'payload is not an object' END AS message, 'events' AS source_stream, ts AS original_ts, 0::INT AS retry_count FROM r WHERE _sequence % 7 <= 1",
    "pipeline_counts": _R + "SELECT CASE WHEN _sequence % 7 <= 1 THEN 'projection' ELSE 'none' END AS stage, count(*) AS n FROM r GROUP BY 1",
    "validate_ok": _R + f"SELECT _sequence FROM r WHERE user_id >= 20 AND event_type <> 'error' AND length(event_type) <= 7 AND value <= 150 AND {_K} <= 90",
    "validate_errors_by_path": _R
    + f"""SELECT path, schema_path, count(*) AS n FROM (
      SELECT '$.user_id' AS path, '#/properties/user_id/minimum' AS schema_path FROM r WHERE user_id < 20
      UNION ALL SELECT '$.event_type', '#/properties/event_type/enum' FROM r WHERE event_type = 'error'
      UNION ALL SELECT '$.event_type', '#/properties/event_type/maxLength' FROM r WHERE length(event_type) > 7
      UNION ALL SELECT '$.value', '#/properties/value/maximum' FROM r WHERE value > 150
      UNION ALL SELECT '$.props.k', '#/properties/props/properties/k/maximum' FROM r WHERE {_K} > 90) GROUP BY 1, 2""",
    "schema_fingerprint": _R + "SELECT _sequence, 'sha256:' || sha256(_record_id) AS fingerprint FROM r",
    "schema_latest_version": "SELECT user_id AS schema, max(event_id) AS version, 'active' AS status FROM events WHERE event_type <> 'error' GROUP BY 1",
    "dedup_24h": """WITH RECURSIVE n AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
      walk AS (SELECT event_id, user_id, event_type, i, ts AS last, true AS fresh FROM n WHERE i = 1
        UNION ALL SELECT n.event_id, n.user_id, n.event_type, n.i, CASE WHEN n.ts - w.last >= INTERVAL 24 HOUR THEN n.ts ELSE w.last END, n.ts - w.last >= INTERVAL 24 HOUR
        FROM walk w JOIN n ON n.user_id = w.user_id AND n.event_type = w.event_type AND n.i = w.i + 1)
      SELECT event_id AS _sequence, user_id, event_type FROM walk WHERE fresh""",
    "assign_sequence": "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS sequence FROM events",
    "rate_limit_fixed_window": "SELECT event_id, n <= 2 AS allowed, greatest(2 - n, 0)::INT AS remaining FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id)::INT AS n FROM events)",
    "backpressure_levels": "SELECT event_id, CASE WHEN u < 0.7 THEN 'healthy' WHEN u < 0.9 THEN 'warning' WHEN u < 1 THEN 'critical' ELSE 'overload' END AS level FROM (SELECT event_id, greatest((event_id % 1000)::DOUBLE / 900, (event_id % 500)::DOUBLE / 600) AS u FROM events)",
    "message_checks": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'stream_id is required' WHEN doc_id % 3 = 0 THEN 'schema_id is required' WHEN text IS NULL OR text = '' THEN 'payload is required' WHEN strlen(text) > 4000 THEN 'payload is larger than 4000 bytes' END AS problem FROM documents",
    "daily_stats": "SELECT ts::DATE AS date, count(*) AS records_ingested, sum(strlen(props))::BIGINT AS bytes_ingested FROM events GROUP BY 1",
    "partition_manifest": _HOURS,
    "compaction_candidates": f"SELECT year, month, day, count(*) AS files, sum(total_bytes)::BIGINT AS bytes FROM ({_HOURS}) GROUP BY 1, 2, 3 HAVING count(*) >= 24",
    "retention_time": f"SELECT year, month, day, hour, record_count FROM ({_HOURS}) WHERE make_timestamp(year, month, day, hour, 0, 0) < TIMESTAMP '2024-01-10 12:00:00'",
    "retention_size": f"""SELECT year, month, day, hour, record_count FROM (SELECT *, sum(total_bytes) OVER w AS bytes, coalesce(sum(record_count) OVER (ORDER BY year DESC, month DESC, day DESC, hour DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS newer
      FROM ({_HOURS}) WINDOW w AS (ORDER BY year DESC, month DESC, day DESC, hour DESC)) WHERE bytes > 20000 AND newer >= 1000""",
    "orphans": "SELECT 'f' || o_orderkey AS path FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)",
    "upsert_additive": "SELECT user_id, count(*) AS n, sum(event_id)::BIGINT AS s FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1",
    "upsert_replace": "WITH c AS (SELECT user_id, event_type, max(event_id) AS last_event FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2) SELECT user_id, last_event FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type DESC) = 1",
    "metric_counters": "SELECT event_type, user_id, count(*) AS total FROM events GROUP BY 1, 2",
    "histogram_value": f"SELECT event_type, CASE WHEN isinf(le) THEN -1.0 ELSE le END::DOUBLE AS le, bucket_count FROM ({_HIST})",
    "histogram_quantile": f"""WITH h AS ({_HIST}), o AS (SELECT *, coalesce(lag(le) OVER w, 0.0) AS low, coalesce(lag(bucket_count) OVER w, 0) AS below, 0.9::DOUBLE * max(bucket_count) OVER (PARTITION BY event_type) AS rank FROM h WINDOW w AS (PARTITION BY event_type ORDER BY le))
      SELECT event_type, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (rank - below) / (bucket_count - below) END, 6) AS p90 FROM o WHERE bucket_count >= rank AND below < rank""",
    "alert_error_ratio": "SELECT date_trunc('hour', ts) AS bucket, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'error')::DOUBLE / count(*) > 0.3 AS firing FROM events GROUP BY 1",
    "alert_no_traffic": "WITH " + _SILENT + "SELECT bucket FROM silent",
    "alert_rate_threshold": "SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM events GROUP BY 1 HAVING count(*) / 3600.0::DOUBLE > 16.0::DOUBLE / 3600",
    "alert_hold_for": "WITH " + _SILENT + ", i AS (SELECT bucket, epoch(bucket)::BIGINT // 300 - row_number() OVER (ORDER BY bucket) AS island FROM silent) SELECT min(bucket) AS since, max(bucket) AS until, count(*) AS windows FROM i GROUP BY island HAVING count(*) >= 2",
    "latest_gauge": "SELECT user_id, arg_max(value, ts) AS value FROM events GROUP BY 1",
    "health_rollup": "SELECT CASE WHEN bool_or(s_suppkey % 7 = 0) THEN 'degraded' ELSE 'healthy' END AS status FROM supplier",
    "batch_jsonl_import": """WITH v AS (SELECT conv_id AS job, count(*) AS processed, count(*) FILTER (length(text) % 97 = 0) AS n_bad, min(turn + 1) FILTER (length(text) % 97 = 0) AS error_line FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1)
      SELECT job, processed, CASE WHEN n_bad = 0 THEN processed ELSE 0 END AS succeeded, CASE WHEN n_bad = 0 THEN 0 ELSE processed END AS failed, CASE WHEN n_bad = 0 THEN 'COMPLETED' ELSE 'FAILED' END AS status,
        error_line, CASE WHEN n_bad = 0 THEN processed ELSE 0 END AS let_through FROM v""",
    "batch_jsonl_import_daily": """WITH l AS (SELECT ts::DATE AS job, event_id + 1 AS n, day(ts) % 2 = 1 AND (event_id + 1) % 77 = 0 AS bad FROM events),
      v AS (SELECT job, count(*) AS processed, count(*) FILTER (bad) AS n_bad, min(n) FILTER (bad) AS error_line FROM l GROUP BY 1)
      SELECT job, processed, CASE WHEN n_bad = 0 THEN processed ELSE 0 END AS succeeded, CASE WHEN n_bad = 0 THEN 0 ELSE processed END AS failed, CASE WHEN n_bad = 0 THEN 'COMPLETED' ELSE 'FAILED' END AS status,
        error_line, CASE WHEN n_bad = 0 THEN processed ELSE 0 END AS let_through FROM v""",
    "lifecycle_transitions": "SELECT * FROM " + _values([(a, b, b in _STATES[a]) for a in _STATES for b in _STATES]) + " t(state, next, allowed)",
    "rbac_matrix": f"""SELECT role, action, kind, {_MAY} AS allowed FROM (SELECT unnest(['admin', 'operator', 'schema_admin', 'writer', 'reader', 'guest']) AS role),
      (SELECT unnest(['read', 'write', 'admin']) AS action), (SELECT unnest(['stream', 'schema', 'pipeline', 'config', 'api_key']) AS kind), (SELECT '' AS name, false AS grants)""",
    "rbac_requests": f"""WITH q AS (SELECT event_id, user_id, ['admin', 'operator', 'schema_admin', 'writer', 'reader', 'guest'][user_id % 6 + 1] AS role, ['read', 'write', 'admin'][(event_id // 4) % 3 + 1] AS action,
        ['stream', 'schema', 'pipeline', 'config', 'api_key'][(event_id // 12) % 5 + 1] AS kind, CASE WHEN event_id % 3 = 0 THEN '' ELSE 's' || event_id % 4 END AS name FROM events),
      g AS (SELECT *, user_id % 7 <> 0 AND (user_id % 3 = 0 OR name = 's' || user_id % 4) AND (user_id % 5 = 0 OR action = 'read') AS grants FROM q)
      SELECT event_id, {_MAY} AS allowed FROM g""",
    "dedup_streams": """WITH RECURSIVE s AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq FROM events),
      n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, seq) AS i FROM s),
      walk AS (SELECT event_id, user_id, event_type, i, seq, ts AS last, false AS repeat, seq AS original FROM n WHERE i = 1
        UNION ALL SELECT n.event_id, n.user_id, n.event_type, n.i, n.seq, CASE WHEN n.ts - w.last >= INTERVAL 24 HOUR THEN n.ts ELSE w.last END, n.ts - w.last < INTERVAL 24 HOUR, CASE WHEN n.ts - w.last >= INTERVAL 24 HOUR THEN n.seq ELSE w.original END
        FROM walk w JOIN n ON n.user_id = w.user_id AND n.event_type = w.event_type AND n.i = w.i + 1)
      SELECT event_id, event_type, seq AS _sequence, repeat, original FROM walk""",
    "ingest_admit": """WITH RECURSIVE q AS (SELECT event_id, event_id % 3 AS s, CASE WHEN event_id % 2 = 0 THEN user_id END AS k, ts,
        CASE WHEN event_id % 13 = 0 THEN 'schema_id is required' WHEN event_id % 11 = 0 THEN '$: invalid JSON' WHEN user_id IS NULL THEN '$: user_id is required' WHEN value > 150 THEN '$.value: maximum 150' END AS wrong FROM events),
      n AS (SELECT *, row_number() OVER (PARTITION BY s, k ORDER BY ts, event_id) AS i FROM q WHERE wrong IS NULL AND k IS NOT NULL),
      walk AS (SELECT event_id, s, k, i, ts AS last, false AS repeat, event_id AS original FROM n WHERE i = 1
        UNION ALL SELECT n.event_id, n.s, n.k, n.i, CASE WHEN n.ts - w.last >= INTERVAL 24 HOUR THEN n.ts ELSE w.last END, n.ts - w.last < INTERVAL 24 HOUR, CASE WHEN n.ts - w.last >= INTERVAL 24 HOUR THEN n.event_id ELSE w.original END
        FROM walk w JOIN n ON n.s = w.s AND n.k = w.k AND n.i = w.i + 1),
      told AS (SELECT q.event_id, q.s, q.ts, coalesce(repeat, false) AS repeat, coalesce(original, q.event_id) AS original FROM q LEFT JOIN walk USING (event_id) WHERE wrong IS NULL),
      fresh AS (SELECT event_id, ts, row_number() OVER (PARTITION BY s ORDER BY ts, event_id) AS seq FROM told WHERE NOT repeat)
      SELECT t.event_id, 'OK' AS status, NULL::VARCHAR AS error_message, t.repeat, f.seq AS sequence_number, epoch_us(f.ts) AS timestamp_unix_micros FROM told t JOIN fresh f ON f.event_id = t.original
      UNION ALL SELECT event_id, 'VALIDATION_ERROR', wrong, false, NULL, NULL FROM q WHERE wrong IS NOT NULL""",
    "rate_limit_categories": """SELECT event_id, CASE WHEN b IS NULL THEN 0 ELSE 1 END::INT AS call_limit, b IS NULL OR n <= b AS allowed, CASE WHEN b IS NULL THEN 0 ELSE greatest(b - n, 0) END::INT AS remaining
      FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 2 WHEN 'error' THEN 1 END AS b, row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts, event_id) AS n FROM events)""",
    "payload_crc32": "SELECT props, count(*) AS n, CASE WHEN props IS NULL THEN 0 ELSE 1 END::BIGINT AS sums FROM events GROUP BY 1",
    "time_range_page1": _R + _SHOW + "(SELECT * FROM r WHERE ts BETWEEN TIMESTAMP '2024-01-05 03:00:00' AND TIMESTAMP '2024-01-11 03:00:00' ORDER BY ts, _sequence LIMIT 20)",
    "daily_partition_paths": _R + "SELECT _sequence, 'streams/events/partitions/' || strftime(ts, 'year=%Y/month=%m/day=%d') AS path FROM r",
    "name_validation": "SELECT name, regexp_full_match(name, '[a-z][a-z0-9-]{2,62}') AS is_name, name = '' OR regexp_full_match(name, '[a-z][a-z0-9-]{0,62}') AS is_namespace, regexp_full_match(name, '[^.]+(\\.[^.]+)*') AS is_path FROM "
    + _values([(t,) for t in SAMPLES]) + " t(name)",
    "catalog_listing": "SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderdate IS NOT NULL AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100",
    "time_range_last_page": _R + _SHOW + "(SELECT * FROM r WHERE ts BETWEEN TIMESTAMP '2024-01-05 03:00:00' AND TIMESTAMP '2024-01-05 15:00:00' ORDER BY ts, _sequence LIMIT 10000 OFFSET (SELECT least(greatest(count(*) - 1, 0) // 50 * 50, 100) FROM r WHERE ts BETWEEN TIMESTAMP '2024-01-05 03:00:00' AND TIMESTAMP '2024-01-05 15:00:00'))",
    "time_range_metadata": """SELECT count(DISTINCT date_trunc('hour', ts)) AS partitions_scanned, count(*) AS records_scanned, count(*) FILTER (ts <= TIMESTAMP '2024-01-07 03:17:00') AS records_matched
      FROM events WHERE ts >= TIMESTAMP '2024-01-05 03:00:00' AND ts < TIMESTAMP '2024-01-07 04:00:00'""",
    "time_range_text": _R + "SELECT _record_id AS record_id, _sequence AS sequence_number, regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || 'Z' AS ingested_at FROM r WHERE ts BETWEEN TIMESTAMP '2024-01-05 03:00:00' AND TIMESTAMP '2024-01-08 03:00:00'",
    "rename_fields": _R + "SELECT _sequence, user_id AS value, value AS user_id, event_type AS kind, concat_ws(',', CASE WHEN event_type IS NOT NULL THEN 'kind' END, 'props', CASE WHEN value IS NOT NULL THEN 'user_id' END, CASE WHEN user_id IS NOT NULL THEN 'value' END) AS keys FROM r",
    "stream_snapshot": "SELECT event_type AS _stream_id, count(*) AS record_count, sum(strlen(props))::BIGINT AS total_bytes, max(event_id) + 1 AS last_sequence, min(ts) AS first_timestamp, max(ts) AS last_timestamp, count(DISTINCT date_trunc('hour', ts)) AS partitions FROM events GROUP BY 1",
    "alert_silent_connected": "WITH w AS (SELECT TIMESTAMP '2024-01-01' + INTERVAL (5 * i) MINUTE AS bucket FROM range(31 * 288) t(i)), b AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, event_type, value FROM events) SELECT bucket FROM w WHERE bucket IN (SELECT bucket FROM b WHERE value > 0) AND bucket NOT IN (SELECT bucket FROM b WHERE event_type = 'purchase' AND bucket IS NOT NULL)",
    "alert_slow_windows": f"""WITH h AS (SELECT date_trunc('hour', ts) AS bucket, le, count(*) FILTER (value <= le) AS bucket_count FROM events, {_BOUNDS} WHERE value IS NOT NULL GROUP BY 1, 2),
      o AS (SELECT *, coalesce(lag(le) OVER w, 0.0) AS low, coalesce(lag(bucket_count) OVER w, 0) AS below, 0.9::DOUBLE * max(bucket_count) OVER (PARTITION BY bucket) AS rank FROM h WINDOW w AS (PARTITION BY bucket ORDER BY le))
      SELECT bucket, round(p, 6) AS p90 FROM (SELECT bucket, CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (rank - below) / (bucket_count - below) END AS p FROM o WHERE bucket_count >= rank AND below < rank) WHERE p > 95""",
    "alert_low_gauges": "SELECT user_id, value FROM (SELECT user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE value < 20",
    "stream_tail_available_now": _R + "SELECT _sequence, _ingested_at, ts < TIMESTAMP '2024-01-20 12:00:00' AS is_historical FROM r WHERE _sequence >= 200",
    "payload_checksums": _R + "SELECT _sequence, sha256(_record_id) AS key_hash, md5(_record_id) AS digest FROM r",
}
# the same walk, by sequences that are one more than event ids
ORACLE_SQL["stream_dedup"] = f"SELECT _sequence + 1 AS _sequence, user_id, event_type FROM ({ORACLE_SQL['dedup_24h']})"
