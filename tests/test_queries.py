"""Every query of the engine against its SQL on the small tables."""

import glob
import os

import pytest

from runnel import oracles
from runnel import queries as Q

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v)


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query_matches_sql(spark, data, sql, name):
    df = Q.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(columns).collect())
    asked = sql.execute(oracles.ORACLE_SQL[name])
    names = [c[0] for c in asked.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[k]) for k in at) for r in asked.fetchall())


def test_entry_names():
    import __spark_entry__ as entry

    assert set(Q.QUERIES) <= set(entry.queries())
    assert set(oracles.ORACLE_SQL) <= set(entry.oracle_sql())
