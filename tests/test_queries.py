"""Every query with SQL gives DuckDB's rows on the small tables; the others give rows."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from quillmark import queries as Q

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v if isinstance(v, int | type(None)) else str(v)


def rows(columns, found):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, duck, name):
    df = Q.queries()[name](spark, DATA)
    got = rows(df.columns, df.collect())
    if name not in Q.oracle_sql():
        assert got
        return
    cur = duck.execute(Q.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, cur.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4 and set(e.oracle_sql()) <= set(e.queries())
