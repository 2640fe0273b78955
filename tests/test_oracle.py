"""Every registered query with an oracle matches DuckDB on the sf0.001 tables
(row count, column names, order-insensitive values)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_matches_duckdb(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    srows = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=str)
    rel = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(dcols) == cols
    dtypes = {c: str(t) for c, t in zip(con.sql(E.oracle_sql()[name]).columns, con.sql(E.oracle_sql()[name]).types)}
    for c, t in sdf.dtypes:
        assert SAME_TYPE.get(t, t) == dtypes[c], (c, t, dtypes[c])
    order = sorted(range(len(dcols)), key=lambda i: dcols[i])
    drows = sorted((tuple(_norm(r[i]) for i in order) for r in rel.fetchall()), key=str)
    assert len(srows) == len(drows)
    assert srows == drows
