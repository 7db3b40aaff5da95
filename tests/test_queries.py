"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from docloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no given tables")


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return float(v) if type(v).__name__ == "Decimal" else str(v) if type(v).__name__ == "datetime" else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    got = [tuple(plain(v) for v in r) for r in df.select(sorted(df.columns)).collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    rel = duck.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=names.__getitem__)
    want = [tuple(plain(r[i]) for i in order) for r in rel.fetchall()]
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted(got, key=key) == sorted(want, key=key)
