"""Every query runs on the smallest tables and agrees with its SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tessaria import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def _norm(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    r = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(_norm(x[names.index(c)]) for c in cols) for x in r.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["a", "b", "similarity"]
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
