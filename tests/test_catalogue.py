"""Every core query with SQL against DuckDB on the smallest tables; the rest must run."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
NAMES = sorted(entry.catalogue.QUERIES)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{DATA}/{t}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return plain(float(v)) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    r = duck.execute(sql)
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(x[columns.index(c)]) for c in df.columns) for x in r.fetchall()), key=repr)
    assert sorted((tuple(plain(x[c]) for c in df.columns) for x in rows), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_core_stands_without_the_subpackage():
    root = os.path.join(os.path.dirname(entry.__file__), "kilnspark")
    for at, _, files in os.walk(root):
        if os.path.basename(at) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert "kilnspark.llm" not in open(os.path.join(at, f)).read(), f
