"""Every query of the training-data operators on the smallest tables, against DuckDB where it has SQL."""

import math
import os

import pytest

from kilnspark.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    import duckdb

    df = queries.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in queries.ORACLE:
        return
    duck = duckdb.connect()
    for t in os.listdir(DATA):
        duck.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{DATA}/{t}')")
    r = duck.execute(queries.ORACLE[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(x[columns.index(c)]) for c in df.columns) for x in r.fetchall()), key=repr)
    assert sorted((tuple(plain(x[c]) for c in df.columns) for x in rows), key=repr) == want
