import math
import random

import pytest

from kilnspark.llm import topn

SCHEMA = "val_id long, g string, h string, s double"


def ranks(spark, rows, n=3, heavy=10_000, schema=SCHEMA):
    got = topn.top_n(spark.createDataFrame(rows, schema), ["g", "h"], "s", "val_id", n, heavy_rows=heavy)
    return sorted(((r["g"], r["h"], r["rank"], r["val_id"]) for r in got.collect()), key=repr)


def brute(rows, n=3):
    groups = {}
    for i, g, h, s, *_ in rows:
        if s is not None and not math.isnan(s):
            groups.setdefault((g, h), []).append((-s, i))
    return sorted(((g, h, k + 1, i) for (g, h), v in groups.items() for k, (_, i) in enumerate(sorted(v)[:n])), key=repr)


@pytest.mark.parametrize("heavy", [10_000, 20])
def test_against_brute_force(spark, heavy, monkeypatch):
    monkeypatch.setattr(topn, "HEAVY_SHARE", 0.05)
    r = random.Random(heavy)
    rows = [(i, r.choice(["a", "a", "a", "b", None]), r.choice(["x", "x", "y"]), r.choice([None, float("nan"), 1.0, 2.5, r.random(), -math.inf, math.inf])) for i in range(700)]
    assert ranks(spark, rows, heavy=heavy) == brute(rows)


def test_equal_scores_take_the_smaller_id_in_a_heavy_group(spark, monkeypatch):
    monkeypatch.setattr(topn, "HEAVY_SHARE", 0.05)
    rows = [(i, "a", "x", 5.0) for i in range(200, 0, -1)]
    assert ranks(spark, rows, heavy=10) == [("a", "x", 1, 1), ("a", "x", 2, 2), ("a", "x", 3, 3)]


def test_empty_and_clashing_columns(spark):
    assert ranks(spark, []) == []
    schema = SCHEMA + ", rank int, _n int, _range int, _part int"
    assert ranks(spark, [(1, "a", "x", 1.0, 9, 9, 9, 9)], schema=schema) == [("a", "x", 1, 1)]


def test_one_row_per_key(spark):
    df = spark.createDataFrame([("p", 5, 1.0), ("p", 2, 3.0), (None, 7, 1.0), (None, 8, 1.0)], "k string, i long, s double")
    got = topn.one_per_key(df, "k", "i", ["s"])
    assert sorted(map(tuple, got.collect())) == [(2, 3.0), (7, 1.0), (8, 1.0)]
