import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnspark.functions import arrays, pressure
from kilnspark.operators import stats


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def arr(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def ints(*values):
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<int>")


def test_suppression(spark):
    delta, relative, log = (one(spark, c) for c in pressure.suppression(F.lit(0.8), F.lit(0.2)))
    assert (delta, relative, log) == pytest.approx((0.6, 0.75, math.log(4)))
    assert one(spark, pressure.suppression(F.lit(0.0), F.lit(0.0))[1]) == 0.0


def test_bins(spark):
    given = [0.0, 0.1999, 0.2, 0.6, 0.99, 1.0, 1.7, -0.3]
    got = [one(spark, pressure.bin_id(F.lit(v))) for v in given]
    assert got == [0, 0, 1, 3, 4, 4, 4, 0]
    assert one(spark, pressure.bin_label(F.lit(4))) == "0.8-1.0"
    labels = {"[0.0, 0.2)": (0.0, 0.1), "p0_bin=[0.4, 0.6)": (0.4, 0.5), "0.0-0.2": (0.0, 0.1), "0.4-0.6": (0.4, 0.5), "x": (math.inf, 0.5)}
    for label, (low, mid) in labels.items():
        assert one(spark, pressure.bin_lower(F.lit(label))) == pytest.approx(low) and one(spark, pressure.bin_center(F.lit(label))) == pytest.approx(mid)


def judged(spark, **kw):
    v = {"is_one_word_answer_enforced": True, "best_one_word_answer": "Paris", "top3_one_word_answers": ["paris", "london", "berlin"], "is_X_best": True, "ambiguity_score": 2, "leaks_answer": False, "naturalness_score": 8} | kw
    schema = "v struct<is_one_word_answer_enforced:boolean,best_one_word_answer:string,top3_one_word_answers:array<string>,is_X_best:boolean,ambiguity_score:int,leaks_answer:boolean,naturalness_score:int>"
    df = spark.createDataFrame([(tuple(v.values()),)], schema)
    return df.select(pressure.judge_score(F.col("v"), F.lit("paris")).alias("s"), pressure.accepted(F.col("v"), F.lit("paris")).alias("a")).first()


def test_judge(spark):
    assert tuple(judged(spark)) == (70, True)
    assert judged(spark, top3_one_word_answers=["paris", "london"])["s"] == 85 and judged(spark, top3_one_word_answers=["Paris"])["s"] == 100
    assert judged(spark, top3_one_word_answers=None)["s"] == 100
    for bad in ({"leaks_answer": True}, {"ambiguity_score": 4}, {"naturalness_score": 6}, {"is_one_word_answer_enforced": None}, {"ambiguity_score": None}):
        assert tuple(judged(spark, **bad)) == (0, False)
    assert judged(spark, best_one_word_answer=None)["a"] is False
    assert one(spark, pressure.selection_score(F.lit(70), F.lit(0.85))) == 155.0


def test_masses_and_scores(spark):
    w = arr(0.1, 0.2, 0.3, 0.4)
    assert one(spark, arrays.mass(w, ints(1, 3, 9, -1))) == pytest.approx(0.6) and one(spark, arrays.mass(w, ints())) == 0.0
    assert one(spark, arrays.span_mass(w, 1, 3)) == pytest.approx(0.5)
    s = {k: one(spark, c) for k, c in arrays.attention_scores(F.lit(0.4), F.lit(0.1), F.lit(0.2), F.lit(0.4)).items()}
    assert s == pytest.approx({"iar": 0.5, "nf": 0.25, "tmf": 0.5, "pi": 0.25}, rel=1e-6)


def test_softmax_and_argmax(spark):
    x = np.array([1.0, 3.0, 2.0, -500.0])
    p = one(spark, arrays.softmax_of(arr(*x)))
    e = np.exp(x - x.max())
    assert np.allclose(p, e / e.sum()) and one(spark, arrays.argmax(arr(*x))) == 1
    assert one(spark, arrays.dot(arr(1, 2), arr(3, 4))) == 11.0 and one(spark, arrays.add(arr(1, 2), arr(3, 4))) == [4.0, 6.0]


def test_patches(spark):
    own, other = arr(0, 1, 2, 3), arr(10, 11, 12)
    assert one(spark, arrays.patched(own, other, ints(2, 3))) == [0.0, 1.0, 12.0, 3.0]
    pairs = arrays.aligned(ints(0, 3, 1), ints(2, 1))
    assert [(r["a"], r["b"]) for r in one(spark, pairs)] == [(0, 2), (3, 1)]
    assert one(spark, arrays.patched_pairs(own, other, pairs)) == [12.0, 1.0, 2.0, 11.0]
    assert one(spark, arrays.aligned(ints(), ints(1))) == []


def test_token_spans(spark):
    tokens = F.array(F.lit("sp"), F.lit("ace"), F.lit("."))
    spans = arrays.running_spans(tokens)
    assert [(r["start"], r["end"]) for r in one(spark, spans)] == [(0, 2), (2, 5), (5, 6)]
    got = one(spark, arrays.token_range(spans, F.lit(0), F.lit(5)))
    assert (got["start"], got["end"]) == (0, 1)
    offsets = F.expr("array(named_struct('start', 0, 'end', 5), named_struct('start', 5, 'end', 10), named_struct('start', 10, 'end', 15), named_struct('start', 0, 'end', 0))")
    assert one(spark, arrays.overlapping(offsets, F.lit(7), F.lit(12))) == [1, 2]
    assert one(spark, arrays.overlapping(offsets, F.lit(None).cast("int"), F.lit(None).cast("int"))) == []


def test_steps_and_ids(spark):
    f = lambda known, bad, present, first, n: one(spark, arrays.decision_step(F.lit(known), F.lit(bad), F.lit(present), F.lit(first), F.lit(n)))
    assert f(True, False, False, 3, 5) == 0 and f(True, False, True, 3, 5) == 3 and f(True, False, True, 9, 5) == 4
    assert one(spark, arrays.trimmed_ids(ints(4, 5, 2, 7), 2, 0)) == [4, 5, 2]
    assert one(spark, arrays.trimmed_ids(ints(4, 0, 5, 0, 0), 2, 0)) == [4, 0, 5] and one(spark, arrays.trimmed_ids(ints(0, 0), 2, 0)) == []
    assert one(spark, arrays.finish_reason(ints(1, 2), 3)) == "stop" and one(spark, arrays.finish_reason(ints(1, 2), 2)) == "length"


def test_factorised(spark):
    logits = np.zeros(100)
    logits[5] = 10
    p = np.exp(logits - 10)
    p /= p.sum()
    rest = F.create_map(F.lit(5), F.lit(0.8), F.lit(10), F.lit(0.1))
    assert one(spark, arrays.factorised(arr(*p), rest)) == pytest.approx(0.8 * p[5] + 0.1 * p[10]) and 0.8 * p[5] > 0.5


def test_bootstrap(spark):
    r = np.random.default_rng(1)
    rows = [("a", f"i{i}", float(v)) for i, v in enumerate(r.normal(3, 1, 400))] + [("a", "n", None), ("a", "m", float("nan")), ("b", "x", 2.0), ("c", "y", None)]
    df = spark.createDataFrame(rows, "g string, id string, v double")
    got = {x["g"]: x for x in stats.bootstrap_ci(df, ["g"], "v", "id", iterations=400).collect()}
    exact = {x["g"]: x for x in stats.bootstrap_exact(df, ["g"], "v", iterations=400).collect()}
    a, b = got["a"], exact["a"]
    assert a["n"] == b["n"] == 400 and a["mean"] == pytest.approx(b["mean"])
    assert a["ci_low"] < a["mean"] < a["ci_high"] and abs(a["ci_low"] - b["ci_low"]) < 0.03 and abs(a["ci_high"] - b["ci_high"]) < 0.03
    assert (got["b"]["mean"], got["b"]["ci_low"], got["b"]["ci_high"]) == (2.0, 2.0, 2.0)
    grid = spark.createDataFrame([("a",), ("c",), ("z",)], "g string")
    full = {x["g"]: x for x in stats.on_grid(grid, stats.bootstrap_ci(df, ["g"], "v", "id", iterations=20), ["g"]).collect()}
    assert full["z"]["n"] == 0 and math.isnan(full["z"]["mean"]) and full["c"]["n"] == 0
    again = stats.bootstrap_ci(df.repartition(7), ["g"], "v", "id", iterations=400).where("g = 'a'").first()
    assert again["ci_low"] == pytest.approx(a["ci_low"])


def test_fits(spark):
    r = np.random.default_rng(2)
    x = r.random(4000)
    y = (r.random(4000) < 1 / (1 + np.exp(2.4 - 2.27 * x))).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    b0, b1 = stats.logistic_newton(df, "y", "x", ridge=0.0)
    assert abs(b0 + 2.4) < 0.2 and abs(b1 - 2.27) < 0.3
    line = stats.regression(spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (3.0, 7.0), (float("nan"), 1.0)], "x double, y double"), "y", "x").first()
    assert (line["slope"], line["intercept"], line["r2"], line["n"]) == pytest.approx((2.0, 1.0, 1.0, 3))
    band = stats.logistic_band(df, "y", "x", replicates=30).orderBy("x").collect()
    assert len(band) == 101 and all(p["low"] <= p["p"] + 0.05 and p["p"] <= p["high"] + 0.05 for p in band)
    steps = [p["p"] for p in stats.isotonic(df.limit(500), "y", "x").orderBy("x").collect()]
    assert all(a <= b + 1e-12 for a, b in zip(steps, steps[1:], strict=False))
