import math

import pytest

from kilnspark.llm import mixing

S = "doc_id long, source string, n_tokens long, src string, u double, n int"
T = "source string, target_share double, max_repeat int"


def sized(spark, rows):
    return spark.createDataFrame([(*r, "q", 0.5, 1) for r in rows], S)


def test_capped_rate_gives_the_mean():
    for mean, cap in ((0.3, 2), (1.0, 2), (1.9, 2), (3.5, 4), (0.01, 1)):
        steps = mixing.thresholds(mixing.capped_rate(mean, cap), cap)
        assert abs(sum(1 - s for s in steps) - mean) < 1e-6
    assert mixing.capped_rate(2, 2) == math.inf and mixing.thresholds(math.inf, 3) == [0.0] * 3
    assert mixing.capped_rate(0, 2) == 0.0


def test_shares_and_caps(spark):
    rows = [(i, ["big", "BIG "][i % 2], 10) for i in range(3000)] + [(5000 + i, "small", 10) for i in range(300)] + [(9000 + i, None, 10) for i in range(700)]
    t = spark.createDataFrame([("big", 0.5, 2), ("small", 0.2, 4), ("absent", 0.3, 2)], T)
    d = sized(spark, rows)
    got = {r["source"]: r for r in mixing.shares(d, t).collect()}
    assert got["big"]["mixed_tokens"] == pytest.approx(20_000, rel=0.05) and got["small"]["mixed_tokens"] == pytest.approx(8_000, rel=0.05)
    assert not got["big"]["unmet"] and not got["small"]["unmet"] and got["absent"]["unmet"] and got["absent"]["mixed_docs"] == 0
    copies = mixing.mix(d, t).groupBy("doc_id").count()
    assert copies.agg({"count": "max"}).first()[0] <= 4
    assert mixing.mix(d, t).collect() == mixing.mix(d.repartition(5), t).collect()


def test_everything_is_repeated_where_the_share_is_out_of_reach(spark):
    t = spark.createDataFrame([("a", 0.9, 3)], T)
    d = sized(spark, [(1, "a", 5), (2, "b", 95)])
    assert sorted((r["doc_id"], r["copy_no"]) for r in mixing.mix(d, t).collect()) == [(1, 1), (1, 2), (1, 3)]
    assert [r["unmet"] for r in mixing.source_report(d, t).collect()] == [True]


def test_odd_tables(spark):
    t = spark.createDataFrame([("a", 0.9, None), ("b", 0.1, 0)], T)
    assert mixing.mix(sized(spark, [(1, "a", 5), (2, "b", 5), (None, "a", 3), (3, None, 0)]), t).collect() == []
    assert mixing.mix(sized(spark, []), t).collect() == []
    assert mixing.mix(sized(spark, [(1, "a", 5)]), spark.createDataFrame([], T)).collect() == []
    assert [r["unmet"] for r in mixing.source_report(sized(spark, []), t).collect()] == [False, False]


def test_token_counts(spark):
    rows = [(1, "hello world"), (2, ""), (3, None), (4, "héllo 漢字 <|endoftext|>"), (5, "word " * 100_000)]
    got = {r["i"]: r["n_tokens"] for r in mixing.token_counts(spark.createDataFrame(rows, "i long, text string")).collect()}
    enc = mixing.encoding(mixing.TOKENIZER)
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in rows}
    assert enc.decode(enc.encode_ordinary(rows[3][1])) == rows[3][1]


def test_sources_out_of_reach_are_those_of_the_mixture(spark):
    t = spark.createDataFrame([("a", 0.6, 2), ("b", 0.3, 1), ("c", 0.1, 5)], T)
    rows = [(i, "a", 10) for i in range(100)] + [(1000 + i, "b", 10) for i in range(900)] + [(5000 + i, "C", 10) for i in range(50)]
    got = {r["source"]: (r["unmet"], r["mixed_docs"]) for r in mixing.shares(sized(spark, rows), t).collect()}
    assert got["a"] == (True, 200) and not got["b"][0] and not got["c"][0]
