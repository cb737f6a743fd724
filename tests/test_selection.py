import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kilnspark.operators import joins, select


def test_first_and_last_win(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z"), (None, 4, "w")], "k string, pos int, v string")
    assert sorted(r["v"] for r in select.first_wins(df, ["k"], "pos").collect()) == ["x", "z"]
    assert sorted(r["v"] for r in select.last_wins(df, ["k"], "pos").collect()) == ["w", "y"]
    assert select.first_wins(df.limit(0), ["k"], "pos").collect() == []


def rows_of(seed, n=400):
    r = random.Random(seed)
    out = []
    for i in range(n):
        p = round(r.random(), 3)
        out.append((r.choice(select.CATEGORIES), f"p{i}", p, float(r.randint(0, 60)), i, min(int(p * 5), 4), f"w{r.randint(0, 25)}"))
    return out


SCHEMA = "category string, prompt_id string, p_sem double, s_score double, pos int, bin_id int, word string"


@pytest.mark.parametrize("seed", range(3))
def test_selection_equals_the_loop(spark, seed):
    """Threshold ladder, balance, back-fill and repetition cap against a loop over sorted lists."""
    rows, per_bin, quota = rows_of(seed), 8, 30
    used, want = defaultdict(set), set()
    for c in select.CATEGORIES:
        mine = sorted((x for x in rows if x[0] == c), key=lambda x: (-x[3], x[4]))
        balanced = []
        for tau in select.TAUS:
            bins = defaultdict(list)
            for x in mine:
                if x[2] >= tau:
                    bins[x[5]].append(x)
            balanced = [x for b in bins.values() for x in b[:per_bin]]
            if len(balanced) >= quota:
                break
        balanced.sort(key=lambda x: (-x[3], x[4]))
        balanced = balanced[:quota]
        order = balanced + [x for x in mine if x not in balanced]
        admitted = [x for x in order if len(used[x[6]] - {c}) < 2][:quota]
        for x in admitted:
            used[x[6]].add(c)
        want |= {x[1] for x in admitted}
    df = spark.createDataFrame(rows, SCHEMA)
    filled = select.backfilled(df, per_bin, quota, whole_ranking=True)
    got = {r["prompt_id"] for r in select.repetition_capped(filled, quota=quota, order=select.filled_order()).collect()}
    assert got == want
    first = select.backfilled(df, per_bin, quota).where("priority = 0").collect()
    assert all(r["rank"] <= quota for r in first)


def test_shortfalls(spark):
    df = spark.createDataFrame(rows_of(1), SCHEMA)
    kept = select.top_per_bin(df, 15)
    short = {(r["category"], r["bin_id"]): r["shortfall"] for r in select.bin_shortfalls(kept, 15, df).collect()}
    have = Counter((x[0], x[5]) for x in rows_of(1))
    assert short == {(c, b): 15 - min(15, have[c, b]) for c in select.CATEGORIES for b in range(5)}


@pytest.mark.parametrize("seed", range(5))
def test_water_filling_equals_the_loop(spark, seed):
    r = random.Random(seed)
    counts = [(f"r{i}", i, r.randint(0, 9)) for i in range(6)]
    gap, level, added = r.randint(0, 25), {n: k for n, _, k in counts}, Counter()
    for _ in range(gap):
        name = min(counts, key=lambda c: (level[c[0]], c[1]))[0]
        level[name] += 1
        added[name] += 1
    got = select.water_filling(spark.createDataFrame(counts, "relation string, relation_no int, n long"), gap)
    assert {x["relation"]: x["added"] for x in got.collect()} == {n: added[n] for n, _, _ in counts}


def test_joint_caps_refuse_without_counting(spark):
    rows = [("c", 1, "a", "s"), ("c", 2, "a", "t"), ("c", 3, "b", "s"), ("c", 4, "b", "u"), ("d", 5, "a", "s")]
    df = spark.createDataFrame(rows, "g string, i int, x string, y string")
    got = select.jointly_capped(df, "g", {"x": 1, "y": 1}, ["i"], "g string, i int, x string, y string")
    assert sorted(r["i"] for r in got.collect()) == [1, 4, 5]


def test_quotas_and_turns(spark):
    df = spark.createDataFrame([(r, i) for r in ("x", "y", "z") for i in range(9)], "r string, i int")
    got = Counter(x["r"] for x in select.per_relation_quota(df, "r", [F.col("i")], 8, ("x", "y", "z")).collect())
    assert got == {"x": 3, "y": 3, "z": 2}
    turns = select.round_robin(df, ["r"], [F.col("i")], 4).where("r = 'x'").orderBy("i").collect()
    assert [t["style_no"] for t in turns] == [0, 1, 2, 3, 0, 1, 2, 3, 0]


def test_batches(spark):
    rows = [("g", i, c) for i, c in enumerate([5, 5, 5, 50, 1, 1, 1, 1])] + [("h", 0, 99)]
    df = spark.createDataFrame(rows, "g string, i int, c int")
    got = select.budget_batches(df, "g", "i", "c", 3, 12, "g string, i int, c int, batch int")
    assert [r["batch"] for r in got.where("g = 'g'").orderBy("i").collect()] == [0, 0, 1, 2, 3, 3, 3, 4]
    assert [r["batch"] for r in select.fixed_batches(df, [F.col("i")], 3, ["g"]).where("g = 'g'").orderBy("i").collect()] == [0, 0, 0, 1, 1, 1, 2, 2]


def test_leak_reasons(spark):
    rows = [("The capital is Paris.", "paris"), ("The capital is ____.", "paris"), ("spacetime is interesting", "space"), ("x", "ice-cream"), (None, "cup"), ("x", None)]
    got = select.leak_reasons(spark.createDataFrame(rows, "question_text string, target_word string")).collect()
    assert [r["reason"] for r in got] == ["whole_word_leak", None, "stripped_leak", "nonalpha_target", None, "nonalpha_target"]


def test_balanced_subset(spark):
    df = spark.createDataFrame([(f"s{i}", "success") for i in range(5)] + [(f"f{i}", "failure") for i in range(12)], "prompt_id string, outcome string")
    got = Counter(r["outcome"] for r in select.balanced_subset(df, "outcome", "prompt_id").collect())
    assert got == {"success": 5, "failure": 5}


def test_lookup_join_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 20)
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(200)] + [(900, None), (901, "none")], "i int, k string")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 200, 3)], "k string, v int")
    got = {r["i"]: r["v"] for r in joins.lookup_join(left, right, "k").collect()}
    assert got == {i: 1 if i % 3 else i for i in range(200)} | {900: None, 901: None}


def test_running_numbers_of_a_large_key(spark):
    df = spark.range(3_000).selectExpr("id", "if(id % 5 = 0, 'a', if(id % 977 = 3, null, 'big')) k").repartition(7)
    got = defaultdict(list)
    for r in select.numbered(df, ["k"], [F.col("id")]).orderBy("id").collect():
        got[r["k"]].append(r["n"])
    assert all(v == list(range(1, len(v) + 1)) for v in got.values()) and set(got) == {"a", "big", None}
    assert [r["n"] for r in select.numbered(df.limit(0), ["k"], [F.col("id")]).collect()] == []


def test_first_of_each_equals_the_ranking(spark):
    df = spark.range(5_000).selectExpr("id", "if(id % 50 = 0, 'small', 'big') k")
    hashed = F.pmod(F.hash("id"), F.lit(1 << 32)).cast("bigint")
    most = spark.createDataFrame([("small", 1_000), ("big", 1_234)], "k string, n int")
    want = select.ranked(df.withColumn("h", hashed), ["k"], [F.col("h"), F.col("id")]).where("k = 'small' or rank <= 1234")
    got = select.first_of_each(df, "k", hashed, "id", most)
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect())
