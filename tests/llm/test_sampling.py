import numpy as np
import pandas as pd
import pytest

from kilnspark.llm import sampling

CELLS = [(c, b) for c in ("a", "b_c") for b in ("0.0-0.2", "0.8-1.0")]
T_SCHEMA = "category string, p0_bin string, target_share double, min_rows int, sample_size int"
P_SCHEMA = "prompt_id string, category string, p0_bin string, unit string, cat string, bin string, have int"


def prompts(spark, per_cell):
    spell = {"a": ["a", " A "], "b_c": ["b_c", "B C", "b-c"]}
    bins = {"0.0-0.2": ["0.0-0.2", "[0.0, 0.2)", "p0_bin=[0.0, 0.2)"], "0.8-1.0": ["0.8–1.0", "0.8 to 1.0", "[0.8,1.0]"]}
    rows = []
    for (c, b), n in zip(CELLS, per_cell, strict=True):
        for i in range(n):
            row = (f"{c}{b}{i}", spell[c][i % len(spell[c])], bins[b][i % 3], "q", "q", "q", 1)
            rows += [row] * (1 + i % 2)
    rows += [("n1", None, "0.0-0.2", "q", "q", "q", 1), ("n2", "a", None, "q", "q", "q", 1), (None, "a", "0.0-0.2", "q", "q", "q", 1), ("n3", "z", "0.0-0.2", "q", "q", "q", 1)]
    return spark.createDataFrame(rows, P_SCHEMA)


def targets(spark, size, shares=(0.4, 0.3, 0.2, 0.1), floors=(2, 2, 2, 2)):
    return spark.createDataFrame([(c, b, s, f, size) for (c, b), s, f in zip(CELLS, shares, floors, strict=True)], T_SCHEMA)


def counts(df):
    return {(r["category"], r["p0_bin"]): r["n"] for r in df.groupBy("category", "p0_bin").count().withColumnRenamed("count", "n").collect()}


def test_sample_has_the_size_and_the_shares(spark):
    got = sampling.sample(prompts(spark, [300, 300, 300, 300]), targets(spark, 200))
    assert counts(got) == dict(zip(CELLS, (80, 60, 40, 20), strict=True))
    assert got.select("unit").distinct().count() == 200


def test_parts_leave_the_size_exact(spark, monkeypatch):
    monkeypatch.setattr(sampling, "PART_UNITS", 40)
    got = sampling.sample(prompts(spark, [300, 300, 300, 300]), targets(spark, 101))
    assert sum(counts(got).values()) == 101


def test_the_same_sample_again(spark):
    one = {r["unit"] for r in sampling.sample(prompts(spark, [50, 60, 70, 80]), targets(spark, 60)).collect()}
    two = {r["unit"] for r in sampling.sample(prompts(spark, [50, 60, 70, 80]).repartition(7), targets(spark, 60)).collect()}
    assert one == two


def test_floors_and_gaps(spark):
    p, t = prompts(spark, [300, 10, 300, 3]), targets(spark, 200, floors=(2, 2, 2, 30))
    report = {(r["category"], r["p0_bin"]): (r["required"], r["available"], r["shortfall"]) for r in sampling.cell_report(p, t).collect()}
    assert report == {CELLS[0]: (80, 300, 0), CELLS[1]: (60, 10, 50), CELLS[2]: (40, 300, 0), CELLS[3]: (30, 3, 27)}
    reached = {(r["category"], r["p0_bin"]) for r in sampling.shares_reached(p, t).where("unmet").collect()}
    assert reached == {CELLS[1], CELLS[3]}
    got = counts(sampling.sample(p, t))
    assert got[CELLS[1]] == 10 and got[CELLS[3]] == 3 and sum(got.values()) == 200


def test_half_rows_are_rounded_up(spark):
    t = spark.createDataFrame([("a", "0.0-0.2", 0.0125, 0, 1000), ("a", "0.8-1.0", 0.0124, 0, 1000)], T_SCHEMA)
    assert sorted(r["required"] for r in sampling.requirements(t).collect()) == [12, 13]


def test_empty_tables(spark):
    none = spark.createDataFrame([], P_SCHEMA)
    assert sampling.sample(none, targets(spark, 10)).collect() == []
    assert [r["unmet"] for r in sampling.shares_reached(none, targets(spark, 10)).collect()] == [True] * 4
    assert [r["available"] for r in sampling.cell_report(none, targets(spark, 10)).collect()] == [0] * 4
    assert sampling.sample(prompts(spark, [3, 3, 3, 3]), spark.createDataFrame([], T_SCHEMA)).collect() == []


def test_newton_meets_the_totals_of_rows_and_columns():
    r = np.random.default_rng(4)
    counts = r.integers(200, 2_000, 12).astype(float)
    rows, columns = np.repeat(np.arange(4), 3), np.tile(np.arange(3), 4)
    design = np.concatenate([np.eye(4)[rows], np.eye(3)[columns]], 1)
    start = r.random(12) * 0.2 + 0.05
    truth = np.clip(start * np.exp(design @ r.normal(0, 0.7, 7)), 0, 1)
    p = sampling.tilt(counts, start, np.zeros(12), design, (counts * truth) @ design)
    assert np.allclose((counts * p) @ design, (counts * truth) @ design, rtol=1e-6)
    # The weights are tilted by row and column only: no interaction is left in their logarithms.
    inner = np.log(p / start).reshape(4, 3)
    assert np.allclose(inner - inner[:1] - inner[:, :1] + inner[0, 0], 0, atol=1e-6) or (p >= 1 - 1e-9).any()


def test_exhausted_cells_leave_their_room_to_their_category_and_bin():
    counts, share = np.array([5, 400, 400, 400, 400, 400]), np.array([0.2, 0.1, 0.2, 0.1, 0.2, 0.2])
    cats, bins = np.array([0, 0, 1, 1, 2, 2]), np.array([0, 1, 0, 1, 0, 1])
    got = sampling.calibrate(counts, share, np.zeros(6), 100, cats, bins)
    assert got.sum() == 100 and got[0] == 5 and (got[1:] >= (share * 100)[1:]).all()
    # Cells that share neither the category nor the bin of the empty one keep their own target.
    assert got[3] == 10 and got[5] == 20 and got[1] > 10 and got[2] > 20 and got[4] > 20


def test_cells_that_hold_enough_reach_what_is_required():
    for seed in range(30):
        r = np.random.default_rng(seed)
        share, size = r.dirichlet(np.ones(12)), 600
        counts = r.integers(0, 400, 12)
        counts[:3] = 0
        got = sampling.calibrate(counts, share, np.full(12, 4), size, np.repeat(np.arange(4), 3), np.tile(np.arange(3), 4))
        due = np.minimum(np.maximum(np.floor(share * size + 0.5), 4), counts)
        assert (got >= due).all() or due.sum() > size or got.sum() < due.sum()
        assert got.sum() == min(size, counts.sum()) or due.sum() > size


@pytest.mark.parametrize("seed", range(40))
def test_calibrated_sizes_stay_within_bounds(seed):
    r = np.random.default_rng(seed)
    n, share = r.integers(0, 60, 8) * (r.random(8) > 0.2), r.dirichlet(np.ones(8))
    floors = r.integers(0, 6, 8)
    size = int(r.integers(20, 150))
    got = sampling.calibrate(n, share, floors, size)
    assert (got <= n).all() and (got >= np.minimum(floors, n)).all()
    assert got.sum() == min(max(size, np.minimum(floors, n).sum()), n.sum())


def test_pivot_keeps_the_sum_and_the_probabilities():
    r = np.random.default_rng(1)
    hits = np.zeros(40)
    for _ in range(400):
        d = sampling.pivot(pd.DataFrame({"unit": [f"{i:02d}" for i in range(40)], "p": 0.25, "u": r.random(40)}))
        assert abs(d["p"].sum() - 10) < 1e-6
        hits[[int(u) for u in d["unit"][d["p"] > 0.5]]] += 1
    assert abs(hits.mean() / 400 - 0.25) < 0.01 and hits.min() > 50


def test_an_empty_cell_leaves_its_share_to_the_others(spark):
    got = counts(sampling.sample(prompts(spark, [300, 0, 300, 300]), targets(spark, 200)))
    assert sum(got.values()) == 200 and CELLS[1] not in got
