"""A sample whose cells follow target shares.

Cells of category and bin are summed up in Spark. Each cell's inclusion
probability starts at what its own target asks and is tilted by
``exp(lambda[category] + mu[bin])``, held between its floor and 1, so that the
shares of every category and of every bin are met although some cells hold too
little: lambda and mu, which all cells of a row or column share, solve the dual
by Newton steps on the moments of the cells. The probabilities are turned into
a sample of fixed size by the pivotal method, in parts that leave one undecided
unit each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilnspark.functions.names import bin_key, name_key
from kilnspark.session import cut_lineage

#: Units of one cell that are decided in one task; a cell of more is cut into parts.
PART_UNITS = 100_000
#: Most rows of the target table.
TARGET_CELLS = 100_000


def cells_of(df: DataFrame, unit: str = "prompt_id", category: str = "category", bin_col: str = "p0_bin") -> DataFrame:
    """Distinct (unit, cat, bin) as read; rows without unit, category or bin are in no cell."""
    rows = df.select(F.col(unit).alias("unit"), name_key(df[category]).alias("cat"), bin_key(df[bin_col]).alias("bin"))
    return rows.dropna().distinct()


def requirements(targets: DataFrame) -> DataFrame:
    """Targets with their cell keys and ``required``: the larger of min_rows and share times size, rounded half up."""
    # Shares are decimal numbers; as such half of a unit is met exactly.
    share = F.col("target_share").cast("decimal(20,10)") * F.col("sample_size").cast("decimal(12,0)")
    asked = F.floor(share + F.lit("0.5").cast("decimal(2,1)")).cast("bigint")
    return targets.select(
        F.col("category").alias("category"),
        F.col("p0_bin").alias("p0_bin"),
        "target_share",
        "min_rows",
        "sample_size",
        name_key(targets["category"]).alias("cat"),
        bin_key(targets["p0_bin"]).alias("bin"),
        F.greatest(F.coalesce(F.col("min_rows").cast("bigint"), F.lit(0)), F.coalesce(asked, F.lit(0))).alias("required"),
    )


def cell_report(df: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target cell: required, available, shortfall. Cells are summed up before the shuffle; the targets are few."""
    return _report(cells_of(df), requirements(targets))


def _report(cells: DataFrame, asked: DataFrame) -> DataFrame:
    have = cells.groupBy("cat", "bin").agg(F.count(F.lit(1)).alias("have"))
    return (
        asked
        .join(have, ["cat", "bin"], "left")
        .withColumn("available", F.coalesce("have", F.lit(0)))
        .withColumn("shortfall", F.greatest(F.col("required") - F.col("available"), F.lit(0)))
        .drop("have")
    )


def tilt(counts: np.ndarray, start: np.ndarray, low: np.ndarray, design: np.ndarray, totals: np.ndarray, ridge: float = 1e-9, steps: int = 200) -> np.ndarray:
    """Inclusion probabilities ``clip(start * exp(design @ theta), low, 1)`` whose moments ``counts * p @ design`` meet ``totals``.

    ``design`` has a row per cell. Damped Newton steps on the dual, whose
    Hessian is that of the cells between their bounds; a ridge, as a share of
    the totals, keeps theta finite where no probabilities can meet them all, and
    then what is missing is spread over the totals.
    """
    theta, size = np.zeros(design.shape[1]), max(totals.sum(), 1.0)
    ridge = ridge * size

    def at(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        raw = start * np.exp(np.clip(design @ theta, -40, 40))
        p = np.clip(raw, low, 1.0)
        gradient = (counts * p) @ design - totals + ridge * theta
        return raw, gradient, float(np.abs(gradient).max())

    raw, gradient, worst = at(theta)
    for _ in range(steps):
        if worst < 1e-9 * size:
            break
        inner = counts * raw * ((raw > low) & (raw < 1.0))
        hessian = design.T @ (inner[:, None] * design) + max(ridge, 1e-7 * size) * np.eye(len(theta))
        step = np.clip(np.linalg.solve(hessian, gradient), -2.0, 2.0)
        for _ in range(20):
            new = at(theta - step)
            if new[2] < worst:
                break
            step = step / 2
        else:
            break
        theta, (raw, gradient, worst) = theta - step, new
    return np.clip(raw, low, 1.0)


def calibrate(counts: np.ndarray, shares: np.ndarray, floors: np.ndarray, size: int, categories: np.ndarray | None = None, bins: np.ndarray | None = None) -> np.ndarray:
    """Whole-number cell sizes that sum to ``size`` where the cells allow it.

    A cell gets what its target and floor ask, or all it holds. The room that
    exhausted cells leave goes to the others by :func:`tilt`, so that the
    totals of categories and bins come as close to their targets as they can
    (each cell by itself where these are not given). What is still missing is
    shared out in proportion, what is too much taken off above the floors.
    Fractions go to the largest remainders, earlier cells first, and to cells
    below their rounded target before others.
    """
    counts = counts.astype(float)
    floors = np.minimum(floors, counts).astype(float)
    n, held = len(counts), np.maximum(counts, 1.0)
    goal = np.minimum(np.maximum(shares * size, floors), counts)
    if categories is None:
        categories, bins = np.arange(n), np.zeros(n)
    marks = [np.unique(m, return_inverse=True)[1] for m in (categories, bins)]
    design = np.concatenate([np.eye(m.max() + 1)[m] for m in marks], 1) if n else np.zeros((0, 0))
    # Two totals that can't both be met share the gap, so the ridge is that of a soft calibration.
    want = counts * tilt(counts, goal / held, goal / held, design, (shares * size) @ design, 1e-3) if n else counts
    want = np.where(counts > 0, want, 0.0)
    for _ in range(2 * n):
        gap = min(size, counts.sum()) - want.sum()
        open_cells = (want < counts - 1e-9) & (shares > 0) if gap > 0 else want > goal + 1e-9
        if gap < 0 and not open_cells.any():
            open_cells = want > floors + 1e-9
        if abs(gap) < 1e-6 or not open_cells.any():
            break
        part = shares[open_cells] if gap > 0 else (want - (goal if (want > goal + 1e-9).any() else floors))[open_cells]
        want[open_cells] += max(gap, -part.sum()) * part / part.sum()
        want = np.clip(want, floors, counts)
    whole = np.floor(want + 1e-9)
    rest = int(round(min(size, want.sum()) - whole.sum()))
    for i in np.argsort(-(want - whole), kind="stable"):
        if rest > 0 and whole[i] < counts[i]:
            whole[i] += 1
            rest -= 1
    due = np.minimum(np.maximum(np.floor(shares * size + 0.5), floors), counts)
    for i in np.flatnonzero(whole < due):
        richest = int((whole - due).argmax())
        if whole[richest] > due[richest]:
            whole[richest] -= 1
            whole[i] += 1
    return whole.astype(int)


def pivot(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pivotal method over units in hash order: pairs fight until all but at most one have probability 0 or 1."""
    pdf = pdf.sort_values(["u", "unit"], kind="stable")
    units, probs, luck = pdf["unit"].to_numpy(), pdf["p"].to_numpy(float).copy(), pdf["u"].to_numpy(float)
    i = 0
    for j in range(1, len(units)):
        a, b, r = probs[i], probs[j], luck[j]
        if a < 1e-9 or a > 1 - 1e-9:
            i = j
            continue
        if b < 1e-9 or b > 1 - 1e-9:
            continue
        if a + b < 1:
            loser, winner = (j, i) if r < a / (a + b) else (i, j)
            probs[loser], probs[winner] = 0.0, a + b
            i = winner
        else:
            one, other = (i, j) if r < (1 - b) / (2 - a - b) else (j, i)
            probs[one], probs[other] = 1.0, a + b - 1
            i = other
    return pdf.assign(p=np.where(probs > 1 - 1e-9, 1.0, np.where(probs < 1e-9, 0.0, probs)))


def sample(df: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """(unit, category, p0_bin) drawn so that the cells follow the targets, floors kept, sizes whole.

    A unit that occurs in several cells is drawn for the first of them only. A
    cell that holds less than it should comes out whole; :func:`cell_report`
    names it. Targets are a table of one row per cell, TARGET_CELLS at most;
    only their counts reach the driver.
    """
    return _drawn(cut_lineage(cells_of(df)), requirements(targets), seed)


def _drawn(cells: DataFrame, asked: DataFrame, seed: int) -> DataFrame:
    spark = cells.sparkSession
    once = cells.groupBy("unit").agg(F.min(F.struct("cat", "bin")).alias("c")).select("unit", "c.cat", "c.bin")
    counted = asked.join(once.groupBy("cat", "bin").agg(F.count(F.lit(1)).alias("have")), ["cat", "bin"], "left").orderBy("cat", "bin", "category", "p0_bin").limit(TARGET_CELLS + 1).toPandas()
    if len(counted) > TARGET_CELLS:
        raise ValueError(f"more than {TARGET_CELLS} target cells")
    schema = "unit string, category string, p0_bin string"
    if counted.empty:
        return spark.createDataFrame([], schema)
    have = counted["have"].fillna(0).to_numpy()
    floors = counted["min_rows"].fillna(0).to_numpy()
    named = [counted[c].fillna("").to_numpy() for c in ("cat", "bin")]
    sizes = calibrate(have, counted["target_share"].fillna(0.0).to_numpy(float), floors, int(counted["sample_size"].fillna(0).max()), *named)
    plan = counted[["cat", "bin", "category", "p0_bin"]].assign(p=np.where(have > 0, sizes / np.maximum(have, 1), 0.0), parts=np.maximum(1, np.ceil(have / PART_UNITS)).astype(int))
    luck = (F.pmod(F.xxhash64(F.lit(seed), "unit"), F.lit(1 << 48)) / float(1 << 48)).alias("u")
    # TARGET_CELLS rows at most.
    units = once.join(F.broadcast(spark.createDataFrame(plan)), ["cat", "bin"])
    units = units.select(F.col("unit").cast("string"), "category", "p0_bin", "p", luck, F.pmod(F.xxhash64(F.lit(seed + 1), "unit"), F.col("parts")).cast("int").alias("part"))
    shape = "unit string, category string, p0_bin string, p double, u double, part int"
    kept = lambda least: lambda d: (r := pivot(d))[r["p"] > least]
    sure = units.where((F.col("p") > 1 - 1e-9))
    first = cut_lineage(units.where((F.col("p") > 1e-9) & (F.col("p") <= 1 - 1e-9)).groupBy("category", "p0_bin", "part").applyInPandas(kept(0), shape))
    # What a part leaves undecided, one unit each, is decided in its cell: at most one unit per PART_UNITS.
    second = first.where(F.col("p") < 1 - 1e-9).groupBy("category", "p0_bin").applyInPandas(kept(0.5), shape)
    return sure.unionByName(first.where(F.col("p") >= 1 - 1e-9)).unionByName(second).select("unit", "category", "p0_bin")


def shares_reached(df: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """The cell report with the number of sampled units and the share they have of the sample.

    ``unmet`` are the cells whose sample stays below what is required because they hold no more.
    """
    cells, asked = cut_lineage(cells_of(df)), requirements(targets)
    got = _drawn(cells, asked, seed).groupBy("category", "p0_bin").agg(F.count(F.lit(1)).alias("sampled"))
    report = _report(cells, asked).join(got, ["category", "p0_bin"], "left").withColumn("sampled", F.coalesce("sampled", F.lit(0)))
    share = F.try_divide(F.col("sampled").cast("double"), F.sum("sampled").over(Window.partitionBy()))
    report = report.withColumns({"share_reached": F.round(share, 9), "unmet": (F.col("sampled") < F.col("required")) & (F.col("shortfall") > 0)})
    return report.select("category", "p0_bin", "target_share", "required", "available", "shortfall", "sampled", "share_reached", "unmet")
