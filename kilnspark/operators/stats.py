"""Resampling, intervals and fits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnspark.functions.pressure import number_or_null

ITERATIONS, LEVELS, SEED = 1000, (0.025, 0.975), 42
#: Published intercept and slope of the violation curve (fixed values).
PUBLISHED = (-2.3981, 2.2709)
#: Most rows of a group whose whole resamples are drawn in one task.
EXACT_ROWS = 10_000_000
#: 2**32 times P(count <= k) of a Poisson distribution with mean 1, for k = 0..7.
POISSON_STEPS = tuple(int(2**32 * sum(np.exp(-1.0) / float(np.prod(np.arange(1, j + 1))) for j in range(k + 1))) for k in range(8))


def bootstrap_ci(df: DataFrame, keys: Sequence[str], value: str, id_col: str, iterations: int = ITERATIONS, levels: tuple[float, float] = LEVELS, seed: int = SEED) -> DataFrame:
    """(keys, mean, ci_low, ci_high, n): percentile bootstrap of the mean, NaN and null left out.

    Each row takes part in replicate r with a Poisson(1) number of copies,
    read off a hash of its id; replicate sums are made before the shuffle, so
    nothing is joined and no group is gathered. A group without values gives
    NaN and 0 when it is joined to a grid of groups.
    """
    rows = df.select(*keys, F.col(id_col).cast("string").alias("_id"), number_or_null(F.col(value)).alias("_v")).where("_v is not null")
    a = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("_id"))), 1, 8), 16, 10).cast("bigint")
    draws = rows.withColumn("_a", a).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    u = F.pmod(F.col("_a") * (2 * F.col("_r") + 1) + F.col("_r") * F.lit(2654435761), F.lit(1 << 32))
    weight = sum(((u >= s).cast("int") for s in POISSON_STEPS), F.lit(0))
    drawn = draws.withColumn("_w", weight)
    reps = drawn.groupBy(*keys, "_r").agg(F.sum(F.col("_w") * F.col("_v")).alias("_s"), F.sum("_w").alias("_n"))
    reps = reps.where("_n > 0").withColumn("_m", F.col("_s") / F.col("_n"))
    ci = reps.groupBy(*keys).agg(F.percentile("_m", F.lit(levels[0])).alias("ci_low"), F.percentile("_m", F.lit(levels[1])).alias("ci_high"))
    means = rows.groupBy(*keys).agg(F.avg("_v").alias("mean"), F.count("_v").alias("n"))
    return means.join(ci, list(keys), "left").select(*keys, "mean", "ci_low", "ci_high", "n") if keys else means.crossJoin(ci).select("mean", "ci_low", "ci_high", "n")


def bootstrap_exact(df: DataFrame, keys: Sequence[str], value: str, iterations: int = ITERATIONS, seed: int = SEED) -> DataFrame:
    """The same with NumPy's generator, drawing whole resamples per group; a generator per group.

    For report tables whose groups have EXACT_ROWS rows at most; a larger one
    raises. :func:`bootstrap_ci` has no such bound.
    """
    schema = df.select(*keys).schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")

    def run(d: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(d[value].dropna().to_numpy(float))
        if len(v) > EXACT_ROWS:
            raise ValueError(f"a group of {len(v)} rows is too large for whole resamples")
        out = d[list(keys)].head(1).copy()
        if len(v):
            rng = np.random.default_rng(seed)
            means = np.array([rng.choice(v, size=len(v), replace=True).mean() for _ in range(iterations)])
            low, high = np.percentile(means, [100 * x for x in LEVELS])
            return out.assign(mean=v.mean(), ci_low=low, ci_high=high, n=len(v))
        return out.assign(mean=np.nan, ci_low=np.nan, ci_high=np.nan, n=0)

    return df.groupBy(*keys).applyInPandas(run, f"{schema}, mean double, ci_low double, ci_high double, n long")


def on_grid(grid: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``found`` for every row of ``grid``; empty groups get NaN and a count of 0."""
    nan = F.lit(float("nan"))
    return grid.join(found, list(keys), "left").withColumns({c: F.coalesce(c, nan) for c in ("mean", "ci_low", "ci_high")} | {"n": F.coalesce("n", F.lit(0))})


def regression(df: DataFrame, y: str, x: str) -> DataFrame:
    """(slope, intercept, r2, n) of least squares over rows where both are numbers."""
    rows = df.select(number_or_null(F.col(y)).alias("y"), number_or_null(F.col(x)).alias("x")).dropna()
    return rows.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.count(F.lit(1)).alias("n"))


def logistic_newton(df: DataFrame, y: str, x: str, ridge: float = 1.0, steps: int = 12) -> tuple[float, float]:
    """(intercept, slope) of P(y) = 1 / (1 + exp(-(b0 + b1 x))) with a ridge on the slope, by Newton steps on summed moments."""
    rows = df.select(F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x")).dropna()
    # Equal (x, y) pairs count once with their number; the moments of a step are one row.
    rows = rows.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n")).persist()
    b0 = b1 = 0.0
    try:
        for _ in range(steps):
            p = 1 / (1 + F.exp(-(F.lit(b0) + F.lit(b1) * F.col("x"))))
            w = F.col("n") * p * (1 - p)
            e = F.col("n") * (F.col("y") - p)
            g0, g1, h00, h01, h11 = (v or 0.0 for v in rows.agg(F.sum(e), F.sum(e * F.col("x")), F.sum(w), F.sum(w * F.col("x")), F.sum(w * F.col("x") * F.col("x"))).first())
            g1, h11 = g1 - ridge * b1, h11 + ridge
            det = h00 * h11 - h01 * h01
            if det <= 0:
                break
            d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
            b0, b1 = b0 + d0, b1 + d1
            if abs(d0) + abs(d1) < 1e-10:
                break
    finally:
        rows.unpersist()
    return b0, b1


def logistic_curve(x: Column, b0: float, b1: float) -> Column:
    """The fitted probability at x."""
    return 1 / (1 + F.exp(-(F.lit(b0) + F.lit(b1) * x)))


def _logistic_replicates(df: DataFrame, y: str, x: str, replicates: int, seed: int) -> DataFrame:
    """(r, b0, b1) of fits to Poisson counts of (x, y) cells, x rounded to a hundredth, so that each task works on a few hundred cells whatever the table's size.

    Replicates of one class only have no fit and are left out.
    """
    cells = df.select(F.round(F.col(x).cast("double"), 2).alias("x"), F.col(y).cast("double").alias("y")).dropna().groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))

    def fit(xs: np.ndarray, ys: np.ndarray, n: np.ndarray) -> tuple[float, float]:
        b = np.zeros(2)
        for _ in range(25):
            p = 1 / (1 + np.exp(-(b[0] + b[1] * xs)))
            w = n * p * (1 - p)
            g = np.array([(n * (ys - p)).sum(), (n * (ys - p) * xs).sum() - b[1]])
            h = np.array([[w.sum(), (w * xs).sum()], [(w * xs).sum(), (w * xs * xs).sum() + 1.0]])
            step = np.linalg.solve(h + 1e-12 * np.eye(2), g)
            b += step
            if np.abs(step).sum() < 1e-10:
                break
        return float(b[0]), float(b[1])

    def run(d: pd.DataFrame) -> pd.DataFrame:
        r = int(d["r"].iat[0])
        d = d.sort_values(["x", "y"])
        xs, ys, n = (d[c].to_numpy(float) for c in ("x", "y", "n"))
        k = np.random.default_rng([seed, r]).poisson(n).astype(float)
        rows = [] if (k * ys).sum() in (0.0, k.sum()) else [(r, *fit(xs, ys, k))]
        return pd.DataFrame(rows, columns=["r", "b0", "b1"]).astype({"r": "int32", "b0": float, "b1": float})

    return cells.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).groupBy("r").applyInPandas(run, "r int, b0 double, b1 double")


def logistic_band(df: DataFrame, y: str, x: str, replicates: int = 200, points: int = 101, seed: int = SEED) -> DataFrame:
    """(x, p, low, high): the curve of the exact fit with the bootstrap band of :func:`_logistic_replicates`."""
    b0, b1 = logistic_newton(df, y, x)
    at = (F.col("i") / (points - 1)).alias("x")
    drawn = _logistic_replicates(df, y, x, replicates, seed).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    p = 1 / (1 + F.exp(-(F.col("b0") + F.col("b1") * F.col("i") / (points - 1))))
    band = drawn.groupBy("i").agg(F.percentile(p, F.lit(0.025)).alias("low"), F.percentile(p, F.lit(0.975)).alias("high"))
    return band.select(at, logistic_curve(F.col("i") / (points - 1), b0, b1).alias("p"), "low", "high")


def logistic_coefficients(df: DataFrame, y: str, x: str, replicates: int = 200, seed: int = SEED) -> DataFrame:
    """(name, value, low, high) of intercept and slope: the exact fit with bootstrap intervals."""
    b = logistic_newton(df, y, x)
    drawn = _logistic_replicates(df, y, x, replicates, seed)
    ends = drawn.agg(*[F.percentile(c, F.lit(q)).alias(f"{c}_{i}") for c in ("b0", "b1") for i, q in enumerate(LEVELS)])
    row = lambda name, c, v: F.struct(F.lit(name).alias("name"), F.lit(v).alias("value"), F.col(f"{c}_0").alias("low"), F.col(f"{c}_1").alias("high"))
    return ends.select(F.inline(F.array(row("intercept", "b0", b[0]), row("slope", "b1", b[1]))))


def isotonic(df: DataFrame, y: str, x: str) -> DataFrame:
    """(x, p) of an increasing step fit, from Spark's own isotonic regression on the distinct x with their mean and weight."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("label")).dropna().groupBy("x").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    features = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    model = IsotonicRegression(weightCol="weight").fit(features)
    return model.transform(features).select("x", F.col("prediction").alias("p"))


def error_bars(df: DataFrame) -> DataFrame:
    """Distances of an interval's ends from the mean."""
    return df.withColumn("err_low", F.col("mean") - F.col("ci_low")).withColumn("err_high", F.col("ci_high") - F.col("mean"))


def hashed_order(id_col: Column, seed: int) -> Column:
    """A seeded order that doesn't depend on the data's place: shuffles and samples sort by it."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), id_col.cast("string"))), 1, 8), 16, 10).cast("bigint")


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = SEED) -> DataFrame:
    """``n`` rows without replacement, or all if there are fewer."""
    return df.orderBy(hashed_order(F.col(id_col), seed), F.col(id_col)).limit(n)


def placed(df: DataFrame, order: Column, name: str) -> DataFrame:
    """A report table's rows with their place in an order."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(order)))
