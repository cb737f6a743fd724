"""The N best items of every group, by a hot-cold split.

Exact group counts tell heavy groups from light ones. Light groups go through
an ordinary window. A heavy group is cut into score ranges at its own
quantiles; the exact counts of the ranges show which of them can hold one of
the N best, the rows of those are ranked in salted parts, and the parts'
winners are ranked again. The two results are united.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilnspark.session import cut_lineage

#: A group is heavy beyond this many rows, as long as there are no more than 1 / HEAVY_SHARE of them, whose ranges are on every task (10 MB); beyond, it is beyond this share of all rows.
HEAVY_ROWS = 10_000
HEAVY_SHARE = 1 / 20_000
#: Score ranges of a heavy group, and parts in which the rows of the kept ranges are ranked.
RANGES = 64
PARTS = 32


def one_per_key(df: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """The row of smallest ``order`` of each ``key``; rows without a key stand for themselves. Summed up before the shuffle."""
    kept = F.struct(order, *[c for c in columns if c != order])
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(kept, F.col(order)).alias("r")).select("r.*")
    return first.unionByName(df.where(F.col(key).isNull()).select(order, *[c for c in columns if c != order]))


def top_n(df: DataFrame, group: Sequence[str], score: str, tie: str, n: int, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Rows of ``df`` (columns group, score, tie) with their ``rank`` of 1..n: highest score first, then smallest tie.

    Rows whose score is null or NaN take no part; a null in the group columns
    is a group value like any other. Rows equal in score and tie are ranked in
    no defined order among themselves. An empty table gives no rows.
    """
    group = list(group)
    rows = df.select(*group, score, tie).where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    best = [F.col(score).desc(), F.col(tie).asc()]
    pick = lambda d, keys: d.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= n)

    counts = cut_lineage(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_total")).scalar()
    heavy = counts.where(F.col("_n") > F.greatest(F.lit(float(heavy_rows)), total * HEAVY_SHARE)).select(*group)
    tag = heavy.select(*[F.col(g).alias(f"_h{i}") for i, g in enumerate(group)])
    is_heavy = lambda: [F.col(g).eqNullSafe(F.col(f"_h{i}")) for i, g in enumerate(group)]

    light = pick(rows.join(F.broadcast(tag), is_heavy(), "left_anti"), group)

    hot = rows.join(F.broadcast(tag), is_heavy(), "left_semi")
    at = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    cuts = hot.groupBy(*group).agg(F.percentile_approx(F.col(score).cast("double"), at, F.lit(1_000)).alias("_cuts"))
    cuts = cut_lineage(cuts.select(*[F.col(g).alias(f"_h{i}") for i, g in enumerate(group)], "_cuts"))
    # Range 0 holds the highest scores; equal scores always share a range.
    ranged = hot.join(F.broadcast(cuts), is_heavy()).withColumn("_range", F.size(F.filter("_cuts", lambda c: c > F.col(score).cast("double")))).drop("_cuts", *[f"_h{i}" for i in range(len(group))])
    filled = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    above = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = filled.withColumn("_above", above).where(F.col("_above") < n).groupBy(*group).agg(F.max("_range").alias("_last"))
    needed = needed.select(*[F.col(g).alias(f"_h{i}") for i, g in enumerate(group)], "_last")
    kept = ranged.join(F.broadcast(needed), is_heavy()).where(F.col("_range") <= F.col("_last"))
    parts = kept.withColumn("_part", F.pmod(F.xxhash64(tie), F.lit(PARTS)))
    winners = pick(pick(parts, [*group, "_part"]).select(*group, score, tie), group)
    return light.unionByName(winners.select(*light.columns))
