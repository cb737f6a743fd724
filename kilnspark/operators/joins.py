"""Joins that hold when one key has a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot beyond this many rows, as long as there are no more than HOT_KEYS of them, which every task knows; beyond, from a HOT_KEYS-th of all rows on, which is no more than a task's fair share of a large table.
HOT_ROWS = 50_000
HOT_KEYS = 100_000
#: Parts into which rows without a key are spread.
NULL_PARTS = 1_000
#: Rows up to which a table counts as small.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has no more than ``rows`` rows, which are counted; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``left`` with the row of ``right`` that has its key; ``right`` has one row per key.

    Exact counts find the hot keys of the left side. Their rows are salted and
    the right side's row is repeated once per salt, so that no task gets a whole
    hot key. Null keys match nothing and are spread by their row's content.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_total")).scalar()
    hot = counts.where(F.col("_n") > F.greatest(F.lit(float(HOT_ROWS)), total / HOT_KEYS))
    hot = hot.select(F.col(key).alias("_hot"), F.ceil(F.col("_n") / HOT_ROWS).cast("int").alias("_parts"))
    tag = lambda d: d.join(F.broadcast(hot), d[key] == F.col("_hot"), "left").drop("_hot")
    spread = F.xxhash64(*[c for c, kind in left.dtypes if not kind.startswith("map")])
    a = tag(left).withColumn(
        "_salt",
        F.when(F.col(key).isNull(), -1 - F.pmod(spread, F.lit(NULL_PARTS))).when(F.col("_parts").isNotNull(), F.pmod(spread, F.col("_parts"))).otherwise(0).cast("int"),
    )
    b = tag(right).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return a.drop("_parts").join(b.drop("_parts"), [key, "_salt"], how).drop("_salt")
