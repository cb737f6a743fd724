"""Selection: de-duplication, ranking, bin balancing, back-fill, repetition caps, quotas and batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnspark.functions import pressure, text
from kilnspark.operators.joins import small
from kilnspark.session import cut_lineage

CATEGORIES = ("idioms", "facts", "common_sense", "creative", "ood")
TAUS = (0.2, 0.15000000000000002, 0.10000000000000002, 0.05000000000000002)


def best_first() -> list[Column]:
    """Highest s_score first, then by place."""
    return [F.col("s_score").desc(), F.col("pos").asc()]


def filled_order() -> list[Column]:
    """Balanced rows first, the best first among them."""
    return [F.col("priority").asc(), *best_first()]


def first_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of smallest ``order`` per key. Summed up before the shuffle, so a key may hold any part of the rows."""
    row = F.struct(order, *[c for c in df.columns if c != order])
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, F.col(order)).alias("r")).select("r.*")


def last_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of largest ``order`` per key."""
    row = F.struct(order, *[c for c in df.columns if c != order])
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(row, F.col(order)).alias("r")).select("r.*")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Row numbers per key; a filter on them is pushed below the shuffle by the planner."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_per_bin(df: DataFrame, per_bin: int, keys: Sequence[str] = ("category", "bin_id"), order: Sequence[Column] | None = None) -> DataFrame:
    """The ``per_bin`` best rows of each key by s_score, then pos."""
    return ranked(df, keys, order or best_first()).where(F.col("rank") <= per_bin)


def bin_shortfalls(kept: DataFrame, per_bin: int, categories: DataFrame) -> DataFrame:
    """(category, bin_id, shortfall) over all bins of all categories, 0 where none."""
    have = kept.groupBy("category", "bin_id").agg(F.count(F.lit(1)).alias("have"))
    grid = categories.select("category").distinct().withColumn("bin_id", F.explode(F.sequence(F.lit(0), F.lit(pressure.BINS - 1))))
    return grid.join(have, ["category", "bin_id"], "left").select("category", "bin_id", (F.lit(per_bin) - F.coalesce("have", F.lit(0))).alias("shortfall"))


def tau_ladder(df: DataFrame, per_bin: int, quota: int) -> DataFrame:
    """(category, tau, balanced, reached): size of the balanced set at each threshold, all thresholds in one pass."""
    taus = df.withColumn("tau", F.explode(F.array(*[F.lit(t) for t in TAUS]))).where(F.col("p_sem") >= F.col("tau"))
    sizes = taus.groupBy("category", "tau", "bin_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("category", "tau").agg(F.sum(F.least("n", F.lit(per_bin))).alias("balanced")).withColumn("reached", F.col("balanced") >= quota)


def chosen_tau(ladder: DataFrame) -> DataFrame:
    """(category, tau): the highest threshold that reaches the quota, else the lowest that keeps anything."""
    return ladder.groupBy("category").agg(F.coalesce(F.max(F.when(F.col("reached"), F.col("tau"))), F.min("tau")).alias("tau"))


def backfilled(df: DataFrame, per_bin: int, quota: int, whole_ranking: bool = False) -> DataFrame:
    """Per category the balanced set at its threshold, filled up to ``quota`` with the next best rows.

    ``df``: category, prompt_id, p_sem, s_score, pos, bin_id. Adds priority
    (0 balanced, the best ``quota`` of them; 1 filled in) and rank within the
    category; both rankings are cut off in each task before the shuffle.
    ``whole_ranking`` gives all rows, with their priority and without a rank,
    for steps that may refuse some. The thresholds are one row per category.
    """
    tau = chosen_tau(tau_ladder(df, per_bin, quota))
    gated = df.join(small(tau), "category").where(F.col("p_sem") >= F.col("tau")).select("category", "bin_id", "prompt_id", "s_score", "pos")
    balanced = top_per_bin(gated, per_bin).drop("rank")
    first = ranked(balanced, ["category"], best_first()).where(F.col("rank") <= quota).select("category", "prompt_id", F.lit(0).alias("priority"))
    flagged = df.join(small(first), ["category", "prompt_id"], "left").withColumn("priority", F.coalesce("priority", F.lit(1)))
    return flagged if whole_ranking else ranked(flagged, ["category"], filled_order()).where(F.col("rank") <= quota)


def repetition_capped(df: DataFrame, categories: Sequence[str] = CATEGORIES, most: int = 2, quota: int | None = None, order: Sequence[Column] | None = None) -> DataFrame:
    """Rows admitted so that a word occurs in at most ``most`` categories, categories in order.

    ``df``: category, word and what ``order`` (rank, if not given) reads. Within a category a word
    may repeat, so each category is one anti-join against the words that others
    have used up; five steps, not one per row. Words used so far are cut off
    from the plan after each step. ``quota`` keeps the first rows of each
    category, cut off in each task before the shuffle.
    """
    # Written once: each step would otherwise work the whole table out again.
    df, used, kept = cut_lineage(df), None, []
    for c in categories:
        rows = df.where(F.col("category") == c)
        if used is not None:
            full = used.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most).select("word")
            rows = rows.join(full, "word", "left_anti")
        if quota is not None:
            rows = ranked(rows, ["category"], order or [F.col("rank")], "_q").where(F.col("_q") <= quota).drop("_q")
        kept.append(rows)
        mine = cut_lineage(rows.select("word").distinct())
        used = mine if used is None else used.unionAll(mine)
    return reduce(DataFrame.unionByName, kept)


def word_categories(df: DataFrame) -> DataFrame:
    """(word, categories): the categories in which each word is used, in order."""
    return df.groupBy("word").agg(F.array_sort(F.collect_set("category")).alias("categories"))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "n") -> DataFrame:
    """Running numbers 1, 2, ... per key, however many rows a key has.

    Rows are cut into ranges of (keys, order) and written; each range numbers
    its own rows, and what the ranges before it hold of a key is added.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = cut_lineage(df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("_p", F.spark_partition_id()))
    groups = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    held = cut.groupBy("_p", *groups).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = held.select(F.col("_p").alias("_q"), *[f"_k{i}" for i in range(len(keys))], F.coalesce(before, F.lit(0)).alias("_before"))
    same = [F.col("_p") == F.col("_q"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
    inner = ranked(cut, ["_p", *keys], order, "_i")
    return inner.join(small(offsets), same).withColumn(name, F.col("_i") + F.col("_before")).select(*df.columns, name)


def first_of_each(df: DataFrame, key: str, hashed: Column, id_col: str, most: DataFrame) -> DataFrame:
    """The first ``most`` rows (key, n) of each key in the order of ``hashed`` (32 bits) and id, however many they are.

    Counts by the hash's high bits show in which small part of a key's rows the
    last one lies; only that part is sorted.
    """
    rows = df.withColumn("_h", hashed).withColumn("_b", F.shiftright("_h", 16).cast("int"))
    counts = rows.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_c"))
    above = F.coalesce(F.sum("_c").over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    limits = counts.withColumn("_above", above).join(small(most.select(F.col(key), F.col("n").alias("_n"))), key)
    room = limits.select(F.col(key).alias("_key"), F.col("_b").alias("_bucket"), F.when(F.col("_above") + F.col("_c") <= F.col("_n"), F.col("_c")).otherwise(F.greatest(F.lit(0), F.col("_n") - F.col("_above"))).alias("_room"), "_c")
    room = room.where("_room > 0")
    found = rows.join(room, [F.col(key).eqNullSafe(F.col("_key")), F.col("_b") == F.col("_bucket")])
    whole = found.where("_room = _c")
    partly = ranked(found.where("_room < _c"), ["_key", "_b"], [F.col("_h"), F.col(id_col)], "_i").where("_i <= _room")
    return whole.select(*df.columns).unionByName(partly.select(*df.columns))


def best_per_target(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The best accepted row per target: highest s_score, then the shorter question, then pos."""
    order = [F.col("s_score").desc(), F.length("question_text").asc(), F.col("pos").asc()]
    return ranked(df.where("accepted"), keys, order).where(F.col("rank") == 1).drop("rank")


def round_robin(df: DataFrame, keys: Sequence[str], order: Sequence[Column], styles: int) -> DataFrame:
    """A running style number 0..styles-1 per key."""
    return numbered(df, keys, order, "_n").withColumn("style_no", (F.col("_n") - 1) % styles).drop("_n")


def per_relation_quota(df: DataFrame, key: str, order: Sequence[Column], n: int, domain: Sequence[str]) -> DataFrame:
    """``n`` rows split over the relations of ``domain``: n // k each, the remainder to the first ones."""
    k = len(domain)
    quota = {r: n // k + (1 if i < n % k else 0) for i, r in enumerate(domain)}
    limit = reduce(lambda acc, kv: acc.when(F.col(key) == kv[0], kv[1]), list(quota.items())[1:], F.when(F.col(key) == domain[0], quota[domain[0]]))
    # The largest quota is a literal, by which each task cuts its rows off before the shuffle.
    return ranked(df.where(F.col(key).isin(*domain)), [key], order).where(F.col("rank") <= max(quota.values())).where(F.col("rank") <= limit)


def water_filling(counts: DataFrame, gap: int) -> DataFrame:
    """(relation, added): ``gap`` units given one by one to the least filled relation, ties by its number.

    ``counts``: relation, relation_no, n. The loop's result in one step: of all
    levels n, n+1, ... of all relations the ``gap`` smallest are taken. The
    relations are a fixed short list, and levels are made up to ``gap`` each.
    """
    levels = counts.withColumn("level", F.explode(F.sequence(F.col("n"), F.col("n") + gap - 1))) if gap > 0 else counts.withColumn("level", F.lit(0)).limit(0)
    taken = levels.orderBy("level", "relation_no").limit(max(gap, 0))
    return counts.join(taken.groupBy("relation").agg(F.count(F.lit(1)).alias("added")), "relation", "left").select("relation", F.coalesce("added", F.lit(0)).alias("added"))


def jointly_capped(df: DataFrame, group: str, caps: dict[str, int], order: Sequence[str], schema: str) -> DataFrame:
    """Rows admitted in order while every cap column's value has been admitted less often than its cap.

    A refused row advances no counter, so this depends on order and is no
    window. Each group is walked through in Arrow batches sorted by the order
    columns; only the counters are held.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, dict] = {}
        current = object()
        for d in batches:
            keep = []
            for row in d.to_dict("records"):
                if row[group] != current:
                    current, seen = row[group], {c: {} for c in caps}
                ok = all(seen[c].get(row[c], 0) < cap for c, cap in caps.items())
                if ok:
                    for c in caps:
                        seen[c][row[c]] = seen[c].get(row[c], 0) + 1
                keep.append(ok)
            yield d[keep][names]

    return df.repartition(F.col(group)).sortWithinPartitions(group, *order).mapInPandas(run, schema)


def fixed_batches(df: DataFrame, order: Sequence[Column], size: int, keys: Sequence[str] = ()) -> DataFrame:
    """Batch numbers of ``size`` rows each, in order."""
    return numbered(df, list(keys), order, "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n")


def grouped_tasks(df: DataFrame, measure: str, order: Sequence[Column], size: int) -> DataFrame:
    """Batch numbers of ``size`` tasks of the same measure (input length, number of missing samples)."""
    return fixed_batches(df, order, size, [measure])


def head(df: DataFrame, position: str, n: int) -> DataFrame:
    """The first ``n`` rows by their position."""
    return df.orderBy(position).limit(n)


def budget_batches(df: DataFrame, group: str, order: str, cost: str, size: int, budget: int, schema: str) -> DataFrame:
    """Batch numbers per group, closed before the row that would exceed ``size`` rows or ``budget`` in ``cost``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, batch, rows, used = object(), 0, 0, 0
        for d in batches:
            numbers = []
            for g, c in zip(d[group], d[cost], strict=True):
                if g != current:
                    current, batch, rows, used = g, 0, 0, 0
                if rows and (rows >= size or used + c > budget):
                    batch, rows, used = batch + 1, 0, 0
                rows, used = rows + 1, used + c
                numbers.append(batch)
            yield d.assign(batch=numbers)

    return df.repartition(F.col(group)).sortWithinPartitions(group, order).mapInPandas(run, schema)


def leak_reasons(df: DataFrame) -> DataFrame:
    """``df`` with the first reason against a candidate, null if it is kept: nonalpha, whole word, letters only."""
    q, t = F.coalesce("question_text", F.lit("")), F.coalesce("target_word", F.lit(""))
    reason = (
        F.when(~t.rlike(r"^\p{L}+$"), "nonalpha_target")
        .when(text.word_present(t, q), "whole_word_leak")
        .when(F.contains(text.letters_only(q), F.lower(t)), "stripped_leak")
    )
    return df.withColumn("reason", reason)


def balanced_subset(df: DataFrame, outcome: str, id_col: str, seed: int = 42) -> DataFrame:
    """All successes and as many failures, those first in hashed order."""
    sizes = df.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"))
    least = sizes.agg(F.min("n").alias("least"))
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col))), 1, 8), 16, 10).cast("bigint")
    wanted = sizes.select(outcome, F.when(F.col(outcome) == "success", F.col("n")).otherwise(least.scalar()).alias("n"))
    return first_of_each(df, outcome, hashed, id_col, wanted)


def subset_size(subset: DataFrame, outcome: str = "outcome") -> DataFrame:
    """(n, n_failures) of a subset."""
    return subset.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(outcome) == "failure").alias("n_failures"))
