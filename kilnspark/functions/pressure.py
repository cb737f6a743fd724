"""Pressure, suppression and judge scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BINS = 5
#: Rubric limits of the judge (fixed values).
MAX_AMBIGUITY, MIN_NATURALNESS = 3, 7


def number_or_null(c: Column) -> Column:
    """NaN as null, so that means leave it out."""
    return F.when(~F.isnan(c), c)


def clamp(c: Column) -> Column:
    """A probability held within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def bin_id(p: Column) -> Column:
    """Bin 0..4 of a probability; the last bin is closed."""
    return F.least(F.floor(clamp(p) * BINS).cast("int"), F.lit(BINS - 1))


def bin_label(i: Column) -> Column:
    """``0.2-0.4`` and so on."""
    return F.format_string("%.1f-%.1f", i / float(BINS), (i + 1) / float(BINS))


def bin_lower(label: Column) -> Column:
    """Lower bound of any notation of a bin; infinity where there is none."""
    return F.coalesce(F.regexp_extract(label, r"(?:^|[\[=])\s*(\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(float("inf")))


def bin_center(label: Column) -> Column:
    """Centre of any notation of a bin; 0.5 where there is none."""
    pair = r"(\d+(?:\.\d+)?)\s*(?:,|-|–|to)\s*(\d+(?:\.\d+)?)"
    lo, hi = F.regexp_extract(label, pair, 1).try_cast("double"), F.regexp_extract(label, pair, 2).try_cast("double")
    return F.coalesce((lo + hi) / 2, F.lit(0.5))


def suppression(p0: Column, p1: Column) -> tuple[Column, Column, Column]:
    """(delta, relative, log) of pressure without and with the rule."""
    delta = p0 - p1
    floor = F.lit(1e-12)
    return delta, delta / F.greatest(p0, F.lit(1e-9)), F.log(F.greatest(p0, floor)) - F.log(F.greatest(p1, floor))


def judge_score(v: Column, target: Column) -> Column:
    """Rubric score of a validation struct; null validation scores null, missing flags count as false."""
    flag = lambda n: F.coalesce(v[n], F.lit(False))
    ambiguity, natural = F.coalesce(v["ambiguity_score"], F.lit(10)), F.coalesce(v["naturalness_score"], F.lit(0))
    others = F.size(F.filter(F.coalesce(v["top3_one_word_answers"], F.array().cast("array<string>")), lambda w: F.lower(w) != F.lower(target)))
    failed = flag("leaks_answer") | ~flag("is_one_word_answer_enforced") | (ambiguity > MAX_AMBIGUITY) | (natural < MIN_NATURALNESS)
    points = (
        F.when(flag("is_X_best"), 40).otherwise(0)
        + F.when(others == 0, 30).when((others == 1) & (ambiguity <= 2), 15).otherwise(0)
        + F.lit(20)
        + F.lit(10)
    )
    return F.when(v.isNotNull(), F.when(failed, 0).otherwise(points))


def accepted(v: Column, target: Column) -> Column:
    """All rules of acceptance at once; false for a null validation."""
    flag = lambda n: F.coalesce(v[n], F.lit(False))
    return F.coalesce(
        flag("is_X_best")
        & (F.coalesce(v["ambiguity_score"], F.lit(10)) <= MAX_AMBIGUITY)
        & ~flag("leaks_answer")
        & flag("is_one_word_answer_enforced")
        & (F.coalesce(v["naturalness_score"], F.lit(0)) >= MIN_NATURALNESS)
        & (F.lower(v["best_one_word_answer"]) == F.lower(target)),
        F.lit(False),
    )


def selection_score(v_score: Column, p_sem: Column) -> Column:
    """Judge score plus a hundred times the pressure."""
    return v_score + 100 * p_sem
