"""Queries of the training-data operators over the project's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnspark.functions.names import name_key
from kilnspark.llm import confusables, leakage, merkle, mixing, pairs, quality, sampling, topn, truncation
from kilnspark.session import cut_lineage, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# Problem 1: duplicates hidden by formatting

CANDIDATE_TREE = {"question_text": "text", "target_word_normalized": "leaf"}
_LEAF_SQL = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')".format
_FIELD = r"(\pL[\pL\pN]*(?:[ _-][\pL\pN]+){0,2}(?:[\s\x{a0}]*(?:[:=]|[\s\x{a0}][\-\x{2013}\x{2014}]+[\s\x{a0}])))"
_FORMS_SQL = rf"""
with marked as (
  select cand_id, question_text q, target_word_normalized t,
         regexp_replace(question_text, '(?:\||;|//|\n|\r)[\s\x{{a0}}]*{_FIELD}', chr(1) || '\1', 'g') m
  from candidates
  where regexp_matches(question_text, '[\pL\pN]') and regexp_matches(target_word_normalized, '[\pL\pN]')
), forms as (
  select cand_id, {_LEAF_SQL('t')} t,
         case when instr(m, chr(1)) > 0 and regexp_matches(m, '^[\s\x{{a0}}]*{_FIELD}')
              then '[' || array_to_string(list_sort(list_transform(string_split(m, chr(1)), lambda p:
                     {_LEAF_SQL(f"regexp_extract(p, '^[\\s\\x{{a0}}]*{_FIELD}', 1)")} || '=' ||
                     {_LEAF_SQL(f"regexp_replace(p, '^[\\s\\x{{a0}}]*{_FIELD}', '')")})), ',') || ']'
              else {_LEAF_SQL('q')} end f
  from marked
)"""


@_query(_FORMS_SQL + " select min(cand_id) over (partition by f, t) first_id, cand_id copy_id from forms qualify cand_id <> min(cand_id) over (partition by f, t)")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate that is a copy of an earlier one, with the first of its class."""
    return merkle.copies(table(spark, sf_dir, "candidates"), "cand_id", CANDIDATE_TREE)


@_query(_FORMS_SQL + " select min(cand_id) first_id, count(*) n_copies from forms group by f, t")
def p1_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct candidate once, with its number of records."""
    return merkle.collapse(table(spark, sf_dir, "candidates"), "cand_id", CANDIDATE_TREE)


# Problem 2: broken prompt and response pairs


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.answers_of(table(spark, sf_dir, "completions_greedy"), table(spark, sf_dir, "prompts"))


@_query()
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each defective answer with its type of defect, one row per defect."""
    return pairs.defects(cut_lineage(_answers(spark, sf_dir))).select(F.col("id").alias("row_id"), "defect_type")


# Problem 4: text cut off by field limits


@_query()
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions whose text was cut."""
    return truncation.cut_posteriors(_answers(spark, sf_dir)).where("cut > 0.5").select(F.col("id").alias("row_id"))


@_query()
def p4_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut rows per export_source."""
    return truncation.source_rates(truncation.cut_posteriors(_answers(spark, sf_dir)))


# Problem 5: visually identical text


def _completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "completions_greedy").select("row_id", "completion_text", "target_word")


@_query()
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions in which a reader sees the target while the stored characters don't hold it."""
    return confusables.seen_but_not_stored(_completions(spark, sf_dir), "completion_text", "target_word").select("row_id")


@_query()
def p5_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All completions and targets in their consistent form."""
    forms = {c: confusables.consistent_form(F.col(c)) for c in ("completion_text", "target_word")}
    return _completions(spark, sf_dir).withColumns(forms)


# Problem 3: top three of every group

_TOP_SQL = r"""
with named as (
  select val_id, prompt_id, source_trace, s_score,
         nullif(regexp_replace(regexp_replace(lower(category), '[\s\x{a0}_\-]+', '_', 'g'), '^_+|_+$', '', 'g'), '') cat
  from validated
), once as (select * from named qualify prompt_id is null or val_id = min(val_id) over (partition by prompt_id)),
ranked as (
  select *, row_number() over (partition by cat, source_trace order by s_score desc, val_id) r
  from once where cat is not null and s_score is not null and not isnan(s_score)
)"""


def _best_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "validated")
    rows = v.select("val_id", "prompt_id", name_key(v["category"]).alias("cat"), "source_trace", "s_score")
    once = topn.one_per_key(rows, "prompt_id", "val_id", ["cat", "source_trace", "s_score"])
    # Written once: counts, ranges and both ways of ranking read these rows.
    return topn.top_n(cut_lineage(once.where("cat is not null")), ["cat", "source_trace"], "s_score", "val_id", 3)


@_query(_TOP_SQL + " select val_id from ranked where r <= 3")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best prompts of every category and source_trace."""
    return _best_prompts(spark, sf_dir).select("val_id")


@_query(_TOP_SQL + ' select cat category, source_trace, s_score, val_id, r "rank" from ranked where r <= 3')
def p3_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with group, score and rank."""
    return _best_prompts(spark, sf_dir).select(F.col("cat").alias("category"), "source_trace", "s_score", "val_id", "rank")


# Problem 6: sample matching target proportions

_CELLS_SQL = r"""
with cells as (
  select distinct prompt_id,
         nullif(regexp_replace(regexp_replace(lower(category), '[\s\x{a0}_\-]+', '_', 'g'), '^_+|_+$', '', 'g'), '') cat,
         array_to_string(list_transform(regexp_extract_all(p0_bin, '\d+\.\d+'), lambda x: format('{:.1f}', x::double)), '-') b
  from prompts where category is not null and p0_bin is not null
), have as (select cat, b, count(*) have from cells where cat is not null and b <> '' group by 1, 2),
asked as (
  select category, p0_bin, greatest(min_rows, floor(target_share::decimal(18, 8) * sample_size + 0.5))::bigint required, coalesce(have, 0) available
  from sample_targets left join have on cat = category and b = p0_bin
)"""


@_query(_CELLS_SQL + " select category, p0_bin from asked where available < required")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target cells that stay below what is required in the sample because prompts hold no more."""
    reached = sampling.shares_reached(table(spark, sf_dir, "prompts"), table(spark, sf_dir, "sample_targets"))
    return reached.where("unmet").select("category", "p0_bin")


@_query()
def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample itself."""
    return sampling.sample(table(spark, sf_dir, "prompts"), table(spark, sf_dir, "sample_targets")).withColumnRenamed("unit", "prompt_id")


@_query()
def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target cells with what was asked, held, drawn and reached."""
    return sampling.shares_reached(table(spark, sf_dir, "prompts"), table(spark, sf_dir, "sample_targets"))


# Problem 7: evaluation texts in the corpus


@_query()
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the evaluation items they hold."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@_query()
def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold passages, without them."""
    return leakage.cleaned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


# Problem 8: mixing sources to target weights


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.token_counts(spread(docs)).drop("text")


@_query()
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that stay below their share in the mixture even when repeated as often as allowed."""
    return mixing.shares(cut_lineage(_sized(spark, sf_dir)), table(spark, sf_dir, "mix_targets")).where("unmet").select("source")


@_query()
def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: every copy of every document, in its global order."""
    return mixing.mix(cut_lineage(_sized(spark, sf_dir)), table(spark, sf_dir, "mix_targets"))


@_query()
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares of the sources."""
    return mixing.shares(cut_lineage(_sized(spark, sf_dir)), table(spark, sf_dir, "mix_targets"))


# Problem 9: text quality statistics


@_query()
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents most of whose text isn't prose, with their kind."""
    kinds = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lexicon"))
    return kinds.where("doc_kind <> 'prose'").select("doc_id", "doc_kind")


@_query()
def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, shares of the kinds of text and kind of every document."""
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lexicon"))
