"""Candidate prompts from idioms, facts, common-sense relations and model answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.functions import text
from kilnspark.operators import select, stats

#: Idiom templates by style (fixed values).
IDIOM_TEMPLATES = {"I1": 'Complete the idiom with one word: "{idiom_with_blank}"'}
#: Styles and question per fact relation (fixed values).
FACTS = {
    "capital": (("F1", "F2"), "Fill the blank with one word: The capital of {subject} is ____."),
    "currency": (("F3",), "Complete with one word: The currency of {subject} is ____."),
    "language": (("F4",), "One-word answer: An official language of {subject} is ____."),
    "continent": (("F5",), "Fill the blank (one word): {subject} is in ____."),
    "occupation": (("F12",), "Fill the blank (one word): A one-word occupation associated with {subject} is ____."),
    "demonym": (("F13",), "Fill the blank (one word): A demonym for {subject} is ____."),
    "birth_month": (("F14",), "Fill the blank (one word): {subject} was born in the month of ____."),
    "national_sport": (("F15",), "Fill the blank (one word): The national sport of {subject} is ____."),
}
#: Question and style of any other fact relation (fixed values).
OTHER_FACT = (("F1",), "Fill the blank with one word: {subject} is ____.")
MARKS = ".,!?;:\"'-"
COLUMNS = ("category", "question_text", "target_word", "target_word_normalized", "prompt_style_id", "source_trace", "raw_data")


def pick(choices: Sequence[str], key: Column, seed: int) -> Column:
    """One of ``choices`` by a seeded hash of ``key``."""
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (F.pmod(stats.hashed_order(key, seed), F.lit(len(choices))) + 1).cast("int"))


def _filled(template: Column, slot: str, value: Column) -> Column:
    return F.replace(template, F.lit("{" + slot + "}"), value)


def _candidates(df: DataFrame, category: str, question: Column, target: Column, style: Column, trace: Column, raw: Column) -> DataFrame:
    """Candidate rows of those whose target isn't given away by the question."""
    rows = df.select(F.lit(category).alias("category"), question.alias("question_text"), target.alias("target_word"), F.lower(target).alias("target_word_normalized"), style.alias("prompt_style_id"), trace.alias("source_trace"), F.to_json(raw).alias("raw_data"))
    return select.leak_reasons(rows).where("reason is null or reason = 'nonalpha_target'").drop("reason")


def idioms(df: DataFrame, n: int, templates: dict[str, str] | None = None, seed: int = 42) -> DataFrame:
    """Candidates of ``n`` idioms (idiom, meaning): the last word is asked for."""
    templates = templates or IDIOM_TEMPLATES
    drawn = stats.sample_n(df, "idiom", n, seed)
    style = pick(sorted(templates), F.col("idiom"), seed + 1)
    template = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(templates.items()) for x in kv]), style)
    return _candidates(drawn, "idioms", _filled(template, "idiom_with_blank", text.blanked_last(F.col("idiom"))), text.last_word(F.col("idiom")), style, F.concat(F.lit("idiom:"), "idiom"), F.struct("idiom", "meaning"))


def facts(df: DataFrame, n: int, relations: Sequence[str], seed: int = 42) -> DataFrame:
    """Candidates of ``n`` facts (source, relation, subject, target), split over ``relations``, styles in turn within each.

    Facts without a subject or a proper target take a place in their relation's quota but become no candidate.
    """
    keyed = df.withColumn("_id", F.concat_ws("|", "source", "relation", "subject", "target"))
    drawn = select.per_relation_quota(keyed, "relation", [stats.hashed_order(F.col("_id"), seed), F.col("_id")], n, relations)
    clean = drawn.withColumns({"subject": F.trim(text.subject_key(F.col("subject"))), "target": F.trim("target")})
    valid = clean.where((F.col("subject") != "") & text.valid_target(F.col("target")))
    # At most n rows are left, a quota per relation.
    turned = select.ranked(valid, ["relation"], [F.col("rank")], "_turn")
    of = lambda i: F.element_at(F.create_map(*[x for r in relations for x in (F.lit(r), i(FACTS.get(r, OTHER_FACT)))]), F.col("relation"))
    styles = of(lambda f: F.array(*[F.lit(s) for s in f[0]]))
    style = F.element_at(styles, ((F.col("_turn") - 1) % F.size(styles) + 1).cast("int"))
    question = _filled(of(lambda f: F.lit(f[1])), "subject", F.col("subject"))
    return _candidates(turned, "facts", question, F.col("target"), style, text.source_trace(F.col("source"), F.col("relation"), F.col("subject")), F.struct("subject", "relation", "target", "source"))


def common_sense(df: DataFrame, n: int, relations: Sequence[str] = ("UsedFor", "MadeOf", "HasProperty"), seed: int = 42) -> DataFrame:
    """Candidates of ``n // 3`` edges (relation, subject, target) of each relation."""
    keyed = df.withColumn("_id", F.concat_ws("|", "relation", "subject", "target"))
    each = n // len(relations)
    drawn = select.ranked(keyed.where(F.col("relation").isin(*relations)), ["relation"], [stats.hashed_order(F.col("_id"), seed), F.col("_id")]).where(F.col("rank") <= each)
    made = drawn.where(text.valid_target(F.col("target"))).withColumn("_q", text.relation_question(F.col("subject"), F.col("relation")))
    return _candidates(made, "common_sense", F.col("_q.question"), F.col("target"), F.col("_q.style"), text.source_trace(F.lit("conceptnet"), F.col("relation"), F.col("subject")), F.struct("subject", "relation", "target"))


def _answers(responses: DataFrame, field: str) -> DataFrame:
    """A row per prompt in each answer (target, idx, answer): its place, its text and its style; those without a text, or that name the target, are left out."""
    parsed = responses.withColumn("_v", F.try_parse_json(text.first_json(F.col("answer"))))
    listed = parsed.select("target", "idx", F.posexplode(F.try_variant_get("_v", "$.prompts", "array<variant>")).alias("place", "p"))
    shown = listed.select(
        "target",
        "idx",
        "place",
        F.trim(F.coalesce(F.when(F.schema_of_variant("p") == "STRING", F.try_variant_get("p", "$", "string")), F.try_variant_get("p", f"$.{field}", "string"))).alias("text"),
        F.nullif(F.when(F.schema_of_variant("p") != "STRING", F.try_variant_get("p", "$.style", "string")), F.lit("")).alias("style"),
    )
    leaks = select.leak_reasons(shown.where("text <> ''").withColumns({"question_text": F.col("text"), "target_word": F.col("target")}))
    return leaks.where("reason is null or reason = 'nonalpha_target'").drop("reason", "question_text", "target_word")


#: Question around a microstory, and around a strange context by style (fixed values).
CREATIVE_TEMPLATE = "Fill the blank with one word: {microstory} ____."
OOD_TEMPLATE = "Fill the blank with one word: ____."


def creative(responses: DataFrame) -> DataFrame:
    """Candidates from answers (target, idx, answer) that list microstories."""
    rows = _answers(responses, "microstory").withColumn("story", F.rtrim(F.col("text"), F.lit(".!?")))
    return _candidates(rows, "creative", _filled(F.lit(CREATIVE_TEMPLATE), "microstory", F.col("story")), F.col("target"), F.concat(F.lit("creative_"), "place"), F.concat(F.lit("gpt5:creative:"), "target"), F.struct(F.col("story").alias("microstory"), "target"))


def out_of_distribution(responses: DataFrame, n: int, default_style: str = "surreal") -> DataFrame:
    """At most ``n`` candidates from answers that list strange contexts, in the order of target, answer and place."""
    rows = _answers(responses, "context").withColumn("style", F.coalesce("style", F.lit(default_style))).orderBy("target", "idx", "place").limit(n)
    question = text.splice_context(F.col("text"), OOD_TEMPLATE)
    return _candidates(rows, "ood", question, F.col("target"), F.concat_ws("_", F.lit("ood"), "style", "idx", "place"), F.concat(F.lit("gpt5:ood:"), "target"), F.struct(F.col("text").alias("context"), "target", "style"))
