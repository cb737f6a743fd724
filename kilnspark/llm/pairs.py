"""Broken prompt and response pairs: empty, truncated, refusing, copying and foreign answers.

The languages of prompt and response are posteriors of the naive Bayes model of
:mod:`kilnspark.llm.languages`, refusals the sentences of
:mod:`kilnspark.llm.refusals`, truncation the posterior of
:mod:`kilnspark.llm.truncation`. All comparisons are made on consistent forms,
so that look-alike letters don't pass for another language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnspark.llm import confusables, languages, refusals, truncation
from kilnspark.llm.confusables import consistent
from kilnspark.llm.truncation import bare, prompt_letters

#: Words that stand for a missing value when they are all of an answer (fixed values).
STAND_INS = frozenset(
    "null none nil nan na undefined empty blank missing nooutput noanswer noresponse nocompletion notext nodata novalue "
    "notavailable notapplicable emptystring emptyanswer emptyresponse emptyoutput missingvalue unavailable tbd".split()
)
_BRACKETED = re.compile(r"^\W*[\[(<{].*[\])>}]\W*$", re.S)
#: Of the stand-ins, those that may be an answer unless they are bracketed.
_MAYBE_WORDS = frozenset(("blank", "empty", "missing", "none", "unavailable"))


def is_empty(text: str | None) -> bool:
    """No answer, or only a stand-in for a missing value."""
    letters = bare(text)
    if not letters:
        return True
    return letters in STAND_INS and (letters not in _MAYBE_WORDS or bool(_BRACKETED.match(text)) or letters == "none")


_WORDS = re.compile(r"[^\W_]+")


@lru_cache(maxsize=4096)
def _words_in_order(text: str) -> list[str]:
    return _WORDS.findall(consistent(text).lower())


def is_copy(text: str, question: str | None, asked: str | None) -> bool:
    """Only the question, most of it or the prompt, with the blank left open."""
    if not question:
        return False
    letters, q, blank = bare(text), prompt_letters(question), "__" in text
    if len(letters) < 12 or (not blank and len(letters) < 0.45 * len(q)):
        return False
    if letters in prompt_letters(asked or ""):
        return True
    if not blank:
        return False
    # Words in the order of the prompt, with hardly any of its own.
    mine = _WORDS.findall(consistent(text).lower())
    same = sum(b.size for b in SequenceMatcher(None, mine, _words_in_order(asked or ""), autojunk=False).get_matching_blocks())
    return same >= 0.85 * len(mine)


def defects(answers: DataFrame, cut_threshold: float = 0.5) -> DataFrame:
    """(id, defect_type) for each defect of each answer; ``answers`` has id, src, text, question, asked.

    A null text is empty. An empty answer has no other defect; a copy is no
    refusal and no other language. Answers without a known prompt can't be copies.
    """
    spark = answers.sparkSession
    alike = confusables.shared(spark)
    held = spark.sparkContext.broadcast((languages.fit_answers(answers), refusals.model()))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        confusables.use(alike.value)
        spoken, declining = held.value
        for d in parts:
            out = []
            for i, text, question, asked in zip(d["id"], d["text"], d["question"], d["asked"], strict=True):
                if is_empty(text):
                    out.append((i, "empty"))
                    continue
                if is_copy(text, question, asked):
                    out.append((i, "copy"))
                    continue
                form = consistent(text)
                if declining.is_refusal(form):
                    out.append((i, "refusal"))
                if languages.is_foreign(spoken, form, question):
                    out.append((i, "other_language"))
            yield pd.DataFrame(out, columns=["id", "defect_type"])

    # Ids go through Python as text, as a null among them would turn whole numbers into floats.
    read = answers.select(F.col("id").cast("string").alias("id"), "text", "question", "asked")
    found = read.mapInPandas(run, "id string, defect_type string").select(F.col("id").cast(answers.schema["id"].dataType).alias("id"), "defect_type")
    cut = truncation.cut_posteriors(answers).where(F.col("cut") > cut_threshold).select("id", F.lit("truncated").alias("defect_type"))
    return found.unionByName(cut)
