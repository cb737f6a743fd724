"""Table functions for SQL: ``surface_variants(word)`` and ``word_spans(word, text)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kilnspark.functions.text import find_spans


class SurfaceVariants:
    """Each surface variant of a word, once, in the order of :func:`kilnspark.functions.text.surface_variants`."""

    def eval(self, word: str) -> Iterator[tuple[str]]:
        if not word:
            return
        seen = dict.fromkeys(
            x
            for c in dict.fromkeys((word, word.lower(), word[:1].upper() + word[1:].lower(), word.upper()))
            for f in (c, f" {c}", f"{c} ", f" {c} ")
            for x in (f, f.rstrip(" ") + ".", f.rstrip(" ") + ". ")
        )
        for v in seen:
            yield (v,)


class WordSpans:
    """Each whole-word occurrence as (start, end), end exclusive."""

    def eval(self, word: str, text: str) -> Iterator[tuple[int, int]]:
        yield from find_spans(word, text)


def register(spark: SparkSession) -> None:
    """Make both known to a session's SQL."""
    spark.udtf.register("surface_variants", F.udtf(SurfaceVariants, returnType="variant_text string"))
    spark.udtf.register("word_spans", F.udtf(WordSpans, returnType="span_start int, span_end int"))
