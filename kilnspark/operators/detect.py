"""Detection of a word in completions and its mapping to token spans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.functions import text
from kilnspark.functions.text import find_spans

#: Longest token span that is tried when the smallest cover doesn't hold the word.
MOST_TOKENS = 8


def token_offsets(tokens: list[str]) -> list[tuple[int, int]]:
    """Running (start, end) of tokens whose texts follow one another."""
    out, at = [], 0
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def _holds(tokens: list[str], offsets: list[tuple[int, int]], a: int, b: int, match: tuple[int, int], word: str) -> bool:
    """Whether tokens a..b cover the match, which is the word and stands whole, and hold its text."""
    if not (0 <= a <= b < len(tokens)) or not (offsets[a][0] <= match[0] and offsets[b][1] >= match[1]):
        return False
    whole = "".join(tokens)
    if (match[0] > 0 and whole[match[0] - 1].isalnum()) or (match[1] < len(whole) and whole[match[1]].isalnum()):
        return False
    shown = whole[match[0] : match[1]].lower()
    return shown == word.lower() and shown in "".join(tokens[a : b + 1]).lower()


def simple_match(offsets: list[tuple[int, int]], match: tuple[int, int]) -> tuple[int, int, int, int] | None:
    """(first token, last token, start, end) of the tokens that overlap a match, unverified; None if none does."""
    hit = [i for i, (s, e) in enumerate(offsets) if e > match[0] and s < match[1]]
    return (hit[0], hit[-1], *match) if hit else None


def map_match(tokens: list[str], offsets: list[tuple[int, int]], match: tuple[int, int], word: str) -> tuple[int, int] | None:
    """Token span (end inclusive) of a match: smallest cover, then one token wider, then the shortest leftmost that holds it.

    ``offsets`` may be those of a tokenizer and differ from the tokens' joined
    text; then wider spans are tried.
    """
    if (hit := simple_match(offsets, match)) is None:
        return None
    a, b = hit[:2]
    for x, y in ((a, b), (a - 1, b), (a - 1, b + 1), (a, b), (a, b + 1)):
        if _holds(tokens, offsets, x, y, match, word):
            return x, y
    for n in range(1, min(MOST_TOKENS, len(tokens)) + 1):
        for x in range(len(tokens) - n + 1):
            if _holds(tokens, offsets, x, x + n - 1, match, word):
                return x, x + n - 1
    return None


def detections(completions: DataFrame) -> DataFrame:
    """``completions`` (text, tokens, target_word) with word_present, token_spans, pre_target_token_indices, mapping_error, format_adherence.

    Matches are sought in the joined tokens; without tokens in the text, as a
    mapping error. Spans end with their last token. Null texts hold nothing.
    """

    @F.pandas_udf("struct<word_present:boolean,token_spans:array<struct<start:int,end:int>>,pre_target_token_indices:array<int>,mapping_error:boolean>")
    def mapped(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, token_lists, words in parts:
            rows = []
            for t, tokens, word in zip(texts, token_lists, words, strict=True):
                tokens = [] if tokens is None else list(tokens)
                if not tokens:
                    rows.append((False, [], [], t is not None))
                    continue
                joined, offsets = "".join(tokens), token_offsets(tokens)
                matches = find_spans(word, joined)
                spans = [map_match(tokens, offsets, m, word) for m in matches]
                found = [s for s in spans if s is not None]
                wrong = len(found) != len(spans) or (t is not None and len(matches) != len(find_spans(word, t)))
                rows.append((bool(matches), [{"start": a, "end": b} for a, b in found], [a - 1 if a > 0 else None for a, _ in found], wrong))
            yield pd.DataFrame(rows, columns=["word_present", "token_spans", "pre_target_token_indices", "mapping_error"])

    d = completions.withColumn("_d", mapped("text", "tokens", "target_word"))
    adherent = text.word_count_is_one(text.normalize_text(F.col("text")))
    return d.select(*completions.columns, "_d.*", adherent.alias("format_adherence"))


#: The first line of every prompt, and the phrases around a forbidden word (fixed values).
FIRST_LINE, NEGATION, BEFORE_TARGET, BEHIND_TARGET = "Answer with exactly one English word.", "Do not use", 'Do not use the word "', '" anywhere in your answer.'


def prompt_spans(prompt: Column, target: Column, condition: Column) -> Column:
    """struct of (start, end) of instruction, negation, target mention and question in a prompt; null where there is none.

    The instruction is the first line in the baseline and the whole prohibition
    in the negative condition; where that line isn't worded as usual, the line
    from ``Do not use`` on. The target is sought in quotes within it. The
    question ends at the first ``Answer:`` line behind it, else with the prompt.
    """
    locate = lambda needle, start: F.call_function("locate", needle, prompt, start)
    some = lambda start, end: F.struct((start - 1).cast("int").alias("start"), (end - 1).cast("int").alias("end"))
    mark = "Question: "
    asked = F.instr(prompt, F.lit(mark))
    ended = locate(F.lit("\nAnswer:"), asked + len(mark))
    question = F.when(asked > 0, some(asked + len(mark), F.when(ended > 0, ended).otherwise(F.length(prompt) + 1)))
    first = F.instr(prompt, F.lit(FIRST_LINE))
    line = F.concat(F.lit(BEFORE_TARGET), target, F.lit(BEHIND_TARGET))
    exact, loose = F.coalesce(locate(line, F.lit(1)), F.lit(0)), F.instr(prompt, F.lit(NEGATION))
    begin = F.when(exact > 0, exact).otherwise(loose)
    newline = locate(F.lit("\n"), begin)
    end = F.when(exact > 0, exact + F.length(line)).when(newline > 0, newline).otherwise(F.length(prompt) + 1)
    mention = locate(F.concat(F.lit('"'), target, F.lit('"')), begin)
    negative = (condition == "negative") & (begin > 0)
    return F.struct(
        F.when((condition == "baseline") & (first > 0), some(first, first + len(FIRST_LINE))).when(negative, some(begin, end)).alias("instruction"),
        F.when(negative, some(begin, begin + len(NEGATION))).alias("negation"),
        F.when(negative & (mention > 0) & (mention < end), some(mention + 1, mention + 1 + F.length(target))).alias("target_mention"),
        question.alias("question"),
    )
