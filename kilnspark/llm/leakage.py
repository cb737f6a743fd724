"""Held-out passages in a corpus: documents that hold them, the items they hold, and their removal.

Words are read as a reader would, each with its place in the stored text. A
broadcast set of the items' word n-grams finds candidate spans; a span counts
if twenty or more words of an item stand there in a row with at most one word
in eight changed, dropped or added.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnspark.llm import confusables
from kilnspark.llm.confusables import consistent
from kilnspark.session import spread

#: Least words of an item in a row, and of how many words one may differ.
LEAST, PER_ERROR = 20, 8
#: Words in a row that make a candidate.
GRAM = 4
#: n-grams that a passage has left at least when every error spoils as many as it can.
HITS = LEAST - GRAM + 1 - GRAM * (LEAST // PER_ERROR)
#: Characters of items up to which their n-grams are broadcast; beyond it the items are taken in blocks of this size.
BLOCK_CHARS = 20_000_000
_HIDE = re.compile(r"<[/!]?[A-Za-z][^<>\n]{0,200}>|&(?:#\d{1,7}|#x[0-9A-Fa-f]{1,6}|[A-Za-z]{2,10});|\\u[0-9A-Fa-f]{4}|\\[A-Za-z]{3,16}(?=\{)|\\[nrt\"/\\]")
#: Marks inside a word that a reader doesn't see or reads over: accents, invisible marks, apostrophes, hyphens, and a hyphen at a line's end.
_JOIN = "(?:[\\u0300-\\u036f\\u00ad\\u034f\\u200b-\\u200f\\u2060-\\u2064\\ufeff'\\u2018\\u2019\\u02bc]|[-\\u2010\\u2011](?:[ \\t]*\\r?\\n[> \\t|*#]*)?)+"
_WORD = re.compile(rf"[^\W_]+(?:{_JOIN}[^\W_]+)*[\u0300-\u036f]*")
_NOISE = re.compile(r"[\W_]+")


def read_words(text: str) -> tuple[list[str], list[int], list[int]]:
    """Words as read, with where each begins and ends in ``text``. Tags, entities and escapes are no words."""
    shown = _HIDE.sub(lambda m: " " * len(m[0]), text)
    words, begin, end = [], [], []
    for m in _WORD.finditer(shown):
        w = m[0]
        if not (w.isascii() and w.isalnum()):
            w = _NOISE.sub("", consistent(w))
        words.append(w.lower())
        begin.append(m.start())
        end.append(m.end())
    return words, begin, end


def only_words(text: str) -> list[str]:
    """The words of :func:`read_words` without their places, which most documents need not tell."""
    if not text.isascii():
        return read_words(text)[0]
    shown = _HIDE.sub(" ", text) if any(mark in text for mark in "<&\\") else text
    return [w if w.isalnum() else _NOISE.sub("", w) for w in _WORD.findall(shown.lower())]


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))


def gram_hashes(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of GRAM words in a row, by their ids; a collision only costs a look."""
    h = np.zeros(max(0, len(words) - GRAM + 1), np.uint64)
    for i in range(GRAM):
        h += (words[i : i + len(h)].astype(np.uint64) + np.uint64(1)) * _MIX[i % len(_MIX)]
        h ^= h >> np.uint64(29)
    return h


class Passages:
    """Items as word ids, with their n-grams as sorted hashes and arrays of where they stand; bounded by BLOCK_CHARS, at about twenty bytes a word."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        hashes, owner, place = [], [], []
        for item, text in items:
            words = [self.ids.setdefault(w, len(self.ids)) for w in read_words(text or "")[0]]
            if len(words) < LEAST:
                continue
            h = gram_hashes(np.array(words, np.int64))
            hashes.append(h)
            owner.append(np.full(len(h), len(self.items), np.int32))
            place.append(np.arange(len(h), dtype=np.int32))
            self.items.append((item, words))
        every = np.concatenate([np.zeros(0, np.uint64), *hashes])
        order = np.argsort(every, kind="stable")
        self.keys, starts = np.unique(every[order], return_index=True)
        self.starts = np.append(starts, len(every))
        self.maybe = np.zeros(1 << max(10, min(24, (16 * len(self.keys)).bit_length())), bool)
        self.maybe[(self.keys >> np.uint64(40)) & np.uint64(len(self.maybe) - 1)] = True
        self.owner, self.place = (np.concatenate([np.zeros(0, np.int32), *x])[order] for x in (owner, place))

    def candidates(self, words: list[int]) -> dict[int, list[tuple[int, int]]]:
        """Per item with enough of them, (place in the document, place in the item) of each n-gram in common."""
        known = np.array(words, np.int64)
        if len(known) < GRAM or not len(self.keys):
            return {}
        h, n = gram_hashes(known), len(known) - GRAM + 1
        # Unknown words and a table of bits leave few places to look up.
        likely = self.maybe[(h >> np.uint64(40)) & np.uint64(len(self.maybe) - 1)]
        for i in range(GRAM):
            likely &= known[i : i + n] >= 0
        found = np.flatnonzero(likely)
        if len(found) < HITS:
            return {}
        h = h[found]
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        same = self.keys[at] == h
        found, at = found[same], at[same]
        if len(found) < HITS:
            return {}
        # The postings of all hits at once; items that have too few are left out before any is looked at.
        first, n = self.starts[at], self.starts[at + 1] - self.starts[at]
        posting = np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        item, where = self.owner[posting], np.repeat(found, n)
        enough = np.bincount(item, minlength=len(self.items)) >= HITS
        keep = enough[item]
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, j, k in zip(item[keep].tolist(), where[keep].tolist(), self.place[posting[keep]].tolist(), strict=True):
            out[i].append((j, k))
        return out

    def spans(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """(item index, first word, last word) of verified spans in a document."""
        for n, hits in self.candidates(words).items():
            item, left = self.items[n][1], list(words)
            for group in clusters(hits):
                for first, last in verify(left, item, group):
                    yield n, first, last


def clusters(hits: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Hits whose places in the document lie within one passage of each other."""
    hits = sorted(hits)
    group = [hits[0]]
    for h in hits[1:]:
        if h[0] - group[-1][0] > 2 * LEAST:
            yield group
            group = []
        group.append(h)
    yield group


def nearest(pattern: list[int], text: list[int], most: int) -> int:
    """Place in ``text`` of an end of an approximate copy of ``pattern`` with at most ``most`` edits, else -1.

    Word-level edit distance against any part of the text, one bit per word of
    the pattern, all rows of a column at once. Of several copies it is one of the
    first: the search ends where a whole pattern's length brings no better end.
    """
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, most + 1, -1
    for j, w in enumerate(text):
        if 0 <= at <= j - m:
            break
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
        if score < best:
            best, at = score, j
    return at


def verify(words: list[int], item: list[int], group: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """All spans of the document, within one cluster, that hold enough of the item; each is masked (-1) in ``words``.

    A run of L words with one error in eight or fewer always holds such a run
    of 20 to 39 words, and of those one of exactly 20, 24 or 32 words with 2, 3
    or 4 errors; so these three lengths, at every start, decide. Masking adds
    no match, so each start and length is searched until it finds nothing more
    and isn't looked at again. What is left of a passage beside its span stays
    only if it is too short to be a passage itself.
    """
    # A hit whose words an earlier cluster's span took is none any more.
    alive = lambda hits: [(j, k) for j, k in hits if -1 not in words[j : j + GRAM]]
    group = alive(group)
    if len({j for j, _ in group}) < HITS:
        return
    low, high = max(0, group[0][0] - 2 * LEAST), min(len(words), group[-1][0] + GRAM + 2 * LEAST)
    starts = sorted({k for _, k in group})
    first, last = max(0, starts[0] - LEAST), starts[-1] + GRAM
    sizes = range(LEAST, 2 * LEAST, 1)
    lengths = sorted({min(n for n in sizes if n // PER_ERROR == e) for e in {n // PER_ERROR for n in sizes}})
    near = set(starts)
    # Starts that lie on a hit come first: most copies are decided by one of them.
    for s in sorted(range(first, min(last, len(item) - LEAST + 1)), key=lambda s: (s not in near, s)):
        for n in lengths:
            if s + n > len(item):
                break
            most, at = n // PER_ERROR, low
            while (found := nearest(item[s : s + n], words[at:high], most)) >= 0:
                end = at + found
                begin = max(at, end - n + most + 1)
                # The whole of the span: from its first to its last word in common with the item on the same diagonal.
                diagonal = end - (s + n - 1)
                close = [j for j, k in group if abs(j - k - diagonal) <= 2 * (len(item) // PER_ERROR)]
                span = min([*close, begin]), max([j + GRAM - 1 for j in close] + [end])
                yield span
                words[span[0] : span[1] + 1] = [-1] * (span[1] + 1 - span[0])
                group = alive(group)
                if len({j for j, _ in group}) < HITS:
                    return
                # A better copy may have been taken before one just ahead of it, at most once per error.
                at = max(at, begin - (most + 2) * n)


def _blocks(items: DataFrame, id_col: str, text: str) -> list[list[tuple[int, str]]]:
    """The items in blocks of at most BLOCK_CHARS characters; items are the stated query set."""
    blocks, size = [[]], 0
    for r in items.select(id_col, text).where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).toLocalIterator():
        if size + len(r[1]) > BLOCK_CHARS and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((r[0], r[1]))
        size += len(r[1])
    return blocks


def leaked_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, span_start, span_end) of verified passages; places are characters of the stored text.

    Every document is read whole, once per block of items. Null texts and ids
    hold nothing; items of fewer than twenty words can't leak.
    """
    spark = docs.sparkSession
    alike = confusables.shared(spark)
    out = None
    for block in _blocks(items, item_id, item_text):
        held = spark.sparkContext.broadcast(Passages(block))

        def run(parts: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            confusables.use(alike.value)
            p: Passages = held.value
            for d in parts:
                rows = []
                for i, t in zip(d["doc_id"], d["text"], strict=True):
                    if not p.candidates([p.ids.get(w, -1) for w in only_words(t)]):
                        continue
                    words, begin, end = read_words(t)
                    for n, a, b in p.spans([p.ids.get(w, -1) for w in words]):
                        rows.append((i, p.items[n][0], begin[a], end[b]))
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "span_start", "span_end"])

        read = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null"))
        found = read.mapInPandas(run, "doc_id long, item_id long, span_start int, span_end int")
        out = found if out is None else out.unionByName(found)
    return out


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) once each."""
    return leaked_spans(docs, items).select("doc_id", "item_id").distinct()


def cleaned(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that hold passages, with those taken out: (doc_id, items, removed_chars, text)."""
    spans = leaked_spans(docs, items)
    held = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("span_start", "span_end"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    both = docs.select("doc_id", "text").join(held, "doc_id")
    # Keep what lies before each span, from the end of those before it; spans of one document are as many as its passages.
    step = lambda acc, s: F.struct(
        F.concat(acc["kept"], F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["span_start"] - acc["at"], F.lit(0)))).alias("kept"),
        F.greatest(acc["at"], s["span_end"]).alias("at"),
    )
    done = F.aggregate("spans", F.struct(F.lit("").alias("kept"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["kept"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return both.withColumn("clean", done).select("doc_id", "items", (F.length("text") - F.length("clean")).alias("removed_chars"), F.col("clean").alias("text"))
