"""Texts cut off by field limits or in transfer.

Three kinds of evidence give each text's posterior of having been cut. What is
left after foreign residue is taken off ends where texts of this kind end or
where they go on: n-gram counts of letters and of words, from long contexts to
short ones, give the likelihood of an end there. Per source, length
distributions are fitted by maximum likelihood, lengths at a candidate limit
counting as right-censored; the excess at a limit over the fitted density is
the censoring posterior there. Away from limits, the lengths of surely cut and
surely whole texts are compared.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.functions.names import name_key
from kilnspark.llm import confusables
from kilnspark.llm.confusables import consistent
from kilnspark.operators.joins import lookup_join
from kilnspark.session import cut_lineage

#: Characters whose contexts are counted at once in a worker.
COUNT_CHARS = 1 << 20
#: Most 64-bit words of the filter that keeps contexts no open ending has out of the shuffle; a fuller one lets more pass, but loses none.
FILTER_WORDS = 1 << 20
#: Letters in a context (c), and words in a slot (w: the last word itself left open; w0: nothing but the last word), from vague to exact.
CHAIN = (("c", 3), ("w", 0), ("c", 5), ("w", 1), ("c", 7), ("c", 9), ("w", 2), ("c", 12), ("w", 3), ("c", 16), ("c", 22))
WEIGHT = 4.0
#: A last word is a fragment if longer words begin with it this many times as often as it occurs itself.
FRAGMENT = 200
#: Least share of texts stopping inside a word at a length that counts as a limit.
INSIDE = 0.1
#: Log-normal lengths of cut texts (0) and of whole ones without a mark (2) before any is seen; they weigh as much as so many texts in every fit.
PRIOR_TEXTS = 20.0
PRIOR = {0: (np.ones(1), np.array([4.6]), np.array([0.5])), 2: (np.array([0.7, 0.3]), np.array([2.2, 4.8]), np.array([0.5, 0.5]))}
#: Lengths from here on share a value with those up to a ninetieth longer.
FINE, PER_OCTAVE = 1024, 64
#: Fits are broadcast up to this many sources, joined beyond.
FEW_SOURCES = 10_000
#: Characters at a text's end in which residue is looked for at once.
TAIL = 80
#: What a field limit or a broken transfer leaves behind the cut.
RESIDUE = re.compile(r"""(?:&\#?\w{0,6};?|\\+(?:u[0-9a-fA-F]{0,4}|x[0-9a-fA-F]{0,2}|[nrt"])?|%[0-9A-F]{0,2}|<[|/!]?[\w|/-]*|["']?[}\]]+|[\[{|(<]+|\([^()]{0,24}|\.{3,}|["'*_~`]+|[\s�]+)$""")
OPEN = ("open", "broken", "pause")
#: Marks that a reader wouldn't end a text with, and how much less likely one with them behind it is whole.
_BROKEN, BROKEN_SHARE = re.compile(r"[{}\[\]<|\\&(%]"), 0.05
_MARKED = re.compile(r"[.!?。！？]$")
_CLOSERS = re.compile(r"""[\s"'”’»)\]*_]+$""")
_WORD = re.compile(r"[^\W_]+(?:['-][^\W_]+)*")
_TOKEN = re.compile(r"[^\W_]+(?:['-][^\W_]+)*|[.!?。！？]+(?=[\s\"')\]]|$)|[,;:]")
_MARKS = ".!?。！？"
_BARE = re.compile(r"[\W_]+")
_NO_LETTER = bytes(b for b in range(256) if not chr(b).isalnum() or b > 127)


def core_of(text: str) -> str:
    """A text's consistent form without residue at its end."""
    return measured(consistent(text))[0]


def measured(form: str) -> tuple[str, int]:
    """(core, length at the cut) of a consistent form: blanks before the residue belong to the length, as a limit counts them too."""
    end = length = len(form)
    while end:
        # Residue is short, so only the last characters are looked at, however long the text.
        begin = max(0, end - TAIL)
        tail = form[begin:end]
        found = RESIDUE.search(tail)
        if not found or (_MARKED.search(_CLOSERS.sub("", tail)) and not tail.endswith("...")):
            break
        end = begin + found.start()
        if found[0].strip():
            length = end
    return form[:end], length


def letters_of(form: str) -> str:
    """Letters and digits of a consistent form, in lower case."""
    low = form.lower()
    return low.encode().translate(None, _NO_LETTER).decode() if low.isascii() else _BARE.sub("", low)


def bare(text: str | None) -> str:
    """Letters and digits of a text's consistent form, in lower case."""
    return letters_of(consistent(text)) if text else ""


@lru_cache(maxsize=4096)
def prompt_letters(asked: str) -> str:
    """The bare letters of a prompt; its answers follow one another."""
    return bare(asked)


@lru_cache(maxsize=4096)
def prompt_words(asked: str) -> frozenset[str]:
    """The words of a prompt."""
    return frozenset(_WORD.findall(consistent(asked).lower()))


def ending_of(text: str | None, prompt: str) -> tuple[str, str, int]:
    """(kind, core, length at the cut): ``empty``, ``echo`` of the prompt (bare letters), ``marked`` with a final mark, ``open``, ``broken`` off with residue behind it, or ``pause``.

    An ellipsis may stand for a pause or for a cut, so a text that ends with one is as undecided as an open one.
    """
    form = consistent(text) if text else ""
    letters = letters_of(form)
    if not letters:
        return "empty", "", 0
    core, length = measured(form)
    if "__" in text or (len(letters) > 12 and letters in prompt):
        return "echo", core, length
    shown = form.rstrip()
    if shown.endswith("...") and not shown.endswith("...."):
        return "pause", core, length
    if _MARKED.search(_CLOSERS.sub("", core[-TAIL:])):
        return "marked", core, length
    return ("broken" if _BROKEN.search(shown[len(core) :]) else "open"), core, length


_MASK = 0xFFFFFFFFFFFFFFFF
_ORDERS = tuple(sorted(n for kind, n in CHAIN if kind == "c"))


def _letters_hashes(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(order, 64-bit hashes of that many letters that end at each place), from short to long."""
    h, power = np.zeros(len(codes), np.uint64), 1
    for j in range(_ORDERS[-1]):
        h[:j] += np.uint64(7 * power & _MASK)
        h[j:] += (codes[: len(codes) - j] + np.uint64(7)) * np.uint64(power)
        power = power * 0x9E3779B97F4A7C15 & _MASK
        if j + 1 in _ORDERS:
            yield j + 1, h * np.uint64(0xBF58476D1CE4E5B9) ^ np.uint64(j + 1)


def _letters_hash(codes: np.ndarray, order: int) -> np.ndarray:
    """64-bit hash of the ``order`` letters that end at each place."""
    return next(h for n, h in _letters_hashes(codes) if n == order)


def _end_hashes(low: str) -> dict[int, int]:
    """The hashes of :func:`_letters_hashes` at the end of one text, all orders in one pass."""
    out, h, power = {}, 0, 1
    codes = [ord(ch) for ch in low[-_ORDERS[-1] :][::-1]]
    codes += [2] * (_ORDERS[-1] - len(codes))
    for j, c in enumerate(codes, 1):
        h = (h + (c + 7) * power) & _MASK
        power = power * 0x9E3779B97F4A7C15 & _MASK
        if j in _ORDERS:
            out[j] = (h * 0xBF58476D1CE4E5B9 & _MASK) ^ j
    return out


# A word in its slot is known by the hashes of the words before it, each times the odd number of its place.
_PLACES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_SLOT = 0xD6E8FEB86659FD93
_START = xxhash.xxh64_intdigest("^", 0)


def _slot_hashes(word: str, before: tuple[str, ...]) -> list[int]:
    """Hashes of a word, and of the one, two and three words before it; where its sentence begins a mark stands for a word."""
    known = [xxhash.xxh64_intdigest(w, 0) for w in before[:3]]
    known += [_START] * (3 - len(known))
    out, h = [xxhash.xxh64_intdigest(word, 0) * _SLOT & _MASK], 0
    for n in range(3):
        h = (h + known[n] * _PLACES[n]) & _MASK
        out.append(h * _SLOT & _MASK ^ (n + 1))
    return out


# A context is known by its hash; these are the letters and ends of all texts, and the seeds of a whole word and of what longer words begin with.
_BASE, _OWN, _LONGER = 0, 10, 11


def context_keys(core: str) -> list[int]:
    """Hashes of the contexts of CHAIN at the end of ``core``, of its last word and of words that begin with it; none where its last mark decides."""
    low = core.lower()
    tokens = _TOKEN.findall(low)
    if not tokens or core[-1] in ",;:)]":
        return []
    before: tuple[str, ...] = ()
    for t in reversed(tokens[:-1][-3:]):
        if t[0] in _MARKS:
            break
        before += (t,)
    letters, slots = _end_hashes(low), _slot_hashes(tokens[-1], before)
    keys = [letters[n] if kind == "c" else slots[n] for kind, n in CHAIN]
    keys += [xxhash.xxh64_intdigest(tokens[-1], seed) for seed in (_OWN, _LONGER)]
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def passes(wanted: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter holds each hash: bit and word are bits 24 and up of it."""
    at = h >> np.uint64(24)
    return (wanted[(at >> np.uint64(6)) & np.uint64(len(wanted) - 1)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


_MARK_RUN = re.compile(r"[.!?。！？]+(?=[\s\"')\]\x02]|$)")
_BATCH_TOKEN = re.compile(r"[^\W_]+(?:['-][^\W_]+)*|[.!?。！？]+(?=[\s\"')\]\x02]|$)|[,;:]|\x02+")
_GAP = "\x02" * _ORDERS[-1]


def _summed(h: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, total, sum of ``end``) of equal hashes."""
    known, at = np.unique(h, return_inverse=True)
    return known, np.bincount(at, minlength=len(known)), np.bincount(at, weights=end, minlength=len(known))


def context_counts(texts: Iterable[tuple[str, str]], wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, total, end) of the contexts in (kind, core) that ``wanted`` lets pass: how often each occurs, and how often a text or sentence ends there.

    The same context may come out several times. Words count with ``end`` as
    their total, so that one that occurs once is kept. Texts are put together
    up to COUNT_CHARS and read as one.
    """
    held: list[tuple[str, str]] = []
    size = 0
    for kind, core in texts:
        if core:
            held.append((kind, core.lower().replace("\x02", " ")))
            size += len(core)
            if size >= COUNT_CHARS:
                yield from _counts_of(held, wanted)
                held, size = [], 0
    if held:
        yield from _counts_of(held, wanted)


def _counts_of(held: list[tuple[str, str]], wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    every = _GAP + _GAP.join(low for _, low in held)
    codes = np.frombuffer(every.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.zeros(len(codes), np.int8)
    starts = np.array([m.start() for m in _MARK_RUN.finditer(every)], np.int64)
    ends[starts[codes[starts - 1] != 2] - 1] = 1
    finals = np.cumsum([len(low) + len(_GAP) for _, low in held]) - 1
    # A text that broke off, or that a mark ends, tells nothing by its last letter.
    ends[finals[[kind in OPEN and kind != "broken" for kind, _ in held]]] = 1
    # Long ones go in pieces, each with the letters before it.
    for begin in range(len(_GAP), len(codes), COUNT_CHARS):
        piece = slice(begin - len(_GAP), begin + COUNT_CHARS)
        flat, end = codes[piece].astype(np.uint64), ends[piece]
        live = flat != 2
        live[: len(_GAP)] = False
        yield np.array([_BASE], np.uint64), np.array([live.sum()]), np.array([end[live].sum()])
        for _, h in _letters_hashes(flat):
            keep = live & passes(wanted, h)
            yield _summed(h[keep], end[keep])
    yield from _slot_counts(_BATCH_TOKEN.findall(every), np.array([kind == "broken" for kind, _ in held]), wanted)


def _slot_counts(tokens: list[str], broken: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The contexts of the words of texts that gaps begin."""
    numbers: dict[str, int] = {}
    at = np.fromiter((numbers.setdefault(t, len(numbers)) for t in tokens), np.int64, len(tokens))
    names = list(numbers)
    sort = np.array([3 if t[0] == "\x02" else 2 if t[0] in _MARKS else 1 if t in ",;:" else 0 for t in names], np.int8)[at]
    h = np.array([xxhash.xxh64_intdigest(t, 0) for t in names], np.uint64)[at]
    follows = np.append(sort[1:], 3)
    last, word = follows == 3, sort == 0
    # What breaks off is no word, and no end.
    slot = word & ~(last & broken[np.cumsum(sort == 3) - 1])
    over = (last | (follows == 2))[slot]
    # The words before each, up to the start of its sentence.
    stop, before = sort >= 2, np.zeros(len(h), np.uint64)
    keys, halted = [h * np.uint64(_SLOT)], np.zeros(len(h), bool)
    for n in range(3):
        gone = np.append(np.ones(n + 1, bool), stop[: -(n + 1)])[: len(h)]
        halted |= gone
        shifted = np.append(np.zeros(n + 1, np.uint64), h[: -(n + 1)])[: len(h)]
        before = before + np.where(halted, np.uint64(_START), shifted) * np.uint64(_PLACES[n])
        keys.append(before * np.uint64(_SLOT) ^ np.uint64(n + 1))
    for k in keys:
        k = k[slot]
        keep = passes(wanted, k)
        yield _summed(k[keep], over[keep])
    complete = np.bincount(at[word & ~last], minlength=len(names))
    found: dict[int, int] = {}
    for i in np.flatnonzero(complete):
        w, n = names[i], int(complete[i])
        digest, k = xxhash.xxh64(seed=_LONGER), xxhash.xxh64_intdigest(w, _OWN)
        found[k] = found.get(k, 0) + n
        for ch in w[:-1]:
            digest.update(ch)
            k = digest.intdigest()
            found[k] = found.get(k, 0) + n
    k, n = np.fromiter(found, np.uint64, len(found)), np.fromiter(found.values(), np.int64, len(found))
    keep = passes(wanted, k)
    yield k[keep], n[keep], n[keep]


def nearness(core: str, words: frozenset[str]) -> int:
    """2 if the last word of ``core`` is one of the prompt's, 1 if one of those begins with it, else 0."""
    tokens = _TOKEN.findall(core[-200:].lower())
    if not tokens:
        return 0
    return 2 if tokens[-1] in words else int(any(w.startswith(tokens[-1]) for w in words))


def whole(core: str, seen: dict[int, tuple[int, int]], base: float, near: int = 0, broken: bool = False) -> tuple[float, bool]:
    """P(the text is whole | it stops after ``core``), and whether it stops inside a word.

    ``seen``: (total, end) of those of its :func:`context_keys` that are known,
    by their place there; ``near`` is that of :func:`nearness`, ``broken`` says that
    residue follows. One end in each context is taken off, as the text itself
    is among those counted.
    """
    low = core.lower()
    tokens = _TOKEN.findall(low)
    if not tokens:
        return 1.0, False
    if core[-1] in ",;:":
        return 1e-4, False
    if core[-1] in ")]":
        return 0.95, False
    p = base
    for i in range(len(CHAIN)):
        if i in seen:
            t, e = seen[i]
            if e:
                e, t = e - 1, t - 1
            p = (e + WEIGHT * p) / (t + WEIGHT)
    last, inside = tokens[-1], False
    if near != 2 and low[-1:].isalnum() and last.replace("-", "").isalpha():
        own, longer = (seen.get(len(CHAIN) + i, (0, 0))[0] for i in (0, 1))
        if own == 0 and (longer > 1 or near == 1) or longer > FRAGMENT * own > 0:
            p, inside = p * 0.02, True
    if broken:
        p *= BROKEN_SHARE
    return min(max(p, 1e-4), 1 - 1e-4), inside


# Lengths


def _survival(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in np.atleast_1d(z)])


def censored_mle(x: np.ndarray, n: np.ndarray, censored: np.ndarray, parts: int = 2, steps: int = 80) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shares, means, deviations) of a mixture of log-normal lengths by EM; censored lengths count as "at least this long"."""
    y = np.log(np.maximum(x, 1.0))
    order = np.argsort(y)
    cum = np.cumsum(n[order]) / n.sum()
    mu = np.array([y[order][min(np.searchsorted(cum, (i + 0.5) / parts), len(y) - 1)] for i in range(parts)])
    sd, w = np.full(parts, max(y.std(), 0.3)), np.full(parts, 1 / parts)
    for _ in range(steps):
        z = (y[:, None] - mu) / sd
        pdf = np.exp(-0.5 * z * z) / (sd * math.sqrt(2 * math.pi))
        surv = np.maximum(_survival(z.ravel()).reshape(z.shape), 1e-12)
        like = w * np.where(censored[:, None], surv, pdf) + 1e-300
        r = like / like.sum(1, keepdims=True) * n[:, None]
        # Expected value and square of a length that is only known to be longer.
        mills = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / surv
        ey = np.where(censored[:, None], mu + sd * mills, y[:, None])
        ey2 = np.where(censored[:, None], mu**2 + sd**2 + sd * (y[:, None] + mu) * mills, (y**2)[:, None])
        total = np.maximum(r.sum(0), 1e-9)
        w, mu = total / total.sum(), (r * ey).sum(0) / total
        sd = np.sqrt(np.maximum((r * ey2).sum(0) / total - mu**2, 0.01))
    return w, mu, sd


def density(x: np.ndarray, fit: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Probability of each whole length under a fitted mixture."""
    w, mu, sd = fit
    z = (np.log(np.maximum(x, 1.0))[:, None] - mu) / sd
    return (w * np.exp(-0.5 * z * z) / (sd * math.sqrt(2 * math.pi))).sum(1) / np.maximum(x, 1.0)


def candidate_limits(length: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Lengths at which far more open texts stop than at the eight lengths on either side."""
    at = dict(zip(length.tolist(), n.tolist(), strict=True))
    out = []
    for x, k in at.items():
        near = [at.get(x + d, 0) for d in range(-8, 9) if d]
        mean = sum(sorted(near)[2:-2]) / (len(near) - 4) + 0.3
        if k >= 5 and k > 3 * mean + 4 * math.sqrt(mean):
            out.append(x)
    return np.array(sorted(out), float)


def fit_source(hist: pd.DataFrame) -> dict:
    """Limits of one source with their censoring posterior, and the log odds of a cut elsewhere.

    ``hist``: core_len, state (0 marked, 1 open, 2 open behind an ellipsis), belief (0 stops inside a word, 1 unsure, 2 surely whole), n.
    A limit is known by four times its length plus the state.
    """
    every = hist.groupby(["core_len", "state"], as_index=False)["n"].sum()
    x, state, n = every["core_len"].to_numpy(float), every["state"].to_numpy(), every["n"].to_numpy(float)
    inside = hist[hist["belief"] == 0].groupby(["state", "core_len"])["n"].sum().to_dict()
    limits = {s: candidate_limits(x[state == s], n[state == s]) for s in (1, 2)}
    # A limit doesn't care for words, so a good part of what it cuts stops inside one.
    limits = {s: np.array([v for v in at if inside.get((s, int(v)), 0) >= INSIDE * n[(state == s) & (x == v)].sum()]) for s, at in limits.items()}
    at_limit = np.zeros(len(x), bool)
    for s in (1, 2):
        at_limit |= (state == s) & np.isin(x, limits[s])
    # Texts at a limit are known to be at least that long; the excess of them is what the limit cut.
    fit = censored_mle(x, n, at_limit)
    keys, posterior = [], []
    for s in (1, 2):
        sure = hist[(hist["state"] == s) & (hist["belief"] == 2) & ~hist["core_len"].isin(limits[s])]["n"].sum()
        for limit in limits[s]:
            here = float(n[(state == s) & (x == limit)].sum())
            expected = float(density(np.array([limit]), fit)[0]) * (sure + 1)
            keys.append(float(limit * 4 + s))
            posterior.append(min(max(1 - expected / here, 0.05), 0.999))
    off = hist[(hist["state"] > 0) & ~(hist["core_len"] * 4.0 + hist["state"]).isin(keys)]
    count = lambda s, belief: float(off[(off["state"] == s) & (off["belief"] == belief)]["n"].sum())
    return {"limits": keys, "posterior": posterior, "cut": [count(1, 0), count(2, 0)], "whole": [count(1, 2), count(2, 2)]}


def length_of(key: np.ndarray) -> np.ndarray:
    """The length that stands for those of a key; see :func:`length_key`."""
    return np.where(key < FINE, key, FINE * 2.0 ** ((np.maximum(key, FINE) - FINE + 0.5) / PER_OCTAVE))


def length_key(length: Column) -> Column:
    """Every length below FINE by itself, longer ones by PER_OCTAVE values for each doubling, so that their number stays small."""
    return F.when(length < FINE, length).otherwise(FINE + F.floor(F.log2(length / FINE) * PER_OCTAVE)).cast("int")


#: No text is longer than 2**31 characters.
KEYS = FINE + 21 * PER_OCTAVE + 1


def length_odds(hist: pd.DataFrame, lengths: np.ndarray) -> np.ndarray:
    """log f(length | cut) / f(length | whole and open), from texts cut inside a word and surely whole ones of all sources.

    PRIOR counts as PRIOR_TEXTS texts in both fits, so that few texts say little and many all.
    """
    out, grid = [], length_of(np.arange(0, FINE + PER_OCTAVE, 8, dtype=float))
    for belief in (0, 2):
        part = hist[(hist["state"] > 0) & (hist["belief"] == belief)].groupby("core_len")["n"].sum()
        if belief == 2:  # those of which the ending doesn't tell count half
            part = part.add(0.5 * hist[(hist["state"] > 0) & (hist["belief"] == 1)].groupby("core_len")["n"].sum(), fill_value=0.0)
        assumed = density(grid, PRIOR[belief])
        x, n = np.append(grid, part.index.to_numpy(float)), np.append(PRIOR_TEXTS * assumed / assumed.sum(), part.to_numpy(float))
        out.append(density(lengths, censored_mle(x, n, np.zeros(len(x), bool), 1 if belief == 0 else 2)))
    # Where neither has any mass a text counts as whole.
    return np.clip(np.log((out[0] + 1e-12) / (out[1] + 1e-9)), -20, 3)


# The operator


def _state() -> Column:
    return F.when(F.col("kind").isin("open", "broken"), 1).when(F.col("kind") == "pause", 2).otherwise(0)


def prompts_once(prompts: DataFrame) -> DataFrame:
    """(prompt_id, question_text, asked) once per prompt; ``asked`` holds both forms of the prompt."""
    asked = F.concat_ws("\n", "prompt_text", "negative_prompt_text", "question_text")
    return prompts.where(F.col("prompt_id").isNotNull()).groupBy("prompt_id").agg(F.min(F.struct(F.col("question_text"), asked.alias("asked"))).alias("p")).select("prompt_id", "p.question_text", "p.asked")


def endings(answers: DataFrame) -> DataFrame:
    """(id, src, kind, core, core_len, near, keys) of rows (id, src, text, asked); ``keys`` are the contexts of an open ending."""
    held = confusables.shared(answers.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        confusables.use(held.value)
        for d in parts:
            rows = []
            for text, asked in zip(d["text"], d["asked"], strict=True):
                kind, core, length = ending_of(text, prompt_letters(asked or ""))
                rows.append((kind, core, length, nearness(core, prompt_words(asked or "")), context_keys(core)) if kind in OPEN else (kind, core, length, 0, []))
            kinds = pd.DataFrame(rows, columns=["kind", "core", "core_len", "near", "keys"], index=d.index)
            yield pd.concat([d[["id", "src"]], kinds], axis=1)

    # Ids go through Python as text, as a null among them would turn whole numbers into floats.
    read = answers.select(F.col("id").cast("string").alias("id"), "src", "text", "asked")
    return read.mapInPandas(run, "id string, src string, kind string, core string, core_len int, near int, keys array<long>")


def counted(found: DataFrame) -> DataFrame:
    """(h, total, n_end) of every context that an open ending of ``found`` has, over all its texts; the same text counts once.

    What the open endings ask for is kept as a bit filter of bounded size, so
    that workers shuffle hardly any other context; sums are made before and after.
    """
    asked = found.select(F.explode("keys").alias("h"))
    words = 1 << min(FILTER_WORDS.bit_length() - 1, max(10, (asked.count() // 8).bit_length()))
    at = F.shiftrightunsigned("h", 24)
    bits = asked.select(F.shiftrightunsigned(at, 6).bitwiseAND(F.lit(words - 1)).alias("at"), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 24) & 63 as int))").alias("bit"))
    bits = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    wanted = np.zeros(words, np.uint64)
    wanted[bits["at"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64).view(np.uint64)
    held = found.sparkSession.sparkContext.broadcast(wanted)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = (t for d in parts for t in zip(d["kind"], d["core"], strict=True))
        for h, total, end in context_counts(texts, held.value):
            yield pd.DataFrame({"h": h.view(np.int64), "total": total.astype(np.int64), "n_end": end.astype(np.int64)})

    texts = found.where(F.col("kind").isin(*OPEN, "marked")).select("kind", "core").distinct()
    return texts.mapInPandas(run, "h long, total long, n_end long").groupBy("h").agg(F.sum("total").alias("total"), F.sum("n_end").alias("n_end"))


def scored(answers: DataFrame) -> DataFrame:
    """(id, src, kind, core_len, whole, inside): each text's ending and the likelihood that it is whole there."""
    found = cut_lineage(endings(answers).withColumn("sig", F.when(F.size("keys") > 0, F.xxhash64("keys"))))
    counts = cut_lineage(counted(found))
    every = counts.where(F.col("h") == _BASE).first()
    base = max(every["n_end"], 1) / max(every["total"], 2) if every else 0.5
    # Equal endings are looked up once.
    asked = found.where(F.col("sig").isNotNull()).select("sig", "keys").dropDuplicates(["sig"]).select("sig", F.posexplode("keys").alias("place", "h"))
    known = lookup_join(asked, counts.where("total > 1 or n_end > 0"), "h", "inner")
    known = cut_lineage(known.groupBy("sig").agg(*(F.collect_list(c).alias(c) for c in ("place", "total", "n_end"))))
    texts = found.select("id", "src", "kind", "core_len", F.when(F.col("kind").isin(*OPEN), F.col("core")).alias("core"), "near", "sig")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            p = []
            for kind, core, near, place, total, end in zip(d["kind"], d["core"], d["near"], d["place"], d["total"], d["n_end"], strict=True):
                if kind not in OPEN:
                    p.append((1.0, False))
                    continue
                seen = {} if place is None else dict(zip(place.tolist(), zip(total.tolist(), end.tolist(), strict=True), strict=True))
                p.append(whole(core, seen, base, near, kind == "broken"))
            yield pd.DataFrame({"id": d["id"], "src": d["src"], "kind": d["kind"], "core_len": d["core_len"], "whole": [x for x, _ in p], "inside": [x for _, x in p]})

    return lookup_join(texts, known, "sig").mapInPandas(run, "id string, src string, kind string, core_len int, whole double, inside boolean")


def cut_posteriors(answers: DataFrame) -> DataFrame:
    """(id, src, kind, core_len, whole, cut): ``answers`` has id, src, text, asked; ``cut`` is the posterior of a cut.

    Texts that are null, without letters, echoes of the prompt or ended by a
    final mark are 0. Lengths are summed up by source before they are fitted.
    """
    rows = cut_lineage(scored(answers))
    counted = rows.where(F.col("kind").isin(*OPEN, "marked")).groupBy(
        "src",
        "core_len",
        _state().alias("state"),
        F.when(F.col("inside"), 0).when(F.col("whole") > 0.8, 2).otherwise(1).alias("belief"),
    )
    hist = cut_lineage(counted.agg(F.count(F.lit(1)).alias("n")))

    def fit(d: pd.DataFrame) -> pd.DataFrame:
        f = fit_source(d)
        return pd.DataFrame([(d["src"].iat[0], f["limits"], f["posterior"], f["cut"], f["whole"])], columns=["src", "limits", "posteriors", "n_cut", "n_whole"])

    fits = cut_lineage(hist.groupBy("src").applyInPandas(fit, "src string, limits array<double>, posteriors array<double>, n_cut array<double>, n_whole array<double>"))
    # There are KEYS lengths at most, so this table's size doesn't grow with the data.
    pooled = hist.groupBy(length_key(F.col("core_len")).alias("core_len"), "state", "belief").agg(F.sum("n").alias("n")).toPandas()
    pooled["core_len"] = length_of(pooled["core_len"].to_numpy(float))
    by_length = np.round(length_odds(pooled, length_of(np.arange(KEYS, dtype=float))), 6).tolist()
    odds = F.broadcast(rows.sparkSession.createDataFrame(list(enumerate(by_length)), "len_key int, len_odds double"))
    joined = rows.join(F.broadcast(fits), "src", "left") if fits.count() <= FEW_SOURCES else lookup_join(rows, fits, "src")
    joined = joined.withColumn("len_key", length_key(F.col("core_len"))).join(odds, "len_key", "left")
    at = F.array_position("limits", F.col("core_len") * 4.0 + _state())
    limit = F.when(at > 0, F.element_at("posteriors", F.greatest(at, F.lit(1)).cast("int")))
    of_state = lambda c: F.element_at(c, F.greatest(_state(), F.lit(1))) + 1
    free = F.log(of_state("n_cut") / of_state("n_whole")) + F.when(_state() == 1, F.col("len_odds")).otherwise(0.0)
    prior = F.coalesce(F.log(limit / (1 - limit)), free, F.lit(0.0))
    logit = prior + F.log((1 - F.col("whole")) / F.col("whole"))
    id_kind = answers.schema["id"].dataType
    return joined.select(F.col("id").cast(id_kind).alias("id"), "src", "kind", "core_len", "whole", F.when(F.col("kind").isin(*OPEN), 1 / (1 + F.exp(-logit))).otherwise(0.0).alias("cut"))


def answers_of(completions: DataFrame, prompts: DataFrame) -> DataFrame:
    """(id, src, text, question, asked) of each completion; prompts are looked up by prompt_id."""
    rows = completions.select(
        F.col("row_id").alias("id"),
        F.coalesce(name_key(completions["export_source"]), F.lit("")).alias("src"),
        F.col("completion_text").alias("text"),
        "prompt_id",
    )
    return lookup_join(rows, prompts_once(prompts), "prompt_id").select("id", "src", "text", F.col("question_text").alias("question"), "asked")


def source_rates(posteriors: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per source: rows, cut rows and their share. Rows without a text count as rows."""
    cut = (F.col("cut") > threshold).cast("bigint")
    return posteriors.groupBy(F.col("src").alias("source")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(cut).alias("n_cut"), F.round(F.avg(cut.cast("double")), 9).alias("cut_share"))
