"""Text statistics per document, and what they tell: prose, lists, tables, junk.

A document is cut into runs of lines of like shape. Boosted trees over the
statistics of a run give the probability that it is prose, a list, a table or
junk; they are fitted on runs that simple rules are sure of and calibrated on
runs of documents labelled by hand. A document is what most of its text is, by
those probabilities.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnspark.llm.trees import BoostedTrees
from kilnspark.session import spread

KINDS = ("prose", "list", "table", "junk")
#: The trees are fitted on runs of about this many documents of at most so many characters; all documents are scored whole.
TRAIN_DOCS, TRAIN_CHARS = 4_000, 20_000
#: Words of the lexicon up to this rank are common.
COMMON_RANK = 120

_WORD = re.compile(r"(?<!\w)[^\W\d_]+(?:['’][^\W\d_]+)*(?!\w)")
_MARKER = re.compile(r"^\s*(?:[-*+•◦▪·–—]|\(?\d{1,4}[.)]|[A-Za-z][.)]|\[[ xX]?\])\s+")
_NUMBER = re.compile(r"^[-+]?[$€]?\d[\d.,:%/-]*$")
_ENDS, _CLOSERS = frozenset(".!?:…。！？;"), "\"'”’)]"
_SENTENCE = re.compile(r"[.!?。！？][\"'”’)\]]*(?=\s|$)")
_CELLS = (("|", None), ("\t", None), ("&", re.compile(r"(?<=\s)&(?=\s)")), (";", None), (",", None), ("  ", re.compile(r"(?<=\S) {2,}(?=\S)")))
_NUMERAL = re.compile(r"\d")
_TAGGED = re.compile(r"</?t(?:able|[rdh]|head|body)\b", re.I)
#: Letters that stand side by side when text was decoded wrongly.
_GARBLED = re.compile(r"[ÃÂâÐÑï][\u0080-¿€™œ“”‘’•–—…šž¢£¥¦§©«¬®°±²³´µ¶·¹º»¼½¾¿Â¤½]")
_PUNCTUATION = '.,;:!?\n()"“”'
_VOWELS = frozenset("aeiouyäöüáéíóúàèìòùâêîôûãõåæøœąęóаеёиоуыэюяіїєαεηιουω")
_HARD = re.compile(r"[bcdfghjklmnpqrstvwxz]{4,}")


def cells_of(line: str, tagged: bool = False) -> list[str]:
    """Cells of a line by the notation that gives most; one cell if none does."""
    s = line.strip()
    if tagged:
        return [c.strip() for c in re.sub(r"<[^>]*>", "\t", s).split("\t") if c.strip()] or [s]
    best = [s]
    for mark, sep in _CELLS:
        if mark not in s:
            continue
        parts = [t for c in (s.split(mark) if sep is None else sep.split(s)) if (t := c.strip())]
        if len(parts) > len(best):
            best = parts
    return best


def _ended(line: str) -> bool:
    """A final mark, or one before closing quotes and brackets, ends the line."""
    return line.rstrip().rstrip(_CLOSERS)[-1:] in _ENDS


def _mixed(token: str) -> bool:
    """Letters and digits in one token, as in numbers of base 16."""
    return not token.isalpha() and len(token) > 2 and token.isalnum() and not token.isdigit()


@lru_cache(maxsize=1 << 16)
def _token(token: str) -> tuple[bool, bool]:
    """(whether it is a number, whether it mixes letters and digits)."""
    return bool(_NUMBER.match(token)), _mixed(token)


@lru_cache(maxsize=1 << 16)
def _hard(word: str) -> bool:
    """Four consonants in a row."""
    return bool(_HARD.search(word))


@lru_cache(maxsize=1 << 14)
def _letter(ch: str) -> tuple[bool, bool, bool, bool, bool]:
    """(letter, digit, blank, capital, vowel)."""
    return ch.isalpha(), ch.isdigit(), ch.isspace(), ch.isupper(), ch.isalpha() and ch.lower() in _VOWELS


class Line(NamedTuple):
    """What is read of a line, once."""

    text: str
    kind: str  # t cells, s symbols, p words of which many are common, m marked item, w other words
    bare: str  # without its marker: an item's number or bullet is layout, and its dot ends no sentence
    words: list[str]
    cells: list[str]
    ended: bool
    tagged: bool


def read_line(line: str, common: frozenset[str]) -> Line:
    """A line that isn't blank."""
    s = line.strip()
    m = _MARKER.match(line)
    bare = line[m.end() :] if m is not None else line
    words = _WORD.findall(bare.lower())
    tagged = "<" in s and _TAGGED.search(s) is not None
    cells, ended = cells_of(s, tagged), _ended(s)
    if tagged or (len(cells) >= 3 and (sum(_NUMBER.match(c.rstrip("\\ ")) is not None for c in cells) >= 0.3 * len(cells) or (not ended and sum(len(c.split()) for c in cells) <= 1.5 * len(cells)))):
        kind = "t"
    # A token that mixes letters and digits has a digit, so few digits make no line of such tokens.
    elif (tokens := s.split()) and len(tokens) > 3 and len(_NUMERAL.findall(s)) > 0.3 * len(tokens) and sum(_token(t)[1] for t in tokens) > 0.3 * len(tokens):
        kind = "s"
    # Letters are counted only where the words don't already make up half of the line.
    elif (dense := sum(map(len, tokens))) > 2 * sum(map(len, words)) and sum(map(str.isalpha, s)) < 0.5 * dense:
        kind = "t" if "|" in s and re.fullmatch(r"[\s|:+=-]+", s) else "s"
    elif len(words) > (2 if ended else 4) and sum(w in common for w in words) >= 0.18 * len(words):
        kind = "p"
    else:
        kind = "m" if m is not None else "w"
    return Line(line, kind, bare, words, cells, ended, tagged)


def runs_of(text: str, common: frozenset[str]) -> list[list[Line]]:
    """Runs of lines of like shape. Lines of wrapped prose that happen to hold no common word stay in its run."""
    runs: list[tuple[str, list[Line], bool]] = []
    gap = True
    for line in text.split("\n"):
        if not line or line.isspace():
            gap = True
            continue
        read = read_line(line, common)
        if runs and runs[-1][0] == read.kind:
            runs[-1][1].append(read)
        else:
            runs.append((read.kind, [read], gap))
        gap = False
    out: list[tuple[str, list[Line]]] = []
    for i, (kind, lines, after_gap) in enumerate(runs):
        before = out[-1] if out else None
        following = runs[i + 1] if i + 1 < len(runs) else None
        if kind == "w" and len(lines) <= 3 and before and before[0] == "p":
            wrapped = not after_gap and not before[1][-1].ended
            inside = following is not None and following[0] == "p" and not after_gap and not following[2]
            if wrapped or inside:
                before[1].extend(lines)
                continue
        if before and before[0] == kind:
            before[1].extend(lines)
            continue
        if kind == "p" and before and before[0] == "w" and len(before[1]) <= 2 and not after_gap and not before[1][-1].ended:
            out[-1] = ("p", before[1] + lines)
            continue
        out.append((kind, list(lines)))
    return [lines for _, lines in out]


FEATURES = (
    "lines", "chars", "words_per_line", "word_length", "longest_token", "letter_share", "digit_share", "symbol_share",
    "space_share", "upper_share", "line_end_share", "sentence_rate", "comma_rate", "common_share", "distinct_share",
    "number_share", "marker_share", "cells_per_line", "cell_spread", "cell_words", "vowel_share", "hard_share", "garbled_share",
    "foreign_letter_share", "entropy", "pair_repeats", "tagged_share", "word_spread", "mixed_share", "words_per_mark",
)


#: Letter, digit, blank, capital and vowel, by ASCII code.
_ASCII = np.array([_letter(chr(i)) for i in range(128)], np.int64)


class Chars(NamedTuple):
    """How often each character occurs: ASCII by code, others by themselves; and how many are letters, digits, blanks, capitals, vowels, and letters beyond ASCII."""

    ascii: np.ndarray
    others: dict[str, int]
    kinds: list[int]

    @staticmethod
    def of(text: str) -> Chars:
        """Counts of one text."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = codes < 128
        counts = np.bincount(codes[low], minlength=128)
        kinds, others = [*(counts @ _ASCII).tolist(), 0], {}
        if len(codes) != counts.sum():
            for c, n in zip(*(x.tolist() for x in np.unique(codes[~low], return_counts=True)), strict=True):
                others[chr(c)] = n
                found = _letter(chr(c))
                kinds = [k + n * yes for k, yes in zip(kinds, (*found, found[0]), strict=True)]
        return Chars(counts, others, kinds)

    def entropy(self) -> float:
        """Bits per character."""
        n = np.concatenate([self.ascii[self.ascii > 0], np.fromiter(self.others.values(), np.int64, len(self.others))]).astype(float)
        if not len(n):
            return 0.0
        share = n / n.sum()
        return float(-(share * np.log2(share)).sum())


class Sums(NamedTuple):
    """What is summed up over the lines of a run."""

    chars: Chars
    words: Counter[str]
    word_letters: int
    common: int
    lines: int
    ended: int
    entropy: float


def measured(lines: list[Line], common: frozenset[str]) -> tuple[list[float], Sums]:
    """FEATURES of a run of lines, and its sums."""
    text, plain = "\n".join([ln.text for ln in lines]), "\n".join([ln.bare for ln in lines])
    words = [w for ln in lines for w in ln.words]
    tokens = Counter(plain.split())
    n_tokens = max(1, tokens.total())
    known = Counter(words)
    k, n, rows = max(1, len(words)), len(text), len(lines)
    chars = Chars.of(text)
    entropy = chars.entropy()
    letters, digits, spaces, upper, vowels, beyond = chars.kinds
    dense = max(1, n - spaces)
    sizes = [len(ln.cells) for ln in lines]
    mean, words_a_line, ended = sum(sizes) / rows, len(words) / rows, sum(ln.ended for ln in lines)
    numbers = mixed = 0
    if digits:  # neither is without one
        for t, c in tokens.items():
            if not t.isalpha():
                number, mix = _token(t)
                numbers, mixed = numbers + c * number, mixed + c * mix
    longest, total = max(map(len, tokens), default=0), sum(map(len, words))
    rare = known.keys() - common
    hard = sum([known[w] for w in rare if _hard(w)])
    common_words = len(words) - sum([known[w] for w in rare])
    spread = math.sqrt(sum([(s - mean) ** 2 for s in sizes]) / rows) if max(sizes) != min(sizes) else 0.0
    features = [
        math.log1p(rows),
        math.log1p(n),
        words_a_line,
        total / k,
        math.log1p(longest),
        letters / dense,
        digits / dense,
        (dense - letters - digits) / dense,
        spaces / n,
        upper / max(1, letters),
        ended / rows,
        len(_SENTENCE.findall(plain)) / k,
        int(chars.ascii[44]) / k,
        common_words / k,
        len(known) / k,
        numbers / n_tokens,
        sum(ln.bare is not ln.text for ln in lines) / rows,
        mean,
        spread,
        sum([len(c.split()) for ln in lines for c in ln.cells]) / max(1, sum(sizes)),
        vowels / max(1, letters),
        hard / k,
        0.0 if not beyond else 2 * len(_GARBLED.findall(text)) / dense,
        beyond / max(1, letters),
        entropy,
        1 - len(set(zip(words, words[1:], strict=False))) / (len(words) - 1) if len(words) > 1 else 0.0,
        sum(ln.tagged for ln in lines) / rows,
        math.sqrt(sum([(len(ln.words) - words_a_line) ** 2 for ln in lines]) / rows),
        mixed / n_tokens,
        math.log1p(len(words) / (1 + sum(map(plain.count, _PUNCTUATION)))),
    ]
    return features, Sums(chars, known, total, common_words, rows, ended, entropy)


def statistics(lines: list[str], common: frozenset[str]) -> list[float]:
    """FEATURES of lines of text; zeros where all are blank."""
    read = [read_line(ln, common) for ln in lines if ln.strip()]
    return measured(read, common)[0] if read else [0.0] * len(FEATURES)


_AT = {name: i for i, name in enumerate(FEATURES)}


def weak_label(v: list[float]) -> int | None:
    """The kind of a run that structure alone makes sure, else None."""
    f = lambda name: v[_AT[name]]
    rows, words = math.expm1(f("lines")), math.expm1(f("chars")) * (1 - f("space_share")) / max(1.0, f("word_length"))
    if f("garbled_share") > 0.25 or (f("hard_share") > 0.3 and f("common_share") < 0.05):
        return 3
    if f("tagged_share") > 0.7:
        return 2
    if f("common_share") > 0.35 and f("words_per_line") >= 5 and f("distinct_share") > 0.2 and f("pair_repeats") < 0.6 and f("vowel_share") > 0.3 and f("digit_share") < 0.1:
        return 0
    if f("mixed_share") > 0.3 and f("common_share") < 0.05 and f("tagged_share") == 0:
        return 3
    if f("symbol_share") > 0.45 and f("common_share") < 0.1 and f("tagged_share") == 0 and (f("cell_spread") > 0.8 or f("digit_share") < 0.05):
        return 3
    if f("longest_token") > math.log1p(60) and f("common_share") < 0.05 and f("tagged_share") == 0:
        return 3
    if rows >= 3 and f("cells_per_line") >= 2.6 and f("cell_spread") < 1.1 and (f("number_share") > 0.25 or f("digit_share") > 0.2 or f("tagged_share") > 0.8) and f("letter_share") > 0.2:
        return 2
    if f("letter_share") < 0.35 and f("cell_spread") > 1.0 or f("letter_share") < 0.05:
        return 3
    if f("pair_repeats") > 0.7 and words > 15 and f("common_share") < 0.5 and f("sentence_rate") < 0.02:
        return 3
    if f("common_share") >= 0.25 and (f("sentence_rate") > 0.02 or f("line_end_share") > 0.5) and f("words_per_line") > 4:
        return 0
    if f("foreign_letter_share") > 0.005 and f("sentence_rate") > 0.03 and f("vowel_share") > 0.3 and f("word_length") > 3 and f("words_per_line") > 4 and f("garbled_share") < 0.02:
        return 0
    if rows >= 4 and f("words_per_line") <= 4.5 and f("line_end_share") < 0.2 and f("digit_share") < 0.25 and f("vowel_share") > 0.25 and f("sentence_rate") < 0.35 and f("common_share") < 0.25:
        return 1
    if rows <= 2 and f("comma_rate") > 0.28 and f("cell_words") < 3 and f("common_share") < 0.15 and f("digit_share") < 0.2 and f("cells_per_line") >= 5:
        return 1
    if f("sentence_rate") == 0 and f("comma_rate") == 0 and f("common_share") < 0.08 and f("words_per_line") > 18 and f("digit_share") < 0.1:
        return 3
    return None


#: Texts written by hand, which are learned from beside the weakly labelled runs, so that no kind is ever missing.
SEEDS = (
    (0, "The ferry left late, and nobody on the pier could say why.\nIn the end we walked home along the river."),
    (0, "She had been told to wait.\nShe had been told\nthat the door would open at noon,\nand so she sat in the rain."),
    (0, "\"Where is it?\" he asked.\n\"Behind the stove,\" she said, \"where you left it.\""),
    (0, "Q: How many samples did you take for each question?\nA: Sixteen, and we threw away the two that were empty."),
    (0, "Wir sind gestern spät angekommen, aber niemand war mehr im Haus. Deshalb schliefen wir in der Scheune."),
    (0, "Nous avons marché jusqu'au port, puis la pluie est tombée. Personne ne voulait rentrer avant la nuit."),
    (0, "ALL OF THE WINDOWS WERE OPEN WHEN WE CAME BACK, AND THE PAPERS HAD BLOWN INTO THE GARDEN."),
    (0, "The run took 41 minutes on 8 cores, of which 12 were spent on reading. Memory stayed below 30 gigabytes."),
    (0, "O wind that never rests at night,\nwhat have you done with all the light\nthat fell upon the sill?"),
    (0, "La casa estaba vacía cuando llegamos, y el reloj de la cocina seguía andando. No había nadie en el jardín."),
    (1, "- bread\n- green apples\n- milk\n- wash the car\n- candles"),
    (1, "1. hammer\n2. saw\n3. two chisels\n4. Oakford, glue\n5. nails\n6. sand paper"),
    (1, "hammer\nred bucket\nrope\npaint\nNorthfield, cement\nold ladder"),
    (1, "hammer, saw, two chisels, wood glue, long nails, sand paper, drill, spirit level, pencil, tape"),
    (1, "[ ] call the plumber\n[x] buy paint\n[ ] return books\n[ ] mend the fence\n[ ] seeds"),
    (1, "• Lisbon, cork\n• Porto, wine\n• Faro\n• salt pans\n• tiles\n• old trams"),
    (2, "name\tage\tscore\nanna\t31\t0.71\nben\t28\t0.64\ncleo\t40\t0.90"),
    (2, "| city | km | min |\n| --- | --- | --- |\n| Porto | 313 | 180 |\n| Faro | 278 | 165 |"),
    (2, "id,layer,p\n1,4,0.31\n2,9,0.55\n3,12,0.08\n4,2,0.67"),
    (2, "<table>\n<tr><td>city</td><td>km</td></tr>\n<tr><td>Porto</td><td>313</td></tr>\n<tr><td>Faro</td><td>278</td></tr>\n</table>"),
    (2, "city      km     min\nPorto     313    180\nFaro      278    165\nBraga     366    205"),
    (2, "a & 1 & 0.4 \\\\\nb & 2 & 0.6 \\\\\nc & 3 & 0.1 \\\\"),
    (3, "x8%$ }{ ++ 77^^ ;;/ #@ 0=0= <<>> [] ** 4|4 ~~ ))(( %% 91"),
    (3, "qzrtk vbnm xcvb lkjhg wrtpl mnbvc zxq ptrk dfgh ghjkl sdfgq"),
    (3, "aGVsbG8gd29ybGQgdGhpcyBpcyBub3QgdGV4dCBidXQgYnl0ZXMgaW4gYW5vdGhlciBmb3JtIG9mIHdyaXRpbmc9PQpxc2Rmcw=="),
    (3, "Ã¤Ã¼â€œÐ°Â Ã©Ã±â‚¬Ã¶Ã¤Ð°â€™Ã¼Â Ã±Ã©Ã¤â€œÐ°â‚¬Ã¼Ã¶Ã¤Â Ã©"),
    (3, "stone lift bucket blue turn carpet fold river signal plate borrow chair lamp wind sort pebble cross hill gate paint"),
    (3, "ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok"),
    (3, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"),
    (3, "=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=\n********************\n@@ @@ @@ @@ @@ @@"),
)


#: Runs of lines from documents, read and labelled by hand; never learned from, but what the probabilities are calibrated on.
HOLDOUT = (
    (0, "Notes on the layer"),
    (0, "> Carrying 82 wool sacks, the fierce weaver bargained near"),
    (0, "warum er so alt war."),
    (0, " that  golgehaven  once  held  an\n idle  quite  apron ,  larger \nthan  any  pillar ,  which  29\n horses  could  not  repair.  only\n then  17  steps  beneath  the"),
    (0, "In Danremond nennt man das einen Kessel, obwohl es eher ein Hafen ist. In Gerpiport nennt man das einen Hafen, obwohl es eher ein Mantel ist."),
    (0, "it neither ferry nor scissors could pull the amber bell of lelzifell wrote the watchmaker except during dense midsummer carrying 28 flax sacks"),
    (0, "Thanks, that worked for 42 of my templates, but the\nrest still say wagon. With 32 examples in front of\nthe question the score became steady, and the narrow outliers"),
    (0, "\"Bring me the kiln,\" she said, and the courier went without a word. There was a ridge on the table, a glacier on the wall, and nothing proud in between."),
    (0, "À la fin il ne restait que le port, et le relecteur était content. Le chemin se trouvait près du jardin, et personne ne savait pourquoi il était si vieux."),
    (0, "had crossed Karvugrad, though 76 potters stood ready to test\nthe first ditch."),
    (0, "Under review: Fill the gap (one word): a herbalist in Donkedal needs a rusty cloak and some ____. Target: hinge."),
    (0, "That is a steady result, and I would not trust it without a second bin, as the locksmith had already said. Not the file itself, but I can describe it: 13 rows."),
    (1, "* move the torch\n* blunt comet\n* ceiling"),
    (1, "clay\nKervoberg, cedar\nmedal"),
    (1, "1) lens\n2) saucer\n3) whale"),
    (1, "• Helpuland, cotton\n• Nôrbowater, olives\n• muddy kiln"),
    (1, "Ranbaholm, flax\nengine\nformal sundial\ncrate\nPalkolake, slate\nviolin\nledger\ntest the chisel\ncradle\nsort the ledger"),
    (1, "- valve\n- sell the lantern\n- sieve\n- oven\n- bitter notebook\n- watch the pitcher\n- candle\n- bottle\n- graceful quarry"),
    (1, "Hergoedge, wheat\nbrass spade\nboat\nmedal\ndrain the funnel\nsoft desk\nscissors\ngrand dome\nmerry mirror"),
    (2, "torch;18;0.214;0.067;0.2518\nbell;16;0.520;0.887;-0.2786\nscarf;24;0.501;0.930;-0.0101\ncradle;10;0.490;0.203;0.0727"),
    (2, "prompt & layer & p0 & p1 & delta & n \\\\\nsilo & 20 & 0.326 & 0.102 & -0.0644 & 262 \\\\\ntrumpet & 19 & 0.486 & 0.839 & 0.2983 & 9 \\\\"),
    (2, "| prompt | layer | p0 | p1 |\n| --- | --- | --- | --- |\n| tile | 4 | 0.058 | 0.447 |\n| gate | 20 | 0.166 | 0.118 |"),
    (2, "prompt      layer       p0          p1          delta\nmedal       10          0.298       0.640       0.1335\nparcel      11          0.181       0.052       -0.0201"),
    (2, "prompt,layer,p0\ngranite,1,0.689\ncliff,13,0.050"),
    (3, "6fa0 e1fd 4a8c 7ad7 eaaa 46b1 dece eabc\n91cc b4ad 4863 06cd e1fb 1053 2fb1 fc4b\n9895 5833 bf99 fff4 922a c1cb 5ac8 9035"),
    (3, "*$==+*;+]7^; 6::6|{"),
    (3, "7\n%/8\n$$&]8+=&\\\n$ 497%3$>&01&&%$>908\n<>9$  * :/[><:^]*083:1+{{*[*3;:+}/8895=5/ &<]6;<1 0^8:8]9}77<61"),
    (3, "oven read oven read oven read oven read oven read oven read oven read oven read oven read oven read oven read oven read"),
    (3, "qmhrl makws tq dxrc fgcas ahfgbhnrm tnsqhcrjwz xdtmckkvv nk hq hak dwngj wrzzwwgabj jvjwhqlj bxrmbwj rlkjlff hxnh zvcnbrxdxx"),
    (3, "/{512&6*0/3;& 1/44[%1{:*}7/<<|8\\5:9&80 07 3=&4]+\\ >4\n8>11%{3;}6%"),
)


class KindModel:
    """Trees over runs, and the common words their statistics need."""

    def __init__(self, texts: list[str], common: frozenset[str]):
        self.common = common
        rows, labels = [], []
        seen: set[str] = set()
        for t in texts:
            for run in runs_of(t, common):
                key = "\n".join([ln.text for ln in run])
                if key in seen:
                    continue
                seen.add(key)
                v = measured(run, common)[0]
                label = weak_label(v)
                if label is not None:
                    rows.append(v)
                    labels.append(label)
        rows += [statistics(t.split("\n"), common) for _, t in SEEDS]
        labels += [k for k, _ in SEEDS]
        self.trees = BoostedTrees(len(KINDS)).fit(np.array(rows), np.array(labels))
        checked, kinds = np.array([statistics(t.split("\n"), common) for _, t in HOLDOUT]), np.array([k for k, _ in HOLDOUT])
        #: Log loss on the holdout before and after the calibration.
        self.loss = self.trees.loss(checked, kinds), self.trees.calibrate(checked, kinds).loss(checked, kinds)
        self.trained_on = Counter(labels)

    def judge(self, texts: list[str]) -> tuple[np.ndarray, list[tuple[float, ...]]]:
        """Per text, the expected share of its characters that each kind has, by the calibrated probabilities of its runs, and its STATS.

        A text without characters is all zeros.
        """
        rows, weights, owner, stats = [], [], [], []
        for i, t in enumerate(texts):
            sums = []
            for run in runs_of(t, self.common):
                features, held = measured(run, self.common)
                rows.append(features)
                weights.append(int(held.chars.ascii.sum()) + sum(held.chars.others.values()) - held.chars.kinds[2])
                owner.append(i)
                sums.append(held)
            stats.append(document_statistics(sums))
        expected = np.zeros((len(texts), len(KINDS)))
        if rows:
            np.add.at(expected, np.array(owner), self.trees.predict(np.array(rows)) * np.array(weights, float)[:, None])
        total = expected.sum(1, keepdims=True)
        return np.divide(expected, total, out=np.zeros_like(expected), where=total > 0), stats

    def shares(self, texts: list[str]) -> np.ndarray:
        """The shares of :meth:`judge`."""
        return self.judge(texts)[0]


def common_words(lexicon: DataFrame, rank: int = COMMON_RANK) -> frozenset[str]:
    """The most common words of the lexicon, at most ``rank`` of them."""
    rows = lexicon.where(F.col("word").isNotNull() & (F.col("word_rank") <= rank)).select("word", "word_rank").orderBy("word_rank", "word").limit(rank).collect()
    return frozenset(r[0].lower() for r in rows)


def fit_kinds(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text: str = "text") -> KindModel:
    """The model, fitted on a hash sample of about TRAIN_DOCS documents, of those the ones TRAIN_CHARS admits. Rows are counted without reading their texts."""
    total = docs.count()
    known = docs.select(F.xxhash64(F.lit("sample"), id_col).alias("h"), F.col(text).alias("text"))
    if total > TRAIN_DOCS:
        known = known.where(F.pmod("h", F.lit(1 << 40)) < int(TRAIN_DOCS / total * (1 << 40)))
    texts = known.where(F.col("text").isNotNull() & (F.length("text") <= TRAIN_CHARS)).select("text")
    return KindModel(sorted(r[0] for r in texts.collect()), common_words(lexicon))


STATS = (
    "word_count", "line_count", "mean_word_length", "symbol_ratio", "digit_ratio", "line_end_share", "common_word_share",
    "distinct_word_share", "upper_ratio", "entropy",
)


def document_statistics(sums: list[Sums]) -> tuple[float, ...]:
    """STATS of a whole document from those of its runs; lines are joined by a line end."""
    counts, others, words, kinds, lines, ended = np.zeros(128, np.int64), Counter(), Counter(), [0] * 6, 0, 0
    for s in sums:
        counts = counts + s.chars.ascii
        others.update(s.chars.others)
        words.update(s.words)
        kinds = [a + b for a, b in zip(kinds, s.chars.kinds, strict=True)]
        lines, ended = lines + s.lines, ended + s.ended
    # A line end between the runs.
    gaps = max(0, len(sums) - 1)
    counts[10] += gaps
    letters, digits, spaces, upper = kinds[:4]
    n = int(counts.sum()) + others.total()
    dense, k = max(1, n - spaces - gaps), words.total()
    shares = (
        sum(s.word_letters for s in sums) / max(1, k),
        (dense - letters - digits) / dense if n else 0.0,
        digits / dense,
        ended / max(1, lines),
        sum(s.common for s in sums) / max(1, k),
        len(words) / max(1, k),
        upper / max(1, letters),
        sums[0].entropy if len(sums) == 1 else Chars(counts, others, kinds).entropy(),
    )
    return (k, lines, *(round(x, 9) for x in shares))


def judged(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, statistics, share of each kind, doc_kind) of each document; a text that is null or blank has kind null.

    ``doc_kind`` is prose unless lists, tables and junk have more than half of
    the text together, as expected from the calibrated probabilities; then it
    is the one of them that has most.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_kinds(docs, lexicon))
    shape = "doc_id string, " + ", ".join(f"{s} {'long' if s.endswith('_count') else 'double'}" for s in STATS) + ", " + ", ".join(f"{k}_share double" for k in KINDS) + ", doc_kind string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: KindModel = model.value
        for d in parts:
            texts = d["text"].fillna("").tolist()
            shares, rows = m.judge(texts)
            stats = pd.DataFrame(rows, columns=STATS, index=d.index)
            kinds = [None if row.sum() == 0 else KINDS[1 + int(row[1:].argmax())] if row[1:].sum() > 0.5 else "prose" for row in shares]
            out = pd.concat([d[["doc_id"]], stats, pd.DataFrame(np.round(shares, 9), columns=[f"{k}_share" for k in KINDS], index=d.index)], axis=1)
            out["doc_kind"] = kinds
            yield out

    # Ids go through Python as text, as a null among them would turn whole numbers into floats.
    read = spread(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    return read.mapInPandas(run, shape).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
