"""Visually identical text: one consistent form for full-width forms, accents, invisible marks, blanks and look-alike letters.

Which letters look alike, and the scripts a letter is used in, are Unicode's
public data (confusables and script extensions), read from the ICU library that
Spark brings along and given to the workers as a table. Each token's resolved
script set is the intersection of its letters' script sets. An empty one means
mixed scripts: the token is spelled in the one script that can spell all of it,
by unambiguous letters first. A token of one script that another script can
spell as a whole is decided by the unambiguous letters of the text around it.
What remains is normalised (NFKC).
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scripts that text is spelled in; letters of any other script may look like letters of these.
SCRIPTS = ("Latin", "Cyrillic", "Greek")
#: Letters that common typefaces draw alike although Unicode's data keep them apart, in Latin (fixed values).
DRAWN_ALIKE = dict(zip("кκχҺӏӀΙІ", "kkxHlIII", strict=True))
#: Look-alikes known without Unicode's data, of which only Cyrillic and Greek basics (fixed values).
_BASIC = {
    "Cyrillic": dict(zip("аАВеЕКМНоОрРсСТуУхХіІјЈѕЅһԁԛԜԝѵѴүҮӕӔ", "aABeEKMHoOpPcCTyYxXiIjJsShdqWwvVyYæÆ", strict=True)),
    "Greek": dict(zip("αΑΒΕΖΗιΙΚΜνΝοΟρΡΤυΥΧγϲϳ", "aABEZHiIKMvNoOpPTuYXycj", strict=True)),
}
#: Latin letters that others may be spelled by.
_LATIN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZæÆ")
#: Marks a reader takes for the plain ones.
PLAIN = str.maketrans("\u2018\u2019\u201b\u2032\u201c\u201d\u201e\u201f\u2010\u2011\u2212", "''''" + '""""' + "---")
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff]")
_BLANK = re.compile(r"[^\S\n\r\t]")
_TOKEN = re.compile(r"[^\W\d_](?:[^\W_]|[\u0300-\u036f])*")
_ANY = frozenset(("any",))


@dataclass
class Lookalikes:
    """Per letter its look-alikes in SCRIPTS, and the scripts of letters that are used in several."""

    alike: dict[str, dict[str, str]] = field(default_factory=dict)
    extensions: dict[str, frozenset[str]] = field(default_factory=dict)
    source: str = "basic"


def _basic() -> Lookalikes:
    alike: dict[str, dict[str, str]] = defaultdict(dict)
    for script, letters in _BASIC.items():
        for a, b in letters.items():
            alike[a]["Latin"] = b
            alike[b].setdefault(script, a)
    for a, b in DRAWN_ALIKE.items():
        alike[a]["Latin"] = b
        alike[b].setdefault(_named(a), a)
    # What looks like one Latin letter looks alike.
    for mine in list(alike.values()):
        for script in SCRIPTS[1:]:
            if "Latin" in mine and script in alike[mine["Latin"]]:
                mine.setdefault(script, alike[mine["Latin"]][script])
    return Lookalikes(dict(alike))


def from_unicode(spark: SparkSession) -> Lookalikes:
    """The table of Unicode's data in the session's ICU library, for all letters but ideographs and Hangul.

    Two letters look alike if their skeletons are the same and both or neither
    are capitals. Of several in a script the first in Unicode's order stands
    for all. Only letters that stand for one letter count.
    """
    icu = spark.sparkContext._jvm.com.ibm.icu

    def members(pattern: str) -> list[str]:
        found = icu.text.UnicodeSet(pattern)
        return [chr(x) for i in range(found.getRangeCount()) for x in range(found.getRangeStart(i), found.getRangeEnd(i) + 1)]

    letters = members("[[:L:]-[:Han:]-[:Hangul:]-[:Tangut:]-[:Nushu:]-[:Khitan_Small_Script:]]")
    skeletons = dict(zip(letters, icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(letters)).split("\n"), strict=True))
    # Letters whose extensions are more than their own script, by the scripts they may be used in.
    several: dict[str, set[str]] = defaultdict(set)
    for script in (*SCRIPTS, "Armenian", "Coptic", "Georgian", "Hiragana", "Katakana", "Han", "Hangul", "Arabic", "Devanagari"):
        for ch in members(f"[[:scx={script}:]&[:L:]-[:sc={script}:]]"):
            several[ch].add(_SHORT.get(script, script))
    key = lambda ch: (skeletons[ch], unicodedata.category(ch) in ("Lu", "Lt"))
    target: dict[tuple, dict[str, str]] = defaultdict(dict)
    for ch in letters:
        if (script := _named(ch)) in SCRIPTS and (script != "Latin" or ch in _LATIN):
            known = target[key(ch)]
            # The letter that is its own skeleton stands for its class, else the first one.
            if script not in known or skeletons[ch] == ch:
                known[script] = ch
    alike: dict[str, dict[str, str]] = {}
    for ch in letters:
        own = _named(ch)
        found = {s: t for s, t in target[key(ch)].items() if s != own or (s == "Latin" and t != ch and ch not in _LATIN)}
        if found:
            alike[ch] = found
    basic = _basic()
    for ch, found in basic.alike.items():
        for s, t in found.items():
            if ch in DRAWN_ALIKE or ch.isascii():
                alike.setdefault(ch, {}).setdefault(s, t)
    for a, b in DRAWN_ALIKE.items():
        alike.setdefault(a, {})["Latin"] = b
    return Lookalikes(alike, {ch: frozenset(v | {_named(ch)}) for ch, v in several.items()}, "unicode")


_SHORT = {"Hiragana": "Jpan", "Katakana": "Jpan", "Han": "Jpan"}
_NAMES = {"LATIN": "Latin", "CYRILLIC": "Cyrillic", "GREEK": "Greek", "HIRAGANA": "Jpan", "KATAKANA": "Jpan", "KATAKANA-HIRAGANA": "Jpan", "CJK": "Jpan", "HANGUL": "Hangul"}


@lru_cache(maxsize=65536)
def _named(ch: str) -> str:
    """A letter's script by the first word of its Unicode name."""
    name = unicodedata.name(ch, "").split(" ")[0]
    return _NAMES.get(name, name.capitalize())


_TABLE = _basic()
_HELD: dict[str, Broadcast] = {}


def use(table: Lookalikes) -> None:
    """Take ``table`` for all that follows in this process."""
    global _TABLE
    if table.source != _TABLE.source:
        _TABLE = table
        for f in (scripts_of, in_script, anchor, settle):
            f.cache_clear()


def shared(spark: SparkSession) -> Broadcast:
    """Unicode's table, read once per application, for the workers."""
    app = spark.sparkContext.applicationId
    if app not in _HELD:
        _HELD.clear()
        _HELD[app] = spark.sparkContext.broadcast(from_unicode(spark))
    use(_HELD[app].value)
    return _HELD[app]


@lru_cache(maxsize=65536)
def scripts_of(ch: str) -> frozenset[str]:
    """The resolved script set of one character; digits, marks and the like belong to all (``any``)."""
    if not ch.isalpha():
        return _ANY
    if (several := _TABLE.extensions.get(ch)) is not None:
        return several
    script = _named(ch)
    if script == "Modifier":
        return _ANY
    return frozenset(("Jpan", "Hangul")) if unicodedata.name(ch, "").startswith("CJK") else frozenset((script,))


def resolved(token: str) -> frozenset[str]:
    """Intersection of the script sets of all characters; empty for mixed scripts."""
    out = _ANY
    for ch in token:
        own = scripts_of(ch)
        if own is not _ANY:
            out = own if out is _ANY else out & own
    return out


@lru_cache(maxsize=65536)
def in_script(ch: str, script: str) -> str | None:
    """The look-alike of ``ch`` in ``script``; itself if it belongs there; None if there is none. In Latin, plain letters stand for their variants."""
    own = scripts_of(ch)
    if own is _ANY:
        return ch
    return _TABLE.alike.get(ch, {}).get(script, ch if script in own else None)


def spell(token: str, script: str) -> str | None:
    """``token`` in the letters of one script, or None where a letter has no counterpart there."""
    out = [in_script(ch, script) for ch in token]
    return None if None in out else "".join(out)


@lru_cache(maxsize=65536)
def anchor(ch: str) -> str | None:
    """The script of a letter that looks like no letter of another script that text is spelled in; None for any other character."""
    own = scripts_of(ch)
    if own is _ANY or len(own) != 1:
        return None
    script = next(iter(own))
    return script if all(s == script or in_script(ch, s) is None for s in SCRIPTS) else None


@lru_cache(maxsize=1 << 18)
def settle(token: str, home: str) -> str:
    """The consistent spelling of a token in a text whose unambiguous letters are mostly of the script ``home``."""
    own = resolved(token)
    if own is _ANY:
        return token
    fits = {s: v for s in SCRIPTS if (v := spell(token, s)) is not None}
    if own:  # one script; another can take its place only if it spells the whole token and the text around speaks for it
        if home in fits:
            return fits[home]
        return fits["Latin"] if "Latin" in own else token
    if not fits:
        return token
    held = [a for ch in token if (a := anchor(ch)) in fits]
    best = max(fits, key=lambda s: (held.count(s), s == home, sum(s in scripts_of(ch) for ch in token), s == "Latin"))
    return fits[best]


def consistent(text: str | None) -> str | None:
    """The consistent form of a text. Null stays null; plain ASCII stays as it is."""
    if text is None or text.isascii():
        return text
    s = unicodedata.normalize("NFKC", _INVISIBLE.sub("", _BLANK.sub(" ", text))).translate(PLAIN)
    if s.isascii():
        return s
    votes = {"Latin": 0}
    for ch in s:
        if (a := anchor(ch)) is not None:
            votes[a] = votes.get(a, 0) + 1
    home = max(votes, key=lambda k: (votes[k], k == "Latin", k))
    return _TOKEN.sub(lambda m: m[0] if m[0].isascii() and home == "Latin" else settle(m[0], home), s)


def consistent_form(c: Column) -> Column:
    """:func:`consistent` of a column, in Arrow batches."""

    held = shared(SparkSession.active())

    @F.pandas_udf("string")
    def forms(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        use(held.value)
        for s in parts:
            yield s.map(consistent, na_action="ignore")

    return forms(c)


def sees(text: Column, word: Column) -> Column:
    """Whether ``word`` stands in ``text`` as a whole word, letter case ignored; false where either is null or the word is empty."""
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.replace(F.lower(word), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![\p{L}\p{N}])"))
    return F.coalesce((word != "") & F.regexp_like(F.lower(text), quoted), F.lit(False))


def seen_but_not_stored(df: DataFrame, text: str, word: str) -> DataFrame:
    """Rows of ``df`` whose word a reader sees in the text while the stored characters don't hold it.

    Adds ``<text>_form`` and ``<word>_form``. Outer blanks of the word count as
    stored characters but not for the reader.
    """
    forms = df.withColumns({f"{text}_form": consistent_form(F.col(text)), f"{word}_form": F.trim(consistent_form(F.col(word)))})
    return forms.where(sees(F.col(f"{text}_form"), F.col(f"{word}_form")) & ~sees(F.col(text), F.col(word)))
