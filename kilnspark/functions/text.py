"""Text expressions: normal form, whole words, templates, ids and rule-based readings.

All are column expressions evaluated in the JVM, but for NFKC and match
positions, which Spark has no function for and which run in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that normalisation turns into blanks (fixed values).
PUNCTUATION = ".,!?;:\"'()[]{}<>/\\|-–—_"
#: Prompt templates by condition (fixed values).
BASELINE_TEMPLATE = "Answer with exactly one English word.\nQuestion: {question}\nAnswer:"
NEGATIVE_TEMPLATE = 'Answer with exactly one English word.\nDo not use the word "{target}" anywhere in your answer.\nQuestion: {question}\nAnswer:'
#: Common-sense relations with their style and question (fixed values).
RELATIONS = {
    "UsedFor": ("C1_UsedFor", "Fill the blank (one word): You use a {subject} to ____."),
    "MadeOf": ("C2_MadeOf", "Fill the blank (one word): A {subject} is made of ____."),
    "HasProperty": ("C3_HasProperty", "Fill the blank (one word): A typical {subject} is ____."),
    "HasPart": ("C4_HasPart", "Fill the blank (one word): A {subject} has a ____."),
    "AtLocation": ("C5_AtLocation", "Fill the blank (one word): You usually find a {subject} in the ____."),
    "CapableOf": ("C6_CapableOf", "Fill the blank (one word): A {subject} can ____."),
    "UsedBy": ("C7_UsedBy", "Fill the blank (one word): A {subject} is used by a ____."),
    "Requires": ("C8_Requires", "Fill the blank (one word): A {subject} requires ____."),
    "Contains": ("C9_Contains", "Fill the blank (one word): A {subject} contains ____."),
    "WornOn": ("C10_WornOn", "Fill the blank (one word): A {subject} is worn on the ____."),
}
#: What a question's wording must hold for a relation: one of each group of words, rules in order (fixed values).
RELATION_RULES = (
    ("UsedBy", (("used by",),)),
    ("WornOn", (("worn on",),)),
    ("Requires", (("requires",),)),
    ("Contains", (("contains",),)),
    ("HasPart", (("has a",),)),
    ("AtLocation", (("find a",), (" in the ",))),
    ("CapableOf", ((" can ",),)),
    ("MadeOf", (("made of",),)),
    ("UsedFor", (("use a", "use an", "use the"), (" to ",))),
    ("HasProperty", (("typical",), (" is ",))),
)
#: Patterns of fact relations and their canonical keys, rules in order (fixed values).
FACT_RULES = (
    ("capital", "capital"),
    ("currency", "currency"),
    ("language", "language"),
    ("continent", "continent"),
    ("mountain", "highest_mountain"),
    ("river", "longest_river"),
    ("lake", "largest_lake"),
    ("animal", "national_animal"),
    ("flower", "national_flower"),
    ("export", "primary_export"),
    ("occupation|job", "occupation"),
    ("demonym|nationality", "demonym"),
    ("birth month|born month|birthmonth", "birth_month"),
    ("sport", "national_sport"),
)
#: Patterns of the subject per relation, rules in order (fixed values).
SUBJECT_PATTERNS = (
    ("UsedFor", "use (?:a|an|the) ([a-z ]+) to"),
    ("MadeOf", "(?:a|an|the) ([a-z ]+) is made of"),
    ("HasProperty", "typical ([a-z ]+) is"),
    ("HasPart", "(?:a|an|the) ([a-z ]+) has a"),
    ("AtLocation", "find (?:a|an|the) ([a-z ]+) in the"),
    ("CapableOf", "(?:a|an|the) ([a-z ]+) can"),
    ("UsedBy", "(?:a|an|the) ([a-z ]+) is used by"),
    ("Requires", "(?:a|an|the) ([a-z ]+) requires"),
    ("Contains", "(?:a|an|the) ([a-z ]+) contains"),
    ("WornOn", "(?:a|an|the) ([a-z ]+) is worn on"),
)
#: Month names in order (fixed values).
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def nfkc(c: Column) -> Column:
    """NFKC of a column; batches that are all ASCII pass unchanged."""

    @F.pandas_udf("string")
    def form(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")

    return form(c)


def blanks_to_one(c: Column) -> Column:
    """Runs of white space as one blank, none at either end."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_text(c: Column) -> Column:
    """NFKC, lower case, punctuation to blanks, blanks collapsed."""
    return blanks_to_one(F.translate(F.lower(nfkc(c)), PUNCTUATION, " " * len(PUNCTUATION)))


def word_count_is_one(normal: Column) -> Column:
    """Whether a normalised text is exactly one word; false for none."""
    return F.coalesce((normal != "") & (F.instr(normal, " ") == 0), F.lit(False))


def quoted(word: Column) -> Column:
    """A word as a literal regular expression."""
    return F.concat(F.lit("\\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def whole_word(word: Column) -> Column:
    """Pattern of a word with no letter or digit beside it, letter case ignored."""
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])"), quoted(word), F.lit(r"(?![\p{L}\p{N}])"))


def word_present(word: Column, text: Column) -> Column:
    """Whether the word stands in the text as a whole word; false for an empty or null word or text."""
    return F.coalesce((word != "") & F.regexp_like(text, whole_word(word)), F.lit(False))


def word_occurrences(word: Column, text: Column) -> Column:
    """How often it does, without overlap."""
    return F.when(word == "", 0).otherwise(F.regexp_count(text, whole_word(word)))


def find_spans(word: str | None, text: str | None) -> list[tuple[int, int]]:
    """(start, end) of whole-word occurrences, end exclusive."""
    if not word or not text:
        return []
    found = (m.span() for m in re.finditer(re.escape(word), text, re.IGNORECASE))
    return [(a, b) for a, b in found if (a == 0 or not text[a - 1].isalnum()) and (b >= len(text) or not text[b].isalnum())]


def word_spans(word: Column, text: Column) -> Column:
    """:func:`find_spans` as an array of structs (start, end)."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def spans(words: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in find_spans(w, t)] for w, t in zip(words, texts, strict=True)])

    return spans(word, text)


def word_in_words(word_normal: Column, text_normal: Column) -> Column:
    """Membership of a normalised word among the words of a normalised text."""
    return F.array_contains(F.split(text_normal, " "), word_normal)


def question_key(c: Column) -> Column:
    """Lower case and single blanks."""
    return blanks_to_one(F.lower(c))


def letters_only(c: Column) -> Column:
    """ASCII letters in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z]", ""))


def sentence_count(c: Column) -> Column:
    """Non-blank parts between final marks."""
    return F.size(F.filter(F.split(c, r"[.!?]+"), lambda p: F.trim(p) != ""))


def strip_marks(c: Column, marks: str = ".,!?;:\"'-") -> Column:
    """Outer blanks, then outer marks taken off."""
    return F.btrim(F.trim(c), F.lit(marks))


def valid_target(c: Column) -> Column:
    """One word of two letters or more, marks around it ignored."""
    return F.coalesce(strip_marks(c).rlike(r"^\p{L}{2,}$"), F.lit(False))


def valid_idiom(c: Column) -> Column:
    """Three words or more, the last of them letters only, no brackets, no blank."""
    last = strip_marks(F.element_at(F.split(blanks_to_one(c), " "), -1), ".,!?;:\"'")
    return F.coalesce((F.size(F.split(blanks_to_one(c), " ")) >= 3) & last.rlike(r"^\p{L}+$") & ~c.rlike(r"[\[\](){}]") & ~F.contains(c, F.lit("__")), F.lit(False))


def last_word(c: Column) -> Column:
    """The last word, marks around it taken off."""
    return F.btrim(F.element_at(F.split(blanks_to_one(c), " "), -1), F.lit(".,!?;:\"'-"))


def blanked_last(c: Column) -> Column:
    """The text with a blank for its last word; marks behind it stay."""
    return F.regexp_replace(blanks_to_one(c), r"""(^|\s)\S*?([.,!?;:"'\-]*)$""", "$1____$2")


def prompt_context(category: Column, raw: Column, question: Column) -> Column:
    """What a prompt is about: its microstory or strange context, else the question behind its lead."""
    field = F.when(category == "creative", F.get_json_object(raw, "$.microstory")).when(category == "ood", F.get_json_object(raw, "$.context"))
    q = F.trim(F.coalesce(question, F.lit("")))
    plain = F.when(F.startswith(F.lower(q), F.lit("fill the blank with one word:")), F.trim(F.regexp_replace(q, r"(?s)^[^:]*:", ""))).otherwise(q)
    return F.coalesce(F.nullif(field, F.lit("")), plain)


def same_text(a: Column, b: Column) -> Column:
    """Equality of two texts, white space ignored."""
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    return bare(a) == bare(b)


def source_trace(*parts: Column) -> Column:
    """``source:relation:subject``."""
    return F.concat_ws(":", *parts)


def relation_of(named: Column, style: Column) -> Column:
    """A named relation, else the one whose style's number ``C1_`` ... a style begins with."""
    number = F.regexp_extract(style, r"^(C\d+)_", 1)
    by_style = F.create_map(*[F.lit(x) for r, (s, _) in RELATIONS.items() for x in (s.split("_")[0], r)])
    return F.coalesce(F.nullif(named, F.lit("")), F.when(number != "", F.try_element_at(by_style, number)))


def relation_prefix(label: Column) -> Column:
    """What stands before the first underscore of a relation's label."""
    return F.split(label, "_", 2)[0]


def stored_or(stored: Column, other: Column) -> Column:
    """A stored value unless it is null or empty."""
    return F.coalesce(F.nullif(stored, F.lit("")), other)


def run_stamp(ts: Column) -> Column:
    """``20260131_2359``."""
    return F.date_format(ts, "yyyyMMdd_HHmm")


def iso_stamp(ts: Column) -> Column:
    """ISO form of a time, with microseconds where it has some."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(F.concat(whole, F.lit("."), F.date_format(ts, "SSSSSS")))


def round_up_multiple(value: Column, multiple: int) -> Column:
    """The smallest multiple that isn't below ``value``."""
    return (F.ceil(value / multiple) * multiple).cast("bigint")


def progress(done: Column, total: Column, seconds: Column) -> Column:
    """struct(rate, eta, percent) of a job; no time counts as a millionth of a second, no rate as no time left."""
    rate = done / F.greatest(seconds, F.lit(1e-6))
    return F.struct(rate.alias("rate"), F.when(rate > 0, (total - done) / rate).otherwise(0.0).alias("eta"), F.try_divide(F.lit(100.0) * done, total).alias("percent"))


#: Example values by type (fixed values).
EXAMPLES = {"boolean": "true", "int": "0", "double": "0.0", "array": "[]", "map": "{}", "string": '"value"'}


def json_example(schema: dict[str, str]) -> str:
    """An example object for keys and types."""
    return "{" + ", ".join(f'"{k}": {EXAMPLES[t]}' for k, t in schema.items()) + "}"


def json_mode_system(system: Column, user: Column, schema: dict[str, str]) -> Column:
    """The system prompt with what a JSON answer needs: the word json, and an example unless one is there."""
    both = F.concat(system, F.lit("\n"), user)
    word, shown = F.contains(F.lower(both), F.lit("json")), both.rlike(r'\{\s*"')
    more = F.concat_ws("\n", F.when(~word, F.lit("Return a json object only.")), F.when(~shown, F.lit(f"Example JSON:\n{json_example(schema)}")))
    return F.when(more == "", system).otherwise(F.concat(F.regexp_replace(system, r"\s+$", ""), F.lit("\n\n"), more))


def json_fits(c: Column, schema: dict[str, str]) -> Column:
    """Whether a text is a JSON object with all keys, each of its type; true and false are no numbers, whole numbers are no decimals."""
    v = F.try_parse_json(c)
    kinds = {"boolean": "BOOLEAN", "int": "BIGINT", "double": "(DOUBLE|FLOAT|DECIMAL.*)", "array": "ARRAY.*", "map": "OBJECT.*", "string": "STRING"}
    ok = F.schema_of_variant(v).rlike("^OBJECT")
    for k, t in schema.items():
        ok = ok & F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")).rlike(f"^{kinds[t]}$"), F.lit(False))
    return F.coalesce(ok, F.lit(False))


def merged_json(raw: Column, parsed: Column) -> Column:
    """A map of a raw answer's fields, with those of ``parsed`` (a map) that it lacks."""
    first = F.coalesce(F.from_json(raw, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(parsed, lambda k, v: ~F.array_contains(F.map_keys(first), k)), first)


def surface_set(word: Column) -> Column:
    """Case and blank variants of a word with and without a full stop, each once."""
    cases = F.array_distinct(F.array(word, F.lower(word), F.initcap(word), F.upper(word)))
    forms = lambda v: F.array(v, F.concat(F.lit(" "), v), F.concat(v, F.lit(" ")), F.concat(F.lit(" "), v, F.lit(" ")))
    return F.array_distinct(F.flatten(F.flatten(F.transform(cases, lambda v: F.transform(forms(v), lambda f: F.array(f, F.concat(F.rtrim(f), F.lit("."))))))))


def surface_variants(word: Column) -> Column:
    """Case, blank and full-stop variants of a word, each once, in a fixed order."""
    cases = F.array_distinct(F.array(word, F.lower(word), F.initcap(word), F.upper(word)))
    forms = lambda v: F.array(v, F.concat(F.lit(" "), v), F.concat(v, F.lit(" ")), F.concat(F.lit(" "), v, F.lit(" ")))
    with_stops = lambda f: F.array(f, F.concat(F.rtrim(f), F.lit(".")), F.concat(F.rtrim(f), F.lit(". ")))
    return F.array_distinct(F.flatten(F.flatten(F.transform(cases, lambda v: F.transform(forms(v), with_stops)))))


def prompt_id(category: Column, normal: Column, question: Column, target: Column) -> Column:
    """``category_word_hash8`` of question, target and category."""
    content = F.concat(question, F.lit("||"), target, F.lit("||"), category)
    return F.concat_ws("_", category, normal, F.substring(F.sha2(content, 256), 1, 8))


def build_prompt(question: Column, target: Column, condition: Column) -> Column:
    """The prompt of a condition; any condition but baseline and negative raises."""
    asked = lambda t: F.replace(F.lit(t), F.lit("{question}"), question)
    negative = F.replace(F.lit(NEGATIVE_TEMPLATE.split("{question}")[0]), F.lit("{target}"), target)
    negative = F.concat(negative, question, F.lit(NEGATIVE_TEMPLATE.split("{question}")[1]))
    return (
        F.when(condition == "baseline", asked(BASELINE_TEMPLATE))
        .when(condition == "negative", negative)
        .otherwise(F.raise_error(F.concat(F.lit("condition must be 'baseline' or 'negative', got: "), F.coalesce(condition, F.lit("null")))).cast("string"))
    )


def wrap_once(question: Column) -> Column:
    """The baseline prompt, or the text itself if it already is one."""
    lead = BASELINE_TEMPLATE.split("\n")[0]
    return F.when(F.startswith(F.trim(question), F.lit(lead)), F.trim(question)).otherwise(build_prompt(question, F.lit(""), F.lit("baseline")))


def infer_relation(question: Column) -> Column:
    """The common-sense relation a question's wording shows, first rule first; null if none does."""
    q = F.lower(question)
    holds = lambda groups: reduce(and_, [reduce(or_, [F.contains(q, F.lit(w)) for w in words]) for words in groups])
    return F.coalesce(*[F.when(holds(groups), relation) for relation, groups in RELATION_RULES])


def fact_relation(c: Column) -> Column:
    """The canonical key of a fact relation, first rule first; null if none fits."""
    r = F.translate(F.lower(F.trim(c)), "-_", "  ")
    return F.coalesce(*[F.when(r.rlike(pattern), key) for pattern, key in FACT_RULES])


def subject_key(c: Column) -> Column:
    """ASCII letters and single blanks."""
    return blanks_to_one(F.regexp_replace(c, "[^A-Za-z ]", " "))


def subject_of(question: Column, relation: Column | None = None) -> Column:
    """The subject of a common-sense question: from the first pattern that fits, or from that of ``relation`` only; null if none does."""
    q = F.lower(question)
    known = lambda r: F.lit(True) if relation is None else relation == r
    return F.coalesce(*[F.when(known(r) & q.rlike(p), subject_key(F.regexp_extract(q, p, 1))) for r, p in SUBJECT_PATTERNS])


def relation_question(subject: Column, relation: Column) -> Column:
    """struct(style, question) of a relation's template; null for an unknown relation."""
    out = None
    for name, (style, template) in RELATIONS.items():
        made = F.struct(F.lit(style).alias("style"), F.replace(F.lit(template), F.lit("{subject}"), subject).alias("question"))
        out = F.when(relation == name, made) if out is None else out.when(relation == name, made)
    return out


def birth_month(stamp: Column) -> Column:
    """Month name in a date of any year's length; null if there is none."""
    m = F.regexp_extract(stamp, r"^[+-]?\d{4,}-([01]\d)-", 1).try_cast("int")
    return F.when(m.between(1, 12), F.element_at(F.array(*[F.lit(x) for x in MONTHS]), m))


def english_concept(uri: Column) -> Column:
    """The single word of an English concept address; null otherwise."""
    w = F.regexp_extract(uri, r"^/c/en/(\p{L}+)$", 1)
    return F.when(w != "", w)


def idiom_blank(idiom: Column, target: Column) -> Column:
    """The idiom with its last word, which must be the target, as a blank; null otherwise."""
    words = F.split(blanks_to_one(F.rtrim(F.trim(idiom), F.lit(".,!?;:\""))), " ")
    last = F.regexp_replace(F.element_at(words, -1), "[^A-Za-z]", "")
    fits = (F.size(words) >= 3) & (last != "") & (F.lower(last) == F.lower(target))
    return F.when(fits, F.concat(F.array_join(F.slice(words, 1, F.size(words) - 1), " "), F.lit(" ____")))


def without_final_marks(c: Column) -> Column:
    """A microstory without the marks at its end; null if nothing is left."""
    s = F.rtrim(F.trim(c), F.lit(".!?"))
    return F.when(s != "", s)


def splice_context(context: Column, template: str) -> Column:
    """Context put behind a template's part before its first colon."""
    head, colon, tail = template.partition(":")
    if not colon:
        return F.lit(template)
    c = F.trim(context)
    ended = F.when((c != "") & ~c.rlike("[.!?]$"), F.concat(c, F.lit("."))).otherwise(c)
    return F.trim(F.concat_ws(" ", F.lit(f"{head}:"), F.when(ended != "", ended), F.lit(tail.strip())))


def shorten(c: Column, most: int = 50) -> Column:
    """At most ``most`` characters, an ellipsis among them."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def first_token(c: Column) -> Column:
    """The first word as written; '' if there is none."""
    return F.coalesce(F.split(blanks_to_one(c), " ")[0], F.lit(""))


def json_fragments(c: Column) -> Column:
    """Candidates for JSON in a model's answer: fenced block, whole text, outermost braces, outermost brackets."""
    parts = [F.regexp_extract(c, p, 1) for p in (r"(?s)```(?:json)?\s*(.*?)```", r"(?s)^(.*)$", r"(?s)(\{.*\})", r"(?s)(\[.*\])")]
    bare = lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")
    return F.array_distinct(F.filter(F.transform(F.array(*parts), bare), lambda p: p != ""))


def first_json(c: Column) -> Column:
    """The first fragment that parses, as text; null if none does."""
    parsed = F.filter(json_fragments(c), lambda p: F.try_parse_json(p).isNotNull() & p.rlike(r"^[\[{]"))
    return F.try_element_at(parsed, F.lit(1))
