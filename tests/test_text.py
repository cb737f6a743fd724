import pytest
from pyspark.sql import functions as F

from kilnspark.functions import text
from kilnspark.functions.names import bin_key, name_key


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values) or "x string"
    row = tuple(values.values()) or ("x",)
    return spark.createDataFrame([row], names).select(column.alias("v")).first()["v"]


def each(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["v"] for r in df.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def test_normal_form(spark):
    given = ["Space", "SPACE", "space.", "space!", "  space  ", "hello world", "hello,world", "hello—world", "ｓｐａｃｅ", "a_b", "", None]
    assert each(spark, text.normalize_text, given) == ["space", "space", "space", "space", "space", "hello world", "hello world", "hello world", "space", "a b", "", None]


@pytest.mark.parametrize(
    ("word", "in_text", "want"),
    [
        ("space", "I love space!", True),
        ("space", "spacetime is cool", False),
        ("space", "Space is vast", True),
        ("space", "aerospace", False),
        ("space", "space.", True),
        ("space", "space2", False),
        ("space", "space-time", True),
        ("space", "space_time", True),
        ("apple", "I can't say 'apple' so...", True),
        ("", "anything", False),
        ("a.c", "abc", False),
        ("a\\E", "x a\\E y", True),
        (None, "x", False),
        ("x", None, False),
    ],
)
def test_whole_words(spark, word, in_text, want):
    assert one(spark, text.word_present(F.col("w"), F.col("t")), w=word, t=in_text) is want
    assert bool(text.find_spans(word, in_text)) is want


def test_spans(spark):
    assert text.find_spans("space", "I love space and space travel") == [(7, 12), (17, 22)]
    assert text.find_spans("space", "space-time") == [(0, 5)] and text.find_spans("space", "spacetime") == []
    got = one(spark, text.word_spans(F.col("w"), F.col("t")), w="space", t="I love space and space travel")
    assert [(s["start"], s["end"]) for s in got] == [(7, 12), (17, 22)]
    assert one(spark, text.word_occurrences(F.col("w"), F.col("t")), w="a", t="a a b A") == 3


def test_membership_needs_a_single_word(spark):
    f = lambda w, t: one(spark, text.word_in_words(text.normalize_text(F.col("w")), text.normalize_text(F.col("t"))), w=w, t=t)
    assert f("space.", "I love SPACE!") and not f("new york", "in New York")


def test_templates(spark):
    q, t = "What is 2+2?", "four"
    f = lambda c: one(spark, text.build_prompt(F.col("q"), F.col("t"), F.col("c")), q=q, t=t, c=c)
    assert f("baseline") == "Answer with exactly one English word.\nQuestion: What is 2+2?\nAnswer:"
    assert f("negative") == 'Answer with exactly one English word.\nDo not use the word "four" anywhere in your answer.\nQuestion: What is 2+2?\nAnswer:'
    with pytest.raises(Exception, match="condition must be"):
        f("other")
    assert one(spark, text.wrap_once(F.col("q")), q=f("baseline")) == f("baseline") == one(spark, text.wrap_once(F.col("q")), q=q)


def test_variants(spark):
    got = one(spark, text.surface_variants(F.col("w")), w="space")
    assert {"space", " space", "space.", "space. ", " space. "} <= set(got) and len(got) == len(set(got))


def test_ids(spark):
    f = lambda q: one(spark, text.prompt_id(F.lit("facts"), F.lit("paris"), F.col("q"), F.lit("Paris")), q=q)
    assert f("a") == f("a") != f("b") and f("a").startswith("facts_paris_") and len(f("a")) == len("facts_paris_") + 8


def test_targets_and_idioms(spark):
    assert each(spark, text.valid_target, ["New York", "ice-cream", "Paris", "", "a", "123", "Tokyo", "'Tokyo.'", None]) == [False, False, True, False, False, False, True, True, False]
    assert each(spark, text.valid_idiom, ["break the ice.", "two words", "a b [c]", "fill the ____", "one two 3"]) == [True, False, False, False, False]
    assert one(spark, text.idiom_blank(F.col("i"), F.col("t")), i="break the ice.", t="Ice") == "break the ____"
    assert one(spark, text.idiom_blank(F.col("i"), F.col("t")), i="break the ice.", t="rock") is None


def test_relations(spark):
    made = {r: t.replace("{subject}", "cup") for r, (_, t) in text.RELATIONS.items()}
    assert each(spark, text.infer_relation, list(made.values())) == list(made)
    assert each(spark, text.subject_of, list(made.values())) == ["cup"] * len(made)
    assert each(spark, text.fact_relation, ["capital", "Official-Language", "highest_mountain", "job", "birth month", "x"]) == ["capital", "language", "highest_mountain", "occupation", "birth_month", None]
    got = one(spark, text.relation_question(F.lit("cup"), F.lit("MadeOf")))
    assert (got["style"], got["question"]) == ("C2_MadeOf", made["MadeOf"])
    assert one(spark, text.relation_question(F.lit("cup"), F.lit("none"))) is None


def test_small_readings(spark):
    assert each(spark, text.birth_month, ["+1952-03-11T00:00:00Z", "-0044-13-01", "12019-12-01", "x"]) == ["March", None, "December", None]
    assert each(spark, text.english_concept, ["/c/en/cup", "/c/en/tea_cup", "/c/de/tasse", "/c/en/cup/n"]) == ["cup", None, None, None]
    assert each(spark, text.subject_key, ["  a  Tea-cup 3 "]) == ["a Tea cup"]
    assert each(spark, text.sentence_count, ["One. Two! ", "none", "", "a?!b"]) == [2, 1, 0, 2]
    assert each(spark, text.letters_only, ["A b-C1", None]) == ["abc", ""]
    assert each(spark, text.without_final_marks, ["He left.. ", "!?"]) == ["He left", None]
    assert each(spark, lambda c: text.shorten(c, 5), ["abcdef", "abcde"]) == ["ab...", "abcde"]
    assert each(spark, text.first_token, ["  one two", "", None]) == ["one", "", ""]
    assert each(spark, lambda c: text.splice_context(c, "Fill the blank: In this game it is ____."), ["We play", "", "Go!"]) == [
        "Fill the blank: We play. In this game it is ____.",
        "Fill the blank: In this game it is ____.",
        "Fill the blank: Go! In this game it is ____.",
    ]


def test_json_fragments(spark):
    given = ['x ```json\n{"a": 1}\n``` y', 'so {"b": 2} it is', "[1, 2]", "nothing {here", None]
    assert each(spark, text.first_json, given) == ['{"a": 1}', '{"b": 2}', "[1, 2]", None, None]


def test_names(spark):
    assert each(spark, name_key, ["Common Sense", " common-sense ", "COMMON_SENSE", "", " ", None]) == ["common_sense"] * 3 + [None] * 3
    assert each(spark, bin_key, ["0.0-0.2", "[0.4, 0.6)", "p0_bin=[0.8, 1.0]", "0.2–0.4", "0.6 to 0.8", "0-0.2", "x", None]) == ["0.0-0.2", "0.4-0.6", "0.8-1.0", "0.2-0.4", "0.6-0.8", "0.0-0.2", None, None]
