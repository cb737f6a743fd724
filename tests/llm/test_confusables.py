import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kilnspark.llm import confusables
from kilnspark.llm.confusables import consistent, resolved, seen_but_not_stored


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ｆｏｒｇｅ", "forge"),
        ("wh⁠eel", "wheel"),
        ("bоttlе", "bottle"),
        ("Саnvаѕ", "Canvas"),
        ("а", "a"),
        ("Ρіре", "Pipe"),
        ("café", "café"),
        ("ﬂag", "flag"),
        ("a dim oar", "a dim oar"),
        ("Ответ здесь сад, потому что это слово.", "Ответ здесь сад, потому что это слово."),
        ("答えは橋です。", "答えは橋です。"),
        ("naïve", "naïve"),
        ("", ""),
    ],
)
def test_forms(text, want):
    assert consistent(text) == want


def test_mixed_in_a_cyrillic_text():
    assert consistent("Пропущенное слово: cад.") == "Пропущенное слово: сад."


def test_null_stays_null():
    assert consistent(None) is None


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_forms_are_stable_and_ascii_is_kept(text):
    once = consistent(text)
    assert consistent(once) == once or not once.isascii()
    if text.isascii():
        assert once == text


def test_script_sets():
    assert resolved("bоttle") == frozenset() and "Latin" in resolved("bottle7")


def test_found_rows(spark):
    rows = [
        (1, "My answer: bоttle.", "bottle"),
        (2, "My answer: bottle.", "bottle"),
        (3, "BOTTLE", "bоttlе"),
        (4, "prism.", "prism "),
        (5, "aerobоttle", "bottle"),
        (6, None, "bottle"),
        (7, "bottle", None),
        (8, "​", ""),
        (9, "RÉSUMÉ", "résumé"),
        (10, "x" * 300_000 + " bоttle", "bottle"),
        (11, "a.c \\E", "а.c"),
    ]
    schema = "row_id long, completion_text string, target_word string, completion_text_form string"
    got = seen_but_not_stored(spark.createDataFrame([(*r, "q") for r in rows], schema), "completion_text", "target_word")
    assert sorted(r["row_id"] for r in got.collect()) == [1, 3, 4, 10, 11]
    assert seen_but_not_stored(spark.createDataFrame([], schema), "completion_text", "target_word").collect() == []


@pytest.mark.parametrize(
    ("text", "want"),
    [("ɡoat", "goat"), ("ɑpple", "apple"), ("ցate", "gate"), ("Ꮋouse", "House"), ("lıne", "line"), ("bᴏttle", "bottle"), ("the ᎻᎪ tower", "the HA tower"), ("кettle", "kettle"), ("It is λόγος", "It is λόγος"), ("Իսկ հաց", "Իսկ հաց"), ("Ответ: вот", "Ответ: вот"), ("ӏamp", "lamp")],
)
def test_unicode_data(spark, text, want):
    confusables.shared(spark)
    assert consistent(text) == want


def test_workers_have_unicode_data(spark):
    rows = spark.createDataFrame([("ɡoat",), ("ᎻᎪT is it",), (None,)], "t string")
    assert [r[0] for r in rows.select(confusables.consistent_form(rows["t"])).collect()] == ["goat", "HAT is it", None]
