import itertools
import random

import pytest
from pyspark.sql import functions as F

from kilnspark.llm import merkle

TREE = {"question_text": "text", "target_word_normalized": "leaf"}
SCHEMA = "cand_id long, question_text string, target_word_normalized string"


def found(spark, rows, schema=SCHEMA, tree=TREE):
    return sorted(map(tuple, merkle.copies(spark.createDataFrame(rows, schema), "cand_id", tree).collect()))


def test_case_blanks_and_marks_are_no_difference(spark):
    rows = [(7, "The  CAT sat.", "Mat."), (3, "the cat, sat", "mat"), (9, "the cat sits", "mat"), (5, "the cat sat!", " MAT ")]
    assert found(spark, rows) == [(3, 5), (3, 7)]


def test_labelled_fields_in_any_order(spark):
    a = "Setting: a hall, at noon | Rule: no cat | Cue: the dog"
    others = [
        "Cue = the dog; Setting = A hall at noon; Rule = no cat",
        "rule : NO CAT // cue : the dog // setting : a hall, at\nnoon",
        "Rule:no cat\nCue:the dog\nSetting:a hall, at noon",
    ]
    swapped = "Setting: no cat | Rule: a hall, at noon | Cue: the dog"
    rows = [(i, q, "x") for i, q in enumerate([a, *others, swapped])]
    assert found(spark, rows) == [(0, 1), (0, 2), (0, 3)]


def test_word_order_counts_outside_fields(spark):
    assert found(spark, [(1, "the man bites the dog", "x"), (2, "the dog bites the man", "x")]) == []


def test_nulls_and_texts_without_letters_are_no_cases(spark):
    rows = [(1, None, "x"), (2, None, "x"), (3, "?!", "x"), (4, "", "x"), (5, "a", None), (6, "a", "..."), (7, "a", "b"), (None, "a", "b"), (8, "A", "B")]
    assert found(spark, rows) == [(7, 8)]


def test_repeated_ids_and_empty_tables(spark):
    assert found(spark, [(1, "a", "b"), (1, "a", "b"), (2, "a!", "b")]) == [(1, 2)]
    assert found(spark, []) == []


def test_very_long_text(spark):
    text = "word " * 200_000
    assert found(spark, [(1, text, "x"), (2, text.upper(), "x"), (3, text + "y", "x")]) == [(1, 2)]


def test_extra_columns_of_clashing_names(spark):
    schema = SCHEMA + ", id string, root string, form string, salt int, n_copies int, first_id int"
    assert found(spark, [(1, "a", "b", "q", "q", "q", 1, 1, 1), (2, "A", "b", "r", "r", "r", 2, 2, 2)], schema) == [(1, 2)]


def test_hot_class_is_split(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HOT_ROWS", 10)
    rows = [(i, "same" if i % 3 else f"other {i // 6}", "x") for i in range(300)]
    want = []
    groups = {}
    for i, q, _ in rows:
        groups.setdefault(q, []).append(i)
    for ids in groups.values():
        want += [(min(ids), i) for i in ids if i != min(ids)]
    assert found(spark, rows) == sorted(want)


def test_nested_records(spark):
    schema = "cand_id long, r struct<b:string,a:struct<x:array<string>>>"
    rows = [(1, ("One.", (["P", "q"],))), (2, ("one", (["q!", "p"],))), (3, ("one", (["q", "q"],))), (4, (None, (["q", "p"],)))]
    assert found(spark, rows, schema, {"r": "bag"}) == [(1, 2)]
    assert found(spark, rows, schema, {"r": "tree"}) == []


def test_counts(spark):
    rows = [(1, "a", "x"), (2, "A", "x"), (3, "b", "x")]
    got = merkle.collapse(spark.createDataFrame(rows, SCHEMA), "cand_id", TREE)
    assert sorted(map(tuple, got.collect())) == [(1, 2), (3, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    fields = [("A", "x y"), ("B", "z"), ("C", "x")]
    rows = []
    for i in range(60):
        order = r.sample(fields, 3)
        sep = r.choice([" | ", "; ", " // "])
        q = sep.join(f"{r.choice([k, k.lower()])}: {r.choice([v, v.upper(), v + '.'])}" for k, v in order) if r.random() < 0.6 else r.choice(["x y", "X, y", "y x"])
        rows.append((i, q, r.choice(["t", "T."])))

    def key(q):
        norm = lambda s: "".join(c for c in s.lower() if c.isalnum())
        for sep in ("|", ";", "//"):
            if sep in q:
                return frozenset(norm(p) for p in q.split(sep))
        return norm(q)

    want = []
    for (i, a, _), (j, b, _) in itertools.combinations(rows, 2):
        if key(a) == key(b) and not any(key(c) == key(a) for k, c, _ in rows if k < i):
            want.append((i, j))
    assert found(spark, rows) == sorted(want)


def test_equal_digests_of_different_records_are_no_class(spark, monkeypatch):
    monkeypatch.setattr(merkle, "_md5", lambda c: F.when(c.isNotNull(), F.lit("ab" * 16)))
    rows = [(1, "a", "x"), (2, "b", "x"), (3, "B!", "x"), (4, "label: one | other: two", "x"), (5, "Other: two; Label: one", "x"), (6, "c", "x")]
    assert found(spark, rows) == [(2, 3), (4, 5)]
    got = merkle.collapse(spark.createDataFrame(rows, SCHEMA), "cand_id", TREE)
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 2), (4, 2), (6, 1)]


def test_many_hot_classes_and_a_full_filter(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HOT_ROWS", 20)
    rows = spark.range(20_000).selectExpr("id cand_id", "concat('Word ', id % 400, if(id % 3 = 0, '!', '')) question_text", "'t' target_word_normalized")
    rows = rows.union(spark.range(20_000, 60_000).selectExpr("id", "concat('single ', id)", "'t'"))
    got = merkle.copies(rows, "cand_id", TREE)
    assert got.count() == 20_000 - 400 and got.where("first_id <> copy_id % 400").count() == 0
    assert merkle.collapse(rows, "cand_id", TREE).groupBy("n_copies").count().orderBy("n_copies").collect() == [(1, 40_000), (50, 400)]
