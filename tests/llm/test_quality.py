import os

import numpy as np
import pytest

from kilnspark.llm import quality
from kilnspark.llm.trees import BoostedTrees

DATA = "/root/testdata/sf0.01"
COMMON = "the of and to a in is it that for was on are as with they at be this have from or had by but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see no way could people my than first been who its now find long down day did get come made may part".split()
PROSE = "The ferry left late that evening, and nobody on the pier could say why it had been so slow. {} was still there when they came back in the rain.\n"


@pytest.fixture(scope="module")
def tables(spark):
    docs = []
    names = ["Anna", "Ben", "Cleo", "Dora", "Emil", "Fred", "Gil", "Hana"]
    for i, n in enumerate(names):
        docs.append((10 + i, PROSE.format(n) * 3))
        docs.append((30 + i, f"{n.lower()} rope\n" + "\n".join(f"{w} {n.lower()}" if k % 2 else w for k, w in enumerate("hammer saw bucket nail paint brush ladder glue".split()))))
        docs.append((50 + i, "name\tx\ty\n" + "\n".join(f"{w}\t{k}\t0.{k}{i}" for k, w in enumerate("rope nail saw glue brush paint".split()))))
        docs.append((70 + i, "".join(chr(33 + (k * 7 + i * 11) % 30) for k in range(200))))
    docs += [(1, None), (2, ""), (3, " \n "), (4, PROSE.format("x") * 3000), (5, "x" * 200_000), (None, PROSE.format("y"))]
    schema = "doc_id long, text string, doc_kind string, word_count int"
    lex = spark.createDataFrame([(w, i + 1, 5.0) for i, w in enumerate(COMMON)] + [(None, 1, None)], "word string, word_rank int, zipf double")
    return spark.createDataFrame([(*d, "q", 1) for d in docs], schema), lex


def test_kinds_of_a_table(tables):
    docs, lex = tables
    got = {r["doc_id"]: r for r in quality.judged(docs, lex).collect()}
    for first, kind in ((10, "prose"), (30, "list"), (50, "table"), (70, "junk")):
        assert [got[first + i]["doc_kind"] for i in range(8)] == [kind] * 8
    assert [got[i]["doc_kind"] for i in (1, 2, 3)] == [None] * 3 and got[1]["word_count"] == 0
    assert got[4]["doc_kind"] == "prose" and got[5]["doc_kind"] == "junk" and None in got
    assert got[10]["line_end_share"] == 1.0 and got[10]["word_count"] == 3 * 30 and got[10]["common_word_share"] > 0.4


def test_empty_tables(spark, tables):
    docs, lex = tables
    assert quality.judged(docs.limit(0), lex).collect() == []
    assert quality.judged(docs.where("doc_id = 10"), lex.limit(0)).count() == 1


@pytest.fixture(scope="module")
def model(spark):
    """Fitted on the project's own documents; the texts judged below are none of them."""
    if not os.path.exists(f"{DATA}/documents.parquet"):
        pytest.skip("no test tables here")
    return quality.fit_kinds(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/lexicon.parquet"))


def kind(model, text):
    row = model.shares([text])[0]
    return quality.KINDS[1 + int(row[1:].argmax())] if row[1:].sum() > 0.5 else "prose"


def test_hand_checked_texts(model):
    right = sum(quality.KINDS[k] == kind(model, t) for k, t in quality.HOLDOUT)
    assert right >= 0.85 * len(quality.HOLDOUT) and not {t for _, t in quality.HOLDOUT} & {t for _, t in quality.SEEDS}


def test_calibration_lowers_the_loss_and_decides(model, monkeypatch):
    before, after = model.loss
    assert after <= before and model.trees.temperature != 1.0
    # A text half of which is unsure counts by its probabilities, not by its likeliest kinds.
    monkeypatch.setattr(model.trees, "predict", lambda x: np.tile([0.45, 0.55, 0.0, 0.0], (len(x), 1)))
    assert model.shares(["a b\nc d"])[0].round(9).tolist() == [0.45, 0.55, 0.0, 0.0]


def test_the_same_model_in_any_row_order(spark):
    if not os.path.exists(f"{DATA}/documents.parquet"):
        pytest.skip("no test tables here")
    docs, lex = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/lexicon.parquet")
    a, b = quality.fit_kinds(docs.limit(300), lex), quality.fit_kinds(docs.limit(300).repartition(5), lex)
    assert a.loss == b.loss and a.trained_on == b.trained_on


def test_what_most_of_the_text_is(model):
    listed = "\n".join(f"- {w} rope" for w in "hammer saw bucket nail paint brush ladder glue drill tape".split())
    assert kind(model, PROSE.format("Anna") * 6 + "\n" + listed) == "prose"
    assert kind(model, PROSE.format("Anna") + "\n" + listed * 3) == "list"


def test_statistics_of_a_known_text():
    v = dict(zip(quality.FEATURES, quality.statistics(["The cat sat.", "", "A dog, 12!"], frozenset(["the", "a"])), strict=True))
    assert v["common_share"] == pytest.approx(2 / 5) and v["line_end_share"] == 1.0 and v["number_share"] == pytest.approx(0.0)
    assert v["digit_share"] == pytest.approx(2 / 18) and v["word_length"] == pytest.approx(13 / 5)


def test_trees_learn_and_calibrate():
    r = np.random.default_rng(1)
    x = r.random((600, 4))
    y = (x[:, 0] > 0.5).astype(int) + 2 * (x[:, 1] > 0.5).astype(int)
    held = r.random((300, 4))
    want = (held[:, 0] > 0.5).astype(int) + 2 * (held[:, 1] > 0.5).astype(int)
    m = BoostedTrees(4).fit(x, y).calibrate(x, y)
    p = m.predict(held)
    assert (p.argmax(1) == want).mean() > 0.95 and np.allclose(p.sum(1), 1)
    assert m.predict(np.zeros((0, 4))).shape == (0, 4)
