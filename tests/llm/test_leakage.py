import random

import pytest

from kilnspark.llm import leakage

ITEMS = [
    (1, "When the quiet compass of Oldford fell silent, an innkeeper climbed past sixteen tiles to stack whatever the strange wind had spared, and by market-day nobody in the valley could say who had rung the bell at night."),
    (2, "Through forty lonely winters the pilots fed Newbridge with copper, a broken crane and songs about a sour carpet, until the last of them sold his boat and walked along the river to the sea."),
]
LONG = (9, ITEMS[0][1] + " " + ITEMS[1][1] + " He never came back to Newbridge and nobody at the inn asked the pilots why.")
D, I = "doc_id long, text string, items string, spans string", "item_id long, text string"
FILL = "The run was started late and most of the time went into loading the model. "


def found(spark, docs, items=ITEMS):
    d = spark.createDataFrame([(i, t, "q", "q") for i, t in docs], D)
    return sorted(map(tuple, leakage.leaks(d, spark.createDataFrame(items, I)).collect()))


def words(n, start=0, item=0):
    return ITEMS[item][1].split()[start : start + n]


def test_whole_and_part(spark):
    docs = [(1, FILL + ITEMS[0][1]), (2, FILL + " ".join(words(22, 3)) + " and then " + FILL), (3, " ".join(words(17, 2)) + " " + FILL), (4, FILL), (5, ITEMS[0][1] + "\n" + ITEMS[1][1])]
    assert found(spark, docs) == [(1, 1), (2, 1), (5, 1), (5, 2)]


def test_layout_case_and_markup_are_read_over(spark):
    w = words(24, 4)
    docs = [
        (1, " ".join(w).upper()),
        (2, "> " + "\n> ".join(" ".join(w[i : i + 5]) for i in range(0, 24, 5))),
        (3, "<p>" + "<br> ".join(w) + "</p>"),
        (4, " ".join(x[:2] + "​" + x[2:] if len(x) > 4 else x for x in w)),
        (5, "  ,  ".join(w).lower()),
        (6, " ".join(w).replace("innkeeper", "inn-\nkeeper")),
        (7, '{"q": "' + " ".join(w).replace(", ", ",\\n") + '"}'),
        (8, " ".join(w).replace("a", "а")),
    ]
    assert found(spark, docs) == [(i, 1) for i in range(1, 9)]


@pytest.mark.parametrize("seed", range(4))
def test_edits(spark, seed):
    r = random.Random(seed)
    docs = []
    for i in range(30):
        w = words(24, r.randint(0, 10))
        for at in sorted(r.sample(range(2, 22), 3), reverse=True):
            how = r.random()
            if how < 0.4:
                w[at] = "lantern"
            elif how < 0.7:
                del w[at]
            else:
                w.insert(at, "very")
        docs.append((i, FILL + " ".join(w) + " " + FILL))
    spoiled = []
    for i in range(100, 120):
        w = words(30, r.randint(0, 5))
        for at in range(0, 30, 4):
            w[at] = "lantern"
        spoiled.append((i, FILL + " ".join(w) + " " + FILL))
    assert [d for d, _ in found(spark, docs + spoiled)] == list(range(30))


def distance(pattern, text):
    """Least word edits between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_bit_parallel_distance_equals_the_table():
    r = random.Random(5)
    for _ in range(300):
        pattern, text = [r.randint(0, 4) for _ in range(r.randint(1, 24))], [r.randint(0, 4) for _ in range(r.randint(0, 30))]
        most = r.randint(0, 5)
        assert (leakage.nearest(pattern, text, most) >= 0) == (distance(pattern, text) <= most and bool(text) or False)


def test_nulls_empty_short_items_and_repeats(spark):
    docs = [(1, None), (2, ""), (None, ITEMS[0][1]), (3, ITEMS[0][1]), (3, ITEMS[0][1])]
    assert found(spark, docs, [*ITEMS, (3, "too short"), (4, None), (None, ITEMS[1][1])]) == [(3, 1)]
    assert found(spark, [], ITEMS) == [] and found(spark, docs, []) == []


def test_very_long_document(spark):
    assert found(spark, [(1, FILL * 20_000 + ITEMS[1][1] + FILL * 20_000)]) == [(1, 2)]


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 50)
    assert found(spark, [(5, ITEMS[0][1] + "\n" + ITEMS[1][1])]) == [(5, 1), (5, 2)]


def test_removal(spark):
    d = spark.createDataFrame([(1, "Before. " + ITEMS[0][1] + " After.", "q", "q"), (2, FILL, "q", "q")], D)
    got = leakage.cleaned(d, spark.createDataFrame(ITEMS, I)).collect()
    assert [(r["doc_id"], r["items"]) for r in got] == [(1, [1])]
    assert got[0]["text"].startswith("Before. ") and got[0]["text"].endswith(" After.") and len(got[0]["text"]) < 30


def cleaned_text(spark, text, items=ITEMS):
    d = spark.createDataFrame([(1, text, "q", "q")], D)
    return leakage.cleaned(d, spark.createDataFrame(items, I)).collect()[0]["text"]


def test_removal_of_swapped_halves(spark):
    w = LONG[1].split()
    got = cleaned_text(spark, "Before. " + " ".join(w[45:]) + " " + " ".join(w[:45]) + " After.", [LONG])
    assert got.startswith("Before. ") and got.endswith(" After.") and len(got) < 30


@pytest.mark.parametrize("between", ["\n", "\n\n" + FILL, " so it goes: "])
@pytest.mark.parametrize("copies", [2, 3, 7])
def test_removal_of_repeated_passages(spark, copies, between):
    got = cleaned_text(spark, "Before. " + between.join([ITEMS[0][1]] * copies) + " After.")
    assert got.startswith("Before. ") and got.endswith(" After.") and not set(got.lower().split()) & {"innkeeper", "oldford", "tiles", "valley"}


def test_removal_of_an_edited_copy_beside_a_whole_one(spark):
    w = words(40)
    w[12], w[20] = "lantern", "lantern"
    got = cleaned_text(spark, "Before. " + " ".join(w) + " " + " ".join(words(40)) + " After.")
    assert got.startswith("Before. ") and got.endswith(" After.") and len(got) < 30


def test_words_without_places_are_the_same():
    for text in ("It's a well-known fact -- <b>bold</b> &amp; \\n plain, 7 o'clock.", "Plain words only", "Caffè e naïveté, ｆull width", "", "a_b c-\n  d", "x < y & z"):
        assert leakage.only_words(text) == leakage.read_words(text)[0]


def test_candidates_equal_those_of_a_dictionary():
    import random
    from collections import defaultdict

    r = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(r.choice(words) for _ in range(30))) for i in range(20)] + [(99, items_text := " ".join(words * 3))] + [(100, items_text)]
    p = leakage.Passages(items)
    grams = defaultdict(list)
    for n, (_, ids) in enumerate(p.items):
        for k in range(len(ids) - leakage.GRAM + 1):
            grams[tuple(ids[k : k + leakage.GRAM])].append((n, k))
    for _ in range(30):
        doc = [p.ids.get(w, -1) for w in (r.choice([*words, "other"]) for _ in range(120))] + p.items[r.randrange(22)][1]
        want = defaultdict(list)
        for j in range(len(doc) - leakage.GRAM + 1):
            for n, k in grams.get(tuple(doc[j : j + leakage.GRAM]), ()):
                want[n].append((j, k))
        want = {n: sorted(h) for n, h in want.items() if len(h) >= leakage.HITS}
        assert {n: sorted(h) for n, h in p.candidates(doc).items()} == want
    assert leakage.Passages([]).candidates(list(range(50))) == {} and p.candidates([]) == {}


@pytest.mark.parametrize("gap", [1, 2, 5, 13, 30, 60])
def test_two_copies_near_each_other_are_two_spans(spark, gap):
    item = " ".join(f"item{i}" for i in range(26))
    between = " ".join(f"between{i}" for i in range(gap))
    text = f"Before it. {item} {between} {item} after it."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    spans = sorted((r["span_start"], r["span_end"]) for r in leakage.leaked_spans(docs, items).collect())
    assert [text[a:b] for a, b in spans] == [item, item]
    assert leakage.cleaned(docs, items).first()["text"].split() == f"Before it. {between} after it.".split()
