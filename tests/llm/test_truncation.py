import random

import numpy as np
import pytest

from kilnspark.llm import truncation as t

LINES = [
    "The answer is {a}. Nothing else fits the {b} as well as this word does.",
    "I would choose {a}. Both the {b} and the {c} point in the same direction.",
    "It should be {a}, I think. People in town keep a {b} near the {c}, and the habit explains the choice.",
    "Most likely {a}. By the end of the sentence only one thing is still possible, and it is the {b}.",
]
WORDS = "anchor basket candle copper fountain garden hammer island ladder mirror needle orchard pebble ribbon saddle tunnel valley window".split()


def made(n=1500, seed=1):
    """(id, src, text, asked) and the ids of cut rows: one source with a limit, all with broken transfers."""
    r = random.Random(seed)
    rows, cut = [], set()
    for i in range(n):
        text = " ".join(r.choice(LINES).format(a=r.choice(WORDS), b=r.choice(WORDS), c=r.choice(WORDS)) for _ in range(r.randint(1, 2)))
        src = r.choice(["limited", "plain"])
        if r.random() < 0.3:
            text = r.choice(WORDS) + r.choice(["", "."])
        elif r.random() < 0.1:
            text = text.rstrip(".")
        if src == "limited" and len(text) > 90 and r.random() < 0.5:
            if text[89] not in "." and text[90] not in ".":
                cut.add(i)
            text = text[:90]
        elif len(text) > 60 and r.random() < 0.05:
            k = r.randint(40, len(text) - 8)
            if text[k - 1] != "." and text[k] != ".":
                cut.add(i)
            text = text[:k] + r.choice(["", '"}', " &quo", "<|", "["])
        rows.append((i, src, text, "Name the thing that fits: ____."))
    return rows, cut


SCHEMA = "id long, src string, text string, asked string"


def posteriors(spark, rows, schema=SCHEMA):
    return {r["id"]: r for r in t.cut_posteriors(spark.createDataFrame(rows, schema)).collect()}


def test_held_out_accuracy(spark):
    rows, cut = made()
    got = {i for i, r in posteriors(spark, rows).items() if r["cut"] > 0.5}
    assert len(got & cut) >= 0.97 * len(cut)
    assert len(got - cut) <= 0.03 * len(cut)


def test_special_texts_are_no_cuts(spark):
    rows, _ = made(300)
    rows += [(1000, "plain", None, None), (1001, "plain", "", "x"), (1002, "plain", "​ \n", "x"), (1003, "", "Name the thing that fits: ____", "Name the thing that fits: ____."), (1004, "plain", "anchor", "x")]
    rows += [(None, "plain", "anchor", None), (1004, "plain", "anchor", "x")]
    got = posteriors(spark, rows)
    assert all(got[i]["cut"] < 0.5 for i in (1000, 1001, 1002, 1003, 1004, None))
    assert got[1000]["kind"] == got[1002]["kind"] == "empty" and got[1003]["kind"] == "echo"


def test_empty_table_and_long_text(spark):
    assert posteriors(spark, []) == {}
    long = "Both the anchor and the ladder point in the same direction. " * 20_000
    got = posteriors(spark, [(1, "a", long, "x"), (2, "a", long + "Both the anch", "x"), (3, "a", '"(' * 50_000, "x")])
    assert got[1]["cut"] == 0.0 and set(got) == {1, 2, 3}


@pytest.mark.parametrize(
    ("text", "core"),
    [
        ('make the li"}', "make the li"),
        ("which \\u20", "which"),
        ("rhythm ask &quo", "rhythm ask"),
        ("settles th<|", "settles th"),
        ("and bot…", "and bot"),
        ("whistl (as in the", "whistl"),
        ("The end.", "The end."),
        ('He said "no."', 'He said "no."'),
        ("as it is (See also: bench.)", "as it is (See also: bench.)"),
        ("soun  \n", "soun"),
        ("", ""),
    ],
)
def test_residue_is_taken_off(text, core):
    assert t.core_of(text) == core


def test_censored_fit_recovers_the_length_distribution():
    r = np.random.default_rng(3)
    lengths = np.exp(r.normal(4.6, 0.4, 20_000))
    x = np.minimum(lengths, 110).round()
    known, n = np.unique(x, return_counts=True)
    _, mu, sd = t.censored_mle(known, n.astype(float), known == 110, parts=1)
    assert abs(mu[0] - 4.6) < 0.02 and abs(sd[0] - 0.4) < 0.02
    _, naive, _ = t.censored_mle(known, n.astype(float), np.zeros(len(known), bool), parts=1)
    assert abs(naive[0] - 4.6) > 0.05


def test_limits_are_found():
    lengths = np.arange(20, 200).astype(float)
    n = np.full(180, 5.0)
    n[100] = 60
    assert t.candidate_limits(lengths, n).tolist() == [120.0]


def test_rates(spark):
    rows, _ = made(400)
    rates = t.source_rates(t.cut_posteriors(spark.createDataFrame(rows, SCHEMA))).collect()
    assert {r["source"] for r in rates} == {"limited", "plain"} and sum(r["n_rows"] for r in rates) == 400


def test_hashes_of_an_end_equal_those_of_all_places():
    for text in ("a", "héllo wörld, this is a longer text", "x" * 50, "日本"):
        codes = np.frombuffer(("\x02" * 22 + text).encode("utf-32-le"), np.uint32).astype(np.uint64)
        assert {n: int(t._letters_hash(codes, n)[-1]) for n in t._ORDERS} == t._end_hashes(text)


def test_words_of_all_texts_count(spark):
    full = [f"marz{chr(97 + i // 5)}{chr(97 + i % 5)}pan" for i in range(30)]
    rows = [(i, "plain", f"Only the {w} fits, and one {w} is enough for it.", "x") for i, w in enumerate(full)]
    rows += [(100 + i, "plain", f"Nothing fits as well as the {w[:-2]}", "x") for i, w in enumerate(full)]
    fill = spark.range(1000, 50_000).selectExpr("id", "'plain' src", "concat('Row ', id, ' is done.') text", "'x' asked")
    got = t.scored(spark.createDataFrame(rows, SCHEMA).union(fill)).where("kind = 'open'").collect()
    assert len(got) == 30 and all(r["inside"] for r in got)


def test_words_of_a_long_text_count(spark):
    long = "Both the anchor and the ladder point in the same direction. " * 200 + "Only the marzipan fits, and marzipan is enough. " + "The garden is wide. " * 200
    got = t.scored(spark.createDataFrame([(1, "a", long, "x"), (2, "a", "Nothing fits as well as the marzi", "x")], SCHEMA)).collect()
    assert {r["id"]: r["inside"] for r in got} == {"1": False, "2": True}


def test_counts_in_pieces_are_the_same(monkeypatch):
    rows, _ = made(200)
    texts = [(kind, core) for kind, core, _ in (t.ending_of(r[2], "") for r in rows) if core]
    texts.append(("open", "Both the anchor and the ladder point in the same direction. " * 30))

    def counts():
        out = {}
        for h, total, end in t.context_counts(texts, np.full(1024, 2**64 - 1, np.uint64)):
            for k, n, e in zip(h.tolist(), total.tolist(), end.tolist(), strict=True):
                a, b = out.get(k, (0, 0))
                out[k] = a + n, b + e
        return out

    whole = counts()
    assert set(np.array(t.context_keys("It should be ancho"), np.int64).view(np.uint64).tolist()) & set(whole)
    monkeypatch.setattr(t, "COUNT_CHARS", 100)
    assert counts() == whole


def test_contexts_counted_in_batches_equal_those_of_single_texts():
    rows, _ = made(120)
    texts = [(kind, core) for kind, core, _ in (t.ending_of(r[2], "") for r in rows) if core] + [("broken", "half a wo"), ("open", ". . ,"), ("marked", "One, two. Three!")]
    every = np.full(1024, 2**64 - 1, np.uint64)

    def counts(batches):
        out = {}
        for batch in batches:
            for h, total, end in t.context_counts(batch, every):
                for k, n, e in zip(h.tolist(), total.tolist(), end.tolist(), strict=True):
                    a, b = out.get(k, (0, 0))
                    out[k] = a + n, b + e
        return out

    got = counts([texts])
    assert got == counts([[x] for x in texts])
    # The contexts that one text asks for are among those counted in it.
    for ending, core in texts:
        if ending != "open":
            continue
        keys = np.array(t.context_keys(core)[: len(t.CHAIN)], np.int64).view(np.uint64).tolist()
        assert not keys or all(k in got for (kind, _), k in zip(t.CHAIN, keys, strict=True) if kind == "w")


def test_few_texts_follow_the_prior_and_many_their_own_lengths():
    import pandas as pd

    lengths = t.length_of(np.arange(t.KEYS, dtype=float))
    none = pd.DataFrame({"core_len": [], "state": [], "belief": [], "n": []}, dtype=float)
    few = pd.DataFrame({"core_len": [300.0, 310.0], "state": [1, 1], "belief": [0, 0], "n": [1, 1]})
    many = few.assign(n=[5_000, 5_000])
    a, b, c = (t.length_odds(h, lengths) for h in (none, few, many))
    assert abs(a[305] - b[305]) < abs(a[305] - c[305]) and c[305] > b[305]


def test_long_lengths_are_told_apart(spark):
    rows = spark.createDataFrame([(x,) for x in (0, 5, 1023, 1024, 1100, 9_000, 90_000, 2_000_000_000)], "n int")
    keys = [r[0] for r in rows.select(t.length_key(rows["n"])).collect()]
    assert keys == sorted(set(keys)) and keys[-1] < t.KEYS
    assert all(abs(t.length_of(np.array([float(k)]))[0] / max(n, 1) - 1) < 0.02 for k, n in zip(keys[1:], (5, 1023, 1024, 1100, 9_000, 90_000, 2_000_000_000), strict=True))
