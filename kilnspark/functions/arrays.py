"""Array algebra over attention weights, logits, hidden states, token spans and token ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def doubles(c: Column) -> Column:
    """An array's elements as doubles, before anything is summed."""
    return F.transform(c, lambda x: x.cast("double"))


def total(c: Column) -> Column:
    """Sum of an array, 0.0 if empty."""
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def mass(weights: Column, positions: Column) -> Column:
    """Sum of the weights at 0-based positions; positions outside are ignored."""
    inside = F.filter(positions, lambda i: (i >= 0) & (i < F.size(weights)))
    return F.aggregate(inside, F.lit(0.0), lambda a, i: a + F.get(weights, i))


def span_mass(weights: Column, start: int, end: int) -> Column:
    """Sum of the weights at 0-based positions start..end-1."""
    return total(F.slice(weights, start + 1, end - start))


def attention_scores(instruction: Column, negation: Column, target: Column, question: Column) -> dict[str, Column]:
    """Instruction attention ratio, negation focus, target mention focus and priming index."""
    iar = instruction / (instruction + question + EPSILON)
    nf = negation / (instruction + EPSILON)
    tmf = target / (instruction + EPSILON)
    return {"iar": iar, "nf": nf, "tmf": tmf, "pi": tmf - nf}


def softmax_of(logits: Column) -> Column:
    """Probabilities; shifted by the largest logit, which is worked out once, as is the sum."""
    once = lambda c, use: F.element_at(F.transform(F.array(c), use), 1)
    shifted = once(F.array_max(logits), lambda m: F.transform(logits, lambda x: F.exp(x - m)))
    return once(shifted, lambda e: once(total(e), lambda s: F.transform(e, lambda x: x / s)))


def first_ids(sequences: Column) -> Column:
    """The ids of sequences of one token, each once, in order."""
    ones = F.filter(sequences, lambda s: F.size(s) == 1)
    return F.array_sort(F.array_distinct(F.transform(ones, lambda s: F.get(s, F.lit(0)))))


def metric_targets(present: Column, exact: Column, spans: Column, generated: Column, prefix_variants: Column) -> Column:
    """struct(ids, kind): the ids whose probability is followed.

    ``exact`` ids, unless the word was written in several tokens; then the first
    of them and those of its case variants (``prefix_variants``, token ids each)
    that are one token, and the kind is ``prefix``.
    """
    first = F.get(spans, F.lit(0))
    start = first["start"]
    split = F.coalesce(present & (first["end"] > start) & (start >= 0) & (start < F.size(generated)), F.lit(False))
    variants = first_ids(F.coalesce(prefix_variants, F.array().cast("array<array<int>>")))
    ids = F.array_sort(F.array_distinct(F.concat(F.array(F.get(generated, start)), variants)))
    return F.struct(F.when(split, ids).otherwise(exact).alias("ids"), F.when(split, "prefix").otherwise("exact").alias("kind"))


def greedy_ids(step_logits: Column, eos: int, most: int) -> Column:
    """Ids of a greedy decode: the largest logit of each step, up to and with the end mark, ``most`` at most."""
    ids = F.slice(F.transform(step_logits, argmax), 1, most)
    at = F.array_position(ids, F.lit(eos)).cast("int")
    return F.when(at > 0, F.slice(ids, F.lit(1), at)).otherwise(ids)


def sequence_probability(logprobs: Column, floor: float = 1e-12) -> Column:
    """Probability of a whole sequence, each token's at least ``floor``."""
    return F.exp(F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + F.log(F.exp(x) + F.lit(floor))))


def argmax(c: Column) -> Column:
    """0-based place of the first largest element."""
    return F.array_position(c, F.array_max(c)).cast("int") - 1


def add(a: Column, b: Column) -> Column:
    """Element-wise sum."""
    return F.zip_with(a, b, lambda x, y: x + y)


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return total(F.zip_with(a, b, lambda x, y: x * y))


def patched(own: Column, other: Column, positions: Column) -> Column:
    """``own`` with the elements of ``other`` at the given 0-based positions that both have."""
    return F.transform(own, lambda x, i: F.when(F.array_contains(positions, i) & (i < F.size(other)), F.get(other, i)).otherwise(x))


def patched_pairs(own: Column, other: Column, pairs: Column) -> Column:
    """``own`` with ``other[b]`` at ``a`` for each pair (a, b) within bounds."""
    hit = lambda i: F.filter(pairs, lambda p: (p["a"] == i) & (p["b"] >= 0) & (p["b"] < F.size(other)))
    return F.transform(own, lambda x, i: F.when(F.size(hit(i)) > 0, F.get(other, F.element_at(hit(i), 1)["b"])).otherwise(x))


def aligned(a: Column, b: Column) -> Column:
    """Pairs (a, b) by place, as many as the shorter has."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.struct(x.alias("a"), y.alias("b")))


def running_spans(tokens: Column) -> Column:
    """(start, end) of each token in the joined text; for tokens whose texts simply follow one another."""
    step = lambda acc, t: F.struct((acc["at"] + F.length(t)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(t)).alias("end")))).alias("out"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return F.aggregate(tokens, zero, step, lambda acc: acc["out"])


def overlapping(offsets: Column, start: Column, end: Column) -> Column:
    """0-based numbers of the token spans that overlap [start, end); empty spans never do; null bounds give none."""
    marked = F.transform(offsets, lambda o, i: F.struct(o["start"].alias("start"), o["end"].alias("end"), i.alias("i")))
    hit = F.filter(marked, lambda o: (o["end"] > o["start"]) & (o["end"] > start) & (o["start"] < end))
    return F.transform(F.coalesce(hit, F.array().cast("array<struct<start:int,end:int,i:int>>")), lambda o: o["i"])


def token_range(offsets: Column, start: Column, end: Column) -> Column:
    """struct(start, end) of the first and last overlapping token, end inclusive; null if none overlaps."""
    hit = overlapping(offsets, start, end)
    return F.when(F.size(hit) > 0, F.struct(F.array_min(hit).alias("start"), F.array_max(hit).alias("end")))


def decision_step(known: Column, mapping_error: Column, present: Column, first_start: Column, generated: Column) -> Column:
    """Step at which an answer is decided: null if unknown or unmapped, 0 if the word is absent, else its first token, within the answer."""
    step = F.when(~known | mapping_error, None).when(~present, 0).otherwise(first_start)
    return F.greatest(F.lit(0), F.least(step, generated - 1))


def factorised(first: Column, rest: Column) -> Column:
    """Sum over tokens of P(first token) times the summed probability of what follows, within 0 and 1."""
    terms = F.transform(F.map_entries(rest), lambda e: F.coalesce(F.get(first, e["key"]), F.lit(0.0)) * e["value"])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total(terms)))


def trimmed_ids(ids: Column, eos: int, pad: int) -> Column:
    """Token ids up to and with the first end mark; without one, the pads at the end taken off."""
    at = F.array_position(ids, F.lit(eos)).cast("int")
    kept = F.transform(ids, lambda x, i: F.when(x != pad, i + 1).otherwise(0))
    return F.when(at > 0, F.slice(ids, F.lit(1), at)).otherwise(F.slice(ids, F.lit(1), F.coalesce(F.array_max(kept), F.lit(0))))


def finish_reason(ids: Column, cap: int) -> Column:
    """``stop`` below the cap, else ``length``."""
    return F.when(F.size(ids) < cap, "stop").otherwise("length")
