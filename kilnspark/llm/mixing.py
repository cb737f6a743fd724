"""Mixing sources to target shares of the size in tokens, by Poisson replication.

A source's mean repetition is what its target share asks of it, at most its
cap. Each document's count inverts a Poisson distribution cut off at the cap,
whose rate is solved so that the mean holds, at a value hashed from the
document's id; documents are exploded by their counts and shuffled globally.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilnspark.functions.names import name_key
from kilnspark.session import cut_lineage

#: Ranks of a public byte-level BPE; a parameter, never part of this repository.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Split pattern that belongs to these ranks (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Most rows of the target table.
TARGET_SOURCES = 100_000
_LOADED: dict[str, object] = {}


def encoding(path: str, ranks: bytes | None = None):
    """The tokenizer of a file of ranks, made once per process; ``ranks`` is its content where the file is elsewhere."""
    if path not in _LOADED:
        import base64

        import tiktoken

        if ranks is None:
            ranks = _content(path)
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})
    return _LOADED[path]


def _content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def token_counts(df: DataFrame, text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """``df`` with ``n_tokens`` of the whole text; a null text has none. The file is read on the driver and sent to the workers."""
    held = df.sparkSession.sparkContext.broadcast(_content(path))

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path, held.value)
        for s in parts:
            yield pd.Series([0 if t is None else len(enc.encode_ordinary(t)) for t in s], dtype="int64")

    return df.withColumn("n_tokens", count(F.col(text)))


def capped_rate(mean: float, cap: int) -> float:
    """The Poisson rate at which min(count, cap) has this mean; infinite where the mean is the cap itself."""
    if mean >= cap:
        return math.inf
    if mean <= 0:
        return 0.0

    def mean_at(rate: float) -> float:
        p, below, total = math.exp(-rate), 0.0, 0.0
        for k in range(cap):
            below, total = below + p, total + k * p
            p *= rate / (k + 1)
        return total + cap * (1 - below)

    lo, hi = 0.0, 1.0
    while mean_at(hi) < mean and hi < 600:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean_at(mid) < mean else (lo, mid)
    return (lo + hi) / 2


def thresholds(rate: float, cap: int) -> list[float]:
    """P(count <= k) for k below the cap; a value below none of them gives the cap."""
    if math.isinf(rate):
        return [0.0] * cap
    p, total, out = math.exp(-rate), 0.0, []
    for k in range(cap):
        total += p
        out.append(total)
        p *= rate / (k + 1)
    return out


def source_report(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: its tokens, what its share asks, the most it can give, and its mean repetition.

    ``sized`` has a source column and n_tokens. The total is that of all
    documents, each once, those without a source included. Sums are made
    before the shuffle, so a source may hold any part of the rows.
    """
    # Written once, a row per source: the tokens are counted for the total and for each source alike.
    by = cut_lineage(sized.groupBy(name_key(sized["source"]).alias("src")).agg(F.sum("n_tokens").alias("tokens")))
    total = by.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens")).scalar()
    asked = targets.select("source", "target_share", "max_repeat", name_key(targets["source"]).alias("src"))
    most = F.col("tokens") * F.greatest(F.coalesce("max_repeat", F.lit(0)), F.lit(0))
    return (
        asked.join(by, "src", "left")
        .withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        .withColumn("asked_tokens", F.col("target_share") * total)
        .withColumn("most_tokens", most)
        .withColumn("unmet", F.col("most_tokens") < F.col("asked_tokens"))
        .withColumn("mean_repeat", F.coalesce(F.try_divide(F.least("asked_tokens", F.col("most_tokens").cast("double")), F.col("tokens").cast("double")), F.lit(0.0)))
    )


def mix(sized: DataFrame, targets: DataFrame, id_col: str = "doc_id", seed: int = 11) -> DataFrame:
    """(id, source, copy_no, n_tokens, mix_key) of the mixture, in the global order of mix_key.

    Documents whose source is no target come out in no copy. The plan per
    source, a row each, is all that reaches the driver.
    """
    spark = sized.sparkSession
    plan = source_report(sized, targets).select("src", "source", "max_repeat", "mean_repeat").limit(TARGET_SOURCES + 1).toPandas()
    if len(plan) > TARGET_SOURCES:
        raise ValueError(f"more than {TARGET_SOURCES} target sources")
    rows = []
    for src, source, cap, mean in plan.itertuples(index=False):
        cap = int(0 if pd.isna(cap) else max(cap, 0))
        rows.append((src, source, [float(x) for x in thresholds(capped_rate(float(mean), cap), cap)]))
    # TARGET_SOURCES rows at most.
    plans = F.broadcast(spark.createDataFrame(rows, "src string, target_source string, steps array<double>"))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 48)) / float(1 << 48)
    docs = sized.select(F.col(id_col).alias("id"), name_key(sized["source"]).alias("src"), "n_tokens", draw.alias("u")).join(plans, "src")
    counted = docs.withColumn("n", F.size(F.filter("steps", lambda s: s <= F.col("u"))))
    copies = counted.where("n > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n"))))
    key = F.xxhash64(F.lit(seed + 1), "id", "copy_no")
    return copies.select(F.col("id").alias(id_col), F.col("target_source").alias("source"), "copy_no", "n_tokens", key.alias("mix_key")).sort("mix_key")


def shares(sized: DataFrame, targets: DataFrame, id_col: str = "doc_id", seed: int = 11) -> DataFrame:
    """The source report with the tokens each source has in the mixture, as a share of it and of the total its target is meant of.

    ``unmet`` are the sources whose mixture stays below what is asked because
    every document already comes out as often as it may.
    """
    got = mix(sized, targets, id_col, seed).groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count(F.lit(1)).alias("mixed_docs"))
    share = F.try_divide(F.col("mixed_tokens").cast("double"), F.sum("mixed_tokens").over(Window.partitionBy()))
    return (
        source_report(sized, targets)
        .join(got, "source", "left")
        .fillna(0, ["mixed_tokens", "mixed_docs"])
        .withColumn("unmet", F.col("unmet") & (F.col("mixed_tokens") < F.col("asked_tokens")))
        .withColumn("share_reached", F.round(share, 9))
        .withColumn("share_of_total", F.round(F.try_divide(F.col("mixed_tokens") * F.col("target_share"), F.col("asked_tokens")), 9))
        .select("source", "target_share", "max_repeat", "tokens", F.round("mean_repeat", 9).alias("mean_repeat"), "unmet", "mixed_docs", "mixed_tokens", "share_reached", "share_of_total")
    )
