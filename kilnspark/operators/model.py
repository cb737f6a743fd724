"""The boundary to a language model: everything before and after it is Spark, the call itself is one function per batch.

A model is a picklable factory; each Python worker calls it once and keeps what
it returns. The returned function takes and gives a pandas frame per batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Batch = Callable[[pd.DataFrame], pd.DataFrame]
_LOADED: dict[str, Batch] = {}


def loaded(name: str, factory: Callable[[], Batch]) -> Batch:
    """The model of this worker, loaded at its first batch."""
    if name not in _LOADED:
        _LOADED[name] = factory()
    return _LOADED[name]


def call(df: DataFrame, name: str, factory: Callable[[], Batch], schema: str, most_rows: int = 256) -> DataFrame:
    """The model's rows for ``df``; a batch that runs out of memory is halved until it fits or is a single row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(name, factory)

        def fit(d: pd.DataFrame) -> Iterator[pd.DataFrame]:
            try:
                yield model(d)
            except MemoryError:
                if len(d) < 2:
                    raise
                half = len(d) // 2
                yield from fit(d.iloc[:half])
                yield from fit(d.iloc[half:])

        for d in parts:
            for at in range(0, len(d), most_rows):
                yield from fit(d.iloc[at : at + most_rows])

    return df.mapInPandas(run, schema)


def token_sequences(words: DataFrame, word: str, name: str, factory: Callable[[], Batch]) -> DataFrame:
    """(word, sequences) per distinct word: its variants' token ids, each once; the tokenizer sees every word once."""
    from kilnspark.functions.text import surface_variants

    variants = words.select(F.col(word).alias("word")).where("word <> ''").distinct().select("word", F.explode(surface_variants(F.col("word"))).alias("variant"))
    coded = call(variants, name, factory, "word string, variant string, ids array<int>")
    ones = coded.where(F.size("ids") > 0).withColumn("place", F.array_position(surface_variants(F.col("word")), F.col("variant"))).groupBy("word", "ids").agg(F.min("place").alias("v"))
    # In the order in which the variants come; a word has few.
    return ones.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("v", "ids"))), lambda s: s["ids"]).alias("sequences"))


def single_token_filter(validated: DataFrame, sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose target has a variant of one token, kept / removed / processed per category)."""
    single = single_token_words(sequences).withColumn("_ok", F.lit(True))
    marked = validated.join(single.withColumnRenamed("word", "target_word"), "target_word", "left")
    ok = F.coalesce("_ok", F.lit(False))
    counts = marked.groupBy("category").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("removed"), F.count(F.lit(1)).alias("processed"))
    return marked.where(ok).drop("_ok"), counts


def single_token_words(sequences: DataFrame) -> DataFrame:
    """Words of which a variant is one token."""
    return sequences.where(F.exists("sequences", lambda s: F.size(s) == 1)).select("word")


def pressure_of(prompts: DataFrame, sequences: DataFrame, name: str, factory: Callable[[], Batch], strict: bool = True) -> DataFrame:
    """(prompt_id, p_sem): summed probability of the target's sequences, held within 0 and 1.

    ``factory``'s model adds ``logprobs``, one log probability per token. With
    ``strict`` a prompt of whose sequences more than half failed (null) raises.
    """
    tasks = prompts.join(sequences, F.col("target_word") == F.col("word")).select("prompt_id", "prompt_text", F.explode("sequences").alias("ids"))
    done = call(tasks, name, factory, "prompt_id string, prompt_text string, ids array<int>, logprobs array<double>")
    p = F.exp(F.aggregate("logprobs", F.lit(0.0), lambda a, x: a + x))
    out = done.groupBy("prompt_id").agg(F.coalesce(F.sum(p), F.lit(0.0)).alias("p"), F.avg(F.col("logprobs").isNull().cast("double")).alias("failed"))
    ok = F.when(F.lit(strict) & (F.col("failed") > 0.5), F.raise_error(F.concat(F.lit("no pressure for "), "prompt_id")).cast("double")).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p"))))
    return out.select("prompt_id", ok.alias("p_sem"))


def rest_sums(done: DataFrame) -> DataFrame:
    """(prompt_id, rest): per first token the summed probability of what follows it; nothing following counts 1.

    ``done``: prompt_id, ids, rest_logprobs of the tokens behind the first.
    """
    p = F.when(F.size("ids") == 1, F.lit(1.0)).otherwise(F.exp(F.aggregate("rest_logprobs", F.lit(0.0), lambda a, x: a + x)))
    sums = done.where(F.size("ids") > 0).groupBy("prompt_id", F.get("ids", F.lit(0)).alias("first")).agg(F.sum(p).alias("p"))
    return sums.groupBy("prompt_id").agg(F.map_from_entries(F.collect_list(F.struct("first", "p"))).alias("rest"))
