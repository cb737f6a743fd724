"""Measures of a model's inside over stored traces: attention per head, its roll-up, the logit lens over a set of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.functions import arrays, text
from kilnspark.operators import detect, joins

SPANS = ("instruction", "negation", "target_mention", "question")
SCORES = ("iar", "nf", "tmf", "pi")


def decisions(traces: DataFrame, detections: DataFrame) -> DataFrame:
    """(prompt_id, condition, decision_step, word_present, status) of each trace (prompt_id, condition, n_steps).

    ``status`` is ok, mapping_error or no_entry; the last two have no step.
    Without any detections every trace is decided at step 0. The last detection
    of a prompt and condition must be the only one.
    """
    keys = ["prompt_id", "condition"]
    if detections.isEmpty():
        return traces.select(*keys, F.lit(0).alias("decision_step"), F.lit(False).alias("word_present"), F.lit("ok").alias("status"))
    found = detections.select(*keys, F.coalesce("word_present", F.lit(False)).alias("word_present"), F.coalesce("mapping_error", F.lit(False)).alias("mapping_error"), F.get("token_spans", F.lit(0))["start"].alias("first_start"), F.lit(True).alias("known"))
    joined = traces.join(found, keys, "left")
    step = arrays.decision_step(F.coalesce("known", F.lit(False)), F.col("mapping_error"), F.col("word_present"), F.coalesce("first_start", F.lit(0)), F.col("n_steps"))
    status = F.when(F.col("known").isNull(), "no_entry").when(F.col("mapping_error"), "mapping_error").otherwise("ok")
    return joined.select(*keys, F.when(status == "ok", step).cast("int").alias("decision_step"), F.coalesce("word_present", F.lit(False)).alias("word_present"), status.alias("status"))


def span_positions(prompts: DataFrame, offsets: DataFrame) -> DataFrame:
    """(prompt_id, condition, one array of token positions per span) for each prompt and condition that has token offsets."""
    asked = joins.lookup_join(offsets, prompts.select("prompt_id", "question_text", "target_word"), "prompt_id", "inner")
    asked = asked.withColumn("prompt", text.build_prompt(F.col("question_text"), F.col("target_word"), F.col("condition")))
    spans = asked.withColumn("spans", detect.prompt_spans(F.col("prompt"), F.col("target_word"), F.col("condition")))
    at = lambda s: arrays.overlapping(F.col("offsets"), F.col(f"spans.{s}.start"), F.col(f"spans.{s}.end")).alias(s)
    return spans.select("prompt_id", "condition", *[at(s) for s in SPANS])


def attention(prompts: DataFrame, offsets: DataFrame, heads: DataFrame, detections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metric rows, counters) of the attention job.

    ``offsets``: prompt_id, condition, n_steps, offsets of the prompt's tokens;
    ``heads``: prompt_id, condition, step, layer, head, weights over those
    tokens. Rows: per head the four scores at the decision step, their means per
    layer (head -1) and over all (layer and head -1). Counters: traces by status.
    """
    keys = ["prompt_id", "condition"]
    steps = decisions(offsets.select(*keys, "n_steps"), detections)
    places = span_positions(prompts, offsets).join(steps.where("status = 'ok'").drop("status"), keys)
    # One row per head is joined with its trace's positions; a trace has few heads, so no key is hot.
    rows = heads.join(places, keys).where(F.col("step") == F.col("decision_step"))
    masses = rows.withColumns({f"m_{s}": arrays.mass(F.col("weights"), F.col(s)) for s in SPANS})
    scored = masses.withColumns(arrays.attention_scores(*[F.col(f"m_{s}") for s in SPANS]))
    return rolled_up(scored, [*keys, "decision_step", "word_present"]), steps.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def rolled_up(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Head rows with their layer and global means, in one pass of grouping sets."""
    every = [F.col(c) for c in (*keys, "layer", "head")]
    sets = [every, every[:-1], every[:-2]]
    means = scored.groupingSets(sets, *every).agg(F.grouping("layer").alias("_gl"), F.grouping("head").alias("_gh"), *[F.avg(c).alias(c) for c in SCORES])
    flag = F.when(F.col("_gl") == 1, "global_mean").when(F.col("_gh") == 1, "layer_mean").otherwise("head")
    level = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return means.select(*keys, level("layer"), level("head"), *SCORES, flag.alias("aggregate_flag"))


def lens(logits: Column, ids: Column) -> Column:
    """struct(p_sem_first_token, greedy_id, greedy_prob) of a logit vector: probability of a set of ids, and the likeliest id."""
    once = lambda c, use: F.element_at(F.transform(F.array(c), use), 1)
    row = lambda p: F.struct(arrays.mass(p, F.array_distinct(ids)).alias("p_sem_first_token"), arrays.argmax(p).alias("greedy_id"), F.array_max(p).alias("greedy_prob"))
    return once(arrays.softmax_of(logits), row)


def failure_modes(suppression: DataFrame, attention_rows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Failures with their mode: priming where the rule raises the target's probability or attention to it outweighs that to the negation.

    ``suppression``: prompt_id, delta; attention is looked up and may be missing.
    """
    seen = attention_rows.where("aggregate_flag = 'global_mean' and condition = 'negative'").select("prompt_id", *SCORES)
    rows = suppression.join(outcomes.where("outcome = 'failure'"), "prompt_id").join(seen, "prompt_id", "left")
    gap = F.col("tmf") - F.col("nf")
    mode = F.when(F.coalesce(F.col("delta") < 0, F.lit(False)) | F.coalesce(gap > 0.02, F.lit(False)), "priming").otherwise("override")
    return rows.select("prompt_id", "delta", gap.alias("tmf_minus_nf"), mode.alias("failure_mode"))
