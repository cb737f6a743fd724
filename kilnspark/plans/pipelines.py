"""The pipelines of an experiment, from candidates to report tables.

Each takes and returns DataFrames; stages are joined by tables, never by
collected dictionaries. Model and judge are parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnspark.functions import arrays, pressure, text
from kilnspark.operators import detect, joins, model, select, stats
from kilnspark.session import cut_lineage
from kilnspark.sinks import writers
from kilnspark.streaming.resume import missing

BIN_METRICS = {"delta": "suppression_delta", "relative": "suppression_relative", "log": "suppression_log"}
ATTENTION_METRICS = {"iar": "attention_iar", "nf": "attention_nf", "tmf": "attention_tmf", "pi": "attention_pi"}


def filtered_candidates(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept candidates, counts by reason). The first reason counts."""
    marked = select.leak_reasons(candidates)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def judge_requests(candidates: DataFrame, system: str, judge_model: str) -> DataFrame:
    """(custom_id, request) of candidates that have an id, ready for a batch file."""
    user = F.concat(F.lit("Question: "), "question_text", F.lit("\nTarget word: "), "target_word")
    return candidates.select(F.col("prompt_id").alias("custom_id"), writers.batch_request(F.col("prompt_id"), F.lit(system), user, judge_model).alias("request"))


def judged(candidates: DataFrame, responses: DataFrame, shape: str) -> DataFrame:
    """Candidates with their validation struct, v_score and acceptance; without an answer, or with a broken one, all flags are false."""
    answer = F.from_json(text.first_json(F.col("answer")), shape)
    both = joins.lookup_join(candidates, responses.select(F.col("custom_id").alias("prompt_id"), "answer", "error"), "prompt_id")
    v = both.withColumn("validation", F.coalesce(F.when(F.col("error").isNull(), answer), F.from_json(F.lit("{}"), shape))).drop("answer", "error")
    return v.withColumn("v_score", pressure.judge_score(F.col("validation"), F.col("target_word"))).withColumn("accepted", pressure.accepted(F.col("validation"), F.col("target_word")))


def scored(validated: DataFrame, checkpoint: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Validated rows with p_sem and s_score; only those the checkpoint (prompt_id, p_sem) lacks are computed."""
    fresh = compute(missing(validated, checkpoint, ["prompt_id"]))
    # A log's last record counts; without places in it, the largest.
    placed = "_pos" in checkpoint.columns
    stored = select.last_wins(checkpoint, ["prompt_id"], "_pos") if placed else checkpoint.groupBy("prompt_id").agg(F.max("p_sem").alias("p_sem"))
    once = stored.select("prompt_id", "p_sem").unionByName(fresh.groupBy("prompt_id").agg(F.max("p_sem").alias("p_sem")))
    with_p = joins.lookup_join(validated.drop("p_sem", "s_score"), once, "prompt_id")
    return with_p.withColumn("s_score", pressure.selection_score(F.col("v_score"), F.col("p_sem")))


def selected(scored_rows: DataFrame, per_category: int = 500, per_bin: int = 100, min_pressure: float | None = None) -> DataFrame:
    """The final prompts per category: gate, thresholds, balance, back-fill, repetition cap.

    Creative and out-of-distribution rows compete per target first. Rows that
    the repetition cap leaves short are filled up with the best of the rest,
    which don't count as used words.
    """
    gated = scored_rows if min_pressure is None else scored_rows.where(F.col("p_sem") >= min_pressure)
    rows = gated.withColumn("bin_id", pressure.bin_id(F.col("p_sem"))).withColumn("word", F.col("target_word_normalized"))
    alone = rows.where(~F.col("category").isin("creative", "ood") & F.col("accepted"))
    best = select.best_per_target(rows.where(F.col("category").isin("creative", "ood")), ["category", "word"])
    filled = select.backfilled(alone.unionByName(best), per_bin, per_category, whole_ranking=True)
    kept = cut_lineage(select.repetition_capped(filled, quota=per_category, order=select.filled_order()))
    short = kept.groupBy("category").agg((F.lit(per_category) - F.count(F.lit(1))).alias("room"))
    rest = select.ranked(missing(rows, kept, ["prompt_id"]), ["category"], select.best_first()).where(F.col("rank") <= per_category)
    fill = rest.join(joins.small(short), "category", "left").where(F.col("rank") <= F.coalesce("room", F.lit(per_category)))
    return kept.select(*rows.columns).unionByName(fill.select(*rows.columns))


def prompt_table(rows: DataFrame) -> DataFrame:
    """The prompt table's derived columns: both prompts, bin, reference."""
    empty = F.coalesce(F.trim("question_text"), F.lit("")) == ""
    question = F.when(empty, F.raise_error(F.concat(F.lit("empty question: "), "prompt_id")).cast("string")).otherwise(F.col("question_text"))
    return rows.select(
        "prompt_id",
        question.alias("question_text"),
        text.build_prompt(F.col("question_text"), F.col("target_word"), F.lit("baseline")).alias("prompt_text"),
        text.build_prompt(F.col("question_text"), F.col("target_word"), F.lit("negative")).alias("negative_prompt_text"),
        "category",
        "target_word",
        "target_word_normalized",
        F.concat("category", F.lit("_validated.jsonl#prompt_id="), "prompt_id").alias("validation_json_ref"),
        F.col("p_sem").alias("p0"),
        pressure.bin_label(pressure.bin_id(F.col("p_sem"))).alias("p0_bin"),
        "v_score",
        "p_sem",
        "s_score",
    )


def metadata(prompts: DataFrame, taus: DataFrame | None = None, shortfalls: DataFrame | None = None, quota: int = 500, min_tau: float = 0.2, seeds: dict[str, int] | None = None) -> DataFrame:
    """One row: id format, total, counts by category and bin, threshold per category, shortfalls, categories below the quota, seeds, hash of the content.

    ``taus``: (category, tau); without them each category has ``min_tau``.
    ``shortfalls``: (category, bin_id, shortfall). Every part is a row of its
    own, put together by scalar subqueries.
    """
    by = lambda c: writers.counts_map(prompts, c).scalar()
    counted = prompts.groupBy(F.coalesce("category", F.lit("")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    known = taus if taus is not None else counted.select("category", F.lit(float(min_tau)).alias("tau"))
    tau_map = known.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", F.round("tau", 6).alias("tau")))))).scalar()
    failing = counted.where(F.col("n") < quota).agg(F.array_sort(F.collect_list("category"))).scalar()
    out = writers.content_hash(prompts).select(
        F.lit("string_key").alias("prompt_id_type"),
        F.lit("{category}_{target_word_normalized}_{hash8}").alias("prompt_id_format"),
        F.col("n_rows").alias("total_count"),
        by("category").alias("counts_by_category"),
        by("p0_bin").alias("counts_by_p0_bin"),
        tau_map.alias("tau_per_category"),
        failing.alias("gating_failures"),
        F.create_map(*[F.lit(x) for kv in (seeds or {"python": 42, "numpy": 42, "torch": 42}).items() for x in kv]).alias("sampling_seeds"),
        F.lit(float(min_tau)).alias("min_pressure_threshold"),
        "dataset_hash",
    )
    if shortfalls is None:
        return out.withColumn("bin_shortfalls", F.create_map().cast("map<string,bigint>"))
    entry = F.struct(F.concat_ws("|", "category", "bin_id").alias("key"), F.col("shortfall").cast("bigint").alias("value"))
    return out.withColumn("bin_shortfalls", shortfalls.agg(F.map_from_entries(F.array_sort(F.collect_list(entry)))).scalar())


def without_p1(prompts: DataFrame, p1: DataFrame) -> DataFrame:
    """Prompts that have no P1."""
    return prompts.join(p1.where("p1 is not null").select("prompt_id"), "prompt_id", "left_anti")


def require_p1(prompts: DataFrame, p1: DataFrame) -> DataFrame:
    """Prompts with their P1; ValueError naming three of those that lack it, if any does."""
    lacking = [r[0] for r in without_p1(prompts, p1).select("prompt_id").orderBy("prompt_id").limit(3).collect()]
    if lacking:
        raise ValueError(f"no P1 for prompts such as {', '.join(map(str, lacking))}")
    return joins.lookup_join(prompts.drop("p1"), p1.groupBy("prompt_id").agg(F.max("p1").alias("p1")), "prompt_id")


def audit_rows(validated: DataFrame) -> DataFrame:
    """The judge's audit log: one record per validated row with what was parsed of the answer and whether it is accepted."""
    parsed = F.struct(*[F.col(f"validation.{f}").alias(f) for f in ("is_one_word_answer_enforced", "best_one_word_answer", "top3_one_word_answers", "is_X_best", "ambiguity_score", "leaks_answer", "naturalness_score", "comments")], "v_score")
    return validated.select(
        "prompt_id",
        "category",
        F.col("question_text").alias("candidate_text"),
        "target_word",
        F.to_json("validation").alias("raw_response_json"),
        parsed.alias("parsed_fields"),
        pressure.accepted(F.col("validation"), F.col("target_word")).alias("acceptance_decision"),
    )


def built(candidates: DataFrame, responses: DataFrame, shape: str, checkpoint: DataFrame, compute: Callable[[DataFrame], DataFrame], p1: DataFrame, per_category: int = 500, per_bin: int = 100) -> tuple[DataFrame, DataFrame]:
    """(prompts, metadata) from candidates: leak filter, ids, judge, pressure, selection, completeness, derived columns.

    ``candidates`` have cand_id, whose order decides between equal ones.
    """
    kept, _ = filtered_candidates(candidates.where("question_text is not null and target_word is not null and category is not null"))
    word = F.coalesce("target_word_normalized", F.lower("target_word"))
    named = kept.withColumns({"target_word_normalized": word, "prompt_id": text.prompt_id(F.col("category"), word, F.col("question_text"), F.col("target_word"))})
    once = select.first_wins(named.withColumn("_q", text.question_key(F.col("question_text"))), ["_q", "target_word_normalized"], "cand_id").drop("_q")
    rows = cut_lineage(scored(judged(once, responses, shape).withColumns({"p_sem": F.lit(None).cast("double"), "s_score": F.lit(None).cast("double")}), checkpoint, compute).withColumn("pos", F.col("cand_id")))
    chosen = cut_lineage(selected(rows.where("accepted"), per_category, per_bin))
    prompts = require_p1(prompt_table(chosen), p1)
    binned = rows.where("accepted").withColumn("bin_id", pressure.bin_id(F.col("p_sem")))
    taus = select.chosen_tau(select.tau_ladder(binned, per_bin, per_category))
    short = select.bin_shortfalls(select.top_per_bin(binned, per_bin), per_bin, binned)
    return prompts, metadata(prompts, taus, short, per_category)


def tasks(prompts: DataFrame, done: DataFrame, samples: int = 16) -> DataFrame:
    """(prompt_id, condition, sample_id, prompt) still to be run: greedy ones have sample_id ''."""
    grid = prompts.select("prompt_id", "prompt_text", "negative_prompt_text", F.explode(F.array(F.lit("baseline"), F.lit("negative"))).alias("condition"))
    ids = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: i.cast("string"))) if samples else F.array(F.lit(""))
    grid = grid.withColumn("sample_id", F.explode(ids)).withColumn("prompt", F.when(F.col("condition") == "baseline", F.col("prompt_text")).otherwise(F.col("negative_prompt_text")))
    return missing(grid.select("prompt_id", "condition", "sample_id", "prompt"), done, ["prompt_id", "condition", "sample_id"])


def experiment(prompts: DataFrame, done: DataFrame, name: str, factory: Callable[[], model.Batch], samples: int = 16) -> DataFrame:
    """Completions of all tasks that aren't done; the model adds generated_text, tokens and finish_reason."""
    schema = "prompt_id string, condition string, sample_id string, prompt string, generated_text string, tokens array<string>, finish_reason string"
    return model.call(tasks(prompts, done, samples), name, factory, schema)


def behaviour(completions: DataFrame, prompts: DataFrame, most_errors: int = 0, rate: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """(detections, metrics per prompt with a negative sample). Halts on more mapping errors than allowed."""
    looked = completions.join(prompts.select("prompt_id", "target_word", "category"), "prompt_id")
    found = detect.detections(looked.withColumnRenamed("generated_text", "text"))
    writers.check_halt(found, "mapping_error", most_errors, rate)
    negative = found.where((F.col("condition") == "negative") & (F.col("sample_id") != ""))
    share = lambda c: F.avg(c.cast("double"))
    metrics = negative.groupBy("prompt_id").agg(
        F.coalesce(F.max("category"), F.lit("")).alias("category"),
        share(F.col("word_present")).alias("violation_rate"),
        share(F.col("format_adherence")).alias("format_adherence_rate"),
        share(~F.col("word_present") & F.col("format_adherence")).alias("clean_success_rate"),
    )
    return found, metrics


def psem_and_bins(prompts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The suppression table and the table of pressure bins."""
    delta, relative, log = pressure.suppression(F.col("p0"), F.col("p1"))
    b = pressure.bin_id(F.col("p0"))
    psem = prompts.select("prompt_id", "category", "p0", "p1", delta.alias("delta"), relative.alias("relative"), log.alias("log"))
    bins = prompts.select("prompt_id", "category", "p0", b.alias("bin_id"), (b / 5).alias("bin_lower"), ((b + 1) / 5).alias("bin_upper"), pressure.bin_label(b).alias("p0_bin"))
    return psem, bins


def bootstrap_table(prompts: DataFrame, behaviour_metrics: DataFrame, psem: DataFrame, attention: DataFrame, patching: DataFrame, iterations: int = stats.ITERATIONS, seed: int = stats.SEED) -> DataFrame:
    """(metric_name, group_key, mean, ci_low, ci_high, n_prompts, seed) of all four families.

    Patching means per prompt are taken before the join; groups of the attention
    and patching grids without rows come out as NaN.
    """
    bins = prompts.select("prompt_id", "p0_bin").where("p0_bin is not null")
    key = F.concat(F.lit("p0_bin="), "p0_bin")
    shape = lambda d, metric, group: d.select(metric.alias("metric_name"), group.alias("group_key"), "mean", "ci_low", "ci_high", F.col("n").alias("n_prompts"), F.lit(seed).alias("seed"))
    ci = lambda d, keys, v, i: stats.bootstrap_ci(d, keys, v, i, iterations, seed=seed)
    violation = ci(behaviour_metrics.join(bins, "prompt_id"), ["p0_bin"], "violation_rate", "prompt_id")

    def long(d: DataFrame, ids: list[str], names: dict[str, str]) -> DataFrame:
        return d.unpivot(ids, list(names), "m", "v").withColumn("metric", F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("m")))

    suppressed = long(psem.join(bins, "prompt_id").select("prompt_id", "p0_bin", *BIN_METRICS), ["prompt_id", "p0_bin"], BIN_METRICS)
    suppression = ci(suppressed, ["metric", "p0_bin"], "v", "prompt_id")
    seen = long(attention.where("aggregate_flag = 'global_mean'").join(bins, "prompt_id").select("prompt_id", "p0_bin", "condition", *ATTENTION_METRICS), ["prompt_id", "p0_bin", "condition"], ATTENTION_METRICS)
    all_bins = bins.select("p0_bin").distinct()
    grid = all_bins.crossJoin(joins.small(attention.select("condition").distinct())).crossJoin(joins.small(seen.select("metric").distinct()))
    attended = stats.on_grid(grid, ci(seen, ["metric", "p0_bin", "condition"], "v", "prompt_id"), ["metric", "p0_bin", "condition"])
    per_prompt = patching.groupBy("prompt_id", "patch_type").agg(F.avg(pressure.number_or_null(F.col("delta_p"))).alias("v")).join(bins, "prompt_id")
    patch_grid = all_bins.crossJoin(joins.small(patching.select("patch_type").distinct()))
    patched = stats.on_grid(patch_grid, ci(per_prompt, ["p0_bin", "patch_type"], "v", "prompt_id"), ["p0_bin", "patch_type"])
    parts = (
        shape(violation, F.lit("violation_rate"), key),
        shape(suppression, F.col("metric"), key),
        shape(attended, F.col("metric"), F.concat(key, F.lit("|condition="), "condition")),
        shape(patched, F.lit("patching_delta_p"), F.concat(key, F.lit("|patch_type="), "patch_type")),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def high_pressure_subset(prompts: DataFrame, outcomes: DataFrame, seed: int = 42) -> DataFrame:
    """(prompt_id, category, p0, p0_bin, outcome) above the upper quartile, failures and successes in equal number; the median if that leaves none."""
    known = prompts.join(outcomes, "prompt_id")
    level = lambda q: known.agg(F.greatest(F.lit(0.7), F.least(F.lit(0.95), F.percentile("p0", F.lit(q)))).alias("t")).scalar()
    above = lambda q: known.where(F.col("p0") >= level(q))
    top = above(0.75)
    if top.isEmpty():
        top = above(0.5)
    return select.balanced_subset(top, "outcome", "prompt_id", seed).select("prompt_id", "category", "p0", "p0_bin", "outcome")


def patch_inputs(subset: DataFrame, prompts: DataFrame, outcomes: DataFrame, completions: DataFrame) -> DataFrame:
    """The patching subset with prompt, outcome and its last greedy negative completion; rows that lack one are left out."""
    greedy = completions.where((F.col("condition") == "negative") & (F.coalesce("sample_id", F.lit("")) == ""))
    last = select.last_wins(greedy.select("prompt_id", "row_id", "completion_text"), ["prompt_id"], "row_id")
    rows = subset.select("prompt_id").join(prompts, "prompt_id").join(outcomes, "prompt_id")
    return rows.join(last.select("prompt_id", "completion_text"), "prompt_id")


def condition_pairs(states: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, base, own): baseline and negative state of the same prompt and place; those that lack one are left out."""
    of = lambda c, name: states.where(F.col("condition") == c).select(*keys, F.col("state").alias(name))
    return of("negative", "own").join(of("baseline", "base"), keys)


PATCH_TYPES = ("A", "B", "C", "D")


def patched_states(pairs: DataFrame, target_positions: Column, aligned_pairs: Column) -> DataFrame:
    """A row per patch type: residual (A) and attention output (B) take the last element, keys and values the positions of the target (C) or aligned pairs (D) of the baseline."""
    last = F.array(F.size("own") - 1)
    of = {"A": arrays.patched(F.col("own"), F.col("base"), last), "B": arrays.patched(F.col("own"), F.col("base"), last), "C": arrays.patched(F.col("own"), F.col("base"), target_positions), "D": arrays.patched_pairs(F.col("own"), F.col("base"), aligned_pairs)}
    kinds = F.explode(F.array(*[F.struct(F.lit(t).alias("patch_type"), c.alias("patched")) for t, c in of.items()]))
    return pairs.withColumn("_p", kinds).select(*pairs.columns, "_p.*")


def patch_results(runs: DataFrame) -> DataFrame:
    """Effect of each patch: delta_p and whether the answer flips. ``runs``: p_sem_original_neg, p_sem_patched, violation flags."""
    return runs.withColumn("delta_p", F.col("p_sem_patched") - F.col("p_sem_original_neg")).withColumn("flip_indicator", (F.col("original_violation") != F.col("patched_violation")).cast("int"))


def report_tables(spark: SparkSession, bootstrap: DataFrame, attention: DataFrame, lens: DataFrame, decomposition: DataFrame, patching: DataFrame, prompts: DataFrame, outcomes: DataFrame) -> dict[str, DataFrame]:
    """The figures' data, a table each; unknown outcomes are named so."""
    bins = prompts.select("prompt_id", "p0_bin")
    known = lambda d: d.join(outcomes, "prompt_id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("unknown")))
    mean = lambda *cs: [F.avg(pressure.number_or_null(F.col(c))).alias(c) for c in cs]
    bars = stats.error_bars(bootstrap).withColumn("bin_lower", pressure.bin_lower(F.element_at(F.split("group_key", "="), -1)))
    patch = patching if "p0_bin" in patching.columns else patching.join(bins, "prompt_id")
    return {
        "violation_vs_pressure": bars.where("metric_name = 'violation_rate'"),
        "suppression_vs_pressure": bars.where("metric_name = 'suppression_relative'"),
        "attention_by_bin_outcome": known(attention.where("aggregate_flag = 'global_mean'").join(bins, "prompt_id")).where(F.col("outcome").isin("success", "failure")).groupBy("p0_bin", "outcome").agg(*mean("iar", "nf", "tmf"), F.count(F.lit(1)).alias("n")),
        "lens_curves": known(lens).groupBy("condition", "outcome", "layer").agg(*mean("p_sem_first_token")),
        "component_curves": known(decomposition).groupBy("outcome", "layer").agg(*mean("attn_contrib", "ffn_contrib")),
        "patch_effects": patch.groupBy("p0_bin", "layer").agg(*mean("delta_p")),
    }
