import json
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kilnspark.functions import arrays, tables
from kilnspark.operators import detect, model
from kilnspark.plans import pipelines
from kilnspark.sources import cached


def test_cached_bindings(spark, tmp_path):
    row = lambda s, o: {"subject": {"value": s}, "object": {"value": o}}
    (tmp_path / "P36.json").write_text(json.dumps({"results": {"bindings": [row("Norway", "Oslo"), {"subject": {"value": "x"}}]}}))
    (tmp_path / "bad.json").write_text("{")
    cached.register(spark)
    broken = spark.read.format("cached_bindings").option("path", str(tmp_path)).load()
    with pytest.raises(Exception, match=r"bad\.json"):
        broken.collect()
    got = spark.read.format("cached_bindings").option("path", str(tmp_path)).option("skipBroken", "true").load()
    assert [tuple(r) for r in got.collect()] == [("P36", "Norway", "Oslo")]
    assert spark.read.format("cached_bindings").option("path", str(tmp_path / "none.json")).option("skipBroken", "true").load().count() == 0


def test_cached_lines_stream_stops_early(spark, tmp_path):
    (tmp_path / "t.txt").write_text("".join(f"line {i}\n" for i in range(50)))
    cached.register(spark)
    rows = spark.readStream.format("cached_lines").option("path", str(tmp_path / "t.txt")).option("batch", "7").option("most", "20").load()
    q = rows.writeStream.format("memory").queryName("cached_lines_test").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["line_no"] for r in spark.table("cached_lines_test").collect()) == list(range(20))


def test_table_functions(spark):
    from kilnspark.functions.text import surface_variants

    tables.register(spark)
    a = [r[0] for r in spark.sql("select * from surface_variants('sPace')").collect()]
    b = spark.createDataFrame([("sPace",)], "w string").select(surface_variants(F.col("w"))).first()[0]
    assert a == b
    assert [tuple(r) for r in spark.sql("select * from word_spans('cup', 'Cup, a cup')").collect()] == [(0, 3), (7, 10)]


def test_detection(spark):
    rows = [
        ("1", "space.", ["sp", "ace", "."], "space"),
        ("2", "spacetime", ["space", "time"], "space"),
        ("3", "my space", ["my", " space"], "space"),
        ("4", "space", None, "space"),
        ("5", None, None, "space"),
        ("6", "a space and Space", ["a", " sp", "ace and Sp", "ace"], "space"),
    ]
    df = spark.createDataFrame(rows, "prompt_id string, text string, tokens array<string>, target_word string")
    got = {r["prompt_id"]: r for r in detect.detections(df).collect()}
    spans = {k: [(s["start"], s["end"]) for s in r["token_spans"]] for k, r in got.items()}
    assert spans == {"1": [(0, 1)], "2": [], "3": [(1, 1)], "4": [], "5": [], "6": [(1, 2), (2, 3)]}
    assert [got[k]["mapping_error"] for k in "123456"] == [False, False, False, True, False, False]
    assert got["3"]["pre_target_token_indices"] == [0] and got["1"]["pre_target_token_indices"] == [None]
    assert got["1"]["format_adherence"] and not got["3"]["format_adherence"] and got["5"]["format_adherence"] is False


def spans_of(spark, prompt, target, condition):
    df = spark.createDataFrame([(prompt, target, condition)], "p string, t string, c string")
    r = df.select(detect.prompt_spans(F.col("p"), F.col("t"), F.col("c")).alias("s")).first()["s"]
    return tuple(prompt[x["start"] : x["end"]] if x else None for x in (r["instruction"], r["negation"], r["target_mention"], r["question"]))


FIRST = "Answer with exactly one English word."
BASE = f"{FIRST}\nQuestion: What is 2+2?\nAnswer:"
NEG = f'{FIRST}\nDo not use the word "four" anywhere in your answer.\nQuestion: What is 2+2?\nAnswer:'


@pytest.mark.parametrize(
    ("prompt", "target", "condition", "want"),
    [
        (BASE, "four", "baseline", (FIRST, None, None, "What is 2+2?")),
        (NEG, "four", "negative", ('Do not use the word "four" anywhere in your answer.', "Do not use", "four", "What is 2+2?")),
        (NEG.replace("four", "word"), "word", "negative", ('Do not use the word "word" anywhere in your answer.', "Do not use", "word", "What is 2+2?")),
        (NEG.replace("four", "not"), "not", "negative", ('Do not use the word "not" anywhere in your answer.', "Do not use", "not", "What is 2+2?")),
        (f'Do not use "four" here.\nQuestion: x\nAnswer: y\nAnswer:', "four", "negative", ('Do not use "four" here.', "Do not use", "four", "x")),
        ("Do not use four", "four", "negative", ("Do not use four", "Do not use", None, None)),
        ("Question: open end", "four", "negative", (None, None, None, "open end")),
        (NEG, None, "negative", ('Do not use the word "four" anywhere in your answer.', "Do not use", None, "What is 2+2?")),
        ("", "four", "baseline", (None, None, None, None)),
        (NEG, "four", "other", (None, None, None, "What is 2+2?")),
    ],
)
def test_prompt_spans(spark, prompt, target, condition, want):
    assert spans_of(spark, prompt, target, condition) == want


def test_matches_with_offsets_of_a_tokenizer():
    tokens = ["The", " an", "swer", " is", " foo", "t", "."]
    offsets = detect.token_offsets(tokens)
    assert detect.map_match(tokens, offsets, (13, 17), "foot") is None  # the match is taken from another text
    assert detect.map_match(tokens, offsets, (14, 18), "foot") == (4, 5)
    assert detect.simple_match(offsets, (14, 18)) == (4, 5, 14, 18) and detect.simple_match(offsets, (90, 91)) is None
    # Offsets without the blanks: the smallest cover misses the match's end, a wider one holds it.
    assert detect.map_match([" ", "foo", "t"], [(0, 1), (1, 3), (3, 5)], (1, 5), "foot") == (1, 2)
    assert detect.map_match(["foot", "ball"], [(0, 4), (4, 8)], (0, 4), "foot") is None  # not whole


# Factories are made inside functions, so that workers, which don't have this module, get them by value.


def coder():
    return lambda: lambda d: d.assign(ids=[[ord(c) for c in v.strip()[:2]] if len(v.strip()) > 1 else [7] for v in d["variant"]])


def likelihoods():
    def run(d):
        if len(d) > 3:
            raise MemoryError
        return d.assign(logprobs=[None if i[0] == 0 else [math.log(0.25)] * len(i) for i in d["ids"]])

    return lambda: run


def test_model_boundary(spark):
    seqs = model.token_sequences(spark.createDataFrame([("cup",), ("cup",), (None,)], "w string"), "w", "coder", coder())
    got = seqs.collect()
    assert len(got) == 1 and len(got[0]["sequences"]) == len({tuple(s) for s in got[0]["sequences"]}) == 3
    assert model.single_token_words(spark.createDataFrame([("a", [[1]]), ("b", [[1, 2]])], "word string, sequences array<array<int>>")).collect()[0][0] == "a"
    prompts = spark.createDataFrame([("p1", "x", "cup"), ("p2", "y", "cup")], "prompt_id string, prompt_text string, target_word string")
    p = {r["prompt_id"]: r["p_sem"] for r in model.pressure_of(prompts, seqs, "lik", likelihoods()).collect()}
    assert p == pytest.approx({"p1": 3 / 16, "p2": 3 / 16})
    bad = spark.createDataFrame([("cup", [[0]])], "word string, sequences array<array<int>>")
    with pytest.raises(Exception, match="no pressure for"):
        model.pressure_of(prompts, bad, "lik", likelihoods()).collect()
    rest = model.rest_sums(spark.createDataFrame([("p", [5], None), ("p", [5, 6], [math.log(0.5)]), ("p", [7, 8], [math.log(0.1)])], "prompt_id string, ids array<int>, rest_logprobs array<double>")).first()["rest"]
    assert rest == pytest.approx({5: 1.5, 7: 0.1})
    first = F.array(*[F.lit(0.1 * i) for i in range(9)])
    assert spark.createDataFrame([(rest,)], "rest map<int,double>").select(arrays.factorised(first, F.col("rest"))).first()[0] == pytest.approx(0.5 * 1.5 + 0.7 * 0.1)


SHAPE = "is_one_word_answer_enforced boolean, best_one_word_answer string, top3_one_word_answers array<string>, is_X_best boolean, ambiguity_score int, leaks_answer boolean, naturalness_score int"


def test_from_candidates_to_prompts(spark):
    n = 40
    good = json.dumps({"is_one_word_answer_enforced": True, "best_one_word_answer": "cup", "top3_one_word_answers": ["cup"], "is_X_best": True, "ambiguity_score": 0, "leaks_answer": False, "naturalness_score": 9})
    rows = [(f"p{i}", c, f"Question {i} ____.", "cup", "cup", i) for c in ("idioms", "facts", "ood") for i in range(n)]
    rows = [(f"{c}{p}", c, q, t, w, i) for p, c, q, t, w, i in rows] + [("leak", "facts", "A cup is a ____.", "cup", "cup", 99)]
    cands = spark.createDataFrame(rows, "prompt_id string, category string, question_text string, target_word string, target_word_normalized string, pos int")
    kept, why = pipelines.filtered_candidates(cands)
    assert {r["reason"]: r["n"] for r in why.collect()} == {"whole_word_leak": 1} and kept.count() == 3 * n
    assert json.loads(pipelines.judge_requests(kept, "judge", "m").first()["request"])["custom_id"]
    answers = kept.where("pos % 2 = 0").select(F.col("prompt_id").alias("custom_id"), F.lit(f"```json\n{good}\n```").alias("answer"), F.lit(None).cast("string").alias("error"))
    rated = pipelines.judged(kept, answers, SHAPE)
    assert rated.where("accepted").count() == 3 * n // 2 and rated.agg(F.max("v_score")).first()[0] == 100
    stored = spark.createDataFrame([("idiomsp0", 0.9)], "prompt_id string, p_sem double")
    done = pipelines.scored(rated, stored, lambda d: d.select("prompt_id", (F.col("pos") / 40.0).alias("p_sem")))
    assert done.where("prompt_id = 'idiomsp0'").first()["p_sem"] == 0.9 and done.where("p_sem is null").count() == 0
    final = pipelines.selected(done, per_category=10, per_bin=4)
    counts = {r["category"]: r["count"] for r in final.groupBy("category").count().collect()}
    assert counts == {"idioms": 10, "facts": 10, "ood": 10}
    table = pipelines.prompt_table(final)
    assert table.where(F.col("prompt_text").startswith("Answer with")).count() == 30
    assert pipelines.metadata(table).first()["counts_by_category"] == counts
    left = pipelines.tasks(table, spark.createDataFrame([(table.first()["prompt_id"], "baseline", "")], "prompt_id string, condition string, sample_id string"), samples=2)
    assert left.count() == 30 * 2 * 3 - 1


def parrot():
    def run(d):
        words = ["cup" if c == "baseline" or s == "0" else "mug" for c, s in zip(d["condition"], d["sample_id"], strict=True)]
        return d.assign(generated_text=words, tokens=[[w] for w in words], finish_reason="stop")

    return lambda: run


def test_behaviour_and_reports(spark):
    prompts = spark.createDataFrame([(f"p{i}", "facts", "cup", "a", "b", i / 20, i / 40, f"{'0.0-0.2' if i < 5 else '0.2-0.4'}") for i in range(10)], "prompt_id string, category string, target_word string, prompt_text string, negative_prompt_text string, p0 double, p1 double, p0_bin string")
    none = spark.createDataFrame([], "prompt_id string, condition string, sample_id string")
    done = pipelines.experiment(prompts, none, "parrot", parrot(), samples=2)
    found, metrics = pipelines.behaviour(done, prompts)
    assert {(r["violation_rate"], r["clean_success_rate"]) for r in metrics.collect()} == {(0.5, 0.5)} and metrics.count() == 10
    psem, bins = pipelines.psem_and_bins(prompts)
    attention = prompts.select("prompt_id", F.explode(F.array(F.lit("baseline"), F.lit("negative"))).alias("condition"), F.lit("global_mean").alias("aggregate_flag"), *[F.lit(0.5).alias(c) for c in ("iar", "nf", "tmf", "pi")])
    patching = prompts.where("p0_bin = '0.0-0.2'").select("prompt_id", F.lit("A").alias("patch_type"), F.lit(1).alias("layer"), F.col("p0").alias("delta_p"))
    boot = pipelines.bootstrap_table(prompts, metrics, psem, attention, patching, iterations=50)
    rows = {(r["metric_name"], r["group_key"]): r for r in boot.collect()}
    assert len(rows) == 2 + 6 + 16 + 2 and rows["violation_rate", "p0_bin=0.0-0.2"]["mean"] == 0.5
    empty = rows["patching_delta_p", "p0_bin=0.2-0.4|patch_type=A"]
    assert empty["n_prompts"] == 0 and math.isnan(empty["mean"])
    outcomes = prompts.select("prompt_id", F.when(F.col("p0") > 0.3, "failure").otherwise("success").alias("outcome"))
    lens = prompts.select("prompt_id", F.lit("negative").alias("condition"), F.lit(1).alias("layer"), F.col("p1").alias("p_sem_first_token"))
    parts = prompts.select("prompt_id", F.lit(1).alias("layer"), F.col("p0").alias("attn_contrib"), F.col("p1").alias("ffn_contrib"))
    made = pipelines.report_tables(spark, boot, attention, lens, parts, patching, prompts, outcomes.limit(9))
    assert {k: v.count() for k, v in made.items()} == {"violation_vs_pressure": 2, "suppression_vs_pressure": 2, "attention_by_bin_outcome": 3, "lens_curves": 3, "component_curves": 3, "patch_effects": 1}
    assert pipelines.high_pressure_subset(prompts.withColumn("p0", F.col("p0") * 2), outcomes).groupBy("outcome").count().count() == 1
    flips = spark.createDataFrame([(0.1, 0.4, True, False)], "p_sem_original_neg double, p_sem_patched double, original_violation boolean, patched_violation boolean")
    assert pipelines.patch_results(flips).first()["flip_indicator"] == 1


def test_workers_keep_their_model():
    model._LOADED.pop("once", None)
    made = []
    f = lambda: made.append(1) or (lambda d: d)
    assert model.loaded("once", f) is model.loaded("once", f) and made == [1]
    assert isinstance(model.loaded("once", f)(pd.DataFrame()), pd.DataFrame)


def test_data_set_from_candidates_to_metadata(spark):
    words = ["bread", "water", "stone", "wheel", "lamp", "rope"]
    rows = [(i, ["facts", "idioms"][i % 2], f"Question {i // 2} asks for ____.", w, None, "s", "t", "{}") for i, w in enumerate(words * 4)]
    rows += [(900, "facts", "The bread is ____.", "bread", None, "s", "t", "{}"), (901, "facts", None, "x", None, "s", "t", "{}"), (902, None, "q", "x", None, "s", "t", "{}")]
    schema = "cand_id long, category string, question_text string, target_word string, target_word_normalized string, prompt_style_id string, source_trace string, raw_data string"
    c = spark.createDataFrame(rows, schema)
    from kilnspark.functions import text
    from kilnspark.schemas import VALIDATION

    ids = c.where("cand_id < 900").select(text.prompt_id(F.col("category"), F.col("target_word"), F.col("question_text"), F.col("target_word")).alias("custom_id"), "target_word", "cand_id")
    verdict = F.concat(F.lit('{"is_X_best": true, "is_one_word_answer_enforced": true, "ambiguity_score": 1, "leaks_answer": false, "naturalness_score": 9, "best_one_word_answer": "'), "target_word", F.lit('"}'))
    responses = ids.select("custom_id", verdict.alias("answer"), F.when(F.col("cand_id") == 3, "failed").alias("error"))
    none = spark.createDataFrame([], "prompt_id string, p_sem double")
    compute = lambda d: d.select("prompt_id", (F.col("cand_id") / 24).alias("p_sem"))
    p1 = ids.select(F.col("custom_id").alias("prompt_id"), F.lit(0.1).alias("p1"))
    prompts, meta = pipelines.built(c, responses, VALIDATION, none, compute, p1, per_category=8, per_bin=4)
    got, m = prompts.collect(), meta.first()
    assert len(got) == m["total_count"] == sum(m["counts_by_category"].values()) and all(r["p1"] == 0.1 for r in got)
    assert m["counts_by_category"].get("facts") == 8 and set(m["tau_per_category"]) <= {"facts", "idioms"}
    with pytest.raises(ValueError, match="no P1"):
        pipelines.require_p1(prompts.drop("p1"), p1.limit(1))


def test_the_last_record_of_a_checkpoint_counts(spark):
    v = spark.createDataFrame([("a", 10), ("b", 20)], "prompt_id string, v_score int").withColumns({"p_sem": F.lit(None).cast("double"), "s_score": F.lit(None).cast("double")})
    log = spark.createDataFrame([("a", 0.9, 1), ("a", 0.2, 2)], "prompt_id string, p_sem double, _pos int")
    compute = lambda d: d.select("prompt_id", F.lit(0.5).alias("p_sem"))
    got = {r["prompt_id"]: r["s_score"] for r in pipelines.scored(v, log, compute).collect()}
    assert got == {"a": 10 + 20.0, "b": 20 + 50.0}


def test_detections_decide_the_attention_step(spark):
    from kilnspark.operators import mechanics

    traces = spark.createDataFrame([("a", "negative", 3), ("b", "negative", 3), ("c", "negative", 3), ("d", "negative", 2)], "prompt_id string, condition string, n_steps int")
    spans = "array<struct<start:int,end:int>>"
    found = spark.createDataFrame([("a", "negative", True, False, [(1, 1)]), ("b", "negative", False, False, []), ("c", "negative", True, True, [(0, 0)])], f"prompt_id string, condition string, word_present boolean, mapping_error boolean, token_spans {spans}")
    got = {r["prompt_id"]: (r["decision_step"], r["status"]) for r in mechanics.decisions(traces, found).collect()}
    assert got == {"a": (1, "ok"), "b": (0, "ok"), "c": (None, "mapping_error"), "d": (None, "no_entry")}
    assert {r["decision_step"] for r in mechanics.decisions(traces, found.limit(0)).collect()} == {0}
