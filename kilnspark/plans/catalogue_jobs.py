"""Queries of the jobs over traces, of report figures, candidate generation and smaller readings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnspark.functions import arrays, pressure, text
from kilnspark.functions.names import name_key
from kilnspark.operators import detect, generate, mechanics, select, stats
from kilnspark.plans import pipelines
from kilnspark.plans.catalogue import _CAT, _DEC, _DET, _ONCE, _OUTCOME, _P, _PAT, _RANKED, _TAU, _TR, _VAL, _bootstrap_sql, _decomposed, _det, _once, _outcomes, _p, _patches, _query, _r, _tr
from kilnspark.session import table

# Prompts and attention over stored traces

_BOTH = """bp as (select prompt_id, target_word, c "condition", case when c = 'baseline' then 'Answer with exactly one English word.' || chr(10) || 'Question: ' || question_text || chr(10) || 'Answer:'
  else 'Answer with exactly one English word.' || chr(10) || 'Do not use the word "' || target_word || '" anywhere in your answer.' || chr(10) || 'Question: ' || question_text || chr(10) || 'Answer:' end prompt
  from p, unnest(['baseline', 'negative']) u(c) where question_text is not null and target_word is not null)"""
_LINE = """'Do not use the word "' || target_word || '" anywhere in your answer.'"""
_SPANS = f"""sp as (select prompt_id, target_word, "condition", prompt, instr(prompt, case when "condition" = 'baseline' then 'Answer with exactly one English word.' else {_LINE} end) - 1 i_start,
    length(case when "condition" = 'baseline' then 'Answer with exactly one English word.' else {_LINE} end) i_len,
    case when "condition" = 'negative' then instr(prompt, {_LINE}) - 1 end n_start, case when "condition" = 'negative' then instr(prompt, {_LINE}) - 1 + 21 end t_start,
    instr(prompt, 'Question: ') - 1 + 10 q_start from bp),
  sp2 as (select *, q_start + instr(substr(prompt, q_start + 1), chr(10) || 'Answer:') - 1 q_end from sp)"""


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _p(spark, sf_dir).where("question_text is not null and target_word is not null")
    each = p.select("prompt_id", "question_text", "target_word", F.explode(F.array(F.lit("baseline"), F.lit("negative"))).alias("condition"))
    return each.withColumn("prompt", text.build_prompt(F.col("question_text"), F.col("target_word"), F.col("condition")))


@_query(f"""with {_P}, {_BOTH}, {_SPANS} select prompt_id, "condition", i_start::int instruction_start, (i_start + i_len)::int instruction_end, coalesce(n_start, -1)::int negation_start, coalesce(n_start + 10, -1)::int negation_end,
  coalesce(t_start, -1)::int target_start, coalesce(t_start + length(target_word), -1)::int target_end, q_start::int question_start, q_end::int question_end from sp2""")
def prompt_char_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where instruction, negation, target mention and question stand in both prompts of every question; -1 where there is none."""
    s = _both(spark, sf_dir).withColumn("s", detect.prompt_spans(F.col("prompt"), F.col("target_word"), F.col("condition")))
    bounds = [F.coalesce(f"s.{f}.{b}", F.lit(-1)).alias(f"{n}_{b}") for n, f in (("instruction", "instruction"), ("negation", "negation"), ("target", "target_mention"), ("question", "question")) for b in ("start", "end")]
    return s.select("prompt_id", "condition", *bounds)


# Traces: a prompt's tokens are its words with the blanks before them; the weights of a head are squares of one of the embeddings, shifted by step, layer and head.
STEPS, LAYERS, HEADS = 3, 2, 2
_TRACE = f"""tk as (select prompt_id, target_word, "condition", prompt, i_start, i_len, n_start, t_start, q_start, q_end, regexp_extract_all(prompt, '\\s*\\S+') t from sp2),
  tf as (select *, list_transform(range(0, len(t)), lambda i: coalesce(list_sum(list_transform(t[1:i], lambda x: length(x))), 0)) s0, list_transform(range(0, len(t)), lambda i: list_sum(list_transform(t[1:i + 1], lambda x: length(x)))) s1 from tk),
  ix as (select prompt_id, "condition", len(t) n, list_filter(range(0, len(t)), lambda i: s1[i + 1] > i_start and s0[i + 1] < i_start + i_len) ii, list_filter(range(0, len(t)), lambda i: s1[i + 1] > n_start and s0[i + 1] < n_start + 10) ni,
    list_filter(range(0, len(t)), lambda i: s1[i + 1] > t_start and s0[i + 1] < t_start + length(target_word)) ti, list_filter(range(0, len(t)), lambda i: s1[i + 1] > q_start and s0[i + 1] < q_end) qi from tf),
  dl as (select prompt_id, "condition", row_id, word_present from det qualify row_number() over (partition by prompt_id, "condition" order by row_id desc) = 1),
  st as (select ix.*, row_id, coalesce(word_present, false) word_present, case when row_id is null then 'no_entry' when row_id % 17 = 0 then 'mapping_error' else 'ok' end status,
    (case when not word_present then 0 else least(row_id % 5, {STEPS - 1}) end)::int decision_step from ix left join dl using (prompt_id, "condition")),
  hd as (select st.*, layer, head, list_transform(embedding, lambda x: x::double * x::double) w, 11 * decision_step + 7 * layer + 3 * head shift from st, range(0, {LAYERS}) l(layer), range(0, {HEADS}) h(head), embeddings
    where status = 'ok' and vec_id = ('0x' || md5(prompt_id || '|' || "condition")[1:6])::bigint % 500),
  ms as (select *, coalesce(list_sum(list_transform(ii, lambda i: w[(i + shift) % 64 + 1])), 0) mi, coalesce(list_sum(list_transform(ni, lambda i: w[(i + shift) % 64 + 1])), 0) mn,
    coalesce(list_sum(list_transform(ti, lambda i: w[(i + shift) % 64 + 1])), 0) mt, coalesce(list_sum(list_transform(qi, lambda i: w[(i + shift) % 64 + 1])), 0) mq from hd),
  ah as (select prompt_id, "condition", decision_step, word_present, layer, head, mi / (mi + mq + 1e-9) iar, mn / (mi + 1e-9) nf, mt / (mi + 1e-9) tmf, mt / (mi + 1e-9) - mn / (mi + 1e-9) pi from ms),
  att as (select prompt_id, "condition", decision_step, word_present, coalesce(layer, -1)::int layer, coalesce(head, -1)::int head, case when grouping(layer) = 1 then 'global_mean' when grouping(head) = 1 then 'layer_mean' else 'head' end aggregate_flag,
    avg(iar) iar, avg(nf) nf, avg(tmf) tmf, avg(pi) pi from ah group by grouping sets ((prompt_id, "condition", decision_step, word_present, layer, head), (prompt_id, "condition", decision_step, word_present, layer), (prompt_id, "condition", decision_step, word_present)))"""
_JOB = f"{_P}, {_DET}, {_BOTH}, {_SPANS}, {_TRACE}"


def _attention(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    both = _both(spark, sf_dir)
    tokens = F.regexp_extract_all("prompt", F.lit(r"(?U)(\s*\S+)"), F.lit(1))
    offsets = both.select("prompt_id", "condition", F.lit(STEPS).alias("n_steps"), arrays.running_spans(tokens).alias("offsets"), F.size(tokens).alias("n"))
    number = F.conv(F.substring(F.md5(F.concat("prompt_id", F.lit("|"), "condition")), 1, 6), 16, 10).cast("bigint") % 500
    squares = F.transform(arrays.doubles(F.col("embedding")), lambda x: x * x)
    weights = table(spark, sf_dir, "embeddings").select("vec_id", squares.alias("w"))
    each = offsets.select("prompt_id", "condition", "n", number.alias("vec_id")).join(weights, "vec_id")
    spread = lambda c, k: F.explode(F.array(*[F.lit(i) for i in range(k)])).alias(c)
    heads = each.select("*", spread("step", STEPS)).select("*", spread("layer", LAYERS)).select("*", spread("head", HEADS))
    shift = 11 * F.col("step") + 7 * F.col("layer") + 3 * F.col("head")
    at = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", ((i + shift) % 64).cast("int")))
    heads = heads.select("prompt_id", "condition", "step", "layer", "head", at.alias("weights"))
    found = select.last_wins(_detections(spark, sf_dir), ["prompt_id", "condition"], "row_id")
    return mechanics.attention(both.where("condition = 'baseline'"), offsets.drop("n"), heads, found)


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _det(spark, sf_dir).where("prompt_id is not null")
    spans = F.array(F.struct((F.col("row_id") % 5).cast("int").alias("start"), (F.col("row_id") % 5 + F.col("row_id") % 2).cast("int").alias("end")))
    return d.select("row_id", "prompt_id", "condition", "word_present", (F.col("row_id") % 17 == 0).alias("mapping_error"), spans.alias("token_spans"))


@_query(f"""with {_JOB} select prompt_id, "condition", decision_step, word_present, layer, head, aggregate_flag, round(iar, 6) iar, round(nf, 6) nf, round(tmf, 6) tmf, round(pi, 6) pi from att""")
def attention_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention scores at each answer's decision step, per head, layer and over all, from stored weights and token offsets."""
    rows, _ = _attention(spark, sf_dir)
    return rows.select("prompt_id", "condition", "decision_step", "word_present", "layer", "head", "aggregate_flag", *[_r(F.col(c), c) for c in mechanics.SCORES])


@_query(f"""with {_JOB} select status, count(*) n from st group by 1""")
def attention_job_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces by what became of them."""
    return _attention(spark, sf_dir)[1]


@_query(f"""with {_JOB}, g as (select prompt_id, pi from att where aggregate_flag = 'global_mean' and "condition" = 'negative'),
  j as (select pi x, violation_rate y from g join behavior_metrics using (prompt_id) where violation_rate is not null and not isnan(violation_rate))
  select round(regr_slope(y, x), 6) slope, round(regr_intercept(y, x), 6) intercept, round(regr_r2(y, x), 6) r2, count(*) n from j""")
def regression_pi_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares of violation rate on the priming index."""
    seen = _attention(spark, sf_dir)[0].where("aggregate_flag = 'global_mean' and condition = 'negative'").select("prompt_id", "pi")
    fit = stats.regression(seen.join(table(spark, sf_dir, "behavior_metrics").select("prompt_id", "violation_rate"), "prompt_id"), "violation_rate", "pi")
    return fit.select(*[_r(F.col(c), c) for c in ("slope", "intercept", "r2")], "n")


@_query(f"""with {_JOB}, {_OUTCOME}, g as (select prompt_id, tmf, nf from att where aggregate_flag = 'global_mean' and "condition" = 'negative')
  select prompt_id, round(p0 - p1, 6) delta, round(tmf - nf, 6) tmf_minus_nf, case when coalesce(p0 - p1 < 0, false) or coalesce(tmf - nf > 0.02, false) then 'priming' else 'override' end failure_mode
  from p join oc using (prompt_id) left join g using (prompt_id) where outcome = 'failure'""")
def failure_modes_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures with their suppression, the attention looked up for them, and their mode."""
    p = _p(spark, sf_dir).select("prompt_id", (F.col("p0") - F.col("p1")).alias("delta"))
    modes = mechanics.failure_modes(p, _attention(spark, sf_dir)[0], _outcomes(spark, sf_dir))
    return modes.select("prompt_id", _r(F.col("delta"), "delta"), _r(F.col("tmf_minus_nf"), "tmf_minus_nf"), "failure_mode")


# Targets and the lens over sets of ids

_SEQ = "[g[1:1], g[2:3], g[3:3], g[1:1]]"


@_query(f"""with t as (select row_id, generated_token_ids g, (row_id % 4)::int s, (row_id % 4 + row_id % 3)::int e, row_id % 5 <> 0 present from completions_greedy where generated_token_ids is not null),
  f as (select *, list_sort(list_distinct(list_transform(list_filter({_SEQ}, lambda x: len(x) = 1), lambda x: x[1]))) exact, coalesce(present and e > s and s < len(g), false) split from t),
  i as (select row_id, case when split then list_sort(list_distinct(list_concat([g[s + 1]], list_transform(list_filter([[g[s + 1] + 1], g[1:2]], lambda x: len(x) = 1), lambda x: x[1])))) else exact end ids, split from f)
  select row_id, case when split then 'prefix' else 'exact' end kind, array_to_string(ids, ',') ids from i""")
def metric_target_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids whose probability is followed, from parts of each answer's ids that stand for token sequences."""
    c = table(spark, sf_dir, "completions_greedy").where("generated_token_ids is not null")
    g, cut = F.col("generated_token_ids"), lambda a, n: F.slice("generated_token_ids", a, n)
    start = (F.col("row_id") % 4).cast("int")
    spans = F.array(F.struct(start.alias("start"), (start + (F.col("row_id") % 3).cast("int")).alias("end")))
    variants = F.array(F.array(F.get(g, start) + 1), cut(1, 2))
    found = arrays.metric_targets(F.col("row_id") % 5 != 0, arrays.first_ids(F.array(cut(1, 1), cut(2, 2), cut(3, 1), cut(1, 1))), spans, g, variants)
    return c.select("row_id", found.alias("t")).select("row_id", "t.kind", F.array_join("t.ids", ",").alias("ids"))


_LENS = """ln as (select vec_id, layer, "condition", label, logits, list_transform(logits, lambda x: exp(x - list_max(logits))) e from tr),
  lp as (select vec_id, layer, "condition", list_transform(e, lambda x: x / list_sum(e)) p, list_distinct([label, 5, 5, 99]) ids from ln),
  lr as (select vec_id, layer, "condition", coalesce(list_sum(list_transform(list_filter(ids, lambda i: i < 64), lambda i: p[i + 1])), 0) p_sem, (list_position(p, list_max(p)) - 1)::int greedy_id, list_max(p) greedy_prob from lp)"""


def _lens(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = mechanics.lens(F.col("logits"), F.array(F.col("label"), F.lit(5), F.lit(5), F.lit(99)))
    return _tr(spark, sf_dir).select("vec_id", "prompt_id", "layer", "condition", row.alias("l")).select("vec_id", "prompt_id", "layer", "condition", "l.*")


@_query(f"with {_TR}, {_LENS} select vec_id, round(p_sem, 6) p_sem_first_token, greedy_id, round(greedy_prob, 6) greedy_prob from lr")
def lens_target_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of a set of ids and the likeliest id of each logit vector; ids beyond the vector are left out."""
    return _lens(spark, sf_dir).select("vec_id", _r(F.col("p_sem_first_token"), "p_sem_first_token"), "greedy_id", _r(F.col("greedy_prob"), "greedy_prob"))


_TRO = """tro as (select distinct vec_id % 50 prompt_id, case when (vec_id % 50) % 3 = 0 then 'failure' else 'success' end outcome from embeddings)"""


def _trace_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("prompt_id")).distinct().withColumn("outcome", F.when(F.col("prompt_id") % 3 == 0, "failure").otherwise("success"))


@_query(f"""with {_TR}, {_LENS}, {_TRO} select "condition", outcome, layer, round(avg(p_sem), 6) p_sem_first_token, count(*) n from lr join tro on tro.prompt_id = lr.vec_id % 50 group by 1, 2, 3""")
def lens_by_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lens curves per condition, outcome and layer."""
    joined = _lens(spark, sf_dir).join(_trace_outcomes(spark, sf_dir), "prompt_id")
    return joined.groupBy("condition", "outcome", "layer").agg(_r(F.avg("p_sem_first_token"), "p_sem_first_token"), F.count(F.lit(1)).alias("n"))


@_query(f"""with {_DEC}, {_TRO} select outcome, layer, round(avg(p_attn - p_in), 6) attn_contrib, round(avg(p_out - p_attn), 6) ffn_contrib from dc join tro on tro.prompt_id = dc.vec_id % 50 where layer >= 3 group by 1, 2""")
def late_contributions_by_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What attention and feed-forward add in the last layers, per outcome."""
    d = _decomposed(spark, sf_dir).withColumn("prompt_id", F.col("vec_id") % 50).join(_trace_outcomes(spark, sf_dir), "prompt_id").where("layer >= 3")
    return d.groupBy("outcome", "layer").agg(_r(F.avg(F.col("p_attn") - F.col("p_in")), "attn_contrib"), _r(F.avg(F.col("p_out") - F.col("p_attn")), "ffn_contrib"))


@_query(f"""with {_PAT} select layer, round(avg(after - before), 6) delta_p, avg(after - before) >= 0 raises from pe where vec_id % 5 = 4 group by 1""")
def patch_effect_top_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patch effect per layer in the highest bin, and its sign."""
    return _patches(spark, sf_dir).where("vec_id % 5 = 4").groupBy("layer").agg(_r(F.avg(F.col("after") - F.col("before")), "delta_p"), (F.avg(F.col("after") - F.col("before")) >= 0).alias("raises"))


@_query(f"""with {_TR}, pr as (select b.prompt_id, b.layer, b.w own, a.w base from tr b join tr a on a.prompt_id = b.prompt_id and a.layer = b.layer where a.head = 0 and b.head = 1),
  x as (select *, unnest(['A', 'B', 'C', 'D']) patch_type from pr)
  select prompt_id, layer, patch_type, round(case when patch_type in ('A', 'B') then list_sum(own[1:63]) + base[64] when patch_type = 'C' then list_sum(base[1:2]) + list_sum(own[3:64]) else list_sum(own[1:3]) + base[11] + base[12] + list_sum(own[6:64]) end, 6) total from x""")
def patch_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each state after the four kinds of patch with the baseline's state of the same prompt and layer; the two heads stand for the conditions."""
    t = _tr(spark, sf_dir).select("prompt_id", "layer", F.when(F.col("head") == 0, "baseline").otherwise("negative").alias("condition"), F.col("w").alias("state"))
    pairs = pipelines.condition_pairs(t, ["prompt_id", "layer"])
    ints = lambda *v: F.array(*[F.lit(x) for x in v])
    done = pipelines.patched_states(pairs, ints(0, 1), arrays.aligned(ints(3, 4), ints(10, 11, 12)))
    return done.select("prompt_id", "layer", "patch_type", _r(arrays.total(F.col("patched")), "total"))


@_query(f"""with {_TR}, s as (select vec_id, list_transform(range(0, 8), lambda i: list_position(logits[i * 8 + 1:i * 8 + 8], list_max(logits[i * 8 + 1:i * 8 + 8])) - 1)[1:6] g from tr),
  c as (select vec_id, case when list_position(g, 3) > 0 then g[1:list_position(g, 3)] else g end g from s) select vec_id, len(g)::int n_ids, array_to_string(g, ',') ids from c""")
def greedy_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A greedy decode of up to six steps of eight logits each, 3 as the end mark."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("logits", i * 8 + 1, 8))
    ids = _tr(spark, sf_dir).select("vec_id", arrays.greedy_ids(steps, 3, 6).alias("g"))
    return ids.select("vec_id", F.size("g").alias("n_ids"), F.array_join("g", ",").alias("ids"))


@_query(f"""with {_TR} select vec_id, round(exp(list_sum(list_transform(h[1:6], lambda x: ln(exp(-abs(x)) + 1e-12)))), 6) p, round(exp(-list_sum(list_transform(h[1:6], lambda x: abs(x)))), 6) p_plain from tr""")
def sequence_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of a sequence from its tokens' log probabilities, with and without a floor."""
    logs = F.transform(F.slice("h", 1, 6), lambda x: -F.abs(x))
    return _tr(spark, sf_dir).select("vec_id", _r(arrays.sequence_probability(logs), "p"), _r(F.exp(arrays.total(logs)), "p_plain"))


# Suppression by outcome, and the published curve

@_query(f"""with {_P}, {_DET}, {_OUTCOME}, {_bootstrap_sql("select outcome, p.prompt_id id, p0 - p1 v from p join oc using (prompt_id) where p0 is not null and p1 is not null", "outcome")}
  select outcome, round(mean, 6) mean, round(ci_low, 6) ci_low, round(ci_high, 6) ci_high, n from me join ci using (outcome)""")
def suppression_by_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean suppression of successes and failures with its interval."""
    rows = _p(spark, sf_dir).where("p0 is not null and p1 is not null").select("prompt_id", (F.col("p0") - F.col("p1")).alias("v")).join(_outcomes(spark, sf_dir), "prompt_id")
    ci = stats.bootstrap_ci(rows, ["outcome"], "v", "prompt_id")
    return ci.select("outcome", *[_r(F.col(c), c) for c in ("mean", "ci_low", "ci_high")], "n")


@_query("select round(i / 100, 6) x, round(1 / (1 + exp(-(-2.3981 + 2.2709 * (i / 100)))), 6) p from range(0, 101) r(i)")
def published_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published logistic curve over the pressure grid."""
    x = F.col("id") / 100
    return spark.range(0, 101).select(_r(x, "x"), _r(stats.logistic_curve(x, *stats.PUBLISHED), "p"))


@_query(f"""with {_P}, m as (select p0_bin, avg(case when not isnan(violation_rate) then violation_rate end) v from behavior_metrics b join p using (prompt_id) where p0_bin is not null group by 1)
  select p0_bin, round(v, 6) violation_rate, (row_number() over (order by string_split(p0_bin, '-')[1]::double))::int place from m""")
def bins_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins with their mean violation rate and their place by lower bound."""
    b = table(spark, sf_dir, "behavior_metrics").select("prompt_id", pressure.number_or_null(F.col("violation_rate")).alias("v"))
    means = b.join(_p(spark, sf_dir).select("prompt_id", "p0_bin"), "prompt_id").where("p0_bin is not null").groupBy("p0_bin").agg(_r(F.avg("v"), "violation_rate"))
    return stats.placed(means, pressure.bin_lower(F.col("p0_bin")), "place")


# Candidate generation

_HASH = "('0x' || md5('{}|' || {})[1:8])::bigint"
_LEAK = r"""(regexp_matches(lower({q}), '(^|[^\pL\pN])' || regexp_escape(lower({t})) || '([^\pL\pN]|$)') or contains(lower(regexp_replace({q}, '[^A-Za-z]', '', 'g')), lower({t})))"""
_IDIOMS = r"""id as (select 'as ' || a.word || ' as any ' || b.word || '.' idiom, a.word meaning from lexicon a join lexicon b on b.word_rank = a.word_rank + 1)"""


@_query(f"""with {_IDIOMS}, d as (select *, row_number() over (order by {_HASH.format(42, 'idiom')}, idiom) r from id), q as (select *, trim(string_split(idiom, ' ')[-1], '.') target,
    case when {_HASH.format(43, 'idiom')} % 2 = 0 then 'I1' else 'I2' end style, array_to_string(string_split(idiom, ' ')[:-2], ' ') || ' ____.' blank from d where r <= 200),
  f as (select *, case when style = 'I1' then 'Complete the idiom with one word: "' || blank || '"' else 'Which word ends this: ' || blank end question from q)
  select question question_text, target target_word, style prompt_style_id, 'idiom:' || idiom source_trace from f where not {_LEAK.format(q='question', t='target')}""")
def idiom_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of two hundred sayings made of neighbours in the lexicon."""
    lex = table(spark, sf_dir, "lexicon")
    after = lex.select((F.col("word_rank") - 1).alias("word_rank"), F.col("word").alias("other"))
    made = lex.join(after, "word_rank").select(F.concat(F.lit("as "), "word", F.lit(" as any "), "other", F.lit(".")).alias("idiom"), F.col("word").alias("meaning"))
    templates = {"I1": generate.IDIOM_TEMPLATES["I1"], "I2": "Which word ends this: {idiom_with_blank}"}
    return generate.idioms(made, 200, templates).select("question_text", "target_word", "prompt_style_id", "source_trace")


_FACT_SQL = r"""w as (select distinct 'wikidata' source, string_split(source_trace, ':')[2] relation, string_split(source_trace, ':')[3] subject, trim(target_word) target from candidates where source_trace like 'wikidata:%' and target_word is not null),
  k as (select *, source || '|' || relation || '|' || subject || '|' || target id from w where relation in ('capital', 'currency', 'export')),
  r as (select *, row_number() over (partition by relation order by ('0x' || md5('42|' || id)[1:8])::bigint, id) r from k),
  c as (select source, relation, trim(regexp_replace(regexp_replace(subject, '[^A-Za-z ]', ' ', 'g'), ' +', ' ', 'g')) subject, target, r from r where r <= 100 // 3 + (list_position(['capital', 'currency', 'export'], relation) <= 100 % 3)::int),
  v as (select *, row_number() over (partition by relation order by r) turn from c where subject <> '' and regexp_full_match(trim(trim(target), '.,!?;:"''-'), '\pL{2,}')),
  q as (select *, case relation when 'capital' then 'Fill the blank with one word: The capital of ' || subject || ' is ____.' when 'currency' then 'Complete with one word: The currency of ' || subject || ' is ____.' else 'Fill the blank with one word: ' || subject || ' is ____.' end question,
    case relation when 'capital' then 'F' || ((turn - 1) % 2 + 1) when 'currency' then 'F3' else 'F1' end style from v)"""


@_query(f"with {_FACT_SQL} select question question_text, target target_word, style prompt_style_id, source || ':' || relation || ':' || subject source_trace from q where not {_LEAK.format(q='question', t='target')}")
def fact_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a hundred facts over three relations, read off the traces of mined facts."""
    c = table(spark, sf_dir, "candidates").where(F.col("source_trace").startswith("wikidata:") & F.col("target_word").isNotNull())
    part = F.split("source_trace", ":")
    rows = c.select(F.lit("wikidata").alias("source"), part[1].alias("relation"), part[2].alias("subject"), F.trim("target_word").alias("target")).distinct()
    return generate.facts(rows, 100, ("capital", "currency", "export")).select("question_text", "target_word", "prompt_style_id", "source_trace")


_EDGES = r"""e as (select distinct string_split(source_trace, ':')[2] relation, string_split(source_trace, ':')[3] subject, target_word target from candidates where source_trace like 'conceptnet:%' and target_word is not null),
  r as (select *, row_number() over (partition by relation order by ('0x' || md5('42|' || relation || '|' || subject || '|' || target)[1:8])::bigint, relation || '|' || subject || '|' || target) r from e where relation in ('UsedFor', 'MadeOf', 'HasProperty')),
  q as (select *, case relation when 'UsedFor' then 'Fill the blank (one word): You use a ' || subject || ' to ____.' when 'MadeOf' then 'Fill the blank (one word): A ' || subject || ' is made of ____.' else 'Fill the blank (one word): A typical ' || subject || ' is ____.' end question,
    case relation when 'UsedFor' then 'C1_UsedFor' when 'MadeOf' then 'C2_MadeOf' else 'C3_HasProperty' end style from r where r <= 30 and regexp_full_match(trim(trim(target), '.,!?;:"''-'), '\pL{2,}'))"""


@_query(f"with {_EDGES} select question question_text, target target_word, style prompt_style_id, 'conceptnet:' || relation || ':' || subject source_trace from q where not {_LEAK.format(q='question', t='target')}")
def common_sense_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of ninety edges over three relations."""
    c = table(spark, sf_dir, "candidates").where(F.col("source_trace").startswith("conceptnet:") & F.col("target_word").isNotNull())
    part = F.split("source_trace", ":")
    rows = c.select(part[1].alias("relation"), part[2].alias("subject"), F.col("target_word").alias("target")).distinct()
    return generate.common_sense(rows, 90).select("question_text", "target_word", "prompt_style_id", "source_trace")


_ANSWERED = r"""a as (select val_id, target_word target, trim(question_text) q, regexp_replace(trim(question_text), '[.!?]+$', '') s from validated where question_text is not null and regexp_full_match(target_word, '[a-z]+') and trim(question_text) <> '')"""


def _model_answers(spark: SparkSession, sf_dir: str, field: str) -> DataFrame:
    v = table(spark, sf_dir, "validated").where(F.col("question_text").isNotNull() & F.col("target_word").rlike("^[a-z]+$") & (F.trim("question_text") != ""))
    listed = F.array(F.to_json(F.struct(F.col("question_text").alias(field), F.lit("dream").alias("style"))), F.to_json(F.struct(F.lit("").alias(field))))
    body = F.concat(F.lit('Sure:\n```json\n{"prompts": ['), F.array_join(listed, ", "), F.lit(', "a plain tale of rain!", 7]}\n```'))
    return v.select(F.col("target_word").alias("target"), F.col("val_id").alias("idx"), body.alias("answer"))


@_query(f"""with {_ANSWERED}, p as (select val_id, target, q, s, 0 place from a union all select val_id, target, 'a plain tale of rain!', 'a plain tale of rain', 2 from a)
  select target target_word, place::varchar place, count(*) n, min('Fill the blank with one word: ' || s || ' ____.') first_question from p where not {_LEAK.format(q='q', t='target')} group by 1, 2""")
def creative_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of microstories in model answers, of which some have no text and some are no record: per target and place their number and the first question."""
    c = generate.creative(_model_answers(spark, sf_dir, "microstory"))
    return c.groupBy("target_word", F.element_at(F.split("prompt_style_id", "_"), -1).alias("place")).agg(F.count(F.lit(1)).alias("n"), F.min("question_text").alias("first_question"))


@_query(f"""with {_ANSWERED}, p as (select val_id, target, q, 0 place, 'dream' style from a union all select val_id, target, 'a plain tale of rain!', 2, 'surreal' from a),
  l as (select *, row_number() over (order by target, val_id, place) r from p where not {_LEAK.format(q='q', t='target')})
  select 'Fill the blank with one word: ' || q || case when regexp_matches(q, '[.!?]$') then '' else '.' end || ' ____.' question_text, target target_word, 'ood_' || style || '_' || val_id || '_' || place prompt_style_id from l where r <= 300""")
def ood_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three hundred candidates of strange contexts in model answers."""
    return generate.out_of_distribution(_model_answers(spark, sf_dir, "context"), 300).select("question_text", "target_word", "prompt_style_id")


# Data set

@_query(f"""with {_VAL}, {_RANKED}, {_ONCE}, {_TAU}, ct as (select category, coalesce(max(case when reached then tau end), min(tau)) tau from ladder group by 1),
  c as (select coalesce(category, '') k, count(*) n from once group by 1), h as (select category, bin_id, least(count(*), 100) n from once group by 1, 2), g as (select category, b::int bin_id from (select distinct category from once), range(0, 5) r(b))
  select 'counts_by_category' section, k "key", n::double "value" from c union all select 'tau_per_category', category, round(tau, 6) from ct union all select 'gating_failures', k, 1 from c where n < 700
  union all select 'bin_shortfalls', category || '|' || bin_id, 100 - coalesce(n, 0) from g left join h using (category, bin_id) union all select 'total_count', '', sum(n)::double from c""")
def dataset_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the data set's metadata say of counts, thresholds, shortfalls and categories that are too small, a row per entry."""
    once = _once(spark, sf_dir).withColumn("p0_bin", pressure.bin_label(F.col("bin_id")))
    taus = select.chosen_tau(select.tau_ladder(once, 100, 500))
    m = pipelines.metadata(once, taus, select.bin_shortfalls(select.top_per_bin(once, 100), 100, once), 700)
    entries = lambda section, c: m.select(F.lit(section).alias("section"), F.explode(c)).select("section", "key", F.col("value").cast("double").alias("value"))
    failing = m.select(F.lit("gating_failures").alias("section"), F.explode("gating_failures").alias("key"), F.lit(1.0).alias("value"))
    total = m.select(F.lit("total_count").alias("section"), F.lit("").alias("key"), F.col("total_count").cast("double").alias("value"))
    return entries("counts_by_category", "counts_by_category").unionByName(entries("tau_per_category", "tau_per_category")).unionByName(entries("bin_shortfalls", "bin_shortfalls")).unionByName(failing).unionByName(total)


@_query(f"with {_P} select prompt_id from p where p1 is null or p1 < 0.001")
def prompts_without_p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts that lack a P1, of which those below a thousandth are taken away first."""
    p = _p(spark, sf_dir)
    return pipelines.without_p1(p.select("prompt_id"), p.where("p1 >= 0.001").select("prompt_id", "p1"))


@_query(f"""with {_P}, {_DET}, {_OUTCOME}, l as (select prompt_id, completion_text from completions_greedy where run_condition = 'negative' and prompt_id is not null qualify row_number() over (partition by prompt_id order by row_id desc) = 1)
  select p.prompt_id, outcome, p.target_word, completion_text from p join oc using (prompt_id) join l using (prompt_id) where p0 >= 0.8""")
def patch_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High-pressure prompts with outcome and last negative answer."""
    p = _p(spark, sf_dir)
    c = table(spark, sf_dir, "completions_greedy").where("prompt_id is not null").select("row_id", "prompt_id", "completion_text", F.col("run_condition").alias("condition"), "sample_id")
    return pipelines.patch_inputs(p.where("p0 >= 0.8"), p.select("prompt_id", "target_word"), _outcomes(spark, sf_dir), c).select("prompt_id", "outcome", "target_word", "completion_text")


@_query(f"""with {_DET}, {_OUTCOME}, m as (select min(n) least from (select count(*) n from oc group by outcome)), s as (select case when outcome = 'failure' then least(count(*), (select least from m)) else count(*) end n, outcome from oc group by outcome)
  select sum(n)::bigint n, coalesce(sum(n) filter (where outcome = 'failure'), 0)::bigint n_failures from s""")
def subset_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the balanced subset and its failures."""
    return select.subset_size(select.balanced_subset(_outcomes(spark, sf_dir), "outcome", "prompt_id"))


@_query(f"select target_word_normalized word, array_to_string(list_sort(list_distinct(list({_CAT}))), ',') categories from candidates where target_word_normalized is not null group by 1")
def word_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories in which each word is used."""
    c = table(spark, sf_dir, "candidates").where("target_word_normalized is not null")
    return select.word_categories(c.select(F.col("target_word_normalized").alias("word"), name_key(c["category"]).alias("category"))).select("word", F.array_join("categories", ",").alias("categories"))


# Work planning

@_query(f"""with {_P}, {_BOTH} select prompt_id, "condition", length(prompt)::int input_length, (row_number() over (partition by length(prompt) order by prompt_id, "condition") - 1) // 8 batch from bp""")
def tasks_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of eight prompts of the same length."""
    rows = _both(spark, sf_dir).select("prompt_id", "condition", F.length("prompt").alias("input_length"))
    return select.grouped_tasks(rows, "input_length", [F.col("prompt_id"), F.col("condition")], 8)


@_query("""with h as (select prompt_id, count(distinct row_id) % 16 have from completions_greedy where prompt_id is not null group by 1) select prompt_id, (16 - have)::int missing, (row_number() over (partition by 16 - have order by prompt_id) - 1) // 32 batch from h""")
def tasks_by_missing_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of thirty-two prompts that lack the same number of samples."""
    have = table(spark, sf_dir, "completions_greedy").where("prompt_id is not null").groupBy("prompt_id").agg((F.countDistinct("row_id") % 16).alias("have"))
    return select.grouped_tasks(have.select("prompt_id", (16 - F.col("have")).cast("int").alias("missing")), "missing", [F.col("prompt_id")], 32)


@_query(f"""with {_P}, t as (select prompt_id, (row_number() over (order by prompt_id) - 1) i from p) select t.prompt_id, (i * 4 + j)::bigint flat_index, j::int sample_no from t, range(0, 4) s(j)""")
def flat_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat task numbers of four samples per prompt."""
    n = select.numbered(_p(spark, sf_dir).select("prompt_id"), [], [F.col("prompt_id")], "n")
    return n.select("prompt_id", F.posexplode(F.array_repeat(F.lit(0), 4)).alias("sample_no", "_z"), F.col("n")).select("prompt_id", ((F.col("n") - 1) * 4 + F.col("sample_no")).alias("flat_index"), "sample_no")


# Smaller readings

@_query(r"""select cand_id, string_split(prompt_style_id, '_')[1] prefix, coalesce(nullif(prompt_style_id, ''), 'none') stored, 'idiom:' || coalesce(target_word, '') trace, strftime(mined_at, '%Y%m%d_%H%M') stamp, (ceil(cand_id / 8) * 8)::bigint rounded,
  regexp_replace(question_text, '[\s\x{a0}]+', '', 'g') = regexp_replace(' ' || question_text || ' ', '[\s\x{a0}]+', '', 'g') same from candidates where question_text is not null and prompt_style_id is not null""")
def name_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes, stored names, traces, stamps and round numbers of each candidate."""
    c = table(spark, sf_dir, "candidates").where("question_text is not null and prompt_style_id is not null")
    style, q = F.col("prompt_style_id"), F.col("question_text")
    return c.select("cand_id", text.relation_prefix(style).alias("prefix"), text.stored_or(style, F.lit("none")).alias("stored"), text.source_trace(F.lit("idiom"), F.coalesce("target_word", F.lit(""))).alias("trace"), text.run_stamp(F.col("mined_at")).alias("stamp"), text.round_up_multiple(F.col("cand_id"), 8).alias("rounded"), text.same_text(q, F.concat(F.lit(" "), q, F.lit(" "))).alias("same"))


@_query(rf"""with c as (select cand_id, {_CAT} cat, raw_data, trim(coalesce(question_text, '')) q from candidates)
  select cand_id, coalesce(nullif(case when cat = 'creative' then raw_data->>'$.place' when cat = 'ood' then raw_data->>'$.target' end, ''), case when lower(q) like 'fill the blank with one word:%' then trim(regexp_replace(q, '^[^:]*:', '')) else q end) context from c""")
def prompt_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each candidate is about; places and targets stand for stories and contexts."""
    c = table(spark, sf_dir, "candidates")
    raw = F.to_json(F.struct(F.get_json_object("raw_data", "$.place").alias("microstory"), F.get_json_object("raw_data", "$.target").alias("context")))
    return c.select("cand_id", text.prompt_context(name_key(c["category"]), raw, c["question_text"]).alias("context"))


@_query("""with w as (select distinct target_word w from prompts where regexp_full_match(target_word, '[A-Za-z]+')),
  v as (select w, list_distinct([w, lower(w), upper(w[1]) || lower(w[2:]), upper(w)]) cs from w), f as (select w, unnest(cs) c from v),
  s as (select w, unnest([c, ' ' || c, c || ' ', ' ' || c || ' ']) f from f) , x as (select w, unnest([f, rtrim(f) || '.']) x from s)
  select w target_word, count(distinct x) n_variants, max(length(x)) longest from x group by w""")
def surface_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and longest of the surface variants per target."""
    w = table(spark, sf_dir, "prompts").where(F.col("target_word").rlike("^[A-Za-z]+$")).select("target_word").distinct()
    v = w.select("target_word", F.explode(text.surface_set(F.col("target_word"))).alias("x"))
    return v.groupBy("target_word").agg(F.count(F.lit(1)).alias("n_variants"), F.max(F.length("x")).cast("bigint").alias("longest"))


@_query("""select val_id, validation is not null and validation.ambiguity_score is not null and validation.comments is not null fits,
  case when validation."is_X_best" is null then 'no' else validation."is_X_best"::varchar end best, coalesce(validation.naturalness_score::varchar, 'none') naturalness from validated""")
def judge_schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each judge answer has the fields asked for, of their types, and what is left when it is merged with defaults."""
    answer = F.to_json("validation")
    merged = text.merged_json(answer, F.create_map(F.lit("is_X_best"), F.lit("no"), F.lit("naturalness_score"), F.lit("none")))
    v = table(spark, sf_dir, "validated").select("val_id", text.json_fits(answer, {"ambiguity_score": "int", "comments": "string"}).alias("fits"), merged.alias("m"))
    return v.select("val_id", "fits", F.element_at("m", "is_X_best").alias("best"), F.element_at("m", "naturalness_score").alias("naturalness"))


@_query("""with e as (select *, string_split(source_trace, ':')[2] rel, 'C' || (val_id % 10 + 1) || '_x' style, val_id % 3 = 0 bare from validated where source_trace like 'conceptnet:%'),
  r as (select case when not bare then rel when style like 'C1\\_%' escape '\\' then 'UsedFor' when style like 'C2\\_%' escape '\\' then 'MadeOf' when style like 'C3\\_%' escape '\\' then 'HasProperty' when style like 'C4\\_%' escape '\\' then 'HasPart' when style like 'C5\\_%' escape '\\' then 'AtLocation'
    when style like 'C6\\_%' escape '\\' then 'CapableOf' when style like 'C7\\_%' escape '\\' then 'UsedBy' when style like 'C8\\_%' escape '\\' then 'Requires' when style like 'C9\\_%' escape '\\' then 'Contains' else 'WornOn' end relation from e)
  select relation, count(*) n from r group by 1""")
def relations_by_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of candidates, read off their style where they aren't named."""
    v = table(spark, sf_dir, "validated").where(F.col("source_trace").startswith("conceptnet:"))
    named = F.when(F.col("val_id") % 3 != 0, F.split("source_trace", ":")[1])
    style = F.concat(F.lit("C"), F.col("val_id") % 10 + 1, F.lit("_x"))
    return v.groupBy(text.relation_of(named, style).alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@_query("""select event_id, round(value / greatest(event_id % 7, 1e-6), 6) rate, case when value / greatest(event_id % 7, 1e-6) > 0 then round((1000 - value) / (value / greatest(event_id % 7, 1e-6)), 6) else 0 end eta, round(100 * value / 1000, 6) percent from events where value is not null""")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate, time left and share of a job, the events' values as work done."""
    e = table(spark, sf_dir, "events").where("value is not null")
    p = text.progress(F.col("value"), F.lit(1000.0), (F.col("event_id") % 7).cast("double"))
    return e.select("event_id", p.alias("p")).select("event_id", *[_r(F.col(f"p.{c}"), c) for c in ("rate", "eta", "percent")])


@_query(r"""with s as (select prompt_id, case when prompt_id[-1] in ('a', 'b', 'c') then 'You write JSON.  ' else 'You write words. ' end system, case when prompt_id[-2] in ('1', '2') then '{"x": 1} ' || question_text else question_text end usr from prompts where question_text is not null)
  select prompt_id, case when contains(lower(system || usr), 'json') and regexp_matches(system || chr(10) || usr, '\{\s*"') then system else rtrim(system) || chr(10) || chr(10) ||
    array_to_string(list_filter([case when not contains(lower(system || chr(10) || usr), 'json') then 'Return a json object only.' end, case when not regexp_matches(system || chr(10) || usr, '\{\s*"') then 'Example JSON:' || chr(10) || '{"word": "value", "sure": true}' end], lambda x: x is not null), chr(10)) end system from s""")
def json_mode_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System prompts with what a JSON answer needs."""
    p = table(spark, sf_dir, "prompts").where("question_text is not null")
    system = F.when(F.substring("prompt_id", -1, 1).isin("a", "b", "c"), "You write JSON.  ").otherwise("You write words. ")
    user = F.when(F.substring("prompt_id", -2, 1).isin("1", "2"), F.concat(F.lit('{"x": 1} '), "question_text")).otherwise(F.col("question_text"))
    return p.select("prompt_id", text.json_mode_system(system, user, {"word": "string", "sure": "boolean"}).alias("system"))


_OF_RELATION = "coalesce(" + ", ".join(f"case when rel = '{r}' and regexp_matches(q, '{p}') then trim(regexp_replace(regexp_extract(q, '{p}', 1), ' +', ' ', 'g')) end" for r, p in text.SUBJECT_PATTERNS) + ")"


@_query(f"select cand_id, {_OF_RELATION} subject from (select cand_id, lower(question_text) q, string_split(source_trace, ':')[2] rel from candidates where question_text is not null and source_trace like 'conceptnet:%')")
def subject_of_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject of each question by the pattern of its own relation."""
    c = table(spark, sf_dir, "candidates").where(F.col("question_text").isNotNull() & F.col("source_trace").startswith("conceptnet:"))
    return c.select("cand_id", text.subject_of(F.col("question_text"), F.split("source_trace", ":")[1]).alias("subject"))
