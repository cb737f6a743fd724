"""Queries of the experiment's operators over the project's tables, and their SQL.

Views: ``p`` holds each prompt once (spellings of a category and bin read as
one), ``det`` one detection per completion, ``val`` the validated rows. Traces
and logits are the embeddings: squares stand for attention weights, ten times
the value for logits, the label for the target id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilnspark.functions import arrays, pressure, text
from kilnspark.functions.names import bin_key, name_key
from kilnspark.operators import select, stats
from kilnspark.session import cut_lineage, table
from kilnspark.sinks import writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _r(c, name: str):
    return F.round(c, DIGITS).alias(name)


# Views, in Spark and in SQL

_CAT = r"nullif(regexp_replace(regexp_replace(lower(category), '[\s\x{a0}_\-]+', '_', 'g'), '^_+|_+$', '', 'g'), '')"
_BIN = r"nullif(array_to_string(list_transform(regexp_extract_all(p0_bin, '\d+\.\d+'), lambda x: format('{:.1f}', x::double)), '-'), '')"
_P = f"""p as (select prompt_id, min({_CAT}) category, min({_BIN}) p0_bin, min(p0) p0, min(p1) p1, min(v_score) v_score, min(s_score) s_score,
  min(question_text) question_text, min(target_word) target_word, min(target_word_normalized) target_word_normalized
  from prompts where prompt_id is not null group by prompt_id)"""
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_HALF = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
_SPACES = "\u00a0\u2002\u2003\u2009\u202f\u3000"


def _nfkc_sql(c: str) -> str:
    """What NFKC does to the characters of these tables."""
    s = f"translate({c}, '{_FULL}{_SPACES}', '{_HALF}{' ' * len(_SPACES)}')"
    for a, b in (("…", "..."), ("‑", "‐"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        s = f"replace({s}, '{a}', '{b}')"
    return f"nfc_normalize({s})"


def _normal_sql(c: str) -> str:
    marks = text.PUNCTUATION.replace("'", "''")
    return f"trim(regexp_replace(translate(lower({_nfkc_sql(c)}), '{marks}', '{' ' * len(text.PUNCTUATION)}'), '\\s+', ' ', 'g'))"


def _whole_sql(t: str, x: str) -> str:
    return rf"coalesce({t} <> '' and regexp_matches(lower({x}), '(^|[^\pL\pN])' || regexp_escape(lower({t})) || '([^\pL\pN]|$)'), false)"


_DET = f"""det as (select row_id, prompt_id, run_condition "condition", {_whole_sql("target_word", "completion_text")} word_present,
  coalesce(len(list_filter(string_split({_normal_sql("completion_text")}, ' '), lambda w: w <> '')) = 1, false) format_adherence
  from completions_greedy where completion_text is not null and target_word is not null)"""
_VAL = f"""val as (select val_id, prompt_id, {_CAT} category, question_text, target_word, target_word_normalized, source_trace, v_score, p_sem,
  case when not isnan(s_score) then s_score end s_score, validation from validated)"""


def _p(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "prompts").where("prompt_id is not null")
    named = t.withColumns({"category": name_key(t["category"]), "p0_bin": bin_key(t["p0_bin"])})
    columns = ("category", "p0_bin", "p0", "p1", "v_score", "s_score", "question_text", "target_word", "target_word_normalized")
    return named.groupBy("prompt_id").agg(*[F.min(c).alias(c) for c in columns])


def _det(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "completions_greedy").where("completion_text is not null and target_word is not null")
    return t.select(
        "row_id",
        "prompt_id",
        F.col("run_condition").alias("condition"),
        text.word_present(F.col("target_word"), F.col("completion_text")).alias("word_present"),
        text.word_count_is_one(text.normalize_text(F.col("completion_text"))).alias("format_adherence"),
    )


def _val(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "validated")
    columns = ("val_id", "prompt_id", "question_text", "target_word", "target_word_normalized", "source_trace", "v_score", "p_sem", "validation")
    return t.select(*columns, name_key(t["category"]).alias("category"), pressure.number_or_null(t["s_score"]).alias("s_score"))


# Behaviour


@_query(f"""with {_DET}, {_P} select d.prompt_id, coalesce(any_value(p.category), '') category, round(avg(word_present::int), 6) violation_rate,
  round(avg(format_adherence::int), 6) format_adherence_rate, round(avg((not word_present and format_adherence)::int), 6) clean_success_rate
  from det d left join p using (prompt_id) where "condition" = 'negative' group by d.prompt_id""")
def behavior_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per prompt the shares of violating, adherent and clean negative answers."""
    d = _det(spark, sf_dir).where("condition = 'negative'")
    rate = lambda c: F.avg(c.cast("double"))
    rates = d.groupBy("prompt_id").agg(
        _r(rate(F.col("word_present")), "violation_rate"),
        _r(rate(F.col("format_adherence")), "format_adherence_rate"),
        _r(rate(~F.col("word_present") & F.col("format_adherence")), "clean_success_rate"),
    )
    return rates.join(_p(spark, sf_dir).select("prompt_id", "category"), "prompt_id", "left").withColumn("category", F.coalesce("category", F.lit("")))


@_query(f"""with {_P} select p0_bin, round(avg(case when not isnan(violation_rate) then violation_rate end), 6) violation_rate,
  count(case when not isnan(violation_rate) then violation_rate end) n_prompts from behavior_metrics b join p using (prompt_id) where p0_bin is not null group by p0_bin""")
def violation_rate_by_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean violation rate and number of rates per pressure bin."""
    b = table(spark, sf_dir, "behavior_metrics").select("prompt_id", pressure.number_or_null(F.col("violation_rate")).alias("v"))
    joined = b.join(_p(spark, sf_dir).select("prompt_id", "p0_bin"), "prompt_id").where("p0_bin is not null")
    return joined.groupBy("p0_bin").agg(_r(F.avg("v"), "violation_rate"), F.count("v").alias("n_prompts"))


@_query(f"""with {_DET}, {_P} select coalesce(p0_bin, '') p0_bin, coalesce(category, '') category, count(*) n_rows, round(avg(word_present::int), 6) violation_rate,
  round(avg(format_adherence::int), 6) adherence_rate from det join p using (prompt_id) where "condition" = 'negative' group by 1, 2""")
def behavior_by_bin_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates per bin and category."""
    d = _det(spark, sf_dir).where("condition = 'negative'").join(_p(spark, sf_dir).select("prompt_id", "p0_bin", "category"), "prompt_id")
    keys = [F.coalesce(c, F.lit("")).alias(c) for c in ("p0_bin", "category")]
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), _r(F.avg(F.col("word_present").cast("double")), "violation_rate"), _r(F.avg(F.col("format_adherence").cast("double")), "adherence_rate"))


@_query(f"""with {_DET} select "condition", count(*) n_rows, sum(word_present::int)::bigint n_present, grouping("condition") is_total from det group by rollup ("condition")""")
def condition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run counters per condition with their total."""
    return _det(spark, sf_dir).rollup("condition").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("word_present").cast("int")).alias("n_present"), F.grouping("condition").cast("int").alias("is_total"))


# Pressure


@_query(f"""with {_P} select prompt_id, round(p0 - p1, 6) delta, round((p0 - p1) / greatest(p0, 1e-9), 6) relative, round(ln(greatest(p0, 1e-12)) - ln(greatest(p1, 1e-12)), 6) log
  from p""")
def suppression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the rule suppresses the target, per prompt."""
    delta, relative, log = pressure.suppression(F.col("p0"), F.col("p1"))
    return _p(spark, sf_dir).select("prompt_id", _r(delta, "delta"), _r(relative, "relative"), _r(log, "log"))


@_query(f"""with {_P}, s as (select p0_bin, p0 - p1 delta, (p0 - p1) / greatest(p0, 1e-9) relative, ln(greatest(p0, 1e-12)) - ln(greatest(p1, 1e-12)) log from p where p0_bin is not null),
  l as (select p0_bin, 'suppression_' || n metric_name, v from s unpivot (v for n in (delta, relative, log)))
  select p0_bin, metric_name, round(avg(v), 6) mean, count(v) n from l group by 1, 2""")
def suppression_by_bin_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three measures per bin, one row each."""
    delta, relative, log = pressure.suppression(F.col("p0"), F.col("p1"))
    wide = _p(spark, sf_dir).where("p0_bin is not null").select("prompt_id", "p0_bin", delta.alias("delta"), relative.alias("relative"), log.alias("log"))
    long = wide.unpivot(["prompt_id", "p0_bin"], ["delta", "relative", "log"], "m", "v")
    return long.groupBy("p0_bin", F.concat(F.lit("suppression_"), "m").alias("metric_name")).agg(_r(F.avg("v"), "mean"), F.count("v").alias("n"))


@_query(f"""with {_P}, b as (select prompt_id, p0, least(floor(greatest(0, least(1, p0)) * 5)::int, 4) bin_id from p)
  select prompt_id, bin_id, round(bin_id / 5, 6) bin_lower, round((bin_id + 1) / 5, 6) bin_upper, format('{{:.1f}}-{{:.1f}}', bin_id / 5, (bin_id + 1) / 5) p0_bin from b""")
def pressure_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bin number, bounds and label of each prompt's pressure."""
    b = _p(spark, sf_dir).select("prompt_id", pressure.bin_id(F.col("p0")).alias("bin_id"))
    return b.select("prompt_id", "bin_id", _r(F.col("bin_id") / 5, "bin_lower"), _r((F.col("bin_id") + 1) / 5, "bin_upper"), pressure.bin_label(F.col("bin_id")).alias("p0_bin"))


@_query(f"""with {_P} select coalesce(category, '') category, coalesce(p0_bin, '') p0_bin, count(*) n, count(*) < 100 is_short from p group by 1, 2""")
def bin_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts per category and bin, and whether they are fewer than a bin's target."""
    keys = [F.coalesce(c, F.lit("")).alias(c) for c in ("category", "p0_bin")]
    return _p(spark, sf_dir).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("is_short", F.col("n") < 100)


@_query(f"""with {_P}, t as (select greatest(0.7, least(0.95, quantile_cont(p0, 0.75))) t from p) select prompt_id, round(p0, 6) p0, round(t, 6) threshold from p, t where p0 >= t""")
def high_pressure_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts above the upper quartile, held within bounds."""
    p = _p(spark, sf_dir).select("prompt_id", "p0")
    t = p.agg(F.greatest(F.lit(0.7), F.least(F.lit(0.95), F.percentile("p0", F.lit(0.75)))).alias("t"))
    return p.where(F.col("p0") >= t.scalar()).select("prompt_id", _r(F.col("p0"), "p0"), F.round(t.scalar(), DIGITS).alias("threshold"))


@_query(r"""select distinct p0_bin label, round(coalesce(try_cast(nullif(regexp_extract(p0_bin, '(?:^|[\[=])\s*(\d+(?:\.\d+)?)', 1), '') as double), 'inf'::double), 6) lower,
  round(coalesce((try_cast(nullif(regexp_extract(p0_bin, '(\d+(?:\.\d+)?)\s*(?:,|-|–|to)\s*(\d+(?:\.\d+)?)', 1), '') as double)
  + try_cast(nullif(regexp_extract(p0_bin, '(\d+(?:\.\d+)?)\s*(?:,|-|–|to)\s*(\d+(?:\.\d+)?)', 2), '') as double)) / 2, 0.5), 6) center from prompts where p0_bin is not null""")
def bin_label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower bound and centre of every notation of a bin."""
    labels = table(spark, sf_dir, "prompts").where("p0_bin is not null").select(F.col("p0_bin").alias("label")).distinct()
    return labels.select("label", _r(pressure.bin_lower(F.col("label")), "lower"), _r(pressure.bin_center(F.col("label")), "center"))


@_query(f"""with {_P} select distinct p.prompt_id from p where exists (select 1 from completions_greedy c where c.prompt_id = p.prompt_id and run_condition = 'negative')""")
def outcome_known_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with a negative answer."""
    done = table(spark, sf_dir, "completions_greedy").where("run_condition = 'negative'").select("prompt_id")
    return _p(spark, sf_dir).select("prompt_id").join(done, "prompt_id", "left_semi")


_GRID = f"""grid as (select prompt_id, c "condition", s sample_id from p, unnest(['baseline', 'negative']) u(c), range(0, 16) r(s))"""


@_query(f"""with {_P}, {_GRID} select "condition", sample_id, count(*) n_tasks from grid group by 1, 2""")
def condition_sample_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks per condition and sample of the full grid."""
    grid = _p(spark, sf_dir).select("prompt_id", F.explode(F.array(F.lit("baseline"), F.lit("negative"))).alias("condition"))
    grid = grid.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(15)).cast("array<bigint>")))
    return grid.groupBy("condition", "sample_id").agg(F.count(F.lit(1)).alias("n_tasks"))


@_query(f"""with {_P}, t as (select prompt_id, c "condition" from p, unnest(['baseline', 'negative']) u(c))
  select * from t where not exists (select 1 from completions_greedy c where c.prompt_id = t.prompt_id and c.run_condition = t."condition" and completion_text is not null)""")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that no completion answers yet."""
    from kilnspark.streaming.resume import missing

    tasks = _p(spark, sf_dir).select("prompt_id", F.explode(F.array(F.lit("baseline"), F.lit("negative"))).alias("condition"))
    done = table(spark, sf_dir, "completions_greedy").where("completion_text is not null").select("prompt_id", F.col("run_condition").alias("condition"))
    return missing(tasks, done, ["prompt_id", "condition"])


@_query(f"""with {_DET}, {_P}, b as (select distinct p0_bin from p where p0_bin is not null), g as (select p0_bin, c "condition" from b, unnest(['baseline', 'negative', 'other']) u(c)),
  a as (select p0_bin, "condition", avg(word_present::int) m, count(*) n from det join p using (prompt_id) where p0_bin is not null group by 1, 2)
  select 'p0_bin=' || g.p0_bin || '|condition=' || g."condition" group_key, round(coalesce(m, 'nan'::double), 6) mean, coalesce(n, 0) n from g left join a using (p0_bin, "condition")""")
def dense_group_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means on the whole grid of bins and conditions; groups without rows are NaN and 0."""
    p = _p(spark, sf_dir).where("p0_bin is not null").select("prompt_id", "p0_bin")
    grid = p.select("p0_bin").distinct().withColumn("condition", F.explode(F.array(*[F.lit(c) for c in ("baseline", "negative", "other")])))
    found = _det(spark, sf_dir).join(p, "prompt_id").groupBy("p0_bin", "condition").agg(F.avg(F.col("word_present").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    key = F.concat(F.lit("p0_bin="), "p0_bin", F.lit("|condition="), "condition").alias("group_key")
    return grid.join(found, ["p0_bin", "condition"], "left").select(key, _r(F.coalesce("m", F.lit(float("nan"))), "mean"), F.coalesce("n", F.lit(0)).alias("n"))


# Text


@_query(f"select val_id, {_normal_sql('question_text')} normal from validated where question_text is not null")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form of every question."""
    return table(spark, sf_dir, "validated").where("question_text is not null").select("val_id", text.normalize_text(F.col("question_text")).alias("normal"))


@_query(f"""with {_DET} select row_id, word_present from det""")
def whole_word_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each completion holds its target as a whole word."""
    return _det(spark, sf_dir).select("row_id", "word_present")


@_query(f"""select row_id, list_contains(string_split({_normal_sql('completion_text')}, ' '), {_normal_sql('target_word')}) found from completions_greedy
  where completion_text is not null and target_word is not null""")
def word_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership of the normalised target among the normalised words."""
    t = table(spark, sf_dir, "completions_greedy").where("completion_text is not null and target_word is not null")
    normal = t.select("row_id", text.normalize_text(F.col("completion_text")).alias("x"), text.normalize_text(F.col("target_word")).alias("w"))
    return normal.select("row_id", text.word_in_words(F.col("w"), F.col("x")).alias("found"))


@_query(f"""with {_DET} select row_id, format_adherence from det""")
def format_adherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each completion is exactly one word."""
    return _det(spark, sf_dir).select("row_id", "format_adherence")


@_query(r"""with t as (select row_id, lower(completion_text) x, lower(target_word) w from completions_greedy where completion_text is not null and target_word <> ''),
  f as (select row_id, x, w, unnest(list_filter(range(1, greatest(length(x) - length(w) + 2, 1)), lambda i: substr(x, i, length(w)) = w)) pos from t where contains(x, w))
  select row_id, (pos - 1)::int span_start, (pos - 1 + length(w))::int span_end from f
  where (pos = 1 or not regexp_matches(substr(x, pos - 1, 1), '[\pL\pN]')) and not regexp_matches(substr(x, pos + length(w), 1), '[\pL\pN]')""")
def word_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character spans of the target in each completion, a row each."""
    t = table(spark, sf_dir, "completions_greedy").where("completion_text is not null and target_word is not null")
    t = t.where(text.word_present(F.col("target_word"), F.col("completion_text")))
    return t.select("row_id", F.explode(text.word_spans(F.col("target_word"), F.col("completion_text"))).alias("s")).select("row_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


@_query(r"""with w as (select row_id, list_filter(string_split(completion_text, ' '), lambda x: x <> '') t from completions_greedy where completion_text is not null)
  select row_id, len(t) n_tokens, coalesce(list_sum(list_transform(t, lambda x: len(x))), 0)::bigint n_chars from w""")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of blank-separated tokens and the end of the last one's running span."""
    t = table(spark, sf_dir, "completions_greedy").where("completion_text is not null")
    tokens = t.select("row_id", F.filter(F.split("completion_text", " "), lambda x: x != "").alias("t")).select("row_id", arrays.running_spans(F.col("t")).alias("s"))
    return tokens.select("row_id", F.size("s").alias("n_tokens"), F.coalesce(F.try_element_at("s", F.lit(-1))["end"], F.lit(0)).cast("bigint").alias("n_chars"))


_REASONS = rf"""reasons as (select cand_id, case when not regexp_full_match(coalesce(target_word, ''), '\pL+') then 'nonalpha_target'
  when {_whole_sql("target_word", "coalesce(question_text, '')")} then 'whole_word_leak'
  when contains(lower(regexp_replace(coalesce(question_text, ''), '[^A-Za-z]', '', 'g')), lower(target_word)) then 'stripped_leak' end reason from candidates)"""


@_query(f"with {_REASONS} select coalesce(reason, 'kept') reason, count(*) n from reasons group by 1")
def leak_filter_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by the first reason against them."""
    c = select.leak_reasons(table(spark, sf_dir, "candidates").select("cand_id", "question_text", "target_word"))
    return c.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@_query(r"select cand_id, len(list_filter(regexp_split_to_array(question_text, '[.!?]+'), lambda x: trim(x) <> '')) n_sentences from candidates where question_text is not null")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts between final marks per question."""
    return table(spark, sf_dir, "candidates").where("question_text is not null").select("cand_id", text.sentence_count(F.col("question_text")).alias("n_sentences"))


@_query(f"""select cand_id, {_CAT} || '_' || target_word_normalized || '_' || substr(sha256(question_text || '||' || target_word || '||' || {_CAT}), 1, 8) prompt_id
  from candidates where question_text is not null and target_word is not null and target_word_normalized is not null and {_CAT} is not null""")
def prompt_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable ids of all complete candidates."""
    c = table(spark, sf_dir, "candidates")
    cat = name_key(c["category"])
    whole = c.where(c["question_text"].isNotNull() & c["target_word"].isNotNull() & c["target_word_normalized"].isNotNull() & cat.isNotNull())
    return whole.select("cand_id", text.prompt_id(cat, F.col("target_word_normalized"), F.col("question_text"), F.col("target_word")).alias("prompt_id"))


@_query(f"""with {_P} select prompt_id, c "condition", case when c = 'baseline' then 'Answer with exactly one English word.' || chr(10) || 'Question: ' || question_text || chr(10) || 'Answer:'
  else 'Answer with exactly one English word.' || chr(10) || 'Do not use the word "' || target_word || '" anywhere in your answer.' || chr(10) || 'Question: ' || question_text || chr(10) || 'Answer:' end prompt
  from p, unnest(['baseline', 'negative']) u(c)""")
def build_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both prompts of every question."""
    p = _p(spark, sf_dir).select("prompt_id", "question_text", "target_word", F.explode(F.array(F.lit("baseline"), F.lit("negative"))).alias("condition"))
    return p.select("prompt_id", "condition", text.build_prompt(F.col("question_text"), F.col("target_word"), F.col("condition")).alias("prompt"))


@_query("""with w as (select distinct target_word w from prompts where regexp_full_match(target_word, '[A-Za-z]+')),
  v as (select w, list_distinct([w, lower(w), upper(w[1]) || lower(w[2:]), upper(w)]) cs from w), f as (select w, unnest(cs) c from v),
  s as (select w, unnest([c, ' ' || c, c || ' ', ' ' || c || ' ']) f from f) , x as (select w, unnest([f, rtrim(f) || '.', rtrim(f) || '. ']) x from s)
  select w target_word, count(distinct x) n_variants from x group by w""")
def surface_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of surface variants per target."""
    w = table(spark, sf_dir, "prompts").where(F.col("target_word").rlike("^[A-Za-z]+$")).select("target_word").distinct()
    return w.select("target_word", F.size(text.surface_variants(F.col("target_word"))).cast("bigint").alias("n_variants"))


_RELATION_SQL = "case " + " ".join(f"when {' and '.join('(' + ' or '.join(f'contains(q, {chr(39)}{w}{chr(39)})' for w in words) + ')' for words in groups)} then '{relation}'" for relation, groups in text.RELATION_RULES) + " end"


@_query(f"select cand_id, {_RELATION_SQL} relation from (select cand_id, lower(question_text) q from candidates where question_text is not null)")
def relation_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation each question's wording shows."""
    return table(spark, sf_dir, "candidates").where("question_text is not null").select("cand_id", text.infer_relation(F.col("question_text")).alias("relation"))


_FACT_CASES = " ".join(f"when regexp_matches(r, '{p}') then '{k}'" for p, k in text.FACT_RULES)


@_query(f"""with r as (select cand_id, replace(replace(lower(trim(string_split(source_trace, ':')[2])), '-', ' '), '_', ' ') r from candidates where source_trace like 'wikidata:%')
  select cand_id, case {_FACT_CASES} end relation from r""")
def fact_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical relation of each fact candidate's trace."""
    c = table(spark, sf_dir, "candidates").where(F.col("source_trace").startswith("wikidata:"))
    return c.select("cand_id", text.fact_relation(F.split("source_trace", ":")[1]).alias("relation"))


_DOMAIN = ("UsedFor", "MadeOf", "HasProperty", "HasPart", "AtLocation", "CapableOf", "UsedBy", "Requires", "Contains", "WornOn")
_COUNTS = f"""counts as (select d relation, i::int relation_no, coalesce(n, 0) n from (select unnest({list(_DOMAIN)}) d, unnest(range(0, {len(_DOMAIN)})) i)
  left join (select string_split(source_trace, ':')[2] d, count(*) n from candidates where source_trace like 'conceptnet:%' group by 1) using (d))"""


def _relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "candidates").where(F.col("source_trace").startswith("conceptnet:")).groupBy(F.split("source_trace", ":")[1].alias("relation")).agg(F.count(F.lit(1)).alias("n"))
    domain = spark.createDataFrame([(r, i) for i, r in enumerate(_DOMAIN)], "relation string, relation_no int")
    return domain.join(found, "relation", "left").select("relation", "relation_no", F.coalesce("n", F.lit(0)).alias("n"))


@_query(f"with {_COUNTS} select relation, n from counts")
def relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates per common-sense relation, those without any too."""
    return _relation_counts(spark, sf_dir).select("relation", "n")


@_query(f"""with {_COUNTS}, l as (select relation, relation_no, unnest(range(n, n + 500)) lv from counts), t as (select * from l order by lv, relation_no limit 500)
  select relation, coalesce(added, 0) added from counts left join (select relation, count(*) added from t group by 1) using (relation)""")
def relation_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hundred more units given to the least filled relations."""
    return select.water_filling(_relation_counts(spark, sf_dir), 500)


# Selection


@_query(r"""select cand_id from candidates where question_text is not null and target_word_normalized is not null
  qualify row_number() over (partition by trim(regexp_replace(lower(question_text), '[\s\x{a0}]+', ' ', 'g')), target_word_normalized order by cand_id) = 1""")
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate of each question key and target."""
    c = table(spark, sf_dir, "candidates").where("question_text is not null and target_word_normalized is not null")
    keyed = c.select("cand_id", text.question_key(F.col("question_text")).alias("q"), F.col("target_word_normalized").alias("t"))
    return select.first_wins(keyed, ["q", "t"], "cand_id").select("cand_id")


@_query("select row_id, prompt_id, run_condition from completions_greedy where prompt_id is not null qualify row_number() over (partition by prompt_id, run_condition order by row_id desc) = 1")
def dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last completion of each prompt and condition."""
    c = table(spark, sf_dir, "completions_greedy").where("prompt_id is not null").select("row_id", "prompt_id", "run_condition")
    return select.last_wins(c, ["prompt_id", "run_condition"], "row_id").select("row_id", "prompt_id", "run_condition")


_SCORE = """case when validation is null then null when coalesce(validation.leaks_answer, false) or not coalesce(validation.is_one_word_answer_enforced, false)
  or coalesce(validation.ambiguity_score, 10) > 3 or coalesce(validation.naturalness_score, 0) < 7 then 0
  else (case when validation."is_X_best" then 40 else 0 end) + (case when len(list_filter(coalesce(validation.top3_one_word_answers, []), lambda w: lower(w) <> lower(target_word))) = 0 then 30
  when len(list_filter(coalesce(validation.top3_one_word_answers, []), lambda w: lower(w) <> lower(target_word))) = 1 and coalesce(validation.ambiguity_score, 10) <= 2 then 15 else 0 end) + 30 end"""
_ACCEPTED = """coalesce(coalesce(validation."is_X_best", false) and coalesce(validation.ambiguity_score, 10) <= 3 and not coalesce(validation.leaks_answer, false)
  and coalesce(validation.is_one_word_answer_enforced, false) and coalesce(validation.naturalness_score, 0) >= 7 and lower(validation.best_one_word_answer) = lower(target_word), false)"""


@_query(f"with {_VAL} select val_id, {_SCORE} judge_score, round({_SCORE} + 100 * p_sem, 6) selection_score from val")
def v_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rubric and selection score of every validated row."""
    v = _val(spark, sf_dir).withColumn("judge_score", pressure.judge_score(F.col("validation"), F.col("target_word")))
    return v.select("val_id", "judge_score", _r(pressure.selection_score(F.col("judge_score"), F.col("p_sem")), "selection_score"))


@_query(f"with {_VAL} select coalesce(category, '') category, count(*) n_rows, sum({_ACCEPTED}::int)::bigint n_accepted, count(distinct case when {_ACCEPTED} then target_word_normalized end) n_targets from val group by 1")
def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted rows and distinct accepted targets per category."""
    v = _val(spark, sf_dir).withColumn("ok", pressure.accepted(F.col("validation"), F.col("target_word")))
    return v.groupBy(F.coalesce("category", F.lit("")).alias("category")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("ok").cast("int")).alias("n_accepted"), F.countDistinct(F.when(F.col("ok"), F.col("target_word_normalized"))).alias("n_targets")
    )


_RANKED = f"""ranked as (select val_id, prompt_id, category, question_text, target_word_normalized word, s_score, p_sem, val_id pos, least(floor(greatest(0, least(1, p_sem)) * 5)::int, 4) bin_id, {_ACCEPTED} accepted
  from val where category is not null and s_score is not null and p_sem is not null and prompt_id is not null)"""
_ONCE = "once as (select * from ranked qualify row_number() over (partition by prompt_id order by pos) = 1)"


def _once(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _val(spark, sf_dir).where("category is not null and s_score is not null and p_sem is not null and prompt_id is not null")
    rows = v.select(
        "val_id",
        "prompt_id",
        "category",
        "question_text",
        F.col("target_word_normalized").alias("word"),
        "s_score",
        "p_sem",
        F.col("val_id").alias("pos"),
        pressure.bin_id(F.col("p_sem")).alias("bin_id"),
        pressure.accepted(F.col("validation"), F.col("target_word")).alias("accepted"),
    )
    return select.first_wins(rows, ["prompt_id"], "pos").select(*rows.columns)


@_query(f"with {_VAL}, {_RANKED}, {_ONCE} select val_id from once where accepted and word is not null qualify row_number() over (partition by category, word order by s_score desc, length(question_text), pos) = 1")
def group_by_target_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best accepted prompt of each category and target."""
    return select.best_per_target(_once(spark, sf_dir).where("word is not null"), ["category", "word"]).select("val_id")


@_query(f"with {_VAL}, {_RANKED}, {_ONCE} select val_id, category, bin_id, r \"rank\" from (select *, row_number() over (partition by category, bin_id order by s_score desc, pos) r from once) where r <= 100")
def top_per_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best prompts per category and bin."""
    return select.top_per_bin(_once(spark, sf_dir), 100).select("val_id", "category", "bin_id", "rank")


@_query(f"""with {_VAL}, {_RANKED}, {_ONCE}, c as (select distinct category from once), g as (select category, b::int bin_id from c, range(0, 5) r(b)), h as (select category, bin_id, least(count(*), 100) n from once group by 1, 2)
  select category, bin_id, 100 - coalesce(n, 0) shortfall from g left join h using (category, bin_id)""")
def bin_shortfalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each bin lacks of a hundred."""
    once = _once(spark, sf_dir)
    return select.bin_shortfalls(select.top_per_bin(once, 100), 100, once)


_TAU = f"t as (select unnest({list(select.TAUS)}::double[]) tau), lad as (select category, tau, bin_id, count(*) n from once, t where p_sem >= tau group by 1, 2, 3), ladder as (select category, tau, sum(least(n, 100))::bigint balanced, sum(least(n, 100)) >= 500 reached from lad group by 1, 2)"


@_query(f"with {_VAL}, {_RANKED}, {_ONCE}, {_TAU} select category, round(tau, 6) tau, balanced, reached from ladder")
def tau_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the balanced set at each threshold."""
    return select.tau_ladder(_once(spark, sf_dir), 100, 500).select("category", _r(F.col("tau"), "tau"), "balanced", "reached")


_FILL = f"""{_TAU}, ct as (select category, coalesce(max(case when reached then tau end), min(tau)) tau from ladder group by 1),
  g as (select o.*, coalesce(p_sem >= tau, false) gated from once o left join ct using (category)),
  pr as (select *, case when gated and row_number() over (partition by category, bin_id, gated order by s_score desc, pos) <= 100 then 0 else 1 end priority from g),
  fill as (select *, row_number() over (partition by category order by priority, s_score desc, pos) r from pr)"""


@_query(f"with {_VAL}, {_RANKED}, {_ONCE}, {_FILL} select val_id, category, priority, r \"rank\" from fill where r <= 500")
def backfill_to_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced prompts filled up to five hundred per category."""
    return select.backfilled(_once(spark, sf_dir), 100, 500).select("val_id", "category", "priority", "rank")


def _capped_sql(source: str, quota: str = "") -> str:
    parts, used = [], []
    for i, c in enumerate(select.CATEGORIES):
        block = " union all ".join(f"select word from u{j}" for j in used)
        anti = f"and not exists (select 1 from (select word from ({block}) group by word having count(*) >= 2) f where f.word = s.word)" if used else ""
        parts.append(f"k{i} as (select * from {source} s where category = '{c}' {anti} {quota})")
        parts.append(f"u{i} as (select distinct word from k{i})")
        used.append(i)
    return ", ".join(parts)


_ALL_KEPT = " union all ".join(f"select val_id, category from k{i}" for i in range(len(select.CATEGORIES)))


@_query(f"with {_VAL}, {_RANKED}, {_ONCE}, w as (select *, pos \"rank\" from once where word is not null), {_capped_sql('w')} {_ALL_KEPT}")
def repetition_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts left when a word may occur in two categories only, categories in order."""
    rows = _once(spark, sf_dir).where("word is not null").select("val_id", "category", "word", F.col("pos").alias("rank"))
    return select.repetition_capped(rows).select("val_id", "category")


@_query(f"""with {_VAL}, {_RANKED}, {_ONCE}, {_FILL}, w as (select *, r "rank" from fill where word is not null),
  {_capped_sql('w', 'qualify row_number() over (order by r) <= 500')} {_ALL_KEPT}""")
def category_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole selection: thresholds, balance, back-fill, repetition cap and quota."""
    filled = select.backfilled(_once(spark, sf_dir), 100, 500, whole_ranking=True)
    rows = filled.where("word is not null").select("val_id", "category", "word", "priority", "s_score", "pos")
    return select.repetition_capped(rows, quota=500, order=select.filled_order()).select("val_id", "category")


@_query("""select val_id, (row_number() over (partition by string_split(source_trace, ':')[2] order by val_id) - 1) % 10 style_no from validated where source_trace like 'conceptnet:%'""")
def round_robin_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles in turn per relation."""
    v = table(spark, sf_dir, "validated").where(F.col("source_trace").startswith("conceptnet:")).select("val_id", F.split("source_trace", ":")[1].alias("relation"))
    return select.round_robin(v, ["relation"], [F.col("val_id")], 10).select("val_id", "style_no")


@_query(f"""with r as (select cand_id, string_split(source_trace, ':')[2] relation, row_number() over (partition by string_split(source_trace, ':')[2] order by md5('7|' || cand_id)[1:8], cand_id) n from candidates where source_trace like 'conceptnet:%')
  select cand_id, relation from r where n <= 37 // 3 + (list_position(['UsedFor', 'MadeOf', 'HasProperty'], relation) <= 37 % 3)::int and list_contains(['UsedFor', 'MadeOf', 'HasProperty'], relation)""")
def per_relation_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty-seven candidates split over three relations, drawn in hashed order."""
    c = table(spark, sf_dir, "candidates").where(F.col("source_trace").startswith("conceptnet:")).select("cand_id", F.split("source_trace", ":")[1].alias("relation"))
    return select.per_relation_quota(c, "relation", [stats.hashed_order(F.col("cand_id"), 7), F.col("cand_id")], 37, ("UsedFor", "MadeOf", "HasProperty")).select("cand_id", "relation")


@_query()
def joint_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates admitted in order while neither target nor style is used up within its category."""
    c = table(spark, sf_dir, "candidates")
    rows = c.select("cand_id", name_key(c["category"]).alias("category"), "target_word_normalized", "source_trace").dropna()
    return select.jointly_capped(rows, "category", {"target_word_normalized": 3, "source_trace": 5}, ["cand_id"], "cand_id long, category string, target_word_normalized string, source_trace string")


_OUTCOME = f"""oc as (select prompt_id, case when bool_or(word_present) then 'failure' else 'success' end outcome from det where "condition" = 'negative' group by 1)"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _det(spark, sf_dir).where("condition = 'negative'").groupBy("prompt_id").agg(F.bool_or("word_present").alias("w"))
    return d.select("prompt_id", F.when(F.col("w"), "failure").otherwise("success").alias("outcome"))


@_query(f"""with {_DET}, {_OUTCOME}, m as (select min(n) least from (select count(*) n from oc group by outcome)), r as (select prompt_id, outcome, row_number() over (partition by outcome order by md5('42|' || prompt_id)[1:8], prompt_id) n from oc)
  select prompt_id, outcome from r, m where outcome = 'success' or n <= least""")
def balanced_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All successes and as many failures."""
    return select.balanced_subset(_outcomes(spark, sf_dir), "outcome", "prompt_id").select("prompt_id", "outcome")


@_query("""select row_id, (row_number() over (partition by run_condition order by row_id) - 1) // 32 batch from completions_greedy""")
def token_budget_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of thirty-two rows per condition."""
    c = table(spark, sf_dir, "completions_greedy").select("row_id", "run_condition")
    return select.fixed_batches(c, [F.col("row_id")], 32, ["run_condition"]).select("row_id", "batch")


@_query("""with recursive c as (select row_id, export_source s, greatest(coalesce(len(generated_token_ids), 0), 0)::int k, row_number() over (partition by export_source order by row_id) n from completions_greedy where export_source is not null),
  w as (select row_id, s, n, k cost, 0 batch, 1 filled, k used from c where n = 1 union all
    select c.row_id, c.s, c.n, c.k, case when filled >= 64 or used + k > 256 then batch + 1 else batch end, case when filled >= 64 or used + k > 256 then 1 else filled + 1 end, case when filled >= 64 or used + k > 256 then k else used + k end from w join c on c.s = w.s and c.n = w.n + 1)
  select row_id, s export_source, cost, batch from w""")
def token_budget_batches_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches closed by a row cap or a token budget."""
    c = table(spark, sf_dir, "completions_greedy").select("row_id", "export_source", F.greatest(F.coalesce(F.size("generated_token_ids"), F.lit(0)), F.lit(0)).alias("cost"))
    rows = c.where("export_source is not null")
    return select.budget_batches(rows, "export_source", "row_id", "cost", 64, 256, "row_id long, export_source string, cost int, batch int")


# Statistics

_STEPS = " + ".join(f"(u >= {t})::int" for t in stats.POISSON_STEPS)


def _bootstrap_sql(rows: str, keys: str, iterations: int = stats.ITERATIONS) -> str:
    """CTEs from ``rows`` (keys, id, v) to ``ci``."""
    return f"""rows as ({rows}), d as (select {keys}, v, (('0x' || md5('{stats.SEED}|' || id)[1:8])::bigint * (2 * r + 1) + r * 2654435761) % 4294967296 u from rows, range(0, {iterations}) t(r)),
  d2 as (select {keys}, v, (('0x' || md5('{stats.SEED}|' || id)[1:8])::bigint * (2 * r + 1) + r * 2654435761) % 4294967296 u, r from rows, range(0, {iterations}) t(r)),
  reps as (select {keys}, r, sum(({_STEPS}) * v) / sum({_STEPS}) m from d2 group by {keys}, r having sum({_STEPS}) > 0),
  ci as (select {keys}, quantile_cont(m, 0.025) ci_low, quantile_cont(m, 0.975) ci_high from reps group by {keys}),
  me as (select {keys}, avg(v) mean, count(v) n from rows group by {keys})"""


@_query(f"""with {_P}, {_bootstrap_sql("select p0_bin, b.prompt_id id, violation_rate v from behavior_metrics b join p using (prompt_id) where p0_bin is not null and violation_rate is not null and not isnan(violation_rate)", "p0_bin")}
  select p0_bin, round(mean, 6) mean, round(ci_low, 6) ci_low, round(ci_high, 6) ci_high, n from me join ci using (p0_bin)""")
def bootstrap_violation_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean violation rate per bin with its bootstrap interval."""
    rows = table(spark, sf_dir, "behavior_metrics").join(_p(spark, sf_dir).select("prompt_id", "p0_bin"), "prompt_id").where("p0_bin is not null")
    ci = stats.bootstrap_ci(rows, ["p0_bin"], "violation_rate", "prompt_id")
    return ci.select("p0_bin", _r(F.col("mean"), "mean"), _r(F.col("ci_low"), "ci_low"), _r(F.col("ci_high"), "ci_high"), "n")


@_query(f"""with {_P}, {_bootstrap_sql("select p0_bin, 'suppression_' || n metric_name, prompt_id || n id, v from (select prompt_id, p0_bin, p0 - p1 delta, (p0 - p1) / greatest(p0, 1e-9) relative, ln(greatest(p0, 1e-12)) - ln(greatest(p1, 1e-12)) log from p where p0_bin is not null) unpivot (v for n in (delta, relative, log))", "p0_bin, metric_name")}
  select p0_bin, metric_name, round(mean, 6) mean, round(ci_low, 6) ci_low, round(ci_high, 6) ci_high, n from me join ci using (p0_bin, metric_name)""")
def bootstrap_suppression_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppression per bin with intervals, all measures in one pass."""
    delta, relative, log = pressure.suppression(F.col("p0"), F.col("p1"))
    wide = _p(spark, sf_dir).where("p0_bin is not null").select("prompt_id", "p0_bin", delta.alias("delta"), relative.alias("relative"), log.alias("log"))
    long = wide.unpivot(["prompt_id", "p0_bin"], ["delta", "relative", "log"], "m", "v").select("p0_bin", F.concat(F.lit("suppression_"), "m").alias("metric_name"), F.concat("prompt_id", "m").alias("id"), "v")
    ci = stats.bootstrap_ci(long, ["p0_bin", "metric_name"], "v", "id")
    return ci.select("p0_bin", "metric_name", _r(F.col("mean"), "mean"), _r(F.col("ci_low"), "ci_low"), _r(F.col("ci_high"), "ci_high"), "n")


@_query()
def bootstrap_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The violation intervals with whole resamples drawn by NumPy."""
    rows = table(spark, sf_dir, "behavior_metrics").join(_p(spark, sf_dir).select("prompt_id", "p0_bin"), "prompt_id").where("p0_bin is not null")
    return stats.bootstrap_exact(rows.select("p0_bin", pressure.number_or_null(F.col("violation_rate")).alias("v")), ["p0_bin"], "v")


@_query(f"""with {_DET}, w as (select prompt_id, avg(case when "condition" = 'baseline' then word_present::int end) baseline, avg(case when "condition" = 'negative' then word_present::int end) negative from det group by 1)
  select prompt_id, round(baseline, 6) baseline, round(negative, 6) negative, round(baseline - negative, 6) delta from w where baseline is not null and negative is not null""")
def pivot_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both conditions of a prompt side by side; prompts that lack one are left out."""
    d = _det(spark, sf_dir).withColumn("v", F.col("word_present").cast("double"))
    wide = d.groupBy("prompt_id").pivot("condition", ["baseline", "negative"]).avg("v").dropna(subset=["baseline", "negative"])
    return wide.select("prompt_id", _r(F.col("baseline"), "baseline"), _r(F.col("negative"), "negative"), _r(F.col("baseline") - F.col("negative"), "delta"))


@_query(f"""with {_P}, j as (select violation_rate y, p0 x from behavior_metrics join p using (prompt_id) where violation_rate is not null and not isnan(violation_rate) and p0 is not null)
  select round(regr_slope(y, x), 6) slope, round(regr_intercept(y, x), 6) intercept, round(regr_r2(y, x), 6) r2, count(*) n from j""")
def regression_violation_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares of violation rate on pressure."""
    rows = table(spark, sf_dir, "behavior_metrics").join(_p(spark, sf_dir).select("prompt_id", "p0"), "prompt_id")
    fit = stats.regression(rows, "violation_rate", "p0")
    return fit.select(_r(F.col("slope"), "slope"), _r(F.col("intercept"), "intercept"), _r(F.col("r2"), "r2"), "n")


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _det(spark, sf_dir).where("condition = 'negative'")
    return d.join(_p(spark, sf_dir).select("prompt_id", "p0"), "prompt_id").select(F.col("word_present").cast("double").alias("y"), F.col("p0").alias("x"))


@_query(f"""with recursive {_DET}, {_P}, r as materialized (select p0 x, word_present::int y, count(*) n from det join p using (prompt_id) where "condition" = 'negative' and p0 is not null group by 1, 2),
  it(step, b0, b1) as (select 0, 0.0::double, 0.0::double union all select step + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) from (
    select step, b0, b1, sum(n * (y - q)) g0, sum(n * (y - q) * x) - b1 g1, sum(n * q * (1 - q)) h00, sum(n * q * (1 - q) * x) h01, sum(n * q * (1 - q) * x * x) + 1 h11
    from (select step, b0, b1, x, y, n, 1 / (1 + exp(-(b0 + b1 * x))) q from it, r where step < 12) group by step, b0, b1))
  select round(i / 100, 6) x, round(1 / (1 + exp(-(b0 + b1 * (i / 100)))), 6) p from it, range(0, 101) g(i) where step = 12""")
def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted probability of a violation over the pressure grid."""
    b0, b1 = stats.logistic_newton(_violations(spark, sf_dir), "y", "x")
    return spark.range(0, 101).select(_r(F.col("id") / 100, "x"), _r(stats.logistic_curve(F.col("id") / 100, b0, b1), "p"))


@_query()
def logistic_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve with its bootstrap band."""
    return stats.logistic_band(_violations(spark, sf_dir), "y", "x")


@_query(f"""with {_DET}, {_P}, r as (select p0 x, avg(word_present::int) y, count(*) w from det join p using (prompt_id) where "condition" = 'negative' and p0 is not null group by 1),
  c as (select x, row_number() over (order by x) k, sum(w * y) over (order by x) s, sum(w) over (order by x) t from r), z as (select * from c union all select null, 0, 0, 0),
  m as (select a.k + 1 i, b.k j, (b.s - a.s) / (b.t - a.t) v from z a join c b on b.k > a.k), l as (select i, j k, min(v) over (partition by i order by j rows between current row and unbounded following) v from m)
  select round(x, 9) x, round(max(v), 6) p from l join c using (k) group by x""")
def isotonic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Increasing step fit of violations on pressure."""
    return stats.isotonic(_violations(spark, sf_dir), "y", "x").select(F.round("x", 9).alias("x"), _r(F.col("p"), "p"))


@_query()
def logistic_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intercept and slope with their bootstrap intervals."""
    return stats.logistic_coefficients(_violations(spark, sf_dir), "y", "x")


# Arrays: attention, logits, patches

_TR = """tr as (select vec_id, vec_id % 50 prompt_id, case when label % 2 = 0 then 'baseline' else 'negative' end "condition", (vec_id // 50 % 5)::int layer, (vec_id // 250)::int head, label,
  list_transform(embedding, lambda x: x::double * x::double) w, list_transform(embedding, lambda x: 10 * x::double) logits, list_transform(embedding, lambda x: x::double) h from embeddings)"""
_MASS = f"""{_TR}, ms as (select *, list_sum(w[1:24]) instr, list_sum(w[1:6]) neg, list_sum(w[13:14]) tgt, list_sum(w[25:56]) qst from tr),
  am as (select *, instr / (instr + qst + 1e-9) iar, neg / (instr + 1e-9) nf, tgt / (instr + 1e-9) tmf, tgt / (instr + 1e-9) - neg / (instr + 1e-9) pi from ms)"""


def _tr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    h = arrays.doubles(F.col("embedding"))
    return e.select(
        "vec_id",
        (F.col("vec_id") % 50).alias("prompt_id"),
        F.when(F.col("label") % 2 == 0, "baseline").otherwise("negative").alias("condition"),
        (F.floor(F.col("vec_id") / 50) % 5).cast("int").alias("layer"),
        F.floor(F.col("vec_id") / 250).cast("int").alias("head"),
        "label",
        F.transform(h, lambda x: x * x).alias("w"),
        F.transform(h, lambda x: 10 * x).alias("logits"),
        h.alias("h"),
    )


def _am(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    at = lambda a, b: F.array(*[F.lit(i) for i in range(a, b)])
    masses = _tr(spark, sf_dir).withColumns({"instr": arrays.mass(w, at(0, 24)), "neg": arrays.mass(w, at(0, 6)), "tgt": arrays.mass(w, at(12, 14)), "qst": arrays.mass(w, at(24, 56))})
    return masses.withColumns(arrays.attention_scores(F.col("instr"), F.col("neg"), F.col("tgt"), F.col("qst")))


@_query(f"with {_MASS} select vec_id, round(instr, 6) instr, round(neg, 6) neg, round(tgt, 6) tgt, round(qst, 6) qst from am")
def attention_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention mass of each span."""
    return _am(spark, sf_dir).select("vec_id", *[_r(F.col(c), c) for c in ("instr", "neg", "tgt", "qst")])


@_query(f"with {_MASS} select vec_id, round(iar, 6) iar, round(nf, 6) nf, round(tmf, 6) tmf, round(pi, 6) pi from am")
def attention_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four attention scores per head."""
    return _am(spark, sf_dir).select("vec_id", *[_r(F.col(c), c) for c in ("iar", "nf", "tmf", "pi")])


@_query(f"""with {_MASS} select prompt_id, "condition", coalesce(layer, -1) layer, coalesce(head, -1) head, case when grouping(layer) = 1 then 'global_mean' when grouping(head) = 1 then 'layer_mean' else 'head' end aggregate_flag,
  round(avg(iar), 6) iar, round(avg(pi), 6) pi from am group by grouping sets ((prompt_id, "condition", layer, head), (prompt_id, "condition", layer), (prompt_id, "condition"))""")
def attention_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head, layer and global means in one pass of grouping sets."""
    keys = [F.col(c) for c in ("prompt_id", "condition", "layer", "head")]
    sets = [keys, keys[:3], keys[:2]]
    rolled = _am(spark, sf_dir).groupingSets(sets, *keys).agg(F.grouping("layer").alias("gl"), F.grouping("head").alias("gh"), _r(F.avg("iar"), "iar"), _r(F.avg("pi"), "pi"))
    flag = F.when(F.col("gl") == 1, "global_mean").when(F.col("gh") == 1, "layer_mean").otherwise("head")
    return rolled.select("prompt_id", "condition", F.coalesce("layer", F.lit(-1)).alias("layer"), F.coalesce("head", F.lit(-1)).alias("head"), flag.alias("aggregate_flag"), "iar", "pi")


_TROUT = """to_ as (select prompt_id, case when avg(case when "condition" = 'negative' then pi end) < 0 then 'failure' else 'success' end outcome from am group by 1)"""


@_query(f"""with {_MASS}, {_TROUT} select (prompt_id % 5)::int bin_id, coalesce(outcome, 'unknown') outcome, round(avg(iar), 6) iar, round(avg(nf), 6) nf, round(avg(tmf), 6) tmf, count(*) n from am left join to_ using (prompt_id) group by 1, 2""")
def attention_by_bin_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention per bin and outcome."""
    am = _am(spark, sf_dir).drop("w", "logits", "h")
    out = am.groupBy("prompt_id").agg(F.when(F.avg(F.when(F.col("condition") == "negative", F.col("pi"))) < 0, "failure").otherwise("success").alias("outcome"))
    joined = am.join(out, "prompt_id", "left").groupBy((F.col("prompt_id") % 5).cast("int").alias("bin_id"), F.coalesce("outcome", F.lit("unknown")).alias("outcome"))
    return joined.agg(_r(F.avg("iar"), "iar"), _r(F.avg("nf"), "nf"), _r(F.avg("tmf"), "tmf"), F.count(F.lit(1)).alias("n"))


def _soft_sql(e: str) -> str:
    return f"list_transform({e}, lambda x: exp(x - list_max({e})))"


_SOFT = f"""{_TR}, sm as (select vec_id, prompt_id, "condition", layer, label, {_soft_sql("logits")} e from tr), pr as (select vec_id, prompt_id, "condition", layer, e[label + 1] / list_sum(e) p_target, list_max(e) / list_sum(e) p_top, list_position(e, list_max(e)) - 1 top_id from sm)"""


def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tr(spark, sf_dir).withColumn("p", arrays.softmax_of(F.col("logits")))
    return t.select("vec_id", "prompt_id", "condition", "layer", F.get("p", F.col("label")).alias("p_target"), F.array_max("p").alias("p_top"), arrays.argmax(F.col("p")).alias("top_id"))


@_query(f"with {_SOFT} select vec_id, round(p_target, 6) p_target, round(p_top, 6) p_top, top_id::int top_id from pr")
def softmax_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and greedy probability of each logit vector."""
    return _probabilities(spark, sf_dir).select("vec_id", _r(F.col("p_target"), "p_target"), _r(F.col("p_top"), "p_top"), "top_id")


@_query(f"""with {_SOFT} select "condition", layer, round(avg(p_target), 6) p_target, count(*) n from pr group by 1, 2""")
def logit_lens_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target probability per condition and layer."""
    return _probabilities(spark, sf_dir).groupBy("condition", "layer").agg(_r(F.avg("p_target"), "p_target"), F.count(F.lit(1)).alias("n"))


def _p_of_sql(h: str) -> str:
    return f"(list_transform({h}, lambda x: exp(10 * x - 10 * list_max({h})))[label + 1] / list_sum(list_transform({h}, lambda x: exp(10 * x - 10 * list_max({h})))))"


_DEC = f"""{_TR}, st as (select vec_id, layer, label, h, list_transform(list_zip(h, list_reverse(h)), lambda z: z[1] + 0.5 * z[2]) ha from tr),
  s2 as (select *, list_transform(list_zip(ha, h), lambda z: z[1] + z[2] * z[2]) haf from st), dc as (select vec_id, layer, {_p_of_sql("h")} p_in, {_p_of_sql("ha")} p_attn, {_p_of_sql("haf")} p_out from s2)"""


def _exponents(c: str):
    return F.transform(c, lambda x: F.exp(10 * x - 10 * F.col(f"m_{c}")))


def _decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tr(spark, sf_dir).select("vec_id", "layer", "label", "h", arrays.add(F.col("h"), F.transform(F.reverse("h"), lambda x: 0.5 * x)).alias("ha"))
    t = t.withColumn("haf", arrays.add(F.col("ha"), F.transform("h", lambda x: x * x)))
    for c in ("h", "ha", "haf"):
        t = t.withColumn(f"m_{c}", F.array_max(c))
        t = t.withColumn(f"e_{c}", _exponents(c))
    p = lambda c: F.get(f"e_{c}", F.col("label")) / arrays.total(F.col(f"e_{c}"))
    return t.select("vec_id", "layer", p("h").alias("p_in"), p("ha").alias("p_attn"), p("haf").alias("p_out"))


@_query(f"with {_DEC} select vec_id, round(p_in, 6) p_h_in, round(p_attn - p_in, 6) attn_contrib, round(p_out - p_attn, 6) ffn_contrib from dc")
def component_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What attention and feed-forward add to the target's probability."""
    d = _decomposed(spark, sf_dir)
    return d.select("vec_id", _r(F.col("p_in"), "p_h_in"), _r(F.col("p_attn") - F.col("p_in"), "attn_contrib"), _r(F.col("p_out") - F.col("p_attn"), "ffn_contrib"))


@_query(f"with {_DEC} select layer, round(avg(p_attn - p_in), 6) attn_contrib, round(avg(p_out - p_attn), 6) ffn_contrib from dc group by 1")
def decomposition_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per layer."""
    return _decomposed(spark, sf_dir).groupBy("layer").agg(_r(F.avg(F.col("p_attn") - F.col("p_in")), "attn_contrib"), _r(F.avg(F.col("p_out") - F.col("p_attn")), "ffn_contrib"))


_PAT = f"""{_TR}, pairs as (select a.vec_id, a.layer, a.label, a.w own, b.w other from tr a join tr b on b.vec_id = a.vec_id + 1 where a.vec_id % 2 = 0),
  pt as (select vec_id, layer, label, own, list_concat(other[1:8], own[9:]) patched from pairs),
  pe as (select vec_id, layer, own[label + 1] before, patched[label + 1] after, list_position(own, list_max(own)) <> list_position(patched, list_max(patched)) flip from pt)"""


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tr(spark, sf_dir).select("vec_id", "layer", "label", "w")
    a = t.where("vec_id % 2 = 0")
    b = t.select((F.col("vec_id") - 1).alias("vec_id"), F.col("w").alias("other"))
    pairs = a.join(b, "vec_id").withColumn("patched", arrays.patched(F.col("w"), F.col("other"), F.array(*[F.lit(i) for i in range(8)])))
    return pairs.select(
        "vec_id",
        "layer",
        F.get("w", F.col("label")).alias("before"),
        F.get("patched", F.col("label")).alias("after"),
        (arrays.argmax(F.col("w")) != arrays.argmax(F.col("patched"))).alias("flip"),
    )


@_query(f"with {_PAT} select vec_id, round(after - before, 6) delta_p, flip::int flip_indicator from pe")
def array_patch_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect of patching the first positions with those of the paired vector."""
    return _patches(spark, sf_dir).select("vec_id", _r(F.col("after") - F.col("before"), "delta_p"), F.col("flip").cast("int").alias("flip_indicator"))


@_query(f"with {_PAT} select layer, (vec_id % 5)::int bin_id, round(avg(after - before), 6) delta_p, count(*) n from pe group by 1, 2")
def patch_effect_by_bin_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean effect per bin and layer."""
    return _patches(spark, sf_dir).groupBy("layer", (F.col("vec_id") % 5).cast("int").alias("bin_id")).agg(_r(F.avg(F.col("after") - F.col("before")), "delta_p"), F.count(F.lit(1)).alias("n"))


@_query(f"""with {_PAT}, {_bootstrap_sql("select layer, vec_id::varchar id, after - before v from pe", "layer")} select layer, round(mean, 6) mean, round(ci_low, 6) ci_low, round(ci_high, 6) ci_high, n from me join ci using (layer)""")
def bootstrap_patching_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patch effect per layer with its interval."""
    rows = _patches(spark, sf_dir).select("layer", "vec_id", (F.col("after") - F.col("before")).alias("v"))
    ci = stats.bootstrap_ci(rows, ["layer"], "v", "vec_id")
    return ci.select("layer", _r(F.col("mean"), "mean"), _r(F.col("ci_low"), "ci_low"), _r(F.col("ci_high"), "ci_high"), "n")


@_query(f"""with {_SOFT}, f as (select vec_id, label, e, list_sum(e) s from sm) select vec_id, round(greatest(0, least(1, 0.8 * e[label + 1] / s + 0.1 * e[11] / s + 0.5 * e[64] / s)), 6) p_sem from f""")
def factorised_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pressure from first-token probabilities and what follows them."""
    rest = F.create_map(F.col("label"), F.lit(0.8), F.lit(10), F.lit(0.1), F.lit(63), F.lit(0.5))
    t = _tr(spark, sf_dir).select("vec_id", arrays.softmax_of(F.col("logits")).alias("first"), rest.alias("rest"))
    return t.select("vec_id", _r(arrays.factorised(F.col("first"), F.col("rest")), "p_sem"))


@_query(rf"""select row_id, case when completion_text is null then null when not {_whole_sql("target_word", "completion_text")} then 0
  else greatest(0, least(len(regexp_extract_all(regexp_extract(lower(completion_text), '^(.*?)(?:^|[^\pL\pN])' || regexp_escape(lower(target_word)) || '(?:[^\pL\pN]|$)', 1, 's'), '\pL+')), len(generated_token_ids) - 1)) end::int step
  from completions_greedy where target_word is not null and generated_token_ids is not null""")
def decision_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step at which each answer was decided, words standing for tokens."""
    c = table(spark, sf_dir, "completions_greedy").where("target_word is not null and generated_token_ids is not null")
    pattern = F.concat(F.lit(r"(?s)^(.*?)(?:^|[^\p{L}\p{N}])"), text.quoted(F.lower("target_word")), F.lit(r"(?:[^\p{L}\p{N}]|$)"))
    lead = F.call_function("regexp_extract", F.lower("completion_text"), pattern, F.lit(1))
    first = F.regexp_count(lead, F.lit(r"\p{L}+"))
    step = arrays.decision_step(F.col("completion_text").isNotNull(), F.lit(False), text.word_present(F.col("target_word"), F.col("completion_text")), first, F.size("generated_token_ids"))
    return c.select("row_id", F.when(F.col("completion_text").isNotNull(), step).cast("int").alias("step"))


# Reports

_TAX = f"""{_MASS}, tx as (select prompt_id, avg(tmf) tmf, avg(nf) nf, avg(case when "condition" = 'baseline' then pi end) - avg(case when "condition" = 'negative' then pi end) delta from am group by 1),
  tm as (select *, tmf - nf tmf_minus_nf, case when coalesce(delta < 0, false) or coalesce(tmf - nf > 0.02, false) then 'priming' else 'override' end failure_mode from tx)"""


def _taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    pi = lambda c: F.avg(F.when(F.col("condition") == c, F.col("pi")))
    t = _am(spark, sf_dir).drop("w", "logits", "h").groupBy("prompt_id").agg(F.avg("tmf").alias("tmf"), F.avg("nf").alias("nf"), (pi("baseline") - pi("negative")).alias("delta"))
    gap = F.col("tmf") - F.col("nf")
    mode = F.when(F.coalesce(F.col("delta") < 0, F.lit(False)) | F.coalesce(gap > 0.02, F.lit(False)), "priming").otherwise("override")
    return t.select("prompt_id", "tmf", "nf", "delta", gap.alias("tmf_minus_nf"), mode.alias("failure_mode"))


@_query(f"with {_TAX} select failure_mode, count(*) n from tm group by 1")
def failure_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures by mode."""
    return _taxonomy(spark, sf_dir).groupBy("failure_mode").agg(F.count(F.lit(1)).alias("n"))


@_query(f"""with {_TAX} select prompt_id, failure_mode, r "rank" from (select *, row_number() over (partition by failure_mode order by case when failure_mode = 'priming' then tmf_minus_nf else delta end desc nulls last, prompt_id) r from tm) where r <= 10""")
def taxonomy_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten clearest failures of each mode, each by its own measure."""
    measure = F.when(F.col("failure_mode") == "priming", F.col("tmf_minus_nf")).otherwise(F.col("delta"))
    ranked = select.ranked(_taxonomy(spark, sf_dir), ["failure_mode"], [measure.desc_nulls_last(), F.col("prompt_id")])
    return ranked.where(F.col("rank") <= 10).select("prompt_id", "failure_mode", "rank")


@_query(f"""with {_DET}, {_OUTCOME}, {_P}, f as (select prompt_id, row_number() over (order by prompt_id) - 1 n from oc where outcome = 'failure' qualify n < 20)
  select format('{{:02d}}_{{}}', n, prompt_id) name, question_text, target_word from f join p using (prompt_id)""")
def appendix_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty failures with their numbers."""
    # A limit before the numbering keeps the sort of all failures to a top-k.
    top = _outcomes(spark, sf_dir).where("outcome = 'failure'").orderBy("prompt_id").limit(20)
    numbered = top.withColumn("n", F.row_number().over(Window.orderBy("prompt_id")) - 1)
    return numbered.join(_p(spark, sf_dir).select("prompt_id", "question_text", "target_word"), "prompt_id").select(F.format_string("%02d_%s", "n", "prompt_id").alias("name"), "question_text", "target_word")


@_query()
def tables_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All report tables as one nested document."""
    return writers.nested_tables(violation_rate=violation_rate_by_bin(spark, sf_dir), attention=attention_by_bin_outcome(spark, sf_dir), lens=logit_lens_curves(spark, sf_dir), patching=patch_effect_by_bin_layer(spark, sf_dir))


@_query("""select cand_id, raw_data->>'$.target' target, raw_data->>'$.place' place, raw_data->>'$.source' source from candidates where raw_data is not null""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of each candidate's raw record."""
    c = table(spark, sf_dir, "candidates").where("raw_data is not null").select("cand_id", F.try_parse_json("raw_data").alias("v"))
    return c.select("cand_id", *[F.try_variant_get("v", f"$.{k}", "string").alias(k) for k in ("target", "place", "source")])


@_query(f"""with {_VAL} select val_id, coalesce(validation."is_X_best", false) is_best, coalesce(validation.ambiguity_score, 10) ambiguity, coalesce(validation.naturalness_score, 0) naturalness, len(coalesce(validation.top3_one_word_answers, []))::int n_answers from val""")
def judge_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge answers written as fenced JSON and read back with defaults."""
    v = table(spark, sf_dir, "validated").select("val_id", F.concat(F.lit("Here you are:\n```json\n"), F.coalesce(F.to_json("validation"), F.lit("{}")), F.lit("\n```")).alias("answer"))
    shape = "is_X_best boolean, ambiguity_score int, naturalness_score int, top3_one_word_answers array<string>"
    parsed = v.select("val_id", F.from_json(text.first_json(F.col("answer")), shape).alias("j"))
    return parsed.select(
        "val_id",
        F.coalesce("j.is_X_best", F.lit(False)).alias("is_best"),
        F.coalesce("j.ambiguity_score", F.lit(10)).alias("ambiguity"),
        F.coalesce("j.naturalness_score", F.lit(0)).alias("naturalness"),
        F.size(F.coalesce("j.top3_one_word_answers", F.array().cast("array<string>"))).alias("n_answers"),
    )


@_query()
def dataset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of prompts and a hash of their content that no order changes."""
    return writers.content_hash(_p(spark, sf_dir))


@_query(r"select word, word_rank, zipf from lexicon where regexp_full_match(word, '\pL{3,}') and zipf between 3.5 and 6.0 and word_rank <= 5000 order by word_rank limit 200")
def lexicon_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two hundred most common words within the frequency band."""
    from kilnspark.sources.readers import lexicon_targets as pick

    return pick(table(spark, sf_dir, "lexicon"), 200)


@_query(r"""select cand_id, regexp_matches(trim(trim(target_word), '.,!?;:"''-'), '^\pL{2,}$') ok from candidates where target_word is not null""")
def valid_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each target is one proper word."""
    return table(spark, sf_dir, "candidates").where("target_word is not null").select("cand_id", text.valid_target(F.col("target_word")).alias("ok"))


@_query("""select user_id, event_type, count(*) n_events, min(event_id) first_event from (select * from events qualify row_number() over (partition by user_id, event_type, ts order by event_id) = 1) group by 1, 2""")
def stream_resume_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through a resumable stream, run twice: each key reaches the table once."""
    import os
    import uuid

    from kilnspark.session import ensure_checkpoint_dir
    from kilnspark.streaming.resume import resume_stream

    root = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    e = table(spark, sf_dir, "events")
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    e.select(*[c.split()[0] for c in schema.split(", ")]).write.parquet(f"{root}/in")
    for _ in range(2):
        resume_stream(spark, f"{root}/in", schema, f"{root}/out", ["user_id", "event_type", "ts"], "event_id", f"{root}/state", fmt="parquet", files=8)
    return spark.read.parquet(f"{root}/out").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_event"))


# Smaller readings


@_query(f"select coalesce({_CAT}, '') category, count(*) n_rows, count(distinct target_word_normalized) n_targets, count(distinct trim(regexp_replace(lower(question_text), '[\\s\\x{{a0}}]+', ' ', 'g'))) n_questions from candidates group by 1")
def diversity_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, distinct targets and distinct question keys per category."""
    c = table(spark, sf_dir, "candidates")
    keys = c.select(F.coalesce(name_key(c["category"]), F.lit("")).alias("category"), "target_word_normalized", text.question_key(F.col("question_text")).alias("q"))
    return keys.groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("target_word_normalized").alias("n_targets"), F.countDistinct("q").alias("n_questions"))


@_query(f"with w as (select target_word_normalized w, count(distinct {_CAT}) n from candidates where target_word_normalized is not null group by 1) select count(*) unique_words, sum((n > 1)::int)::bigint multi_category_words, max(n) max_categories from w")
def word_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, words of several categories, and the most categories a word has."""
    c = table(spark, sf_dir, "candidates").where("target_word_normalized is not null")
    per_word = c.groupBy("target_word_normalized").agg(F.countDistinct(name_key(c["category"])).alias("n"))
    return per_word.agg(F.count(F.lit(1)).alias("unique_words"), F.sum((F.col("n") > 1).cast("int")).alias("multi_category_words"), F.max("n").alias("max_categories"))


@_query("select doc_id, run_id from documents where run_id = (select max(run_id) from documents)")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the latest run."""
    from kilnspark.sources.readers import latest_run_rows

    return latest_run_rows(table(spark, sf_dir, "documents").select("doc_id", "run_id"))


@_query("select row_id, case when len(generated_token_ids) < 8 then 'stop' else 'length' end reason, case when len(generated_token_ids) < 8 then 'stop' else 'length' end = finish_reason agrees from completions_greedy where generated_token_ids is not null")
def finish_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finish reason the token ids show, and whether the run reported the same."""
    c = table(spark, sf_dir, "completions_greedy").where("generated_token_ids is not null")
    reason = arrays.finish_reason(F.col("generated_token_ids"), 8)
    return c.select("row_id", reason.alias("reason"), (reason == F.col("finish_reason")).alias("agrees"))


@_query("""with a as (select row_id, list_transform(generated_token_ids, lambda x: x % 5) g from completions_greedy where generated_token_ids is not null),
  b as (select row_id, g, list_position(g, 1) p, coalesce(list_max(list_transform(range(1, len(g) + 1), lambda i: case when g[i] <> 0 then i else 0 end)), 0) k from a)
  select row_id, (case when p > 0 then len(g[1:p]) else k end)::int n_ids, coalesce(list_sum(case when p > 0 then g[1:p] else g[1:k] end), 0)::bigint id_sum from b""")
def trimmed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and sum of the ids up to the first end mark or without the pads at the end; their remainders by five stand for ids, 1 ends and 0 pads."""
    c = table(spark, sf_dir, "completions_greedy").where("generated_token_ids is not null")
    kept = c.select("row_id", arrays.trimmed_ids(F.transform("generated_token_ids", lambda x: x % 5), 1, 0).alias("g"))
    return kept.select("row_id", F.size("g").alias("n_ids"), F.aggregate("g", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"))


@_query(r"""select cand_id, string_split(trim(regexp_replace(question_text, '[\s\x{a0}]+', ' ', 'g')), ' ')[1] first_word, case when length(question_text) > 50 then substr(question_text, 1, 47) || '...' else question_text end short,
  lower(regexp_replace(question_text, '[^A-Za-z]', '', 'g')) letters, string_split(source_trace, ':')[1] source from candidates where question_text is not null and source_trace is not null""")
def small_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First word, shortened text and letters of each question, and the source of its trace."""
    c = table(spark, sf_dir, "candidates").where("question_text is not null and source_trace is not null")
    q = F.col("question_text")
    return c.select("cand_id", text.first_token(q).alias("first_word"), text.shorten(q, 50).alias("short"), text.letters_only(q).alias("letters"), F.split("source_trace", ":")[0].alias("source"))


_SUBJECT_SQL = "coalesce(" + ", ".join(f"case when regexp_matches(q, '{p}') then trim(regexp_replace(regexp_extract(q, '{p}', 1), ' +', ' ', 'g')) end" for _, p in text.SUBJECT_PATTERNS) + ")"


@_query(f"select cand_id, {_SUBJECT_SQL} subject from (select cand_id, lower(question_text) q from candidates where question_text is not null)")
def subject_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject of each question that has the wording of a relation."""
    return table(spark, sf_dir, "candidates").where("question_text is not null").select("cand_id", text.subject_of(F.col("question_text")).alias("subject"))


@_query(f"""with {_P}, {_bootstrap_sql("select p0_bin, prompt_id id, ln(greatest(p0, 1e-12)) - ln(greatest(p1, 1e-12)) v from p where p0_bin is not null", "p0_bin")}
  select p0_bin, round(mean, 6) mean, round(mean - ci_low, 6) err_low, round(ci_high - mean, 6) err_high, n from me join ci using (p0_bin)""")
def log_suppression_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log suppression per bin with the lengths of its error bars."""
    rows = _p(spark, sf_dir).where("p0_bin is not null").select("p0_bin", "prompt_id", pressure.suppression(F.col("p0"), F.col("p1"))[2].alias("v"))
    bars = stats.error_bars(stats.bootstrap_ci(rows, ["p0_bin"], "v", "prompt_id"))
    return bars.select("p0_bin", _r(F.col("mean"), "mean"), _r(F.col("err_low"), "err_low"), _r(F.col("err_high"), "err_high"), "n")


@_query(f"""with {_SOFT}, x as (select layer, max(layer) over () last, "condition", p_target from pr) select "condition", round(avg(p_target), 6) p_target, count(*) n from x where layer = last group by 1""")
def final_layer_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target probability at the last layer per condition."""
    p = _probabilities(spark, sf_dir)
    last = p.agg(F.max("layer").alias("m")).scalar()
    return p.where(F.col("layer") == last).groupBy("condition").agg(_r(F.avg("p_target"), "p_target"), F.count(F.lit(1)).alias("n"))


@_query(f"""with {_TR}, pairs as (select a.vec_id, a.w own, b.w other from tr a join tr b on b.vec_id = a.vec_id + 1 where a.vec_id % 2 = 0)
  select vec_id, round(list_sum(list_concat(list_concat(own[1:3], [other[11], other[12], other[13]]), own[7:])), 6) total from pairs""")
def aligned_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after positions 3, 4, 5 were replaced by positions 10, 11, 12 of the paired vector, aligned up to the shorter list."""
    t = _tr(spark, sf_dir).select("vec_id", "w")
    both = t.where("vec_id % 2 = 0").join(t.select((F.col("vec_id") - 1).alias("vec_id"), F.col("w").alias("other")), "vec_id")
    ints = lambda *v: F.array(*[F.lit(x) for x in v])
    patched = arrays.patched_pairs(F.col("w"), F.col("other"), arrays.aligned(ints(3, 4, 5), ints(10, 11, 12, 13)))
    return both.select("vec_id", _r(arrays.total(patched), "total"))


# The remaining queries register themselves.
from kilnspark.plans import catalogue_files, catalogue_jobs  # noqa: E402, F401
