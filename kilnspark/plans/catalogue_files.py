"""Queries that write tables with the library's sinks, read them back with its sources, and work on what was read, with their SQL.

Files are written below the shared folder and removed when the application ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnspark.functions import pressure, text
from kilnspark.functions.names import name_key
from kilnspark.operators import model, select
from kilnspark.plans import pipelines
from kilnspark.plans.catalogue import _ACCEPTED, _CAT, _DET, _OUTCOME, _P, _VAL, _det, _outcomes, _p, _query, _r, _val, attention_by_bin_outcome, violation_rate_by_bin
from kilnspark.session import scratch, table
from kilnspark.sinks import writers
from kilnspark.sources import cached, readers
from kilnspark.streaming.resume import append_new, resume_stream

# CSV


@_query(f"""with {_P} select prompt_id, nullif(category, '') category, p0_bin, question_text, round(p0, 6) p0, v_score from p""")
def csv_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt table through CSV: ids stay text, numbers numbers, and line breaks and quotes stay in questions."""
    path = scratch(spark, "prompts")
    p = _p(spark, sf_dir).select("prompt_id", "category", "p0_bin", "question_text", "target_word", "p0", "v_score")
    writers.write_csv(p, path, p.columns)
    return readers.read_prompts(spark, path).select("prompt_id", "category", "p0_bin", "question_text", _r(F.col("p0"), "p0"), "v_score")


@_query(f"""with {_P} select prompt_id, target_word from p where question_text is not null and target_word is not null order by prompt_id limit 50""")
def limited_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty prompts of a file written in order, as the jobs read it with a limit."""
    path = scratch(spark, "limited")
    p = _p(spark, sf_dir).where("question_text is not null and target_word is not null").select("prompt_id", "question_text", "target_word")
    writers.write_csv(p.orderBy("prompt_id"), path, p.columns)
    return select.head(readers.read_prompts(spark, path), "prompt_id", 50).select("prompt_id", "target_word")


@_query("""with r as (select prompt_id, violation_rate v, 1 part from behavior_metrics where prompt_id < 'd' union all select prompt_id, violation_rate, 2 from behavior_metrics where prompt_id >= 'd')
  select count(*) n_rows, count(case when not isnan(v) then v end) n_rates, round(avg(case when not isnan(v) then v end), 6) mean from r""")
def csv_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric table appended to a CSV in two parts and read with its types inferred."""
    path = scratch(spark, "metrics")
    b = table(spark, sf_dir, "behavior_metrics").select("prompt_id", pressure.number_or_null(F.col("violation_rate")).alias("violation_rate"))
    for i, part in enumerate((b.where("prompt_id < 'd'"), b.where("prompt_id >= 'd'"))):
        writers.write_csv(part, path, ["prompt_id", "violation_rate"], append=i > 0)
    rows = readers.read_csv(spark, path, ["prompt_id", "violation_rate"])
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count("violation_rate").alias("n_rates"), _r(F.avg("violation_rate"), "mean"))


# JSON lines


def _lines(spark: SparkSession, path: str, *lines: str) -> None:
    """More lines for a log."""
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)


@_query(f"""select coalesce({_CAT}, '') category, count(*) n, count(distinct coalesce(target_word_normalized, lower(target_word))) n_targets from candidates group by 1""")
def jsonl_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates through a JSON-lines log that also holds blank and broken lines."""
    path = scratch(spark, "candidates")
    c = table(spark, sf_dir, "candidates")
    writers.write_jsonl(c.select("category", "question_text", "target_word", "target_word_normalized", "prompt_style_id", "source_trace", "raw_data"), path)
    _lines(spark, path, "", "  ", '{"category": "facts", ', "no json")
    r = readers.read_candidates(spark, path)
    return r.groupBy(F.coalesce(name_key(r["category"]), F.lit("")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target_word_normalized").alias("n_targets"))


@_query("select count(*) + 2 n_rows, 2::bigint n_bad from candidates")
def jsonl_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and broken records of a log."""
    path = scratch(spark, "bad")
    writers.write_jsonl(table(spark, sf_dir, "candidates").select("cand_id", "question_text"), path)
    _lines(spark, path, "", '{"cand_id": ', "{")
    return readers.bad_lines(spark, path, "cand_id long, question_text string")


@_query(f"""with {_VAL} select val_id::varchar prompt_id, coalesce(v_score, coalesce(validation.v_score, 0)) v_score, round(coalesce(p_sem, 0), 6) p_sem, round(coalesce(s_score, 0), 6) s_score, coalesce(validation."is_X_best", false) is_best,
  coalesce(validation.ambiguity_score, 10) ambiguity, coalesce(validation.best_one_word_answer, '') best, len(coalesce(validation.top3_one_word_answers, []))::int n_answers from val""")
def jsonl_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validated prompts through a log, a folder per category, read back typed with the defaults of missing judge fields."""
    path = scratch(spark, "validated")
    v = _val(spark, sf_dir).select(F.col("val_id").cast("string").alias("prompt_id"), F.coalesce("category", F.lit("none")).alias("category"), "question_text", "target_word", "target_word_normalized", "source_trace", "v_score", "p_sem", "s_score", F.to_json("validation").alias("validation"))
    writers.write_by_category(v, path)
    r = readers.read_validated(spark, path)
    return r.select("prompt_id", "v_score", _r(F.col("p_sem"), "p_sem"), _r(F.col("s_score"), "s_score"), F.col("validation.is_X_best").alias("is_best"), F.col("validation.ambiguity_score").alias("ambiguity"), F.col("validation.best_one_word_answer").alias("best"), F.size("validation.top3_one_word_answers").alias("n_answers"))


def _completion_log(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Completions as a log of one file, in the order of row_id."""
    path = scratch(spark, name)
    c = table(spark, sf_dir, "completions_greedy").select("row_id", "prompt_id", F.col("run_condition").alias("condition"), "sample_id", F.col("completion_text").alias("generated_text"))
    writers.write_jsonl(c.repartitionByRange(4, "row_id").sortWithinPartitions("row_id"), path)
    return path


@_query("select distinct prompt_id, run_condition \"condition\", sample_id from completions_greedy where prompt_id is not null")
def jsonl_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys of a completion log."""
    return readers.read_keys(spark, _completion_log(spark, sf_dir, "completions")).where("prompt_id is not null")


@_query("select prompt_id, completion_text generated_text from completions_greedy where prompt_id is not null and run_condition = 'negative' and sample_id = '' qualify row_number() over (partition by prompt_id order by row_id desc) = 1")
def jsonl_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last greedy negative completion of each prompt in a log of several files, by the place of its record."""
    return readers.read_greedy(spark, _completion_log(spark, sf_dir, "greedy"))


@_query(f"""with {_DET}, l as (select prompt_id, "condition", word_present from det where prompt_id is not null qualify row_number() over (partition by prompt_id, "condition" order by row_id desc) = 1)
  select prompt_id, case when word_present then 'failure' else 'success' end outcome from l where "condition" = 'negative'""")
def jsonl_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes from a detection log: the last record of a prompt and condition counts, and the first log that exists."""
    path = scratch(spark, "detections")
    d = _det(spark, sf_dir).where("prompt_id is not null").select("row_id", "prompt_id", "condition", F.lit("").alias("sample_id"), "word_present")
    writers.write_jsonl(d.repartitionByRange(4, "row_id").sortWithinPartitions("row_id"), path)
    schema = "prompt_id string, condition string, sample_id string, word_present boolean"
    return readers.outcomes(readers.read_detection(spark, [f"{path}-none", path], schema))


@_query(f"""with {_P} select prompt_id, round(p0 / 2, 6) p_sem from p where p0 is not null""")
def jsonl_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a checkpoint log written twice: the later record of a prompt counts, records without a score don't."""
    path = scratch(spark, "checkpoint")
    p = _p(spark, sf_dir).select("prompt_id", F.col("p0").alias("p_sem"))
    old = p.withColumn("turn", F.lit(0)).unionByName(p.withColumn("p_sem", F.col("p_sem") / 2).withColumn("turn", F.lit(1)))
    writers.write_jsonl(old.repartitionByRange(4, "turn", "prompt_id").sortWithinPartitions("turn", "prompt_id").drop("turn"), path)
    return readers.last_by_place(readers.read_checkpoint(spark, path), ["prompt_id"]).select("prompt_id", _r(F.col("p_sem"), "p_sem"))


@_query("select distinct prompt_id, run_condition \"condition\", 1 source from completions_greedy where prompt_id is not null union all select distinct prompt_id, run_condition, 2 from completions_greedy where prompt_id is not null and run_condition = 'negative'")
def keys_or_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are done: of a log (1), and of a CSV output where there is no log (2)."""
    log, out = _completion_log(spark, sf_dir, "keys"), scratch(spark, "output")
    c = table(spark, sf_dir, "completions_greedy").where("run_condition = 'negative'").select("prompt_id", F.col("run_condition").alias("condition"))
    writers.write_csv(c, out, ["prompt_id", "condition"])
    first = readers.keys_or(spark, log, out).withColumn("source", F.lit(1))
    return first.unionByName(readers.keys_or(spark, f"{log}-none", out).withColumn("source", F.lit(2)))


# Nested documents


@_query(f"""with {_P} select p0_bin, round(avg(case when not isnan(violation_rate) then violation_rate end), 6) violation_rate, count(case when not isnan(violation_rate) then violation_rate end) n_prompts from behavior_metrics b join p using (prompt_id) where p0_bin is not null group by p0_bin""")
def nested_tables_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the tables of a nested report document, written and read again."""
    path = scratch(spark, "tables")
    doc = writers.nested_tables(violation_rate=violation_rate_by_bin(spark, sf_dir), attention=attention_by_bin_outcome(spark, sf_dir))
    doc.coalesce(1).write.text(path)
    return readers.read_nested(spark, path, violation_rate="n_prompts bigint, p0_bin string, violation_rate double")["violation_rate"].select("p0_bin", "violation_rate", "n_prompts")


@_query(f"""with {_DET}, {_OUTCOME}, {_P}, f as (select prompt_id, row_number() over (order by prompt_id) - 1 n from oc where outcome = 'failure' qualify n < 20) select format('{{:02d}}_{{}}', n, prompt_id) name, question_text, target_word from f join p using (prompt_id)""")
def exemplar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exemplars written as a folder of a record each, and read again."""
    from kilnspark.plans.catalogue import appendix_exemplars

    path = scratch(spark, "exemplars")
    writers.write_exemplars(appendix_exemplars(spark, sf_dir), path)
    return spark.read.option("basePath", path).schema("question_text string, target_word string, name string").json(f"{path}/name=*").select("name", "question_text", "target_word")


@_query(f"""with {_P} select prompt_id, c "condition", (c = 'negative' or length(prompt_id) % 2 = 0) found, case when c = 'negative' or length(prompt_id) % 2 = 0 then length(prompt_id)::int else -1 end first_id from p, unnest(['baseline', 'negative']) u(c)""")
def trace_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated ids from stored traces, for pairs that lack one too."""
    path = scratch(spark, "traces")
    pairs = _p(spark, sf_dir).select("prompt_id", F.explode(F.array(F.lit("baseline"), F.lit("negative"))).alias("condition"))
    kept = pairs.where((F.col("condition") == "negative") | (F.length("prompt_id") % 2 == 0))
    writers.write_traces(kept.withColumn("generated_ids", F.array(F.length("prompt_id"), F.lit(7))), path)
    return readers.read_traces(spark, path, pairs).select("prompt_id", "condition", "found", F.coalesce(F.get("generated_ids", F.lit(0)), F.lit(-1)).alias("first_id"))


# Judge


@_query(f"""with {_VAL} select coalesce(category, '') category, count(*) n_rows, sum(({_ACCEPTED})::int)::bigint n_accepted, count(*) filter (where validation is null) n_unparsed from val group by 1""")
def judge_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judge's audit log, appended and read back: decisions and answers that were not parsed per category."""
    path = scratch(spark, "audit")
    v = _val(spark, sf_dir)
    for i, part in enumerate((v.where("val_id % 2 = 0"), v.where("val_id % 2 = 1"))):
        writers.write_jsonl(pipelines.audit_rows(part), path, append=i > 0)
    log = readers.read_jsonl(spark, path, "prompt_id string, category string, raw_response_json string, acceptance_decision boolean")
    return log.groupBy(F.coalesce("category", F.lit("")).alias("category")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("acceptance_decision").alias("n_accepted"), F.count_if(F.col("raw_response_json").isNull()).alias("n_unparsed"))


@_query("""with v as (select val_id, coalesce(validation.ambiguity_score, 10) ambiguity, val_id % 11 = 0 err from validated where validation is not null and val_id % 13 <> 0)
  select val_id::varchar custom_id, case when err then 10 else ambiguity end ambiguity, err failed from v""")
def batch_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge answers from a batch output: some are sent twice, of which the last counts, some failed, some have no id."""
    path = scratch(spark, "batch")
    v = table(spark, sf_dir, "validated").where("validation is not null")
    body = F.to_json(F.struct(F.struct(F.concat(F.lit("```json\n"), F.to_json("validation"), F.lit("\n```")).alias("output_text")).alias("body")))
    rows = v.select("val_id", F.when(F.col("val_id") % 13 != 0, F.col("val_id").cast("string")).alias("custom_id"), body.alias("response"), F.when(F.col("val_id") % 11 == 0, "timed out").alias("error"))
    early = rows.select(F.lit(0).alias("turn"), "custom_id", F.lit("{}").alias("response"), F.lit(None).cast("string").alias("error"))
    late = rows.select(F.lit(1).alias("turn"), "custom_id", "response", "error")
    both = early.unionByName(late).repartitionByRange(4, "turn", "custom_id").sortWithinPartitions("turn", "custom_id")
    writers.write_jsonl(both.drop("turn"), path)
    got = readers.batch_responses(spark, path)
    answer = F.when(F.col("error").isNull(), F.from_json(text.first_json(readers.message_text("response")), "ambiguity_score int"))
    return got.select("custom_id", F.coalesce(answer["ambiguity_score"], F.lit(10)).alias("ambiguity"), F.col("error").isNotNull().alias("failed"))


@_query("""with w as (select distinct coalesce(target_word, '') w from validated), t as (select w, length(w) <= 5 single from w), v as (select coalesce(nullif(regexp_replace(regexp_replace(lower(category), '[\\s\\x{a0}_\\-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'none') category, coalesce(target_word, '') w from validated where target_word is not null)
  select category, sum(single::int)::bigint kept, sum((not single)::int)::bigint removed, count(*) processed from v join t using (w) group by 1""")
def single_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the single-token filter keeps and removes per category, through its files; words of up to five letters stand for single tokens."""
    path = scratch(spark, "single")
    v = _val(spark, sf_dir).where("target_word is not null").select("val_id", F.coalesce("category", F.lit("none")).alias("category"), "target_word")
    words = v.select(F.col("target_word").alias("word")).distinct()
    sequences = words.select("word", F.array(F.when(F.length("word") <= 5, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))).alias("sequences"))
    writers.write_single_token(*model.single_token_filter(v, sequences), path)
    return readers.read_jsonl(spark, f"{path}/summary", "category string, kept long, removed long, processed long")


# Cached sources


@_query(r"""with id as (select 'as ' || a.word || ' as any ' || b.word idiom, a.word meaning from lexicon a join lexicon b on b.word_rank = a.word_rank + 1 where regexp_full_match(b.word, '\pL+'))
  select k.kind, idiom, case when k.kind = 'bare' then meaning else meaning end meaning from id, unnest(['braces', 'bare', 'named']) k(kind)""")
def idiom_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sayings from files of the three layouts: in braces, two columns without a header, and columns named by a header in another order."""
    lex = table(spark, sf_dir, "lexicon")
    after = lex.select((F.col("word_rank") - 1).alias("word_rank"), F.col("word").alias("other")).where(F.col("other").rlike(r"^\p{L}+$"))
    made = lex.join(after, "word_rank").select(F.concat(F.lit("as "), "word", F.lit(" as any "), "other").alias("idiom"), F.col("word").alias("meaning"))
    braces, bare, named = (scratch(spark, n) for n in ("braces", "bare", "named"))
    made.select(F.concat(F.lit("{"), "idiom", F.lit("}>>{"), "meaning", F.lit("}"))).coalesce(1).write.text(braces)
    made.coalesce(1).write.csv(bare)
    made.select(F.col("meaning").alias("The meaning"), F.col("idiom").alias("English idiom")).coalesce(1).write.option("header", True).csv(named)
    read = lambda kind, path: readers.read_idioms(spark, path).select(F.lit(kind).alias("kind"), "idiom", "meaning")
    return read("braces", braces).unionByName(read("bare", bare)).unionByName(read("named", named))


@_query(r"""with q as (select cand_id, trim(question_text) q from candidates where question_text is not null and not contains(question_text, chr(10)) and not contains(question_text, chr(13)) and len(string_split(trim(regexp_replace(question_text, '[\s\x{a0}]+', ' ', 'g')), ' ')) >= 6)
  select q scenario from (select q from q order by cand_id limit 40)""")
def scenario_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty texts of six words or more of a file."""
    path = scratch(spark, "scenarios")
    c = table(spark, sf_dir, "candidates").where(F.col("question_text").isNotNull() & ~F.contains("question_text", F.lit("\n")) & ~F.contains("question_text", F.lit("\r")))
    c.select("cand_id", "question_text").orderBy("cand_id").coalesce(1).select("question_text").write.text(path)
    return readers.read_scenarios(spark, path, 40)


_WIKI = r"""w as (select distinct string_split(source_trace, ':')[2] relation, string_split(source_trace, ':')[3] subject, target_word target from candidates where source_trace like 'wikidata:%' and target_word is not null)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "candidates").where(F.col("source_trace").startswith("wikidata:") & F.col("target_word").isNotNull())
    part = F.split("source_trace", ":")
    return c.select(part[1].alias("relation"), part[2].alias("subject"), F.col("target_word").alias("target")).distinct()


@_query(f"with {_WIKI} select relation source, count(*) n, count(distinct subject) n_subjects from w group by 1")
def bindings_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result bindings of cached answers through the data source, counted per relation; an answer has about a thousand pairs."""
    root = scratch(spark, "bindings")
    facts = _facts(spark, sf_dir)
    parts = facts.count() // 1_000 + 1
    value = lambda c: F.struct(F.col(c).alias("value"))
    rows = facts.groupBy(F.col("relation").alias("source"), F.pmod(F.xxhash64("subject", "target"), F.lit(parts))).agg(F.collect_list(F.struct(value("subject").alias("subject"), value("target").alias("object"))).alias("b"))
    rows.select("source", F.to_json(F.struct(F.struct(F.col("b").alias("bindings")).alias("results"))).alias("value")).write.partitionBy("source").text(root)
    cached.register(spark)
    got = spark.read.format("cached_bindings").option("path", root.removeprefix("file://").removeprefix("file:")).option("pattern", "source=*/*.txt").load()
    return got.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("subject").alias("n_subjects"))


@_query(rf"""with {_WIKI}, v as (select distinct subject, target from w where relation = 'capital' and regexp_full_match(trim(trim(target), '.,!?;:"''-'), '\pL{{2,}}')) select subject, target from v order by subject, target limit 60""")
def fact_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sixty pairs of one predicate whose target is one word."""
    return readers.triples(_facts(spark, sf_dir).select("subject", F.col("relation").alias("predicate"), F.col("target").alias("object")), "capital", 60)


@_query(rf"""with {_WIKI}, f as (select distinct subject, length(subject) % 7 via from w where relation = 'capital'), g as (select distinct length(subject) % 7 via, target from w where relation = 'currency'),
  v as (select distinct f.subject, g.target from f join g using (via) where regexp_full_match(trim(trim(g.target), '.,!?;:"''-'), '\pL{{2,}}')) select subject, target from v order by subject, target limit 60""")
def fact_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sixty pairs over an intermediate node; lengths of names stand for those nodes."""
    f = _facts(spark, sf_dir).withColumn("via", (F.length("subject") % 7).cast("string"))
    first = f.where("relation = 'capital'").select("subject", F.lit("at").alias("predicate"), F.col("via").alias("object"))
    second = f.where("relation = 'currency'").select(F.col("via").alias("subject"), F.lit("has").alias("predicate"), F.col("target").alias("object"))
    return readers.two_hops(first.unionByName(second), "at", "has", 60)


@_query(f"""with {_WIKI}, u as (select 0 p, 'wikidata' source, * from w where relation <> 'river' union all select 1, 'restcountries', relation, upper(subject), lower(target) from w)
  select source, relation, subject, target from u qualify row_number() over (partition by relation, lower(subject), lower(target) order by p, subject, target) = 1""")
def united_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of two sources; of equal pairs, whatever their letter case, the first source's stays."""
    f = _facts(spark, sf_dir)
    other = f.select("relation", F.upper("subject").alias("subject"), F.lower("target").alias("target")).distinct()
    return readers.united_facts(("wikidata", f.where("relation <> 'river'")), ("restcountries", other))


_NET = r"""e as (select distinct lower(string_split(source_trace, ':')[3]) concept, string_split(source_trace, ':')[2] relation, target_word word from candidates where source_trace like 'conceptnet:%' and target_word is not null)"""


@_query(rf"""with {_NET}, r as (select *, row_number() over (partition by concept, relation order by length(word) desc, '/c/en/' || word) r from e where relation in ('UsedFor', 'MadeOf', 'HasProperty'))
  select concept, relation, word from r where r <= 20 and regexp_full_match(word, '\pL+')""")
def concept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heaviest edges of each concept that end in one English word, from a dump of edges."""
    path = scratch(spark, "edges")
    c = table(spark, sf_dir, "candidates").where(F.col("source_trace").startswith("conceptnet:") & F.col("target_word").isNotNull())
    part = F.split("source_trace", ":")
    e = c.select(F.lower(part[2]).alias("concept"), part[1].alias("relation"), F.col("target_word").alias("word")).distinct()
    edges = e.select(F.concat(F.lit("/c/en/"), "concept").alias("subject"), "relation", F.concat(F.lit("/c/en/"), "word").alias("object"), F.length("word").cast("double").alias("weight"))
    writers.write_jsonl(edges, path)
    return readers.related(e.select("concept").distinct(), readers.read_edges(spark, path))


@_query("""select n_name name, upper(r_name) capital, 'CUR' currency, r_name continent, len(n_name) % 3 n_languages from nation join region on r_regionkey = n_regionkey""")
def country_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cached country list with nested fields, some of them missing."""
    path = scratch(spark, "countries")
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    spoken = F.when(F.length("n_name") % 3 == 1, F.create_map(F.lit("a"), F.lit("A"))).when(F.length("n_name") % 3 == 2, F.create_map(F.lit("a"), F.lit("A"), F.lit("b"), F.lit("B")))
    doc = n.select(F.struct(F.col("n_name").alias("common")).alias("name"), F.array(F.upper("r_name")).alias("capital"), F.create_map(F.lit("CUR"), F.struct(F.lit("Coin").alias("name"))).alias("currencies"), spoken.alias("languages"), F.array("r_name").alias("continents"))
    doc.agg(F.to_json(F.collect_list(F.struct(*doc.columns)))).coalesce(1).write.text(path)
    c = readers.read_countries(spark, path)
    return c.select("name", F.get("capitals", F.lit(0)).alias("capital"), F.get("currency_codes", F.lit(0)).alias("currency"), F.get("continents", F.lit(0)).alias("continent"), F.size("languages").cast("bigint").alias("n_languages"))


_MONTHS_SQL = "[" + ", ".join(f"'{m}'" for m in text.MONTHS) + "]"


@_query(f"""select event_id, ({_MONTHS_SQL})[month(ts)] birth_month, 'a_b' word, case when event_id % 2 = 0 then 'bread' end concept from events""")
def stamp_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of dates with long years, and words of concept addresses."""
    e = table(spark, sf_dir, "events")
    stamp = F.concat(F.lit("+"), F.date_format("ts", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    address = F.when(F.col("event_id") % 2 == 0, "/c/en/bread").when(F.col("event_id") % 3 == 0, "/c/de/brot").otherwise("/c/en/two_words")
    return e.select("event_id", text.birth_month(stamp).alias("birth_month"), F.lit("a_b").alias("word"), text.english_concept(address).alias("concept"))


@_query(f"""with runs as (select distinct run_id from documents where run_id is not null) select (select 'experiment_run_' || max(run_id) from runs) below, 'experiment_run_0' itself, true no_run, (select 'experiment_run_' || max(run_id) from runs) unnamed""")
def run_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run that is chosen: the latest below a folder, a run itself, a folder without runs, and the latest below the default."""
    root = scratch(spark, "runs")
    d = table(spark, sf_dir, "documents").where("run_id is not null").select("run_id").distinct()
    fs = spark._jvm.org.apache.hadoop.fs
    for r in d.select(F.concat(F.lit("experiment_run_"), "run_id").alias("r")).orderBy(F.col("r").desc()).limit(5).collect():
        p = fs.Path(f"{root}/{r['r']}/runs")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
    name = lambda p: p.rsplit("/", 1)[-1]
    chosen = (name(readers.latest_run(spark, root)), name(readers.latest_run(spark, f"{root}/experiment_run_0")), readers.latest_run(spark, f"{root}-none") == f"{root}-none", name(readers.latest_run(spark, None, root)))
    return spark.createDataFrame([chosen], "below string, itself string, no_run boolean, unnamed string")


# Resumption


@_query("select prompt_id, run_condition, count(*) n from (select prompt_id, run_condition from completions_greedy where prompt_id is not null group by prompt_id, run_condition) group by 1, 2")
def resumed_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions appended by key in three overlapping parts: each key is there once."""
    path = scratch(spark, "resumed")
    c = table(spark, sf_dir, "completions_greedy").where("prompt_id is not null").select("row_id", "prompt_id", "run_condition")
    for part in (c.where("row_id % 3 <> 0"), c.where("row_id % 3 <> 1"), c):
        append_new(part, path, ["prompt_id", "run_condition"], "row_id")
    return spark.read.parquet(path).groupBy("prompt_id", "run_condition").agg(F.count(F.lit(1)).alias("n"))


@_query(f"""with {_DET}, f as (select prompt_id, "condition", min(row_id) row_id from det where prompt_id is not null group by 1, 2) select f.prompt_id, f."condition", word_present, format_adherence from f join det using (row_id)""")
def streamed_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection run inside a resumable stream over a completion log, twice: each prompt and condition is detected once."""
    root = scratch(spark, "detecting")
    c = table(spark, sf_dir, "completions_greedy").where("completion_text is not null and target_word is not null and prompt_id is not null")
    first = select.first_wins(c.select("row_id", "prompt_id", F.col("run_condition").alias("condition"), "completion_text", "target_word"), ["prompt_id", "condition"], "row_id")
    first.repartition(3).write.parquet(f"{root}/in")

    def detect(batch: DataFrame) -> DataFrame:
        found = text.word_present(F.col("target_word"), F.col("completion_text"))
        return batch.select("row_id", "prompt_id", "condition", found.alias("word_present"), text.word_count_is_one(text.normalize_text(F.col("completion_text"))).alias("format_adherence"))

    for _ in range(2):
        resume_stream(spark, f"{root}/in", "row_id long, prompt_id string, condition string, completion_text string, target_word string", f"{root}/out", ["prompt_id", "condition"], "row_id", f"{root}/state", fmt="parquet", work=detect, files=1)
    return spark.read.parquet(f"{root}/out").select("prompt_id", "condition", "word_present", "format_adherence")


@_query("""with t as (select distinct prompt_id, run_condition from completions_greedy where prompt_id is not null), k as (select prompt_id, run_condition, min(row_id) % 4 = 0 lost from completions_greedy where prompt_id is not null group by 1, 2)
  select prompt_id, run_condition "condition", case when lost then 'unknown' else 'stop' end finish_reason from k""")
def recovered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions of which a quarter is lost, rebuilt from the traces."""
    from kilnspark.streaming.resume import recovered

    k = table(spark, sf_dir, "completions_greedy").where("prompt_id is not null").groupBy("prompt_id", F.col("run_condition").alias("condition")).agg(F.min("row_id").alias("row_id"))
    have = k.where("row_id % 4 <> 0").select("prompt_id", "condition", F.lit("stop").alias("finish_reason"))
    return recovered(k.select("prompt_id", "condition"), have)


# The experiment's tasks and tables


@_query(f"""with {_P}, g as (select prompt_id, c "condition", s sample_id from p, unnest(['baseline', 'negative']) u(c), unnest(['', '0', '1']) v(s)), d as (select distinct prompt_id, run_condition "condition", sample_id from completions_greedy where completion_text is not null)
  select "condition", sample_id, count(*) n from g anti join d using (prompt_id, "condition", sample_id) group by 1, 2""")
def open_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy and sampled tasks that no completion answers, per condition and sample."""
    p = _p(spark, sf_dir).select("prompt_id", F.lit("b").alias("prompt_text"), F.lit("n").alias("negative_prompt_text"))
    done = table(spark, sf_dir, "completions_greedy").where("completion_text is not null").select("prompt_id", F.col("run_condition").alias("condition"), "sample_id")
    return pipelines.tasks(p, done, 2).groupBy("condition", "sample_id").agg(F.count(F.lit(1)).alias("n"))


@_query(f"""with {_P} select prompt_id, round(p0 - p1, 6) delta, round((p0 - p1) / greatest(p0, 1e-9), 6) relative, least(floor(greatest(0, least(1, p0)) * 5)::int, 4) bin_id from p""")
def psem_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppression table and the table of bins, side by side."""
    psem, bins = pipelines.psem_and_bins(_p(spark, sf_dir))
    return psem.join(bins.select("prompt_id", "bin_id"), "prompt_id").select("prompt_id", _r(F.col("delta"), "delta"), _r(F.col("relative"), "relative"), "bin_id")


@_query(f"""with {_P}, {_DET}, {_OUTCOME}, j as (select p.* exclude (category), coalesce(category, 'none') category, outcome from p join oc using (prompt_id)), q as (select greatest(0.7, least(0.95, quantile_cont(p0, 0.75))) t from j), a as (select j.* from j, q where p0 >= t),
  m as (select min(n) least from (select count(*) n from a group by outcome)), r as (select *, row_number() over (partition by outcome order by md5('42|' || prompt_id)[1:8], prompt_id) n from a) select prompt_id, category, round(p0, 6) p0, outcome from r, m where outcome = 'success' or n <= least""")
def high_pressure_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patching subset: prompts of known outcome above the upper quartile, balanced."""
    p = _p(spark, sf_dir).withColumn("category", F.coalesce("category", F.lit("none")))
    return pipelines.high_pressure_subset(p, _outcomes(spark, sf_dir)).select("prompt_id", "category", _r(F.col("p0"), "p0"), "outcome")
