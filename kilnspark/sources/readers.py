"""Readers of the pipeline's files and cached service answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilnspark.functions import text
from kilnspark.schemas import CANDIDATES, CONCEPT_EDGES, COUNTRIES, PROMPTS, VALIDATED_LOG, VALIDATION


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df``, or ValueError naming the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def file_place() -> Column:
    """Where a record stands in the files it is read from: file, block and order within it. Later records are larger."""
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))


def read_prompts(spark: SparkSession, path: str, columns: Sequence[str] = ("prompt_id", "question_text", "target_word")) -> DataFrame:
    """The prompt table from CSV; ids are strings. A missing file raises FileNotFoundError."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    head = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    require_columns(head, columns)
    kinds = dict(f.split(" ") for f in PROMPTS.split(", "))
    return head.select(*[F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in head.columns])


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A named stage output with its required columns, types inferred."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return require_columns(spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", True).csv(path), columns)


_PLACE = "struct<file_path:string,file_block_start:bigint,row:bigint>"


def read_jsonl(spark: SparkSession, path: str, schema: str, keep_bad: bool = False, placed: bool = False, required: bool = False) -> DataFrame:
    """Records of a JSON-lines log. A missing file has none, or raises if ``required``; blank and broken lines are left out, or kept in ``_corrupt``.

    ``placed`` adds ``_pos``, the record's place in the files.
    """
    if not _exists(spark, path):
        if required:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema + (f", _pos {_PLACE}" if placed else "") + (", _corrupt string" if keep_bad else ""))
    # Parsed from text lines, so that a query of few columns still finds broken records.
    parsed = F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    lines = spark.read.text(path).select("value", *([file_place().alias("_pos")] if placed else [])).where(F.trim("value") != "")
    rows = lines.select(parsed.alias("r"), *(["_pos"] if placed else [])).select("r.*", *(["_pos"] if placed else []))
    return rows if keep_bad else rows.where(F.col("_corrupt").isNull()).drop("_corrupt")


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(n_rows, n_bad) of a log."""
    rows = read_jsonl(spark, path, schema, keep_bad=True)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count("_corrupt").alias("n_bad"))


def read_validated(spark: SparkSession, path: str) -> DataFrame:
    """Typed validated prompts of a required log: scores that are no numbers are 0, missing judge fields have their defaults."""
    rows = read_jsonl(spark, path, VALIDATED_LOG, required=True)
    v = F.from_json("validation", VALIDATION)
    fields = {"is_one_word_answer_enforced": False, "best_one_word_answer": "", "is_X_best": False, "ambiguity_score": 10, "leaks_answer": False, "naturalness_score": 0, "comments": ""}
    typed = F.struct(*[F.coalesce(F.col("_v")[k], F.lit(d)).alias(k) for k, d in fields.items()], F.coalesce(F.col("_v")["top3_one_word_answers"], F.array().cast("array<string>")).alias("top3_one_word_answers"))
    number = lambda c, kind, other: F.coalesce(F.col(c).try_cast(kind), other).alias(c)
    score = F.coalesce(F.col("_v")["v_score"], F.lit(0))
    norm = F.coalesce("target_word_normalized", F.lower("target_word")).alias("target_word_normalized")
    return rows.withColumn("_v", v).select(F.coalesce("prompt_id", F.lit("")).alias("prompt_id"), "category", "question_text", "target_word", norm, "prompt_style_id", "source_trace", number("v_score", "int", score), number("p_sem", "double", F.lit(0.0)), number("s_score", "double", F.lit(0.0)), typed.alias("validation"))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Typed candidates of a required log; a missing normal form is the target in lower case."""
    rows = read_jsonl(spark, path, CANDIDATES, required=True)
    return rows.withColumn("target_word_normalized", F.coalesce("target_word_normalized", F.lower("target_word")))


def read_keys(spark: SparkSession, path: str, keys: Sequence[str] = ("prompt_id", "condition", "sample_id")) -> DataFrame:
    """Distinct keys already in a log; only these columns are read."""
    return read_jsonl(spark, path, ", ".join(f"{k} string" for k in keys)).select(*keys).distinct()


def keys_or(spark: SparkSession, log: str, table: str, keys: Sequence[str] = ("prompt_id", "condition")) -> DataFrame:
    """Distinct keys that are done: those of the log if there is one, else those of the CSV output, else none."""
    if _exists(spark, log) or not _exists(spark, table):
        found = read_keys(spark, log, keys)
    else:
        found = spark.read.option("header", True).csv(table).select(*keys).distinct()
    return found.dropna()


def read_checkpoint(spark: SparkSession, path: str, key: str = "prompt_id", value: str = "p_sem") -> DataFrame:
    """(key, value, _pos) of a score log; rows lacking either are left out."""
    return read_jsonl(spark, path, f"{key} string, {value} double", placed=True).where(F.col(key).isNotNull() & F.col(value).isNotNull())


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A whole JSON document per file."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def read_detection(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Greedy detections, one per prompt and condition, from the first log that exists; the last record wins."""
    for p in paths:
        if _exists(spark, p):
            rows = read_jsonl(spark, p, schema, placed=True).where(F.coalesce("sample_id", F.lit("")) == "")
            return last_by_place(rows, ["prompt_id", "condition"])
    return spark.createDataFrame([], schema)


def last_by_place(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last record of each key in the files; summed up before the shuffle."""
    kept = F.struct(*[c for c in rows.columns if c != "_pos"])
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(kept, "_pos").alias("r")).select("r.*")


def read_greedy(spark: SparkSession, path: str) -> DataFrame:
    """(prompt_id, generated_text) of the last greedy negative completion of each prompt."""
    rows = read_jsonl(spark, path, "prompt_id string, condition string, sample_id string, generated_text string", placed=True)
    negative = rows.where("condition = 'negative' and coalesce(sample_id, '') = '' and prompt_id is not null")
    return last_by_place(negative, ["prompt_id"]).select("prompt_id", "generated_text")


def read_nested(spark: SparkSession, path: str, **schemas: str) -> dict[str, DataFrame]:
    """The tables of a nested document, a table of records per key."""
    doc = spark.read.option("multiLine", True).schema(", ".join(f"{k} array<struct<{v}>>" for k, v in schemas.items())).json(path)
    return {k: doc.select(F.inline(k)) for k in schemas}


def read_traces(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Stored traces, a folder per condition; for ``wanted`` (prompt_id, condition) pairs also those without a trace, with ``found`` false."""
    if not _exists(spark, path):
        traces = spark.createDataFrame([], "prompt_id string, condition string, generated_ids array<int>")
    else:
        traces = spark.read.parquet(path)
    if wanted is None:
        return traces
    return wanted.join(traces.withColumn("_f", F.lit(True)), ["prompt_id", "condition"], "left").withColumn("found", F.coalesce("_f", F.lit(False))).drop("_f")


def outcomes(detections: DataFrame) -> DataFrame:
    """(prompt_id, outcome): failure where the word is in the negative answer."""
    return detections.where("condition = 'negative'").select("prompt_id", F.when(F.col("word_present"), "failure").otherwise("success").alias("outcome"))


def read_idioms(spark: SparkSession, path: str) -> DataFrame:
    """(idiom, meaning) of a file whose rows are ``{idiom}>>{meaning}``, or two columns, or columns named by a header. Invalid idioms are left out.

    A header is a first row with a column whose name holds ``idiom``; that of the meaning holds ``meaning`` or ``definition``.
    """
    lines = spark.read.text(path)
    top = spark.read.csv(path).limit(1).collect()
    names = [(h or "").strip().lower() for h in top[0]] if top else []
    column = lambda *parts: next((i for i, h in enumerate(names) if any(p in h for p in parts)), None)
    if (at := column("idiom")) is not None:
        table = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        named = [F.col(f"`{c}`") for c in table.columns]
        second = named[i] if (i := column("meaning", "definition")) is not None else F.lit("")
        rows = table.select(F.trim(named[at]).alias("idiom"), F.trim(F.coalesce(second, F.lit(""))).alias("meaning"))
        return rows.where(text.valid_idiom(F.col("idiom")))
    pair = r"\{([^}]+)\}>>\{([^}]+)\}"
    cells = F.from_csv(F.col("value"), F.lit("a string, b string"))
    rows = lines.select(
        F.when(F.col("value").rlike(pair), F.regexp_extract("value", pair, 1)).otherwise(cells["a"]).alias("idiom"),
        F.when(F.col("value").rlike(pair), F.regexp_extract("value", pair, 2)).otherwise(F.coalesce(cells["b"], F.lit(""))).alias("meaning"),
    )
    rows = rows.select(F.trim("idiom").alias("idiom"), F.trim("meaning").alias("meaning"))
    return rows.where(text.valid_idiom(F.col("idiom")))


def read_scenarios(spark: SparkSession, path: str, n: int, least_words: int = 6) -> DataFrame:
    """``n`` scenario texts of at least six words from text or JSON lines; of a record the first of prompt, text, story, context that isn't empty."""
    if path.endswith((".json", ".jsonl")):
        fields = ("prompt", "text", "story", "context")
        rows = read_jsonl(spark, path, ", ".join(f"{f} string" for f in fields), placed=True)
        value = F.coalesce(*[F.nullif(F.trim(f), F.lit("")) for f in fields])
    else:
        rows, value = spark.read.text(path).select("value", file_place().alias("_pos")), F.trim("value")
    texts = rows.select(value.alias("scenario"), "_pos")
    return texts.where(F.size(F.split(text.blanks_to_one(F.col("scenario")), " ")) >= least_words).orderBy("_pos").limit(n).select("scenario")


def lexicon_targets(lexicon: DataFrame, n: int, low: float = 3.5, high: float = 6.0, top: int = 5000) -> DataFrame:
    """The ``n`` most common alphabetic words of three letters or more within the frequency band."""
    good = F.col("word").rlike(r"^\p{L}{3,}$") & F.col("zipf").between(low, high) & (F.col("word_rank") <= top)
    return lexicon.where(good).orderBy("word_rank").limit(n).select("word", "word_rank", "zipf")


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """(name, capitals, currencies, languages, continents) of a cached country list."""
    c = spark.read.option("multiLine", True).schema(COUNTRIES).json(path)
    return c.select(
        F.col("name.common").alias("name"),
        F.coalesce("capital", F.array().cast("array<string>")).alias("capitals"),
        F.array_sort(F.map_keys(F.coalesce("currencies", F.create_map().cast("map<string,struct<name:string>>")))).alias("currency_codes"),
        F.array_sort(F.map_values(F.coalesce("languages", F.create_map().cast("map<string,string>")))).alias("languages"),
        F.coalesce("continents", F.array().cast("array<string>")).alias("continents"),
    )


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(subject, relation, object, weight) of a graph dump."""
    return spark.read.schema(CONCEPT_EDGES).json(path)


def related(concepts: DataFrame, edges: DataFrame, relations: Sequence[str] = ("UsedFor", "MadeOf", "HasProperty"), most: int = 20) -> DataFrame:
    """(concept, relation, word) of each concept's ``most`` heaviest edges per relation that end in one English word."""
    hit = edges.where(F.col("relation").isin(*relations)).join(concepts.select(F.col("concept"), F.concat(F.lit("/c/en/"), F.lower("concept")).alias("subject")), "subject")
    first = F.row_number().over(Window.partitionBy("concept", "relation").orderBy(F.col("weight").desc(), F.col("object")))
    return hit.withColumn("_n", first).where(F.col("_n") <= most).select("concept", "relation", text.english_concept(F.col("object")).alias("word")).where("word is not null")


def triples(edges: DataFrame, predicate: str, most: int) -> DataFrame:
    """(subject, target) pairs of one predicate whose target is one alphabetic word, ``most`` of them by subject."""
    pairs = edges.where(F.col("predicate") == predicate).select("subject", F.col("object").alias("target"))
    return pairs.where(text.valid_target(F.col("target"))).dropDuplicates().orderBy("subject", "target").limit(most)


def two_hops(edges: DataFrame, first: str, second: str, most: int) -> DataFrame:
    """(subject, target) over an intermediate node, the ``most`` first of all pairs by subject and target.

    Before a pair over a node come all pairs of its subject with the node's smaller targets and of its target with the node's smaller
    subjects. So no node needs more than its ``most`` first subjects and targets, and a node with many of both isn't multiplied out.
    """
    first_of = lambda df, c: df.dropDuplicates().withColumn("_n", F.row_number().over(Window.partitionBy("via").orderBy(c))).where(F.col("_n") <= most).drop("_n")
    a = edges.where(F.col("predicate") == first).select("subject", F.col("object").alias("via")).where("via is not null")
    b = edges.where(F.col("predicate") == second).select(F.col("subject").alias("via"), F.col("object").alias("target")).where(F.col("via").isNotNull() & text.valid_target(F.col("target")))
    return first_of(a, "subject").join(first_of(b, "target"), "via").select("subject", "target").dropDuplicates().orderBy("subject", "target").limit(most)


def united_facts(*sources: tuple[str, DataFrame]) -> DataFrame:
    """(source, relation, subject, target) of all fact sources; of equal pairs of a relation the first source's stays."""
    rows = None
    for i, (name, df) in enumerate(sources):
        one = df.select(F.lit(i).alias("_p"), F.lit(name).alias("source"), "relation", "subject", "target")
        rows = one if rows is None else rows.unionByName(one)
    keys = [F.col("relation"), F.lower("subject"), F.lower("target")]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("_p", "subject", "target"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n", "_p")


def batch_responses(spark: SparkSession, path: str) -> DataFrame:
    """(custom_id, response, error) of a batch output; rows without id are left out, the last of an id stays."""
    rows = read_jsonl(spark, path, "custom_id string, response string, error string", placed=True).where("custom_id is not null")
    return last_by_place(rows, ["custom_id"]).select("custom_id", "response", "error")


def latest_run(spark: SparkSession, root: str | None, base: str = "outputs", prefix: str = "experiment_run_") -> str:
    """The folder of a run: ``root`` if it is one, else the run of largest name below it, else ``root`` itself; without ``root`` the same below ``base``."""
    folder = base if root is None else root
    if root is not None and root.rstrip("/").rsplit("/", 1)[-1].startswith(prefix):
        return root
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []
    runs = [n for n in names if n.startswith(prefix)]
    return f"{folder.rstrip('/')}/{max(runs)}" if runs else folder


def latest_run_rows(df: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Rows of the run of largest id, by a scalar subquery that prunes partitions."""
    return df.where(F.col(run_col) == df.agg(F.max(run_col)).scalar())


def message_text(response: str = "response") -> Column:
    """The answer's text in any of the layouts a batch response may have; null if there is none."""
    paths = ("$.body.output_text", "$.output_text", "$.body.output[0].content[0].text", "$.output[0].content[0].text", "$.body.choices[0].message.content", "$.choices[0].message.content")
    return F.coalesce(*[F.nullif(F.get_json_object(response, p), F.lit("")) for p in paths])
