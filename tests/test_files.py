import json

import pytest
from pyspark.sql import functions as F

from kilnspark.sinks import writers
from kilnspark.sources import readers
from kilnspark.streaming import resume


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_prompts_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("7", 'two\nlines, "quoted"', "cup", 0.5)], "prompt_id string, question_text string, target_word string, p0 double")
    writers.write_csv(df, str(tmp_path / "p"), df.columns)
    got = readers.read_prompts(spark, str(tmp_path / "p"))
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in df.collect()] and dict(got.dtypes)["prompt_id"] == "string"
    with pytest.raises(FileNotFoundError):
        readers.read_prompts(spark, str(tmp_path / "absent"))
    with pytest.raises(ValueError, match="category"):
        readers.read_csv(spark, str(tmp_path / "p"), ["category"])


def test_jsonl(spark, tmp_path):
    p = lines(tmp_path / "a.jsonl", [{"prompt_id": "a", "p_sem": 0.5}, "", "{broken", {"prompt_id": None, "p_sem": 1}, {"prompt_id": "b"}])
    assert readers.read_jsonl(spark, p, "prompt_id string, p_sem double").count() == 3
    assert readers.read_jsonl(spark, p, "prompt_id string", keep_bad=True).where("_corrupt is not null").count() == 1
    assert [tuple(r) for r in readers.read_checkpoint(spark, p).drop("_pos").collect()] == [("a", 0.5)]
    assert readers.read_jsonl(spark, str(tmp_path / "no.jsonl"), "x int").count() == 0


def test_detections(spark, tmp_path):
    rows = [
        {"prompt_id": "a", "condition": "negative", "sample_id": "", "word_present": False},
        {"prompt_id": "a", "condition": "negative", "sample_id": "", "word_present": True},
        {"prompt_id": "a", "condition": "negative", "sample_id": "3", "word_present": False},
        {"prompt_id": "b", "condition": "negative", "word_present": False},
        {"prompt_id": "b", "condition": "baseline", "word_present": True},
    ]
    d = readers.read_detection(spark, [str(tmp_path / "no.jsonl"), lines(tmp_path / "d.jsonl", rows)], "prompt_id string, condition string, sample_id string, word_present boolean")
    assert {tuple(r) for r in readers.outcomes(d).collect()} == {("a", "failure"), ("b", "success")}


@pytest.mark.parametrize("form", [["idiom,meaning", "break the ice,start", "two words,x"], ["{break the ice}>>{start}"], ["break the ice,start"]])
def test_idioms_in_any_format(spark, tmp_path, form):
    assert [tuple(r) for r in readers.read_idioms(spark, lines(tmp_path / "i.csv", form)).collect()] == [("break the ice", "start")]


def test_scenarios(spark, tmp_path):
    a = lines(tmp_path / "s.jsonl", [{"prompt": "", "text": "one two three four five six"}, {"story": "too short"}, {"context": "a b c d e f g"}])
    assert [r[0] for r in readers.read_scenarios(spark, a, 5).collect()] == ["one two three four five six", "a b c d e f g"]
    assert readers.read_scenarios(spark, lines(tmp_path / "s.txt", ["one two three four five six", "", "x"]), 1).count() == 1


def test_countries_and_edges(spark, tmp_path):
    c = tmp_path / "c.json"
    c.write_text(json.dumps([{"name": {"common": "Norway"}, "capital": ["Oslo"], "currencies": {"NOK": {"name": "krone"}}, "languages": {"nor": "Norwegian"}, "continents": ["Europe"]}, {"name": {"common": "X"}}]))
    got = {r["name"]: r for r in readers.read_countries(spark, str(c)).collect()}
    assert got["Norway"]["currency_codes"] == ["NOK"] and got["X"]["capitals"] == [] and got["X"]["languages"] == []
    e = readers.read_edges(spark, lines(tmp_path / "e.jsonl", [{"subject": "/c/en/cup", "relation": "UsedFor", "object": "/c/en/drinking", "weight": 2}, {"subject": "/c/en/cup", "relation": "UsedFor", "object": "/c/de/trinken", "weight": 3}, {"subject": "/c/en/cup", "relation": "Other", "object": "/c/en/x", "weight": 1}]))
    assert [tuple(r) for r in readers.related(spark.createDataFrame([("Cup",)], "concept string"), e).collect()] == [("Cup", "UsedFor", "drinking")]


def test_triples_and_union(spark):
    e = spark.createDataFrame([("Norway", "P36", "Oslo"), ("Brazil", "P36", "Sao Paulo"), ("Ann", "P27", "Norway"), ("Norway", "P1549", "Norwegian")], "subject string, predicate string, object string")
    assert [tuple(r) for r in readers.triples(e, "P36", 10).collect()] == [("Norway", "Oslo")]
    assert [tuple(r) for r in readers.two_hops(e, "P27", "P1549", 10).collect()] == [("Ann", "Norwegian")]
    a = spark.createDataFrame([("capital", "Norway", "Oslo")], "relation string, subject string, target string")
    b = spark.createDataFrame([("capital", "NORWAY", "oslo"), ("capital", "Chad", "Ndjamena")], a.schema)
    assert sorted((r["source"], r["subject"]) for r in readers.united_facts(("one", a), ("two", b)).collect()) == [("one", "Norway"), ("two", "Chad")]


def join_rows(df):
    """Rows that each join of a collected query gave."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name.endswith("Join"):
            found.append(p.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(p.plan())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_two_hops_over_hubs(spark):
    word = lambda i: "".join(chr(97 + int(d)) for d in f"{i:03}")
    rows = [(word(i), "at", f"hub{i % 2}") for i in range(300)] + [("aaa", "at", "hub1"), (word(7), "at", "lone"), ("A", "at", "dead"), ("B", "at", "none"), ("C", "at", None), (None, "at", "lone")]
    rows += [(f"hub{i % 2}", "has", word(999 - i)) for i in range(300)] + [("hub0", "has", "x1"), ("hub0", "has", "A b"), ("dead", "has", "7"), (None, "has", "zz"), ("lone", "has", "end"), ("lone", "has", None), ("hub1", "has", "'end'")]
    rows += rows[::3]
    e = spark.createDataFrame(rows, "subject string, predicate string, object string")
    good = lambda t: t is not None and t.strip(" ").strip(".,!?;:\"'-").isalpha()
    pairs = {(s, t) for s, p, v in rows if p == "at" and v is not None for w, q, t in rows if q == "has" and w == v and good(t)}
    want = sorted(pairs, key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    for most in (1, 5, 160, 40_000, 90_000):
        got = readers.two_hops(e, "at", "has", most)
        assert [tuple(r) for r in got.collect()] == want[:most]
        assert 0 < sum(join_rows(got)) <= 3 * most * most  # three nodes reach a target; none is multiplied out beyond what is wanted


def test_batches(spark, tmp_path):
    p = lines(tmp_path / "b.jsonl", [{"custom_id": "x", "response": {"body": {"choices": [{"message": {"content": "old"}}]}}}, {"custom_id": "x", "response": {"body": {"output_text": "new"}}}, {"response": {}}, {"custom_id": "y", "error": "bad"}])
    got = {r["custom_id"]: (r["t"], r["error"]) for r in readers.batch_responses(spark, p).select("custom_id", readers.message_text().alias("t"), "error").collect()}
    assert got == {"x": ("new", None), "y": (None, "bad")}
    req = spark.range(1).select(writers.batch_request(F.lit("id1"), F.lit("sys"), F.lit("usr"), "m").alias("r")).first()["r"]
    assert json.loads(req)["body"]["input"][1] == {"role": "user", "content": "usr"}


def test_latest_run(tmp_path, spark):
    for n in ("experiment_run_20250101_0000", "experiment_run_20250301_0000", "other"):
        (tmp_path / n).mkdir()
    assert readers.latest_run(spark, str(tmp_path)).endswith("20250301_0000")
    assert readers.latest_run(spark, str(tmp_path / "other")) == str(tmp_path / "other")
    assert readers.latest_run(spark, None, str(tmp_path)).endswith("20250301_0000")
    assert readers.latest_run(spark, f"{tmp_path}/experiment_run_0") == f"{tmp_path}/experiment_run_0"
    df = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, v int")
    assert [r["v"] for r in readers.latest_run_rows(df).collect()] == [2]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("facts", "a"), ("ood", "b"), (None, "c")], "category string, v string")
    writers.write_by_category(df, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).count() == 3
    writers.write_jsonl(df, str(tmp_path / "j"))
    writers.write_jsonl(df, str(tmp_path / "j"), append=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 6
    assert writers.content_hash(df).first() == writers.content_hash(df.repartition(3)).first() != writers.content_hash(df.limit(2)).first()
    assert writers.content_hash(df.limit(0)).first()["n_rows"] == 0
    assert writers.counts_map(df, "category").first()["counts"] == {"": 1, "facts": 1, "ood": 1}
    assert json.loads(writers.nested_tables(t=df.where("category is not null")).first()[0])["t"][0] == {"category": "facts", "v": "a"}
    bad = spark.createDataFrame([(True,), (False,), (None,)], "mapping_error boolean")
    with pytest.raises(RuntimeError, match="1 of 3"):
        writers.check_halt(bad, "mapping_error")
    assert writers.check_halt(bad, "mapping_error", most=1).count() == 3


def test_stream_adds_each_key_once(spark, tmp_path):
    src, sink, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    schema = "prompt_id string, sample_id string, pos int"
    lines(src / "1.json", [{"prompt_id": "a", "sample_id": "0", "pos": 1}, {"prompt_id": "a", "sample_id": "0", "pos": 2}, {"prompt_id": "b", "sample_id": "0", "pos": 3}])
    run = lambda s: resume.resume_stream(spark, str(src), schema, sink, ["prompt_id", "sample_id"], "pos", s)
    run(state)
    lines(src / "2.json", [{"prompt_id": "b", "sample_id": "0", "pos": 4}, {"prompt_id": "b", "sample_id": "1", "pos": 5}])
    run(state)
    run(str(tmp_path / "lost"))  # a lost checkpoint replays everything and adds nothing
    assert sorted((r["prompt_id"], r["sample_id"], r["pos"]) for r in spark.read.parquet(sink).collect()) == [("a", "0", 1), ("b", "0", 3), ("b", "1", 5)]


def test_recovery(spark):
    done = spark.createDataFrame([("a", "baseline", "stop")], "prompt_id string, condition string, finish_reason string")
    traces = spark.createDataFrame([("a", "baseline"), ("a", "negative")], "prompt_id string, condition string")
    assert sorted((r["condition"], r["finish_reason"]) for r in resume.recovered(traces, done).collect()) == [("baseline", "stop"), ("negative", "unknown")]
