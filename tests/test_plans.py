"""Whole plans, files and streams on small hand-made records."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from retort import constants as K
from retort import schemas
from retort.functions import scoring
from retort.operators import records
from retort.plans import answers, training, translation
from retort.queries import files as file_queries
from retort.sources import files, sinks
from retort.streaming import resume


def inference(spark, *rows):
    """Records from dicts, through the declared JSON schema."""
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    parsed = lines.select(F.from_json("value", schemas.INFERENCE.replace("prompt VARIANT", "prompt STRING")).alias("r"))
    return parsed.select("r.*").withColumn("prompt", F.try_parse_json("prompt"))


def record(**fields):
    base = {
        "task": K.BOOL_TASKS[0],
        "sample_id": "s1",
        "ground_truth": "Yes",
        "prompt": json.dumps([{"role": "user", "content": "q"}]),
        "generated": {},
        "extracted_core_answer": {},
    }
    return base | fields


def test_tag_hit_keeps_the_stored_answer(spark):
    df = inference(spark, record(generated={"generation1": "<BOOLEAN>Yes</BOOLEAN>"}, extracted_core_answer={"generation1": "old"}))
    row = answers.answer_booleans(df).first()
    assert row[answers.ANSWER] == {"generation1": "old"} and row[answers.CORRECT] == {"generation1": False}
    assert row[answers.STRATEGY] == {"generation1": None}
    fixed = answers.answer_booleans(df, keep_tag_hits=False).first()
    assert fixed[answers.ANSWER] == {"generation1": "Yes"} and fixed[answers.CORRECT] == {"generation1": True}


def test_other_tasks_pass_through(spark):
    df = inference(spark, record(task="retrosynthesis", generated={"generation1": "**yes**"}, extracted_core_answer={"generation1": ""}))
    row = answers.answer_booleans(df).first()
    assert row[answers.ANSWER] == {"generation1": ""} and row[answers.CORRECT] is None


def test_stored_numbers_are_kept_and_missing_texts_are_empty(spark):
    df = inference(
        spark,
        record(task=K.NUM_TASKS[0], ground_truth="2", generated={"generation1": "9"}, extracted_core_answer={"generation1": "1.5", "generation2": ""}),
    )
    row = answers.answer_numbers(df).first()
    assert row[answers.ANSWER] == {"generation1": "1.5", "generation2": ""}
    assert row[answers.CORRECT] == {"generation1": True, "generation2": False}


def test_accuracy_can_pass_hundred(spark):
    three = {f"generation{i}": "**yes**" for i in (1, 2, 3)}
    df = answers.answer_booleans(inference(spark, record(generated=three, extracted_core_answer=dict.fromkeys(three, ""))))
    report = answers.extraction_report(df, K.BOOL_TASKS).first()
    assert (report["accuracy"], report["correct_rate"], report["extracted"]) == (300.0, 100.0, 3)


def test_captions_and_rethreshold(spark):
    df = inference(
        spark,
        record(task=K.CAPTION_TASK, ground_truth="a b", generated={"generation1": "x</THINK> a b", "generation2": "a b"}),
        record(task="retrosynthesis"),
    )
    done = answers.answer_captions(df, scoring.meteor_scores(), 0.4)
    row = done.filter(F.col("task") == K.CAPTION_TASK).first()
    assert row[answers.CORRECT] == {"generation1": True, "generation2": False}
    assert row["caption_score"]["generation2"] is None
    again = answers.rethreshold(done, 0.95).filter(F.col("task") == K.CAPTION_TASK).first()
    assert again[answers.CORRECT] == {"generation1": False, "generation2": False}
    plain = answers.answer_captions(df, scoring.meteor_scores(), 0.4, enable_thinking=False)
    assert plain.filter(F.col("task") == K.CAPTION_TASK).first()[answers.CORRECT]["generation2"] is True


def test_selection_variants(spark):
    texts = {"generation1": "", "generation2": "no tags", "generation3": "why</think>so"}
    row = record(generated=texts) | {"extracted_core_answer_correctness": dict.fromkeys(texts, True)}
    df = inference(spark, row)
    strict = training.training_records(training.candidates(df)).first()
    assert strict["messages"][1]["content"] == "<think> why</think>so" and strict["messages"][0]["content"] == "q"
    loose = training.candidates(df, think_rules=False).first()
    assert [c["key"] for c in loose["candidates"]] == list(texts)
    unprompted = inference(spark, row | {"prompt": "[]"})
    assert training.training_records(training.candidates(unprompted)).count() == 0


def translations(spark, *rows):
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    ddl = schemas.TRANSLATION.replace("prompt VARIANT, ", "")
    return lines.select(F.from_json("value", ddl).alias("r")).select("r.*")


def test_translation_scoring_repair_and_share(spark):
    df = translations(
        spark,
        {"sample_idx": 0, "sample_id": "a", "user_content": "u", "gold_answer": "x y", "generated": {"generation1": "t</think>x y", "generation2": "</think>"}, "extracted_translation": {"generation1": "x z", "generation2": "x y"}},
        {"sample_idx": 1, "sample_id": "b", "user_content": "u", "gold_answer": "x", "generated": {"generation1": "<think>"}, "extracted_translation": {}},
        {"sample_idx": 2, "sample_id": "c", "user_content": "u", "gold_answer": "x", "generated": {}, "spbleu": {"generation1": 5.0}, "best_spbleu": 5.0, "best_generation_key": "generation1"},
    )
    scored = translation.scored(df, scoring.bleu_scores("whitespace"))
    first = {r["sample_id"]: r for r in scored.collect()}
    assert first["a"]["best_generation_key"] == "generation2" and first["a"]["best_spbleu"] == 100.0
    assert (first["b"]["best_spbleu"], first["b"]["best_generation_key"], first["b"]["spbleu"]) == (0.0, None, {})
    assert first["c"]["spbleu"] == {"generation1": 5.0}
    checked = translation.think_checked(scored)
    rows = {r["sample_id"]: r for r in checked.collect()}
    # the best translation has no valid tags, so the repaired other one is best
    assert rows["a"]["best_generation_key"] == "generation1" and rows["a"]["generated"]["generation1"] == "<think>\nt</think>x y"
    assert (rows["b"]["best_spbleu"], rows["b"]["think_tag_valid"]) == (-1.0, False)
    # a record without generations is never marked invalid
    assert rows["c"]["think_tag_valid"] is None and translation.valid_records(checked).count() == 2
    kept = translation.top_share(checked, 0.4, "sample_idx")
    assert [r["sample_id"] for r in kept.collect()] == ["a"]
    assert translation.top_share(checked, 1.0, "sample_idx").count() == 2
    chat = translation.chats(kept, "sys").first()["messages"]
    assert [m["role"] for m in chat] == ["system", "user", "assistant"]


def test_first_key_wins_ties(spark):
    df = spark.sql("SELECT map('b', 1.0D, 'a', 1.0D, 'c', 0.5D) AS m, map() AS e")
    assert df.select(records.best_key(F.col("m"))["key"]).first()[0] == "b"


def test_prompt_without_answer_turn(spark):
    df = spark.createDataFrame([("s", "in")], "task string, input string")
    prompt = records.generation_prompt(F.col("input"), "oracle", {"oracle": "S"}, F.lit("truth"), ("<", ">"))
    assert json.loads(df.select(prompt).first()[0]) == [
        {"role": "system", "content": "S"},
        {"role": "user", "content": [{"type": "text", "text": "in<truth>"}]},
    ]
    with pytest.raises(ValueError):
        records.generation_prompt(F.col("input"), "nope", {})


# --- files ------------------------------------------------------------------------


def put(folder, name, body):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body, encoding="utf-8")
    return str(path)


def test_strict_lenient_and_raw_reads(spark, tmp_path):
    good = '{"task": "a", "sample_id": "1"}'
    path = put(tmp_path, "x.jsonl", f"{good}\n\n  \n{{bad\n{good}\n")
    kept, bad = files.read_jsonl_lenient(spark, path, schemas.SOURCE)
    assert kept.count() == 2 and [r[0] for r in bad.collect()] == ["{bad"]
    with pytest.raises(Exception):
        files.read_jsonl(spark, path, schemas.SOURCE).collect()
    lines = files.parsed_lines(files.read_lines(spark, path))
    assert sorted((r["value"], r["record"] is None) for r in lines.collect()) == [(good, False), (good, False), ("{bad", True)]
    assert [(r["line_number"], r["value"]) for r in files.bad_lines(spark, path).collect()] == [(4, "{bad")]


def test_map_key_order_and_absent_keys(spark, tmp_path):
    path = put(tmp_path, "m.jsonl", '{"sample_id": "1", "generated": {"generation2": "x", "generation1": null}}\n')
    row = files.read_jsonl(spark, path, schemas.INFERENCE).select("*", F.map_keys("generated").alias("keys")).first()
    assert row["keys"] == ["generation2", "generation1"] and row["generated"]["generation1"] is None
    assert row["extracted_core_answer"] is None


def test_line_numbers_over_many_blocks(spark, tmp_path):
    path = put(tmp_path, "big.txt", "".join(f"line {i}\n" for i in range(1, 4001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = files.with_line_numbers(files.with_source(spark.read.text(path))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 4000 and all(r["value"] == f"line {r['line_number']}" for r in rows)


def test_json_formats(spark, tmp_path):
    cases = {
        "a.json": ('[{"task": "a"}]', "json_array", 1),
        "b.json": ('{"task": "a"}\n{"task": "b"}\n', "jsonl", 2),
        "c.json": (' [\n{"task": "a"},\n{"task": "b"}]', "json_array", 2),
        "d.json": ('{"task": "a"}\nbad\n', "jsonl", 1),
    }
    for name, (body, kind, n) in cases.items():
        path = put(tmp_path, name, body)
        assert files.json_format(spark, path) == kind, name
        assert files.read_json(spark, path, schemas.SOURCE).count() == n, name


def test_discovery(spark, tmp_path):
    for name in ("r/a/x_postprocessed.jsonl", "r/a/b/y.jsonl", "r/c/d/z.jsonl", "r/c/d/w_postprocessed_METEOR0.40.jsonl"):
        put(tmp_path, name, "{}\n")
    root = f"file:{tmp_path}/r"
    found = files.list_files(spark, root, "*.jsonl")
    assert found.count() == 4
    folders = sorted(r["folder"].split("/r/")[1] for r in files.nearest_folders(found, root).collect())
    assert folders == ["a", "c/d"]
    assert files.postprocessed_file(spark, f"{root}/c/d").endswith("METEOR0.40.jsonl")


def test_small_readers(spark, tmp_path):
    csv = put(tmp_path, "s.csv", "lang,score\nhu , 1.5\nvi,\nxx,3\n")
    assert [(r["lang"], r["score"].strip()) for r in files.read_scores(spark, csv).collect()] == [("hu ", "1.5"), ("vi", ""), ("xx", "3")]
    tokens = put(tmp_path, "t/esol.jsonl", '{"sample_id": "1"}\n{"sample_id": "2", "task": "own"}\n')
    assert sorted(r["task"] for r in files.read_tokens(spark, tokens, schemas.TOKENS).collect()) == ["esol", "own"]
    report = put(tmp_path, "r.txt", "Model:\nesol:\n  Avg Probability:  0.5\n  Avg Rank: 3.25\n  Samples: 7\nlipo:\n  Avg Rank: 2\n")
    rows = {r["task"]: r for r in files.read_summary(spark, report).collect()}
    assert (rows["esol"]["avg_prob"], rows["esol"]["avg_rank"], rows["esol"]["n_samples"]) == (0.5, 3.25, 7)
    assert (rows["lipo"]["avg_prob"], rows["lipo"]["avg_rank"]) == (None, 2.0)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a/b c", "é", None), ("d", "x", 1)], "task string, t string, n int")
    sinks.write_by_task(df, str(tmp_path / "tasks"))
    assert sorted(p.name for p in (tmp_path / "tasks").iterdir() if p.is_dir()) == ["task_file=a_b_c", "task_file=d"]
    body = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "tasks/task_file=a_b_c").glob("*.txt"))
    assert body == '{"task":"a/b c","t":"é","n":null}\n'
    with pytest.raises(Exception):  # an existing folder is never overwritten
        sinks.write_jsonl(df, str(tmp_path / "tasks"))
    sinks.write_jsonl(spark.range(25).coalesce(1), str(tmp_path / "parts"), max_records=10)
    assert len(list((tmp_path / "parts").glob("*.txt"))) == 3
    sinks.write_sorted(df.withColumnRenamed("n", "sample_idx"), str(tmp_path / "sorted"))
    for name, frame in (("array", df.repartition(2)), ("none", df.limit(0))):
        sinks.write_json_array(frame, str(tmp_path / name), "task")
        parts = sorted((tmp_path / name).glob("part-*.txt"))
        array = json.loads("".join(p.read_text(encoding="utf-8") for p in parts))
        assert array == [{"task": "a/b c", "t": "é", "n": None}, {"task": "d", "t": "x", "n": 1}][: frame.count()]
    lines = [r["value"] for r in sinks.report_lines(df, "Report", ["task"]).collect()]
    assert "Report" in lines[0] and lines[1:3] == ["  task=a/b c  t=é  n=None", "  task=d  t=x  n=1"]
    register = str(tmp_path / "reg/info.json")
    for target in ("one.jsonl", "two.jsonl"):
        sinks.register_dataset(register, "set", target)
    assert json.load(open(register))["set"]["file_name"] == "two.jsonl"


# --- streams ----------------------------------------------------------------------


def test_stream_answers_each_request_once(spark, tmp_path):
    inbox, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    asked = []

    def answer(todo):
        asked.extend(r["sample_id"] for r in todo.collect())
        return todo.select("sample_id", F.upper("q").alias("a"))

    def feed(*rows):
        spark.createDataFrame(rows, "sample_id string, q string").write.mode("append").json(inbox)
        stream = spark.readStream.schema("sample_id string, q string").json(inbox)
        resume.answer_stream(stream, answer, out, marks, "sample_id STRING, a STRING").awaitTermination()

    feed(("1", "x"), ("2", "y"))
    feed(("2", "again"), ("3", "z"))
    assert sorted(asked) == ["1", "2", "3"]
    done = resume.stored_results(spark, out, "sample_id STRING, a STRING")
    assert sorted(tuple(r) for r in done.collect()) == [("1", "X"), ("2", "Y"), ("3", "Z")]


def test_only_unscored_records_are_scored(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "sample_id string, spbleu double")
    out = resume.score_new(df, lambda d: d.withColumn("spbleu", F.lit(2.0)))
    assert sorted(tuple(r) for r in out.collect()) == [("a", 1.0), ("b", 2.0)]


def test_files_of_a_language_have_many_writers(spark, tmp_path, monkeypatch):
    """A language is written by several tasks, and counts and line numbers go over all its files."""
    rows = [(i, "en" if i % 5 else "fr", "web", f"text {i}") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    frame.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(file_queries, "_fresh", lambda _, name: str(tmp_path / name))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        report = file_queries.bad_line_report(spark, str(tmp_path)).select("doc_id", "line_number").collect()
        outcomes = file_queries.file_outcomes(spark, str(tmp_path)).select("lang", "n_good", "n_bad", "failed").collect()
    finally:
        spark.conf.set(key, before)
    numbers = {}
    for lang in ("en", "fr"):
        numbers |= {r[0]: k for k, r in enumerate((r for r in rows if r[1] == lang), 1)}
    assert sorted(tuple(r) for r in report) == [(i, numbers[i]) for i in range(400) if i % 7 == 3]
    bad = {lang: sum(r[1] == lang and r[0] % 7 == 3 for r in rows) for lang in ("en", "fr")}
    assert sorted(tuple(r) for r in outcomes) == [("en", 320 - bad["en"], bad["en"], True), ("fr", 80 - bad["fr"], bad["fr"], True)]
    for name in ("report", "outcomes"):
        assert len(list((tmp_path / name / "lang=en").glob("part-*"))) > 1


def test_share_summary_derives_scores_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def derived(x):
        seen.add(1)
        return float(x % 7)

    rows = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 3 != 0).alias("think_tag_valid"), derived("id").alias("best_spbleu"))
    want = translation.share_report(rows, translation.top_share(rows, 0.2, "doc_id")).orderBy("part").collect()
    seen.value = 0
    assert translation.share_summary(rows, 0.2, "doc_id").orderBy("part").collect() == want
    assert seen.value == 100


def test_requests_move_once(spark, tmp_path):
    inbox, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    schema, plans = "sample_id STRING, a STRING", []

    def answer(todo):
        plans.append(todo._jdf.queryExecution().executedPlan().toString())
        return todo.select("sample_id", F.upper("q").alias("a"))

    for rows in ([("1", "x"), ("2", "y"), ("2", "y")], [("2", "again"), ("3", "z"), (None, "n")], [("3", "z")]):
        spark.createDataFrame(rows, "sample_id string, q string").write.mode("append").json(inbox)
        stream = spark.readStream.schema("sample_id string, q string").json(inbox)
        resume.answer_stream(stream, answer, out, marks, schema).awaitTermination()
    assert [p.count("Exchange hashpartitioning") for p in plans] == [1, 1, 1] and not any("Join" in p for p in plans)
    stored = spark.read.schema(schema).parquet(out).select("sample_id", "a")
    assert sorted((tuple(r) for r in stored.collect()), key=repr) == [("1", "X"), ("2", "Y"), ("3", "Z"), (None, "N")]
    done = resume.stored_results(spark, out, schema, F.length("a").alias("n"))
    assert done.columns == ["sample_id", "n"] and sorted(tuple(r) for r in done.collect()) == [("1", 1), ("2", 1), ("3", 1)]


def test_array_lines_are_put_together_in_small_pieces():
    lines = [json.dumps({"k": k, "text": "é" * 10}) for k in range(1000)]
    batches = [pa.RecordBatch.from_pydict({"value": pa.array(part, pa.string())}) for part in ([], lines[:700], lines[700:])]
    made = list(file_queries._as_array(iter(batches)))
    assert json.loads("\n".join(v for b in made for v in b.column(0).to_pylist())) == [json.loads(line) for line in lines]
    assert max(b.num_rows for b in made) <= 256
