"""Queries that go through files and streams in the session's shared folder."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from retort import schemas
from retort.operators import records
from retort.queries import views
from retort.queries.registry import query, table
from retort.session import shared_dir
from retort.operators.stored import with_ordinals
from retort.sources import catalogue, files, sinks, splits, versions
from retort.streaming import resume


def _fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT 's' || doc_id AS sample_id, source AS task, md5(text) AS input_md5, lang AS output FROM documents")
def jsonl_round_trip(spark, sf_dir):
    """Write documents as JSONL per task and read them back with a declared schema."""
    path = _fresh(spark, "jsonl")
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("task"), F.concat(F.lit("s"), "doc_id").alias("sample_id"), F.col("text").alias("input"), F.col("lang").alias("output")
    )
    sinks.write_by_task(docs, path)
    back = files.read_jsonl(spark, path, schemas.SOURCE, recursive=True)
    return back.select("sample_id", "task", F.md5("input").alias("input_md5"), "output")


@query("SELECT doc_id, doc_id % 7 = 3 AS broken, true AS numbered FROM documents")
def jsonl_bad_lines(spark, sf_dir):
    """Every seventh line is broken; all lines come back with their place and a verdict."""
    path = _fresh(spark, "lines")
    docs = table(spark, sf_dir, "documents")
    good = sinks.json_line(docs)
    line = F.when(F.col("doc_id") % 7 == 3, F.concat(F.lit("{"), good)).otherwise(good)
    sinks.write_lines(docs.select(line.alias("value")), path)
    lines = files.parsed_lines(files.with_line_numbers(files.read_lines(spark, path)))
    number = F.regexp_extract("value", r'"doc_id":([0-9]+)', 1).cast("bigint")
    return lines.select(
        number.alias("doc_id"),
        F.col("record").isNull().alias("broken"),
        (F.col("line_number") >= 1).alias("numbered"),
    )


@query(
    "SELECT doc_id, md5('{' || source || '|' || text) AS line_md5, "
    "1 + count(*) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS line_number "
    "FROM documents QUALIFY doc_id % 7 = 3"
)
def bad_line_report(spark, sf_dir):
    """Bad lines verbatim with their number among the lines of their language, over its files in order."""
    path = _fresh(spark, "report")
    docs = table(spark, sf_dir, "documents")
    line = F.to_json(F.struct("doc_id", "source", "text"))
    broken = F.when(F.col("doc_id") % 7 == 3, F.concat(F.lit("{"), line)).otherwise(line)
    ordered = docs.select("lang", "doc_id", broken.alias("value")).repartitionByRange("lang", "doc_id").sortWithinPartitions("lang", "doc_id")
    ordered.select("lang", "value").write.partitionBy("lang").text(path)
    folder = F.regexp_extract("file_path", "^(.*)/", 1)
    sizes = files.with_source(spark.read.text(path)).groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    # files are named by range; one row per file
    before = Window.partitionBy(folder).orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file_path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    found = files.bad_lines(spark, path).join(F.broadcast(offsets), "file_path").withColumn("line_number", F.col("line_number") + F.col("offset"))
    record = F.parse_json(F.substring("value", F.lit(2), F.length("value")))
    at = lambda name, kind: F.variant_get(record, f"$.{name}", kind)
    told = F.md5(F.concat(F.lit("{"), at("source", "string"), F.lit("|"), at("text", "string")))
    return found.select(at("doc_id", "bigint").alias("doc_id"), told.alias("line_md5"), "line_number")


@query(
    "SELECT lang, count_if(doc_id % 7 <> 3)::bigint AS n_good, count_if(doc_id % 7 = 3)::bigint AS n_bad, count_if(doc_id % 7 = 3) > 0 AS failed FROM documents GROUP BY lang"
)
def file_outcomes(spark, sf_dir):
    """A job over many files: good and bad lines of each, failures counted instead of raised."""
    path = _fresh(spark, "outcomes")
    docs = table(spark, sf_dir, "documents")
    line = F.to_json(F.struct("doc_id", "text"))
    broken = F.when(F.col("doc_id") % 7 == 3, F.concat(F.lit("{"), line)).otherwise(line)
    docs.select("lang", broken.alias("value")).write.partitionBy("lang").text(path)
    counts = files.file_outcomes(files.parsed_lines(files.read_lines(spark, path, recursive=True)))
    lang = F.regexp_extract("file_path", "lang=([a-z]+)/", 1)
    return counts.groupBy(lang.alias("lang")).agg(F.sum("n_good").alias("n_good"), F.sum("n_bad").alias("n_bad"), F.bool_or("failed").alias("failed"))


@query("SELECT doc_id, source, md5(text) AS text_md5 FROM documents")
def json_array_round_trip(spark, sf_dir):
    """Documents as one JSON array over part files, written by the executors and read again."""
    path = _fresh(spark, "array")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sinks.write_json_array(docs, path, "doc_id")
    lines = files.read_lines(spark, path).filter(~F.col("value").isin("[", "]"))
    record = F.parse_json(F.substring("value", F.lit(3), F.length("value")))
    at = lambda name, kind: F.variant_get(record, f"$.{name}", kind)
    return lines.select(at("doc_id", "bigint").alias("doc_id"), at("source", "string").alias("source"), F.md5(at("text", "string")).alias("text_md5"))


@query(
    "SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN lang END AS file_lang FROM documents"
)
def language_of_name(spark, sf_dir):
    """Language code out of file names of both directions, and of names without one."""
    docs, lang, k = table(spark, sf_dir, "documents"), F.col("lang"), F.col("doc_id") % 4
    name = (
        F.when(k == 0, F.concat(F.lit("part_en2"), lang, F.lit("_01")))
        .when(k == 1, F.concat(F.lit("01-"), lang, F.lit("2en.out")))
        .when(k == 2, F.concat(F.lit("en2"), lang))
        .otherwise(F.concat(F.lit("plain_"), lang))
    )
    return docs.select("doc_id", records.language_of_name(name).alias("file_lang"))


@query(
    views.TRANSLATION_SQL
    + f"SELECT sample_id, md5({'string_agg(gtext, chr(10) ORDER BY gen)'}) AS answers_md5, 1::bigint AS n_stored FROM g GROUP BY sample_id"
)
def stream_resume(spark, sf_dir):
    """Requests arrive as files in two waves, the second repeating some; a stream answers each once."""
    inbox, results, marks = (_fresh(spark, n) for n in ("inbox", "results", "marks"))
    requests = views.translation_records(spark, sf_dir).select("sample_id", "generated")
    schema = "sample_id STRING, answers STRING"
    wave = F.pmod(F.xxhash64("sample_id"), F.lit(3))

    def answer(todo):
        joined = F.array_join(F.map_values("generated"), "\n")
        return todo.select("sample_id", joined.alias("answers"))

    for arrived in (wave < 2, wave > 0, None):  # at last nothing new
        if arrived is not None:
            requests.filter(arrived).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(requests.schema).parquet(inbox)
        resume.answer_stream(stream, answer, results, marks, schema).awaitTermination()
    done = resume.stored_results(spark, results, schema, F.md5("answers").alias("answers_md5"))
    stored_rows = spark.read.schema(schema).parquet(results).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_stored"))
    return done.join(stored_rows, "sample_id").select("sample_id", "answers_md5", "n_stored")


@query(
    "SELECT source, count(*)::bigint AS n_rows, count_if(doc_id % 97 = 1)::bigint AS n_changed, CASE WHEN count_if(doc_id % 97 = 1) > 0 THEN 2 ELSE 1 END AS version, "
    "sum(length(CASE WHEN doc_id % 97 = 1 THEN text || ' (revised)' ELSE text END))::bigint AS n_chars FROM documents GROUP BY source"
)
def changed_partitions(spark, sf_dir):
    """A second version rewrites only the sources that hold changed records; the others keep their files."""
    path = _fresh(spark, "versions")
    docs, schema = table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id BIGINT, source STRING, text STRING"
    versions.commit_changes(docs, path, "source")
    changed = F.col("doc_id") % 97 == 1
    first = versions.read_version(spark, path, schema)
    revised = first.withColumn("text", F.when(changed, F.concat("text", F.lit(" (revised)"))).otherwise(F.col("text")))
    versions.commit_changes(revised, path, "source", changed)
    now = versions.read_version(spark, path, schema).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(changed).alias("n_changed"), F.sum(F.length("text")).alias("n_chars")
    )
    written = versions.manifest(spark, path).select(F.col("part").alias("source"), "version")
    return now.join(written, "source")


@query(
    "SELECT (o - 1) // 300 + 1 AS part, count(*)::bigint AS n_rows, min(doc_id) AS first_id, max(doc_id) AS last_id, 0::bigint AS n_written_again "
    "FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS o FROM documents) GROUP BY 1"
)
def parts_of_fixed_size(spark, sf_dir):
    """Documents in parts of 300 in identifier order; a second run finds all parts and writes none."""
    path = _fresh(spark, "parts")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    versions.write_parts(docs, path, [F.col("doc_id").asc()], 300)
    again = versions.write_parts(docs, path, [F.col("doc_id").asc()], 300).agg(F.sum("n_rows").alias("n")).select("n").scalar()
    rows = spark.read.schema("doc_id BIGINT, text STRING, part BIGINT").parquet(f"{path}/parts")
    ends = [F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")]
    return rows.groupBy("part").agg(*ends).withColumn("n_written_again", F.coalesce(again, F.lit(0).cast("bigint")))


@query("SELECT lang AS task, count(*)::bigint AS n, sum(length(text))::bigint AS n_chars FROM documents GROUP BY lang")
def raw_line_union(spark, sf_dir):
    """Raw-line union of all files below a folder; a file's stem names its language."""
    path = _fresh(spark, "raw")
    docs = table(spark, sf_dir, "documents")
    sinks.write_jsonl(docs.select("lang", "text"), path, ["lang"])
    lines = files.parsed_lines(files.read_lines(spark, path, recursive=True, pattern="*.txt"))
    named = lines.select(
        F.regexp_extract("file_path", "lang=([a-z]+)/", 1).alias("task"),
        F.length(F.try_variant_get("record", "$.text", "string")).alias("n"),
    )
    return named.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("n_chars"))


#: Lines that are put into an array at once, as Arrow columns.
_ARRAY_LINES = 256


def _as_array(batches):
    """The lines of a partition as one JSON array."""
    yield pa.RecordBatch.from_pydict({"value": ["["]})
    first = True
    for batch in batches:
        for a in range(0, batch.num_rows, _ARRAY_LINES):
            lines = batch.column(0).slice(a, _ARRAY_LINES)
            marks = pa.array(["" if first and k == 0 else "," for k in range(len(lines))], lines.type)
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(marks, lines, pa.scalar("", lines.type))], ["value"])
            first = False
    yield pa.RecordBatch.from_pydict({"value": ["]"]})


@query(
    "SELECT doc_id, row_number() OVER (ORDER BY doc_id % 2 = 0, doc_id) AS position, md5(text) AS text_md5 FROM documents"
)
def split_records(spark, sf_dir):
    """Documents in split files, odd ones as JSON arrays and even ones as lines, read back in input order."""
    root = _fresh(spark, "splits")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("doc_id", "text")).alias("value"))
    parts = {k: docs.filter(F.col("doc_id") % 2 == k).repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("value") for k in (0, 1)}
    plain = {"extension": "json", "quote": "", "escapeQuotes": "false", "sep": "\x01"}  # lines as they are
    parts[1].mapInArrow(_as_array, "value string").write.options(**plain).csv(f"{root}/arrays")
    parts[0].write.options(**plain).csv(f"{root}/lines")
    rows = splits.read_splits(spark, catalogue.catalogue(spark, root, ("*.jsonl", "*.json")))
    placed = with_ordinals(rows.select("file_no", "ordinal", "value"), [F.col("file_no").asc(), F.col("ordinal").asc()], "position")
    record = F.parse_json("value")
    return placed.select(
        F.variant_get(record, "$.doc_id", "bigint").alias("doc_id"), "position", F.md5(F.variant_get(record, "$.text", "string")).alias("text_md5")
    )


@query("SELECT lang, count(*)::bigint AS n, 'lang=' || lang || '.jsonl' AS output FROM documents GROUP BY lang")
def merge_plan(spark, sf_dir):
    """Files below a folder planned for a merge: the former output and files of the folder itself are not read."""
    root = _fresh(spark, "merge")
    docs = table(spark, sf_dir, "documents").select("lang", F.to_json(F.struct("doc_id", "text")).alias("value"))
    docs.select("value").write.text(root)
    docs.write.mode("append").partitionBy("lang").text(root)
    docs.select("value").write.text(f"{root}/merged")
    files_ = catalogue.catalogue(spark, root, ("*.txt",), output=f"{root}/merged", skip_root_level=True)
    outputs = catalogue.planned_outputs(files_).select("folder", F.element_at(F.split("output", "/"), -1).alias("output")).distinct()
    rows = splits.read_splits(spark, files_)
    counts = rows.groupBy(F.regexp_replace("file_path", "/[^/]*$", "").alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    lang = F.regexp_extract("folder", "lang=([a-z]+)$", 1)
    return counts.join(outputs, "folder").select(lang.alias("lang"), "n", "output")  # a row per folder


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS position, md5(text) AS text_md5 FROM documents")
def sorted_results(spark, sf_dir):
    """Results written in request order; the order of the files' lines is that order."""
    path = _fresh(spark, "sorted")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_idx"), "text")
    sinks.write_sorted(docs.repartition(16, "text"), path)
    rows = splits.read_splits(spark, catalogue.catalogue(spark, path, ("*.txt",)))
    placed = with_ordinals(rows.select("file_no", "ordinal", "value"), [F.col("file_no").asc(), F.col("ordinal").asc()], "position")
    record = F.parse_json("value")
    at = lambda name, kind: F.variant_get(record, f"$.{name}", kind)
    return placed.select(at("sample_idx", "bigint").alias("doc_id"), "position", F.md5(at("text", "string")).alias("text_md5"))


@query(
    "SELECT doc_id, doc_id % 7 <> 3 AS good, CASE WHEN doc_id % 7 <> 3 THEN md5(text) END AS text_md5 FROM documents"
)
def lenient_records(spark, sf_dir):
    """Lines of which every seventh is broken, read leniently: good records beside the bad lines."""
    path = _fresh(spark, "lenient")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    line = sinks.json_line(docs)
    sinks.write_lines(docs.select(F.when(F.col("doc_id") % 7 == 3, F.concat(F.lit("{"), line)).otherwise(line).alias("value")), path)
    good, bad = files.read_jsonl_lenient(spark, path, "doc_id BIGINT, text STRING")
    number = F.regexp_extract(files.CORRUPT, '"doc_id":([0-9]+)', 1).cast("bigint")
    lost = bad.select(number.alias("doc_id"), F.lit(False).alias("good"), F.lit(None).cast("string").alias("text_md5"))
    return good.select("doc_id", F.lit(True).alias("good"), F.md5("text").alias("text_md5")).unionByName(lost)


@query("SELECT lang, n_chars::varchar AS score, count(*)::bigint AS n FROM documents GROUP BY lang, n_chars")
def scores_from_csv(spark, sf_dir):
    """Scores by position out of a CSV with a header of other names."""
    path = _fresh(spark, "scores")
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("language"), F.col("n_chars").alias("value"), F.col("source").alias("note"))
    docs.write.option("header", True).csv(path)
    return files.read_scores(spark, path).groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT lang AS task, round(avg(n_chars) / 100000, 6) AS avg_prob, round(avg(n_chars), 2) AS avg_rank, count(*)::int AS n_samples FROM documents GROUP BY lang"
)
def summary_round_trip(spark, sf_dir):
    """Task means as the lines of a text report, read back by their labels."""
    path = _fresh(spark, "summary")
    means = table(spark, sf_dir, "documents").groupBy("lang").agg(F.avg("n_chars").alias("m"), F.count(F.lit(1)).alias("n"))
    lines = F.array(
        F.concat("lang", F.lit(":")),
        F.format_string("  Avg Probability: %.6f", F.col("m") / 100000),
        F.format_string("  Avg Rank: %.2f", F.col("m")),
        F.concat(F.lit("  Samples: "), "n"),
    )
    rows = means.select("lang", F.posexplode(lines).alias("at", "value"))
    sinks.write_lines(rows.coalesce(1).sortWithinPartitions("lang", "at"), path)  # four lines a language
    return files.read_summary(spark, path)


@query(
    "WITH r AS (SELECT lang, count(*) AS n, avg(n_chars) AS m FROM documents GROUP BY lang) "
    "SELECT 0 AS place, repeat('=', 70) || chr(10) || 'Lengths' || chr(10) || repeat('=', 70) AS value "
    "UNION ALL SELECT row_number() OVER (ORDER BY lang), '  lang=' || lang || '  n=' || n || '  mean=' || printf('%.6f', m) FROM r "
    "UNION ALL SELECT (SELECT count(*) FROM r) + 1, repeat('=', 70)"
)
def length_report_lines(spark, sf_dir):
    """A statistics frame as the lines of a report, in order."""
    means = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean"))
    lines = sinks.report_lines(means, "Lengths", ["lang"])
    return lines.select((F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1).alias("place"), "value")  # a line per language


@query("SELECT DISTINCT 'lang=' || lang AS folder, count(*)::bigint AS n FROM documents GROUP BY lang")
def folders_to_merge(spark, sf_dir):
    """The nearest folders below a root that hold files, and the records of each."""
    path = _fresh(spark, "folders")
    docs = table(spark, sf_dir, "documents").select("lang", F.to_json(F.struct("doc_id", "text")).alias("value"))
    docs.write.partitionBy("lang").text(f"{path}/deep")
    docs.withColumn("inner", F.lit("x")).write.mode("append").partitionBy("lang", "inner").text(f"{path}/deep")  # below the nearest
    chosen = catalogue.catalogue(spark, path, ("*.txt",), nearest=True)
    rows = splits.read_splits(spark, chosen)
    folder = F.regexp_extract("file_path", "/([^/]*)/[^/]*$", 1)
    return rows.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n"))
