"""Reading JSONL, JSON, CSV and raw lines, with their error policies and row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retort.functions.text import strip
from retort.operators.records import keep_computed

CORRUPT = "_corrupt_record"


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def with_source(df: DataFrame) -> DataFrame:
    """Adds ``file_path``, ``file_stem``, ``block_start`` and ``row_id`` (rising within a block).

    Sorting by the first, third and fourth is the order of the input files.
    """
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_id"),
    ).withColumn("file_stem", stem(F.col("file_path")))


def read_jsonl(spark: SparkSession, paths: str | list[str], ddl: str, recursive: bool = False) -> DataFrame:
    """Strict: a line that is not JSON fails the job; blank lines are skipped."""
    reader = spark.read.schema(ddl).option("mode", "FAILFAST").option("recursiveFileLookup", recursive)
    return reader.json(paths)


def read_jsonl_lenient(
    spark: SparkSession, paths: str | list[str], ddl: str, recursive: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(good records, bad lines): bad lines are set apart instead of failing."""
    lines = read_lines(spark, paths, recursive)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    rows = lines.select(F.from_json("value", f"{ddl}, {CORRUPT} STRING", options).alias("r"))
    bad = F.col(f"r.{CORRUPT}").isNotNull()
    return (
        keep_computed(rows, ~bad).select("r.*").drop(CORRUPT),
        keep_computed(rows, bad).select(f"r.{CORRUPT}"),
    )


def read_lines(spark: SparkSession, paths: str | list[str], recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """Non-blank raw lines (``value``) with their place; never parsed."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return keep_computed(with_source(reader.text(paths)), strip(F.col("value")) != "")


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Adds ``record`` (VARIANT, NULL for a bad line); ``value`` stays for pass-through."""
    return lines.withColumn("record", F.try_parse_json("value"))


def with_line_numbers(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Adds the 1-based number of each row in its file, counted over ``every`` row of the input
    where ``rows`` are some of them.

    Ids of a block are consecutive, so a block's first id and the lengths of the blocks
    before it are enough; no file is sorted. Where rows were dropped before, numbers still
    rise in file order but no longer count the dropped rows at block ends.
    """
    span = F.max("row_id") - F.min("row_id") + 1
    blocks = (rows if every is None else every).groupBy("file_path", "block_start").agg(
        span.alias("_n"), F.min("row_id").alias("_first")
    )
    earlier = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "file_path", "block_start", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    number = F.col("row_id") - F.col("_first") + F.col("_offset") + 1
    return rows.join(offsets, ["file_path", "block_start"]).withColumn("line_number", number).drop("_first", "_offset")


def bad_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """File, line number and text of every non-blank line that is not JSON."""
    every = with_source(spark.read.text(paths))
    lines = keep_computed(parsed_lines(every), (strip(F.col("value")) != "") & F.col("record").isNull())
    return with_line_numbers(lines, every).select("file_path", "line_number", "value")


def file_outcomes(lines: DataFrame) -> DataFrame:
    """Good and bad lines per file, and whether the file failed (has bad ones), of parsed lines."""
    good = F.count_if(F.col("record").isNotNull())
    counts = lines.groupBy("file_path").agg(good.alias("n_good"), (F.count(F.lit(1)) - good).alias("n_bad"))
    return counts.withColumn("failed", F.col("n_bad") > 0)


def json_format(spark: SparkSession, path: str) -> str:
    """``json_array`` or ``jsonl`` by the first lines of a file."""
    lines = spark.read.text(path)
    first = lines.head(1)
    head = first[0]["value"] if first else ""
    if head.startswith("["):
        return "json_array"
    if head.strip() and lines.limit(1).select(F.try_parse_json(strip(F.col("value"))).isNotNull()).first()[0]:
        return "jsonl"
    filled = lines.filter(strip(F.col("value")) != "").head(1)
    is_array = bool(head.strip()) and bool(filled) and filled[0]["value"].strip().startswith("[")
    return "json_array" if is_array else "jsonl"


def read_json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A JSON array or JSONL file, whichever it is; bad JSONL lines are skipped."""
    if json_format(spark, path) == "json_array":
        return spark.read.schema(ddl).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return read_jsonl_lenient(spark, path, ddl)[0]


def list_files(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Paths below a root by name pattern, without reading the files; each path once."""
    reader = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", recursive)
    )
    return reader.load(root).select("path").distinct()


def postprocessed_file(spark: SparkSession, folder: str) -> str | None:
    """The judged file of a task folder: the first in path order."""
    row = list_files(spark, folder, "*_postprocessed*.jsonl", recursive=False).agg(F.min("path")).first()
    return row[0]


def nearest_folders(files: DataFrame, root: str) -> DataFrame:
    """Folders to merge: the root itself if it holds files, else the nearest ones below it."""
    prefix = root.rstrip("/")
    folders = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()
    parts = F.split(F.substr("folder", F.instr("folder", prefix) + F.lit(len(prefix))), "/")
    chains = folders.withColumn(
        "_above",
        F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda n: F.concat(F.substring_index("folder", prefix, 1), F.lit(prefix), F.array_join(F.slice(parts, 1, n), "/")),
        ),
    )
    parents = chains.select("folder", F.explode("_above").alias("above")).filter("above <> folder")
    covered = parents.join(folders.withColumnRenamed("folder", "above"), "above", "left_semi")
    return folders.join(covered.select("folder").distinct(), "folder", "left_anti")


def read_tokens(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Token records of a file or folder; a missing task is the file stem."""
    rows = with_source(spark.read.schema(ddl).json(path))
    return rows.withColumn("task", F.coalesce("task", "file_stem")).drop("file_path", "file_stem", "block_start")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(language, score) by position from a CSV with a header; rows with one cell are dropped."""
    rows = spark.read.option("header", True).csv(path)
    named = rows.toDF("lang", "score", *[f"_c{i}" for i in range(2, len(rows.columns))])
    return named.select("lang", F.coalesce("score", F.lit("")).alias("score")).filter(F.col("lang").isNotNull())


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Task means out of a text report: a ``task:`` line, then its labelled values."""
    lines = with_line_numbers(with_source(spark.read.text(path)))
    text = F.regexp_replace("value", r"\s+$", "")
    header = F.nullif(F.regexp_extract(text, r"^(\S+):$", 1), F.lit(""))
    is_task = header.isNotNull() & ~F.startswith(text, F.lit("Model")) & ~F.startswith(text, F.lit("Token"))
    # a report is a few lines per task, and one file is one window
    seen = Window.partitionBy("file_path").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    tagged = lines.select(
        F.last(F.when(is_task, header), ignorenulls=True).over(seen).alias("task"),
        F.regexp_extract(text, r"Avg Probability:\s+([\d.]+)", 1).try_cast("double").alias("p"),
        F.regexp_extract(text, r"Avg Rank:\s+([\d.]+)", 1).try_cast("double").alias("r"),
        F.regexp_extract(text, r"Samples:\s+(\d+)", 1).try_cast("int").alias("n"),
    )
    return (
        tagged.filter(F.col("task").isNotNull())
        .groupBy("task")
        .agg(F.max("p").alias("avg_prob"), F.max("r").alias("avg_rank"), F.max("n").alias("n_samples"))
    )
