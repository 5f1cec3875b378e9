"""Writing JSONL and its variants, small reports, and the dataset register."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.operators.records import safe_name


def json_line(df: DataFrame, drop: tuple[str, ...] = ()) -> Column:
    """A record as one JSON line, null fields included, in column order."""
    names = [c for c in df.columns if c not in drop]
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, split_by: list[str] | None = None, max_records: int = 0) -> None:
    """JSONL into a new folder, optionally one sub-folder per value and parts of fixed size.

    An existing folder is an error, so an input is never overwritten while it is read. The
    commit protocol makes the files appear at once, which stands in for a temporary file
    and a rename.
    """
    parts = split_by or []
    line = df.select(*parts, json_line(df, tuple(parts)).alias("value"))
    writer = line.write.mode("errorifexists")
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    if parts:
        writer = writer.partitionBy(*parts)
    writer.text(path)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("errorifexists").text(path)


def write_sorted(df: DataFrame, path: str, by: str = "sample_idx") -> None:
    """Results in request order (a range sort; file order follows it)."""
    write_jsonl(df.orderBy(by), path)


def write_by_task(df: DataFrame, path: str, task: str = "task") -> None:
    """One sub-folder per task under a file-safe name; the record keeps its task."""
    write_jsonl(df.withColumn("task_file", safe_name(F.col(task))), path, ["task_file"])


def write_directions(df: DataFrame, path: str, direction: str = "direction") -> None:
    """One sub-folder per direction; a direction without records gets none."""
    write_jsonl(df.filter(F.col(direction).isNotNull()), path, [direction])


def write_json_array(df: DataFrame, path: str, by: str) -> None:
    """One JSON array over the part files of a new folder, in the order of the unique column ``by``.

    Executors write the parts; read one after the other they are the array.
    """
    first = df.agg(F.min(by).alias("m")).select("m").scalar()
    lead = F.when(F.col(by) == first, F.lit("  ")).otherwise(F.lit(", "))
    body = df.select(F.lit(1).alias("_place"), F.col(by).alias("_by"), F.concat(lead, json_line(df)).alias("value"))
    frame = df.sparkSession.createDataFrame([(0, "["), (2, "]")], "_place int, value string")
    frame = frame.select("_place", F.lit(None).cast(df.schema[by].dataType).alias("_by"), "value")
    body.unionByName(frame).orderBy("_place", "_by").select("value").write.mode("errorifexists").text(path)


def report_lines(df: DataFrame, title: str, by: list[str]) -> DataFrame:
    """A statistics frame as text lines (column ``value``, in order), ready for ``write_lines``."""
    bar = "=" * 70
    cells = [
        F.concat(F.lit(f"{c}="), F.format_string("%.6f", F.col(c)) if t == "double" else F.coalesce(F.col(c).cast("string"), F.lit("None")))
        for c, t in df.dtypes
    ]
    order = F.struct(*by)
    body = df.select(F.lit(1).alias("_place"), order.alias("_by"), F.concat(F.lit("  "), F.concat_ws("  ", *cells)).alias("value"))
    frame = df.sparkSession.createDataFrame([(0, f"{bar}\n{title}\n{bar}"), (2, bar)], "_place int, value string")
    frame = frame.select("_place", F.lit(None).cast(body.schema["_by"].dataType).alias("_by"), "value")
    return body.unionByName(frame).orderBy("_place", "_by").select("value")


def register_dataset(register: str, name: str, data_file: str) -> None:
    """Add or replace a chat dataset in a ``dataset_info.json`` register."""
    entries = {}
    if os.path.exists(register):
        with open(register, encoding="utf-8") as file:
            entries = json.load(file)
    # The register's entry format.
    entries[name] = {
        "file_name": data_file,
        "formatting": "sharegpt",
        "columns": {"messages": "messages"},
        "tags": {
            "role_tag": "role",
            "content_tag": "content",
            "user_tag": "user",
            "assistant_tag": "assistant",
            "system_tag": "system",
        },
    }
    os.makedirs(os.path.dirname(register) or ".", exist_ok=True)
    with open(register, "w", encoding="utf-8") as file:
        json.dump(entries, file, indent=2, ensure_ascii=False)
