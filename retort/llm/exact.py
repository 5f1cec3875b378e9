"""Exact de-duplication by content sort.

Sampled splitters deal the normalised texts out by range, a sort within each range puts equal
texts next to each other, and each text is compared in full with the one before it. A group of
equal texts may cross range borders (its rows are dealt out by identifier), so no group is ever
one task's; the last text of a range is compared with the first of the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retort.llm.text import SPACE_PATTERN, saved

#: Leading characters of a text that the splitters hold; the digest orders texts beyond it.
SPLITTER_CHARS = 32

_RUNS = "doc_id {id}, text_sha256 string, part int, run long, head boolean, first_text string, last_text string"


def normalised(text):
    """White space runs as one space, null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_PATTERN, " ")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal neighbouring texts of one sorted range."""
    part = TaskContext.get().partitionId()
    last, run, held = None, -1, None
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column("norm")
        same = np.zeros(batch.num_rows, bool)
        same[1:] = pc.equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_numpy(zero_copy_only=False)
        same[0] = last is not None and texts[0].as_py() == last
        runs = run + np.cumsum(~same)
        first = [None] * batch.num_rows
        if last is None:
            first[0] = texts[0].as_py()
        last, run = texts[-1].as_py(), int(runs[-1])
        if held is not None:
            yield held
        held = pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text_sha256"),
                pa.array(np.full(batch.num_rows, part, np.int32)),
                pa.array(runs),
                pa.array(~same),
                pa.array(first, pa.string()),
                pa.nulls(batch.num_rows, pa.string()),
            ],
            ["doc_id", "text_sha256", "part", "run", "head", "first_text", "last_text"],
        )
    if held is not None:
        ends = pa.array([None] * (held.num_rows - 1) + [last], pa.string())
        yield held.set_column(6, "last_text", ends)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after white space runs became single spaces; a null text
    counts as empty. The row with the smallest identifier of a group is kept, null identifiers
    last; of rows that are equal in both, exactly one is kept. keep_id is null only where all
    identifiers of the group are. An empty table gives an empty result; other columns are not
    read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.withColumns({"text_sha256": F.sha2("norm", 256), "start": F.left("norm", F.lit(SPLITTER_CHARS))})
    order = [F.col("start"), F.col("text_sha256"), F.col("doc_id").asc_nulls_last()]
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.repartitionByRange(width, *order).sortWithinPartitions(*order).drop("start")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    runs = saved(ranges.mapInArrow(_runs, _RUNS.format(id=id_type)), "exact-runs")

    # two texts and a run number per range, later one pair of numbers: as many rows as ranges
    ends = runs.filter("first_text IS NOT NULL OR last_text IS NOT NULL").groupBy("part").agg(
        F.max("first_text").alias("first_text"), F.max("last_text").alias("last_text"), F.max("run").alias("last_run")
    )
    by_part = Window.orderBy("part")
    ends = ends.withColumn("joined", F.coalesce(F.lag("last_text").over(by_part) == F.col("first_text"), F.lit(False)))
    own = F.when(~(F.col("joined") & (F.col("last_run") == 0)), F.struct("part", F.col("last_run").alias("run")))
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    joined = ends.withColumn("to", F.last(own, ignorenulls=True).over(before)).filter("joined")
    joined = joined.select("part", F.lit(0).cast("long").alias("run"), F.col("to.part").alias("to_part"), F.col("to.run").alias("to_run"))

    rows = runs.drop("first_text", "last_text").join(F.broadcast(joined), ["part", "run"], "left").select(
        "doc_id",
        "text_sha256",
        F.coalesce("to_part", "part").alias("part"),
        F.coalesce("to_run", "run").alias("run"),
        (F.col("head") & F.col("to_part").isNull()).alias("kept"),
    )
    groups = rows.groupBy("part", "run").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # written first, so that the join can be split where a group is large
    return rows.join(saved(groups, "exact-groups"), ["part", "run"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
