"""Frames written once to the session's shared folder, and total order over such frames."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from retort.session import shared_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, its lineage cut."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores in front until no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def with_ordinals(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """Adds the 1-based position of each row in ``order``, as ``name``, without a window over rows.

    The rows are sorted by ranges and written with their place, which is the number of their
    range and the position in it. Ranges are counted, the counts are summed up in a frame of one
    row per range, and a row's position is its place plus the rows of the ranges before. Rows
    that are equal in ``order`` get positions in no set order; give an order that tells all rows
    apart (equal keys also go to one range). Every row moves once. An empty frame stays empty.
    """
    place, part, before = fresh(df, "_place", "_part", "_before")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(ranged.withColumn(place, F.monotonically_increasing_id()), "ordinals")
    # the id is the number of the partition, then 33 bits for the position in it
    rows = rows.withColumn(part, F.shiftright(place, 33))
    ends = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select(part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))  # a row per range
    position = F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + F.col(before) + 1
    return rows.join(F.broadcast(offsets), part).select(*df.columns, position.alias(name))


def with_running_sums(df: DataFrame, order: list[str], weight: str, name: str = "before") -> DataFrame:
    """Adds the sum of the whole number ``weight`` over all rows that come before in ``order``.

    The columns in ``order`` (ascending, nulls first) must tell rows apart. Rows are sorted by ranges,
    and each task adds up its range as it writes it; the totals of the ranges, one row each,
    then shift the sums. Every row moves once, and no window holds more than one batch.
    """
    part, run = fresh(df, "_part", "_run")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    names = [*df.columns, part, run]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            sums = np.cumsum(batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64))
            before = total + np.concatenate([[0], sums[:-1]]) if len(sums) else sums
            total += int(sums[-1]) if len(sums) else 0
            place = pa.array(np.full(len(sums), number, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, place, pa.array(before, pa.int64())], names)

    schema = StructType([*df.schema.fields, StructField(part, IntegerType()), StructField(run, LongType())])
    rows = stored(ranged.mapInArrow(add_up, schema), "running")
    totals = rows.groupBy(part).agg(F.sum(weight).alias("n"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_shift"))  # a row per range
    shifts = shifts.withColumnRenamed("_shift", fresh(df, "_shift")[0])
    return rows.join(F.broadcast(shifts), part).select(*df.columns, (F.col(run) + F.col(shifts.columns[1])).alias(name))
