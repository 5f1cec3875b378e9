"""Folders that are rewritten in part: versions of partitions under a manifest, and numbered parts.

A manifest is a small frame that names what is there. It is written last, so a job that fails
leaves files that nothing names, and readers see either the former state or the whole new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.operators.joins import shuffle_width
from retort.operators.stored import fresh, stored, with_ordinals

_MANIFEST = "part string, version int, n_rows long, n_changed long"
_PARTS = "part long, n_rows long"


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a committed folder is there, in any store that Spark writes to."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def latest_version(spark: SparkSession, path: str) -> int:
    """The number of the last committed version, 0 if there is none; versions count from 1."""
    last, step = 0, 1
    while _exists(spark, f"{path}/manifests/{last + step}"):  # doubling, then halving
        last, step = last + step, step * 2
    while step > 1:
        step //= 2
        if _exists(spark, f"{path}/manifests/{last + step}"):
            last += step
    return last


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """part, version that wrote it, n_rows and n_changed, one row per partition."""
    version = latest_version(spark, path) if version is None else version
    if not version:
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifests/{version}")


def commit_changes(df: DataFrame, path: str, part: str, changed: Column | None = None) -> int:
    """Write the partitions of ``df`` that hold changed records as a new version; its number.

    ``df`` holds all records. Partitions without a change keep the files they have: the new
    manifest points to them. All are written where there is no version yet, or without ``changed``;
    where nothing changed, nothing is written and the former number is returned. A partition is
    a value of ``part`` (null is one). The rows of a partition are spread over all tasks. One job
    at a time may commit; of two, the second finds the folder of its version taken and fails.
    """
    spark = df.sparkSession
    last = latest_version(spark, path)
    mark = F.coalesce(changed, F.lit(False)) if changed is not None else F.lit(True)
    n, mine = fresh(df, "_changed", "_part")
    rows = df.withColumns({n: mark, mine: F.coalesce(F.col(part).cast("string"), F.lit("__null__"))})
    counts = rows.groupBy(mine).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(n).alias("n_changed"))
    counts = stored(counts.withColumnRenamed(mine, "part"), "changes")
    old = manifest(spark, path, last)
    # a partition that the manifest doesn't know is new, whatever its marks
    known = old.select(F.col("part").alias("known"))
    touched = counts.join(known, F.col("part") == F.col("known"), "left").filter("n_changed > 0 OR known IS NULL").drop("known")
    touched = stored(touched, "touched")
    if last and touched.isEmpty():
        return last
    number = last + 1
    names = touched.select(F.col("part").alias(mine))
    # joined by the name of the partition, whose rows AQE splits where they are many
    wanted = rows.join(names, mine, "left_semi").drop(n)
    wanted.write.mode("overwrite").partitionBy(mine).parquet(f"{path}/data/{number}")
    kept = old.join(touched.select("part"), "part", "left_anti")
    new = touched.select("part", F.lit(number).alias("version"), "n_rows", "n_changed")
    kept.select("part", "version", "n_rows", "n_changed").unionByName(new).coalesce(1).write.parquet(f"{path}/manifests/{number}")
    return number


def read_version(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """All records of a version (the last one if not given), from whatever versions wrote them."""
    frames = None
    for row in manifest(spark, path, version).groupBy("version").agg(F.collect_list("part").alias("parts")).orderBy("version").collect():
        rows = spark.read.schema(f"{schema}, _part STRING").parquet(f"{path}/data/{row['version']}")
        rows = rows.filter(F.col("_part").isin(row["parts"])).drop("_part")  # whole folders are left out
        frames = rows if frames is None else frames.unionByName(rows)
    return spark.createDataFrame([], schema) if frames is None else frames


def write_parts(df: DataFrame, path: str, order: list[Column], size: int) -> DataFrame:
    """Write ``df`` as parts of ``size`` records in ``order``, but for those already there.

    Returns (part, n_rows) of what this run wrote. Parts count from 1, and the last one may be
    short. A part is there when the manifest names it with as many rows; one that a failed run left
    without a name, or that grew, is written again. ``order`` must tell records apart.
    """
    spark = df.sparkSession
    part, place = fresh(df, "part", "_place")
    rows = with_ordinals(df, order, place).withColumn(part, F.floor((F.col(place) - 1) / size) + 1)
    there = spark.createDataFrame([], _PARTS)
    if _exists(spark, f"{path}/manifest"):
        there = spark.read.schema(_PARTS).parquet(f"{path}/manifest")
    total = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n_rows")).withColumnRenamed(part, "part")
    there = there.groupBy("part").agg(F.max("n_rows").alias("n_rows"))
    missing = stored(total.join(there, ["part", "n_rows"], "left_anti"), "parts")
    if missing.isEmpty():
        return missing
    # a part goes to one task by its number, and its records are sorted there
    width = shuffle_width(df)
    wanted = rows.join(missing.select(F.col("part").alias(part)), part, "left_semi")
    wanted = wanted.withColumn("_task", F.pmod(F.col(part), F.lit(width)).cast("int")).repartitionById(width, F.col("_task"))
    wanted = wanted.sortWithinPartitions(part, place).drop("_task", place)
    wanted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(f"{path}/parts")
    missing.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return missing
