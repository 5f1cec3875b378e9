"""Folders rewritten in part: what a commit leaves alone, what a second run skips, what a batch reads."""

import os

import pytest
from pyspark.sql import functions as F

from retort.sources import versions
from retort.streaming import resume

SCHEMA = "id INT, part STRING, text STRING"


def files_of(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_only_changed_partitions_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = [(i, "abc"[i % 3] if i % 4 else None, f"t{i}") for i in range(60)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("_changed", F.lit("clash"))
    schema = SCHEMA + ", _changed STRING"
    assert versions.latest_version(spark, path) == 0 and versions.read_version(spark, path, schema).count() == 0
    assert versions.commit_changes(frame, path, "part", F.lit(False)) == 1
    first = files_of(path)
    assert rows_of(versions.read_version(spark, path, schema)) == rows_of(frame)

    revised = frame.withColumn("text", F.when(F.col("id") == 1, "new").otherwise(F.col("text")))
    assert versions.commit_changes(revised, path, "part", F.col("id") == 1) == 2
    added = files_of(path) - first
    assert first <= files_of(path) and added and all("data/2/_part=b" in f or "manifests/2" in f for f in added)
    assert rows_of(versions.read_version(spark, path, schema)) == rows_of(revised)
    assert rows_of(versions.read_version(spark, path, schema, 1)) == rows_of(frame)
    assert {r["part"]: r["version"] for r in versions.manifest(spark, path).collect()} == {"a": 1, "b": 2, "c": 1, "__null__": 1}

    before = files_of(path)
    assert versions.commit_changes(revised, path, "part", F.lit(None).cast("boolean")) == 2 and files_of(path) == before
    more = revised.unionByName(spark.createDataFrame([(99, "new", "t")], SCHEMA).withColumn("_changed", F.lit("clash")))
    assert versions.commit_changes(more, path, "part", F.lit(False)) == 3  # a partition that was not there
    assert rows_of(versions.read_version(spark, path, schema)) == rows_of(more)


def test_a_failed_commit_shows_nothing(spark, tmp_path):
    path = str(tmp_path / "v")
    frame = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], SCHEMA)
    versions.commit_changes(frame, path, "part")
    frame.write.parquet(f"{path}/data/2/_part=a")  # written, and then the driver was lost
    assert versions.latest_version(spark, path) == 1 and rows_of(versions.read_version(spark, path, SCHEMA)) == rows_of(frame)
    assert versions.commit_changes(frame.withColumn("text", F.lit("z")), path, "part", F.col("part") == "a") == 2
    assert rows_of(versions.read_version(spark, path, SCHEMA)) == [(1, "a", "z"), (2, "b", "y")]


def test_versions_are_counted_by_halving(spark, tmp_path):
    for n in range(1, 12):
        (tmp_path / "manifests" / str(n)).mkdir(parents=True)
        (tmp_path / "manifests" / str(n) / "_SUCCESS").touch()
        assert versions.latest_version(spark, str(tmp_path)) == n


@pytest.mark.parametrize("n", [0, 1, 10, 11])
def test_parts_of_fixed_size(spark, tmp_path, n):
    path = str(tmp_path / "p")
    frame = spark.createDataFrame([(i, f"t{i}", 0) for i in range(n)], "id int, text string, _place int").repartition(3)
    order = [F.col("id").desc()]
    assert rows_of(versions.write_parts(frame, path, order, 5)) == [(k + 1, min(5, n - 5 * k)) for k in range(-(-n // 5))]
    before = files_of(path)
    assert versions.write_parts(frame, path, order, 5).count() == 0 and files_of(path) == before
    if n:
        back = spark.read.parquet(f"{path}/parts")
        assert sorted(tuple(r) for r in back.select("id", "part").collect()) == [(i, (n - 1 - i) // 5 + 1) for i in range(n)]
        files = back.select("part", F.input_file_name().alias("f")).distinct()
        assert files.groupBy("part").count().filter("count > 1").count() == 0


def test_parts_without_a_name_are_written_again(spark, tmp_path):
    path = str(tmp_path / "p")
    frame = spark.range(10)
    versions.write_parts(frame, path, [F.col("id").asc()], 4)
    grown = spark.range(13)
    assert rows_of(versions.write_parts(grown, path, [F.col("id").asc()], 4)) == [(3, 4), (4, 1)]
    back = spark.read.parquet(f"{path}/parts")
    assert sorted(r["id"] for r in back.collect()) == list(range(13))
    frame.limit(2).write.parquet(f"{path}/parts/part=5")  # left by a run that failed before it named its parts
    assert rows_of(versions.write_parts(spark.range(17), path, [F.col("id").asc()], 4)) == [(4, 4), (5, 1)]
    assert sorted(r["id"] for r in spark.read.parquet(f"{path}/parts").collect()) == list(range(17))


def test_a_batch_reads_the_folders_of_its_prefixes_only(spark, tmp_path):
    out = str(tmp_path / "out")
    frame = spark.range(500).select(F.col("id").cast("string").alias("sample_id"), F.lit("x").alias("a"))
    for number in (0, 1):
        half = frame.filter(F.col("sample_id").cast("int") % 2 == number)
        half.withColumn("prefix", resume._prefix()).write.partitionBy("prefix").parquet(f"{out}/batch={number}")
    batch = frame.filter("sample_id IN ('4', '5')")
    done = resume.answered_before(batch, 1, out, "sample_id STRING, a STRING")
    mine = {r[0] for r in batch.select(resume._prefix()).collect()}
    read = {f.split("prefix=")[1].split("/")[0] for f in done.inputFiles()}
    assert done.join(batch, "sample_id").count() == 1
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "prefix" in plan[plan.index("PartitionFilters") :]
    assert "ReadSchema: struct<sample_id:string>" in plan
    paths = [r[0] for r in done.select(F.input_file_name()).distinct().collect()]
    assert {int(p.split("prefix=")[1].split("/")[0]) for p in paths} <= mine and all("batch=0" in p for p in paths) and read
