"""Physical plans: what must not shuffle, must be pushed down, or must combine early."""

import pytest
from pyspark.sql import functions as F

from retort.operators import joins, ranking, sampling
from retort.plans import answers, translation
from retort.queries import views

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("records") / "r")
    views.bool_records(spark, SF_DIR).drop("prompt").write.parquet(path)
    return spark.read.parquet(path)


def test_extraction_is_one_scan_without_shuffle(stored):
    text = plan(answers.answer_booleans(stored))
    assert "Exchange" not in text and text.count("FileScan") == 1


def test_report_reads_only_its_columns_and_shuffles_counts(stored):
    text = plan(answers.extraction_report(answers.answer_booleans(stored), ("x",), ["task"]))
    assert text.count("Exchange") == 1 and "partial_sum" in text
    schema = text[text.index("ReadSchema") :]
    assert "output_core_tag_left" not in schema and "lang" not in schema


def test_costly_columns_are_not_repeated_in_pushed_filters(spark):
    checked = translation.think_checked(views.translation_records(spark, SF_DIR))
    text = plan(translation.valid_records(checked).select("sample_id", "best_spbleu"))
    below = text[text.index("FileScan") - 2500 : text.index("FileScan")]
    assert "Filter" not in below


def test_top_k_is_a_pushed_filter(spark):
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    kept = ranking.top_k(lines, [("l_extendedprice", True), ("l_orderkey", False), ("l_linenumber", False)], 500)
    text = plan(kept)
    assert "Exchange" not in text and "Window" not in text and "GreaterThan(l_extendedprice" in text


def test_last_per_key_combines_before_the_shuffle(spark):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    text = plan(joins.last_per_key(events, ["user_id"], "event_id"))
    assert "partial_max(" in text and "SortAggregate" not in text and "Window" not in text


def test_samples_sort_buckets_not_groups(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    text = plan(sampling.per_task_sample(docs, 7, "doc_id", task="source"))
    assert "windowspecdefinition(source#" in text.replace(" ", "")
    windows = [line for line in text.splitlines() if "row_number()" in line]
    assert windows and all("_bucket" in line for line in windows)


def test_no_cartesian_products(spark):
    import __spark_entry__ as entry_point

    for name in ("iqr_rmse", "rank_cdf_curve", "alignment_report", "upsample_copies", "missing_ids"):
        assert "CartesianProduct" not in plan(entry_point.queries()[name](spark, SF_DIR)), name


def test_restarts_write_only_their_batch(spark, tmp_path):
    out = str(tmp_path / "o")
    spark.range(3).withColumn("x", F.lit("a")).write.mode("overwrite").parquet(f"{out}/batch=0")
    spark.range(2).withColumn("x", F.lit("b")).write.mode("overwrite").parquet(f"{out}/batch=1")
    spark.range(2).withColumn("x", F.lit("c")).write.mode("overwrite").parquet(f"{out}/batch=1")
    rows = spark.read.parquet(out).groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in rows} == {0: 3, 1: 2}
