"""Ranks, samples, joins and statistics against brute force, under skew and repartitioning."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from retort.operators import joins, ranking, sampling
from retort.operators import statistics as st


@pytest.fixture(scope="module")
def skewed(spark):
    """One value holds a third of the rows, one group two thirds."""
    rng = random.Random(1)
    rows = [
        (i, "hot" if i % 3 else f"g{i % 7}", 0.0 if rng.random() < 0.34 else rng.gauss(0, 5))
        for i in range(5000)
    ]
    return rows, spark.createDataFrame(rows, "id long, g string, v double").repartition(7).cache()


def test_kth_value_with_narrowing(skewed, monkeypatch):
    rows, df = skewed
    monkeypatch.setattr(ranking, "BRACKET_VALUES", 20)
    values = sorted(r[2] for r in rows)
    for k in (1, 2, 777, 2500, 4999, 5000):
        value, before = ranking.kth_value(df, "v", k)
        assert value == values[k - 1]
        assert before == sum(v < value for v in values)
        value, before = ranking.kth_value(df, "v", k, descending=True)
        assert value == values[-k]
        assert before == sum(v > value for v in values)
    with pytest.raises(ValueError):
        ranking.kth_value(df, "v", 5001)


def test_top_k_breaks_ties_by_order(skewed):
    rows, df = skewed
    for k in (0, 1, 1700, 3000, 5000, 9999):
        want = {r[0] for r in sorted(rows, key=lambda r: (-r[2], r[0]))[:k]}
        got = ranking.top_k(df, [("v", True), ("id", False)], k)
        assert {r["id"] for r in got.collect()} == want


def test_cumulative_counts_and_percentiles(skewed):
    rows, df = skewed
    groups = {}
    for _, g, v in rows:
        groups.setdefault(g, []).append(v)
    for r in ranking.cumulative_counts(df, ["g"], "v", buckets=8).collect():
        values = groups[r["g"]]
        assert r["n"] == values.count(r["v"])
        assert r["before"] == sum(v < r["v"] for v in values)
        assert r["n_values"] == len(values)
    spark_own = {
        r["g"]: r["p"]
        for r in df.groupBy("g").agg(F.percentile("v", [0.25, 0.5, 0.99]).alias("p")).collect()
    }
    cut = ranking.exact_percentiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.99}, "upper")
    for r in cut.collect():
        assert [r["a"], r["b"], r["c"]] == pytest.approx(spark_own[r["g"]])
        ordered = sorted(groups[r["g"]])
        assert r["upper"] == ordered[len(ordered) // 2]


def test_bounded_counts_agree(skewed):
    _, df = skewed
    whole = df.withColumn("v", F.round("v").cast("int"))
    one, two = (
        sorted(tuple(r) for r in f(whole, ["g"], "v").select("g", "v", "n", "before", "n_values").collect())
        for f in (ranking.cumulative_counts, ranking.bounded_counts)
    )
    assert one == two


def test_average_ranks(skewed):
    rows, df = skewed
    values = [r[2] for r in rows]
    got = {r["id"]: r["rk"] for r in ranking.average_ranks(df, "v", "rk").select("id", "rk").collect()}
    for i, _, v in rows[::97]:
        assert got[i] == sum(x < v for x in values) + (values.count(v) + 1) / 2


def test_samples_do_not_depend_on_partitioning(skewed):
    rows, df = skewed

    def ids(frame):
        return sorted(r["id"] for r in frame.collect())

    pick = lambda d: ids(sampling.per_task_sample(d, 40, "id", task="g"))
    assert pick(df) == pick(df.repartition(2)) == pick(df.coalesce(1))
    sizes = df.groupBy("g").count().collect()
    assert len(pick(df)) == sum(min(40, r["count"]) for r in sizes)
    assert pick(df) != ids(sampling.per_task_sample(df, 40, "id", seed=7, task="g"))
    assert ids(sampling.random_rows(df, 10_000, "id")) == sorted(r[0] for r in rows)
    assert len(ids(sampling.random_rows(df, 123, "id"))) == 123
    with pytest.raises(ValueError):
        sampling.required_rows(df, 5001, "id")


def test_rows_without_task_are_dropped(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "a")], "id int, task string")
    assert [r["id"] for r in sampling.per_task_sample(df, 5, "id").collect()] == [3]


def test_nested_subsets_contain_each_other(skewed):
    _, df = skewed
    marked = sampling.nested_subsets(df, [10, 100, 1000], "id")
    counts = {r["subset_size"]: r["count"] for r in marked.groupBy("subset_size").count().collect()}
    assert counts == {10: 10, 100: 90, 1000: 900}


def test_upsample_regimes(spark):
    rows = [(i, "big") for i in range(50)] + [(i, "mid") for i in range(100, 120)] + [(i, "small") for i in range(200, 205)]
    df = spark.createDataFrame(rows, "id long, task string")
    out = sampling.upsample(df, "task", "id", target=40, copies=3)
    counts = {r["task"]: r["count"] for r in out.groupBy("task").count().collect()}
    assert counts == {"big": 50, "mid": 40, "small": 15}
    report = {r["task"]: (r["final_count"], r["note"]) for r in sampling.upsample_report(df, "task", 40, 3).collect()}
    assert report == {"big": (50, "unchanged"), "mid": (40, "upsampled"), "small": (15, "repeated")}


def test_alignment_keeps_missing_modes_out(spark):
    rows = [(f"{t}{m}{i}", t, m) for t, m, n in (("a", "x", 5), ("a", "y", 3), ("b", "x", 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "sample_id string, task string, mode string")
    counts = {(r["task"], r["mode"]): r["count"] for r in sampling.aligned(df, "sample_id").groupBy("task", "mode").count().collect()}
    assert counts == {("a", "x"): 3, ("a", "y"): 3, ("b", "x"): 2}
    assert {r["totals_equal"] for r in sampling.alignment_report(df).collect()} == {False}


def test_quota_keeps_tasks_without_quota(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("sample_id"), F.when(F.col("id") < 10, "q").otherwise("free").alias("task"))
    counts = {r["task"]: r["count"] for r in sampling.quota_sample(df, {"q": 4}, "sample_id").groupBy("task").count().collect()}
    assert counts == {"q": 4, "free": 20}


def test_joins(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "sample_id string, at int")
    right = spark.createDataFrame([("a", 7), ("a", 9), ("c", 8)], "sample_id string, at int")
    both = joins.paired(left, right, "sample_id", "at", "at").collect()
    assert [(r["sample_id"], r["from_file1"]["at"], r["from_file2"]["at"]) for r in both] == [("a", 2, 9)]
    assert sorted((r["at"], r["at_2"]) for r in joins.matched(left, right, "sample_id", "at").collect()) == [(1, 9), (2, 9)]
    assert sorted(r["at"] for r in joins.pending(left.dropna(), right, "sample_id").collect()) == [3]
    full = spark.createDataFrame([("t", 1), ("t", 1), ("t", 2), ("u", 5)], "task string, sample_id int")
    taken = spark.createDataFrame([("t", 2)], "task string, sample_id int")
    assert [r["sample_id"] for r in joins.difference(full, taken, "task", "sample_id").collect()] == [1, 1]


@pytest.mark.parametrize("values", [[], [2.0], [1.0, 3.0], [1.0, 2.0, 4.0], [1.0, 2.0, 4.0, 9.0], [5.0] * 6, [1.0, 2.0, 2.0, 3.0, 11.0]])
def test_moments_and_their_guards(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.agg(*st.moments(F.col("v"), "v")).first()
    n = len(values)
    if n == 0:
        assert got["v_std"] == got["v_skewness"] == got["v_kurtosis"] == 0.0
        return
    mean = statistics.fmean(values)
    std = statistics.stdev(values) if n > 1 else 0.0
    assert got["v_mean"] == pytest.approx(mean) and got["v_std"] == pytest.approx(std)
    z = [(v - mean) / std for v in values] if std else [0.0] * n
    skew = n / ((n - 1) * (n - 2)) * sum(x**3 for x in z) if n > 2 else 0.0
    kurt = (
        n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * sum(x**4 for x in z) - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3))
        if n > 3 and std
        else 0.0
    )
    assert got["v_skewness"] == pytest.approx(skew) and got["v_kurtosis"] == pytest.approx(kurt)


def test_rank_beyond_last_edge_counts_in_total_only(spark):
    df = spark.createDataFrame([("t", r, 0.5) for r in (1, 2, 10000, 10001)], "task string, rank long, prob double")
    bins = {r["label"]: (r["n"], r["total"]) for r in st.rank_histogram(df, ["task"]).collect()}
    assert bins["1"] == (1, 4) and bins["2-5"] == (1, 4) and bins["1K+"] == (1, 4)
