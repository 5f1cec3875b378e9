"""Quantiles, ranks, ordinals, running sums and p-values against numpy and plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from retort.operators import quantiles, ranking, sampling, statistics, stored

FRACTIONS = {"a": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "top": 1.0}


def values(seed, n):
    draw = random.Random(seed)
    return [draw.choice([draw.random(), 0.5, float(draw.randrange(4)), -draw.expovariate(1)]) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 2, 7, 5000])
def test_bracketed_percentiles(spark, n):
    rows = [(g, v) for g in ("x", "y", None) for v in values(f"{g}{n}", n)] + [("z", None)]
    found = quantiles.bracketed_percentiles(spark.createDataFrame(rows, "g string, v double").repartition(3), ["g"], "v", FRACTIONS)
    got = {r["g"]: r for r in found.collect()}
    assert set(got) == {"x", "y", None}
    for g, r in got.items():
        mine = [v for h, v in rows if h == g]
        assert r["n_values"] == len(mine)
        assert [r[k] for k in FRACTIONS] == pytest.approx(np.quantile(mine, list(FRACTIONS.values())).tolist())


def test_percentiles_without_groups_and_with_nan(spark):
    frame = spark.createDataFrame([(float(i),) for i in range(10)] + [(float("nan"),)] * 10, "v double")
    row = quantiles.bracketed_percentiles(frame, [], "v", {"low": 0.25, "high": 0.9}).first()
    assert row["low"] == 4.75 and math.isnan(row["high"]) and row["n_values"] == 20
    assert quantiles.bracketed_percentiles(frame.limit(0), [], "v", {"low": 0.25}).filter("n_values > 0").count() == 0


def test_missed_brackets_are_widened(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "HALF_WIDTH", 1e-9)
    monkeypatch.setattr(quantiles, "ACCURACY", 2)
    widths, cells = [], quantiles._cells

    def seen(rows, groups, value, shares, half):
        widths.append(half)
        return cells(rows, groups, value, shares, half)

    monkeypatch.setattr(quantiles, "_cells", seen)
    mine = values(3, 3000)
    row = quantiles.bracketed_percentiles(spark.createDataFrame([(v,) for v in mine], "v double"), [], "v", {"q": 0.37}).first()
    assert row["q"] == pytest.approx(float(np.quantile(mine, 0.37))) and len(widths) > 1


def test_cells_collapse_what_is_outside_the_brackets(spark):
    frame = spark.range(100_000).select(F.lit("g").alias("g"), F.rand(1).alias("v"))
    assert quantiles._cells(frame, ["g"], "v", [0.25, 0.75], quantiles.HALF_WIDTH).count() < 1500


def test_running_sums_and_ordinals(spark):
    draw = random.Random(4)
    rows = [(i, draw.randrange(5), draw.randrange(9)) for i in range(1000)]
    frame = spark.createDataFrame(rows, "i int, k int, _part int").repartition(5)
    sums = {r["i"]: r["before"] for r in stored.with_running_sums(frame, ["k", "i"], "_part").collect()}
    total = 0
    for i, _, w in sorted(rows, key=lambda r: (r[1], r[0])):
        assert sums[i] == total
        total += w
    places = {r["i"]: r["ordinal"] for r in stored.with_ordinals(frame, [F.col("k").desc(), F.col("i").asc()]).collect()}
    assert [i for i, _, _ in sorted(rows, key=lambda r: (-r[1], r[0]))] == sorted(places, key=places.get)
    assert sorted(places.values()) == list(range(1, 1001))
    assert stored.with_ordinals(frame.limit(0), [F.col("i").asc()]).count() == 0
    assert stored.with_running_sums(frame.limit(0), ["i"], "k").count() == 0


def test_average_ranks_of_hot_values(spark):
    mine = [7] * 400 + list(range(300)) + [300, 300]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(mine)], "i int, v int").repartition(4)
    got = {r["i"]: r["r"] for r in ranking.average_ranks(frame, "v", "r").collect()}
    order = sorted(mine)
    want = {v: (order.index(v) + 1 + len(order) - order[::-1].index(v)) / 2 for v in set(mine)}
    assert got == {i: want[v] for i, v in enumerate(mine)}


# The published accuracies of 27 pairs.
FIRST = (
    59.65, 57.72, 33.60, 28.57, 60.36, 42.65, 29.61, 60.20, 44.03, 90.73, 68.43, 16.31, 92.83, 68.98, 38.03, 93.65, 70.13, 38.50,
    35.93, 23.86, 6.90, 20.47, 43.16, 41.41, 35.68, 43.99, 39.08,
)
SECOND = (
    40.55, 46.14, 25.20, 29.80, 59.31, 34.89, 29.54, 60.47, 42.11, 91.85, 68.51, 14.09, 91.93, 69.87, 38.26, 92.75, 70.84, 40.80,
    30.77, 27.78, 15.08, 22.97, 30.87, 35.89, 34.17, 43.87, 41.23,
)


def two_sided(r, n):
    """Student's t by Simpson's rule over u = t / sqrt(f), from the tail's side."""
    f, low = n - 2, abs(r) / math.sqrt(1 - r * r)
    density = lambda u: (1 + u * u) ** (-(f + 1) / 2)
    grid = lambda a, b, k=20000: [(a + (b - a) * i / k, (b - a) / k / 3 * (1 if i in (0, k) else 4 if i % 2 else 2)) for i in range(k + 1)]
    # u = low / s turns the tail into s from 0 to 1
    if low < 1e-3:
        inside = sum(w * density(u) for u, w in grid(0.0, low))
        whole = 2 * sum(w * density(math.tan(a)) / math.cos(a) ** 2 for a, w in grid(0.0, math.pi / 2 - 1e-6))
        return 1 - 2 * inside / whole
    tail = sum(w * density(low / s) * low / s**2 for s, w in grid(1e-6, 1.0))
    beta = math.exp(math.lgamma(0.5) + math.lgamma(f / 2) - math.lgamma((f + 1) / 2))
    return 2 * tail / beta


def test_spearman_of_published_pairs(spark):
    frame = spark.createDataFrame(list(zip(FIRST, SECOND)), "x double, y double")
    row = statistics.spearman(frame, "x", "y").first()
    assert row["rho"] == pytest.approx(0.9573, abs=5e-5) and row["n"] == 27
    assert row["p"] == pytest.approx(two_sided(row["rho"], 27), rel=1e-6) and row["p"] < 1e-13


def test_p_values(spark):
    pairs = [(0.1, 100), (-0.5, 3), (0.9, 5), (0.02, 4000), (-0.99, 50), (0.3, 12)]
    rows = [*pairs, (1.0, 9), (0.0, 9), (0.5, 2), (float("nan"), 9), (None, 9)]
    frame = spark.createDataFrame(rows, "r double, n long")
    got = [r[0] for r in frame.select(quantiles.correlation_p(F.col("r"), F.col("n"))).collect()]
    assert got[: len(pairs)] == pytest.approx([two_sided(r, n) for r, n in pairs], rel=1e-5)
    assert got[len(pairs) :] == [0.0, pytest.approx(1.0), None, None, None]
    gammas = spark.createDataFrame([(x,) for x in (0.5, 1.0, 2.5, 40.0, 1e6)], "x double")
    found = [r[0] for r in gammas.select(quantiles.log_gamma(F.col("x"))).collect()]
    assert found == pytest.approx([math.lgamma(x) for x in (0.5, 1.0, 2.5, 40.0, 1e6)], rel=1e-12, abs=1e-12)


def test_shuffle_reads_its_input_once_and_keeps_the_hash_order(spark):
    rows = [(f"s{i}", i) for i in range(500)] + [(None, -1)]
    frame = spark.createDataFrame(rows, "id string, _order int").repartition(6)
    mixed = sampling.shuffled(frame, "id")
    assert mixed.columns == frame.columns
    got = [r["id"] for r in mixed.collect()]
    assert got == [r["id"] for r in frame.orderBy(ranking.hash_key("id"), "id").collect()]
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.count("Exchange") <= 2
