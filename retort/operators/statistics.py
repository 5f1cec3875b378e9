"""Summary statistics; sums combine on the map side, percentiles are exact and bucketed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retort.constants import RANK_BIN_EDGES, RANK_BIN_LABELS, RANK_THRESHOLDS
from retort.functions.text import python_float, strip
from retort.operators.quantiles import bracketed_percentiles, correlation_p
from retort.operators.ranking import (
    average_ranks,
    bounded_counts,
    cumulative_counts,
    exact_percentiles,
    percentile_columns,
    value_at,
)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def _with_percentiles(
    df: DataFrame, groups: list[str], value: str, fractions: dict[str, float], *aggs: Column
) -> DataFrame:
    basic = df.groupBy(*groups).agg(F.count(value).alias("n"), *aggs)
    cut = exact_percentiles(df, groups, value, fractions).drop("n_values")
    if groups:
        return basic.join(cut, groups, "left")
    # one row each: joined on the row count's sign, not crossed
    one = F.lit(1).alias("_one")
    return basic.select("*", one).join(cut.select("*", one), "_one", "left").drop("_one")


def score_distribution(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Count, mean, median, population deviation, extremes, quartiles and zeros."""
    return _with_percentiles(
        df,
        groups,
        value,
        {"median": 0.5, "p25": 0.25, "p75": 0.75},
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std_pop"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.count_if(F.col(value) == 0).alias("n_zero"),
        percent(F.count_if(F.col(value) == 0), F.count(value)).alias("zero_percent"),
    )


def length_statistics(df: DataFrame, groups: list[str], value: str, threshold: int) -> DataFrame:
    """Count, total, mean, sample deviation (0 for one value), median, extremes, over-long.

    ``value`` is a whole number, so its sums are exact and everything comes from the counts
    of the distinct lengths: the texts are measured once.
    """
    v, n = F.col(value).cast("decimal(19,0)"), F.col("n").cast("decimal(19,0)")
    ranked = bounded_counts(df, groups, value)
    picks, results = percentile_columns(value, {"median": 0.5})
    sums = ranked.groupBy(*groups, "n_values").agg(
        F.sum(v * n).alias("_s1"),
        F.sum((v * v * n).cast("decimal(38,0)")).alias("_s2"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.sum(F.when(F.col(value) > threshold, F.col("n")).otherwise(0)).alias("n_over"),
        *picks,
    )
    size, s1 = F.col("n_values"), F.col("_s1").cast("double")
    # n * s2 - s1 * s1 is the exact whole number n * (n - 1) * variance
    spread = (F.col("_s2") * size - F.col("_s1") * F.col("_s1")).cast("double")
    variance = spread / (size * F.nullif(size - 1, F.lit(0)))
    return sums.select(
        *groups,
        size.alias("n"),
        F.col("_s1").cast("bigint").alias("total"),
        (s1 / size).alias("mean"),
        F.coalesce(F.sqrt(variance), F.lit(0.0)).alias("std_samp"),
        "min",
        "max",
        "n_over",
        percent(F.col("n_over"), size).alias("over_percent"),
        *results,
    )


def score_summary(df: DataFrame, value: str) -> DataFrame:
    """Average, upper median (element ``n div 2``), minimum and maximum of the whole frame."""
    ranked = cumulative_counts(df, [], value)
    return ranked.agg(
        (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("avg"),
        value_at(value, F.floor(F.col("n_values") / 2)).alias("median"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def moments(value: Column, prefix: str) -> list[Column]:
    """Mean, sample deviation, adjusted skewness G1 and excess kurtosis G2.

    Spark's ``skewness`` and ``kurtosis`` are the population forms. All four are 0 beyond
    the mean for fewer than 2 values or no spread; G1 needs 3 values, G2 needs 4.
    """
    n = F.count(value)
    std = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    spread = (n >= 2) & (std >= 1e-15)
    g1 = F.skewness(value) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))
    g2 = (
        ((n + 1) * F.kurtosis(value) + 6)
        * (n - 1)
        / F.nullif((n - 2) * (n - 3), F.lit(0).cast("bigint"))
    )
    zero = F.lit(0.0)
    return [
        F.avg(value).alias(f"{prefix}_mean"),
        F.when(spread, std).otherwise(zero).alias(f"{prefix}_std"),
        F.when(spread & (n > 2), g1).otherwise(zero).alias(f"{prefix}_skewness"),
        F.when(spread & (n > 3), g2).otherwise(zero).alias(f"{prefix}_kurtosis"),
    ]


def _error_bounds(df: DataFrame, groups: list[str], multiplier: float) -> DataFrame:
    cut = bracketed_percentiles(df, groups, "abs_error", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return cut.withColumn("bound", F.col("q3") + F.lit(multiplier) * (F.col("q3") - F.col("q1")))


def iqr_rmse(
    df: DataFrame, group: str, predicted: str, truth: str, multiplier: float = 1.5
) -> DataFrame:
    """RMSE per group after dropping errors beyond q3 + 1.5 IQR, and the mean over groups."""
    errors = df.select(
        group, F.abs(F.col(predicted) - F.col(truth)).alias("abs_error")
    ).filter(F.col(group).isNotNull() & F.col("abs_error").isNotNull())
    bounds = _error_bounds(errors, [group], multiplier).select(group, "bound", "n_values")
    per_group = (
        errors.join(bounds, group)
        .groupBy(group, "n_values")
        .agg(F.sqrt(F.avg(F.when(F.col("abs_error") <= F.col("bound"), F.pow("abs_error", F.lit(2))))).alias("rmse"))
        .withColumnRenamed("n_values", "n")
    )
    # one row per generation is left
    return per_group.withColumn("mean_rmse", F.avg("rmse").over(Window.partitionBy(F.lit(0))))


def error_summary(df: DataFrame, predicted: str, truth: str, multiplier: float = 1.5) -> DataFrame:
    """Quartiles of |error| over everything and the share beyond q3 + 1.5 IQR."""
    errors = df.select(F.abs(F.col(predicted) - F.col(truth)).alias("abs_error")).filter("abs_error IS NOT NULL")
    bounds = _error_bounds(errors, [], multiplier)
    cut = bounds.select(F.struct("q1", "q2", "q3", "bound")).scalar()
    summary = errors.withColumn("_cut", cut).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("abs_error").alias("min"),
        F.max("abs_error").alias("max"),
        F.count_if(F.col("abs_error") > F.col("_cut.bound")).alias("n_beyond"),
        F.first("_cut").alias("_cut"),
    )
    share = percent(F.col("n_beyond"), F.col("n")).alias("beyond_percent")
    return summary.select("n", "min", "max", "n_beyond", "_cut.*", share)


def rank_statistics(tokens: DataFrame, groups: list[str]) -> DataFrame:
    """Over exploded tokens (``rank``, ``prob``): means, percentiles and the rank CDF."""
    ranked = bounded_counts(tokens, groups, "rank", (F.sum("prob").alias("_prob"),))
    picks, results = percentile_columns("rank", {"median_rank": 0.5, "p90_rank": 0.9, "p99_rank": 0.99})
    size = F.col("n_values")
    upto = [
        F.sum(F.when(F.col("rank") <= k, F.col("n")).otherwise(0)).alias(f"_c{k}")
        for k in RANK_THRESHOLDS
    ]
    return (
        ranked.groupBy(*groups, "n_values")
        .agg(F.sum(F.col("rank") * F.col("n")).alias("_r"), F.sum("_prob").alias("_p"), *upto, *picks)
        .select(
            *groups,
            size.alias("n"),
            (F.col("_r") / size).alias("mean_rank"),
            (F.col("_p") / size).alias("mean_prob"),
            *[(F.col(f"_c{k}") / size).alias(f"cdf_{k}") for k in RANK_THRESHOLDS],
            *results,
        )
    )


def rank_histogram(tokens: DataFrame, groups: list[str]) -> DataFrame:
    """Share of tokens per rank bin; ranks beyond the last edge count in the total only."""
    edges = list(zip(RANK_BIN_EDGES, RANK_BIN_EDGES[1:], RANK_BIN_LABELS))
    counts = tokens.groupBy(*groups).agg(
        F.count("rank").alias("total"),
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("bin"),
                    F.lit(label).alias("label"),
                    F.count_if((F.col("rank") >= lo) & (F.col("rank") < hi)).alias("n"),
                )
                for i, (lo, hi, label) in enumerate(edges)
            ]
        ).alias("_bins"),
    )
    return counts.select(*groups, "total", F.inline("_bins")).withColumn(
        "fraction", F.try_divide(F.col("n"), F.col("total"))
    )


def width_histogram(df: DataFrame, groups: list[str], value: str, width: float) -> DataFrame:
    """Counts per fixed-width bin; only bins with rows are listed."""
    start = F.floor(F.col(value) / F.lit(width)) * F.lit(width)
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*groups, start.alias("bin_start"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def equal_histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Counts in ``bins`` equal bins between minimum and maximum, the maximum in the last."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    width = F.col("_hi") - F.col("_lo")
    spot = F.floor(F.try_divide((F.col(value) - F.col("_lo")) * F.lit(bins), width))
    return (
        df.filter(F.col(value).isNotNull())
        .select(value, lo.alias("_lo"), hi.alias("_hi"))
        .groupBy(F.least(F.coalesce(spot, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def rank_cdf_curve(tokens: DataFrame, groups: list[str], points: int = 500, common: bool = False) -> DataFrame:
    """Share of tokens at or below log-spaced ranks up to the 99.5th percentile (100 at least).

    ``common`` gives all groups the grid of the largest percentile, so that curves share points.
    """
    if not groups:
        return rank_cdf_curve(tokens.withColumn("_all", F.lit(0)), ["_all"], points).drop("_all")
    ranked = bounded_counts(tokens, groups, "rank")
    picks, results = percentile_columns("rank", {"_p": 0.995})
    top = (
        ranked.groupBy(*groups, "n_values")
        .agg(*picks)
        .select(*groups, "n_values", *results)
        .withColumn("_top", F.greatest(F.floor("_p"), F.lit(100)) + 1)
    )
    if common:  # one row per group
        top = top.withColumn("_top", F.max("_top").over(Window.partitionBy(F.lit(0))))
    grid = top.select(
        *groups,
        "n_values",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.lit(points - 1)),
                lambda i: F.pow(F.col("_top").cast("double"), i / F.lit(float(points - 1))),
            )
        ).alias("point", "rank_at"),
    )
    # rows are placed on the first grid point that covers them, then accumulated per group
    step = F.log(F.col("_top").cast("double")) / F.lit(float(points - 1))
    first = F.greatest(F.ceil(F.log(F.col("rank").cast("double")) / step - 1e-9), F.lit(0))
    placed = (
        ranked.drop("n_values")
        .join(top, groups)
        .filter(F.col("rank") <= F.col("_top"))
        .groupBy(*groups, F.least(first, F.lit(points - 1)).cast("int").alias("point"))
        .agg(F.sum("n").alias("_n"))
    )
    upto = Window.partitionBy(*groups).orderBy("point").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(placed, [*groups, "point"], "left").select(
        *groups,
        "point",
        "rank_at",
        F.try_divide(F.sum(F.coalesce("_n", F.lit(0))).over(upto), F.col("n_values")).alias("cdf"),
    )


def gaussian_density(
    df: DataFrame, value: str, low: float = 0.0, high: float = 1.0, points: int = 200
) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth on an even grid; NULL where all values are equal."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    stats = df.agg(
        F.count(value).alias("n"),
        (F.stddev_samp(value) * F.pow(F.count(value), F.lit(-0.2))).alias("h"),
    )
    n, h = stats.select("n").scalar(), stats.select("h").scalar()
    step = (high - low) / (points - 1)
    spread = counts.select(
        value, "_n", n.alias("n"), h.alias("h"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    )
    z = F.try_divide(F.lit(low) + F.col("point") * F.lit(step) - F.col(value), F.col("h"))
    return (
        spread.groupBy("point", "n", "h")
        .agg(F.sum(F.col("_n") * F.exp(-0.5 * z * z)).alias("_s"))
        .select(
            "point",
            (F.lit(low) + F.col("point") * F.lit(step)).alias("x"),
            F.try_divide(F.col("_s"), F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi))).alias("density"),
        )
    )


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with tied ranks shared: one row of rho, the number of pairs, and the
    two-sided p under Student's t (NULL below three pairs, or where one side is constant)."""
    pairs = df.select(x, y).dropna()
    ranked = average_ranks(average_ranks(pairs, x, "_rx"), y, "_ry", source=pairs)
    rho = ranked.agg(F.corr("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n"))
    return rho.withColumn("p", correlation_p(F.col("rho"), F.col("n")))


def weighted_mean(means: DataFrame, mean: str, weight: str, name: str) -> DataFrame:
    """Mean over samples from group means and group sizes."""
    return means.agg(
        F.coalesce(
            F.try_divide(F.sum(F.col(mean) * F.col(weight)), F.sum(weight)), F.lit(0.0)
        ).alias(name)
    )


def subset_mean(scores: DataFrame, wanted: tuple[str, ...], key: str, score: str) -> DataFrame:
    """Mean score over a fixed key set, with how many keys were unusable or absent.

    ``score`` is text; blank and non-numeric cells are reported, not averaged.
    """
    rows = scores.select(strip(F.col(key)).alias("_k"), python_float(F.col(score)).alias("_v"))
    inside = rows.filter(F.col("_k").isin(*wanted))
    seen = F.collect_set("_k")  # at most len(wanted) keys
    missing = F.array_except(F.array(*[F.lit(w) for w in sorted(wanted)]), seen)
    return inside.agg(
        F.count("_v").alias("n_scores"),
        F.avg("_v").alias("mean_score"),
        F.count_if(F.col("_v").isNull()).alias("n_skipped"),
        F.array_join(missing, ",").alias("missing"),
    )
