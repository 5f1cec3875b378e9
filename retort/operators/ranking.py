"""Ranks, order statistics and samples that never put one group into one task.

A plain ``row_number() over (partition by g order by x)`` sorts a whole group in one
task. Groups here may hold a third of all rows, so ranks are built from counts instead:
rows are put into order-preserving buckets, buckets are counted with map-side
aggregation, and only rows within one bucket are ever sorted together.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType
from pyspark.storagelevel import StorageLevel

from retort.operators.joins import salted_join, shuffle_width
from retort.operators.records import keep_computed
from retort.operators.stored import with_running_sums

BRACKET_VALUES = 200_000  # distinct values the last step of an order statistic may sort


def hash_key(*cols: str | Column, seed: int = 42) -> Column:
    """Seeded pseudo-random order: the same for any partitioning and on any engine."""
    parts = [c.cast("string") if isinstance(c, Column) else F.col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def hash_number(key: Column, size: Column) -> Column:
    """Uniform integer in ``0..size-1`` from a hash key."""
    return F.pmod(F.conv(F.substr(key, F.lit(1), F.lit(8)), 16, 10).cast("bigint"), size)


def _before(order: str, by: list[str], weight: Column) -> Column:
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(weight).over(window), F.lit(0).cast("bigint"))


def _hash_digits(df: DataFrame) -> int:
    """Leading digits of a hash that make 64 buckets or more for each shuffle partition."""
    return max(2, math.ceil(math.log(64 * shuffle_width(df), 16)))


def sample_per_group(
    df: DataFrame,
    groups: list[str],
    limit: Column | int,
    key: Column,
    ties: Iterable[str] = (),
) -> DataFrame:
    """The ``limit`` rows of each group that come first in ``key`` (a hash) order.

    ``limit`` is worked out per group; it may use the group columns, ``_group_rows`` (rows of the
    group) and windows over groups. Groups at or below their limit are kept whole. The last key
    of each group is found on the order columns alone, in the one hash bucket in which the limit
    falls; the rows are then only filtered by it and move once.
    """
    ties = list(ties)
    keyed = df.withColumn("_key", key)
    slim = keyed.select(*groups, "_key", *[t for t in ties if t not in groups]).withColumn(
        "_bucket", F.substr("_key", F.lit(1), F.lit(_hash_digits(df)))
    )
    sizes = slim.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    quota = limit if isinstance(limit, Column) else F.lit(limit)
    limits = (
        sizes.groupBy(*groups)
        .agg(F.sum("_n").alias("_group_rows"))
        .withColumn("_limit", quota.cast("bigint"))
        .filter("_limit > 0")
    )
    crossed = (
        sizes.join(limits.filter("_limit < _group_rows"), groups)
        .withColumn("_before", _before("_bucket", groups, F.col("_n")))
        .filter("_before < _limit AND _limit <= _before + _n")
        .select(*groups, "_bucket", (F.col("_limit") - F.col("_before")).alias("_nth"))
    )
    in_bucket = Window.partitionBy(*groups, "_bucket").orderBy("_key", *ties)
    order = F.struct("_key", *ties)
    last = (
        slim.join(crossed, [*groups, "_bucket"])
        .withColumn("_rank", F.row_number().over(in_bucket))
        .filter("_rank = _nth")
        .select(*groups, order.alias("_cut"))
    )
    cuts = limits.select(*groups).join(last, groups, "left")
    kept = salted_join(keyed, cuts, groups, ["_key"])
    inside = F.col("_cut").isNull() | (order <= F.col("_cut"))
    return keep_computed(kept, inside).select(*df.columns)


def _bucketed(df: DataFrame, value: str, bounds: str, buckets: int) -> DataFrame:
    """Adds ``_bucket``, the number of sorted ``bounds`` below the value, by bisection.

    One projection per halving keeps the search in generated code.
    """
    df, step = df.withColumn("_bucket", F.lit(0)), 1 << (buckets - 1).bit_length()
    while step:
        probe = F.get(bounds, F.col("_bucket") + (step - 1))
        df = df.withColumn("_bucket", F.col("_bucket") + F.when(probe < F.col(value), step).otherwise(0))
        step //= 2
    return df


def cumulative_counts(df: DataFrame, groups: list[str], value: str, buckets: int | None = None) -> DataFrame:
    """Distinct values per group with ``n`` rows each and ``before`` rows of smaller value.

    ``n_values`` is the number of rows with a value in the group. Equal values collapse first
    (map side), so a hot value is one row.

    The buckets are cut at a sample of the distinct values, which affects balance only. The
    sample takes one value per hash class, so it is the same each time it is computed; a
    quantile sketch is not, and the two uses of the cuts below would disagree. There are eight
    buckets for each shuffle partition.
    """
    buckets = buckets or max(64, 8 * shuffle_width(df))
    keys = groups or ["_every"]
    source = df if groups else df.withColumn("_every", F.lit(0))
    counts = (
        keep_computed(source, F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    mark = F.xxhash64(F.col(value))
    sample = counts.groupBy(*keys, F.pmod(mark, F.lit(buckets)).alias("_class")).agg(
        F.min_by(F.col(value), mark).alias("_cut"), F.sum("n").alias("_n")
    )
    bounds = sample.groupBy(*keys).agg(
        F.array_sort(F.collect_set("_cut")).alias("_bounds"), F.sum("_n").alias("n_values")
    )
    bounded = salted_join(counts, bounds, keys, [value]) if groups else counts.join(F.broadcast(bounds), keys)
    placed = _bucketed(bounded, value, "_bounds", buckets).drop("_bounds")
    offsets = (
        placed.groupBy(*keys, "_bucket")
        .agg(F.sum("n").alias("_n"))
        .withColumn("_offset", _before("_bucket", keys, F.col("_n")))
        .drop("_n")
    )
    inside = _before(value, [*keys, "_bucket"], F.col("n"))
    return (
        placed.join(offsets, [*keys, "_bucket"])
        .withColumn("before", inside + F.col("_offset"))
        .drop("_every", "_bucket", "_offset")
    )


def bounded_counts(
    df: DataFrame, groups: list[str], value: str, extra: tuple[Column, ...] = ()
) -> DataFrame:
    """``cumulative_counts`` for values of a bounded domain, in one pass over ``df``.

    For whole numbers such as lengths (bounded by the longest text) and token ranks (bounded
    by the vocabulary): after equal values collapse, a group has at most as many rows as the
    domain has values, so the group can be one window. ``extra`` aggregates go beside ``n``.
    """
    counts = (
        keep_computed(df, F.col(value).isNotNull())
        .groupBy(*groups, value)
        .agg(F.count(F.lit(1)).alias("n"), *extra)
    )
    by = [F.col(g) for g in groups] or [F.lit(0)]
    window = Window.partitionBy(*by)
    running = window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(
        "before", F.coalesce(F.sum("n").over(running), F.lit(0).cast("bigint"))
    ).withColumn("n_values", F.sum("n").over(window))


def exact_percentiles(
    df: DataFrame,
    groups: list[str],
    value: str,
    fractions: dict[str, float],
    upper_median: str | None = None,
) -> DataFrame:
    """Linearly interpolated percentiles, one column per name in ``fractions``.

    ``upper_median`` names a column for element ``n div 2`` of the sorted values. The
    output also has ``n_values``.
    """
    ranked = cumulative_counts(df, groups, value)
    picks, results = percentile_columns(value, fractions)
    if upper_median:
        picks.append(value_at(value, F.floor(F.col("n_values") / 2)).alias(upper_median))
        results.append(F.col(upper_median))
    return ranked.groupBy(*groups, "n_values").agg(*picks).select(*groups, "n_values", *results)


def value_at(value: str, rank: Column) -> Column:
    """Aggregate over ``cumulative_counts``: the value at a 0-based rank."""
    inside = (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))
    return F.max(F.when(inside, F.col(value)))


def percentile_columns(value: str, fractions: dict[str, float]) -> tuple[list[Column], list[Column]]:
    """(aggregates, results) of interpolated percentiles over ``cumulative_counts``."""
    picks, results = [], []
    for name, fraction in fractions.items():
        spot = F.lit(fraction) * (F.col("n_values") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        picks += [
            value_at(value, F.floor(spot)).alias(f"_{name}_lo"),
            value_at(value, F.ceil(spot)).alias(f"_{name}_hi"),
        ]
        results.append((lo + (hi - lo) * (spot - F.floor(spot))).cast("double").alias(name))
    return picks, results


def average_ranks(df: DataFrame, value: str, rank: str, source: DataFrame | None = None) -> DataFrame:
    """Adds the 1-based rank over the whole frame, ties sharing their mean rank; rows without
    a value leave.

    Values are counted once, and running sums over the sorted counts give the ranks. Values with
    at least a thousandth of the rows are at most a thousand: their ranks are a broadcast frame,
    and their rows are dealt out in the join with the other ranks, so no hot value gathers its
    rows in one task. ``source`` is a cheaper frame with the same values to count, where ``df`` is
    costly.
    """
    counted = keep_computed(df if source is None else source, F.col(value).isNotNull())
    sums = with_running_sums(counted.groupBy(value).agg(F.count(F.lit(1)).alias("_n")), [value], "_n", "_before")
    total = sums.agg(F.sum("_n").alias("n")).select("n").scalar()
    ranked = sums.select(
        value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(rank), (F.col("_n") * 1000 >= total).alias("_hot")
    )
    hot = keep_computed(ranked, F.col("_hot")).select(value, F.col(rank).alias("_hot_rank"))
    apart = [c for c in df.columns if not isinstance(df.schema[c].dataType, (MapType, VariantType))]
    salt = F.pmod(F.xxhash64(*apart), F.lit(shuffle_width(df))) + 1
    marked = df.join(F.broadcast(hot), value, "left").withColumn(
        "_salt", F.when(F.col("_hot_rank").isNotNull(), salt).otherwise(F.lit(0))
    )
    others = keep_computed(ranked, ~F.col("_hot")).withColumn("_salt", F.lit(0).cast("bigint")).drop("_hot")
    both = marked.join(others, [value, "_salt"], "left")
    ranks = both.withColumn(rank, F.coalesce("_hot_rank", rank))
    return keep_computed(ranks, F.col(rank).isNotNull()).select(*df.columns, rank)


def kth_value(df: DataFrame, column: str, k: int, descending: bool = False):
    """Exact ``k``-th value (1-based) of a numeric column, and how many come before it.

    Each round brackets the value with an approximate quantile, counts what lies below and
    inside in one pass, and goes on inside the bracket until it holds few distinct values.
    A bracket that missed the rank is widened, so the approximation decides the number of
    rounds, never the result.
    """
    live = df.filter(F.col(column).isNotNull()).select(column)
    total = distinct = live.count()
    if not 1 <= k <= total:
        raise ValueError(f"rank {k} outside 1..{total}")
    whole, passed, size = total, 0, total
    rank = total - k + 1 if descending else k  # ascending rank inside ``live``
    spread = 2e-4
    while distinct > BRACKET_VALUES:
        share = rank / size
        cuts = [max(0.0, share - spread), min(1.0, share + spread)]
        low, high = live.agg(F.percentile_approx(column, cuts, 100_000)).first()[0]
        inside = F.col(column).between(low, high)
        below, held, distinct = live.agg(
            F.count_if(F.col(column) < low),
            F.count_if(inside),
            F.approx_count_distinct(F.when(inside, F.col(column))),
        ).first()
        if not below < rank <= below + held:
            spread *= 16
            continue
        live, rank, passed, size, spread = live.filter(inside), rank - below, passed + below, held, 2e-4
    # at most about BRACKET_VALUES rows reach this window: equal values are one row each
    hit = (
        live.groupBy(column)
        .count()
        .withColumn("_upto", F.sum("count").over(Window.orderBy(column)))
        .filter(F.col("_upto") >= rank)
        .orderBy(column)
        .first()
    )
    upto = passed + hit["_upto"]
    return hit[column], whole - upto if descending else upto - hit["count"]


def top_k(df: DataFrame, order: list[tuple[str, bool]], k: int, computed: bool = False) -> DataFrame:
    """The first ``k`` rows by ``order`` ((column, descending) pairs, the last one unique).

    The result is a filter on ``df``: the threshold is searched on the order columns
    alone, and wide rows are neither sorted nor moved. Use it where ``k`` grows with the
    data; for a short report ``orderBy().limit()`` is right. ``computed`` says that the
    order columns are costly to derive, which keeps the filter from deriving them again.
    """
    if k <= 0:
        return df.filter(F.lit(False))
    keys = df.select(*[c for c, _ in order]).persist(StorageLevel.DISK_ONLY)
    tied, keep, condition, wanted = keys, F.lit(False), F.lit(True), min(k, keys.count())
    for column, descending in order:
        if not wanted:
            break
        value, before = kth_value(tied, column, wanted, descending)
        better = F.col(column) > F.lit(value) if descending else F.col(column) < F.lit(value)
        keep = keep | (condition & better)
        condition = condition & (F.col(column) == F.lit(value))
        tied = tied.filter(F.col(column) == F.lit(value))
        wanted -= before
    keys.unpersist()
    return keep_computed(df, keep | condition) if computed else df.filter(keep | condition)
