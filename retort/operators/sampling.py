"""Shuffles, samples, quotas, alignment and replication.

Random choices follow a seeded hash of the record key (``ranking.hash_key``), so they do
not depend on partitioning, file split or retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retort.constants import UPSAMPLE_COPIES, UPSAMPLE_TARGET
from retort.operators.joins import salted_join, shuffle_width
from retort.operators.ranking import (
    cumulative_counts,
    hash_key,
    hash_number,
    kth_value,
    sample_per_group,
    top_k,
)
from retort.operators.stored import fresh


def per_task_sample(
    df: DataFrame, n: int, key: str, seed: int = 42, task: str = "task"
) -> DataFrame:
    """``n`` random rows per task, all of a shorter task; rows without a task are dropped."""
    named = df.filter(F.coalesce(F.col(task), F.lit("")) != "")
    return sample_per_group(named, [task], n, hash_key(key, seed=seed), [key])


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Random order, total over the partitions in turn.

    Hashes are even, so their leading bits cut the rows into ranges without a look at the data:
    the input is evaluated once. Rows with one key stay together, in no set order.
    """
    width = shuffle_width(df)
    order, part = fresh(df, "_order", "_range")
    lead = F.conv(F.left(order, F.lit(8)), 16, 10).cast("bigint")
    keyed = df.withColumn(order, hash_key(key, seed=seed)).withColumn(part, F.shiftright(lead * F.lit(width), 32).cast("int"))
    return keyed.repartitionById(width, part).sortWithinPartitions(order, key).drop(order, part)


def _hash_order(df: DataFrame, key: str, seed: int) -> DataFrame:
    digits = F.substr(hash_key(key, seed=seed), F.lit(1), F.lit(15))
    return df.withColumn("_hash", F.conv(digits, 16, 10).cast("bigint"))


def random_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` random rows of the frame, all of them if it is shorter. ``key`` is numeric, unique."""
    total = df.count()
    if n >= total:
        return df
    return top_k(_hash_order(df, key, seed), [("_hash", False), (key, False)], n).drop("_hash")


def required_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """As ``random_rows``, but too few rows are an error."""
    total = df.count()
    if total < n:
        raise ValueError(f"{n} rows requested, {total} available")
    return random_rows(df, n, key, seed)


def nested_subsets(df: DataFrame, sizes: list[int], key: str, seed: int = 42) -> DataFrame:
    """Random subsets where each contains the smaller ones; ``subset_size`` is the smallest
    size whose subset has the row. Source order is that of ``key``."""
    total = df.count()
    if max(sizes) > total:
        raise ValueError(f"{max(sizes)} rows requested, {total} available")
    ordered, chosen = sorted(set(sizes)), None
    rest = _hash_order(df, key, seed)
    marked = top_k(rest, [("_hash", False), (key, False)], ordered[-1])
    # cut points of the smaller sizes inside the largest subset
    size_of = F.lit(ordered[-1])
    for size in reversed(ordered[:-1]):
        cut, before = kth_value(marked, "_hash", size)
        tie, _ = kth_value(marked.filter(F.col("_hash") == cut), key, size - before)
        inside = (F.col("_hash") < cut) | ((F.col("_hash") == cut) & (F.col(key) <= tie))
        size_of = F.when(inside, F.lit(size)).otherwise(size_of)
    return marked.withColumn("subset_size", size_of).drop("_hash")


def first_rows(df: DataFrame, n: int, ordinal: str) -> DataFrame:
    """First ``n`` rows in source order (a preview; ``n`` is small)."""
    return df.orderBy(ordinal).limit(n)


def first_per_task(df: DataFrame, n: int, ordinal: str, task: str = "task") -> DataFrame:
    """First ``n`` rows of each task in source order (``n`` is small).

    The first ordinals of a task are found on two columns, ``n`` from each map task at most.
    """
    place = F.row_number().over(Window.partitionBy(task).orderBy(ordinal))
    first = df.select(task, ordinal).withColumn("_place", place).filter(F.col("_place") <= n)
    cut = first.groupBy(task).agg(F.max(ordinal).alias("_last"))
    kept = salted_join(df, cut, [task], [ordinal])
    return kept.filter(F.col(ordinal) <= F.col("_last")).select(*df.columns)


def quota_sample(
    df: DataFrame, quotas: dict[str, int], key: str, seed: int = 42, task: str = "task"
) -> DataFrame:
    """At most the quota of each task; tasks without a quota are kept whole."""
    pairs = [F.lit(x) for item in quotas.items() for x in item]
    limit = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(task)), F.col("_group_rows"))
    return sample_per_group(df, [task], limit, hash_key(key, seed=seed), [key])


def aligned(
    df: DataFrame, key: str, seed: int = 42, task: str = "task", mode: str = "mode"
) -> DataFrame:
    """Every mode of a task reduced to the rows of its smallest mode.

    A mode that lacks a task has no count for it and does not pull it to zero.
    """
    least = F.min("_group_rows").over(Window.partitionBy(task))
    return sample_per_group(df, [task, mode], least, hash_key(key, seed=seed), [key])


def alignment_report(df: DataFrame, task: str = "task", mode: str = "mode") -> DataFrame:
    """Rows per (task, mode) before and after alignment, with the check of mode totals."""
    sizes = df.groupBy(task, mode).agg(F.count(F.lit(1)).alias("n_before"))
    per_task = sizes.withColumn("n_after", F.min("n_before").over(Window.partitionBy(task)))
    totals = per_task.groupBy(mode).agg(F.sum("n_after").alias("mode_total"))
    equal = totals.agg(F.count_distinct("mode_total") == 1).scalar()
    return per_task.join(totals, mode).withColumn("totals_equal", equal)


def upsample(
    df: DataFrame,
    task: str,
    ordinal: str,
    target: int = UPSAMPLE_TARGET,
    copies: int = UPSAMPLE_COPIES,
    seed: int = 42,
) -> DataFrame:
    """Replicate small tasks; ``copy`` numbers the copies (draws) of a row.

    A task with ``target`` rows stays as it is, one that reaches it within ``copies``
    copies gets ``target`` draws with replacement, a smaller one is repeated.
    """
    sizes = df.groupBy(task).agg(F.count(F.lit(1)).alias("_n"))
    drawn = (F.col("_n") < target) & (F.col("_n") * copies >= target)

    times = F.when(F.col("_n") >= target, 1).otherwise(copies)
    repeated = (
        salted_join(df, sizes.filter(~drawn), [task], [ordinal])
        .withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
        .drop("_n")
    )
    # draw i of a task takes the row at a hashed position; positions come from counts
    draws = (
        sizes.filter(drawn)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(target))))
        .withColumn("_pos", hash_number(hash_key(F.col(task), F.col("copy"), seed=seed), F.col("_n")))
    )
    positions = cumulative_counts(
        salted_join(df.select(task, ordinal), sizes.filter(drawn).select(task), [task], [ordinal], "left_semi"),
        [task],
        ordinal,
    ).select(task, ordinal, F.col("before").alias("_pos"))
    picks = draws.join(positions, [task, "_pos"]).select(task, ordinal, "copy")
    return repeated.unionByName(df.join(picks, [task, ordinal]))


def upsample_report(
    df: DataFrame, task: str, target: int = UPSAMPLE_TARGET, copies: int = UPSAMPLE_COPIES
) -> DataFrame:
    n = F.col("original_count")
    final = F.when(n >= target, n).when(n * copies >= target, F.lit(target)).otherwise(n * copies)
    note = (
        F.when(n >= target, F.lit("unchanged"))
        .when(n * copies >= target, F.lit("upsampled"))
        .otherwise(F.lit("repeated"))
    )
    return (
        df.groupBy(task)
        .agg(F.count(F.lit(1)).alias("original_count"))
        .withColumns({"final_count": final.cast("bigint"), "note": note})
    )


def pick_one(items: Column, key: str | Column, seed: int = 42) -> Column:
    """One element of an array, uniformly by the hash of the record key; NULL if empty."""
    column = F.col(key) if isinstance(key, str) else key
    return F.when(
        F.size(items) > 0,
        F.get(items, hash_number(hash_key(column, seed=seed), F.size(items)).cast("int")),
    )


def chunk_number(position: Column, size: int) -> Column:
    """Number of the fixed-size batch a 0-based position falls into."""
    return F.floor(position / F.lit(size)).cast("bigint")
