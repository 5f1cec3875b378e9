"""Reports over generations, messages and token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.constants import EMPTY_THINK_TOKENS
from retort.functions.text import let, strip, word_count
from retort.functions.think import think_content, think_flags
from retort.operators.joins import matched
from retort.operators.records import explode_generations, keep_computed
from retort.operators.statistics import length_statistics, moments, percent
from retort.operators.stored import stored

FLAGS = ("has_close", "one_close", "has_open", "one_open", "valid_pair")


def think_flag_counts(df: DataFrame, group: str) -> DataFrame:
    """Flag counts per (group, generation) with percentages of the group's records."""
    total = df.groupBy(group).agg(F.count(F.lit(1)).alias("datapoints"))
    texts = explode_generations(df, "generated", group, name="text").filter(F.col("text").isNotNull())
    flags = texts.select(group, "gen_key", think_flags(F.col("text")).alias("f"))
    counts = flags.groupBy(group, "gen_key").agg(
        *[F.count_if(F.col(f"f.{name}")).alias(name) for name in FLAGS]
    )
    return counts.join(total, group).withColumns(
        {f"{name}_percent": percent(F.col(name), F.col("datapoints")) for name in FLAGS}
    )


def think_flag_averages(counts: DataFrame, group: str, strict: bool = True) -> DataFrame:
    """Mean percentages over a group's generations.

    As published, a generation for which no flag was ever true is not among those averaged;
    ``strict=False`` averages over all.
    """
    named = counts.filter(F.startswith("gen_key", F.lit("generation")))
    if strict:
        any_flag = F.lit(False)
        for name in FLAGS:
            any_flag = any_flag | (F.col(name) > 0)
        named = named.filter(any_flag)
    return named.groupBy(group).agg(*[F.avg(f"{name}_percent").alias(name) for name in FLAGS])


def think_word_statistics(df: DataFrame, group: str) -> DataFrame:
    """Complete and empty rationales and their word counts, per group and merged (NULL group)."""
    texts = explode_generations(df, "generated", group, name="text").filter(F.col("text").isNotNull())
    parsed = texts.select(group, think_content(F.col("text")).alias("c"))
    words = parsed.select(
        group,
        F.col("c").isNotNull().alias("complete"),
        (strip(F.col("c")) == "").alias("empty"),
        word_count(F.col("c")).alias("w"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return (
        words.rollup(group)
        .agg(
            F.count(F.lit(1)).alias("total_texts"),
            F.count_if("complete").alias("complete_think"),
            F.count_if("empty").alias("empty_in_complete"),
            F.coalesce(F.avg("w"), F.lit(0.0)).alias("word_mean"),
            F.coalesce(F.stddev_samp("w"), F.lit(0.0)).alias("word_std"),
        )
        .withColumns(
            {
                "complete_ratio": ratio("complete_think", "total_texts"),
                "empty_ratio": ratio("empty_in_complete", "complete_think"),
            }
        )
    )


def assistant_lengths(df: DataFrame, messages: str, *keep: str) -> DataFrame:
    """One row per assistant message with its word count."""
    return (
        df.select(*keep, F.explode_outer(messages).alias("m"))
        .filter((F.col("m.role") == "assistant") & F.col("m.content").isNotNull())
        .select(*keep, F.col("m.content").alias("content"), word_count(F.col("m.content")).alias("n_words"))
    )


def length_report(lengths: DataFrame, group: str, threshold: int = 20_000) -> DataFrame:
    """Word-count statistics per group and overall (NULL group)."""
    per_group = length_statistics(lengths, [group], "n_words", threshold)
    overall = length_statistics(lengths, [], "n_words", threshold).withColumn(
        group, F.lit(None).cast(lengths.schema[group].dataType)
    )
    return per_group.unionByName(overall)


def overlong_examples(lengths: DataFrame, group: str, ordinal: str, threshold: int, preview: int = 2000) -> DataFrame:
    """First message per group beyond the threshold, with a preview of its text."""
    over = lengths.filter(F.col("n_words") > threshold)
    first = over.groupBy(group).agg(
        F.min_by(
            F.struct(ordinal, "n_words", F.left("content", F.lit(preview)).alias("preview"), F.length("content").alias("n_chars")),
            F.col(ordinal),
        ).alias("e")
    )
    return first.select(
        group,
        f"e.{ordinal}",
        "e.n_words",
        "e.preview",
        "e.n_chars",
    )


# --- token arrays ----------------------------------------------------------------


def _mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v.cast("double")), F.size(values))


def token_means(df: DataFrame) -> DataFrame:
    """Per-sample means of the token arrays, with and without an empty leading rationale.

    If nothing follows the prefix, the means without it fall back to the full ones.
    """
    prefix = F.array(*[F.lit(t) for t in EMPTY_THINK_TOKENS])
    skipped = F.when(F.slice("token_strs", 1, 4) == prefix, F.lit(4)).otherwise(F.lit(0))
    df = df.withColumns({"n_tokens": F.size("token_probs"), "n_prefix": skipped})
    inner = (F.col("n_prefix") > 0) & (F.col("n_prefix") < F.col("n_tokens"))
    names = {"token_probs": "avg_prob", "token_ranks": "avg_rank", "token_top1_hits": "avg_top1_hit_rate"}
    df = df.withColumns({mean: _mean(F.col(array)) for array, mean in names.items()})
    rest = lambda array: F.slice(array, F.col("n_prefix") + 1, F.col("n_tokens"))
    return df.withColumns(
        {
            f"{mean}_excl": F.when(inner, _mean(rest(array))).otherwise(F.col(mean))
            for array, mean in names.items()
        }
    )


def task_moments(samples: DataFrame, task: str = "task") -> DataFrame:
    """Count, mean, deviation, G1 and G2 of the sample means, per task and overall (NULL)."""
    columns = ("avg_prob", "avg_rank", "avg_top1_hit_rate")
    aggs = [m for c in columns for m in moments(F.col(c), c)]
    return samples.rollup(task).agg(F.count(F.lit(1)).alias("n_samples"), *aggs)


def exploded_tokens(df: DataFrame, *keep: str) -> DataFrame:
    zipped = F.arrays_zip(F.col("token_ranks").alias("rank"), F.col("token_probs").alias("prob"))
    return df.select(*keep, F.inline_outer(zipped)).filter(F.col("rank").isNotNull())


def task_comparison(first: DataFrame, second: DataFrame, task: str = "task") -> DataFrame:
    """Mean probability and rank of two models on the tasks both have."""

    def means(df: DataFrame, suffix: str) -> DataFrame:
        return df.groupBy(task).agg(
            F.avg("avg_prob").alias(f"avg_prob_{suffix}"),
            F.avg("avg_rank").alias(f"avg_rank_{suffix}"),
            F.count(F.lit(1)).alias(f"n_{suffix}"),
        )

    return means(first, "m1").join(means(second, "m2"), task)


def paradox_examples(first: DataFrame, second: DataFrame, ordinal: str, n: int = 20) -> DataFrame:
    """Samples the second model finds likelier though their mean rank is over twice as bad.

    The ``n`` largest rank ratios, for a report. They are found on the means alone; texts and
    token arrays are fetched for those samples only, of both models by a broadcast of the ``n`` rows.
    """
    slim = ["sample_id", ordinal, "avg_prob", "avg_rank"]
    pairs = matched(first.select(*slim), second.select(*slim), "sample_id", ordinal)
    ratio = F.col("avg_rank_2") / F.col("avg_rank")
    gain = F.col("avg_prob_2") - F.col("avg_prob")
    scored = pairs.withColumns(
        {"rank_ratio": F.when(F.col("avg_rank") >= 1e-6, ratio), "prob_diff": gain}
    )
    odd = (F.col("prob_diff") > 0) & (F.col("rank_ratio") > 2)
    top = keep_computed(scored, odd).orderBy(F.desc("rank_ratio"), ordinal).limit(n)
    top = top.select("sample_id", ordinal, f"{ordinal}_2", "rank_ratio", "prob_diff")
    top = stored(top, "paradox")  # found once for both
    theirs = second.select("sample_id", *[F.col(c).alias(f"{c}_2") for c in second.columns if c != "sample_id"])
    theirs = theirs.join(F.broadcast(top), ["sample_id", f"{ordinal}_2"])
    wide = first.join(F.broadcast(top.select("sample_id", ordinal)), ["sample_id", ordinal])
    # at most n rows on each side are left
    return wide.join(F.broadcast(theirs), ["sample_id", ordinal]).orderBy(F.desc("rank_ratio"), ordinal)


def high_rank_tokens(strs: Column, ranks: Column, probs: Column, above: int = 50, n: int = 8) -> Column:
    """The ``n`` worst-ranked tokens beyond rank ``above``, earlier tokens first on a tie."""
    zipped = F.arrays_zip(strs.alias("token"), ranks.alias("rank"), probs.alias("prob"))
    keyed = F.transform(
        zipped,
        lambda t, i: F.struct((-t["rank"]).alias("_order"), i.alias("at"), t["token"].alias("token"), t["rank"].alias("rank"), t["prob"].alias("prob")),
    )
    return let(
        F.filter(keyed, lambda t: t["rank"] > above),
        lambda a: F.transform(
            F.slice(F.array_sort(a), 1, n),
            lambda t: F.struct(t["token"].alias("token"), t["rank"].alias("rank"), t["prob"].alias("prob")),
        ),
    )


def target_rank(distribution: Column, target: Column) -> Column:
    """1-based rank of a probability within a distribution: larger ones plus one."""
    return F.size(F.filter(distribution, lambda p: p > target)) + 1


def divergence_means(samples: DataFrame, task: str = "task", value: str = "kl") -> DataFrame:
    """Mean divergence per task and over all samples (NULL task)."""
    return samples.rollup(task).agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg(value).alias("mean_kl")
    )
