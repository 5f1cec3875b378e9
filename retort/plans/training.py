"""Training sets from judged records: select, reshape, balance, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.constants import MARKERS_KEEP_TAGS, TASK_QUOTAS
from retort.functions.think import chemistry_think, repair_chemistry
from retort.operators.records import keep_computed, prompt_text, strip_markers, to_sharegpt
from retort.operators.sampling import aligned, pick_one, quota_sample, shuffled
from retort.plans.answers import CORRECT


def candidates(df: DataFrame, think_rules: bool = True) -> DataFrame:
    """Adds ``n_correct`` and ``candidates`` (STRUCT<key, text> a record may be drawn from).

    With ``think_rules`` only correct, non-empty texts with valid rationale tags qualify and
    a missing open tag is put in front. Without, every correct generation is a candidate,
    even one without text.
    """
    right = F.map_keys(F.map_filter(F.col(CORRECT), lambda k, v: F.coalesce(v, F.lit(False))))
    texts = F.col("generated")
    if think_rules:

        def entry(key: Column) -> Column:
            text = F.coalesce(F.try_element_at(texts, key), F.lit(""))
            case = chemistry_think(text)
            return F.struct(key.alias("key"), text.alias("text"), case.alias("case"))

        judged = F.filter(F.transform("_right", entry), lambda c: c["case"].isNotNull())
        drawn = F.transform(
            judged,
            lambda c: F.struct(c["key"].alias("key"), repair_chemistry(c["text"], c["case"]).alias("text")),
        )
    else:
        drawn = F.transform(
            "_right",
            lambda k: F.struct(k.alias("key"), F.coalesce(F.try_element_at(texts, k), F.lit("")).alias("text")),
        )
    empty = F.array().cast("array<string>")
    return (
        df.withColumn("_right", F.coalesce(right, empty))
        .withColumns({"n_correct": F.size("_right"), "candidates": drawn})
        .drop("_right")
    )


def chosen(judged: DataFrame, seed: int = 42) -> DataFrame:
    """One candidate per record by the hash of its id; records without text or prompt leave."""
    prompted = F.size(F.try_variant_get("prompt", "$", "array<variant>")) > 0
    picked = judged.filter(prompted).withColumn(
        "_pick", pick_one(F.col("candidates"), "sample_id", seed)
    )
    return (
        keep_computed(picked, F.col("_pick.text") != "")
        .withColumns({"chosen_key": F.col("_pick.key"), "chosen_text": F.col("_pick.text")})
        .drop("_pick", "candidates")
    )


def training_records(judged: DataFrame, seed: int = 42) -> DataFrame:
    picked = chosen(judged, seed)
    return to_sharegpt(picked, prompt_text(F.col("prompt")), F.col("chosen_text"))


def quota_records(
    records: DataFrame, quotas: dict[str, int] | None = None, seed: int = 42
) -> DataFrame:
    return quota_sample(records, TASK_QUOTAS if quotas is None else quotas, "sample_id", seed)


def selection_report(judged: DataFrame, groups: list[str], seed: int = 42) -> DataFrame:
    """Rows per group and in total: all, with a correct generation, and chosen.

    The total row has NULL groups.
    """
    pick = pick_one(F.col("candidates"), "sample_id", seed)
    saved = F.coalesce(pick["text"] != "", F.lit(False)) & (
        F.coalesce(F.size(F.try_variant_get("prompt", "$", "array<variant>")), F.lit(0)) > 0
    )
    slim = judged.select(*groups, "n_correct", saved.alias("_saved"))
    return slim.rollup(*groups).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("n_correct") > 0).alias("filtered"),
        F.sum("n_correct").alias("correct_generations"),
        F.count_if("_saved").alias("saved"),
    )


def merged_modes(records: DataFrame, seed: int = 42) -> DataFrame:
    """Modes aligned task by task, markers stripped, each mode in shuffled order.

    ``records`` has ``task``, ``mode``, ``sample_id`` and ``messages``; write the result with
    ``partitionBy("mode")``.
    """
    ordered = shuffled(aligned(records, "sample_id", seed), "sample_id", seed)
    # behind the sort, whose range sampling would otherwise strip every text twice
    return ordered.withColumn("messages", strip_markers(F.col("messages"), MARKERS_KEEP_TAGS))
