"""Translation results: scoring, tag repair, best generation, top share, chats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.functions.think import translation_think
from retort.operators.ranking import top_k
from retort.operators.records import best_key, chat, keep_computed
from retort.operators.sampling import shuffled
from retort.operators.statistics import score_summary
from retort.operators.stored import stored

_SCORES = "map<string,double>"


def scored(df: DataFrame, score: Callable[[Column, Column], Column]) -> DataFrame:
    """Fill ``spbleu``, ``best_spbleu`` and ``best_generation_key`` of unscored records.

    Records that have ``spbleu`` keep theirs and cost no scoring: the scorer gets a null
    array for them. A record without translations gets an empty map, 0.0 and no key.
    """
    for name, kind in (("spbleu", _SCORES), ("best_spbleu", "double"), ("best_generation_key", "string")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    todo = F.col("spbleu").isNull()
    pairs = F.coalesce(F.col("extracted_translation"), F.create_map().cast("map<string,string>"))
    df = df.withColumn("_scores", score(F.when(todo, F.map_values(pairs)), F.col("gold_answer")))
    df = df.withColumn("_new", F.when(todo, F.map_from_arrays(F.map_keys(pairs), F.col("_scores"))))
    df = df.withColumn("_best", best_key(F.col("_new")))
    return df.withColumns(
        {
            "spbleu": F.coalesce("_new", "spbleu"),
            "best_spbleu": F.when(todo, F.coalesce(F.col("_best.score"), F.lit(0.0))).otherwise(F.col("best_spbleu")),
            "best_generation_key": F.when(todo, F.col("_best.key")).otherwise(F.col("best_generation_key")),
        }
    ).drop("_scores", "_new", "_best")


def think_checked(df: DataFrame) -> DataFrame:
    """Repair generations, choose the best among valid ones, set ``think_tag_valid``.

    A record without valid scored generation gets -1.0, no key and False. A record without
    generations is left as it is. ``think_counts`` holds ok / fixed / invalid per record.
    """
    if "think_tag_valid" not in df.columns:
        df = df.withColumn("think_tag_valid", F.lit(None).cast("boolean"))
    has = F.coalesce(F.size("generated"), F.lit(0)) > 0
    df = df.withColumn("_checked", F.transform_values("generated", lambda k, t: translation_think(t)))
    valid = F.map_filter("_checked", lambda k, v: v["valid"])
    usable = F.map_filter(
        F.transform_values(valid, lambda k, v: F.try_element_at(F.col("spbleu"), k)),
        lambda k, s: s.isNotNull(),
    )
    df = df.withColumn("_best", best_key(usable))
    found = F.col("_best").isNotNull()
    repaired = F.transform_values("_checked", lambda k, v: v["text"])

    def counted(test: Callable[[Column, Column], Column]) -> Column:
        return F.size(F.map_filter("_checked", lambda k, v: test(v, F.try_element_at(F.col("generated"), k))))

    counts = F.struct(
        counted(lambda v, t: v["valid"] & (v["text"] == t)).alias("ok"),
        counted(lambda v, t: v["valid"] & (v["text"] != t)).alias("fixed"),
        counted(lambda v, t: ~v["valid"]).alias("invalid"),
    )
    return (
        df.withColumn("think_counts", F.when(has, counts))
        .withColumns(
            {
                "generated": F.coalesce(repaired, "generated"),
                "best_spbleu": F.when(has & found, F.col("_best.score")).when(has, F.lit(-1.0)).otherwise(F.col("best_spbleu")),
                "best_generation_key": F.when(has, F.col("_best.key")).otherwise(F.col("best_generation_key")),
                "think_tag_valid": F.when(has, found).otherwise(F.col("think_tag_valid")),
            }
        )
        .drop("_checked", "_best")
    )


def valid_records(df: DataFrame) -> DataFrame:
    """Records not marked invalid; an absent mark counts as valid."""
    return keep_computed(df, F.coalesce(F.col("think_tag_valid"), F.lit(True)))


def top_share(
    df: DataFrame, ratio: float = 0.2, ordinal: str = "ordinal", score: str = "best_spbleu",
    skip_validation: bool = False,
) -> DataFrame:
    """Best records by score, input order deciding ties.

    The number kept is ``ratio`` of *all* records (one at least), limited to valid ones.
    """
    valid = df if skip_validation else valid_records(df)
    valid = valid.withColumn(score, F.coalesce(F.col(score), F.lit(0.0)))
    k = max(1, int(df.count() * ratio))
    return top_k(valid, [(score, True), (ordinal, False)], k, computed=True)


def share_report(df: DataFrame, kept: DataFrame, score: str = "best_spbleu") -> DataFrame:
    """Summary of valid scores beside that of the kept share, whose minimum is the threshold."""
    whole = score_summary(valid_records(df), score).select(F.lit("valid").alias("part"), "avg", "median", "min", "max")
    top = score_summary(kept, score).select(F.lit("kept").alias("part"), "avg", "median", "min", "max")
    return whole.unionByName(top)


def share_summary(df: DataFrame, ratio: float = 0.2, ordinal: str = "ordinal", score: str = "best_spbleu") -> DataFrame:
    """``share_report`` of the top share of ``df``, whose scores and marks are derived once and written."""
    scores = stored(df.select(ordinal, score, "think_tag_valid"), "share-scores")
    return share_report(scores, top_share(scores, ratio, ordinal, score), score)


def chats(df: DataFrame, system: str | None = None, seed: int = 42) -> DataFrame:
    """Shuffled chat records with the best generation as the answer."""
    answer = F.coalesce(F.try_element_at("generated", F.col("best_generation_key")), F.lit(""))
    return shuffled(
        df.select(
            chat(F.col("user_content"), answer, system).alias("messages"),
            F.coalesce("sample_id", F.lit("")).alias("sample_id"),
            F.coalesce("gold_answer", F.lit("")).alias("gold_answer"),
            F.coalesce("best_spbleu", F.lit(0.0)).alias("best_spbleu"),
            "best_generation_key",
            "spbleu",
        ),
        "sample_id",
        seed,
    )
