"""Answer extraction and correctness over inference records.

Records keep their maps (generation -> text / answer / correctness). Everything is done
inside the maps, so a whole extraction pass is one scan without a shuffle. Records of
other tasks pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort import constants as K
from retort.functions import chem, extract
from retort.functions.text import let
from retort.operators.statistics import percent

ANSWER = "extracted_core_answer"
CORRECT = "extracted_core_answer_correctness"
STRATEGY = "extraction_strategy"

_CORRECT_TYPE = "map<string,boolean>"
_STRATEGY_TYPE = "map<string,string>"


def _updated(
    df: DataFrame,
    member: Column,
    resolve: Callable[[Column, Column], Column],
    correct: Callable[[Column], Column],
) -> DataFrame:
    """Replace answers by ``resolve(text, stored)`` (STRUCT<answer, strategy>) and mark them."""
    for name, kind in ((CORRECT, _CORRECT_TYPE), (STRATEGY, _STRATEGY_TYPE)):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    stored = F.coalesce(F.col(ANSWER), F.create_map().cast("map<string,string>"))
    texts = F.col("generated")

    def entry(key: Column, value: Column) -> Column:
        text = F.coalesce(F.try_element_at(texts, key), F.lit(""))
        return resolve(text, F.coalesce(value, F.lit("")))

    df = df.withColumn("_new", F.when(member, F.transform_values(stored, entry)))
    mine = F.col("_new").isNotNull()
    answers = F.transform_values("_new", lambda k, v: v["answer"])
    marks = F.transform_values("_new", lambda k, v: correct(v["answer"]))
    used = F.transform_values("_new", lambda k, v: v["strategy"])
    return df.withColumns(
        {
            ANSWER: F.when(mine, answers).otherwise(F.col(ANSWER)),
            CORRECT: F.when(mine, marks).otherwise(F.col(CORRECT)),
            STRATEGY: F.when(mine, used).otherwise(F.col(STRATEGY)),
        }
    ).drop("_new")


def _found(found: Column) -> Column:
    return F.struct(
        F.coalesce(found["value"], F.lit("")).alias("answer"),
        F.coalesce(found["strategy"], F.lit("not_extracted")).alias("strategy"),
    )


def _if_empty(stored: Column, cascade: Column) -> Column:
    """Keep a stored answer (strategy NULL); extract only where it is empty."""
    kept = F.struct(stored.alias("answer"), F.lit(None).cast("string").alias("strategy"))
    return F.when(stored != "", kept).otherwise(let(cascade, _found))


def answer_booleans(df: DataFrame, keep_tag_hits: bool = True) -> DataFrame:
    """Yes/No tasks: the cascade always runs again.

    A hit in the answer tag leaves the stored answer in place and counts for no strategy;
    with ``keep_tag_hits=False`` it is written like any other hit.
    """

    def resolve(text: Column, stored: Column) -> Column:
        def write(hit: Column) -> Column:
            written = F.struct(
                extract.yes_no(hit["value"]).alias("answer"),
                F.coalesce(hit["strategy"], F.lit("not_extracted")).alias("strategy"),
            )
            if not keep_tag_hits:
                return written
            kept = F.struct(stored.alias("answer"), F.lit(None).cast("string").alias("strategy"))
            return F.when(hit["strategy"] == "boolean_tags", kept).otherwise(written)

        return let(extract.boolean_cascade(text), write)

    return _updated(
        df,
        F.col("task").isin(*K.BOOL_TASKS),
        resolve,
        lambda a: extract.boolean_equal(a, F.col("ground_truth")),
    )


def answer_numbers(df: DataFrame, tolerance: float = 1.0) -> DataFrame:
    return _updated(
        df,
        F.col("task").isin(*K.NUM_TASKS),
        lambda text, stored: _if_empty(stored, extract.number_cascade(text)),
        lambda a: extract.number_within(a, F.col("ground_truth"), tolerance),
    )


def answer_texts(df: DataFrame, normalize: bool = True) -> DataFrame:
    """Formula and systematic-name tasks."""
    task = F.col("task")
    return _updated(
        df,
        task.isin(*K.TEXT_TASKS),
        lambda text, stored: _if_empty(stored, extract.text_cascade(text, task)),
        lambda a: chem.text_equal(a, F.col("ground_truth"), task, normalize),
    )


def answer_molecules(
    df: DataFrame, equal: Callable[[Column, Column], Column] = chem.fragments_equal
) -> DataFrame:
    """Molecule-string tasks. ``equal`` decides correctness on (answer, truth) columns.

    The default compares fragment strings. For chemical equality use
    ``mark_molecules`` with RDKit on the executors.
    """
    task = F.col("task")
    return _updated(
        df,
        task.isin(*K.SMILES_TASKS),
        lambda text, stored: _if_empty(stored, chem.smiles_cascade(text, task)),
        lambda a: equal(a, F.col("ground_truth")),
    )


def mark_molecules(df: DataFrame, same: Callable[[Column, Column], Column]) -> DataFrame:
    """Correctness by an array-level UDF ``same(answers, truth) -> ARRAY<DOUBLE>`` (1 = equal)."""
    member = F.col("task").isin(*K.SMILES_TASKS)
    scores = same(F.map_values(ANSWER), F.col("ground_truth"))
    marks = F.map_from_arrays(F.map_keys(ANSWER), F.transform(scores, lambda s: s == 1.0))
    return df.withColumn(CORRECT, F.when(member, marks).otherwise(F.col(CORRECT)))


def answer_captions(
    df: DataFrame,
    score: Callable[[Column, Column], Column],
    threshold: float = 0.4,
    enable_thinking: bool = True,
) -> DataFrame:
    """Caption task: score per generation in ``caption_score``, correct from ``threshold`` on.

    ``score`` is an array-level scorer; other tasks hand it an empty array.
    """
    member = F.col("task") == K.CAPTION_TASK
    texts = F.when(
        member,
        F.transform(F.map_values("generated"), lambda t: extract.caption_text(t, enable_thinking)),
    ).otherwise(F.array().cast("array<string>"))
    scored = df.withColumn("_texts", texts).withColumn("_scores", score(F.col("_texts"), F.col("ground_truth")))
    scores = F.when(member, F.map_from_arrays(F.map_keys("generated"), F.col("_scores")))
    return rethreshold(
        scored.withColumn("caption_score", scores).drop("_texts", "_scores"), threshold
    )


def rethreshold(df: DataFrame, threshold: float) -> DataFrame:
    """Correctness of the caption task from stored scores; unscored generations are wrong."""
    marks = F.transform_values(
        "caption_score", lambda k, v: F.coalesce(v >= F.lit(threshold), F.lit(False))
    )
    current = F.col(CORRECT) if CORRECT in df.columns else F.lit(None).cast(_CORRECT_TYPE)
    return df.withColumn(CORRECT, F.when(F.col("task") == K.CAPTION_TASK, marks).otherwise(current))


# --- reports -------------------------------------------------------------------


def _hits(marks: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.map_values(marks), lambda v: v)), F.lit(0))


def extraction_report(df: DataFrame, tasks: tuple[str, ...], groups: list[str] | None = None) -> DataFrame:
    """Lines, fresh extractions and correct generations.

    ``accuracy`` is correct generations per line of the file in percent, as published (it
    can pass 100); ``correct_rate`` divides by generations.
    """
    member = F.col("task").isin(*tasks)
    used = F.filter(F.map_values(STRATEGY), lambda s: s.isNotNull() & (s != "not_extracted"))
    zero = F.lit(0)
    fresh = F.when(member, F.coalesce(F.size(used), zero)).otherwise(zero)
    right = F.when(member, _hits(F.col(CORRECT))).otherwise(zero)
    made = F.when(member, F.coalesce(F.size(ANSWER), zero)).otherwise(zero)
    return (
        df.groupBy(*(groups or []))
        .agg(
            F.count(F.lit(1)).alias("total_lines"),
            F.sum(made).alias("generations"),
            F.sum(fresh).alias("extracted"),
            F.sum(right).alias("correct"),
        )
        .withColumns(
            {
                "accuracy": percent(F.col("correct"), F.col("total_lines")),
                "correct_rate": percent(F.col("correct"), F.col("generations")),
                "accuracy_of_extracted": percent(F.col("correct"), F.col("extracted")),
            }
        )
    )


def strategy_counts(df: DataFrame, tasks: tuple[str, ...], groups: list[str] | None = None) -> DataFrame:
    """How often each rule produced the answer."""
    return (
        df.filter(F.col("task").isin(*tasks))
        .select(*(groups or []), F.explode_outer(F.map_values(STRATEGY)).alias("strategy"))
        .filter(F.col("strategy").isNotNull())
        .groupBy(*(groups or []), "strategy")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def caption_report(df: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Caption generations with and without a score, accuracy over all, and score range."""
    own = F.col("task") == K.CAPTION_TASK
    values = F.when(own, F.map_values("caption_score"))
    scored = F.filter(values, lambda v: v.isNotNull())
    summed = F.aggregate(scored, F.lit(0.0), lambda a, v: a + v)
    zero = F.lit(0)
    return (
        df.groupBy(*(groups or []))
        .agg(
            F.count(F.lit(1)).alias("total_lines"),
            F.count_if(own).alias("task_lines"),
            F.sum(F.coalesce(F.size(values), zero)).alias("generations"),
            F.sum(F.coalesce(F.size(scored), zero)).alias("scored"),
            F.sum(F.when(own, _hits(F.col(CORRECT))).otherwise(zero)).alias("meeting"),
            F.sum(summed).alias("_sum"),
            F.coalesce(F.max(F.array_max(scored)), F.lit(0.0)).alias("max_score"),
            F.coalesce(F.min(F.array_min(scored)), F.lit(0.0)).alias("min_score"),
        )
        .withColumns(
            {
                "accuracy": percent(F.col("meeting"), F.col("generations")),
                "avg_score": F.coalesce(F.try_divide(F.col("_sum"), F.col("scored")), F.lit(0.0)),
            }
        )
        .drop("_sum")
    )
