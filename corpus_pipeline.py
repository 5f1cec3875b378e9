"""A corpus pipeline in five stages, each over all that the one before kept."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.llm import bpe, exact, mixing, ngram_join, toxicity
from retort.llm.text import release, release_paths, saved, scratch, small_batches
from retort.operators.stored import fresh
from retort.queries.registry import table

#: What the stage before wrote for itself; the next stage, which reads that stage's rows, lets it go.
_written: list[str] = []


def _stage(fn):
    """A stage that begins by deleting the former stage's intermediate frames.

    A stage's result must be written before the next stage is called, as ``run`` does.
    """

    @wraps(fn)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_paths(spark, _written)
        with scratch() as paths:
            result = fn(spark, docs, sf_dir)
        _written.extend(paths)
        return result

    return stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network doesn't reject."""
    held_out = F.coalesce(F.crc32(F.col("id").cast("string")) % 3 == 1, F.lit(False))
    weights = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", lambda _: ~held_out)
    return toxicity.clean_documents(docs, weights)


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the smallest identifier."""
    rows, key = _numbered(docs)
    kept = exact.exact_groups(rows, id_col=key).filter("kept").select(F.col("doc_id").alias(key))
    return rows.join(kept, key, "left_semi").select(docs.columns)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: that with the smallest identifier."""
    rows, key = _numbered(docs)
    found = ngram_join.near_duplicates(rows, id_col=key)
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(key))
    return rows.join(kept, key, "left_semi").select(docs.columns)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights; a document is repeated as often as it is taken."""
    return mixing.mixed_documents(docs)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of what they decode to."""
    coded = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    with small_batches(spark):  # the workers' tables leave little room for large batches
        return saved(coded, "pipeline-coded")


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written, each with a key of its own that follows the identifiers' order, nulls last; its name.

    Identifiers may be null or repeated; the key makes one row of a group the one that stays: that
    with the smallest identifier, and of those that share it the first in the files. The key follows
    the splits of one scan, which another scan need not repeat, so the rows are written first.
    """
    (name,) = fresh(docs, "_row")
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.monotonically_increasing_id().alias("row"))
    return saved(docs.withColumn(name, key), "pipeline-rows"), name


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL can't express the first and the last stage; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's rows go when the next has its own."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"pipeline-stage-{k + 1}")
        release(before)
    return docs
