"""Incremental generation and scoring: each request is answered once, restarts included."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from retort.operators.joins import last_per_key
from retort.operators.stored import fresh


#: Folders that results are dealt to by a hash of their identifier.
PREFIXES = 64


def _prefix(sample_id: str = "sample_id") -> Column:
    return F.pmod(F.xxhash64(sample_id), F.lit(PREFIXES)).cast("int")


def _results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch BIGINT, prefix INT").parquet(folder)


def stored_results(spark: SparkSession, folder: str, schema: str, *derived: Column) -> DataFrame:
    """Results of all finished batches, the latest per ``sample_id``; with ``derived`` only the
    identifier and these columns, derived before rows move."""
    rows = _results(spark, folder, schema)
    if derived:
        rows = rows.select("sample_id", *derived, "batch", "prefix")
    return last_per_key(rows, ["sample_id"], "batch").drop("batch", "prefix")


def answered_before(batch: DataFrame, number: int, folder: str, schema: str) -> DataFrame:
    """Identifiers that earlier batches answered, of the prefixes that ``batch`` has.

    The prefixes, 64 at most, are found first, so that only their folders are listed and read.
    """
    mine = sorted(r[0] for r in batch.select(_prefix().alias("p")).distinct().collect())
    done = _results(batch.sparkSession, folder, schema)
    return done.filter(F.col("prefix").isin(mine) & (F.col("batch") < number)).select("sample_id")


def answer_stream(
    requests: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    folder: str,
    checkpoint: str,
    schema: str,
) -> StreamingQuery:
    """Answer new requests of a streaming frame into ``folder`` and stop when none are left.

    ``answer`` maps pending requests to results with ``sample_id`` (a model call belongs in
    its ``mapInPandas``). A batch writes its own ``batch=N`` folder, dealt to prefixes of the
    identifiers' hash, and overwrites just that when it is replayed, so a lost executor or driver
    leaves neither gaps nor doubles. Requests answered by earlier batches are left out by the
    identifiers in the history of the batch's own prefixes.
    """

    def run(batch: DataFrame, number: int) -> None:
        (row, done) = fresh(batch, "_row", "_done")
        rows = batch.select("sample_id", F.struct(*batch.columns).alias(row), F.lit(False).alias(done))
        if number:
            rows = rows.unionByName(answered_before(batch, number, folder, schema).dropna().withColumn(done, F.lit(True)), allowMissingColumns=True)
        # requests move once: dealt by prefix, they are told apart and written where they are
        rows = rows.withColumn("prefix", _prefix()).repartition("prefix").groupBy("prefix", "sample_id")
        rows = rows.agg(F.max(done).alias(done), F.any_value(row).alias(row))
        todo = rows.filter(~F.col(done)).select(f"{row}.*")
        results = answer(todo).withColumn("prefix", _prefix())
        results.write.mode("overwrite").partitionBy("prefix").parquet(f"{folder}/batch={number}")

    return (
        requests.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def score_new(records: DataFrame, score: Callable[[DataFrame], DataFrame], column: str = "spbleu") -> DataFrame:
    """Score the records that have no score yet and leave the others as they are."""
    old = records.filter(F.col(column).isNotNull())
    new = score(records.filter(F.col(column).isNull()))
    return old.unionByName(new, allowMissingColumns=True)
