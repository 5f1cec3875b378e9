"""Importance resampling towards a target distribution, over hashed word n-grams.

Texts are read as UTF-8 bytes: a table of 256 bytes lower-cases A-Z and blanks what separates
words, ``bytes.split`` yields the words, and an n-gram's checksum is the chained ``zlib.crc32``
of its words, each seeded by the one before, so that n-grams are never joined. ``Counter`` reduces
the checksums of a piece of text; only counts per bucket leave a task.

A document's weight is the sum over its features of the log ratio of target to corpus in the
feature's bucket. A seeded Gumbel draw is added, and the highest scores are the sample: drawing
without replacement in proportion to the weights.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.llm.text import saved
from retort.operators.stored import with_ordinals

NGRAM = 1
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"

#: Bytes of a text split at once; a longer text goes in runs that end between words.
BLOCK_BYTES = 1 << 20
#: Different checksums a task counts before it adds them to the buckets.
MAX_COUNTED = 1 << 17

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEPT else 32 for c in range(256))


def _blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in runs of about ``BLOCK_BYTES``."""
    at = 0
    while at < len(text):
        piece = text[at : at + BLOCK_BYTES].translate(TABLE)
        end = at + len(piece)
        while end < len(text):  # up to the end of the last word
            cut = piece.rfind(b" ")
            if cut >= 0:
                piece, end = piece[: cut + 1], end - len(piece) + cut + 1
                break
            more = text[end : end + BLOCK_BYTES].translate(TABLE)
            piece, end = piece + more, end + len(more)
        at = end
        yield piece.split()


def checksums(text: bytes, ngram: int = NGRAM) -> Iterator[tuple[int, list[int]]]:
    """(words, checksums of the runs of 1 to ``ngram`` words that end in them) by block of a text."""
    held: list[bytes] = []  # the last words of the blocks before
    for words in _blocks(text):
        if not words:
            continue
        run = held + words
        level = list(map(zlib.crc32, run))
        out = level[len(held) :]
        spaced = [b" " + w for w in run] if ngram > 1 else []
        for n in range(2, ngram + 1):
            # level[i] is the checksum of the n - 1 words from i on; the word behind them extends it
            level = list(map(zlib.crc32, spaced[n - 1 :], level))
            # of the runs, those that end in this block are new
            out += level[max(0, len(held) - n + 1) :]
        held = run[max(0, len(run) - ngram + 1) :] if ngram > 1 else []
        yield len(words), out


def _texts(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def bucket_counts(texts: DataFrame, text_col: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts per bucket; buckets without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(buckets, np.int64), Counter()

        def settle() -> None:
            if seen:
                sums, counts = np.fromiter(seen.keys(), np.int64, len(seen)), np.fromiter(seen.values(), np.int64, len(seen))
                np.add.at(total, sums % buckets, counts)
                seen.clear()

        for batch in batches:
            for text in _texts(batch.column(0)):
                for _, sums in checksums(text, ngram):
                    seen.update(sums)
                    if len(seen) > MAX_COUNTED:
                        settle()
        settle()
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.array(total[filled])], ["bucket", "n"])

    parts = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket, from the bucket counts of both sides."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    )
    every = both.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    sums = both.unionByName(every).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    sums = saved(sums, "importance-sums")  # one row per bucket
    whole = lambda c: sums.agg(F.sum(c).alias("n")).select("n").scalar() + F.lit(float(buckets))
    ratio = ((F.col("t") + 1) * whole("s")) / ((F.col("s") + 1) * whole("t"))
    return sums.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def weights(docs: DataFrame, gain: DataFrame, id_col: str, text_col: str, ngram: int, buckets: int) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row. The gains, one per bucket, go with the tasks."""
    table = np.zeros(buckets, np.int64)
    for row in gain.collect():
        table[row["bucket"]] = row["gain"]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, 3), np.int64)
            for k, text in enumerate(_texts(batch.column(1))):
                for n_words, sums in checksums(text, ngram):
                    cells = np.fromiter(sums, np.int64, len(sums)) % buckets
                    found[k] += (n_words, len(sums), table[cells].sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in found.T)], ["doc_id", "n_words", "n_features", "weight"]
            )

    return rows.mapInArrow(run, f"doc_id {id_type}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """Thousandfold Gumbel draw of an identifier, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resampled(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    ngram: int = NGRAM,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: str = SEED,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_features, weight, score, rank.

    ``percent`` of the rows with at least ``min_words`` words (rounded down) are drawn, those of
    highest score, ties to the smaller identifier, a null one last; ``rank`` is their place in
    that order, null for all others. Rows that share identifier and score follow one another in
    no set order. Null and empty texts have no features and weight 0. A null identifier draws as
    the text ``null``. An empty ``docs`` gives an empty result, an empty ``target`` equal odds per
    bucket; other columns are not read. Texts are counted whole, in blocks, and all rows count.
    """
    gain = gains(bucket_counts(docs, text_col, ngram, buckets), bucket_counts(target, target_text_col, ngram, buckets), buckets)
    rows = weights(docs, gain, id_col, text_col, ngram, buckets)
    # rows of one identifier may be many: the number tells them apart in the sort by ranges
    rows = saved(rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id()), "importance-rows")
    able = F.col("n_words") >= min_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    ranked = with_ordinals(rows.filter(able), order, "place")
    drawn = F.floor(rows.agg(F.count_if(able).alias("n")).select("n").scalar() * percent / 100)
    ranked = ranked.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")))
    others = rows.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    return ranked.drop("place").unionByName(others).drop("row")
