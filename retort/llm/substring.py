"""Removal of word passages that occur more than once, by level-wise doubling.

A window of ``size`` words can occur twice only if what is inside it does. Candidates are found at
a quarter of the size and extended to twice that length, and again, each time only where the
shorter one is repeated:

* quarter: of the short windows inside a full window the one with the smallest hash is its anchor,
  so equal full windows have equal anchors at equal places; only anchors are counted;
* half: around a repeated anchor, the half-size windows that end and that begin with it, one of
  which is inside any full window of that anchor;
* full: the windows of each repeated half-size window and its anchor, counted by a 96-bit hash.

Counts are aggregated before they are shuffled, and positions find their counts by a join that
can be split, so a passage that very many documents share is no one task's. Texts with equal words
are one class: a class of more than one row is repeated throughout, and one of its texts per task
stands for it in the search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.llm.text import CHUNK_BYTES, Words, pieces, release, saved, signed

SIZE = 35


def _class_ids(words: Words) -> np.ndarray:
    return words.spans(words.bounds[:-1], words.bounds[1:])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class, number of words, and the digest of all words, of each row."""
    for batch in batches:
        for piece in pieces(batch, "text", CHUNK_BYTES):
            words = Words(piece.column("text"))
            digests = []
            for text in piece.column("text").to_pylist():
                digests.append(hashlib.sha256(b" ".join((text or "").encode().split())).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), signed(_class_ids(words)), pa.array(words.counts.astype(np.int64)), pa.array(digests)],
                ["doc_id", "cls", "n_words", "kept_sha256"],
            )


def _first_of_class(piece: pa.RecordBatch, words: Words, seen: set) -> np.ndarray:
    """Rows whose class this task meets for the first time."""
    keys = list(zip(_class_ids(words).tolist(), words.counts.tolist(), strict=True))
    first = np.zeros(len(keys), bool)
    for i, key in enumerate(keys):
        if key not in seen:
            seen.add(key)
            first[i] = True
    return first


def _anchors(words: Words, size: int, quarter: int) -> tuple[np.ndarray, ...]:
    """Anchor, first and last start of the windows that have it, for the windows inside a text."""
    full = len(words.hashes) - size + 1
    if full <= 0:
        return (np.zeros(0, np.int64),) * 3
    value = words.windows(quarter)
    at = np.arange(len(value), dtype=np.int32)
    reach, span = size - quarter + 1, 1
    while span < reach:  # smallest of ``span`` neighbours, the leftmost of equals
        add = min(span, reach - span)
        left, right = value[:-add], value[add:]
        keep = left <= right
        value, at = np.where(keep, left, right), np.where(keep, at[:-add], at[add:])
        span += add
    at = at[:full]
    inside = np.zeros(full + 1, bool)
    for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        if b - a >= size:
            inside[a : b - size + 1] = True
    inside = inside[:full]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    own = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return own[first].astype(np.int64), starts[first], starts[last]


def _anchor_rows(size: int):
    quarter = -(-size // 4)
    half = 2 * quarter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for piece in pieces(batch, "text", CHUNK_BYTES):
                words = Words(piece.column("text"))
                first = _first_of_class(piece, words, seen)
                anchor, low, high = _anchors(words, size, quarter)
                doc = np.searchsorted(words.bounds, anchor, side="right") - 1
                mine = first[doc]
                anchor, low, high, doc = anchor[mine], low[mine], high[mine], doc[mine]
                short, long = words.windows(quarter), words.windows(half)
                # the half-size window that ends with the anchor, and the one that begins with it
                back = anchor - (half - quarter)
                ends = np.where(low <= back, long[np.clip(back, 0, max(len(long) - 1, 0))], 0) if len(long) else np.zeros(len(anchor), np.uint64)
                begins = np.where(high > back, long[np.clip(anchor, 0, max(len(long) - 1, 0))], 0) if len(long) else np.zeros(len(anchor), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        signed(_class_ids(words)[doc]),
                        pa.array(words.counts[doc].astype(np.int64)),
                        pa.array((anchor - words.bounds[doc]).astype(np.int32)),
                        signed(short[anchor]),
                        pa.array(ends.view(np.int64), mask=low > back),
                        pa.array(begins.view(np.int64), mask=high <= back),
                    ],
                    ["cls", "n_words", "anchor", "short", "ends", "begins"],
                )

    return run, "cls long, n_words long, anchor int, short long, ends long, begins long"


def _window_rows(size: int):
    quarter = -(-size // 4)
    half = 2 * quarter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for piece in pieces(batch, "text", CHUNK_BYTES):
                words = Words(piece.column("text"))
                first = _first_of_class(piece, words, seen)
                spans = piece.column("spans").to_pylist()
                anchor, low, high = _anchors(words, size, quarter)
                doc = np.searchsorted(words.bounds, anchor, side="right") - 1
                where = anchor - words.bounds[doc]
                starts, owner = [], []
                for d in np.flatnonzero(first):
                    a, b = np.searchsorted(anchor, words.bounds[d]), np.searchsorted(anchor, words.bounds[d + 1])
                    wanted = {(s["anchor"], s["left"]) for s in spans[d]}
                    for i in range(a, b):
                        back = anchor[i] - (half - quarter)
                        for left, lo, hi in ((True, low[i], min(high[i], back)), (False, max(low[i], back + 1), high[i])):
                            if lo <= hi and (int(where[i]), left) in wanted:
                                starts.append(np.arange(lo, hi + 1))
                                owner.append(np.full(hi - lo + 1, d))
                if not starts:
                    continue
                start, own = np.concatenate(starts), np.concatenate(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        signed(_class_ids(words)[own]),
                        pa.array(words.counts[own].astype(np.int64)),
                        pa.array((start - words.bounds[own]).astype(np.int32)),
                        signed(words.windows(size)[start]),
                        pa.array((words.windows(size, 1)[start] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    ],
                    ["cls", "n_words", "start", "key1", "key2"],
                )

    return run, "cls long, n_words long, start int, key1 long, key2 int"


def _kept_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            out = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("cls", "n_words", "text", "starts")), strict=True)
            for cls, n, text, starts in rows:
                if (cls, n) in seen:
                    continue
                seen.add((cls, n))
                words = (text or "").encode().split()
                turns = np.zeros(len(words) + 1, np.int32)
                np.add.at(turns, starts, 1)
                np.add.at(turns, np.array(starts) + size, -1)
                gone = np.cumsum(turns[:-1]) > 0
                kept = b" ".join(compress(words, (~gone).tolist()))
                out.append((cls, n, int(gone.sum()), kept.decode()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["cls", "n_words", "n_removed", "kept"])

    return run, "cls long, n_words long, n_removed long, kept string"


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs more than once.

    The keys are written first: a join of two plain shuffles can be split where a key is hot, one
    that shares its shuffle with the aggregation can not.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return rows.join(saved(counts, "passages-keys"), keys, "left_semi")


def repeated_windows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(cls, n_words, starts): starts of the repeated windows of each class of texts.

    ``docs`` has a column text. A class of several rows may have its windows counted once; such a
    class is repeated as a whole.
    """
    if size < 4:
        raise ValueError("windows have four words at least")
    run, schema = _anchor_rows(size)
    anchors = docs.select("text").mapInArrow(run, schema)
    found = saved(_repeated(anchors, ["short"]).drop("short"), "passages-quarter")
    sides = F.explode(F.array(*[F.struct(F.lit(left).alias("left"), F.col(c).alias("key")) for left, c in ((True, "ends"), (False, "begins"))]))
    halves = found.select("cls", "n_words", "anchor", sides.alias("side")).select("cls", "n_words", "anchor", "side.*").filter("key IS NOT NULL")
    spans = _repeated(halves, ["left", "key"]).groupBy("cls", "n_words").agg(F.collect_set(F.struct("anchor", "left")).alias("spans"))
    run, schema = _window_rows(size)
    windows = _texts(docs).join(spans, ["cls", "n_words"]).select("text", "spans").mapInArrow(run, schema)
    windows = saved(windows, "passages-full")
    release(found)
    starts = _repeated(windows, ["key1", "key2"]).groupBy("cls", "n_words").agg(F.collect_set("start").alias("starts"))
    starts = saved(starts, "passages-starts")
    release(windows)
    return starts


def _texts(docs: DataFrame) -> DataFrame:
    """(cls, n_words, text), one row of each class from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for piece in pieces(batch, "text", CHUNK_BYTES):
                words = Words(piece.column("text"))
                first = pa.array(_first_of_class(piece, words, seen))
                rows = pa.RecordBatch.from_arrays(
                    [signed(_class_ids(words)), pa.array(words.counts.astype(np.int64)), piece.column("text")], ["cls", "n_words", "text"]
                )
                yield rows.filter(first)

    return docs.select("text").mapInArrow(run, "cls long, n_words long, text string")


def without_repeats(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, kept.

    Each word covered by a window of ``size`` words that also starts anywhere else, in the same
    text or another, is removed; windows are judged on the input. ``kept`` is the rest, joined by
    single spaces, or null where nothing was removed (the text stays as it is). Null texts have no
    words; texts shorter than a window keep all; repeated rows count as repeats; null identifiers
    pass through. An empty table gives an empty result; other columns are not read.
    """
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    rows = saved(source.mapInArrow(_rows, f"doc_id {id_type}, cls long, n_words long, kept_sha256 string"), "passages-rows")
    starts = repeated_windows(texts, size)
    run, schema = _kept_rows(size)
    cut = _texts(texts).join(starts, ["cls", "n_words"]).mapInArrow(run, schema)
    # a class spread over split partitions may come more than once, always alike
    cut = cut.groupBy("cls", "n_words").agg(F.max("n_removed").alias("n_removed"), F.max("kept").alias("kept"))
    cut = saved(cut, "passages-cut").withColumn("kept_digest", F.sha2("kept", 256))
    release(starts)
    copies = rows.groupBy("cls", "n_words").agg(F.count(F.lit(1)).alias("copies")).filter((F.col("copies") > 1) & (F.col("n_words") >= size))
    copies = saved(copies, "passages-copies")  # before the join, which can then be split at a large class
    rows = rows.join(cut, ["cls", "n_words"], "left").join(copies, ["cls", "n_words"], "left")
    whole = F.col("copies").isNotNull()
    return rows.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_digest", "kept_sha256")).alias("kept_sha256"),
        F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )
