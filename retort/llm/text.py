"""Words and word-window hashes of whole Arrow text columns, without Python strings.

A word is a maximal run of bytes other than ``\\x20`` and ``\\x09-\\x0D``. Hashes are two
polynomials over the bytes (or over the words of a window) modulo the prime 2**31 - 1, read off
prefix sums, put together to 62 bits and finished by a mixing step to 64. They depend on the words
only, never on partition or machine. A modulus of 2**64 would not do: there, texts that follow
the Thue-Morse sequence collide whatever the multiplier.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame, SparkSession

#: Bytes of text worked on at once (a longer single text is one piece): few enough that the work arrays stay in a core's cache.
CHUNK_BYTES = 1 << 17
#: The same where words are not hashed.
PIECE_BYTES = 1 << 18

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"

_U = np.uint64
_PRIME, _BITS = _U((1 << 31) - 1), _U(31)
#: Two multipliers for bytes, and for words two pairs (the second of windows told apart by 96 bits).
_BYTE_STEPS = (0x2545F491, 0x5851F42D)
_WORD_STEPS = ((0x369DEA0F, 0x1F3D5B79), (0x4C957F2D, 0x7C9B3A11))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ _U(seed)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _folded(x: np.ndarray) -> np.ndarray:
    """Values below 2**62 modulo the prime, up to one multiple of it."""
    x = (x & _PRIME) + (x >> _BITS)
    return (x & _PRIME) + (x >> _BITS)


_CODES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_LOWER_CODES = _CODES.copy()
_LOWER_CODES[65:91] = _CODES[97:123]
#: For each of the two polynomials, its own bits of the bytes' codes.
_LANES = [(_CODES >> _U(31 * k)) & _PRIME for k in (0, 1)]
_LOWER_LANES = [(_LOWER_CODES >> _U(31 * k)) & _PRIME for k in (0, 1)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``step`` and of its inverse modulo the prime, at least ``n`` of each."""
    have = _powers.get(step)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        tables = []
        for base in (step, pow(step, -1, int(_PRIME))):
            table = np.ones(1, _U)
            while len(table) < size:  # the next powers are those so far times one
                table = np.concatenate([table, _folded(table * _U(pow(base, len(table), int(_PRIME))))])
            tables.append(table.astype(np.uint32))
        have = (tables[0], tables[1])
        if size <= 4 * CHUNK_BYTES:
            _powers[step] = have
    return have


_held = np.zeros((3, 0), _U)


def _buffers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three work arrays for ``n`` values, the last with a place more; kept between pieces of usual size."""
    global _held
    if _held.shape[1] < n + 1:
        fresh = np.zeros((3, max(n + 1, 1 << 18)), _U)
        if n > 4 * CHUNK_BYTES:
            return fresh[0, :n], fresh[1, :n], fresh[2, : n + 1]
        _held = fresh
    return _held[0, :n], _held[1, :n], _held[2, : n + 1]


def _span_hash(lanes: list[np.ndarray], starts: np.ndarray, ends: np.ndarray, steps: tuple[int, int]) -> np.ndarray:
    """62 bits for each span: two polynomials, each over values of its own below 2**31."""
    found = np.zeros(len(starts), _U)
    for k, (values, step) in enumerate(zip(lanes, steps, strict=True)):
        up, down = _power_tables(step, len(values) + 1)
        terms, above, sums = _buffers(len(values))
        np.multiply(values, up[: len(values)], out=terms)
        np.right_shift(terms, _BITS, out=above)
        np.bitwise_and(terms, _PRIME, out=terms)
        np.add(terms, above, out=terms)  # below 2**32, so fewer than 2**32 of them add up in 64 bits
        sums[0] = 0
        np.cumsum(terms, out=sums[1:])
        part = _folded(_folded(sums[ends] - sums[starts]) * down[starts])
        found |= np.where(part >= _PRIME, part - _PRIME, part) << _U(31 * k)
    return found


class Words:
    """The words of a run of texts: their hashes, and for each text the range of its words.

    ``separates``: the bytes between words, white space if not given.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, separates: np.ndarray = _IS_SPACE):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        size = int(offsets[-1] - offsets[0])
        data = texts.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if size else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        solid = ~separates[self.bytes]
        before = np.zeros(size + 1, bool)
        before[1:] = solid
        before[offsets] = False  # a word never runs over the end of its text
        self.starts = np.flatnonzero(solid & ~before[:-1])
        after = np.zeros(size + 1, bool)
        after[:-1] = solid
        after[offsets] = False
        self.ends = np.flatnonzero(solid & ~after[1:]) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        self.hashes = np.empty(len(self.starts), _U)
        # a run of words at a time, as hashing needs some hundred times their bytes
        for i, j in self._runs():
            a, b = self.starts[i], self.ends[j - 1]
            lanes = [codes[self.bytes[a:b]] for codes in (_LOWER_LANES if lower else _LANES)]
            self.hashes[i:j] = _span_hash(lanes, self.starts[i:j] - a, self.ends[i:j] - a, _BYTE_STEPS)
        # the length goes in as well, as no value of a byte is barred from being 0 modulo the prime
        self.hashes = mix(self.hashes + (self.ends - self.starts).astype(_U), 0x243F6A8885A308D3)

    def _runs(self) -> Iterator[tuple[int, int]]:
        """Words in runs over at most CHUNK_BYTES, one word at least."""
        i = 0
        while i < len(self.starts):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + CHUNK_BYTES, "right")))
            yield i, j
            i = j

    def windows(self, size: int, which: int = 0) -> np.ndarray:
        """Hash of the ``size`` words from each word on; the caller leaves out those over a text's end."""
        n = len(self.hashes)
        if n < size:
            return np.zeros(0, _U)
        found = np.empty(n - size + 1, _U)
        for i in range(0, len(found), CHUNK_BYTES):
            starts = np.arange(min(CHUNK_BYTES, len(found) - i))
            values = self.hashes[i : i + len(starts) + size - 1]
            values = values if which == 0 else mix(values, 0x452821E638D01377)
            found[i : i + len(starts)] = _span_hash(_two_lanes(values), starts, starts + size, _WORD_STEPS[which])
        return mix(found, size)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the words from ``starts`` up to ``ends``."""
        found = _span_hash(_two_lanes(self.hashes), starts, ends, _WORD_STEPS[0])
        return mix(found + np.asarray(ends - starts).astype(_U), 0x13198A2E03707344)


def _two_lanes(hashes: np.ndarray) -> list[np.ndarray]:
    return [hashes & _PRIME, (hashes >> _BITS) & _PRIME]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``limit`` text bytes, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(lengths) > start:
        yield batch.slice(start, len(lengths) - start)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the session's shared folder and read back: computed once, lineage cut.

    The shuffle files of the write go when it is done, as nothing can need them again.
    """
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    for scope in _scopes:
        scope.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._saved_at = path
    return back


_scopes: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(*frames: DataFrame) -> None:
    """Delete what ``saved`` wrote for these frames; only when all that reads them is itself written.

    Through the file system of the path, so in any shared store. Frames that are not from ``saved``
    are left alone.
    """
    for frame in frames:
        path = frame.__dict__.pop("_saved_at", None)
        if path:
            _delete(frame.sparkSession, path)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The paths that ``saved`` writes meanwhile, for ``release_paths`` once they are superseded."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield paths
    finally:
        _scopes.remove(paths)


def release_paths(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        _delete(spark, path)
    paths.clear()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most so many rows in what runs meanwhile, for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def new_path(spark: SparkSession, name: str) -> str:
    import uuid

    from retort.session import shared_dir

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
