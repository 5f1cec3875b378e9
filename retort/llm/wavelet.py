"""Token ids in wavelet-matrix shards: one compressed file answers access, count and select.

The ids of a run of documents are stored by bit, highest first: a plane holds one bit of every
id, and for the next plane ids with a 0 go before ids with a 1, in order. Counts of ones before
every block of a plane make rank and select a matter of one block per plane, so a token is read,
counted or found without the rest of the file.

File, integers little-endian: ``WVM1``; length of the header as unsigned 32-bit; the header as
JSON (n, levels, zeros of each plane, block_bits, and for each section its offset, stored and
full length); the sections, each a zstandard frame: document ends (64-bit), ones before each block
of each plane (32-bit), then the blocks of the planes, bits packed from the high end.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retort.llm.bpe import NOT_ONE_WORD, split_words
from retort.llm.text import new_path, pieces, saved

__all__ = ["build", "Shard", "write_shards", "read_documents", "new_path"]

MAGIC = b"WVM1"
BLOCK_BITS = 1 << 16
#: Tokens after which a shard is closed at the end of the document (a longer document is one shard).
SHARD_TOKENS = 1 << 20
#: Words that one worker keeps with their ids, twice.
MAX_WORDS = 500_000


def build(ids: np.ndarray, doc_lengths: np.ndarray) -> bytes:
    """The shard file of these ids; ``doc_lengths`` sum to their number."""
    top = int(ids.max()) if len(ids) else 0
    levels = max(1, top.bit_length())
    current = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    zeros, planes, ones_before = [], [], []
    for level in range(levels - 1, -1, -1):
        ones = (current & current.dtype.type(1 << level)) != 0
        packed = np.packbits(ones)
        blocks = [packed[i : i + BLOCK_BITS // 8] for i in range(0, len(packed), BLOCK_BITS // 8)]
        counts = [int(np.bitwise_count(b).sum()) for b in blocks]
        ones_before.append(np.cumsum([0, *counts[:-1]], dtype=np.uint32) if counts else np.zeros(0, np.uint32))
        planes.extend(b.tobytes() for b in blocks)
        zeros.append(len(ones) - int(np.count_nonzero(ones)))
        parted = np.empty_like(current)
        np.compress(~ones, current, out=parted[: zeros[-1]])
        np.compress(ones, current, out=parted[zeros[-1] :])
        current = parted
    sections = [np.cumsum(doc_lengths, dtype=np.int64).tobytes(), np.concatenate(ones_before).tobytes(), *planes]
    pack = zstandard.ZstdCompressor(level=1)
    stored = [pack.compress(s) for s in sections]
    offsets = np.cumsum([0, *[len(s) for s in stored]])
    header = {
        "n": len(ids),
        "levels": levels,
        "zeros": zeros,
        "block_bits": BLOCK_BITS,
        "sections": [[int(o), len(s), len(f)] for o, s, f in zip(offsets, stored, sections, strict=False)],
    }
    head = json.dumps(header).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *stored])


class Shard:
    """Reads one shard, from its bytes or from a file-like object with ``read_at``."""

    def __init__(self, source):
        self._source = source
        magic, size = self._read(0, 4), struct.unpack("<I", self._read(4, 4))[0]
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        head = json.loads(self._read(8, size))
        self.n, self.levels, self.zeros = head["n"], head["levels"], head["zeros"]
        self.block_bits, self._sections, self._base = head["block_bits"], head["sections"], 8 + size
        self._unpack = zstandard.ZstdDecompressor()
        self.doc_ends = np.frombuffer(self._section(0), np.int64)
        self._per_plane = -(-self.n // self.block_bits)
        self._ones = np.frombuffer(self._section(1), np.uint32).reshape(self.levels, self._per_plane).astype(np.int64)
        self._blocks: dict[tuple[int, int], np.ndarray] = {}

    def _read(self, offset: int, size: int) -> bytes:
        return self._source[offset : offset + size] if isinstance(self._source, bytes | memoryview) else self._source.read_at(size, offset)

    def _section(self, i: int) -> bytes:
        offset, stored, full = self._sections[i]
        return self._unpack.decompress(self._read(self._base + offset, stored), max_output_size=full) if full else b""

    def _block(self, plane: int, block: int) -> np.ndarray:
        found = self._blocks.get((plane, block))
        if found is None:
            if len(self._blocks) > 64:
                self._blocks.clear()
            packed = np.frombuffer(self._section(2 + plane * self._per_plane + block), np.uint8)
            found = self._blocks[plane, block] = np.unpackbits(packed)[: min(self.block_bits, self.n - block * self.block_bits)]
        return found

    def _rank1(self, plane: int, position: int) -> int:
        """Ones of a plane before ``position``."""
        block, inside = divmod(position, self.block_bits)
        if block == self._per_plane:
            block, inside = block - 1, self.block_bits
        if self.n == 0:
            return 0
        return int(self._ones[plane, block]) + int(self._block(plane, block)[:inside].sum())

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) ``bit`` of a plane."""
        starts = self._ones[plane]
        before = starts if bit else np.arange(self._per_plane) * self.block_bits - starts
        block = int(np.searchsorted(before, k, side="right")) - 1
        return block * self.block_bits + int(np.flatnonzero(self._block(plane, block) == bit)[k - int(before[block])])

    def access(self, position: int) -> int:
        """The token at a position."""
        if not 0 <= position < self.n:
            raise IndexError(position)
        token = 0
        for plane in range(self.levels):
            block, inside = divmod(position, self.block_bits)
            bit = int(self._block(plane, block)[inside])
            ones = self._rank1(plane, position)
            position = self.zeros[plane] + ones if bit else position - ones
            token = token << 1 | bit
        return token

    def _range(self, token: int, end: int) -> tuple[int, int]:
        start = 0
        for plane in range(self.levels):
            low, high = self._rank1(plane, start), self._rank1(plane, end)
            if token >> (self.levels - 1 - plane) & 1:
                start, end = self.zeros[plane] + low, self.zeros[plane] + high
            else:
                start, end = start - low, end - high
        return start, end

    def rank(self, token: int, position: int) -> int:
        """Occurrences of ``token`` before ``position``."""
        if token >> self.levels or token < 0 or not self.n:
            return 0
        start, end = self._range(token, min(max(position, 0), self.n))
        return end - start

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``token``."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        position = self._range(token, self.n)[0] + k
        for plane in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - plane) & 1
            position = self._select(plane, bit, position - self.zeros[plane] * bit)
        return position

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for plane in range(self.levels - 1, -1, -1):
            packed = b"".join(self._section(2 + plane * self._per_plane + b) for b in range(self._per_plane))
            ones = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n).view(bool)
            zeros = self.zeros[plane]
            above = np.empty(self.n, kind)
            above[np.flatnonzero(~ones)] = values[:zeros]
            above[np.flatnonzero(ones)] = values[zeros:] | kind(1 << (self.levels - 1 - plane))
            values = above
        return values


class _Encoder:
    """Ids of words by the tokenizers library, each new word encoded once while it is kept.

    The library's pattern takes white space by itself or as one leading space, so where all white
    space is single, a text falls into independent words before each space and each line feed. A
    word is known by its characters without that space. Other texts are encoded whole, as are those
    that hold an added token of the tokenizer, and all texts where it normalises or splits otherwise.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        splits = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.words_apart = not parts["normalizer"] and splits.items() <= (parts["pre_tokenizer"] or {}).items()
        self.added = [token["content"] for token in parts["added_tokens"]]
        self.line_feed = self._ids(["\n"])[0]
        self.marks = dict(zip(".,;:!?", self._ids(list(".,;:!?")), strict=True))
        self.words: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(m.ids, "<u4").tobytes() for m in made]

    def _only_whole(self, text: str) -> bool:
        return not self.words_apart or any(token in text for token in self.added)

    def _learn(self, words: list[str]) -> None:
        """Words of one run of text each: encoded 200 at a time, a line feed between them."""
        # letters and one mark: the pattern takes the two apart
        marked, plain, rest = [], [], []
        for w in words:
            if w[-1] in self.marks and w[:-1].isalpha():
                marked.append(w)
            else:
                (rest if w[0] == "\n" else plain).append(w)
        known, earlier = self.words, self.earlier
        stems = {w[:-1] for w in marked}.difference(known)
        known.update((w, earlier[w]) for w in stems if w in earlier)
        plain += stems.difference(known, plain)
        lines = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        made = self.tokenizer.encode_batch_fast([" " + "\n ".join(line) for line in lines], add_special_tokens=False)
        gap = struct.unpack("<I", self.line_feed)[0]
        for line, encoding in zip(lines, made, strict=True):
            ids = np.array(encoding.ids, "<u4")
            at = np.flatnonzero(ids == gap)
            data = ids.tobytes()
            starts, ends = [0, *(4 * at + 4).tolist()], [*(4 * at).tolist(), len(data)]
            self.words.update(zip(line, [data[i:j] for i, j in zip(starts, ends, strict=True)], strict=True))
        known.update((w, known[w[:-1]] + self.marks[w[-1]]) for w in marked)
        heads = [w[1:] for w in rest if len(w) > 1]
        ids = dict(zip(heads, self._ids(heads), strict=True))
        self.words.update((w, self.line_feed + ids.get(w[1:], b"")) for w in rest)

    def encode(self, texts: list[str | None], end_id: int) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with the end id."""
        if len(self.words) >= MAX_WORDS:
            self.earlier, self.words = self.words, {}
        words, earlier, end = self.words, self.earlier, struct.pack("<I", end_id)
        # as if a space came first; the true first word is put in its place below
        whole = [i for i, text in enumerate(texts) if text and self._only_whole(text)]
        others = dict(zip(whole, self._ids([texts[i] for i in whole]), strict=True))
        split = [split_words(text) if text and i not in others else [] for i, text in enumerate(texts)]
        # ids of the words after the first, and the places of those that are not known yet
        parts = [list(map(words.get, s[1:], repeat(b""))) for s in split]
        gaps = [[] if all(p) else [k for k, part in enumerate(p) if not part] for p in parts]
        new = []
        for word in {s[k + 1] for s, gap in zip(split, gaps, strict=True) for k in gap}:
            found = earlier.get(word)
            if found is None:
                new.append(word)
            else:
                words[word] = found
        bad = set() if _all_one_word(new) else {w for w in new if NOT_ONE_WORD.search(w)}
        if new:
            self._learn([w for w in new if w not in bad] if bad else new)
        whole = [i for i, s in enumerate(split) if s and (NOT_ONE_WORD.search(s[0]) or bad and not bad.isdisjoint(s))]
        others |= zip(whole, self._ids([texts[i] for i in whole]), strict=True)
        firsts = iter(self._ids([s[0] for i, s in enumerate(split) if s and i not in others]))
        encoded = []
        for i, s in enumerate(split):
            if i in others:
                encoded.append(others[i] + end)
            elif s:
                for k in gaps[i]:
                    parts[i][k] = words[s[k + 1]]
                encoded.append(b"".join([next(firsts), *parts[i], end]))
            else:
                encoded.append(end)
        for word in new:
            if len(word) > 64:
                words.pop(word, None)
        return encoded


def _all_one_word(words: list[str]) -> bool:
    """Whether ``NOT_ONE_WORD`` is found in none of the words, told for all of them at once."""
    bare = [w[1:] if w[:1] == "\n" else w for w in words]
    return " ".join(bare).split() == bare


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that all executors reach."""
    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder[len("file:") :]
    return fs.FileSystem.from_uri(folder)


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all documents, in ascending order of identifier, as shards below ``folder``.

    Null texts count as empty: their ids are the end id alone. Null identifiers come first; rows
    of one identifier are ordered by text. Returns (part, seq, file, first_token, doc_ids), one row
    per shard; part and seq give the order of the shards. A task names its files anew in every
    attempt, and only those of the attempt that Spark commits are in the result: other files in
    the folder are to be ignored. An empty table gives no shard. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = TaskContext.get().partitionId(), _encoder(tokenizer)
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        held: list[bytes] = []
        names: list[pa.Array] = []
        seq, size = 0, 0

        def close() -> pa.RecordBatch:
            data = build(np.frombuffer(b"".join(held), "<u4"), np.array([len(h) // 4 for h in held], np.int64))
            file = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.wvm"
            with store.open_output_stream(f"{base}/{file}") as out:
                out.write(data)
            ids = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.concat_arrays(names))
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([f"{folder}/{file}"]), pa.array([size], pa.int64()), ids]
            return pa.RecordBatch.from_arrays(columns, ["part", "seq", "file", "n_tokens", "doc_ids"])

        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                for i, ids in enumerate(own.encode(piece.column("text").to_pylist(), end_id)):
                    held.append(ids)
                    names.append(piece.column("doc_id").slice(i, 1))
                    size += len(ids) // 4
                    if size >= SHARD_TOKENS:
                        yield close()
                        held, names, seq, size = [], [], seq + 1, 0
        if held:
            yield close()

    schema = f"part int, seq int, file string, n_tokens long, doc_ids array<{id_type}>"
    ordered = rows.repartitionByRange(width, *order).sortWithinPartitions(*order)
    shards = saved(ordered.mapInArrow(write, schema), "shards")
    # one number per shard, not per document
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shard files."""
    id_type = shards.schema["doc_ids"].dataType.elementType.simpleString()
    width = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                store, path = _store(batch.column("file")[row].as_py())
                with store.open_input_file(path) as file:
                    shard = Shard(file.read())
                ids = shard.decode().astype("<u4")
                ends = shard.doc_ends
                starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
                data = memoryview(ids).cast("B")
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
                first = batch.column("first_token")[row].as_py()
                columns = [batch.column("doc_ids")[row].values, pa.array(starts + first), pa.array(ends - starts), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    work = shards.select("file", "first_token", "doc_ids").repartition(width, "file")
    return work.mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")
