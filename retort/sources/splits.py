"""Split files as a partitioned data source: JSON lines by byte ranges, documents as one stream.

The planner looks at the head of each ``.json`` file. A file whose first filled line is JSON is a
file of lines and is read in ranges, as ``.jsonl`` files are; any other is one document, of which
a single partition streams the array's elements without holding the document. Rows carry the number
of their file and their place in it, so ordering by both is the order of the input.
"""

from __future__ import annotations

import codecs
import io
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range of lines, of what the planner reads of a head, and of one read of a stream.
RANGE_BYTES = 64 << 20
HEAD_BYTES = 1 << 20
READ_BYTES = 1 << 20
BATCH_ROWS = 4096

SCHEMA = "file_no int, file_path string, ordinal long, value string"


def opened(path: str):
    """A seekable binary file of any store that Arrow reads, and its size."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    store, inner = (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)
    return store.open_input_file(inner), store.get_file_info(inner).size


@dataclass
class Part(InputPartition):
    file_no: int
    path: str
    kind: str  # lines, or document
    start: int
    end: int


def is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def lines_between(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [start, end); the last one is read past the end."""
    at = max(0, start - 1)
    file.seek(at)
    held = b""  # of the line that begins at ``at``
    skip = start > 0  # up to the first end of line at or behind start - 1
    while at < end or held:
        block = file.read(READ_BYTES)
        if not block:
            break
        pieces = (held + block).split(b"\n")
        held = pieces.pop()
        for piece in pieces:
            if not skip and at >= end:
                return
            if not skip:
                yield at, piece
            skip = False
            at += len(piece) + 1
        if not skip and at >= end:
            return
    if held and not skip and at < end:
        yield at, held


def elements(file) -> Iterator[str]:
    """The texts of a document's records: of an array its elements, else the whole.

    ``ValueError`` where the document is not JSON. One element and one read are held at a time.
    """
    decode, text, done = codecs.getincrementaldecoder("utf-8")().decode, "", False
    parse = json.JSONDecoder().raw_decode
    file.seek(0)

    def more() -> bool:
        nonlocal text, done
        block = file.read(max(READ_BYTES, len(text)))  # as much again, so that a long element is parsed few times
        done = not block
        text += decode(block, done)
        return not done

    def skip_space(at: int) -> int:
        while True:
            while at < len(text) and text[at] in " \t\r\n":
                at += 1
            if at < len(text) or not more():
                return at

    at = skip_space(0)
    if text[at : at + 1] != "[":
        while more():
            pass
        end = parse(text, at)[1] if text[at:] else 0
        if text[end:].strip() or not text.strip():
            raise ValueError("not one JSON document")
        yield text[at:end]
        return
    at, first = skip_space(at + 1), True
    while True:
        if text[at : at + 1] == "]":
            text, at = text[at + 1 :], 0
            if skip_space(0) < len(text):
                raise ValueError("text behind the array")
            return
        if not first:
            if text[at : at + 1] != ",":
                raise ValueError("no comma between elements")
            at = skip_space(at + 1)
        first = False
        text, at = text[at:], 0
        while True:
            try:
                end = parse(text, 0)[1]
                if done or text[end : end + 1] in {",", "]", " ", "\t", "\r", "\n"}:  # a number may go on in the next read
                    break
            except ValueError:
                if done:
                    raise
            more()
        yield text[:end]
        at = skip_space(end)


class SplitReader(DataSourceReader):
    def __init__(self, paths: list[str], cuts: dict[str, int], size: int):
        self.paths, self.cuts, self.size = paths, cuts, size

    def _kind(self, path: str, file, size: int) -> str:
        if not path.endswith(".json"):
            return "lines"
        for _, line in lines_between(file, 0, size):
            if line.strip():
                return "lines" if is_json(line.decode("utf-8", "replace").strip()) else "document"
            if file.tell() > HEAD_BYTES:  # blank so far
                break
        return "lines"

    def _parts(self, numbered: tuple[int, str]) -> list[Part]:
        number, path = numbered
        file, size = opened(path)
        with file:
            if self._kind(path, file, size) == "document":
                return [Part(number, path, "document", 0, size)]
        end = min(size, self.cuts.get(path, size))
        return [Part(number, path, "lines", at, min(at + self.size, end)) for at in range(0, end, self.size)]

    def partitions(self) -> list[Part]:
        with ThreadPoolExecutor(16) as pool:
            return [p for parts in pool.map(self._parts, enumerate(self.paths, 1)) for p in parts]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        file, _ = opened(part.path)
        with file:
            if part.kind == "lines":
                rows = ((at, line.decode("utf-8", "replace").strip()) for at, line in lines_between(file, part.start, part.end))
                yield from self._batches(part, ((at, line) for at, line in rows if line))
                return
            try:  # the whole document is checked before any of it is returned
                for _ in elements(file):
                    pass
            except ValueError:
                return
            yield from self._batches(part, enumerate(elements(file)))

    def _batches(self, part: Part, rows: Iterator[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
        places: list[int] = []
        values: list[str] = []
        held = 0

        def batch() -> pa.RecordBatch:
            n = len(values)
            arrays = [pa.array([part.file_no] * n, pa.int32()), pa.array([part.path] * n), pa.array(places, pa.int64()), pa.array(values, pa.string())]
            return pa.RecordBatch.from_arrays(arrays, ["file_no", "file_path", "ordinal", "value"])

        for place, value in rows:
            places.append(place)
            values.append(value)
            held += len(value)
            if len(values) >= BATCH_ROWS or held >= 4 * READ_BYTES:
                yield batch()
                places, values, held = [], [], 0
        if values:
            yield batch()


class SplitSource(DataSource):
    """Options: ``paths`` (JSON list, in order), ``cuts`` (JSON map of path to offset), ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "json_splits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SplitReader:
        options = self.options
        return SplitReader(json.loads(options["paths"]), json.loads(options.get("cuts", "{}")), int(options.get("rangebytes", RANGE_BYTES)))


def _read(spark: SparkSession, paths: list[str], cuts: dict[str, int], size: int) -> DataFrame:
    spark.dataSource.register(SplitSource)
    reader = spark.read.format("json_splits").option("paths", json.dumps(paths)).option("cuts", json.dumps(cuts))
    return reader.option("rangeBytes", size).load().withColumn("record", F.try_parse_json("value"))


def read_splits(spark: SparkSession, files: DataFrame, flatten_one_line: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of the files of a ``catalogue``: file_no, file_path, ordinal, value, record (VARIANT).

    Lines of ``.jsonl`` files that are not JSON are left out. A ``.json`` file of lines counts up
    to its first bad line; the offsets of such lines, at most one for each file, are found first,
    and the second plan reads no further. A document that is not JSON is left out whole. An array
    on a single line stays one record unless ``flatten_one_line``. (file_no, ordinal) is the order of
    the input; files without records have no rows.
    """
    paths = [r["path"] for r in files.orderBy("ordinal").select("path").collect()]
    rows = _read(spark, paths, {}, range_bytes)
    broken = rows.filter(F.endswith("file_path", F.lit(".json")) & F.col("record").isNull())
    ends = broken.groupBy("file_path").agg(F.min("ordinal").alias("cut")).collect() if any(p.endswith(".json") for p in paths) else []
    if ends:
        rows = _read(spark, paths, {r["file_path"]: r["cut"] for r in ends}, range_bytes)
    rows = rows.filter(F.col("record").isNotNull())
    if not flatten_one_line:
        return rows
    items = F.coalesce(F.try_variant_get("record", "$", "array<variant>"), F.array("record"))
    # elements of one line follow one another below its ordinal
    spread = rows.select("file_no", "file_path", F.col("ordinal").alias("line"), F.posexplode(items).alias("place", "record"))
    return spread.select("file_no", "file_path", F.struct("line", "place").alias("ordinal"), F.to_json("record").alias("value"), "record")


def in_memory(text: str) -> io.BytesIO:
    """A document as the file that ``elements`` reads."""
    return io.BytesIO(text.encode())
