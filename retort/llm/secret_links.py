"""Secrets in texts, with weak candidates linked across the parts of a credential.

Strong patterns are reported as they are. Weak ones (an account name, a random-looking token, an
address) are common in clean text; one is reported only where the parts that complete it are in
its scope, that is where its interval, widened by ``REACH`` characters, meets theirs: an identifier
and a secret need each other, and an endpoint between them if both are weak; an endpoint needs
both. Intervals are joined by their sorted ends within each text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.llm.text import pieces

REACH = 200

#: Kinds in the order in which spans of equal start are listed.
BASE = ("assign", "access", "hex")
WEAK = ("weak_id", "weak_secret", "endpoint")
KINDS = BASE + WEAK

_ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WEAK_ID = re.compile(r"(?ai:\b(?:access_?key|client_?id|account|user(?:name)?|login))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{3,})")
_WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}")
_ENDPOINT = re.compile(r"(?ai:https?|jdbc:[a-z]+|ftp|s3)://[^\s\"'<>]+")
#: Texts in which any of the patterns can match.
_LIKELY = r"(?i:passw|secret|token|api_?key|access_?key|client_?id|account|user|login)|AKIA|[0-9a-f]{24}|[A-Za-z0-9+/_-]{20}"


class _Intervals:
    """Sorted intervals that answer whether any of them meets another."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = np.array([s for s, _ in spans], np.int64)
        self.ends = np.maximum.accumulate(np.array([e for _, e in spans], np.int64)) if spans else np.zeros(0, np.int64)

    def meets(self, start: int, end: int) -> bool:
        upto = int(np.searchsorted(self.starts, end, side="right"))
        return upto > 0 and bool(self.ends[upto - 1] >= start)


def find(text: str, reach: int = REACH) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by start, then kind as listed."""
    spans = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    strong = _Intervals([(s, e) for _, s, e in spans])
    free = lambda pattern: [m.span() for m in pattern.finditer(text) if not strong.meets(m.start() + 1, m.end() - 1)]
    ids, secrets = free(_WEAK_ID), free(_WEAK_SECRET)
    ends = free(_ENDPOINT) if spans or (ids and secrets) else []
    strong_ids = _Intervals([(s, e) for k, s, e in spans if k == "access"])
    strong_secrets = _Intervals([(s, e) for k, s, e in spans if k != "access"])
    weak_ids, weak_secrets, endpoints = _Intervals(ids), _Intervals(secrets), _Intervals(ends)
    for kind, own, others, weak in (("weak_id", ids, strong_secrets, weak_secrets), ("weak_secret", secrets, strong_ids, weak_ids)):
        for s, e in own:
            low, high = s - reach, e + reach
            if others.meets(low, high) or (weak.meets(low, high) and endpoints.meets(low, high)):
                spans.append((kind, s, e))
    for s, e in ends:
        low, high = s - reach, e + reach
        if (strong_ids.meets(low, high) or weak_ids.meets(low, high)) and (strong_secrets.meets(low, high) or weak_secrets.meets(low, high)):
            spans.append(("endpoint", s, e))
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per input row: doc_id, found (array of kind, start, end, in code points, end exclusive).

    Strong kinds are all matches of their patterns; weak kinds only those that complementary parts
    support. Null and empty texts have none; texts are searched whole. Repeated rows are alike,
    null identifiers pass through, an empty table gives an empty result; other columns are not
    read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for piece in pieces(batch, "text"):
                likely = pc.match_substring_regex(piece.column("text"), _LIKELY).to_numpy(zero_copy_only=False)
                found: list[list] = [[] for _ in likely]
                for i in np.flatnonzero(likely):
                    found[i] = [{"kind": k, "start": s, "end": e} for k, s, e in find(piece.column("text")[int(i)].as_py(), reach)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(found, kind)], ["doc_id", "found"])

    return rows.mapInArrow(run, f"doc_id {id_type}, found array<struct<kind:string,start:bigint,end:bigint>>")


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
