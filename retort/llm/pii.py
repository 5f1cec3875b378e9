"""Personal data: strict patterns, and looser candidates judged by gradient-boosted trees.

Generators propose whatever might be an address, a number of a network, card or telephone, written
in any way: their spans overlap, and most are wrong. Boosted trees score each by its format and by
what stands around it, the scores are calibrated to probabilities, and per kind a threshold picks
those that are right often enough. Of overlapping picks the likeliest stays; none overlaps a strict
match.

The trees learn here, without labels: strict matches of a bounded sample of the documents are
rewritten as people write them (``at`` for ``@``, other separators, no ``+``) and count as right;
all that the generators propose elsewhere in those documents, or at other borders, counts as wrong.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.llm.text import pieces

#: Kinds in the order in which spans are listed.
BASE = ("email", "ip", "card", "phone")
LIKE = ("email_like", "ip_like", "card_like", "phone_like")
KINDS = BASE + LIKE

#: Documents that the trees learn from, about, and examples of one document at most.
SAMPLE_DOCS = 20_000
EXAMPLES_PER_DOC = 24
#: Share of picks that must be right on the examples held out for calibration, of so many at least.
PRECISION = 0.95
MIN_RIGHT = 20

ROUNDS, DEPTH, BINS, STEP, RIDGE = 60, 4, 32, 0.2, 1.0
CONTEXT = 40

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a digit before would have begun the match already, so all four scan a text once
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Texts in which any pattern or generator can match.
_LIKELY = r"@|＠|(?i:[(\[{]at[)\]}]| at .{0,64}dot)|[0-9][^0-9A-Za-z]{0,3}[0-9]"

_GROUP = re.compile(r"[0-9]+")
_BETWEEN = frozenset(" ().,/_-–[]\xa0")
_AT = re.compile(r"@|＠| ?[(\[{]at[)\]}] ?| at ", re.I)
_BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]+$")
_AFTER_AT = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.| ?[(\[{]dot[)\]}] ?| dot )[A-Za-z0-9-]{1,63}){1,5}", re.I)
_DOT = re.compile(r"\.| ?[(\[{]dot[)\]}] ?| dot ", re.I)


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def strict_spans(text: str) -> list[Span]:
    """All matches of the strict patterns, by kind as listed, then start."""
    spans, end, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > end and text[left - 1] in _LOCAL:
            left -= 1
        domain = _DOMAIN.match(text, at + 1) if left < at else None
        if domain:
            end = domain.end()
            spans.append(("email", left, end))
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 38:  # 19 digits and 18 marks between them at most
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                spans.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(m[0].count, "0123456789")) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def proposals(text: str) -> Iterator[Span]:
    """Spans that might be personal data, overlapping, of the ``LIKE`` kinds."""
    groups: list[tuple[int, int]] = []
    for m in _GROUP.finditer(text):
        gap = text[groups[-1][1] : m.start()] if groups and m.start() - groups[-1][1] <= 3 else None
        if gap is None or not _BETWEEN.issuperset(gap):
            groups = []
        groups = [*groups[-7:], m.span()]
        digits = 0
        for k in range(len(groups) - 1, -1, -1):  # runs of at most eight groups that end in this one
            digits += groups[k][1] - groups[k][0]
            if digits > 19:
                break
            start, end = groups[k][0], m.end()
            if start and text[start - 1] in "+(":
                start -= 1 + (start > 1 and text[start - 2 : start] == "+(")
            if len(groups) - k == 4 and all(e - s <= 3 for s, e in groups[k:]):
                yield "ip_like", groups[k][0], end
            if 7 <= digits <= 15:
                yield "phone_like", start, end
            if 13 <= digits:
                yield "card_like", groups[k][0], end
    for m in _AT.finditer(text):
        before = _BEFORE_AT.search(text, max(0, m.start() - 64), m.start())
        after = _AFTER_AT.match(text, m.end())
        if before and after:
            yield "email_like", before.start(), after.end()
            dots = list(_DOT.finditer(after[0]))
            if len(dots) > 1:  # what follows may be the next sentence
                yield "email_like", before.start(), m.end() + dots[-1].start()


FEATURES = (
    "is_email is_ip is_card is_phone length digits groups longest_group shortest_group first_group last_group marks longest_gap "
    "plus brackets letters luhn bytes even_groups before after run_before run_after digits_before digits_after "
    "letters_before marks_around key_before labels last_label worded repeated"
).split()


def _class(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3 if c in "\"'=:" else 4


def _share(text: str, test) -> float:
    return sum(map(test, text)) / len(text) if text else 0.0


def described(text: str, span: Span) -> list[float]:
    """The features of a proposed span: its format, then its context."""
    kind, s, e = span
    inside, left, right = text[s:e], text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT]
    groups = _GROUP.findall(inside)
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    gaps = re.split(r"[0-9]+", inside)[1:-1]
    labels = _DOT.split(inside[m.end() :]) if kind == LIKE[0] and (m := _AT.search(inside)) else [""]
    beyond = lambda t: len(t) - len(t.lstrip("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return [
        *(float(kind == k) for k in LIKE),
        len(inside),
        len(digits),
        len(groups),
        max(sizes),
        min(sizes),
        sizes[0],
        sizes[-1],
        len({c for c in inside if not c.isalnum()}),
        max(map(len, gaps), default=0),
        inside.startswith("+") + 2 * inside.startswith("00"),
        inside.count("("),
        sum(map(str.isalpha, inside)),
        13 <= len(digits) <= 19 and _luhn(digits),
        len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups),
        len(set(sizes)) == 1,
        _class(left[-1:]),
        _class(right[:1]),
        beyond(left[::-1]),
        beyond(right),
        _share(left, str.isdigit),
        _share(right, str.isdigit),
        _share(left, str.isalpha),
        _share(left + right, lambda c: not c.isalnum() and not c.isspace()),
        any(c in "\"'=:" for c in left[-3:]),
        len(labels),
        len(labels[-1]),
        kind == LIKE[0] and "@" not in inside and "＠" not in inside,
        len(digits) - len(set(digits)),
    ]


def rewritten(kind: str, found: str, draw: int) -> str:
    """A strict match as it is written by hand; ``draw`` chooses how."""
    if kind == "email":
        name, domain = found.split("@")
        at = ("(at)", " at ", "[at]", "＠", " (at) ")[draw % 5]
        return name + at + domain.replace(".", (" dot ", "(dot)", ".", "[dot]")[draw // 5 % 4] if at != "＠" else ".")
    if kind == "ip":
        return found.replace(".", (",", " . ", "[.]", "-", "_")[draw % 5])
    digits = "".join(_GROUP.findall(found))
    if kind == "card":
        return (".", "/", "  ", "_", " - ")[draw % 5].join(digits[k : k + 4] for k in range(0, len(digits), 4))
    loose = re.sub(r"[ ().-]+", (" ", "-", "/", ".", ") ")[draw % 5], found)
    return ("00" if draw // 5 % 3 == 0 else "") + loose.removeprefix("+")


def examples(text: str, limit: int = EXAMPLES_PER_DOC) -> list[tuple[int, list[float]]]:
    """(label, features) from one text: rewritten strict matches, other borders, and what else is proposed."""
    right, wrong = [], []
    strict = strict_spans(text)
    for kind, s, e in strict:
        if e - s > 80:
            continue
        new = rewritten(kind, text[s:e], zlib.crc32(text[s:e].encode("utf-8", "surrogatepass")))
        left = text[max(0, s - CONTEXT) : s]
        snippet, want = left + new + text[e : e + CONTEXT], (f"{kind}_like", len(left), len(left) + len(new))
        for span in proposals(snippet):
            if span == want:
                right.append((1, described(snippet, span)))
            elif span[1] < want[2] and span[2] > want[1] and (span[0] == want[0] or span[2] - span[1] < 0.8 * len(new)):
                wrong.append((0, described(snippet, span)))
    taken = _Taken((s, e) for _, s, e in strict)
    for span in proposals(text):
        if len(wrong) >= limit:
            break
        if taken.free(span[1], span[2]):
            wrong.append((0, described(text, span)))
    return right[: limit // 2] + wrong[: limit // 2]


class _Taken:
    """Disjoint intervals in order."""

    def __init__(self, spans=()):
        self.spans = sorted(spans)

    def free(self, start: int, end: int) -> bool:
        k = bisect_left(self.spans, (end,))
        return all(self.spans[i][1] <= start for i in range(max(0, k - 4), k))

    def add(self, start: int, end: int) -> None:
        insort(self.spans, (start, end))


class Trees:
    """Gradient-boosted trees for log odds: equal depth, splits on binned features, then a calibration."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray):
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1], method="nearest")) for c in x.T]
        self.edges = edges
        cells, learn = self._binned(x), ~held
        self.start = float(np.log((y[learn].sum() + 1) / ((1 - y[learn]).sum() + 1)))
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        score = np.full(len(y), self.start)
        for _ in range(ROUNDS):
            tree = self._tree(cells[learn], y[learn], score[learn])
            self.nodes.append(tree)
            score += self._value(tree, cells)
        self.slope, self.offset = self._calibrate(score[held], y[held])
        sure = self._sure(score)
        self.thresholds = np.full(len(LIKE), 2.0)  # a kind without enough proof is never picked
        for k in range(len(LIKE)):
            of = held & (x[:, k] == 1)
            order = np.argsort(-sure[of], kind="stable")
            p, hits = sure[of][order], np.cumsum(y[of][order])
            fine = np.flatnonzero((hits >= MIN_RIGHT) & (hits >= PRECISION * np.arange(1, len(p) + 1)))
            fine = fine[[i + 1 == len(p) or p[i + 1] < p[i] for i in fine]] if len(fine) else fine
            if len(fine):
                self.thresholds[k] = max(0.5, p[fine[-1]])

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1).astype(np.int16)

    @staticmethod
    def _tree(cells: np.ndarray, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-score))
        slope, bend = y - p, np.maximum(p * (1 - p), 1e-9)
        inner = (1 << DEPTH) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS)
        at = np.zeros(len(y), np.int64)  # place of a row within its level
        for depth in range(DEPTH):
            wide, first = 1 << depth, (1 << depth) - 1
            best = np.full(wide, 1e-6)
            for f in range(cells.shape[1]):
                key = at * BINS + cells[:, f]
                g = np.bincount(key, slope, wide * BINS).reshape(wide, BINS).cumsum(1)
                h = np.bincount(key, bend, wide * BINS).reshape(wide, BINS).cumsum(1)
                total_g, total_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + RIDGE) + (total_g - g) ** 2 / (total_h - h + RIDGE) - total_g**2 / (total_h + RIDGE)
                where = gain.argmax(1)
                top = gain[np.arange(wide), where]
                better = top > best
                best[better] = top[better]
                feature[first : first + wide][better] = f
                cut[first : first + wide][better] = where[better]
            node = first + at
            at = 2 * at + (cells[np.arange(len(at)), feature[node]] > cut[node])
        leaves = 1 << DEPTH
        g, h = np.bincount(at, slope, leaves), np.bincount(at, bend, leaves)
        return feature, cut, STEP * g / (h + RIDGE)

    @staticmethod
    def _value(tree: tuple[np.ndarray, np.ndarray, np.ndarray], cells: np.ndarray) -> np.ndarray:
        feature, cut, leaf = tree
        at, rows = np.zeros(len(cells), np.int64), np.arange(len(cells))
        for depth in range(DEPTH):
            node = (1 << depth) - 1 + at
            at = 2 * at + (cells[rows, feature[node]] > cut[node])
        return leaf[at]

    @staticmethod
    def _calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Slope and offset of the log odds by Newton steps, with targets drawn in from 0 and 1."""
        slope, offset, right = 1.0, 0.0, y.sum()
        aim = np.where(y == 1, (right + 1) / (right + 2), 1 / (len(y) - right + 2))
        for _ in range(25):
            p = 1 / (1 + np.exp(-(slope * score + offset)))
            w, rest = p * (1 - p) + 1e-9, p - aim
            hessian = np.array([[(w * score**2).sum(), (w * score).sum()], [(w * score).sum(), w.sum()]]) + 1e-6 * np.eye(2)
            step = np.linalg.solve(hessian, [(rest * score).sum(), rest.sum()])
            slope, offset = slope - float(np.clip(step[0], -1, 1)), offset - float(np.clip(step[1], -2, 2))
        return slope, offset

    def _sure(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.offset, -50, 50)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        cells = self._binned(x)
        return self._sure(self.start + sum(self._value(t, cells) for t in self.nodes))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Trees | None:
    """Trees from about ``SAMPLE_DOCS`` different documents, drawn by a hash; None without strict matches in them.

    The sample is bounded at every size, and so are the examples of a document, which the driver
    learns from. A quarter of the documents is held out for calibration and thresholds.
    """
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter(F.pmod("key", F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, labels, values = [], [], [], []
            texts = batch.column("text")
            for i in _likely(texts):
                for k, (label, features) in enumerate(examples(texts[int(i)].as_py())):
                    keys.append(batch.column("key")[int(i)].as_py())
                    places.append(k)
                    labels.append(label)
                    values.append([float(v) for v in features])
            arrays = [pa.array(keys, pa.int64()), pa.array(places, pa.int32()), pa.array(labels, pa.int32()), pa.array(values, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "place", "label", "x"])

    made = rows.mapInArrow(run, "key long, place int, label int, x array<float>").dropDuplicates(["key", "place"])
    table = made.toArrow().sort_by([("key", "ascending"), ("place", "ascending")])
    y = table["label"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return None
    x = np.array(table["x"].combine_chunks().values, dtype=float).reshape(len(y), len(FEATURES))
    held = table["key"].to_numpy() % 4 == 0
    if not 0 < y[~held].sum() < (~held).sum() or not held.any():
        return None
    return Trees(x, y, held)


def _likely(texts: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, _LIKELY), False).to_numpy(zero_copy_only=False))


def _picked(texts: list[str], trees: Trees | None) -> list[list[Span]]:
    """All spans of each text, by kind as listed, then start."""
    found = [strict_spans(t) for t in texts]
    if trees is None:
        return found
    taken = [_Taken((s, e) for _, s, e in spans) for spans in found]
    # some thousand proposals are scored at once; those that can be picked wait for the text's end
    waiting, hopeful = [], []

    def judge() -> None:
        if waiting:
            sure = trees.probability(np.array([w[2] for w in waiting], float))
            hopeful.extend((i, -p, span) for (i, span, _), p in zip(waiting, sure, strict=True) if p >= trees.thresholds[LIKE.index(span[0])])
            waiting.clear()

    for i, text in enumerate(texts):
        for span in proposals(text):
            if taken[i].free(span[1], span[2]):
                waiting.append((i, span, described(text, span)))
                if len(waiting) >= 8192:
                    judge()
    judge()
    for i, _, (kind, s, e) in sorted(hopeful, key=lambda h: (h[0], h[1], h[2][1], -h[2][2], h[2][0])):
        if taken[i].free(s, e):
            taken[i].add(s, e)
            found[i].append((kind, s, e))
    return [sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])) for spans in found]


def find_personal_data(docs: DataFrame, trees: Trees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, found (array of kind, start, end, in code points, end exclusive).

    The strict kinds are all matches of their patterns; the ``_like`` kinds are the proposals that
    ``trees`` pick (none if it is None). Null and empty texts have none; texts are searched
    whole, and a text's proposals are scored some thousand at a time. Repeated rows are alike,
    null identifiers pass through, an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for piece in pieces(batch, "text"):
                found: list[list] = [[] for _ in range(piece.num_rows)]
                likely = _likely(piece.column("text"))
                texts = [piece.column("text")[int(i)].as_py() for i in likely]
                for i, spans in zip(likely, _picked(texts, trees), strict=True):
                    found[i] = [{"kind": k, "start": s, "end": e} for k, s, e in spans]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(found, kind)], ["doc_id", "found"])

    return rows.mapInArrow(run, f"doc_id {id_type}, found array<struct<kind:string,start:bigint,end:bigint>>")


def redacted(text: Column, found: Column) -> Column:
    """The text with each span of ``found`` replaced by its kind in angle brackets."""
    ordered = F.array_sort(found, lambda a, b: (a["start"] - b["start"]).cast("int"))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        start = F.greatest(span["start"], state["at"])
        plain = F.substr(text, (state["at"] + 1).cast("int"), (start - state["at"]).cast("int"))
        more = F.concat(state["out"], plain, F.lit("<"), span["kind"], F.lit(">"))
        overlaps = span["end"] <= state["at"]
        return F.struct(
            F.greatest(span["end"], state["at"]).alias("at"), F.when(overlaps, state["out"]).otherwise(more).alias("out")
        )

    return F.aggregate(ordered, begin, step, lambda s: F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"), F.length(text))))
