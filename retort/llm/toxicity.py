"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Each word is a vector of two learned inputs: a word embedding and the mean of the embeddings of its
character n-grams (both hashed into tables of fixed size). A long word, as a clause in a script
without spaces is, goes in as overlapping parts with n-grams of their own, so that each part counts
as much as a short word. A forward
and a backward GRU run over windows of words, every window half over the next, so that all of a
text is scored; attention pools a window's states, and a text has the score of its worst window.
Training sees a text's label only: in every step the window that scores highest stands for its
text. The embeddings start from the log odds of the tables' cells in the training texts.

The training sample is bounded (``max_per_label``) and comes to the driver; scoring runs in the
tasks with the weights broadcast (their size is fixed by the settings below).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retort.llm.text import Words, mix, pieces, release, saved

WINDOW, STRIDE = 32, 16
WORD_CELLS, GRAM_CELLS = 1 << 18, 1 << 17
WORD_DIM = GRAM_DIM = 6
HIDDEN, ATTENTION = 8, 8
GRAMS = (4, 5)
#: Bytes of a part of a word, with the mark of the word's beginning, and those of the next part that
#: it holds too: no n-gram is between parts.
PART, OVERLAP = 16, max(GRAMS) - 1
#: N-grams whose vectors are looked up at once.
LOOKED_UP = 1 << 18

#: Labelled rows of each label that training may take, in an order by hash; bytes of one of their
#: texts, and of those of a label together, as they come to the driver.
MAX_PER_LABEL = 2500
MAX_TEXT_BYTES, MAX_BYTES_PER_LABEL = 1 << 20, 1 << 27
#: Rounds of choosing the windows that stand for the texts, and optimiser steps on those in each,
#: with about so many texts in a step; the same for every number of texts.
ROUNDS, STEPS, STEP_TEXTS = 3, 320, 64
#: Windows that go through the network at once, which bounds the memory of a long text's states.
BLOCK_WINDOWS = 1 << 12
#: Texts that a cell must be seen in to have a vector of its own, and the weight of the base rate
#: in its log odds, in texts: what few texts have says little.
LEAST_TEXTS, BASE_TEXTS = 3, 10.0
LIMIT = 0.7
SEED = 20

#: Words are letters and digits: ASCII ones and all bytes of longer characters.
_SEPARATES = np.ones(256, bool)
_SEPARATES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _spread(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of all entries of some rows, where row i has those from at[i] up to at[i + 1]."""
    sizes = at[rows + 1] - at[rows]
    return np.arange(sizes.sum()) + np.repeat(at[rows] - np.cumsum(sizes) + sizes, sizes)


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(sizes)).astype(np.int64)


class _Input:
    """Parts of the distinct words of a run of texts, as table cells, and the windows over each text's words.

    ``grams`` has the n-grams of all parts, those of part i from at[i] up to at[i + 1].
    """

    def __init__(self, texts: pa.Array):
        words = Words(texts, lower=True, separates=_SEPARATES)
        hashes, first, word = np.unique(words.hashes, return_index=True, return_inverse=True)
        size = words.ends[first] - words.starts[first] + 1  # with the mark of the beginning
        parts = np.maximum(1, -(-(size - OVERLAP) // (PART - OVERLAP)))
        part_at = _bounds(parts)
        self.cell = np.repeat((mix(hashes, 0xB8E1AFED6A267E96) >> np.uint64(40)).astype(np.int64) % WORD_CELLS, parts)
        skip = (np.arange(part_at[-1]) - np.repeat(part_at[:-1], parts)) * (PART - OVERLAP)
        held = np.minimum(np.repeat(size, parts) - skip, PART)
        room = np.maximum(held, min(GRAMS))  # the shortest words have one
        byte_at = _bounds(room)
        place = np.arange(byte_at[-1]) - np.repeat(byte_at[:-1], room)
        left = np.repeat(room, room) - place
        at = np.repeat(words.starts[first].repeat(parts) + skip - 1, room) + place
        value = _LOWER[words.bytes[np.clip(at, 0, len(words.bytes) - 1)]] if len(at) else np.zeros(0, np.uint64)
        value[np.repeat(held, room) <= place] = 0
        value[byte_at[:-1][skip == 0]] = 1
        value = np.append(value, np.zeros(max(GRAMS), np.uint64))
        cells = np.zeros((len(at), len(GRAMS)), np.int64)
        for i, n in enumerate(GRAMS):
            gram = np.zeros(len(at), np.uint64)
            for k in range(n):
                gram = gram * np.uint64(257) + value[k : k + len(at)]
            cells[:, i] = (mix(gram, n) >> np.uint64(40)).astype(np.int64) % GRAM_CELLS
        self.grams = cells[left[:, None] >= np.array(GRAMS)]
        self.at = _bounds(sum(np.maximum(room - n + 1, 0) for n in GRAMS))
        self.word, bounds = _spread(part_at, word), _bounds(parts[word])[words.bounds]
        starts, owner, ends = [], [], []
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if b > a:
                own = np.arange(a, max(a + 1, b - WINDOW + STRIDE), STRIDE)
                if b - a > WINDOW:
                    own[-1] = b - WINDOW
                starts.append(own)
                owner.append(np.full(len(own), i))
                ends.append(np.full(len(own), b))
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        starts, self.owner, ends = join(starts), join(owner), join(ends)
        place = starts[:, None] + np.arange(WINDOW)
        self.mask = place < ends[:, None]
        self.windows = np.where(self.mask, self.word[np.minimum(place, max(len(self.word) - 1, 0))] if len(self.word) else 0, 0)
        self.n = len(texts)


def _subset(x, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """cell, grams and their number of the words in some windows, and these windows over them, and masks."""
    words, windows = np.unique(x.windows[rows], return_inverse=True)
    return x.cell[words], x.grams[_spread(x.at, words)], np.diff(x.at)[words], windows.reshape(-1, WINDOW), x.mask[rows]


class _Chosen:
    """Windows of many texts together, with the words in them."""

    def __init__(self, parts: list, owner: np.ndarray):
        at = np.cumsum([0, *[len(p[0]) for p in parts]])
        self.cell, self.grams, sizes = (np.concatenate([p[k] for p in parts]) for k in range(3))
        self.at = _bounds(sizes)
        self.windows = np.concatenate([p[3] + a for p, a in zip(parts, at, strict=False)])
        self.mask, self.owner = np.concatenate([p[4] for p in parts]), owner


_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    dim = WORD_DIM + GRAM_DIM
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    weights = {"words": 0.1 * draw(WORD_CELLS, WORD_DIM) * 0, "grams": 0.1 * draw(GRAM_CELLS, GRAM_DIM) * 0}
    for d in "fb":
        weights |= {f"x{d}": draw(dim, 3 * HIDDEN), f"h{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    weights |= {"a": draw(2 * HIDDEN, ATTENTION), "v": draw(ATTENTION), "o": draw(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
    return weights


def inputs(w: dict, x) -> np.ndarray:
    """A vector per distinct word."""
    sizes, sums = np.diff(x.at), np.zeros((len(x.cell), GRAM_DIM), w["grams"].dtype)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for a in range(0, len(owner), LOOKED_UP):
        own = owner[a : a + LOOKED_UP]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        sums[own[first]] += np.add.reduceat(w["grams"][x.grams[a : a + LOOKED_UP]], first)
    return np.concatenate([w["words"][x.cell], sums / sizes[:, None].astype(sums.dtype)], 1)


def _run(w: dict, vectors: np.ndarray, windows: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
    """States [time, window, hidden] of one direction."""
    table, n = vectors @ w[f"x{d}"] + w[f"c{d}"], len(windows)
    states = np.zeros((WINDOW, n, HIDDEN), np.float32)
    h = np.zeros((n, HIDDEN), np.float32)
    for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
        x, rec = table[windows[:, t]], h @ w[f"h{d}"]
        gates = _sigmoid(x[:, : 2 * HIDDEN] + rec[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(x[:, 2 * HIDDEN :] + r * rec[:, 2 * HIDDEN :])
        z = np.where(mask[:, t, None], z, np.float32(1))
        if keep is not None:
            keep.append((t, h, z, r, new, rec[:, 2 * HIDDEN :]))
        h = new + z * (h - new)
        states[t] = h
    return states


def forward(w: dict, vectors: np.ndarray, windows: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logit of each window."""
    runs = {d: [] if keep is not None else None for d in "fb"}
    states = np.concatenate([_run(w, vectors, windows, mask, d, runs[d]) for d in "fb"], 2)
    look = np.tanh(states @ w["a"])
    weight = np.where(mask.T, look @ w["v"], np.float32(-1e9))
    weight = np.exp(weight - weight.max(0))
    weight /= weight.sum(0)
    pooled = np.einsum("tn,tnh->nh", weight, states)
    if keep is not None:
        keep |= {"runs": runs, "states": states, "look": look, "weight": weight, "pooled": pooled}
    return pooled @ w["o"] + w["bias"]


def backward(w: dict, x, vectors: np.ndarray, windows: np.ndarray, mask: np.ndarray, keep: dict, d_logit: np.ndarray) -> dict:
    """Gradients of all weights, each with the rows of the weight that it is for."""
    states, look, weight = keep["states"], keep["look"], keep["weight"]
    grads = {"o": keep["pooled"].T @ d_logit, "bias": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * w["o"]
    d_states = weight[:, :, None] * d_pooled
    d_weight = np.einsum("tnh,nh->tn", states, d_pooled)
    d_score = weight * (d_weight - (weight * d_weight).sum(0))
    d_look = d_score[:, :, None] * w["v"] * (1 - look**2)
    grads["v"] = np.einsum("tna,tn->a", look, d_score)
    grads["a"] = np.einsum("tnh,tna->ha", states, d_look)
    d_states = d_states + d_look @ w["a"].T
    d_vectors = np.zeros_like(vectors)
    for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
        d_h = np.zeros((len(windows), HIDDEN), np.float32)
        for name in (f"x{d}", f"h{d}", f"c{d}"):
            grads[name] = np.zeros_like(w[name])
        for t, before, z, r, new, rec in reversed(keep["runs"][d]):
            d_h = d_h + d_states[t][:, part]
            d_new = d_h * (1 - z) * (1 - new**2)
            d_z = d_h * (before - new) * z * (1 - z)
            d_r = d_new * rec * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_new], 1)
            d_rec = np.concatenate([d_z, d_r, d_new * r], 1)
            at = windows[:, t]
            grads[f"x{d}"] += vectors[at].T @ d_x
            grads[f"h{d}"] += before.T @ d_rec
            grads[f"c{d}"] += d_x.sum(0)
            np.add.at(d_vectors, at, d_x @ w[f"x{d}"].T)
            d_h = d_h * z + d_rec @ w[f"h{d}"].T
    found = {name: (slice(None), g) for name, g in grads.items()}
    sizes = np.diff(x.at)
    for name, cells, d_rows in (
        ("words", x.cell, d_vectors[:, :WORD_DIM]),
        ("grams", x.grams, np.repeat(d_vectors[:, WORD_DIM:] / sizes[:, None], sizes, axis=0)),
    ):
        own, place = np.unique(cells, return_inverse=True)
        g = np.zeros((len(own), w[name].shape[1]), np.float32)
        np.add.at(g, place.reshape(-1), d_rows.reshape(-1, g.shape[1]))
        found[name] = (own, g)
    return found


def window_logits(w: dict, x: _Input) -> np.ndarray:
    """Logit of each window, a block of them at a time."""
    vectors, blocks = inputs(w, x), range(0, len(x.owner), BLOCK_WINDOWS)
    return np.concatenate([forward(w, vectors, x.windows[a : a + BLOCK_WINDOWS], x.mask[a : a + BLOCK_WINDOWS]) for a in blocks])


def logits(w: dict, x: _Input) -> np.ndarray:
    """Logit of each text: that of its worst window; of a text without words, the bias."""
    found = np.full(x.n, w["bias"][0], np.float32)
    if len(x.owner):
        own = window_logits(w, x)
        first = np.flatnonzero(np.append(True, x.owner[1:] != x.owner[:-1]))
        found[x.owner[first]] = np.maximum.reduceat(own, first)
    return found


def _minibatches(rng: np.random.Generator, n: int, count: int) -> Iterator[np.ndarray]:
    """``count`` draws of about STEP_TEXTS of n rows; each row comes once before any comes again."""
    passes = iter(lambda: np.array_split(rng.permutation(n), max(1, n // STEP_TEXTS)), None)
    return islice(chain.from_iterable(passes), count)


def train(texts: list[str], labels: np.ndarray, rounds: int = ROUNDS, steps: int = STEPS, seed: int = SEED) -> dict | None:
    """Weights fitted to the texts; None without texts of both labels."""
    labels = np.asarray(labels, np.float32)
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    w = initial(rng)
    batches = np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 64))
    load = lambda b: _Input(pa.array([texts[i] for i in b]))
    seen = {name: np.zeros((2, len(w[name]))) for name in ("words", "grams")}
    for b in batches:
        x = load(b)
        for i, label in enumerate(labels[b].astype(int)):
            own = np.unique(x.windows[x.owner == i][x.mask[x.owner == i]])
            seen["words"][label][np.unique(x.cell[own])] += 1
            seen["grams"][label][np.unique(x.grams[_spread(x.at, own)])] += 1
    sizes = np.array([(labels == 0).sum(), (labels == 1).sum()], np.float64)
    usable = {}
    for name, counts in seen.items():
        rates = counts / sizes[:, None]  # as if there were as many texts of either label
        texts_seen = counts.sum(0)
        share = (texts_seen * rates[1] / np.maximum(rates.sum(0), 1e-12) + BASE_TEXTS / 2) / (texts_seen + BASE_TEXTS)
        usable[name] = texts_seen >= LEAST_TEXTS
        w[name][:, 0] = np.where(usable[name], np.log(share / (1 - share)), 0)
    weight = np.where(labels == 1, 0.5 / sizes[1], 0.5 / sizes[0]) * len(labels)
    done, first, second = 0, {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    for turn in range(rounds):
        parts, owners = [], []
        for b in batches:
            x = load(b)
            if not len(x.owner):
                continue
            if turn:
                score = window_logits(w, x)
            else:  # the untrained network can't tell; the word of the highest log odds can
                vectors = inputs(w, x)
                odds = vectors[:, 0] + vectors[:, WORD_DIM]
                score = np.where(x.mask, odds[x.windows], -np.inf).max(1)
            order = np.lexsort((-score, x.owner))
            best = order[np.append(True, x.owner[order][1:] != x.owner[order][:-1])]
            parts.append(_subset(x, best))
            owners.append(b[x.owner[best]])
        if not parts:
            return None
        x = _Chosen(parts, np.concatenate(owners))
        for rows in _minibatches(rng, len(x.owner), steps):
            part = _Chosen([_subset(x, rows)], x.owner[rows])
            vectors, keep = inputs(w, part), {}
            score = forward(w, vectors, part.windows, part.mask, keep)
            d_logit = ((_sigmoid(score) - labels[part.owner]) * weight[part.owner] / len(rows)).astype(np.float32)
            done += 1
            for name, (at, g) in backward(w, part, vectors, part.windows, part.mask, keep, d_logit).items():
                if name in usable:
                    at, g = at[usable[name][at]], g[usable[name][at]]
                first[name][at] += 0.1 * (g - first[name][at])
                second[name][at] += 0.01 * (g**2 - second[name][at])
                size = first[name][at] / (1 - 0.9**done) / (np.sqrt(second[name][at] / (1 - 0.99**done)) + 1e-6)
                w[name][at] -= (0.005 * size).astype(np.float32)
    # the limit is put where the training texts part best; where they part whole, nearer to the clean ones, as texts not seen score less apart
    final, own = [], []
    for b in batches:
        final.append(logits(w, load(b)))
        own.append(labels[b])
    final, own = np.concatenate(final), np.concatenate(own)
    order = np.argsort(final, kind="stable")
    cost = np.where(own[order] == 1, 1.0, -1.0)
    wrong = np.concatenate([[0], np.cumsum(cost)])
    at = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    at = at[len(at) // 2]
    low = final[order[at - 1]] if at > 0 else final[order[0]] - 1
    high = final[order[at]] if at < len(order) else final[order[-1]] + 1
    w["shift"] = np.array([np.log(LIMIT / (1 - LIMIT)) - (0.7 * low + 0.3 * high)], np.float32)
    return w


def fit(docs: DataFrame, labels: DataFrame, label_col: str, usable, max_per_label: int = MAX_PER_LABEL) -> dict | None:
    """Weights from at most ``max_per_label`` documents of each label, of the labelled rows that
    ``usable`` (a function of the identifier column) allows; the same for the same rows.

    Texts over MAX_TEXT_BYTES aren't learned from, and no more than MAX_BYTES_PER_LABEL of a label.
    """
    rows = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("label"))
    rows = rows.filter(F.col("label").isin(0, 1) & usable(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    picked = [rows.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(max_per_label) for k in (0, 1)]
    picked = picked[0].union(picked[1])
    sample = docs.select(F.col("doc_id").alias("id"), "text").filter(F.col("text").isNotNull()).join(F.broadcast(picked), "id")
    size = F.octet_length("text")
    sample = saved(sample.filter(size <= MAX_TEXT_BYTES).groupBy("id", "label").agg(F.min("text").alias("text")), "toxicity-sample")
    # identifiers and sizes of the sampled rows only
    so_far = F.sum("bytes").over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))
    fitting = sample.select("id", "label", size.alias("bytes")).withColumn("so_far", so_far).filter(F.col("so_far") <= MAX_BYTES_PER_LABEL)
    rows = sample.join(F.broadcast(fitting.select("id")), "id", "left_semi").orderBy(F.xxhash64("id"), "id").toPandas()
    release(sample)
    return train(rows["text"].tolist(), rows["label"].to_numpy())


def _scores(w: dict, texts: pa.Array) -> np.ndarray:
    return _sigmoid(logits(w, _Input(texts)).astype(np.float64) + float(w["shift"][0]))


def score_documents(docs: DataFrame, weights: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), predicted (1 from a score of 0.7 on).

    Null and wordless texts have the score of no evidence; without weights (no labels to learn
    from) every score is 0. Null identifiers pass through, repeated rows score alike; an empty
    table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if weights is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                score = _scores(w, piece.column("text"))
                columns = [piece.column("doc_id"), pa.array(score), pa.array((score >= LIMIT).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {id_type}, score double, predicted int")


def clean_documents(docs: DataFrame, weights: dict | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, in all their columns, that score_documents would not mark as toxic."""
    if weights is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text_col):
                yield piece.filter(pa.array(_scores(shared.value, piece.column(text_col)) < LIMIT))

    return docs.mapInArrow(run, docs.schema)
