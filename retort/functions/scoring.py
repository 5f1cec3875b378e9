"""Text-similarity scores and token counts that need Python inside the task.

Each scorer is an Arrow UDF over (candidates of a record, reference): the record is
not exploded, so scoring adds no shuffle, and models are loaded once per task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Score = Callable[[str, str], float]


def scorer(make: Callable[[], Score]) -> Callable[[Column, Column], Column]:
    """Column function (ARRAY<STRING>, STRING) -> ARRAY<DOUBLE> from a score factory.

    Null candidates stay null; a candidate the score fails on gets 0.0.
    """

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = make()

        def safe(candidate, reference):
            if candidate is None:
                return None
            try:
                return float(score(candidate, reference or ""))
            except (ArithmeticError, ValueError):  # of the score itself; a missing library is no score
                return 0.0

        for candidates, references in batches:
            yield pd.Series(
                [
                    None if cs is None else [safe(c, r) for c in cs]
                    for cs, r in zip(candidates, references)
                ]
            )

    return run


#: Characters of texts scored together.
SCORED_CHARS = 1 << 22
MAX_ORDER = 4


def bleu_batch(candidates: list[list[str]], record: np.ndarray, references: list[list[str]]) -> np.ndarray:
    """BLEU in percent of token lists, ``record`` (rising) naming each one's reference.

    Effective order, exponential smoothing and brevity penalty. The n-grams of a record are whole
    numbers, made from those of the order before and the next token; a candidate's n-gram goes on to
    the next order only if the reference has it. A reference is counted once, and the candidates
    are counted beside it, the first of all records together, then the second, and so on.
    """
    if not candidates:
        return np.zeros(0)
    n_ref, texts = len(references), [*references, *candidates]
    sizes = np.array([len(t) for t in texts])
    owner, first = np.repeat(np.arange(len(texts)), sizes), np.concatenate([[0], np.cumsum(sizes)])
    tokens = np.empty(len(owner) + MAX_ORDER, object)
    tokens[:-MAX_ORDER] = [t for text in texts for t in text]
    tokens[-MAX_ORDER:] = ""
    token, kinds = pd.factorize(tokens)
    token, n_kinds = token.astype(np.int64), len(kinds)
    of = np.concatenate([np.arange(n_ref), record])
    turn = np.concatenate([[-1] * n_ref, np.arange(len(record)) - np.searchsorted(record, record)])  # which of a record's
    at, code = np.arange(len(owner)), of[owner]
    matched = np.zeros((MAX_ORDER + 1, len(texts)))
    for n in range(1, MAX_ORDER + 1):
        inside = at + n <= first[owner[at] + 1]
        at, code = at[inside], code[inside]
        gram, names = pd.factorize(code * n_kinds + token[at + n - 1])
        text = owner[at]
        known = np.bincount(gram[text < n_ref], minlength=len(names))
        keep = (text < n_ref) | (known[gram] > 0)
        at, code, text = at[keep], gram[keep].astype(np.int64), text[keep]
        by_turn = np.argsort(turn[text], kind="stable")
        ends = np.cumsum(np.bincount(turn[text] + 1))
        for low, high in zip(ends, ends[1:]):
            where = by_turn[low:high]
            if len(where):
                counts = np.bincount(code[where], minlength=len(names))
                # one text of a record at a time, so a gram of the record belongs to one text
                grams, place = code[where], text[where]
                share = np.minimum(counts, known)[grams] / counts[grams]
                matched[n] += np.bincount(place, share, len(texts))
    matched = np.rint(matched[:, n_ref:])
    logs, orders, any_match = (np.zeros(len(candidates)) for _ in range(3))
    smooth = np.ones(len(candidates))
    for n in range(1, MAX_ORDER + 1):
        total = sizes[n_ref:] - n + 1
        has, hit = total > 0, matched[n] > 0
        any_match += hit
        smooth[has & ~hit] *= 2
        with np.errstate(divide="ignore", invalid="ignore"):
            logs += np.where(has, np.log(np.where(hit, 100 * matched[n] / total, 100 / (smooth * total))), 0.0)
        orders += has
    penalty = np.minimum(0.0, 1 - sizes[record] / np.maximum(sizes[n_ref:], 1))
    return np.where(any_match > 0, np.exp(penalty + logs / np.maximum(orders, 1)), 0.0)


def bleu_scores(tokenizer: str = "whitespace") -> Callable[[Column, Column], Column]:
    """Sentence BLEU rounded to 4 places; blank sides score 0, null candidates stay null.

    ``tokenizer`` is ``whitespace``, ``char`` or the path of a SentencePiece model
    (the multilingual one of spBLEU, which is not bundled). Executors must be able to
    read the path. Records are scored some megabytes of text at a time, one at least.
    """

    def splitter() -> Callable[[str], list[str]]:
        if tokenizer == "whitespace":
            return str.split
        if tokenizer == "char":
            return lambda text: list("".join(text.split()))
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
        return lambda text: model.encode(text, out_type=str)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        split = splitter()

        def scored(rows: list[tuple[list[str | None], str]]) -> list[list[float | None]]:
            texts, owner, references = [], [], []
            for k, (candidates, reference) in enumerate(rows):
                # a blank reference scores 0 whatever the candidates, which need no tokens then
                blank = not reference.strip()
                references.append([] if blank else split(reference))
                different = dict.fromkeys(c for c in candidates if c is not None)
                texts += [[] if blank else split(c) for c in different]
                owner += [k] * len(different)
            values = iter(round(v, 4) for v in bleu_batch(texts, np.array(owner, np.int64), references).tolist())
            scores = ({c: next(values) for c in dict.fromkeys(c for c in candidates if c is not None)} for candidates, _ in rows)
            return [[found.get(c) for c in candidates] for (candidates, _), found in zip(rows, scores)]

        for candidates, references in batches:
            out: list = [None] * len(candidates)
            rows, places, held = [], [], 0
            for k, (options, reference) in enumerate(zip(candidates, references)):
                if options is not None:
                    rows.append((list(options), reference or ""))
                    places.append(k)
                    held += len(rows[-1][1]) + sum(len(c) for c in rows[-1][0] if c)
                if rows and (held >= SCORED_CHARS or k + 1 == len(candidates)):
                    for place, values in zip(places, scored(rows)):
                        out[place] = values
                    rows, places, held = [], [], 0
            if rows:
                for place, values in zip(places, scored(rows)):
                    out[place] = values
            yield pd.Series(out)

    return run


def exact_meteor(candidate: list[str], reference: list[str]) -> float:
    """METEOR with the exact-match stage only (alpha 0.9, beta 3, gamma 0.5)."""
    places: dict[str, list[int]] = {}
    for i, token in enumerate(reference):
        places.setdefault(token, []).append(i)
    pairs = []
    for i in range(len(candidate) - 1, -1, -1):
        if places.get(candidate[i]):
            pairs.append((i, places[candidate[i]].pop()))
    if not pairs:
        return 0.0
    pairs.reverse()
    chunks = 1 + sum(
        (b[0] - a[0], b[1] - a[1]) != (1, 1) for a, b in zip(pairs, pairs[1:])
    )
    precision, recall = len(pairs) / len(candidate), len(pairs) / len(reference)
    mean = precision * recall / (0.9 * precision + 0.1 * recall)
    return (1 - 0.5 * (chunks / len(pairs)) ** 3) * mean


def meteor_scores(full: bool = False) -> Callable[[Column, Column], Column]:
    """METEOR on lower-cased tokens.

    ``full`` uses NLTK with its stem and synonym stages and needs NLTK and its data on
    the executors. The default has the exact stage only and must not be read as METEOR.
    """

    def make() -> Score:
        if full:
            from nltk import word_tokenize
            from nltk.translate.meteor_score import meteor_score

            # fails here, and not as a score, where the library's data is missing
            meteor_score([word_tokenize("a word")], word_tokenize("words"))
            return lambda c, r: meteor_score([word_tokenize(r.lower())], word_tokenize(c.lower()))
        token = re.compile(r"\w+|[^\w\s]")
        return lambda c, r: exact_meteor(token.findall(c.lower()), token.findall(r.lower()))

    return scorer(make)


def token_counts(tokenizer_file: str) -> Callable[[Column], Column]:
    """Token count by a ``tokenizers`` JSON file every executor can read."""

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer_file)
        for texts in batches:
            encoded = model.encode_batch_fast(list(texts), add_special_tokens=False)
            yield pd.Series([len(e.ids) for e in encoded])

    return run


def _identifiers(text: str, chem) -> list[str] | None:
    """Sorted distinct InChI of the fragments, atom maps cleared; None if one is unreadable."""
    molecules = [chem.MolFromSmiles(part) for part in text.replace(";", ".").split(".")]
    if any(m is None or m.GetNumAtoms() == 0 for m in molecules):
        return None
    for molecule in molecules:
        for atom in molecule.GetAtoms():
            atom.SetAtomMapNum(0)
    return sorted({chem.MolToInchi(m) for m in molecules})


def molecule_ids() -> Callable[[Column], Column]:
    """InChI sets of a molecule-string column. Needs RDKit on the executors."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from rdkit import Chem

        for texts in batches:
            yield texts.map(lambda t: _identifiers(t, Chem) if t else None)

    return run


def molecule_matches() -> Callable[[Column, Column], Column]:
    """1.0 where a candidate is chemically the reference, for ``answers.mark_molecules``.

    Equal strings match at once; others by InChI sets. Needs RDKit on the executors.
    """

    def make() -> Score:
        from rdkit import Chem

        def score(candidate: str, reference: str) -> float:
            if not candidate:
                return 0.0
            if candidate == reference:
                return 1.0
            ids = _identifiers(candidate, Chem)
            return float(ids is not None and ids == _identifiers(reference, Chem))

        return score

    return scorer(make)
