"""Importance resampling, personal data and whitening against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from retort.llm import importance, pii, whitening
from retort.llm.queries import op7_secret_links, op12_personal_data, op13_spectrum_whitening
from tests.llm.test_llm_operators import ODD, SMALL, documents, empty, odd, rows_of

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
FEATURE_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text, ngram):
    w = FEATURE_WORDS.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) for k in range(1, ngram + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("block", [1, 2, 5, 17, 1 << 20])
def test_checksums_in_blocks(monkeypatch, block):
    monkeypatch.setattr(importance, "BLOCK_BYTES", block)
    draw = random.Random(block)
    for _ in range(200):
        text = "".join(draw.choice(["a", "bc", " ", "É", ".", "9", "漢", "\n", "Zz", "  ", "\x00", "@"]) for _ in range(draw.randint(0, 60)))
        for ngram in (1, 2, 3, 5):
            parts = list(importance.checksums(text.encode(), ngram))
            n, sums = brute_features(text, ngram)
            assert sum(p[0] for p in parts) == n and sorted(c for p in parts for c in p[1]) == sorted(sums)


def brute_resampled(docs, target, ngram, buckets, min_words, percent):
    count = lambda texts: np.bincount([c % buckets for t in texts for c in brute_features(t, ngram)[1]], minlength=buckets)
    s, t = count([text for _, text in docs]), count(target)
    total_s, total_t = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log(((int(b) + 1) * (total_s + buckets)) / ((int(a) + 1) * (total_t + buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        n, sums = brute_features(text, ngram)
        weight = sum(gain[c % buckets] for c in sums)
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(sums), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = [r + (k + 1,) for k, r in enumerate(able[: len(able) * percent // 100])]
    rest = able[len(drawn) :] + [r for r in rows if r[1] < min_words]
    return sorted(drawn + [r + (None,) for r in rest], key=repr)


@pytest.mark.parametrize(("ngram", "buckets"), [(1, 10_000), (3, 50)])
def test_resampled(spark, ngram, buckets):
    draw = random.Random(ngram)
    docs = [(i, " ".join(draw.choice("Alpha beta. gamma, delta 42 été 漢字".split()) for _ in range(draw.randint(0, 40)))) for i in range(300)]
    target = ["beta gamma delta " * 3, None, "", "42 été"]
    frame = odd(spark, [(i, t, "s") for i, t in docs]).withColumn("row", F.lit(0))
    found = importance.resampled(frame, odd(spark, [(k, t, "s") for k, t in enumerate(target)]), ngram=ngram, buckets=buckets, percent=30)
    columns = ("doc_id", "n_words", "n_features", "weight", "score", "rank")
    assert rows_of(found, *columns) == brute_resampled(docs, target, ngram, buckets, 20, 30)


def test_resampled_odd_rows(spark):
    columns = ("doc_id", "n_words", "n_features", "weight", "score", "rank")
    docs = [r[:2] for r in ODD] + [(77, "one text of a hot identifier with several words")] * 50
    found = importance.resampled(odd(spark, [(*r, "s") for r in docs]), empty(spark), min_words=1, percent=100)
    assert rows_of(found, *columns) == brute_resampled(docs, [], 1, importance.BUCKETS, 1, 100)
    assert importance.resampled(empty(spark), odd(spark)).count() == 0


LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_strict(text):
    spans = []
    for kind, pattern in LOOSE.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(sum(divmod(v, 10)) for v in doubled) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            spans.append((kind, *m.span()))
    return spans


def test_strict_spans():
    draw = random.Random(2)
    parts = ["a", "B", "@", ".", "-", " ", "1", "25", "0", "+", "(", ")", "4111 1111 1111 1111", "+1 (705) 555-1234", "a.b@c.de", "1.2.3.4", "é", "_", "%", "😀"]
    for _ in range(5000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert pii.strict_spans(text) == brute_strict(text), text


def test_personal_data_query_against_brute_force(spark):
    found = {r["doc_id"]: r for r in op12_personal_data(spark, SMALL).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark).collect()}
    assert set(found) == set(texts)
    for i, text in texts.items():
        base = brute_strict(text)
        listed = [f"{k}:{s}:{e}" for k, s, e in base]
        assert [found[i][f"n_{k}"] for k in LOOSE] == [sum(b[0] == k for b in base) for k in LOOSE]
        assert found[i]["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(found[i]["spans"].split(",") if found[i]["spans"] else [])


def written(seed, n=3000):
    """Texts with personal data, and with numbers that are none."""
    draw, texts = random.Random(seed), []
    number = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    for _ in range(n):
        words = [draw.choice("the of a house green runs over and it was".split()) for _ in range(draw.randint(5, 30))]
        kind = draw.randrange(8)
        if kind == 0:
            thing = f"{draw.choice(['anna', 'ben'])}.{number(2)}@mail{number(1)}.example.com"
        elif kind == 1:
            thing = ".".join(str(draw.randrange(256)) for _ in range(4))
        elif kind == 2:
            body = number(15)
            thing = next(body + d for d in "0123456789" if pii._luhn(body + d))
        elif kind == 3:
            thing = f"+1 ({number(3)}) 555-{number(4)}"
        elif kind == 4:
            thing = f'token = "{hashlib.md5(number(9).encode()).hexdigest()}"'
        elif kind == 5:
            body = number(15)
            thing = next(body + d for d in "0123456789" if not pii._luhn(body + d))
        else:
            thing = f"in {number(4)}"
        words.insert(draw.randrange(len(words)), thing)
        texts.append(" ".join(words))
    return texts


@pytest.fixture(scope="module")
def trees(spark):
    return pii.fit(odd(spark, [(i, t, "s") for i, t in enumerate(written(1))]))


def test_trees_pick_rewritten_data_and_little_else(trees):
    right = wrong = missed = 0
    for k, text in enumerate(written(2, 1200)):
        strict = pii.strict_spans(text)
        for kind, s, e in strict:
            new = pii.rewritten(kind, text[s:e], k)
            changed = text[:s] + new + text[e:]
            (found,) = pii._picked([changed], trees)
            like = [(a, b) for kind_, a, b in found if kind_ in pii.LIKE]
            hit = any(a < s + len(new) and b > s for a, b in like) or any(a < s + len(new) and b > s for _, a, b in pii.strict_spans(changed))
            right, missed = right + hit, missed + (not hit)
        if not strict:
            wrong += sum(kind in pii.LIKE for kind, _, _ in pii._picked([text], trees)[0])
    assert right > 0.8 * (right + missed) and wrong <= 12, (right, missed, wrong)


def test_trees_calibrated(trees):
    rows = [e for t in written(3, 2000) for e in pii.examples(t)]
    y, p = np.array([r[0] for r in rows]), trees.probability(np.array([r[1] for r in rows], float))
    assert abs(p.mean() - y.mean()) < 0.05 and ((p - y) ** 2).mean() < 0.06
    assert (trees.thresholds >= 0.5).all()


def test_picks_leave_strict_matches_alone(trees):
    text = "a.b@c.de and 4111 1111 1111 1111 or 4111.1111.1111.1111 +1 (705) 555-1234"
    (found,) = pii._picked([text], trees)
    assert [f for f in found if f[0] in pii.BASE] == brute_strict(text)
    places = sorted((s, e) for _, s, e in found)
    assert all(a[1] <= b[0] for a, b in zip(places, places[1:], strict=False))
    assert found == sorted(found, key=lambda f: (pii.KINDS.index(f[0]), f[1]))


def test_tree_splits_where_the_labels_part():
    x = np.random.default_rng(0).random((4000, len(pii.FEATURES)))
    y = ((x[:, 3] > 0.5) ^ (x[:, 7] > 0.3)).astype(float)
    held = np.arange(4000) % 4 == 0
    assert ((pii.Trees(x, y, held).probability(x[held]) > 0.5) == y[held]).mean() > 0.95


def test_personal_data_odd_rows(spark, trees):
    found = pii.find_personal_data(odd(spark), trees)
    assert found.count() == len(ODD) and found.filter(F.size("found") > 0).count() == 0
    assert pii.find_personal_data(empty(spark), trees).count() == 0
    assert pii.fit(empty(spark)) is None and pii.fit(odd(spark)) is None
    assert pii.find_personal_data(odd(spark, [(1, "x a@b.c y", "s")]), None).first()["found"][0]["kind"] == "email"
    for text in ("1" * 10**6, "1 " * 10**5, "a" * 10**6 + "@", "+1" + "(" * 10**6, "1." * 10**5, "a@" * 10**5):
        assert len(pii._picked([text], trees)) == 1  # in time that follows the length


def test_redacted(spark):
    frame = spark.createDataFrame([("a x@y.de b 1.2.3.4 é",), ("",)], "text string")
    found = F.expr("array(named_struct('kind','ip','start',11L,'end',18L), named_struct('kind','email','start',2L,'end',8L), named_struct('kind','card','start',4L,'end',8L))")
    assert frame.select(pii.redacted(F.col("text"), found)).first()[0] == "a <email> b <ip> é"
    assert frame.select(pii.redacted(F.col("text"), F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint>>)"))).collect()[1][0] == ""


def test_inertia_counts():
    draw = np.random.default_rng(1)
    for trial in range(200):
        m = draw.standard_normal((12, 12))
        m = m + m.T
        if trial % 2:
            np.fill_diagonal(m, 0)
        values = np.linalg.eigvalsh(m)
        for shift in draw.uniform(-8, 8, 6):
            assert whitening.inertia(m, shift) == (values > shift).sum()


@pytest.mark.parametrize(
    "values",
    [[5] * 4 + [3] * 3 + [1] * 23, [1e9, 1e6, 1] + [0] * 27, [2] * 30, [1] * 5 + [0] * 25, [1 + 1e-12, 1] + [0.5] * 28, [0] * 30, list(range(30)), [7]],
)
def test_eigenpairs(values):
    size = len(values)
    q = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))[0]
    m = (q * np.array(values, float)) @ q.T
    m = (m + m.T) / 2
    found, vectors = whitening.leading_eigenpairs(m, 16)
    scale = max(values) or 1
    want = sorted((v for v in values if v > 1e-12 * scale), reverse=True)[:16]
    assert len(found) == len(want) and np.allclose(found, want, rtol=0, atol=1e-11 * scale)
    assert np.abs(vectors @ vectors.T - np.eye(len(found))).max(initial=0) < 1e-10
    assert np.abs(m @ vectors.T - vectors.T * found).max(initial=0) < 1e-11 * scale


def brute_whitened(rows, components):
    fit = np.array(sorted({tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for _, v in rows}))
    n, sums = len(fit), fit.sum(0)
    d = fit - sums / n
    cov = d.T @ d / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, v in rows:
        x = [math.floor(64 * float(c)) + 1_000_000 for c in v]
        out[i] = (sum((n * a - int(s)) ** 2 for a, s in zip(x, sums)), (np.array(x) - sums / n) @ vectors / np.sqrt(values))
    return n, values / cov.trace(), out


def test_whitening_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    n, explained, want = brute_whitened(rows, 16)
    found = op13_spectrum_whitening(spark, SMALL).toPandas().sort_values(["vec_id", "component"])
    assert len(found) == 16 * len(rows) and (found["n"] == n).all() and found["identity_error"].nunique() == 1
    assert found["identity_error"].max() < 1e-8
    white = found["whitened"].to_numpy().reshape(-1, 16)
    theirs = np.array([want[i][1] for i in found["vec_id"].unique()])
    theirs = theirs * np.sign((theirs * white).sum(0))  # either sign, one for all rows
    assert np.abs(white - theirs).max() < 1e-6
    assert found["deviation"].tolist() == [want[i][0] for i in found["vec_id"]]
    assert np.allclose(found["explained"].to_numpy()[:16], explained, rtol=1e-9)


def test_whitening_odd_rows(spark):
    nan, draw = float("nan"), np.random.default_rng(4)
    rows = [(i, [float(v) for v in draw.standard_normal(3)]) for i in range(40)]
    rows += [(90 + i, rows[0][1]) for i in range(200)]  # copies weigh once
    bad = [(None, None), (300, []), (301, [1.0, None, 2.0]), (302, [nan, 1.0, 1.0]), (303, [float("inf"), 0.0, 0.0]), (304, [1.0, 2.0])]
    frame = spark.createDataFrame(rows + bad + [(None, rows[1][1])], "vec_id long, embedding array<float>")
    frame = frame.withColumns({c: F.lit("clash") for c in ("x", "n", "size", "component", "whitened")})
    found = whitening.whitened(frame)
    n, _, want = brute_whitened([(i, [float(np.float32(c)) for c in v]) for i, v in rows], 3)
    assert found.filter("vec_id IS NULL").count() == 3 and found.count() == 3 * (len(rows) + 1)
    assert {(r["vec_id"], r["deviation"], r["n"]) for r in found.filter("vec_id IS NOT NULL").collect()} == {(i, want[i][0], n) for i, _ in rows}
    assert whitening.whitened(frame.limit(0)).count() == 0
    assert whitening.whitened(frame.filter("vec_id >= 90 AND vec_id < 300")).count() == 0
    huge = spark.createDataFrame([(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<float>")
    assert whitening.whitened(huge).filter("deviation IS NULL").count() > 0


def test_deviations_beyond_64_bits():
    x = np.array([[1_000_000, 3], [1_000_005, 9]], np.int64)
    sums = [2_000_005, 12]
    assert whitening.deviations(x, 2, sums) == [25 + 36, 25 + 36]
    assert whitening.deviations(np.array([[0]], np.int64), 1, [1 << 40]) == [None]
    assert pa.array(whitening.deviations(np.zeros((0, 2), np.int64), 1, [0, 0]), pa.int64()).to_pylist() == []


def test_secret_query_against_brute_force(spark):
    """Base columns of every document."""
    patterns = {
        "assign": (re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 6),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    }
    data = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in op7_secret_links(spark, data).collect()}
    total = 0
    for row in spark.read.parquet(f"{data}/documents.parquet").collect():
        base = [(k, *m.span()) for k, (p, fine) in patterns.items() for m in p.finditer(row["text"] or "") if fine(m)]
        listed = [f"{k}:{s}:{e}" for k, s, e in sorted(base, key=lambda b: (b[1], list(patterns).index(b[0])))]
        mine, total = found.pop(row["doc_id"]), total + len(base)
        assert [mine[f"n_{k}"] for k in patterns] == [sum(b[0] == k for b in base) for k in patterns]
        assert mine["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set((mine["spans"] or "").split(",")) or not listed
    assert not found and total > 0
