"""The registered queries of this subpackage, each beside its SQL where there is one (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retort.llm import (
    bpe, exact, importance, mixing, mtree, ngram_join, pii, quotes, secret_links, substring, toxicity, wavelet, whitening,
)
from retort.queries.registry import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


@_query(
    r"""
WITH w AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size,
        md5('mix-1:' || coalesce(doc_id::varchar, 'null')) AS key FROM documents),
s AS (SELECT source, sum(size)::double AS ss, 3.0::double * sum(size)::double AS cap,
        row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank FROM w GROUP BY source),
r AS (SELECT *, [5.0::double, 2.0::double, 1.0::double][(rank % 3 + 1)::int] AS weight FROM s),
l AS (SELECT *, ((SELECT sum(ss) FROM r) - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT *, first(CASE WHEN cap / weight > level THEN level END IGNORE NULLS)
        OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM l),
t AS (SELECT source, ss, CASE WHEN open IS NULL THEN cap ELSE open * weight END AS target FROM f),
u AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END AS whole FROM t),
k AS (SELECT source, key, sum(size) AS size FROM w GROUP BY source, key),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key) AS upto FROM k),
x AS (SELECT c.source, min_by(key, key) AS ckey, min_by((target - whole * ss - (upto - size)) / size, key) AS cpart
        FROM c JOIN u ON c.source IS NOT DISTINCT FROM u.source WHERE upto > target - whole * ss GROUP BY c.source)
SELECT w.doc_id, w.size, u.ss::bigint AS source_size, u.target,
    (u.whole * w.size + floor(CASE WHEN w.size = 0 OR x.ckey IS NULL OR w.key > x.ckey THEN 0 WHEN w.key < x.ckey THEN 1 ELSE x.cpart END * w.size))::bigint AS taken
FROM w JOIN u ON w.source IS NOT DISTINCT FROM u.source LEFT JOIN x ON w.source IS NOT DISTINCT FROM x.source
"""
)
def op3_source_mixture(spark, sf_dir):
    """All documents mixed to the weights 5, 2, 1 with at most three epochs of a source."""
    mixed = mixing.mixture(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@_query(
    r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
    row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM n
"""
)
def op9_exact_dedup(spark, sf_dir):
    """Groups of equal documents by content sort."""
    return exact.exact_groups(table(spark, sf_dir, "documents"))


@_query()
def op4_wavelet_shards(spark, sf_dir):
    """Token ids of all documents written to wavelet-matrix shards, and read back from them."""
    shards = wavelet.write_shards(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), wavelet.new_path(spark, "op4-shards"), end_id=2
    )
    return wavelet.read_documents(shards)


@_query()
def op6_bpe_round_trip(spark, sf_dir):
    """Token ids of all documents by the merge transducer, and the texts that they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@_query(
    r"""
WITH w AS (SELECT rowid AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
s AS (SELECT r, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
h AS (SELECT s.r, s.i, md5(array_to_string(ws[s.i:s.i + 34], ' ')) AS k FROM s JOIN w USING (r)),
d AS (SELECT r, i FROM h WHERE k IN (SELECT k FROM h GROUP BY k HAVING count(*) > 1)),
g AS (SELECT DISTINCT r, i + j AS i FROM d, range(0, 35) t(j)),
p AS (SELECT r, doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT p.r, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN p.ws[p.i] END, ' ' ORDER BY p.i) AS kept
        FROM p LEFT JOIN g USING (r, i) GROUP BY p.r)
SELECT doc_id, len(ws)::bigint AS n_words, coalesce(n_removed, 0)::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (r)
"""
)
def op5_passage_removal(spark, sf_dir):
    """All documents without the words of 35-word windows that occur more than once."""
    return substring.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


@_query(
    r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT r, md5(array_to_string(ws[i:i + 4], ' ')) AS k
        FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM g a JOIN g b ON a.k = b.k AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT a, b FROM p JOIN n x ON x.r = p.a JOIN n y ON y.r = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT r AS a, r AS b FROM w UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT w.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (r) JOIN (SELECT a AS r, min(x.doc_id) AS component_id FROM reach JOIN w x ON x.r = reach.b GROUP BY a) c USING (r)
"""
)
def op2_ngram_jaccard(spark, sf_dir):
    """Components of all documents under 80 % of equal five-word shingles."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).drop("set_id")


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


@_query()
def op1_toxicity(spark, sf_dir):
    """All documents scored by a network trained on the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    weights = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", lambda doc_id: ~_held_out(doc_id))
    scored = toxicity.score_documents(docs, weights)
    return scored.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@_query(
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::double * x::double)::bigint) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
)
def op8_mtree_top_k(spark, sf_dir):
    """The five rows of highest integer inner product for every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", mtree.scaled(F.col("embedding")).alias("vector"))
    return mtree.top_k(vectors, F.col("vec_id") % 50 == 0, 5, vector_col="vector").withColumnRenamed("id", "vec_id")


@_query()
def op7_secret_links(spark, sf_dir):
    """Secrets of all documents, with the weak candidates that other parts support."""
    rows = secret_links.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"].isin(*secret_links.BASE))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id",
        *[count(kind) for kind in secret_links.BASE],
        F.sha2(secret_links.listed(base), 256).alias("base_sha256"),
        secret_links.listed(F.col("found")).alias("spans"),
    )


@_query(
    r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text,
        trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM conversations),
q AS (SELECT *, lag(norm) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lag(norm, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS earlier FROM m),
f AS (SELECT conv_id, norm, min(turn) AS first FROM m WHERE norm <> '' GROUP BY conv_id, norm),
p AS (SELECT q.*, coalesce(a.first, b.first) AS parent_id FROM q
        LEFT JOIN f a ON a.conv_id = q.conv_id AND a.norm = q.before AND a.first < q.turn
        LEFT JOIN f b ON b.conv_id = q.conv_id AND b.norm = q.earlier AND b.first < q.turn),
t AS (SELECT conv_id, turn, turn AS root_id, 0 AS depth FROM p WHERE parent_id IS NULL
        UNION ALL SELECT p.conv_id, p.turn, t.root_id, t.depth + 1 FROM p JOIN t ON p.conv_id = t.conv_id AND p.parent_id = t.turn)
SELECT p.conv_id, p.turn, p.role, p.parent_id, t.root_id, t.depth::bigint AS depth, md5(p.text) AS text_md5
FROM p JOIN t ON t.conv_id = p.conv_id AND t.turn = p.turn
"""
)
def op10_quote_threads(spark, sf_dir):
    """All turns as replies that quote the two turns before, and the conversations found from the quotes.

    The table has no quotes of its own: Spark writes them, and the operator sees only the texts.
    """
    turns = table(spark, sf_dir, "conversations")
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    before, earlier = F.lag("text").over(by_turn), F.lag("text", 2).over(by_turn)
    mail = F.concat_ws("\n", quotes.quote(quotes.quote(earlier)), quotes.quote(before), F.coalesce("text", F.lit("")))
    found = quotes.threads(turns.withColumn("text", mail))
    return found.select(
        F.col("scope").alias("conv_id"), F.col("id").alias("turn"), "role", "parent_id", "root_id", "depth", F.md5("text").alias("text_md5")
    )


@_query(
    r"""
WITH RECURSIVE bits AS (SELECT n::bigint AS n, n::bigint AS c, 0 AS step FROM range(256) t(n)
        UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::bigint) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
tab AS (SELECT list(c ORDER BY n) AS tab FROM bits WHERE step = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT r, unnest(ws) AS w FROM d),
bw AS (SELECT unnest(ws) AS w FROM b),
v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM dw UNION SELECT DISTINCT w FROM bw)),
crc AS (SELECT w, (xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::bigint)),
        lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295::bigint) % 10000) AS bucket FROM v, tab),
s AS (SELECT bucket, count(*)::double AS s FROM dw JOIN crc USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*)::double AS t FROM bw JOIN crc USING (w) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)) / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000))))::bigint AS gain
        FROM (SELECT range AS bucket FROM range(10000)) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT r, sum(gain) AS weight FROM dw JOIN crc USING (w) JOIN g USING (bucket) GROUP BY r),
c AS (SELECT d.r, doc_id, len(ws)::bigint AS n_features, coalesce(weight, 0)::bigint AS weight,
        (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint + 0.5::double) / 4294967296))))::bigint AS score
        FROM d LEFT JOIN w ON w.r = d.r),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM c WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM k) * 10 // 100 THEN rank END AS rank FROM c LEFT JOIN k USING (r)
"""
)
def op11_importance_resampling(spark, sf_dir):
    """A tenth of the documents drawn towards the distribution of the benchmark texts."""
    found = importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@_query()
def op12_personal_data(spark, sf_dir):
    """Personal data of all documents: strict matches, and what the boosted trees pick beyond them."""
    docs = table(spark, sf_dir, "documents")
    rows = pii.find_personal_data(docs, pii.fit(docs))
    base = F.filter("found", lambda s: s["kind"].isin(*pii.BASE))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id",
        *[count(kind) for kind in pii.BASE],
        F.sha2(secret_links.listed(base), 256).alias("base_sha256"),
        secret_links.listed(F.col("found")).alias("spans"),
    )


@_query()
def op13_spectrum_whitening(spark, sf_dir):
    """All embeddings on the first 16 principal components of the distinct ones, at unit variance."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))
