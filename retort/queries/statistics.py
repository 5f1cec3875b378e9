"""Distribution, length, token-array and rank-correlation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort import constants as K
from retort.functions.loops import trailing_loop
from retort.functions.text import words
from retort.operators import statistics as st
from retort.operators.records import message
from retort.plans import analysis
from retort.queries import duck, views
from retort.queries.answers import _rounded
from retort.queries.registry import query, table

# --- numeric carriers ---------------------------------------------------------------


@query(
    "SELECT l_returnflag, count(l_discount)::bigint AS n, round(avg(l_discount), 6) AS mean, round(stddev_pop(l_discount), 6) AS std_pop, min(l_discount) AS min, max(l_discount) AS max, "
    "count_if(l_discount = 0)::bigint AS n_zero, round(count_if(l_discount = 0) * 100::double / count(*), 6) AS zero_percent, round(quantile_cont(l_discount, 0.5), 6) AS median, "
    "round(quantile_cont(l_discount, 0.25), 6) AS p25, round(quantile_cont(l_discount, 0.75), 6) AS p75 FROM lineitem GROUP BY l_returnflag"
)
def score_distribution(spark, sf_dir):
    return _rounded(st.score_distribution(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_discount"))


@query(
    "SELECT round(avg(l_extendedprice), 4) AS avg, (list(l_extendedprice ORDER BY l_extendedprice))[count(*) // 2 + 1] AS median, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem"
)
def score_summary(spark, sf_dir):
    return st.score_summary(table(spark, sf_dir, "lineitem"), "l_extendedprice").withColumn("avg", F.round("avg", 4))


def _g(x: str, name: str) -> str:
    """Adjusted moments of ``x`` (DuckDB's skewness and kurtosis are the adjusted ones)."""
    return (
        f"round(avg({x}), 6) AS {name}_mean, round(coalesce(stddev_samp({x}), 0), 6) AS {name}_std, "
        f"round(coalesce(skewness({x}), 0), 6) AS {name}_skewness, round(coalesce(kurtosis({x}), 0), 6) AS {name}_kurtosis"
    )


@query(f"SELECT l_returnflag, count(*)::bigint AS n, {_g('l_extendedprice', 'price')} FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def moments_g1_g2(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").rollup("l_returnflag")
    return _rounded(rows.agg(F.count(F.lit(1)).alias("n"), *st.moments(F.col("l_extendedprice"), "price")))


_ERRORS = "e AS (SELECT l_shipmode, abs(l_extendedprice - l_quantity * 1000) AS d FROM (SELECT *, 'generation' || (l_linenumber % 3 + 1) AS l_shipmode FROM lineitem))"


def _predictions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("generation"), F.col("l_linenumber") % 3 + 1).alias("gen_key"),
        F.col("l_extendedprice").alias("predicted"),
        (F.col("l_quantity") * 1000).alias("truth"),
    )


@query(
    f"WITH {_ERRORS}, q AS (SELECT l_shipmode, quantile_cont(d, 0.25) AS q1, quantile_cont(d, 0.75) AS q3, count(*) AS n FROM e GROUP BY ALL), "
    "r AS (SELECT l_shipmode AS gen_key, n::bigint AS n, sqrt(avg(CASE WHEN d <= q3 + 1.5 * (q3 - q1) THEN d * d END)) AS rmse FROM e JOIN q USING (l_shipmode) GROUP BY ALL) "
    "SELECT gen_key, n, round(rmse, 4) AS rmse, round(avg(rmse) OVER (), 4) AS mean_rmse FROM r"
)
def iqr_rmse(spark, sf_dir):
    return _rounded(st.iqr_rmse(_predictions(spark, sf_dir), "gen_key", "predicted", "truth"), 4)


@query(
    f"WITH {_ERRORS}, q AS (SELECT quantile_cont(d, 0.25) AS q1, quantile_cont(d, 0.5) AS q2, quantile_cont(d, 0.75) AS q3 FROM e), b AS (SELECT *, q3 + 1.5 * (q3 - q1) AS bound FROM q) "
    "SELECT count(*)::bigint AS n, round(min(d), 4) AS min, round(max(d), 4) AS max, count_if(d > bound)::bigint AS n_beyond, round(any_value(q1), 4) AS q1, round(any_value(q2), 4) AS q2, round(any_value(q3), 4) AS q3, "
    "round(any_value(bound), 4) AS bound, round(100::double * count_if(d > bound) / count(*), 4) AS beyond_percent FROM e, b"
)
def error_summary(spark, sf_dir):
    return _rounded(st.error_summary(_predictions(spark, sf_dir), "predicted", "truth"), 4)


@query("SELECT round(avg(l_quantity), 6) AS mean_quantity FROM lineitem")
def weighted_mean(spark, sf_dir):
    """Mean over rows out of group means and sizes."""
    means = table(spark, sf_dir, "lineitem").groupBy("l_shipdate").agg(F.avg("l_quantity").alias("m"), F.count(F.lit(1)).alias("n"))
    return _rounded(st.weighted_mean(means, "m", "n", "mean_quantity"))


@query(
    "WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) "
    "SELECT least(floor((l_extendedprice - lo) * 50 / (hi - lo)), 49)::int AS bin, count(*)::bigint AS n FROM lineitem, e GROUP BY ALL"
)
def equal_histogram(spark, sf_dir):
    return st.equal_histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 50)


@query(
    "WITH s AS (SELECT count(*) AS n, stddev_samp(l_discount) * pow(count(*), -0.2) AS h FROM lineitem), "
    "c AS (SELECT l_discount AS v, count(*) AS k FROM lineitem GROUP BY ALL), p AS (SELECT unnest(range(200)) AS point) "
    "SELECT point::int AS point, round(point / 199.0::double, 6) AS x, round(sum(k * exp(-0.5 * pow((point / 199.0::double - v) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density FROM p, c, s GROUP BY point"
)
def score_density(spark, sf_dir):
    return _rounded(st.gaussian_density(table(spark, sf_dir, "lineitem"), "l_discount"))


@query(
    "WITH r AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0::double AS rx, "
    "rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0::double AS ry FROM orders), "
    "c AS (SELECT corr(rx, ry) AS rho, count(*) AS n, (count(*) - 2)::double AS f FROM r), "
    # Simpson's rule for the density of Student's t from 0 to t
    "t AS (SELECT *, abs(rho) * sqrt(f / (1 - rho * rho)) AS t, exp(lgamma((f + 1) / 2) - lgamma(f / 2)) / sqrt(f * pi()) AS k FROM c), "
    "s AS (SELECT sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * k * pow(1 + pow(i * t / 2000.0::double, 2) / f, -(f + 1) / 2) * t / 6000.0::double) AS area FROM t, range(2001) x(i)) "
    "SELECT round(rho, 6) AS rho, n::bigint AS n, round(1 - 2 * area, 6) AS p FROM t, s"
)
def spearman_rank(spark, sf_dir):
    return _rounded(st.spearman(table(spark, sf_dir, "orders"), "o_totalprice", "o_custkey"))


_SCORES = "(SELECT CASE doc_id % 4 WHEN 0 THEN ' ' || lang || ' ' ELSE lang END AS k, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'n/a' ELSE (n_chars % 100 + 0.5)::varchar END AS v FROM documents)"


@query(
    f"SELECT count(try_cast(v AS double))::bigint AS n_scores, round(avg(try_cast(v AS double)), 6) AS mean_score, count_if(try_cast(v AS double) IS NULL)::bigint AS n_skipped, "
    f"(SELECT string_agg(w, ',' ORDER BY w) FROM (SELECT unnest([{', '.join(duck.lit(w) for w in K.REPORT_LANGS)}]) AS w) WHERE w NOT IN (SELECT trim(k) FROM {_SCORES})) AS missing "
    f"FROM {_SCORES} WHERE trim(k) IN {duck.words_in(K.REPORT_LANGS)}"
)
def subset_mean_score(spark, sf_dir):
    i = F.col("doc_id")
    scores = table(spark, sf_dir, "documents").select(
        F.when(i % 4 == 0, F.concat(F.lit(" "), "lang", F.lit(" "))).otherwise(F.col("lang")).alias("lang"),
        F.when(i % 5 == 0, "").when(i % 5 == 1, "n/a").otherwise((F.col("n_chars") % 100 + 0.5).cast("string")).alias("score"),
    )
    return _rounded(st.subset_mean(scores, K.REPORT_LANGS, "lang", "score"))


@query("SELECT l_linestatus, count(*)::bigint AS n_samples, round(avg(l_tax), 6) AS mean_kl FROM lineitem GROUP BY ROLLUP (l_linestatus)")
def divergence_means(spark, sf_dir):
    """The per-sample divergence comes from models outside; ``l_tax`` stands in for it."""
    return _rounded(analysis.divergence_means(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_tax"))


@query("SELECT vec_id, (len(list_filter(embedding, lambda p: p > embedding[1])) + 1)::int AS target_rank FROM embeddings")
def target_ranks(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", analysis.target_rank(F.col("embedding"), F.get("embedding", F.lit(0))).alias("target_rank"))


# --- lengths ------------------------------------------------------------------------


def _lengths(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn(
        "messages", F.array(message("user", F.col("source")), message("assistant", F.col("text")))
    )
    return analysis.assistant_lengths(docs, "messages", "lang", "doc_id")


_LEN = f"w AS (SELECT lang, doc_id, text, {duck.word_count('text')} AS n_words FROM documents)"


@query(
    f"WITH {_LEN} SELECT lang, count(*)::bigint AS n, sum(n_words)::bigint AS total, round(avg(n_words), 6) AS mean, round(coalesce(stddev_samp(n_words), 0), 6) AS std_samp, round(quantile_cont(n_words, 0.5), 6) AS median, "
    "min(n_words)::int AS min, max(n_words)::int AS max, count_if(n_words > 400)::bigint AS n_over, round(100::double * count_if(n_words > 400) / count(*), 6) AS over_percent FROM w GROUP BY GROUPING SETS ((lang), ())"
)
def length_report(spark, sf_dir):
    return _rounded(analysis.length_report(_lengths(spark, sf_dir), "lang", 400))


@query(
    f"WITH {_LEN} SELECT lang, doc_id, n_words::int AS n_words, md5(text[1:2000]) AS preview_md5, length(text)::int AS n_chars FROM w WHERE n_words > 400 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) = 1"
)
def overlong_examples(spark, sf_dir):
    first = analysis.overlong_examples(_lengths(spark, sf_dir), "lang", "doc_id", 400)
    return first.select("lang", "doc_id", "n_words", F.md5("preview").alias("preview_md5"), "n_chars")


@query(f"WITH {_LEN} SELECT lang, (n_words // 100 * 100)::bigint AS bin_start, count(*)::bigint AS n FROM w GROUP BY ALL")
def length_histogram(spark, sf_dir):
    return st.width_histogram(_lengths(spark, sf_dir), ["lang"], "n_words", 100)


@query(
    f"WITH l AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN list_concat({duck.words('text')}, ['a', 'b', 'c', 'a', 'b', 'c', 'a', 'b', 'c']) ELSE {duck.words('text')} END AS w FROM documents) "
    "SELECT doc_id, len(list_filter(range(2, least(50, len(w) // 3) + 1), lambda p: w[len(w) - 3 * p + 1:len(w) - p] = w[len(w) - 2 * p + 1:len(w)])) > 0 AS looped FROM l"
)
def loop_detect(spark, sf_dir):
    tail = F.array(*[F.lit(t) for t in "abcabcabc"])
    tokens = F.when(F.col("doc_id") % 3 == 0, F.concat(words(F.col("text")), tail)).otherwise(words(F.col("text")))
    docs = table(spark, sf_dir, "documents").withColumn("tokens", tokens)
    return docs.select("doc_id", trailing_loop(F.col("tokens"), 2, 50, 3).alias("looped"))


# --- token arrays -------------------------------------------------------------------


def _token_means_sql() -> str:
    mean = "list_avg({})"
    rest = "CASE WHEN strs[1:4] = ['<think>', chr(10) || chr(10), '</think>', chr(10) || chr(10)] AND len(strs) > 4 THEN list_avg({0}[5:]) ELSE list_avg({0}) END"
    hits = "list_transform(ranks, lambda r: (r = 1)::int::double)"
    cols = {"avg_prob": "probs", "avg_rank": "ranks", "avg_top1_hit_rate": hits}
    picks = ", ".join(
        f"round({mean.format(a)}, 6) AS {n}, round({rest.format('(' + a + ')')}, 6) AS {n}_excl" for n, a in cols.items()
    )
    return f"WITH {views.tokens_sql()} SELECT sample_id, len(probs)::int AS n_tokens, {picks} FROM t"


_MEANS = ["avg_prob", "avg_rank", "avg_top1_hit_rate"]


@query(_token_means_sql())
def token_means(spark, sf_dir):
    means = analysis.token_means(views.token_records(spark, sf_dir))
    return _rounded(means.select("sample_id", "n_tokens", *_MEANS, *[f"{m}_excl" for m in _MEANS]))


_SAMPLE = (
    "sm AS (SELECT sample_id, doc_id, task, text, strs, ranks, probs, list_avg(probs) AS avg_prob, list_avg(ranks) AS avg_rank, list_avg(list_transform(ranks, lambda r: (r = 1)::int::double)) AS avg_top1_hit_rate FROM t)"
)


@query(f"WITH {views.tokens_sql()}, {_SAMPLE} SELECT task, count(*)::bigint AS n_samples, {', '.join(_g(m, m) for m in _MEANS)} FROM sm GROUP BY ROLLUP (task)")
def token_task_moments(spark, sf_dir):
    samples = analysis.token_means(views.token_records(spark, sf_dir)).select("task", *_MEANS)
    return _rounded(analysis.task_moments(samples))


_FLAT = "x AS (SELECT task, unnest(ranks) AS rank, unnest(probs) AS prob FROM t)"


@query(
    f"WITH {views.tokens_sql()}, {_FLAT} SELECT task, count(*)::bigint AS n, round(avg(rank), 6) AS mean_rank, round(avg(prob), 6) AS mean_prob, "
    + ", ".join(f"round(avg((rank <= {k})::int), 6) AS cdf_{k}" for k in K.RANK_THRESHOLDS)
    + ", round(quantile_cont(rank, 0.5), 6) AS median_rank, round(quantile_cont(rank, 0.9), 6) AS p90_rank, round(quantile_cont(rank, 0.99), 6) AS p99_rank FROM x GROUP BY task"
)
def percentile_cdf(spark, sf_dir):
    tokens = analysis.exploded_tokens(views.token_records(spark, sf_dir), "task")
    return _rounded(st.rank_statistics(tokens, ["task"]))


@query(
    f"WITH {views.tokens_sql('m2')}, {_FLAT}, b AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, {duck.lit(lab)}, {lo}, {hi})" for i, (lo, hi, lab) in enumerate(zip(K.RANK_BIN_EDGES, K.RANK_BIN_EDGES[1:], K.RANK_BIN_LABELS)))
    + ") v(bin, label, lo, hi)) SELECT task, any_value(total)::bigint AS total, bin::int AS bin, label, count_if(rank >= lo AND rank < hi)::bigint AS n, round(count_if(rank >= lo AND rank < hi) / any_value(total), 6) AS fraction "
    "FROM (SELECT *, count(*) OVER (PARTITION BY task) AS total FROM x), b GROUP BY ALL"
)
def rank_histogram(spark, sf_dir):
    tokens = analysis.exploded_tokens(views.token_records(spark, sf_dir, "m2"), "task")
    return _rounded(st.rank_histogram(tokens, ["task"]))


@query(
    f"WITH {views.tokens_sql('m2')}, {_FLAT}, c AS (SELECT rank, count(*) AS k FROM x GROUP BY rank), q AS (SELECT greatest(floor(quantile_cont(rank, 0.995)), 100) + 1 AS top, count(*) AS total FROM x), "
    "g AS (SELECT point, pow(top::double, point / 499.0::double) AS rank_at, total FROM q, (SELECT unnest(range(500)) AS point)) "
    "SELECT point::int AS point, round(rank_at, 6) AS rank_at, round(coalesce(sum(k) FILTER (rank <= rank_at * (1 + 1e-9)), 0) / any_value(total), 6) AS cdf FROM g, c GROUP BY point, rank_at"
)
def rank_cdf_curve(spark, sf_dir):
    tokens = analysis.exploded_tokens(views.token_records(spark, sf_dir, "m2"), "task")
    return _rounded(st.rank_cdf_curve(tokens, []))


@query(
    f"WITH {views.tokens_sql('m1', 't')}, {views.tokens_sql('m2', 'u')}, "
    "x AS (SELECT 'm1' AS model, unnest(ranks) AS rank FROM t UNION ALL SELECT 'm2', unnest(ranks) FROM u), "
    "c AS (SELECT model, rank, count(*) AS k FROM x GROUP BY model, rank), n AS (SELECT model, count(*) AS total FROM x GROUP BY model), "
    "q AS (SELECT max(top) AS top FROM (SELECT greatest(floor(quantile_cont(rank, 0.995)), 100) + 1 AS top FROM x GROUP BY model)), "
    "g AS (SELECT model, total, point, pow(top::double, point / 499.0::double) AS rank_at FROM n, q, (SELECT unnest(range(500)) AS point)) "
    "SELECT g.model, point::int AS point, round(rank_at, 6) AS rank_at, round(coalesce(sum(k) FILTER (rank <= rank_at * (1 + 1e-9)), 0) / any_value(total), 6) AS cdf FROM g JOIN c ON c.model = g.model GROUP BY g.model, point, rank_at"
)
def rank_cdf_two_models(spark, sf_dir):
    """Both models' curves over one grid."""
    both = [
        analysis.exploded_tokens(views.token_records(spark, sf_dir, m), "task").select(F.lit(m).alias("model"), "rank") for m in ("m1", "m2")
    ]
    return _rounded(st.rank_cdf_curve(both[0].unionByName(both[1]), ["model"], common=True))


_TWO = (
    f"WITH {views.tokens_sql('m1', 't')}, {_SAMPLE}, {views.tokens_sql('m2', 'u')}, "
    + _SAMPLE.replace("sm AS", "sn AS").replace("FROM t)", "FROM u)")
)


def _two_models(spark, sf_dir) -> list[DataFrame]:
    keep = ["sample_id", "doc_id", "task", "text", *_MEANS, "token_strs", "token_ranks", "token_probs"]
    return [analysis.token_means(views.token_records(spark, sf_dir, m)).select(*keep) for m in ("m1", "m2")]


@query(
    _TWO
    + ", a AS (SELECT task, avg(avg_prob) AS p, avg(avg_rank) AS r, count(*) AS n FROM sm GROUP BY task), b AS (SELECT task, avg(avg_prob) AS p, avg(avg_rank) AS r, count(*) AS n FROM sn WHERE task <> 'src3' GROUP BY task) "
    "SELECT task, round(a.p, 6) AS avg_prob_m1, round(a.r, 6) AS avg_rank_m1, a.n::bigint AS n_m1, round(b.p, 6) AS avg_prob_m2, round(b.r, 6) AS avg_rank_m2, b.n::bigint AS n_m2 FROM a JOIN b USING (task)"
)
def task_comparison(spark, sf_dir):
    first, second = _two_models(spark, sf_dir)
    # the second model never saw one source: tasks of both only are the feature
    return _rounded(analysis.task_comparison(first, second.filter(F.col("task") != "src3")))


@query(
    _TWO
    + ", p AS (SELECT sm.sample_id, sm.doc_id, sm.task, md5(sm.text) AS output_md5, sn.avg_rank / sm.avg_rank AS rank_ratio, sn.avg_prob - sm.avg_prob AS prob_diff, sn.strs AS s2, sn.ranks AS r2 "
    "FROM sm JOIN sn USING (sample_id) WHERE sm.avg_rank >= 1e-6), "
    "k AS (SELECT * FROM p WHERE prob_diff > 0 AND rank_ratio > 2 ORDER BY rank_ratio DESC, doc_id LIMIT 20) "
    "SELECT sample_id, task, output_md5, round(rank_ratio, 6) AS rank_ratio, round(prob_diff, 6) AS prob_diff, "
    "array_to_string(list_transform(list_sort(list_filter(list_transform(r2, lambda r, i: {'o': -r, 'i': i, 's': s2[i] || ':' || r}), lambda z: z.o < -50))[1:8], lambda z: z.s), ' ') AS worst FROM k"
)
def paradox_examples(spark, sf_dir):
    found = analysis.paradox_examples(*_two_models(spark, sf_dir), "doc_id")
    worst = analysis.high_rank_tokens(F.col("token_strs_2"), F.col("token_ranks_2"), F.col("token_probs_2"))
    shown = F.array_join(F.transform(worst, lambda t: F.concat(t["token"], F.lit(":"), t["rank"].cast("string"))), " ")
    return _rounded(
        found.select("sample_id", "task", F.md5("text").alias("output_md5"), "rank_ratio", "prob_diff", shown.alias("worst"))
    )
