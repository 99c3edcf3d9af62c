"""Queries of replays as of the day, of the gated era fit and of distributed fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.plans import era, fits, ranking, replay, studies
from quillrank.queries.registry import CANDIDATES, READS, candidates, query, reads, rounded
from quillrank.session import table

_DENSE = f"WITH {READS}, sims AS (SELECT t.id, r.id AS read_id, r.rating, r.day, list_cosine_similarity(t.vec, r.vec) AS sim FROM reads t JOIN reads r ON r.day < t.day),"
_SPARSE = """WITH reads AS (SELECT p_partkey AS id, p_brand AS author, CAST(1 + p_size % 5 AS DOUBLE) AS rating, DATE '2020-01-01' + CAST(p_partkey % 365 AS INT) AS day, p_name FROM part),
    k AS (SELECT id, list_filter(string_split(regexp_replace(lower(p_name), '[^\\pL\\pN_]+', ' ', 'g'), ' '), lambda x: len(x) >= 2) AS ws FROM reads),
    g AS (SELECT id, unnest(list_concat(list_transform(ws, lambda x: 'w:' || x), list_transform(range(1, len(ws)), lambda i: 'w:' || ws[i] || ' ' || ws[i + 1]), flatten(list_transform(ws, lambda x: flatten(list_transform([3, 4, 5], lambda n: list_transform(generate_series(1, greatest(len(x) + 3 - n, 1)), lambda i: 'c:' || substr(' ' || x || ' ', i, n)))))))) AS term FROM k),
    c AS (SELECT id, term, count(*) AS tf FROM g GROUP BY 1, 2), d AS (SELECT term, ln((1 + (SELECT count(*) FROM part WHERE p_partkey % 4 = 0)) / (1 + count(*))) + 1 AS idf FROM c WHERE id % 4 = 0 GROUP BY 1),
    y AS (SELECT id, term, tf * idf AS v FROM c JOIN d USING (term)), u AS (SELECT id, term, v / sqrt(sum(v * v) OVER (PARTITION BY id, term[1])) AS v FROM y), q AS (SELECT id, term, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM u),
    p AS (SELECT a.id, b.id AS read_id, sum(a.v * b.v) AS sim FROM q a JOIN q b USING (term) GROUP BY 1, 2),
    sims AS (SELECT t.id, r.id AS read_id, r.rating, r.day, round(coalesce(sim, 0), 12) AS sim FROM reads t JOIN reads r ON r.day < t.day LEFT JOIN p ON p.id = t.id AND p.read_id = r.id),"""
_REPLAY = """
    n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, read_id) AS n, row_number() OVER (PARTITION BY id, rating >= 4 ORDER BY sim DESC, read_id) AS m, row_number() OVER (PARTITION BY id, rating <= 2 ORDER BY sim DESC, read_id) AS b FROM sims),
    w AS (SELECT *, greatest(sim, 0) + 1e-4 AS tw, CASE WHEN n <= 40 THEN pow(greatest(sim, 0) + 1e-8, 8) END AS w, CASE WHEN n <= 40 THEN (max(CASE WHEN n <= 40 THEN day END) OVER (PARTITION BY id) - day) / 365.25 END AS age FROM n),
    t AS (SELECT id, sum(tw * sim) FILTER (rating >= 4 AND m <= 5) / sum(tw) FILTER (rating >= 4 AND m <= 5) AS up, max(sim) FILTER (rating >= 4) AS up_max, max(sim) FILTER (rating <= 2) AS down,
        sum(tw * sim) FILTER (rating <= 2 AND b <= 5) / sum(tw) FILTER (rating <= 2 AND b <= 5) AS neg_top, sum(tw * rating) FILTER (n <= 5) / sum(tw) FILTER (n <= 5) AS local, sum(w * rating) / sum(w) AS kernel,
        sum(w * exp(-age / 8) * rating) / sum(w * exp(-age / 8)) AS recent, pow(sum(w), 2) / sum(w * w) AS ess, max(sim) AS best FROM w GROUP BY id),
    h AS (SELECT t.id, count(r.id) AS hn, coalesce(avg(r.rating), 3) AS mean, median(r.rating) AS med, count(*) FILTER (r.author = t.author) AS an, coalesce(sum(r.rating) FILTER (r.author = t.author), 0) AS s, count(*) FILTER (r.author = t.author AND r.rating >= 4) AS liked
        FROM reads t LEFT JOIN reads r ON r.day < t.day GROUP BY t.id),
    f AS (SELECT c.id, c.day, c.rating, hn, mean, med, liked, coalesce(up, 0.25) AS pos_top, coalesce(up_max, 0.25) AS pos_max, coalesce(down, 0) AS neg_max, coalesce(neg_top, 0) AS neg_top, CASE WHEN best > 0 THEN local - 3 ELSE 0 END AS local_shift,
        CASE WHEN best > 0 THEN kernel - mean ELSE 0 END AS kernel_shift, CASE WHEN best > 0 THEN recent - kernel ELSE 0 END AS recent_shift, CASE WHEN an > 0 THEN (s + 5 * mean) / (an + 5) - mean ELSE 0 END AS author_shift, CASE WHEN best > 0 THEN ess ELSE 0 END AS ess
        FROM reads c LEFT JOIN t ON t.id = c.id JOIN h ON h.id = c.id),
    x AS (SELECT *, least(100, greatest(0, 42 + 48 * pos_top - 24 * neg_max + 3.5 * local_shift + 3.5 * author_shift + 10 * least(1, hn / 100.0) * kernel_shift * ess / (ess + 5) + 20 * least(1, hn / 100.0) * recent_shift)) AS raw,
        least(100, greatest(0, 42 + 48 * pos_max - 24 * neg_max + CASE WHEN liked > 0 THEN 7 ELSE 0 END)) AS old FROM f)"""
_FEATURES = ", ".join(f"CASE WHEN hn >= 100 THEN round({c}, 6) END AS {c}" for c in replay.FEATURES[:8])


_SCORED = f"""{_REPLAY} SELECT id, CAST(day AS VARCHAR) AS day, rating, hn AS history, CASE WHEN hn >= 100 THEN round(raw, 6) END AS raw_score, CASE WHEN hn >= 100 THEN round(round(raw, 6), 1) END AS score, CASE WHEN hn >= 100 THEN round(old, 6) END AS earlier,
    CASE WHEN hn >= 100 THEN round(mean, 6) END AS prior_mean, CASE WHEN hn >= 100 THEN med END AS prior_median, {_FEATURES}, CASE WHEN hn >= 100 THEN round(mean - 3, 6) END AS mean_shift, CASE WHEN hn >= 100 THEN round(ln(1 + hn), 6) END AS log_count FROM x"""


@query(_DENSE + _SCORED)
def historical_replay(spark, sf):
    """Every read's score and features by the reads of strictly earlier days."""
    return rounded(replay.replay(reads(spark, sf)).withColumn("day", F.col("day").cast("string")))


@query(_SPARSE + _SCORED)
def sparse_replay(spark, sf):
    """The same scores and features from TF-IDF cosines of names, weights fitted on a quarter of them."""
    p = table(spark, sf, "part").withColumn("id", F.col("p_partkey"))
    weights = studies.tfidf(p, "id", "p_name", F.col("id") % 4 == 0).groupBy("id").agg(F.collect_list(F.struct(F.xxhash64("term").alias("term"), "weight")).alias("v"))
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 365).cast("int"))
    rows = p.join(weights, "id").select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("identity"), F.col("p_brand").alias("author"), (1 + F.col("p_size") % 5).cast("double").alias("rating"), day.alias("day"), F.col("v.term").alias("terms"), F.col("v.weight").alias("weights"))
    return rounded(replay.replay(rows).withColumn("day", F.col("day").cast("string")))


def _left_out(history, queries):
    """The library's scorer as a callback: each query without its own identity."""
    own = queries.withColumns({"source_weight": F.lit(1.0), "confidence": F.lit(1.0)})
    return ranking.score_candidates(history, own, leave_one_out=True)


@query()
def era_fit(spark, sf):
    """The gated era correction over all reads; scores come from the whole history before each block."""
    rows = reads(spark, sf).withColumn("year", (F.lit(1930) + F.col("id") % 90).cast("int"))
    return rounded(era.fit_era(rows, _left_out).rows(spark))


def _rated(spark, sf):
    """Reads in four parts of whole days, eight features and a score that knows a little."""
    r = reads(spark, sf).select("id", "day", F.col("rating").alias("y"), F.slice("vec", 1, 8).alias("x"), F.round(50 + 40 * F.col("vec")[8].cast("double") + 2 * F.col("rating"), 1).alias("current"))
    return fits.prepared(fits.time_folds(r, "day", 3))


@query()
def ordinal_fit(spark, sf):
    """Proportional odds of all ratings, gradients summed over tasks."""
    m = fits.ordinal(_rated(spark, sf))[0]
    return spark.createDataFrame([("all", m.beta.tolist(), m.thresholds.tolist(), m.fit.n)], "reader string, weights array<double>, cuts array<double>, n long")


@query()
def pairwise_fit(spark, sf):
    """The pairwise ranker for each penalty, without pairs."""
    shape = "c double, weights array<double>, pairs double, loss double, cap double"
    return spark.createDataFrame([(m.fit.c, m.beta.tolist(), m.pairs, m.loss, m.cap) for m in fits.pairwise(_rated(spark, sf))], shape)


@query()
def tail_head_scores(spark, sf):
    """Every read's served score by heads fitted on the first three parts of the days."""
    data = _rated(spark, sf)
    return fits.scored(data.rows, fits.tail_heads(data, (1.0,), (3,))).drop("fit")


@query()
def pairwise_selection(spark, sf):
    """The pairwise penalty chosen on three forward folds, all fits in the same jobs."""
    return rounded(fits.out_of_fold(_rated(spark, sf), fits.pairwise, folds=(1, 2, 3))[1])


@query()
def tail_head_selection(spark, sf):
    return rounded(fits.out_of_fold(_rated(spark, sf), fits.tail_heads, folds=(1, 2, 3))[1])


@query(f"""WITH {READS}, {CANDIDATES}, u AS (SELECT vec_id AS candidate, CASE WHEN vec_id % 9 = 1 THEN concat('r', vec_id - 1) ELSE concat('c', vec_id) END AS identity, CASE vec_id % 4 WHEN 1 THEN 'reject' ELSE 'save' END AS action, DATE '2020-01-01' + CAST((vec_id * 7) % 400 AS INT) AS day FROM embeddings WHERE vec_id % 2 = 1 AND vec_id % 5 <> 0),
    w AS (SELECT candidate AS id, u.identity, CAST(action = 'save' AS INTEGER) AS label, day, author, vec, source_weight, confidence FROM u JOIN candidates c ON c.id = candidate),
    s AS (SELECT w.id, r.id AS read_id, r.rating, r.day, r.author = w.author AS same, list_cosine_similarity(w.vec, r.vec) AS sim FROM w JOIN reads r ON r.day < w.day AND r.identity <> w.identity),
    n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, read_id) AS n, row_number() OVER (PARTITION BY id, rating >= 4 ORDER BY sim DESC, read_id) AS m FROM s),
    k AS (SELECT *, greatest(sim, 0) + 1e-4 AS tw, CASE WHEN n <= 40 THEN pow(greatest(sim, 0) + 1e-8, 8) END AS w, CASE WHEN n <= 40 THEN (max(CASE WHEN n <= 40 THEN day END) OVER (PARTITION BY id) - day) / 365.25 END AS age FROM n),
    t AS (SELECT id, sum(tw * sim) FILTER (rating >= 4 AND m <= 5) / sum(tw) FILTER (rating >= 4 AND m <= 5) AS up, max(sim) FILTER (rating >= 4) AS up_max, max(sim) FILTER (rating <= 2) AS down, sum(tw * rating) FILTER (n <= 5) / sum(tw) FILTER (n <= 5) AS local,
        sum(w * rating) / sum(w) AS kernel, sum(w * exp(-age / 8) * rating) / sum(w * exp(-age / 8)) AS recent, pow(sum(w), 2) / sum(w * w) AS ess, max(sim) AS best, count(*) AS hn, avg(rating) AS mean, count(*) FILTER (same) AS an, coalesce(sum(rating) FILTER (same), 0) AS a, count(*) FILTER (same AND rating >= 4) AS liked FROM k GROUP BY id),
    x AS (SELECT w.id, label, hn, liked, up_max, down, confidence, 42 + 48 * coalesce(up, 0.25) - 24 * coalesce(down, 0) + 3.5 * CASE WHEN best > 0 THEN local - 3 ELSE 0 END + 3.5 * CASE WHEN an > 0 THEN (a + 5 * mean) / (an + 5) - mean ELSE 0 END
        + CASE WHEN best > 0 THEN 10 * least(1, hn / 100.0) * (kernel - mean) * ess / (ess + 5) + 20 * least(1, hn / 100.0) * (recent - kernel) ELSE 0 END + 5 * (source_weight - 1) AS raw FROM w JOIN t USING (id))
    SELECT id, label, hn AS prior, round(least(100, greatest(0, 50 + confidence * (raw - 50))), 6) AS raw_score, round(round(least(100, greatest(0, 50 + confidence * (raw - 50))), 6), 1) AS score,
        round(least(100, greatest(0, 42 + 48 * coalesce(up_max, 0.25) - 24 * coalesce(down, 0) + CASE WHEN liked > 0 THEN 7 ELSE 0 END)), 6) AS earlier FROM x""")
def feedback_scores(spark, sf):
    """Decided candidates scored by the reads before their decision, their own work left out; undone and older decisions don't count."""
    c = candidates(spark, sf)
    k = F.col("id")
    identity = F.when(k % 9 == 1, F.concat(F.lit("r"), (k - 1).cast("string"))).otherwise(F.col("identity"))
    at = F.date_add(F.lit("2020-01-01").cast("date"), ((k * 7) % 400).cast("int")).cast("timestamp")
    told = c.select((k * 10).alias("id"), k.alias("candidate"), identity.alias("identity"), F.when(k % 4 == 1, "reject").otherwise("save").alias("action"), F.when(k % 5 != 0, at).alias("at"))
    older = told.select((F.col("id") - 1).alias("id"), "candidate", "identity", F.lit("reject").alias("action"), (F.col("at") - F.expr("INTERVAL 3 DAYS")).alias("at"))
    return rounded(replay.feedback_replay(told.unionByName(older), reads(spark, sf), c))
