"""Learner, fatigue and evaluation queries over the event log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillrank.operators import aggregates as A
from quillrank.operators import windows as W
from quillrank.operators.joins import latest_before
from quillrank.plans import evaluation, serving
from quillrank.queries.registry import ACTIONS, IMPRESSIONS, actions, events, impressions, query, rounded
from quillrank.session import table

NOW = "2024-02-01 00:00:00"
_LATEST = f"WITH {ACTIONS}, last AS (SELECT * FROM actions QUALIFY row_number() OVER (PARTITION BY book ORDER BY ts DESC NULLS LAST, id DESC) = 1), obs AS (SELECT book, label, pow(0.5, greatest(0, (epoch(TIMESTAMP '{NOW}') - epoch_us(ts) // 1000000) / 86400.0) / 730.0) AS weight FROM last WHERE label IS NOT NULL)"
_FEATURES = "f AS (SELECT book, unnest([concat('author:a', book % 3), concat('subject:s', book % 5), CASE WHEN book % 4 = 0 THEN 'era:2020_plus' ELSE concat('era:', book % 2) END]) AS feature FROM obs)"


def _observed(spark, sf):
    return serving.latest_observations(actions(spark, sf), F.lit(NOW).cast("timestamp"))


def _features(obs):
    b = F.col("book")
    names = F.array(F.concat(F.lit("author:a"), (b % 3).cast("string")), F.concat(F.lit("subject:s"), (b % 5).cast("string")), F.when(b % 4 == 0, "era:2020_plus").otherwise(F.concat(F.lit("era:"), (b % 2).cast("string"))))
    return obs.select("book", F.explode(names).alias("feature"))


@query(_LATEST + " SELECT book, label, round(weight, 6) AS weight FROM obs WHERE weight >= 0.05")
def latest_action_per_entity(spark, sf):
    return rounded(_observed(spark, sf))


@query(_LATEST + f", {_FEATURES} SELECT feature, count(*) AS n, round(sum(weight), 6) AS weight, round(sum(weight * label), 6) AS positive, round(pow(sum(weight), 2) / sum(weight * weight), 6) AS effective FROM f JOIN obs USING (book) GROUP BY feature")
def decayed_feature_sums(spark, sf):
    obs = _observed(spark, sf)
    g = _features(obs).join(obs, "book").groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("label")).alias("positive"), (F.pow(F.sum("weight"), 2) / F.sum(F.col("weight") * F.col("weight"))).alias("effective"))
    return rounded(g)


@query(_LATEST + f""", {_FEATURES}, g AS (SELECT feature, sum(weight) AS w, sum(weight * label) AS p, sum(weight * weight) AS w2 FROM f JOIN obs USING (book) GROUP BY feature)
    SELECT feature, round((p / w + 1.9208 / n) / (1 + 3.8416 / n) - 1.96 * sqrt(p / w * (1 - p / w) / n + 0.9604 / (n * n)) / (1 + 3.8416 / n), 6) AS low, round((p / w + 1.9208 / n) / (1 + 3.8416 / n) + 1.96 * sqrt(p / w * (1 - p / w) / n + 0.9604 / (n * n)) / (1 + 3.8416 / n), 6) AS high
    FROM (SELECT *, greatest(1, w * w / w2) AS n FROM g)""")
def wilson_gate(spark, sf):
    obs = _observed(spark, sf)
    g = _features(obs).join(obs, "book").groupBy("feature").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("label")).alias("p"), F.sum(F.col("weight") * F.col("weight")).alias("w2"))
    low, high = A.wilson(F.col("p"), F.col("w"), F.col("w") * F.col("w") / F.col("w2"))
    return rounded(g.select("feature", low.alias("low"), high.alias("high")))


def _wilson(p, w, n):
    n = f"greatest(1, {n})"
    mid, half = f"(({p}) / ({w}) + 1.9208 / {n}) / (1 + 3.8416 / {n})", f"1.96 * sqrt(({p}) / ({w}) * (1 - ({p}) / ({w})) / {n} + 0.9604 / ({n} * {n})) / (1 + 3.8416 / {n})"
    return f"greatest(0, {mid} - {half})", f"least(1, {mid} + {half})"


_LOW, _HIGH = _wilson("p", "w", "n")
_OLOW, _OHIGH = _wilson("op", "nullif(ow, 0)", "coalesce(m, 0)")
_EFFECTS = f"""o AS (SELECT * FROM obs WHERE weight >= 0.05), t AS (SELECT count(*) AS books, sum(weight) AS tw, sum(CASE WHEN label = 1 THEN weight ELSE 0 END) AS tp, sum(weight * weight) AS tw2 FROM o),
    g AS (SELECT feature, sum(weight) AS w, sum(CASE WHEN label = 1 THEN weight ELSE 0 END) AS p, sum(weight * weight) AS w2 FROM f JOIN o USING (book) GROUP BY feature),
    h AS (SELECT *, greatest(0, tw - w) AS ow, greatest(0, tp - p) AS op, greatest(0, tw2 - w2) AS ow2 FROM g CROSS JOIN t WHERE tw >= 4.5), i AS (SELECT *, w * w / w2 AS n, CASE WHEN ow2 > 0 THEN ow * ow / ow2 END AS m FROM h),
    j AS (SELECT *, {_LOW} AS low, {_HIGH} AS high, {_OLOW} AS olow, {_OHIGH} AS ohigh, CASE WHEN feature LIKE 'author:%' THEN 4.0 WHEN feature = 'era:2020_plus' THEN 1.0 WHEN feature LIKE 'era:%' THEN 3.5 ELSE 2.0 END::DOUBLE AS cap,
        CASE WHEN feature LIKE 'author:%' THEN 3.0 WHEN feature = 'era:2020_plus' THEN 4.0 WHEN feature LIKE 'era:%' THEN 3.0 ELSE 3.5 END::DOUBLE AS prior FROM i),
    l AS (SELECT *, CASE WHEN low > ohigh THEN low - ohigh WHEN high < olow THEN high - olow END AS gap, n + 1e-9 >= 6 AND coalesce(m, 0) + 1e-9 >= 6 AND w >= 4.5 AND ow >= 4.5 AS ready, cap * ((p + prior * tp / tw) / (w + prior) - tp / tw) / 0.5 AS s FROM j),
    effects AS (SELECT * FROM (SELECT feature, coalesce(CASE WHEN ready THEN sign(gap) * cap * least(1, abs(p / w - op / ow) / 0.5) * least(1, abs(gap) / 0.15) END, CASE WHEN books >= 20 AND w >= 1.5 AND abs(s) >= 0.05 THEN least(cap, greatest(-cap, s)) END) AS effect FROM l) WHERE effect IS NOT NULL)"""


def _deltas(features):
    """SQL of what effects move each id by, given a table of (id, feature)."""
    return f"""ranked AS (SELECT id, feature, effect, NOT (feature LIKE 'author:%' OR feature LIKE 'era:%') AS subject FROM {features} JOIN effects USING (feature)), shares AS (SELECT *, row_number() OVER (PARTITION BY id, subject ORDER BY abs(effect) DESC, feature) AS turn FROM ranked),
    moves AS (SELECT id, greatest(-8, least(8, sum(CASE WHEN NOT subject THEN effect WHEN turn <= 4 THEN effect * pow(0.5, turn - 1) ELSE 0 END))) AS d FROM shares GROUP BY id)"""


@query(_LATEST + f", {_FEATURES}, {_EFFECTS} SELECT feature, round(effect, 6) AS effect FROM effects")
def feature_effects(spark, sf):
    obs = _observed(spark, sf)
    return rounded(serving.feature_effects(obs, _features(obs)))


@query(_LATEST + f""", {_FEATURES}, {_EFFECTS}, bf AS (SELECT book AS id, feature FROM f JOIN o USING (book)), {_deltas("bf")}, c AS (SELECT book AS id, CAST(50 + book % 40 AS DOUBLE) AS score, 0.9 * coalesce(d, 0) AS delta FROM o LEFT JOIN moves ON moves.id = book)
    SELECT id, score, 0.9::DOUBLE AS confidence, round(delta, 6) AS delta, CASE WHEN abs(delta) >= 0.05 THEN round(least(100, greatest(0, score + delta)), 1) ELSE score END AS new_score FROM c""")
def personalize(spark, sf):
    obs = _observed(spark, sf)
    effects = serving.feature_effects(obs, _features(obs))
    books = obs.select("book").distinct().select(F.col("book").alias("id"), (50 + F.col("book") % 40).cast("double").alias("score"), F.lit(0.9).alias("confidence"))
    return rounded(serving.personalized(books, _features(obs).withColumnRenamed("book", "id"), effects))


_ASOF = """SELECT p.event_id, p.user_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND {when} QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY v.ts DESC, v.event_id DESC) = 1"""


def _asof(spark, sf, before):
    e = events(spark, sf)
    p = e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("ts").alias("p_ts"))
    v = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("v_ts"))
    return latest_before(p.withColumn("at", before), v, "user_id", "at", "v_ts", ["v_ts", "view_id"]).select("event_id", "user_id", "view_id")


@query(_ASOF.format(when="v.ts < p.ts"))
def asof_attribution_ts(spark, sf):
    return _asof(spark, sf, F.col("p_ts"))


@query(_ASOF.format(when="CASE WHEN p.event_id % 3 = 0 THEN CAST(v.ts AS DATE) < CAST(p.ts AS DATE) ELSE v.ts < p.ts END"))
def asof_attribution_day(spark, sf):
    # Known by its day only: what came before that day began.
    return _asof(spark, sf, F.when(F.col("event_id") % 3 == 0, F.date_trunc("day", "p_ts")).otherwise(F.col("p_ts")))


_DAYS = "d AS (SELECT user_id AS id, count(DISTINCT CAST(ts AS DATE)) AS days FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-11' AND ts <= TIMESTAMP '2024-02-01' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100) GROUP BY user_id)"


def _days(spark, sf):
    e = events(spark, sf)
    v = e.where("event_type = 'view'").select(F.col("user_id").alias("id"), F.col("ts").alias("visible_at"))
    return serving.visible_days(v, e.where("event_type = 'error' and value > 100").select(F.col("user_id").alias("id")), F.lit(NOW).cast("timestamp"))


@query(f"WITH {_DAYS} SELECT * FROM d")
def unacted_visible_days(spark, sf):
    return _days(spark, sf)


@query(f"""WITH {_DAYS}, c AS (SELECT c_custkey AS id, CAST(50 + c_custkey % 50 AS DOUBLE) AS score, row_number() OVER (ORDER BY 50 + c_custkey % 50 DESC, c_custkey DESC) AS pos FROM customer),
    p AS (SELECT c.*, least(4.5, greatest(0, (coalesce(days, 0) - 3) * 0.75)) AS penalty FROM c LEFT JOIN d USING (id)), q AS (SELECT *, greatest(0, score - penalty) AS new_score, max(penalty > 0) OVER () AS moved FROM p)
    SELECT id, score, CAST(pos AS INT) AS pos, CAST(penalty AS DOUBLE) AS penalty, CAST(new_score AS DOUBLE) AS new_score, CAST(row_number() OVER (ORDER BY CASE WHEN moved THEN -new_score ELSE pos END, id DESC) AS INT) AS position FROM q""")
def fatigue_rerank(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (50 + F.col("c_custkey") % 50).cast("double").alias("score"))
    return serving.fatigued(W.placed(c, [-F.col("score"), -F.col("id")], "pos"), _days(spark, sf))


_W = f"WITH {IMPRESSIONS}, w AS (SELECT *, 1 / propensity AS weight FROM impressions)"


def _weighted(spark, sf):
    return impressions(spark, sf).withColumn("weight", 1 / F.col("propensity"))


@query(_W + ", p AS (SELECT score, weight FROM w WHERE label = 1), q AS (SELECT score, sum(weight) AS weight FROM w WHERE label = 0 GROUP BY score), c AS (SELECT score, weight, sum(weight) OVER (ORDER BY score) - weight AS below FROM q) SELECT round(sum(p.weight * (coalesce((SELECT sum(weight) FROM q WHERE q.score < p.score), 0) + 0.5 * coalesce((SELECT sum(weight) FROM q WHERE q.score = p.score), 0))) / (sum(p.weight) * (SELECT sum(weight) FROM q)), 6) AS auc FROM p")
def ips_auc(spark, sf):
    return rounded(A.weighted_auc(_weighted(spark, sf).where("label is not null"), "label", "score", "weight"))


@query(_W + " SELECT round(avg(p), 6) AS precision FROM (SELECT sum(CASE WHEN label > 0.5 THEN weight ELSE 0 END) / sum(weight) AS p FROM w WHERE rank <= 8 AND label IS NOT NULL GROUP BY run)")
def ips_precision_at_k(spark, sf):
    return rounded(A.precision_at(_weighted(spark, sf), "run", "rank", "label", "weight", 8))


@query(_W + """, k AS (SELECT run, rank, label * weight AS gain, row_number() OVER (PARTITION BY run ORDER BY label * weight DESC, rank) AS best FROM w WHERE label IS NOT NULL),
    r AS (SELECT run, sum(CASE WHEN rank <= 8 THEN gain / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN best <= 8 THEN gain / log2(best + 1) ELSE 0 END) AS ideal FROM k GROUP BY run) SELECT round(avg(dcg / ideal), 6) AS ndcg FROM r WHERE ideal > 0""")
def ips_ndcg_at_k(spark, sf):
    return rounded(A.ndcg_at(_weighted(spark, sf), "run", "rank", "label", "weight", 8))


@query(_W + """, r AS (SELECT run, min(ts) AS t FROM w GROUP BY run), k AS (SELECT run, row_number() OVER (ORDER BY t, run) AS k, count(*) OVER () AS n FROM r),
    s AS (SELECT run, CASE WHEN k <= greatest(1, floor(n * 0.6)) THEN 'train' WHEN k <= greatest(greatest(1, floor(n * 0.6)), floor(n * 0.8)) THEN 'validation' ELSE 'test' END AS split FROM k),
    z AS (SELECT *, unnest(CASE WHEN label IN (0, 1) THEN ['sample', split, 'enjoyment'] ELSE ['sample', split] END) AS part FROM w JOIN s USING (run)),
    a AS (SELECT part, count(*) AS impressions, count(label) AS labelled, count(*) FILTER (label > 0.5) AS positive, count(*) FILTER (label < 0.5) AS negative, count(DISTINCT run) AS runs FROM z GROUP BY part),
    b AS (SELECT part, score, coalesce(sum(weight) FILTER (label > 0.5), 0) AS p, coalesce(sum(weight) FILTER (label < 0.5), 0) AS q FROM z WHERE label <> 0.5 GROUP BY part, score),
    c AS (SELECT part, sum(p * (below + q / 2)) / (sum(p) * sum(q)) AS auc FROM (SELECT *, coalesce(sum(q) OVER (PARTITION BY part ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b) GROUP BY part),
    d AS (SELECT part, avg(p) AS precision FROM (SELECT part, run, sum(CASE WHEN label > 0.5 THEN weight ELSE 0 END) / sum(weight) AS p FROM z WHERE rank <= 20 AND label IS NOT NULL GROUP BY part, run) GROUP BY part),
    e AS (SELECT part, run, rank, label * weight AS gain, row_number() OVER (PARTITION BY part, run ORDER BY label * weight DESC, rank) AS best FROM z WHERE label IS NOT NULL),
    f AS (SELECT part, avg(dcg / ideal) AS ndcg FROM (SELECT part, run, sum(CASE WHEN rank <= 20 THEN gain / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN best <= 20 THEN gain / log2(best + 1) ELSE 0 END) AS ideal FROM e GROUP BY part, run) WHERE ideal > 0 GROUP BY part)
    SELECT part, impressions, labelled, positive, negative, runs, round(auc, 6) AS auc, round(precision, 6) AS precision, round(ndcg, 6) AS ndcg, concat_ws(',', CASE WHEN runs < 20 THEN 'runs' END, CASE WHEN labelled < 200 THEN 'labelled' END, CASE WHEN positive < 20 THEN 'positive' END, CASE WHEN negative < 20 THEN 'negative' END) AS short_of
    FROM a LEFT JOIN c USING (part) LEFT JOIN d USING (part) LEFT JOIN f USING (part)""")
def metric_report(spark, sf):
    """Ranking metrics of the whole sample, its temporal splits and rated outcomes alone, with what there is too little of."""
    return rounded(evaluation.metric_report(_weighted(spark, sf).withColumn("rating", F.col("label").isin(0.0, 1.0))))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean_value, round(median(value), 6) AS median_value FROM events GROUP BY event_type")
def signal_metrics(spark, sf):
    return rounded(events(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.avg("value").alias("mean_value"), F.median("value").alias("median_value")))


_LAB = "x AS (SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id))"


@query(f"WITH {_LAB}, r AS (SELECT *, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS k FROM x) SELECT round((sum(k) FILTER (quality = 1) - sum(quality) * (sum(quality) + 1) / 2.0) / (sum(quality) * (count(*) - sum(quality))), 6) AS auc FROM r")
def rank_auc(spark, sf):
    x = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return rounded(A.rank_auc(x, "quality", "n_chars"))


@query("WITH x AS (SELECT l_quantity::DOUBLE AS y, l_extendedprice::DOUBLE / 1000 AS x FROM lineitem), r AS (SELECT *, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx FROM x) SELECT round(avg(abs(y - x)), 6) AS mae, round(sqrt(avg(pow(y - x, 2))), 6) AS rmse, round(corr(rx, ry), 6) AS spearman FROM r")
def raw_ranking_metrics(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("y"), (F.col("l_extendedprice").cast("double") / 1000).alias("x"))
    return rounded(evaluation.raw_metrics(x, "y", "x"))


@query("SELECT decile, count(*) AS n, round(min(o_totalprice::DOUBLE), 6) AS low, round(avg(o_totalprice::DOUBLE), 4) AS mean FROM (SELECT o_totalprice, CAST(ntile(10) OVER (ORDER BY o_totalprice, o_orderkey) AS INT) AS decile FROM orders) GROUP BY decile")
def score_deciles(spark, sf):
    d = A.deciles(table(spark, sf, "orders"), "o_totalprice", "o_orderkey").groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("o_totalprice").cast("double")).alias("low"), F.avg(F.col("o_totalprice").cast("double")).alias("mean"))
    return d.select("decile", "n", F.round("low", 6).alias("low"), F.round("mean", 4).alias("mean"))


@query(f"WITH {IMPRESSIONS} SELECT count(rank) AS n, median(rank) AS median_rank, count(*) FILTER (rank <= 8) AS hit8, count(*) FILTER (rank <= 24) AS hit24, round(avg(1.0 / rank), 6) AS mrr FROM impressions WHERE label = 1")
def rank_summary(spark, sf):
    return rounded(A.reciprocal_ranks(impressions(spark, sf).where("label = 1"), "rank"))


@query(f"""WITH {IMPRESSIONS}, r AS (SELECT run, min(ts) AS t FROM impressions GROUP BY run), k AS (SELECT run, row_number() OVER (ORDER BY t, run) AS k, count(*) OVER () AS n FROM r),
    s AS (SELECT run, CASE WHEN k <= greatest(1, floor(n * 0.6)) THEN 'train' WHEN k <= greatest(greatest(1, floor(n * 0.6)), floor(n * 0.8)) THEN 'validation' ELSE 'test' END AS split FROM k)
    SELECT split, count(DISTINCT run) AS runs, count(*) AS n FROM impressions JOIN s USING (run) GROUP BY split""")
def temporal_split_runs(spark, sf):
    return W.run_split(impressions(spark, sf), "run", "ts").groupBy("split").agg(F.count_distinct("run").alias("runs"), F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT o_orderdate AS day, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT day, n, coalesce(sum(n) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS t FROM d)
    SELECT CASE WHEN b < floor(t * 0.6) THEN 'train' WHEN b < floor(t * 0.8) THEN 'validation' ELSE 'later' END AS split, CAST(sum(n) AS BIGINT) AS n, count(*) AS days FROM c GROUP BY 1""")
def whole_day_split(spark, sf):
    s = W.day_split(table(spark, sf, "orders"), "o_orderdate", "o_orderkey")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderdate").alias("days"))


@query("WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(value) AS n, sum(value) AS s FROM events GROUP BY 1, 2) SELECT user_id, CAST(day AS VARCHAR) AS day, n, CAST(sum(n) OVER w AS BIGINT) AS n_before, round(sum(s) OVER w, 2) AS sum_before FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def causal_prefix_sums(spark, sf):
    """What was known before each day: days are summed first, so the join on earlier days is a window."""
    d = events(spark, sf).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("value").alias("n"), F.sum("value").alias("s"))
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return d.select("user_id", F.col("day").cast("string").alias("day"), "n", F.sum("n").over(w).alias("n_before"), F.round(F.sum("s").over(w), 2).alias("sum_before"))


@query()
def cluster_bootstrap(spark, sf):
    x = impressions(spark, sf).where("label in (0, 1)")
    return rounded(evaluation.cluster_bootstrap(x, "run", "label", "score"))


@query("SELECT round(greatest(0, regr_slope(l_extendedprice::DOUBLE, l_quantity::DOUBLE)), 6) AS slope, round(avg(l_extendedprice::DOUBLE) - greatest(0, regr_slope(l_extendedprice::DOUBLE, l_quantity::DOUBLE)) * avg(l_quantity::DOUBLE), 4) AS intercept FROM lineitem")
def ols_calibration(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("p"))
    return A.calibration(x, "q", "p").select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("SELECT round(covar_pop(l_extendedprice::DOUBLE, l_quantity::DOUBLE) / (var_pop(l_quantity::DOUBLE) + 10.0 / count(*)), 6) AS slope FROM lineitem")
def ridge_calibration(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("p"))
    return rounded(x.agg((F.covar_pop("p", "q") / (F.var_pop("q") + 10.0 / F.count(F.lit(1)))).alias("slope")))


@query("""WITH a AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer), b AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_nationkey DESC, c_acctbal DESC, c_custkey) AS r FROM customer)
    SELECT round(avg(abs(a.r - b.r)), 6) AS mean_move, max(abs(a.r - b.r)) AS max_move, median(abs(a.r - b.r)) AS median_move, count(*) FILTER (a.r <= 8 AND b.r <= 8) AS same8, count(*) FILTER (a.r <= 20 AND b.r <= 20) AS same20 FROM a JOIN b USING (id)""")
def rank_movement(spark, sf):
    c = table(spark, sf, "customer")
    balance, key = -F.col("c_acctbal"), F.col("c_custkey")
    r = W.placed(W.placed(c.select("c_custkey", "c_acctbal", "c_nationkey"), [balance, key], "a"), [-F.col("c_nationkey"), balance, key], "b")
    move = F.abs(F.col("a") - F.col("b"))
    both = lambda k: F.count_if((F.col("a") <= k) & (F.col("b") <= k))
    return rounded(r.agg(F.avg(move).alias("mean_move"), F.max(move).cast("long").alias("max_move"), F.median(move).alias("median_move"), both(8).alias("same8"), both(20).alias("same20")))


@query("WITH g AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(p) AS linked, count(*) FILTER (p = ts) AS same, round(median(epoch_us(ts) / 1e6 - epoch_us(p) / 1e6), 3) AS median_gap FROM g")
def telemetry_coverage(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    g = events(spark, sf).select("user_id", "ts", F.lag("ts").over(w).alias("p"))
    gap = (F.unix_micros("ts") - F.unix_micros("p")) / 1e6
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.count("p").alias("linked"), F.count_if(F.col("p") == F.col("ts")).alias("same"), F.round(F.median(gap), 3).alias("median_gap"))
