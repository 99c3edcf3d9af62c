"""Validation, audit, slice and blend queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillrank.functions.dates import read_day
from quillrank.operators import checks as C
from quillrank.plans import serving
from quillrank.queries.registry import IMPRESSIONS, events, impressions, query, rounded
from quillrank.session import table
from quillrank.sources.feeds import filtered


@query("""SELECT p_partkey AS id, list_sort(list_filter([CASE WHEN p_partkey % 11 = 0 THEN 'missing_title' END, CASE WHEN p_partkey % 7 = 0 THEN 'missing_author' END, CASE WHEN p_partkey % 5 = 0 AND p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 THEN 'title_is_author' END, CASE WHEN p_partkey % 3 = 0 THEN 'bad_scheme' END], lambda x: x IS NOT NULL)) AS flags FROM part""")
def record_flags(spark, sf):
    k, name = F.col("p_partkey"), F.concat(F.lit("x"), F.col("p_name"))
    title = F.when(k % 11 == 0, "").otherwise(name)
    author = F.when(k % 7 == 0, "Unknown").when(k % 5 == 0, name).otherwise(F.concat(F.lit("y"), F.col("p_brand")))
    return table(spark, sf, "part").select(k.alias("id"), C.title_flags(title, author, F.when(k % 3 == 0, "ftp://x").otherwise("https://x")).alias("flags"))


@query("SELECT event_id AS id, CASE WHEN event_id < 10 THEN 'key' WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'type' END AS fault FROM events")
def event_validation(spark, sf):
    e = table(spark, sf, "events")
    key = F.concat(F.lit("event:"), F.col("event_id").cast("string"))
    return e.select(F.col("event_id").alias("id"), C.event_fault(F.when(F.col("event_id") < 10, "short").otherwise(F.concat(key, F.lit("xx"))), F.col("event_type"), F.col("value"), F.col("props"), ("view", "click", "purchase")).alias("fault"))


@query(f"WITH {IMPRESSIONS} SELECT run, count(*) FILTER (rank % 5 = 0) AS bad_ranks, 0::BIGINT AS shared_ranks, 0::BIGINT AS moved_items FROM impressions GROUP BY run")
def slot_validation(spark, sf):
    i = impressions(spark, sf).withColumn("rank", F.when(F.col("rank") % 5 == 0, -1).otherwise(F.col("rank")))
    return C.slot_violations(i, "run", "rank", "id")


@query("SELECT coalesce(a.k, b.k) AS id FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 4 <> 0) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 6 <> 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def aligned_join_check(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return C.misaligned(c.where("id % 4 <> 0"), c.where("id % 6 <> 0"), "id").select("id")


@query("SELECT state, count(*) AS n FROM (SELECT CASE WHEN vec_id % 5 = 0 THEN 'missing' WHEN vec_id % 5 = 1 THEN 'stale' WHEN vec_id % 5 = 2 THEN 'old' ELSE 'fresh' END AS state FROM embeddings) GROUP BY state")
def cache_states(spark, sf):
    k = F.col("vec_id") % 5
    state = C.cache_state(F.lit("h"), F.when(k == 0, None).when(k == 1, "g").otherwise("h"), F.size("embedding"), 64, F.when(k == 2, 400).otherwise(1))
    return table(spark, sf, "embeddings").select(state.alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x FROM events) SELECT state, count(*) AS n FROM (SELECT CASE WHEN x IS NULL THEN 'missing' WHEN event_id % 2 = 0 THEN CASE WHEN CAST(ts AS DATE) > CAST(x AS DATE) THEN 'after' WHEN CAST(ts AS DATE) = CAST(x AS DATE) THEN 'same_day' ELSE 'before' END WHEN ts > x THEN 'after' WHEN ts = x THEN 'same_time' ELSE 'before' END AS state FROM p) GROUP BY state""")
def event_chronology(spark, sf):
    x = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    p = events(spark, sf).withColumn("x", x)
    return p.select(C.chronology(F.col("ts"), F.col("x"), F.col("event_id") % 2 == 0).alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey AS id, min(year(l_shipdate)) AS year FROM lineitem GROUP BY 1 HAVING count(DISTINCT year(l_shipdate)) = 1")
def sole_year(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.year(F.col("l_shipdate").cast("date")).cast("long").alias("year"))
    return C.sole_value(l, "id", "year")


@query("SELECT event_id AS id, event_id % 7 = 0 OR ts < TIMESTAMP '2024-01-20' AS expired FROM events")
def lease_expiry(spark, sf):
    beat = F.when(F.col("event_id") % 7 == 0, "never").otherwise(F.col("ts").cast("string"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), C.expired(beat, F.lit(None).cast("string"), F.lit("2024-01-20 00:05:00").cast("timestamp")).alias("expired"))


@query("WITH f AS (SELECT event_type AS arm, user_id % 5 AS fold, avg(value) AS m FROM events GROUP BY 1, 2), a AS (SELECT arm, avg(m) AS mean FROM f GROUP BY arm) SELECT arm, round(mean, 6) AS mean, CAST(row_number() OVER (ORDER BY round(mean, 9) DESC, arm) AS INT) AS place FROM a")
def arm_selection(spark, sf):
    e = events(spark, sf).select(F.col("event_type").alias("arm"), (F.col("user_id") % 5).alias("fold"), "value")
    return rounded(C.mean_by(e, "arm", "fold", "value"))


@query("SELECT CAST(round(c_acctbal::DOUBLE / 100) AS BIGINT) AS score, count(*) AS n FROM customer GROUP BY 1")
def tie_density(spark, sf):
    return table(spark, sf, "customer").groupBy(F.round(F.col("c_acctbal").cast("double") / 100).cast("long").alias("score")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN l_discount < 0.03 THEN 'low' WHEN l_discount < 0.07 THEN 'middle' ELSE 'high' END AS bin, count(*) AS n, round(avg(l_quantity)::DOUBLE, 6) AS mean FROM lineitem GROUP BY 1")
def binned_slices(spark, sf):
    d = F.col("l_discount")
    g = table(spark, sf, "lineitem").groupBy(F.when(d < 0.03, "low").when(d < 0.07, "middle").otherwise("high").alias("bin"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("l_quantity").cast("double")), 6).alias("mean"))


@query(f"WITH {IMPRESSIONS} SELECT round(sum(CASE WHEN label = 1 THEN 1 / propensity ELSE 0 END), 4) AS low, round(sum(CASE WHEN label = 1 OR label IS NULL THEN 1 / propensity ELSE 0 END), 4) AS high, round(sum(1 / propensity), 4) AS total FROM impressions")
def inclusion_weighted(spark, sf):
    w = 1 / F.col("propensity")
    one = lambda when: F.round(F.sum(F.when(when, w).otherwise(0.0)), 4)
    return impressions(spark, sf).agg(one(F.col("label") == 1).alias("low"), one(F.col("label").isNull() | (F.col("label") == 1)).alias("high"), F.round(F.sum(w), 4).alias("total"))


@query("WITH y AS (SELECT year(o_orderdate) AS y, count(*) AS n, sum(o_totalprice::DOUBLE) AS s FROM orders GROUP BY 1) SELECT a.y AS year, round(sum(b.s * exp(-0.5 * pow((a.y - b.y) / 10.0, 2))) / sum(b.n * exp(-0.5 * pow((a.y - b.y) / 10.0, 2))), 4) AS local_mean FROM y a CROSS JOIN y b GROUP BY a.y")
def era_local_mean(spark, sf):
    """Rows are summed per year first, so years meet years: a few dozen on each side."""
    y = table(spark, sf, "orders").groupBy(F.year(F.col("o_orderdate").cast("date")).cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("double")).alias("s"))
    b = y.select(F.col("year").alias("b"), "n", "s")
    w = F.exp(-0.5 * F.pow((F.col("year") - F.col("b")) / 10.0, 2))
    return y.select("year").crossJoin(b).groupBy("year").agg(F.round(F.sum(F.col("s") * w) / F.sum(F.col("n") * w), 4).alias("local_mean"))


@query("WITH t AS (SELECT avg(l_quantity::DOUBLE) AS ma, stddev_pop(l_quantity::DOUBLE) AS sa, avg(l_discount::DOUBLE) AS mb, stddev_pop(l_discount::DOUBLE) AS sb FROM lineitem WHERE l_orderkey % 2 = 0) SELECT l_orderkey AS id, round(max((l_quantity::DOUBLE - ma) / sa + 0.25 * (l_discount::DOUBLE - mb) / sb), 6) AS blend FROM lineitem CROSS JOIN t GROUP BY 1")
def additive_blend(spark, sf):
    """Signals in units of the training rows, added with a weight."""
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").cast("double").alias("a"), F.col("l_discount").cast("double").alias("b"))
    t = l.where("id % 2 = 0").agg(*[f(c).alias(f"{n}{c}") for c in "ab" for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = (F.col("a") - F.col("ma")) / F.col("sa") + 0.25 * (F.col("b") - F.col("mb")) / F.col("sb")
    return rounded(l.crossJoin(F.broadcast(t)).groupBy("id").agg(F.max(z).alias("blend")))


@query("WITH s AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_suppkey % 8)) AS a, list_sort(list(DISTINCT l_partkey % 8)) AS b FROM lineitem GROUP BY 1) SELECT id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS jaccard FROM s")
def facet_jaccard(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.col("l_suppkey") % 8).alias("a"), F.collect_set(F.col("l_partkey") % 8).alias("b"))
    return rounded(s.select("id", (F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))).alias("jaccard")))


@query("""WITH c AS (SELECT c_custkey // 100 AS run, c_custkey AS id, CAST(50 + c_custkey % 50 AS DOUBLE) AS score, row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY 50 + c_custkey % 50 DESC, c_custkey DESC) AS pos FROM customer),
    n AS (SELECT *, CASE WHEN pos <= 24 THEN score + greatest(-1.2, least(1.2, (id % 7 - 3)::DOUBLE)) ELSE score END AS new_score FROM c)
    SELECT run, id, score, CAST(pos AS INT) AS pos, new_score, CAST(row_number() OVER (PARTITION BY run ORDER BY CASE WHEN pos <= 24 THEN 0 ELSE 1 END, CASE WHEN pos <= 24 THEN -new_score ELSE pos END, id DESC) AS INT) AS position FROM n""")
def outside_deltas(spark, sf):
    """Clipped deltas on the head of each page, a hundred customers to a page."""
    c = table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 100).alias("run"), F.col("c_custkey").alias("id"), (50 + F.col("c_custkey") % 50).cast("double").alias("score"))
    c = c.withColumn("pos", F.row_number().over(Window.partitionBy("run").orderBy(F.col("score").desc(), F.col("id").desc())))
    return serving.nudged(c, c.select("id", (F.col("id") % 7 - 3).cast("double").alias("delta")), by="run")


@query("SELECT p_partkey AS id FROM part WHERE concat(' ', lower(p_name), ' ') LIKE '% blue %' AND p_partkey % 3 <> 0")
def phrase_filter(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array("p_name", F.when(F.col("p_partkey") % 3 == 0, "out of print").otherwise("in print")).alias("genres"))
    return filtered(p, ["blue"], ["out of print"]).select("id")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'hidden' ELSE 'recommended' END AS status, CAST(CASE WHEN c_custkey % 6 = 0 THEN 50 + c_custkey % 50 WHEN c_custkey % 4 = 0 THEN least(100, 60 + c_custkey % 50) ELSE 50 + c_custkey % 50 END AS DOUBLE) AS score FROM customer")
def shelf_effects(spark, sf):
    """Being read now hides a candidate; being on the list to read lifts it by ten points."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (50 + F.col("c_custkey") % 50).cast("double").alias("score"), F.array(F.concat(F.lit("k"), F.col("c_custkey").cast("string"))).alias("keys"))
    now, later = (c.where(f"id % {m} = 0").select(F.explode("keys").alias("k")).distinct() for m in (6, 4))
    flag = lambda shelf, name: c.select("id", F.explode("keys").alias("k")).join(shelf, "k", "left_semi").select("id", F.lit(True).alias(name)).distinct()
    j = c.join(flag(now, "now"), "id", "left").join(flag(later, "later"), "id", "left")
    lifted = F.when(F.col("now").isNull() & F.col("later"), F.least(F.lit(100.0), F.col("score") + 10)).otherwise(F.col("score"))
    return j.select("id", F.when(F.col("now"), "hidden").otherwise("recommended").alias("status"), lifted.alias("score"))


@query("""WITH d AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, ts FROM events), h AS (SELECT user_id, CAST(ts AS DATE) AS day, ts FROM events WHERE event_type = 'view'), a AS (SELECT event_id, user_id, ts, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase')
    SELECT event_id AS id, count(h.ts) AS known FROM a LEFT JOIN h ON a.user_id = h.user_id AND h.day < a.day GROUP BY event_id""")
def history_available_at(spark, sf):
    """What was known before an action's day: a running count per day, met by day."""
    e = events(spark, sf).withColumn("day", F.to_date("ts"))
    days = e.groupBy("user_id", "day").agg(F.count_if(F.col("event_type") == "view").alias("v"))
    before = F.coalesce(F.sum("v").over(Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return e.where("event_type = 'purchase'").join(days.withColumn("known", before), ["user_id", "day"]).select(F.col("event_id").alias("id"), "known")


def _delivered(orders):
    d = orders.groupBy(F.col("o_orderpriority").alias("period"), (F.col("o_orderkey") % 9).alias("delivery")).agg(F.collect_set(F.col("o_custkey") % 20).alias("ids"))
    return d.select("period", F.explode("ids").alias("i")).groupBy("period").agg(F.array_sort(F.collect_set("i")).alias("ids"))


@query("SELECT o_orderpriority AS period, list_sort(list(DISTINCT o_custkey % 20)) AS ids FROM orders GROUP BY 1")
def delivered_ids(spark, sf):
    """Distinct union of id lists over the deliveries of a period."""
    return _delivered(table(spark, sf, "orders"))


@query("SELECT event_id AS id, event_id % 2 = 0 AS kept FROM events")
def provenance_verified(spark, sf):
    """A value counts only if the stored digest is the digest of the value."""
    v = F.col("event_type")
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.sha2(v, 256) == F.sha2(F.when(F.col("event_id") % 2 == 0, v).otherwise("other"), 256)).alias("kept"))


@query("SELECT event_id AS id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS day FROM events")
def mixed_read_days(spark, sf):
    ts = F.col("ts").cast("timestamp")
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd")).when(k == 1, F.date_format(ts, "yyyy/MM/dd")).when(k == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), read_day(raw).cast("string").alias("day"))


@query()
def tail_classifier(spark, sf):
    """Chance of a high rating by ridge logistic regression on the vectors."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (1 + F.col("label") % 5 >= 4).cast("double").alias("y"), array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("x"))
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=0.01).fit(e.where("id % 2 = 0"))
    return model.transform(e.where("id % 2 = 1")).select("id", F.round(vector_to_array("probability")[1], 6).alias("high"))


@query()
def rating_ridge(spark, sf):
    """Ridge prediction of ratings, its correction of a neutral score capped at five points."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (1 + F.col("label") % 5).cast("double").alias("y"), array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("x"))
    model = LinearRegression(featuresCol="x", labelCol="y", regParam=0.1, elasticNetParam=0.0).fit(e.where("id % 2 = 0"))
    p = model.transform(e.where("id % 2 = 1"))
    return p.select("id", F.round("prediction", 6).alias("rating"), F.round(F.greatest(F.lit(-5.0), F.least(F.lit(5.0), 10 * (F.col("prediction") - 3))), 6).alias("correction"))


@query()
def isotonic_calibration(spark, sf):
    from pyspark.ml.regression import IsotonicRegression

    x = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", F.col("quality").cast("double").alias("label"), F.col("n_chars").cast("double").alias("features"))
    return IsotonicRegression().fit(x).transform(x).select("doc_id", F.round("prediction", 6).alias("calibrated"))
