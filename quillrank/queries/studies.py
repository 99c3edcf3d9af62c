"""Queries of offline studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.functions.vectors import dot, unit
from quillrank.operators import windows as W
from quillrank.plans import evaluation
from quillrank.plans import studies as S
from quillrank.queries.registry import events, query, reads, rounded
from quillrank.session import table


def _rated(spark, sf):
    """Lines as rated rows with two scores."""
    l = table(spark, sf, "lineitem")
    return l.select(F.col("l_orderkey").alias("id"), (F.col("l_quantity") % 5 + 1).alias("rating"), (F.col("l_linenumber") % 3).alias("fold"), (F.col("l_extendedprice") / 1000).alias("current"), (F.col("l_extendedprice") / 1000 + F.col("l_quantity") % 5).alias("candidate"), F.col("l_returnflag").alias("slice"), F.to_date("l_shipdate").alias("day"))


_RATED = "r AS (SELECT l_orderkey AS id, l_quantity % 5 + 1 AS rating, l_linenumber % 3 AS fold, l_extendedprice / 1000 AS current, l_extendedprice / 1000 + l_quantity % 5 AS candidate, l_returnflag AS slice, CAST(l_shipdate AS DATE) AS day FROM lineitem)"
_AUC = "(sum(CASE WHEN {0} THEN rk END) - count(*) FILTER ({0}) * (count(*) FILTER ({0}) + 1) / 2.0) / (count(*) FILTER ({0}) * count(*) FILTER (NOT {0}))"
_ARMS = "a AS (SELECT 'current' AS arm, current AS score, * EXCLUDE (current, candidate) FROM r UNION ALL SELECT 'candidate', candidate, * EXCLUDE (current, candidate) FROM r)"


def _ranked(by: str) -> str:
    return f"k AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY score) + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0 AS rk FROM a)"


@query(f"WITH {_RATED}, {_ARMS}, {_ranked('arm, fold')}, f AS (SELECT arm, fold, {_AUC.format('rating >= 4')} AS high, {_AUC.format('rating > 2')} AS low FROM k GROUP BY 1, 2) SELECT arm, round(avg(high), 6) AS high, round(avg(low), 6) AS low, round((avg(high) + avg(low)) / 2, 6) AS balanced FROM f GROUP BY arm")
def balanced_auc(spark, sf):
    return rounded(S.balanced_auc(S.stacked(_rated(spark, sf), ["current", "candidate"]), "rating", "score", "fold"))


@query(f"WITH {_RATED}, {_ARMS}, {_ranked('arm, slice')}, f AS (SELECT arm, slice, {_AUC.format('rating >= 4')} AS auc, avg(abs(rating - score)) AS mae FROM k GROUP BY 1, 2) SELECT c.slice, c.arm, round(c.auc - b.auc, 6) AS auc_delta, round(c.mae - b.mae, 6) AS mae_delta FROM f c JOIN f b USING (slice) WHERE c.arm = 'candidate' AND b.arm = 'current'")
def slice_comparison(spark, sf):
    from quillrank.operators.aggregates import rank_auc

    arms = S.stacked(_rated(spark, sf), ["current", "candidate"]).withColumn("high", (F.col("rating") >= 4).cast("int"))
    by = ["slice", "arm"]
    metrics = rank_auc(arms, "high", "score", by).join(arms.groupBy(*by).agg(F.avg(F.abs(F.col("rating") - F.col("score"))).alias("mae")), by)
    return rounded(S.deltas(metrics, "current", ["auc", "mae"], ["slice"]))


@query(f"WITH {_RATED}, t AS (SELECT avg(current) AS sm, stddev_pop(current) AS ss, avg(rating) AS rm, stddev_pop(rating) AS rs FROM r WHERE fold < 2) SELECT id, round(max(rm + (current - sm) * rs / ss), 6) AS aligned FROM r CROSS JOIN t GROUP BY id")
def score_alignment(spark, sf):
    return rounded(S.aligned(_rated(spark, sf), "current", "rating", F.col("fold") < 2).groupBy("id").agg(F.max("aligned").alias("aligned")))


@query(f"""WITH a AS (SELECT event_id AS id, value AS score, event_type = 'purchase' AS y FROM events WHERE event_type IN ('purchase', 'error')), k AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM a), t AS (SELECT * FROM a ORDER BY score DESC, id LIMIT 20), b AS (SELECT * FROM a ORDER BY score, id DESC LIMIT 20)
    SELECT (SELECT round({_AUC.format('y')}, 6) FROM k) AS auc, (SELECT count(*) FILTER (y) FROM t) AS top_saves, (SELECT count(*) FILTER (NOT y) FROM t) AS top_rejects, (SELECT count(*) FILTER (y) FROM b) AS bottom_saves, (SELECT count(*) FILTER (NOT y) FROM b) AS bottom_rejects""")
def feedback_metrics(spark, sf):
    e = table(spark, sf, "events").where(F.col("event_type").isin("purchase", "error"))
    return rounded(S.feedback_metrics(e.select(F.col("event_id").alias("id"), F.col("value").alias("score"), (F.col("event_type") == "purchase").cast("int").alias("label")), "label", "score", "id"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'unknown' WHEN c_custkey % 7 = 0 THEN 'missing' WHEN c_custkey % 11 = 0 THEN 'repeated' ELSE 'label' END AS fault FROM customer WHERE (c_custkey % 5 = 0 AND c_custkey % 7 <> 0) OR (c_custkey % 5 <> 0 AND (c_custkey % 7 = 0 OR c_custkey % 11 = 0 OR c_mktsegment = 'MACHINERY'))")
def judgment_validation(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    row = [k.alias("id"), F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("label")]
    answers = c.where(k % 7 != 0).select(*row).union(c.where((k % 7 != 0) & (k % 11 == 0)).select(*row))
    return S.judged(answers, c.where(k % 5 != 0).select(k.alias("id")), ("HOUSEHOLD", "AUTOMOBILE", "BUILDING", "FURNITURE"))


@query(f"WITH {_RATED}, d AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM r)) SELECT CASE WHEN i < n // 2 THEN 'early' ELSE 'late' END AS half, count(*) AS n, round(avg(rating), 6) AS mean FROM r JOIN d USING (day) GROUP BY 1")
def temporal_halves(spark, sf):
    return rounded(S.halves(_rated(spark, sf), "day").groupBy("half").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("mean")))


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 0) AS unknown_rows, 0::BIGINT AS split_days, 0::BIGINT AS days_out_of_order")
def fold_validation(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"))
    split = W.day_split(o, "day", "id").withColumn("split", F.when(F.col("id") % 10 != 0, F.col("split")))
    return S.fold_faults(split, "day", "split", ("train", "validation", "later"))


@query("""WITH t AS (SELECT o_orderkey AS id, o_custkey % 97 AS key, o_orderpriority || (o_custkey % 40) AS author, o_orderkey % 5 + 1 AS rating FROM orders WHERE o_orderkey % 2 = 1), x AS (SELECT *, author IN (SELECT o_orderpriority || (o_custkey % 40) FROM orders WHERE o_orderkey % 200 = 0) AS seen, key IN (SELECT c_custkey % 97 FROM customer WHERE c_acctbal > 9000) AS got, CASE WHEN rating >= 4 THEN 'high' WHEN rating <= 2 THEN 'low' END AS class FROM t)
    SELECT class, slice, count(*) AS targets, count(*) FILTER (got) AS retrieved, round(count(*) FILTER (got) / count(*), 6) AS recall FROM (SELECT *, unnest(CASE WHEN seen THEN ['all'] ELSE ['all', 'unseen_author'] END) AS slice FROM x WHERE class IS NOT NULL) GROUP BY class, slice""")
def coverage_recall(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    author = F.concat("o_orderpriority", (F.col("o_custkey") % 40).cast("string")).alias("author")
    t = o.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 97).alias("key"), author, (F.col("o_orderkey") % 5 + 1).alias("rating"))
    return rounded(S.coverage(t, c.where("c_acctbal > 9000").select((F.col("c_custkey") % 97).alias("key")), o.where("o_orderkey % 200 = 0").select(author)))


@query("""WITH v AS (SELECT p_partkey AS id, unnest(list_distinct([p_type, p_brand])) AS value FROM part), h AS (SELECT id, value, TRUE AS known FROM v WHERE value IN (SELECT value FROM v WHERE id % 100 = 0)) SELECT * FROM h UNION ALL SELECT p_partkey, NULL, FALSE FROM part WHERE p_partkey NOT IN (SELECT id FROM h)""")
def one_hot_labels(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array("p_type", "p_brand").alias("values"))
    return S.one_hot(p, "id", "values", F.col("id") % 100 == 0)


@query("""WITH t AS (SELECT p_type, p_size % 3 AS rich, avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2) SELECT p_partkey AS id, round((p_retailprice - m) / CASE WHEN coalesce(s, 0) < 1e-8 THEN 1 ELSE s END, 6) AS z FROM part LEFT JOIN t ON part.p_type = t.p_type AND p_size % 3 = rich""")
def stratum_scores(spark, sf):
    p = table(spark, sf, "part").withColumn("rich", F.col("p_size") % 3)
    return rounded(S.stratum_z(p, ["p_type", "rich"], "p_retailprice", F.col("p_partkey") % 2 == 0).select(F.col("p_partkey").alias("id"), "z"))


@query("""WITH w AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS ws FROM part),
    g AS (SELECT id, unnest(list_concat(list_transform(ws, lambda x: 'w:' || x), ['w:' || array_to_string(ws, ' ')], flatten(list_transform(ws, lambda x: flatten(list_transform([3, 4, 5], lambda n: list_transform(generate_series(1, greatest(len(x) + 3 - n, 1)), lambda i: 'c:' || substr(' ' || x || ' ', i, n)))))))) AS term FROM w),
    c AS (SELECT id, term, count(*) AS tf FROM g GROUP BY 1, 2), d AS (SELECT term, ln((1 + (SELECT count(*) FROM part WHERE p_partkey % 4 = 0)) / (1 + count(*))) + 1 AS idf FROM c WHERE id % 4 = 0 GROUP BY 1),
    x AS (SELECT id, term, tf * idf AS v FROM c JOIN d USING (term)), f AS (SELECT id, term, v / sqrt(sum(v * v) OVER (PARTITION BY id, term[1])) AS v FROM x) SELECT id, count(*) AS terms, round(sum(weight), 5) AS total FROM (SELECT id, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS weight FROM f) GROUP BY id""")
def tfidf_vectors(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name")
    return S.tfidf(p, "id", "p_name", F.col("id") % 4 == 0).groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 5).alias("total"))


@query()
def paired_bootstrap(spark, sf):
    e = events(spark, sf).where(F.col("event_type").isin("purchase", "error"))
    return S.paired_bootstrap(e.select("user_id", (F.col("event_type") == "purchase").cast("int").alias("label"), "value", (F.col("value") + F.col("event_id") % 7).alias("moved")), "user_id", "label", "value", "moved", 100)


@query()
def supervised_metric(spark, sf):
    """Cosine to the first training vector under the learnt metric, beside the plain one."""
    r = reads(spark, sf)
    d = S.metric_direction(r.where("id % 3 <> 0"), "vec", "rating")
    first = r.where("id = 2").select(S.stretched(F.col("vec"), d, 1.0).alias("b"), unit(F.col("vec").cast("array<double>")).alias("c"))
    return rounded(r.crossJoin(F.broadcast(first)).select("id", dot(S.stretched(F.col("vec"), d, 1.0), F.col("b")).alias("metric"), dot(unit(F.col("vec").cast("array<double>")), F.col("c")).alias("plain")))


@query(f"WITH {_RATED}, t AS (SELECT stddev_pop(current) AS sd FROM r) SELECT id, round(max(least(least(5, 0.25 * sd), greatest(-least(5, 0.25 * sd), candidate * 1.5 - current))), 6) AS correction FROM r CROSS JOIN t GROUP BY id")
def capped_residual(spark, sf):
    r = _rated(spark, sf)
    sd = r.agg(F.stddev_pop("current").alias("sd"))
    return rounded(r.crossJoin(F.broadcast(sd)).groupBy("id").agg(F.max(S.capped_residual(F.col("candidate") * 1.5, F.col("current"), F.col("sd"))).alias("correction")))


@query("SELECT CASE WHEN n < 20 THEN ['too few runs'] ELSE [] END || CASE WHEN m < 200 THEN ['too few impressions'] ELSE [] END || ['auc', 'precision'] AS reasons, FALSE AS promote FROM (SELECT count(DISTINCT user_id) AS n, count(*) AS m FROM events)")
def promotion_gate(spark, sf):
    e = table(spark, sf, "events").agg(F.count_distinct("user_id").alias("runs"), F.count(F.lit(1)).alias("impressions"))
    return evaluation.promotion(e.select("*", F.lit(0.005).alias("auc_delta"), F.lit(-0.1).alias("precision_delta"), F.lit(0.02).alias("ndcg_delta")))
