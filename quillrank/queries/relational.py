"""Eligibility, joins, merges, set operations and top-k queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillrank.functions.text import plain_part
from quillrank.operators import joins as J
from quillrank.operators import merge as M
from quillrank.operators import windows as W
from quillrank.queries.registry import events, query, rounded
from quillrank.session import table


@query("""SELECT c_custkey AS id, n_name AS source, CASE WHEN c_custkey % 7 > 0 THEN (c_custkey % 7) / 10.0::DOUBLE ELSE 0.85 END AS confidence FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') AND c_custkey % 3 <> 0""")
def eligibility_join(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    places = n.join(r, n["n_regionkey"] == r["r_regionkey"]).where(F.col("r_name").isin("ASIA", "EUROPE"))
    k = F.col("c_custkey")
    return c.where(k % 3 != 0).join(places, c["c_nationkey"] == places["n_nationkey"]).select(k.alias("id"), F.col("n_name").alias("source"), F.when(k % 7 > 0, (k % 7) / F.lit(10.0)).otherwise(0.85).alias("confidence"))


@query("SELECT s_suppkey AS id, CASE WHEN n_regionkey IS NULL OR n_regionkey = 1 OR coalesce(s_suppkey % 4, 0) = 0 THEN 'new' ELSE 'recommended' END AS status, CASE WHEN n_regionkey IS NULL OR n_regionkey = 1 OR s_suppkey % 4 = 0 THEN 0 ELSE s_suppkey % 100 END AS score FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def status_reset(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"], "left")
    stale = F.col("n_regionkey").isNull() | (F.col("n_regionkey") == 1) | (F.col("s_suppkey") % 4 == 0)
    return j.select(F.col("s_suppkey").alias("id"), F.when(stale, "new").otherwise("recommended").alias("status"), F.when(stale, 0).otherwise(F.col("s_suppkey") % 100).alias("score"))


@query("WITH l AS (SELECT user_id, max(ts) AS last, max(ts) FILTER (event_type = 'error') AS bad FROM events GROUP BY user_id) SELECT user_id FROM l WHERE last < TIMESTAMP '2024-01-30' OR bad >= last OR bad IS NULL")
def source_due(spark, sf):
    g = events(spark, sf).groupBy("user_id").agg(F.max("ts").alias("last"), F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("bad"))
    return g.where((F.col("last") < F.lit("2024-01-30").cast("timestamp")) | (F.col("bad") >= F.col("last")) | F.col("bad").isNull()).select("user_id")


@query("SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_exists(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    c = table(spark, sf, "customer")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select(F.col("c_custkey").alias("id"))


@query("SELECT p_partkey AS id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_discount > 0.09)")
def orphan_antijoin(spark, sf):
    p, l = table(spark, sf, "part"), table(spark, sf, "lineitem")
    out = p
    for when in ("l_quantity > 45", "l_returnflag = 'R' and l_discount > 0.09"):
        out = out.join(l.where(when).select("l_partkey"), out["p_partkey"] == F.col("l_partkey"), "left_anti")
    return out.select(F.col("p_partkey").alias("id"))


@query("SELECT id, source FROM (SELECT event_id AS id, 'event' AS source FROM events WHERE event_type = 'purchase' UNION ALL SELECT 1000000000 + o_orderkey, 'legacy' FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase'))")
def legacy_union_events(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("id"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("id"))
    return e.withColumn("source", F.lit("event")).unionByName(o.join(e, "id", "left_anti").select((F.col("id") + 1_000_000_000).alias("id"), F.lit("legacy").alias("source")))


_PARTS = "k AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS title, concat('size', p_size) AS code, p_size AS size FROM part)"


def _parts(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), plain_part(F.col("p_name")).alias("title"), F.concat(F.lit("size"), F.col("p_size").cast("string")).alias("code"), F.col("p_size").alias("size"))


@query(f"WITH {_PARTS}, known AS (SELECT * FROM k WHERE id % 10 = 0) SELECT id FROM k WHERE id % 10 <> 0 AND title NOT IN (SELECT title FROM known) AND concat(code, id % 50) NOT IN (SELECT concat(code, id % 50) FROM known)")
def identity_antijoin(spark, sf):
    k = _parts(spark, sf).select("id", F.array("title", F.concat("code", (F.col("id") % 50).cast("string"))).alias("keys"))
    return J.without_known(k.where("id % 10 <> 0"), k.where("id % 10 = 0")).select("id")


@query(f"WITH {_PARTS} SELECT title, min(id) AS id, count(*) AS n FROM k GROUP BY title")
def identity_dedup_first(spark, sf):
    return _parts(spark, sf).groupBy("title").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))


# Row by row in SQL too: every block takes its next item in each step.
@query(f"""WITH RECURSIVE {_PARTS}, o AS (SELECT id, size AS block, [concat(size, ':', title), concat(size, ':m', id % 17)] AS keys, row_number() OVER (PARTITION BY size ORDER BY id) AS n FROM k),
    r AS (SELECT block, n, id, TRUE AS stays, keys AS seen FROM o WHERE n = 1 UNION ALL SELECT o.block, o.n, o.id, NOT list_has_any(o.keys, r.seen), CASE WHEN list_has_any(o.keys, r.seen) THEN r.seen ELSE list_concat(r.seen, o.keys) END FROM r JOIN o ON o.block = r.block AND o.n = r.n + 1)
    SELECT id, block FROM r WHERE stays""")
def greedy_identity_dedup(spark, sf):
    key = lambda x: F.concat(F.col("size").cast("string"), F.lit(":"), x)
    k = _parts(spark, sf).select("id", F.col("size").alias("block"), F.array(key(F.col("title")), key(F.concat(F.lit("m"), (F.col("id") % 17).cast("string")))).alias("keys"))
    return J.greedy_rounds(k, "id", []).select("id", "block")


@query(f"WITH {_PARTS}, t AS (SELECT id AS target, concat('m', id % 397) AS key, 2 AS method FROM k WHERE id % 5 = 0 UNION ALL SELECT id, concat('t', id % 991), 1 FROM k WHERE id % 5 = 0), i AS (SELECT id, concat('m', id % 397) AS key FROM k WHERE id % 5 = 1 UNION ALL SELECT id, concat('t', id % 991) FROM k WHERE id % 5 = 1) SELECT id, CAST(min(target) AS BIGINT) AS target, min(method) AS method FROM i JOIN t USING (key) GROUP BY id HAVING count(DISTINCT target) = 1")
def unambiguous_target(spark, sf):
    k = _parts(spark, sf)
    mod, other = (F.concat(F.lit(c), (F.col("id") % n).cast("string")) for c, n in (("m", 397), ("t", 991)))
    t = k.where("id % 5 = 0").select(F.col("id").cast("long").alias("target"), mod.alias("key"), F.lit(2).alias("method")).unionByName(k.where("id % 5 = 0").select(F.col("id").cast("long").alias("target"), other.alias("key"), F.lit(1).alias("method")))
    i = k.where("id % 5 = 1").select("id", mod.alias("key")).unionByName(k.where("id % 5 = 1").select("id", other.alias("key")))
    return J.unambiguous(i, t, "id", "target", "key", "method")


@query("""WITH o AS (SELECT o_orderkey AS id, o_totalprice::DOUBLE AS price, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 4 <> 0),
    n AS (SELECT o_orderkey AS id, o_totalprice::DOUBLE + 1 AS price, o_orderpriority AS status FROM orders WHERE o_orderkey % 2 = 0)
    SELECT coalesce(o.id, n.id) AS id, coalesce(n.price, o.price) AS price, coalesce(o.status, n.status) AS status FROM o FULL JOIN n ON o.id = n.id""")
def merge_upsert(spark, sf):
    t = table(spark, sf, "orders")
    old = t.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("price"), F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(F.col("o_orderstatus")).alias("status"))
    new = t.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice").cast("double") + 1).alias("price"), F.col("o_orderpriority").alias("status"), F.lit(1).alias("at"))
    return M.upsert(old, new, "id", "at", {"status": "fill"})


@query("SELECT o_orderkey AS id FROM orders o WHERE NOT (o_orderstatus IN ('O', 'P') AND o_custkey % 5 <> 0 AND o_orderkey % 3 = 0)")
def delete_missing(spark, sf):
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 5).alias("source"))
    scanned = t.where("source <> 0 and id % 3 <> 0").select("id", "source")
    return M.delete_missing(t, scanned, "id", "source", ["O", "P"]).select("id")


@query("SELECT user_id AS key, count(DISTINCT event_type) AS versions FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def event_conflicts(spark, sf):
    return M.conflicts(table(spark, sf, "events"), "user_id", "event_type").withColumnRenamed("user_id", "key")


@query("SELECT event_id AS id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS INT) AS revision FROM events")
def event_revisions(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).alias("revision"))


@query("""WITH r AS (SELECT vec_id AS id, label AS author, 1 + label % 5 AS rating, vec_id // 2 AS work FROM embeddings), w AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY work ORDER BY rating DESC, id) = 1),
    a AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY author ORDER BY rating DESC, id) <= 2) SELECT id FROM a ORDER BY rating DESC, id LIMIT 25""")
def seed_selection(spark, sf):
    r = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("author"), (1 + F.col("label") % 5).alias("rating"), F.floor(F.col("vec_id") / 2).alias("work"))
    return W.seeds(r, "work", "author", [F.col("rating").desc(), F.col("id")]).select("id")


@query("SELECT p_partkey AS id, p_size AS size FROM part QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY sha256(concat('20261002:', p_partkey)), p_partkey) <= 10")
def hash_stratified_sample(spark, sf):
    return W.hash_sample(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size")), "size", "id", 10)


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def latest_turn(spark, sf):
    return W.first_per(table(spark, sf, "conversations"), ["conv_id"], [F.col("turn").desc()]).select("conv_id", "turn", "role")


@query("SELECT user_id, CAST(floor(date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) / 30.0) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def thirty_day_groups(spark, sf):
    e = events(spark, sf)
    start = e.agg(F.min(F.to_date("ts")).alias("d0"))
    return e.crossJoin(F.broadcast(start)).groupBy("user_id", F.floor(F.datediff(F.to_date("ts"), "d0") / 30).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id AS id, coalesce(min(CAST(ts AS DATE)) OVER (PARTITION BY user_id) < CAST(ts AS DATE), false) AS seen FROM events")
def author_seen_before(spark, sf):
    day = F.to_date("ts")
    return events(spark, sf).select(F.col("event_id").alias("id"), (F.min(day).over(Window.partitionBy("user_id")) < day).alias("seen"))


@query("SELECT c_custkey AS id FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 12 OFFSET 24")
def recent_page(spark, sf):
    return table(spark, sf, "customer").orderBy(F.col("c_acctbal").desc(), F.col("c_custkey").desc()).offset(24).limit(12).select(F.col("c_custkey").alias("id"))


@query("WITH t AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) SELECT id, (SELECT count(*) > 20 FROM customer) AS has_more FROM t WHERE n <= 20")
def has_more_probe(spark, sf):
    page = table(spark, sf, "customer").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(21)
    n = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("c_acctbal").desc(), "c_custkey"))
    return page.withColumn("n", n).withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) > 20).where("n <= 20").select(F.col("c_custkey").alias("id"), "has_more")


@query("SELECT list_sort(list(DISTINCT n_name)) AS names FROM nation")
def distinct_sorted_labels(spark, sf):
    return table(spark, sf, "nation").agg(F.array_sort(F.collect_set("n_name")).alias("names"))


@query("WITH a AS (SELECT l_partkey AS id, round(sum(l_quantity)::DOUBLE, 2) AS best FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1), b AS (SELECT l_partkey AS id, round(sum(l_quantity)::DOUBLE, 2) AS best FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) (SELECT 'gone' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) UNION ALL (SELECT 'new', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))")
def symmetric_difference(spark, sf):
    l = table(spark, sf, "lineitem")
    g = lambda when: l.where(when).groupBy(F.col("l_partkey").alias("id")).agg(F.round(F.sum("l_quantity").cast("double"), 2).alias("best"))
    a, b = g("l_returnflag = 'N'"), g("l_linestatus = 'O'")
    return a.exceptAll(b).select(F.lit("gone").alias("side"), "*").unionByName(b.exceptAll(a).select(F.lit("new").alias("side"), "*"))


@query("SELECT l_orderkey AS id, arg_max(l_partkey, struct_pack(q := l_quantity, n := l_linenumber, p := l_partkey)) AS best_part, max(l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY l_orderkey")
def best_record_per_key(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id"))
    return g.agg(F.max_by("l_partkey", F.struct("l_quantity", "l_linenumber", "l_partkey")).alias("best_part"), F.max("l_quantity").cast("double").alias("quantity"))


@query("WITH e AS (SELECT user_id, ts FROM events WHERE event_type = 'error'), r AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') SELECT event_id AS id, (SELECT count(*) FROM e WHERE e.user_id = r.user_id AND e.ts < r.ts) AS prior FROM r")
def prior_event_count(spark, sf):
    """Counting earlier events is one running sum over the union, not a range join."""
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    e = events(spark, sf).where("event_type in ('purchase', 'error')")
    peers = F.count_if(F.col("event_type") == "error").over(Window.partitionBy("user_id", "ts"))
    return e.withColumn("prior", F.count_if(F.col("event_type") == "error").over(w) - peers).where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "prior")


@query("SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS large, round(sum(o_totalprice)::DOUBLE, 2) AS total FROM orders GROUP BY 1")
def quality_summary(spark, sf):
    g = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("large"), F.round(F.sum("o_totalprice").cast("double"), 2).alias("total"))


@query("SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def table_counts(spark, sf):
    count = lambda t: table(spark, sf, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n"))
    return count("customer").unionByName(count("orders")).unionByName(count("events"))


@query("SELECT round(avg(l_quantity)::DOUBLE, 9) AS mean, round(stddev_pop(l_quantity)::DOUBLE, 9) AS scale FROM lineitem WHERE l_orderkey % 2 = 0")
def train_standardize(spark, sf):
    t = table(spark, sf, "lineitem").where("l_orderkey % 2 = 0")
    return rounded(t.agg(F.avg("l_quantity").cast("double").alias("mean"), F.stddev_pop("l_quantity").alias("scale")), 9)
