"""Queries of catalogue records beside items."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.operators.aggregates import register as register_aggregates
from quillrank.plans import records as R
from quillrank.queries.registry import IMPRESSIONS, events, impressions, query, rounded
from quillrank.session import table

_NOW = "2024-01-25 12:00:00"


@query("""WITH o AS (SELECT o_custkey AS id, o_orderkey, o_totalprice::DOUBLE AS price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1), e AS (SELECT user_id AS id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)
    SELECT c_custkey AS id, o_orderkey AS last_order, price, event_id AS first_event FROM customer LEFT JOIN o ON o.id = c_custkey LEFT JOIN e ON e.id = c_custkey""")
def side_lookups(spark, sf):
    """Customers with their last order and first event."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", "o_orderdate", F.col("o_totalprice").cast("double").alias("price"))
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), "event_id")
    met = R.attached(c, "id", order=(o, [F.col("o_orderdate").desc(), F.col("o_orderkey")]), event=(e, [F.col("event_id")]))
    return met.select("id", F.col("order.o_orderkey").alias("last_order"), F.col("order.price").alias("price"), F.col("event.event_id").alias("first_event"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 10 <> 0 AND p_partkey % 3 <> 0 AND p_partkey % 4 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 THEN concat('/works/OL', p_partkey, 'W') END AS verified_work FROM part")
def verified_works(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part")
    work = F.concat(F.lit("OL"), k.cast("string"), F.lit("W"))
    reads = p.select(k.alias("id"), F.sha2("p_name", 256).alias("identity_hash"), F.when(k % 11 == 0, "OL1W").when(k % 2 == 0, work).alias("work"))
    metadata = p.where(k % 10 != 0).select(k.alias("read_id"), F.sha2(F.when(k % 3 == 0, "x").otherwise(F.col("p_name")), 256).alias("identity_hash"), F.when(k % 4 == 0, "other").otherwise(" OpenLibrary ").alias("provider"), F.when(k % 7 == 0, "OL2W").otherwise(F.lower(work)).alias("provider_id"), F.concat(F.lit("/works/"), work).alias("work"))
    return R.verified_works(reads, metadata).select("id", "verified_work")


_NORMAL = "trim(regexp_replace(lower(concat(p_name, ' ', p_brand)), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH s AS (SELECT {_NORMAL} AS key, p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN concat('c', p_partkey) WHEN p_partkey % 3 = 0 THEN concat('q', p_partkey) ELSE '' END AS isbn FROM part WHERE p_partkey % 5 = 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY p_partkey DESC) = 1)
    SELECT p_partkey AS id, isbn AS known_isbn FROM part LEFT JOIN s ON s.key = {_NORMAL}""")
def known_isbns(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part")
    named = [k.alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author")]
    stored = p.where(k % 5 == 0)
    quality = stored.where(k % 3 == 0).select(k.alias("id"), F.concat(F.lit("q"), k.cast("string")).alias("isbn"))
    return R.known_isbns(p.select(*named), stored.select(*named, F.when(k % 2 == 0, F.concat(F.lit("c"), k.cast("string"))).otherwise("").alias("isbn")), quality).select("id", "known_isbn")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0 AND c_nationkey % 2 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0")
def eligible_population(spark, sf):
    """The candidates a scoring run would look at."""
    from quillrank.plans.chain import scorable

    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(k.alias("id"), F.col("c_nationkey").alias("source_id"), F.when(k % 3 == 0, "saved").otherwise("new").alias("status"), F.array(F.concat(F.lit("k"), k.cast("string"))).alias("keys"))
    sources = table(spark, sf, "nation").select(F.col("n_nationkey").alias("source_id"), (F.col("n_nationkey") % 2 == 0).alias("enabled"), F.lit(1.0).alias("source_weight"))
    quality = c.select("id", F.when(F.col("id") % 5 == 0, "pending").otherwise("accepted").alias("quality_status"), F.lit(0.0).alias("quality_score"))
    return scorable(c, sources, quality, c.where("id % 7 = 0").select("keys")).select("id")


@query("""WITH m AS (SELECT p_partkey AS id, (p_partkey % 101) / 100.0::DOUBLE AS t, (p_size % 21) / 20.0::DOUBLE AS a, length(p_name) AS n, p_partkey % 2 = 0 AS whole FROM part)
    SELECT id, round(CASE WHEN t >= 0.98 AND a >= 0.98 THEN 1 ELSE least(1, 0.65 * t + 0.35 * a) END, 4) AS confidence, round(CASE WHEN whole THEN 0.5 ELSE 0 END + 0.5 * least(1, n / 600.0::DOUBLE), 4) AS description FROM m""")
def match_confidence(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part")
    return p.select(k.alias("id"), R.match_confidence((k % 101) / F.lit(100.0), (F.col("p_size") % 21) / F.lit(20.0)).alias("confidence"), R.description_quality(F.col("p_name"), F.when(k % 2 == 0, "synopsis").otherwise("opening_sentence")).alias("description"))


@query(f"""WITH r AS (SELECT p_partkey AS id, p_partkey % 6 AS m, p_size AS days FROM part WHERE p_partkey % 5 <> 0) SELECT id FROM r WHERE m IN (0, 1) OR (m = 2) OR (m = 3 AND days >= 1) OR (m IN (4, 5) AND days >= 30)""")
def read_metadata_due(spark, sf):
    k = F.col("p_partkey")
    m = k % 6
    now = F.lit(_NOW).cast("timestamp")
    rows = table(spark, sf, "part").select(
        k.alias("id"), F.when(k % 5 == 0, "978").otherwise("9780306406157").alias("isbn"), F.when(m == 1, "OL1W").alias("work"), F.lit("/works/OL2W").alias("cached_work"), F.lit("h").alias("identity_hash"), F.when(m == 0, "g").otherwise("h").alias("cached_hash"),
        F.when(m != 2, now - F.make_dt_interval(F.col("p_size").cast("int"))).alias("checked_at"), F.lit("done").alias("attempt_status"), F.when(m == 3, F.array(F.lit("ok"), F.lit("timeout"))).alias("traces"))
    return R.metadata_due(rows, now).select("id")


@query("SELECT p_partkey AS id, p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AS allowed FROM part")
def description_upgrade(spark, sf):
    k = F.col("p_partkey")
    fetched = F.array(
        F.struct(F.lit("books").alias("provider"), F.lit("0").alias("provider_id"), F.lit("synopsis").alias("kind"), F.col("p_name").alias("opening_sentence")),
        F.struct(F.when(k % 3 == 0, "books").otherwise("library").alias("provider"), k.cast("string").alias("provider_id"), F.when(k % 5 == 0, "opening_sentence").otherwise("synopsis").alias("kind"), F.when(k % 7 == 0, "other").otherwise(F.col("p_name")).alias("opening_sentence")),
    )
    allowed = R.upgrade_allowed(F.when(k % 2 == 0, "opening_sentence").otherwise("synopsis"), F.col("p_name"), F.lit("library"), k.cast("string"), F.lit("synopsis"), F.when(k % 11 != 0, "A longer text."), fetched)
    return table(spark, sf, "part").select(k.alias("id"), allowed.alias("allowed"))


@query("""WITH e AS (SELECT event_id AS id, user_id AS candidate, event_type AS action, ts AS moment FROM events WHERE event_type <> 'view'), o AS (SELECT o_orderkey AS id, o_custkey AS candidate, 'save' AS action, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (o_orderkey % 40000) AS moment FROM orders WHERE o_orderkey NOT IN (SELECT id FROM e WHERE id % 2 = 0))
    SELECT id, candidate, action FROM (SELECT * FROM e UNION ALL SELECT id + 1000000000, candidate, action, moment FROM o) ORDER BY moment DESC, id DESC LIMIT 5000""")
def recent_events(spark, sf):
    k = F.col("event_id")
    key = F.when(k % 2 == 0, F.concat(F.lit("feedback:"), k.cast("string"))).otherwise(F.concat(F.lit("e"), k.cast("string")))
    e = events(spark, sf).where("event_type <> 'view'").select(k.alias("id"), key.alias("key"), F.col("user_id").alias("candidate"), F.col("event_type").alias("action"), F.col("ts").alias("at"))
    o = F.col("o_orderkey")
    legacy = table(spark, sf, "orders").select(o.cast("long").alias("id"), F.col("o_custkey").cast("long").alias("candidate"), F.lit("save").alias("action"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=(o % 40000).cast("int"))).alias("at"))
    return R.recent_events(e, legacy).select("id", "candidate", "action")


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal / 100 >= 90")
def high_confidence(spark, sf):
    return R.confident(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("score"))).select("id")


@query("""WITH s AS (SELECT user_id AS run, ts, event_id, CASE event_type WHEN 'signup' THEN 'begin' WHEN 'purchase' THEN 'finish' ELSE 'request' END AS step, event_type, value FROM events)
    SELECT run, max(CASE WHEN step = 'begin' THEN 'graph' END) AS provider, max(CASE WHEN step = 'begin' THEN event_id END) AS seeds, CASE WHEN count(*) FILTER (step = 'finish') > 0 THEN arg_max(CASE WHEN event_id % 2 = 0 THEN 'done' ELSE 'failed' END, ts) FILTER (step = 'finish') ELSE 'running' END AS status,
        coalesce(arg_max(event_id, ts) FILTER (step = 'finish'), 0) AS edges, arg_max(concat('e', event_id), ts) FILTER (step = 'finish') AS error, count(*) FILTER (step = 'request') AS requests, count(*) FILTER (step = 'request' AND event_type <> 'view') AS failed_requests FROM s GROUP BY run""")
def run_ledger(spark, sf):
    t, k = F.col("event_type"), F.col("event_id")
    step = F.when(t == "signup", "begin").when(t == "purchase", "finish").otherwise("request")
    status = F.when(step == "finish", F.when(k % 2 == 0, "done").otherwise("failed")).otherwise(F.when(t == "view", "ok").otherwise("error"))
    return R.run_ledger(events(spark, sf).select(F.col("user_id").alias("run"), F.col("ts").alias("at"), step.alias("step"), F.lit("graph").alias("provider"), k.alias("seeds"), status.alias("status"), k.alias("edges"), F.concat(F.lit("e"), k.cast("string")).alias("error")))


@query("SELECT doc_id, length(trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' ')) AS n FROM documents WHERE text IS NOT NULL AND text <> trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' ')")
def renormalized(spark, sf):
    """Only the texts that single spaces would change."""
    clean = F.btrim(F.regexp_replace("text", "[ \\t\\n\\x0b\\f\\r]+", " "), F.lit(" "))
    return R.rewritten(table(spark, sf, "documents"), "doc_id", text=clean).select("doc_id", F.length("text").alias("n"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 1900 + p_size WHEN p_partkey % 4 = 1 THEN 2000 + p_size END AS year, CASE WHEN p_partkey % 3 = 0 THEN -1.0 WHEN p_partkey % 3 = 1 THEN least(10, p_size) ELSE -1 END::DOUBLE AS number FROM part""")
def coerced_values(spark, sf):
    """Years and numbers from text: what is no whole, real, finite value is left out."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("int")
    year = F.when(k % 4 == 0, F.concat(F.lit(" "), (1900 + size).cast("string"))).when(k % 4 == 1, F.concat((2000 + size).cast("string"), F.lit("-02-03"))).when(k % 4 == 2, F.concat((2000 + size).cast("string"), F.lit("-13-01"))).otherwise("c. 1999")
    number = F.when(k % 3 == 0, "NaN").when(k % 3 == 1, F.concat(size.cast("string"), F.lit(" "))).otherwise("many")
    return table(spark, sf, "part").select(k.alias("id"), R.strict_year(year).alias("year"), R.number_or(number, -1.0, 0.0, 10.0).alias("number"))


@query(f"WITH {IMPRESSIONS}, w AS (SELECT event_type, label, score, 1 / propensity AS weight FROM impressions JOIN (SELECT event_id AS id, user_id % 3 AS event_type FROM events) USING (id) WHERE label IN (0, 1)), q AS (SELECT a.event_type, sum(a.weight * b.weight * CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / sum(a.weight * b.weight) AS auc FROM w a JOIN w b ON a.event_type = b.event_type AND a.label = 1 AND b.label = 0 GROUP BY 1) SELECT event_type AS part, round(auc, 6) AS auc FROM q")
def sql_weighted_auc(spark, sf):
    """The aggregate under its SQL name."""
    register_aggregates(spark)
    impressions(spark, sf).where("label in (0, 1)").withColumn("part", F.col("user_id") % 3).createOrReplaceTempView("quillrank_shown")
    return rounded(spark.sql("SELECT part, weighted_auc(label, score, 1 / propensity) AS auc FROM quillrank_shown GROUP BY part"))
