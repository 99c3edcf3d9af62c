"""Queries of due work, deliveries, caches, outcomes and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.functions.dates import iso_week
from quillrank.operators import ledgers as L
from quillrank.queries.registry import events, query
from quillrank.session import table

_NOW = "2024-01-25 12:00:00"


def _now():
    return F.lit(_NOW).cast("timestamp")


@query(f"""WITH r AS (SELECT p_partkey AS id, p_partkey % 8 AS m, TIMESTAMP '{_NOW}' - INTERVAL 1 DAY * (p_size % 40) AS checked, p_partkey % 11 = 0 AS old FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 10 <> 0)
    SELECT id FROM r WHERE (old OR m <= 4) AND (old OR m = 7 OR checked <= TIMESTAMP '{_NOW}' - INTERVAL 1 DAY * CASE WHEN m IN (0, 1) THEN 7 ELSE 30 END)""")
def metadata_refresh_due(spark, sf):
    k = F.col("p_partkey")
    m = k % 8
    rows = table(spark, sf, "part").select(
        k.alias("id"), F.when(k % 9 == 0, "rejected").otherwise("new").alias("status"), F.when(k % 10 == 0, "pending").otherwise("accepted").alias("quality"), F.when(k % 11 == 0, 1).otherwise(2).alias("metadata_version"),
        F.when(m != 7, _now() - F.make_dt_interval(F.col("p_size") % 40)).alias("checked_at"), F.when(m == 0, "").when(m == 1, "https://placehold.co/2").otherwise("https://books.google.com/c").alias("cover"),
        F.when(m == 2, "").otherwise("about").alias("description"), F.when(m != 3, "2001").alias("released"), F.when(m == 4, 0).otherwise(2).alias("genre_count"), F.col("p_retailprice").alias("score"))
    return L.refresh_due(rows, _now(), 2).select("id")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 5 = 0 OR (p_partkey % 3 = 0 AND p_partkey % 2 = 0) OR (p_partkey % 13 = 0 AND p_size % 3 >= 1)")
def quality_audit_due(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(
        k.alias("id"), F.when(k % 7 == 0, "pending").otherwise("quarantine").alias("quality"), F.when(k % 5 == 0, None).when(k % 3 == 0, 1).otherwise(2).alias("audit_version"), F.when(k % 2 == 0, "9780306406157").otherwise("").alias("isbn"),
        F.when(k % 13 == 0, F.array(F.lit("catalog_provider_unavailable"))).alias("flags"), (_now() - F.make_dt_interval(F.col("p_size") % 3)).alias("checked_at"))
    return L.audit_due(rows, _now(), 2).select("id")


@query("""WITH c AS (SELECT c_custkey AS owner, unnest(['mail', 'chat']) AS channel FROM customer WHERE c_custkey % 7 = 3 AND (c_custkey % 24) * 60 <= 720 AND c_custkey % 5 <> 0),
    o AS (SELECT owner, channel, CASE WHEN channel = 'chat' AND owner % 4 = 0 THEN 'sent' WHEN channel = 'chat' AND owner % 4 = 1 THEN 'failed' END AS status, owner % 5 AS tries, owner % 3 = 0 AS fresh FROM c)
    SELECT owner, '2024-W04' AS period, list_sort(list(channel)) AS channels FROM o WHERE coalesce(status, '') <> 'sent' AND NOT (status IS NOT NULL AND tries >= 3) GROUP BY owner HAVING NOT bool_or(coalesce(status = 'failed', FALSE) AND fresh)""")
def digest_due(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    week = iso_week(_now())
    configs = c.select(k.alias("owner"), (k % 7 + 1).alias("day"), ((k % 24) * 60).alias("minute"), F.when(k % 5 == 0, week).alias("last_period"), F.array(F.lit("mail"), F.lit("chat")).alias("channels"))
    tries = c.where(k % 4 <= 1).select(k.alias("owner"), week.alias("period"), F.lit("chat").alias("channel"), F.when(k % 4 == 0, "sent").otherwise("failed").alias("status"), (k % 5).alias("attempts"), (_now() - F.make_dt_interval(mins=F.when(k % 3 == 0, 5).otherwise(60))).alias("updated_at"))
    return L.digest_due(configs, tries, _now())


@query("""WITH b AS (SELECT user_id AS period, event_type AS channel, CASE WHEN event_id % 3 = 0 THEN 'sent' ELSE 'failed' END AS status, ts, event_id FROM events) SELECT period, channel, arg_max(status, ts) AS status, count(*) AS attempts, max(ts) AS updated_at FROM b GROUP BY period, channel""")
def delivery_ledger(spark, sf):
    e = events(spark, sf).select("event_id", F.col("user_id").alias("period"), F.col("event_type").alias("channel"), F.when(F.col("event_id") % 3 == 0, "sent").otherwise("failed").alias("status"), F.lit(1).alias("attempts"), F.col("ts").alias("updated_at"))
    return L.delivered(e.where("event_id < 5000").drop("event_id"), e.where("event_id >= 5000").drop("event_id"))


@query("""WITH f AS (SELECT o_orderpriority AS period, -epoch_us(o_orderdate) AS c, unnest([o_custkey, o_orderkey % 40]) AS id, unnest([0, 1]) AS p FROM orders), g AS (SELECT period, id, min((c, p)) AS o FROM f GROUP BY 1, 2) SELECT period, list(id ORDER BY o, id) AS ids FROM g GROUP BY period""")
def digest_review(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("period"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.to_json(F.array(F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 40).cast("string"))).alias("ids"))
    return L.reviewed(o)


@query(f"SELECT event_id AS key FROM events WHERE ts + INTERVAL 1 DAY * (event_id % 20) > TIMESTAMP '{_NOW}' QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 512")
def cache_eviction(spark, sf):
    e = events(spark, sf).select(F.col("event_type").alias("provider"), F.col("event_id").alias("key"), F.col("ts").alias("created_at"), (F.col("ts") + F.make_dt_interval((F.col("event_id") % 20).cast("int"))).alias("expires_at"))
    return L.live_cache(e, _now(), 512).select("key")


@query("""SELECT change, count(*) AS n, sum(label)::DOUBLE AS label FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'created' WHEN event_id % 3 = 1 OR event_id % 5 = 0 THEN 'unchanged' ELSE 'updated' END AS change, CASE WHEN event_id % 3 = 2 AND event_id % 5 <> 0 THEN 1.0 WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.5 END AS label FROM events) GROUP BY change""")
def outcome_upsert(spark, sf):
    """Of three events one is new, one is only stored, and one was seen again, mostly with a later rating."""
    e, k = table(spark, sf, "events"), F.col("event_id")
    row = lambda label: [k.alias("impression"), (k + 1).alias("event"), label.alias("label"), F.lit(None).cast("string").alias("note")]
    stored = e.where(k % 3 != 0).select(*row(F.lit(0.5)))
    seen = e.where(k % 3 != 1).select(*row(F.when((k % 3 == 2) & (k % 5 == 0), 0.5).otherwise(1.0)))
    return L.outcome_changes(stored, seen, ["impression", "event"], ["label", "note"]).groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("label"))


@query("""SELECT o_orderkey AS id, first(l_discount ORDER BY l_quantity DESC, l_shipdate DESC, l_discount DESC) FILTER (l_orderkey IS NOT NULL) AS label, count(l_orderkey) AS outcomes FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def best_outcome(spark, sf):
    i = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    o = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("impression"), F.col("l_discount").alias("label"), F.col("l_quantity").alias("confidence"), F.col("l_shipdate").alias("attributed_at"))
    return L.best_outcome(i, o).select("id", F.col("best.label").alias("label"), F.coalesce(F.size("outcomes"), F.lit(0)).cast("long").alias("outcomes"))


@query("""WITH s AS (SELECT c_nationkey AS batch, CASE WHEN c_custkey % 5 = 0 THEN 'unlinked' WHEN c_nationkey % 6 = 0 THEN 'incomplete' WHEN c_custkey % 7 = 0 THEN 'score_changed' WHEN c_custkey % 11 = 0 THEN 'stale_input' ELSE 'replayable' END AS state FROM customer)
    SELECT batch, count(*) AS n, count(*) FILTER (state = 'replayable') AS good, CASE WHEN count(*) FILTER (state = 'replayable') = count(*) THEN 'complete' WHEN count(*) FILTER (state = 'replayable') > 0 THEN 'partial' ELSE 'incomplete' END AS status FROM s GROUP BY batch""")
def score_lineage(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    items = c.select(k.alias("id"), F.col("c_nationkey").alias("batch"), F.col("c_acctbal").alias("score"), F.sha2("c_name", 256).alias("content_hash"))
    links = c.where(k % 5 != 0).select(k.alias("id"), F.col("c_nationkey").alias("batch"), F.when(F.col("c_nationkey") % 6 == 0, "partial").otherwise("complete").alias("capture"), (F.col("c_acctbal") + F.when(k % 7 == 0, 1.0).otherwise(0.0)).alias("score"), F.sha2(F.when(k % 11 == 0, "x").otherwise(F.col("c_name")), 256).alias("content_hash"))
    return L.lineage_rollup(L.lineage(items, links), "batch")


@query("SELECT event_id AS id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 300 UNION SELECT c_custkey FROM customer WHERE c_nationkey = 3 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 499000)")
def purge_runs(spark, sf):
    e = table(spark, sf, "events")
    c, o = (table(spark, sf, t) for t in ("customer", "orders"))
    return L.purged(e, "user_id", e.where("value > 300"), c.where("c_nationkey = 3").select(F.col("c_custkey").alias("user_id")), o.where("o_totalprice > 499000").select(F.col("o_custkey").alias("user_id"))).select(F.col("event_id").alias("id"))


@query("""WITH r AS (SELECT event_id AS id, user_id AS key, ts AS created FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS candidate, ts AS run_at, event_id % 20 + 1 AS rank, value AS score, event_id FROM events WHERE event_type = 'view'),
    m AS (SELECT r.id, s.* FROM r JOIN s USING (key) WHERE s.run_at < r.created QUALIFY row_number() OVER (PARTITION BY r.id, candidate ORDER BY run_at DESC, rank) = 1) SELECT id, min(rank) AS rank, first(score ORDER BY rank, candidate) AS score FROM m GROUP BY id""")
def preread_rank(spark, sf):
    e = events(spark, sf)
    reads = e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("ts").alias("created"))
    shown = e.where("event_type = 'view'").select(F.col("user_id").alias("key"), (F.get_json_object("props", "$.k").cast("long") % 3).alias("candidate"), F.col("ts").alias("run_at"), (F.col("event_id") % 20 + 1).alias("rank"), F.col("value").alias("score"))
    return L.shown_before(reads, shown)


@query("""WITH l AS (SELECT user_id AS query, max(event_id) AS e FROM events GROUP BY 1) SELECT query, [concat('a', e), concat('b', e)] AS records FROM l""")
def search_frames(spark, sf):
    k = F.col("event_id").cast("string")
    frames = table(spark, sf, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("seq"), F.to_json(F.array(F.concat(F.lit("a"), k), F.repeat(F.lit("x"), F.lit(25_001)), F.concat(F.lit("b"), k))).alias("payload"))
    return L.latest_frame(frames)


@query(f"""WITH j AS (SELECT event_id AS id, user_id AS kind, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' ELSE 'done' END AS state, event_id % 50 <> 0 OR ts < TIMESTAMP '{_NOW}' - INTERVAL 5 MINUTE AS lost, event_id % 5 AS tries FROM events)
    SELECT kind, min(id) AS id FROM j WHERE (state = 'queued' OR (state = 'running' AND lost AND tries < 3)) AND kind NOT IN (SELECT kind FROM j WHERE state = 'running' AND NOT lost) GROUP BY kind""")
def job_claims(spark, sf):
    t = F.col("event_type")
    jobs = events(spark, sf).select(F.col("event_id").alias("id"), F.col("user_id").alias("kind"), F.when(t == "view", "queued").when(t == "click", "running").otherwise("done").alias("state"), F.when(F.col("event_id") % 50 == 0, F.col("ts")).alias("heartbeat"), (F.col("event_id") % 5).alias("tries"))
    return L.open_jobs(jobs, _now()).select("kind", "id")
