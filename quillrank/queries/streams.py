"""Streaming queries, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillrank.queries.registry import query
from quillrank.session import shared_dir, table
from quillrank.streaming import budgets as B
from quillrank.streaming import events as S


def _run(spark, sf, make, mode):
    schema = table(spark, sf, "events").schema
    name = "s" + uuid.uuid4().hex
    # A file source reads a folder; the glob makes one of the single file.
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    df = make(source.withColumn("ts", F.col("ts").cast("timestamp")))
    return S.run_to_end(df, name, f"{shared_dir(spark).rstrip('/')}/{name}", mode)


@query("SELECT user_id, min(ts) AS visible_at FROM events WHERE event_type = 'view' GROUP BY user_id")
def stream_first_visible(spark, sf):
    out = _run(spark, sf, lambda e: S.first_visible(e.where("event_type = 'view'"), ["user_id"]), "complete")
    return out.select("user_id", F.col("visible_at").cast("timestamp_ntz").alias("visible_at"))


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, sf):
    out = _run(spark, sf, lambda e: e.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n")), "complete")
    return out.select(F.to_date("window.start").alias("day"), "event_type", "n")


@query("SELECT count(DISTINCT event_id) AS n FROM events")
def stream_dedup(spark, sf):
    # Every id is state for sixty days: it is kept outside the heap.
    found = B.with_rocks(spark, lambda: _run(spark, sf, lambda e: S.once(e.select("event_id", "ts"), "event_id", "ts", "60 days"), "append"))
    return found.agg(F.count(F.lit(1)).alias("n"))


@query()
def stream_decisions(spark, sf):
    def make(e):
        action = F.when(F.col("event_type") == "error", "undo").otherwise(F.col("event_type"))
        return S.decisions(e.select(F.col("user_id").alias("book"), "ts", action.alias("action")))

    return _run(spark, sf, make, "update")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT user_id, event_id AS id, n, true AS allowed, '' AS reason, us AS last, us // 86400000000 AS win, 1 AS used FROM e WHERE n = 1
        UNION ALL SELECT user_id, id, n, why = '', why, CASE WHEN why = '' THEN us ELSE last END, CASE WHEN why = '' THEN mine ELSE win END, CASE WHEN why = '' THEN spent + 1 ELSE used END
        FROM (SELECT e.user_id, e.event_id AS id, e.n, e.us, r.last, r.win, r.used, e.us // 86400000000 AS mine, CASE WHEN e.us // 86400000000 = r.win THEN r.used ELSE 0 END AS spent,
            CASE WHEN e.us - r.last < 7200000000 THEN 'interval' WHEN e.us // 86400000000 = r.win AND r.used >= 2 THEN 'budget' ELSE '' END AS why FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
    SELECT user_id, id, allowed, reason FROM r""")
def request_budgets(spark, sf):
    """Events as requests of their users: two hours apart at least, two a day at most."""
    make = lambda e: B.budgets(e.select("user_id", F.col("event_id").alias("id"), "ts"), "user_id", 7200, 86400, 2, "60 days")
    return B.with_rocks(spark, lambda: _run(spark, sf, make, "append"))
