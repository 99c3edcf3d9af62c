"""Queries of whole jobs: the serving chain, its ablations, scoring of a catalogue, the transition to read, feedback against history."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.plans import chain, serving
from quillrank.queries.learning import _DAYS, _EFFECTS, _FEATURES, _LATEST, _days, _deltas, _features, _observed
from quillrank.queries.ranking import _full
from quillrank.queries.registry import candidates, events, query, reads, rounded
from quillrank.session import table


def _page_sql(learn: bool = True, fatigue: bool = True) -> str:
    move = "coalesce(0.9 * d, 0)" if learn else "0"
    wear = "least(3.0, greatest(0, (coalesce(days, 0) - 1) * 0.5))" if fatigue else "0"
    again = "other, p1.score DESC, pos" if learn else "pos"
    return f"""p0 AS (SELECT *, CAST(status <> 'recommended' AS INT) AS other, row_number() OVER (PARTITION BY run ORDER BY status <> 'recommended', score DESC, id DESC) AS pos FROM items),
    p1 AS (SELECT p0.* EXCLUDE (score), CASE WHEN abs({move}) >= 0.05 THEN round(least(100, greatest(0, score + {move})), 1) ELSE score END AS score FROM p0 LEFT JOIN moves USING (id)),
    p2 AS (SELECT * EXCLUDE (pos), row_number() OVER (PARTITION BY run ORDER BY {again}) AS pos FROM p1),
    p3 AS (SELECT p2.* EXCLUDE (score), greatest(0, score - {wear}) AS score, max({wear} > 0) OVER (PARTITION BY run) AS worn FROM p2 LEFT JOIN d ON d.id = p2.id),
    p4 AS (SELECT * EXCLUDE (pos), row_number() OVER (PARTITION BY run ORDER BY CASE WHEN worn THEN other ELSE 0 END, CASE WHEN worn THEN -p3.score ELSE pos END, pos) AS pos FROM p3),
    p5 AS (SELECT *, status = 'recommended' AND pos <= 24 AS top, CASE WHEN status = 'recommended' AND pos <= 24 THEN score + greatest(-1.2, least(1.2, (id % 7 - 3)::DOUBLE)) ELSE score END AS lifted FROM p4),
    p6 AS (SELECT * EXCLUDE (score, pos), lifted AS score, row_number() OVER (PARTITION BY run ORDER BY other, NOT top, CASE WHEN top THEN -lifted ELSE pos END, id DESC) AS pos FROM p5),
    p7 AS (SELECT *, row_number() OVER (PARTITION BY run, status ORDER BY pos) AS nth FROM p6),
    p8 AS (SELECT run, id, status, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY run ORDER BY other, pos) AS INT) AS position, 1.0::DOUBLE AS propensity FROM p7 WHERE (status = 'recommended' AND nth <= 24) OR status IN ('saved', 'imported', 'new'))"""


_ITEMS = """items AS (SELECT c_custkey % 5 AS run, c_custkey AS id, ['recommended', 'recommended', 'saved', 'new'][c_custkey % 4 + 1] AS status, CAST(50 + c_custkey % 50 AS DOUBLE) AS score FROM customer),
    itf AS (SELECT id, unnest([concat('author:a', id % 3), concat('subject:s', id % 5), CASE WHEN id % 4 = 0 THEN 'era:2020_plus' ELSE concat('era:', id % 2) END]) AS feature FROM items)"""


def _inputs(spark, sf):
    obs = _observed(spark, sf)
    effects = serving.feature_effects(obs, _features(obs))
    k = F.col("c_custkey")
    status = F.get(F.array(*[F.lit(s) for s in ("recommended", "recommended", "saved", "new")]), (k % 4).cast("int"))
    vec = F.array(*[F.sin(k * n).cast("double") for n in (1.0, 2.0, 3.0)])
    items = table(spark, sf, "customer").select((k % 5).alias("run"), k.alias("id"), status.alias("status"), (50 + k % 50).cast("double").alias("score"), F.lit(0.9).alias("confidence"), F.concat(F.lit("a"), (k % 3).cast("string")).alias("author"), vec.alias("vec"))
    features = _features(items.select(F.col("id").alias("book"))).withColumnRenamed("book", "id")
    deltas = items.select("id", (F.col("id") % 7 - 3).cast("double").alias("delta"))
    return items, effects, features, _days(spark, sf), deltas


_WORN = (1, 0.5, 3.0)


@query(_LATEST + f", {_FEATURES}, {_EFFECTS}, {_ITEMS}, {_deltas('itf')}, {_DAYS}, {_page_sql()} SELECT * FROM p8")
def served_page(spark, sf):
    """From events to pages, without the steps that are drawn or search: learned, worn, lifted from outside, cut."""
    items, effects, features, days, deltas = _inputs(spark, sf)
    return rounded(chain.served(items, effects, features, days, deltas=deltas, head=24, slate=False, fatigue_of=_WORN))


@query(" UNION ALL ".join(f"SELECT * FROM ({_LATEST}, {_FEATURES}, {_EFFECTS}, {_ITEMS}, {_deltas('itf')}, {_DAYS}, {_page_sql(**how)} SELECT *, '{arm}' AS arm FROM p8)" for arm, how in (("all", {}), ("no_learning", {"learn": False}), ("no_fatigue", {"fatigue": False}))))
def served_arms(spark, sf):
    """The chain with one step left out at a time."""
    items, effects, features, days, deltas = _inputs(spark, sf)
    arms = {"all": {}, "no_learning": {"learn": False}, "no_fatigue": {"fatigue": False}}
    return rounded(chain.ablated(items, effects, features, days, deltas=deltas, head=24, slate=False, fatigue_of=_WORN, arms=arms))


@query()
def served_slate(spark, sf):
    """The whole chain with slate and exploration, which SQL cannot say; the tests run it by brute force."""
    items, effects, features, days, deltas = _inputs(spark, sf)
    return rounded(chain.served(items, effects, features, days, deltas=deltas, head=24, epsilon=0.3, seed=11, fatigue_of=_WORN))


@query(f"""WITH ranked AS ({_full(False)}), c AS (SELECT vec_id AS id, label AS source, CASE WHEN vec_id % 7 = 0 THEN 'saved' WHEN vec_id % 3 = 0 THEN 'recommended' ELSE 'new' END AS status, vec_id % 5 <> 1 AS accepted, label % 4 <> 0 AS enabled FROM embeddings WHERE vec_id % 2 = 1),
    e AS (SELECT * FROM c WHERE status <> 'saved' AND accepted AND enabled AND id % 9 <> 0)
    SELECT id, CASE WHEN id % 11 = 0 THEN 'hidden' ELSE 'recommended' END AS status, CASE WHEN id % 11 = 0 THEN 0 WHEN id % 13 = 0 THEN round(least(100, score + 10), 1) ELSE score END AS score FROM e JOIN ranked USING (id)
    UNION ALL SELECT id, 'new', 0 FROM c WHERE status = 'recommended' AND NOT (accepted AND enabled)""")
def score_all(spark, sf):
    """A scoring run over all open candidates: eligibility, ranking, shelves, and what goes back to new."""
    k = F.col("id")
    shared = lambda n, name: F.when(k % n == 0, F.concat(F.lit(name), k.cast("string")))
    keys = F.array_compact(F.array(F.concat(F.lit("w"), k.cast("string")), shared(9, "read"), shared(11, "now"), shared(13, "later")))
    base = candidates(spark, sf)
    source = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("source_id"), "label")
    status = F.when(k % 7 == 0, "saved").when(k % 3 == 0, "recommended").otherwise("new")
    # A source's weight is its own; here each candidate's source is named so that it gives the weight of the candidate table.
    c = base.drop("source_weight", "confidence").join(source, "id").withColumn("source_id", F.concat_ws(":", F.col("label").cast("string"), (k % 3).cast("string"))).select("id", "identity", "author", "vec", "source_id", status.alias("status"), keys.alias("keys"))
    sources = source.select("label").distinct().crossJoin(spark.range(3).select(F.col("id").alias("w"))).select(F.concat_ws(":", F.col("label").cast("string"), F.col("w").cast("string")).alias("source_id"), (F.col("label") % 4 != 0).alias("enabled"), (1 + F.col("w") * F.lit(0.1)).alias("source_weight"))
    quality = base.select("id", F.when(k % 5 == 1, "quarantine").otherwise("accepted").alias("quality_status"), F.col("confidence").alias("quality_score"))
    named = lambda name: c.select(F.filter("keys", lambda x: x.startswith(name)).alias("keys"))
    history = reads(spark, sf).withColumn("keys", F.array(F.concat(F.lit("r"), k.cast("string")))).unionByName(named("read").select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("identity"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("double").alias("rating"), F.lit(None).cast("date").alias("day"), F.lit(None).cast("array<float>").alias("vec"), "keys"))
    return chain.scored(c, sources, quality, history, named("now"), named("later"))


_READ = """r AS (SELECT c_custkey AS key, nullif(c_custkey % 6, 0)::DOUBLE AS rating, CASE WHEN c_custkey % 8 <> 0 THEN TIMESTAMP '2024-01-10 00:00:00' + INTERVAL 1 HOUR * (c_custkey % 300) END AS read_at FROM customer WHERE c_custkey % 2 = 0),
    m AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 9 <> 0 THEN 5.0 END::DOUBLE AS rating, TIMESTAMP '2024-01-20 12:00:00' AS read_at FROM customer WHERE c_custkey % 3 = 0)"""


@query(f"""WITH {_READ}, n AS (SELECT key, coalesce(m.rating, r.rating) AS rating, coalesce(r.read_at, m.read_at) AS read_at FROM m LEFT JOIN r USING (key)),
    a AS (SELECT key, event_id AS impression FROM n JOIN events ON user_id = key AND ts < read_at QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1)
    SELECT key, rating, impression, CASE WHEN impression IS NULL THEN NULL WHEN rating IS NULL THEN 0.75 WHEN rating >= 4 THEN 1 WHEN rating <= 2 THEN 0 ELSE 0.5 END::DOUBLE AS label,
        CASE WHEN impression IS NULL THEN NULL WHEN rating IS NULL THEN 'completed_unrated' WHEN rating >= 4 THEN 'rating_positive' WHEN rating <= 2 THEN 'rating_negative' ELSE 'rating_neutral' END AS label_kind FROM n LEFT JOIN a USING (key)""")
def marked_read(spark, sf):
    """Books marked as read: merged into the reads, each owed to the last impression before."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    hour = F.lit("2024-01-10 00:00:00").cast("timestamp") + F.make_dt_interval(hours=(k % 300).cast("int"))
    old = c.where(k % 2 == 0).select(k.alias("key"), F.nullif(k % 6, F.lit(0)).cast("double").alias("rating"), F.when(k % 8 != 0, hour).alias("read_at"), F.lit(None).cast("string").alias("isbn"))
    marks = c.where(k % 3 == 0).select(k.alias("key"), F.when(k % 9 != 0, 5.0).alias("rating"), F.lit("2024-01-20 12:00:00").cast("timestamp").alias("read_at"), F.lit("x").alias("isbn"), F.lit(1).alias("at"))
    shown = events(spark, sf).select(F.col("user_id").alias("key"), F.col("event_id").alias("impression"), F.col("ts").alias("seen_at"))
    return chain.marked_read(old, marks, shown)[1]


@query("""WITH f AS (SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS candidate, CASE event_type WHEN 'purchase' THEN 'save' WHEN 'error' THEN 'reject' ELSE 'maybe_later' END AS action, ts FROM events WHERE event_type <> 'view' AND event_id % 10 <> 0),
    l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY ts DESC, id DESC) = 1), r AS (SELECT event_id % 40 AS identity, 1 + event_id % 5 AS rating, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'view')
    SELECT candidate, CAST(action = 'save' AS INT) AS label, count(*) AS prior, round(avg(rating), 6) AS mean_rating FROM l JOIN r ON r.day < CAST(l.ts AS DATE) AND r.identity <> l.candidate WHERE action IN ('save', 'reject') GROUP BY ALL""")
def feedback_histories(spark, sf):
    """Each decided candidate with what was read on the days before, its own identity left out."""
    e = events(spark, sf)
    k = F.get_json_object("props", "$.k").cast("long")
    action = F.when(F.col("event_type") == "purchase", "save").when(F.col("event_type") == "error", "reject").otherwise("maybe_later")
    feedback = e.where("event_type <> 'view'").select(F.col("event_id").alias("id"), k.alias("candidate"), k.alias("identity"), action.alias("action"), F.when(F.col("event_id") % 10 != 0, F.col("ts")).alias("at"))
    read = e.where("event_type = 'view'").select((F.col("event_id") % 40).alias("identity"), (1 + F.col("event_id") % 5).cast("double").alias("rating"), F.to_date("ts").alias("day"))
    return rounded(chain.feedback_histories(feedback, read))
