"""Queries of the evidence store, of published versions, of association edges, frontiers and budgets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillrank.plans import evidence, graph, ranking, rebuild
from quillrank.queries.registry import query
from quillrank.session import shared_dir, table
from quillrank.sources import associations

# Batches of customers: orders are their candidates, parts of their lines the reads, embeddings (rounded, so that many agree) the vectors.
_BATCHES = """h AS (SELECT c_custkey AS batch FROM customer WHERE c_custkey % 5 = 0),
    r AS (SELECT DISTINCT o_custkey AS batch, l_partkey AS read FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 5 = 0 AND l_partkey > 0),
    k AS (SELECT o_custkey AS batch, o_orderkey AS candidate, round(o_totalprice::DOUBLE / 1000, 1) AS score, sha256(CAST(o_orderkey AS VARCHAR)) AS identity_hash, CASE WHEN o_orderkey % 97 = 0 THEN 'none' ELSE sha256(o_orderpriority) END AS input_hash FROM orders WHERE o_custkey % 5 = 0 AND o_orderkey > 0),
    s AS (SELECT batch, CASE WHEN vec_id % 2 = 0 THEN 'read' ELSE 'candidate' END AS kind, vec_id AS entity, concat_ws(',', CAST(round(embedding[1] * 20) AS INT), CAST(round(embedding[2] * 20) AS INT)) AS content FROM (SELECT *, unnest([vec_id * 5, vec_id * 5 + 35]) AS batch FROM embeddings WHERE vec_id > 0) e JOIN h USING (batch)),
    v AS (SELECT *, sha256('{"backend":"local","dimensions":2,"model":"m"}' || chr(0) || content) AS artifact, sha256(content) AS content_sha256 FROM s),
    bad AS (SELECT DISTINCT batch FROM k WHERE input_hash = 'none'), ok AS (SELECT batch FROM h WHERE batch NOT IN (SELECT batch FROM bad))"""
_PAYLOADS = _BATCHES + """,
    p AS (SELECT ok.batch, '{"candidates":' || coalesce((SELECT to_json(list({'candidate_id': candidate, 'score': score} ORDER BY candidate)) FROM k WHERE k.batch = ok.batch), '[]') || ',"reads":' || coalesce((SELECT to_json(list(read ORDER BY read)) FROM r WHERE r.batch = ok.batch), '[]')
        || ',"vectors":' || coalesce((SELECT to_json(list({'artifact': artifact, 'content_sha256': content_sha256, 'entity': entity, 'kind': kind} ORDER BY artifact, content_sha256, entity, kind)) FROM v WHERE v.batch = ok.batch), '[]') || '}' AS payload FROM ok)"""


def _store(spark, sf) -> evidence.Store:
    fifth = lambda c: F.col(c) % 5 == 0
    header = table(spark, sf, "customer").where(fifth("c_custkey")).select(F.col("c_custkey").alias("batch"), F.lit("2024-01-01").alias("captured_at"))
    orders = table(spark, sf, "orders").where(fifth("o_custkey")).withColumn("batch", F.col("o_custkey"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("read"))
    reads = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("batch", "read").where("read > 0").distinct()
    price = F.round(F.col("o_totalprice").cast("double") / 1000, 1)
    digest = F.when(F.col("o_orderkey") % 97 == 0, "none").otherwise(F.sha2("o_orderpriority", 256))
    candidates = orders.where("o_orderkey > 0").select("batch", F.col("o_orderkey").alias("candidate"), price.alias("score"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("identity_hash"), digest.alias("input_hash"))
    rough = lambda k: F.round(F.col("embedding")[k] * 20).cast("int").cast("string")
    vectors = table(spark, sf, "embeddings").where("vec_id > 0").select(F.explode(F.array(F.col("vec_id") * 5, F.col("vec_id") * 5 + 35)).alias("batch"), F.when(F.col("vec_id") % 2 == 0, "read").otherwise("candidate").alias("kind"), F.col("vec_id").alias("entity"), F.lit("local").alias("backend"), F.lit("m").alias("model"), F.lit(2).alias("dimensions"), F.concat_ws(",", rough(0), rough(1)).alias("content"))
    vectors = vectors.join(header.select("batch"), "batch", "left_semi")
    return evidence.capture(header, reads, candidates, vectors)


@query(f"""WITH {_PAYLOADS} SELECT h.batch, CASE WHEN p.batch IS NULL THEN 'incomplete' ELSE 'complete' END AS status, CASE WHEN p.batch IS NULL THEN 'invalid_candidate_manifest' ELSE '' END AS reason, sha256(payload) AS payload_sha256, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
    (SELECT count(*) FROM r WHERE r.batch = h.batch) AS read_count, (SELECT count(*) FROM k WHERE k.batch = h.batch) AS candidate_count, (SELECT count(*) FROM v WHERE v.batch = h.batch) AS vector_count FROM h LEFT JOIN p USING (batch)""")
def evidence_batches(spark, sf):
    """Captured batches with their checksums; those with an invalid candidate are markers."""
    return _store(spark, sf).batches.drop("payload", "captured_at")


@query(f"WITH {_BATCHES} SELECT artifact, content, count(*) AS links FROM v JOIN ok USING (batch) GROUP BY ALL")
def evidence_artifacts(spark, sf):
    """Each artifact once, with the links it has."""
    store = _store(spark, sf)
    return store.artifacts.join(evidence.references(store), "artifact").select("artifact", "content", "links")


# What went wrong with a kept store: lost and added links, other scores, other contents, other payloads.
_DAMAGE = """
    l AS (SELECT v.* FROM v JOIN ok USING (batch)), a AS (SELECT DISTINCT artifact, content FROM l), first AS (SELECT min(artifact) AS low, max(artifact) AS top FROM a),
    f AS (SELECT batch, 'read links' AS problem FROM ok WHERE batch IN (SELECT batch FROM r WHERE read % 211 = 0) UNION SELECT batch, 'candidate links' FROM k JOIN ok USING (batch) WHERE candidate % 389 = 0
        UNION SELECT batch, 'vector links' FROM ok WHERE batch % 45 = 0 UNION SELECT batch, 'payload checksum' FROM ok WHERE batch % 65 = 0 UNION SELECT batch, 'read count' FROM ok WHERE batch % 85 = 0
        UNION SELECT batch, 'artifact missing' FROM l, first WHERE artifact = low UNION SELECT batch, 'artifact checksum' FROM l, first WHERE artifact = top AND low <> top)"""


@query(f"WITH {_BATCHES}, {_DAMAGE} SELECT h.batch, CASE WHEN h.batch IN (SELECT batch FROM ok) THEN 'complete' ELSE 'incomplete' END AS status, coalesce(string_agg(problem, ', ' ORDER BY problem), '') AS problems FROM h LEFT JOIN f USING (batch) GROUP BY ALL")
def evidence_verified(spark, sf):
    """Every kind of damage to a store is found, and named for just the batches it touches."""
    from dataclasses import replace

    s = _store(spark, sf)
    ends = s.artifacts.agg(F.min("artifact").alias("low"), F.max("artifact").alias("top"))
    artifacts = s.artifacts.crossJoin(F.broadcast(ends)).where("artifact <> low").withColumn("content", F.when(F.col("artifact") == F.col("top"), "else").otherwise(F.col("content"))).drop("low", "top")
    b = F.col("batch")
    hurt = replace(
        s, artifacts=artifacts, read_links=s.read_links.where("read % 211 <> 0"), candidate_links=s.candidate_links.withColumn("score", F.when(F.col("candidate") % 389 == 0, -1.0).otherwise(F.col("score"))),
        vector_links=s.vector_links.unionByName(s.batches.where((b % 45 == 0) & (F.col("status") == "complete")).select("batch", F.lit("read").alias("kind"), F.lit(0).cast("long").alias("entity"), F.lit("added").alias("artifact"))),
        batches=s.batches.withColumn("payload_sha256", F.when(b % 65 == 0, "other").otherwise(F.col("payload_sha256"))).withColumn("read_count", F.when(b % 85 == 0, F.col("read_count") + 1).otherwise(F.col("read_count"))),
    )
    return evidence.verify(hurt).withColumn("problems", F.concat_ws(", ", "problems"))


@query(f"""WITH {_BATCHES}, gone AS (SELECT DISTINCT batch FROM r JOIN ok USING (batch) WHERE read % 83 = 0), u AS (SELECT concat('run', batch // 10) AS run, batch FROM ok), lost AS (SELECT DISTINCT run FROM u JOIN gone USING (batch)),
    w AS (SELECT concat('run', batch // 10) AS run, artifact FROM v JOIN ok USING (batch) WHERE entity % 3 = 0), left_ AS (SELECT batch FROM h WHERE batch NOT IN (SELECT batch FROM gone)),
    n AS (SELECT artifact, count(*) AS links FROM (SELECT artifact FROM v JOIN ok USING (batch) JOIN left_ USING (batch) UNION ALL SELECT artifact FROM w WHERE run NOT IN (SELECT run FROM lost)) GROUP BY 1)
    SELECT (SELECT count(*) FROM left_) AS batches, (SELECT count(*) FROM n) AS artifacts, (SELECT sum(links)::BIGINT FROM n) AS links, (SELECT count(*) FROM u WHERE run NOT IN (SELECT run FROM lost)) AS run_links,
    (SELECT count(*) FROM k JOIN ok USING (batch) JOIN left_ USING (batch)) AS candidates, (SELECT count(*) FROM r JOIN ok USING (batch) JOIN left_ USING (batch)) AS reads""")
def evidence_purged(spark, sf):
    """What is left when some reads are forgotten: their batches go, runs served from those too, artifacts only when nothing links them."""
    s = _store(spark, sf)
    run = F.concat(F.lit("run"), F.floor(F.col("batch") / 10).cast("string"))
    done = s.batches.where("status = 'complete'").select(run.alias("run"), "batch")
    own = s.vector_links.where("entity % 3 = 0").join(s.artifacts, "artifact").select(run.alias("run"), "kind", "entity", "backend", "model", "dimensions", "content")
    forgotten = s.read_links.select("read").where("read % 83 = 0").distinct()
    left = evidence.purge(evidence.served(s, done, own), reads=forgotten)
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    one = n(left.batches, "batches").crossJoin(evidence.references(left).agg(F.count(F.lit(1)).alias("artifacts"), F.sum("links").alias("links")))
    return one.crossJoin(n(left.run_links, "run_links")).crossJoin(n(left.candidate_links, "candidates")).crossJoin(n(left.read_links, "reads"))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _letter_counts(items):
    """An embedder: how often each letter stands in a text."""
    return items.select("id", F.array(*[(F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).cast("double") for c in _LETTERS]).alias("vec"))


@query(f"""WITH v AS (SELECT p_partkey AS id, p_brand AS author, CAST(1 + p_size % 5 AS DOUBLE) AS rating, list_transform(string_split('{",".join(_LETTERS)}', ','), lambda c: CAST(length(p_name) - length(replace(p_name, c, '')) AS DOUBLE)) AS vec FROM part),
    s AS (SELECT c.id, c.author, r.author AS ra, r.rating, list_cosine_similarity(c.vec, r.vec) AS sim FROM v c JOIN v r ON c.id % 2 = 1 AND r.id % 2 = 0)
    SELECT id, round(least(100, greatest(0, 42 + 48 * coalesce(max(sim) FILTER (rating >= 4), 0.25) - 24 * coalesce(max(sim) FILTER (rating <= 2), 0) + 7 * coalesce(max(CASE WHEN rating >= 4 AND ra = author THEN 1 END), 0))), 6) AS score FROM s GROUP BY id""")
def rebuilt_scores(spark, sf):
    """All vectors and scores rebuilt and published as a version; the scores as a reader of that version sees them."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("identity"), F.col("p_brand").alias("author"), (1 + F.col("p_size") % 5).cast("double").alias("rating"))
    root = f"{shared_dir(spark).rstrip('/')}/published-{uuid.uuid4().hex}"
    return rebuild.rebuild(root, p.where("id % 2 = 0"), p.where("id % 2 = 1"), _letter_counts, ranking.baseline, "letters").table(spark, "scores")


def _level(k: int, budget: int | None) -> str:
    layer = f"(SELECT id FROM f{k} WHERE level = {k} ORDER BY id{f' LIMIT {budget}' if budget else ''})"
    return f"f{k + 1} AS (SELECT * FROM f{k} UNION ALL SELECT dst, {k + 1}, min(src) FROM e JOIN {layer} l ON l.id = e.src WHERE dst NOT IN (SELECT id FROM f{k}) GROUP BY dst)"


_BUDGETS = (100, 300, None, 50)


@query(f"""WITH a AS (SELECT DISTINCT concat('o', l_orderkey) AS o, concat('p', l_partkey) AS p FROM lineitem), b AS (SELECT o AS src, p AS dst FROM a UNION ALL SELECT p, o FROM a),
    e AS (SELECT src, dst FROM b QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 5), f0 AS (SELECT concat('o', o_orderkey) AS id, 0 AS level, NULL AS via FROM orders WHERE o_orderkey % 50 = 0),
    {", ".join(_level(k, b) for k, b in enumerate(_BUDGETS))} SELECT id, CAST(level AS INTEGER) AS level, via FROM f{len(_BUDGETS)}""")
def graph_frontier(spark, sf):
    """Orders and their parts, expanded within budgets from some orders."""
    l = table(spark, sf, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    seeds = table(spark, sf, "orders").where("o_orderkey % 50 = 0").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"))
    return graph.frontier(l.unionByName(l.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), seeds, list(_BUDGETS), 5)


@query("""WITH s AS (SELECT DISTINCT concat('w', l_partkey) AS seed, l_orderkey AS name FROM lineitem WHERE l_partkey % 20 = 0), x AS (SELECT DISTINCT l_orderkey AS name, concat('w', l_partkey) AS related FROM lineitem),
    l AS (SELECT 'shelves' AS provider, seed, related, 'list' AS relation, NULL::INTEGER AS position, CAST(count(*) AS DOUBLE) AS weight FROM s JOIN x USING (name) WHERE related <> seed GROUP BY ALL),
    r AS (SELECT 'similar' AS provider, concat('w', l_partkey) AS seed, concat('w', l_suppkey) AS related, l_linenumber AS line_no, l_orderkey FROM lineitem WHERE l_partkey % 20 = 1),
    p AS (SELECT provider, seed, related, row_number() OVER (PARTITION BY seed ORDER BY l_orderkey, line_no, related) AS position FROM r)
    SELECT * FROM l UNION ALL SELECT provider, seed, related, 'recommendation', CAST(min(position) AS INTEGER), 1.0 / min(position) FROM p WHERE position <= 40 AND related <> seed GROUP BY ALL""")
def association_edges(spark, sf):
    """Edges out of payload files that two providers left in the shared folder."""
    w = lambda c: F.concat(F.lit("w"), F.col(c).cast("string"))
    l = table(spark, sf, "lineitem")
    entries = l.groupBy("l_orderkey").agg(F.collect_list(F.struct(w("l_partkey").alias("key"))).alias("entries"))
    shelves = l.where("l_partkey % 20 = 0").select(w("l_partkey").alias("seed"), "l_orderkey").join(entries, "l_orderkey")
    shelves = shelves.groupBy("seed").agg(F.to_json(F.struct(F.first("seed").alias("seed"), F.collect_list(F.struct(F.col("l_orderkey").cast("string").alias("name"), "entries")).alias("lists"))).alias("value"))
    ranked = l.where("l_partkey % 20 = 1").groupBy(w("l_partkey").alias("seed")).agg(F.sort_array(F.collect_list(F.struct("l_orderkey", F.col("l_linenumber").alias("at"), w("l_suppkey").alias("key")))).alias("r"))
    similar = ranked.select("seed", F.to_json(F.struct("seed", F.transform("r", lambda x: F.struct(x["key"].alias("key"))).alias("recommendations"))).alias("value"))
    folder = f"{shared_dir(spark).rstrip('/')}/payloads-{uuid.uuid4().hex}"
    for name, rows in (("shelves", shelves), ("similar", similar)):
        rows.select("value").write.text(f"{folder}/provider={name}")
    return associations.edges(associations.payloads(spark, folder))
