"""Scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.functions.vectors import dot, doubles, unit
from quillrank.plans import graph, ranking, serving
from quillrank.queries.registry import CANDIDATES, READS, candidates, query, reads, rounded
from quillrank.session import table

_SIMS = f"WITH {READS}, {CANDIDATES}, sims AS (SELECT c.id, c.author, r.author AS ra, r.rating, r.id AS read_id, list_cosine_similarity(c.vec, r.vec) AS sim FROM candidates c CROSS JOIN reads r)"
_BASE = _SIMS + """, base AS (SELECT id, round(least(100, greatest(0, 42 + 48 * coalesce(max(sim) FILTER (rating >= 4), 0.25) - 24 * coalesce(max(sim) FILTER (rating <= 2), 0)
    + 7 * coalesce(max(CASE WHEN rating >= 4 AND ra = author THEN 1 END), 0))), 6) AS score FROM sims GROUP BY id)"""


@query(_BASE + " SELECT id, score FROM base ORDER BY score DESC, id LIMIT 20")
def baseline_score_topk(spark, sf):
    return ranking.baseline(reads(spark, sf), candidates(spark, sf)).orderBy(F.col("score").desc(), "id").limit(20)


@query(_BASE + " SELECT * FROM base")
def baseline_score(spark, sf):
    return ranking.baseline(reads(spark, sf), candidates(spark, sf))


def _full(loo: bool) -> str:
    pool = (
        "candidates AS (SELECT id, identity, author, vec, 1.0::DOUBLE AS source_weight, 1.0::DOUBLE AS confidence FROM reads)" if loo else CANDIDATES
    )
    other = "WHERE c.identity <> r.identity" if loo else ""
    own = "LEFT JOIN reads o ON o.identity = c.identity" if loo else "LEFT JOIN (SELECT NULL::DOUBLE AS rating, NULL::VARCHAR AS author) o ON FALSE"
    return f"""WITH {READS}, {pool}, sims AS (SELECT c.id, r.id AS read_id, r.rating, r.day, list_cosine_similarity(c.vec, r.vec) AS sim FROM candidates c CROSS JOIN reads r {other}),
    n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, read_id) AS n, row_number() OVER (PARTITION BY id, rating >= 4 ORDER BY sim DESC, read_id) AS m FROM sims),
    w AS (SELECT *, CASE WHEN n <= 40 THEN pow(greatest(sim, 0) + 1e-8, 8) END AS w, CASE WHEN n <= 5 THEN greatest(sim, 0) + 1e-4 END AS lw,
        CASE WHEN rating >= 4 AND m <= 5 THEN greatest(sim, 0) + 1e-4 END AS uw, CASE WHEN n <= 40 THEN (max(CASE WHEN n <= 40 THEN day END) OVER (PARTITION BY id) - day) / 365.25 END AS age FROM n),
    t AS (SELECT id, sum(uw * sim) / sum(uw) AS up, max(sim) FILTER (rating <= 2) AS down, sum(lw * rating) / sum(lw) AS local, sum(w * rating) / sum(w) AS kernel,
        sum(w * exp(-age / 8) * rating) / sum(w * exp(-age / 8)) AS recent, pow(sum(w), 2) / sum(w * w) AS ess, max(sim) AS best FROM w GROUP BY id),
    a AS (SELECT author, count(*) AS an, sum(rating) AS s FROM reads GROUP BY author), h AS (SELECT count(*) AS hn, sum(rating) AS hs FROM reads),
    c AS (SELECT c.id, t.*, c.source_weight, c.confidence, hn - (CASE WHEN o.rating IS NULL THEN 0 ELSE 1 END) AS hn, (hs - coalesce(o.rating, 0)) / (hn - (CASE WHEN o.rating IS NULL THEN 0 ELSE 1 END)) AS mean,
        coalesce(an, 0) - (CASE WHEN o.author = c.author THEN 1 ELSE 0 END) AS an, coalesce(s, 0) - (CASE WHEN o.author = c.author THEN o.rating ELSE 0 END) AS s
        FROM candidates c JOIN t ON t.id = c.id LEFT JOIN a ON a.author = c.author CROSS JOIN h {own}),
    f AS (SELECT id, ess, 42 + 48 * coalesce(up, 0.25) - 24 * coalesce(down, 0) + 3.5 * (local - 3) + 3.5 * (CASE WHEN an > 0 THEN (s + 5 * mean) / (an + 5) - mean ELSE 0 END)
        + 10 * least(1, hn / 100.0) * (kernel - mean) * ess / (ess + 5) + 20 * least(1, hn / 100.0) * (recent - kernel) + 5 * (source_weight - 1) AS x, confidence FROM c)
    SELECT id, round(least(100, greatest(0, 50 + confidence * (x - 50))), 6) AS raw_score, round(round(least(100, greatest(0, 50 + confidence * (x - 50))), 6), 1) AS score, round(ess, 4) AS ess FROM f"""


@query(_full(False))
def kernel_score_full(spark, sf):
    return ranking.score_candidates(reads(spark, sf), candidates(spark, sf))


@query(_full(True))
def kernel_score_loo(spark, sf):
    own = reads(spark, sf).select("id", "identity", "author", "vec", F.lit(1.0).alias("source_weight"), F.lit(1.0).alias("confidence"))
    return ranking.score_candidates(reads(spark, sf), own, leave_one_out=True)


@query(_SIMS + " SELECT id, round(max(sim), 6) AS nearest FROM sims GROUP BY id")
def max_cosine(spark, sf):
    near = ranking.near_reads(ranking.history_of(reads(spark, sf)), candidates(spark, sf))
    return rounded(near.groupBy("id").agg(F.max("sim").alias("nearest")))


@query(f"WITH {READS}, {CANDIDATES}, p AS (SELECT r.id, r.author, r.rating FROM reads r) SELECT author, count(*) AS n, round((sum(rating) + 5 * (SELECT avg(rating) FROM reads)) / (count(*) + 5) - (SELECT avg(rating) FROM reads), 6) AS delta FROM p GROUP BY author")
def author_shrinkage(spark, sf):
    r = reads(spark, sf)
    mean = r.agg(F.avg("rating").alias("m"))
    g = r.groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("s")).crossJoin(F.broadcast(mean))
    return rounded(g.select("author", "n", ((F.col("s") + 5 * F.col("m")) / (F.col("n") + 5) - F.col("m")).alias("delta")))


@query("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm, len(embedding) = 64 AS valid FROM embeddings")
def vector_norms(spark, sf):
    v = doubles(F.col("embedding"))
    from quillrank.functions.vectors import valid

    return rounded(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.sqrt(dot(v, v)).alias("norm"), valid(F.col("embedding"), 64).alias("valid")))


_POOLED = """WITH v AS (SELECT vec_id AS id, label % 2 AS y, 0.5 + (vec_id % 5) / 10.0::DOUBLE AS w, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT * FROM v WHERE id % 3 = 0),
    g AS (SELECT count(*) >= 20 AS grown, (sum(w * y) + 1) / (sum(w) + 2) AS rate FROM d), k AS (SELECT *, CASE WHEN grown THEN 1.0 ELSE 1.5 END::DOUBLE AS prior, CASE WHEN grown THEN 5.0 ELSE 4.0 END::DOUBLE AS most FROM g),
    s AS (SELECT c.id, d.y, d.w, list_cosine_similarity(c.v, d.v) AS sim FROM v c CROSS JOIN d WHERE c.id % 3 <> 0),
    l AS (SELECT id, y, w * CASE WHEN grown AND y = 1 THEN pow(greatest(0, sim - 0.52) / 0.48, 2) ELSE greatest(0, sim - 0.45) / 0.55 END AS w FROM s CROSS JOIN k),
    t AS (SELECT id, sum(w) AS w, sum(w * y) AS p FROM l GROUP BY id HAVING sum(w) > 0),
    a AS (SELECT id, greatest(-most, least(most, most * ((p + prior * rate) / (w + prior) - rate) / 0.5)) AS adjustment FROM t CROSS JOIN k)
    SELECT id, round(adjustment, 6) AS adjustment FROM a WHERE abs(adjustment) >= 0.05"""


@query(_POOLED)
def semantic_pooling(spark, sf):
    """The learner's semantic part over all vectors: a third of them decided, the others candidates."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 2).alias("label"), (0.5 + (F.col("vec_id") % 5) / F.lit(10.0)).alias("weight"), F.col("embedding").alias("vec"))
    decided = v.where("id % 3 = 0").withColumnRenamed("id", "book")
    return rounded(serving.semantic_adjustments(decided, v.where("id % 3 <> 0").select("id", "vec")))


@query(_POOLED.replace("CAST(embedding AS DOUBLE[]) AS v", "list_concat(list_transform(range(10), lambda k: CASE WHEN k = vec_id % 10 THEN 1.0 ELSE 0.0 END::DOUBLE), list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 0.8)) AS v").replace("label % 2 AS y", "CASE WHEN vec_id % 10 < 5 THEN 1 ELSE 0 END AS y"))
def semantic_clusters(spark, sf):
    """The same over clustered vectors, in which every candidate has decided books within reach of the floors."""
    cluster = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.when(k == F.col("vec_id") % 10, 1.0).otherwise(0.0))
    vec = F.concat(cluster, F.transform(doubles(F.col("embedding")), lambda x: x * 0.8))
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 10 < 5).cast("int").alias("label"), (0.5 + (F.col("vec_id") % 5) / F.lit(10.0)).alias("weight"), vec.alias("vec"))
    decided = v.where("id % 3 = 0").withColumnRenamed("id", "book")
    return rounded(serving.semantic_adjustments(decided, v.where("id % 3 <> 0").select("id", "vec")))


_EDGES = "e AS (SELECT DISTINCT l_partkey AS work, l_suppkey AS entity FROM lineitem), s AS (SELECT DISTINCT work FROM e WHERE work % 50 = 0)"


def _edges(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("work"), F.col("l_suppkey").alias("entity")).distinct()
    return e, e.where("work % 50 = 0").select("work").distinct()


@query(f"""WITH {_EDGES}, d AS (SELECT entity, count(*) AS degree FROM e GROUP BY entity), m AS (SELECT e.entity, count(*) / (SELECT count(*) FROM s)::DOUBLE / any_value(degree) AS m FROM e JOIN s USING (work) JOIN d USING (entity) GROUP BY e.entity)
    SELECT work, round(sum(m), 9) AS score FROM e JOIN m USING (entity) WHERE work NOT IN (SELECT work FROM s) GROUP BY work""")
def one_hop_graph(spark, sf):
    return rounded(graph.one_hop(*_edges(spark, sf)), 9)


_STEP = "r{n} AS (SELECT node, sum(r) AS r FROM (SELECT a.dst AS node, 0.6 * p.r * a.p AS r FROM r{m} p JOIN arcs a ON a.src = p.node UNION ALL SELECT node, 0.4 * r FROM r0) GROUP BY node)"


@query(f"""WITH {_EDGES}, arcs AS MATERIALIZED (SELECT concat('w', work) AS src, concat('e', entity) AS dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY work) AS p FROM e UNION ALL
    SELECT concat('e', entity), concat('w', work), 1.0::DOUBLE / count(*) OVER (PARTITION BY entity) FROM e), r0 AS MATERIALIZED (SELECT concat('w', work) AS node, 1.0::DOUBLE / (SELECT count(*) FROM s) AS r FROM s),
    {", ".join(_STEP.format(n=n, m=n - 1).replace("AS (", "AS MATERIALIZED (", 1) for n in range(1, 9))}
    SELECT CAST(substr(node, 2) AS BIGINT) AS work, round(r, 9) AS rank FROM r8 WHERE node LIKE 'w%' AND CAST(substr(node, 2) AS BIGINT) NOT IN (SELECT work FROM s)""")
def pagerank_diffusion(spark, sf):
    """Eight steps, so that SQL can write them out."""
    return rounded(graph.diffusion(*_edges(spark, sf), steps=8), 9)


@query(f"""WITH {_EDGES}, arcs AS MATERIALIZED (SELECT concat('w', work) AS src, concat('e', entity) AS dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY work) AS p FROM e UNION ALL
    SELECT concat('e', entity), concat('w', work), 1.0::DOUBLE / count(*) OVER (PARTITION BY entity) FROM e), r0 AS MATERIALIZED (SELECT concat('w', work) AS node, 1.0::DOUBLE / (SELECT count(*) FROM s) AS r FROM s),
    {", ".join(_STEP.format(n=n, m=n - 1).replace("AS (", "AS MATERIALIZED (", 1) for n in range(1, 33))}
    SELECT CAST(substr(node, 2) AS BIGINT) AS work, round(r, 7) AS rank FROM r32 WHERE node LIKE 'w%' AND CAST(substr(node, 2) AS BIGINT) NOT IN (SELECT work FROM s)""")
def pagerank_converged(spark, sf):
    """To the end: what is left after 32 steps is less than the digits given."""
    return rounded(graph.diffusion(*_edges(spark, sf)), 7)


@query()
def slate_diversify(spark, sf):
    from pyspark.sql import Window

    c = candidates(spark, sf).withColumn("run", (F.col("id") % 7).cast("long")).withColumn("score", 60 + F.pmod(F.col("id") * 37, F.lit(30)).cast("double"))
    page = c.withColumn("pos", F.row_number().over(Window.partitionBy("run").orderBy(F.col("score").desc(), "id"))).where("pos <= 24")
    return serving.diversified(page)


@query()
def epsilon_explore(spark, sf):
    from pyspark.sql import Window

    c = candidates(spark, sf).withColumn("run", F.col("id") % 7)
    return serving.explored(c.select("run", "id", F.row_number().over(Window.partitionBy("run").orderBy("id")).alias("pos")), 0.3, 11)


@query()
def kmeans_interests(spark, sf):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = reads(spark, sf).select("id", array_to_vector(doubles(F.col("vec"))).alias("features"))
    return KMeans(k=5, seed=3).fit(v).transform(v).select("id", F.col("prediction").alias("interest"))


@query()
def hashed_text_vectors(spark, sf):
    """768 buckets of one- and two-word grams without stop words, unit length."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, NGram, Normalizer, RegexTokenizer, StopWordsRemover, VectorAssembler

    steps = [RegexTokenizer(inputCol="text", outputCol="w", pattern=r"\W+"), StopWordsRemover(inputCol="w", outputCol="s"), NGram(n=2, inputCol="s", outputCol="g"), HashingTF(numFeatures=768, inputCol="s", outputCol="v1"), HashingTF(numFeatures=768, inputCol="g", outputCol="v2"), VectorAssembler(inputCols=["v1", "v2"], outputCol="v"), Normalizer(inputCol="v", outputCol="unit")]
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    from pyspark.ml.functions import vector_to_array

    out = Pipeline(stages=steps).fit(docs).transform(docs).withColumn("a", vector_to_array("unit"))
    return out.select("doc_id", F.size(F.filter("a", lambda x: x != 0)).alias("used"), F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x * x), 6).alias("length"))
