"""Queries of routing, eligibility, rejections, audits, digests, explanations and scorer variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.functions.vectors import doubles
from quillrank.plans import gates as G
from quillrank.plans import ranking
from quillrank.queries.ranking import _SIMS, _full
from quillrank.queries.registry import candidates, events, query, reads, rounded
from quillrank.session import table

_STATES = ("recommended", "new", "saved", "rejected", "maybe_later")
_ITEMS = "i AS (SELECT c_custkey AS id, ['recommended', 'new', 'saved', 'rejected', 'maybe_later'][c_custkey % 5 + 1] AS status, c_acctbal AS score FROM customer)"


def _items(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), F.get(F.array(*[F.lit(s) for s in _STATES]), (k % 5).cast("int")).alias("status"), F.col("c_acctbal").alias("score"))


@query(f"""WITH {_ITEMS}, v AS (SELECT 'decisions' AS view, * FROM i WHERE status IN ('rejected', 'maybe_later') UNION ALL SELECT 'all', * FROM i WHERE status NOT IN ('rejected', 'maybe_later') UNION ALL SELECT 'saved', * FROM i WHERE status = 'saved'
    UNION ALL SELECT 'head', * FROM (SELECT * FROM i WHERE status = 'recommended' ORDER BY score DESC, id DESC LIMIT 24) UNION ALL SELECT 'head', * FROM i WHERE status IN ('new', 'saved')) SELECT view, id, CAST(row_number() OVER (PARTITION BY view ORDER BY status <> 'recommended', score DESC, id DESC) AS INT) AS position FROM v""")
def status_routing(spark, sf):
    i = _items(spark, sf)
    out = G.routed(i, head=24).withColumn("view", F.lit("head"))
    for view in ("decisions", "all", "saved"):
        out = out.unionByName(G.routed(i, view).withColumn("view", F.lit(view)))
    return out.select("view", "id", "position")


@query("SELECT p_partkey AS id FROM part WHERE contains(lower(concat(p_name, ' ', p_brand)), 'ring brand#1') AND p_type = 'PROMO' AND p_size % 3 <> 0 AND p_retailprice / 10 >= 90")
def history_filter(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.array("p_type").alias("genres"), F.nullif(F.col("p_size") % 3, F.lit(0)).alias("rating"), F.lit("x").alias("source"), (F.col("p_retailprice") / 10).alias("score"))
    return G.searched(p, " Ring BRAND#1", "PROMO", "rated", "x", 90.0).select("id")


@query("""WITH w AS (SELECT p_partkey AS id, p_partkey % 13 = 0 AS conflict, p_partkey % 7 = 0 AS unnamed, 1990 + p_size AS year, p_partkey % 5 = 0 AS foreign_, p_partkey % 11 = 0 AS flawed, p_name IN (SELECT p_name FROM part WHERE p_partkey < 12) AS read FROM part)
    SELECT id, CASE WHEN conflict THEN 'identity_conflict' WHEN unnamed THEN 'unverified_work_id' WHEN year > 2020 THEN 'published_after_cutoff' WHEN foreign_ THEN 'untrusted_source' WHEN flawed THEN 'local_quality_gate' WHEN read THEN 'already_read' ELSE 'eligible' END AS reason FROM w""")
def work_eligibility(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part")
    works = p.select(
        k.alias("id"), (k % 13 == 0).alias("identity_conflict"), F.when(k % 7 != 0, F.concat(F.lit("OL"), k.cast("string"), F.lit("W"))).alias("work"), F.lit(None).cast("date").alias("released"), (1990 + F.col("p_size")).alias("year"),
        F.when(k % 5 == 0, "https://shop.example/x").otherwise("https://openlibrary.org/x").alias("url"), F.when(k % 11 == 0, F.array(F.lit("noise_title"))).alias("flags"), F.array("p_name").alias("keys"))
    return G.eligibility(works, p.where(k < 12).select(F.array("p_name").alias("keys")), F.lit("2020-06-01").cast("date"))


@query("""WITH r AS (SELECT DISTINCT p_name FROM part WHERE p_partkey < 12), s AS (SELECT DISTINCT p_name FROM part WHERE p_partkey BETWEEN 12 AND 30), a AS (SELECT p_partkey AS id, p_name, p_brand, p_retailprice, p_partkey % 3 <> 0 AS accepted FROM part),
    f AS (SELECT * FROM a WHERE p_name NOT IN (FROM r) AND p_name NOT IN (FROM s)) SELECT id, 'read_overlap' AS reason FROM a WHERE p_name IN (FROM r) UNION ALL SELECT id, 'shortlisted_overlap' FROM a WHERE p_name NOT IN (FROM r) AND p_name IN (FROM s)
    UNION ALL SELECT id, 'duplicate_identity' FROM (SELECT id, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_retailprice DESC, id) AS n FROM f WHERE accepted) WHERE n > 1""")
def overlap_rejections(spark, sf):
    """An item has one key that it shares with reads and one that it shares with its copies."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    copy = F.concat_ws("\x1f", "p_name", "p_brand")
    active = p.select(k.alias("id"), F.array(copy, F.concat(F.lit("name:"), "p_name", F.lit(":"), "p_brand")).alias("keys"), F.lit(None).cast("double").alias("quality"), (k % 3 != 0).alias("accepted"), F.lit("d").alias("description"), F.lit("").alias("cover"), F.col("p_retailprice").alias("score"), "p_name")
    named = p.select("p_name", "p_brand").distinct()
    keyed = lambda when: p.where(when).select("p_name").distinct().join(named, "p_name").select(F.array(copy).alias("keys"))
    return G.overlap_rejections(active, keyed(k < 12), keyed(k.between(12, 30)))


@query("""WITH r AS (SELECT c_custkey AS id, c_custkey % 9 = 0 AS bad, c_custkey % 7 <> 0 AS av, c_custkey % 5 <> 0 AS ma, c_acctbal / 10000 >= 0.82 AND c_custkey % 2 = 0 AS good FROM customer)
    SELECT CASE WHEN bad THEN 'rejected' WHEN av AND ma AND good THEN 'accepted' ELSE 'quarantine' END AS status, CASE WHEN bad THEN ['missing_title'] WHEN NOT av THEN ['catalog_provider_unavailable'] WHEN NOT ma THEN ['catalog_unmatched'] WHEN NOT good THEN ['catalog_match_ambiguous'] ELSE [] END AS flags, count(*) AS n FROM r GROUP BY ALL""")
def audit_verdicts(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k.alias("id"), F.when(k % 9 == 0, F.array(F.lit("missing_title"))).alias("flags"), (k % 7 != 0).alias("available"), (k % 5 != 0).alias("matched"), (F.col("c_acctbal") / 10000).alias("quality"), F.lit(0.9).alias("title_match"), F.when(k % 2 == 0, 0.65).otherwise(0.64).alias("author_match"))
    return G.audited(rows).groupBy("status", "flags").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH i AS (SELECT o_orderkey AS id, o_custkey AS k, o_totalprice AS score, o_orderdate AS t FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 300000 AND o_orderkey % 10 <> 0 AND o_custkey % 6 <> 0 AND o_custkey % 7 <> 0), d AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, t DESC, id DESC) AS n FROM i) SELECT id, score FROM d WHERE n = 1 ORDER BY score DESC, t DESC, id DESC LIMIT 30""")
def digest_top(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_custkey")
    items = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "recommended").otherwise("new").alias("status"), F.col("o_totalprice").alias("score"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), F.array(k.cast("string")).alias("keys"))
    known = lambda n: o.where(k % n == 0).select(F.array(k.cast("string")).alias("keys"))
    return G.digest(items, o.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("id")), known(6), known(7), 300000.0, 30).select("id", "score")


@query("SELECT p_partkey AS id FROM part ORDER BY p_partkey % 2 = 0, p_partkey % 3 <> 0, p_partkey % 5 = 0, p_partkey LIMIT 50")
def enrichment_priority(spark, sf):
    """The 50 records that one batch of requests is spent on."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k.alias("id"), F.when(k % 2 == 0, F.array("p_type")).alias("genres"), F.when(k % 3 == 0, "0306406152").otherwise("12").alias("isbn"), F.when(k % 5 == 0, "https://books.google.com/c").otherwise("").alias("cover"), F.lit("").alias("url"))
    return p.orderBy(*G.enrichment_order(p, True)).limit(50).select("id")


@query(_SIMS + """, n AS (SELECT id, any_value(author) AS author, first(read_id ORDER BY sim DESC, read_id) FILTER (rating >= 4) AS ut, max(sim) FILTER (rating >= 4) AS us, first(read_id ORDER BY sim DESC, read_id) FILTER (rating <= 2) AS dt, max(sim) FILTER (rating <= 2) AS ds FROM sims GROUP BY id), a AS (SELECT author, max(rating) AS best, min(rating) AS worst FROM reads GROUP BY author)
    SELECT n.id, list_filter([CASE WHEN best >= 4 AND worst <= 2 THEN 'This author has mixed ratings in your reading history' WHEN best >= 4 THEN 'You rated a book by this author highly' END, CASE WHEN us > 0.25 THEN concat('Closest highly rated title: t', ut) END, CASE WHEN ds > 0 THEN concat('Reduced: similar to a 1–2★ book — t', dt) END, CASE WHEN n.id % 4 < 2 THEN 'From feed' END, CASE WHEN n.id % 51 < 15 THEN 'Ranking confidence reduced because catalog details are sparse' END], lambda x: x IS NOT NULL) AS explanation FROM n LEFT JOIN a USING (author)""")
def explanations(spark, sf):
    r, c = reads(spark, sf), candidates(spark, sf)
    near = ranking.near_reads(r, c).join(r.select(F.col("id").alias("read_id"), "rating", F.concat(F.lit("t"), F.col("id").cast("string")).alias("title")), "read_id")
    authors = r.groupBy("author").agg(F.max("rating").alias("best"), F.min("rating").alias("worst"))
    return G.explained(near, c.select("id", "author", F.when(F.col("id") % 4 < 2, "feed").alias("source"), "confidence"), authors)


@query("""WITH k AS (SELECT arg_max(c_acctbal, c_custkey) AS s, c_nationkey AS n, c_mktsegment AS m FROM customer GROUP BY 2, 3) SELECT o_orderkey AS id, CASE WHEN s IS NOT NULL THEN s WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS score, CASE WHEN s IS NOT NULL THEN 'candidate' WHEN o_orderkey % 2 = 0 THEN 'virtual' END AS origin FROM orders LEFT JOIN k ON o_custkey % 40 = n AND m = 'BUILDING'""")
def history_scores(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    r = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Title  "), (F.col("o_custkey") % 40).cast("string")).alias("title"), F.lit("Building").alias("author"))
    k = c.select(F.concat(F.lit("TITLE: "), F.col("c_nationkey").cast("string")).alias("title"), F.col("c_mktsegment").alias("author"), F.lit(0).alias("updated_at"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    return G.history_scores(r, k, o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")))


@query("SELECT p_partkey AS id, p_partkey + 1 AS record FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 = 0")
def identifier_match(spark, sf):
    """Codes are made from the key: nine digits and their check digit."""
    k = F.col("p_partkey")
    digits = F.lpad(k.cast("string"), 9, "0")
    total = sum((10 - i) * F.substring(digits, i + 1, 1).cast("int") for i in range(9))
    check = F.pmod(11 - total % 11, F.lit(11))
    code = F.concat(digits, F.when(check == 10, "X").otherwise(check.cast("string")))
    p = table(spark, sf, "part")
    records = p.where(k % 2 == 0).select((k + 1).alias("record"), F.array(F.lit("junk"), F.concat(F.lit("ISBN "), code), code).alias("isbns"))
    return G.identified(records, p.where(k % 3 == 0).select(k.alias("id"), code.alias("isbn")))


_ARMS = {"kernel_unshrunk": {"ess_prior": 0.0}, "author_stronger": {"ess_prior": 0.0, "author_prior": 3.0, "author_weight": 5.0}, "kernel_ess2": {"ess_prior": 2.0}, "kernel_ess5": {}, "negative_top5": {"ess_prior": 0.0, "disliked": 5}, "cosine_centred": {"ess_prior": 0.0, "centred": True}}


def _variant(arm: str) -> str:
    sql = _full(False)
    if arm != "kernel_ess5":
        sql = sql.replace("* ess / (ess + 5)", "* ess / (ess + 2)" if arm == "kernel_ess2" else "")
    if arm == "author_stronger":
        sql = sql.replace("3.5 * (CASE WHEN an > 0 THEN (s + 5 * mean) / (an + 5)", "5.0 * (CASE WHEN an > 0 THEN (s + 3 * mean) / (an + 3)")
    if arm == "negative_top5":
        sql = sql.replace("AS m FROM sims", "AS m, row_number() OVER (PARTITION BY id, rating <= 2 ORDER BY sim DESC, read_id) AS b FROM sims").replace("max(sim) FILTER (rating <= 2) AS down", "sum(sim * (greatest(sim, 0) + 1e-4)) FILTER (rating <= 2 AND b <= 5) / sum(greatest(sim, 0) + 1e-4) FILTER (rating <= 2 AND b <= 5) AS down")
    if arm == "cosine_centred":
        sql = sql.replace("list_cosine_similarity(c.vec, r.vec) AS sim FROM candidates c CROSS JOIN reads r )", "least(1, greatest(0, list_cosine_similarity(c.vec, r.vec) - avg(list_cosine_similarity(c.vec, r.vec)) OVER (PARTITION BY c.id) + 0.25)) AS sim FROM candidates c CROSS JOIN reads r )")
    return f"SELECT id, '{arm}' AS arm, raw_score FROM ({sql})"


@query(" UNION ALL ".join(map(_variant, _ARMS)))
def formula_variants(spark, sf):
    return ranking.score_variants(reads(spark, sf), candidates(spark, sf), _ARMS)


@query()
def reserved_slot(spark, sf):
    c = candidates(spark, sf)
    pages = c.select(F.floor(F.col("id") / 40).alias("run"), "id", (F.floor(F.col("id") % 40 / 2) + 1).alias("pos"), "author", F.round(90 - F.col("id") % 40 / 4, 2).alias("score"), "vec")
    return G.reserved(pages)


@query("SELECT vec_id AS id, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total, CAST(len(embedding) AS INT) AS n FROM embeddings")
def snapshot_vectors(spark, sf):
    packed = G.packed_vectors(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), "vec")
    total = F.aggregate(doubles(F.col("vec")), F.lit(0.0), lambda s, x: s + x)
    return G.vectors_of(packed, "packed").select("id", F.round(total, 5).alias("total"), F.size("vec").alias("n"))
