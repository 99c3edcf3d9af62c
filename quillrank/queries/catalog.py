"""Queries of the rules on single catalogue records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.functions import catalog as K
from quillrank.queries.registry import query
from quillrank.session import table

PHRASES = {"size": ("small", "large"), "colour": ("red", "blue", "green"), "shape": ("ring", "widget")}


def _parts(spark, sf):
    return table(spark, sf, "part").withColumn("k", F.col("p_partkey"))


@query("""SELECT p_partkey AS id, p_partkey % 6 IN (0, 1) AS weak, CASE p_partkey % 6 WHEN 0 THEN concat('https://covers.openlibrary.org/b/isbn/', p_partkey, '-L.jpg') WHEN 1 THEN 'https://placehold.co/9' WHEN 2 THEN concat('https://is1.mzstatic.com/', p_partkey) WHEN 5 THEN concat('https://shop.example/', p_partkey) ELSE '' END AS safe FROM part""")
def cover_urls(spark, sf):
    p, k = _parts(spark, sf), F.col("k").cast("string")
    m = F.col("k") % 6
    url = F.when(m == 0, F.concat(F.lit("https://covers.openlibrary.org/b/isbn/"), k, F.lit("-L.jpg"))).when(m == 1, "https://placehold.co/9").when(m == 2, F.concat(F.lit("https://is1.mzstatic.com/"), k, F.lit("#top"))).when(m == 3, "http://books.google.com/x").when(m == 4, "https://me:pw@books.google.com/x").otherwise(F.concat(F.lit("https://shop.example/"), k))
    return p.select(F.col("k").alias("id"), K.weak_cover(url).alias("weak"), K.safe_cover(url, F.lit("https://SHOP.example/list")).alias("safe"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 IN (0, 1) THEN '9780306406157' END AS isbn FROM part""")
def store_link_isbn(spark, sf):
    m = F.col("k") % 4
    url = F.when(m == 0, "https://www.amazon.co.uk/Some-Title/dp/0306406152?x=1").when(m == 1, "https://amazon.com/s?k=2&ISBN13=9780306406157").when(m == 2, "https://amazon.evil/dp/0306406153").otherwise("https://shop.example/dp/0306406152")
    return _parts(spark, sf).select(F.col("k").alias("id"), K.store_isbn(url).alias("isbn"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 < 3 THEN concat('/works/OL', p_partkey, 'W') ELSE '' END AS work, CASE WHEN p_partkey % 2 = 0 THEN concat('/authors/OL', p_partkey, 'A') ELSE '' END AS author FROM part""")
def catalog_keys(spark, sf):
    k, m = F.col("k").cast("string"), F.col("k") % 5
    work = F.when(m == 0, F.concat(F.lit("ol"), k, F.lit("w"))).when(m == 1, F.concat(F.lit("/works/OL"), k, F.lit("W.json"))).when(m == 2, F.concat(F.lit("https://www.openlibrary.org/works/OL"), k, F.lit("W"))).when(m == 3, F.concat(F.lit("https://evil.example/works/OL"), k, F.lit("W"))).otherwise(F.concat(F.lit("/works/OL"), k, F.lit("W/x")))
    author = F.concat(F.lit("OL"), k, F.when(F.col("k") % 2 == 0, "A").otherwise("W"))
    return _parts(spark, sf).select(F.col("k").alias("id"), K.work_key(work).alias("work"), K.work_key(author, "A", "authors").alias("author"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('https://covers.openlibrary.org/b/id/', p_partkey, '-L.jpg') END AS cover FROM part""")
def cover_builders(spark, sf):
    return _parts(spark, sf).select(F.col("k").alias("id"), K.cover_of("id", F.when(F.col("k") % 3 != 0, F.col("k"))).alias("cover"))


@query("""WITH e AS (SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN 'save' WHEN 'error' THEN 'reject' WHEN 'signup' THEN 'import' WHEN 'click' THEN 'read' ELSE 'maybe_later' END AS kind, event_id % 6 AS stars FROM events)
    SELECT id, CASE WHEN kind IN ('save', 'import') THEN 1.0 WHEN kind = 'reject' THEN 0.0 WHEN kind = 'read' AND stars >= 4 THEN 1.0 WHEN kind = 'read' AND stars <= 2 THEN 0.0 END::DOUBLE AS label,
    CASE WHEN kind IN ('save', 'reject') THEN 1.0 WHEN kind = 'import' THEN 0.7 WHEN kind = 'read' AND stars IN (0, 1, 5) THEN 1.0 WHEN kind = 'read' AND stars IN (2, 4) THEN 0.85 ELSE 0 END::DOUBLE AS reliability FROM e""")
def event_labels(spark, sf):
    t = F.col("event_type")
    kind = F.when(t == "purchase", "save").when(t == "error", "reject").when(t == "signup", "import").when(t == "click", "read").otherwise("maybe_later")
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), K.event_label(kind, (F.col("event_id") % 6).cast("double")).alias("x")).select("id", "x.*")


@query("""SELECT kind, count(*) AS n, min(label)::DOUBLE AS label, min(confidence)::DOUBLE AS confidence FROM (SELECT CASE WHEN p_size % 6 = 0 THEN 'completed_unrated' WHEN p_size % 6 >= 4 THEN 'rating_positive' WHEN p_size % 6 <= 2 THEN 'rating_negative' ELSE 'rating_neutral' END AS kind, CASE WHEN p_size % 6 = 0 THEN 0.75 WHEN p_size % 6 >= 4 THEN 1 WHEN p_size % 6 <= 2 THEN 0 ELSE 0.5 END AS label, CASE WHEN p_size % 6 = 0 THEN 0.4 WHEN p_size % 6 = 3 THEN 0.25 ELSE 1 END AS confidence FROM part) GROUP BY kind""")
def outcome_labels(spark, sf):
    rating = F.nullif((F.col("p_size") % 6).cast("double"), F.lit(0.0))
    o = _parts(spark, sf).select(K.outcome_label(rating).alias("o")).select("o.*")
    return o.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("label"), F.min("confidence").alias("confidence"))


@query("""SELECT feature, count(*) AS n FROM (SELECT unnest(list_filter([concat('author:', trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g'))), concat('subject:', lower(p_type)), CASE WHEN p_partkey % 4 = 0 THEN 'subject:red herrings' END, CASE WHEN p_partkey % 130 + 1930 <= 1950 THEN 'era:pre_1950' WHEN p_partkey % 130 + 1930 < 2000 THEN 'era:1950_1999' WHEN p_partkey % 130 + 1930 >= 2020 THEN 'era:2020_plus' END], lambda x: x IS NOT NULL)) AS feature FROM part) GROUP BY feature""")
def book_features(spark, sf):
    year = (F.col("k") % 130 + 1930).cast("string")
    genres = F.array(F.lit("Fiction"), F.col("p_type"), F.when(F.col("k") % 4 == 0, "Red Herrings").otherwise("Novels"))
    return _parts(spark, sf).select(F.explode(K.book_features(F.col("p_brand"), genres, F.concat(year, F.lit("-05-01")))).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey AS id, concat(p_name, ' ', p_brand, CASE WHEN p_partkey % 2 = 0 THEN ' about' ELSE '' END, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(' Subjects: ', p_type, '; Kitchen') END) AS text FROM part""")
def embedding_texts(spark, sf):
    genres = F.when(F.col("k") % 3 != 0, F.array(F.col("p_type"), F.lit("Kitchen"), F.col("p_type")))
    return _parts(spark, sf).select(F.col("k").alias("id"), K.embedding_text(F.col("p_name"), F.col("p_brand"), F.when(F.col("k") % 2 == 0, " about ").otherwise(" "), genres).alias("text"))


@query("SELECT p_partkey % 2 = 0 AND p_partkey % 3 = 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AS complete, count(*) AS n FROM part GROUP BY 1")
def record_completeness(spark, sf):
    k = F.col("k")
    cover = F.when(k % 5 == 0, "https://placehold.co/1").otherwise("https://books.google.com/c")
    whole = K.complete(F.when(k % 2 == 0, "about").otherwise(" "), cover, F.lit(""), F.when(k % 7 != 0, "2001"), F.when(k % 3 == 0, F.array("p_type")))
    return _parts(spark, sf).groupBy(whole.alias("complete")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS id, round_even(least(100, greatest(0, floor(c_acctbal) / 8)), 1)::DOUBLE AS score FROM customer")
def served_scores(spark, sf):
    """Eighths, so that quarters, which are the only ties, occur."""
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), K.served(F.floor("c_acctbal") / 8.0).alias("score"))


@query("""WITH t AS (SELECT p_partkey AS id, concat(CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'This is not a very ' WHEN 2 THEN 'never, ever was it known as ' ELSE 'no: ' END, p_name) AS x, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_partkey % 4 AS m FROM part)
    SELECT id, list_sort(list_filter([CASE WHEN a IN ('small', 'large') AND m NOT IN (1, 3) THEN 'size' END, CASE WHEN a IN ('red', 'blue', 'green') AND m NOT IN (1, 3) THEN 'colour' END, CASE WHEN b IN ('ring', 'widget') AND m NOT IN (3) THEN 'shape' END], lambda v: v IS NOT NULL)) AS labels FROM t""")
def text_cues(spark, sf):
    m = F.col("k") % 4
    text = F.concat(F.when(m == 0, "").when(m == 1, "This is not a very ").when(m == 2, "never, ever was it known as ").otherwise("no: "), F.col("p_name"))
    return _parts(spark, sf).select(F.col("k").alias("id"), K.cues(text, PHRASES).alias("labels"))
