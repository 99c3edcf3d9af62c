"""Scalar functions and sources over the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.functions import dates, identity, text
from quillrank.queries.registry import events, query, rounded
from quillrank.session import table
from quillrank.sources import feeds


@query("SELECT p_partkey AS id, trim(regexp_replace(lower(concat(p_name, ' ', p_brand)), '[^a-z0-9]+', ' ', 'g')) AS key FROM part")
def normalize_key(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.normalize_key(F.col("p_name"), F.col("p_brand")).alias("key"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS key FROM documents")
def plain_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.plain_part(F.col("text")).alias("key"))


@query()
def canonical_keys(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.canonical_part("p_name").alias("key"))


# Titles with suffixes that an identity leaves out, authors with initials written in two ways and a generation.
_NAMED = """n AS (SELECT p_partkey AS id, concat(CASE WHEN p_partkey % 3 = 0 THEN 'The ' ELSE '' END, p_name) AS name, lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', ' ', 'g')) AS brand FROM part)"""
_KEY = "trim(regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


def _named(spark, sf):
    k = F.col("p_partkey")
    suffix = F.when(k % 4 == 0, " (Unabridged)").when(k % 4 == 1, " (A Series, #3)").when(k % 4 == 2, ": The Saga, Book 2").otherwise("")
    title = F.concat(F.when(k % 3 == 0, "The ").otherwise(""), "p_name", suffix)
    author = F.concat(F.when(k % 2 == 0, "R. K. ").otherwise("R.K. "), F.col("p_brand"), F.when(k % 5 == 0, " Jr. III").otherwise(""))
    return table(spark, sf, "part").select(k.alias("id"), title.alias("title"), author.alias("author"))


@query(f"WITH {_NAMED} SELECT id, concat({_KEY}, chr(31), 'rk ', brand, CASE WHEN id % 5 = 0 THEN ' jr iii' ELSE '' END) AS identity, id % 5 <> 0 OR id % 3 <> 1 AS same FROM n")
def sql_identity(spark, sf):
    """The SQL functions: identities, and matches with the plain title by an author without generation or by another."""
    identity.register(spark)
    _named(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand"), "id").createOrReplaceTempView("quillrank_named")
    other = "CASE WHEN id % 5 = 0 AND id % 3 = 1 THEN 'Another' ELSE concat('R K ', p_brand) END"
    return spark.sql(f"SELECT id, book_identity(title, author) AS identity, book_identity_matches(title, author, concat(CASE WHEN id % 3 = 0 THEN 'The ' ELSE '' END, p_name), {other}) AS same FROM quillrank_named")


@query(f"WITH {_NAMED}, k AS (SELECT id, {_KEY} AS key, concat(chr(31), 'rk ', brand) AS author FROM n) SELECT id, list_transform(CASE WHEN id % 3 = 0 AND len(string_split(key, ' ')) >= 4 THEN [key, substr(key, 5)] ELSE [key] END, lambda x: concat('title', chr(31), x, author)) AS keys FROM k")
def identity_keys(spark, sf):
    return _named(spark, sf).select("id", identity.match_keys(F.col("title"), F.col("author")).alias("keys"))


_CODES = "c AS (SELECT p_partkey AS id, concat('978', lpad(CAST(p_partkey * 7919 % 1000000000 AS VARCHAR), 9, '0')) AS stem, p_partkey % 10 AS guess FROM part), d AS (SELECT *, (10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr(stem, i::INT, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10 AS check_digit FROM c)"


@query(f"WITH {_CODES} SELECT id, CASE WHEN check_digit = guess THEN concat(stem, guess) END AS isbn FROM d")
def isbn_check(spark, sf):
    k = F.col("p_partkey")
    stem = F.concat(F.lit("978"), F.lpad(((k * 7919) % 1000000000).cast("string"), 9, "0"))
    return table(spark, sf, "part").select(k.alias("id"), text.isbn13(F.concat(stem, (k % 10).cast("string"))).alias("isbn"))


@query("SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages")
def url_parts(spark, sf):
    part = lambda k: F.coalesce(F.try_parse_url("url", F.lit(k)), F.lit(""))
    return table(spark, sf, "pages").select("page_id", part("PROTOCOL").alias("scheme"), part("HOST").alias("host"), part("PATH").alias("path"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS plain_chars FROM pages")
def parse_pages(spark, sf):
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.length(text.without_tags(h)).cast("long").alias("plain_chars"))


@query("SELECT event_id AS id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, strftime(ts, '%G-W%V') AS week, round(pow(0.5, greatest(0, date_diff('day', CAST(ts AS DATE), DATE '2024-02-01')) / 730.0), 9) AS decay FROM events")
def iso_week_and_decay(spark, sf):
    e = events(spark, sf)
    age = F.datediff(F.lit("2024-02-01").cast("date"), F.to_date("ts")).cast("double")
    return e.select(F.col("event_id").alias("id"), F.to_date("ts").cast("string").alias("day"), dates.iso_week(F.col("ts")).alias("week"), F.round(dates.half_life(age), 9).alias("decay"))


@query("""WITH r AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, o_orderkey % 6 AS k FROM orders)
    SELECT id, CAST(CASE k WHEN 0 THEN d WHEN 1 THEN date_trunc('month', d) WHEN 2 THEN date_trunc('year', d) WHEN 3 THEN d END AS DATE)::VARCHAR AS date, CASE k WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'year' WHEN 3 THEN 'day' END AS kind FROM r""")
def date_precision(spark, sf):
    """Days of orders written in forms of different precision."""
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 6
    form = lambda f: F.date_format(d, f)
    raw = F.when(k == 0, form("yyyy-MM-dd")).when(k == 1, form("yyyy-MM")).when(k == 2, form("yyyy")).when(k == 3, form("MMMM d, yyyy")).when(k == 4, "soon").otherwise("")
    p = dates.publication(F.col("raw"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("raw")).select("id", p["date"].cast("string").alias("date"), p["kind"].alias("kind"))


@query("SELECT doc_id, text IS NULL OR trim(text) = '' AS blank, coalesce(regexp_matches(text, 'https?://'), false) AS has_url, n_chars <> length(text) AS wrong_length, length(text) < 200 AS short FROM documents")
def quality_flags(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", (t.isNull() | (F.trim(t) == "")).alias("blank"), F.coalesce(t.rlike("https?://"), F.lit(False)).alias("has_url"), (F.col("n_chars") != F.length(t)).alias("wrong_length"), (F.length(t) < 200).alias("short"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("SELECT doc_id, list_slice(list_filter(list_distinct_ordered, lambda x: len(x) >= 2), 1, 8) AS labels FROM (SELECT doc_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_ordered FROM (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ') AS w FROM documents))")
def subject_labels(spark, sf):
    """The first labels of whole texts; repeated words go first, as a label counts once."""
    words = F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")), " "))
    return table(spark, sf, "documents").select("doc_id", text.subjects(words).alias("labels"))


@query("SELECT event_id AS id, json_valid(props) AS valid, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.try_parse_json("props").isNotNull().alias("valid"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT p_partkey AS id, round(0.45 + 0.4 * least(1.0, length(p_name) / 400.0::DOUBLE) + 0.15 * least(1.0, (p_size % 6) / 4.0::DOUBLE), 4) AS confidence FROM part")
def metadata_confidence(spark, sf):
    return rounded(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.metadata_confidence(F.col("p_name"), F.col("p_brand"), F.col("p_name"), F.col("p_size") % 6).alias("confidence")))


@query()
def title_similarity(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return p.select(F.col("p_partkey").alias("id"), F.round(text.title_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


# One page per part, in one of seven forms; quotes and angles stand in none of the names.
@query("SELECT concat('https://list.example/2024/', p_partkey) AS url, p_name AS title, CASE WHEN p_partkey % 7 = 1 THEN 'Unknown author' ELSE p_brand END AS author, CASE WHEN p_partkey % 7 = 0 THEN '1987-01-01' WHEN p_partkey % 7 = 4 THEN '1999-12-31' WHEN p_partkey % 7 = 6 THEN '2024-05-03' END AS released FROM part")
def parse_feeds(spark, sf):
    """Subject lists, best sellers, charts, feeds, linked data, cards and editors' lists, each to the same items."""
    k, name, brand = F.col("p_partkey"), F.col("p_name"), F.col("p_brand")
    m = k % 7
    item = lambda **c: F.struct(*[v.alias(n) for n, v in c.items()])
    subject = F.to_json(item(works=F.array(item(title=name, first_publish_year=F.lit("1987"), authors=F.array(item(name=brand))))))
    sellers = F.to_json(item(results=item(lists=F.array(item(list_name=F.lit("Fiction"), books=F.array(item(title=name)))))))
    chart = F.to_json(item(feed=item(results=F.array(item(name=name, artistName=brand)))))
    rss = F.concat(F.lit("<rss><channel><item><title>"), name, F.lit("</title><author_name>"), brand, F.lit("</author_name></item></channel></rss>"))
    linked = F.concat(F.lit('<html><script type="application/ld+json">'), F.to_json(item(**{"@type": F.lit("Book"), "name": name, "author": item(name=brand), "datePublished": F.lit("1999-12-31")})), F.lit("</script></html>"))
    card = F.concat(F.lit('<div><h3 class="book-title">'), name, F.lit('</h3><span class="author-name">by '), brand, F.lit("</span></div>"))
    editor = F.concat(F.lit('<h3><a href="https://shop.example/b">'), name, F.lit("</a> by "), brand, F.lit(", translated by A. Other (May 3rd)</h3>"))
    content = F.when(m == 0, subject).when(m == 1, sellers).when(m == 2, chart).when(m == 3, rss).when(m == 4, linked).when(m == 5, card).otherwise(editor)
    kind = F.when(m <= 2, "application/json").when(m == 3, "application/rss+xml").when(m == 6, "text/html+editorial").otherwise("text/html")
    pages = table(spark, sf, "part").select(F.concat(F.lit("https://list.example/2024/"), k.cast("string")).alias("url"), kind.alias("content_type"), content.alias("content"))
    return feeds.parse(pages).select("url", "title", "author", F.col("release.date").cast("string").alias("released"))


@query("""WITH f AS (SELECT ['to-read', 'currently-reading', 'other'][c_custkey % 3 + 1] AS shelf, c_name AS title, CASE WHEN c_custkey % 4 = 0 THEN 'Unknown author' ELSE c_mktsegment END AS author, CASE WHEN c_custkey % 5 <> 0 THEN 'i' END AS isbn FROM customer WHERE c_custkey % 2 = 0)
    SELECT shelf, title, author, max(isbn) AS isbn FROM f WHERE shelf <> 'other' GROUP BY ALL UNION ALL SELECT 'other', c_name, c_mktsegment, 'old' FROM customer WHERE c_custkey % 3 = 2""")
def shelves_replaced(spark, sf):
    """Two shelves fetched, one failed; each item comes twice, once without its ISBN."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(k, F.col("c_name").alias("title"), F.col("c_mktsegment").alias("author"), F.get(F.array(F.lit("to-read"), F.lit("currently-reading"), F.lit("other")), (k % 3).cast("int")).alias("shelf"))
    none = F.lit(None).cast("string")
    stored = c.select("shelf", "title", "author", F.lit("old").alias("isbn"), none.alias("added_at"))
    item = lambda isbn: F.struct("title", F.when(k % 4 == 0, " ").otherwise(F.col("author")).alias("author"), isbn.alias("isbn"), none.alias("added_at"))
    fetched = c.where(k % 2 == 0).groupBy("shelf").agg(F.flatten(F.collect_list(F.array(item(F.when(k % 5 != 0, "i")), item(none)))).alias("items")).withColumn("ok", F.col("shelf") != "other")
    return feeds.shelves_replaced(stored, fetched).drop("added_at")
