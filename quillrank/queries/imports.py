"""Queries of imports and reports: files written to the shared folder from the given tables, read back and cleaned."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillrank.functions.text import blank_to, redacted, unescaped, without_tags
from quillrank.queries.registry import query
from quillrank.session import shared_dir, table
from quillrank.sources import feeds


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# The check digit of 978 and nine digits.
_CHECK = "(10 - (38 + list_sum(list_transform(range(1, 10), lambda i: CAST(substr(lpad(CAST(p_partkey AS VARCHAR), 9, '0'), i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END))) % 10) % 10"


@query(f"""SELECT trim(p_name) AS title, trim(p_brand) AS author, CAST(nullif(p_size % 6, 0) AS INTEGER) AS rating, CASE p_partkey % 3 WHEN 0 THEN '2024/01/05' WHEN 1 THEN '2023/12/01' ELSE '' END AS read_at,
    CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE '978' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || CAST({_CHECK} AS VARCHAR) END AS isbn, CASE p_partkey % 5 WHEN 0 THEN 'to-read' WHEN 1 THEN 'currently-reading' ELSE 'read' END AS shelf FROM part WHERE p_partkey % 7 <> 0""")
def history_import(spark, sf):
    """A reading-history export as a CSV file with quoted commas and line ends, imported whole."""
    key = F.col("p_partkey")
    digits = F.lpad(key.cast("string"), 9, "0")
    total = F.aggregate(F.transform(F.split(digits, ""), lambda c, i: c.cast("int") * F.when(i % 2 == 0, 3).otherwise(1)), F.lit(38), lambda s, x: s + x)
    isbn = F.concat(F.lit("978"), digits, ((10 - total % 10) % 10).cast("string"))
    on = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (key % n).cast("int") + 1)
    rows = table(spark, sf, "part").select(
        F.when(key % 7 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))).alias("Title"), F.col("p_brand").alias("Author"), (F.col("p_size") % 6).cast("string").alias("My Rating"), on(3, "2024/01/05", "", "").alias("Date Read"), on(3, "2020/01/01", "2023/12/01", "").alias("Date Added"),
        on(5, "to-read", "currently-reading", "read", "", " ").alias("Exclusive Shelf"), F.lit('=""').alias("ISBN"), F.when(key % 4 == 0, '="12"').otherwise(F.concat(F.lit('="'), isbn, F.lit('"'))).alias("ISBN13"), F.lit('Liked it, "much"\nand so on').alias("My Review"),
    )
    rows.write.option("header", True).option("escape", '"').csv(path := _folder(spark, "export"))
    lines = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return feeds.reading_history(lines)


@query("""SELECT concat('k', p_partkey) AS item_key, p_name AS title, p_brand AS author, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE concat('b ', p_type) END AS description, concat('http://b/', p_partkey) AS link,
    CASE WHEN p_partkey % 3 = 0 THEN concat('c', p_partkey) END AS cover, CASE WHEN p_partkey % 3 = 0 THEN '2024-05-01' ELSE '2023-01-01' END AS date, CASE WHEN p_partkey % 3 = 0 THEN 'day' ELSE 'year' END AS kind, concat_ws('|', 'All', p_mfgr) AS genres
    FROM (SELECT *, concat('M', p_size % 3) AS p_mfgr FROM part)""")
def merged_records(spark, sf):
    """Two sources' records of every part, merged field by field: blanks filled in page order, the finest date, all genres."""
    key = F.col("p_partkey")
    other = lambda *c: F.array(*c)
    release = lambda d, k: F.struct(F.lit(d).cast("date").alias("date"), F.lit(k).alias("kind"))
    p = table(spark, sf, "part").withColumn("item_key", F.concat(F.lit("k"), key.cast("string")))
    first = p.select("item_key", F.lit("a").alias("url"), F.lit(3).alias("at"), F.col("p_name").alias("title"), F.lit("").alias("author"), F.when(key % 2 == 0, F.col("p_type")).otherwise("").alias("description"), F.lit(None).cast("string").alias("link"), F.lit("").alias("cover"), F.lit(None).cast("string").alias("isbn"), release("2023-01-01", "year").alias("release"), other(F.lit("All")).alias("genres"))
    second = p.select("item_key", F.lit("b").alias("url"), F.lit(1).alias("at"), F.lit("other").alias("title"), F.col("p_brand").alias("author"), F.concat(F.lit("b "), F.col("p_type")).alias("description"), F.concat(F.lit("http://b/"), key.cast("string")).alias("link"), F.when(key % 3 == 0, F.concat(F.lit("c"), key.cast("string"))).alias("cover"), F.lit(None).cast("string").alias("isbn"), F.when(key % 3 == 0, release("2024-05-01", "day")).alias("release"), other(F.lit("All"), F.concat(F.lit("M"), (F.col("p_size") % 3).cast("string"))).alias("genres"))
    m = feeds.merged(first.unionByName(second))
    return m.select("item_key", "title", "author", "description", "link", "cover", F.col("release.date").cast("string").alias("date"), "release.kind", F.array_join("genres", "|").alias("genres"))


@query("SELECT page_id AS id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text, concat('A & B <', page_id, '>') AS title, concat('fetch of https://', split_part(split_part(url, '://', 2), '/', 1), ' failed: timeout') AS error, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN 'given' ELSE '' END AS link FROM pages")
def cleaned_metadata(spark, sf):
    """Whole pages without tags, character references decoded, addresses in errors cut to their host, the first value that isn't blank."""
    k = F.col("page_id")
    link = blank_to(F.when(k % 3 == 0, F.lit("")), F.when(k % 3 == 0, F.col("url")), F.when(k % 3 == 1, F.lit("given")))
    address = F.concat(F.lit("https://"), F.element_at(F.split("url", "://"), 2))
    message = F.concat(F.lit("fetch of "), address, F.lit("?key=secret failed: timeout"))
    return table(spark, sf, "pages").select(k.alias("id"), without_tags(F.col("html")).alias("text"), unescaped(F.concat(F.lit("A &amp; B &lt;"), k.cast("string"), F.lit("&gt;"))).alias("title"), redacted(message).alias("error"), link.alias("link"))


@query("""SELECT concat('{"n":', count(*), ',"nation":"', n_name, '","total":', CAST(CAST(round(sum(c_acctbal::DOUBLE)) AS BIGINT) AS VARCHAR), '}') AS line FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""")
def json_report(spark, sf):
    """A report written as one JSON object per row, as its lines."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    report = c.groupBy(F.col("n_name").alias("nation")).agg(F.round(F.sum(F.col("c_acctbal").cast("double"))).cast("long").alias("total"), F.count(F.lit(1)).alias("n"))
    feeds.write_json(report, path := _folder(spark, "report"))
    return spark.read.text(path).withColumnRenamed("value", "line")
