"""Catalogue feeds: JSON, RSS, JSON-LD and HTML to one item struct.

Parsers take a table of fetched bytes as text (url, content_type, content); fetching
isn't done here. JSON shapes are projected by schema in the JVM; markup goes through one
Arrow parser. Items without a title are left out.
"""

from __future__ import annotations

import html
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions.dates import publication
from quillrank.functions.text import blank_to, isbn13, normalize_key, subjects, without_tags
from quillrank.operators.windows import first_per

ITEM = "url string, at int, title string, author string, description string, link string, cover string, released string, genres array<string>, isbn string"
_SUBJECTS = "works array<struct<title:string,key:string,first_publish_year:string,description:string,cover_id:long,subject:array<string>,authors:array<struct<name:string>>>>"
_LISTS = "results struct<lists:array<struct<list_name:string,books:array<struct<title:string,author:string,description:string,book_image:string,primary_isbn13:string,primary_isbn10:string>>>>>"
_CHART = "feed struct<results:array<struct<name:string,artistName:string,url:string,artworkUrl100:string,releaseDate:string,genres:array<struct<name:string>>>>>"


def subject_works(pages: DataFrame) -> DataFrame:
    """Subject listings: works[]."""
    w = pages.select("url", F.posexplode(F.from_json("content", _SUBJECTS)["works"]).alias("at", "w"))
    cover = F.when(F.col("w.cover_id").isNotNull(), F.concat(F.lit("https://covers.openlibrary.org/b/id/"), F.col("w.cover_id").cast("string"), F.lit("-L.jpg")))
    return _items(w, F.col("w.title"), F.col("w.authors")[0]["name"], F.col("w.description"), F.col("w.key"), cover, F.col("w.first_publish_year"), F.col("w.subject"), F.lit(None).cast("string"))


def best_seller_lists(pages: DataFrame) -> DataFrame:
    """Best-seller overviews: results.lists[].books[], the list's name as genre."""
    lists = pages.select("url", F.posexplode(F.from_json("content", _LISTS)["results"]["lists"]).alias("l_at", "l"))
    b = lists.select("url", "l", "l_at", F.posexplode("l.books").alias("b_at", "b")).withColumn("at", F.col("l_at") * 1000 + F.col("b_at"))
    return _items(b, F.col("b.title"), F.col("b.author"), F.col("b.description"), F.lit(None).cast("string"), F.col("b.book_image"), F.lit(None).cast("string"), F.array("l.list_name"), F.coalesce("b.primary_isbn13", "b.primary_isbn10"))


def charts(pages: DataFrame) -> DataFrame:
    """Store charts: feed.results[]."""
    r = pages.select("url", F.posexplode(F.from_json("content", _CHART)["feed"]["results"]).alias("at", "r"))
    return _items(r, F.col("r.name"), F.col("r.artistName"), F.lit(None).cast("string"), F.col("r.url"), F.col("r.artworkUrl100"), F.col("r.releaseDate"), F.transform("r.genres", lambda g: g["name"]), F.lit(None).cast("string"))


def _items(df: DataFrame, title: Column, author: Column, description: Column, link: Column, cover: Column, released: Column, genres: Column, isbn: Column) -> DataFrame:
    cleaned = lambda c, n: F.substring(without_tags(c), 1, n)
    named = df.withColumn("_t", cleaned(title, 500)).where("_t != ''")
    return named.select(
        "url", "at", F.col("_t").alias("title"), F.coalesce(F.nullif(cleaned(author, 300), F.lit("")), F.lit("Unknown author")).alias("author"), cleaned(description, 4000).alias("description"),
        link.alias("link"), cover.alias("cover"), released.alias("released"), subjects(F.coalesce(genres, F.array().cast("array<string>"))).alias("genres"), isbn13(isbn).alias("isbn"),
    )


_LD = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", re.S | re.I)


def _text(value) -> str:
    if isinstance(value, list):
        return ", ".join(filter(None, map(_text, value)))
    if isinstance(value, dict):
        return _text(value.get("name") or value.get("@id") or "")
    return "" if value is None else str(value)


def linked_nodes(value) -> Iterator[dict]:
    """Every object of a JSON value, depth first, the outer before the inner."""
    if isinstance(value, dict):
        yield value
        for v in value.values():
            yield from linked_nodes(v)
    elif isinstance(value, list):
        for v in value:
            yield from linked_nodes(v)


def _linked_books(page: str) -> Iterator[dict]:
    for m in _LD.finditer(page):
        try:
            payload = json.loads(m[1])
        except ValueError:
            continue
        for node in linked_nodes(payload):
            kinds = node.get("@type")
            if {"Book", "Audiobook"} & set(kinds if isinstance(kinds, list) else [kinds]):
                genre = node.get("genre") or []
                yield {"title": _text(node.get("name")), "author": _text(node.get("author")), "description": _text(node.get("description")), "link": _text(node.get("url") or node.get("@id")), "cover": _text(node.get("image")), "released": _text(node.get("datePublished")), "genres": [_text(g) for g in (genre if isinstance(genre, list) else [genre])], "isbn": _text(node.get("isbn"))}


def _feed_entries(page: str) -> Iterator[dict]:
    try:
        root = ET.fromstring(page)
    except ET.ParseError:
        return
    local = lambda e: e.tag.rpartition("}")[2].lower()
    for entry in (e for e in root.iter() if local(e) in ("item", "entry")):
        found: dict[str, str] = {}
        for child in entry:
            found.setdefault(local(child), "".join(child.itertext()).strip() or child.attrib.get("href", ""))
        yield {"title": found.get("title"), "author": found.get("author_name") or found.get("author") or found.get("creator"), "description": found.get("description") or found.get("summary") or found.get("book_description"), "link": found.get("link"), "cover": found.get("book_image_url"), "released": found.get("pubdate") or found.get("published") or found.get("book_published"), "genres": [], "isbn": found.get("isbn")}


_CARD = re.compile(r"<h([1-4])[^>]*(?:book-title|itemprop=[\"']name)[^>]*>(.*?)</h\1>(.*?)(?=<h[1-4][^>]*(?:book-title|itemprop=[\"']name)|\Z)", re.S | re.I)
_BY = re.compile(r"(?:author-name|itemprop=[\"']author)[^>]*>(.*?)<", re.S | re.I)
_PAIR = re.compile(r"<h([2-4])[^>]*>(.*?)</h\1>\s*<(p|div|span)[^>]*>\s*by\s+(.*?)</\3>", re.S | re.I)


def _cards(page: str) -> Iterator[dict]:
    plain = lambda x: " ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split())
    found = False
    for m in _CARD.finditer(page):
        by = _BY.search(m[3])
        found = True
        yield {"title": plain(m[2]), "author": re.sub(r"^by\s+", "", plain(by[1]) if by else "", flags=re.I)}
    if not found:
        for m in _PAIR.finditer(page):
            yield {"title": plain(m[2]), "author": plain(m[4])}


# How a list names its authors and translators, and the months of its dates.
_BYLINE, _TRANSLATED = re.compile(r"\s+(?:edited\s+by|by)\s+", re.I), re.compile(r"(?:,|\s+and)\s+translated\s+by\s+", re.I)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_DAY = re.compile(rf"\b({'|'.join(MONTHS)})\s+(\d{{1,2}})(?:st|nd|rd|th)?\b", re.I)
_HEADING, _LINK = re.compile(r"<h([2-4])\b[^>]*>(.*?)</h\1>", re.S | re.I), re.compile(r"<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</a>", re.S | re.I)


def plain_text(markup: str) -> str:
    return " ".join(html.unescape(re.sub("<[^>]*>", " ", markup)).split())


def editorial_items(page: str, url: str, own_hosts: tuple[str, ...] = ()) -> Iterator[dict]:
    """Books of an editor's list: headings that link to shops and say by whom, the date in parentheses at the end.

    Links to the list's own hosts are no books; a title cut over several links of one
    target is one; with several books in a heading the words before the first belong to each.
    """
    year = re.search(r"\b(20\d{2})\b", url or "")
    for heading in _HEADING.finditer(page):
        links = [m for m in _LINK.finditer(heading[2]) if re.match("https?://", m[1], re.I) and re.sub(r"^https?://([^/?#:]*).*$", r"\1", m[1].lower(), flags=re.S).rstrip(".") not in own_hosts]
        text = plain_text(heading[2])
        by = _BYLINE.search(text)
        if not links or not by:
            continue
        author, date = text[by.end() :], re.search(r"\s+\(([^()]*)\)\s*$", text[by.end() :])
        if date:
            author = author[: date.start()]
        author = _TRANSLATED.split(author, maxsplit=1)[0].strip()
        day = _DAY.search(date[1]) if date else None
        released = f"{year[1]}-{MONTHS.index(day[1].lower()) + 1:02d}-{int(day[2]):02d}" if day and year else None
        targets: list[list[str]] = []
        for m in links:
            if targets and targets[-1][0] == m[1]:
                targets[-1][1] += " " + plain_text(m[2])
            else:
                targets.append([m[1], plain_text(m[2])])
        before = plain_text(heading[2][: links[0].start()]) if len(targets) > 1 else ""
        for link, title in targets:
            if title and author:
                yield {"title": f"{before} {title}".strip(), "author": author, "link": link, "released": released}


#: Items that a page gives at most, as its site's list would show.
MAX_ITEMS = 250


def marked_up(pages: DataFrame) -> DataFrame:
    """RSS or Atom entries; else linked-data books; else book cards and heading pairs of a page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["title", "author", "description", "link", "cover", "released", "genres", "isbn"]
        for pdf in batches:
            out = []
            for url, kind, content in zip(pdf["url"], pdf["content_type"], pdf["content"], strict=True):
                content = content or ""
                items = list(_feed_entries(content)) if re.search("xml|rss|atom", kind or "") else list(editorial_items(content, url)) if (kind or "").endswith("+editorial") else list(_linked_books(content)) or list(_cards(content))
                out += [(url, n, *(x.get(c) for c in names)) for n, x in enumerate(items[:MAX_ITEMS]) if x.get("title")]
            yield pd.DataFrame(out, columns=["url", "at", *names])

    return pages.select("url", "content_type", "content").mapInPandas(run, ITEM)


def parse(pages: DataFrame) -> DataFrame:
    """All items of all pages: JSON by its shape, the rest by its markup; the first of equal keys per page."""
    is_json = F.coalesce(F.col("content_type").contains("json"), F.lit(False))
    j = pages.where(is_json)
    found = subject_works(j).unionByName(best_seller_lists(j)).unionByName(charts(j)).unionByName(marked_up(pages.where(~is_json)))
    keyed = found.withColumn("item_key", normalize_key(F.col("title"), F.col("author")))
    dated = keyed.withColumn("release", publication(F.substring(F.coalesce("released", F.lit("")), 1, 10)))
    return first_per(dated, ["url", "item_key"], [F.col("at")])


def merged(items: DataFrame) -> DataFrame:
    """One record per key: blanks filled in page order, the finest date, all genres."""
    fineness = F.when(F.col("release.kind") == "day", 3).when(F.col("release.kind") == "month", 2).when(F.col("release.kind") == "year", 1).otherwise(0)
    order = F.struct("url", "at")
    pick = lambda c: F.min_by(F.nullif(c, F.lit("")), F.when(F.nullif(c, F.lit("")).isNotNull(), order))
    return items.groupBy("item_key").agg(*[pick(c).alias(c) for c in ("title", "author", "description", "link", "cover", "isbn")], F.max_by("release", F.struct(fineness, F.col("url"))).alias("release"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("genres")))).alias("genres"))


def filtered(items: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Genre phrases as whole words: including drops items without genres, excluding alone keeps them."""
    text = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.array_join("genres", " | ")), r"[^\p{L}\p{N}|]+", " "), F.lit(" "))
    any_of = lambda phrases: F.lit(False) if not phrases else F.greatest(*[F.contains(text, F.lit(f" {p.lower()} ")) for p in [*phrases, phrases[0]]])
    out = items.where(~any_of(exclude))
    return out.where(any_of(include)) if include else out


def reading_history(lines: DataFrame) -> DataFrame:
    """Rows of a reading-history export (strings by header): shelves routed, ISBNs bared, rating 0 as none.

    A rating that is no whole number from 0 to 5 fails the whole import.
    """
    rating = F.trim("My Rating").try_cast("int")
    fair = F.coalesce(rating.between(0, 5), F.trim(F.coalesce("My Rating", F.lit(""))) == "")
    checked = F.when(fair, F.nullif(rating, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("bad rating: "), F.col("My Rating"))).cast("int"))
    code = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), '[="]', "")
    shelf = F.coalesce(F.nullif(F.trim("Exclusive Shelf"), F.lit("")), F.lit("read"))
    return lines.select(F.trim("Title").alias("title"), F.trim("Author").alias("author"), checked.alias("rating"), blank_to(F.col("Date Read"), F.col("Date Added")).alias("read_at"), isbn13(blank_to(code("ISBN13"), code("ISBN"))).alias("isbn"), shelf.alias("shelf")).where("title != '' and author != ''")


# The shelves beside the one of finished books.
SHELVES = ("to-read", "currently-reading")


def shelf_url(read_url: Column, shelf: str) -> Column:
    """The address of another shelf's feed, from that of the finished books."""
    if shelf not in SHELVES:
        raise ValueError(f"no such shelf: {shelf}")
    base, query = F.regexp_extract(read_url, r"^([^?#]*)", 1), F.regexp_extract(read_url, r"\?([^#]*)", 1)
    others = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike("^shelf(=|$)"))
    return F.concat(base, F.lit("?"), F.array_join(F.concat(others, F.array(F.lit(f"shelf={shelf}"))), "&"))


def shelves_replaced(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """Shelf items after a fetch: a shelf that was fetched is replaced whole, one whose fetch failed stays.

    Items of one title and author are one, blanks filled. stored: shelf, title, author,
    isbn, added_at; fetched: shelf, ok, items array of struct(title, author, isbn, added_at).
    """
    good = fetched.where("ok")
    rows = good.select("shelf", F.posexplode("items").alias("_n", "i")).select("shelf", "_n", F.trim("i.title").alias("title"), blank_to(F.trim("i.author"), F.lit("Unknown author")).alias("author"), "i.isbn", "i.added_at").where("title != ''")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_n"))).alias(c)
    one = rows.groupBy("shelf", "title", "author").agg(last("isbn"), last("added_at"))
    return stored.join(good.select("shelf").distinct(), "shelf", "left_anti").select("shelf", "title", "author", "isbn", "added_at").unionByName(one)


def write_json(report: DataFrame, path: str) -> None:
    """A report as one JSON object per row."""
    report.select(F.to_json(F.struct(*sorted(report.columns))).alias("value")).write.mode("overwrite").text(path)
