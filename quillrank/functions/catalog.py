"""Rules on single catalogue records: covers, identifiers in links, labels, features, facets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank.functions.identity import author_key
from quillrank.functions.text import blank_to, isbn13, plain_part, subjects

# Hosts that serve covers, themselves or by a subdomain.
COVER_HOSTS = (
    "covers.openlibrary.org", "images.openlibrary.org", "books.google.com", "books.googleusercontent.com", "googleusercontent.com", "images-na.ssl-images-amazon.com",
    "images.amazon.com", "static01.nyt.com", "penguinrandomhouse.com", "mzstatic.com", "gr-assets.com", "placehold.co",
)
# Subjects that say nothing of a book.
PLAIN_SUBJECTS = (
    "audio books", "audiobook", "audiobooks", "book", "books", "ebook", "ebooks", "fiction", "fiction general", "fiction literature", "general", "general fiction",
    "large type books", "literary", "literature", "nonfiction", "nonfiction general", "novel", "novels",
)
# Label and reliability of an event; reads are labelled by their stars.
EVENT_LABELS = (("save", 1.0, 1.0), ("reject", 0.0, 1.0), ("import", 1.0, 0.7))
MAX_SUBJECTS = 4


def _host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"\.$", "")


def weak_cover(url: Column) -> Column:
    """A placeholder that should be looked for again."""
    host, path = _host(url), F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    return F.coalesce((host == "placehold.co") | ((host == "covers.openlibrary.org") & path.startswith("/b/isbn/")), F.lit(False))


def safe_cover(url: Column, source: Column) -> Column:
    """The URL without its fragment if it is https, without credentials, and of a cover host or the source's own; else ''."""
    host = _host(url)
    known = reduce(lambda a, b: a | b, [(host == h) | host.endswith(f".{h}") for h in COVER_HOSTS])
    fair = (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.try_parse_url(url, F.lit("USERINFO")).isNull() & (known | F.coalesce(host == _host(source), F.lit(False)))
    return F.when(F.coalesce(fair, F.lit(False)), F.regexp_replace(url, "#.*$", "")).otherwise("")


def store_isbn(url: Column) -> Column:
    """The ISBN-13 that a store's product link names in its path or query, else null. Only hosts with the store's label count."""
    # By pattern: a link with a stray % isn't a URL to Spark's parser, but stores serve it.
    part = lambda n: F.coalesce(F.regexp_extract(url, r"^(?i)https?://(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^?#]*)(?:\?([^#]*))?", n), F.lit(""))
    path = F.url_decode(F.regexp_replace(part(2), "%(?![0-9A-Fa-f]{2})", "%25"))
    named = F.regexp_extract_all(path, F.lit(r"(?i)/(?:dp|gp/(?:product|aw/d|aw/dp))/([^/?#]+)"), F.lit(1))
    asked = F.regexp_extract_all(part(3), F.lit(r"(?i)(?:^|&)(?:isbn13|isbn10|isbn|asin)=([^&]+)"), F.lit(1))
    codes = F.array_compact(F.transform(F.concat(named, asked), isbn13))
    return F.when(F.array_contains(F.split(F.lower(part(1)), r"\."), "amazon"), F.get(codes, 0))


def cover_of(kind: str, value: Column, size: str = "L") -> Column:
    """The cover URL of a cover id or an ISBN; blank stays ''."""
    text = blank_to(F.trim(value.cast("string")))
    return F.when(text == "", "").otherwise(F.concat(F.lit(f"https://covers.openlibrary.org/b/{kind}/"), F.url_encode(text), F.lit(f"-{size}.jpg")))


def work_key(value: Column, letter: str = "W", folder: str = "works") -> Column:
    """A work's (or author's) canonical key from a bare id, a path or the catalogue's own URL; else ''."""
    v = F.trim(F.coalesce(value, F.lit("")))
    link = v.rlike("^https?://")
    path = F.when(link & _host(v).isin("openlibrary.org", "www.openlibrary.org"), F.coalesce(F.try_parse_url(v, F.lit("PATH")), F.lit(""))).when(link, "").otherwise(v)
    code = blank_to(F.regexp_extract(path, rf"(?i)^(OL\d+{letter})$", 1), F.regexp_extract(path, rf"(?i)^/{folder}/(OL\d+{letter})(?:\.json)?$", 1))
    return F.when(code == "", "").otherwise(F.concat(F.lit(f"/{folder}/"), F.upper(code)))


def event_label(kind: Column, value: Column) -> Column:
    """struct(label, reliability): what an event says of liking; neutral events have no label."""
    fair = (kind == "read") & ~F.isnan(value) & (F.abs(value) != float("inf"))
    stars = ((value >= 5, 1.0, 1.0), (value >= 4, 1.0, 0.85), (value <= 1, 0.0, 1.0), (value <= 2, 0.0, 0.85))
    label, reliability = F.lit(None).cast("double"), F.lit(0.0)
    # The first rule that holds counts, so it is laid on last.
    for when, a, b in reversed([*((kind == k, a, b) for k, a, b in EVENT_LABELS), *((fair & test, a, b) for test, a, b in stars)]):
        label, reliability = F.when(when, a).otherwise(label), F.when(when, b).otherwise(reliability)
    return F.struct(label.alias("label"), reliability.alias("reliability"))


def outcome_label(rating: Column) -> Column:
    """struct(label, kind, confidence) of a read that was shown before; a read without stars counts as weak liking."""
    told = lambda a, b, c: F.struct(F.lit(a).alias("label"), F.lit(b).alias("kind"), F.lit(c).alias("confidence"))
    return F.when(rating.isNull() | F.isnan(rating), told(0.75, "completed_unrated", 0.4)).when(rating >= 4, told(1.0, "rating_positive", 1.0)).when(rating <= 2, told(0.0, "rating_negative", 1.0)).otherwise(told(0.5, "rating_neutral", 0.25))


def book_features(author: Column, genres: Column, released: Column) -> Column:
    """Sorted features of a book: its author, up to four telling subjects, its era. 2000 to 2019 is no era."""
    a = author_key(author)
    keys = F.transform(subjects(F.coalesce(genres, F.array().cast("array<string>"))), plain_part)
    telling = F.slice(F.array_distinct(F.filter(keys, lambda k: ~k.isin(*PLAIN_SUBJECTS) & (F.length(k) >= 3))), 1, MAX_SUBJECTS)
    year = F.regexp_extract(F.trim(F.coalesce(released, F.lit(""))), r"^(\d{4})", 1).try_cast("int")
    era = F.when(year.between(1000, 1950), "era:pre_1950").when(year.between(1951, 1999), "era:1950_1999").when(year.between(2020, 2100), "era:2020_plus")
    return F.array_sort(F.array_compact(F.concat(F.array(F.when(a != "", F.concat(F.lit("author:"), a)), era), F.transform(telling, lambda k: F.concat(F.lit("subject:"), k)))))


def embedding_text(title: Column, author: Column, description: Column, genres: Column) -> Column:
    """What of a candidate is embedded: its parts without blanks, subjects last."""
    list_ = F.array_join(subjects(F.coalesce(genres, F.array().cast("array<string>"))), "; ")
    parts = [F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")) for c in (title, author, description)]
    return F.concat_ws(" ", *parts, F.when(list_ != "", F.concat(F.lit("Subjects: "), list_)))


def complete(description: Column, cover: Column, source: Column, released: Column, genres: Column) -> Column:
    """A record with a description, a real cover, a date and subjects."""
    some = F.size(subjects(F.coalesce(genres, F.array().cast("array<string>")))) > 0
    return (blank_to(F.trim(description)) != "") & some & (blank_to(F.trim(released)) != "") & ~weak_cover(cover) & (safe_cover(cover, source) != "")


def served(score: Column) -> Column:
    """A score cut to 0..100 and rounded to the nearest tenth of its exact binary value, true ties to even.

    Spark rounds the shortest decimal text, which takes 0.15 (a little less in binary) up.
    """
    x = F.least(F.lit(100.0), F.greatest(F.lit(0.0), score))
    low = F.floor(x * 10)
    near = F.when(F.abs(x * 10 - low - 0.5) < 1e-9, F.bround(x, 1)).otherwise(F.round(x, 1))
    # Only quarters are ties in binary: other values near a half lie on one side of it.
    side = (x - low / 10.0) - 0.05
    tie = (x * 4) == F.floor(x * 4)
    return F.when(F.isnan(score), score).otherwise(F.when((F.abs(side) < 1e-9) & ~tie, F.when(_above_half(x, low), (low + 1) / 10.0).otherwise(low / 10.0)).otherwise(near))


def _above_half(x: Column, low: Column) -> Column:
    """Whether x lies above low/10 + 1/20: 20x against the odd number 2 low + 1, by the part that the product's rounding lost (x split in two halves)."""
    high = F.floor(x * 65536.0) / 65536.0
    return ((high * 20.0 - (2 * low + 1)) + (x - high) * 20.0) > 0


def cues(text: Column, phrases: dict[str, tuple[str, ...]], negators: tuple[str, ...] = ("not", "no", "never", "without")) -> Column:
    """Sorted labels one of whose phrases stands in the text as whole words, without a negator among the three words before it."""

    def told(words: tuple[str, ...]) -> Column:
        either = "|".join(map(_escaped, words))
        free = rf"(?is)(?<!\w)(?:{either})(?!\w)"
        denied = rf"(?is)(?<!\w)(?:{'|'.join(map(_escaped, negators))})(?:\W+\w+){{0,2}}\W+(?:{either})(?!\w)"
        return F.regexp_replace(F.coalesce(text, F.lit("")), denied, " ").rlike(free)

    return F.array_sort(F.array_compact(F.array(*[F.when(told(words), label) for label, words in phrases.items()])))


def _escaped(word: str) -> str:
    return "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in word)
