"""Text keys, cleaning, subjects and identifiers."""

from __future__ import annotations

import html
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.functions.vectors import let


def normalize_key(title: Column, author: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as single spaces."""
    joined = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(author, F.lit(""))))
    return F.trim(F.regexp_replace(joined, "[^a-z0-9]+", " "))


def plain_part(value: Column) -> Column:
    """Letters and digits of any script in lower case, the rest as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def folded(value: str | None) -> str:
    """Letters and digits after compatibility normalization and full case folding, the rest as single spaces."""
    plain = unicodedata.normalize("NFKC", value or "").casefold()
    return " ".join("".join(c if c.isalnum() else " " for c in plain).split())


@F.pandas_udf(T.StringType())
def canonical_part(value: pd.Series) -> pd.Series:
    """As ``plain_part`` after normalization and folding, which Spark has not."""
    return value.map(folded)


@F.pandas_udf(T.StringType())
def unescaped(value: pd.Series) -> pd.Series:
    """Character references decoded."""
    return value.map(lambda x: html.unescape(x or ""))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two keys."""
    return pd.Series([SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(left, right, strict=True)])


def without_tags(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(value, "<[^>]*>", " "), r"\s+", " "))


def title_similarity(left: Column, right: Column) -> Column:
    """The larger of token Jaccard and sequence ratio."""
    a, b = F.split(plain_part(left), " "), F.split(plain_part(right), " ")
    jaccard = F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    return F.greatest(jaccard, sequence_ratio(plain_part(left), plain_part(right)))


def subjects(values: Column, limit: int = 8, most: int = 80) -> Column:
    """First ``limit`` labels: tags stripped, list prefixes dropped, distinct by key in order, no bare numbers."""
    clean = F.transform(values, lambda x: F.regexp_replace(without_tags(x), "^nyt:", ""))
    fair = F.filter(clean, lambda x: (F.length(x) <= most) & (F.length(plain_part(x)) >= 2) & ~plain_part(x).rlike("^[0-9 ]+$"))
    both = F.struct(fair.alias("x"), F.transform(fair, plain_part).alias("k"))
    first = let(both, lambda b: F.filter(b["x"], lambda x, i: F.array_position(b["k"], b["k"][i]) == i + 1))
    return F.slice(first, 1, limit)


def subjects_of(raw: Column, limit: int = 8) -> Column:
    """Subjects from a JSON list; text that is no list counts as one label."""
    parsed = F.from_json(raw, "array<string>", {"mode": "PERMISSIVE"})
    is_list = F.try_parse_json(raw).isNotNull() & F.trim(raw).startswith("[")
    return subjects(F.when(is_list, F.filter(parsed, lambda x: x.isNotNull())).otherwise(F.array(raw)), limit)


def isbn13(value: Column) -> Column:
    """The ISBN-13 of a valid ISBN-10 or ISBN-13, else null."""
    bare = F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), "[^0-9Xx]", ""))

    def weighted(digits: Column, weight) -> Column:
        parts = F.transform(F.split(digits, ""), lambda c, i: F.when(c == "X", 10).otherwise(c.try_cast("int")) * weight(i))
        return F.aggregate(parts, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))

    thirteen = bare.rlike("^97[89][0-9]{10}$") & (weighted(bare, lambda i: F.when(i % 2 == 0, 1).otherwise(3)) % 10 == 0)
    ten = bare.rlike("^[0-9]{9}[0-9X]$") & (weighted(bare, lambda i: 10 - i) % 11 == 0)
    stem = F.concat(F.lit("978"), F.substring(bare, 1, 9))
    check = (10 - weighted(stem, lambda i: F.when(i % 2 == 0, 1).otherwise(3)) % 10) % 10
    return F.when(thirteen, bare).when(ten, F.concat(stem, check.cast("string")))


def redacted(message: Column, limit: int = 400) -> Column:
    """URLs in an error message cut down to their host."""
    return F.substring(F.regexp_replace(message, r"(https?://[^/\s?#]+)[^\s]*", "$1"), 1, limit)


def blank_to(*values: Column) -> Column:
    """The first value that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def metadata_confidence(title: Column, author: Column, description: Column, subject_count: Column) -> Column:
    """How much of a catalogue record there is; a record without title or author isn't judged."""
    score = 0.45 + 0.40 * F.least(F.lit(1.0), F.length(F.coalesce(description, F.lit(""))) / 400) + 0.15 * F.least(F.lit(1.0), subject_count / 4)
    return F.when((blank_to(title) == "") | (blank_to(author) == ""), 1.0).otherwise(F.round(score, 4))
