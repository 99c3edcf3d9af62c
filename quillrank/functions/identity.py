"""Identities of works across noisy titles, authors and identifiers.

One set of rules serves columns and SQL: they need compatibility normalization and full
case folding, which Spark has not, so they run over Arrow batches, a whole column at a
time: every rule is a pattern over a column of keys. A null counts as empty; empty parts
stay empty.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.functions.text import folded, isbn13

# Titles that are known in words and in figures.
ALIASES = (
    ("1984", "nineteen eighty four"),
    ("2001", "two thousand one", "two thousand and one"),
    ("catch 22", "catch twenty two"),
    ("fahrenheit 451", "fahrenheit four hundred fifty one"),
    ("slaughterhouse 5", "slaughterhouse five"),
)
# Generations, articles, and what a format or series suffix, a subtitle and its separator look like.
GENERATIONS = ("jr", "sr", "ii", "iii", "iv", "v", "vi")
ARTICLES = ("a", "an", "the")
SUFFIXES = (
    r"\s*\(\s*unabridged\s*\)\s*$",
    r"\s*\([^()]*?(?:#\s*\d+|\bbook\s+\d+|\bvol(?:ume)?\s+\d+)\s*\)\s*$",
    r"\s*:\s*[^:]+,\s*book\s+\d+\s*$",
)
SEPARATOR = r"\s+(?:-|–|—)\s+|\s*:\s*"
SUBTITLE = r"(?:a|an|the)\b"
NUMBERED = r"(?:a|an|the)\s+(?:one|two|three|four|five|first|second|third|fourth|fifth)\b"
# Words of a title that stands without its subtitle, letters of a telling word, words from which an article may go.
PREFIX_WORDS, TELLING, LED_WORDS = 3, 9, 4

# The rules as patterns over folded keys: leading initials, trailing generations, a leading article of a long key.
_INITIALS = r"^(?:\S(?: |$))+"
_GENERATION = rf"(?<=\S)(?: (?:{'|'.join(GENERATIONS)}))+$"
_LED = rf"^(?:{'|'.join(ARTICLES)}) ((?:\S+ ){{{LED_WORDS - 2},}}\S+)$"
_STANDS = rf"^(?:(?:\S+ ){{{PREFIX_WORDS - 1},}}\S+|\S{{{TELLING},}} \S+|\S+ \S{{{TELLING},}})$"
_LEADS_ON = rf"(?!{NUMBERED}){SUBTITLE}"
_SAME = {name: [x for x in group if x != name] for group in ALIASES for name in group}


def _columns(title: pd.Series, author: pd.Series) -> pd.DataFrame:
    """Keys of a batch, a column each: bare title, what of it stands alone, both without their article, author with joined initials and without generation."""
    bare = title.fillna("").map(lambda t: unicodedata.normalize("NFKC", t)).str.strip()
    for suffix in SUFFIXES:
        bare = bare.str.replace(suffix, "", regex=True, case=False).str.strip()
    halves = bare.str.split(SEPARATOR, n=1, regex=True)
    front, rest = halves.str[0], halves.str[1].fillna("").str.strip()
    full, front = bare.map(folded), front.map(folded)
    alone = front.where(front.str.match(_STANDS) & rest.str.match(_LEADS_ON, case=False), "")
    led = lambda key: key.str.extract(_LED, expand=False).fillna("")
    joined = author.map(folded).str.replace(_INITIALS, lambda m: m[0].replace(" ", "") + " ", regex=True).str.strip()
    return pd.DataFrame({"full": full, "alone": alone, "led": led(full), "alone_led": led(alone), "author": joined, "person": joined.str.replace(_GENERATION, "", regex=True)})


def _title_keys(keys: pd.DataFrame) -> pd.Series:
    """All keys of each title, those it is known by in words or figures among them."""
    every = zip(keys["full"], keys["alone"], keys["full"].map(_SAME), keys["alone"].map(_SAME), keys["led"], keys["alone_led"], strict=True)
    return pd.Series([[*dict.fromkeys(filter(None, (full, alone, *(same if same == same else ()), *(other if other == other else ()), led, alone_led)))] for full, alone, same, other, led, alone_led in every], dtype=object)


def _nothing(like: pd.Series) -> pd.Series:
    return pd.Series([""] * len(like), dtype=object)


@F.pandas_udf(T.StringType())
def title_key(title: pd.Series) -> pd.Series:
    """The whole title without format and series suffixes; null for null."""
    return _columns(title, _nothing(title))["full"].where(title.notna(), None)


@F.pandas_udf(T.StringType())
def author_key(author: pd.Series) -> pd.Series:
    """Leading initials joined, generation suffixes dropped."""
    return _columns(_nothing(author), author)["person"]


@F.pandas_udf(T.ArrayType(T.StringType()))
def title_keys(title: pd.Series) -> pd.Series:
    """The full key, a safe key without an article-led subtitle, aliases, and keys without a leading article."""
    return _title_keys(_columns(title, _nothing(title)))


@F.pandas_udf(T.StringType())
def identity(title: pd.Series, author: pd.Series) -> pd.Series:
    """Title and author as one key: generations count, subtitles count."""
    keys = _columns(title, author)
    return keys["full"] + "\x1f" + keys["author"]


@F.pandas_udf(T.BooleanType())
def matches(left_title: pd.Series, left_author: pd.Series, right_title: pd.Series, right_author: pd.Series) -> pd.Series:
    """Whether two rows are one work: authors agree, and some key of their titles."""
    left, right = _columns(left_title, left_author), _columns(right_title, right_author)
    shared = [not set(a).isdisjoint(b) for a, b in zip(_title_keys(left), _title_keys(right), strict=True)]
    return (left["person"] == right["person"]) & pd.Series(shared, dtype=bool)


@F.pandas_udf(T.ArrayType(T.StringType()))
def named_keys(title: pd.Series, author: pd.Series) -> pd.Series:
    """A tagged key per title key, with the author's."""
    keys = _columns(title, author)
    return pd.Series([[f"title\x1f{t}\x1f{person}" for t in titles] for titles, person in zip(_title_keys(keys), keys["person"], strict=True)], dtype=object)


def match_keys(title: Column, author: Column, *isbns: Column) -> Column:
    """Tagged keys of a row: two rows are the same work if any key is shared."""
    codes = [F.concat(F.lit("isbn\x1f"), isbn13(x)) for x in isbns]
    return F.array_compact(F.concat(named_keys(title, author), F.array(*codes) if codes else F.array().cast("array<string>")))


def register(spark: SparkSession) -> None:
    """SQL names for the identity functions: the same rules."""
    spark.udf.register("book_identity", identity)
    spark.udf.register("book_identity_matches", matches)
