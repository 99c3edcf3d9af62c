"""Dates of mixed forms and precisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "d MMM yyyy HH:mm:ss Z")


def read_time(value: Column) -> Column:
    """Timestamp of ISO, slashed or mail dates, else null. A weekday before a mail date is ignored."""
    bare = F.regexp_replace(F.trim(value), "^[A-Z][a-z]{2},\\s*", "")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in FORMS])


def read_day(value: Column) -> Column:
    return F.to_date(read_time(value))


def day_precision(value: Column) -> Column:
    """Ten characters name a day, not a moment."""
    return F.length(F.trim(value)) == 10


def publication(value: Column) -> Column:
    """struct(date, kind): a day, the first of a month, or the first of a year."""
    v = F.trim(value)
    iso, month, year = v.rlike(r"^\d{4}-\d{2}-\d{2}$"), v.rlike(r"^\d{4}-\d{2}$"), v.rlike(r"^\d{4}$")
    date = F.when(iso, F.try_to_date(v, "yyyy-MM-dd")).when(month, F.try_to_date(F.concat(v, F.lit("-01")), "yyyy-MM-dd")).when(year, F.try_to_date(F.concat(v, F.lit("-01-01")), "yyyy-MM-dd"))
    date = F.coalesce(date, F.try_to_date(v, "MMMM d, yyyy"))
    kind = F.when(date.isNull(), None).when(month, "month").when(year, "year").otherwise("day")
    return F.struct(date.alias("date"), kind.alias("kind"))


def iso_week(ts: Column, zone: str = "UTC") -> Column:
    """YYYY-Www by ISO weeks in a zone."""
    local = F.from_utc_timestamp(ts, zone)
    return F.concat(F.extract(F.lit("YEAROFWEEK"), local).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), local).cast("string"), 2, "0"))


def half_life(age_days: Column, days: float = 730.0) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / days)
