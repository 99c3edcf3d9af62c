"""Validation as predicates and as violation counts; states and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.text import blank_to, plain_part

# Fixed value: what may be logged.
EVENT_TYPES = ("visible", "open", "save", "reject", "maybe_later", "import", "read", "undo", "click", "dismiss")


def title_flags(title: Column, author: Column, url: Column) -> Column:
    """Sorted defects of a record: missing or noise title, missing or unknown author, title as author, URL in title, bad scheme."""
    t, a = plain_part(title), plain_part(author)
    flags = [
        F.when(blank_to(F.trim(title)) == "", "missing_title"),
        F.when((blank_to(F.trim(title)) != "") & (t == ""), "noise_title"),
        F.when(a.isin("", "unknown", "unknown author"), "missing_author"),
        F.when((t != "") & (t == a), "title_is_author"),
        F.when(F.coalesce(title, F.lit("")).rlike("(?i)https?://|www\\."), "url_in_title"),
        F.when((blank_to(url) != "") & ~F.coalesce(url, F.lit("")).rlike("^https?://"), "bad_scheme"),
    ]
    return F.array_sort(F.array_compact(F.array(*flags)))


def event_fault(key: Column, kind: Column, value: Column, metadata: Column, kinds: tuple[str, ...] = EVENT_TYPES) -> Column:
    """Why an event can't be logged, or null."""
    return (
        F.when(~F.coalesce(key.rlike("^[A-Za-z0-9:_.-]{8,128}$"), F.lit(False)), "key")
        .when(~F.coalesce(kind.isin(*kinds), F.lit(False)), "type")
        .when(F.isnan(value) | (F.abs(value) == float("inf")), "value")
        .when(F.octet_length(F.coalesce(metadata, F.lit("{}"))) > 4096, "metadata")
    )


def slot_violations(rows: DataFrame, run: str, rank: str, item: str) -> DataFrame:
    """Per run: ranks that aren't positive, ranks that two items share, items on two ranks."""
    valid = F.col(rank) >= 1
    ranks = rows.where(valid).groupBy(run, rank).agg(F.count_distinct(item).alias("n")).groupBy(run).agg(F.count_if(F.col("n") > 1).alias("shared_ranks"))
    items = rows.where(valid).groupBy(run, item).agg(F.count_distinct(rank).alias("n")).groupBy(run).agg(F.count_if(F.col("n") > 1).alias("moved_items"))
    bad = rows.groupBy(run).agg(F.count_if(~F.coalesce(valid, F.lit(False))).alias("bad_ranks"))
    return bad.join(ranks, run, "left").join(items, run, "left").na.fill(0, ["shared_ranks", "moved_items"])


def misaligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys missing on either side or repeated: none means the two join one to one."""
    l, r = left.groupBy(key).agg(F.count(F.lit(1)).alias("l")), right.groupBy(key).agg(F.count(F.lit(1)).alias("r"))
    return l.join(r, key, "full").na.fill(0, ["l", "r"]).where("l <> 1 or r <> 1")


def cache_state(hash_: Column, cached_hash: Column, size: Column, dimensions: int, age_days: Column, most_days: int = 180) -> Column:
    """missing, stale, invalid, old or fresh."""
    return F.when(cached_hash.isNull(), "missing").when(hash_ != cached_hash, "stale").when(F.coalesce(size, F.lit(0)) != dimensions, "invalid").when(age_days > most_days, "old").otherwise("fresh")


def chronology(event: Column, exposure: Column, day_only: Column) -> Column:
    """How an event stands to an exposure; a day-precision event is compared by day."""
    e, x = F.to_date(event), F.to_date(exposure)
    return (
        F.when(event.isNull() | exposure.isNull(), "missing")
        .when(day_only, F.when(e > x, "after").when(e == x, "same_day").otherwise("before"))
        .when(event > exposure, "after").when(event == exposure, "same_time").otherwise("before")
    )


def sole_value(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The value of keys that have exactly one distinct value."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("n"), F.min(value).alias(value)).where("n = 1").drop("n")


def expired(heartbeat: Column, started: Column, now: Column, seconds: int = 300) -> Column:
    """A lease without a readable recent sign of life."""
    seen = F.try_to_timestamp(blank_to(heartbeat, started))
    return F.coalesce(seen < now - F.make_dt_interval(secs=F.lit(seconds)), F.lit(True))


def mean_by(rows: DataFrame, arm: str, fold: str, value: str) -> DataFrame:
    """Arms by the mean of their per-fold means, the best first and ties by name: folds are never pooled."""
    folds = rows.groupBy(arm, fold).agg(F.avg(value).alias("m"))
    arms = folds.groupBy(arm).agg(F.avg("m").alias("mean"))
    return arms.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.round("mean", 9).desc(), arm)))
