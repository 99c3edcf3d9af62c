"""Catalogue records beside items: lookups, projections of verified keys, precedence, match confidence, run ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions.catalog import work_key
from quillrank.functions.text import blank_to, isbn13, normalize_key
from quillrank.operators.windows import first_per

# Weights of a match, and what is as good as equal; lengths and halves of the description heuristic.
TITLE_WEIGHT, AUTHOR_WEIGHT, EQUAL = 0.65, 0.35, 0.98
FULL_LENGTH, KIND_SHARE = 600.0, 0.5
# Outcomes of a request that are worth an early retry.
TRANSIENT = ("request_error", "http_error", "rate_limited", "server_error", "timeout", "provider_unavailable")
MOST_EVENTS = 5000


def attached(items: DataFrame, key: str, **sides: tuple[DataFrame, list[Column]]) -> DataFrame:
    """Items with one row of each side as a struct: of several rows of a key the first in the side's order."""
    out = items
    for name, (rows, order) in sides.items():
        one = first_per(rows, [key], order).select(F.col(key).alias("_k"), F.struct(*[c for c in rows.columns if c != key]).alias(name))
        out = out.join(one, F.col(key) == F.col("_k"), "left").drop("_k")
    return out


def verified_works(reads: DataFrame, metadata: DataFrame) -> DataFrame:
    """Reads with the work their metadata verified (``verified_work``, else null).

    The metadata must be of the read as it is now (identity hash), of the open catalogue,
    agree with the identity it was verified by, and not contradict a work the read names.
    reads: id, identity_hash, work; metadata: read_id (unique), identity_hash, provider, provider_id, work.
    """
    m = metadata.select(F.col("read_id").alias("_r"), F.col("identity_hash").alias("_h"), F.lower(F.trim("provider")).alias("_p"), work_key(F.col("provider_id")).alias("_i"), work_key(F.col("work")).alias("_w"))
    now = work_key(F.col("work"))
    good = (F.col("_h") == F.col("identity_hash")) & (F.col("_p") == "openlibrary") & (F.col("_w") != "") & (F.col("_w") == F.col("_i")) & ((now == "") | (now == F.col("_w")))
    return reads.join(m, F.col("id") == F.col("_r"), "left").withColumn("verified_work", F.when(good, F.col("_w"))).drop("_r", "_h", "_p", "_i", "_w")


def known_isbns(items: DataFrame, candidates: DataFrame, quality: DataFrame) -> DataFrame:
    """Items with the ISBN a stored candidate of their title and author has, itself or by its record. items: id, title, author; candidates: id, title, author, isbn; quality: id, isbn."""
    q = quality.select("id", F.col("isbn").alias("_q"))
    stored = first_per(candidates.withColumn("_key", normalize_key(F.col("title"), F.col("author"))).join(q, "id", "left"), ["_key"], [F.col("id").desc()])
    return items.withColumn("_key", normalize_key(F.col("title"), F.col("author"))).join(stored.select("_key", blank_to(F.col("isbn"), F.col("_q")).alias("known_isbn")), "_key", "left").drop("_key")


def match_confidence(title_match: Column, author_match: Column) -> Column:
    """How sure it is that a record is the item's; equal in both parts is certain."""
    both = F.least(F.lit(1.0), TITLE_WEIGHT * title_match + AUTHOR_WEIGHT * author_match)
    return F.round(F.when((title_match >= EQUAL) & (author_match >= EQUAL), 1.0).otherwise(both), 4)


def description_quality(description: Column, kind: Column) -> Column:
    """By kind of field and length only: a synopsis starts at one half."""
    length = KIND_SHARE * F.least(F.lit(1.0), F.length(description) / FULL_LENGTH)
    return F.when(blank_to(description) == "", 0.0).otherwise(F.round(F.when(kind == "synopsis", KIND_SHARE + length).otherwise(length), 4))


def metadata_due(reads: DataFrame, now: Column, retry_days: int = 30, transient_hours: int = 6) -> DataFrame:
    """Reads with a valid ISBN whose metadata is missing, of another identity or work, or old; what failed for a passing reason is retried sooner.

    reads: isbn, work, cached_work, identity_hash, cached_hash, checked_at, attempt_status, traces (statuses of its requests).
    """
    here, cached = work_key(F.col("work")), work_key(F.col("cached_work"))
    changed = ~F.coalesce(F.col("identity_hash") == F.col("cached_hash"), F.lit(False)) | ((here != "") & (cached != "") & (here != cached))
    passing = F.coalesce(F.col("attempt_status").isin("request_error", "provider_unavailable"), F.lit(False)) | F.exists(F.coalesce("traces", F.array().cast("array<string>")), lambda s: F.coalesce(s.isin(*TRANSIENT), F.lit(False)))
    limit = F.when(passing, now - F.make_dt_interval(hours=F.lit(transient_hours))).otherwise(now - F.make_dt_interval(F.lit(retry_days)))
    return reads.where(isbn13(F.col("isbn")).isNotNull() & (changed | F.col("checked_at").isNull() | (F.col("checked_at") <= limit)))


def upgrade_allowed(kind: Column, description: Column, provider: Column, provider_id: Column, new_kind: Column, new_description: Column, payloads: Column) -> Column:
    """Whether a synopsis may replace a stored opening sentence: only from the same source, whose record has that very sentence.

    provider, provider_id: the source of the stored text; payloads: array of struct(provider, provider_id, kind, opening_sentence) of what was fetched.
    """
    same = F.exists(payloads, lambda p: (p["provider"] == provider) & (p["provider_id"] == provider_id) & (p["kind"] == "synopsis") & (p["opening_sentence"] == description))
    sourced = (blank_to(provider) != "") & (blank_to(provider_id) != "")
    return F.coalesce((kind == "opening_sentence") & (new_kind == "synopsis") & (blank_to(description) != "") & (blank_to(new_description) != "") & sourced & same, F.lit(False))


def recent_events(events: DataFrame, legacy: DataFrame, most: int = MOST_EVENTS) -> DataFrame:
    """The last ``most`` events and legacy decisions that no event repeats, newest first. events: id, key, candidate, action, at; legacy: id, candidate, action, at."""
    known = events.select(F.col("key").alias("_k"))
    old = legacy.join(known, F.concat(F.lit("feedback:"), F.col("id").cast("string")) == F.col("_k"), "left_anti")
    both = events.select("id", "candidate", "action", "at").unionByName(old.select((F.col("id") + 1_000_000_000).alias("id"), "candidate", "action", "at"))
    return both.orderBy(F.col("at").desc(), F.col("id").desc()).limit(most)


def confident(items: DataFrame, least: float = 90.0) -> DataFrame:
    """Items whose score, held in 0..100, reaches ``least``. items: score."""
    held = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce("score", F.lit(0.0))))
    return items.where(held >= least)


def run_ledger(steps: DataFrame) -> DataFrame:
    """One row per run from its steps: what it began with, how it ended, what it asked.

    Of several ends the last counts; a run without one is still running. steps: run, at,
    step (begin, finish, request), provider, seeds, status, edges, error.
    """
    ended, began = F.col("step") == "finish", F.col("step") == "begin"
    last = lambda c: F.max_by(c, F.when(ended, F.col("at")))
    rows = steps.groupBy("run").agg(
        F.max(F.when(began, F.col("provider"))).alias("provider"), F.max(F.when(began, F.col("seeds"))).alias("seeds"), F.count_if(ended).alias("_ends"), last(F.col("status")).alias("_status"), last(F.coalesce("edges", F.lit(0))).alias("_edges"),
        last(F.substring("error", 1, 1000)).alias("_error"), F.count_if(F.col("step") == "request").alias("requests"), F.count_if((F.col("step") == "request") & (F.col("status") != "ok")).alias("failed_requests"),
    )
    done = F.col("_ends") > 0
    return rows.select("run", "provider", "seeds", F.when(done, F.col("_status")).otherwise("running").alias("status"), F.when(done, F.col("_edges")).otherwise(0).cast("long").alias("edges"), F.when(done, F.col("_error")).alias("error"), "requests", "failed_requests")


def rewritten(rows: DataFrame, key: str, **values: Column) -> DataFrame:
    """Only the rows that new values change, with those values."""
    changed = None
    for name, new in values.items():
        differs = ~F.col(name).eqNullSafe(new)
        changed = differs if changed is None else changed | differs
    return rows.where(changed).select(key, *[new.alias(name) for name, new in values.items()])


def strict_year(value: Column, low: int = 1000, high: int = 2100) -> Column:
    """The year of four digits or of a real ISO day, in range, else null."""
    v = F.trim(value)
    year = F.when(v.rlike(r"^\d{4}$"), v.try_cast("int")).when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.year(F.try_to_date(v, "yyyy-MM-dd")))
    return F.when(year.between(low, high), year)


def number_or(value: Column, default: float | None = None, low: float | None = None, high: float | None = None) -> Column:
    """A finite number from text, cut to its range, else ``default``."""
    x = F.trim(value).try_cast("double")
    fair = F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)
    fair = fair if low is None else F.greatest(F.lit(float(low)), fair)
    fair = fair if high is None else F.least(F.lit(float(high)), fair)
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), fair).otherwise(F.lit(default).cast("double"))
