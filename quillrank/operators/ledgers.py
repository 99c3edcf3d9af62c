"""What the service keeps books of: due work, deliveries, caches, outcomes, lineage, purges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.catalog import weak_cover
from quillrank.functions.dates import iso_week
from quillrank.functions.text import blank_to
from quillrank.operators.windows import first_per

# Retries of a record's metadata, and of a digest's channel.
RETRY_DAYS, COVER_RETRY_DAYS, MAX_ATTEMPTS, BACKOFF_MINUTES = 30, 7, 3, 15


def refresh_due(rows: DataFrame, now: Column, version: int) -> DataFrame:
    """Accepted records that lack a field or have an old version and whose last look is long enough ago, the neediest first.

    rows: id, status, quality, metadata_version, checked_at, cover, description, released, genre_count, score.
    A weak or missing cover is looked for again after a week, the rest after a month.
    """
    bad_cover = (blank_to(F.col("cover")) == "") | weak_cover(F.col("cover"))
    old = F.col("metadata_version") != version
    sparse = bad_cover | (blank_to(F.col("description")) == "") | F.col("released").isNull() | (F.coalesce("genre_count", F.lit(0)) == 0)
    wait = F.make_dt_interval(F.when(bad_cover, COVER_RETRY_DAYS).otherwise(RETRY_DAYS))
    rested = old | F.col("checked_at").isNull() | (F.col("checked_at") <= now - wait)
    due = rows.where((F.col("status") != "rejected") & (F.col("quality") == "accepted") & (old | sparse) & rested)
    return due.orderBy((~old).cast("int"), F.col("checked_at").asc_nulls_first(), F.col("score").desc(), "id")


def audit_due(rows: DataFrame, now: Column, version: int) -> DataFrame:
    """Records to audit: pending, never versioned, of an old version with an ISBN, or quarantined by an outage a day ago. rows: quality, audit_version, isbn, flags, checked_at."""
    outage = F.array_contains(F.coalesce("flags", F.array().cast("array<string>")), "catalog_provider_unavailable")
    stale = (F.col("audit_version") != version) & (blank_to(F.col("isbn")) != "")
    rested = F.coalesce(F.col("checked_at") <= now - F.make_dt_interval(hours=F.lit(24)), F.lit(True))
    return rows.where((F.col("quality") == "pending") | F.col("audit_version").isNull() | stale | (outage & rested))


def digest_due(configs: DataFrame, deliveries: DataFrame, at: Column, zone: str = "UTC") -> DataFrame:
    """Digests to send now. configs: owner, day (1 is Monday), minute (of the day), last_period, channels; deliveries: owner, period, channel, status, attempts, updated_at.

    A channel is open until it was sent to or tried three times; an open channel that
    failed less than 15 minutes ago holds the digest back.
    """
    local = F.from_utc_timestamp(at, zone)
    period = iso_week(at, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    ready = configs.where((F.weekday(local) + 1 == F.col("day")) & (minute >= F.col("minute")) & ~F.coalesce(F.col("last_period") == period, F.lit(False)))
    sent = deliveries.where(F.col("period") == period).select("owner", "channel", "status", "attempts", "updated_at")
    open_ = ready.select("owner", F.explode("channels").alias("channel")).join(sent, ["owner", "channel"], "left").where((F.coalesce("status", F.lit("")) != "sent") & (F.coalesce("attempts", F.lit(0)) < MAX_ATTEMPTS))
    hot = F.coalesce((F.col("status") == "failed") & (F.col("updated_at") > at - F.make_dt_interval(mins=F.lit(BACKOFF_MINUTES))), F.lit(False))
    return open_.groupBy("owner").agg(F.max(hot).alias("hot"), F.sort_array(F.collect_list("channel")).alias("channels")).where("not hot").select("owner", period.alias("period"), "channels")


def delivered(ledger: DataFrame, tries: DataFrame) -> DataFrame:
    """One row per (period, channel): a try adds one attempt, its status and moment count if they are the latest. Both: period, channel, status, attempts, updated_at."""
    both = ledger.unionByName(tries)
    return both.groupBy("period", "channel").agg(F.max_by("status", "updated_at").alias("status"), F.sum("attempts").alias("attempts"), F.max("updated_at").alias("updated_at"))


def reviewed(deliveries: DataFrame, period: str = "period", ids: str = "ids", created: str = "created_at") -> DataFrame:
    """Per period the distinct ids of its deliveries' JSON lists, the newest delivery first, in order of first appearance; what is no whole number is left out."""
    flat = deliveries.select(period, F.col(created).alias("_c"), F.posexplode(F.from_json(ids, "array<string>")).alias("_p", "_v")).withColumn("id", F.col("_v").try_cast("long")).where("id is not null")
    first = flat.groupBy(period, "id").agg(F.min(F.struct((-F.unix_micros("_c")).alias("c"), F.col("_p").alias("p"))).alias("_o"))
    listed = first.groupBy(period).agg(F.array_sort(F.collect_list(F.struct("_o", "id"))).alias("_l"))
    return listed.select(period, F.transform("_l", lambda x: x["id"]).alias("ids"))


def live_cache(rows: DataFrame, now: Column, most: int, by: str = "provider", key: str = "key", created: str = "created_at", expires: str = "expires_at") -> DataFrame:
    """Entries that haven't expired, the newest ``most`` per provider: the cache's own bound."""
    order = Window.partitionBy(by).orderBy(F.col(created).desc(), F.col(key).desc())
    return rows.where(F.col(expires) > now).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def outcome_changes(stored: DataFrame, seen: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """What recording does to each key: created, updated (a late correction) or unchanged, with the value that holds then."""
    s, n = stored.select(*keys, F.struct(*content).alias("_old")), seen.select(*keys, F.struct(*content).alias("_new"))
    both = s.join(n, keys, "full")
    state = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull() | F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    return both.select(*keys, state.alias("change"), F.coalesce("_new", "_old").alias("_v")).select(*keys, "change", "_v.*")


def best_outcome(impressions: DataFrame, outcomes: DataFrame, key: str = "id") -> DataFrame:
    """Every impression with its surest outcome (the later of equally sure ones) and all of them in order. outcomes: impression, label, confidence, attributed_at."""
    item = F.struct("confidence", "attributed_at", "label")
    per = outcomes.groupBy("impression").agg(F.max(item).alias("best"), F.array_sort(F.collect_list(item)).alias("outcomes"))
    return impressions.join(per, impressions[key] == per["impression"], "left").drop("impression")


def lineage(items: DataFrame, links: DataFrame) -> DataFrame:
    """Per item what its score can be traced to. items: id, batch, score, content_hash; links: batch, id, capture, score, content_hash.

    unlinked without a batch's row, incomplete if its batch wasn't captured whole,
    score_changed or stale_input if what was served differs, else replayable.
    """
    l = links.select("batch", "id", "capture", F.col("score").alias("_s"), F.col("content_hash").alias("_h"))
    state = (
        F.when(F.col("_s").isNull(), "unlinked").when(F.col("capture") != "complete", "incomplete")
        .when(F.abs(F.col("score") - F.col("_s")) > 1e-9, "score_changed").when(~F.col("content_hash").eqNullSafe(F.col("_h")), "stale_input").otherwise("replayable")
    )
    return items.join(l, ["batch", "id"], "left").select("id", "batch", state.alias("state"))


def lineage_rollup(states: DataFrame, by: str) -> DataFrame:
    """complete if all can be replayed, partial if some can, incomplete if none."""
    g = states.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "replayable").alias("good"))
    return g.select(by, "n", "good", F.when(F.col("good") == F.col("n"), "complete").when(F.col("good") > 0, "partial").otherwise("incomplete").alias("status"))


def purged(rows: DataFrame, run: str, *named: DataFrame) -> DataFrame:
    """Rows of runs that none of the tables names (each has the column ``run``)."""
    gone = named[0].select(run)
    for t in named[1:]:
        gone = gone.union(t.select(run))
    return rows.join(gone.distinct(), run, "left_anti")


def shown_before(reads: DataFrame, shown: DataFrame) -> DataFrame:
    """Each read's best rank among the candidates it matches, each by its last run before the read.

    reads: id, key, created; shown: key, candidate, run_at, rank, score. Of the same moment the smaller rank counts.
    """
    met = reads.join(shown, "key").where(F.col("run_at") < F.col("created"))
    last = first_per(met, ["id", "candidate"], [F.col("run_at").desc(), F.col("rank")])
    return last.groupBy("id").agg(F.min("rank").alias("rank"), F.min_by("score", F.struct("rank", "candidate")).alias("score"))


def latest_frame(frames: DataFrame, query: str = "query", seq: str = "seq", payload: str = "payload", most_bytes: int = 25_000, most: int = 50) -> DataFrame:
    """Records of each query's last frame: a frame replaces those before it. The protocol keeps the first 50 records, of 25 kB at most."""
    last = frames.groupBy(query).agg(F.max_by(payload, seq).alias("_p"))
    return last.select(query, F.slice(F.filter(F.from_json("_p", "array<string>"), lambda x: F.octet_length(x) <= most_bytes), 1, most).alias("records"))


def open_jobs(jobs: DataFrame, now: Column, attempts: int = MAX_ATTEMPTS, seconds: int = 300) -> DataFrame:
    """The jobs to run next: per kind the oldest that is queued, or whose lease ran out with attempts left; no kind that runs now. jobs: id, kind, state, heartbeat, tries."""
    lost = F.coalesce(F.col("heartbeat") < now - F.make_dt_interval(secs=F.lit(seconds)), F.lit(True))
    running = jobs.where((F.col("state") == "running") & ~lost).select("kind").distinct()
    ready = jobs.where((F.col("state") == "queued") | ((F.col("state") == "running") & lost & (F.col("tries") < attempts)))
    return first_per(ready.join(running, "kind", "left_anti"), ["kind"], [F.col("id")])
