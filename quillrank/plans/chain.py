"""Whole jobs put together: scoring of a catalogue, the serving chain and its ablations, a reader's transition to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.catalog import outcome_label
from quillrank.operators.joins import latest_before, without_known
from quillrank.operators.merge import upsert
from quillrank.plans import ranking, serving

# The states that scoring looks at, and what a shelf does to a score.
SCORED, SHELF_LIFT, DEFAULT_CONFIDENCE = ("new", "recommended"), 10.0, 0.85
BEHIND = ("saved", "imported", "new")


def scorable(candidates: DataFrame, sources: DataFrame, quality: DataFrame, reads: DataFrame) -> DataFrame:
    """The candidates a scoring run looks at, with the weight of their source and the confidence of their record.

    Open candidates of enabled sources with an accepted record that share no key with a
    read; titles alone exclude nothing. candidates: id, source_id, status, keys; sources:
    source_id, enabled, source_weight; quality: id, quality_status, quality_score; reads: keys.
    """
    open_ = candidates.where(F.col("status").isin(*SCORED))
    good = quality.where("quality_status = 'accepted'").select("id", F.when(F.col("quality_score") > 0, F.col("quality_score")).otherwise(DEFAULT_CONFIDENCE).alias("confidence"))
    return without_known(open_.join(sources.where("enabled").select("source_id", "source_weight"), "source_id").join(good, "id"), reads)


def scored(candidates: DataFrame, sources: DataFrame, quality: DataFrame, reads: DataFrame, reading: DataFrame, to_read: DataFrame) -> DataFrame:
    """(id, status, score): what a scoring run writes for every open candidate.

    Eligible ones are ranked against the rated history and recommended; what is being read
    now is hidden, what is on the list to read is lifted; recommended ones that are no
    longer eligible by source or record go back to new. candidates also have identity,
    author, vec; reads identity, author, rating, day, vec; reading, to_read: keys.
    """
    eligible = scorable(candidates, sources, quality, reads)
    ranked = ranking.score_candidates(reads, eligible).select("id", "score")
    shelf = lambda rows, name: eligible.select("id", F.explode("keys").alias("_k")).join(rows.select(F.explode("keys").alias("_k")).distinct(), "_k", "left_semi").select("id", F.lit(True).alias(name)).distinct()
    met = ranked.join(shelf(reading, "_now"), "id", "left").join(shelf(to_read, "_later"), "id", "left")
    lifted = F.when(F.col("_later"), F.round(F.least(F.lit(100.0), F.col("score") + SHELF_LIFT), 1)).otherwise(F.col("score"))
    written = met.select("id", F.when(F.col("_now"), "hidden").otherwise("recommended").alias("status"), F.when(F.col("_now"), 0.0).otherwise(lifted).alias("score"))
    fair = candidates.join(sources.where("enabled"), "source_id").join(quality.where("quality_status = 'accepted'"), "id").select("id")
    stale = candidates.where("status = 'recommended'").join(fair, "id", "left_anti").select("id", F.lit("new").alias("status"), F.lit(0.0).alias("score"))
    return written.unionByName(stale)


def _placed(rows: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("run").orderBy(*order)))


def served(
    items: DataFrame, effects: DataFrame, features: DataFrame, days: DataFrame, semantic: DataFrame | None = None, deltas: DataFrame | None = None,
    head: int | None = None, epsilon: float = 0.0, seed: int = 0, learn: bool = True, fatigue: bool = True, slate: bool = True, fatigue_of: tuple[float, float, float] = (serving.GRACE, serving.PER_DAY, serving.MAX_PENALTY),
) -> DataFrame:
    """The page a reader sees: (run, id, status, score, position, propensity).

    In order: recommended ones first by score; scores moved by what was learned; less for
    days of being passed over (the order is made anew only if some score changed); early
    slots of the recommended ones diversified; outside deltas on their head; with ``head``
    that many recommended ones and the other open ones behind them; the tail explored.
    Each step can be left out, which gives the arms of an ablation. A run is one page's
    candidates. items: run, id, status, score, confidence, author, vec; effects: feature,
    effect; features: id, feature; days, semantic, deltas: by id.
    """
    other = (F.col("status") != "recommended").cast("int")
    rows = _placed(items, [other, F.col("score").desc(), F.col("id").desc()])
    if learn:
        moves = serving.personalized(items.select("id", "score", "confidence").dropDuplicates(["id"]), features, effects, semantic).select("id", F.col("delta").alias("_delta"))
        moved = F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("score") + F.col("_delta"))), 1)
        rows = rows.join(moves, "id", "left").withColumn("score", F.when(F.abs("_delta") >= 0.05, moved).otherwise(F.col("score"))).drop("_delta")
        rows = _placed(rows, [other, F.col("score").desc(), "pos"])
    if fatigue:
        grace, per_day, most = fatigue_of
        penalty = F.least(F.lit(float(most)), F.greatest(F.lit(0.0), (F.coalesce("days", F.lit(0)) - grace) * float(per_day)))
        rows = rows.join(days, "id", "left").withColumn("_p", penalty).drop("days").withColumn("_any", F.max(F.col("_p") > 0).over(Window.partitionBy("run")))
        rows = rows.withColumn("score", F.greatest(F.lit(0.0), F.col("score") - F.col("_p")))
        rows = _placed(rows, [F.when(F.col("_any"), other).otherwise(0), F.when(F.col("_any"), -F.col("score")).otherwise(F.col("pos").cast("double")), "pos"]).drop("_p", "_any")
    if slate:
        page = serving.diversified(_placed(rows.where("status = 'recommended'"), ["pos"])).select("run", "id", "position")
        rows = rows.join(page, ["run", "id"], "left")
        rows = _placed(rows, [other, F.coalesce("position", "pos")]).drop("position")
    if deltas is not None:
        lifted = serving.nudged(rows.where("status = 'recommended'"), deltas, by="run").select("run", "id", "new_score", "position")
        rows = rows.join(lifted, ["run", "id"], "left").withColumn("score", F.coalesce("new_score", "score"))
        rows = _placed(rows, [other, F.coalesce("position", "pos")]).drop("position", "new_score")
    if head is not None:
        first = F.row_number().over(Window.partitionBy("run", "status").orderBy("pos"))
        rows = rows.withColumn("_f", first).where(((F.col("status") == "recommended") & (F.col("_f") <= head)) | F.col("status").isin(*BEHIND)).drop("_f")
        rows = _placed(rows, [other, "pos"])
    shown = serving.explored(rows.select("run", "id", "status", "score", "pos"), epsilon, seed)
    return shown.select("run", "id", "status", "score", F.col("position").cast("int").alias("position"), "propensity")


def ablated(items: DataFrame, *args, arms: dict[str, dict], **how) -> DataFrame:
    """``served`` once per arm with that arm's changes, under a column ``arm``."""
    out = None
    for arm, changes in arms.items():
        page = served(items, *args, **{**how, **changes}).withColumn("arm", F.lit(arm))
        out = page if out is None else out.unionByName(page)
    return out


def marked_read(reads: DataFrame, marks: DataFrame, shown: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads with the marked books merged in, and one event per mark with the impression it is owed to.

    A new rating replaces the old one, a moment or ISBN only fills a gap. The event carries
    a label only if an impression came before the read. reads: key, rating, read_at, isbn;
    marks: the same, at (order of marks); shown: key, impression, seen_at.
    """
    merged = upsert(reads, marks, "key", "at", {"read_at": "fill", "isbn": "fill"})
    now = marks.select("key").distinct().join(merged, "key")
    owed = latest_before(now, shown, "key", "read_at", "seen_at", ["seen_at", "impression"]).select("key", "impression")
    label = outcome_label(F.col("rating"))
    told = now.join(owed, "key", "left").withColumn("_l", F.when(F.col("impression").isNotNull(), label))
    return merged, told.select("key", "rating", "impression", F.col("_l.label").alias("label"), F.col("_l.kind").alias("label_kind"))


def feedback_histories(feedback: DataFrame, reads: DataFrame) -> DataFrame:
    """Per candidate with a last decision of saving or rejecting: its label and what was read on earlier days.

    Reads of the candidate's own identity don't count. Days are summed up first and met by
    day, and a candidate's own reads are taken off, so no candidate meets every read.
    Candidates without any earlier read go. feedback: id, candidate, identity, action, at
    (null if undone); reads: identity, rating, day.
    """
    last = feedback.where("at is not null").withColumn("_n", F.row_number().over(Window.partitionBy("candidate").orderBy(F.col("at").desc(), F.col("id").desc()))).where("_n = 1 and action in ('save', 'reject')")
    wanted = last.select("candidate", "identity", (F.col("action") == "save").cast("int").alias("label"), F.to_date("at").alias("day"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("rating").alias("s")]
    every = reads.groupBy("day").agg(*sums).unionByName(wanted.select("day").distinct().select("day", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"))).groupBy("day").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    known = every.select("day", F.sum("n").over(before).alias("n"), F.sum("s").over(before).alias("s"))
    own = wanted.join(reads.select("identity", F.col("day").alias("_d"), "rating"), "identity").where("_d < day").groupBy("candidate").agg(F.count(F.lit(1)).alias("on"), F.sum("rating").alias("os"))
    met = wanted.join(known, "day").join(own, "candidate", "left")
    n, s = F.coalesce("n", F.lit(0)) - F.coalesce("on", F.lit(0)), F.coalesce("s", F.lit(0.0)) - F.coalesce("os", F.lit(0.0))
    return met.select("candidate", "label", n.cast("long").alias("prior"), (s / F.nullif(n, F.lit(0))).alias("mean_rating")).where("prior > 0")
