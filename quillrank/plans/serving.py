"""Serving: event learner, fatigue, bounded diversification, exploration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.dates import half_life
from quillrank.functions.vectors import doubles, unit, valid
from quillrank.operators.aggregates import wilson
from quillrank.operators.windows import placed
from quillrank.plans.ranking import BLOCK_ROWS, PAIRS
from quillrank.session import cut

# Fixed values of the learner.
MIN_BOOKS, MIN_EVIDENCE, MATURE, RATE_SCALE, GAP_SCALE, MIN_FEATURE = 6.0, 4.5, 20, 0.5, 0.15, 1.5
CAPS = {"author": (4.0, 3.0), "era_new": (1.0, 4.0), "era": (3.5, 3.0), "subject": (2.0, 3.5)}
DIMINISHING = (1.0, 0.5, 0.25, 0.125)
MAX_MOVE = 8.0
GRACE, PER_DAY, MAX_PENALTY = 3, 0.75, 4.5
SLATE, DISPLACEMENT, SACRIFICE, SIMILAR = 8, 3, 5.0, 0.75
STABLE = 4
# Of the semantic part: floors of similarity, and (prior weight, most) before and after there is enough history.
FLOOR, POSITIVE_FLOOR, MIN_VECTORS = 0.45, 0.52, 10
YOUNG, GROWN = (1.5, 4.0), (1.0, 5.0)


def latest_observations(events: DataFrame, now: Column) -> DataFrame:
    """book, label, weight of each book's last event: neutral events erase, evidence halves in two years.

    events: id, book, ts, label (null if neutral), reliability.
    """
    last = Window.partitionBy("book").orderBy(F.col("ts").desc_nulls_last(), F.col("id").desc())
    rows = events.withColumn("_n", F.row_number().over(last)).where("_n = 1 and label is not null")
    age = (F.unix_timestamp(now) - F.unix_timestamp("ts")) / 86400.0
    weight = F.col("reliability") * F.when(F.col("ts").isNull(), 1.0).otherwise(half_life(age))
    return rows.select("book", "label", weight.alias("weight")).where("weight >= 0.05")


def _part(feature: Column, n: int) -> Column:
    kind = F.when(feature.startswith("author:"), F.lit(CAPS["author"][n])).when(feature == "era:2020_plus", CAPS["era_new"][n]).when(feature.startswith("era:"), CAPS["era"][n])
    return kind.otherwise(CAPS["subject"][n])


def feature_effects(observations: DataFrame, features: DataFrame) -> DataFrame:
    """feature -> effect: a gap between Wilson intervals of a feature and the rest, else a shrunk rate once there is enough history.

    observations: book, label, weight; features: book, feature.
    """
    w, pos = F.col("weight"), F.when(F.col("label") == 1, F.col("weight")).otherwise(0.0)
    sums = [F.sum(w).alias("w"), F.sum(pos).alias("p"), F.sum(w * w).alias("w2")]
    whole = observations.agg(F.count(F.lit(1)).alias("books"), *[F.sum(x).alias(a) for x, a in ((w, "tw"), (pos, "tp"), (w * w, "tw2"))])
    g = features.join(observations, "book").groupBy("feature").agg(*sums).crossJoin(F.broadcast(whole)).where(F.col("tw") >= MIN_EVIDENCE)
    rest = lambda a, b: F.greatest(F.lit(0.0), F.col(a) - F.col(b))
    g = g.withColumn("ow", rest("tw", "w")).withColumn("op", rest("tp", "p")).withColumn("ow2", rest("tw2", "w2"))
    n, on = F.col("w") * F.col("w") / F.col("w2"), F.try_divide(F.col("ow") * F.col("ow"), F.col("ow2"))
    low, high = wilson(F.col("p"), F.col("w"), n)
    olow, ohigh = wilson(F.col("op"), F.nullif("ow", F.lit(0.0)), F.coalesce(on, F.lit(0.0)))
    # One row per feature is cut here: with what follows, one generated method would grow too large to compile.
    g = cut(g.withColumn("low", low).withColumn("high", high).withColumn("olow", olow).withColumn("ohigh", ohigh))
    ready = (n + 1e-9 >= MIN_BOOKS) & (F.coalesce(on, F.lit(0.0)) + 1e-9 >= MIN_BOOKS) & (F.col("w") >= MIN_EVIDENCE) & (F.col("ow") >= MIN_EVIDENCE)
    gap = F.when(F.col("low") > F.col("ohigh"), F.col("low") - F.col("ohigh")).when(F.col("high") < F.col("olow"), F.col("high") - F.col("olow"))
    cap, prior = _part(F.col("feature"), 0), _part(F.col("feature"), 1)
    rate, orate, all_rate = F.col("p") / F.col("w"), F.try_divide(F.col("op"), F.col("ow")), F.col("tp") / F.col("tw")
    gated = F.when(ready & gap.isNotNull(), F.signum(gap) * cap * F.least(F.lit(1.0), F.abs(rate - orate) / RATE_SCALE) * F.least(F.lit(1.0), F.abs(gap) / GAP_SCALE))
    shrunk = cap * ((F.col("p") + prior * all_rate) / (F.col("w") + prior) - all_rate) / RATE_SCALE
    mature = F.when((F.col("books") >= MATURE) & (F.col("w") >= MIN_FEATURE) & (F.abs(shrunk) >= 0.05), F.least(cap, F.greatest(-cap, shrunk)))
    return g.select("feature", F.coalesce(gated, mature).alias("effect")).where("effect is not null")


def semantic_adjustments(observations: DataFrame, candidates: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id -> adjustment: the rate of likes among similar decided books, shrunk to the rate of all of them.

    The decided books go to every task in blocks, and each candidate keeps two sums a block.
    Vectors count if finite, not zero and as long as that of the lowest book.

    observations: book, label, weight, vec; candidates: id (unique), vec.
    """
    spark = candidates.sparkSession
    found = observations.where("vec is not null").select("book", F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"), doubles(F.col("vec")).alias("vec"))
    size = found.agg(F.min_by(F.size("vec"), "book")).first()[0] or 0
    usable = valid(F.col("vec"), size) & F.exists("vec", lambda x: x != 0)
    decided = found.where(usable).withColumn("vec", unit(F.col("vec")))
    w = F.col("weight")
    n, total, liked = decided.agg(F.count(F.lit(1)), F.coalesce(F.sum(w), F.lit(0.0)), F.coalesce(F.sum(w * F.col("label")), F.lit(0.0))).first()
    if n < MIN_VECTORS or total < MIN_EVIDENCE:
        return candidates.select("id", F.lit(0.0).alias("adjustment")).where("false")
    grown = n >= MATURE
    prior, most = GROWN if grown else YOUNG
    rate = (liked + 1.0) / (total + 2.0)
    ready = candidates.select("id", doubles(F.col("vec")).alias("vec")).where(usable).select("id", unit(F.col("vec")).alias("vec"))
    kind = dict(candidates.dtypes)["id"]
    parts = max(1, -(-n // block_rows))
    sums = None
    for k in range(parts):
        rows = decided.where(F.pmod(F.xxhash64("book"), F.lit(parts)) == k).orderBy("book").toPandas()
        block = spark.sparkContext.broadcast((rows["label"].to_numpy(np.float64), rows["weight"].to_numpy(np.float64), np.array(rows["vec"].tolist(), np.float64).reshape(len(rows), size)))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            labels, weights, matrix = block.value
            for batch in batches:
                if not len(labels) or not batch.num_rows:
                    continue
                v = np.array(batch.column("vec").to_pylist(), np.float64)
                total, liked = np.zeros(len(v)), np.zeros(len(v))
                step = max(1, PAIRS // len(labels))
                for a in range(0, len(v), step):
                    sims = v[a : a + step] @ matrix.T
                    local = np.maximum(0.0, sims - FLOOR) / (1 - FLOOR)
                    if grown:
                        local = np.where(labels == 1, (np.maximum(0.0, sims - POSITIVE_FLOOR) / (1 - POSITIVE_FLOOR)) ** 2, local)
                    total[a : a + step], liked[a : a + step] = local @ weights, local @ (weights * labels)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(total), pa.array(liked)], ["id", "w", "p"])

        part = ready.mapInArrow(run, f"id {kind}, w double, p double")
        sums = part if sums is None else sums.unionByName(part)
    near = sums.groupBy("id").agg(F.sum("w").alias("w"), F.sum("p").alias("p")).where("w > 0")
    shrunk = most * ((F.col("p") + prior * rate) / (F.col("w") + prior) - rate) / RATE_SCALE
    return near.select("id", F.greatest(F.lit(-most), F.least(F.lit(most), shrunk)).alias("adjustment")).where("abs(adjustment) >= 0.05")


def personalized(candidates: DataFrame, features: DataFrame, effects: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """Candidates with delta and new_score. candidates: id, score, confidence; features: id, feature; semantic: id, adjustment."""
    met = features.join(effects, "feature")
    subject = ~(F.col("feature").startswith("author:") | F.col("feature").startswith("era:"))
    turn = F.row_number().over(Window.partitionBy("id", subject).orderBy(F.abs("effect").desc(), "feature"))
    share = F.when(subject, F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in DIMINISHING]), turn), F.lit(0.0))).otherwise(1.0)
    sums = met.withColumn("part", F.col("effect") * share).groupBy("id").agg(F.sum("part").alias("d"))
    if semantic is not None:
        sums = sums.unionByName(semantic.select("id", F.col("adjustment").alias("d"))).groupBy("id").agg(F.sum("d").alias("d"))
    delta = F.greatest(F.lit(-MAX_MOVE), F.least(F.lit(MAX_MOVE), F.coalesce("d", F.lit(0.0)))) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.0))))
    out = candidates.join(sums, "id", "left").withColumn("delta", delta).drop("d")
    moved = F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("score") + F.col("delta"))), 1)
    return out.withColumn("new_score", F.when(F.abs("delta") >= 0.05, moved).otherwise(F.col("score")))


def visible_days(impressions: DataFrame, acted: DataFrame, now: Column, window: int = 21) -> DataFrame:
    """Distinct days in the window on which an item nobody acted on was visible. impressions: id, visible_at; acted: id."""
    recent = impressions.where((F.col("visible_at") >= now - F.make_dt_interval(F.lit(window))) & (F.col("visible_at") <= now))
    return recent.join(acted.select("id").distinct(), "id", "left_anti").groupBy("id").agg(F.count_distinct(F.to_date("visible_at")).alias("days"))


def fatigued(candidates: DataFrame, days: DataFrame, grace: int = GRACE, per_day: float = PER_DAY, most: float = MAX_PENALTY) -> DataFrame:
    """Scores less a penalty for days of being passed over, and the position after it.

    Only if any score changed is the order made anew; otherwise it stays. candidates: id, score, pos.
    """
    penalty = F.least(F.lit(float(most)), F.greatest(F.lit(0.0), (F.coalesce("days", F.lit(0)) - grace) * float(per_day)))
    rows = candidates.join(days, "id", "left").withColumn("penalty", penalty).withColumn("new_score", F.greatest(F.lit(0.0), F.col("score") - F.col("penalty")))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max(F.col("penalty") > 0).alias("_any"))))
    order = [F.when(F.col("_any"), -F.col("new_score")).otherwise(F.col("pos").cast("double")), -F.col("id")]
    return placed(rows, order, "position").drop("_any", "days")


def diversified(items: DataFrame, by: str = "run", slate: int = SLATE, reach: int = DISPLACEMENT, sacrifice: float = SACRIFICE, similar: float = SIMILAR) -> DataFrame:
    """(run, id, pos, position): early slots swapped with near later ones that repeat less.

    A slate depends on the slots before it, so a run's first slots are one group; a swap
    never takes an item from beyond ``slate + reach``, so no more than those go there, and
    the rest of the run keeps its order. items: run, id, pos, author, score, vec.
    """

    def arrange(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("pos", ignore_index=True)
        v = np.array(page["vec"].tolist(), np.float64)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        sims = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
        sims = sims @ sims.T
        author, score, row = page["author"].tolist(), page["score"].to_numpy(float), list(range(len(page)))

        def repeats(i: int, before: list[int]) -> int:
            return sum(author[i] == author[b] for b in before) + sum(sims[i, b] >= similar for b in before)

        for at in range(min(slate, len(row))):
            before = row[:at]
            cost = repeats(row[at], before)
            options = []
            for to in range(at + 1, min(len(row), at + reach + 1)):
                new = row[to]
                c = repeats(new, before)
                if cost and c < cost and abs(new - at) <= reach and abs(row[at] - to) <= reach and score[new] >= score[row[at]] - sacrifice:
                    options.append((c, -score[new], to - at, new, to))
            if options:
                to = min(options)[-1]
                row[at], row[to] = row[to], row[at]
        return pd.DataFrame({by: page[by].to_numpy()[row], "id": page["id"].to_numpy()[row], "pos": page["pos"].to_numpy()[row], "position": np.arange(1, len(row) + 1)})

    kinds = dict(items.dtypes)
    ordered = items.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("pos")).cast("long"))
    near = F.col("position") <= slate + reach
    head = ordered.where(near).select(by, "id", "pos", "author", "score", "vec").groupBy(by).applyInPandas(arrange, f"{by} {kinds[by]}, id {kinds['id']}, pos {kinds['pos']}, position long")
    return head.unionByName(ordered.where(~near).select(by, "id", "pos", "position"))


def explored(items: DataFrame, epsilon: float, seed: int, stable: int = STABLE, by: str = "run") -> DataFrame:
    """Position and exact propensity per item: the head stays, the tail of a run is shuffled with chance epsilon.

    The draw is a seeded hash of the run, so a rerun logs the same propensities. items: run, id, pos.
    """
    page = Window.partitionBy(by)
    unit_of = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 30)) / float(1 << 30)
    tail = F.col("pos") > stable
    rows = items.withColumn("n", F.count_if(tail).over(page)).withColumn("go", unit_of(by) < epsilon)
    drawn = F.row_number().over(Window.partitionBy(by, tail).orderBy(F.when(F.col("go"), unit_of(by, "id")).otherwise(F.col("pos").cast("double")), "pos"))
    rows = rows.withColumn("position", F.when(tail, drawn + stable).otherwise(F.col("pos")))
    moved = F.when(F.col("position") == F.col("pos"), 1.0 - epsilon).otherwise(0.0) + epsilon / F.col("n")
    return rows.withColumn("propensity", F.when(~tail | (F.col("n") <= 1) | F.lit(epsilon <= 0), 1.0).otherwise(moved)).drop("n", "go")


def nudged(items: DataFrame, deltas: DataFrame, top: int = 24, most: float = 1.2, by: str | None = None) -> DataFrame:
    """Clipped outside deltas on the first ``top`` items, re-ranked among themselves. items: id, score, pos; deltas: id, delta.

    Without ``by`` the items are one page; with it, each value's items are a page.
    """
    head = F.col("pos") <= top
    rows = items.join(deltas, "id", "left").withColumn("new_score", F.when(head, F.col("score") + F.greatest(F.lit(-most), F.least(F.lit(most), F.coalesce("delta", F.lit(0.0))))).otherwise(F.col("score")))
    order = Window.partitionBy(by or F.lit(1)).orderBy((~head).cast("int"), F.when(head, -F.col("new_score")).otherwise(F.col("pos").cast("double")), F.col("id").desc())
    return rows.withColumn("position", F.row_number().over(order)).drop("delta")
