"""Replay of a rated history day by day: each read scored by what was read on earlier days only.

Reads are dealt to blocks of days. A block meets every block that begins before its own
last day; blocks wholly earlier count whole, in the others the products with reads of the
same or a later day are masked. Of each meeting only the neighbours that a term of the
score can need are kept, so there is no table of pairs, and no task holds more than two
blocks. The number of meetings is half the square of the number of blocks: as-of
neighbours are exact, so every read has to meet every earlier one. What doesn't need
neighbours (counts, means, medians, an author's record) is a running sum over days.

Vectors are dense (``vec``) or sparse (``terms``, ``weights``, of unit length). Sparse
blocks meet by an inverted index of one of them; terms that more than a HOT_SHARE of its
reads have are columns of a small dense product instead, so no term, however common,
lists its pairs, and none is the key of a shuffle. Sparse cosines are rounded to twelve
digits, so that equal texts tie whatever the order of their sums; copies of a sparse
vector are then told apart by id alone, and only those that can matter are compared.

Reads without a day, without a rating from 1 to 5 or without a valid vector are no
records (a sparse one may be empty, like nothing); of reads with one identity the first counts, by day and then id. A target with
less than ``min_history`` earlier reads has null scores and features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.vectors import doubles, unit, valid
from quillrank.operators.windows import first_per
from quillrank.plans import ranking
from quillrank.session import cut

MIN_HISTORY = 100
#: Reads of one block; two are held by a task, with as many products as ranking.PAIRS.
BLOCK_ROWS = 8_192
#: The interpretable parts of a score, in the order the studies use.
FEATURES = ("pos_top", "pos_max", "neg_max", "neg_top", "local_shift", "kernel_shift", "recent_shift", "author_shift", "mean_shift", "log_count")
#: Share of a block's reads above which a term is a dense column.
HOT_SHARE = 1 / 32
_NEAR = "id long, read_id long, sim double, rating double, day date"


def records(reads: DataFrame) -> DataFrame:
    """The reads that a replay can use. reads: id, identity, author, rating, day, vec."""
    fine = valid(F.col("vec")) if "vec" in reads.columns else valid(F.col("weights")) & (F.size("terms") == F.size("weights"))
    usable = reads.where(F.col("rating").between(1, 5) & F.col("day").isNotNull() & fine)
    return first_per(usable, ["identity"], [F.col("day"), F.col("id")])


def time_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """``rows`` with a block: ``span``, ordered by day, and ``part``, which deals out a day of more than a block's rows."""
    days = rows.groupBy("day").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select("day", F.floor(before / block_rows).cast("int").alias("span"), F.ceil(F.col("_n") / block_rows).alias("_parts"))
    return rows.join(days, "day").withColumn("part", F.pmod(F.xxhash64("id"), "_parts").cast("int")).drop("_parts")


_BLOCK = "span int, part int, first date, last date, ids binary, ratings binary, days binary, at binary, terms binary, matrix binary"


def _pack(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("id").combine_chunks()
    days = rows.column("day").cast(pa.int32()).to_numpy()
    values, sizes = rows.column("vec").combine_chunks(), np.diff(rows.column("vec").combine_chunks().offsets.to_numpy())
    terms = rows.column("terms").combine_chunks().flatten().to_numpy(zero_copy_only=False) if "terms" in rows.column_names else np.zeros(0, np.int64)
    at = np.append(0, np.cumsum(sizes)).astype(np.int64)
    made = [rows.column("id").to_numpy(), rows.column("rating").to_numpy(), days, at, terms, values.flatten().to_numpy(zero_copy_only=False)]
    ends = pa.array([days.min(), days.max()], pa.int32()).cast(pa.date32())
    return pa.table([rows.column("span").slice(0, 1), rows.column("part").slice(0, 1), ends.slice(0, 1), ends.slice(1, 1), *([x.tobytes()] for x in made)], names=[c.split()[0] for c in _BLOCK.split(", ")])


def blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block of at most about twice ``block_rows`` reads, packed. rows: id, rating, day, and vec or terms and weights."""
    vector = [unit(doubles(F.col("vec"))).alias("vec")] if "vec" in rows.columns else [F.col("terms").cast("array<long>").alias("terms"), doubles(F.col("weights")).alias("vec")]
    dealt = time_blocks(rows.select(F.col("id").cast("long").alias("id"), F.col("rating").cast("double").alias("rating"), "day", *vector), block_rows)
    return dealt.groupBy("span", "part").applyInArrow(_pack, _BLOCK)


class _Dense:
    """Products with the rows of a block."""

    def __init__(self, block: dict, of: str = ""):
        self.rows = np.frombuffer(block[f"{of}matrix"]).reshape(len(np.frombuffer(block[f"{of}ids"], np.int64)), -1)

    def products(self, queries: _Dense, a: int, b: int) -> np.ndarray:
        return queries.rows[a:b] @ self.rows.T


class _Sparse:
    """Products with the rows of a block by an inverted index of its terms."""

    def __init__(self, block: dict, of: str = ""):
        self.at, self.terms = (np.frombuffer(block[f"{of}{c}"], np.int64) for c in ("at", "terms"))
        self.weights, self.n = np.frombuffer(block[f"{of}matrix"]), len(self.at) - 1
        self.row = np.repeat(np.arange(self.n), np.diff(self.at))
        if not of:
            self.known, term = np.unique(self.terms, return_inverse=True)
            self.count = np.bincount(term, minlength=len(self.known))
            hot = self.count > max(1, self.n * HOT_SHARE)
            self.column = np.where(hot, np.cumsum(hot) - 1, -1)
            self.dense = np.zeros((self.n, int(hot.sum())))
            on = hot[term]
            self.dense[self.row[on], self.column[term[on]]] = self.weights[on]
            order = np.argsort(term, kind="stable")
            self.posted_row, self.posted_weight, self.start = self.row[order], self.weights[order], np.cumsum(self.count) - self.count

    def products(self, queries: _Sparse, a: int, b: int) -> np.ndarray:
        i, j = queries.at[a], queries.at[b]
        terms, weights, row = queries.terms[i:j], queries.weights[i:j], queries.row[i:j] - a
        at = np.minimum(np.searchsorted(self.known, terms), max(0, len(self.known) - 1))
        met = self.known[at] == terms if len(self.known) else np.zeros(len(terms), bool)
        at, weights, row = at[met], weights[met], row[met]
        on = self.column[at] >= 0
        dense = np.zeros((b - a, self.dense.shape[1]))
        dense[row[on], self.column[at[on]]] = weights[on]
        at, weights, row = at[~on], weights[~on], row[~on]
        n = self.count[at]
        pick = np.repeat(self.start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        flat = np.repeat(row, n) * self.n + self.posted_row[pick]
        rare = np.bincount(flat, np.repeat(weights, n) * self.posted_weight[pick], minlength=(b - a) * self.n)
        return np.round(dense @ self.dense.T + rare.reshape(b - a, self.n), 12)


def _meet(disliked: int, kind: type, more: int = 0):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, rids = (np.frombuffer(r[c], np.int64) for c in ("q_ids", "ids"))
                qdays, days = (np.frombuffer(r[c], np.int32) for c in ("q_days", "days"))
                ratings, queries, block = np.frombuffer(r["ratings"]), kind(r, "q_"), kind(r)
                kinds = ((ratings > 0, ranking.KERNEL_NEIGHBOURS), (ratings >= ranking.LIKED, ranking.LOCAL_NEIGHBOURS), ((ratings > 0) & (ratings <= ranking.DISLIKED), disliked))
                groups = [(np.flatnonzero(mask), k + more) for mask, k in kinds]
                step = max(1, ranking.PAIRS // len(rids))
                for a in range(0, len(ids), step):
                    sims = block.products(queries, a, min(a + step, len(ids)))
                    sims[days >= qdays[a : a + step, None]] = -np.inf
                    want = np.zeros(sims.shape, bool)
                    for at, k in groups:
                        if len(at):
                            want[:, at] |= ranking.best_of_each(sims[:, at], k)
                    i, j = np.nonzero(want & np.isfinite(sims))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a + i]), pa.array(rids[j]), pa.array(sims[i, j]), pa.array(ratings[j]), pa.array(days[j], pa.int32()).cast(pa.date32())], [c.split()[0] for c in _NEAR.split(", ")])

    return run


def near_before(rows: DataFrame, disliked: int = ranking.LOCAL_NEIGHBOURS, block_rows: int = BLOCK_ROWS, more: int = 0) -> DataFrame:
    """(id, read_id, sim, rating, day): for each row those of earlier days that a term can need, and ``more`` of each kind.

    rows: id, rating, day, and vec or terms and weights. A row rated 0 is only a target.
    """
    packed = cut(blocks(rows, block_rows))
    targets = packed.select(F.explode(F.sequence(F.lit(0), "span")).alias("span"), F.col("last").alias("q_last"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "days", "at", "terms", "matrix")])
    met = targets.join(packed, "span").where("first < q_last")
    return met.drop("span", "part", "first", "last", "q_last").mapInArrow(_meet(disliked, _Dense if "vec" in rows.columns else _Sparse, more), _NEAR)


def _first_of_each_day(group: pd.DataFrame) -> pd.DataFrame:
    """Of reads with one vector those that are among the first of a kind, by id, up to the end of their own day."""
    group = group.sort_values(["day", "id"], ignore_index=True)
    ids, rating = group["id"].to_numpy(), group["rating"].to_numpy()
    edges = np.append(np.flatnonzero(~group["day"].duplicated().to_numpy()), len(group))
    kept = np.zeros(len(group), bool)
    for mask, k in ((rating > 0, ranking.KERNEL_NEIGHBOURS), (rating >= ranking.LIKED, ranking.LOCAL_NEIGHBOURS), (rating <= ranking.DISLIKED, ranking.LOCAL_NEIGHBOURS)):
        first = np.zeros(0, np.int64)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            first = np.sort(np.append(first, ids[a:b][mask[a:b]]))[:k]
            kept[a:b] |= mask[a:b] & np.isin(ids[a:b], first)
    return group.loc[kept, ["id"]]


def without_copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that decide all neighbours, and (id, asked): the row among them whose neighbours are those of a row.

    Rows of one vector and day have the same neighbours, so one of them asks. Rows of one
    vector tie in every comparison and then stand in order of id, so one that has enough
    of its kind before it, of its own day or earlier, is nobody's neighbour; it stays, rated
    0, if it asks. A day of a vector is cut to what each kind can need first, so what is
    scanned in one piece is a few dozen rows per day, whatever the number of copies.
    """
    vector = F.sort_array(F.arrays_zip(F.col("terms").cast("array<long>"), F.col("weights").cast("array<double>")))
    keyed = cut(rows.select(F.col("id").cast("long").alias("id"), F.col("rating").cast("double").alias("rating"), "day", F.sha2(vector.cast("string"), 256).alias("_v")))
    asking = keyed.groupBy("_v", "day").agg(F.min("id").alias("asked"))
    place = F.row_number().over(Window.partitionBy("_v", "day").orderBy("id"))
    liked, disliked = F.col("rating") >= ranking.LIKED, F.col("rating") <= ranking.DISLIKED
    kinds = ((keyed, ranking.KERNEL_NEIGHBOURS), (keyed.where(liked), ranking.LOCAL_NEIGHBOURS), (keyed.where(disliked), ranking.LOCAL_NEIGHBOURS))
    first, *more = [d.withColumn("_n", place).where(F.col("_n") <= k).drop("_n") for d, k in kinds]
    for d in more:
        first = first.unionByName(d)
    first = cut(first.dropDuplicates(["id"]))
    # With no more copies than the fewest that a kind needs, all stay.
    many = first.groupBy("_v").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > ranking.LOCAL_NEIGHBOURS).select("_v")
    scanned = first.join(many, "_v").groupBy("_v").applyInPandas(_first_of_each_day, "id long")
    stay = scanned.unionByName(first.join(many, "_v", "left_anti").select("id")).withColumn("_stays", F.lit(True))
    wanted = stay.join(asking.select(F.col("asked").alias("id")), "id", "full")
    needed = rows.withColumn("id", F.col("id").cast("long")).join(wanted, "id").withColumn("rating", F.when(F.col("_stays"), F.col("rating").cast("double")).otherwise(0.0)).drop("_stays")
    return cut(needed), keyed.join(asking, ["_v", "day"]).select("id", "asked")


def known_before(rows: DataFrame) -> DataFrame:
    """hn, hs and median of the ratings of earlier days, per day that has rows: running sums over days and rating levels."""
    cells = rows.groupBy("day", "rating").agg(F.count(F.lit(1)).alias("n"))
    days, levels = cells.select("day").distinct(), cells.select("rating").distinct()
    # Ratings have few levels, so this grid is a few rows a day.
    grid = days.crossJoin(levels).join(cells, ["day", "rating"], "left")
    upto = Window.partitionBy("rating").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.select("day", "rating", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n"))
    return grid.groupBy("day").agg(F.sum("n").alias("hn"), F.sum(F.col("n") * F.col("rating")).alias("hs"), F.expr("percentile(rating, 0.5, n)").alias("median"))


def author_before(rows: DataFrame) -> DataFrame:
    """an, as_ and liked of an author's reads of earlier days, per author and day."""
    sums = rows.groupBy("author", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("s"), F.count_if(F.col("rating") >= ranking.LIKED).alias("l"))
    upto = Window.partitionBy("author").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("author", "day", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(name) for c, name in (("n", "an"), ("s", "as_"), ("l", "liked"))])


def replay(reads: DataFrame, min_history: int = MIN_HISTORY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every record with its scores and features as of the day it was read, and what a mean or median of earlier ratings would say.

    reads: id, identity, author, rating, day, vec or terms and weights, and source_weight
    and confidence where they are known. ``score`` is the served score, ``earlier`` that of the first scorer.
    """
    rows = cut(records(reads))
    for name in ("source_weight", "confidence"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(1.0))
    if "terms" in rows.columns:
        needed, asked = without_copies(rows)
        near = near_before(needed, block_rows=block_rows).join(asked.select(F.col("asked").alias("id")).distinct(), "id", "left_semi")
        terms = asked.join(ranking.neighbour_terms(near, ranking.LOCAL_NEIGHBOURS).withColumnRenamed("id", "asked"), "asked").drop("asked")
    else:
        terms = ranking.neighbour_terms(near_before(rows, block_rows=block_rows), ranking.LOCAL_NEIGHBOURS)
    terms = terms.withColumnRenamed("down", "neg_top").withColumnRenamed("down_max", "down")
    targets = rows.select("id", "author", "day", "rating", "source_weight", "confidence")
    met = _with_records(targets, rows)
    c = met.join(terms, "id", "left").withColumn("mean", F.when(F.col("hn") > 0, F.col("hs") / F.col("hn")).otherwise(3.0))
    some, prior = F.coalesce(F.col("best") > 0, F.lit(False)), ranking.AUTHOR_PRIOR
    author = F.when(F.col("an") > 0, (F.col("as_") + prior * F.col("mean")) / (F.col("an") + prior) - F.col("mean")).otherwise(0.0)
    values = (
        F.coalesce("up", F.lit(0.25)), F.coalesce("up_max", F.lit(0.25)), F.coalesce("down", F.lit(0.0)), F.coalesce("neg_top", F.lit(0.0)),
        F.when(some, F.col("local")).otherwise(3.0) - 3, F.when(some, F.col("kernel") - F.col("mean")).otherwise(0.0), F.when(some, F.col("recent") - F.col("kernel")).otherwise(0.0),
        author, F.col("mean") - 3, F.log1p("hn"),
    )
    raw, score, _ = ranking.final_score()
    first = 42 + 48 * F.coalesce("up_max", F.lit(0.25)) - 24 * F.coalesce("down", F.lit(0.0)) + 7 * (F.col("liked") > 0).cast("int")
    first = F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), first)), 6).alias("earlier")
    out = c.select("id", "day", "rating", "hn", raw, score, first, F.col("mean").alias("prior_mean"), F.col("median").alias("prior_median"), *[v.alias(n) for n, v in zip(FEATURES, values, strict=True)])
    enough = F.col("hn") >= min_history
    return out.select("id", "day", "rating", F.col("hn").alias("history"), *[F.when(enough, F.col(n)).alias(n) for n in out.columns[4:]])


def _with_records(targets: DataFrame, rows: DataFrame) -> DataFrame:
    """Targets with what was known of all reads and of their author's before their day."""
    keyed = lambda d: d.withColumn("_none", F.col("author").isNull()).withColumn("_author", F.coalesce("author", F.lit(""))).drop("author")
    return keyed(targets).join(known_before(rows), "day").join(keyed(author_before(rows)), ["_author", "_none", "day"]).drop("_author", "_none")


def feedback_replay(feedback: DataFrame, reads: DataFrame, candidates: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Candidates last saved (label 1) or rejected (0), scored by what was read on days before that decision.

    A read of the candidate's own identity is no history of it; a candidate without
    earlier reads, or without a valid vector, goes. ``score`` is the served score,
    ``earlier`` the first scorer's. feedback: id, candidate, identity, action, at (null if
    undone); reads: id, identity, author, rating, day, vec; candidates: id, author, vec,
    and source_weight and confidence where they are known.
    """
    known = cut(records(reads))
    last = first_per(feedback.where("at is not null"), ["candidate"], [F.col("at").desc(), F.col("id").desc()]).where("action in ('save', 'reject')")
    wanted = last.select(F.col("candidate").alias("id"), "identity", (F.col("action") == "save").cast("int").alias("label"), F.to_date("at").alias("day"))
    for name in ("source_weight", "confidence"):
        if name not in candidates.columns:
            candidates = candidates.withColumn(name, F.lit(1.0))
    wanted = cut(wanted.join(candidates.where(valid(F.col("vec"))).select("id", "author", "vec", "source_weight", "confidence"), "id"))
    # One numbering for both: reads are even, targets odd.
    even, odd = (F.col("id").cast("long") * 2).alias("id"), (F.col("id").cast("long") * 2 + 1).alias("id")
    both = known.select(even, F.col("rating").cast("double").alias("rating"), "day", doubles(F.col("vec")).alias("vec")).unionByName(wanted.select(odd, F.lit(0.0).alias("rating"), "day", doubles(F.col("vec")).alias("vec")))
    own = wanted.select(odd, "identity").join(known.select(even, "identity").withColumnRenamed("id", "read_id"), "identity").select("id", "read_id")
    # At most one read is the candidate's own, so one more of each kind is enough to leave it out.
    near = near_before(both, 1, block_rows, more=1).where("id % 2 = 1").join(own, ["id", "read_id"], "left_anti")
    terms = ranking.neighbour_terms(near).withColumn("id", F.expr("shiftright(id, 1)"))
    author = lambda d: d.withColumn("_none", F.col("author").isNull()).withColumn("_author", F.coalesce("author", F.lit(""))).drop("author")
    own_read = wanted.select("id", "identity", F.col("day").alias("_day")).join(known.select("identity", F.col("rating").alias("own"), F.col("day").alias("_d"), F.col("author").alias("own_author")), "identity").where("_d < _day").select("id", "own", "own_author")
    stats = _before(known, wanted, [], {"hn": F.lit(1), "hs": F.col("rating")})
    theirs = _before(author(known), author(wanted), ["_author", "_none"], {"an": F.lit(1), "as_": F.col("rating"), "liked": (F.col("rating") >= ranking.LIKED).cast("int")})
    c = author(wanted.withColumn("_a", F.col("author"))).join(stats, "day").join(theirs, ["_author", "_none", "day"]).join(own_read, "id", "left").join(terms, "id", "left")
    gone = F.col("own").isNotNull()
    same = gone & F.col("own_author").eqNullSafe(F.col("_a"))
    c = c.withColumn("hn", F.col("hn") - gone.cast("int")).withColumn("hs", F.col("hs") - F.coalesce("own", F.lit(0.0))).where("hn > 0").withColumn("mean", F.col("hs") / F.col("hn"))
    c = c.withColumn("an", F.col("an") - same.cast("int")).withColumn("as_", F.col("as_") - F.when(same, F.col("own")).otherwise(0.0)).withColumn("liked", F.col("liked") - (same & (F.col("own") >= ranking.LIKED)).cast("int"))
    first = 42 + 48 * F.coalesce("up_max", F.lit(0.25)) - 24 * F.coalesce("down", F.lit(0.0)) + 7 * (F.col("liked") > 0).cast("int")
    return c.select("id", "label", F.col("hn").cast("long").alias("prior"), *ranking.final_score()[:2], F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), first)), 6).alias("earlier"))


def _before(rows: DataFrame, targets: DataFrame, by: list[str], values: dict) -> DataFrame:
    """Sums of ``values`` over the rows of earlier days, per day (and ``by``) that has targets: days are summed first."""
    per = rows.groupBy(*by, "day").agg(*[F.sum(v).alias(n) for n, v in values.items()], F.lit(0).alias("_t"))
    asked = targets.select(*by, "day").distinct().select(*by, "day", *[F.lit(0).alias(n) for n in values], F.lit(1).alias("_t"))
    every = per.unionByName(asked).groupBy(*by, "day").agg(*[F.sum(n).alias(n) for n in values], F.max("_t").alias("_t"))
    upto = Window.partitionBy(*(by or [F.lit(1)])).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return every.select(*by, "day", *[F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(n) for n in values], "_t").where("_t = 1").drop("_t")
