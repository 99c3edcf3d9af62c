"""Fits whose gradients are sums over Spark's tasks: tail heads, ordinal logit, pairwise ranker.

Every fold and penalty is a fit of its own, and all take their steps together: one job
gives the loss and gradient of every fit that still runs, so a grid costs as many rounds
as its slowest fit. A task sends a few numbers per fit, added up by Spark. Features are
scaled by each fit's own training rows, from moments per block that are taken once.

The pairwise loss is the mean over all pairs of unequal ratings of log(1 + exp(-d)), d
the better row's margin less the worse one's, and no pair is ever made. What a row adds
depends only on its margin m and, for each rating class, on two smooth functions of m: the
sums over the class of sigmoid(m' - m) and log(1 + exp(m' - m)). Both are analytic in a
strip of pi around the axis, so on intervals of width 2 their interpolants at NODES
Chebyshev points are exact to rounding. A first pass finds the range of margins, a second
sums both functions at the nodes, a third reads every row's gradient off them: the cost
grows with rows, not pairs.

Rows with a null or non-finite feature, rating, score or block are left out. A fit needs
both classes of its target (heads), all levels (ordinal) or two unequal ratings
(pairwise) in its training rows, and raises ValueError without them.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.vectors import valid
from quillrank.operators.aggregates import rank_auc
from quillrank.session import cut

HIGH, LOW = 4.0, 2.0
#: Of the pairwise correction: a share of the score's spread, and points at most.
CAP_SHARE, CAP_POINTS = 0.25, 5.0
PENALTIES = (0.1, 1.0, 10.0)
NODES = 18
#: Levels of rating that a fit can tell apart; sums per level are held for each node.
MAX_LEVELS = 64
MEMORY, MAX_STEPS = 10, 500
#: Rows that one task of a step takes.
ROWS_PER_TASK = 50_000


@dataclass(frozen=True)
class Prepared:
    """Rows (id, block, y, current, x) written once, and each block's count, means and variances of (x, current)."""

    rows: DataFrame
    moments: dict[int, tuple[int, np.ndarray, np.ndarray]]
    levels: np.ndarray

    def scale(self, limit: int | None) -> tuple[int, np.ndarray, np.ndarray]:
        """Count, mean and spread of the rows of blocks before ``limit`` (all for None)."""
        n, mean, var = 0, 0.0, 0.0
        for block, (k, m, v) in sorted(self.moments.items()):
            if limit is None or block < limit:
                off, total = m - mean, n + k
                mean, var, n = mean + off * k / total, (n * var + k * v) / total + off * off * n * k / total**2, total
        if not n:
            raise ValueError("a fold without training rows")
        spread = np.sqrt(var)
        return n, mean, np.where(spread < 1e-8, 1.0, spread)


def time_folds(rows: DataFrame, day: str, folds: int) -> DataFrame:
    """``rows`` with ``block`` 0 to ``folds``: whole days in order, in parts of about equal count."""
    days = rows.groupBy(day).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy(F.lit(1)))
    return rows.join(days.select(day, F.floor(before * (folds + 1) / total).cast("int").alias("block")), day)


def prepared(rows: DataFrame) -> Prepared:
    """rows: id, y, x (array of numbers) and, where there are any, current (a score) and block."""
    for name in ("current", "block"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(0))
    x = F.col("x").cast("array<double>")
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("block").cast("int").alias("block"), F.col("y").cast("double").alias("y"), F.col("current").cast("double").alias("current"), x.alias("x"))
    fine = F.col("block").isNotNull() & valid(F.col("x")) & valid(F.array("y", "current"))
    rows = cut(rows.where(fine))
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = rows.where(F.size("x") == width)
    every = [F.col("x")[k] for k in range(width)] + [F.col("current")]
    sums = rows.groupBy("block").agg(F.count(F.lit(1)), *[F.avg(c) for c in every], *[F.var_pop(c) for c in every])
    moments = {r[0]: (r[1], np.array(r[2 : 3 + width]), np.array(r[3 + width :])) for r in sums.collect()}  # a row per block
    # Every step is a job over all rows, so a small table shouldn't be many tasks.
    rows = rows.coalesce(max(1, -(-sum(m[0] for m in moments.values()) // ROWS_PER_TASK)))
    levels = [r[0] for r in rows.select("y").distinct().orderBy("y").limit(MAX_LEVELS + 1).collect()]
    if len(levels) > MAX_LEVELS:
        raise ValueError(f"more than {MAX_LEVELS} levels of rating")
    return Prepared(rows, moments, np.array(levels))


# Sums over tasks.


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    x = batch.column("x")
    flat = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
    return flat, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "current", "block"))


def _reduced(rows: DataFrame, each: Callable, most: bool = False) -> dict[int, np.ndarray]:
    """For every number that ``each`` yields with a batch's vector: the sum (or maximum) of its vectors over all batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for k, v in each(*_columns(batch)):
                    total[k] = v if k not in total else (np.maximum if most else np.add)(total[k], v)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["fit", "values"])

    parts = rows.mapInArrow(run, "fit int, values array<double>").select("fit", F.posexplode("values").alias("at", "value"))
    out: dict[int, dict] = {}
    for r in parts.groupBy("fit", "at").agg((F.max if most else F.sum)("value").alias("value")).collect():  # a few numbers per fit
        out.setdefault(r["fit"], {})[r["at"]] = r["value"]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


# Steps.

Step = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


def descent(start: np.ndarray, tolerance: float = 1e-9) -> Step:
    """Quasi-Newton steps with limited memory: yields where to look, is sent loss and gradient there, returns the minimum."""
    x = start
    loss, gradient = yield x
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(MAX_STEPS):
        if np.abs(gradient).max(initial=0.0) <= tolerance:
            break
        way, kept = -gradient, []
        for s, d in reversed(pairs):
            kept.append((a := (s @ way) / (s @ d), s, d))
            way = way - a * d
        if pairs:
            s, d = pairs[-1]
            way = way * ((s @ d) / (d @ d))
        for a, s, d in reversed(kept):
            way = way + s * (a - (d @ way) / (s @ d))
        slope = float(gradient @ way)
        if slope >= 0:
            pairs, way, slope = [], -gradient, -float(gradient @ gradient)
        size = 1.0 if pairs else min(1.0, 1.0 / max(np.linalg.norm(gradient), 1e-12))
        while True:
            there = x + size * way
            new_loss, new_gradient = yield there
            # Near the minimum losses are equal to rounding, and only the slope still tells.
            if new_loss <= loss + 1e-4 * size * slope or (new_loss <= loss + 1e-14 * abs(loss) and abs(new_gradient @ way) <= abs(slope)):
                break
            size /= 2
            if size < 1e-12:
                return x
        s, d = there - x, new_gradient - gradient
        if s @ d > 1e-300:
            pairs = [*pairs, (s, d)][-MEMORY:]
        x, loss, gradient = there, new_loss, new_gradient
    return x


def minimized(starts: dict[int, np.ndarray], evaluate: Callable[[dict[int, np.ndarray]], dict[int, tuple[float, np.ndarray]]], tolerance: float = 1e-9) -> dict[int, np.ndarray]:
    """All minima, every fit that still runs looked at in the same jobs."""
    steps = {k: descent(x, tolerance) for k, x in starts.items()}
    looks, found = {k: next(s) for k, s in steps.items()}, {}
    while looks:
        seen = evaluate(looks)
        looks_next = {}
        for k in looks:
            try:
                looks_next[k] = steps[k].send(seen[k])
            except StopIteration as end:
                found[k] = end.value
        looks = looks_next
    return found


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass(frozen=True)
class Fit:
    """What a fit is trained on (blocks before ``limit``), its penalty, and its scaling."""

    limit: int | None
    c: float
    mean: np.ndarray
    spread: np.ndarray
    n: int

    def train(self, block: np.ndarray) -> np.ndarray:
        return np.ones(len(block), bool) if self.limit is None else block < self.limit

    def z(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean[:-1]) / self.spread[:-1]

    def base(self, current: np.ndarray) -> np.ndarray:
        return (current - self.mean[-1]) / self.spread[-1]


def _fits(data: Prepared, penalties, limits) -> list[Fit]:
    out = []
    for limit in limits:
        n, mean, spread = data.scale(limit)
        out += [Fit(limit, float(c), mean, spread, n) for c in penalties]
    return out


def _needs(data: Prepared, fits: list[Fit], classes: Callable[[np.ndarray], np.ndarray], what: str) -> list[np.ndarray]:
    """Each fit's training rows per level; raises unless every class has some in every fit."""
    counts: dict[int, np.ndarray] = {}
    for r in data.rows.groupBy("block", "y").count().collect():  # blocks times levels
        counts.setdefault(r["block"], np.zeros(len(data.levels)))[np.searchsorted(data.levels, r["y"])] += r["count"]
    out = [sum((v for b, v in counts.items() if fit.limit is None or b < fit.limit), np.zeros(len(data.levels))) for fit in fits]
    if not all(have[mask].any() for have in out for mask in classes(data.levels)):
        raise ValueError(what)
    return out


# Tail heads.


@dataclass(frozen=True)
class Heads:
    """Two logistic heads, for high and for low ratings."""

    fit: Fit
    high: np.ndarray
    low: np.ndarray

    def score(self, x: np.ndarray, current: np.ndarray) -> np.ndarray:
        z = self.fit.z(x)
        high, low = (_sigmoid(z @ w[:-1] + w[-1]) for w in (self.high, self.low))
        return np.clip(50.0 + 50.0 * (high - low), 0.0, 100.0)


def tail_heads(data: Prepared, penalties=PENALTIES, limits=(None,)) -> list[Heads]:
    """Ridge logistic heads: ``c`` times the summed loss and half the squared weights, the intercept free."""
    fits = _fits(data, penalties, limits)
    _needs(data, fits, lambda y: [y >= HIGH, y < HIGH, y <= LOW, y > LOW], "training rows need both classes for each tail head")
    targets = (lambda y: y >= HIGH, lambda y: y <= LOW)

    def evaluate(looks):
        def each(x, y, current, block):
            for k, w in looks.items():
                fit, side = fits[k // 2], 2.0 * targets[k % 2](y) - 1
                on = fit.train(block)
                z, s = fit.z(x[on]), side[on]
                margin = s * (z @ w[:-1] + w[-1])
                pull = -s * _sigmoid(-margin)
                yield k, np.concatenate([[np.logaddexp(0.0, -margin).sum()], z.T @ pull, [pull.sum()]])

        sums = _reduced(data.rows, each)
        out = {}
        for k, w in looks.items():
            fit, ridge = fits[k // 2], np.append(w[:-1], 0.0)
            # Scaled to the mean loss, so that one tolerance fits every size.
            out[k] = (sums[k][0] + 0.5 * float(ridge @ ridge) / fit.c) / fit.n, (sums[k][1:] + ridge / fit.c) / fit.n
        return out

    width = len(fits[0].mean)
    found = minimized({k: np.zeros(width) for k in range(2 * len(fits))}, evaluate)
    return [Heads(fit, found[2 * k], found[2 * k + 1]) for k, fit in enumerate(fits)]


# Ordinal logit.


@dataclass(frozen=True)
class Ordinal:
    fit: Fit
    beta: np.ndarray
    thresholds: np.ndarray
    levels: np.ndarray

    def latent(self, x: np.ndarray) -> np.ndarray:
        return self.fit.z(x) @ self.beta

    def score(self, x: np.ndarray, current: np.ndarray | None = None) -> np.ndarray:
        """The expected rating."""
        below = _sigmoid(self.thresholds - self.latent(x)[:, None])
        chance = np.diff(np.column_stack([np.zeros(len(x)), below, np.ones(len(x))]), axis=1)
        return np.maximum(chance, 0.0) / np.maximum(chance, 0.0).sum(axis=1, keepdims=True) @ self.levels


_GAP = 1e-3  # thresholds stand at least this far apart


def _thresholds(tail: np.ndarray) -> np.ndarray:
    return np.concatenate([tail[:1], tail[0] + np.cumsum(np.logaddexp(0.0, tail[1:]) + _GAP)])


def _tail(shares: np.ndarray) -> np.ndarray:
    """What ``_thresholds`` makes into the log odds of these shares."""
    odds = np.log(shares / (1 - shares))
    return np.concatenate([odds[:1], np.log(np.expm1(np.maximum(np.diff(odds) - _GAP, _GAP)))])


def ordinal(data: Prepared, ridge: float = 0.1, limits=(None,)) -> list[Ordinal]:
    """Proportional odds with ordered thresholds: summed loss and half ``ridge`` times the squared weights."""
    fits = _fits(data, [1.0 / ridge], limits)
    levels = data.levels
    if len(levels) < 2:
        raise ValueError("two levels of rating at least")
    counts = _needs(data, fits, lambda y: [y == v for v in y], "training rows must contain all rating levels")
    width = len(fits[0].mean) - 1

    def evaluate(looks):
        def each(x, y, current, block):
            for k, w in looks.items():
                on = fits[k].train(block)
                z, at = fits[k].z(x[on]), np.searchsorted(levels, y[on])
                cuts = np.concatenate([[-np.inf], _thresholds(w[width:]), [np.inf]])
                eta = z @ w[:width]
                upper, lower = cuts[at + 1] - eta, cuts[at] - eta
                with np.errstate(invalid="ignore"):
                    up, low = _sigmoid(upper), _sigmoid(lower)
                chance = np.maximum(up - low, 1e-12)
                du, dl = up * (1 - up) / chance, low * (1 - low) / chance
                side = np.zeros(len(levels) + 1)
                np.add.at(side, at + 1, -du)
                np.add.at(side, at, dl)
                yield k, np.concatenate([[-np.log(chance).sum()], z.T @ (du - dl), side[1:-1]])

        sums = _reduced(data.rows, each)
        out = {}
        for k, w in looks.items():
            beta, tail, side = w[:width], w[width:], sums[k][1 + width :]
            after = np.cumsum(side[::-1])[::-1]  # a gap moves its threshold and all above
            grad = np.concatenate([sums[k][1 : 1 + width] + ridge * beta, [after[0]], _sigmoid(tail[1:]) * after[1:]])
            out[k] = (sums[k][0] + 0.5 * ridge * float(beta @ beta)) / fits[k].n, grad / fits[k].n
        return out

    # Thresholds begin where they fit the shares of the levels, as if no feature said anything.
    found = minimized({k: np.concatenate([np.zeros(width), _tail(np.cumsum(n)[:-1] / n.sum())]) for k, n in enumerate(counts)}, evaluate)
    return [Ordinal(fit, found[k][:width], _thresholds(found[k][width:]), levels) for k, fit in enumerate(fits)]


# Pairwise ranker.


@dataclass(frozen=True)
class Pairwise:
    """A capped correction of the current score."""

    fit: Fit
    beta: np.ndarray
    pairs: float
    loss: float

    @property
    def cap(self) -> float:
        return min(CAP_SHARE * float(self.fit.spread[-1]), CAP_POINTS)

    def score(self, x: np.ndarray, current: np.ndarray) -> np.ndarray:
        move = np.clip(self.fit.spread[-1] * (self.fit.z(x) @ self.beta), -self.cap, self.cap)
        return np.clip(current + move, 0.0, 100.0)


_POINTS = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
_WEIGHTS = (-1.0) ** np.arange(NODES) * np.sin((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))


def _basis(t: np.ndarray) -> np.ndarray:
    """Values at ``t`` in [-1, 1] of the polynomials that are one at a node and zero at the others."""
    off = t[:, None] - _POINTS
    hit = np.abs(off) < 1e-15
    w = _WEIGHTS / np.where(hit, 1.0, off)
    out = w / w.sum(axis=1, keepdims=True)
    on = hit.any(axis=1)
    out[on] = hit[on]
    return out


@dataclass(frozen=True)
class _Grid:
    """Intervals of width 2 at most over a range of margins."""

    low: float
    width: float
    n: int

    @staticmethod
    def over(low: float, high: float) -> _Grid:
        n = max(1, int(np.ceil((high - low) / 2)))
        return _Grid(low, max((high - low) / n, 1e-9), n)

    def nodes(self) -> np.ndarray:
        return (self.low + self.width * (np.arange(self.n)[:, None] + (_POINTS + 1) / 2)).ravel()

    def of(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of each margin, and the node polynomials' values there."""
        at = (m - self.low) / self.width
        k = np.clip(at.astype(int), 0, self.n - 1)
        return k, _basis(np.clip(2 * (at - k) - 1, -1.0, 1.0))


def pairwise(data: Prepared, penalties=PENALTIES, limits=(None,), chunk: int = 512) -> list[Pairwise]:
    """Fits of the mean pair loss and half the squared weights over ``c``; the scaled current score is a fixed offset. ``c`` 0 leaves the score as it is."""
    fits, levels = _fits(data, penalties, limits), data.levels
    classes = len(levels)

    def margins(looks):
        def of(x, current, block):
            for k, w in looks.items():
                on = fits[k].train(block)
                z = fits[k].z(x[on])
                yield k, on, z, fits[k].base(current[on]) + z @ w

        return of

    def evaluate(looks):
        of = margins(looks)

        def ends(x, y, current, block):
            for k, _, _, m in of(x, current, block):
                if len(m):
                    yield k, np.array([-m.min(), m.max()])

        grids = {k: _Grid.over(-v[0], v[1]) for k, v in _reduced(data.rows, ends, most=True).items()}

        def at_nodes(x, y, current, block):
            for k, on, _, m in of(x, current, block):
                nodes, level = grids[k].nodes(), np.searchsorted(levels, y[on])
                total = np.zeros((2, classes, len(nodes)))
                for i in range(0, len(m), chunk):
                    off = m[i : i + chunk, None] - nodes
                    one = (level[i : i + chunk] == np.arange(classes)[:, None]).astype(float)
                    total[0] += one @ _sigmoid(off)
                    total[1] += one @ np.logaddexp(0.0, off)
                yield k, np.concatenate([np.bincount(level, minlength=classes), total.ravel()])

        sums = _reduced(data.rows, at_nodes)
        counts = {k: v[:classes] for k, v in sums.items()}
        tables = {k: v[classes:].reshape(2, classes, grids[k].n, NODES) for k, v in sums.items()}

        def per_row(x, y, current, block):
            for k, on, z, m in of(x, current, block):
                level, below = np.searchsorted(levels, y[on]), np.arange(classes)
                total = np.zeros(1 + z.shape[1])
                for i in range(0, len(m), chunk):
                    interval, basis = grids[k].of(m[i : i + chunk])
                    won, cost = np.einsum("fcnk,nk->fnc", tables[k][:, :, interval], basis)
                    own = level[i : i + chunk, None]
                    pull = np.where(below > own, counts[k] - won, 0.0).sum(axis=1) - np.where(below < own, won, 0.0).sum(axis=1)
                    total[0] += np.where(below < own, cost, 0.0).sum()
                    total[1:] += z[i : i + chunk].T @ pull
                yield k, total

        sums, out = _reduced(data.rows, per_row), {}
        for k, w in looks.items():
            pairs = pairs_of(counts[k])
            if not pairs:
                raise ValueError("pairwise training requires unequal ratings")
            lost[k], made[k] = float(sums[k][0] / pairs), pairs
            ridge = w / fits[k].c if fits[k].c else np.zeros_like(w)
            out[k] = lost[k] + 0.5 * float(w @ ridge), sums[k][1:] / pairs + ridge if fits[k].c else np.zeros_like(w)
        return out

    lost: dict[int, float] = {}
    made: dict[int, float] = {}
    width = len(fits[0].mean) - 1
    found = minimized({k: np.zeros(width) for k in range(len(fits))}, evaluate)
    evaluate(found)
    return [Pairwise(fit, found[k], made[k], lost[k]) for k, fit in enumerate(fits)]


def pairs_of(counts: np.ndarray) -> float:
    """Pairs of rows of unequal level."""
    return float((counts.sum() ** 2 - (counts**2).sum()) / 2)


# Scores and selection.


def scored(rows: DataFrame, models: list, tenths: bool = True) -> DataFrame:
    """(fit, id, block, y, score): every row by every model; served scores have one decimal. rows: as prepared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, current, block = _columns(batch)
            for k, model in enumerate(models):
                score = model.score(x, current)
                score = np.array([round(float(s), 1) for s in score]) if tenths else score
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), k, np.int32)), batch.column("id"), batch.column("block"), batch.column("y"), pa.array(score)], ["fit", "id", "block", "y", "score"])

    return rows.mapInArrow(run, "fit int, id long, block int, y double, score double")


def out_of_fold(data: Prepared, fit: Callable, penalties=PENALTIES, folds=(1,)) -> tuple[float, DataFrame]:
    """The penalty with the best mean balanced AUC over forward folds (of ties the smallest), and each penalty's figures.

    ``fit`` is ``pairwise`` or ``tail_heads``; a fold is trained on the blocks before it
    and judged on its own, and scores of different folds are never compared.
    """
    models = fit(data, penalties, folds)
    where = F.array(*[F.lit(m.fit.limit) for m in models])
    held = scored(data.rows, models).where(F.col("block") == where[F.col("fit")])
    held = cut(held.withColumn("c", F.array(*[F.lit(m.fit.c) for m in models])[F.col("fit")]))
    per_fold = None
    for name, label, score in (("high", F.col("y") >= HIGH, F.col("score")), ("low", F.col("y") <= LOW, -F.col("score"))):
        auc = rank_auc(held.select("c", "block", label.cast("int").alias("label"), score.alias("score")), "label", "score", ["c", "block"]).withColumnRenamed("auc", name)
        per_fold = auc if per_fold is None else per_fold.join(auc, ["c", "block"])
    figures = per_fold.groupBy("c").agg(F.avg("high").alias("high"), F.avg("low").alias("low"), F.avg((F.col("high") + F.col("low")) / 2).alias("balanced"), F.count(F.lit(1)).cast("int").alias("folds"))
    rows = figures.collect()  # a row per penalty
    best = max(rows, key=lambda r: (r["balanced"] if r["balanced"] is not None else -1.0, -r["c"]))["c"]
    shape = "c double, high double, low double, balanced double, folds int, chosen boolean"
    return best, data.rows.sparkSession.createDataFrame([(*r, r["c"] == best) for r in rows], shape)
