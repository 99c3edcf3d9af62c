"""Distributed fits against brute force: every pair in a table, and plain loops over rows."""

from datetime import date, timedelta

import numpy as np
import pytest

from quillrank.plans import fits
from quillrank.queries import QUERIES
from quillrank.queries.registry import reads


def ratings_table(n=150, width=3, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * [1.0, 5.0, 0.2][:width] + [3.0, 0.0, -1.0][:width]
    current = np.round(50 + 12 * rng.normal(size=n), 1)
    y = np.clip(np.round(3 + 0.7 * x[:, 0] - 2.1 + 0.05 * (current - 50) + rng.normal(size=n)), 1, 5)
    block = np.minimum(np.arange(n) * 4 // n, 3)
    return x, y, current, block


def frame(spark, x, y, current, block):
    return spark.createDataFrame([(i, float(b), float(c), int(k), a.tolist()) for i, (a, b, c, k) in enumerate(zip(x, y, current, block, strict=True))], "id long, y double, current double, block int, x array<double>").repartition(3)


def scaled(x):
    spread = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(spread < 1e-8, 1, spread)


def newton(gradient, start, hessian):
    w = start
    for _ in range(100):
        step = np.linalg.solve(hessian(w), gradient(w))
        w = w - step
        if np.abs(step).max() < 1e-12:
            break
    return w


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def plain_pairwise(x, y, current, c):
    """Newton's method on the table of all pairs."""
    z, base = scaled(x), scaled(current[:, None])[:, 0]
    i, j = np.triu_indices(len(y), k=1)
    i, j = i[y[i] != y[j]], j[y[i] != y[j]]
    side = np.sign(y[i] - y[j])
    dz, db = (z[i] - z[j]) * side[:, None], (base[i] - base[j]) * side
    grad = lambda w: -(dz * sigmoid(-(db + dz @ w))[:, None]).mean(axis=0) + w / c
    hess = lambda w: (dz * (sigmoid(db + dz @ w) * sigmoid(-(db + dz @ w)))[:, None]).T @ dz / len(i) + np.eye(x.shape[1]) / c
    w = newton(grad, np.zeros(x.shape[1]), hess)
    return w, len(i), np.logaddexp(0, -(db + dz @ w)).mean()


def test_pairwise_equals_all_pairs(spark):
    x, y, current, block = ratings_table()
    data = fits.prepared(frame(spark, x, y, current, block))
    models = fits.pairwise(data, (0.1, 1.0, 10.0), (2, None))
    assert len(models) == 6
    for m in models:
        on = block < m.fit.limit if m.fit.limit is not None else block >= 0
        w, pairs, loss = plain_pairwise(x[on], y[on], current[on], m.fit.c)
        assert m.beta == pytest.approx(w, abs=1e-6) and m.pairs == pairs and m.loss == pytest.approx(loss, abs=1e-10)
    assert models[0].cap == min(0.25 * current[block < 2].std(), 5.0)


def test_pairwise_with_wide_margins(spark):
    """A score far from the others makes margins of many intervals; constant features and equal rows change nothing."""
    x, y, current, block = ratings_table(60, 2, seed=4)
    current[3], x[5] = 5000.0, [400.0, -90.0]
    x = np.column_stack([x, np.ones(len(x))])
    x[10:14], y[10:14], current[10:14] = x[10], y[10], current[10]
    m = fits.pairwise(fits.prepared(frame(spark, x, y, current, block)), (5.0,))[0]
    w, _, loss = plain_pairwise(x, y, current, 5.0)
    assert m.beta == pytest.approx(w, abs=1e-6) and m.loss == pytest.approx(loss, abs=1e-9)


def test_no_penalty_leaves_scores(spark):
    x, y, current, block = ratings_table(40)
    m = fits.pairwise(fits.prepared(frame(spark, x, y, current, block)), (0.0,))[0]
    assert not m.beta.any() and (m.score(x, current) == np.clip(current, 0, 100)).all()


def plain_heads(x, y, c):
    z = np.column_stack([scaled(x), np.ones(len(x))])
    ridge = np.diag([1.0] * x.shape[1] + [0.0]) / c
    out = []
    for target in (y >= 4, y <= 2):
        grad = lambda w: z.T @ (sigmoid(z @ w) - target) + ridge @ w  # noqa: B023, E731
        hess = lambda w: (z * (sigmoid(z @ w) * sigmoid(-(z @ w)))[:, None]).T @ z + ridge
        out.append(newton(grad, np.zeros(z.shape[1]), hess))
    return out


def test_tail_heads_equal_newton(spark):
    x, y, current, block = ratings_table(seed=2)
    data = fits.prepared(frame(spark, x, y, current, block))
    for m in fits.tail_heads(data, (0.1, 10.0), (2, None)):
        on = block < m.fit.limit if m.fit.limit is not None else block >= 0
        high, low = plain_heads(x[on], y[on], m.fit.c)
        assert m.high == pytest.approx(high, abs=1e-5) and m.low == pytest.approx(low, abs=1e-5)
        z = np.column_stack([(x - x[on].mean(0)) / x[on].std(0), np.ones(len(x))])
        assert m.score(x, current) == pytest.approx(50 + 50 * (sigmoid(z @ high) - sigmoid(z @ low)), abs=1e-4)


def test_ordinal_is_at_a_minimum(spark):
    """No small change of any weight or threshold makes the likelihood better, which has one minimum only."""
    x, y, current, block = ratings_table(seed=3)
    m = fits.ordinal(fits.prepared(frame(spark, x, y, current, block)), 0.1)[0]
    z = scaled(x)

    def loss(beta, cuts):
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        at = y.astype(int)
        with np.errstate(over="ignore"):
            p = sigmoid(edges[at] - z @ beta) - sigmoid(edges[at - 1] - z @ beta)
        return -np.log(p).sum() + 0.05 * beta @ beta

    best = loss(m.beta, m.thresholds)
    for k in range(len(m.beta) + len(m.thresholds)):
        for step in (1e-4, -1e-4):
            v = np.concatenate([m.beta, m.thresholds])
            v[k] += step
            assert loss(v[: len(m.beta)], v[len(m.beta) :]) >= best - 1e-9
    assert (np.diff(m.thresholds) > 0).all()
    expected = m.score(x)
    assert ((1 <= expected) & (expected <= 5)).all() and np.corrcoef(expected, y)[0, 1] > 0.4


def plain_auc(label, score):
    p, q = score[label], score[~label]
    return ((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q))


@pytest.mark.parametrize("kind", ["pairwise", "tail_heads"])
def test_selection_equals_separate_fits(spark, kind):
    x, y, current, block = ratings_table(240, seed=6)
    data = fits.prepared(frame(spark, x, y, current, block))
    best, figures = fits.out_of_fold(data, getattr(fits, kind), (0.1, 1.0, 10.0), (1, 2, 3))
    got, want = {r["c"]: r for r in figures.collect()}, {}
    for c in (0.1, 1.0, 10.0):
        aucs = []
        for fold in (1, 2, 3):
            on, held = block < fold, block == fold
            mean, spread = x[on].mean(0), x[on].std(0)
            z = (x[held] - mean) / spread
            if kind == "pairwise":
                w, _, _ = plain_pairwise(x[on], y[on], current[on], c)
                s = current[on].std()
                cap = min(0.25 * s, 5)
                score = np.clip(current[held] + np.clip(s * (z @ w), -cap, cap), 0, 100)
            else:
                high, low = plain_heads(x[on], y[on], c)
                z = np.column_stack([z, np.ones(len(z))])
                score = 50 + 50 * (sigmoid(z @ high) - sigmoid(z @ low))
            score = np.array([round(float(v), 1) for v in score])
            aucs.append((plain_auc(y[held] >= 4, score), plain_auc(y[held] <= 2, -score)))
        want[c] = np.mean(aucs)
        assert [got[c]["high"], got[c]["low"]] == pytest.approx(np.mean(aucs, axis=0), abs=2e-4)
    assert best == max(want, key=lambda c: (want[c], -c)) and got[best]["chosen"] and all(r["folds"] == 3 for r in got.values())


def test_fits_of_odd_rows(spark):
    x, y, current, block = ratings_table(40)
    df = frame(spark, x, y, current, block)
    odd = spark.createDataFrame([(100, None, 1.0, 0, [1.0, 2.0, 3.0]), (101, 3.0, None, 0, [1.0, 2.0, 3.0]), (102, 3.0, 1.0, None, [1.0, 2.0, 3.0]), (103, 3.0, 1.0, 0, [1.0, None, 3.0]), (104, 3.0, 1.0, 0, None), (105, 3.0, float("nan"), 0, [1.0, 2.0, 3.0])], df.schema)
    one, two = (fits.pairwise(fits.prepared(d), (1.0,))[0].beta for d in (df, df.unionByName(odd)))
    assert one == pytest.approx(two, abs=1e-9)
    with pytest.raises(ValueError, match="unequal"):
        fits.pairwise(fits.prepared(frame(spark, x, np.full(40, 3.0), current, block)))
    with pytest.raises(ValueError, match="both classes"):
        fits.tail_heads(fits.prepared(frame(spark, x, np.full(40, 5.0), current, block)))
    with pytest.raises(ValueError, match="without training rows"):
        fits.pairwise(fits.prepared(df.limit(0)))


def test_time_folds_keep_days_whole(spark):
    rows = [(i, date(2024, 1, 1) + timedelta(days=i // 7)) for i in range(100)]
    got = fits.time_folds(spark.createDataFrame(rows, "id long, day date"), "day", 3).collect()
    by_day = {}
    for r in got:
        assert by_day.setdefault(r["day"], r["block"]) == r["block"]
    assert [by_day[d] for d in sorted(by_day)] == sorted(by_day.values()) and set(by_day.values()) == {0, 1, 2, 3}


@pytest.fixture(scope="module")
def given(spark, sf):
    """The rows that the registered fits read, as arrays."""
    rows = sorted(reads(spark, sf).collect(), key=lambda r: r["id"])
    per_day = {}
    for r in rows:
        per_day[r["day"]] = per_day.get(r["day"], 0) + 1
    before, blocks = 0, {}
    for day in sorted(per_day):
        blocks[day] = before * 4 // len(rows)
        before += per_day[day]
    current = np.array([float(np.floor((50 + 40 * float(r["vec"][8]) + 2 * r["rating"]) * 10 + 0.5)) / 10 for r in rows])
    return np.array([r["vec"][:8] for r in rows], np.float64), np.array([r["rating"] for r in rows]), current, np.array([blocks[r["day"]] for r in rows]), [r["id"] for r in rows]


def test_registered_pairwise_fits(spark, sf, given):
    x, y, current, block, _ = given
    for r in QUERIES["pairwise_fit"](spark, sf).collect():
        w, pairs, loss = plain_pairwise(x, y, current, r["c"])
        assert r["weights"] == pytest.approx(w, abs=1e-6) and r["pairs"] == pairs and r["loss"] == pytest.approx(loss, abs=1e-9)


def test_registered_heads(spark, sf, given):
    x, y, current, block, ids = given
    on = block < 3
    high, low = plain_heads(x[on], y[on], 1.0)
    z = np.column_stack([(x - x[on].mean(0)) / x[on].std(0), np.ones(len(x))])
    want = dict(zip(ids, 50 + 50 * (sigmoid(z @ high) - sigmoid(z @ low)), strict=True))
    got = {r["id"]: r["score"] for r in QUERIES["tail_head_scores"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) <= 0.0501 for i in want)
