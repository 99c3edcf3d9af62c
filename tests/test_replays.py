"""Replays as of the day, and the era fit, against plain loops."""

import math
from collections import defaultdict
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.plans import era, ranking, replay
from quillrank.queries.registry import reads
from quillrank.session import table

READ = "id long, identity string, author string, rating double, day date, vec array<double>"


def a_history(n, seed, dims=6, days=40):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        # A third of all reads on one day, few authors, some repeated vectors.
        day = date(2024, 1, 1) + timedelta(days=int(rng.integers(days)) if rng.random() > 0.33 else 17)
        vec = rng.normal(size=dims).round(1) if rng.random() > 0.2 else np.ones(dims)
        rows.append((i, f"r{i}", f"a{rng.integers(5)}" if rng.random() > 0.1 else None, float(rng.integers(2, 11) / 2), day, vec.tolist()))
    return rows


def plain_scores(rows, k):
    """One target by a loop over all earlier reads."""
    i, _, author, _, day, vec = rows[k]
    before = [r for r in rows if r[4] < day]
    n = len(before)
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    near = sorted(((float(unit(vec) @ unit(r[5])), -r[0], r) for r in before), key=lambda x: (-round(x[0], 12), -x[1]))
    mean = sum(r[3] for r in before) / n
    top = lambda group, default: sum(max(s, 0) * s + 1e-4 * s for s, _, _ in group) / sum(max(s, 0) + 1e-4 for s, _, _ in group) if group else default
    liked, bad = [x for x in near if x[2][3] >= 4], [x for x in near if x[2][3] <= 2]
    k40 = near[:40]
    w = [(max(s, 0) + 1e-8) ** 8 for s, _, _ in k40]
    newest = max(x[2][4] for x in k40)
    rw = [a * math.exp(-(newest - x[2][4]).days / 365.25 / 8) for a, x in zip(w, k40, strict=True)]
    kernel, recent = (sum(a * x[2][3] for a, x in zip(ws, k40, strict=True)) / sum(ws) for ws in (w, rw))
    ess = sum(w) ** 2 / sum(a * a for a in w)
    local = sum((max(s, 0) + 1e-4) * r[3] for s, _, r in near[:5]) / sum(max(s, 0) + 1e-4 for s, _, _ in near[:5])
    own = [r[3] for r in before if r[2] == author]
    shift = (sum(own) + 5 * mean) / (len(own) + 5) - mean if own else 0.0
    if near[0][0] <= 0:
        kernel = recent = mean
        local, ess = 3.0, 0.0
    ramp = min(1, n / 100)
    up, down = top(liked[:5], 0.25), bad[0][0] if bad else 0.0
    raw = 42 + 48 * up - 24 * down + 3.5 * (local - 3) + 3.5 * shift + 10 * ramp * (kernel - mean) * ess / (ess + 5) + 20 * ramp * (recent - kernel)
    features = [up, liked[0][0] if liked else 0.25, down, top(bad[:5], 0.0), local - 3, kernel - mean, recent - kernel, shift, mean - 3, math.log1p(n)]
    return [n, min(100, max(0, raw)), mean, float(np.median([r[3] for r in before])), *features]


@pytest.mark.parametrize("block_rows", [7, 64, 8192])
def test_replay_equals_a_loop(spark, block_rows):
    rows = a_history(160, 3)
    got = {r["id"]: r for r in replay.replay(spark.createDataFrame(rows, READ), min_history=20, block_rows=block_rows).collect()}
    assert len(got) == 160
    for k, row in enumerate(rows):
        r, n = got[row[0]], sum(x[4] < row[4] for x in rows)
        if n < 20:
            assert r["history"] == n and r["raw_score"] is None and r["kernel_shift"] is None
            continue
        want = plain_scores(rows, k)
        assert [r["history"], r["raw_score"], r["prior_mean"], r["prior_median"], *[r[c] for c in replay.FEATURES]] == pytest.approx(want, abs=2e-6)


def test_replay_sees_no_day_but_earlier_ones(spark):
    """Ratings, vectors and authors of the target's day and later don't change its score."""
    rows = a_history(120, 4)
    day = sorted(r[4] for r in rows)[80]
    changed = [r if r[4] < day else (*r[:3], 1.0, r[4], [-x for x in r[5]]) for r in rows]
    first, second = ({r["id"]: r for r in replay.replay(spark.createDataFrame(x, READ), min_history=10).collect()} for x in (rows, changed))
    early = [r[0] for r in rows if r[4] < day]
    assert early and all(first[i] == second[i] for i in early)
    # On the day itself only a target's own vector and rating count, never another's of that day.
    only = [r for r in rows if r[4] == day][0]
    alone = [r for r in rows if r[4] < day] + [only]
    assert {r["id"]: r for r in replay.replay(spark.createDataFrame(alone, READ), min_history=10).collect()}[only[0]] == first[only[0]]


def test_replay_of_odd_rows(spark):
    rows = [(1, "x", None, 4.0, date(2024, 1, 2), [1.0, 0.0]), (2, "x", "a", 1.0, date(2024, 1, 1), [0.0, 1.0]), (3, "y", "a", None, date(2024, 1, 1), [1.0, 1.0]), (4, "z", "a", 5.0, None, [1.0, 1.0]), (5, "w", None, 3.0, date(2024, 1, 3), None), (6, "v", None, 3.0, date(2024, 1, 3), [0.0, 0.0])]
    got = replay.replay(spark.createDataFrame(rows, READ), min_history=0).collect()
    assert {r["id"]: r["history"] for r in got} == {2: 0, 6: 1}
    assert replay.replay(spark.createDataFrame([], READ)).collect() == []


# The era fit.


def era_rows(effect, n=120):
    """A reader whose ratings lean on quality and, with an effect, on the era in a way no line can follow."""
    start, out = date(2021, 1, 1), []
    for i in range(n):
        year = list(range(1920, 2021, 5))[i % 21]
        quality = (2.4, 2.9, 3.3, 3.7, 4.0)[i * 7 % 5]
        lean = (0.85 if year <= 1950 or year >= 1990 else -0.85) if effect else 0.0
        out.append({"id": i + 1, "author": f"author-{i % 30}", "rating": min(5.0, max(1.0, quality + lean)), "day": start + timedelta(days=i), "year": year, "given": 50.0 + 10.0 * (quality - 3.0), "work_id": None})
    return out


def fitted(spark, rows, scorer=None, **more):
    df = spark.createDataFrame([tuple(r[c] for c in ("id", "author", "rating", "day", "year", "given", "work_id")) for r in rows], "id long, author string, rating double, day date, year int, given double, work_id string")
    return era.fit_era(df, scorer or (lambda history, queries: queries.select("id", F.col("given").alias("score"))), **more)


def test_era_activates_only_with_an_effect(spark):
    rows = era_rows(True)
    rows[0]["year"] = None
    calls = []

    def scorer(history, queries):
        first, last = queries.agg(F.min("day")).first()[0], history.agg(F.max("day")).first()[0]
        calls.append((first, last, history.count(), history.where("year is null").count()))
        return queries.select("id", F.col("given").alias("score"))

    fit = fitted(spark, rows, scorer)
    assert fit.activated and fit.reason == "all_three_folds_passed" and [f["status"] for f in fit.folds] == ["passed"] * 3
    assert len(calls) == 4 and all(last < first for first, last, _, _ in calls[1:]) and calls[0][1] < calls[1][0]
    assert all(unknown == 1 for *_, unknown in calls)
    assert fit.adjustment(1935) > 0 > fit.adjustment(1975) and fit.adjustment(2005) > 0
    assert all(abs(fit.adjustment(y)) <= era.MAX_ADJUSTMENT for y in (1935, 1975, 2005))
    assert fit.adjustment(None) == fit.adjustment("1935") == fit.adjustment(2100) == fit.adjustment(True) == 0.0


def test_era_abstains(spark):
    plain = era_rows(False)
    assert not fitted(spark, plain).activated
    sparse = [r | {"year": 1940 if n < 60 else 1990} for n, r in enumerate(plain)]
    assert fitted(spark, sparse).reason == "all_fold_confidence_gate_not_met"
    explained = []
    for r in plain:
        rating = 4.6 if r["year"] <= 1950 or r["year"] >= 1990 else 2.4
        explained.append(r | {"rating": rating, "given": 50.0 + 10.0 * (rating - 3.0)})
    assert not fitted(spark, explained).activated
    rows = era_rows(True)
    order = np.random.default_rng(981).permutation(len(rows))
    assert not fitted(spark, [r | {"year": rows[int(o)]["year"]} for r, o in zip(rows, order, strict=True)]).activated
    assert not fitted(spark, [r | {"author": "Only One Author"} for r in rows]).activated
    assert not fitted(spark, [r | {"day": date(2021, 1, 1) + timedelta(days=n // 24)} for n, r in enumerate(rows)]).activated
    assert not fitted(spark, [r | {"rating": 5.0} if n == 57 else r for n, r in enumerate(plain)]).activated
    assert fitted(spark, rows[:30]).reason == "insufficient_chronological_rows"
    assert fitted(spark, rows, lambda h, q: q.select("id", F.lit(None).cast("double").alias("score"))).reason == "baseline_scoring_failed"


def test_era_counts_a_work_once(spark):
    rows = [r | {"work_id": f"/works/OL{r['id']}W"} for r in era_rows(True)]
    again = rows + [r | {"id": r["id"] + 1000, "rating": 1.0} for r in rows]
    one, two = fitted(spark, rows), fitted(spark, again)
    assert two.activated and [one.adjustment(y) for y in range(1915, 2026)] == [two.adjustment(y) for y in range(1915, 2026)]


def test_era_local_estimates_by_a_loop():
    rng = np.random.default_rng(5)
    years, residuals = rng.integers(1950, 2000, 60).astype(float), rng.normal(0.4, 0.6, 60)
    authors, days = rng.integers(0, 20, 60), rng.integers(0, 40, 60)
    local = era.Local(years, residuals, authors, days)
    for year in range(1940, 2010, 3):
        w = [math.exp(-0.5 * ((y - year) / 10) ** 2) for y in years]
        mean = sum(a * r for a, r in zip(w, residuals, strict=True)) / sum(w)
        errors = [math.sqrt(sum(a * (r - mean) ** 2 for a, r in zip(w, residuals, strict=True)) / sum(w) / (sum(w) ** 2 / sum(a * a for a in w)))]
        for groups in (authors, days):
            pull = defaultdict(float)
            for g, a, r in zip(groups, w, residuals, strict=True):
                pull[g] += a * (r - mean) / sum(w)
            errors.append(math.sqrt(len(pull) / (len(pull) - 1) * sum(v * v for v in pull.values())))
        got, why = local.estimate(year)
        if why == "supported":
            assert got == pytest.approx(mean) and abs(mean) > 1.96 * max(errors)
        elif why == "correction_uncertainty_includes_zero":
            assert abs(mean) <= 1.96 * max(errors)
        else:
            assert year < years.min() or year > years.max() or why == "low_local_support"
    gap = era.Local(np.array([1920.0] * 10 + [2020.0] * 10), np.array([0.5] * 10 + [-0.5] * 10), np.arange(20), np.arange(20))
    assert gap.estimate(1970) == (0.0, "unsupported_local_gap")


def test_era_with_the_librarys_scorer(spark):
    """Scores of the ranker itself support a bounded correction."""
    rng = np.random.default_rng(4021)
    years, rows = list(range(1920, 2021, 5)), []
    for i in range(128):
        kind, year = i * 7 % 10, years[i * 13 % 21]
        lean = 0.8 if year <= 1950 or year >= 1990 else -0.8
        vec = np.zeros(10)
        vec[kind] = 1.0
        vec += rng.normal(0.0, 0.07, size=10)
        rows.append((i + 1, f"r{i}", f"author {i % 32}", min(5.0, max(1.0, 2.2 + 0.2 * kind + lean)), date(2022, 1, 1) + timedelta(days=i), (vec / np.linalg.norm(vec)).tolist(), year))
    df = spark.createDataFrame(rows, READ + ", year int")
    own = lambda q: q.withColumns({"source_weight": F.lit(1.0), "confidence": F.lit(1.0)})
    fit = era.fit_era(df, lambda history, queries: ranking.score_candidates(history, own(queries), leave_one_out=True))
    assert fit.activated and fit.adjustment(1930) > 0 > fit.adjustment(1975) and fit.adjustment(2010) > 0


def test_era_samples_a_spread_of_a_long_history(spark, sf):
    few = era._sample(reads(spark, sf), 250, 128)
    every = sorted((r["day"], r["id"]) for r in reads(spark, sf).select("day", "id").collect())
    assert sorted((r["day"], r["id"]) for r in few.select("day", "id").collect()) == [every[int(k)] for k in np.linspace(0, 249, 128, dtype=np.int64)]


def test_sparse_neighbours_of_all_documents(spark):
    """The top 40 of every document by TF-IDF of its whole words, as by a loop, in blocks of several sizes."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").withColumn("text", F.coalesce("text", F.lit("")))
    words = docs.select("doc_id", F.explode(F.split("text", "[^A-Za-z]+")).alias("term")).groupBy("doc_id", "term").count()
    n = docs.count()
    idf = words.groupBy("term").agg((F.log(F.lit(1.0 + n) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    long = words.join(idf, "term").select("doc_id", F.xxhash64("term").alias("term"), (F.col("count") * F.col("idf")).alias("w"))
    rows = long.groupBy("doc_id").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("w"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 50).cast("int"))
    rows = rows.select(F.col("doc_id").alias("id"), (1 + F.col("doc_id") % 5).cast("double").alias("rating"), day.alias("day"), "terms", F.transform("w", lambda x: x / F.col("norm")).alias("weights")).cache()
    every = [(r["id"], r["rating"], r["day"], dict(zip(r["terms"], r["weights"], strict=True))) for r in rows.collect()]
    want = {}
    for i, _, day, v in every:
        sims = sorted(((-round(sum(w * u.get(t, 0.0) for t, w in v.items()), 12), j, rating) for j, rating, d, u in every if d < day))
        keep = sims[:40] + [x for x in sims if x[2] >= 4][:5] + [x for x in sims if x[2] <= 2][:5]
        want[i] = {j: -s for s, j, _ in keep}
    for block_rows in (23, 8192):
        got = {}
        for r in replay.near_before(rows, 5, block_rows).collect():
            got.setdefault(r["id"], {})[r["read_id"]] = r["sim"]
        for i, near in want.items():
            assert near.keys() <= got.get(i, {}).keys()
            assert all(abs(got[i][j] - s) < 1e-9 for j, s in near.items())
            best = sorted(got.get(i, {}).items(), key=lambda x: (-x[1], x[0]))[:40]
            assert [round(s, 9) for _, s in best] == sorted((round(s, 9) for s in near.values()), reverse=True)[: len(best)]


@pytest.mark.parametrize(("leave_one_out", "disliked", "n"), [(False, 1, 90), (True, 1, 90), (True, 3, 90), (False, 3, 7), (True, 1, 1), (False, 1, 0)])
def test_one_pass_terms_equal_windows(spark, monkeypatch, leave_one_out, disliked, n):
    """Ties, repeated vectors, opposite vectors, unknown days, and histories shorter than any neighbourhood."""
    rows = [(i, name, a, float(np.clip(round(r), 1, 5)), None if i % 4 == 0 else day, vec if i % 9 else [-x for x in vec]) for i, name, a, r, day, vec in a_history(n, 6)]
    history = spark.createDataFrame(rows, READ)
    wanted = a_history(50, 7)
    shape = "id long, identity string, author string, vec array<double>, source_weight double, confidence double"
    wanted = spark.createDataFrame([(i, f"r{i}" if i % 2 else f"c{i}", a, vec, 1.0 + i % 3 / 10, 0.9) for i, _, a, _, _, vec in wanted], shape)

    def scores():
        return {r["id"]: [None if v is None else round(v, 5) for v in r] for r in ranking.score_candidates(history, wanted, leave_one_out, disliked=disliked, centred=n == 7).collect()}

    one = scores()
    monkeypatch.setattr(ranking, "BLOCK_ROWS", -1)
    assert scores() == one and len(one) == 50
