"""Queries that SQL cannot say, row by row in plain Python."""

import datetime as dt
from collections import defaultdict

import numpy as np
import pytest

from quillrank.queries import QUERIES


def rows_of(spark, sf, name):
    return [r.asDict() for r in QUERIES[name](spark, sf).collect()]


@pytest.fixture(scope="module")
def vectors(spark, sf):
    return {r["vec_id"]: (np.array(r["embedding"], float), r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}


def cosine(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b) / n if n else 0.0


def test_slate_diversify(spark, sf, vectors):
    """Every slot in turn: of the next three the one that repeats least, then scores most, if it repeats less and costs little."""
    pages = defaultdict(list)
    for i, (v, label) in vectors.items():
        if i % 2:
            pages[i % 7].append((i, 60 + i * 37 % 30, f"a{label}", v))
    want = {}
    for run, page in pages.items():
        page = sorted(page, key=lambda r: (-r[1], r[0]))[:24]
        home = {r[0]: k for k, r in enumerate(page)}
        for slot in range(min(8, len(page))):
            shown = page[:slot]
            cost = lambda r: sum((r[2] == o[2]) + (cosine(r[3], o[3]) >= 0.75) for o in shown)
            here = cost(page[slot])
            fit = [(cost(page[k]), -page[k][1], k) for k in range(slot + 1, min(len(page), slot + 4)) if cost(page[k]) < here and abs(home[page[k][0]] - slot) <= 3 and abs(home[page[slot][0]] - k) <= 3 and page[k][1] >= page[slot][1] - 5]
            if here and fit:
                k = min(fit)[2]
                page[slot], page[k] = page[k], page[slot]
        want |= {(run, r[0]): k + 1 for k, r in enumerate(page)}
    assert {(r["run"], r["id"]): r["position"] for r in rows_of(spark, sf, "slate_diversify")} == want


def test_reserved_slot(spark, sf, vectors):
    pages = defaultdict(list)
    for i, (v, label) in vectors.items():
        if i % 2:
            pages[i // 40].append((i % 40 // 2 + 1, i, f"a{label}", round(90 - i % 40 / 4, 2), v))
    want = {}
    for run, page in pages.items():
        page.sort()
        taken = lambda r: any(r[2] == o[2] or cosine(r[4], o[4]) >= 0.9 for o in page[:7])
        if len(page) > 8 and taken(page[7]):
            for k in range(8, min(11, len(page))):
                if page[7][3] - page[k][3] <= 2 and not taken(page[k]):
                    page[7], page[k] = page[k], page[7]
                    break
        want |= {(run, r[1]): k + 1 for k, r in enumerate(page)}
    assert {(r["run"], r["id"]): r["position"] for r in rows_of(spark, sf, "reserved_slot")} == want


def test_epsilon_explore(spark, sf):
    """The head stays; a run's tail is a permutation; chances are those of a draw with chance 0.3 among the tail."""
    pages = defaultdict(list)
    for r in rows_of(spark, sf, "epsilon_explore"):
        pages[r["run"]].append(r)
    for page in pages.values():
        n = len(page) - 4
        assert sorted(r["position"] for r in page) == list(range(1, len(page) + 1))
        for r in page:
            want = 1.0 if r["pos"] <= 4 else (0.7 if r["position"] == r["pos"] else 0.0) + 0.3 / n
            assert r["propensity"] == pytest.approx(want) and (r["pos"] > 4 or r["position"] == r["pos"])


def test_served_slate(spark, sf):
    """The whole chain: the first four places of a page come from its first recommended ones, all places are filled once."""
    plain = {(r["run"], r["id"]): r for r in rows_of(spark, sf, "served_page")}
    whole = {(r["run"], r["id"]): r for r in rows_of(spark, sf, "served_slate")}
    pages = defaultdict(list)
    for (run, _), r in whole.items():
        pages[run].append(r)
        assert 0 < r["propensity"] <= 1 and (r["position"] > 4 or r["propensity"] == 1)
    for page in pages.values():
        assert sorted(r["position"] for r in page) == list(range(1, len(page) + 1))
        assert sum(r["status"] == "recommended" for r in page) == 24
    # A slot moves by three places at most before the deltas, so the top of one page is near the top of the other.
    assert sum(k in plain for k in whole) >= 0.95 * len(whole)


def test_isotonic_calibration(spark, sf):
    """The fit is the greatest, over starts, of the least mean over ends; rows of one value are one point."""
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    x = {r["doc_id"]: r["n_chars"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r["doc_id"] in labels}
    points = defaultdict(list)
    for i, v in x.items():
        points[v].append(labels[i])
    values = sorted(points)
    total, count = np.cumsum([0, *(sum(points[v]) for v in values)]), np.cumsum([0, *(len(points[v]) for v in values)])
    fit = {}
    for k, v in enumerate(values):
        means = (total[None, k + 1 :] - total[: k + 1, None]) / (count[None, k + 1 :] - count[: k + 1, None])
        fit[v] = means.min(axis=1).max()
    got = rows_of(spark, sf, "isotonic_calibration")
    assert len(got) == len(x) and all(r["calibrated"] == pytest.approx(fit[x[r["doc_id"]]], abs=1e-5) for r in got)


def test_stream_decisions(spark, sf):
    events = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/events.parquet").collect():
        events[r["user_id"]].append((r["ts"], r["event_type"]))
    want = {}
    for user, found in events.items():
        now = before = None
        for _, action in sorted(found, key=lambda e: e[0]):
            if action != "error":
                now, before = action, now
            elif before is not None:
                now, before = before, None
            else:
                now = before = None
        want[user] = (now, len(found))
    tied = {u for u, f in events.items() if len({t for t, _ in f}) < len(f)}
    got = {r["book"]: (r["decision"], r["seen"]) for r in rows_of(spark, sf, "stream_decisions")}
    assert got.keys() == want.keys() and all(got[u] == want[u] for u in want if u not in tied) and len(tied) < len(want)


def test_visible_days_are_exact(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillrank.streaming import events as S

    start = dt.datetime(2024, 1, 1)
    rows = [(k % 3, start + dt.timedelta(hours=7 * k)) for k in range(300)]
    spark.createDataFrame(rows, "book long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = S.visible_days(spark.readStream.schema("book long, ts timestamp").parquet(str(tmp_path / "in")), "book")
    got = S.run_to_end(stream, "exact_days", str(tmp_path / "cp"), "complete").select("book", F.unix_timestamp("window.start").alias("s"), F.unix_timestamp("window.end").alias("e"), "days", "n").collect()
    for r in got:
        inside = [t for b, t in rows if b == r["book"] and r["s"] <= t.replace(tzinfo=dt.UTC).timestamp() < r["e"]]
        assert (r["days"], r["n"]) == (len({t.date() for t in inside}), len(inside))
    assert len(got) > 200


def test_weighted_auc_registers_and_holds_alike(spark, sf):
    """The SQL aggregate and the plan for groups of any size agree."""
    from quillrank.operators import aggregates as A
    from quillrank.queries.registry import impressions

    shown = impressions(spark, sf).where("label in (0, 1)").selectExpr("user_id % 3 AS part", "label", "score", "1 / propensity AS weight")
    plan = {r["part"]: r["auc"] for r in A.weighted_auc(shown, "label", "score", "weight", ["part"]).collect()}
    assert {r["part"]: pytest.approx(r["auc"], abs=1e-6) for r in rows_of(spark, sf, "sql_weighted_auc")} == plan
