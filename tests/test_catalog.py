"""Rules on records, greedy rounds, study plans: expected values by hand or by a plain version."""

import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.functions import catalog as K
from quillrank.operators import ledgers as L
from quillrank.operators.joins import greedy_rounds
from quillrank.plans import gates as G
from quillrank.plans import studies as S


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_covers(spark):
    urls = ["https://books.google.com/a#x", "https://a.mzstatic.com/b", "https://evilmzstatic.com/b", "http://books.google.com/a", "https://u:p@books.google.com/a", "https://shop.example/c", "not a url", "", None, "https://covers.openlibrary.org/b/ISBN/1-L.jpg"]
    got = one(spark, [(u,) for u in urls], "u string", K.safe_cover(F.col("u"), F.lit("https://shop.example")), K.weak_cover(F.col("u")))
    assert [a for a, _ in got] == ["https://books.google.com/a", "https://a.mzstatic.com/b", "", "", "", "https://shop.example/c", "", "", "", urls[-1]]
    assert [b for _, b in got] == [False] * 9 + [True]


def test_store_links(spark):
    links = ["https://www.amazon.com/gp/product/0306406152/ref", "https://amazon.de/x?asin=0306406152", "https://notamazon.com/dp/0306406152", "https://amazon.com/dp/0306406153", "https://amazon.com/%zz/dp/9780306406157", None]
    assert [x for (x,) in one(spark, [(u,) for u in links], "u string", K.store_isbn(F.col("u")))] == ["9780306406157", "9780306406157", None, None, "9780306406157", None]


def test_event_and_outcome_labels(spark):
    rows = [("save", None), ("reject", None), ("import", None), ("maybe_later", None), ("read", 5.0), ("read", 4.0), ("read", 3.0), ("read", 2.0), ("read", 1.0), ("read", None), ("read", float("nan")), ("read", float("inf")), (None, 5.0)]
    got = [tuple(x) for (x,) in one(spark, rows, "k string, v double", K.event_label(F.col("k"), F.col("v")))]
    assert got == [(1.0, 1.0), (0.0, 1.0), (1.0, 0.7), (None, 0.0), (1.0, 1.0), (1.0, 0.85), (None, 0.0), (0.0, 0.85), (0.0, 1.0), (None, 0.0), (None, 0.0), (None, 0.0), (None, 0.0)]
    got = [tuple(x) for (x,) in one(spark, [(None,), (5.0,), (3.0,), (2.0,)], "v double", K.outcome_label(F.col("v")))]
    assert got == [(0.75, "completed_unrated", 0.4), (1.0, "rating_positive", 1.0), (0.5, "rating_neutral", 0.25), (0.0, "rating_negative", 1.0)]


def test_book_features(spark):
    rows = [("J. R. Hartley Jr.", ["Fiction", "Fly fishing", "Rivers", "Trout", "Bait", "Weirs"], "1950-01"), ("", None, "2010"), (None, [], None)]
    got = [x for (x,) in one(spark, rows, "a string, g array<string>, y string", K.book_features(F.col("a"), F.col("g"), F.col("y")))]
    assert got == [["author:jr hartley", "era:pre_1950", "subject:bait", "subject:fly fishing", "subject:rivers", "subject:trout"], [], []]


def test_served_rounds_as_binary_values_do(spark):
    values = [k / 100 for k in range(-5, 10105)] + [0.15 + 1e-17, 12.25, 12.75, float("nan")]
    got = [x for (x,) in one(spark, [(v,) for v in values], "v double", K.served(F.col("v")))]
    assert got[:-1] == [round(min(100.0, max(0.0, v)), 1) for v in values[:-1]] and np.isnan(got[-1])


def test_cues(spark):
    phrases = {"cozy": ("cozy", "small town"), "dark": ("dark", "grim")}
    rows = [("A cozy tale.",), ("Not a very dark tale, and grimly so",), ("never a word of it, yet dark",), ("Smalltown",), ("SMALL TOWN; no\nreally grim end",), (None,), ("not dark but dark",)]
    assert [x for (x,) in one(spark, rows, "t string", K.cues(F.col("t"), phrases))] == [["cozy"], [], ["dark"], [], ["cozy"], [], []]


def test_greedy_rounds_equals_the_row_by_row_pass(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(5), [f"k{rng.randrange(90)}" for _ in range(rng.randrange(4))]) for i in range(300)] + [(900, 0, None)]
    seen, stay = set(), []
    for i, _, ks in sorted(rows, key=lambda r: (r[1], r[0])):
        if not seen & set(ks or []):
            seen |= set(ks or [])
            stay.append(i)
    df = spark.createDataFrame(rows, "id long, place int, keys array<string>")
    assert sorted(r.id for r in greedy_rounds(df, "id", [F.col("place")]).collect()) == sorted(stay)
    assert greedy_rounds(df.limit(0), "id", [F.col("place")]).count() == 0


def test_overlaps_and_digest(spark):
    items = spark.createDataFrame([(1, ["a"], True, 0.9, "", "", 1.0), (2, ["b", "c"], True, 0.9, "d", "", 1.0), (3, ["c"], True, 0.9, "", "", 5.0), (4, ["c"], False, 1.0, "d", "", 5.0), (5, ["s"], True, 0.1, "", "", 0.0)], "id long, keys array<string>, accepted boolean, quality double, description string, cover string, score double")
    keyed = lambda *k: spark.createDataFrame([([x],) for x in k], "keys array<string>")
    assert {tuple(r) for r in G.overlap_rejections(items, keyed("a"), keyed("s", "a")).collect()} == {(1, "read_overlap"), (5, "shortlisted_overlap"), (3, "duplicate_identity")}
    stamped = items.select("id", F.lit("recommended").alias("status"), "score", F.lit(datetime(2024, 1, 1)).alias("updated_at"), "keys")
    got = G.digest(stamped, spark.createDataFrame([(4,)], "id long"), keyed("a"), keyed("zz"), 0.5, 5)
    assert [r.id for r in got.collect()] == [3]


def test_eligibility_reasons(spark):
    day = date(2020, 6, 1)
    url = "https://openlibrary.org/works/OL1W"
    rows = [(1, True, "OL1W", None, 1999, url, [], ["k"]), (2, False, "OL1A", None, 1999, url, [], ["k"]), (3, False, "OL1W", date(2020, 6, 2), None, url, [], ["k"]), (4, False, "OL1W", None, 2020, url, [], ["k"]), (5, False, "OL1W", None, None, "http://openlibrary.org/", [], ["k"]), (6, False, "OL1W", None, None, url, ["x"], ["k"]), (7, False, "OL1W", None, None, url, None, ["read"]), (8, False, "OL1W", None, None, url, None, None)]
    works = spark.createDataFrame(rows, "id long, identity_conflict boolean, work string, released date, year int, url string, flags array<string>, keys array<string>")
    got = dict(tuple(r) for r in G.eligibility(works, spark.createDataFrame([(["read"],)], "keys array<string>"), F.lit(day)).collect())
    assert got == {1: "identity_conflict", 2: "unverified_work_id", 3: "published_after_cutoff", 4: "eligible", 5: "untrusted_source", 6: "local_quality_gate", 7: "already_read", 8: "eligible"}


def test_reserved_slot(spark):
    vec = lambda k: [float(i == k) for i in range(12)]
    rows = [(0, i, i + 1, f"a{i}" if i != 7 else "a0", 90.0 - i / 2, vec(i)) for i in range(11)]
    got = {r.id: r.position for r in G.reserved(spark.createDataFrame(rows, "run long, id long, pos long, author string, score double, vec array<double>")).collect()}
    assert got[8] == 8 and got[7] == 9 and got[6] == 7
    few = spark.createDataFrame(rows[:8], "run long, id long, pos long, author string, score double, vec array<double>")
    assert all(r.position == r.pos for r in G.reserved(few).collect())


def test_vectors_round_trip(spark):
    df = spark.createDataFrame([(1, [0.1, -2.5, 3e-40]), (2, []), (3, None)], "id long, vec array<float>")
    back = {r.id: r.vec for r in G.vectors_of(G.packed_vectors(df, "vec"), "packed").collect()}
    assert back == {r.id: r.vec for r in df.collect()}
    assert G.vectors_of(spark.createDataFrame([("AAA=",), ("!",)], "packed string"), "packed").where("vec is not null").count() == 0


def test_outcomes_and_frames(spark):
    s = spark.createDataFrame([(1, 0.5, None), (2, 0.5, "x")], "id long, label double, note string")
    n = spark.createDataFrame([(1, 0.5, None), (2, 1.0, "x"), (3, 0.0, None)], "id long, label double, note string")
    assert {(r.id, r.change, r.label) for r in L.outcome_changes(s, n, ["id"], ["label", "note"]).collect()} == {(1, "unchanged", 0.5), (2, "updated", 1.0), (3, "created", 0.0)}
    f = spark.createDataFrame([("q", 1, '["old"]'), ("q", 2, '["a", "b"]'), ("r", 1, "no json")], "query string, seq int, payload string")
    got = {r.query: r.records for r in L.latest_frame(f).collect()}
    assert got["q"] == ["a", "b"] and not got["r"]


def test_reviewed_ids_keep_first_appearance(spark):
    d = spark.createDataFrame([("w", datetime(2024, 1, 2), '[3, "4", "x", 3]'), ("w", datetime(2024, 1, 1), "[1, 4]"), ("v", datetime(2024, 1, 1), None)], "period string, created_at timestamp, ids string")
    assert [tuple(r) for r in L.reviewed(d).collect()] == [("w", [3, 4, 1])]


def test_metric_direction_equals_components_and_ridge(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 6)) * [3, 1, 1, 0.1, 0.1, 0.1]
    stars = np.clip(np.round(3 + v[:, 0] / 2), 1, 5)
    df = spark.createDataFrame([(x.tolist(), float(r)) for x, r in zip(v, stars, strict=True)], "vec array<double>, rating double")
    d = S.metric_direction(df, "vec", "rating")
    rows = v / np.linalg.norm(v, axis=1, keepdims=True)
    centred = rows - rows.mean(axis=0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:4]
    p = centred @ axes.T
    scale = p.std(axis=0)
    z, y = p / scale, stars - 3
    plain = axes.T @ (np.linalg.solve(z.T @ z + 10 * np.eye(4), z.T @ (y - y.mean())) / scale)
    assert d == pytest.approx(plain / np.linalg.norm(plain), abs=1e-8)
    u = v[0] / np.linalg.norm(v[0])
    want = u + (np.sqrt(2) - 1) * (u @ d) * d
    assert np.array(df.limit(1).select(S.stretched(F.col("vec"), d, 1.0)).first()[0]) == pytest.approx(want / np.linalg.norm(want))
    assert len(S.metric_direction(df.limit(0), "vec", "rating")) == 0


def test_split_faults(spark):
    rows = [(date(2024, 1, 1), "train"), (date(2024, 1, 2), "train"), (date(2024, 1, 2), "later"), (date(2024, 1, 3), "validation"), (date(2024, 1, 4), None)]
    got = S.fold_faults(spark.createDataFrame(rows, "day date, part string"), "day", "part", ("train", "validation", "later")).first()
    assert (got.unknown_rows, got.split_days, got.days_out_of_order) == (1, 1, 1)
