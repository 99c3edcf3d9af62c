"""What queries hold on the driver and how their work grows."""

import datetime as dt
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.operators import joins as J
from quillrank.plans import graph, ranking, replay
from quillrank.queries import QUERIES
from quillrank.queries.registry import rounded
from quillrank.streaming import events as S


def test_stream_rows_are_written_by_tasks(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("k1", t0), ("k1", t0), ("k2", t0)], "event_key string, ts timestamp").write.parquet(str(tmp_path / "in"))
    out = S.run_to_end(S.once(S.stream(spark, str(tmp_path / "in"), "event_key string, ts timestamp")), "written", str(tmp_path / "c"))
    assert out.inputFiles() and out.count() == 2


def test_one_key_of_very_many_targets(spark):
    """40,000 items and as many targets of one key: a table of pairs would have 1.6 billion rows."""
    n = 40_000
    items = spark.range(n).selectExpr("id", "'k' AS key").union(spark.sql("SELECT -1L, 'own'"))
    targets = spark.range(n).selectExpr("id AS target", "'k' AS key", "2 AS method").union(spark.sql("SELECT 7L, 'own', 1 UNION ALL SELECT 7L, 'own', 2"))
    began = time.monotonic()
    assert [tuple(r) for r in J.unambiguous(items, targets, "id", "target", "key", "method").collect()] == [(-1, 7, 1)]
    assert time.monotonic() - began < 60


def test_edges_are_walked_once_for_two_steps(spark):
    """Even and odd numbers of steps give what plain steps give, and the edges are laid out once for each way."""
    arcs = [(1, 10), (2, 10), (2, 11), (3, 11), (3, 12), (4, 12), (1, 12)]
    edges, seeds = spark.createDataFrame(arcs, "work long, entity long"), spark.createDataFrame([(1,), (4,)], "work long")
    both = [(("w", w), ("e", e)) for w, e in arcs]
    both += [(b, a) for a, b in both]
    degree = Counter(a for a, _ in both)
    start = {("w", 1): 0.5, ("w", 4): 0.5}
    for steps in (1, 2, 7, 8, 32):
        rank = start
        for _ in range(steps):
            new = Counter({k: 0.4 * r for k, r in start.items()})
            for a, b in both:
                new[b] += 0.6 * rank.get(a, 0.0) / degree[a]
            rank = new
        got = {r["work"]: r["rank"] for r in graph.diffusion(edges, seeds, steps=steps).collect()}
        assert got == pytest.approx({w: r for (kind, w), r in rank.items() if kind == "w" and w not in (1, 4) and r > 0}, abs=1e-9)


def test_copies_of_a_vector_are_compared_once(spark, monkeypatch):
    """With blocks of two vectors too, every candidate gets the score of all pairs."""
    rng = np.random.default_rng(5)
    kinds = np.vstack([rng.normal(size=(6, 4)), np.zeros((1, 4))])
    row = lambda i, k: (i, f"a{i % 11}", float(1 + i % 5), kinds[k].tolist())
    reads, asked = [row(i, i % 5) for i in range(400)], [row(1000 + i, i % 7) for i in range(300)]
    cos = lambda a, b: float(np.dot(a, b) / ((np.linalg.norm(a) * np.linalg.norm(b)) or 1))
    want = {}
    for i, author, _, v in asked:
        up, down = (max(cos(v, w) for *_, r, w in reads if (r >= 4 if liked else r <= 2)) for liked in (True, False))
        want[i] = round(min(100, max(0, 42 + 48 * up - 24 * down + 7 * any(a == author and r >= 4 for _, a, r, _ in reads))), 6)
    sizes, real = [], ranking.nearest_kinds
    monkeypatch.setattr(ranking, "nearest_kinds", lambda h, a, block_rows=2: sizes.append((h.count(), a.count())) or real(h, a, block_rows))
    make = lambda rows: spark.createDataFrame(rows, "id long, author string, rating double, vec array<double>").withColumn("identity", F.col("id").cast("string"))
    got = {r["id"]: r["score"] for r in ranking.baseline(make(reads), make(asked)).collect()}
    assert got == pytest.approx(want, abs=2e-6) and sizes == [(4, 7)]  # reads rated 3 count for nothing


def test_variants_share_their_neighbours(spark, sf, monkeypatch):
    passes, real = [], ranking._with_block_terms
    monkeypatch.setattr(ranking, "_with_block_terms", lambda *a: passes.append(a[3:]) or real(*a))
    out = QUERIES["formula_variants"](spark, sf)
    assert len(out.columns) == 3 and len(passes) == 2  # plain and centred cosines


def test_variants_of_a_long_history_take_one_search(spark, sf, monkeypatch):
    """Blocks of 60 reads, rounds of 130: no pair leaves a task, and the scores are those of one block."""
    rows = lambda: {(r["id"], r["arm"]): r["raw_score"] for r in QUERIES["formula_variants"](spark, sf).collect()}
    one, searches, real = rows(), [], ranking.long_terms
    monkeypatch.setattr(ranking, "near_reads", lambda *a, **k: pytest.fail("neighbours left their tasks"))
    monkeypatch.setattr(ranking, "long_terms", lambda *a: searches.append(a[2]) or real(*a), raising=False)
    monkeypatch.setattr(ranking, "BLOCK_ROWS", 60)
    monkeypatch.setattr(ranking, "ROUND_ROWS", 130, raising=False)
    assert rows() == pytest.approx(one, abs=2e-6) and len(one) == 1500
    assert searches == [[(5, False), (1, True)]]


def test_copies_in_a_long_history_stand_in_order_of_id(spark, monkeypatch):
    """300 reads of five vectors and no vector, with ratings and days that tell which of the copies were taken."""
    rng = np.random.default_rng(3)
    kinds = [*rng.normal(size=(5, 3)).tolist(), None]
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i * 7 % 900)
    reads = [(i, f"r{i}", f"a{i % 9}", float(1 + i * i % 5), day(i), kinds[int(rng.integers(5))]) for i in range(300)]
    asked = [(1000 + i, f"c{i}", f"a{i % 9}", kinds[i % 6] if i % 4 else rng.normal(size=3).tolist(), 1.0, 0.9) for i in range(80)]
    history = spark.createDataFrame([*reads, (999, "none", "a1", 5.0, day(1), None)], "id long, identity string, author string, rating double, day date, vec array<double>")
    wanted = spark.createDataFrame(asked, "id long, identity string, author string, vec array<double>, source_weight double, confidence double")
    monkeypatch.setattr(ranking, "BLOCK_ROWS", 50)
    got = {r["id"]: [r[f"{t}_{k}"] for k in range(2) for t in ranking.TERMS] for r in ranking.long_terms(history, wanted, [(3, False), (1, True)]).collect()}
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    known = np.array([unit(v) for *_, v in reads])
    ratings, days = np.array([r[3] for r in reads]), np.array([(r[4] - dt.date(1970, 1, 1)).days for r in reads], float)
    assert len(got) == 80
    for i, *_, vec, _, _ in asked:
        if vec is None:
            assert got[i] == [None] * 18
            continue
        sims = np.round(unit(vec) @ known.T, 12)[None]
        want = ranking.block_terms(sims, ratings, days, 3) + ranking.block_terms(ranking.centred_on(sims, sims.mean(axis=1)), ratings, days, 1)
        assert got[i] == pytest.approx([float(x[0]) for x in want], abs=1e-9)


@pytest.mark.parametrize(("pending", "ties", "levels", "zeros"), [(400, 1, 0, 0), (1 << 19, 128, 0, 0), (500, 128, 3, 5), (1 << 19, 1, 2, 3), (3000, 60, 2, 0)])
def test_search_equals_all_pairs(monkeypatch, pending, ties, levels, zeros):
    """Random and coarse vectors (many ties between different ones, centred cosines held at 0 and 1), few products held."""
    monkeypatch.setattr(ranking, "TILE_READS", 64)
    monkeypatch.setattr(ranking, "TILE_ASKED", 8)
    monkeypatch.setattr(ranking._Near, "PENDING", pending)
    monkeypatch.setattr(ranking._Near, "TIES", ties)
    rng = np.random.default_rng(levels + zeros)
    vectors = rng.integers(-levels, levels + 1, size=(740, 3)).astype(float) if levels else rng.normal(size=(740, 3))
    if levels:
        vectors[np.abs(vectors).sum(axis=1) == 0] = 1.0
        vectors /= np.array([1.0, 2.0, 4.0])[rng.integers(3, size=740), None]
    vectors[rng.integers(740, size=zeros)] = 0.0
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
    asked, known = vectors[:40], vectors[40:]
    ids, ratings, days = np.arange(700), rng.integers(1, 6, 700).astype(float), rng.integers(900, size=700).astype(float)
    near = ranking._Near(asked, 4, known.mean(axis=0))
    for a, b in ((0, 300), (300, 700)):
        order = np.lexsort((ranking._kinds(ratings[a:b]), np.arange(b - a) // 64)) + a
        block = (ids[order], ratings[order], days[order], np.ascontiguousarray(known[order]))
        for n, at in enumerate(range(0, b - a, 64)):
            near.meet(block, at)
            if n % 3 == 0:
                near.settle(block, n % 2 == 0)
        near.settle(block)
    sims = np.array([np.einsum("ij,ij->i", np.repeat(v[None], 700, 0), known) for v in asked])
    for disliked, centred in ((4, False), (1, True), (1, False)):
        want = ranking.block_terms(ranking.centred_on(sims, near.mean) if centred else sims, ratings, days, disliked)
        for name, x, y in zip(ranking.TERMS, near.terms(disliked, centred), want, strict=True):
            assert np.allclose(x, y, atol=1e-9, equal_nan=True), (name, disliked, centred)


def test_copies_of_sparse_vectors_are_thinned_exactly(spark, monkeypatch):
    """Twelve texts, 900 reads: the same scores and features, bit by bit of the six digits, as when all reads meet."""
    rng = np.random.default_rng(8)
    texts = [sorted(rng.choice(30, 4, replace=False).tolist()) for _ in range(12)]
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=int(rng.integers(9)))
    rows = [(i, f"i{i}", f"a{i % 7}", float(1 + int(rng.integers(5))), day(i), texts[int(rng.integers(12))], [0.5] * 4) for i in rng.permutation(900).tolist()]
    reads = spark.createDataFrame(rows, "id long, identity string, author string, rating double, day date, terms array<long>, weights array<double>")
    needed, asked = replay.without_copies(reads)
    assert needed.count() < 800 and asked.count() == 900
    got = {r["id"]: r for r in rounded(replay.replay(reads)).collect()}
    monkeypatch.setattr(replay, "without_copies", lambda rows: (rows, rows.select("id", F.col("id").alias("asked"))))
    assert got == {r["id"]: r for r in rounded(replay.replay(reads)).collect()}
