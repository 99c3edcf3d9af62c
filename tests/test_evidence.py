"""The evidence store on odd tables, and versions published half way."""

import hashlib
import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.plans import evidence, ranking, rebuild
from quillrank.sources import versions

A, B = "a" * 64, "b" * 64
VECTOR = "batch string, kind string, entity long, backend string, model string, dimensions int, content binary"


def made(spark, reads, candidates, vectors, header=("x", "y", "z")):
    return evidence.capture(
        spark.createDataFrame([(b, "now") for b in header], "batch string, captured_at string"), spark.createDataFrame(reads, "batch string, read long"),
        spark.createDataFrame(candidates, "batch string, candidate long, score double, identity_hash string, input_hash string"), spark.createDataFrame(vectors, VECTOR),
    )


def status(store):
    return {r["batch"]: (r["status"], r["reason"]) for r in store.batches.collect()}


def problems(store):
    return {r["batch"]: r["problems"] for r in evidence.verify(store).collect()}


@pytest.fixture(scope="module")
def store(spark):
    raw = np.array([0.7, 0.4, 0.2], "<f4").tobytes()
    return made(spark, [("x", 1), ("x", 2), ("y", 2)], [("x", 9, 50.0, A, B), ("y", 9, 61.5, A, B)], [("x", "read", 1, "local", "m", 3, raw), ("y", "read", 2, "local", "m", 3, raw), ("x", "candidate", 9, "local", "m", 3, raw[:8] + b"\0\0\0\0")])


def test_capture_addresses_and_payloads(store):
    assert status(store) == {b: ("complete", "") for b in "xyz"}
    raw = np.array([0.7, 0.4, 0.2], "<f4").tobytes()
    address = hashlib.sha256(b'{"backend":"local","dimensions":3,"model":"m"}\0' + raw).hexdigest()
    assert {r["artifact"]: r["links"] for r in evidence.references(store).collect()}[address] == 2 and store.artifacts.count() == 2
    for r in store.batches.collect():
        assert hashlib.sha256(r["payload"].encode()).hexdigest() == r["payload_sha256"] and len(r["payload"].encode()) == r["payload_bytes"]
        said = json.loads(r["payload"])
        assert list(said) == ["candidates", "reads", "vectors"] and r["payload"] == json.dumps(said, sort_keys=True, separators=(",", ":"))
    assert problems(store) == {b: [] for b in "xyz"}


def test_every_damage_is_named(spark, store):
    assert problems(replace(store, read_links=store.read_links.where("read <> 1")))["x"] == ["read links"]
    twice = replace(store, read_links=store.read_links.unionByName(store.read_links.where("batch = 'y'")))
    assert problems(twice) == {"x": [], "y": ["read links"], "z": []}
    assert problems(replace(store, candidate_links=store.candidate_links.withColumn("score", F.lit(1.0))))["y"] == ["candidate links"]
    assert problems(replace(store, artifacts=store.artifacts.limit(0))) == {"x": ["artifact missing"], "y": ["artifact missing"], "z": []}
    assert problems(replace(store, artifacts=store.artifacts.withColumn("content", F.lit(b"else"))))["y"] == ["artifact checksum"]
    changed = replace(store, batches=store.batches.withColumn("payload", F.regexp_replace("payload", "61.5", "61.6")))
    assert problems(changed) == {"x": [], "y": ["candidate links", "payload checksum"], "z": []}
    assert "payload size" in problems(replace(store, batches=store.batches.withColumn("payload_bytes", F.lit(3).cast("long"))))["z"]
    broken = replace(store, batches=store.batches.withColumn("payload", F.lit("{")))
    assert {"payload checksum", "read count", "read links"} <= set(problems(broken)["x"])
    added = store.vector_links.where("batch = 'x'").withColumn("batch", F.lit("z"))
    assert problems(replace(store, vector_links=store.vector_links.unionByName(added)))["z"] == ["vector links"]


@pytest.mark.parametrize(
    ("reads", "candidates", "vectors", "reason"),
    [
        ([("x", None)], [], [], "invalid_read_manifest"), ([("x", 1), ("x", 1)], [], [], "invalid_read_manifest"), ([("x", 0)], [], [], "invalid_read_manifest"),
        ([], [("x", 1, None, A, B)], [], "invalid_candidate_manifest"), ([], [("x", 1, float("nan"), A, B)], [], "invalid_candidate_manifest"), ([], [("x", 1, float("inf"), A, B)], [], "invalid_candidate_manifest"),
        ([], [("x", 1, 1.0, "A" * 64, B)], [], "invalid_candidate_manifest"), ([], [("x", 1, 1.0, A, None)], [], "invalid_candidate_manifest"), ([], [("x", 1, 1.0, A, B), ("x", 1, 2.0, A, B)], [], "invalid_candidate_manifest"),
        ([], [], [("x", "book", 1, "l", "m", 1, b"abcd")], "invalid_vector_artifact"), ([], [], [("x", "read", 1, "l", "m", 1, None)], "invalid_vector_artifact"), ([], [], [("x", "read", 1, "l", "m", 9000, b"abcd")], "invalid_vector_artifact"),
        ([], [], [("x", "read", 1, "l", "m", 1, b"abcd"), ("x", "read", 1, "l", "m", 1, b"abce")], "invalid_vector_artifact"), ([("x", k) for k in range(1, 10_002)], [], [], "read_limit_exceeded"),
    ],
)
def test_invalid_batches_are_markers(spark, reads, candidates, vectors, reason):
    s = made(spark, [*reads, ("y", 5)], candidates, vectors)
    assert status(s) == {"x": ("incomplete", reason), "y": ("complete", ""), "z": ("complete", "")}
    assert s.read_links.collect() == [("y", 5)] and not s.candidate_links.collect() and not s.artifacts.collect()
    assert problems(s) == {"x": [], "y": [], "z": []}


def test_union_keeps_an_artifact_once(spark, store):
    raw = np.array([0.7, 0.4, 0.2], "<f4").tobytes()
    both = store.union(made(spark, [("w", 1)], [], [("w", "read", 1, "local", "m", 3, raw), ("w", "read", 2, "local", "other", 3, raw)], ["w"]))
    assert both.artifacts.count() == 3 and problems(both) == {b: [] for b in "wxyz"}


def test_purge_by_reads_runs_and_batches(spark, store):
    raw = np.array([0.7, 0.4, 0.2], "<f4").tobytes()
    runs = spark.createDataFrame([("r1", "x"), ("r2", "y"), ("r2", "z"), ("r3", "z")], "run string, batch string")
    own = spark.createDataFrame([("r2", "read", 2, "local", "m", 3, raw), ("r3", "read", 7, "local", "m", 1, b"only")], VECTOR.replace("batch", "run"))
    s = evidence.served(store, runs, own)
    assert s.artifacts.count() == 3
    kept = lambda t: {f: sorted(r[0] for r in getattr(t, f).collect()) for f in ("batches", "run_links", "read_links")} | {"artifacts": t.artifacts.count()}
    some = lambda **k: spark.createDataFrame([(v,) for v in next(iter(k.values()))], f"{next(iter(k))} {'long' if 'read' in k else 'string'}")
    # Read 1 was seen by x alone, whose own artifact goes; the shared one is still linked.
    assert kept(evidence.purge(s, reads=some(read=[1]))) == {"batches": ["y", "z"], "run_links": ["r2", "r2", "r3"], "read_links": ["y"], "artifacts": 2}
    # Read 2 was seen by both; the run that was served from one of them goes whole.
    assert kept(evidence.purge(s, reads=some(read=[2]))) == {"batches": ["z"], "run_links": ["r3"], "read_links": [], "artifacts": 1}
    assert kept(evidence.purge(s, runs=some(run=["r2"]))) == {"batches": ["x", "y", "z"], "run_links": ["r1", "r3"], "read_links": ["x", "x", "y"], "artifacts": 3}
    assert kept(evidence.purge(s, batches=some(batch=["x", "y", "z"]))) == {"batches": [], "run_links": [], "read_links": [], "artifacts": 0}
    assert evidence.used_bytes(evidence.purge(s, batches=some(batch=["x", "y", "z"]))).first()[0] == 0 < evidence.used_bytes(s).first()[0]


def test_float_bytes_are_exact(spark):
    df = spark.createDataFrame([([0.1, -2.5],), (None,)], "v array<float>").select(evidence.float_bytes("v").alias("b"))
    assert [None if r["b"] is None else bytes(r["b"]) for r in df.collect()] == [np.array([0.1, -2.5], "<f4").tobytes(), None]


# Versions.


def test_versions_swap_whole(spark, tmp_path):
    root = f"file://{tmp_path}/pub"
    assert versions.current(spark, root) is None
    ids = lambda n: spark.range(n)
    one = versions.publish(spark, root, {"vectors": ids(3), "scores": ids(2)}, {"model": "m1"})
    assert one.number == 1 and versions.current(spark, root) == one and one.rows == {"vectors": 3, "scores": 2}
    pinned = versions.current(spark, root).table(spark, "vectors")
    two = versions.publish(spark, root, {"vectors": one.table(spark, "vectors").union(ids(4)), "scores": ids(0)}, {"model": "m2"})
    assert two.rows == {"vectors": 7, "scores": 0} and versions.current(spark, root).note == {"model": "m2"}
    assert pinned.count() == 3 and versions.current(spark, root, 1) == one
    versions.publish(spark, root, {"vectors": ids(1)})
    assert versions.current(spark, root, 1) is None and versions.current(spark, root, 2) == two
    with pytest.raises(KeyError):
        versions.current(spark, root).table(spark, "scores")
    with pytest.raises(ValueError, match="needs a table"):
        versions.publish(spark, root, {})


def test_a_run_that_dies_half_way_changes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/pub"
    one = versions.publish(spark, root, {"vectors": spark.range(3), "scores": spark.range(3)})
    dies = spark.range(5).select(F.when(F.col("id") < 4, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).alias("id"))
    with pytest.raises(Exception, match="lost"):
        versions.publish(spark, root, {"vectors": spark.range(9), "scores": dies})
    assert versions.current(spark, root) == one and one.table(spark, "vectors").count() == 3
    left = [p.name for p in (tmp_path / "pub").iterdir() if p.name.startswith("v2-")]
    assert left and (tmp_path / "pub" / left[0] / "vectors").exists()
    two = versions.publish(spark, root, {"vectors": spark.range(9), "scores": spark.range(9)})
    assert two.number == 2 and versions.current(spark, root).rows == {"vectors": 9, "scores": 9}
    assert not (tmp_path / "pub" / left[0]).exists()


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/pub"
    versions.publish(spark, root, {"t": spark.range(1)})
    seen = versions._numbers

    def late(files):
        monkeypatch.setattr(versions, "_numbers", seen)
        before = seen(files)
        versions.publish(spark, root, {"t": spark.range(22)})
        return before

    monkeypatch.setattr(versions, "_numbers", late)
    with pytest.raises(RuntimeError, match="meanwhile"):
        versions.publish(spark, root, {"t": spark.range(33)})
    assert versions.current(spark, root).rows == {"t": 22} and len([p for p in (tmp_path / "pub").iterdir() if p.name.startswith("v")]) == 2


def test_rebuild_is_whole_or_not(spark, tmp_path):
    root = f"file://{tmp_path}/pub"
    reads = spark.createDataFrame([(1, "aab", "r1", "x", 5.0), (2, "zz", "r2", "y", 1.0)], "id long, text string, identity string, author string, rating double")
    wanted = spark.createDataFrame([(7, "ab", "c7", "x"), (8, "zy", "c8", None)], "id long, text string, identity string, author string")
    letters = lambda items: items.select("id", F.transform(F.array(*[F.lit(c) for c in "abyz"]), lambda c: (F.length("text") - F.length(F.replace("text", c, F.lit("")))).cast("double")).alias("vec"))
    one = rebuild.rebuild(root, reads, wanted, letters, ranking.baseline, "m1")
    scores = {r["id"]: r["score"] for r in one.table(spark, "scores").collect()}
    assert scores[7] > 90 > scores[8] and one.rows == {"read_vectors": 2, "candidate_vectors": 2, "scores": 2} and one.note == {"model": "m1", "dimensions": 4}
    for bad in (lambda i: letters(i).where("id <> 8"), lambda i: letters(i).withColumn("vec", F.array(F.lit(float("nan")))), lambda i: letters(i).union(letters(i)), lambda i: letters(i).withColumn("vec", F.slice("vec", 1, F.when(F.col("id") == 7, 2).otherwise(3)))):
        with pytest.raises(ValueError, match="one finite vector"):
            rebuild.rebuild(root, reads, wanted, bad, ranking.baseline, "m2")
    assert versions.current(spark, root) == one
