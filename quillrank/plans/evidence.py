"""Evidence of scoring: what went into a batch, content-addressed, verified by its own checksums, purged by reference.

A store is a few tables. A batch's payload is the canonical JSON of its manifest (keys in
order, entries in order of their ids) with a SHA-256; what is large (vectors) is an
artifact, addressed by the digest of its spec and content and kept once however many
batches and runs link to it. Links are tables of their own, and verification holds them
against the manifest by full outer joins, so neither a lost nor an added link goes
unseen. A batch that breaks a rule or a limit is kept as a marker with its reason and
without payload or links. Limits bound a manifest, so that it is one row of a task; a
batch over them is told by counts, before any list is made.

Null ids, scores that are no numbers and digests that aren't 64 hex digits are invalid;
repeated ids of a batch are too. Batches without rows have empty manifests.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.session import cut

#: Reads, candidates, vectors, dimensions and payload bytes of one batch at most.
MAX_READS, MAX_CANDIDATES, MAX_VECTORS, MAX_DIMENSIONS, MAX_PAYLOAD = 10_000, 5_000, 15_000, 8_192, 16 << 20
_HEX = "^[0-9a-f]{64}$"
_MANIFEST = "struct<candidates:array<struct<candidate_id:bigint,score:double>>,reads:array<bigint>,vectors:array<struct<artifact:string,content_sha256:string,entity:bigint,kind:string>>>"


@dataclass(frozen=True)
class Store:
    """batches, artifacts, the links of batches, and the runs that were served from batches with their links."""

    batches: DataFrame  # batch, captured_at, status, reason, payload, payload_sha256, payload_bytes, read_count, candidate_count, vector_count
    artifacts: DataFrame  # artifact, backend, model, dimensions, content
    vector_links: DataFrame  # batch, kind, entity, artifact
    candidate_links: DataFrame  # batch, candidate, score, identity_hash, input_hash
    read_links: DataFrame  # batch, read
    run_links: DataFrame  # run, batch
    run_vectors: DataFrame  # run, kind, entity, artifact

    def union(self, new: Store) -> Store:
        """Both, an artifact of one address once. ``new`` has batches and runs of its own."""
        known = self.artifacts.unionByName(new.artifacts.join(self.artifacts.select("artifact"), "artifact", "left_anti"))
        return Store(**{f.name: known if f.name == "artifacts" else getattr(self, f.name).unionByName(getattr(new, f.name)) for f in fields(Store)})


def address(backend: Column, model: Column, dimensions: Column, content: Column) -> Column:
    """The digest that a content is kept under: that of its spec, a zero byte and itself."""
    spec = F.to_json(F.struct(backend.alias("backend"), dimensions.alias("dimensions"), model.alias("model")))
    return F.sha2(F.concat(spec.cast("binary"), F.lit(b"\0"), content.cast("binary")), 256)


@F.pandas_udf(T.BinaryType())
def float_bytes(vec):
    """A vector as 32-bit floats, little-endian: the exact content of an artifact."""
    import numpy as np

    return vec.map(lambda v: np.asarray(v, "<f4").tobytes(), na_action="ignore")


def _counted(rows: DataFrame, wrong: Column, key: list[str], name: str) -> DataFrame:
    """n_``name`` rows, and bad_``name`` of them that are wrong or repeat the key, per batch."""
    per_key = rows.groupBy("batch", *key).agg(F.count(F.lit(1)).alias("_n"), F.count_if(wrong).alias("_w"))
    return per_key.groupBy("batch").agg(F.sum("_n").alias(f"n_{name}"), F.sum(F.greatest(F.col("_w"), F.col("_n") - 1)).alias(f"bad_{name}"))


def capture(header: DataFrame, reads: DataFrame, candidates: DataFrame, vectors: DataFrame) -> Store:
    """A store of new batches.

    header: batch, captured_at; reads: batch, read; candidates: batch, candidate, score,
    identity_hash, input_hash; vectors: batch, kind, entity, backend, model, dimensions, content.
    """
    vectors = vectors.withColumn("artifact", address(F.col("backend"), F.col("model"), F.col("dimensions"), F.col("content")))
    vectors = cut(vectors.withColumn("content_sha256", F.sha2(F.col("content").cast("binary"), 256)))
    positive = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    hexed = lambda c: F.coalesce(F.col(c).rlike(_HEX), F.lit(False))
    score = F.coalesce(F.abs("score") < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce("score", F.lit(0.0)))
    vector = positive("entity") & F.coalesce(F.col("kind").isin("read", "candidate"), F.lit(False)) & F.col("content").isNotNull() & (F.length("content") > 0) & F.coalesce(F.col("dimensions").between(1, MAX_DIMENSIONS), F.lit(False))
    counts = (
        header.join(_counted(reads, ~positive("read"), ["read"], "reads"), "batch", "left")
        .join(_counted(candidates, ~(positive("candidate") & score & hexed("identity_hash") & hexed("input_hash")), ["candidate"], "candidates"), "batch", "left")
        .join(_counted(vectors, ~vector, ["kind", "entity"], "vectors"), "batch", "left")
        .na.fill(0, [f"{k}_{n}" for k in ("n", "bad") for n in ("reads", "candidates", "vectors")])
    )
    rules = (
        (F.col("n_reads") > MAX_READS, "read_limit_exceeded"), (F.col("n_candidates") > MAX_CANDIDATES, "candidate_limit_exceeded"), (F.col("n_vectors") > MAX_VECTORS, "vector_limit_exceeded"),
        (F.col("bad_vectors") > 0, "invalid_vector_artifact"), (F.col("bad_candidates") > 0, "invalid_candidate_manifest"), (F.col("bad_reads") > 0, "invalid_read_manifest"),
    )
    counts = cut(counts.withColumn("reason", F.coalesce(*[F.when(broken, F.lit(why)) for broken, why in rules], F.lit(""))))
    good = counts.where("reason = ''").select("batch")
    kept = [d.join(good, "batch") for d in (reads, candidates, vectors)]
    lists = (
        kept[0].groupBy("batch").agg(F.sort_array(F.collect_list("read")).alias("reads")),
        kept[1].groupBy("batch").agg(F.sort_array(F.collect_list(F.struct(F.col("candidate").alias("candidate_id"), F.col("score").cast("double").alias("score")))).alias("candidates")),
        kept[2].groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("artifact", "content_sha256", "entity", "kind"))).alias("vectors")),
    )
    whole = reduce(lambda a, b: a.join(b, "batch", "left"), lists, good)
    empty = {"candidates": "array<struct<candidate_id:bigint,score:double>>", "reads": "array<bigint>", "vectors": "array<struct<artifact:string,content_sha256:string,entity:bigint,kind:string>>"}
    payload = F.to_json(F.struct(*[F.coalesce(F.col(c), F.array().cast(t)).alias(c) for c, t in empty.items()]))
    whole = whole.select("batch", payload.alias("payload"))
    batches = counts.join(whole, "batch", "left").withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    large = F.col("payload_bytes") > MAX_PAYLOAD
    reason = F.when(large, "storage_quota_exceeded").otherwise(F.col("reason"))
    complete = reason == ""
    batches = cut(batches.select(
        "batch", "captured_at", F.when(complete, "complete").otherwise("incomplete").alias("status"), reason.alias("reason"), *[F.when(complete, c).alias(n) for n, c in (("payload", F.col("payload")), ("payload_sha256", F.sha2("payload", 256)), ("payload_bytes", F.col("payload_bytes")))],
        F.col("n_reads").alias("read_count"), F.col("n_candidates").alias("candidate_count"), F.col("n_vectors").alias("vector_count"),
    ))
    done = batches.where("status = 'complete'").select("batch")
    reads, candidates, vectors = (d.join(done, "batch", "left_semi") for d in (reads, candidates, vectors))
    artifacts = vectors.groupBy("artifact").agg(*[F.first(c).alias(c) for c in ("backend", "model", "dimensions", "content")])  # all the same, by the address
    nobody = batches.sparkSession.createDataFrame([], f"run string, batch {dict(header.dtypes)['batch']}")
    return Store(
        batches, artifacts, vectors.select("batch", "kind", "entity", "artifact"), candidates.select("batch", "candidate", F.col("score").cast("double").alias("score"), "identity_hash", "input_hash"), reads.select("batch", "read"),
        nobody, vectors.select(F.lit(None).cast("string").alias("run"), "kind", "entity", "artifact").limit(0),
    )


def served(store: Store, runs: DataFrame, vectors: DataFrame) -> Store:
    """``store`` with the runs (run, batch) served from its batches and their own vectors (run, kind, entity, backend, model, dimensions, content)."""
    vectors = vectors.withColumn("artifact", address(F.col("backend"), F.col("model"), F.col("dimensions"), F.col("content")))
    new = vectors.groupBy("artifact").agg(*[F.first(c).alias(c) for c in ("backend", "model", "dimensions", "content")])
    return replace(
        store, run_links=store.run_links.unionByName(runs.select("run", "batch").distinct()), run_vectors=store.run_vectors.unionByName(vectors.select("run", "kind", "entity", "artifact")),
        artifacts=store.artifacts.unionByName(new.join(store.artifacts.select("artifact"), "artifact", "left_anti")),
    )


def _unmatched(expected: DataFrame, actual: DataFrame, keys: list[str], problem: str) -> DataFrame:
    """(batch, problem) of batches in which one side has a row that the other lacks, or has it another number of times."""
    count = lambda d, n: d.groupBy("batch", *keys).agg(F.count(F.lit(1)).alias(n))
    both = count(expected, "_e").join(count(actual, "_a"), ["batch", *keys], "full_outer")
    return both.where(~F.col("_e").eqNullSafe(F.col("_a"))).select("batch", F.lit(problem).alias("problem"))


def verify(store: Store) -> DataFrame:
    """(batch, status, problems): every complete batch held against its checksums, counts, links and artifacts; problems in order of their names."""
    complete = store.batches.where("status = 'complete'")
    parsed = cut(complete.withColumn("_m", F.from_json("payload", _MANIFEST)))
    own = F.coalesce(F.sha2("payload", 256) == F.col("payload_sha256"), F.lit(False))
    size = F.coalesce(F.octet_length("payload") == F.col("payload_bytes"), F.lit(False))
    counted = [F.coalesce(F.size(f"_m.{c}"), F.lit(0)) == F.col(n) for c, n in (("reads", "read_count"), ("candidates", "candidate_count"), ("vectors", "vector_count"))]
    alone = [(~own, "payload checksum"), (~size, "payload size"), *[(~F.coalesce(ok, F.lit(False)), f"{n} count") for ok, n in zip(counted, ("read", "candidate", "vector"), strict=True)]]
    found = [parsed.where(wrong).select("batch", F.lit(name).alias("problem")) for wrong, name in alone]
    listed = parsed.select("batch", F.explode("_m.vectors").alias("v")).select("batch", "v.*")
    shown = parsed.select("batch", F.explode("_m.candidates").alias("c")).select("batch", F.col("c.candidate_id").alias("candidate"), "c.score")
    read = parsed.select("batch", F.explode("_m.reads").alias("read"))
    mine = lambda links: links.join(complete.select("batch"), "batch", "left_semi")
    found.append(_unmatched(read, mine(store.read_links), ["read"], "read links"))
    found.append(_unmatched(shown, mine(store.candidate_links).select("batch", "candidate", "score"), ["candidate", "score"], "candidate links"))
    found.append(_unmatched(listed.select("batch", "kind", "entity", "artifact"), mine(store.vector_links), ["kind", "entity", "artifact"], "vector links"))
    true_address = address(F.col("backend"), F.col("model"), F.col("dimensions"), F.col("content"))
    kept = store.artifacts.select("artifact", (true_address == F.col("artifact")).alias("_sound"), F.sha2(F.col("content").cast("binary"), 256).alias("_sha"))
    met = listed.join(kept, "artifact", "left")
    found.append(met.where("_sound is null").select("batch", F.lit("artifact missing").alias("problem")))
    found.append(met.where(~(F.col("_sound") & (F.col("_sha") == F.col("content_sha256")))).select("batch", F.lit("artifact checksum").alias("problem")))
    problems = reduce(DataFrame.unionByName, found).groupBy("batch").agg(F.sort_array(F.collect_set("problem")).alias("problems"))
    return store.batches.select("batch", "status").join(problems, "batch", "left").withColumn("problems", F.coalesce("problems", F.array().cast("array<string>")))


def references(store: Store) -> DataFrame:
    """(artifact, links): how many batches' and runs' links an artifact has, 0 included."""
    links = store.vector_links.select("artifact").unionByName(store.run_vectors.select("artifact")).groupBy("artifact").agg(F.count(F.lit(1)).alias("links"))
    return store.artifacts.select("artifact").join(links, "artifact", "left").na.fill(0, ["links"])


def purge(store: Store, reads: DataFrame | None = None, runs: DataFrame | None = None, batches: DataFrame | None = None) -> Store:
    """``store`` without the batches that saw these reads (or are named), the runs that are named or were served from such a batch, and artifacts that nothing links any more.

    reads: read; runs: run; batches: batch. Each may be large.
    """
    gone = store.batches.select("batch").limit(0)
    if reads is not None:
        gone = gone.unionByName(store.read_links.join(reads, "read", "left_semi").select("batch"))
    if batches is not None:
        gone = gone.unionByName(batches.select("batch"))
    gone = cut(gone.distinct())
    lost = store.run_links.join(gone, "batch", "left_semi").select("run")
    lost = cut((lost if runs is None else lost.unionByName(runs.select("run"))).distinct())
    off = lambda d, by, key: d.join(by, key, "left_anti")
    left = replace(
        store, batches=off(store.batches, gone, "batch"), vector_links=off(store.vector_links, gone, "batch"), candidate_links=off(store.candidate_links, gone, "batch"),
        read_links=off(store.read_links, gone, "batch"), run_links=off(store.run_links, lost, "run"), run_vectors=off(store.run_vectors, lost, "run"),
    )
    used = left.vector_links.select("artifact").unionByName(left.run_vectors.select("artifact"))
    return replace(left, artifacts=store.artifacts.join(used, "artifact", "left_semi"))


def used_bytes(store: Store) -> DataFrame:
    """One row: payloads with a header each, artifacts once, and what links take."""
    links = ((store.vector_links, 96), (store.candidate_links, 224), (store.read_links, 64))
    sums = [store.batches.agg(F.sum(192 + F.coalesce("payload_bytes", F.lit(0)))), store.artifacts.agg(F.sum(F.octet_length("content")))]
    sums += [d.agg((F.count(F.lit(1)) * size).cast("long")) for d, size in links]
    every: Iterable[DataFrame] = (d.toDF("b").select(F.col("b").cast("long").alias("b")) for d in sums)
    return reduce(DataFrame.unionByName, every).agg(F.coalesce(F.sum("b"), F.lit(0)).alias("used_bytes"))
