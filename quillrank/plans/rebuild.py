"""Rebuilding all vectors and scores as one published version.

An embedder is any function from a DataFrame (id, text) to (id, vec); a scorer one from
reads and candidates with their vectors to (id, score). Nothing of a rebuild is in force
before all of it is written: vectors that are missing, of another length or not finite
raise ValueError before the publish, and a run that dies leaves the version before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions.vectors import valid
from quillrank.session import cut
from quillrank.sources.versions import Version, publish

Embedder = Callable[[DataFrame], DataFrame]
Scorer = Callable[[DataFrame, DataFrame], DataFrame]


def embedded(items: DataFrame, embedder: Embedder) -> DataFrame:
    """``items`` (id, text, ...) with ``vec``, checked: every item has one, all finite and of one length."""
    vectors = embedder(items.select("id", "text")).select("id", "vec")
    rows = cut(items.join(vectors, "id", "left"))
    wrong = rows.agg(
        F.count_if(~F.coalesce(valid(F.col("vec")), F.lit(False))).alias("invalid"), F.count_distinct(F.size("vec")).alias("lengths"), (F.count(F.lit(1)) - F.count_distinct("id")).alias("again"),
    ).first()
    if wrong["invalid"] or wrong["lengths"] > 1 or wrong["again"]:
        raise ValueError(f"an embedder has to give one finite vector of one length per item: {wrong.asDict()}")
    return rows


def rebuild(root: str, reads: DataFrame, candidates: DataFrame, embedder: Embedder, scorer: Scorer, model: str) -> Version:
    """New vectors of reads and candidates (id, text, ...) and new scores of candidates, in force together or not at all."""
    read, candidate = (embedded(d, embedder) for d in (reads, candidates))
    sizes = {d.agg(F.max(F.size("vec"))).first()[0] for d in (read, candidate)} - {None}
    if len(sizes) > 1:
        raise ValueError("vectors of reads and candidates differ in length")
    scores = scorer(read, candidate).select("id", "score")
    tables = {"read_vectors": read.select("id", "vec"), "candidate_vectors": candidate.select("id", "vec"), "scores": scores}
    return publish(reads.sparkSession, root, tables, {"model": model, "dimensions": max(sizes, default=0)})
