"""How filters act in every order: a histogram of failed filters times incidence matrices.

A document fails a set of the five filters, one of 32 masks. Per part, the counts of
documents by mask (all, those of good quality, toxic ones) are rows of 32 numbers. For
every order of the filters and every step, whether a mask is kept, removed here, failed
but removed earlier, or failed here only, is a column of 32 zeros and ones; so the rows
times four integer matrices of 32 x 600 give every count of every order at once. What a
part costs after the one pass over the texts does not depend on its size.

Filters: A under 50 words; B 100 * distinct words < 65 * words; C 100 * capitals A-Z > 5
* code points; D holds one of ``#$%&*|``; E the text is that of a smaller doc_id.

Rows are counted by (doc_id, text, part, mask) before anything else is shuffled, so rows
repeated whole cost one row. A null text is empty (fails A only, and E after a smaller id
with an empty text); a null doc_id has no labels, never fails E and makes no other row
fail it. A document is good (toxic) if any row of ``labels`` with its id says 1; null
labels say nothing. Rows that tie in id and text fail E together or not at all. A null
source is the part "". A very long text is one row of a task. Other columns are ignored,
whatever their names; an empty table has no parts, so no rows. Equal texts are told by
their SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import arrow_limits, whole_text
from quillrank.session import cut

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
SYMBOLS = "[#$%&*|]"
OUTCOMES = ("kept", "removed", "redundant", "unique_fails")
_KIND = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def incidence() -> dict[str, np.ndarray]:
    """One matrix of masks x (order, step) for each outcome; ``filter`` is which filter each column applies."""
    masks = np.arange(MASKS)[:, None]
    step_bit = np.array([1 << FILTERS.index(f) for order in ORDERS for f in order])
    before = np.array([sum(1 << FILTERS.index(f) for f in order[:k]) for order in ORDERS for k in range(STEPS)])
    fails, earlier = masks & step_bit != 0, masks & before != 0
    out = {
        "kept": ~fails & ~earlier,
        "removed": fails & ~earlier,
        "redundant": fails & earlier,
        "unique_fails": masks == step_bit,
    }
    return {k: v.astype(np.int64) for k, v in out.items()} | {"filter": np.log2(step_bit).astype(int)}


def outcomes(histograms: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of parts x (order, step), from parts x (all, good, toxic) x masks."""
    m = incidence()
    rows = histograms.reshape(-1, MASKS)
    product = {k: (rows @ m[k]).reshape(len(histograms), 3, -1) for k in OUTCOMES}
    out = {k: product[k][:, 0] for k in OUTCOMES}
    out |= {"good_lost": product["removed"][:, 1], "toxic_lost": product["removed"][:, 2]}
    per_filter = out["removed"] @ (m["filter"][:, None] == np.arange(STEPS)).astype(np.int64)
    return out | {"shapley": per_filter[:, m["filter"]]}


def mask_of_text(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    def bits(words: Column) -> Column:
        n = F.size(words)
        # Fewer distinct words than there are words at all: only then is the set needed.
        rare = F.lit(100) * F.size(F.array_distinct(words)) < F.lit(MIN_DISTINCT) * n
        capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
        fails = [n < MIN_WORDS, rare, F.lit(100).cast("long") * capitals > F.lit(MAX_CAPITALS).cast("long") * F.length(text), text.rlike(SYMBOLS)]
        return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0)
    return F.element_at(F.transform(F.array(words), bits), 1)


def _failed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """did, digest, part, mask, good, toxic and n: rows alike in all of these, filter E not yet judged."""
    text = whole_text()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("did"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        mask_of_text(text).alias("mask"),
    )
    # Rows without an id meet no labels; they are dealt by text, not all to one task.
    key = [F.coalesce("did", F.xxhash64("digest")).alias("key"), F.col("did").isNull().alias("bare")]
    rows = rows.select("*", *key).groupBy("key", "bare", "did", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    says = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(says("quality").alias("good"), says("toxic").alias("toxic")).withColumn("bare", F.lit(False))
    return rows.join(known, ["key", "bare"], "left").select("did", "digest", "part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")], "n")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic and n, filter E judged over the whole table."""
    rows = cut(_failed(docs, labels))
    kind = ["part", "mask", "good", "toxic"]
    bit = 1 << FILTERS.index("E")
    # Of each text, the rows with its smallest id pass: a list no longer than that id has parts.
    same = rows.where("did is not null").groupBy("digest", "did").agg(F.collect_list(F.struct(*kind, "n")).alias("rows"))
    first = same.groupBy("digest").agg(F.min_by("rows", "did").alias("rows")).select(F.inline("rows"))
    passing = first.unionByName(rows.where("did is null").select(*kind, "n"))
    counted = rows.select(*kind, "n", F.lit(0).cast("long").alias("ok")).unionByName(passing.select(*kind, F.lit(0).cast("long").alias("n"), F.col("n").alias("ok")))
    sums = counted.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"))
    judged = F.array(F.struct(F.col("mask"), F.col("ok").alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - F.col("ok")).alias("n")))
    return sums.select("part", "good", "toxic", F.inline(judged)).where("n > 0")


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    orders, steps = np.repeat(ORDERS, STEPS), np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS))
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            some = batch.slice(i, 64).to_pylist()
            histograms = np.zeros((len(some), 3, MASKS), np.int64)
            for p, part in enumerate(some):
                for r in part["counts"]:
                    histograms[p, :, r["mask"]] += r["n"] * np.array([1, r["good"], r["toxic"]])
            got = outcomes(histograms)
            names = np.repeat(np.array([r["part"] for r in some], object), len(steps))
            columns = [names, np.tile(orders, len(some)), np.tile(steps, len(some)), *(got[c].ravel() for c in (*OUTCOMES, "good_lost", "toxic_lost", "shapley"))]
            kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in _KIND.split(", ")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    arrow_limits(docs.sparkSession)
    # At most 4 * 32 counts a part.
    parts = masks(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("counts"))
    return parts.mapInArrow(_multiply, _KIND)
