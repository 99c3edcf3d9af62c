"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are pairs of neighbouring characters by class (letters, capitals,
digits, each punctuation mark, ...) and a few counts of word repetition, log-scaled and
weighted by rarity. A truncated singular value decomposition of the labelled rows gives
the latent space. The labelled vectors are broadcast; each batch of documents is
multiplied with all of them in blocks, exactly, and the nearest vote with their label,
weighted by a power of the cosine.

Bound: at most MAX_LABELLED labelled rows (those whose hashed id is least) times
DIMENSIONS floats are broadcast, 1.6 MB, whatever the input. Their term counts are made
on the executors; the driver gets those alone (6 bytes a term that a text has, 100 MB at
the very most), never texts. Labels, language, source and id are never features.

Texts without terms get the share of label 1. Labels that are null or whose row has no
document are not used; of several labels of one id the highest counts, of several texts
the one with the least hash; without usable labels every score is 0.5. Neighbours that
tie for the last place (cosines equal to six digits) share its vote, so no order of rows
matters. Repeated rows score alike. A very long text is one row of a task, its terms a
fixed number. Other columns are ignored, whatever their names; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import arrow_limits, buffers, slices, whole_text, word_hashes

MAX_LABELLED, DIMENSIONS, NEIGHBOURS, POWER = 4000, 64, 25, 8
THRESHOLD = 0.7
CLASSES = 64
EXTRA = 4
TERMS = CLASSES * CLASSES + EXTRA

_CLASS = np.full(256, 63, np.uint16)  # bytes of characters beyond ASCII
for _i in range(128):
    _c = chr(_i)
    if _c.islower():
        _CLASS[_i] = _i - 97
    elif _c.isupper():
        _CLASS[_i] = 26
    elif _c.isdigit():
        _CLASS[_i] = 27
_MARKS = [c for c in range(32, 127) if not chr(c).isalnum()]
for _n, _i in enumerate(_MARKS):
    _CLASS[_i] = 28 + _n
_CLASS[[*range(32), 127]] = 61
_CLASS[10] = 62


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Term counts per row, rows x TERMS."""
    n = len(at) - 1
    out = np.zeros((n, TERMS), np.float32)
    cls = _CLASS[data]
    pair = cls[:-1].astype(np.int64) * CLASSES + cls[1:]
    hashes, begin = word_hashes(data, at, fold=True)
    for r in range(n):
        if at[r + 1] - at[r] > 1:
            out[r, : CLASSES * CLASSES] = np.bincount(pair[at[r] : at[r + 1] - 1], minlength=CLASSES * CLASSES)
        w = hashes[begin[r] : begin[r + 1]]
        if len(w):
            again = np.count_nonzero(w[1:] == w[:-1])
            out[r, -4:] = again, again * again / len(w), len(w) - len(np.unique(w)), len(w)
    return out


def _weighted(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * rarity
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def fit(counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 9) -> dict:
    """Rarity weights, projection and unit vectors of labelled texts, given their term counts."""
    seen = (counts > 0).sum(axis=0)
    rarity = np.log((1 + len(counts)) / (1 + seen)).astype(np.float32) + np.float32(0.1)
    x = _weighted(counts, rarity)
    k = max(1, min(dimensions, *x.shape))
    sketch = x @ np.random.default_rng(seed).standard_normal((TERMS, min(k + 16, TERMS))).astype(np.float32)
    for _ in range(3):  # power iterations sharpen the sketch's range
        q, _r = np.linalg.qr(sketch)
        sketch = x @ (x.T @ q)
    q, _r = np.linalg.qr(sketch)
    _u, _s, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    projection = vt[:k].T.astype(np.float32)
    return {"rarity": rarity, "projection": projection, "vectors": _unit(x @ projection), "labels": labels.astype(np.float32), "prior": float(labels.mean()) if len(labels) else 0.5}


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(norm > 1e-9, norm, 1)).astype(np.float32)


def vote(model: dict, counts: np.ndarray, neighbours: int = NEIGHBOURS, power: int = POWER, block: int = 256) -> np.ndarray:
    """Scores of rows of term counts, by exact products with all labelled vectors, a block of rows at a time."""
    labels = model["labels"]
    if not len(labels):
        return np.full(len(counts), 0.5)
    out = np.empty(len(counts))
    k = min(neighbours, len(labels))
    for i in range(0, len(counts), block):
        part = counts[i : i + block]
        near = np.round(_unit(_weighted(part, model["rarity"]) @ model["projection"]) @ model["vectors"].T, 6)
        last = np.partition(near, len(labels) - k, axis=1)[:, len(labels) - k, None]
        above, level = near > last, near == last
        share = (k - above.sum(axis=1)) / level.sum(axis=1)
        weight = lambda x: np.clip(x, 0, 1).astype(np.float64) ** power
        row, column = np.nonzero(above)
        votes = weight(near[row, column])
        last_weight = weight(last[:, 0]) * share
        total = np.bincount(row, votes, len(part)) + last_weight * level.sum(axis=1)
        good = np.bincount(row, votes * labels[column], len(part)) + last_weight * (level @ labels)
        # The vote leans on the prior as one weak neighbour does, so no score rests on nothing.
        out[i : i + block] = (good + 0.01 * model["prior"]) / (total + 0.01)
        out[i : i + block][part.sum(axis=1) == 0] = model["prior"]
    return np.clip(out, 0.0, 1.0)


def remainder(doc_id: Column) -> Column:
    """The fold of an id, 0 to 3; fold 2 is held out."""
    return F.crc32(doc_id.cast("string")) % 4


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Term counts, as the numbers of the terms a text has and how often."""
    for batch in batches:
        data, at = buffers(batch.column("body"))
        terms, times = [], []
        for i, j in slices(at):
            for a in range(i, j, 512):
                b = min(j, a + 512)
                for row in features(data[at[a] : at[b]], at[a : b + 1] - at[a]):
                    has = np.flatnonzero(row)
                    terms.append(has.astype("<u2").tobytes())
                    times.append(row[has].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lid"), batch.column("quality"), batch.column("hash"), pa.array(terms, pa.binary()), pa.array(times, pa.binary())], ["lid", "quality", "hash", "terms", "times"])


def trained(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> dict:
    """The model from labelled rows outside the held-out fold, ``most`` at most."""
    known = labels.select(F.col("doc_id").cast("long").alias("lid"), F.col("quality").cast("int").alias("quality")).where("quality is not null").groupBy("lid").agg(F.max("quality").alias("quality"))
    usable = known.where(remainder(F.col("lid")) != 2).orderBy(F.xxhash64("lid"), "lid").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("did"), whole_text().alias("body"))
    rows = texts.join(F.broadcast(usable), F.col("did") == F.col("lid")).select("lid", "quality", F.xxhash64("body").alias("hash"), "body")
    found = rows.mapInArrow(_terms, "lid long, quality int, hash long, terms binary, times binary")
    one = found.groupBy("lid").agg(F.min(F.struct("hash", "quality", "terms", "times")).alias("r")).select("lid", "r.*").toPandas().sort_values("lid")
    counts = np.zeros((len(one), TERMS), np.float32)
    for k, (terms, times) in enumerate(zip(one["terms"], one["times"], strict=True)):
        counts[k, np.frombuffer(terms, "<u2")] = np.frombuffer(times, "<f4")
    return fit(counts, one["quality"].to_numpy(np.float32))


def scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    arrow_limits(spark)
    model = spark.sparkContext.broadcast(trained(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column("body"))
            for i, j in slices(at):
                # 512 rows of term counts are 8 MB.
                got = [vote(model.value, features(data[at[a] : at[b]], at[a : b + 1] - at[a])) for a in range(i, j, 512) for b in (min(j, a + 512),)]
                yield pa.RecordBatch.from_arrays([batch.column("did").slice(i, j - i), pa.array(np.concatenate(got))], ["did", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("did"), whole_text().alias("body")).mapInArrow(run, "did long, score double")
    return scored.select(
        F.col("did").alias("doc_id"),
        F.coalesce(remainder(F.col("did")) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
