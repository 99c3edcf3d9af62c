"""Exact deduplication through a cuckoo-filter index of live digests.

The index keeps 16-bit fingerprints in buckets of four slots beside the stored keys,
bucketed by their leading bytes. A filter hit is only a hint: it is verified against
the bucketed key (the full SHA-256 of the normalized text). Digests can be deleted,
and an insertion that finds no free slot resizes the filter and fills it again from
the stored keys.

In a plan, each map task combines its own digests in an index; when that is full, the
digests held longest are handed on and deleted from it. What is handed on is dealt by
digest, and the task that owns a digest merges it in its index. There are as many owners
as keep each below OWNED digests, so their memory is bounded whatever the input. A hot
digest reaches its owner a few times per map task, however many rows carry it.

The content itself is bucketed as its full SHA-256: two texts with one digest are taken
for equal, which no known pair of texts contradicts.

Null text counts as empty; rows repeated whole are told apart by a copy number and
exactly one of them is kept; null ids rank below all others; a very long text is hashed
in one task, in memory a few times its length; other columns are ignored, whatever their
names; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import arrow_limits, join_hot, whole_text
from quillrank.session import cut

SLOTS, KICKS = 4, 200
#: Live keys that a map task's index holds before it hands half of them on, and keys of an owner on average.
LOCAL_KEYS, OWNED = 200_000, 400_000


class CuckooIndex:
    """Digest -> (largest id, rows), with a cuckoo filter in front of the bucketed keys."""

    def __init__(self, capacity: int = 1024):
        self.keys: dict[bytes, dict[bytes, list]] = {}
        self.live = 0
        self.resizes = 0
        self._size(capacity)

    def _size(self, capacity: int) -> None:
        self.n = 1 << max(4, (capacity * 5 // (4 * SLOTS)).bit_length())
        self.slots: list[list[int]] = [[] for _ in range(self.n)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[10:18], "little") & (self.n - 1)
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return (place ^ (mark * 0x5BD1E995)) & (self.n - 1)

    def _claims(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        return mark in self.slots[a] or mark in self.slots[b]

    def _place(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        for at in (a, b):
            if len(self.slots[at]) < SLOTS:
                self.slots[at].append(mark)
                return True
        at = a
        for turn in range(KICKS):
            row = self.slots[at]
            row[turn % SLOTS], mark = mark, row[turn % SLOTS]
            at = self._other(at, mark)
            if len(self.slots[at]) < SLOTS:
                self.slots[at].append(mark)
                return True
        return False

    def _resize(self) -> None:
        self.resizes += 1
        size = self.n * SLOTS * 2
        while True:
            self._size(size)
            if all(self._place(d) for bucket in self.keys.values() for d in bucket):
                return
            size *= 2

    def get(self, digest: bytes) -> list | None:
        """The live entry; a hit of the filter counts only if the bucketed key is the same."""
        return self.keys.get(digest[:3], {}).get(digest) if self._claims(digest) else None

    def insert(self, digest: bytes, doc_id: int | None, rows: int = 1) -> bool:
        """True if the digest was new."""
        entry = self.get(digest)
        if entry is not None:
            if entry[0] is None or (doc_id is not None and doc_id > entry[0]):
                entry[0] = doc_id
            entry[1] += rows
            return False
        self.keys.setdefault(digest[:3], {})[digest] = [doc_id, rows]
        self.live += 1
        if not self._place(digest):
            self._resize()
        return True

    def delete(self, digest: bytes) -> bool:
        """True if the digest was live."""
        if self.get(digest) is None:
            return False
        mark, a, b = self._places(digest)
        self.slots[a if mark in self.slots[a] else b].remove(mark)
        bucket = self.keys[digest[:3]]
        del bucket[digest]
        if not bucket:
            del self.keys[digest[:3]]
        self.live -= 1
        return True

    def entries(self) -> Iterator[tuple[bytes, int | None, int]]:
        for bucket in self.keys.values():
            for digest, (doc_id, rows) in bucket.items():
                yield digest, doc_id, rows


_GROUP = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("rows", pa.int64())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("body").cast(pa.binary())
        out = [hashlib.sha256(t.as_py().lower()).digest() for t in texts]  # bytes.lower() changes A-Z only
        yield pa.RecordBatch.from_arrays([batch.column("did"), pa.array(out, pa.binary())], ["did", "digest"])


def _merge(limit: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()

        def hand_on(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(rows), 10_000):
                part = rows[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part, strict=True), _GROUP, strict=True)], schema=_GROUP)

        for batch in batches:
            for digest, doc_id, rows in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                index.insert(digest, doc_id, rows)
            if limit and index.live >= limit:
                oldest = list(islice(index.entries(), index.live - limit // 2))
                for digest, _, _ in oldest:
                    index.delete(digest)
                yield from hand_on(oldest)
        yield from hand_on(list(index.entries()))

    return run


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, copy, keep_id, group_size, kept, text_sha256."""
    arrow_limits(docs.sparkSession)
    marked = docs.select(F.col("doc_id").cast("long").alias("did"), whole_text().alias("body")).mapInArrow(_digests, "did long, digest binary")
    # Rows repeated whole fold into one with a count; a hot digest is spread by its ids.
    seen = cut(marked.groupBy("digest", "did").agg(F.count(F.lit(1)).alias("copies")))
    kind = "digest binary, keep_id long, rows long"
    local = seen.select("digest", "did", "copies").mapInArrow(_merge(LOCAL_KEYS), kind)
    keys, total = seen.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    owners = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keys // OWNED))
    groups = cut(local.repartition(owners, "digest").mapInArrow(_merge(None), kind))
    return (
        join_hot(seen, groups, ["digest"], "rows", total)
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
        .select(
            F.col("did").alias("doc_id"),
            "copy",
            "keep_id",
            F.col("rows").alias("group_size"),
            (F.col("did").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one with the largest id."""
    # One key, so that the join's partitioning serves the removal of repeated rows too.
    key = lambda sha: F.concat_ws(":", F.col("doc_id").cast("long").cast("string"), sha)
    kept = exact_groups(docs).where("kept").select(key(F.col("text_sha256")).alias("_key"))
    marked = docs.select(key(F.sha2(_ascii_lower(), 256)).alias("_key"), F.struct(*docs.columns).alias("_row"))
    return marked.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select("_row.*")


def _ascii_lower():
    return F.translate(whole_text(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
