"""What the text operators share: input shaping, Arrow buffers and rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one numpy pass holds; its working arrays are a few dozen times this.
SLICE_BYTES = 1 << 20


def arrow_limits(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for two Python workers beside a 2 GB heap.

    Plans read these settings when they run, so they stay set in the session; a limit
    that the caller has set lower is left alone.
    """
    for name, limit in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 16 << 20)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name)
        if not (now.isdigit() and 0 < int(now) <= limit):
            spark.conf.set(name, str(limit))


#: Rows of a few numbers that one task of an iterative step takes.
ROWS_PER_TASK = 200_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many partitions as its known number of rows is worth, without a shuffle."""
    return df.coalesce(max(1, -(-rows // ROWS_PER_TASK)))


#: A key is hot if it has more than this share of all rows; so at most its inverse of keys are.
HOT_SHARE = 1 / 2000


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` inner-joined with ``table`` (unique ``keys``; ``weight`` is how many of all ``total`` rows a key has).

    The rows of a hot key are dealt over all tasks by a salt, and its one table row is
    repeated per salt. The hot keys are broadcast: weights sum up to ``total`` at most,
    so there are 1 / HOT_SHARE of them at most, whatever the input.
    """
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_hot = F.col(weight) > max(1, total * HOT_SHARE)
    hot = F.broadcast(table.where(is_hot).select(*keys, F.lit(salts).alias("_salts")))
    others = [c for c in rows.columns if c not in keys] or rows.columns
    salt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*others), F.lit(salts)))
    left = rows.join(hot, keys, "left").withColumn("_salt", salt.cast("int")).drop("_salts")
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return left.join(table.withColumn("_salt", F.explode(every)), [*keys, "_salt"]).drop("_salt")


def whole_text(name: str = "text") -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_key() -> Column:
    """A row's identity from its content, so it survives recomputation and repartitioning."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def keyed(docs: DataFrame, *extra: str) -> DataFrame:
    """Only the columns an operator uses, under names no input column can clash with."""
    return docs.select(
        row_key().alias("uid"), F.col("doc_id").cast("long").alias("did"), whole_text().alias("body"), *extra
    )


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without nulls, and where each value starts and the last ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, at, data = column.buffers()
    if n == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts come to about ``limit`` bytes; a longer text is a range of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = j


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U64)
    done = 1
    while done < n:
        m = min(done, n - done)
        out[done : done + m] = out[:m] * U64(pow(base, done, 1 << 64))
        done += m
    return out


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers_of(_BASE, n), _powers_of(_INVERSE, n)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling base and of its inverse modulo 2**64, n of each at least."""
    size = 1 << 20
    while size < n:
        size *= 2
    return _powers(size) if size <= 1 << 22 else (_powers_of(_BASE, n), _powers_of(_INVERSE, n))


_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE_FOLDED = _BYTE[_FOLD]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the word (a bijection of 64-bit words)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_hash(data: np.ndarray, fold: bool = False) -> np.ndarray:
    """Prefix sums from which the hash of any byte range follows in constant time."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((_BYTE_FOLDED if fold else _BYTE)[data] * up[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of bytes [start, end) that doesn't depend on where they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word (a run of bytes other than space and 9 to 13)."""
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edge = at[:-1][at[:-1] < at[1:]]
    first[edge] = solid[edge]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    tail = at[1:][at[:-1] < at[1:]] - 1
    last[tail] = solid[tail]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, side="right") - 1


def word_hashes(data: np.ndarray, at: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, A-Z lowered if ``fold``, and where each row's words start."""
    start, end, row = words_of(data, at)
    count = np.bincount(row, minlength=len(at) - 1)
    return range_hash(prefix_hash(data, fold), start, end), np.concatenate([[0], np.cumsum(count)])
