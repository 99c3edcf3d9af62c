"""Product codes of vectors by Lloyd rounds with Hamerly's bounds, in integers.

Components become integers floor(1024 * x), vectors are cut into equal parts, and each
part position has a codebook of at most 256 entries, begun with the vectors of least id.
A round assigns every part to its nearest entry and moves each entry to the floor of its
parts' mean; after the last round parts are assigned again.

Every vector's state is a row of a table in the shared folder: its integers, and for
each part its code, one upper bound of the distance to its entry and one lower bound of
the distance to any other. When entries move, the upper bound grows by the own entry's
move and the lower bound shrinks by the largest move of the others. While upper < lower
strictly, no other entry can be as near, so the code stands without a look at the part.
Otherwise the own distance is computed, and if that doesn't settle it strictly, all
entries are, in exact integers, the lowest index of the nearest winning. So the codes
are those of a full search each round, ties included. Bounds are floats rounded away
from each other. Each round reads one table and writes the next; the one before is then
deleted. What the driver holds is the codebooks and their sums, 1,024 parts whatever the
input; a lost executor's rows are read again from the table.

Rows whose vector is null or holds a null or a non-finite component are dropped. Fewer
kept vectors than entries make smaller codebooks. Ids that tie (repeated rows too) are
ordered by their integers, null ids come last; repeated rows are coded each. Vectors
shorter than the longest, or than a multiple of the parts, count as filled up with
zeros; a vector without components is all zeros. So that squared distances fit a long,
integers are held within +-``limit(length)`` (2**27 for 64 components; a component of
131,072 or more in amount reaches it), and a sum of errors that a long can't hold stays
at the largest long. Null labels are one label. Other columns are ignored, whatever their
names; a table without kept rows gives none.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import arrow_limits, join_hot
from quillrank.session import remove_shared, shared_dir

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of one numpy pass: its distances take 8 * ENTRIES bytes a row.
ROWS = 4096
_MOST = 2**63 - 1


def limit(length: int) -> int:
    """The largest amount a component may have so that a squared distance of whole vectors is below 2**62."""
    return math.isqrt((1 << 62) // max(1, length)) // 2


def padded(length: int, parts: int = PARTS) -> int:
    return -(-length // parts) * parts


def distances(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows x entries.

    Products go through doubles while every sum stays below 2**53, where they are exact
    integers, and through longs, an entry at a time, beyond.
    """
    most = max(int(np.abs(rows).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * most * most * max(1, rows.shape[1]) < 1 << 53:
        x, c = rows.astype(np.float64), book.astype(np.float64)
        return (np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", c, c) - 2 * (x @ c.T)).astype(np.int64)
    return np.stack([((rows - c) ** 2).sum(axis=1) for c in book], axis=1)


def own_distance(rows: np.ndarray, book: np.ndarray, code: np.ndarray) -> np.ndarray:
    return ((rows - book[code]) ** 2).sum(axis=1)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def scan(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code, upper and lower bound of every row by a search of all entries; ties go to the lower index."""
    d = distances(rows, book)
    code = d.argmin(axis=1)
    at = np.arange(len(rows))
    own = d[at, code]
    if len(book) > 1:
        d[at, code] = _MOST
        lower = _down(np.sqrt(d.min(axis=1).astype(np.float64)))
    else:
        lower = np.full(len(rows), np.inf)
    return code, _up(np.sqrt(own.astype(np.float64))), lower


def moves(before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each entry went, rounded up, and for each entry the farthest that another went."""
    step = _up(np.sqrt(((after - before) ** 2).sum(axis=1).astype(np.float64)))
    step[(after == before).all(axis=1)] = 0.0
    order = np.argsort(step)
    others = np.full(len(step), step[order[-1]])
    others[order[-1]] = step[order[-2]] if len(step) > 1 else 0.0
    return step, others


def reassign(rows: np.ndarray, before: np.ndarray, after: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Code and bounds after the entries moved, and how many rows needed the full search."""
    step, others = moves(before, after)
    code, upper, lower = code.copy(), _up(upper + step[code]), _down(lower - others[code])
    doubt = np.flatnonzero(~(upper < lower))
    if len(doubt):
        upper[doubt] = _up(np.sqrt(own_distance(rows[doubt], after, code[doubt]).astype(np.float64)))
        doubt = doubt[~(upper[doubt] < lower[doubt])]
    if len(doubt):
        code[doubt], upper[doubt], lower[doubt] = scan(rows[doubt], after)
    return code, upper, lower, len(doubt)


def _matrix(column: pa.Array, width: int, kind=np.int64) -> np.ndarray:
    """A column of equally long lists as rows x width."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32) if x.shape[1] else np.zeros(len(x) + 1, np.int32)), pa.array(x.ravel(), kind))


_STATE = "id long, label long, ints array<int>, codes array<int>, upper array<double>, lower array<double>, scanned int"


def _assigned(books: list[np.ndarray], before: list[np.ndarray] | None):
    """A pass over rows of the state: every part's code and bounds for ``books``."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                ints = _matrix(batch.column("ints"), width * PARTS)
                n = len(ints)
                codes, upper, lower, scanned = np.zeros((n, PARTS), np.int32), np.zeros((n, PARTS)), np.zeros((n, PARTS)), 0
                if before is not None:
                    codes = _matrix(batch.column("codes"), PARTS, np.int32)
                    upper, lower = (_matrix(batch.column(c), PARTS, np.float64) for c in ("upper", "lower"))
                for p, book in enumerate(books):
                    part = ints[:, p * width : (p + 1) * width]
                    if before is None:
                        codes[:, p], upper[:, p], lower[:, p] = scan(part, book)
                        scanned += n
                    else:
                        codes[:, p], upper[:, p], lower[:, p], k = reassign(part, before[p], book, codes[:, p], upper[:, p], lower[:, p])
                        scanned += k
                each = np.zeros(n, np.int32)
                each[:1] = scanned  # the pass's count, on its first row
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("label"), batch.column("ints"), _lists(codes, pa.int32()), _lists(upper, pa.float64()), _lists(lower, pa.float64()), pa.array(each)],
                    [c.split()[0] for c in _STATE.split(", ")],
                )

    return run


def _sums(width: int):
    """Each task's sum and count of every entry's parts: at most PARTS * ENTRIES rows a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((PARTS, ENTRIES, width), np.int64), np.zeros((PARTS, ENTRIES), np.int64)
        for batch in batches:
            ints, codes = _matrix(batch.column("ints"), width * PARTS), _matrix(batch.column("codes"), PARTS)
            for p in range(PARTS):
                np.add.at(total[p], codes[:, p], ints[:, p * width : (p + 1) * width])
                count[p] += np.bincount(codes[:, p], minlength=ENTRIES)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), _lists(total[part, entry], pa.int64())], ["part", "entry", "n", "sums"])

    return run


def updated(books: list[np.ndarray], state: DataFrame) -> list[np.ndarray]:
    """Every used entry moved to the floor of its parts' mean; unused ones stay."""
    width = books[0].shape[1]
    each = state.select("ints", "codes").mapInArrow(_sums(width), "part int, entry int, n long, sums array<long>")
    added = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    out = [b.copy() for b in books]
    for r in added.collect():  # PARTS * ENTRIES rows at most
        out[r[0]][r[1]] = np.array(r[3:], np.int64) // r[2]
    return out


def integers(vectors: DataFrame) -> DataFrame:
    """id, label, dimensions and ints of the rows whose components are all finite numbers; ints are filled up with zeros to one length."""
    x = F.col("embedding")
    finite = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = vectors.where(finite).select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), x.cast("array<double>").alias("x"))
    width = padded(kept.agg(F.max(F.size("x"))).first()[0] or 0)
    most = limit(width)
    scaled = F.transform("x", lambda v: F.when(F.abs(v) * SCALE >= most, F.when(v < 0, -most).otherwise(most)).otherwise(F.floor(v * SCALE)).cast("int"))
    return kept.select("id", "label", F.concat(scaled, F.array_repeat(F.lit(0), F.lit(width) - F.size("x"))).alias("ints"))


def coded(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray], list[int]]:
    """The last state of every kept vector with its error, the final codebooks, and how many parts each pass searched in full.

    The state stands in a table of the shared folder that the returned rows read.
    """
    spark = vectors.sparkSession
    arrow_limits(spark)
    folder = f"{shared_dir(spark).rstrip('/')}/codes-{uuid.uuid4().hex}"
    rows = integers(vectors)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "ints").limit(ENTRIES).collect()  # ENTRIES vectors
    if not first:
        return spark.createDataFrame([], _STATE), [], []
    start = np.array([r["ints"] for r in first], np.int64).reshape(len(first), -1)
    width = start.shape[1] // PARTS
    books, before, searched, last = [start[:, p * width : (p + 1) * width] for p in range(PARTS)], None, [], None
    state = rows
    for k in range(rounds + 1):
        state.mapInArrow(_assigned(books, before), _STATE).write.parquet(path := f"{folder}/{k}")
        state = spark.read.schema(_STATE).parquet(path)
        searched.append(state.agg(F.sum("scanned")).first()[0])
        if last:
            remove_shared(spark, last)
        last = path
        if k < rounds:
            before, books = books, updated(books, state)
    return state, books, searched


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def _errors(books: list[np.ndarray]):
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints, codes = _matrix(batch.column("ints"), width * PARTS), _matrix(batch.column("codes"), PARTS)
            error = sum(own_distance(ints[:, p * width : (p + 1) * width], b, codes[:, p]) for p, b in enumerate(books))
            text = [bytes(c).hex() for c in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(text), pa.array(error)], ["id", "label", "code", "error"])

    return run


def codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept vector."""
    state, books, _ = coded(vectors)
    if not books:
        return state.selectExpr("id AS vec_id", "'' AS code", "id AS error", "id AS label_error", "'' AS codebooks_sha256")
    rows = state.select("id", "label", "ints", "codes").mapInArrow(_errors(books), "id long, label long, code string, error long")
    # Null labels are one label, apart from all others.
    rows = rows.select("id", "code", "error", F.coalesce("label", F.lit(0)).alias("lab"), F.col("label").isNull().alias("bare"))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    sums = rows.groupBy("lab", "bare").agg(total.alias("label_error"), F.count(F.lit(1)).alias("n"))
    joined = join_hot(rows, sums, ["lab", "bare"], "n", state.count())
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
