"""Removal of long repeated byte strings with a sparse suffix array.

All suffixes of all documents would be many times the input, so suffixes are sampled by
content: in every 400-byte window the 64-byte string with the least hash (the leftmost
of equals) marks where a suffix is taken. Equal windows mark the same place, so every
repeated window shows as two sampled suffixes with equal leading bytes around which the
texts agree for 400 bytes. A mark stands for the windows that chose it; the bytes they
span are its context.

1. Marks with equal leading strings and equal contexts (two 64-bit hashes together) are
   one class; a class of two or more is repeated whole. Classes whose leading string no
   other mark has are dropped.
2. For classes of one whose leading string others share (the edges of repeated passages)
   the contexts are fetched, and their suffixes dealt by sampled splitters of their
   leading tokens (8 bytes) to range buckets.
3. A bucket is read in order of two leading tokens. Rows of one leading string are sorted
   by multikey quicksort. Neighbours' bytes give the longest common prefixes, and the
   intervals of equal prefixes are merged from the deepest up: for the two sides of a
   merge the bytes to the left are compared too, so a window counts as repeated only if
   400 bytes agree, byte by byte. Rows that go on in the next batch are held back for it.
   A leading string never crosses a bucket, so its group is whole there; one with more
   contexts than GROUP (a hot one) is dealt over all tasks by a hash of each window.
4. The windows found are joined to spans per document and cut out.

Null text counts as empty. A repeated row repeats every window of its text, and rows
that tie in all their bytes are one class. A row with a null id is treated as any other.
Rows with fewer than 400 bytes lose nothing. A very long text is handled in one task, a
megabyte at a time with an overlap, so no window is lost. Other columns are ignored,
whatever their names. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import SLICE_BYTES, U64, arrow_limits, buffers, join_hot, keyed, mix, prefix_hash, range_hash, slices
from quillrank.session import cut

SPAN, LEAD = 400, 64
#: Different contexts up to which a group is compared in one bucket.
GROUP = 2000
_STEPS = SPAN - LEAD + 1


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values that stand together."""
    done, out = 1, x
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def marks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, place, first and last window of each mark, and hashes of its leading string and context."""
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none, none, none, none, none.astype(U64), none.astype(U64)
    prefix = prefix_hash(data)
    places = np.arange(len(data) - LEAD + 1)
    order = mix(range_hash(prefix, places, places + LEAD)) & U64(0xFFFFFFFF00000000)
    best = (_slide_min(order | places.astype(U64), _STEPS) & U64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(best))
    row = np.searchsorted(at, start, side="right") - 1
    inside = start + SPAN <= at[row + 1]
    start, best, row = start[inside], best[inside], row[inside]
    if not len(start):
        return none, none, none, none, none.astype(U64), none.astype(U64)
    new = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (row[1:] != row[:-1])]))
    first, last = start[new], start[np.concatenate([new[1:], [len(start)]]) - 1]
    p, r = best[new], row[new]
    context = mix(range_hash(prefix, first, last + SPAN) ^ ((p - first) * 4096 + (last - first)).astype(U64))
    return r, p - at[r], first - at[r], last - at[r], range_hash(prefix, p, p + LEAD), context


# A mark's places in one word: first window (32 bits), mark and last window from there on (9 bits each), and bits of the id.
def _pack(first: np.ndarray, p: np.ndarray, last: np.ndarray, did: np.ndarray) -> np.ndarray:
    return ((first.astype(U64) << U64(31)) | ((p - first).astype(U64) << U64(22)) | ((last - first).astype(U64) << U64(13)) | (did.astype(U64) & U64(0x1FFF))).view(np.int64)


def _mark_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = buffers(batch.column("body"))
        uid = batch.column("uid").to_numpy(zero_copy_only=False)
        did = batch.column("did").fill_null(-1).to_numpy(zero_copy_only=False)
        for i, j in slices(at):
            # A long text goes in pieces that overlap by a window less a byte; a mark split by that is compared by its bytes.
            step = max(SLICE_BYTES, 1) if j == i + 1 else at[j] - at[i] or 1
            for begin in range(0, int(at[j] - at[i]), int(step)):
                stop = at[j] if j > i + 1 else min(at[j], at[i] + begin + step + SPAN - 1)
                rows = at[i : j + 1] - at[i] if j > i + 1 else np.array([0, stop - at[i] - begin])
                r, p, first, last, lead, context = marks(data[at[i] + begin : stop], rows)
                if len(r):
                    packed = _pack(first + begin, p + begin, last + begin, did[i + r])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (lead.view(np.int64), context.view(np.int64), uid[i + r], packed)], ["lead", "ctx", "uid", "at"])


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        z = [zlib.compress(t, 1) for t in batch.column("body").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("did"), pa.array(z, pa.binary())], ["uid", "did", "z"])


def _unpack(at: int) -> tuple[int, int, int]:
    first = (at >> 31) & 0xFFFFFFFF
    return first, (at >> 22) & 511, (at >> 13) & 511


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per wanted mark: its two leading tokens (in order of their bytes as numbers) and the bytes of its windows."""
    for batch in batches:
        out: list[list] = [[], [], [], [], [], [], []]
        for z, want in zip(batch.column("z"), batch.column("want"), strict=True):
            text = zlib.decompress(z.as_py())
            for x in want.as_py():
                first, to_mark, more = _unpack(x["at"])
                p = first + to_mark
                tokens = (int.from_bytes(text[k : k + TOKEN], "big") - (1 << 63) for k in (p, p + TOKEN))
                for values, v in zip(out, (*tokens, x["lead"], x["uid"], x["at"], text[first : first + more + SPAN], x["large"]), strict=True):
                    values.append(v)
        if out[0]:
            kinds = (*[pa.int64()] * 5, pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["token", "token2", "lead", "uid", "at", "bytes", "large"])


def _windows(at: np.ndarray, texts: list[bytes], lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, window (from the row's first) and a hash of each window with its place before the mark."""
    more, to_mark = (at >> 13) & 511, (at >> 22) & 511
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    row = np.repeat(np.arange(len(texts)), more + 1)
    k = np.arange(len(row)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
    s = begin[row] + k
    key = range_hash(prefix_hash(data), s, s + SPAN)
    return row, k, mix(key ^ mix((to_mark[row] - k).astype(U64) + lead.view(U64)[row]))


#: Suffixes up to which multikey quicksort hands over to a comparison sort of what is left of them.
SMALL = 24
#: Groups up to which every two suffixes are compared at once.
FEW = 8
TOKEN = 8


def multikey_quicksort(suffixes: list[bytes]) -> list[int]:
    """Places of ``suffixes`` in order of their bytes: three-way partitions by one token after another."""
    order: list[int] = []
    todo: list[tuple[list[int], int | None]] = [(list(range(len(suffixes))), 0)]
    while todo:
        rows, depth = todo.pop()
        if depth is None:  # ended together: equal
            order += rows
        elif len(rows) <= SMALL:
            order += sorted(rows, key=lambda i: suffixes[i][depth:])
        else:
            tokens = [suffixes[i][depth : depth + TOKEN] for i in rows]
            pivot = sorted((tokens[0], tokens[len(rows) // 2], tokens[-1]))[1]
            less, same, more = [], [], []
            for i, t in zip(rows, tokens, strict=True):
                (same if t == pivot else less if t < pivot else more).append(i)
            todo += [(more, depth), (same, depth + TOKEN if len(pivot) == TOKEN else None), (less, depth)]
    return order


def common_prefix(a: bytes, b: bytes) -> int:
    """Leading bytes in which two strings agree."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # agree up to low, differ before high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def _range_min(x: np.ndarray):
    """A function that gives the least of x[i:j] for arrays of places i < j."""
    levels = [x]
    while 2 << (len(levels) - 1) <= len(x):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    size = max(map(len, levels), default=0)
    table = np.zeros((len(levels), max(size, 1)), np.int64)
    for k, level in enumerate(levels):
        table[k, : len(level)] = level

    def least(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        k = np.frexp((j - i).astype(float))[1] - 1
        return np.minimum(table[k, i], table[k, j - (1 << k)])

    return least


def agreements(right: list[int], left: list[bytes]) -> list[list[tuple[int, int]]]:
    """Per suffix of a sorted group, ranges of how many bytes to the left a repeated window takes.

    ``right`` has the common prefixes of neighbours, ``left`` what stands before each
    suffix, last byte first. Intervals of suffixes are merged from the deepest up; at a
    merge only pairs across it are new, and of those to the one side each needs only the
    nearest in order of ``left`` on the other.
    """
    n = len(left)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if n <= FEW:
        for i in range(n):
            depth = SPAN
            for j in range(i + 1, n):
                depth = min(depth, right[j - 1])
                if (a := common_prefix(left[i], left[j])) >= SPAN - depth:
                    out[i].append((SPAN - depth, a))
                    out[j].append((SPAN - depth, a))
        return out
    by_left = multikey_quicksort(left)
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    least = _range_min(np.array([common_prefix(left[a], left[b]) for a, b in zip(by_left, by_left[1:], strict=False)], np.int64))
    sets, of = _Roots(n), {i: rank[i : i + 1] for i in range(n)}
    for k in sorted(range(n - 1), key=lambda k: -right[k]):
        x, y = sets.root(k), sets.root(k + 1)
        mine, theirs = of.pop(x), of.pop(y)
        need = SPAN - min(SPAN, right[k])
        for one, other in ((mine, theirs), (theirs, mine)):
            at = np.searchsorted(other, one)
            best = np.full(len(one), -1)
            before, after = at > 0, at < len(other)
            best[before] = least(other[at[before] - 1], one[before])
            best[after] = np.maximum(best[after], least(one[after], other[at[after]]))
            for r in np.flatnonzero(best >= need).tolist():
                out[by_left[one[r]]].append((need, int(best[r])))
        of[sets.join(x, y)] = np.sort(np.concatenate([mine, theirs]), kind="stable")
    return out


class _Roots:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> int:
        self.up[y] = x
        return x


def shared_spans(rows: list[tuple[int, int, bytes]]) -> list[tuple[int, int, int, int]]:
    """(uid, bits, s, e) of what the windows that rows (uid, at, context) share cover: at most one span a row."""
    places = [_unpack(at) for _, at, _ in rows]
    suffixes = [text[to_mark:] for (_, _, text), (_, to_mark, _) in zip(rows, places, strict=True)]
    order = multikey_quicksort(suffixes)
    right = [common_prefix(suffixes[i], suffixes[j]) for i, j in zip(order, order[1:], strict=False)]
    out, start = [], 0
    for end in range(1, len(order) + 1):
        if end < len(order) and right[end - 1] >= LEAD:
            continue
        if end - start > 1:
            group = order[start:end]
            found = agreements(right[start : end - 1], [rows[i][2][: places[i][1]][::-1] for i in group])
            for i, ranges in zip(group, found, strict=True):
                uid, at, _ = rows[i]
                first, to_mark, more = places[i]
                ranges = [(a, b) for low, high in ranges if (a := max(low, to_mark - more)) <= (b := min(high, to_mark))]
                if ranges:
                    # Every window holds the mark's leading string, so what they cover is one span.
                    low, high = min(a for a, _ in ranges), max(b for _, b in ranges)
                    out.append((uid, at & 0x1FFF, first + to_mark - high, first + to_mark - low + SPAN))
        start = end
    return out


def _equal_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the windows that contexts share; rows come in order of their leading tokens."""
    names = ["uid", "bits", "s", "e"]
    held: list[tuple] = []
    for batch in batches:
        held += zip(*(batch.column(c).to_pylist() for c in ("lead", "uid", "at", "bytes")), strict=True)
        out, start = [], 0
        for end in range(1, len(held)):
            if held[end][0] != held[end - 1][0]:
                if end - start > 1:
                    out += shared_spans([r[1:] for r in held[start:end]])
                start = end
        # The last leading string's rows may go on in the next batch.
        held = held[start:]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names)
    if len(held) > 1 and (out := shared_spans([r[1:] for r in held])):
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names)


_SPANS = "uid long, bits long, s long, e long"


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, lead = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "lead"))
        row, k, key = _windows(at, batch.column("bytes").to_pylist(), lead)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(batch.column("uid").to_numpy(zero_copy_only=False)[row]), pa.array(at[row] & 0x1FFF), pa.array(((at[row] >> 31) & 0xFFFFFFFF) + k)], ["key", "uid", "bits", "s"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(uid, bits, s, e): byte spans made of windows that start elsewhere too; bits are the low 13 of the id."""
    base = keyed(docs)
    rows = cut(base.mapInArrow(_mark_rows, "lead long, ctx long, uid long, at long"))
    twice = cut(rows.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi")).where("n > 1").select("lead", "n", (F.col("lo") < F.col("hi")).alias("differ")))
    marks_in = twice.agg(F.sum("n")).first()[0] or 0
    shared = cut(join_hot(rows, twice, ["lead"], "n", marks_in).drop("n"))
    classes = cut(shared.groupBy("lead", "ctx").agg(F.count(F.lit(1)).alias("n"), F.first("differ").alias("differ"), F.min(F.struct("uid", "at")).alias("one")))
    bits = F.col("at").bitwiseAND(F.lit(0x1FFF))
    first = F.shiftrightunsigned("at", 31).bitwiseAND(F.lit(0xFFFFFFFF))
    more = F.shiftright("at", 13).bitwiseAND(F.lit(511))
    whole = join_hot(shared.select("lead", "ctx", "uid", "at"), classes.where("n > 1").select("lead", "ctx", "n"), ["lead", "ctx"], "n", marks_in)
    whole = whole.select("uid", bits.alias("bits"), first.alias("s"), (first + more + SPAN).alias("e"))
    # Contexts are compared only where one of a group is single and another differs from it.
    edges = classes.where("differ")
    groups = cut(edges.groupBy("lead").agg(F.count(F.lit(1)).alias("g"), F.min("n").alias("least")).where("least = 1").select("lead", "g", (F.col("g") > GROUP).alias("large")))
    wanted = join_hot(edges.select("lead", "one"), groups, ["lead"], "g", marks_in).select("lead", F.col("one.uid").alias("uid"), F.col("one.at").alias("at"), "large")
    asked = wanted.groupBy("uid").agg(F.collect_list(F.struct("lead", "uid", "at", "large")).alias("want"))
    zipped = base.mapInArrow(_zipped, "uid long, did long, z binary")
    fetched = zipped.join(asked.hint("shuffle_hash"), "uid").dropDuplicates(["uid"]).select("z", "want").mapInArrow(_contexts, "token long, token2 long, lead long, uid long, at long, bytes binary, large boolean")
    fetched = cut(fetched)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Splitters are sampled over the leading tokens; a group of equal ones is whole in its bucket, so no two buckets share a window.
    buckets = fetched.where("not large").repartitionByRange(parts, "token", "token2").sortWithinPartitions("token", "token2", "lead")
    near = buckets.mapInArrow(_equal_neighbours, _SPANS)
    windows = fetched.where("large").mapInArrow(_window_rows, "key long, uid long, bits long, s long")
    keys = cut(windows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    far = join_hot(windows, keys, ["key"], "n", keys.agg(F.sum("n")).first()[0] or 0).select("uid", "bits", "s", (F.col("s") + SPAN).alias("e"))
    return whole.unionByName(near).unionByName(far)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for did, z, spans in zip(batch.column("did").to_pylist(), batch.column("z"), batch.column("spans"), strict=True):
            text = zlib.decompress(z.as_py())
            kept, end, gone, runs = hashlib.sha256(), 0, 0, 0
            joined: list[list[int]] = []
            bits = (-1 if did is None else did) & 0x1FFF
            for s, e in sorted((x["s"], x["e"]) for x in spans.as_py() or [] if x["bits"] == bits):
                if joined and s <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], e)
                else:
                    joined.append([s, e])
            for s, e in joined:
                kept.update(text[end:s])
                end, gone, runs = e, gone + e - s, runs + 1
            kept.update(text[end:])
            for values, v in zip(out, (did, len(text), gone, runs, kept.hexdigest()), strict=True):
                values.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    arrow_limits(docs.sparkSession)
    # Rows repeated whole share a uid and find the same spans: a set, or each of n rows would meet n times its spans.
    spans = repeated_spans(docs).groupBy("uid").agg(F.collect_set(F.struct("bits", "s", "e")).alias("spans"))
    zipped = keyed(docs).mapInArrow(_zipped, "uid long, did long, z binary")
    both = zipped.join(spans, "uid", "left").select("did", "z", "spans")
    return both.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
