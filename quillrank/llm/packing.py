"""Best-fit packing of tokenized documents by bulk-synchronous rounds.

Documents longer than a sequence are cut; pieces over half a sequence open one each.
Then every round works on all unplaced pieces and all gaps at once:

1. pieces and gaps are brought in order of size, each row ranked within its size;
2. a sweep from large to small finds for every piece its successor, the smallest gap
   that holds it and that no larger piece takes (gaps opened last are taken first, as
   brackets close); it runs over the counts per size, of which there are as many as a
   sequence has tokens, whatever the data;
3. pieces of one size that want gaps of one size are told apart by rank and joined to
   gaps by (size, rank);
4. gaps shrink by what they took, and the next round begins; when most pieces find no
   gap, they get as many new sequences as their tokens fill.

Ranks are made in salted parts whose counts give the offsets, so a size that a third of
all pieces have is ranked by many tasks; there are more parts the more pieces there are.

Null text has no tokens but the end mark; null ids stay null; repeated rows are packed
each on their own; pieces that tie in size are told apart by a number of their row; a
very long text is encoded in one task, in memory a few times its length; other columns
are ignored, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.llm.common import ROWS_PER_TASK, arrow_limits, few, whole_text
from quillrank.session import cut

LENGTH, END_ID = 2048, 0
#: Parts in which one size is ranked, from few to many rows. The driver holds a count per size and part, half a million at most.
SALTS = (8, 256)
#: New sequences are opened once a round would place less than this share of the pieces that find no gap.
OPEN_BELOW = 0.3
#: Characters for which the pre-tokenizer below surely agrees with the tokenizer's own.
_PLAIN = "\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ‐-‧‰-⁞€"
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteTokens:
    """Text -> ids as little-endian uint32 bytes.

    Texts of plain characters go through a byte-pair encoder over the same vocabulary,
    which is several times faster; all others, and texts with an added token's literal, go
    to the tokenizer itself.
    """

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.plain = regex.compile(f"[{_PLAIN}]*+")
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        # Byte-level vocabularies write a byte as a printable character: itself, or one from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(printable)))}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if all(c in byte_of for c in token) and not token.startswith("<|")}
        self.encoder = tiktoken.Encoding("bytes", pat_str=_WORD, mergeable_ranks=ranks, special_tokens={})

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: str) -> bytes:
        if not self.plain.fullmatch(text) or any(t in text for t in self.added):
            return self._encode(text)
        return np.array(self.encoder.encode_ordinary(text), "<u4").tobytes()


_PIECES = "did long, piece int, start long, length long, crc long"


def pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH) -> DataFrame:
    """did, piece, start, length and crc of each piece's ids; the first piece of a cut document may be shorter."""
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ByteTokens(tokenizer_path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for did, text in zip(batch.column("did").to_pylist(), batch.column("body"), strict=True):
                ids = memoryview(tokens.of(text.as_py()) + end)
                n = len(ids) // 4
                first = n % length or length if n > length else n
                at, k = 0, 0
                while at < n:
                    m = first if not at else length
                    out.append((did, k, at, m, zlib.crc32(ids[4 * at : 4 * (at + m)])))
                    at, k = at + m, k + 1
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["did", "piece", "start", "length", "crc"])

    return docs.select(F.col("doc_id").cast("long").alias("did"), whole_text().alias("body")).mapInArrow(run, _PIECES)


def counts_of(rows: DataFrame, size: str, key: str, salts: int) -> list[tuple[int, int, int]]:
    """(size, salt, rows): at most LENGTH * salts entries, whatever the data."""
    return [tuple(r) for r in rows.groupBy(size, _salt(key, salts).alias("salt")).count().collect()]


def _salt(key: str, salts: int):
    return F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")


def ranked(rows: DataFrame, size: str, key: str, counts: list[tuple[int, int, int]], salts: int) -> DataFrame:
    """``rows`` with their rank (from 0) among the rows of their size, without one task per size."""
    offsets, last, at = [], None, 0
    for s, salt, n in sorted(counts):
        at = at if s == last else 0
        offsets.append((s, salt, at))
        last, at = s, at + n
    table = F.broadcast(rows.sparkSession.createDataFrame(offsets, f"{size} int, salt int, o long"))
    inside = Window.partitionBy(size, "salt").orderBy(key)
    numbered = rows.withColumn("salt", _salt(key, salts)).withColumn("r", F.row_number().over(inside) - 1)
    return numbered.join(table, [size, "salt"]).withColumn("rank", F.col("r") + F.col("o")).drop("salt", "r", "o")


def sweep(want: dict[int, int], have: dict[int, int]) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int]]:
    """Match counts of pieces by size with counts of gaps by size.

    Returns (piece size, first rank, ranks, gap size, first gap rank) runs, and per
    piece size how many ranks (the lowest) found no gap. From large to small, gaps of a
    size open and pieces of that size close those opened last, so each piece takes the
    smallest gap still open.
    """
    open_: list[list[int]] = []  # gap size, first rank still free, number free
    runs, left = [], {}
    for size in sorted({*want, *have}, reverse=True):
        if n := have.get(size):
            open_.append([size, 0, n])
        n = want.get(size, 0)
        while n and open_:
            gap, first, free = open_[-1]
            m = min(n, free)
            runs.append((size, n - m, m, gap, first))
            n -= m
            if m == free:
                open_.pop()
            else:
                open_[-1] = [gap, first + m, free - m]
        if n:
            left[size] = n
    return runs, left


def pack(lengths: DataFrame, rows: int, length: int = LENGTH) -> DataFrame:
    """(pid, length) -> (pid, seq, place): a sequence and a gapless place in it for every piece.

    Sequences opened by a large piece carry its pid, those opened empty a negative number.
    """
    spark = lengths.sparkSession
    lengths = few(lengths, rows)
    half = length // 2
    big = F.col("length") > half
    done = [lengths.where(big).select("pid", F.col("pid").alias("seq"), F.lit(0).cast("long").alias("place"))]
    gaps = lengths.where(big & (F.col("length") < length)).select(F.col("pid").alias("seq"), (length - F.col("length")).cast("int").alias("gap"))
    todo = lengths.where(~big).select("pid", F.col("length").cast("int").alias("size"))
    opened = 0
    salts = min(SALTS[1], max(SALTS[0], rows // ROWS_PER_TASK))
    while wanted := counts_of(todo, "size", "pid", salts):
        want = _by_size(wanted)
        gaps = gaps.where(F.col("gap") >= min(want))
        held = counts_of(gaps, "gap", "seq", salts)
        runs, left = sweep(want, _by_size(held))
        if sum(r[2] for r in runs) < OPEN_BELOW * sum(left.values()):
            # Most find no gap: as many new sequences as their tokens fill.
            new = -(-sum(s * n for s, n in left.items()) // length)
            gaps = gaps.unionByName(few(spark.range(opened + 1, opened + new + 1), new).select((-F.col("id")).alias("seq"), F.lit(length).alias("gap")))
            opened += new
            held = counts_of(gaps, "gap", "seq", salts)
            runs, left = sweep(want, _by_size(held))
        n_todo, n_gaps = sum(want.values()), sum(n for _, _, n in held)
        # At most as many runs as there are sizes of pieces and of gaps together.
        plan = F.broadcast(spark.createDataFrame(runs, "size int, at long, n long, gap int, g long"))
        r = few(ranked(todo, "size", "pid", wanted, salts), n_todo)
        met = r.join(plan, (r["size"] == plan["size"]) & (r["rank"] >= plan["at"]) & (r["rank"] < plan["at"] + plan["n"]), "left")
        met = cut(met.select("pid", r["size"], plan["gap"], (plan["g"] + r["rank"] - plan["at"]).alias("grank")))
        g = few(ranked(gaps, "gap", "seq", held, salts).withColumnRenamed("rank", "grank"), n_gaps)
        taken = cut(few(g.join(met.where("gap is not null"), ["gap", "grank"], "left").select("seq", "gap", "pid", "size"), n_gaps))
        done.append(taken.where("pid is not null").select("pid", "seq", (length - F.col("gap")).cast("long").alias("place")))
        gaps = taken.select("seq", (F.col("gap") - F.coalesce("size", F.lit(0))).cast("int").alias("gap")).where("gap > 0")
        todo = met.where("gap is null").select("pid", "size")
        if not left:
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _by_size(counts: list[tuple[int, int, int]]) -> dict[int, int]:
    out: dict[int, int] = {}
    for s, _, n in counts:
        out[s] = out.get(s, 0) + n
    return out


def packed(docs: DataFrame, tokenizer_path: str, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    every = cut(pieces(docs, tokenizer_path, length).withColumn("pid", F.monotonically_increasing_id()))
    places = pack(every.select("pid", "length"), every.count(), length)
    return every.join(places, "pid").select(
        F.col("did").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("seq").alias("sequence_id"), F.col("place").alias("offset")
    )
