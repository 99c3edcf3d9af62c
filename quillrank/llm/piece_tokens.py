"""Encoding with a sentence-piece model that keeps the place of every piece, and decoding.

A text is normalized by the model's compiled character map, a double-array trie: at every
place the longest key that begins there is replaced, a character without a key stands for
itself, a byte that begins no character becomes U+FFFD. Every normalized byte records
the source byte it came from. Pairs are merged by the model's scores, best first, ties
from the left; characters without a piece fall back to bytes. The widths of the pieces,
summed over the normalized bytes and looked up in the record, are their spans in the
source's bytes: a piece begins where the one before it ends. The mark that the model puts
before a text comes from no source byte, so a piece of that mark alone is empty.

No piece holds a space after another character, nor some characters beside any other, so
a text falls apart there into chunks that are merged alone. Chunks of up to KEPT_BYTES
are kept, CHUNKS at most a task and then forgotten, so memory is bounded and each word
is merged about once. A longer chunk costs its length times its logarithm.

The model file is read by each task from a path that all executors have. Models other
than pair merging with byte fallback, or with symbols defined by the user, raise.

Null text is empty and gets the begin and end ids alone; null ids stay null; rows are
treated each on their own, so ties and repeated rows need nothing; a very long text is
one row of a task, in memory some 30 times its length; other columns are ignored, whatever
their names; no rows give no rows.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import arrow_limits, buffers, slices, whole_text

#: Chunks kept by a task, and the longest that is.
CHUNKS, KEPT_BYTES = 200_000, 64
SPACE, UNKNOWN = "▁", "�".encode()
_NONE = 1 << 31  # a rank above all
_NORMAL, _UNK, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_CHARACTER = re.compile(rb"[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialized message's fields."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (message[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if message[i - 1] < 128:
                return value, i

    i = 0
    while i < len(message):
        key, i = number(i)
        if key & 7 == 0:
            value, i = number(i)
        else:
            n, i = number(i) if key & 7 == 2 else ({5: 4, 1: 8}[key & 7], i)
            value, i = message[i : i + n], i + n
        yield key >> 3, value


class CharacterMap:
    """The compiled map: a double-array trie of keys, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = memoryview(blob[4 : 4 + size]).cast("I").tolist() if blob else []
        self.values = blob[4 + size :]
        # Runs of ASCII that surely stand for themselves: no key is such a character or begins with two of them.
        self.plain = re.compile(rb"(?:[%s](?![\x80-\xff]))+" % re.escape(bytes(b for b in range(128) if self._stands(b)))) if self.units else None

    def _stands(self, first: int) -> bool:
        return not self.longest(bytes([first]), 0)[1] and not any(self._walks(first, second) for second in range(128))

    def _walks(self, *key: int) -> bool:
        at = self._child(0)
        for c in key:
            at ^= c
            if at >= len(self.units) or self.units[at] & 0x800000FF != c:
                return False
            at ^= self._child(at)
        return True

    def _child(self, at: int) -> int:
        unit = self.units[at]
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, i: int) -> tuple[bytes, int]:
        """What the longest key at ``i`` is replaced by, and its length; length 0 without a key."""
        if not self.units:
            return b"", 0
        units, at, found, length = self.units, self._child(0), -1, 0
        for k in range(i, len(data)):
            at ^= data[k]
            unit = units[at] if at < len(units) else 0x80000000
            if unit & 0x800000FF != data[k]:
                break
            at ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                found, length = units[at] & 0x7FFFFFFF, k + 1 - i
        return (self.values[found : self.values.index(b"\0", found)], length) if length else (b"", 0)


class PieceModel:
    def __init__(self, data: bytes):
        pieces, trainer, normalizer = [], {}, {}
        for number, value in fields(data):
            if number == 1:
                pieces.append({1: b"", 2: b"\0\0\0\0", 3: _NORMAL} | dict(fields(value)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        kinds = [p[3] for p in pieces]
        names = [p[1].decode() for p in pieces]
        if trainer.get(3, 1) != 2 or not trainer.get(35) or trainer.get(24) or _USER in kinds or _UNUSED in kinds or not normalizer.get(5, 1):
            raise ValueError("only pair-merging models with byte fallback, marks before words and no symbols defined by the user")
        self.map = CharacterMap(normalizer.get(2, b""))
        self.mark_first, self.trim = bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1))
        self.ids = {n: i for i, n in enumerate(names) if kinds[i] == _NORMAL}
        self.scores = {n: -struct.unpack("<f", pieces[i][2])[0] for n, i in self.ids.items()}
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(len(names)) if kinds[i] == _BYTE}
        self.begin, self.end = (names.index(trainer.get(k, default).decode()) for k, default in ((46, b"<s>"), (47, b"</s>")))
        unknown = trainer.get(44, " ⁇ ".encode())
        shown = {_CONTROL: lambda n: b"", _UNK: lambda n: unknown, _BYTE: lambda n: bytes([int(n[3:5], 16)]), _NORMAL: lambda n: n.replace(SPACE, " ").encode()}
        self.surface = [shown[k](n) for n, k in zip(names, kinds, strict=True)]
        self.kinds, self.controls = kinds, [i for i, k in enumerate(kinds) if k == _CONTROL]
        self.marked = [k == _NORMAL and n.startswith(SPACE) for n, k in zip(names, kinds, strict=True)]
        self.cut, self.cut_marks = self._chunk_patterns()
        self._pair_tables()
        self._forget()

    def _chunk_patterns(self) -> tuple[re.Pattern, re.Pattern]:
        """Where texts fall apart: the second pattern is for texts that hold the mark's own character."""
        together = [p for p in self.ids if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in together):
            return re.compile(rb"(?s).+"), re.compile(rb"(?s).+")
        beside = set().union(*together)
        alone = bytes(b for b in range(128) if b != 32 and chr(b) not in beside)
        letters = re.compile("[A-Za-z]").match
        other = bytes(b for b in range(128) if b != 32 and b not in alone and not letters(chr(b)))
        pairs = {(x, y) for p in together for x, y in zip(p, p[1:], strict=False)}
        if any(x < "\x80" and y < "\x80" and bool(letters(x)) != bool(letters(y)) for x, y in pairs):
            words = rb" *[^ %s]+" % re.escape(alone) if alone else rb" *[^ ]+"
        else:  # no piece holds an ASCII letter beside another ASCII character, but both may stand beside others
            run = rb"(?:[A-Za-z]+|[%s]+)" % re.escape(other)
            words = rb" *(?:%s(?:[\x80-\xff]+%s?)*|(?:[\x80-\xff]+%s?)+)" % (run, run, run)
        single = rb"|[%s]" % re.escape(alone) if alone else b""
        return re.compile(words + single + rb"| +"), re.compile(rb"(?: |\xe2\x96\x81)*(?:(?!\xe2\x96\x81)[^ ])+|(?: |\xe2\x96\x81)+")

    def _pair_tables(self) -> None:
        """Every pair of symbols that makes a piece, in order of its code, with that piece's id and rank."""
        characters = {c for p in self.ids for c in p}
        bare = {c: len(self.surface) + k for k, c in enumerate(sorted(characters - self.ids.keys()))}
        symbols = self.ids | bare
        self.symbols = len(self.surface) + len(bare)
        self.of_byte = np.array([self.byte_ids[b] for b in range(256)])
        self.of_code = np.full(0x110000, -1, np.int64)
        for c in characters:
            self.of_code[ord(c)] = symbols[c]
        order = {x: k for k, x in enumerate(sorted(set(self.scores.values())))}
        rows = [(symbols[p[:k]] * self.symbols + symbols[p[k:]], i, order[self.scores[p]]) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        table = np.array(sorted(rows), np.int64).reshape(-1, 3)
        self.pair_codes, self.pair_ids, self.pair_ranks = (np.ascontiguousarray(c) for c in table.T)

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.start, self.count, self.flat, self.widths = array("q"), array("q"), array("I"), array("I")

    # Normalization.

    def normalize(self, raw: bytes) -> tuple[bytes, np.ndarray | None]:
        """Normalized bytes (spaces not yet marks) and the source byte of each, with one more for the end; None: each its own."""
        if not self.map.units and not self.trim:
            try:
                raw.decode()
                return raw, None
            except UnicodeDecodeError:
                pass
        out, source, i, after_space = bytearray(), [], 0, self.trim
        while i < len(raw):
            run = self.map.plain.match(raw, i) if self.map.plain and not self.trim else None
            if run:
                out += run[0]
                source.extend(range(i, run.end()))
                i = run.end()
                continue
            put, n = self.map.longest(raw, i)
            if not n:
                one = _CHARACTER.match(raw, i)
                put, n = (one[0], len(one[0])) if one else (UNKNOWN, 1)
                at = range(i, i + n) if one else [i] * 3
            else:
                at = [i] * len(put)
            if self.trim:
                lead = len(put) - len(put.lstrip(b" ")) if after_space else 0
                put, at = put[lead:], at[lead:]
                after_space = put.endswith(b" ") if put else after_space
            out += put
            source.extend(at)
            i += n
        if self.trim:
            kept = len(out.rstrip(b" "))
            end = source[kept] if kept < len(source) else len(raw)
            out, source = out[:kept], source[:kept] + [end]
        else:
            source.append(len(raw))
        return bytes(out), np.array(source, np.int64)

    # Merging.

    def merged(self, chunk: bytes) -> tuple[list[int], list[int]]:
        """Ids of a chunk's pieces and how many of its bytes each takes."""
        source = chunk.decode()
        parts: list[str | None] = list(source.replace(" ", SPACE))
        wide = [len(c.encode()) for c in source]
        n, scores = len(parts), self.scores
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (score := scores.get(both := parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (score, a, b, both))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or after[a] != b or len(parts[a]) + len(parts[b]) != len(both):
                continue
            parts[a], parts[b] = both, None
            wide[a] += wide[b]
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        ids, widths, k = [], [], 0
        while k < n:
            found = self.ids.get(parts[k])
            if found is not None:
                ids.append(found)
                widths.append(wide[k])
            else:
                encoded = parts[k].encode()
                ids.extend(self.byte_ids[b] for b in encoded)
                widths.extend([1] * wide[k] + [0] * (len(encoded) - wide[k]))
            k = after[k]
        return ids, widths

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of the piece that two symbols make (_NONE without one), and its id."""
        if not len(self.pair_codes):
            return np.full(len(left), _NONE), left
        code = left * self.symbols + right
        at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        there = (self.pair_codes[at] == code) & (left >= 0) & (right >= 0)
        return np.where(there, self.pair_ranks[at], _NONE), self.pair_ids[at]

    def merged_together(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many pieces each chunk has, then what ``merged`` gives of all in one row: one merge of every chunk a round, all at once."""
        texts = [c.decode() for c in chunks]
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        wide = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        codes = np.where(codes == 32, ord(SPACE), codes)
        symbol = self.of_code[codes]
        chunk = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        code, done = codes.astype(np.int64), []
        rank, made = self._ranked(symbol[:-1], symbol[1:])
        rank, made = np.append(rank, _NONE), np.append(made, 0)
        rank[np.flatnonzero(chunk[1:] != chunk[:-1])] = _NONE
        while len(symbol):
            first = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
            n = len(symbol)
            best = np.minimum.reduceat(rank * n + np.arange(n), first)
            ended = best >= _NONE * n
            if ended.any():
                gone = np.repeat(ended, np.diff(np.append(first, n)))
                done.append((chunk[gone], symbol[gone], code[gone], wide[gone]))
                stay = ~gone
                # A chunk goes whole, so no pair that stays loses its neighbour.
                chunk, symbol, code, wide, rank, made = (x[stay] for x in (chunk, symbol, code, wide, rank, made))
                if not len(symbol):
                    break
                shift = np.cumsum(gone)
                at = best[~ended] % n
                at = at - shift[at]
            else:
                at = best % n
            symbol[at] = made[at]
            wide[at] += wide[at + 1]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            chunk, symbol, code, wide, rank, made = (x[keep] for x in (chunk, symbol, code, wide, rank, made))
            at = at - np.arange(len(at))  # one symbol before each went per earlier chunk
            for left in (at[at > 0] - 1, at[at < len(symbol) - 1]):
                new, into = self._ranked(symbol[left], symbol[left + 1])
                rank[left], made[left] = np.where(chunk[left] == chunk[left + 1], new, _NONE), into
            if at[-1] == len(symbol) - 1:
                rank[-1] = _NONE
        columns = [np.concatenate(c) for c in zip(*done, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        chunk, symbol, code, wide = (c[order] for c in columns)
        known = (symbol >= 0) & (symbol < len(self.surface))
        encoded = np.frombuffer("".join(map(chr, code[~known].tolist())).encode(), np.uint8)
        size = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        times = np.where(known, 1, size)
        ids, widths, as_bytes = np.repeat(symbol, times), np.repeat(np.where(known, wide, 1), times), np.repeat(~known, times)
        ids[as_bytes] = self.of_byte[encoded]
        # A space without a piece is one source byte behind three of the mark's.
        nth = np.arange(len(ids)) - np.repeat(np.cumsum(times) - times, times)
        widths[as_bytes & (nth >= np.repeat(wide, times))] = 0
        return np.bincount(np.repeat(chunk, times), minlength=len(chunks)), ids, widths

    def _place(self, chunks: list[bytes]) -> None:
        """Merge chunks that aren't known yet and keep them."""
        short = [c for c in chunks if len(c) <= KEPT_BYTES]
        if short:
            count, ids, widths = self.merged_together(short)
            start = len(self.flat) + np.cumsum(count) - count
            self.known.update(zip(short, range(len(self.start), len(self.start) + len(short)), strict=True))
            for kept, new, kind in ((self.start, start, np.int64), (self.count, count, np.int64), (self.flat, ids, np.uint32), (self.widths, widths, np.uint32)):
                kept.frombytes(new.astype(kind).tobytes())
        for chunk in chunks:
            if len(chunk) > KEPT_BYTES:
                ids, widths = self.merged(chunk)
                self.known[chunk] = len(self.start)
                self.start.append(len(self.flat))
                self.count.append(len(ids))
                self.flat.extend(ids)
                self.widths.extend(widths)

    def encode(self, raws: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids with begin and end, and where each piece ends in the source's bytes."""
        chunks, sources, at = [], [], [0]
        for raw in raws:
            body, source = self.normalize(raw)
            if body and self.mark_first:
                body = b" " + body
            chunks += (self.cut_marks if b"\xe2\x96\x81" in body else self.cut).findall(body)
            sources.append(source)
            at.append(len(chunks))
        new = [c for c in dict.fromkeys(chunks) if c not in self.known]
        if new:
            self._place(new)
        which = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        start, count, flat, widths = (np.frombuffer(a, t) for a, t in ((self.start, np.int64), (self.count, np.int64), (self.flat, np.uint32), (self.widths, np.uint32)))
        n = count[which]
        total = np.append(0, np.cumsum(n))
        pick = np.repeat(start[which] - total[:-1], n) + np.arange(total[-1])
        every, wide = flat[pick], widths[pick].astype(np.int64)
        del start, count, flat, widths
        for chunk in new:
            if len(chunk) > KEPT_BYTES:
                del self.known[chunk]
        if len(self.start) >= CHUNKS or len(self.flat) > 16 * CHUNKS:
            self._forget()
        out = []
        for k, source in enumerate(sources):
            i, j = total[at[k]], total[at[k + 1]]
            ids, ends = np.empty(j - i + 2, np.uint32), np.zeros(j - i + 2, np.uint32)
            ids[0], ids[1:-1], ids[-1] = self.begin, every[i:j], self.end
            if j > i:
                inside = np.maximum(np.cumsum(wide[i:j]) - self.mark_first, 0)
                ends[1:-1] = inside if source is None else source[inside]
                ends[-1] = ends[-2]
            out.append((ids, ends))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks are spaces, the first mark goes, bytes that make no character are U+FFFD each."""
        runs = [ids]
        if any(c in ids[1:-1] for c in self.controls):  # bytes on two sides of a control id are no character together
            runs = [list(run) for control, run in groupby(ids, lambda i: self.kinds[i] == _CONTROL) if not control]
        shown = [b"".join(map(self.surface.__getitem__, run)) for run in runs]
        if runs and (self.mark_first or self.trim):
            strip = 0
            for i in runs[0]:
                if self.kinds[i] == _CONTROL:
                    continue
                strip += self.marked[i]
                if not self.trim or self.surface[i] != b" ":
                    break
            shown[0] = shown[0][strip:]
        return "".join(map(self._mended, shown))

    @staticmethod
    def _mended(shown: bytes) -> str:
        try:
            return shown.decode()
        except UnicodeDecodeError:
            pass
        out, i = [], 0
        while i < len(shown):
            one = _CHARACTER.match(shown, i)
            out.append(one[0].decode() if one else "�")
            i += len(one[0]) if one else 1
        return "".join(out)


@lru_cache(maxsize=2)
def model_of(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel(f.read())


_KIND = "doc_id long, ids binary, ends binary, decoded string"


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32 bits each), ends (alike: where each piece ends in the source's bytes) and the decoded text."""
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_path)
        names = [c.split()[0] for c in _KIND.split(", ")]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.string()]
        for batch in batches:
            dids, bodies = batch.column("did"), batch.column("body")
            for i, j in slices(buffers(bodies)[1]):
                found = model.encode(bodies.slice(i, j - i).to_pylist())
                ids, ends = ([x[k].astype("<u4", copy=False).tobytes() for x in found] for k in range(2))
                columns = [dids.slice(i, j - i), ids, ends, [model.decode(x[0].tolist()) for x in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("did"), whole_text().cast("binary").alias("body")).mapInArrow(run, _KIND)


def pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per piece: doc_id, place, id, and its span [start, end) in the source's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for did, ids, ends in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                end = np.frombuffer(ends, "<u4").astype(np.int64)
                n = len(end)
                columns = [pa.array([did] * n, pa.int64()), pa.array(np.arange(n)), pa.array(np.frombuffer(ids, "<u4").astype(np.int32)), pa.array(np.concatenate([[0], end[:-1]])), pa.array(end)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "id", "start", "end"])

    return encoded(docs, model_path).select("doc_id", "ids", "ends").mapInArrow(run, "doc_id long, place long, id int, start long, end long")
