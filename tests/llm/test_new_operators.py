"""Operators 11 to 13 against brute force, and on odd tables."""

import hashlib
import random
import re
import time
from collections import Counter
from itertools import permutations
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece

from quillrank.llm import exact_dedup, filter_audit, piece_tokens, secrets, substring_dedup, vector_codes
from quillrank.llm import queries as Q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, did long, body string, kind int, part string, mask int, digest string, key long, bare boolean, n long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and columns with clashing names."""
    t = 'Call A$B "é" ' * 3
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "Lorem ipsum dolor " * 4000), (5, "LOREM " * 20000), (6, t), (6, t), (None, t), (None, None), (9, "one two"), (9, t), (11, "x" * 5000)]
    return spark.createDataFrame([(i, x, None, None if k % 2 else "s", None, 7, 7, "b", 1, "p", 3, "d", 5, True, 9) for k, (i, x) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


# 11


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """Every round a full search, in Python integers where numpy's could overflow."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return {}, None
    width = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    ints = [[int(np.floor(1024 * float(x))) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    w = width // parts
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, ints[k]))[:entries]
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(ints[k], p) for k in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (far(part(v, p), books[p][e]), e)) for p in range(parts)] for v in ints]

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [part(v, p) for v, c in zip(ints, codes, strict=True) if c[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    codes = assign()
    errors = [sum(far(part(v, p), books[p][c[p]]) for p in range(parts)) for v, c in zip(ints, codes, strict=True)]
    by_label = Counter()
    for (_, _, label), error in zip(kept, errors, strict=True):
        by_label[label] += error
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{x:02x}" for x in c), e, by_label[label], sha) for (i, _, label), c, e in zip(kept, codes, errors, strict=True)), sha


def codes_of(df):
    return Counter(tuple(r) for r in vector_codes.codes(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


VECTORS = "vec_id long, embedding array<double>, label int, id long, ints string, codes int, n int, lab int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "i", 2, 3, 4) for i, v, label in rows], VECTORS)


def test_codes_of_clusters_equal_full_search(spark):
    """Clustered vectors, where most bounds hold; repeated rows, ties between entries, null labels, ids and vectors."""
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 1, (9, 8))
    rows = [(int(i), (centres[i % 9] + rng.normal(0, 0.05, 8)).tolist(), None if i % 7 == 0 else int(i % 3)) for i in rng.permutation(600)]
    rows += [(3, rows[5][1], 1), (3, rows[5][1], 1), (None, rows[8][1], 2), (700, None, 1), (701, [0.5, None] * 4, 1), (702, [float("nan")] * 8, 1), (703, [float("inf")] + [0.0] * 7, 1)]
    want, _ = plain_codes(rows)
    df = vectors(spark, rows)
    assert codes_of(df) == want
    searched = vector_codes.coded(df)[2]
    assert searched[0] == 4 * sum(want.values()) and searched[-1] < searched[0]


def test_codes_on_a_grid_of_ties(spark):
    """Few distinct integers, so that distances tie all the time: the lower index has to win."""
    rng = np.random.default_rng(12)
    rows = [(i, (rng.integers(-2, 3, 4) / 1024).tolist(), 0) for i in range(900)]
    assert codes_of(vectors(spark, rows)) == plain_codes(rows)[0]


def test_codes_of_odd_vectors(spark):
    rows = [(1, [], None), (2, [0.25], 1), (3, [1.5, -2.25, 3.0, 4.0, -5.0, 0.001], 1), (4, [1000.0, -90000.5, 7.0], None)]
    assert codes_of(vectors(spark, rows)) == plain_codes(rows)[0]
    assert codes_of(vectors(spark, [(7, [], 1)])) == plain_codes([(7, [], 1)])[0]
    assert codes_of(vectors(spark, [(7, None, 1)])) == codes_of(vectors(spark, rows).limit(0)) == Counter()
    huge = vector_codes.codes(vectors(spark, [(1, [1e300, -1e300, 0.0, 1.0], 1), (2, [-1e300, 1e300, 0.0, 1.0], 1), (3, [3e38] * 4, 1)])).collect()
    assert {r["vec_id"]: (r["code"], r["error"]) for r in huge} == {1: ("00000000", 0), 2: ("01010000", 0), 3: ("00010202", 0)}


def test_distances_beyond_doubles_are_exact():
    a, b = np.array([[2**27, -(2**27)], [2**27 - 1, 5]]), np.array([[-(2**27), 2**27], [0, 1]])
    want = [[sum((int(x) - int(y)) ** 2 for x, y in zip(r, c, strict=True)) for c in b] for r in a]
    assert vector_codes.distances(a, b).tolist() == want


def test_bounds_hold_through_moves():
    """After any moves the bounds enclose the true distances wherever they weren't searched anew."""
    rng = np.random.default_rng(13)
    x, book = rng.integers(-300, 300, (500, 6)), rng.integers(-300, 300, (40, 6))
    code, upper, lower = vector_codes.scan(x, book)
    for _ in range(5):
        after = book + rng.integers(-9, 10, book.shape) * (rng.random((40, 1)) < 0.3)
        code, upper, lower, _ = vector_codes.reassign(x, book, after, code, upper, lower)
        book = after
        d = np.sqrt(((x[:, None] - book) ** 2).sum(-1))
        assert (code == ((x[:, None] - book) ** 2).sum(-1).argmin(1)).all()
        own = d[np.arange(500), code]
        d[np.arange(500), code] = np.inf
        assert (upper >= own).all() and (lower <= d.min(1)).all()


# 12


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def model():
    return piece_tokens.PieceModel(Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes())


def test_pieces_of_all_documents(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    got = {r["doc_id"]: r for r in Q.op12_piece_tokens(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert got[i]["bytes_spanned"] == len(text.encode())


ALPHABET = [*"  aab▁\t\n\x00　éé́ﬁ①😀日本語か <s>0123.,'\"«»”…", "▁▁", "the", " of", "<unk>", "⁇", "  ", "\r\n", "internationally"]


def random_texts(seed, n, alphabet=ALPHABET):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_pieces_of_random_texts_and_their_spans(library, model):
    texts = random_texts(12, 4000) + ["x" * 3000, " " * 300, "か" * 500, "▁" * 70 + " " * 70]
    for text, (ids, ends) in zip(texts, model.encode([t.encode() for t in texts]), strict=True):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == want and model.decode(want) == library.decode(want)
        raw, start = text.encode(), 0
        for i, end in zip(ids.tolist(), ends.tolist(), strict=True):
            shown = model.surface[i]
            # A piece's span holds its own bytes: the mark put before the text has none, and a literal mark is shown as a space.
            span = raw[start:end].replace("▁".encode(), b" ")
            assert span == shown or (start == 0 and b" " + span == shown)
            start = end
        assert start == len(raw)


def test_decode_of_any_ids(library, model):
    rng = random.Random(13)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(300), rng.randrange(32000), 28705, 259]) for _ in range(rng.randrange(12))]
        assert model.decode(ids) == library.decode(ids)


def test_bytes_that_make_no_character(model):
    raw = b"a\xff\xe2\x96 b\xed\xa0\x80"
    ids, ends = model.encode([raw])[0]
    assert model.decode(ids.tolist()) == "a�" + "�" * 2 + " b" + "�" * 3
    assert ends[-1] == len(raw)


COMPILED = Path(sentencepiece.__file__).parent / "package_data"


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"])
@pytest.mark.parametrize("trim", [False, True])
def test_character_maps(rule, trim, model):
    """Longest-prefix normalization by the library's own compiled maps, with a source place for every byte."""
    if not (COMPILED / f"{rule}.bin").exists():
        pytest.skip("the library has no compiled maps here")
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=trim)
    mine = piece_tokens.PieceModel.__new__(piece_tokens.PieceModel)
    mine.map, mine.trim = piece_tokens.CharacterMap((COMPILED / f"{rule}.bin").read_bytes()), trim
    wide = ALPHABET + [chr(c) for r in ((0x20, 0x17F), (0x300, 0x340), (0x2000, 0x2070), (0xFF00, 0xFF60), (0x1100, 0x1120), (0xAC00, 0xAC20)) for c in range(*r)]
    for text in random_texts(14, 1500, wide):
        raw = text.encode()
        out, source = mine.normalize(raw)
        assert out.decode() == theirs.normalize(text)
        assert len(source) == len(out) + 1 and (np.diff(source) >= 0).all() and source[-1] <= len(raw)
    out, source = mine.normalize("ﬁ ①x".encode())
    assert out == b"fi 1x" and source.tolist() == [0, 0, 3, 4, 7, 8]


def test_pieces_of_odd_tables(spark, odd, no_docs, library):
    got = piece_tokens.encoded(odd, Q.piece_model_path()).collect()
    rows = odd.collect()
    want = Counter((r["doc_id"], np.array(library.encode(r["text"] or "", add_bos=True, add_eos=True), "<u4").tobytes()) for r in rows)
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    assert piece_tokens.encoded(no_docs, Q.piece_model_path()).collect() == []
    one = sorted((r["place"], r["id"], r["start"], r["end"]) for r in piece_tokens.pieces(odd.where("text = 'one two'"), Q.piece_model_path()).collect())
    assert [library.id_to_piece(r[1]) for r in one] == ["<s>", "▁one", "▁two", "</s>"] and [r[2:] for r in one] == [(0, 0), (0, 3), (3, 7), (7, 7)]


def test_chunks_are_forgotten(monkeypatch, library):
    monkeypatch.setattr(piece_tokens, "CHUNKS", 20)
    small = piece_tokens.PieceModel(Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes())
    for text in random_texts(15, 200):
        assert small.encode([text.encode()])[0][0].tolist() == library.encode(text, add_bos=True, add_eos=True)
        assert len(small.known) <= 20 + 40


# 13


def plain_audit(rows, labels):
    """Every order, step and document on its own."""
    said = {k: {i for i, *v in labels if i is not None and v[k] == 1} for k in range(2)}
    docs = []
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        fails["E"] = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)
        docs.append((source or "", {f for f in fails if fails[f]}, i in said[0], i in said[1]))
    out = {}
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                n = Counter()
                for _, fails, good, toxic in (d for d in docs if d[0] == part):
                    before = fails & set(order[: step - 1])
                    here = f in fails and not before
                    n["kept"] += not before and f not in fails
                    n["removed"] += here
                    n["redundant"] += f in fails and bool(before)
                    n["unique_fails"] += fails == {f}
                    n["good_lost"] += here and good
                    n["toxic_lost"] += here and toxic
                out[part, "".join(order), step] = [n[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")]
    total = Counter()
    for (part, order, step), n in out.items():
        total[part, order[step - 1]] += n[1]
    return {k: (*n, total[k[0], k[1][k[2] - 1]]) for k, n in out.items()}


def audited(docs, labels):
    return {tuple(r[:3]): tuple(r[3:]) for r in filter_audit.audit(docs, labels).collect()}


def test_audit_of_odd_tables(spark, odd, no_docs):
    labels = [(6, 1, None), (6, None, 1), (9, 1, 1), (4, 0, 1), (None, 1, 1), (77, 1, 1), (2, None, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    assert audited(odd, table) == plain_audit(rows, labels)
    assert audited(odd, table.limit(0)) == plain_audit(rows, [])
    assert audited(no_docs, table) == {}


def test_audit_of_random_masks(spark):
    rng = random.Random(13)
    texts = [" ".join(rng.choice(["alpha", "beta", "GAMMA", "d#", "é", f"w{k}"]) for k in range(rng.choice([0, 20, 55]))) for _ in range(25)]
    rows = [(rng.randrange(150), rng.choice(texts), rng.choice(["s", "t", "", None])) for _ in range(220)]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 150, 2)]
    got = audited(spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got == plain_audit(rows, labels)


def test_incidence_matrices():
    m = filter_audit.incidence()
    assert all(m[k].shape == (32, 600) and m[k].dtype == np.int64 for k in filter_audit.OUTCOMES)
    # Each mask that fails a filter is removed or redundant there, and every mask is kept to the end or removed once in each order.
    assert (m["removed"] + m["redundant"] == [[(mask >> f) & 1 for f in m["filter"]] for mask in range(32)]).all()
    assert (m["removed"].reshape(32, 120, 5).sum(2) + m["kept"].reshape(32, 120, 5)[:, :, -1] == 1).all()


# Repeated rows in earlier operators.


def test_repeated_rows_cost_what_other_rows_cost(spark):
    """1,500 times the same row of 10 KB: every copy is covered by the others, in linear time."""
    text = " ".join(f"word{k * 7919 % 4099}" for k in range(1100))
    rows = spark.createDataFrame([(5, text)], "doc_id long, text string")
    many = rows.crossJoin(spark.range(1500)).select("doc_id", "text").repartition(8)
    began = time.perf_counter()
    got = substring_dedup.without_repeats(many).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    assert [tuple(r) for r in got] == [(5, len(text), len(text), 1, 1500)]
    assert time.perf_counter() - began < 600


def test_a_hot_digest_is_dealt(spark):
    """A text that a third of all rows have, under as many ids, beside others and a row repeated whole."""
    rows = [(i, "Same text" if i % 3 == 0 else f"text {i}") for i in range(6000)] + [(1, "text 1")] * 40 + [(None, "same TEXT")]
    got = {(r["doc_id"], r["copy"]): r for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert len(got) == 6041
    assert {got[i, 0]["group_size"] for i in range(0, 6000, 3)} == {2001} and {got[i, 0]["keep_id"] for i in range(0, 6000, 3)} == {5997}
    assert [got[1, k]["group_size"] for k in range(41)] == [41] * 41 and sum(r["kept"] for r in got.values()) == 4001


def test_keys_of_letters_alone(sf):
    """Random letters of both cases are found, names in one case or camel case are not; real texts give none."""
    rng, allowed = np.random.default_rng(31), secrets.allow_list()
    found = lambda text: list(secrets.entropy_spans(text, allowed))
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    for n, least in ((24, 0.78), (32, 0.92), (40, 0.96), (64, 0.99)):
        keys = ["".join(rng.choice(letters, n)) for _ in range(400)]
        assert np.mean([bool(found(f"key {k} end")) for k in keys]) >= least
    words = "settings user request handler factory service abstract context provider template resolver".split()
    for k in range(400):
        parts = [str(rng.choice(words)) for _ in range(5)]
        parts.insert(k % 6, ["XML", "HTTPS"][k % 2])
        camel = "".join(p if p.isupper() else p.capitalize() for p in parts)
        for name in (camel, camel[0].lower() + camel[1:], "".join(parts).lower(), "".join(parts).upper(), "_".join(p.capitalize() for p in parts), "iPhone" + camel):
            assert not found(name), name
    texts = [r["text"] or "" for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    assert not any(found(re.sub(r"[0-9]", " ", t)) for t in texts)
