"""The pipeline's stages, each against what its operator decides by brute force."""

import hashlib
from collections import Counter

import corpus_pipeline as P
from test_operators import plain_components, plain_rules


def test_pipeline(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for k, (_name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf)
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.collect())
    quality, exact, near, mixed, packed = kept
    for r in quality:
        n = plain_rules(r["text"])
        assert n[0] >= 50 and 100 * n[4] <= 50 * n[0]
    last = {}
    for r in quality:
        h = hashlib.sha256(r["text"].encode().lower()).digest()
        last[h] = max(last.get(h, -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in exact) == sorted(last.values())
    want = plain_components([(r["doc_id"], r["text"]) for r in exact])
    assert sorted(r["doc_id"] for r in near) == sorted(i for i, w in want.items() if w[2])
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in near} and max(Counter(r["doc_id"] for r in mixed).values()) <= 2
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == Counter(r["doc_id"] for r in mixed)
    assert sum(r["length"] for r in packed) / (2048 * len({r["sequence_id"] for r in packed})) > 0.95


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, _row int, skey string"


def prose(k, n=60):
    return " ".join(f"word{(k * 7919 + j * 31) % 10_000_019}" for j in range(n))


def odd_rows():
    a, b = prose(1), prose(2)
    rows = [(1, None), (2, ""), (3, " \n "), (4, a), (4, a), (5, a.upper()), (6, a + " one more"), (7, b), (None, prose(3)), (None, None), (8, prose(4, 60_000)), (9, "few words"), (10, "same " * 80), (11, prose(5))]
    return [(i, t, None if k % 2 else "en", None if k % 3 else "s", None, "clash", 1, None) for k, (i, t) in enumerate(rows)]


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda i: (i is None, i))


def test_stages_on_odd_tables(spark, sf):
    odd, empty = spark.createDataFrame(odd_rows(), SCHEMA), spark.createDataFrame([], SCHEMA)
    stages = dict(P.STAGES)
    for name, stage in P.STAGES:
        assert stage(spark, empty, sf).collect() == [], name
    plain = odd.select(*P.COLUMNS)
    assert ids(stages["quality_rules"](spark, odd, sf)) == [4, 4, 5, 6, 7, 8, 11, None]
    exact = stages["exact_dedup"](spark, odd, sf)
    assert exact.columns == list(P.COLUMNS)
    # Of equal texts the largest id stays, once; null counts as empty and ranks below every id.
    assert ids(exact) == [2, 3, 5, 6, 7, 8, 9, 10, 11, None]
    near = ids(stages["near_dedup"](spark, odd, sf))
    # 4, 4, 5 and 6 are one group; texts without words stay, as do rows without id.
    assert near == [1, 2, 3, 4, 4, 7, 8, 9, 10, 11, None, None]
    mixed = stages["mixing"](spark, odd, sf)
    assert mixed.columns == plain.columns and set(ids(mixed)) <= set(ids(odd))
    packed = stages["packing"](spark, odd, sf).collect()
    assert sum(r["start"] == 0 for r in packed) == odd.count()


def test_run_on_an_odd_table(spark, tmp_path):
    spark.createDataFrame(odd_rows(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    rows = P.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} <= {5, 6, 7, 8, 11, None} and {7, 8, 11} & {r["doc_id"] for r in rows}
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert P.run(spark, str(tmp_path / "none")).collect() == []
