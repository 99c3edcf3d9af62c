"""Literal fixtures with known results, and invariants."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from quillrank.functions import dates, identity, text
from quillrank.functions.vectors import unit, valid
from quillrank.operators import aggregates as A
from quillrank.operators import joins as J
from quillrank.operators import merge as M
from quillrank.operators import windows as W
from quillrank.plans import evaluation, graph, ranking, serving
from quillrank.sources import feeds
from quillrank.streaming import events as S


def scored(spark, reads, candidates, **how):
    r = spark.createDataFrame([(i, f"t{i}", a, float(x), None, v) for i, a, x, v in reads], "id long, identity string, author string, rating double, day date, vec array<double>")
    c = spark.createDataFrame([(i, f"t{i}", a, v, 1.0, 1.0) for i, a, v in candidates], "id long, identity string, author string, vec array<double>, source_weight double, confidence double")
    return {x["id"]: x["score"] for x in ranking.score_candidates(r, c, **how).collect()}


def test_scorer_goldens(spark):
    assert scored(spark, [], [(10, "New", [1.0, 0.0])]) == {10: 54.0}
    assert scored(spark, [(1, "Writer", 3, [1.0, 0.0])], [(10, "New", [1.0, 0.0])]) == {10: 54.0}
    assert scored(spark, [(1, "Writer", 5, [1.0, 0.0]), (2, "Writer", 1, [1.0, 0.0])], [(10, "Writer", [1.0, 0.0])]) == {10: 66.0}
    assert scored(spark, [(1, "Loved", 5, [1e300, 0.0])], [(2, "New", [1e300, 0.0])]) == {2: 97.0}
    two = scored(spark, [(1, "A", 5, [1.0, 0.0]), (2, "B", 1, [0.0, 1.0])], [(3, "C", [1.0, 0.0]), (4, "D", [0.0, 1.0])])
    assert two == {3: 97.1, 4: 10.9}


def test_kernel_weighs_dominant_and_diffuse_neighbours(spark):
    def vectors(first, rest):
        out = []
        for k in range(40):
            v = [0.0] * 101
            s = first if k == 0 else rest
            v[0], v[k + 1] = s, (1 - s * s) ** 0.5
            out.append(v)
        return out + [[float(j == 41 + k) for j in range(101)] for k in range(60)]

    query = [(1000, "Unseen", [1.0] + [0.0] * 100)]
    reads = lambda vs: [(k, f"a{k}", 5 if k < 40 else 3, v) for k, v in enumerate(vs)]
    assert scored(spark, reads(vectors(1.0, 0.25)), query) == {1000: 81.0}
    assert scored(spark, reads(vectors(0.5, 0.5)), query) == {1000: 83.7}


def test_leave_one_out_is_removal_and_blocks_agree(spark, monkeypatch):
    reads = [(k, f"a{k % 3}", 1 + k % 5, [float((k * 7) % 5) - 2, float(k % 4), 1.0]) for k in range(30)]
    loo = scored(spark, reads, [(4, "a1", reads[4][3])], leave_one_out=True)
    assert loo == scored(spark, [r for r in reads if r[0] != 4], [(4, "a1", reads[4][3])])
    whole = scored(spark, reads, [(99, "a1", [1.0, 2.0, 3.0])])
    monkeypatch.setattr(ranking.near_reads, "__defaults__", (False, 7))
    assert scored(spark, reads, [(99, "a1", [1.0, 2.0, 3.0])]) == whole


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],)], "v array<double>")
    rows = df.select(unit(F.col("v")).alias("u"), valid(F.col("v"), 2).alias("ok")).collect()
    assert [round(x, 9) for x in rows[0]["u"]] == [0.6, 0.8] and rows[1]["u"] == [0.0, 0.0] and [r["ok"] for r in rows] == [True, True, False]


def test_text_and_identity(spark):
    one = lambda c, **k: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(text.normalize_key(F.lit("The  Left-Hand"), F.lit("U. K. LeGuin"))) == "the left hand u k leguin"
    assert one(text.isbn13(F.lit("0-306-40615-2"))) == "9780306406157" and one(text.isbn13(F.lit("9780306406158"))) is None and one(text.isbn13(F.lit("080442957X"))) == "9780804429573"
    assert one(identity.author_key(F.lit("R. F. Kuang Jr."))) == "rf kuang"
    assert one(identity.title_key(F.lit("Dune (Dune Chronicles, #1)"))) == "dune"
    assert set(one(identity.title_keys(F.lit("1984")))) == {"1984", "nineteen eighty four"}
    assert "the left hand of darkness" in one(identity.title_keys(F.lit("The Left Hand of Darkness: A Novel"))) and "left hand of darkness" in one(identity.title_keys(F.lit("The Left Hand of Darkness: A Novel")))
    assert one(identity.title_keys(F.lit("Dune: Messiah"))) == ["dune messiah"]
    assert one(text.subjects_of(F.lit(json.dumps(["Fiction", "<b>Fiction</b>", "123", "nyt:Fantasy", "x"])))) == ["Fiction", "Fantasy"]
    assert one(text.subjects_of(F.lit("not json"))) == ["not json"]
    assert one(text.redacted(F.lit("GET https://a.b/secret?k=1 failed"))) == "GET https://a.b failed"
    df = spark.createDataFrame([("ﬁn Straße",)], "t string")
    assert df.select(text.canonical_part("t").alias("x")).first()["x"] == "fin strasse"


def test_dates(spark):
    raw = ["2024-03-05", "2024/03/05", "Tue, 05 Mar 2024 10:00:00 +0000", "2024-03-05T23:00:00-05:00", "nope"]
    rows = spark.createDataFrame([(x,) for x in raw], "d string").select(dates.read_day(F.col("d")).alias("x"), dates.day_precision(F.col("d")).alias("p")).collect()
    assert [r["x"] for r in rows] == [dt.date(2024, 3, 5)] * 3 + [dt.date(2024, 3, 6), None] and [r["p"] for r in rows] == [True, True, False, False, False]


def test_auc_vectors(spark):
    auc = lambda rows: A.rank_auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()["auc"]
    assert auc([(1, 4.0), (1, 3.0), (0, 2.0), (0, 1.0)]) == 1 and auc([(0, 4.0), (0, 3.0), (1, 2.0), (1, 1.0)]) == 0 and auc([(0, 1.0), (1, 1.0), (0, 1.0), (1, 1.0)]) == 0.5


# What an identity must and must not tell apart: (title, author, title, author, equal identities, matching works).
IDENTITIES = [
    ("Yellowface", "R.F. Kuang", "Yellowface", "R. F. Kuang", True, True),
    ("Dune Book 2", "Author", "Dune", "Author", False, False),
    ("Tales (Series, #1-3)", "Author", "Tales", "Author", False, False),
    ("Tales (Notebook 1)", "Author", "Tales", "Author", False, False),
    ("Tales (Book 1 of the Saga)", "Author", "Tales", "Author", False, False),
    ("Tales (Abridged)", "Author", "Tales", "Author", False, False),
    ("The Fifth Season", "N. K. Jemisin", "The Fifth Season", "N K Jemisin", True, True),
    ("The Expanse: Books, Book 1 (Unabridged)", "James Corey", "The Expanse", "James Corey", True, True),
    ("Book 1", "Author", "Book 2", "Author", False, False),
    ("MaddAddam (MaddAddam, #1)", "Margaret Atwood", "MaddAddam", "Margaret Atwood", True, True),
    ("Collected Tales (Books 1-3)", "Author", "Collected Tales", "Author", False, False),
    ("Ninth House (Alex Stern, Book 1)", "A", "Ninth House", "A", True, True),
    ("Dune 2", "Author", "Dune", "Author", False, False),
    ("Same Title", "Author A", "Same Title", "Author B", False, False),
    ("Slaughterhouse-Five", "Kurt Vonnegut", "Slaughterhouse 5", "Kurt Vonnegut Jr.", False, True),
    ("One", "Henry VI", "One", "Henry", False, True),
    ("One", "A. Person Jr. III", "One", "A Person", False, True),
    ("The Rise and Fall of the Third Reich", "William L. Shirer", "Rise and Fall of the Third Reich: A History of Nazi Germany", "William L. Shirer", False, True),
    ("The Rise and Fall of the Third Reich", "William L. Shirer", "The Rise and Fall of the Third Reich: A History of Nazi Germany", "William L. Shirer", False, True),
    ("The Dispossessed", "Ursula K. Le Guin", "The Dispossessed: An Ambiguous Utopia", "Ursula K. Le Guin", False, True),
    ("Biological War", "Annie Jacobsen", "Biological War: A Scenario", "Annie Jacobsen", False, True),
    ("Dune", "Frank Herbert", "Dune: Messiah", "Frank Herbert", False, False),
    ("The Hunger Games", "Suzanne Collins", "The Hunger Games: Catching Fire", "Suzanne Collins", False, False),
    ("The Lord of the Rings", "J. R. R. Tolkien", "The Lord of the Rings: The Two Towers", "J. R. R. Tolkien", False, False),
    ("The Left Hand of Darkness", "U", "Left Hand of Darkness", "U", False, True),
    ("Ｄｕｎｅ", "ＦＲＡＮＫ Straße", "Dune", "Frank Strasse", True, True),
    (None, None, "", "", True, False),
]


def test_identity_goldens(spark):
    """Columns and SQL have one set of rules, with the known matches and non-matches."""
    identity.register(spark)
    df = spark.createDataFrame([(k, *r[:4]) for k, r in enumerate(IDENTITIES)], "k int, a string, b string, c string, d string")
    df.createOrReplaceTempView("identity_goldens")
    columns = df.select("k", (identity.identity("a", "b") == identity.identity("c", "d")).alias("e"), F.arrays_overlap(identity.match_keys(F.col("a"), F.col("b")), identity.match_keys(F.col("c"), F.col("d"))).alias("m"))
    in_sql = spark.sql("SELECT k, book_identity(a, b) = book_identity(c, d) AS e, book_identity_matches(a, b, c, d) AS m FROM identity_goldens")
    for got in (columns, in_sql):
        assert {r["k"]: (r["e"], r["m"]) for r in got.collect()} == {k: r[4:] for k, r in enumerate(IDENTITIES)}


def test_canonical_keys_and_similarity_by_brute_force(spark, sf):
    """The Arrow functions, row by row."""
    import difflib
    import unicodedata

    from quillrank.queries import QUERIES

    parts = {r["p_partkey"]: r for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    fold = lambda x: " ".join(re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKC", x).casefold()).split())
    assert {r["id"]: r["key"] for r in QUERIES["canonical_keys"](spark, sf).collect()} == {k: fold(r["p_name"]) for k, r in parts.items()}
    for r in QUERIES["title_similarity"](spark, sf).collect():
        a, b = fold(parts[r["id"]]["p_name"]), fold(parts[r["id"]]["p_type"])
        words = {*a.split()}, {*b.split()}
        assert r["similarity"] == pytest.approx(max(len(words[0] & words[1]) / len(words[0] | words[1]), difflib.SequenceMatcher(None, a, b).ratio()), abs=1e-6)


def test_latest_before_on_a_hot_group(spark):
    """Equal times are not earlier; ties go by the further order; groups span ranges."""
    rng = __import__("random").Random(3)
    left = [(k, 1 if k % 3 else k % 7, rng.randint(0, 50)) for k in range(400)]
    right = [(k, 1 if k % 4 else k % 7, rng.randint(0, 50)) for k in range(300)]
    got = J.latest_before(spark.createDataFrame(left, "id long, g int, at int"), spark.createDataFrame(right, "rid long, g int, t int"), "g", "at", "t", ["t", "rid"])
    want = {i: max(((t, r) for r, h, t in right if h == g and t < at), default=None) for i, g, at in left}
    assert {r["id"]: (r["t"], r["rid"]) for r in got.collect()} == {i: w for i, w in want.items() if w}


def test_greedy_dedup_depends_on_what_was_kept(spark):
    items = spark.createDataFrame([(1, 0, 1, ["a"]), (2, 0, 2, ["a", "b"]), (3, 0, 3, ["b"])], "id long, block int, place int, keys array<string>")
    assert sorted(r["id"] for r in J.greedy_rounds(items, "id", [F.col("place")]).collect()) == [1, 3]


def test_merge_and_delete(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "y")], "id long, v string, w string")
    new = spark.createDataFrame([(2, "c", "z", 1), (2, "d", "q", 2), (3, "e", None, 1)], "id long, v string, w string, at int")
    got = sorted(tuple(r) for r in M.upsert(old, new, "id", "at", {"w": "fill"}).collect())
    assert got == [(1, "a", None), (2, "d", "y"), (3, "e", None)]
    rows = spark.createDataFrame([(1, "s", "new"), (2, "s", "new"), (3, "t", "new"), (4, "s", "saved")], "id long, src string, status string")
    scan = spark.createDataFrame([(1, "s")], "id long, src string")
    assert sorted(r["id"] for r in M.delete_missing(rows, scan, "id", "src", ["new"]).collect()) == [1, 3, 4]


def test_whole_day_split_keeps_days_together(spark):
    rows = spark.createDataFrame([(k, dt.date(2024, 1, 1 + k // 3)) for k in range(30)], "id long, day date")
    got = W.day_split(rows, "day", "id").groupBy("day").agg(F.count_distinct("split").alias("n")).agg(F.max("n").alias("m")).first()
    assert got["m"] == 1


def test_fatigue_goldens(spark):
    c = spark.createDataFrame([(1, 82.0, 1), (2, 80.0, 2), (3, 75.0, 3)], "id long, score double, pos int")
    days = spark.createDataFrame([(1, 5)], "id long, days long")
    got = serving.fatigued(c, days, grace=1, per_day=1.5, most=9.0).orderBy("position").collect()
    assert [(r["id"], r["new_score"]) for r in got] == [(2, 80.0), (1, 76.0), (3, 75.0)]
    assert [r["id"] for r in serving.fatigued(c, days.limit(0)).orderBy("position").collect()] == [1, 2, 3]


def test_slate_is_bounded(spark):
    page = spark.createDataFrame([(1, k, k, "same" if k < 4 else f"a{k}", 90.0 - k, [1.0, 0.0] if k < 4 else [float(k), 1.0]) for k in range(1, 13)], "run long, id long, pos int, author string, score double, vec array<double>")
    got = serving.diversified(page).collect()
    assert sorted(r["position"] for r in got) == list(range(1, 13)) and all(abs(r["position"] - r["pos"]) <= 3 for r in got) and any(r["position"] != r["pos"] for r in got)


def test_explore_logs_exact_propensities(spark):
    page = spark.createDataFrame([(run, run * 100 + k, k) for run in range(40) for k in range(1, 9)], "run long, id long, pos int")
    got = serving.explored(page, 0.4, 1).collect()
    assert all(0 < r["propensity"] <= 1 for r in got) and all(r["position"] == r["pos"] and r["propensity"] == 1 for r in got if r["pos"] <= 4)
    for run in range(40):
        assert sorted(r["position"] for r in got if r["run"] == run) == list(range(1, 9))
    moved = [r for r in got if r["position"] != r["pos"]]
    assert moved and all(r["propensity"] == pytest.approx(0.1) for r in moved)


def test_learner_ranks_saved_features(spark):
    rows = [(k, k, dt.datetime(2024, 1, 1), 1 if k <= 6 else 0, 1.0) for k in range(1, 13)]
    events = spark.createDataFrame(rows, "id long, book long, ts timestamp, label int, reliability double")
    obs = serving.latest_observations(events, F.lit("2024-01-01").cast("timestamp"))
    feats = obs.select("book", F.when(F.col("label") == 1, "subject:good").otherwise("subject:bad").alias("feature"))
    effects = {r["feature"]: r["effect"] for r in serving.feature_effects(obs, feats).collect()}
    assert effects == {"subject:good": 2.0, "subject:bad": -2.0}
    c = spark.createDataFrame([(101, 70.0, 1.0), (102, 70.0, 1.0)], "id long, score double, confidence double")
    f = spark.createDataFrame([(101, "subject:bad"), (102, "subject:good")], "id long, feature string")
    assert {r["id"]: r["new_score"] for r in serving.personalized(c, f, serving.feature_effects(obs, feats)).collect()} == {101: 68.0, 102: 72.0}


def test_semantic_part_is_the_shrunk_local_rate(spark):
    """Against loops over pairs: before and after 20 decided books, in blocks, with odd vectors, and behind the gates."""
    import numpy as np

    rng = np.random.default_rng(5)
    near = lambda: (np.array([1.0, 0.5, 0.2, 0.0]) + rng.normal(0, 0.6, 4)).tolist()
    observed = [(k, int(rng.random() < 0.4), 0.4 + (k % 4) / 5, near()) for k in range(40)]
    odd = [(100, 1, 9.0, [0.0] * 4), (101, 1, 9.0, [float("nan"), 1.0, 1.0, 1.0]), (102, 1, 9.0, [1.0, 1.0]), (103, 1, 9.0, None)]
    candidates = [(k, near()) for k in range(1, 60)] + [(90, [0.0] * 4), (91, [1.0]), (92, None), (93, [-1.0, -1.0, 0.0, 0.0])]
    c = spark.createDataFrame(candidates, "id long, vec array<double>")

    def got(rows, **how):
        o = spark.createDataFrame(rows, "book long, label int, weight double, vec array<double>")
        return {r["id"]: r["adjustment"] for r in serving.semantic_adjustments(o, c, **how).collect()}

    def want(rows):
        total, grown = sum(w for _, _, w, _ in rows), len(rows) >= 20
        rate = (sum(y * w for _, y, w, _ in rows) + 1) / (total + 2)
        out = {}
        for i, v in candidates:
            if v is None or len(v) != 4 or not any(v):
                continue
            ws = ps = 0.0
            for _, y, w, u in rows:
                sim = float(np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v))
                part = w * max(0, (sim - 0.52) / 0.48) ** 2 if grown and y else w * max(0, (sim - 0.45) / 0.55)
                ws, ps = ws + part, ps + part * y
            prior, most = (1.0, 5.0) if grown else (1.5, 4.0)
            x = max(-most, min(most, most * ((ps + prior * rate) / (ws + prior) - rate) / 0.5))
            if ws > 0 and abs(x) >= 0.05:
                out[i] = x
        return out

    for n in (12, 40):
        assert len(want(observed[:n])) > 20
        assert got(observed[:n] + odd) == pytest.approx(want(observed[:n]))
    assert got(observed, block_rows=7) == pytest.approx(want(observed))
    assert got(observed[:9]) == {} and got([(k, y, 0.4, v) for k, y, _, v in observed[:11]]) == {} and got([]) == {}
    base = spark.createDataFrame([(k, 50.0, 0.5) for k, _ in candidates], "id long, score double, confidence double")
    none = spark.createDataFrame([], "id long, feature string"), spark.createDataFrame([], "feature string, effect double")
    moved = serving.personalized(base, *none, spark.createDataFrame([(1, 5.0), (2, -4.0)], "id long, adjustment double"))
    assert {r["id"]: r["delta"] for r in moved.collect() if r["delta"]} == {1: 2.5, 2: -2.0}


def test_whole_tables_stand_beside_the_subsets(spark, sf):
    from quillrank.queries import QUERIES

    pages = QUERIES["outside_deltas"](spark, sf).collect()
    assert sorted(r["id"] for r in pages) == sorted(r[0] for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect())
    assert all(r["position"] <= 100 for r in pages)
    orders = {}
    for period, customer in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderpriority", "o_custkey").collect():
        orders.setdefault(period, set()).add(customer % 20)
    assert {r["period"]: r["ids"] for r in QUERIES["delivered_ids"](spark, sf).collect()} == {k: sorted(v) for k, v in orders.items()}


def test_whole_texts_stand_beside_the_prefixes(spark, tmp_path):
    from quillrank.queries import QUERIES

    same, few = "word " * 60, "one two " * 20
    rows = [(1, same + "left"), (2, same + "right"), (3, few + "three four five six seven eight nine")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    keys = {r["doc_id"]: r["key"] for r in QUERIES["plain_keys"](spark, str(tmp_path)).collect()}
    assert keys == dict(rows)
    labels = {r["doc_id"]: r["labels"] for r in QUERIES["subject_labels"](spark, str(tmp_path)).collect()}
    assert labels == {1: ["word", "left"], 2: ["word", "right"], 3: "one two three four five six seven eight".split()}


def test_neutral_event_erases(spark):
    events = spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 1), 1, 1.0), (2, 1, dt.datetime(2024, 1, 2), None, 1.0)], "id long, book long, ts timestamp, label int, reliability double")
    assert serving.latest_observations(events, F.lit("2024-01-03").cast("timestamp")).count() == 0


def test_graph_scores(spark):
    edges = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 11), (4, 12)], "work long, entity long")
    seeds = spark.createDataFrame([(1,)], "work long")
    assert {r["work"]: r["score"] for r in graph.one_hop(edges, seeds).collect()} == {2: 0.5}
    rank = {r["work"]: r["rank"] for r in graph.diffusion(edges, seeds).collect()}
    assert set(rank) == {2, 3} and rank[2] > rank[3] > 0


def test_promotion_and_bootstrap(spark):
    d = spark.createDataFrame([(30, 500, 0.02, 0.0, 0.02), (3, 500, 0.02, -0.1, None)], "runs int, impressions int, auc_delta double, precision_delta double, ndcg_delta double")
    assert [r["reasons"] for r in evaluation.promotion(d).collect()] == [[], ["too few runs", "precision", "ndcg"]]
    x = spark.createDataFrame([(k % 20, int(k % 3 == 0), float((k * 7) % 11)) for k in range(400)], "run long, y int, s double")
    r = evaluation.cluster_bootstrap(x, "run", "y", "s", replicas=50).first()
    assert r["replicas"] == 50 and r["low"] <= r["middle"] <= r["high"]


PAGES = [
    ("u1", "application/json", json.dumps({"works": [{"title": "A", "authors": [{"name": "X"}], "subject": ["Fiction"], "first_publish_year": "1999"}, {"title": "", "authors": []}]})),
    ("u2", "application/json", json.dumps({"results": {"lists": [{"list_name": "Best", "books": [{"title": "B", "author": "Y", "primary_isbn13": "9780306406157"}]}]}})),
    ("u3", "application/json", json.dumps({"feed": {"results": [{"name": "C", "artistName": "Z", "releaseDate": "2024-05-01", "genres": [{"name": "SF"}]}]}})),
    ("u4", "text/html", '<script type="application/ld+json">{"@graph": [{"@type": ["Book"], "name": "D", "author": {"name": "W"}, "isbn": "0306406152", "genre": "Poetry"}]}</script>'),
    ("u5", "application/rss+xml", "<rss><channel><item><title>E</title><author_name>V</author_name><link>http://x</link></item><item><title></title></item></channel></rss>"),
    ("u6", "text/html", '<h3 class="book-title">F &amp; G</h3><span class="author-name">by U</span>'),
    ("u7", "text/html", "<h2><a href=x>H</a></h2><p>by T</p>"),
    ("u8", None, None),
]


def test_feeds(spark):
    pages = spark.createDataFrame(PAGES, "url string, content_type string, content string")
    got = {r["title"]: r for r in feeds.parse(pages).collect()}
    assert {t: r["author"] for t, r in got.items()} == {"A": "X", "B": "Y", "C": "Z", "D": "W", "E": "V", "F & G": "U", "H": "T"}
    assert got["A"]["release"]["kind"] == "year" and got["B"]["isbn"] == "9780306406157" and got["C"]["genres"] == ["SF"]
    merged = feeds.merged(feeds.parse(pages.unionByName(pages.withColumn("url", F.concat(F.lit("z"), "url")))))
    assert merged.count() == 7
    assert {r["title"] for r in feeds.filtered(feeds.parse(pages), ["sf"], []).collect()} == {"C"}
    assert "C" not in {r["title"] for r in feeds.filtered(feeds.parse(pages), [], ["sf"]).collect()}


def test_reading_history(spark, tmp_path):
    (tmp_path / "h.csv").write_text('Title,Author,My Rating,Date Read,Date Added,Exclusive Shelf,ISBN,ISBN13\nA,X,5,2024/01/02,,read,"=""0306406152""",\nB,Y,0,,2024/02/03,to-read,,\n')
    lines = spark.read.csv(str(tmp_path / "h.csv"), header=True, escape='"')
    got = [tuple(r) for r in feeds.reading_history(lines).orderBy("title").collect()]
    assert got == [("A", "X", 5, "2024/01/02", "9780306406157", "read"), ("B", "Y", None, "2024/02/03", None, "to-read")]
    with pytest.raises(Exception, match="bad rating"):
        feeds.reading_history(lines.withColumn("My Rating", F.lit("seven"))).collect()


def test_json_sink(spark, tmp_path):
    feeds.write_json(spark.createDataFrame([(1, "x")], "b int, a string"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()[0] == '{"a":"x","b":1}'


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("k1", 1, t0, "save"), ("k1", 1, t0, "save"), ("k2", 1, t0 + dt.timedelta(minutes=1), "undo"), ("k3", 2, t0, "reject")]
    spark.createDataFrame(rows, "event_key string, book long, ts timestamp, action string").write.parquet(str(tmp_path / "in"))
    source = lambda: S.stream(spark, str(tmp_path / "in"), "event_key string, book long, ts timestamp, action string")
    assert S.run_to_end(S.once(source()), "once", str(tmp_path / "c1")).count() == 3
    first = {r["book"]: r["visible_at"] for r in S.run_to_end(S.first_visible(source(), ["book"]), "first", str(tmp_path / "c2"), "complete").collect()}
    assert first == {1: t0, 2: t0}
    last = {r["book"]: r["decision"] for r in S.run_to_end(S.decisions(S.once(source())), "decided", str(tmp_path / "c3"), "update").collect()}
    assert last == {1: None, 2: "reject"}
    write = S.merge_into(spark, str(tmp_path / "out"), "book", "ts", {})
    for epoch, label in enumerate((1.0, 0.75)):
        batch = spark.createDataFrame([(1, t0, label)], "book long, ts timestamp, label double")
        write(batch, epoch)
        write(batch, epoch)  # a retry changes nothing
    assert [r["label"] for r in spark.read.parquet(str(tmp_path / "out/v1")).collect()] == [0.75]


def test_editorial_lists():
    page = """<h2>News</h2><h3>The <a href="https://shop.example/1">First</a> and <a href="https://shop.example/2">Second</a> <a href="https://shop.example/2">Book</a> edited by A. Person and B. Other (October 7th)</h3>
    <h3><a href="https://own.example/x">Own</a> by Us</h3><h4><a href="https://shop.example/3">No byline</a></h4><h4><a href="https://shop.example/4">Last</a> by C. D., translated by E. F.</h4>"""
    got = list(feeds.editorial_items(page, "https://own.example/2023/list", ("own.example",)))
    assert got == [
        {"title": "The First", "author": "A. Person and B. Other", "link": "https://shop.example/1", "released": "2023-10-07"},
        {"title": "The Second Book", "author": "A. Person and B. Other", "link": "https://shop.example/2", "released": "2023-10-07"},
        {"title": "Last", "author": "C. D.", "link": "https://shop.example/4", "released": None},
    ]


def test_shelf_addresses(spark):
    one = lambda u, s: spark.range(1).select(feeds.shelf_url(F.lit(u), s).alias("u")).first()["u"]
    assert one("https://a.b/rss/1?key=k&shelf=read", "to-read") == "https://a.b/rss/1?key=k&shelf=to-read"
    assert one("https://a.b/rss/1", "currently-reading") == "https://a.b/rss/1?shelf=currently-reading"
    with pytest.raises(ValueError):
        feeds.shelf_url(F.lit("x"), "read")
