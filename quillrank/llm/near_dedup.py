"""Near-duplicate components by a multi-index Hamming join over b-bit MinHash signatures.

A document's set of five-word shingles gets a signature of 48 symbols of 16 bits, cut
into 12 chunks of 4. If two signatures differ in at most 23 symbols, some chunk differs
in at most one (pigeonhole: 12 chunks with two errors each make 24), so indexing every
chunk under each of its four "all but one symbol" keys meets every such pair. (At a
similarity of 0.75 a pair is missed with a chance of 1e-7: all 12 chunks need two
errors.) Every link is confirmed on the full sets; the signature decides nothing.

Pairs inside a key's bucket are never expanded:
* equal sets are one class from the start;
* in each bucket the members are compared with its smallest member only (a star);
* then only buckets that still hold several components are looked at. Components with
  members near each other there form a cluster, told by spanning edges; a cluster's
  texts come together, and its members of different components are compared until they
  are joined or all compared. So components are those of the full link graph.
A bucket or a cluster too large for a task is cut into blocks, and every block is taken
with every other (and itself) in a task of its own: each pair still meets, and a task
holds two blocks whatever the size of the group. Only links that join components are
put out, never the pairs of a group. Rows of a hot key are dealt over tasks by a salt.

Rows without words have no set and link with nothing; rows with a null id too (their
component is null, they are kept). Rows that share an id are one document, with the
component of any of them. Null text counts as empty. Ties and repeated rows: equal sets
are one class, named by its smallest id. A very long text is one row of a task, in
memory a few dozen times its length. Other columns are ignored, whatever their names.
No rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import U64, arrow_limits, buffers, few, join_hot, keyed, mix, slices
from quillrank.llm.shingles import shared, shingle_sets
from quillrank.session import cut

#: Fixed value: linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
CHUNKS, CHUNK = 12, 4
SYMBOLS = CHUNKS * CHUNK
#: Symbols by which a pair compared after the stars may differ (a linked pair differs in more with a chance of 3e-7).
MAX_DISTANCE = 27
#: Members of a block of a bucket, and of a cluster (whose texts come along); and members dealt to a task.
BUCKET, CLUSTER, TASK = 4096, 4096, 2048
#: Links of which a task makes a forest (in memory about a hundred bytes each).
LINKS = 1_000_000

_rng = np.random.default_rng(48)
_A = (_rng.integers(0, 1 << 31, SYMBOLS) * 2 + 1).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, SYMBOLS).astype(np.uint32)


def signature(hashes: np.ndarray) -> np.ndarray:
    """16-bit symbols of the minima of SYMBOLS hash functions over a set."""
    x = (hashes >> U64(32)).astype(np.uint32)
    low = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (x[i : i + 2048, None] * _A + _B).min(axis=0), out=low)
    return (mix(low.astype(U64)) & U64(0xFFFF)).astype("<u2")


_SETS = "uid long, did long, n long, s1 long, s2 long, sig binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = buffers(batch.column("body"))
        n, s1, s2, sig = [], [], [], []
        for i, j in slices(at):
            for s in shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i]):
                n.append(len(s))
                s1.append(s.sum(dtype=U64))
                s2.append(mix(s ^ U64(0x1234567)).sum(dtype=U64))
                sig.append(signature(s).tobytes() if len(s) else None)
        longs = lambda x: pa.array(np.array(x, U64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("did"), pa.array(n, pa.int64()), longs(s1), longs(s2), pa.array(sig, pa.binary())], ["uid", "did", "n", "s1", "s2", "sig"])


def _chunk_keys(sig) -> list:
    """A key per chunk and symbol left out."""
    keys = []
    for c in range(CHUNKS):
        for out in range(CHUNK):
            at = [F.substring(sig, 2 * (c * CHUNK + k) + 1, 2) for k in range(CHUNK) if k != out]
            keys.append(F.xxhash64(F.lit(c * CHUNK + out), *at))
    return keys


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        z = [zlib.compress(t, 1) for t in batch.column("body").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(z, pa.binary())], ["id", "z"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among pairs with both texts. Rows of a left member come together, so its set is made once."""
    last, last_set = None, None
    for batch in batches:
        ok = []
        texts = [zlib.decompress(z) for z in batch.column("zb").to_pylist()]
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        data = np.frombuffer(b"".join(texts), np.uint8)
        sets = [s for i, j in slices(at) for s in shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i])]
        for a, za, b in zip(batch.column("a").to_pylist(), batch.column("za"), sets, strict=True):
            if a != last:
                t = np.frombuffer(zlib.decompress(za.as_py()), np.uint8)
                last, last_set = a, shingle_sets(t, np.array([0, len(t)]))[0]
            both = shared(last_set, b)
            ok.append(100 * both >= PERCENT * (len(last_set) + len(b) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok)], ["a", "b", "ok"])


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) -> (a, b, ok), with ``texts`` (id, z) of all members."""
    x, y = texts.select(F.col("id").alias("a"), F.col("z").alias("za")), texts.select(F.col("id").alias("b"), F.col("z").alias("zb"))
    both = pairs.join(y, "b").join(x, "a").select("a", "za", "b", "zb")
    return cut(both.mapInArrow(_confirm, "a long, b long, ok boolean"))


def _lowest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of links (a, b) and for each the smallest id reachable by them."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while len(x):
        # Labels are roots here: each root hooks to the lowest that a link shows it, then all jump to their roots.
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (next_ := label[label])).any():
            label = next_
        x, y = label[x], label[y]
        x, y = x[x != y], y[x != y]
    return ids, ids[label]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each id of a task's links and the smallest id that these links reach from it."""
    parts = [[batch.column(c).to_numpy() for c in ("a", "b")] for batch in batches]
    if parts:
        ids, comp = _lowest(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        for i in range(0, len(ids), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 100_000]), pa.array(comp[i : i + 100_000])], ["id", "comp"])


def components(links: DataFrame) -> DataFrame:
    """(a, b) links, materialized -> (id, comp): the smallest id reachable, for every id in a link.

    Each task replaces its links by stars on their smallest id; if they are one task's, that
    is the result. Else rounds over the stars join those of different tasks: each takes the
    smallest label among neighbours, for its old label too, then jumps to that label's label.
    A round costs the driver several jobs with their tasks and plans, so small tables get none.
    """
    tasks = max(1, -(-links.count() // LINKS))
    stars = cut(links.select("a", "b").coalesce(tasks).mapInArrow(_forest, "id long, comp long"))
    if tasks == 1:
        return stars
    links = stars.where("id != comp").select(F.col("id").alias("a"), F.col("comp").alias("b"))
    arcs = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    n = arcs.count()
    arcs = few(arcs, n)
    labels = cut(few(arcs.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), n))
    while True:
        near = few(arcs.join(labels.withColumnRenamed("id", "b"), "b").select("a", "comp"), n).groupBy("a").agg(F.min("comp").alias("m"))
        hooked = few(labels.join(near, labels["id"] == near["a"]).select("id", "comp", F.least("comp", "m").alias("new")), n)
        # What an id finds its old label finds too, or a long chain would take as many rounds as it has ids.
        told = hooked.unionByName(hooked.select(F.col("comp").alias("id"), F.lit(None).cast("long").alias("comp"), "new"))
        hooked = few(told.groupBy("id").agg(F.max("comp").alias("comp"), F.min("new").alias("new")), n)
        jump = labels.select(F.col("id").alias("new"), F.col("comp").alias("jumped"))
        step = cut(few(hooked.join(jump, "new").select("id", "comp", F.least("new", "jumped").alias("next")), n))
        moved = step.where(F.col("next") != F.col("comp")).limit(1).count()
        labels = step.select("id", F.col("next").alias("comp"))
        if not moved:
            return labels


def _symbols(sigs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), "<u2").reshape(len(sigs), SYMBOLS)


class _Sets(dict):
    """Disjoint sets over whatever is asked for."""

    def __missing__(self, x):
        return x

    def root(self, x):
        while (y := self[x]) != x:
            self[x] = self[y]
            x = y
        return x

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self[max(x, y)] = min(x, y)
        return True


def _others(group: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """Each row with the rows near it that stand in another component.

    A group is two blocks of a bucket or cluster, or one block taken with itself; rows
    are in order of component. Of two blocks only pairs across them are looked at.
    """
    comp, sig, block = group["comp"].to_numpy(), _symbols(group["sig"]), group["block"].to_numpy()
    low, high = group["lo"].iat[0], group["hi"].iat[0]
    one = low == high
    mine, theirs = np.flatnonzero(block == low), np.flatnonzero(block == high)
    their_comp, their_sig = comp[theirs], sig[theirs]
    for i in mine.tolist():
        # Within one block a pair is looked at once: with the rows of later components.
        a, b = (0 if one else np.searchsorted(their_comp, comp[i])), np.searchsorted(their_comp, comp[i], side="right")
        parts = [(b, len(theirs))] if one else [(0, a), (b, len(theirs))]
        for x, y in parts:
            if x < y:
                near = theirs[x + np.flatnonzero(np.count_nonzero(their_sig[x:y] != sig[i], axis=1) <= MAX_DISTANCE)]
                if len(near):
                    yield i, near


def _near_components(group: pd.DataFrame) -> pd.DataFrame:
    """Spanning edges between components that have near members in two blocks of a bucket."""
    group = group.sort_values("comp", ignore_index=True)
    comp, sets, out = group["comp"].to_numpy(), _Sets(), []
    for i, near in _others(group):
        for c in np.unique(comp[near]).tolist():
            if sets.join(int(comp[i]), c):
                out.append((int(comp[i]), c))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _solve(group: pd.DataFrame) -> pd.DataFrame:
    """Links that join the components of two blocks of a cluster, from the full sets of their members."""
    group = group.sort_values(["comp", "id"], ignore_index=True)
    ids, comp = group["id"].to_numpy(), group["comp"].to_numpy()
    made: dict[int, np.ndarray] = {}

    def full(i: int) -> np.ndarray:
        if i not in made:
            text = np.frombuffer(zlib.decompress(group["z"].iat[i]), np.uint8)
            made[i] = shingle_sets(text, np.array([0, len(text)]))[0]
        return made[i]

    sets, out = _Sets(), []
    for i, near in _others(group):
        for k in near.tolist():
            if sets.root(int(comp[i])) != sets.root(int(comp[k])):
                both = shared(full(i), full(k))
                if 100 * both >= PERCENT * (len(full(i)) + len(full(k)) - both):
                    sets.join(int(comp[i]), int(comp[k]))
                    out.append((int(ids[i]), int(ids[k])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def block_pairs(members: DataFrame, by: str, most: int) -> DataFrame:
    """Members of each group (column ``by``) in blocks of about ``most``, each block paired with every other and itself.

    Adds block, lo and hi: rows of one (``by``, lo, hi) are compared in one task. Any two
    members of a group meet in exactly one of these, whatever the size of the group.
    """
    sizes = members.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("blocks"))
    cast = members.join(sizes, by).withColumn("block", F.pmod(F.xxhash64("id", F.lit(by)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return cast.withColumn("other", other).select(*members.columns, "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))


def _dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """Groups dealt to tasks of about TASK members; a given number of partitions is not coalesced by their few bytes."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-n // TASK)), *keys)


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) that have the classes' components; of those by stars, id by smallest id.

    ``classes`` has (id, uid, sig), one row per distinct set.
    """
    index = classes.select("id", F.explode(F.array(*_chunk_keys(F.col("sig")))).alias("key"))
    shared_keys = cut(index.groupBy("key").agg(F.min("id").alias("lowest"), F.max("id").alias("highest"), F.count(F.lit(1)).alias("g")).where(F.col("lowest") < F.col("highest")).drop("highest"))
    entries = shared_keys.agg(F.sum("g")).first()[0] or 0
    members = cut(join_hot(index, shared_keys, ["key"], "g", entries).select("key", "id", "lowest", "g"))
    wanted = members.select("id").distinct().join(classes.select("id", "uid"), "id")
    base = keyed(docs)
    texts = base.join(wanted.hint("shuffle_hash"), (base["uid"] == wanted["uid"]) & (base["did"] == wanted["id"])).select("id", "body")
    texts = cut(texts.mapInArrow(_packed_texts, "id long, z binary").dropDuplicates(["id"]))
    stars = members.where(F.col("id") != F.col("lowest")).select(F.col("lowest").alias("a"), F.col("id").alias("b")).distinct()
    found = confirm(stars, texts).where("ok").select("a", "b")
    labels = components(found)
    # Only buckets with a pair that no star has compared are looked at again.
    now = members.where("g > 2").join(labels, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    mixed = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("g")).where("lo < hi").select("key", "g")
    active = cut(join_hot(now, cut(mixed), ["key"], "g", entries).join(classes.select("id", "sig"), "id").select("key", "id", "comp", "sig"))
    met = block_pairs(active, "key", BUCKET)
    clusters = components(cut(_dealt(met, active.count(), "key", "lo", "hi").groupBy("key", "lo", "hi").applyInPandas(_near_components, "a long, b long")))
    clusters = clusters.select(F.col("id").alias("comp"), F.col("comp").alias("cluster"))
    placed = cut(active.select("id", "comp", "sig").dropDuplicates(["id"]).join(clusters, "comp"))
    parts = block_pairs(placed, "cluster", CLUSTER).join(texts, "id")
    solved = _dealt(parts, placed.count(), "cluster", "lo", "hi").groupBy("cluster", "lo", "hi").applyInPandas(_solve, "a long, b long")
    # The stars' labels stand for the links found: the same components from fewer rows and tasks.
    return labels.select(F.col("comp").alias("a"), F.col("id").alias("b")).unionByName(cut(solved))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    arrow_limits(docs.sparkSession)
    sets = cut(keyed(docs).mapInArrow(_sets, _SETS))
    real = sets.where("n > 0 and did is not null")
    classes = cut(real.groupBy("s1", "s2").agg(F.min(F.struct("did", "uid", "sig")).alias("r")).select("s1", "s2", F.col("r.did").alias("id"), F.col("r.uid").alias("uid"), F.col("r.sig").alias("sig")))
    labels = components(links(docs, classes))
    reps = classes.join(labels, "id", "left").select("s1", "s2", F.coalesce("comp", "id").alias("comp"))
    placed = sets.join(reps, ["s1", "s2"], "left")
    component = F.when(F.col("did").isNull(), F.lit(None).cast("long")).when(F.col("n") > 0, F.col("comp")).otherwise(F.col("did"))
    return placed.select(F.col("did").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("_of"), F.struct(*docs.columns).alias("_row"))
    return rows.join(kept, F.col("_of").eqNullSafe(F.col("_id")), "left_semi").select("_row.*")
