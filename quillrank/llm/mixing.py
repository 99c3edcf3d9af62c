"""Mix sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents stand in a seeded permuted order cut into blocks. A source's
target gives whole passes over its blocks and a last part of a pass; the blocks of all
sources are then dealt to output shards by a tree: at each node the exact counts per
source are split in two by a multivariate hypergeometric draw, so every shard gets an
exact quota of disjoint blocks and shards mix sources as a random deal would. Inside a
shard documents stand in a seeded order.

The block in which a source's last pass ends is cut into finer blocks until few rows are
left in it, so a source with a third of all rows is never windowed by one task. Rows of
hot sources meet their source's figures in salted parts.

Sizes are words of the whole text, however long; a null source is a source of its own,
last in order; null text has size 0; repeated rows share one place in the order and are
taken alike; rows that tie in place are taken together; a source of size 0 gets target
0; other columns are ignored, whatever their names; no rows give no rows. Only figures
with one row per source are windowed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.llm.common import join_hot, whole_text
from quillrank.llm.quality_rules import words_in
from quillrank.session import cut

#: Fixed values of the mix.
WEIGHTS, SHARE, MAX_PASSES = (5.0, 2.0, 1.0), 1.5, 2.0
SEED, BLOCKS, SHARDS = 1729, 256, 16
#: Rows of a source's last block that are looked at one by one, and words of a slice of a shard.
EDGE_ROWS, SLICE_WORDS = 100_000, 1_500_000
_PLACE_BITS, _LEVEL_BITS = 62, 8


def _place(seed: int):
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    name = F.col("source").cast("string")
    key = F.when(name.isNull(), "n").otherwise(F.concat(F.lit("s"), name)).alias("skey")  # joins as any other value
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), name.alias("source"), key, F.size(words_in(whole_text())).cast("long").alias("size"), _place(seed).alias("place"))


def _fine(bits: int):
    """The block of a place when the order is cut into 2 ** bits equal ranges."""
    return F.shiftrightunsigned("place", 64 - bits)


def _block():
    return _fine(_LEVEL_BITS).cast("int")


def targets(per_source: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: float = MAX_PASSES) -> DataFrame:
    """source, source_size -> target. Water-filling: the excess over a source's limit is shared by weight.

    Sources reach their limit in order of limit per weight, so running sums over the
    table of sources give the final level at once.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    with_weight = per_source.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumn("limit", passes * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    left = F.greatest(F.lit(0.0), share * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    level = with_weight.withColumn("level", left / F.sum("w").over(onward))
    # The first source whose limit isn't reached fixes the level for all after it.
    first_free = F.min(F.when(F.col("limit") / F.col("w") >= F.col("level"), F.struct((F.col("limit") / F.col("w")).alias("k"), F.col("level")))).over(everything)["level"]
    return level.withColumn("target", F.least(F.col("limit"), F.coalesce(first_free * F.col("w"), F.col("limit")))).select("source", "source_size", "target")


def choices(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: float = MAX_PASSES) -> tuple[DataFrame, int]:
    """Per source: its rows, target, whole passes, the place up to which one more pass goes, and places that fill the rest; and all rows."""
    per_block = cut(rows.groupBy("skey", "source", _block().cast("long").alias("block")).agg(F.sum("size").alias("block_size"), F.count(F.lit(1)).alias("n")))
    per_source = per_block.groupBy("skey", "source").agg(F.sum("block_size").alias("source_size"), F.sum("n").alias("n_rows"))
    total = per_source.agg(F.sum("n_rows")).first()[0] or 0
    aims = targets(per_source.select("source", "source_size"), weights, share, passes).join(per_source.select(F.col("source").alias("_s"), "skey", "n_rows"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    aims = aims.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    aims = cut(aims.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))

    def edge_of(blocks: DataFrame, known: DataFrame) -> DataFrame:
        """The block in which each source's rest ends, with the words below it. ``known`` has skey, rest, below, n_rows."""
        running = Window.partitionBy("skey").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
        upto = blocks.join(known, "skey").withColumn("upto", F.col("below") + F.sum("block_size").over(running))
        found = upto.where("upto > rest").groupBy("skey", "rest", "n_rows").agg(F.min(F.struct("block", (F.col("upto") - F.col("block_size")).alias("below"), "n")).alias("e"))
        return cut(found.select("skey", "rest", "n_rows", F.col("e.block").alias("block"), F.col("e.below").alias("below"), F.col("e.n").alias("n")))

    bits = _LEVEL_BITS
    edge = edge_of(per_block.select("skey", "block", "block_size", "n"), aims.select("skey", "rest", F.lit(0).cast("long").alias("below"), "n_rows"))
    inside = rows.select("skey", "place", "size")
    while True:
        e = edge.select("skey", F.col("block").alias("_block"), "n_rows")
        inside = join_hot(inside, e, ["skey"], "n_rows", total).where(_fine(bits) == F.col("_block")).select("skey", "place", "size")
        if bits >= _PLACE_BITS or (edge.agg(F.max("n")).first()[0] or 0) <= EDGE_ROWS:
            break
        bits = min(bits + _LEVEL_BITS, _PLACE_BITS)
        inside = cut(inside)
        finer = inside.groupBy("skey", _fine(bits).alias("block")).agg(F.sum("size").alias("block_size"), F.count(F.lit(1)).alias("n"))
        edge = edge_of(finer, edge.select("skey", "rest", "below", "n_rows"))
    upto = Window.partitionBy("skey").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    one_by_one = inside.join(edge.select("skey", "rest", "below"), "skey").withColumn("upto", F.col("below") + F.sum("size").over(upto))
    cuts = one_by_one.groupBy("skey").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.struct("place", "upto"))).alias("c"))
    # All of the blocks before the edge, and of the edge the places up to the cut; ``from_`` is where the rest of the order begins.
    open_ = cut(edge.join(cuts, "skey", "left").select("skey", "n_rows", "block", F.col("c.place").alias("cut"), (F.col("rest") - F.coalesce("c.upto", "below")).alias("gap"), F.array().cast("array<long>").alias("fill")))
    edge_block, beyond_cut = F.col("block"), F.col("cut").isNull() | (F.col("place") > F.col("cut"))
    # The rest, less than the next document, goes to the largest documents that still fit.
    for _ in range(2):
        met = join_hot(rows.select("skey", "place", "size"), open_, ["skey"], "n_rows", total)
        beyond = met.where((F.col("size") > 0) & (F.col("size") <= F.col("gap")) & ((_fine(bits) > edge_block) | ((_fine(bits) == edge_block) & beyond_cut)) & ~F.array_contains("fill", F.col("place")))
        best = beyond.groupBy("skey").agg(F.max(F.struct("size", "place")).alias("b"))
        open_ = cut(open_.join(best, "skey", "left").select(
            "skey", "n_rows", "block", "cut", (F.col("gap") - F.coalesce("b.size", F.lit(0))).alias("gap"),
            F.when(F.col("b").isNull(), F.col("fill")).otherwise(F.array_append("fill", F.col("b.place"))).alias("fill"),
        ))
    plan = aims.join(open_.select("skey", F.col("block").alias("edge"), "cut", "fill"), "skey", "left")
    return plan.select("skey", "n_rows", "source_size", "target", "whole", "edge", F.lit(bits).alias("bits"), "cut", "fill"), total


def _copies():
    block = F.expr("shiftrightunsigned(place, 64 - bits)")
    more = (block < F.col("edge")) | ((block == F.col("edge")) & F.col("cut").isNotNull() & (F.col("place") <= F.col("cut"))) | F.array_contains("fill", F.col("place"))
    return F.when(F.col("size") == 0, F.col("whole")).otherwise(F.col("whole") + F.coalesce(more, F.lit(False)).cast("long"))


def taken(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, skey, size, place, source_size, target and copies per row of ``docs``."""
    rows = cut(sized(docs))
    plan, total = choices(rows, **how)
    return cut(join_hot(rows, plan, ["skey"], "n_rows", total).withColumn("copies", _copies()).select("doc_id", "source", "skey", "size", "place", "source_size", "target", "copies"))


def split_tree(counts: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(source, n) -> (shard, source, n, first): how many of each source's blocks each shard gets, and from which on.

    ``shards`` is a power of two. A level of the tree splits all its nodes at once; a
    node's rows are one per source.
    """
    levels = shards.bit_length() - 1
    level = counts.select(F.lit(0).alias("node"), "source", F.col("n").cast("long").alias("n"), F.lit(0).cast("long").alias("first"))

    def dealer(depth: int):
        def deal(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("source", na_position="last", ignore_index=True)
            node, n = int(pdf["node"].iloc[0]), pdf["n"].to_numpy(np.int64)
            rng = np.random.default_rng([seed, depth, node])
            draw = rng.multivariate_hypergeometric(n, int(n.sum()) // 2, method="marginals")
            left, right = pdf.assign(node=2 * node, n=draw), pdf.assign(node=2 * node + 1, n=n - draw, first=pdf["first"].to_numpy() + draw)
            return pd.concat([left, right], ignore_index=True)[["node", "source", "n", "first"]]

        return deal

    for depth in range(levels):
        level = level.groupBy("node").applyInPandas(dealer(depth), "node int, source string, n long, first long")
    return level.select(F.col("node").alias("shard"), "source", "n", "first").where("n > 0")


def deal(chosen: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Every copy that the mix takes: doc_id, source, size, place, copy, shard and its order inside the shard.

    ``chosen`` is what ``taken`` gives. A unit is a block of a source in one of its passes.
    """
    dealt = chosen.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
    dealt = dealt.withColumn("unit", F.col("copy") * F.lit(BLOCKS) + _block())
    # Units that have rows, in permuted order within their source: what the tree deals out.
    units = cut(dealt.groupBy("skey", "source", "unit").agg(F.count(F.lit(1)).alias("n_rows")))
    order = Window.partitionBy("skey").orderBy(F.xxhash64(F.lit(seed), "source", "unit"), "unit")
    ranked = cut(units.withColumn("rank", F.row_number().over(order) - 1))
    quotas = split_tree(ranked.groupBy("source").agg(F.count(F.lit(1)).alias("n")), shards, seed)
    r, q = ranked.alias("r"), quotas.alias("q")
    homes = r.join(q, F.col("r.source").eqNullSafe(F.col("q.source")) & (F.col("r.rank") >= F.col("q.first")) & (F.col("r.rank") < F.col("q.first") + F.col("q.n"))).select("r.skey", "r.unit", "r.n_rows", "q.shard")
    total = units.agg(F.sum("n_rows")).first()[0] or 0
    return join_hot(dealt, cut(homes), ["skey", "unit"], "n_rows", total).select(
        "doc_id", "source", "size", "source_size", "target", "place", "copy", "shard", F.xxhash64(F.lit(seed + 1), "place", "copy").alias("order_in_shard")
    )


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, **how) -> DataFrame:
    """``deal`` of what the mix takes of ``docs``."""
    return deal(taken(docs, **how), shards, seed)


def mixture_per_document(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (from the copies dealt to shards), and the shards that hold its copies."""
    every = taken(docs)
    homes = deal(every).groupBy(F.col("doc_id").alias("_id"), F.col("place").alias("_place")).agg(F.count_distinct("copy").alias("_copies"), F.array_sort(F.collect_set("shard")).alias("shards"))
    both = every.join(homes, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("place") == F.col("_place")), "left")
    return both.select("doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("_copies", F.lit(0))).alias("taken"), "shards")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: a row per copy, partitioned by shard and in the shard's order."""
    # One key, so that the removal of repeated rows and the join share a partitioning.
    key = lambda place: F.concat_ws(":", F.col("doc_id").cast("long").cast("string"), place.cast("string")).alias("_key")
    every = taken(docs)
    homes = deal(every).select(key(F.col("place")), F.col("shard").alias("_shard"), F.col("order_in_shard").alias("_order"))
    marked = docs.select(key(_place(SEED)), F.struct(*docs.columns).alias("_row")).dropDuplicates(["_key"])
    both = marked.join(homes.dropDuplicates(["_key", "_shard", "_order"]), "_key")
    # Slices of a shard follow what they hold, so none grows with the input.
    words = every.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-words // SLICE_WORDS))
    slice_ = F.pmod("_order", F.lit(max(8, 8 * partitions // SHARDS)))
    return both.repartition(partitions, "_shard", slice_).sortWithinPartitions("_shard", "_order").select("_row.*")
