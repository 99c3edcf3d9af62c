"""Joins that a plain equi join doesn't say: as-of, any-key identity, greedy dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.session import cut


def latest_before(left: DataFrame, right: DataFrame, on: str, at: str, before: str, order: list[str]) -> DataFrame:
    """Each left row with the last right row of its group whose ``before`` is earlier than the left row's ``at``.

    Of right rows the last is that with the greatest ``order`` (the first of it is
    ``before``). Both sides are brought in order together and each left row takes the
    greatest right row that stands before it, so a group with many rows on both sides
    costs their sum, not their product. Rows are dealt by range of group and time; what a
    range needs of those before it is one row per range. Rows without a match go.
    """
    mine = left.select(F.col(on).alias("_on"), F.col(at).alias("_at"), F.lit(0).alias("_kind"), F.struct(*left.columns).alias("_l"))
    theirs = right.select(F.col(on).alias("_on"), F.col(before).alias("_at"), F.lit(1).alias("_kind"), F.struct(*order, F.struct(*right.columns).alias("_row")).alias("_r"))
    # At one moment left rows stand first: a right row of that moment is not earlier.
    both = mine.unionByName(theirs, allowMissingColumns=True)
    dealt = cut(both.repartitionByRange("_on", "_at", "_kind").withColumn("_p", F.spark_partition_id()))
    last = dealt.where("_kind = 1").groupBy("_on", "_p").agg(F.max("_r").alias("_m"))
    ranges = Window.partitionBy("_on").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    known = dealt.select("_on", "_p").distinct().join(last, ["_on", "_p"], "left").withColumn("_carried", F.max("_m").over(ranges)).drop("_m")
    inside = Window.partitionBy("_on", "_p").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    # Left rows have no right row, so those among the rows before change no maximum.
    seen = dealt.withColumn("_here", F.max("_r").over(inside)).where("_kind = 0").join(known, ["_on", "_p"])
    met = seen.select("_l.*", F.coalesce("_here", "_carried").alias("_m")).where("_m is not null")
    return met.select(*left.columns, *[F.col(f"_m._row.{c}").alias(c) for c in right.columns if c not in left.columns])


def without_known(items: DataFrame, known: DataFrame, keys: str = "keys", key: str = "id") -> DataFrame:
    """Items none of whose keys is a key of a known row. Both sides have an array of keys."""
    have = known.select(F.explode(keys).alias("_k")).distinct()
    hit = items.select(key, F.explode(keys).alias("_k")).join(have, "_k", "left_semi").select(F.col(key).alias("_hit")).distinct()
    return items.join(hit, items[key] == hit["_hit"], "left_anti")


def unambiguous(items: DataFrame, targets: DataFrame, item: str, target: str, key: str, method: str) -> DataFrame:
    """Items that meet exactly one target, with the strongest (least) method."""
    # A key says with two of its targets whether it has one, so it meets an item as one row, however many it has.
    keys = targets.groupBy(key).agg(F.min(target).alias("_low"), F.max(target).alias("_high"), F.min(method).alias(method))
    met = items.join(keys, key).groupBy(item).agg(F.min("_low").alias(target), F.max("_high").alias("_high"), F.min(method).alias(method))
    return met.where(F.col(target) == F.col("_high")).drop("_high")


def greedy_rounds(items: DataFrame, key: str, order: list[Column], keys: str = "keys") -> DataFrame:
    """In ``order`` (then ``key``), an item stays if none of its keys is one of an item that stayed.

    In a round, items first at each of their keys stay and what shares a key with them
    goes; both are what the row-by-row pass decides. A round is two aggregations by key.
    The number of rounds is that of the longest chain of items each waiting for the one
    before it. Items without keys stay.
    """
    arcs = cut(items.select(key, F.struct(*[c.alias(f"o{n}") for n, c in enumerate(order)], F.col(key).alias("k")).alias("_o"), F.explode(F.array_distinct(F.array_compact(keys))).alias("_k")))
    lost = None
    while not arcs.isEmpty():
        least = arcs.groupBy("_k").agg(F.min("_o").alias("_m"))
        first = arcs.join(least, "_k").groupBy(key).agg(F.bool_and(F.col("_o") == F.col("_m")).alias("_stays")).where("_stays").select(key)
        taken = arcs.join(first, key, "left_semi").select("_k").distinct()
        # One pass says of each item whether it is among the first, met their keys, or waits.
        hit = arcs.join(taken, "_k", "left_semi").select(key).distinct()
        gone = cut(hit.join(first.withColumn("_stays", F.lit(True)), key, "left"))
        out = gone.where("_stays is null").select(key)
        lost = out if lost is None else lost.unionByName(out)
        arcs = cut(arcs.join(gone.select(key), key, "left_anti"))
    return items if lost is None else items.join(lost, key, "left_anti")
