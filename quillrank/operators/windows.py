"""Window-style operators: latest rows, splits, bounded seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.session import cut


def first_per(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def day_split(df: DataFrame, day: str, key: str, cuts: tuple[float, float] = (0.6, 0.8)) -> DataFrame:
    """train, validation or later by whole days: a cut moves on to the end of its day.

    Counts per day, of which there are few, are summed up; rows meet their day's split.
    """
    per_day = df.groupBy(day).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    before = F.coalesce(upto, F.lit(0))
    # A day belongs to the part in which its first row stands.
    part = F.when(before < F.floor(total * cuts[0]), "train").when(before < F.floor(total * cuts[1]), "validation").otherwise("later")
    return df.join(per_day.select(day, part.alias("split")), day)


def run_split(df: DataFrame, run: str, ts: str, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """Runs in order of their first moment (none first), cut by count of runs."""
    runs = df.groupBy(run).agg(F.min(ts).alias("_t"))
    runs = prefix_sums(runs, ["_t", run], {"_b": F.lit(1)}).crossJoin(F.broadcast(runs.agg(F.count(F.lit(1)).alias("_n"))))
    at, n = F.col("_b") + 1, F.col("_n")
    first = F.greatest(F.lit(1), F.floor(n * train))
    second = F.greatest(first, F.floor(n * (train + validation)))
    split = F.when(at <= first, "train").when(at <= second, "validation").otherwise("test")
    return df.join(runs.select(run, split.alias("split")), run)


def seeds(reads: DataFrame, work: str, author: str, order: list[Column], per_author: int = 2, limit: int = 25) -> DataFrame:
    """First row per work, at most ``per_author`` per author, the first ``limit`` of those."""
    once = first_per(reads, [work], order)
    few = once.withColumn("_a", F.row_number().over(Window.partitionBy(author).orderBy(*order))).where(F.col("_a") <= per_author).drop("_a")
    return few.orderBy(*order).limit(limit)


def hash_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 20261002) -> DataFrame:
    """``n`` rows per stratum by a salted digest of their key: the same rows on every run."""
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy(order, key))).where(F.col("_n") <= n).drop("_n")


def prefix_sums(df: DataFrame, order: list[str], values: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Each row with sums of ``values`` over the rows before it (of its group), zero for the first. ``order`` has no ties in a group.

    Not one window over all rows, which would be one task: rows are dealt by range and
    kept so (a second sampling could deal them anew), each range is summed by itself, and
    what lies before a range is a running sum over ranges.
    """
    by = by or []
    dealt = cut(df.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()))
    totals = dealt.groupBy(*by, "_p").agg(*[F.sum(v).alias(f"_t{n}") for n, v in enumerate(values.values())])
    ranges = Window.partitionBy(*(by or [F.lit(1)])).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.struct(*by, "_p").alias("_at"), *[F.coalesce(F.sum(f"_t{n}").over(ranges), F.lit(0)).alias(f"_o{n}") for n in range(len(values))])
    inside = Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    part = dealt.withColumns({f"_i{n}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in enumerate(values.values())})
    met = part.withColumn("_here", F.struct(*by, "_p")).join(offsets, F.col("_here").eqNullSafe(F.col("_at")))
    return met.select(*df.columns, *[(F.col(f"_i{n}") + F.col(f"_o{n}")).alias(name) for n, name in enumerate(values)])


def placed(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Each row with its place (from 1) in an order without ties over all rows, by ranges and not in one task."""
    keys = {f"_k{n}": c for n, c in enumerate(order)}
    return prefix_sums(df.withColumns(keys), list(keys), {name: F.lit(1)}).withColumn(name, (F.col(name) + 1).cast("int")).drop(*keys)
