"""Aggregates of the learner and of evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank.operators.windows import prefix_sums

Z = 1.96


def wilson(positive: Column, weight: Column, effective: Column) -> tuple[Column, Column]:
    """Wilson interval of a weighted rate with an effective sample size."""
    n, p = F.greatest(F.lit(1.0), effective), positive / weight
    mid = (p + Z * Z / (2 * n)) / (1 + Z * Z / n)
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / (1 + Z * Z / n)
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def rank_auc(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """AUC by tie-averaged ranks: one sort, no pairs. Groups are counted over distinct scores first."""
    by = by or []
    steps = df.groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    return _won(steps, score, by)


def weighted_auc(df: DataFrame, label: str, score: str, weight: str, by: list[str] | None = None) -> DataFrame:
    """AUC in which a pair counts by the product of its weights; labels of one half are left out."""
    by = by or []
    steps = df.where(F.col(label) != 0.5).groupBy(*by, score).agg(F.sum(F.when(F.col(label) > 0.5, F.col(weight)).otherwise(0.0)).alias("p"), F.sum(F.when(F.col(label) < 0.5, F.col(weight)).otherwise(0.0)).alias("q"))
    return _won(steps, score, by)


def _won(steps: DataFrame, score: str, by: list[str]) -> DataFrame:
    """The share of pairs won, from positives p and negatives q per distinct score."""
    won = prefix_sums(steps, [score], {"below": F.col("q")}, by).withColumn("won", F.col("p") * (F.col("below") + F.col("q") / 2))
    return won.groupBy(*by).agg((F.sum("won") / F.nullif((F.sum("p") * F.sum("q")).cast("double"), F.lit(0.0))).alias("auc"))


def precision_at(df: DataFrame, run: str, rank: str, label: str, weight: str, k: int, by: list[str] | None = None) -> DataFrame:
    """Weighted share of positives among the labelled of the first k slots, averaged over runs; the cut comes before labels."""
    by = by or []
    per_run = df.where((F.col(rank) <= k) & F.col(label).isNotNull()).groupBy(*by, run).agg((F.sum(F.when(F.col(label) > 0.5, F.col(weight)).otherwise(0.0)) / F.sum(weight)).alias("p"))
    return per_run.groupBy(*by).agg(F.avg("p").alias("precision"))


def ndcg_at(df: DataFrame, run: str, rank: str, label: str, weight: str, k: int, by: list[str] | None = None) -> DataFrame:
    """Weighted NDCG over logged ranks against the best order of all labelled gains, averaged over runs with a gain."""
    known = df.where(F.col(label).isNotNull()).withColumn("gain", F.col(label) * F.col(weight))
    by = by or []
    best = Window.partitionBy(*by, run).orderBy(F.col("gain").desc(), rank)
    known = known.withColumn("best", F.row_number().over(best))
    discounted = lambda at: F.sum(F.when(F.col(at) <= k, F.col("gain") / F.log2(F.col(at) + 1)).otherwise(0.0))
    per_run = known.groupBy(*by, run).agg(discounted(rank).alias("dcg"), discounted("best").alias("ideal")).where("ideal > 0")
    return per_run.groupBy(*by).agg(F.avg(F.col("dcg") / F.col("ideal")).alias("ndcg"))


def deciles(df: DataFrame, score: str, key: str, n: int = 10) -> DataFrame:
    """Parts of equal count by score; the first take the remainder."""
    rows = df.count()
    small, more = divmod(rows, n)
    at = prefix_sums(df, [score, key], {"_at": F.lit(1)})
    # The first ``more`` parts have one row more than the others.
    edge = more * (small + 1)
    part = F.when(F.col("_at") < edge, F.floor(F.col("_at") / (small + 1))).otherwise(more + F.floor((F.col("_at") - edge) / max(small, 1)))
    return at.withColumn("decile", (part + 1).cast("int")).drop("_at")


def calibration(df: DataFrame, score: str, rating: str) -> DataFrame:
    """Slope (not below 0) and intercept of rating on score."""
    s = df.agg(F.regr_slope(rating, score).alias("s"), F.avg(rating).alias("r"), F.avg(score).alias("x"))
    slope = F.greatest(F.lit(0.0), F.coalesce("s", F.lit(0.0)))
    return s.select(slope.alias("slope"), (F.col("r") - slope * F.col("x")).alias("intercept"))


def reciprocal_ranks(df: DataFrame, rank: str) -> DataFrame:
    """Count, median rank, hits at 8 and 24, mean reciprocal rank."""
    return df.agg(F.count(rank).alias("n"), F.median(rank).alias("median_rank"), F.count_if(F.col(rank) <= 8).alias("hit8"), F.count_if(F.col(rank) <= 24).alias("hit24"), F.avg(1 / F.col(rank)).alias("mrr"))


def register(spark: SparkSession) -> None:
    """SQL names for aggregates Spark lacks. A group is held by one task: for groups of any size there is ``weighted_auc``."""

    @F.pandas_udf("double")
    def weighted_auc_of(label: pd.Series, score: pd.Series, weight: pd.Series) -> float:
        rows = pd.DataFrame({"y": label, "s": score, "w": weight}).dropna()
        steps = rows.assign(p=rows["w"].where(rows["y"] == 1, 0.0), q=rows["w"].where(rows["y"] == 0, 0.0)).groupby("s")[["p", "q"]].sum()
        below = steps["q"].cumsum() - steps["q"]
        pairs = steps["p"].sum() * steps["q"].sum()
        return float((steps["p"] * (below + steps["q"] / 2)).sum() / pairs) if pairs else float("nan")

    spark.udf.register("weighted_auc", weighted_auc_of)
