"""Offline evaluation: bootstraps, raw metrics, the metric report, promotion."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.operators.aggregates import ndcg_at, precision_at, weighted_auc
from quillrank.operators.windows import prefix_sums, run_split


def raw_metrics(df: DataFrame, rating: str, score: str) -> DataFrame:
    """MAE, RMSE and Spearman correlation by tie-averaged ranks."""
    r = df.select(F.col(rating).alias("y"), F.col(score).alias("x"))
    for c in ("y", "x"):
        steps = prefix_sums(r.groupBy(c).agg(F.count(F.lit(1)).alias("n")), [c], {"below": F.col("n")})
        r = r.join(steps.select(c, (F.col("below") + (F.col("n") + 1) / 2).alias(f"r{c}")), c)
    return r.agg(F.avg(F.abs(F.col("y") - F.col("x"))).alias("mae"), F.sqrt(F.avg(F.pow(F.col("y") - F.col("x"), 2))).alias("rmse"), F.corr("rx", "ry").alias("spearman"))


def cluster_bootstrap(df: DataFrame, cluster: str, label: str, score: str, replicas: int = 200, seed: int = 7) -> DataFrame:
    """Quantiles of the AUC over resamples of whole clusters.

    Each cluster counts a Poisson(1) number of times in each replica, drawn from a seeded
    hash, so no cluster list is collected and reruns agree. Scores are counted per cluster
    and step first; replicas multiply those counts, not the rows.
    """
    steps = df.groupBy(cluster, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    u = F.pmod(F.xxhash64(F.lit(seed), cluster, "replica"), F.lit(1 << 30)) / float(1 << 30)
    cumulative, term, times = 0.0, float(np.exp(-1)), F.lit(8)
    bounds = []
    for k in range(8):
        cumulative += term
        bounds.append((cumulative, k))
        term /= k + 1
    for bound, k in reversed(bounds):
        times = F.when(u < bound, k).otherwise(times)
    drawn = steps.withColumn("replica", F.explode(F.sequence(F.lit(1), F.lit(replicas)))).withColumn("t", times).where("t > 0")
    per = drawn.groupBy("replica", score).agg(F.sum(F.col("t") * F.col("p")).alias("p"), F.sum(F.col("t") * F.col("q")).alias("q"))
    below = Window.partitionBy("replica").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    auc = per.withColumn("won", F.col("p") * (F.coalesce(F.sum("q").over(below), F.lit(0)) + F.col("q") / 2)).groupBy("replica").agg((F.sum("won") / F.nullif(F.sum("p") * F.sum("q"), F.lit(0))).alias("auc"))
    return auc.agg(F.count("auc").alias("replicas"), F.percentile("auc", F.lit(0.025)).alias("low"), F.percentile("auc", F.lit(0.5)).alias("middle"), F.percentile("auc", F.lit(0.975)).alias("high"))


#: What a part needs before its figures mean anything.
MINIMUMS = {"runs": 20, "labelled": 200, "positive": 20, "negative": 20}


def metric_report(impressions: DataFrame, k: int = 20, minimums: dict[str, int] | None = None) -> DataFrame:
    """Counts, weighted AUC, precision and NDCG at ``k``, and what there is too little of: one row per part.

    Parts are the whole sample, the temporal splits of whole runs, and enjoyment, which
    takes ratings alone. A row is counted in each of its parts. impressions: run, ts,
    score, rank, label (null: unknown, 0.5: neutral), weight, rating (whether the label is one).
    """
    split = run_split(impressions, "run", "ts")
    parts = F.array_compact(F.array(F.lit("sample"), F.col("split"), F.when(F.col("rating") & F.col("label").isNotNull(), F.lit("enjoyment"))))
    rows = split.withColumn("part", F.explode(parts)).drop("split")
    label = F.col("label")
    counts = rows.groupBy("part").agg(
        F.count(F.lit(1)).alias("impressions"), F.count("label").alias("labelled"), F.count_if(label > 0.5).alias("positive"), F.count_if(label < 0.5).alias("negative"), F.count_distinct("run").alias("runs"),
    )
    known = rows.where(label.isNotNull())
    metrics = (weighted_auc(known, "label", "score", "weight", ["part"]), precision_at(rows, "run", "rank", "label", "weight", k, ["part"]), ndcg_at(rows, "run", "rank", "label", "weight", k, ["part"]))
    out = counts
    for m in metrics:
        out = out.join(m, "part", "left")
    short = F.array_compact(F.array(*[F.when(F.col(c) < least, F.lit(c)) for c, least in {**MINIMUMS, **(minimums or {})}.items()]))
    return out.withColumn("short_of", F.array_join(short, ","))


def promotion(delta: DataFrame) -> DataFrame:
    """Reasons against promotion. delta: runs, impressions, auc_delta, precision_delta, ndcg_delta."""
    tests = (("runs", 20, "too few runs"), ("impressions", 200, "too few impressions"), ("auc_delta", 0.01, "auc"), ("precision_delta", 0.0, "precision"), ("ndcg_delta", 0.01, "ndcg"))
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c) < least, F.lit(True)), F.lit(why)) for c, least, why in tests]))
    return delta.select(reasons.alias("reasons"), (F.size(reasons) == 0).alias("promote"))
