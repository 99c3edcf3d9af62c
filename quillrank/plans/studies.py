"""Offline studies: metric bundles, paired bootstraps, alignment, slices, coverage, vocabularies, metrics learnt from ratings."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.vectors import dot, let, unit
from quillrank.operators.aggregates import rank_auc


def stacked(df: DataFrame, arms: list[str], arm: str = "arm", score: str = "score") -> DataFrame:
    """One row per row and arm, from one column per arm: arms are compared by one grouped aggregate, not by one job each."""
    rest = [c for c in df.columns if c not in arms]
    return df.select(*rest, F.explode(F.array(*[F.struct(F.lit(a).alias(arm), F.col(a).cast("double").alias(score)) for a in arms])).alias("_x")).select(*rest, "_x.*")


def balanced_auc(df: DataFrame, rating: str, score: str, fold: str, arm: str = "arm") -> DataFrame:
    """(arm, high, low, balanced): AUC of four stars and more and of more than two stars, the means of the folds' own values; folds are never pooled."""
    by = [arm, fold]
    rows = df.select(*by, score, (F.col(rating) >= 4).cast("int").alias("high"), (F.col(rating) > 2).cast("int").alias("low"))
    high, low = (rank_auc(rows, c, score, by).withColumnRenamed("auc", c) for c in ("high", "low"))
    per = high.join(low, by).groupBy(arm).agg(F.avg("high").alias("high"), F.avg("low").alias("low"))
    return per.withColumn("balanced", (F.col("high") + F.col("low")) / 2)


def deltas(metrics: DataFrame, baseline: str, names: list[str], by: list[str] | None = None, arm: str = "arm") -> DataFrame:
    """Each arm's metrics less the baseline arm's of the same slice."""
    by = by or []
    base = metrics.where(F.col(arm) == baseline).select(*by, *[F.col(n).alias(f"_{n}") for n in names])
    rest = metrics.where(F.col(arm) != baseline)
    met = rest.join(base, by) if by else rest.crossJoin(F.broadcast(base))
    return met.select(*by, arm, *[(F.col(n) - F.col(f"_{n}")).alias(f"{n}_delta") for n in names])


def aligned(df: DataFrame, source: str, reference: str, train: Column) -> DataFrame:
    """``aligned``: the source's scores on the reference's scale, by mean and deviation of training rows where both are finite."""
    fair = train & ~F.isnan(source) & ~F.isnan(reference) & F.col(source).isNotNull() & F.col(reference).isNotNull()
    fit = df.where(fair).agg(F.avg(source).alias("_sm"), F.avg(reference).alias("_rm"), F.stddev_pop(source).alias("_ss"), F.stddev_pop(reference).alias("_rs"))
    scale = F.when(F.col("_ss") > 1e-12, F.col("_rs") / F.col("_ss")).otherwise(0.0)
    return df.crossJoin(F.broadcast(fit)).withColumn("aligned", F.col("_rm") + (F.col(source) - F.col("_sm")) * scale).drop("_sm", "_rm", "_ss", "_rs")


def feedback_metrics(df: DataFrame, label: str, score: str, key: str, k: int = 20) -> DataFrame:
    """AUC of saves against rejects and the saves among the first and the last ``k`` (ties by key)."""
    rows = df.select(key, label, score)
    top = rows.orderBy(F.col(score).desc(), key).limit(k).agg(F.count_if(F.col(label) == 1).alias("top_saves"), F.count_if(F.col(label) == 0).alias("top_rejects"))
    bottom = rows.orderBy(score, F.col(key).desc()).limit(k).agg(F.count_if(F.col(label) == 1).alias("bottom_saves"), F.count_if(F.col(label) == 0).alias("bottom_rejects"))
    return rank_auc(rows, label, score).crossJoin(top).crossJoin(bottom)


def judged(answers: DataFrame, manifest: DataFrame, labels: tuple[str, ...], key: str = "id", label: str = "label") -> DataFrame:
    """Faults of a set of judgments as (id, fault): unknown or repeated ids, labels not allowed, items without an answer."""
    n = answers.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max((~F.coalesce(F.col(label).isin(*labels), F.lit(False))).cast("int")).alias("bad"))
    both = n.join(manifest.select(key).distinct().withColumn("_known", F.lit(True)), key, "full")
    fault = F.when(F.col("_known").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when(F.col("bad") == 1, "label")
    return both.select(key, fault.alias("fault")).where("fault is not null")


def halves(df: DataFrame, day: str) -> DataFrame:
    """``half``: early or late by the middle distinct day, which is late."""
    days = df.select(day).distinct()
    at, n = F.row_number().over(Window.orderBy(day)), F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    parts = days.select(day, F.when(at - 1 < F.floor(n / 2), "early").otherwise("late").alias("half"))
    return df.join(parts, day)


def fold_faults(df: DataFrame, day: str, part: str, order: tuple[str, ...]) -> DataFrame:
    """Counts of what a temporal split must not have: rows without a known part, days in two parts, parts out of order."""
    place = reduce(lambda c, x: c.when(F.col(part) == x[1], x[0]), enumerate(order[1:], 1), F.when(F.col(part) == order[0], 0))
    days = df.groupBy(day).agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count_if(place.isNull()).alias("stray"))
    before = F.max("hi").over(Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1))
    return days.withColumn("_b", before).agg(F.sum("stray").alias("unknown_rows"), F.count_if(F.col("lo") < F.col("hi")).alias("split_days"), F.count_if(F.col("lo") < F.col("_b")).alias("days_out_of_order"))


def coverage(targets: DataFrame, pool: DataFrame, prefix: DataFrame) -> DataFrame:
    """Recall of later reads in a pool, by class of rating, of all authors and of authors not read before.

    targets: id, key, author, rating; pool: key; prefix: author.
    """
    known = prefix.select("author").distinct().withColumn("_seen", F.lit(True))
    got = pool.select("key").distinct().withColumn("_got", F.lit(True))
    t = targets.join(known, "author", "left").join(got, "key", "left")
    kind = F.when(F.col("rating") >= 4, "high").when(F.col("rating").between(1, 2), "low")
    t = t.withColumn("class", kind).where("class is not null").withColumn("slice", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("_seen").isNull(), "unseen_author")))))
    return t.groupBy("class", "slice").agg(F.count(F.lit(1)).alias("targets"), F.count("_got").alias("retrieved"), (F.count("_got") / F.count(F.lit(1))).alias("recall"))


def one_hot(rows: DataFrame, key: str, values: str, train: Column) -> DataFrame:
    """Sparse one-hot rows (key, value, known): the vocabulary is the training rows'; a key of which no value is in it has one row with known false."""
    flat = rows.select(key, F.explode_outer(F.array_distinct(values)).alias("value"), train.alias("_train"))
    vocabulary = flat.where("_train and value is not null").select("value").distinct().withColumn("_in", F.lit(True))
    met = flat.join(vocabulary, "value", "left")
    hits = met.where("_in").select(key, "value", F.lit(True).alias("known"))
    none = rows.select(key).join(hits.select(key), key, "left_anti").select(key, F.lit(None).cast("string").alias("value"), F.lit(False).alias("known"))
    return hits.unionByName(none)


def stratum_z(df: DataFrame, stratum: list[str], value: str, train: Column) -> DataFrame:
    """``z``: a value in units of its stratum's training rows; a deviation near nothing counts as one."""
    fit = df.where(train).groupBy(*stratum).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    sd = F.when(F.coalesce("_s", F.lit(0.0)) < 1e-8, 1.0).otherwise(F.col("_s"))
    return df.join(fit, stratum, "left").withColumn("z", (F.col(value) - F.col("_m")) / sd).drop("_m", "_s")


def terms(text: Column) -> Column:
    """Words and word pairs, and runs of three to five characters inside padded words, each with its family's mark."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " "), " "), lambda w: F.length(w) >= 2)
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))).otherwise(F.array().cast("array<string>"))

    def runs(padded: Column, n: int) -> Column:
        """Every run of n characters; a padded word shorter than n is one run itself."""
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))

    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = F.flatten(F.transform(padded, lambda p: F.concat(*[runs(p, n) for n in (3, 4, 5)])))
    return F.concat(F.transform(F.concat(words, pairs), lambda w: F.concat(F.lit("w:"), w)), F.transform(grams, lambda g: F.concat(F.lit("c:"), g)))


def tfidf(df: DataFrame, key: str, text: str, train: Column) -> DataFrame:
    """(key, term, weight): smoothed inverse document frequencies of training rows; each family has unit length, halves are joined, the whole has unit length."""
    counts = df.select(key, train.alias("_t"), F.explode(terms(F.col(text))).alias("term")).groupBy(key, "_t", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = df.agg(F.count_if(train).alias("_n"))
    idf = counts.where("_t").groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = counts.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"), F.substring("term", 1, 1).alias("_f"))
    family = w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key, "_f"))))
    return family.select(key, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))).alias("weight"))


def paired_bootstrap(df: DataFrame, cluster: str, label: str, base: str, candidate: str, replicas: int = 200, seed: int = 7) -> DataFrame:
    """Quantiles of AUC(candidate) - AUC(base) over resamples of whole clusters; both arms meet the same draws.

    A cluster counts a Poisson(1) number of times in a replica, drawn from a seeded hash
    of both. Rows are counted per cluster, arm and score before replicas multiply them.
    """
    arms = stacked(df.select(cluster, label, base, candidate), [base, candidate])
    steps = arms.groupBy(cluster, "arm", "score").agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    drawn = steps.withColumn("replica", F.explode(F.sequence(F.lit(1), F.lit(replicas)))).withColumn("t", _poisson(seed, F.col(cluster), F.col("replica"))).where("t > 0")
    per = drawn.groupBy("replica", "arm", "score").agg(F.sum(F.col("t") * F.col("p")).alias("p"), F.sum(F.col("t") * F.col("q")).alias("q"))
    below = Window.partitionBy("replica", "arm").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    won = per.withColumn("won", F.col("p") * (F.coalesce(F.sum("q").over(below), F.lit(0)) + F.col("q") / 2))
    auc = won.groupBy("replica", "arm").agg((F.sum("won") / F.nullif(F.sum("p") * F.sum("q"), F.lit(0))).alias("auc"))
    delta = auc.groupBy("replica").agg((F.max(F.when(F.col("arm") == candidate, F.col("auc"))) - F.max(F.when(F.col("arm") == base, F.col("auc")))).alias("d"))
    return delta.agg(F.count("d").alias("replicas"), *[F.percentile("d", F.lit(q)).alias(a) for q, a in ((0.025, "low"), (0.05, "low_5"), (0.5, "middle"), (0.975, "high"))])


def _poisson(seed: int, *of: Column) -> Column:
    u = F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 30)) / float(1 << 30)
    bounds = np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 8)]))
    return reduce(lambda times, k: F.when(u < float(bounds[k]), k).otherwise(times), reversed(range(8)), F.lit(8))


def metric_direction(train: DataFrame, vec: str, rating: str, components: int = 4, alpha: float = 10.0) -> np.ndarray:
    """The direction of ratings (less three) in the training vectors' leading components.

    What reaches the driver is the moments of the vectors, (dimensions + 1)^2 numbers
    whatever the number of rows. The rest is algebra on them.
    """
    x = F.concat(unit(F.col(vec).cast("array<double>")), F.array((F.col(rating) - 3.0).cast("double"), F.lit(1.0)))
    rows = train.select(x.alias("x"))
    cells = rows.select(F.posexplode("x").alias("i", "a"), "x").select("i", F.posexplode("x").alias("j", "b"), "a").where("i <= j")
    d = int(rows.select(F.max(F.size("x"))).first()[0] or 0)
    if d < 3:
        return np.zeros(0)
    m = np.zeros((d, d))
    for r in cells.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("s")).toLocalIterator():
        m[r.i, r.j] = m[r.j, r.i] = r.s
    n, k = m[-1, -1], d - 2
    mean, y = m[:k, -1] / n, m[k, -1] / n
    values, axes = np.linalg.eigh(m[:k, :k] / n - np.outer(mean, mean))
    top = axes[:, ::-1][:, :components]
    scale = np.sqrt(np.maximum(values[::-1][:components], 0))
    scale[scale < 1e-10] = 1.0
    # Components are uncorrelated and scaled, so ridge weights are one division each.
    weights = (top.T @ (m[:k, k] / n - mean * y)) / scale * n / (n + alpha)
    out = top @ (weights / scale)
    norm = np.linalg.norm(out)
    return out / norm if np.isfinite(norm) and norm >= 1e-12 else np.zeros(k)


def stretched(v: Column, direction: np.ndarray, strength: float) -> Column:
    """A unit vector after the metric I + strength d d': cosines of the results are cosines under the metric."""
    d = F.array(*[F.lit(float(x)) for x in direction])
    factor = float(np.sqrt(1 + strength) - 1)
    return let(unit(v.cast("array<double>")), lambda u: let(dot(u, d) * factor, lambda along: unit(F.zip_with(u, d, lambda a, b: a + along * b))))


def capped_residual(prediction: Column, score: Column, deviation: Column) -> Column:
    """What a learner may add to a score: at most five points and a quarter of the scores' deviation."""
    most = F.least(F.lit(5.0), 0.25 * deviation)
    return F.least(most, F.greatest(-most, prediction - score))
