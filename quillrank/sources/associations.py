"""Edges from a seed to related items, out of saved payloads of providers.

What was fetched is kept as one JSON object a line, in a folder per provider
(``provider=<name>``), so a filter on the provider skips the folders of others. Three
shapes are known, whoever sends them: lists that hold the seed, ranked recommendations,
and volumes with their info. A provider is any function from reads to edges; a run of
one is audited whether it succeeds or fails, and persists its edges only if it succeeds.

An item that is the seed itself, has no key or repeats one is no edge; of several
positions the first counts. Lines that are no such object are counted, not parsed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.operators.windows import seeds as bounded_seeds

_SHAPE = "struct<seed:string,lists:array<struct<name:string,entries:array<struct<key:string>>>>,recommendations:array<struct<key:string,score:double>>,volumes:array<struct<id:string,info:struct<title:string>>>>"
#: Recommendations and volumes beyond this place aren't related enough to be kept.
MAX_PLACE = 40


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """provider, line and the parsed payload (null where a line is none)."""
    lines = spark.read.option("basePath", folder).text(folder)
    parsed = F.from_json("value", _SHAPE)
    return lines.select("provider", F.col("value").alias("line"), F.when(parsed["seed"].isNotNull(), parsed).alias("p"))


def edges(rows: DataFrame) -> DataFrame:
    """(provider, seed, related, relation, position, weight) of payloads.

    A list weighs one for each list that holds both; recommendations and volumes weigh
    the inverse of their position.
    """
    p = rows.where("p is not null").select("provider", F.col("p.seed").alias("seed"), "p.lists", "p.recommendations", "p.volumes")
    listed = p.select("provider", "seed", F.explode("lists").alias("l")).select("provider", "seed", F.col("l.name").alias("name"), F.explode("l.entries").alias("e"))
    listed = listed.select("provider", "seed", "name", F.col("e.key").alias("related")).where("related <> '' and related <> seed").distinct()
    lists = listed.groupBy("provider", "seed", "related").agg(F.count(F.lit(1)).cast("double").alias("weight")).select("*", F.lit("list").alias("relation"), F.lit(None).cast("int").alias("position"))
    out = lists
    for column, key, relation in (("recommendations", "key", "recommendation"), ("volumes", "id", "volume")):
        ranked = p.select("provider", "seed", F.posexplode(column).alias("at", "x")).select("provider", "seed", F.col(f"x.{key}").alias("related"), F.col("at") + 1)
        ranked = ranked.toDF("provider", "seed", "related", "position").where(f"related <> '' and related <> seed and position <= {MAX_PLACE}")
        best = ranked.groupBy("provider", "seed", "related").agg(F.min("position").alias("position"))
        out = out.unionByName(best.select("*", F.lit(relation).alias("relation"), (1.0 / F.col("position")).alias("weight")))
    return out.select("provider", "seed", "related", "relation", "position", "weight")


Provider = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Run:
    id: str
    provider: str
    status: str
    seeds: int
    edges: int
    persisted: int
    error: str


def run_provider(name: str, provider: Provider, reads: DataFrame, persist: Callable[[DataFrame], None] | None = None, max_seeds: int = 25) -> Run:
    """Run a provider over the whole library and audit it; a failure is a run too, and persists nothing.

    reads: id, work, author, rating, day. The audit counts the seeds a provider may
    choose: the best liked, latest reads, one per work and two per author.
    """
    liked = reads.where("rating >= 4")
    n = bounded_seeds(liked, "work", "author", [F.col("rating").desc(), F.col("day").desc_nulls_last(), F.col("id")], 2, max_seeds).count()
    run = uuid.uuid4().hex
    try:
        found = provider(reads)
        count = found.count()
        if persist is not None and count:
            persist(found.withColumn("run", F.lit(run)))
    except Exception as error:
        return Run(run, name, "failed", n, 0, 0, str(error).split("\n")[0][:200])
    return Run(run, name, "complete", n, count, count if persist is not None else 0, "")


def saved_provider(spark: SparkSession, folder: str, name: str) -> Provider:
    """A provider whose answers were saved: edges of the seeds among the reads that are liked, to works that were not read."""

    def collect(reads: DataFrame) -> DataFrame:
        found = edges(payloads(spark, folder).where(F.col("provider") == name))
        liked = reads.where("rating >= 4").select(F.col("work").alias("seed")).distinct()
        return found.join(liked, "seed", "left_semi").join(reads.select(F.col("work").alias("related")), "related", "left_anti")

    return collect
