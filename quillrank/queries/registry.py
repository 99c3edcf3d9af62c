"""Where queries register themselves, and the tables they derive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Derived tables, the same in both engines.
READS = "reads AS (SELECT vec_id AS id, concat('r', vec_id) AS identity, concat('a', label) AS author, CAST(1 + label % 5 AS DOUBLE) AS rating, DATE '2020-01-01' + CAST(vec_id % 365 AS INT) AS day, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id % 2 = 0)"
CANDIDATES = "candidates AS (SELECT vec_id AS id, concat('c', vec_id) AS identity, concat('a', label) AS author, CAST(embedding AS DOUBLE[]) AS vec, 1 + (vec_id % 3) * 0.1::DOUBLE AS source_weight, (50 + vec_id % 51) / 100.0::DOUBLE AS confidence FROM embeddings WHERE vec_id % 2 = 1)"
ACTIONS = "actions AS (SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS book, user_id, ts, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 0 END AS label, 1.0::DOUBLE AS reliability FROM events)"
IMPRESSIONS = "impressions AS (SELECT event_id AS id, user_id, concat(user_id, '-', CAST(CAST(ts AS DATE) AS VARCHAR)) AS run, ts, value AS score, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rank, 0.5 + (event_id % 5) / 10.0::DOUBLE AS propensity, CASE WHEN event_type = 'purchase' THEN 1.0 WHEN event_type = 'error' THEN 0.0 WHEN event_type = 'signup' THEN 0.5 END::DOUBLE AS label FROM events)"


def reads(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").where("vec_id % 2 = 0")
    return e.select(F.col("vec_id").alias("id"), F.concat(F.lit("r"), F.col("vec_id").cast("string")).alias("identity"), F.concat(F.lit("a"), F.col("label").cast("string")).alias("author"), (1 + F.col("label") % 5).cast("double").alias("rating"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("vec_id") % 365).cast("int")).alias("day"), F.col("embedding").alias("vec"))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").where("vec_id % 2 = 1")
    return e.select(F.col("vec_id").alias("id"), F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("identity"), F.concat(F.lit("a"), F.col("label").cast("string")).alias("author"), F.col("embedding").alias("vec"), (1 + (F.col("vec_id") % 3) * F.lit(0.1)).alias("source_weight"), ((50 + F.col("vec_id") % 51) / F.lit(100.0)).alias("confidence"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def actions(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", 0)
    return events(spark, sf).select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("long").alias("book"), "user_id", "ts", label.alias("label"), F.lit(1.0).alias("reliability"))


def impressions(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    day = F.to_date("ts")
    label = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "error", 0.0).when(F.col("event_type") == "signup", 0.5)
    rank = F.row_number().over(Window.partitionBy("user_id", day).orderBy("ts", "event_id"))
    return events(spark, sf).select(F.col("event_id").alias("id"), "user_id", F.concat(F.col("user_id").cast("string"), F.lit("-"), day.cast("string")).alias("run"), "ts", F.col("value").alias("score"), rank.alias("rank"), (0.5 + (F.col("event_id") % 5) / F.lit(10.0)).alias("propensity"), label.alias("label"))


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
