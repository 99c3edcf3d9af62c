"""Streams of events: idempotent append, first visibility, visible days, latest action, late corrections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.operators.merge import upsert


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def once(events: DataFrame, key: str = "event_key", ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """Each key once; state older than the watermark is dropped."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def first_visible(events: DataFrame, keys: list[str], ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """The earliest moment of each key (of event time, not arrival)."""
    return events.withWatermark(ts, lateness).groupBy(*keys).agg(F.min(ts).alias("visible_at"))


def visible_days(events: DataFrame, key: str, ts: str = "ts", lateness: str = "1 day", width: str = "21 days", slide: str = "1 day") -> DataFrame:
    """Distinct days and events per key in sliding windows that close with the watermark; a window has few days, so they are kept, not estimated."""
    return events.withWatermark(ts, lateness).groupBy(F.window(ts, width, slide), key).agg(F.size(F.collect_set(F.to_date(ts))).alias("days"), F.count(F.lit(1)).alias("n"))


def decisions(events: DataFrame, key: str = "book") -> DataFrame:
    """Latest decision per key with undo: an undo takes back the last decision, once. events: book, ts, action."""

    def follow(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, before = state.get if state.exists else (None, None)
        n = 0
        for rows in batches:
            for action in rows.sort_values("ts")["action"]:
                n += 1
                if action == "undo":
                    now, before = (before, None) if now is not None and before is not None else (None if now is not None else now, None)
                else:
                    now, before = action, now
        state.update((now, before))
        yield pd.DataFrame({key: [k[0]], "decision": [now], "seen": [n]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(follow, f"{key} {kind}, decision string, seen long", "now string, before string", "update", "NoTimeout")


def merge_into(spark: SparkSession, path: str, key: str, order: str, rules: dict[str, str]):
    """A foreachBatch writer that upserts each batch into the table at ``path``, versioned by batch so a retried batch changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        at = f"{path}/v{epoch}"
        if epoch and _exists(spark, f"{path}/v{epoch - 1}"):
            batch = upsert(spark.read.parquet(f"{path}/v{epoch - 1}"), batch, key, order, rules)
        batch.write.mode("overwrite").parquet(at)

    return write


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def run_to_end(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now; its rows are written beside ``checkpoint`` and read from there.

    Tasks write them, so none goes through the driver. A retried batch overwrites its own folder. In complete mode only the last batch counts.
    """
    spark, path, last = df.sparkSession, f"{checkpoint}-rows", []

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")
        last[:] = [epoch]

    q = df.writeStream.outputMode(mode).queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    if not _exists(spark, path):
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(f"{path}/batch={last[0]}" if mode == "complete" and last else path).select(*df.columns)
