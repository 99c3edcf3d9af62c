"""Upserts, deletions and set operations as full plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.operators.windows import first_per


def upsert(old: DataFrame, new: DataFrame, key: str, order: str, rules: dict[str, str]) -> DataFrame:
    """``old`` with ``new`` merged in; of several new rows per key the last by ``order`` counts.

    A column's rule says what a meeting does: take the new value, keep the old, or fill
    (the new value only where the old is null).
    """
    last = first_per(new, [key], [F.col(order).desc()])
    o, n = old.alias("o"), last.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")

    def value(c: str):
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        rule = rules.get(c, "take")
        met = {"take": F.coalesce(b, a), "keep": a, "fill": F.coalesce(a, b)}[rule]
        return F.when(F.col(f"o.{key}").isNull(), b).when(F.col(f"n.{key}").isNull(), a).otherwise(met).alias(c)

    return both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *[value(c) for c in old.columns if c != key])


def delete_missing(rows: DataFrame, scanned: DataFrame, key: str, group: str, open_states: list[str], state: str = "status") -> DataFrame:
    """Drop open rows of a group that its latest scan no longer has; a scan with no rows at all deletes nothing."""
    live = scanned.select(F.col(group).alias("_g")).distinct()
    gone = rows.where(F.col(state).isin(open_states)).join(live, F.col(group) == F.col("_g"), "left_semi").join(scanned.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti").select(F.col(key).alias("_k"))
    return rows.join(gone, F.col(key) == F.col("_k"), "left_anti")


def conflicts(events: DataFrame, key: str, *content: str) -> DataFrame:
    """Keys that came with different contents."""
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in content]), 256)
    return events.groupBy(key).agg(F.count_distinct(digest).alias("versions")).where("versions > 1")
