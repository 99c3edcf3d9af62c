"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing, packing.

Each stage takes the documents its predecessor kept and returns documents; the last
returns packed pieces. Stages are separated by tables in the shared folder, which is
removed once the last stage has made its pieces (they are checkpointed there).

A document is its five columns; others are left behind. Null and empty texts have no
words and go in the first stage; null ids, languages and sources are kept (a null source
is a source of its own). Rows repeated whole are one document after exact deduplication,
as are texts that tie but for case. A very long text is one row of a task. An empty table
gives no rows in any stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillrank.llm import exact_dedup, mixing, near_dedup, packing, quality_rules
from quillrank.llm.queries import tokenizer_path
from quillrank.session import remove_shared, shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules reject go; the others stay as they are."""
    return quality_rules.passing(docs).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays."""
    return exact_dedup.drop_exact_copies(docs).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component, the document with the smallest id stays."""
    return near_dedup.drop_near_copies(docs).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, dealt to shards and shuffled inside them."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document taken, each in its sequence."""
    return packing.packed(docs, tokenizer_path())


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]

#: Packing leaves the choice of sequences open, so no SQL has run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    try:
        for k, (name, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
            docs = spark.read.parquet(path)
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        remove_shared(spark, folder)
