"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, mixing, token shards.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written and read again.
All but the last return the columns of documents. The stages' docstrings tell how they treat nulls, ties and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import decontam, mixing, neardup, quality, sstable
from tickloom.llm.shared import let_go, ship, table, written


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return neardup.deduplicated(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def _token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return sstable.read_documents(sstable.stored(docs))


STAGES = [
    ("quality_rules", _quality),
    ("minhash_near_dedup", _near_duplicates),
    ("benchmark_decontamination", _decontamination),
    ("source_mixing", _mixing),
    ("token_sstable", _token_shards),
]

#: The last stage needs a tokenizer, which SQL has not; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if i:
            let_go(before)
    return docs
