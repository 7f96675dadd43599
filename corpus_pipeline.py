"""A training corpus from the table ``documents``: filter, deduplicate, decontaminate, mix, shard.

Each stage is written as Parquet and read again as the next one's input. All but the last return the columns of
``documents``; the last one adds ``shard`` and ``slot`` to each row's id and source.

* ``quality``: rows that the base rules or the estimated quality reject go.
* ``near_dedup``: of each component of texts whose fingerprints differ in few bits (op1's shingles and distance) the row with
  the smallest id stays.
* ``decontaminate``: rows that overlap a benchmark item go.
* ``mix``: rows in the order of the mixture; rows of sources that the target weights want more of come again.
* ``shard``: every row of the mixture with its shard and slot.

Nulls, empty texts, ties, repeated rows, empty tables and further columns are treated as each operator states; further columns are
kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanflow.llm.common import staged, table
from gleanflow.llm.decontaminate import clean_documents
from gleanflow.llm.mixing import mixed
from gleanflow.llm.quality import good_documents
from gleanflow.llm.sharding import shard_rows
from gleanflow.llm.simhash import one_per_group


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_per_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_rows(docs).select("doc_id", "source", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

# SQL can't express expectation-maximisation or fingerprints; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
