"""Sharding by proportional stratified interleaving.

The rows of every source are shuffled by a seeded hash and ranked. A row's fractional rank is
(rank + 0.5) / rows of its source. Sorted by fractional rank, any run of rows holds every source in
proportion, so cutting the order into equal runs gives shards that all match the mixture.

Defined cases: null and missing texts have size 1 and checksum 0; a null source is a source of its own;
equal rows are separate rows, which the shuffle parts; an empty table gives no rows; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanflow.llm.common import positions, ranked_within, shuffle_partitions, table, text_of

SEED = 20
SHARDS = 16
RUN = 4096


def numbered_copies(narrow: DataFrame) -> DataFrame:
    """Equal rows get numbers from 0 (``_copy``), so that the shuffle parts them; one row may have any number of copies.

    Equal rows can't be told apart, so they are counted and written out again, in runs of ``RUN`` that spread over the tasks.
    """
    counts = narrow.groupBy(*narrow.columns).agg(F.count("*").alias("_n"))
    runs = counts.select("*", F.explode(F.expr(f"sequence(0L, (_n - 1) div {RUN})")).alias("_run"))
    runs = runs.repartition(shuffle_partitions(narrow.sparkSession), *narrow.columns, "_run")
    copies = F.explode(F.expr(f"sequence(_run * {RUN}, least(_n, (_run + 1) * {RUN}) - 1)"))
    return runs.select(*narrow.columns, copies.alias("_copy"))


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, text_crc32, shard, slot`` for every row of ``docs``.

    Shard counts differ by one row at most; ``slot`` is gapless from 0 in each shard. Texts are read
    once for size and checksum and are not shuffled.
    """
    narrow = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("_source"),
        (F.octet_length(text_of()) + 1).cast("bigint").alias("size"),
        F.crc32(text_of()).alias("text_crc32"),
    )
    shuffled = F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "_copy")
    ranks = ranked_within(
        numbered_copies(narrow).withColumn("_mix", shuffled),
        "_source", F.col("_mix"), F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("_copy"),
    )
    fraction = ((F.col("_rank") + 0.5) / F.col("_total")).alias("_fraction")
    rows, total = positions(
        ranks.select("doc_id", "source", "_source", "size", "text_crc32", "_rank", fraction),
        F.col("_fraction"),
        F.xxhash64(F.lit(seed), "_source"),
        F.col("_source"),
        F.col("_rank"),
    )
    n = max(total, 1)
    shard = F.expr(f"({shards} * (_pos + 1) - 1) div {n}")
    return rows.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        "shard",
        (F.col("_pos") - F.expr(f"(shard * {n}L) div {shards}")).alias("slot"),
    )


def op3_stratified_shards(spark, sf_dir):
    """Law ``rows``: shard counts are at most one apart."""
    return with_law(shard_rows(table(spark, sf_dir, "documents")))


def with_law(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )
