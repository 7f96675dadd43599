"""Helpers shared by the operators: staging, global positions, components."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanflow.operators.tables import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there, a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def named(columns: list[str]) -> list[Column]:
    """The columns under their names, whatever characters these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def unused(columns: list[str], name: str) -> str:
    """``name``, made longer until no column has it (Spark takes upper and lower case for one)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(*columns: str) -> Column:
    """64 bits that stand for the values of the columns; nulls count as values of their own."""
    values = named(list(columns))
    return F.xxhash64(*values, *[c.isNull() for c in values])


# Keys that are sent to all tasks at most: 8 MB.
FEW_KEYS = 1 << 20


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is not among the distinct ``keys`` (staged, bigint).

    The list goes to all tasks if it is counted to be short, so the rows stay where they are; a longer one is joined by shuffle.
    """
    return rows.join(F.broadcast(keys) if keys.count() <= FEW_KEYS else keys, key, "left_anti")


def ordered(df: DataFrame, *order: Column) -> DataFrame:
    """Rows in range partitions by ``order``, staged, with ``_pid`` and ``_idx`` (place in the partition)."""
    n = shuffle_partitions(df.sparkSession)
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = staged(rows.withColumn("_mid", F.monotonically_increasing_id()))
    return rows.select(
        "*",
        F.shiftright("_mid", 33).alias("_pid"),
        F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)).alias("_idx"),
    ).drop("_mid")


def positions(df: DataFrame, *order: Column) -> tuple[DataFrame, int]:
    """Adds ``_pos``, the place from 0 in the global order, and tells the number of rows.

    Only one count per range partition reaches the driver.
    """
    rows = ordered(df, *order)
    counts = dict(rows.groupBy("_pid").count().collect())
    starts, total = [], 0
    for pid in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(pid, 0)
    offsets = F.from_json(F.lit(json.dumps(starts)), "array<bigint>")
    place = F.get(offsets, F.col("_pid").cast("int")) + F.col("_idx")
    return rows.withColumn("_pos", place).drop("_pid", "_idx"), total


def ranked_within(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """Adds ``_rank`` (from 0, by ``order``) and ``_total`` within each value of ``key`` (not null).

    One value may own any share of the rows: range partitions split it, and only one count per
    partition and value is put together afterwards.
    """
    rows = ordered(df, F.col(key), *order)
    parts = rows.groupBy(key, "_pid").agg(F.min("_idx").alias("_low"), F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        key,
        "_pid",
        "_low",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(key)).alias("_total"),
    )
    return (
        rows.join(parts, [key, "_pid"])
        .withColumn("_rank", F.col("_before") + F.col("_idx") - F.col("_low"))
        .drop("_pid", "_idx", "_low", "_before")
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected links ``a``, ``b`` (bigint): ``node``, ``root`` (smallest node).

    Large-star and small-star rounds in turn, each staged. Minima are pre-aggregated, and a hub meets its
    neighbours in a join that the runtime can split, so no task holds all links of a node.
    """

    def shape(pairs: DataFrame):
        mark = F.xxhash64("hi", "lo")
        return pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))"), F.sum(F.shiftright(mark, 20))).first()

    pairs = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    seen = shape(pairs)
    while seen[0]:
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(lowest, "hi")
            .where("lo <> m")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(lowest.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        pairs = staged(small)
        now = shape(pairs)
        if now == seen:
            break
        seen = now
    roots = pairs.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)
