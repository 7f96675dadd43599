"""Partition layout helpers: spreading small scans and joining on keys that may be hot."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanflow.operators.folders import staged


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Give CPU-heavy column work as many tasks as the cluster has cores.

    A scan with fewer partitions than cores holds at most ``cores * maxPartitionBytes``,
    so the shuffle stays small; larger scans are left as they are. Rows move by key and
    not round-robin, so a retried task produces the same partitions.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *keys)


# Narrow rows with much work each: some ten seconds a task.
ROWS_PER_TASK = 200_000


def spread_rows(scan: DataFrame, *keys: str, rows: int = ROWS_PER_TASK) -> DataFrame:
    """As :func:`spread`, for narrow rows: tasks by the number of rows, whatever the size of the scan.

    The splits of a scan don't tell how the rows lie: a row group is read by one of them as a whole, however many rows it packs.
    The count comes from the footers.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(max(cores, -(-scan.count() // rows)), *keys)


def computed(df: DataFrame, *columns: Column) -> DataFrame:
    """Adds expensive columns that must be evaluated once per row.

    A filter on a plain projected column is pushed below the projection together with a copy of
    the expression. Generated columns stay where they are.
    """
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def salted_join(
    many: DataFrame,
    one: DataFrame,
    on: Sequence[str],
    salt_by: Sequence[str],
    how: str = "inner",
    salts: int = 32,
) -> DataFrame:
    """Equi-join where a key of ``many`` may be hot and ``one`` has few, narrow rows.

    Every row of ``one`` is repeated once per salt, so a hot key meets ``salts`` tasks.
    """
    left = many.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


# Rows of keys that go to all tasks at most: some 8 MB of hashes.
FEW_KEYS = 100_000


def sent_if_few(keys: DataFrame) -> DataFrame:
    """The keys, stored and counted; few of them go to all tasks, so that the rows they pick stay where they are until then."""
    keys = staged(keys)
    return F.broadcast(keys) if keys.count() <= FEW_KEYS else keys


def hot_key_join(
    many: DataFrame,
    one: DataFrame,
    on: str,
    salt_by: Sequence[str],
    rows_per_task: int = 200_000,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Inner join of narrow ``many`` with wide ``one`` (unique on ``on``), exact under skew.

    The keys of ``many`` are counted first (partial aggregation, narrow). They pick the rows of ``one`` that are needed at
    all, and only those meet ``prepare`` and a shuffle if the keys are few; a row is repeated once per ``rows_per_task`` partners.
    ``many`` is read three times, so pass a stored table.
    """
    fan = F.ceil(F.count("*") / rows_per_task).cast("int").alias("_fan")
    needed = sent_if_few(many.groupBy(on).agg(fan))
    hot = needed.where(F.col("_fan") > 1)
    left = (
        many.join(hot, on, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.coalesce(F.col("_fan"), F.lit(1))).cast("int"))
        .drop("_fan")
    )
    right = one.join(needed, on)
    if prepare is not None:
        right = prepare(right)
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_fan") - 1))).drop("_fan")
    return left.join(right, [on, "_salt"]).drop("_salt")
