"""Instance and target settings as tables: upsert, removal, state carry-over, runnable check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanflow.contract import TRIGGERS


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Rows replaced by key at their old ``position``; new keys follow at the end in given order.

    Both sides have ``position``; in ``incoming`` the last row of a key wins.
    """
    rest = [name for name in incoming.columns if name not in (key, "position")]
    old = existing.select(
        key, F.struct(*rest).alias("_row"), F.lit(0).alias("_version"), F.col("position").alias("_at")
    )
    new = incoming.select(
        key, F.struct(*rest).alias("_row"), F.lit(1).alias("_version"), F.col("position").alias("_at")
    )
    return (
        old.unionByName(new)
        .groupBy(key)
        .agg(
            F.max_by("_row", F.struct("_version", "_at")).alias("_row"),
            F.min(F.struct("_version", "_at")).alias("position"),
        )
        .select(key, "_row.*", "position")
    )


def remove(existing: DataFrame, removed: DataFrame, key: str = "id") -> DataFrame:
    return existing.join(removed.select(key).distinct(), key, "left_anti")


def removal_report(existing: DataFrame, removed: DataFrame, key: str = "id") -> DataFrame:
    """``(id, removed)``: whether each asked id was there."""
    known = existing.select(key).distinct().withColumn("_known", F.lit(True))
    return (
        removed.select(key)
        .distinct()
        .join(known, key, "left")
        .select(key, F.col("_known").isNotNull().alias("removed"))
    )


def carry_state(requested: DataFrame, existing: DataFrame, manifests: DataFrame) -> DataFrame:
    """Instances to store: asked schedule, else the stored one, else the source default; the
    checkpoint of a stored instance is kept."""
    old = existing.select(
        "id", F.col("schedule").alias("_old_schedule"), F.col("checkpoint").alias("_old_checkpoint")
    )
    defaults = manifests.select(F.col("id").alias("connector"), "default_schedule")
    return (
        requested.join(old, "id", "left")
        .join(defaults, "connector", "left")
        .select(
            "id",
            "connector",
            "enabled",
            F.coalesce("schedule", "_old_schedule", "default_schedule").alias("schedule"),
            "config",
            F.col("_old_checkpoint").alias("checkpoint"),
        )
    )


def duplicate_manifests(manifests: DataFrame) -> DataFrame:
    return (
        manifests.groupBy("id")
        .count()
        .where(F.col("count") > 1)
        .select("id", F.concat(F.lit("Connector already registered: "), F.col("id")).alias("error"))
    )


def check_trigger(trigger: str) -> str:
    if trigger not in TRIGGERS:
        raise ValueError(f"Invalid trigger: {trigger}")
    return trigger


def runnable(instances: DataFrame, manifests: DataFrame, trigger: str = "trigger") -> DataFrame:
    """Adds ``error`` to instance rows with a trigger column: null when the run may start."""
    known = manifests.select(F.col("id").alias("connector")).distinct().withColumn("_known", F.lit(True))
    t = F.col(trigger)
    return (
        instances.join(known, "connector", "left")
        .withColumn(
            "error",
            F.coalesce(
                F.when(~F.coalesce(t.isin(*TRIGGERS), F.lit(False)), F.concat(F.lit("Invalid trigger: "), F.coalesce(t, F.lit("null")))),
                F.when(F.col("_known").isNull(), F.concat(F.lit("Unknown connector: "), F.coalesce("connector", F.lit("null")))),
                F.when(
                    ~F.coalesce("enabled", F.lit(False)) & (t != "manual"),
                    F.concat(F.lit("Connector instance is disabled: "), F.coalesce("id", F.lit("null"))),
                ),
            ),
        )
        .drop("_known")
    )
