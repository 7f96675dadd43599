"""Idempotent outbox as an append-only log.

An entry is the fold of its events. Allowed events: ``enqueue``, the three marks
``pending``/``sent``/``failed`` and ``remove``. ``seq`` is the unique log position.
Every aggregation keeps partial (map-side) state, so one id may own any share of the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanflow.contract import OUTBOX_STATUSES
from gleanflow.operators.layout import salted_join

EVENTS_PER_BLOCK = 1_000_000


def _is_mark() -> Column:
    return F.col("event").isin(*OUTBOX_STATUSES)


# --- enqueue ------------------------------------------------------------------


def first_per_id(captures: DataFrame, order_by: Column, key: str = "id") -> DataFrame:
    """First row of every id in the given order; copies collapse before the shuffle."""
    rest = [name for name in captures.columns if name != key]
    return (
        captures.groupBy(key)
        .agg(F.min_by(F.struct(*rest), order_by).alias("_first"))
        .select(key, "_first.*")
        .select(*captures.columns)
    )


def new_entries(captures: DataFrame, stored: DataFrame, order_by: Column) -> DataFrame:
    """Captures to append: one per id, and none whose id is stored in any status."""
    known = stored.select("id").distinct()
    return first_per_id(captures, order_by).join(known, "id", "left_anti")


def enqueue_events(entries: DataFrame, seq: Column, at: Column) -> DataFrame:
    return entries.select(
        seq.cast("bigint").alias("seq"),
        "id",
        F.lit("enqueue").alias("event"),
        F.lit(None).cast("string").alias("error"),
        at.alias("at"),
        F.lit(None).cast("string").alias("target"),
    )


def run_report(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: rows collected and rows that were new."""
    collected = captures.agg(F.count("*").alias("collected"), F.lit(0).cast("bigint").alias("enqueued"))
    enqueued = entries.agg(F.lit(0).cast("bigint").alias("collected"), F.count("*").alias("enqueued"))
    return collected.unionByName(enqueued).agg(
        F.sum("collected").alias("collected"), F.sum("enqueued").alias("enqueued")
    )


def privacy_conflicts(captures: DataFrame, stored: DataFrame) -> DataFrame:
    """Re-submissions that are stricter than the stored capture, which stays as it is."""
    rank = lambda level: F.array_position(
        F.array(*[F.lit(x) for x in ("public", "private", "sensitive")]), level
    )
    strictest = captures.groupBy("id").agg(F.max(rank(F.col("privacy.level"))).alias("_asked"))
    kept = stored.select("id", rank(F.col("privacy.level")).alias("_kept"))
    names = F.array(*[F.lit(x) for x in ("public", "private", "sensitive")])
    return (
        strictest.join(kept, "id")
        .where(F.col("_asked") > F.col("_kept"))
        .select(
            "id",
            F.element_at(names, F.col("_kept").cast("int")).alias("stored_level"),
            F.element_at(names, F.col("_asked").cast("int")).alias("requested_level"),
        )
    )


# --- fold ---------------------------------------------------------------------


def _with_epoch(log: DataFrame, block: int = EVENTS_PER_BLOCK) -> DataFrame:
    """Number of removals of the id before each event.

    Only ids that were ever removed are counted, in two levels: totals per (id, block of
    log positions), then a window inside one block, which holds at most ``block`` events.
    """
    removed = log.where(F.col("event") == "remove").select("id").distinct()
    calm = log.join(removed, "id", "left_anti").withColumn("epoch", F.lit(0).cast("bigint"))
    hit = log.join(removed, "id", "left_semi").withColumn("_block", F.floor(F.col("seq") / block))
    is_remove = (F.col("event") == "remove").cast("bigint")
    before_block = W.partitionBy("id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    in_block = W.partitionBy("id", "_block").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        hit.groupBy("id", "_block")
        .agg(F.sum(is_remove).alias("_n"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(before_block), F.lit(0)))
        .drop("_n")
    )
    counted = (
        hit.join(totals, ["id", "_block"])
        .withColumn("epoch", F.col("_base") + F.coalesce(F.sum(is_remove).over(in_block), F.lit(0)))
        .drop("_block", "_base")
    )
    return calm.unionByName(counted)


def _lives(log: DataFrame) -> DataFrame:
    """One row per (id, epoch): birth, marks and last mark, in one aggregation.

    The last status comes from a packed number, so counting statuses stays a hash
    aggregation; texts of the last mark are only carried when they are selected.
    """
    enqueued = F.col("event") == "enqueue"
    code = F.when(F.col("event") == "sent", 1).when(F.col("event") == "failed", 2).otherwise(0)
    mark_seq = F.when(_is_mark(), F.col("seq"))
    return log.groupBy("id", "epoch").agg(
        F.min(F.when(enqueued, F.col("seq"))).alias("born"),
        F.min(mark_seq).alias("first_mark"),
        F.max(F.when(_is_mark(), F.col("seq") * 4 + code)).alias("_last"),
        F.count_if(F.col("event") == "failed").alias("_failed"),
        F.count_if(F.col("event") == "remove").alias("_removed"),
        F.min_by("at", F.when(enqueued, F.col("seq"))).alias("_born_at"),
        F.max_by(F.struct("error", "at", "target"), mark_seq).alias("_mark"),
    )


def _orphan_marks(log: DataFrame, lives: DataFrame) -> DataFrame:
    """Marks of an id that was not in the outbox at that position."""
    suspect = lives.where(
        F.col("first_mark").isNotNull()
        & (F.col("born").isNull() | (F.col("first_mark") < F.col("born")))
    ).select("id", "epoch", "born")
    marks = log.where(_is_mark())
    return salted_join(marks, suspect, ["id", "epoch"], ["seq"]).where(
        F.col("born").isNull() | (F.col("seq") < F.col("born"))
    )


def outbox_state(log: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Current entries: ``id, status, attempts, last_error, updated_at, target, born``.

    ``base`` has entries as they were before the first event of ``log``; the result has the ids of the log only.
    """
    log = _with_epoch(log)
    lives = _lives(log)
    if base is not None:
        return _state_onto(log, lives, base)
    early = (
        _orphan_marks(log, lives)
        .where(F.col("event") == "failed")
        .groupBy("id", "epoch")
        .agg(F.count("*").alias("_early"))
    )
    marked = F.shiftright(F.col("_last"), 2) > F.col("born")
    status = F.element_at(
        F.array(*[F.lit(name) for name in OUTBOX_STATUSES]),
        F.when(marked, F.pmod(F.col("_last"), F.lit(4)) + 1).otherwise(1).cast("int"),
    )
    return (
        lives.where(F.col("born").isNotNull() & (F.col("_removed") == 0))
        .join(early, ["id", "epoch"], "left")
        .select(
            "id",
            status.alias("status"),
            (F.col("_failed") - F.coalesce(F.col("_early"), F.lit(0))).alias("attempts"),
            F.when(marked, F.col("_mark.error")).alias("last_error"),
            F.when(marked, F.col("_mark.at")).otherwise(F.col("_born_at")).alias("updated_at"),
            F.when(marked, F.col("_mark.target")).alias("target"),
            "born",
        )
    )


def _state_onto(log: DataFrame, lives: DataFrame, base: DataFrame) -> DataFrame:
    """An entry of ``base`` goes on in the life before the first removal: it was born there, earlier than all events."""
    held = base.select("id", F.struct("status", "attempts", "last_error", "updated_at", "target", "born").alias("_base"))
    lives = lives.join(held, "id", "left").withColumn("_base", F.when(F.col("epoch") == 0, F.col("_base")))
    lives = lives.withColumn("born", F.coalesce("_base.born", "born"))
    early = (
        _orphan_marks(log, lives)
        .where(F.col("event") == "failed")
        .groupBy("id", "epoch")
        .agg(F.count("*").alias("_early"))
    )
    marked = F.shiftright(F.col("_last"), 2) > F.col("born")
    names = F.array(*[F.lit(name) for name in OUTBOX_STATUSES])
    last = F.element_at(names, (F.pmod(F.col("_last"), F.lit(4)) + 1).cast("int"))
    earlier = F.coalesce(F.col("_base.attempts"), F.lit(0))
    return (
        lives.where(F.col("born").isNotNull() & (F.col("_removed") == 0))
        .join(early, ["id", "epoch"], "left")
        .select(
            "id",
            F.when(marked, last).otherwise(F.coalesce("_base.status", F.lit(OUTBOX_STATUSES[0]))).alias("status"),
            (earlier + F.col("_failed") - F.coalesce(F.col("_early"), F.lit(0))).alias("attempts"),
            F.when(marked, F.col("_mark.error")).otherwise(F.col("_base.last_error")).alias("last_error"),
            F.when(marked, F.col("_mark.at")).otherwise(F.coalesce("_base.updated_at", "_born_at")).alias("updated_at"),
            F.when(marked, F.col("_mark.target")).otherwise(F.col("_base.target")).alias("target"),
            "born",
        )
    )


def stored_ids(log: DataFrame) -> DataFrame:
    """Ids that are in the outbox in any status; only numbers are aggregated."""
    lives = _lives(_with_epoch(log))
    return lives.where(F.col("born").isNotNull() & (F.col("_removed") == 0)).select("id")


def rejected_marks(log: DataFrame) -> DataFrame:
    """Marks of unknown entries, with the message of the failed call."""
    log = _with_epoch(log)
    return _orphan_marks(log, _lives(log)).select(
        "seq", "id", "event", unknown_entry(F.col("id")).alias("error")
    )


def unknown_entry(identifier: Column) -> Column:
    return F.concat(F.lit("Unknown outbox entry: "), identifier)


# --- reads --------------------------------------------------------------------


def file_order(identifier: Column) -> Column:
    """Sort key of an entry: entries are visited in the order of their file names."""
    return F.concat(identifier, F.lit(".json"))


def outbox_list(entries: DataFrame, status: str | None = None) -> DataFrame:
    """All entries, or those of one status. Sort by ``file_order`` at the very end if needed."""
    if status is None:
        return entries
    if status not in OUTBOX_STATUSES:
        raise ValueError(f"Unknown outbox status: {status}")
    return entries.where(F.col("status") == status)


def outbox_summary(entries: DataFrame) -> DataFrame:
    return entries.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == name).alias(name) for name in OUTBOX_STATUSES],
    )


def retry_events(entries: DataFrame, seq: Column, at: Column, ids: DataFrame | None = None) -> DataFrame:
    """``pending`` marks for failed entries, all of them or those in ``ids``."""
    failed = outbox_list(entries, "failed")
    if ids is not None:
        failed = failed.join(ids.select("id").distinct(), "id", "left_semi")
    return failed.select(
        seq.cast("bigint").alias("seq"),
        "id",
        F.lit("pending").alias("event"),
        F.lit(None).cast("string").alias("error"),
        at.alias("at"),
        F.lit(None).cast("string").alias("target"),
    )
