"""Incremental runs as Structured Streaming queries: one scheduled run is one ``availableNow`` trigger.

Ids are derived from content and every micro-batch writes its own batch folder, so a replayed
batch changes nothing. Repeats that come close to each other are dropped in stream state; beyond that, stored ids decide what is new.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanflow.contract import RunContext
from gleanflow.operators import changes
from gleanflow.operators import delivery as dl
from gleanflow.operators.tables import Checkpoints, Outbox, read_table, shared_folder, staged, write_batch
from gleanflow.sources.web import web_captures, web_rejects


def stream_captures(
    responses: DataFrame, run: RunContext, path: str, checkpoint: str, rejects: str | None = None
) -> StreamingQuery:
    """Captures of a stream of crawl responses, one batch folder per micro-batch below ``path``.

    Pages that can't be taken go to ``rejects`` in the same way (``url, problem``); without such a folder one fails the stream.
    """

    def collect(batch: DataFrame, epoch: int) -> None:
        refused = staged(web_rejects(batch))
        if rejects is not None:
            write_batch(refused, rejects, f"{epoch:012d}")
        elif (bad := refused.first()) is not None:
            raise ValueError(f"{bad['url']}: {bad['problem']}")
        write_batch(web_captures(batch, run), path, f"{epoch:012d}")

    return (
        responses.writeStream.foreachBatch(collect)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def without_repeats(captures: DataFrame, remember: str) -> DataFrame:
    """Captures whose id did not come in the time ``remember``, across micro-batches.

    The time is that of processing, so no capture is ever late and none but repeats are dropped, and state holds the ids of that
    time only. An id that is removed from the outbox and comes again within it counts as a repeat.
    """
    seen = captures.withColumn("_seen", F.current_timestamp()).withWatermark("_seen", remember)
    return seen.dropDuplicatesWithinWatermark(["id"]).drop("_seen")


def enqueue_in_order(outbox: Outbox, batch: DataFrame, name: str) -> int:
    """Of equal ids in a micro-batch the first row counts. The rows are stored once, with their places."""
    rows = staged(batch.withColumn("_place", F.monotonically_increasing_id()))
    return outbox.enqueue(rows, name, F.col("_place"))


def stream_enqueue(
    captures: DataFrame, outbox: Outbox, checkpoint: str, name: str = "stream", remember: str | None = "1 day"
) -> StreamingQuery:
    """Idempotent enqueue of a stream of captures; ``remember=None`` leaves all repeats to the stored ids."""

    def enqueue(batch: DataFrame, epoch: int) -> None:
        enqueue_in_order(outbox, batch, f"{name}-{epoch:012d}")

    rows = captures if remember is None else without_repeats(captures, remember)
    return (
        rows.writeStream.foreachBatch(enqueue)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


OPEN_ENTRIES = "scan_id long, instance_id string, path string, type string, sha string, entries long, since long"


def complete_snapshots(rows: DataFrame) -> DataFrame:
    """``instance_id, scan_id`` of the newest snapshot of each instance that has as many paths as ``entries`` says."""
    sizes = rows.groupBy("instance_id", "scan_id").agg(F.count("*").alias("n"), F.max("entries").alias("entries"))
    whole = sizes.where(F.col("n") >= F.col("entries"))
    return whole.groupBy("instance_id").agg(F.max("scan_id").alias("scan_id"))


def stream_changes(
    listings: DataFrame,
    sources: DataFrame,
    checkpoints: Checkpoints,
    run: RunContext,
    path: str,
    checkpoint: str,
    patience: int | None = None,
) -> StreamingQuery:
    """Changed files of a stream of listing snapshots ``(scan_id, instance_id, path, type, sha)``.

    With a column ``entries`` (number of paths of the snapshot) a snapshot may be split over micro-batches: its rows wait in the table
    ``<path>-open``, which each micro-batch writes anew without what it has used, and change nothing until the last one is there. Paths that
    come twice count once. A snapshot that a newer complete one overtakes is dropped; one that waits for more than ``patience`` micro-batches is
    dropped too and listed in ``<path>-expired``. Without the column, a snapshot must arrive whole within one micro-batch.

    A truncated listing fails the micro-batch and leaves the checkpoint. Versions come from the checkpoint table
    itself, so streams with new folders and batch runs may take turns. Of several snapshots of an instance in
    a batch the newest counts and replaces the checkpoint of the instance.
    """

    def gathered(batch: DataFrame, epoch: int) -> tuple[DataFrame, DataFrame]:
        """Rows of the newest whole snapshots, and which these are; the other rows are kept for the next micro-batch."""
        spark, waiting = batch.sparkSession, f"{path}-open"
        schema = spark.createDataFrame([], OPEN_ENTRIES).schema
        earlier = read_table(spark, waiting, schema, [f"batch={epoch - 1:012d}"] if epoch else []).drop("batch")
        fresh = batch.select(*[n for n in schema.names if n != "since"], F.lit(epoch).cast("long").alias("since"))
        rows = earlier.unionByName(fresh).groupBy("instance_id", "scan_id", "path").agg(
            F.min_by(F.struct("type", "sha", "entries", "since"), "since").alias("_r")
        )
        rows = staged(rows.select("instance_id", "scan_id", "path", "_r.*"))
        whole = staged(complete_snapshots(rows))
        done = whole.select("instance_id", F.col("scan_id").alias("_done"))
        rest = rows.join(done, "instance_id", "left").where(F.col("_done").isNull() | (F.col("scan_id") > F.col("_done"))).drop("_done")
        if patience is not None:
            starts = rest.groupBy("instance_id", "scan_id").agg(F.min("since").alias("_first"), F.count("*").alias("arrived"), F.max("entries").alias("entries"))
            late = staged(starts.where(F.col("_first") + patience < epoch))
            write_batch(late.select("instance_id", "scan_id", "arrived", "entries"), f"{path}-expired", f"{epoch:012d}")
            rest = rest.join(late.select("instance_id", "scan_id"), ["instance_id", "scan_id"], "left_anti")
        write_batch(rest.select(*schema.names), waiting, f"{epoch:012d}")
        return rows.join(whole, ["instance_id", "scan_id"], "left_semi"), whole

    def detect(batch: DataFrame, epoch: int) -> None:
        if "entries" in batch.columns:
            listing, newest = gathered(batch, epoch)
        else:
            batch = staged(batch)
            newest = batch.groupBy("instance_id").agg(F.max("scan_id").alias("scan_id"))
            listing = batch.join(newest, ["instance_id", "scan_id"], "left_semi")
        present = changes.require_complete(sources.join(newest, "instance_id", "left_semi"))
        files = changes.document_files(listing, present)
        version = checkpoints.version_for(checkpoint, epoch)
        headers, before = checkpoints.headers(version), checkpoints.files(version)
        known = changes.valid_checkpoint_files(before, headers, present)
        unchanged = changes.unchanged_sources(present, headers)
        changed = changes.changed_files(files, known, unchanged)
        write_batch(changed.select("instance_id", "path", "sha"), path, f"{epoch:012d}")
        if newest.isEmpty():
            return
        done = changed.sparkSession.read.parquet(f"{path}/batch={epoch:012d}")
        following = changes.next_checkpoint_headers(present, files, done, run)
        checkpoints.replace(staged(following), changes.next_checkpoint_files(files), version)

    return (
        listings.writeStream.foreachBatch(detect)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_sync(
    captures: DataFrame,
    outbox: Outbox,
    target: dl.Target,
    send: Callable[[str, str], str | None],
    checkpoint: str,
    name: str = "sync",
    compact_every: int = 10,
) -> StreamingQuery:
    """Enqueue a stream of captures and deliver what is pending after each micro-batch.

    Every ``compact_every`` micro-batches the outbox moves its snapshot on, so a batch does not cost more as history grows.
    """

    def deliver(batch: DataFrame, epoch: int) -> None:
        from gleanflow.plans.run import sync

        enqueue_in_order(outbox, batch, f"{name}-{epoch:012d}")
        sync(outbox, target, f"{name}-sent-{epoch:012d}", send=send)
        if epoch % compact_every == compact_every - 1:
            outbox.compact()

    return (
        captures.writeStream.foreachBatch(deliver)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
