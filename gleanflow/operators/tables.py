"""Where a pipeline keeps its tables: append-only Parquet folders in the shared directory.

Every write goes to its own ``batch=<name>`` folder in overwrite mode. Repeating a batch after a
crash replaces the same folder, so replays change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanflow.contract import (
    CAPTURE_SCHEMA,
    CHECKPOINT_FILES_SCHEMA,
    CHECKPOINT_HEADER_SCHEMA,
    OUTBOX_EVENT_SCHEMA,
    utc_now,
)
from gleanflow.operators import outbox as ob
from gleanflow.operators.folders import committed, names_in, remove_folder, shared_folder, staged
from gleanflow.operators.snapshots import Manifest, Snapshots


def read_table(spark: SparkSession, path: str, schema: T.StructType, folders: list[str] | None = None) -> DataFrame:
    """The Parquet folder, or only some of its ``batch=`` folders; no rows while nothing was written yet."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.StringType(), True)])
    if folders is not None and not folders:
        return spark.createDataFrame([], full)
    reader = spark.read.schema(full).option("mergeSchema", "false")
    try:
        if folders is None:
            return reader.parquet(path)
        return reader.option("basePath", path).parquet(*[f"{path}/{folder}" for folder in folders])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def write_batch(df: DataFrame, path: str, batch: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


STORED_CAPTURE = T.StructType([*CAPTURE_SCHEMA.fields, T.StructField("seq", T.LongType(), True)])


@dataclass(frozen=True)
class Batch:
    """A batch folder: its place in the log and its name."""

    seq: int
    name: str

    @property
    def folder(self) -> str:
        return f"{self.seq:012d}-{self.name}"


@dataclass(frozen=True)
class Outbox:
    """Captures and marks below one folder. A stored capture is its own enqueue event.

    A batch folder carries its place in the log in its name, so what lies before a snapshot is neither listed in a plan nor read.
    ``compact`` moves the snapshot on; until then all batches are folded.
    """

    spark: SparkSession
    root: str
    buckets: int | None = None

    @property
    def _captures(self) -> str:
        return f"{self.root}/captures"

    @property
    def _marks(self) -> str:
        return f"{self.root}/marks"

    @property
    def snapshots(self) -> Snapshots:
        return Snapshots(self.spark, f"{self.root}/snapshots", self.buckets)

    def _batches(self, path: str) -> list[Batch]:
        found = [name.partition("=")[2] for name in names_in(self.spark, path) if name.startswith("batch=")]
        return [Batch(int(name[:12]), name[13:]) for name in found]

    def _read(self, path: str, schema: T.StructType, batches: list[Batch]) -> DataFrame:
        return read_table(self.spark, path, schema, [f"batch={b.folder}" for b in batches])

    def captures(self, seqs: set[int] | None = None) -> DataFrame:
        """Stored captures, of all batches or of those at the places ``seqs``."""
        batches = [b for b in self._batches(self._captures) if seqs is None or b.seq in seqs]
        return self._read(self._captures, STORED_CAPTURE, batches)

    def log(self, without: str | None = None, after: int = -1) -> DataFrame:
        """Events after a place in the log; ``without`` leaves one batch unread, as when it is being replaced."""
        later = lambda path: [b for b in self._batches(path) if b.seq > after and b.name != without]
        captures = self._read(self._captures, STORED_CAPTURE, later(self._captures))
        marks = self._read(self._marks, OUTBOX_EVENT_SCHEMA, later(self._marks))
        born = ob.enqueue_events(captures, F.col("seq"), F.col("captured_at"))
        return born.unionByName(marks.drop("batch"))

    def entries(self, status: str | None = None) -> DataFrame:
        """Present entries, of one status if it is given: a snapshot and the batches after it."""
        manifest = self.snapshots.manifest()
        return self.snapshots.state(self.log(after=manifest.high), status, manifest)

    def stored(self, ids: DataFrame, without: str | None = None) -> DataFrame:
        """Those of the ``ids`` that are in the outbox in any status."""
        manifest = self.snapshots.manifest()
        wanted = ids.select("id").distinct()
        later = self.log(without, manifest.high).join(wanted, "id", "left_semi")
        base = self.snapshots.lookup(wanted, manifest)
        calm = base.join(later.select("id").distinct(), "id", "left_anti").select("id")
        return calm.unionByName(ob.outbox_state(later, base).select("id"))

    def summary(self) -> dict[str, int]:
        """Entries in all and per status; entries that nothing touched since the snapshot are not read."""
        manifest = self.snapshots.manifest()
        counts = self.snapshots.counts(self.log(after=manifest.high), manifest)
        return {"total": sum(counts.values()), **counts}

    def next_seq(self) -> int:
        """The first free place in the log, from the names of the folders."""
        places = [b.seq for path in (self._captures, self._marks) for b in self._batches(path)]
        return max([self.snapshots.manifest().high, *places]) + 1

    def _place(self, path: str, name: str) -> tuple[Batch, bool]:
        """Where a batch goes, and whether it is written already: then a replay has nothing to do.

        A batch whose job broke off keeps its place, unless a snapshot has moved past it.
        """
        same = [b for b in self._batches(path) if b.name == name]
        for batch in same:
            if committed(self.spark, f"{path}/batch={batch.folder}"):
                return batch, True
        high = self.snapshots.manifest().high
        return next((b for b in same if b.seq > high), Batch(self.next_seq(), name)), False

    def enqueue(self, captures: DataFrame, batch: str, order_by=None) -> int:
        """Append the captures that are new; returns how many there were.

        A batch that was written before is left as it is. Of equal ids the first by ``order_by`` counts, by default the smallest row.
        """
        place, written = self._place(self._captures, batch)
        if written:
            return 0
        if order_by is None:
            order_by = F.struct(*CAPTURE_SCHEMA.names)
        # A removed id may come back; anything else that is stored stays as it is.
        new = ob.new_entries(captures, self.stored(captures, without=batch), order_by)
        counted = Observation()
        new = new.select(*CAPTURE_SCHEMA.names, F.lit(place.seq).cast("bigint").alias("seq")).observe(counted, F.count("*").alias("n"))
        write_batch(new, self._captures, place.folder)
        return counted.get["n"]

    def unused_batch(self, name: str) -> str:
        """``name``, or with a number added where marks of that name exist: outcomes are never replaced."""
        taken = {b.name.partition(".")[0] for b in self._batches(self._marks)}
        attempt, free = 0, name
        while free in taken:
            attempt += 1
            free = f"{name}-{attempt}"
        return free

    def append(self, events: DataFrame, batch: str) -> int:
        """Write marks ``id, event, error, at, target`` as one batch; returns its place. A batch that was written before stays."""
        place, written = self._place(self._marks, batch)
        if not written:
            seq = F.lit(place.seq).cast("bigint").alias("seq")
            names = [name for name in OUTBOX_EVENT_SCHEMA.names if name != "seq"]
            write_batch(events.select(seq, *names), self._marks, place.folder)
        return place.seq

    def batch_marks(self, *batches: str) -> DataFrame:
        found = [b for b in self._batches(self._marks) if b.name in batches]
        return self._read(self._marks, OUTBOX_EVENT_SCHEMA, found)

    def batch_captures(self, batch: str) -> DataFrame:
        found = [b for b in self._batches(self._captures) if b.name == batch]
        return self._read(self._captures, STORED_CAPTURE, found)

    def mark(self, ids: DataFrame, event: str, batch: str, error: str | None = None) -> DataFrame:
        """One mark per distinct id: ``pending``, ``sent``, ``failed`` or ``remove``.

        Returns the marks of unknown entries (``seq, id, event, error``); they change nothing. No rows: all are known.
        """
        marks = ids.select("id").distinct().select(
            "id",
            F.lit(event).alias("event"),
            F.lit(error).cast("string").alias("error"),
            F.lit(utc_now()).alias("at"),
            F.lit(None).cast("string").alias("target"),
        )
        known = self.stored(ids, without=batch)
        seq = self.append(marks, batch)
        unknown = self.batch_marks(batch).where(F.col("event") != "remove").join(known, "id", "left_anti")
        return unknown.select(
            F.lit(seq).cast("bigint").alias("seq"), "id", "event", ob.unknown_entry(F.col("id")).alias("error")
        )

    def retry(self, batch: str, ids: DataFrame | None = None) -> int:
        """Failed entries back to pending; attempts stay. Returns how many."""
        manifest = self.snapshots.manifest()
        entries = self.snapshots.state(self.log(batch, manifest.high), "failed", manifest)
        self.append(ob.retry_events(entries, F.lit(0), F.lit(utc_now()), ids), batch)
        return self.batch_marks(batch).count()

    def bodies(self, entries: DataFrame) -> DataFrame:
        """Stored captures of ``id, seq`` (place of birth); only batches that hold one of them are read."""
        seqs = {r[0] for r in entries.select("seq").distinct().collect()}  # one per batch at most
        return self.captures(seqs).drop("batch").join(entries.select("id", "seq"), ["id", "seq"], "left_semi")

    def pending(self) -> DataFrame:
        """Pending captures with their privacy ``level``."""
        state = self.entries("pending").select("id", F.col("born").alias("seq"))
        return self.bodies(state).withColumn("level", F.col("privacy.level"))

    def compact(self) -> Manifest:
        """Folds all batches so far into the snapshot. Entries stay the same; reads become shorter."""
        manifest = self.snapshots.manifest()
        return self.snapshots.advance(self.log(after=manifest.high), self.next_seq() - 1)


STORED_HEADER = T.StructType(
    [*CHECKPOINT_HEADER_SCHEMA.fields, T.StructField("version", T.LongType(), True), T.StructField("files_version", T.LongType(), True)]
)
STORED_FILE = T.StructType([*CHECKPOINT_FILES_SCHEMA.fields, T.StructField("version", T.LongType(), True)])


@dataclass(frozen=True)
class Checkpoints:
    """Scan state per instance, replaced by newer versions.

    A version's folder of headers lists all instances and says in which version's folder the files of each one are, so it is the
    manifest of the whole state: it is written last, and files and headers become visible together. An instance whose tree is the
    one of the last scan keeps its files where they are; only the others are written. Readers open the folders that the
    newest headers name.
    """

    spark: SparkSession
    root: str

    def _versions(self, kind: str) -> list[int]:
        names = [name.partition("=")[2] for name in names_in(self.spark, f"{self.root}/{kind}") if name.startswith("batch=")]
        return sorted(int(name) for name in names if committed(self.spark, f"{self.root}/{kind}/batch={name}"))

    def _folders(self, kind: str, schema: T.StructType, versions: list[int]) -> DataFrame:
        folders = [f"batch={v:012d}" for v in versions]
        return read_table(self.spark, f"{self.root}/{kind}", schema, folders).drop("batch")

    def headers(self, before: int | None = None) -> DataFrame:
        """Newest header of every instance, of all versions or of those before one."""
        versions = [v for v in self._versions("headers") if before is None or v < before]
        return self._folders("headers", STORED_HEADER, versions[-1:])

    def files(self, before: int | None = None) -> DataFrame:
        """File rows that belong to ``headers(before)``."""
        current = self.headers(before).select("instance_id", F.col("files_version").alias("version"))
        named = sorted(r[0] for r in current.select("version").distinct().collect())
        return self._folders("files", STORED_FILE, named).join(current, ["instance_id", "version"], "left_semi")

    def replace(self, headers: DataFrame, files: DataFrame, version: int) -> None:
        """New state of the instances in ``headers``; the others keep theirs."""
        before = staged(self.headers(version))
        known = before.where(F.col("files_tracked") & (F.col("tree_sha") != ""))
        same = known.select("instance_id", "ref", "content_dir", "tree_sha", F.col("files_version").alias("_kept"))
        given = headers.select(*CHECKPOINT_HEADER_SCHEMA.names)
        new = given.join(same, ["instance_id", "ref", "content_dir", "tree_sha"], "left").select(
            *CHECKPOINT_HEADER_SCHEMA.names,
            F.lit(version).cast("bigint").alias("version"),
            F.when(F.col("files_tracked"), F.col("_kept")).alias("files_version"),
        )
        new = staged(new.fillna(version, ["files_version"]))
        moved = new.where(F.col("files_version") == version).select("instance_id")
        rows = files.select(*CHECKPOINT_FILES_SCHEMA.names).join(moved, "instance_id", "left_semi")
        write_batch(
            rows.withColumn("version", F.lit(version).cast("bigint")).sortWithinPartitions("instance_id"),
            f"{self.root}/files", f"{version:012d}",
        )
        rest = before.join(new.select("instance_id"), "instance_id", "left_anti")
        write_batch(new.unionByName(rest), f"{self.root}/headers", f"{version:012d}")

    def compact(self) -> int:
        """All current files in one new version, so that no folder holds files of the past; returns the version."""
        version, headers = self.next_version(), staged(self.headers())
        rows = self.files().select(*CHECKPOINT_FILES_SCHEMA.names, F.lit(version).cast("bigint").alias("version"))
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # By path too, as one instance may own most of the files.
        rows = rows.repartitionByRange(parts, "instance_id", "path").sortWithinPartitions("instance_id")
        write_batch(rows, f"{self.root}/files", f"{version:012d}")
        moved = headers.withColumn("files_version", F.lit(version).cast("bigint"))
        write_batch(moved, f"{self.root}/headers", f"{version:012d}")
        return version

    def forget(self, keep: int = 2) -> list[int]:
        """Deletes versions before the last ``keep`` ones and files that none of these names; returns the deleted file versions."""
        versions = self._versions("headers")
        needed = set()
        for version in versions[-keep:]:
            rows = self._folders("headers", STORED_HEADER, [version]).select("files_version").distinct()
            needed |= {r[0] for r in rows.collect()}
        gone = [v for v in self._versions("files") if v not in needed and v <= versions[-1]] if versions else []
        for version in gone:
            remove_folder(self.spark, f"{self.root}/files/batch={version:012d}")
        for version in versions[:-keep]:
            remove_folder(self.spark, f"{self.root}/headers/batch={version:012d}")
        return gone

    def version_for(self, stream: str, epoch: int) -> int:
        """Version of one micro-batch of a stream: a new one, or that of its first attempt."""
        schema = T.StructType([T.StructField("stream", T.StringType()), T.StructField("epoch", T.LongType()),
                               T.StructField("version", T.LongType())])
        known = read_table(self.spark, f"{self.root}/epochs", schema).drop("batch")
        found = known.where((F.col("stream") == stream) & (F.col("epoch") == epoch)).agg(F.min("version")).first()[0]
        if found is not None:
            return found
        last = known.agg(F.max("version")).first()[0]
        version = max(self.next_version(), -1 if last is None else last + 1)
        row = self.spark.createDataFrame([(stream, epoch, version)], schema)
        write_batch(row, f"{self.root}/epochs", f"{version:012d}")
        return version

    def next_version(self) -> int:
        return max([-1, *self._versions("headers"), *self._versions("files")]) + 1
