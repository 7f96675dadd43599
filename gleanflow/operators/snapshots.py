"""Folded outbox entries in levels, so that the present state is read without its history.

A level is an immutable table of entries as they were after the event ``high`` of the log, one row per id that the level knows; a
removed entry is a row with the status ``removed``. Newer levels win over older ones. Folding later events writes a small
new level that holds only the ids that occur in them, and a level is merged into the next one when it has reached a fixed share of its
rows, so each row is rewritten a number of times that grows with the logarithm of the entries. The manifest names the levels, the
event that they reach and the entries per status; it is written last and replaces its predecessor as a whole.

Levels are bucketed by id. A join with a batch of ids moves the batch to the buckets and leaves the stored side where it is. Within
a bucket rows are sorted by status, so a scan for one status skips the row groups of the others.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanflow.contract import OUTBOX_STATUSES
from gleanflow.operators import outbox as ob
from gleanflow.operators.folders import committed, names_in, remove_folder, staged

REMOVED = "removed"
COLUMNS = "id STRING, status STRING, attempts BIGINT, last_error STRING, updated_at STRING, target STRING, born BIGINT"
NAMES = [part.split()[0] for part in COLUMNS.split(", ")]
# A level is merged into the next when it has a fourth of its rows.
SHARE = 4


@dataclass(frozen=True)
class Level:
    name: str
    rows: int


@dataclass(frozen=True)
class Manifest:
    """Levels (newest first), the last event that they hold and the entries per status."""

    version: int
    high: int
    buckets: int
    levels: tuple[Level, ...] = ()
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(OUTBOX_STATUSES, 0))

    def to_json(self) -> str:
        levels = [[level.name, level.rows] for level in self.levels]
        return json.dumps({"version": self.version, "high": self.high, "buckets": self.buckets, "levels": levels, "counts": self.counts})

    @staticmethod
    def from_json(text: str) -> "Manifest":
        held = json.loads(text)
        return Manifest(held["version"], held["high"], held["buckets"], tuple(Level(*x) for x in held["levels"]), held["counts"])


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], COLUMNS)


@dataclass(frozen=True)
class Snapshots:
    """The levels below one folder. ``buckets`` holds for a new folder only; by default it is the number of shuffle partitions."""

    spark: SparkSession
    root: str
    buckets: int | None = None

    # --- manifest ---------------------------------------------------------------------

    def _versions(self) -> list[int]:
        found = names_in(self.spark, f"{self.root}/manifests")
        return [int(name.split("=")[1]) for name in found if committed(self.spark, f"{self.root}/manifests/{name}")]

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest one, or one before the first event."""
        if version is None:
            version = max(self._versions(), default=None)
        if version is None:
            return Manifest(-1, -1, self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return Manifest.from_json(self.spark.read.text(f"{self.root}/manifests/version={version:012d}").first()[0])

    def _publish(self, manifest: Manifest) -> Manifest:
        text = self.spark.createDataFrame([(manifest.to_json(),)], "value string").coalesce(1)
        text.write.mode("overwrite").text(f"{self.root}/manifests/version={manifest.version:012d}")
        return manifest

    def forget(self, keep: int = 2) -> list[str]:
        """Deletes what the last ``keep`` manifests do not need; returns the names of the deleted levels."""
        versions = sorted(self._versions())
        old, kept = versions[:-keep], versions[-keep:]
        needed = {level.name for v in kept for level in self.manifest(v).levels}
        for version in old:
            remove_folder(self.spark, f"{self.root}/manifests/version={version:012d}")
        gone = [name for name in names_in(self.spark, f"{self.root}/levels") if name not in needed]
        for name in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table_name(name)}")
            remove_folder(self.spark, f"{self.root}/levels/{name}")
        return gone

    # --- levels -----------------------------------------------------------------------

    def _table_name(self, level: str) -> str:
        return "gleanflow_level_" + hashlib.md5(f"{self.root}/{level}".encode()).hexdigest()

    def _level(self, level: Level, buckets: int) -> DataFrame:
        """The level as a bucketed table; a session that did not write it gets to know it here."""
        name = self._table_name(level.name)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS}) USING parquet CLUSTERED BY (id) SORTED BY (status, id) "
            f"INTO {buckets} BUCKETS LOCATION '{self.root}/levels/{level.name}'"
        )
        return self.spark.table(name)

    def _write(self, rows: DataFrame, buckets: int) -> Level:
        name = uuid.uuid4().hex
        writer = rows.select(*NAMES).repartition(buckets, "id").write.format("parquet")
        writer = writer.bucketBy(buckets, "id").sortBy("status", "id").option("path", f"{self.root}/levels/{name}")
        writer.saveAsTable(self._table_name(name))
        return Level(name, self.spark.table(self._table_name(name)).count())

    def _overlaid(self, tables: Sequence[DataFrame], status: str | None = None) -> DataFrame:
        """Rows of all levels (newest first) that no newer level replaces, of one status if it is given."""
        rows = []
        for i, level in enumerate(tables):
            some = level if status is None else level.where(F.col("status") == status)
            for newer in tables[:i]:
                some = some.join(newer.select("id"), "id", "left_anti")
            rows.append(some)
        return reduce(DataFrame.unionByName, rows) if rows else nothing(self.spark)

    # --- reading ----------------------------------------------------------------------

    def stored(self, status: str | None = None, manifest: Manifest | None = None) -> DataFrame:
        """All entries of the levels, or those of one status."""
        manifest = manifest or self.manifest()
        tables = [self._level(level, manifest.buckets) for level in manifest.levels]
        return self._overlaid(tables, status).where(F.col("status") != REMOVED).select(*NAMES)

    def lookup(self, ids: DataFrame, manifest: Manifest | None = None) -> DataFrame:
        """Entries of the distinct ``ids``. The ids move to the buckets; the stored side does not move."""
        manifest = manifest or self.manifest()
        found = [
            self._level(level, manifest.buckets).join(ids.select("id"), "id", "left_semi").withColumn("_age", F.lit(age))
            for age, level in enumerate(manifest.levels)
        ]
        if not found:
            return nothing(self.spark)
        if len(found) == 1:
            rows = found[0].drop("_age")
        else:
            # Of the ids asked for only, so these are few.
            rest = F.struct(*NAMES[1:])
            newest = reduce(DataFrame.unionByName, found).groupBy("id").agg(F.min_by(rest, "_age").alias("_e"))
            rows = newest.select("id", "_e.*")
        return rows.where(F.col("status") != REMOVED).select(*NAMES)

    def state(self, later: DataFrame, status: str | None = None, manifest: Manifest | None = None) -> DataFrame:
        """Entries of the levels with the ``later`` events on top."""
        manifest = manifest or self.manifest()
        touched = later.select("id").distinct()
        calm = self.stored(status, manifest).join(touched, "id", "left_anti")
        changed = ob.outbox_state(later, self.lookup(touched, manifest))
        return calm.unionByName(changed if status is None else changed.where(F.col("status") == status))

    def counts(self, later: DataFrame, manifest: Manifest | None = None) -> dict[str, int]:
        """Entries per status after the ``later`` events; reads these and the entries that they touch."""
        manifest = manifest or self.manifest()
        later = staged(later)
        known = staged(self.lookup(later.select("id").distinct(), manifest))
        return self._changed_counts(manifest, known, ob.outbox_state(later, known))

    def _changed_counts(self, manifest: Manifest, known: DataFrame, entries: DataFrame) -> dict[str, int]:
        """Counts once the ``known`` entries have become ``entries``."""
        steps = known.select("status", F.lit(-1).alias("n")).unionByName(entries.select("status", F.lit(1).alias("n")))
        change = dict(steps.groupBy("status").agg(F.sum("n")).collect())
        return {status: manifest.counts[status] + change.get(status, 0) for status in OUTBOX_STATUSES}

    # --- folding ----------------------------------------------------------------------

    def advance(self, later: DataFrame, high: int) -> Manifest:
        """Folds the events after the manifest's ``high``, up to ``high``, into the levels."""
        before = self.manifest()
        if high <= before.high:
            return before
        later = staged(later)
        touched = later.select("id").distinct()
        known = staged(self.lookup(touched, before))
        entries = ob.outbox_state(later, known)
        gone = touched.join(entries.select("id"), "id", "left_anti").select(
            "id", F.lit(REMOVED).alias("status"), F.lit(0).cast("bigint").alias("attempts"),
            *[F.lit(None).cast("string").alias(name) for name in ("last_error", "updated_at", "target")],
            F.lit(None).cast("bigint").alias("born"),
        )
        levels = [self._write(entries.unionByName(gone), before.buckets), *before.levels]
        newest = self._level(levels[0], before.buckets)
        counts = before.counts | self._changed_counts(before, known, newest.where(F.col("status") != REMOVED))
        merged, rows = 1, levels[0].rows
        while merged < len(levels) and rows * SHARE >= levels[merged].rows:
            rows += levels[merged].rows
            merged += 1
        if merged > 1:
            whole = self._overlaid([self._level(level, before.buckets) for level in levels[:merged]])
            if merged == len(levels):
                # Nothing older is left that a removed row would have to hide.
                whole = whole.where(F.col("status") != REMOVED)
            levels = [self._write(whole, before.buckets), *levels[merged:]]
        return self._publish(Manifest(before.version + 1, high, before.buckets, tuple(levels), counts))
