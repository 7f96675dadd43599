"""Change detection of listings against a checkpoint.

``sources`` has one row per instance: ``instance_id, owner, repo, ref, content_dir, tree_sha,
truncated``. ``listing`` and ``files`` have one row per path. Joins with ``sources`` and the
checkpoint header carry no broadcast hint: the runtime broadcasts them only when their measured
size is below the threshold and otherwise splits skewed instances.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanflow.contract import RunContext
from gleanflow.functions.urls import repository_url

TRUNCATED = "repository tree is truncated; narrow config.content_dir before collecting"


# --- listing --------------------------------------------------------------------


def truncated_sources(sources: DataFrame) -> DataFrame:
    """Instances whose listing is partial and must not be used."""
    return sources.where(F.coalesce(F.col("truncated"), F.lit(False))).select(
        "instance_id", F.lit(TRUNCATED).alias("error")
    )


def require_complete(sources: DataFrame) -> DataFrame:
    """The same rows; a truncated listing fails the job that reads them."""
    guard = F.when(
        F.coalesce(F.col("truncated"), F.lit(False)),
        F.raise_error(F.concat(F.col("instance_id"), F.lit(f": {TRUNCATED}"))),
    )
    return sources.where(guard.cast("boolean").isNull())


def is_document_entry(kind: str = "type", path: str = "path"):
    return (F.col(kind) == "blob") & F.rlike(F.col(path), F.lit(r"(?i)\.(md|mdoc)\z"))


def document_files(listing: DataFrame, sources: DataFrame) -> DataFrame:
    """Markdown blobs inside the content directory of their instance."""
    dirs = sources.select("instance_id", F.concat("content_dir", F.lit("/")).alias("_dir"))
    return (
        listing.where(is_document_entry())
        .join(dirs, "instance_id")
        .where(F.startswith(F.col("path"), F.col("_dir")))
        .drop("_dir")
    )


def in_path_order(df: DataFrame, path: str = "path") -> DataFrame:
    """Locale order of paths; use it as the outermost step only."""
    return df.orderBy(F.collate(F.col(path), "UNICODE"))


# --- checkpoint ------------------------------------------------------------------


def valid_headers(headers: DataFrame, sources: DataFrame) -> DataFrame:
    """Headers that describe the same ref and directory and carry per-file state."""
    current = sources.select("instance_id", "ref", "content_dir")
    return headers.where(F.col("files_tracked")).join(
        current, ["instance_id", "ref", "content_dir"], "left_semi"
    )


def valid_checkpoint_files(files: DataFrame, headers: DataFrame, sources: DataFrame) -> DataFrame:
    usable = valid_headers(headers, sources).select("instance_id")
    return files.where(F.col("sha").isNotNull()).join(usable, "instance_id", "left_semi")


def unchanged_sources(sources: DataFrame, headers: DataFrame) -> DataFrame:
    """Instances whose whole tree has the hash of the last scan."""
    before = valid_headers(headers, sources).select("instance_id", "tree_sha")
    return (
        sources.where(F.col("tree_sha") != "")
        .join(before, ["instance_id", "tree_sha"], "left_semi")
        .select("instance_id")
    )


def changed_files(files: DataFrame, before: DataFrame, unchanged: DataFrame | None = None) -> DataFrame:
    """Files that are new or have another hash. Renames are new files, deletions give nothing.

    The anti-join key holds the path, so a large instance spreads over all tasks.
    """
    if unchanged is not None:
        files = files.join(unchanged.select("instance_id"), "instance_id", "left_anti")
    return files.join(
        before.select("instance_id", "path", "sha"), ["instance_id", "path", "sha"], "left_anti"
    )


def next_checkpoint_files(files: DataFrame) -> DataFrame:
    """State for the next scan: every listed document, changed or not."""
    return files.select("instance_id", "path", "sha")


def next_checkpoint_headers(
    sources: DataFrame, files: DataFrame, changed: DataFrame, run: RunContext
) -> DataFrame:
    """One header per instance. Counts are partial aggregates over the narrow file rows."""
    listed = files.groupBy("instance_id").agg(F.count("*").alias("file_count"))
    fresh = changed.groupBy("instance_id").agg(F.count("*").alias("changed"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)
    return (
        sources.join(listed, "instance_id", "left")
        .join(fresh, "instance_id", "left")
        .select(
            "instance_id",
            repository_url(F.col("owner"), F.col("repo")).alias("repository"),
            "ref",
            "content_dir",
            "tree_sha",
            F.lit(True).alias("files_tracked"),
            zero("file_count"),
            zero("changed"),
            F.lit(run.now).alias("scanned_at"),
        )
    )


def quarantined_checkpoint(
    headers: DataFrame, files: DataFrame, rejects: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Checkpoint of a run that set documents aside.

    Their paths stay out, and the tree hash of their instance is cleared, so the next scan
    neither skips the source nor takes the documents for known.
    """
    touched = rejects.select("instance_id").distinct().withColumn("_touched", F.lit(True))
    cleared = (
        headers.join(touched, "instance_id", "left")
        .withColumn("tree_sha", F.when(F.col("_touched").isNull(), F.col("tree_sha")))
        .select(*headers.columns)
    )
    kept = files.join(rejects.select("instance_id", "path"), ["instance_id", "path"], "left_anti")
    return cleared, kept
