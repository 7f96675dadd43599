"""Repository checkouts as a source: a scan of files and the object hashes that a listing service would have given.

Each folder directly below the scanned one is a checkout, and its name is the instance id. A file's hash is the SHA-1 of its blob object
(``blob <size>``, a zero byte, the bytes), a folder's that of its tree object (``tree <size>``, a zero byte, an entry per name in
byte order, folders as if they ended in a slash). Folder hashes are made from the deepest level up, one aggregation per level, so an
unchanged checkout is known by one hash and its files are known one by one, both without any service.

Names that begin with a dot or an underscore and empty files are not seen by Spark's file scan. Files count as plain ones (mode 100644). A folder's
entries are put together in one task, as its hash is one value over all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanflow.operators.folders import full_path
from gleanflow.operators.tables import staged

# Fixed values of the object format.
FILE_MODE, FOLDER_MODE = "100644", "40000"


def object_hash(kind: str, body: Column) -> Column:
    """SHA-1 of an object of the given kind."""
    head = F.concat(F.lit(f"{kind} "), F.octet_length(body).cast("string"))
    return F.sha1(F.concat(F.encode(head, "UTF-8"), F.unhex(F.lit("00")), body))


def checkout_files(spark: SparkSession, base: str) -> DataFrame:
    """``instance_id, path, sha, content`` of every file of the checkouts below ``base``; one scan, no listing on the driver."""
    root = full_path(spark, base).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    place = F.substring("path", F.lit(len(root) + 1), F.length("path"))
    split = F.locate("/", place)
    return files.where(split > 1).select(
        F.left(place, split - 1).alias("instance_id"),
        F.substring(place, split + 1, F.length(place)).alias("path"),
        object_hash("blob", F.col("content")).alias("sha"),
        "content",
    )


def folder_hashes(files: DataFrame) -> DataFrame:
    """``instance_id, path, sha`` of every folder that holds files, ``""`` for the top one. ``files`` are narrow and stored."""
    parts = F.split("path", "/")
    entries = files.select(
        "instance_id",
        F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("folder"),
        F.element_at(parts, -1).alias("name"),
        (F.size(parts) - 1).alias("depth"),
        F.lit(FILE_MODE).alias("mode"),
        "sha",
    )
    deepest = entries.agg(F.max("depth")).first()[0]
    found, below = [], None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        here = entries.where(F.col("depth") == depth)
        if below is not None:
            steps = F.split("path", "/")
            here = here.unionByName(
                below.select(
                    "instance_id",
                    F.array_join(F.slice(steps, F.lit(1), F.size(steps) - 1), "/").alias("folder"),
                    F.element_at(steps, -1).alias("name"),
                    F.lit(depth).alias("depth"),
                    F.lit(FOLDER_MODE).alias("mode"),
                    "sha",
                )
            )
        below = staged(
            here.groupBy("instance_id", F.col("folder").alias("path")).agg(object_hash("tree", tree_body()).alias("sha"))
        )
        found.append(below)
    out = files.select("instance_id", "path", "sha").limit(0)
    for level in found:
        out = out.unionByName(level)
    return out


def tree_body() -> Column:
    """The entries of a folder, by name."""
    slash = F.when(F.col("mode") == FOLDER_MODE, "/").otherwise("")
    entry = F.concat(
        F.encode(F.concat("mode", F.lit(" "), "name"), "UTF-8"), F.unhex(F.lit("00")), F.unhex("sha")
    )
    rows = F.sort_array(F.collect_list(F.struct(F.concat("name", slash).alias("order"), entry.alias("entry"))))
    joined = F.aggregate(rows, F.lit("").cast("string"), lambda text, row: F.concat(text, F.hex(row["entry"])))
    return F.unhex(joined)


def checkout_tables(spark: SparkSession, base: str, config: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(config, listing, blobs)`` as the repository source takes them, from the checkouts below ``base``.

    ``config`` has the settings of the instances without ``tree_sha`` and ``truncated``; an instance without files gets no hash.
    Contents are read again for changed files only.
    """
    files = checkout_files(spark, base)
    narrow = staged(files.select("instance_id", "path", "sha"))
    tops = folder_hashes(narrow).where(F.col("path") == "").select("instance_id", F.col("sha").alias("tree_sha"))
    listing = narrow.select("instance_id", "path", F.lit("blob").alias("type"), "sha", F.lit(None).cast("string").alias("url"))
    blobs = files.groupBy("sha").agg(F.first("content").alias("content")).select(
        "sha", F.lit("base64").alias("encoding"), F.base64("content").alias("content")
    )
    settings = config.join(tops, "instance_id", "left").withColumn("truncated", F.lit(False))
    return settings, listing, blobs
