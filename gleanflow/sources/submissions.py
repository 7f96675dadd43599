"""Manual submissions and imported capture files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanflow.contract import CAPTURE_ID_PREFIX, CAPTURE_SCHEMA, CAPTURE_VERSION, OUTBOX_STATUSES
from gleanflow.functions import text as tx
from gleanflow.functions import urls
from gleanflow.operators.layout import computed
from gleanflow.operators.rules import with_capture_problem
from gleanflow.operators.tables import Outbox, staged
from gleanflow.sources.web import with_optional

MANUAL_CONNECTOR = "manual"
MANUAL_STAMP = "manual@1.0.0"

_OPTIONAL = {
    "url": "string",
    "text": "string",
    "title": "string",
    "note": "string",
    "tags": "array<string>",
    "kind": "string",
    "metadata": "string",
    "privacy_level": "string",
    "allow_cloud_llm": "boolean",
    "trigger": "string",
}


def submission_problem(url: Column, text: Column) -> Column:
    given = lambda c: F.coalesce(c != "", F.lit(False))
    return F.when(given(url) == given(text), "capture requires exactly one of url or text")


def address_submissions(submissions: DataFrame) -> DataFrame:
    """Adds ``uri`` and ``problem`` to rows with ``url`` or ``text``."""
    rows = with_optional(submissions, _OPTIONAL)
    return rows.withColumn("problem", submission_problem(F.col("url"), F.col("text"))).withColumn(
        "uri", F.when(F.col("problem").isNull(), urls.submission_uri(F.col("url"), F.col("text")))
    )


def manual_captures(
    submissions: DataFrame, now: str, version: str = CAPTURE_VERSION, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Captures of submissions with ``uri``; the id covers content, not time or privacy.

    ``keep`` names further columns to carry along, such as the order of submission.
    """
    rows = with_optional(submissions, _OPTIONAL)
    clean = rows.select(
        *keep,
        "uri",
        tx.blank_to_null(F.col("text")).alias("text"),
        tx.blank_to_null(F.col("title")).alias("title"),
        tx.blank_to_null(F.col("note")).alias("note"),
        tx.normalize_tags(F.col("tags")).alias("tags"),
        F.col("kind").alias("_asked_kind"),
        F.coalesce(F.col("metadata"), F.lit("{}")).alias("metadata"),
        F.col("privacy_level"),
        F.col("allow_cloud_llm"),
        F.coalesce(F.col("trigger"), F.lit("manual")).alias("_trigger"),
    ).withColumn(
        "_kind",
        F.coalesce(F.col("_asked_kind"), F.when(F.col("text").isNotNull(), "text").otherwise("url")),
    )
    seed = tx.seed_json(
        uri=F.col("uri"),
        note=F.col("note"),
        text=F.col("text"),
        title=F.col("title"),
        tags=F.col("tags"),
        kind=F.col("_kind"),
    )
    null = F.lit(None).cast("string")
    identified = computed(clean, tx.stable_id(CAPTURE_ID_PREFIX, seed).alias("id"))
    return identified.select(
        F.lit(version).alias("schema_version"),
        "id",
        F.lit(MANUAL_CONNECTOR).alias("connector"),
        null.alias("instance_id"),
        null.alias("run_id"),
        F.lit(now).alias("observed_at"),
        F.lit(now).alias("captured_at"),
        F.struct(
            F.col("_kind").alias("kind"),
            F.col("uri"),
            F.col("title"),
            F.when(urls.is_web_url(F.col("uri")), F.col("uri")).alias("url"),
        ).alias("subject"),
        F.struct(
            F.when(F.col("text").isNotNull(), "text").otherwise("reference").alias("kind"),
            F.col("text"),
            null.alias("raw_ref"),
            tx.content_hash(F.coalesce(F.col("text"), F.col("uri"))).alias("content_hash"),
            null.alias("mime_type"),
        ).alias("payload"),
        "note",
        "tags",
        "metadata",
        tx.privacy(F.col("privacy_level"), F.col("allow_cloud_llm")).alias("privacy"),
        F.struct(
            F.col("_trigger").alias("trigger"),
            F.lit(MANUAL_STAMP).alias("connector_version"),
            null.alias("cursor"),
        ).alias("provenance"),
        *keep,
    )


# --- capture import -------------------------------------------------------------------


def unwrap_capture(value: Column) -> Column:
    """The capture inside an envelope, or the variant itself."""
    wrapped = F.variant_get(value, "$.capture", "variant")
    return F.when(
        F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.coalesce(wrapped, value)
    ).otherwise(value)


def read_captures(
    documents: DataFrame, json: str = "value", version: str = CAPTURE_VERSION
) -> DataFrame:
    """Adds ``capture`` (struct) and ``problem`` to rows that hold one JSON text each.

    Each text is parsed once, and once more as a typed row if it is a capture.
    """
    value = computed(documents, F.try_parse_json(F.col(json)).alias("_value"))
    checked = with_capture_problem(computed(value, unwrap_capture(F.col("_value")).alias("_capture")), "_capture", version)
    good = F.when(F.col("problem").isNull(), F.col("_capture"))
    metadata = F.to_json(F.variant_get(good, "$.metadata", "variant"))
    read = computed(checked, F.from_json(F.to_json(good), _IMPORT_SCHEMA).alias("_typed"))
    fields = [(metadata if name == "metadata" else F.col("_typed")[name]).alias(name) for name in CAPTURE_SCHEMA.names]
    return read.withColumn("capture", F.when(F.col("problem").isNull(), F.struct(*fields))).drop("_value", "_capture", "_typed")


# Metadata has any shape; it is taken from the variant and left out of the typed read.
_IMPORT_SCHEMA = ", ".join(
    f"{f.name} {f.dataType.simpleString()}" for f in CAPTURE_SCHEMA.fields if f.name != "metadata"
)


# --- legacy outbox files ------------------------------------------------------------------


def legacy_entries(files: DataFrame, name: str = "file_name", json: str = "value") -> DataFrame:
    """Entries of flat files: ``id, status, readable``. Unreadable ones stay visible as pending."""
    value = F.try_parse_json(F.col(json))
    status = F.try_variant_get(value, "$.status", "string")
    return files.where(F.endswith(F.col(name), F.lit(".json"))).select(
        F.regexp_replace(F.col(name), r"\.json\z", "").alias("id"),
        F.when(status.isin(*OUTBOX_STATUSES), status).otherwise("pending").alias("status"),
        value.isNotNull().alias("readable"),
    )


# --- files ------------------------------------------------------------------------------------


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """``file_name, file_path, value``: every ``.json`` file below a folder as one text."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return rows.select("_metadata.file_name", "_metadata.file_path", "value")


def read_capture_files(spark: SparkSession, path: str, version: str = CAPTURE_VERSION) -> DataFrame:
    """``file_name, file_path, capture, problem`` of files with one capture (or an envelope around it) each."""
    return read_captures(json_files(spark, path), "value", version).drop("value")


def legacy_files(spark: SparkSession, path: str, version: str = CAPTURE_VERSION) -> DataFrame:
    """Entries of an outbox that kept one file per capture: ``file_name, file_path, capture, status, attempts, last_error,
    updated_at, problem``.

    A file without a readable capture has a problem and stays visible by its path; an unknown status counts as pending.
    """
    value = F.try_parse_json("value")
    get = lambda name, kind: F.try_variant_get("_entry", f"$.{name}", kind)
    status = get("status", "string")
    rows = read_captures(json_files(spark, path).withColumn("_entry", value), "value", version)
    return rows.select(
        "file_name", "file_path", "capture",
        F.when(status.isin(*OUTBOX_STATUSES), status).otherwise("pending").alias("status"),
        F.greatest(F.coalesce(get("attempts", "bigint"), F.lit(0)), F.lit(0)).cast("bigint").alias("attempts"),
        get("last_error", "string").alias("last_error"),
        get("updated_at", "string").alias("updated_at"),
        "problem",
    )


def import_legacy(outbox: Outbox, entries: DataFrame, batch: str) -> dict:
    """Entries of :func:`legacy_files` into an outbox, each as it was: capture, status, attempts, last error and time.

    An id that the outbox has already stays as it is there. Three batches are written (captures, earlier failures, last
    states); a repeat after a crash writes those that are missing. A failed entry counts at least one attempt.
    """
    entries = staged(entries)
    good = entries.where(F.col("problem").isNull())
    enqueued = outbox.enqueue(good.select("capture.*"), batch)
    fresh = good.withColumn("id", F.col("capture.id")).join(outbox.batch_captures(batch).select("id"), "id", "left_semi")
    rest = F.struct("status", "attempts", "last_error", "updated_at")
    fresh = fresh.groupBy("id").agg(F.min_by(rest, "file_path").alias("_e")).select("id", "_e.*")
    nothing = F.lit(None).cast("string")
    before = F.col("attempts") - F.when(F.col("status") == "failed", 1).otherwise(0)
    earlier = fresh.where(before > 0).select("id", F.explode(F.sequence(F.lit(1).cast("bigint"), before)))
    outbox.append(
        earlier.select("id", F.lit("failed").alias("event"), nothing.alias("error"), nothing.alias("at"), nothing.alias("target")),
        f"{batch}-attempts",
    )
    outbox.append(
        fresh.select("id", F.col("status").alias("event"), F.col("last_error").alias("error"), F.col("updated_at").alias("at"), nothing.alias("target")),
        f"{batch}-states",
    )
    rejected = entries.where(F.col("problem").isNotNull()).select("file_path", "problem")
    return {"enqueued": enqueued, "rejected": rejected.count(), "rejects": rejected}
