"""Record contract: schemas, closed value sets and fixed values shared by every operator."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import types as T

# Fixed values -----------------------------------------------------------------
PRIVACY_LEVELS = ("public", "private", "sensitive")
DEFAULT_PRIVACY_LEVEL = "private"
FILE_LEVELS = ("public", "private", "sensitive")
PUSH_LEVELS = ("public", "private")
TRIGGERS = ("manual", "schedule", "webhook", "import")
OUTBOX_STATUSES = ("pending", "sent", "failed")
TARGET_KINDS = ("file", "webhook")
PAYLOAD_KINDS = ("reference", "text", "markdown", "html", "json", "binary")
SUBJECT_KINDS = ("url", "web", "repo", "feed", "file", "folder", "media", "text", "document")
DEFAULT_CONTENT_DIR = "src/content/blogs"
DEFAULT_TIMEOUT_MS = 20_000
CAPTURE_ID_PREFIX = "cap"
# What a capture has to fulfil, in the order in which it is checked, and the message of each rule.
CAPTURE_RULES = {
    "object": "Capture must be an object",
    "schema": "Unsupported capture schema",
    "keys": "Capture requires id, connector, observed_at, and captured_at",
    "subject": "Capture requires subject.kind and subject.uri",
    "payload": "Capture requires payload.kind",
    "privacy": "Capture requires privacy.level",
    "level": "Capture privacy.level is invalid",
    "tags": "Capture tags must be an array of strings",
    "metadata": "Capture metadata must be an object",
}
# ------------------------------------------------------------------------------

# Our own version tag; it is part of no id seed, so callers may pass another one.
CAPTURE_VERSION = "capture.v1"

_S = T.StringType()


def _texts(required: tuple[str, ...], optional: tuple[str, ...] = ()) -> T.StructType:
    """A struct of strings; the optional ones may be null."""
    return T.StructType(
        [T.StructField(name, _S, False) for name in required] + [T.StructField(name, _S, True) for name in optional]
    )


# The names of the record fields below.
# ``metadata`` is a JSON object kept as text: it hashes, writes to every sink and
# turns into a variant with ``parse_json`` where a rule has to look inside.
CAPTURE_SCHEMA = T.StructType(
    [
        T.StructField("schema_version", _S, False),
        T.StructField("id", _S, False),
        T.StructField("connector", _S, False),
        T.StructField("instance_id", _S, True),
        T.StructField("run_id", _S, True),
        T.StructField("observed_at", _S, False),
        T.StructField("captured_at", _S, False),
        T.StructField("subject", _texts(("kind", "uri"), ("title", "url")), False),
        T.StructField("payload", _texts(("kind",), ("text", "raw_ref", "content_hash", "mime_type")), False),
        T.StructField("note", _S, True),
        T.StructField("tags", T.ArrayType(_S, False), False),
        T.StructField("metadata", _S, False),
        T.StructField(
            "privacy",
            T.StructType(
                [
                    T.StructField("level", _S, False),
                    T.StructField("allow_cloud_llm", T.BooleanType(), False),
                ]
            ),
            False,
        ),
        T.StructField("provenance", _texts(("trigger", "connector_version"), ("cursor",)), False),
    ]
)

LISTING_SCHEMA = _texts(("instance_id", "path", "type", "sha"), ("url",))
BLOB_SCHEMA = _texts(("sha", "encoding"), ("content",))
RESPONSE_SCHEMA = T.StructType(
    [
        T.StructField("url", _S, False),
        T.StructField("status", T.IntegerType(), True),
        T.StructField("content_type", _S, True),
        T.StructField("body", _S, True),
        T.StructField("error_name", _S, True),
        T.StructField("error_message", _S, True),
        T.StructField("ratelimit_remaining", _S, True),
        T.StructField("ratelimit_reset", _S, True),
    ]
)
CHECKPOINT_FILES_SCHEMA = _texts(("instance_id", "path"), ("sha",))
CHECKPOINT_HEADER_SCHEMA = T.StructType(
    [
        T.StructField("instance_id", _S, False),
        T.StructField("repository", _S, True),
        T.StructField("ref", _S, False),
        T.StructField("content_dir", _S, False),
        T.StructField("tree_sha", _S, True),
        T.StructField("files_tracked", T.BooleanType(), False),
        T.StructField("file_count", T.LongType(), False),
        T.StructField("changed", T.LongType(), False),
        T.StructField("scanned_at", _S, True),
    ]
)
OUTBOX_EVENT_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("id", _S, False),
        T.StructField("event", _S, False),
        T.StructField("error", _S, True),
        T.StructField("at", _S, True),
        T.StructField("target", _S, True),
    ]
)


@dataclass(frozen=True)
class Manifest:
    """Static description of a source kind."""

    id: str
    version: str
    name: str
    description: str
    capabilities: tuple[str, ...]
    permissions: tuple[str, ...]
    default_schedule: str | None
    config_schema: dict = field(default_factory=dict)

    @property
    def stamp(self) -> str:
        return f"{self.id}@{self.version}"


@dataclass(frozen=True)
class RunContext:
    """Values stamped on every row of one run.

    Built once on the driver, so a retried task writes the same rows.
    """

    run_id: str
    trigger: str
    now: str

    @staticmethod
    def start(trigger: str = "manual", now: str | None = None, run_id: str | None = None) -> "RunContext":
        if trigger not in TRIGGERS:
            raise ValueError(f"Invalid trigger: {trigger}")
        return RunContext(run_id or f"run_{uuid.uuid4()}", trigger, now or utc_now())


def utc_now() -> str:
    moment = datetime.now(timezone.utc)
    return moment.strftime("%Y-%m-%dT%H:%M:%S.") + f"{moment.microsecond // 1000:03d}Z"
