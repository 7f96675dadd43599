"""Repository document source: listing, blobs and front matter become captures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanflow.contract import CAPTURE_VERSION, DEFAULT_CONTENT_DIR, PRIVACY_LEVELS, Manifest, RunContext
from gleanflow.functions import text as tx
from gleanflow.functions import urls
from gleanflow.operators import frontmatter as fm
from gleanflow.operators.layout import computed, hot_key_join, sent_if_few
from gleanflow.sources.web import capture_id, with_optional

REPOSITORY_MANIFEST = Manifest(
    id="repository-documents",
    version="1.0.0",
    name="Repository documents",
    description="Markdown documents of a repository directory, collected incrementally.",
    capabilities=("manual", "scheduled", "incremental", "batch"),
    permissions=("network",),
    default_schedule="0 3 * * *",
    # The options this source accepts.
    config_schema={
        "type": "object",
        "required": ["repository_url"],
        "additionalProperties": False,
        "properties": {
            "repository_url": {"type": "string", "format": "uri"},
            "branch": {"type": "string"},
            "content_dir": {"type": "string", "default": DEFAULT_CONTENT_DIR},
            "site_url": {"type": "string", "format": "uri"},
            "source_name": {"type": "string"},
            "token_env": {"type": "string"},
            "privacy_level": {"type": "string", "enum": list(PRIVACY_LEVELS), "default": "private"},
            "allow_cloud_llm": {"type": "boolean", "default": False},
        },
    },
)

_OPTIONAL = {
    "branch": "string",
    "content_dir": "string",
    "default_branch": "string",
    "tree_sha": "string",
    "truncated": "boolean",
    "site_url": "string",
    "source_name": "string",
    "privacy_level": "string",
    "allow_cloud_llm": "boolean",
}
NO_BRANCH = "repository does not expose a default branch; set config.branch"


def resolve_sources(config: DataFrame, manifest: Manifest = REPOSITORY_MANIFEST) -> DataFrame:
    """One row per instance with ``owner, repo, ref, content_dir`` or an ``error``."""
    parsed = with_optional(config, _OPTIONAL).withColumn(
        "_repo", urls.parse_repository_url(F.col("repository_url"), manifest.id)
    )
    placed = parsed.withColumn(
        "_dir",
        urls.normalize_content_dir(
            F.coalesce(
                tx.blank_to_null(F.col("content_dir")), F.col("_repo.content_dir"), F.lit(DEFAULT_CONTENT_DIR)
            ),
            manifest.id,
        ),
    )
    ref = F.coalesce(
        tx.blank_to_null(F.col("branch")),
        F.col("_repo.branch"),
        F.nullif(F.col("default_branch"), F.lit("")),
    )
    return placed.select(
        "instance_id",
        F.col("_repo.owner").alias("owner"),
        F.col("_repo.repo").alias("repo"),
        ref.alias("ref"),
        F.col("_dir.content_dir").alias("content_dir"),
        "tree_sha",
        "truncated",
        "site_url",
        "source_name",
        "privacy_level",
        "allow_cloud_llm",
        F.coalesce(F.col("_repo.error"), F.when(ref.isNull(), NO_BRANCH), F.col("_dir.error")).alias("error"),
    )


# --- blobs ------------------------------------------------------------------------


def decode_blobs(blobs: DataFrame) -> DataFrame:
    """Adds ``text`` and ``problem`` to rows ``(sha, encoding, content)``."""
    packed = F.regexp_replace(F.col("content"), f"[{tx.BLANK_CLASS}]+", "")
    binary = F.try_to_binary(packed, F.lit("base64"))
    problem = F.when(
        ~F.coalesce(F.col("encoding") == "base64", F.lit(False)) | binary.isNull(),
        F.concat(F.lit("blob response is not base64: "), F.col("sha")),
    )
    return blobs.withColumn("problem", problem).withColumn(
        # Damaged byte sequences become replacement characters, as in any lenient decoder.
        "text", F.when(F.col("problem").isNull(), F.make_valid_utf8(binary.cast("string")))
    )


def readable_blobs(blobs: DataFrame) -> DataFrame:
    """Blobs with ``text``; the generator keeps the decoding in one place, out of the filter above."""
    packed = F.regexp_replace(F.col("content"), f"[{tx.BLANK_CLASS}]+", "")
    # Damaged byte sequences become replacement characters, as in any lenient decoder.
    text = F.make_valid_utf8(F.try_to_binary(packed, F.lit("base64")).cast("string"))
    encoded = blobs.where(F.coalesce(F.col("encoding") == "base64", F.lit(False)))
    return computed(encoded, text.alias("text")).where(F.col("text").isNotNull()).drop("encoding", "content")


def missing_blobs(changed: DataFrame, blobs: DataFrame) -> DataFrame:
    """Changed files whose blob is absent or unreadable. Only blobs of changed files are decoded."""
    needed = sent_if_few(changed.select("sha").distinct())
    readable = readable_blobs(blobs.join(needed, "sha", "left_semi")).select("sha")
    return changed.join(readable, "sha", "left_anti").select(
        "instance_id", "path", "sha", F.concat(F.lit("blob is missing or unreadable: "), F.col("sha")).alias("problem")
    )


# --- captures -----------------------------------------------------------------------


def document_rows(changed: DataFrame, blobs: DataFrame) -> DataFrame:
    """Changed files with text, body, leaves and front-matter error.

    Only blobs of changed files are decoded, each once, and their texts join the narrow file rows last.
    """
    files = changed.select("instance_id", "path", "sha")
    packed = blobs.select("sha", "encoding", "content")
    return fm.parse_documents(
        hot_key_join(files, packed, "sha", ["instance_id", "path"], prepare=readable_blobs)
    )


def document_rejects(changed: DataFrame, blobs: DataFrame) -> DataFrame:
    """Files that cannot become captures: ``instance_id, path, problem``."""
    broken = document_rows(changed, blobs).where(F.col("error").isNotNull())
    return (
        missing_blobs(changed, blobs)
        .select("instance_id", "path", "problem")
        .unionByName(
            broken.select(
                "instance_id",
                "path",
                F.concat(
                    F.lit("frontmatter line "), F.col("error.line"), F.lit(": "), F.col("error.reason")
                ).alias("problem"),
            )
        )
    )


def repository_captures(
    documents: DataFrame,
    sources: DataFrame,
    run: RunContext,
    mode: str = "fail",
    manifest: Manifest = REPOSITORY_MANIFEST,
    source_name: str = "documents",
    version: str = CAPTURE_VERSION,
) -> DataFrame:
    """Captures of parsed ``documents`` (see ``document_rows``).

    ``mode="fail"`` stops the job at the first unreadable front matter; ``mode="quarantine"``
    leaves such documents out (they are listed by ``document_rejects``).
    """
    if mode not in ("fail", "quarantine"):
        raise ValueError(f"Unknown mode: {mode}")
    if mode == "quarantine":
        documents = documents.where(F.col("error").isNull())
    else:
        broken = F.concat(
            F.col("path"), F.lit(": frontmatter line "), F.col("error.line"), F.lit(": "), F.col("error.reason")
        )
        documents = documents.where(
            F.when(F.col("error").isNotNull(), F.raise_error(broken)).cast("boolean").isNull()
        )

    settings = sources.select(
        "instance_id", "owner", "repo", "ref", "content_dir", "site_url", "source_name",
        "privacy_level", "allow_cloud_llm",
    )
    owner, repo, ref, path = (F.col(name) for name in ("owner", "repo", "ref", "path"))
    located = documents.join(settings, "instance_id").select(
        "*",
        tx.document_slug(path, F.col("content_dir")).alias("_slug"),
        urls.blob_url(owner, repo, ref, path).alias("_blob_url"),
        urls.source_uri(owner, repo, path, ref).alias("_uri"),
        tx.content_hash(F.col("text")).alias("_hash"),
    )
    title = tx.blank_to_null(fm.top_value(F.col("leaves"), "title"))
    metadata = F.to_json(
        F.struct(
            F.lit("blogs").alias("collection"),
            path.alias("path"),
            F.coalesce(tx.blank_to_null(F.col("source_name")), F.lit(source_name)).alias("source_name"),
            urls.repository_url(owner, repo).alias("repository"),
            ref.alias("ref"),
            F.col("sha").alias("blob_sha"),
            F.col("_blob_url").alias("source_url"),
        )
    )
    with_frontmatter = F.concat(
        F.left(metadata, F.length(metadata) - 1),
        F.lit(',"frontmatter":'),
        fm.leaves_json(F.col("leaves")),
        F.lit("}"),
    )
    return located.select(
        F.lit(version).alias("schema_version"),
        capture_id(manifest, F.col("instance_id"), F.col("_uri"), F.col("_hash")).alias("id"),
        F.lit(manifest.id).alias("connector"),
        "instance_id",
        F.lit(run.run_id).alias("run_id"),
        F.lit(run.now).alias("observed_at"),
        F.lit(run.now).alias("captured_at"),
        F.struct(
            F.lit("document").alias("kind"),
            F.col("_uri").alias("uri"),
            F.coalesce(title, F.col("_slug")).alias("title"),
            F.coalesce(urls.article_url(F.col("site_url"), F.col("_slug")), F.col("_blob_url")).alias("url"),
        ).alias("subject"),
        F.struct(
            F.lit("markdown").alias("kind"),
            F.col("body").alias("text"),
            F.col("_blob_url").alias("raw_ref"),
            F.col("_hash").alias("content_hash"),
            F.lit("text/markdown").alias("mime_type"),
        ).alias("payload"),
        F.lit(None).cast("string").alias("note"),
        fm.document_tags(F.col("leaves")).alias("tags"),
        with_frontmatter.alias("metadata"),
        tx.privacy(F.col("privacy_level"), F.col("allow_cloud_llm")).alias("privacy"),
        F.struct(
            F.lit(run.trigger).alias("trigger"),
            F.lit(manifest.stamp).alias("connector_version"),
            F.col("sha").alias("cursor"),
        ).alias("provenance"),
    )
