"""Web page source: a table of crawl responses becomes captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanflow.contract import CAPTURE_ID_PREFIX, CAPTURE_VERSION, PRIVACY_LEVELS, Manifest, RunContext
from gleanflow.functions import text as tx
from gleanflow.functions import urls
from gleanflow.operators.layout import computed
from gleanflow.sources.responses import response_problem

WEB_MANIFEST = Manifest(
    id="web-page",
    version="1.0.0",
    name="Web page",
    description="One capture per crawled page.",
    capabilities=("manual", "batch"),
    permissions=("network",),
    default_schedule=None,
    # The options this source accepts.
    config_schema={
        "type": "object",
        "required": ["url"],
        "additionalProperties": False,
        "properties": {
            "url": {"type": "string", "format": "uri"},
            "title": {"type": "string"},
            "note": {"type": "string"},
            "tags": {"type": "array", "items": {"type": "string"}},
            "privacy_level": {"type": "string", "enum": list(PRIVACY_LEVELS), "default": "private"},
            "allow_cloud_llm": {"type": "boolean", "default": False},
        },
    },
)

_OPTIONAL = {
    "instance_id": "string",
    "content_type": "string",
    "error_name": "string",
    "error_message": "string",
    "title": "string",
    "note": "string",
    "tags": "array<string>",
    "privacy_level": "string",
    "allow_cloud_llm": "boolean",
}


def with_optional(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    missing = {name: F.lit(None).cast(kind) for name, kind in columns.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df


def capture_id(manifest: Manifest, instance_id: Column, uri: Column, content_hash: Column) -> Column:
    """Id of a sourced capture: it depends on connector, instance, address and content only."""
    return tx.stable_id(
        CAPTURE_ID_PREFIX,
        tx.seed_json(
            connector=F.lit(manifest.id), instance=instance_id, uri=uri, contentHash=content_hash
        ),
    )


def _page_problem() -> Column:
    return F.coalesce(
        F.when(~F.coalesce(urls.is_web_url(F.col("url")), F.lit(False)), "requires an http(s) config.url"),
        F.col("_canonical.issue"),
        F.when(
            F.col("error_name").isNotNull() | F.col("status").isNull(),
            response_problem(host_label=True),
        ),
        F.when(
            ~F.col("status").between(200, 299),
            F.concat(F.lit("Web capture failed: HTTP "), F.col("status"), F.lit(" "), F.col("url")),
        ),
    )


def page_rows(responses: DataFrame) -> DataFrame:
    """Responses with trimmed address, canonical address and the reason they are refused."""
    rows = with_optional(responses, _OPTIONAL).withColumn("url", tx.trim_blanks(F.col("url")))
    located = computed(rows, urls.canonical_url(F.col("url")).alias("_canonical"))
    return located.withColumn("problem", _page_problem())


def web_captures(
    responses: DataFrame,
    run: RunContext,
    manifest: Manifest = WEB_MANIFEST,
    version: str = CAPTURE_VERSION,
) -> DataFrame:
    """Captures of all good responses. The hash is taken over the raw HTML."""
    good = page_rows(responses).where(F.col("problem").isNull())
    html = F.col("body")
    cleaned = good.select(
        "*",
        tx.html_text(html).alias("_text"),
        tx.content_hash(html).alias("_hash"),
        F.col("_canonical.uri").alias("_uri"),
    )
    body = F.nullif(F.col("_text"), F.lit(""))
    return cleaned.select(
        F.lit(version).alias("schema_version"),
        capture_id(manifest, F.col("instance_id"), F.col("_uri"), F.col("_hash")).alias("id"),
        F.lit(manifest.id).alias("connector"),
        "instance_id",
        F.lit(run.run_id).alias("run_id"),
        F.lit(run.now).alias("observed_at"),
        F.lit(run.now).alias("captured_at"),
        F.struct(
            F.lit("web").alias("kind"),
            F.col("_uri").alias("uri"),
            F.coalesce(tx.blank_to_null(F.col("title")), tx.html_title(html), F.col("url")).alias("title"),
            F.col("url").alias("url"),
        ).alias("subject"),
        F.struct(
            F.when(body.isNotNull(), "text").otherwise("reference").alias("kind"),
            body.alias("text"),
            F.lit(None).cast("string").alias("raw_ref"),
            F.col("_hash").alias("content_hash"),
            F.col("content_type").alias("mime_type"),
        ).alias("payload"),
        tx.blank_to_null(F.col("note")).alias("note"),
        tx.normalize_tags(F.col("tags")).alias("tags"),
        F.to_json(
            F.struct(F.col("status"), tx.utf16_length(html).alias("content_length"))
        ).alias("metadata"),
        tx.privacy(F.col("privacy_level"), F.col("allow_cloud_llm")).alias("privacy"),
        F.struct(
            F.lit(run.trigger).alias("trigger"),
            F.lit(manifest.stamp).alias("connector_version"),
            F.lit(None).cast("string").alias("cursor"),
        ).alias("provenance"),
    )


def web_rejects(responses: DataFrame) -> DataFrame:
    return page_rows(responses).where(F.col("problem").isNotNull()).select("url", "problem")
