"""Triage of crawl responses: why a request failed and what the operator can do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanflow.contract import DEFAULT_TIMEOUT_MS
from gleanflow.functions.text import trim_blanks, utf16_prefix

# Error names that mean a timeout, quota statuses, excerpt length.
TIMEOUT_ERRORS = ("TimeoutError", "AbortError")
QUOTA_STATUSES = (403, 429)
DENIED_STATUSES = (401, 403)
EXCERPT_UNITS = 200


def _iso_seconds(seconds: Column) -> Column:
    """UTC text of epoch seconds, whatever the session time zone is."""
    moment = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(
        secs=seconds.cast("decimal(18,6)")
    )
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def response_problem(
    timeout_ms: int = DEFAULT_TIMEOUT_MS,
    subject: str = "GitHub",
    host_label: bool = False,
) -> Column:
    """Message of a request that got no response (columns ``url, error_name, error_message``)."""
    target = F.regexp_extract(F.col("url"), "^[A-Za-z]+://([^/?#]*)", 1) if host_label else F.lit(subject)
    timed_out = F.concat(
        F.lit("Request to "), target, F.lit(f" timed out after {timeout_ms}ms: "), F.col("url")
    )
    unreachable = F.concat(
        F.lit("Could not reach "),
        target,
        F.lit(" ("),
        F.coalesce(F.col("error_message"), F.lit("")),
        F.lit("): "),
        F.col("url"),
        F.lit(". Check network connectivity or proxy settings."),
    )
    return F.when(F.col("error_name").isin(*TIMEOUT_ERRORS), timed_out).otherwise(unreachable)


def triage(
    responses: DataFrame,
    authenticated: Column | bool = False,
    timeout_ms: int = DEFAULT_TIMEOUT_MS,
    subject: str = "GitHub",
) -> DataFrame:
    """Adds ``category`` (``ok`` or the kind of failure) and ``message`` to repository responses."""
    signed = authenticated if isinstance(authenticated, Column) else F.lit(authenticated)
    status, url, body = F.col("status"), F.col("url"), F.col("body")
    reset = F.col("ratelimit_reset").try_cast("double")
    exhausted = status.isin(*QUOTA_STATUSES) & (F.col("ratelimit_remaining") == "0")
    excerpt = utf16_prefix(trim_blanks(F.coalesce(body, F.lit(""))), EXCERPT_UNITS)

    category = (
        F.when(F.col("error_name").isin(*TIMEOUT_ERRORS), "timeout")
        .when(F.col("error_name").isNotNull() | status.isNull(), "network")
        .when(exhausted, "rate_limit")
        .when(status.isin(*DENIED_STATUSES), "denied")
        .when(status == 404, "not_found")
        .when(~status.between(200, 299), "http_error")
        .when(F.try_parse_json(body).isNull(), "invalid_json")
        .otherwise("ok")
    )
    # Texts shown to the operator.
    message = (
        F.when(F.col("category").isin("timeout", "network"), response_problem(timeout_ms, subject))
        .when(
            F.col("category") == "rate_limit",
            F.concat(
                F.lit(f"{subject} API rate limit exhausted (resets at "),
                F.when((reset > 0) & (reset < 1e11), _iso_seconds(reset)).otherwise("an unknown time"),
                F.lit("). "),
                F.when(signed, "Wait for the window to reset or narrow config.content_dir.").otherwise(
                    "Set config.token_env to raise the limit from 60 to 5000 requests per hour."
                ),
            ),
        )
        .when(
            F.col("category") == "denied",
            F.concat(
                F.lit(f"{subject} denied the request: HTTP "),
                status,
                F.lit(" "),
                url,
                F.lit(". "),
                F.when(
                    signed, "The token in config.token_env may be expired or lack repository access."
                ).otherwise("This repository looks private; set config.token_env."),
            ),
        )
        .when(
            F.col("category") == "not_found",
            F.concat(
                F.lit(f"{subject} resource not found: "),
                url,
                F.lit(". Check repository_url, branch and content_dir."),
            ),
        )
        .when(
            F.col("category") == "http_error",
            F.concat(
                F.lit(f"{subject} request failed: HTTP "),
                status,
                F.lit(" "),
                url,
                F.when(excerpt != "", F.concat(F.lit(" — "), excerpt)).otherwise(""),
            ),
        )
        .when(
            F.col("category") == "invalid_json",
            F.concat(F.lit(f"{subject} request returned invalid JSON: "), url),
        )
    )
    return responses.withColumn("category", category).withColumn("message", message)
