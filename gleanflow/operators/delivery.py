"""Delivery of pending captures: gate, limit, file and push targets, outcome accounting."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gleanflow.contract import CAPTURE_SCHEMA, DEFAULT_TIMEOUT_MS, FILE_LEVELS, OUTBOX_STATUSES, PUSH_LEVELS
from gleanflow.operators.folders import names_in, remove_folder, shared_folder, staged
from gleanflow.operators.outbox import file_order

OUTCOME_SCHEMA = "id string, status string, error string"
EXCERPT_UNITS = 200


@dataclass(frozen=True)
class Target:
    """A delivery target. ``levels`` defaults to what its kind accepts."""

    id: str
    kind: str
    config: dict = field(default_factory=dict)
    levels: tuple[str, ...] = ()

    @property
    def accepted(self) -> tuple[str, ...]:
        return self.levels or (FILE_LEVELS if self.kind == "file" else PUSH_LEVELS)


# --- gate -------------------------------------------------------------------------


def skip_reason(level: Column, accepted: Sequence[str] | Column) -> Column:
    """Why a capture of this privacy level is held back (fixed wording); null when it may go out."""
    allowed = accepted if isinstance(accepted, Column) else F.array(*[F.lit(x) for x in accepted])
    return F.when(
        ~F.array_contains(allowed, level),
        F.concat(F.lit('privacy level "'), level, F.lit('" is not accepted by this target')),
    )


def gate_matrix(pending: DataFrame, targets: Sequence[Target]) -> DataFrame:
    """``(target, id, accepted, reason)`` for a short list of targets in one scan, without a join."""
    options = F.array(
        *[
            F.struct(
                F.lit(t.id).alias("target"), F.array(*[F.lit(x) for x in t.accepted]).alias("levels")
            )
            for t in targets
        ]
    )
    reason = skip_reason(F.col("level"), F.col("_t.levels"))
    return pending.select("id", "level", F.explode(options).alias("_t")).select(
        F.col("_t.target").alias("target"),
        "id",
        reason.isNull().alias("accepted"),
        reason.alias("reason"),
    )


# --- selection ---------------------------------------------------------------------


def select_ids(entries: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Entries with a wanted id; no list or an empty one means all, unknown ids are ignored."""
    if ids is None or ids.isEmpty():
        return entries
    return entries.join(ids.select("id").distinct(), "id", "left_semi")


def nth_key(keys: DataFrame, n: int, ranges: int | None = None) -> Column:
    """The n-th smallest value of the single column ``key``, null when there are fewer.

    The range partition that holds it is found by counts, one row per partition on the driver. Only the keys of that
    range are then sorted, so no task holds more than one range whatever ``n`` is. The keys are stored first and computed once.
    """
    spark = keys.sparkSession
    keys = staged(keys)
    found = (
        keys.repartitionByRange(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), "key")
        .groupBy(F.spark_partition_id().alias("part"))
        .agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        .orderBy("low")
        .collect()
    )
    for part in found:
        if n <= part["n"]:
            inside = keys.where(F.col("key").between(part["low"], part["high"]))
            return inside.orderBy("key").limit(n).agg(F.max("key").alias("cutoff")).scalar()
        n -= part["n"]
    return F.lit(None).cast("string")


def sync_plan(
    pending: DataFrame,
    accepted: Sequence[str],
    limit: int | None = None,
    ids: DataFrame | None = None,
    ranges: int | None = None,
    reason: Column | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Visited entries with ``reason`` (null: deliver). Needs columns ``id`` and ``level``.

    ``keep`` names the columns of the result besides the reason; with a limit these narrow rows are then stored, so that entries are
    found out once and not again for the cut.

    ``reason`` replaces the privacy gate by the rule of a custom target.

    With a limit, the visit stops at the n-th accepted entry in file order; later entries are
    neither delivered nor reported. Skipped entries do not count.
    """
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit <= 0):
        raise ValueError("limit must be a positive integer")
    visited = select_ids(pending, ids).withColumn(
        "reason", skip_reason(F.col("level"), accepted) if reason is None else reason
    )
    if keep is not None:
        visited = visited.select(*keep, "reason")
    if limit is None:
        return visited
    if keep is not None:
        visited = staged(visited)
    keys = visited.where(F.col("reason").isNull()).select(file_order(F.col("id")).alias("key"))
    cutoff = nth_key(keys, limit, ranges)
    return visited.where(file_order(F.col("id")) <= F.coalesce(cutoff, file_order(F.col("id"))))


# --- payload ------------------------------------------------------------------------


def capture_json(df: DataFrame | None = None) -> Column:
    """The capture row as one JSON text with nulls kept and metadata as a nested object."""
    fields = [
        (F.parse_json("metadata") if name == "metadata" else F.col(name)).alias(name)
        for name in CAPTURE_SCHEMA.names
    ]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


# --- file target ----------------------------------------------------------------------


def export_captures(captures: DataFrame, directory: str, mode: str = "append") -> None:
    """One JSON line per capture; the commit protocol publishes the files together."""
    captures.select(capture_json().alias("value")).write.mode(mode).text(directory)


def exported(captures: DataFrame, directory: str) -> DataFrame:
    """Outcomes ``(id, status, error)`` of an export into a folder of its own: all are sent, or the job's error is everyone's."""
    error = None
    try:
        export_captures(captures, directory, "overwrite")
    except Exception as failure:  # noqa: BLE001 - the entries carry the reason
        error = (str(failure).strip().splitlines() or [type(failure).__name__])[0]
    status = "sent" if error is None else "failed"
    return captures.select("id", F.lit(status).alias("status"), F.lit(error).cast("string").alias("error"))


@dataclass(frozen=True)
class Folder:
    """Single files ``<id>.json`` in a directory that every executor mounts, for receivers that want these.

    A file appears under its name when it is complete, so a task that is repeated replaces it by the same.
    """

    directory: str

    def connect(self) -> Callable[[str, str], str | None]:
        folder = Path(self.directory)
        folder.mkdir(parents=True, exist_ok=True)

        def place(identifier: str, value: str) -> str | None:
            pretty = json.dumps(json.loads(value), indent=2, ensure_ascii=False)
            with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=folder, suffix=".part", delete=False) as draft:
                draft.write(pretty + "\n")
            Path(draft.name).rename(folder / f"{identifier}.json")
            return None

        return place


def export_files(captures: DataFrame, directory: str) -> DataFrame:
    """Outcomes of writing one file per capture. Evaluating them writes, so store them once."""
    values = captures.select("id", capture_json().alias("value"))
    return push_captures(values, connect=Folder(directory).connect, lanes=None)


# --- push target ------------------------------------------------------------------------


def push_captures(
    payloads: DataFrame,
    send: Callable[[str, str], str | None] | None = None,
    lanes: int | None = 1,
    connect: Callable[[], Callable[[str, str], str | None]] | None = None,
) -> DataFrame:
    """Outcomes ``(id, status, error)`` of sending rows ``(id, value)``.

    ``send(id, json)`` returns an error text or None and may raise. ``connect`` makes such a function once per task, which may hold a
    connection. ``lanes`` bounds how many sends run at once (None: as many as there are tasks); inside a lane entries go out in file
    order. Evaluating the result sends, so write it once and read it back.
    """
    if lanes is not None:
        key = file_order(F.col("id"))
        payloads = payloads.repartitionByRange(lanes, key).sortWithinPartitions(key)

    def outcome(deliver, identifier: str, value: str) -> str | None:
        try:
            return deliver(identifier, value)
        except Exception as failure:  # noqa: BLE001 - every failure is an outcome
            return str(failure) or type(failure).__name__

    def run_lane(batches):
        deliver = send
        for batch in batches:
            deliver = deliver or connect()
            errors = [outcome(deliver, *row) for row in zip(batch["id"], batch["value"], strict=True)]
            status = ["failed" if error is not None else "sent" for error in errors]
            yield pd.DataFrame({"id": batch["id"], "status": status, "error": pd.Series(errors, index=batch.index, dtype=object)})

    return payloads.select("id", "value").mapInPandas(run_lane, OUTCOME_SCHEMA)


# Bytes of payloads that a lane sends in one step, so that no task holds more.
STEP_BYTES = 64 << 20


def push_in_steps(
    payloads: DataFrame,
    send: Callable[[str, str], str | None] | None = None,
    lanes: int | None = 1,
    connect: Callable[[], Callable[[str, str], str | None]] | None = None,
    step_bytes: int | None = None,
) -> DataFrame:
    """Outcomes of :func:`push_captures` for payloads of any size; all are sent and the outcomes stored when this returns.

    Payloads are stored in ranges of the file order, about ``step_bytes`` (by default ``STEP_BYTES``) a lane, and these go out one after the other. So there are
    never more than ``lanes`` sends at once, and no task reads more than its lane of one range, however much there is to send.
    """
    if lanes is None:
        return staged(push_captures(payloads, send, None, connect))
    spark, size = payloads.sparkSession, Observation()
    given, ranges, outcomes = (shared_folder(spark) for _ in range(3))
    held = F.octet_length("id") + F.octet_length("value")
    payloads = payloads.select("id", "value")
    payloads.observe(size, F.sum(held).alias("bytes")).write.parquet(given)
    rows = spark.read.schema(payloads.schema).parquet(given)
    steps = -(-(size.get["bytes"] or 0) // ((step_bytes or STEP_BYTES) * lanes))
    if steps <= 1:
        push_captures(rows, send, lanes, connect).write.parquet(f"{outcomes}/step=0")
    else:
        cut = rows.repartitionByRange(steps, file_order(F.col("id"))).withColumn("step", F.spark_partition_id())
        cut.write.partitionBy("step").parquet(ranges)
        for step in sorted(int(name[5:]) for name in names_in(spark, ranges) if name.startswith("step=")):
            part = spark.read.schema(rows.schema).parquet(f"{ranges}/step={step}")
            push_captures(part, send, lanes, connect).write.parquet(f"{outcomes}/step={step}")
        remove_folder(spark, ranges)
    remove_folder(spark, given)
    return spark.read.schema(OUTCOME_SCHEMA).parquet(outcomes).drop("step")


@dataclass(frozen=True)
class Webhook:
    """An endpoint that takes one capture per POST.

    A task resolves the settings once and keeps one connection open for all of its captures. The token is read where the task
    runs and never stored.
    """

    url: str
    headers: dict[str, str] = field(default_factory=dict)
    token_env: str | None = None
    timeout_ms: int = DEFAULT_TIMEOUT_MS

    @staticmethod
    def of(target: Target) -> "Webhook":
        given = {name: target.config[name] for name in ("url", "headers", "token_env", "timeout_ms") if target.config.get(name) is not None}
        return Webhook(**given)

    def resolved(self) -> tuple[dict[str, str], str | None]:
        """Headers of every request, and what keeps them from being complete (fixed wording)."""
        fixed = {"content-type": "application/json", "user-agent": "gleanflow"}
        token = os.environ.get(self.token_env, "").strip() if self.token_env else ""
        missing = f"Environment variable {self.token_env} is not set" if self.token_env and not token else None
        return fixed | self.headers | ({"authorization": f"Bearer {token}"} if token else {}), missing

    def connect(self) -> Callable[[str, str], str | None]:
        import http.client
        from urllib.parse import urlsplit

        headers, missing = self.resolved()
        if missing is not None:
            return lambda identifier, value: missing
        place = urlsplit(self.url)
        kind = http.client.HTTPSConnection if place.scheme == "https" else http.client.HTTPConnection
        line = kind(place.hostname, place.port, timeout=self.timeout_ms / 1000)
        where = (place.path or "/") + (f"?{place.query}" if place.query else "")

        def post(identifier: str, value: str) -> str | None:
            try:
                line.request("POST", where, value.encode("utf-8"), headers)
                answer = line.getresponse()
                body = answer.read()
            except (OSError, http.client.HTTPException):
                line.close()  # the next request opens a new one
                raise
            return None if 200 <= answer.status < 300 else refusal(answer.status, body)

        return post


def refusal(status: int, body: bytes) -> str:
    """Fixed wording: what a failed delivery leaves in the outbox."""
    excerpt = body.decode("utf-8", "replace").strip()[:EXCERPT_UNITS]
    return ": ".join([f"Webhook responded HTTP {status}", *([excerpt] if excerpt else [])])


# --- accounting ----------------------------------------------------------------------------


def outcome_events(outcomes: DataFrame, target: str, seq: Column, at: Column) -> DataFrame:
    """Marks for the outbox log; skipped entries get none and stay pending."""
    return outcomes.where(F.col("status").isin(*OUTBOX_STATUSES)).select(
        seq.cast("bigint").alias("seq"),
        "id",
        F.col("status").alias("event"),
        "error",
        at.alias("at"),
        F.lit(target).alias("target"),
    )


def sync_outcomes(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row per visited entry: ``id, outcome (delivered|failed|skipped), detail``."""
    skipped = plan.where(F.col("reason").isNotNull()).select(
        "id", F.lit("skipped").alias("outcome"), F.col("reason").alias("detail")
    )
    tried = outcomes.select(
        "id",
        F.when(F.col("status") == "sent", "delivered").otherwise("failed").alias("outcome"),
        F.col("error").alias("detail"),
    )
    return tried.unionByName(skipped)


def sync_summary(outcomes: DataFrame, target: str) -> DataFrame:
    """One row of counts. The id lists are the rows of ``sync_outcomes``: they may be of any length."""
    count = lambda name: F.count_if(F.col("outcome") == name)
    return outcomes.agg(
        (count("delivered") + count("failed")).alias("attempted"),
        count("delivered").alias("delivered"),
        count("failed").alias("failed"),
        count("skipped").alias("skipped"),
    ).select(F.lit(target).alias("target"), "attempted", "delivered", "failed", "skipped")
