"""End-to-end runs: check instances, collect, validate, enqueue, checkpoint, report; and sync of an outbox."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gleanflow.contract import CAPTURE_SCHEMA, CAPTURE_VERSION, Manifest, RunContext, utc_now
from gleanflow.operators import changes
from gleanflow.operators import delivery as dl
from gleanflow.operators.layout import computed
from gleanflow.operators.rules import option_errors, row_problem
from gleanflow.operators.settings import runnable
from gleanflow.operators.tables import Checkpoints, Outbox, shared_folder, staged
from gleanflow.sources import repository as repo
from gleanflow.sources.web import WEB_MANIFEST, page_rows, web_captures


class Source(Protocol):
    """A source of captures: a table-valued function of its instances.

    ``collect`` gets the instances that may run (``id, config``, the config as JSON text) and the state of their last scan, or None
    for a full one. It returns captures and, where the source keeps one, the next checkpoint.
    """

    def manifest(self) -> Manifest: ...

    def collect(self, instances: DataFrame, run: RunContext, state: Checkpoints | None) -> "Collected": ...


class Deliverer(Protocol):
    """A custom delivery target: what it skips and what became of the rest.

    ``accepts`` is the skip reason over capture columns (null: deliver); ``deliver`` returns rows
    ``(id, status, error)`` with status ``sent`` or ``failed``.
    """

    def accepts(self) -> Column: ...

    def deliver(self, captures: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Collected:
    """Result of a source: captures, and the next checkpoint where the source keeps one."""

    captures: DataFrame
    headers: DataFrame | None = None
    files: DataFrame | None = None
    rejects: DataFrame | None = None


def collect_web(responses: DataFrame, run: RunContext, mode: str = "fail", version: str = CAPTURE_VERSION) -> Collected:
    """Captures of crawled pages. A page that can't be taken fails the run, or is a reject in mode ``quarantine``."""
    pages = page_rows(responses)
    rejects = pages.where(F.col("problem").isNotNull()).select("url", "problem")
    if mode == "fail":
        bad = rejects.first()
        if bad is not None:
            raise ValueError(f"{bad['url']}: {bad['problem']}")
    return Collected(web_captures(responses, run, version=version), rejects=rejects)


def valid_captures(captures: DataFrame, version: str = CAPTURE_VERSION) -> DataFrame:
    """The same rows; a row that breaks the contract fails the job that reads it."""
    problem = row_problem(version)
    return captures.where(F.when(problem.isNotNull(), F.raise_error(problem)).cast("boolean").isNull())


def check_config(config: DataFrame, manifest: Manifest, column: str = "config") -> DataFrame:
    """Rows ``(instance_id, error)`` of instance configs that break the source's option rules."""
    value = F.try_parse_json(F.col(column))
    return config.select(
        "instance_id", F.explode(option_errors(value, manifest.config_schema)).alias("error")
    )


def collect_repository(
    config: DataFrame,
    listing: DataFrame,
    blobs: DataFrame,
    headers: DataFrame | None,
    before: DataFrame | None,
    run: RunContext,
    mode: str = "fail",
    manifest: Manifest = repo.REPOSITORY_MANIFEST,
) -> Collected:
    """Captures and next checkpoint of all instances. No headers means a full scan.

    The narrow results of change detection are written once to the shared folder: the captures,
    both checkpoint tables and the checks read them, and none repeats the joins with the state.
    """
    spark = listing.sparkSession
    stage = shared_folder(spark)

    def staged(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{stage}/{name}")
        return spark.read.parquet(f"{stage}/{name}")

    sources = repo.resolve_sources(config, manifest)
    bad = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).cast("boolean")
    sources = staged(changes.require_complete(sources.where(bad.isNull())), "sources")
    files = staged(changes.document_files(listing, sources).select("instance_id", "path", "sha"), "files")
    if headers is None or before is None:
        changed = files
    else:
        known = changes.valid_checkpoint_files(before, headers, sources)
        unchanged = changes.unchanged_sources(sources, headers)
        changed = staged(changes.changed_files(files, known, unchanged), "changed")
    captures = repo.repository_captures(repo.document_rows(changed, blobs), sources, run, mode, manifest)
    next_headers = changes.next_checkpoint_headers(sources, files, changed, run)
    next_files = changes.next_checkpoint_files(files)
    if mode == "quarantine":
        rejects = staged(repo.document_rejects(changed, blobs), "rejects")
        next_headers, next_files = changes.quarantined_checkpoint(next_headers, next_files, rejects)
        return Collected(captures, next_headers, next_files, rejects)
    lost = repo.missing_blobs(changed, blobs).select(F.concat("path", F.lit(": "), "problem")).first()
    if lost is not None:
        raise ValueError(lost[0])
    return Collected(captures, next_headers, next_files)


def run_source(
    collected: Collected,
    outbox: Outbox,
    batch: str,
    checkpoints: Checkpoints | None = None,
    mode: str = "fail",
    version: str = CAPTURE_VERSION,
) -> dict:
    """Enqueue first and move the checkpoint after it, so a crash in between only repeats work.

    Captures of every source are held against the contract before any is enqueued: one that breaks it ends the run, or is left out
    and counted as rejected in mode ``quarantine``. Captures are written once with their place in the source's order, and of
    equal ids the first one counts. All numbers are counted by the jobs that write.
    """
    checked = computed(collected.captures.select(*CAPTURE_SCHEMA.names), row_problem(version).alias("_problem"))
    if mode == "fail":
        checked = checked.where(F.when(F.col("_problem").isNotNull(), F.raise_error(F.col("_problem"))).cast("boolean").isNull())
    seen = Observation()
    checked = checked.observe(seen, F.count("*").alias("all"), F.count("_problem").alias("rejected"))
    rows = staged(checked.withColumn("_place", F.monotonically_increasing_id()))
    captures = rows.where(F.col("_problem").isNull())
    enqueued = outbox.enqueue(captures, batch, F.col("_place"))
    if checkpoints is not None and collected.headers is not None:
        checkpoints.replace(collected.headers, collected.files, checkpoints.next_version())
    counts = seen.get
    report = {"collected": counts["all"] - counts["rejected"], "enqueued": enqueued}
    return report | ({"rejected": counts["rejected"]} if mode == "quarantine" else {})


@dataclass(frozen=True)
class Registry:
    """Sources by the id of their manifest."""

    sources: dict[str, Source]

    @staticmethod
    def of(sources: Iterable[Source]) -> "Registry":
        known: dict[str, Source] = {}
        for source in sources:
            name = source.manifest().id
            if name in known:
                raise ValueError(f"Connector already registered: {name}")
            known[name] = source
        return Registry(known)

    def manifests(self, spark) -> DataFrame:
        rows = [(name, source.manifest().default_schedule) for name, source in sorted(self.sources.items())]
        return spark.createDataFrame(rows, "id string, default_schedule string")


def instance_problems(registry: Registry, instances: DataFrame, trigger: str) -> DataFrame:
    """``id, connector, config, error`` of all instances; the error is null where the run may start.

    Trigger, source and the enabled flag come first, then the option rules of the source, all broken ones in one message.
    """
    spark = instances.sparkSession
    rows = runnable(instances.withColumn("_trigger", F.lit(trigger)), registry.manifests(spark), "_trigger")
    config = F.try_parse_json(F.coalesce("config", F.lit("{}")))
    broken = F.lit(None).cast("string")
    for name, source in sorted(registry.sources.items()):
        errors = F.when(config.isNull(), F.array(F.lit("config must be valid JSON"))).otherwise(
            option_errors(config, source.manifest().config_schema)
        )
        message = F.concat(
            F.lit(f"Invalid config for connector {name} (instance "), F.col("id"), F.lit("):\n  - "), F.array_join(errors, "\n  - ")
        )
        broken = F.when(F.col("connector") == name, F.when(F.size(errors) > 0, message)).otherwise(broken)
    return computed(rows.drop("_trigger"), F.coalesce("error", broken).alias("_error")).select(
        "id", "connector", "config", F.col("_error").alias("error")
    )


@dataclass(frozen=True)
class RunReport:
    """Counts per source and the instances that did not run (``id, connector, error``)."""

    counts: dict[str, dict]
    problems: DataFrame


def run(
    registry: Registry,
    instances: DataFrame,
    outbox: Outbox,
    checkpoints: Checkpoints,
    context: RunContext,
    full: bool = False,
    mode: str = "fail",
) -> RunReport:
    """One run of all given instances (``id, connector, enabled, config``): check, collect, enqueue, checkpoint.

    In mode ``fail`` the first instance that may not run ends the run before anything is collected; in mode ``quarantine`` the
    others go on and it is reported. ``full`` lets no source see its last scan. Sources run one after the other, each for all of its instances.
    """
    checked = staged(instance_problems(registry, instances, context.trigger))
    problems = checked.where(F.col("error").isNotNull()).select("id", "connector", "error")
    if mode == "fail" and (bad := problems.orderBy("id").first()) is not None:
        raise ValueError(bad["error"])
    counts = {}
    for name, source in sorted(registry.sources.items()):
        mine = checked.where(F.col("error").isNull() & (F.col("connector") == name)).select("id", "config")
        if mine.isEmpty():
            continue
        collected = source.collect(mine, context, None if full else checkpoints)
        counts[name] = run_source(collected, outbox, f"{context.run_id}-{name}", checkpoints, mode)
    return RunReport(counts, problems)


@dataclass(frozen=True)
class WebSource:
    """Pages from a table of crawl responses; an instance's ``url`` picks its response."""

    responses: DataFrame
    mode: str = "fail"
    kind: Manifest = WEB_MANIFEST

    def manifest(self) -> Manifest:
        return self.kind

    def collect(self, instances: DataFrame, run: RunContext, state: Checkpoints | None) -> Collected:
        config = F.from_json("config", "url string, title string, note string, tags array<string>, privacy_level string, allow_cloud_llm boolean")
        asked = instances.select(F.col("id").alias("instance_id"), config.alias("_c")).select("instance_id", "_c.*")
        fetched = self.responses.drop("instance_id", *[c for c in asked.columns if c != "url"])
        rows = fetched.withColumn("_url", F.col("url")).drop("url").join(asked, F.col("_url") == F.col("url")).drop("_url")
        return collect_web(rows, run, self.mode)


@dataclass(frozen=True)
class RepositorySource:
    """Documents of repositories from tables of trees (``repository_url, tree_sha, truncated``), listings and blobs."""

    trees: DataFrame
    listing: DataFrame
    blobs: DataFrame
    mode: str = "fail"
    kind: Manifest = repo.REPOSITORY_MANIFEST

    def manifest(self) -> Manifest:
        return self.kind

    def collect(self, instances: DataFrame, run: RunContext, state: Checkpoints | None) -> Collected:
        options = ("repository_url", "branch", "content_dir", "site_url", "source_name", "privacy_level")
        config = F.from_json("config", ", ".join(f"{name} string" for name in options) + ", allow_cloud_llm boolean")
        settings = instances.select(F.col("id").alias("instance_id"), config.alias("_c")).select("instance_id", "_c.*")
        settings = settings.join(self.trees, "repository_url")
        mine = self.listing.join(settings.select("instance_id"), "instance_id", "left_semi")
        headers, files = (None, None) if state is None else (state.headers(), state.files())
        return collect_repository(settings, mine, self.blobs, headers, files, run, self.mode, self.kind)


def sync(
    outbox: Outbox,
    target: dl.Target,
    batch: str,
    send: Callable[[str, str], str | None] | None = None,
    limit: int | None = None,
    ids: DataFrame | None = None,
    lanes: int | None = 1,
    deliverer: Deliverer | None = None,
    waves: int = 1,
) -> DataFrame:
    """Deliver pending captures and append the outcomes; returns one row per visited entry.

    Accepted entries go out in ``waves``, ranges in file order that are about equal. A wave's outcomes are stored before the next
    one starts, so a sync that breaks off leaves its own wave at most to be sent again. A file export is published as a whole or not at
    all; one that breaks off makes its entries failed ones.

    ``deliverer`` replaces the gate and the transport of the target. Gate, limit and selection work on narrow rows, which
    are stored; the bodies of accepted entries are read after that.
    """
    spark = outbox.spark
    batch = outbox.unused_batch(batch)
    reason = None if deliverer is None else deliverer.accepts()
    plan = dl.sync_plan(outbox.pending(), target.accepted, limit, ids, reason=reason, keep=("id", "seq"))
    if waves > 1:
        plan = plan.repartitionByRange(waves, dl.file_order(F.col("id")))
    plan = staged(plan.withColumn("wave", F.spark_partition_id() if waves > 1 else F.lit(0)))
    outcomes = []
    for wave in range(waves):
        wanted = plan.where(F.col("reason").isNull() & (F.col("wave") == wave)).select("id", "seq")
        accepted = outbox.bodies(wanted).withColumn("level", F.col("privacy.level"))
        name = batch if waves == 1 else f"{batch}.{wave:06d}"
        if deliverer is not None:
            done = deliverer.deliver(accepted)
        elif target.kind == "file":
            done = dl.exported(accepted, f"{target.config['directory'].rstrip('/')}/batch={name}")
        else:
            done = dl.push_in_steps(
                accepted.select("id", dl.capture_json().alias("value")), send, lanes, None if send else dl.Webhook.of(target).connect
            )
        outbox.append(dl.outcome_events(done, target.id, F.lit(0), F.lit(utc_now())), name)
        outcomes.append(name)
    written = outbox.batch_marks(*outcomes).select("id", F.col("event").alias("status"), "error")
    return dl.sync_outcomes(plan, written)
