"""Registered queries: every operator over whole given tables, flat output columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanflow.functions import text as tx
from gleanflow.functions import urls
from gleanflow.operators import changes, rules, settings
from gleanflow.operators import delivery as dl
from gleanflow.operators import frontmatter as fm
from gleanflow.operators import outbox as ob
from gleanflow.operators.snapshots import Snapshots
from gleanflow.operators.tables import Checkpoints, Outbox, shared_folder
from gleanflow.plans import fixtures as fx
from gleanflow.plans.run import Collected, Registry, WebSource, collect_repository, run, run_source, sync
from gleanflow.sources import repository as repo
from gleanflow.sources import submissions as sub
from gleanflow.sources.responses import triage
from gleanflow.sources.web import WEB_MANIFEST, web_captures
from gleanflow.streaming import pipelines

Query = Callable[[SparkSession, str], DataFrame]

FILE_TARGET = dl.Target("files", "file", {"directory": "export"})
PUSH_TARGET = dl.Target("hook", "webhook", {"url": "https://hook.example/in"})
SYNC_LIMIT = 40


def _tags(column: str = "tags"):
    return F.array_join(column, "|").alias("tags")


# --- web source ----------------------------------------------------------------------


def flat_web(captures: DataFrame) -> DataFrame:
    return captures.select(
        "id",
        F.col("subject.uri").alias("uri"),
        F.col("subject.title").alias("title"),
        F.col("subject.url").alias("url"),
        F.col("payload.kind").alias("payload_kind"),
        F.col("payload.text").alias("text"),
        F.col("payload.content_hash").alias("content_hash"),
        "metadata",
        F.col("privacy.level").alias("level"),
        F.col("provenance.connector_version").alias("connector_version"),
        "observed_at",
    )


def web_captures_query(spark, sf):
    return flat_web(web_captures(fx.responses(spark, sf), fx.RUN))


def page_text(spark, sf):
    return fx.pages(spark, sf).select("page_id", tx.html_text(F.col("html")).alias("text"))


def page_title(spark, sf):
    return fx.pages(spark, sf).select("page_id", tx.html_title(F.col("html")).alias("title"))


def canonical_urls(spark, sf):
    return fx.table(spark, sf, "pages").select(
        "page_id", urls.canonical_url(F.col("url")).alias("_c")
    ).select("page_id", F.col("_c.uri").alias("uri"), F.col("_c.issue").alias("issue"))


def page_hosts(spark, sf):
    """Page addresses with hosts in all spellings: their usual form, or why there is none."""
    address = F.concat(F.lit("HTTP://"), F.expr(fx.host_cases()), F.lit("/"), F.col("page_id").cast("string"), F.lit("?q#f"))
    return fx.table(spark, sf, "pages").select("page_id", urls.canonical_url(address).alias("_c")).select(
        "page_id", F.col("_c.uri").alias("uri"), F.col("_c.issue").alias("issue")
    )


def page_lengths(spark, sf):
    return fx.pages(spark, sf).select("page_id", tx.utf16_length(F.col("html")).alias("content_length"))


# --- scalar functions -------------------------------------------------------------------


def stable_ids(spark, sf):
    rows = fx.documents(spark, sf)
    seed = tx.seed_json(
        connector=F.lit("repository-documents"),
        instance=F.col("source"),
        uri=F.concat(F.lit("doc://"), F.col("doc_id").cast("string")),
        contentHash=tx.content_hash(F.col("text")),
    )
    return rows.select("doc_id", tx.stable_id("cap", seed).alias("id"), tx.content_hash(F.col("text")).alias("hash"))


def normalize_tags(spark, sf):
    raw = F.array(
        F.col("role"), F.concat(F.lit(" \t"), F.col("role"), F.lit(" ")), F.lit(""), F.col("text"), F.lit(" ")
    )
    return fx.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_join(tx.normalize_tags(raw), "|").alias("tags")
    )


def slugs(spark, sf):
    # Whole texts as slugs: lines become path segments.
    rows = spark_texts(spark, sf)
    return rows.select(
        "doc_id",
        F.sha2(tx.slug(F.col("text")), 256).alias("slug_hash"),
        tx.slug_path(F.concat(F.col("source"), F.lit("/ // Ärger & Über_"), F.col("lang"), F.lit(".x~/"), F.col("doc_id").cast("string"))).alias("path"),
    )


def spark_texts(spark, sf):
    return fx.documents(spark, sf).select("doc_id", "text", "source", "lang")


def document_urls(spark, sf):
    rows = fx.labelled(spark, sf).select("doc_id", "source", F.expr(fx.PATH).alias("path"))
    owner, name, ref = F.lit("octo"), F.col("source"), F.lit("rel/1+0")
    return rows.select(
        "doc_id",
        urls.blob_url(owner, name, ref, F.concat(F.col("path"), F.lit("~!*('é)%"))).alias("blob_url"),
        urls.article_url(F.lit("https://site.example//"), tx.document_slug(F.col("path"), F.lit("content"))).alias("article_url"),
        urls.source_uri(owner, name, F.col("path"), ref).alias("uri"),
    )


def parse_repo_url(spark, sf):
    rows = fx.documents(spark, sf).select("doc_id", F.expr(fx.REPOSITORY).alias("repository_url"))
    parsed = rows.withColumn("_r", urls.parse_repository_url(F.col("repository_url"), "repository-documents"))
    return parsed.select("doc_id", "_r.owner", "_r.repo", "_r.branch", "_r.content_dir", "_r.error")


def privacy_defaults(spark, sf):
    asked = F.when(F.col("toxic") == 1, "sensitive").when(F.col("quality") == 1, "secret")
    allow = F.when(F.col("toxic") == 0, F.lit(True))
    return fx.labelled(spark, sf).select("doc_id", tx.privacy(asked, allow).alias("_p")).select(
        "doc_id", F.col("_p.level").alias("level"), F.col("_p.allow_cloud_llm").alias("allow_cloud_llm")
    )


# --- submissions and imports ---------------------------------------------------------------


def _submissions(spark, sf):
    first = F.col("turn") == 0
    return fx.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.when(first, F.concat(F.lit("HTTPS://chat.example/"), F.col("conv_id").cast("string"))).alias("url"),
        F.when(~first, F.col("text")).alias("text"),
        F.concat(F.lit(" "), F.col("role"), F.lit("\n")).alias("title"),
        F.lit("  ").alias("note"),
        F.array(F.col("role"), F.concat(F.lit(" "), F.col("role"), F.lit(" ")), F.lit("")).alias("tags"),
    )


def manual_captures(spark, sf):
    rows = sub.address_submissions(_submissions(spark, sf))
    return sub.manual_captures(rows, fx.RUN.now, keep=("conv_id", "turn")).select(
        "conv_id",
        "turn",
        "id",
        F.col("subject.kind").alias("kind"),
        F.col("subject.uri").alias("uri"),
        F.col("subject.title").alias("title"),
        F.col("subject.url").alias("url"),
        F.col("payload.kind").alias("payload_kind"),
        F.col("payload.text").alias("text"),
        F.col("payload.content_hash").alias("content_hash"),
        "note",
        _tags(),
        F.col("privacy.level").alias("level"),
    )


def manual_uri(spark, sf):
    rows = fx.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "user", F.lit("https://chat.example/x")).alias("url"),
        F.when((F.col("role") != "user") | (F.col("turn") == 0), F.col("text")).alias("text"),
    )
    return sub.address_submissions(rows).select("conv_id", "turn", "uri", "problem")


def import_captures(spark, sf):
    rows = fx.events(spark, sf).select("event_id", F.expr(fx.CAPTURE_JSON).alias("value"))
    return sub.read_captures(rows).select(
        "event_id",
        "problem",
        F.col("capture.id").alias("id"),
        F.col("capture.subject.uri").alias("uri"),
        F.col("capture.privacy.level").alias("level"),
        F.array_join("capture.tags", "|").alias("tags"),
    )


def legacy_outbox(spark, sf):
    body = (
        F.when(F.col("event_type") == "purchase", F.lit('{"status":"sent"}'))
        .when(F.col("event_type") == "error", F.lit('{"status":"failed"}'))
        .when(F.col("event_type") == "click", F.lit('{"status":"lost"}'))
        .when(F.col("event_type") == "view", F.replace("props", F.lit("}"), F.lit("")))
        .otherwise(F.col("props"))
    )
    name = F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(".json"))
    rows = fx.table(spark, sf, "events").select(name.alias("file_name"), body.alias("value"))
    return sub.legacy_entries(rows)


def _files_of(rows: DataFrame) -> str:
    """A folder with one file per ``id, value``."""
    folder = shared_folder(rows.sparkSession)
    dl.push_captures(rows, connect=dl.Folder(folder).connect, lanes=None).where("error is not null").count()
    return folder


def import_files(spark, sf):
    """Page captures as single files, read back as captures."""
    captures = web_captures(fx.responses(spark, sf), fx.RUN)
    folder = _files_of(captures.dropDuplicates(["id"]).select("id", dl.capture_json().alias("value")))
    found = sub.read_capture_files(spark, folder)
    return found.select(
        "problem", "file_name", F.col("capture.id").alias("id"), F.col("capture.subject.uri").alias("uri"),
        F.col("capture.payload.text").alias("text"), F.col("capture.metadata").alias("metadata"),
    )


def legacy_import(spark, sf):
    """Files of an older outbox, with statuses, attempts and broken ones, become entries of a new one."""
    captures = web_captures(fx.responses(spark, sf), fx.RUN).dropDuplicates(["id"])
    kind = F.conv(F.right("id", F.lit(1)), 16, 10).cast("int")
    state = F.struct(
        F.parse_json(dl.capture_json()).alias("capture"),
        F.when(kind % 4 == 1, "sent").when(kind % 4 == 2, "failed").when(kind % 4 == 3, "lost").otherwise("pending").alias("status"),
        (kind % 5 + F.when(kind % 4 == 2, 1).otherwise(0)).alias("attempts"),
        F.when(kind % 2 == 0, F.concat(F.lit("why "), "id")).alias("last_error"),
        F.concat(F.lit("t"), kind.cast("string")).alias("updated_at"),
    )
    whole = F.to_json(state, {"ignoreNullFields": "false"})
    value = F.when(kind == 15, F.to_json(F.struct(F.lit("no capture").alias("note")))).otherwise(whole)
    folder = _files_of(captures.select("id", value.alias("value")))
    outbox = Outbox(spark, shared_folder(spark))
    report = sub.import_legacy(outbox, sub.legacy_files(spark, folder), "old")
    broken = report["rejects"].select(
        F.regexp_extract("file_path", "([^/]+)[.]json$", 1).alias("id"), F.col("problem").alias("status"),
        F.lit(None).cast("long").alias("attempts"), F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("string").alias("updated_at"),
    )
    return outbox.entries().select(*broken.columns).unionByName(broken)


# --- repository source ------------------------------------------------------------------------


def listing_guard(spark, sf):
    rows = fx.repository_sources(spark, sf).withColumn("truncated", F.col("instance_id") < "src3")
    return changes.truncated_sources(rows)


def listing_filter(spark, sf):
    return changes.document_files(fx.repository_listing(spark, sf), fx.repository_sources(spark, sf)).select(
        "instance_id", "path", "sha"
    )


def blob_decode(spark, sf):
    content = F.base64(F.encode("text", "UTF-8"))
    rows = fx.documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("sha"),
        F.when(F.col("lang") == "es", "utf-8").otherwise("base64").alias("encoding"),
        F.concat(F.left(content, F.lit(60)), F.lit("\r\n"), F.substring(content, F.lit(61), F.length(content))).alias("content"),
    )
    return repo.decode_blobs(rows).select("sha", "text", "problem")


def resolve_ref(spark, sf):
    rows = fx.documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("instance_id"),
        F.expr(fx.REPOSITORY).alias("repository_url"),
        F.expr(fx.BRANCH).alias("branch"),
        F.expr(fx.CONTENT_DIR).alias("content_dir"),
        F.expr(fx.DEFAULT_BRANCH).alias("default_branch"),
    )
    return repo.resolve_sources(rows).select("instance_id", "ref", "content_dir", "error")


def checkpoint_valid(spark, sf):
    return changes.valid_checkpoint_files(
        fx.checkpoint_files(spark, sf), fx.checkpoint_headers(spark, sf), fx.repository_sources(spark, sf)
    )


def unchanged_sources(spark, sf):
    return changes.unchanged_sources(fx.repository_sources(spark, sf), fx.checkpoint_headers(spark, sf))


def _changed(spark, sf):
    sources, headers = fx.repository_sources(spark, sf), fx.checkpoint_headers(spark, sf)
    files = changes.document_files(fx.repository_listing(spark, sf), sources)
    before = changes.valid_checkpoint_files(fx.checkpoint_files(spark, sf), headers, sources)
    return files, changes.changed_files(files, before, changes.unchanged_sources(sources, headers)), sources


def changed_files(spark, sf):
    return changes.in_path_order(_changed(spark, sf)[1].select("instance_id", "path", "sha"))


def checkpoint_next(spark, sf):
    files, changed, sources = _changed(spark, sf)
    return changes.next_checkpoint_headers(sources, files, changed, fx.RUN)


def full_rescan(spark, sf):
    sources = fx.repository_sources(spark, sf)
    files = changes.document_files(fx.repository_listing(spark, sf), sources)
    return changes.next_checkpoint_headers(sources, files, files, fx.RUN).select(
        "instance_id", "file_count", "changed", "tree_sha"
    )


def flat_documents(captures: DataFrame) -> DataFrame:
    return captures.select(
        "id",
        "instance_id",
        F.col("subject.uri").alias("uri"),
        F.col("subject.title").alias("title"),
        F.col("subject.url").alias("url"),
        F.col("payload.text").alias("text"),
        F.col("payload.raw_ref").alias("raw_ref"),
        F.col("payload.content_hash").alias("content_hash"),
        _tags(),
        "metadata",
        F.col("privacy.level").alias("level"),
        F.col("provenance.cursor").alias("cursor"),
    )


def repo_captures(spark, sf):
    _, changed, sources = _changed(spark, sf)
    stored = f"{shared_folder(spark)}/changed"
    changed.write.parquet(stored)
    rows = repo.document_rows(spark.read.parquet(stored), fx.repository_blobs(spark, sf))
    return flat_documents(repo.repository_captures(rows, sources, fx.RUN))


def fetch_triage(spark, sf):
    rows = fx.events(spark, sf).select(
        "event_id",
        F.expr(fx.RESPONSE_URL).alias("url"),
        F.expr(fx.RESPONSE_STATUS).alias("status"),
        F.expr(fx.RESPONSE_BODY).alias("body"),
        F.expr(fx.ERROR_NAME).alias("error_name"),
        F.lit("fetch failed").alias("error_message"),
        F.expr(fx.REMAINING).alias("ratelimit_remaining"),
        F.expr(fx.RESET).alias("ratelimit_reset"),
        (F.col("value") >= 9).alias("_signed"),
    )
    return triage(rows, F.col("_signed")).select("event_id", "category", "message")


# --- front matter ---------------------------------------------------------------------------------


def frontmatter_split(spark, sf):
    rows = fx.front_documents(spark, sf)
    return rows.select("doc_id", fm.split_document(F.col("text")).alias("_d")).select(
        "doc_id", F.col("_d.block").alias("block"), F.col("_d.body").alias("body")
    )


def frontmatter_lines(spark, sf):
    rows = fx.front_documents(spark, sf).select("doc_id", fm.split_document(F.col("text")).alias("_d"))
    return rows.select("doc_id", F.explode(fm.block_lines(F.col("_d.block"))).alias("_l")).select(
        "doc_id",
        F.col("_l.line").cast("bigint").alias("line"),
        F.col("_l.indent").cast("bigint").alias("indent"),
        F.col("_l.content").alias("content"),
        F.col("_l.tab").alias("tab"),
    )


def frontmatter_leaves(spark, sf):
    return fm.frontmatter_leaves(fx.front_documents(spark, sf)).select(
        "doc_id", "key_path", F.col("ordinal").cast("bigint").alias("ordinal"), "value", "value_type",
        F.col("line").cast("bigint").alias("line"),
    )


def frontmatter_nested(spark, sf):
    rows = fm.parse_documents(fx.front_documents(spark, sf, fx.GOOD_TEXT))
    return rows.select("doc_id", fm.leaves_json(F.col("leaves")).alias("frontmatter"))


def frontmatter_tags(spark, sf):
    rows = fm.parse_documents(fx.front_documents(spark, sf, fx.GOOD_TEXT))
    return rows.select("doc_id", F.array_join(fm.document_tags(F.col("leaves")), "|").alias("tags"))


def frontmatter_rejects(spark, sf):
    return fm.frontmatter_rejects(fx.front_documents(spark, sf)).select(
        "doc_id", F.col("line").cast("bigint").alias("line"), "reason"
    )


# --- outbox ------------------------------------------------------------------------------------------


def _document_captures(spark, sf):
    return sub.manual_captures(fx.document_submissions(spark, sf), fx.RUN.now, keep=("doc_id", "stored"))


def enqueue(spark, sf):
    captures = _document_captures(spark, sf)
    stored = captures.where(F.col("stored"))
    new = ob.new_entries(captures, stored, F.col("doc_id"))
    return new.select("id", "doc_id", F.col("privacy.level").alias("level"), F.length("payload.text").cast("bigint").alias("n_chars"))


def run_report(spark, sf):
    captures = _document_captures(spark, sf)
    narrow = captures.select("id", "doc_id", "stored")
    return ob.run_report(narrow, ob.new_entries(narrow, narrow.where(F.col("stored")), F.col("doc_id")))


def privacy_conflicts(spark, sf):
    captures = _document_captures(spark, sf).select("id", "doc_id", "privacy")
    return ob.privacy_conflicts(captures, ob.first_per_id(captures, F.col("doc_id")))


def outbox_state(spark, sf):
    return ob.outbox_state(fx.outbox_log(spark, sf)).select(
        "id", "status", "attempts", "last_error", "updated_at"
    )


def outbox_summary(spark, sf):
    return ob.outbox_summary(ob.outbox_state(fx.outbox_log(spark, sf)))


def _folded_log(spark, sf) -> tuple[Snapshots, DataFrame]:
    """The log folded into a snapshot in three steps, and the events that are left."""
    log, snapshots = fx.outbox_log(spark, sf), Snapshots(spark, shared_folder(spark))
    low, high = log.agg(F.min("seq"), F.max("seq")).first()
    cuts = [low - 1, *[low + (high - low) * share // 100 for share in (55, 80, 90)]]
    for before, upto in zip(cuts, cuts[1:], strict=False):
        snapshots.advance(log.where((F.col("seq") > before) & (F.col("seq") <= upto)), upto)
    return snapshots, log.where(F.col("seq") > cuts[-1])


def outbox_compacted(spark, sf):
    """Present entries from snapshot levels and the last tenth of the log."""
    snapshots, later = _folded_log(spark, sf)
    return snapshots.state(later).select("id", "status", "attempts", "last_error", "updated_at")


def outbox_counts(spark, sf):
    """Entries per status from the manifest and the last tenth of the log."""
    snapshots, later = _folded_log(spark, sf)
    counts = snapshots.counts(later)
    return spark.createDataFrame([(sum(counts.values()), *counts.values())], "total long, pending long, sent long, failed long")


def outbox_rejects(spark, sf):
    return ob.rejected_marks(fx.outbox_log(spark, sf))


def outbox_list(spark, sf):
    entries = ob.outbox_list(ob.outbox_state(fx.outbox_log(spark, sf)), "pending")
    return entries.select("id", "status", "attempts").orderBy(ob.file_order(F.col("id")))


def retry(spark, sf):
    seq = F.lit(1_000_000_000)
    entries = ob.outbox_state(fx.outbox_log(spark, sf))
    return ob.retry_events(entries, seq, F.lit(fx.RUN.now)).select("seq", "id", "event", "at")


# --- delivery -------------------------------------------------------------------------------------------


def _pending(spark, sf):
    first = ob.first_per_id(_document_captures(spark, sf).select("id", "doc_id", "privacy"), F.col("doc_id"))
    return first.select("id", F.col("privacy.level").alias("level"))


def privacy_gate(spark, sf):
    return dl.gate_matrix(_pending(spark, sf), [FILE_TARGET, PUSH_TARGET])


def sync_limit(spark, sf):
    return dl.sync_plan(_pending(spark, sf), PUSH_TARGET.accepted, limit=SYNC_LIMIT, keep=("id", "level"))


def sync_ids(spark, sf):
    wanted = _document_captures(spark, sf).where(F.col("stored")).select("id")
    return dl.sync_plan(_pending(spark, sf), PUSH_TARGET.accepted, ids=wanted).select("id", "level", "reason")


def _try_send(identifier: str, value: str) -> str | None:
    """Stand-in transport: refuses captures whose id ends in a zero."""
    return "Webhook responded HTTP 500" if identifier.endswith("0") else None


def _outcomes(spark, sf):
    plan = dl.sync_plan(_pending(spark, sf), PUSH_TARGET.accepted)
    payload = plan.where(F.col("reason").isNull()).select("id", F.to_json(F.struct("id", "level")).alias("value"))
    return plan, dl.push_in_steps(payload, _try_send)


def push_outcomes(spark, sf):
    return _outcomes(spark, sf)[1]


def sync_summary(spark, sf):
    return dl.sync_summary(dl.sync_outcomes(*_outcomes(spark, sf)), PUSH_TARGET.id)


def file_export(spark, sf):
    folder = shared_folder(spark)
    dl.export_captures(web_captures(fx.responses(spark, sf), fx.RUN), folder)
    back = spark.read.text(folder).select(F.parse_json("value").alias("_v"))
    get = lambda path: F.variant_get("_v", path, "string")
    return back.select(
        get("$.id").alias("id"),
        get("$.subject.uri").alias("uri"),
        get("$.payload.text").alias("text"),
        F.variant_get("_v", "$.metadata.content_length", "bigint").alias("content_length"),
    )


# --- settings and rules ------------------------------------------------------------------------------------


def _instance_versions(spark, sf):
    rows = fx.table(spark, sf, "events").select(
        F.concat(F.lit("i"), F.col("user_id").cast("string")).alias("id"),
        F.col("event_type").alias("connector"),
        "props",
        F.col("event_id").alias("position"),
    )
    stored = F.col("connector").isin("signup", "error")
    return rows.where(stored), rows.where(~stored)


def config_upsert(spark, sf):
    old, new = _instance_versions(spark, sf)
    existing = old.groupBy("id").agg(
        F.max("connector").alias("connector"), F.max("props").alias("props"), F.min("position").alias("position")
    )
    return settings.upsert(existing, new).select(
        "id", "connector", "props", F.col("position._version").cast("bigint").alias("is_new"), F.col("position._at").alias("position")
    )


def config_remove(spark, sf):
    old, new = _instance_versions(spark, sf)
    return settings.removal_report(old, new)


def config_carry(spark, sf):
    old, new = _instance_versions(spark, sf)
    existing = old.groupBy("id").agg(
        F.max(F.when(F.col("props") < '{"k": 2', "0 1 * * *")).alias("schedule"),
        F.max("props").alias("checkpoint"),
    )
    asked = new.groupBy("id").agg(F.max("props").alias("config"), F.count("*").alias("n")).select(
        "id",
        F.when(F.col("n") > 13, WEB_MANIFEST.id).otherwise(repo.REPOSITORY_MANIFEST.id).alias("connector"),
        F.lit(True).alias("enabled"),
        F.when(F.col("n") > 15, "@daily").alias("schedule"),
        "config",
    )
    return settings.carry_state(asked, existing, manifests(spark)).select(
        "id", "connector", "schedule", "config", "checkpoint"
    )


def manifests(spark):
    return spark.createDataFrame(
        [(m.id, m.default_schedule) for m in (WEB_MANIFEST, repo.REPOSITORY_MANIFEST)],
        "id string, default_schedule string",
    )


def runnable_instances(spark, sf):
    trigger = (
        F.when(F.col("event_type") == "error", "cron")
        .when(F.col("value") < 10, "manual")
        .otherwise("schedule")
    )
    rows = fx.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.when(F.col("event_type") == "click", "other").otherwise(WEB_MANIFEST.id).alias("connector"),
        (F.col("event_type") != "view").alias("enabled"),
        trigger.alias("trigger"),
    )
    return settings.runnable(rows, manifests(spark)).select("id", "connector", "trigger", "error")


def config_errors(spark, sf):
    rows = fx.events(spark, sf).select("event_id", F.expr(fx.OPTIONS_JSON).alias("config"))
    return rules.config_errors(rows, repo.REPOSITORY_MANIFEST.config_schema, "event_id")


def rule_sets(spark, sf):
    """The option rules of pages, file and push targets and a set with lists of objects, over all conversations."""
    turns = fx.table(spark, sf, "conversations")
    sets = {
        "page": (fx.PAGE_CONFIG, WEB_MANIFEST.config_schema),
        "file": (fx.FILE_CONFIG, rules.TARGET_SCHEMAS["file"]),
        "webhook": (fx.HOOK_CONFIG, rules.TARGET_SCHEMAS["webhook"]),
        "list": (fx.LIST_CONFIG, fx.LIST_RULES),
    }
    found = []
    for name, (config, schema) in sets.items():
        rows = turns.select(F.struct("conv_id", "turn").alias("row"), F.expr(config).alias("config"))
        errors = rules.config_errors(rows, schema, "row")
        found.append(errors.select(F.lit(name).alias("rule_set"), "row.conv_id", "row.turn", "error"))
    return reduce(DataFrame.unionByName, found)


def option_suggestions(spark, sf):
    known = list(repo.REPOSITORY_MANIFEST.config_schema["properties"])
    # Misspelt names: declared ones with the event's whole properties in them.
    bare = F.regexp_replace("props", '[{}": ]', "")
    key = F.concat(F.col("event_type"), F.lit("_"), bare, F.lit("ranch"))
    rows = fx.events(spark, sf).select(
        "event_id",
        F.when(F.col("event_type") == "click", F.lit("site_ur"))
        .when(F.col("event_type") == "view", F.concat(F.lit("token_"), bare))
        .when(F.col("event_type") == "error", F.lit("allow_llm"))
        .otherwise(key)
        .alias("option"),
    )
    return rows.select("event_id", "option", rules.suggestion(F.col("option"), known).alias("hint"))


def capture_rejects(spark, sf):
    rows = fx.events(spark, sf).select("event_id", F.expr(fx.CAPTURE_JSON).alias("value"))
    return rules.capture_rejects(rows, "event_id", "value")


def instances_normalized(spark, sf):
    rows = fx.events(spark, sf).select("event_id", F.expr(fx.INSTANCE_JSON).alias("value"))
    return rules.normalize_instances(rows).drop("value")


def targets_normalized(spark, sf):
    rows = fx.events(spark, sf).select("event_id", F.expr(fx.TARGET_JSON).alias("value"))
    return rules.normalize_targets(rows).select(
        "event_id", "problem", "id", "kind", "directory", "url", "timeout_ms",
        F.array_join("levels", "|").alias("levels"),
    )


# --- end-to-end runs -----------------------------------------------------------------------------------------


def run_and_summary(spark, sf):
    """Web run into an empty outbox, then its summary."""
    outbox = Outbox(spark, shared_folder(spark))
    run_source(Collected(web_captures(fx.responses(spark, sf), fx.RUN)), outbox, "run-1")
    return ob.outbox_summary(outbox.entries())


def incremental_runs(spark, sf):
    """Two runs over the same repositories: all documents first, none in the repeat."""
    folder = shared_folder(spark)
    outbox, checkpoints = Outbox(spark, f"{folder}/outbox"), Checkpoints(spark, f"{folder}/state")
    config = fx.repository_sources(spark, sf).select(
        "instance_id",
        F.concat(F.lit("https://github.com/octo/"), F.col("instance_id")).alias("repository_url"),
        F.lit("main").alias("branch"),
        F.lit("content").alias("content_dir"),
        "tree_sha",
        "truncated",
    )
    reports = []
    for step in (1, 2):
        collected = collect_repository(
            config, fx.repository_listing(spark, sf), fx.repository_blobs(spark, sf),
            checkpoints.headers(), checkpoints.files(), fx.RUN,
        )
        report = run_source(collected, outbox, f"run-{step}", checkpoints)
        reports.append((step, report["collected"], report["enqueued"]))
    return spark.createDataFrame(reports, "step long, collected long, enqueued long")


def sync_loop(spark, sf):
    """Enqueue, deliver, retry the failures, deliver again: final entry counts."""
    outbox = Outbox(spark, shared_folder(spark))
    outbox.enqueue(_document_captures(spark, sf).drop("stored"), "docs", F.col("doc_id"))
    sync(outbox, PUSH_TARGET, "sync-1", send=_try_send)
    outbox.retry("retry-1")
    sync(outbox, PUSH_TARGET, "sync-2", send=_try_send)
    return outbox.entries().groupBy("status", "attempts").agg(F.count("*").alias("entries"))


def _page_instances(spark, sf):
    """An instance per page: most may run, some are off, have an unknown source or break the option rules."""
    by = lambda n: F.col("page_id") % n == 0
    url = F.to_json(F.struct("url"))
    return fx.table(spark, sf, "pages").select(
        F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("id"),
        F.when(by(13), "nothing").otherwise(WEB_MANIFEST.id).alias("connector"),
        (~by(7)).alias("enabled"),
        F.when(by(11), F.lit('{"url":5,"tagz":[]}')).when(by(5), F.lit('{"note":"x"}')).otherwise(url).alias("config"),
    )


def run_registry(spark, sf):
    """A scheduled run of all page instances: counts, and what keeps instances from running."""
    folder = shared_folder(spark)
    registry = Registry.of([WebSource(fx.responses(spark, sf).drop("page_id"))])
    report = run(
        registry, _page_instances(spark, sf), Outbox(spark, f"{folder}/outbox"), Checkpoints(spark, f"{folder}/state"), fx.RUN, mode="quarantine"
    )
    counts = [(None, name, None, c["collected"], c["enqueued"]) for name, c in report.counts.items()]
    schema = "id string, connector string, error string, collected long, enqueued long"
    problems = report.problems.select("*", F.lit(None).cast("long").alias("collected"), F.lit(None).cast("long").alias("enqueued"))
    return problems.unionByName(spark.createDataFrame(counts, schema))


class _Shelf:
    """A target of its own kind: takes private captures too, and has no room for ids that end in a zero."""

    def accepts(self):
        return F.when(F.col("level") == "sensitive", "not on a shelf")

    def deliver(self, captures):
        full = F.when(F.col("id").endswith("0"), "full")
        return captures.select("id", F.when(full.isNull(), "sent").otherwise("failed").alias("status"), full.alias("error"))


def sync_custom(spark, sf):
    """Delivery in three waves to a target of a custom kind: outcomes by level and detail."""
    outbox = Outbox(spark, shared_folder(spark))
    outbox.enqueue(_document_captures(spark, sf).drop("stored"), "docs", F.col("doc_id"))
    levels = outbox.captures().select("id", F.col("privacy.level").alias("level"))
    done = sync(outbox, dl.Target("shelf", "shelf"), "sync", deliverer=_Shelf(), waves=3)
    return done.join(levels, "id").groupBy("level", "outcome", "detail").agg(F.count("*").alias("entries"))


# --- streams ----------------------------------------------------------------------------------------------------


def _stream_table(spark, sf, name):
    """A given table as a stream, be it one file or a folder of files.

    A stream takes a single file only by a pattern, so the last letter of its name is one.
    """
    schema = fx.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("basePath", sf).parquet(f"{sf}/{name}.parque[t]")


def _stream_responses(spark, sf):
    return _stream_table(spark, sf, "pages").select(
        "url",
        F.lit(200).alias("status"),
        F.lit("text/html").alias("content_type"),
        F.col("html").alias("body"),
        F.lit("pages").alias("instance_id"),
    )


def stream_captures(spark, sf):
    folder = shared_folder(spark)
    pipelines.stream_captures(
        _stream_responses(spark, sf), fx.RUN, f"{folder}/captures", f"{folder}/progress"
    ).awaitTermination()
    return flat_web(spark.read.parquet(f"{folder}/captures"))


def _stream_document_captures(spark, sf):
    rows = _stream_table(spark, sf, "documents").select(
        F.concat(F.lit("text://manual/"), F.sha2("text", 256)).alias("uri"),
        "text",
        F.array("lang").alias("tags"),
        F.when(F.col("lang") == "de", "sensitive").otherwise("public").alias("privacy_level"),
    )
    return sub.manual_captures(rows, fx.RUN.now)


def stream_enqueue(spark, sf):
    folder = shared_folder(spark)
    outbox = Outbox(spark, f"{folder}/outbox")
    for attempt in ("first", "again"):  # the second stream finds every id stored
        pipelines.stream_enqueue(
            _stream_document_captures(spark, sf), outbox, f"{folder}/{attempt}", attempt
        ).awaitTermination()
    return outbox.entries().select("id", "status", "attempts")


def stream_changes(spark, sf):
    folder = shared_folder(spark)
    checkpoints = Checkpoints(spark, f"{folder}/state")
    sources = fx.repository_sources(spark, sf)
    checkpoints.replace(fx.checkpoint_headers(spark, sf), fx.checkpoint_files(spark, sf), -1)
    labels = fx.table(spark, sf, "labels")
    listing = (
        _stream_table(spark, sf, "documents")
        .join(labels, "doc_id", "left")
        .select(
            F.lit(1).alias("scan_id"),
            F.col("source").alias("instance_id"),
            F.expr(fx.PATH).alias("path"),
            F.expr(fx.KIND).alias("type"),
            F.sha2(F.expr(fx.GOOD_TEXT), 256).alias("sha"),
        )
    )
    pipelines.stream_changes(
        listing, sources, checkpoints, fx.RUN, f"{folder}/changed", f"{folder}/progress"
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/changed").select("instance_id", "path", "sha")


def stream_changes_split(spark, sf):
    """The listing in three files, each a micro-batch of its own: every snapshot is complete with the last one only."""
    folder = shared_folder(spark)
    checkpoints = Checkpoints(spark, f"{folder}/state")
    checkpoints.replace(fx.checkpoint_headers(spark, sf), fx.checkpoint_files(spark, sf), -1)
    listing = fx.repository_listing(spark, sf)
    sizes = listing.groupBy("instance_id").agg(F.countDistinct("path").alias("entries"))
    rows = listing.join(sizes, "instance_id").select(F.lit(1).cast("long").alias("scan_id"), *listing.columns, "entries")
    rows.repartition(3, "path").write.parquet(f"{folder}/listing")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/listing")
    pipelines.stream_changes(
        stream, fx.repository_sources(spark, sf), checkpoints, fx.RUN, f"{folder}/changed", f"{folder}/progress"
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/changed").select("instance_id", "path", "sha")


def stream_rejects(spark, sf):
    """Pages without a usable address, of a stream whose other pages become captures."""
    folder = shared_folder(spark)
    pages = _stream_responses(spark, sf)
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    broken = F.when(F.length("body") % 3 == 0, F.replace("url", host, F.lit("1.2.3.256")))
    rows = pages.withColumn("url", F.when(F.length("body") % 5 == 0, F.lit("mailto:a@b")).otherwise(F.coalesce(broken, "url")))
    pipelines.stream_captures(rows, fx.RUN, f"{folder}/captures", f"{folder}/progress", f"{folder}/rejects").awaitTermination()
    taken = spark.read.parquet(f"{folder}/captures").select(F.col("subject.url").alias("url"), F.lit(None).cast("string").alias("problem"))
    refused = spark.read.parquet(f"{folder}/rejects").select("url", "problem")
    return taken.unionByName(refused).groupBy("url", "problem").agg(F.count("*").alias("pages"))


def stream_sync(spark, sf):
    folder = shared_folder(spark)
    outbox = Outbox(spark, f"{folder}/outbox")
    pipelines.stream_sync(
        _stream_document_captures(spark, sf), outbox, PUSH_TARGET, _try_send, f"{folder}/progress"
    ).awaitTermination()
    return outbox.entries().select("id", "status", "attempts", "last_error")


QUERIES: dict[str, Query] = {
    "web_captures": web_captures_query,
    "repo_captures": repo_captures,
    "listing_guard": listing_guard,
    "blob_decode": blob_decode,
    "resolve_ref": resolve_ref,
    "manual_captures": manual_captures,
    "manual_uri": manual_uri,
    "import_captures": import_captures,
    "import_files": import_files,
    "legacy_import": legacy_import,
    "outbox_list": outbox_list,
    "legacy_outbox": legacy_outbox,
    "checkpoint_valid": checkpoint_valid,
    "fetch_triage": fetch_triage,
    "file_export": file_export,
    "push_outcomes": push_outcomes,
    "enqueue": enqueue,
    "checkpoint_next": checkpoint_next,
    "config_upsert": config_upsert,
    "config_remove": config_remove,
    "config_carry": config_carry,
    "stable_ids": stable_ids,
    "page_text": page_text,
    "page_title": page_title,
    "canonical_urls": canonical_urls,
    "page_lengths": page_lengths,
    "page_hosts": page_hosts,
    "normalize_tags": normalize_tags,
    "frontmatter_tags": frontmatter_tags,
    "slugs": slugs,
    "document_urls": document_urls,
    "parse_repo_url": parse_repo_url,
    "privacy_defaults": privacy_defaults,
    "option_suggestions": option_suggestions,
    "frontmatter_split": frontmatter_split,
    "frontmatter_lines": frontmatter_lines,
    "frontmatter_leaves": frontmatter_leaves,
    "frontmatter_nested": frontmatter_nested,
    "frontmatter_rejects": frontmatter_rejects,
    "listing_filter": listing_filter,
    "privacy_gate": privacy_gate,
    "sync_ids": sync_ids,
    "runnable_instances": runnable_instances,
    "retry": retry,
    "changed_files": changed_files,
    "unchanged_sources": unchanged_sources,
    "outbox_summary": outbox_summary,
    "outbox_rejects": outbox_rejects,
    "outbox_compacted": outbox_compacted,
    "outbox_counts": outbox_counts,
    "privacy_conflicts": privacy_conflicts,
    "run_report": run_report,
    "sync_summary": sync_summary,
    "outbox_state": outbox_state,
    "sync_limit": sync_limit,
    "capture_rejects": capture_rejects,
    "config_errors": config_errors,
    "rule_sets": rule_sets,
    "instances_normalized": instances_normalized,
    "targets_normalized": targets_normalized,
    "full_rescan": full_rescan,
    "run_and_summary": run_and_summary,
    "incremental_runs": incremental_runs,
    "sync_loop": sync_loop,
    "sync_custom": sync_custom,
    "run_registry": run_registry,
    "stream_captures": stream_captures,
    "stream_enqueue": stream_enqueue,
    "stream_changes": stream_changes,
    "stream_sync": stream_sync,
    "stream_changes_split": stream_changes_split,
    "stream_rejects": stream_rejects,
}
