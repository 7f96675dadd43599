"""Gate, limit, targets and outcome accounting."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gleanflow.operators import delivery as dl
from gleanflow.operators import settings
from gleanflow.operators.tables import Outbox, shared_folder
from gleanflow.plans.run import sync
from gleanflow.sources.submissions import manual_captures
from gleanflow.streaming import pipelines

PUSH = dl.Target("hook", "webhook", {"url": "https://h.example"})


def captures(spark, levels, **extra):
    rows = [(f"https://e.example/{i}", level) for i, level in enumerate(levels)]
    df = spark.createDataFrame(rows, "uri string, privacy_level string")
    return manual_captures(df, "2024-01-01T00:00:00.000Z")


def loop(rows, accepted, limit):
    visited, tried = [], 0
    for identifier, level in sorted(rows, key=lambda r: r[0] + ".json"):
        if limit is not None and tried >= limit:
            break
        visited.append((identifier, level not in accepted))
        tried += level in accepted
    return visited


@pytest.mark.parametrize("limit", [None, 1, 7, 30, 44, 45, 500])
@pytest.mark.parametrize("ranges", [1, 7])
def test_limit_equals_loop(spark, limit, ranges):
    levels = ["public", "private", "sensitive", "private"]
    rows = [(f"c{(i * 7919) % 997:03d}", levels[i % 4]) for i in range(60)]
    pending = spark.createDataFrame(rows, "id string, level string")
    plan = dl.sync_plan(pending, PUSH.accepted, limit, ranges=ranges)
    got = sorted((r["id"], r["reason"] is not None) for r in plan.collect())
    assert got == sorted(loop(rows, PUSH.accepted, limit))


def test_limit_must_be_positive(spark):
    pending = spark.createDataFrame([("a", "public")], "id string, level string")
    for bad in (0, -1, 1.5, True):
        with pytest.raises(ValueError):
            dl.sync_plan(pending, PUSH.accepted, bad)


def test_gate_and_ids(spark):
    pending = spark.createDataFrame([("a", "public"), ("b", "sensitive")], "id string, level string")
    wanted = spark.createDataFrame([("b",), ("nope",)], "id string")
    row = dl.sync_plan(pending, PUSH.accepted, ids=wanted).first()
    assert (row["id"], row["reason"]) == ("b", 'privacy level "sensitive" is not accepted by this target')
    assert dl.sync_plan(pending, PUSH.accepted, ids=wanted.where("id = ''")).count() == 2
    assert dl.sync_plan(pending, PUSH.accepted, ids=wanted.where("id = 'nope'")).count() == 0
    matrix = dl.gate_matrix(pending, [PUSH, dl.Target("f", "file"), dl.Target("only", "file", levels=("public",))])
    assert {(r["target"], r["id"]): r["accepted"] for r in matrix.collect()} == {
        ("hook", "a"): True, ("hook", "b"): False, ("f", "a"): True, ("f", "b"): True,
        ("only", "a"): True, ("only", "b"): False,
    }


def test_sync_marks_and_retries(spark):
    outbox = Outbox(spark, shared_folder(spark))
    assert outbox.enqueue(captures(spark, ["public", "sensitive", "private"]), "b1") == 3
    assert outbox.enqueue(captures(spark, ["public", "sensitive", "private"]), "b2") == 0

    def broken(identifier, value):
        raise RuntimeError("no route")

    first = {r["outcome"]: r["detail"] for r in sync(outbox, PUSH, "s1", send=broken).collect()}
    assert first == {"failed": "no route", "skipped": 'privacy level "sensitive" is not accepted by this target'}
    assert outbox.retry("r1") == 2
    sent = sync(outbox, PUSH, "s2", send=lambda identifier, value: None, limit=1)
    assert sent.where("outcome = 'delivered'").count() == 1
    sync(outbox, PUSH, "s3", send=lambda identifier, value: None, lanes=2)
    state = sorted((r["status"], r["attempts"], r["target"]) for r in outbox.entries().collect())
    assert state == [("pending", 0, None), ("sent", 1, "hook"), ("sent", 1, "hook")]


def test_remove_and_enqueue_again(spark):
    outbox = Outbox(spark, shared_folder(spark))
    one = captures(spark, ["public"])
    outbox.enqueue(one, "b1")
    outbox.mark(one, "sent", "m1")
    outbox.mark(one, "remove", "m2")
    assert outbox.entries().count() == 0
    assert outbox.enqueue(one, "b2") == 1
    assert [(r["status"], r["attempts"]) for r in outbox.entries().collect()] == [("pending", 0)]
    assert outbox.pending().count() == 1


def test_repeating_a_batch_changes_nothing(spark):
    outbox = Outbox(spark, shared_folder(spark))
    rows = captures(spark, ["public", "private"])
    assert outbox.enqueue(rows, "same") == 2
    assert outbox.enqueue(rows, "same") == 0
    assert outbox.entries().count() == 2


def test_a_replay_leaves_delivered_entries_alone(spark):
    outbox = Outbox(spark, shared_folder(spark))
    rows = captures(spark, ["public", "private"])
    outbox.enqueue(rows, "b1")
    outbox.mark(rows.select("id"), "sent", "m1")
    assert outbox.enqueue(rows, "b1") == 0
    assert [r["status"] for r in outbox.entries().collect()] == ["sent", "sent"]


def test_first_of_equal_ids_does_not_depend_on_the_run(spark):
    rows = captures(spark, ["public", "public"]).withColumn("id", F.lit("same"))
    kept = set()
    for order in ("uri", None):
        outbox = Outbox(spark, shared_folder(spark))
        shuffled = rows.repartition(3) if order else rows.coalesce(1)
        assert outbox.enqueue(shuffled, "b") == 1
        kept.add(tuple(outbox.captures().select("subject.uri", "privacy.level").first()))
    assert len(kept) == 1


def test_stream_sync_replay_posts_nothing_twice(spark, tmp_path):
    outbox = Outbox(spark, shared_folder(spark))
    captures(spark, ["public", "private"]).write.parquet(str(tmp_path / "in"))
    log = tmp_path / "posts"
    log.mkdir()

    def send(id_, value):
        with open(log / id_.replace("/", "_"), "a") as handle:
            handle.write("x")

    target = dl.Target("hook", "webhook", {"url": "https://hook.example/in", "allowed_privacy_levels": ["public", "private"]})
    for attempt in ("one", "two"):
        source = spark.readStream.schema(captures(spark, ["public"]).schema).parquet(str(tmp_path / "in"))
        pipelines.stream_sync(source, outbox, target, send, str(tmp_path / attempt)).awaitTermination()
    assert sum(len(p.read_text()) for p in log.iterdir()) == len(list(log.iterdir())) > 0
    assert {r["status"] for r in outbox.entries().collect()} <= {"sent", "pending"}


def test_file_targets(spark):
    folder = shared_folder(spark)
    rows = captures(spark, ["public", "sensitive"])
    outbox = Outbox(spark, f"{folder}/outbox")
    outbox.enqueue(rows, "b")
    sync(outbox, dl.Target("files", "file", {"directory": f"{folder}/out"}), "s")
    lines = [json.loads(r["value"]) for r in spark.read.text(f"{folder}/out").select("value").collect()]
    assert {line["privacy"]["level"] for line in lines} == {"public", "sensitive"}
    assert all(line["metadata"] == {} and line["instance_id"] is None for line in lines)
    assert {r["status"] for r in dl.export_files(rows, f"{folder}/single").collect()} == {"sent"}
    names = sorted(os.listdir(f"{folder}/single"))
    assert names == sorted(f"{r['id']}.json" for r in rows.collect())
    with open(f"{folder}/single/{names[0]}", encoding="utf-8") as handle:
        assert json.load(handle)["id"] + ".json" == names[0]


def test_custom_deliverer(spark):
    class TableTarget:
        def accepts(self):
            return F.when(F.col("payload.kind") != "reference", "only references")

        def deliver(self, rows):
            refused = F.when(F.col("level") == "private", "full")
            return rows.select("id", F.when(refused.isNull(), "sent").otherwise("failed").alias("status"), refused.alias("error"))

    outbox = Outbox(spark, shared_folder(spark))
    outbox.enqueue(captures(spark, ["public", "private", "sensitive"]), "b")
    done = sync(outbox, dl.Target("table", "custom"), "s", deliverer=TableTarget())
    assert sorted(r["outcome"] for r in done.collect()) == ["delivered", "delivered", "failed"]
    assert sorted((r["status"], r["last_error"]) for r in outbox.entries().collect()) == [
        ("failed", "full"), ("sent", None), ("sent", None),
    ]


def test_missing_token_is_a_failure():
    hook = dl.Webhook.of(dl.Target("t", "webhook", {"url": "https://h.example", "token_env": "GLEANFLOW_TEST_UNSET_TOKEN"}))
    assert hook.connect()("id", "{}") == "Environment variable GLEANFLOW_TEST_UNSET_TOKEN is not set"


def test_settings(spark):
    schema = "id string, connector string, position long"
    existing = spark.createDataFrame([("a", "x", 0), ("b", "x", 1)], schema)
    incoming = spark.createDataFrame([("c", "n", 0), ("a", "y", 1), ("a", "z", 2)], schema)
    merged = settings.upsert(existing, incoming).orderBy("position").collect()
    assert [(r["id"], r["connector"]) for r in merged] == [("a", "z"), ("b", "x"), ("c", "n")]
    gone = spark.createDataFrame([("a",), ("q",)], "id string")
    assert [r["id"] for r in settings.remove(existing, gone).collect()] == ["b"]
    assert {r["id"]: r["removed"] for r in settings.removal_report(existing, gone).collect()} == {"a": True, "q": False}
    twice = spark.createDataFrame([("m", None), ("m", None), ("k", None)], "id string, default_schedule string")
    assert [r["id"] for r in settings.duplicate_manifests(twice).collect()] == ["m"]
    with pytest.raises(ValueError):
        settings.check_trigger("cron")
    assert settings.check_trigger("import") == "import"


def test_marks_of_unknown_entries_are_returned(spark, tmp_path):
    outbox = Outbox(spark, str(tmp_path))
    outbox.enqueue(captures(spark, ["public"]), "b")
    known = outbox.captures().select("id")
    assert outbox.mark(known, "sent", "m1").count() == 0
    rows = outbox.mark(known.unionByName(spark.createDataFrame([("nope",)], "id string")), "failed", "m2", "x").collect()
    assert [(r["id"], r["error"]) for r in rows] == [("nope", "Unknown outbox entry: nope")]
    assert [(r["status"], r["attempts"]) for r in outbox.entries().collect()] == [("failed", 1)]


def test_gate_and_limit_read_no_bodies(spark, tmp_path):
    outbox = Outbox(spark, str(tmp_path))
    outbox.enqueue(captures(spark, ["public", "sensitive", "private"]), "b")
    plan = dl.sync_plan(outbox.pending(), PUSH.accepted, 1).select("id", "seq", "reason")
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in shown and "payload" not in shown and "metadata" not in shown
    assert plan.where("reason is null").count() == 1


def test_a_lane_sends_in_order_by_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    outbox = Outbox(spark, shared_folder(spark))
    assert outbox.enqueue(captures(spark, ["public"] * 60), "b1") == 60
    sent = tmp_path / "sent"

    def send(identifier, value):
        from pyspark import TaskContext

        with open(sent, "a") as log:
            log.write(f"{TaskContext.get().taskAttemptId()} {identifier}\n")
        return "no" if identifier.endswith("0") else None

    monkeypatch.setattr(dl, "STEP_BYTES", 4_000, raising=False)
    outcomes = {r["id"]: r["outcome"] for r in sync(outbox, PUSH, "s1", send=send).collect()}
    tasks, ids = zip(*[line.split() for line in sent.read_text().splitlines()], strict=True)
    assert list(ids) == sorted(ids, key=lambda i: i + ".json") and len(set(ids)) == 60
    assert len(set(tasks)) > 5 and max(tasks.count(t) for t in tasks) < 30
    assert outcomes == {i: "failed" if i.endswith("0") else "delivered" for i in ids}
