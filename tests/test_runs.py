"""The run entry, waves of a sync, failing exports, and the counters of the writing jobs."""

import pytest
from pyspark.sql import functions as F

from gleanflow.operators import delivery as dl
from gleanflow.operators.tables import Checkpoints, Outbox
from gleanflow.plans import fixtures as fx
from gleanflow.plans.run import Collected, Registry, RepositorySource, WebSource, run, run_source, sync
from test_repository import FRONT, sha
from test_snapshots import capture_rows

RESPONSES = "url string, body string, status int"


@pytest.fixture
def place(spark, tmp_path):
    return Outbox(spark, str(tmp_path / "outbox"), 4), Checkpoints(spark, str(tmp_path / "state"))


def instances(spark, *rows):
    return spark.createDataFrame(rows, "id string, connector string, enabled boolean, config string")


def web(spark):
    return WebSource(spark.createDataFrame([("https://a.example/", "<title>A</title>x", 200), ("https://b.example/", "b", 404)], RESPONSES))


def repository(spark):
    files = [("r", "posts/a.md", "blob", sha(FRONT), None)]
    import base64

    return RepositorySource(
        spark.createDataFrame([("https://github.com/o/r", "tree-1", False)], "repository_url string, tree_sha string, truncated boolean"),
        spark.createDataFrame(files, "instance_id string, path string, type string, sha string, url string"),
        spark.createDataFrame([(sha(FRONT), "base64", base64.b64encode(FRONT.encode()).decode())], "sha string, encoding string, content string"),
    )


GOOD = [
    ("w", "web-page", True, '{"url":"https://a.example/","tags":["t"],"privacy_level":"public"}'),
    ("r", "repository-documents", True, '{"repository_url":"https://github.com/o/r","branch":"main","content_dir":"posts"}'),
]


def test_run_of_two_sources(spark, place):
    outbox, state = place
    registry = Registry.of([web(spark), repository(spark)])
    report = run(registry, instances(spark, *GOOD), outbox, state, fx.RUN)
    assert report.counts == {"repository-documents": {"collected": 1, "enqueued": 1}, "web-page": {"collected": 1, "enqueued": 1}}
    page = outbox.captures().where("connector = 'web-page'").first()
    assert (page["instance_id"], page["tags"], page["privacy"]["level"], page["subject"]["title"]) == ("w", ["t"], "public", "A")
    again = fx.RunContext("run_2", "manual", fx.RUN.now)
    off = [(*row[:2], False, row[3]) for row in GOOD]  # a manual run starts what is switched off
    assert run(registry, instances(spark, *off), outbox, state, again).counts["repository-documents"] == {"collected": 0, "enqueued": 0}
    full = fx.RunContext("run_3", "manual", fx.RUN.now)
    assert run(registry, instances(spark, *GOOD), outbox, state, full, full=True).counts["repository-documents"] == {"collected": 1, "enqueued": 0}


def test_instances_that_may_not_run(spark, place):
    outbox, state = place
    registry = Registry.of([web(spark)])
    rows = [*GOOD, ("x", "web-page", False, "{}"), ("y", "web-page", True, "{"), ("z", "web-page", True, None), ("n", None, True, "{}")]
    with pytest.raises(ValueError, match="Unknown connector: null"):
        run(registry, instances(spark, *rows), outbox, state, fx.RUN)
    assert outbox.summary()["total"] == 0
    report = run(registry, instances(spark, *rows), outbox, state, fx.RUN, mode="quarantine")
    assert {r["id"]: r["error"] for r in report.problems.collect()} == {
        "r": "Unknown connector: repository-documents", "x": "Connector instance is disabled: x", "n": "Unknown connector: null",
        "y": "Invalid config for connector web-page (instance y):\n  - config must be valid JSON",
        "z": "Invalid config for connector web-page (instance z):\n  - config.url is required",
    }
    assert report.counts == {"web-page": {"collected": 1, "enqueued": 1, "rejected": 0}}
    assert run(registry, instances(spark), outbox, state, fx.RUN).counts == {}
    with pytest.raises(ValueError, match="already registered"):
        Registry.of([web(spark), web(spark)])


def test_captures_of_any_source_keep_the_contract(spark, place):
    outbox, _ = place
    rows = capture_rows(spark, "abc").withColumn("schema_version", F.lit("capture.v1"))
    broken = rows.withColumn("metadata", F.when(F.col("id") == "b", "[]").otherwise(F.col("metadata")))
    with pytest.raises(Exception, match="metadata must be an object"):
        run_source(Collected(broken), outbox, "bad")
    assert outbox.summary()["total"] == 0
    assert run_source(Collected(broken), outbox, "some", mode="quarantine") == {"collected": 2, "enqueued": 2, "rejected": 1}
    assert run_source(Collected(rows), outbox, "rest") == {"collected": 3, "enqueued": 1}
    with pytest.raises(Exception, match="Unsupported capture schema"):
        run_source(Collected(rows), outbox, "other", version="capture.v2")


def test_first_of_equal_ids_in_the_order_of_the_source(spark, place):
    outbox, _ = place
    rows = capture_rows(spark, "a").withColumn("schema_version", F.lit("capture.v1"))
    late = rows.withColumn("note", F.lit("z first"))
    both = late.unionByName(rows.withColumn("note", F.lit("a second")))
    assert run_source(Collected(both.coalesce(1)), outbox, "b") == {"collected": 2, "enqueued": 1}
    assert outbox.captures().first()["note"] == "z first"


def test_a_broken_wave_repeats_no_other(spark, place, tmp_path):
    outbox, _ = place
    ids = [f"c{i:02d}" for i in range(30)]
    outbox.enqueue(capture_rows(spark, ids), "b")
    log, trap = tmp_path / "sent", tmp_path / "trap"
    log.mkdir()
    trap.write_text("c15")

    def connect():
        def send(identifier, value):
            if trap.exists() and identifier >= trap.read_text():
                raise SystemExit("the machine goes down")
            with open(log / identifier, "a") as handle:
                handle.write("x")

        return send

    class Fragile:
        def accepts(self):
            return F.lit(None).cast("string")

        def deliver(self, captures):
            return dl.push_captures(captures.select("id", dl.capture_json().alias("value")), connect=connect)

    target = dl.Target("t", "webhook", {"url": "https://h.example"})
    with pytest.raises(BaseException):  # noqa: B017
        sync(outbox, target, "s", deliverer=Fragile(), waves=4)
    kept = {r["id"] for r in outbox.entries("sent").collect()}
    assert kept and max(kept) < "c15"
    trap.unlink()
    done = sync(outbox, target, "s", deliverer=Fragile(), waves=4)
    assert done.where("outcome = 'delivered'").count() == 30 - len(kept)
    assert outbox.summary() == {"total": 30, "pending": 0, "sent": 30, "failed": 0}
    assert all(len((log / i).read_text()) == 1 for i in kept)  # of finished waves nothing went out again


def test_a_failing_export_makes_failed_entries(spark, place, tmp_path):
    outbox, _ = place
    outbox.enqueue(capture_rows(spark, "ab"), "b")
    (tmp_path / "file").write_text("in the way")
    done = sync(outbox, dl.Target("f", "file", {"directory": f"{tmp_path}/file"}), "s")
    assert [r["outcome"] for r in done.collect()] == ["failed", "failed"]
    assert {(r["status"], r["attempts"], bool(r["last_error"])) for r in outbox.entries().collect()} == {("failed", 1, True)}
    outbox.retry("again")
    sync(outbox, dl.Target("f", "file", {"directory": f"{tmp_path}/folder"}), "s")
    assert {r["status"] for r in outbox.entries().collect()} == {"sent"}


def test_webhook_settings_are_resolved_once(monkeypatch):
    monkeypatch.setenv("GLEANFLOW_TEST_TOKEN", " secret ")
    target = dl.Target("t", "webhook", {"url": "https://h.example/in?x=1", "token_env": "GLEANFLOW_TEST_TOKEN", "headers": {"x-a": "1"}, "timeout_ms": None})
    headers, missing = dl.Webhook.of(target).resolved()
    assert missing is None and headers["authorization"] == "Bearer secret" and headers["x-a"] == "1"
    assert dl.refusal(500, b" no \xff ") == "Webhook responded HTTP 500: no �" and dl.refusal(404, b"") == "Webhook responded HTTP 404"
