"""Imports of capture files and of an outbox that kept one file per entry."""

import json

from gleanflow.operators.layout import spread_rows
from gleanflow.operators.tables import Outbox
from gleanflow.sources import submissions as sub
from test_snapshots import capture_rows, id_rows


def capture(identifier):
    return {
        "schema_version": "capture.v1", "id": identifier, "connector": "x", "instance_id": None, "observed_at": "o", "captured_at": "c",
        "subject": {"kind": "url", "uri": f"u/{identifier}"}, "payload": {"kind": "text", "text": "é\n\"x\""}, "tags": ["t"],
        "metadata": {"n": 1}, "privacy": {"level": "public", "allow_cloud_llm": False}, "provenance": {"trigger": "manual", "connector_version": "x@1"},
    }


def entry(identifier, status, attempts=0, error=None):
    return {"capture": capture(identifier), "status": status, "attempts": attempts, "last_error": error, "updated_at": f"at-{identifier}"}


FILES = {
    "a.json": entry("a", "pending"), "b.json": entry("b", "failed", 3, "down"), "deep/c.json": entry("c", "sent", 2), "d.json": entry("d", "odd", 1, "why"),
    "e.json": entry("e", "failed", 0), "stored.json": entry("stored", "failed", 5), "none.json": {"status": "sent"}, "twice.json": entry("a", "sent", 9),
}


def test_legacy_entries_become_whole_entries(spark, tmp_path):
    folder = tmp_path / "old"
    for name, value in FILES.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(json.dumps(value, indent=2))
    (folder / "broken.json").write_text('{"capture":')
    (folder / "other.txt").write_text("x")
    outbox = Outbox(spark, str(tmp_path / "outbox"), 4)
    outbox.enqueue(capture_rows(spark, ["stored"]), "before")
    outbox.mark(id_rows(spark, "stored"), "sent", "done").count()
    report = sub.import_legacy(outbox, sub.legacy_files(spark, str(folder)), "old")
    assert report["enqueued"] == 5
    assert sorted((r["file_path"].rsplit("/", 1)[1], r["problem"]) for r in report["rejects"].collect()) == [
        ("broken.json", "not valid JSON"), ("none.json", "Unsupported capture schema"),
    ]
    want = [
        ("a", "pending", 0, None, "at-a"), ("b", "failed", 3, "down", "at-b"), ("c", "sent", 2, None, "at-c"),
        ("d", "pending", 1, "why", "at-d"), ("e", "failed", 1, None, "at-e"),
    ]
    state = lambda: sorted(tuple(r) for r in outbox.entries().where("id <> 'stored'").select("id", "status", "attempts", "last_error", "updated_at").collect())
    assert state() == want
    assert outbox.entries().where("id = 'stored'").first()["status"] == "sent"
    assert sub.import_legacy(outbox, sub.legacy_files(spark, str(folder)), "old")["enqueued"] == 0 and state() == want
    body = outbox.captures().where("id = 'b'").first()
    assert body["payload"]["text"] == "é\n\"x\"" and json.loads(body["metadata"]) == {"n": 1}


def test_capture_files(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(capture("one"), indent=1))
    (tmp_path / "bad.json").write_text("[]")
    found = {r["file_name"]: (r["problem"], r["capture"] and r["capture"]["id"]) for r in sub.read_capture_files(spark, str(tmp_path)).collect()}
    assert found["one.json"] == (None, "one") and found["bad.json"][0] and found["bad.json"][1] is None


def test_narrow_rows_are_spread_by_their_number(spark, tmp_path):
    spark.range(0, 5000, 1, 1).write.parquet(str(tmp_path / "t"))  # one row group: one split reads it all
    scan = spark.read.option("maxPartitionBytes", "1").parquet(str(tmp_path / "t"))
    parts = [len(p) for p in spread_rows(scan, "id", rows=250).rdd.glom().collect()]
    assert len(parts) == 20 and sum(parts) == 5000 and max(parts) < 400


def test_a_capture_is_read_once(spark):
    rows = sub.read_captures(spark.createDataFrame([(json.dumps(capture("one")),)], "value string"))
    plan = rows.select("problem", "capture.id", "capture.subject.uri", "capture.tags")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("parseJson(") == 1
    assert rows.first()["capture"]["subject"]["uri"] == "u/one"
