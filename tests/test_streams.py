"""Streams: repeats across micro-batches, split snapshots, rejected pages; checkpoints per instance."""

import pytest
from pyspark.sql import functions as F

from gleanflow.contract import CAPTURE_SCHEMA, CHECKPOINT_FILES_SCHEMA, CHECKPOINT_HEADER_SCHEMA
from gleanflow.operators.tables import Checkpoints, Outbox
from gleanflow.plans import fixtures as fx
from gleanflow.plans import queries as q
from gleanflow.streaming import pipelines
from test_snapshots import capture_rows

LISTING = "scan_id long, instance_id string, path string, type string, sha string, entries long"


@pytest.fixture
def sources(spark):
    return spark.createDataFrame(
        [(i, "o", "r", "main", "p", None, False) for i in ("i", "j")],
        "instance_id string, owner string, repo string, ref string, content_dir string, tree_sha string, truncated boolean",
    )


def test_repeats_never_reach_the_batch(spark, tmp_path):
    seen = []

    class Watched(Outbox):
        def enqueue(self, captures, batch, order_by=None):
            seen.append(sorted(r["id"] for r in captures.select("id").collect()))
            return super().enqueue(captures, batch, order_by)

    outbox = Watched(spark, str(tmp_path / "o"), 4)

    def run(*ids):
        capture_rows(spark, ids).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(CAPTURE_SCHEMA).parquet(str(tmp_path / "in"))
        pipelines.stream_enqueue(stream, outbox, str(tmp_path / "progress")).awaitTermination()

    run("a", "b", "a")
    run("b", "c")  # a restart: state comes back from the checkpoint
    assert sum(seen, []) == ["a", "b", "c"]
    assert sorted(r["id"] for r in outbox.entries().collect()) == ["a", "b", "c"]


def test_split_snapshot_changes_nothing_until_it_is_whole(spark, tmp_path, sources):
    checkpoints = Checkpoints(spark, str(tmp_path / "state"))

    def step(*rows, patience=None):
        spark.createDataFrame([(*r[:2], f"p/{r[2]}.md", "blob", r[3], r[4]) for r in rows], LISTING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(LISTING).parquet(str(tmp_path / "in"))
        pipelines.stream_changes(
            stream, sources, checkpoints, fx.RUN, str(tmp_path / "out"), str(tmp_path / "progress"), patience
        ).awaitTermination()
        out = spark.read.parquet(max(str(f) for f in (tmp_path / "out").iterdir()))
        state = sorted((r["instance_id"], r["path"][2:3], r["sha"]) for r in checkpoints.files().collect())
        return sorted(r["instance_id"] + r["path"][2:3] for r in out.collect()), state

    assert step((1, "i", "a", "1", 3), (1, "j", "a", "1", 1), (1, "i", "a", "1", 3)) == (["ja"], [("j", "a", "1")])
    assert step((1, "i", "b", "1", 3), (1, "i", "a", "1", 3)) == ([], [("j", "a", "1")])
    whole = [("i", "a", "1"), ("i", "b", "1"), ("i", "c", "1"), ("j", "a", "1")]
    assert step((1, "i", "c", "1", 3), (2, "i", "a", "2", 2)) == (["ia", "ib", "ic"], whole)
    # Scan 3 overtakes scan 2, which is never complete.
    assert step((3, "i", "a", "3", 1), (2, "j", "a", "9", 2)) == (["ia"], [("i", "a", "3"), ("j", "a", "1")])
    assert step((4, "i", "b", "4", 2)) == ([], [("i", "a", "3"), ("j", "a", "1")])
    assert step((4, "i", "z", "4", 3), patience=1) == ([], [("i", "a", "3"), ("j", "a", "1")])
    expired = spark.read.parquet(str(tmp_path / "out-expired")).collect()
    assert [(r["instance_id"], r["scan_id"], r["arrived"], r["entries"]) for r in expired] == [("j", 2, 1, 2)]
    left = spark.read.parquet(max(str(f) for f in (tmp_path / "out-open").iterdir()))
    assert sorted((r["scan_id"], r["path"]) for r in left.collect()) == [(4, "p/b.md"), (4, "p/z.md")]


def test_rejected_pages_of_a_stream(spark, tmp_path):
    rows = [("https://a.example/", "<p>x</p>"), ("mailto:a@b", "y"), (None, "z")]
    schema = "url string, body string, status int, instance_id string"
    spark.createDataFrame([(*r, 200, "w") for r in rows], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="requires an http"):
        pipelines.stream_captures(stream, fx.RUN, str(tmp_path / "out"), str(tmp_path / "p1")).awaitTermination()
    pipelines.stream_captures(stream, fx.RUN, str(tmp_path / "out"), str(tmp_path / "p2"), str(tmp_path / "no")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    assert sorted((str(r["url"]), r["problem"]) for r in spark.read.parquet(str(tmp_path / "no")).collect()) == [
        ("None", "requires an http(s) config.url"), ("mailto:a@b", "requires an http(s) config.url"),
    ]


def test_checkpoints_write_changed_instances_only(spark, tmp_path):
    state = Checkpoints(spark, str(tmp_path / "s"))

    def replace(version, **trees):
        headers = [(i, "r", "main", "p", t and t[0], True, len(t[1]) if t else 0, 0, "now") for i, t in trees.items()]
        files = [(i, f"p/{name}", t[0]) for i, t in trees.items() if t for name in t[1]]
        state.replace(spark.createDataFrame(headers, CHECKPOINT_HEADER_SCHEMA), spark.createDataFrame(files, CHECKPOINT_FILES_SCHEMA), version)

    def held():
        return sorted((r["instance_id"], r["path"], r["sha"]) for r in state.files().collect())

    replace(0, a=("t1", "xy"), b=("u1", "z"))
    replace(1, a=("t1", "xy"), b=("u2", "zw"))
    assert spark.read.parquet(str(tmp_path / "s/files/batch=000000000001")).select("instance_id").distinct().collect()[0][0] == "b"
    assert held() == [("a", "p/x", "t1"), ("a", "p/y", "t1"), ("b", "p/w", "u2"), ("b", "p/z", "u2")]
    assert {r["instance_id"]: (r["version"], r["files_version"]) for r in state.headers().collect()} == {"a": (1, 0), "b": (1, 1)}
    replace(2, b=("", "q"))  # a is not part of this run; no tree hash is never the same
    replace(3, b=("", "q"))
    assert held() == [("a", "p/x", "t1"), ("a", "p/y", "t1"), ("b", "p/q", "")]
    assert "batch=000000000001" not in "".join(state.files().inputFiles())
    assert sorted(r["path"] for r in state.files(2).collect()) == ["p/w", "p/x", "p/y", "p/z"]
    assert state.forget(keep=1) == [1, 2]
    assert state.compact() == 4 and held() == [("a", "p/x", "t1"), ("a", "p/y", "t1"), ("b", "p/q", "")]
    assert state.forget(keep=1) == [0, 3] and len(held()) == 3 and state.next_version() == 5


def table_folder(spark, sf, name, rows):
    """A table as a folder of two files, as larger tables come."""
    rows.repartition(2).write.parquet(f"{sf}/{name}.parquet")


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    sf = str(tmp_path)
    pages = [(n, f"https://{n}.example/", "<title>t</title><p>" + "x" * n + "</p>") for n in range(1, 31)]
    table_folder(spark, sf, "pages", spark.createDataFrame(pages, "page_id long, url string, html string"))
    documents = [(n, f"text {n}", ("en", "fr", "de", "es")[n % 4], f"src{n % 3}", 500) for n in range(1, 31)]
    table_folder(spark, sf, "documents", spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long"))
    table_folder(spark, sf, "labels", spark.createDataFrame([(n, n % 2, 0) for n in range(1, 31, 3)], "doc_id long, quality long, toxic long"))
    everything = lambda df: sorted(map(str, df.collect()))
    captures = everything(q.stream_captures(spark, sf))
    assert captures == everything(q.web_captures_query(spark, sf)) and len(captures) == 30
    counts = {r["problem"]: r["n"] for r in q.stream_rejects(spark, sf).groupBy("problem").agg(F.sum("pages").alias("n")).collect()}
    assert len(counts) > 1 and sum(counts.values()) == 30
    assert everything(q.stream_changes(spark, sf)) == everything(q.stream_changes_split(spark, sf)) != []
    assert q.stream_enqueue(spark, sf).count() == q.stream_sync(spark, sf).count() == 30


def test_streams_read_tables_that_are_files(spark, tmp_path):
    for name, ids in (("pages", [1, 2]), ("pages2", [3])):
        rows = spark.createDataFrame([(n, f"https://{n}.example/", "<p>x</p>") for n in ids], "page_id long, url string, html string")
        rows.coalesce(1).write.parquet(str(tmp_path / "parts" / name))
        (file,) = (tmp_path / "parts" / name).glob("*.parquet")
        (tmp_path / f"{name}.parquet").write_bytes(file.read_bytes())
    assert sorted(r["url"] for r in q.stream_captures(spark, str(tmp_path)).collect()) == ["https://1.example/", "https://2.example/"]
