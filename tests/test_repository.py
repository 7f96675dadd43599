"""Repository source: listing, change detection, captures and checkpoints."""

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gleanflow.contract import RunContext
from gleanflow.operators import changes
from gleanflow.operators.tables import Checkpoints, Outbox, shared_folder
from gleanflow.plans.run import check_config, collect_repository, run_source
from gleanflow.sources import repository as repo

RUN = RunContext("run_1", "schedule", "2024-01-01T00:00:00.000Z")
FRONT = "---\ntitle: First\ntags: [tech, memory]\n---\n\n# Hello\n"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


class Repo:
    """A tiny repository that tests can change between scans."""

    def __init__(self, spark):
        self.spark = spark
        self.files = {
            "posts/Hello World.md": FRONT,
            "posts/nested/Second.MDOC": "---\ntag: notes\n---\nBody",
            "posts/skip.txt": "text",
            "posts-old/Other.md": "no",
        }
        self.tree = "tree-1"
        self.branch = "main"
        self.truncated = False
        folder = shared_folder(spark)
        self.outbox, self.checkpoints = Outbox(spark, f"{folder}/outbox"), Checkpoints(spark, f"{folder}/state")
        self.step = 0

    def config(self):
        return self.spark.createDataFrame(
            [("i", "https://github.com/o/r", self.branch, "posts", "https://s.example/", self.tree, self.truncated)],
            "instance_id string, repository_url string, branch string, content_dir string, site_url string, "
            "tree_sha string, truncated boolean",
        )

    def collect(self, full=False, mode="fail", lost=()):
        listing = [("i", path, "blob", sha(text), None) for path, text in self.files.items()]
        blobs = {sha(t): base64.b64encode(t.encode()).decode() for p, t in self.files.items() if p not in lost}
        return collect_repository(
            self.config(),
            self.spark.createDataFrame(listing, "instance_id string, path string, type string, sha string, url string"),
            self.spark.createDataFrame([(k, "base64", v[:8] + "\n" + v[8:]) for k, v in blobs.items()], "sha string, encoding string, content string"),
            None if full else self.checkpoints.headers(),
            None if full else self.checkpoints.files(),
            RUN,
            mode,
        )

    def run(self, **options):
        self.step += 1
        return run_source(self.collect(**options), self.outbox, f"run-{self.step}", self.checkpoints)


@pytest.fixture
def tiny(spark):
    return Repo(spark)


def test_captures(tiny):
    rows = {json.loads(r["metadata"])["path"]: r for r in tiny.collect().captures.collect()}
    assert sorted(rows) == ["posts/Hello World.md", "posts/nested/Second.MDOC"]
    hello, second = rows["posts/Hello World.md"], rows["posts/nested/Second.MDOC"]
    assert hello["subject"]["title"] == "First"
    assert hello["subject"]["url"] == "https://s.example/posts/hello-world"
    assert hello["subject"]["uri"] == "github://o/r/posts/Hello World.md?ref=main"
    assert hello["payload"]["text"] == "# Hello"
    assert hello["payload"]["raw_ref"] == "https://github.com/o/r/blob/main/posts/Hello%20World.md"
    assert hello["payload"]["content_hash"] == "sha256:" + sha(FRONT)
    assert hello["tags"] == ["tech", "memory"]
    assert hello["provenance"]["cursor"] == sha(FRONT)
    assert hello["privacy"]["level"] == "private" and hello["privacy"]["allow_cloud_llm"] is False
    assert json.loads(hello["metadata"])["frontmatter"] == {"title": "First", "tags": ["tech", "memory"]}
    seed = json.dumps(
        {"connector": "repository-documents", "instance": "i", "uri": hello["subject"]["uri"], "contentHash": "sha256:" + sha(FRONT)},
        separators=(",", ":"),
    )
    assert hello["id"] == "cap_" + sha(seed)[:20]
    assert (second["subject"]["title"], second["subject"]["url"]) == ("nested/second", "https://s.example/posts/nested/second")
    assert second["tags"] == ["notes"]


def test_incremental_runs(tiny):
    assert tiny.run() == {"collected": 2, "enqueued": 2}
    assert tiny.run() == {"collected": 0, "enqueued": 0}  # same tree
    tiny.tree = "tree-2"
    assert tiny.run() == {"collected": 0, "enqueued": 0}  # other tree, same files
    tiny.tree, tiny.files["posts/Hello World.md"] = "tree-3", FRONT + "more"
    assert tiny.run() == {"collected": 1, "enqueued": 1}
    header = tiny.checkpoints.headers().first()
    assert (header["file_count"], header["changed"], header["tree_sha"]) == (2, 1, "tree-3")
    assert tiny.checkpoints.files().count() == 2  # every file, not only the changed one
    del tiny.files["posts/nested/Second.MDOC"]
    tiny.files["posts/Renamed.md"], tiny.tree = FRONT + "more", "tree-4"
    assert tiny.run() == {"collected": 1, "enqueued": 1}
    assert tiny.run(full=True) == {"collected": 2, "enqueued": 0}


def test_other_branch_is_a_full_scan(tiny):
    tiny.run()
    tiny.branch = "next"
    assert tiny.run() == {"collected": 2, "enqueued": 2}


def test_untracked_header_enables_nothing(spark):
    sources = spark.createDataFrame([("i", "main", "posts", "t")], "instance_id string, ref string, content_dir string, tree_sha string")
    old = sources.withColumn("files_tracked", F.lit(False))
    assert changes.unchanged_sources(sources, old).count() == 0
    assert changes.unchanged_sources(sources, old.withColumn("files_tracked", F.lit(True))).count() == 1
    nothing = sources.withColumn("tree_sha", F.lit(None).cast("string"))
    assert changes.unchanged_sources(nothing, nothing.withColumn("files_tracked", F.lit(True))).count() == 0


def test_failures_stop_the_run(tiny):
    tiny.files["posts/bad.md"] = "---\n- a\n---\n"
    with pytest.raises(Exception, match="must be a mapping"):
        tiny.run()
    assert tiny.outbox.entries().count() == 0 and tiny.checkpoints.headers().count() == 0
    del tiny.files["posts/bad.md"]
    with pytest.raises(ValueError, match="missing or unreadable"):
        tiny.run(lost=("posts/Hello World.md",))
    tiny.truncated = True
    with pytest.raises(Exception, match="truncated"):
        tiny.run()
    assert tiny.outbox.entries().count() == 0


def test_quarantine_is_retried(tiny):
    tiny.files["posts/bad.md"] = "---\n- a\n---\n"
    rejects = tiny.collect(mode="quarantine").rejects.collect()
    assert [(r["path"], r["problem"]) for r in rejects] == [
        ("posts/bad.md", "frontmatter line 1: the document must be a mapping, not a sequence")
    ]
    assert tiny.run(mode="quarantine") == {"collected": 2, "enqueued": 2}
    assert tiny.checkpoints.headers().first()["tree_sha"] is None
    tiny.files["posts/bad.md"] = "fixed"
    assert tiny.run() == {"collected": 1, "enqueued": 1}


def test_path_order(spark):
    paths = [(p,) for p in ("b", "A", "B", "a", "_x")]
    ordered = changes.in_path_order(spark.createDataFrame(paths, "path string")).collect()
    assert [r["path"] for r in ordered] == ["_x", "a", "A", "b", "B"]


def test_resolve(spark):
    rows = [
        ("a", "https://github.com/o/r", None, None, "trunk"),
        ("b", "https://github.com/o/r/tree/dev/docs", None, None, None),
        ("c", "https://github.com/o/r/tree/dev/docs", " main ", "/x/", None),
        ("d", "https://github.com/o/r", None, None, None),
        ("e", "https://github.com/o/r", "m", "a/../b", None),
    ]
    df = spark.createDataFrame(rows, "instance_id string, repository_url string, branch string, content_dir string, default_branch string")
    got = {r["instance_id"]: (r["ref"], r["content_dir"], r["error"]) for r in repo.resolve_sources(df).collect()}
    assert got["a"] == ("trunk", "src/content/blogs", None)
    assert got["b"] == ("dev", "docs", None)
    assert got["c"] == ("main", "x", None)
    assert got["d"][2] == repo.NO_BRANCH
    assert "repository-relative" in got["e"][2]


def test_check_config(spark):
    df = spark.createDataFrame([("i", '{"repository_url":"https://x.example"}'), ("j", "{}")], "instance_id string, config string")
    assert [tuple(r) for r in check_config(df, repo.REPOSITORY_MANIFEST).collect()] == [("j", "config.repository_url is required")]
