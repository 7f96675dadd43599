"""Checkouts: object hashes against a plain reading of the format, and equal captures as from a listing."""

import base64
import hashlib

from pyspark.sql import functions as F

from gleanflow.operators.tables import Checkpoints, Outbox
from gleanflow.plans import fixtures as fx
from gleanflow.plans.run import collect_repository, run_source
from gleanflow.sources import checkout

FILES = {
    "one": {"README.md": b"# One\n", "posts/a.md": b"---\ntitle: A\n---\nText", "posts/b c.md": "é\n".encode(), "posts/deep/er/x.mdoc": b"x", "posts.txt": b"\x00\xff", "posts-x/y.md": b"y"},
    "two": {"posts/a.md": b"---\ntitle: A\n---\nText"},
}


def plain_blob(body):
    return hashlib.sha1(b"blob %d\0" % len(body) + body).digest()


def plain_tree(files):
    entries = {}
    for path, body in files.items():
        head, _, rest = path.partition("/")
        entries.setdefault(head, {})[rest] = body
    rows = []
    for name, inside in entries.items():
        if "" in inside:
            rows.append((name.encode(), b"100644 " + name.encode() + b"\0" + plain_blob(inside[""])))
        else:
            rows.append((name.encode() + b"/", b"40000 " + name.encode() + b"\0" + plain_tree(inside)))
    body = b"".join(entry for _, entry in sorted(rows))
    return hashlib.sha1(b"tree %d\0" % len(body) + body).digest()


def write(base, files):
    for instance, tree in files.items():
        for path, body in tree.items():
            place = base / instance / path
            place.parent.mkdir(parents=True, exist_ok=True)
            place.write_bytes(body)


def config(spark):
    rows = [(i, f"https://github.com/o/{i}", "main", "posts", None) for i in FILES]
    return spark.createDataFrame(rows, "instance_id string, repository_url string, branch string, content_dir string, site_url string")


def test_object_hashes(spark, tmp_path):
    write(tmp_path, FILES)
    files = checkout.checkout_files(spark, str(tmp_path))
    assert {(r["instance_id"], r["path"]): r["sha"] for r in files.collect()} == {
        (i, p): plain_blob(b).hex() for i, tree in FILES.items() for p, b in tree.items()
    }
    found = {(r["instance_id"], r["path"]): r["sha"] for r in checkout.folder_hashes(files.drop("content")).collect()}
    assert found["one", ""] == plain_tree(FILES["one"]).hex() and found["two", ""] == plain_tree(FILES["two"]).hex()
    assert found["one", "posts/deep"] == plain_tree({"er/x.mdoc": b"x"}).hex()
    assert checkout.folder_hashes(files.drop("content").limit(0)).count() == 0


def test_a_checkout_equals_its_listing_and_a_second_scan_finds_changes_only(spark, tmp_path):
    write(tmp_path / "in", FILES)
    outbox, state = Outbox(spark, str(tmp_path / "o"), 4), Checkpoints(spark, str(tmp_path / "s"))

    def scan(name):
        tables = checkout.checkout_tables(spark, str(tmp_path / "in"), config(spark))
        return tables, run_source(collect_repository(*tables, state.headers(), state.files(), fx.RUN), outbox, name, state)

    (settings, _, _), report = scan("first")
    assert report == {"collected": 4, "enqueued": 4}
    listing = [(i, p, "blob", plain_blob(b).hex(), None) for i, tree in FILES.items() for p, b in tree.items()]
    blobs = {plain_blob(b).hex(): base64.b64encode(b).decode() for tree in FILES.values() for b in tree.values()}
    plain = collect_repository(
        settings, spark.createDataFrame(listing, "instance_id string, path string, type string, sha string, url string"),
        spark.createDataFrame([(k, "base64", v) for k, v in blobs.items()], "sha string, encoding string, content string"), None, None, fx.RUN,
    ).captures
    narrow = lambda df: sorted(tuple(r) for r in df.select("id", "subject.uri", "payload.content_hash", "metadata").collect())
    assert narrow(outbox.captures()) == narrow(plain)
    assert {r["instance_id"]: r["tree_sha"] for r in state.headers().collect()} == {i: plain_tree(t).hex() for i, t in FILES.items()}
    assert scan("second")[1] == {"collected": 0, "enqueued": 0}
    (tmp_path / "in/two/posts/a.md").write_bytes(b"changed")
    assert scan("third")[1] == {"collected": 1, "enqueued": 1}
    assert state.headers().where(F.col("files_version") == 2).count() == 1
