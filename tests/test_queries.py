"""Registered queries against their SQL at the smallest scale, and properties of their plans."""

import pytest
from check import compare
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gleanflow.operators.layout import spread
from gleanflow.operators.tables import Checkpoints, shared_folder
from gleanflow.plans import fixtures as fx
from gleanflow.plans import queries as q
from gleanflow.plans.oracles import ORACLES
from gleanflow.streaming import pipelines

SF = "/root/testdata/sf0.001"
SLOW = {"repo_captures", "incremental_runs", "sync_loop", "frontmatter_rejects", "frontmatter_nested", "frontmatter_tags"}


def test_every_query_has_sql():
    assert set(q.QUERIES) == set(ORACLES)
    assert set(q.QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - SLOW))
def test_query_equals_sql(spark, name):
    verdict = compare(spark, SF, name)
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    assert entry.entry(spark).first()["total"] > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_needed_columns(spark):
    plan = plan_of(q.outbox_summary(spark, SF))
    assert "props:string" not in plan  # texts of marks are pruned when only counts are asked
    assert "page_id" in plan_of(q.page_lengths(spark, SF)) and "ReadSchema: struct<page_id:bigint,html:string>" in plan_of(
        q.page_lengths(spark, SF)
    )


def test_no_cross_joins_and_no_single_partition_windows(spark):
    for name in ("enqueue", "outbox_state", "changed_files", "checkpoint_next", "privacy_gate", "sync_limit", "config_carry"):
        plan = plan_of(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert "row_number" not in plan, name


def test_large_scans_are_not_shuffled(spark):
    many = spark.range(0, 1000, 1, 64)
    assert spread(many, "id") is many


def test_listing_snapshots_replace_state(spark):
    """A later scan in the stream sees the state of the earlier one; replays give the same files."""
    folder = shared_folder(spark)
    checkpoints = Checkpoints(spark, f"{folder}/state")
    schema = "scan_id long, instance_id string, path string, type string, sha string"
    sources = spark.createDataFrame(
        [("i", "o", "r", "main", "p", None, False)],
        "instance_id string, owner string, repo string, ref string, content_dir string, tree_sha string, truncated boolean",
    )

    def scan(scan_id, files):
        rows = [(scan_id, "i", f"p/{name}.md", "blob", sha) for name, sha in files.items()]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        pipelines.stream_changes(stream, sources, checkpoints, fx.RUN, f"{folder}/out", f"{folder}/progress").awaitTermination()
        out = spark.read.parquet(f"{folder}/out")
        last = out.agg(F.max("batch")).first()[0]
        return sorted(r["path"] for r in out.where(F.col("batch") == last).collect())

    with pytest.raises(Exception, match="truncated"):
        cut = spark.createDataFrame([(1, "i", "p/a.md", "blob", "1")], schema).coalesce(1)
        cut.write.parquet(f"{folder}/cut")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/cut")
        pipelines.stream_changes(
            stream, sources.withColumn("truncated", F.lit(True)), checkpoints, fx.RUN, f"{folder}/cut-out", f"{folder}/cut-progress"
        ).awaitTermination()
    assert checkpoints.headers().count() == 0
    assert scan(1, {"a": "1", "b": "1"}) == ["p/a.md", "p/b.md"]
    assert scan(2, {"a": "1", "b": "2", "c": "1"}) == ["p/b.md", "p/c.md"]
    assert checkpoints.files().count() == 3
    # A stream that starts anew continues the versions of the table.
    rows = [(9, "i", "p/a.md", "blob", "9")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/again")
    stream = spark.readStream.schema(schema).parquet(f"{folder}/again")
    pipelines.stream_changes(stream, sources, checkpoints, fx.RUN, f"{folder}/out2", f"{folder}/progress2").awaitTermination()
    assert [r["sha"] for r in checkpoints.files().collect()] == ["9"]
