"""Snapshot levels of the outbox: equal entries after any mix of events and folds, and what a batch reads."""

import random

import pytest
from pyspark.sql import functions as F

from gleanflow.contract import CAPTURE_SCHEMA
from gleanflow.operators.snapshots import Snapshots
from gleanflow.operators.tables import Outbox
from test_outbox import MARKS, log_of, replay


def entries_of(df):
    return {r["id"]: (r["status"], r["attempts"], r["last_error"], r["updated_at"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_levels_equal_a_replay(spark, tmp_path, seed):
    rng = random.Random(seed)
    ids = ["hot"] * 6 + [f"c{i}" for i in range(40)]
    kinds = ["enqueue", "enqueue", "remove", *MARKS, "failed"]
    events = [(seq, rng.choice(ids), rng.choice(kinds), f"e{seq}" if seq % 3 else None, f"t{seq:03d}") for seq in range(240)]
    snapshots, folded, levels = Snapshots(spark, str(tmp_path / "s"), 4), -1, set()
    for upto in (119, 123, 125, 190, 192, 230):
        some = [e for e in events if folded < e[0] <= upto]
        manifest, folded = snapshots.advance(log_of(spark, some), upto), upto
        levels.add(len(manifest.levels))
        want, _ = replay([e for e in events if e[0] <= upto])
        states = [e[0] for e in want.values()]
        assert entries_of(snapshots.stored()) == want
        assert manifest.counts == {m: states.count(m) for m in MARKS} and manifest.high == upto
    assert max(levels) > 1 and min(levels) == 1
    later = log_of(spark, [e for e in events if e[0] > folded])
    want, _ = replay(events)
    states = [e[0] for e in want.values()]
    assert entries_of(snapshots.state(later)) == want
    assert entries_of(snapshots.state(later, "failed")) == {k: v for k, v in want.items() if v[0] == "failed"}
    assert snapshots.counts(later) == {m: states.count(m) for m in MARKS}
    asked = spark.createDataFrame([("c1",), ("hot",), ("nobody",)], "id string")
    before, _ = replay([e for e in events if e[0] <= folded])
    assert entries_of(snapshots.lookup(asked)) == {k: before[k] for k in ("c1", "hot") if k in before}
    assert snapshots.advance(log_of(spark, events[:5]), 3) == snapshots.manifest()  # already folded


def test_old_levels_go_and_other_sessions_read(spark, tmp_path):
    snapshots = Snapshots(spark, str(tmp_path / "s"), 4)
    for step in range(4):
        snapshots.advance(log_of(spark, [(step, f"c{step}", "enqueue", None, "t")]), step)
    want = entries_of(snapshots.stored())
    assert snapshots.forget(keep=1) and snapshots.forget(keep=1) == []
    for row in spark.catalog.listTables():
        if row.name.startswith("gleanflow_level"):
            spark.sql(f"DROP TABLE {row.name}")  # as a session that never wrote them
    again = Snapshots(spark, str(tmp_path / "s"))
    assert entries_of(again.stored()) == want and len(want) == 4 and again.manifest().buckets == 4


def test_lookup_moves_the_batch_only(spark, tmp_path):
    snapshots = Snapshots(spark, str(tmp_path / "s"), 8)
    snapshots.advance(log_of(spark, [(i, f"c{i}", "enqueue", None, "t") for i in range(50)]), 49)
    ids = spark.createDataFrame([(f"c{i}",) for i in range(9)], "id string")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = snapshots.lookup(ids)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    scan = plan.index("FileScan parquet spark_catalog.default.gleanflow_level")
    # The only exchange belongs to the other side of the join.
    assert "Exchange" not in plan[plan.rindex("+- ", 0, scan) - 200 : scan].split("Scan ExistingRDD")[-1] or plan.index("Exchange") > scan


def capture_rows(spark, ids, level="public"):
    row = lambda i: ("v1", i, "web", None, "r", "t", "t", ("url", i, None, None), ("text", i, None, None, None), None, [], "{}", (level, False), ("manual", "w@1", None))
    return spark.createDataFrame([row(i) for i in ids], CAPTURE_SCHEMA)


def id_rows(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_outbox_with_and_without_compaction(spark, tmp_path):
    plain, compacted = Outbox(spark, str(tmp_path / "plain"), 4), Outbox(spark, str(tmp_path / "compacted"), 4)
    steps = [
        lambda o: o.enqueue(capture_rows(spark, "abcdef"), "one"),
        lambda o: o.mark(id_rows(spark, "a", "b", "x"), "failed", "m1", "down").count(),
        lambda o: o.mark(id_rows(spark, "c"), "sent", "m2").count(),
        lambda o: o.enqueue(capture_rows(spark, "abgh"), "two"),
        lambda o: o.mark(id_rows(spark, "d", "a"), "remove", "m3").count(),
        lambda o: o.retry("r1"),
        lambda o: o.enqueue(capture_rows(spark, "adz"), "three"),
        lambda o: o.enqueue(capture_rows(spark, "abcdef"), "one"),  # replays from here on
        lambda o: o.retry("r1"),
        lambda o: o.mark(id_rows(spark, "b"), "failed", "m4", "again").count(),
        lambda o: o.enqueue(capture_rows(spark, "adz"), "three"),
    ]
    for number, step in enumerate(steps):
        results = [step(o) for o in (plain, compacted)]
        assert results[0] == results[1], number
        if number % 2:
            compacted.compact()
        states = [sorted((r["id"], r["status"], r["attempts"], r["last_error"], r["born"]) for r in o.entries().collect()) for o in (plain, compacted)]
        assert states[0] == states[1], number
        assert plain.summary() == compacted.summary()
        kept = [sorted(r["id"] for r in o.pending().collect()) for o in (plain, compacted)]
        assert kept[0] == kept[1] == sorted(s[0] for s in states[0] if s[1] == "pending")


def test_reads_skip_what_is_folded(spark, tmp_path):
    outbox = Outbox(spark, str(tmp_path / "o"), 4)
    outbox.enqueue(capture_rows(spark, "ab"), "one")
    outbox.mark(id_rows(spark, "a"), "sent", "m1")
    outbox.compact()
    outbox.enqueue(capture_rows(spark, "bc"), "two")
    assert outbox.enqueue(capture_rows(spark, "xyz"), "one") == 0  # folded: final
    for df in (outbox.stored(id_rows(spark, "a", "c")), outbox.entries()):
        read = "\n".join(df.inputFiles())
        assert "-two/" in read and "/levels/" in read and "-one/" not in read and "-m1/" not in read
    assert sorted(r["id"] for r in outbox.stored(id_rows(spark, "a", "c", "d")).collect()) == ["a", "c"]
    assert outbox.summary() == {"total": 3, "pending": 2, "sent": 1, "failed": 0}
    bodies = "\n".join(outbox.bodies(outbox.entries().where("id = 'c'").select("id", F.col("born").alias("seq"))).inputFiles())
    assert "-two/" in bodies and "-one/" not in bodies
