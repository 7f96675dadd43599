"""Outbox fold, enqueue and skew handling against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from gleanflow.operators import outbox as ob
from gleanflow.operators.layout import hot_key_join, salted_join
from gleanflow.contract import OUTBOX_EVENT_SCHEMA

MARKS = ("pending", "sent", "failed")


def replay(events):
    """One event after the other: the meaning the fold has to reproduce."""
    entries, rejects = {}, []
    for seq, identifier, event, error, at in sorted(events):
        if event == "enqueue":
            entries.setdefault(identifier, ["pending", 0, None, at])
        elif event == "remove":
            entries.pop(identifier, None)
        elif identifier not in entries:
            rejects.append((seq, identifier, event))
        else:
            entry = entries[identifier]
            entries[identifier] = [event, entry[1] + (event == "failed"), error, at]
    return {k: tuple(v) for k, v in entries.items()}, sorted(rejects)


def log_of(spark, events):
    return spark.createDataFrame([(*event, None) for event in events], OUTBOX_EVENT_SCHEMA)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("block", [7, 1_000_000])
def test_fold_equals_replay(spark, seed, block, monkeypatch):
    monkeypatch.setattr(ob._with_epoch, "__defaults__", (block,))
    rng = random.Random(seed)
    ids = ["hot"] * 8 + [f"c{i}" for i in range(12)]
    kinds = ["enqueue", "remove", *MARKS, "failed"] if seed < 3 else ["enqueue", *MARKS]
    events = []
    for seq in range(300):
        kind = rng.choice(kinds)
        error = f"e{seq}" if kind == "failed" else None
        events.append((seq, rng.choice(ids), kind, error, f"t{seq:03d}"))
    log = log_of(spark, events)
    entries, rejects = replay(events)
    got = {r["id"]: (r["status"], r["attempts"], r["last_error"], r["updated_at"]) for r in ob.outbox_state(log).collect()}
    assert got == entries
    assert sorted((r["seq"], r["id"], r["event"]) for r in ob.rejected_marks(log).collect()) == rejects
    assert sorted(r["id"] for r in ob.stored_ids(log).collect()) == sorted(entries)
    summary = ob.outbox_summary(ob.outbox_state(log)).first().asDict()
    states = [e[0] for e in entries.values()]
    assert summary == {"total": len(states), **{m: states.count(m) for m in MARKS}}


def test_attempts_survive_retry(spark):
    events = [
        (1, "a", "enqueue", None, "1"), (2, "a", "failed", "x", "2"), (3, "a", "pending", None, "3"),
        (4, "a", "failed", "y", "4"), (5, "b", "enqueue", None, "5"), (6, "b", "sent", None, "6"),
    ]
    state = ob.outbox_state(log_of(spark, events))
    assert {r["id"]: (r["status"], r["attempts"], r["last_error"]) for r in state.collect()} == {
        "a": ("failed", 2, "y"), "b": ("sent", 0, None),
    }
    retried = ob.retry_events(state, F.lit(9), F.lit("now")).collect()
    assert [(r["id"], r["event"], r["error"]) for r in retried] == [("a", "pending", None)]
    none = spark.createDataFrame([("b",), ("zz",)], "id string")
    assert ob.retry_events(state, F.lit(9), F.lit("now"), none).count() == 0


def test_enqueue_keeps_first_and_skips_stored(spark):
    rows = [("a", 3, "late"), ("a", 1, "first"), ("b", 2, "only"), ("c", 4, "stored")] + [("hot", i, f"v{i}") for i in range(5, 500)]
    captures = spark.createDataFrame(rows, "id string, n int, v string")
    stored = spark.createDataFrame([("c",), ("c",)], "id string")
    new = ob.new_entries(captures, stored, F.col("n"))
    assert sorted(tuple(r) for r in new.collect()) == [("a", 1, "first"), ("b", 2, "only"), ("hot", 5, "v5")]
    report = ob.run_report(captures, new).first()
    assert (report["collected"], report["enqueued"]) == (len(rows), 3)


def test_list_and_order(spark):
    rows = spark.createDataFrame([("b", "sent"), ("a-", "pending"), ("a", "pending")], "id string, status string")
    listed = ob.outbox_list(rows, "pending").orderBy(ob.file_order(F.col("id"))).collect()
    assert [r["id"] for r in listed] == ["a-", "a"]  # "a-.json" sorts before "a.json"
    assert ob.outbox_list(rows).count() == 3
    with pytest.raises(ValueError):
        ob.outbox_list(rows, "lost")


def test_privacy_conflict(spark):
    schema = "id string, privacy struct<level string>"
    stored = spark.createDataFrame([("a", ("public",)), ("b", ("sensitive",))], schema)
    asked = spark.createDataFrame([("a", ("sensitive",)), ("a", ("public",)), ("b", ("public",))], schema)
    assert [tuple(r) for r in ob.privacy_conflicts(asked, stored).collect()] == [("a", "public", "sensitive")]


def test_hot_key_joins_are_exact(spark):
    many = spark.createDataFrame([("hot" if i % 3 else f"k{i % 7}", i) for i in range(600)], "k string, n int")
    one = spark.createDataFrame([("hot", "H")] + [(f"k{i}", f"v{i}") for i in range(5)], "k string, v string")
    want = sorted(tuple(r) for r in many.join(one, "k").collect())
    assert sorted(tuple(r) for r in hot_key_join(many, one, "k", ["n"], rows_per_task=50).collect()) == want
    assert sorted(tuple(r) for r in salted_join(many, one, ["k"], ["n"]).collect()) == want
