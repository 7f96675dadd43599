"""Mixing sources to target weights by Pfair scheduling.

A source's share f is its target weight over the sum of all, as an exact fraction. Its j-th block (from 1) is released
at slot floor((j - 1) / f) and due at slot ceil(j / f). Earliest deadline first over one slot at a time meets
all of these, so after any number t of slots a source has had less than one block more or fewer than t * f, however long
the mixture is. The driver runs through the slots once with one entry per source and hands the blocks on in bounded
chunks; rows find their slot in a join by source and block.

Defined cases: a null source is a source of its own; equal rows are separate rows; an empty table gives no rows;
other columns of the input are left alone. Sources that the target weights want more of than they have come round
again (``epoch`` counts from 0); no row is left out, so a weight that is not above 0 is an error, and a very small
one makes a long mixture.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from math import isfinite, lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanflow.llm.common import named, ranked_within, row_key, shuffle_partitions, staged, table, unused

SEED = 10
BLOCK_ROWS = 16
# Target weight of a source: its number of rows to this power.
FLATTEN = 0.7
# The weights of so many sources are held on the driver; more are an error, not a cut.
MAX_SOURCES = 100_000
# Blocks that the driver hands on at a time.
CHUNK = 1_000_000


def quantized(weights: dict[str, float]) -> tuple[dict[str, int], int]:
    """Whole units per source, at least one each, and their sum ``D``; largest remainders first."""
    if not weights:
        return {}, 0
    units = max(1000, 10 * len(weights))
    total = sum(weights.values())
    spare = units - len(weights)
    exact = {s: spare * w / total for s, w in weights.items()}
    q = {s: 1 + int(x) for s, x in exact.items()}
    rest = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))
    for s in rest[: units - sum(q.values())]:
        q[s] += 1
    return q, units


def pfair_slots(q: dict[str, int], units: int) -> dict[str, list[int]]:
    """The slots (0 to D - 1) of each source's blocks in one period."""
    slots: dict[str, list[int]] = {s: [] for s in q}
    waiting = [(0, s) for s in sorted(q)]  # release time, source
    ready: list[tuple[int, str]] = []  # deadline, source
    heapq.heapify(waiting)
    for now in range(units):
        while waiting and waiting[0][0] <= now:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * units // q[s]), s))
        s = heapq.heappop(ready)[1]
        slots[s].append(now)
        if len(slots[s]) < q[s]:
            heapq.heappush(waiting, (len(slots[s]) * units // q[s], s))
    return slots


def exact_units(weights: dict[str, float]) -> tuple[dict[str, int], int]:
    """The weights themselves as whole units, and their sum."""
    if bad := sorted(s for s, w in weights.items() if not (isfinite(w) and w > 0)):
        raise ValueError(f"target weights must be above 0: {[b[1:] or None for b in bad[:5]]}")
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = reduce(lcm, (w.denominator for w in exact.values()), 1)
    q = {s: int(w * scale) for s, w in exact.items()}
    return q, sum(q.values())


def schedule(weights: dict[str, float], least: dict[str, int]) -> Iterator[tuple[str, int]]:
    """``(source, block)`` slot by slot, until every source has had ``least`` blocks."""
    q, units = exact_units(weights)
    done = dict.fromkeys(q, 0)
    missing = sum(n > 0 for n in least.values())
    waiting = [(0, s) for s in sorted(q)]  # release time, source
    ready: list[tuple[int, str]] = []  # deadline, source
    now = 0
    while missing:
        while waiting and waiting[0][0] <= now:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[s] + 1) * units // q[s]), s))
        s = heapq.heappop(ready)[1]
        yield s, done[s]
        done[s] += 1
        missing -= done[s] == least[s]
        heapq.heappush(waiting, (done[s] * units // q[s], s))
        now += 1


def scheduled(spark, weights: dict[str, float], least: dict[str, int]) -> DataFrame:
    """``_source, block, slot`` of all blocks."""
    kinds = pa.schema([("_source", pa.string()), ("block", pa.int64()), ("slot", pa.int64())])
    parts: list[DataFrame] = []
    chunk: list[tuple[str, int]] = []
    start = 0

    def hand_on() -> None:
        nonlocal start
        columns = [[s for s, _ in chunk], [b for _, b in chunk], range(start, start + len(chunk))]
        parts.append(staged(spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], kinds))))
        start += len(chunk)
        chunk.clear()

    for block in schedule(weights, least):
        chunk.append(block)
        if len(chunk) == CHUNK:
            hand_on()
    if chunk or not parts:
        hand_on()
    return reduce(DataFrame.unionByName, parts)


def source_key(column: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(column).cast("string")), F.lit("n"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS,
        flatten: float = FLATTEN, seed: int = SEED, mark: list[str] | None = None) -> DataFrame:
    """Places of all rows in the mixture: ``doc_id, source, key, epoch, block, slot, position, units``.

    ``key`` is :func:`row_mark` of the columns ``mark``. ``position`` is gapless: slot * block_rows + place in the block.
    ``units`` is the target weight rounded to whole units (:func:`quantized`), for reading only; slots follow the weight itself.
    ``weights`` maps every source to its target weight; by default it is rows ** ``flatten``. The mixture ends
    with the slot that completes the first round of the source that needs longest.
    """
    narrow = docs.select("doc_id", "source", source_key().alias("_source"), row_mark(mark).alias("key"))
    spark = docs.sparkSession
    ranks = ranked_within(
        narrow.withColumn("_mix", F.xxhash64(F.lit(seed), "key")), "_source", F.col("_mix"), F.col("key"), F.col("doc_id")
    )
    sizes = narrow.groupBy("_source").count().limit(MAX_SOURCES + 1).collect()
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: give coarser ones")
    rows = {r["_source"]: r["count"] for r in sizes}
    if weights is None:
        target = {s: n**flatten for s, n in rows.items()}
    else:
        named = {"n" if s is None else f"s{s}": w for s, w in weights.items()}
        if missing := sorted(set(rows) - set(named)):
            raise ValueError(f"no target weight for {[m[1:] or None for m in missing[:5]]}")
        target = {s: named[s] for s in rows}
    q, units = quantized(target)
    plan = scheduled(spark, target, {s: -(-n // block_rows) for s, n in rows.items()})
    lengths = plan.groupBy("_source").agg((F.count("*") * block_rows).alias("_length"))
    shares = spark.createDataFrame([(s, q[s]) for s in q], "_source string, units int")
    # A row comes once per epoch, as often as its source's stream is longer than its place.
    again = F.expr("explode(sequence(0L, greatest(0L, (_length - 1 - _rank) div _total)))")
    placed = ranks.join(lengths.join(shares, "_source"), "_source").where("_rank < _length").withColumn("epoch", again)
    return (
        placed.withColumn("_place", F.expr("epoch * _total + _rank"))
        .withColumn("block", F.expr(f"_place div {block_rows}L"))
        .join(plan, ["_source", "block"])
        .select(
            "doc_id", "source", "key", "epoch", "block", "slot",
            (F.col("slot") * block_rows + F.col("_place") % block_rows).alias("position"), "units",
        )
    )


def row_mark(columns: list[str] | None = None) -> Column:
    """64 bits for the values of a row, so that equal rows share their mark."""
    return row_key(*(columns or ["doc_id", "source", "text"]))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves in the order of the mixture, with the columns of ``docs``.

    Texts move twice: to their places and into the order. Columns of map type can't be part of the mark.
    """
    columns = [f.name for f in docs.schema.fields if f.dataType.typeName() != "map"]
    key, position = unused(docs.columns, "_key"), unused(docs.columns, "_position")
    places = mix(docs, mark=columns, **options).select(F.col("key").alias(key), F.col("position").alias(position))
    texts = docs.withColumn(key, row_mark(columns)).dropDuplicates([key])
    placed = texts.join(places, key)
    n = shuffle_partitions(docs.sparkSession)
    return placed.repartitionByRange(n, position).sortWithinPartitions(position).select(*named(docs.columns))


def op10_pfair_mixture(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))
