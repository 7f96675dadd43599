"""SimHash near-duplicates: vantage-point trees over fingerprints.

A text's fingerprint has a bit for each bit position that is 1 in over half of its shingles' hashes. Texts
link when their fingerprints differ in at most ``RADIUS`` bits, and links make components.

Distinct fingerprints are dealt to shards by a vantage-point tree. A node holds a fingerprint v and a distance m.
Its inner side takes what lies within m + RADIUS of v, its outer side what lies beyond m. If x is inside and y is
outside and they are within RADIUS of each other, the triangle inequality puts y within m + RADIUS, so both
are on the inner side: every pair that links meets in at least one shard. The tree is fitted on a bounded sample,
which only decides how even the shards are, and all fingerprints go through it. Each shard is searched with a tree
of its own and gives one link per fingerprint to its local component, never all pairs. The components of
these links are then joined across shards.

Defined cases: a null text is empty; texts without words have fingerprint 0 and link like others; equal
rows share fingerprint and component; a null id takes part in links but is never the smallest id, so
``component_id`` is null only if all ids of the component are; an empty table gives no rows; other columns
of the input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanflow.llm.common import components, named, row_key, staged, table, unused

WORDS = 3
RADIUS = 3
HASH_SEED = 42
# Fingerprints that the tree over shards is fitted on, at most.
TREE_SAMPLE = 65_536
# A shard's own tree stops at so many fingerprints, which are then compared with each other.
LEAF = 1024


# --- fingerprints ---------------------------------------------------------------------


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII only, for both
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    ends = list(accumulate(map(len, tokens), lambda end, size: end + 1 + size))
    if len(tokens) <= words:
        spans = [(0, len(joined))]
    else:
        spans = zip([0, *(end + 1 for end in ends[:-words])], ends[words - 1 :], strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[start:end], HASH_SEED) for start, end in spans], np.uint64)


BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """Majority bits as a signed 64-bit number."""
    if not len(hashes):
        return 0
    lanes = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    if len(lanes) < 4096:
        ones = np.unpackbits(lanes, axis=1).sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(lanes[:, i], minlength=256) @ BYTE_BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` with the column ``_fp``."""

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(shingle_hashes(t or "", words)) for t in texts], dtype="int64")

    return docs.withColumn("_fp", simhash(F.col(text)))


# --- trees ------------------------------------------------------------------------------


def split(points: np.ndarray, radius: int, tries: int, seed: int):
    """A vantage point and distance for the most even overlapping halves: ``(size of larger half, v, m)``."""
    rng = np.random.default_rng(seed)
    best = None
    for v in points[rng.integers(0, len(points), tries)]:
        upto = np.cumsum(np.bincount(np.bitwise_count(points ^ v), minlength=65))
        inner = upto[np.minimum(np.arange(65) + radius, 64)]
        larger = np.maximum(inner, upto[-1] - upto)
        m = int(np.argmin(larger))
        if best is None or larger[m] < best[0]:
            best = (int(larger[m]), int(v), m)
    return best


def shard_tree(sample: np.ndarray, leaf: int, radius: int = RADIUS) -> list[tuple[int, int, int, int]]:
    """Nodes ``(v, m, inner, outer)``; a negative child ``-1 - s`` is shard s."""
    nodes: list[tuple[int, int, int, int]] = []
    shards = 0

    def grow(points: np.ndarray, depth: int) -> int:
        nonlocal shards
        best = split(points, radius, 8, depth) if len(points) > leaf else None
        if best is None or best[0] > 0.95 * len(points):
            shards += 1
            return -shards
        at = len(nodes)
        nodes.append((0, 0, 0, 0))
        distance = np.bitwise_count(points ^ np.uint64(best[1]))
        inner = grow(points[distance <= best[2] + radius], depth + 1)
        outer = grow(points[distance > best[2]], depth + 1)
        nodes[at] = (best[1], best[2], inner, outer)
        return at

    if len(sample):
        grow(sample, 0)
    return nodes


def deal(points: np.ndarray, nodes: list[tuple[int, int, int, int]], radius: int = RADIUS):
    """Yields ``(shard, points)``: every shard that a point belongs to."""
    waiting = [(0 if nodes else -1, points)]
    while waiting:
        at, some = waiting.pop()
        if not len(some):
            continue
        if at < 0:
            yield -1 - at, some
            continue
        v, m, inner, outer = nodes[at]
        distance = np.bitwise_count(some ^ np.uint64(v))
        waiting.append((inner, some[distance <= m + radius]))
        waiting.append((outer, some[distance > m]))


def local_roots(points: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of the distinct points the smallest position in its component within the shard."""
    root = np.arange(len(points))

    def unite(a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            low = np.minimum(ra[apart], rb[apart])
            np.minimum.at(root, ra[apart], low)
            np.minimum.at(root, rb[apart], low)
            while (root[root] != root).any():
                np.copyto(root, root[root])

    def sweep(some: np.ndarray) -> None:
        """A search from point to point: each step meets only what no step has reached."""
        rest, todo = some, []
        while len(rest) or todo:
            if not todo:
                todo, rest = [rest[0]], rest[1:]
            at = todo.pop()
            near = np.bitwise_count(points[rest] ^ points[at]) <= radius
            if near.any():
                found = rest[near]
                unite(np.full(len(found), at), found)
                todo.extend(found)
                rest = rest[~near]

    def search(some: np.ndarray, depth: int) -> None:
        if len(some) <= LEAF:
            values = points[some]
            a, b = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= radius)
            if len(a) > len(some):
                keep = a < b
                unite(some[a[keep]], some[b[keep]])
            return
        best = split(points[some], radius, 4, depth)
        if best[0] > 0.95 * len(some):
            sweep(some)
            return
        distance = np.bitwise_count(points[some] ^ np.uint64(best[1]))
        search(some[distance <= best[2] + radius], depth + 1)
        search(some[distance > best[2]], depth + 1)

    search(root.copy(), 0)
    return root


# --- jobs --------------------------------------------------------------------------------


def close_pairs(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a``, ``b`` that connect all distinct ``_fp`` within ``radius`` of each other."""
    spark = prints.sparkSession
    total = prints.count()
    # Shards about as many as points in a shard, so both grow with the root of the input.
    depth = 0.5 * math.log2(max(total, 2))
    share = min(1.0, TREE_SAMPLE / max(total, 1))
    # Which ones are taken is decided by their own bits.
    sample = prints.where(F.pmod(F.xxhash64("_fp"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(2 * TREE_SAMPLE)
    sample = np.sort(np.array([r[0] for r in sample.collect()], np.int64)).view(np.uint64)
    leaf = max(64, int(len(sample) * 0.66**depth))
    nodes = shard_tree(sample, leaf, radius)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, some in deal(points, nodes, radius):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), shard, np.int32)), pa.array(some.view(np.int64))], ["shard", "_fp"]
                )

    def links(part: pa.Table) -> pa.Table:
        points = np.unique(part.column("_fp").to_numpy()).view(np.uint64)
        root = local_roots(points, radius)
        moved = np.flatnonzero(root != np.arange(len(points)))
        values = points.view(np.int64)
        return pa.table({"a": values[moved], "b": values[root[moved]]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    dealt = prints.select("_fp").mapInArrow(shards, "shard int, _fp long")
    return staged(dealt.groupBy("shard").applyInArrow(links, "a long, b long"))


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``_fp``, ``component_id`` and the columns ``keep`` for every row of ``docs``."""
    rows = staged(fingerprints(docs, words=words).select("doc_id", "_fp", *keep))
    prints = staged(rows.groupBy("_fp").agg(F.min("doc_id").alias("_first")))
    roots = components(close_pairs(prints, radius))
    linked = prints.join(roots, prints["_fp"] == roots["node"], "left").select(
        "_fp", "_first", F.coalesce("root", "_fp").alias("_root")
    )
    smallest = linked.groupBy("_root").agg(F.min("_first").alias("component_id"))
    labels = linked.join(smallest, "_root").select("_fp", "component_id")
    return rows.join(labels, "_fp").select("doc_id", "_fp", "component_id", *keep)


def hex_digits(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op1_simhash_vptree(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits("_fp").alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (null ids last)."""
    # 128 bits for id and text, so that rows of a very large table stay apart.
    marks = {unused(docs.columns, "_key"): row_key("doc_id", "text"), unused(docs.columns, "_mark"): row_key("text", "doc_id")}
    found = near_duplicates(docs.select("doc_id", "text", row_key("doc_id", "text").alias("_key"), row_key("text", "doc_id").alias("_mark")),
                            words, radius, ("_key", "_mark"))
    # A component without ids is told apart by one of its fingerprints.
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_key", "_mark")
    group = F.when(F.col("component_id").isNull(), F.col("_fp"))
    first = found.groupBy("component_id", group.alias("_g")).agg(F.min(order).alias("_o"))
    key, mark = marks
    first = first.select(F.col("_o._key").alias(key), F.col("_o._mark").alias(mark)).distinct()
    kept = docs.withColumns(marks).join(first, [key, mark], "left_semi").dropDuplicates([key, mark])
    return kept.select(*named(docs.columns))


