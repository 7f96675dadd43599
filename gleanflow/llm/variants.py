"""Spelling variants: words that differ by one code point, found through a dictionary of trie-node pairs.

A word is a path in the trie of all words and, read backwards, a path in the trie of all reversed words. Nodes of both
tries are numbered, so ``(prefix node, suffix node)`` stands for a word cut in two. With the code point at place i skipped,
a word has the pair ``(node of w[:i], node of w[i+1:])``. Two words of a length share such a pair if and only if they differ at
that place alone; a word's cut ``(node of w[:i], node of w[i:])`` equals a skipped pair of another if and only if that one
has one code point more there. So a join on two integers finds all neighbours and nothing else.

Nodes are numbered in a pass over the sorted words: a word brings a new node for each prefix that it does not share with the
word before. Each range partition numbers its own; of each partition one word reaches the driver, which puts the numbers
together, as prefixes may go on across a border.

A pair of nodes is shared by at most one word per letter of the alphabet and is summed up before the join, so pairs of words are never
listed: a neighbour counts as one of its pair's words, and the best neighbour is the pair's most frequent word.

Defined cases: a null text has no words; a null id counts as an empty one in the noise hash; equal rows count as often
as they come; an empty table gives no rows; other columns are not looked at; words may be of any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanflow.llm.common import positions, shuffle_partitions, staged, table

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
NOISE = 199
RUN = "[A-Za-zÀ-ÿ]+"
LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}
# Different words that a task counts before it hands them on.
COUNTED_AT_ONCE = 400_000


# --- words --------------------------------------------------------------------------------


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: lower-cased runs of letters of the whole texts, some with a code point taken out by the noise hash."""
    find, noise, lower = re.compile(RUN).findall, NOISE, LOWER

    def pairs(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())}
        )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                runs: Counter = Counter()
                for run, n in Counter(find(text or "")).items():
                    runs[run.lower() if run.isascii() else run.translate(lower)] += n
                for run, n in runs.items():
                    h = zlib.crc32(run.encode(), start)
                    if h % noise == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= least_length:
                        counts[run] += n
                if len(counts) >= COUNTED_AT_ONCE:
                    yield pairs(counts)
                    counts = Counter()
        if counts:
            yield pairs(counts)

    some = docs.select("doc_id", "text").mapInArrow(counted, "word string, n long")
    return some.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- tries --------------------------------------------------------------------------------


def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    if b.startswith(a):
        return len(a)
    for i, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return i
    return min(len(a), len(b))


def trie_paths(words: DataFrame, key: str = "key") -> DataFrame:
    """``f, path``: for each of the distinct words in ``key`` the numbers of its nodes, from the root (0) to the whole word."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, path, free = TaskContext.get().partitionId(), "", [-1], 0
        for batch in batches:
            texts, paths, upto = batch.column(1).to_pylist(), [], []
            for word in texts:
                k = shared(word, last)
                path = path[: k + 1] + list(range(free, free + len(word) - k))
                free += len(word) - k
                last = word
                paths.append(path)
                upto.append(free)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([part] * len(texts), pa.int32()),
                 pa.array(paths, pa.list_(pa.int64())), pa.array(upto, pa.int64())],
                ["f", "key", "part", "path", "upto"],
            )

    spark = words.sparkSession
    dealt = words.select("f", key).repartitionByRange(shuffle_partitions(spark), key).sortWithinPartitions(key)
    local = staged(dealt.mapInArrow(numbered, "f long, key string, part int, path array<long>, upto long"))
    # One word per range partition, in order.
    ends = local.groupBy("part").agg(
        F.max("key").alias("key"), F.max_by("path", "key").alias("path"), F.max("upto").alias("nodes")
    )
    before: dict[int, tuple[str, list[int], int]] = {}
    last, path, start = "", [0], 1
    for part, word, own, nodes in sorted(map(tuple, ends.collect()), key=lambda end: end[1]):
        before[part] = (last, path, start)
        k = shared(word, last)
        last, path, start = word, path[: k + 1] + [start + x for x in own[k + 1 :]], start + nodes

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, words, parts, paths, _ = (column.to_pylist() for column in batch.columns)
            whole = []
            for word, part, own in zip(words, parts, paths, strict=True):
                last, path, start = before[part]
                k = shared(word, last)
                whole.append(path[: k + 1] + [start + x for x in own[k + 1 :]])
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(whole, pa.list_(pa.int64()))], ["f", "path"])

    return local.mapInArrow(joined, "f long, path array<long>")


# --- neighbours ---------------------------------------------------------------------------


def node_pairs(words: DataFrame) -> DataFrame:
    """``f, p, s, skip, first``: every word's pairs, cut in two and with each place skipped.

    ``first`` marks the skipped places that begin a run of one code point: skipping any other of the run gives the same word.
    """
    ahead = trie_paths(words.select("f", F.col("word").alias("key")))
    back = trie_paths(words.select("f", F.reverse("word").alias("key")))
    letters = F.split("word", "")
    nodes = staged(
        words.select("f", letters.alias("letters"))
        .join(ahead.withColumnRenamed("path", "ps"), "f")
        .join(back.select("f", F.reverse("path").alias("ss")), "f")
    )
    size = F.size("letters")
    starts = F.zip_with(
        "letters", F.concat(F.array(F.lit("")), F.slice("letters", 1, size - 1)), lambda here, left: here != left
    )
    skipped = F.arrays_zip(
        F.slice("ps", 1, size).alias("p"), F.slice("ss", 2, size).alias("s"), starts.alias("first")
    )
    whole = F.arrays_zip(F.col("ps").alias("p"), F.col("ss").alias("s"))
    skips = nodes.select("f", F.inline(skipped).alias("p", "s", "first"))
    cuts = nodes.select("f", F.inline(whole).alias("p", "s"))
    return skips.select("f", "p", "s", F.lit(True).alias("skip"), "first").unionByName(
        cuts.select("f", "p", "s", F.lit(False).alias("skip"), F.lit(False).alias("first"))
    )


def neighbours(pairs: DataFrame) -> DataFrame:
    """``f, n_near, best``: number of words one code point away and the smallest ``f`` of these, if smaller than the own."""
    sums = pairs.groupBy("p", "s").agg(
        F.count_if("skip").alias("skips"),
        F.count_if("first").alias("firsts"),
        F.min(F.when(F.col("skip"), F.col("f"))).alias("least"),
        F.min(F.when(F.col("first"), F.col("f"))).alias("least_first"),
        F.min(F.when(~F.col("skip"), F.col("f"))).alias("whole"),
    )
    meeting = sums.where((F.col("skips") > 1) | (F.col("whole").isNotNull() & (F.col("firsts") > 0)))
    shorter = F.when(F.col("first"), F.col("whole"))
    met = pairs.join(meeting, ["p", "s"]).select(
        "f",
        F.when(F.col("skip"), F.col("skips") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0))
        .otherwise(F.col("firsts"))
        .alias("near"),
        F.when(F.col("skip"), F.least("least", shorter)).otherwise(F.col("least_first")).alias("best"),
    )
    return met.groupBy("f").agg(
        F.sum("near").alias("n_near"), F.min(F.when(F.col("best") < F.col("f"), F.col("best"))).alias("best")
    )


def roots_of(links: DataFrame) -> DataFrame:
    """``f, root``: the last one on the way along the links ``f -> form``; counts grow on the way, so there are no rings.

    Each round doubles the steps that a link takes.
    """
    ways = staged(links.select("f", F.col("form").alias("root")))
    while True:
        further = ways.select(F.col("f").alias("root"), F.col("root").alias("next"))
        longer = staged(ways.join(further, "root", "left").select("f", F.coalesce("next", "root").alias("root"), "next"))
        if longer.where("next is not null").isEmpty():
            return longer.select("f", "root")
        ways = longer.drop("next")


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for the distinct words in ``word, n``."""
    # A word's number is its place by falling frequency, so the smallest number is the best neighbour.
    ranked, _ = positions(words.select("word", "n"), F.col("n").desc(), F.col("word"))
    ranked = staged(ranked.withColumnRenamed("_pos", "f"))
    near = neighbours(node_pairs(ranked))
    forms = ranked.select(F.col("f").alias("best"), F.col("word").alias("form_word"), F.col("n").alias("best_n"))
    told = ranked.join(near, "f", "left").join(forms, "best", "left")
    fits = F.col("best_n") >= ratio * F.col("n")
    told = staged(
        told.select(
            "f", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(fits, F.col("best")).alias("form_f"),
            F.when(fits, F.col("form_word")).alias("form"),
            F.when(fits, F.col("best_n")).alias("form_n"),
        )
    )
    ends = roots_of(told.where("form_f is not null").select("f", F.col("form_f").alias("form")))
    ends = ends.join(ranked.select(F.col("f").alias("root"), F.col("word").alias("root_word")), "root").drop("root")
    return told.join(ends, "f", "left").select(
        "word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"
    )


def op11_trie_pair_variants(spark, sf_dir):
    return spelling_variants(staged(word_counts(table(spark, sf_dir, "documents"))))


# The noise hash bit by bit, and neighbours as words that agree once a place of either is left out.
OP11_SQL = r"""
with crc_table as (
  select list(c order by i) as crcs from (
    select i, list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, z: case when c % 2 = 1 then xor(3988292384, c // 2) else c // 2 end) as c
    from range(256) as r(i))
), runs as (
  select coalesce(doc_id::varchar, '') as doc, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) as run
  from documents
), lowered as (
  select doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as times
  from runs group by all
), hashed as (
  select run, times, xor(list_reduce([4294967295::bigint] || list_transform(
      range(1, length(hex(encode(doc || ':' || run))) // 2 + 1),
      lambda k: ('0x' || substr(hex(encode(doc || ':' || run)), 2 * k - 1, 2))::bigint),
    lambda c, b: xor(crcs[(xor(c, b) % 256) + 1], c // 256)), 4294967295) as h
  from lowered, crc_table
), noisy as (
  select case when h % 199 = 0 then left(run, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, times
  from hashed
), words as (
  select word, sum(times)::bigint as n from noisy where length(word) >= 6 group by word having sum(times) >= 5
), holes as (
  select word, n, k, left(word, k) as a, substr(word, k + 2) as b, a || b as short
  from words, lateral (select unnest(range(length(word))) as k) as t
), near as (
  select x.word, y.word as other, y.n as m from holes as x join holes as y on x.k = y.k and x.a = y.a and x.b = y.b and x.word <> y.word
  union select x.word, y.word, y.n from holes as x join words as y on x.short = y.word
  union select y.word, x.word, x.n from holes as x join words as y on x.short = y.word
), best as (
  select word, count(*) as n_near, first(other order by m desc, other) as other, max(m) as m from near group by word
), formed as (
  select word, case when m >= 5 * n then other end as form, n, coalesce(n_near, 0)::bigint as n_near,
    case when m >= 5 * n then m end as form_n
  from words left join best using (word)
), ways as (
  with recursive steps as (
    select word, word as here, 0 as depth from formed
    union all select s.word, f.form, depth + 1 from steps as s join formed as f on f.word = s.here where f.form is not null
  ) select word, last(here order by depth) as root from steps group by word
)
select word, form, root, n, n_near, form_n from formed join ways using (word)
"""
