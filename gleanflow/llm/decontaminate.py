"""Benchmark decontamination by spaced-seed hashing.

Words are hashed at the selected places of fixed masks, so a seed still matches when words at the other places were
changed. Seeds of the benchmark fill a bitmap of fixed size. Each document tests its seeds against it and keeps the words
around possible hits only. These join the benchmark's seeds, and each hit is verified: along its diagonal, the best
run of words may hold substitutions but must agree in ``MIN_SHARE`` of its places and in ``MIN_WORDS`` words
(in 80 % of the item if that is shorter). The masks hit every such run of up to 20 words, whichever words were changed. Items of
``SHORT_ITEM`` to 12 words have masks of their own; shorter ones are looked for as a whole and unchanged.

A fuller bitmap only lets more candidates into the join, so larger benchmarks need no other path.

Defined cases: null and empty texts have no words and never match; items without words
are not looked for; an item of a single word is found wherever that word stands; repeated items are found under each id; equal documents give equal
results; an empty table on either side gives no rows; other columns of the input are not looked at.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanflow.llm.common import named, row_key, staged, table, unused, without

# Fixed masks: 1 is a place that counts. Found by search, so that one of them misses all changed words of any run that is accepted.
MASKS = ("1101111", "1100010111", "111000100101")
SHORT_MASKS = ("11101", "1100101")
MIN_WORDS = 12
MIN_SHARE = 0.8
# Items of fewer words allow no changes.
SHORT_ITEM = 8
# Bits of the bitmap that every task holds: 8 MB whatever the benchmark's size.
BITMAP_BITS = 1 << 26
# Words kept on each side of a hit.
AROUND = 64
MISMATCH = 2.0

ASCII_WORDS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
REMEMBERED = 500_000
# Letters of scripts that are written without spaces: each one is a word.
UNSPACED = re.compile(
    "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aad\u3005-\u3007\u3021-\u3029\u3031-\u3035\u3040-\u30ff\u3100-\u312f"
    "\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua9e0-\ua9ff\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f"
    "\U00020000-\U0003ffff]"
)


class WordIds(dict):
    """64-bit ids of words, remembered within bounds."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Places(dict):
    """What a character of a word becomes: itself, nothing (format characters) or a gap."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = unicodedata.category(c)
        value = c if kind[0] in "LMN" or kind in ("Cs", "Co") else "" if kind == "Cf" else " "
        if value == c and UNSPACED.match(c):
            value = f" {c} "
        self[code] = value
        return value


PLACES = Places()


class Parts(dict):
    """The words in a run that has characters beyond ASCII, remembered within bounds."""

    def __missing__(self, run: bytes) -> tuple[bytes, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        text = run.decode("utf-8", "surrogatepass").translate(PLACES)
        value = self[run] = tuple(w.encode("utf-8", "surrogatepass") for w in text.split())
        return value


PARTS = Parts()


def word_ids(text: str | None, known: WordIds) -> np.ndarray:
    """Lower-case words: runs of letters, marks and numbers; letters of unspaced scripts one by one."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(ASCII_WORDS).split()
    if text and not text.isascii():
        words = [w for run in words for w in ((run,) if run.isascii() else PARTS[run])]
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def seeds(ids: np.ndarray, mask: str) -> np.ndarray:
    """One hash for each place at which the mask fits."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, len(mask) * 1_000_003 + int(mask, 2), np.uint64)
    for at, one in enumerate(mask):
        if one == "1":
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[at : at + n]
    return mixed(h)


def item_masks(size: int) -> tuple[str, ...]:
    if size > MIN_WORDS:
        return MASKS
    return SHORT_MASKS if size >= SHORT_ITEM else ("1" * size,) if size else ()


def benchmark_seeds(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """``item_id, words array<long>, hashes, places`` of each item."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordIds()
        for batch in batches:
            out = []
            for item, body in zip(batch["item_id"], batch["text"], strict=True):
                ids = word_ids(body, known)
                for mask in item_masks(len(ids)):
                    h = seeds(ids, mask)
                    out.append((item, ids.view(np.int64), mask, h.view(np.int64), np.arange(len(h))))
            yield pd.DataFrame(out, columns=["item_id", "words", "mask", "hashes", "places"])

    kind = dict(benchmark.dtypes)[item_id]
    return benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).mapInPandas(
        of, f"item_id {kind}, words array<long>, mask string, hashes array<long>, places array<long>"
    )


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits set at the hashes; at most BITMAP_BITS / 64 words of 64 bits come to the driver."""
    bit = F.col("hash").bitwiseAND(F.lit(BITMAP_BITS - 1))
    words = (
        hashes.select(F.shiftright(bit, 6).alias("w"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("b"))
        .groupBy("w")
        .agg(F.expr("bit_or(b)").alias("b"))
        .toArrow()
    )
    bits = np.zeros(BITMAP_BITS // 64, np.int64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return bits.view(np.uint64)


REGION = "key long, words array<long>, start long, hashes array<long>, places array<long>"


def candidates(docs: DataFrame, text: str, bits, masks: list[str]) -> DataFrame:
    """Words around places whose seeds are in the bitmap, one row for each stretch of a document."""
    longest = max(map(len, masks), default=0)

    def hits(ids: np.ndarray, held: np.ndarray):
        where, what = [], []
        for mask in masks:
            h = seeds(ids, mask)
            low = h & np.uint64(BITMAP_BITS - 1)
            at = np.flatnonzero(held[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1))
            if "0" not in mask:
                # A whole item: its first place in the document says all.
                at = np.sort(at[np.unique(h[at], return_index=True)[1]])
            where.append(at)
            what.append(h[at])
        where, what = np.concatenate(where), np.concatenate(what)
        order = np.argsort(where, kind="stable")
        return where[order], what[order]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds()
        held = bits.value
        for batch in batches:
            rows = ([], [], [], [], [])
            for key, body in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                ids = word_ids(body.as_py(), known)
                where, what = hits(ids, held) if masks else ((), ())
                if not len(where):
                    continue
                cuts = np.flatnonzero(np.diff(where) > 2 * AROUND) + 1
                for places, found in zip(np.split(where, cuts), np.split(what, cuts), strict=True):
                    first = max(0, int(places[0]) - AROUND)
                    last = int(places[-1]) + longest + AROUND
                    for column, value in zip(
                        rows, (key, ids[first:last].view(np.int64), first, found.view(np.int64), places - first), strict=True
                    ):
                        column.append(value)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, (pa.int64(), lists, pa.int64(), lists, lists), strict=True)],
                ["key", "words", "start", "hashes", "places"],
            )

    return docs.select("key", F.col(text).alias("text")).mapInArrow(find, REGION)


def best_run(agree: np.ndarray) -> tuple[int, int, int]:
    """Start, end and agreeing places of the run with the highest score."""
    total = np.concatenate(([0.0], np.cumsum(np.where(agree, 1.0, -MISMATCH))))
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return start, end, int(agree[start:end].sum())


def overlap(words: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Along ``place in words - place in item = shift``: run start in ``words``, length, agreeing words."""
    low, high = max(0, shift), min(len(words), shift + len(item))
    if high <= low:
        return 0, 0, 0
    start, end, agree = best_run(words[low:high] == item[low - shift : high - shift])
    return low + start, end - start, agree


def overlap_of(words: pd.Series, item: pd.Series, shift: pd.Series) -> pd.DataFrame:
    found = [overlap(np.asarray(w), np.asarray(i), s) for w, i, s in zip(words, item, shift, strict=True)]
    return pd.DataFrame(found, columns=["run_start", "run_words", "agreeing"], dtype="int64")


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Verified overlaps of documents (by their ``key``) and items: ``key, item_id, first_word, n_words, n_agreeing, item_words``."""
    items = staged(benchmark_seeds(benchmark, item_id, text))
    exploded = items.select("item_id", F.explode(F.arrays_zip("hashes", "places")).alias("s"))
    exploded = exploded.select("item_id", F.col("s.hashes").alias("hash"), F.col("s.places").alias("item_place"))
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(bitmap(exploded))
    masks = sorted(r[0] for r in items.select("mask").distinct().collect())  # 5 and one for each length below SHORT_ITEM at most
    regions = candidates(docs, text, bits, masks).withColumn("region", F.monotonically_increasing_id())
    regions = staged(regions)
    hits = regions.select("region", F.explode(F.arrays_zip("hashes", "places")).alias("s")).select(
        "region", F.col("s.hashes").alias("hash"), F.col("s.places").alias("place")
    )
    diagonals = (
        hits.join(exploded, "hash")
        .select("region", "item_id", (F.col("place") - F.col("item_place")).alias("shift"))
        .distinct()
    )
    bodies = items.groupBy("item_id", F.xxhash64("words").alias("_w")).agg(F.first("words").alias("item")).drop("_w")
    verify = F.pandas_udf(overlap_of, "run_start long, run_words long, agreeing long")
    checked = (
        diagonals.join(regions.select("region", "key", "start", "words"), "region")
        .join(bodies, "item_id")
        .withColumn("_v", verify("words", "item", "shift"))
    )
    least = F.least(F.lit(MIN_WORDS), F.ceil(F.size("item") * MIN_SHARE))
    return checked.where(
        (F.col("_v.agreeing") >= least) & (F.col("_v.agreeing") >= MIN_SHARE * F.col("_v.run_words"))
    ).select(
        "key",
        "item_id",
        (F.col("start") + F.col("_v.run_start")).alias("first_word"),
        F.col("_v.run_words").alias("n_words"),
        F.col("_v.agreeing").alias("n_agreeing"),
        F.size("item").cast("long").alias("item_words"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row's key and item, the longest overlap: ``key, item_id, first_word, n_words, n_agreeing, item_words``."""
    found = overlaps(docs, benchmark)
    best = F.max_by(
        F.struct("first_word", "n_words", "n_agreeing", "item_words"), F.struct("n_agreeing", -F.col("first_word"))
    )
    return found.groupBy("key", "item_id").agg(best.alias("_b")).select("key", "item_id", "_b.*")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("key", row_key("doc_id", "text"))


def op7_spaced_seed_decontamination(spark, sf_dir):
    """Contaminated documents only, one row per document and benchmark item."""
    docs = keyed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return (
        docs.select("doc_id", "key").join(found, "key").select("doc_id", "item_id", "first_word", "n_words", "n_agreeing", "item_words")
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that overlap a benchmark item."""
    mark = unused(docs.columns, "_key")
    found = overlaps(docs.select(row_key("doc_id", "text").alias("key"), "text"), benchmark)
    found = staged(found.select(F.col("key").alias(mark)).distinct())
    return without(docs.withColumn(mark, row_key("doc_id", "text")), found, mark).select(*named(docs.columns))
