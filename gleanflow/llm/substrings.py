"""Removal of repeated substrings: suffixes in order through ``WINDOW`` bytes by radix passes, most significant digit first.

A full suffix order isn't needed to find repeated windows of n bytes: suffixes that agree in n bytes form one group,
and everything beyond stays unsorted. The digits of a suffix's first n bytes are taken in this order:

1. Its anchor: the ``GRAM`` bytes of the window with the smallest hash. Equal windows have equal anchors, and
   neighbouring windows mostly share one, so this digit costs one entry per dozen bytes. A pass over all documents finds
   the anchors that several documents have; all suffixes with other anchors are alone in their group and drop out.
2. The bytes on both sides of the anchor. They travel with each surviving anchor, once per chunk of documents,
   and are enough for all windows around it. Within an anchor's group a pass for each distance between window
   start and anchor orders the suffixes by their remaining bytes; equal groups are exactly the repeated windows,
   and the smallest document of a group keeps it.

Texts are reduced to distinct ones, which are kept in chunks as a bucketed table, so the passes move digits and answers
and no texts. A chunk sends an anchor or a context once however many of its documents share it, so passages that many
documents share don't gather in one task. Hashes of anchors only admit candidates: a context holds the
anchor's bytes too, and windows of one hash are compared byte by byte.

Defined cases: null and empty texts have no windows; a text that a smaller id has too is removed whole if it
has at least ``WINDOW`` bytes; a null id comes after all others and null ids count as one document, as do repeated ids; an empty
table gives no rows; other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanflow.llm.common import shuffle_partitions, staged, table, text_of

WINDOW = 50
GRAM = 24
SIDE = WINDOW - GRAM
# Bytes of text in a chunk, and in a bucket of anchors, about.
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 64 << 20
# Bytes that are hashed at once.
STEP_BYTES = 1 << 20
ANCHOR_BITS = 40
NO_ID = np.int64(2**63 - 1)
ODD = 0x9E3779B97F4A7C15


# --- bytes to digits -------------------------------------------------------------------


def scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolled(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each position, put together from powers of two."""
    n = len(data) - size + 1
    part, length = data.astype(np.uint64) + np.uint64(1), 1
    whole, done = None, 0
    while True:
        if size & length:
            whole = part[:n] if whole is None else whole[:n] * np.uint64(pow(ODD, length, 1 << 64)) + part[done : done + n]
            done += length
        if 2 * length > size:
            return scrambled(whole)
        part = part[:-length] * np.uint64(pow(ODD, length, 1 << 64)) + part[length:]
        length *= 2


def slid(values: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over ``size`` values from each position."""
    n, length = len(values) - size + 1, 1
    while 2 * length <= size:
        values = pick(values[:-length], values[length:])
        length *= 2
    return pick(values[:n], values[size - length : size - length + n])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of anchors of windows that lie in one text; texts lie one after the other in ``data``."""
    if len(data) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = rolled(data, GRAM)
    least = slid(grams, SIDE + 1, np.minimum)
    # No window starts in the last WINDOW - 1 bytes of a text.
    over = np.zeros(len(data) + 1, np.int32)
    np.add.at(over, np.maximum(starts, ends - WINDOW + 1), 1)
    np.add.at(over, ends, -1)
    least[np.cumsum(over)[: len(least)] > 0] = 0
    # A position is an anchor if it is the least of any window over it.
    most = slid(np.concatenate((np.zeros(SIDE, np.uint64), least, np.zeros(SIDE, np.uint64))), SIDE + 1, np.maximum)
    at = np.flatnonzero((most == grams) & (grams != 0))
    # Least hashes are small numbers: scrambled once more, their first bits are even.
    return at, scrambled(grams[at]) >> np.uint64(64 - ANCHOR_BITS)


def groups_of_texts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about STEP_BYTES."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > STEP_BYTES:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


class Chunk:
    """Texts of a chunk in a fixed order and their anchors."""

    def __init__(self, part: pa.Table):
        rows = sorted(zip(part.column("doc").to_pylist(), part.column("digest").to_pylist(), range(len(part)), strict=True))
        bodies = part.column("body")
        self.digests = [r[1] for r in rows]
        self.docs = np.array([r[0] for r in rows], np.int64)
        self.texts: list[bytes] = [bodies[r[2]].as_py() for r in rows]

    def steps(self):
        """``(first text, data, starts, ends, text of each anchor, position, hash)`` for runs of texts."""
        for first, last in groups_of_texts(self.texts):
            sizes = np.array([len(t) for t in self.texts[first:last]], np.int64)
            data = np.frombuffer(b"".join(self.texts[first:last]), np.uint8)
            ends = np.cumsum(sizes)
            at, h = anchors(data, ends - sizes, ends)
            yield first, data, ends - sizes, ends, np.searchsorted(ends, at, "right"), at, h


def per_value(order_by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order and the starts of equal values in it."""
    order = np.argsort(order_by, kind="stable")
    some = order_by[order]
    return order, np.flatnonzero(np.concatenate((np.ones(min(1, len(some)), bool), some[1:] != some[:-1])))


def anchor_table(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchor hashes of a chunk, and whether several documents of it have them."""
    hs, docs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for first, _, _, _, text, _, h in chunk.steps():
        hs.append(h)
        docs.append(chunk.docs[first + text])
    h, d = np.concatenate(hs), np.concatenate(docs)
    order, starts = per_value(h)
    if not len(starts):
        return h, np.empty(0, bool)
    several = np.minimum.reduceat(d[order], starts) != np.maximum.reduceat(d[order], starts)
    return h[order][starts], several


# --- contexts -----------------------------------------------------------------------------

# What a context holds: the anchor with SIDE bytes before and after it, and how many of these are in the text.
WIDTH = SIDE + GRAM + SIDE


def contexts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, at: np.ndarray):
    left = np.minimum(at - starts[text], SIDE)
    right = np.minimum(ends[text] - at - GRAM, SIDE)
    padded = np.concatenate((np.zeros(SIDE, np.uint8), data, np.zeros(SIDE, np.uint8)))
    around = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[at]
    # Near the ends of a text the bytes of its neighbours are blanked.
    edge = np.flatnonzero((left < SIDE) | (right < SIDE))
    steps = np.arange(WIDTH)
    around[edge] *= (steps >= SIDE - left[edge, None]) & (steps < SIDE + GRAM + right[edge, None])
    return around, left.astype(np.uint8), right.astype(np.uint8)


def context_table(chunk: Chunk, wanted: np.ndarray):
    """Distinct contexts of the wanted anchors in a chunk, in a fixed order.

    Returns hash, bytes, left, right and smallest document of each, and for every occurrence ``(text, position,
    number of its context)``.
    """
    hs, rows, lefts, rights, texts, places = [], [], [], [], [], []
    for first, data, starts, ends, text, at, h in chunk.steps():
        keep = np.isin(h, wanted)
        text, at, h = text[keep], at[keep], h[keep]
        body, left, right = contexts(data, starts, ends, text, at)
        for out, value in zip(
            (hs, rows, lefts, rights, texts, places), (h, body, left, right, first + text, at - starts[text]), strict=True
        ):
            out.append(value)
    if not sum(map(len, hs)):
        empty = np.empty(0, np.int64)
        return np.empty(0, np.uint64), np.empty((0, WIDTH), np.uint8), empty, empty, empty, (empty, empty, empty)
    h, body, left, right, text, place = map(np.concatenate, (hs, rows, lefts, rights, texts, places))
    whole = np.concatenate((h[:, None].view(np.uint8).reshape(len(h), 8), left[:, None], right[:, None], body), axis=1)
    whole = np.ascontiguousarray(whole).view(np.dtype((np.void, whole.shape[1]))).ravel()
    _, one, number = np.unique(whole, return_index=True, return_inverse=True)
    least = np.full(len(one), NO_ID)
    np.minimum.at(least, number, chunk.docs[text])
    return h[one], body[one], left[one], right[one], least, (text, place, number)


def alike(body: np.ndarray, rows: np.ndarray, others: np.ndarray, at: int) -> bool:
    """True if each row's window, WINDOW bytes from ``at`` in its body, is that of the other row."""
    wide = WINDOW // 8
    words = np.ndarray((len(body), wide), "<u8", body, at, body.strides[:1] + (8,))
    tail = slice(at + 8 * wide, at + WINDOW)
    return bool((words[rows] == words[others]).all() and (body[rows, tail] == body[others, tail]).all())


def late_windows(h, body, left, right, docs) -> np.ndarray:
    """For each context a mask of distances from window start to anchor at which a smaller document has the window too."""
    n = len(h)
    mask = np.zeros(n, np.uint32)
    if not n:
        return mask
    body = np.ascontiguousarray(body)
    # Hashes of the j bytes before and after the anchor, for all j.
    before, after = np.zeros((SIDE + 1, n), np.uint64), np.zeros((SIDE + 1, n), np.uint64)
    for j in range(SIDE):
        before[j + 1] = before[j] * np.uint64(ODD) + body[:, SIDE - 1 - j] + np.uint64(1)
        after[j + 1] = after[j] * np.uint64(ODD) + body[:, SIDE + GRAM + j] + np.uint64(1)
    for distance in range(SIDE + 1):
        fits = np.flatnonzero((left >= distance) & (right >= SIDE - distance))
        if len(fits) < 2:
            continue
        key = scrambled(before[distance, fits]) + np.uint64(ODD) * scrambled(after[SIDE - distance, fits] + h[fits])
        order, starts = per_value(key)
        inside = np.ones(len(order), bool)
        inside[starts] = False
        same = np.flatnonzero(inside)
        if not alike(body, fits[order[same]], fits[order[same - 1]], SIDE - distance):
            # Different windows of one hash: sorted by their bytes.
            bytes_ = np.ascontiguousarray(body[fits, SIDE - distance : SIDE - distance + WINDOW])
            order, starts = per_value(np.unique(bytes_.view((np.void, WINDOW)).ravel(), return_inverse=True)[1])
        lowest = np.minimum.reduceat(docs[fits][order], starts)
        first = np.repeat(lowest, np.diff(np.append(starts, len(fits))))
        late = fits[order][docs[fits][order] > first]
        mask[late] |= np.uint32(1 << distance)
    return mask


# --- jobs -----------------------------------------------------------------------------------

PIECE = "bucket int, chunk int, body binary"
PIECE_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("body", pa.binary())])
CONTEXT = np.dtype([("h", "<u8"), ("doc", "<i8"), ("left", "u1"), ("right", "u1"), ("body", "u1", (WIDTH,))])


def by_bucket(h: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets and the positions of their hashes, in the order given."""
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    order, starts = per_value(bucket)
    for some in np.split(order, starts[1:]) if len(starts) else ():
        yield int(bucket[some[0]]), some


def packed(values: np.ndarray) -> bytes:
    """Sorted 40-bit numbers as differences."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T[:5]).tobytes(), 1)


def unpacked(body: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(body), np.uint8).reshape(5, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :5] = planes.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def pieces(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, PIECE_ARROW.types, strict=True)], schema=PIECE_ARROW)


def removed(text: bytes, places: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes and runs covered by windows that start at ``places``, and what is left."""
    edge = np.zeros(len(text) + 1, np.int32)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + WINDOW, -1)
    gone = np.cumsum(edge)[:-1] > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, np.frombuffer(text, np.uint8)[~gone].tobytes()


def deduplicated(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row; with texts also ``kept``."""
    spark = docs.sparkSession
    body = text_of().cast("binary")
    digest = F.unhex(F.sha2(body, 256)).alias("digest")
    order = F.coalesce("doc_id", F.lit(int(NO_ID))).cast("long")
    total = docs.agg(F.sum(F.octet_length(text_of()))).first()[0] or 0
    parts = shuffle_partitions(spark)
    chunks = max(parts, -(-total // CHUNK_BYTES))
    buckets = max(parts, -(-total // BUCKET_BYTES))

    # Distinct texts with their smallest document, in chunks.
    texts = (
        docs.select(digest, order.alias("doc"), body.alias("body"))
        .groupBy("digest")
        .agg(F.min("doc").alias("doc"), F.first("body").alias("body"))
        .withColumn("chunk", F.pmod(F.xxhash64("digest"), F.lit(chunks)).cast("int"))
    )
    name = f"gleanflow_texts_{uuid.uuid4().hex}"
    texts.repartition(chunks, "chunk").write.format("parquet").bucketBy(chunks, "chunk").saveAsTable(name)
    try:
        results = staged(passes(spark.table(name), buckets, with_text))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")

    rows = docs.select("doc_id", order.alias("_doc"), digest, F.octet_length(text_of()).cast("long").alias("n_bytes"))
    found = rows.join(results, "digest")
    copy = (F.col("_doc") > F.col("doc")) & (F.col("n_bytes") >= WINDOW)
    empty = hashlib.sha256(b"").hexdigest()
    columns = [
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, 1).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, empty).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    ]
    return found.select(*columns, *([F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_text else []))


def passes(texts: DataFrame, buckets: int, with_text: bool) -> DataFrame:
    """``digest, doc, n_removed, n_spans, kept_sha256`` (and ``kept``) for a bucketed table ``digest, doc, body, chunk``."""

    def first_digits(part: pa.Table) -> pa.Table:
        chunk = part.column("chunk")[0].as_py()
        h, several = anchor_table(Chunk(part))
        out = []
        for bucket, some in by_bucket(h, buckets):
            a, b = packed(h[some]), np.packbits(several[some]).tobytes()
            out.append((bucket, chunk, len(a).to_bytes(4, "little") + a + b))
        return pieces(out)

    def shared_anchors(part: pa.Table) -> pa.Table:
        bucket, chunk = part.column("bucket")[0].as_py(), part.column("chunk").to_pylist()
        hs, several = [], []
        for body in part.column("body").to_pylist():
            size = int.from_bytes(body[:4], "little")
            hs.append(unpacked(body[4 : 4 + size]))
            several.append(np.unpackbits(np.frombuffer(body[4 + size :], np.uint8), count=len(hs[-1])).astype(bool))
        h, s = np.concatenate(hs), np.concatenate(several)
        order, starts = per_value(h)
        counts = np.diff(np.append(starts, len(h)))
        shared = np.empty(len(h), bool)
        shared[order] = np.repeat((counts > 1) | np.logical_or.reduceat(s[order], starts), counts)
        cuts = np.cumsum([len(x) for x in hs])[:-1]
        return pieces([(bucket, c, packed(x[m])) for c, x, m in zip(chunk, hs, np.split(shared, cuts), strict=True) if m.any()])

    def next_digits(part: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(part) or not len(answers):
            return pieces([])
        chunk = part.column("chunk")[0].as_py()
        wanted = np.concatenate([unpacked(b) for b in answers.column("body").to_pylist()])
        h, body, left, right, least, _ = context_table(Chunk(part), wanted)
        rows = np.empty(len(h), CONTEXT)
        rows["h"], rows["doc"], rows["left"], rows["right"], rows["body"] = h, least, left, right, body
        return pieces([(b, chunk, zlib.compress(rows[some].tobytes(), 1)) for b, some in by_bucket(h, buckets)])

    def equal_groups(part: pa.Table) -> pa.Table:
        bucket, chunk = part.column("bucket")[0].as_py(), part.column("chunk").to_pylist()
        each = [np.frombuffer(zlib.decompress(b), CONTEXT) for b in part.column("body").to_pylist()]
        rows = np.concatenate(each)
        mask = late_windows(rows["h"], rows["body"], rows["left"], rows["right"], rows["doc"])
        cuts = np.cumsum([len(x) for x in each])[:-1]
        return pieces(
            [(bucket, c, zlib.compress(m.astype("<u4").tobytes(), 1)) for c, m in zip(chunk, np.split(mask, cuts), strict=True)]
        )

    kept_schema = pa.schema(
        [("digest", pa.binary()), ("doc", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
        + [("kept", pa.binary())] * with_text
    )

    def kept_texts(part: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(part):
            return kept_schema.empty_table()
        chunk = Chunk(part)
        places: dict[int, np.ndarray] = {}
        if len(answers):
            wanted = np.concatenate([unpacked(b) for b in answers.column("anchors").to_pylist()])
            h, _, left, right, least, (text, place, number) = context_table(chunk, wanted)
            mask = np.zeros(len(h), np.uint32)
            given = dict(zip(answers.column("bucket").to_pylist(), answers.column("masks").to_pylist(), strict=True))
            for bucket, some in by_bucket(h, buckets):
                mask[some] = np.frombuffer(zlib.decompress(given[bucket]), "<u4")
            # A context that a smaller document of the chunk has too repeats in all windows that it holds.
            later = chunk.docs[text] > least[number]
            starts, owners = [], []
            for distance in range(SIDE + 1):
                fits = (left[number] >= distance) & (right[number] >= SIDE - distance)
                hit = fits & (later | (mask[number] >> np.uint32(distance) & np.uint32(1)).astype(bool))
                starts.append(place[hit] - distance)
                owners.append(text[hit])
            starts, owners = np.concatenate(starts), np.concatenate(owners)
            order, cuts = per_value(owners)
            for some in np.split(order, cuts[1:]) if len(cuts) else ():
                places[int(owners[some[0]])] = starts[some]
        out = []
        for i, body in enumerate(chunk.texts):
            gone, runs, rest = removed(body, places[i]) if i in places else (0, 0, body)
            sha = hashlib.sha256(rest).hexdigest()
            out.append((chunk.digests[i], int(chunk.docs[i]), gone, runs, sha, *([rest] * with_text)))
        columns = zip(*out, strict=True)
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kept_schema.types, strict=True)], schema=kept_schema)

    by_chunk = texts.groupBy("chunk")
    digits = by_chunk.applyInArrow(first_digits, PIECE)
    shared = staged(digits.groupBy("bucket").applyInArrow(shared_anchors, PIECE))
    further = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(next_digits, PIECE)
    masks = staged(further.groupBy("bucket").applyInArrow(equal_groups, PIECE))
    answers = shared.withColumnRenamed("body", "anchors").join(masks.withColumnRenamed("body", "masks"), ["bucket", "chunk"])
    schema = "digest binary, doc long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(kept_texts, schema)


def op8_radix_suffixes(spark, sf_dir):
    return deduplicated(table(spark, sf_dir, "documents"))


# Every 50-byte string of every text, put together byte by byte.
OP8_SQL = r"""
with bytes as (
  select doc_id, unnest(string_split(rtrim(regexp_replace(hex(encode(text)), '(..)', '\1,', 'g'), ','), ',')) as b,
    generate_subscripts(string_split(rtrim(regexp_replace(hex(encode(text)), '(..)', '\1,', 'g'), ','), ','), 1) as pos
  from documents where text <> ''
), w2 as (select *, b || lead(b, 1) over d as s2 from bytes window d as (partition by doc_id order by pos)),
w4 as (select *, s2 || lead(s2, 2) over d as s4 from w2 window d as (partition by doc_id order by pos)),
w8 as (select *, s4 || lead(s4, 4) over d as s8 from w4 window d as (partition by doc_id order by pos)),
w16 as (select *, s8 || lead(s8, 8) over d as s16 from w8 window d as (partition by doc_id order by pos)),
w50 as (
  select doc_id, pos, b, s16 || lead(s16, 16) over d || lead(s16, 32) over d || lead(s2, 48) over d as s50
  from w16 window d as (partition by doc_id order by pos)
), firsts as (select s50, min(doc_id) as doc from w50 where s50 is not null group by s50 having count(*) > 1
), marked as (
  select w.doc_id, pos, b, max(case when w.doc_id > f.doc then 1 else 0 end) over (
    partition by w.doc_id order by pos rows between 49 preceding and current row) as gone
  from w50 as w left join firsts as f using (s50)
), edges as (select *, gone - coalesce(lag(gone) over (partition by doc_id order by pos), 0) as step from marked),
told as (
  select doc_id, sum(gone)::bigint as n_removed, count(*) filter (step = 1) as n_spans,
    sha256(unhex(coalesce(string_agg(b, '' order by pos) filter (gone = 0), ''))) as kept_sha256
  from edges group by doc_id
)
select doc_id, coalesce(octet_length(encode(text)), 0)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  coalesce(kept_sha256, sha256('')) as kept_sha256
from documents left join told using (doc_id)
"""
