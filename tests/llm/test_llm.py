"""The training-data operators against plain Python on small tables with odd rows."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from gleanflow.llm import decontaminate as dc
from gleanflow.llm import mixing, quality, revisits, sharding, simhash, substrings, surrogates, tokens, wrappers
from gleanflow.llm.common import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, _fp string, key string, shard string, host string"
WORDS = "the quick brown fox jumps over lazy dog while seven large boats sail past quiet green islands toward home".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[b % len(WORDS)] + str(b % 3) for b in np.random.default_rng(seed).integers(0, 10_000, n))


LONG = prose(1, 3000)
ROWS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG.replace("fox", "cat", 1), "b"), (4, None, "b"), (5, "", None), (6, "One", "c"),
    (7, "one", "c"), (8, "two words", "c"), (8, "two words", "c"), (8, "other words of it", "c"), (None, prose(2, 200), None),
    (None, LONG, "a"), (9, " \t\n", "a"), (10, prose(3, 120), "d"), (11, prose(3, 120) + " end", "d"), (12, "aaaa" * 60, "e"),
    (13, "naïve ☃ " * 40, "e"), (14, prose(4, 400)[:900] + prose(2, 200), "a"), (15, "x" * 49, "a"), (16, "x" * 50, "a"), (17, "x" * 50, "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "f", "k", "s", "h") for r in ROWS], SCHEMA).repartition(3)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_registered_queries():
    names = {n.split("_")[0] for n in entry.queries()}
    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} <= names


def test_every_operator_takes_an_empty_table(spark, docs):
    none = docs.where("false")
    bench = spark.createDataFrame([(1, prose(1, 30))], "item_id int, text string")
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.one_per_group(none).count() == 0
    assert sharding.shard_rows(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert mixing.mixed(none).count() == 0
    assert quality.judged(none).count() == 0
    assert quality.good_documents(none).count() == 0
    assert dc.contaminated(dc.keyed(none.drop("key")), bench).count() == 0
    assert dc.clean_documents(docs, bench.where("false")).count() == len(ROWS)
    assert substrings.deduplicated(none).count() == 0
    assert surrogates.pseudonymized(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert wrappers.main_texts(pages).count() == 0
    assert revisits.resolve(revisits.crawl(pages)).count() == 0


# --- SimHash ---------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def plain_components(prints, ids):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        r = find(i)
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    return [low[find(i)] for i in range(len(ids))]


def test_simhash_components(docs):
    prints = [plain_fingerprint(r[1]) for r in ROWS]
    want = sorted(zip((r[0] for r in ROWS), (f"{p:016x}" for p in prints), plain_components(prints, [r[0] for r in ROWS]), strict=True), key=repr)
    found = simhash.near_duplicates(docs).withColumn("fp", simhash.hex_digits("_fp"))
    assert rows(found, "doc_id", "fp", "component_id") == want


def test_simhash_matches_spark_hash(spark):
    assert spark.sql("select xxhash64('one two three') h").first()[0] == simhash.shingle_hashes("one two three").view(np.int64)[0]


@pytest.mark.parametrize("leaf", [64, 300])
def test_tree_finds_all_links(monkeypatch, leaf):
    monkeypatch.setattr(simhash, "LEAF", 40)
    rng = np.random.default_rng(leaf)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = base[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    ball = base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    points = np.unique(np.concatenate((base, near, ball)))
    want = {(i, j) for i in range(len(points)) for j in range(i) if np.bitwise_count(points[i] ^ points[j]) <= 3}
    place = {int(p): i for i, p in enumerate(points)}
    met = set()
    for _, some in simhash.deal(points, simhash.shard_tree(points[::2], leaf)):
        here = [place[int(p)] for p in some]
        met |= {(i, j) for i in here for j in here if i > j} & want
    assert met == want
    root = simhash.local_roots(points)
    assert all(root[i] == root[j] for i, j in want)
    assert [int(r) for r in root] == [
        min(k for k, c in enumerate(plain_components([int(p) for p in points], list(range(len(points))))) if c == plain)
        for plain in plain_components([int(p) for p in points], list(range(len(points))))
    ]


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (5, 5)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}


def test_one_row_of_each_group_stays(docs):
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    components_ = set(plain_components([plain_fingerprint(r[1]) for r in ROWS], [r[0] for r in ROWS]))
    assert sorted((r[0] for r in kept.select("doc_id").collect()), key=repr) == sorted(components_, key=repr)


def test_pipeline_keeps_one_row_of_each_group(spark):
    rng = np.random.default_rng(8)
    table, hot = [], prose(900, 4000).split()
    table += [(1000 + i, " ".join([*hot[: 5 * i], f"own{i}", *hot[5 * i + 1 :]])) for i in range(120)]
    table += [(i, prose(200 + i, int(rng.integers(1, 400)))) for i in range(100)]
    table += [(2000, None), (2001, ""), (2002, "two words"), (2003, "two words"), (2003, "two words"), (None, "two Words"), (None, prose(77, 90))]
    docs = spark.createDataFrame([(*r, 1, 2, "m") for r in table], "doc_id long, text string, _key int, _fp int, _mark string")
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    found = plain_components([plain_fingerprint(r[1]) for r in table], [r[0] for r in table])
    assert kept.columns == docs.columns and {(r._key, r._fp, r._mark) for r in kept.collect()} == {(1, 2, "m")}
    assert sorted((r[0] for r in kept.collect()), key=repr) == sorted(set(found), key=repr)
    assert corpus_pipeline.near_dedup(spark, docs.where("false"), SF).count() == 0


def test_stages_keep_columns_of_any_name(spark):
    names = "_counts _failed _pattern _quality _key _mark _position _mentions _row _new n_entities key a.b _source block".split()
    table = [(i, prose(i, 150), "ab"[i % 2]) for i in range(12)] + [(5, prose(5, 150), "b"), (None, None, None), (None, prose(99, 80), "a")]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in table], ["doc_id", "text", "source", *names])
    bench = spark.createDataFrame([(1, prose(3, 30))], "item_id long, text string")
    wanted = tuple(range(len(names)))
    for out in (quality.good_documents(docs), simhash.one_per_group(docs), dc.clean_documents(docs, bench), mixing.mixed(docs),
                surrogates.pseudonymized(docs).drop("n_entities_")):
        assert out.columns == docs.columns
        rows_ = out.collect()
        assert rows_ and {tuple(r)[3:] for r in rows_} == {wanted}
    assert 3 not in {r.doc_id for r in dc.clean_documents(docs, bench).collect()}
    assert sharding.shard_rows(docs).count() == len(table)


# --- sharding, mixing -----------------------------------------------------------------------------


def test_shuffle_parts_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    table = [(1, "same", "a")] * 60 + [(i, f"text {i}", "a") for i in range(2, 62)] + [(1, "same", None)] * 3
    docs = spark.createDataFrame(table, "doc_id long, text string, source string")
    out = sharding.shard_rows(docs, 1).orderBy("slot").collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter((r[0], r[2]) for r in table)
    order = [r.doc_id for r in out if r.source == "a"]
    assert sum(x == y == 1 for x, y in zip(order, order[1:], strict=False)) < 45


def test_shards(spark, docs):
    many = docs.unionByName(spark.range(1000, 1300).select(
        F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("source"), *(F.lit("z").alias(c) for c in ("_fp", "key", "shard", "host")),
    ))
    found = sharding.with_law(sharding.shard_rows(many)).collect()
    n = len(ROWS) + 300
    assert len(found) == n
    sizes = Counter(r["shard"] for r in found)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, size in sizes.items():
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(size))
        assert abs(sum(r["source"] == "hot" for r in found if r["shard"] == s) - 100 / n * size) < 2
    texts = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found if (r["doc_id"] or 0) < 1000) == texts
    assert {r["grown_shard"] for r in found} == {None}


def test_mixture_follows_the_weights(spark, docs):
    weights = {"a": 5.0, "b": 1.0, "c": 2.0, "d": 0.5, "e": 1.5, None: 3.0}
    found = mixing.mix(docs, weights, block_rows=2).collect()
    assert sorted(r["position"] for r in found) == list(range(len(found)))
    q, units = mixing.quantized({"n" if s is None else f"s{s}": w for s, w in weights.items()})
    at = sorted(found, key=lambda r: r["position"])
    for source, unit in q.items():
        own = None if source == "n" else source[1:]
        done = 0
        for slot in range(len(at) // 2):
            assert at[2 * slot]["source"] == at[2 * slot + 1]["source"]
            done += at[2 * slot]["source"] == own
            assert abs(done - (slot + 1) * unit / units) < 1
    for r in {r["key"] for r in found}:
        epochs = sorted(x["epoch"] for x in found if x["key"] == r)
        assert epochs[0] == 0
    assert {r["key"] for r in found} == {r[0] for r in docs.select(mixing.row_mark()).collect()}
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 1.0})


def test_pfair_period_meets_all_windows():
    q, units = mixing.quantized({"a": 3, "b": 1.7, "c": 0.01, "d": 9})
    assert sum(q.values()) == units
    slots = mixing.pfair_slots(q, units)
    for s, own in slots.items():
        for j, t in enumerate(own, 1):
            assert (j - 1) * units // q[s] <= t < -(-j * units // q[s])


def test_long_mixtures_stay_within_a_block_of_the_given_weights(spark):
    small = {f"s{i}": 2.0 / 57 for i in range(19)}
    weights = {"hot": 1 / 3, **small, "rare": 1 / 7000}
    done, total = Counter(), sum(weights.values())
    for t, (s, block) in enumerate(mixing.schedule(weights, {"hot": 30_000, "rare": 1, **dict.fromkeys(small, 1)}), 1):
        assert block == done[s]
        done[s] += 1
        if t % 97 == 0 or t > 89_000:
            assert all(abs(done[x] - t * w / total) < 1 + 1e-6 for x, w in weights.items()), t
    assert done["hot"] == 30_000
    table = spark.range(40_000).select("id", F.when(F.col("id") < 10, "rare").otherwise("hot").alias("source"))
    docs = table.select(F.col("id").alias("doc_id"), "source", F.lit("t").alias("text"))
    found = mixing.mix(docs, {"hot": 1.0, "rare": 0.0003}).groupBy("source").agg(F.countDistinct("slot").alias("n")).collect()
    blocks = {r["source"]: r["n"] for r in found}
    assert abs(blocks["rare"] - sum(blocks.values()) * 0.0003 / 1.0003) < 1
    with pytest.raises(ValueError):
        mixing.mix(docs, {"hot": 1.0, "rare": 0.0})


def test_mixed_documents_keep_columns_and_rows(docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert set(map(tuple, out.collect())) == set(map(tuple, docs.collect()))


# --- tokens, quality ----------------------------------------------------------------------------


def test_token_cache(spark, docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = ["a  b", "a \n b", " lead", "trail ", "x<|endoftext|> y", "don't  stop", "  q", "tab\tq r", "a　 b", "\n\n x"]
    many = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    whole = Tokenizer.from_file(path)
    want = sorted(((r[0], len((r[1] or "").encode()), len(whole.encode(r[1] or "", add_special_tokens=False).ids)) for r in many.collect()), key=repr)
    cache = str(tmp_path / "cache")
    assert rows(tokens.token_counts(many.where("doc_id < 9"), path, cache), "doc_id", "n_bytes", "n_tokens") == [w for w in want if w[0] and w[0] < 9]
    first = {r[0] for r in spark.read.parquet(cache).select(F.hex("digest")).collect()}
    assert rows(tokens.token_counts(many, path, cache), "doc_id", "n_bytes", "n_tokens") == want
    stored = [r[0] for r in spark.read.parquet(cache).select(F.hex("digest")).collect()]
    assert len(stored) == len(set(stored)) == many.select(F.coalesce("text", F.lit(""))).distinct().count() and first < set(stored)


def plain_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_quality_counts(docs):
    more = ["a\na\n\n \n a\na", "# * $ x|y <b> &&", "q r s q r s t q r s", "  \x1c x", "l\r\nl\r\nl"]
    for text in [r[1] for r in ROWS] + more:
        assert quality.text_counts(text or "")[:5] == plain_counts(text)
    found = {(r["doc_id"], r["n_words"]): r for r in quality.judged(docs).collect()}
    for d, text, _ in ROWS:
        c = plain_counts(text)
        r = found[d, c[0]]
        assert r["base_failed"] == (c[0] < 50 or 100 * c[4] > 50 * c[0])
        assert not (r["base_failed"] and r["kept"])


def test_accuracies_are_found_without_labels():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.85
    right_good, right_bad = np.array([0.95, 0.9, 0.8, 0.99]), np.array([0.9, 0.8, 0.7, 0.3])
    votes = np.where(rng.random((20_000, 4)) < np.where(truth[:, None], right_good, right_bad), truth[:, None] * 2, 2 - truth[:, None] * 2)
    votes[rng.random(votes.shape) < 0.2] = 1
    patterns, times = np.unique(votes @ 3 ** np.arange(4), return_counts=True)
    model = quality.fit(quality.votes_of(patterns, 4), times.astype(float))
    assert abs(model.prior - 0.85) < 0.04 and abs(model.right_good - right_good).max() < 0.04
    assert ((model.posterior(votes) >= 0.5) == truth).mean() > 0.9


def test_quality_agrees_with_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    found = quality.op6_weak_supervision(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "label"), "doc_id")
    seen = found.where("not base_failed").groupBy("label").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    share = {r["label"]: r["k"] for r in seen}
    assert share[1] > 0.99 and share[0] < 0.1


# --- decontamination -----------------------------------------------------------------------------


def test_changed_words_are_tolerated(spark):
    item = prose(50, 40)
    words = item.split()
    few = [w if i % 9 else "changed" for i, w in enumerate(words)]
    many = [w if i % 2 else "changed" for i, w in enumerate(words)]
    clean = prose(60, 300)
    table = [(1, clean), (2, f"{clean} {item.upper()}! {clean}"), (3, f"{' '.join(few)} {clean}"), (4, " ".join(many)), (5, None), (6, ""),
             (None, item), (7, "short item of five words"), (8, "an item of five words"), (9, item), (9, item)]
    docs = dc.keyed(spark.createDataFrame(table, "doc_id long, text string"))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "An item, of five words."), (5, "two words"), (6, item)], "item_id int, text string")
    found = docs.join(dc.contaminated(docs, bench), "key").select("doc_id", "item_id").distinct().collect()
    assert {tuple(r) for r in found} == {(d, i) for d in (2, 3, 9, None) for i in (1, 6)} | {(8, 4)}
    left = dc.clean_documents(docs.drop("key"), bench)
    assert sorted((r[0] for r in left.select("doc_id").collect()), key=repr) == [1, 4, 5, 6, 7]


def seeds_meet(words, copy):
    a, b = (np.array(x, np.uint64) for x in (words, copy))
    return any((dc.seeds(a, m)[: len(b)] == dc.seeds(b, m)).any() for m in dc.item_masks(len(a)))


def test_masks_hit_every_accepted_run_of_up_to_twenty_words():
    for size in range(dc.SHORT_ITEM, 21):
        words = list(range(size))
        for n in range(size // 5 + 1):
            for changed in itertools.combinations(range(size), n):
                copy = [w if w not in changed else 1000 + w for w in words]
                _, length, agree = dc.overlap(np.array(copy), np.array(words), 0)
                if agree >= min(dc.MIN_WORDS, -(-4 * size // 5)) and agree >= dc.MIN_SHARE * length:
                    assert seeds_meet(words, copy), (size, changed)


def test_runs_inside_longer_items_unspaced_scripts_and_short_items(spark):
    item, ten = prose(51, 40).split(), prose(52, 10).split()
    clean = prose(61, 90)
    chinese, thai = "水在一个大气压下的沸点是多少度？", "น้ำเดือดที่กี่องศา"
    ten_changed = [w if i not in (3, 6) else "changed" for i, w in enumerate(ten)]
    table = [(1, f"{clean} {' '.join(item[9:21])} {clean}"), (2, f"文章：“{chinese}”。完"), (3, f"บทความ {thai} จบ"), (4, f"{clean} Forty-two, «Zürich»! {clean}"),
             (5, clean), (6, "水在气压下"), (7, f"{clean} {' '.join(ten_changed)} {clean}"), (8, "forty zürich two")]
    docs = dc.keyed(spark.createDataFrame(table, "doc_id long, text string"))
    bench = spark.createDataFrame([(1, " ".join(item)), (2, chinese), (3, thai), (4, "forty two zürich"), (7, " ".join(ten)), (9, "?!")], "item_id int, text string")
    found = docs.join(dc.contaminated(docs, bench), "key").select("doc_id", "item_id").collect()
    assert {tuple(r) for r in found} == {(1, 1), (2, 2), (3, 3), (4, 4), (7, 7)}


def test_planted_benchmark_passages(spark):
    d, b = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").collect() for t in ("documents", "benchmark"))
    planted = {(x["doc_id"], i["item_id"]) for x in d for i in b if i["text"] in x["text"]}
    found = {(r["doc_id"], r["item_id"]) for r in dc.op7_spaced_seed_decontamination(spark, "/root/testdata/sf0.01").collect()}
    assert planted <= found and len(found) <= len(planted) + 5


# --- repeated substrings ---------------------------------------------------------------------------


def plain_removal(table):
    order = sorted(range(len(table)), key=lambda i: (table[i][0] is None, table[i][0] or 0))
    rank = {d: k for k, d in enumerate(dict.fromkeys(table[i][0] for i in order))}
    least = {}
    for d, t, *_ in table:
        b = (t or "").encode()
        for j in range(len(b) - 49):
            least[b[j : j + 50]] = min(least.get(b[j : j + 50], 10**9), rank[d])
    out = []
    for d, t, *_ in table:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if least[b[j : j + 50]] < rank[d]:
                gone[j : j + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeated_substrings(spark, docs, monkeypatch):
    passage, period = prose(70, 12), "ab" * 45
    extra = [(20, f"{prose(71, 30)}{passage}{prose(72, 30)}", "a"), (21, f"{prose(73, 9)}{passage[:60]}é{prose(74, 9)}", "a"), (22, period, "a"),
             (23, "zz" + period, "a"), (24, passage[5:56], "a"), (25, passage[5:54], "a"), (26, passage + passage, "a")]
    table = ROWS + extra
    many = docs.unionByName(spark.createDataFrame([(*r, "f", "k", "s", "h") for r in extra], SCHEMA))
    found = substrings.deduplicated(many, with_text=True)
    assert rows(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain_removal(table)
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in found.collect())
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("gleanflow_texts")]


def test_windows_of_one_anchor_hash_stay_apart(spark, monkeypatch):
    """Two texts whose 24-byte anchors differ but share 40 bits of hash, and no string of 50 bytes."""
    a = "gbevumnwquy31ocmda4qsau00qfbzhi9ezlrnrgd6seykczugzzx5odo5iz39ec1rnc77r7s36n2"
    b = "gbevumnwquy31ocmda4qsau00q4lllmpfgm0428zes0zc43chmzx5odo5iz39ec1rnc77r7s36n2"
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert rows(substrings.deduplicated(docs), "doc_id", "n_removed") == [(1, 0), (2, 0)]
    # Even where all windows share their hash.
    monkeypatch.setattr(substrings, "scrambled", lambda h: h * np.uint64(0) + np.uint64(1))
    body = np.frombuffer((a + b + a).encode(), np.uint8).reshape(3, 76).copy()
    full = np.full(3, 26, np.uint8)
    mask = substrings.late_windows(np.ones(3, np.uint64), body, full, full, np.array([1, 2, 3]))
    assert mask.tolist() == [0, 0, (1 << 27) - 1]


# --- surrogates --------------------------------------------------------------------------------------


def test_names_are_replaced_throughout(spark):
    table = [
        (1, "Mrs. Maria Keller came. Later Keller said that KELLER's car, not Maria's, was Keller-green; a keller is a cellar."),
        (2, "Mr 王小明 wrote; 王小明 signed."), (3, "On 2024-01-15, in 1999-2003, 10 000 000 000 or 12.34.56.78.90 or 12.05.2021, ISBN 9780306406157."),
        (4, "Call 030 901 820, 212-555-0147, (030) 12345 or 555-0147."),
    ]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    out = {r.doc_id: r for r in surrogates.pseudonymized(docs).collect()}
    assert "Keller" not in out[1].text and "KELLER" not in out[1].text and "Maria" not in out[1].text and "keller is a cellar" in out[1].text
    surname = re.search(r"Later (\w+) said", out[1].text)[1]
    assert f" {surname} came" in out[1].text and f"{surname.upper()}'s car" in out[1].text
    assert "王小明" not in out[2].text and re.search(r"Mr (\w+) wrote; \1 signed", out[2].text)
    assert out[3].text == table[2][1] and out[3].n_entities == 0
    assert out[4].n_entities == 4 and not re.search("901 820|555-0147|12345", out[4].text)



def test_surrogates(spark):
    card = "4539 5787 6362 1486"
    table = [
        (1, f"Write to Ann.Lee@Mail.example.com or +1 (974) 555-3436, card {card}.", "x"),
        (2, "ann.lee@mail.example.com again; call +1 974 555 3436. Mrs. Maria Keller and Keller. IP 192.168.3.4 and 8.8.4.4", "x"),
        (3, "Frau Keller wrote token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "x"), (4, None, "x"), (5, "", "x"), (6, "Plain words only, 2024.", "x"),
        (6, "Plain words only, 2024.", "x"), (None, "GB82 WEST 1234 5698 7654 32, Г-н Господин Иван Петров", "x"),
    ]
    docs = spark.createDataFrame(table, "doc_id long, text string, n_chars string")
    out = [tuple(r) for r in surrogates.pseudonymized(docs).collect()]
    text = {r[0]: r[1] for r in out}
    assert len(out) == len(table) and text[4] is None and text[5] == "" and text[6] == "Plain words only, 2024."
    for secret in ("Ann.Lee", "ann.lee", "974) 555-3436", "974 555 3436", card, "Keller wrote", "192.168.3.4", "8.8.4.4", "04dbebab", "WEST", "Петров"):
        assert not any(secret in (t or "") for t in text.values()), secret
    mail = re.search(r"to (\S+@\S+) or", text[1])[1]
    assert mail.lower() in text[2] and [c.isupper() for c in mail] == [c.isupper() for c in "Ann.Lee@Mail.example.com"]
    phone = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4})", text[1])
    assert " ".join(phone.groups()) in text[2]
    assert surrogates.luhn(re.search(r"card ([\d ]+)\.", text[1])[1].replace(" ", "")) and "192.168." in text[2]
    given, surname = re.search(r"Mrs\. (\w+) (\w+) and", text[2]).groups()
    assert surrogates.GENDER.get(given.lower(), "f") == "f" and f"Frau {surname} wrote" in text[3]
    account = re.match(r"GB[\w ]+", text[None])[0].replace(" ", "").strip()
    assert surrogates.mod97(account[:22]) == 1 and re.search(r"[а-я]{4,}$", text[None])
    assert sorted(r[3] for r in out if r[0] in (1, 4, 6)) == [0, 0, 0, 3]


@pytest.mark.parametrize("text", [
    "call 06 12 34 56 78 now", "+44 20 794 609 58", "555 123 456", "+4420794609", "“Mr Brown” said", "«Frau Keller»", "so—Anna Smith", "¿Juan Perez?",
    "token: abcdefghijklm", "Key = abcdefghijklm", "id a1bcdefabcdefabcdefabcdefabcdefa1", "id abcdefabcdefabcdefabcdefabcdef1a", "١٢٣-٤٥-٦٧٨٩",
    "4 5-3 9 5 7 8 7 6 3 6 2 1 4 8 6", "8.8.4.4", "GB82WEST12345698765432", "a@b.example", "Dr. Oswald", "_Mr Brown", "… Mary O’Neill",
])
def test_gate_passes_whatever_a_finder_matches(text):
    hit = any(finder.search(text) for finder in surrogates.FINDERS.values())
    assert hit == (text != "_Mr Brown") and (surrogates.may_hold(text) or not hit)


def test_grouped_numbers_and_quoted_names_are_replaced(spark):
    real = ["06 12 34 56 78", "+44 20 794 609 58", "555 123 456", "Brown"]
    docs = spark.createDataFrame([(i, f"“Mr {r}” said" if r == "Brown" else f"call {r} now") for i, r in enumerate(real)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in surrogates.pseudonymized(docs).collect()}
    assert all(out[i]["n_entities"] == 1 and r not in out[i]["text"] for i, r in enumerate(real))


def test_surrogates_stay_distinct(spark, monkeypatch):
    """Two-digit numbers as phones: draws collide with each other and with real ones, and end up one to one."""
    real = [f"555{n:04d}" for n in range(2000)]
    table = spark.createDataFrame([("phone", n, "555") for n in real], "kind string, norm string, detail string")
    found = surrogates.assigned(table).collect()
    new = [r["new"] for r in found]
    assert len(new) == len(set(new)) == 2000 and not set(new) & set(real)


# --- pages ----------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p><article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li><li>Two</li></ul></nav><div class="cookie-notice">We use cookies</div>
<aside>side</aside>{body}<section id="comments"><p>First!</p></section><form><label>mail</label><input></form>
<div class="ad">Buy</div><footer>&copy; x</footer></body></html>"""


def test_main_texts(spark):
    article = "<article><h1>Head &amp; tail</h1><p>One <b>two</b>\n three<br>four<p>Five&nbsp;six<!-- no --><div class='ad'>x</div></article>"
    plain = "<div class=story><p>{0} alpha beta gamma delta epsilon</p><p>{0} zeta eta theta iota</p></div>"
    pages = [
        (1, "http://a.example/1", PAGE.format(body=article)), (2, "http://A.example/2", PAGE.format(body=article.replace("</article>", ""))),
        *((10 + i, f"http://b.example/{i}", PAGE.format(body=plain.format(f"n{i}" * (i + 1)))) for i in range(5)),
        (20, "http://a.example/e", ""), (21, None, None), (22, "no url", "just text"), (22, "no url", "just text"),
        (23, "http://c.example/", "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>flat</p>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    text = {r["page_id"]: r["text"] for r in wrappers.main_texts(df).collect()}
    assert text[1] == "Head & tail\n\nOne two three four\n\nFive six"
    assert text[2].startswith(text[1]) or text[2].split("\n\n")[:3] == text[1].split("\n\n")
    for i in range(5):
        own = f"n{i}" * (i + 1)
        assert text[10 + i] == f"{own} alpha beta gamma delta epsilon\n\n{own} zeta eta theta iota"
    assert text[20] == text[21] == "" and text[22] == "just text" and text[23] == "deep\n\nflat"
    assert wrappers.main_texts(df).count() == len(pages)


def test_pages_of_the_table(spark):
    for r in wrappers.op9_wrapper_text(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet"), ["page_id", "url"]).collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
        want = [re.sub(r"\s+", " ", wrappers.entities.unescape(x)).strip() for x in parts]
        assert r["text"] == "\n\n".join(x for x in want if x) and r["n_chars"] == len(r["text"])


def test_wrappers_find_optional_and_repeated_groups():
    def pattern(body):
        return wrappers.skeleton(wrappers.parsed(body))

    one, two = pattern("<ul><li>a</li><li>b</li></ul><p>x</p>"), pattern("<ul><li>a</li></ul><h2>y</h2><p>x</p><p>z</p>")
    found = wrappers.aligned(one, two)
    assert found == [["ul", "1", [["li", "+", ["#"]]]], ["h2", "?", ["#"]], ["p", "+", ["#"]]]
    assert wrappers.aligned(found, one) == found


def test_many_skeletons_of_a_host_are_aligned_in_rounds(spark):
    def body(i):
        return "<main><div class=story><p>one</p><p>" + "words of it " * (i + 5) + "</p>" + "<h3>h</h3><ul></ul>" * (i % 7) + "<b></b><hr><table></table>" * (i % 5) + "</div></main>"

    pages = [(i, f"http://h{i % 2}.example/{i}", PAGE.format(body=body(i))) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = [{r["host"]: r for r in wrappers.wrappers(df, n).collect()} for n in (2, 3, 1000)]
    for each in found:
        assert {h: (r["pages"], r["region"]) for h, r in each.items()} == {
            f"h{k}.example": (30, "/html/body/main/div.story") for k in (0, 1)
        }


# --- revisits ----------------------------------------------------------------------------------------------


def test_revisits(spark):
    u, t = "http://a.example/x", "2024-01-01 00:00:{:02d}".format
    table = [
        (1, u, t(1), "response", {"ETag": "1", "X": "keep", "Date": "d1"}, "p1", "body1"), (2, u + "#frag", t(2), "revisit", {"etag": "1", "Date": "d2", "X": "no"}, None, None),
        (3, u, t(3), "response", {"ETag": "2", "Last-Modified": "m"}, "p2", "body2"), (4, u, t(3), "revisit", {"ETag": "1"}, "p1", None),
        (5, u, t(4), "revisit", {"ETag": "1"}, None, None), (6, u, t(5), "revisit", {"last-modified": "m"}, "p2", None), (7, u, t(5), "revisit", {"Last-Modified": "n"}, None, None),
        (8, u, t(6), "revisit", None, "p9", None), (9, u, t(0), "revisit", {}, None, None), (10, None, t(9), "revisit", {}, None, None),
        (11, u, None, "revisit", {}, None, None), (12, "HTTP://A.example:80/x", t(7), "revisit", {}, None, None), (13, u, t(8), "response", {}, None, None),
        (14, u, t(9), "revisit", {}, None, None),
    ]
    schema = "record_id long, url string, at string, kind string, headers map<string,string>, digest string, payload string"
    records = spark.createDataFrame(table, schema).withColumn("at", F.col("at").cast("timestamp"))
    found = {r["record_id"]: r for r in revisits.resolve(records).collect()}
    want = {2: ("resolved", 1, "body1"), 4: ("resolved", 1, "body1"), 5: ("etag", None, None), 6: ("resolved", 3, "body2"), 7: ("last_modified", None, None),
            8: ("digest", None, None), 9: ("no_response", None, None), 10: ("no_response", None, None), 11: ("no_response", None, None),
            12: ("resolved", 3, "body2"), 14: ("resolved", 13, None)}
    assert {k: (found[k]["outcome"], found[k]["refers_to"], found[k]["payload"]) for k in want} == want
    assert found[2]["headers"] == {"etag": "1", "x": "keep", "date": "d2"}
    assert found[1]["payload"] == "body1" and len(found) == len(table)


# --- pipeline ---------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    sf = SF
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("extra", F.lit(1))
    columns, seen = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    item = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        assert {r["doc_id"]: r["text"] for r in docs.collect()}.items() <= seen.items()
    ids = [r["doc_id"] for r in docs.collect()]
    assert len(ids) == len(set(ids)) and not any(i in seen[d] for d in ids for i in item)
    prints = [plain_fingerprint(seen[d]) for d in ids]
    assert not any((a ^ b).bit_count() <= 3 for i, a in enumerate(prints) for b in prints[:i])
    mix = corpus_pipeline.mix(spark, docs, sf)
    assert mix.columns == columns and {r["doc_id"] for r in mix.collect()} == set(ids)
    shards = corpus_pipeline.shard(spark, mix, sf).collect()
    assert len(shards) == mix.count()
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == set(ids)


# --- wrappers that decide ---------------------------------------------------------------------------------------


def test_deep_blocks_stay_apart_and_other_articles_stay_out(spark):
    deep = "<div>" * 200 + "<p>one</p><p>two <b>x</b></p>three" + "</div>" * 200
    texts = [prose(i, 60) for i in range(8)]
    rows = [(i, "http://h.example/", f"<body><article class='post main'><p>{t}</p></article><article class='teaser'><p>More</p></article></body>") for i, t in enumerate(texts)]
    rows += [(100, "http://deep.example/", deep), (101, "http://i.example/", "<div>" * 200 + "a <i>b</i> c" + "</div>" * 200)]
    pages = spark.createDataFrame([(*r, "w", "s") for r in rows], "page_id long, url string, html string, wrapper string, skeleton string")
    out = {r["page_id"]: r["text"] for r in wrappers.main_texts(pages).collect()}
    assert out[100] == "one\n\ntwo x\n\nthree" and out[101] == "a b c"
    assert [out[i] for i in range(8)] == texts


def test_wrappers_decide_pages_without_names(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")  # some forty pages a host
    plain = pages.withColumn("html", F.regexp_replace("html", r"<(/?)(article|main)\b", "<$1div"))
    assert plain.where(F.lower("html").contains("<article")).count() == 0
    assert rows(wrappers.main_texts(plain), "page_id", "text") == rows(wrappers.main_texts(pages), "page_id", "text")
    regions = {r["host"]: r["region"] for r in wrappers.wrappers(pages).collect()}
    for r in pages.select("html", wrappers.host("url").alias("host")).collect():
        tree = wrappers.parsed(r["html"])
        found = [b for n in wrappers.at_path(tree, regions[r["host"]]) for b in wrappers.blocks(n.children)]
        assert regions[r["host"]] and found  # the wrapper's region, not the page's own name


def test_constant_texts_do_not_make_a_region(spark):
    """The template says far more than the articles do, but says the same on every page."""
    legal = prose(1, 900)
    rows_ = [(i, "http://h.example/", f"<div class='top'><p>{legal}</p></div><div class='text'><p>{prose(i + 5, 40)}</p></div>") for i in range(60)]
    pages = spark.createDataFrame(rows_, "page_id long, url string, html string")
    assert wrappers.wrappers(pages).first()["region"].startswith("/div.text")
    assert {r["page_id"]: r["text"] for r in wrappers.main_texts(pages).collect()} == {i: prose(i + 5, 40) for i in range(60)}


def test_long_and_unlike_sibling_lists():
    long = [[f"m{i}", "1", []] for i in range(1500)]
    other = [[f"m{i}" if i % 3 else f"n{i}", "1", []] for i in range(1500)]
    found = wrappers.aligned(long, other)
    kept = {x[0]: x[1] for x in found}
    assert kept["m1"] == "1" and kept["m0"] == "?" and kept["n0"] == "?" and len(found) == 2000
    assert len(wrappers.aligned(long, [[f"x{i}", "1", []] for i in range(1500)])) == 3000
    group = [[f"g{i}", "1", []] for i in range(7)]
    assert [x[1] for x in wrappers.folded(group * 3)] == ["+"] * 7 and len(wrappers.folded(group * 40)) == 7
    assert wrappers.folded(["#", "#", "#"]) == ["#"] and wrappers.folded([]) == []
