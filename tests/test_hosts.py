"""ASCII forms of international hosts against Python's codec."""

import random

from pyspark.sql import functions as F

from gleanflow.functions.hosts import ascii_host, punycode
from gleanflow.functions.urls import canonical_url

LETTERS = ["abcz09-", "àéîõüßøæœčřžğış", "αβγδέώς", "абвгдїёў", "אבגד", "ابتث", "あいうアイウー", "中文国日本語㐀", "한국어가힣", "աբգ", "აბგ"]


def test_punycode_equals_the_codec(spark):
    rng = random.Random(3)
    labels = ["".join(rng.choice(rng.choice([LETTERS[0], rng.choice(LETTERS[1:])])) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    labels += ["bücher", "münchen-ost", "ü", "üüü", "ü" * 60, "日本語", "例え", "\U00020000x", "a" * 50 + "é"]
    labels = sorted({w for w in labels if not w.isascii()})
    df = spark.createDataFrame([(w,) for w in labels], "w string").repartition(4)
    assert {r[0]: r[1] for r in df.select("w", punycode(F.col("w"))).collect()} == {w: w.encode("punycode").decode() for w in labels}


def test_hosts(spark):
    want = {
        "bücher.example": "xn--bcher-kva.example", "plain.example": "plain.example", "日本語。jp": "xn--wgv71a119e.jp", "a.ü.b": "a.xn--tda.b",
        "אבג.com": "xn--4dbcd.com", "אבג.3com": None, "אa.com": None, "ﬁx.example": None, "é.example": None, "ｆ.example": None, "☃.net": None,
        "ĳ.nl": None, "straße.de": "xn--strae-oqa.de", "": "", "xn--bcher-kva.de": "xn--bcher-kva.de",
    }
    df = spark.createDataFrame([(k,) for k in want], "h string")
    assert {r[0]: r[1] for r in df.select("h", ascii_host(F.col("h"))).collect()} == want


def test_urls_with_international_hosts(spark):
    want = {
        "https://BÜCHER.example:443/ä?ö#x": ("https://xn--bcher-kva.example/%C3%A4?%C3%B6", None), "http://b%C3%BCcher.example/": ("http://xn--bcher-kva.example/", None),
        "http://☃.net/": (None, "internationalized host"), "http://１.2.3.4/": (None, "internationalized host"), "http://ü x/": (None, "internationalized host"),
    }
    df = spark.createDataFrame([(k,) for k in want], "u string")
    assert {r[0]: tuple(r[1]) for r in df.select("u", canonical_url(F.col("u"))).collect()} == want
