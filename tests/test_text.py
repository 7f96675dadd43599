"""Text and URL columns on literal edge rows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gleanflow.functions import text as tx
from gleanflow.functions import urls

NBSP, BOM = chr(0xA0), chr(0xFEFF)


def values(spark, inputs, build):
    rows = [(i, value) for i, value in enumerate(inputs)]
    df = spark.createDataFrame(rows, "i int, c string").select("i", build(F.col("c")).alias("o"))
    return [row["o"] for row in df.orderBy("i").collect()]


def test_html_text(spark):
    pages = {
        "<p>a</p><SCRIPT type=x>var t='</p>';</SCRIPT><b>b</b>": "a b",
        "<noscript>no</noscript>x<style>p{}</style>y": "x y",
        "<scripted>kept</scripted>": "kept",
        "a&nbsp;b&amp;lt;c&#39;d&quot;e&copy;": "a b<c'd\"e&copy;",
        "&AMP;amp;lt; &amp;amp;lt;": "&amp;lt; &amp;lt;",
        "<script>open <p>tail": "open tail",
        "<!-- a > b --> c": "b --> c",
        f"a{NBSP}{BOM}  b\r\n\tc": "a b c",
        "": "",
    }
    assert values(spark, list(pages), tx.html_text) == list(pages.values())


def test_html_title(spark):
    pages = {
        "<TITLE lang=en> A <b>b</b>\n&amp; c </TITLE><title>second</title>": "A b & c",
        "<title></title>": None,
        "<title>   </title>": None,
        "no title": None,
    }
    assert values(spark, list(pages), tx.html_title) == list(pages.values())


def test_utf16_length_and_prefix(spark):
    face = chr(0x1F600)
    assert values(spark, ["", "abc", "é", face + "a"], tx.utf16_length) == [0, 3, 1, 3]
    assert values(spark, [face * 3, "abcdef"], lambda c: tx.utf16_prefix(c, 5)) == [face * 2, "abcde"]


def test_trim_and_null(spark):
    assert values(spark, [f" {BOM}a b{NBSP}\n", "  ", None], tx.blank_to_null) == ["a b", None, None]


def test_stable_id_is_prefix_and_twenty_hex(spark):
    want = "cap_" + hashlib.sha256("seed".encode()).hexdigest()[:20]
    assert values(spark, ["seed"], lambda c: tx.stable_id("cap", c)) == [want]


def test_seed_json_matches_compact_json(spark):
    texts = ['q"uo\\te', "line\nbreak\ttab", "\x1b\x0b\x0e\x00", "\\u001B stays", "\\\x1b", "é/ \x7f", None]

    def python_json(text):
        return json.dumps({"uri": text, "note": None}, ensure_ascii=False, separators=(",", ":"))

    got = values(spark, texts, lambda c: tx.seed_json(uri=c, note=F.lit(None).cast("string")))
    assert got == [python_json(text) for text in texts]


def test_tags(spark):
    df = spark.createDataFrame([([" b", "a", "b ", "", NBSP, "A"],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(tx.normalize_tags(F.col("t"))).collect()] == [["b", "a", "A"], []]


def test_slugs(spark):
    cases = {
        " Hello  World ": "hello-world",
        "C++ & C#": "c-c-",
        "-a--b-": "a-b",
        "Ärger.Über_~": "ärger.über_~",
        "日本 語": "日本-語",
        "!!!": "",
    }
    got = values(spark, list(cases), tx.slug)
    assert got == [want.rstrip("-") if text == "C++ & C#" else want for text, want in cases.items()]
    assert values(spark, ["A b//!!/c.md"], tx.slug_path) == ["a-b/c.md"]
    assert values(spark, ["posts/Nested/Second.MDOC", "posts/a.md.md"], lambda c: tx.document_slug(c, F.lit("posts"))) == [
        "nested/second",
        "a.md",
    ]


def test_canonical_url(spark):
    cases = {
        "HTTPS://Example.COM": "https://example.com/",
        "http://example.com:80/a#top": "http://example.com/a",
        "https://example.com:8443?x=1#f": "https://example.com:8443/?x=1",
        "https://u:p@example.com/a/./b/../c/": "https://u:p@example.com/a/c/",
        "https://example.com/../..": "https://example.com/",
        "https://example.com/a b?q=é x": "https://example.com/a%20b?q=%C3%A9%20x",
        "  https://example.com/%7e\n": "https://example.com/%7e",
    }
    hosts = {
        "xn--mnchen-3ya.example": "xn--mnchen-3ya.example",
        "ex%41mple.com": "example.com",
        "127.0.0.1": "127.0.0.1",
        "0x7f.1": "127.0.0.1",
        "0300.0250.1": "192.168.0.1",
        "2130706433": "127.0.0.1",
        "1.2.3.4.": "1.2.3.4",
        "0x": "0.0.0.0",
        "4294967295": "255.255.255.255",
        "a.1b": "a.1b",
        "[::1]": "[::1]",
        "[1:0:0:2:0:0:0:3]": "[1:0:0:2::3]",
        "[2001:DB8:0:0:1:0:0:1]": "[2001:db8::1:0:0:1]",
        "[1:0::]": "[1::]",
        "[0:0:0:0:0:0:0:0]": "[::]",
        "[::ffff:192.168.0.1]": "[::ffff:c0a8:1]",
        "[1:2:3:4:5:6:7::]": "[1:2:3:4:5:6:7:0]",
    }
    cases |= {f"http://{host}:81/": f"http://{want}:81/" for host, want in hosts.items()}
    assert values(spark, list(cases), lambda c: urls.canonical_url(c)["uri"]) == list(cases.values())
    wrong = ["256.1.1.1", "1.2.3.4.5", "08.1", "4294967296", "a.1", "1..2", "0x" + "f" * 30, "[1:2]", "[1::2::3]", "[::g]", "[::1.2.3.256]", "a%2Fb", "a|b"]
    issues = values(spark, [f"http://{host}/" for host in wrong], lambda c: urls.canonical_url(c)["issue"])
    assert issues == ["invalid host"] * len(wrong)
    bad = ["ftp://x/", "no url", "https://münchen.example/", "https://a.example:99999/", None]
    got = values(spark, bad, lambda c: urls.canonical_url(c)["issue"])
    assert got == [
        "unsupported scheme", "not an absolute URL", "internationalized host", "invalid port", "not an absolute URL",
    ]


def test_percent_encoding(spark):
    assert values(spark, ["a b/c~!*()'", "é+%", "x_y-z."], urls.encode_path) == [
        "a%20b/c~!*()'", "%C3%A9%2B%25", "x_y-z.",
    ]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://github.com/o/r.git", ("o", "r", None, None, None)),
        ("https://www.github.com/o/r/tree/main/src/a", ("o", "r", "main", "src/a", None)),
        ("https://github.com/o/r/tree/v%2F1+0/", ("o", "r", "v/1+0", None, None)),
        ("https://github.com/o", (None,) * 4 + ("repository_url must include owner and repository",)),
        ("https://github.com/o/.git", (None,) * 4 + ("repository_url must include owner and repository",)),
        ("http://github.com/o/r", (None,) * 4 + ("x repository_url must point to github.com",)),
        ("https://github.com/o/r/blob/a", (None,) * 4 + ("repository_url must point to a repository or tree URL",)),
        ("nonsense", (None,) * 4 + ("x repository_url must be a valid URL",)),
    ],
)
def test_repository_url(spark, url, want):
    assert tuple(values(spark, [url], lambda c: urls.parse_repository_url(c, "x"))[0]) == want


def test_content_dir(spark):
    got = values(spark, ["/a/b/", " x ", "", "a/../b", "a..b"], lambda c: urls.normalize_content_dir(c)["content_dir"])
    assert got == ["a/b", "x", None, None, "a..b"]


def test_trailing_slashes(spark):
    assert values(spark, ["https://s.example//", " ", None], urls.trim_trailing_slash) == ["https://s.example", None, None]
