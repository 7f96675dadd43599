"""Front matter grammar by example."""

import json

import pytest
from pyspark.sql import functions as F

from gleanflow.operators import frontmatter as fm


def document(*lines, body="Body text."):
    return "\n".join(["---", *lines, "---", body])


@pytest.fixture(scope="module")
def parse(spark):
    def run(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
        rows = (
            fm.parse_documents(df)
            .select("doc_id", "body", fm.leaves_json(F.col("leaves")).alias("data"), "error",
                    fm.document_tags(F.col("leaves")).alias("tags"))
            .orderBy("doc_id")
            .collect()
        )
        return rows

    return run


ACCEPTED = [
    (
        document("name: Grace Hopper", "draft: False", "n: -12", "ratio: 2.50", "empty:", "none: ~", "word: NULL", "exp: 1e3"),
        {"name": "Grace Hopper", "draft": False, "n": -12, "ratio": 2.5, "empty": None, "none": None, "word": "NULL", "exp": "1e3"},
    ),
    (document("tags:", "  - one", "  - two", "next: 1"), {"tags": ["one", "two"], "next": 1}),
    (document("tags:", "- one", "-", "- three", "next: 1"), {"tags": ["one", None, "three"], "next": 1}),
    (document('list: [a, "b, c", [1, 2]]', "map: {x: 1, 'y z': {k: v}}", "e: []", "f: {}"),
     {"list": ["a", "b, c", [1, 2]], "map": {"x": 1, "y z": {"k": "v"}}, "e": [], "f": {}}),
    (document("d: [a, [b, [c, [d, {e: [f, {g: [[]]}]}]]]]", "[[k: 1]]: v", "c: {[[a: 1]]: {b: {c: {d: x}}}}"),
     {"d": ["a", ["b", ["c", ["d", {"e": ["f", {"g": [[]]}]}]]]], "[[k: 1]]": "v", "c": {"[[a: 1]]": {"b": {"c": {"d": "x"}}}}}),
    (document("a: [x] [y, z]", "b: ['[', \"{,\", it's, x]", "c: [a}, b]"),
     {"a": ["x] [y", "z"], "b": ["[", "{,", "it's, x"], "c": ["a}, b"]}),
    (document("a:", "  b:", "    c: deep", "  d: 2", "e: 3"), {"a": {"b": {"c": "deep"}, "d": 2}, "e": 3}),
    (document("people:", "  - name: A", "    links:", "      - x", "  - name: B"),
     {"people": [{"name": "A", "links": ["x"]}, {"name": "B"}]}),
    (document("seq:", "  -", "    - in", "    - ner", "  -", "    k: v"), {"seq": [["in", "ner"], {"k": "v"}]}),
    (document("text: |", "  one", "", "    two", "  # three", "", "after: 1"), {"text": "one\n\n  two\n# three", "after": 1}),
    (document("text: >", "", "  one", "  two", "", "", "  three"), {"text": "one two\nthree"}),
    (document("people:", "  - bio: |-", "      long", "      text", "    age: 5"), {"people": [{"bio": "long\ntext", "age": 5}]}),
    (document("# only comment", "u: https://e.example/#x # gone", "q: 'a # b'", "h: a#b"),
     {"u": "https://e.example/#x", "q": "a # b", "h": "a#b"}),
    (document("s: 'it''s'", r'd: "tab\tnl\n\"q\" \\ \x \/"', 'e: ""', '"k: y": 1', "n: '3'"),
     {"s": "it's", "d": 'tab\tnl\n"q" \\ x /', "e": "", "k: y": 1, "n": "3"}),
    (document("t: a: b", "time: 12:30", "date: 2024-05-06"), {"t": "a: b", "time": "12:30", "date": "2024-05-06"}),
    (document("k: 1", "k: 2", "m:", "  x: 1", "m: last"), {"k": 2, "m": "last"}),
    ("---\r\na: 1\r\nb:\r\n  - x\r\n---\r\nBody text.", {"a": 1, "b": ["x"]}),
    ("---  \n\n---\nBody text.", {}),
    ("Body text.", {}),
    ("---\nnever closed", {}),
    (document("  a: 1", "  b: 2"), {"a": 1, "b": 2}),
    (document("p: [1, 2", "# no") .replace("[1, 2", "x [1, 2"), {"p": "x [1, 2"}),
]

REJECTED = {
    document("a: 1", "\tb: 2"): (2, "tab indentation is not supported, use spaces"),
    document("a: &x y"): (1, "YAML anchors and aliases are not supported"),
    document("a: [ok, *x]"): (1, "YAML anchors and aliases are not supported"),
    document("<<: base"): (1, "YAML merge keys are not supported"),
    document("? key"): (1, "complex mapping keys are not supported"),
    document("a: 1", "plain"): (2, 'expected "key: value", found "plain"'),
    document("- a"): (1, "the document must be a mapping, not a sequence"),
    document("a: [x"): (1, "unterminated inline sequence"),
    document("a: {x: 1"): (1, "unterminated inline mapping"),
    document("a: {x}"): (1, 'inline mapping entry "x" is missing a value'),
    document("a: 1", "  b: 2"): (2, "unexpected indentation"),
    document("  a: 1", "b: 2"): (2, "unexpected content after the mapping"),
    document("a: 1", "..."): (2, "multiple YAML documents are not supported"),
    document("'': 1"): (1, "empty mapping key"),
    document("a:", "  - x", "   - y"): (3, "unexpected indentation"),
    document("a: [b, {c: [1, {d: *x}]}]"): (1, "YAML anchors and aliases are not supported"),
    document("a: [[[1]]"): (1, "unterminated inline sequence"),
    document("a: [x, {b: 1]]"): (1, "unterminated inline mapping"),
    document("a: [[[{k}]]]"): (1, 'inline mapping entry "k" is missing a value'),
    document("a]: 1"): (1, 'expected "key: value", found "a]: 1"'),
}


def test_accepted(parse):
    for row, (text, want) in zip(parse([text for text, _ in ACCEPTED]), ACCEPTED, strict=True):
        assert row["error"] is None, text
        assert json.loads(row["data"]) == want, text
        if "Body" in text:
            assert row["body"] == "Body text."


def test_rejected(parse):
    for row, (text, want) in zip(parse(list(REJECTED)), REJECTED.items(), strict=True):
        assert row["error"] is not None, text
        assert tuple(row["error"]) == want, text
        assert row["data"] == "{}"


def test_tags(parse):
    texts = [
        document("tags: [b, a, b]", "tag: first"),
        document("tag:", "  - x", "  - 3", "tags: ' x '"),
        document("tags:", "  - k: v"),
        document("tags: true"),
    ]
    assert [row["tags"] for row in parse(texts)] == [["first", "b", "a"], ["x"], [], []]


def test_leaf_rows(spark):
    df = spark.createDataFrame([(1, document("a:", "  - n: 1", "b: x"))], "doc_id int, text string")
    rows = fm.frontmatter_leaves(df).orderBy("ordinal").collect()
    assert [tuple(r) for r in rows] == [
        (1, "a[0].n", 0, "1", "number", 2),
        (1, "b", 1, "x", "string", 3),
    ]


def test_sections_of_repeated_empty_and_late_keys(spark):
    def leaves(block):
        docs = spark.createDataFrame([(1, f"---\n{block}\n---\n")], "doc_id long, text string")
        return [(r["key_path"], r["value"], r["value_type"]) for r in fm.frontmatter_leaves(docs).orderBy("ordinal").collect()]

    assert leaves("a: 1\nb: 2\na: 3") == [("b", "2", "number"), ("a", "3", "number")]
    assert [p for p, _, _ in leaves("a:\n  x: 1\n  y: 2\nb: 1\na: []")] == ["b", "a"]
    assert [p for p, _, _ in leaves("a:\n  x: 1\n\"a\": {}\nb:")] == ["a", "b"]
    assert leaves("\n\n# c\na:\n- 1\n- 2\n\nb: |\n  # no comment\n\n  x\n# end\nc: ''") == [
        ("a[0]", "1", "number"), ("a[1]", "2", "number"), ("b", "# no comment\n\nx", "string"), ("c", "", "string"),
    ]
    assert leaves("  a: 1\n  b: 2") == [("a", "1", "number"), ("b", "2", "number")]


def test_cost_grows_with_the_lines(spark):
    import time

    def seconds(keys):
        block = "\n".join(f"key{i}: {i}" if i % 3 else f"map{i}:\n  sub: {i}" for i in range(keys))
        docs = spark.createDataFrame([(i, f"---\n{block}\n---\n") for i in range(8)], "doc_id long, text string").repartition(4)
        assert fm.frontmatter_leaves(docs).count() == 8 * keys
        start = time.perf_counter()
        fm.frontmatter_leaves(docs).count()
        return time.perf_counter() - start

    seconds(20)
    assert seconds(2000) < 12 * seconds(200)
