"""Option rules and the capture contract."""

import json

import pytest
from pyspark.sql import functions as F

from gleanflow.operators import rules
from gleanflow.sources.responses import triage
from gleanflow.sources.submissions import address_submissions, legacy_entries, manual_captures, read_captures
from gleanflow.sources.web import web_captures, web_rejects
from gleanflow.contract import RunContext

OPTIONS = {
    "type": "object",
    "required": ["url"],
    "additionalProperties": False,
    "properties": {
        "url": {"type": "string", "format": "uri"},
        "branch": {"type": "string", "minLength": 2},
        "retries": {"type": ["integer", "null"]},
        "tags": {"type": "array", "minItems": 1, "items": {"type": "string"}},
        "level": {"enum": ["low", 3, None, {"a": 1}]},
        "nested": {
            "type": "object",
            "required": ["k"],
            "additionalProperties": False,
            "properties": {"k": {"type": "number"}},
        },
        "free": {"description": "anything"},
        "odd": {"type": "unheard-of"},
    },
}
GOOD = {"url": "https://e.example/x"}

CASES = [
    (GOOD, []),
    ({**GOOD, "retries": 3.0, "free": [1], "odd": 1, "level": 3}, []),
    ({**GOOD, "retries": 1e3, "level": None, "nested": {"k": 1.5}}, []),
    ({**GOOD, "level": {"a": 1}, "retries": None}, []),
    ({"branch": "main"}, ["config.url is required"]),
    ({"url": None}, ["url must be string, received null"]),
    ({"url": "no-uri"}, ["url must be a valid absolute URI"]),
    ({"url": "https://"}, ["url must be a valid absolute URI"]),
    ({"url": "mailto:x"}, []),
    ({**GOOD, "branch": "x"}, ["branch must be at least 2 character(s)"]),
    ({**GOOD, "retries": 1.5}, ["retries must be integer or null, received number"]),
    ({**GOOD, "tags": []}, ["tags must contain at least 1 item(s)"]),
    ({**GOOD, "tags": ["a", 7, None]}, ["tags[1] must be string, received number", "tags[2] must be string, received null"]),
    ({**GOOD, "tags": {"a": 1}}, ["tags must be array, received object"]),
    ({**GOOD, "level": "high"}, ['level must be one of "low", 3, null, {"a":1}']),
    ({**GOOD, "branchh": 1}, ['config.branchh is not a recognized option (did you mean "branch"?)']),
    ({**GOOD, "entirely_other": 1}, ["config.entirely_other is not a recognized option"]),
    ({**GOOD, "nested": {"q": 1}}, ["config.nested.k is required", 'config.nested.q is not a recognized option (did you mean "k"?)']),
    ({**GOOD, "nested": {"k": "1"}}, ["nested.k must be number, received string"]),
    ([], ["config must be object, received array"]),
    (None, ["config must be object, received null"]),
    ("text", ["config must be object, received string"]),
]


def test_option_errors(spark):
    df = spark.createDataFrame([(i, json.dumps(value)) for i, (value, _) in enumerate(CASES)], "i int, c string")
    checked = df.select("i", rules.option_errors(F.parse_json("c"), OPTIONS).alias("e"))
    for row in checked.orderBy("i").collect():
        assert row["e"] == CASES[row["i"]][1], CASES[row["i"]]


def test_rows_without_a_schema_pass(spark):
    df = spark.createDataFrame([('{"a":1}',)], "c string")
    assert df.select(rules.option_errors(F.parse_json("c"), True).alias("e")).first()["e"] == []


def test_suggestion_ties_go_to_the_first(spark):
    df = spark.createDataFrame([("ab",), ("zzzzzzz",)], "k string")
    got = [r[0] for r in df.select(rules.suggestion(F.col("k"), ["ax", "ay"])).collect()]
    assert got == [' (did you mean "ax"?)', ""]


CAPTURE = {
    "schema_version": "capture.v1", "id": "c1", "connector": "x", "instance_id": None, "run_id": None,
    "observed_at": "t", "captured_at": "t", "subject": {"kind": "anything", "uri": "u", "title": None, "url": None},
    "payload": {"kind": "odd", "text": None, "raw_ref": None, "content_hash": None, "mime_type": None},
    "note": None, "tags": ["a"], "metadata": {"deep": [1, {"x": None}]},
    "privacy": {"level": "public", "allow_cloud_llm": True},
    "provenance": {"trigger": "manual", "connector_version": "x@1", "cursor": None},
}


def broken(**changes):
    return {**CAPTURE, **changes}


CONTRACT = [
    (CAPTURE, None),
    (7, "Capture must be an object"),
    ([], "Unsupported capture schema"),
    (broken(schema_version="v0"), "Unsupported capture schema"),
    (broken(id=""), "Capture requires id, connector, observed_at, and captured_at"),
    (broken(observed_at=5), "Capture requires id, connector, observed_at, and captured_at"),
    (broken(subject={"kind": "", "uri": "u"}), "Capture requires subject.kind and subject.uri"),
    (broken(subject=None), "Capture requires subject.kind and subject.uri"),
    (broken(payload={}), "Capture requires payload.kind"),
    (broken(privacy={"level": ""}), "Capture requires privacy.level"),
    (broken(privacy={"level": "secret"}), "Capture privacy.level is invalid"),
    (broken(tags=["a", 1]), "Capture tags must be an array of strings"),
    (broken(tags="a"), "Capture tags must be an array of strings"),
    (broken(metadata=[]), "Capture metadata must be an object"),
]


def test_capture_contract(spark):
    texts = [json.dumps(value) for value, _ in CONTRACT] + ["{broken"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, value string")
    got = {r["i"]: r["problem"] for r in rules.capture_rejects(df, "i", "value").collect()}
    want = {i: problem for i, (_, problem) in enumerate(CONTRACT) if problem}
    assert got == {**want, len(CONTRACT): "not valid JSON"}


def test_import_envelope(spark):
    texts = [json.dumps(CAPTURE), json.dumps({"capture": CAPTURE, "outbox": {"status": "sent"}}), "[]"]
    rows = read_captures(spark.createDataFrame([(t,) for t in texts], "value string")).collect()
    assert [r["problem"] for r in rows] == [None, None, "Unsupported capture schema"]
    assert rows[0]["capture"] == rows[1]["capture"]
    assert json.loads(rows[0]["capture"]["metadata"]) == CAPTURE["metadata"]
    assert rows[2]["capture"] is None


def test_instances(spark):
    texts = ['{"id":" a ","connector":"web-page"}', '{"connector":"x"}', '{"id":"a"}', '{"id":"a","connector":"x","enabled":"yes"}',
             '{"id":"a","connector":"x","config":[]}', '{"id":"a","connector":"x","checkpoint":{"f":1},"schedule":null}', "[]"]
    rows = rules.normalize_instances(spark.createDataFrame([(t,) for t in texts], "value string")).collect()
    first = rows[0]
    assert (first["id"], first["enabled"], first["schedule"], first["config"], first["checkpoint"]) == ("a", True, None, "{}", None)
    for row, part in zip(rows[1:5], ("non-empty id", "requires a connector id", "non-boolean enabled", "non-object config")):
        assert part in row["problem"] and row["id"] is None
    assert rows[5]["checkpoint"] == '{"f":1}'
    assert rows[6]["problem"] == "connector instance must be an object"


def test_targets(spark):
    texts = ['{"id":"t","kind":"file","config":{"directory":" d "}}',
             '{"id":"t","kind":"webhook","config":{"url":"https://h","headers":{"a":"b","c":1},"timeout_ms":5,"include_privacy_levels":["sensitive","x"]}}',
             '{"id":"t","kind":"webhook","config":{"url":"https://h","include_privacy_levels":[]}}',
             '{"id":"t","kind":"file"}', '{"id":"t","kind":"ftp"}', '{"kind":"file"}']
    rows = rules.normalize_targets(spark.createDataFrame([(t,) for t in texts], "value string")).collect()
    assert (rows[0]["directory"], rows[0]["levels"]) == ("d", ["public", "private", "sensitive"])
    assert (rows[1]["headers"], rows[1]["timeout_ms"], rows[1]["levels"]) == ({"a": "b"}, 5.0, ["sensitive"])
    assert (rows[2]["timeout_ms"], rows[2]["levels"]) == (20000.0, ["public", "private"])
    assert [r["problem"] for r in rows[3:]] == [
        "file target requires config.directory",
        'delivery target "t" has an unknown kind; supported kinds are file, webhook',
        "delivery target requires a non-empty id",
    ]


def test_target_schemas(spark):
    df = spark.createDataFrame([('{"directory":"","extra":1}',)], "c string")
    errors = df.select(rules.option_errors(F.parse_json("c"), rules.TARGET_SCHEMAS["file"]).alias("e")).first()["e"]
    assert errors == ["config.extra is not a recognized option", "directory must be at least 1 character(s)"]


def test_manual_submissions(spark):
    rows = [("https://e.example", None), (None, " words "), (None, None), ("x", "y")]
    df = address_submissions(spark.createDataFrame(rows, "url string, text string"))
    got = df.collect()
    assert got[0]["uri"] == "https://e.example" and got[0]["problem"] is None
    assert got[1]["uri"].startswith("text://manual/") and len(got[1]["uri"]) == 14 + 64
    assert got[2]["problem"] == got[3]["problem"] == "capture requires exactly one of url or text"
    good = df.where("problem IS NULL")
    early, late = manual_captures(good, "t1").collect(), manual_captures(good, "t2").collect()
    assert [r["id"] for r in early] == [r["id"] for r in late]
    assert [(r["subject"]["kind"], r["payload"]["kind"], r["payload"]["text"]) for r in early] == [
        ("url", "reference", None), ("text", "text", "words"),
    ]
    assert early[1]["subject"]["url"] is None


def test_legacy_files(spark):
    rows = [("a.json", '{"status":"failed"}'), ("b.json", "{oops"), ("c.json", '{"status":"lost"}'), ("d.json.tmp", "{}")]
    got = legacy_entries(spark.createDataFrame(rows, "file_name string, value string")).collect()
    assert [tuple(r) for r in got] == [("a", "failed", True), ("b", "pending", False), ("c", "pending", True)]


def test_triage_texts(spark):
    schema = "url string, status int, body string, error_name string, error_message string, ratelimit_remaining string, ratelimit_reset string"
    rows = [
        ("u", 403, "", None, None, "0", "1900000000"), ("u", 403, "", None, None, "5", None), ("u", 404, "", None, None, None, None),
        ("u", None, None, "TypeError", "fetch failed", None, None), ("u", None, None, "AbortError", "x", None, None),
        ("u", 500, " x" * 150, None, None, None, None), ("u", 200, "{}", None, None, None, None), ("u", 200, "<", None, None, None, None),
    ]
    got = triage(spark.createDataFrame(rows, schema)).collect()
    assert [r["category"] for r in got] == ["rate_limit", "denied", "not_found", "network", "timeout", "http_error", "ok", "invalid_json"]
    assert "resets at 2030-03-17T17:46:40.000Z" in got[0]["message"] and "token_env" in got[0]["message"]
    assert got[4]["message"] == "Request to GitHub timed out after 20000ms: u"
    assert len(got[5]["message"].split(" — ")[1]) == 200
    assert got[6]["message"] is None


def test_web_source(spark):
    schema = "url string, status int, body string, content_type string, title string, tags array<string>, privacy_level string, instance_id string"
    rows = [
        (" https://E.example#x ", 200, "<title>T</title><p>hi</p>", "text/html", None, [" a", "a"], "odd", "i"),
        ("https://e.example/2", 200, "<p></p>", None, " Given ", None, "sensitive", "i"),
        ("https://e.example/3", 500, "x", None, None, None, None, "i"),
        ("ftp://e.example", 200, "x", None, None, None, None, "i"),
    ]
    responses = spark.createDataFrame(rows, schema)
    got = sorted(web_captures(responses, RunContext("r", "manual", "t")).collect(), key=lambda r: r["subject"]["uri"])
    first, second = got
    assert (first["subject"]["uri"], first["subject"]["url"], first["subject"]["title"]) == ("https://e.example/", "https://E.example#x", "T")
    assert (first["payload"]["kind"], first["payload"]["text"], first["tags"], first["privacy"]["level"]) == ("text", "T hi", ["a"], "private")
    assert json.loads(first["metadata"]) == {"status": 200, "content_length": 25}
    assert (second["payload"]["kind"], second["payload"]["text"], second["subject"]["title"], second["privacy"]["level"]) == (
        "reference", None, "Given", "sensitive",
    )
    assert {r["url"]: r["problem"] for r in web_rejects(responses).collect()} == {
        "https://e.example/3": "Web capture failed: HTTP 500 https://e.example/3",
        "ftp://e.example": "requires an http(s) config.url",
    }


def test_run_context():
    assert RunContext.start("schedule").run_id.startswith("run_")
    with pytest.raises(ValueError):
        RunContext.start("cron")
