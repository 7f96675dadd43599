"""Null-safe errors, number text, hosts, and rejected pages."""

import pytest
from pyspark.sql import functions as F

from gleanflow.functions.urls import canonical_url
from gleanflow.operators import settings
from gleanflow.operators.frontmatter import _number_text
from gleanflow.plans import fixtures as fx
from gleanflow.plans.run import collect_web


def test_nulls_are_never_runnable(spark):
    rows = [("a", "web", True, None), ("b", None, True, "manual"), ("c", "web", None, "schedule"), ("d", "web", None, "manual"), (None, "web", False, "schedule"),
            ("e", "web", True, "schedule")]
    df = spark.createDataFrame(rows, "id string, connector string, enabled boolean, trigger string")
    known = spark.createDataFrame([("web",)], "id string")
    found = {r["id"]: r["error"] for r in settings.runnable(df, known).collect()}
    assert found == {"a": "Invalid trigger: null", "b": "Unknown connector: null", "c": "Connector instance is disabled: c",
                     "d": None, None: "Connector instance is disabled: null", "e": None}


def test_numbers_as_json_prints_them(spark):
    want = {"0.0005": "0.0005", "12345678.5": "12345678.5", "12345678901234567890": "12345678901234567000", "007": "7", "-1.50": "-1.5", "0.000001": "0.000001",
            "0.0000005": "5e-7", "1000000000000000000000": "1e+21", "-0.0": "0", "0.1": "0.1", "123.456789012345": "123.456789012345"}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r[0]: r[1] for r in df.select("t", _number_text(F.col("t"))).collect()} == want


def test_hosts(spark):
    want = {"http://10.0.0.1/a": "http://10.0.0.1/a", "http://xn--bcher-kva.example/": "http://xn--bcher-kva.example/",
            "http://256.1.1.1/": None, "http://1.2.3/": "http://1.2.0.3/", "http://0x7f.1/": "http://127.0.0.1/", "http://b\u00fccher.example/": "http://xn--bcher-kva.example/"}
    df = spark.createDataFrame([(k,) for k in want], "u string")
    assert {r[0]: r[1] for r in df.select("u", canonical_url(F.col("u"))["uri"]).collect()} == want


def test_bad_pages_fail_or_are_rejects(spark):
    responses = fx.responses(spark, "/root/testdata/sf0.001")
    bad = responses.limit(1).withColumn("url", F.lit("http://1.2.3.256/"))
    both = responses.unionByName(bad)
    with pytest.raises(ValueError, match="invalid host"):
        collect_web(both, fx.RUN)
    found = collect_web(both, fx.RUN, "quarantine")
    assert "http://1.2.3.256/" in {r["url"] for r in found.rejects.collect()}
