import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from evenkeel.functions import bind_override, match_labels, parse_quantity, plain_text, render_query, url_host
from evenkeel.schemas import quantise


@pytest.mark.parametrize("rounding", ["nearest", "up"])
def test_quantise(spark, rounding):
    cases = {1.0: "1", 1 / 3: "0.333333333", -2 / 3: "-0.666666667", 1e-10: "0", 0.1 + 0.2: "0.3"}
    if rounding == "up":
        cases |= {1 / 3: "0.333333334", 1e-10: "0.000000001", -1e-10: "-0.000000001", 0.1 + 0.2: "0.300000001"}
    df = spark.createDataFrame([(x,) for x in cases], "x double")
    got = {r.x: r.q for r in df.select("x", quantise(F.col("x"), rounding=rounding).alias("q")).collect()}
    assert got == {x: Decimal(t) for x, t in cases.items()}


def test_quantise_of_what_no_decimal_holds_is_null(spark):
    df = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,), (1e300,)], "x double")
    assert [r.q for r in df.select(quantise(F.col("x")).alias("q")).collect()] == [None] * 4


def test_quantise_ignores_noise_at_a_tie(spark):
    df = spark.createDataFrame([(0.1234565,), (0.12345649999999998,), (0.12345650000000001,)], "x double")
    assert {r.q for r in df.select(quantise(F.col("x"), 6).alias("q")).collect()} == {Decimal("0.123457")}


def test_parse_quantity(spark):
    cases = {
        "0": "0", "1": "1", "-3": "-3", "+2.5": "2.5", ".5": "0.5", "5.": "5", "1.5Ki": "1536", "2Ei": str(2 * 2**60),
        "1Mi": str(2**20), "100m": "0.1", "3n": "0.000000003", "7u": "0.000007", "1k": "1000", "2M": "2000000",
        "1G": str(10**9), "1T": str(10**12), "1P": str(10**15), "1E": str(10**18), "1E3": "1000", "1e-3": "0.001",
        "0.1n": "0.000000001", "-0.1n": "-0.000000001", "1.0000000001": "1.000000001",
    }
    bad = ["", "abc", "1 k", "1KiB", "k", "1e", "--1", "0x10", "1.2.3"]
    df = spark.createDataFrame([(t,) for t in [*cases, *bad]], "t string")
    got = {r.t: r.q for r in df.select("t", parse_quantity(F.col("t")).alias("q")).collect()}
    assert got == {**{t: Decimal(v) for t, v in cases.items()}, **{t: None for t in bad}}


def test_plain_text(spark):
    cases = {
        1.0: "1", 1e10: "10000000000", 1e-7: "0.0000001", -0.25: "-0.25", 123456.789: "123456.789",
        1e21: "1" + "0" * 21, 12345678.9: "12345678.9", 1234567890123456.7: "1234567890123456.8",
        -1.5e-9: "-0.0000000015", 2.0**-44: "0.00000000000005684341886080802", 9999999.0: "9999999",
    }
    df = spark.createDataFrame([(x,) for x in cases], "x double")
    assert {r.x: r.t for r in df.select("x", plain_text(F.col("x")).alias("t")).collect()} == cases


def test_match_labels(spark):
    df = spark.createDataFrame(
        [(1, {"a": "x", "b": "1"}), (2, {"a": "y"}), (3, {"b": "2"}), (4, {})], "id int, labels map<string,string>"
    )

    def ids(**how):
        return [r.id for r in df.where(match_labels(F.col("labels"), **how)).orderBy("id").collect()]

    assert ids() == [1, 2, 3, 4]
    assert ids(equals={"a": "x"}) == [1]
    assert ids(not_equals={"a": "x"}) == [2, 3, 4]
    assert ids(within={"a": ["x", "y"]}) == [1, 2]
    assert ids(without={"b": ["1", "2"]}) == [2, 4]
    assert ids(exists=["b"]) == [1, 3]
    assert ids(absent=["a", "b"]) == [4]
    assert ids(exists=["a"], not_equals={"a": "x"}) == [2]


def test_binding(spark):
    urls = {
        "https://kubernetes.default.svc": ("kubernetes.default.svc", "100.64.0.1:443"),
        "https://a.example.com:6443/x?y": ("a.example.com:6443", "a.example.com:6443"),
        "https://user:pw@b.example.com": ("b.example.com", "b.example.com"),
        "not a url": ("", ""),
    }
    host = url_host(F.col("u"))
    bound = bind_override(host, {"kubernetes.default.svc": "100.64.0.1:443"})
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", host.alias("h"), bound.alias("b"))
    assert {r.u: (r.h, r.b) for r in df.collect()} == urls


def test_render_query(spark):
    df = spark.createDataFrame([("1", "i", "ns", "n", "s")], "uid string, id string, namespace string, name string, server string")
    text = 'm{uid="{{ .uid }}",id="{{ .id }}",ns="{{ .namespace }}",n="{{ .name }}",s="{{ .server }}"}'
    assert df.select(render_query(text).alias("q")).first().q == 'm{uid="1",id="i",ns="ns",n="n",s="s"}'
