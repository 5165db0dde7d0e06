from datetime import datetime, timedelta, timezone

import pytest
from conftest import metric_values
from pyspark.sql import functions as F

from evenkeel.operators import poll, validate
from evenkeel.sources import MetricDef
from evenkeel.sources.strategy import Strategy

SHARDS = "ref string, uid string, id string, namespace string, name string, server string"


def shards(spark, uids=("a", "b")):
    return spark.createDataFrame([("r", u, f"id-{u}", "ns", u, f"https://{u}.example.com") for u in uids], SHARDS)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "metric_id string, namespace string, bound string, value double")


METRICS = (
    MetricDef("cpu", 'cpu{server="{{ .server }}"}'),
    MetricDef("mem", 'mem{name="{{ .name }}"}', no_data="0.5", bind=lambda: F.col("name")),
)


def test_every_metric_for_every_shard(spark):
    found = vectors(spark, [("cpu", "ns", "https://a.example.com", 1.5), ("cpu", "ns", "https://b.example.com", 2.0), ("mem", "ns", "a", 7.0), ("mem", "elsewhere", "b", 9.0)])
    out = poll.poll(shards(spark), METRICS, found).collect()
    got = {(r.metric_id, r.shard.uid): (float(r.value), r.query, r.display_value, r.samples) for r in out}
    assert got == {
        ("cpu", "a"): (1.5, 'cpu{server="https://a.example.com"}', "1.5", 1),
        ("cpu", "b"): (2.0, 'cpu{server="https://b.example.com"}', "2", 1),
        ("mem", "a"): (7.0, 'mem{name="a"}', "7", 1),
        ("mem", "b"): (0.5, 'mem{name="b"}', "0.5", 0),
    }


def test_rules_of_a_poll(spark):
    found = vectors(spark, [("cpu", "ns", "https://a.example.com", 1.0), ("cpu", "ns", "https://a.example.com", 2.0), ("mem", "ns", "a", float("inf"))])
    polled = poll.poll(shards(spark), METRICS, found)
    messages = sorted(r.message for r in validate.poll_violations(polled).collect())
    assert messages == [
        'more than one sample: 2, query:\ncpu{server="https://a.example.com"}',
        'no data, query:\ncpu{server="https://b.example.com"}',
        'not a finite value, query:\nmem{name="a"}',
    ]
    assert {r.reason for r in validate.poll_violations(polled).collect()} == {"PollingError"}


AS_OF = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)


@pytest.mark.parametrize(
    "age, shards_now, metrics_now, stale, reason",
    [
        (None, ["a"], ["m"], True, "NeverPolled"),
        (30, ["a"], ["m"], False, "Fresh"),
        (60, ["a"], ["m"], True, "PeriodElapsed"),
        (30, ["a", "b"], ["m"], True, "ShardsChanged"),
        (30, [], ["m"], True, "ShardsChanged"),
        (30, ["a"], ["m", "n"], True, "MetricsChanged"),
        (30, ["a", "a"], ["m", "m"], False, "Fresh"),
    ],
)
def test_stale_refs(spark, age, shards_now, metrics_now, stale, reason):
    last = None if age is None else AS_OF - timedelta(seconds=age)
    out = poll.stale_refs(
        spark.createDataFrame([("r", 60, last)], "ref string, period_s int, last_poll timestamp"),
        spark.createDataFrame([("r", u) for u in shards_now], "ref string, uid string"),
        spark.createDataFrame([("r", m) for m in metrics_now], "ref string, metric_id string"),
        spark.createDataFrame([("r", "a", "m")], "ref string, uid string, metric_id string"),
        F.lit(AS_OF),
    ).first()
    assert (out.stale, out.reason) == (stale, reason)
    assert out.remaining_s == (30 if reason == "Fresh" else 0)


def test_duplicate_ids(spark):
    ids = spark.createDataFrame([("r", "a"), ("r", "a"), ("r", "b"), ("q", "a")], "ref string, metric_id string")
    out = validate.duplicate_ids(ids, "poll", validate.MALFORMED_POLL).collect()
    assert [tuple(r) for r in out] == [("poll", "r", "MalformedResource", "duplicate id a")]


def test_weighted_metric_must_occur_once(spark):
    rows = [("r", "a", "s1", 1.0), ("r", "b", "s1", 1.0), ("r", "a", "s2", 1.0), ("r", "a", "s2", 1.0), ("r", "c", "s3", 1.0), ("q", "a", "s1", 1.0), ("q", "b", "s1", 1.0), ("q", "c", "s1", 1.0), ("q", "c", "s1", 1.0)]
    values = metric_values(spark, rows)
    want = {
        ("r", f"metric {m} must occur once in shard {s}")
        for m, s in (("a", "s2"), ("b", "s2"), ("a", "s3"), ("b", "s3"))
    }
    out = validate.metric_exactly_once(values, {"a": "1", "b": "1"})
    assert {(r.ref, r.message) for r in out.collect()} == want
    table = spark.createDataFrame([("q", "c", 1.0)], "ref string, metric_id string, weight double")
    out = validate.metric_exactly_once(values, table).collect()
    assert [(r.ref, r.message) for r in out] == [("q", "metric c must occur once in shard s1")]


def test_failed_refs_fail_alone(spark):
    values = metric_values(spark, [("good", "a", "s", 1.0), ("bad", "a", "s", float("nan")), ("bad", "b", "s", 1.0)])
    broken = validate.not_finite(values, "normalize", validate.NORMALIZATION_ERROR)
    assert {r.ref for r in validate.drop_failed(values, broken).collect()} == {"good"}
    status = validate.stage_status(values, broken, "normalize")
    assert {r.ref: (r.ready, r.reason) for r in status.collect()} == {"good": (True, "Ready"), "bad": (False, "ErrorDuringNormalization")}
    assert {r.ref for r in validate.require_ready(values, status).collect()} == {"good"}
    refs = spark.createDataFrame([("good",), ("bad",), ("absent",)], "ref string")
    waiting = validate.not_ready(refs, status, "load_index").collect()
    assert {(r.ref, r.ready, r.reason) for r in waiting} == {(x, False, "MetricValuesProviderNotReady") for x in ("bad", "absent")}
    assert validate.raise_on_violation(values.where("ref = 'good'"), broken).count() == 1
    with pytest.raises(Exception, match="not a finite value"):
        validate.raise_on_violation(values, broken).collect()


def test_matchers_choose_the_samples(spark):
    at = datetime(2024, 1, 1, 1, tzinfo=timezone.utc)
    schema = "metric string, labels map<string,string>, ts timestamp, value double"
    rows = [("up", {"namespace": "ns", "pod": "p", "server": "s", "job": job}, at, value) for job, value in (("own", 1.0), ("other", 100.0))]
    samples = spark.createDataFrame(rows, schema)
    for matchers, wanted in (({}, 101.0), ({"equals": {"job": "own"}}, 1.0), ({"not_equals": {"job": "own"}}, 100.0), ({"within": {"job": ["own", "x"]}}, 1.0)):
        strategy = Strategy((MetricDef("up", **matchers),), {"up": "1"}, window_seconds=60)
        assert [r.value for r in poll.metric_vectors(samples, strategy, at).collect()] == [wanted]
    both = Strategy((MetricDef("a", sample="up", equals={"job": "own"}), MetricDef("b", sample="up")), {}, window_seconds=60)
    assert {r.metric_id: r.value for r in poll.metric_vectors(samples, both, at).collect()} == {"a": 1.0, "b": 101.0}
