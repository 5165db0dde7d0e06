from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import evaluate, validate
from evenkeel.operators.poll import metric_vectors
from evenkeel.plans.pipeline import Pipeline, keep_raw, observation
from evenkeel.schemas import SAMPLES
from evenkeel.sources import MetricDef, Strategy, default_strategy

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
AS_OF = T0 + timedelta(hours=2)
SHARDS = "ref string, uid string, id string, namespace string, name string, server string"


def cluster_samples(spark, levels, names, missing=()):
    """Gauges at a level per server and counters growing by it each minute, from two pods."""
    rows = []
    for server, level in levels.items():
        host = server.split("://")[1]
        for metric, kind, label in names:
            if (server, metric) in missing:
                continue
            value = host if label == "host" else server
            for pod, share in (("p1", 1.0), ("p2", 0.5)):
                for minute in range(50, 121):
                    v = level * share * (minute if kind == "counter" else 1)
                    for second in (0, 30):
                        ts = T0 + timedelta(minutes=minute, seconds=second)
                        grown = v + (level * share * second / 60 if kind == "counter" else 0)
                        rows.append((metric, {"namespace": "ns", "pod": pod, label: value}, ts, grown))
    return spark.createDataFrame(rows, SAMPLES)


def test_default_strategy_end_to_end(spark):
    strategy = default_strategy()
    names = [(m.sample, m.kind, m.label) for m in strategy.metrics]
    levels = {f"https://c{i}.example.com:6443": float(i) for i in range(1, 6)}
    shards = spark.createDataFrame([("ns/default", f"u{i}", f"c{i}", "ns", f"c{i}", s) for i, s in enumerate(levels, 1)], SHARDS)
    samples = cluster_samples(spark, levels, names, missing={("https://c1.example.com:6443", "app_k8s_request_total")})
    run = Pipeline(strategy).run(shards, samples, AS_OF)
    polled = {(r.metric_id, r.shard.uid): float(r.value) for r in run.metric_values.collect()}
    assert len(polled) == 35
    for m in strategy.metrics:
        for i in range(1, 6):
            # per minute two samples half a minute apart: the growth seen inside is half a step
            want = i if m.kind == "gauge" else i / 2
            if (m.id, i) == ("app_k8s_request_total", 1):
                want = 0
            assert polled[(m.id, f"u{i}")] == pytest.approx(want, abs=1e-8), (m.id, i)
    loads = {r.shard.uid: float(r.value) for r in run.load_indexes.collect()}
    assert sorted(loads, key=loads.get) == ["u1", "u2", "u3", "u4", "u5"]
    assert len(run.assignments.collect()) == 5
    assert {(r.stage, r.ready) for r in run.status.collect()} == {(s, True) for s in ("poll", "normalize", "load_index", "partition")}
    # the elected plan of a first observation is the plan itself
    elected = evaluate.replay(observation(run, AS_OF), Pipeline(strategy).periods()).first()
    assert elected.promoted and elected.elected == run.identity.first().plan_hash


def test_one_bad_ref_fails_alone(spark):
    strategy = Strategy((MetricDef("up"),), {"up": "1"})
    levels = {"https://a": 1.0, "https://b": 2.0}
    rows = [(ref, u, u, "ns", u, s) for ref, u, s in (("good", "a", "https://a"), ("good", "b", "https://b"), ("bad", "a", "https://a"), ("bad", "c", "https://c"))]
    shards, samples = spark.createDataFrame(rows, SHARDS), cluster_samples(spark, levels, [("up", "gauge", "server")])
    run = Pipeline(strategy).run(shards, samples, AS_OF)
    assert {r.ref for r in run.assignments.collect()} == {"good"}
    status = {(r.stage, r.ref): (r.ready, r.reason) for r in run.status.collect()}
    assert status[("poll", "bad")] == (False, "PollingError") and status[("poll", "good")] == (True, "Ready")
    assert status[("normalize", "bad")] == (False, "MetricValuesProviderNotReady")
    assert status[("partition", "bad")] == (False, "LoadIndexProviderNotReady")
    with pytest.raises(Exception, match="no data"):
        Pipeline(strategy, check=validate.raise_on_violation).run(shards, samples, AS_OF)


def test_stages_can_be_exchanged(spark):
    strategy = Strategy((MetricDef("up"),), {"up": "2"}, max_shards_per_replica=1)
    levels = {f"https://{i}": float(i) for i in range(1, 4)}
    shards = spark.createDataFrame([("r", s[8:], s[8:], "ns", s[8:], s) for s in levels], SHARDS)
    samples = cluster_samples(spark, levels, [("up", "gauge", "server")])
    run = Pipeline(strategy, normalizer=keep_raw).run(shards, samples, AS_OF)
    assert {r.shard.uid: float(r.value) for r in run.load_indexes.collect()} == {"1": 2.0, "2": 4.0, "3": 6.0}
    reversed_ids = Pipeline(strategy, normalizer=keep_raw, partitioner=lambda l, s: l.withColumn("replica_id", F.lit(0)).select("ref", "replica_id", "shard", "value", "display_value"))
    assert [r.replicas for r in reversed_ids.run(shards, samples, AS_OF).identity.collect()] == [1]


def test_metrics_may_share_their_samples(spark):
    strategy = Strategy((MetricDef("up"), MetricDef("by_pod", sample="up", label="pod", bind=lambda: F.lit("p2"))), {"up": "1"})
    samples = cluster_samples(spark, {"https://a": 4.0}, [("up", "gauge", "server")])
    out = metric_vectors(samples, strategy, AS_OF)
    assert {(r.metric_id, r.namespace, r.bound, r.value) for r in out.collect()} == {
        ("up", "ns", "https://a", 4.0), ("by_pod", "ns", "p1", 4.0), ("by_pod", "ns", "p2", 2.0),
    }


def test_contracts_are_checked(spark):
    strategy = Strategy((MetricDef("up"),), {"up": "1"})
    shards = spark.createDataFrame([("r", "u", "u", "ns", "u", "https://k")], SHARDS)
    samples = cluster_samples(spark, {"https://k": 1.0}, [("up", "gauge", "server")])
    with pytest.raises(ValueError, match="normalized: metric_id is missing, value is double"):
        broken = Pipeline(strategy, normalizer=lambda v, s: v.drop("metric_id").withColumn("value", F.lit(1.0)))
        broken.run(shards, samples, AS_OF)


def test_one_shard_one_metric(spark):
    """One shard with one metric: scaled to 0, load 0, replica 0."""
    strategy = Strategy((MetricDef("up"),), {"up": "1"})
    shards = spark.createDataFrame([("r", "u", "in-cluster", "ns", "in-cluster", "https://k")], SHARDS)
    run = Pipeline(strategy).run(shards, cluster_samples(spark, {"https://k": 1.0}, [("up", "gauge", "server")]), AS_OF)
    row = run.assignments.first()
    assert (row.replica_id, float(row.value), run.normalized.first().display_value) == (0, 0.0, "0")
