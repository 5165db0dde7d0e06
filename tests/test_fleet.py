"""Many strategies as tables: matchers by counting, one scan, a status for each ref."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from test_pipeline import SHARDS, cluster_samples

from evenkeel.functions.labels import match_labels
from evenkeel.operators import fleet, packing
from evenkeel.operators.poll import metric_vectors
from evenkeel.plans.pipeline import Pipeline
from evenkeel.schemas import SAMPLES
from evenkeel.sources import MetricDef, Strategy, append_series, open_series, series_of, strategy_tables
from evenkeel.sources.series import qualifying
from evenkeel.sources.strategies import MATCHERS, METRICS, SETTINGS, WEIGHTS, StrategyTables
from evenkeel.stages import publish
from conftest import loads

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
AS_OF = T0 + timedelta(hours=2)
NAMES = [("up", "gauge", "server"), ("grown", "counter", "server")]


@pytest.fixture(scope="module")
def samples(spark):
    levels = {f"https://s{i}": float(i) for i in range(1, 5)}
    extra = [("up", {"namespace": "ns", "pod": "p9", "server": "https://s1", "job": "other"}, AS_OF, 50.0), ("up", None, AS_OF, 1.0)]
    return cluster_samples(spark, levels, NAMES).unionByName(spark.createDataFrame(extra, SAMPLES))


@pytest.fixture(scope="module")
def store(spark, samples, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("series") / "store")
    early = samples.where(F.col("ts") < F.lit(T0 + timedelta(hours=1)))
    append_series(early, path)
    append_series(samples.where(F.col("ts") >= F.lit(T0 + timedelta(hours=1))), path)
    return open_series(spark, path)


def test_series_are_listed_once(store, samples):
    series = samples.select("metric", F.to_json("labels").alias("l")).distinct().count()
    assert store.series.count() == series == store.series.select("sid").distinct().count()
    assert store.samples.count() == samples.count()
    assert "labels" not in store.samples.columns
    listing = store.listing.collect()
    assert len(listing) == len({(r.metric, r.term, bytes(r.sid)) for r in listing})


@pytest.mark.parametrize(
    "rows,matchers",
    [
        ([("pod", "=", "p1")], {"equals": {"pod": "p1"}}),
        ([("pod", "!=", "p1")], {"not_equals": {"pod": "p1"}}),
        ([("pod", "in", "p1"), ("pod", "in", "p9"), ("server", "=", "https://s1")], {"equals": {"server": "https://s1"}, "within": {"pod": ["p1", "p9"]}}),
        ([("pod", "not_in", "p1"), ("pod", "not_in", "p9")], {"without": {"pod": ["p1", "p9"]}}),
        ([("job", "exists", None)], {"exists": ["job"]}),
        ([("job", "absent", None), ("pod", "=", "p1"), ("pod", "=", "p1")], {"equals": {"pod": "p1"}, "absent": ["job"]}),
        ([("pod", "=", "p1"), ("pod", "=", "p2")], {"within": {"pod": []}}),
        ([], {}),
    ],
)
def test_matchers_as_rows_are_those_as_columns(spark, store, rows, matchers):
    tables = StrategyTables(
        spark.createDataFrame([], SETTINGS),
        spark.createDataFrame([("r", "m", "up", "gauge", "server", "server", None, None)], METRICS),
        spark.createDataFrame([("r", "m", *row) for row in rows], MATCHERS),
        spark.createDataFrame([], WEIGHTS),
    )
    got = {bytes(r.sid) for r in qualifying(store.listing, tables.conditions()).collect()}
    labels = F.coalesce("labels", F.create_map().cast("map<string,string>"))
    wanted = store.series.where("metric = 'up'").where(match_labels(labels, **matchers))
    assert got == {bytes(r.sid) for r in wanted.collect()}


STRATEGIES = {
    "a": Strategy((MetricDef("up"), MetricDef("more", sample="grown", kind="counter")), {"up": "1", "more": "500m"}),
    "b": Strategy(
        (MetricDef("up", not_equals={"pod": "p2"}, no_data="0"), MetricDef("more", sample="grown", kind="counter", within={"pod": ["p1"]})),
        {"up": "2", "more": "1"}, p=2, epsilon=None, step_seconds=300, range_seconds=600, window_seconds=1800, lookback_seconds=900,
        quantile=0.5, extrapolate=True, max_shards_per_replica=1,
    ),
}


def test_vectors_of_many_strategies_are_those_of_each(spark, samples, store):
    found = fleet.fleet_vectors(store, strategy_tables(spark, STRATEGIES), AS_OF)
    got = {(r.ref, r.metric_id, r.bound): r.value for r in found.where("bound IS NOT NULL").collect()}
    plain = samples.where("labels IS NOT NULL")
    for ref, strategy in STRATEGIES.items():
        one = {(ref, r.metric_id, r.bound): r.value for r in metric_vectors(plain, strategy, AS_OF).collect()}
        assert one and {k: v for k, v in got.items() if k[0] == ref} == pytest.approx(one)


def test_one_scan_and_no_labels_in_a_shuffle(spark, store):
    tables = strategy_tables(spark, STRATEGIES)
    used = fleet.uses(store, tables)
    readings = used.select("metric", "sid", *fleet.READING).distinct()
    text = fleet.reading_vectors(store.samples, readings, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert len([line for line in text.split("\n") if "FileScan parquet" in line and "ts#" in line]) == 1, text
    assert not [line for line in text.split("\n") if "Exchange" in line and "labels" in line]


def fleet_shards(spark, refs):
    rows = [(ref, f"u{i}", f"c{i}", "ns", f"c{i}", f"https://s{i}") for ref in refs for i in range(1, 4)]
    return spark.createDataFrame(rows, SHARDS)


def test_a_run_of_many_strategies(spark, samples, store):
    refs = ["a", "b", "twice", "heavy", "flat", "kept"]
    shards = fleet_shards(spark, refs)
    more = {r: STRATEGIES["a"] for r in refs[2:]}
    tables = strategy_tables(spark, {**STRATEGIES, **more})
    metrics = tables.metrics.unionByName(tables.metrics.where("ref = 'twice' AND metric_id = 'up'"))
    weights = tables.weights.unionByName(tables.weights.where("ref = 'heavy' AND metric_id = 'up'"))
    settings = tables.settings.withColumn("p", F.when(F.col("ref") == "flat", -1.0).otherwise(F.col("p")))
    tables = StrategyTables(settings, metrics, tables.matchers, weights)
    previous = spark.createDataFrame(
        [("kept", m, (f"u{i}", f"c{i}", "ns", f"c{i}", f"https://s{i}"), "", float(i * 10), str(i)) for m in ("up", "more") for i in range(1, 4)],
        "ref string, metric_id string, shard struct<uid:string,id:string,namespace:string,name:string,server:string>, query string, value double, display_value string",
    ).withColumn("value", F.col("value").cast("decimal(38,9)"))
    polls = spark.createDataFrame([("kept", AS_OF - timedelta(seconds=30)), ("a", AS_OF - timedelta(seconds=61))], "ref string, last_poll timestamp")
    run = Pipeline(tables).run(shards, store, AS_OF, polls, previous)
    status = {(r.stage, r.ref): (r.ready, r.reason) for r in run.status.collect()}
    assert len(status) == run.status.count() == 4 * len(refs)
    assert status["poll", "twice"] == (False, "MalformedResource") and status["normalize", "twice"] == (False, "MetricValuesProviderNotReady")
    for ref in ("heavy", "flat"):
        assert status["normalize", ref] == (True, "Ready") and status["load_index", ref] == (False, "WeightsMalformed")
        assert status["partition", ref] == (False, "LoadIndexProviderNotReady")
    assert all(status["partition", ref] == (True, "Ready") for ref in ("a", "b", "kept"))
    assert {(r.ref, r.reason) for r in run.gate.where("NOT stale OR ref = 'a'").collect()} == {("kept", "Fresh"), ("a", "PeriodElapsed")}
    values = {(r.ref, r.metric_id, r.shard.uid): float(r.value) for r in run.metric_values.collect()}
    assert values["kept", "up", "u2"] == 20.0 and ("twice", "up", "u1") not in values
    # each ref as if it were alone
    plain = samples.where("labels IS NOT NULL")
    for ref in ("a", "b"):
        alone = Pipeline(STRATEGIES[ref]).run(shards.where(F.col("ref") == ref), plain, AS_OF)
        got = {(r.shard.uid, r.replica_id, r.value) for r in run.assignments.where(F.col("ref") == ref).collect()}
        assert got == {(r.shard.uid, r.replica_id, r.value) for r in alone.assignments.collect()}
    # samples that are not stored as series give the same
    listed = Pipeline(tables).run(shards, plain, AS_OF, polls, previous)
    assert set(map(tuple, listed.assignments.collect())) == set(map(tuple, run.assignments.collect()))


def test_no_strategies(spark, samples):
    tables = strategy_tables(spark, {})
    assert fleet.fleet_vectors(series_of(samples), tables, AS_OF).count() == 0
    assert fleet.fleet_poll(fleet_shards(spark, ["a"]), series_of(samples), tables, AS_OF).count() == 0


def test_caps_of_refs(spark):
    df = loads(spark, [(ref, f"u{i}", None, float(10 - i)) for ref in ("x", "y", "z") for i in range(8)])
    caps = spark.createDataFrame([("x", 2), ("y", 0)], "ref string, max_shards_per_replica int")
    for rows in (1_000_000, 3):
        got = {(r.ref, r.shard.uid, r.replica_id) for r in packing.lpt_pack(df, caps, rows).collect()}
        wanted = set()
        for ref, cap in (("x", 2), ("y", None), ("z", None)):
            wanted |= {(r.ref, r.shard.uid, r.replica_id) for r in packing.lpt_pack(df.where(F.col("ref") == ref), cap).collect()}
        assert got == wanted


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_series_and_terms_whatever_the_labels(spark):
    rows = [
        ("up", {"a": "1", "b": "2"}, T0, 1.0), ("up", {"b": "2", "a": "1"}, AS_OF, 2.0), ("up", {"a": "1", "b": None}, T0, 3.0),
        ("up", {}, T0, 4.0), ("up", None, T0, 5.0), ("up", None, AS_OF, 6.0), ("down", {"a": "1", "b": "2"}, T0, 7.0),
    ]
    store = series_of(spark.createDataFrame(rows, SAMPLES))
    # neither sorted nor given an id before samples of one series are one row
    assert "SortAggregate" not in plan_of(store.series)
    sids = {(r.metric, None if r.labels is None else tuple(sorted(r.labels.items(), key=str))): bytes(r.sid) for r in store.series.collect()}
    assert len(sids) == store.series.count() == len(set(sids.values())) == 5
    assert {bytes(r.sid) for r in store.samples.collect()} == set(sids.values())
    terms = sorted((r.metric, bytes(r.sid), r.term) for r in store.listing.collect())
    any_, is_ = "\u0001", "\u0001="
    both = [any_, "a" + any_, "a" + is_ + "1", "b" + any_, "b" + is_ + "2"]
    wanted = {("a", "1"): both[:3], ("b", "2"): both[3:], ("b", None): both[3:4]}
    listed = []
    for (metric, labels), sid in sids.items():
        listed.append((metric, sid, any_))
        listed += [(metric, sid, t) for pair in labels or () for t in wanted[pair] if t != any_]
    assert terms == sorted(listed)


def test_joins_with_strategies_shuffle_nothing_large(spark, samples, tmp_path):
    tables = strategy_tables(spark, STRATEGIES).stored()
    store = series_of(samples)
    used = plan_of(fleet.uses(store, tables))
    # the listing meets the conditions, and the series the metrics, without being dealt by their keys
    assert not [line for line in used.split("\n") if "Exchange hashpartitioning(metric" in line and "term" in line], used
    assert "BroadcastHashJoin [metric" in used, used
    assert not [line for line in plan_of(store.listing).split("\n") if "transform(" in line]


def test_a_run_on_samples_does_not_store_the_listing(spark, samples, monkeypatch):
    from evenkeel.plans import pipeline

    names = []
    monkeypatch.setattr(pipeline, "publish", lambda df, name="stage": names.append(name) or publish(df, name))
    polled = pipeline.poll_samples(fleet_shards(spark, ["a", "b"]), samples, strategy_tables(spark, STRATEGIES), AS_OF)
    assert polled.count() == 12 and "series" in names and "listing" not in names


def test_only_samples_within_reach_are_listed_for_a_run(spark, samples):
    old = [("up", {"namespace": "ns", "pod": "old", "server": "https://s1"}, AS_OF - timedelta(days=9), 9e9)]
    late = [("up", {"namespace": "ns", "pod": "late", "server": "https://s1"}, AS_OF + timedelta(seconds=1), 9e9)]
    other = [("unread", {"namespace": "ns", "pod": "p1", "server": "https://s1"}, AS_OF, 9e9), (None, None, AS_OF, 9e9)]
    more = samples.unionByName(spark.createDataFrame(old + late + other, SAMPLES))
    tables = strategy_tables(spark, STRATEGIES).stored()
    reach = fleet.within_reach(more, tables, AS_OF)
    far = max(s.window_seconds + max(s.range_seconds, s.lookback_seconds) for s in STRATEGIES.values())
    near = (F.col("ts") > F.lit(AS_OF - timedelta(seconds=far))) & (F.col("ts") <= F.lit(AS_OF)) & F.col("metric").isin("up", "grown")
    text = F.to_json(F.struct("metric", "labels", "ts", "value"))
    assert sorted(reach.select(text).collect()) == sorted(more.where(near).select(text).collect())
    days = more.withColumn("day", F.to_date("ts"))
    assert fleet.within_reach(days, tables, AS_OF).count() == reach.count()
    assert fleet.within_reach(more, strategy_tables(spark, {}), AS_OF).count() == 0
    # what is left out is nothing that a vector is made of
    keys = ["ref", "metric_id", "namespace", "bound", "value"]
    everything = fleet.fleet_vectors(series_of(more), tables, AS_OF).select(keys).collect()
    assert sorted(map(str, fleet.fleet_vectors(series_of(reach), tables, AS_OF).select(keys).collect())) == sorted(map(str, everything))


def test_an_id_is_worked_out_once(spark, store):
    readings = fleet.uses(store, strategy_tables(spark, STRATEGIES)).select("metric", "sid", *fleet.READING).distinct()
    rows = spark.createDataFrame([("up", {"a": "1"}, AS_OF, 1.0)], SAMPLES)
    filters = [line for line in plan_of(fleet.reading_vectors(series_of(rows).samples, publish(readings), AS_OF)).split("\n") if "Filter" in line]
    assert not [line for line in filters if "md5" in line], filters
