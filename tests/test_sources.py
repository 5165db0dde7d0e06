import json
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from evenkeel.schemas import SAMPLES
from evenkeel.sources import (
    RelationStore, default_strategy, discover_shards, load_strategy, read_sample_stream, relation_writer, scan_samples, series_columns,
    write_relation, write_samples,
)
from evenkeel.operators.load_index import weight_table
from evenkeel.sources.strategy import MetricDef, Strategy
from evenkeel.streaming import peak_stream, quantile_stream

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def samples(spark):
    rows = [
        (m, {"pod": p, "server": s}, T0 + timedelta(hours=h), float(h))
        for m in ("up", "down") for p in ("x", "y") for s in ("1", "2") for h in range(0, 72, 6)
    ]
    return spark.createDataFrame(rows, SAMPLES)


def test_scan_prunes_folders_and_filters(spark, tmp_path):
    path = str(tmp_path / "samples")
    write_samples(samples(spark), path)
    out = scan_samples(spark, path, "up", T0 + timedelta(hours=24), T0 + timedelta(hours=36), {"pod": "x"}, within={"server": ["1"]})
    assert sorted(r.value for r in out.collect()) == [30.0, 36.0]
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "metric" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThan(ts" in text and "LessThanOrEqual(ts" in text


def test_series_columns(spark):
    out = series_columns(samples(spark), ["pod"])
    assert out.columns == ["metric", "series", "pod", "ts", "value"]
    assert out.select("series").distinct().count() == 4


def test_discover_shards(spark):
    rows = [
        ("1", "o1", "ns", {"kind": "cluster", "env": "prod"}, {"name": "n1", "server": "s1"}),
        ("2", "o2", "ns", {"kind": "repository"}, {"name": "n2", "server": "s2"}),
        ("3", "o3", "ns", {"kind": "cluster"}, {"name": "n3", "server": "s3"}),
    ]
    registry = spark.createDataFrame(rows, "uid string, object_name string, namespace string, labels map<string,string>, data map<string,string>")
    assert {tuple(r) for r in discover_shards(registry, {"kind": "cluster"}).collect()} == {("1", "o1", "ns", "n1", "s1"), ("3", "o3", "ns", "n3", "s3")}
    assert [r.uid for r in discover_shards(registry, {"kind": "cluster"}, absent=["env"]).collect()] == ["3"]


def test_strategies(spark):
    s = default_strategy("x_")
    assert [str(w) for w in s.weights.values()] == ["0.05", "0.1", "0.1", "0.15", "0.2", "0.2", "0.2"]
    assert sum(Decimal(w) for w in s.weights.values()) == 1
    assert (s.p, s.epsilon, s.period_seconds, s.window_seconds, s.step_seconds, s.stabilization_seconds) == (1, 0.01, 60, 3600, 60, 86400)
    assert [m.id for m in s.metrics if m.no_data is not None] == ["x_app_k8s_request_total"]
    text = json.dumps({"metrics": [{"id": "m", "query": "q", "no_data": "1k", "bind": "server_host"}], "weights": {"m": "1"}, "p": 2, "epsilon": None})
    loaded = load_strategy(text)
    assert (loaded.p, loaded.epsilon, loaded.metrics[0].no_data) == (2, None, "1k")
    assert len(Strategy(tuple(MetricDef(str(i)) for i in range(2000)), {}).metrics) == 2000
    with pytest.raises(ValueError):
        Strategy((MetricDef("m"), MetricDef("m")), {})
    with pytest.raises(ValueError):
        load_strategy('{"metrics": [{"id": "m"}], "weights": {"m": "1", "m": "2"}}')
    timed = load_strategy('{"metrics": [], "weights": {"m": "500m"}, "stabilization_seconds": "24h", "step_seconds": "1m30s", "epsilon": "10m"}')
    assert (timed.stabilization_seconds, timed.step_seconds, timed.epsilon) == (86400, 90, 0.01)
    weights = {r.metric_id: r.weight for r in weight_table(spark, {"a": "500m", "b": 1 / 3, "c": "2"}).collect()}
    assert weights == {"a": 0.5, "b": 1 / 3, "c": 2.0}
    with pytest.raises(ValueError):
        weight_table(spark, {"a": "many"})


def test_relation_sink_replaces_whole_refs(spark, tmp_path):
    path = str(tmp_path / "relation")
    schema = "ref string, shard string, value double"
    write_relation(spark.createDataFrame([("a", "1", 1.0), ("a", "2", 2.0), ("b", "1", 3.0)], schema), path)
    write_relation(spark.createDataFrame([("a", "3", 9.0)], schema), path)
    assert {(r.ref, r.shard) for r in spark.read.parquet(path).collect()} == {("a", "3"), ("b", "1")}


def test_relation_writer_keeps_rows_of_earlier_batches(spark, tmp_path):
    path = str(tmp_path / "relation")
    schema = "ref string, shard string, value double"
    write = relation_writer(lambda rows: rows.where("value >= 0"), path)
    write(spark.createDataFrame([("a", "1", 1.0), ("b", "1", 3.0)], schema), 0)
    for _ in range(2):  # a replayed batch changes nothing
        write(spark.createDataFrame([("a", "2", 2.0)], schema), 1)
    rows = spark.read.schema("shard string, value double, ref string").parquet(path)
    assert sorted((r.ref, r.shard) for r in rows.collect()) == [("a", "1"), ("a", "2"), ("b", "1")]
    whole = spark.createDataFrame([("a", "9", 1.0)], schema)
    write_relation(whole, path, spark.createDataFrame([("a",), ("b",)], "ref string"))
    rows = spark.read.schema("shard string, value double, ref string").parquet(path)
    assert [(r.ref, r.shard) for r in rows.collect()] == [("a", "9")]


def test_streamed_relation_and_peaks(spark, tmp_path):
    minutes = [T0 + timedelta(seconds=s) for s in range(0, 600, 20)]
    rows = [("m", {"pod": p, "i": i}, t, float(n + (5 if p == "y" else 0))) for n, t in enumerate(minutes) for p in ("x", "y") for i in ("1", "2")]
    rows += [("m", {"pod": "x", "i": "1"}, T0 + timedelta(hours=2), 0.0)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, SAMPLES).coalesce(1).write.parquet(source)
    lifted = series_columns(read_sample_stream(spark, source), ["pod"])
    peaks = peak_stream(lifted, ["metric"], "pod", "series", "1 minute", "1 minute")
    out, wide = str(tmp_path / "out"), str(tmp_path / "wide")
    write = relation_writer(lambda batch: batch.withColumn("ref", F.date_format("grid_ts", "HH-mm")), out)
    queries = [
        peaks.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp1")).start(),
        quantile_stream(peaks, ["metric"], 0.5, "3 minutes", "1 minute")
        .writeStream.format("parquet").option("path", wide).option("checkpointLocation", str(tmp_path / "cp2")).start(),
    ]
    try:
        for query in queries:
            query.processAllAvailable()
    finally:
        for query in queries:
            query.stop()
    # last sample of each minute, two series per pod, pod y is the larger
    want = {k: 2.0 * (3 * k + 2 + 5) for k in range(10)}
    got = {int(r.ref[3:]) - 1: r.value for r in spark.read.schema("grid_ts timestamp, value double, ref string").parquet(out).collect()}
    assert got == want
    middle = {r.grid_ts.minute: r.value for r in spark.read.parquet(wide).collect() if r.grid_ts.hour == 0}
    assert {m: middle[m] for m in range(3, 11)} == {m: want[m - 2] for m in range(3, 11)}


def test_relation_store_shows_whole_versions_only(spark, tmp_path):
    schema = "ref string, label string, value double"
    store = RelationStore(spark, str(tmp_path / "store"), schema)

    def rows(*found):
        return spark.createDataFrame(list(found), schema)

    def shown():
        return sorted(tuple(r) for r in store.read().collect())

    assert shown() == [] and store.compact() is None
    store.put(0, rows(("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)))
    store.put(1, rows(("a", "z", 4.0)), refs=rows(("c", "", 0.0)))
    assert shown() == [("a", "z", 4.0), ("b", "x", 3.0)]
    # a replay of a committed batch changes nothing, a batch without a commit shows nothing
    store.put(1, rows(("a", "late", 9.0)))
    rows(("b", "half", 5.0)).write.parquet(str(tmp_path / "store/rows/version=4"))
    assert shown() == [("a", "z", 4.0), ("b", "x", 3.0)]
    store.put(2, rows(("b", "whole", 6.0)), extend=True)
    assert shown() == [("a", "z", 4.0), ("b", "whole", 6.0), ("b", "x", 3.0)]
    # only the versions that hold the wanted refs are opened
    files = store.read(rows(("a", "", 0.0))).inputFiles()
    assert files and all("version=2/" in f for f in files if "/rows/" in f)
    store.put(3, rows(), refs=rows(("a", "", 0.0)))
    assert store.compact() == 7 and shown() == [("b", "whole", 6.0), ("b", "x", 3.0)]
    assert sorted(p.name for p in (tmp_path / "store/rows").iterdir()) == ["version=7"]
    store.put(4, rows(("c", "new", 1.0)))
    assert shown() == [("b", "whole", 6.0), ("b", "x", 3.0), ("c", "new", 1.0)]


def test_relation_store_as_a_stream_sink(spark, tmp_path):
    schema = "ref string, label string, value double"
    source, store = str(tmp_path / "in"), RelationStore(spark, str(tmp_path / "store"), schema)
    for n, found in enumerate([[("a", "x", 1.0)], [("a", "y", 2.0), ("b", "x", 3.0)]]):
        spark.createDataFrame(found, schema).coalesce(1).write.mode("append").parquet(source)
        query = (
            spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(store.writer(lambda b: b, extend=True))
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    assert sorted(tuple(r) for r in store.read().collect()) == [("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)]
