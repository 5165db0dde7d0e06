"""What the physical plans must and must not contain."""

from datetime import datetime, timedelta

import pytest
from conftest import loads, metric_values
from pyspark.sql import functions as F

from evenkeel import stages
from evenkeel.operators import adjacent, load_index as li, normalize, packing, plan, poll, timeseries as ts, validate
from evenkeel.sources import MetricDef

T0 = datetime(2024, 1, 1)
END = T0 + timedelta(hours=1)
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition", "BatchEvalPython")


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def samples(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "samples")
    rows = [(f"k{i % 3}", f"p{i % 2}", T0 + timedelta(seconds=i), float(i), "unused") for i in range(100)]
    spark.createDataFrame(rows, "k string, pod string, ts timestamp, value double, other string").write.parquet(path)
    return spark.read.parquet(path)


def build(name, spark, samples):
    values = metric_values(spark, [("r", m, f"s{i}", float(i)) for i in range(20) for m in ("a", "b")])
    packed = packing.lpt_pack(loads(spark, [("r", f"u{i}", None, float(i)) for i in range(20)]))
    shards = spark.createDataFrame([("r", "u", "u", "ns", "u", "s")], "ref string, uid string, id string, namespace string, name string, server string")
    vectors = spark.createDataFrame([("m", "ns", "s", 1.0)], "metric_id string, namespace string, bound string, value double")
    return {
        "instant": lambda: ts.instant_vector(samples, ["k", "pod"], T0, END),
        "increase": lambda: ts.increase(samples, ["k", "pod"], T0, END),
        "quartiles": lambda: normalize.quartile_stats(samples.withColumn("ref", F.lit("r")), ("ref", "k"), whole_rows=50, accuracy=50),
        "scale": lambda: normalize.robust_scale(values, 0.01),
        "index": lambda: li.load_index(values, {"a": "1", "b": "1"}, 2),
        "once": lambda: validate.metric_exactly_once(values, {"a": "1", "b": "1"}),
        "poll": lambda: poll.poll(shards, [MetricDef("m"), MetricDef("n")], vectors),
        "pack": lambda: packed,
        "identity": lambda: plan.plan_identity(packed),
        "diff": lambda: plan.plan_diff(packed, packed),
    }[name]()


@pytest.mark.parametrize("name", ["instant", "increase", "quartiles", "scale", "index", "once", "poll", "pack", "identity", "diff"])
def test_no_single_task_no_pairing_of_all_with_all(spark, samples, name):
    text = physical(build(name, spark, samples))
    assert not [word for word in FORBIDDEN if word in text], text


@pytest.mark.parametrize("name", ["instant", "increase"])
def test_filters_and_columns_reach_the_scan(spark, samples, name):
    text = physical(build(name, spark, samples))
    assert "GreaterThan(ts" in text and "LessThanOrEqual(ts" in text
    assert "other" not in text.split("ReadSchema")[1].split(">")[0]


def test_scaling_neither_shuffles_nor_sorts_the_values(spark, samples):
    text = physical(build("scale", spark, samples))
    assert "Exchange hashpartitioning" not in text and "Sort" not in text and "BroadcastHashJoin" in text


@pytest.mark.parametrize("lookback", [300, 36_000])
def test_samples_are_combined_before_the_first_shuffle(spark, samples, lookback):
    text = physical(ts.instant_vector(samples, ["k", "pod"], T0, END, 60, lookback))
    assert "partial_max_by" in text
    # no aggregate above the explode: what is shuffled does not grow with the lookback
    assert "Aggregate" not in text.split("Generate explode")[0] and "Exchange" not in text.split("Generate explode")[0]


def test_neighbours_come_from_one_shuffle_of_the_rows(spark, samples):
    near = physical(ts.increase(samples, ["k", "pod"], T0, END))
    # one shuffle of samples, one of the sums
    assert near.count("Scan parquet") == 1 and near.count("Exchange hashpartitioning") == 2 and "Join" not in near
    rows = samples.select("k", "pod", F.unix_micros("ts").alias("us"), "value")
    far = adjacent.with_previous(rows, ["k", "pod"], "us", ["value"], 10_000_000)
    far.collect()
    final = physical(far).split("== Initial Plan ==")[0]
    assert final.count("Scan parquet") == 1 and "ReusedExchange" in final, final


def test_stage_tables_need_a_shared_folder_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stages.stage_root(Session())


def test_publish_writes_once(spark):
    table = stages.publish(spark.range(10))
    assert stages.publish(table) is table and stages.stored_rows(table) == 10
    assert stages.stored_rows(table.where("id > 3")) is None
    assert stages.stored_rows(stages.project(table, "id")) == 10


@pytest.mark.parametrize("p", [1, 2])
def test_load_index_sorts_no_values(spark, p):
    values = metric_values(spark, [("r", m, f"s{i}", float(i)) for i in range(20) for m in ("a", "b")])
    text = physical(li.load_index(values, {"a": "1", "b": "500m"}, p))
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_quartiles_sort_no_values(spark, samples, monkeypatch):
    """No window and no sort over the values, whether they are listed, bracketed or narrowed."""
    seen = []
    plain = normalize.publish

    def spied(df, name="stage"):
        seen.append(physical(df))
        return plain(df, name)

    monkeypatch.setattr(normalize, "publish", spied)
    df = samples.select(F.lit("r").alias("ref"), F.col("k").alias("metric_id"), "value")
    for options in ({"whole_rows": 1000}, {"whole_rows": 50, "accuracy": 50}, {"whole_rows": 10, "accuracy": 10, "list_rows": 5}):
        seen.append(physical(normalize.quartile_stats(df, **options)))
    assert len(seen) > 8 and not [text for text in seen if "Window" in text]
    # and a table that is small is read once
    seen.append(physical(normalize.quartile_stats(plain(df), whole_rows=1000)))
    assert seen[-1].count("Scan parquet") == 1
