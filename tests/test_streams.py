"""Streams with their own state against the batch operators."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Row

from evenkeel.operators import evaluate, timeseries as ts
from evenkeel.streaming import elect_stream, growth_stream, sliding_quantile_stream
from evenkeel.streaming.election import Election
from evenkeel.streaming.growth import Growth

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "k string, ts timestamp, value double"


def run(spark, batches, schema, build, tmp_path, progress=None):
    """Feeds batches one by one; returns the rows that came out, and notes the state of each batch in ``progress``."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], schema).coalesce(1).write.parquet(source)
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        query = (
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        if progress is not None:
            progress.append([p.stateOperators[0] for p in query.recentProgress if p.stateOperators])
    return spark.read.schema(stream.schema).parquet(out).collect()


@pytest.mark.parametrize("step,span", [(60, 60), (60, 200), (100, 30)])
def test_growth_is_that_of_the_batch(spark, tmp_path, step, span):
    rng = random.Random(step + span)
    batches = []
    for n in range(4):
        rows = []
        for _ in range(40):
            k = rng.choice(["a", "b"] if n > 1 else ["a", "b", "gone"])
            at = T0 + timedelta(seconds=300 * n + rng.randrange(300), microseconds=rng.randrange(10**6))
            rows.append((k, at, float(rng.randrange(100))))
        rows.append((None, T0 + timedelta(seconds=300 * n + 7), float(n)))
        batches.append(rows)
    # out of order within the delay
    batches[2].append(("a", T0 + timedelta(seconds=590), 7.5))
    found = run(spark, batches, SCHEMA, lambda s: growth_stream(s, ["k"], step, span, "20 seconds"), tmp_path)
    everything = [r for b in batches for r in b]
    end = max(r[1] for r in everything) - timedelta(seconds=20)
    whole = ts.increase(spark.createDataFrame(everything, SCHEMA), ["k"], T0 - timedelta(seconds=1), end, step, span)
    assert len(found) > 10
    # doubles of whole numbers and halves: sums are exact
    assert sorted((str(r.k), r.grid_ts, r.value) for r in found) == sorted((str(r.k), r.grid_ts, r.value) for r in whole.collect())


def test_late_samples_change_nothing_and_idle_series_leave_no_state(spark, tmp_path):
    def at(s):
        return T0 + timedelta(seconds=s)

    batches = [
        [("a", at(10), 1.0), ("a", at(50), 3.0), ("b", at(55), 1.0)],
        [("b", at(400), 2.0)],
        [("a", at(20), 100.0), ("b", at(410), 5.0)],
        [("a", at(1000), 9.0), ("b", at(1001), 9.0)],
    ]
    found = run(spark, batches, SCHEMA, lambda s: growth_stream(s, ["k"], 60, 60, "5 seconds"), tmp_path)
    assert sorted((r.k, r.grid_ts, r.value) for r in found) == [
        ("a", datetime(2024, 1, 1, 0, 1), 2.0), ("b", datetime(2024, 1, 1, 0, 7), 3.0)
    ]


def test_sliding_quantile_is_that_of_each_window(spark, tmp_path):
    rng = random.Random(3)
    schema = "k string, grid_ts timestamp, ts timestamp, value double"
    values = {(k, m): float(rng.randrange(1000)) for k in "xy" for m in range(1, 40) if rng.random() < 0.6 and not (k == "y" and 12 < m < 30)}
    batches = [
        [(k, T0 + timedelta(minutes=m), T0 + timedelta(minutes=m, microseconds=-1), v) for (k, m), v in values.items() if low < m <= low + 13]
        for low in (0, 13, 26)
    ]
    closed = [("z", T0 + timedelta(minutes=90), T0 + timedelta(minutes=90), 1.0)]
    found = run(
        spark, [*batches, closed], schema,
        lambda s: sliding_quantile_stream(s.withWatermark("ts", "1 minute"), ["k"], 0.3, 300, 60), tmp_path,
    )
    wanted = {}
    for k in "xy":
        for m in range(1, 50):
            inside = sorted(v for (name, at), v in values.items() if name == k and m - 5 < at <= m)
            if inside:
                place = (len(inside) - 1) * 0.3
                low = int(place)
                high = min(low + 1, len(inside) - 1)
                wanted[k, m] = inside[low] + (inside[high] - inside[low]) * (place - low)
    got = {(r.k, r.grid_ts.hour * 60 + r.grid_ts.minute): r.value for r in found if r.k != "z"}
    assert len(got) == sum(r.k != "z" for r in found)
    assert got == pytest.approx(wanted)


OBSERVED = "ref string, at timestamp, plan_hash string, replicas int"


def test_election_over_many_refs_and_batches_is_the_replay(spark, tmp_path):
    rng = random.Random(8)
    batches = [
        [
            (ref, T0 + timedelta(seconds=200 * n + s), rng.choice("abcdef") * 8, rng.randrange(1, 5))
            for ref in ("x", "y", "z", None)
            for s in sorted(rng.sample(range(200), 25 if ref != "z" or n != 2 else 0))
        ]
        for n in range(3)
    ]
    periods = evaluate.Periods(60, scale_up=40, scale_down=150)
    everything = spark.createDataFrame([r for b in batches for r in b], OBSERVED)
    wanted = sorted(map(str, evaluate.replay(everything, periods).collect()))
    assert len(wanted) == 275
    for name, delay in (("plain", None), ("timers", "1 second")):
        (tmp_path / name).mkdir()
        found = run(spark, batches, OBSERVED, lambda s: elect_stream(s, periods, delay), tmp_path / name)
        assert sorted(map(str, found)) == wanted


def test_election_writes_what_a_batch_changes_and_timers_clear_silent_refs(spark, tmp_path):
    periods = evaluate.Periods(10_000, scale_up=10_000, scale_down=10_000)
    many = [("x", T0 + timedelta(seconds=s), f"{s:08d}", 1) for s in range(500)]
    few = [("x", T0 + timedelta(seconds=600), "00000007", 1), ("y", T0 + timedelta(seconds=601), "a", 1)]
    later = [("y", T0 + timedelta(seconds=40_000 + s), "b", 1) for s in range(2)]
    progress = []
    found = run(spark, [many, few, later, later], OBSERVED, lambda s: elect_stream(s, periods, "5 seconds"), tmp_path, progress)
    assert [r.history_size for r in found if r.plan_hash == "00000007" and r.votes > 100] == [500]
    first, second, *rest = [sum(p.numRowsUpdated for p in batch) for batch in progress]
    assert first >= 500 and 0 < second < 20
    # of the silent ref only the head is left
    assert progress[1][-1].numRowsTotal > 500 > 20 > progress[-1][-1].numRowsTotal


class Counted:
    """A handle whose states are empty and note how often they are called."""

    def __init__(self, calls):
        self.calls = calls

    def getValueState(self, name, *schemas):
        return Counted(self.calls)

    getListState = getMapState = getValueState

    def __getattr__(self, name):
        def call(*args):
            self.calls[name] += 1
            return iter(()) if name == "iterator" else None

        return call


def test_a_series_has_one_timer_however_many_grid_points_its_samples_reach():
    calls = Counter()
    growth = Growth(["k"], 60, 60)
    growth.init(Counted(calls))
    assert list(growth.handleInputRows(("a",), iter([Row(us=60 * n, value=1.0) for n in range(1, 50)]), None)) == []
    assert calls["registerTimer"] == 1 and sum(calls.values()) < 6


def test_a_new_ref_costs_few_calls_to_the_state():
    calls = Counter()
    election = Election(evaluate.Periods(60))
    election.init(Counted(calls))
    out = list(election.handleInputRows(("a",), iter([Row(ref="a", at_us=1, plan_hash="h", replicas=2)]), None))
    assert [(r.winner, r.elected, r.promoted) for r in out] == [("h", "h", True)]
    assert sum(calls.values()) <= 3
