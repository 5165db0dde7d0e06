import math
import random
from datetime import datetime, timedelta, timezone

import pytest

from evenkeel.operators import timeseries as ts
from evenkeel.operators.adjacent import with_previous

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
END = T0 + timedelta(minutes=20)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def grid(step):
    return [at(s) for s in range(step, 1201, step)]


@pytest.fixture(scope="module")
def series():
    """Series with gaps, resets, bursts; one of them holds most of the samples."""
    rng = random.Random(11)
    out = {}
    for name, n in (("hot", 400), ("warm", 40), ("cold", 3), ("late", 12)):
        low = 600 if name == "late" else -500
        times = sorted(rng.sample(range(low * 10, 12000), n))
        value, rows = 0.0, []
        for t in times:
            value = value + rng.randint(0, 9) if rng.random() > 0.1 else float(rng.randint(0, 3))
            rows.append((t / 10, value))
        out[name] = rows
    return out


@pytest.fixture(scope="module")
def samples(spark, series):
    rows = [(k, at(t), v) for k, s in series.items() for t, v in s]
    return spark.createDataFrame(rows, "k string, ts timestamp, value double").repartition(4)


def found(df):
    return {(r.k, r.grid_ts.replace(tzinfo=timezone.utc)): r.value for r in df.collect()}


@pytest.mark.parametrize("step, lookback", [(60, 300), (60, 30), (60, 60), (300, 90), (45, 200)])
def test_instant_vector(samples, series, step, lookback):
    got = found(ts.instant_vector(samples, ["k"], T0, END, step, lookback))
    want = {}
    for k, rows in series.items():
        # the grid is absolute: multiples of the step since the epoch
        first = math.floor(T0.timestamp() / step) * step + step
        for g in range(int(first), int(END.timestamp()) + 1, step):
            seen = [(t, v) for t, v in rows if g - lookback < T0.timestamp() + t <= g]
            if seen:
                want[(k, datetime.fromtimestamp(g, timezone.utc))] = max(seen)[1]
    assert got == want


def test_instant(samples, series):
    got = {r.k: r.value for r in ts.instant(samples, ["k"], at(700), 120).collect()}
    want = {k: max((t, v) for t, v in rows if 580 < t <= 700)[1] for k, rows in series.items() if any(580 < t <= 700 for t, _ in rows)}
    assert got == want


def growth(rows, low, high):
    inside = [(t, v) for t, v in rows if low < t <= high]
    total = sum(b if b < a else b - a for (_, a), (_, b) in zip(inside, inside[1:]))
    return inside, total


@pytest.mark.parametrize("step, span", [(60, 60), (60, 150), (120, 45), (60, 1000)])
def test_increase(samples, series, step, span):
    got = found(ts.increase(samples, ["k"], T0, END, step, span))
    want = {}
    for k, rows in series.items():
        for g in range(step, 1201, step):
            inside, total = growth(rows, g - span, g)
            if len(inside) > 1:
                want[(k, at(g))] = total
    assert got == want
    rates = found(ts.rate(samples, ["k"], T0, END, step_seconds=step, range_seconds=span))
    assert rates == {k: pytest.approx(v / span) for k, v in want.items()}


def test_increase_extrapolated(samples, series):
    got = found(ts.increase(samples, ["k"], T0, END, 60, 120, extrapolate=True))
    want = {}
    for k, rows in series.items():
        for g in range(60, 1201, 60):
            inside, total = growth(rows, g - 120, g)
            if len(inside) < 2:
                continue
            sampled = inside[-1][0] - inside[0][0]
            gap = sampled / (len(inside) - 1)
            start, end = inside[0][0] - (g - 120), g - inside[-1][0]
            if start >= gap * 1.1:
                start = gap / 2
            if total > 0 and inside[0][1] >= 0:
                start = min(start, sampled * inside[0][1] / total)
            if end >= gap * 1.1:
                end = gap / 2
            want[(k, at(g))] = pytest.approx(total * (sampled + start + end) / sampled, rel=1e-9)
    assert got == want


def test_previous_row_across_chunks(spark):
    rng = random.Random(2)
    rows = [(k, t, float(i)) for k, n in (("a", 200), ("b", 7)) for i, t in enumerate(sorted(rng.sample(range(-5000, 5000), n)))]
    df = spark.createDataFrame(rows, "k string, t bigint, v double").repartition(5)
    for chunk in (1, 37, 100000):
        out = {(r.k, r.t): (r.prev_t, r.prev_v) for r in with_previous(df, ["k"], "t", ["v"], chunk).collect()}
        want = {}
        for k in ("a", "b"):
            mine = sorted((t, v) for name, t, v in rows if name == k)
            for i, (t, _) in enumerate(mine):
                want[(k, t)] = mine[i - 1] if i else (None, None)
        assert out == want, chunk


def test_pod_sums_and_peaks(spark):
    rows = [("m", p, i, at(s), float(v)) for p, i, s, v in [("x", 1, 10, 3), ("x", 2, 20, 4), ("y", 1, 30, 5), ("x", 1, 70, 9), ("y", 1, 80, 1)]]
    df = spark.createDataFrame(rows, "k string, pod string, i int, ts timestamp, value double")
    vector = ts.instant_vector(df, ["k", "pod", "i"], T0, at(120), 60, 300)
    peaks = ts.max_over_series(ts.sum_by(vector, ["k", "pod"]), ["k"])
    assert found(peaks) == {("m", at(60)): 7.0, ("m", at(120)): 13.0}
    assert ts.quantile_over_time(peaks, ["k"], 0.95).first().value == pytest.approx(7 + 0.95 * 6)
    assert ts.quantile_over_time(peaks, ["k"], 0.95, approximate=100).first().value == 13.0
    assert ts.max_over_time(peaks, ["k"]).first().value == 13.0
    assert found(ts.scale(peaks, 100.0))[("m", at(60))] == 700.0


def test_a_grid_of_any_length_is_taken(samples):
    """400 days of seconds are 35 million points; each sample serves the next 300 of them."""
    long = ts.instant_vector(samples, ["k"], T0, T0 + timedelta(days=400), 1)
    short = ts.instant_vector(samples, ["k"], T0, T0 + timedelta(hours=3), 1)
    assert found(long) == found(short)


INF = float("inf")


@pytest.mark.parametrize(
    "buckets, q, want",
    [
        ([(1.0, 2), (2.0, 6), (4.0, 8), (INF, 10)], 0.5, 1.75),
        ([(1.0, 2), (2.0, 6), (4.0, 8), (INF, 10)], 0.1, 0.5),
        ([(1.0, 2), (2.0, 6), (4.0, 8), (INF, 10)], 0.95, 4.0),
        ([(-1.0, 4), (2.0, 6), (INF, 6)], 0.5, -1.0),
        ([(1.0, 2), (2.0, 6)], 0.5, math.nan),
        ([(1.0, 0), (INF, 0)], 0.5, math.nan),
    ],
)
def test_histogram_quantile(spark, buckets, q, want):
    # two pods whose buckets add up
    rows = [("k", le, pod, n / 2) for le, n in buckets for pod in ("x", "y")]
    df = spark.createDataFrame(rows, "k string, le double, pod string, value double")
    got = ts.histogram_quantile(df, ["k"], q).first().value
    assert got == pytest.approx(want, nan_ok=True)


def test_histogram_quantile_outside_zero_to_one(spark):
    buckets = spark.createDataFrame([("a", 1.0, 2.0), ("a", float("inf"), 4.0)], "k string, le double, value double")
    found = [ts.histogram_quantile(buckets, ["k"], q).first().value for q in (1.5, -0.5, float("nan"))]
    assert found[:2] == [float("inf"), float("-inf")] and found[2] != found[2]
