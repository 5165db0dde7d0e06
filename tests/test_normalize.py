import random
from decimal import Decimal

import pytest
from conftest import metric_values

from evenkeel.operators import load_index as li, normalize
from evenkeel.stages import publish


def halves(values):
    s = sorted(values)
    n = len(s)

    def mid(part):
        m = len(part)
        return (part[(m - 1) // 2] + part[m // 2]) / 2

    median = mid(s)
    if n == 1:
        return median, None, None, 0.0
    q1, q3 = mid(s[: n // 2]), mid(s[(n + 1) // 2 :])
    return median, q1, q3, q3 - q1


GOLDEN = [
    ([1, 2, 3, 4, 5], 3, 1.5, 4.5, [-0.666666667, -0.333333333, 0, 0.333333333, 0.666666667]),
    ([1, 2, 3, 4, 5, 6, 7, 100], 4.5, 2.5, 6.5, [-0.875, -0.625, -0.375, -0.125, 0.125, 0.375, 0.625, 23.875]),
    ([10, 20], 15, 10, 20, [-0.5, 0.5]),
    ([1, 2, 9], 2, 1, 9, [-0.125, 0, 0.875]),
    ([5, 5, 5], 5, 5, 5, [0, 0, 0]),
    ([7], 7, None, None, [0]),
]


def test_golden_values(spark):
    rows = [(str(i), "m", f"s{j}", float(v)) for i, g in enumerate(GOLDEN) for j, v in enumerate(g[0])]
    table = publish(metric_values(spark, rows))
    stats = {r.ref: r for r in normalize.quartile_stats(table).collect()}
    scaled = {(r.ref, r.shard.uid): r.value for r in normalize.robust_scale(table).collect()}
    for i, (values, median, q1, q3, out) in enumerate(GOLDEN):
        s = stats[str(i)]
        assert (s.n, s.median, s.q1, s.q3) == (len(values), median, q1, q3)
        assert [float(scaled[(str(i), f"s{j}")]) for j in range(len(values))] == out


def golden_pair(spark):
    rows = [("r", "a", f"s{i}", float(i)) for i in range(1, 6)] + [("r", "b", f"s{i}", 100.0) for i in range(1, 6)]
    return metric_values(spark, rows)


def test_offset_spans_all_metrics_and_not_the_display(spark):
    out = normalize.robust_scale(golden_pair(spark), 0.01).collect()
    got = {(r.metric_id, r.shard.uid): float(r.value) for r in out}
    want = {"s1": 0.013333333, "s2": 0.346666667, "s3": 0.68, "s4": 1.013333333, "s5": 1.346666667}
    assert got == {**{("a", s): v for s, v in want.items()}, **{("b", s): 0.68 for s in want}}
    assert {r.display_value for r in out if r.metric_id == "b"} == {"0"}
    assert {r.display_value for r in out if r.shard.uid == "s2" and r.metric_id == "a"} == {"-0.3333333333333333"}


@pytest.mark.parametrize(
    "p, want",
    [
        (1, [0.513333333, 0.596666667, 0.68, 0.763333333, 0.846666667]),
        (2, [0.588935009, 0.613876571, 0.68, 0.776859776, 0.894526566]),
        (3, [0.617821519, 0.626785853, 0.68, 0.791555939, 0.94591887]),
    ],
)
def test_p_norm(spark, p, want):
    scaled = normalize.robust_scale(golden_pair(spark), 0.01)
    out = li.load_index(scaled, {"a": "0.25", "b": "0.75"}, p)
    assert [float(r.value) for r in sorted(out.collect(), key=lambda r: r.shard.uid)] == want


def test_unweighted_metrics_and_weights_per_ref(spark):
    values = metric_values(spark, [(r, m, "s", v) for r in ("x", "y") for m, v in (("a", 2.0), ("b", 3.0), ("c", 9.0))])
    assert {float(r.value) for r in li.load_index(values, {"a": "1", "b": "2"}).collect()} == {8.0}
    table = spark.createDataFrame([("x", "a", 1.0), ("y", "c", 0.5)], "ref string, metric_id string, weight double")
    assert {r.ref: float(r.value) for r in li.load_index(values, table).collect()} == {"x": 2.0, "y": 4.5}


def test_p_must_be_positive_and_a_negative_sum_has_no_root(spark):
    values = metric_values(spark, [("r", "a", "s", -2.0)])
    with pytest.raises(ValueError):
        li.load_index(values, {"a": "1"}, 0)
    row = li.load_index(values, {"a": "1"}, 3).first()
    assert row.value is None and row.display_value == "NaN"
    assert li.load_index(values, {"a": "1"}, 1).first().value == Decimal(-2)


@pytest.mark.parametrize("shape", ["spread", "ties", "one_hot"])
def test_brackets_find_the_same_quartiles_as_sorting(spark, shape):
    rng = random.Random(shape)
    draw = {
        "spread": lambda: rng.lognormvariate(0, 3),
        "ties": lambda: float(rng.randint(0, 9)),
        "one_hot": lambda: 5.0 if rng.random() < 0.6 else rng.uniform(-10, 10),
    }[shape]
    groups = {f"m{n}": [round(draw(), 9) for _ in range(n)] for n in (1, 2, 3, 4, 5, 50, 51, 52, 53, 4000, 4001, 4002, 4003)}
    rows = [("r", m, v) for m, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "ref string, metric_id string, value double").repartition(5)
    for limit, accuracy in ((10**6, 10_000), (100, 100), (1000, 1000)):
        got = {r.metric_id: (r.median, r.q1, r.q3, r.iqr) for r in normalize.quartile_stats(df, whole_rows=limit, accuracy=accuracy).collect()}
        assert got == {m: halves(v) for m, v in groups.items()}, (limit, accuracy)


@pytest.mark.parametrize("margin", [0, 0.1, 4])
def test_ranks_outside_their_brackets_are_found_by_wider_ones(spark, margin):
    rng = random.Random(23)
    groups = {m: [round(rng.gauss(0, 1), 6) for _ in range(6000 + i)] for i, m in enumerate("abcd")}
    rows = [("r", m, v) for m, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "ref string, metric_id string, value double").repartition(5)
    stats = normalize.quartile_stats(df, whole_rows=200, accuracy=200, margin=margin).collect()
    assert {r.metric_id: (r.median, r.q1, r.q3, r.iqr) for r in stats} == {m: halves(v) for m, v in groups.items()}


def test_brackets_too_narrow_for_the_group_are_refused(spark):
    with pytest.raises(ValueError):
        normalize.quartile_stats(metric_values(spark, []), whole_rows=50, accuracy=100)


def test_scaling_is_invariant_and_offset_reaches_epsilon(spark):
    rng = random.Random(3)
    base = [float(rng.randint(0, 1000)) for _ in range(41)]
    rows = [("r", "m", f"s{i}", v) for i, v in enumerate(base)] + [("t", "m", f"s{i}", 4 * v + 7) for i, v in enumerate(base)]
    out = normalize.robust_scale(metric_values(spark, rows)).collect()
    by_ref = {ref: [r.value for r in sorted(out, key=lambda r: r.shard.uid) if r.ref == ref] for ref in ("r", "t")}
    assert by_ref["r"] == by_ref["t"]
    spread = max(by_ref["r"]) - min(by_ref["r"])
    lifted = [r.value for r in normalize.robust_scale(metric_values(spark, rows), 0.05).collect() if r.ref == "r"]
    assert float(min(lifted)) == pytest.approx(0.05 * float(spread), abs=2e-9)
