import random
from collections import defaultdict

import pytest
from conftest import loads
from hypothesis import given, settings, strategies as st

from evenkeel.operators import packing
from evenkeel.operators.packing import lpt_fold


def naive(items, cap=None):
    """Brute force: ask every replica.  Items are (uid, name, load)."""
    order = sorted(items, key=lambda r: (r[1] != "in-cluster", -r[2], r[0]))
    bucket = max((r[2] for r in items), default=0)
    replicas, out = [], {}
    for uid, _, load in order:
        best = None
        for i, (total, count) in enumerate(replicas):
            if (not cap or count < cap) and total + load < bucket and (best is None or total < replicas[best][0]):
                best = i
        if best is None:
            replicas.append((0, 0))
            best = len(replicas) - 1
        replicas[best] = (replicas[best][0] + load, replicas[best][1] + 1)
        out[uid] = best
    return out


F1 = [("shard1", 5), ("shard2", 3), ("shard3", 8), ("shard4", 6), ("shard5", 7)]
F2 = [("shard1", 5), ("shard2", 3), ("shard3", 8), ("in-cluster", 6), ("shard5", 7)]


@pytest.mark.parametrize(
    "rows, order",
    [
        (F1, ["shard3", "shard5", "shard4", "shard1", "shard2"]),
        (F2, ["in-cluster", "shard3", "shard5", "shard1", "shard2"]),
    ],
)
def test_order_and_bucket(spark, rows, order):
    df = loads(spark, [("r", n, n, float(v)) for n, v in rows])
    assert [r.shard.name for r in packing.packing_order(df).collect()] == order
    assert packing.bucket_size(df).first().bucket == 8


PACKINGS = [
    ([("shard1", 5), ("shard2", 3), ("shard3", 10), ("in-cluster", 6), ("shard5", 7)], -1,
     [(["in-cluster"], 6), (["shard3"], 10), (["shard5"], 7), (["shard1", "shard2"], 8)]),
    ([("in-cluster", 10)] + [(f"shard{i}", 1) for i in range(1, 6)], 2,
     [(["in-cluster"], 10), (["shard1", "shard2"], 2), (["shard3", "shard4"], 2), (["shard5"], 1)]),
    ([("a", 9), ("b", 9), ("c", 9)], None, [(["a"], 9), (["b"], 9), (["c"], 9)]),
    ([("a", 0), ("b", 0), ("c", 0)], 0, [(["a"], 0), (["b"], 0), (["c"], 0)]),
    ([("a", 10), ("b", 4), ("c", 3), ("d", 3), ("e", 2), ("f", 1)], None,
     [(["a"], 10), (["b", "e", "f"], 7), (["c", "d"], 6)]),
]


@pytest.mark.parametrize("rows, cap, plan", PACKINGS[:4])
def test_packing_fixtures(spark, rows, cap, plan):
    df = loads(spark, [("r", n, n, float(v)) for n, v in rows])
    nested = packing.replicas(packing.lpt_pack(df, cap)).orderBy("replica_id").collect()
    got = [(sorted(e.shard.name for e in r.load_indexes), int(r.total_load)) for r in nested]
    assert got == plan
    assert [r.total_load_display for r in nested] == [str(t) for _, t in plan]


def test_totals_of_a_mixed_case():
    ids = lpt_fold([10, 4, 3, 3, 2, 1], 10)
    totals = defaultdict(int)
    for replica, load in zip(ids, [10, 4, 3, 3, 2, 1]):
        totals[replica] += load
    assert sorted(totals.values(), reverse=True) == [10, 7, 6]


def test_empty(spark):
    out = packing.lpt_pack(loads(spark, []))
    assert out.collect() == [] and packing.replica_count(out).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-3, 40), min_size=1, max_size=40), st.sampled_from([None, 1, 2, 3]))
def test_heap_equals_brute_force(values, cap):
    items = sorted(((f"s{i:03}", "", v) for i, v in enumerate(values)), key=lambda r: (-r[2], r[0]))
    ids = lpt_fold([r[2] for r in items], max(values), cap)
    assert dict(zip((r[0] for r in items), ids)) == naive(items, cap)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=40), st.sampled_from([None, 2, 3]), st.integers(1, 9))
def test_slices_equal_the_whole(values, cap, width):
    """Handing over only as many least loaded replicas as the slice has shards loses nothing."""
    values = sorted(values, reverse=True)
    whole = lpt_fold(values, values[0], cap)
    state, got = {}, []
    for at in range(0, len(values), width):
        part = values[at : at + width]
        room = sorted((t, r, n) for r, (t, n) in state.items() if not cap or n < cap)[: len(part)]
        ids = lpt_fold(part, values[0], cap, room, len(state))
        for load, replica in zip(part, ids):
            total, n = state.get(replica, (0, 0))
            state[replica] = (total + load, n + 1)
        got += ids
    assert got == whole


@pytest.mark.parametrize("cap", [None, 3])
def test_large_refs_pack_like_small_ones(spark, cap):
    rng = random.Random(5)
    rows = []
    for ref, n in (("huge", 260), ("tiny", 9), ("other", 90)):
        rows += [(ref, f"{ref}{i}", "in-cluster" if i == 17 else f"n{i}", float(rng.choice([rng.randint(0, 60), rng.randint(0, 4)]))) for i in range(n)]
    df = loads(spark, rows)
    want = set()
    for ref in ("huge", "tiny", "other"):
        plan = naive([(u, n, v) for r, u, n, v in rows if r == ref], cap)
        want |= {(ref, uid, replica) for uid, replica in plan.items()}
    for limit in (1000, 40, 15):
        out = packing.lpt_pack(df, cap, max_group_rows=limit)
        got = [(r.ref, r.shard.uid, r.replica_id) for r in out.collect()]
        assert len(got) == len(rows) and set(got) == want, limit


def test_totals_and_quality(spark):
    out = packing.lpt_pack(loads(spark, [("r", str(i), None, float(v)) for i, v in enumerate([8, 4, 3, 1])]))
    totals = {r.replica_id: (r.shards, int(r.total_load), r.total_load_display) for r in packing.replica_totals(out).collect()}
    assert totals == {0: (1, 8, "8"), 1: (2, 7, "7"), 2: (1, 1, "1")} or sum(t[1] for t in totals.values()) == 16
    quality = packing.plan_quality(out).first()
    assert quality.replicas == len(totals) and quality.makespan == 8
    assert float(quality.spread) == pytest.approx(8 / (16 / quality.replicas), abs=1e-8)
    assert float(quality.fill) == pytest.approx(16 / quality.replicas / 8, abs=1e-8)
    assert packing.replica_count(out).first().replicas == len(totals)


def test_long_lists_come_in_parts(spark):
    rows = [("r", f"u{i:02}", None, float(v)) for i, v in enumerate([50] + [1] * 40)]
    out = packing.lpt_pack(loads(spark, rows))
    whole = {r.replica_id: r for r in packing.replicas(out).collect()}
    parts = packing.replicas(out, max_list=10).collect()
    assert {r.part for r in whole.values()} == {0} and max(r.part for r in parts) > 0
    for replica, row in whole.items():
        mine = sorted((r for r in parts if r.replica_id == replica), key=lambda r: r.part)
        assert [e.shard.uid for r in mine for e in r.load_indexes] == [e.shard.uid for e in row.load_indexes]
        assert all(len(r.load_indexes) == 10 for r in mine[:-1]) and len(mine[-1].load_indexes) <= 10
        assert {r.total_load for r in mine} == {row.total_load}


def test_loads_beyond_64_bits_stay_exact(spark):
    rows = [("r", str(i), None, v) for i, v in enumerate([3e12, 2e12, 1e12, 5e11])]
    out = packing.lpt_pack(loads(spark, rows))
    want = naive([(r[1], "", r[3]) for r in rows])
    assert {r.shard.uid: r.replica_id for r in out.collect()} == want


def one_by_one(loads, bucket, cap, replicas=(), opened=0):
    """The fold as it is told: the least (total, id) if the load fits, else a new replica."""
    state, out = {r: [t, n] for t, r, n in replicas}, []
    for load in loads:
        free = [(t, r) for r, (t, n) in state.items() if not cap or n < cap]
        total, replica = min(free, default=(bucket, None))
        if total + load >= bucket:
            replica, opened = opened, opened + 1
            state[replica] = [0, 0]
        state[replica][0] += load
        state[replica][1] += 1
        out.append(replica)
    return out


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 12), st.integers(1, 60)), min_size=1, max_size=6),
    st.one_of(st.none(), st.integers(1, 9)),
    st.lists(st.tuples(st.integers(0, 40), st.integers(1, 5)), max_size=6),
    st.integers(0, 30),
)
def test_runs_of_equal_loads_are_dealt_as_one_by_one(runs, cap, known, slack):
    runs = sorted(runs, reverse=True)
    loads_ = [load for load, n in runs for _ in range(n)]
    bucket = max(loads_) + slack
    replicas = [(t, r, n) for r, (t, n) in enumerate(known) if not cap or n < cap]
    opened = len(known)
    wanted = one_by_one(loads_, bucket, cap, replicas, opened)
    old, packing.RUN = packing.RUN, 2
    try:
        assert packing.lpt_fold(loads_, bucket, cap, replicas, opened) == wanted
    finally:
        packing.RUN = old
    assert packing.lpt_fold(loads_, bucket, cap, replicas, opened) == wanted


def test_an_idle_fleet_is_a_few_steps():
    n = 2_000_000
    ids = packing.lpt_fold([10] * 3 + [1] * n + [0] * n, 10)
    assert ids[:3] == [0, 1, 2] and len(ids) == 2 * n + 3
    assert max(ids) == 2 + -(-n // 9) and len(set(ids[-n:])) == 1


def test_steps_of_a_large_ref_do_not_grow_with_it(spark, monkeypatch):
    values = [float(1000 - n % 400) for n in range(600)]
    df = loads(spark, [("r", f"{n:04d}", None, v) for n, v in enumerate(values)])
    taken = []

    class Counted(packing.Slices):
        def __init__(self, *args):
            super().__init__(*args)
            taken.append(len(self))
            assert len(self) < 2 * packing.STEPS

    monkeypatch.setattr(packing, "Slices", Counted)
    sliced, whole = (
        sorted((r.shard.uid, r.replica_id) for r in packing.lpt_pack(df, 3, max_group_rows=limit).collect()) for limit in (3, 1000)
    )
    assert len(taken) == 1 and sliced == whole


def test_slices_stay_within_a_task():
    assert packing._rows_per_slice(1_000, 700) == 700
    assert packing._rows_per_slice(120_000, 700) == 7_500
    assert packing._rows_per_slice(10**9, 700) == packing.MAX_GROUP_ROWS


def test_small_refs_share_a_call(spark, capsys):
    rows = [(None if n % 50 == 0 else f"r{n % 50}", str(n), None, float(n * 7919 % 100)) for n in range(400)]
    packed = packing.lpt_pack(loads(spark, rows))
    packed.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    found = {(r.ref, r.shard.uid): r.replica_id for r in packed.collect()}
    for ref in {r[0] for r in rows}:
        group = sorted((-v, uid) for name, uid, _, v in rows if name == ref)
        ids = packing.lpt_fold([int(-v) for v, _ in group], int(-group[0][0]))
        assert [found[ref, uid] for _, uid in group] == ids
