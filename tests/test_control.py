from datetime import datetime, timedelta, timezone

import pytest
from conftest import shard_of

from evenkeel.operators import control, observe

BASE = dict(
    ref="r", mode_default=True, mode_x0y=False, rollout_restart=False, paused=None, provider_ready=True, manager_ready=True,
    plan_key="new", manager_spec_key="new", manager_status_key="new", scaler_status_key="new",
    desired_replicas=3, spec_replicas=3, actual_replicas=3,
)
SNAPSHOT = (
    "ref string, mode_default boolean, mode_x0y boolean, rollout_restart boolean, paused boolean, provider_ready boolean, "
    "manager_ready boolean, plan_key string, manager_spec_key string, manager_status_key string, scaler_status_key string, "
    "desired_replicas int, spec_replicas int, actual_replicas int"
)
X0Y = dict(mode_default=False, mode_x0y=True, scaler_status_key="old")
LADDER = [
    ({}, "Ready", False, False),
    (dict(mode_default=False), "Ready", False, False),
    (dict(mode_x0y=True, paused=True), "ErrorResourceMalformedDuplicateModes", False, False),
    (dict(paused=True, provider_ready=False), "Paused", False, False),
    (dict(provider_ready=False, manager_ready=False), "PartitionProviderNotReady", False, False),
    (dict(manager_ready=False), "ShardManagerNotReady", False, False),
    (X0Y, "BeginningScalingToZero", False, True),
    (X0Y | dict(spec_replicas=0), "WaitingForRSControllerToScaleToZero", False, False),
    (X0Y | dict(spec_replicas=0, actual_replicas=0), "BeginningRSControllerScaling", False, True),
    (X0Y | dict(spec_replicas=0, actual_replicas=0, manager_spec_key="old", manager_status_key="old"),
     "WaitingForShardManagerToApplyDesiredState", True, False),
    (X0Y | dict(scaler_status_key="new", spec_replicas=0), "EnforcingDesiredState", False, True),
    (dict(spec_replicas=0, manager_spec_key="old"), "EnforcingDesiredState", False, True),
    (dict(actual_replicas=0), "EnforcingDesiredState", False, True),
    (dict(manager_spec_key="old", manager_status_key="old"), "WaitingForShardManagerToApplyDesiredState", True, False),
    (dict(manager_status_key="old"), "WaitingForShardManagerToApplyDesiredState", False, False),
    (dict(scaler_status_key="old", spec_replicas=25, actual_replicas=25), "BeginningRSControllerScaling", False, True),
    (dict(scaler_status_key=None), "BeginningRSControllerScaling", False, False),
    (dict(scaler_status_key="old", rollout_restart=True), "BeginningRSControllerScaling", False, True),
    (dict(spec_replicas=None), "EnforcingDesiredState", False, True),
    (dict(spec_replicas=2), "EnforcingDesiredState", False, True),
    (dict(actual_replicas=2), "WaitingForRSControllerToScale", False, False),
    (dict(desired_replicas=0, spec_replicas=0, actual_replicas=0), "Ready", False, False),
    (dict(desired_replicas=0, spec_replicas=0, actual_replicas=1), "WaitingForRSControllerToScale", False, False),
]


def test_ladder(spark):
    names = [part.split()[0] for part in SNAPSHOT.split(", ")]
    rows = [tuple((BASE | change | {"ref": str(i)})[n] for n in names) for i, (change, *_) in enumerate(LADDER)]
    out = control.rollout_state(spark.createDataFrame(rows, SNAPSHOT))
    got = {int(r.ref): (r.state, r.hand_over, r.scale_now) for r in out.collect()}
    assert got == {i: (state, over, now) for i, (_, state, over, now) in enumerate(LADDER)}


def test_change_log_and_counts(spark):
    t0 = datetime(2024, 1, 1)
    rows = [("a", t0 + timedelta(days=d), n) for d, n in ((0, 1), (1, 1), (9, 3), (10, 3), (30, 2))] + [("b", t0, 5)]
    df = spark.createDataFrame(rows, "target string, at timestamp, replicas int")
    changes = control.change_log(df, ["target"])
    got = sorted((r.target, (r.at - t0).days, r.from_replicas, r.to_replicas) for r in changes.collect())
    assert got == [("a", 9, 1, 3), ("a", 30, 3, 2)]
    assert [tuple(r) for r in control.change_counts(changes, ["target"]).collect()] == [("a", 2)]


def test_desired_replicas(spark):
    df = spark.createDataFrame([("r", 3), ("s", None)], "ref string, replicas int")
    assert {tuple(r) for r in control.desired_replicas(df).collect()} == {("r", 3), ("s", 0)}


PLAN_RELATIONS = [
    ("partition_shards", "partition_replicas_total_load", "longest_processing_time"),
    ("evaluation_projected_shards", "evaluation_projected_replicas_total_load", "most_wanted_two_phase_hysteresis"),
    ("evaluation_shards", "evaluation_replicas_total_load", "most_wanted_two_phase_hysteresis"),
]


@pytest.mark.parametrize("shards, loads, kind", PLAN_RELATIONS)
def test_plan_relations(spark, shards, loads, kind):
    df = spark.createDataFrame([("r", 0, "a", 2.0), ("r", 0, "b", 3.0), ("r", 1, "c", 4.0)], "ref string, replica_id int, uid string, value double")
    plan = df.select("ref", "replica_id", shard_of("uid"), "value")
    rows = getattr(observe, shards)(plan).collect()
    assert {(r.relation, r.type, r.shard_uid, r.replica_id, r.value) for r in rows} == {(shards, kind, u, n, 1.0) for u, n in (("a", 0), ("b", 0), ("c", 1))}
    totals = getattr(observe, loads)(plan)
    assert {(r.relation, r.replica_id, r.value) for r in totals.collect()} == {(loads, 0, 5.0), (loads, 1, 4.0)}
    rolled = observe.rollup(getattr(observe, shards)(plan), shards)
    assert {(r.ref, r.replica_id, r.value) for r in rolled.collect()} == {("r", 0, 2.0), ("r", 1, 1.0)}


def test_relation_names_and_rollups_agree():
    assert set(observe.RELATION_TYPES) == set(observe.ROLLUP_LABELS) and len(observe.RELATION_TYPES) == 11


def test_unknown_readiness_is_not_ready(spark):
    fields = "mode_default boolean, mode_x0y boolean, rollout_restart boolean, paused boolean, provider_ready boolean, manager_ready boolean"
    fields += ", plan_key string, manager_spec_key string, manager_status_key string, scaler_status_key string"
    fields += ", desired_replicas int, spec_replicas int, actual_replicas int"
    ready = (True, False, False, False, True, True, "k", "k", "k", "k", 1, 1, 1)
    rows = [ready, (*ready[:4], None, *ready[5:]), (*ready[:5], None, *ready[6:]), (*ready[:6], *[None] * 4, *ready[10:]), (None, None, *ready[2:])]
    states = [r.state for r in control.rollout_state(spark.createDataFrame(rows, fields)).collect()]
    assert states == ["Ready", "PartitionProviderNotReady", "ShardManagerNotReady", "PartitionProviderNotReady", "Ready"]


def test_transition_log_has_each_step_once(spark):
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    base = {
        "mode_default": True, "mode_x0y": False, "rollout_restart": True, "paused": False, "provider_ready": True, "manager_ready": True,
        "plan_key": "p", "manager_spec_key": "p", "manager_status_key": "p", "scaler_status_key": "p",
        "desired_replicas": 3, "spec_replicas": 3, "actual_replicas": 3,
    }
    zero = {"mode_default": False, "mode_x0y": True, "scaler_status_key": "old"}
    steps = [
        ("a", {}), ("a", {"scaler_status_key": "o"}), ("a", {"scaler_status_key": "o"}), ("a", {}),
        ("a", {"scaler_status_key": "o", "actual_replicas": 2}), ("a", {"spec_replicas": 5}), ("a", {"spec_replicas": 5}), ("a", {}),
        ("b", zero), ("b", {**zero, "spec_replicas": 0}), ("b", {**zero, "spec_replicas": 0, "actual_replicas": 0}),
    ]
    rows = [{"target": t, "at": at + timedelta(hours=30 * n), **base, **change} for n, (t, change) in enumerate(steps)]
    schema = "target string, at timestamp, " + ", ".join(
        f"{c} {'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'string'}" for c, v in base.items()
    )
    df = spark.createDataFrame([tuple(r[c] for c in ["target", "at", *base]) for r in rows], schema)
    found = control.transition_log(df, ["target"]).orderBy("target", "at").collect()
    assert [(r.target, r.kind, r.from_replicas, r.to_replicas, r.counted) for r in found] == [
        ("a", "restart", 3, 3, True), ("a", "scale", 2, 3, True), ("a", "enforce", 3, 3, True),
        ("b", "to_zero", 3, 0, False), ("b", "scale", 0, 3, True),
    ]
