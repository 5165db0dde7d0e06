import hashlib
import random
import time
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import evaluate
from evenkeel.operators.evaluate import AWAITING, LATE, MICROS, READY, Periods, State, step
from evenkeel.plans.catalog import QUERIES
from evenkeel.plans.oracles import ORACLES
from evenkeel.streaming import elect_stream

T0 = datetime(2024, 1, 1)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plan(n: int) -> tuple[str, int]:
    """A plan of n replicas with one shard each."""
    return sha(",".join(f"shard-{i}={i}" for i in range(n))), n


def see(state, seconds, n, periods):
    return step(state, int(seconds * MICROS), *plan(n), periods)


def test_first_observation_promotes_and_the_second_only_counts():
    state, periods = State(), Periods(300)
    assert see(state, 0, 1, periods) == (plan(1)[0], True, READY)
    assert state.elected == state.projection == plan(1)[0] and len(state.history) == 1
    assert see(state, 6, 1, periods)[1:] == (False, READY)
    assert state.history[plan(1)[0]] == [6 * MICROS, 2] and state.evaluated == 0


def test_unknown_leader_must_be_outvoted():
    now = 10_000
    state = State(
        history={"old": [(now - 3600) * MICROS, 2**31 - 1], "unknown": [now * MICROS, 3]},
        projection=plan(1)[0],
        projection_size=1,
    )
    reasons = [see(state, now + 6 * i, 1, Periods(300))[2] for i in range(3)]
    assert reasons == [AWAITING, AWAITING, READY]
    assert list(state.history) == [plan(1)[0]] and state.history[plan(1)[0]][1] == 1


@pytest.mark.parametrize("have, seen, elected", [(1, 2, 2), (2, 1, 2)])
def test_growing_is_quicker_than_shrinking(have, seen, elected):
    state = State(elected=plan(have)[0], elected_size=have, evaluated=0, latest=0)
    see(state, 120, seen, Periods(86_400, scale_up=60, scale_down=3600))
    assert (state.elected, state.projection) == (plan(elected)[0], plan(seen)[0])


def test_no_retention_never_elects():
    state = State()
    assert see(state, 0, 1, Periods(0)) == (None, False, AWAITING)
    assert state.elected == evaluate.EMPTY_HASH and not state.history


def test_ties_go_to_the_later_and_then_the_smaller_hash():
    state = State(history={"b": [5, 1], "a": [5, 1]}, evaluated=0, latest=0)
    assert step(state, 6, "c", 1, Periods(100))[0] == "c"
    state = State(history={"b": [6, 1], "a": [6, 1]}, evaluated=0, latest=0)
    assert step(state, 6, "c", 1, Periods(100))[0] == "a"


A, B = sha("A=0"), sha("A=0,B=1")
TRACE = [
    (0, A, A, A, True, [1]), (10, B, B, A, False, [1, 1]), (20, B, B, A, False, [1, 2]), (30, A, A, A, False, [2, 2]),
    (40, B, B, A, False, [2, 3]), (70, B, B, B, True, [1]), (80, A, A, B, False, [1, 1]), (90, A, A, B, False, [1, 2]),
    (100, A, A, B, False, [1, 3]), (110, A, A, B, False, [1, 4]), (120, A, A, B, False, [1, 5]),
    (140, A, A, B, False, [1, 6]), (190, A, A, A, True, [1]), (200, A, A, A, False, [2]),
]
TRACE_PERIODS = Periods(60, 60, 120)


def test_trace():
    state = State()
    for at, seen, projection, elected, promoted, votes in TRACE:
        _, up, reason = step(state, at * MICROS, seen, 1 if seen == A else 2, TRACE_PERIODS)
        assert (state.projection, state.elected, up, reason) == (projection, elected, promoted, READY)
        assert sorted(r[1] for r in state.history.values()) == votes
        state = State.load(state.dump())


def observations(spark, rows):
    rows = [(ref, T0 + timedelta(seconds=at), h, n) for ref, at, h, n in rows]
    return spark.createDataFrame(rows, "ref string, at timestamp, plan_hash string, replicas int")


def random_rows(seed, refs):
    rng = random.Random(seed)
    return [
        (ref, t, *plan(rng.choice([1, 2, 2, 3])))
        for ref, n in refs
        for t in sorted(rng.sample(range(3000), n))
    ]


def test_replay_equals_the_fold_whole_and_sliced(spark):
    rows = random_rows(4, [("long", 150), ("short", 5), ("other", 60)])
    periods = Periods(100, 50, 200)
    want = []
    for ref in ("long", "short", "other"):
        state = State()
        for r, at, h, n in rows:
            if r == ref:
                winner, up, reason = step(state, at * MICROS, h, n, periods)
                want.append((ref, at, winner, state.projection, state.elected, up, reason, sum(x[1] for x in state.history.values())))
    df = observations(spark, rows).repartition(4)
    for limit in (1000, 20):
        out = evaluate.replay(df, periods, max_group_rows=limit).collect()
        got = [(r.ref, int((r.at - T0).total_seconds()), r.winner, r.projection, r.elected, r.promoted, r.reason, r.votes) for r in out]
        assert sorted(got) == sorted(want), limit


def test_replay_goes_on_from_a_state(spark):
    rows = random_rows(9, [("x", 80)])
    whole = {r.at: tuple(r) for r in evaluate.replay(observations(spark, rows), TRACE_PERIODS).collect()}
    state = State()
    list(evaluate.fold(state, "x", [(at * MICROS + int(T0.timestamp()) * MICROS, h, n) for _, at, h, n in rows[:30]], TRACE_PERIODS))
    start = spark.createDataFrame([("x", state.dump())], "ref string, state string")
    for limit in (1000, 20):
        out = evaluate.replay(observations(spark, rows[30:]), TRACE_PERIODS, states=start, max_group_rows=limit)
        assert {r.at: tuple(r) for r in out.collect()} == {at: r for at, r in whole.items() if at >= T0 + timedelta(seconds=rows[30][1])}


def test_stream_equals_replay_and_marks_late_rows(spark, tmp_path):
    rows = [("r", at, h, 1 if h == A else 2) for at, h, *_ in TRACE] + random_rows(6, [("s", 40)])
    df = observations(spark, rows)
    want = {(r.ref, r.at): tuple(r) for r in evaluate.replay(df, TRACE_PERIODS).collect()}
    source = str(tmp_path / "in")
    for low, high in ((0, 100), (100, 900), (900, 4000)):
        edge = [T0 + timedelta(seconds=s) for s in (low, high)]
        df.where((df.at >= edge[0]) & (df.at < edge[1])).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)
    observations(spark, [("r", 5, A, 1)]).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        elect_stream(stream, TRACE_PERIODS)
        .writeStream.format("memory")
        .queryName("elections")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    out = spark.table("elections").collect()
    late = [r for r in out if r.reason == LATE]
    assert [(r.ref, r.at, r.ready, r.winner) for r in late] == [("r", T0 + timedelta(seconds=5), False, None)]
    assert {(r.ref, r.at): tuple(r) for r in out if r.reason != LATE} == want


def test_latest_election_and_its_rows(spark):
    out = evaluate.replay(observations(spark, [("r", at, h, 1 if h == A else 2) for at, h, *_ in TRACE[:8]]), TRACE_PERIODS)
    last = evaluate.latest_election(out)
    row = last.first()
    assert (row.elected, row.projection) == (B, A)
    plans = spark.createDataFrame(
        [("r", T0 + timedelta(seconds=at), 0, f"{at}") for at, *_ in TRACE], "ref string, at timestamp, replica_id int, note string"
    )
    assert [r.note for r in evaluate.elected_assignments(last, plans).collect()] == ["70"]
    assert [r.note for r in evaluate.elected_assignments(last, plans, "projection").collect()] == ["90"]


def test_vote_counts(spark):
    rows = [("r", at, h, 1) for at, h in ((0, "a"), (10, "a"), (59, "b"), (60, "a"), (61, "a"))]
    out = evaluate.vote_counts(observations(spark, rows), 120, 60)
    got = {(r.plan_hash, int((r.at - T0).total_seconds())): r.votes for r in out.collect()}
    assert got == {("a", 0): 1, ("a", 60): 3, ("a", 120): 3, ("a", 180): 1, ("b", 60): 1, ("b", 120): 1}


@pytest.mark.parametrize("seconds, step_seconds", [(90, 60), (30, 60), (60, 60), (125, 10)])
def test_votes_of_any_period(spark, seconds, step_seconds):
    rng = random.Random(seconds)
    seen = [(rng.randint(0, 400), rng.choice("ab")) for _ in range(60)]
    out = evaluate.vote_counts(observations(spark, [("r", at, h, 1) for at, h in seen]), seconds, step_seconds)
    got = {(r.plan_hash, int((r.at - T0).total_seconds())): r.votes for r in out.collect()}
    want = {}
    for g in range(0, 700, step_seconds):
        for at, h in seen:
            if at <= g < at + seconds:
                want[h, g] = want.get((h, g), 0) + 1
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_ranking_equals_a_search_of_the_whole_history(seed):
    rng = random.Random(seed)
    periods, state, at, history = Periods(40, scale_up=25), State(), 0, {}
    for n in range(2000):
        at += rng.choice([0, 0, 1, 1, 2, 30])
        name = f"p{rng.randint(0, 12)}"
        micros = at * MICROS
        history[name] = [micros, history.get(name, [micros, 0])[1] + 1]
        history = {h: r for h, r in history.items() if r[0] > micros - periods.retention}
        want = min(history, key=lambda h: (-history[h][1], -history[h][0], h))
        winner, promoted, _ = step(state, micros, name, rng.randint(1, 3), periods)
        assert winner == want
        if promoted:
            history = {state.elected: [micros, 1]}
        assert state.history == history and state.votes == sum(r[1] for r in history.values())
        if n % 97 == 0:
            state = State.load(state.dump())


def test_distinct_plans_take_linear_time():
    state, periods = State(evaluated=0, elected=sha("x"), elected_size=1), Periods(10**9)
    began = time.process_time()
    for at in range(100_000):
        step(state, at, f"{at:064x}", 1, periods)
    assert len(state.history) == 100_000 and time.process_time() - began < 20


def test_small_refs_share_a_call(spark, capsys):
    rows = [(None if n % 30 == 0 else f"r{n % 30}", n, "ab"[n * 7 % 2], n % 3 + 1) for n in range(300)]
    df = observations(spark, rows)
    out = evaluate.replay(df, TRACE_PERIODS)
    out.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    # by the way taken with earlier states, each ref is a call of its own
    none = spark.createDataFrame([], "ref string, state string")
    apart = evaluate.replay(df, TRACE_PERIODS, states=none)
    assert sorted(map(str, out.collect())) == sorted(map(str, apart.collect()))


def test_replay_elects_among_several_plans(spark, tmp_path):
    # three plans of one replica, a larger one, the first again: all within a day
    windows = [*[(n, ["click"]) for n in range(3)], (3, ["click", "view", "error"]), (4, ["click"])]
    rows = [
        (n, 7, kind, 0.0 if kind == "error" else 10.0, "{}", (T0 + timedelta(hours=6 * n + 1)).isoformat(sep=" "))
        for n, kinds in windows
        for kind in kinds
    ]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string, ts string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    shown = QUERIES["evaluation_replay"](spark, str(tmp_path))
    found = shown.orderBy("at").collect()
    assert len(found) == len(windows)
    one, larger = found[0].plan_hash, found[3].plan_hash
    assert one != larger and [r.plan_hash for r in found] == [one] * 3 + [larger, one]
    # the larger plan is outvoted, and a promotion, after a day, wipes the votes
    assert [r.winner for r in found] == [r.elected for r in found] == [one] * 5
    assert [r.promoted for r in found] == [True, False, False, False, True]
    assert [r.votes for r in found] == [1, 2, 3, 4, 1]
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    result = con.execute(ORACLES["evaluation_replay"])
    assert shown.columns == [d[0] for d in result.description]
    assert sorted(map(tuple, found)) == sorted(result.fetchall())
