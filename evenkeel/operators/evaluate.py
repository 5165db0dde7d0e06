"""Election of a stable plan: the most wanted one, in two phases, with hysteresis.

Only plan hashes and sizes go through the fold; ``elected_assignments`` joins the
time at which the elected plan was observed back to the plan's rows.  Time is the observation's ``at`` column, so
a replay gives the same result as the stream did.  An observation older than the
latest one of its ref is marked ``Late`` and changes nothing.

The fold is sequential within a ref, since a promotion wipes the history, and
independent between refs.  A ref with more than ``max_group_rows`` observations is
folded slice by slice, its state handed on through a stage table.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..stages import Slices, open_stage, split_by_size, stage_path, whole_groups
from .plan import EMPTY_HASH

MICROS = 1_000_000
MAX_GROUP_ROWS = 1_000_000

READY = "Ready"
AWAITING = "AwaitingNewProjection"
LATE = "Late"


@dataclass(frozen=True)
class Periods:
    """Stabilisation in seconds; the two directions fall back to the common one."""

    common: float
    scale_up: float | None = None
    scale_down: float | None = None

    @property
    def up(self) -> int:
        return int((self.common if self.scale_up is None else self.scale_up) * MICROS)

    @property
    def down(self) -> int:
        return int((self.common if self.scale_down is None else self.scale_down) * MICROS)

    @property
    def retention(self) -> int:
        return max(self.up, self.down)


@dataclass
class State:
    """``history`` maps a plan hash to [last seen, times seen]; times are micros.

    It is kept in the order of last sight, so what has expired is at its front.
    ``projection_at`` and ``elected_at`` are the observations whose rows hold the plan.
    ``ranking`` is a heap of (-times, -last, hash) whose outdated entries are dropped
    when they reach the top; ``votes`` the sum of times.  Both follow from the history.
    """

    history: dict[str, list[int]] = field(default_factory=dict)
    projection: str = EMPTY_HASH
    projection_size: int = 0
    projection_at: int | None = None
    elected: str = EMPTY_HASH
    elected_size: int = 0
    elected_at: int | None = None
    evaluated: int | None = None
    latest: int | None = None

    def __post_init__(self):
        self.forget(dict(sorted(self.history.items(), key=lambda item: item[1][0])))

    def forget(self, history: dict[str, list[int]]) -> None:
        """Start over from a history in the order of last sight."""
        self.history = history
        self.votes = sum(times for _, times in history.values())
        self.rank()

    def rank(self) -> None:
        self.ranking = [(-times, -last, plan) for plan, (last, times) in self.history.items()]
        heapq.heapify(self.ranking)

    def note(self, plan: str, at: int) -> None:
        times = self.history.pop(plan, (at, 0))[1] + 1
        self.history[plan] = [at, times]
        self.votes += 1
        heapq.heappush(self.ranking, (-times, -at, plan))
        if len(self.ranking) > 2 * len(self.history) + 100:
            self.rank()

    def expire(self, keep: int) -> None:
        """Drops what was last seen at ``keep`` or before."""
        while self.history:
            plan = next(iter(self.history))
            if self.history[plan][0] > keep:
                break
            self.votes -= self.history.pop(plan)[1]

    def winner(self) -> str | None:
        """Most often seen, then seen last, then the smaller hash."""
        while self.ranking:
            times, last, plan = self.ranking[0]
            if self.history.get(plan) == [-last, -times]:
                return plan
            heapq.heappop(self.ranking)
        return None

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def load(text: str | None) -> State:
        return State(**json.loads(text)) if text else State()


def step(state: State, at: int, plan: str, size: int, periods: Periods) -> tuple[str | None, bool, str]:
    """Take one observation into the state; returns (winner, promoted, reason)."""
    if state.latest is not None and at < state.latest:
        return None, False, LATE
    state.latest = at
    state.note(plan, at)
    state.expire(at - periods.retention)
    winner = state.winner()
    if winner == plan:
        state.projection, state.projection_size, state.projection_at = plan, size, at
    if winner != state.projection:
        return winner, False, AWAITING
    wait = periods.down if state.projection_size < state.elected_size else periods.up
    promoted = state.evaluated is None or at - state.evaluated >= wait
    if promoted:
        state.elected, state.elected_size = state.projection, state.projection_size
        state.elected_at = state.projection_at
        state.evaluated = at
        state.forget({state.elected: [at, 1]})
    return winner, promoted, READY


OUTPUT = (
    "ref string, at timestamp, plan_hash string, winner string, projection string, "
    "projection_size int, elected string, elected_size int, promoted boolean, ready boolean, "
    "reason string, last_evaluation timestamp, projection_at timestamp, elected_at timestamp, "
    "history_size int, votes bigint"
)
_TIMES = ("at", "last_evaluation", "projection_at", "elected_at")
# inside the fold the times are micros
_ROW = OUTPUT.replace("timestamp", "bigint")
_NAMES = [part.split()[0] for part in _ROW.split(", ")]


_ARROW = pa.schema(
    [(name, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}[kind])
     for name, kind in (part.split() for part in _ROW.split(", "))]
)


def _as_number(row: tuple) -> tuple:
    """An observation without time or size counts as one that compares with no other."""
    at, plan, size = row
    return math.nan if at is None else at, plan, math.nan if size is None else size


def _column(values: Iterable, kind: pa.DataType) -> pa.Array:
    return pa.array([None if v != v else v for v in values], kind)


def fold(state: State, ref: str, rows: Iterable[tuple[int, str, int]], periods: Periods) -> Iterator[tuple]:
    """One output row per observation (at, plan hash, replicas), in the given order."""
    for at, plan, size in rows:
        winner, promoted, reason = step(state, at, plan, size, periods)
        yield (
            ref,
            at,
            plan,
            winner,
            state.projection,
            state.projection_size,
            state.elected,
            state.elected_size,
            promoted,
            reason == READY,
            reason,
            state.evaluated,
            state.projection_at,
            state.elected_at,
            len(state.history),
            state.votes,
        )


def _table(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_NAMES)
    return out.astype({name: "Int64" for name in _TIMES})


def in_time_order(group: pd.DataFrame) -> Iterator[tuple[int, str, int]]:
    """A group's observations by time; equal times by hash, so that the order is fixed."""
    ordered = group.sort_values(["at_us", "plan_hash"], kind="stable")
    return zip(ordered["at_us"].tolist(), ordered["plan_hash"].tolist(), ordered["replicas"].tolist())


def as_output(folded: DataFrame) -> DataFrame:
    return folded.withColumns({name: F.timestamp_micros(name) for name in _TIMES})


def as_observations(observations: DataFrame) -> DataFrame:
    return observations.select(
        F.col("ref").cast("string").alias("ref"),
        F.unix_micros("at").alias("at_us"),
        "plan_hash",
        F.col("replicas").cast("int").alias("replicas"),
    )


def _fold_large(rows: DataFrame, periods: Periods, slice_rows: int, states: DataFrame | None) -> DataFrame:
    spark = rows.sparkSession
    slices = Slices(rows, "ref", [F.col("at_us"), F.col("plan_hash")], slice_rows, "observation-slices")
    schema = _ROW + ", state string"
    path = stage_path(spark, "evaluated")

    def fold_slice(items: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if items.empty:
            return _table([]).assign(state=None)
        state = State.load(known["state"].iloc[0] if len(known) else None)
        out = _table(list(fold(state, items["ref"].iloc[0], in_time_order(items), periods)))
        out["state"] = None
        out.loc[out.index[-1], "state"] = state.dump()
        return out

    state = states if states is not None else spark.createDataFrame([], "ref string, state string")
    paths = []
    for number in range(len(slices)):
        folded = slices.read(number).groupBy("ref").cogroup(state.groupBy("ref")).applyInPandas(fold_slice, schema)
        paths.append(f"{path}/slice={number}")
        folded.write.parquet(paths[-1])
        done = open_stage(spark, paths[-1], folded.schema)
        # the last row of a ref carries its state; refs that ended stay out
        state = done.where("state IS NOT NULL").select("ref", "state")
    return spark.read.schema(folded.schema).parquet(*paths).drop("state")


def replay(
    observations: DataFrame,
    periods: Periods,
    states: DataFrame | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Evaluate recorded observations (ref, at, plan_hash, replicas) in time order.

    ``states`` (ref, state) is an optional earlier state, as ``State.dump`` writes it.
    """
    small, large = split_by_size(as_observations(observations), "ref", max_group_rows, "observations")

    if states is None:

        def fold_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, bounds in whole_groups(batches, "ref"):
                refs, *columns = (table[name].to_pylist() for name in ("ref", "at_us", "plan_hash", "replicas"))
                out: list[tuple] = []
                for low, high in zip(bounds, bounds[1:]):
                    rows = zip(*(column[low:high] for column in columns))
                    out += fold(State(), refs[low], map(_as_number, rows), periods)
                yield pa.RecordBatch.from_arrays(
                    [_column(values, kind) for values, kind in zip(zip(*out), _ARROW.types)], schema=_ARROW
                )

        # the refs of a task follow one another in its batches
        order = [F.col(name).asc_nulls_last() for name in ("at_us", "plan_hash")]
        folded = small.repartition("ref").sortWithinPartitions("ref", *order).mapInArrow(fold_groups, _ROW)
    else:

        def fold_from(group: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            if group.empty:
                return _table([])
            state = State.load(known["state"].iloc[0] if len(known) else None)
            return _table(list(fold(state, group["ref"].iloc[0], in_time_order(group), periods)))

        folded = small.groupBy("ref").cogroup(states.groupBy("ref")).applyInPandas(fold_from, _ROW)
    if large is not None:
        folded = folded.unionByName(_fold_large(large, periods, max_group_rows, states))
    return as_output(folded)


def latest_election(evaluated: DataFrame) -> DataFrame:
    """The last row of each ref that was not late: the current status."""
    status = ["plan_hash", "winner", "projection", "projection_size", "elected", "elected_size"]
    status += ["ready", "reason", "last_evaluation", "projection_at", "elected_at"]
    newest = F.max_by(F.struct(*status), F.struct("at", "plan_hash")).alias("s")
    return (
        evaluated.where(F.col("reason") != LATE)
        .groupBy("ref")
        .agg(F.max("at").alias("at"), newest)
        .select("ref", "at", "s.*")
    )


def elected_assignments(elections: DataFrame, plans: DataFrame, which: str = "elected") -> DataFrame:
    """Rows of the elected (or projected) plan, loads as observed when it was noted.

    ``plans`` are the assignments of all observations, with their ``at`` and, where two
    plans can be observed at one time, their ``plan_hash``.
    """
    keys = ["ref", "at"] + (["plan_hash"] if "plan_hash" in plans.columns else [])
    plan_hash = F.col("projection" if which == "projection" else "elected").alias("plan_hash")
    wanted = elections.select("ref", F.col(f"{which}_at").alias("at"), plan_hash).select(*keys)
    return plans.join(wanted, keys, "left_semi").drop("at", "plan_hash")


def vote_counts(observations: DataFrame, seconds: float, step_seconds: float) -> DataFrame:
    """Votes per plan in the trailing period, on a time grid; without resets or elections.

    A vote counts at grid points from its own time on, up to but not including its time
    plus the period.  Observations are first counted per grid step, so a frequent plan
    is not sorted as a whole; each count is then offered to the grid points whose period
    covers the step, and at the last of them to those that it covers in part.
    """
    width, period = int(step_seconds * MICROS), int(seconds * MICROS)
    whole, rest = divmod(period, width)
    us = F.unix_micros("at")
    slot = F.call_function("div", us + F.lit(width - 1), F.lit(width)) * F.lit(width)
    counted = (
        observations.select("ref", "plan_hash", us.alias("us"), slot.alias("slot"))
        .groupBy("ref", "plan_hash", "slot")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("us") > F.col("slot") - F.lit(rest)).alias("late"))
    )
    offers = F.transform(
        F.sequence(F.lit(0), F.lit(whole)),
        lambda i: F.struct(
            (F.col("slot") + i * F.lit(width).cast("bigint")).alias("g"),
            F.when(i < whole, F.col("n")).otherwise(F.col("late")).alias("n"),
        ),
    )
    return (
        counted.select("ref", "plan_hash", F.explode(offers).alias("o"))
        .where("o.n > 0")
        .groupBy("ref", "plan_hash", F.timestamp_micros("o.g").alias("at"))
        .agg(F.sum("o.n").alias("votes"))
    )
