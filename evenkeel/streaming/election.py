"""The election as a stateful stream: the same step as the replay, state per ref and plan hash."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import fields

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.evaluate import _NAMES, _ROW, Periods, State, _as_number, as_observations, as_output, fold

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a ref keeps beside its history: fixed in size.
_HEAD = (
    "projection string, projection_size int, projection_at bigint, elected string, elected_size int, "
    "elected_at bigint, evaluated bigint, latest bigint"
)
_HEAD_NAMES = [f.name for f in fields(State) if f.name != "history"]


def _by_time(observation: tuple) -> tuple:
    """The order of the replay: by time, equal times by hash, nulls last."""
    at, plan, _ = observation
    return at is None, at or 0, plan is None, plan or ""


class Election(StatefulProcessor):
    """``head`` holds the projection and the elected plan of a ref, ``seen`` last sight and votes by plan hash.

    A batch reads a ref's history once and writes the entries that it changed: what it
    writes grows with the batch.  With ``timers``, a ref that is no longer observed loses
    what the watermark shows to be out of every later period; its head stays.
    """

    def __init__(self, periods: Periods, timers: bool = False):
        self.periods, self.timers = periods, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", _HEAD)
        self.seen = handle.getMapState("seen", "plan_hash string", "last bigint, times bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # most refs have few rows in a batch: plain rows, and as few calls to the state as can be
        head = self.head.get()
        state = State()
        if head is not None:
            state = State({plan[0]: list(entry) for plan, entry in self.seen.iterator()}, **dict(zip(_HEAD_NAMES, head)))
        before = dict(state.history)
        # one micro-batch of one ref, bounded by the source's trigger limits
        batch = map(_as_number, sorted(((r.at_us, r.plan_hash, r.replicas) for r in rows), key=_by_time))
        folded = fold(state, key[0], batch, self.periods)
        out = [Row(**{name: None if v != v else v for name, v in zip(_NAMES, row)}) for row in folded]
        for plan in before.keys() - state.history.keys():
            self.seen.removeKey((plan,))
        for plan, entry in state.history.items():
            if before.get(plan) is not entry:  # every sight makes a new entry
                self.seen.updateValue((plan,), tuple(entry))
        self.head.update(tuple(getattr(state, name) for name in _HEAD_NAMES))
        if self.timers:
            self.handle.registerTimer(-(-(state.latest + self.periods.retention) // 1000))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # an observation that still counts is at the watermark or after it
        keep = timerValues.getCurrentWatermarkInMs() * 1000 - self.periods.retention
        for plan in [plan for plan, entry in self.seen.iterator() if entry[0] <= keep]:
            self.seen.removeKey(plan)
        return iter(())

    def close(self) -> None:
        pass


def elect_stream(observations: DataFrame, periods: Periods, delay: str | None = None) -> DataFrame:
    """Evaluate a stream of observations (ref, at, plan_hash, replicas).

    Bound the source's batches (``maxFilesPerTrigger``).  Observations of a batch are
    taken in time order; one older than an earlier batch comes out as ``Late``.

    With a ``delay`` the stream has a watermark that far behind its latest observation:
    histories of refs that went silent are cleared by timers, and observations behind the
    watermark are left out instead of marked.
    """
    conf = observations.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = as_observations(observations)
    if delay is not None:
        rows = rows.withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", delay)
    folded = rows.groupBy("ref").transformWithState(
        statefulProcessor=Election(periods, timers=delay is not None),
        outputStructType=_ROW,
        outputMode="Append",
        timeMode="None" if delay is None else "EventTime",
    )
    return as_output(folded)
