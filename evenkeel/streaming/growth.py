"""Counter growth and sliding quantiles as streams with their own state and event-time timers."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .election import ROCKSDB


def _grid(us: int, step: int) -> int:
    return -(-us // step) * step


def _millis(us: int) -> int:
    """The first millisecond at or after an instant: watermarks have no finer ones."""
    return -(-us // 1000)


class _PerSeries(StatefulProcessor):
    """Rows of one key wait until the watermark has passed them, then are taken in time order.

    A key has one timer, for the earliest instant at which something of it is due; when it
    goes off, all that the watermark has passed is settled and the next one is set.
    """

    def __init__(self, keys: list[str], step: int):
        self.keys, self.step = keys, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alarm = handle.getValueState("alarm", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # one micro-batch of one key, bounded by the source's trigger limits
        found = [(r.us, math.nan if r.value is None else r.value) for r in rows]
        self.keep(found)
        due, alarm = _millis(_grid(min(us for us, _ in found), self.step)), self.alarm.get()
        if alarm is None or due < alarm[0]:
            if alarm is not None:
                self.handle.deleteTimer(alarm[0])
            self.handle.registerTimer(due)
            self.alarm.update((due,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        points, due = self.settle(timerValues.getCurrentWatermarkInMs() * 1000)
        if due is None:
            self.alarm.clear()
        else:
            self.handle.registerTimer(_millis(due))
            self.alarm.update((_millis(due),))
        if points:
            yield Row(**dict(zip(self.keys, key)), points=[Row(g=g, value=None if v != v else v) for g, v in points])

    def close(self) -> None:
        pass


class Growth(_PerSeries):
    """``waiting`` samples, the ``last`` one settled, and the growth of the grid points still ``open``."""

    def __init__(self, keys: list[str], step: int, span: int):
        super().__init__(keys, step)
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "us bigint, value double")
        self.last = handle.getValueState("last", "us bigint, value double")
        self.open = handle.getMapState("open", "g bigint", "grown double")

    def keep(self, samples: list[tuple]) -> None:
        self.waiting.appendList(samples)

    def settle(self, mark: int) -> tuple[list[tuple], int | None]:
        """The grid points that are closed, and when something is due next."""
        waiting = sorted((r[0], r[1]) for r in self.waiting.get())
        due = [s for s in waiting if s[0] <= mark]
        left = waiting[len(due) :]
        if due:
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
        last = self.last.get()
        last = tuple(last) if last is not None else None
        added: dict = {}
        for us, value in due:
            if last and last[0] > us - self.span:
                grown = value if value < last[1] else value - last[1]
                for g in range(_grid(us, self.step), last[0] + self.span, self.step):
                    added[g] = added.get(g, 0.0) + grown
            last = (us, value)
        known = {r[0][0]: r[1][0] for r in self.open.iterator()}
        sums = dict(known)
        for g, grown in added.items():
            sums[g] = sums.get(g, 0.0) + grown
            if g > mark:
                self.open.updateValue((g,), (sums[g],))
        for g in known:
            if g <= mark:
                self.open.removeKey((g,))
        ahead = [g for g in sums if g > mark] + ([_grid(left[0][0], self.step)] if left else [])
        if last and last[0] + self.span <= mark and not left:
            self.last.clear()  # too old for any range: an idle series leaves nothing behind
        elif last:
            if due:
                self.last.update(last)
            if last[0] + self.span > mark:
                ahead.append(last[0] + self.span)
        return sorted((g, v) for g, v in sums.items() if g <= mark), min(ahead, default=None)


class SlidingQuantile(_PerSeries):
    """One partial state a step: the step's value.  A window is put together from those it covers."""

    def __init__(self, keys: list[str], step: int, window: int, q: float):
        super().__init__(keys, step)
        self.window, self.q = window, q

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.steps = handle.getMapState("steps", "g bigint", "value double")
        self.done = handle.getValueState("done", "g bigint")

    def keep(self, values: list[tuple]) -> None:
        for us, value in values:
            self.steps.updateValue((us,), (value,))

    def settle(self, mark: int) -> tuple[list[tuple], int | None]:
        steps = {r[0][0]: r[1][0] for r in self.steps.iterator()}
        if not steps:
            return [], None
        done = self.done.get()[0] if self.done.exists() else min(steps) - self.step
        last = mark // self.step * self.step
        points = []
        for end in range(done + self.step, min(last, max(steps) + self.window - self.step) + 1, self.step):
            inside = [steps[g] for g in range(end - self.window + self.step, end + 1, self.step) if g in steps]
            if inside:
                points.append((end, _interpolated(sorted(inside), self.q)))
        if last > done:
            self.done.update((last,))
        left = [g for g in steps if g + self.window > last + self.step]
        for g in steps.keys() - set(left):
            self.steps.removeKey((g,))
        if left:
            return points, max(last, min(left) - self.step) + self.step
        self.done.clear()
        return points, None


def _interpolated(ordered: list[float], q: float) -> float:
    place = (len(ordered) - 1) * q
    low, high = math.floor(place), math.ceil(place)
    if low == high:
        return ordered[low]
    return (high - place) * ordered[low] + (place - low) * ordered[high]


def _micros(seconds: float) -> int:
    return int(round(seconds * 1_000_000))


def _run(rows: DataFrame, keys: list[str], processor: _PerSeries) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    point = T.StructType([T.StructField("g", T.LongType()), T.StructField("value", T.DoubleType())])
    fields = [rows.schema[k] for k in keys] + [T.StructField("points", T.ArrayType(point))]
    out = rows.groupBy(*keys).transformWithState(
        statefulProcessor=processor, outputStructType=T.StructType(fields), outputMode="Append", timeMode="EventTime"
    )
    return out.select(*keys, F.inline("points")).select(*keys, F.timestamp_micros("g").alias("grid_ts"), "value")


def growth_stream(samples: DataFrame, keys: list[str], step_seconds: float, range_seconds: float, delay: str) -> DataFrame:
    """(keys, grid_ts, value): ``timeseries.increase`` of a stream of (keys, ts, value), each grid point once.

    A grid point comes out when the watermark, ``delay`` behind the latest sample, has passed it.  Samples may
    come in any order within the delay; those behind the watermark are late and are left out (Spark
    counts them as ``numRowsDroppedByWatermark``).  A series keeps its samples ahead of the watermark, the last
    one behind it, and a sum for each grid point that is still open; once idle for a range, nothing.
    """
    rows = samples.withWatermark("ts", delay).select(
        *keys, "ts", F.unix_micros("ts").alias("us"), F.col("value").cast("double").alias("value")
    )
    return _run(rows, keys, Growth(keys, _micros(step_seconds), _micros(range_seconds)))


def sliding_quantile_stream(steps: DataFrame, keys: list[str], q: float, window_seconds: float, step_seconds: float) -> DataFrame:
    """(keys, grid_ts, value): quantile of the steps' values in each window (grid_ts - window, grid_ts] that has one.

    ``steps`` has (keys, grid_ts, ts, value), one value a step (a second one replaces the
    first), and a watermark on ``ts``.  The state grows with the steps of a window, not with its square.
    """
    rows = steps.select(*keys, "ts", F.unix_micros("grid_ts").alias("us"), F.col("value").cast("double").alias("value"))
    return _run(rows, keys, SlidingQuantile(keys, _micros(step_seconds), _micros(window_seconds), q))
