"""The polls of many strategies from one scan of the samples.

Windows, steps, ranges and quantiles are columns, a row for each ref.  What two strategies read
of a series in the same way is worked out once: a *reading* is a series with its kind,
window, step and reach.  Each sample finds its neighbours in one shuffle by series id; a
gauge serves the grid points up to its successor, a counter's growth since its predecessor
goes to the grid points whose range holds both.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schemas import SCALE
from ..sources.samples import utc
from ..sources.series import SeriesStore, qualifying
from ..sources.strategies import StrategyTables, specs_of
from ..sources.strategy import BINDINGS
from ..stages import publish
from . import validate as v
from .adjacent import in_chunks
from .poll import answered
from .timeseries import CHUNK, _grid_at_or_after, instant_literal, to_edges

READING = ["kind", "window", "step", "reach", "extrapolate"]


def _us(seconds: str) -> Column:
    return F.round(F.col(seconds) * 1_000_000).cast("bigint")


def uses(store: SeriesStore, tables: StrategyTables, namespace: str = "namespace", pod: str = "pod") -> DataFrame:
    """The series each metric reads, by label and reading: ref, metric_id, sid, metric, namespace, bound, pod, READING."""
    counter = F.col("kind") == "counter"
    settings = tables.settings.select(
        "ref", _us("window_s").alias("window"), _us("step_s").alias("step"), _us("range_s").alias("range"),
        _us("lookback_s").alias("lookback"), F.coalesce("extrapolate", F.lit(False)).alias("extrapolate"),
    )
    metrics = tables.metrics.join(settings, "ref").select(
        "ref", "metric_id", "label", "kind", "window", "step", F.when(counter, F.col("range")).otherwise(F.col("lookback")).alias("reach"),
        (counter & F.col("extrapolate")).alias("extrapolate"),
    )
    # stored, so that the joins know how small it is: an estimate multiplies the sizes of the two tables
    metrics = publish(metrics, "fleet-metrics")
    labels = F.col("labels")
    return (
        qualifying(store.listing, tables.conditions())
        .join(store.series, "sid")
        .join(metrics, ["ref", "metric_id"])
        .select("ref", "metric_id", "sid", "metric", labels[namespace].alias("namespace"), labels[F.col("label")].alias("bound"), labels[pod].alias("pod"), *READING)
    )


def _up_to(samples: DataFrame, as_of: datetime, far: int) -> DataFrame:
    """Samples of the ``far`` microseconds before ``as_of``; of a table stored by day, only these folders."""
    end, back = utc(as_of), timedelta(microseconds=far)
    rows = samples.where((F.col("ts") > instant_literal(as_of - back)) & (F.col("ts") <= instant_literal(as_of)))
    if "day" in samples.columns:
        rows = rows.where(F.col("day").between(F.lit((end - back).date()), F.lit(end.date())))
    return rows


def within_reach(samples: DataFrame, tables: StrategyTables, as_of: datetime) -> DataFrame:
    """Samples that some metric may read at ``as_of``: those it names, as far back as any window and range go.

    What a run has no use for need not be listed for it; ``reading_vectors`` would leave these samples out.
    """
    back = _us("window_s") + F.greatest(_us("range_s"), _us("lookback_s"))
    far = tables.settings.agg(F.max(back)).first()[0]
    if far is None:
        return samples.where(F.lit(False))
    names = publish(tables.metrics.select(F.coalesce("sample", "metric_id").alias("metric")).distinct(), "fleet-names")
    return _up_to(samples, as_of, far).join(names, "metric", "left_semi")


def reading_vectors(samples: DataFrame, readings: DataFrame, as_of: datetime) -> DataFrame:
    """Grid values of readings (sid, metric, READING): the same with g (micros) and value.

    Samples of one series and time count once, the largest value.
    """
    bounds = readings.agg(F.max(F.col("window") + F.col("reach")).alias("far"), F.max(F.greatest("reach", "step")).alias("reach")).first()
    if bounds["far"] is None:
        return readings.select("sid", *READING, F.lit(None).cast("bigint").alias("g"), F.lit(None).cast("double").alias("value"))
    rows = _up_to(samples, as_of, bounds["far"])
    # the few names first, so that samples of other metrics are given no id
    names = publish(readings.select("metric").distinct(), "fleet-names")
    rows = rows.join(names, "metric", "left_semi").join(readings, ["metric", "sid"], "left_semi").select("sid", F.unix_micros("ts").alias("us"), F.col("value").cast("double").alias("value"))
    # a sample reaches as far as any reading does, so a chunk holds all neighbours that matter
    chunk = CHUNK * bounds["reach"]
    split = in_chunks(rows, ["sid"], "us", chunk, bounds["reach"])
    split = split.groupBy("sid", "chunk", "us").agg(F.max("value").alias("value"), F.max("own").alias("own"))
    here = Window.partitionBy("sid", "chunk").orderBy("us")
    known = split.select(
        "sid", "chunk", "us", "value", "own", F.lag("us").over(here).alias("prev_us"), F.lag("value").over(here).alias("prev_value"),
        F.lead("us").over(here).alias("next_us"),
    )
    both = known.join(readings.select("sid", *READING), "sid")
    counter, step, reach, us = F.col("kind") == "counter", F.col("step"), F.col("reach"), F.col("us")
    first = _grid_at_or_after(us, step)
    pair = counter & F.col("own") & (F.col("prev_us") > us - reach)
    gauge_low = F.greatest(first, _grid_at_or_after(F.col("chunk") * chunk, step))
    gauge_high = F.least(us + reach - 1, F.col("next_us") - 1, (F.col("chunk") + 1) * chunk - 1)
    now = F.unix_micros(instant_literal(as_of))
    low = F.greatest(F.when(counter, first).otherwise(gauge_low), _grid_at_or_after(now - F.col("window") + 1, step))
    high = F.least(F.when(counter, F.col("prev_us") + reach - 1).otherwise(gauge_high), now)
    points = F.when((~counter | pair) & (low <= high), F.sequence(low, high, step))
    grown = F.when(F.col("value") < F.col("prev_value"), F.col("value")).otherwise(F.col("value") - F.col("prev_value"))
    added = F.when(counter, grown).otherwise(F.col("value"))
    offered = both.select("sid", *READING, F.explode(points).alias("g"), us.alias("us"), "prev_us", "prev_value", added.alias("added"))
    # a gauge has one sample for each point, a counter any number of pairs
    sums = offered.groupBy("sid", *READING, "g").agg(
        F.sum("added").alias("grown"), F.count("prev_us").alias("gaps"), F.min("prev_us").alias("first_us"),
        F.max("us").alias("last_us"), F.min_by("prev_value", "prev_us").alias("first_value"),
    )
    value = F.when(F.col("extrapolate"), to_edges(reach)).otherwise(F.col("grown"))
    return sums.select("sid", *READING, "g", value.alias("value"))


def quantile_of(values: Column, q: Column) -> Column:
    """Linearly interpolated quantile of an array, with the quantile as a column."""
    ordered = F.array_sort(values)
    place = (F.size(values) - 1) * F.greatest(F.least(q, F.lit(1.0)), F.lit(0.0))
    low, high = F.floor(place).cast("int"), F.ceil(place).cast("int")
    below, above = F.get(ordered, low), F.get(ordered, high)
    return F.when(low == high, below).otherwise((high - place) * below + (place - low) * above)


def fleet_vectors(store: SeriesStore, tables: StrategyTables, as_of: datetime) -> DataFrame:
    """Each metric's expression at ``as_of``: ref, metric_id, namespace, bound, value.  One scan of the samples."""
    used = publish(uses(store, tables), "fleet-uses")
    readings = publish(used.select("metric", "sid", *READING).distinct(), "fleet-readings")
    vectors = reading_vectors(store.samples, readings, as_of)
    keys = ["ref", "metric_id", "namespace", "bound"]
    pods = used.join(vectors, ["sid", *READING]).groupBy(*keys, "pod", "g").agg(F.sum("value").alias("value"))
    peaks = pods.groupBy(*keys, "g").agg(F.max("value").alias("value"))
    # a group has one value for each grid point of its window
    points = peaks.groupBy(*keys).agg(F.collect_list("value").alias("points")).join(tables.settings.select("ref", "quantile"), "ref")
    return points.select(*keys, quantile_of(F.col("points"), F.col("quantile")).alias("value"))


def fleet_poll(shards: DataFrame, store: SeriesStore, tables: StrategyTables, as_of: datetime, scale: int = SCALE) -> DataFrame:
    """Metric values of all refs, each by its own strategy; as ``poll.poll`` gives them."""
    return answered(specs_of(shards, tables), fleet_vectors(store, tables, as_of), scale)


def malformed(tables: StrategyTables) -> tuple[DataFrame, DataFrame]:
    """Violations of the poll's and of the load index's specs: ids listed twice, weights that are no numbers, p not positive."""
    polls = v.duplicate_ids(tables.metrics, "poll", v.MALFORMED_POLL)
    unbound = tables.metrics.where(~F.coalesce("bind", F.lit("")).isin(*BINDINGS))
    polls = polls.unionByName(v.violations(unbound, "poll", v.MALFORMED_POLL, F.concat(F.lit("unknown binding of "), F.col("metric_id"))))
    weights = v.duplicate_ids(tables.weights, "load_index", v.MALFORMED_WEIGHTS)
    wrong = tables.weight_numbers().where("weight IS NULL")
    weights = weights.unionByName(v.violations(wrong, "load_index", v.MALFORMED_WEIGHTS, F.concat(F.lit("not a quantity: weight of "), F.col("metric_id"))))
    flat = tables.settings.where("p IS NULL OR p <= 0")
    return polls, weights.unionByName(v.violations(flat, "load_index", v.MALFORMED_WEIGHTS, F.lit("p must be positive")))
