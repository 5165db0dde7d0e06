"""Time-series operators over sample tables.

``keys`` names the columns that identify a series.  Evaluation times lie on a grid
of multiples of ``step_seconds`` in (start, end].  Ranges are left-open.  Every
operator is a hash aggregate with map-side combine, or a window over a bounded
slice of a series, so that a series holding much of the data stays spread out.
"""

from __future__ import annotations

import math
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window, functions as F

from .adjacent import in_chunks, with_previous_within

MICROS = 1_000_000
#: Ranges, or steps, of a series that are sorted together.
CHUNK = 10


def _micros(seconds: float) -> int:
    return int(round(seconds * MICROS))


def instant_literal(at: datetime) -> Column:
    """A time literal; a time without a zone is UTC."""
    return F.lit(at if at.tzinfo else at.replace(tzinfo=timezone.utc))


def _us(at: datetime) -> Column:
    return F.unix_micros(instant_literal(at))


def _grid_at_or_after(us: Column, step: int | Column) -> Column:
    # div is exact on bigint, / would go through double
    step = F.lit(step) if isinstance(step, int) else step
    return F.call_function("div", us + step - F.lit(1), step) * step


def _on_grid(first: Column, until: Column, start: datetime, end: datetime, step: int) -> Column:
    """Grid points g with first <= g <= until inside (start, end], as an array."""
    low = F.greatest(first, _grid_at_or_after(_us(start) + F.lit(1), step))
    high = F.least(until, _us(end))
    return F.when(low <= high, F.sequence(low, high, F.lit(step)))


def _grid_time(df: DataFrame) -> DataFrame:
    return df.withColumn("grid_ts", F.timestamp_micros("g")).drop("g")


def instant_vector(
    samples: DataFrame,
    keys: list[str],
    start: datetime,
    end: datetime,
    step_seconds: float = 60,
    lookback_seconds: float = 300,
    ts: str = "ts",
    value: str = "value",
) -> DataFrame:
    """Latest sample of each series at or before each grid point, within the lookback.

    Samples are first reduced to one per series and step.  Each survivor serves the grid
    points up to its successor, so that no point is offered two: what is shuffled
    does not grow with the lookback.
    """
    step, lookback = _micros(step_seconds), _micros(lookback_seconds)
    reach = start - timedelta(seconds=lookback_seconds)
    rows = samples.where((F.col(ts) > instant_literal(reach)) & (F.col(ts) <= instant_literal(end))).select(
        *keys, F.unix_micros(ts).alias("us"), F.col(value).alias("value")
    )
    first = _grid_at_or_after(F.col("us"), step)
    slots = rows.groupBy(*keys, first.alias("first")).agg(
        F.max("us").alias("us"), F.max_by("value", "us").alias("value")
    )
    until = F.col("us") + F.lit(lookback - 1)
    if lookback <= step:
        points = _on_grid(F.col("first"), until, start, end, step)
        return _grid_time(slots.select(*keys, F.explode(points).alias("g"), "value"))
    chunk = CHUNK * lookback
    rows = in_chunks(slots, keys, "us", chunk, lookback - 1)
    following = F.lead("first").over(Window.partitionBy(*keys, "chunk").orderBy("us"))
    rows = rows.select(*keys, "chunk", "us", "value", "first", following.alias("next_first"))
    low = F.greatest("first", F.col("chunk") * F.lit(chunk))
    # the last one of a chunk has no successor there; least skips nulls
    high = F.least(until, F.col("next_first") - F.lit(1), (F.col("chunk") + F.lit(1)) * F.lit(chunk) - F.lit(1))
    points = _on_grid(_grid_at_or_after(low, step), high, start, end, step)
    return _grid_time(rows.select(*keys, F.explode(points).alias("g"), "value"))


def instant(
    samples: DataFrame,
    keys: list[str],
    at: datetime,
    lookback_seconds: float = 300,
    ts: str = "ts",
    value: str = "value",
) -> DataFrame:
    """The instant vector at one time."""
    since = at - timedelta(seconds=lookback_seconds)
    return (
        samples.where((F.col(ts) > instant_literal(since)) & (F.col(ts) <= instant_literal(at)))
        .groupBy(*keys)
        .agg(F.max_by(value, ts).alias("value"))
    )


def sum_by(vector: DataFrame, by: list[str]) -> DataFrame:
    """Sum of the series that share the kept labels, per grid point."""
    return vector.groupBy(*by, "grid_ts").agg(F.sum("value").alias("value"))


def max_over_series(vector: DataFrame, by: list[str]) -> DataFrame:
    """Largest of the series that share the kept labels, per grid point."""
    return vector.groupBy(*by, "grid_ts").agg(F.max("value").alias("value"))


def increase(
    samples: DataFrame,
    keys: list[str],
    start: datetime,
    end: datetime,
    step_seconds: float = 60,
    range_seconds: float = 60,
    extrapolate: bool = False,
    chunk_seconds: float | None = None,
    ts: str = "ts",
    value: str = "value",
) -> DataFrame:
    """Counter growth inside (g - range, g] for each grid point g.

    A drop between neighbours is a counter reset: the new reading counts as growth
    from zero.  At least two samples must lie in the range.  ``extrapolate`` widens
    the growth to the edges of the range in the way Prometheus documents.  A series is
    sorted in chunks of ``chunk_seconds`` (ten times the range or step, the longer one).
    """
    step, span = _micros(step_seconds), _micros(range_seconds)
    reach = start - timedelta(seconds=range_seconds)
    rows = samples.where((F.col(ts) > instant_literal(reach)) & (F.col(ts) <= instant_literal(end))).select(
        *keys, F.unix_micros(ts).alias("us"), F.col(value).alias("value")
    )
    chunk = CHUNK * max(span, step) if chunk_seconds is None else _micros(chunk_seconds)
    pairs = with_previous_within(rows, keys, "us", ["value"], chunk, span)
    grown = F.when(F.col("value") < F.col("prev_value"), F.col("value")).otherwise(
        F.col("value") - F.col("prev_value")
    )
    points = _on_grid(
        _grid_at_or_after(F.col("us"), step), F.col("prev_us") + F.lit(span - 1), start, end, step
    )
    spread = pairs.select(
        *keys, F.explode(points).alias("g"), "us", "prev_us", "prev_value", grown.alias("grown")
    )
    if not extrapolate:
        out = spread.groupBy(*keys, "g").agg(F.sum("grown").alias("value"))
        return _grid_time(out.select(*keys, "g", "value"))
    edges = spread.groupBy(*keys, "g").agg(
        F.sum("grown").alias("grown"),
        F.count(F.lit(1)).alias("gaps"),
        F.min("prev_us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.min_by("prev_value", "prev_us").alias("first_value"),
    )
    return _grid_time(edges.select(*keys, "g", to_edges(F.lit(span)).alias("value")))


def to_edges(span: Column) -> Column:
    """Extrapolated growth: up to the range's edge where the nearest sample is close
    (within 1.1 mean gaps), else by half a gap, and never to below a zero reading."""
    sampled = (F.col("last_us") - F.col("first_us")).cast("double")
    gap = sampled / F.col("gaps")
    to_start = (F.col("first_us") - F.col("g") + span).cast("double")
    to_end = (F.col("g") - F.col("last_us")).cast("double")
    near = gap * F.lit(1.1)
    to_start = F.when(to_start >= near, gap / 2).otherwise(to_start)
    zero_at = F.when(
        (F.col("grown") > 0) & (F.col("first_value") >= 0),
        sampled * F.col("first_value") / F.col("grown"),
    )
    to_start = F.least(to_start, zero_at)
    to_end = F.when(to_end >= near, gap / 2).otherwise(to_end)
    return F.col("grown") * (sampled + to_start + to_end) / sampled


def rate(samples: DataFrame, keys: list[str], start: datetime, end: datetime, **options) -> DataFrame:
    """Growth per second: ``increase`` divided by the range."""
    seconds = options.get("range_seconds", 60)
    return scale(increase(samples, keys, start, end, **options), 1.0 / seconds)


def quantile_over_time(vector: DataFrame, by: list[str], q: float, approximate: int | None = None) -> DataFrame:
    """Linearly interpolated quantile of a grid vector's points.

    Exact by default; a group holds at most one value per grid point.  With
    ``approximate`` (an accuracy) the quantile comes from a sketch.
    """
    if approximate:
        return vector.groupBy(*by).agg(F.percentile_approx("value", q, approximate).alias("value"))
    return vector.groupBy(*by).agg(F.percentile("value", q).alias("value"))


def max_over_time(vector: DataFrame, by: list[str]) -> DataFrame:
    """Largest value over time: the reactive alternative to a high quantile."""
    return vector.groupBy(*by).agg(F.max("value").alias("value"))


def scale(vector: DataFrame, factor: float) -> DataFrame:
    """Vector times scalar."""
    return vector.withColumn("value", F.col("value") * F.lit(factor))


def histogram_quantile(buckets: DataFrame, by: list[str], q: float, le: str = "le") -> DataFrame:
    """Quantile from cumulative buckets: the series are first summed per (by, le).

    ``le`` is a double, with infinity for the last bucket.  The window holds one row
    per bucket bound.  NaN where there is no infinite bucket or no observation; the
    last finite bound where the quantile falls into the infinite bucket.  For q above 1
    the result is infinity, below 0 minus infinity, for NaN it is NaN.
    """
    if not 0 <= q <= 1:
        edge = q if math.isnan(q) else math.copysign(math.inf, q)
        return buckets.select(*by).distinct().withColumn("value", F.lit(edge))
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    summed = buckets.groupBy(*by, F.col(le).cast("double").alias("le")).agg(F.sum("value").alias("value"))
    ordered = Window.partitionBy(*by).orderBy("le")
    whole = Window.partitionBy(*by)
    # counts may not fall as le grows; a small dip is float noise
    level = summed.select(
        *by,
        "le",
        F.max("value").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"),
        F.max("le").over(whole).alias("top"),
    )
    ranked = level.select(
        *by,
        "le",
        "cum",
        "top",
        F.max("cum").over(whole).alias("total"),
        F.lag("le").over(ordered).alias("low"),
        F.lag("cum").over(ordered).alias("below"),
    )
    rank = F.col("total") * F.lit(q)
    low = F.coalesce(F.col("low"), F.lit(0.0))
    below = F.coalesce(F.col("below"), F.lit(0.0))
    inside = F.col("cum") - below
    part = F.when(inside > 0, (rank - below) / F.when(inside > 0, inside)).otherwise(F.lit(0.0))
    value = (
        F.when((F.col("top") != inf) | (F.col("total") <= 0), nan)
        .when(F.col("le") == inf, F.coalesce(F.col("low"), nan))
        .when(F.col("low").isNull() & (F.col("le") <= 0), F.col("le"))
        .otherwise(low + (F.col("le") - low) * part)
    )
    return (
        ranked.where(F.col("cum") >= rank)
        .select(*by, "le", value.alias("value"))
        .groupBy(*by)
        .agg(F.min_by("value", "le").alias("value"))
    )
