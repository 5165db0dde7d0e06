"""Poll: one value per shard and metric at one instant, from sample tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import match_labels, render_query
from ..functions.quantity import parse_quantity, plain_text
from ..schemas import SCALE, SHARD_FIELDS, quantise, shard_struct
from ..sources.samples import series_identity, utc
from ..sources.strategy import MetricDef, Strategy
from . import timeseries as ts


def _bound_samples(samples: DataFrame, metrics: Sequence[MetricDef], namespace: str, pod: str) -> DataFrame:
    """Samples that the metrics' matchers let pass, keyed by metric id, namespace, bound label, pod, series."""
    labels = F.col("labels")
    names = [m.sample or m.id for m in metrics]
    uses = [
        (F.col("metric") == name) & match_labels(labels, m.equals, m.not_equals, m.within)
        for m, name in zip(metrics, names)
    ]
    wanted = samples.where(F.col("metric").isin(names)).where(reduce(or_, uses)).select(
        "metric",
        "labels",
        labels[namespace].alias("namespace"),
        labels[pod].alias("pod"),
        series_identity().alias("series"),
        "ts",
        "value",
    )
    if len(set(names)) == len(names):
        metric_id, bound = F.lit(None).cast("string"), F.lit(None).cast("string")
        for m, use in zip(metrics, uses):
            metric_id = F.when(use, F.lit(m.id)).otherwise(metric_id)
            bound = F.when(use, labels[m.label]).otherwise(bound)
        keyed = wanted.withColumns({"metric_id": metric_id, "bound": bound})
    else:
        # several metrics read the same samples, each by its own label
        found = F.array(
            *[
                F.when(use, F.struct(F.lit(m.id).alias("metric_id"), labels[m.label].alias("bound")))
                for m, use in zip(metrics, uses)
            ]
        )
        keyed = wanted.withColumn("use", F.explode(found)).where("use IS NOT NULL").select("*", "use.*")
    return keyed.select("metric_id", "namespace", "bound", "pod", "series", "ts", "value")


def metric_vectors(
    samples: DataFrame,
    strategy: Strategy,
    as_of: datetime,
    namespace: str = "namespace",
    pod: str = "pod",
) -> DataFrame:
    """Each metric's expression at ``as_of``: (metric_id, namespace, bound, value).

    The expression is the high quantile over a window of the largest per-pod sum, of
    gauges or of counter increases.  All gauges share one pass over the samples, all
    counters another.
    """
    start = as_of - timedelta(seconds=strategy.window_seconds)
    if "day" in samples.columns:
        # a table stored by day: skip the folders the window cannot reach
        reach = start - timedelta(seconds=max(strategy.lookback_seconds, strategy.range_seconds))
        samples = samples.where(F.col("day").between(F.lit(utc(reach).date()), F.lit(utc(as_of).date())))
    keys = ["metric_id", "namespace", "bound"]
    parts = []
    for kind in ("gauge", "counter"):
        metrics = [m for m in strategy.metrics if m.kind == kind]
        if not metrics:
            continue
        series = _bound_samples(samples, metrics, namespace, pod)
        names = [*keys, "pod", "series"]
        if kind == "gauge":
            vector = ts.instant_vector(
                series, names, start, as_of, strategy.step_seconds, strategy.lookback_seconds
            )
        else:
            vector = ts.increase(
                series, names, start, as_of, strategy.step_seconds, strategy.range_seconds, strategy.extrapolate
            )
        peak = ts.max_over_series(ts.sum_by(vector, [*keys, "pod"]), keys)
        parts.append(ts.quantile_over_time(peak, keys, strategy.quantile))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def poll(
    shards: DataFrame, metrics: Sequence[MetricDef], vectors: DataFrame, scale: int = SCALE
) -> DataFrame:
    """Every metric for every shard: metric values plus ``samples``, the number found.

    The metric list sits in the plan as an array that each shard row is expanded by,
    so the pairing needs no join.  An empty result takes the metric's fallback.  Rows
    that break a rule keep a NULL value or ``samples`` above one; see
    ``validate.poll_violations``.
    """
    specs = F.array(
        *[
            F.struct(
                F.lit(m.id).alias("metric_id"),
                render_query(m.query).alias("query"),
                m.bind().alias("bound"),
                F.lit(m.no_data).cast("string").alias("no_data"),
            )
            for m in metrics
        ]
    )
    pairs = shards.select("ref", shard_struct(), *SHARD_FIELDS, F.explode(specs).alias("m")).select(
        "ref", "shard", "namespace", "m.metric_id", "m.query", "m.bound", "m.no_data"
    )
    return answered(pairs, vectors, scale)


def answered(pairs: DataFrame, vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """Metric values for (ref, shard or its fields, namespace, metric_id, query, bound, no_data).

    ``vectors`` has (metric_id, namespace, bound, value), or fewer of these keys, or a ref as well.
    """
    if "shard" not in pairs.columns:
        pairs = pairs.withColumn("shard", shard_struct())
    on = [c for c in ("ref", "metric_id", "namespace", "bound") if c in vectors.columns]
    found = vectors.groupBy(*on).agg(F.count(F.lit(1)).alias("samples"), F.max("value").alias("found"))
    fallback = parse_quantity(F.col("no_data")).cast("double")
    value = F.when(F.col("samples").isNull(), fallback).when(F.col("samples") == 1, F.col("found"))
    return (
        pairs.join(found, on, "left")
        .withColumn("raw", value)
        .select(
            "ref",
            "metric_id",
            "shard",
            "query",
            quantise(F.col("raw"), scale).alias("value"),
            plain_text(F.col("raw")).alias("display_value"),
            F.coalesce("samples", F.lit(0)).cast("bigint").alias("samples"),
        )
    )


def same_sets(previous: DataFrame, current: DataFrame, item: str) -> DataFrame:
    """Per ref: whether the distinct items are the same on both sides.

    Items meet in a full outer join, so no ref's set is gathered in one place.
    """
    before = previous.select("ref", item).distinct().withColumn("before", F.lit(1))
    now = current.select("ref", item).distinct().withColumn("now", F.lit(1))
    lone = F.col("before").isNull() | F.col("now").isNull()
    return (
        before.join(now, ["ref", item], "full")
        .groupBy("ref")
        .agg(F.max(lone.cast("int")).alias("lone"))
        .select("ref", (F.col("lone") == 0).alias("same"))
    )


def stale_refs(
    polls: DataFrame,
    shards: DataFrame,
    metrics: DataFrame,
    previous: DataFrame,
    as_of: Column,
) -> DataFrame:
    """Which refs are due for a poll, why, and how many seconds the others may wait.

    ``polls`` (ref, period_s, last_poll); ``shards`` (ref, uid); ``metrics`` (ref,
    metric_id); ``previous`` (ref, uid, metric_id) are the values of the last poll.
    A changed query text alone does not make a ref due.
    """
    same_shards = same_sets(previous, shards, "uid").withColumnRenamed("same", "same_shards")
    same_metrics = same_sets(previous, metrics, "metric_id").withColumnRenamed("same", "same_metrics")
    age = (F.unix_micros(as_of) - F.unix_micros("last_poll")) / F.lit(1e6)
    joined = polls.join(same_shards, "ref", "left").join(same_metrics, "ref", "left")
    reason = (
        F.when(F.col("last_poll").isNull(), F.lit("NeverPolled"))
        .when(age >= F.col("period_s"), F.lit("PeriodElapsed"))
        .when(~F.coalesce("same_shards", F.lit(True)), F.lit("ShardsChanged"))
        .when(~F.coalesce("same_metrics", F.lit(True)), F.lit("MetricsChanged"))
        .otherwise(F.lit("Fresh"))
    )
    wait = F.when(F.col("reason") == "Fresh", F.col("period_s") - age).otherwise(F.lit(0.0))
    return joined.withColumn("reason", reason).select(
        "ref", (F.col("reason") != "Fresh").alias("stale"), "reason", wait.alias("remaining_s")
    )
