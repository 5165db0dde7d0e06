"""Gauge peaks as a stream: last sample per series and step, sum per pod, max over pods."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .growth import sliding_quantile_stream


def peak_stream(samples: DataFrame, keys: list[str], pod: str, series: str, step: str, watermark: str) -> DataFrame:
    """(keys, grid_ts, value) per step: the largest per-pod sum of the latest samples.

    A step is closed by the watermark; later samples of it are dropped by Spark.  A
    series counts in the steps it was sampled in (no lookback).
    """
    latest = (
        samples.withWatermark("ts", watermark)
        .groupBy(F.window("ts", step).alias("w"), *keys, pod, series)
        .agg(F.max_by("value", "ts").alias("value"))
    )
    pods = latest.groupBy(F.window(F.window_time("w"), step).alias("w"), *keys, pod).agg(
        F.sum("value").alias("value")
    )
    peaks = pods.groupBy(F.window(F.window_time("w"), step).alias("w"), *keys).agg(
        F.max("value").alias("value")
    )
    return peaks.select(*keys, F.col("w.end").alias("grid_ts"), F.window_time("w").alias("ts"), "value")


def quantile_stream(peaks: DataFrame, keys: list[str], q: float, window: str, step: str) -> DataFrame:
    """Quantile of the peaks over a sliding window; a key's state holds one value a step."""
    return sliding_quantile_stream(peaks, keys, q, _seconds(window), _seconds(step))


def _seconds(interval: str) -> float:
    """Seconds of an interval text such as ``3 minutes``."""
    number, unit = interval.split()
    return float(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.rstrip("s")]
