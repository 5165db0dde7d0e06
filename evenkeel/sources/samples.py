"""Labelled samples: table layout, pruned scans, streams."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.labels import match_labels
from ..schemas import SAMPLES


def _utc_day(ts: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / 86400).cast("int"))


def utc(at: datetime) -> datetime:
    return at.astimezone(timezone.utc) if at.tzinfo else at.replace(tzinfo=timezone.utc)


def write_samples(samples: DataFrame, path: str, mode: str = "append") -> None:
    """Store samples by metric and day, so that a scan reads only what it needs."""
    (
        samples.withColumn("day", _utc_day(F.col("ts")))
        .write.mode(mode)
        .partitionBy("metric", "day")
        .parquet(path)
    )


def scan_samples(
    spark: SparkSession,
    path: str,
    metric: str,
    start: datetime,
    end: datetime,
    equals: Mapping[str, str] | None = None,
    **matchers,
) -> DataFrame:
    """Samples of one metric with start < ts <= end and matching labels.

    Metric and day prune folders; ts reaches the parquet reader.  A time without a
    zone is UTC.
    """
    start, end = utc(start), utc(end)
    table = spark.read.parquet(path)
    return table.where(
        (F.col("metric") == metric)
        & F.col("day").between(F.lit(start.date()), F.lit(end.date()))
        & (F.col("ts") > F.lit(start))
        & (F.col("ts") <= F.lit(end))
        & match_labels(F.col("labels"), equals=equals, **matchers)
    ).select("metric", "labels", "ts", "value")


def read_sample_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Sample files as a stream, a bounded number of files per batch."""
    return spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", max_files).parquet(path)


def series_identity() -> Column:
    """All labels in a fixed order: a map itself cannot be a grouping key that hashes."""
    return F.sort_array(F.map_entries("labels"))


def series_columns(samples: DataFrame, labels: Iterable[str]) -> DataFrame:
    """Lift the named labels into columns and add ``series``, the full identity.

    Plain columns keep grouping and joining inside generated code.
    """
    lifted: list[Column] = [F.col("labels")[name].alias(name) for name in labels]
    return samples.select("metric", series_identity().alias("series"), *lifted, "ts", "value")
