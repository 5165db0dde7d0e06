"""Rules on stage inputs and results, and what becomes of refs that break them.

A rule yields rows (stage, ref, reason, message).  One broken rule fails the whole
stage for its ref and for no other.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from .load_index import weight_table

# The reasons each stage gives.
MALFORMED_POLL = "MalformedResource"
MALFORMED_WEIGHTS = "WeightsMalformed"
POLLING_ERROR = "PollingError"
NORMALIZATION_ERROR = "ErrorDuringNormalization"
PARTITION_ERROR = "ErrorDuringPartitioning"
LOAD_INDEX_ERROR = "LoadIndexCalculationError"
UPSTREAM_NOT_READY = {
    "poll": "ShardManagerNotReady",
    "normalize": "MetricValuesProviderNotReady",
    "load_index": "MetricValuesProviderNotReady",
    "partition": "LoadIndexProviderNotReady",
    "evaluation": "PartitionProviderNotReady",
    "scaler": "PartitionProviderNotReady",
}


def violations(df: DataFrame, stage: str, reason: str, message: Column) -> DataFrame:
    return df.select(
        F.lit(stage).alias("stage"), "ref", F.lit(reason).alias("reason"), message.alias("message")
    )


def duplicate_ids(definitions: DataFrame, stage: str, reason: str) -> DataFrame:
    """A metric or weight id listed more than once for a ref."""
    repeated = definitions.groupBy("ref", "metric_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return violations(repeated, stage, reason, F.concat(F.lit("duplicate id "), F.col("metric_id")))


def metric_exactly_once(
    values: DataFrame, weights: Mapping[str, str | float] | DataFrame, stage: str = "load_index"
) -> DataFrame:
    """Every weighted metric occurs once in each shard that has any value at all."""
    counts = values.groupBy("ref", F.col("shard.uid").alias("uid"), "metric_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    shards = counts.select("ref", "uid").distinct()
    if isinstance(weights, DataFrame):
        expected = shards.join(weight_table(values.sparkSession, weights).select("ref", "metric_id"), "ref")
    else:
        ids = F.array(*[F.lit(k) for k in weights]) if weights else F.array().cast("array<string>")
        expected = shards.withColumn("metric_id", F.explode(ids))
    wrong = expected.join(counts, ["ref", "uid", "metric_id"], "left").where(
        F.coalesce("n", F.lit(0)) != 1
    )
    message = F.format_string(
        "metric %s must occur once in shard %s", F.col("metric_id"), F.col("uid")
    )
    return violations(wrong, stage, LOAD_INDEX_ERROR, message)


def not_finite(values: DataFrame, stage: str, reason: str) -> DataFrame:
    """Results that no fixed-point number can hold: NaN, infinities, overflow."""
    message = F.concat(F.lit("not a finite value: "), F.coalesce("display_value", F.lit("null")))
    return violations(values.where(F.col("value").isNull()), stage, reason, message)


def poll_violations(polled: DataFrame, stage: str = "poll") -> DataFrame:
    """No data and no fallback, more than one sample, or a value that is not finite."""
    missing = (F.col("samples") == 0) & F.col("value").isNull()
    message = (
        F.when(F.col("samples") > 1, F.concat(F.lit("more than one sample: "), F.col("samples").cast("string")))
        .when(missing, F.lit("no data"))
        .otherwise(F.lit("not a finite value"))
    )
    text = F.concat(message, F.lit(", query:\n"), F.coalesce("query", F.lit("")))
    wrong = polled.where((F.col("samples") > 1) | F.col("value").isNull())
    return violations(wrong, stage, POLLING_ERROR, text)


def first_violation(violations: DataFrame) -> DataFrame:
    """One row per failed stage and ref: the least reason and message."""
    return violations.groupBy("stage", "ref").agg(
        F.min(F.struct("reason", "message")).alias("first")
    ).select("stage", "ref", "first.reason", "first.message")


def drop_failed(values: DataFrame, violations: DataFrame) -> DataFrame:
    """Rows of the refs that broke no rule."""
    return values.join(violations.select("ref").distinct(), "ref", "left_anti")


def raise_on_violation(values: DataFrame, violations: DataFrame) -> DataFrame:
    """The values, or an error when the rows of a failed ref are read."""
    failed = violations.groupBy("ref").agg(F.min("message").alias("failure"))
    joined = values.join(failed, "ref", "left")
    checked = F.when(F.col("failure").isNull(), F.col("ref")).otherwise(F.raise_error(F.col("failure")))
    return joined.withColumn("ref", checked.cast("string")).select(*values.columns)


def stage_status(refs: DataFrame, violations: DataFrame | None, stage: str) -> DataFrame:
    """Ready flag, reason and message for every ref of a stage; None for no violations."""
    refs = refs.select("ref").distinct()
    if violations is None:
        none = F.lit(None).cast("string")
        joined = refs.select("ref", none.alias("reason"), none.alias("message"))
    else:
        failed = first_violation(violations.where(F.col("stage") == stage)).drop("stage")
        joined = refs.join(failed, "ref", "left")
    return joined.select(
        F.lit(stage).alias("stage"),
        "ref",
        F.col("reason").isNull().alias("ready"),
        F.coalesce("reason", F.lit("Ready")).alias("reason"),
        F.coalesce("message", F.lit("")).alias("message"),
    )


def require_ready(values: DataFrame, upstream: DataFrame) -> DataFrame:
    """Rows whose ref is ready upstream; a stage does nothing for the others."""
    return values.join(upstream.where("ready").select("ref").distinct(), "ref", "left_semi")


def not_ready(refs: DataFrame, upstream: DataFrame, stage: str) -> DataFrame:
    """A status row, not ready, for each ref whose upstream stage is missing or not ready."""
    ready = upstream.where("ready").select("ref").distinct()
    return refs.select("ref").distinct().join(ready, "ref", "left_anti").select(
        F.lit(stage).alias("stage"),
        "ref",
        F.lit(False).alias("ready"),
        F.lit(UPSTREAM_NOT_READY[stage]).alias("reason"),
        F.lit("").alias("message"),
    )
