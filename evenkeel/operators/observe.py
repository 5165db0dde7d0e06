"""Published relations: flat rows of labels and a value, one per label set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import SHARD_FIELDS

# Relation name -> type label of the stage that publishes it.
RELATION_TYPES = {
    "shard_manager_discovered_shards": "secret_type_cluster",
    "poll_values": "prometheus",
    "normalizer_values": "robust_scaling",
    "load_index_values": "weighted_p_norm",
    "partition_shards": "longest_processing_time",
    "partition_replicas_total_load": "longest_processing_time",
    "evaluation_projected_shards": "most_wanted_two_phase_hysteresis",
    "evaluation_projected_replicas_total_load": "most_wanted_two_phase_hysteresis",
    "evaluation_shards": "most_wanted_two_phase_hysteresis",
    "evaluation_replicas_total_load": "most_wanted_two_phase_hysteresis",
    "scaler_replica_set_changes_total": "replica_set",
}


def _shard_labels() -> list[Column]:
    return [F.col(f"shard.{f}").alias(f"shard_{f}") for f in SHARD_FIELDS]


def _relation(df: DataFrame, name: str, *labels: Column | str, value: Column) -> DataFrame:
    return df.select(
        F.lit(name).alias("relation"),
        F.lit(RELATION_TYPES[name]).alias("type"),
        "ref",
        *labels,
        value.cast("double").alias("value"),
    )


def discovered_shards(shards: DataFrame, assignments: DataFrame | None = None) -> DataFrame:
    """One row per shard, with its replica where one is assigned."""
    labels = [F.col(f).alias(f"shard_{f}") for f in SHARD_FIELDS]
    if assignments is None:
        placed = shards.withColumn("replica_id", F.lit(None).cast("int"))
    else:
        where = assignments.select("ref", F.col("shard.uid").alias("uid"), "replica_id")
        placed = shards.join(where, ["ref", "uid"], "left")
    return _relation(placed, "shard_manager_discovered_shards", *labels, "replica_id", value=F.lit(1))


def poll_values(values: DataFrame) -> DataFrame:
    return _relation(values, "poll_values", *_shard_labels(), "metric_id", value=F.col("value"))


def normalizer_values(values: DataFrame) -> DataFrame:
    return _relation(values, "normalizer_values", *_shard_labels(), "metric_id", value=F.col("value"))


def load_index_values(indexes: DataFrame) -> DataFrame:
    return _relation(indexes, "load_index_values", *_shard_labels(), value=F.col("value"))


def plan_shards(assignments: DataFrame, name: str) -> DataFrame:
    """One row of value 1 per shard and replica, for a plan, projection or elected plan."""
    return _relation(assignments, name, *_shard_labels(), "replica_id", value=F.lit(1))


def plan_total_load(assignments: DataFrame, name: str) -> DataFrame:
    """Total load per replica, for a plan, projection or elected plan."""
    totals = assignments.groupBy("ref", "replica_id").agg(F.sum("value").alias("total"))
    return _relation(totals, name, "replica_id", value=F.col("total"))


def partition_shards(assignments: DataFrame) -> DataFrame:
    return plan_shards(assignments, "partition_shards")


def partition_replicas_total_load(assignments: DataFrame) -> DataFrame:
    return plan_total_load(assignments, "partition_replicas_total_load")


def evaluation_projected_shards(assignments: DataFrame) -> DataFrame:
    return plan_shards(assignments, "evaluation_projected_shards")


def evaluation_projected_replicas_total_load(assignments: DataFrame) -> DataFrame:
    return plan_total_load(assignments, "evaluation_projected_replicas_total_load")


def evaluation_shards(assignments: DataFrame) -> DataFrame:
    return plan_shards(assignments, "evaluation_shards")


def evaluation_replicas_total_load(assignments: DataFrame) -> DataFrame:
    return plan_total_load(assignments, "evaluation_replicas_total_load")


def replica_set_changes(changes: DataFrame) -> DataFrame:
    """Changes per scaler and target, from the change log (ref, target_kind, target)."""
    counted = changes.groupBy("ref", "target_kind", "target").agg(F.count(F.lit(1)).alias("n"))
    return _relation(
        counted, "scaler_replica_set_changes_total", "target_kind", "target", value=F.col("n")
    )


# The labels each relation is summed by on the dashboards.
ROLLUP_LABELS = {
    "shard_manager_discovered_shards": ["type", "ref"],
    "poll_values": ["type", "ref", "shard_name", "metric_id"],
    "normalizer_values": ["type", "ref", "shard_name", "metric_id"],
    "load_index_values": ["type", "ref", "shard_name"],
    "partition_shards": ["type", "ref", "replica_id"],
    "partition_replicas_total_load": ["type", "ref", "replica_id"],
    "evaluation_projected_shards": ["type", "ref", "replica_id"],
    "evaluation_projected_replicas_total_load": ["type", "ref", "replica_id"],
    "evaluation_shards": ["type", "ref", "replica_id"],
    "evaluation_replicas_total_load": ["type", "ref", "replica_id"],
    "scaler_replica_set_changes_total": ["type", "ref", "target_kind", "target"],
}


def rollup(relation: DataFrame, name: str) -> DataFrame:
    """The relation summed by its dashboard labels."""
    return relation.groupBy(*ROLLUP_LABELS[name]).agg(F.sum("value").alias("value"))
