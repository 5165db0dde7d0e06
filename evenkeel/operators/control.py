"""Decision tables: the rollout state of a fleet snapshot, and the log of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .adjacent import with_previous

DAY = 86_400 * 1_000_000


def desired_replicas(plans: DataFrame) -> DataFrame:
    """Wanted scale: the size of each plan given as identity rows."""
    return plans.select("ref", F.coalesce("replicas", F.lit(0)).cast("int").alias("desired_replicas"))


def rollout_state(snapshot: DataFrame) -> DataFrame:
    """Where each scaler stands; the first rule that applies names the state.

    ``snapshot`` has ``mode_default`` and ``mode_x0y`` (whether that mode is set),
    ``rollout_restart``, ``paused``, ``provider_ready``, ``manager_ready``, the plan
    keys or hashes ``plan_key`` (wanted), ``manager_spec_key``, ``manager_status_key``
    and ``scaler_status_key``, and the counts ``desired_replicas``,
    ``spec_replicas`` (may be NULL) and ``actual_replicas``.  It is a classification:
    nothing is acted upon.  Readiness that is unknown (NULL) is not ready, nor is a
    provider whose plan has no key; a mode that is NULL is not set.  ``hand_over`` marks rows whose plan must still be handed
    to the shard manager; ``scale_now`` those where a scaling step would be taken.
    """
    c = F.col
    spec, actual, desired = c("spec_replicas"), c("actual_replicas"), c("desired_replicas")

    def differs(left: str, right: str):
        return ~c(left).eqNullSafe(c(right))

    def holds(name: str):
        return F.coalesce(c(name), F.lit(False))

    pending = holds("mode_x0y") & differs("plan_key", "scaler_status_key")
    is_zero = F.coalesce(spec == 0, F.lit(False)) | (actual == 0)
    # The names of the states.
    state = (
        F.when(holds("mode_default") & holds("mode_x0y"), "ErrorResourceMalformedDuplicateModes")
        .when(holds("paused"), "Paused")
        .when(~holds("provider_ready") | c("plan_key").isNull(), "PartitionProviderNotReady")
        .when(~holds("manager_ready"), "ShardManagerNotReady")
        .when(pending & (actual > 0) & F.coalesce(spec > 0, F.lit(True)), "BeginningScalingToZero")
        .when(pending & (actual > 0), "WaitingForRSControllerToScaleToZero")
        .when(~pending & (desired > 0) & is_zero, "EnforcingDesiredState")
        .when(differs("plan_key", "manager_status_key"), "WaitingForShardManagerToApplyDesiredState")
        .when(differs("scaler_status_key", "manager_status_key"), "BeginningRSControllerScaling")
        .when(spec.isNull() | (spec != desired) | ((desired > 0) & (actual == 0)), "EnforcingDesiredState")
        .when(actual != desired, "WaitingForRSControllerToScale")
        .otherwise("Ready")
    )
    early = ["ErrorResourceMalformedDuplicateModes", "Paused", "PartitionProviderNotReady", "ShardManagerNotReady"]
    to_zero = ["BeginningScalingToZero", "WaitingForRSControllerToScaleToZero"]
    enforced = ~pending & (desired > 0) & is_zero
    restart = holds("mode_default") & holds("rollout_restart") & ~holds("mode_x0y")
    scaling = (c("state") == "BeginningRSControllerScaling") & (restart | (actual != desired))
    return snapshot.withColumn("state", state).withColumns(
        {
            "hand_over": ~c("state").isin(early + to_zero) & ~enforced & differs("plan_key", "manager_spec_key"),
            "scale_now": scaling | c("state").isin("BeginningScalingToZero", "EnforcingDesiredState"),
        }
    )


def change_log(snapshots: DataFrame, keys: list[str], chunk: int = DAY) -> DataFrame:
    """One row per change of the replica count of a target, with the counts before and after.

    ``snapshots`` has ``keys``, ``at`` and ``replicas``.
    """
    rows = snapshots.select(*keys, F.unix_micros("at").alias("us"), F.col("replicas").cast("int").alias("replicas"))
    pairs = with_previous(rows, keys, "us", ["replicas"], chunk)
    return pairs.where(F.col("prev_replicas") != F.col("replicas")).select(
        *keys,
        F.timestamp_micros("us").alias("at"),
        F.col("prev_replicas").alias("from_replicas"),
        F.col("replicas").alias("to_replicas"),
    )


def transition_log(snapshots: DataFrame, keys: list[str], chunk: int = DAY) -> DataFrame:
    """What is done to a target, one row for each step it enters: keys, at, kind, from_replicas, to_replicas, counted.

    ``snapshots`` are those of ``rollout_state`` with ``keys`` and ``at``.  A step is entered
    where a target's state, plan or wanted size differs from its snapshot before.  Kinds are
    ``scale`` (another size once the manager has the plan), ``restart`` (the same size, rolled out anew),
    ``enforce`` (the size was changed by someone else) and ``to_zero`` (on the way to another plan
    in the mode that goes through zero).  The last is no change of its own: the way through zero counts once, when
    the new size is set.
    """
    seen = rollout_state(snapshots).withColumn("us", F.unix_micros("at"))
    columns = ["state", "plan_key", "desired_replicas", "actual_replicas", "scale_now"]
    pairs = with_previous(seen.select(*keys, "us", *columns), keys, "us", columns, chunk)
    entered = F.col("prev_us").isNull()
    for c in columns[:3]:
        entered = entered | ~F.col(c).eqNullSafe(F.col(f"prev_{c}"))
    kind = (
        F.when(F.col("state") == "BeginningScalingToZero", "to_zero")
        .when(F.col("state") == "EnforcingDesiredState", "enforce")
        .when(F.col("actual_replicas") != F.col("desired_replicas"), "scale")
        .otherwise("restart")
    )
    return pairs.where(entered & F.col("scale_now")).select(
        *keys,
        F.timestamp_micros("us").alias("at"),
        kind.alias("kind"),
        F.col("actual_replicas").alias("from_replicas"),
        F.when(kind == "to_zero", 0).otherwise(F.col("desired_replicas")).alias("to_replicas"),
        (kind != "to_zero").alias("counted"),
    )


def change_counts(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Number of changes per target."""
    return changes.groupBy(*keys).agg(F.count(F.lit(1)).alias("changes"))
