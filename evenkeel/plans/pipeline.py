"""One run of a strategy: shards and samples in, stage tables out.

Stages are plain callables with the schema contracts of ``schemas``, so each can be
exchanged: a load index may read raw or normalised values, an evaluation any plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, functions as F, types as T

from ..operators import evaluate, fleet, load_index as li, normalize, packing, plan, poll as polling, validate
from ..operators.timeseries import instant_literal
from ..schemas import ASSIGNMENTS, LOAD_INDEXES, METRIC_VALUES, SAMPLES, SHARDS, require_contract
from ..sources.series import SeriesStore, listing_of, series_of
from ..sources.strategies import StrategyTables
from ..sources.strategy import Strategy
from ..stages import publish, stored_rows


Strategies = Strategy | StrategyTables


class Poller(Protocol):
    def __call__(self, shards: DataFrame, samples: DataFrame, strategy: Strategies, as_of: datetime) -> DataFrame: ...


class Normalizer(Protocol):
    def __call__(self, values: DataFrame, strategy: Strategies) -> DataFrame: ...


class LoadIndexer(Protocol):
    def __call__(self, values: DataFrame, strategy: Strategies) -> DataFrame: ...


class Partitioner(Protocol):
    def __call__(self, load_indexes: DataFrame, strategy: Strategies) -> DataFrame: ...


def poll_samples(shards: DataFrame, samples: DataFrame | SeriesStore, strategy: Strategies, as_of: datetime) -> DataFrame:
    """Metric values; strategies as tables read a series store, or samples that are listed for the run."""
    if isinstance(strategy, StrategyTables):
        if isinstance(samples, DataFrame):
            view = series_of(fleet.within_reach(samples, strategy, as_of))
            series = publish(view.series, "series")
            # read once, so the listing is not stored: its terms meet the conditions as they are listed
            samples = SeriesStore(series, listing_of(series), view.samples)
        return fleet.fleet_poll(shards, samples, strategy, as_of)
    vectors = polling.metric_vectors(samples, strategy, as_of)
    return polling.poll(shards, strategy.metrics, vectors)


def scale_robustly(values: DataFrame, strategy: Strategies) -> DataFrame:
    own = isinstance(strategy, StrategyTables)
    return normalize.robust_scale(values, strategy.settings if own else strategy.epsilon)


def keep_raw(values: DataFrame, strategy: Strategies) -> DataFrame:
    return values


def index_by_p_norm(values: DataFrame, strategy: Strategies) -> DataFrame:
    if isinstance(strategy, StrategyTables):
        return li.load_index(values, strategy.weight_numbers())
    return li.load_index(values, strategy.weights, strategy.p)


def pack_longest_first(load_indexes: DataFrame, strategy: Strategies) -> DataFrame:
    own = isinstance(strategy, StrategyTables)
    return packing.lpt_pack(load_indexes, strategy.settings if own else strategy.max_shards_per_replica)


@dataclass
class Run:
    """Tables of one run.  A failed ref is missing downstream; ``status`` says why.

    ``gate`` says for each ref whether it was due for a poll, why, and how many seconds it may wait.
    """

    metric_values: DataFrame
    normalized: DataFrame
    load_indexes: DataFrame
    assignments: DataFrame
    identity: DataFrame
    status: DataFrame
    gate: DataFrame


@dataclass(frozen=True)
class Pipeline:
    strategy: Strategies
    poller: Poller = poll_samples
    normalizer: Normalizer = scale_robustly
    indexer: LoadIndexer = index_by_p_norm
    partitioner: Partitioner = pack_longest_first
    check: Callable[[DataFrame, DataFrame], DataFrame] = field(default=validate.drop_failed)

    def run(
        self,
        shards: DataFrame,
        samples: DataFrame | SeriesStore,
        as_of: datetime,
        last_polls: DataFrame | None = None,
        previous: DataFrame | None = None,
    ) -> Run:
        """Every stage is written once and read by the stages after it.

        A ref that breaks a rule drops out of the following stages with its reason in
        ``status``; with ``check=validate.raise_on_violation`` it fails the run instead.  Strategies
        as tables are checked too: a ref whose own are malformed fails alone.
        With ``last_polls`` (ref, last_poll) and the ``previous`` metric values, only refs that are due are
        polled, and the others keep their values.
        """
        require_contract(shards, SHARDS, "shards")
        if isinstance(samples, DataFrame):
            require_contract(samples, SAMPLES, "samples")
        refs = publish(shards.select("ref").distinct(), "refs")
        whole, due, statuses = self.strategy, refs, []
        bad_polls = bad_weights = None
        if isinstance(whole, StrategyTables):
            whole = whole.stored()
            bad_polls, bad_weights = (publish(v.join(refs, "ref", "left_semi"), "malformed") for v in fleet.malformed(whole))
        strategy = whole

        def settle(stage: str, values: DataFrame, violations: DataFrame | None) -> DataFrame:
            """Note each ref's status; return the values of the refs that broke no rule."""
            nonlocal due
            broken = stored_rows(violations) if violations is not None else 0
            status = validate.stage_status(due, violations, stage)
            if due is not refs:
                status = status.unionByName(validate.not_ready(refs, due.withColumn("ready", F.lit(True)), stage))
            statuses.append(status)
            if not broken:
                return values
            due = publish(validate.drop_failed(due, violations), "refs-due")
            return publish(self.check(values, violations), f"{stage}-settled")

        def stage(df: DataFrame, contract: T.StructType, name: str) -> DataFrame:
            return publish(require_contract(df, contract, name), name)

        gate = self._gate(whole, refs, shards, as_of, last_polls, previous)
        wanted = refs if last_polls is None else gate.where("stale").select("ref")
        if bad_polls is not None:
            wanted = validate.drop_failed(wanted, bad_polls)
            strategy = strategy.of(wanted)
        asked = shards if wanted is refs else shards.join(publish(wanted, "refs-polled"), "ref", "left_semi")
        polled = stage(self.poller(asked, samples, strategy, as_of), METRIC_VALUES, "polled")
        broken = validate.poll_violations(polled)
        polled = polled.drop("samples")
        if bad_polls is not None:
            broken = broken.unionByName(bad_polls)
        if last_polls is not None and previous is not None:
            fresh = gate.where("NOT stale").select("ref")
            kept = previous.join(fresh if bad_polls is None else validate.drop_failed(fresh, bad_polls), "ref", "left_semi")
            polled = publish(polled.unionByName(kept.select(*polled.columns)), "polled-and-kept")
        values = settle("poll", polled, publish(broken, "poll-violations"))

        scaled = stage(self.normalizer(values, whole), METRIC_VALUES, "normalized")
        broken = validate.not_finite(scaled, "normalize", validate.NORMALIZATION_ERROR)
        scaled = settle("normalize", scaled, publish(broken, "normalize-violations"))

        # a malformed ref has no index at all, so that its status tells the cause
        usable = scaled if bad_weights is None else validate.drop_failed(scaled, bad_weights)
        weights = whole.weight_numbers() if isinstance(whole, StrategyTables) else whole.weights
        indexes = stage(self.indexer(usable, whole), LOAD_INDEXES, "load-indexes")
        broken = validate.metric_exactly_once(usable, weights).unionByName(
            validate.not_finite(indexes, "load_index", validate.LOAD_INDEX_ERROR)
        )
        if bad_weights is not None:
            broken = broken.unionByName(bad_weights.join(due, "ref", "left_semi"))
        indexes = settle("load_index", indexes, publish(broken, "load-index-violations"))

        assignments = stage(self.partitioner(indexes, whole), ASSIGNMENTS, "assignments")
        assignments = settle("partition", assignments, None)
        identity = publish(plan.plan_identity(assignments), "plan-identity")
        return Run(values, scaled, indexes, assignments, identity, reduce(DataFrame.unionByName, statuses), gate)

    def _gate(
        self, strategy: Strategies, refs: DataFrame, shards: DataFrame, as_of: datetime, last_polls: DataFrame | None, previous: DataFrame | None
    ) -> DataFrame:
        """``poll.stale_refs`` of the strategy's refs; all are due without ``last_polls``."""
        never = refs.select("ref", F.lit(None).cast("timestamp").alias("last_poll"))
        polls = never if last_polls is None else refs.join(last_polls.select("ref", "last_poll"), "ref", "left")
        if isinstance(strategy, StrategyTables):
            polls = polls.join(strategy.settings.select("ref", F.col("period_s")), "ref")
            metrics = strategy.metrics.select("ref", "metric_id")
        else:
            polls = polls.withColumn("period_s", F.lit(strategy.period_seconds))
            ids = F.array(*[F.lit(m.id) for m in strategy.metrics]).cast("array<string>")
            metrics = refs.select("ref", F.explode(ids).alias("metric_id"))
        if previous is None:
            before = refs.select("ref", F.lit("").alias("uid"), F.lit("").alias("metric_id")).limit(0)
        else:
            before = previous.select("ref", F.col("shard.uid").alias("uid"), "metric_id")
        gate = polling.stale_refs(polls, shards.select("ref", "uid"), metrics, before, instant_literal(as_of))
        return gate if last_polls is None else publish(gate, "poll-gate")

    def periods(self) -> evaluate.Periods:
        """Of a single strategy."""
        s = self.strategy
        return evaluate.Periods(s.stabilization_seconds, s.scale_up_seconds, s.scale_down_seconds)


def observation(run: Run, as_of: datetime) -> DataFrame:
    """The run's plans as observations for the evaluation."""
    return run.identity.select("ref", instant_literal(as_of).alias("at"), "plan_hash", "replicas")


__all__ = ["LoadIndexer", "Normalizer", "Partitioner", "Pipeline", "Poller", "Run", "keep_raw", "observation"]
