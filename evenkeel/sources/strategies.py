"""Strategies of many refs as tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.labels import render_template
from ..functions.quantity import parse_quantity
from ..stages import publish
from .series import ANY, term
from .strategy import BINDINGS, MetricDef, Strategy

SETTINGS = (
    "ref string, p double, epsilon double, max_shards_per_replica int, period_s double, window_s double, step_s double, "
    "range_s double, lookback_s double, quantile double, extrapolate boolean"
)
METRICS = "ref string, metric_id string, sample string, kind string, label string, bind string, query string, no_data string"
MATCHERS = "ref string, metric_id string, label string, op string, value string"
WEIGHTS = "ref string, metric_id string, weight string"

#: Ways to match a label; several rows of ``in`` or ``not_in`` for one label are one list.
OPS = ("=", "!=", "in", "not_in", "exists", "absent")


@dataclass(frozen=True)
class StrategyTables:
    """``settings`` has a row for each ref, the others any number; see the schemas above.

    A metric is one of a ref's own: it names the stored sample it reads, the label that is
    compared with a field of the shard (``bind``, one of the names in ``BINDINGS``) and its matchers.
    """

    settings: DataFrame
    metrics: DataFrame
    matchers: DataFrame
    weights: DataFrame

    def of(self, refs: DataFrame) -> StrategyTables:
        """The rows of some refs."""
        kept = refs.select("ref").distinct()
        parts = (self.settings, self.metrics, self.matchers, self.weights)
        return StrategyTables(*(t.join(kept, "ref", "left_semi") for t in parts))

    def stored(self) -> StrategyTables:
        """The same as stage tables: joins with them know how small they are before anything is shuffled."""
        return StrategyTables(*(publish(t, "strategies") for t in (self.settings, self.metrics, self.matchers, self.weights)))

    def weight_numbers(self) -> DataFrame:
        """ref, metric_id, weight as double, p; a stage table."""
        number = F.coalesce(parse_quantity(F.col("weight")).cast("double"), F.col("weight").try_cast("double"))
        numbers = self.weights.select("ref", "metric_id", number.alias("weight"))
        return publish(numbers.join(self.settings.select("ref", "p"), "ref"), "weight-numbers")

    def conditions(self) -> DataFrame:
        """Matchers as ``series.qualifying`` takes them, with the condition that names the metric."""
        metrics = self.metrics.select("ref", "metric_id", F.coalesce("sample", "metric_id").alias("metric")).distinct()
        negative = F.col("op").isin("!=", "not_in", "absent")
        bare = F.col("op").isin("exists", "absent")
        labelled = self.matchers.join(metrics, ["ref", "metric_id"]).select(
            "ref", "metric_id", "metric", F.concat_ws("\u0001", "op", "label", F.when(F.col("op").isin("in", "not_in"), "").otherwise(F.coalesce("value", F.lit("")))).alias("cond"),
            negative.alias("negative"),
            F.when(bare, term(F.col("label"))).otherwise(term(F.col("label"), F.col("value"))).alias("term"),
        )
        named = metrics.select("ref", "metric_id", "metric", F.lit(ANY).alias("cond"), F.lit(False).alias("negative"), F.lit(ANY).alias("term"))
        return named.unionByName(labelled)


def strategy_tables(spark: SparkSession, strategies: Mapping[str, Strategy]) -> StrategyTables:
    """Tables of strategies given as objects; their bindings must be those of ``BINDINGS``."""
    names = {f: name for name, f in BINDINGS.items()} | {MetricDef.__dataclass_fields__["bind"].default: "server"}
    settings, metrics, matchers, weights = [], [], [], []
    for ref, s in strategies.items():
        settings.append(
            (ref, float(s.p), s.epsilon, s.max_shards_per_replica, *map(float, (s.period_seconds, s.window_seconds, s.step_seconds,
             s.range_seconds, s.lookback_seconds, s.quantile)), s.extrapolate)
        )
        for m in s.metrics:
            if m.bind not in names:
                raise ValueError(f"metric {m.id}: its binding has no name")
            metrics.append((ref, m.id, m.sample or m.id, m.kind, m.label, names[m.bind], m.query, m.no_data))
            matchers += [(ref, m.id, k, "=", v) for k, v in m.equals.items()]
            matchers += [(ref, m.id, k, "!=", v) for k, v in m.not_equals.items()]
            matchers += [(ref, m.id, k, "in", v) for k, values in m.within.items() for v in values]
        weights += [(ref, k, str(w)) for k, w in s.weights.items()]
    return StrategyTables(
        spark.createDataFrame(settings, SETTINGS), spark.createDataFrame(metrics, METRICS),
        spark.createDataFrame(matchers, MATCHERS), spark.createDataFrame(weights, WEIGHTS),
    )


def bound_value(bind: Column) -> Column:
    """The field of a shard row that a named binding stands for; null for a name that is unknown."""
    out = F.lit(None).cast("string")
    for name, field in BINDINGS.items():
        out = F.when(bind == name, field()).otherwise(out)
    return out


def specs_of(shards: DataFrame, tables: StrategyTables) -> DataFrame:
    """Every metric of its ref for every shard: ref, shard fields, metric_id, query, bound, no_data."""
    pairs = shards.join(tables.metrics.select("ref", "metric_id", "bind", "query", "no_data"), "ref")
    return pairs.withColumns({"query": render_template(F.coalesce("query", F.lit(""))), "bound": bound_value(F.col("bind"))})
