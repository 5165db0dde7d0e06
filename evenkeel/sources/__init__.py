"""Shard catalogue, sample tables and streams, strategy configuration, sinks."""

from .relation_store import RelationStore
from .samples import read_sample_stream, scan_samples, series_columns, write_samples
from .series import SeriesStore, append_series, open_series, series_of
from .shards import discover_shards
from .sinks import relation_writer, write_relation
from .strategies import StrategyTables, strategy_tables
from .strategy import MetricDef, Strategy, default_strategy, load_strategy

__all__ = [
    "MetricDef",
    "RelationStore",
    "SeriesStore",
    "Strategy",
    "StrategyTables",
    "append_series",
    "default_strategy",
    "discover_shards",
    "load_strategy",
    "open_series",
    "read_sample_stream",
    "relation_writer",
    "scan_samples",
    "series_columns",
    "series_of",
    "strategy_tables",
    "write_relation",
    "write_samples",
]
