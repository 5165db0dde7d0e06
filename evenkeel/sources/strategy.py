"""Strategy configuration: what to poll, how to weigh it, how long to wait."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from ..functions.labels import bind_override, url_host
from ..functions.quantity import duration_seconds, quantity_number


@dataclass(frozen=True)
class MetricDef:
    """One metric: id, text for the record, fallback, and the label value it is bound by.

    ``kind`` is ``gauge`` or ``counter``; a counter is read as its increase.
    ``sample`` is the stored metric name, ``label`` the label compared with ``bind``.
    ``equals``, ``not_equals`` and ``within`` are matchers on the samples' labels.
    """

    id: str
    query: str = ""
    no_data: str | None = None
    kind: str = "gauge"
    sample: str | None = None
    label: str = "server"
    bind: Callable[[], Column] = field(default=lambda: F.col("server"))
    equals: Mapping[str, str] = field(default_factory=dict)
    not_equals: Mapping[str, str] = field(default_factory=dict)
    within: Mapping[str, list[str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Strategy:
    metrics: tuple[MetricDef, ...]
    weights: Mapping[str, str]
    p: int = 1
    epsilon: float | None = 0.01
    max_shards_per_replica: int | None = None
    period_seconds: int = 60
    window_seconds: int = 3600
    step_seconds: int = 60
    range_seconds: int = 60
    lookback_seconds: int = 300
    quantile: float = 0.95
    stabilization_seconds: int = 86400
    scale_up_seconds: int | None = None
    scale_down_seconds: int | None = None
    extrapolate: bool = False

    def __post_init__(self):
        ids = [m.id for m in self.metrics]
        twice = sorted({i for i in ids if ids.count(i) > 1}) if len(set(ids)) < len(ids) else []
        if twice:
            raise ValueError(f"metrics given more than once: {twice}")


# The bindings a configuration file can name.
IN_CLUSTER_URL = "https://kubernetes.default.svc"
IN_CLUSTER_HOST = "kubernetes.default.svc"
IN_CLUSTER_ADDRESS = "100.64.0.1:443"

BINDINGS: dict[str, Callable[[], Column]] = {
    "server": lambda: F.col("server"),
    "name": lambda: F.col("name"),
    "id": lambda: F.col("id"),
    "uid": lambda: F.col("uid"),
    "namespace": lambda: F.col("namespace"),
    "server_address": lambda: bind_override(
        F.col("server"), {IN_CLUSTER_URL: "https://" + IN_CLUSTER_ADDRESS}
    ),
    "server_host": lambda: bind_override(
        url_host(F.col("server")), {IN_CLUSTER_HOST: IN_CLUSTER_ADDRESS}
    ),
}


def default_strategy(prefix: str = "", job: str | None = None) -> Strategy:
    """The default strategy; ``prefix`` is put before the exporter's own metric names.

    With ``job``, only samples of that job are read.
    """
    matchers = {} if job is None else {"job": job}
    # Metric, kind, label, binding, fallback, weight.
    table = [
        ("app_info", "gauge", "dest_server", "server", None, "0.05"),
        ("cluster_api_resource_objects", "gauge", "server", "server", None, "0.1"),
        ("cluster_api_resources", "gauge", "server", "server", None, "0.1"),
        ("app_reconcile_count", "counter", "dest_server", "server", None, "0.15"),
        ("cluster_events_total", "counter", "server", "server", None, "0.2"),
        ("app_k8s_request_total", "counter", "server", "server_address", "0", "0.2"),
        ("rest_client_requests_total", "counter", "host", "server_host", None, "0.2"),
    ]
    metrics, weights = [], {}
    for name, kind, label, binding, no_data, weight in table:
        full = name if name.startswith("rest_") else prefix + name
        metrics.append(
            MetricDef(full, "", no_data, kind, sample=full, label=label, bind=BINDINGS[binding], equals=matchers)
        )
        weights[full] = weight
    return Strategy(tuple(metrics), weights)


def _unique(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        names = [k for k, _ in pairs]
        raise ValueError(f"given more than once: {sorted({k for k in names if names.count(k) > 1})}")
    return out


def load_strategy(text: str) -> Strategy:
    """Strategy from JSON: the dataclass fields, with ``bind`` one of BINDINGS.

    Times may be numbers of seconds or texts such as ``24h``, epsilon a quantity text.
    A key that is given twice, such as a weight, is an error.
    """
    raw = json.loads(text, object_pairs_hook=_unique)
    for name, value in raw.items():
        if name.endswith("_seconds") and isinstance(value, str):
            raw[name] = duration_seconds(value)
    if isinstance(raw.get("epsilon"), str):
        raw["epsilon"] = float(quantity_number(raw["epsilon"]))
    metrics = tuple(
        MetricDef(**{**m, "bind": BINDINGS[m.get("bind", "server")]}) for m in raw.pop("metrics")
    )
    return Strategy(metrics=metrics, **raw)
