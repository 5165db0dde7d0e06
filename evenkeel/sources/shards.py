"""Shard discovery from a labelled registry table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import match_labels


def discover_shards(registry: DataFrame, equals: Mapping[str, str], **matchers) -> DataFrame:
    """Registry rows whose labels match, as shards.

    ``registry`` has (uid, object_name, namespace, labels map, data map) and
    optionally ``ref``.  The object's name becomes the shard id; the display name
    and the server address come from the data map.
    """
    columns = ["ref"] if "ref" in registry.columns else []
    return registry.where(match_labels(F.col("labels"), equals=equals, **matchers)).select(
        *columns,
        F.col("uid").cast("string").alias("uid"),
        F.col("object_name").cast("string").alias("id"),
        F.col("namespace").cast("string").alias("namespace"),
        F.col("data")["name"].alias("name"),
        F.col("data")["server"].alias("server"),
    )
