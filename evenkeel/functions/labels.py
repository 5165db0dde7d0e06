"""Label matching over map columns and the binding of shards to label values."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, functions as F

from ..schemas import SHARD_FIELDS


def match_labels(
    labels: Column,
    equals: Mapping[str, str] | None = None,
    not_equals: Mapping[str, str] | None = None,
    within: Mapping[str, Iterable[str]] | None = None,
    without: Mapping[str, Iterable[str]] | None = None,
    exists: Iterable[str] = (),
    absent: Iterable[str] = (),
) -> Column:
    """All conditions joined by AND.  A missing label satisfies the negative ones."""
    tests = [F.lit(True)]
    for key, value in (equals or {}).items():
        tests.append(labels[key].eqNullSafe(F.lit(value)))
    for key, value in (not_equals or {}).items():
        tests.append(~labels[key].eqNullSafe(F.lit(value)))
    for key, values in (within or {}).items():
        tests.append(F.coalesce(labels[key].isin(list(values)), F.lit(False)))
    for key, values in (without or {}).items():
        tests.append(~F.coalesce(labels[key].isin(list(values)), F.lit(False)))
    for key in exists:
        tests.append(F.map_contains_key(labels, F.lit(key)))
    for key in absent:
        tests.append(~F.map_contains_key(labels, F.lit(key)))
    return reduce(lambda a, b: a & b, tests)


def bind_override(value: Column, overrides: Mapping[str, str]) -> Column:
    """Replace listed values, keep the rest: for labels that report another spelling."""
    out = value
    for original, replacement in overrides.items():
        out = F.when(value == original, F.lit(replacement)).otherwise(out)
    return out


def url_host(url: Column) -> Column:
    """Host of a URL with its port, if it has one; user info is left out."""
    authority = F.try_parse_url(url, F.lit("AUTHORITY"))
    return F.coalesce(F.regexp_replace(authority, r"^[^@]*@", ""), F.lit(""))


def render_query(template: str) -> Column:
    """Fill ``{{ .field }}`` places of a metric's text from the shard columns."""
    return render_template(F.lit(template))


def render_template(out: Column) -> Column:
    """``render_query`` for a text that is a column."""
    for field in SHARD_FIELDS:
        value = F.coalesce(F.col(field).cast("string"), F.lit(""))
        out = F.replace(out, F.lit("{{ .%s }}" % field), value)
    return out
