"""Neighbouring rows of a series, without sorting a whole series in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def in_chunks(df: DataFrame, keys: list[str], at: str, chunk: int, reach: int) -> DataFrame:
    """Adds ``chunk`` and ``own``: each row in the chunk of its time, and again, not its own, in those it reaches into.

    A row reaches ``reach`` units of ``at`` (a bigint) ahead.  Where a chunk is much longer than
    that, few rows come twice, and whatever lies within reach of a row of a chunk is found inside it:
    one shuffle by series and chunk, and a hot series is sorted by many tasks.
    """
    first = F.floor(F.col(at) / F.lit(chunk)).cast("bigint")
    last = F.floor((F.col(at) + F.lit(reach)) / F.lit(chunk)).cast("bigint")
    rows = df.select("*", first.alias("_first"), F.explode(F.sequence(first, last)).alias("chunk"))
    return rows.withColumn("own", F.col("chunk") == F.col("_first")).drop("_first")


def with_previous_within(
    df: DataFrame, keys: list[str], at: str, columns: list[str], chunk: int, reach: int
) -> DataFrame:
    """Add ``prev_<c>`` for ``at`` and each of ``columns`` to the rows whose previous row lies less than ``reach`` behind."""
    rows = in_chunks(df.select(*keys, at, *columns), keys, at, chunk, reach)
    here = Window.partitionBy(*keys, "chunk").orderBy(at, F.col("own"))
    sides = [F.lag(c).over(here).alias(f"prev_{c}") for c in (at, *columns)]
    near = F.col("own") & (F.col(f"prev_{at}") > F.col(at) - F.lit(reach))
    return rows.select(*keys, at, *columns, "own", *sides).where(near).drop("own")


def with_previous(df: DataFrame, keys: list[str], at: str, columns: list[str], chunk: int) -> DataFrame:
    """Add ``prev_<c>`` for ``at`` (a bigint) and each of ``columns``, however far behind.

    A series is cut into chunks of ``chunk`` units of ``at``, so a hot series is
    sorted by many tasks.  The rows are shuffled once, by series and chunk; the last rows of
    the chunks come from that same shuffle and are carried to the next chunk that is not
    empty.  Rows of one time go by their columns.
    """
    fields = [at, *columns]
    rows = df.select(
        F.struct(*keys).alias("_key"), *fields, F.floor(F.col(at) / F.lit(chunk)).cast("bigint").alias("_chunk")
    ).repartition("_key", "_chunk")
    row = F.struct(*fields)
    here = Window.partitionBy("_key", "_chunk").orderBy(*fields)
    local = rows.select("*", F.lag(row).over(here).alias("_lag"))
    ends = rows.groupBy("_key", "_chunk").agg(F.max(row).alias("_last"))
    before = F.lag("_last").over(Window.partitionBy("_key").orderBy("_chunk"))
    joined = local.join(ends.select("_key", "_chunk", before.alias("_before")), ["_key", "_chunk"], "left")
    side = F.coalesce("_lag", "_before")
    return joined.select("_key.*", *fields, *[side[c].alias(f"prev_{c}") for c in fields])
