"""Stage tables in the shared checkpoint folder, and the size checks built on them.

A stage that several later steps read is written once, as the columnar table it
is, to the folder named by ``spark.checkpoint.dir``.  That cuts the lineage,
survives the loss of executors, and gives Catalyst the true size of the table, so
that a join with it is broadcast only when it really is small.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_MARK = "_evenkeel_stage_table"


def stage_root(spark: SparkSession) -> str:
    """The shared folder for stage tables; a private one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="evenkeel-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/") + "/evenkeel"


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


def publish(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a frame as a stage table and return the table.  Idempotent."""
    if getattr(df, _MARK, False):
        return df
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return open_stage(df.sparkSession, path, df.schema)


def open_stage(spark: SparkSession, path: str, schema) -> DataFrame:
    table = spark.read.schema(schema).parquet(path)
    setattr(table, _MARK, True)
    return table


def project(table: DataFrame, *columns: Column | str) -> DataFrame:
    """Columns of a stage table; as good as the table itself, so not written again."""
    view = table.select(*columns)
    setattr(view, _MARK, getattr(table, _MARK, False))
    return view


def stored_rows(df: DataFrame) -> int | None:
    """Rows of a stage table, from the file footers; None for any other frame."""
    return df.count() if getattr(df, _MARK, False) else None


def large_groups(df: DataFrame, key: str, limit: int) -> list:
    """Keys holding more than ``limit`` rows.

    The list is short by construction: n rows have at most n / limit such keys.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows_in_group"))
    return [r[0] for r in sizes.where(F.col("rows_in_group") > limit).select(key).collect()]


def split_by_size(df: DataFrame, key: str, limit: int, name: str) -> tuple[DataFrame, DataFrame | None]:
    """Split into groups that fit one task and groups that do not (None if there are none).

    The frame becomes a stage table first.  A table that has no more rows than the
    limit cannot hold a larger group and is not counted by key.
    """
    table = publish(df, name)
    if stored_rows(table) <= limit:
        return table, None
    large = large_groups(table, key, limit)
    if not large:
        return table, None
    marks = table.sparkSession.createDataFrame([(k,) for k in large], table.select(key).schema)
    return table.join(marks, key, "left_anti"), table.join(marks, key, "left_semi")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups with the bounds of each, from batches that come sorted by key.

    A task's many small groups share a table, so that none costs a call of its own; at
    most one group and one batch are held.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pc.run_end_encode(batch[key]).run_ends
        last = ends[-2].as_py() if len(ends) > 1 else 0  # where the batch's last group starts
        if held and (last or held[-1][key][-1].as_py() != batch[key][0].as_py()):
            yield _with_bounds([*held, batch.slice(0, last)], key)
            held = []
        elif last:
            yield _with_bounds([batch.slice(0, last)], key)
        held.append(batch.slice(last))
    if held:
        yield _with_bounds(held, key)


def _with_bounds(batches: list[pa.RecordBatch], key: str) -> tuple[pa.Table, list[int]]:
    table = pa.Table.from_batches(batches)
    keys = pa.concat_arrays(table[key].chunks)
    return table, [0, *pc.run_end_encode(keys).run_ends.to_pylist()]


def ordered_parts(
    df: DataFrame, key: str, order: list[Column], parts: int, name: str
) -> tuple[DataFrame, list[tuple]]:
    """Store a frame sorted over ``parts`` files: each group runs through consecutive parts.

    A range shuffle on (key, order) spreads a huge group over many tasks.  The table is
    stored by ``part``, so that reading some parts reads nothing else.  Also returns the
    (key, part, rows) triples by part: at most one per part plus one per key.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(max(1, parts), F.col(key), *order).withColumn("part", F.spark_partition_id())
    path = stage_path(spark, name)
    ranged.write.partitionBy("part").parquet(path)
    table = open_stage(spark, path, ranged.schema)
    sizes = table.groupBy(key, "part").agg(F.count(F.lit(1)).alias("n")).collect()
    return table, sorted(((r[key], r["part"], r["n"]) for r in sizes), key=lambda t: t[1])


def read_parts(table: DataFrame, key: str, wanted: list[tuple]) -> DataFrame:
    """Rows of the given (key, part) pairs; other parts are not read."""
    schema = table.select(key, "part").schema
    marks = table.sparkSession.createDataFrame(wanted, schema)
    numbers = sorted({part for _, part in wanted})
    return table.where(F.col("part").isin(numbers)).join(marks, [key, "part"], "left_semi").drop("part")


class Slices:
    """Groups cut into consecutive runs of about ``rows_per_slice`` rows, in order."""

    def __init__(self, df: DataFrame, key: str, order: list[Column], rows_per_slice: int, name: str):
        parts = math.ceil(df.count() / rows_per_slice)
        self.key = key
        self.table, sizes = ordered_parts(df, key, order, parts, name)
        runs: dict = {}
        for group, part, rows in sizes:
            runs.setdefault(group, []).append((part, rows))
        self.runs = runs

    def __len__(self) -> int:
        return max((len(run) for run in self.runs.values()), default=0)

    def sizes(self, number: int) -> dict:
        """Rows of each group that has a slice of this number."""
        return {group: run[number][1] for group, run in self.runs.items() if number < len(run)}

    def read(self, number: int) -> DataFrame:
        wanted = [(group, run[number][0]) for group, run in self.runs.items() if number < len(run)]
        return read_parts(self.table, self.key, wanted)
