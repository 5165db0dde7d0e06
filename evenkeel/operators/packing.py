"""Longest-processing-time packing of shards onto replicas.

Shards go in order of falling load, ties by uid, a shard named ``in-cluster``
before all others.  Each goes to the least loaded replica (lowest id on ties) that
is not full and stays strictly below the bucket size, which is the largest load of
the ref; if there is none it opens a replica.  Whether a replica fits falls as its
total grows, so only the least loaded open one need be asked: a heap does it.

Packing is sequential within a ref and independent between refs.  Refs of ordinary
size are packed whole, each in one task, many at a time.  A ref beyond
``max_group_rows`` is cut into ordered slices; each step packs one slice of every
such ref, given only the least loaded replicas, as many as the slice has shards,
since a slice cannot reach more.  Slices grow with the ref up to what a task holds, so
that the number of steps does not.  Both ways give the same plan.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..schemas import SCALE, quantise
from ..functions.quantity import plain_text
from ..stages import Slices, open_stage, ordered_parts, project, publish, read_parts, split_by_size, stage_path, stored_rows, whole_groups

# Fixed value: the shard that always gets replica 0.
PINNED_NAME = "in-cluster"

# A packed group is held by one task: a million rows are some hundred megabytes.
MAX_GROUP_ROWS = 1_000_000

# A ref beyond that takes so many steps, more only where a slice would not fit a task.
STEPS = 16

# So many equal loads in a row, at least, are dealt at once; totals beyond this are left to whole numbers.
RUN = 64
_EXACT = 1 << 62

# Shards listed in one row of a nested plan: some tens of megabytes.
MAX_LIST = 100_000


def lpt_fold(
    loads: list[int],
    bucket: int,
    cap: int | None = None,
    replicas: list[tuple[int, int, int]] = (),
    opened: int = 0,
) -> list[int]:
    """Replica id per load, in the given order.  Loads are scaled integers.

    ``replicas`` are the known (total, id, shards) with room left, ``opened`` the
    number of replicas so far.
    """
    heap = list(replicas)
    heapq.heapify(heap)
    out: list[int] = []
    at = 0
    while at < len(loads):
        load, until = loads[at], at + 1
        while until < len(loads) and loads[until] == load:
            until += 1
        if until - at >= max(RUN, len(heap) // 8) and bucket < _EXACT:
            ids, heap, opened = _deal_run(until - at, load, bucket, cap, heap, opened)
            out += ids
            at = until
        for load in loads[at:until]:
            if heap and heap[0][0] + load < bucket:
                total, replica, shards = heap[0]
                if cap and shards + 1 >= cap:
                    heapq.heappop(heap)
                else:
                    heapq.heapreplace(heap, (total + load, replica, shards + 1))
            else:
                replica, opened = opened, opened + 1
                if not cap or cap > 1:
                    heapq.heappush(heap, (load, replica, 1))
            out.append(replica)
        at = until
    return out


def _deal_run(
    n: int, load: int, bucket: int, cap: int | None, heap: list[tuple[int, int, int]], opened: int
) -> tuple[list[int], list[tuple[int, int, int]], int]:
    """Replica ids of ``n`` equal loads in a row, the replicas with room left as a heap, and the number opened.

    The totals a replica goes through are an arithmetic sequence, and each load goes to the
    least (total, id) of all: the loads are dealt along the merged sequences, found by
    bisection for the total that the last of them reaches.  What is left opens replicas one after another, each filled
    before the next.
    """
    known = np.array(heap, np.int64).reshape(-1, 3)
    totals, ids, shards = known[:, 0], known[:, 1], known[:, 2]
    room = np.full(len(known), n, np.int64)
    if load:
        # the k-th load fits where total + k * load < bucket
        room = np.minimum(room, np.maximum(bucket - 1 - totals, 0) // load)
    else:
        room[totals >= bucket] = 0
    if cap:
        room = np.minimum(room, np.maximum(cap - shards, 0))

    def taken(limit: int) -> np.ndarray:
        """Loads each replica takes while its total is at most the limit."""
        below = np.where(totals <= limit, (limit - totals) // load + 1 if load else n, 0)
        return np.minimum(below, room)

    low, high = -1, bucket  # fewer than wanted, and all that fit
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if int(taken(middle).sum()) >= n else (middle, high)
    sure = taken(low) if low >= 0 else np.zeros_like(room)
    more = taken(high) - sure
    # of the last total, the smaller ids go first
    order = np.argsort(ids, kind="stable")
    left = n - int(sure.sum())
    before = np.cumsum(more[order]) - more[order]
    counts = sure.copy()
    counts[order] += np.clip(left - before, 0, more[order])
    who = np.repeat(np.arange(len(known)), counts)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = ids[who[np.lexsort((ids[who], totals[who] + nth * load))]].tolist()
    if not load:  # a total that does not grow keeps its replica in front
        out = ids[np.repeat(np.lexsort((ids, totals)), counts[np.lexsort((ids, totals))])].tolist()
    totals, shards = totals + counts * load, shards + counts
    kept = [row for row in zip(totals.tolist(), ids.tolist(), shards.tolist()) if not cap or row[2] < cap]
    rest = n - len(out)
    if rest:
        each = max(1, (bucket - 1) // load if load else (n if bucket > 0 else 1))
        each = min(each, cap) if cap else each
        number = -(-rest // each)
        out += np.repeat(np.arange(opened, opened + number), each)[:rest].tolist()
        for k in range(number):
            size = min(each, rest - k * each)
            if not cap or size < cap:
                kept.append((size * load, opened + k, size))
        opened += number
    heapq.heapify(kept)
    return out, kept, opened


def _integers(column) -> list[int]:
    """Scaled loads as Python integers, exact at any size."""
    try:
        return pc.cast(column, pa.int64()).to_pylist()
    except pa.ArrowInvalid:
        return [v if v is None else int(v) for v in column.to_pylist()]


_ORDER = [("pinned", "descending"), ("load", "descending"), ("uid", "ascending")]


def _pack_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs ref after ref; rows come sorted by ref and in the order of packing."""
    for table, bounds in whole_groups(batches, "ref"):
        loads, caps = _integers(table["load"]), table["cap"].to_pylist()
        ids: list[int] = []
        for low, high in zip(bounds, bounds[1:]):
            group = loads[low:high]
            ids += lpt_fold(group, max(group), caps[low])
        yield from table.append_column("replica_id", pa.array(ids, pa.int32())).to_batches()


def _pack_slice(items: pa.Table, known: pa.Table) -> pa.Table:
    items = items.take(pc.sort_indices(items, sort_keys=_ORDER))
    replicas = list(zip(_integers(known["total"]), known["replica_id"].to_pylist(), known["shards"].to_pylist()))
    loads = _integers(items["load"])
    if not loads:
        ids = []
    else:
        bucket = _integers(items["bucket"].slice(0, 1))[0]
        ids = lpt_fold(loads, bucket, items["cap"][0].as_py(), replicas, items["opened"][0].as_py())
    return items.drop_columns(["bucket", "opened"]).append_column("replica_id", pa.array(ids, pa.int32()))


def _least_loaded(sizes: list[tuple], needed: dict) -> list[tuple]:
    """The first (ref, part) pairs, by rising load, that together hold the needed rows."""
    wanted, held = [], {}
    for ref, part, rows in sizes:
        if held.get(ref, 0) < needed.get(ref, 0):
            wanted.append((ref, part))
            held[ref] = held.get(ref, 0) + rows
    return wanted


def _rows_per_slice(longest: int, least: int) -> int:
    """Rows of a slice: ``least``, or a ``STEPS``-th of the longest ref up to what one task holds."""
    return max(least, min(MAX_GROUP_ROWS, math.ceil(longest / STEPS)))


def _pack_large(items: DataFrame, slice_rows: int) -> DataFrame:
    """Refs too big for one task, slice after slice.  Every step is a stage table.

    The replicas that can still take a shard are kept sorted by load over many files,
    so that a step reads the least loaded ones and no others.  A replica that not even
    the smallest load of its ref fits is dropped: it can take nothing more.
    """
    spark = items.sparkSession
    order = [F.col("pinned").desc(), F.col("load").desc(), F.col("uid")]
    longest = items.groupBy("ref").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    slice_rows = _rows_per_slice(longest, slice_rows)
    slices = Slices(items, "ref", order, slice_rows, "packing-slices")
    # one row per large ref, of which there are at most rows / max_group_rows
    ends = items.groupBy("ref").agg(F.max("load").alias("bucket"), F.min("load").alias("least"), F.max("cap").alias("most"))
    refs = publish(ends, "buckets")
    out_schema = T.StructType(items.schema.fields + [T.StructField("replica_id", T.IntegerType())])
    out_path = stage_path(spark, "packed")
    nothing = spark.createDataFrame([], "ref string, replica_id int, total decimal(38,0), shards bigint")
    opened = spark.createDataFrame([], "ref string, opened int")
    state, room, open_replicas = nothing, nothing, []
    for number in range(len(slices)):
        sizes = slices.sizes(number)
        step = (
            slices.read(number)
            .join(refs.drop("least", "most"), "ref")
            .join(opened, "ref", "left")
            .withColumn("opened", F.coalesce("opened", F.lit(0)))
        )
        wanted = _least_loaded(open_replicas, sizes)
        least = read_parts(room, "ref", wanted) if wanted else nothing
        packed = step.groupBy("ref").cogroup(least.groupBy("ref")).applyInArrow(_pack_slice, out_schema)
        packed.write.parquet(f"{out_path}/slice={number}")
        if number + 1 == len(slices):
            break
        done = open_stage(spark, f"{out_path}/slice={number}", out_schema)
        one = F.lit(1).cast("bigint").alias("shards")
        added = done.select("ref", "replica_id", F.col("load").alias("total"), one)
        ids = done.groupBy("ref").agg((F.max("replica_id") + 1).alias("opened"))
        opened = publish(opened.unionByName(ids).groupBy("ref").agg(F.max("opened").alias("opened")), "opened")
        merged = state.unionByName(added).groupBy("ref", "replica_id")
        merged = merged.agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("shards").alias("shards"))
        with_room = merged.join(refs, "ref").where(F.col("total") + F.col("least") < F.col("bucket"))
        with_room = with_room.where(F.col("most").isNull() | (F.col("shards") < F.col("most")))
        state = publish(with_room.select("ref", "replica_id", "total", "shards"), "replicas")
        by_load = [F.col("total"), F.col("replica_id")]
        parts = math.ceil(stored_rows(state) / slice_rows)
        room, open_replicas = ordered_parts(state, "ref", by_load, parts, "replicas-by-load")
    return spark.read.schema(out_schema).parquet(*[f"{out_path}/slice={n}" for n in range(len(slices))])


def lpt_pack(
    load_indexes: DataFrame,
    max_shards_per_replica: int | DataFrame | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Assignments: ref, replica_id, shard, value, display_value.

    A cap that is unset, zero or negative means no cap; a frame of (ref,
    max_shards_per_replica) gives each ref its own.  The pinned shard is put
    first wherever it stands, which the original's lookup only manages for some
    positions.
    """
    loads = publish(load_indexes, "load-indexes")
    if isinstance(max_shards_per_replica, DataFrame):
        caps = max_shards_per_replica.select("ref", F.col("max_shards_per_replica").cast("int").alias("cap"))
        loads = publish(loads.join(caps, "ref", "left"), "load-indexes-capped")
        cap = F.when(F.col("cap") > 0, F.col("cap")).alias("cap")
    else:
        cap = F.lit(max_shards_per_replica if (max_shards_per_replica or 0) > 0 else None).cast("int").alias("cap")
    scale = load_indexes.schema["value"].dataType.scale
    units = (F.col("value").cast(T.DecimalType(38, scale)) * F.lit(10**scale)).cast("decimal(38,0)")
    items = project(
        loads,
        "ref",
        cap,
        F.col("shard.uid").alias("uid"),
        F.col("shard.name").eqNullSafe(F.lit(PINNED_NAME)).alias("pinned"),
        units.alias("load"),
        "shard",
        "value",
        "display_value",
    )
    small, large = split_by_size(items, "ref", max_group_rows, "packing-items")
    schema = T.StructType(items.schema.fields + [T.StructField("replica_id", T.IntegerType())])
    # the refs of a task follow one another in its batches
    order = [F.col("pinned").desc(), F.col("load").desc(), F.col("uid").asc_nulls_last()]
    packed = small.repartition("ref").sortWithinPartitions("ref", *order).mapInArrow(_pack_whole, schema)
    if large is not None:
        packed = packed.unionByName(_pack_large(large, max_group_rows))
    return packed.select("ref", "replica_id", "shard", "value", "display_value")


def replica_totals(assignments: DataFrame) -> DataFrame:
    """Per (ref, replica_id): shards, total_load and its text."""
    scale = assignments.schema["value"].dataType.scale
    totals = assignments.groupBy("ref", "replica_id").agg(
        F.count(F.lit(1)).alias("shards"),
        F.sum("value").cast(T.DecimalType(38, scale)).alias("total_load"),
    )
    return totals.withColumn("total_load_display", plain_text(F.col("total_load")))


def _parts_by_rank(table: DataFrame, max_list: int) -> DataFrame:
    """Adds ``part``: the shard's rank in its replica, largest first, in runs of ``max_list``.

    A range shuffle spreads a long replica over tasks; ranks are counted within each
    range and shifted by the sizes of the ranges before it.
    """
    keys, order = ["ref", "replica_id"], [F.col("value").desc(), F.col("shard.uid")]
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = table.repartitionByRange(parts, *keys, *order).withColumn("range", F.spark_partition_id())
    ranged = publish(ranged, "assignments-by-load")
    earlier = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*keys, "range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(*keys, "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy(*keys, "range").orderBy(*order))
    part = F.floor((F.col("before") + F.col("nth") - 1) / max_list).cast("int")
    numbered = ranged.withColumn("nth", nth).join(before, [*keys, "range"])
    return numbered.withColumn("part", part).drop("before", "nth", "range")


def replicas(assignments: DataFrame, max_list: int = MAX_LIST) -> DataFrame:
    """Nested plan: the load indexes of each replica, largest first, at most ``max_list`` to a row.

    ``part`` numbers a replica's rows from 0, the largest loads first; ``total_load`` is
    the whole replica's in each.
    """
    table = publish(assignments, "assignments")
    counts = table.groupBy("ref", "replica_id").agg(F.count(F.lit(1)).alias("shards"), F.sum("value").alias("total"))
    counts = publish(counts, "replica-sizes")
    largest = counts.agg(F.max("shards")).first()[0] or 0
    if largest <= max_list:
        parted = table.withColumn("part", F.lit(0))
    else:
        parted = _parts_by_rank(table, max_list)
    entry = F.struct(
        (-F.col("value")).alias("order"), F.col("shard.uid").alias("uid"), "shard", "value", "display_value"
    )
    nested = parted.groupBy("ref", "replica_id", "part").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    total = F.col("total").cast(assignments.schema["value"].dataType)
    return nested.join(counts.select("ref", "replica_id", total.alias("total_load")), ["ref", "replica_id"]).select(
        "ref",
        "replica_id",
        "part",
        F.transform("entries", lambda e: e.dropFields("order", "uid")).alias("load_indexes"),
        "total_load",
        plain_text(F.col("total_load")).alias("total_load_display"),
    )


def replica_count(assignments: DataFrame) -> DataFrame:
    """Size of each plan; ids run from 0 without gaps."""
    return assignments.groupBy("ref").agg((F.max("replica_id") + 1).alias("replicas"))


def bucket_size(load_indexes: DataFrame) -> DataFrame:
    """Capacity of one replica: the largest load of the ref."""
    return load_indexes.groupBy("ref").agg(F.max("value").alias("bucket"))


def packing_order(load_indexes: DataFrame) -> DataFrame:
    """The order in which shards are packed, as a sorted frame (a range sort, not one task)."""
    return load_indexes.orderBy(
        "ref",
        F.col("shard.name").eqNullSafe(F.lit(PINNED_NAME)).desc(),
        F.col("value").desc(),
        F.col("shard.uid"),
    )


def plan_quality(assignments: DataFrame, scale: int = SCALE) -> DataFrame:
    """Makespan, spread (largest over mean) and fill (mean over bucket) of each plan."""
    totals = assignments.groupBy("ref", "replica_id").agg(
        F.sum("value").alias("total"), F.max("value").alias("largest")
    )
    per_ref = totals.groupBy("ref").agg(
        F.count(F.lit(1)).alias("replicas"),
        F.max("total").alias("makespan"),
        (F.sum("total").cast("double") / F.count(F.lit(1))).alias("mean"),
        F.max("largest").cast("double").alias("bucket"),
    )
    return per_ref.select(
        "ref",
        F.col("replicas").cast("int").alias("replicas"),
        "makespan",
        quantise(F.col("makespan").cast("double") / F.when(F.col("mean") != 0, F.col("mean")), scale).alias("spread"),
        quantise(F.col("mean") / F.when(F.col("bucket") != 0, F.col("bucket")), scale).alias("fill"),
    )
