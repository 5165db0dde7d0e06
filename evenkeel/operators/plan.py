"""Plan identity and comparison."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..stages import publish, split_by_size

# Key text in one row: a million pairs are some tens of megabytes.
MAX_KEY_PAIRS = 1_000_000

# SHA-256 of the empty key, the identity of a plan without replicas.
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def plan_pairs(assignments: DataFrame) -> DataFrame:
    """One replica per (ref, uid); of a repeated uid the last replica counts."""
    return assignments.groupBy("ref", F.col("shard.uid").alias("uid")).agg(
        F.max("replica_id").alias("replica_id")
    )


def _key_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join each run of pairs of one ref into a piece of key text; pairs come sorted."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        refs = batch["ref"]
        pairs = pc.binary_join_element_wise(batch["uid"], pc.cast(batch["replica_id"], pa.string()), "=")
        starts = [0] + [i for i in range(1, len(refs)) if refs[i] != refs[i - 1]] + [len(refs)]
        for low, high in zip(starts, starts[1:]):
            if low == high:
                continue
            text = ",".join(pairs.slice(low, high - low).to_pylist())
            yield pa.RecordBatch.from_pylist(
                [{"ref": refs[low].as_py(), "part": part, "number": number, "text": text}],
                schema=_PIECES,
            )
            number += 1


_PIECES = pa.schema(
    [("ref", pa.string()), ("part", pa.int32()), ("number", pa.int64()), ("text", pa.string())]
)


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest each ref's pieces in order; only the running digest is held."""
    ref, digest = None, None
    for batch in batches:
        for name, text in zip(batch["ref"].to_pylist(), batch["text"].to_pylist()):
            if digest is not None and name == ref:
                digest.update(b",")
            else:
                if digest is not None:
                    yield pa.RecordBatch.from_pylist([{"ref": ref, "plan_hash": digest.hexdigest()}])
                ref, digest = name, hashlib.sha256()
            digest.update(text.encode())
    if digest is not None:
        yield pa.RecordBatch.from_pylist([{"ref": ref, "plan_hash": digest.hexdigest()}])


def _large_pieces(pairs: DataFrame) -> DataFrame:
    parts = max(2, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = (
        pairs.repartitionByRange(parts, "ref", "uid")
        .sortWithinPartitions("ref", "uid")
        .mapInArrow(_key_pieces, "ref string, part int, number bigint, text string")
    )
    return publish(pieces, "key-pieces")


def _large_hashes(pieces: DataFrame) -> DataFrame:
    return (
        pieces.repartition("ref")
        .sortWithinPartitions("ref", "part", "number")
        .mapInArrow(_hash_pieces, "ref string, plan_hash string")
    )


def _sizes() -> list:
    return [(F.max("replica_id") + 1).alias("replicas"), F.count(F.lit(1)).alias("shards")]


def _whole_keys(pairs: DataFrame) -> DataFrame:
    pair = F.struct("uid", F.concat("uid", F.lit("="), F.col("replica_id").cast("string")).alias("text"))
    keys = pairs.groupBy("ref").agg(F.sort_array(F.collect_list(pair)).alias("sorted"), *_sizes())
    text = F.array_join(F.transform("sorted", lambda p: p["text"]), ",")
    return keys.select("ref", text.alias("plan_key"), "replicas", "shards").select(
        "ref", "plan_key", F.sha2(F.col("plan_key"), 256).alias("plan_hash"), "replicas", "shards"
    )


def plan_identity(assignments: DataFrame, max_pairs: int = MAX_KEY_PAIRS) -> DataFrame:
    """Per ref: plan_hash, replicas and shards.

    The key is ``uid=replica`` sorted by uid, joined by commas; the hash its SHA-256
    in lower-case hex.  Replica order does not matter, replica ids do.  The key of a
    plan beyond ``max_pairs`` is built in sorted pieces on many tasks and digested piece
    by piece; the hash is the same.  ``plan_keys`` gives the text.
    """
    small, large = split_by_size(plan_pairs(assignments), "ref", max_pairs, "plan-pairs")
    out = _whole_keys(small).drop("plan_key")
    if large is None:
        return out
    return out.unionByName(_large_hashes(_large_pieces(large)).join(large.groupBy("ref").agg(*_sizes()), "ref"))


def plan_keys(assignments: DataFrame, max_pairs: int = MAX_KEY_PAIRS) -> DataFrame:
    """The key text beside the identity: ref, piece, plan_key, plan_hash, replicas, shards.

    A key of at most ``max_pairs`` pairs is one row with ``piece`` 0; a longer one comes
    in pieces that, joined by commas in the order of ``piece``, are the key.
    """
    small, large = split_by_size(plan_pairs(assignments), "ref", max_pairs, "plan-pairs")
    columns = ["ref", "piece", "plan_key", "plan_hash", "replicas", "shards"]
    out = _whole_keys(small).withColumn("piece", F.lit(0)).select(columns)
    if large is None:
        return out
    pieces = _large_pieces(large)
    # one row per ten thousand pairs or so
    nth = F.row_number().over(Window.partitionBy("ref").orderBy("part", "number")) - 1
    identity = _large_hashes(pieces).join(large.groupBy("ref").agg(*_sizes()), "ref")
    texts = pieces.select("ref", nth.alias("piece"), F.col("text").alias("plan_key"))
    return out.unionByName(texts.join(identity, "ref").select(columns))


def plan_diff(applied: DataFrame, desired: DataFrame, changes_only: bool = True) -> DataFrame:
    """Shards added, removed, moved (or kept) from the applied to the desired plan."""
    before = plan_pairs(applied).withColumnRenamed("replica_id", "from_replica")
    after = plan_pairs(desired).withColumnRenamed("replica_id", "to_replica")
    change = (
        F.when(F.col("from_replica").isNull(), F.lit("added"))
        .when(F.col("to_replica").isNull(), F.lit("removed"))
        .when(F.col("from_replica") != F.col("to_replica"), F.lit("moved"))
        .otherwise(F.lit("kept"))
    )
    out = before.join(after, ["ref", "uid"], "full").select(
        "ref", "uid", change.alias("change"), "from_replica", "to_replica"
    )
    return out.where(F.col("change") != "kept") if changes_only else out


def plan_delta(diff: DataFrame) -> DataFrame:
    """Counts per kind of change and the change of the replica count, per ref.

    Takes the full diff, kept shards included, for the replica counts.
    """
    def tally(kind: str):
        return F.sum((F.col("change") == kind).cast("bigint")).alias(kind)

    size = F.coalesce(F.max("to_replica") + 1, F.lit(0)) - F.coalesce(F.max("from_replica") + 1, F.lit(0))
    return diff.groupBy("ref").agg(
        tally("added"), tally("removed"), tally("moved"), tally("kept"), size.alias("replica_delta")
    )


def plan_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per ref: whether two plans put the same shards on the same replica ids."""
    diff = plan_diff(left, right, changes_only=False)
    return diff.groupBy("ref").agg((F.max((F.col("change") != "kept").cast("int")) == 0).alias("equal"))
