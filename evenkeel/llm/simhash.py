"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two halves.  Two fingerprints that differ in at most three
bits differ in at most one bit of one half, so looking up every half, and every half
with one bit turned, in the table of all halves finds every such pair; the whole
distance is then checked.  Equal fingerprints are one row from the start, so copies
are never paired with each other.

Null and empty texts, and texts of white space, have no words and the fingerprint zero,
linked like any other.  Repeated rows come back as often as they came.  A null doc_id
takes part but is nobody's component_id; a component of such rows alone has a null one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.llm.components import connected_components
from evenkeel.stages import publish

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Shingles hashed at a time, so that a long text takes no more memory than a short one.
AT_ONCE = 1 << 15


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit SimHash of UTF-8 text."""
    words = text.lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(islice(words, k, None) for k in range(SHINGLE))))
    hashes = (xxhash.xxh64_intdigest(s, SEED) for s in shingles)
    ones, n = np.zeros(64, np.int64), 0
    for first in hashes:
        block = np.fromiter(chain((first,), islice(hashes, AT_ONCE - 1)), ">u8")
        ones += np.unpackbits(block.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
        n += len(block)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary()) if batch.num_rows else pa.array([], pa.large_binary())
        found = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), np.uint64, batch.num_rows)
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.record_batch([*map(batch.column, names), pa.array(found.view(np.int64))], [*names, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _fingerprints, "doc_id long, fp long"
    )


def _keyed_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp): as ``fingerprints``, with a hash of the whole row."""
    return docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), _row_key(docs).alias("key")
    ).mapInArrow(_fingerprints, "doc_id long, key string, fp long")


def _row_key(docs: DataFrame) -> Column:
    """128 bits of all columns of a row: equal rows only have equal keys."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.md5(F.col(f"`{c}`").cast("string")), F.lit("")) for c in docs.columns]))


def _halves(fp: Column) -> list[Column]:
    return [F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))]


def _key(half: Column, number: int) -> Column:
    """Half and its number in one long."""
    return half + F.lit(number << 32)


def _ball(half: Column, number: int, flips: Column) -> Column:
    return F.transform(flips, lambda flip: _key(half.bitwiseXOR(flip), number))


def links(fps: DataFrame) -> DataFrame:
    """(a, b) of distinct fingerprints ``fp`` at most three bits apart, a before b; a pair may come twice."""
    fp = F.col("fp")
    homes = F.array(*[_key(h, k) for k, h in enumerate(_halves(fp))])
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    balls = F.flatten(F.array(*[_ball(h, k, flips) for k, h in enumerate(_halves(fp))]))
    rows = fps.select(fp.alias("b"), F.explode(homes).alias("half"))
    probes = fps.select(fp.alias("a"), F.explode(balls).alias("half"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    return probes.join(rows, "half").where((F.col("a") < F.col("b")) & near).select("a", "b")


def _rooted(fps: DataFrame, least: Column) -> DataFrame:
    """fp, least (an aggregate of its rows), root (the smallest fingerprint of its component)."""
    nodes = publish(fps.groupBy("fp").agg(least.alias("least")), "simhash-nodes")
    roots = publish(connected_components(links(nodes), "simhash-links"), "simhash-roots")
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long), component_id: the smallest doc_id reachable over links."""
    fps = publish(fingerprints(docs), "simhash")
    placed = _rooted(fps, F.min("doc_id"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = publish(placed.join(smallest, "root").select("fp", "component_id"), "simhash-components")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Exactly one row of each component: that of its smallest doc_id, null ids last, then of the smallest row hash.

    Rows that share an id but not a component, or have none, are told apart by the hash.
    """
    fps = publish(_keyed_fingerprints(docs), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key"))
    chosen = _rooted(fps, first).groupBy("root").agg(F.min("least").alias("first"))
    chosen = publish(chosen.select("first.key"), "simhash-chosen")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), _row_key(docs).alias("key"))
    # what still shares a key is one row that came repeatedly
    return rows.join(chosen, "key", "left_semi").dropDuplicates(["key"]).select("_row.*")
