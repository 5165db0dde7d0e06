"""Positions in a linked list that is spread over a table.

A list longer than ``WALK_ROWS`` shrinks round by round: each element throws a coin (a
hash of its key and the round), and an element that shows tails and follows one that
shows heads is taken out, its predecessor now pointing past it with the distances added
up.  A quarter goes each round, so that all rounds together move a few times the
list.  What is left, no more than ``WALK_ROWS`` elements, is walked from its head by one task;
then the rounds are undone, each element taken out standing its distance behind its
predecessor.  All tables of a round are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.stages import publish

#: So many elements are walked by one task.
WALK_ROWS = 1 << 18


def _heads(number: int, major: str, minor: str) -> Column:
    """Whether an element shows heads in a round; null for none."""
    coin = F.xxhash64(F.lit(number), F.col(major), F.col(minor)).bitwiseAND(F.lit(1)) == 1
    return F.when(F.col(major).isNotNull(), coin)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    follows: dict = {}
    for batch in batches:
        major, minor, next_major, next_minor, far = (batch.column(n).to_pylist() for n in ("major", "minor", "next_major", "next_minor", "far"))
        follows.update(zip(zip(major, minor), zip(zip(next_major, next_minor), far)))
    behind = {following for following, _ in follows.values()}
    here = next((key for key in follows if key not in behind), None)
    at, out = 0, []
    while here in follows:
        out.append((*here, at))
        here, far = follows[here]
        at += far
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], []))], ["major", "minor", "at"])


def positions(links: DataFrame) -> DataFrame:
    """major, minor, at (from 0) for one list of (major, minor, next_major, next_minor); the last one's next is null.

    The pair (major, minor) is an element's key, two longs.  No rows give no rows.
    """
    left = publish(links.select("major", "minor", "next_major", "next_minor", F.lit(1).cast("long").alias("far")), "list")
    taken_out = []
    while left.count() > WALK_ROWS:
        number = len(taken_out)
        heads = F.coalesce(_heads(number, "major", "minor"), F.lit(False))
        before_tails = heads & F.coalesce(~_heads(number, "next_major", "next_minor"), F.lit(False))
        tails = left.where(~heads).select(
            F.col("major").alias("next_major"), F.col("minor").alias("next_minor"),
            F.col("next_major").alias("past_major"), F.col("next_minor").alias("past_minor"), F.col("far").alias("past_far"),
        )
        spliced = publish(left.where(before_tails).join(tails, ["next_major", "next_minor"]), "list-spliced")
        gone = spliced.select(F.col("next_major").alias("major"), F.col("next_minor").alias("minor"))
        shorter = spliced.select(
            "major", "minor", F.col("past_major").alias("next_major"), F.col("past_minor").alias("next_minor"),
            (F.col("far") + F.col("past_far")).alias("far"),
        )
        left = publish(left.where(~before_tails).join(gone, ["major", "minor"], "left_anti").unionByName(shorter), "list")
        taken_out.append(spliced)
    found = left.repartition(1).mapInArrow(_walk, "major long, minor long, at long")
    for spliced in reversed(taken_out):
        found = publish(found, "list-positions")
        back = spliced.join(found, ["major", "minor"]).select(
            F.col("next_major").alias("major"), F.col("next_minor").alias("minor"), (F.col("at") + F.col("far")).alias("at")
        )
        found = found.unionByName(back)
    return publish(found, "list-positions")
