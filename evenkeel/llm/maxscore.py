"""Exact top-k by inner product with MaxScore.

Dimensions are the terms, and a shard of candidates keeps a posting column for each.  In a
column, every candidate's product with the query counts from the least one up, so a
dimension adds between nothing and its bound.  The largest set of dimensions, those of the
smallest bounds, that together cannot lift a candidate to the threshold (the k-th best
score known) is non-essential.  The postings of the essential ones are traversed for all
candidates; then the others are probed, the largest bound first, for the candidates that
are still competitive.  Scores are exact integers, so nothing depends on the order of sums.

Candidates are dealt into shards and queries into blocks of fixed size, packed in the fewest
bytes a number.  A unit of work is some shards, by id, and all blocks go to it one after
another; a block is scored as a whole, by matrix products in floats that hold every sum
exactly.  Where the essential dimensions leave most candidates competitive, the others are
traversed too.  A unit returns k rows a query at most, which are merged by query.  The first
round scores every block against one unit of ``ROUND``; its k-th best rows go along with the
blocks to the other units as thresholds, and its rows are part of the answer.

Nothing shuffled pairs a block with a shard: each shard goes to one task, each block once to
each unit.

Every row is a candidate for every query but itself, also where rows share their vec_id; equal
rows (vec_id and vector) are one entry with a count.  Ties go to the smaller vec_id.  Rows whose
id or vector is null, or whose vector holds a null or a non-finite component, take no part.
Shorter vectors are filled up with zeros.  Fewer candidates than k: all of them.  Components and
sums beyond 64 bits are cut to the largest long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from evenkeel.stages import publish

TOP = 5
SHARD_ROWS = 4096
BLOCK_ROWS = 512
#: Dimensions probed between two looks at who is competitive, and candidates scored for a first threshold.
STEP = 8
FIRST = 64
#: Candidates of a block's matrix product, and units to one of the first round.
CHUNK = 1024
ROUND = 16
#: A unit's pairs of a query and a candidate, as long as there are not too many units, and its candidates at most.
UNIT_PAIRS = 4 * 10**9
UNITS = 256
UNIT_ROWS = 1 << 18


_EDGE = (1 << 63) - 1


def _long(score: int) -> int:
    return min(max(score, -_EDGE - 1), _EDGE)


def _matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def _pack(table: pa.Table) -> pa.Table:
    """One row for a shard: ids, counts, and the vectors as columns (postings by dimension) of ``size`` bytes a number."""
    vectors = [v.values.to_numpy() for v in table.column("v")]
    postings = _matrix(vectors, max(len(v) for v in vectors)).T
    kind = np.result_type(np.min_scalar_type(postings.min(initial=-1)), np.min_scalar_type(min(-1, -1 - postings.max(initial=0))))
    numbers = [table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("vec_id", "copies")]
    return pa.table(
        {
            "shard": table.column("shard").slice(0, 1),
            "ids": pa.array(numbers[:1], pa.binary()),
            "copies": pa.array(numbers[1:], pa.binary()),
            "size": pa.array([kind.itemsize], pa.int32()),
            "postings": pa.array([postings.astype(kind).tobytes()], pa.binary()),
        }
    )


def top_of_shard(
    query: np.ndarray, postings: np.ndarray, ids: np.ndarray, copies: np.ndarray, own: int, top: int, threshold: int | None = None
) -> list[tuple[int, int]]:
    """The ``top`` highest (score, id) of a shard, ties to the smaller id, an entry as often as it has copies.

    One copy of the query's own entry takes no part, nor need entries below the threshold.
    """
    same = np.flatnonzero(ids == own)
    same = same[(postings[:, same] == query[:, None]).all(0)]
    if len(same):
        copies = copies.copy()
        copies[same] -= 1
    alive = np.flatnonzero(copies > 0)
    if not len(alive):
        return []
    ends = np.stack([query * postings.max(1), query * postings.min(1)])
    least, bounds = ends.min(0), ends.max(0) - ends.min(0)
    order = np.argsort(-bounds.astype(float), kind="stable")
    # what all dimensions from a place on can still add
    rest = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)
    floor = least.sum()

    def raised(candidates: np.ndarray) -> int | None:
        if len(candidates) < top:
            return threshold
        whole = (query[:, None] * postings[:, candidates]).sum(0)
        known = _long(int(np.partition(whole, len(candidates) - top)[len(candidates) - top]))
        if known == -_EDGE - 1:  # scores that are cut to the least long are alike
            return threshold
        return known if threshold is None else max(threshold, known)

    if threshold is None:
        threshold = raised(alive[:FIRST])
    essential = len(order) if threshold is None else int(np.sum(rest[:-1] >= threshold - floor))
    partial = np.full(len(alive), floor, postings.dtype)
    for n, d in enumerate(order):
        if n >= essential and (n - essential) % STEP == 0:
            if len(alive) > top:
                threshold = raised(alive[np.argpartition(-partial, top)[:top]])
            if threshold is not None:
                competitive = partial + rest[n] >= threshold
                alive, partial = alive[competitive], partial[competitive]
        column = postings[d]
        partial = partial + (query[d] * (column if len(alive) == len(ids) else column[alive]) - least[d])
    scores = [-_long(score) for score in partial.tolist()]
    best = sorted(zip(scores, ids[alive].tolist(), copies[alive].tolist()))[:top]
    return [(-score, i) for score, i, n in best for _ in range(min(n, top))][:top]


#: Below any score of a block; no threshold is known.
_NONE = -(1 << 60)


def _exact(queries: np.ndarray, columns: np.ndarray) -> type | None:
    """The floats that hold every sum of products; None where there are none."""
    most = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(columns.astype(float)).max(initial=0))
    most *= max(len(columns), 1)
    return np.float32 if most < 2.0**24 else np.float64 if most < 2.0**52 else None


def _own_places(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Where each query's own entry is among ids in ascending order; -1 where it is not."""
    places = np.full(len(own), -1)
    low, high = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
    for row in np.flatnonzero(high > low):
        same = (columns[:, low[row] : high[row]] == queries[row][:, None]).all(0)
        if same.any():
            places[row] = low[row] + same.argmax()
    return places


def _suffix_sums(x: np.ndarray) -> np.ndarray:
    return np.pad(np.cumsum(x[:, ::-1], 1)[:, ::-1], ((0, 0), (0, 1)))


def top_of_block(
    queries: np.ndarray, own: np.ndarray, ids: np.ndarray, copies: np.ndarray, columns: np.ndarray, top: int, known: np.ndarray, known_ids: np.ndarray, kind: type
) -> tuple[np.ndarray, ...]:
    """row, id, score, copies of the entries that may be among the ``top`` of a query, at most ``top`` for each.

    The ids ascend.  Entries that come after (``known``, ``known_ids``) need not be found; ``known`` is _NONE where nothing is known.
    """
    low, high = columns.min(1).astype(np.int64), columns.max(1).astype(np.int64)
    ends = queries * low, queries * high
    reach = np.flatnonzero(np.maximum(*ends).sum(1) >= known)
    queries, known, known_ids = queries[reach], known[reach], known_ids[reach]
    most, least = np.maximum(*ends)[reach], np.minimum(*ends)[reach]
    places = _own_places(queries, own[reach], ids, columns)
    width = len(columns)
    order = np.argsort(-(most - least).sum(0).astype(float), kind="stable")
    # what all dimensions from a place on can still add, counted from nothing and from the least
    rest, room = _suffix_sums(most[:, order]), _suffix_sums((most - least)[:, order])
    floor = least.sum(1)
    edge = 1 << (24 if kind is np.float32 else 53)
    as_limit = lambda x: np.clip(x, -edge, edge).astype(kind)[:, None]
    factors = queries[:, order].astype(kind)
    space = np.empty((len(reach), min(CHUNK, len(ids))), kind)
    raised = np.full(len(reach), _NONE)
    look, misses = None, 0
    empty = np.zeros(0, np.int64)
    best = pending = (empty, empty, empty, empty)  # row, place, score, copies

    def merged() -> tuple[np.ndarray, ...]:
        row, place, score, n = (np.concatenate(c) for c in zip(best, pending))
        by = np.lexsort((place, -score, row))
        row, place, score, n = row[by], place[by], score[by], n[by]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        last = rank == top - 1
        # what comes later has a larger id, so that it must be better
        raised[row[last]] = score[last] + 1
        return tuple(c[rank < top] for c in (row, place, score, n))

    for first in range(0, len(ids) if len(reach) else 0, CHUNK):
        chunk = columns[order, first : first + CHUNK].astype(kind)
        limit = np.maximum(np.where(known_ids < ids[first], known + 1, known), raised)
        if look is None and limit.min() > _NONE + 1:
            look = int((room[:, :-1] >= (limit - floor)[:, None]).sum(1).max(initial=0))
        found = None
        if look is not None and look < width:
            partial = np.matmul(factors[:, :look], chunk[:look], out=space[:, : chunk.shape[1]])
            competitive = partial >= as_limit(limit - rest[:, look])
            if np.count_nonzero(competitive) <= competitive.size // 16:
                row, at = np.nonzero(competitive)
                score = partial[row, at]
                for d in range(look, width, STEP):
                    score = score + (factors[row, d : d + STEP] * chunk[d : d + STEP, at].T).sum(1)
                    keep = score >= (limit[row] - rest[row, min(d + STEP, width)])
                    row, at, score = row[keep], at[keep], score[keep]
                found = row, at, score
            else:
                look, misses = ((look + width + 1) // 2 if not misses else width), misses + 1
        if found is None:
            scores = np.matmul(factors, chunk, out=space[:, : chunk.shape[1]])
            alone = np.flatnonzero((places >= first) & (places < first + chunk.shape[1]))
            alone = alone[copies[places[alone]] == 1]
            scores[alone, places[alone] - first] = -np.inf
            if limit.min() <= _NONE + 1 and chunk.shape[1] > top:
                kth = np.partition(scores, -top, 1)[:, -top]
                limit = np.maximum(limit, np.where(np.isfinite(kth), kth, -edge).astype(np.int64))
            rows = np.flatnonzero(scores.max(1) >= as_limit(limit)[:, 0])
            row, at = np.nonzero(scores[rows] >= as_limit(limit[rows]))
            row = rows[row]
            found = row, at, scores[row, at]
        row, at, score = found
        n = copies[first + at] - (places[row] == first + at)
        fresh = [c[n > 0] for c in (row, first + at, score, n)]
        pending = tuple(np.concatenate([c, np.asarray(x).astype(np.int64)]) for c, x in zip(pending, fresh))
        if len(pending[0]) >= len(reach) or not first:
            best, pending = merged(), (empty, empty, empty, empty)
    row, place, score, n = merged()
    return reach[row], ids[place], score, n


def _numbers(cell: pa.Scalar) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), np.int64)


def _packed(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, ...]:
    """Ids, counts and columns of a packed row."""
    ids, copies = _numbers(batch.column("ids")[n]), _numbers(batch.column("copies")[n])
    size = batch.column("size")[n].as_py()
    return ids, copies, np.frombuffer(batch.column("postings")[n].as_buffer(), f"i{size}").reshape(-1, len(ids))


def _joined(shards: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Ids in ascending order, counts and columns of some shards together."""
    ids, copies = (np.concatenate([s[n] for s in shards]) for n in (0, 1))
    columns = np.zeros((max(len(s[2]) for s in shards), len(ids)), np.result_type(*[s[2] for s in shards]))
    first = 0
    for own, _, part in shards:
        columns[: len(part), first : first + len(own)] = part
        first += len(own)
    order = np.argsort(ids, kind="stable")
    return ids[order], copies[order], columns[:, order]


def _found(block: tuple[np.ndarray, ...], known: np.ndarray, unit: tuple[np.ndarray, ...], top: int) -> tuple[np.ndarray, ...]:
    """row, id, score, copies of a unit's best entries for each query of a block."""
    (own, _, queries), (ids, copies, columns) = block, unit
    width = max(len(queries), len(columns))
    queries = np.pad(queries, ((0, width - len(queries)), (0, 0))).T.astype(np.int64)
    columns = np.pad(columns, ((0, width - len(columns)), (0, 0))) if len(columns) < width else columns
    least, after = np.full(len(own), _NONE), np.full(len(own), _EDGE)
    at, least_score, last_id = known.reshape(3, -1)
    kind = _exact(queries, columns)
    if kind:
        least[at], after[at] = np.clip(least_score, _NONE + 1, -_NONE), last_id
        return top_of_block(queries, own, ids, copies, columns, top, least, after, kind)
    # whole numbers of 64 bits, or of any size
    most = float(np.abs(queries.astype(float)).max()) * float(np.abs(columns.astype(float)).max()) * width
    numbers = np.int64 if most < 2.0**61 else object
    queries, columns = queries.astype(numbers), columns.astype(numbers)
    thresholds = {int(row): int(score) for row, score in zip(at, least_score) if score > -_EDGE - 1}
    found = [
        (row, i, score, 1)
        for row, q in enumerate(queries)
        for score, i in top_of_shard(q, columns, ids, copies, own[row], top, thresholds.get(row))
    ]
    return tuple(np.array(c, np.int64) for c in (zip(*found) if found else [()] * 4))


def _search(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, shards, joined = None, [], None
        for batch in batches:
            for n in range(batch.num_rows):
                if unit != batch.column("unit")[n].as_py():
                    unit, shards, joined = batch.column("unit")[n].as_py(), [], None
                block = batch.column("block")[n].as_py()
                if block < 0:  # a unit's shards come first
                    shards.append(_packed(batch, n))
                    continue
                if shards:
                    joined, shards = _joined(shards), []
                if joined is None:  # a unit that no candidate was dealt to
                    continue
                asked = _packed(batch, n)
                known = batch.column("known")[n]
                known = _numbers(known) if known.is_valid else np.zeros(0, np.int64)
                row, ids, score, copies = _found(asked, known, joined, top)
                row, ids, score = (np.repeat(c, np.minimum(copies, top)) for c in (row, ids, score))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(row), block, np.int32)),
                        pa.array(row.astype(np.int32)),
                        *(pa.array(c.astype(np.int64)) for c in (asked[1][row], asked[0][row], ids, score)),
                    ],
                    ["block", "row", "times", "query_id", "vec_id", "score"],
                )

    return run


def _known(table: pa.Table) -> pa.Table:
    """A block's thresholds: rows, k-th best scores and their ids, one after another."""
    numbers = np.concatenate([table.column(c).to_numpy().astype(np.int64) for c in ("row", "score", "vec_id")])
    return pa.table({"block": table.column("block").slice(0, 1), "known": pa.array([numbers.tobytes()], pa.binary())})


def whole_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, v, copies: floor(256 * x) of each component without zeros at the end, for rows that take part."""
    x = F.col("embedding").cast("array<double>")
    broken = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    fit = F.col("vec_id").isNotNull() & x.isNotNull() & ~F.coalesce(broken, F.lit(True))
    known = rows.where(fit).select(F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c * 256)).alias("v"))
    last = F.array_max(F.transform("v", lambda c, i: F.when(c != 0, i + 1).otherwise(0)))
    known = known.select("vec_id", F.slice("v", F.lit(1), F.coalesce(last, F.lit(0))).alias("v"))
    return known.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"))


def _dealt(vectors: DataFrame, count: int, rows: int) -> DataFrame:
    shard = F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, -(-count // rows)))).cast("int").alias("shard")
    packed = vectors.select(shard, "vec_id", "v", "copies").groupBy("shard")
    return packed.applyInArrow(_pack, "shard int, ids binary, copies binary, size int, postings binary")


def _units(candidates: int, queries: int) -> int:
    wanted = max(ROUND, min(UNITS, math.ceil(candidates * queries / UNIT_PAIRS)), math.ceil(candidates / UNIT_ROWS))
    return max(1, min(wanted, math.ceil(candidates / SHARD_ROWS)))


def _scored(shards: DataFrame, blocks: DataFrame, units: int, first: bool, top: int) -> DataFrame:
    """The rows that the units of the first round, or all others, return for all blocks."""
    chosen = [u for u in range(units) if (u % ROUND == 0) == first]
    unit = F.pmod("shard", F.lit(units))
    packed = ["ids", "copies", "size", "postings"]
    held = shards.select(unit.alias("unit"), F.lit(-1).alias("block"), *packed, F.lit(None).cast("binary").alias("known"))
    asked = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(units - 1))).alias("unit"), "block", *packed, "known")
    work = held.unionByName(asked).where((F.col("unit") % ROUND == 0) == F.lit(first))
    # a task for each unit
    place = F.floor(F.col("unit") / ROUND).cast("int")
    dealt = work.repartitionById(len(chosen), place if first else F.col("unit") - place - 1)
    schema = "block int, row int, times long, query_id long, vec_id long, score long"
    return dealt.sortWithinPartitions("unit", "block").mapInArrow(_search(top), schema)


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("block", "row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(rows: DataFrame, is_query: Column, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score for every row that ``is_query`` (a condition on vec_id) holds for, against all other rows."""
    vectors = publish(whole_vectors(rows), "maxscore-vectors")
    asked = vectors.where(is_query)
    candidates, queries = vectors.count(), asked.count()
    units = _units(candidates, queries)
    shards = publish(_dealt(vectors, candidates, SHARD_ROWS), "maxscore-shards")
    blocks = publish(_dealt(asked, queries, BLOCK_ROWS).withColumnRenamed("shard", "block"), "maxscore-queries")
    unknown = blocks.withColumn("known", F.lit(None).cast("binary"))
    ranked = _best(_scored(shards, unknown, units, True, top), top)
    if units > 1:
        seeds = publish(ranked, "maxscore-seeds")
        known = seeds.where(F.col("rank") == top).groupBy("block").applyInArrow(_known, "block int, known binary")
        others = _scored(shards, publish(blocks.join(known, "block", "left"), "maxscore-thresholds"), units, False, top)
        ranked = _best(seeds.drop("rank").unionByName(others), top)
    # equal queries have equal answers
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return ranked.select("query_id", "rank", "vec_id", "score", times.alias("time")).drop("time")


ORACLE = """
WITH v AS MATERIALIZED (
  SELECT vec_id, [floor(256 * x::double) for x in embedding] AS v, row_number() OVER () AS n FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.n <> c.n),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::int AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""
