"""Document fingerprints from prefix polynomial hashes.

A text's code points give prefix sums of polynomials modulo two primes.  From them the
hash of any span takes constant time, so that two spans are compared without reading
them, a longest common extension is a binary search, and the hash of an edited text is
put together from those of its parts.

A fingerprint is the length, the hash of the whole text, and the smallest ``SKETCH``
distinct hashes of all spans of ``SPAN`` code points (of the whole text, if it is shorter).  The likeness of
two fingerprints is the Dice share of common spans that the sketches estimate.  Equal
texts have equal fingerprints and likeness 1.

Neighbours: documents are dealt by ranges of doc_id into sorted buckets, and the first
document of each bucket is also sent to the end of the bucket before (of the last bucket,
for the first of all).  So texts are shuffled once, and a task holds two texts at a time.

Null texts are empty; rows that share a doc_id come in the order of a hash of their
texts; null ids come first; a single row is its own neighbour; an empty input gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenkeel.llm.common import mixed

SPAN = 12
SKETCH = 32
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1812433253)


class _Powers:
    """Powers of a base and of its inverse modulo a prime, as far as needed."""

    def __init__(self, base: int, prime: int):
        self.prime, self.steps = np.uint64(prime), (base % prime, pow(base, -1, prime))
        self.up, self.down = (np.ones(1, np.uint64) for _ in range(2))

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            size = len(self.up)
            for name, step in zip(("up", "down"), self.steps):
                have = getattr(self, name)
                more = have * np.uint64(pow(step, size, int(self.prime))) % self.prime
                setattr(self, name, np.concatenate([have, more]))


POWERS = [_Powers(b, p) for b, p in zip(BASES, PRIMES)]


class PrefixHash:
    """Prefix arrays of one text."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        codes = points.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for power in POWERS:
            power.reach(self.n + 1)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(codes * power.up[: self.n] % power.prime, out=sums[1:])
            self.sums.append(sums % power.prime)

    @classmethod
    def of(cls, text: str) -> PrefixHash:
        return cls(np.frombuffer(text.encode("utf-32-le"), np.uint32))

    def spans(self, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        """Hashes of spans, wherever they stand: both remainders in one number."""
        parts = []
        for power, sums in zip(POWERS, self.sums):
            parts.append((sums[ends] + power.prime - sums[starts]) % power.prime * power.down[: self.n + 1][starts] % power.prime)
        return (parts[0] << np.uint64(32)) | parts[1]

    def span(self, start: int, end: int) -> int:
        a, b = (
            (int(sums[end]) - int(sums[start])) * int(power.down[start]) % int(power.prime)
            for power, sums in zip(POWERS, self.sums)
        )
        return a << 32 | b

    def windows(self) -> np.ndarray:
        """Mixed hashes of all spans of ``SPAN`` code points."""
        last = self.n - SPAN + 1
        return mixed(self.spans(slice(0, last), slice(SPAN, self.n + 1))) if last > 0 else np.empty(0, np.uint64)

    def equal(self, start: int, other: PrefixHash, at: int, length: int) -> bool:
        return self.span(start, start + length) == other.span(at, at + length)

    def extension(self, start: int, other: PrefixHash, at: int, most: int | None = None) -> int:
        """Longest common extension from two places, by binary search."""
        low, high = 0, min(self.n - start, other.n - at)
        high = high if most is None else min(high, most)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(start, other, at, middle) else (low, middle - 1)
        return low


def smallest(hashes: np.ndarray) -> np.ndarray:
    """The ``SKETCH`` smallest distinct hashes."""
    if len(hashes) > 16 * SKETCH:
        few = np.unique(hashes[hashes < np.uint64((4 * SKETCH << 64) // len(hashes))])
        if len(few) >= SKETCH:
            return few[:SKETCH]
    return np.unique(hashes)[:SKETCH]


def _print(n: int, whole: int, sketch: np.ndarray) -> str:
    return f"{n:x}-{whole:016x}-" + "".join(f"{int(h) >> 24:010x}" for h in sketch)


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    x, y = ({s[i : i + 10] for i in range(0, len(s), 10)} for s in (a.rpartition("-")[2], b.rpartition("-")[2]))
    both = sorted(x | y)[:SKETCH]
    share = sum(h in x and h in y for h in both) / len(both) if both else 0.0
    return 2 * share / (1 + share)


class Document:
    """A text with its prefix arrays and what its fingerprint is made of."""

    def __init__(self, text: str):
        self.text, self.hash = text, PrefixHash.of(text)
        self.n, self.windows = self.hash.n, self.hash.windows()
        self.print = _print(self.n, self.hash.span(0, self.n), self._sketch(self.windows, self.hash))

    @staticmethod
    def _sketch(windows: np.ndarray, whole: PrefixHash) -> np.ndarray:
        if len(windows):
            return smallest(windows)
        return mixed(whole.spans(np.array([0]), np.array([whole.n]))) if whole.n else windows

    def edited(self, other: Document) -> tuple[str, str, int]:
        """(text, fingerprint, common prefix) after the last half gave way to the beginning of ``other``.

        Spans on either side are those already hashed; only the spans across the seam are new.
        """
        half = self.n // 2
        keep, more = self.n - half, min(half, other.n)
        text = self.text[:keep] + other.text[:more]
        left, right = max(keep - SPAN + 1, 0), min(more, SPAN - 1)
        seam = PrefixHash.of(text[left : keep + right])
        windows = [smallest(self.windows[: max(keep - SPAN + 1, 0)]), smallest(other.windows[: max(more - SPAN + 1, 0)]), seam.windows()]
        parts = []
        for power, a, b in zip(POWERS, self.hash.sums, other.hash.sums):
            power.reach(keep + 1)
            parts.append((int(a[keep]) + int(b[more]) * int(power.up[keep])) % int(power.prime))
        sketch = np.concatenate(windows)
        sketch = smallest(sketch) if len(sketch) else self._sketch(sketch, PrefixHash.of(text))
        common = keep + self.hash.extension(keep, other.hash, 0, more)
        return text, _print(keep + more, parts[0] << 32 | parts[1], sketch), common


FIELDS = {
    "doc_id": pa.int64(),
    "n_chars": pa.int64(),
    "edited_sha256": pa.string(),
    "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(),
    "near_next": pa.float64(),
    "prefix_edited": pa.int64(),
    "prefix_next": pa.int64(),
}
_DDL = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, prefix_edited long, prefix_next long"
)


def _compare(doc_id, a: Document, b: Document) -> tuple:
    text, changed, common = a.edited(b)
    digest = hashlib.sha256(text.encode()).hexdigest()
    near = likeness(a.print, changed), likeness(a.print, b.print)
    return doc_id, a.n, digest, a.print, changed, *near, common, a.hash.extension(0, b.hash, 0)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before = None
    schema, rows = pa.schema(list(FIELDS.items())), []
    for batch in batches:
        for bucket, late, doc_id, text in zip(*(batch.column(c) for c in ("bucket", "late", "doc_id", "text"))):
            document = Document(text.as_py() or "")
            if before is not None and before[0] == bucket.as_py():
                rows.append(_compare(before[1], before[2], document))
            # a borrowed row ends its bucket
            before = None if late.as_py() else (bucket.as_py(), doc_id.as_py(), document)
            if len(rows) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """``FIELDS`` for each row and the row that follows it by doc_id."""
    spark = docs.sparkSession
    docs = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"),
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # the bucket bounds are as many numbers as there are buckets
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = docs.agg(F.percentile_approx("key", shares, 8 * buckets)).first()[0] or []
    bounds = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def bucket_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), "right").astype(np.int32))

    first = {r[0]: r[1] for r in docs.groupBy(bucket_of("key").alias("b")).agg(F.min("key")).collect()}
    order = sorted(first)
    lender = {first[b]: order[i - 1] for i, b in enumerate(order)}  # the first of all goes to the last

    @F.pandas_udf("array<struct<bucket:int,late:boolean>>")
    def places(key: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, key.to_numpy(), "right")
        return pd.Series(
            [[(int(b), False)] + ([(lender[k], True)] if k in lender else []) for k, b in zip(key.tolist(), own)]
        )

    dealt = docs.select("key", "doc_id", "text", F.explode(places("key")).alias("p")).select("p.*", "key", "doc_id", "text")
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", "late", "key", F.xxhash64("text"))
    return ordered.select("bucket", "late", "doc_id", "text").mapInArrow(_neighbours, _DDL)
