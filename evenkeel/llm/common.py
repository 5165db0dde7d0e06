"""What the operators share: table access, word patterns, and word hashes over whole Arrow batches.

Texts may be null (no words), empty or very long.  Operators pick the columns they
need by name, so further columns of the input, whatever their names, do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space; everything else is part of a word.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def once(df: DataFrame, value: Column, name: str, *keep: str) -> DataFrame:
    """Adds a column that later filters and projections read but never compute again."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int) -> DataFrame:
    """(doc_id, target) of at most ``rows`` labelled rows to learn from: those of the smallest hashes.

    Rows without an id or a 0/1 label are left out, as are ids with differing labels.
    """
    return (
        labels.select("doc_id", F.col(target).alias("target"))
        .where(F.col("doc_id").isNotNull() & F.col("target").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("target").alias("target"), F.max("target").alias("most"))
        .where("target = most")
        .select("doc_id", "target", F.xxhash64("doc_id").alias("h"))
        .orderBy("h", "doc_id")
        .limit(rows)
        .select("doc_id", "target")
    )


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1), modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_runs(texts: pa.Array, most_bytes: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; a longer text is a run of its own."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1)
        end = min(end, len(texts))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


#: For ``word_hashes``: the byte that counts for each byte; 0 separates words.
SPLIT_AT_SPACES = np.array([0 if b == 32 or 9 <= b <= 13 else b + 1 for b in range(256)], np.uint16)
LETTERS_ONLY = np.array(
    [b + 33 if 65 <= b <= 90 else b + 1 if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 0 for b in range(256)],
    np.uint16,
)


def word_edges(code: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of all words of a run, and each text's range in them (offsets of rows + 1)."""
    inside = code > 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(code))]
    opens[edges] = inside[edges]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray, beginning: int = 0) -> tuple[np.ndarray, ...]:
    """64-bit hashes of all words of a run, and each text's range in them (offsets of rows + 1).

    With ``beginning``, also the hashes of each word's first bytes.  Good enough for features: there
    are words of a thousand letters, made for the purpose, that fall together.
    """
    code = codes[data]
    start, end, bounds = word_edges(code, offsets)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code * powers(_BASE, len(data)), out=sums[1:])
    scale = powers(_BASE_INVERSE, len(data) + 1)[start]
    hashes = mixed((sums[end] - sums[start]) * scale ^ (end - start).astype(np.uint64))
    if not beginning:
        return hashes, bounds
    return hashes, bounds, mixed((sums[np.minimum(start + beginning, end)] - sums[start]) * scale)


def arrow_schema(spec: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(spec.items()))
