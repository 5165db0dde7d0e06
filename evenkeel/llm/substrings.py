"""Substring dedup: repeated windows of words, by Rabin-Karp hashes counted in Spark.

Words come from white-space splitting.  Texts are dealt into chunks by a hash of the
row.  Each chunk hashes every window of its texts (a rolling polynomial over word hashes, cut to
as many bits as the number of windows asks for), sorts the distinct hashes and sends
them, cut into ranges of the hash space ("buckets") and packed as differences, with a mark
on those it saw more than once.  A bucket counts the hashes of all chunks and answers each
with one bit per hash sent.

Hits are then compared: for each hash that was found again, the chunk sends check sums of
its windows' words (64 bits, by another word hash, put together as a tree) to the same
bucket, which returns the hashes whose words repeat.  Where a chunk has several
word sequences for one hash, it gets their check sums too.  The chunk merges the repeated windows
into maximal intervals.  A window that repeats thousands of times is one entry of
each chunk, so no task holds its occurrences.  Chunks and buckets are placed one to a partition.

All windows of all texts are counted.  A window is lost by chance only where two word
sequences agree in hash and check sum, some 2**100 to one for a pair: no run of letters or words that
is built to fool a polynomial does.

Null and empty texts have no words; texts shorter than a window lose nothing; repeated
rows are repeats of each other and lose all their windows; an empty input gives an
empty result.  A very long text makes a chunk of its own size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenkeel.llm.common import SPLIT_AT_SPACES, byte_runs, mixed, powers, word_edges

WINDOW = 35
#: Text bytes of a chunk, and windows of a bucket, on average.
CHUNK_BYTES = 24 << 20
BUCKET_WINDOWS = 2_000_000

_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Of the word hashes, one for windows and one for check sums.
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Longer words are hashed one by one.
_LONG = 256


def word_values(data: np.ndarray, offsets: np.ndarray, kinds: int) -> tuple[list[np.ndarray], np.ndarray]:
    """One 64-bit hash of each kind for all words, and each text's range in them.

    A word is taken by eight bytes at a time, mixed after each, so that words of one length up to eight
    bytes never fall together.
    """
    start, end, bounds = word_edges(SPLIT_AT_SPACES[data], offsets)
    length = end - start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data), "<u8", padded.tobytes(), strides=(1,))  # the bytes from each place on
    values = [mixed(length.astype(np.uint64) * np.uint64(seed)) for seed in _SEEDS[:kinds]]
    long = np.flatnonzero(length > _LONG)
    left = np.flatnonzero(length <= _LONG)
    at = 0
    while len(left):
        room = length[left] - at
        piece = eight[start[left] + at]
        short = room < 8
        piece[short] &= (np.uint64(1) << (room[short] * 8).astype(np.uint64)) - np.uint64(1)
        for v, seed in zip(values, _SEEDS):
            v[left] = mixed((v[left] ^ piece) * np.uint64(seed))
        left, at = left[room > 8], at + 8
    for n in long.tolist():
        digest = hashlib.blake2b(data[start[n] : end[n]], digest_size=16).digest()
        for k, v in enumerate(values):
            v[n] = int.from_bytes(digest[8 * k : 8 * k + 8], "little")
    return values, bounds


def window_hashes(words: np.ndarray, window: int, starts: np.ndarray) -> np.ndarray:
    """Rolling polynomials of the windows at ``starts``."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_BASE, len(words)), out=sums[1:])
    return mixed((sums[starts + window] - sums[starts]) * powers(_BASE_INVERSE, len(words))[starts])


def window_checks(words: np.ndarray, window: int, starts: np.ndarray) -> np.ndarray:
    """Check sums of the windows at ``starts``: pairs of pairs of words, mixed at each level."""
    block, length, out, done = words, 1, np.full(len(starts), window, np.uint64), 0
    while True:
        if window & length:
            out = mixed(out * np.uint64(_SEEDS[0]) + block[starts + done])
            done += length
        if 2 * length > window:
            return out
        block = mixed(block[:-length] * np.uint64(_SEEDS[1]) + block[length:])
        length *= 2


def hash_bits(windows: int) -> int:
    """Bits of a window's hash: few enough to pack well, enough that of 4,000 windows one is compared in vain."""
    return min(64, max(32, windows.bit_length() + 12))


def _runs(texts: pa.Array, window: int, bits: int, checks: bool = False) -> Iterator[tuple]:
    """(first row, end row, word bounds, window hashes, window starts, check sums of some starts) over runs of rows."""
    for first, end, data, offsets in byte_runs(texts):
        values, bounds = word_values(data, offsets, 2 if checks else 1)
        last = np.repeat(bounds[1:], np.diff(bounds))  # end of the text of each word
        starts = np.flatnonzero(np.arange(len(last)) + window <= last)
        hashes = window_hashes(values[0], window, starts) if len(starts) else np.empty(0, np.uint64)
        check = partial(window_checks, values[-1], window)
        yield first, end, bounds, hashes >> np.uint64(64 - bits), starts, check


def pack(sorted_hashes: np.ndarray) -> bytes:
    """Width of the largest difference, then the differences at that width."""
    steps = np.diff(sorted_hashes, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(packed: bytes) -> np.ndarray:
    width = packed[0]
    narrow = np.frombuffer(packed, np.uint8, offset=1).reshape(-1, width)
    wide = np.zeros((len(narrow), 8), np.uint8)
    wide[:, :width] = narrow
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def _texts(table: pa.Table) -> pa.Array:
    column = table.column("text").cast(pa.large_string())
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _cuts(hashes: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each bucket's range begins in sorted hashes; buckets is a power of two."""
    if buckets == 1:
        return np.array([0, len(hashes)])
    lower = np.arange(1, buckets, dtype=np.uint64) << np.uint64(bits - (buckets.bit_length() - 1))
    return np.concatenate([[0], np.searchsorted(hashes, lower), [len(hashes)]])


def _chunk_hashes(texts: pa.Array, window: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct window hashes in order, and whether each was seen more than once."""
    found = [run[3] for run in _runs(texts, window, bits)]
    hashes = np.concatenate(found) if found else np.empty(0, np.uint64)
    del found
    hashes.sort()
    first = np.ones(len(hashes), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    at = np.flatnonzero(first)
    return hashes[at], np.diff(at, append=len(hashes)) > 1


def _sender(window: int, buckets: int, bits: int):
    def send(table: pa.Table) -> pa.Table:
        hashes, again = _chunk_hashes(_texts(table), window, bits)
        cuts = _cuts(hashes, buckets, bits)
        full = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
        return pa.table(
            {
                "bucket": pa.array(full, pa.int32()),
                "chunk": pa.array([table.column("chunk")[0].as_py()] * len(full), pa.int32()),
                "packed": pa.array([pack(hashes[cuts[b] : cuts[b + 1]]) for b in full], pa.binary()),
                "again": pa.array([np.packbits(again[cuts[b] : cuts[b + 1]]).tobytes() for b in full], pa.binary()),
            }
        )

    return send


def _count(table: pa.Table) -> pa.Table:
    """One bucket: for each chunk, a bit for each hash it sent that occurs more than once in all."""
    sent = [unpack(p.as_py()) for p in table.column("packed")]
    lengths = [len(s) for s in sent]
    hashes = np.concatenate(sent)
    again = np.concatenate([np.unpackbits(np.frombuffer(a.as_py(), np.uint8), count=n) for a, n in zip(table.column("again"), lengths)])
    del sent
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    repeated = again[order].astype(bool)
    same = hashes[1:] == hashes[:-1]
    repeated[1:] |= same
    repeated[:-1] |= same
    bits = np.empty(len(hashes), bool)
    bits[order] = repeated
    parts = np.split(bits, np.cumsum(lengths)[:-1])
    return pa.table(
        {
            "chunk": table.column("chunk"),
            "bucket": table.column("bucket"),
            "bits": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary()),
        }
    )


def _among(sorted_known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(sorted_known):
        return np.zeros(len(hashes), bool)
    return sorted_known[np.minimum(np.searchsorted(sorted_known, hashes), len(sorted_known) - 1)] == hashes


def _unlike_before(hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])
    return first


def _confirmer(window: int, buckets: int, bits: int):
    """Of each chunk: for the hashes found again, the distinct (hash, check sum), by bucket, and which came more than once."""

    def confirm(texts_of: pa.Table, answers: pa.Table) -> pa.Table:
        texts = _texts(texts_of) if texts_of.num_rows else pa.array([], pa.large_string())
        hashes, _ = _chunk_hashes(texts, window, bits)
        cuts, repeated = _cuts(hashes, buckets, bits), np.zeros(len(hashes), bool)
        for bucket, found in zip(answers.column("bucket").to_pylist(), answers.column("bits")):
            first, end = cuts[bucket], cuts[bucket + 1]
            repeated[first:end] = np.unpackbits(np.frombuffer(found.as_py(), np.uint8), count=end - first)
        known = hashes[repeated]
        del hashes, repeated
        found = [(np.empty(0, np.uint64), np.empty(0, np.uint64))]
        if len(known):
            for *_, own, starts, check in _runs(texts, window, bits, checks=True):
                hit = _among(known, own)
                if hit.any():
                    found.append((own[hit], check(starts[hit])))
        hashes, checks = (np.concatenate(c) for c in zip(*found))
        del found
        order = np.lexsort((checks, hashes))
        hashes, checks = hashes[order], checks[order]
        at = np.flatnonzero(_unlike_before(hashes, checks))
        again, hashes, checks = np.diff(at, append=len(hashes)) > 1, hashes[at], checks[at]
        cuts = _cuts(hashes, buckets, bits)
        full = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
        chunk = texts_of.column("chunk")[0].as_py() if full else 0
        return pa.table(
            {
                "bucket": pa.array(full, pa.int32()),
                "chunk": pa.array([chunk] * len(full), pa.int32()),
                "packed": pa.array([pack(hashes[cuts[b] : cuts[b + 1]]) for b in full], pa.binary()),
                "checks": pa.array([checks[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()),
                "again": pa.array([np.packbits(again[cuts[b] : cuts[b + 1]]).tobytes() for b in full], pa.binary()),
            }
        )

    return confirm


def _count_checked(table: pa.Table) -> pa.Table:
    """One bucket: for each chunk, the hashes whose words occur more than once in all, packed.

    A hash for which the chunk has several check sums is not among them; ``several`` has (hash, check
    sum) of those of its windows that repeat.
    """
    hashes_of = [unpack(p.as_py()) for p in table.column("packed")]
    checks_of = [np.frombuffer(c.as_py(), np.uint64) for c in table.column("checks")]
    again = [np.unpackbits(np.frombuffer(a.as_py(), np.uint8), count=len(h)) for a, h in zip(table.column("again"), hashes_of)]
    hashes, checks, repeated = np.concatenate(hashes_of), np.concatenate(checks_of), np.concatenate(again).astype(bool)
    order = np.lexsort((checks, hashes))
    marks, same = repeated[order], ~_unlike_before(hashes[order], checks[order])[1:]
    marks[1:] |= same
    marks[:-1] |= same
    repeated[order] = marks
    packed, several_of = [], []
    for own, check, hit in zip(hashes_of, checks_of, np.split(repeated, np.cumsum([len(h) for h in hashes_of])[:-1])):
        several, equal = np.zeros(len(own), bool), own[1:] == own[:-1]
        several[1:] |= equal
        several[:-1] |= equal
        packed.append(pack(own[hit & ~several]))
        several_of.append(np.stack([own, check], 1)[hit & several].tobytes())
    return pa.table(
        {
            "chunk": table.column("chunk"),
            "bucket": table.column("bucket"),
            "packed": pa.array(packed, pa.binary()),
            "several": pa.array(several_of, pa.binary()),
        }
    )


def covered(starts: np.ndarray, window: int, words: int) -> np.ndarray:
    """Which words the windows at ``starts`` cover: the union of their intervals."""
    edges = np.zeros(words + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return np.cumsum(edges[:-1]) > 0


def intervals(gone: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of removed words, end exclusive."""
    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _remover(window: int, bits: int):
    def remove(texts_of: pa.Table, answers: pa.Table) -> pa.Table:
        words_of, gone_of, kept_of = [], [], []
        texts = _texts(texts_of) if texts_of.num_rows else pa.array([], pa.large_string())
        answers = answers.sort_by("bucket")
        known = np.concatenate([np.empty(0, np.uint64), *(unpack(p.as_py()) for p in answers.column("packed"))])
        several = np.concatenate([np.empty((0, 2), np.uint64), *(np.frombuffer(s.as_py(), np.uint64).reshape(-1, 2) for s in answers.column("several"))])
        doubtful, told = np.unique(several[:, 0]), set(map(tuple, several.tolist()))
        for first, end, bounds, own, starts, check in _runs(texts, window, bits, checks=len(told) > 0):
            hit = _among(known, own)
            unsure = np.flatnonzero(_among(doubtful, own))
            if len(unsure):
                hit[unsure] = [pair in told for pair in zip(own[unsure].tolist(), check(starts[unsure]).tolist())]
            gone = covered(starts[hit], window, int(bounds[-1]))
            for row in range(first, end):
                mine = gone[bounds[row - first] : bounds[row - first + 1]]
                kept, spans = (texts[row].as_py() or "").encode().split(), intervals(mine)
                words_of.append(len(kept))
                for a, b in reversed(spans):
                    del kept[a:b]
                gone_of.append([{"first": a, "end": b} for a, b in spans])
                kept_of.append(b" ".join(kept).decode())
        return pa.table(
            {
                "doc_id": texts_of.column("doc_id"),
                "n_words": pa.array(words_of, pa.int64()),
                "removed": pa.array(gone_of, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                "kept": pa.array(kept_of, pa.string()),
            }
        )

    return remove


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, bucket_windows: int = BUCKET_WINDOWS
) -> DataFrame:
    """doc_id, n_words, removed (intervals of words, end exclusive), kept (words joined by a space)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    # a window needs at least two bytes a word
    buckets = 1 << max(0, (size // 6 // bucket_windows).bit_length())
    bits = hash_bits(size // 2)
    row = F.xxhash64("doc_id", "text")
    dealt = docs.withColumn("chunk", F.pmod(row, F.lit(chunks)).cast("int")).repartitionById(chunks, "chunk")
    sent = dealt.groupBy("chunk").applyInArrow(_sender(window, buckets, bits), "bucket int, chunk int, packed binary, again binary")
    sent = sent.repartitionById(buckets, "bucket")
    answers = sent.groupBy("bucket").applyInArrow(_count, "chunk int, bucket int, bits binary")
    hits = (
        dealt.groupBy("chunk")
        .cogroup(answers.repartitionById(chunks, "chunk").groupBy("chunk"))
        .applyInArrow(_confirmer(window, buckets, bits), "bucket int, chunk int, packed binary, checks binary, again binary")
    )
    told = hits.repartitionById(buckets, "bucket").groupBy("bucket").applyInArrow(_count_checked, "chunk int, bucket int, packed binary, several binary")
    return (
        dealt.groupBy("chunk")
        .cogroup(told.repartitionById(chunks, "chunk").groupBy("chunk"))
        .applyInArrow(
            _remover(window, bits), "doc_id long, n_words long, removed array<struct<first: long, end: long>>, kept string"
        )
    )
