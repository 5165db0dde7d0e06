"""Toxicity: a convolutional text classifier over hashed words, trained in numpy.

Words (runs of letters and digits, A-Z in lower case) are hashed.  A hash that enough
training texts have is a row of the embedding table; a rarer word takes the row of its
hashed first bytes, which inflected words share, or else the row of unknown words.
Filters of widths 1 to 3 slide over the words of a whole text, each keeps its maximum,
and a logistic layer reads the maxima.  For scoring, filters and embeddings are
multiplied into one table a word position, so a text costs a few gathers a word.  Only
the text is ever read for a score.

Training reads at most ``rows`` labelled rows whose texts have at most ``words`` words;
that sample (32-bit word rows) is all that reaches the driver.  The model that travels to the
tasks has a fixed size.  Thresholds are calibrated by language on rows kept out of the
training, and only decide ``flagged``; ``predicted`` uses the one fixed threshold.

Null and empty texts get the score of an empty text; repeated rows score alike; without
labels every score is 0.5; languages without enough labels use the threshold of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenkeel.llm.common import LETTERS_ONLY, byte_runs, held_out, labelled_sample, word_hashes

#: Bounds of the training sample: labelled rows, and words of a text.
TRAINING_ROWS = 8_000
TRAINING_WORDS = 2_000
THRESHOLD = 0.3

#: Hash space of words and of beginnings; texts that must have one for a row of its own.
BUCKETS = 1 << 18
LEAST_TEXTS = 5
BEGINNING = 4
WIDTHS = (1, 2, 3)
#: Words scored at a time within a text.
AT_ONCE = 1 << 16
#: Rows 0 and 1 of the embeddings: padding, unknown words.
PAD, UNKNOWN = 0, 1


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words x 2) places in the hash space, of the word and of its beginning; the texts' ranges."""
    hashes, bounds, starts = word_hashes(data, offsets, LETTERS_ONLY, BEGINNING)
    both = np.stack([hashes, starts], 1) % np.uint64(BUCKETS)
    return both.astype(np.int32), bounds


def _own_rows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Maps of words and of beginnings to embedding rows (0: none), and the number of rows."""
    maps, n = [], 2
    for k in range(2):
        in_texts = np.zeros(BUCKETS, np.int32)
        for t in texts:
            in_texts[np.unique(t[:, k])] += 1
        own = np.zeros(BUCKETS, np.int32)
        often = np.flatnonzero(in_texts >= LEAST_TEXTS)
        own[often] = n + np.arange(len(often))
        n += len(often)
        maps.append(own)
    return maps[0], maps[1], n


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


class ToxicityModel:
    """Embeddings, filters and the logistic layer."""

    def __init__(self, texts: list[np.ndarray] = (), dim: int = 8, filters: int = 8, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.words, self.starts, rows = _own_rows(texts)
        self.p = {"emb": rng.normal(0, 0.1, (rows, dim)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"conv{w}"] = rng.normal(0, 1 / np.sqrt(w * dim), (w, dim, filters)).astype(np.float32)
            self.p[f"bias{w}"] = np.zeros(filters, np.float32)
        self.p["out"] = rng.normal(0, 0.1, len(WIDTHS) * filters).astype(np.float32)
        self.p["out_bias"] = np.zeros(1, np.float32)
        self.p["emb"][0] = 0
        self.slope, self.offset = 1.0, 0.0  # calibration of the logit
        self.thresholds: dict[str, float] = {}
        self.general = THRESHOLD

    def ids(self, hashed: np.ndarray) -> np.ndarray:
        """Embedding rows of hashed words."""
        own, start = self.words[hashed[:, 0]], self.starts[hashed[:, 1]]
        return np.where(own > 0, own, np.where(start > 0, start, UNKNOWN))

    def tables(self) -> dict[int, np.ndarray]:
        """For each width, what a word adds at each position of a filter."""
        return {w: np.matmul(self.p["emb"], self.p[f"conv{w}"]) for w in WIDTHS}

    @staticmethod
    def _maps(words: int, part):
        """Outputs of each width at every word; ``part(w, j, a, b)``: what words a to b add at place j."""
        for w in WIDTHS:
            n = words - w + 1
            out = part(w, 0, 0, n)
            for j in range(1, w):
                out += part(w, j, j, j + n)
            yield w, out

    def pooled(self, texts: list[np.ndarray]):
        """Maxima (texts x features) and their positions; texts are padded by the widest filter,
        so that no window runs into the next text."""
        pad = np.zeros(WIDTHS[-1] - 1, np.int32)
        lengths = np.array([max(len(t), 1) for t in texts])
        ids = np.concatenate([x for t in texts for x in (t if len(t) else pad[:1], pad)])
        starts = np.concatenate([[0], np.cumsum(lengths + len(pad))])
        maxima, places = [], []
        words = self.p["emb"][ids]
        for w, out in self._maps(len(ids), lambda w, j, a, b: words[a:b] @ self.p[f"conv{w}"][j]):
            at = np.stack([out[s : s + n].argmax(0) + s for s, n in zip(starts, lengths)])
            maxima.append(np.take_along_axis(out, at, 0) + self.p[f"bias{w}"])
            places.append(at)
        return np.concatenate(maxima, 1), places, ids

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        features, *_ = self.pooled(texts)
        return np.maximum(features, 0) @ self.p["out"] + self.p["out_bias"][0]

    def score_one(self, tables, ids: np.ndarray) -> float:
        """Score of a whole text, block by block; blocks overlap by the widest filter."""
        ids = ids if len(ids) else np.zeros(1, np.int32)
        ids = np.concatenate([ids, np.zeros(WIDTHS[-1] - 1, np.int32)])
        most = None
        n = len(ids) - (WIDTHS[-1] - 1)
        for first in range(0, n, AT_ONCE):
            block = ids[first : min(first + AT_ONCE, n) + WIDTHS[-1] - 1]
            maps = self._maps(len(block), lambda w, j, a, b: tables[w][j][block[a:b]])
            here = np.concatenate([out[: len(block) - WIDTHS[-1] + 1].max(0) for _, out in maps])
            most = here if most is None else np.maximum(most, here)
        features = np.maximum(most + np.concatenate([self.p[f"bias{w}"] for w in WIDTHS]), 0)
        logit = float(features @ self.p["out"] + self.p["out_bias"][0])
        return float(_sigmoid(self.slope * logit + self.offset))

    def fit(self, texts: list[np.ndarray], y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        filters, step = len(self.p["bias1"]), 0
        heavy = np.where(y == 1, min(4.0, (len(y) - y.sum()) / max(y.sum(), 1)), 1.0)
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for s in range(0, len(order), batch):
                rows = order[s : s + batch]
                features, places, ids = self.pooled([texts[r] for r in rows])
                active = np.maximum(features, 0)
                error = (_sigmoid(active @ self.p["out"] + self.p["out_bias"][0]) - y[rows]) * heavy[rows] / len(rows)
                g = {"out": active.T @ error, "out_bias": np.array([error.sum()])}
                back = (error[:, None] * self.p["out"]) * (features > 0)
                g["emb"] = np.zeros_like(self.p["emb"])
                for k, w in enumerate(WIDTHS):
                    part, at = back[:, k * filters : (k + 1) * filters], places[k]
                    g[f"bias{w}"] = part.sum(0)
                    g[f"conv{w}"] = np.empty_like(self.p[f"conv{w}"])
                    for j in range(w):
                        words = ids[at + j]  # texts x filters
                        g[f"conv{w}"][j] = np.einsum("nf,nfd->df", part, self.p["emb"][words])
                        np.add.at(g["emb"], words, part[:, :, None] * self.p[f"conv{w}"][j].T)
                g["emb"][0] = 0
                step += 1
                for k, grad in g.items():
                    m[k] += 0.1 * (grad - m[k])
                    v[k] += 0.001 * (grad * grad - v[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def calibrate(self, logits: np.ndarray, y: np.ndarray, langs: list) -> None:
        """Platt's line for the score, then the threshold of each language with the best F1."""
        if len(y) < 20 or y.min() == y.max():
            return
        target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(200):  # Newton on two numbers
            p = _sigmoid(a * logits + b)
            w, e = p * (1 - p) + 1e-6, p - target
            h = np.array([[(w * logits**2).sum() + 1e-3, (w * logits).sum()], [(w * logits).sum(), w.sum() + 1e-3]])
            da, db = np.linalg.solve(h, [(e * logits).sum() + 1e-3 * a, e.sum()])
            a, b = a - float(np.clip(da, -1, 1)), b - float(np.clip(db, -1, 1))
        self.slope, self.offset = max(a, 1e-3), b
        scores = _sigmoid(self.slope * logits + self.offset)
        self.general = _best_threshold(scores, y)
        for lang in {x for x in langs if x is not None}:
            mine = np.array([x == lang for x in langs])
            if mine.sum() >= 20 and 0 < y[mine].sum() < mine.sum():
                self.thresholds[lang] = _best_threshold(scores[mine], y[mine])

    @classmethod
    def train(cls, docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, words: int = TRAINING_WORDS, **options) -> ToxicityModel:
        sample = labelled_sample(docs, labels, "toxic", rows)
        # at most ``rows`` pairs of numbers, so its size is known
        chosen = docs.select("doc_id", "text", "lang").join(F.broadcast(sample), "doc_id")
        hashed = chosen.mapInArrow(_hash_rows(words), "doc_id long, target int, lang string, ids binary")
        data = hashed.groupBy("doc_id").agg(F.min(F.struct("target", "lang", "ids")).alias("r")).select("doc_id", "r.*")
        found = data.toPandas().sort_values("doc_id")
        y = found["target"].to_numpy(float)
        if len(y) < 10 or y.min() == y.max():
            model, rate = cls(), (y.sum() + 1) / (len(y) + 2)
            model.p["out"][:] = 0
            model.p["out_bias"][0] = np.log(rate / (1 - rate))
            return model
        hashed = [np.frombuffer(b, np.int32).reshape(-1, 2) for b in found["ids"]]
        kept = np.arange(len(y)) % 5 == 0
        model = cls([t for t, k in zip(hashed, kept) if not k])
        texts = [model.ids(t) for t in hashed]
        model.fit([t for t, k in zip(texts, kept) if not k], y[~kept], **options)
        rest = [t for t, k in zip(texts, kept) if k]
        logits = np.concatenate([model.logits(rest[i : i + 64]) for i in range(0, len(rest), 64)])
        model.calibrate(logits, y[kept], [None if x != x else x for x in found["lang"][kept]])
        return model


def _best_threshold(scores: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(np.diff(scores[order]) != 0, True)  # equal scores stay on one side
    return float(scores[order][int(np.where(last, f1, -1).argmax())])


def _hash_rows(most_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, ids = [], []
            for first, end, data, offsets in byte_runs(batch.column("text")):
                words, bounds = _hashed(data, offsets)
                for row in range(first, end):
                    mine = words[bounds[row - first] : bounds[row - first + 1]]
                    if len(mine) <= most_words:
                        keep.append(row)
                        ids.append(mine.tobytes())
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.record_batch(
                [part.column("doc_id"), part.column("target").cast(pa.int32()), part.column("lang"), pa.array(ids, pa.binary())],
                ["doc_id", "target", "lang", "ids"],
            )

    return run


def _scorer(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for batch in batches:
            scores = []
            for first, end, data, offsets in byte_runs(batch.column("text"), 1 << 20):
                words, bounds = _hashed(data, offsets)
                ids = model.ids(words)
                scores += [model.score_one(tables, ids[bounds[k] : bounds[k + 1]]) for k in range(end - first)]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("lang"), pa.array(scores, pa.float64())], ["doc_id", "lang", "score"]
            )

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold (of the row's language), flagged; one row per input row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    scored = rows.mapInArrow(_scorer(model), "doc_id long, lang string, score double")
    threshold = F.lit(model.general)
    for lang, value in sorted(model.thresholds.items()):
        threshold = F.when(F.col("lang") == lang, F.lit(value)).otherwise(threshold)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        threshold.alias("threshold"),
        (F.col("score") >= threshold).alias("flagged"),
    )
