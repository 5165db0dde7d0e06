"""Quality classifier: a sparse ensemble of rules over text statistics, run as column expressions.

Training reads at most ``rows`` labelled rows (the bound of what reaches the driver:
one row of statistics each).  Scoring is one scan of the texts without Python.
Null and empty texts have the statistics zero and get the score of those; repeated
rows get equal scores; an empty input gives an empty result; without labels the score
is 0.5 for all.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.llm import rule_ensemble
from evenkeel.llm.common import SPACES, held_out, labelled_sample, once

#: Labelled rows that training may use.
TRAINING_ROWS = 20_000
THRESHOLD = 0.7

#: The statistics that rules read, in order.
FEATURES = ["words", "word_length", "distinct_words", "line_words", "distinct_lines", "signs", "digits", "stops"]

#: Counted signs.
SIGNS = r"[|#$%&*<>{}=_~^@\\]"


def counts(text: Column) -> Column:
    """Raw counts of a whole text, each computed once; parts are what white space separates."""
    text = F.coalesce(text, F.lit(""))
    parts = F.split(text, rf"[{SPACES}]+")
    lines = F.split(text, "\n")
    return F.struct(
        F.length(text).alias("chars"),
        F.size(parts).alias("words"),
        F.size(F.array_distinct(parts)).alias("distinct_words"),
        F.size(lines).alias("lines"),
        F.size(F.array_distinct(lines)).alias("distinct_lines"),
        F.regexp_count(text, F.lit(SIGNS)).alias("signs"),
        F.regexp_count(text, F.lit("[0-9]")).alias("digits"),
        F.regexp_count(text, F.lit("[.,;:!?]")).alias("stops"),
    )


def statistics(c: str) -> dict[str, Column]:
    """Statistics over the counts in struct column ``c``."""

    def share(part: str, whole: str) -> Column:
        # there is always a part and a line; an empty text has no characters
        whole_count = F.greatest(F.col(f"{c}.{whole}"), F.lit(1))
        return F.col(f"{c}.{part}").cast("double") / whole_count

    return {
        "words": F.col(f"{c}.words").cast("double"),
        "word_length": share("chars", "words"),
        "distinct_words": share("distinct_words", "words"),
        "line_words": share("words", "lines"),
        "distinct_lines": share("distinct_lines", "lines"),
        "signs": share("signs", "words"),
        "digits": share("digits", "chars"),
        "stops": share("stops", "words"),
    }



def with_statistics(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """``keep`` and a struct column ``_stats``."""
    counted = once(docs, counts(F.col(text)), "_counts", *keep)
    return once(counted, F.struct(*[v.alias(k) for k, v in statistics("_counts").items()]), "_stats", *keep)


class QualityModel:
    """Intercept and weighted rules; ``score`` is a column over ``_stats``."""

    def __init__(self, intercept: float, rules: list[tuple[rule_ensemble.Rule, float]]):
        self.intercept, self.rules = intercept, rules

    @classmethod
    def train(cls, docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, **options) -> QualityModel:
        sample = labelled_sample(docs, labels, "quality", rows)
        # at most ``rows`` pairs of numbers, so its size is known
        chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
        found = with_statistics(chosen, "doc_id", "target").groupBy("doc_id", "target").agg(F.min("_stats").alias("s"))
        data = found.select("doc_id", "target", "s.*").toPandas().sort_values("doc_id")
        x, y = data[FEATURES].to_numpy(float), data["target"].to_numpy(float)
        return cls(*rule_ensemble.fit(x, y, **options)) if len(y) else cls(0.0, [])

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            met = F.lit(True)
            for f, at_most, cut in rule:
                value = F.col(f"_stats.{FEATURES[f]}")
                met = met & ((value <= cut) if at_most else (value > cut))
            total = total + F.when(met, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score_numpy(self, x: np.ndarray) -> np.ndarray:
        a = rule_ensemble.activations(x, [r for r, _ in self.rules])
        return 1 / (1 + np.exp(-(self.intercept + a @ np.array([w for _, w in self.rules]))))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per input row."""
    scored = once(with_statistics(docs, "doc_id"), model.score(), "score", "doc_id")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns.

    A model without rules (no labels, fewer than ten, or of one class) tells no documents apart and rejects none.
    """
    if not model.rules:
        return docs
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))
    scored = once(with_statistics(whole, "_row", text="_text"), model.score(), "_score", "_row")
    return scored.where(F.col("_score") >= THRESHOLD).select("_row.*")
