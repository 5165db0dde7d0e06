"""A corpus, stage by stage: good documents, one of each near-duplicate group, no secrets, mixed, encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's ``docs``.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evenkeel.llm import mixing, quality, secrets, sentencepiece, simhash
from evenkeel.llm.common import table
from evenkeel.stages import publish


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, quality.QualityModel.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id, or one without an id if none has one."""
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secrets.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes them."""
    return mixing.mix(docs, whole=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_words, ids."""
    found = sentencepiece.encode(docs.select("doc_id", "lang", "source", "text"))
    return found.select("_row.*", "n_words", "ids")


STAGES = [
    ("quality", drop_bad),
    ("near_duplicates", drop_near_copies),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
    ("encode", encode),
]

#: Classifier, fingerprints and vocabulary have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = publish(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
