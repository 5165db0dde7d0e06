"""Driver queries of this folder: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evenkeel.llm import fingerprints, maxscore, mixing, prefix_trie, quality, role_repair, secrets, sentencepiece, simhash, substrings, toxicity, url_globs, warc
from evenkeel.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.QualityModel.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, run: n + run["end"] - run["first"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[f"n_{k}" for k in secrets.KINDS],
        F.sha2(secrets.as_text("base"), 256).alias("base_sha256"),
        secrets.as_text("spans").alias("spans"),
    )


def op4_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.ToxicityModel.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model)


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses_of(table(spark, sf_dir, "pages")))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and the digest of what they decode to."""
    found = sentencepiece.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = found.select(F.struct("_row.doc_id", "n_words", "ids").alias("_row"), "ids")
    return sentencepiece.decode(found).select("_row.*", F.sha2("text", 256).alias("decoded_sha256"))


def op7_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixed_rows(docs).select(
        "doc_id", "size", "source_size", "target", "taken", F.array_join("shards", ",").alias("shards")
    )


def op9_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op11_url_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_globs.judge(table(spark, sf_dir, "pages"))
    return found.select("row.page_id", "host", "path", "rule", "pattern", "verdict")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_repair.damage_and_repair(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_substring_dedup,
        op3_secret_scan,
        op4_toxicity_cnn,
        op5_warc_derivatives,
        op6_sentencepiece,
        op7_prefix_fingerprints,
        op8_source_mixing,
        op9_maxscore_top_k,
        op10_simhash_near_dedup,
        op11_url_globs,
        op12_prefix_trie,
        op13_role_repair,
    )
}
