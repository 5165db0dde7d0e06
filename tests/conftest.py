from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from evenkeel.schemas import SHARD_FIELDS, quantise  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


def shard_of(uid: str = "uid", name: str | None = None):
    none = F.lit(None).cast("string")
    fields = {"uid": F.col(uid), "name": F.col(name) if name else none}
    return F.struct(*[fields.get(f, none).alias(f) for f in SHARD_FIELDS]).alias("shard")


def loads(spark, rows, scale: int = 9) -> DataFrame:
    """Load indexes from (ref, uid, name, value) rows."""
    df = spark.createDataFrame(rows, "ref string, uid string, name string, v double")
    return df.select(
        "ref", shard_of("uid", "name"), quantise(F.col("v"), scale).alias("value"), F.lit("").alias("display_value")
    )


def metric_values(spark, rows) -> DataFrame:
    """Metric values from (ref, metric_id, uid, value) rows."""
    df = spark.createDataFrame(rows, "ref string, metric_id string, uid string, v double")
    return df.select(
        "ref",
        "metric_id",
        shard_of("uid"),
        F.lit("").alias("query"),
        quantise(F.col("v")).alias("value"),
        F.lit("").alias("display_value"),
    )
