"""Load index: one weighted p-norm per shard."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.quantity import QUANTITY_PATTERN, parse_quantity, plain_text
from ..schemas import SCALE, quantise


def weight_table(spark: SparkSession, weights: Mapping[str, str | float] | DataFrame) -> DataFrame:
    """Weights as a frame: (metric_id, weight), or with a ``ref`` column per strategy.

    A mapping becomes a local relation, whose size Catalyst knows and broadcasts.
    Weights are numbers or quantity texts such as ``500m``.
    """
    if isinstance(weights, DataFrame):
        return weights
    texts = {k: v for k, v in weights.items() if isinstance(v, str)}
    wrong = [k for k, v in texts.items() if not re.match(QUANTITY_PATTERN, v)]
    if wrong:
        raise ValueError(f"weights that are no quantities: {sorted(wrong)}")
    rows = [(k, texts.get(k), None if k in texts else float(v)) for k, v in weights.items()]
    table = spark.createDataFrame(rows, "metric_id string, text string, number double")
    weight = F.coalesce("number", parse_quantity(F.col("text")).cast("double"))
    return table.select("metric_id", weight.alias("weight"))


def _on(weights: DataFrame) -> list[str]:
    return ["ref", "metric_id"] if "ref" in weights.columns else ["metric_id"]


def load_index(
    values: DataFrame,
    weights: Mapping[str, str | float] | DataFrame,
    p: int = 1,
    scale: int = SCALE,
    rounding: str = "nearest",
) -> DataFrame:
    """(sum of w * x^p)^(1/p) over the weighted metrics of each shard.

    Metrics without a weight are ignored; where rows of a uid differ in the shard's
    attributes, the smallest by field order counts.  A result that is not finite becomes NULL, which
    ``validate.not_finite`` reports.  p must be positive; weights with a column ``p`` bring
    each ref's own.
    """
    if p <= 0:
        raise ValueError("p must be positive")
    table = weight_table(values.sparkSession, weights)
    x = F.col("value").cast("double")
    own = "p" in table.columns
    if own:
        power, root_of = F.when(F.col("p") == 1, x).otherwise(F.pow(x, "p")), [F.max("p").alias("p")]
    else:
        power, root_of = (x if p == 1 else F.pow(x, F.lit(float(p)))), []
    term = F.col("weight").cast("double") * power
    # grouped by the whole shard, so that the sums are hash aggregates over values;
    # what is sorted by uid is one row per shard
    sums = values.join(table, _on(table)).groupBy("ref", "shard").agg(F.sum(term).alias("sum"), *root_of)
    by_uid = Window.partitionBy("ref", "shard.uid")
    sums = sums.select(
        "ref",
        "shard",
        *(["p"] if own else []),
        F.sum("sum").over(by_uid).alias("total"),
        F.row_number().over(by_uid.orderBy("shard")).alias("nth"),
    ).where("nth = 1")
    if own:
        root = F.when(F.col("p") == 1, F.col("total")).otherwise(F.pow("total", 1.0 / F.col("p")))
    else:
        root = F.col("total") if p == 1 else F.pow(F.col("total"), F.lit(1.0 / p))
    return sums.withColumn("norm", root).select(
        "ref",
        "shard",
        quantise(F.col("norm"), scale, rounding).alias("value"),
        plain_text(F.col("norm")).alias("display_value"),
    )
