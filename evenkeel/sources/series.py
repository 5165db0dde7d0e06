"""Series by id: labels stored once, an inverted listing of them, samples without labels.

A store holds three tables.  ``series`` has each label set once, under a ``sid`` of 16
bytes (the digest of metric and sorted labels).  ``listing`` is inverted: for every
metric a row (term, sid) for each label with its value, for each label as such, and for
the series itself.  ``samples`` has (metric, day, sid, ts, value).  Matchers are resolved on
the listing, before any sample is read, and samples cross the network with an id in
place of their labels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..stages import publish
from .samples import _utc_day, series_identity

#: The term that every series of a metric has.
ANY = "\u0001"


def term(label: Column, value: Column | None = None) -> Column:
    """The listing's key for a label's value, or for having the label."""
    end = F.lit("\u0001") if value is None else F.concat(F.lit("\u0001="), value)
    return F.concat(label, end)


def with_sid(samples: DataFrame) -> DataFrame:
    """Adds ``sid`` to samples with (metric, labels)."""
    sid = F.unhex(F.md5(F.to_json(F.struct("metric", series_identity().alias("l")))))
    # never null, and known not to be: else a join by sid works it out once more, to leave out nulls, before any other filter
    return samples.withColumn("sid", F.coalesce(sid, F.lit(b"")))


def listing_of(series: DataFrame) -> DataFrame:
    """(metric, term, sid) rows of a series table."""
    entries = series.select("metric", "sid", F.posexplode_outer("labels").alias("nth", "label", "value"))
    label = F.col("label")
    # the series itself goes with its first label; a label without a value has no term of its own
    own = F.when(F.coalesce("nth", F.lit(0)) == 0, F.lit(ANY))
    terms = F.array(own, term(label), term(label, F.col("value")))
    return entries.select("metric", F.explode(terms).alias("term"), "sid").where("term IS NOT NULL")


@dataclass(frozen=True)
class SeriesStore:
    series: DataFrame
    listing: DataFrame
    samples: DataFrame


def _distinct_series(samples: DataFrame) -> DataFrame:
    """(sid, metric, labels) of samples, each series once.

    The labels themselves are the key, so that a hash aggregate finds them: no samples are
    sorted, and an id is worked out for each series and not for each sample.
    """
    found = samples.groupBy("metric", "labels").agg(F.count(F.lit(1)).alias("samples"))
    return with_sid(found).select("sid", "metric", "labels")


def series_of(samples: DataFrame) -> SeriesStore:
    """The three tables as views on labelled samples, not stored."""
    series = _distinct_series(samples)
    return SeriesStore(series, listing_of(series), with_sid(samples).select("metric", "sid", "ts", "value"))


def append_series(samples: DataFrame, path: str) -> None:
    """Add samples to a store; series that it knows are not listed again.

    One writer at a time.  A batch that fails halfway and is written again may repeat
    samples, which readers take for one (see ``operators.fleet``), but no series.
    """
    spark = samples.sparkSession
    keyed = with_sid(samples).withColumn("day", _utc_day(F.col("ts")))
    keyed.select("metric", "day", "sid", "ts", "value").write.mode("append").partitionBy("metric", "day").parquet(f"{path}/samples")
    found = _distinct_series(samples)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/series")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        known = spark.read.schema(found.schema).parquet(f"{path}/series")
        found = found.join(known.select("sid"), "sid", "left_anti")
    # the listing goes first: a series that is known is listed
    marked = found.persist()
    try:
        listing_of(marked).write.mode("append").partitionBy("metric").parquet(f"{path}/listing")
        marked.write.mode("append").parquet(f"{path}/series")
    finally:
        marked.unpersist()


def open_series(spark: SparkSession, path: str) -> SeriesStore:
    """A store that ``append_series`` wrote."""
    return SeriesStore(*(spark.read.parquet(f"{path}/{name}") for name in ("series", "listing", "samples")))


def qualifying(listing: DataFrame, conditions: DataFrame) -> DataFrame:
    """(ref, metric_id, sid) of the series that meet all conditions of a metric: a relational division by counting.

    ``conditions`` has (ref, metric_id, metric, cond, negative, term).  The rows of one
    ``cond`` are alternatives: a positive one is met by having one of its terms, a negative
    one by having none.  Every metric has at least one positive condition.
    """
    rows = publish(conditions.select("ref", "metric_id", "metric", "cond", "negative", "term").distinct(), "conditions")
    wanted = rows.groupBy("ref", "metric_id").agg(F.count_distinct(F.when(~F.col("negative"), F.col("cond"))).alias("wanted"))
    # a series has one value for each label, so it has at most one term of a condition
    hits = listing.join(rows, ["metric", "term"])
    met = hits.groupBy("ref", "metric_id", "sid").agg(
        F.sum(F.when(F.col("negative"), 0).otherwise(1)).alias("met"), F.max(F.col("negative").cast("int")).alias("barred")
    )
    return met.join(wanted, ["ref", "metric_id"]).where("met = wanted AND barred = 0").select("ref", "metric_id", "sid")
