"""Schema contracts between stages and the fixed-point hand-over rule.

Every stage is a function from DataFrames to DataFrames.  A ``ref`` column names
the tenant or strategy a row belongs to, so one job serves many of them.
Arithmetic inside a stage is double; numbers handed to the next stage are
decimals of a fixed scale, so that later comparisons do not depend on the order
in which Spark added partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

SCALE = 9


def decimal_type(scale: int = SCALE) -> T.DecimalType:
    return T.DecimalType(38, scale)


SHARD_FIELDS = ("uid", "id", "namespace", "name", "server")

SHARD = T.StructType([T.StructField(f, T.StringType(), f != "uid") for f in SHARD_FIELDS])

SHARDS = T.StructType([T.StructField("ref", T.StringType())] + list(SHARD.fields))

SAMPLES = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ts", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
    ]
)

METRIC_VALUES = T.StructType(
    [
        T.StructField("ref", T.StringType()),
        T.StructField("metric_id", T.StringType()),
        T.StructField("shard", SHARD),
        T.StructField("query", T.StringType()),
        T.StructField("value", decimal_type()),
        T.StructField("display_value", T.StringType()),
    ]
)

WEIGHTS = T.StructType(
    [
        T.StructField("ref", T.StringType()),
        T.StructField("metric_id", T.StringType()),
        T.StructField("weight", decimal_type()),
    ]
)

LOAD_INDEXES = T.StructType(
    [
        T.StructField("ref", T.StringType()),
        T.StructField("shard", SHARD),
        T.StructField("value", decimal_type()),
        T.StructField("display_value", T.StringType()),
    ]
)

ASSIGNMENTS = T.StructType(
    [LOAD_INDEXES.fields[0], T.StructField("replica_id", T.IntegerType()), *LOAD_INDEXES.fields[1:]]
)

VIOLATIONS = T.StructType(
    [
        T.StructField("stage", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)


def quantise(value: Column, scale: int = SCALE, rounding: str = "nearest") -> Column:
    """Double to fixed decimal; NaN, infinities and overflow become NULL.

    ``nearest`` keeps results stable under a different summation order: three digits
    more are taken first, so that noise in the last bits cannot decide a tie.  ``up``
    rounds away from zero, as a decimal quantity type with nano precision does.
    """
    if rounding == "nearest":
        return value.cast("double").try_cast(decimal_type(scale + 3)).try_cast(decimal_type(scale))
    if rounding != "up":
        raise ValueError(f"unknown rounding: {rounding}")
    text = value.cast("double").cast("string")
    exact = text.try_cast(T.DecimalType(38, 18))
    up = F.ceil(F.abs(exact), F.lit(scale))
    return F.when(exact < 0, -up).otherwise(up).try_cast(decimal_type(scale))


def require_contract(df: DataFrame, contract: T.StructType, stage: str) -> DataFrame:
    """The frame itself, or an error naming the columns that break the stage's contract.

    Further columns are allowed, and decimals of any scale.
    """
    wrong = []
    for wanted in contract.fields:
        have = next((f for f in df.schema.fields if f.name == wanted.name), None)
        if have is None:
            wrong.append(f"{wanted.name} is missing")
        elif type(have.dataType) is not type(wanted.dataType):
            wrong.append(f"{wanted.name} is {have.dataType.simpleString()}")
    if wrong:
        raise ValueError(f"{stage}: " + ", ".join(wrong))
    return df


def shard_struct(prefix: str = "") -> Column:
    """Pack the five shard attributes into the struct every stage carries."""
    return F.struct(*[F.col(prefix + f).cast("string").alias(f) for f in SHARD_FIELDS]).alias("shard")
