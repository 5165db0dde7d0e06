"""Driver queries: every operator on the whole given tables.

Suppliers are shards measured by their line items; users and event types are shards
measured by events.  Computed numbers leave as decimal(18,6), times as epoch
seconds, so that a second engine can reproduce them digit by digit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import bind_override, match_labels, parse_quantity, plain_text, url_host
from ..operators import control, evaluate, load_index as li, normalize, observe, packing, plan, poll, timeseries as ts, validate
from ..schemas import SHARD_FIELDS, quantise, shard_struct
from ..sources import MetricDef, RelationStore, Strategy, discover_shards as discover, strategy_tables
from ..stages import publish, stage_path
from ..streaming import elect_stream, growth_stream
from .pipeline import Pipeline

SCALE = 6
WEIGHTS = {"rows": "0.2", "quantity": "0.3", "price": "0.5"}
EPSILON = 0.01

DAY = 86_400


@dataclass(frozen=True)
class Span:
    """Whole days that hold all events, and an instant at 19 thirtieths of them."""

    start: datetime
    end: datetime
    as_of: datetime


def _span(spark: SparkSession, sf: str) -> Span:
    ends = event_samples(spark, sf).agg(F.unix_micros(F.min("ts")).alias("low"), F.unix_micros(F.max("ts")).alias("high")).first()
    low, high = (ends["low"] or 0) // (DAY * 10**6), -(-(ends["high"] or 0) // (DAY * 10**6))
    start, days = datetime.fromtimestamp(low * DAY, timezone.utc), high - low
    return Span(start, start + timedelta(days=days), start + timedelta(days=days * 19 // 30))


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _out(column: Column | str, name: str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return quantise(column, SCALE).cast("decimal(18,6)").alias(name)


def _money_sum(column: str) -> Column:
    """Exact sum of a double that holds two decimals: hundredths add up as integers."""
    hundredths = F.sum(F.rint(F.col(column) * 100).cast("bigint"))
    return (hundredths.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast("decimal(38,6)")


def _exact(column: str, name: str) -> Column:
    return F.col(column).cast("decimal(18,6)").alias(name)


# ---- inputs -----------------------------------------------------------------


def supplier_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as shards; the region is the namespace, the nation names the server."""
    nation, region = _read(spark, sf, "nation"), _read(spark, sf, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "n_name", "r_name"
    )
    supplier = _read(spark, sf, "supplier")
    return supplier.join(places, supplier.s_nationkey == places.n_nationkey).select(
        F.lit("suppliers").alias("ref"),
        F.col("s_suppkey").cast("string").alias("uid"),
        F.col("s_name").alias("id"),
        F.col("r_name").alias("namespace"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example.com:6443")).alias("server"),
        "s_acctbal",
        "s_nationkey",
    )


def supplier_values(spark: SparkSession, sf: str) -> DataFrame:
    """Three metrics per supplier: one pass over the line items, then unpivoted."""
    measured = (
        _read(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").cast("string").alias("uid"))
        .agg(
            F.count(F.lit(1)).cast("decimal(38,6)").alias("rows"),
            _money_sum("l_quantity").alias("quantity"),
            _money_sum("l_extendedprice").alias("price"),
        )
    )
    shards = supplier_shards(spark, sf).select("ref", "uid", shard_struct())
    wide = measured.join(shards, "uid")
    long = wide.unpivot(["ref", "shard"], ["rows", "quantity", "price"], "metric_id", "value")
    return long.select(
        "ref",
        "metric_id",
        "shard",
        F.lit("").alias("query"),
        "value",
        plain_text(F.col("value")).alias("display_value"),
    )


def supplier_loads(spark: SparkSession, sf: str, p: int = 1) -> DataFrame:
    scaled = normalize.robust_scale(supplier_values(spark, sf), EPSILON, SCALE)
    return li.load_index(scaled, WEIGHTS, p, SCALE)


def part_loads(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as shards, loaded by the quantity of their line items."""
    loads = (
        _read(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").cast("string").alias("uid"))
        .agg(_money_sum("l_quantity").alias("value"))
    )
    none = F.lit(None).cast("string")
    shard = F.struct(*[F.col("uid") if f == "uid" else none.alias(f) for f in SHARD_FIELDS])
    return loads.select(
        F.lit("parts").alias("ref"), shard.alias("shard"), "value", plain_text(F.col("value")).alias("display_value")
    )


def event_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Events as samples.  The stored times carry no zone and are taken as UTC."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return _read(spark, sf, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("user_id"),
        "event_type",
        F.concat(F.lit("pod-"), (F.col("event_id") % 3).cast("string")).alias("pod"),
        F.timestamp_micros(micros).alias("ts"),
        "value",
        "props",
    )


def labelled_samples(spark: SparkSession, sf: str) -> DataFrame:
    """The same events in the labelled sample shape."""
    return event_samples(spark, sf).select(
        F.col("event_type").alias("metric"),
        F.create_map(
            F.lit("namespace"), F.lit("events"), F.lit("server"), "user_id", F.lit("pod"), "pod",
            F.lit("k"), F.get_json_object("props", "$.k"),
        ).alias("labels"),
        "ts",
        "value",
    )


def user_shards(spark: SparkSession, sf: str) -> DataFrame:
    users = _read(spark, sf, "events").select(F.col("user_id").cast("string").alias("uid")).distinct()
    return users.select(
        F.lit("users").alias("ref"),
        "uid",
        F.concat(F.lit("user-"), "uid").alias("id"),
        F.lit("events").alias("namespace"),
        F.concat(F.lit("user-"), "uid").alias("name"),
        F.col("uid").alias("server"),
    )


def six_hour_plans(spark: SparkSession, sf: str) -> DataFrame:
    """One plan per six hours: event types as shards, loaded by the sum of values.

    ``ref`` is the end of the window in epoch seconds.
    """
    window = 6 * 3600
    seconds = F.unix_seconds("ts")
    end = (F.floor(seconds / window).cast("bigint") + 1) * window
    none = F.lit(None).cast("string")
    shard = F.struct(*[F.col("event_type").alias("uid") if f == "uid" else none.alias(f) for f in SHARD_FIELDS])
    loads = (
        event_samples(spark, sf)
        .groupBy(end.cast("string").alias("ref"), "event_type")
        .agg(_money_sum("value").alias("value"))
        .select("ref", shard.alias("shard"), "value", plain_text(F.col("value")).alias("display_value"))
    )
    return publish(packing.lpt_pack(loads), "six-hour-plans")


def observations(plans: DataFrame) -> DataFrame:
    return plan.plan_identity(plans).select(
        F.lit("fleet").alias("ref"),
        F.timestamp_seconds(F.col("ref").cast("bigint")).alias("at"),
        "plan_hash",
        "replicas",
    )


PERIODS = evaluate.Periods(86_400, scale_up=86_400, scale_down=2 * 86_400)
USER_DAYS = 5
USER_PERIODS = evaluate.Periods(USER_DAYS * DAY, scale_up=USER_DAYS * DAY, scale_down=2 * USER_DAYS * DAY)


def user_plans(spark: SparkSession, sf: str, window: int = USER_DAYS * DAY) -> DataFrame:
    """One plan per user and window of so many seconds, as ``six_hour_plans`` has them for all: ``ref`` is user/end."""
    end = (F.floor(F.unix_seconds("ts") / window).cast("bigint") + 1) * window
    none = F.lit(None).cast("string")
    shard = F.struct(*[F.col("event_type").alias("uid") if f == "uid" else none.alias(f) for f in SHARD_FIELDS])
    loads = (
        event_samples(spark, sf)
        .groupBy(F.concat_ws("/", "user_id", end.cast("string")).alias("ref"), "event_type")
        .agg(_money_sum("value").alias("value"))
        .select("ref", shard.alias("shard"), "value", plain_text(F.col("value")).alias("display_value"))
    )
    return publish(packing.lpt_pack(loads), "user-plans")


def _observed_at(rows: DataFrame) -> DataFrame:
    """``ref`` is the user, ``at`` the end of the window."""
    at = F.timestamp_seconds(F.substring_index("ref", "/", -1).cast("bigint"))
    return rows.withColumns({"at": at, "ref": F.substring_index("ref", "/", 1)})


def user_observations(plans: DataFrame) -> DataFrame:
    return _observed_at(plan.plan_identity(plans)).select("ref", "at", "plan_hash", "replicas")


def _elections(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The last election of every user, and the assignments of every observation."""
    plans = user_plans(spark, sf)
    elected = evaluate.latest_election(evaluate.replay(user_observations(plans), USER_PERIODS))
    return publish(elected, "elected"), _observed_at(plans)


# ---- scans and ingest ---------------------------------------------------------


def discover_shards(spark, sf):
    shards = supplier_shards(spark, sf)
    kind = F.when(F.col("s_acctbal") >= 0, F.lit("cluster")).otherwise(F.lit("retired"))
    registry = shards.select(
        "ref",
        "uid",
        F.col("id").alias("object_name"),
        "namespace",
        F.create_map(F.lit("secret-type"), kind, F.lit("region"), "namespace").alias("labels"),
        F.create_map(F.lit("name"), "name", F.lit("server"), "server").alias("data"),
    )
    return discover(registry, {"secret-type": "cluster"}, exists=["region"], absent=["paused"])


def scan_samples(spark, sf):
    matched = labelled_samples(spark, sf).where(
        (F.col("metric") == "purchase")
        & match_labels(F.col("labels"), not_equals={"pod": "pod-1"}, without={"k": ["0", "1", "2"]})
    )
    return matched.select(
        F.col("labels")["server"].alias("user_id"), F.unix_micros("ts").alias("at_us"), _out("value", "value")
    )


def bind_labels(spark, sf):
    host = url_host(F.col("url"))
    return _read(spark, sf, "pages").select(
        "page_id",
        host.alias("host"),
        bind_override(host, {"www.example.com": "100.64.0.1:443"}).alias("bound"),
    )


def ingest_quantities(spark, sf):
    suffix = F.element_at(
        F.array(*[F.lit(s) for s in ("n", "u", "m", "", "k", "Ki", "e2")]), F.col("l_linenumber").cast("int")
    )
    text = F.concat(F.col("l_quantity").cast("int").cast("string"), suffix)
    return _read(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        text.alias("text"),
        parse_quantity(text).alias("quantity"),
        plain_text(F.col("l_extendedprice") * F.lit(1000)).alias("display"),
    )


# ---- time series --------------------------------------------------------------


def _grid(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.unix_seconds("grid_ts").alias("at"), _out("value", "value"))


def instant_vector(spark, sf):
    span = _span(spark, sf)
    vector = ts.instant_vector(
        event_samples(spark, sf), ["user_id", "event_type"], span.start, span.end, 6 * 3600, 12 * 3600
    )
    return _grid(vector, "user_id", "event_type")


def _pod_peaks(spark, sf):
    span = _span(spark, sf)
    series = ts.instant_vector(
        event_samples(spark, sf), ["event_type", "user_id", "pod"], span.start, span.end, 6 * 3600, 24 * 3600
    )
    return ts.max_over_series(ts.sum_by(series, ["event_type", "pod"]), ["event_type"])


def sum_by_pod_max(spark, sf):
    return _grid(_pod_peaks(spark, sf), "event_type")


def quantile_over_time(spark, sf):
    return ts.quantile_over_time(_pod_peaks(spark, sf), ["event_type"], 0.95).select(
        "event_type", _out("value", "value")
    )


def quantile_over_time_by_user(spark, sf):
    span = _span(spark, sf)
    vector = ts.instant_vector(
        event_samples(spark, sf), ["user_id", "event_type", "pod"], span.start, span.end, 6 * 3600, 24 * 3600
    )
    peaks = ts.max_over_series(vector, ["user_id", "event_type"])
    return ts.quantile_over_time(peaks, ["user_id", "event_type"], 0.95).select(
        "user_id", "event_type", _out("value", "value")
    )


def max_over_time(spark, sf):
    return ts.max_over_time(_pod_peaks(spark, sf), ["event_type"]).select("event_type", _out("value", "value"))


def _increase(spark, sf, **options):
    span = _span(spark, sf)
    return ts.increase(
        event_samples(spark, sf), ["user_id"], span.start, span.end, step_seconds=12 * 3600, range_seconds=24 * 3600, **options
    )


def increase(spark, sf):
    return _grid(_increase(spark, sf), "user_id")


def increase_extrapolated(spark, sf):
    return _grid(_increase(spark, sf, extrapolate=True), "user_id")


def rate_percent(spark, sf):
    span = _span(spark, sf)
    rates = ts.rate(event_samples(spark, sf), ["user_id"], span.start, span.end, step_seconds=12 * 3600, range_seconds=24 * 3600)
    return _grid(ts.scale(rates, 100.0), "user_id")


def increase_stream(spark, sf):
    """Counter growth as a stream that sees the events in four stretches of time.

    Grid points come out once the watermark, an hour behind the last event, has passed them.
    """
    span, events = _span(spark, sf), event_samples(spark, sf).select("user_id", "ts", "value")
    stored, out, marks = (stage_path(spark, name) for name in ("growth-in", "growth-out", "growth-checkpoint"))
    quarter = (span.end - span.start) / 4
    for n in range(4):
        low, high = (ts.instant_literal(span.start + quarter * k) for k in (n, n + 1))
        events.where((F.col("ts") >= low) & (F.col("ts") < high)).write.mode("append").parquet(stored)
        stream = growth_stream(spark.readStream.schema(events.schema).parquet(stored), ["user_id"], 12 * 3600, 24 * 3600, "1 hour")
        query = (
            stream.writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", marks)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return _grid(spark.read.schema(stream.schema).parquet(out), "user_id")


BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]


def histogram_quantile(spark, sf):
    """0.9 quantile per user and type from cumulative bucket counts."""
    names = [f"b{i}" for i in range(len(BOUNDS))] + ["binf"]
    tests = [F.col("value") <= F.lit(b) for b in BOUNDS] + [F.lit(True)]
    counted = event_samples(spark, sf).groupBy("event_type", "user_id").agg(
        *[F.sum(t.cast("double")).alias(n) for t, n in zip(tests, names)]
    )
    buckets = counted.unpivot(["event_type", "user_id"], names, "bucket", "value").withColumn(
        "le",
        F.element_at(
            F.create_map(*[F.lit(x) for pair in zip(names, BOUNDS + [float("inf")]) for x in pair]), F.col("bucket")
        ),
    )
    return ts.histogram_quantile(buckets, ["event_type", "user_id"], 0.9).select(
        "event_type", "user_id", _out("value", "value")
    )


# ---- poll ---------------------------------------------------------------------

EVENT_TYPES = ("click", "view", "purchase", "signup", "error")
EVENT_METRICS = tuple(
    MetricDef(t, 'last(%s{user="{{ .uid }}"})' % t, no_data="0", bind=lambda: F.col("uid")) for t in EVENT_TYPES
)


def poll_cross_fill(spark, sf):
    vectors = ts.instant(event_samples(spark, sf), ["user_id", "event_type"], _span(spark, sf).as_of, 2 * 86_400).select(
        F.col("event_type").alias("metric_id"), F.col("user_id").alias("bound"), "value"
    )
    polled = poll.poll(user_shards(spark, sf), EVENT_METRICS, vectors, SCALE)
    return polled.select(
        "metric_id", F.col("shard.uid").alias("uid"), "query", _exact("value", "value"), "samples"
    )


def _pod_poll(spark, sf):
    vectors = ts.instant(event_samples(spark, sf), ["user_id", "event_type", "pod"], _span(spark, sf).as_of, 4 * 86_400).select(
        F.col("event_type").alias("metric_id"), F.col("user_id").alias("bound"), "value"
    )
    shards = user_shards(spark, sf).withColumn("ref", F.col("id"))
    return poll.poll(shards, EVENT_METRICS, vectors, SCALE)


def require_single_sample(spark, sf):
    return validate.poll_violations(_pod_poll(spark, sf)).select("stage", "ref", "reason", "message")


def stale_refs(spark, sf):
    """Users as refs and event types as shards: what was polled before, what is there now."""
    events = event_samples(spark, sf).select("ts", F.col("user_id").alias("ref"), F.col("event_type").alias("uid"))
    edge = ts.instant_literal(_span(spark, sf).as_of)
    before, now = events.where(F.col("ts") < edge), events.where(F.col("ts") >= edge)
    refs = events.groupBy("ref").agg(
        F.max(F.when(F.col("ts") < edge, F.col("ts"))).alias("last_poll")
    )
    previous = before.select("ref", "uid", F.lit("value").alias("metric_id"))
    return poll.stale_refs(
        refs.select("ref", F.lit(43_200).alias("period_s"), "last_poll"),
        now.select("ref", "uid"),
        refs.select("ref", F.lit("value").alias("metric_id")),
        previous,
        edge,
    ).select("ref", "stale", "reason", _out("remaining_s", "remaining_s"))


def set_equality(spark, sf):
    """Per user: whether the same event types occur before and after the middle of the time."""
    events = event_samples(spark, sf).select("ts", F.col("user_id").alias("ref"), "event_type")
    edge = ts.instant_literal(_span(spark, sf).as_of)
    return poll.same_sets(events.where(F.col("ts") < edge), events.where(F.col("ts") >= edge), "event_type")


# ---- normalise, index -----------------------------------------------------------


def _stats(stats: DataFrame) -> DataFrame:
    return stats.select(
        "ref", "metric_id", "n", *[_out(c, c) for c in ("q1", "median", "q3", "iqr")]
    )


def quartiles(spark, sf):
    return _stats(normalize.quartile_stats(publish(supplier_values(spark, sf))))


def quartiles_bracketed(spark, sf):
    """Price quartiles of all line items per flag and status, through brackets."""
    prices = _read(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("ref"), F.col("l_returnflag").alias("metric_id"), F.col("l_extendedprice").alias("value")
    )
    return _stats(normalize.quartile_stats(prices, whole_rows=1000, accuracy=1000))


def quartiles_refined(spark, sf):
    """The same with lists so short that ranks are narrowed by counts of ranges first."""
    prices = _read(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("ref"), F.col("l_returnflag").alias("metric_id"), F.col("l_extendedprice").alias("value")
    )
    return _stats(normalize.quartile_stats(prices, whole_rows=100, accuracy=50, list_rows=40))


def _scaled(df: DataFrame) -> DataFrame:
    return df.select("ref", "metric_id", F.col("shard.uid").alias("uid"), _exact("value", "value"))


def robust_scale(spark, sf):
    return _scaled(normalize.robust_scale(supplier_values(spark, sf), None, SCALE))


def robust_scale_offset(spark, sf):
    return _scaled(normalize.robust_scale(supplier_values(spark, sf), EPSILON, SCALE))


def _load_index(p: int):
    def query(spark, sf):
        return supplier_loads(spark, sf, p).select(
            "ref", F.col("shard.uid").alias("uid"), F.col("shard.name").alias("name"), _exact("value", "value")
        )

    return query


def not_finite(spark, sf):
    """Without the offset a cubic norm may have no real root: those shards fail their ref."""
    scaled = normalize.robust_scale(supplier_values(spark, sf), None, SCALE)
    broken = validate.not_finite(li.load_index(scaled, WEIGHTS, 3, SCALE), "load_index", validate.LOAD_INDEX_ERROR)
    return broken.groupBy("stage", "ref", "reason", "message").agg(F.count(F.lit(1)).alias("shards"))


def metric_exactly_once(spark, sf):
    """Weighted metrics missing from, or repeated in, a user's day of events."""
    values = event_samples(spark, sf).select(
        F.date_from_unix_date(F.floor(F.unix_seconds("ts") / 86_400).cast("int")).cast("string").alias("ref"),
        F.col("event_type").alias("metric_id"),
        F.struct(F.col("user_id").alias("uid")).alias("shard"),
    )
    return validate.metric_exactly_once(values, {"click": "1", "view": "1"})


# ---- packing --------------------------------------------------------------------


def _placed(assignments: DataFrame) -> DataFrame:
    return assignments.select("ref", F.col("shard.uid").alias("uid"), "replica_id", _exact("value", "value"))


def lpt_assignments(spark, sf):
    return _placed(packing.lpt_pack(supplier_loads(spark, sf)))


def lpt_replicas(spark, sf):
    return packing.replica_totals(packing.lpt_pack(supplier_loads(spark, sf))).select(
        "ref", "replica_id", "shards", _exact("total_load", "total_load")
    )


def flagship(spark, sf):
    """Line items to replicas: measure, scale, index, pack; one row per supplier."""
    return packing.lpt_pack(supplier_loads(spark, sf)).select(
        "ref",
        "replica_id",
        *[F.col(f"shard.{f}").alias(f) for f in SHARD_FIELDS],
        _exact("value", "value"),
    )


def _nested(plans: DataFrame) -> DataFrame:
    return plans.select(
        "ref",
        "replica_id",
        "part",
        F.size("load_indexes").alias("shards"),
        F.array_join(F.transform("load_indexes", lambda e: e["shard"]["uid"]), ",").alias("shard_uids"),
        _exact("total_load", "total_load"),
        "total_load_display",
    )


def nested_replicas(spark, sf):
    """Each replica with its parts listed, largest first."""
    return _nested(packing.replicas(packing.lpt_pack(part_loads(spark, sf))))


def nested_replicas_in_parts(spark, sf):
    """The same where a row lists one part at most."""
    return _nested(packing.replicas(packing.lpt_pack(part_loads(spark, sf)), max_list=1))


def lpt_capped(spark, sf):
    return _placed(packing.lpt_pack(part_loads(spark, sf), max_shards_per_replica=1))


def lpt_parts(spark, sf):
    return _placed(packing.lpt_pack(part_loads(spark, sf)))


def lpt_equal_loads(spark, sf):
    """Parts loaded by their size: long runs of equal loads, a third of them idle."""
    size = F.when(F.col("p_partkey") % 3 == 0, 0).otherwise(F.col("p_size")).cast("decimal(38,6)")
    loads = _read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("uid"), size.alias("value"))
    none = F.lit(None).cast("string")
    shard = F.struct(*[F.col("uid") if f == "uid" else none.alias(f) for f in SHARD_FIELDS])
    loads = loads.select(F.lit("sizes").alias("ref"), shard.alias("shard"), "value", plain_text(F.col("value")).alias("display_value"))
    return _placed(packing.lpt_pack(loads))


def lpt_parts_sliced(spark, sf):
    """The same plan by the way taken for a ref too big for one task."""
    return _placed(packing.lpt_pack(part_loads(spark, sf), max_group_rows=700))


def _pinned_loads(spark, sf):
    loads = supplier_loads(spark, sf)
    renamed = F.when(F.col("shard.uid") == "7", F.lit("in-cluster")).otherwise(F.col("shard.name"))
    return loads.withColumn("shard", F.col("shard").withField("name", renamed))


def lpt_pinned(spark, sf):
    return _placed(packing.lpt_pack(_pinned_loads(spark, sf)))


def nation_loads(spark, sf):
    """Customers as shards, loaded by their orders; a nation is a ref."""
    orders = _read(spark, sf, "orders").groupBy("o_custkey").agg(
        _money_sum("o_totalprice").alias("value")
    )
    customers = _read(spark, sf, "customer")
    nation = _read(spark, sf, "nation")
    return (
        customers.join(orders, customers.c_custkey == orders.o_custkey)
        .join(nation, customers.c_nationkey == nation.n_nationkey)
        .select(
            F.col("n_name").alias("ref"),
            F.struct(
                F.col("c_custkey").cast("string").alias("uid"),
                F.col("c_name").alias("id"),
                F.col("n_name").alias("namespace"),
                F.col("c_name").alias("name"),
                F.lit(None).cast("string").alias("server"),
            ).alias("shard"),
            "value",
            plain_text(F.col("value")).alias("display_value"),
        )
    )


def lpt_by_nation(spark, sf):
    """One plan per nation, two customers per replica at most."""
    return _placed(packing.lpt_pack(nation_loads(spark, sf), max_shards_per_replica=2))


def bucket_sizes(spark, sf):
    loads = publish(supplier_loads(spark, sf))
    counts = packing.replica_count(packing.lpt_pack(loads))
    return packing.bucket_size(loads).join(counts, "ref").select("ref", _exact("bucket", "bucket"), "replicas")


def plan_quality(spark, sf):
    return packing.plan_quality(packing.lpt_pack(part_loads(spark, sf)), SCALE).select(
        "ref", "replicas", *[_exact(c, c) for c in ("makespan", "spread", "fill")]
    )


# ---- plans ----------------------------------------------------------------------


def plan_key_hash(spark, sf):
    return plan.plan_keys(packing.lpt_pack(supplier_loads(spark, sf)))


def plan_hash_streamed(spark, sf):
    """The same hash by the way taken for a plan whose key does not fit a row."""
    return plan.plan_identity(packing.lpt_pack(part_loads(spark, sf)), max_pairs=100).select(
        "ref", "plan_hash", "replicas", "shards"
    )


def _two_plans(spark, sf):
    """Plans by two norms of the same scaled values, packed together as two refs."""
    scaled = publish(normalize.robust_scale(supplier_values(spark, sf), EPSILON, SCALE))

    def named(p: int) -> DataFrame:
        return li.load_index(scaled, WEIGHTS, p, SCALE).withColumn("ref", F.concat("ref", F.lit(f"/{p}")))

    packed = publish(packing.lpt_pack(named(1).unionByName(named(2))))
    ref = F.regexp_replace("ref", "/[12]$", "")
    return tuple(packed.where(F.col("ref").endswith(f"/{p}")).withColumn("ref", ref) for p in (1, 2))


def plan_diff(spark, sf):
    return plan.plan_diff(*_two_plans(spark, sf))


def plan_delta(spark, sf):
    return plan.plan_delta(plan.plan_diff(*_two_plans(spark, sf), changes_only=False))


def plan_equal(spark, sf):
    """Are the plans of consecutive six-hour windows the same?"""
    plans = six_hour_plans(spark, sf)
    later = plans.withColumn("ref", (F.col("ref").cast("bigint") + 6 * 3600).cast("string"))
    return plan.plan_equal(later, plans)


# ---- evaluation -----------------------------------------------------------------


def evaluation_replay(spark, sf):
    """An election for each user, from a plan every six hours; the periods hold several of them."""
    return _elections_shown(evaluate.replay(user_observations(user_plans(spark, sf, 6 * 3600)), PERIODS))


def _elections_shown(out: DataFrame) -> DataFrame:
    return out.select(
        "ref",
        F.unix_seconds("at").alias("at"),
        "plan_hash",
        "winner",
        "projection",
        "projection_size",
        "elected",
        "elected_size",
        "promoted",
        "reason",
        F.unix_seconds("last_evaluation").alias("last_evaluation"),
        "votes",
    )


def evaluation_stream(spark, sf):
    """The election of a plan for every five days, as a stream over stored observations, run until it is through.

    The observations come in files of one window, one after another, and a batch takes one.
    """
    stored = stage_path(spark, "observation-stream")
    watched = publish(user_observations(user_plans(spark, sf)), "watched")
    for row in watched.select("at").distinct().orderBy("at").collect():  # one for each five days
        watched.where(F.col("at") == F.lit(row["at"])).coalesce(1).write.mode("append").parquet(stored)
    stream = spark.readStream.schema(watched.schema).option("maxFilesPerTrigger", 1).parquet(stored)
    out = stage_path(spark, "elections")
    query = (
        elect_stream(stream, USER_PERIODS)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", stage_path(spark, "election-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return _elections_shown(spark.read.schema(evaluate.OUTPUT).parquet(out))


def vote_counts(spark, sf):
    votes = evaluate.vote_counts(observations(six_hour_plans(spark, sf)), 2 * 86_400, 6 * 3600)
    return votes.select("ref", "plan_hash", F.unix_seconds("at").alias("at"), "votes")


# ---- relations, status, decisions -----------------------------------------------


def _shown(relation: DataFrame) -> DataFrame:
    keep = [c for c in relation.columns if c != "value"]
    return relation.select(*keep, _out("value", "value"))


def relation_discovered_shards(spark, sf):
    assignments = packing.lpt_pack(supplier_loads(spark, sf))
    return _shown(observe.discovered_shards(supplier_shards(spark, sf), assignments))


def relation_poll_values(spark, sf):
    return _shown(observe.poll_values(supplier_values(spark, sf)))


def relation_normalizer_values(spark, sf):
    return _shown(observe.normalizer_values(normalize.robust_scale(supplier_values(spark, sf), EPSILON, SCALE)))


def relation_load_index_values(spark, sf):
    return _shown(observe.load_index_values(supplier_loads(spark, sf)))


def relation_partition_shards(spark, sf):
    return _shown(observe.partition_shards(packing.lpt_pack(supplier_loads(spark, sf))))


def relation_partition_total_load(spark, sf):
    return _shown(observe.partition_replicas_total_load(packing.lpt_pack(supplier_loads(spark, sf))))


def _evaluation_relation(build: Callable[[DataFrame], DataFrame], which: str):
    def query(spark, sf):
        elected, plans = _elections(spark, sf)
        relation = build(evaluate.elected_assignments(elected, plans, which))
        keep = [c for c in relation.columns if c not in ("shard_id", "shard_namespace", "shard_name", "shard_server")]
        return _shown(relation.select(*keep))

    return query


def gauge_rollup(spark, sf):
    """Dashboard sums of the poll values and the partition's total load."""
    measured = publish(supplier_values(spark, sf))
    values = observe.rollup(observe.poll_values(measured), "poll_values")
    indexes = li.load_index(normalize.robust_scale(measured, EPSILON, SCALE), WEIGHTS, 1, SCALE)
    loads = observe.partition_replicas_total_load(packing.lpt_pack(indexes))
    totals = observe.rollup(loads, "partition_replicas_total_load")
    both = values.select(
        "type", "ref", F.concat_ws("/", "shard_name", "metric_id").alias("label"), "value"
    ).unionByName(totals.select("type", "ref", F.col("replica_id").cast("string").alias("label"), "value"))
    return _shown(both)


def stage_status(spark, sf):
    polled = publish(_pod_poll(spark, sf), "polled")
    return validate.stage_status(polled, validate.poll_violations(polled), "poll")


def ready_values(spark, sf):
    """Values of refs that broke no rule, and a status row for the next stage of the others."""
    polled = publish(_pod_poll(spark, sf), "polled")
    status = validate.stage_status(polled, validate.poll_violations(polled), "poll")
    ready = validate.require_ready(polled, status).select(
        "ref", F.col("metric_id").alias("what"), _exact("value", "value")
    )
    waiting = validate.not_ready(polled, status, "normalize").select(
        "ref", F.col("reason").alias("what"), F.lit(None).cast("decimal(18,6)").alias("value")
    )
    return ready.unionByName(waiting)


def duplicate_ids(spark, sf):
    """Part sizes as ids defined per brand: an id listed twice is malformed."""
    ids = _read(spark, sf, "part").select(
        F.col("p_brand").alias("ref"), F.col("p_size").cast("string").alias("metric_id")
    )
    return validate.duplicate_ids(ids, "load_index", validate.MALFORMED_WEIGHTS)


def rollout_snapshot(spark, sf):
    """Every order as the snapshot of one scaler: its columns spread over all states."""
    price = F.floor(F.col("o_totalprice")).cast("bigint")
    day = F.dayofmonth("o_orderdate")
    return _read(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("ref"),
        (F.col("o_orderpriority") != "1-URGENT").alias("mode_default"),
        F.col("o_orderpriority").isin("1-URGENT", "5-LOW").alias("mode_x0y"),
        (F.col("o_orderstatus") == "F").alias("rollout_restart"),
        (day == 31).alias("paused"),
        (day != 30).alias("provider_ready"),
        (day != 29).alias("manager_ready"),
        F.lit("plan-0").alias("plan_key"),
        F.concat(F.lit("plan-"), (price % 2).cast("string")).alias("manager_spec_key"),
        F.concat(F.lit("plan-"), F.when(price % 7 == 0, 1).otherwise(0).cast("string")).alias("manager_status_key"),
        F.concat(F.lit("plan-"), F.when(price % 5 == 0, 1).otherwise(0).cast("string")).alias("scaler_status_key"),
        (price % 3).cast("int").alias("desired_replicas"),
        F.when(price % 11 != 0, (F.floor(price / 3) % 3).cast("int")).alias("spec_replicas"),
        (F.floor(price / 9) % 3).cast("int").alias("actual_replicas"),
    )


def rollout_state(spark, sf):
    return control.rollout_state(rollout_snapshot(spark, sf)).select("ref", "state", "hand_over", "scale_now")


def scaler_snapshots(spark, sf):
    """The orders of a customer as snapshots of one scaler, one after another."""
    orders = _read(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("ref"),
        F.col("o_custkey").cast("string").alias("target"),
        F.timestamp_micros(F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint") * DAY * 10**6 + F.col("o_orderkey")).alias("at"),
    )
    return rollout_snapshot(spark, sf).join(orders, "ref")


def transition_log(spark, sf):
    log = control.transition_log(scaler_snapshots(spark, sf), ["target"], 365 * DAY * 10**6)
    return log.select("target", F.unix_micros("at").alias("at_us"), "kind", "from_replicas", "to_replicas", "counted")


def relation_scaler_changes(spark, sf):
    """Restarts, enforcements and new sizes by target; the way through zero is none of its own."""
    log = control.transition_log(scaler_snapshots(spark, sf), ["target"], 365 * DAY * 10**6).where("counted")
    changes = log.select(F.lit("fleet").alias("ref"), F.lit("StatefulSet").alias("target_kind"), "target")
    return _shown(observe.rollup(observe.replica_set_changes(changes), "scaler_replica_set_changes_total"))


def desired_replicas(spark, sf):
    """Wanted scale of every nation's plan; a nation without customers has an empty plan, of size 0."""
    nations = _read(spark, sf, "nation").select(F.col("n_name").alias("ref"))
    busy = _read(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("ref"))
    loads = nation_loads(spark, sf).join(busy, "ref", "left_semi")
    sizes = plan.plan_identity(packing.lpt_pack(loads, max_shards_per_replica=2))
    return control.desired_replicas(nations.join(sizes, "ref", "left"))


def normalized_display(spark, sf):
    """The text beside a scaled value is that of the value before the offset."""
    scaled = normalize.robust_scale(supplier_values(spark, sf), EPSILON, SCALE)
    return scaled.select("ref", "metric_id", F.col("shard.uid").alias("uid"), _out(F.col("display_value").cast("double"), "display"), _exact("value", "value"))


def relation_store(spark, sf):
    """Sums by user and type: of the first half of the time, replaced for the users of the second half.

    A user without purchases there is cleared of all rows; a version without a commit shows nothing.
    """
    span, events = _span(spark, sf), event_samples(spark, sf)
    middle = ts.instant_literal(span.start + (span.end - span.start) / 2)
    store = RelationStore(spark, stage_path(spark, "relation-store"), "ref string, label string, value decimal(38,6)")

    def sums(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("user_id").alias("ref"), F.col("event_type").alias("label")).agg(_money_sum("value").alias("value"))

    early, late = events.where(F.col("ts") < middle), events.where(F.col("ts") >= middle)
    buyers = late.where("event_type = 'purchase'").select(F.col("user_id").alias("ref")).distinct()
    store.put(0, sums(early))
    store.put(1, sums(late).join(buyers, "ref", "left_semi"), refs=late.select(F.col("user_id").alias("ref")))
    sums(events).write.parquet(f"{store.path}/rows/version=4")  # fails before its commit
    store.compact()
    return store.read().select("ref", "label", _exact("value", "value"))


def all_rollups(spark, sf):
    """The dashboard sums of the eight relations that ``gauge_rollup`` and the change counters leave."""
    values = publish(supplier_values(spark, sf))
    scaled = publish(normalize.robust_scale(values, EPSILON, SCALE))
    indexes = li.load_index(scaled, WEIGHTS, 1, SCALE)
    plans = publish(packing.lpt_pack(indexes))
    elected, observed = _elections(spark, sf)
    relations = {
        "shard_manager_discovered_shards": observe.discovered_shards(supplier_shards(spark, sf), plans),
        "normalizer_values": observe.normalizer_values(scaled),
        "load_index_values": observe.load_index_values(publish(indexes)),
        "partition_shards": observe.partition_shards(plans),
    }
    for which, shards, total in (
        ("projection", observe.evaluation_projected_shards, observe.evaluation_projected_replicas_total_load),
        ("elected", observe.evaluation_shards, observe.evaluation_replicas_total_load),
    ):
        rows = publish(evaluate.elected_assignments(elected, observed, which))
        prefix = "evaluation_projected" if which == "projection" else "evaluation"
        relations |= {f"{prefix}_shards": shards(rows), f"{prefix}_replicas_total_load": total(rows)}
    out = None
    for name, relation in relations.items():
        labels = observe.ROLLUP_LABELS[name][2:]
        label = F.concat_ws("/", *labels) if labels else F.lit("")
        part = observe.rollup(relation, name).select(F.lit(name).alias("relation"), "type", "ref", label.alias("label"), "value")
        out = part if out is None else out.unionByName(part)
    return _shown(out)


def _replica_changes(spark, sf):
    counts = event_samples(spark, sf).select(
        F.col("user_id").alias("target"), F.col("ts").alias("at"), F.floor(F.col("value") / 40).cast("int").alias("replicas")
    )
    return control.change_log(counts, ["target"])


def change_log(spark, sf):
    return _replica_changes(spark, sf).select(
        "target", F.unix_micros("at").alias("at_us"), "from_replicas", "to_replicas"
    )


def relation_replica_set_changes(spark, sf):
    changes = _replica_changes(spark, sf).select(
        F.lit("fleet").alias("ref"), F.lit("StatefulSet").alias("target_kind"), "target"
    )
    return _shown(observe.rollup(observe.replica_set_changes(changes), "scaler_replica_set_changes_total"))


# ---- whole strategy ---------------------------------------------------------------

EVENT_STRATEGY = Strategy(
    metrics=(
        MetricDef("views", 'view{user="{{ .server }}"}', no_data="0", sample="view"),
        MetricDef("errors", 'error{user="{{ .server }}"}', no_data="0", sample="error"),
        MetricDef("spent", 'increase(purchase{user="{{ .server }}"})', no_data="0", kind="counter", sample="purchase"),
    ),
    weights={"views": "0.5", "errors": "0.25", "spent": "0.25"},
    window_seconds=10 * 86_400,
    step_seconds=6 * 3600,
    range_seconds=5 * 86_400,
    lookback_seconds=2 * 86_400,
)


def strategy_run(spark, sf):
    """A whole run on event samples: poll, scale, index, pack."""
    run = Pipeline(EVENT_STRATEGY).run(user_shards(spark, sf), labelled_samples(spark, sf), _span(spark, sf).as_of)
    return _placed(run.assignments)


FLEET = {
    "plain": EVENT_STRATEGY,
    "pods": replace(
        EVENT_STRATEGY,
        metrics=tuple(replace(m, not_equals={"pod": "pod-1"}, within={"k": [str(k) for k in range(50)]}) for m in EVENT_STRATEGY.metrics),
        p=2, epsilon=0.05, quantile=0.5, step_seconds=12 * 3600, window_seconds=6 * DAY, lookback_seconds=DAY, range_seconds=3 * DAY,
    ),
    "twice": EVENT_STRATEGY,
    "fresh": replace(EVENT_STRATEGY, period_seconds=10 * DAY),
}


def _fleet_run(spark, sf):
    """Four strategies over the same samples: one lists a metric twice, one is not due and keeps what it had."""
    as_of = _span(spark, sf).as_of
    users = user_shards(spark, sf).drop("ref")
    shards = publish(users.select(F.explode(F.array(*[F.lit(r) for r in FLEET])).alias("ref"), "*"), "fleet-shards")
    tables = strategy_tables(spark, FLEET)
    again = tables.metrics.where("ref = 'twice' AND metric_id = 'views'")
    tables = replace(tables, metrics=tables.metrics.unionByName(again))
    before = publish(shards.where("ref = 'fresh'").select("ref", shard_struct()), "fleet-before")
    counts = event_samples(spark, sf).groupBy(F.col("user_id").alias("uid")).agg(F.count(F.lit(1)).alias("n"))
    ids = F.array(*[F.lit(m.id) for m in EVENT_STRATEGY.metrics])
    previous = before.join(counts, F.col("shard.uid") == F.col("uid")).select(
        "ref", F.explode(ids).alias("metric_id"), "shard", F.lit("").alias("query"),
        F.col("n").cast("decimal(38,9)").alias("value"), F.lit("").alias("display_value"),
    )
    polls = spark.createDataFrame([("fresh", as_of - timedelta(days=1))], "ref string, last_poll timestamp")
    return Pipeline(tables).run(shards, labelled_samples(spark, sf), as_of, polls, publish(previous, "fleet-previous"))


def fleet_values(spark, sf):
    return _fleet_run(spark, sf).metric_values.select(
        "ref", "metric_id", F.col("shard.uid").alias("uid"), _exact("value", "value")
    )


def fleet_status(spark, sf):
    """One row a stage and ref, and the gate's verdict on each ref."""
    run = _fleet_run(spark, sf)
    gate = run.gate.select(F.lit("gate").alias("stage"), "ref", F.col("stale").alias("ready"), "reason", F.lit("").alias("message"))
    return run.status.unionByName(gate)


def fleet_assignments(spark, sf):
    return _placed(_fleet_run(spark, sf).assignments)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "flagship": flagship,
    "discover_shards": discover_shards,
    "scan_samples": scan_samples,
    "bind_labels": bind_labels,
    "ingest_quantities": ingest_quantities,
    "instant_vector": instant_vector,
    "sum_by_pod_max": sum_by_pod_max,
    "quantile_over_time": quantile_over_time,
    "quantile_over_time_by_user": quantile_over_time_by_user,
    "max_over_time": max_over_time,
    "increase": increase,
    "increase_extrapolated": increase_extrapolated,
    "rate_percent": rate_percent,
    "increase_stream": increase_stream,
    "histogram_quantile": histogram_quantile,
    "poll_cross_fill": poll_cross_fill,
    "require_single_sample": require_single_sample,
    "stale_refs": stale_refs,
    "set_equality": set_equality,
    "quartiles": quartiles,
    "quartiles_bracketed": quartiles_bracketed,
    "quartiles_refined": quartiles_refined,
    "robust_scale": robust_scale,
    "robust_scale_offset": robust_scale_offset,
    "load_index_p1": _load_index(1),
    "load_index_p2": _load_index(2),
    "load_index_p3": _load_index(3),
    "not_finite": not_finite,
    "metric_exactly_once": metric_exactly_once,
    "lpt_assignments": lpt_assignments,
    "lpt_replicas": lpt_replicas,
    "nested_replicas": nested_replicas,
    "nested_replicas_in_parts": nested_replicas_in_parts,
    "lpt_capped": lpt_capped,
    "lpt_pinned": lpt_pinned,
    "lpt_parts": lpt_parts,
    "lpt_parts_sliced": lpt_parts_sliced,
    "lpt_equal_loads": lpt_equal_loads,
    "lpt_by_nation": lpt_by_nation,
    "bucket_sizes": bucket_sizes,
    "plan_quality": plan_quality,
    "plan_key_hash": plan_key_hash,
    "plan_hash_streamed": plan_hash_streamed,
    "plan_diff": plan_diff,
    "plan_delta": plan_delta,
    "plan_equal": plan_equal,
    "evaluation_replay": evaluation_replay,
    "evaluation_stream": evaluation_stream,
    "vote_counts": vote_counts,
    "relation_discovered_shards": relation_discovered_shards,
    "relation_poll_values": relation_poll_values,
    "relation_normalizer_values": relation_normalizer_values,
    "relation_load_index_values": relation_load_index_values,
    "relation_partition_shards": relation_partition_shards,
    "relation_partition_total_load": relation_partition_total_load,
    "relation_projected_shards": _evaluation_relation(observe.evaluation_projected_shards, "projection"),
    "relation_projected_total_load": _evaluation_relation(
        observe.evaluation_projected_replicas_total_load, "projection"
    ),
    "relation_evaluation_shards": _evaluation_relation(observe.evaluation_shards, "elected"),
    "relation_evaluation_total_load": _evaluation_relation(observe.evaluation_replicas_total_load, "elected"),
    "relation_replica_set_changes": relation_replica_set_changes,
    "gauge_rollup": gauge_rollup,
    "stage_status": stage_status,
    "ready_values": ready_values,
    "duplicate_ids": duplicate_ids,
    "rollout_state": rollout_state,
    "change_log": change_log,
    "transition_log": transition_log,
    "relation_scaler_changes": relation_scaler_changes,
    "desired_replicas": desired_replicas,
    "normalized_display": normalized_display,
    "relation_store": relation_store,
    "all_rollups": all_rollups,
    "strategy_run": strategy_run,
    "fleet_values": fleet_values,
    "fleet_status": fleet_status,
    "fleet_assignments": fleet_assignments,
}
