"""Grouped robust scaling: (x - median) / IQR per metric, with exact quartiles.

The quartiles are the medians of the lower and upper half, the middle value left
out of both when the count is odd.  They are found by rank, without sorting a
whole metric in one task and without moving the values themselves:

1. one aggregate gives count, extremes and approximate quantiles per metric;
2. a second pass keeps only values inside narrow brackets around the quartiles and
   counts the rest, which yields exact ranks;
3. where too many values are left for one row, rounds of counts by range narrow each rank to a
   few of them;
4. the resulting table, one row per metric, is joined back to the values.

Nothing sorts the values of a metric: they are counted, and short lists picked from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from ..functions.quantity import plain_text
from ..schemas import SCALE, quantise
from ..stages import publish, stored_rows

KEYS = ("ref", "metric_id")

# Up to this many values a group is ranked whole, beyond it inside brackets.
WHOLE_GROUP_ROWS = 100_000
# Relative rank error of the approximate quantiles is 1 / accuracy; about 30 / accuracy
# of a group lie inside its brackets, so very large tables get the finer sketch.
ACCURACY = 10_000
FINE_ACCURACY = 100_000
FINE_FROM_ROWS = 1_000_000_000
# Distinct values that ranks are picked from in one row, and ranges of a round that narrows them.
LIST_ROWS = 100_000
RANGES = 64


def _quartile_ranks(n: Column) -> dict[str, Column]:
    """1-based ranks: each quartile is the mean of its two rank values."""
    half = F.call_function("div", n, F.lit(2))

    def middle(count: Column, after: Column) -> tuple[Column, Column]:
        return (
            after + F.call_function("div", count + F.lit(1), F.lit(2)),
            after + F.call_function("div", count + F.lit(2), F.lit(2)),
        )

    zero = F.lit(0).cast("bigint")
    ranks = {}
    for name, (count, after) in {
        "median": (n, zero),
        "q1": (half, zero),
        "q3": (half, n - half),
    }.items():
        ranks[name + "_a"], ranks[name + "_b"] = middle(count, after)
    return ranks


def _brackets(values: DataFrame, keys: list[str], whole_rows: int, accuracy: int, margin: float) -> DataFrame:
    reach = margin / accuracy
    spots = [max(0.0, min(1.0, q + d)) for q in (0.25, 0.5, 0.75) for d in (-reach, reach)]
    seen = values.groupBy(*keys).agg(
        F.count("x").alias("n"),
        F.min("x").alias("least"),
        F.max("x").alias("most"),
        F.percentile_approx("x", spots, accuracy).alias("spots"),
    )
    small = F.lit(True) if margin >= accuracy else F.col("n") <= F.lit(whole_rows)
    return seen.select(
        *keys,
        "n",
        "least",
        "most",
        *[F.when(small, F.col("least")).otherwise(F.col("spots")[2 * i]).alias(f"lo{i}") for i in range(3)],
        *[F.when(small, F.col("most")).otherwise(F.col("spots")[2 * i + 1]).alias(f"hi{i}") for i in range(3)],
    )


def _whole(values: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the values at the six ranks, from a list of all: for a table that is small as a whole."""
    lists = values.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    sized = lists.select(*keys, "xs", F.size("xs").cast("bigint").alias("n"))
    picks = [F.get("xs", (rank - 1).cast("int")).alias(name) for name, rank in _quartile_ranks(F.col("n")).items()]
    return sized.select(*keys, "n", F.get("xs", F.lit(0)).alias("least"), F.get("xs", (F.col("n") - 1).cast("int")).alias("most"), *picks)


def _count_in_brackets(values: DataFrame, keys: list[str], brackets: DataFrame) -> DataFrame:
    """Distinct values inside the brackets with their counts, and one count per gap."""
    x = F.col("x")
    inside = F.lit(False)
    for i in range(3):
        inside = inside | x.between(F.col(f"lo{i}"), F.col(f"hi{i}"))
    # a value outside stands for its gap: the bracket end before it, or nothing
    gap = F.when(x > F.col("hi2"), F.col("hi2"))
    gap = gap.when(x > F.col("hi1"), F.col("hi1")).when(x > F.col("hi0"), F.col("hi0"))
    return (
        values.join(brackets, keys)
        .select(*keys, "n", "least", "most", inside.alias("kept"), F.when(inside, x).otherwise(gap).alias("x"))
        .groupBy(*keys, "n", "least", "most", "kept", "x")
        .agg(F.count(F.lit(1)).alias("c"))
    )


def quartile_stats(
    df: DataFrame,
    keys: tuple[str, ...] = KEYS,
    value: str = "value",
    whole_rows: int = WHOLE_GROUP_ROWS,
    accuracy: int | None = None,
    margin: float = 4,
    list_rows: int = LIST_ROWS,
) -> DataFrame:
    """Per group: n, least, most, q1, median, q3, iqr (0 for a single value).

    Reads ``df`` twice: hand over a stage table, not a long lazy plan.  A stage table
    of at most ``whole_rows`` rows is read once.  ``margin`` is the half width of a
    bracket in ranks of the sketch; groups with a rank outside its bracket are done
    again with wider ones, at last with all their values.  ``list_rows`` distinct values of a
    group at most are held by one row.
    """
    rows = stored_rows(df)
    if accuracy is None:
        fine = rows is not None and rows >= FINE_FROM_ROWS
        accuracy = min(whole_rows, FINE_ACCURACY if fine else ACCURACY)
    if whole_rows < accuracy:
        raise ValueError("brackets need more values than the sketch's accuracy: raise whole_rows")
    keys = list(keys)
    values = df.select(*keys, F.col(value).cast("double").alias("x")).where("x IS NOT NULL")
    if rows is not None and rows <= whole_rows:
        return _means(_whole(values, keys), keys)
    done, rest = None, values
    for width in (margin, 16 * margin + 16, accuracy):
        brackets = publish(_brackets(rest, keys, whole_rows, accuracy, width), "brackets")
        counted = _count_in_brackets(rest, keys, brackets)
        largest = brackets.agg(F.max("n")).first()[0] or 0
        # by the sketch's error no more than this lies inside three brackets
        inside = largest if width >= accuracy else max(min(largest, whole_rows), 6 * (width + 1) / accuracy * largest)
        cells = None
        if inside > list_rows:
            counted, cells = _narrowed(counted, keys, list_rows)
        misses = Observation()
        picked = _picked(counted, keys, cells).observe(misses, F.count_if(_missed()).alias("n"))
        picked = publish(picked, "quartiles")
        if not misses.get["n"]:
            done = picked if done is None else done.unionByName(picked)
            break
        found, missed = picked.where(~_missed()), picked.where(_missed())
        done = found if done is None else done.unionByName(found)
        rest = values.join(missed.select(*keys), keys, "left_semi")
    return _means(done, keys)


def _in_order(x: Column, kept: Column, c: Column) -> Column:
    """Entries sort by value, a gap after the value it follows, the gap below all first."""
    return F.struct(x.isNotNull().alias("valued"), x.alias("x"), (~kept).alias("gap"), c.alias("c"))


def _wanted(n: Column) -> Column:
    return F.array(*[F.struct(F.lit(name).alias("name"), rank.alias("rank")) for name, rank in _quartile_ranks(n).items()])


def _narrowed(counted: DataFrame, keys: list[str], list_rows: int) -> tuple[DataFrame, DataFrame]:
    """Entries in cells of at most ``list_rows``, and (keys, n, least, most, name, rank, cell) of each rank wanted.

    Each round cuts the cells that are still too large into ranges of about as many entries each,
    counts them, and keeps those that a wanted rank falls into, with the rank counted from there.
    """
    group = [*keys, "n", "least", "most"]
    start = F.lit(0).cast("bigint").alias("cell")
    data = publish(counted.select("*", start), "rank-entries")
    wanted = data.select(*group).distinct().select(*group, F.inline(_wanted(F.col("n"))))
    wanted = publish(wanted.select("*", start), "ranks")
    while True:
        sizes = data.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("entries")).where(F.col("entries") > list_rows)
        spots = [i / RANGES for i in range(1, RANGES)]
        edges = data.join(sizes, [*keys, "cell"]).groupBy(*keys, "cell").agg(F.percentile_approx("x", spots, 1000).alias("edges"))
        edges = publish(edges, "rank-edges")
        if not stored_rows(edges):
            return data, wanted
        # the range that begins at the last edge below the value; cells without edges stay as they are
        nth = F.when(F.col("edges").isNotNull(), F.size(F.filter("edges", lambda e: e < F.col("x"))))
        nth = F.when(F.col("edges").isNotNull() & F.col("x").isNull(), F.lit(0)).otherwise(nth)
        cut = data.join(edges, [*keys, "cell"], "left").select(*group, "cell", "kept", "x", "c", nth.alias("nth"))
        cut = publish(cut, "rank-cut")
        counts = cut.where("nth IS NOT NULL").groupBy(*keys, "cell", "nth").agg(F.sum("c").alias("c"))
        lists = counts.groupBy(*keys, "cell").agg(F.array_sort(F.collect_list(F.struct("nth", "c"))).alias("counts"))
        zero = F.lit(0).cast("bigint")
        found = F.aggregate(
            "counts",
            F.struct(F.lit(None).cast("int").alias("nth"), zero.alias("upto"), zero.alias("before")),
            lambda s, e: F.when(s["nth"].isNotNull(), s).otherwise(
                F.struct(
                    F.when(F.col("rank") <= s["upto"] + e["c"], e["nth"]).alias("nth"),
                    (s["upto"] + e["c"]).alias("upto"),
                    s["upto"].alias("before"),
                )
            ),
        )
        placed = wanted.join(lists, [*keys, "cell"], "left").withColumn("at", F.when(F.col("counts").isNotNull(), found))
        inner = F.col("cell") * F.lit(RANGES) + 1
        wanted = publish(
            placed.select(
                *group, "name",
                F.when(F.col("at").isNotNull(), F.col("rank") - F.col("at.before")).otherwise(F.col("rank")).alias("rank"),
                F.when(F.col("at").isNotNull(), inner + F.col("at.nth")).otherwise(F.col("cell")).alias("cell"),
            ),
            "ranks",
        )
        moved = cut.withColumn("cell", F.when(F.col("nth").isNotNull(), inner + F.col("nth")).otherwise(F.col("cell"))).drop("nth")
        data = publish(moved.join(wanted.select(*keys, "cell").distinct(), [*keys, "cell"], "left_semi"), "rank-entries")


def _picked(counted: DataFrame, keys: list[str], ranks: DataFrame | None = None) -> DataFrame:
    """Per group the values at the six ranks; NULL where a rank lies in a gap.

    ``ranks`` are those of ``_narrowed``; without them each group is one cell.
    """
    group, cell = [*keys, "n", "least", "most"], [] if ranks is None else ["cell"]
    entry = _in_order(F.col("x"), F.col("kept"), F.col("c"))
    lists = counted.groupBy(*group, *cell).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    names = list(_quartile_ranks(F.col("n")))
    if ranks is None:
        lists = lists.withColumns({f"rank_{name}": rank for name, rank in _quartile_ranks(F.col("n")).items()})
    else:
        asked = [F.max(F.when(F.col("name") == name, F.col("rank"))).alias(f"rank_{name}") for name in names]
        lists = lists.join(ranks.groupBy(*keys, "cell").agg(*asked), [*keys, "cell"])
    # one pass over a list: each rank takes the entry that its count falls into
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(0).cast("bigint").alias("upto"), *[none.alias(name) for name in names])

    def step(s: Column, e: Column) -> Column:
        upto = s["upto"] + e["c"]

        def pick(name: str) -> Column:
            rank = F.col(f"rank_{name}")
            return F.when((rank > s["upto"]) & (rank <= upto) & ~e["gap"], e["x"]).otherwise(s[name]).alias(name)

        return F.struct(upto.alias("upto"), *[pick(name) for name in names])

    found = lists.select(*group, F.aggregate("entries", start, step).alias("found"))
    if ranks is None:
        return found.select(*group, *[F.col(f"found.{name}").alias(name) for name in names])
    return found.groupBy(*group).agg(*[F.max(f"found.{name}").alias(name) for name in names])


def _missed() -> Column:
    missed = F.col("median_a").isNull() | F.col("median_b").isNull()
    for name in ("q1", "q3"):
        missed = missed | ((F.col("n") > 1) & (F.col(name + "_a").isNull() | F.col(name + "_b").isNull()))
    return missed


def _means(picked: DataFrame, keys: list[str]) -> DataFrame:
    def mean(name: str) -> Column:
        return (F.col(name + "_a") + F.col(name + "_b")) / 2

    return picked.select(
        *keys,
        "n",
        "least",
        "most",
        F.when(F.col("n") > 1, mean("q1")).alias("q1"),
        mean("median").alias("median"),
        F.when(F.col("n") > 1, mean("q3")).alias("q3"),
        F.when(F.col("n") > 1, mean("q3") - mean("q1")).otherwise(F.lit(0.0)).alias("iqr"),
    )


def _scaled(x: Column) -> Column:
    return F.when(F.col("iqr") == 0, F.lit(0.0)).otherwise(
        (x - F.col("median")) / F.when(F.col("iqr") != 0, F.col("iqr"))
    )


def scaling_table(stats: DataFrame, epsilon: float | DataFrame | None, scale: int = SCALE) -> DataFrame:
    """Per (ref, metric): median, IQR and the ref-wide offset, NULL for a ref without epsilon.

    Scaling is monotone, so the extremes of the scaled values follow from the
    extremes of the raw ones; the values are not read again.
    """
    if epsilon is None:
        return stats.select(*KEYS, "median", "iqr")
    ends = stats.select(
        *KEYS,
        "median",
        "iqr",
        quantise(_scaled(F.col("least")), scale).cast("double").alias("low"),
        quantise(_scaled(F.col("most")), scale).cast("double").alias("high"),
    )
    # one row per metric, so a ref's rows are few
    ref = Window.partitionBy("ref")
    low, high = F.min("low").over(ref), F.max("high").over(ref)
    if isinstance(epsilon, DataFrame):
        ends, share = ends.join(epsilon.select("ref", "epsilon"), "ref", "left"), F.col("epsilon").cast("double")
    else:
        share = F.lit(float(epsilon))
    offset = -low + share * (high - low)
    return ends.select(*KEYS, "median", "iqr", offset.alias("offset"))


def robust_scale(
    values: DataFrame,
    epsilon: float | DataFrame | None = None,
    scale: int = SCALE,
    whole_rows: int = WHOLE_GROUP_ROWS,
    rounding: str = "nearest",
) -> DataFrame:
    """Scale every metric by its median and IQR; a group without spread becomes 0.

    With ``epsilon`` one offset per ref, over all its metrics together, makes every
    value positive; a frame of (ref, epsilon) gives each ref its own.  ``display_value``
    is the text before the offset.
    """
    table = publish(values, "metric-values")
    stats = quartile_stats(table, whole_rows=whole_rows)
    # one row per metric, stored: its true size decides whether the join broadcasts it
    ways = publish(scaling_table(stats, epsilon, scale), "scaling")
    scaled = table.join(ways, list(KEYS)).withColumn("scaled", _scaled(F.col("value").cast("double")))
    fixed = quantise(F.col("scaled"), scale, rounding)
    final = fixed if epsilon is None else quantise(fixed.cast("double") + F.col("offset"), scale, rounding)
    if isinstance(epsilon, DataFrame):
        final = F.when(F.col("offset").isNull(), fixed).otherwise(final)
    return scaled.select(
        "ref",
        "metric_id",
        "shard",
        "query",
        final.alias("value"),
        plain_text(F.col("scaled")).alias("display_value"),
    )
