"""Mixing sources to target weights, with DataFrame functions only.

Sources in code point order (null last) weigh 1, 2, 3, 1, ... and share all words; a
target stops at three times its source's words and the excess is shared again by weight.
Each source is cut into 256 blocks by a hash of the document, so that a hot source is
many small groups.  A source gives whole passes over its blocks, then as many blocks, in
a permuted order, as its target still needs; the last of them gives its documents in
order, and the last document only the words that are still missing.  So the words
taken are the target rounded to a word.  With ``whole`` no document is cut: the last one
is taken whole or not at all, whichever leaves its source nearer the target.

The block quotas are dealt to the output shards by a splitting tree: each node draws half of its
blocks without replacement for the left child (a multivariate hypergeometric draw over
the sources), the rest goes right.  Within a shard, documents are shuffled by a hash.
All draws are hashes of seed, source, block and document: reruns agree.

Null and empty texts have size zero, belong to a source and are never taken beyond
zero words.  Repeated rows are documents of their own; rows that agree in id and size
are interchangeable.  No words, or no rows: targets are zero.  Tables of sources and blocks
have one row and at most 1,024 rows for each source; a window over all sources runs in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evenkeel.llm.common import SPACES, WORD
from evenkeel.stages import publish

#: A document gives at most so many times its words.
MOST = 3
#: Levels of the splitting tree, 2**LEVELS output shards, and text bytes of a shard beyond which ``mix`` adds levels.
LEVELS = 4
SHARD_BYTES = 32 << 20
SEED = "mix-1"


def _hash(*parts: Column | str) -> Column:
    columns = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts]
    return F.md5(F.concat_ws("|", F.lit(SEED), *columns))


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from rows of (source, size)."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.select(
        "source", "source_size", (1 + F.col("rank") % 3).cast("long").alias("weight"), "rank",
        (F.col("source_size") * MOST).alias("cap"),
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = weighed.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("words_left"),
        F.sum("weight").over(onward).alias("weight_left"),
    )
    capped = F.col("cap") * F.col("weight_left") < F.col("weight") * F.col("words_left")
    # the first source that is not capped sets the share of all after it
    share = F.first(F.when(~capped, F.struct("words_left", "weight_left")), ignorenulls=True).over(everything)
    level = F.col("weight").cast("double") * share["words_left"].cast("double") / share["weight_left"].cast("double")
    target = F.when(capped, F.col("cap").cast("double")).otherwise(level)
    return left.withColumn("target", target).select("source", "source_size", "target")


def _block(doc_id: Column) -> Column:
    return F.substring(_hash("doc", doc_id), 1, 2)


def blocks(sizes: DataFrame) -> DataFrame:
    """One row for each (source, block): words, what the partial pass takes, and the source's target.

    ``passes`` counts whole passes, ``need`` is what the partial pass takes of the block.
    """
    sums = sizes.groupBy("source", _block(F.col("doc_id")).alias("block")).agg(F.sum("size").alias("words"))
    sums = publish(sums, "mix-sums")
    goals = targets(sums.select("source", F.col("words").alias("size")))
    goal = F.floor(F.col("target") + 0.5)
    rows = sums.join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("int"))
    rest = goal - F.col("passes") * F.col("source_size")
    order = Window.partitionBy("source").orderBy(_hash("block", F.col("source"), F.col("block")))
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    need = F.least(F.greatest(rest - before, F.lit(0)), F.col("words"))
    return rows.withColumn("need", need.cast("long"))


def split_tree(plan: DataFrame, levels: int = LEVELS) -> DataFrame:
    """source, block, pass, shard: every block taken, as often as it is taken.

    A whole pass takes all blocks; the partial pass, numbered after them, takes those that are needed.
    """
    turns = F.when(F.col("need") > 0, F.col("passes") + 1).otherwise(F.col("passes"))
    rows = plan.where((turns > 0) & (F.col("words") > 0)).select(
        "source", "block", F.explode(F.sequence(F.lit(0), (turns - 1).cast("int"))).alias("pass"), F.lit(0).alias("shard")
    )
    for level in range(levels):
        node = Window.partitionBy("shard")
        drawn = F.row_number().over(node.orderBy(_hash(f"level{level}", F.col("source"), F.col("block"), F.col("pass")), "source"))
        left = drawn * 2 <= F.count(F.lit(1)).over(node)
        rows = rows.withColumn("shard", F.col("shard") * 2 + F.when(left, 0).otherwise(1))
    return rows


def levels_for(docs: DataFrame) -> int:
    """Levels of the tree for whole documents: shards of some ``SHARD_BYTES`` of text, 2**LEVELS at least."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(LEVELS, (size // SHARD_BYTES).bit_length())


def mixed_rows(docs: DataFrame, whole: bool = False, levels: int = LEVELS) -> DataFrame:
    """row (a struct of all columns), size, source_size, target, taken, part, passes, shards.

    ``part`` is what the partial pass takes of the document, with ``whole`` all or nothing;
    ``shards`` has the shard of each pass in order.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        size_of(F.col("text").cast("string")).alias("size"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    plan = publish(blocks(rows.select("doc_id", "source", "size")), "mix-plan")
    shards = split_tree(plan, levels).groupBy(F.col("source").alias("_s"), F.col("block").alias("_b")).agg(
        F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("turns")
    )
    plan = plan.join(shards, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")), "left").select(
        F.col("source").alias("_s"), F.col("block").alias("_b"), "words", "need", "passes", "source_size", "target",
        F.coalesce(F.col("turns.shard"), F.array().cast("array<int>")).alias("shards"),
    )
    plan = publish(plan, "mix-blocks")
    placed = rows.withColumn("block", _block(F.col("doc_id"))).join(
        plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))
    )
    # only a source's last block is in need of an order of its documents
    border = (F.col("need") > 0) & (F.col("need") < F.col("words"))
    sure = placed.where(~border).withColumn("part", F.when(F.col("need") > 0, F.col("size")).otherwise(F.lit(0).cast("long")))
    order = Window.partitionBy("source", "block").orderBy(_hash("doc", F.col("doc_id")), "doc_id", "size")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = placed.where(border).withColumn("part", F.least(F.greatest(F.col("need") - before, F.lit(0)), F.col("size")))
    if whole:
        # words still missing before the document: half of it or more, and it is taken
        missing = F.col("target") - F.floor(F.col("target") + 0.5) + F.col("part")
        fits = (F.col("part") > 0) & ((F.col("part") == F.col("size")) | (missing * 2 >= F.col("size")))
        cut = cut.withColumn("part", F.when(fits, F.col("size")).otherwise(F.lit(0).cast("long")))
    taken = F.col("passes") * F.col("size") + F.col("part")
    return sure.unionByName(cut).select(
        "row", "doc_id", "size", "source_size", "target", taken.alias("taken"), "part", "passes",
        F.when(F.col("size") == 0, F.array().cast("array<int>"))
        .when(F.col("part") > 0, F.col("shards"))
        .otherwise(F.slice("shards", F.lit(1), F.col("passes"))).alias("shards"),
    )


def mix(docs: DataFrame, whole: bool = False) -> DataFrame:
    """The mix itself: the columns of ``docs``, one row for each time a document is taken.

    A document cut short (none with ``whole``) has its first words, joined by single spaces (and
    ``n_chars``, if there is one, of that text).  Rows are dealt by shard, each shard to a partition of
    its own, and shuffled within it by a hash.
    """
    levels = levels_for(docs)
    taken = mixed_rows(docs, whole, levels).where(F.size("shards") > 0).select("*", F.posexplode("shards").alias("_turn", "_shard"))
    short = (F.col("_turn") == F.col("passes")) & (F.col("part") < F.col("size"))
    words = F.slice(F.split(F.regexp_replace(F.col("row.text"), rf"^[{SPACES}]+", ""), rf"[{SPACES}]+"), F.lit(1), F.col("part").cast("int"))
    text = F.when(short, F.array_join(words, " ")).otherwise(F.col("row.text"))
    kept = {c: F.col(f"row.`{c}`") for c in docs.columns}
    kept["text"] = text.alias("text")
    if "n_chars" in kept:
        kept["n_chars"] = F.when(short, F.length(text).cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars")
    place = _hash("place", F.col("doc_id"), F.col("_turn"))
    dealt = taken.select(F.struct(*kept.values()).alias("out"), "_shard", place.alias("_place"))
    return dealt.repartitionById(1 << levels, "_shard").sortWithinPartitions("_shard", "_place").select("out.*")


def _sql_hash(*parts: str) -> str:
    return "md5(concat_ws('|', '%s', %s))" % (SEED, ", ".join(parts))


def oracle(documents: str = "documents") -> str:
    """The per-document result in SQL."""
    key = "coalesce(doc_id::varchar, '\\N')"
    source = "coalesce(source, '\\N')"
    levels, table = [], "turns"
    for level in range(LEVELS):
        h = _sql_hash(f"'level{level}'", source, "block", "pass::varchar")
        levels.append(
            f"level{level} AS (SELECT source, block, pass, shard * 2 + CASE WHEN 2 * row_number() OVER "
            f"(PARTITION BY shard ORDER BY {h}, source) <= count(*) OVER (PARTITION BY shard) THEN 0 ELSE 1 END AS shard "
            f"FROM {table})"
        )
        table = f"level{level}"
    return rf"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size,
         {_sql_hash("'doc'", key)} AS h
  FROM {documents}),
sums AS (SELECT source, h[1:2] AS block, sum(size)::bigint AS words FROM sizes GROUP BY ALL),
ranked AS (SELECT source, sum(words)::bigint AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
           FROM sums GROUP BY source),
weighed AS (SELECT *, 1 + rank % 3 AS weight, {MOST} * source_size AS cap FROM ranked),
lefts AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
                 sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
          FROM weighed WINDOW o AS (ORDER BY cap / weight::double, rank)),
marked AS (SELECT *, cap * weight_left < weight * words_left AS capped FROM lefts),
shares AS (SELECT words_left AS wl, weight_left AS tl FROM marked WHERE NOT capped ORDER BY cap / weight::double, rank LIMIT 1),
goals AS (SELECT source, source_size, CASE WHEN capped THEN cap::double ELSE weight::double * wl::double / tl::double END AS target
          FROM marked LEFT JOIN shares ON true),
passed AS (SELECT source, source_size, target, floor(target + 0.5)::bigint AS goal,
                  CASE WHEN source_size > 0 THEN floor(floor(target + 0.5) / source_size)::bigint ELSE 0 END AS passes FROM goals),
plan AS (
  SELECT s.source, s.block, s.words, p.source_size, p.target, p.passes,
         least(greatest(p.goal - p.passes * p.source_size - coalesce(sum(s.words) OVER (
           PARTITION BY s.source ORDER BY {_sql_hash("'block'", "coalesce(s.source, '\\N')", "s.block")}
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), s.words)::bigint AS need
  FROM sums s JOIN passed p ON s.source IS NOT DISTINCT FROM p.source),
turns AS (SELECT source, block, unnest(range(passes + CASE WHEN need > 0 THEN 1 ELSE 0 END)) AS pass, 0 AS shard
          FROM plan WHERE words > 0),
{", ".join(levels)},
dealt AS (SELECT source, block, list(shard ORDER BY pass) AS shards FROM {table} GROUP BY ALL),
parts AS (
  SELECT z.doc_id, z.size, p.source_size, p.target, p.passes, d.shards,
         least(greatest(p.need - coalesce(sum(z.size) OVER (PARTITION BY z.source, p.block ORDER BY z.h, z.doc_id, z.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), z.size)::bigint AS part
  FROM sizes z JOIN plan p ON z.source IS NOT DISTINCT FROM p.source AND z.h[1:2] = p.block
  LEFT JOIN dealt d ON z.source IS NOT DISTINCT FROM d.source AND z.h[1:2] = d.block)
SELECT doc_id, size, source_size, target, (passes * size + part)::bigint AS taken,
       CASE WHEN size = 0 THEN '' ELSE coalesce(array_to_string(shards[1:passes + CASE WHEN part > 0 THEN 1 ELSE 0 END], ','), '') END AS shards
FROM parts"""
