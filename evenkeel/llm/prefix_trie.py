"""A trie of conversations that share their beginnings, measured along its Euler tour.

A node is a distinct sequence of first turns (role, text).  It is known by the running
exclusive-or of two 64-bit hashes of each (depth, role, digest of the text), so a
prefix needs no walk down the trie, and its parent is its own key without the last turn.  Two
of n prefixes fall together by chance in one of 2**128 / n**2 corpora.

Each node enters the tour by one arc and leaves it by another.  From its entry the tour goes
to the first child, else to the node's exit; from its exit to the next sibling, else to the
parent's exit.  The arcs are ranked as one linked list, and what stands between entry and exit of
a node, a difference of two prefix sums over the positions, is its subtree.

Texts are read once, as digest and number of words.  A conversation, a set of siblings or
the members that end at one node may each be a third of all rows: groups beyond
``GROUP_ROWS`` are cut by range into many tasks, with an offset for each part.

Turns are ordered by number (null first), then role and digest, so that repeated and
clashing turns have a fixed order.  Rows without conv_id belong to no conversation.
Null roles and texts are empty ones; a text of any length is one row's work.  No
conversations: no nodes, not even the root.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from evenkeel.llm.common import WORD
from evenkeel.llm.list_ranking import positions
from evenkeel.stages import publish, split_by_size

#: A larger group is ordered in parts by many tasks.
GROUP_ROWS = 200_000
#: Positions whose sums are formed together, at least.
RUN_ROWS = 1 << 16

_SUMS = {"sum": (F.sum, lambda a, b: a + b), "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b))}


def _in_parts(large: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Large groups cut by range: adds ``_part``, ascending with the order; equal rows may lie in several parts."""
    numbered = large.withColumn("_row", F.monotonically_increasing_id())
    parts = max(2, math.ceil(large.count() / GROUP_ROWS))
    return publish(numbered.repartitionByRange(parts, "key", *order, "_row").withColumn("_part", F.spark_partition_id()), name)


def running(rows: DataFrame, order: list[Column], sums: dict[str, tuple[str, Column]], name: str) -> DataFrame:
    """Adds running sums or exclusive-ors (name: (kind, value)) within each ``key`` group, the row itself included."""
    small, large = split_by_size(rows, "key", GROUP_ROWS, name)

    def over(window, group=small):
        window = window.rowsBetween(Window.unboundedPreceding, 0)
        return group.select("*", *[_SUMS[kind][0](value).over(window).alias(c) for c, (kind, value) in sums.items()])

    out = over(Window.partitionBy("key").orderBy(*order))
    if large is None:
        return out
    cut = _in_parts(large, order, f"{name}-parts")
    totals = cut.groupBy("key", "_part").agg(*[_SUMS[kind][0](value).alias(c) for c, (kind, value) in sums.items()])
    before = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "key", "_part", *[F.coalesce(_SUMS[kind][0](c).over(before), F.lit(0)).alias(f"_{c}") for c, (kind, _) in sums.items()]
    )
    local = over(Window.partitionBy("key", "_part").orderBy(*order, "_row"), cut).join(offsets, ["key", "_part"])
    whole = {c: _SUMS[kind][1](F.col(c), F.col(f"_{c}")) for c, (kind, _) in sums.items()}
    return out.unionByName(local.withColumns(whole).select(out.columns))


def _turns(conversations: DataFrame) -> DataFrame:
    """key (the conversation), place (from 1), role, digest, words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("key"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.md5(text).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    placed = running(rows, order, {"place": ("sum", F.lit(1).cast("long"))}, "trie-turns")
    return publish(placed.select("key", "place", "role", "digest", "words"), "trie-places")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (key, depth, role, digest, words) of their turns, and (key, turns) of all of them.

    A conversation c begins with the first h turns of conversation c - c % 20, where
    h = crc32(c) % 4, and goes on with its own turns after its first h.
    """
    starts = turns.where("key % 20 = 0 AND place <= 3").select(F.col("key").alias("base"), "place", "role", "digest", "words")
    have = starts.groupBy("base").agg(F.count(F.lit(1)).alias("have"))
    plan = (
        turns.groupBy("key")
        .agg(F.max("place").alias("own"))
        .select("key", "own", (F.col("key") - F.col("key") % 20).alias("base"), (F.crc32(F.col("key").cast("string")) % 4).alias("h"))
        .join(have, "base", "left")
        .withColumn("lent", F.least("h", F.coalesce("have", F.lit(0))))
    )
    plan = publish(plan.select("key", "base", "h", "lent", (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns")), "trie-plan")
    columns = ["key", "depth", "role", "digest", "words"]
    lent = plan.join(starts, "base").where("place <= h").withColumnRenamed("place", "depth").select(columns)
    own = turns.join(plan, "key").where("place > h").withColumn("depth", F.col("place") - F.col("h") + F.col("lent")).select(columns)
    return lent.unionByName(own), plan.select("key", "turns")


def nodes(paths: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, a and b (its key), up_a and up_b (its parent's), n_convs, words."""
    of_turns = paths.groupBy("depth", "a", "b").agg(
        F.min("key").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        F.max(F.col("a").bitwiseXOR(F.col("za"))).alias("up_a"), F.max(F.col("b").bitwiseXOR(F.col("zb"))).alias("up_b"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = members.agg(F.min("key").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select("*", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("words"), none.alias("up_a"), none.alias("up_b"))
    return of_turns.unionByName(root)


def _siblings(tree: DataFrame) -> DataFrame:
    """conv_id, depth, sibling: the next child of the same parent; the last child has none."""
    rows = tree.where("depth > 0").select(F.struct("depth", "parent_conv_id").alias("key"), "conv_id", "depth")
    small, large = split_by_size(rows, "key", GROUP_ROWS, "trie-children")
    following = F.lead("conv_id").over(Window.partitionBy("key").orderBy("conv_id"))
    out = small.select("conv_id", "depth", following.alias("sibling"))
    if large is None:
        return out
    cut = _in_parts(large, [F.col("conv_id")], "trie-children-parts")
    firsts = cut.groupBy("key", "_part").agg(F.min("conv_id").alias("first"))
    beyond = F.lead("first").over(Window.partitionBy("key").orderBy("_part"))
    local = F.lead("conv_id").over(Window.partitionBy("key", "_part").orderBy("conv_id"))
    rest = cut.select("*", local.alias("local")).join(firsts.select("key", "_part", beyond.alias("beyond")), ["key", "_part"])
    return out.unionByName(rest.select("conv_id", "depth", F.coalesce("local", "beyond").alias("sibling")))


def tour(tree: DataFrame) -> DataFrame:
    """Both arcs of each node: major (conv_id), minor (twice the depth, one more for the exit), what comes next, leaf, saved."""
    inside, none = F.col("first_child").isNotNull(), F.lit(None).cast("long")
    here = F.col("conv_id")
    entry, out = F.col("depth") * 2, F.col("depth") * 2 + 1
    enter = F.struct(
        here.alias("major"), entry.alias("minor"),
        F.coalesce("first_child", here).alias("next_major"), F.when(inside, entry + 2).otherwise(out).alias("next_minor"),
        F.when(inside, 0).otherwise(1).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    more = F.col("sibling").isNotNull()
    leave = F.struct(
        here.alias("major"), out.alias("minor"),
        F.coalesce("sibling", "parent_conv_id").alias("next_major"),
        F.when(more, entry).when(F.col("depth") > 0, out - 2).otherwise(none).alias("next_minor"),
        F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"),
    )
    return tree.select(F.inline(F.array(enter, leave)))


def subtrees(arcs: DataFrame) -> DataFrame:
    """conv_id, depth, n_leaves, saved_tokens from the prefix sums at the arcs' positions."""
    placed = arcs.join(positions(arcs), ["major", "minor"])
    run = max(RUN_ROWS, math.isqrt(arcs.count()))
    placed = publish(placed.select("major", "minor", "at", F.floor(F.col("at") / run).alias("run"), "leaf", "saved"), "trie-arcs")
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # no more than the root of the arcs' number
    runs = placed.groupBy("run").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    runs = runs.select("run", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("leaf", "saved")])
    within = Window.partitionBy("run").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.select("*", *[F.sum(c).over(within).alias(f"{c}_here") for c in ("leaf", "saved")]).join(runs, "run")
    exit_arc = F.col("minor") % 2 == 1

    def between(c: str) -> Column:
        total = F.col(f"{c}_before") + F.col(f"{c}_here")
        return F.sum(F.when(exit_arc, total).otherwise(F.col(c) - total))

    depth = F.floor(F.col("minor") / 2).alias("depth")
    return sums.groupBy(F.col("major").alias("conv_id"), depth).agg(between("leaf").alias("n_leaves"), between("saved").alias("saved_tokens"))


def _id_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one group's ids, joined; the rows come sorted."""
    for batch in batches:
        keys, parts = batch["key"], batch["_part"]
        edges = [0, *[i for i in range(1, batch.num_rows) if keys[i] != keys[i - 1]], batch.num_rows]
        for low, high in zip(edges, edges[1:]):
            if low < high:
                ids = batch["member"].slice(low, high - low).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(low, 1), parts.slice(low, 1), pa.array(ids[:1], pa.int64()), pa.array([",".join(map(str, ids))])],
                    ["key", "_part", "member", "text"],
                )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each group's texts in order, with commas between; only the running digest is held."""
    key, digest = None, None
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])

    def row():
        return pa.RecordBatch.from_pylist([{**key, "ends_sha256": digest.hexdigest()}], schema)

    for batch in batches:
        for here, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist()):
            if here == key:
                digest.update(b",")
            else:
                if key is not None:
                    yield row()
                key, digest = here, hashlib.sha256()
            digest.update(text.encode())
    if key is not None:
        yield row()


def endings(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of rows (key: a struct of conv_id and depth, member)."""
    small, large = split_by_size(ends, "key", GROUP_ROWS, "trie-ends")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda m: m.cast("string")), ",")
    out = small.groupBy("key").agg(F.sha2(ids, 256).alias("ends_sha256")).select("key.*", "ends_sha256")
    if large is None:
        return out
    cut = _in_parts(large, [F.col("member")], "trie-ends-parts").select("key", "_part", "member")
    schema = cut.select("key", "_part", "member", F.lit("").alias("text")).schema
    texts = publish(
        cut.repartition("key", "_part").sortWithinPartitions("key", "_part", "member").mapInArrow(_id_texts, schema), "trie-ends-texts"
    )
    hashed = texts.repartition("key").sortWithinPartitions("key", "_part", "member")
    return out.unionByName(hashed.select("key", "text").mapInArrow(_digests, "conv_id long, depth long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the rebuilt conversations' trie.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; (conv_id, depth) is unique.
    """
    turns, members = rebuilt(_turns(conversations))
    marks = [F.xxhash64(F.lit(seed), "depth", "role", "digest").alias(c) for seed, c in ((1, "za"), (2, "zb"))]
    rows = turns.select("key", "depth", "words", *marks)
    paths = running(rows, [F.col("depth")], {"a": ("xor", F.col("za")), "b": ("xor", F.col("zb"))}, "trie-rebuilt")
    paths = publish(paths, "trie-paths")
    known = publish(nodes(paths, members), "trie-nodes")
    above = known.select(
        F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b")
    )
    tree = publish(known.join(above, ["depth", "up_a", "up_b"], "left"), "trie-tree")
    children = tree.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    children = children.agg(F.count(F.lit(1)).alias("n_children"), F.min("conv_id").alias("first_child"))
    linked = publish(tree.join(children, ["conv_id", "depth"], "left").join(_siblings(tree), ["conv_id", "depth"], "left"), "trie-linked")
    arcs = publish(tour(linked), "trie-tour")
    zero = F.lit(0).cast("long")
    last = paths.select("key", "depth", "a", "b").join(members.withColumnRenamed("turns", "depth"), ["key", "depth"])
    last = last.unionByName(members.where("turns = 0").select("key", zero.alias("depth"), zero.alias("a"), zero.alias("b")))
    ends = last.join(known.select("conv_id", "depth", "a", "b"), ["depth", "a", "b"]).select(
        F.struct("conv_id", "depth").alias("key"), F.col("key").alias("member")
    )
    found = linked.join(subtrees(arcs), ["conv_id", "depth"]).join(endings(ends), ["conv_id", "depth"], "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


#: crc32 has no function in SQL here: its table, made by its rule, and the steps over the bytes of an ASCII text.
CRC_TABLE = """crc AS (
  SELECT list(list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS tab
  FROM range(256) r(i))"""


def sql_crc32(text: str) -> str:
    return (
        f"xor(list_reduce([ord(ch) for ch in string_split({text}, '')], "
        "lambda a, b: xor(a >> 8, tab[(xor(a, b::bigint) & 255) + 1]), 4294967295), 4294967295)"
    )


ORACLE = rf"""
WITH {CRC_TABLE},
turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, md5(coalesce(text, '')) AS digest,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 20 AS base, {sql_crc32("c::varchar")} % 4 AS h FROM (SELECT DISTINCT c FROM turns), crc),
lent AS (SELECT v.c, t.place AS depth, t.role, t.digest, t.words FROM convs v JOIN turns t ON t.c = v.base AND t.place <= v.h),
own AS (SELECT v.c, t.place - v.h + (SELECT count(*) FROM lent l WHERE l.c = v.c) AS depth, t.role, t.digest, t.words
        FROM convs v JOIN turns t ON t.c = v.c AND t.place > v.h),
rows_ AS (SELECT * FROM lent UNION ALL SELECT * FROM own),
paths AS (
  SELECT c, depth, words, md5(string_agg(len(role) || ':' || role || digest, '' ) OVER (PARTITION BY c ORDER BY depth)) AS k FROM rows_
  UNION ALL SELECT c, 0, 0, '' FROM convs),
nodes AS (SELECT depth, k, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words FROM paths GROUP BY depth, k),
parents AS (
  SELECT n.conv_id, n.depth, n.n_convs, n.words, min(u.conv_id) AS parent_conv_id
  FROM nodes n LEFT JOIN paths p ON p.c = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN nodes u ON u.depth = p.depth AND u.k = p.k
  GROUP BY ALL),
children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM parents WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM parents p LEFT JOIN children USING (conv_id, depth)),
above AS (  -- each node and all nodes on its way from the root
  SELECT u.conv_id, u.depth, sum((c.n_children = 0)::bigint) AS n_leaves, sum((c.n_convs - 1) * c.words) AS saved_tokens
  FROM counted c JOIN paths p ON p.c = c.conv_id AND p.depth <= c.depth JOIN nodes u ON u.depth = p.depth AND u.k = p.k GROUP BY ALL),
ends AS (
  SELECT n.conv_id, n.depth, sha256(string_agg(p.c::varchar, ',' ORDER BY p.c)) AS ends_sha256
  FROM (SELECT c, max(depth) AS depth FROM paths GROUP BY c) JOIN paths p USING (c, depth) JOIN nodes n USING (depth, k) GROUP BY ALL)
SELECT c.conv_id::bigint AS conv_id, c.depth::bigint AS depth, parent_conv_id::bigint AS parent_conv_id, n_convs::bigint AS n_convs,
       n_children::bigint AS n_children, n_leaves::bigint AS n_leaves, saved_tokens::bigint AS saved_tokens,
       coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM counted c JOIN above USING (conv_id, depth) LEFT JOIN ends USING (conv_id, depth)"""
