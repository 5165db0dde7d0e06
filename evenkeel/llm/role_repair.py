"""Conversations repaired to the grammar of roles, by a generalised LR parser with edits.

A conversation is an optional system turn and then pairs of user and assistant, or nothing::

    S -> (empty) | P | s P        P -> P E | E        E -> u a

Every row is kept, given another role, or deleted, and turns may be inserted; each edit has
its cost.  All stacks that the parser can have after a row live side by side.  A stack is a node: an
LR state and the node below it, so that stacks share what lies below, and equal stacks
are one node, which keeps the least (cost, audit) that leads to it.  The audit has a letter for
each edit.  An audit that ends with the edit of a row is never the beginning of another such audit of
the same rows, so a rank among the live nodes says all that later comparisons need, and
a step depends on the differences of costs, the ranks and the row's kind alone: steps
are looked up once they have been worked out.

Rows are sorted over all tasks by conversation.  A conversation that lies within one task and a run
of ``RUN_ROWS`` rows or ``RUN_CHARS`` characters is done at once.  For the others (the first and the last of a task,
and long ones, however long) each run is parsed from every node it might begin with; folding the
runs' tables of costs picks the nodes, and with them the audit of each run.  Texts pass
by run by run, and only a running digest sees a whole conversation.

Null roles, texts and parts of the damage's key count as one space; rows without conv_id
are one conversation.  Turns come by number (null first), then by role and digest of the text.
Equal rows of one turn stay in one task, where they stream.  No rows: no conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from evenkeel.llm.prefix_trie import CRC_TABLE, sql_crc32
from evenkeel.stages import publish

#: Rows, and characters of text, that are parsed and carried as one.
RUN_ROWS = 2000
RUN_CHARS = 1 << 22

# Costs, roles, and what one space or none of it means.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = {("s", "u"), ("u", "a"), ("a", "u")}
BLANKS = " \t\n\x0b\f\r"

# LR(0) states of the grammar: 0 start, 1 after s, 2 after the u of a pair, 3 pairs, 4 pairs after s.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (4, "u"): 2}
GOTO = {0: 3, 1: 4, 3: 3, 4: 4}
ACCEPTING = {0, 3, 4}
#: Kinds of rows: the role's initial (x: any other), then what must or may become of it.
MUST_GO = "-"


def _shifted(stack: tuple, role: str) -> tuple | None:
    """The stack after a role; a stack is (state, stack below).  None: an error."""
    state, below = stack
    if state == 2:
        if role != "a":
            return None
        # E -> u a, then P -> E on the bottom state, or P -> P E in place of the pairs so far
        pairs = GOTO[below[0]]
        return (pairs, below[1]) if below[0] == pairs else (pairs, below)
    following = SHIFT.get((state, role))
    return None if following is None else (following, stack)


def _all_stacks() -> list[tuple]:
    found = [(0, None)]
    for stack in found:
        for role in "sua":
            following = _shifted(stack, role)
            if following and following not in found:
                found.append(following)
    return found


STACKS = _all_stacks()
NODES = range(len(STACKS))
MOVE = [{r: STACKS.index(s) for r in "sua" if (s := _shifted(stack, r))} for stack in STACKS]
#: The one role that an edit can put on each node.
EDITED = [next(r for r in "ua" if r in moves) for moves in MOVE]


def _inserts(node: int) -> list[int]:
    """The nodes after 0, 1, 2, ... inserted turns, as long as they are new."""
    out = [node]
    while (following := MOVE[out[-1]][EDITED[out[-1]]]) not in out:
        out.append(following)
    return out


@lru_cache(maxsize=None)
def _edits(kind: str) -> list[dict[int, tuple[int, str]]]:
    """For each node the nodes after a row of this kind, each with the least (cost, letters).

    Turns are not inserted right before a deleted row: behind it they cost the same, and D sorts before I.
    """
    out = []
    for node in NODES:
        found: dict = {node: (DELETE, "D")}
        if kind != MUST_GO:
            more = TRUNCATED if kind.endswith("!") else 0
            for n, here in enumerate(_inserts(node)):
                for letter, role, cost in (("K", kind[0], KEEP), ("R", EDITED[here], REROLE)):
                    if role in MOVE[here]:
                        way = (n * INSERT + cost + more, "I" * n + letter)
                        target = MOVE[here][role]
                        found[target] = min(found.get(target, way), way)
        out.append(found)
    return out


@lru_cache(maxsize=1 << 16)
def _step(live: tuple, kind: str) -> tuple[tuple, int, dict]:
    """(live nodes after a row, cost they all share, for each its predecessor and letters).

    ``live`` has (node, cost beyond the cheapest, rank of its audit).
    """
    best: dict = {}
    for node, cost, rank in live:
        for target, (more, letters) in _edits(kind)[node].items():
            way = (cost + more, rank, letters, node)
            best[target] = min(best.get(target, way), way)
    least = min(way[0] for way in best.values())
    ranks = {key: n for n, key in enumerate(sorted({(rank, letters) for _, rank, letters, _ in best.values()}))}
    after = tuple(sorted((t, cost - least, ranks[rank, letters]) for t, (cost, rank, letters, _) in best.items()))
    return after, least, {t: (node, letters) for t, (_, _, letters, node) in best.items()}


def parse(kinds: list[str], entry: int) -> dict[int, tuple[int, int, str]]:
    """For each node that rows of these kinds can end with, from an entry: (cost, rank, audit)."""
    live, total, back = ((entry, 0, 0),), 0, []
    for kind in kinds:
        live, more, ways = _step(live, kind)
        total += more
        back.append(ways)
    out = {}
    for node, cost, rank in live:
        letters, here = [], node
        for ways in reversed(back):
            here, piece = ways[here]
            letters.append(piece)
        out[node] = (total + cost, rank, "".join(reversed(letters)))
    return out


def finish(live: dict[int, tuple[int, int]]) -> tuple[int, int, int]:
    """(cost, node, turns to insert) of the cheapest way from live nodes (cost, rank) to an end."""
    ways = [
        (cost + n * INSERT, rank, n, node)
        for node, (cost, rank) in live.items()
        for n, here in enumerate(_inserts(node))
        if STACKS[here][0] in ACCEPTING
    ]
    cost, _, n, node = min(ways)
    return cost, node, n


def replay(entry: int, audit: str, roles: list[str], texts: list[str]) -> str:
    """The repaired turns, ``role:text`` by line, of rows edited by an audit."""
    lines, here, row = [], entry, 0
    for letter in audit:
        if letter == "D":
            row += 1
            continue
        if letter == "K":
            role, text, shifted = roles[row], texts[row], roles[row][:1]
        else:
            shifted = EDITED[here]
            role, text = ROLES[shifted], "" if letter == "I" else texts[row]
        lines.append(f"{role}:{text}")
        here = MOVE[here][shifted]
        row += letter != "I"
    return "\n".join(lines)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32 of ``conv_id:turn`` does to a row."""
    space = F.lit(" ")
    known = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"),
        (F.crc32(F.concat_ws(":", *known)) % 20).alias("damage"),
    ).where("damage <> 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")


def _place(turn: str = "turn") -> Column:
    return F.struct(F.col(turn).isNotNull().alias("numbered"), F.col(turn).alias("turn"))


def _marked(rows: DataFrame) -> DataFrame:
    """Adds digest, trimmed end and whether an equal row (role, text) stands at an earlier turn."""
    rows = rows.withColumn("digest", F.md5("text"))
    end = F.rtrim("text", F.lit(BLANKS))
    repeats = rows.groupBy("conv_id", "role", "digest").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # written, so that its true size decides whether it is broadcast; where it is not, skewed keys are split
    repeats = publish(repeats.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first"), "repair-repeats")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    return rows.join(repeats, same, "left").select(
        "conv_id", "turn", "role", "text", "digest", F.right(end, F.lit(1)).alias("last"),
        F.coalesce(_place() > F.col("first"), F.lit(False)).alias("again"),
    )


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_WAYS = "array<struct<entry:int,exit:int,cost:bigint,rank:int,audit:string>>"
_RUN = (
    "conv_id long, part int, run int, whole boolean, least long, most long, distinct long, blank long, duplicate long, truncated long, "
    f"illegal long, first string, last string, cost long, audit string, sha string, ways {_WAYS}, roles array<string>, texts array<string>"
)


class _Run:
    """Consecutive rows of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.roles, self.texts, self.kinds, self.chars = conv_id, [], [], [], [], 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, turn, role, text, last, again) -> None:
        fault = "blank" if not last else "duplicate" if again else "truncated" if last not in ".!?" else ""
        if fault:
            self.faults[fault] += 1
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        self.kinds.append(MUST_GO if fault in ("blank", "duplicate") else initial + ("!" if fault else ""))
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def row(self, part: int, number: int, whole: bool) -> dict:
        known = [t for t in self.turns if t is not None]
        initials = [r[:1] for r in self.roles]
        out = {
            "conv_id": self.conv_id, "part": part, "run": number, "whole": whole,
            "least": min(known, default=None), "most": max(known, default=None), "distinct": len(set(known)),
            "illegal": sum(pair not in LEGAL_PAIRS for pair in zip(initials, initials[1:])),
            "first": initials[0], "last": initials[-1], **self.faults,
        }
        if not whole:
            ways = [(e, x, *way) for e in NODES for x, way in parse(self.kinds, e).items()]
            names = ("entry", "exit", "cost", "rank", "audit")
            return {**out, "ways": [dict(zip(names, w)) for w in ways], "roles": self.roles, "texts": self.texts}
        found = parse(self.kinds, 0)
        cost, node, n = finish({x: (c, rank) for x, (c, rank, _) in found.items()})
        audit = found[node][2] + "I" * n
        text = replay(0, audit, self.roles, self.texts)
        return {**out, "cost": cost, "audit": audit, "sha": hashlib.sha256(text.encode()).hexdigest()}


def _runs(run_rows: int, run_chars: int, schema: pa.Schema):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, run, before, opened, out = 0, None, None, True, []

        for batch in batches:
            for conv_id, turn, role, text, digest, last, again in zip(*(c.to_pylist() for c in batch.columns)):
                full = run and (len(run.kinds) >= run_rows or run.chars >= run_chars)
                if run and (full or conv_id != run.conv_id):
                    # a task's first conversation may have begun in the task before; a full run goes on
                    ended = conv_id != run.conv_id
                    out.append(run.row(part, number, whole=ended and not opened))
                    number, opened, run = number + 1, not ended, None
                if run is None:
                    run = _Run(conv_id)
                run.add(turn, role, text, last, again or (conv_id, turn, role, digest) == before)
                before = (conv_id, turn, role, digest)
                if len(out) >= 500 or (out and "texts" in out[-1]):
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if run:
            out.append(run.row(part, number, whole=False))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return pack


_CHOSEN = "conv_id long, part int, run int, entry int, exit int, tail int, " + ", ".join(f"{c} long" for c in _COUNTS)


def _fold(table: pa.Table) -> pa.Table:
    """Picks entry and exit of each run of a conversation, and sums up its counts."""
    runs = sorted(table.to_pylist(), key=lambda r: (r["part"], r["run"]))
    live, back = {0: (0, 0)}, []
    for r in runs:
        best: dict = {}
        for way in r["ways"]:
            if way["entry"] in live:
                cost, rank = live[way["entry"]]
                candidate = (cost + way["cost"], rank, way["rank"], way["entry"])
                best[way["exit"]] = min(best.get(way["exit"], candidate), candidate)
        order = sorted(best, key=lambda x: best[x][1:3])
        live = {x: (best[x][0], n) for n, x in enumerate(order)}
        back.append({x: b[3] for x, b in best.items()})
    cost, here, tail = finish(live)
    totals = {c: sum(r[c] for r in runs) for c in ("blank", "duplicate", "truncated", "illegal")}
    totals["illegal"] += sum((a["last"], b["first"]) not in LEGAL_PAIRS for a, b in zip(runs, runs[1:]))
    known = [r for r in runs if r["least"] is not None]
    shared = sum(a["most"] == b["least"] for a, b in zip(known, known[1:]))
    distinct = sum(r["distinct"] for r in known) - shared
    totals |= {"cost": cost, "gaps": known[-1]["most"] - known[0]["least"] + 1 - distinct if known else 0}
    out = []
    for r, ways in zip(reversed(runs), reversed(back)):
        entry = ways[here]
        ids = {c: r[c] for c in ("conv_id", "part", "run")}
        out.append({**ids, "entry": entry, "exit": here, "tail": tail, **totals})
        here, tail = entry, 0
    columns = {c: pa.array([r[c] for r in out], pa.int32() if c in ("part", "run", "entry", "exit", "tail") else pa.int64()) for c in out[0]}
    return pa.table(columns)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        entries, roles, texts = (batch[c].to_pylist() for c in ("entry", "roles", "texts"))
        audits = [a + "I" * n for a, n in zip(batch["audit"].to_pylist(), batch["tail"].to_pylist())]
        repaired = [replay(*row) for row in zip(entries, audits, roles, texts)]
        names = ["conv_id", "part", "run", *_COUNTS]
        yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(audits, pa.string()), pa.array(repaired, pa.string())], [*names, "audit", "text"])


_FOUND = "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of sorted pieces; of its texts only the running digest is held."""
    row, audit, digest, empty = None, [], None, True
    names = ["conv_id", *_COUNTS]

    def done():
        found = {**row, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
        return pa.RecordBatch.from_arrays([pa.array([v], pa.string() if isinstance(v, str) else pa.int64()) for v in found.values()], list(found))

    for batch in batches:
        for r in batch.to_pylist():
            if row is None or r["conv_id"] != row["conv_id"]:
                if row is not None:
                    yield done()
                row, audit, digest, empty = {n: r[n] for n in names}, [], hashlib.sha256(), True
            audit.append(r["audit"])
            if r["text"]:
                digest.update((r["text"] if empty else "\n" + r["text"]).encode())
                empty = False
    if row is not None:
        yield done()


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and repaired turns of each conversation of rows (conv_id, turn, role, text), none of them null but ids and turns.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    order = ["conv_id", "turn", "role", "digest"]
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], _RUN).schema)
    packed = _marked(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    packed = packed.select("conv_id", "turn", "role", "text", "digest", "last", "again")
    runs = publish(packed.mapInArrow(_runs(RUN_ROWS, RUN_CHARS, schema), _RUN), "repair-runs")
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("distinct"), F.lit(0).cast("long"))
    done = runs.where("whole").select("conv_id", gaps.alias("gaps"), *_COUNTS[1:], "audit", F.col("sha").alias("repaired_sha256"))
    ways = F.transform("ways", lambda w: F.struct(*[w[c].alias(c) for c in ("entry", "exit", "cost", "rank")])).alias("ways")
    rest = runs.where("NOT whole")
    sums = ["conv_id", "part", "run", "least", "most", "distinct", "blank", "duplicate", "truncated", "illegal", "first", "last"]
    chosen = publish(rest.select(*sums, ways).groupBy("conv_id").applyInArrow(_fold, _CHOSEN), "repair-chosen")
    way = F.filter("ways", lambda w: (w["entry"] == F.col("entry")) & (w["exit"] == F.col("exit")))[0]
    pieces = rest.select("part", "run", "ways", "roles", "texts").join(chosen, ["part", "run"])
    pieces = pieces.select("conv_id", "part", "run", *_COUNTS, "entry", "tail", way["audit"].alias("audit"), "roles", "texts")
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    pieces = pieces.mapInArrow(_pieces, f"conv_id long, part int, run int, {counts}, audit string, text string")
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "run")
    return done.unionByName(ordered.mapInArrow(_joined, _FOUND))


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """``repair`` of the damaged rows, for every conversation there was; those without rows have zeros and an empty audit."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = repair(damaged(conversations)).withColumnRenamed("conv_id", "_c")
    zero = F.lit(0).cast("long")
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left").select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in _COUNTS], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


ORACLE = rf"""
WITH RECURSIVE {CRC_TABLE},
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {sql_crc32("(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")} % 20 AS damage
  FROM conversations, crc),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
         CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN damage = 3 THEN 2 ELSE 1 END)) AS time
  FROM hit WHERE damage <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), time) AS i,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM rows_),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
                left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
faults AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND (before || initial NOT IN ('su', 'ua', 'au'))) AS illegal, count(*) AS n
  FROM faults GROUP BY conv_id),
legal(q, role, q2) AS (VALUES ('0', 's', 'S'), ('0', 'u', 'U'), ('S', 'u', 'U'), ('U', 'a', 'P'), ('P', 'u', 'U')),
added AS (  -- up to three inserted turns
  SELECT DISTINCT q AS q0, q, 0 AS n, '' AS names FROM (SELECT q FROM legal UNION ALL SELECT q2 FROM legal)
  UNION ALL
  SELECT q0, q2, n + 1, names || CASE role WHEN 'u' THEN 'user:' ELSE 'assistant:' END || chr(10)
  FROM added JOIN legal USING (q) WHERE role <> 's' AND n < 3),
dp AS (
  SELECT conv_id, 0::bigint AS i, '0' AS q, {{'cost': 0::bigint, 'audit': '', 'lines': ''}} AS best FROM counts
  UNION ALL
  SELECT conv_id, i, q, min(way) FROM (
    SELECT d.conv_id, f.i, l.q2 AS q,
           {{'cost': (best.cost + 2 * a.n + CASE WHEN edit = 'R' THEN 2 ELSE 0 END + CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END)::bigint,
             'audit': best.audit || repeat('I', a.n) || edit,
             'lines': best.lines || a.names || CASE WHEN edit = 'K' THEN f.role WHEN l.role = 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text || chr(10)}} AS way
    FROM dp d JOIN faults f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i + 1 AND f.fault NOT IN ('blank', 'duplicate')
    JOIN added a ON a.q0 = d.q JOIN legal l ON l.q = a.q
    JOIN (VALUES ('K'), ('R')) e(edit) ON (edit = 'K' AND l.role = f.initial) OR (edit = 'R' AND l.role <> 's')
    UNION ALL
    SELECT d.conv_id, f.i, a.q, {{'cost': (best.cost + 2 * a.n + 3)::bigint, 'audit': best.audit || repeat('I', a.n) || 'D', 'lines': best.lines || a.names}}
    FROM dp d JOIN faults f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i + 1 JOIN added a ON a.q0 = d.q)
  GROUP BY conv_id, i, q),
ends AS (
  SELECT d.conv_id, min({{'cost': best.cost + 2 * a.n, 'audit': best.audit || repeat('I', a.n), 'lines': best.lines || a.names}}) AS way
  FROM dp d JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND c.n = d.i JOIN added a ON a.q0 = d.q AND a.q IN ('0', 'P')
  GROUP BY d.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate,
       coalesce(truncated, 0)::bigint AS truncated, coalesce(illegal, 0)::bigint AS illegal, coalesce(way.cost, 0)::bigint AS cost,
       coalesce(way.audit, '') AS audit, sha256(coalesce(left(way.lines, greatest(len(way.lines) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""
