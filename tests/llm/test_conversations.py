"""The trie of conversations and their repair, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evenkeel.llm import list_ranking, prefix_trie, role_repair

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, key long, depth string"


def plain_trie(rows):
    """Every node by comparing whole prefixes."""
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            text = text or ""
            turns[c].append(((turn is not None, turn or 0, role or "", hashlib.md5(text.encode()).hexdigest()), (role or "", text)))
    own = {c: [t for _, t in sorted(found)] for c, found in turns.items()}
    members = defaultdict(list)
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    out = []
    for prefix, convs in members.items():
        under = [p for p in members if p[: len(prefix)] == prefix]
        leaves = [p for p in under if not any(q[:-1] == p for q in members if q)]
        saved = sum((len(members[p]) - 1) * len(WORDS.findall(p[-1][1])) for p in under if p)
        ended = ",".join(str(c) for c in sorted(convs) if whole[c] == prefix)
        out.append(
            (min(convs), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(convs),
             sum(1 for q in members if q and q[:-1] == prefix), len(leaves), saved, hashlib.sha256(ended.encode()).hexdigest())
        )
    return Counter(out)


def some_conversations(seed, convs=60):
    rng = random.Random(seed)
    rows = []
    for c in range(-25, convs - 25):
        for turn in range(rng.randint(0, 5) if c != 7 else 40):
            text = rng.choice(["a b", "c", "", None, "d\x0be f", "é g h"])
            rows.append((rng.choice([c] * 9 + [None]), rng.choice([turn] * 8 + [None]), rng.choice(["user", "assistant", None]), text, 1, "x"))
    rows += rng.sample(rows, 10)
    rows += [(c, 0, "user", "same start here", 1, "x") for c in range(200, 260)]
    return rows


@pytest.mark.parametrize("group_rows,walk_rows", [(1 << 20, 1 << 20), (3, 16)])
def test_trie_is_that_of_whole_prefixes(spark, monkeypatch, group_rows, walk_rows):
    monkeypatch.setattr(prefix_trie, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(prefix_trie, "RUN_ROWS", 8)
    monkeypatch.setattr(list_ranking, "WALK_ROWS", walk_rows)
    rows = some_conversations(group_rows)
    found = Counter(map(tuple, prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert found == plain_trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", 1, ""), (None, 0, "user", "y", 1, "")], SCHEMA)
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0
    assert prefix_trie.prefix_trie(df.where("conv_id IS NULL")).count() == 0
    # conversation 1 loses its only turn where h > 0 and conversation 0 is absent
    rows = [(c, 0, "user", "x", 1, "") for c in (1, 2, 3, 4)]
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(map(tuple, found)) == plain_trie(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 500])
def test_positions_in_a_list(spark, monkeypatch, n):
    monkeypatch.setattr(list_ranking, "WALK_ROWS", 20)
    keys = [(k * 7919 % 1009, k) for k in range(n)]
    rows = [(*key, *(keys[k + 1] if k + 1 < n else (None, None))) for k, key in enumerate(keys)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "major long, minor long, next_major long, next_minor long")
    found = {(r.major, r.minor): r.at for r in list_ranking.positions(df).collect()}
    assert found == {key: k for k, key in enumerate(keys)}


def plain_damage(rows):
    """conv_id: rows (turn, role, text) after the damage, in order."""
    out = {}
    for c, turn, role, text, *_ in rows:
        kept = out.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = ":".join(" " if x is None else str(x) for x in (c, turn))
        damage = zlib.crc32(key.encode()) % 20
        if damage == 0:
            continue
        text = "" if damage == 1 else re.sub("[.!?]", "", text) if damage == 2 else text
        kept += [(turn, "user" if damage == 4 else role, text)] * (2 if damage == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())
    return {c: sorted(kept, key=order) for c, kept in out.items()}


def plain_repair(rows):
    """Every sequence of edits, cheapest first, then by its letters."""
    turns = [t for t, _, _ in rows if t is not None]
    counts = {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": 0, "duplicate": 0, "truncated": 0}
    faults, seen = [], set()
    for _, role, text in rows:
        kept = text.rstrip(" \t\n\x0b\f\r")
        fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        if fault:
            counts[fault] += 1
    illegal = sum((a[1][:1], b[1][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(rows, rows[1:]))
    # cheapest completed sequences, searched in the order of (cost, audit); no more than two turns are ever worth inserting at once
    best, stack = None, [(0, 0, "", "", (), 0)]
    while stack:
        row, cost, audit, initials, lines, added = stack.pop()
        if best and cost > best[0] or not re.fullmatch("s?(ua)*u?", initials):
            continue
        if row == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            best = min(best or (cost, audit, lines), (cost, audit, lines))
        if added < 3:
            for role in ("user", "assistant"):
                stack.append((row, cost + 2, audit + "I", initials + role[0], (*lines, f"{role}:"), added + 1))
        if row < len(rows):
            _, role, text = rows[row]
            stack.append((row + 1, cost + 3, audit + "D", initials, lines, 0))
            if faults[row] not in ("blank", "duplicate"):
                more = cost + (faults[row] == "truncated")
                for other in ("user", "assistant"):
                    stack.append((row + 1, more + 2, audit + "R", initials + other[0], (*lines, f"{other}:{text}"), 0))
                if role[:1] in tuple("sua"):
                    stack.append((row + 1, more, audit + "K", initials + role[:1], (*lines, f"{role}:{text}"), 0))
    cost, audit, lines = best
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (*counts.values(), illegal, cost, audit, digest)


def broken_conversations(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(-3, convs):
        for turn in range(rng.randint(0, longest)):
            role = rng.choice(["user"] * 4 + ["assistant"] * 4 + ["system", "s", "", None, "tool", "Unknown", "u"])
            text = rng.choice(["Yes.", "no", "Why?\n", "", " \t", None, "é!", "a ", "x" * 50 + "."])
            rows.append((rng.choice([c] * 20 + [None]), rng.choice([turn] * 9 + [None, turn + 3]), role, text, 1, "x"))
    return rows + rng.sample(rows, min(3, len(rows)))


@pytest.mark.parametrize("run_rows", [2000, 2])
def test_repairs_are_the_cheapest(spark, monkeypatch, run_rows):
    monkeypatch.setattr(role_repair, "RUN_ROWS", run_rows)
    rows = [r for r in broken_conversations(run_rows, 120, 6) if r[0] is not None]
    rows += [(None, 0, "user", "No id", 1, "x"), (None, 1, None, None, 1, "x"), (None, None, "assistant", "Hm?", 1, "")]
    rows.append((next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0), 0, "user", "Gone.", 1, "x"))
    wanted = Counter((c, *plain_repair(found)) for c, found in plain_damage(rows).items())
    assert any(not found for found in plain_damage(rows).values())
    found = Counter(map(tuple, role_repair.damage_and_repair(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert found == wanted


def test_runs_of_a_long_conversation_fold_to_the_whole(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice("ab") + rng.choice([".", ""]) + " " * (t % 97), 1, "x")
            for c, n in ((1, 3000), (2, 5)) for t in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = Counter(map(tuple, role_repair.damage_and_repair(df).collect()))
    monkeypatch.setattr(role_repair, "RUN_ROWS", 70)
    assert Counter(map(tuple, role_repair.damage_and_repair(df).collect())) == whole
    monkeypatch.setattr(role_repair, "RUN_ROWS", 10**9)
    monkeypatch.setattr(role_repair, "RUN_CHARS", 1000)
    assert Counter(map(tuple, role_repair.damage_and_repair(df).collect())) == whole
    assert role_repair.damage_and_repair(df.limit(0)).count() == 0
