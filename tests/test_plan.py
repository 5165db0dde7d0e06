import hashlib
import random

import pytest
from conftest import shard_of

from evenkeel.operators import plan


def assignments(spark, rows):
    df = spark.createDataFrame(rows, "ref string, replica_id int, uid string")
    return df.select("ref", "replica_id", shard_of("uid"))


def key(rows):
    last = {}
    for replica, uid in sorted(rows):
        last[uid] = replica
    return ",".join(f"{u}={r}" for u, r in sorted(last.items()))


@pytest.mark.parametrize(
    "text, digest",
    [
        ("", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"),
        ("shard-0=0", "8e4619e0b5c9f6f7cb44f5371f99677164b55af3fe8cf772e7a32cfe57bfa895"),
        ("shard-0=0,shard-1=1", "de1a1aca4a99a7fa3369927c44ab7567da31591cd3b69a1c0a0f5c6e963e4030"),
    ],
)
def test_known_hashes(spark, text, digest):
    if not text:
        assert plan.EMPTY_HASH == digest
        return
    rows = [("r", int(pair.split("=")[1]), pair.split("=")[0]) for pair in text.split(",")]
    row = plan.plan_keys(assignments(spark, rows[::-1])).first()
    assert (row.plan_key, row.plan_hash, row.replicas, row.shards) == (text, digest, len(rows), len(rows))


def test_last_replica_wins_for_a_repeated_uid(spark):
    row = plan.plan_keys(assignments(spark, [("r", 2, "a"), ("r", 0, "a"), ("r", 1, "b")])).first()
    assert row.plan_key == "a=2,b=1"


def test_streamed_hash_equals_the_whole_key(spark):
    rng = random.Random(1)
    rows = [("big", rng.randint(0, 300), f"uid-{i * 7919 % 100003}") for i in range(25_000)]
    rows += [("mid", rng.randint(0, 9), f"m{i}") for i in range(700)] + [("small", 0, "s")]
    want = {
        ref: hashlib.sha256(key([(r, u) for x, r, u in rows if x == ref]).encode()).hexdigest()
        for ref in ("big", "mid", "small")
    }
    table = assignments(spark, rows).repartition(6)
    for limit in (10**6, 500):
        out = {r.ref: r for r in plan.plan_identity(table, max_pairs=limit).collect()}
        assert {ref: r.plan_hash for ref, r in out.items()} == want, limit
        pieces = plan.plan_keys(table, max_pairs=limit).orderBy("ref", "piece").collect()
        assert len({r.plan_hash for r in pieces}) == 3
        for ref in want:
            mine = [r for r in pieces if r.ref == ref]
            assert [r.piece for r in mine] == list(range(len(mine)))
            assert hashlib.sha256(",".join(r.plan_key for r in mine).encode()).hexdigest() == want[ref], (limit, ref)


def test_diff_delta_equal(spark):
    old = assignments(spark, [("r", 0, "a"), ("r", 1, "b"), ("r", 1, "c"), ("q", 0, "x"), ("gone", 0, "z")])
    new = assignments(spark, [("r", 0, "a"), ("r", 0, "b"), ("r", 2, "d"), ("q", 0, "x")])
    diff = {(r.ref, r.uid): (r.change, r.from_replica, r.to_replica) for r in plan.plan_diff(old, new).collect()}
    assert diff == {
        ("r", "b"): ("moved", 1, 0),
        ("r", "c"): ("removed", 1, None),
        ("r", "d"): ("added", None, 2),
        ("gone", "z"): ("removed", 0, None),
    }
    delta = {r.ref: tuple(r)[1:] for r in plan.plan_delta(plan.plan_diff(old, new, changes_only=False)).collect()}
    assert delta == {"r": (1, 1, 1, 1, 1), "q": (0, 0, 0, 1, 0), "gone": (0, 1, 0, 0, -1)}
    assert {r.ref: r.equal for r in plan.plan_equal(old, new).collect()} == {"r": False, "q": True, "gone": False}
