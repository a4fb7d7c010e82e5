"""Tries of conversation prefixes against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from intertie.llm import queries, turn_trie
from intertie.llm.queries import op13_turn_trie
from intertie.session import with_package

from ..oracle import compare, connect
from .helpers import FOLDER, scratch

SCHEMA = "conv_id long, turn long, role string, text string, turns string, sizes string, key string, depth string"


def order(r):
    role, text = r[2] or "", r[3] or ""
    digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
    return (r[1] is not None, r[1] or 0, digest)


def conversations(rows):
    found: dict = {}
    for r in sorted(rows, key=order):
        if r[0] is not None:
            found.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return found


def rebuilt(found):
    out = {}
    for c, own in found.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = found.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(found) -> list[tuple]:
    members: dict = {}
    for c, turns in found.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids: dict = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        saved[node] = own + sum(saved[k] for k in kids.get(node, []))
        leaves[node] = sum(leaves[k] for k in kids.get(node, [])) or 1
    out = []
    for node, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(found[c]) == len(node))
        out.append((
            min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(kids.get(node, [])),
            leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def in_order(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_query_equals_plain_trie_and_sql(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    frame = op13_turn_trie(spark, FOLDER)
    assert in_order(frame) == brute(rebuilt(conversations(table)))
    status, _, _ = compare(spark, FOLDER, connect(FOLDER), lambda *_: frame, queries.REGISTRY.sql["op13_turn_trie"])
    assert status == "ok"


def forest(seed: int, n: int = 90):
    """Few distinct turns, so that prefixes branch; a hot conversation, nulls, ties, repeats, a long one."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", None]), rng.choice(["a", "bé", "", None])))
    for c in range(200, 240):
        rows += [(c, 0, "user", "hot"), (c, 1, "x", "same")]
    rows += [(300, None, "user", "first"), (300, 0, "user", "b"), (300, 0, "user", "a"), (300, 0, "user", "a")]
    rows += [(301, t, "user", f"t{t % 3}") for t in range(700)]
    rows += [(None, 0, "user", "nobody")]
    return rows


def run(spark, rows, shuffled=False, **settings):
    with_package(spark)
    frame = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)
    found = turn_trie.sequences(frame, scratch)
    if shuffled:
        own = F.col("conv_id")
        found = turn_trie.rebuilt(found, own - F.pmod(own, F.lit(5)), (F.crc32(own.cast("string")) % 9).cast("int"), 8)
    return in_order(turn_trie.trie(found, scratch, **settings))


@pytest.mark.parametrize("shard_turns, fan_in", [(200_000, 64), (40, 2), (15, 3)])
def test_shards_and_merges(spark, shard_turns, fan_in):
    rows = forest(shard_turns)
    assert run(spark, rows, shard_turns=shard_turns, fan_in=fan_in) == brute(conversations(rows))


def test_rebuilt_conversations(spark):
    rows = forest(3)
    rows = [r for r in rows if r[0] not in (5, 10)]
    assert run(spark, rows, True, shard_turns=60, fan_in=4) == brute(rebuilt(conversations(rows)))


def test_none_and_one(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 0, "a", "b")]) == []
    one = [(7, 0, None, None)]
    assert run(spark, one) == brute(conversations(one))


def test_digests_of_many_members(spark):
    with_package(spark)
    ids = spark.range(1000).select(F.when(F.col("id") < 700, F.lit("hot")).otherwise("rest").cast("binary").alias("key"),
                                   F.col("id").alias("conv_id"))
    got = {bytes(r.key): r.ends for r in turn_trie.member_digests(ids, scratch, run=7).collect()}
    want = lambda r: hashlib.sha256(",".join(map(str, r)).encode()).hexdigest()
    assert got == {b"hot": want(range(700)), b"rest": want(range(700, 1000))}


def test_median_order():
    for n in range(20):
        assert sorted(turn_trie.halves(n)) == list(range(n))
    tree = turn_trie.TernaryTree()
    for i in turn_trie.halves(1023):
        tree.insert([i], [1], 1, i, "")
    node, steps = tree.eq[0], 0
    while tree.turn[node] != 1022:
        node, steps = tree.hi[node], steps + 1
    assert steps == 9
