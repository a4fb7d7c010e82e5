"""Top-k search and sharding."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from intertie.llm import sharding, top_k
from intertie.llm.registry import load

from ..oracle import compare, connect
from .helpers import FOLDER, awkward, rows

VECTORS = "vec_id long, embedding array<float>, rank int, score string"


@pytest.mark.parametrize("name", ["op5_top_k", "op9_sharding"])
def test_query_equals_sql(spark, name):
    registry = load()
    status, n, _ = compare(spark, FOLDER, connect(FOLDER), registry.queries[name], registry.sql[name])
    assert status == "ok" and n


def vectors(n=700, width=12):
    random.seed(6)
    out = {i: [random.uniform(-1, 1) for _ in range(width)] for i in range(n)}
    out[60] = list(out[50])
    out[61] = list(out[50])
    return {i: [float(__import__("numpy").float32(x)) for x in v] for i, v in out.items()}


def test_search_equals_brute_force_over_many_blocks(spark):
    held = vectors()
    odd = [(900, None), (901, [1.0, None]), (950, [float("nan")] * 12), (902, [math.inf] * 12), (None, [0.5] * 12)]
    odd += [(903, []), (1000, []), (904, [0.1, 0.2]), (1050, [0.3, 0.4])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in [*held.items(), *odd]], VECTORS)
    good = held | {903: [], 1000: [], 904: [0.1, 0.2], 1050: [0.3, 0.4]}
    want = sorted(top_k.brute_force(good, [i for i in good if i % 50 == 0], 5))
    for blocks in ({}, {"vector_block": 64, "query_block": 5}):
        got = top_k.search(frame, "vec_id % 50 = 0", **blocks)
        assert sorted(map(tuple, got.collect())) == want
    assert top_k.search(frame.limit(0), "vec_id % 50 = 0").count() == 0


def test_fewer_candidates_than_k(spark):
    frame = spark.createDataFrame([(0, [1.0], 1, ""), (1, [2.0], 1, ""), (2, [-1.0], 1, "")], VECTORS)
    got = top_k.search(frame, "vec_id = 0").orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 256 * 512), (0, 2, 2, -256 * 256)]


def test_repeated_rows_are_candidates_each(spark):
    frame = spark.createDataFrame([(0, [1.0], 1, ""), (0, [1.0], 1, ""), (1, [2.0], 1, ""), (1, [2.0], 1, "")], VECTORS)
    assert [r.vec_id for r in top_k.search(frame, "vec_id = 0").collect()] == [1, 1]


def test_table_is_even_and_stable():
    names = [f"s{i}" for i in range(10)]
    before = sharding.fill(names, 1009)
    assert max(Counter(before).values()) - min(Counter(before).values()) <= 1
    after = sharding.fill(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(before, after) if a != 9)
    assert moved < 0.2 * 1009
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill(bad, 7)
    with pytest.raises(ValueError):
        sharding.fill(["a"], 8)


def test_placement_of_awkward_rows(spark):
    docs = rows(spark, awkward())
    placed = sharding.place(docs, "doc_id", ["a", "b", "c"], 101)
    assert placed.count() == len(awkward()) and placed.columns.count("shard") == 1
    assert len({r.shard for r in placed.where("doc_id = 5").collect()}) == 1
    assert sharding.place(docs.limit(0), "doc_id", ["a"], 2).count() == 0
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "SortMergeJoin" not in plan
