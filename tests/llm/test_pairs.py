"""Near-duplicates, benchmark items, components."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from intertie.llm import components, decontaminate, near_dup
from intertie.llm.queries import op7_near_dup, op8_decontaminate, table

from ..oracle import compare, connect
from .helpers import FOLDER, awkward, documents, rows, scratch, words


def brute_classes(texts, least=0.8):
    named = [(i, t or "") for i, t in texts if i is not None]
    first = {}
    for i, t in named:
        first[t] = min(first.get(t, i), i)
    distinct = sorted(first)
    bags = near_dup.bags(pa.array(distinct, pa.string()))
    parent = {t: t for t in distinct}

    def top(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a in range(len(distinct)):
        for b in range(a):
            if near_dup.similarity(bags[a], bags[b]) >= least:
                x, y = sorted((top(distinct[a]), top(distinct[b])), key=first.get)
                parent[y] = x
    return sorted((i, first[t], first[top(t)]) for i, t in named)


def found(frame):
    return sorted((r.doc_id, r.copy_of, r.class_id) for r in frame.collect() if r.doc_id is not None)


def test_near_dup_query_equals_all_pairs(spark):
    texts = [(r.doc_id, r.text) for r in documents(spark).collect()]
    assert found(op7_near_dup(spark, FOLDER)) == brute_classes(texts)


def planted():
    random.seed(9)
    fresh = lambda n: [f"u{random.randrange(10**6)}" for _ in range(n)]
    root = fresh(200)
    texts = []
    for i in range(60):
        own = list(root)
        for _ in range(random.randrange(0, 9)):
            own[random.randrange(200)] = "edit"
        texts.append((i, " ".join(own)))
    half = fresh(100)
    texts += [(100 + i, " ".join(half + fresh(60))) for i in range(40)]
    return texts + [(500, "x y"), (501, " x  y "), (502, "x y z"), (503, " ".join(["a"] * 400)), (504, " ".join(["a"] * 340))]


def test_planted_groups_and_false_bands(spark):
    """Groups within which not all are alike, bands whose members are not, short and repetitive texts."""
    want = brute_classes(planted())
    assert found(near_dup.classes(rows(spark, planted()), scratch)) == want
    # Short bands bring unlike texts together, in groups beyond the small ones.
    assert found(near_dup.classes(rows(spark, planted()), scratch, size=64, rows=1)) == want


def edited(n: int):
    """A large group of copies edited at random, more or less: many are close to none."""
    rng = random.Random(12)
    root = [f"r{i}" for i in range(150)]
    texts = []
    for i in range(n):
        own = list(root)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 9])):
            own[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        texts.append((i, " ".join(own)))
    return texts


def test_large_group_of_unlike_copies(spark):
    texts = edited(300)
    want = brute_classes(texts)
    assert len({c for _, _, c in want}) > 50
    assert found(near_dup.classes(rows(spark, texts), scratch)) == want


def test_pairs_met_grow_with_the_links(spark):
    """Texts that share half of their words and nothing rarer meet in no pair."""
    texts = edited(200)
    bodies = spark.createDataFrame(texts, "id long, text string")
    nodes = bodies.select(F.col("id").alias("node"), F.col("id").alias("component"))
    got = {(r.a, r.b) for r in near_dup.close_pairs(nodes, bodies, scratch, 0.8).collect()}
    bags = near_dup.bags(pa.array([t for _, t in texts]))
    close = {(a, b) for b in range(200) for a in range(b) if near_dup.similarity(bags[a], bags[b]) >= 0.8}
    assert close <= got


def test_two_texts_under_one_id_and_clashing_columns(spark):
    base = " ".join(f"w{i}" for i in range(60))
    texts = [(5, base), (5, "quite another text of more words"), (6, base), (6, base), (7, base + " end")]
    got = sorted((r.doc_id, r.copy_of, r.class_id) for r in near_dup.classes(rows(spark, texts), scratch).collect())
    assert got == [(5, 5, 5), (5, 5, 5), (6, 5, 5), (6, 5, 5), (7, 7, 5)]
    named = rows(spark, texts).withColumnsRenamed({"ids": "_id", "score": "_digest", "shard": "_text_digest"})
    left = near_dup.one_of_each(named, scratch)
    assert left.columns == named.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted({(5, texts[0][1]), (5, texts[1][1])})


def test_near_dup_awkward_rows(spark):
    frame = near_dup.classes(rows(spark, awkward()), scratch)
    assert found(frame) == brute_classes(awkward())
    assert frame.count() == len(awkward()) and frame.where("doc_id IS NULL AND class_id IS NULL").count() == 1
    assert near_dup.classes(rows(spark, []), scratch).count() == 0
    left = near_dup.one_of_each(rows(spark, awkward()), scratch)
    assert left.columns == rows(spark, []).columns
    assert sorted(r.doc_id or -1 for r in left.collect()) == [-1, 1, 2, 4, 6, 7]


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    off = []
    for r in range(150):
        a = {i: int(rng.integers(1, 20)) for i in range(50)}
        b = {i: c if rng.random() < 0.7 else int(rng.integers(1, 20)) for i, c in a.items()}
        bag = lambda x: (near_dup.mixed(np.array(list(x), np.uint64) + np.uint64(r * 1000)), np.array(list(x.values())))  # noqa: B023, E731
        s = near_dup.signatures([bag(a), bag(b)], 128)
        off.append((s[0] == s[1]).mean() - sum(min(a[i], b[i]) for i in a) / sum(max(a[i], b[i]) for i in a))
    assert abs(np.mean(off)) < 4 * np.std(off) / len(off) ** 0.5


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 130)] + [(129, 200), (7, 7)]
    got = components.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()
    want = {i: 0 for i in range(31)} | {i: 100 for i in [*range(100, 130), 200]}
    assert {r.node: r.component for r in got} == want


def test_decontamination_equals_sql(spark):
    from intertie.llm.registry import load

    status, n, _ = compare(spark, FOLDER, connect(FOLDER), op8_decontaminate, load().sql["op8_decontaminate"])
    assert status == "ok" and n


def similar(a, b):
    k = min(5, len(b))
    x, y = ([tuple(w[i : i + k]) for i in range(len(w) - k + 1)] for w in (a, b))
    shared = sum(min(x.count(s), y.count(s)) for s in set(x))
    return shared / (len(x) + len(y) - shared)


def brute_items(texts, items, least=0.8):
    out = set()
    for i, text in texts:
        own = words(text)
        for item, body in items:
            want = words(body) if item is not None else []
            best = max(
                ((similar(own[s : s + len(want)], want), -s) for s in range(len(own) - len(want) + 1) if want),
                default=(0, 0),
            )
            if best[0] >= least:
                out.add((i, item, round(best[0], 9), -best[1]))
    return out


def test_items_in_awkward_documents(spark):
    random.seed(4)
    fresh = lambda n: [f"v{random.randrange(10**6)}" for _ in range(n)]
    long, short, loop = fresh(40), ["ab", "cd"], ["la", "la", "la", "la", "la", "lo", "la"] * 3
    items = [(1, " ".join(long)), (2, " ".join(short)), (3, " ".join(loop)), (4, None), (5, ""), (6, " ".join(long)), (None, "q r s t u v")]
    texts = awkward() + [
        (20, " ".join(fresh(30) + long + fresh(30))),
        (21, " ".join(fresh(3) + long[2:] + fresh(3))),
        (22, " ".join(long[:20] + ["zz"] + long[20:])),
        (23, " ".join(long[:20])),
        (24, "x ab cd y ab\ncd"),
        (25, " ".join(["la"] * 50 + loop)),
        (26, "p q r s t u v w"),
        (20, " ".join(fresh(5) + long)),
    ]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, score string")
    got = decontaminate.matches(rows(spark, texts), bench, scratch).collect()
    assert {(r.doc_id, r.item_id, round(r.similarity, 9), r.start) for r in got} == brute_items(texts, items)
    assert decontaminate.matches(rows(spark, []), bench, scratch).count() == 0
    assert decontaminate.matches(rows(spark, texts), bench.limit(0), scratch).count() == 0
    left = decontaminate.clean(rows(spark, texts), bench, scratch)
    gone = {i for i, *_ in brute_items(texts, items)}
    assert sorted(r.doc_id or -1 for r in left.collect()) == sorted(i or -1 for i, _ in texts if i not in gone)


def test_no_python_in_decontamination(spark):
    plan = op8_decontaminate(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    assert table(spark, FOLDER, "benchmark").count()
