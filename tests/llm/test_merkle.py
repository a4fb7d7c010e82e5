"""Merkle manifests against a plain tree."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from intertie.llm import merkle, queries
from intertie.llm.queries import op12_merkle

from ..oracle import compare, connect
from .helpers import FOLDER, awkward, documents, rows, scratch

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_of(nodes: list[str], fanout=8) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return levels


def siblings(levels: list[list[str]], at: int, fanout=8) -> list[tuple[int, str]]:
    out = []
    for level in levels[:-1]:
        first = at - at % fanout
        run = level[first : first + fanout]
        out.append((at - first, "".join(run[: at - first] + run[at - first + 1 :])))
        at //= fanout
    return out


def brute(table: list[dict], fanout=8) -> list[tuple]:
    groups: dict = {}
    for r in table:
        leaf = leaf_of([r[f] for f in FIELDS])
        small = r["text"] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
        third = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        claimed = leaf_of([*[r[f] for f in FIELDS[:-1]], small]) if third else leaf
        groups.setdefault(r["lang"], []).append((r["doc_id"], leaf, claimed))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        trees[g] = tree_of([x[1] for x in groups[g]], fanout)
    top = tree_of([trees[g][-1][0] for g in order], fanout)
    out = []
    for number, g in enumerate(order):
        for i, (doc_id, leaf, claimed) in enumerate(groups[g]):
            path = siblings(trees[g], i, fanout) + siblings(top, number, fanout)
            root = claimed
            for at, others in path:
                root = sha(others[: 64 * at] + root + others[64 * at :])
            proof = sha("".join(o for _, o in path))
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], proof, root, root == top[-1][0]))
    return sorted(out, key=repr)


def audited(docs, levels, fanout):
    plain = [F.col(c) for c in FIELDS]
    leaf = merkle.digest_of(plain)
    changed = merkle.digest_of([*plain[:-1], F.translate("text", queries.CAPITALS, queries.SMALL)])
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle.build(
        docs, scratch, F.col("lang"), F.col("doc_id"), leaf, F.when(third, changed).otherwise(leaf), levels, fanout
    )


def in_order(frame) -> list[tuple]:
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_query_equals_plain_tree_and_sql(spark):
    table = [r.asDict() for r in documents(spark).collect()]
    frame = op12_merkle(spark, FOLDER)
    assert in_order(frame) == brute(table)
    status, _, _ = compare(spark, FOLDER, connect(FOLDER), lambda *_: frame, queries.REGISTRY.sql["op12_merkle"])
    assert status == "ok"


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos string, path string"


def many(n: int):
    """A hot group, a null one, a lone one, one of exactly a block, repeated rows, null and equal ids."""
    langs = ["hot"] * 5 + [None, "ä", "b"]
    out = [(i, "s" if i % 3 else None, langs[i % 8], i % 7 or None, f"Text {i}" if i % 5 else None) for i in range(n)]
    out += [(7, "s", "lone", 1, "L"), (5, "s", "hot", 1, "Other"), (5, "s", "hot", 1, "Other"), (None, "s", "hot", 2, "N")]
    out += [(1000 + i, "s", "block", 1, "X") for i in range(9)]
    return [(*r, "x", "y", "z") for r in out]


@pytest.mark.parametrize("levels, fanout, n", [(1, 3, 160), (2, 3, 200), (1, 2, 40), (3, 8, 60)])
def test_rounds(spark, levels, fanout, n):
    docs = spark.createDataFrame(many(n), SCHEMA)
    manifest = audited(docs, levels, fanout)
    table = [r.asDict() for r in docs.collect()]
    assert in_order(merkle.audit(manifest, scratch)) == brute(table, fanout)
    # The log of a group is its postorder.
    log: dict = {}
    for r in merkle.append_log(manifest).collect():
        log.setdefault(r.tree, []).append((r.place, r.level, r["index"], r.digest))
    groups: dict = {}
    for r in manifest.leaves.collect():
        groups.setdefault(r.tree, []).append((r.pos, r.digest))
    assert set(log) == set(groups)
    for tree, leaves in groups.items():
        nodes = tree_of([d for _, d in sorted(leaves)], fanout)
        out: list = []

        def visit(level, index):
            if level:
                for child in range(index * fanout, min((index + 1) * fanout, len(nodes[level - 1]))):
                    visit(level - 1, child)
            out.append((len(out), level, index, nodes[level][index]))

        visit(len(nodes) - 1, 0)
        assert sorted(log[tree]) == out


def test_proofs_of_chosen_leaves(spark):
    docs = spark.createDataFrame(many(100), SCHEMA)
    manifest = audited(docs, 1, 3)
    got = merkle.proofs(manifest, scratch, F.col("id") % 10 == 0).collect()
    assert {r.id for r in got} == {*range(0, 100, 10), 1000}
    for r in got:
        path = [(p.place, p.others) for p in r.path]
        assert merkle.folded(r.digest, path) == r.root
        assert path[0][1] == "" or merkle.folded(r.digest[::-1], path) != r.root


def test_awkward_rows(spark):
    docs = rows(spark, awkward())
    table = [r.asDict() for r in docs.collect()]
    assert in_order(merkle.audit(audited(docs, 3, 8), scratch)) == brute(table)
    empty = audited(docs.where("false"), 3, 8)
    assert merkle.audit(empty, scratch).collect() == [] and merkle.append_log(empty).collect() == []


def test_place():
    for leaves in range(1, 40):
        height = merkle.height_of(leaves, 3)
        found = [merkle.place(l, i, leaves, height, 3) for l in range(height + 1) for i in range(merkle.count_at(l, leaves, 3))]
        assert sorted(found) == list(range(len(found)))
