"""Merkle manifest of a table: a tree of digests for each group of rows, and one over the groups.

The tree of a group is an append log: nodes stand in the order in which they
are completed (postorder), so a log that grows never rewrites what it holds.
Aligned builders each write the nodes above one block of ``fanout ** levels``
consecutive leaves; the tops of the blocks are the leaves of the next round,
until one is left. Where a node stands follows from the sizes of complete
subtrees alone (:func:`place`), so siblings are found without any pointer.

Groups of any size are spread over as many builders as they have blocks; no
builder holds more than one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import globally_ordered, running

PATH = "array<struct<place:int,others:string>>"
SEGMENT = "tree string, block long, n long, height int, top string, nodes binary"
PATH_TYPE = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.string())]))


def digest_of(values: list[Column]) -> Column:
    """SHA-256, in hexadecimal, of the values in turn: ``-`` for null, else UTF-8 length, colon and value."""
    texts = [v.cast("string") for v in values]
    marked = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*marked), 256)


def joined(digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(digests)).hexdigest().encode()


def count_at(level: int, leaves: int, fanout: int) -> int:
    """Nodes of a level of a tree."""
    return -(-leaves // fanout**level)


def height_of(leaves: int, fanout: int) -> int:
    height = 0
    while count_at(height, leaves, fanout) > 1:
        height += 1
    return height


def place(level: int, index: int, leaves: int, height: int, fanout: int) -> int:
    """Where a node stands in the postorder of its tree.

    When it is completed, every level up to its own has all nodes that reach
    its last leaf, and every level above has those that end before its first.
    """
    first = index * fanout**level
    end = min(first + fanout**level, leaves)
    upto = sum(count_at(i, end, fanout) for i in range(level + 1))
    return upto + sum(first // fanout**i for i in range(level + 1, height + 1)) - 1


def raised(leaves: list[bytes], alone: bool, levels: int, fanout: int) -> list[list[bytes]]:
    """Levels of nodes above a block, the leaves first. A block that is a whole tree ends at its root."""
    found = [leaves]
    while (len(found[-1]) > 1) if alone else (len(found) <= levels):
        below = found[-1]
        found.append([joined(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return found


def _segments(nodes: DataFrame, levels: int, fanout: int) -> DataFrame:
    """One segment of the log for each block of (``tree``, ``pos``, ``digest``); only the first block can be a whole tree."""
    width = fanout**levels
    schema = pa.schema(
        [("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("height", pa.int32()), ("top", pa.string()),
         ("nodes", pa.binary())]
    )

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        tree, block = (k.as_py() for k in key)
        order = np.argsort(rows.column("pos").to_numpy())
        leaves = [d.encode() for d in rows.column("digest").take(pa.array(order)).to_pylist()]
        found = raised(leaves, block == 0 and len(leaves) < width, levels, fanout)
        height = len(found) - 1
        log = [b""] * sum(map(len, found))
        for level, digests in enumerate(found):
            for i, digest in enumerate(digests):
                log[place(level, i, len(leaves), height, fanout)] = bytes.fromhex(digest.decode())
        row = [[tree], [block], [len(leaves)], [height], [found[-1][0].decode()], [b"".join(log)]]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

    blocks = nodes.select("tree", "pos", "digest", F.floor(F.col("pos") / width).alias("block"))
    return blocks.groupBy("tree", "block").applyInArrow(write, SEGMENT)


def _rounds(nodes: DataFrame, scratch: Callable, levels: int, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Segments round by round, and the root of every tree (``tree``, ``top``, ``round``)."""
    rounds: list[DataFrame] = []
    roots: DataFrame | None = None
    while True:
        segments = scratch(_segments(nodes, levels, fanout))
        # A tree goes on if it has a second block.
        large = segments.where("block = 1").select("tree")
        ended = segments.join(large, "tree", "left_anti").select("tree", "top", F.lit(len(rounds)).alias("round"))
        roots = ended if roots is None else roots.unionByName(ended)
        rounds.append(segments)
        nodes = segments.join(large, "tree", "left_semi").select(
            "tree", F.col("block").alias("pos"), F.col("top").alias("digest")
        )
        if nodes.isEmpty():
            return rounds, roots


def _positions(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with ``pos``, counted from 0 within each ``tree`` along ``order``."""
    ordered = globally_ordered(rows, ["tree", *order])
    upto = running(ordered, ["tree"], {"_upto": ("count", F.lit(1))})
    return upto.select(*rows.columns, (F.col("_upto") - 1).alias("pos"))


@dataclass
class Manifest:
    """``leaves``: ``tree``, ``pos``, ``id``, ``digest``, ``claimed``; ``rounds`` and ``top_rounds``: segments of the
    logs of the groups and of the tree over them; ``roots``: ``tree``, ``top``, ``round`` and ``pos`` of the groups."""

    leaves: DataFrame
    rounds: list[DataFrame]
    roots: DataFrame
    top_rounds: list[DataFrame]
    levels: int
    fanout: int


def build(
    rows: DataFrame, scratch: Callable, group: Column, key: Column, digest: Column, claimed: Column | None = None,
    levels: int = 3, fanout: int = 8,
) -> Manifest:
    """The manifest of ``rows``: groups by ``group`` (a string), leaves by ``key`` and then ``digest``, nulls first.

    Every ``fanout`` consecutive nodes become the digest of their digests,
    until one is left; a lone leaf is its own root. The roots of the groups,
    by group (null first, then bytewise), are the leaves of the last tree.
    ``claimed`` is the digest that :func:`audit` checks (``digest`` itself by
    default). Repeated rows are leaves of their own; rows of a null key are
    leaves like others. A table without rows has no nodes. Of the rows only
    the named columns are kept, so other columns cannot clash.
    ``scratch(df)`` writes a table to the shared folder and reads it back.
    """
    tree = F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))
    own = rows.select(
        tree.alias("tree"), key.alias("id"), digest.alias("digest"),
        (digest if claimed is None else claimed).alias("claimed"),
    )
    # Digests are taken once; the texts go no further.
    leaves = scratch(_positions(scratch(own), [F.col("id").asc_nulls_first(), "digest", "claimed"]))
    rounds, roots = _rounds(leaves, scratch, levels, fanout)
    named = roots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("top").alias("digest"), "round")
    placed = scratch(_positions(named, ["group"]))
    top_rounds, _ = _rounds(placed, scratch, levels, fanout)
    roots = placed.select(F.col("group").alias("tree"), F.col("digest").alias("top"), "round", "pos")
    return Manifest(leaves, rounds, roots, top_rounds, levels, fanout)


def _local_paths(n: int, height: int, nodes: bytes, fanout: int) -> list[list[tuple[int, str]]]:
    """For every leaf of a segment its place in each run and the run's other digests, level by level."""
    # above[i]: what follows for the nodes of the level in hand, from the top of the segment downwards.
    above: list[list[tuple[int, str]]] = [[]]
    for level in range(height - 1, -1, -1):
        count = count_at(level, n, fanout)
        at = [32 * place(level, i, n, height, fanout) for i in range(count)]
        digests = [nodes[a : a + 32].hex() for a in at]
        found = []
        for i in range(count):
            first = i - i % fanout
            others = "".join(digests[first:i] + digests[i + 1 : first + fanout])
            found.append([(i - first, others), *above[i // fanout]])
        above = found
    return above


def _uppers(segments: DataFrame, uppers: DataFrame) -> DataFrame:
    """(``tree``, ``block``, ``n``, ``height``, ``nodes``, ``path``, ``subroot``, ``root``) of a round."""
    return segments.select("tree", "block", "n", "height", "nodes").join(uppers, ["tree", "block"])


def _expanded(segments: DataFrame, levels: int, fanout: int) -> DataFrame:
    """The path of every leaf of segments that have the path of their top: one row for each leaf."""
    width = fanout**levels
    names = ["tree", "block", "path", "subroot", "root"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rest = [(p["place"], p["others"]) for p in row["path"]]
                paths = [p + rest for p in _local_paths(row["n"], row["height"], row["nodes"], fanout)]
                n = len(paths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["tree"]] * n, pa.string()),
                        pa.array(range(row["block"] * width, row["block"] * width + n), pa.int64()),
                        pa.array([[{"place": a, "others": b} for a, b in p] for p in paths], PATH_TYPE),
                        pa.array([row["subroot"]] * n, pa.string()),
                        pa.array([row["root"]] * n, pa.string()),
                    ],
                    names=names,
                )

    return segments.mapInArrow(work, f"tree string, block long, path {PATH}, subroot string, root string")


def _with_paths(manifest: Manifest, scratch: Callable) -> DataFrame:
    """Segments of the first round, each with the path from its top to the root."""
    levels, fanout = manifest.levels, manifest.fanout
    empty_path = F.array().cast(PATH)
    uppers = manifest.top_rounds[-1].select(
        "tree", "block", empty_path.alias("path"), F.col("top").alias("subroot"), F.col("top").alias("root")
    )
    for segments in reversed(manifest.top_rounds):
        uppers = scratch(_expanded(_uppers(segments, uppers), levels, fanout))
    tops = scratch(
        manifest.roots.join(uppers.select(F.col("block").alias("pos"), "path", "root"), "pos").select(
            "tree", F.lit(0).cast("long").alias("block"), "path", F.col("top").alias("subroot"), "root", "round"
        )
    )
    below: DataFrame | None = None
    for number in range(len(manifest.rounds) - 1, -1, -1):
        uppers = tops.where(F.col("round") == number).drop("round")
        if below is not None:
            uppers = uppers.unionByName(below)
        placed = _uppers(manifest.rounds[number], uppers)
        if number == 0:
            return placed
        below = scratch(_expanded(placed, levels, fanout))
    raise AssertionError("there is a first round")


def _of_leaves(manifest: Manifest, leaves: DataFrame, scratch: Callable, one: Callable, schema: str, arrow) -> DataFrame:
    """Rows that ``one(leaf, path, segment)`` gives for every leaf, blocks of leaves meeting their segment."""
    width, fanout = manifest.fanout**manifest.levels, manifest.fanout
    names = [f.name for f in arrow]

    def work(segment: pa.Table, rows: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return arrow.empty_table()
        own = segment.to_pylist()[0]
        rest = [(p["place"], p["others"]) for p in own["path"]]
        paths = _local_paths(own["n"], own["height"], own["nodes"], fanout)
        first = own["block"] * width
        found = [one(leaf, paths[leaf["pos"] - first] + rest, own) for leaf in rows.to_pylist()]
        return pa.Table.from_arrays(
            [pa.array([f[i] for f in found], arrow.field(i).type) for i in range(len(names))], schema=arrow
        )

    blocks = leaves.withColumn("block", F.floor(F.col("pos") / width))
    segments = _with_paths(manifest, scratch)
    return segments.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(work, schema)


def folded(digest: str, path: list[tuple[int, str]]) -> str:
    """The root that a digest and the others on its path give."""
    for at, others in path:
        digest = hashlib.sha256(f"{others[: 64 * at]}{digest}{others[64 * at :]}".encode()).hexdigest()
    return digest


def proofs(manifest: Manifest, scratch: Callable, wanted: Column | None = None) -> DataFrame:
    """``id``, ``digest``, ``path``, ``subroot`` and ``root`` of the leaves that ``wanted`` keeps (all by default).

    ``path`` holds, level by level from the leaf to the root, the place in the
    run and the other digests of the run, left to right; a node without others
    has an empty string there. ``wanted`` may use ``id``, ``digest``, ``claimed``.
    """
    leaves = manifest.leaves if wanted is None else manifest.leaves.where(wanted)
    id_type = manifest.leaves.schema["id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.schema(
        [("id", to_arrow_type(manifest.leaves.schema["id"].dataType)), ("digest", pa.string()), ("path", PATH_TYPE),
         ("subroot", pa.string()), ("root", pa.string())]
    )

    def one(leaf: dict, path: list, own: dict) -> tuple:
        levels = [{"place": a, "others": b} for a, b in path]
        return leaf["id"], leaf["digest"], levels, own["subroot"], own["root"]

    schema = f"id {id_type}, digest string, path {PATH}, subroot string, root string"
    return _of_leaves(manifest, leaves, scratch, one, schema, arrow)


def audit(manifest: Manifest, scratch: Callable) -> DataFrame:
    """Every leaf checked by its proof: ``id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    ``folded_root`` is what ``claimed`` and the digests on the path give, and
    ``verified`` whether that is the root; ``proof_sha256`` is the SHA-256 of
    those digests, from the leaf's level to the root's.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = manifest.leaves.schema["id"].dataType
    texts = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    arrow = pa.schema([("id", to_arrow_type(kind)), *[(t, pa.string()) for t in texts], ("verified", pa.bool_())])

    def one(leaf: dict, path: list, own: dict) -> tuple:
        proof = hashlib.sha256("".join(others for _, others in path).encode()).hexdigest()
        root = folded(leaf["claimed"], path)
        return leaf["id"], leaf["digest"], own["subroot"], own["root"], proof, root, root == own["root"]

    schema = f"id {kind.simpleString()}, {', '.join(f'{t} string' for t in texts)}, verified boolean"
    return _of_leaves(manifest, manifest.leaves, scratch, one, schema, arrow)


def append_log(manifest: Manifest) -> DataFrame:
    """The logs of the groups: ``tree`` (``0`` for the null group, else ``1`` and its name), ``place``, ``level``, ``index``, ``digest``."""
    levels, fanout = manifest.levels, manifest.fanout
    sizes = manifest.rounds[0].groupBy("tree").agg(F.sum("n").alias("leaves"))

    def work_of(number: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    height = height_of(row["leaves"], fanout)
                    out: list[tuple] = []
                    # The leaves of a later round are in the log already.
                    for level in range(1 if number else 0, row["height"] + 1):
                        for i in range(count_at(level, row["n"], fanout)):
                            at = 32 * place(level, i, row["n"], row["height"], fanout)
                            above = number * levels + level
                            index = row["block"] * fanout ** (levels - level) + i
                            out.append((place(above, index, row["leaves"], height, fanout), above, index,
                                        row["nodes"][at : at + 32].hex()))
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string()]
                    columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["tree"]] * len(out), pa.string()), *columns],
                        names=["tree", "place", "level", "index", "digest"],
                    )

        return work

    parts = [
        segments.join(sizes, "tree").mapInArrow(
            work_of(number), "tree string, place long, level int, index long, digest string"
        )
        for number, segments in enumerate(manifest.rounds)
    ]
    log = parts[0]
    for part in parts[1:]:
        log = log.unionByName(part)
    return log
