"""Trie of conversation prefixes, built shard by shard from ternary search trees.

Turns become integers by a dictionary, conversations become sequences of them,
and equal sequences one row with a count. The distinct sequences are dealt in
lexicographic ranges over shards, so a shard holds whole subtrees; only nodes
on the path of its first and of its last sequence can go on in a neighbour.

Within a shard the sequences go into a ternary search tree, the middle one
first, then the middles of both halves and so on, which keeps the search among
siblings balanced. Children are always made after their parent, so one pass in
reverse order sums members, leaves and savings.

Boundary nodes of neighbouring shards are merged some shards at a time until
one group is left. What lies off the outer paths of a group is final.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE_SHA = hashlib.sha256(b"").hexdigest()

#: A node as shards and merges pass it on. ``conv_id`` is its smallest member; ``kids``, ``leaves`` and ``saved`` of an
#: open node count what hangs below it and is final already. ``first``, ``last``: it lies on that path of its shard.
NODE = pa.schema(
    [
        ("shard", pa.int64()), ("open", pa.bool_()), ("key", pa.binary()), ("parent_key", pa.binary()),
        ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("depth", pa.int64()), ("n_convs", pa.int64()),
        ("kids", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("bytes", pa.int64()), ("ends", pa.string()),
        ("first", pa.bool_()), ("last", pa.bool_()),
    ]
)
NODE_DDL = (
    "shard long, open boolean, key binary, parent_key binary, conv_id long, parent_conv_id long, depth long, n_convs long, "
    "kids long, leaves long, saved long, bytes long, ends string, first boolean, last boolean"
)
ROOT_KEY = hashlib.blake2b(b"", digest_size=16).digest()


def child_key(parent: bytes, turn: int) -> bytes:
    """Name of a prefix: a digest of its turns, one after another."""
    return hashlib.blake2b(parent + int(turn).to_bytes(8, "little", signed=True), digest_size=16).digest()


def halves(n: int) -> Iterator[int]:
    """0 to n - 1, every range's middle before its halves."""
    waiting = [(0, n)]
    while waiting:
        low, high = waiting.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            waiting += [(middle + 1, high), (low, middle)]


class TernaryTree:
    """Sequences of integers. Node 0 is the empty prefix; ``eq`` leads to the first tested child, ``lo`` and ``hi`` to siblings."""

    def __init__(self) -> None:
        self.turn, self.parent, self.depth, self.size = [0], [-1], [0], [0]
        self.lo, self.eq, self.hi = [-1], [-1], [-1]
        self.members, self.least = [0], [None]
        self.ends: dict[int, str] = {}

    def _new(self, turn: int, size: int, parent: int) -> int:
        self.turn.append(turn)
        self.size.append(size)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        for links in (self.lo, self.eq, self.hi):
            links.append(-1)
        self.members.append(0)
        self.least.append(None)
        return len(self.turn) - 1

    def path(self, turns: list[int]) -> list[int]:
        """Nodes of a sequence that is in the tree, the root first."""
        found = [0]
        for turn in turns:
            node = self.eq[found[-1]]
            while self.turn[node] != turn:
                node = self.lo[node] if turn < self.turn[node] else self.hi[node]
            found.append(node)
        return found

    def insert(self, turns: list[int], sizes: list[int], members: int, least: int, ends: str) -> None:
        turn_of, lo, eq, hi = self.turn, self.lo, self.eq, self.hi
        parent = 0
        self._count(0, members, least)
        for turn, size in zip(turns, sizes):
            node = eq[parent]
            if node < 0:
                node = eq[parent] = self._new(turn, size, parent)
            while turn_of[node] != turn:
                links = lo if turn < turn_of[node] else hi
                if links[node] < 0:
                    links[node] = self._new(turn, size, parent)
                node = links[node]
            self._count(node, members, least)
            parent = node
        self.ends[parent] = ends

    def _count(self, node: int, members: int, least: int) -> None:
        self.members[node] += members
        known = self.least[node]
        if known is None or least < known:
            self.least[node] = least


def shard_nodes(shard: int, sequences: list[tuple[list[int], list[int], int, int, str]]) -> list[tuple]:
    """Nodes of a shard's sequences (turns, sizes, members, smallest member, digest of members), sorted by turns."""
    tree = TernaryTree()
    for i in halves(len(sequences)):
        tree.insert(*sequences[i])
    first, last = tree.path(sequences[0][0]), tree.path(sequences[-1][0])
    is_first, is_last = set(first), set(last)
    open_nodes = is_first | is_last
    keys = {0: ROOT_KEY}
    for path in (first, last):
        for above, node in zip(path, path[1:]):
            if node not in keys:
                keys[node] = child_key(keys[above], tree.turn[node])
    n = len(tree.turn)
    kids, leaves, saved = [0] * n, [0] * n, [0] * n
    for node in range(n - 1, -1, -1):
        if node in open_nodes:
            continue
        if not kids[node]:
            leaves[node] = 1
        saved[node] += (tree.members[node] - 1) * tree.size[node]
        above = tree.parent[node]
        kids[above] += 1
        leaves[above] += leaves[node]
        saved[above] += saved[node]
    out = []
    for node in range(n):
        above = tree.parent[node]
        is_open = node in open_nodes
        # A final node below an open one learns its parent's smallest member later.
        waits = above >= 0 and above in open_nodes
        out.append((
            shard, is_open, keys.get(node), keys.get(above) if waits or is_open else None, tree.least[node],
            None if waits or above < 0 else tree.least[above], tree.depth[node], tree.members[node], kids[node],
            leaves[node], saved[node], tree.size[node], tree.ends.get(node), node in is_first, node in is_last,
        ))
    return out


def merged_nodes(group: int, rows: list[dict]) -> list[tuple]:
    """Open nodes of neighbouring shards as one shard's: those off its outer paths become final."""
    low, high = min(r["shard"] for r in rows), max(r["shard"] for r in rows)
    nodes: dict[bytes, dict] = {}
    for r in rows:
        node = nodes.get(r["key"])
        is_first, is_last = r["first"] and r["shard"] == low, r["last"] and r["shard"] == high
        if node is None:
            nodes[r["key"]] = {**r, "first": is_first, "last": is_last}
            continue
        for name in ("n_convs", "kids", "leaves", "saved"):
            node[name] += r[name]
        node["conv_id"] = min(node["conv_id"], r["conv_id"])
        node["ends"] = node["ends"] or r["ends"]
        node["first"] |= is_first
        node["last"] |= is_last
    for node in sorted(nodes.values(), key=lambda x: -x["depth"]):
        node["open"] = node["first"] or node["last"]
        if node["open"]:
            continue
        if not node["kids"]:
            node["leaves"] = 1
        node["saved"] += (node["n_convs"] - 1) * node["bytes"]
        above = nodes[node["parent_key"]]
        above["kids"] += 1
        above["leaves"] += node["leaves"]
        above["saved"] += node["saved"]
    names = NODE.names
    return [tuple({**node, "shard": group}[name] for name in names) for node in nodes.values()]


def closed_nodes(rows: list[tuple]) -> list[tuple]:
    """The nodes of the last group, none of them open any more."""
    names = NODE.names
    nodes = [dict(zip(names, r)) for r in rows]
    by_key = {x["key"]: x for x in nodes}
    for node in sorted(nodes, key=lambda x: -x["depth"]):
        if not node["open"]:
            continue
        node["open"] = False
        if not node["kids"]:
            node["leaves"] = 1
        node["saved"] += (node["n_convs"] - 1) * node["bytes"]
        above = by_key.get(node["parent_key"])
        if above is not None:
            above["kids"] += 1
            above["leaves"] += node["leaves"]
            above["saved"] += node["saved"]
    return [tuple(x[name] for name in names) for x in nodes]


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in NODE]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, NODE)], schema=NODE)


def sequences(turns: DataFrame, scratch: Callable) -> DataFrame:
    """(``conv_id``, ``turns``, ``sizes``): ids of a conversation's turns in order and the bytes of their texts.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and ``text``. Turns of equal
    number are ordered by a digest of role and text; null numbers come first.
    Rows without ``conv_id`` are in no conversation. Texts are read once and
    not shuffled.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    marked = scratch(
        turns.where("conv_id IS NOT NULL").select(
            F.col("conv_id").cast("long").alias("conv_id"), "turn",
            F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
            F.octet_length(text).cast("long").alias("size"),
        )
    )
    # The dictionary: one number for each distinct turn, fixed by writing it.
    dictionary = scratch(
        marked.groupBy("digest").agg(F.max("size").alias("size")).withColumn("id", F.monotonically_increasing_id())
    )
    coded = marked.select("conv_id", "turn", "digest").join(dictionary, "digest")
    own = F.sort_array(F.collect_list(F.struct(
        F.col("turn").isNotNull().alias("known"), "turn", "digest", "id", "size"
    )))
    # A conversation is held by one task, at some 50 bytes a turn.
    return coded.groupBy("conv_id").agg(own.alias("own")).select(
        "conv_id", F.col("own.id").alias("turns"), F.col("own.size").alias("sizes")
    )


def rebuilt(found: DataFrame, source: Column, head: Column, most: int) -> DataFrame:
    """Sequences whose first ``head`` turns (at most ``most``) are those of conversation ``source``.

    Both are computed from ``conv_id``. A source that is absent gives no turns,
    a short one all it has; the conversation's own turns after its first
    ``head`` follow.
    """
    heads = found.select(
        F.col("conv_id").alias("_source"), F.slice("turns", 1, most).alias("_turns"), F.slice("sizes", 1, most).alias("_sizes")
    )
    with_head = found.withColumns({"_wanted": source, "_head": head}).join(
        heads, F.col("_wanted") == F.col("_source"), "left"
    )

    def both(own: str, first: str) -> Column:
        taken = F.coalesce(F.slice(first, F.lit(1), F.col("_head")), F.array().cast("array<long>"))
        return F.concat(taken, F.slice(own, F.col("_head") + 1, F.size(own)))

    return with_head.select(
        "conv_id", both("turns", "_turns").alias("turns"), both("sizes", "_sizes").alias("sizes")
    )


def _key() -> Column:
    return F.unhex(F.md5(F.array_join(F.col("turns").cast("array<string>"), ",")))


def member_digests(members: DataFrame, scratch: Callable, run: int = 4096) -> DataFrame:
    """(``key``, ``ends``): SHA-256 of the ascending ``conv_id`` of each ``key``, joined by commas.

    The ids are sorted by range and joined ``run`` at a time, so a key of any
    size is spread over tasks; one task then reads the short texts of a key in
    turn, holding one at a time.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found), (pa.binary(), pa.int64(), pa.string()))],
                names=["key", "first_id", "ids"],
            )

        key, ids, done = None, [], []
        for batch in batches:
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (k != key or len(ids) == run):
                    done.append((key, ids[0], ",".join(map(str, ids))))
                    ids = []
                    if len(done) == 2000:
                        yield rows(done)
                        done = []
                key = k
                ids.append(i)
        if ids:
            done.append((key, ids[0], ",".join(map(str, ids))))
        if done:
            yield rows(done)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, shas = [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k == key:
                    state.update(b"," + text.encode())
                    continue
                if state is not None:
                    keys.append(key)
                    shas.append(state.hexdigest())
                key, state = k, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shas, pa.string())], names=["key", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends"]
            )

    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = members.select("key", "conv_id").repartitionByRange(tasks, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    texts = scratch(ordered.mapInArrow(runs, "key binary, first_id long, ids string"))
    together = texts.repartition(tasks, "key").sortWithinPartitions("key", "first_id").select("key", "ids")
    return together.mapInArrow(digests, "key binary, ends string")


def trie(found: DataFrame, scratch: Callable, shard_turns: int = 200_000, fan_in: int = 64) -> DataFrame:
    """All nodes of the trie of ``found`` (``conv_id``, ``turns``, ``sizes``), the root included.

    ``conv_id`` is a node's smallest member, ``depth`` its number of turns,
    ``parent_conv_id`` the parent's smallest member (null for the root),
    ``n_convs`` its members, ``n_children`` and ``n_leaves`` its children and
    the childless nodes of its subtree (itself if it has none), ``saved_tokens``
    the sum over its subtree of (members - 1) times the bytes of the last
    turn's text, ``ends_sha256`` the SHA-256 of the ids of members that end
    there, ascending and joined by commas. A conversation without turns is a
    member of the root; no conversations give no nodes. ``conv_id`` is unique.
    About ``shard_turns`` turns go to a shard, and a sequence to one shard as a
    whole.
    """
    members = scratch(found.select("conv_id", "turns", "sizes", _key().alias("key")))
    ends = member_digests(members, scratch)
    distinct = members.groupBy("key", "turns", "sizes").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    distinct = scratch(distinct.join(ends, "key").select("turns", "sizes", "n", "least", "ends"))
    total = distinct.agg(F.sum(F.size("turns") + 1)).first()[0]
    shards = max(1, -(-(total or 0) // shard_turns))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = [], 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            shard = columns[0][0] if columns[0] else shard
            own += zip(*columns[1:])
        if own:
            yield from _table(shard_nodes(shard, own)).to_batches(50_000)

    dealt = distinct.repartitionByRange(shards, "turns").sortWithinPartitions("turns")
    nodes = scratch(
        dealt.select(F.spark_partition_id().cast("long").alias("shard"), "turns", "sizes", "n", "least", "ends")
        .mapInArrow(build, NODE_DDL)
    )
    inner, waiting = nodes.where("NOT open"), nodes.where("open")
    first_open = waiting
    final: DataFrame | None = None
    while True:
        rest = waiting.agg(F.count_distinct("shard").alias("n")).first()["n"]
        if rest == 0:
            break
        alone = rest <= fan_in

        merge = _merge(alone)
        group = F.lit(0) if alone else F.floor(F.col("shard") / fan_in)
        merged = scratch(waiting.withColumn("group", group.cast("long")).groupBy("group").applyInArrow(merge, NODE_DDL))
        ended = merged.where("NOT open")
        final = ended if final is None else final.unionByName(ended)
        if alone:
            break
        waiting = merged.where("open")
    if final is None:
        return _named(inner)
    final = scratch(final)
    # Smallest members of open nodes, for their children: by shard for what was final within it, by key for the others.
    least = final.select(F.col("key").alias("_key"), F.col("conv_id").alias("_least"))
    of_shard = first_open.select(F.col("shard").alias("_shard"), F.col("key").alias("_open")).join(
        least, F.col("_open") == F.col("_key")
    ).select("_shard", "_open", "_least")
    settled = inner.where("parent_key IS NULL")
    hanging = inner.where("parent_key IS NOT NULL").join(
        of_shard, (F.col("shard") == F.col("_shard")) & (F.col("parent_key") == F.col("_open"))
    ).withColumn("parent_conv_id", F.col("_least")).drop("_shard", "_open", "_least")
    root = final.where("depth = 0")
    below = final.where("depth > 0").join(least, F.col("parent_key") == F.col("_key")).withColumn(
        "parent_conv_id", F.col("_least")
    ).drop("_key", "_least")
    return _named(settled.unionByName(hanging).unionByName(root).unionByName(below))


def _merge(alone: bool) -> Callable:
    """Merge of one group of shards; ``alone``: it is the last group, so no node stays open."""

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        found = merged_nodes(key[0].as_py(), rows.drop_columns(["group"]).to_pylist())
        return _table(closed_nodes(found) if alone else found)

    return merge


def _named(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NONE_SHA)).alias("ends_sha256"),
    )
