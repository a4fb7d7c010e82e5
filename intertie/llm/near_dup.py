"""Near-duplicate documents by BagMinHash signatures, banding and exact comparison.

A text is a bag of shingles: runs of five words with their counts. For every
shingle, points arrive by a Poisson process over its weights, cut into the
intervals 0-1, 1-2, 2-4, 4-8 and so on; a point in an interval that the count
covers in part counts if its place lies below the count. Each point goes to a
random component of the signature, which keeps its earliest. Two texts share a
component with the probability of their weighted Jaccard similarity. Points are
made in order of time and only until the latest component is settled, so long
texts cost hardly more than one point a shingle.

Signatures are cut into bands; texts that share a band are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .components import components
from .word_hashes import grams, hashed_words, mixed

SHINGLE = 5


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their counts; a text of fewer words is one shingle, a text of none has none."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(grams(words, min(SHINGLE, len(words))), return_counts=True)


def bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    words, counts = hashed_words(texts)
    ends = np.cumsum(counts)
    return [shingles(words[start:end]) for start, end in zip(ends - counts, ends)]


def signatures(texts: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """BagMinHash signatures, ``size`` (a power of two) times of arrival for each bag; infinite for an empty bag."""
    if size & (size - 1):
        raise ValueError("the size of a signature is a power of two")
    least = np.full(len(texts) * size, np.inf)
    lengths = [len(s) for s, _ in texts]
    bag = np.repeat(np.arange(len(texts)), lengths)
    item = np.concatenate([s for s, _ in texts]) if texts else np.zeros(0, np.uint64)
    count = np.concatenate([c for _, c in texts]) if texts else np.zeros(0, np.int64)
    # One process for each interval that a count reaches into; interval 0 is 0-1, interval j is 2**(j-1) to 2**j.
    reach = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1
    level = np.concatenate([np.arange(r) for r in reach.tolist()]) if reach.max(initial=1) > 1 else np.zeros(len(item), np.int64)
    bag, item, count = np.repeat(bag, reach), np.repeat(item, reach), np.repeat(count, reach)
    seed = mixed(item ^ mixed(level.astype(np.uint64) + np.uint64(1)))
    width = np.where(level > 0, 1 << np.maximum(level - 1, 0), 1)
    low = np.where(level > 0, width, 0)
    time = np.zeros(len(item))
    turn = 0
    while len(item):
        turn += 1
        random = mixed(seed + np.uint64(turn * 0xD1342543DE82EF95 % (1 << 64)))
        time = time - np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        second = mixed(random)
        part = (second & np.uint64(size - 1)).astype(np.int64)
        covered = low + width <= count
        if not covered.all():
            # The place within the interval is uniform, as halving it again and again would give.
            place = low + ((second >> np.uint64(11)).astype(np.float64) * 2.0**-53 * width).astype(np.int64)
            counts = covered | (place < count)
            np.minimum.at(least, bag[counts] * size + part[counts], time[counts])
        else:
            np.minimum.at(least, bag * size + part, time)
        settled = least.reshape(-1, size).max(axis=1)
        going = time < settled[bag]
        bag, seed, count, width, low, time, item = (x[going] for x in (bag, seed, count, width, low, time, item))
    return least.reshape(-1, size)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One key for each band of each signature."""
    rows = signature.shape[1] // bands
    parts = signature.view(np.uint64)[:, : bands * rows].reshape(len(signature), bands, rows)
    key = np.tile(mixed(np.arange(1, bands + 1, dtype=np.uint64)), (len(signature), 1))
    for i in range(parts.shape[2]):
        key = mixed(key ^ parts[:, :, i])
    return key.view(np.int64)


def signed(docs: DataFrame, size: int, bands: int) -> DataFrame:
    """(``id``, ``digest``, ``bands``) from (``id``, ``digest``, ``text``); no bands for a text without words."""
    schema = T.StructType(
        [docs.schema["id"], docs.schema["digest"], T.StructField("bands", T.ArrayType(T.LongType()))]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                found = bags(batch.column(2))
                keys = band_keys(signatures(found, size), bands)
                full = np.array([len(s) > 0 for s, _ in found])
                offsets = np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=schema.names)

    return docs.select("id", "digest", "text").mapInArrow(work, schema)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags; 0 if both are empty."""
    _, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][at_a], b[1][at_b]).sum())
    total = int(a[1].sum() + b[1].sum()) - shared
    return shared / total if total else 0.0


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(``a``, ``b``, ``similarity``) of pairs of ids, from (``id``, ``text``)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                # A centre's text comes with each of its pairs; its bag is made once.
                distinct = list(dict.fromkeys(left + right))
                known = dict(zip(distinct, bags(pa.array(distinct, pa.string()))))
                found = [similarity(known[x], known[y]) for x, y in zip(left, right)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["a", "b", "similarity"]
                )

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("b_text"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "a_text", "b_text")
    return both.mapInArrow(work, "a long, b long, similarity double")


def close_pairs(nodes: DataFrame, texts: DataFrame, scratch, least: float) -> DataFrame:
    """Pairs (``a``, ``b``) of nodes of different ``component`` that may have the similarity ``least``; none that has is missing.

    Shingles are put in order, the rarest first. Bags of ``x`` and ``y``
    shingles, counted with their repeats, can be close only if they have
    ``least / (1 + least) * (x + y)`` in common. So the first shingle that both
    have stands early enough in both orders to leave that many behind it; a
    shingle that only one text has takes up room but is never looked for.
    Near copies that differ everywhere begin with shingles of their own and
    meet none.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 200):
                batch = whole.slice(first, 200)
                found = bags(batch.column(2))
                sizes = np.array([int(counts.sum()) for _, counts in found], np.int64)
                tokens = []
                for items, counts in found:
                    # The second of equal shingles is another token than the first.
                    turn = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    tokens.append(mixed(np.repeat(items, counts) ^ mixed(turn.astype(np.uint64))))
                place = np.repeat(np.arange(batch.num_rows), sizes)
                flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
                for start in range(0, len(flat), 200_000):
                    own = pa.array(place[start : start + 200_000])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(own), batch.column(1).take(own),
                            pa.array(sizes).take(own), pa.array(flat[start : start + 200_000].view(np.int64)),
                        ],
                        names=["node", "component", "size", "token"],
                    )

    bodies = nodes.join(texts.withColumnRenamed("id", "node"), "node").select("node", "component", "text")
    tokens = scratch(bodies.mapInArrow(work, "node long, component long, size long, token long"))
    common = tokens.groupBy("token").agg(F.count("*").alias("texts")).where("texts > 1")
    known = tokens.join(common, "token")
    own = Window.partitionBy("node")
    ranked = known.withColumn("rank", F.row_number().over(own.orderBy("texts", "token"))).withColumn(
        "shared", F.count("*").over(own)
    )
    # Counted from 0; what only this text has comes first.
    placed = ranked.select(
        "node", "component", "size", "token", (F.col("size") - F.col("shared") + F.col("rank") - 1).alias("at")
    )
    share = least / (1 + least)
    whole = lambda x: F.ceil(x - 1e-9)
    placed = scratch(placed.where(F.col("at") <= F.col("size") - whole(least * F.col("size"))))
    short = placed.where(F.col("at") <= F.col("size") - whole(2 * share * F.col("size")))
    x = short.select("token", *[F.col(c).alias(f"x_{c}") for c in ("node", "component", "size", "at")])
    y = placed.select("token", *[F.col(c).alias(f"y_{c}") for c in ("node", "component", "size", "at")])
    # The shorter one, or of equal ones that with the smaller id, looks for the other.
    in_turn = (F.col("x_size") < F.col("y_size")) | (
        (F.col("x_size") == F.col("y_size")) & (F.col("x_node") < F.col("y_node"))
    )
    behind = F.least(F.col("x_size") - F.col("x_at"), F.col("y_size") - F.col("y_at"))
    enough = behind >= whole(share * (F.col("x_size") + F.col("y_size")))
    met = x.join(
        y, (x.token == y.token) & in_turn & enough & (F.col("x_component") != F.col("y_component"))
        & (F.col("x_size") >= least * F.col("y_size") - 1e-9),
    )
    return met.select(
        F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")
    ).distinct()


def classes(
    docs: DataFrame,
    scratch,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = 0.8,
    size: int = 256,
    rows: int = 6,
) -> DataFrame:
    """``id_col``, ``digest`` (of the text), ``copy_of`` (least id with the same text) and ``class_id`` (least id of the group) of every row.

    A group is a connected set of texts whose similarity is ``least`` or more;
    every pair that shares a band is compared exactly, directly or by its
    texts being in one group already. With 42 bands of 6 values, a pair at 0.8
    shares none with a probability of 3e-6. A null text counts as empty; texts
    without words are grouped with equal texts only. Rows of equal id and text
    get the same answer. A row without an id is compared with none and has no
    class. ``scratch(df)`` writes a table to the shared folder and reads it back.

    Not all pairs of a band are made. Of its members the one that shares most
    bands with others, as the texts in the middle of a group do, meets the
    rest. The members of bands that are not in one group by then look for
    texts of other groups by :func:`close_pairs`, which loses none.
    """
    bands = size // rows
    if not bands:
        raise ValueError("a band has no more values than the signature")
    bodies_of = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("digest", F.unhex(F.md5("text")))
    marked = scratch(signed(bodies_of.where("id IS NOT NULL"), size, bands))
    # Copies are one node; its number is fixed by writing it.
    texts = scratch(
        marked.groupBy("digest").agg(F.min("id").alias("copy_of"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    banded = texts.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    members = scratch(banded.join(shared, "band"))
    wanted = members.select("node").distinct().join(texts.select("node", "digest", F.col("copy_of").alias("id")), "node")
    bodies = bodies_of.join(wanted, ["id", "digest"]).dropDuplicates(["id", "digest"])
    bodies = scratch(bodies.select(F.col("node").alias("id"), "text"))

    # One member of every band, that with most company, meets the others.
    company = members.groupBy("node").agg(F.sum("members").alias("company"))
    centre = members.join(company, "node").groupBy("band").agg(
        (-F.max(F.struct("company", (-F.col("node")).alias("least")))["least"]).alias("a")
    )
    spokes = members.select("band", "node").join(centre, "band").where("node <> a")
    spokes = spokes.select("a", F.col("node").alias("b")).distinct()
    near = F.col("similarity") >= least - 1e-12
    links = scratch(compared(spokes, bodies).where(near).select("a", "b"))
    groups = components(links, scratch)
    held = _in_groups(members.select("band", "node"), groups)
    several = held.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    unsettled = scratch(held.join(several.select("band"), "band", "left_semi").select("node", "component").distinct())
    pairs = scratch(close_pairs(unsettled, bodies, scratch, least))
    more = scratch(compared(pairs, bodies).where(near).select("a", "b"))
    if not more.isEmpty():
        groups = components(links.unionByName(more), scratch)

    placed = _in_groups(texts.select("digest", "copy_of", "node"), groups)
    named = placed.groupBy("component").agg(F.min("copy_of").alias("class_id"))
    placed = placed.join(named, "component").select("digest", "copy_of", "class_id")
    found = marked.select("id", "digest").join(placed, "digest").select(
        F.col("id").alias(id_col), "digest", "copy_of", "class_id"
    )
    none = F.lit(None).cast("long")
    without = bodies_of.where("id IS NULL").select(
        F.col("id").alias(id_col), "digest", none.alias("copy_of"), none.alias("class_id")
    )
    return found.unionByName(without)


def _in_groups(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """``nodes`` with the ``component`` of ``node``, itself where it has no link."""
    known = groups.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    joined = nodes.join(known, F.col("node") == F.col("_node"), "left")
    return joined.select(*nodes.columns, F.coalesce("_component", "node").alias("component"))


def one_of_each(docs: DataFrame, scratch, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with one row left of each group: that with the least id. Rows without an id stay.

    Of rows of equal id and text one stays.
    """
    found = classes(docs, scratch, id_col, text_col, **settings)
    # Names that no column of the documents has.
    free = max((len(c) for c in docs.columns), default=0) * "_" + "_"
    mark, digest, key = f"{free}m", f"{free}d", f"{free}k"
    kept = found.where(F.col(id_col) == F.col("class_id")).select(
        F.col(id_col).alias(key), F.col("digest").alias(digest)
    ).distinct()
    marked = docs.withColumn(mark, F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    same = (F.col(id_col) == F.col(key)) & (F.col(mark) == F.col(digest))
    first = marked.join(kept, same, "left_semi").dropDuplicates([id_col, mark]).drop(mark)
    return first.unionByName(docs.where(F.col(id_col).isNull()))
