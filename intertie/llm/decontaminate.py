"""Benchmark items inside documents: SimHash windows, multi-index Hamming blocks, exact comparison.

A document's windows that share a shingle with an item are given a 64-bit
SimHash, as items are; windows are as long as the item. Fingerprints are cut
into one block more than the radius, so any two within the radius agree in a
block; windows and items of one length meet in an equi-join on blocks. What is
within the radius is compared exactly by weighted Jaccard similarity of
shingles. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
BITS = 64
SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def shingles_of(words: Column, size: Column) -> Column:
    """Runs of ``size`` words joined by a space; none if there are fewer words."""
    return F.when(
        F.size(words) >= size,
        F.transform(
            F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " ")
        ),
    ).otherwise(F.array().cast("array<string>"))


def shingle_hashes(hashes: Column, size: int) -> Column:
    """Hash of each run of ``size`` neighbours of an array of word hashes."""
    return F.when(
        F.size(hashes) >= size,
        F.transform(
            F.sequence(F.lit(0), F.size(hashes) - size),
            lambda i: F.xxhash64(*[F.get(hashes, i + F.lit(j)) for j in range(size)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """SimHash of a bag of word hashes: each bit is the majority of that bit over the words, 1 on a tie."""
    def bit(b: Column) -> Column:
        balance = F.aggregate(
            hashes, F.lit(0), lambda s, h: s + (F.getbit(h, b) * F.lit(2) - F.lit(1)).cast("int")
        )
        return F.when(balance >= 0, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        F.lit(0).cast("bigint"),
        lambda s, b: s.bitwiseOR(F.call_function("shiftleft", bit(b), b)),
    )


def blocks_of(fingerprint: Column, radius: int) -> Column:
    """The fingerprint's ``radius`` + 1 blocks of bits as structs (no, value)."""
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    parts = []
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
        mask = (1 << (high - low)) - 1
        value = F.shiftrightunsigned(fingerprint, low).bitwiseAND(F.lit(mask))
        parts.append(F.struct(F.lit(i).alias("no"), value.alias("value")))
    return F.array(*parts)


def bag_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of shingles taken as bags.

    Without repeats in either, bags are sets and one hashed intersection gives it.
    """
    count = lambda bag, s: F.size(F.filter(bag, lambda x: x == s))
    single = lambda bag: F.size(F.array_distinct(bag)) == F.size(bag)
    shared = F.when(single(a) & single(b), F.size(F.array_intersect(a, b))).otherwise(
        F.aggregate(F.array_distinct(a), F.lit(0), lambda total, s: total + F.least(count(a, s), count(b, s)))
    )
    return shared / (F.size(a) + F.size(b) - shared)


def item_table(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Items with words, length, shingle size, shingles, hashes and fingerprint; items without words or id are left out."""
    split = items.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("item_words"))
    sized = split.where(F.col("item").isNotNull() & (F.size("item_words") > 0)).withColumns(
        {
            "length": F.size("item_words"),
            "size": F.least(F.lit(SHINGLE), F.size("item_words")),
            "hashes": F.transform("item_words", lambda w: F.xxhash64(w)),
        }
    )
    return sized.select(
        "item",
        "length",
        "size",
        "hashes",
        shingles_of(F.col("item_words"), F.col("size")).alias("item_shingles"),
        simhash(F.col("hashes")).alias("item_print"),
    )


def matches(
    docs: DataFrame,
    items: DataFrame,
    scratch,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: float = 0.8,
    radius: int = 15,
) -> DataFrame:
    """(``id_col``, ``item_id``, ``similarity``, ``start``, ``distance``): every item found in every document.

    ``start`` is the first word of the most similar window, the earliest of
    equals, and ``distance`` its Hamming distance. Items of fewer than five
    words are one shingle. Documents or items that are null, empty or shorter
    than the other's window give no rows. Rows of equal id and text, and of
    equal item and text, give one row; a null document id is
    kept as null, an item without an id is none.
    ``scratch(df)`` writes a table to the shared folder and reads it back.

    The first step drops no window that counts: a window at ``least`` holds
    that share of the item's shingles, so only documents with as many places
    of them are cut into windows.
    """
    known = scratch(item_table(items, item_id, item_text))
    # At most SHINGLE different sizes.
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).withColumn(
        "key", F.xxhash64("id", "body")
    )
    hashed = rows.select("key", F.transform(words_of(F.col("body")), lambda w: F.xxhash64(w)).alias("words"))
    hits = None
    for size in sizes:
        wanted = known.where(F.col("size") == size).select(
            "item",
            "length",
            F.size("item_shingles").alias("n"),
            F.explode(F.array_distinct(shingle_hashes(F.col("hashes"), size))).alias("shingle"),
        )
        places = hashed.select("key", F.posexplode(shingle_hashes(F.col("words"), size)).alias("place", "shingle"))
        # The items' shingles are written first, so their size is known and the planner picks the join by it.
        found = places.join(scratch(wanted), "shingle").select("key", "item", "length", "n", "place")
        hits = found if hits is None else hits.union(found)
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {item_id} " \
        f"{items.schema[item_id].dataType.simpleString()}, similarity double, start int, distance int"
    if hits is None:
        return docs.sparkSession.createDataFrame([], schema)
    # Places of a document and item: at most one for each word of the document.
    paired = hits.groupBy("key", "item", "length", "n").agg(F.collect_set("place").alias("places"))
    paired = scratch(paired.where(F.size("places") >= F.col("n") * F.lit(least)))
    lengths = paired.groupBy("key", "length").agg(
        F.array_distinct(F.flatten(F.collect_set("places"))).alias("places")
    )
    size = F.least(F.lit(SHINGLE), F.col("length"))
    starts = F.array_distinct(
        F.flatten(
            F.transform(
                "places",
                lambda p: F.sequence(
                    F.greatest(F.lit(0), p - F.col("length") + size),
                    F.greatest(F.lit(0), F.least(p, F.col("total") - F.col("length"))),
                ),
            )
        )
    )
    cut = (
        rows.join(lengths, "key")
        .withColumn("doc_words", words_of(F.col("body")))
        .withColumn("total", F.size("doc_words"))
        .where("total >= length")
        .select("id", "key", "length", "total", "doc_words", F.explode(starts).alias("start"))
        .where("start + length <= total")
        .select("id", "key", "length", "start", F.expr("slice(doc_words, start + 1, length)").alias("words"))
        .withColumn("print", simhash(F.transform("words", lambda w: F.xxhash64(w))))
    )
    windows = scratch(cut)
    left = windows.select(
        "key", "length", "start", "print", F.explode(blocks_of(F.col("print"), radius)).alias("block")
    )
    right = known.select(
        "item", "length", "item_print", F.explode(blocks_of(F.col("item_print"), radius)).alias("block")
    )
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    near = (
        left.join(right, ["length", "block"])
        .select("key", "length", "start", "item", distance.alias("distance"))
        .where(F.col("distance") <= radius)
        .distinct()
    )
    checked = (
        windows.join(near, ["key", "length", "start"])
        .join(known.select("item", "length", "size", "item_shingles"), ["item", "length"])
        .withColumn("window_shingles", shingles_of(F.col("words"), F.col("size")))
        .withColumn("similarity", bag_similarity(F.col("window_shingles"), F.col("item_shingles")))
        .where(F.col("similarity") >= least - 1e-12)
    )
    best = checked.groupBy("id", "key", "item").agg(
        F.min(F.struct((-F.col("similarity")).alias("less"), "start", "distance")).alias("best")
    )
    return best.select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_id),
        (-F.col("best.less")).alias("similarity"),
        "best.start",
        F.col("best.distance").cast("int").alias("distance"),
    )


def clean(docs: DataFrame, items: DataFrame, scratch, id_col: str = "doc_id", **settings) -> DataFrame:
    """``docs`` without the documents in which an item is found; rows without an id stay."""
    found = matches(docs.where(F.col(id_col).isNotNull()), items, scratch, id_col, **settings)
    return docs.join(found.select(id_col).distinct(), id_col, "left_anti").select(*docs.columns)


def matches_sql(least: float = 0.8) -> str:
    """SQL for the rows of ``matches`` over tables ``documents`` and ``benchmark``, without fingerprints."""
    split = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    return f"""
WITH d AS (SELECT DISTINCT doc_id, {split} AS w FROM documents),
i AS (SELECT DISTINCT item_id, {split} AS v FROM benchmark),
it AS (SELECT item_id, v, len(v) AS n, least({SHINGLE}, len(v)) AS k FROM i WHERE len(v) > 0),
ish AS (SELECT item_id, n, k,
               list_transform(range(1, n - k + 2), lambda p: array_to_string(v[p:p + k - 1], ' ')) AS s FROM it),
one AS (SELECT DISTINCT item_id, n, k, unnest(s) AS g FROM ish),
dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p
       FROM d, (SELECT DISTINCT k FROM it) ks WHERE len(w) >= k),
dg AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM dp),
hit AS (SELECT doc_id, item_id, n, dg.k, p FROM dg JOIN one ON dg.g = one.g AND dg.k = one.k),
st AS (SELECT DISTINCT doc_id, item_id, n, k, unnest(range(greatest(1, p - n + k), p + 1)) AS b FROM hit),
win AS (SELECT st.doc_id, st.item_id, b, ish.s,
               list_transform(range(b, b + st.n - st.k + 1), lambda p: array_to_string(w[p:p + st.k - 1], ' ')) AS t
        FROM st JOIN d ON d.doc_id IS NOT DISTINCT FROM st.doc_id JOIN ish USING (item_id)
        WHERE b + st.n - 1 <= len(w)),
inter AS (SELECT *, list_sum(list_transform(list_distinct(s), lambda g: least(
              len(list_filter(s, lambda x: x = g)), len(list_filter(t, lambda x: x = g)))))::BIGINT AS c FROM win),
sim AS (SELECT doc_id, item_id, b - 1 AS start, c::DOUBLE / (len(s) + len(t) - c)::DOUBLE AS similarity FROM inter),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS rn
      FROM sim WHERE similarity >= {least})
SELECT doc_id, item_id, similarity, start::INTEGER AS start FROM r WHERE rn = 1"""
