"""Toxicity by class-conditional Kneser-Ney models of characters.

Texts become symbols of a small alphabet, white space and punctuation being
one. Toxic and ordinary texts have a model each: the probability of a symbol
after five, by absolute discounting. Both fall back on the same distribution,
which pools their counts and itself falls back on continuation counts of
shorter contexts, so what is rare in both hardly tells them apart. A text is
scored by its length-normalised log-likelihood ratio and by how many of its
words, and how strongly, speak for the toxic model; a logistic curve fitted on
labels that the counts have not seen turns that into a score.

Every context of five symbols has counts of its own, in a table whose rows grow
with what the labelled texts of the counted folds hold. No process holds that
table: documents are dealt into shards, a shard asks for the distinct runs of
six symbols in its texts, and gets their log ratios back. Only what belongs to
contexts of three symbols, at most 2^15, is kept as arrays.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import fold

SYMBOLS = 32
CONTEXT = 5
SHORT = 3
#: Parts of the model's table, by the last symbols of a context; a part has 2^21 cells at most.
PARTS = 512
#: Cells that a task gathers before it makes them distinct.
BUFFER = 1 << 21
STRONG = 3.0
EVIDENCE = 4


def alphabet() -> np.ndarray:
    """Symbol of each code point below U+0250; 0 for what is neither a letter nor a digit.

    Letters a to z, one symbol for digits, one each for accented a, e, o and
    n; other letters count as the letter without its accent.
    """
    groups = ["0123456789", "äáàâ", "éèê", "óôö", "ñ"]
    table = np.zeros(0x250, np.int64)
    for i in range(26):
        table[ord("a") + i] = i + 1
    for i, group in enumerate(groups):
        table[[ord(c) for c in group]] = 27 + i
    for point in range(0x250):
        if not table[point]:
            base = unicodedata.normalize("NFD", chr(point).lower())[0]
            table[point] = table[ord(base)] if ord(base) < 0x250 else 0
    return table


TABLE = alphabet()


def symbols(text: str) -> np.ndarray:
    """A text as symbols, after as many separators as a context is long and before one; separators do not repeat."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    # Letters beyond the table, such as Cyrillic ones, are hashed to its letters.
    far = points >= 0x250
    body = TABLE[np.where(far, 0, points)]
    if far.any():
        letters = np.fromiter((chr(p).isalnum() for p in points[far].tolist()), bool, int(far.sum()))
        body[far] = np.where(letters, points[far] % 26 + 1, 0)
    whole = np.concatenate([np.zeros(CONTEXT, np.int64), body, [0]])
    kept = np.ones(len(whole), bool)
    kept[CONTEXT:] = (whole[CONTEXT:] != 0) | (whole[CONTEXT - 1 : -1] != 0)
    return whole[kept]


def cells(x: np.ndarray) -> np.ndarray:
    """For each symbol after the first ones: the context before it and the symbol, as one number below 2^30."""
    n = max(0, len(x) - CONTEXT)
    out = np.zeros(n, np.uint32)
    for i in range(CONTEXT + 1):
        out = (out << np.uint32(5)) | x[i : i + n].astype(np.uint32)
    return out


def wrapped(values: np.ndarray) -> bytes:
    """The bytes of an array behind their number, compressed."""
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unwrapped(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), kind)


def increasing(cell: np.ndarray) -> bytes:
    """Sorted cells by their differences."""
    return wrapped(np.diff(cell, prepend=np.uint32(0)))


def from_increasing(data: bytes) -> np.ndarray:
    return np.cumsum(unwrapped(data, "<u4"), dtype=np.uint32)


def discount(once: int, twice: int) -> float:
    return once / (once + 2 * twice) if once else 0.5


def discount_of(counts: np.ndarray) -> float:
    return discount(int((counts == 1).sum()), int((counts == 2).sum()))


def smoothed(counts: np.ndarray, lower: np.ndarray, strength: float = 0.0) -> np.ndarray:
    """Discounted counts by row, the rest of the mass (and ``strength`` observations more) spread like ``lower``."""
    d = discount_of(counts)
    total = counts.sum(axis=1, keepdims=True)
    kinds = (counts > 0).sum(axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        mixed = (np.maximum(counts - d, 0) + (strength + d * kinds) * lower) / (total + strength)
    return np.where(total + strength > 0, mixed, lower)


def shared_by_short(continuation: np.ndarray) -> np.ndarray:
    """The shared distribution after each context of ``SHORT`` symbols, from continuation counts of these contexts."""
    levels = [continuation]
    for _ in range(SHORT):
        # In how many longer contexts each symbol follows the shorter one.
        levels.append((levels[-1].reshape(SYMBOLS, -1, SYMBOLS) > 0).sum(axis=0))
    shared = np.full((1, SYMBOLS), 1 / SYMBOLS)
    for level in levels[::-1]:
        shared = smoothed(level, np.tile(shared, (len(level) // len(shared), 1)))
    return shared


def log_ratios(
    cell: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray, shared: np.ndarray, discounts: list[float], strength: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logarithm of the ratio of the two models' probabilities for every counted cell, and for the others of a context.

    Contexts come whole. Returns the cells' values, the contexts, and the value
    of symbols that did not follow a context: it is the same for all of them.
    """
    contexts, row = np.unique(cell >> 5, return_inverse=True)
    n = len(contexts)

    def parts(counts: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the counts of cells keep, what their rows give away, and the rows' totals."""
        kinds = np.bincount(row, counts > 0, n)
        return np.maximum(counts - d, 0), d * kinds, np.bincount(row, counts, n)

    kept, given, total = parts(ordinary + toxic, discounts[0])
    lower = (kept + given[row] * shared[contexts[row] % SYMBOLS**SHORT, cell % SYMBOLS]) / total[row]
    value, other = np.zeros(len(cell)), np.zeros(n)
    for sign, counts, d in ((1, toxic, discounts[2]), (-1, ordinary, discounts[1])):
        kept, given, total = parts(counts, d)
        value += sign * np.log((kept + (strength + given[row]) * lower) / (total[row] + strength))
        other += sign * np.log((strength + given) / (total + strength))
    return value.astype(np.float32), contexts, other.astype(np.float32)


def evidence(x: np.ndarray, found: np.ndarray) -> list[float]:
    """Of a whole text's symbols and log ratios: mean by symbol, log count and share of strong words, strongest (at most 8)."""
    if not len(found):
        return [0.0] * EVIDENCE
    stops = np.flatnonzero(x[CONTEXT:] == 0)
    words = np.add.reduceat(found, np.concatenate([[0], stops[:-1] + 1])) if len(stops) else found.sum(keepdims=True)
    strong = int((words > STRONG).sum())
    return [float(found.mean()), float(np.log1p(strong)), strong / len(words), float(min(words.max(), 8.0))]


@dataclass
class Model:
    """``counts`` has columns ``cell``, ``ordinary`` and ``toxic``; ``discounts`` are of both classes' sum and of each."""

    counts: DataFrame
    shared: np.ndarray
    discounts: list[float]
    strength: float
    toxic_texts: int
    ordinary_texts: int


def _judged(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """One label for each id: toxic if any of its labels says so."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    return known.groupBy(id_col).agg(F.max(label_col).alias("_label"))


def packed(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with a text's symbols, compressed, as the last column ``symbols`` instead of the text."""
    kept = [c for c in docs.columns if c != text_col]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("symbols", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [wrapped(symbols(t.as_py() or "").astype(np.uint8)) for t in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(found, pa.binary())], names=schema.names
            )

    return docs.select(*kept, text_col).mapInArrow(work, schema)


COUNTS = "cell int, ordinary long, toxic long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of cells by class, made distinct a few texts at a time; cell -1 counts texts."""
    gathered: tuple[list, list] = ([], [])
    texts, size = [0, 0], 0

    def drained() -> pa.RecordBatch:
        each = [np.unique(np.concatenate(g), return_counts=True) if g else (np.zeros(0, np.uint32), np.zeros(0, int)) for g in gathered]
        n = [len(c) for c, _ in each]
        none = [np.zeros(k, np.int64) for k in n]
        columns = [
            np.concatenate([each[0][0], each[1][0]]).astype(np.int32),
            np.concatenate([each[0][1], none[1]]),
            np.concatenate([none[0], each[1][1]]),
        ]
        gathered[0].clear(), gathered[1].clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "ordinary", "toxic"])

    for batch in batches:
        for data, label in zip(batch.column(0), batch.column(1).to_pylist()):
            own = cells(unwrapped(data.as_py(), "u1"))
            gathered[label].append(own)
            texts[label] += 1
            size += len(own)
            if size >= BUFFER:
                yield drained()
                size = 0
    yield drained()
    yield pa.RecordBatch.from_arrays(
        [pa.array([-1], pa.int32()), pa.array([texts[0]]), pa.array([texts[1]])], names=["cell", "ordinary", "toxic"]
    )


def withheld(id_col: str, folds: int, calibration: int, share: float) -> Column:
    """Whether an id is among that share of the calibration fold, chosen by a hash of the id, that fits the curve."""
    chosen = F.pmod(F.xxhash64(id_col, F.lit("c")), F.lit(1_000_000)) < int(share * 1_000_000)
    return (fold(id_col, folds) == calibration) & chosen


def train(
    docs: DataFrame,
    labels: DataFrame,
    scratch,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 5,
    held_out: int = 0,
    calibration: int = 1,
    strength: float = 30.0,
    share: float = 1.0,
) -> Model | None:
    """Counts over all labelled texts but the held-out fold and ``share`` of the calibration fold; None if a class has none.

    Counts are summed in every task before they are shuffled. What goes to the
    driver are sums of a fixed number: of texts, of cells that occur once and
    twice, and in how many contexts a symbol follows the same last three.
    """
    learnt = lambda rows: rows.where((fold(id_col, folds) != held_out) & ~withheld(id_col, folds, calibration, share))
    judged = learnt(_judged(labels, id_col, label_col)).withColumn("_label", (F.col("_label") > 0).cast("int"))
    # Labels grow with the documents: the same plan at every size, not a broadcast while they happen to be few.
    texts = packed(learnt(docs.select(id_col, text_col)), text_col).join(judged.hint("merge"), id_col)
    counted = texts.select("symbols", "_label").mapInArrow(_count, COUNTS)
    counts = scratch(counted.groupBy("cell").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")))
    kinds = {"both": F.col("ordinary") + F.col("toxic"), "ordinary": F.col("ordinary"), "toxic": F.col("toxic")}
    told = counts.agg(
        F.sum(F.when(F.col("cell") < 0, F.col("ordinary"))),
        F.sum(F.when(F.col("cell") < 0, F.col("toxic"))),
        *[F.count(F.when((F.col("cell") >= 0) & (of == n), 1)) for of in kinds.values() for n in (1, 2)],
    ).first()
    if not told[0] or not told[1]:
        return None
    counts = counts.where("cell >= 0")
    short = SYMBOLS ** (SHORT + 1)
    continuation = np.zeros(short, np.int64)
    for row in counts.groupBy((F.col("cell") % short).alias("at")).count().toLocalIterator():
        continuation[row["at"]] = row["count"]
    shared = shared_by_short(continuation.reshape(-1, SYMBOLS))
    discounts = [discount(told[i], told[i + 1]) for i in (2, 4, 6)]
    return Model(counts, shared, discounts, strength, told[1], told[0])


ASKED = "part int, shard int, cells binary, ratios binary, contexts binary, others binary"
ANSWERS = "shard int, cells binary, ratios binary"
#: Rows of ``ASKED`` without a shard are the model's.
MODEL = -1


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.table({name: pa.array(list(c), kinds[kind]) for (name, kind), c in zip(fields, columns)})


def model_parts(model: Model):
    """Of one part of the contexts: its row of ``ASKED``."""
    shared = model.counts.sparkSession.sparkContext.broadcast(model.shared)
    discounts, strength = model.discounts, model.strength

    def work(counts: pa.Table) -> pa.Table:
        cell, ordinary, toxic = (counts.column(c).to_numpy() for c in ("cell", "ordinary", "toxic"))
        order = np.argsort(cell)
        cell = cell[order].astype(np.uint32)
        value, contexts, other = log_ratios(cell, ordinary[order], toxic[order], shared.value, discounts, strength)
        row = int(contexts[0]) % PARTS, MODEL, increasing(cell), wrapped(value), increasing(contexts), wrapped(other)
        return _table([row], ASKED)

    return work


def wanted(texts: pa.Table) -> pa.Table:
    """Of one shard: the distinct cells of its texts, by parts."""
    known, gathered, size = np.zeros(0, np.uint32), [], 0
    for data in texts.column("symbols"):
        gathered.append(cells(unwrapped(data.as_py(), "u1")))
        size += len(gathered[-1])
        if size >= BUFFER:
            known, gathered, size = np.unique(np.concatenate([known, *gathered])), [], 0
    known = np.unique(np.concatenate([known, *gathered]))
    part = (known >> 5) % PARTS
    by = np.argsort(part, kind="stable")
    known, ends = known[by], np.cumsum(np.bincount(part, minlength=PARTS))
    shard = texts.column("shard")[0].as_py()
    spans = [(p, known[a:b]) for p, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())) if b > a]
    return _table([(p, shard, increasing(own), None, None, None) for p, own in spans], ASKED)


def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Log ratios of wanted cells; a part's row of the model comes before what is wanted of it. Unseen contexts give 0."""
    at, held = None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["shard"] == MODEL:
                at = row["part"]
                held = (
                    from_increasing(row["cells"]), unwrapped(row["ratios"], "<f4"),
                    from_increasing(row["contexts"]), unwrapped(row["others"], "<f4"),
                )
                continue
            cell = from_increasing(row["cells"])
            found = np.zeros(len(cell), np.float32)
            if row["part"] == at:
                # The cells of contexts come last, so counted ones take their own values.
                for keys, values, asked in ((held[2], held[3], cell >> 5), (held[0], held[1], cell)):
                    where = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                    found = np.where(keys[where] == asked, values[where], found)
            out.append((row["shard"], row["cells"], wrapped(found)))
        yield from _table(out, ANSWERS).to_batches()


def weighed_texts(schema: T.StructType):
    """Of one shard: ``schema``, an id and the evidence of its text, from the log ratios the shard has asked for."""

    def work(texts: pa.Table, answers: pa.Table) -> pa.Table:
        none = np.zeros(0, np.uint32)
        keys = np.concatenate([none, *[from_increasing(c.as_py()) for c in answers.column("cells")]])
        values = np.concatenate([none.astype("<f4"), *[unwrapped(c.as_py(), "<f4") for c in answers.column("ratios")]])
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        rows = []
        for data in texts.column("symbols"):
            x = unwrapped(data.as_py(), "u1")
            rows.append(evidence(x, values[np.searchsorted(keys, cells(x))]))
        rows = pa.array(rows, pa.list_(pa.float64()))
        return pa.table([texts.column(0), rows], names=schema.names)

    return work


def weigh(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 32_000_000
) -> DataFrame:
    """``id_col`` and ``evidence`` (array of double) of every row; a null text counts as empty.

    Shards follow from the size of the texts, about ``shard_bytes`` each; what
    is shuffled is every text once, and the distinct cells of shards.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    shard = F.pmod(F.xxhash64(id_col, text_col), F.lit(shards)).cast("int")
    dealt = packed(docs.select(id_col, shard.alias("shard"), text_col), text_col).repartition("shard")
    asked = dealt.groupBy("shard").applyInArrow(wanted, ASKED)
    part = F.pmod(F.shiftright("cell", 5), F.lit(PARTS))
    table = model.counts.groupBy(part.alias("part")).applyInArrow(model_parts(model), ASKED)
    answers = table.union(asked).repartition("part").sortWithinPartitions("part", "shard").mapInArrow(answered, ANSWERS)
    schema = T.StructType([docs.schema[id_col], T.StructField("evidence", T.ArrayType(T.DoubleType()))])
    return dealt.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(weighed_texts(schema), schema)


def logistic(rows: np.ndarray, label: np.ndarray, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps on standardised rows, given for the rows as they are."""
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    z = np.c_[(rows - mean) / scale, np.ones(len(rows))]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (q - label) / len(label) + decay * w
        bend = (z * (q * (1 - q))[:, None]).T @ z / len(label) + (decay + 1e-6) * np.eye(len(w))
        w -= np.linalg.solve(bend, slope)
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def report(
    docs: DataFrame,
    labels: DataFrame,
    scratch,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 5,
    held_out: int = 0,
    calibration: int = 1,
    most: int = 40_000,
) -> DataFrame:
    """Every document's fold, score and predicted label.

    ``scratch(df)`` writes a table to the shared folder and reads it back. At
    most about ``most`` labelled rows of the calibration fold, chosen by a hash
    of their ids, fit the curve; the others are counted. Without toxic or ordinary labels to learn
    from all scores are 0. Null ids and empty or null texts get a score too.
    """
    out = lambda rows, value: rows.select(
        id_col,
        F.coalesce(fold(id_col, folds) == held_out, F.lit(False)).alias("held_out"),
        value.alias("score"),
        (value >= 0.5).cast("int").alias("predicted"),
    )
    judged = _judged(labels, id_col, label_col).where(fold(id_col, folds) == calibration)
    share = min(1.0, most / max(1, judged.count()))
    model = train(docs, labels, scratch, id_col, text_col, label_col, folds, held_out, calibration, share=share)
    if model is None:
        return out(docs, F.lit(0.0))
    weighed = scratch(weigh(docs, model, id_col, text_col))
    pairs = weighed.join(judged.where(withheld(id_col, folds, calibration, share)), id_col).toPandas()
    if pairs["_label"].nunique() > 1:
        weights, bias = logistic(np.stack(pairs["evidence"].to_numpy()), (pairs["_label"] > 0).to_numpy(float))
    else:
        weights, bias = np.array([0.0, 0.0, 0.0, 1.0]), -6.0
    line = sum((F.get("evidence", F.lit(i)) * float(w) for i, w in enumerate(weights)), F.lit(bias))
    return out(weighed, 1 / (1 + F.exp(-line)))
