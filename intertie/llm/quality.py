"""Quality of texts by learning from positive and unlabelled examples.

A linear model on features of whole texts minimises the non-negative unbiased
risk: the risk of trusted good texts taken as positive, plus the risk of
unlabelled texts taken as negative less what the good ones among them add,
which must not fall below zero. The share of good texts is estimated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

#: Shares of the 128 ASCII characters, other bytes, and the figures of ``shape``.
BYTES = 129
SHAPES = 12
FEATURES = BYTES + SHAPES


def shape(text: str) -> list[float]:
    """Figures of a text's words and lines, each between 0 and a few units."""
    words = text.split()
    lines = [line for line in text.split("\n") if line.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    distinct = set(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    repeated = sum(a == b for a, b in zip(words, words[1:])) / n
    return [
        np.log1p(len(text)) / 10,
        np.log1p(n) / 10,
        len(distinct) / n,
        len(distinct) / n**0.8,
        repeated,
        len(set(lines)) / m,
        float(sizes.mean()) / 10,
        float(sizes.std()) / 10,
        float((sizes <= 3).mean()),
        np.log1p(n / m) / 5,
        sum(w.isupper() for w in words) / n,
        sum(not w.isalnum() for w in words) / n,
    ]


def features(text: str | None) -> np.ndarray:
    """Features of one whole text; null counts as empty, and an empty text has features too."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    shares = np.append(counts[:128], counts[128:].sum()) / max(1, len(raw))
    return np.concatenate([np.sqrt(shares), shape(text)]).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def standard(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Rows at the scale of the model, with a last column of ones for the bias."""
    z = np.clip((rows - mean) / scale, -8, 8).astype(np.float64)
    return np.c_[z, np.ones(len(z))]


def moments(rows: np.ndarray) -> np.ndarray:
    """Number, sum and sum of squares of rows."""
    wide = rows.astype(np.float64)
    return np.concatenate([[len(wide)], wide.sum(axis=0), (wide**2).sum(axis=0)])


def curvature(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of rows, gradient and second derivatives of the loss of rows taken as negative."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
    return np.concatenate([x.sum(axis=0), p @ x, ((x * (p * (1 - p))[:, None]).T @ x).ravel()])


def losses(x: np.ndarray, trials: np.ndarray) -> np.ndarray:
    """Number of rows, and for every trial the sums of their losses as negative and as positive."""
    z = x @ trials.T
    return np.concatenate([[len(x)], np.logaddexp(0, z).sum(axis=0), np.logaddexp(0, -z).sum(axis=0)])


#: Shares of a step that are tried.
STEPS = np.array([1.0, 0.5, 0.25, 0.1, 0.03, 0.0])


def minimise(positive: Callable, unlabelled: Callable, prior: float, rounds: int = 12, decay: float = 1e-4) -> Model | None:
    """Minimise the non-negative risk with the logistic loss.

    ``positive`` and ``unlabelled`` take a function of rows and give the sum of
    its results over all rows of the class. The loss of a row as positive less
    that as negative is linear, so the unbiased risk is convex; Newton steps
    lead down it, cut short by the non-negative risk: of some shares of a step
    the one with the least is taken, and none of it when the risk of the
    unlabelled rows as negative would fall below what the good ones add.
    """
    found = unlabelled(moments)
    count, width = found[0], len(found) // 2
    if not count or not positive(moments)[0]:
        return None
    mean = found[1 : width + 1] / count
    scale = np.sqrt(np.maximum(found[width + 1 :] / count - mean**2, 0)) + 1e-3
    w = np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    ridge = np.append(np.full(width, decay), 1e-9)
    good = positive(lambda rows: np.append(len(rows), standard(rows, mean, scale).sum(axis=0)))
    good_mean = good[1:] / good[0]
    for _ in range(rounds):
        sums = unlabelled(lambda rows: curvature(standard(rows, mean, scale), w))
        slope = sums[width + 1 : 2 * width + 2] / count - prior * good_mean + ridge * w
        second = sums[2 * width + 2 :].reshape(width + 1, width + 1) / count + np.diag(ridge)
        step = np.linalg.solve(second, slope)
        trials = w - STEPS[:, None] * step
        risk_p = positive(lambda rows: losses(standard(rows, mean, scale), trials))
        risk_u = unlabelled(lambda rows: losses(standard(rows, mean, scale), trials))
        k = len(STEPS)
        rest = risk_u[1 : k + 1] / count - prior * risk_p[1 : k + 1] / risk_p[0]
        risk = prior * risk_p[k + 1 :] / risk_p[0] + np.maximum(rest, 0) + (ridge * trials**2).sum(axis=1) / 2
        # A negative rest is what the non-negative risk keeps from being fitted.
        best = int(np.argmin(np.where(rest >= 0, risk, np.inf))) if (rest >= 0).any() else k - 1
        if risk[-1] - risk[best] < 1e-9:
            break
        w = trials[best]
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, **settings) -> Model | None:
    """:func:`minimise` over rows at hand."""
    return minimise(lambda f: f(positive), lambda f: f(unlabelled), prior, **settings)


def summed(rows: DataFrame) -> Callable[[Callable[[np.ndarray], np.ndarray]], np.ndarray]:
    """Sums over the ``features`` of all rows: each task adds its own up, the rest is an aggregate by position."""

    def total(function: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = function(np.zeros((0, FEATURES), np.float32))
            for batch in batches:
                flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                matrix = flat.reshape(-1, FEATURES)
                for first in range(0, len(matrix), 4096):
                    own = own + function(matrix[first : first + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(own)), pa.int32()), pa.array(own)], names=["place", "value"])

        parts = rows.select("features").mapInArrow(work, "place int, value double")
        # Decimal sums do not depend on the order in which tasks end.
        exact = F.sum(F.col("value").cast("decimal(38,12)")).cast("double")
        found = parts.groupBy("place").agg(exact.alias("value")).toArrow()
        size = len(function(np.zeros((0, FEATURES), np.float32)))
        out = np.zeros(size)
        out[found.column("place").to_numpy()] = found.column("value").to_numpy()
        return out

    return total


def fold(id_col: str, parts: int) -> Column:
    """CRC-32 of the id's decimal text, modulo ``parts``; a null id has none."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def sampled(rows: DataFrame, id_col: str, share: float, name: str) -> DataFrame:
    """About that share of the rows, chosen by a hash of the id."""
    return rows.where(F.pmod(F.xxhash64(id_col, F.lit(name)), F.lit(1_000_000)) < int(share * 1_000_000))


def featured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col`` and ``features`` (array of float) of every row."""
    schema = T.StructType([docs.schema[id_col], T.StructField("features", T.ArrayType(T.FloatType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(1)]
            flat = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.float32))
            offsets = pa.array(np.arange(0, FEATURES * len(rows) + 1, FEATURES, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=schema.names
            )

    return docs.select(id_col, text_col).mapInArrow(work, schema)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 3,
    held_out: int = 1,
) -> Model | None:
    """A model from labels outside the held-out fold; None if no text there is labelled as good.

    The class prior is the share of good ones among all of those labels. An id
    labelled more than once is good if all its labels are. All texts with a
    good label count as positive and all rows of ``docs`` as unlabelled,
    whatever their labels, ids of null included; a repeated row counts each
    time. Features are written once to the shared folder and summed there in
    every round; the driver holds sums only. No rows give no model.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col, folds) != held_out))
    judged = known.groupBy(id_col).agg(F.min(label_col).alias("_label"))
    good, total = judged.agg(F.count(F.when(F.col("_label") == 1, 1)), F.count("*")).first()
    if not good:
        return None
    prior = min(0.99, max(0.01, good / total))
    every = _kept(featured(docs, id_col, text_col), "features")
    trusted = _kept(every.join(judged.where("_label = 1").select(id_col), id_col, "left_semi"), "good-features")
    return minimise(summed(trusted), summed(every), prior)


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read back."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def score(docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of being good as column ``out`` (replaced if there); 0.5 without a model."""
    kept = docs.drop(out) if out in docs.columns and out != text_col else docs
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType())])
    at = kept.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                rows = np.stack([features(t.as_py()) for t in batch.column(at)])
                found = model.scores(rows) if model else np.full(len(rows), 0.5)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=schema.names)

    return kept.mapInArrow(work, schema)


def report(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, **names: str) -> DataFrame:
    """Every document's fold, score and predicted label."""
    model = train(docs, labels, folds=folds, held_out=held_out, **names)
    id_col, text_col = names.get("id_col", "doc_id"), names.get("text_col", "text")
    return score(docs.select(id_col, text_col), model, text_col).select(
        id_col,
        F.coalesce(fold(id_col, folds) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
