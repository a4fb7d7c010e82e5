"""Words of many texts as arrays of hashes. A word is what stands between ASCII white space, unchanged."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

ODD = np.uint64(0x9E3779B97F4A7C15)
#: ODD times this is 1 modulo 2**64.
ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of every text in turn, and the number of words of each; null counts as empty."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = parts.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    hashes = pd.util.hash_array(np.array(distinct, object), categorize=False) if distinct else np.zeros(0, np.uint64)
    at = coded.indices.to_numpy(zero_copy_only=False)
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    # White space at an end leaves an empty part.
    empty = distinct.index("") if "" in distinct else -1
    full = at != empty
    if not full.all():
        reached = np.concatenate([[0], np.cumsum(full)])[np.cumsum(counts)]
        counts = np.diff(reached, prepend=0)
    return hashes.astype(np.uint64)[at[full]], counts


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    v = values ^ (values >> np.uint64(30))
    v = v * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` neighbours, from one running sum of hash times power."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    powers = np.full(len(hashes), ODD, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers)])
    back = np.full(n, ODD_INVERSE, np.uint64)
    back[0] = 1
    return mixed((sums[size:] - sums[:-size]) * np.cumprod(back))


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Least value of every run of ``size`` neighbours."""
    n = len(values) - size + 1
    if n < 1:
        return values[:0]
    best, covered = values, 1
    while covered < size:
        step = min(covered, size - covered)
        best = np.minimum(best[: len(best) - step], best[step:])
        covered += step
    return best
