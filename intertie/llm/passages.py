"""Removal of passages that an earlier document has too.

1. Every window of ``window`` words holds a phrase whose order value is its least; equal windows hold the same one.
   The documents' least phrases are counted; those in two documents at least are recurring.
2. Documents are dealt into shards. The recurring phrases of a shard's documents are compiled into an Aho-Corasick
   automaton, one letter for each word, and all documents of the shard run through it. Only windows around a hit can
   recur; their hashes go on, in groups by hash, once for each shard.
3. The first document of each such window is found, and sent back to the shards that have the window again.
4. Each shard removes the words of windows that an earlier document has.

No group of documents that share a passage or a phrase is ever brought
together: a group by hash gets an entry for each of its windows and shard that
has it, and there are as many groups as keep it about as large as a few shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .word_hashes import ODD, ODD_INVERSE, grams, hashed_words, mixed, sliding_min

PHRASE = 6
LETTER_BITS = 10
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Letters of the automaton begin at this code point.
FIRST_LETTER = 0x100


def letters(words: np.ndarray) -> np.ndarray:
    """A letter of ``LETTER_BITS`` bits for each word."""
    return words >> np.uint64(64 - LETTER_BITS)


def orders(word_letters: np.ndarray) -> np.ndarray:
    """Order value of the phrase at each place: its letters as one number, times an odd constant, so one to one."""
    n = len(word_letters) - PHRASE + 1
    packed = np.zeros(max(n, 0), np.uint64)
    for i in range(PHRASE):
        packed = (packed << np.uint64(LETTER_BITS)) | word_letters[i : i + len(packed)]
    return packed * ODD


def phrase_letters(order: int) -> str:
    """The letters of the phrase with this order value."""
    packed = order * int(ODD_INVERSE) % (1 << 64)
    mask = (1 << LETTER_BITS) - 1
    return "".join(
        chr(FIRST_LETTER + (packed >> (LETTER_BITS * (PHRASE - 1 - i)) & mask)) for i in range(PHRASE)
    )


def per_text(texts: pa.Array) -> Iterator[np.ndarray]:
    words, counts = hashed_words(texts)
    ends = np.cumsum(counts)
    for start, end in zip(ends - counts, ends):
        yield words[start:end]


def least_phrases(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(``phrase``, id, ``shard``) for the least phrases of every document's windows."""
    schema = T.StructType(
        [T.StructField("phrase", T.LongType()), docs.schema[id_col], T.StructField("shard", T.IntegerType())]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                found = [
                    np.unique(sliding_min(orders(letters(words)), window - PHRASE + 1)) if len(words) >= window
                    else np.zeros(0, np.uint64)
                    for words in per_text(batch.column(1))
                ]
                rows = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(found).view(np.int64)),
                        batch.column(0).take(pa.array(rows)),
                        batch.column(2).take(pa.array(rows)),
                    ],
                    names=schema.names,
                )

    return docs.select(id_col, text_col, "shard").mapInArrow(work, schema)


class Phrases:
    """Automaton over recurring phrases, and the windows that hold one."""

    def __init__(self, recurring: np.ndarray, window: int) -> None:
        self.window = window
        self.automaton = ahocorasick.Automaton()
        for order in recurring.view(np.uint64).tolist():
            self.automaton.add_word(phrase_letters(order), order)
        if len(recurring):
            self.automaton.make_automaton()

    def windows(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and least recurring phrase (``NONE`` without one) of every window of a document."""
        none = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if len(words) < self.window or not len(self.automaton):
            return none
        line = (letters(words).astype(np.uint32) + FIRST_LETTER).tobytes().decode("utf-32-le")
        hits = list(self.automaton.iter(line))
        if not hits:
            return none
        at = np.full(len(words) - PHRASE + 1, NONE, np.uint64)
        at[[end - PHRASE + 1 for end, _ in hits]] = np.array([order for _, order in hits], np.uint64)
        return grams(words, self.window), sliding_min(at, self.window - PHRASE + 1)


def wrapped(*columns: np.ndarray) -> bytes:
    """Equally long columns behind their length, byte places apart, compressed."""
    raw = b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unwrapped(data: bytes, *kinds: str) -> list[np.ndarray]:
    n, widths = int.from_bytes(data[:8], "little"), [np.dtype(k).itemsize for k in kinds]
    raw, out, at = np.frombuffer(pa.decompress(data[8:], n * sum(widths), "zstd", asbytes=True), np.uint8), [], 0
    for kind, width in zip(kinds, widths):
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


WINDOWS = "bucket int, shard int, entries binary"
#: Of a window: its hash, 16 bits of its least phrase, the least id that has it, and how far the largest is from that.
ENTRY = "<u8", "<u2", "<i8", "<i8"


def spans(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal keys begin and end."""
    edges = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
    return list(zip([0, *edges.tolist()], [*edges.tolist(), len(sorted_keys)])) if len(sorted_keys) else []


def candidate_windows(window: int, buckets: int):
    """Of one shard: its windows that can recur, each once, with the least and largest id that has it, by bucket."""

    def work(docs: pa.Table, phrases: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        shard = None
        if docs.num_rows and phrases.num_rows:
            shard = docs.column("shard")[0].as_py()
            compiled = Phrases(phrases.column("phrase").to_numpy(), window)
            ids = docs.column("id").to_numpy()
            for chunk_start in range(0, docs.num_rows, 500):
                texts = docs.column("text").slice(chunk_start, 500).combine_chunks()
                for i, words in enumerate(per_text(texts), chunk_start):
                    hashes, least = compiled.windows(words)
                    hit = least != NONE
                    if hit.any():
                        marks = mixed(least[hit]).astype(np.uint16)
                        found.append((hashes[hit], marks, np.full(len(marks), ids[i], np.int64)))
        rows = []
        if found:
            hashes, marks, owner = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((marks, hashes, hashes % np.uint64(buckets)))
            hashes, marks, owner = hashes[order], marks[order], owner[order]
            starts = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (marks[1:] != marks[:-1])])
            lo, hi = np.minimum.reduceat(owner, starts), np.maximum.reduceat(owner, starts)
            hashes, marks = hashes[starts], marks[starts]
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            rows = [(int(bucket[a]), wrapped(hashes[a:b], marks[a:b], lo[a:b], hi[a:b] - lo[a:b])) for a, b in spans(bucket)]
        return pa.table(
            {
                "bucket": pa.array([r[0] for r in rows], pa.int32()),
                "shard": pa.array([shard] * len(rows), pa.int32()),
                "entries": pa.array([r[1] for r in rows], pa.binary()),
            }
        )

    return work


FIRSTS = "shard int, firsts binary"


def first_documents(rows: pa.Table) -> pa.Table:
    """Of one bucket: for every shard the windows that an earlier document has, and that document."""
    each = [unwrapped(e.as_py(), *ENTRY) for e in rows.column("entries")]
    hashes, marks, lo, apart = (np.concatenate(c) for c in zip(*each))
    shards = np.repeat(rows.column("shard").to_numpy(), [len(e[0]) for e in each])
    order = np.lexsort((marks, hashes))
    hashes, marks, lo, hi, shards = hashes[order], marks[order], lo[order], (lo + apart)[order], shards[order]
    fresh = np.r_[True, (hashes[1:] != hashes[:-1]) | (marks[1:] != marks[:-1])]
    first = np.minimum.reduceat(lo, np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
    again = np.flatnonzero(first < hi)
    again = again[np.argsort(shards[again], kind="stable")]
    hashes, first, shards = hashes[again], first[again], shards[again]
    cuts = spans(shards)
    return pa.table(
        {
            "shard": pa.array([int(shards[a]) for a, _ in cuts], pa.int32()),
            "firsts": pa.array([wrapped(hashes[a:b], first[a:b]) for a, b in cuts], pa.binary()),
        }
    )


def remove_windows(window: int):
    """Of one shard: every document's words without those of windows that an earlier document has."""

    def work(docs: pa.Table, firsts: pa.Table) -> pa.Table:
        each = [unwrapped(f.as_py(), "<u8", "<i8") for f in firsts.column("firsts")]
        hashes = np.concatenate([np.zeros(0, np.uint64), *[e[0] for e in each]])
        first = np.concatenate([np.zeros(0, np.int64), *[e[1] for e in each]])
        order = np.lexsort((first, hashes))
        hashes, first = hashes[order], first[order]
        ids = docs.column("id").to_pylist()
        kept, counts, removed = [], [], []
        for chunk_start in range(0, docs.num_rows, 500):
            texts = docs.column("text").slice(chunk_start, 500).combine_chunks()
            if isinstance(texts, pa.ChunkedArray):
                texts = pa.concat_arrays(texts.chunks)
            values = pa.compute.fill_null(texts, "").to_pylist()
            for i, (text, words) in enumerate(zip(values, per_text(texts)), chunk_start):
                # Bytes split at the same ASCII white space.
                own = text.encode("utf-8").split()
                gone = 0
                if len(words) >= window and len(hashes) and ids[i] is not None:
                    h = grams(words, window)
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    bad = np.flatnonzero((hashes[at] == h) & (first[at] < ids[i]))
                    if len(bad):
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, bad, 1)
                        np.add.at(edge, bad + window, -1)
                        covered = np.cumsum(edge[:-1]) > 0
                        gone = int(covered.sum())
                        own = [w for w, c in zip(own, covered.tolist()) if not c]
                kept.append(b" ".join(own).decode("utf-8"))
                counts.append(len(words))
                removed.append(gone)
        return pa.table(
            {
                "id": docs.column("id"),
                "n_words": pa.array(counts, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept": pa.array(kept, pa.string()),
            }
        )

    return work


def remove_repeats(
    docs: DataFrame,
    scratch,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 50,
    shard_bytes: int = 4_000_000,
) -> DataFrame:
    """``id_col``, ``n_words``, ``n_removed`` and ``kept`` (remaining words, one space between) of every row.

    A word goes if a window of ``window`` words covers it whose words also
    start in a row with a smaller id. Rows of equal ids are not earlier than
    each other; a row without an id is earlier than none and loses nothing. A
    null text has no words. Other columns are left out. ``scratch(df)``
    writes a table to the shared folder and reads it back.

    The number of shards follows from the size of the texts, about
    ``shard_bytes`` each; a shard holds its documents and their phrases.
    """
    if window < PHRASE:
        raise ValueError(f"a window has {PHRASE} words at least")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    dealt = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("text"),
        F.pmod(F.xxhash64(id_col, text_col), F.lit(shards)).cast("int").alias("shard"),
    )
    phrases = least_phrases(dealt.where("id IS NOT NULL"), "id", "text", window)
    recurring = (
        phrases.groupBy("phrase")
        .agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.collect_set("shard").alias("shards"))
        .where("lo < hi")
        .select("phrase", F.explode("shards").alias("shard"))
    )
    by_shard = dealt.groupBy("shard")
    windows = (
        dealt.where("id IS NOT NULL").groupBy("shard").cogroup(recurring.groupBy("shard"))
        .applyInArrow(candidate_windows(window, -(-shards // 4)), WINDOWS)
    )
    firsts = scratch(windows.groupBy("bucket").applyInArrow(first_documents, FIRSTS))
    left = by_shard.cogroup(firsts.groupBy("shard")).applyInArrow(
        remove_windows(window), "id long, n_words long, n_removed long, kept string"
    )
    return left.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept")
