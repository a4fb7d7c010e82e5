"""Token ids in binary segments of patched frame-of-reference blocks.

A segment holds the ids of consecutive documents. Its bytes are, little-endian:

- header: magic ``PFR1``, block length, number of ids, number of blocks (4 x uint32);
- index, one entry for each block: uint64 byte offset of the block, uint32 minimum, uint32 number of exceptions,
  uint32 bit width (20 bytes);
- blocks: every id minus the block's minimum, packed at the width that most of them need; then, for those that need
  more, uint16 positions and uint32 differences.

The block index makes any run of ids readable without unpacking what precedes.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .pieces import PieceTable, flat_ids, joinable, read_config, run_ends_of, runs, special_pattern

MAGIC = b"PFR1"
HEADER = struct.Struct("<4sIII")
#: Blocks that are packed or unpacked together.
SLICE = 256
#: Parts that the library gets as one text.
JOINED = 1000
INDEX = np.dtype([("offset", "<u8"), ("base", "<u4"), ("exceptions", "<u4"), ("width", "<u4")])


def pack(values: np.ndarray, block: int = 1024, share: float = 0.95) -> bytes:
    """One segment of unsigned 32-bit ``values``; ``share`` of a block's differences fit the packed width."""
    if not 1 <= block <= 65536:
        raise ValueError("a block has 1 to 65536 values")
    values = np.asarray(values, np.uint32)
    n = len(values)
    blocks = -(-n // block)
    index = np.zeros(blocks, INDEX)
    bodies: list[bytes] = []
    # So many blocks at a time that their bits take some megabytes.
    for first in range(0, blocks, SLICE):
        own = values[first * block : (first + SLICE) * block]
        bodies += _packed(own, index[first : first + SLICE], block, share)
    sizes = np.fromiter(map(len, bodies), np.int64, blocks)
    index["offset"] = HEADER.size + INDEX.itemsize * blocks + np.cumsum(sizes) - sizes
    return HEADER.pack(MAGIC, block, n, blocks) + index.tobytes() + b"".join(bodies)


def _packed(values: np.ndarray, index: np.ndarray, block: int, share: float) -> list[bytes]:
    """Bodies of consecutive blocks; their entries of the index are filled in, apart from the offset."""
    blocks = len(index)
    padded = np.full(blocks * block, values[-1], np.uint32)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, block)
    index["base"] = grid.min(axis=1)
    rest = grid - index["base"][:, None]
    rank = min(block - 1, int(np.ceil(share * block)) - 1)
    typical = np.partition(rest, rank, axis=1)[:, rank].astype(np.int64)
    index["width"] = np.ceil(np.log2(typical + 1.0)).astype(np.int64)
    over = rest.astype(np.int64) >= (np.int64(1) << index["width"].astype(np.int64))[:, None]
    index["exceptions"] = over.sum(axis=1)
    bodies: list[bytes] = [b""] * blocks
    for width in np.unique(index["width"]).tolist():
        rows = np.flatnonzero(index["width"] == width)
        kept = np.where(over[rows], 0, rest[rows])
        packed = _joined(kept, width)
        for row, body in zip(rows.tolist(), packed):
            outside = np.flatnonzero(over[row])
            bodies[row] = (
                body.tobytes() + outside.astype("<u2").tobytes() + rest[row, outside].astype("<u4").tobytes()
            )
    return bodies


def _joined(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values at ``width`` bits each, lowest first; eight values make ``width`` bytes."""
    rows, n = values.shape
    groups = -(-n // 8)
    eights = np.zeros((rows, groups * 8), np.uint64)
    eights[:, :n] = values
    out = np.zeros((rows, groups, width), np.uint8)
    for k in range(8):
        first, shift = divmod(k * width, 8)
        bits = eights[:, k::8] << np.uint64(shift)
        for j in range(-(-(shift + width) // 8) if width else 0):
            out[:, :, first + j] |= (bits >> np.uint64(8 * j)).astype(np.uint8)
    return out.reshape(rows, groups * width)[:, : -(-n * width // 8)]


def _separated(packed: np.ndarray, width: int, n: int) -> np.ndarray:
    """What :func:`_joined` was given: rows of ``n`` values."""
    rows, size = packed.shape
    groups = -(-n // 8)
    padded = np.zeros((rows, groups * width), np.uint8)
    padded[:, :size] = packed
    padded = padded.reshape(rows, groups, width)
    out = np.zeros((rows, groups * 8), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for k in range(8 if width else 0):
        first, shift = divmod(k * width, 8)
        bits = np.zeros((rows, groups), np.uint64)
        for j in range(-(-(shift + width) // 8)):
            bits |= padded[:, :, first + j].astype(np.uint64) << np.uint64(8 * j)
        out[:, k::8] = (bits >> np.uint64(shift)) & mask
    return out[:, :n]


def unpack(segment: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Values ``start`` to ``stop`` of a segment; only the blocks that hold them are read."""
    magic, block, n, blocks = HEADER.unpack_from(segment)
    if magic != MAGIC:
        raise ValueError("not a segment of packed ids")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    first, last = start // block, -(-stop // block)
    index = np.frombuffer(segment, INDEX, blocks, HEADER.size)[first:last]
    grid = np.concatenate([
        _unpacked(segment, index[i : i + SLICE], block) for i in range(0, len(index), SLICE)
    ])
    return grid.ravel()[start - first * block : stop - first * block]


def _unpacked(segment: bytes, index: np.ndarray, block: int) -> np.ndarray:
    grid = np.zeros((len(index), block), np.uint32)
    for width in np.unique(index["width"]).tolist():
        rows = np.flatnonzero(index["width"] == width)
        size = -(-block * width // 8)
        raw = np.zeros((len(rows), size), np.uint8)
        for i, row in enumerate(rows.tolist()):
            raw[i] = np.frombuffer(segment, np.uint8, size, int(index["offset"][row]))
        grid[rows] = _separated(raw, width, block)
    for row in np.flatnonzero(index["exceptions"]).tolist():
        count = int(index["exceptions"][row])
        at = int(index["offset"][row]) + -(-block * int(index["width"][row]) // 8)
        places = np.frombuffer(segment, "<u2", count, at)
        grid[row, places] = np.frombuffer(segment, "<u4", count, at + 2 * count)
    return grid + index["base"][:, None]


_TABLES: dict[str, tuple[PieceTable, re.Pattern | None]] = {}


def library_table(text: str) -> tuple[PieceTable, re.Pattern | None]:
    """Ids given by the tokenizers library, one table for each tokenizer file and worker; with it its special tokens."""
    if text not in _TABLES:
        import os

        # One thread for each task: Spark already runs as many tasks as there are cores.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(text)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        special = special_pattern(json.loads(text))
        sizes = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
            sizes[i] = len(token)

        def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            return flat_ids([e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

        def learn(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Ids of the parts; to the library many parts are one text, whose ids are cut by the bytes they stand for."""
            start, length = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
            flat: list[np.ndarray] = []
            held = 0
            strings = pa.array(parts, pa.string())
            joins = joinable(strings)
            alone = np.flatnonzero(~joins).tolist()
            reach = pc.binary_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)

            def keep(rows, ids: np.ndarray, lengths: np.ndarray) -> None:
                nonlocal held
                start[rows] = np.cumsum(lengths) - lengths + held
                length[rows] = lengths
                flat.append(ids)
                held += len(ids)

            together = np.flatnonzero(joins)
            for first in range(0, len(together), JOINED):
                rows = together[first : first + JOINED]
                joined = "".join([parts[i] for i in rows.tolist()])
                ids, _ = encode([joined])
                reached, ends = np.cumsum(sizes[ids]), np.cumsum(reach[rows])
                last = np.searchsorted(reached, ends)
                whole = len(ids) and reached[-1] == ends[-1] and (reached[last] == ends).all()
                if not whole or (special is not None and special.search(joined)):
                    alone += rows.tolist()
                else:
                    keep(rows, ids, np.diff(last + 1, prepend=0))
            for first in range(0, len(alone), 2000):
                rows = alone[first : first + 2000]
                keep(rows, *encode([parts[i] for i in rows]))
            return np.concatenate(flat), start, length

        _TABLES[text] = PieceTable(learn, limit=500_000), special
    return _TABLES[text]


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    segment_ids: int = 65_536,
) -> None:
    """Write the ids of every text, each followed by ``end_id``, in ascending order of ``id_col``.

    The range partitions of the ids are the files, named by ``part``, and follow each other. A row of a file is
    a segment: whole documents until there are ``segment_ids`` ids, their keys
    and lengths, and ``start``, the ids before it in the same file. A null
    text counts as empty; null keys come first; rows of equal key are ordered
    by a hash of their text, then the text. Other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_config(vocabulary))
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("segment", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("n_ids", T.LongType()),
            T.StructField("keys", T.ArrayType(docs.schema[id_col].dataType)),
            T.StructField("lengths", T.ArrayType(T.LongType())),
            T.StructField("packed", T.BinaryType()),
        ]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        table, special = library_table(shared.value)
        keys: list = []
        chunks: list[np.ndarray] = []
        lengths: list[int] = []
        segment = start = size = 0

        def close() -> pa.RecordBatch:
            columns = [[part], [segment], [start], [size], [keys], [lengths], [pack(np.concatenate(chunks))]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa_type) for c, pa_type in zip(columns, types)], names=schema.names
            )

        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), None, pa.list_(pa.int64()), pa.binary()]
        for batch in batches:
            types[4] = pa.list_(batch.schema.field(0).type)
            own = batch.column(0).to_pylist()
            for first, taken in runs(batch.column(1), 16_000_000):
                ids, counts = table.encode(*run_ends_of(taken, special))
                ends = np.cumsum(counts)
                for i in range(len(taken)):
                    keys.append(own[first + i])
                    chunks.append(np.append(ids[ends[i] - counts[i] : ends[i]], end_id))
                    lengths.append(int(counts[i]) + 1)
                    size += lengths[-1]
                    if size >= segment_ids:
                        yield close()
                        segment, start, size = segment + 1, start + size, 0
                        keys, chunks, lengths = [], [], []
        if keys:
            yield close()

    # Rows of one key are spread by a hash of their text; the sample of range bounds must not hold texts.
    keys = [F.col(id_col), F.xxhash64(text_col)]
    ordered = docs.select(id_col, text_col).repartitionByRange(*keys).sortWithinPartitions(*keys, text_col)
    ordered.mapInArrow(work, schema).write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Documents of the files at ``path``: key, ``start`` over all files, ``n_tokens`` and ``ids`` (binary uint32)."""
    files = spark.read.parquet(path)
    # One row for each file: how many ids precede it.
    before = files.groupBy("part").agg(F.sum("n_ids").alias("_ids")).select(
        "part",
        F.coalesce(
            F.sum("_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField(id_col, files.schema["keys"].dataType.elementType),
            T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, start = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                keys = batch.column(2)[i].values
                lengths = np.array(batch.column(3)[i].as_py(), np.int64)
                values = unpack(batch.column(4)[i].as_py()).astype("<u4")
                ends = np.cumsum(lengths)
                # Arrow's 32-bit offsets: one document of a segment is below 2 GB.
                data = [values[e - n : e].tobytes() for n, e in zip(lengths, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(keys), pa.int32()), keys, pa.array(start + ends - lengths),
                     pa.array(lengths), pa.array(data, pa.binary())],
                    names=schema.names,
                )

    rows = files.select("part", "start", "keys", "lengths", "packed").mapInArrow(work, schema)
    placed = rows.join(F.broadcast(before), "part")
    return placed.select(id_col, (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents as read, with the CRC-32 of their ids in place of the ids."""
    return tokens.select(id_col, "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids).astype("<u4").tobytes())
