"""Byte-level BPE over a rank file, by dynamic programming over byte prefixes.

Every prefix of a piece has exactly one encoding and so exactly one last
token. Token ``t`` is the last token of a prefix when it is a suffix of it and
merging the bytes of ``p`` and ``t`` alone gives ``p`` and ``t`` again, ``p``
being the last token of what precedes: no merge ever crosses a border between
two tokens of a result, and what happens on either side of a border depends on
nothing beyond it. So the last tokens of all prefixes, kept as a
:class:`PrefixTable`, allow

- exact appends: the entries of a prefix never change;
- edits: entries before the edit stay, and once as many entries in a row as
  the longest token has bytes equal the old ones, all later ones stay too.

Ranks are merge priorities: of all neighbours whose joined bytes have a rank,
the pair of the lowest rank, leftmost first, is joined. A piece that is itself
a token is that token.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .pieces import SETTLED, PieceTable, flat_ids, runs, spaced_words_of

NEVER = 1 << 60


class Ranks:
    """Tokens of a rank file, an automaton over them and the pair tests met so far."""

    def __init__(self, lines: bytes) -> None:
        self.rank: dict[bytes, int] = {
            base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token
        }
        missing = [b for b in range(256) if bytes([b]) not in self.rank]
        if missing:
            raise ValueError(f"no token for the bytes {missing}")
        self.token = {rank: token for token, rank in self.rank.items()}
        self.longest = max(map(len, self.rank))
        # The automaton takes strings: one character stands for one byte.
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self._fits: dict[int, bool] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Ranks that merging from single bytes leaves; used for pair tests on at most two tokens."""
        rank = self.rank
        parts = [piece[i : i + 1] for i in range(len(piece))]
        joined = [rank.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while joined:
            best = min(joined)
            if best == NEVER:
                break
            at = joined.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = rank.get(parts[at - 1] + parts[at], NEVER)
            if at < len(joined):
                joined[at] = rank.get(parts[at] + parts[at + 1], NEVER)
        return [rank[p] for p in parts]

    def follows(self, before: int, after: int) -> bool:
        """``after`` can stand behind ``before`` (-1: the start of a piece) in a result."""
        key = (before + 1) << 32 | after
        found = self._fits.get(key)
        if found is None:
            if len(self._fits) > 400_000:
                self._fits.clear()
            if before < 0:
                found = self.merged(self.token[after]) == [after]
            else:
                found = self.merged(self.token[before] + self.token[after]) == [before, after]
            self._fits[key] = found
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        return [whole] if whole is not None else PrefixTable(self, piece).ids()


class PrefixTable:
    """The last token of every non-empty prefix of ``data``: ``last[i]`` ends at byte ``i`` and begins at ``begin[i]``."""

    def __init__(self, ranks: Ranks, data: bytes = b"") -> None:
        self.ranks = ranks
        self.data = b""
        self.last: list[int] = []
        self.begin: list[int] = []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; entries of the old prefixes are not touched."""
        old = len(self.data)
        self.data += more
        last, begin = self._settled(old, len(self.data))
        self.last += last
        self.begin += begin

    def replace(self, start: int, stop: int, by: bytes) -> int:
        """Put ``by`` in place of bytes ``start`` to ``stop``; returns how many entries were computed anew."""
        if not 0 <= start <= stop <= len(self.data):
            raise ValueError("the edit lies outside the text")
        tail = self.data[stop:]
        old_last, old_begin = self.last[stop:], self.begin[stop:]
        self.data = self.data[:start] + by + tail
        del self.last[start:], self.begin[start:]
        shift = start + len(by) - stop
        at, same = start, 0
        fixed = start + len(by)
        while at < len(self.data):
            until = min(len(self.data), max(fixed, at) + self.ranks.longest)
            last, begin = self._settled(at, until)
            self.last += last
            self.begin += begin
            for i in range(max(at, fixed), until):
                j = i - fixed
                # An entry that begins before the edit is the same only if its bytes are.
                equal = self.last[i] == old_last[j] and self.begin[i] >= fixed
                same = same + 1 if equal else 0
                if same >= self.ranks.longest:
                    self.last[i + 1 :] = old_last[j + 1 :]
                    self.begin[i + 1 :] = [b + shift for b in old_begin[j + 1 :]]
                    return i + 1 - start
            at = until
        return len(self.data) - start

    def _settled(self, first: int, until: int) -> tuple[list[int], list[int]]:
        """Entries ``first`` to ``until``, those before ``first`` being known."""
        follows, known = self.ranks.follows, len(self.last)
        last = [-1] * (until - first)
        begin = [0] * (until - first)
        # A token that ends in the new part can begin this much earlier.
        from_byte = max(0, first - self.ranks.longest)
        part = self.data[from_byte:until].decode("latin-1")
        for end, (length, token) in self.ranks.automaton.iter(part):
            i = from_byte + end
            if i < first or last[i - first] >= 0:
                continue
            start = i + 1 - length
            before = -1 if not start else self.last[start - 1] if start <= known else last[start - 1 - first]
            if follows(before, token):
                last[i - first], begin[i - first] = token, start
        return last, begin

    def ids(self, stop: int | None = None) -> list[int]:
        """The encoding of the first ``stop`` bytes (all of them by default)."""
        out: list[int] = []
        at = len(self.data) if stop is None else stop
        while at > 0:
            out.append(self.last[at - 1])
            at = self.begin[at - 1]
        return out[::-1]


class Splitter:
    """Matches of a pattern, as the tiktoken library finds them.

    Characters that library versions may classify differently are asked of
    the library one by one; a settled character of the same class then stands
    for each while the text is cut.
    """

    #: Stand-ins by class: letter, number, white space, other.
    CLASSES = ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", "\t"))

    def __init__(self, pattern: str) -> None:
        import tiktoken

        self.find = regex.compile(pattern)
        single = {bytes([b]): b for b in range(256)}
        self._class_of = [
            (tiktoken.Encoding(f"class{i}", pat_str=p, mergeable_ranks=single, special_tokens={}), stand_in)
            for i, (p, stand_in) in enumerate(self.CLASSES)
        ]
        self._stand_in: dict[int, str] = {}

    def __call__(self, text: str) -> list[str]:
        odd = SETTLED.search(text)
        if odd is None:
            return self.find.findall(text)
        for c in set(SETTLED.findall(text)):
            if ord(c) not in self._stand_in:
                self._stand_in[ord(c)] = next((s for e, s in self._class_of if e.encode_ordinary(c)), "!")
        return [text[m.start() : m.end()] for m in self.find.finditer(text.translate(self._stand_in))]


class ByteCodec:
    """Encoder and decoder of one rank file and pattern."""

    def __init__(self, lines: bytes, pattern: str) -> None:
        self._lines, self._ranks = lines, None
        self.split = Splitter(pattern)
        pieces: dict[str, list[int]] = {}

        def learn(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if len(pieces) > 150_000:
                pieces.clear()
            out = []
            for part in parts:
                ids: list[int] = []
                for piece in self.split(part):
                    found = pieces.get(piece)
                    if found is None:
                        found = pieces[piece] = self.ranks.encode_piece(piece.encode("utf-8"))
                    ids += found
                out.append(ids)
            ids_of_all, lengths = flat_ids(out)
            return ids_of_all, np.cumsum(lengths) - lengths, lengths

        self.table = PieceTable(learn, limit=400_000)
        size = max(self.ranks.token) + 1
        self.names = pa.array([self.ranks.token.get(i, b"") for i in range(size)], pa.large_binary())

    @property
    def ranks(self) -> Ranks:
        if self._ranks is None:
            self._ranks = Ranks(self._lines)
        return self._ranks

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and how many each text has; a text with unsettled characters is cut as a whole."""
        return self.table.encode(*spaced_words_of(texts, SETTLED))

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
        """The bytes of consecutive runs of ids; ids that the rank file lacks give none."""
        inside = (ids >= 0) & (ids < len(self.names))
        tokens = pc.fill_null(self.names.take(pa.array(np.where(inside, ids, 0), mask=~inside)), b"")
        # The tokens stand in one buffer already: only the borders of the runs are new.
        ends = np.frombuffer(tokens.buffers()[1], np.int64, len(tokens) + 1, 8 * tokens.offset)
        borders = ends[np.concatenate([[0], np.cumsum(lengths)])]
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(lengths), [None, pa.py_buffer(borders.astype(np.int64)), tokens.buffers()[2]]
        )


_CODECS: dict[tuple[bytes, str], ByteCodec] = {}


def codec(lines: bytes, pattern: str) -> ByteCodec:
    """One codec for each rank file, pattern and worker process."""
    if (lines, pattern) not in _CODECS:
        _CODECS[lines, pattern] = ByteCodec(lines, pattern)
    return _CODECS[lines, pattern]


def _shared(df: DataFrame, ranks_path: str):
    with open(ranks_path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def _as_lists(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))


def _as_bytes(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Every run of ids as little-endian unsigned 32-bit integers."""
    borders = 4 * np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    flat = pa.py_buffer(np.ascontiguousarray(ids, "<u4"))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(borders), flat])


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens`` (long) and ``ids`` (array of int) of every text, one row for each row.

    A null text counts as empty and has no ids; null ids, repeated rows and
    equal ids are kept as they are; an empty table gives an empty one. Other
    columns are left out, so no name can clash. ``ranks_path`` is a rank file
    on the driver; executors get its content, whose size is that of one
    vocabulary. A text is held by one task as a whole.
    """
    shared = _shared(docs, ranks_path)
    schema = T.StructType(
        [docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            for first, taken in runs(batch.column(1)):
                ids, lengths = own.encode(taken)
                keys = batch.column(0).slice(first, len(taken))
                yield pa.RecordBatch.from_arrays([keys, pa.array(lengths), _as_lists(ids, lengths)], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(work, schema)


def decode(
    encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out: str = "decoded"
) -> DataFrame:
    """``encoded`` with the bytes of every row of ids as column ``out`` (replaced if there).

    Null ids give null, an empty row of ids gives no bytes; ids that the rank
    file lacks, and nulls among the ids, are passed over.
    """
    shared = _shared(encoded, ranks_path)
    plain = encoded.drop(out) if out in encoded.columns else encoded
    at = plain.columns.index(ids_col)
    schema = T.StructType([*plain.schema.fields, T.StructField(out, T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                lists = batch.column(at)
                lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                texts = own.decode(ids, lengths).cast(pa.binary())
                texts = pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=schema.names)

    return plain.mapInArrow(work, schema)


def round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``encode`` and ``decode`` in one pass: ``id_col``, ``n_tokens``, ``packed`` and ``decoded`` (both binary).

    ``packed`` holds the ids as little-endian unsigned 32-bit integers. Nulls,
    repeats, empty tables and other columns as for :func:`encode`.
    """
    shared = _shared(docs, ranks_path)
    schema = T.StructType(
        [
            docs.schema[id_col],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("packed", T.BinaryType()),
            T.StructField("decoded", T.BinaryType()),
        ]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            for first, taken in runs(batch.column(1)):
                ids, lengths = own.encode(taken)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(taken)),
                        pa.array(lengths),
                        _as_bytes(ids, lengths).cast(pa.binary()),
                        own.decode(ids, lengths).cast(pa.binary()),
                    ],
                    names=schema.names,
                )

    return docs.select(id_col, text_col).mapInArrow(work, schema)


def reencode(
    edits: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    start_col: str = "start",
    stop_col: str = "stop",
    by_col: str = "replacement",
) -> DataFrame:
    """Texts and ids after an edit each: ``id_col``, ``edited``, ``ids``, ``n_settled`` (bytes whose last token was computed anew).

    Characters ``start`` to ``stop`` of a text are replaced; bounds beyond the
    text are moved to its ends, a stop before the start counts as the start,
    null bounds are the text's end, null texts and replacements are empty.
    Pieces before the one that the edit touches, and pieces from the first
    border on that both texts share, keep their ids; of the pieces between,
    prefix tables are edited in place.
    """
    shared = _shared(edits, ranks_path)
    schema = T.StructType(
        [
            edits.schema[id_col],
            T.StructField("edited", T.StringType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("n_settled", T.LongType()),
        ]
    )

    def one(own: ByteCodec, text: str, start: int | None, stop: int | None, by: str) -> tuple[str, list[int], int]:
        start = len(text) if start is None else min(max(start, 0), len(text))
        stop = len(text) if stop is None else min(max(stop, start), len(text))
        edited = text[:start] + by + text[stop:]
        before, after = own.split(text), own.split(edited)
        # Pieces that both texts begin with, and pieces that both end with.
        head = 0
        for a, b in zip(before, after):
            if a != b:
                break
            head += 1
        tail = 0
        for a, b in zip(reversed(before[head:]), reversed(after[head:])):
            if a != b:
                break
            tail += 1
        ids: list[int] = []
        for piece in after[:head]:
            ids += own.ranks.encode_piece(piece.encode("utf-8"))
        settled = 0
        old, new = before[head : len(before) - tail], after[head : len(after) - tail]
        if len(old) == 1 and len(new) == 1:
            # The edit lies within one piece: its prefix table is edited.
            a, b = old[0].encode("utf-8"), new[0].encode("utf-8")
            same = 0
            while same < min(len(a), len(b)) and a[same] == b[same]:
                same += 1
            ends = 0
            while ends < min(len(a), len(b)) - same and a[len(a) - 1 - ends] == b[len(b) - 1 - ends]:
                ends += 1
            table = PrefixTable(own.ranks, a)
            settled = table.replace(same, len(a) - ends, b[same : len(b) - ends])
            whole = own.ranks.rank.get(b)
            ids += [whole] if whole is not None else table.ids()
        else:
            for piece in new:
                data = piece.encode("utf-8")
                settled += len(data)
                ids += own.ranks.encode_piece(data)
        for piece in after[len(after) - tail :]:
            ids += own.ranks.encode_piece(piece.encode("utf-8"))
        return edited, ids, settled

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for whole in batches:
            for first in range(0, whole.num_rows, 100):
                batch = whole.slice(first, 100)
                columns = [batch.column(i).to_pylist() for i in range(1, 5)]
                done = [one(own, t or "", a, b, by or "") for t, a, b, by in zip(*columns)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([d[0] for d in done], pa.string()),
                        pa.array([d[1] for d in done], pa.list_(pa.int32())),
                        pa.array([d[2] for d in done], pa.int64()),
                    ],
                    names=schema.names,
                )

    return edits.select(id_col, text_col, start_col, stop_col, by_col).mapInArrow(work, schema)
