"""Byte-pair encoding and decoding by dynamic programming over prefixes.

Every prefix of a word has exactly one encoding, so exactly one last token.
Token ``t`` is the last token of a prefix when it is a suffix of it and the
last token ``p`` of what precedes is compatible: merging the text of ``p`` and
``t`` from scratch gives ``p`` and ``t`` again. An automaton over the
vocabulary lists the tokens that end at each character; the last tokens are
stored with the place where they begin, and following those places backwards
emits the ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import (
    BYTE_CHARACTER,
    CHARACTER_BYTE,
    Cutter,
    PieceTable,
    flat_ids,
    read_config,
    runs,
    spaced_words_of,
    to_symbols,
    words_of,
)

#: A character that ends a word is moved up by this much, so that it is a symbol of its own.
WORD_END = 0x1000
NEVER = 1 << 60


class PairMerges:
    """A merge table with the tests that the dynamic programme needs."""

    def __init__(self, config: dict) -> None:
        model = config["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("only plain byte-pair vocabularies are supported")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids = {self._inner(token): i for token, i in model["vocab"].items()}
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(self._inner(a), self._inner(b)): r for r, (a, b) in enumerate(pairs)}
        self._check_order()
        self.token = {i: symbols for symbols, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for symbols, i in self.ids.items():
            self.automaton.add_word(symbols, (len(symbols), i))
        self.automaton.make_automaton()
        self.edges: dict[int, tuple | None] = {}
        self.fits: dict[int, bool] = {}

    def _inner(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + WORD_END)
        return token

    def _check_order(self) -> None:
        """Merges use only symbols of earlier merges, and every byte is a token: the method relies on both."""
        made: set[str] = set()
        for left, right in self.rank:
            if (len(left) > 1 and left not in made) or (len(right) > 1 and right not in made):
                raise ValueError(f"merge {left!r} {right!r} uses a symbol that no earlier merge makes")
            made.add(left + right)
        for c in BYTE_CHARACTER:
            if c not in self.ids or (self.suffix and chr(ord(c) + WORD_END) not in self.ids):
                raise ValueError(f"no token for the byte {c!r}")

    def _outline(self, token: int) -> tuple | None:
        """What the token's two ends look like while it is merged; None if merging its text gives something else.

        Each end is a list of (symbol, rank of the merge that takes it in).
        """
        parts = list(self.token[token])
        left: list[tuple[str, int]] = []
        right: list[tuple[str, int]] = []
        while len(parts) > 1:
            ranks = [self.rank.get(pair, NEVER) for pair in zip(parts, parts[1:])]
            best = min(ranks)
            if best == NEVER:
                return None
            at = ranks.index(best)
            if at == 0:
                left.append((parts[0], best))
            if at == len(parts) - 2:
                right.append((parts[-1], best))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if self.ids.get(parts[0]) != token:
            return None
        return [*left, (parts[0], NEVER)], [*right, (parts[0], NEVER)]

    def compatible(self, before: int, after: int) -> bool:
        """Merging the two texts together never joins them across their border.

        A pair across the border is joined if its rank comes while both its
        symbols are still there. At equal rank the pair further left is joined
        first. A token that its own text does not give is compatible with none.
        """
        if before not in self.edges:
            self.edges[before] = self._outline(before)
        if after not in self.edges:
            self.edges[after] = self._outline(after)
        if self.edges[before] is None or self.edges[after] is None:
            return False
        rank = self.rank
        for x, gone_x in self.edges[before][1]:
            for y, gone_y in self.edges[after][0]:
                joined = rank.get((x, y))
                if joined is not None and joined < gone_x and joined <= gone_y:
                    return False
        return True

    def whole(self, token: int) -> bool:
        """Merging the token's own text gives the token."""
        if token not in self.edges:
            self.edges[token] = self._outline(token)
        return self.edges[token] is not None

    def encode(self, symbols: str) -> list[int]:
        """Token ids of one word given in inner symbols."""
        fits = self.fits
        if len(fits) > 400_000:
            fits.clear()
        # By last character of the prefix; before the first stands -1, which every whole token follows.
        last = [-2] * len(symbols) + [-1]
        begin = [0] * len(symbols)
        for end, (length, token) in self.automaton.iter(symbols):
            if last[end] == -2:
                start = end - length
                key = last[start] << 32 | token
                good = fits.get(key)
                if good is None:
                    good = fits[key] = self.compatible(last[start], token) if start >= 0 else self.whole(token)
                if good:
                    last[end], begin[end] = token, start
        out: list[int] = []
        at = len(symbols) - 1
        while at >= 0:
            out.append(last[at])
            at = begin[at]
        return out[::-1]

    def encode_piece(self, piece: str) -> list[int]:
        symbols = to_symbols(piece)
        if self.suffix:
            symbols = symbols[:-1] + chr(ord(symbols[-1]) + WORD_END)
        return self.encode(symbols)


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, text: str) -> None:
        from tokenizers import Tokenizer

        self.config = json.loads(text)
        cut = self.config["pre_tokenizer"]
        lower = self.config.get("normalizer") is not None
        if cut["type"] == "Sequence":
            pattern = cut["pretokenizers"][0]["pattern"]["Regex"]
        else:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        self.cutter = Cutter(Tokenizer.from_str(text), self.config, pattern, lower)
        special = {" " + content: [i] for content, i in self.cutter.special.items()}
        self.drops_space = bool(self.config["model"].get("end_of_word_suffix"))
        self.merges: PairMerges | None = None
        known: dict[str, list[int]] = {}

        def learn(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if len(known) > 150_000:
                known.clear()
            if self.merges is None:
                self.merges = PairMerges(self.config)
            out = []
            for part in parts:
                ids: list[int] = []
                for piece in self.cutter(part):
                    found = known.get(piece)
                    if found is None:
                        found = known[piece] = special.get(piece) or self.merges.encode_piece(piece)
                    ids += found
                out.append(ids)
            ids_of_all, lengths = flat_ids(out)
            return ids_of_all, np.cumsum(lengths) - lengths, lengths

        self.table = PieceTable(learn, limit=400_000)
        names = self.config["model"]["vocab"] | self.cutter.special
        self.names = np.full(max(names.values()) + 1, None, object)
        for name, i in names.items():
            self.names[i] = name
        self.bytes = self.config.get("decoder") is not None
        self.special_ids = set(self.cutter.special.values())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = words_of(texts) if self.drops_space else spaced_words_of(texts, self.cutter.at_special)
        return self.table.encode(*parts)

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids; ids that the vocabulary lacks are passed over."""
        known = (ids >= 0) & (ids < len(self.names))
        names = np.where(known, self.names[np.where(known, ids, 0)], None).tolist()
        ends = np.cumsum(lengths).tolist()
        out = []
        for start, end in zip([0, *ends[:-1]], ends):
            tokens = [name for name in names[start:end] if name is not None]
            out.append(self._bytes_of(tokens) if self.bytes else " ".join(tokens))
        return out

    def _bytes_of(self, tokens: list[str]) -> str:
        raw = bytearray()
        for token in tokens:
            inside = [CHARACTER_BYTE.get(c) for c in token]
            raw += token.encode("utf-8") if None in inside else bytes(inside)
        return raw.decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(text: str) -> Codec:
    """One codec for each tokenizer file and worker process."""
    if text not in _CODECS:
        _CODECS[text] = Codec(text)
    return _CODECS[text]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text: ``id_col``, ``n_tokens`` (long) and ``ids`` (array of int), one row for each row.

    A null text counts as empty and has no ids; a null id and repeated rows
    are kept. Other columns are left out, so none can clash. ``vocabulary`` is
    a tokenizer file on the driver; executors get its content.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_config(vocabulary))
    schema = T.StructType(
        [docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            keys = batch.column(0)
            for first, taken in runs(batch.column(1)):
                ids, lengths = own.encode(taken)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(first, len(taken)),
                        pa.array(lengths),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32())),
                    ],
                    names=schema.names,
                )

    return docs.select(id_col, text_col).mapInArrow(work, schema)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of every row of ids, special tokens included, as column ``out`` (replaced if there).

    Null ids give a null text, an empty row of ids an empty text.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(read_config(vocabulary))
    plain = encoded.drop(out) if out in encoded.columns else encoded
    at = plain.columns.index(ids_col)
    schema = T.StructType([*plain.schema.fields, T.StructField(out, T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                lists = batch.column(at)
                lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                texts = pa.array(own.decode(ids, lengths), pa.string())
                texts = pa.compute.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=schema.names)

    return plain.mapInArrow(work, schema)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` and then ``decode`` in one pass: ``id_col``, ``n_tokens``, ``ids``, ``decoded``."""
    shared = docs.sparkSession.sparkContext.broadcast(read_config(vocabulary))
    schema = T.StructType(
        [
            docs.schema[id_col],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("decoded", T.StringType()),
        ]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            for first, taken in runs(batch.column(1)):
                ids, lengths = own.encode(taken)
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(taken)),
                        pa.array(lengths),
                        lists,
                        pa.array(own.decode(ids, lengths), pa.string()),
                    ],
                    names=schema.names,
                )

    return docs.select(id_col, text_col).mapInArrow(work, schema)


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The round trip of every text, reduced to counts and SHA-256 sums."""
    return round_trip(docs, vocabulary, id_col, text_col).select(
        id_col,
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
