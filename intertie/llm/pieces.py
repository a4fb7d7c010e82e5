"""Text pieces of a byte-level vocabulary and a bounded table of their token ids."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Characters that the installed regular-expression and tokenizer libraries classify alike whatever their Unicode
#: version. A text with any other character is cut into pieces by the tokenizer library itself.
SETTLED = re.compile(
    "[^\x00-ԯ -⁯₠-₿぀-ヿ一-鿿가-힣\U0001f300-\U0001f64f]"
)


#: Composed letters without a special case in lower-casing, when they are letters at all.
LATIN = re.compile("[A-Za-z\u00c0-\u012f\u0131-\u024f]+")
#: White space to Python but not to the tokenizer library.
SEPARATORS = re.compile(r"[\x1c-\x1f]")
#: White space, then signs, then letters and digits, as far as each goes; no piece spans the end of such a part.
SPACED = re.compile(r"\s*(?:[^\w\s]|_)*[^\W_]+|\s*(?:[^\w\s]|_)+|\s+")


def _flat(parts: list[list[str]]) -> tuple[pa.Array, np.ndarray]:
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    return pa.array(list(chain.from_iterable(parts)), pa.string()), counts


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Parts between white space, and how many there are in each text.

    Merges that drop white space treat each part alone. A part can be empty.
    """
    if pc.any(pc.match_substring_regex(texts, SEPARATORS.pattern)).as_py():
        return _flat([[t] if SEPARATORS.search(t) else t.split() for t in texts.to_pylist()])
    parts = pc.utf8_split_whitespace(texts)
    return parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)


def spaced_words_of(texts: pa.Array, special: re.Pattern | None = None) -> tuple[pa.Array, np.ndarray]:
    """Parts that together are a text: white space, signs, letters and digits in turn, ending before the next turn.

    No piece goes on after letters or digits into something else, so each
    part is cut into the same pieces alone as within the text. A text with a
    special token is one part.
    """
    whole = lambda t: SEPARATORS.search(t) or (special is not None and special.search(t))
    return _flat([[t] if whole(t) else SPACED.findall(t) for t in texts.to_pylist()])


#: Bytes whose longer characters are looked up together.
CHUNK = 1 << 20
#: For each byte: a letter or digit of one byte, another such character, the first of a longer one, or a later byte of one.
OTHER, ALNUM, FIRST, LATER = range(4)
BYTE_KIND = bytes([ALNUM if chr(b).isalnum() else OTHER for b in range(128)] + [LATER] * 64 + [FIRST] * 64)


@cache
def letters_and_digits() -> np.ndarray:
    """Whether each settled character is a letter or digit."""
    found = np.zeros(0x110000, bool)
    found[:0x1F650] = [unicodedata.category(chr(c))[0] in "LN" for c in range(0x1F650)]
    return found


def run_ends_of(texts: pa.Array, special: re.Pattern | None = None) -> tuple[pa.Array, np.ndarray]:
    """Parts that together are a text, each ending with a run of letters and digits or with the text.

    Fewer and longer than :func:`spaced_words_of` gives, and cut for the same
    reason. A text with a special token or with characters outside ``SETTLED``
    is one part. The parts share the memory of the texts, which must not be null.
    """
    if pc.any(pc.match_substring_regex(texts, SEPARATORS.pattern)).as_py():
        return spaced_words_of(texts, special)
    whole = pc.match_substring_regex(texts, SETTLED.pattern)
    if special is not None:
        whole = pc.or_(whole, pc.match_substring_regex(texts, special.pattern))
    whole = whole.to_numpy(zero_copy_only=False)
    if not len(texts):
        return texts, np.zeros(0, np.int64)
    starts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2] if starts[-1] > starts[0] else pa.py_buffer(b"")
    data = data.slice(int(starts[0]), int(starts[-1] - starts[0])) if data.size else data
    starts -= starts[0]
    kind = _kinds(data)
    ends = np.zeros(len(kind) + 1, bool)
    ends[1:-1] = kind[:-1] > kind[1:]
    for i in np.flatnonzero(whole).tolist():
        ends[starts[i] : starts[i + 1]] = False
    ends[starts] = True
    ends = np.flatnonzero(ends)
    parts = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), data)
    return parts, np.diff(np.searchsorted(ends, starts))


def _kinds(data: pa.Buffer) -> np.ndarray:
    """For each byte of UTF-8 whether its character is a letter or digit."""
    known = letters_and_digits()
    raw = np.frombuffer(data, np.uint8)
    kind = np.frombuffer(bytearray(data).translate(BYTE_KIND), np.uint8)
    for first in range(0, len(raw), CHUNK):
        at = np.flatnonzero(kind[first : first + CHUNK] == FIRST) + first
        lead = raw[at].astype(np.int64)
        length = 2 + (lead >= 0xE0) + (lead >= 0xF0)
        code = lead & (0x3F >> (length - 1))
        for k in (1, 2, 3):
            code = np.where(length > k, code << 6 | raw[np.minimum(at + k, len(raw) - 1)] & 0x3F, code)
        kind[at] = known[code]
        for k in (1, 2, 3):
            kind[at[length > k] + k] = known[code[length > k]]
    return kind


def joinable(parts: pa.Array) -> np.ndarray:
    """Parts that, one after the other, are cut as each alone: from another character to a letter or digit."""
    ends = pc.match_substring_regex(parts, r"(?s)^[^\p{L}\p{N}].*[\p{L}\p{N}]$")
    settled = pc.invert(pc.match_substring_regex(parts, SETTLED.pattern))
    return pc.and_(ends, settled).to_numpy(zero_copy_only=False)


def special_pattern(config: dict) -> re.Pattern | None:
    """Matches any special token of a tokenizer file, the longest first."""
    tokens = config.get("added_tokens") or []
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in tokens):
        raise ValueError("special tokens with options are not supported")
    contents = sorted((t["content"] for t in tokens), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, contents)) + ")") if contents else None


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


BYTE_CHARACTER = byte_characters()
CHARACTER_BYTE = {c: b for b, c in enumerate(BYTE_CHARACTER)}


def to_symbols(piece: str) -> str:
    if piece.isascii() and piece.isprintable() and " " not in piece:
        return piece
    return "".join([BYTE_CHARACTER[b] for b in piece.encode("utf-8")])


def from_symbols(symbols: str) -> str:
    return bytes([CHARACTER_BYTE[c] for c in symbols]).decode("utf-8")


class Cutter:
    """Cuts texts into the pieces within which merges happen.

    Special tokens are found first, in the raw text; they come out as a space
    followed by the token. ``pattern`` cuts what lies between them. With
    ``lower``, that is first composed (NFC) and lower-cased character by
    character. ``tokenizer`` cuts texts with characters outside ``SETTLED``.
    """

    def __init__(self, tokenizer, config: dict, pattern: str, lower: bool) -> None:
        self.special: dict[str, int] = {t["content"]: t["id"] for t in config.get("added_tokens") or []}
        self.at_special = special_pattern(config)
        self.find = regex.compile(pattern).findall
        self.lower = lower
        self.tokenizer = tokenizer

    def __call__(self, text: str) -> list[str]:
        if self.lower and text.isalpha() and LATIN.fullmatch(text):
            return [text.lower()]
        if self.at_special is None or not self.at_special.search(text):
            return self._plain(text)
        parts = self.at_special.split(text)
        return list(chain.from_iterable([" " + p] if i % 2 else self._plain(p) for i, p in enumerate(parts)))

    def _plain(self, text: str) -> list[str]:
        if not text:
            return []
        if text.isascii():
            return self.find(text.lower() if self.lower else text)
        if SETTLED.search(text):
            normal = self.tokenizer.normalizer
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal.normalize_str(text) if normal else text)
            return [from_symbols(symbols) for symbols, _ in cut]
        if self.lower:
            # A capital sigma becomes the same letter wherever it stands, as each character is lowered alone.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.find(text)


class PieceTable:
    """Token ids of the pieces met so far, kept flat.

    Once it holds ``limit`` pieces, those met in one batch only go; if that leaves more than half, it starts over.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]], limit: int = 400_000) -> None:
        self.learn = learn
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.met = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.int32)

    def _shrink(self) -> None:
        kept = np.flatnonzero(self.met > 1)
        if len(kept) > self.limit // 2:
            return self._clear()
        place = np.full(len(self.met), -1, np.int64)
        place[kept] = np.arange(len(kept))
        self.index = {p: k for p, k in zip(self.index, place.tolist()) if k >= 0}
        self.flat = self.flat[_spans(self.start[kept], self.length[kept])]
        self.length = self.length[kept]
        self.start = np.cumsum(self.length) - self.length
        # Kept pieces must be met again to stay the next time.
        self.met = np.ones(len(kept), np.int32)

    def encode(self, pieces: pa.Array, per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all documents in one array, and the number of ids of each document.

        ``pieces`` are those of all documents in turn, ``per_doc`` of them from each.
        """
        if len(self.index) > self.limit:
            self._shrink()
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        rows = np.fromiter(map(self.index.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(rows < 0)
        if len(new):
            unseen = [distinct[i] for i in new.tolist()]
            found, starts, lengths = self.learn(unseen)
            rows[new] = np.arange(len(self.start), len(self.start) + len(unseen))
            self.index.update(zip(unseen, rows[new].tolist()))
            self.start = np.concatenate([self.start, starts + len(self.flat)])
            self.length = np.concatenate([self.length, lengths])
            self.met = np.concatenate([self.met, np.zeros(len(unseen), np.int32)])
            self.flat = np.concatenate([self.flat, found])
        self.met[rows] += 1
        at = rows[coded.indices.to_numpy(zero_copy_only=False)]
        counts = self.length[at]
        ends = np.cumsum(counts)
        ids = self.flat[_spans(self.start[at], counts)]
        reached = np.concatenate([[0], ends])[np.cumsum(per_doc)]
        return ids, np.diff(reached, prepend=0)


def flat_ids(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids in one array, and their lengths."""
    return np.fromiter(chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int64, len(found))


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places ``start`` to ``start + count`` of every span in turn."""
    ends = np.cumsum(counts)
    places = np.arange(int(ends[-1]) if len(ends) else 0)
    places += np.repeat(starts - (ends - counts), counts)
    return places


def runs(texts: pa.Array, characters: int = 4_000_000) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive texts, about that many bytes at a time and one text at least; null counts as empty."""
    texts = pc.fill_null(texts, "")
    reach = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        before = reach[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(reach, before + characters, side="right")))
        yield first, texts.slice(first, last - first)
        first = last


def read_config(path: str) -> str:
    """The tokenizer file as text, read once on the driver; its size is that of one vocabulary."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    json.loads(text)
    return text
