"""Byte-level encoding over a rank file against the tiktoken library."""

from __future__ import annotations

import base64
import hashlib
import random
import struct

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from intertie.llm import byte_bpe
from intertie.llm.queries import op11_byte_bpe

from .helpers import FOLDER, awkward, documents, rows
from .test_bpe import strings

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
with open(PATH, "rb") as file:
    LINES = file.read()
LIBRARY = tiktoken.Encoding(
    "own",
    pat_str=public_tokenizers.PATTERN,
    mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, LINES.splitlines())},
    special_tokens={},
)
RANKS = byte_bpe.Ranks(LINES)


def library(piece: bytes) -> list[int]:
    return LIBRARY._encode_single_piece(piece)


@pytest.mark.parametrize("path", [PATH, public_tokenizers.path("byte_bpe_50k.tiktoken")])
def test_codec_equals_library(path):
    with open(path, "rb") as file:
        lines = file.read()
    theirs = tiktoken.Encoding(
        "t",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())},
        special_tokens={},
    )
    own = byte_bpe.ByteCodec(lines, public_tokenizers.PATTERN)
    random.seed(5)
    anything = ["".join(chr(random.choice([random.randrange(0xD800), random.randrange(0xE000, 0x110000)]))
                        for _ in range(20)) for _ in range(400)]
    mixed = ["".join(random.choice("aé1!ⅷ٣ऩा͸ 　ǅᲀ '_\n") for _ in range(20)) for _ in range(400)]
    texts = strings() + anything + mixed
    ids, lengths = own.encode(pa.array(texts))
    decoded = own.decode(ids, lengths).to_pylist()
    at = 0
    for text, n, back in zip(texts, lengths.tolist(), decoded):
        assert ids[at : at + n].tolist() == theirs.encode_ordinary(text), text
        assert back == text.encode("utf-8")
        at += n


def test_follows_is_what_the_library_does():
    random.seed(6)
    tokens = random.sample(sorted(RANKS.token), 400)
    for a, b in zip(tokens, reversed(tokens)):
        joined = RANKS.token[a] + RANKS.token[b]
        if joined not in RANKS.rank:
            assert RANKS.follows(a, b) == (library(joined) == [a, b])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=30), min_size=1, max_size=5), st.data())
def test_appends_and_edits(parts, data):
    table = byte_bpe.PrefixTable(RANKS)
    for part in parts:
        table.append(part)
    whole = b"".join(parts)
    for stop in range(len(whole) + 1):
        assert table.ids(stop) == RANKS.merged(whole[:stop])
    start = data.draw(st.integers(0, len(whole)))
    stop = data.draw(st.integers(start, len(whole)))
    by = data.draw(st.binary(max_size=10))
    table.replace(start, stop, by)
    fresh = byte_bpe.PrefixTable(RANKS, whole[:start] + by + whole[stop:])
    assert (table.data, table.last, table.begin) == (fresh.data, fresh.last, fresh.begin)


def test_an_edit_settles_only_what_is_near():
    random.seed(8)
    text = "".join(random.choice("etaoinshrdlu") for _ in range(20_000)).encode()
    table = byte_bpe.PrefixTable(RANKS, text)
    settled = table.replace(100, 103, b"zzzz")
    assert settled < 4 * RANKS.longest + 100
    assert table.ids() == library(text[:100] + b"zzzz" + text[103:])
    with pytest.raises(ValueError):
        table.replace(5, 4, b"")


def test_query_equals_library(spark):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    got = op11_byte_bpe(spark, FOLDER).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_awkward_rows(spark):
    docs = rows(spark, [*awkward(), (8, "a" * 300_000), (9, " " * 5000)])
    encoded = byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    got = sorted(map(tuple, encoded.collect()), key=repr)
    want = []
    for i, text in [*awkward(), (8, "a" * 300_000), (9, " " * 5000)]:
        ids = LIBRARY.encode_ordinary(text or "")
        want.append((i, len(ids), ids))
    assert got == sorted(want, key=repr)
    back = byte_bpe.decode(encoded, PATH, public_tokenizers.PATTERN)
    assert sorted((bytes(r.decoded) for r in back.collect())) == sorted((t or "").encode() for _, t in [
        *awkward(), (8, "a" * 300_000), (9, " " * 5000)])
    empty = byte_bpe.round_trip(docs.where("false"), PATH, public_tokenizers.PATTERN)
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_tokens", "packed", "decoded"]


def test_unknown_and_null_ids(spark):
    frame = spark.createDataFrame([([1, None, 10**6, -3, 2],), (None,), ([],)], "ids array<int>")
    got = [r.decoded for r in byte_bpe.decode(frame, PATH, public_tokenizers.PATTERN).collect()]
    assert got == [RANKS.token[1] + RANKS.token[2], None, b""]


def test_edited_texts(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("etaoinshrdlu") for _ in range(5000))
    edits = [
        (1, "the quick brown fox", 4, 9, "slow"), (2, None, None, None, None), (3, "abc", 10, 2, "d e"),
        (4, long, 50, 51, "x"), (4, long, 50, 51, "x"), (5, "it's", 2, 3, " "), (6, "h" * 900, 50, 51, "x"), (None, "a b", -4, 1, "é ñ"),
    ]
    frame = spark.createDataFrame(edits, "doc_id long, text string, start int, stop int, replacement string")
    got = byte_bpe.reencode(frame, PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == len(edits)
    for r in got:
        assert r.ids == LIBRARY.encode_ordinary(r.edited)
    near = [r for r in got if r.doc_id == 4]
    assert len(near) == 2 and all(r.n_settled < 2000 for r in near)
    assert {r.edited for r in got if r.doc_id not in (4, 6)} == {"the slow brown fox", "", "abcd e", "it s", "é ñ b"}
