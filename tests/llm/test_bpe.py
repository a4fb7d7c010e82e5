"""Encoding, decoding and token files against the tokenizer library."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from intertie.llm import bpe, token_files
from intertie.llm.pieces import read_config, spaced_words_of
from intertie.llm.queries import op1_bpe, op6_token_files

from .helpers import FOLDER, awkward, documents, rows, scratch

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def strings():
    random.seed(7)
    near = "aaabbcdething sSeEé'’<|>/w1_ \n\tñ你"
    out = ["".join(random.choice(near) for _ in range(50)) for _ in range(400)]
    wide = lambda: chr(random.choice([random.randrange(32, 0x600), random.randrange(0x2000, 0x3100), random.randrange(0xD7FF)]))
    out += ["".join(wide() for _ in range(30)) for _ in range(300)]
    return out + ["", "   ", "it's 'tis ''s", "a<|endoftext|> <|startoftext|>b <|ENDOFTEXT|>", "ΑΣ İ é", "a\x1cb"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_codec_equals_library(path):
    own, library = bpe.Codec(read_config(path)), Tokenizer.from_file(path)
    texts = strings()
    ids, lengths = own.encode(pa.array(texts))
    decoded = own.decode(ids, lengths)
    ends = np.cumsum(lengths)
    for text, start, end, back in zip(texts, ends - lengths, ends, decoded):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[start:end].tolist() == want, text
        assert back == library.decode(want, skip_special_tokens=False), text


def test_compatible_pairs_are_those_that_merge_to_themselves():
    own, library = bpe.PairMerges(bpe.json.loads(read_config(BYTE))), Tokenizer.from_file(BYTE)
    random.seed(3)
    letters = [i for i, t in own.token.items() if t.isascii() and t.isalpha() and len(t) < 5]
    for _ in range(300):
        a, b = random.choice(letters), random.choice(letters)
        want = library.encode(own.token[a] + own.token[b], add_special_tokens=False).ids == [a, b]
        assert own.compatible(a, b) == want


def test_query_equals_library(spark):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    library = Tokenizer.from_file(WORD)
    for row in op1_bpe(spark, FOLDER).collect():
        ids = library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_awkward_rows(spark):
    docs, library = rows(spark, awkward()), Tokenizer.from_file(WORD)
    encoded = bpe.encode(docs, WORD)
    assert encoded.columns == ["doc_id", "n_tokens", "ids"]
    back = bpe.decode(encoded, WORD).collect()
    want = sorted((i or -1, library.encode(t or "", add_special_tokens=False).ids) for i, t in awkward())
    assert sorted((r.doc_id or -1, r.ids) for r in back) == want
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in back)
    assert bpe.digests(docs.limit(0), WORD).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, []), (3, [5, -1, None, 10**6])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(nulls, WORD).orderBy("doc_id").collect()] == [None, "", library.id_to_token(5)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), st.integers(1, 200), st.floats(0.3, 1))
def test_segments_round_trip(values, block, share):
    packed = token_files.pack(np.array(values, np.int64), block, share)
    assert token_files.unpack(packed).tolist() == values
    assert token_files.unpack(packed, 3, 90).tolist() == values[3:90]


def test_outliers_do_not_widen_a_block():
    values = np.full(1024, 7)
    values[[5, 900]] = 2**31
    assert len(token_files.pack(values)) < 100


def expected_files(texts, library):
    start, out = 0, []
    for i, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_query(spark):
    texts = sorted((r.doc_id, r.text) for r in documents(spark).collect())
    found = [tuple(r) for r in op6_token_files(spark, FOLDER).orderBy("doc_id").collect()]
    assert found == expected_files(texts, Tokenizer.from_file(BYTE))


def test_token_files_awkward_rows(spark, tmp_path):
    ordered = sorted(awkward(), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    for n, texts in enumerate((awkward(), [])):
        path = f"file://{tmp_path}/{n}"
        token_files.write_tokens(rows(spark, texts), path, BYTE, segment_ids=50)
        found = token_files.checksums(token_files.read_tokens(spark, path)).collect()
        want = expected_files(ordered, Tokenizer.from_file(BYTE)) if texts else []
        assert sorted(map(tuple, found), key=lambda r: r[1]) == want


def test_spaced_parts_are_the_text():
    texts = strings()
    parts, counts = spaced_words_of(pa.array(texts))
    ends = np.cumsum(counts)
    assert ["".join(parts[e - n : e].to_pylist()) for n, e in zip(counts, ends)] == texts
    assert scratch is not None


def test_large_segments_take_little_memory():
    """Ten million ids are packed some blocks at a time, and read back in part and whole."""
    import tracemalloc

    ids = np.random.default_rng(2).integers(0, 50_000, 10_000_000).astype(np.int32)
    tracemalloc.start()
    segment = token_files.pack(ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    assert (token_files.unpack(segment, 4_999_990, 5_300_007) == ids[4_999_990:5_300_007]).all()
    assert (token_files.unpack(segment) == ids).all()


def test_parts_by_arrow_are_cut_where_the_library_cuts():
    from intertie.llm.pieces import run_ends_of

    library = Tokenizer.from_file(BYTE)
    texts = strings()
    parts, counts = run_ends_of(pa.array(texts))
    parts, at = parts.to_pylist(), 0
    for text, n in zip(texts, counts.tolist()):
        own = parts[at : at + n]
        at += n
        assert "".join(own) == text
        ids = [i for p in own for i in library.encode(p, add_special_tokens=False).ids]
        if "<|endoftext|>" not in text:
            assert ids == library.encode(text, add_special_tokens=False).ids, text


def test_parts_learned_together_have_the_ids_of_each():
    """Also where joined parts would make a special token, and where a part must not be joined."""
    from intertie.llm.pieces import joinable

    table, _ = token_files.library_table(read_config(BYTE))
    library = Tokenizer.from_file(BYTE)
    parts = [f" wort{i}" for i in range(1500)] + ["<|endoftext", "|>x", "x", "", " ", "  a", "'s", "'tis", "\n\n1", " é", " あ", "ab ", " \U000e0100b"]
    flat, start, length = table.learn(parts)
    assert joinable(pa.array(parts)).sum() > 1500
    for part, first, n in zip(parts, start.tolist(), length.tolist()):
        assert flat[first : first + n].tolist() == library.encode(part, add_special_tokens=False).ids, part


def test_piece_table_keeps_what_was_met_again():
    from intertie.llm.pieces import PieceTable, flat_ids

    learned = []

    def learn(parts):
        learned.extend(parts)
        flat, lengths = flat_ids([list(p.encode()) for p in parts])
        return flat, np.cumsum(lengths) - lengths, lengths

    table = PieceTable(learn, limit=6)
    for batch in (["aa", "b"], ["aa", "c", "d", "ee", "f", "g"], ["ee", "aa", "h"], ["h", "aa"]):
        ids, counts = table.encode(pa.array(batch), np.array([len(batch) - 1, 1]))
        assert bytes(ids.tolist()).decode() == "".join(batch) and counts[1] == len(batch[-1])
    assert learned.count("aa") == 1 and learned.count("ee") == 2 and len(table.index) == 3


def test_packed_bits_are_in_order():
    values = np.random.default_rng(4).integers(0, 2**32, (5, 37)).astype(np.uint32)
    for width in range(33):
        kept = values & np.uint32((1 << width) - 1)
        bits = np.unpackbits(kept.astype("<u4").reshape(-1, 1).view(np.uint8), axis=1, count=width, bitorder="little")
        packed = token_files._joined(kept, width)
        assert (packed == np.packbits(bits.reshape(5, 37 * width), axis=1, bitorder="little")).all()
        assert (token_files._separated(packed, width, 37) == kept).all()
