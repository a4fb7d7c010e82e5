from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa

from intertie.llm import passages
from intertie.llm.queries import op3_passages

from .helpers import FOLDER, awkward, documents, rows, scratch, words


def brute(texts, window=50):
    first = {}
    for i, text in texts:
        own = words(text)
        for k in range(len(own) - window + 1) if i is not None else ():
            key = tuple(own[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in texts:
        own = words(text)
        gone = [False] * len(own)
        for k in range(len(own) - window + 1) if i is not None else ():
            if first[tuple(own[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((-1 if i is None else i, len(own), sum(gone), " ".join(w for w, g in zip(own, gone) if not g)))
    return sorted(out)


def found(frame):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in frame.collect())


def test_query_equals_brute_force(spark):
    texts = [(r.doc_id, r.text) for r in documents(spark).collect()]
    want = [(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute(texts)]
    assert sorted(map(tuple, op3_passages(spark, FOLDER).collect())) == want


def test_planted_passages(spark):
    random.seed(11)
    fresh = lambda n: [f"u{random.randrange(10**6)}" for _ in range(n)]
    shared, other = fresh(80), fresh(50)
    texts = [(i, " ".join(fresh(random.randrange(5, 40)) + shared[i % 7 : 60 + i % 20] + fresh(9))) for i in range(60)]
    texts += [(100 + i, "\n".join(other + fresh(i))) for i in range(4)]
    texts += [(200, " ".join(shared[:49])), (201, " ".join(["a"] * 300)), (202, " ".join(["a"] * 120 + ["b"]))]
    texts += [(300, texts[0][1]), (300, texts[0][1]), (300, texts[5][1])]
    for shard_bytes in (1000, 10**7):
        assert found(passages.remove_repeats(rows(spark, texts), scratch, shard_bytes=shard_bytes)) == brute(texts)


def test_awkward_rows(spark):
    assert found(passages.remove_repeats(rows(spark, awkward()), scratch)) == brute(awkward())
    assert found(passages.remove_repeats(rows(spark, awkward()), scratch, window=6)) == brute(awkward(), 6)
    assert passages.remove_repeats(rows(spark, []), scratch).count() == 0


def common_line(n):
    """Different documents around one line that all of them have."""
    rng = random.Random(3)
    fresh = lambda k: [f"v{rng.randrange(10**6)}" for _ in range(k)]
    line = fresh(12)
    return [(i, " ".join(fresh(60) + line + fresh(60))) for i in range(n)]


def test_windows_of_a_common_phrase_do_not_meet():
    texts, buckets = common_line(200), 16
    table = pa.table(
        {
            "id": pa.array([i for i, _ in texts], pa.int64()),
            "text": pa.array([t for _, t in texts]),
            "shard": pa.array([7] * len(texts), pa.int32()),
        }
    )
    tokens = next(passages.per_text(table.column("text").slice(0, 1).combine_chunks()))
    common = passages.orders(passages.letters(tokens))[60:67]
    found = passages.candidate_windows(50, buckets)(table, pa.table({"phrase": pa.array(common.view(np.int64))}))
    sizes = [len(passages.unwrapped(e, *passages.ENTRY)[0]) for e in found.column("entries").to_pylist()]
    assert len(sizes) == buckets and sum(sizes) > 200 * 40 and max(sizes) < 2 * sum(sizes) / buckets


def test_common_line_in_different_documents(spark):
    texts = common_line(60)
    texts += [(100 + i, " ".join(t.split()[i : 100 + i])) for i, t in texts[:20]]
    texts += [(-5, texts[3][1]), (2**62, texts[4][1]), (-(2**62), texts[4][1])]
    for shard_bytes in (500, 5000, 10**7):
        assert found(passages.remove_repeats(rows(spark, texts), scratch, shard_bytes=shard_bytes)) == brute(texts)
