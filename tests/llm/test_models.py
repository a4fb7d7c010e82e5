"""Quality and toxicity on held-out labels and awkward rows."""

from __future__ import annotations

import random
import zlib

import numpy as np

from intertie.llm import quality, toxicity
from intertie.llm.queries import op4_toxicity, op10_quality

from .helpers import FOLDER, awkward, documents, rows, scratch

LABELS = "doc_id long, quality int, toxic int"


def accuracy(found, labels, column):
    held = [(r.predicted, labels[r.doc_id][column]) for r in found if r.held_out and r.doc_id in labels]
    return np.mean([p == y for p, y in held]), len(held)


def planted(n=900):
    random.seed(2)
    syllables = ["an", "er", "ou", "ti", "the", "re", "in", "on", "st", "al"]
    word = lambda: "".join(random.choice(syllables) for _ in range(random.randrange(1, 4)))
    texts, labels = [], []
    for i in range(n):
        own = [word() for _ in range(random.randrange(20, 200))]
        bad, toxic = random.random() < 0.3, random.random() < 0.3
        if toxic:
            for _ in range(max(2, len(own) // 25)):
                own[random.randrange(len(own))] = random.choice(["zorgle", "quabbit", "fnarx"])
        if bad:
            own = [w + random.choice(["###", "$$$", "%%%"]) for w in own]
        texts.append((i, " ".join(own)))
        labels.append((i, int(not bad), int(toxic)))
    return texts, labels


def test_queries_give_every_document_a_score(spark):
    ids = sorted(r.doc_id for r in documents(spark).select("doc_id").collect())
    for query, parts, out in ((op4_toxicity, 5, 0), (op10_quality, 3, 1)):
        found = query(spark, FOLDER).collect()
        assert sorted(r.doc_id for r in found) == ids
        for r in found:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == out)
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_held_out_accuracy(spark):
    texts, labels = planted()
    docs, table = rows(spark, texts), spark.createDataFrame(labels, LABELS)
    known = {i: {"quality": q, "toxic": t} for i, q, t in labels}
    right, n = accuracy(quality.report(docs, table).collect(), known, "quality")
    assert n > 200 and right > 0.97
    right, n = accuracy(toxicity.report(docs, table, scratch).collect(), known, "toxic")
    assert n > 120 and right > 0.93


def test_held_out_labels_change_nothing(spark):
    texts, labels = planted(200)
    docs = rows(spark, texts)
    turned = [
        (i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t)
        for i, q, t in labels
    ]
    for report in (quality.report, lambda d, t: toxicity.report(d, t, scratch)):
        a, b = (
            {r.doc_id: r.score for r in report(docs, spark.createDataFrame(x, LABELS)).collect()} for x in (labels, turned)
        )
        assert a == b


def test_awkward_rows_and_missing_labels(spark):
    texts, labels = planted(120)
    docs = rows(spark, texts + [((i or 0) + 1000 if i else None, t) for i, t in awkward()])
    odd = labels + [(None, 1, 1), (1000, None, None), (3, 1, 0), (10**9, 0, 1)]
    for table in (spark.createDataFrame(odd, LABELS), spark.createDataFrame([], LABELS)):
        for found in (quality.report(docs, table).collect(), toxicity.report(docs, table, scratch).collect()):
            assert len(found) == len(texts) + len(awkward())
            assert all(0 <= r.score <= 1 and not (r.doc_id is None and r.held_out) for r in found)
    assert quality.report(rows(spark, []), spark.createDataFrame(labels, LABELS)).count() == 0
    assert toxicity.report(rows(spark, []), spark.createDataFrame(labels, LABELS), scratch).count() == 0


def test_risk_with_unlabelled_negatives():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (500, 4)), rng.normal(-1, 1, (500, 4))
    model = quality.fit(good[:200], np.r_[good[200:], bad[:300]], 0.5)
    assert (model.scores(good) >= 0.5).mean() > 0.9 and (model.scores(bad) < 0.5).mean() > 0.9


def test_training_equals_sums_at_hand(spark):
    """Risk and scores from sums in tasks are those of plain gradient descent over all rows."""
    texts, labels = planted(150)
    texts = texts + texts[:20] + [(None, "of no id")]
    docs = rows(spark, texts)
    model = quality.train(docs.repartition(5), spark.createDataFrame(labels, LABELS))
    known = {i: q for i, q, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    every = np.stack([quality.features(t) for _, t in texts])
    good = np.stack([quality.features(t) for i, t in texts if known.get(i) == 1])
    prior = min(0.99, max(0.01, sum(known.values()) / len(known)))
    plain = quality.fit(good, every, prior)
    assert model.prior == plain.prior == prior
    assert np.allclose(model.scores(every), plain.scores(every), atol=1e-4)

    def risk(weights, bias):
        z = lambda x: np.clip((x - every.mean(0)) / (every.std(0) + 1e-3), -8, 8) @ weights + bias
        loss = lambda x: np.logaddexp(0, x).mean()
        rest = loss(z(every)) - prior * loss(z(good))
        return prior * loss(-z(good)) + max(0.0, rest), rest

    found, rest = risk(plain.weights, plain.bias)
    assert rest >= -1e-9 and found < risk(np.zeros(quality.FEATURES), np.log(prior / (1 - prior)))[0]


def test_no_move_leads_below_the_least_risk():
    """Where the rest stays above zero, the non-negative risk of the model is the least around it."""
    rng = np.random.default_rng(5)
    good, bad = rng.normal(0.4, 1, (900, 4)), rng.normal(-0.4, 1, (600, 4))
    trusted, every, prior = good[:400], np.r_[good[400:], bad], 0.45
    model = quality.fit(trusted, every, prior)

    def risk(weights, bias):
        z = lambda x: np.clip((x - model.mean) / model.scale, -8, 8) @ weights + bias
        loss = lambda x: np.logaddexp(0, x).mean()
        rest = loss(z(every)) - prior * loss(z(trusted))
        return prior * loss(-z(trusted)) + max(0.0, rest), rest

    least, rest = risk(model.weights, model.bias)
    assert rest > 0.05
    for size in (0.003, 0.03, 0.3, 3):
        for move in rng.normal(0, size, (100, 5)):
            assert risk(model.weights + move[:4], model.bias + move[4])[0] > least - 1e-4


def test_smoothed_probabilities_add_up():
    counts = np.array([[5, 1, 0, 0], [0, 0, 0, 0], [2, 2, 1, 1]])
    out = toxicity.smoothed(counts, np.full((3, 4), 0.25), 2.0)
    assert np.allclose(out.sum(axis=1), 1)


def random_letters(n, size, seed=4):
    """Texts with so many contexts that few recur, as in a large corpus."""
    rng = random.Random(seed)
    texts = [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(size))) for i in range(n)]
    return texts, [(i, 1, int(rng.random() < 0.4)) for i, _ in texts]


def test_toxicity_does_not_depend_on_the_order_of_rows(spark):
    texts, labels = random_letters(120, 3000)
    table = spark.createDataFrame(labels, LABELS)
    a, b = (
        {r.doc_id: r.score for r in toxicity.report(docs, table, scratch).collect()}
        for docs in (rows(spark, texts).coalesce(1), rows(spark, texts[::-1]).repartition(7))
    )
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-6 for i in a)


def exact_evidence(texts, labels, known):
    """Plain version of the toxicity model's evidence: dictionaries over whole contexts."""
    counts, seen = ({}, {}), set()
    for i, text in texts:
        x = toxicity.symbols(text).tolist()
        for k in range(len(x) - 5) if i in known else ():
            own = counts[labels[i]].setdefault(tuple(x[k : k + 5]), {})
            own[x[k + 5]] = own.get(x[k + 5], 0) + 1
            seen.add((*x[k : k + 5], x[k + 5]))
    off = lambda values: (lambda a, b: a / (a + 2 * b) if a else 0.5)(values.count(1), values.count(2))
    both = {}
    for table in counts:
        for c, row in table.items():
            for s, v in row.items():
                own = both.setdefault(c, {})
                own[s] = own.get(s, 0) + v
    levels, grams = {}, {g[2:] for g in seen}
    follow = {}
    for g in seen:
        own = follow.setdefault(g[2:5], {})
        own[g[5]] = own.get(g[5], 0) + 1
    levels[3] = follow
    for size in (2, 1, 0):
        longer, levels[size] = grams, {}
        grams = {g[1:] for g in longer}
        for g in longer:
            own = levels[size].setdefault(g[1:-1], {})
            own[g[-1]] = own.get(g[-1], 0) + 1
    discounts = {n: off([v for row in t.values() for v in row.values()]) for n, t in levels.items()}
    pooled, by_class = off([v for r in both.values() for v in r.values()]), [
        off([v for r in t.values() for v in r.values()]) for t in counts
    ]

    def mix(row, s, d, lower, strength=0.0):
        total = sum(row.values())
        return (max(row.get(s, 0) - d, 0) + (strength + d * len(row)) * lower) / (total + strength) if total + strength else lower

    def shared(c, s, size=3):
        lower = shared(c[1:], s, size - 1) if size else 1 / 32
        return mix(levels[size].get(c, {}), s, discounts[size], lower)

    out = []
    for i, text in texts:
        x, found = toxicity.symbols(text), []
        for k in range(len(x) - 5):
            c, s = tuple(x[k : k + 5].tolist()), int(x[k + 5])
            lower = mix(both.get(c, {}), s, pooled, shared(c[2:], s))
            o, t = (mix(counts[n].get(c, {}), s, by_class[n], lower, 30.0) for n in (0, 1))
            found.append(np.log(t) - np.log(o))
        out.append((i, toxicity.evidence(x, np.array(found))))
    return out


def test_every_context_has_its_own_counts(spark):
    texts, labels = random_letters(40, 400, 5)
    more, tags = planted(60)
    texts += [(100 + i, t) for i, t in more] + [(500, ""), (501, "a"), (502, "unseen ünlike 你好 contexts")]
    labels += [(100 + i, q, t) for i, q, t in tags]
    known = {i: t for i, _, t in labels}
    learnt = {i for i in known if zlib.crc32(str(i).encode()) % 5 > 1}
    docs = rows(spark, texts)
    model = toxicity.train(docs, spark.createDataFrame(labels, LABELS), scratch)
    want = dict(exact_evidence(texts, known, learnt))
    for shard_bytes in (3000, 10**7):
        found = {r.doc_id: r.evidence for r in toxicity.weigh(docs, model, shard_bytes=shard_bytes).collect()}
        assert found.keys() == want.keys()
        assert all(np.allclose(found[i], want[i], atol=1e-4) for i in want)


def test_calibration_labels_beyond_the_sample_are_counted(spark, monkeypatch):
    texts, labels = planted(300)
    models, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda *a, **k: models.append(train(*a, **k)) or models[-1])
    docs, table = rows(spark, texts), spark.createDataFrame(labels, LABELS)
    assert toxicity.report(docs, table, scratch, most=20).count() == 300
    parts = [zlib.crc32(str(i).encode()) % 5 for i, _ in texts]
    sample = quality.sampled(docs.where(quality.fold("doc_id", 5) == 1), "doc_id", 20 / parts.count(1), "c").count()
    assert 0 < sample < parts.count(1)
    assert models[0].toxic_texts + models[0].ordinary_texts == 300 - parts.count(0) - sample
