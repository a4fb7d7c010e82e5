from __future__ import annotations

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from intertie.llm import near_dup, quality
from intertie.llm.queries import written

from .helpers import FOLDER, documents, scratch
from .test_pairs import brute_classes, brute_items
from .test_secrets import base


def test_stages_one_by_one(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "keep_good", "drop_near_duplicates", "drop_contaminated", "redact_secrets", "encode_texts",
    ]
    docs = documents(spark)
    stage = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}

    good = written(stage["keep_good"](spark, docs, FOLDER), "stage")
    model = quality.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    passed = {r.doc_id for r in quality.score(docs, model).where("score >= 0.5").select("doc_id").collect()}
    assert set(rows(good)) == passed and good.columns == docs.columns

    alone = written(stage["drop_near_duplicates"](spark, good, FOLDER), "stage")
    assert set(rows(alone)) == {c for _, _, c in brute_classes(rows(good).items())} and alone.columns == docs.columns

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = written(stage["drop_contaminated"](spark, alone, FOLDER), "stage")
    gone = {i for i, *_ in brute_items(rows(alone).items(), items)}
    assert set(rows(clean)) == set(rows(alone)) - gone and clean.columns == docs.columns

    masked = written(stage["redact_secrets"](spark, clean, FOLDER), "stage")
    assert masked.columns == docs.columns
    before, after = rows(clean), rows(masked)
    assert set(after) == set(before)
    for i, text in before.items():
        assert not base(after[i]) and (base(text) or after[i] == text)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {
        i: hashlib.sha256(" ".join(map(str, library.encode(t, add_special_tokens=False).ids)).encode()).hexdigest()
        for i, t in after.items()
    }
    for found in (stage["encode_texts"](spark, masked, FOLDER), corpus_pipeline.run(spark, FOLDER)):
        assert {r.doc_id: r.ids_sha256 for r in found.collect()} == want


def test_registered(spark):
    import __spark_entry__ as contract

    names = contract.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert near_dup and scratch
