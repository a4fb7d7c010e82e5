"""Small documents with the awkward cases, and plain versions of the operators."""

from __future__ import annotations

import os
import re

from intertie.llm.queries import written
from intertie.session import with_package

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, shard string"


def scratch(df):
    return written(df, "test")


def documents(spark):
    return with_package(spark).read.parquet(f"{FOLDER}/documents.parquet")


def rows(spark, texts, schema=DOCS):
    """Documents with columns whose names clash with those of the operators."""
    with_package(spark)
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in texts], schema)


def long_text(words=30_000):
    return " ".join(f"w{i % 977}x{i % 31}" for i in range(words))


def awkward():
    """Null and empty texts, a null id, repeated rows, odd white space, other scripts, a very long text."""
    return [
        (1, "one two three four five six seven"),
        (2, None),
        (3, ""),
        (None, "one two three four five six seven"),
        (4, "  \t\n\x0b\x1c a b  é é ñ 你好 \U0001f600 ΑΣ İ don't <|endoftext|>x"),
        (5, "one two three four five six seven"),
        (5, "one two three four five six seven"),
        (6, long_text()),
        (7, "   "),
    ]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
