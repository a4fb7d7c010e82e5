"""From raw documents to encoded ones: the stages of a training corpus, each a function of (spark, docs, sf_dir)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intertie.llm import bpe, decontaminate, near_dup, quality, secret_scan
from intertie.llm.queries import table, written
from intertie.session import with_package


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject; the model learns from the labels' own folds."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    # A name that no column of the documents has.
    own = "_" * (1 + max(map(len, docs.columns)))
    scored = quality.score(docs, model, out=own)
    return scored.where(F.col(own) >= 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least id."""
    return near_dup.one_of_each(docs, lambda df: written(df, "near-dup"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), lambda df: written(df, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked; ``n_chars`` follows where it was known."""
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The end of the pipeline: ids of every text and what they decode to, as counts and digests."""
    with_package(spark)
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("keep_good", keep_good),
    ("drop_near_duplicates", drop_near_duplicates),
    ("drop_contaminated", drop_contaminated),
    ("redact_secrets", redact_secrets),
    ("encode_texts", encode_texts),
]

#: Fitting a model and merging byte pairs are not things SQL can say.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; every stage but the last is written and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
