"""Keyword search, relevance filters and vector search."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.market import NEWS_KEYWORDS, is_relevant
from .versions import top_per_key


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of ``word``."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))
    return (removed / len(word)).cast("long")


def query_words(query: str) -> list[str]:
    return [w.lower() for w in re.split(r"\W+", query) if len(w) > 2]


def keyword_search(
    documents: DataFrame, query: str, n: int = 8, text: str = "text", id_column: str = "doc_id", snippet: int = 600
) -> DataFrame:
    """Documents by total occurrences of the query words, with the start of their text as a preview."""
    lowered = F.lower(F.col(text))
    score = F.lit(0).cast("long")
    for word in query_words(query):
        score = score + occurrences(lowered, word)
    scored = documents.select(id_column, score.alias("score"), F.col(text).alias("_text")).where("score > 0")
    # The n best are picked on (score, id) before their texts are touched again.
    best = scored.orderBy(F.col("score").desc(), F.col(id_column).desc()).limit(n)
    stripped = F.btrim(F.col("_text"), F.lit(" \t\n\r"))
    preview = F.replace(F.substring(stripped, 1, snippet), F.lit("\n"), F.lit(" "))
    return best.select(id_column, "score", preview.alias("snippet"))


def first_relevant_per_feed(
    articles: DataFrame,
    n: int = 5,
    feed: str = "source",
    position: Sequence[str] = ("position",),
    title: str = "title",
    summary: str = "summary",
    keywords: Sequence[str] = tuple(NEWS_KEYWORDS),
) -> DataFrame:
    """The first ``n`` relevant items of each feed."""
    return top_per_key(articles.where(is_relevant(title, summary, keywords)), [feed], list(position), n)


def vector_search(
    vectors: DataFrame, query: Sequence[float], n: int = 8, vector: str = "embedding", id_column: str = "vec_id"
) -> DataFrame:
    """Exact cosine neighbours of one query vector.

    A vector of another length than the query's has no similarity and comes
    last. Only the best ``n`` rows of each task leave it.
    """
    values = F.col(vector).cast("array<double>")
    target = F.array(*[F.lit(float(q)) for q in query])
    dot = F.aggregate(F.zip_with(values, target, lambda x, q: x * q), F.lit(0.0), lambda acc, x: acc + x)
    norm = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x)
    same_length = F.size(values) == F.lit(len(query))
    query_norm = sum(float(q) * float(q) for q in query) ** 0.5
    similarity = F.when(same_length, F.try_divide(dot, F.sqrt(norm) * F.lit(query_norm)))
    return (
        vectors.select(id_column, similarity.alias("similarity"))
        .orderBy(F.col("similarity").desc_nulls_last(), id_column)
        .limit(n)
    )


def most_recent(documents: DataFrame, modified: str, n: int = 10, tie_break: Sequence[str] = ()) -> DataFrame:
    return documents.orderBy(F.col(modified).desc(), *tie_break).limit(n)
