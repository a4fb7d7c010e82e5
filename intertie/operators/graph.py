"""Link graph of notes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIKI_LINK = r"\[\[([^\]|#\n]+)"


def link_edges(
    notes: DataFrame, name: str = "name", text: str = "text", pattern: str = WIKI_LINK, known: DataFrame | None = None
) -> DataFrame:
    """Links between existing notes, one row per occurrence, no self links."""
    links = notes.select(
        F.col(name).alias("source"), F.explode(F.regexp_extract_all(text, F.lit(pattern), 1)).alias("_link")
    ).select("source", F.trim("_link").alias("target"))
    names = (known if known is not None else notes).select(F.col(name).alias("target")).distinct()
    return links.where(F.col("source") != F.col("target")).join(names, "target", "left_semi").select("source", "target")


def degree_counts(edges: DataFrame, nodes: DataFrame, name: str = "name") -> DataFrame:
    """Out, in and total degree of every node; nodes without links are orphans."""
    ends = edges.select(F.col("source").alias("_n"), F.lit(1).alias("_out"), F.lit(0).alias("_in")).unionAll(
        edges.select(F.col("target"), F.lit(0), F.lit(1))
    )
    sums = ends.groupBy("_n").agg(F.sum("_out").alias("_out"), F.sum("_in").alias("_in"))
    joined = nodes.select(name).distinct().join(sums, F.col(name) == F.col("_n"), "left")
    out, inside = F.coalesce("_out", F.lit(0)), F.coalesce("_in", F.lit(0))
    return joined.select(
        name, out.alias("out_degree"), inside.alias("in_degree"), (out + inside).alias("degree"),
        ((out + inside) == 0).alias("orphan"),
    )


def top_nodes(degrees: DataFrame, n: int, name: str = "name") -> DataFrame:
    """The ``n`` best connected nodes with their drawing size."""
    return (
        degrees.orderBy(F.col("degree").desc(), name)
        .limit(n)
        .select(
            name,
            F.substring(name, 1, 50).alias("label"),
            F.least(F.lit(3) + F.col("degree") * 0.4, F.lit(14)).cast("double").alias("size"),
            "degree",
            "orphan",
        )
    )


def induced_edges(edges: DataFrame, nodes: DataFrame, name: str = "name") -> DataFrame:
    """Edges with both ends in ``nodes``, which holds at most the ``n`` rows of :func:`top_nodes`."""
    kept = F.broadcast(nodes.select(F.col(name).alias("_n")))
    return edges.join(kept, edges["source"] == F.col("_n"), "left_semi").join(
        kept, F.col("target") == F.col("_n"), "left_semi"
    )


def folder_counts(documents: DataFrame, folder: str = "folder") -> DataFrame:
    return documents.groupBy(folder).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-empty values of several columns as ``(column, value)`` rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return (
        df.select(F.explode(pairs).alias("_p"))
        .select("_p.*")
        .where(F.length("value") > 0)
        .distinct()
    )
