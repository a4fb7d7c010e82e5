"""Writers of derived tables, the recommendation ledger and the reconciliation report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import exclude_existing
from ..operators.residue import CATEGORY_GAP_UP_TO, TOTAL_GAP_UP_TO, certification_counts
from ..operators.versions import first_occurrence

LEDGER_KEY = ("timestamp", "product_id", "quarter", "tranche")


def write_quarterly(df: DataFrame, path: str) -> None:
    """Derived table partitioned by quarter; only the quarters in ``df`` are replaced.

    Rebalancing gathers a quarter into few files and splits a quarter too big for one task.
    """
    (
        df.hint("rebalance", F.col("quarter"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("quarter")
        .parquet(path)
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    (writer.option("header", "true") if fmt == "csv" else writer).format(fmt).save(path)


def existing_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``, empty while nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def ledger_rows(spark: SparkSession, path: str, schema, quarters: Sequence[str | None]) -> DataFrame:
    """Rows of the ledger in the given quarters; no file of another quarter is opened."""
    known = [q for q in quarters if q is not None]
    wanted = F.col("quarter").isin(*known) if known else F.lit(False)
    return existing_rows(spark, path, schema).where(wanted | F.col("quarter").isNull() if None in quarters else wanted)


def append_recommendations(df: DataFrame, path: str, key: Sequence[str] = LEDGER_KEY) -> None:
    """Append rows whose key the ledger does not hold yet, so that a repeated run adds nothing.

    Key parts that are NULL are equal to each other. The ledger is partitioned
    by quarter, which is part of the key, and an append reads the quarters of
    its own rows only; there are four labels a year, so the driver may hold them.
    """
    if "quarter" not in key:
        raise ValueError("the quarter is part of a ledger's key")
    spark = df.sparkSession
    fresh = first_occurrence(df, list(key), [c for c in df.columns if c not in key])
    quarters = [r[0] for r in df.select("quarter").distinct().collect()]
    existing = ledger_rows(spark, path, df.schema, quarters)
    new = exclude_existing(fresh, existing, list(key), null_safe=True)
    new.write.mode("append").partitionBy("quarter").parquet(path)


def reconciliation_report(
    certified: DataFrame, total_threshold: float = TOTAL_GAP_UP_TO, category_threshold: float = CATEGORY_GAP_UP_TO
) -> DataFrame:
    """One JSON document: thresholds, a row per quarter, and the summary.

    ``certified`` holds one row per quarter, which bounds the collected list.
    """
    row = F.struct(*[F.col(c) for c in certified.columns])
    gathered = certified.agg(F.array_sort(F.collect_list(row)).alias("quarters"), *certification_counts())
    thresholds = F.struct(F.lit(total_threshold).alias("total_pct"), F.lit(category_threshold).alias("category_pct"))
    summary = F.struct("total_quarters", "passed", "not_yet", "errors")
    document = F.struct(thresholds.alias("thresholds"), F.col("quarters"), summary.alias("summary"))
    return gathered.select(F.to_json(document).alias("value"))


def write_reconciliation_report(certified: DataFrame, path: str) -> None:
    reconciliation_report(certified).coalesce(1).write.mode("overwrite").text(path)
