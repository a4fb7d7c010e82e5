"""Readers of derived and external tables in CSV or Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.network import demand_reduction_estimate
from ..functions.wind import wind_speed
from ..operators.residue import load_quarterly_residue
from ..schemas import NETWORK_CAPACITY, NETWORK_DEFERRAL, RESIDUE_RESULT_MONTHLY

# Networks taken from the investment table, and those that come from a register instead.
OPPORTUNITY_NETWORKS = {
    "Energex": "QLD",
    "Ergon Energy": "QLD",
    "TasNetworks": "TAS",
    "Essential Energy": "NSW",
    "Evoenergy": "ACT",
    "CitiPower": "VIC",
    "Powercor": "VIC",
    "United Energy": "VIC",
}
REGISTER_NETWORKS = ["Ausgrid", "Ausnet Services", "SA Power Networks", "Endeavour Energy", "Jemena"]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, in the splits that the session's file settings give."""
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header; without a schema every column is text."""
    reader = spark.read.option("header", "true").option("ignoreLeadingWhiteSpace", "true")
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_residue_results_monthly(spark: SparkSession, path: str) -> DataFrame:
    """All monthly residue-result tables of a folder."""
    return read_csv(spark, path, RESIDUE_RESULT_MONTHLY)


def read_quarterly_residue(spark: SparkSession, path: str) -> DataFrame:
    """Quarterly residue from one or more CSV files: aliases resolved, bad numbers 0, the last file name wins."""
    # Read as text: header names may be padded.
    rows = read_csv(spark, path).select("*", F.col("_metadata.file_name").alias("file_seq"))
    trimmed = rows.toDF(*[c.strip() for c in rows.columns])
    numbers = trimmed.withColumn("residue_aud", F.trim("residue_aud").try_cast("double"))
    return load_quarterly_residue(numbers)


def read_network_assets(
    spark: SparkSession, investment: str, deferral: str, capacity: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three network tables; figures of the investment table that do not parse are NULL."""
    raw = read_csv(spark, investment)
    figures = (
        "latitude", "longitude", "aug_cost_aud", "annual_deferral_aud", "capacity_mva", "peak_demand_mva", "available_mva",
    )
    assets = raw.select(
        *[F.col(c) for c in raw.columns if c not in figures],
        *[
            (F.col(c).try_cast("double") if c in raw.columns else F.lit(None).cast("double")).alias(c)
            for c in figures
        ],
    )
    return assets, read_csv(spark, deferral, NETWORK_DEFERRAL), read_csv(spark, capacity, NETWORK_CAPACITY)


def read_opportunities(spark: SparkSession, investment: str) -> DataFrame:
    """Investment rows of the listed networks as opportunities."""
    return opportunities(read_csv(spark, investment))


def opportunities(raw: DataFrame) -> DataFrame:
    """Investment rows in the shape of a register, with an estimate of the demand reduction."""
    def number(name: str):
        return F.col(name).try_cast("double") if name in raw.columns else F.lit(None).cast("double")

    def words(name: str):
        return F.trim(F.coalesce(F.col(name), F.lit(""))) if name in raw.columns else F.lit("")

    network = words("network")
    kept = raw.where(network.isin(*OPPORTUNITY_NETWORKS) & ~network.isin(*REGISTER_NETWORKS))
    entries = [F.lit(part) for pair in OPPORTUNITY_NETWORKS.items() for part in pair]
    staged = kept.select(
        F.concat(
            F.lit("ena_"),
            F.replace(F.coalesce("asset_code", words("asset_name")), F.lit(" "), F.lit("_")),
        ).alias("id"),
        words("asset_name").alias("name"),
        network.alias("dnsp"),
        F.element_at(F.create_map(*entries), network).alias("state"),
        number("latitude").alias("lat"),
        number("longitude").alias("lng"),
        words("investment_description").alias("constraint_driver"),
        words("constraint_season").alias("peak_season"),
        words("network_element_str").alias("network_element"),
        number("annual_deferral_pool").alias("deferral_value_m"),
        number("deferrable_invest").alias("capex_m"),
        words("invest_year_str").alias("proposed_timing"),
        number("wacc_rate").alias("_wacc"),
        number("depr_rate").alias("_depr"),
        F.lit(False).alias("is_nna"),
    ).where("lat IS NOT NULL AND lng IS NOT NULL AND name <> ''")
    # The id is whole, as it tells assets apart; the short one is for display.
    return staged.withColumn("short_id", F.substring("id", 1, 44)).withColumn(
        "demand_reduction_mw", demand_reduction_estimate("capex_m", "deferral_value_m", F.col("_wacc"), F.col("_depr"))
    ).drop("_wacc", "_depr")


def hourly_wind_at(grid: DataFrame, lat: float, lon: float) -> DataFrame:
    """Series of the grid point nearest to a site, with speeds at 10 m and 100 m.

    The nearest latitude and the nearest longitude are taken independently, as
    on a regular grid.
    """
    axes = grid.agg(
        F.min_by("latitude", F.struct(F.abs(F.col("latitude") - lat), F.col("latitude"))).alias("latitude"),
        F.min_by("longitude", F.struct(F.abs(F.col("longitude") - lon), F.col("longitude"))).alias("longitude"),
    )
    # One row by construction.
    point = grid.join(F.broadcast(axes), ["latitude", "longitude"], "left_semi")
    return point.select(
        "timestamp", "u10", "v10", wind_speed("u10", "v10").alias("ws10"), "u100", "v100",
        wind_speed("u100", "v100").alias("ws100"), F.lit("ERA5").alias("source"),
    )


def read_limited(df: DataFrame, n: int, order: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows by ``order`` (any ``n`` without one) with every column as text."""
    return (df.orderBy(*order) if order else df).limit(n).select(*[F.col(c).cast("string").alias(c) for c in df.columns])
