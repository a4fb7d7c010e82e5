"""Streaming twins of the batch operators.

Streams read landed files. Revisions arrive late by design, so the revision
stream keeps everything and the latest version is resolved when the table is
read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.quarters import quarter_label
from ..operators.versions import latest_version
from ..sources.archives import file_system
from ..sources.sinks import LEDGER_KEY, append_recommendations


def read_stream(
    spark: SparkSession, path: str, schema, fmt: str = "parquet", pattern: str = "*", files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(fmt).load(path)


def as_event_time(stream: DataFrame, ts: str) -> DataFrame:
    """Watermarks need ``timestamp``; run the job in a UTC session, where the cast keeps the clock reading."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_prices(
    prices: DataFrame, ts: str = "timestamp", keys: Sequence[str] = ("region",), delay: str = "1 day"
) -> DataFrame:
    """One row per region and timestamp; repeats within the delay are dropped."""
    return as_event_time(prices, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark([*keys, ts])


def stream_residue_30min(
    intervals: DataFrame,
    ts: str = "trading_interval",
    value: str = "residue_aud",
    keys: Sequence[str] = ("interconnector_id", "from_region"),
    delay: str = "10 minutes",
) -> DataFrame:
    """Mean per half hour, emitted once the half hour is complete."""
    windowed = as_event_time(intervals, ts).withWatermark(ts, delay).groupBy(F.window(ts, "30 minutes"), *keys)
    means = windowed.agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    return means.select(
        F.col("window.start").alias("bucket_start"), *keys, (F.col("_sum").cast("double") / F.col("_n")).alias("mean_residue")
    )


def quarterly_from_buckets(buckets: DataFrame, keys: Sequence[str] = ("interconnector_id", "from_region")) -> DataFrame:
    """Quarter sums over the emitted half hours."""
    return buckets.groupBy(quarter_label("bucket_start").alias("quarter"), *keys).agg(
        F.sum("mean_residue").alias("residue_aud")
    )


def latest_snapshot(rows: DataFrame, keys: Sequence[str] = ("region",), order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Newest row per key; works on tables and, in update or complete mode, on streams."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return newest.select(*keys, "_row.*")


def resolve_revisions(bronze: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Late revisions replace earlier ones when the append-only table is read."""
    return latest_version(bronze, keys, version)


def _start(writer, trigger_now: bool, interval: str) -> StreamingQuery:
    return writer.trigger(availableNow=True).start() if trigger_now else writer.trigger(processingTime=interval).start()


def to_table(
    stream: DataFrame, path: str, checkpoint: str, trigger_now: bool = False, interval: str = "5 minutes"
) -> StreamingQuery:
    """Append a stream to a Parquet table exactly once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return _start(writer.outputMode("append"), trigger_now, interval)


def snapshot_batches(path: str) -> list[int]:
    """Batches of a snapshot table that are complete, in order; the file a finished write leaves is what publishes one."""
    system, root = file_system(path)
    if system.get_file_info(root).type != FileType.Directory:
        return []
    folders = [f.path for f in system.get_file_info(FileSelector(root)) if f.base_name.startswith("batch=")]
    marks = system.get_file_info([f"{folder}/_SUCCESS" for folder in folders])
    return sorted(int(f.rsplit("=", 1)[1]) for f, mark in zip(folders, marks) if mark.type == FileType.File)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The last published batch of a snapshot table; a batch that is being written is not seen."""
    batches = snapshot_batches(path)
    if not batches:
        raise ValueError(f"no snapshot has been published at {path}")
    return spark.read.parquet(f"{path}/batch={batches[-1]}")


def snapshot_to_table(
    stream: DataFrame, path: str, checkpoint: str, trigger_now: bool = False, interval: str = "5 minutes", keep: int = 2
) -> StreamingQuery:
    """Write the table of a complete-mode aggregate anew with each batch and publish it at once.

    The last ``keep`` batches stay, so a reader of the one before can end; a
    batch that runs again replaces its own folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        system, root = file_system(path)
        for old in snapshot_batches(path)[:-keep]:
            system.delete_dir(f"{root}/batch={old}")

    writer = stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint)
    return _start(writer, trigger_now, interval)


def ledger_append(
    stream: DataFrame, path: str, checkpoint: str, key: Sequence[str] = LEDGER_KEY, trigger_now: bool = False,
    interval: str = "5 minutes",
) -> StreamingQuery:
    """Append recommendations; a replayed batch adds nothing because keys are checked."""
    def write(batch: DataFrame, batch_id: int) -> None:
        append_recommendations(batch, path, key)

    writer = stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
    return _start(writer, trigger_now, interval)
