"""Structured Streaming forms of the observation and fact pipelines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import facts, partitioning, quality
from gridloom.operators.grid import assign_cells


def stream_observations(spark: SparkSession, path: str, schema, grid: str = "geohash", level: int = 5, files_per_trigger: int = 100, fmt: str = "parquet") -> DataFrame:
    """New observation files (``satellite, observation_id, acq_time, lon, lat, xco2, ...``) as stamped fact rows."""
    raw = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)
    cells = assign_cells(raw.withColumn("acq_time", F.col("acq_time").cast("timestamp")), "lon", "lat", grid, level, "null")
    return partitioning.stamp(cells, "day")


def without_repeats(stream: DataFrame, delay: str = "1 hour", keys: tuple = ("satellite", "observation_id")) -> DataFrame:
    """Each observation once, however often it is delivered within the delay."""
    return stream.withWatermark("acq_time", delay).dropDuplicatesWithinWatermark(list(keys))


def daily_summary(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Running count, least, greatest and mean value per cell and day."""
    return (
        stream.withWatermark("acq_time", delay)
        .groupBy(F.window("acq_time", "1 day"), "grid_type", "grid_level", "space_code")
        .agg(F.count("*").alias("n"), F.min("xco2").alias("xco2_min"), F.max("xco2").alias("xco2_max"), F.avg("xco2").alias("xco2_avg"))
        .select(F.date_format("window.start", "yyyyMMdd").alias("time_bucket"), "grid_type", "grid_level", "space_code", "n", "xco2_min", "xco2_max", "xco2_avg")
    )


def streaming_winner(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Latest scene per cell, bucket and band, for update mode."""
    best = F.max_by(F.struct("scene_id", "asset_path"), F.struct("acq_time", "scene_id")).alias("w")
    return (
        stream.withWatermark("acq_time", delay)
        .groupBy(F.window("acq_time", "1 day"), "grid_type", "grid_level", "space_code", "band")
        .agg(best)
        .select(F.date_format("window.start", "yyyyMMdd").alias("time_bucket"), "grid_type", "grid_level", "space_code", "band", "w.*")
    )


def upsert_sink(path: str, keys: list[str], partition_by: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: the last row of each key of a batch goes into a partitioned table.

    The write is by key, so a batch that is run again after a failure changes nothing.
    """

    def write(batch: DataFrame, _batch_id: int) -> None:
        facts.upsert_table(batch.sparkSession, path, facts.last_per(batch, keys, order), keys, partition_by)

    return write


def completed_versions(stream: DataFrame, keys: tuple = ("dataset_id", "output_version"), status: str = "status") -> DataFrame:
    """Each output version of a stream of version rows (dataset_id, output_version, status) once, when it is first completed.

    The state is one key for each version ever completed, kept without a time limit: a version that is
    delivered again, however late, triggers nothing.
    """
    return stream.filter(F.col(status) == "completed").select(*keys).dropDuplicates(list(keys))


def rules_sink(load_tables: Callable[[DataFrame], quality.Tables], path: str, codes: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: runs the rules once for the output versions that arrived.

    ``load_tables`` gives the tables of those versions; findings go to one folder
    per batch number, so a batch that is run again replaces its own.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        arrived = batch.select("dataset_id", "output_version").distinct()
        findings = quality.evaluate(load_tables(arrived), codes)
        findings.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return write


def evaluate_incrementally(stream: DataFrame, load_tables: Callable[[DataFrame], quality.Tables], path: str, checkpoint: str, codes: list[str] | None = None):
    """Start a query that runs the rules for each output version once it is completed; findings go below ``path``.

    What was evaluated is in ``checkpoint``, so a restart goes on where the last run ended.
    """
    sink = rules_sink(load_tables, path, codes)
    return completed_versions(stream).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
