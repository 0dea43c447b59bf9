"""Views over the given tables: observations, scenes, bands and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Satellite observations from ``events``."""
    e = table(spark, sf_dir, "events")
    key = F.col("event_id")
    return e.select(
        (key % 9500).cast("string").alias("observation_id"),
        F.when(F.col("event_type").isin("view", "click"), "OCO2").otherwise("TanSat").alias("satellite"),
        F.lit("xco2").alias("product_type"),
        F.col("ts").cast("timestamp").alias("acq_time"),
        (((key * 7919) % 36000).cast("double") / 100.0 - 180.0).alias("lon"),
        (((key * 104729) % 17800).cast("double") / 100.0 - 89.0).alias("lat"),
        (F.lit(240.0) + F.col("value")).alias("xco2"),
        F.when(F.col("user_id") % 7 == 0, F.lit(None)).otherwise((F.col("user_id") % 3).cast("string")).alias("quality_flag"),
        F.concat(F.lit("s3://bucket/obs/"), F.col("event_type"), F.lit(".nc4")).alias("source_uri"),
        key.alias("source_index"),
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes with one asset each from ``orders``."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    west = ((key * 37) % 3400).cast("double") / 10.0 - 170.0
    south = ((key * 53) % 1600).cast("double") / 10.0 - 80.0
    return o.select(
        F.concat(F.lit("S"), key).alias("scene_id"),
        F.concat(F.lit("D"), F.col("o_custkey") % 50).alias("dataset_id"),
        F.concat(F.lit("A"), key).alias("asset_id"),
        F.col("o_orderdate").cast("timestamp").alias("acq_time"),
        F.when(F.col("o_orderstatus") == "F", "available").when(F.col("o_orderstatus") == "P", "failed").otherwise("loaded").alias("status"),
        west.alias("min_lon"),
        south.alias("min_lat"),
        (west + 2.0).alias("max_lon"),
        (south + 1.5).alias("max_lat"),
        F.col("o_orderpriority").alias("priority"),
        key.alias("pos"),
    )


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of assets from ``lineitem``."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("A"), F.col("l_orderkey")).alias("asset_id"),
        F.concat(F.lit("b"), F.col("l_linenumber")).alias("band_code"),
        F.when(F.col("l_returnflag") == "A", "spectral").when(F.col("l_returnflag") == "N", "polarization").otherwise("variable").alias("band_type"),
        F.col("l_linenumber").alias("display_order"),
        F.col("l_shipdate").cast("timestamp").alias("time_start"),
        F.col("l_quantity").alias("sample_mean"),
        (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 1000 + F.col("l_quantity").cast("long")).alias("pos"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long pixel table from ``lineitem``."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("A"), F.col("l_orderkey") % 500).alias("asset_path"),
        F.concat(F.lit("b"), F.col("l_linenumber")).alias("band"),
        (F.col("l_partkey") % 64).alias("col"),
        (F.col("l_suppkey") % 64).alias("row"),
        F.when(F.col("l_discount") == 0, 0.0).otherwise(F.col("l_quantity")).alias("value"),
        (F.col("l_tax") > 0).alias("is_valid"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_extendedprice").alias("tie"),
    )
