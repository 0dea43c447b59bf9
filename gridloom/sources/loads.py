"""Load documents (batch, datasets, scenes, assets, bands) flattened into tables, and index row scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom import schemas
from gridloom.functions import identity

# Band type of each data type where none is given.
DEFAULT_BAND_TYPES = {"optical": "spectral", "radar": "polarization", "product": "variable", "carbon": "variable"}


def default_band_type(data_type: Column) -> Column:
    pairs = [F.lit(v) for item in DEFAULT_BAND_TYPES.items() for v in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), data_type), F.lit("variable"))


def auto_band_code(data_type: Column, uri: Column, number: Column) -> Column:
    """``auto-<type>-<12 hex>-<n>`` for a band without a code."""
    return F.concat_ws("-", F.lit("auto"), data_type, F.substring(identity.joined_hash(data_type, uri), 1, 12), number.cast("string"))


def parse_load(docs: DataFrame, column: str = "doc") -> DataFrame:
    """JSON load documents as nested rows."""
    return docs.select(F.from_json(column, schemas.LOAD).alias("d")).select("d.*")


def flatten_load(docs: DataFrame, column: str = "doc") -> dict[str, DataFrame]:
    """Five tables of JSON load documents: batches, datasets, scenes, assets, bands, each with the keys above it."""
    return load_tables(parse_load(docs, column))


def load_tables(d: DataFrame) -> dict[str, DataFrame]:
    """The five tables of parsed load documents; where several are used, stage the documents first."""
    batches = d.select("load_batch_id", "batch_name")
    sets = d.select("load_batch_id", F.explode("datasets").alias("x")).select("load_batch_id", "x.*")
    sc = sets.select("load_batch_id", "dataset_code", "data_type", F.explode("scenes").alias("x")).select("load_batch_id", "dataset_code", "data_type", "x.*")
    sc = sc.withColumn("scene_id", identity.scene_identity("dataset_code", "scene_key"))
    assets = sc.select("load_batch_id", "data_type", "scene_id", F.explode("assets").alias("x")).select("load_batch_id", "data_type", "scene_id", "x.*")
    assets = assets.withColumn("asset_id", identity.asset_id("source_uri"))
    # An asset without bands still has one, with a made code.
    bands = assets.select("load_batch_id", "data_type", "scene_id", "asset_id", "source_uri", F.posexplode_outer("bands").alias("pos", "x"))
    number = F.coalesce("pos", F.lit(0)) + 1
    bands = bands.select(
        "load_batch_id", "scene_id", "asset_id",
        F.coalesce(F.nullif(F.trim("x.band_code"), F.lit("")), auto_band_code(F.col("data_type"), F.col("source_uri"), number)).alias("band_code"),
        F.col("x.band_name").alias("band_name"),
        F.coalesce(F.nullif(F.trim("x.band_type"), F.lit("")), default_band_type(F.col("data_type"))).alias("band_type"),
        F.coalesce(F.when(F.col("x.source_band_index") > 0, F.col("x.source_band_index")), number).alias("source_band_index"), number.alias("display_order"),
    )
    bands = bands.withColumn("band_unit_id", identity.band_unit_id("scene_id", "asset_id", "band_code"))
    return {
        "batches": batches,
        "datasets": sets.drop("scenes"),
        "scenes": sc.drop("assets"),
        "assets": assets.drop("bands"),
        "bands": bands,
    }


def repeated_band_indexes(bands: DataFrame) -> DataFrame:
    """Assets that give one source band index twice."""
    return bands.groupBy("load_batch_id", "asset_id", "source_band_index").agg(F.count("*").alias("n")).filter("n > 1")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file_path``, ``line_number`` (from 1 in each file, blank lines counted) and ``value`` of every line of text files.

    A split of a file numbers its lines alone; the counts of the splits before it, a row for each,
    tell where it starts.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").withColumn("__at", F.monotonically_increasing_id())
    splits = lines.groupBy("file_path", "file_block_start").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1
    splits = splits.select("file_path", "file_block_start", shift.alias("__shift"))
    numbered = lines.join(splits, ["file_path", "file_block_start"])
    return numbered.select("file_path", (F.col("__at") + F.col("__shift")).alias("line_number"), "value")


def lines_before(spark: SparkSession, path: str, whole: Column) -> DataFrame:
    """``file_path`` and ``before``, the lines in the files before it, where text files of one ``whole`` go on from each other in name order.

    One row per file, so the running sum is over the list of files.
    """
    files = spark.read.text(path).select("_metadata.file_path").groupBy("file_path").agg(F.count("*").alias("n"))
    before = Window.partitionBy(whole).orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file_path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def read_index_rows(spark: SparkSession, path: str, line_numbers: bool = False) -> DataFrame:
    """Index rows of partition files (JSON lines); with ``file_path`` and ``line_number`` only where asked for.

    Blank lines are no rows but count as lines.
    """
    if not line_numbers:
        return spark.read.schema(schemas.INDEX_ROW).json(path)
    lines = numbered_lines(spark, path).filter(F.trim(F.regexp_replace("value", r"\s", "")) != "")
    return lines.select(F.from_json("value", schemas.INDEX_ROW).alias("r"), "file_path", "line_number").select("r.*", "file_path", "line_number")
