"""Asset manifests: scan, validation, boxes, resolutions, file listings and radar batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import schemas

DATA_TYPES = ("optical", "product", "radar")
SUFFIXES = {"optical": ("tif", "tiff"), "product": ("tif", "tiff"), "radar": ("dat", "tif", "tiff")}


def read_manifest(spark: SparkSession, path: str, default_type: str = "optical") -> DataFrame:
    """One row per asset and band of a manifest: ``.jsonl`` rows, or a ``.json`` array or object with ``assets``."""
    if path.rstrip("/").endswith(".jsonl"):
        rows = spark.read.schema(schemas.MANIFEST).json(path)
    else:
        # Both layouts are read with one schema; an array of rows leaves ``assets`` NULL.
        both = spark.read.schema(f"{schemas.MANIFEST}, {schemas.MANIFEST_OBJECT}").option("multiLine", True).json(path)
        own = [c for c in both.columns if c != "assets"]
        wrapped = both.filter(F.col("assets").isNotNull()).select(F.explode("assets").alias("a")).select("a.*")
        rows = both.filter(F.col("assets").isNull()).select(*own).unionByName(wrapped)
    return manifest_rows(rows, default_type)


def parse_resolution(c: Column) -> Column:
    """Metres from text such as ``30m``; NULL for anything that is not a positive number."""
    value = F.trim(F.regexp_replace(F.lower(c.cast("string")), "m", "")).try_cast("double")
    return F.when(value > 0, value)


def manifest_rows(rows: DataFrame, default_type: str = "optical") -> DataFrame:
    """Trim and default manifest fields; one row per asset and band, a NULL band where none is given."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    listed = F.filter(F.transform(F.coalesce("bands", F.array().cast("array<string>")), lambda b: F.lower(F.trim(b))), lambda b: b != "")
    single = F.lower(F.trim(F.coalesce(F.nullif("band", F.lit("")), F.nullif("variable", F.lit("")), F.nullif("polarization", F.lit("")))))
    names = F.when(F.size(listed) > 0, listed).otherwise(F.array(F.nullif(single, F.lit(""))))
    family = F.coalesce(F.nullif("product_family", F.lit("")), F.col("product_type"))
    return rows.withColumn("data_type", F.lower(F.trim(F.coalesce(F.nullif("data_type", F.lit("")), F.lit(default_type))))).select(
        "data_type", text("scene_id").alias("scene_id"), F.explode(names).alias("band"), text("source_uri").alias("path"), text("acq_time").alias("acq_time"),
        F.lower(F.trim(F.coalesce(family, F.lit("")))).alias("product_family"), F.lower(text("sensor")).alias("sensor"),
        parse_resolution(F.col("resolution")).alias("resolution"), "corners",
    )


def _corner_checks(corners: str) -> tuple[Column, Column, Column]:
    """Whether there are four corners, all are pairs, and all lie in WGS84 bounds."""
    four = F.coalesce(F.size(corners) == 4, F.lit(False))
    pairs = F.coalesce(F.forall(corners, lambda p: F.size(p) == 2), F.lit(False))
    inside = F.coalesce(F.forall(corners, lambda p: F.get(p, F.lit(0)).between(-180, 180) & F.get(p, F.lit(1)).between(-90, 90)), F.lit(False))
    return four, pairs, inside


def manifest_problem() -> Column:
    """First problem of a manifest row, or NULL."""
    blank = F.lit(False)
    for c in ("path", "scene_id", "acq_time", "product_family", "sensor"):
        blank = blank | (F.col(c) == "")
    blank = blank | F.col("band").isNull() | F.col("resolution").isNull()
    four, pairs, inside = _corner_checks("corners")
    return (
        F.when(blank, "required_fields").when(~four, "four_corners").when(~pairs, "corner_pair").when(~inside, "corner_range")
        .when(F.col("acq_time").try_cast("timestamp").isNull(), "acq_time").when(~F.col("data_type").isin(*DATA_TYPES), "data_type")
    )


def validate_manifest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)``; a reject carries ``problem``."""
    marked = rows.withColumn("problem", manifest_problem())
    return marked.filter(F.col("problem").isNull()).drop("problem"), marked.filter(F.col("problem").isNotNull())


def with_bbox(df: DataFrame, corners: str = "corners", digits: int | None = None) -> DataFrame:
    """Add the box of corner points (``ARRAY<ARRAY<DOUBLE>>``), rounded where asked; NULLs where the corners are not four pairs in WGS84 bounds."""
    good = reduce(lambda a, b: a & b, _corner_checks(corners))
    lons, lats = F.transform(corners, lambda p: F.get(p, F.lit(0))), F.transform(corners, lambda p: F.get(p, F.lit(1)))
    box = {"min_lon": F.array_min(lons), "min_lat": F.array_min(lats), "max_lon": F.array_max(lons), "max_lat": F.array_max(lats)}
    return df.withColumns({k: F.when(good, F.round(v, digits) if digits is not None else v) for k, v in box.items()})


# Keys under which a resolution may be given.
RESOLUTION_KEYS = (
    "resolution_native", "resolution", "resolution_m", "spatial_resolution", "spatial_resolution_m", "ground_resolution",
    "pixel_size", "pixel_size_m", "gsd", "gsd_m", "resolution_x", "resolution_y", "pixel_size_x", "pixel_size_y",
)
NESTED_KEYS = ("x", "y", "width", "height")


def json_resolution(json: Column) -> Column:
    """Finest positive number under any resolution key of a JSON object.

    A value may be a number, a text with a number in it, a list, or an object
    with the same keys or ``x``/``y``/``width``/``height``.
    """
    fields = F.from_json(json, "map<string,string>")
    values = F.transform(F.array(*[F.lit(k) for k in RESOLUTION_KEYS]), lambda k: F.try_element_at(fields, k))
    return F.array_min(F.filter(F.flatten(F.transform(values, _value_numbers)), lambda v: v > 0))


def _value_numbers(value: Column) -> Column:
    """Numbers in one JSON value: a number or the first in a text, all of a list, those of an object's size keys."""
    text = F.trim(value)
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda t: t.try_cast("double"))
    inner = F.from_json(text, "map<string,string>")
    sizes = F.transform(
        F.array(*[F.lit(k) for k in (*RESOLUTION_KEYS, *NESTED_KEYS)]), lambda k: F.try_element_at(inner, k).try_cast("double")
    )
    none = F.array().cast("array<double>")
    return F.coalesce(
        F.when(text.isin("true", "false"), none)
        .when(F.startswith(text, F.lit("{")), sizes)
        .when(F.startswith(text, F.lit("[")), numbers)
        .otherwise(F.slice(numbers, 1, 1)),
        none,
    )


def finest_resolution(assets: DataFrame, json: str, by: list[str]) -> DataFrame:
    """Finest resolution of each group of assets, from their JSON and its ``attributes``."""
    texts = F.filter(F.array(F.col(json), F.get_json_object(json, "$.attributes")), lambda t: t.isNotNull())
    return assets.withColumn("__r", F.array_min(F.transform(texts, json_resolution))).groupBy(*by).agg(F.min("__r").alias("resolution"))


def scan_assets(spark: SparkSession, root: str, kind: str = "optical") -> DataFrame:
    """Files below a folder with the kind's suffixes; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    return files.filter(asset_suffix(F.col("path")).isin(*SUFFIXES[kind]))


def asset_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def radar_manifest(catalog: DataFrame, batch_id: str, root: str | None = None, source_prefix: str | None = None) -> DataFrame:
    """One JSON text per radar asset of a catalogue (with ``corners`` and pixel sizes), URIs moved under a prefix."""
    uri = F.col("path")
    if source_prefix:
        relative = F.regexp_replace(uri, f"^{root.rstrip('/')}/", "") if root else uri
        uri = F.concat(F.lit(source_prefix.rstrip("/") + "/"), relative)
    boxed = with_bbox(catalog, "corners", 6)
    size = F.greatest(F.abs("pixel_x"), F.abs("pixel_y"))
    row = F.struct(
        uri.alias("source_uri"), "scene_id", F.date_format("acq_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("acq_time"), F.array("band").alias("bands"),
        "band", F.col("band").alias("polarization"), F.when(size > 0, size).alias("resolution"),
        F.array("min_lon", "min_lat", "max_lon", "max_lat").alias("bbox"), "corners", "sensor", "product_family",
    )
    return boxed.select(F.lit(batch_id).alias("batch_id"), uri.alias("source_uri"), F.to_json(row).alias("asset"))
