"""Satellite observations: scans, normalization and product guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom import schemas

# Product types and the other names they go by.
PRODUCTS = {"xco2": ("xco2", "oco2_lite", "oco2"), "tansat": ("tansat", "tansat_xco2")}
# Names a value may have in an XCO2 extract, first one present wins.
XCO2_ALIASES = {
    "lat": ("latitude", "lat"),
    "lon": ("longitude", "lon"),
    "time": ("time",),
    "xco2": ("xco2", "xco2_no_bias_correction"),
    "quality_flag": ("xco2_quality_flag", "quality_flag", "retr_flag", "qa_value"),
    "observation_id": ("sounding_id", "exposure_id", "exposureID", "observation_id"),
}
FILL_LIMIT = -999000.0


def product_type(name: str) -> str:
    """Product of a name or alias."""
    wanted = name.strip().lower().replace("-", "_")
    for product, names in PRODUCTS.items():
        if wanted in names:
            return product
    raise ValueError(f"unsupported carbon product type: {name}")


def read_observations(spark: SparkSession, path: str, product: str = "xco2") -> DataFrame:
    """Raw observation rows of ``.jsonl`` or ``.csv`` files as texts, with the file they came from."""
    product_type(product)
    file_path = F.col("_metadata.file_path").alias("file_path")
    if not path.rstrip("/").endswith(".csv"):
        return spark.read.schema(schemas.OBSERVATION).json(path).select("*", file_path)
    rows = spark.read.option("header", True).csv(path).select("*", file_path)
    for name in [c.strip().split(" ")[0] for c in schemas.OBSERVATION.split(",")]:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    return rows


def _given(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def with_row_index(df: DataFrame, by: str, order: str, out: str = "row_index") -> DataFrame:
    """Position of each row within its file, from 0, only for callers that need it.

    Files are numbered in pieces: rows per block of ``order`` are counted first,
    and a row's position is the rows before its block plus its rank in the block,
    so a huge file is never ranked by one task.
    """
    block = F.floor(F.col(order) / 100_000)
    counted = df.withColumn("__b", block)
    sizes = counted.groupBy(by, "__b").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("__start", F.coalesce(before, F.lit(0))).drop("__n")
    ranked = counted.withColumn("__r", F.row_number().over(Window.partitionBy(by, "__b").orderBy(order)))
    return ranked.join(starts, [by, "__b"]).withColumn(out, F.col("__start") + F.col("__r") - 1).drop("__b", "__start", "__r")


def normalize_observations(rows: DataFrame, index: str = "row_index", file: str = "file_path") -> DataFrame:
    """Typed observations: id and source fallbacks, footprint ring and metadata from JSON text."""
    ring = F.from_json("footprint", "array<array<double>>")
    points = F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    closed = F.when(F.element_at(points, 1) != F.element_at(points, -1), F.concat(points, F.slice(points, 1, 1))).otherwise(points)
    return rows.select(
        "satellite",
        F.coalesce(_given("observation_id"), _given("sounding_id"), F.col(index).cast("string")).alias("observation_id"),
        F.col("acq_time").try_cast("timestamp").alias("acq_time"),
        F.col("lon").try_cast("double").alias("lon"), F.col("lat").try_cast("double").alias("lat"), F.col("xco2").try_cast("double").alias("xco2"),
        "quality_flag", F.when(F.size(ring) > 0, closed).alias("footprint"),
        F.coalesce(_given("source_uri"), F.col(file)).alias("source_uri"),
        F.coalesce(_given("source_index").try_cast("bigint"), F.col(index).cast("bigint")).alias("source_index"),
        F.coalesce(F.from_json(_given("metadata"), "map<string,string>"), F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def footprint_geojson(lon: Column, lat: Column, ring: Column) -> Column:
    """GeoJSON text: the ring as a polygon, else the point."""
    from gridloom.functions.shapes import ring_geojson

    point = F.concat(F.lit('{"type":"Point","coordinates":['), lon.cast("string"), F.lit(","), lat.cast("string"), F.lit("]}"))
    return F.coalesce(F.when(ring.isNotNull(), ring_geojson(ring)), point)


def is_measured(*values: Column) -> Column:
    """Numbers that are finite and no fill value."""
    ok = F.lit(True)
    for v in values:
        ok = ok & F.coalesce(~F.isnan(v) & (v > FILL_LIMIT) & (v < float("inf")), F.lit(False))
    return ok


def sounding_time(sounding_id: Column) -> Column:
    """Time in a sounding id: 14 digits to the second, then a digit of tenths."""
    base = F.try_to_timestamp(F.substring(sounding_id, 1, 14), F.lit("yyyyMMddHHmmss"))
    tenths = F.coalesce(F.substring(sounding_id, 15, 1).try_cast("int"), F.lit(0))
    return F.timestamp_micros(F.unix_micros(base) + tenths * 100000)


def normalize_oco2(df: DataFrame) -> DataFrame:
    """Observations of a lite extract (``sounding_id, latitude, longitude, time, xco2, flag`` and four vertices); fill values are dropped."""
    good = is_measured(F.col("latitude"), F.col("longitude"), F.col("xco2"), F.col("time"))
    sid = F.col("sounding_id").cast("string")
    pairs = F.arrays_zip(F.slice("vertex_longitude", 1, 4).alias("lon"), F.slice("vertex_latitude", 1, 4).alias("lat"))
    return df.filter(good).select(
        F.lit("OCO2").alias("satellite"), sid.alias("observation_id"), sounding_time(sid).alias("acq_time"), F.col("longitude").alias("lon"),
        F.col("latitude").alias("lat"), "xco2", F.col("xco2_quality_flag").cast("int").cast("string").alias("quality_flag"),
        F.concat(pairs, F.slice(pairs, 1, 1)).alias("footprint"), "source_uri", "source_index",
    )


def mission(named: Column, file: Column, columns: list[str]) -> Column:
    """Satellite from an attribute text, else from the file name, else from the columns there are."""
    known = lambda c: F.when(F.lower(c).contains("tansat"), "TanSat").when(F.lower(c).contains("oco"), "OCO2")
    text = F.nullif(F.trim(named), F.lit(""))
    last = "TanSat" if {"exposure_id", "exposureID"} & set(columns) else "OCO2"
    return F.coalesce(known(text), text, known(F.element_at(F.split(file, "/"), -1)), F.lit(last))


def observation_time(value: Column, units: Column | None = None) -> Column:
    """Time from CF units (``seconds since ...``), Unix seconds, 14 digits or ISO text."""
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")
    digits = F.when(F.length(text) == 14, F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")))
    unix = F.timestamp_micros((number * 1000000).cast("bigint"))
    iso = text.try_cast("timestamp")
    plain = F.when(number.isNull(), iso).otherwise(F.coalesce(F.when(text.rlike(r"^\d{14}$"), digits), unix))
    if units is None:
        return plain
    unit = F.lower(F.regexp_extract(units, r"^\s*(\w+?)s?\s+since\s+", 1))
    origin = F.regexp_extract(units, r"since\s+(.*)$", 1).try_cast("timestamp")
    scale = F.try_element_at(F.create_map(*[F.lit(v) for p in (("second", 1.0), ("minute", 60.0), ("hour", 3600.0), ("day", 86400.0)) for v in p]), unit)
    since = F.timestamp_micros(F.unix_micros(origin) + F.round(number * scale * 1000000).cast("bigint"))
    return F.coalesce(since, plain)


def normalize_xco2(df: DataFrame, satellite: str | None = None, units: str | None = None, file: str = "source_uri", aliases: dict | None = None) -> DataFrame:
    """Observations of a generic extract, whatever names its columns go by; fill values are dropped."""
    names = aliases or XCO2_ALIASES

    def pick(key, required=False):
        there = [c for c in names[key] if c in df.columns]
        if required and not there:
            raise ValueError(f"extract has no column for {key}")
        return F.coalesce(*[F.col(c).cast("string") for c in there]) if there else F.lit(None).cast("string")

    number = lambda key: pick(key, True).try_cast("double")
    lat, lon, xco2 = number("lat"), number("lon"), number("xco2")
    when = observation_time(pick("time", True), F.col(units) if units else None)
    return df.filter(is_measured(lat, lon, xco2)).select(
        mission(F.col(satellite) if satellite else F.lit(None).cast("string"), F.col(file), df.columns).alias("satellite"),
        F.coalesce(F.nullif(pick("observation_id"), F.lit("")), F.col("source_index").cast("string")).alias("observation_id"),
        when.alias("acq_time"), lon.alias("lon"), lat.alias("lat"), xco2.alias("xco2"), F.nullif(pick("quality_flag"), F.lit("")).alias("quality_flag"),
        F.col(file).alias("source_uri"), "source_index",
    )


def resolve_product(df: DataFrame, product: str) -> DataFrame:
    """Set the product type; TanSat products accept TanSat rows only, others make the job fail."""
    name = product_type(product)
    out = df.withColumn("product_type", F.lit(name))
    if name == "tansat":
        ok = F.lower("satellite") == "tansat"
        text = F.concat(F.lit("TanSat product requires TanSat observations, found: "), F.col("satellite"))
        out = out.withColumn("satellite", F.when(ok, F.col("satellite")).otherwise(F.raise_error(text)))
    return out


def foreign_satellites(df: DataFrame) -> DataFrame:
    """Satellites other than TanSat with their row counts: what the guard would refuse."""
    return df.filter(F.lower("satellite") != "tansat").groupBy("satellite").agg(F.count("*").alias("n"))


def limit_observations(df: DataFrame, n: int | None, order: list[str], indexes: DataFrame | None = None) -> DataFrame:
    """At most ``n`` observations in source order, and only listed source indexes where a list is given."""
    out = df.join(indexes, "source_index", "left_semi") if indexes is not None else df
    return out.orderBy(*order).limit(n) if n is not None else out
