"""Scene, band, time and sensor from asset file names, as ordered pattern Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Product families and the other names they go by.
FAMILIES = {
    "landsat_l1tp": ("landsat", "landsat_l1tp", "landsat_wrs2", "l1tp"),
    "landsat_collection": ("landsat_collection", "landsat8", "landsat9"),
    "sentinel2": ("sentinel2", "sentinel_2", "sentinel_optical", "s2"),
    "mosaic": ("other", "generic_optical", "shandong", "shandong_optical", "optical_mosaic"),
}
# File name patterns.
L1TP = r"(?i)^L[OCTE][5789]\d{3}\d{3}\d{7}[A-Z0-9]+_[A-Za-z0-9]+$"
SENTINEL2 = r"(?i)^(T\d{2}[A-Z]{3})_(\d{8}T\d{6})_(B\d{2,3}A?)_(\d+m)$"
MOSAIC = r"(?i)^(Shandong_mosaic)_(\d{4}(?:Q[1-4]|\d{2}))_(sr_band\d+)(?:_cut)?$"
SENTINEL1 = r"(?i)^(?:S1[_-]?)?(\d{8})[_-](VV|VH|HH|HV)$"
ANNUAL = r"^(.*)_(\d{4})年$"
# Sensor of each scene prefix.
COLLECTION_SENSORS = {"LC09": "landsat9_oli_tirs", "LC08": "landsat8_oli_tirs", "LE07": "landsat7_etm", "LT05": "landsat5_tm"}
L1TP_SENSORS = {
    "LO8": "landsat8_oli_tirs", "LC8": "landsat8_oli_tirs", "LO9": "landsat9_oli_tirs", "LC9": "landsat9_oli_tirs",
    "LE7": "landsat7_etm", "LT5": "landsat5_tm",
}
OTHER_LANDSAT = "landsat_oli_tirs"
ANNUAL_SCENE_PREFIX = "dianzhong_ecological_security_"


def stem(path: Column) -> Column:
    """File name without folders and last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def _lookup(values: dict, key: Column, other: str) -> Column:
    pairs = [F.lit(v) for item in values.items() for v in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(other))


def _row(scene, band, time, family, sensor) -> Column:
    return F.struct(
        scene.alias("scene_id"), band.alias("band"), time.cast("timestamp").alias("acq_time"),
        F.lit(family).alias("product_family"), sensor.alias("sensor"),
    )


def _landsat_l1tp(s: Column) -> tuple[Column, Column]:
    scene, band = F.split_part(s, F.lit("_"), F.lit(1)), F.split_part(s, F.lit("_"), F.lit(2))
    year, day = F.substring(scene, 10, 4).try_cast("int"), F.substring(scene, 14, 3).try_cast("int")
    time = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day - 1)
    sensor = _lookup(L1TP_SENSORS, F.upper(F.substring(scene, 1, 3)), OTHER_LANDSAT)
    return s.rlike(L1TP), _row(scene, F.lower(band), time, "landsat", sensor)


def _landsat_collection(s: Column) -> tuple[Column, Column]:
    parts = F.split(s, "_")
    scene = F.array_join(F.slice(parts, 1, 7), "_")
    rest = F.array_join(F.slice(parts, F.lit(8), F.greatest(F.size(parts) - 7, F.lit(0))), "_")
    band = F.when(F.size(parts) > 7, F.lower(rest)).otherwise(F.lower(s))
    time = F.try_to_timestamp(F.get(parts, F.lit(3)), F.lit("yyyyMMdd"))
    match = (F.size(parts) >= 7) & F.upper(s).rlike("^(LC08|LC09|LE07|LT05)_")
    return match, _row(scene, band, time, "landsat", _lookup(COLLECTION_SENSORS, F.substring(scene, 1, 4), OTHER_LANDSAT))


def _sentinel2(s: Column) -> tuple[Column, Column]:
    g = [F.regexp_extract(s, SENTINEL2, k) for k in range(1, 5)]
    time = F.try_to_timestamp(F.upper(g[1]), F.lit("yyyyMMdd'T'HHmmss"))
    return s.rlike(SENTINEL2), _row(F.concat(F.lit("S2_"), F.upper(g[0]), F.lit("_"), F.upper(g[1])), F.lower(F.concat_ws("_", g[2], g[3])), time, "sentinel2", F.lit("sentinel2_msi"))


def _mosaic(s: Column) -> tuple[Column, Column]:
    name, period, band = (F.regexp_extract(s, MOSAIC, k) for k in (1, 2, 3))
    year = F.substring(period, 1, 4).try_cast("int")
    quarter = F.regexp_extract(F.upper(period), r"Q(\d)", 1).try_cast("int")
    month = F.when(quarter.isNotNull(), (quarter - 1) * 3 + 1).otherwise(F.substring(period, 5, 2).try_cast("int"))
    valid = month.between(1, 12)
    time = F.make_date(F.when(valid, year), F.when(valid, month), F.lit(1))
    return s.rlike(MOSAIC), _row(F.concat_ws("_", name, period), F.lower(band), time, "other", F.lit("optical_mosaic"))


def _generic(s: Column) -> Column:
    return _row(s, F.lower(s), F.make_date(F.lit(1970), F.lit(1), F.lit(1)), "generic_tif", F.lit("unknown"))


ADAPTERS = {"landsat_l1tp": _landsat_l1tp, "landsat_collection": _landsat_collection, "sentinel2": _sentinel2, "mosaic": _mosaic}


def family_of(name: str) -> str:
    """Adapter of a family name or alias; an unknown name is an error."""
    wanted = name.strip().lower().replace("-", "_")
    for adapter, names in FAMILIES.items():
        if wanted in names:
            return adapter
    raise ValueError(f"unsupported optical product family: {name}")


def extract_asset_metadata(df: DataFrame, family: str = "auto", path: str = "path") -> DataFrame:
    """Add scene, band, time, family and sensor of optical assets.

    ``auto`` takes the first pattern that matches, in fixed order, and a generic
    reading where none does; a named family is taken as it is (NULLs where the name does not fit).
    """
    s = stem(F.col(path))
    if family == "auto":
        hits = [make(s) for make in ADAPTERS.values()]
        meta = F.coalesce(*[F.when(match, row) for match, row in hits], _generic(s))
    else:
        match, row = ADAPTERS[family_of(family)](s)
        meta = F.when(match, row)
    return df.withColumn("__m", meta).select("*", "__m.*").drop("__m")


def extract_product_metadata(df: DataFrame, path: str = "path") -> DataFrame:
    """Add name, year, scene, band and time of annual products ``<name>_YYYY年``; NULLs for other names."""
    s = stem(F.col(path))
    ok, year = s.rlike(ANNUAL), F.regexp_extract(s, ANNUAL, 2).try_cast("int")
    return df.withColumns(
        {
            "product_name": F.when(ok, F.regexp_extract(s, ANNUAL, 1)),
            "product_year": F.when(ok, year),
            "scene_id": F.when(ok, F.concat(F.lit(ANNUAL_SCENE_PREFIX), year.cast("string"))),
            "band": F.when(ok, "product_value"),
            "acq_time": F.when(ok, F.make_date(year, F.lit(1), F.lit(1)).cast("timestamp")),
            "product_family": F.when(ok, "product"),
            "sensor": F.when(ok, "data_product"),
        }
    )


def extract_radar_metadata(df: DataFrame, path: str = "path") -> DataFrame:
    """Add scene, band and time of Sentinel-1 assets ``[S1_]YYYYMMDD_VV``; NULLs for other names."""
    s = stem(F.col(path))
    ok = s.rlike(SENTINEL1)
    day = F.regexp_extract(s, SENTINEL1, 1)
    return df.withColumns(
        {
            "scene_id": F.when(ok, F.concat(F.lit("S1_"), day)),
            "band": F.when(ok, F.lower(F.regexp_extract(s, SENTINEL1, 2))),
            "acq_time": F.when(ok, F.try_to_timestamp(day, F.lit("yyyyMMdd"))),
            "product_family": F.when(ok, "sentinel1"),
            "sensor": F.when(ok, "sentinel1_sar"),
        }
    )
