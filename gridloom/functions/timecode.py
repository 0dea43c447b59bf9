"""Time buckets and space-time (ST) codes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The date pattern of each granularity.
TIME_PATTERNS = {
    "year": "yyyy",
    "month": "yyyyMM",
    "day": "yyyyMMdd",
    "hour": "yyyyMMddHH",
    "minute": "yyyyMMddHHmm",
    "second": "yyyyMMddHHmmss",
}

# ST code prefix of each grid.
GRID_PREFIX = {"geohash": "gh", "mgrs": "mgrs", "isea4h": "i4h"}

# Accepted levels of each grid (lowest, highest).
GRID_LEVELS = {"geohash": (1, 12), "mgrs": (0, 5), "isea4h": (0, 15)}

ST_PATTERN = r"^([a-z0-9]+):(\d+):([^:]+):(\d+)$"


def utc_timestamp(c: Column | str) -> Column:
    """A zoned timestamp from a timestamp, a zone-less timestamp or ISO text (zone-less means UTC)."""
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("timestamp")


def time_bucket(ts: Column | str, granularity: str = "day") -> Column:
    """UTC bucket text of a timestamp, ``yyyy`` up to ``yyyyMMddHHmmss``."""
    if granularity not in TIME_PATTERNS:
        raise ValueError(f"unsupported time granularity: {granularity}")
    return F.date_format(utc_timestamp(ts), TIME_PATTERNS[granularity])


def source_zone_bucket(iso_text: Column | str, granularity: str = "day") -> Column:
    """Bucket taken from the wall clock written in ISO text, whatever its offset."""
    col = F.col(iso_text) if isinstance(iso_text, str) else iso_text
    digits = F.regexp_replace(F.substring(col, 1, 19), "[^0-9]", "")
    return F.substring(F.rpad(digits, 14, "0"), 1, len(TIME_PATTERNS[granularity].replace("'", "")))


def st_granularity(granularity: str) -> str:
    """Annual buckets carry the acquisition day in the ST code."""
    return "day" if granularity == "year" else granularity


def grid_prefix(grid_type: Column) -> Column:
    pairs = [F.lit(part) for pair in GRID_PREFIX.items() for part in pair]
    return F.element_at(F.create_map(*pairs), grid_type)


def st_code(grid_type: Column, level: Column, code: Column, ts: Column | str, granularity: str = "day") -> Column:
    """``prefix:level:cell:timecode``; NULL when any part is NULL."""
    return F.concat(
        grid_prefix(grid_type),
        F.lit(":"),
        level.cast("string"),
        F.lit(":"),
        code,
        F.lit(":"),
        time_bucket(ts, st_granularity(granularity)),
    )


def parse_time_code(code: Column) -> Column:
    """Timestamp of a 6/8/10/12/14 digit time code, NULL for anything that is not a real date."""
    expr = None
    for pattern in ("yyyyMM", "yyyyMMdd", "yyyyMMddHH", "yyyyMMddHHmm", "yyyyMMddHHmmss"):
        hit = F.length(code) == len(pattern)
        value = F.try_to_timestamp(code, F.lit(pattern))
        expr = F.when(hit, value) if expr is None else expr.when(hit, value)
    return expr


def parse_st_code(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Split ST codes into their parts: ``(good, rejects)``; a reject carries its reason."""
    c = F.col(column)
    prefixes = {short: name for name, short in GRID_PREFIX.items()}
    pairs = [F.lit(part) for pair in prefixes.items() for part in pair]
    parsed = df.withColumns(
        {
            "grid_type": F.try_element_at(F.create_map(*pairs), F.regexp_extract(c, ST_PATTERN, 1)),
            "grid_level": F.regexp_extract(c, ST_PATTERN, 2).try_cast("int"),
            "space_code": F.regexp_extract(c, ST_PATTERN, 3),
            "time_code": F.regexp_extract(c, ST_PATTERN, 4),
        }
    )
    parsed = parsed.withColumn("acq_time", parse_time_code(F.col("time_code")))
    reason = (
        F.when(~F.coalesce(c.rlike(ST_PATTERN), F.lit(False)), "format")
        .when(F.col("grid_type").isNull(), "prefix")
        .when(F.col("acq_time").isNull(), "time")
    )
    parsed = parsed.withColumn("reason", reason)
    good = parsed.filter(F.col("reason").isNull()).drop("reason")
    return good, parsed.filter(F.col("reason").isNotNull()).select(*df.columns, "reason")


def with_level_name(df: DataFrame) -> DataFrame:
    """Add the display name of each row's grid and level."""
    return df.withColumn("grid_level_name", F.concat_ws("-", "grid_type", F.col("grid_level").cast("string")))
