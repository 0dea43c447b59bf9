"""SQL functions: grid cells, ST codes and cell boxes, and the cover as a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gridloom.functions.geohash import ALPHABET
from gridloom.functions.timecode import GRID_PREFIX


def _bits(value: str, width: str) -> str:
    return f"lpad(conv(CAST({value} AS STRING), 10, 2), {width}, '0')"


def register(spark: SparkSession) -> None:
    """Create temporary SQL functions ``grid_cell``, ``cell_parent``, ``cell_bbox``, ``st_code`` and the table function ``grid_cover``.

    All are SQL expressions that Catalyst puts in line.  ``grid_cover(west, south, east, north,
    level, mode)`` gives geohash cells, mode ``intersect`` or ``contain``; minimal covers have
    several levels and are made by ``cover_bbox``.
    """
    x = "CAST(floor(((CASE WHEN lon = 180 THEN -180 ELSE lon END) + 180D) / 360D * pow(2D, (5 * level + 1) div 2)) AS BIGINT)"
    y = "least(CAST(floor((lat + 90D) / 180D * pow(2D, 5 * level div 2)) AS BIGINT), CAST(pow(2D, 5 * level div 2) AS BIGINT) - 1)"
    bits = (
        f"concat(array_join(transform(sequence(1, 5 * level), m -> CASE WHEN m % 2 = 1 THEN substr({_bits(x, '(5 * level + 1) div 2')}, (m + 1) div 2, 1) "
        f"ELSE substr({_bits(y, '5 * level div 2')}, m div 2, 1) END), ''))"
    )
    code = f"array_join(transform(sequence(1, level), k -> substr('{ALPHABET}', CAST(conv(substr({bits}, 5 * k - 4, 5), 2, 10) AS INT) + 1, 1)), '')"
    prefixes = " ".join(f"WHEN '{g}' THEN '{p}'" for g, p in GRID_PREFIX.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION grid_cell(lon DOUBLE, lat DOUBLE, level INT) RETURNS STRING RETURN {code}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cell_parent(code STRING) RETURNS STRING RETURN substr(code, 1, length(code) - 1)")
    digit = f"(instr('{ALPHABET}', substr(code, (m + 4) div 5, 1)) - 1)"
    bit = f"(shiftright({digit}, 4 - (m - 1) % 5) & 1)"
    east = f"aggregate(filter(sequence(1, 5 * length(code)), m -> m % 2 = 1), 0D, (a, m) -> a + {bit} * 360D / pow(2D, (m + 1) div 2))"
    north = f"aggregate(filter(sequence(1, 5 * length(code)), m -> m % 2 = 0), 0D, (a, m) -> a + {bit} * 180D / pow(2D, m div 2))"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION cell_bbox(code STRING) RETURNS STRUCT<min_lon: DOUBLE, min_lat: DOUBLE, max_lon: DOUBLE, max_lat: DOUBLE> RETURN "
        f"named_struct('min_lon', {east} - 180D, 'min_lat', {north} - 90D, 'max_lon', {east} - 180D + 360D / pow(2D, (5 * length(code) + 1) div 2), "
        f"'max_lat', {north} - 90D + 180D / pow(2D, 5 * length(code) div 2))"
    )
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION st_code(grid STRING, level INT, code STRING, ts TIMESTAMP) RETURNS STRING RETURN "
        f"concat_ws(':', CASE grid {prefixes} END, level, code, date_format(ts, 'yyyyMMdd'))"
    )
    # Cells of a box, for lateral use; a box whose west is above its east crosses the dateline.
    # The arguments become columns first: lambdas do not see a function's parameters.
    parts = "CASE WHEN west > east THEN array(named_struct('a', west, 'b', 180D), named_struct('a', -180D, 'b', east)) ELSE array(named_struct('a', west, 'b', east)) END"
    inside = "CASE WHEN mode IN ('intersect', 'contain') THEN mode = 'contain' ELSE CAST(raise_error('unsupported cover mode: ' || mode) AS BOOLEAN) END"
    first = lambda low, size: f"IF(inside, ceil({low} / {size}), floor({low} / {size}))"
    last = lambda high, size, end: f"least(IF(inside, floor({high} / {size}), ceil({high} / {size})), {end})"
    span = lambda low, end: f"filter(sequence(greatest({low}, 0L), greatest({end}, {low}, 0L)), k -> k < {end})"
    named = bits.replace(x, "i").replace(y, "j")
    text = f"array_join(transform(sequence(1, level), k -> substr('{ALPHABET}', CAST(conv(substr({named}, 5 * k - 4, 5), 2, 10) AS INT) + 1, 1)), '')".replace("level", "lev")
    columns, lines = "CAST(pow(2D, (5 * lev + 1) div 2) AS BIGINT)", "CAST(pow(2D, 5 * lev div 2) AS BIGINT)"
    wide, high = "(360D / pow(2D, (5 * lev + 1) div 2))", "(180D / pow(2D, 5 * lev div 2))"
    bounds = f"{first('(p.a + 180D)', wide)} AS i0, {last('(p.b + 180D)', wide, columns)} AS i1, {first('(s + 90D)', high)} AS j0, {last('(n + 90D)', high, lines)} AS j1"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION grid_cover(west DOUBLE, south DOUBLE, east DOUBLE, north DOUBLE, level INT, mode STRING) RETURNS TABLE(space_code STRING) RETURN "
        f"SELECT {text} FROM (SELECT lev, {bounds} FROM (SELECT explode({parts}) AS p, south AS s, north AS n, level AS lev, {inside} AS inside)), "
        f"LATERAL explode({span('i0', 'i1')}) AS t(i), LATERAL explode({span('j0', 'j1')}) AS v(j)"
    )
