"""UTM/UPS zones and MGRS references.

Zones, letters, digits, parents and children are Column expressions.  The
projections (the Krueger series to sixth order, and the ellipsoidal polar
stereographic one) run on Arrow batches.
"""

from __future__ import annotations

from math import sqrt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.fence import fence

# WGS84 ellipsoid and the UTM/UPS projection constants.
SEMI_MAJOR = 6378137.0
FLATTENING = 1.0 / 298.257223563
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM_FALSE_NORTHING = 10000000.0
UPS_SCALE = 0.994
UPS_FALSE = 2000000.0

ECC2 = FLATTENING * (2.0 - FLATTENING)
ECC = sqrt(ECC2)
_N = FLATTENING / (2.0 - FLATTENING)
RECTIFYING = SEMI_MAJOR / (1.0 + _N) * (1.0 + _N**2 / 4.0 + _N**4 / 64.0 + _N**6 / 256.0)

# Krueger series coefficients, geodetic to projected.
ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180 - 127 * _N**5 / 288 + 7891 * _N**6 / 37800,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440 + 281 * _N**5 / 630 - 1983433 * _N**6 / 1935360,
    61 * _N**3 / 240 - 103 * _N**4 / 140 + 15061 * _N**5 / 26880 + 167603 * _N**6 / 181440,
    49561 * _N**4 / 161280 - 179 * _N**5 / 168 + 6601661 * _N**6 / 7257600,
    34729 * _N**5 / 80640 - 3418889 * _N**6 / 1995840,
    212378941 * _N**6 / 319334400,
)
# Krueger series coefficients, projected to geodetic.
BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360 - 81 * _N**5 / 512 + 96199 * _N**6 / 604800,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440 + 46 * _N**5 / 105 - 1118711 * _N**6 / 3870720,
    17 * _N**3 / 480 - 37 * _N**4 / 840 - 209 * _N**5 / 4480 + 5569 * _N**6 / 90720,
    4397 * _N**4 / 161280 - 11 * _N**5 / 504 - 830251 * _N**6 / 7257600,
    4583 * _N**5 / 161280 - 108847 * _N**6 / 3991680,
    20648693 * _N**6 / 638668800,
)

# Latitude limits of the UTM area.
UPS_NORTH_LAT = 84.0
UPS_SOUTH_LAT = -80.0

# Latitude band letters from 80 S in steps of 8 degrees (X is 12 high).
BANDS = "CDEFGHJKLMNPQRSTUVWX"
# 100 km column letters of the zones 1, 2 and 3 modulo 3.
COLUMN_LETTERS = ("ABCDEFGH", "JKLMNPQR", "STUVWXYZ")
# 100 km row letters, odd zones; even zones start five letters on.
ROW_LETTERS = "ABCDEFGHJKLMNPQRSTUV"
# Least northing of each latitude band, from C to X, in metres.
BAND_MIN_NORTHING = (
    1100000, 2000000, 2800000, 3700000, 4600000, 5500000, 6400000, 7300000, 8200000, 9100000,
    0, 800000, 1700000, 2600000, 3500000, 4400000, 5300000, 6200000, 7000000, 7900000,
)
# Polar 100 km letters; columns west and east of the pole, rows, and row origins.
UPS_WEST_COLUMNS = "JKLPQRSTUXYZ"
UPS_EAST_COLUMNS = "ABCFGHJKLPQR"
UPS_ROWS = "ABCDEFGHJKLMNPQRSTUVWXYZ"
UPS_COLUMN_ORIGIN = 800000.0
UPS_ROW_ORIGIN_NORTH = 1300000.0
UPS_ROW_ORIGIN_SOUTH = 800000.0

# The widened zones (west, east, south, north, zone) of Norway and Svalbard.
WIDE_ZONES = (
    (3.0, 12.0, 56.0, 64.0, 32),
    (0.0, 9.0, 72.0, 84.0, 31),
    (9.0, 21.0, 72.0, 84.0, 33),
    (21.0, 33.0, 72.0, 84.0, 35),
    (33.0, 42.0, 72.0, 84.0, 37),
)


def letter(letters: str, index0: Column) -> Column:
    """The letter at a zero-based position."""
    return F.substring(F.lit(letters), (index0 + 1).cast("int"), F.lit(1))


def utm_zone(lon: Column, lat: Column) -> Column:
    """UTM zone 1..60 of a point between 80 S and 84 N."""
    wrapped = F.when(lon == 180.0, F.lit(-180.0)).otherwise(lon)
    expr = None
    for west, east, south, north, zone in WIDE_ZONES:
        hit = (lat >= south) & (lat < north) & (wrapped >= west) & (wrapped < east)
        expr = F.when(hit, zone) if expr is None else expr.when(hit, zone)
    regular = (F.floor((wrapped + 180.0) / 6.0).cast("int") % 60) + 1
    return expr.otherwise(regular).cast("int")


def domain_columns(lon: Column, lat: Column) -> dict[str, Column]:
    """Kind (utm/ups), zone, hemisphere, token and EPSG code of the projected domain of a point."""
    north_pole, south_pole = lat >= UPS_NORTH_LAT, lat <= UPS_SOUTH_LAT
    polar = north_pole | south_pole
    zone = F.when(~polar, utm_zone(lon, lat))
    hemisphere = F.when(lat >= 0.0, "n").otherwise("s")
    return {
        "domain_kind": F.when(polar, "ups").otherwise("utm"),
        "zone": zone,
        "hemisphere": hemisphere,
        "domain": F.when(polar, F.concat(F.lit("ups-"), hemisphere)).otherwise(
            F.concat(F.lit("utm-"), zone.cast("string"), hemisphere)
        ),
        "epsg": F.when(north_pole, 32661)
        .when(south_pole, 32761)
        .otherwise(F.when(lat >= 0.0, 32600).otherwise(32700) + zone),
    }


# Polar scale: 2 a k0 / sqrt((1+e)^(1+e) (1-e)^(1-e)).
UPS_RADIUS = 2.0 * SEMI_MAJOR * UPS_SCALE / sqrt((1 + ECC) ** (1 + ECC) * (1 - ECC) ** (1 - ECC))


def band_index(lat: Column) -> Column:
    return F.least(F.floor((lat + 80.0) / 8.0), F.lit(19)).cast("int")


def _digits(value: Column, precision: int) -> Column:
    if precision == 0:
        return F.lit("")
    step = 10 ** (5 - precision)
    return F.lpad(F.floor((value % 100000.0) / F.lit(float(step))).cast("string"), precision, "0")


def utm_reference(easting: Column, northing: Column, zone: Column, band: Column, precision: int) -> Column:
    """MGRS text from projected coordinates, zone number and zero-based latitude band."""
    col_no = F.floor(easting / 100000.0).cast("int") - 1
    row_no = (F.floor(northing / 100000.0).cast("int") + F.when(zone % 2 == 0, 5).otherwise(0)) % 20
    col_letter = (
        F.when(zone % 3 == 1, letter(COLUMN_LETTERS[0], col_no))
        .when(zone % 3 == 2, letter(COLUMN_LETTERS[1], col_no))
        .otherwise(letter(COLUMN_LETTERS[2], col_no))
    )
    return F.concat(
        F.lpad(zone.cast("string"), 2, "0"),
        letter(BANDS, band),
        col_letter,
        letter(ROW_LETTERS, row_no),
        _digits(easting, precision),
        _digits(northing, precision),
    )


def ups_reference(easting: Column, northing: Column, north: Column, precision: int) -> Column:
    """MGRS text of polar coordinates."""
    west = easting < UPS_FALSE
    first = F.when(north, F.when(west, "Y").otherwise("Z")).otherwise(F.when(west, "A").otherwise("B"))
    origin = F.when(north, UPS_ROW_ORIGIN_NORTH).otherwise(UPS_ROW_ORIGIN_SOUTH)
    return F.concat(
        first,
        F.when(west, letter(UPS_WEST_COLUMNS, F.floor((easting - UPS_COLUMN_ORIGIN) / 100000.0))).otherwise(
            letter(UPS_EAST_COLUMNS, F.floor((easting - UPS_FALSE) / 100000.0))
        ),
        letter(UPS_ROWS, F.floor((northing - origin) / 100000.0)),
        _digits(easting, precision),
        _digits(northing, precision),
    )


def projected(lon: Column, lat: Column) -> Column:
    """Zone, latitude band, polar flag, easting and northing of each point, as one struct (one Arrow-batched call)."""

    @F.pandas_udf("zone int, band int, polar boolean, northern boolean, e double, n double")
    def project(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        import numpy as np

        from gridloom.functions import kernels

        known = (x.notna() & y.notna()).to_numpy()
        lon, lat = x.fillna(0.0).to_numpy(float), y.fillna(0.0).to_numpy(float)
        lon = np.where(lon == 180.0, -180.0, lon)
        zone = np.floor((lon + 180.0) / 6.0).astype(int) % 60 + 1
        for west, east, south, north, owner in WIDE_ZONES:
            zone[(lat >= south) & (lat < north) & (lon >= west) & (lon < east)] = owner
        polar = (lat >= UPS_NORTH_LAT) | (lat <= UPS_SOUTH_LAT)
        band = np.minimum(np.floor((lat + 80.0) / 8.0), 19).astype(int)
        e, n = kernels.project_metric(lon, lat, zone, lat >= 0.0, polar)
        out = pd.DataFrame({"zone": zone, "band": band, "polar": polar, "northern": lat >= 0.0, "e": e, "n": n})
        return out.astype({"e": "Float64", "n": "Float64"}).where(pd.Series(known))

    return project(lon, lat)


def with_cell(df, lon: Column, lat: Column, precision: int, out: str):
    """Add the MGRS reference of each point at a precision of 0 to 5 digit pairs; NULL for a NULL point."""
    p = F.col("__p")
    code = F.when(p["polar"], ups_reference(p["e"], p["n"], p["northern"], precision)).when(
        p["e"].isNotNull(), utm_reference(p["e"], p["n"], p["zone"], p["band"], precision)
    )
    return df.withColumn("__p", projected(lon, lat)).withColumn(out, fence(code)).drop("__p")


def is_polar(code: Column) -> Column:
    return F.substring(code, 1, 1).isin("A", "B", "Y", "Z")


def parse(code: Column, precision: int) -> dict[str, Column]:
    """Zone, band and south-west corner in projected metres of a reference."""
    polar = is_polar(code)
    zone = F.when(~polar, F.substring(code, 1, 2).try_cast("int"))
    band = F.when(~polar, F.instr(F.lit(BANDS), F.substring(code, 3, 1)) - 1)
    col_at = F.when(polar, F.substring(code, 2, 1)).otherwise(F.substring(code, 4, 1))
    row_at = F.when(polar, F.substring(code, 3, 1)).otherwise(F.substring(code, 5, 1))
    head = F.when(polar, 3).otherwise(5)
    step = float(10 ** (5 - precision))
    if precision:
        east_digits = code.substr(head + 1, F.lit(precision)).try_cast("int") * step
        north_digits = code.substr(head + 1 + precision, F.lit(precision)).try_cast("int") * step
    else:
        east_digits, north_digits = F.lit(0.0), F.lit(0.0)
    set_letters = F.element_at(F.array(*[F.lit(v) for v in COLUMN_LETTERS]), (zone + 2) % 3 + 1)
    utm_east = F.instr(set_letters, col_at) * 100000.0
    row_base = F.pmod(F.instr(F.lit(ROW_LETTERS), row_at) - 1 - F.when(zone % 2 == 0, 5).otherwise(0), F.lit(20)) * 100000.0
    least = F.element_at(F.array(*[F.lit(float(v)) for v in BAND_MIN_NORTHING]), band + 1)
    utm_north = row_base + F.ceil(F.greatest(least - row_base, F.lit(0.0)) / 2000000.0) * 2000000.0
    first = F.substring(code, 1, 1)
    west = first.isin("A", "Y")
    north = first.isin("Y", "Z")
    ups_east = F.when(
        west, F.lit(UPS_COLUMN_ORIGIN) + (F.instr(F.lit(UPS_WEST_COLUMNS), col_at) - 1) * 100000.0
    ).otherwise(F.lit(UPS_FALSE) + (F.instr(F.lit(UPS_EAST_COLUMNS), col_at) - 1) * 100000.0)
    ups_north = (
        F.when(north, UPS_ROW_ORIGIN_NORTH).otherwise(UPS_ROW_ORIGIN_SOUTH)
        + (F.instr(F.lit(UPS_ROWS), row_at) - 1) * 100000.0
    )
    return {
        "polar": polar,
        "zone": zone,
        "band": band,
        "northern": F.when(polar, north).otherwise(band >= 10),
        "easting": F.when(polar, ups_east).otherwise(utm_east) + east_digits,
        "northing": F.when(polar, ups_north).otherwise(utm_north) + north_digits,
    }


def parent_of(code: Column) -> Column:
    """Reference one precision up: the last digit of each half is dropped (NULL at precision 0)."""
    head = F.when(is_polar(code), 3).otherwise(5)
    pairs = ((F.length(code) - head) / 2).cast("int")
    return F.when(
        pairs > 0,
        F.concat(
            code.substr(F.lit(1), head),
            code.substr(head + 1, pairs - 1),
            code.substr(head + 1 + pairs, pairs - 1),
        ),
    )


def child_of(code: Column, east_digit: Column, north_digit: Column) -> Column:
    """Reference one precision down, given the next easting and northing digit."""
    head = F.when(is_polar(code), 3).otherwise(5)
    pairs = ((F.length(code) - head) / 2).cast("int")
    return F.concat(
        code.substr(F.lit(1), head),
        code.substr(head + 1, pairs),
        east_digit.cast("string"),
        code.substr(head + 1 + pairs, pairs),
        north_digit.cast("string"),
    )
