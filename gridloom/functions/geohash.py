"""Geohash arithmetic as Column expressions.

A cell is handled as two integers, its column ``x`` and row ``y`` at the cell's
own level, for as long as possible: covers, neighbours and parents are integer
arithmetic, and the text code is written once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the geohash base-32 alphabet.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"

MAX_LEVEL = 12


def lon_bits(level: int) -> int:
    return (5 * level + 1) // 2


def lat_bits(level: int) -> int:
    return 5 * level // 2


def columns_at(level: int) -> int:
    """Number of cells around the globe at a level."""
    return 1 << lon_bits(level)


def rows_at(level: int) -> int:
    """Number of cells from pole to pole at a level."""
    return 1 << lat_bits(level)


def cell_width(level: int) -> float:
    return 360.0 / columns_at(level)


def cell_height(level: int) -> float:
    return 180.0 / rows_at(level)


def column_index(lon: Column, level: int) -> Column:
    """Cell column of a longitude; 180 degrees is the same meridian as -180."""
    n = columns_at(level)
    wrapped = F.when(lon == 180.0, F.lit(-180.0)).otherwise(lon)
    return F.floor((wrapped + 180.0) / 360.0 * F.lit(float(n))).cast("long")


def row_index(lat: Column, level: int) -> Column:
    """Cell row of a latitude; the north pole belongs to the top row."""
    n = rows_at(level)
    return F.least(F.floor((lat + 90.0) / 180.0 * F.lit(float(n))).cast("long"), F.lit(n - 1).cast("long"))


def _interleave(lon_part: int, lat_part: int, k: int) -> int:
    """Digit of character ``k`` from its longitude and latitude bits (3+2 at even places, 2+3 at odd)."""
    digit = 0
    for bit in range(5):
        # The lowest bit belongs to longitude at even places and to latitude at odd ones.
        from_lon = (bit + k) % 2 == 0
        source = lon_part if from_lon else lat_part
        digit |= ((source >> (bit // 2)) & 1) << bit
    return digit


# Characters by (longitude bits, latitude bits) of even and odd places.
_EVEN_CHARS = "".join(ALPHABET[_interleave(a, b, 0)] for a in range(8) for b in range(4))
_ODD_CHARS = "".join(ALPHABET[_interleave(a, b, 1)] for a in range(4) for b in range(8))


def encode(x: Column, y: Column, level: int) -> Column:
    """Text code of cell (x, y) at a level; two shifts and one look-up per character."""
    x, y = x.cast("long"), y.cast("long")
    chars = []
    for k in range(level):
        nx, ny = lon_bits(k + 1) - lon_bits(k), lat_bits(k + 1) - lat_bits(k)
        px = F.shiftright(x, lon_bits(level) - lon_bits(k + 1)).bitwiseAND(F.lit((1 << nx) - 1).cast("long"))
        py = F.shiftright(y, lat_bits(level) - lat_bits(k + 1)).bitwiseAND(F.lit((1 << ny) - 1).cast("long"))
        table = _EVEN_CHARS if k % 2 == 0 else _ODD_CHARS
        chars.append(F.substring(F.lit(table), (px * (1 << ny) + py + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)


def cell_of(lon: Column, lat: Column, level: int) -> Column:
    """Code of the cell that holds a point."""
    return encode(column_index(lon, level), row_index(lat, level), level)


def _corner30(code: Column) -> tuple[Column, Column]:
    """South-west corner of a code of any length as two 30-bit integers."""
    padded = F.rpad(code, MAX_LEVEL, ALPHABET[0])
    x = y = None
    for k in range(MAX_LEVEL):
        nx, ny = lon_bits(k + 1) - lon_bits(k), lat_bits(k + 1) - lat_bits(k)
        table = _EVEN_CHARS if k % 2 == 0 else _ODD_CHARS
        at = (F.instr(F.lit(table), F.substring(padded, k + 1, 1)) - 1).cast("long")
        px = F.shiftleft(F.shiftright(at, ny), lon_bits(MAX_LEVEL) - lon_bits(k + 1))
        py = F.shiftleft(at.bitwiseAND(F.lit((1 << ny) - 1).cast("long")), lat_bits(MAX_LEVEL) - lat_bits(k + 1))
        x = px if x is None else x.bitwiseOR(px)
        y = py if y is None else y.bitwiseOR(py)
    return x, y


def decode(code: Column, level: int) -> tuple[Column, Column]:
    """Column and row of a code at its level."""
    x, y = _corner30(code)
    return F.shiftright(x, 30 - lon_bits(level)), F.shiftright(y, 30 - lat_bits(level))


def bbox_of(code: Column) -> dict[str, Column]:
    """Box of a code of any length; every edge is an exact binary fraction."""
    x, y = _corner30(code)
    n = F.length(code)
    west = x * F.lit(360.0 / (1 << 30)) - 180.0
    south = y * F.lit(180.0 / (1 << 30)) - 90.0
    width = F.lit(360.0) / F.pow(F.lit(2.0), F.floor((n * 5 + 1) / 2))
    height = F.lit(180.0) / F.pow(F.lit(2.0), F.floor(n * 5 / 2))
    return {"min_lon": west, "min_lat": south, "max_lon": west + width, "max_lat": south + height}


def bbox_of_index(x: Column, y: Column, level: int) -> dict[str, Column]:
    w, h = cell_width(level), cell_height(level)
    return {
        "min_lon": x * F.lit(w) - 180.0,
        "min_lat": y * F.lit(h) - 90.0,
        "max_lon": (x + 1) * F.lit(w) - 180.0,
        "max_lat": (y + 1) * F.lit(h) - 90.0,
    }


def neighbor_offsets(k: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dy in range(-k, k + 1) for dx in range(-k, k + 1) if (dx, dy) != (0, 0)]


def index_range(lo: Column, hi: Column, origin: float, size: float, n: int, mode: str) -> tuple[Column, Column]:
    """First and last cell index of an interval on one axis.

    ``intersect`` keeps cells that share a positive length with the interval,
    ``contain`` keeps cells that lie inside it.
    """
    a = (lo - origin) / F.lit(size)
    b = (hi - origin) / F.lit(size)
    if mode == "contain":
        first, last = F.ceil(a), F.floor(b) - 1
    else:
        first, last = F.floor(a), F.ceil(b) - 1
    return F.greatest(first.cast("long"), F.lit(0).cast("long")), F.least(last.cast("long"), F.lit(n - 1).cast("long"))


def encode_number(x: int, y: int, level: int) -> str:
    """Text code of one cell given as plain integers."""
    chars = []
    for k in range(level):
        nx, ny = lon_bits(k + 1) - lon_bits(k), lat_bits(k + 1) - lat_bits(k)
        a = (x >> (lon_bits(level) - lon_bits(k + 1))) & ((1 << nx) - 1)
        b = (y >> (lat_bits(level) - lat_bits(k + 1))) & ((1 << ny) - 1)
        chars.append((_EVEN_CHARS if k % 2 == 0 else _ODD_CHARS)[(a << ny) + b])
    return "".join(chars)
