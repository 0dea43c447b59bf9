"""ISEA4H hexagons: the icosahedral equal-area grid of aperture four.

The globe is ten diamonds of ``n x n`` cells (``n = 2**level``) and two cap
cells.  A cell is the triple (quad, i, j); everything that is index arithmetic
(numbering, neighbours, children, parents) is a Column expression on these
integers.  The projections between degrees and the plane are numpy kernels in
:mod:`gridloom.functions.kernels`.
"""

from __future__ import annotations

from math import acos, asin, atan2, cos, pi, radians, sin, sqrt, tan

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Orientation of the icosahedron (vertex 0) in degrees.
VERTEX0_LON = 11.25
VERTEX0_LAT = 58.28252559
# Latitude of the vertex ring in a frame whose pole is vertex 0.
RING_LAT = 26.565051177
# Snyder's constants for the icosahedron and the plane triangle.
R_PRIME = 0.9103832815
FACE_ANGLE = radians(37.37736814)
THETA_G = radians(36.0)
ORIGIN_X = 0.6022955029
ORIGIN_Y = 0.3477354707
EDGE = 2.0 * ORIGIN_X
# Longitudes given to a cell whose centre is a geographic pole.
NORTH_POLE_LON = -179.1061274
SOUTH_POLE_LON = -157.3603104

# Vertices of the twenty faces.
FACES = (
    (0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 4, 5), (0, 5, 1),
    (6, 2, 1), (7, 3, 2), (8, 4, 3), (9, 5, 4), (10, 1, 5),
    (2, 6, 7), (3, 7, 8), (4, 8, 9), (5, 9, 10), (1, 10, 6),
    (11, 7, 6), (11, 8, 7), (11, 9, 8), (11, 10, 9), (11, 6, 10),
)

TAN_FACE = tan(FACE_ANGLE)
COS_FACE = cos(FACE_ANGLE)
COT30 = 1.0 / tan(radians(30.0))
SIN60 = sqrt(3.0) / 2.0


def _travel(azimuth: float, distance: float) -> tuple[float, float]:
    """Point reached from vertex 0, as (lat, lon) in radians."""
    lat0, lon0 = radians(VERTEX0_LAT), radians(VERTEX0_LON)
    lat = asin(sin(lat0) * cos(distance) + cos(lat0) * sin(distance) * cos(azimuth))
    dlon = atan2(sin(azimuth) * sin(distance) * cos(lat0), cos(distance) - sin(lat0) * sin(lat))
    return lat, (lon0 + dlon + pi) % (2 * pi) - pi


VERTICES = (
    [(radians(VERTEX0_LAT), radians(VERTEX0_LON))]
    + [_travel(-radians(72.0 * k), radians(90.0 - RING_LAT)) for k in range(5)]
    + [_travel(-radians(36.0 + 72.0 * k), radians(90.0 + RING_LAT)) for k in range(5)]
    + [_travel(0.0, pi)]
)


def _unit(lat: float, lon: float) -> tuple[float, float, float]:
    return cos(lat) * cos(lon), cos(lat) * sin(lon), sin(lat)


def _face_frame(face: tuple[int, int, int]) -> dict[str, float]:
    """Centre of a face and the azimuth from it to the face's first vertex."""
    s = [sum(v) for v in zip(*(_unit(*VERTICES[k]) for k in face))]
    norm = sqrt(sum(v * v for v in s))
    x, y, z = (v / norm for v in s)
    lat, lon = asin(z), atan2(y, x)
    vlat, vlon = VERTICES[face[0]]
    turn = atan2(cos(vlat) * sin(vlon - lon), cos(lat) * sin(vlat) - sin(lat) * cos(vlat) * cos(vlon - lon))
    return {"x": x, "y": y, "z": z, "lat": lat, "lon": lon, "turn": turn}


FRAMES = [_face_frame(face) for face in FACES]


def cell_count(level: int) -> int:
    return 10 * 4**level + 2


# ---------------------------------------------------------------------------
# numbering

def seqnum(quad: Column, i: Column, j: Column, level: int) -> Column:
    """Sequence number 1..10*4^level+2 of a cell triple."""
    n = 1 << level
    inner = (quad.cast("long") - 1) * (n * n) + i.cast("long") * n + j.cast("long") + 2
    return F.when(quad == 0, F.lit(1).cast("long")).when(quad == 11, F.lit(cell_count(level)).cast("long")).otherwise(inner)


def triple(seq: Column, level: int) -> tuple[Column, Column, Column]:
    """(quad, i, j) of a sequence number."""
    n = 1 << level
    pole = (seq == 1) | (seq == cell_count(level))
    idx = seq.cast("long") - 2
    quad = F.when(seq == 1, 0).when(seq == cell_count(level), 11).otherwise((F.floor(idx / F.lit(n * n)) + 1).cast("int"))
    inner = F.pmod(idx, F.lit(n * n).cast("long"))
    zero = F.lit(0).cast("long")
    return (
        quad,
        F.when(pole, zero).otherwise(F.shiftright(inner, level)),
        F.when(pole, zero).otherwise(inner.bitwiseAND(F.lit(n - 1).cast("long"))),
    )


def is_valid(seq: Column, level: int) -> Column:
    return F.coalesce((seq >= 1) & (seq <= cell_count(level)), F.lit(False))


def is_pentagon(seq: Column, level: int) -> Column:
    quad, i, j = triple(seq, level)
    return quad.isin(0, 11) | ((i == 0) & (j == 0))


# ---------------------------------------------------------------------------
# gluing of the ten diamonds

def _next(quad: Column) -> Column:
    """The following quad of the same row (1..5 or 6..10)."""
    return F.when(quad <= 5, quad % 5 + 1).otherwise((quad - 5) % 5 + 6)


def _previous(quad: Column) -> Column:
    return F.when(quad <= 5, (quad + 3) % 5 + 1).otherwise((quad - 2) % 5 + 6)


def fold(quad: Column, i: Column, j: Column, level: int) -> tuple[Column, Column, Column]:
    """Move an address that runs one cell off its diamond to the cell's own diamond.

    Valid for -1 <= i, j <= n.  Quads 1..5 touch the north cap at (0, n), quads
    6..10 the south cap at (n, 0); the upper edges belong to the neighbours.
    """
    n = 1 << level
    upper = quad <= 5
    zero, top = F.lit(0).cast("long"), F.lit(n).cast("long")
    cap = F.when(upper & (i == 0) & (j == n), 0).when(~upper & (i == n) & (j == 0), 11)
    off_i, off_j = i >= n, j >= n
    q2 = (
        F.when(upper & off_j, _next(quad))
        .when(upper & off_i, quad + 5)
        .when(upper & (i < 0), _previous(quad))
        .when(upper & (j < 0), _previous(quad + 5))
        .when(off_i, _next(quad))
        .when(off_j, _next(quad - 5))
        .when(i < 0, quad - 5)
        .when(j < 0, _previous(quad))
        .otherwise(quad)
    )
    i2 = (
        F.when(upper & off_j, zero)
        .when(upper & off_i, zero)
        .when(upper & (i < 0), top - j + i)
        .when(upper, i)
        .when(off_i, top - j)
        .when(off_j, i)
        .when(i < 0, top + i)
        .when(j < 0, top + j)
        .otherwise(i)
    )
    j2 = (
        F.when(upper & off_j, top - i)
        .when(upper & off_i, j)
        .when(upper & (i < 0), top + i)
        .when(upper & (j < 0), top + j)
        .when(upper, j)
        .when(off_i | off_j, zero)
        .when(i < 0, j)
        .when(j < 0, top - i + j)
        .otherwise(j)
    )
    return F.coalesce(cap, q2), F.when(cap.isNull(), i2).otherwise(zero), F.when(cap.isNull(), j2).otherwise(zero)


# The six lattice directions around a hexagon.
DIRECTIONS = ((1, 0), (1, 1), (0, 1), (-1, 0), (-1, -1), (0, -1))


def neighbors(quad: Column, i: Column, j: Column, level: int) -> Column:
    """Sorted array of the sequence numbers around a cell: six, or five around a pentagon."""
    n = 1 << level
    around = []
    for di, dj in DIRECTIONS:
        number = seqnum(*fold(quad, i + di, j + dj, level), level)
        if (di, dj) == (-1, -1):
            # A pentagon has no cell in this direction.
            number = F.when((i > 0) | (j > 0), number)
        around.append(number)
    last = F.lit(n - 1).cast("long")
    zero = F.lit(0).cast("long")
    north = F.array(*[seqnum(F.lit(q), zero, last, level) for q in range(1, 6)])
    south = F.array(*[seqnum(F.lit(q), last, zero, level) for q in range(6, 11)])
    ring = F.when(quad == 0, north).when(quad == 11, south).otherwise(F.array_compact(F.array(*around)))
    return F.array_sort(F.array_distinct(ring))


def children(quad: Column, i: Column, j: Column, level: int) -> Column:
    """Sorted array of the cells one level down: the one with the same centre and those around it."""
    ci, cj = F.shiftleft(i, 1), F.shiftleft(j, 1)
    centre = seqnum(quad, ci, cj, level + 1)
    return F.array_sort(F.concat(F.array(centre), neighbors(quad, ci, cj, level + 1)))


def parent(quad: Column, i: Column, j: Column, level: int) -> Column:
    """Sequence number one level up whose children hold the cell.

    A cell on the edge between two parents is shared; halves are rounded away
    from the lattice axis through the diamond's origin.
    """
    up_j = F.shiftright(j + 1, 1)
    right = i * 2 >= j
    up_i = F.when(right, F.shiftright(i + 1, 1)).otherwise(up_j - F.shiftright(j - i + 1, 1))
    # The caps keep their own number; a rounded address may run off its diamond.
    folded = seqnum(*fold(quad, up_i, up_j, level - 1), level - 1)
    return F.when(quad == 0, F.lit(1).cast("long")).when(
        quad == 11, F.lit(cell_count(level - 1)).cast("long")
    ).otherwise(folded)


# ---------------------------------------------------------------------------
# forward projection

def with_cell(df, lon: Column, lat: Column, level: int, out: str):
    """Add the sequence number of the cell that holds each point.

    One Arrow-batched call.  Written as Columns the projection is a chain of
    fifteen dependent steps, and the optimizer's constraint and filter rules
    grow exponentially with such a chain.
    """

    @F.pandas_udf("long")
    def locate(x: pd.Series, y: pd.Series) -> pd.Series:
        from gridloom.functions import kernels

        known = (x.notna() & y.notna()).to_numpy()
        found = kernels.locate_hexagon(x.fillna(0.0).to_numpy(float), y.fillna(0.0).to_numpy(float), level)
        return pd.Series(found, dtype="Int64").where(known)

    return df.withColumn(out, locate(lon, lat))
