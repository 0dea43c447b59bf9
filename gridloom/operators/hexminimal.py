"""Minimal hexagon covers: the largest hexagons inside an area, and those of the last level on what is left.

Hexagons of two levels do not nest, so whether one may be taken depends on what is left of the area
after the coarser ones.  That is arithmetic: the area of the cell inside the area of interest, less
the areas it shares with hexagons taken before.  Only a few coarser hexagons can share area with a
cell, those that hold its centre and their neighbours, and they are found from the lattice.  So a
whole cover is one walk from the twelve base cells down, in the task that has the area's row; cells
with nothing left are not followed, which leaves the border.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import isea4h
from gridloom.functions import kernels as K
from gridloom.functions import shapes

#: A cell counts as inside, or as untouched, when all but this part of it is.
TOLERANCE = 1e-9
#: Cells of one numpy step.
STEP = 20_000
#: Points of an area that is walked together with others, and the number of those.
POINTS, TOGETHER = 24, 500
_WORLD = np.array([[-180.0, -90.0], [180.0, -90.0], [180.0, 90.0], [-180.0, 90.0]])


def triples(seq: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(quad, i, j) of sequence numbers."""
    n, last = 1 << level, isea4h.cell_count(level)
    at = np.clip(seq - 2, 0, 10 * n * n - 1)
    pole = (seq == 1) | (seq == last)
    quad = np.where(seq == 1, 0, np.where(seq == last, 11, at // (n * n) + 1))
    return quad, np.where(pole, 0, at % (n * n) // n), np.where(pole, 0, at % n)


def neighbourhood(seq: np.ndarray, level: int) -> np.ndarray:
    """For each cell a row of seven numbers: itself and the cells next to it; a pentagon's row repeats itself.

    Points a little beyond the middle of each side lie in the cell on its other side.
    """
    quad, i, j = triples(seq, level)
    size = 1 << level
    out = np.repeat(seq[:, None], 7, axis=1)
    at = np.flatnonzero((quad >= 1) & (quad <= 10))
    for k, (di, dj) in enumerate(isea4h.DIRECTIONS, start=1):
        lon, lat = K.unproject_diamond(quad[at], (i[at] + 0.9 * di) / size, (j[at] + 0.9 * dj) / size)
        out[at, k] = K.locate_hexagon(lon, lat, level)
    for cap, quads, a, b in ((0, range(1, 6), 0, size - 1), (11, range(6, 11), size - 1, 0)):
        out[quad == cap, 1:6] = [2 + (q - 1) * size * size + a * size + b for q in quads]
    return out


def _centre_below(seq: np.ndarray, level: int) -> np.ndarray:
    """The cell one level down with the same centre; those next to it also share area with the cell."""
    quad, i, j = triples(seq, level)
    n = 1 << level
    inner = 2 + (quad - 1) * 4 * n * n + 2 * i * 2 * n + 2 * j
    return np.where(quad == 0, 1, np.where(quad == 11, isea4h.cell_count(level + 1), inner))


def _shared_convex(cells: np.ndarray, areas: np.ndarray) -> np.ndarray:
    out = np.zeros(len(cells))
    lo, hi, alo, ahi = cells.min(axis=1), cells.max(axis=1), areas.min(axis=1), areas.max(axis=1)
    for shift in (-720.0, -360.0, 0.0, 360.0, 720.0):
        meets = (lo[:, 0] + shift < ahi[:, 0]) & (hi[:, 0] + shift > alo[:, 0]) & (lo[:, 1] < ahi[:, 1]) & (hi[:, 1] > alo[:, 1])
        at = np.flatnonzero(meets)
        if len(at):
            out[at] += K.areas(K.clip_convex(areas[at], cells[at] + np.array([shift, 0.0])))
    return out


def _turns(rings: np.ndarray) -> np.ndarray:
    """Twice the signed area of the triangles of a fan from each ring's first point."""
    d = rings[:, 1:] - rings[:, :1]
    return d[:, :-1, 0] * d[:, 1:, 1] - d[:, 1:, 0] * d[:, :-1, 1]


def _bent(rings: np.ndarray) -> np.ndarray:
    """Whether some point of a counter-clockwise ring lies to the right of one of its sides."""
    side = np.roll(rings, -1, axis=1) - rings
    away = rings[:, None, :, :] - rings[:, :, None, :]
    right = side[:, :, None, 0] * away[..., 1] - side[:, :, None, 1] * away[..., 0]
    return (right < -1e-12 * np.abs(right).max(axis=(1, 2), keepdims=True)).any(axis=(1, 2))


def _shared(cells: np.ndarray, areas: np.ndarray) -> np.ndarray:
    """Area that each cell shares with its own ring, in any turn of longitude.

    A large hexagon can be bent in degrees; it is the signed sum of the triangles of a fan.
    """
    out = np.zeros(len(cells))
    lo, hi, alo, ahi = cells.min(axis=1), cells.max(axis=1), areas.min(axis=1), areas.max(axis=1)
    turns = np.ceil((alo[:, 0] - hi[:, 0]) / 360.0) <= np.floor((ahi[:, 0] - lo[:, 0]) / 360.0)
    live = np.flatnonzero(turns & (lo[:, 1] < ahi[:, 1]) & (hi[:, 1] > alo[:, 1]))
    if not len(live):
        return out
    is_bent = _bent(cells[live])
    bent, plain = live[is_bent], live[~is_bent]
    if len(plain):
        out[plain] = _shared_convex(cells[plain], areas[plain])
    if len(bent):
        signs = np.sign(_turns(cells[bent]))
        for k in range(cells.shape[1] - 2):
            some = np.flatnonzero(signs[:, k] != 0)
            if len(some):
                fan = cells[bent[some]][:, [0, k + 1, k + 2]]
                out[bent[some]] += signs[some, k] * _shared_convex(K.counter_clockwise(fan), areas[bent[some]])
    return out


def _expand(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers, each as often as ``count`` says, and the number of each repeat."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


class Areas:
    """Areas of a batch, each of several rings: 1 counts up, -1 (a hole) down."""

    def __init__(self, areas: list[list[tuple[np.ndarray, int]]]):
        self.count = np.array([len(a) for a in areas], dtype=np.int64)
        self.first = np.cumsum(self.count) - self.count
        parts = [part for a in areas for part in a]
        self.rings = K.pad_rings([ring for ring, _ in parts])
        self.signs = np.array([sign for _, sign in parts], dtype=float)

    def inside(self, area: np.ndarray, rings: np.ndarray) -> np.ndarray:
        """Area of each cell that lies in its own area."""
        row, k = _expand(self.count[area])
        part = self.first[area][row] + k
        return np.bincount(row, self.signs[part] * _shared(rings[row], self.rings[part]), len(area))


def _taken_before(area: np.ndarray, seq: np.ndarray, rings: np.ndarray, level: int, taken: list[np.ndarray]) -> np.ndarray:
    """Area of each cell that its area has given to coarser cells; ``taken`` holds codes of area and cell by level."""
    out = np.zeros(len(seq))
    if not any(len(t) for t in taken):
        return out
    lon, lat = K.hexagon_centres(*triples(seq, level), level)
    for above, found in enumerate(taken):
        if not len(found):
            continue
        # A cell is near a taken one only if the cell that holds its centre, or one next to it, is taken.
        holders, at = np.unique(K.locate_hexagon(lon, lat, above), return_inverse=True)
        near = neighbourhood(holders, above)
        first = np.ones(near.shape, bool)
        for k in range(1, 7):  # a pentagon's row repeats
            first[:, k] = (near[:, :k] != near[:, k : k + 1]).all(axis=1)
        code = area[:, None] * (isea4h.cell_count(above) + 1) + near[at]
        own, which = np.nonzero(np.isin(code, found) & first[at])
        if len(own):
            big = shapes.hexagon_rings(*triples(near[at[own], which], above), above)
            out += np.bincount(own, _shared(rings[own], big), len(out))
    return out


def _pairs(area: np.ndarray, seq: np.ndarray, rows, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (area, cell) of the rows of cells that belong to each area's cells."""
    base = isea4h.cell_count(level) + 1
    own, at = np.unique(seq, return_inverse=True)
    code = np.unique(area[:, None] * base + rows(own, level)[at])
    return code // base, code % base


def minimal_cells(areas: list[list[tuple[np.ndarray, int]]], level: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, areas, sequence numbers) of the minimal covers of areas, given by their number.

    An area is a list of open rings with continuous longitudes, each with 1 or, for a hole, -1.
    """
    if not sum(map(len, areas)):
        return
    batch = Areas(areas)
    base = np.arange(1, isea4h.cell_count(0) + 1)
    world = batch.inside(np.arange(len(areas)), np.repeat(_WORLD[None], len(areas), axis=0))
    whole_world = np.flatnonzero(world >= 360.0 * 180.0 - 1e-9)
    if len(whole_world):
        yield 0, np.repeat(whole_world, len(base)), np.tile(base, len(whole_world))
    rest = np.setdiff1d(np.flatnonzero(batch.count > 0), whole_world)
    area, seq, taken = np.repeat(rest, len(base)), np.tile(base, len(rest)), []
    for lv in range(level + 1):
        chosen, left = [np.empty((2, 0), np.int64)], [np.empty((2, 0), np.int64)]
        for start in range(0, len(seq), STEP):
            a, s = area[start : start + STEP], seq[start : start + STEP]
            drawn, at = np.unique(s, return_inverse=True)  # areas share cells
            rings = shapes.hexagon_rings(*triples(drawn, lv), lv)[at]
            whole, inside = K.areas(rings), batch.inside(a, rings)
            keep = inside > TOLERANCE * whole
            a, s, rings, whole, inside = a[keep], s[keep], rings[keep], whole[keep], inside[keep]
            open_part = inside - _taken_before(a, s, rings, lv, taken)
            full = open_part >= whole * (1 - TOLERANCE)
            some = open_part > TOLERANCE * whole
            chosen.append(np.stack([a, s])[:, full if lv < level else some])
            left.append(np.stack([a, s])[:, some & ~full])
        (area, seq), (left_area, left_seq) = np.concatenate(chosen, axis=1), np.concatenate(left, axis=1)
        if len(seq):
            yield lv, area, seq
        if lv == level or not len(left_seq):
            return
        taken.append(area * (isea4h.cell_count(lv) + 1) + seq)
        # Drawn sides are straight between corners, so a cell can reach a hair beyond its parents.
        area, seq = _pairs(left_area, left_seq, neighbourhood, lv)
        area, seq = _pairs(area, _centre_below(seq, lv), neighbourhood, lv + 1)


def minimal_cover(parts: DataFrame, level: int, key: list[str]) -> DataFrame:
    """The columns of ``parts`` but its rings, grid_level and space_code of the minimal hexagon cover of each area.

    ``parts`` has the rings of the areas, ``__rx`` and ``__ry`` (open, longitudes continuous), and
    ``__hole``; rings with equal ``key`` are one area.  The rings of an area meet in its task.
    """
    ring = F.struct(F.col("__rx").alias("x"), F.col("__ry").alias("y"), F.col("__hole").alias("hole"))
    rest = [c for c in parts.columns if c not in key and not c.startswith("__")]
    areas = parts.groupBy(*key).agg(F.collect_list(ring).alias("__rings"), *[F.first(c).alias(c) for c in rest])
    # Few small rows become many cells: dealt to all tasks, by number, or they would be put together again.
    areas = areas.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)

    @F.pandas_udf("array<struct<grid_level: int, space_code: string>>")
    def walk(areas: pd.Series) -> pd.Series:
        drawn = [[(np.stack([np.asarray(r["x"], float), np.asarray(r["y"], float)], axis=1), -1 if r["hole"] else 1) for r in rings if len(r["x"])] for rings in areas]
        out = [[] for _ in drawn]
        # Areas of few points go together; a ring of many would widen the arrays of all.
        small = [k for k, a in enumerate(drawn) if sum(len(r) for r, _ in a) <= POINTS]
        groups = [small[k : k + TOGETHER] for k in range(0, len(small), TOGETHER)] + [[k] for k in sorted(set(range(len(drawn))) - set(small))]
        for group in groups:
            for lv, own, seq in minimal_cells([drawn[k] for k in group], level):
                for k, n in zip(own.tolist(), seq.tolist()):
                    out[group[k]].append({"grid_level": lv, "space_code": str(n)})
        return pd.Series(out, dtype=object)

    return areas.withColumn("__cells", walk("__rings")).select(*key, *rest, F.explode("__cells").alias("__c")).select(*key, *rest, "__c.*")
