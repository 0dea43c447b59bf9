"""Arrow-batched cell shapes and exact overlap areas.

Cheap cases (a cell wholly inside or wholly outside a box) are decided for a
whole batch at once; only cells on the border are clipped one by one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import kernels as K
from gridloom.functions import mgrs as metric

SHAPE = "center_lon double, center_lat double, ring_lon array<double>, ring_lat array<double>"
AREAS = "inside double, whole double"

# Segments per edge of a projected square when it is drawn in degrees.
EDGE_SEGMENTS = 8


# ---------------------------------------------------------------------------
# rings of a batch of cells, shape (cells, points, 2)

def _centred(rings):
    """Rings shifted by whole turns so that their mean longitude lies in -180..180."""
    out = rings.copy()
    out[:, :, 0] -= 360.0 * np.round(rings[:, :, 0].mean(axis=1) / 360.0)[:, None]
    return out


def hexagon_rings(q, i, j, level: int, bends: bool = False):
    """Counter-clockwise, longitude-continuous rings; the ring of a cell around a pole reaches the pole.

    Of corners alone, or with the points between in which the true sides bend.
    """
    lon, lat = K.hexagon_outline(q, i, j, level) if bends else K.hexagon_corners(q, i, j, level)
    corners = lon.shape[1]
    # The corner a pentagon lacks is filled with the one before it.
    gone = np.isnan(lon)
    lon = np.where(gone, np.roll(lon, 1, axis=1), lon)
    lat = np.where(gone, np.roll(lat, 1, axis=1), lat)
    lon = K.continuous_lon(lon)
    gap = lon[:, 0] - lon[:, -1]
    turn = lon[:, -1] + gap - 360.0 * np.round(gap / 360.0) - lon[:, 0]
    rings = np.stack([lon, lat], axis=2)
    polar = np.flatnonzero(np.abs(turn) > 180.0)
    if len(polar):
        rings = np.concatenate([rings, np.repeat(rings[:, :1], 3, axis=1)], axis=1)
        last = rings[polar, 0, 0] + turn[polar]
        pole = np.where(lat[polar].mean(axis=1) > 0, 90.0, -90.0)
        rings[polar, corners] = np.stack([last, rings[polar, 0, 1]], axis=1)
        rings[polar, corners + 1] = np.stack([last, pole], axis=1)
        rings[polar, corners + 2] = np.stack([rings[polar, 0, 0], pole], axis=1)
    return K.counter_clockwise(_centred(rings))


def square_rings(easting, northing, zone, northern, polar, size: float):
    """Counter-clockwise rings of projected squares in degrees."""
    t = np.arange(EDGE_SEGMENTS) / EDGE_SEGMENTS
    one, zero = np.ones_like(t), np.zeros_like(t)
    dx = np.concatenate([t, one, 1 - t, zero]) * size
    dy = np.concatenate([zero, t, one, 1 - t]) * size
    count, m = len(easting), len(dx)
    lon, lat = K.unproject_metric(
        (easting[:, None] + dx).ravel(),
        (northing[:, None] + dy).ravel(),
        np.repeat(zone, m),
        np.repeat(northern, m),
        np.repeat(polar, m),
    )
    lon, lat = lon.reshape(count, m), lat.reshape(count, m)
    rings = np.stack([K.continuous_lon(lon), lat], axis=2)
    touching = np.flatnonzero(polar & (np.abs(lat).max(axis=1) > 90.0 - 1e-9))
    if len(touching):
        # A corner on the pole becomes an edge along it.
        rings = np.concatenate([rings, rings[:, :1]], axis=1)
        for k in touching:
            at = int(np.argmax(np.abs(lat[k])))
            x = K.continuous_lon(np.roll(np.delete(lon[k], at), -at))
            y = np.roll(np.delete(lat[k], at), -at)
            pole = np.sign(lat[k, at]) * 90.0
            rings[k] = np.stack([np.concatenate([x, [x[-1], x[0]]]), np.concatenate([y, [pole, pole]])], axis=1)
    return K.counter_clockwise(_centred(rings))


def metric_rings(e, n, z, hemi, p, w, s, ea, no, size: float):
    """Rings of MGRS squares cut to the valid box of their zone and band."""
    pol = p.to_numpy().astype(bool)
    rings = square_rings(e.to_numpy(), n.to_numpy(), z.fillna(1).to_numpy(), hemi.to_numpy().astype(bool), pol, size)
    # A square of zone 1 or 60 that lies mostly beyond the dateline stays beside its own zone.
    middle = (w.to_numpy(float) + ea.to_numpy(float)) / 2.0
    turns = np.where(pol, 0.0, np.round((middle - rings[:, :, 0].mean(axis=1)) / 360.0))
    rings[:, :, 0] += 360.0 * turns[:, None]
    # Polar areas span all longitudes; their rings may run past the dateline.
    west, east = np.where(pol, -540.0, w.to_numpy(float)), np.where(pol, 540.0, ea.to_numpy(float))
    return K.clip_box(rings, west, s.to_numpy(float), east, no.to_numpy(float))


def _without_padding(ring):
    """A ring without repeated neighbours."""
    keep = np.any(ring != np.roll(ring, 1, axis=0), axis=1)
    return ring[keep] if keep.any() else ring[:1]


def _shape_frame(rings, clon, clat):
    tight = [_without_padding(r) for r in rings]
    return pd.DataFrame(
        {
            "center_lon": clon,
            "center_lat": clat,
            "ring_lon": [r[:, 0].tolist() for r in tight],
            "ring_lat": [r[:, 1].tolist() for r in tight],
        }
    )


def hexagon_shape(quad: Column, i: Column, j: Column, level: int) -> Column:
    """Centre and open ring of hexagon cells."""

    @F.pandas_udf(SHAPE)
    def shape(q: pd.Series, i: pd.Series, j: pd.Series) -> pd.DataFrame:
        q, i, j = q.to_numpy(), i.to_numpy(), j.to_numpy()
        clon, clat = K.hexagon_centres(q, i, j, level)
        return _shape_frame(hexagon_rings(q, i, j, level), clon, clat)

    return shape(quad, i, j)


def metric_shape(easting, northing, zone, northern, polar, west, south, east, north, precision: int) -> Column:
    """Centre and open ring of MGRS squares cut to the valid box of their zone and band."""
    size = float(10 ** (5 - precision))

    @F.pandas_udf(SHAPE)
    def shape(
        e: pd.Series, n: pd.Series, z: pd.Series, hemi: pd.Series, p: pd.Series,
        w: pd.Series, s: pd.Series, ea: pd.Series, no: pd.Series,
    ) -> pd.DataFrame:
        rings = metric_rings(e, n, z, hemi, p, w, s, ea, no, size)
        clon, clat = K.centroids(rings)
        return _shape_frame(rings, clon - 360.0 * np.round(clon / 360.0), clat)

    return shape(easting, northing, zone, northern, polar, west, south, east, north)


# ---------------------------------------------------------------------------
# overlap of cells with boxes and polygons

def _overlap_boxes(rings, w, s, e, n):
    """Areas inside boxes and whole areas; only rings across a box edge are clipped."""
    whole = K.areas(rings)
    inside = np.zeros(len(rings))
    lo, hi = rings.min(axis=1), rings.max(axis=1)
    for shift in (-360.0, 0.0, 360.0):
        west, east = lo[:, 0] + shift, hi[:, 0] + shift
        meets = (west < e) & (east > w) & (lo[:, 1] < n) & (hi[:, 1] > s)
        within = meets & (west >= w) & (east <= e) & (lo[:, 1] >= s) & (hi[:, 1] <= n)
        inside[within] += whole[within]
        cut = np.flatnonzero(meets & ~within)
        if len(cut):
            moved = rings[cut] + np.array([shift, 0.0])
            inside[cut] += K.areas(K.clip_box(moved, w[cut], s[cut], e[cut], n[cut]))
    return pd.DataFrame({"inside": inside, "whole": whole})


def hexagon_box_overlap(quad, i, j, level: int, west, south, east, north, bends: bool = False) -> Column:
    """Area of each hexagon inside a box, and its whole area, in square degrees."""

    @F.pandas_udf(AREAS)
    def overlap(
        q: pd.Series, i: pd.Series, j: pd.Series, w: pd.Series, s: pd.Series, e: pd.Series, n: pd.Series
    ) -> pd.DataFrame:
        rings = hexagon_rings(q.to_numpy(), i.to_numpy(), j.to_numpy(), level, bends)
        return _overlap_boxes(rings, w.to_numpy(float), s.to_numpy(float), e.to_numpy(float), n.to_numpy(float))

    return overlap(quad, i, j, west, south, east, north)


def metric_box_overlap(easting, northing, zone, northern, polar, cell_box, aoi_box, precision: int) -> Column:
    """Area of each MGRS cell inside an area box, and its whole area, in square degrees.

    Squares whose corners lie clear inside or outside, by more than their edges
    can bulge, count as 1 of 1 or 0 of 1 without being drawn.
    """
    size = float(10 ** (5 - precision))

    @F.pandas_udf(AREAS)
    def overlap(
        e: pd.Series, n: pd.Series, z: pd.Series, hemi: pd.Series, p: pd.Series,
        cw: pd.Series, cs: pd.Series, ce: pd.Series, cn: pd.Series,
        aw: pd.Series, as_: pd.Series, ae: pd.Series, an: pd.Series,
    ) -> pd.DataFrame:
        pol = p.to_numpy().astype(bool)
        corner = size * np.array([[0, 0], [1, 0], [1, 1], [0, 1]])
        lon, lat = K.unproject_metric(
            (e.to_numpy()[:, None] + corner[:, 0]).ravel(), (n.to_numpy()[:, None] + corner[:, 1]).ravel(),
            np.repeat(z.fillna(1).to_numpy(), 4), np.repeat(hemi.to_numpy().astype(bool), 4), np.repeat(pol, 4),
        )
        lon, lat = lon.reshape(-1, 4), lat.reshape(-1, 4)
        bulge = 0.02 * size / 111_000.0
        wide = bulge / np.maximum(np.cos(np.radians(np.abs(lat).max(axis=1))), 0.05)
        w, east = lon.min(axis=1) - wide, lon.max(axis=1) + wide
        s, north = lat.min(axis=1) - bulge, lat.max(axis=1) + bulge
        west_to, east_to = np.maximum(cw, aw).to_numpy(float), np.minimum(ce, ae).to_numpy(float)
        south_to, north_to = np.maximum(cs, as_).to_numpy(float), np.minimum(cn, an).to_numpy(float)
        clear_in = ~pol & (w >= west_to) & (east <= east_to) & (s >= south_to) & (north <= north_to)
        clear_out = ~pol & ((w >= east_to) | (east <= west_to) | (s >= north_to) | (north <= south_to))
        # A square outside its own zone or band has no area at all.
        empty = ~pol & ((w >= ce.to_numpy(float)) | (east <= cw.to_numpy(float)) | (s >= cn.to_numpy(float)) | (north <= cs.to_numpy(float)))
        out = pd.DataFrame({"inside": clear_in.astype(float), "whole": np.where(empty, 0.0, 1.0)})
        at = np.flatnonzero(~clear_in & ~clear_out)
        if len(at):
            pick = lambda v: v.iloc[at]
            rings = metric_rings(*[pick(v) for v in (e, n, z, hemi, p, cw, cs, ce, cn)], size)
            drawn = _overlap_boxes(rings, *[pick(v).to_numpy(float) for v in (aw, as_, ae, an)])
            out.iloc[at] = drawn.to_numpy()
        return out

    return overlap(easting, northing, zone, northern, polar, *cell_box, *aoi_box)


def ring_polygon_overlap(cell_lon, cell_lat, ring_lon, ring_lat) -> Column:
    """Area of each convex cell ring inside a polygon ring (any simple polygon), and its whole area."""

    @F.pandas_udf(AREAS)
    def overlap(cx: pd.Series, cy: pd.Series, rx: pd.Series, ry: pd.Series) -> pd.DataFrame:
        if not len(cx):
            return pd.DataFrame({"inside": [], "whole": []})
        cells = K.counter_clockwise(K.pad_rings([np.stack(v, axis=1) for v in zip(cx, cy)]))
        areas = K.pad_rings([np.stack([K.continuous_lon(np.asarray(x, float)), y], axis=1) for x, y in zip(rx, ry)])
        whole, inside = K.areas(cells), np.zeros(len(cells))
        lo, hi = cells.min(axis=1), cells.max(axis=1)
        alo, ahi = areas.min(axis=1), areas.max(axis=1)
        for shift in (-360.0, 0.0, 360.0):
            meets = (
                (lo[:, 0] + shift < ahi[:, 0]) & (hi[:, 0] + shift > alo[:, 0])
                & (lo[:, 1] < ahi[:, 1]) & (hi[:, 1] > alo[:, 1])
            )
            at = np.flatnonzero(meets)
            if len(at):
                inside[at] += K.areas(K.clip_convex(areas[at], cells[at] + np.array([shift, 0.0])))
        return pd.DataFrame({"inside": inside, "whole": whole})

    return overlap(cell_lon, cell_lat, ring_lon, ring_lat)


def wgs84_parts(ring: Column) -> Column:
    """Parts of a continuous ring cut to longitudes -180..180, as open coordinate arrays."""

    @F.pandas_udf("array<struct<ring_lon: array<double>, ring_lat: array<double>>>")
    def cut(rings: pd.Series) -> pd.Series:
        if not len(rings):
            return pd.Series([], dtype=object)
        batch = K.pad_rings([np.array([[p["lon"], p["lat"]] for p in r], dtype=float)[:-1] for r in rings])
        out = [[] for _ in range(len(batch))]
        full = [np.full(len(batch), v) for v in (-180.0, -90.0, 180.0, 90.0)]
        for shift in (-360.0, 0.0, 360.0):
            pieces = K.clip_box(batch + np.array([shift, 0.0]), *full)
            for k in np.flatnonzero(K.areas(pieces) > 0):
                piece = _without_padding(pieces[k])
                out[k].append({"ring_lon": piece[:, 0].tolist(), "ring_lat": piece[:, 1].tolist()})
        return pd.Series(out)

    return cut(ring)


def continuous(lons: Column) -> Column:
    """Ring longitudes without steps larger than half a turn; a step of a whole turn is a side along a parallel and stays."""

    @F.pandas_udf("array<double>")
    def unwrap(values: pd.Series) -> pd.Series:
        rings = (np.asarray(v, float) for v in values)
        return pd.Series([(r if (np.abs(np.diff(r)) >= 360.0).any() else K.continuous_lon(r)).tolist() for r in rings])

    return unwrap(lons)


def _common_edge_lengths(a, b):
    """Length of the edges of outlines ``a`` that lie on edges of outlines ``b``, pair by pair."""
    a2, b2 = np.roll(a, -1, axis=1), np.roll(b, -1, axis=1)
    length = np.hypot(a2[..., 0] - a[..., 0], a2[..., 1] - a[..., 1])
    real = length > 1e-15
    along = (a2 - a) / np.where(real, length, 1.0)[..., None]

    def measured(points):
        d = points[:, None, :, :] - a[:, :, None, :]
        t = d[..., 0] * along[:, :, None, 0] + d[..., 1] * along[:, :, None, 1]
        off = np.abs(d[..., 1] * along[:, :, None, 0] - d[..., 0] * along[:, :, None, 1])
        return t, off

    (t1, off1), (t2, off2) = measured(b), measured(b2)
    span = length[:, :, None]
    near = (off1 < 1e-3 * span) & (off2 < 1e-3 * span) & real[:, :, None]
    shared = np.minimum(np.maximum(t1, t2), span) - np.maximum(np.minimum(t1, t2), 0.0)
    return np.where(near & (shared > 1e-9 * span), shared, 0.0).sum(axis=(1, 2))


def shared_border(cell_lon: Column, cell_lat: Column, ring: Column) -> Column:
    """Length in degrees over which two convex outlines touch along an edge."""

    @F.pandas_udf("double")
    def border(x: pd.Series, y: pd.Series, ring: pd.Series) -> pd.Series:
        out = np.zeros(len(x))
        for start in range(0, len(x), 500):
            stop = min(start + 500, len(x))
            a = K.pad_rings([np.stack(v, axis=1) for v in zip(x.iloc[start:stop], y.iloc[start:stop])])
            b = K.pad_rings([np.array([[p["lon"], p["lat"]] for p in r], dtype=float)[:-1] for r in ring.iloc[start:stop]])
            turns = np.round((b[:, :, 0].mean(axis=1) - a[:, :, 0].mean(axis=1)) / 360.0)
            a[:, :, 0] += 360.0 * turns[:, None]
            out[start:stop] = _common_edge_lengths(a, b)
        return pd.Series(out)

    return border(cell_lon, cell_lat, ring)


def beyond_ring(lon: Column, lat: Column, center_lon: Column, center_lat: Column, ring: Column) -> Column:
    """How far a point lies beyond the sides of a convex ring, in radii of the ring; zero or less inside.

    Measured in the plane that touches the sphere at the ring's centre, where sides are great circles:
    poles and the dateline are places like others.  Sides along a pole are drawn, not real, and count not.
    """

    def plane(x, y, cx, cy):
        d, phi, c = np.radians(x - cx), np.radians(y), np.radians(cy)
        depth = np.sin(c) * np.sin(phi) + np.cos(c) * np.cos(phi) * np.cos(d)
        depth = np.maximum(depth, 1e-9)  # the far half of the globe is far away
        return np.stack([np.cos(phi) * np.sin(d) / depth, (np.cos(c) * np.sin(phi) - np.sin(c) * np.cos(phi) * np.cos(d)) / depth], axis=-1)

    @F.pandas_udf("double")
    def beyond(x: pd.Series, y: pd.Series, cx: pd.Series, cy: pd.Series, rings: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        drawn = K.pad_rings([np.array([[p["lon"], p["lat"]] for p in r], dtype=float)[:-1] for r in rings])
        centre = cx.to_numpy(float), cy.to_numpy(float)
        corners = plane(drawn[..., 0], drawn[..., 1], centre[0][:, None], centre[1][:, None])
        point = plane(x.to_numpy(float), y.to_numpy(float), *centre)
        after = np.roll(corners, -1, axis=1)
        pole = np.abs(drawn[..., 1]) > 90.0 - 1e-9
        side = after - corners
        length = np.hypot(side[..., 0], side[..., 1])
        real = (length > 1e-12) & ~pole & ~np.roll(pole, -1, axis=1)
        away = point[:, None, :] - corners
        turn = np.sign((corners[..., 0] * after[..., 1] - after[..., 0] * corners[..., 1]).sum(axis=1))
        right = -turn[:, None] * (side[..., 0] * away[..., 1] - side[..., 1] * away[..., 0]) / np.where(real, length, 1.0)
        radius = np.hypot(corners[..., 0], corners[..., 1]).max(axis=1)
        return pd.Series(np.where(real, right, -np.inf).max(axis=1) / radius)

    return beyond(lon, lat, center_lon, center_lat, ring)


def beyond_hexagon(lon: Column, lat: Column, quad: Column, i: Column, j: Column, level: int) -> Column:
    """How far a point lies beyond the true sides of a hexagon, in radii of the hexagon; zero or less inside.

    Measured in the plane that touches the sphere at the hexagon's centre.
    """

    @F.pandas_udf("double")
    def beyond(x: pd.Series, y: pd.Series, q: pd.Series, i: pd.Series, j: pd.Series) -> pd.Series:
        out = np.empty(len(x))
        for at in range(0, len(x), 2000):
            one = [v.to_numpy()[at : at + 2000] for v in (q, i, j)]
            clon, clat = K.hexagon_centres(*one, level)

            def plane(lon, lat, clon=clon[:, None], clat=clat[:, None]):
                d, phi, c = np.radians(lon - clon), np.radians(lat), np.radians(clat)
                depth = np.maximum(np.sin(c) * np.sin(phi) + np.cos(c) * np.cos(phi) * np.cos(d), 1e-9)
                return np.cos(phi) * np.sin(d) / depth, (np.cos(c) * np.sin(phi) - np.sin(c) * np.cos(phi) * np.cos(d)) / depth

            cx, cy = plane(*K.hexagon_outline(*one, level))
            px, py = plane(x.to_numpy(float)[at : at + 2000, None], y.to_numpy(float)[at : at + 2000, None])
            dx, dy = np.roll(cx, -1, axis=1) - cx, np.roll(cy, -1, axis=1) - cy
            square = dx * dx + dy * dy
            t = np.clip(((px - cx) * dx + (py - cy) * dy) / np.where(square > 0, square, 1.0), 0.0, 1.0)
            away = np.hypot(px - cx - t * dx, py - cy - t * dy).min(axis=1)
            spans = (cy > py) != (cy + dy > py)
            with np.errstate(divide="ignore", invalid="ignore"):
                right = cx + (py - cy) / dy * dx > px
            inside = (spans & right).sum(axis=1) % 2 == 1
            out[at : at + 2000] = np.where(inside, -away, away) / np.hypot(cx, cy).max(axis=1)
        return pd.Series(out)

    return beyond(lon, lat, quad, i, j)


def project_points(spots: Column, zone: Column, polar: Column, northern: Column) -> Column:
    """Projected coordinates of an array of ``x, y`` points in one zone or polar area, as arrays ``e`` and ``n``."""

    @F.pandas_udf("e array<double>, n array<double>")
    def project(points: pd.Series, zone: pd.Series, polar: pd.Series, northern: pd.Series) -> pd.DataFrame:
        count = len(points)
        m = len(points.iloc[0]) if count else 0
        xy = np.array([[(p["x"], p["y"]) for p in row] for row in points], dtype=float).reshape(count, m, 2)
        e, n = K.project_metric(
            xy[:, :, 0], xy[:, :, 1],
            zone.to_numpy(float)[:, None], northern.to_numpy(bool)[:, None], polar.to_numpy(bool)[:, None],
        )
        return pd.DataFrame({"e": e.tolist(), "n": n.tolist()})

    return project(spots, zone, polar, northern)


# ---------------------------------------------------------------------------
# ring arrays as Columns

RING = T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))


def ring_of(lons: Column, lats: Column) -> Column:
    """Closed ``ARRAY<STRUCT<lon, lat>>`` from open coordinate arrays."""
    points = F.transform(F.arrays_zip(lons.alias("lon"), lats.alias("lat")), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    return F.concat(points, F.slice(points, 1, 1))


def box_ring(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Closed five-point ring of a box, counter-clockwise from the south-west corner."""

    def point(x, y):
        return F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))

    return F.array(point(west, south), point(east, south), point(east, north), point(west, north), point(west, south))


def shoelace(ring: Column) -> Column:
    """Area of a closed ring in square degrees."""
    steps = F.sequence(F.lit(1), F.size(ring) - 1)
    twice = F.aggregate(
        steps,
        F.lit(0.0),
        lambda acc, k: acc
        + (
            F.element_at(ring, k)["lon"] * F.element_at(ring, k + 1)["lat"]
            - F.element_at(ring, k + 1)["lon"] * F.element_at(ring, k)["lat"]
        ),
    )
    return F.abs(twice) / 2.0


def ring_is_closed(ring: Column) -> Column:
    return F.element_at(ring, 1) == F.element_at(ring, -1)


def ring_geojson(ring: Column) -> Column:
    """GeoJSON text of one exterior ring."""
    points = F.transform(
        ring, lambda p: F.concat(F.lit("["), p["lon"].cast("string"), F.lit(","), p["lat"].cast("string"), F.lit("]"))
    )
    return F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.concat_ws(",", points), F.lit("]]}"))


def zone_box(zone: Column, band: Column, polar: Column, northern: Column) -> dict[str, Column]:
    """Longitude and latitude box in which references of a zone and latitude band are valid."""
    v, x = band == metric.BANDS.index("V"), band == metric.BANDS.index("X")
    west = zone * 6.0 - 186.0
    east = zone * 6.0 - 180.0
    for w, e, south, _, owner in metric.WIDE_ZONES:
        here = (v if south == 56.0 else x) & (zone == owner)
        west = F.when(here, F.lit(w)).otherwise(west)
        east = F.when(here, F.lit(e)).otherwise(east)
    east = F.when(v & (zone == 31), F.lit(3.0)).otherwise(east)
    # Zones 32, 34 and 36 do not exist in band X: an empty box.
    gone = x & zone.isin(32, 34, 36)
    south = band * 8.0 - 80.0
    north = F.when(x, F.lit(84.0)).otherwise(band * 8.0 - 72.0)
    return {
        "west": F.when(polar, F.lit(-180.0)).otherwise(west),
        "south": F.when(polar, F.when(northern, F.lit(84.0)).otherwise(F.lit(-90.0))).otherwise(south),
        "east": F.when(polar, F.lit(180.0)).otherwise(F.when(gone, west).otherwise(east)),
        "north": F.when(polar, F.when(northern, F.lit(90.0)).otherwise(F.lit(-80.0))).otherwise(north),
    }
