"""Numpy kernels used inside Arrow batches where Column arithmetic cannot express the work.

Three small pieces: the inverse icosahedral projection (an iteration), the
inverse transverse Mercator and polar projections over many ring points, and
polygon clipping (a variable number of vertices).
"""

from __future__ import annotations

import math

import numpy as np

from gridloom.functions import isea4h as hexgrid
from gridloom.functions import mgrs as metric

_TURN = np.array([f["turn"] for f in hexgrid.FRAMES])
_CLAT = np.array([f["lat"] for f in hexgrid.FRAMES])
_CLON = np.array([f["lon"] for f in hexgrid.FRAMES])


_CENTRES = np.array([[f["x"], f["y"], f["z"]] for f in hexgrid.FRAMES])

# Differences of cosines, and of places in units of a cell of level 0, that rounding can turn round; the thirds of a face meet to 4e-11.
EDGE_TOLERANCE = 1e-9


class _Libm:
    """Sines and arcs of the C library; vector units round them in the last place as the machine does."""

    sin, cos, arccos, arctan2 = (
        lambda *v, f=np.frompyfunc(f, n, 1): np.asarray(f(*v), float) for f, n in ((math.sin, 1), (math.cos, 1), (math.acos, 1), (math.atan2, 2))
    )


def locate_hexagon(lon, lat, level: int):
    """Sequence numbers of the cells that hold points in degrees; points on edges are located alike on all machines."""
    found, edge = _locate(lon, lat, level, np)
    at = np.flatnonzero(edge)
    if len(at):
        found[at] = _locate(np.asarray(lon, float)[at], np.asarray(lat, float)[at], level, _Libm)[0]
    return found


def _locate(lon, lat, level: int, m):
    """Sequence numbers by the sines and arcs of ``m``, and which points are as near to another face or cell, but for rounding."""
    lam, phi = np.radians(lon), np.radians(lat)
    px, py, pz = m.cos(phi) * m.cos(lam), m.cos(phi) * m.sin(lam), m.sin(phi)
    # Summed in one order: a matrix product may round by the size of its batch, and points midway between faces would change cells.
    faces = np.stack([px * x + py * y + pz * z for x, y, z in _CENTRES], axis=1)
    face = np.argmax(faces, axis=1)
    edge = (faces > faces.max(axis=1)[:, None] - EDGE_TOLERANCE).sum(axis=1) > 1
    clat, dlon = _CLAT[face], lam - _CLON[face]
    away = m.sin(clat) * m.sin(phi) + m.cos(clat) * m.cos(phi) * m.cos(dlon)
    z = m.arccos(np.clip(away, -1.0, 1.0))
    bearing = m.arctan2(
        m.cos(phi) * m.sin(dlon), m.cos(clat) * m.sin(phi) - m.sin(clat) * m.cos(phi) * m.cos(dlon)
    )
    az = bearing - _TURN[face]
    az = np.where(az < 0.0, az + 2.0 * np.pi, az)
    third = 2.0 * np.pi / 3.0
    sector = np.where(az < third, 0.0, np.where(az <= 2.0 * third, third, 2.0 * third))
    az = az - sector
    tan_face, cot30 = hexgrid.TAN_FACE, hexgrid.COT30
    reach = m.arctan2(tan_face, m.cos(az) + cot30 * m.sin(az))
    corner = m.arccos(
        m.sin(az) * m.sin(hexgrid.THETA_G) * hexgrid.COS_FACE - m.cos(az) * m.cos(hexgrid.THETA_G)
    )
    excess = az + hexgrid.THETA_G + corner - np.pi
    plane = m.arctan2(2.0 * excess, (hexgrid.R_PRIME * tan_face) ** 2 - 2.0 * excess * cot30)
    stretch = tan_face / ((m.cos(plane) + cot30 * m.sin(plane)) * 2.0 * m.sin(reach / 2.0))
    rho = 2.0 * hexgrid.R_PRIME * stretch * m.sin(z / 2.0)
    x = (rho * m.sin(plane + sector) + hexgrid.ORIGIN_X) / hexgrid.EDGE
    y = (rho * m.cos(plane + sector) + hexgrid.ORIGIN_Y) / hexgrid.EDGE
    # Faces 0-4 and 10-14 are the upper halves of the diamonds, turned by 60 degrees;
    # the others the lower halves, which the far corner maps onto the upper by point reflection.
    upper = face % 10 < 5
    quad = face % 5 + np.where(face < 10, 1, 6)
    hx, hy = x * 0.5 - y * hexgrid.SIN60, x * hexgrid.SIN60 + y * 0.5
    hx, hy = np.where(upper, hx, 0.5 - hx), np.where(upper, hy, hexgrid.SIN60 - hy)
    n = 1 << level
    v = hy * n / hexgrid.SIN60
    u = hx * n + v / 2.0
    # Nearest of the four lattice points around; of equally near ones the first, so that edges have one owner.
    fu, fv = np.floor(u), np.floor(v)
    off = [(u - (fu + di), v - (fv + dj)) for di, dj in ((0, 0), (1, 0), (0, 1), (1, 1))]
    away = np.stack([x * x - x * y + y * y for x, y in off])
    best, close = np.argmin(away, axis=0), EDGE_TOLERANCE * n
    edge |= ((away < away.min(axis=0) + close).sum(axis=0) > 1) | (np.abs(u - np.rint(u)) < close) | (np.abs(v - np.rint(v)) < close)
    i, j = (fu + best % 2).astype(np.int64), (fv + best // 2).astype(np.int64)
    return _number_on_edges(quad.astype(np.int64), np.clip(i, 0, n), np.clip(j, 0, n), level), edge


def _number_on_edges(quad, i, j, level: int):
    """Sequence numbers of addresses with 0 <= i, j <= n; the far edges belong to the neighbouring diamonds."""
    n = 1 << level
    upper = quad <= 5
    top, right = j == n, i == n
    after = np.where(upper, quad % 5 + 1, (quad - 5) % 5 + 6)
    across = np.where(upper, quad + 5, (quad - 5) % 5 + 1)
    q = np.where(np.where(upper, top, right), after, np.where(top | right, across, quad))
    a = np.where(upper, np.where(top | right, 0, i), np.where(right, n - j, i))
    b = np.where(upper, np.where(top, n - i, j), np.where(right | top, 0, j))
    number = 2 + (q - 1) * n * n + a * n + b
    number = np.where(upper & top & (i == 0), 1, number)
    return np.where(~upper & right & (j == 0), hexgrid.cell_count(level), number)


def unproject_face(face, x, y):
    """Longitude and latitude in degrees of plane points on icosahedron faces."""
    px = x * hexgrid.EDGE - hexgrid.ORIGIN_X
    py = y * hexgrid.EDGE - hexgrid.ORIGIN_Y
    rho = np.hypot(px, py)
    third = 2.0 * np.pi / 3.0
    plane = np.mod(np.arctan2(px, py), 2.0 * np.pi)
    sector = np.minimum(np.floor(plane / third), 2.0) * third
    plane = plane - sector
    safe = np.maximum(plane, 1e-15)
    goal = (hexgrid.R_PRIME * hexgrid.TAN_FACE) ** 2 / (2.0 * (1.0 / np.tan(safe) + hexgrid.COT30))
    sg, cg = np.sin(hexgrid.THETA_G), np.cos(hexgrid.THETA_G)
    az = safe.copy()
    # Newton's method on the spherical excess; quadratic, so a fixed count reaches full precision.
    for _ in range(12):
        s, c = np.sin(az), np.cos(az)
        h = np.arccos(np.clip(s * sg * hexgrid.COS_FACE - c * cg, -1.0, 1.0))
        miss = goal - az - hexgrid.THETA_G - h + np.pi
        slope = (c * sg * hexgrid.COS_FACE + s * cg) / np.sin(h) - 1.0
        az = az - miss / slope
    reach = np.arctan2(hexgrid.TAN_FACE, np.cos(az) + hexgrid.COT30 * np.sin(az))
    stretch = hexgrid.TAN_FACE / (2.0 * (np.cos(safe) + hexgrid.COT30 * np.sin(safe)) * np.sin(reach / 2.0))
    z = 2.0 * np.arcsin(np.clip(rho / (2.0 * hexgrid.R_PRIME * stretch), -1.0, 1.0))
    full = az + sector + _TURN[face]
    clat, clon = _CLAT[face], _CLON[face]
    slat = np.clip(np.sin(clat) * np.cos(z) + np.cos(clat) * np.sin(z) * np.cos(full), -1.0, 1.0)
    lat = np.arcsin(slat)
    lon = clon + np.arctan2(np.sin(full) * np.sin(z) * np.cos(clat), np.cos(z) - np.sin(clat) * slat)
    return (np.degrees(lon) + 180.0) % 360.0 - 180.0, np.degrees(lat)


def fold_plane(quad, u, v):
    """Diamond coordinates (unit 1) that run below zero, moved to the diamond they fall in."""
    quad, u, v = quad.copy(), u.copy(), v.copy()
    for _ in range(2):
        upper = quad <= 5
        down = (v < 0) & (upper | (u >= 0))
        left = (u < 0) & ~down
        prev = np.where(upper, (quad + 3) % 5 + 1, (quad - 2) % 5 + 6)
        below = np.where(upper, (quad + 5 - 2) % 5 + 6, prev)
        beside = np.where(upper, prev, quad - 5)
        nu = np.where(down, np.where(upper, u, 1.0 + v), np.where(left, np.where(upper, 1.0 - v + u, 1.0 + u), u))
        nv = np.where(down, np.where(upper, 1.0 + v, 1.0 - u + v), np.where(left, np.where(upper, 1.0 + u, v), v))
        quad = np.where(down, below, np.where(left, beside, quad))
        u, v = nu, nv
    return quad, u, v


def unproject_diamond(quad, u, v):
    """Longitude and latitude in degrees of points given in diamond coordinates."""
    quad, u, v = fold_plane(np.asarray(quad), np.asarray(u, float), np.asarray(v, float))
    x, y = u - v / 2.0, v * hexgrid.SIN60
    upper = v >= u
    k = (quad - 1) % 5
    face = np.where(upper, np.where(quad <= 5, k, k + 10), np.where(quad <= 5, k + 5, k + 15))
    dx, dy = np.where(upper, x, 0.5 - x), np.where(upper, y, hexgrid.SIN60 - y)
    # Turned back by 60 degrees; the lower half by 240, which is 60 after the point reflection.
    return unproject_face(face, dx * 0.5 + dy * hexgrid.SIN60, dy * 0.5 - dx * hexgrid.SIN60)


# Hexagon corners around a cell in lattice units, counter-clockwise.
CORNERS = ((1 / 3, 2 / 3), (-1 / 3, 1 / 3), (-2 / 3, -1 / 3), (-1 / 3, -2 / 3), (1 / 3, -1 / 3), (2 / 3, 1 / 3))
# The corner a pentagon lacks, for the upper and the lower row of diamonds.
_MISSING_UPPER, _MISSING_LOWER = 2, 3


def hexagon_centres(quad, i, j, level: int):
    """Cell centres in degrees; caps sit on icosahedron vertices 0 and 11."""
    n = float(1 << level)
    inner = np.clip(quad, 1, 10)
    lon, lat = unproject_diamond(inner, i / n, j / n)
    for cap in (0, 11):
        vlat, vlon = hexgrid.VERTICES[cap]
        lon = np.where(quad == cap, np.degrees(vlon), lon)
        lat = np.where(quad == cap, np.degrees(vlat), lat)
    polar = np.abs(np.abs(lat) - 90.0) < 1e-6
    lon = np.where(polar, np.where(lat > 0, hexgrid.NORTH_POLE_LON, hexgrid.SOUTH_POLE_LON), lon)
    lat = np.where(polar, np.sign(lat) * 90.0, lat)
    return lon, lat


def hexagon_corners(quad, i, j, level: int):
    """Corner longitudes and latitudes, shape (cells, 6); NaN marks the corner a pentagon lacks."""
    n = float(1 << level)
    count = len(quad)
    q = np.repeat(quad[:, None], 6, axis=1)
    u = (i[:, None] + np.array([c[0] for c in CORNERS])[None, :]) / n
    v = (j[:, None] + np.array([c[1] for c in CORNERS])[None, :]) / n
    gone = np.zeros((count, 6), dtype=bool)
    pent = (i == 0) & (j == 0) & (quad >= 1) & (quad <= 10)
    gone[pent & (quad <= 5), _MISSING_UPPER] = True
    gone[pent & (quad >= 6), _MISSING_LOWER] = True
    for cap, order, cu, cv in ((0, (2, 3, 4, 5, 1), 1 / 3, n - 1 / 3), (11, (8, 7, 6, 10, 9), n - 1 / 3, 1 / 3)):
        rows = np.flatnonzero(quad == cap)
        if len(rows):
            q[rows[:, None], np.arange(5)[None, :]] = order
            u[rows] = cu / n
            v[rows] = cv / n
            gone[rows, 5] = True
            q[rows, 5] = order[0]
    lon, lat = unproject_diamond(q.ravel(), u.ravel(), v.ravel())
    lon, lat = lon.reshape(count, 6), lat.reshape(count, 6)
    lon[gone] = np.nan
    lat[gone] = np.nan
    return lon, lat


#: Parts of a hexagon's side when it is drawn with its bends.
SIDE_PARTS = 8


def hexagon_outline(quad, i, j, level: int):
    """Longitudes and latitudes along the true sides, shape (cells, points).

    A side is straight on the unfolded icosahedron: it bends where it crosses an icosahedron edge and curves a little
    between, so it is drawn at equal parts and at the crossings.  The twelve pentagons keep their corners.
    """
    # Rows of a batch often name the same cell: each is drawn once.
    cells, back = np.unique(np.stack([quad, i, j], axis=1), axis=0, return_inverse=True)
    lon, lat = _outline_of(*cells.T, level)
    return lon[back.ravel()], lat[back.ravel()]


def _outline_of(quad, i, j, level: int):
    n = float(1 << level)
    corner = np.array(CORNERS)
    a = np.stack([i, j], axis=1)[:, None, :] + corner
    step = np.roll(corner, -1, axis=0) - corner
    with np.errstate(divide="ignore", invalid="ignore"):
        cuts = [(m - a[..., k]) / step[:, k] for k in (0, 1) for m in (0.0, n)]
        cuts.append((a[..., 1] - a[..., 0]) / (step[:, 0] - step[:, 1]))
        at = np.stack(cuts, axis=2)
        at = np.where((at > 0) & (at < 1), at, 0.0)
    parts = np.broadcast_to(np.arange(SIDE_PARTS) / SIDE_PARTS, (*at.shape[:2], SIDE_PARTS))
    at = np.sort(np.concatenate([parts, at], axis=2), axis=2)
    uv = (a[:, :, None, :] + at[..., None] * step[None, :, None, :]) / n
    count = len(quad)
    q = np.repeat(np.clip(quad, 1, 10), uv.shape[1] * uv.shape[2])
    lon, lat = unproject_diamond(q, uv[..., 0].ravel(), uv[..., 1].ravel())
    lon, lat = lon.reshape(count, -1), lat.reshape(count, -1)
    pent = np.flatnonzero((quad < 1) | (quad > 10) | ((i == 0) & (j == 0)))
    if len(pent):
        clon, clat = hexagon_corners(quad[pent], i[pent], j[pent], level)
        gone = np.isnan(clon)
        clon, clat = np.where(gone, np.roll(clon, 1, axis=1), clon), np.where(gone, np.roll(clat, 1, axis=1), clat)
        lon[pent], lat[pent] = np.repeat(clon, lon.shape[1] // 6, axis=1), np.repeat(clat, lat.shape[1] // 6, axis=1)
    return lon, lat


def continuous_lon(ring_lon):
    """Longitudes along the last axis made continuous: no step larger than half a turn."""
    return np.unwrap(ring_lon, period=360.0)


def unproject_metric(easting, northing, zone, northern, polar):
    """Longitude and latitude in degrees of UTM (zone > 0) or UPS coordinates."""
    easting, northing = np.asarray(easting, float), np.asarray(northing, float)
    zone, northern, polar = np.asarray(zone, float), np.asarray(northern, bool), np.asarray(polar, bool)
    scale = metric.UTM_SCALE * metric.RECTIFYING
    xi = (northing - np.where(northern, 0.0, metric.UTM_FALSE_NORTHING)) / scale
    eta = (easting - metric.UTM_FALSE_EASTING) / scale
    x0, e0 = xi.copy(), eta.copy()
    for k, b in enumerate(metric.BETA, start=1):
        x0 -= b * np.sin(2 * k * xi) * np.cosh(2 * k * eta)
        e0 -= b * np.cos(2 * k * xi) * np.sinh(2 * k * eta)
    taup = np.sin(x0) / np.sqrt(np.sinh(e0) ** 2 + np.cos(x0) ** 2)
    utm_lat = np.degrees(_geodetic(taup))
    utm_lon = zone * 6.0 - 183.0 + np.degrees(np.arctan2(np.sinh(e0), np.cos(x0)))
    dx, dy = easting - metric.UPS_FALSE, northing - metric.UPS_FALSE
    t = np.hypot(dx, dy) / metric.UPS_RADIUS
    with np.errstate(divide="ignore", invalid="ignore"):
        polar_lat = np.where(t > 0, np.degrees(_geodetic((1.0 / t - t) / 2.0)), 90.0)
    polar_lat = np.where(northern, polar_lat, -polar_lat)
    polar_lon = np.degrees(np.arctan2(dx, np.where(northern, -dy, dy)))
    return np.where(polar, polar_lon, utm_lon), np.where(polar, polar_lat, utm_lat)


def project_metric(lon, lat, zone, northern, polar):
    """UTM or UPS coordinates of points in degrees; arrays broadcast against each other."""
    lam, phi = np.radians(lon), np.radians(lat)
    dlon = lam - np.radians(zone * 6.0 - 183.0)
    s = np.clip(np.sin(phi), -1 + 1e-16, 1 - 1e-16)
    t = np.sinh(np.arctanh(s) - metric.ECC * np.arctanh(metric.ECC * s))
    xi, eta = np.arctan2(t, np.cos(dlon)), np.arcsinh(np.sin(dlon) / np.hypot(t, np.cos(dlon)))
    e, n = eta.copy(), xi.copy()
    for j, a in enumerate(metric.ALPHA, start=1):
        n += a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        e += a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    scale = metric.UTM_SCALE * metric.RECTIFYING
    e = metric.UTM_FALSE_EASTING + scale * e
    n = scale * n + np.where(northern, 0.0, metric.UTM_FALSE_NORTHING)
    es = metric.ECC * np.sin(np.abs(phi))
    rho = metric.UPS_RADIUS * np.tan(np.pi / 4 - np.abs(phi) / 2) / ((1 - es) / (1 + es)) ** (metric.ECC / 2)
    polar_e = metric.UPS_FALSE + rho * np.sin(lam)
    polar_n = metric.UPS_FALSE + np.where(northern, -1.0, 1.0) * rho * np.cos(lam)
    return np.where(polar, polar_e, e), np.where(polar, polar_n, n)


def _geodetic(taup):
    """Geodetic latitude from the tangent of the conformal one."""
    e2, e = metric.ECC2, metric.ECC
    tau = taup / (1.0 - e2)
    for _ in range(6):
        root = np.sqrt(1.0 + tau * tau)
        sigma = np.sinh(e * np.arctanh(e * tau / root))
        have = tau * np.sqrt(1.0 + sigma * sigma) - sigma * root
        tau = tau + (taup - have) / np.sqrt(1.0 + have * have) * (1.0 + (1.0 - e2) * tau * tau) / ((1.0 - e2) * root)
    return np.arctan(tau)


# ---------------------------------------------------------------------------
# polygons

# Rings of a batch are one array (cells, points, 2).  Shorter rings repeat their
# first point at the end, which changes neither their area nor a clip.

def areas(rings):
    """Areas of a batch of rings."""
    x, y = rings[:, :, 0] - rings[:, :1, 0], rings[:, :, 1] - rings[:, :1, 1]
    return np.abs(np.sum(x * np.roll(y, -1, axis=1) - np.roll(x, -1, axis=1) * y, axis=1)) / 2.0


def counter_clockwise(rings):
    x, y = rings[:, :, 0] - rings[:, :1, 0], rings[:, :, 1] - rings[:, :1, 1]
    turn = np.sum(x * np.roll(y, -1, axis=1) - np.roll(x, -1, axis=1) * y, axis=1)
    # Reversal keeps the first point first, so that the padding stays at the end.
    back = np.concatenate([rings[:, :1], rings[:, :0:-1]], axis=1)
    return np.where((turn < 0)[:, None, None], back, rings)


def clip_left(rings, ax, ay, bx, by):
    """Part of every ring on the left of its own directed line a -> b."""
    side = (bx - ax)[:, None] * (rings[:, :, 1] - ay[:, None]) - (by - ay)[:, None] * (rings[:, :, 0] - ax[:, None])
    inside = side >= 0
    if inside.all():
        return rings
    nxt, nside = np.roll(rings, -1, axis=1), np.roll(side, -1, axis=1)
    crosses = inside != np.roll(inside, -1, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(crosses, side / (side - nside), 0.0)
    both = np.stack([rings, rings + t[:, :, None] * (nxt - rings)], axis=2).reshape(len(rings), -1, 2)
    mask = np.stack([inside, crosses], axis=2).reshape(len(rings), -1)
    count = mask.sum(axis=1)
    width = max(int(count.max()), 1)
    order = np.argsort(~mask, axis=1, kind="stable")[:, :width]
    out = np.take_along_axis(both, order[:, :, None], axis=1)
    spare = np.arange(width)[None, :] >= count[:, None]
    return np.where(spare[:, :, None], out[:, :1], out)


def clip_box(rings, west, south, east, north):
    """Part of every ring inside its own box."""
    for ax, ay, bx, by in (
        (west, south, east, south), (east, south, east, north), (east, north, west, north), (west, north, west, south),
    ):
        rings = clip_left(rings, ax, ay, bx, by)
    return rings


def clip_convex(rings, windows):
    """Part of every ring inside its own convex counter-clockwise window."""
    for k in range(windows.shape[1]):
        a, b = windows[:, k], windows[:, (k + 1) % windows.shape[1]]
        rings = clip_left(rings, a[:, 0], a[:, 1], b[:, 0], b[:, 1])
    return rings


def centroids(rings):
    """Centroids of a batch of rings; the mean point of a ring without area."""
    x, y = rings[:, :, 0], rings[:, :, 1]
    x0, y0 = x[:, :1], y[:, :1]
    dx, dy = x - x0, y - y0
    cross = dx * np.roll(dy, -1, axis=1) - np.roll(dx, -1, axis=1) * dy
    total = cross.sum(axis=1)
    flat = np.abs(total) < 1e-18
    safe = np.where(flat, 1.0, total)
    cx = ((dx + np.roll(dx, -1, axis=1)) * cross).sum(axis=1) / (3 * safe)
    cy = ((dy + np.roll(dy, -1, axis=1)) * cross).sum(axis=1) / (3 * safe)
    return np.where(flat, x.mean(axis=1), x0[:, 0] + cx), np.where(flat, y.mean(axis=1), y0[:, 0] + cy)


def pad_rings(parts):
    """A batch from rings of different length."""
    width = max((len(p) for p in parts), default=1)
    out = np.empty((len(parts), width, 2))
    for k, p in enumerate(parts):
        out[k, : len(p)] = p
        out[k, len(p) :] = p[0]
    return out
