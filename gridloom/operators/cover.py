"""Covers: which cells a box or polygon takes up.

Box covers are index arithmetic (geohash) or index arithmetic followed by an
exact overlap test (MGRS, ISEA4H).  Candidates always come from the area itself,
so the cost follows the area of interest and never the size of the grid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import geohash, isea4h, mgrs, shapes
from gridloom.operators import grid as gridops
from gridloom.operators.hexminimal import minimal_cover

BOX = ("min_lon", "min_lat", "max_lon", "max_lat")
# The box of a geohash candidate, known from its indices.
_INDEX_BOX = ("__w", "__s", "__e", "__n")
MODES = ("intersect", "contain", "minimal")
# Name of a distinct area.
_AREA = "__area"

# A cell counts as inside an area when all but this part of its own area is.
CONTAIN_TOLERANCE = 1e-9
# Overlaps below this many square degrees, relative to the cell, are edge contact.
CONTACT_TOLERANCE = 1e-12


def _check(grid: str, level: int, mode: str) -> None:
    gridops.check_level(grid, level)
    if mode not in MODES:
        raise ValueError(f"unsupported cover mode: {mode}")


# ---------------------------------------------------------------------------
# candidates

def _ranges(level: int, mode: str, w: Column, s: Column, e: Column, n: Column):
    i0, i1 = geohash.index_range(w, e, -180.0, geohash.cell_width(level), geohash.columns_at(level), mode)
    j0, j1 = geohash.index_range(s, n, -90.0, geohash.cell_height(level), geohash.rows_at(level), mode)
    return i0, i1, j0, j1


def _span(first: Column, last: Column) -> Column:
    """first..last as an array, empty when the range is."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def geohash_candidates(df: DataFrame, level: int, mode: str = "intersect") -> DataFrame:
    """One row per geohash cell of each row's box, as ``__x, __y`` and the cell's own box ``__w..__n``."""
    w, s, e, n = (F.col(c) for c in BOX)
    i0, i1, j0, j1 = _ranges(level, mode, w, s, e, n)
    df = df.withColumns({"__i0": i0, "__i1": i1, "__j0": j0, "__j1": j1})
    df = df.withColumn("__x", F.explode(_span(F.col("__i0"), F.col("__i1"))))
    df = df.withColumn("__y", F.explode(_span(F.col("__j0"), F.col("__j1"))))
    box = geohash.bbox_of_index(F.col("__x"), F.col("__y"), level)
    df = df.withColumns({f"__{k}": v for k, v in zip(("w", "s", "e", "n"), box.values())})
    return df.drop("__i0", "__i1", "__j0", "__j1")


def mgrs_candidates(df: DataFrame, precision: int) -> DataFrame:
    """One row per MGRS cell that may overlap each row's box.

    The box is cut by zone and latitude band; within one piece the projected
    extremes lie at its corners, on the central meridian or at a right angle to
    the pole, so the index ranges are exact.
    """
    w, s, e, n = (F.col(c) for c in BOX)
    zone0, zone1 = F.floor((w + 180.0) / 6.0).cast("int"), F.ceil((e + 180.0) / 6.0).cast("int")
    # One zone more on each side: the wide zones of the far north reach over their neighbours.
    zones = F.transform(F.sequence(zone0 - 1, zone1 + 1), lambda z: F.pmod(z, F.lit(60)) + 1)
    utm_part = (s < 84.0) & (n > -80.0)
    band0 = F.greatest(F.floor((s + 80.0) / 8.0), F.lit(0)).cast("int")
    band1 = F.least(F.ceil((n + 80.0) / 8.0) - 1, F.lit(19)).cast("int")
    none = F.array().cast("array<int>")
    bands = F.when(utm_part, F.sequence(F.least(band0, F.lit(19)), F.greatest(band1, F.least(band0, F.lit(19))))).otherwise(none)
    # Bands -1 and 20 stand for the two polar areas.
    bands = F.concat(
        bands,
        F.when(s < -80.0, F.array(F.lit(-1))).otherwise(none),
        F.when(n > 84.0, F.array(F.lit(20))).otherwise(none),
    )
    df = df.withColumn("__band", F.explode(bands))
    polar_here = (F.col("__band") < 0) | (F.col("__band") > 19)
    df = df.withColumn(
        "__zone",
        F.explode(F.when(polar_here, F.array(F.lit(0))).otherwise(F.array_distinct(zones))),
    )
    df = df.withColumns(
        {
            "__polar": polar_here,
            "__northern": F.col("__band") >= 10,
            "__zone": F.col("__zone").cast("int"),
        }
    )
    box = shapes.zone_box(F.col("__zone"), F.col("__band"), F.col("__polar"), F.col("__northern"))
    df = df.withColumns({f"__v{k[0]}": v for k, v in box.items()})
    df = df.withColumns(
        {
            "__pw": F.greatest(w, F.col("__vw")),
            "__ps": F.greatest(s, F.col("__vs")),
            "__pe": F.least(e, F.col("__ve")),
            "__pn": F.least(n, F.col("__vn")),
        }
    ).filter("__pw < __pe and __ps < __pn")
    pw, ps, pe, pn = (F.col(f"__p{k}") for k in "wsen")

    def within(x: Column) -> Column:
        return F.least(F.greatest(x, pw), pe)

    middle = within(F.col("__zone") * 6.0 - 183.0)
    polar = F.col("__polar")
    lons = [
        pw,
        pe,
        F.when(polar, within(F.lit(0.0))).otherwise(middle),
        F.when(polar, within(F.lit(-90.0))).otherwise(middle),
        F.when(polar, within(F.lit(90.0))).otherwise(middle),
    ]
    # Project the ten extreme points of each piece, then take the ranges per piece.
    spots = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x in lons for y in (ps, pn)])
    size = float(10 ** (5 - precision))
    df = df.withColumn("__en", shapes.project_points(spots, F.col("__zone"), polar, F.col("__northern")))
    es, ns = F.col("__en")["e"], F.col("__en")["n"]
    tiny = 1e-6
    df = df.withColumns(
        {
            "__e0": F.floor((F.array_min(es) + tiny) / size).cast("long"),
            "__e1": (F.ceil((F.array_max(es) - tiny) / size) - 1).cast("long"),
            "__n0": F.floor((F.array_min(ns) + tiny) / size).cast("long"),
            "__n1": (F.ceil((F.array_max(ns) - tiny) / size) - 1).cast("long"),
        }
    ).drop("__en", "__pw", "__ps", "__pe", "__pn")
    df = df.withColumn("__ei", F.explode(_span(F.col("__e0"), F.col("__e1"))))
    df = df.withColumn("__ni", F.explode(_span(F.col("__n0"), F.col("__n1"))))
    df = df.withColumns({"__easting": F.col("__ei") * size, "__northing": F.col("__ni") * size})
    code = F.when(
        polar, mgrs.ups_reference(F.col("__easting"), F.col("__northing"), F.col("__northern"), precision)
    ).otherwise(
        mgrs.utm_reference(F.col("__easting"), F.col("__northing"), F.col("__zone"), F.col("__band"), precision)
    )
    return df.withColumn("space_code", code).drop("__e0", "__e1", "__n0", "__n1", "__ei", "__ni")


def isea4h_candidates(df: DataFrame, level: int, key: list[str]) -> DataFrame:
    """One row per hexagon that may overlap each row's box: the cells under a lattice laid over the box, and those around them.

    The lattice is finer than a hexagon's inner radius, so every cell the box
    touches is one under the lattice or next to one.
    """
    w, s, e, n = (F.col(c) for c in BOX)
    area = 4.0 * 3.141592653589793 * (180.0 / 3.141592653589793) ** 2 / isea4h.cell_count(level)
    step = 0.5 * (area / 3.4641016151377544) ** 0.5
    rows = F.greatest(F.ceil((n - s) / step), F.lit(1)).cast("int")
    df = df.withColumn("__rows", rows).withColumn("__r", F.explode(F.sequence(F.lit(0), F.col("__rows"))))
    df = df.withColumn("__lat", s + (n - s) * F.col("__r") / F.col("__rows"))
    # Towards the poles a degree of longitude shrinks; beside a pole one step is a whole turn.
    squeeze = F.greatest(F.cos(F.radians(F.col("__lat"))), F.lit(0.02))
    cols = F.greatest(F.ceil((e - w) * squeeze / step), F.lit(1)).cast("int")
    df = df.withColumn("__cols", cols).withColumn("__c", F.explode(F.sequence(F.lit(0), F.col("__cols"))))
    df = df.withColumn("__lon", w + (e - w) * F.col("__c") / F.col("__cols"))
    df = isea4h.with_cell(df, F.col("__lon"), F.col("__lat"), level, "__seq")
    df = df.drop("__rows", "__r", "__cols", "__c", "__lon", "__lat").dropDuplicates(key + ["__seq"])
    quad, i, j = isea4h.triple(F.col("__seq"), level)
    df = df.withColumns({"__q": quad, "__i": i, "__j": j})
    ring = F.concat(F.array(F.col("__seq")), isea4h.neighbors(F.col("__q"), F.col("__i"), F.col("__j"), level))
    df = df.withColumn("__seq", F.explode(ring)).dropDuplicates(key + ["__seq"])
    quad, i, j = isea4h.triple(F.col("__seq"), level)
    return df.withColumns({"__q": quad, "__i": i, "__j": j, "space_code": F.col("__seq").cast("string")})


def with_outline(df: DataFrame, grid: str, level: int) -> DataFrame:
    """Add ``__outline`` (open ring arrays) to candidate rows."""
    if grid == "geohash":
        w, s, e, n = (F.col(f"__{k}") for k in "wsen")
        return df.withColumn(
            "__outline", F.struct(F.array(w, e, e, w).alias("ring_lon"), F.array(s, s, n, n).alias("ring_lat"))
        )
    if grid == "isea4h":
        return df.withColumn("__outline", shapes.hexagon_shape(F.col("__q"), F.col("__i"), F.col("__j"), level))
    return df.withColumn(
        "__outline",
        shapes.metric_shape(
            *[F.col(f"__{k}") for k in ("easting", "northing", "zone", "northern", "polar", "vw", "vs", "ve", "vn")],
            precision=level,
        ),
    )


def _keep(df: DataFrame, mode: str, inside: Column, whole: Column) -> DataFrame:
    if mode == "contain":
        return df.filter((whole > 0.0) & (inside >= whole * (1.0 - CONTAIN_TOLERANCE)))
    return df.filter(inside > whole * CONTACT_TOLERANCE)


# ---------------------------------------------------------------------------
# boxes

def cover_bbox(
    df: DataFrame,
    grid: str = "geohash",
    level: int = 5,
    mode: str = "intersect",
    key: list[str] | None = None,
    boundary: str = "bbox",
    bends: bool = False,
) -> DataFrame:
    """One row per cell of each row's box (``min_lon, min_lat, max_lon, max_lat``).

    ``intersect`` keeps cells that share positive area with the box, ``contain``
    cells inside it, ``minimal`` replaces complete groups of children by their
    parent.  ``key`` names the columns that identify a row (all non-box columns
    by default).  ``boundary`` adds the cell's box, its ring (``polygon``) or
    nothing (``none``).  A box with ``min_lon > max_lon`` crosses the dateline.  ``bends`` draws hexagons
    with the bends of their sides (not in ``minimal``), so that the cells of all points in a box are in its cover.
    """
    _check(grid, level, mode)
    key = key or [c for c in df.columns if c not in BOX]
    if grid == "geohash":
        parts = gridops.bbox_rings(df).drop("ring", "part_no")
        cells = _geohash_minimal(parts, level) if mode == "minimal" else _box_level(parts, grid, level, mode, key)
        return _finish(cells, grid, boundary, level, mode)
    return _finish(_each_area_once(df, BOX, key, lambda areas: _box_cells(areas, grid, level, mode, bends)), grid, boundary, level, mode)


def _box_cells(areas: DataFrame, grid: str, level: int, mode: str, bends: bool) -> DataFrame:
    """Hexagons or squares of distinct areas made of boxes."""
    if mode == "minimal" and grid == "isea4h":
        return minimal_cover(_box_parts(areas, [_AREA]), level, [_AREA])
    parts = gridops.bbox_rings(areas).drop("ring", "part_no")
    if mode == "minimal":
        return _minimal(lambda lv, m: _box_level(parts, grid, lv, m, [_AREA]), grid, level, [_AREA])
    return _box_level(parts, grid, level, mode, [_AREA], bends)


def _each_area_once(df: DataFrame, shape: tuple, key: list[str], cover) -> DataFrame:
    """``cover`` of each distinct area, joined to all rows that have it.

    An area is the set of shapes with one key, named by a digest of their exact values; repeated
    footprints (scenes of one path and row) are drawn and clipped once.
    """
    rest = [c for c in df.columns if c not in shape and c not in key]
    shapes_of = F.array_sort(F.collect_list(F.struct(*shape)))
    rows = df.groupBy(*key).agg(*[F.first(c).alias(c) for c in rest], shapes_of.alias("__shapes"))
    rows = rows.withColumn(_AREA, F.sha2(F.to_json("__shapes"), 256))
    areas = rows.groupBy(_AREA).agg(F.first("__shapes").alias("__shapes")).select(_AREA, F.inline("__shapes"))
    return rows.drop("__shapes").join(_many(cover(areas)), _AREA).drop(_AREA)


def _many(cells: DataFrame) -> DataFrame:
    """Cells that are joined by a shuffle: before it runs, Spark takes them for as few as the rows they were made of, and would broadcast them."""
    return cells.hint("merge")


def _box_level(parts: DataFrame, grid: str, level: int, mode: str, key: list[str], bends: bool = False) -> DataFrame:
    """Cells of one level as ``key columns, grid_level, space_code``."""
    keep = [c for c in parts.columns if c not in BOX]
    aoi = [F.col(c) for c in BOX]
    if grid == "geohash":
        cells = geohash_candidates(parts, level, mode).withColumn(
            "space_code", geohash.encode(F.col("__x"), F.col("__y"), level)
        )
        return cells.select(*keep, F.lit(level).alias("grid_level"), "space_code", *_INDEX_BOX)
    parts = _spread_rows(parts, key)
    if grid == "isea4h":
        cells = isea4h_candidates(parts, level, key + list(BOX))
        areas = shapes.hexagon_box_overlap(F.col("__q"), F.col("__i"), F.col("__j"), level, *aoi, bends=bends)
    else:
        cells = mgrs_candidates(parts, level)
        areas = shapes.metric_box_overlap(
            *[F.col(f"__{k}") for k in ("easting", "northing", "zone", "northern", "polar")],
            cell_box=[F.col(f"__v{k}") for k in "wsen"],
            aoi_box=aoi,
            precision=level,
        )
    cells = cells.withColumn("__a", areas)
    # The parts of a box cut at the dateline are added up per cell.
    rest = [c for c in keep if c not in key]
    cells = cells.groupBy(*key, "space_code").agg(
        *[F.first(c).alias(c) for c in rest],
        F.sum("__a.inside").alias("__inside"),
        F.max("__a.whole").alias("__whole"),
    )
    cells = _keep(cells, mode, F.col("__inside"), F.col("__whole"))
    return cells.select(*keep, F.lit(level).alias("grid_level"), "space_code")


def _spread_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows spread over all tasks before each becomes many cells; the number is fixed, or the small rows would be put together again."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [c for c in (*key, *BOX) if c in df.columns]
    return df.repartition(tasks, *by)


def _geohash_minimal(parts: DataFrame, level: int) -> DataFrame:
    """Largest cells inside the box, and the border cells of the requested level; no shuffle.

    A parent replaces its 32 children exactly when the box holds the parent, so
    each level can be decided from the box alone.
    """
    keep = [c for c in parts.columns if c not in BOX]
    w, s, e, n = (F.col(c) for c in BOX)
    out = []
    for lv in range(1, level + 1):
        cells = geohash_candidates(parts, lv, "contain" if lv < level else "intersect")
        if lv > 1:
            dx, dy = geohash.lon_bits(lv) - geohash.lon_bits(lv - 1), geohash.lat_bits(lv) - geohash.lat_bits(lv - 1)
            box = geohash.bbox_of_index(F.shiftright("__x", dx), F.shiftright("__y", dy), lv - 1)
            swallowed = (
                (box["min_lon"] >= w) & (box["max_lon"] <= e) & (box["min_lat"] >= s) & (box["max_lat"] <= n)
            )
            cells = cells.filter(~swallowed)
        code = geohash.encode(F.col("__x"), F.col("__y"), lv)
        out.append(cells.select(*keep, F.lit(lv).alias("grid_level"), code.alias("space_code"), *_INDEX_BOX))
    return reduce(DataFrame.unionByName, out)


def _minimal(cover_at, grid: str, level: int, key: list[str]) -> DataFrame:
    """Largest nested cells inside the area: level by level, without the children of those taken before."""
    lowest = gridops.GRID_LEVELS[grid][0]
    out, above = [], None
    for lv in range(lowest, level + 1):
        inside = cover_at(lv, "contain")
        cells = inside if lv < level else cover_at(lv, "intersect")
        if above is not None:
            cells = gridops.parent_cells(cells, grid, lv)
            taken = above.select(*key, F.col("space_code").alias("parent_code"))
            cells = cells.join(_many(taken), key + ["parent_code"], "left_anti").drop("parent_code", "parent_level")
        out.append(cells)
        above = inside
    return reduce(DataFrame.unionByName, [o.select(*out[0].columns) for o in out])


def _finish(cells: DataFrame, grid: str, boundary: str, level: int, mode: str) -> DataFrame:
    """Add the grid name and the wanted outline; the outline is drawn per distinct cell."""
    cells = cells.withColumn("grid_type", F.lit(grid))
    if boundary == "none":
        return cells.drop(*_INDEX_BOX)
    if grid == "geohash":
        if "__w" in cells.columns:
            cells = cells.withColumnsRenamed({a: f"cell_{b}" for a, b in zip(_INDEX_BOX, BOX)})
        else:
            cells = cells.withColumns({f"cell_{k}": v for k, v in geohash.bbox_of(F.col("space_code")).items()})
        if boundary == "polygon":
            cells = cells.withColumn("cell_ring", shapes.box_ring(*[F.col(f"cell_{k}") for k in BOX]))
        return cells
    distinct = cells.select("grid_level", "space_code").distinct()
    drawn = None
    for lv in range(gridops.GRID_LEVELS[grid][0], level + 1) if mode == "minimal" else [level]:
        one = gridops.cell_geometry(distinct.filter(F.col("grid_level") == lv), grid, lv)
        drawn = one if drawn is None else drawn.unionByName(one)
    shape = drawn.select("grid_level", "space_code", *[F.col(k).alias(f"cell_{k}") for k in (*BOX, "ring")])
    if boundary == "bbox":
        shape = shape.drop("cell_ring")
    return cells.join(shape, ["grid_level", "space_code"])


# ---------------------------------------------------------------------------
# polygons

def cover_polygon(
    df: DataFrame,
    grid: str = "geohash",
    level: int = 5,
    mode: str = "intersect",
    key: list[str] | None = None,
    ring: str = "ring",
    boundary: str = "bbox",
) -> DataFrame:
    """One row per cell of each polygon.

    A polygon is a closed ``ring`` (``ARRAY<STRUCT<lon, lat>>``); a multipolygon
    is several rows with the same ``key``, a hole a row with ``is_hole`` true.
    """
    _check(grid, level, mode)
    key = key or [c for c in df.columns if c not in (ring, "is_hole")]
    hole = F.coalesce(F.col("is_hole"), F.lit(False)) if "is_hole" in df.columns else F.lit(False)
    shape = df.select(*key, F.col(ring).alias("__polygon"), hole.alias("is_hole"))
    cells = _each_area_once(shape, ("__polygon", "is_hole"), key, lambda areas: _polygon_cells(areas, grid, level, mode))
    return _finish(cells, grid, boundary, level, mode)


def _polygon_cells(areas: DataFrame, grid: str, level: int, mode: str) -> DataFrame:
    """Cells of distinct areas made of polygons and holes."""
    if mode == "minimal" and grid == "isea4h":
        return minimal_cover(_rings(areas, "__polygon", [_AREA]), level, [_AREA])
    parts = _polygon_parts(areas, "__polygon", [_AREA])
    if mode == "minimal":
        return _minimal(lambda lv, m: _polygon_level(parts, grid, lv, m, [_AREA]), grid, level, [_AREA])
    return _polygon_level(parts, grid, level, mode, [_AREA])


def _rings(df: DataFrame, ring: str, key: list[str]) -> DataFrame:
    """Open ring arrays with continuous longitudes and whether they are holes."""
    hole = F.col("is_hole") if "is_hole" in df.columns else F.lit(False)
    r = F.slice(F.col(ring), F.lit(1), F.size(F.col(ring)) - 1)
    return df.select(
        *key,
        hole.alias("__hole"),
        F.xxhash64(F.col(ring), hole).alias("__part"),
        shapes.continuous(F.transform(r, lambda p: p["lon"])).alias("__rx"),
        F.transform(r, lambda p: p["lat"]).alias("__ry"),
    )


def _box_parts(df: DataFrame, key: list[str]) -> DataFrame:
    """Boxes as rings; one that crosses the dateline runs on beyond 180 degrees, a whole turn stays one."""
    w, s, e, n = (F.col(c).cast("double") for c in BOX)
    e = F.when(w > e, e + 360.0).otherwise(e)
    rest = [c for c in df.columns if c not in BOX and c not in key]
    return df.select(*key, *rest, F.lit(False).alias("__hole"), F.array(w, e, e, w).alias("__rx"), F.array(s, s, n, n).alias("__ry"))


def _polygon_parts(df: DataFrame, ring: str, key: list[str]) -> DataFrame:
    """Ring arrays (made continuous) with their bounding boxes, shifted into WGS84 where they cross the dateline."""
    out = _rings(df, ring, key)
    out = out.withColumn("__shift", F.explode(F.array(*[F.lit(v) for v in (-360.0, 0.0, 360.0)])))
    out = out.withColumn("__rx", F.transform("__rx", lambda v: v + F.col("__shift")))
    out = out.withColumns(
        {
            "min_lon": F.greatest(F.array_min("__rx"), F.lit(-180.0)),
            "max_lon": F.least(F.array_max("__rx"), F.lit(180.0)),
            "min_lat": F.array_min("__ry"),
            "max_lat": F.array_max("__ry"),
        }
    )
    return out.filter("min_lon < max_lon").drop("__shift")


def _polygon_level(parts: DataFrame, grid: str, level: int, mode: str, key: list[str]) -> DataFrame:
    if grid == "geohash":
        cells = geohash_candidates(parts, level, "intersect").withColumn(
            "space_code", geohash.encode(F.col("__x"), F.col("__y"), level)
        )
    elif grid == "mgrs":
        cells = mgrs_candidates(parts, level)
    else:
        cells = isea4h_candidates(parts, level, key + ["__part"])
    cells = with_outline(cells, grid, level)
    areas = shapes.ring_polygon_overlap(
        F.col("__outline.ring_lon"), F.col("__outline.ring_lat"), F.col("__rx"), F.col("__ry")
    )
    if grid == "isea4h":
        # The kernel matches a hexagon against every shift of the polygon; shifted copies of
        # the part itself would count the overlap again.
        cells = cells.dropDuplicates(key + ["space_code", "__hole", "__part"])
    cells = cells.withColumn("__a", areas)
    signed = F.when(F.col("__hole"), -F.col("__a.inside")).otherwise(F.col("__a.inside"))
    total = cells.groupBy(*key, "space_code").agg(F.sum(signed).alias("__inside"), F.max("__a.whole").alias("__whole"))
    return _keep(total, mode, F.col("__inside"), F.col("__whole")).select(
        *key, F.lit(level).alias("grid_level"), "space_code"
    )


# ---------------------------------------------------------------------------
# footprints and guarantees

def cover_footprints(obs: DataFrame, grid: str, level: int, ring: str = "footprint") -> DataFrame:
    """Distinct cells of observation footprints: polygons are covered, points located."""
    polygons = obs.filter(F.col(ring).isNotNull()).select("observation_id", F.col(ring).alias("ring"))
    points = obs.filter(F.col(ring).isNull()).select("lon", "lat")
    located = gridops.assign_cells(points, "lon", "lat", grid, level, "null")
    columns = ["grid_type", "grid_level", "space_code"]
    covered = cover_polygon(polygons, grid, level, "intersect", ["observation_id"], boundary="none")
    return located.select(*columns).unionByName(covered.select(*columns)).filter("space_code is not null").distinct()


def ensure_center_cell(tasks: DataFrame, assets: DataFrame, grid: str, level: int, key: list[str]) -> DataFrame:
    """Give every asset without a cell the cell at the centre of its box."""
    w, s, e, n = (F.col(c) for c in BOX)
    missing = assets.join(tasks.select(*key).distinct(), key, "left_anti")
    missing = missing.withColumns({"__lon": (w + e) * 0.5, "__lat": (s + n) * 0.5})
    added = gridops.assign_cells(missing, "__lon", "__lat", grid, level, "null").drop("__lon", "__lat")
    return tasks.unionByName(added, allowMissingColumns=True)
