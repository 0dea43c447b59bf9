"""Grid assignment, cell geometry and cell topology on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import geohash, isea4h, mgrs, shapes
from gridloom.functions.timecode import GRID_LEVELS

GRIDS = tuple(GRID_LEVELS)


def check_level(grid: str, level: int) -> None:
    if grid not in GRID_LEVELS:
        raise ValueError(f"unsupported grid type: {grid}")
    lowest, highest = GRID_LEVELS[grid]
    if not lowest <= level <= highest:
        raise ValueError(f"{grid} level must be in [{lowest}, {highest}]")


def point_is_valid(lon: Column, lat: Column) -> Column:
    return F.coalesce(lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0), F.lit(False))


def assign_cells(
    df: DataFrame,
    lon: str = "lon",
    lat: str = "lat",
    grid: str = "geohash",
    level: int = 5,
    on_error: str = "fail",
    out: str = "space_code",
):
    """Add ``grid_type``, ``grid_level`` and the cell code of each point; no shuffle.

    ``on_error``: ``fail`` raises on a point outside WGS84, ``null`` leaves its
    code NULL, ``reject`` returns ``(good, rejects)``.
    """
    check_level(grid, level)
    if on_error == "reject":
        valid = point_is_valid(F.col(lon), F.col(lat))
        return assign_cells(df.filter(valid), lon, lat, grid, level, "null", out), df.filter(~valid)
    x, y = F.col(lon), F.col(lat)
    valid = point_is_valid(x, y)
    if on_error == "fail":
        x = F.when(valid, x).otherwise(F.raise_error(F.lit("point outside WGS84 bounds")))
    else:
        x, y = F.when(valid, x), F.when(valid, y)
    if grid == "geohash":
        # Indices first, so that each is computed once for all characters of the code.
        df = df.withColumns({"__gx": geohash.column_index(x, level), "__gy": geohash.row_index(y, level)})
        df = df.withColumn(out, geohash.encode(F.col("__gx"), F.col("__gy"), level)).drop("__gx", "__gy")
    elif grid == "mgrs":
        df = mgrs.with_cell(df, x, y, level, out)
    else:
        df = isea4h.with_cell(df, x, y, level, out).withColumn(out, F.col(out).cast("string"))
    return df.withColumns({"grid_type": F.lit(grid), "grid_level": F.lit(level)})


def utm_domain(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add the projected domain (UTM zone or polar) and EPSG code of each point."""
    return df.withColumns(mgrs.domain_columns(F.col(lon), F.col(lat)))


def utm_domain_bounds(spark) -> DataFrame:
    """Valid longitude/latitude boxes of every zone and latitude band, and of the two polar areas."""
    zones = spark.range(1, 61).select(F.col("id").cast("int").alias("zone"))
    bands = spark.range(0, 20).select(F.col("id").cast("int").alias("band"))
    utm = zones.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumns(
        shapes.zone_box(F.col("zone"), F.col("band"), F.lit(False), F.col("band") >= 10)
    )
    utm = utm.filter("west < east").select(
        F.concat(F.lit("utm-"), F.col("zone"), F.when(F.col("band") >= 10, "n").otherwise("s")).alias("domain"),
        F.col("zone"),
        mgrs.letter(mgrs.BANDS, F.col("band")).alias("band"),
        "west", "south", "east", "north",
    )
    polar = bands.filter("band < 2").select(
        F.when(F.col("band") == 0, "ups-s").otherwise("ups-n").alias("domain"),
        F.lit(None).cast("int").alias("zone"),
        F.lit(None).cast("string").alias("band"),
        F.lit(-180.0).alias("west"),
        F.when(F.col("band") == 0, -90.0).otherwise(84.0).alias("south"),
        F.lit(180.0).alias("east"),
        F.when(F.col("band") == 0, -80.0).otherwise(90.0).alias("north"),
    )
    return utm.unionByName(polar)


# ---------------------------------------------------------------------------
# geometry

def _with_shape(df: DataFrame, grid: str, level: int, code: Column) -> DataFrame:
    """Add ``__shape`` (centre and open ring arrays) for the two grids drawn by Arrow kernels."""
    if grid == "isea4h":
        quad, i, j = isea4h.triple(code.cast("long"), level)
        df = df.withColumns({"__q": quad, "__i": i, "__j": j})
        return df.withColumn(
            "__shape", shapes.hexagon_shape(F.col("__q"), F.col("__i"), F.col("__j"), level)
        ).drop("__q", "__i", "__j")
    parts = mgrs.parse(code, level)
    df = df.withColumns({f"__{k}": v for k, v in parts.items()})
    box = shapes.zone_box(F.col("__zone"), F.col("__band"), F.col("__polar"), F.col("__northern"))
    df = df.withColumns({f"__{k}": v for k, v in box.items()})
    shape = shapes.metric_shape(
        *[F.col(f"__{k}") for k in ("easting", "northing", "zone", "northern", "polar", "west", "south", "east", "north")],
        precision=level,
    )
    return df.withColumn("__shape", shape).drop(*[f"__{k}" for k in parts], *[f"__{k}" for k in box])


def cell_geometry(df: DataFrame, grid: str, level: int, code: str = "space_code") -> DataFrame:
    """Add centre, box and closed ring of each row's cell.

    A hexagon box that crosses the antimeridian has ``min_lon > max_lon``; its
    ring stays continuous.  Call it on distinct cells (:func:`distinct_cell_geometry`).
    """
    check_level(grid, level)
    c = F.col(code)
    if grid == "geohash":
        df = df.withColumns(geohash.bbox_of(c))
        return df.withColumns(
            {
                "center_lon": (F.col("min_lon") + F.col("max_lon")) * 0.5,
                "center_lat": (F.col("min_lat") + F.col("max_lat")) * 0.5,
                "ring": shapes.box_ring(F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("max_lat")),
            }
        )
    df = _with_shape(df, grid, level, c)
    s = F.col("__shape")
    west, east = F.array_min(s["ring_lon"]), F.array_max(s["ring_lon"])
    if grid == "isea4h":
        wide = east - west > 180.0 + 1e-6
        bounds = {
            "min_lon": F.when(wide, F.lit(-180.0)).otherwise(F.pmod(west + 180.0, F.lit(360.0)) - 180.0),
            "max_lon": F.when(wide, F.lit(180.0)).otherwise(
                F.when(F.pmod(east + 180.0, F.lit(360.0)) == 0.0, F.lit(180.0)).otherwise(
                    F.pmod(east + 180.0, F.lit(360.0)) - 180.0
                )
            ),
        }
    else:
        bounds = {"min_lon": west, "max_lon": east}
    return df.withColumns(
        {
            **bounds,
            "min_lat": F.array_min(s["ring_lat"]),
            "max_lat": F.array_max(s["ring_lat"]),
            "center_lon": s["center_lon"],
            "center_lat": s["center_lat"],
            "ring": shapes.ring_of(s["ring_lon"], s["ring_lat"]),
        }
    ).drop("__shape")


def wgs84_pieces(df: DataFrame, ring: str = "ring") -> DataFrame:
    """One row per part of a continuous ring cut to longitudes -180..180."""

    return df.select("*", F.posexplode(shapes.wgs84_parts(F.col(ring))).alias("piece_no", "__p")).withColumn(
        "piece", shapes.ring_of(F.col("__p")["ring_lon"], F.col("__p")["ring_lat"])
    ).drop("__p")


def distinct_cell_geometry(df: DataFrame, grid: str, level: int) -> DataFrame:
    """Geometry once per distinct cell of a table."""
    return cell_geometry(df.select("grid_type", "grid_level", "space_code").distinct(), grid, level)


def storage_ring(df: DataFrame, grid: str, ring: str = "ring", tolerance: float = 1e-4) -> DataFrame:
    """Add the ring kept in fact tables and whether it is valid.

    A geohash ring has 5 points, a hexagon 7 and an MGRS ring at least 4; the twelve
    pentagons (6 points) are not valid for storage.  A densified MGRS ring is stored
    as its four corners where the symmetric difference of the two shapes, the areas
    between each edge and its chord, is at most ``tolerance`` of the ring's area.
    """
    r = F.col(ring)
    expected = {"geohash": F.size(r) == 5, "isea4h": F.size(r) == 7, "mgrs": F.size(r) >= 4}[grid]
    stored = r
    if grid == "mgrs":
        step = shapes.EDGE_SEGMENTS
        corners = F.array(*[F.element_at(r, k) for k in (1, 1 + step, 1 + 2 * step, 1 + 3 * step, 1)])
        simple = F.size(r) == 4 * step + 1
        between = [shapes.shoelace(F.concat(F.slice(r, 1 + k * step, step + 1), F.slice(r, 1 + k * step, 1))) for k in range(4)]
        close = sum(between[1:], between[0]) <= tolerance * shapes.shoelace(r)
        stored = F.when(simple & close, corners).otherwise(r)
    in_range = F.forall(r, lambda p: p["lon"].between(-180.0, 180.0) & p["lat"].between(-90.0, 90.0))
    return df.withColumns(
        {"storage_ring": stored, "ring_valid": expected & shapes.ring_is_closed(r) & in_range}
    )


def backfill_geometry(facts: DataFrame, grid: str, level: int, ring: str = "cell_ring") -> DataFrame:
    """Fill missing cell rings of a fact table; each distinct cell is drawn once."""
    missing = facts.filter((F.col("grid_type") == grid) & (F.col("grid_level") == level) & F.col(ring).isNull())
    drawn = distinct_cell_geometry(missing, grid, level).select(
        "grid_type", "grid_level", "space_code", F.col("ring").alias("__ring")
    )
    filled = facts.join(drawn, ["grid_type", "grid_level", "space_code"], "left")
    return filled.withColumn(ring, F.coalesce(F.col(ring), F.col("__ring"))).drop("__ring")


def geometry_report(facts: DataFrame, ring: str = "cell_ring") -> DataFrame:
    """Validation counts of stored rings: rows, missing, not closed, out of range."""
    r = F.col(ring)
    outside = ~F.forall(r, lambda p: p["lon"].between(-180.0, 180.0) & p["lat"].between(-90.0, 90.0))
    return facts.agg(
        F.count("*").alias("rows"),
        F.count_if(r.isNull()).alias("missing"),
        F.count_if(~shapes.ring_is_closed(r)).alias("not_closed"),
        F.count_if(outside).alias("out_of_range"),
        F.min(F.size(r)).alias("min_points"),
        F.max(F.size(r)).alias("max_points"),
    )


def bbox_rings(df: DataFrame) -> DataFrame:
    """One row per box part: a box with ``min_lon > max_lon`` is split at the dateline."""
    w, s, e, n = (F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat"))

    def part(a, b):
        return F.struct(a.alias("min_lon"), s.alias("min_lat"), b.alias("max_lon"), n.alias("max_lat"))

    parts = F.when(w > e, F.array(part(w, F.lit(180.0)), part(F.lit(-180.0), e))).otherwise(F.array(part(w, e)))
    rest = [c for c in df.columns if c not in ("min_lon", "min_lat", "max_lon", "max_lat")]
    out = df.select(*rest, F.posexplode(parts).alias("part_no", "__b")).select(*rest, "part_no", "__b.*")
    return out.withColumn("ring", shapes.box_ring(F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("max_lat")))


# ---------------------------------------------------------------------------
# topology

def parent_cells(df: DataFrame, grid: str, level: int, n: int = 1, code: str = "space_code") -> DataFrame:
    """Add ``parent_code``, the cell ``n`` levels up, and ``parent_level``."""
    check_level(grid, level)
    check_level(grid, level - n)
    c = F.col(code)
    if grid == "geohash":
        df = df.withColumn("parent_code", F.substring(c, 1, level - n))
    elif grid == "mgrs":
        df = df.withColumn("parent_code", c)
        for _ in range(n):
            df = df.withColumn("parent_code", mgrs.parent_of(F.col("parent_code")))
    else:
        df = df.withColumn("__p", c.cast("long"))
        for step in range(n):
            quad, i, j = isea4h.triple(F.col("__p"), level - step)
            df = df.withColumns({"__q": quad, "__i": i, "__j": j})
            df = df.withColumn("__p", isea4h.parent(F.col("__q"), F.col("__i"), F.col("__j"), level - step))
        df = df.withColumn("parent_code", F.col("__p").cast("string")).drop("__p", "__q", "__i", "__j")
    return df.withColumn("parent_level", F.lit(level - n))


def child_cells(df: DataFrame, grid: str, level: int, target_level: int, code: str = "space_code") -> DataFrame:
    """One row per child at ``target_level`` (``child_code``, ``child_level``).

    ISEA4H children overlap between parents and are defined one level down only.
    """
    check_level(grid, target_level)
    if target_level <= level:
        raise ValueError("target level must be finer than the cell level")
    df = df.withColumn("child_code", F.col(code))
    if grid == "geohash":
        digits = F.array(*[F.lit(ch) for ch in geohash.ALPHABET])
        for _ in range(target_level - level):
            df = df.withColumn("__d", F.explode(digits)).withColumn(
                "child_code", F.concat(F.col("child_code"), F.col("__d"))
            )
        df = df.drop("__d")
    elif grid == "mgrs":
        # Only the children of a cell that its zone or band cuts can be empty.
        marked = _with_reference_areas(df, level, code, whole_globe=True)
        cut = F.col("__a.inside") < F.col("__a.whole") * (1.0 - 1e-9)
        whole, border = marked.filter(~cut).drop("__a"), marked.filter(cut).drop("__a")
        border = _mgrs_children(border, target_level - level)
        border = _with_reference_areas(border, target_level, "child_code").filter(F.col("__a.whole") > 0.0).drop("__a")
        df = _mgrs_children(whole, target_level - level).unionByName(border)
    else:
        if target_level != level + 1:
            raise ValueError("ISEA4H children are defined only one level down")
        quad, i, j = isea4h.triple(F.col(code).cast("long"), level)
        df = df.withColumns({"__q": quad, "__i": i, "__j": j})
        df = df.withColumn(
            "child_code",
            F.explode(isea4h.children(F.col("__q"), F.col("__i"), F.col("__j"), level).cast("array<string>")),
        ).drop("__q", "__i", "__j")
    return df.withColumn("child_level", F.lit(target_level))


def _mgrs_children(df: DataFrame, steps: int) -> DataFrame:
    for _ in range(steps):
        df = df.withColumn("__d", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn(
            "child_code", mgrs.child_of(F.col("child_code"), F.floor(F.col("__d") / 10), F.col("__d") % 10)
        )
    return df.drop("__d")


def _with_reference_areas(df: DataFrame, precision: int, code: str, whole_globe: bool = False) -> DataFrame:
    """Add ``__a``: area of a reference's square inside its zone and band, and its whole area.

    The whole area is that of the part in zone and band, or of the full square with ``whole_globe``.
    """
    keep = df.columns
    parts = mgrs.parse(F.col(code), precision)
    df = df.withColumns({f"__{k}": v for k, v in parts.items()})
    box = shapes.zone_box(F.col("__zone"), F.col("__band"), F.col("__polar"), F.col("__northern"))
    df = df.withColumns({f"__{k}": v for k, v in box.items()})
    valid = [F.col(f"__{k}") for k in ("west", "south", "east", "north")]
    globe = [F.lit(-540.0), F.lit(-90.0), F.lit(540.0), F.lit(90.0)]
    areas = shapes.metric_box_overlap(
        *[F.col(f"__{k}") for k in ("easting", "northing", "zone", "northern", "polar")],
        cell_box=globe if whole_globe else valid, aoi_box=valid, precision=precision,
    )
    return df.select(*keep, areas.alias("__a"))


def neighbor_cells(df: DataFrame, grid: str, level: int, k: int = 1, code: str = "space_code") -> DataFrame:
    """One row per cell of the k-ring around each row's cell (``neighbor_code``), without the cell itself."""
    check_level(grid, level)
    if k < 1:
        raise ValueError("k must be at least 1")
    if grid == "geohash":
        x, y = geohash.decode(F.col(code), level)
        df = df.withColumns({"__x": x, "__y": y})
        wide, high = geohash.columns_at(level), geohash.rows_at(level)
        spots = F.array_distinct(
            F.array(
                *[
                    F.struct(
                        F.pmod(F.col("__x") + dx, F.lit(wide).cast("long")).alias("x"),
                        F.greatest(F.least(F.col("__y") + dy, F.lit(high - 1).cast("long")), F.lit(0).cast("long")).alias("y"),
                    )
                    for dx, dy in geohash.neighbor_offsets(k)
                ]
            )
        )
        df = df.withColumn("__s", F.explode(spots))
        df = df.filter((F.col("__s.x") != F.col("__x")) | (F.col("__s.y") != F.col("__y")))
        return df.withColumn("neighbor_code", geohash.encode(F.col("__s.x"), F.col("__s.y"), level)).drop("__x", "__y", "__s")
    # The other grids: k frontier steps per distinct cell, then back to the rows.
    origins = df.select(F.col(code).alias("__origin")).distinct()
    ring = _step(origins.withColumn("__at", F.col("__origin")), grid, level).select("__origin", "__at")
    ring = ring.filter("__origin <> __at").distinct()
    seen = ring
    for _ in range(k - 1):
        ring = _step(ring, grid, level).select("__origin", "__at").filter("__origin <> __at").distinct()
        seen = seen.union(ring).distinct()
    return df.join(seen.withColumnRenamed("__at", "neighbor_code"), df[code] == F.col("__origin")).drop("__origin")


def _step(df: DataFrame, grid: str, level: int) -> DataFrame:
    """Replace ``__at`` by each of its direct neighbours."""
    if grid == "isea4h":
        quad, i, j = isea4h.triple(F.col("__at").cast("long"), level)
        df = df.withColumns({"__q": quad, "__i": i, "__j": j})
        return df.withColumn(
            "__at",
            F.explode(isea4h.neighbors(F.col("__q"), F.col("__i"), F.col("__j"), level).cast("array<string>")),
        ).drop("__q", "__i", "__j")
    return _mgrs_step(df, level)


def _mgrs_step(df: DataFrame, level: int) -> DataFrame:
    """Cells that share an edge with ``__at``, also across zone and band borders.

    The cell's own outline is widened by a hair and covered again: every cell
    under the widened outline touches it.  Corner contact is told from a shared
    edge by the area of the overlap.
    """
    from gridloom.operators import cover

    size_degrees = 10 ** (5 - level) / 111_000.0
    hair = size_degrees * 1e-3
    around = cell_geometry(df, "mgrs", level, "__at").drop("center_lon", "center_lat")
    cos_lat = F.greatest(F.cos(F.radians(F.greatest(F.abs(F.col("min_lat")), F.abs(F.col("max_lat"))))), F.lit(0.02))
    around = around.withColumns(
        {
            "__from": F.col("__at"),
            "min_lon": F.col("min_lon") - hair / cos_lat,
            "max_lon": F.col("max_lon") + hair / cos_lat,
            "min_lat": F.greatest(F.col("min_lat") - hair, F.lit(-90.0)),
            "max_lat": F.least(F.col("max_lat") + hair, F.lit(90.0)),
        }
    ).withColumnRenamed("ring", "__ring")
    covered = cover.mgrs_candidates(around, level)
    covered = cover.with_outline(covered, "mgrs", level)
    touching = covered.withColumn(
        "__shared",
        shapes.shared_border(F.col("__outline")["ring_lon"], F.col("__outline")["ring_lat"], F.col("__ring")),
    ).filter(F.col("__shared") > size_degrees * 1e-6)
    return touching.select(*[c for c in df.columns if c != "__at"], F.col("space_code").alias("__at"))


def rollup_cells(
    df: DataFrame,
    levels: list[int],
    aggs: list[Column],
    grid: str = "geohash",
    level: int | None = None,
    code: str = "space_code",
    by: tuple = (),
) -> DataFrame:
    """Aggregate facts at several coarser levels in one shuffle.

    A geohash ancestor is a prefix of the code; the other grids climb parent by
    parent.  Partial aggregation runs before the shuffle, so a crowded coarse
    cell sends one row per task.
    """
    if grid == "geohash":
        rows = df.withColumn("rollup_level", F.explode(F.array(*[F.lit(v) for v in levels])))
        rows = rows.withColumn("rollup_code", F.col(code).substr(F.lit(1), F.col("rollup_level")))
    else:
        rows = df.withColumn("__c0", F.col(code))
        for step, at in enumerate(range(level, min(levels), -1)):
            rows = parent_cells(rows, grid, at, 1, f"__c{step}").withColumnRenamed("parent_code", f"__c{step + 1}")
            rows = rows.drop("parent_level")
        spots = [F.struct(F.lit(v).alias("level"), F.col(f"__c{level - v}").alias("code")) for v in levels]
        rows = rows.withColumn("__r", F.explode(F.array(*spots)))
        rows = rows.withColumns({"rollup_level": F.col("__r.level"), "rollup_code": F.col("__r.code")})
    return rows.groupBy(*by, "rollup_level", "rollup_code").agg(*aggs)


# ---------------------------------------------------------------------------
# defaults

# Default level of each grid, and metres per degree.
DEFAULT_LEVELS = {"geohash": 4, "mgrs": 1, "isea4h": 6}
OTHER_DEFAULT_LEVEL = 5
METERS_PER_DEGREE = 111320.0
# Names of geographic reference systems.
GEOGRAPHIC_CRS = ("EPSG:4326", "CRS:84", "OGC:CRS84")


def default_level(resolution: Column, grid: Column) -> Column:
    """Grid level for a resolution in metres; the grid's own default where it is unknown."""
    hexagon = F.when(resolution < 10, 12).when(resolution <= 30, 11).otherwise(8)
    square = F.when(resolution < 10, 1).otherwise(0)
    plain = (
        F.when(resolution >= 1000, 2)
        .when(resolution >= 500, 3)
        .when(resolution < 10, 6)
        .when(resolution <= 30, 5)
        .otherwise(4)
    )
    known = F.when(grid == "isea4h", hexagon).when(grid == "mgrs", square).otherwise(plain)
    pairs = [F.lit(v) for item in DEFAULT_LEVELS.items() for v in item]
    unknown = F.coalesce(F.element_at(F.create_map(*pairs), grid), F.lit(OTHER_DEFAULT_LEVEL))
    return F.when(resolution.isNull() | (resolution <= 0), unknown).otherwise(known)


def resolution_metadata(df: DataFrame, resolution: str = "resolution", crs: str = "crs") -> DataFrame:
    """Add resolution unit, metres and the suggested grid (degrees at most 1 in a geographic system)."""
    r, c = F.col(resolution), F.col(crs)
    named = F.coalesce(F.trim(c) != "", F.lit(False))
    degrees = named & F.upper(F.trim(c)).isin(*GEOGRAPHIC_CRS) & (r <= 1.0)
    return df.withColumns(
        {
            "resolution_unit": F.when(r.isNotNull(), F.when(degrees, "degree").otherwise("m")),
            "resolution_m": F.when(degrees, r * METERS_PER_DEGREE).otherwise(r),
            "suggested_grid_type": F.when(
                r.isNotNull(), F.when(degrees, "geohash").when(named, "mgrs").otherwise("geohash")
            ),
        }
    )


def partition_method(grid: Column, requested: Column | None = None) -> Column:
    """``entity`` for hexagons, else ``logical``; a different request is an error."""
    derived = F.when(grid == "isea4h", "entity").otherwise("logical")
    if requested is None:
        return derived
    wanted = F.nullif(F.lower(F.trim(F.coalesce(requested, F.lit("")))), F.lit(""))
    return F.when(wanted.isNull() | (wanted == derived), derived).otherwise(
        F.raise_error(F.concat(F.lit("grid requires partition method "), derived))
    )
