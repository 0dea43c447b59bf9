"""Queries of covers, tasks, windows and area lookups."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from gridloom.functions import geohash, shapes
from gridloom.operators import cover as C
from gridloom.operators import grid as G
from gridloom.operators import partitioning as P
from gridloom.operators import query as Q
from gridloom.plans import duck, views
from gridloom.plans.flagship import observation_facts
from gridloom.plans.registry import query
from gridloom.session import stage_folder

BOXES = ("scene_id", "min_lon", "min_lat", "max_lon", "max_lat")


def boxes(spark, sf_dir):
    return views.scenes(spark, sf_dir).select(*BOXES)


def _cover(grid, level, mode):
    def run(spark, sf_dir):
        out = C.cover_bbox(boxes(spark, sf_dir), grid, level, mode, ["scene_id"], boundary="none")
        return out.select("scene_id", F.col("grid_level").cast("long").alias("grid_level"), "space_code")

    return run


query("c1_geohash_intersect", f"SELECT scene_id, 3 AS grid_level, space_code FROM ({duck.geohash_cover('scenes', 3)})")(_cover("geohash", 3, "intersect"))
query("c2_geohash_contain", f"SELECT scene_id, 4 AS grid_level, space_code FROM ({duck.geohash_cover('scenes', 4, 'contain')})")(_cover("geohash", 4, "contain"))


def _minimal_sql(level):
    """Replace complete groups of children bottom-up, by counting siblings."""
    w, h = geohash.cell_width, geohash.cell_height
    parts = [f"c{level} AS (SELECT scene_id, gx, gy, min_lon, min_lat, max_lon, max_lat FROM ({duck.geohash_cover('scenes', level)}))"]
    out = []
    for lv in range(level, 1, -1):
        dx, dy = geohash.lon_bits(lv) - geohash.lon_bits(lv - 1), geohash.lat_bits(lv) - geohash.lat_bits(lv - 1)
        parts.append(
            f"c{lv - 1} AS (SELECT scene_id, px AS gx, py AS gy, any_value(min_lon) AS min_lon, any_value(min_lat) AS min_lat, "
            f"any_value(max_lon) AS max_lon, any_value(max_lat) AS max_lat FROM (SELECT *, gx >> {dx} AS px, gy >> {dy} AS py FROM c{lv}) GROUP BY scene_id, px, py "
            f"HAVING count(*) = 32 AND px * CAST({w(lv - 1)!r} AS DOUBLE) - 180 >= any_value(min_lon) AND (px + 1) * CAST({w(lv - 1)!r} AS DOUBLE) - 180 <= any_value(max_lon) "
            f"AND py * CAST({h(lv - 1)!r} AS DOUBLE) - 90 >= any_value(min_lat) AND (py + 1) * CAST({h(lv - 1)!r} AS DOUBLE) - 90 <= any_value(max_lat))"
        )
        out.append(
            f"SELECT scene_id, {lv} AS grid_level, {duck.geohash_code('gx', 'gy', lv)} AS space_code FROM c{lv} a "
            f"WHERE NOT EXISTS (SELECT 1 FROM c{lv - 1} b WHERE b.scene_id = a.scene_id AND b.gx = a.gx >> {dx} AND b.gy = a.gy >> {dy})"
        )
    out.append(f"SELECT scene_id, 1 AS grid_level, {duck.geohash_code('gx', 'gy', 1)} AS space_code FROM c1")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(out)


query("c3_geohash_minimal", _minimal_sql(4))(_cover("geohash", 4, "minimal"))


@query("c4_geohash_polygon_box", f"SELECT scene_id, 3 AS grid_level, space_code FROM ({duck.geohash_cover('scenes', 3)})")
def _(spark, sf_dir):
    rings = G.bbox_rings(boxes(spark, sf_dir)).select("scene_id", "ring")
    out = C.cover_polygon(rings, "geohash", 3, "intersect", ["scene_id"], boundary="none")
    return out.select("scene_id", F.col("grid_level").cast("long").alias("grid_level"), "space_code")


@query("c4_geohash_polygon_triangle")
def _(spark, sf_dir):
    s = boxes(spark, sf_dir)

    def point(x, y):
        return F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))

    a, b, c = point("min_lon", "min_lat"), point("max_lon", "min_lat"), point("min_lon", "max_lat")
    rings = s.select("scene_id", F.array(a, b, c, a).alias("ring"))
    return C.cover_polygon(rings, "geohash", 3, "intersect", ["scene_id"], boundary="none").select("scene_id", "space_code")


def _cover_counts(grid, level, mode):
    """Cells of each scene by level, counted once for all scenes with one box."""

    def run(spark, sf_dir):
        s = boxes(spark, sf_dir)
        areas = s.groupBy(*BOXES[1:]).agg(F.min("scene_id").alias("area"))
        out = C.cover_bbox(areas, grid, level, mode, ["area"], boundary="none")
        counts = out.groupBy("area", F.col("grid_level").cast("long").alias("grid_level")).agg(F.count("*").alias("cells"))
        return s.join(areas, list(BOXES[1:])).join(counts, "area").select("scene_id", "grid_level", "cells")

    return run


query("c5_mgrs_intersect")(_cover("mgrs", 0, "intersect"))
query("c5_mgrs_contain")(_cover("mgrs", 0, "contain"))
query("c6_mgrs_minimal")(_cover_counts("mgrs", 1, "minimal"))
_C7 = "SELECT scene_id, {level} AS grid_level, CAST(seq AS VARCHAR) AS space_code FROM ({pairs}) WHERE {keep}"
_SCENE_BOXES = "SELECT scene_id, min_lon, min_lat, max_lon, max_lat FROM scenes"
query("c7_isea4h_intersect", _C7.format(level=4, pairs=duck.isea4h_box_pairs(_SCENE_BOXES, 4), keep="inside > whole * 1e-12"))(_cover("isea4h", 4, "intersect"))
query("c7_isea4h_contain", _C7.format(level=6, pairs=duck.isea4h_box_pairs(_SCENE_BOXES, 6), keep="inside >= whole * (1 - 1e-9)"))(_cover("isea4h", 6, "contain"))


def _hex_minimal_sql(areas, inside):
    """Level 6 and 7 of the minimal covers of areas of at most three square degrees, which hold no hexagon of level 5.

    ``inside`` turns pairs of areas and hexagons into ones with the area ``inside``.
    """
    side = "(b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)"
    sides = [side.replace("a.", f"big[{k}].").replace("b.", f"big[{k} % len(big) + 1].") for k in (f"(({n} - 1) % len(big) + 1)" for n in range(1, 7))]
    near = """SELECT c.scene_id, c.seq, c.ring, t.ring AS big FROM c JOIN t ON c.scene_id = t.scene_id AND list_max(list_transform(t.ring, lambda p: p.x)) > list_min(list_transform(c.ring, lambda p: p.x))
        AND list_min(list_transform(t.ring, lambda p: p.x)) < list_max(list_transform(c.ring, lambda p: p.x)) AND list_max(list_transform(t.ring, lambda p: p.y)) > list_min(list_transform(c.ring, lambda p: p.y))
        AND list_min(list_transform(t.ring, lambda p: p.y)) < list_max(list_transform(c.ring, lambda p: p.y))"""
    return f"""WITH t AS MATERIALIZED (SELECT scene_id, seq, ring FROM ({inside(duck.isea4h_box_pairs(areas, 6))}) WHERE inside >= whole * (1 - 1e-9)),
      c AS MATERIALIZED (SELECT scene_id, seq, ring, whole, inside FROM ({inside(duck.isea4h_box_pairs(areas, 7))}) WHERE inside > whole * 1e-9),
      l AS (SELECT scene_id, seq, sum(lap) AS lap FROM ({duck.clipped(near, sides, 'lap')}) GROUP BY scene_id, seq)
      SELECT scene_id, 6 AS grid_level, CAST(seq AS VARCHAR) AS space_code FROM t
      UNION ALL SELECT c.scene_id, 7, CAST(c.seq AS VARCHAR) FROM c LEFT JOIN l ON c.scene_id = l.scene_id AND c.seq = l.seq WHERE inside - coalesce(lap, 0) > whole * 1e-9"""


query("c8_isea4h_minimal", _hex_minimal_sql(_SCENE_BOXES, lambda pairs: pairs))(_cover("isea4h", 7, "minimal"))
_HOLE = ("min_lon + 0.9", "min_lat + 0.6", "min_lon + 1.3", "min_lat + 0.9")


def _without_hole(pairs):
    w, s, e, n = (c.replace("+ ", "+ CAST(") + " AS DOUBLE)" for c in _HOLE)
    return f"SELECT * REPLACE (inside - hole AS inside) FROM ({duck.clipped(pairs, [f'p.x - ({w})', f'p.y - ({s})', f'({e}) - p.x', f'({n}) - p.y'], 'hole')})"


@query("c8_isea4h_minimal_polygon", _hex_minimal_sql(_SCENE_BOXES, _without_hole))
def _(spark, sf_dir):
    s = boxes(spark, sf_dir)
    outer = s.select("scene_id", shapes.box_ring(*[F.col(c) for c in C.BOX]).alias("ring"), F.lit(False).alias("is_hole"))
    hole = s.select("scene_id", shapes.box_ring(*[F.expr(c) for c in _HOLE]).alias("ring"), F.lit(True).alias("is_hole"))
    out = C.cover_polygon(outer.unionByName(hole), "isea4h", 7, "minimal", ["scene_id"], boundary="none")
    return out.select("scene_id", F.col("grid_level").cast("long").alias("grid_level"), "space_code")


def _cover_holds_points(grid, level):
    """Observations inside a scene box whose own cell is missing from the box's cover: none.

    Equal boxes and equal points are met once, with how many they are.  Boxes and points meet over
    geohash cells, an equi join.
    """

    def run(spark, sf_dir):
        s = boxes(spark, sf_dir).groupBy(*BOXES[1:]).agg(F.min("scene_id").alias("scene_id"), F.count("*").alias("boxes"))
        cover = C.cover_bbox(s.select(*BOXES), grid, level, "intersect", ["scene_id"], boundary="none", bends=True)
        points = views.obs(spark, sf_dir).groupBy("lon", "lat").agg(F.count("*").alias("points"))
        points = G.assign_cells(points, "lon", "lat", grid, level)
        keyed = points.withColumns({"__x": geohash.column_index(F.col("lon"), 3), "__y": geohash.row_index(F.col("lat"), 3)})
        spread = C.geohash_candidates(s, 3).select(*BOXES, "boxes", "__x", "__y")
        inside = (F.col("lon") > F.col("min_lon")) & (F.col("lon") < F.col("max_lon")) & (F.col("lat") > F.col("min_lat")) & (F.col("lat") < F.col("max_lat"))
        pairs = keyed.join(spread, ["__x", "__y"]).filter(inside).groupBy("scene_id", "space_code").agg(F.sum(F.col("points") * F.col("boxes")).alias("n"))
        held = cover.select("scene_id", "space_code", F.lit(True).alias("held"))
        zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
        total = pairs.join(held, ["scene_id", "space_code"], "left").agg(zero(F.col("n")).alias("pairs"), zero(F.when(F.col("held").isNull(), F.col("n"))).alias("lost"))
        return total.unpivot([], ["pairs", "lost"], "measure", "n")

    return run


_HOLDS = """SELECT 'pairs' AS measure, count(*) AS n FROM obs JOIN scenes ON lon > min_lon AND lon < max_lon AND lat > min_lat AND lat < max_lat
            UNION ALL SELECT 'lost', 0"""
query("c5_mgrs_cover_holds_points", _HOLDS)(_cover_holds_points("mgrs", 0))
query("c7_isea4h_cover_holds_points", _HOLDS)(_cover_holds_points("isea4h", 4))


@query(
    "c9_cover_boundaries",
    f"""SELECT scene_id, space_code, cell_min_lon, cell_min_lat, cell_max_lon, cell_max_lat, 5 AS ring_points
        FROM ({duck.geohash_cover('scenes', 3)})""",
)
def _(spark, sf_dir):
    out = C.cover_bbox(boxes(spark, sf_dir), "geohash", 3, "intersect", ["scene_id"], boundary="polygon")
    return out.select("scene_id", "space_code", *P.CELL_BOX, F.size("cell_ring").cast("long").alias("ring_points"))


_ASSETS = "(SELECT s.*, b.band_code AS band, b.pos AS band_pos FROM scenes s JOIN bands b USING (asset_id))"


def assets(spark, sf_dir):
    """Assets by band: scenes joined to their bands.

    The join keeps all shuffle partitions: its rows are small and would be put together again, but each
    becomes a row per cell, and a task sorts what it has by the keys of those.
    """
    s = views.scenes(spark, sf_dir)
    b = views.bands(spark, sf_dir).select("asset_id", F.col("band_code").alias("band"), F.col("sample_mean"), F.col("pos").alias("band_pos"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return s.repartition(tasks, "asset_id").join(b.repartition(tasks, "asset_id"), "asset_id")


@query("c10_shared_scene_cover", f"SELECT space_code, count(*) AS n, count(DISTINCT scene_id) AS scenes, count(DISTINCT band) AS bands FROM ({duck.geohash_cover(_ASSETS, 2)}) GROUP BY 1")
def _(spark, sf_dir):
    tasks = P.build_tasks(assets(spark, sf_dir), "geohash", 2)
    return tasks.groupBy("space_code").agg(
        F.count("*").alias("n"), F.count_distinct("scene_id").alias("scenes"), F.count_distinct("band").alias("bands")
    )


_OVER = "(SELECT scene_id, min_lat, max_lat, min_lon + 12 AS min_lon, max_lon + 12 AS max_lon FROM scenes WHERE min_lon + 12 > 178 AND min_lon + 12 < 180)"


@query(
    "c11_dateline_cover",
    f"""SELECT DISTINCT scene_id, space_code FROM (
        SELECT scene_id, space_code FROM ({duck.geohash_cover(f'(SELECT scene_id, min_lon, 180.0 AS max_lon, min_lat, max_lat FROM {_OVER})', 3)})
        UNION ALL SELECT scene_id, space_code FROM ({duck.geohash_cover(f'(SELECT scene_id, -180.0 AS min_lon, max_lon - 360 AS max_lon, min_lat, max_lat FROM {_OVER} WHERE max_lon > 180)', 3)}))""",
)
def _(spark, sf_dir):
    s = boxes(spark, sf_dir).withColumns({"min_lon": F.col("min_lon") + 12.0, "max_lon": F.col("max_lon") + 12.0})
    s = s.filter("min_lon > 178 and min_lon < 180")
    wrapped = s.withColumn("max_lon", F.when(F.col("max_lon") > 180, F.col("max_lon") - 360).otherwise(F.col("max_lon")))
    return C.cover_bbox(wrapped, "geohash", 3, "intersect", ["scene_id"], boundary="none").select("scene_id", "space_code")


_FOOT = "(SELECT source_index, lon - 0.4 AS min_lon, lon + 0.4 AS max_lon, lat - 0.3 AS min_lat, lat + 0.3 AS max_lat FROM (SELECT source_index, lon, lat FROM obs) WHERE source_index % 2 = 0 AND abs(lon) < 179)"


@query(
    "c12_footprint_cover",
    f"""SELECT space_code FROM ({duck.geohash_cover(_FOOT, 3)})
        UNION SELECT space_code FROM ({duck.geohash_cells('(SELECT * FROM obs WHERE NOT (source_index % 2 = 0 AND abs(lon) < 179))', 'lon', 'lat', 3)})""",
)
def _(spark, sf_dir):
    o = views.obs(spark, sf_dir)
    polygon = (F.col("source_index") % 2 == 0) & (F.abs("lon") < 179)
    ring = shapes.box_ring(F.col("lon") - 0.4, F.col("lat") - 0.3, F.col("lon") + 0.4, F.col("lat") + 0.3)
    o = o.withColumns({"footprint": F.when(polygon, ring), "observation_id": F.col("source_index")})
    return C.cover_footprints(o, "geohash", 3).select("space_code")


_NOCELL = "(SELECT scene_id, (min_lon + max_lon) * 0.5 AS lon, (min_lat + max_lat) * 0.5 AS lat FROM scenes WHERE scene_id NOT IN (SELECT scene_id FROM inside))"


@query(
    "c13_center_cell",
    f"""WITH inside AS (SELECT scene_id, space_code FROM ({duck.geohash_cover('scenes', 3, 'contain')}))
        SELECT scene_id, space_code FROM inside UNION ALL SELECT scene_id, space_code FROM ({duck.geohash_cells(_NOCELL, 'lon', 'lat', 3)})""",
)
def _(spark, sf_dir):
    s = boxes(spark, sf_dir)
    tasks = C.cover_bbox(s, "geohash", 3, "contain", ["scene_id"], boundary="none")
    return C.ensure_center_cell(tasks, s, "geohash", 3, ["scene_id"]).select("scene_id", "space_code")


# --- tasks, intersections, windows -------------------------------------------

_TASKS = duck.geohash_cover("scenes", 3)
_CUT = f"""SELECT *, greatest(min_lon, cell_min_lon) AS iw, greatest(min_lat, cell_min_lat) AS isx, least(max_lon, cell_max_lon) AS ie, least(max_lat, cell_max_lat) AS inx
           FROM ({_TASKS})"""


def tasks(spark, sf_dir, level=3):
    return P.build_tasks(views.scenes(spark, sf_dir), "geohash", level)


@query("d1_task_table", f"SELECT scene_id, asset_id, space_code, 'geohash' AS grid_type, 3 AS grid_level, 'intersect' AS cover_mode, min_lon, cell_min_lon FROM ({_TASKS})")
def _(spark, sf_dir):
    t = tasks(spark, sf_dir)
    return t.select("scene_id", "asset_id", "space_code", "grid_type", F.col("grid_level").cast("long").alias("grid_level"), "cover_mode", "min_lon", "cell_min_lon")


@query("d2_bbox_intersection", f"SELECT scene_id, space_code, iw AS intersect_min_lon, isx AS intersect_min_lat, ie AS intersect_max_lon, inx AS intersect_max_lat FROM ({_CUT}) WHERE iw < ie AND isx < inx")
def _(spark, sf_dir):
    out = P.intersect_bbox(tasks(spark, sf_dir))
    return out.select("scene_id", "space_code", "intersect_min_lon", "intersect_min_lat", "intersect_max_lon", "intersect_max_lat")


@query(
    "d3_bbox_overlap_join",
    """SELECT a.scene_id AS a_scene, b.scene_id AS b_scene, greatest(a.min_lon, b.min_lon) AS intersect_min_lon
       FROM (SELECT * FROM scenes WHERE status = 'available') a JOIN (SELECT * FROM scenes WHERE status = 'failed') b
       ON a.min_lon < b.max_lon AND b.min_lon < a.max_lon AND a.min_lat < b.max_lat AND b.min_lat < a.max_lat""",
)
def _(spark, sf_dir):
    s = views.scenes(spark, sf_dir)
    a = s.filter("status = 'available'").withColumnRenamed("scene_id", "a_scene")
    b = s.filter("status = 'failed'").withColumnRenamed("scene_id", "b_scene")
    return P.bbox_join(a, b, 3, "a_scene", "b_scene").select("a_scene", "b_scene", "intersect_min_lon")


def with_raster(df):
    """A north-up raster of 40 x 30 pixels that starts half a pixel inside the scene box."""
    return df.withColumns(
        {
            "origin_x": F.col("min_lon") + 0.0625, "origin_y": F.col("max_lat") - 0.0625, "pixel_size": F.lit(0.125),
            "raster_width": F.lit(14), "raster_height": F.lit(10),
        }
    )


def _window_sql(clip):
    x0, x1 = "(iw - (min_lon + 0.0625)) / 0.125", "(ie - (min_lon + 0.0625)) / 0.125"
    y0, y1 = "((max_lat - 0.0625) - inx) / 0.125", "((max_lat - 0.0625) - isx) / 0.125"
    d = lambda s: s.replace("0.0625", "CAST(0.0625 AS DOUBLE)").replace("0.125", "CAST(0.125 AS DOUBLE)")
    x0, x1, y0, y1 = d(x0), d(x1), d(y0), d(y1)
    if clip == "intersection":
        c0, w = f"greatest(floor({x0}), 0)", f"least(ceil({x1}), 14) - greatest(floor({x0}), 0)"
        r0, h = f"greatest(floor({y0}), 0)", f"least(ceil({y1}), 10) - greatest(floor({y0}), 0)"
    else:
        c0 = f"greatest(floor({x0}), 0)"
        w = f"least(14 - greatest(floor({x0}), 0), ceil({x1} - {x0}) - (greatest(floor({x0}), 0) - floor({x0})))"
        r0 = f"greatest(floor({y0}), 0)"
        h = f"least(10 - greatest(floor({y0}), 0), ceil({y1} - {y0}) - (greatest(floor({y0}), 0) - floor({y0})))"
    return f"""SELECT * FROM (SELECT scene_id, asset_id, acq_time, space_code, CAST({c0} AS BIGINT) AS window_col_off, CAST({r0} AS BIGINT) AS window_row_off,
               CAST({w} AS BIGINT) AS window_width, CAST({h} AS BIGINT) AS window_height FROM ({_CUT}) WHERE iw < ie AND isx < inx)
               WHERE window_width > 0 AND window_height > 0"""


WINDOW_COLUMNS = ("window_col_off", "window_row_off", "window_width", "window_height")


def windows(spark, sf_dir, clip="shrink"):
    return P.pixel_window(with_raster(P.intersect_bbox(tasks(spark, sf_dir))), clip=clip)


for _name, _clip in (("d4_pixel_window", "shrink"), ("d5_pixel_window_intersection", "intersection")):

    def _run(spark, sf_dir, clip=_clip):
        return windows(spark, sf_dir, clip).select("scene_id", "space_code", *WINDOW_COLUMNS)

    query(_name, f"SELECT scene_id, space_code, {', '.join(WINDOW_COLUMNS)} FROM ({_window_sql(_clip)})")(_run)


@query(
    "d9_value_reference",
    f"""SELECT scene_id, space_code, 's3://cube/' || asset_id || '#window=' || window_col_off || ',' || window_row_off || ',' || window_width || ',' || window_height AS value_ref_uri,
               's3://cube/' || asset_id AS asset_uri, window_col_off, window_height FROM ({_window_sql('shrink')})""",
)
def _(spark, sf_dir):
    w = windows(spark, sf_dir).withColumn("asset_uri", F.concat(F.lit("s3://cube/"), "asset_id"))
    refs = P.with_value_ref(w).select("scene_id", "space_code", "value_ref_uri")
    return P.parse_value_ref(refs).select("scene_id", "space_code", "value_ref_uri", "asset_uri", "window_col_off", "window_height")


# --- area queries --------------------------------------------------------------


def _area(grid, level, box, limit):
    def run(spark, sf_dir):
        out = Q.query_observations(
            observation_facts(spark, sf_dir, grid, level), box, "20240105", "20240125", ["0", "1"], "xco2", grid, level, limit=limit
        )
        return out.select("source_index", "space_code", "xco2")

    return run


def _area_sql(cells, box, limit):
    w, s, e, n = box
    tail = f" ORDER BY acq_time, observation_id LIMIT {limit}" if limit else ""
    return f"""SELECT source_index, space_code, xco2 FROM (SELECT * FROM ({cells}) WHERE lon BETWEEN {w} AND {e} AND lat BETWEEN {s} AND {n}
        AND quality_flag IN ('0', '1') AND strftime(acq_time, '%Y%m%d') BETWEEN '20240105' AND '20240125'{tail})"""


_WIDE = (-30.0, -20.0, 75.0, 55.0)
query("d6_area_time_query_geohash", _area_sql(duck.geohash_cells("obs", "lon", "lat", 3), _WIDE, None))(_area("geohash", 3, _WIDE, None))
query("d6_area_time_query_isea4h", _area_sql(duck.isea4h_cells("obs", "lon", "lat", 5), _WIDE, None))(_area("isea4h", 5, _WIDE, None))
query("d6_area_time_query_mgrs", _area_sql(duck.mgrs_cells("obs", "lon", "lat", 0), _WIDE, None))(_area("mgrs", 0, _WIDE, None))
def _area_table(grid, level, box, prefix):
    """The observations written as an area table, with folders by so many letters of the code, and read back for one box."""

    def run(spark, sf_dir):
        path = f"{stage_folder(spark)}/area-{uuid4().hex}"
        rows = observation_facts(spark, sf_dir, grid, level).withColumn("space_code_prefix", F.substring("space_code", 1, prefix))
        Q.write_area_table(rows.select(*Q.AREA_LAYOUT, "source_index", "space_code", "xco2", "center_lon", "center_lat"), path)
        w, s, e, n = box
        inside = F.col("center_lon").between(w, e) & F.col("center_lat").between(s, n)
        return Q.read_area(spark, path, box, grid, level, prefix).filter(inside).select("source_index", "space_code", "xco2")

    return run


_NARROW = (12.0, -35.0, 61.0, 18.5)
_IN_BOX = "SELECT source_index, space_code, xco2 FROM ({cells}) WHERE lon BETWEEN 12 AND 61 AND lat BETWEEN -35 AND 18.5"
query("d6_area_table_geohash", _IN_BOX.format(cells=duck.geohash_cells("obs", "lon", "lat", 4)))(_area_table("geohash", 4, _NARROW, 1))
query("d6_area_table_mgrs", _IN_BOX.format(cells=duck.mgrs_cells("obs", "lon", "lat", 1)))(_area_table("mgrs", 1, _NARROW, 2))
query("d6_area_table_isea4h", _IN_BOX.format(cells=duck.isea4h_cells("obs", "lon", "lat", 5)))(_area_table("isea4h", 5, _NARROW, 1))
query("g1_area_query_oldest_first", _area_sql(duck.geohash_cells("obs", "lon", "lat", 3), _WIDE, 200))(_area("geohash", 3, _WIDE, 200))

# The position of observation 1234 in the given tables.
_LON, _LAT = (1234 * 7919) % 36000 / 100.0 - 180.0, (1234 * 104729) % 17800 / 100.0 - 89.0


@query("d7_point_query", f"SELECT source_index, xco2 FROM obs WHERE abs(lon - ({_LON})) <= 1e-5 AND abs(lat - ({_LAT})) <= 1e-5")
def _(spark, sf_dir):
    out = Q.query_observations(observation_facts(spark, sf_dir, "geohash", 5), point=(_LON, _LAT), grid="geohash", level=5, limit=None)
    return out.select("source_index", "xco2")


@query(
    "d8_cell_lookup",
    f"""SELECT space_code, band, asset_id FROM (SELECT * FROM ({duck.geohash_cover(_ASSETS, 3)}) WHERE year(acq_time) = 1997 AND band IN ('b1', 'b2'))
        WHERE cell_max_lon > 0 AND cell_min_lon < 40 AND cell_max_lat > 10 AND cell_min_lat < 35""",
)
def _(spark, sf_dir):
    t = P.stamp(P.build_tasks(assets(spark, sf_dir), "geohash", 3), "year")
    return Q.query_cells(t, (0.0, 10.0, 40.0, 35.0), "1997", ["b1", "b2"], "geohash", 3).select("space_code", "band", "asset_id")
