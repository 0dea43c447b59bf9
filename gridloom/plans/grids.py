"""Queries of grid assignment, geometry, topology and ST codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import isea4h, mgrs, shapes
from gridloom.functions import timecode as T
from gridloom.operators import grid as G
from gridloom.operators import partitioning as P
from gridloom.plans import duck, views
from gridloom.plans.registry import query

# --- assignment ------------------------------------------------------------


def _assign(grid, level):
    def run(spark, sf_dir):
        cells = G.assign_cells(views.obs(spark, sf_dir), "lon", "lat", grid, level)
        return cells.select("source_index", "grid_type", F.col("grid_level").cast("long").alias("grid_level"), "space_code")

    return run


for _level in (1, 5, 9, 12):
    query(
        f"b1_geohash_assign_l{_level}",
        f"SELECT source_index, 'geohash' AS grid_type, {_level} AS grid_level, space_code FROM ({duck.geohash_cells('obs', 'lon', 'lat', _level)})",
    )(_assign("geohash", _level))
for _level in (0, 3, 5):
    query(
        f"b2_mgrs_assign_p{_level}",
        f"SELECT source_index, 'mgrs' AS grid_type, {_level} AS grid_level, space_code FROM ({duck.mgrs_cells('obs', 'lon', 'lat', _level)})",
    )(_assign("mgrs", _level))
for _level in (0, 3, 6, 10):
    query(
        f"b4_isea4h_assign_r{_level}",
        f"SELECT source_index, 'isea4h' AS grid_type, {_level} AS grid_level, space_code FROM ({duck.isea4h_cells('obs', 'lon', 'lat', _level)})",
    )(_assign("isea4h", _level))

# --- domains, numbering, guards --------------------------------------------


@query(
    "b3_utm_domain",
    f"""SELECT source_index, CASE WHEN polar THEN 'ups' ELSE 'utm' END AS domain_kind,
               CASE WHEN polar THEN NULL ELSE zone END AS zone, hemi AS hemisphere,
               CASE WHEN polar THEN 'ups-' || hemi ELSE 'utm-' || zone || hemi END AS domain,
               CASE WHEN lat >= 84 THEN 32661 WHEN lat <= -80 THEN 32761 WHEN lat >= 0 THEN 32600 + zone ELSE 32700 + zone END AS epsg
        FROM (SELECT *, {duck.utm_zone('lon', 'lat')} AS zone, CASE WHEN lat >= 0 THEN 'n' ELSE 's' END AS hemi,
                     lat >= 84 OR lat <= -80 AS polar FROM obs)""",
)
def _(spark, sf_dir):
    out = G.utm_domain(views.obs(spark, sf_dir))
    return out.select("source_index", "domain_kind", "zone", "hemisphere", "domain", "epsg")


def _hex_cells(spark, sf_dir, level):
    return G.assign_cells(views.obs(spark, sf_dir), "lon", "lat", "isea4h", level).select("source_index", "space_code")


_HEX = 5
_hq, _hi, _hj = duck.isea4h_triple("CAST(space_code AS BIGINT)", _HEX)


@query(
    "b5_isea4h_numbering",
    f"""SELECT source_index, {_hq} AS quad, {_hi} AS i, {_hj} AS j, CAST(space_code AS BIGINT) AS again,
               CAST(space_code AS BIGINT) BETWEEN 1 AND {10 * 4**_HEX + 2} AS valid
        FROM ({duck.isea4h_cells('obs', 'lon', 'lat', _HEX)})""",
)
def _(spark, sf_dir):
    seq = F.col("space_code").cast("long")
    quad, i, j = isea4h.triple(seq, _HEX)
    out = _hex_cells(spark, sf_dir, _HEX).withColumns({"quad": quad, "i": i, "j": j, "valid": isea4h.is_valid(seq, _HEX)})
    return out.select(
        "source_index", F.col("quad").cast("long").alias("quad"), "i", "j",
        isea4h.seqnum(F.col("quad"), F.col("i"), F.col("j"), _HEX).alias("again"), "valid",
    )


@query(
    "b6_batch_locate_three_grids",
    f"""SELECT source_index, 'geohash' AS grid_type, space_code FROM ({duck.geohash_cells('obs', 'lon', 'lat', 4)})
        UNION ALL SELECT source_index, 'mgrs', space_code FROM ({duck.mgrs_cells('obs', 'lon', 'lat', 1)})
        UNION ALL SELECT source_index, 'isea4h', space_code FROM ({duck.isea4h_cells('obs', 'lon', 'lat', 6)})""",
)
def _(spark, sf_dir):
    points = views.obs(spark, sf_dir).select("source_index", "lon", "lat")
    parts = [
        G.assign_cells(points, "lon", "lat", grid, level).select("source_index", "grid_type", "space_code")
        for grid, level in G.DEFAULT_LEVELS.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_SHIFTED = "SELECT source_index, lon * 1.2 AS lon, lat * 1.2 AS lat FROM obs"


@query(
    "b7_point_guard_rejects",
    "SELECT source_index, lon, lat FROM (SELECT source_index, lon * CAST(1.2 AS DOUBLE) AS lon, lat * CAST(1.2 AS DOUBLE) AS lat FROM obs) "
    "WHERE NOT (lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90)",
)
def _(spark, sf_dir):
    points = views.obs(spark, sf_dir).select("source_index", (F.col("lon") * 1.2).alias("lon"), (F.col("lat") * 1.2).alias("lat"))
    return G.assign_cells(points, "lon", "lat", "geohash", 3, on_error="reject")[1]


@query(
    "b7_point_guard_nulls",
    f"""SELECT source_index, CASE WHEN ok THEN space_code END AS space_code FROM (
          {duck.geohash_cells('''(SELECT source_index, ok, CASE WHEN ok THEN lon ELSE 0 END AS lon, CASE WHEN ok THEN lat ELSE 0 END AS lat FROM
          (SELECT *, lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AS ok FROM
          (SELECT source_index, lon * CAST(1.2 AS DOUBLE) AS lon, lat * CAST(1.2 AS DOUBLE) AS lat FROM obs)))''', 'lon', 'lat', 3)})""",
)
def _(spark, sf_dir):
    points = views.obs(spark, sf_dir).select("source_index", (F.col("lon") * 1.2).alias("lon"), (F.col("lat") * 1.2).alias("lat"))
    return G.assign_cells(points, "lon", "lat", "geohash", 3, on_error="null").select("source_index", "space_code")


# --- geometry --------------------------------------------------------------

_box = duck.geohash_box("space_code", 5)


@query(
    "b8_geohash_geometry",
    f"""SELECT space_code, min_lon, min_lat, max_lon, max_lat, (min_lon + max_lon) * 0.5 AS center_lon,
               (min_lat + max_lat) * 0.5 AS center_lat, 5 AS ring_points, (max_lon - min_lon) * (max_lat - min_lat) AS area
        FROM (SELECT space_code, {', '.join(f'{v} AS {k}' for k, v in _box.items())}
              FROM (SELECT DISTINCT space_code FROM ({duck.geohash_cells('obs', 'lon', 'lat', 5)})))""",
)
def _(spark, sf_dir):
    cells = G.assign_cells(views.obs(spark, sf_dir), "lon", "lat", "geohash", 5)
    out = G.distinct_cell_geometry(cells, "geohash", 5)
    return out.select(
        "space_code", "min_lon", "min_lat", "max_lon", "max_lat", "center_lon", "center_lat",
        F.size("ring").cast("long").alias("ring_points"),
        ((F.col("max_lon") - F.col("min_lon")) * (F.col("max_lat") - F.col("min_lat"))).alias("area"),
    )


def _geometry(grid, level):
    def run(spark, sf_dir):
        cells = G.assign_cells(views.obs(spark, sf_dir), "lon", "lat", grid, level)
        out = G.distinct_cell_geometry(cells, grid, level)
        numbers = ("min_lon", "min_lat", "max_lon", "max_lat", "center_lon", "center_lat")
        return out.select("space_code", *[F.round(c, 9).alias(c) for c in numbers], F.size("ring").alias("ring_points"))

    return run


query("b9_mgrs_geometry")(_geometry("mgrs", 1))
query("b11_isea4h_geometry")(_geometry("isea4h", 5))


def _own_cell(grid, level):
    """Points outside their own cell's ring, and cells whose centre lies in another cell."""

    def run(spark, sf_dir):
        points = G.assign_cells(views.obs(spark, sf_dir), "lon", "lat", grid, level)
        points = points.select("source_index", "lon", "lat", "grid_type", "grid_level", "space_code")
        cells = G.distinct_cell_geometry(points, grid, level).withColumnRenamed("space_code", "cell")
        again = G.assign_cells(cells.select("cell", "center_lon", "center_lat"), "center_lon", "center_lat", grid, level)
        wrong = again.agg(F.lit("centres_outside").alias("measure"), F.count_if(F.col("cell") != F.col("space_code")).alias("n"))
        joined = points.join(cells, points.space_code == cells.cell)
        # Sides of squares are not quite great circles: a hundredth of the cell's radius.
        if grid == "isea4h":
            # Points of a cell side by side, so that its sides are drawn once for many.
            joined = joined.drop("ring").repartition("cell").sortWithinPartitions("cell")
            beyond = shapes.beyond_hexagon(F.col("lon"), F.col("lat"), *isea4h.triple(F.col("cell").cast("long"), level), level)
        else:
            beyond = shapes.beyond_ring(*[F.col(c) for c in ("lon", "lat", "center_lon", "center_lat", "ring")])
        out = joined.select(beyond.alias("beyond")).agg(F.lit("points_outside").alias("measure"), F.count_if(F.coalesce(F.col("beyond") > 0.01, F.lit(True))).alias("n"))
        return out.unionByName(joined.agg(F.lit("points").alias("measure"), F.count("*").alias("n"))).unionByName(wrong)

    return run


_NONE_OUTSIDE = (
    "SELECT 'points' AS measure, count(*) AS n FROM events UNION ALL SELECT 'points_outside', 0 UNION ALL SELECT 'centres_outside', 0"
)
query("b9_mgrs_point_in_cell", _NONE_OUTSIDE)(_own_cell("mgrs", 2))
query("b11_isea4h_point_in_cell", _NONE_OUTSIDE)(_own_cell("isea4h", 6))


@query(
    "b10_utm_domain_bounds",
    f"""SELECT CASE WHEN lat >= 84 THEN 'ups-n' WHEN lat <= -80 THEN 'ups-s'
                  ELSE 'utm-' || {duck.utm_zone('lon', 'lat')} || CASE WHEN lat >= 0 THEN 'n' ELSE 's' END END AS domain,
               count(*) AS n, count(*) AS inside FROM obs GROUP BY 1""",
)
def _(spark, sf_dir):
    points = G.utm_domain(views.obs(spark, sf_dir))
    letter = F.when(F.col("domain_kind") == "utm", mgrs.letter(mgrs.BANDS, mgrs.band_index(F.col("lat"))))
    points = points.withColumn("band", letter)
    bounds = G.utm_domain_bounds(spark).drop("zone")
    # At most 1,200 boxes: zones by bands, and the two polar areas.
    b = F.broadcast(bounds.withColumnsRenamed({"domain": "d", "band": "b"}))
    joined = points.join(b, (F.col("domain") == F.col("d")) & F.col("band").eqNullSafe(F.col("b")))
    inside = F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))
    return joined.groupBy("domain").agg(F.count("*").alias("n"), F.count_if(inside).alias("inside"))


@query("b12_antimeridian_pieces")
def _(spark, sf_dir):
    cells = G.assign_cells(views.obs(spark, sf_dir), "lon", "lat", "isea4h", 4)
    pieces = G.wgs84_pieces(G.distinct_cell_geometry(cells, "isea4h", 4))
    return pieces.select(
        "space_code", "piece_no", (F.col("min_lon") > F.col("max_lon")).alias("wraps"),
        F.round(shapes.shoelace(F.col("piece")), 9).alias("area"),
    )


@query(
    "b13_distinct_cells",
    f"SELECT DISTINCT 'geohash:3:' || space_code AS cell_key FROM ({duck.geohash_cells('obs', 'lon', 'lat', 3)})",
)
def _(spark, sf_dir):
    cells = G.distinct_cell_geometry(G.assign_cells(views.obs(spark, sf_dir), "lon", "lat", "geohash", 3), "geohash", 3)
    return cells.select(F.concat_ws(":", "grid_type", F.col("grid_level").cast("string"), "space_code").alias("cell_key"))


_box4 = duck.geohash_box("space_code", 4)


@query(
    "b14_storage_ring_geohash",
    f"""SELECT space_code, 5 AS points, true AS ring_valid, round(({_box4['max_lon']} - ({_box4['min_lon']})) * ({_box4['max_lat']} - ({_box4['min_lat']})), 6) AS area
        FROM (SELECT DISTINCT space_code FROM ({duck.geohash_cells('obs', 'lon', 'lat', 4)}))""",
)
def _(spark, sf_dir):
    cells = G.distinct_cell_geometry(G.assign_cells(views.obs(spark, sf_dir), "lon", "lat", "geohash", 4), "geohash", 4)
    out = G.storage_ring(cells, "geohash")
    return out.select(
        "space_code", F.size("storage_ring").cast("long").alias("points"), "ring_valid",
        F.round(shapes.shoelace(F.col("storage_ring")), 6).alias("area"),
    )


def points(spark, sf_dir):
    """Distinct points of the observations: each is located once, however often it was observed."""
    return views.obs(spark, sf_dir).select("lon", "lat").distinct()


def _storage(grid, level):
    def run(spark, sf_dir):
        cells = G.distinct_cell_geometry(G.assign_cells(points(spark, sf_dir), "lon", "lat", grid, level), grid, level)
        out = G.storage_ring(cells, grid)
        return out.groupBy("grid_type", F.size("storage_ring").alias("points"), "ring_valid").agg(F.count("*").alias("n"))

    return run


query("b14_storage_ring_mgrs")(_storage("mgrs", 2))
query("b14_storage_ring_isea4h")(_storage("isea4h", 5))


@query(
    "b15_backfill_geometry",
    "SELECT count(*) AS rows, 0 AS missing, 0 AS not_closed, 0 AS out_of_range, 5 AS min_points, 5 AS max_points FROM obs",
)
def _(spark, sf_dir):
    cells = G.assign_cells(views.obs(spark, sf_dir), "lon", "lat", "geohash", 3)
    drawn = G.cell_geometry(cells.select("source_index", "grid_type", "grid_level", "space_code"), "geohash", 3)
    # Two rows of three have lost their ring.
    holed = drawn.withColumn("cell_ring", F.when(F.col("source_index") % 3 == 0, F.col("ring"))).drop("ring")
    return G.geometry_report(G.backfill_geometry(holed, "geohash", 3))


_WRAPPED = """SELECT scene_id, min_lon, min_lat, CASE WHEN max_lon > 0 AND min_lon > 100 THEN max_lon - 300 ELSE max_lon END AS max_lon, max_lat FROM scenes"""


@query(
    "b16_bbox_rings",
    f"""WITH w AS ({_WRAPPED})
        SELECT scene_id, 0 AS part_no, min_lon, CASE WHEN min_lon > max_lon THEN 180.0 ELSE max_lon END AS max_lon, min_lat, max_lat FROM w
        UNION ALL SELECT scene_id, 1, -180.0, max_lon, min_lat, max_lat FROM w WHERE min_lon > max_lon""",
)
def _(spark, sf_dir):
    s = views.scenes(spark, sf_dir)
    far = (F.col("max_lon") > 0) & (F.col("min_lon") > 100)
    boxes = s.select("scene_id", "min_lon", "min_lat", F.when(far, F.col("max_lon") - 300.0).otherwise(F.col("max_lon")).alias("max_lon"), "max_lat")
    return G.bbox_rings(boxes).select("scene_id", F.col("part_no").cast("long").alias("part_no"), "min_lon", "max_lon", "min_lat", "max_lat")


# --- topology --------------------------------------------------------------


def _distinct(spark, sf_dir, grid, level):
    # Geohash codes are plain columns, cheaper than the shuffle that finds distinct points.
    rows = views.obs(spark, sf_dir) if grid == "geohash" else points(spark, sf_dir)
    return G.assign_cells(rows, "lon", "lat", grid, level).select("space_code").distinct()


def _distinct_sql(grid, level):
    make = {"geohash": duck.geohash_cells, "mgrs": duck.mgrs_cells, "isea4h": duck.isea4h_cells}[grid]
    return f"(SELECT DISTINCT space_code FROM ({make('obs', 'lon', 'lat', level)}))"


@query("b17_geohash_parent", f"SELECT space_code, substr(space_code, 1, 3) AS parent_code FROM {_distinct_sql('geohash', 5)}")
def _(spark, sf_dir):
    return G.parent_cells(_distinct(spark, sf_dir, "geohash", 5), "geohash", 5, 2).select("space_code", "parent_code")


@query("b17_mgrs_parent", f"SELECT space_code, {duck.mgrs_parent('space_code')} AS parent_code FROM {_distinct_sql('mgrs', 3)}")
def _(spark, sf_dir):
    return G.parent_cells(_distinct(spark, sf_dir, "mgrs", 3), "mgrs", 3).select("space_code", "parent_code")


_q5, _i5, _j5 = duck.isea4h_triple("seq", 5)
_pi = "(CASE WHEN 2 * i >= j THEN (i + 1) // 2 ELSE (j + 1) // 2 - (j - i + 1) // 2 END)"
_pj = "((j + 1) // 2)"


@query(
    "b17_isea4h_parent",
    f"""SELECT CAST(seq AS VARCHAR) AS space_code,
               CAST(CASE WHEN q = 0 THEN 1 WHEN q = 11 THEN {10 * 4**4 + 2} ELSE {duck.isea4h_folded('q', _pi, _pj, 4)} END AS VARCHAR) AS parent_code
        FROM (SELECT seq, {_q5} AS q, {_i5} AS i, {_j5} AS j FROM
             (SELECT CAST(space_code AS BIGINT) AS seq FROM {_distinct_sql('isea4h', 5)}))""",
)
def _(spark, sf_dir):
    return G.parent_cells(_distinct(spark, sf_dir, "isea4h", 5), "isea4h", 5).select("space_code", "parent_code")


@query(
    "b18_geohash_children",
    f"""SELECT space_code, space_code || substr('{duck.ALPHABET}', CAST(k AS BIGINT), 1) AS child_code
        FROM {_distinct_sql('geohash', 3)}, range(1, 33) t(k)""",
)
def _(spark, sf_dir):
    return G.child_cells(_distinct(spark, sf_dir, "geohash", 3), "geohash", 3, 4).select("space_code", "child_code")


@query("b18_mgrs_children")
def _(spark, sf_dir):
    kids = G.child_cells(_distinct(spark, sf_dir, "mgrs", 0), "mgrs", 0, 1)
    return kids.groupBy("space_code").agg(F.count("*").alias("children"), F.min("child_code").alias("first"), F.max("child_code").alias("last"))


@query(
    "b18_isea4h_children",
    f"""WITH c AS (SELECT CAST(space_code AS BIGINT) AS parent FROM {_distinct_sql('isea4h', 4)}),
        m AS (SELECT parent, CASE WHEN parent = 1 THEN 1 WHEN parent = {10 * 4**4 + 2} THEN {10 * 4**5 + 2}
                ELSE 2 + (q - 1) * {4**5} + 2 * i * 32 + 2 * j END AS seq FROM
             (SELECT parent, {duck.isea4h_triple('parent', 4)[0]} AS q, {duck.isea4h_triple('parent', 4)[1]} AS i, {duck.isea4h_triple('parent', 4)[2]} AS j FROM c))
        SELECT CAST(parent AS VARCHAR) AS space_code, CAST(seq AS VARCHAR) AS child_code FROM m
        UNION ALL SELECT CAST(parent AS VARCHAR), CAST(number AS VARCHAR) FROM ({duck.isea4h_around('m', 5, 'parent')})""",
)
def _(spark, sf_dir):
    return G.child_cells(_distinct(spark, sf_dir, "isea4h", 4), "isea4h", 4, 5).select("space_code", "child_code")


def _ring_sql(level, k):
    from gridloom.functions import geohash as gh

    nx, ny = gh.columns_at(level), gh.rows_at(level)
    x, y = duck.geohash_index("lon", "lat", level)
    return f"""
        WITH c AS (SELECT DISTINCT {x} AS gx, {y} AS gy FROM obs),
        r AS (SELECT DISTINCT gx AS ox, gy AS oy, (gx + dx + {nx}) % {nx} AS gx, greatest(least(gy + dy, {ny - 1}), 0) AS gy
              FROM c, range({-k}, {k + 1}) a(dx), range({-k}, {k + 1}) b(dy))
        SELECT {duck.geohash_code('ox', 'oy', level)} AS space_code, {duck.geohash_code('gx', 'gy', level)} AS neighbor_code
        FROM r WHERE NOT (gx = ox AND gy = oy)"""


def _ring(grid, level, k):
    def run(spark, sf_dir):
        return G.neighbor_cells(_distinct(spark, sf_dir, grid, level), grid, level, k).select("space_code", "neighbor_code")

    return run


query("b19_geohash_neighbors", _ring_sql(4, 1))(_ring("geohash", 4, 1))
query("b20_geohash_two_ring", _ring_sql(3, 2))(_ring("geohash", 3, 2))
query(
    "b19_isea4h_neighbors",
    f"""WITH c AS (SELECT CAST(space_code AS BIGINT) AS seq FROM {_distinct_sql('isea4h', 5)})
        SELECT CAST(seq AS VARCHAR) AS space_code, CAST(number AS VARCHAR) AS neighbor_code FROM ({duck.isea4h_around('c', 5, 'seq')})""",
)(_ring("isea4h", 5, 1))
query(
    "b20_isea4h_two_ring",
    f"""WITH c AS (SELECT CAST(space_code AS BIGINT) AS seq FROM {_distinct_sql('isea4h', 4)}),
        one AS (SELECT * FROM ({duck.isea4h_around('c', 4, 'seq')})),
        again AS (SELECT seq AS origin, number AS seq FROM one),
        two AS (SELECT origin, number FROM ({duck.isea4h_around('again', 4, 'origin')}))
        SELECT DISTINCT CAST(a AS VARCHAR) AS space_code, CAST(b AS VARCHAR) AS neighbor_code
        FROM (SELECT seq AS a, number AS b FROM one UNION SELECT origin, number FROM two) WHERE a <> b""",
)(_ring("isea4h", 4, 2))
query("b19_mgrs_neighbors")(_ring("mgrs", 0, 1))


@query(
    "b21_rollup_geohash",
    " UNION ALL ".join(
        f"SELECT {lv} AS rollup_level, substr(space_code, 1, {lv}) AS rollup_code, count(*) AS n, round(avg(xco2), 6) AS xco2_avg FROM ({duck.geohash_cells('obs', 'lon', 'lat', 4)}) GROUP BY 2"
        for lv in (1, 2, 3)
    ),
)
def _(spark, sf_dir):
    cells = G.assign_cells(views.obs(spark, sf_dir), "lon", "lat", "geohash", 4)
    aggs = [F.count("*").alias("n"), F.round(F.avg("xco2"), 6).alias("xco2_avg")]
    return G.rollup_cells(cells, [1, 2, 3], aggs).withColumn("rollup_level", F.col("rollup_level").cast("long"))


@query(
    "b21_rollup_mgrs",
    f"SELECT 1 AS rollup_level, {duck.mgrs_parent('space_code')} AS rollup_code, count(*) AS n FROM ({duck.mgrs_cells('obs', 'lon', 'lat', 2)}) GROUP BY 2 "
    f"UNION ALL SELECT 0, p0, count(*) FROM (SELECT {duck.mgrs_parent('p1')} AS p0 FROM (SELECT {duck.mgrs_parent('space_code')} AS p1 FROM ({duck.mgrs_cells('obs', 'lon', 'lat', 2)}))) GROUP BY 2",
)
def _(spark, sf_dir):
    cells = G.assign_cells(views.obs(spark, sf_dir), "lon", "lat", "mgrs", 2)
    return G.rollup_cells(cells, [1, 0], [F.count("*").alias("n")], "mgrs", 2).withColumn("rollup_level", F.col("rollup_level").cast("long"))


# --- defaults --------------------------------------------------------------


@query(
    "b22_default_level",
    """SELECT l_orderkey, l_linenumber, l_quantity AS resolution,
         CASE WHEN l_quantity <= 2 THEN 4 WHEN l_quantity * 30 >= 1000 THEN 2 WHEN l_quantity * 30 >= 500 THEN 3
              WHEN l_quantity * 30 < 10 THEN 6 WHEN l_quantity * 30 <= 30 THEN 5 ELSE 4 END AS geohash_level,
         CASE WHEN l_quantity <= 2 THEN 1 WHEN l_quantity * 30 < 10 THEN 1 ELSE 0 END AS mgrs_level,
         CASE WHEN l_quantity <= 2 THEN 6 WHEN l_quantity * 30 < 10 THEN 12 WHEN l_quantity * 30 <= 30 THEN 11 ELSE 8 END AS isea4h_level
       FROM lineitem""",
)
def _(spark, sf_dir):
    r = F.when(F.col("l_quantity") > 2, F.col("l_quantity") * 30)
    return views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("resolution"),
        *[G.default_level(r, F.lit(g)).cast("long").alias(f"{g}_level") for g in G.GRIDS],
    )


@query(
    "b23_resolution_metadata",
    """SELECT l_orderkey, l_linenumber, r AS resolution, CASE WHEN geo THEN 'degree' ELSE 'm' END AS resolution_unit,
         CASE WHEN geo THEN r * 111320 ELSE r END AS resolution_m,
         CASE WHEN geo THEN 'geohash' WHEN crs <> '' THEN 'mgrs' ELSE 'geohash' END AS suggested_grid_type
       FROM (SELECT *, crs IN ('EPSG:4326') AND r <= 1 AS geo FROM
         (SELECT l_orderkey, l_linenumber, l_quantity / 10 AS r,
            CASE l_returnflag WHEN 'A' THEN 'EPSG:4326' WHEN 'N' THEN 'EPSG:32650' ELSE '' END AS crs FROM lineitem))""",
)
def _(spark, sf_dir):
    crs = F.when(F.col("l_returnflag") == "A", "epsg:4326").when(F.col("l_returnflag") == "N", "EPSG:32650").otherwise("")
    rows = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("resolution"), crs.alias("crs"))
    return G.resolution_metadata(rows).drop("crs")


@query(
    "b24_partition_method",
    "SELECT o_orderkey, g AS grid_type, CASE WHEN g = 'isea4h' THEN 'entity' ELSE 'logical' END AS partition_method FROM "
    "(SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'geohash' WHEN 1 THEN 'mgrs' ELSE 'isea4h' END AS g FROM orders)",
)
def _(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    grid = F.when(k == 0, "geohash").when(k == 1, "mgrs").otherwise("isea4h")
    asked = F.when(F.col("o_orderkey") % 2 == 0, F.when(k == 2, " Entity ").otherwise("logical"))
    rows = views.table(spark, sf_dir, "orders").select("o_orderkey", grid.alias("grid_type"), asked.alias("asked"))
    return rows.withColumn("partition_method", G.partition_method(F.col("grid_type"), F.col("asked"))).drop("asked")


# --- time and ST codes -----------------------------------------------------

for _g in T.TIME_PATTERNS:

    def _bucket(spark, sf_dir, g=_g):
        return views.obs(spark, sf_dir).select("source_index", T.time_bucket("acq_time", g).alias("time_bucket"))

    query(f"k3_time_bucket_{_g}", f"SELECT source_index, {duck.time_bucket('acq_time', _g)} AS time_bucket FROM obs")(_bucket)


@query(
    "k1_st_code",
    f"""SELECT source_index, 'gh:4:' || space_code || ':' || strftime(acq_time, '%Y%m%d%H') AS st_code FROM ({duck.geohash_cells('obs', 'lon', 'lat', 4)})
        UNION ALL SELECT source_index, 'mgrs:1:' || space_code || ':' || strftime(acq_time, '%Y%m%d%H') FROM ({duck.mgrs_cells('obs', 'lon', 'lat', 1)})
        UNION ALL SELECT source_index, 'i4h:6:' || space_code || ':' || strftime(acq_time, '%Y%m%d%H') FROM ({duck.isea4h_cells('obs', 'lon', 'lat', 6)})""",
)
def _(spark, sf_dir):
    points = views.obs(spark, sf_dir).select("source_index", "lon", "lat", "acq_time")
    out = None
    for grid, level in G.DEFAULT_LEVELS.items():
        part = P.stamp(G.assign_cells(points, "lon", "lat", grid, level), "hour").select("source_index", "st_code")
        out = part if out is None else out.unionByName(part)
    return out


_CODES = f"""SELECT source_index, CASE source_index % 5
      WHEN 0 THEN 'gh:4:' || space_code || ':' || strftime(acq_time, '%Y%m%d')
      WHEN 1 THEN 'gh:4:' || space_code || ':' || strftime(acq_time, '%Y%m%d%H%M%S')
      WHEN 2 THEN 'xx:4:' || space_code || ':' || strftime(acq_time, '%Y%m%d')
      WHEN 3 THEN 'gh:4:' || space_code || ':20241399'
      ELSE 'gh:' || space_code || ':' || strftime(acq_time, '%Y%m') END AS code FROM ({duck.geohash_cells('obs', 'lon', 'lat', 4)})"""


def _codes(spark, sf_dir):
    cells = G.assign_cells(views.obs(spark, sf_dir), "lon", "lat", "geohash", 4)
    k, c, t = F.col("source_index") % 5, F.col("space_code"), F.col("acq_time")
    day = T.time_bucket(t, "day")
    code = (
        F.when(k == 0, F.concat(F.lit("gh:4:"), c, F.lit(":"), day))
        .when(k == 1, F.concat(F.lit("gh:4:"), c, F.lit(":"), T.time_bucket(t, "second")))
        .when(k == 2, F.concat(F.lit("xx:4:"), c, F.lit(":"), day))
        .when(k == 3, F.concat(F.lit("gh:4:"), c, F.lit(":20241399")))
        .otherwise(F.concat(F.lit("gh:"), c, F.lit(":"), T.time_bucket(t, "month")))
    )
    return cells.select("source_index", code.alias("st_code"))


@query(
    "k2_parse_st_code",
    f"""SELECT source_index, 'geohash' AS grid_type, 4 AS grid_level, split_part(code, ':', 3) AS space_code,
               split_part(code, ':', 4) AS time_code FROM ({_CODES}) WHERE source_index % 5 IN (0, 1)""",
)
def _(spark, sf_dir):
    good, _rejects = T.parse_st_code(_codes(spark, sf_dir), "st_code")
    return good.select("source_index", "grid_type", F.col("grid_level").cast("long").alias("grid_level"), "space_code", "time_code")


@query("k2_reject_st_code", f"SELECT source_index, code AS st_code, CASE source_index % 5 WHEN 2 THEN 'prefix' WHEN 3 THEN 'time' ELSE 'format' END AS reason FROM ({_CODES}) WHERE source_index % 5 > 1")
def _(spark, sf_dir):
    _good, rejects = T.parse_st_code(_codes(spark, sf_dir), "st_code")
    return rejects.select("source_index", "st_code", "reason")


@query("k4_cell_prefix", f"SELECT substr(space_code, 1, 2) AS space_code_prefix, count(*) AS n FROM ({duck.geohash_cells('obs', 'lon', 'lat', 5)}) GROUP BY 1")
def _(spark, sf_dir):
    cells = G.assign_cells(views.obs(spark, sf_dir), "lon", "lat", "geohash", 5)
    return P.stamp(cells, prefix_length=2).groupBy("space_code_prefix").agg(F.count("*").alias("n"))


@query(
    "k23_grid_level_name",
    "SELECT grid_type, grid_level, grid_type || '-' || grid_level AS grid_level_name, count(*) AS n FROM "
    "(SELECT CASE o_orderkey % 3 WHEN 0 THEN 'geohash' WHEN 1 THEN 'mgrs' ELSE 'isea4h' END AS grid_type, o_orderkey % 6 AS grid_level FROM orders) GROUP BY 1, 2",
)
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    grid = F.when(k % 3 == 0, "geohash").when(k % 3 == 1, "mgrs").otherwise("isea4h")
    rows = views.table(spark, sf_dir, "orders").select(grid.alias("grid_type"), (k % 6).alias("grid_level"))
    return T.with_level_name(rows).groupBy("grid_type", "grid_level", "grid_level_name").agg(F.count("*").alias("n"))
