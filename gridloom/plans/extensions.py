"""Queries of the SQL functions, and of the batch forms of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import sqlfuncs
from gridloom.operators import grid as G, partitioning as P
from gridloom.plans import duck, views
from gridloom.plans.registry import query

_box = duck.geohash_box("space_code", 4)


@query(
    "m1_sql_functions",
    f"""SELECT source_index, space_code, substr(space_code, 1, 3) AS parent, 'gh:4:' || space_code || ':' || strftime(acq_time, '%Y%m%d') AS st_code, {_box['min_lon']} AS west, {_box['max_lat']} AS north
        FROM ({duck.geohash_cells('obs', 'lon', 'lat', 4)})""",
)
def _(spark, sf_dir):
    o = views.obs(spark, sf_dir)
    sqlfuncs.register(spark)
    o = o.withColumn("space_code", F.expr("grid_cell(lon, lat, 4)"))
    return o.selectExpr(
        "source_index", "space_code", "cell_parent(space_code) AS parent", "st_code('geohash', 4, space_code, acq_time) AS st_code",
        "cell_bbox(space_code).min_lon AS west", "cell_bbox(space_code).max_lat AS north",
    )


@query("m2_lateral_cover", f"SELECT scene_id, space_code FROM ({duck.geohash_cover('scenes', 3)})")
def _(spark, sf_dir):
    s = views.scenes(spark, sf_dir)
    sqlfuncs.register(spark)
    return spark.sql("SELECT scene_id, c.space_code FROM {s}, LATERAL grid_cover(min_lon, min_lat, max_lon, max_lat, 3, 'intersect') c", s=s)


@query(
    "n3_daily_cell_summary",
    f"SELECT space_code, strftime(acq_time, '%Y%m%d') AS time_bucket, count(*) AS n, min(xco2) AS xco2_min, max(xco2) AS xco2_max, round(avg(xco2), 6) AS xco2_avg FROM ({duck.geohash_cells('obs', 'lon', 'lat', 2)}) GROUP BY 1, 2",
)
def _(spark, sf_dir):
    from gridloom.streaming.observations import daily_summary

    rows = P.stamp(G.assign_cells(views.obs(spark, sf_dir), "lon", "lat", "geohash", 2))
    return daily_summary(rows).select("space_code", "time_bucket", "n", "xco2_min", "xco2_max", F.round("xco2_avg", 6).alias("xco2_avg"))


@query(
    "n5_daily_winner",
    f"SELECT space_code, strftime(acq_time, '%Y%m%d') AS time_bucket, band, arg_max(scene_id, (acq_time, scene_id)) AS scene_id FROM (SELECT *, strftime(acq_time, '%Y%m%d') AS d FROM ({duck.geohash_cover('(SELECT s.*, b.band_code AS band FROM scenes s JOIN bands b USING (asset_id))', 2)})) GROUP BY 1, 2, 3",
)
def _(spark, sf_dir):
    from gridloom.plans import covers
    from gridloom.streaming.observations import streaming_winner

    t = P.build_tasks(covers.assets(spark, sf_dir), "geohash", 2).withColumn("asset_path", F.col("asset_id"))
    return streaming_winner(t).select("space_code", "time_bucket", "band", "scene_id")
