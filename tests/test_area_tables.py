"""Tables laid out for reads by area: what reaches the scan, and which rows come back."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import query as Q
from gridloom.operators.grid import assign_cells


def test_code_ranges_cut_where_codes_part():
    codes = ["abc1", "abc2", "abd1", "b1", "b2", "zz"]
    assert Q.code_ranges(codes, 3) == [("abc1", "abd1"), ("b1", "b2"), ("zz", "zz")]
    assert Q.code_ranges(codes, 1) == [("abc1", "zz")] and Q.code_ranges([]) == []
    assert Q.code_ranges(codes, 99) == [(c, c) for c in codes]


@pytest.mark.parametrize(("grid", "level", "prefix"), [("geohash", 4, 1), ("geohash", 5, 2), ("mgrs", 2, 2), ("isea4h", 5, 1)])
def test_area_reads_only_its_folders_and_codes(spark, tmp_path, grid, level, prefix):
    points = spark.range(4000).select("id", ((F.col("id") * 7919 % 36000) / 100 - 180).alias("lon"), ((F.col("id") * 104729 % 16000) / 100 - 80).alias("lat"))
    rows = assign_cells(points, "lon", "lat", grid, level).withColumn("space_code_prefix", F.substring("space_code", 1, prefix))
    path = str(tmp_path / "rows")
    Q.write_area_table(rows, path)
    box = (10.0, -5.0, 24.0, 12.0)
    got = Q.read_area(spark, path, box, grid, level, prefix)
    cells = {r.space_code for r in Q.aoi_cells(spark, box, grid, level).collect()} if Q.cover_bound(box, grid, level) < 50_000 else None
    inside = {r.id for r in points.filter("lon between 10 and 24 and lat between -5 and 12").collect()}
    ids = {r.id for r in got.collect()}
    assert inside and inside <= ids
    if cells is not None:
        assert ids == {r.id for r in rows.collect() if r.space_code in cells}
    plan = got._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "PartitionFilters" in line)
    folders, pushed = scan.split("PartitionFilters: ")[1].split("]")[0], scan.split("PushedFilters: ")[1].split("]")[0]
    assert "space_code_prefix" in folders and "grid_level" in folders and "space_code" in pushed
    read, there = got.select(F.input_file_name()).distinct().count(), rows.select("space_code_prefix").distinct().count()
    assert read < there or there < 10


def test_prefixes_that_look_like_numbers_stay_text(spark, tmp_path):
    rows = spark.createDataFrame([("geohash", 3, "9e5", "9e5"), ("geohash", 3, "123", "123"), ("geohash", 3, "00d", "00d")], "grid_type string, grid_level int, space_code_prefix string, space_code string")
    Q.write_area_table(rows, str(tmp_path / "t"))
    got = Q.read_area(spark, str(tmp_path / "t"), (-180.0, -90.0, 180.0, 90.0), "geohash", 3)
    assert {(r.space_code_prefix, r.space_code) for r in got.collect()} == {(c, c) for c in ("9e5", "123", "00d")}


def test_points_on_the_edge_of_the_area_are_found(spark):
    spots = [(75.0, 10.0), (60.0, 45.0), (60.0, 55.0), (180.0, 10.0), (-180.0, 10.0), (75.0, 56.0)]
    for grid, level, box in (("mgrs", 0, (-30.0, -20.0, 75.0, 55.0)), ("geohash", 2, (-20.0, -10.0, 60.0, 45.0)), ("geohash", 2, (100.0, 0.0, 180.0, 20.0))):
        points = assign_cells(spark.createDataFrame(spots, "center_lon double, center_lat double"), "center_lon", "center_lat", grid, level)
        got = {(r.center_lon, r.center_lat) for r in Q.query_observations(points, box, grid=grid, level=level).collect()}
        assert got == {p for p in spots if box[0] <= p[0] <= box[2] and box[1] <= p[1] <= box[3]}, (grid, box)
