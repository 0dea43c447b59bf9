"""Work and plans that must not grow faster than their tables."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import quality as Q
from gridloom.plans import load_all, rules

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j18_rule_status", "j19_run_status", "e33_assert_totals"])
def test_rule_runs_end_in_small_plans(spark, name):
    plan = plan_of(load_all().QUERIES[name](spark, SMALL))
    assert plan.count("FileScan parquet") <= 4 and plan.count("Exchange") <= 10


def test_staged_counts_are_the_counts_of_one_plan(spark):
    t = rules.tables(spark, SMALL)
    codes = ["index_schema", "output_reference_integrity", "time_bucket_consistency", "asset_crs"]
    counts = Q.staged_counts(t, codes)
    want = Q.count_findings(Q.evaluate(t, codes))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want.collect())) and counts.count() > 50


def test_parts_of_lines_are_numbered_across_their_files(spark, tmp_path):
    from gridloom.sources import loads

    for part, files in {"a": [3, 2], "b": [1, 0, 4]}.items():
        (tmp_path / f"part={part}").mkdir()
        for k, n in enumerate(files):
            (tmp_path / f"part={part}" / f"f{k}").write_text("\n".join([f"{part}{k}{j}" for j in range(n)]) + ("\n" if n else ""))
    whole = F.regexp_extract("file_path", r"(part=\w+)", 1)
    starts = loads.lines_before(spark, str(tmp_path), whole)
    got = loads.numbered_lines(spark, str(tmp_path)).join(starts, "file_path").select("value", (F.col("line_number") + F.col("before")).alias("n"))
    want = {"a00": 1, "a01": 2, "a02": 3, "a10": 4, "a11": 5, "b00": 1, "b20": 2, "b21": 3, "b22": 4, "b23": 5}
    assert dict(map(tuple, got.collect())) == want


def test_overlap_of_boxes_is_tested_once_for_rows_that_share_them(spark):
    from gridloom.operators import partitioning as P

    box = lambda k: (float(k % 3), 0.0, k % 3 + 1.5, 1.0)
    names = "min_lon double, min_lat double, max_lon double, max_lat double"
    a = spark.createDataFrame([(f"a{k}", *box(k)) for k in range(30)], f"a_id string, {names}")
    b = spark.createDataFrame([(f"b{k}", *box(k)) for k in range(12)] + [("none", None, None, None, None)], f"b_id string, {names}")
    out = P.bbox_join(a, b, 3, "a_id", "b_id")
    want = sorted((f"a{i}", f"b{j}") for i in range(30) for j in range(12) if abs(i % 3 - j % 3) < 2)
    assert sorted((r.a_id, r.b_id) for r in out.collect()) == want
    # Only distinct boxes are spread over cells: their grouping comes below the cells of both sides.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate") > plan.rindex("Generate") and plan.count("Aggregate") == 2


@pytest.mark.parametrize("name", ["b14_storage_ring_mgrs", "b19_mgrs_neighbors"])
def test_observations_of_one_point_are_located_once(spark, name):
    plan = load_all().QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    lowest = [line for line in plan.splitlines() if "ArrowEvalPython" in line or "Aggregate" in line][-1]
    assert "Aggregate" in lowest and "event_id" not in lowest.split("]")[0]


def test_assets_are_spread_over_all_tasks_before_they_become_cells(spark):
    from gridloom.plans import covers

    assert covers.assets(spark, SMALL).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in ("n5_daily_winner", "e1_latest_wins", "e2_best_quality_wins", "e3_approved_output_wins", "e4_provenance"):
        plan = load_all().QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RepartitionByExpression [asset_id") == 2


def test_tile_codes_meet_each_tile_once(spark):
    from gridloom.operators import catalog

    place = "dataset_id string, output_version string, source_asset_id string, band_code string, grid_type string, grid_level int, space_code string, time_bucket string"
    at = lambda cell, bucket="t": ("D", "v", "a", "b", "g", 3, cell, bucket)
    tiles = [(*at("x"), "T1"), (*at("x"), "T1"), (*at("y"), "T1"), (*at("x"), "T2"), (*at("z"), "T3"), (*at("x", None), "T4"), (*at("x"), None)]
    codes = [
        (*at("x"), "T1", 1, "i1", "own"), (*at("x"), "lost", 3, "i3", "late b"), (*at("x"), "lost", 3, "i2", "late a"),
        (*at("y"), "T2", 9, "i4", "of y"), (*at("z"), "T3", 9, "i6", None), (*at("z"), "lost", 1, "i5", "of z"), (*at("x", None), "T4", 9, "i7", "no time"),
    ]
    t = spark.createDataFrame(tiles, f"{place}, output_id string")
    i = spark.createDataFrame(codes, f"{place}, tile_output_id string, at long, output_id string, st_code string").withColumn("created_at", F.timestamp_seconds("at"))
    out = catalog.tile_st_code(t, i)
    got = sorted(((r.output_id or "", r.space_code, r.st_code) for r in out.collect()), key=str)
    assert got == [("", "x", None), ("T1", "x", "own"), ("T1", "x", "own"), ("T1", "y", "own"), ("T2", "x", "late a"), ("T3", "z", None), ("T4", "x", None)]
    assert out.columns == [*t.columns, "st_code"]
    plan = load_all().QUERIES["d16_tile_st_code"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2


def test_load_documents_are_parsed_once_for_all_their_tables(spark):
    out = load_all().QUERIES["a22_flatten_load"](spark, SMALL)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan.lower() and "to_json" not in plan.lower() and "lineitem" not in plan
    assert {r.part: r.n for r in out.filter("key = 'all'").collect()}.keys() == {"assets", "batches", "bands"}


def test_snapshot_joins_assets_and_bands_before_index_rows(spark):
    from gridloom.operators import catalog

    place = "dataset_id string, output_version string, grid_type string, grid_level int, space_code string"
    cell = lambda d: (d, "v", "g", 3, "x")
    make = spark.createDataFrame
    t = {
        "indexes": make([(*cell("D1"), "A", "b1", "T1", None), (*cell("D1"), "A", "b2", "T2", None), (*cell("D2"), "A", "b1", "T1", None), (*cell("D3"), "A", "b1", "T1", None), (*cell("D1"), "A", "b1", "T1", "y")],
                        f"{place}, source_asset_id string, band_code string, tile_output_id string, topology_code string"),
        "assets": make([("D1", "A", "u1", "c"), ("D2", "A", "u2", "c")], "dataset_id string, source_asset_id string, source_uri string, checksum string"),
        "bands": make([("D1", "A", "b1", "red")], "dataset_id string, source_asset_id string, band_code string, band_name string"),
        "scene_bands": make([("A", "b1", "A:b1", "S"), ("A", "b2", "A:b2", "S")], "asset_id string, band_code string, band_unit_id string, scene_id string"),
        "cells": make([(*cell(f"D{k}"), None, [float(k)]) for k in (1, 2, 3)], f"{place}, topology_code string, bbox array<double>"),
        "tiles": make([("T1", 64, 64, "t")], "output_id string, width int, height int, tile_uri string"),
    }
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = catalog.output_snapshot(t)
        assert plan_of(out).count("Exchange hashpartitioning") <= 9
        got = sorted((r.dataset_id, r.band_code, r.source_uri, r.band_name, r.scene_id, r.width, r.bbox[0]) for r in out.collect())
        one = catalog.output_snapshot(t, dataset="D2").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert got == [("D1", "b1", "u1", "red", "S", 64, 1.0), ("D1", "b2", "u1", None, "S", None, 1.0), ("D2", "b1", "u2", None, "S", 64, 2.0)]
    assert [(r.dataset_id, r.band_name) for r in one] == [("D2", None)]


def test_cells_of_covers_are_not_broadcast(spark):
    # The small table makes all cells look few; they are hundreds for each box.
    plan = plan_of(load_all().QUERIES["c6_mgrs_minimal"](spark, SMALL))
    joins = [line.split("- ")[-1] for line in plan.splitlines() if "Join" in line and "__area" in line]
    assert len(joins) == 2 and all(j.startswith("SortMergeJoin [__area") for j in joins), joins
