"""Ids of outputs in contract order and the backfill of band-unit status."""

import hashlib
import json
from datetime import datetime

import pytest

from gridloom.functions import identity
from gridloom.operators import lifecycle
from gridloom.operators import partitioning as P

FIELDS = ["dataset_id", "output_version", "source_asset_id", "band_code", "grid_type", "grid_level", "space_code", "topology_code", "time_bucket", "window_identity"]
ROWS = [
    ("dataset-a", "v1", "asset-a", "B04", "mgrs", 2, "50QKK1234", "mgrs-topo-v1:utm-50n:2:50QKK1234", "20260701", "0:0:512:512"),
    ("dataset-a", "v1", "asset-a", "B04", "mgrs", 1, "50QKK1234", "mgrs-topo-v1:utm-50n:2:50QKK1234", "20260701", "0:0:512:512"),
    ("dataset-a", "v1", "asset-a", "B04", "mgrs", 2, "50QKK1234", None, "20260701", "512:0:512:512"),
    ('quo"te\\', "v/1", "é\n", "_cell", "geohash", 12, "ezs42", None, "_", "cell"),
]


def test_output_ids_are_hashes_of_json_in_contract_order(spark):
    df = spark.createDataFrame(ROWS, ", ".join(f"{f} {'int' if f == 'grid_level' else 'string'}" for f in FIELDS))
    got = [r.id for r in df.select(identity.output_id().alias("id")).collect()]
    want = [hashlib.sha256(json.dumps(dict(zip(FIELDS, r)), separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() for r in ROWS]
    assert got == want and len(set(got)) == len(ROWS)
    with pytest.raises(ValueError):
        identity.output_id(window="w")


def test_windows_of_a_cell_have_ids_of_their_own(spark):
    rows = [("d", "v", "a", "b1", "geohash", 3, "ezs", "20240101", w) for w in ("0,0", "8,0")] + [("d", "v", "a", "b1", "isea4h", 3, "7", "20240101", "0,0")]
    t = spark.createDataFrame(rows, "dataset_id string, output_version string, source_asset_id string, band string, grid_type string, grid_level int, space_code string, time_bucket string, win string")
    from pyspark.sql import functions as F

    tiles, indexes, cells = P.build_outputs(t, window=F.col("win"))
    ids = {r.output_id for r in tiles.collect()}
    assert len(ids) == 3 and {r.output_id for r in indexes.collect()} == {i + "-index" for i in ids}
    assert [r.tile_output_id is None for r in indexes.orderBy("grid_type").collect()] == [True, True, False]
    assert {(r.grid_type, r.tile_count) for r in cells.collect()} == {("geohash", 2), ("isea4h", 1)}


def day(n):
    return datetime(2024, 1, n)


def test_backfill(spark):
    config = lambda **c: json.dumps(c)
    runs = [
        ("r1", "s1", "d", "completed", config(grid_type="geohash", requested_grid_level=4, band_unit_ids=["u1", "", "u2"]), "v1", 2, None, day(2)),
        ("r0", "s1", "d", "failed", config(grid_type="geohash", requested_grid_level=5, band_unit_ids=["u2"]), None, None, "broken", day(1)),
        ("r2", "s2", "d", "queued", None, "v2", 1, None, day(3)),
        ("r3", "s3", "d", "queued", config(grid_type="geohash"), None, 1, None, day(3)),
        ("r4", "s3", "d", "queued", config(grid_type="quadtree", requested_grid_level=1), "v1", 1, None, day(3)),
    ]
    runs = spark.createDataFrame(runs, "partition_run_id string, scene_id string, dataset_id string, status string, grid_config string, output_version string, attempt_count int, error_message string, created_at timestamp")
    versions = spark.createDataFrame([("d", "v2", "isea4h", 6)], "dataset_id string, output_version string, grid_type string, requested_grid_level int")
    bands = spark.createDataFrame([("s2", "u3"), ("s2", None), ("s1", "u9")], "scene_id string, band_unit_id string")
    quality = spark.createDataFrame([("d", "v1", day(1), day(1), "fail"), ("d", "v1", day(2), day(1), "pass"), ("d", "v1", None, day(9), "running"), ("d", "v2", None, day(9), "running")], "dataset_id string, output_version string, completed_at timestamp, created_at timestamp, status string")
    ingest = spark.createDataFrame([("s1", "v1", '["u1"]', day(1), "failed"), ("s1", "v1", '["u1","u2"]', day(2), "completed")], "scene_id string, output_version string, band_unit_ids string, updated_at timestamp, status string")
    status = spark.createDataFrame([("u1", "mgrs", 2, "kept")], "band_unit_id string, grid_type string, grid_level int, partition_status string")
    rows, rejects = lifecycle.backfill_status(runs, versions, bands, quality, ingest, status)
    got = {(r.band_unit_id, r.grid_type, r.grid_level, r.partition_run_id, r.partition_status, r.quality_status, r.ingest_status, r.attempt_no, r.error_message) for r in rows.collect()}
    assert got == {
        ("u1", "mgrs", 2, None, "kept", None, None, None, None),
        ("u1", "geohash", 4, "r1", "completed", "pass", "completed", 2, None),
        ("u2", "geohash", 5, "r0", "failed", "pending", "pending", 0, "broken"),  # the earliest run of the unit on the grid
        ("u3", "isea4h", 6, "r2", "queued", "running", "pending", 1, None),
    }
    assert {r.partition_run_id for r in rejects.collect()} == {"r3", "r4"}
    again, _ = lifecycle.backfill_status(runs, versions, bands, quality, ingest, rows)
    assert again.count() == len(got)
