"""Keyed tables, streams and sessions."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridloom.operators import facts
from gridloom.streaming import observations as S


def rows(spark, data):
    return spark.createDataFrame(data, "k long, day string, grid string, v long")


def content(spark, path):
    return sorted((r.k, r.day, r.grid, r.v) for r in spark.read.parquet(path).select("k", "day", "grid", "v").collect())


def test_row_moves_to_another_partition(spark, tmp_path):
    path = f"{tmp_path}/t"
    facts.upsert_table(spark, path, rows(spark, [(1, "a", "g", 1), (2, "b", "g", 1), (3, "b c/d", "g", 1), (4, None, "g", 1)]), ["k"], ["day"])
    facts.upsert_table(spark, path, rows(spark, [(1, "b", "g", 2), (3, "a", "g", 2), (5, None, "g", 2), (4, "z", "g", 2)]), ["k"], ["day"])
    assert len(spark.read.parquet(path).collect()) == 5
    assert {r.k: r.day for r in spark.read.parquet(path).collect()} == {1: "b", 2: "b", 3: "a", 4: "z", 5: None}
    assert not any(Path(f"{path}_staged").iterdir())


def test_two_partition_columns_and_repeats(spark, tmp_path):
    path = f"{tmp_path}/t"
    with pytest.raises(ValueError):
        facts.upsert_table(spark, path, rows(spark, [(1, "a", "g", 1), (1, "b", "g", 2)]), ["k"], ["grid", "day"])
    facts.upsert_table(spark, path, rows(spark, [(1, "a", "g", 1), (2, "a", "h", 1)]), ["k"], ["grid", "day"])
    facts.upsert_table(spark, path, rows(spark, [(1, "b", "h", 2)]), ["k"], ["grid", "day"])
    assert content(spark, path) == [(1, "b", "h", 2), (2, "a", "h", 1)]


def test_target_scan_is_pruned(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows(spark, [(k, f"d{k % 9}", "g", 1) for k in range(90)]).write.partitionBy("day").parquet(path)
    target = spark.read.parquet(path)
    few = target.filter("day = 'd3'").select("day").distinct().collect()
    read = facts.in_partitions(target, few, ["day"])
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(read._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [" in plan and read.count() == 10


def test_stream_upserts_keep_one_row_per_key(spark, tmp_path):
    data = [(1, "2024-01-01 10:00:00", 410.0), (2, "2024-01-01 11:00:00", 411.0), (1, "2024-01-02 10:00:00", 412.0)]
    schema = "observation_id long, acq_time string, xco2 double"
    for n, part in enumerate((data[:2], data[2:])):
        (spark.createDataFrame(part, schema).withColumns({"satellite": F.lit("OCO2"), "acq_time": F.col("acq_time").cast("timestamp"), "lon": F.lit(1.0), "lat": F.lit(2.0)}).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in"))
        given = spark.read.parquet(f"{tmp_path}/in").schema
        stream = S.stream_observations(spark, f"{tmp_path}/in", given)
        sink = S.upsert_sink(f"{tmp_path}/out", ["satellite", "observation_id"], ["grid_type", "time_bucket"], "acq_time")
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = {(r.observation_id, str(r.time_bucket), r.xco2) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, "20240102", 412.0), (2, "20240101", 411.0)}


def test_streaming_winner(spark, tmp_path):
    data = [("geohash", 3, "abc", "b1", f"2024-01-0{d} 0{h}:00:00", f"s{d}{h}") for d in (1, 2) for h in (1, 5, 3)]
    df = spark.createDataFrame(data, "grid_type string, grid_level int, space_code string, band string, acq_time string, scene_id string").withColumns({"acq_time": F.col("acq_time").cast("timestamp"), "asset_path": F.col("scene_id")})
    df.write.parquet(f"{tmp_path}/in")
    out = S.streaming_winner(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    out.writeStream.format("memory").queryName("winners").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start().awaitTermination()
    assert {(r.time_bucket, r.scene_id) for r in spark.table("winners").collect()} == {("20240101", "s15"), ("20240102", "s25")}


def test_package_reaches_workers_from_any_folder(tmp_path):
    root = Path(__file__).resolve().parents[1]
    code = (
        f"import sys; sys.path.insert(0, {str(root)!r})\n"
        "from gridloom.session import session\n"
        "s = session('local[1]', 1)\n"
        "from pyspark.sql import functions as F\n"
        "from gridloom.operators.grid import assign_cells\n"
        "print(assign_cells(s.range(3).withColumns({'lon': F.lit(1.0), 'lat': F.lit(2.0)}), 'lon', 'lat', 'isea4h', 4).count())\n"
        "print('CELL', assign_cells(s.range(1).withColumns({'lon': F.lit(1.0), 'lat': F.lit(2.0)}), 'lon', 'lat', 'isea4h', 4).first().space_code)\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=240, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert "CELL" in done.stdout, done.stderr[-800:]
