import json
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import facts, quality
from gridloom.plans import load_all
from gridloom.sources import manifest, observations
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
# A query of every section; the whole set is run by ``python -m tests.compare``.
SAMPLE = (
    "flagship_area_time_summary", "a2_manifest_rejects", "a14_adapter_choice", "b4_isea4h_assign_r6", "b2_mgrs_assign_p3", "c1_geohash_intersect",
    "d2_bbox_intersection", "d16_tile_st_code", "e2_best_quality_wins", "e13_run_overview", "e30_mosaic", "g2_page", "h3_difference",
    "i7_merge_catalog", "i2_upsert_partitioned_table", "j4_grid_method_agreement", "j19_run_status", "k5_output_ids", "k17_publication_eligibility", "m1_sql_functions",
)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    reg = load_all()
    state, message = compare(spark, con, reg.QUERIES[name], reg.ORACLES[name], SF)
    assert state == "same", message


def test_winner_does_not_depend_on_order_or_partitions(spark):
    rows = [("gh", 3, "abc", "2024", "b1", f"S{k % 9}", k % 50, float(k % 7), k) for k in range(300)]
    schema = "grid_type string, grid_level int, space_code string, time_bucket string, band string, scene_id string, acq_time int, sample_mean_band1 double, pos int"
    seen = set()
    for seed, parts in ((1, 1), (2, 7), (3, 20)):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, schema).repartition(parts)
        got = facts.resolve_facts(df, "best_quality_wins", ("pos",), pos="pos").first()
        seen.add((got.winner_scene_id, got.pos, got.source_scene_count))
    assert len(seen) == 1


def test_zero_mean_counts_as_missing(spark):
    rows = [("g", 3, "c", "t", "b", "S1", 9, 0.0), ("g", 3, "c", "t", "b", "S0", 1, -5.0)]
    schema = "grid_type string, grid_level int, space_code string, time_bucket string, band string, scene_id string, acq_time int, sample_mean_band1 double"
    got = facts.resolve_facts(spark.createDataFrame(rows, schema), "best_quality_wins", ("acq_time",)).first()
    assert got.winner_scene_id == "S0"


def test_upsert_is_idempotent(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    once = facts.upsert(t, s, ["k"])
    twice = facts.upsert(once, s, ["k"])
    assert sorted(once.collect()) == sorted(twice.collect()) == [(1, "a"), (2, "B"), (3, "c")]


def test_manifest_files(spark, tmp_path):
    row = {
        "scene_id": "S", "bands": ["B1", "b2"], "acq_time": "2024-01-01T00:00:00Z", "source_uri": "s3://b/x.tif", "sensor": "OLI",
        "product_family": "landsat", "resolution": "30m", "corners": [[0, 0], [1, 0], [1, 1], [0, 1]],
    }
    (tmp_path / "m.jsonl").write_text(json.dumps(row) + "\n\n")
    (tmp_path / "list.json").write_text(json.dumps([row]))
    (tmp_path / "object.json").write_text(json.dumps({"assets": [row]}))
    for name in ("m.jsonl", "list.json", "object.json"):
        good, bad = manifest.validate_manifest(manifest.read_manifest(spark, str(tmp_path / name)))
        assert sorted(r.band for r in good.collect()) == ["b1", "b2"], name
        assert bad.count() == 0


def test_observation_files(spark, tmp_path):
    (tmp_path / "o.jsonl").write_text('{"satellite":"TanSat","acq_time":"2024-01-01T00:00:00Z","lon":1.5,"lat":2,"xco2":400.5,"metadata":"{\\"a\\":1}"}\n')
    (tmp_path / "o.csv").write_text("satellite,observation_id,acq_time,lon,lat,xco2\nOCO2,7,2024-01-01T00:00:00Z,1,2,401\n")
    rows = observations.read_observations(spark, str(tmp_path / "o.jsonl")).withColumn("row_index", F.lit(0))
    got = observations.normalize_observations(rows).first()
    assert (got.observation_id, got.xco2, got.metadata) == ("0", 400.5, {"a": "1"})
    rows = observations.read_observations(spark, str(tmp_path / "o.csv")).withColumn("row_index", F.lit(0))
    assert observations.normalize_observations(rows).first().observation_id == "7"


def test_product_guard(spark):
    df = spark.createDataFrame([("OCO2",)], "satellite string")
    with pytest.raises(Exception, match="TanSat product requires"):
        observations.resolve_product(df, "tansat").collect()


def test_register_rule_needs_a_new_code():
    with pytest.raises(ValueError):
        quality.register_rule("index_schema", lambda t: None, True)


def test_streams(spark, tmp_path):
    from gridloom.streaming import observations as streams

    src = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts")
    rows = src.select(
        F.lit("OCO2").alias("satellite"), F.col("event_id").cast("string").alias("observation_id"), F.col("ts").cast("timestamp").alias("acq_time"),
        (F.col("event_id") % 180).cast("double").alias("lon"), (F.col("event_id") % 80).cast("double").alias("lat"), F.col("value").alias("xco2"),
    )
    inbox = str(tmp_path / "in")
    rows.write.parquet(inbox)
    rows.limit(50).write.mode("append").parquet(inbox)
    stream = streams.stream_observations(spark, inbox, rows.schema, "geohash", 2)
    q = streams.without_repeats(stream, "60 days").writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == rows.count()
    q = streams.daily_summary(stream).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("days").agg(F.sum("n")).first()[0] == rows.count() + 50
    table = str(tmp_path / "facts")
    sink = streams.upsert_sink(table, ["satellite", "observation_id"], ["grid_type", "time_bucket"], "acq_time")
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(table).count() == rows.count()
