"""Queries of the quality rules and file checks."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from gridloom.functions import timecode as T
from gridloom.operators import partitioning as P
from gridloom.operators import quality as Q
from gridloom.operators import facts
from gridloom.plans import duck, views
from gridloom.plans.registry import query
from gridloom.session import stage

KEYS = ("dataset_id", "output_version")


def index_rows(spark, sf_dir):
    """Index rows of scene boxes at geohash level 3; chosen rows are broken on purpose."""
    t = P.build_tasks(views.scenes(spark, sf_dir), "geohash", 3)
    pos, day = F.col("pos"), T.time_bucket("acq_time", "day")
    place = F.concat_ws(":", "scene_id", "space_code")
    return t.select(
        "dataset_id", F.lit("v1").alias("output_version"), place.alias("output_id"), F.col("asset_id").alias("source_asset_id"), "scene_id",
        F.concat(F.lit("b"), pos % 7 + 1).alias("band_code"), "grid_type", F.when(pos % 61 == 0, 4).otherwise(3).alias("grid_level"), "space_code",
        F.col("acq_time").alias("acquisition_time"),
        F.when(pos % 178 == 0, "").when(pos % 89 == 0, "19700101").otherwise(day).alias("time_bucket"),
        F.when(pos % 97 != 0, F.concat_ws(":", F.lit("gh:3"), "space_code", day)).alias("st_code"),
        F.concat(F.lit("T"), place).alias("tile_output_id"),
        (pos % 50).alias("window_col_off"), (pos % 40).alias("window_row_off"), F.when(pos % 73 == 0, 60).otherwise(14).alias("window_width"),
        F.lit(10).alias("window_height"), *P.CELL_BOX, "pos", F.lit("optical").alias("data_type"),
    )


def data_type(dataset):
    k = F.substring(dataset, 2, 10).cast("int") % 3
    return F.when(k == 0, "optical").when(k == 1, "radar").otherwise("carbon")


def tables(spark, sf_dir, staged=False) -> dict:
    """The tables of one rule run, over all datasets; ``staged`` reads index rows, cells and versions from the stage folder."""
    keep = stage if staged else lambda df, label: df
    idx = keep(index_rows(spark, sf_dir), "index-rows")
    pos = F.col("pos")
    tiles = idx.filter(pos % 79 != 0).select(
        *KEYS, F.col("tile_output_id").alias("output_id"), "grid_type", F.when(pos % 67 == 0, 4).otherwise(3).alias("grid_level"),
        F.when(pos % 71 == 0, "entity_file").otherwise("logical_reference").alias("tile_kind"), F.lit(64).alias("width"), F.lit(64).alias("height"), "space_code",
    )
    cells = idx.groupBy(*KEYS, "space_code").agg(F.min("pos").alias("p"), *[F.max(c).alias(c) for c in P.CELL_BOX])
    flip = F.col("p") % 83 == 0
    w, e = F.when(flip, F.col("cell_max_lon")).otherwise(F.col("cell_min_lon")), F.when(flip, F.col("cell_min_lon")).otherwise(F.col("cell_max_lon"))
    cells = cells.select(
        *KEYS, F.concat_ws(":", "dataset_id", "space_code").alias("output_id"), F.lit("geohash").alias("grid_type"), F.lit(3).alias("grid_level"), "space_code",
        F.array(w, F.col("cell_min_lat"), e, F.col("cell_max_lat")).alias("bbox"),
    )
    cells = keep(cells, "cell-rows")
    s = views.scenes(spark, sf_dir)
    kind = data_type(F.col("dataset_id"))
    carbon = kind == "carbon"
    uri = F.concat(F.lit("s3://bucket/"), "asset_id", F.when(carbon, ".nc4").otherwise(".tif"))
    assets = s.select(
        "dataset_id", F.col("asset_id").alias("source_asset_id"), kind.alias("data_type"),
        F.when(pos % 53 == 0, F.concat(F.lit("http://x/"), "asset_id")).otherwise(uri).alias("source_uri"),
        F.lit(None).cast("string").alias("cog_uri"),
        F.when(carbon, "netcdf").when(pos % 59 == 0, "tif").otherwise("cog").alias("source_format"),
        F.when(pos % 47 == 0, "zz").otherwise(F.sha2("asset_id", 256)).alias("checksum"),
        F.when(pos % 41 == 0, "").when(pos % 43 == 0, "nonsense").when(pos % 2 == 0, "epsg:4326").otherwise("EPSG:32650").alias("crs"), "pos",
    )
    inspections = assets.select(
        "dataset_id", "source_asset_id", (pos % 101 != 0).alias("readable"),
        F.when(pos % 37 == 0, "EPSG:3857").when(pos % 2 == 0, "EPSG:4326").otherwise("EPSG:32650").alias("crs"),
    )
    b = views.bands(spark, sf_dir).select(F.col("asset_id").alias("source_asset_id"), F.when(F.col("display_order") == 7, "QA_PIXEL").otherwise(F.col("band_code")).alias("band_code"), "band_type")
    bands = b.join(s.select(F.col("asset_id").alias("source_asset_id"), "dataset_id"), "source_asset_id")
    n_tiles = tiles.groupBy(*KEYS).agg(F.count("*").alias("tile_count"))
    versions = (
        idx.filter("dataset_id <> 'D7'").groupBy(*KEYS)
        .agg(F.count("*").alias("index_count"), F.count_distinct("space_code").alias("grid_cell_count"))
        .join(n_tiles, list(KEYS), "left")
    )
    off = F.when(F.substring("dataset_id", 2, 10).cast("int") % 10 == 3, 1).otherwise(0)
    versions = versions.select(
        *KEYS, data_type(F.col("dataset_id")).alias("data_type"), F.lit("geohash").alias("grid_type"), F.lit(3).alias("requested_grid_level"),
        F.lit("logical").alias("partition_method"), (F.coalesce("tile_count", F.lit(0)) + off).alias("tile_count"), "index_count", "grid_cell_count",
    )
    versions = keep(versions, "versions")
    return {"indexes": idx, "tiles": tiles, "cells": cells, "assets": assets, "inspections": inspections, "bands": bands, "versions": versions}


def carbon_tables(spark, sf_dir) -> dict:
    o = views.obs(spark, sf_dir)
    k = F.col("source_index")
    text = lambda c: c.cast("string")
    lon = F.when(k % 31 == 0, F.col("lon") + 200).otherwise(F.col("lon"))
    xco2 = F.when(k % 29 == 0, F.col("xco2") + 900).otherwise(F.col("xco2"))
    old = k % 19 == 0
    base = F.create_map(
        F.lit("observation_id"), F.col("observation_id"), F.when(old, "center_lon").otherwise("lon"), text(lon),
        F.when(old, "center_lat").otherwise("lat"), text(F.col("lat")), F.lit("xco2"), text(xco2),
    )
    with_flag = F.map_concat(base, F.create_map(F.lit("quality_flag"), F.col("quality_flag")))
    rows = o.select(
        F.lit("DC").alias("dataset_id"), F.lit("v1").alias("output_version"), k.cast("string").alias("output_id"), F.col("source_uri").alias("source_asset_id"),
        F.lit("carbon").alias("data_type"), F.when(k % 23 == 0, base).otherwise(with_flag).alias("attributes"),
    )
    versions = rows.select("dataset_id", "output_version", "data_type").distinct()
    return {"indexes": rows, "versions": versions}


#: SQL of each rule's findings.
_FINDINGS: dict[str, str] = {}


def _rule(name, fn, sql, make=tables, columns=("dataset_id", "error_code", "output_id", "source_asset_id", "field")):
    _FINDINGS[name.split("_", 1)[1]] = sql

    def run(spark, sf_dir):
        return fn(make(spark, sf_dir)).select(*columns)

    query(name, sql)(run)


def _sql(source, where, error, output="output_id", asset="NULL", field="NULL"):
    return f"SELECT dataset_id, {error} AS error_code, {output} AS output_id, {asset} AS source_asset_id, {field} AS field FROM {source} WHERE {where}"


_FINDINGS["index_schema"] = "SELECT dataset_id, count(*) || ' index rows have no ST code' AS message FROM index_rows WHERE st_code IS NULL GROUP BY 1"


@query("j1_index_schema", _FINDINGS["index_schema"])
def _(spark, sf_dir):
    return Q.rule_index_schema(tables(spark, sf_dir)).select("dataset_id", "message")


_rule("j2_output_count_consistency", Q.rule_output_count_consistency, _sql("version_rows", "CAST(substr(dataset_id, 2) AS INTEGER) % 10 = 3", "'output_count_mismatch'", "NULL"))
_rule("j3_output_reference_integrity", Q.rule_output_reference_integrity, _sql("index_rows", "pos % 79 = 0", "'missing_tile_reference'"))
_rule(
    "j4_grid_method_agreement", Q.rule_grid_method_agreement,
    _sql("tile_rows", "dataset_id <> 'D7' AND grid_level <> 3", "'tile_grid_mismatch'")
    + " UNION ALL " + _sql("tile_rows", "dataset_id <> 'D7' AND tile_kind <> 'logical_reference'", "'tile_kind_mismatch'", field="'tile_kind'")
    + " UNION ALL " + _sql("index_rows", "dataset_id <> 'D7' AND grid_level <> 3", "'detail_grid_mismatch'")
    + " UNION ALL SELECT 'D7', 'missing_output_version', NULL, NULL, NULL",
)
_rule("j5_cell_bbox_validity", Q.rule_cell_bbox_validity, _sql("cell_rows", "NOT (-180 <= west AND west < east AND east <= 180 AND -90 <= south AND south < north AND north <= 90)", "'invalid_bbox'", field="'bbox'"))
_rule("j6_time_bucket_consistency", Q.rule_time_bucket_consistency, _sql("index_rows", "pos % 89 = 0", "CASE WHEN time_bucket = '' THEN 'missing_time_bucket' ELSE 'time_bucket_mismatch' END", field="'time_bucket'"))
_BAD_URI = "(source_uri NOT LIKE 's3://%' OR (data_type <> 'carbon' AND source_format <> 'cog'))"
_rule(
    "j7_asset_readability", Q.rule_asset_readability,
    _sql("asset_rows", _BAD_URI, "CASE WHEN data_type = 'carbon' THEN 'invalid_carbon_source' ELSE 'invalid_cog_uri' END", "NULL", "source_asset_id", "CASE WHEN data_type = 'carbon' THEN 'source_uri' ELSE 'cog_uri' END")
    + " UNION ALL " + _sql("asset_rows", "length(checksum) <> 64", "'invalid_checksum'", "NULL", "source_asset_id", "'checksum'")
    + " UNION ALL " + _sql("asset_rows", f"NOT {_BAD_URI} AND length(checksum) = 64 AND NOT readable", "'source_object_unreadable'", "NULL", "source_asset_id", "'source_uri'"),
)
_rule(
    "j8_asset_crs", Q.rule_asset_crs,
    _sql("asset_rows", "data_type <> 'carbon' AND crs IN ('', 'nonsense')", "CASE WHEN crs = '' THEN 'missing_crs' ELSE 'invalid_crs' END", "NULL", "source_asset_id", "'crs'")
    + " UNION ALL " + _sql("asset_rows", "data_type <> 'carbon' AND crs NOT IN ('', 'nonsense') AND readable AND upper(crs) <> actual_crs", "'crs_metadata_mismatch'", "NULL", "source_asset_id", "'crs'"),
)
_rule("j9_window_bounds", Q.rule_window_bounds, _sql("index_rows", "pos % 79 <> 0 AND (window_col_off + window_width > 64 OR window_row_off + window_height > 64)", "'window_out_of_bounds'", field="'window'"))
for _n, _kind, _fn in (("j10_optical_band_contract", "optical", Q.rule_optical_band_contract), ("j11_radar_band_contract", "radar", Q.rule_radar_band_contract)):
    _want = "spectral" if _kind == "optical" else "polarization"
    _aux = "AND NOT (band_type = 'variable' AND band_code = 'b7')" if _kind == "optical" else ""
    _FINDINGS[_n.split("_", 1)[1]] = f"""SELECT a.dataset_id, CASE WHEN band_code IS NULL THEN 'missing_band_metadata' ELSE 'invalid_band_type' END AS error_code, a.source_asset_id,
                   CASE WHEN band_code = 'b7' THEN 'QA_PIXEL' ELSE band_code END AS band_code
            FROM asset_rows a LEFT JOIN bands b ON b.asset_id = a.source_asset_id
            WHERE data_type = '{_kind}' AND (band_code IS NULL OR (band_type <> '{_want}' {_aux}))"""
    query(_n, _FINDINGS[_n.split("_", 1)[1]])(lambda spark, sf_dir, fn=_fn: fn(tables(spark, sf_dir)).select("dataset_id", "error_code", "source_asset_id", "band_code"))
_CC = ("error_code", "index_id", "source_asset_id", "message")
_rule("j12_carbon_schema", Q.rule_carbon_schema, "SELECT 'missing_carbon_fields' AS error_code, output_id AS index_id, source_asset_id, 'missing carbon fields: quality_flag' AS message FROM carbon_rows WHERE no_flag_key", carbon_tables, _CC)
_rule("j13_carbon_coordinates", Q.rule_carbon_coordinates, "SELECT 'invalid_coordinates' AS error_code, output_id AS index_id, source_asset_id, 'carbon coordinates are outside WGS84 bounds' AS message FROM carbon_rows WHERE NOT (lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90)", carbon_tables, _CC)
_rule("j14_carbon_xco2_range", Q.rule_carbon_xco2_range, "SELECT 'xco2_out_of_range' AS error_code, output_id AS index_id, source_asset_id, 'xco2 must be between 0 and 1000 ppm' AS message FROM carbon_rows WHERE NOT (xco2 > 0 AND xco2 < 1000)", carbon_tables, _CC)
_rule("j15_carbon_quality_flags", Q.rule_carbon_quality_flags, "SELECT 'missing_quality_flag' AS error_code, output_id AS index_id, source_asset_id, 'carbon quality_flag is required' AS message FROM carbon_rows WHERE no_flag_key OR quality_flag IS NULL OR trim(quality_flag) = ''", carbon_tables, _CC)


@query("j16_alias_attributes", "SELECT output_id, 'lat' AS lat_name, 'lon' AS lon_name, old_names AS had_old FROM carbon_rows")
def _(spark, sf_dir):
    rows = Q.alias_attributes(carbon_tables(spark, sf_dir)["indexes"])
    has = lambda k: F.when(F.map_contains_key("attributes", k), k)
    return rows.select("output_id", has("lat").alias("lat_name"), has("lon").alias("lon_name"), F.map_contains_key("attributes", "center_lon").alias("had_old"))


_REGISTRY = ", ".join(f"({k}, '{c}', {list(t)!r}, {str(m).lower()})" for k, (c, _, t, m) in enumerate(Q.RULES))
_DATASETS = "(SELECT DISTINCT dataset_id, CASE CAST(substr(dataset_id, 2) AS INTEGER) % 3 WHEN 0 THEN 'optical' WHEN 1 THEN 'radar' ELSE 'carbon' END AS data_type FROM scenes)"


def _datasets(spark, sf_dir):
    return views.scenes(spark, sf_dir).select("dataset_id").distinct().withColumn("data_type", data_type(F.col("dataset_id")))


@query(
    "j17_rule_snapshot",
    f"""SELECT dataset_id, data_type, rule_code, rule_order, mandatory FROM {_DATASETS} JOIN (VALUES {_REGISTRY}) r(rule_order, rule_code, types, mandatory)
        ON list_contains(types, data_type) WHERE mandatory OR rule_code IN ('asset_crs', 'carbon_schema')""",
)
def _(spark, sf_dir):
    out = Q.rule_snapshot(Q.rules_table(spark), _datasets(spark, sf_dir), ["asset_crs", "carbon_schema"])
    return out.select("dataset_id", "data_type", "rule_code", F.col("rule_order").cast("long").alias("rule_order"), "mandatory")


# Findings of all rules over the scene datasets and DC, the dataset of the observations; carbon datasets of scenes have no observation rows.
_EVERY = f"(SELECT dataset_id, data_type FROM {_DATASETS} UNION ALL SELECT 'DC', 'carbon')"
_OF_OBSERVATIONS = ("carbon_schema", "carbon_coordinates", "carbon_xco2_range", "carbon_quality_flags")
_FIND = "(" + " UNION ALL ".join(
    [f"SELECT {repr('DC') if c in _OF_OBSERVATIONS else 'dataset_id'} AS dataset_id, '{c}' AS rule_code FROM ({sql})" for c, sql in _FINDINGS.items()]
    + [f"SELECT dataset_id, 'carbon_schema' FROM {_DATASETS} WHERE data_type = 'carbon'"]
) + ")"
_STATUS = f"""SELECT d.dataset_id, r.rule_code, count(f.rule_code) AS finding_count,
        CASE WHEN count(f.rule_code) = 0 THEN 'pass' WHEN any_value(mandatory) THEN 'fail' ELSE 'warn' END AS status
        FROM {_EVERY} d JOIN (VALUES {_REGISTRY}) r(rule_order, rule_code, types, mandatory) ON list_contains(types, data_type)
        LEFT JOIN {_FIND} f ON f.dataset_id = d.dataset_id AND f.rule_code = r.rule_code GROUP BY 1, 2"""


def all_tables(spark, sf_dir) -> dict:
    """The tables of a run over the scene datasets and the observations, which are dataset DC."""
    t, c = tables(spark, sf_dir, staged=True), carbon_tables(spark, sf_dir)["indexes"]
    rows = c.withColumns(
        {
            "acquisition_time": F.lit("2024-01-01 10:00:00").cast("timestamp"), "time_bucket": F.lit("20240101"), "st_code": F.lit("gh"), "grid_type": F.lit("geohash"),
            "grid_level": F.lit(3), "tile_output_id": F.lit(None).cast("string"), "space_code": F.lit("ezs"),
        }
    )
    version = rows.groupBy(*KEYS).agg(F.count("*").alias("index_count")).withColumns(
        {"data_type": F.lit("carbon"), "grid_type": F.lit("geohash"), "requested_grid_level": F.lit(3), "partition_method": F.lit("logical"), "tile_count": F.lit(0), "grid_cell_count": F.lit(0)}
    )
    return t | {"indexes": t["indexes"].unionByName(rows, allowMissingColumns=True), "versions": t["versions"].unionByName(version)}


def _statuses(spark, sf_dir):
    one = _datasets(spark, sf_dir)
    every = one.unionByName(spark.createDataFrame([("DC", "carbon")], one.schema))
    snapshot = Q.rule_snapshot(Q.rules_table(spark), every).withColumn("output_version", F.lit("v1"))
    return stage(Q.status_of_counts(Q.staged_counts(all_tables(spark, sf_dir)), snapshot), "rule-status")


@query("j18_rule_status", _STATUS)
def _(spark, sf_dir):
    return _statuses(spark, sf_dir).select("dataset_id", "rule_code", "finding_count", "status")


@query("j19_run_status", f"SELECT dataset_id, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'pass' END AS status FROM ({_STATUS}) GROUP BY 1")
def _(spark, sf_dir):
    return Q.run_status(_statuses(spark, sf_dir)).select("dataset_id", "status")


@query(
    "j20_apply_if_newest",
    """SELECT d.dataset_id, CASE WHEN s >= d.sequence THEN r.status ELSE 'old' END AS status, greatest(s, d.sequence) AS sequence FROM
       (SELECT dataset_id, max(pos) - 100 * (CAST(substr(dataset_id, 2) AS INTEGER) % 3 - 1) AS sequence FROM scenes GROUP BY 1) d
       JOIN (SELECT dataset_id, max(pos) AS s, arg_max(status, pos) AS status FROM scenes GROUP BY 1) r USING (dataset_id)""",
)
def _(spark, sf_dir):
    s = views.scenes(spark, sf_dir)
    step = F.substring("dataset_id", 2, 10).cast("int") % 3 - 1
    d = s.groupBy("dataset_id").agg(F.max("pos").alias("m")).select("dataset_id", F.lit("old").alias("status"), (F.col("m") - 100 * step).alias("sequence"))
    return Q.apply_if_newest(d, s.select("dataset_id", "status", F.col("pos").alias("sequence"))).select("dataset_id", "status", "sequence")


# --- file checks -----------------------------------------------------------


def file_rows(spark, sf_dir):
    """Index rows under the names of the partition file."""
    return index_rows(spark, sf_dir).withColumnsRenamed({"acquisition_time": "acq_time", "band_code": "band", "source_asset_id": "asset_path"})


def obs_rows(spark, sf_dir):
    o = views.obs(spark, sf_dir)
    k = F.col("source_index")
    kind = F.when(k % 41 == 0, "LineString").otherwise("Point")
    return o.select(
        "satellite", "observation_id", "acq_time", "product_type", "quality_flag", "source_index",
        F.when(k % 31 == 0, F.col("lon") + 200).otherwise(F.col("lon")).alias("center_lon"), F.col("lat").alias("center_lat"),
        F.when(k % 37 == 0, "n/a").otherwise(F.col("xco2").cast("string")).alias("xco2"),
        F.when(k % 43 == 0, "20200101").otherwise(T.time_bucket("acq_time", "day")).alias("time_bucket"),
        F.concat(F.lit('{"type":"'), kind, F.lit('"}')).alias("footprint_geojson"),
    )


def _check(check, bad, source="obs", level="FAIL", rows="count(*)"):
    return f"SELECT '{check}' AS \"check\", CASE WHEN {bad} > 0 THEN '{level}' ELSE 'PASS' END AS status, {rows} AS rows, {bad} AS bad_rows FROM {source}"


query("j21_check_rows", _check("rows", "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END", "index_rows"))(lambda s, d: Q.check_rows(file_rows(s, d)))


@query("j22_check_schema", _check("schema", "count(*) FILTER (WHERE source_index % 23 = 0)", "obs"))
def _(spark, sf_dir):
    return Q.check_schema(carbon_tables(spark, sf_dir)["indexes"], ("observation_id", "xco2", "quality_flag"), raw="attributes")


query("j23_check_time_bucket", _check("time_bucket", "count(*) FILTER (WHERE source_index % 43 = 0)", "obs"))(lambda s, d: Q.check_time_bucket(obs_rows(s, d)))


@query("j24_check_cell_bbox", "SELECT CASE WHEN pos % 83 = 0 THEN 'inverted' WHEN pos % 5 = 0 THEN 'non_numeric' WHEN pos % 7 = 0 THEN 'out_of_range' ELSE 'good' END AS reason, count(*) AS n FROM index_rows GROUP BY 1")
def _(spark, sf_dir):
    p = F.col("pos")
    r = file_rows(spark, sf_dir).withColumns(
        {
            "cell_min_lon": F.when(p % 83 == 0, F.col("cell_max_lon").cast("string")).when(p % 5 == 0, "west").when(p % 7 == 0, "-190.5").otherwise(F.col("cell_min_lon").cast("string")),
        }
    )
    return r.groupBy(F.coalesce(Q.cell_bbox_reason(), F.lit("good")).alias("reason")).agg(F.count("*").alias("n"))


_PAIRS = "(SELECT 'S' || (pos % 4000) AS scene_id, band_code AS band, asset_id FROM bands)"


def _pairs(spark, sf_dir):
    return views.bands(spark, sf_dir).select(F.concat(F.lit("S"), F.col("pos") % 4000).alias("scene_id"), F.col("band_code").alias("band"), F.col("asset_id").alias("asset_path"))


query("e26_logical_duplicates", f"SELECT scene_id, band, count(DISTINCT asset_id) AS assets FROM {_PAIRS} GROUP BY 1, 2 HAVING count(DISTINCT asset_id) > 1")(
    lambda s, d: Q.logical_duplicates(_pairs(s, d))
)
query("j25_check_logical_duplicates", f"SELECT 'logical_duplicates' AS \"check\", 'WARN' AS status, count(*) AS rows, count(*) AS bad_rows FROM (SELECT scene_id, band FROM {_PAIRS} GROUP BY 1, 2 HAVING count(DISTINCT asset_id) > 1)")(
    lambda s, d: Q.check_logical_duplicates(_pairs(s, d))
)


@query(
    "j26_check_assets",
    """WITH r AS (SELECT *, 'P' || (pos % 500) AS asset_path FROM index_rows), a AS (SELECT 'P' || x AS asset_path, x, 64 AS width, 64 AS height FROM (SELECT DISTINCT pos % 500 AS x FROM index_rows) WHERE x % 50 <> 3),
         j AS (SELECT r.*, a.x, width, height FROM r LEFT JOIN a USING (asset_path))
       SELECT 'asset_present' AS "check", CASE WHEN count(*) FILTER (WHERE width IS NULL) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) AS rows, count(*) FILTER (WHERE width IS NULL) AS bad_rows FROM j
       UNION ALL SELECT 'window_bounds', CASE WHEN count(*) FILTER (WHERE window_col_off + window_width > width OR window_row_off + window_height > height) > 0 THEN 'FAIL' ELSE 'PASS' END, count(*), count(*) FILTER (WHERE window_col_off + window_width > width OR window_row_off + window_height > height) FROM j
       UNION ALL SELECT 'asset_crs', CASE WHEN count(*) FILTER (WHERE x % 11 = 0) > 0 THEN 'FAIL' ELSE 'PASS' END, count(*), count(*) FILTER (WHERE x % 11 = 0) FROM j
       UNION ALL SELECT 'all_zero', CASE WHEN count(*) FILTER (WHERE x % 13 = 0) > 0 THEN 'WARN' ELSE 'PASS' END, count(*), count(*) FILTER (WHERE x % 13 = 0) FROM a""",
)
def _(spark, sf_dir):
    r = index_rows(spark, sf_dir).withColumn("x", F.col("pos") % 500).withColumn("asset_path", F.concat(F.lit("P"), "x"))
    x = F.col("x")
    a = r.select("asset_path", "x").distinct().filter(x % 50 != 3).select(
        "asset_path", F.lit(64).alias("width"), F.lit(64).alias("height"), F.when(x % 11 == 0, "EPSG:3857").otherwise("EPSG:4326").alias("crs"),
        F.lit(10).alias("valid"), F.when(x % 13 == 0, 0).otherwise(5).alias("nonzero"),
    )
    return Q.check_assets(r, a)


query("j27_check_coordinates", _check("coordinates", "count(*) FILTER (WHERE source_index % 31 = 0 AND lon + 200 > 180)", "obs"))(lambda s, d: Q.check_coordinates(obs_rows(s, d)))


@query(
    "j28_check_xco2",
    """SELECT 'xco2_range' AS "check", 'FAIL' AS status, count(*) AS rows, count(*) FILTER (WHERE source_index % 37 = 0 OR NOT xco2 BETWEEN 250 AND 650) AS bad_rows,
       min(xco2) FILTER (WHERE source_index % 37 <> 0) AS xco2_min, max(xco2) FILTER (WHERE source_index % 37 <> 0) AS xco2_max, round(avg(xco2) FILTER (WHERE source_index % 37 <> 0), 6) AS xco2_avg FROM obs""",
)
def _(spark, sf_dir):
    return Q.check_xco2(obs_rows(spark, sf_dir))


query("j29_check_flags", "SELECT coalesce(quality_flag, '') AS quality_flag, count(*) AS n, CASE WHEN coalesce(quality_flag, '') IN ('', '0', '1') THEN 'PASS' ELSE 'WARN' END AS status FROM obs GROUP BY 1")(
    lambda s, d: Q.check_flags(obs_rows(s, d))
)
_DUP = "(SELECT satellite, observation_id, count(*) AS n FROM obs GROUP BY 1, 2 HAVING count(*) > 1)"
query("e25_duplicates", "SELECT observation_id, count(*) AS n FROM obs GROUP BY 1 HAVING count(*) > 1")(lambda s, d: Q.duplicates(obs_rows(s, d), ["observation_id"]))
query("j30_check_duplicates", f"SELECT 'duplicates' AS \"check\", CASE WHEN count(*) > 0 THEN 'WARN' ELSE 'PASS' END AS status, count(*) AS rows, count(*) AS bad_rows FROM {_DUP}")(
    lambda s, d: Q.check_duplicates(obs_rows(s, d), ["satellite", "observation_id"])
)
query("j31_check_footprints", _check("footprints", "count(*) FILTER (WHERE source_index % 41 = 0)", "obs", "WARN"))(lambda s, d: Q.check_footprints(obs_rows(s, d)))


@query(
    "j32_check_years",
    """SELECT 'year_bucket' AS "check", CASE WHEN count(*) FILTER (WHERE pos % 113 = 0) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) AS rows, count(*) FILTER (WHERE pos % 113 = 0) AS bad_rows FROM scenes
       UNION ALL SELECT 'missing_years', CASE WHEN count(*) > 0 THEN 'WARN' ELSE 'PASS' END, count(*), count(*) FROM (SELECT DISTINCT year(time_start) AS y FROM bands EXCEPT SELECT DISTINCT year(acq_time) FROM scenes)""",
)
def _(spark, sf_dir):
    s = views.scenes(spark, sf_dir).withColumn("time_bucket", F.when(F.col("pos") % 113 == 0, "1900").otherwise(F.year("acq_time").cast("string")))
    expected = views.bands(spark, sf_dir).select(F.year("time_start").alias("year"))
    return Q.check_years(s, expected)


def _whole(df, fields):
    """Rows with columns for the fields that the views lack."""
    return df.withColumns({f: F.lit(None).cast("string") for f in fields if f not in df.columns})


@query(
    "j33_radar_report",
    f"""SELECT *, 'radar' AS kind FROM (
        SELECT 'rows' AS "check", 'PASS' AS status, count(*) AS rows, 0 AS bad_rows FROM index_rows
        UNION ALL SELECT 'schema', 'PASS', count(*), 0 FROM index_rows
        UNION ALL {_check('time_bucket', 'count(*) FILTER (WHERE pos % 89 = 0)', 'index_rows')}
        UNION ALL {_check('cell_bbox', '0', 'index_rows')}
        UNION ALL SELECT 'logical_duplicates', 'PASS', 0, 0)""",
)
def _(spark, sf_dir):
    return Q.quality_report(_whole(file_rows(spark, sf_dir), Q.INDEX_FIELDS), "radar")


_REPORT = " UNION ALL ".join(
    [
        "SELECT 'rows' AS \"check\", CASE WHEN count(*) = 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) AS rows, CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS bad_rows FROM obs",
        "SELECT 'schema', 'PASS', count(*), 0 FROM obs",
        _check("time_bucket", "count(*) FILTER (WHERE source_index % 43 = 0)"),
        _check("coordinates", "count(*) FILTER (WHERE source_index % 31 = 0 AND lon + 200 > 180)"),
        _check("xco2_range", "count(*) FILTER (WHERE source_index % 37 = 0 OR NOT xco2 BETWEEN 250 AND 650)"),
        _check("flags", "count(*) FILTER (WHERE coalesce(quality_flag, '') NOT IN ('', '0', '1'))", level="WARN"),
        _check("footprints", "count(*) FILTER (WHERE source_index % 41 = 0)", level="WARN"),
        _check("duplicates", "count(*)", "(SELECT observation_id FROM obs GROUP BY 1 HAVING count(*) > 1)", "WARN"),
    ]
)


@query("j33_carbon_report", f"SELECT *, 'carbon' AS kind FROM ({_REPORT})")
def _(spark, sf_dir):
    return Q.quality_report(_whole(obs_rows(spark, sf_dir), Q.OBSERVATION_FIELDS), "carbon")


@query("j33_carbon_report_without_columns", "SELECT 'rows' AS \"check\", 'PASS' AS status, count(*) AS rows, 0 AS bad_rows, 'carbon' AS kind FROM obs UNION ALL SELECT 'schema', 'FAIL', count(*), count(*), 'carbon' FROM obs")
def _(spark, sf_dir):
    return Q.quality_report(obs_rows(spark, sf_dir), "carbon")


@query(
    "e12_summarize_checks",
    f"""SELECT count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'WARN') AS warned, count(*) FILTER (WHERE status = 'FAIL') AS failed,
        CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARN') THEN 'WARN' ELSE 'PASS' END AS status FROM ({_REPORT})""",
)
def _(spark, sf_dir):
    return Q.summarize_checks(Q.quality_report(_whole(obs_rows(spark, sf_dir), Q.OBSERVATION_FIELDS), "carbon"))


@query("g5_sample_of_offenders", "SELECT source_index FROM obs WHERE source_index % 43 = 0 ORDER BY source_index LIMIT 20")
def _(spark, sf_dir):
    return Q.sample_rows(obs_rows(spark, sf_dir), Q.bad_time_bucket(), order="source_index").select("source_index")


@query("e32_output_counts", "SELECT dataset_id, (SELECT count(*) FROM tile_rows t WHERE t.dataset_id = i.dataset_id) AS tile_count, count(*) AS index_count, count(DISTINCT space_code) AS grid_cell_count FROM index_rows i GROUP BY 1")
def _(spark, sf_dir):
    return Q.output_counts(tables(spark, sf_dir)).drop("output_version")


@query("e33_assert_totals", f"SELECT dataset_id, sum(finding_count) + 1 AS total, sum(finding_count) AS summed FROM ({_STATUS}) WHERE TRY_CAST(substr(dataset_id, 2) AS INTEGER) % 5 = 0 GROUP BY 1")
def _(spark, sf_dir):
    results = _statuses(spark, sf_dir)
    off = F.when(F.substring("dataset_id", 2, 10).try_cast("int") % 5 == 0, 1).otherwise(0)
    totals = results.groupBy("dataset_id").agg((F.sum("finding_count")).alias("s")).select("dataset_id", (F.col("s") + off).alias("total"))
    return Q.assert_totals(totals, results, ["dataset_id"])


@query(
    "i17_export_errors",
    """SELECT output_id AS index_id, 'window_bounds' AS rule_code, CASE WHEN pos % 2 = 0 THEN '''=' ELSE '' END || 'index window exceeds tile dimensions' AS message, '{}' AS context FROM index_rows
       WHERE pos % 79 <> 0 AND (window_col_off + window_width > 64 OR window_row_off + window_height > 64)""",
)
def _(spark, sf_dir):
    from gridloom.operators import lifecycle

    found = Q.rule_window_bounds(tables(spark, sf_dir))
    pos = F.substring(F.split_part("index_id", F.lit(":"), F.lit(1)), 2, 20).cast("long")
    found = found.withColumn("message", F.when(pos % 2 == 0, F.concat(F.lit("="), "message")).otherwise(F.col("message")))
    return lifecycle.export_rows(found).select("index_id", "rule_code", "message", "context")
