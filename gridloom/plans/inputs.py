"""Queries of the sources: manifests, file names, observations and load documents made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.sources import filenames, loads, manifest, observations
from gridloom.functions import identity
from gridloom.plans import views
from gridloom.plans.registry import query
from gridloom.session import stage


def manifests(spark, sf_dir):
    """Manifest rows from orders; every seventh or so is broken in a way of its own."""
    o = views.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    west, south = ((k * 37) % 3400).cast("double") / 10.0 - 170.0, ((k * 53) % 1600).cast("double") / 10.0 - 80.0
    point = lambda x, y: F.array(x, y)
    corners = F.array(point(west, south), point(west + 2.0, south), point(west + 2.0, south + 1.5), point(west, south + 1.5))
    t = lambda c: c.cast("string")
    return o.select(
        k.alias("k"), F.when(k % 31 == 0, "lidar").when(k % 3 == 0, "Radar ").otherwise(F.lit(None)).cast("string").alias("data_type"),
        F.when(k % 29 == 0, " ").otherwise(F.concat(F.lit("S"), t(k))).alias("scene_id"), F.when(k % 2 == 1, F.lit("B9")).alias("band"),
        F.when(k % 2 == 0, F.array(F.lit(" B1"), F.lit("b2"), F.lit(""))).alias("bands"), F.lit(None).cast("string").alias("variable"), F.lit("vv").alias("polarization"),
        F.when(k % 23 == 0, "yesterday").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("acq_time"),
        F.concat(F.lit("s3://b/"), t(k), F.lit(".tif")).alias("source_uri"), F.lit("OLI").alias("sensor"), F.lit("").alias("product_family"), F.lit("Landsat").alias("product_type"),
        F.when(k % 19 == 0, "-5").when(k % 17 == 0, "fine").otherwise(F.concat(t(k % 40 + 1), F.lit(" M"))).alias("resolution"),
        F.when(k % 13 == 0, F.slice(corners, 1, 3)).otherwise(corners).alias("corners"),
    )


_ROWS = """(SELECT k, unnest(CASE WHEN k % 2 = 0 THEN ['b1', 'b2'] ELSE ['b9'] END) AS band, CASE WHEN k % 31 = 0 THEN 'lidar' WHEN k % 3 = 0 THEN 'radar' ELSE 'optical' END AS data_type,
    CASE WHEN k % 29 = 0 THEN '' ELSE 'S' || k END AS scene_id, 's3://b/' || k || '.tif' AS path, CASE WHEN k % 19 = 0 OR k % 17 = 0 THEN NULL ELSE CAST(k % 40 + 1 AS DOUBLE) END AS resolution,
    CASE WHEN k % 29 = 0 OR k % 19 = 0 OR k % 17 = 0 THEN 'required_fields' WHEN k % 13 = 0 THEN 'four_corners' WHEN k % 23 = 0 THEN 'acq_time' WHEN k % 31 = 0 THEN 'data_type' END AS problem
    FROM (SELECT o_orderkey AS k FROM orders))"""


@query("a1_manifest_scan", f"SELECT scene_id, band, data_type, path, 'landsat' AS product_family, 'oli' AS sensor, resolution FROM {_ROWS}")
def _(spark, sf_dir):
    return manifest.manifest_rows(manifests(spark, sf_dir)).select("scene_id", "band", "data_type", "path", "product_family", "sensor", "resolution")


@query("a2_manifest_good", f"SELECT scene_id, band FROM {_ROWS} WHERE problem IS NULL")
def _(spark, sf_dir):
    return manifest.validate_manifest(manifest.manifest_rows(manifests(spark, sf_dir)))[0].select("scene_id", "band")


@query("a2_manifest_rejects", f"SELECT path, band, problem FROM {_ROWS} WHERE problem IS NOT NULL")
def _(spark, sf_dir):
    return manifest.validate_manifest(manifest.manifest_rows(manifests(spark, sf_dir)))[1].select("path", "band", "problem")


@query("a3_bbox_of_corners", "SELECT pos AS k, CASE WHEN pos % 29 = 0 THEN ' ' ELSE scene_id END AS scene_id, CASE WHEN pos % 13 <> 0 THEN round(min_lon, 6) END AS min_lon, CASE WHEN pos % 13 <> 0 THEN round(min_lat, 6) END AS min_lat, CASE WHEN pos % 13 <> 0 THEN round(max_lon, 6) END AS max_lon, CASE WHEN pos % 13 <> 0 THEN round(max_lat, 6) END AS max_lat FROM scenes")
def _(spark, sf_dir):
    return manifest.with_bbox(manifests(spark, sf_dir), digits=6).select("k", "scene_id", "min_lon", "min_lat", "max_lon", "max_lat")


@query("a4_parse_resolution", f"SELECT DISTINCT path, resolution FROM {_ROWS}")
def _(spark, sf_dir):
    return manifests(spark, sf_dir).select(F.col("source_uri").alias("path"), manifest.parse_resolution(F.col("resolution")).alias("resolution"))


@query(
    "a5_finest_resolution",
    """SELECT 'D' || (o_custkey % 50) AS dataset_id, min(CASE k % 4 WHEN 0 THEN 10.0 + k % 7 WHEN 1 THEN 20.5 + k % 9 WHEN 2 THEN 5 + k % 11 ELSE 3 + k % 13 END) AS resolution
       FROM (SELECT o_custkey, o_orderkey AS k FROM orders) GROUP BY 1""",
)
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    t = lambda c: c.cast("string")
    json = (
        F.when(k % 4 == 0, F.concat(F.lit('{"gsd":'), t(k % 7 + 10), F.lit("}")))
        .when(k % 4 == 1, F.concat(F.lit('{"resolution":"'), t(k % 9 + F.lit(20)), F.lit('.5 m","crs":"x"}')))
        .when(k % 4 == 2, F.concat(F.lit('{"pixel_size":{"x":'), t(k % 11 + 5), F.lit(',"y":400}}')))
        .otherwise(F.concat(F.lit('{"attributes":{"resolution_m":['), t(k % 13 + 3), F.lit(",90]}}")))
    )
    rows = views.table(spark, sf_dir, "orders").select(F.concat(F.lit("D"), F.col("o_custkey") % 50).alias("dataset_id"), json.alias("asset"))
    return manifest.finest_resolution(rows, "asset", ["dataset_id"])


@query("a6_listing_by_suffix", "SELECT 's3://b/' || l_orderkey || CASE l_linenumber % 4 WHEN 0 THEN '.TIF' WHEN 1 THEN '.tiff' END AS path FROM lineitem WHERE l_linenumber % 4 < 2")
def _(spark, sf_dir):
    n = F.col("l_linenumber") % 4
    ext = F.when(n == 0, ".TIF").when(n == 1, ".tiff").when(n == 2, ".dat").otherwise(".json")
    files = views.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s3://b/"), F.col("l_orderkey").cast("string"), ext).alias("path"))
    return files.filter(manifest.asset_suffix(F.col("path")).isin(*manifest.SUFFIXES["optical"]))


def names(spark, sf_dir):
    """File names of every pattern from orders."""
    k = F.col("o_orderkey")
    t = lambda c: c.cast("string")
    day, doy = F.date_format("o_orderdate", "yyyyMMdd"), F.date_format("o_orderdate", "yyyyDDD")
    quarter = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    name = (
        F.when(k % 6 == 0, F.concat(F.lit("LC0"), t(k % 2 + 8), F.lit("_L2SP_120034_"), day, F.lit("_20240101_02_T1_SR_B"), t(k % 7)))
        .when(k % 6 == 1, F.concat(F.lit("LO8120029"), doy, F.lit("BJC00_B"), t(k % 9)))
        .when(k % 6 == 2, F.concat(F.lit("T50sMK_"), day, F.lit("T031541_B"), F.lpad(t(k % 12 + 1), 2, "0"), F.lit("_10m")))
        .when(k % 6 == 3, F.concat(F.lit("Shandong_mosaic_"), F.when(k % 4 == 3, quarter).otherwise(F.date_format("o_orderdate", "yyyyMM")), F.lit("_sr_band"), t(k % 5), F.lit("_cut")))
        .when(k % 6 == 4, F.concat(F.lit("S1_"), day, F.lit("_"), F.when(k % 4 == 0, "VV").otherwise("vh")))
        .otherwise(F.concat(F.lit("Index_"), F.date_format("o_orderdate", "yyyy"), F.lit("年")))
    )
    return views.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("s3://data/x/"), name, F.lit(".TIF")).alias("path"))


_NAMES = """(SELECT o_orderkey, o_orderkey AS k, o_orderdate AS d, CASE o_orderkey % 6
    WHEN 0 THEN 'LC0' || (o_orderkey % 2 + 8) || '_L2SP_120034_' || strftime(o_orderdate, '%Y%m%d') || '_20240101_02_T1_SR_B' || (o_orderkey % 7)
    WHEN 1 THEN 'LO8120029' || strftime(o_orderdate, '%Y%j') || 'BJC00_B' || (o_orderkey % 9)
    WHEN 2 THEN 'T50sMK_' || strftime(o_orderdate, '%Y%m%d') || 'T031541_B' || lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0') || '_10m'
    WHEN 3 THEN 'Shandong_mosaic_' || CASE WHEN o_orderkey % 4 = 3 THEN strftime(o_orderdate, '%Y') || 'Q' || quarter(o_orderdate) ELSE strftime(o_orderdate, '%Y%m') END || '_sr_band' || (o_orderkey % 5) || '_cut'
    WHEN 4 THEN 'S1_' || strftime(o_orderdate, '%Y%m%d') || '_' || CASE WHEN o_orderkey % 4 = 0 THEN 'VV' ELSE 'vh' END
    ELSE 'Index_' || strftime(o_orderdate, '%Y') || '年' END AS s FROM orders)"""


def _meta(df):
    return df.select("o_orderkey", "scene_id", "band", F.date_format("acq_time", "yyyy-MM-dd HH:mm:ss").alias("acq_time"), "product_family", "sensor")


def _family(name, rest, condition, scene, band, time, family, sensor):
    sql = f"SELECT o_orderkey, {scene} AS scene_id, {band} AS band, {time} AS acq_time, {family} AS product_family, {sensor} AS sensor FROM {_NAMES} WHERE k % 6 = {rest}"

    def run(spark, sf_dir):
        return _meta(filenames.extract_asset_metadata(names(spark, sf_dir).filter(F.col("o_orderkey") % 6 == rest)))

    query(name, sql)(run)
    return sql


_DAY = "strftime(d, '%Y-%m-%d') || ' 00:00:00'"
_PARTS = [
    _family("a7_landsat_collection_names", 0, None, "regexp_extract(s, '^(([^_]*_){6}[^_]*)_', 1)", "'sr_b' || (k % 7)", _DAY, "'landsat'", "'landsat' || (k % 2 + 8) || '_oli_tirs'"),
    _family("a8_landsat_l1tp_names", 1, None, "split_part(s, '_', 1)", "'b' || (k % 9)", _DAY, "'landsat'", "'landsat8_oli_tirs'"),
    _family("a9_sentinel2_names", 2, None, "'S2_T50SMK_' || strftime(d, '%Y%m%d') || 'T031541'", "'b' || lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0') || '_10m'", "strftime(d, '%Y-%m-%d') || ' 03:15:41'", "'sentinel2'", "'sentinel2_msi'"),
    _family("a10_mosaic_names", 3, None, "regexp_extract(s, '^(Shandong_mosaic_[0-9Q]+)_', 1)", "'sr_band' || (k % 5)", "strftime(date_trunc(CASE WHEN k % 4 = 3 THEN 'quarter' ELSE 'month' END, d), '%Y-%m-%d') || ' 00:00:00'", "'other'", "'optical_mosaic'"),
    _family("a11_generic_names", 4, None, "s", "lower(s)", "'1970-01-01 00:00:00'", "'generic_tif'", "'unknown'"),
]
# Names of no family, radar and annual products included, fall to the generic adapter.
query("a14_adapter_choice", " UNION ALL ".join([*_PARTS, _PARTS[4].replace("k % 6 = 4", "k % 6 = 5")]))(lambda s, d: _meta(filenames.extract_asset_metadata(names(s, d))))


@query("a12_annual_product_names", f"SELECT o_orderkey, 'dianzhong_ecological_security_' || strftime(d, '%Y') AS scene_id, 'Index' AS product_name, year(d) AS product_year FROM {_NAMES} WHERE k % 6 = 5")
def _(spark, sf_dir):
    out = filenames.extract_product_metadata(names(spark, sf_dir)).filter("scene_id is not null")
    return out.select("o_orderkey", "scene_id", "product_name", F.col("product_year").cast("long").alias("product_year"))


@query("a13_sentinel1_names", f"SELECT o_orderkey, 'S1_' || strftime(d, '%Y%m%d') AS scene_id, CASE WHEN k % 4 = 0 THEN 'vv' ELSE 'vh' END AS band, {_DAY} AS acq_time, 'sentinel1' AS product_family, 'sentinel1_sar' AS sensor FROM {_NAMES} WHERE k % 6 = 4")
def _(spark, sf_dir):
    return _meta(filenames.extract_radar_metadata(names(spark, sf_dir)).filter("scene_id is not null"))


@query(
    "a15_radar_batch_manifest",
    """SELECT scene_id, 'minio://radar/' || scene_id || '.tif' AS source_uri, 'vv' AS polarization, 0.125 AS resolution, round(min_lon, 6) AS west, strftime(acq_time, '%Y-%m-%dT%H:%M:%SZ') AS acq_time FROM scenes""",
)
def _(spark, sf_dir):
    s = views.scenes(spark, sf_dir)
    a = lambda x, y: F.array(F.col(x), F.col(y))
    cat = s.select(
        F.concat(F.lit("/in/"), "scene_id", F.lit(".tif")).alias("path"), "scene_id", F.lit("vv").alias("band"), "acq_time", F.lit("sentinel1").alias("product_family"), F.lit("sentinel1_sar").alias("sensor"),
        F.array(a("min_lon", "min_lat"), a("max_lon", "min_lat"), a("max_lon", "max_lat"), a("min_lon", "max_lat")).alias("corners"), F.lit(0.125).alias("pixel_x"), F.lit(-0.1).alias("pixel_y"),
    )
    j = lambda k: F.get_json_object("asset", f"$.{k}")
    out = manifest.radar_manifest(cat, "batch", "/in", "minio://radar/")
    return out.select(j("scene_id").alias("scene_id"), "source_uri", j("polarization").alias("polarization"), j("resolution").cast("double").alias("resolution"), j("bbox[0]").cast("double").alias("west"), j("acq_time").alias("acq_time"))


# --- observations ------------------------------------------------------------


def raw_rows(spark, sf_dir):
    """Observation rows as delivered: texts, some without an id, an index or a source."""
    o = views.obs(spark, sf_dir)
    k = F.col("source_index")
    t = lambda c: c.cast("string")
    ring = F.concat(F.lit("[["), t(F.col("lon")), F.lit(","), t(F.col("lat")), F.lit("],[0,0],[1,1]]"))
    return o.select(
        "satellite", F.when(k % 3 != 0, F.col("observation_id")).otherwise("").alias("observation_id"), F.when(k % 6 == 0, F.concat(F.lit("s"), t(k))).alias("sounding_id"),
        F.date_format("acq_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("acq_time"), t(F.col("lon")).alias("lon"), t(F.col("lat")).alias("lat"), t(F.col("xco2")).alias("xco2"), "quality_flag",
        F.when(k % 5 == 0, ring).alias("footprint"), F.when(k % 2 == 0, F.col("source_uri")).alias("source_uri"), F.when(k % 7 == 0, t(k + 1000000)).alias("source_index"),
        F.when(k % 4 == 0, '{"mode":"nadir"}').alias("metadata"), k.alias("row_index"), F.lit("file:/x.jsonl").alias("file_path"),
    )


_NORMAL = """SELECT satellite, CASE WHEN source_index % 3 <> 0 THEN observation_id WHEN source_index % 6 = 0 THEN 's' || source_index ELSE CAST(source_index AS VARCHAR) END AS observation_id,
    strftime(acq_time, '%Y%m%d%H%M%S') AS t, lon, lat, xco2, quality_flag, CASE WHEN source_index % 5 = 0 THEN 4 END AS ring_points,
    CASE WHEN source_index % 2 = 0 THEN source_uri ELSE 'file:/x.jsonl' END AS source_uri, CASE WHEN source_index % 7 = 0 THEN source_index + 1000000 ELSE source_index END AS source_index,
    CASE WHEN source_index % 4 = 0 THEN 'nadir' END AS mode FROM obs"""


def _normal(df):
    out = observations.normalize_observations(df)
    return out.select(
        "satellite", "observation_id", F.date_format("acq_time", "yyyyMMddHHmmss").alias("t"), "lon", "lat", "xco2", "quality_flag",
        F.when(F.col("footprint").isNotNull(), F.size("footprint").cast("long")).alias("ring_points"), "source_uri", "source_index", F.try_element_at("metadata", F.lit("mode")).alias("mode"),
    )


query("a18_normalize_observations", _NORMAL)(lambda s, d: _normal(raw_rows(s, d)))


@query("a16_observation_lines", _NORMAL)
def _(spark, sf_dir):
    from gridloom import schemas

    lines = raw_rows(spark, sf_dir)
    text = lines.select(F.to_json(F.struct(*[c for c in lines.columns if c not in ("row_index", "file_path")])).alias("line"), "row_index", "file_path")
    rows = text.select(F.from_json("line", schemas.OBSERVATION).alias("r"), "row_index", "file_path").select("r.*", "row_index", "file_path")
    return _normal(rows)


@query("a17_observation_csv", "SELECT satellite, source_index, strftime(acq_time, '%Y%m%d%H%M%S') AS t, lon, xco2 FROM obs")
def _(spark, sf_dir):
    o = raw_rows(spark, sf_dir)
    line = F.to_csv(F.struct("satellite", "acq_time", "lon", "lat", "xco2"))
    rows = o.select(F.from_csv(line, "satellite string, acq_time string, lon string, lat string, xco2 string").alias("r"), "row_index", "file_path").select("r.*", "row_index", "file_path")
    for c in ("observation_id", "sounding_id", "quality_flag", "footprint", "source_uri", "source_index", "metadata"):
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    out = observations.normalize_observations(rows)
    return out.select("satellite", "source_index", F.date_format("acq_time", "yyyyMMddHHmmss").alias("t"), "lon", "xco2")


@query(
    "a19_normalize_oco2",
    """SELECT strftime(acq_time, '%Y%m%d%H%M%S') || (source_index % 10) AS observation_id, 'OCO2' AS satellite, strftime(acq_time, '%Y%m%d%H%M%S') || '.' || (source_index % 10) AS t,
       lon, lat, xco2, CAST(source_index % 2 AS VARCHAR) AS quality_flag, 5 AS ring_points, lon - 0.5 AS first_lon FROM obs WHERE source_index % 9 <> 0""",
)
def _(spark, sf_dir):
    o = views.obs(spark, sf_dir)
    k, x, y = F.col("source_index"), F.col("lon"), F.col("lat")
    df = o.select(
        F.concat(F.date_format("acq_time", "yyyyMMddHHmmss"), (k % 10).cast("string")).cast("bigint").alias("sounding_id"), y.alias("latitude"), x.alias("longitude"),
        F.unix_timestamp("acq_time").cast("double").alias("time"), F.when(k % 9 == 0, -999999.0).otherwise(F.col("xco2")).alias("xco2"), (k % 2).alias("xco2_quality_flag"),
        F.array(x - 0.5, x + 0.5, x + 0.5, x - 0.5).alias("vertex_longitude"), F.array(y, y, y + 0.1, y + 0.1).alias("vertex_latitude"), "source_uri", "source_index",
    )
    out = observations.normalize_oco2(df)
    return out.select(
        "observation_id", "satellite", F.date_format("acq_time", "yyyyMMddHHmmss.S").alias("t"), "lon", "lat", "xco2", "quality_flag",
        F.size("footprint").cast("long").alias("ring_points"), F.col("footprint")[0]["lon"].alias("first_lon"),
    )


@query(
    "a20_normalize_xco2",
    """SELECT CAST(source_index AS VARCHAR) AS observation_id, CASE source_index % 3 WHEN 0 THEN 'TanSat' WHEN 1 THEN 'GOSAT' ELSE 'OCO2' END AS satellite,
       strftime(acq_time, '%Y%m%d%H%M%S') AS t, lon, lat, xco2, quality_flag FROM obs WHERE source_index % 9 <> 0""",
)
def _(spark, sf_dir):
    o = views.obs(spark, sf_dir)
    k = F.col("source_index")
    stamp = (
        F.when(k % 4 == 0, F.unix_timestamp("acq_time").cast("string")).when(k % 4 == 1, F.date_format("acq_time", "yyyyMMddHHmmss"))
        .when(k % 4 == 2, F.date_format("acq_time", "yyyy-MM-dd HH:mm:ss")).otherwise((F.unix_timestamp("acq_time") - 1672531200).cast("string"))
    )
    df = o.select(
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), stamp.alias("time"), F.when(k % 9 == 0, float("nan")).otherwise(F.col("xco2")).alias("xco2_no_bias_correction"),
        F.col("quality_flag").alias("retr_flag"), F.when(k % 3 == 0, "TANSAT mission").when(k % 3 == 1, "GOSAT").otherwise("").alias("platform"),
        F.when(k % 4 == 3, "seconds since 2023-01-01").alias("units"), F.lit("s3://b/oco2_x.nc4").alias("source_uri"), "source_index",
    )
    out = observations.normalize_xco2(df, "platform", "units")
    return out.select("observation_id", "satellite", F.date_format("acq_time", "yyyyMMddHHmmss").alias("t"), "lon", "lat", "xco2", "quality_flag")


@query("a21_product_guard", "SELECT satellite, count(*) AS n FROM obs WHERE lower(satellite) <> 'tansat' GROUP BY 1")
def _(spark, sf_dir):
    return observations.foreign_satellites(views.obs(spark, sf_dir))


@query("a21_resolve_product", "SELECT 'tansat' AS product_type, count(*) AS n FROM obs WHERE satellite = 'TanSat'")
def _(spark, sf_dir):
    own = views.obs(spark, sf_dir).filter("satellite = 'TanSat'")
    return observations.resolve_product(own, "TanSat-XCO2").groupBy("product_type").agg(F.count("satellite").alias("n"))


# --- load documents -----------------------------------------------------------


def documents(spark, sf_dir):
    """One load document per order: a scene with an asset and the order's bands (some without any)."""
    s = views.scenes(spark, sf_dir)
    b = views.bands(spark, sf_dir)
    code = F.when(F.col("display_order") % 3 != 0, F.col("band_code"))
    band = F.struct(F.col("display_order").alias("o"), F.col("pos").alias("p"), code.alias("band_code"), F.lit(None).cast("string").alias("band_name"), F.lit(None).cast("string").alias("band_type"), F.col("display_order").alias("source_band_index"))
    per = b.groupBy("asset_id").agg(F.sort_array(F.collect_list(band)).alias("bands"))
    rows = s.join(per, "asset_id", "left")
    asset = F.array(F.struct(F.concat(F.lit("s3://b/"), "asset_id").alias("source_uri"), F.lit("x").alias("checksum"), "bands"))
    scene = F.array(F.struct(F.col("scene_id").alias("scene_key"), F.date_format("acq_time", "yyyy-MM-dd").alias("acquisition_time"), asset.alias("assets")))
    dataset = F.array(F.struct(F.col("dataset_id").alias("dataset_code"), F.lit("t").alias("dataset_title"), F.lit("radar").alias("data_type"), scene.alias("scenes")))
    return rows.select(F.to_json(F.struct(F.concat(F.lit("L"), "pos").alias("load_batch_id"), F.lit("n").alias("batch_name"), dataset.alias("datasets"))).alias("doc"))


@query(
    "a22_flatten_load",
    """SELECT 'scenes' AS part, dataset_id AS key, count(*) AS n FROM scenes GROUP BY 2 UNION ALL SELECT 'assets', 'all', count(*) FROM scenes
       UNION ALL SELECT 'batches', 'all', count(*) FROM scenes UNION ALL SELECT 'bands', 'all', count(*) FROM (SELECT s.pos FROM scenes s LEFT JOIN bands b USING (asset_id))""",
)
def _(spark, sf_dir):
    # Four tables are counted: the documents are made and parsed once, and the tables read from the nested rows.
    t = loads.load_tables(stage(loads.parse_load(documents(spark, sf_dir)), "load-documents"))
    n = F.count("*").alias("n")
    total = lambda name: t[name].agg(F.lit(name).alias("part"), F.lit("all").alias("key"), n)
    per = t["scenes"].groupBy(F.lit("scenes").alias("part"), F.col("dataset_code").alias("key")).agg(n)
    return per.unionByName(total("assets")).unionByName(total("batches")).unionByName(total("bands"))


@query(
    "a23_band_defaults",
    """SELECT 'L' || substr(asset_id, 2) AS load_batch_id, CASE WHEN display_order IS NULL OR display_order % 3 = 0 THEN 'auto-radar-' || substr(sha256('radar' || chr(0) || 's3://b/' || asset_id), 1, 12) || '-' || n ELSE band_code END AS band_code,
         'polarization' AS band_type, coalesce(display_order, n) AS source_band_index, n AS display_order
       FROM (SELECT s.asset_id, b.band_code, b.display_order, row_number() OVER (PARTITION BY s.asset_id ORDER BY b.display_order, b.pos) AS n FROM scenes s LEFT JOIN bands b USING (asset_id))""",
)
def _(spark, sf_dir):
    b = loads.flatten_load(documents(spark, sf_dir))["bands"]
    return b.select("load_batch_id", "band_code", "band_type", F.col("source_band_index").cast("long").alias("source_band_index"), F.col("display_order").cast("long").alias("display_order"))


@query("a23_repeated_band_index", "SELECT 'L' || substr(asset_id, 2) AS load_batch_id, display_order AS source_band_index, count(*) AS n FROM bands JOIN scenes USING (asset_id) GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf_dir):
    out = loads.repeated_band_indexes(loads.flatten_load(documents(spark, sf_dir))["bands"])
    return out.select("load_batch_id", F.col("source_band_index").cast("long").alias("source_band_index"), "n")


@query("a24_row_numbers", "SELECT source_uri, source_index, row_number() OVER (PARTITION BY source_uri ORDER BY source_index) - 1 AS row_index FROM obs")
def _(spark, sf_dir):
    return observations.with_row_index(views.obs(spark, sf_dir), "source_uri", "source_index").select("source_uri", "source_index", "row_index")


@query(
    "a24_index_line_numbers",
    """SELECT 'part=' || k AS file, output_id AS space_code, rows + blanks + 1 AS line_number FROM (SELECT *, row_number() OVER w - 1 AS rows, coalesce(sum(CAST(pos % 17 = 0 AS BIGINT)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS blanks
       FROM (SELECT output_id, pos, pos % 3 AS k FROM index_rows) WINDOW w AS (PARTITION BY k ORDER BY pos, output_id))""",
)
def _(spark, sf_dir):
    """Index rows written as three parts of JSON lines, each cut into files by ranges of its order, with blank lines after every seventeenth scene's, read in small splits."""
    from uuid import uuid4

    from gridloom.plans.rules import index_rows
    from gridloom.session import stage, stage_folder

    base = f"{stage_folder(spark)}/lines-{uuid4().hex}"
    line = F.to_json(F.struct(F.col("output_id").alias("space_code")))
    order = ("part", "pos", "output_id")
    rows = index_rows(spark, sf_dir).select("pos", "output_id", (F.col("pos") % 3).alias("part"), line.alias("value")).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("part", F.explode(F.when(F.col("pos") % 17 == 0, F.array("value", F.lit(" "))).otherwise(F.array("value"))).alias("value"))
    rows.write.partitionBy("part").text(f"{base}/in")
    part = F.regexp_extract("file_path", r"(part=\d+)", 1).alias("file")
    starts = stage(loads.lines_before(spark, f"{base}/in", part), "lines-before")
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        numbered = loads.read_index_rows(spark, f"{base}/in", line_numbers=True).join(F.broadcast(starts), "file_path")
        numbered.select(part, "space_code", (F.col("line_number") + F.col("before")).alias("line_number")).write.parquet(f"{base}/out")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    return spark.read.parquet(f"{base}/out")


@query("a25_fact_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '5-LOW')")
def _(spark, sf_dir):
    from gridloom.operators.query import read_fact

    views.table(spark, sf_dir, "orders")
    return read_fact(spark, f"{sf_dir}/orders.parquet", o_orderstatus="F", o_orderpriority=["1-URGENT", "5-LOW"]).select("o_orderkey", "o_totalprice")


@query("a26_source_budget", "SELECT source_uri, source_index FROM obs WHERE source_index % 3 = 0 ORDER BY source_uri, source_index LIMIT 1500")
def _(spark, sf_dir):
    o = views.obs(spark, sf_dir)
    listed = o.filter(F.col("source_index") % 3 == 0).select("source_index")
    return observations.limit_observations(o, 1500, ["source_uri", "source_index"], listed).select("source_uri", "source_index")
