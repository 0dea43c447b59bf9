"""Queries of upserts, sinks, identities and lifecycle gates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.functions import identity
from gridloom.operators import facts, lifecycle as L
from gridloom.operators import partitioning as P
from gridloom.plans import rules, views
from gridloom.plans.registry import query
from gridloom.plans.relations import register, run_scenes, units
from gridloom.session import stage_folder

# --- upserts -------------------------------------------------------------------

_T = "(SELECT * FROM run_rows WHERE pos % 3 <> 0)"
_S = "(SELECT * FROM run_rows WHERE pos % 2 = 0)"


def _upsert(name, keys, rows, sql):
    """Rows of one kind keyed by ``keys``: a third is missing from the table, half comes anew."""
    columns = ", ".join(keys)

    @query(
        name,
        f"""WITH r AS (SELECT {columns}, max(pos) AS pos FROM {sql} GROUP BY ALL) SELECT {columns}, CASE WHEN pos % 2 = 0 THEN 'new' ELSE 'old' END AS state FROM r WHERE pos % 3 <> 0 OR pos % 2 = 0""",
    )
    def _(spark, sf_dir):
        r = rows(spark, sf_dir).groupBy(*keys).agg(F.max("pos").alias("pos"))
        target, source = r.filter("pos % 3 <> 0").withColumn("state", F.lit("old")), r.filter("pos % 2 = 0").withColumn("state", F.lit("new"))
        return facts.upsert(target, source, keys).select(*keys, "state")


_BAND_SQL = "(SELECT *, 'v' || (pos % 3) AS cube_version, strftime(created_at, '%Y%m') AS time_bucket, 'C' || (pos % 400) AS space_code, 'N' || (pos % 5) AS product_name FROM unit_rows)"


def _band_rows(spark, sf_dir):
    p = F.col("pos")
    return units(spark, sf_dir).withColumns(
        {"cube_version": F.concat(F.lit("v"), p % 3), "time_bucket": F.date_format("created_at", "yyyyMM"), "space_code": F.concat(F.lit("C"), p % 400), "product_name": F.concat(F.lit("N"), p % 5)}
    )


_upsert("i1_upsert_raw_assets", ["scene_id", "band_code", "cube_version"], _band_rows, _BAND_SQL)
_upsert("i2_upsert_cube_facts", ["grid_type", "grid_level", "space_code", "time_bucket", "band_code", "cube_version"], _band_rows, _BAND_SQL)
_upsert("i3_upsert_product_assets", ["product_name", "asset_id", "cube_version"], _band_rows, _BAND_SQL)
_upsert("i4_upsert_product_facts", ["product_name", "grid_type", "grid_level", "space_code", "time_bucket", "cube_version"], _band_rows, _BAND_SQL)
_upsert("i6_upsert_entity_tiles", ["asset_id", "band_code", "grid_type", "grid_level", "space_code", "time_bucket"], _band_rows, _BAND_SQL)


@query(
    "i5_upsert_observations",
    """SELECT satellite, observation_id, product_type, cube_version, max(source_index) AS source_index FROM (SELECT *, 'v' || (source_index % 3) AS cube_version FROM obs)
       WHERE source_index % 4 <> 0 OR source_index >= 5000 GROUP BY 1, 2, 3, 4""",
)
def _(spark, sf_dir):
    o = views.obs(spark, sf_dir).withColumn("cube_version", F.concat(F.lit("v"), F.col("source_index") % 3))
    key = ["satellite", "observation_id", "product_type", "cube_version"]
    o = o.select(*key, "source_index", "xco2")
    stored = facts.last_per(o.filter("source_index < 5000 and source_index % 4 <> 0"), key, F.col("source_index"))
    new = facts.last_per(o.filter("source_index >= 5000"), key, F.col("source_index"))
    return facts.upsert(stored, new, key).select(*key, "source_index")


_NEW = "(SELECT scene_id, CASE WHEN pos % 10 = 0 THEN 'moved' ELSE status END AS status FROM run_rows WHERE pos % 2 = 0 AND pos % 5 = 0)"


@query("i2_upsert_partitioned_table", f"SELECT status, count(*) AS n, sum(v) AS total FROM (SELECT status, 2 AS v FROM {_NEW} UNION ALL SELECT status, 1 FROM run_rows WHERE pos % 3 <> 0 AND scene_id NOT IN (SELECT scene_id FROM {_NEW})) GROUP BY 1")
def _(spark, sf_dir):
    """Two writes to a table partitioned by a column outside the key; the second moves rows to another partition."""
    path = f"{stage_folder(spark).rstrip('/')}/upsert-{uuid.uuid4().hex}"
    r = run_scenes(spark, sf_dir).select("scene_id", "status", "pos")
    facts.upsert_table(spark, path, r.filter("pos % 3 <> 0").withColumn("v", F.lit(1)), ["scene_id"], ["status"])
    new = r.filter("pos % 2 = 0 and pos % 5 = 0").withColumns({"v": F.lit(2), "status": F.when(F.col("pos") % 10 == 0, "moved").otherwise(F.col("status"))})
    facts.upsert_table(spark, path, new, ["scene_id"], ["status"])
    return spark.read.parquet(path).groupBy(F.col("status").cast("string").alias("status")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@register(
    "i7_merge_catalog",
    f"""SELECT coalesce(s.scene_id, t.scene_id) AS scene_id, coalesce(s.output_version, t.output_version) AS output_version, coalesce(t.status, s.status) AS status,
        CASE WHEN s.scene_id IS NOT NULL THEN 'b' ELSE 'a' END AS both_key, CASE WHEN t.scene_id IS NOT NULL THEN t.dataset_id END AS old_key FROM {_T} t FULL JOIN {_S} s USING (scene_id)""",
)
def _(u, r):
    t = r.filter("pos % 3 <> 0").select("scene_id", "output_version", "status", F.create_map(F.lit("k"), F.lit("a"), F.lit("old"), F.col("dataset_id")).alias("attributes"))
    s = r.filter("pos % 2 = 0").select("scene_id", "output_version", "status", F.create_map(F.lit("k"), F.lit("b")).alias("attributes"))
    out = facts.merge_catalog(t, s, ["scene_id"], {"output_version": "coalesce", "status": "keep", "attributes": "merge_map"})
    get = lambda k: F.try_element_at("attributes", F.lit(k))
    return out.select("scene_id", "output_version", "status", get("k").alias("both_key"), get("old").alias("old_key"))


@register("i8_identity_conflicts", "SELECT scene_id, 'v9' AS output_version, output_version AS stored_output_version FROM run_rows WHERE pos % 6 = 0")
def _(u, r):
    source = r.filter("pos % 3 = 0").withColumn("output_version", F.when(F.col("pos") % 6 == 0, "v9").otherwise(F.col("output_version")))
    return facts.identity_conflicts(r, source, ["scene_id"], ["output_version"]).select("scene_id", "output_version", "stored_output_version")


@register("i9_insert_absent", f"SELECT scene_id, status FROM {_T} UNION ALL SELECT scene_id, 'new' FROM {_S} WHERE pos % 3 = 0")
def _(u, r):
    return facts.insert_absent(r.filter("pos % 3 <> 0"), r.filter("pos % 2 = 0").withColumn("status", F.lit("new")), ["scene_id"]).select("scene_id", "status")


@register(
    "i10_reset_if_changed",
    "SELECT scene_id, output_version, CASE WHEN pos % 3 <> 0 AND pos % 5 <> 0 THEN status ELSE 'pending' END AS status FROM (SELECT *, 1 AS x FROM run_rows) WHERE true",
)
def _(u, r):
    source = r.withColumn("load_batch_id", F.when(F.col("pos") % 5 == 0, "other").otherwise(F.col("load_batch_id")))
    out = facts.reset_if_changed(r.filter("pos % 3 <> 0"), source, ["scene_id"], ["load_batch_id", "output_version"], {"status": "pending"})
    return out.select("scene_id", "output_version", "status")


@register("i11_requeue_units", "SELECT scene_id, CASE WHEN pos % 2 = 0 AND status IN ('failed', 'cancelled') THEN 'pending' ELSE status END AS status FROM run_rows")
def _(u, r):
    return facts.requeue_units(r, r.filter("pos % 2 = 0"), ["scene_id"]).select("scene_id", "status")


@register("i12_propagate_status", "SELECT scene_id, CASE WHEN pos % 4 = 1 THEN 'moved' ELSE status END AS status FROM run_rows")
def _(u, r):
    doc = F.concat(F.lit('{"scene":"'), F.col("scene_id"), F.lit('"}'))
    updates = r.filter("pos % 4 = 1").select(F.get_json_object(doc, "$.scene").alias("scene_id"), F.lit("moved").alias("status"))
    return facts.propagate_status(r, updates, ["scene_id"]).select("scene_id", "status")


@register("i13_advance_status", "SELECT scene_id, CASE WHEN status = 'queued' THEN 'running' ELSE status END AS status FROM run_rows")
def _(u, r):
    return facts.advance_status(r, r.select("scene_id", F.lit("running").alias("status")), ["scene_id"]).select("scene_id", "status")


@register("i14_verify_written", "SELECT partition_run_id, count(*) + CASE WHEN CAST(substr(partition_run_id, 2) AS INTEGER) % 9 = 0 THEN 1 ELSE 0 END AS expected, count(*) AS stored, CAST(substr(partition_run_id, 2) AS INTEGER) % 9 <> 0 AS ok FROM run_rows GROUP BY 1")
def _(u, r):
    odd = F.when(F.substring("partition_run_id", 2, 9).cast("int") % 9 == 0, 1).otherwise(0)
    expected = r.groupBy("partition_run_id").agg(F.count("*").alias("n")).select("partition_run_id", (F.col("n") + odd).alias("expected"))
    return facts.verify_written(r, expected, ["partition_run_id"]).select("partition_run_id", "expected", "stored", "ok")


@query("i15_job_report", "SELECT 'partition' AS job, count(*) AS rows, count(DISTINCT space_code) AS cells, count(DISTINCT scene_id) AS scenes, min(time_bucket) AS first_bucket, max(time_bucket) AS last_bucket FROM index_rows")
def _(spark, sf_dir):
    return facts.job_report(rules.index_rows(spark, sf_dir), "partition")


@query("i16_object_key", "SELECT scene_id, 'cube/dataset=' || dataset_id || '/sensor=' || replace(priority, ' ', '_') || '/acq_date=' || strftime(acq_time, '%Y-%m-%d') || '/scene_id=' || scene_id || '/version=v1/' || scene_id || '.tif' AS object_key FROM scenes")
def _(spark, sf_dir):
    s = views.scenes(spark, sf_dir).withColumns({"acq_date": F.date_format("acq_time", "yyyy-MM-dd"), "version": F.lit("v1"), "file": F.concat(F.lit("s3://x/y/"), "scene_id", F.lit(".tif"))})
    fields = {"dataset": "dataset_id", "sensor": "priority", "acq_date": "acq_date", "scene_id": "scene_id", "version": "version"}
    return facts.with_object_key(s, "cube/", fields, "file").select("scene_id", "object_key")


@query("i18_asset_uri_map", "SELECT asset_path, 'root/dataset=d/sensor=s/acq_date=' || strftime(arg_min(acq_time, pos), '%Y-%m-%d') || '/scene_id=' || arg_min(scene_id, pos) || '/version=v/' || asset_path AS asset_uri FROM (SELECT *, 'P' || (pos % 700) AS asset_path FROM scenes) GROUP BY 1")
def _(spark, sf_dir):
    s = views.scenes(spark, sf_dir).withColumn("asset_path", F.concat(F.lit("P"), F.col("pos") % 700))
    return facts.asset_uri_map(s, "root", "d", "s", "v", "pos")


# --- identities ------------------------------------------------------------------


def _identity_sql(asset, band, level, topology, bucket, window, version="output_version", grid="grid_type"):
    """Hash of the identity JSON of an output, field by field in contract order."""
    field = lambda name, value: f"""'"{name}":"' || {value} || '"'"""
    parts = [field("dataset_id", "dataset_id"), field("output_version", version), field("source_asset_id", asset), field("band_code", band), field("grid_type", grid), f"""'"grid_level":' || {level}"""]
    parts += [field("space_code", "space_code"), f"""'"topology_code":' || coalesce('"' || {topology} || '"', 'null')""", field("time_bucket", bucket), field("window_identity", window)]
    return "sha256('{' || " + " || ',' || ".join(parts) + " || '}')"


_K5_VERSION = "substr(sha256(dataset_id || chr(0) || scene_id), 1, 32)"
_K5_TOPOLOGY = "CASE WHEN pos % 2 = 0 THEN 'topo-v1:' || space_code END"


@query("k5_output_ids", f"SELECT scene_id, space_code, pos, {_K5_VERSION} AS output_version, {_identity_sql('source_asset_id', 'band_code', 'grid_level', _K5_TOPOLOGY, 'time_bucket', chr(39) + 'logical-window' + chr(39), _K5_VERSION)} AS output_id FROM index_rows")
def _(spark, sf_dir):
    i = rules.index_rows(spark, sf_dir).drop("output_version", "output_id").withColumn("topology_code", F.when(F.col("pos") % 2 == 0, F.concat(F.lit("topo-v1:"), "space_code")))
    return identity.with_output_ids(i, "dataset_id", "scene_id", window_identity=F.lit("logical-window")).select("scene_id", "space_code", "pos", "output_version", "output_id")


@register(
    "k6_identities",
    """SELECT scene_id, sha256(dataset_id || chr(0) || scene_id) AS scene_identity, 'asset-' || substr(sha256('s3://' || scene_id), 1, 32) AS asset_identity,
       'band-' || substr(sha256(sha256(dataset_id || chr(0) || scene_id) || chr(0) || 'asset-' || substr(sha256('s3://' || scene_id), 1, 32) || chr(0) || status), 1, 32) AS band_unit_id FROM run_rows""",
)
def _(u, r):
    out = identity.with_identity(r.withColumn("uri", F.concat(F.lit("s3://"), "scene_id")), "dataset_id", "scene_id", "uri", "status")
    return out.select("scene_id", "scene_identity", "asset_identity", "band_unit_id")


@register("k7_idempotency_key", "SELECT scene_id, sha256(dataset_id || chr(0) || coalesce(output_version, '') || chr(0) || CASE WHEN load_batch_id < 'L5' THEN load_batch_id || ',L5' WHEN load_batch_id = 'L5' THEN 'L5' ELSE 'L5,' || load_batch_id END) AS key FROM run_rows")
def _(u, r):
    ids = F.array(F.lit("L5"), F.col("load_batch_id"), F.lit("L5"))
    return r.select("scene_id", identity.idempotency_key(["dataset_id", "output_version"], [ids]).alias("key"))


# --- versions and gates -------------------------------------------------------------

_VERSIONS = "(SELECT dataset_id, output_version, max(pos) AS tile_count, max(created_at) AS completed_at, CASE WHEN output_version = 'v1' THEN 'completed' ELSE 'running' END AS status FROM run_rows WHERE output_version IS NOT NULL GROUP BY 1, 2)"


def versions(r):
    v = r.filter("output_version is not null").groupBy("dataset_id", "output_version").agg(F.max("pos").alias("tile_count"), F.max("created_at").alias("completed_at"))
    return v.withColumns({"status": F.when(F.col("output_version") == "v1", "completed").otherwise("running"), "index_count": F.lit(0), "grid_cell_count": F.lit(0)})


@register("k8_complete_output_pointer", f"SELECT dataset_id, coalesce(n, 'v1') AS current_output_version, CASE WHEN n IS NULL THEN 'pass' ELSE 'pending' END AS quality_status FROM (SELECT DISTINCT dataset_id FROM run_rows) LEFT JOIN (SELECT dataset_id, arg_max(output_version, (completed_at, output_version)) AS n FROM {_VERSIONS} WHERE output_version <> 'v1' GROUP BY 1) USING (dataset_id)")
def _(u, r):
    v = versions(r)
    d = r.select("dataset_id").distinct().withColumns({"current_output_version": F.lit("v1"), "quality_status": F.lit("pass")})
    return L.complete_outputs(d, v, v.filter("output_version <> 'v1'"))[0]


@register("k8_complete_output_versions", f"""SELECT dataset_id, output_version, CASE WHEN output_version = n THEN 'completed' ELSE 'superseded' END AS status, tile_count + CASE WHEN output_version <> 'v1' THEN 1 ELSE 0 END AS tile_count
    FROM {_VERSIONS} JOIN (SELECT dataset_id, arg_max(output_version, (completed_at, output_version)) AS n FROM {_VERSIONS} WHERE output_version <> 'v1' GROUP BY 1) USING (dataset_id)""")
def _(u, r):
    v = versions(r)
    d = r.select("dataset_id").distinct().withColumns({"current_output_version": F.lit("v1"), "quality_status": F.lit("pass")})
    out = L.complete_outputs(d, v, v.filter("output_version <> 'v1'").withColumn("tile_count", F.col("tile_count") + 1))[1]
    return out.select("dataset_id", "output_version", "status", "tile_count")


@register("k8_current_units", "SELECT dataset_id, band_unit_id, arg_max(v, (created_at, v)) AS output_version FROM (SELECT *, 'v' || (pos % 4) AS v FROM unit_rows WHERE partition_status = 'completed') GROUP BY 1, 2")
def _(u, r):
    o = u.withColumns({"output_version": F.concat(F.lit("v"), F.col("pos") % 4), "status": F.col("partition_status"), "completed_at": F.col("created_at")})
    return L.current_units(o).select("dataset_id", "band_unit_id", "output_version")


@register("k9_resolve_version", "SELECT scene_id, coalesce(output_version, c) AS output_version FROM run_rows JOIN (SELECT dataset_id, max(output_version) AS c FROM run_rows GROUP BY 1) USING (dataset_id)")
def _(u, r):
    current = r.groupBy("dataset_id").agg(F.max("output_version").alias("current_output_version"))
    return L.resolve_version(r.withColumnRenamed("output_version", "requested_version"), current).select("scene_id", "output_version")


# Every third row is of a hexagon output, whose tiles are files.
_K10 = "(SELECT * REPLACE (CASE WHEN pos % 3 = 0 THEN 'isea4h' ELSE grid_type END AS grid_type) FROM index_rows)"
_K10_ID = _identity_sql("source_asset_id", "band_code", "grid_level", "CAST(NULL AS VARCHAR)", "time_bucket", "CASE WHEN grid_type = 'isea4h' THEN 'entity' ELSE 'logical-window' END")


@query(
    "k10_build_outputs",
    f"""WITH r AS (SELECT *, {_K10_ID} AS id FROM {_K10}),
        c AS (SELECT dataset_id, output_version, grid_type, grid_level, space_code, min(source_asset_id) AS asset, count(*) AS n FROM {_K10} GROUP BY ALL)
        SELECT 'tile' AS part, id AS output_id, NULL AS tile_output_id, CASE WHEN grid_type = 'isea4h' THEN 'entity_file' ELSE 'logical_reference' END AS kind, 1 AS n FROM r
        UNION ALL SELECT 'index', id || '-index', CASE WHEN grid_type = 'isea4h' THEN id END, NULL, 1 FROM r
        UNION ALL SELECT 'cell', {_identity_sql('asset', "'_cell'", 'grid_level', 'CAST(NULL AS VARCHAR)', "'_'", "'cell'")}, NULL, NULL, n FROM c""",
)
def _(spark, sf_dir):
    i = rules.index_rows(spark, sf_dir).withColumn("grid_type", F.when(F.col("pos") % 3 == 0, "isea4h").otherwise(F.col("grid_type"))).drop("output_id", "tile_output_id")
    tiles, indexes, cells = P.build_outputs(i, band="band_code")
    none, one = F.lit(None).cast("string"), F.lit(1).cast("long")
    out = tiles.select(F.lit("tile").alias("part"), "output_id", none.alias("tile_output_id"), F.col("tile_kind").alias("kind"), one.alias("n"))
    out = out.unionByName(indexes.select(F.lit("index").alias("part"), "output_id", "tile_output_id", none.alias("kind"), one.alias("n")))
    return out.unionByName(cells.select(F.lit("cell").alias("part"), "output_id", none.alias("tile_output_id"), none.alias("kind"), F.col("tile_count").alias("n")))


@query("k11_observation_bucket", "SELECT source_index, strftime(acq_time, '%Y%m%d') || '-' || lpad(CAST(source_index AS VARCHAR), 9, '0') AS time_bucket FROM obs")
def _(spark, sf_dir):
    from gridloom.functions.timecode import time_bucket

    return views.obs(spark, sf_dir).select("source_index", P.observation_bucket(time_bucket("acq_time"), F.col("source_index")).alias("time_bucket"))


@query("k12_id_conflicts", "SELECT observation_id, count(DISTINCT (satellite, quality_flag)) AS versions FROM obs GROUP BY 1 HAVING count(DISTINCT (satellite, quality_flag)) > 1")
def _(spark, sf_dir):
    return L.id_conflicts(views.obs(spark, sf_dir).select("observation_id", "satellite", "quality_flag"), "observation_id")


_LAST = """(SELECT partition_run_id AS run_id, dataset_id, scene_id, asset_id, band_unit_id, grid_level AS attempt, partition_status AS status, CASE WHEN pos % 7 = 0 THEN 'completed' ELSE 'failed' END AS dataset_status,
    max(grid_level) OVER (PARTITION BY partition_run_id) AS last FROM unit_rows)"""


def _attempts(u):
    return u.select(
        F.col("partition_run_id").alias("run_id"), "dataset_id", "asset_id", "band_unit_id", F.col("grid_level").alias("attempt"), F.col("partition_status").alias("status"),
        F.when(F.col("pos") % 7 == 0, "completed").otherwise("failed").alias("dataset_status"),
    )


for _n, _mode, _cond in (("k13_retry_failed", "failed", "status = 'failed'"), ("k13_retry_unfinished", "unfinished", "status <> 'completed'")):
    register(
        _n,
        f"SELECT run_id, band_unit_id, attempt, status FROM {_LAST} WHERE attempt = last AND dataset_status <> 'completed' AND {_cond}",
    )(lambda u, r, m=_mode: L.retry_units(_attempts(u), m).select("run_id", "band_unit_id", "attempt", "status"))


@register(
    "k13_retry_inputs",
    f"""WITH told AS (SELECT DISTINCT dataset_id FROM unit_rows WHERE CAST(substr(dataset_id, 2) AS INTEGER) % 2 = 0), again AS (SELECT DISTINCT dataset_id, band_unit_id FROM {_LAST} WHERE attempt = last AND dataset_status <> 'completed' AND status = 'failed'),
        b AS (SELECT DISTINCT dataset_id, asset_id, band_unit_id FROM unit_rows WHERE dataset_id NOT IN (FROM told) OR (dataset_id, band_unit_id) IN (FROM again))
        SELECT 'band' AS part, dataset_id, band_unit_id AS id FROM b UNION ALL SELECT DISTINCT 'asset', dataset_id, asset_id FROM unit_rows WHERE dataset_id NOT IN (FROM told) OR (dataset_id, asset_id) IN (SELECT dataset_id, asset_id FROM b)""",
)
def _(u, r):
    bands = u.select("dataset_id", F.col("asset_id").alias("source_asset_id"), "band_unit_id").distinct()
    assets = bands.select("dataset_id", "source_asset_id").distinct()
    reported = bands.filter(F.substring("dataset_id", 2, 9).cast("int") % 2 == 0)
    b, a = L.retry_inputs(bands, assets, reported, L.retry_units(_attempts(u)))
    return b.select(F.lit("band").alias("part"), "dataset_id", F.col("band_unit_id").alias("id")).unionByName(a.select(F.lit("asset").alias("part"), "dataset_id", F.col("source_asset_id").alias("id")))


_TEXTS = ("GridLimitExceeded: 9", "No such key: x", "Connection reset by peer", "value must be positive", "403 Forbidden", "boom", "HTTP 503 for url", "missing invalid thing")
_CLASSES = ("grid_limit", "source_missing", "transient", "validation", "permission", "unknown", "transient", "source_missing")


@register("k14_error_classes", "SELECT error_class, count(*) AS n FROM (SELECT [" + ", ".join(f"'{c}'" for c in _CLASSES) + "][pos % 8 + 1] AS error_class FROM run_rows) GROUP BY 1")
def _(u, r):
    texts = F.array(*[F.lit(t) for t in _TEXTS])
    return L.classify_errors(r.select(F.element_at(texts, (F.col("pos") % 8 + 1).cast("int")).alias("error")), "error")


_GATE = "(SELECT DISTINCT dataset_id, CASE WHEN x % 7 = 0 THEN NULL ELSE 'v' || (x % 3 + 1) END AS cur, ['pass', 'warn', 'fail', 'pass'][x % 4 + 1] AS q, x % 11 <> 0 AS active, x % 5 <> 0 AS auto_ok, x % 2 = 0 AS warn_ok FROM (SELECT dataset_id, CAST(substr(dataset_id, 2) AS INTEGER) AS x FROM run_rows))"


def gates(r):
    x = F.substring("dataset_id", 2, 9).cast("int")
    return r.select("dataset_id").distinct().select(
        "dataset_id", F.when(x % 7 != 0, F.concat(F.lit("v"), x % 3 + 1)).alias("current_output_version"), F.when(x % 11 != 0, "active").otherwise("archived").alias("dataset_status"),
        (x % 5 != 0).alias("auto_ingest"), (x % 2 == 0).alias("allow_warn"), F.element_at(F.array(*[F.lit(v) for v in ("pass", "warn", "fail", "pass")]), x % 4 + 1).alias("quality_status"), F.concat(F.lit("Q"), x).alias("quality_run_id"),
    )


# Fixed marks on the rows: runs, scenes, units and quality runs that break one condition each.
_UNIT_OK = "u.partition_status = 'completed' AND u.quality_status IN ('pass', 'warn')"
_RUN_OK = "CAST(substr(r.partition_run_id, 2) AS INTEGER) % 6 <> 1"


def partition_runs(r):
    return r.select("partition_run_id").distinct().withColumn("status", F.when(F.substring("partition_run_id", 2, 9).cast("int") % 6 == 1, "running").otherwise("completed"))


@register(
    "k15_plan_ingest",
    f"""SELECT DISTINCT r.partition_run_id, u.band_unit_id, r.dataset_id, r.scene_id FROM run_rows r JOIN {_GATE} g USING (dataset_id) JOIN unit_rows u ON u.scene_id = r.scene_id AND u.partition_run_id = r.partition_run_id
        WHERE r.status = 'completed' AND r.output_version = g.cur AND (q = 'pass' OR (q = 'warn' AND warn_ok)) AND active AND auto_ok AND {_UNIT_OK} AND {_RUN_OK}""",
)
def _(u, r):
    g = gates(r)
    d = g.drop("quality_status", "quality_run_id")
    out = L.plan_ingest(d, r, g.select("dataset_id", "quality_status", "quality_run_id"), partition_runs(r), u)
    return out.select("partition_run_id", "band_unit_id", "dataset_id", "scene_id")


def _quality_runs(r):
    """Three runs for each dataset and version: an older good one for some, then a failed and an incomplete one."""
    x = F.substring("dataset_id", 2, 9).cast("int")
    rows = r.select("dataset_id", "output_version").filter("output_version is not null").distinct().withColumn("n", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    status = F.when(F.col("n") == 1, F.when(x % 4 == 2, "fail").when(x % 4 == 1, "warn").otherwise("pass")).when(F.col("n") == 2, "fail").otherwise("pass")
    return rows.select(
        "dataset_id", "output_version", F.concat_ws(":", "dataset_id", "output_version", "n").alias("quality_run_id"), status.alias("status"), (F.col("n") < 3).alias("result_complete"),
        F.timestamp_seconds(F.col("n") * 1000).alias("created_at"), F.when(F.col("n") != 1, F.timestamp_seconds(F.col("n") * 1000)).alias("completed_at"),
    )


def _manual(u, r):
    selected = u.filter("pos % 3 = 0").select("partition_run_id", "band_unit_id").distinct()
    return L.plan_manual_ingest(_quality_runs(r), partition_runs(r), r, u, selected)


_CHOSEN = "(SELECT DISTINCT partition_run_id, band_unit_id FROM unit_rows WHERE pos % 3 = 0)"
_GOOD = f"""SELECT DISTINCT u.partition_run_id, u.band_unit_id, r.dataset_id || ':' || r.output_version || ':1' AS quality_run_id FROM unit_rows u JOIN run_rows r USING (partition_run_id, scene_id) JOIN {_CHOSEN} c ON c.partition_run_id = u.partition_run_id AND c.band_unit_id = u.band_unit_id
    WHERE {_UNIT_OK} AND u.ingest_status <> 'completed' AND r.status = 'completed' AND {_RUN_OK} AND r.output_version IS NOT NULL AND CAST(substr(r.dataset_id, 2) AS INTEGER) % 4 <> 2"""
register("k16_manual_ingest", _GOOD)(lambda u, r: _manual(u, r)[0].select("partition_run_id", "band_unit_id", "quality_run_id"))
register("k16_manual_ingest_refused", f"SELECT partition_run_id, band_unit_id FROM {_CHOSEN} EXCEPT (SELECT partition_run_id, band_unit_id FROM ({_GOOD}))")(lambda u, r: _manual(u, r)[1].select("partition_run_id", "band_unit_id"))


@register(
    "k17_publication_eligibility",
    """SELECT dataset_id, reason IS NULL AS eligible, reason FROM (SELECT dataset_id, CASE WHEN x % 7 = 0 THEN 'no_current_output' WHEN x % 13 = 1 THEN 'output_not_completed' WHEN x % 9 = 2 THEN 'quality_run_not_complete'
         WHEN x % 4 = 1 AND x % 8 <> 1 THEN 'warn_not_approved' WHEN x % 4 = 2 THEN 'quality_status' WHEN x % 5 = 3 THEN 'ingest_not_completed' WHEN x % 3 = 0 THEN 'ingest_of_other_version' END AS reason
       FROM (SELECT DISTINCT dataset_id, CAST(substr(dataset_id, 2) AS INTEGER) AS x FROM run_rows))""",
)
def _(u, r):
    x = F.substring("dataset_id", 2, 9).cast("int")
    g = gates(r).withColumn("x", x)
    t = {
        "datasets": g.select("dataset_id", "current_output_version", F.col("quality_run_id").alias("current_quality_run_id")),
        "versions": g.select("dataset_id", F.col("current_output_version").alias("output_version"), F.when(x % 13 == 1, "running").otherwise("completed").alias("status")),
        "quality_runs": g.select("quality_run_id", "dataset_id", F.col("current_output_version").alias("output_version"), F.col("quality_status").alias("status"), (x % 9 != 2).alias("result_complete"), F.lit("r1").alias("rule_set_version")),
        "approvals": g.filter(x % 4 == 1).select("quality_run_id", F.when(x % 8 == 1, "r1").otherwise("r0").alias("rule_set_version")),
        "partition_runs": g.sparkSession.createDataFrame([("done", "completed"), ("open", "running")], "partition_run_id string, status string"),
    }
    run = g.select("dataset_id", F.concat(F.lit("I"), "dataset_id").alias("ingest_run_id"), F.lit("done").alias("partition_run_id"), F.lit(1).alias("created_at"), F.when(x % 5 == 3, "failed").otherwise("completed").alias("status"))
    # A newer run of a partition run that is still going must not count.
    newer = run.select("dataset_id", F.concat(F.lit("N"), "dataset_id").alias("ingest_run_id"), F.lit("open").alias("partition_run_id"), F.lit(2).alias("created_at"), F.when(x % 2 == 0, "failed").otherwise("completed").alias("status"))
    t["ingest_runs"] = run.unionByName(newer)
    scenes = r.select("dataset_id", "scene_id").join(g.select("dataset_id", "current_output_version"), "dataset_id")
    t["ingest_scenes"] = scenes.select(F.concat(F.lit("I"), "dataset_id").alias("ingest_run_id"), F.lit("completed").alias("status"), F.when(x % 3 == 0, "v0").otherwise(F.col("current_output_version")).alias("output_version"))
    return L.publication_eligibility(t)


@register(
    "k18_check_targets",
    """SELECT source_asset_id, band_code, 'not_in_dataset' AS reason FROM (SELECT DISTINCT asset_id AS source_asset_id, band_code FROM unit_rows WHERE pos % 5 = 0) t WHERE NOT EXISTS (SELECT 1 FROM unit_rows u WHERE u.asset_id = t.source_asset_id AND u.band_code = t.band_code AND grid_level = 3)
       UNION ALL SELECT source_asset_id, band_code, 'not_partitioned' FROM (SELECT DISTINCT asset_id AS source_asset_id, band_code FROM unit_rows WHERE pos % 5 = 0) t WHERE EXISTS (SELECT 1 FROM unit_rows u WHERE u.asset_id = t.source_asset_id AND u.band_code = t.band_code AND grid_level = 3)
         AND NOT EXISTS (SELECT 1 FROM unit_rows u WHERE u.asset_id = t.source_asset_id AND u.band_code = t.band_code AND partition_status = 'completed')""",
)
def _(u, r):
    x = u.withColumnRenamed("asset_id", "source_asset_id")
    key = ["dataset_id", "source_asset_id", "band_code"]
    out = L.check_targets(x.filter("pos % 5 = 0").select(*key).distinct(), x.filter("grid_level = 3"), x.filter("partition_status = 'completed'"))
    return out.select("source_asset_id", "band_code", "reason")


@register(
    "k19_cleanup_candidates",
    f"""SELECT dataset_id, output_version FROM {_VERSIONS} WHERE output_version <> 'v2' AND NOT (output_version = 'v3' AND CAST(substr(dataset_id, 2) AS INTEGER) % 2 = 0) AND tile_count % 10 NOT IN (3, 4, 5, 6, 7)
        AND completed_at + INTERVAL 2 DAY * (CASE WHEN tile_count % 3 = 1 THEN 1 ELSE 0 END) <= TIMESTAMP '2001-12-20'""",
)
def _(u, r):
    """Versions that completed, that failed, or that did both; manifests with one fault each."""
    v, n, at = versions(r), F.col("tile_count"), F.col("completed_at")
    prefix = F.concat(F.lit("outputs/"), "dataset_id", F.lit("/"), "output_version", F.lit("/"))
    v = v.withColumns({"object_prefix": prefix, "failed_at": F.when(n % 3 == 1, at + F.expr("INTERVAL 2 DAYS")).when(n % 3 == 2, at), "completed_at": F.when(n % 3 != 2, at)})
    held = v.select("dataset_id", "output_version", "tile_count", prefix.alias("p"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("part")).withColumns({"object_key": F.concat("p", "part"), "byte_size": F.lit(7), "checksum": F.lit("c")})
    last = F.endswith("object_key", F.lit("b"))
    named = held.withColumns({
        "object_key": F.when(last & (n % 10 == 3), F.concat(F.lit("x"), "object_key")).when(last & (n % 10 == 4), F.concat("object_key", F.lit("?"))).otherwise(F.col("object_key")),
        "byte_size": F.when(n % 10 == 5, 8).otherwise(7), "checksum": F.when(n % 10 == 6, "d").otherwise("c"),
    })
    named = named.unionByName(named.filter((n % 10 == 7) & last))
    d = r.select("dataset_id").distinct().withColumn("current_output_version", F.lit("v2"))
    p = d.filter(F.substring("dataset_id", 2, 9).cast("int") % 2 == 0).select("dataset_id", F.lit("v3").alias("output_version"))
    return L.cleanup_candidates(v, d, p, held, named, "2001-12-20").select("dataset_id", "output_version")


@register(
    "k20_claimable_groups",
    """SELECT dataset_id, output_version, strftime(min(created_at), '%Y%m%d') AS oldest, count(*) AS n_rows FROM (SELECT *, ['queued', 'running', 'completed'][CAST(substr(partition_run_id, 2) AS INTEGER) % 3 + 1] AS run_status FROM run_rows)
       WHERE (status = 'queued' AND run_status IN ('queued', 'running')) OR (status = 'running' AND run_status = 'running' AND created_at < TIMESTAMP '1997-06-01' - INTERVAL 5 MINUTE) GROUP BY 1, 2""",
)
def _(u, r):
    state = F.element_at(F.array(*map(F.lit, ("queued", "running", "completed"))), F.substring("partition_run_id", 2, 9).cast("int") % 3 + 1)
    rows = r.withColumns({"ingest_run_id": F.concat_ws("/", "partition_run_id", "dataset_id"), "updated_at": F.col("created_at")})
    runs = rows.select("ingest_run_id", "dataset_id", state.alias("status")).distinct()
    return L.claimable_groups(rows.drop("dataset_id"), runs, F.lit("1997-06-01").cast("timestamp"), None).withColumn("oldest", F.date_format("oldest", "yyyyMMdd"))


@register("k21_filter_listing", "SELECT scene_id FROM run_rows WHERE (scene_id ILIKE '%s12%' OR dataset_id ILIKE '%s12%') AND status = 'completed' AND created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '2000-01-01'")
def _(u, r):
    return L.filter_listing(r, "s12", ("scene_id", "dataset_id"), {"status": "completed"}, ("created_at", "1996-01-01", "2000-01-01")).select("scene_id")


# Runs with and without a grid of their own, with and without listed units; versions, quality and ingest runs of the same scenes.
_K22 = {
    "runs": """SELECT *, CASE pos % 5 WHEN 0 THEN '{"grid_type":"geohash","requested_grid_level":' || (3 + pos % 2) || ',"band_unit_ids":["A' || pos || ':b1","",null,"U' || pos % 40 || '"]}'
        WHEN 1 THEN '{"grid_type":"isea4h","requested_grid_level":5}' WHEN 2 THEN '{"grid_type":"mgrs","band_unit_ids":[]}' WHEN 3 THEN '{}' END AS grid_config,
        CAST(pos % 3 AS INTEGER) AS attempt_count, CASE WHEN status = 'failed' THEN 'E' || pos END AS error_message FROM run_rows""",
    "versions": "SELECT DISTINCT dataset_id, output_version, CASE WHEN CAST(substr(output_version, 2) AS INTEGER) = 3 THEN 'entity' ELSE 'mgrs' END AS grid_type, 2 AS requested_grid_level FROM run_rows WHERE output_version IS NOT NULL",
    "quality": "SELECT dataset_id, output_version, pos, CASE WHEN pos % 4 > 0 THEN created_at END AS completed_at, created_at, CASE pos % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'warn' ELSE 'fail' END AS status FROM run_rows WHERE output_version IS NOT NULL AND pos % 7 > 2",
    "ingest": "SELECT scene_id, output_version, created_at AS updated_at, '[\"A' || pos || ':b1\",\"A' || pos || ':b2\",\"A' || pos || ':b1\"]' AS band_unit_ids, CASE WHEN pos % 2 = 0 THEN 'completed' ELSE 'failed' END AS status FROM run_rows WHERE output_version IS NOT NULL AND pos % 3 > 0",
    "kept": "SELECT band_unit_id, 'mgrs' AS grid_type, 2 AS grid_level, 'old' AS partition_status FROM unit_rows WHERE grid_level = 3 AND band_code = 'b2'",
}


def _k22(spark, sf_dir):
    """The tables of the backfill; quality runs have distinct times in a version."""
    r, u, k = run_scenes(spark, sf_dir), units(spark, sf_dir), F.col("pos")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    config = (
        F.when(k % 5 == 0, text('{"grid_type":"geohash","requested_grid_level":', 3 + k % 2, ',"band_unit_ids":["A', k, ':b1","",null,"U', k % 40, '"]}'))
        .when(k % 5 == 1, '{"grid_type":"isea4h","requested_grid_level":5}').when(k % 5 == 2, '{"grid_type":"mgrs","band_unit_ids":[]}').when(k % 5 == 3, "{}")
    )
    runs = r.withColumns({"grid_config": config, "attempt_count": (k % 3).cast("int"), "error_message": F.when(F.col("status") == "failed", text("E", k))})
    some = r.filter("output_version is not null")
    third = F.substring("output_version", 2, 9).cast("int") == 3
    versions = some.select("dataset_id", "output_version").distinct().withColumns({"grid_type": F.when(third, "entity").otherwise("mgrs"), "requested_grid_level": F.lit(2)})
    at = F.col("created_at") + F.make_dt_interval(secs=k.cast("decimal(18,6)") / 1000000)
    quality = some.filter(k % 7 > 2).select("dataset_id", "output_version", F.when(k % 4 > 0, at).alias("completed_at"), at.alias("created_at"), F.when(k % 3 == 0, "pass").when(k % 3 == 1, "warn").otherwise("fail").alias("status"))
    ids = text('["A', k, ':b1","A', k, ':b2","A', k, ':b1"]')
    ingest = some.filter(k % 3 > 0).select("scene_id", "output_version", F.col("created_at").alias("updated_at"), ids.alias("band_unit_ids"), F.when(k % 2 == 0, "completed").otherwise("failed").alias("status"))
    kept = u.filter("grid_level = 3 and band_code = 'b2'").select("band_unit_id", F.lit("mgrs").alias("grid_type"), F.lit(2).alias("grid_level"), F.lit("old").alias("partition_status"))
    return L.backfill_status(runs, versions, u.select("scene_id", "band_unit_id"), quality, ingest, kept)


_K22_SQL = f"""WITH runs AS ({_K22['runs']}), versions AS ({_K22['versions']}), quality AS ({_K22['quality']}), ingest AS ({_K22['ingest']}), kept AS ({_K22['kept']}),
  g AS (SELECT runs.*, coalesce(nullif(grid_config ->> '$.grid_type', ''), versions.grid_type) AS gt, coalesce(CAST(grid_config ->> '$.requested_grid_level' AS INTEGER), versions.requested_grid_level) AS gl,
        list_filter(coalesce(CAST(grid_config -> '$.band_unit_ids' AS VARCHAR[]), []), lambda x: x IS NOT NULL AND x <> '') AS ids FROM runs LEFT JOIN versions USING (dataset_id, output_version)),
  ok AS (SELECT * FROM g WHERE gt IN ('geohash', 'mgrs', 'isea4h') AND gl IS NOT NULL),
  e AS (SELECT * EXCLUDE (ids), unnest(ids) AS band_unit_id FROM ok UNION ALL SELECT ok.* EXCLUDE (ids), u.band_unit_id FROM ok JOIN unit_rows u ON u.scene_id = ok.scene_id WHERE len(ids) = 0),
  f AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.band_unit_id = e.band_unit_id AND kept.grid_type = e.gt) QUALIFY row_number() OVER (PARTITION BY band_unit_id, gt ORDER BY created_at, partition_run_id, scene_id) = 1),
  q AS (SELECT dataset_id, output_version, status FROM quality QUALIFY row_number() OVER (PARTITION BY dataset_id, output_version ORDER BY completed_at DESC NULLS LAST, created_at DESC, pos DESC) = 1),
  i AS (SELECT DISTINCT scene_id, output_version, status, unnest(CAST(CAST(band_unit_ids AS JSON) AS VARCHAR[])) AS band_unit_id FROM ingest)"""


@query(
    "k22_backfill_status",
    _K22_SQL + """ SELECT band_unit_id, grid_type, grid_level, NULL AS partition_run_id, partition_status, NULL AS quality_status, NULL AS ingest_status, NULL AS attempt_no, NULL AS error_message FROM kept
       UNION ALL SELECT f.band_unit_id, gt, gl, partition_run_id, f.status, coalesce(q.status, 'pending'), coalesce(i.status, 'pending'), attempt_count, error_message
       FROM f LEFT JOIN q USING (dataset_id, output_version) LEFT JOIN i ON i.scene_id = f.scene_id AND i.output_version = f.output_version AND i.band_unit_id = f.band_unit_id""",
)
def _(spark, sf_dir):
    return _k22(spark, sf_dir)[0].select("band_unit_id", "grid_type", "grid_level", "partition_run_id", "partition_status", "quality_status", "ingest_status", "attempt_no", "error_message")


@query("k22_backfill_rejects", _K22_SQL + " SELECT partition_run_id, scene_id, coalesce(gt, '') AS grid_type, gl AS grid_level FROM g WHERE NOT coalesce(gt IN ('geohash', 'mgrs', 'isea4h') AND gl IS NOT NULL, false)")
def _(spark, sf_dir):
    return _k22(spark, sf_dir)[1].select("partition_run_id", "scene_id", "grid_type", "grid_level")
