"""Queries of catalogue loads: all six tables after a load, and what stops one."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import catalogload as C
from gridloom.plans.registry import query
from gridloom.plans.relations import run_scenes, units


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _stored_id(k):
    """Id under which a scene was loaded before: every fifth has another one than the load gives it."""
    return F.when(k % 5 == 0, _text("P", k)).otherwise(_text("S", k))


def _map(state, dataset=None):
    entries = [F.lit("k"), F.lit(state)] + ([F.lit("old"), dataset] if dataset is not None else [])
    return F.create_map(*entries)


def _bands(spark, sf_dir):
    """Distinct bands of the scenes, ``o`` the scene's number."""
    u = units(spark, sf_dir).select("scene_id", "asset_id", "band_code", "dataset_id").distinct()
    return u.join(run_scenes(spark, sf_dir).select("scene_id"), "scene_id", "left_semi").withColumn("o", F.substring("scene_id", 2, 12).cast("long"))


def stored(spark, sf_dir):
    """The catalogue before the load: what does not divide by three."""
    r, u, k, o = run_scenes(spark, sf_dir).filter("pos % 3 <> 0"), _bands(spark, sf_dir), F.col("pos"), F.col("o")
    number = F.substring("load_batch_id", 2, 9).cast("int")
    scene = _stored_id(k).alias("scene_id")
    batches = run_scenes(spark, sf_dir).select("load_batch_id").distinct().filter(number % 3 != 0)
    datasets = run_scenes(spark, sf_dir).select("dataset_id").distinct().filter(F.substring("dataset_id", 2, 9).cast("int") % 3 != 0)
    return {
        "load_batches": batches.select("load_batch_id", F.lit("old").alias("batch_name"), F.lit("failed").alias("status"), F.lit("2020-01-01 00:00:00").cast("timestamp").alias("loaded_at"), _map("a", F.col("load_batch_id")).alias("attributes")),
        "datasets": datasets.select("dataset_id", F.lit("old").alias("dataset_title"), F.lit("active").alias("status"), _map("a", F.col("dataset_id")).alias("attributes")),
        "scenes": r.select(_text("I", k).alias("identity_key"), scene, "dataset_id", F.when(k % 4 != 0, _text("c", k)).alias("checksum"), F.lit("old").alias("crs"), F.lit("available").alias("status"), _map("a", F.col("dataset_id")).alias("attributes")),
        "scene_assets": r.select(scene, _text("A", k).alias("asset_id"), F.lit("old").alias("source_uri"), F.lit("cog").alias("cog_uri"), _map("a", F.col("dataset_id")).alias("attributes")),
        "scene_bands": u.filter(o % 3 != 0).select(_stored_id(o).alias("scene_id"), "asset_id", "band_code", F.lit("old").alias("band_unit_id"), F.lit("m").alias("unit"), _map("a", F.col("dataset_id")).alias("attributes")),
        "load_batch_scenes": r.select("load_batch_id", scene, F.lit("failed").alias("load_status"), F.lit("broken").alias("error_message"), _map("a", F.col("dataset_id")).alias("attributes")),
    }


def load(spark, sf_dir):
    """The load: what divides by two."""
    r, u, k, o = run_scenes(spark, sf_dir).filter("pos % 2 = 0"), _bands(spark, sf_dir), F.col("pos"), F.col("o")
    b = _map("b").alias("attributes")
    batches = run_scenes(spark, sf_dir).select("load_batch_id").distinct().filter(F.substring("load_batch_id", 2, 9).cast("int") % 2 == 0)
    late = F.when(F.substring("load_batch_id", 2, 9).cast("int") % 4 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    datasets = run_scenes(spark, sf_dir).select("dataset_id").distinct().filter(F.substring("dataset_id", 2, 9).cast("int") % 2 == 0)
    key = _text("I", k).alias("identity_key")
    return {
        "load_batches": batches.select("load_batch_id", F.lit("new").alias("batch_name"), late.alias("loaded_at"), b),
        "datasets": datasets.select("dataset_id", F.lit("new").alias("dataset_title"), F.lit("new").alias("status"), b),
        "scenes": r.select(key, "load_batch_id", "scene_id", "dataset_id", _text("c", k).alias("checksum"), F.lit("new").alias("crs"), b),
        "scene_assets": r.select(key, _text("A", k).alias("asset_id"), F.lit("new").alias("source_uri"), b),
        "scene_bands": u.filter(o % 2 == 0).select(_text("I", o).alias("identity_key"), "asset_id", "band_code", b),
    }


_RUN = "(SELECT *, CASE WHEN pos % 5 = 0 THEN 'P' || pos ELSE 'S' || pos END AS sid FROM run_rows)"
_UNIT = "(SELECT DISTINCT scene_id, asset_id, band_code, dataset_id, CAST(substr(scene_id, 2) AS BIGINT) AS o FROM unit_rows WHERE scene_id IN (SELECT scene_id FROM run_rows))"
_SID = "CASE WHEN o % 5 = 0 THEN 'P' || o ELSE 'S' || o END"
#: Stored and loaded scenes have one id: the stored one, if any.
_LOADED = "CASE WHEN pos % 3 <> 0 THEN sid ELSE scene_id END"
_BAND = "CASE WHEN o % 3 <> 0 THEN CASE WHEN o % 5 = 0 THEN 'P' || o ELSE 'S' || o END ELSE 'S' || o END"
_SQL = {
    "load_batches": (
        ["load_batch_id", "batch_name", "status", "loaded_at"],
        "SELECT load_batch_id, CASE WHEN n % 2 = 0 THEN 'new' ELSE 'old' END AS batch_name, CASE WHEN n % 2 = 0 THEN 'succeeded' ELSE 'failed' END AS status, "
        "CASE WHEN n % 4 = 0 THEN TIMESTAMP '2024-01-01' WHEN n % 3 <> 0 THEN TIMESTAMP '2020-01-01' END AS loaded_at, CASE WHEN n % 2 = 0 THEN 'b' ELSE 'a' END AS k, CASE WHEN n % 3 <> 0 THEN load_batch_id END AS old "
        "FROM (SELECT DISTINCT load_batch_id, CAST(substr(load_batch_id, 2) AS INTEGER) AS n FROM run_rows) WHERE n % 2 = 0 OR n % 3 <> 0",
    ),
    "datasets": (
        ["dataset_id", "dataset_title", "status"],
        "SELECT dataset_id, CASE WHEN n % 2 = 0 THEN 'new' ELSE 'old' END AS dataset_title, CASE WHEN n % 3 <> 0 THEN 'active' ELSE 'new' END AS status, CASE WHEN n % 2 = 0 THEN 'b' ELSE 'a' END AS k, "
        "CASE WHEN n % 3 <> 0 THEN dataset_id END AS old FROM (SELECT DISTINCT dataset_id, CAST(substr(dataset_id, 2) AS INTEGER) AS n FROM run_rows) WHERE n % 2 = 0 OR n % 3 <> 0",
    ),
    "scenes": (
        ["identity_key", "scene_id", "dataset_id", "checksum", "crs", "status"],
        f"SELECT 'I' || pos AS identity_key, {_LOADED} AS scene_id, dataset_id, CASE WHEN pos % 2 = 0 OR pos % 4 <> 0 THEN 'c' || pos END AS checksum, CASE WHEN pos % 2 = 0 THEN 'new' ELSE 'old' END AS crs, "
        f"CASE WHEN pos % 3 <> 0 THEN 'available' ELSE 'loaded' END AS status, CASE WHEN pos % 2 = 0 THEN 'b' ELSE 'a' END AS k, CASE WHEN pos % 3 <> 0 THEN dataset_id END AS old FROM {_RUN} WHERE pos % 2 = 0 OR pos % 3 <> 0",
    ),
    "scene_assets": (
        ["scene_id", "asset_id", "source_uri", "cog_uri"],
        f"SELECT {_LOADED} AS scene_id, 'A' || pos AS asset_id, CASE WHEN pos % 2 = 0 THEN 'new' ELSE 'old' END AS source_uri, CASE WHEN pos % 2 <> 0 THEN 'cog' END AS cog_uri, CASE WHEN pos % 2 = 0 THEN 'b' ELSE 'a' END AS k, "
        f"CASE WHEN pos % 3 <> 0 THEN dataset_id END AS old FROM {_RUN} WHERE pos % 2 = 0 OR pos % 3 <> 0",
    ),
    "scene_bands": (
        ["scene_id", "asset_id", "band_code", "band_unit_id", "unit"],
        f"SELECT {_BAND} AS scene_id, asset_id, band_code, CASE WHEN o % 2 = 0 THEN 'band-' || substr(sha256({_BAND} || chr(0) || asset_id || chr(0) || band_code), 1, 32) ELSE 'old' END AS band_unit_id, CASE WHEN o % 2 <> 0 THEN 'm' END AS unit, "
        f"CASE WHEN o % 2 = 0 THEN 'b' ELSE 'a' END AS k, CASE WHEN o % 3 <> 0 THEN dataset_id END AS old FROM {_UNIT} WHERE o % 2 = 0 OR o % 3 <> 0",
    ),
    "load_batch_scenes": (
        ["load_batch_id", "scene_id", "load_status", "error_message", "checksum"],
        f"SELECT load_batch_id, {_LOADED} AS scene_id, CASE WHEN pos % 2 = 0 THEN 'succeeded' ELSE 'failed' END AS load_status, CASE WHEN pos % 2 <> 0 THEN 'broken' END AS error_message, CASE WHEN pos % 2 = 0 THEN 'c' || pos END AS checksum, "
        f"CASE WHEN pos % 3 <> 0 THEN 'a' END AS k, CASE WHEN pos % 3 <> 0 THEN dataset_id END AS old FROM {_RUN} WHERE pos % 2 = 0 OR pos % 3 <> 0",
    ),
}


def _table(name, columns):
    def run(spark, sf_dir):
        tables, _ = C.merge_load(stored(spark, sf_dir), load(spark, sf_dir))
        get = lambda k: F.try_element_at("attributes", F.lit(k)).alias(k)
        return tables[name].select(*columns, get("k"), get("old"))

    return run


for _name, (_columns, _sql) in _SQL.items():
    query(f"i7_load_{_name}", _sql)(_table(_name, _columns))


@query(
    "i7_load_conflicts",
    """SELECT 'I' || pos AS identity_key, 'checksum' AS reason FROM run_rows WHERE pos % 3 <> 0 AND pos % 4 <> 0 AND pos % 14 = 0
       UNION ALL SELECT 'I' || pos, 'dataset' FROM run_rows WHERE pos % 3 <> 0 AND pos % 10 = 0 UNION ALL SELECT 'I' || pos, 'repeated' FROM run_rows WHERE pos % 26 = 0
       UNION ALL SELECT 'I' || pos, 'no_scene' FROM run_rows WHERE pos % 34 = 1""",
)
def _(spark, sf_dir):
    """A load with changed checksums, datasets, repeated scenes and assets without a scene."""
    rows, k = load(spark, sf_dir), F.substring("identity_key", 2, 12).cast("long")
    s = rows["scenes"].withColumn("checksum", F.when(k % 14 == 0, "other").otherwise(F.col("checksum"))).withColumn("dataset_id", F.when(k % 10 == 0, "D99").otherwise(F.col("dataset_id")))
    again = rows["scenes"].filter(k % 26 == 0).withColumn("checksum", F.lit(None).cast("string"))
    rows["scenes"] = s.unionByName(again)
    alone = run_scenes(spark, sf_dir).filter("pos % 34 = 1").select(_text("I", F.col("pos")).alias("identity_key"), _text("A", F.col("pos")).alias("asset_id"))
    rows["scene_assets"] = rows["scene_assets"].unionByName(alone, allowMissingColumns=True)
    return C.conflicts(stored(spark, sf_dir)["scenes"], rows)
