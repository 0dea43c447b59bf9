"""Loading a catalogue: batches, datasets, scenes, assets, bands and batch scenes in one commit.

A load is six tables of flat rows.  Scenes are known by their identity key: a scene that was loaded
before keeps its id, and its assets, bands and batch rows go to that id.  What a repeated load does
to a column is the table's policy.  Conflicts of identity stop the whole load.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.identity import band_unit_id
from gridloom.operators.facts import merge_catalog, table_exists


@dataclass(frozen=True)
class Policy:
    """Keys of a table and what a matched row does to its columns; columns not named are replaced."""

    schema: str
    keys: tuple[str, ...]
    keep: tuple[str, ...] = ()
    coalesce: tuple[str, ...] = ()
    merged: tuple[str, ...] = ("attributes",)
    #: Values of every loaded row, inserted or matched.
    fixed: dict = field(default_factory=dict)

    def rules(self) -> dict[str, str]:
        return {c: "keep" for c in self.keep} | {c: "coalesce" for c in self.coalesce} | {c: "merge_map" for c in self.merged}


_MAP = "attributes map<string, string>"
# Keys of the tables, columns that a repeated load leaves, and the states of a load.
TABLES = {
    "load_batches": Policy(f"load_batch_id string, batch_name string, source_system string, status string, loaded_at timestamp, {_MAP}", ("load_batch_id",), coalesce=("loaded_at",), fixed={"status": "succeeded"}),
    "datasets": Policy(
        f"dataset_id string, dataset_code string, dataset_title string, data_type string, product_type string, status string, assignment_confidence double, assignment_issue string, auto_ingest_allowed boolean, {_MAP}",
        ("dataset_id",), keep=("status",),
    ),
    "scenes": Policy(
        f"identity_key string, scene_id string, dataset_id string, scene_key string, source_asset_id string, source_uri string, checksum string, acquisition_time timestamp, bbox array<double>, crs string, resolution_m double, suggested_grid_type string, status string, {_MAP}",
        ("identity_key",), keep=("scene_id", "dataset_id", "scene_key", "status"),
    ),
    "scene_assets": Policy(
        f"scene_id string, asset_id string, source_uri string, cog_uri string, asset_role string, source_kind string, source_format string, checksum string, acquisition_time timestamp, bbox array<double>, crs string, {_MAP}",
        ("scene_id", "asset_id"),
    ),
    "scene_bands": Policy(f"scene_id string, asset_id string, band_code string, band_unit_id string, band_name string, band_type string, unit string, display_order int, {_MAP}", ("scene_id", "asset_id", "band_code")),
    "load_batch_scenes": Policy(
        f"load_batch_id string, scene_id string, source_asset_id string, source_uri string, checksum string, load_status string, error_message string, {_MAP}",
        ("load_batch_id", "scene_id"), fixed={"load_status": "succeeded", "error_message": None},
    ),
}


class CatalogConflict(ValueError):
    """A load that contradicts the catalogue; nothing of it was written."""


def _fitted(spark: SparkSession, name: str, rows: DataFrame | None) -> DataFrame:
    """Rows in the table's columns: absent ones are NULL, others are dropped."""
    empty = spark.createDataFrame([], TABLES[name].schema)
    if rows is None:
        return empty
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema])


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def conflicts(scenes: DataFrame, load: dict[str, DataFrame]) -> DataFrame:
    """identity_key (or the key of another table as text) and reason of every contradiction of a load.

    ``checksum``: stored and loaded checksums are both given and differ; ``dataset``: the scene
    belongs to another dataset; ``repeated``: a load has two rows for one key; ``no_scene``: an asset or
    band of a scene that is not in the load.
    """
    stored = scenes.select("identity_key", F.col("checksum").alias("__checksum"), F.col("dataset_id").alias("__dataset"))
    pairs = load["scenes"].join(stored, "identity_key")
    other = _filled("checksum") & _filled("__checksum") & (F.col("checksum") != F.col("__checksum"))
    out = pairs.filter(other).select("identity_key", F.lit("checksum").alias("reason"))
    out = out.unionByName(pairs.filter(~F.col("dataset_id").eqNullSafe(F.col("__dataset"))).select("identity_key", F.lit("dataset").alias("reason")))
    for name, policy in TABLES.items():
        if name not in load or name == "load_batch_scenes":
            continue
        keys = ["identity_key" if k == "scene_id" else k for k in policy.keys]
        twice = load[name].groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n > 1")
        out = out.unionByName(twice.select(F.concat_ws("/", *keys).alias("identity_key"), F.lit("repeated").alias("reason")))
        if name in ("scene_assets", "scene_bands"):
            lost = load[name].join(load["scenes"].select("identity_key"), "identity_key", "left_anti")
            out = out.unionByName(lost.select("identity_key", F.lit("no_scene").alias("reason")))
    return out


def merge_load(stored: dict[str, DataFrame], load: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the six tables after a load, its conflicts).

    ``load`` has ``load_batches``, ``datasets``, ``scenes`` (with load_batch_id) and, keyed by the
    scene's identity_key, ``scene_assets`` and ``scene_bands``.  The tables are meaningful only
    where there is no conflict.
    """
    spark = load["scenes"].sparkSession
    stored = {name: _fitted(spark, name, stored.get(name)) for name in TABLES}
    found = conflicts(stored["scenes"], load)
    known = stored["scenes"].select("identity_key", F.col("scene_id").alias("__stored"))
    scenes = load["scenes"].join(known, "identity_key", "left").withColumn("__scene", F.coalesce("__stored", "scene_id"))
    ids = scenes.select("identity_key", F.col("__scene").alias("scene_id"))
    batch_scenes = scenes.select("load_batch_id", F.col("__scene").alias("scene_id"), *[c for c in ("source_asset_id", "source_uri", "checksum") if c in scenes.columns], F.create_map(F.lit("schema_import"), F.lit("true")).alias("attributes"))
    assets = load["scene_assets"].drop("scene_id").join(ids, "identity_key")
    bands = load["scene_bands"].drop("scene_id").join(ids, "identity_key").withColumn("band_unit_id", band_unit_id("scene_id", "asset_id", "band_code"))
    rows = {
        "load_batches": load["load_batches"], "datasets": load["datasets"], "scenes": load["scenes"].withColumn("status", F.lit("loaded")),
        "scene_assets": assets, "scene_bands": bands, "load_batch_scenes": batch_scenes,
    }
    out = {}
    for name, policy in TABLES.items():
        new = _fitted(spark, name, rows[name]).withColumns({c: F.lit(v).cast("string") for c, v in policy.fixed.items()})
        new = new.withColumns({c: F.coalesce(c, F.create_map().cast("map<string,string>")) for c in policy.merged})
        out[name] = merge_catalog(stored[name], new, list(policy.keys), policy.rules())
    return out, found


def _pointer(root: str) -> str:
    return f"{root.rstrip('/')}/CURRENT"


def read_catalog(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the last committed load; empty ones where nothing was loaded."""
    if not table_exists(spark, _pointer(root)):
        return {name: _fitted(spark, name, None) for name in TABLES}
    version = spark.read.text(_pointer(root)).first()[0]
    return {name: spark.read.schema(p.schema).parquet(f"{root.rstrip('/')}/{version}/{name}") for name, p in TABLES.items()}


def load_catalog(spark: SparkSession, root: str, load: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Load into the catalogue below ``root`` and return its tables.

    All six tables are staged under a new version; then the name of the version replaces the last
    one in one rename, so a reader sees all of a load or nothing.  A conflict raises before anything
    is staged.  Loads of one catalogue must not run side by side.
    """
    tables, found = merge_load(read_catalog(spark, root), load)
    bad = found.orderBy("reason", "identity_key").limit(20).collect()  # for the message
    if bad:
        raise CatalogConflict(", ".join(f"{r.identity_key}: {r.reason}" for r in bad))
    version = f"load-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.parquet(f"{root.rstrip('/')}/{version}/{name}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    staged = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/.{version}")
    stream = staged.getFileSystem(conf).create(staged, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), conf).rename(staged, jvm.org.apache.hadoop.fs.Path(_pointer(root)), options)
    return read_catalog(spark, root)
