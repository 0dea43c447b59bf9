"""Catalogue joins, overviews, listings and set reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.lifecycle import latest_per

GRIDS = ("geohash", "mgrs", "isea4h")


# --- joins -------------------------------------------------------------------

def output_snapshot(t: dict[str, DataFrame], dataset: str | None = None, version: str | None = None, scenes: list | None = None, bands: list | None = None) -> DataFrame:
    """Index rows of outputs with their asset, band, scene band, grid cell and tile.

    A missing topology code matches a missing one; an empty band list means all.
    An index whose scene is unknown makes the job fail.  Assets, bands and scene bands meet first, so the
    index rows, the widest and most, go through one shuffle for the three.
    """
    i = t["indexes"]
    a = t["assets"].select("dataset_id", "source_asset_id", "source_uri", F.col("checksum").alias("source_checksum"))
    b = t["bands"].select("dataset_id", "source_asset_id", "band_code", "band_name")
    if dataset is not None:
        i, a, b = (x.filter(F.col("dataset_id") == dataset) for x in (i, a, b))
    if version is not None:
        i = i.filter(F.col("output_version") == version)
    sb = t["scene_bands"].select(F.col("asset_id").alias("source_asset_id"), "band_code", "band_unit_id", "scene_id")
    if scenes:
        sb = sb.filter(F.col("scene_id").isin(list(scenes)))
    if bands:
        sb = sb.filter(F.col("band_unit_id").isin(list(bands)))
    place = ["dataset_id", "output_version", "grid_type", "grid_level", "space_code"]
    g = t["cells"].select(*place, F.col("topology_code").alias("g_topology"), "bbox")
    tiles = t["tiles"].select(F.col("output_id").alias("tile_output_id"), "width", "height", "tile_uri")
    named = sb.join(a, "source_asset_id").join(b, ["dataset_id", "source_asset_id", "band_code"], "left")
    out = i.join(named, ["dataset_id", "source_asset_id", "band_code"])
    out = out.join(g, place).filter(F.col("topology_code").eqNullSafe(F.col("g_topology"))).drop("g_topology")
    return out.join(tiles, "tile_output_id", "left")


def with_scene(df: DataFrame, scene_assets: DataFrame, strict: bool = True) -> DataFrame:
    """Add the scene of each asset; with ``strict`` an unknown asset makes the job fail."""
    m = scene_assets.select(F.col("asset_id").alias("source_asset_id"), F.col("scene_id").alias("__scene"))
    out = df.join(m, "source_asset_id", "left")
    scene = F.col("__scene")
    if strict:
        scene = F.when(scene.isNotNull(), scene).otherwise(F.raise_error(F.concat(F.lit("asset has no scene: "), "source_asset_id")))
    return out.withColumn("scene_id", scene).drop("__scene")


def orphans(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows of ``child`` without a row in ``parent`` (child column to parent column)."""
    p = parent.select(*[F.col(pc).alias(cc) for cc, pc in keys.items()]).distinct()
    return child.join(p, list(keys), "left_anti")


def orphan_counts(checks: list[tuple[str, DataFrame, DataFrame, dict]]) -> DataFrame:
    """Number of orphans of each named relation."""
    parts = [orphans(c, p, k).agg(F.lit(name).alias("relation"), F.count("*").alias("n")) for name, c, p, k in checks]
    return reduce(DataFrame.unionByName, parts)


def tile_st_code(tiles: DataFrame, indexes: DataFrame) -> DataFrame:
    """ST code of each tile: from the index that points to it, else the newest of the same place and time, then the lowest id."""
    place = ["dataset_id", "output_version", "source_asset_id", "band_code", "grid_type", "grid_level", "space_code", "time_bucket"]
    i = indexes.select(*place, F.col("tile_output_id").alias("__points"), F.col("created_at").alias("__at"), F.col("output_id").alias("__id"), "st_code")
    # Newest first, then the lowest id; once per pointing index and once per place, so no tile meets every index.
    first = lambda rows, *keys: rows.groupBy(*keys).agg(F.min_by(F.struct("st_code"), F.struct(-F.unix_micros("__at"), F.col("__id"))).alias("__code"))
    # An index mostly points alone: its rows are sorted once, where they meet, and not before the shuffle too.
    pointing = first(i.filter("__points is not null").repartition(*place, "__points"), *place, "__points").withColumnsRenamed({"__points": "output_id", "__code": "__own"})
    found = tiles.join(pointing, [*place, "output_id"], "left").join(first(i, *place), place, "left")
    # The rows of one tile take the greatest code of its places; no tile is met again for that.
    code = F.max(F.coalesce("__own", "__code")["st_code"]).over(Window.partitionBy("output_id"))
    return found.withColumn("st_code", F.when(F.col("output_id").isNotNull(), code)).select(*tiles.columns, "st_code")


def enrich_errors(errors: DataFrame, indexes: DataFrame, tiles: DataFrame, assets: DataFrame, bands: DataFrame) -> DataFrame:
    """Errors with the ids their index, tile, asset and band lead to.

    The index is looked up by ``index_id`` and, where that is absent, by
    ``output_id``: two keys of one column, so the join stays an equi join.
    """
    e = errors.withColumn("__index", F.coalesce("index_id", "output_id"))
    i = indexes.select(F.col("output_id").alias("__index"), F.col("source_asset_id").alias("i_asset"), F.col("band_code").alias("i_band"), F.col("tile_output_id").alias("i_tile"))
    out = e.join(i, "__index", "left")
    out = out.withColumns(
        {
            "source_asset_id": F.coalesce("source_asset_id", "i_asset"),
            "band_code": F.coalesce("band_code", "i_band"),
            "tile_id": F.coalesce("tile_id", "i_tile"),
        }
    ).drop("__index", "i_asset", "i_band", "i_tile")
    t = tiles.select(F.col("output_id").alias("tile_id"), F.lit(True).alias("tile_exists"))
    a = assets.select("source_asset_id", "scene_id")
    b = bands.select("source_asset_id", "band_code", "band_name").distinct()
    return out.join(t, "tile_id", "left").join(a, "source_asset_id", "left").join(b, ["source_asset_id", "band_code"], "left")


def member_or_all(ids: Column, x: Column) -> Column:
    """``x`` is in a JSON id list; an empty or missing list means all."""
    listed = F.from_json(F.coalesce(ids, F.lit("[]")), "array<string>")
    return (F.size(listed) == 0) | F.array_contains(listed, x)


def lookup_names(df: DataFrame, ids: str, names: DataFrame, key: str, name: str, row: str) -> DataFrame:
    """Names of an id list in list order, one row per entry; an unknown id keeps its id."""
    entries = df.select(row, F.posexplode(ids).alias("pos", "__id"))
    n = names.select(F.col(key).alias("__id"), F.col(name).alias("__name"))
    return entries.join(n, "__id", "left").select(row, "pos", F.coalesce("__name", "__id").alias("name"))


def eligible_scenes(request: DataFrame, batch_scenes: DataFrame, scenes: DataFrame):
    """Scenes of the asked batches that can be worked on, and the asked batches that have none."""
    usable = scenes.filter(F.col("status") == "available").select("scene_id")
    eligible = batch_scenes.join(request, "load_batch_id", "left_semi").join(usable, "scene_id", "left_semi")
    missing = request.join(eligible.select("load_batch_id"), "load_batch_id", "left_anti")
    return eligible, missing


def already_done(units: DataFrame, status: DataFrame, grid: str, level: int) -> DataFrame:
    """Units whose partition is completed for a grid and level."""
    done = status.filter((F.col("grid_type") == grid) & (F.col("grid_level") == level) & (F.col("partition_status") == "completed"))
    return units.join(done, "band_unit_id", "left_semi")


def already_ingested(units: DataFrame, status: DataFrame, run_scenes: DataFrame, batches: DataFrame) -> DataFrame:
    """Units, with grid and level, that runs of the chosen load batches have both partitioned and ingested."""
    chosen = run_scenes.join(batches, "load_batch_id", "left_semi").select("partition_run_id", "scene_id")
    done = status.filter((F.col("partition_status") == "completed") & (F.col("ingest_status") == "completed")).join(chosen, ["partition_run_id", "scene_id"], "left_semi")
    return done.join(units, "band_unit_id", "left_semi").select("band_unit_id", "grid_type", "grid_level").distinct()


def pending_batches(batches: DataFrame, batch_units: DataFrame, status: DataFrame) -> DataFrame:
    """Batches with a unit that no completed ingest covers."""
    done = status.filter(F.col("ingest_status") == "completed").select("band_unit_id")
    return batches.join(batch_units.join(done, "band_unit_id", "left_anti"), "load_batch_id", "left_semi")


def pending_configs(request: DataFrame, attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Asked configurations without a completed attempt; NULL settings match NULL."""
    done = attempts.filter(F.col("status") == "completed").select(*[F.col(k).alias(f"__{k}") for k in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return request.join(done, on, "left_anti")


def visible(df: DataFrame, restrictions: DataFrame, role: str | None) -> DataFrame:
    """Rows a role may see; no role (an administrator) sees all."""
    if role is None:
        return df
    return df.join(restrictions.filter(F.col("role") == role).select("dataset_id"), "dataset_id", "left_anti")


def having_scene(df: DataFrame, scenes: DataFrame, t0: str | None = None, t1: str | None = None) -> DataFrame:
    """Datasets with a scene not before ``t0`` and a scene (maybe another) not after ``t1``."""
    if t0 is not None:
        df = df.join(scenes.filter(F.col("acq_time") >= F.lit(t0).cast("timestamp")).select("dataset_id"), "dataset_id", "left_semi")
    if t1 is not None:
        df = df.join(scenes.filter(F.col("acq_time") <= F.lit(t1).cast("timestamp")).select("dataset_id"), "dataset_id", "left_semi")
    return df


def nest_status(scenes: DataFrame, bands: DataFrame, status: DataFrame) -> DataFrame:
    """Dataset, scene, band and grid status in reading order, one row per leaf.

    Rows rather than one nested value per dataset, which would have to fit one task.
    """
    out = scenes.join(bands, "scene_id").join(status, "band_unit_id", "left")
    return out.select("dataset_id", "scene_id", "band_unit_id", "band_code", "grid_type", "grid_level", "partition_status", "quality_status", "ingest_status")


def reassign_conflicts(scenes: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves (``scene_id, new_dataset_id``) whose target already has a scene of the same key."""
    moving = moves.join(scenes.select("scene_id", "scene_key"), "scene_id")
    there = scenes.select(F.col("dataset_id").alias("new_dataset_id"), "scene_key", F.col("scene_id").alias("existing_scene_id"))
    return moving.join(there, ["new_dataset_id", "scene_key"]).filter("scene_id <> existing_scene_id")


# --- overviews -----------------------------------------------------------------

def run_overview(runs: DataFrame, run_scenes: DataFrame, status: DataFrame) -> DataFrame:
    """Distinct datasets, scenes and bands of each run, and distinct bands by state.

    The distinct values are found first, in a grouping that spreads a huge run,
    and counted afterwards, so the two child tables never multiply.
    """
    states = {
        "partitioned_count": F.col("partition_status") == "completed",
        "partition_failed_count": F.col("partition_status") == "failed",
        "quality_pass_count": F.col("quality_status").isin("pass", "warn"),
        "quality_failed_count": F.col("quality_status").isin("fail", "error"),
        "ingested_count": F.col("ingest_status") == "completed",
        "ingest_failed_count": F.col("ingest_status") == "failed",
    }
    flags = [F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in states.items()]
    units = status.groupBy("partition_run_id", "band_unit_id").agg(*flags)
    bands = units.groupBy("partition_run_id").agg(F.count("*").alias("band_count"), *[F.count_if(n).alias(n) for n in states])
    sc = run_scenes.groupBy("partition_run_id", "scene_id").agg(F.lit(1).alias("x")).groupBy("partition_run_id").agg(F.count("*").alias("scene_count"))
    ds = run_scenes.select("partition_run_id", "dataset_id").distinct().groupBy("partition_run_id").agg(F.count("*").alias("dataset_count"))
    out = runs.join(ds, "partition_run_id", "left").join(sc, "partition_run_id", "left").join(bands, "partition_run_id", "left")
    counts = ["dataset_count", "scene_count", "band_count", *states]
    return out.select(*runs.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def dataset_overview(datasets: DataFrame, scenes: DataFrame) -> DataFrame:
    """Scene counts, time range, finest resolution and union box of each dataset; the dataset's own box without scenes."""
    s = scenes.groupBy("dataset_id").agg(
        F.count("*").alias("scene_count"), F.count_if(F.col("status") == "available").alias("ready_scene_count"),
        F.count_if(F.col("status") == "failed").alias("failed_scene_count"), F.min("acq_time").alias("time_start"), F.max("acq_time").alias("time_end"),
        F.min("resolution_m").alias("resolution_m"), F.min("min_lon").alias("west"), F.min("min_lat").alias("south"), F.max("max_lon").alias("east"), F.max("max_lat").alias("north"),
    )
    out = datasets.join(s, "dataset_id", "left")
    own = [F.get("spatial_extent", F.lit(k)) for k in range(4)] if "spatial_extent" in datasets.columns else [F.lit(None)] * 4
    sides = {n: F.coalesce(n, own[k]) for k, n in enumerate(("west", "south", "east", "north"))}
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("scene_count", "ready_scene_count", "failed_scene_count")}
    return out.withColumns({**counts, **sides})


def grid_matrix(status: DataFrame, units: DataFrame) -> DataFrame:
    """Per dataset and grid: partitioned, checked and ingested units, as columns, with the unit total."""
    done = {
        "partition": F.col("partition_status") == "completed",
        "quality": F.col("quality_status").isin("pass", "warn"),
        "ingest": F.col("ingest_status") == "completed",
    }
    rows = units.join(status, "band_unit_id", "left")
    aggs = [F.count_if(F.coalesce((F.col("grid_type") == g) & c, F.lit(False))).alias(f"{g}_{n}") for g in GRIDS for n, c in done.items()]
    total = units.select("dataset_id", "band_unit_id").distinct().groupBy("dataset_id").agg(F.count("*").alias("total"))
    return rows.groupBy("dataset_id").agg(*aggs).join(total, "dataset_id")


def catalog_totals(datasets: DataFrame, scenes: DataFrame) -> DataFrame:
    """Datasets, scenes, ready and failed scenes in all (``measure, n``)."""
    known = scenes.join(datasets.select("dataset_id"), "dataset_id", "left_semi")
    s = known.agg(F.count("*").alias("scene_count"), F.count_if(F.col("status") == "available").alias("ready_scene_count"), F.count_if(F.col("status") == "failed").alias("failed_scene_count"))
    long = s.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("n")) for c in s.columns])).alias("r")).select("r.*")
    return long.unionByName(datasets.agg(F.lit("dataset_count").alias("measure"), F.count("*").alias("n")))


def batch_summary(batch_scenes: DataFrame) -> DataFrame:
    """Distinct datasets and scenes of each batch, distinct values found before they are counted."""
    sets = batch_scenes.select("load_batch_id", "dataset_id").distinct().groupBy("load_batch_id").agg(F.count("*").alias("dataset_count"))
    return batch_scenes.groupBy("load_batch_id").agg(F.count("*").alias("scene_count")).join(sets, "load_batch_id")


def ingest_summary(runs: DataFrame, run_scenes: DataFrame) -> DataFrame:
    """Runs, scenes, completed and failed scenes of each dataset."""
    r = runs.groupBy("dataset_id").agg(F.count("*").alias("runs"))
    s = run_scenes.groupBy("dataset_id").agg(
        F.count("*").alias("scenes"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed")
    )
    return r.join(s, "dataset_id", "left").fillna(0, ["scenes", "completed", "failed"])


def ingest_collections(units: DataFrame) -> DataFrame:
    """Per run: units, distinct scenes and grid settings, and the state: completed, partial or pending."""
    n = lambda *c: units.select("partition_run_id", *c).distinct().groupBy("partition_run_id").agg(F.count("*").alias("n"))
    base = units.groupBy("partition_run_id").agg(F.count("*").alias("unit_count"), F.count_if(F.col("ingest_status") == "completed").alias("ingested"))
    scenes = n("scene_id").withColumnRenamed("n", "scene_count")
    grids = n("grid_type", "grid_level").withColumnRenamed("n", "grid_config_count")
    state = F.when(F.col("ingested") == F.col("unit_count"), "completed").when(F.col("ingested") > 0, "partial").otherwise("pending")
    return base.join(scenes, "partition_run_id").join(grids, "partition_run_id").withColumn("state", state)


def band_summary(rows: DataFrame, pos: str) -> DataFrame:
    """Counts of the last status row of every band."""
    last = latest_per(rows, ["band_unit_id"], [F.col(pos)], ["partition_status", "quality_status", "ingest_status"])
    n = lambda c, *v: F.count_if(F.col(c).isin(*v))
    return last.agg(
        F.count("*").alias("bands"), n("partition_status", "completed").alias("partitioned"), n("partition_status", "failed").alias("partition_failed"),
        n("quality_status", "pass", "warn").alias("quality_passed"), n("quality_status", "fail", "error").alias("quality_failed"),
        n("ingest_status", "completed").alias("ingested"), n("ingest_status", "failed").alias("ingest_failed"),
    )


def source_batches(batch_scenes: DataFrame) -> DataFrame:
    """Batches each scene came from, in order, one row per pair."""
    return batch_scenes.select("scene_id", "load_batch_id").distinct()


def attempt_overview(tasks: DataFrame, assets: DataFrame) -> DataFrame:
    """Asset count of each task: its own list if not empty, else the grouped count, else 0."""
    grouped = assets.groupBy("task_id").agg(F.count("*").alias("__n"))
    listed = F.nullif(F.size("assets"), F.lit(0))
    return tasks.join(grouped, "task_id", "left").withColumn("asset_count", F.coalesce(listed, "__n", F.lit(0)).cast("bigint")).drop("__n")


def merge_grid_cells(cells: DataFrame, identity: list[str], geometry: str) -> DataFrame:
    """Cells of several bands as one: counts added up; ``conflict`` marks cells drawn in more than one way."""
    return cells.groupBy(*identity).agg(
        F.sum("tile_count").alias("tile_count"), F.sum("index_count").alias("index_count"), (F.min(geometry) != F.max(geometry)).alias("conflict")
    )


def count_of(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


# --- listings and sets ------------------------------------------------------------

def page(df: DataFrame, sort_by: str, allowed: tuple, tie: str, order: str = "desc", limit: int = 20, offset: int = 0) -> DataFrame:
    """One page of a listing: a permitted sort column, NULLs last, an id to break ties."""
    if sort_by not in allowed:
        raise ValueError(f"cannot sort by {sort_by}")
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("page out of bounds")
    if order not in ("asc", "desc"):
        raise ValueError(f"unsupported order: {order}")
    c, t = F.col(sort_by), F.col(tie)
    by = [c.desc_nulls_last(), t.desc()] if order == "desc" else [c.asc_nulls_last(), t.asc()]
    return df.orderBy(*by).offset(offset).limit(limit)


def provenance(parts: dict[str, DataFrame], audits: DataFrame) -> DataFrame:
    """Timeline of a catalogue: relations of several tables and the entries of JSON audit lists."""
    columns = ("relation_id", "dataset_id", "scene_id", "status", "created_at")
    rows = [df.select(F.lit(name).alias("relation_type"), *columns) for name, df in parts.items()]
    entry = "array<struct<changed_at:string, action:string>>"
    a = audits.select("dataset_id", F.explode(F.from_json("management_audit", entry)).alias("e"))
    rows.append(
        a.select(
            F.lit("dataset_audit").alias("relation_type"), F.col("e.changed_at").alias("relation_id"), "dataset_id", F.lit(None).cast("string").alias("scene_id"),
            F.col("e.action").alias("status"), F.col("e.changed_at").try_cast("timestamp").alias("created_at"),
        )
    )
    return reduce(DataFrame.unionByName, rows)


def union_view(a: DataFrame, b: DataFrame, a_kind: str, b_kind: str) -> DataFrame:
    """Rows of two sources with the kind of source; columns one lacks are NULL."""
    return a.withColumn("source_kind", F.lit(a_kind)).unionByName(b.withColumn("source_kind", F.lit(b_kind)), allowMissingColumns=True)


def difference(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only: ``missing`` from the actual, or ``unexpected``."""
    e, a = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    return e.join(a, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(
        a.join(e, keys, "left_anti").withColumn("side", F.lit("unexpected"))
    )


def quality_targets(run_scenes: DataFrame) -> DataFrame:
    """Distinct output versions a run wrote."""
    return run_scenes.filter(F.col("output_version").isNotNull()).select("partition_run_id", "dataset_id", "output_version").distinct()
