"""From assets to cells: task tables, intersections, pixel windows and output rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import identity
from gridloom.functions.timecode import st_code, st_granularity, time_bucket
from gridloom.operators import cover as covers

BOX = ("min_lon", "min_lat", "max_lon", "max_lat")
CELL_BOX = tuple(f"cell_{c}" for c in BOX)


def build_tasks(assets: DataFrame, grid: str, level: int, mode: str = "intersect") -> DataFrame:
    """One row per asset and cell of its box.

    The cover is worked out once per distinct scene box and joined back to the
    scene's bands, unless the cover is plain arithmetic, which is cheaper than a join.
    """
    if grid == "geohash" and mode != "minimal":
        boxed = assets.withColumns({f"__{c}": F.col(c) for c in BOX})
        tasks = covers.cover_bbox(boxed, grid, level, mode)
        return tasks.withColumnsRenamed({f"__{c}": c for c in BOX}).withColumn("cover_mode", F.lit(mode))
    scenes = assets.select("scene_id", *BOX).distinct()
    shared = scenes.select("scene_id", *[F.col(c).alias(f"__{c}") for c in BOX], *BOX)
    cells = covers.cover_bbox(shared, grid, level, mode, ["scene_id", *[f"__{c}" for c in BOX]])
    cells = cells.select(
        "scene_id",
        *[F.col(f"__{c}").alias(c) for c in BOX],
        "grid_type", "grid_level", "space_code", *CELL_BOX,
    )
    return assets.join(cells, ["scene_id", *BOX]).withColumn("cover_mode", F.lit(mode))


def intersect_bbox(df: DataFrame, a: tuple = BOX, b: tuple = CELL_BOX) -> DataFrame:
    """Add the common box of two boxes; rows whose boxes share no area are dropped."""
    w, s = F.greatest(F.col(a[0]), F.col(b[0])), F.greatest(F.col(a[1]), F.col(b[1]))
    e, n = F.least(F.col(a[2]), F.col(b[2])), F.least(F.col(a[3]), F.col(b[3]))
    df = df.withColumns(
        {"intersect_min_lon": w, "intersect_min_lat": s, "intersect_max_lon": e, "intersect_max_lat": n}
    )
    return df.filter("intersect_min_lon < intersect_max_lon and intersect_min_lat < intersect_max_lat")


def bbox_join(a: DataFrame, b: DataFrame, level: int, a_key: str, b_key: str) -> DataFrame:
    """Pairs of rows of two tables whose boxes share area.

    The distinct boxes of both sides are spread over coarse geohash cells, so the overlap test runs
    behind an equi join and once for each pair of boxes.  A pair that meets in several cells is found
    once, in the cell that holds the south-west corner of its common box.  The pairs of boxes then
    meet the rows that have them, so rows that share a box cost no more tests.
    """
    a_box, b_box = [f"a_{c}" for c in BOX], [f"b_{c}" for c in BOX]
    left = a.select(a_key, *[F.col(c).alias(f"a_{c}") for c in BOX])
    right = b.select(b_key, *[F.col(c).alias(f"b_{c}") for c in BOX])
    lc = left.select(*a_box).distinct().withColumns({c: F.col(f"a_{c}") for c in BOX})
    rc = right.select(*b_box).distinct().withColumns({c: F.col(f"b_{c}") for c in BOX})
    lc = covers.geohash_candidates(lc, level).select(
        *a_box, "__x", "__y", F.col("__w").alias("cw"), F.col("__s").alias("cs"), F.col("__e").alias("ce"), F.col("__n").alias("cn"),
    )
    rc = covers.geohash_candidates(rc, level).select(*b_box, "__x", "__y")
    w = F.greatest("a_min_lon", "b_min_lon")
    s = F.greatest("a_min_lat", "b_min_lat")
    overlap = (w < F.least("a_max_lon", "b_max_lon")) & (s < F.least("a_max_lat", "b_max_lat"))
    here = (w >= F.col("cw")) & (w < F.col("ce")) & (s >= F.col("cs")) & (s < F.col("cn"))
    pairs = lc.join(rc, ["__x", "__y"]).filter(overlap & here).select(*a_box, *b_box)
    # A fixed number of tasks: the pairs take few bytes but become many rows.
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = pairs.join(right, b_box).repartition(tasks, *a_box).join(left.repartition(tasks, *a_box), a_box)
    return joined.select(
        a_key, b_key,
        w.alias("intersect_min_lon"), s.alias("intersect_min_lat"),
        F.least("a_max_lon", "b_max_lon").alias("intersect_max_lon"),
        F.least("a_max_lat", "b_max_lat").alias("intersect_max_lat"),
    )


def pixel_window(
    df: DataFrame,
    origin_x: str = "origin_x",
    origin_y: str = "origin_y",
    pixel: str = "pixel_size",
    width: str = "raster_width",
    height: str = "raster_height",
    box: tuple = ("intersect_min_lon", "intersect_min_lat", "intersect_max_lon", "intersect_max_lat"),
    clip: str = "shrink",
) -> DataFrame:
    """Add the pixel window of a box in a north-up raster; rows without a window are dropped.

    Offsets are floored and lengths rounded up.  ``clip="shrink"`` cuts what
    lies before the first row or column off the length too; ``"intersection"``
    is the window of the box on its pixel edges, cut to the raster.
    """
    px = F.col(pixel)
    x0 = (F.col(box[0]) - F.col(origin_x)) / px
    x1 = (F.col(box[2]) - F.col(origin_x)) / px
    y0 = (F.col(origin_y) - F.col(box[3])) / px
    y1 = (F.col(origin_y) - F.col(box[1])) / px
    w, h = F.col(width).cast("long"), F.col(height).cast("long")
    zero = F.lit(0).cast("long")
    if clip == "intersection":
        c0, c1 = F.greatest(F.floor(x0), zero), F.least(F.ceil(x1), w)
        r0, r1 = F.greatest(F.floor(y0), zero), F.least(F.ceil(y1), h)
        cols, rows = c1 - c0, r1 - r0
    else:
        left, top = F.floor(x0), F.floor(y0)
        c0, r0 = F.greatest(left, zero), F.greatest(top, zero)
        cols = F.least(w - c0, F.ceil(x1 - x0) - (c0 - left))
        rows = F.least(h - r0, F.ceil(y1 - y0) - (r0 - top))
    df = df.withColumns(
        {
            "window_col_off": c0.cast("long"),
            "window_row_off": r0.cast("long"),
            "window_width": cols.cast("long"),
            "window_height": rows.cast("long"),
        }
    )
    return df.filter("window_width > 0 and window_height > 0")


def with_value_ref(df: DataFrame, uri: str = "asset_uri", out: str = "value_ref_uri") -> DataFrame:
    """Add ``uri#window=col,row,width,height``."""
    window = F.concat_ws(
        ",", *[F.col(c).cast("string") for c in ("window_col_off", "window_row_off", "window_width", "window_height")]
    )
    return df.withColumn(out, F.concat(F.col(uri), F.lit("#window="), window))


def parse_value_ref(df: DataFrame, ref: str = "value_ref_uri") -> DataFrame:
    """Split a value reference into its URI and window; a malformed window gives NULLs."""
    pattern = r"^(.*)#window=(\d+),(\d+),(\d+),(\d+)$"
    names = ("window_col_off", "window_row_off", "window_width", "window_height")
    parts = {n: F.regexp_extract(F.col(ref), pattern, k + 2).try_cast("long") for k, n in enumerate(names)}
    return df.withColumns({"asset_uri": F.split_part(F.col(ref), F.lit("#"), F.lit(1)), **parts})


def stamp(df: DataFrame, granularity: str = "day", ts: str = "acq_time", prefix_length: int = 3) -> DataFrame:
    """Add time bucket, ST code and the cell prefix used for grouping and storage."""
    return df.withColumns(
        {
            "time_bucket": time_bucket(ts, granularity),
            "st_code": st_code(
                F.col("grid_type"), F.col("grid_level"), F.col("space_code"), ts, st_granularity(granularity)
            ),
            "space_code_prefix": F.substring("space_code", 1, prefix_length),
        }
    )


def observation_bucket(bucket: Column, index: Column) -> Column:
    """Day bucket with the observation's source index: ``20240101-000000123``."""
    return F.format_string("%s-%09d", bucket, index.cast("long"))


def build_outputs(tasks: DataFrame, dataset: str = "dataset_id", version: str = "output_version", band: str = "band", window: Column | None = None):
    """Tile, index and grid-cell rows of an output from stamped tasks (asset x cell x band).

    Ids are hashes of the identity fields in contract order, so a second run gives the same rows.
    Hexagon tiles are files of their own (``entity``), the others windows of their asset
    (``logical-window``); ``window`` names the window where an asset has several in one cell.  An index
    row has its tile's id and ``-index``, and points to the tile only where that is a file.  Cells
    are distinct by code and topology, with the number of their tiles and indexes.
    """
    if "topology_code" not in tasks.columns:
        tasks = tasks.withColumn("topology_code", F.lit(None).cast("string"))
    entity = F.col("grid_type") == "isea4h"
    fixed = {"dataset_id": dataset, "output_version": version}
    own = window if window is not None else F.when(entity, "entity").otherwise("logical-window")
    tiles = tasks.withColumn("output_id", identity.output_id(**fixed, band_code=band, window_identity=own))
    indexes = tiles.withColumn("tile_output_id", F.when(entity, F.col("output_id"))).withColumn("output_id", F.concat("output_id", F.lit("-index")))
    tiles = tiles.withColumn("tile_kind", F.when(entity, "entity_file").otherwise("logical_reference"))
    place = [dataset, version, "grid_type", "grid_level", "space_code", "topology_code"]
    cells = tasks.groupBy(*place).agg(
        F.count("*").alias("tile_count"),
        F.count("*").alias("index_count"),
        F.min("source_asset_id").alias("source_asset_id"),
        *[F.min(c).alias(c) for c in CELL_BOX if c in tasks.columns],
    )
    # What stands for band, time and window in a cell's identity; its asset is the least one.
    marks = {"band_code": F.lit("_cell"), "time_bucket": F.lit("_"), "window_identity": F.lit("cell")}
    return tiles, indexes, cells.withColumn("output_id", identity.output_id(**fixed, **marks))
