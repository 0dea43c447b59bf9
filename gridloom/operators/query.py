"""Area and time queries over observation and cube fact tables."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gridloom.operators import cover as covers

POINT_HALF_WIDTH = 1e-5

# A cover list is broadcast only up to this many cells; beyond it Spark picks the join.
BROADCAST_CELLS = 200_000


def _cell_side(grid: str, level: int) -> float:
    """About the shorter side of a cell in degrees."""
    if grid == "geohash":
        from gridloom.functions import geohash

        return min(geohash.cell_width(level), geohash.cell_height(level))
    return 10 ** (5 - level) / 111_000.0 if grid == "mgrs" else (41253.0 / (10 * 4**level + 2)) ** 0.5


def _closed(bbox: tuple, grid: str, level: int) -> tuple:
    """A box a little wider, so that cells that only touch it are in its cover: a point on its edge may lie in them."""
    w, s, e, n = (float(v) for v in bbox)
    slack = 1e-4 * _cell_side(grid, level)
    span = e - w if w <= e else e - w + 360.0
    if span + 2 * slack >= 360.0:
        w, e = -180.0, 180.0
    else:
        # East of 180 the cells begin again at -180, where a point at 180 lies.
        w, e = ((v + 180.0) % 360.0 - 180.0 for v in (w - slack, e + slack))
    return w, max(s - slack, -90.0), e, min(n + slack, 90.0)


def aoi_cells(like: DataFrame | SparkSession, bbox: tuple, grid: str, level: int, closed: bool = False) -> DataFrame:
    """Cells of one area of interest as a one-column DataFrame; ``closed``: the cells of all its points, edges included."""
    w, s, e, n = _closed(bbox, grid, level) if closed else (float(v) for v in bbox)
    spark = like if isinstance(like, SparkSession) else like.sparkSession
    box = spark.range(1).select(
        F.lit(w).alias("min_lon"), F.lit(s).alias("min_lat"), F.lit(e).alias("max_lon"), F.lit(n).alias("max_lat")
    )
    return covers.cover_bbox(box, grid, level, "intersect", key=[], boundary="none", bends=closed).select("space_code").distinct()


def cover_bound(bbox: tuple, grid: str, level: int) -> float:
    """Upper estimate of the number of cells in a box, from its area."""
    w, s, e, n = bbox
    wide = (e - w) if w <= e else (e - w + 360.0)
    if grid == "geohash":
        from gridloom.functions import geohash

        return (wide / geohash.cell_width(level) + 2) * ((n - s) / geohash.cell_height(level) + 2)
    side = _cell_side(grid, level)
    return (wide / side + 3) * ((n - s) / side + 3) * 2


def query_observations(
    obs: DataFrame,
    bbox: tuple | None = None,
    t0: str | None = None,
    t1: str | None = None,
    flags: list[str] | None = None,
    product: str | None = None,
    grid: str = "isea4h",
    level: int = 5,
    version: str | None = None,
    limit: int | None = None,
    point: tuple | None = None,
) -> DataFrame:
    """Observations of an area and bucket range, oldest first; all of them unless ``limit`` asks for fewer.

    Buckets, product, version, flags and the longitude/latitude box go to the
    scan as plain filters; the cell list is a semi join, which prunes partitions
    and row groups of a table laid out by cell.
    """
    if point is not None:
        lon, lat = point
        bbox = (lon - POINT_HALF_WIDTH, lat - POINT_HALF_WIDTH, lon + POINT_HALF_WIDTH, lat + POINT_HALF_WIDTH)
    w, s, e, n = bbox
    out = obs.filter((F.col("grid_type") == grid) & (F.col("grid_level") == level))
    if t0 is not None:
        out = out.filter(F.col("time_bucket") >= t0)
    if t1 is not None:
        out = out.filter(F.col("time_bucket") <= t1)
    if product is not None:
        out = out.filter(F.col("product_type") == product)
    if version is not None:
        out = out.filter(F.col("cube_version") == version)
    if flags:
        out = out.filter(F.col("quality_flag").isin([str(f) for f in flags]))
    lon_in = F.col("center_lon").between(w, e) if w <= e else ((F.col("center_lon") >= w) | (F.col("center_lon") <= e))
    out = out.filter(lon_in & F.col("center_lat").between(s, n))
    cells = aoi_cells(obs, bbox, grid, level, closed=True)
    if cover_bound(bbox, grid, level) <= BROADCAST_CELLS:
        cells = F.broadcast(cells)
    out = out.join(cells, "space_code", "left_semi")
    if limit is None:
        return out
    return out.orderBy("acq_time", "observation_id").limit(max(1, int(limit)))


def query_cells(
    facts: DataFrame,
    bbox: tuple,
    bucket: str,
    bands: list[str],
    grid: str = "geohash",
    level: int = 5,
    version: str | None = None,
    require: bool = False,
) -> DataFrame:
    """Value references of an area, bucket and band list, in cell and band order.

    ``require`` makes an empty result an error (it looks for one row).
    """
    out = facts.filter((F.col("grid_type") == grid) & (F.col("grid_level") == level) & (F.col("time_bucket") == bucket))
    if bands:
        out = out.filter(F.col("band").isin(bands))
    if version is not None:
        out = out.filter(F.col("cube_version") == version)
    cells = aoi_cells(facts, bbox, grid, level)
    if cover_bound(bbox, grid, level) <= BROADCAST_CELLS:
        cells = F.broadcast(cells)
    out = out.join(cells, "space_code", "left_semi")
    if require and out.isEmpty():
        raise ValueError("no facts in the area")
    return out.orderBy("space_code", "band")


#: Cells of an area that become literals of a scan, and ranges of codes they are merged into.
LITERAL_CELLS, LITERAL_RANGES = 20_000, 32
#: Columns a table read by area is laid out by.
AREA_LAYOUT = ("grid_type", "grid_level", "space_code_prefix")


def write_area_table(df: DataFrame, path: str) -> None:
    """Write rows with cells (``grid_type, grid_level, space_code, space_code_prefix``) so that areas can be read alone.

    Folders go by grid and code prefix; rows lie in code order, so that a row group spans few codes.  A
    crowded prefix is spread over tasks by its codes.
    """
    by = [F.col(c) for c in (*AREA_LAYOUT, "space_code")]
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").partitionBy(*AREA_LAYOUT).parquet(path)


def code_ranges(codes: list[str], most: int = LITERAL_RANGES) -> list[tuple[str, str]]:
    """Ranges (first, last) over sorted codes, cut where neighbours have least of their beginning in common."""
    codes = sorted(set(codes))
    common = [len(os.path.commonprefix([a, b])) for a, b in zip(codes, codes[1:])]
    cuts = sorted(sorted(range(len(common)), key=lambda k: (common[k], k))[: most - 1])
    starts, ends = [0, *[k + 1 for k in cuts]], [*cuts, len(codes) - 1]
    return [(codes[a], codes[b]) for a, b in zip(starts, ends)] if codes else []


def area_predicate(spark: SparkSession, bbox: tuple, grid: str, level: int, prefix_length: int = 3) -> Column | None:
    """Literals on ``space_code_prefix`` and ``space_code`` that hold for every cell of a box; None for hexagons too many to list.

    The codes of at most ``LITERAL_CELLS`` cells reach the driver: where the box has more, those of
    a coarser level, which the codes of its cells begin with (hexagon numbers do not nest, so these
    have no coarser form).
    """
    coarse = {"geohash": range(level, 0, -1), "mgrs": (level, 0), "isea4h": (level,)}[grid]
    at = next((lv for lv in coarse if cover_bound(bbox, grid, lv) <= LITERAL_CELLS), None)
    if at is None:
        return None
    codes = [r.space_code for r in aoi_cells(spark, bbox, grid, at).collect()]
    # Every letter and digit comes before the tilde.
    beyond = "" if at == level else "~"
    ranges = [F.col("space_code").between(a, b + beyond) for a, b in code_ranges(codes)]
    if not ranges:
        return F.lit(False)
    heads = sorted({c[:prefix_length] for c in codes})
    if len(codes[0]) >= prefix_length:
        folders = F.col("space_code_prefix").isin(heads)
    else:
        folders = reduce(Column.__or__, [F.col("space_code_prefix").between(h, h + "~") for h in heads])
    return folders & reduce(Column.__or__, ranges)


def read_area(spark: SparkSession, path: str, bbox: tuple, grid: str, level: int, prefix_length: int = 3) -> DataFrame:
    """Rows of a table of :func:`write_area_table` in the cells of a box.

    Folders and row groups are chosen by literals before anything is read; a semi join with the cells
    keeps exactly theirs.
    """
    found = spark.read.parquet(path).schema
    # A prefix such as 9e5 is no number.
    typed = StructType([StructField(f.name, StringType() if f.name in ("grid_type", "space_code_prefix") else f.dataType) for f in found])
    rows = spark.read.schema(typed).parquet(path).filter((F.col("grid_type") == grid) & (F.col("grid_level") == level))
    literals = area_predicate(spark, bbox, grid, level, prefix_length)
    if literals is not None:
        rows = rows.filter(literals)
    cells = aoi_cells(spark, bbox, grid, level)
    if cover_bound(bbox, grid, level) <= BROADCAST_CELLS:
        cells = F.broadcast(cells)
    return rows.join(cells, "space_code", "left_semi")


def read_fact(spark, path: str, **predicates) -> DataFrame:
    """A partitioned fact table with equality or list predicates, which reach the scan."""
    df = spark.read.parquet(path)
    for column, value in predicates.items():
        df = df.filter(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return df
