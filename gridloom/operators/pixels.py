"""Pixel operators on long pixel tables (``asset_path, band, col, row, value, is_valid``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import grid as G

# Side of the blocks by which pixels and windows meet; windows span few blocks.
BLOCK = 32


def _spread(windows: DataFrame, block: int) -> DataFrame:
    """One row per block a window touches."""
    c0, r0 = F.col("window_col_off"), F.col("window_row_off")
    cols = F.sequence(F.floor(c0 / block), F.floor((c0 + F.col("window_width") - 1) / block))
    rows = F.sequence(F.floor(r0 / block), F.floor((r0 + F.col("window_height") - 1) / block))
    return windows.withColumn("__bc", F.explode(cols)).withColumn("__br", F.explode(rows))


def pixels_in_windows(pixels: DataFrame, windows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pixels joined to the windows that hold them.

    Both sides carry a block number, so the range condition runs behind an
    equi join and one large asset is spread over all its blocks.
    """
    p = pixels.withColumns({"__bc": F.floor(F.col("col") / block), "__br": F.floor(F.col("row") / block)})
    w = _spread(windows, block)
    inside = (
        (F.col("col") >= F.col("window_col_off")) & (F.col("col") < F.col("window_col_off") + F.col("window_width"))
        & (F.col("row") >= F.col("window_row_off")) & (F.col("row") < F.col("window_row_off") + F.col("window_height"))
    )
    return p.join(w, ["asset_path", "__bc", "__br"]).filter(inside).drop("__bc", "__br")


def zonal_stats(pixels: DataFrame, windows: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Mean of the valid pixels of each window, with valid and total counts."""
    valid = F.when(F.col("is_valid"), F.col("value"))
    return pixels_in_windows(pixels, windows, block).groupBy(*keys).agg(
        F.avg(valid).alias("sample_mean"), F.count(valid).alias("valid_pixels"), F.count("*").alias("pixels")
    )


def pixel_counts(pixels: DataFrame, sample: int = 1) -> DataFrame:
    """Valid, non-zero valid and total pixels of each asset; ``sample`` reads every n-th row and column."""
    rows = pixels if sample <= 1 else pixels.filter((F.col("row") % sample == 0) & (F.col("col") % sample == 0))
    return rows.groupBy("asset_path").agg(
        F.count_if("is_valid").alias("valid"),
        F.count_if(F.col("is_valid") & (F.col("value") != 0)).alias("nonzero"),
        F.count("*").alias("total"),
    )


def entity_tiles(pixels: DataFrame, lon: Column, lat: Column, grid: str, level: int) -> DataFrame:
    """Tiles cut from pixels by the cell of each pixel centre: size, valid ratio to six places; empty tiles are dropped."""
    located = G.assign_cells(pixels.withColumns({"__lon": lon, "__lat": lat}), "__lon", "__lat", grid, level)
    tiles = located.groupBy("asset_path", "band", "space_code").agg(
        F.count("*").alias("pixels"),
        F.count_if("is_valid").alias("valid_pixels"),
        (F.max("col") - F.min("col") + 1).alias("width"),
        (F.max("row") - F.min("row") + 1).alias("height"),
    )
    return tiles.filter("valid_pixels > 0").withColumn("valid_ratio", F.round(F.col("valid_pixels") / F.col("pixels"), 6))


def mosaic(pixels: DataFrame, windows: DataFrame, order: list[str], block: int = BLOCK) -> DataFrame:
    """Canvas of an area: the windows' union, non-zero pixels written in ``order``, the last one staying.

    ``canvas_col``/``canvas_row`` of a window place its first pixel on the canvas.
    """
    rows = pixels_in_windows(pixels, windows, block).filter((F.col("value") != 0) & F.col("is_valid"))
    col = F.col("canvas_col") + F.col("col") - F.col("window_col_off")
    row = F.col("canvas_row") + F.col("row") - F.col("window_row_off")
    return rows.groupBy("band", row.alias("canvas_row_no"), col.alias("canvas_col_no")).agg(
        F.max_by("value", F.struct(*order)).alias("value")
    )
