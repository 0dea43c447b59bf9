"""The flagship query: observations to cells, an area and time query, a summary per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import facts, partitioning
from gridloom.operators.grid import assign_cells
from gridloom.operators.query import query_observations
from gridloom.plans import duck, views
from gridloom.plans.registry import query

AREA = (-20.0, -10.0, 60.0, 45.0)
FIRST, LAST = "20240103", "20240126"


def observation_facts(spark: SparkSession, sf_dir: str, grid: str = "geohash", level: int = 2) -> DataFrame:
    """Observations with cell, day bucket and ST code."""
    cells = assign_cells(views.obs(spark, sf_dir), "lon", "lat", grid, level)
    return partitioning.stamp(cells, "day").withColumnsRenamed({"lon": "center_lon", "lat": "center_lat"})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = query_observations(
        observation_facts(spark, sf_dir), AREA, FIRST, LAST, ["0", "1"], "xco2", "geohash", 2, limit=None
    )
    return facts.summarize_xco2(found, ("space_code",)).select(
        "space_code", F.col("n").alias("n_obs"), "xco2_min", "xco2_max", "xco2_avg"
    )


w, s, e, n = AREA
query(
    "flagship_area_time_summary",
    f"""SELECT space_code, count(xco2) AS n_obs, min(xco2) AS xco2_min, max(xco2) AS xco2_max, round(avg(xco2), 6) AS xco2_avg
        FROM ({duck.geohash_cells('obs', 'lon', 'lat', 2)})
        WHERE lon BETWEEN {w} AND {e} AND lat BETWEEN {s} AND {n} AND quality_flag IN ('0', '1')
          AND strftime(acq_time, '%Y%m%d') BETWEEN '{FIRST}' AND '{LAST}' GROUP BY space_code""",
)(flagship)
