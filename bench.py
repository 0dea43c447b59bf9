"""Times headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "flagship_area_time_summary", "b1_geohash_assign_l5", "b2_mgrs_assign_p5", "b4_isea4h_assign_r6", "b19_geohash_neighbors",
    "c1_geohash_intersect", "d2_bbox_intersection", "d4_pixel_window", "d6_area_time_query_isea4h", "e1_latest_wins", "e2_best_quality_wins",
    "e13_run_overview", "e27_zonal_mean", "e30_mosaic", "i2_upsert_cube_facts", "j9_window_bounds", "k15_plan_ingest", "h1_provenance_timeline", "i2_upsert_partitioned_table", "d16_tile_st_code",
)


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from gridloom.plans import load_all
    from gridloom.session import session

    spark = session(f"local[{CPUS}]", int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all().QUERIES
    queries[HEADLINE[0]](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
