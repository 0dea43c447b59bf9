"""Queries of joins, overviews, winners, upserts, lifecycle gates and pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import identity
from gridloom.functions import timecode as T
from gridloom.operators import catalog as C
from gridloom.operators import facts, lifecycle as L, partitioning as P, pixels as X
from gridloom.plans import covers, duck, rules, views
from gridloom.plans.registry import query


def units(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    c = lambda *p: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in p])
    return li.select(
        c("A", k, ":b", n).alias("band_unit_id"), c("A", k).alias("asset_id"), c("S", k).alias("scene_id"), c("b", n).alias("band_code"),
        c("R", k % 200).alias("partition_run_id"), c("D", k % 50).alias("dataset_id"),
        F.when(F.col("l_suppkey") % 3 == 0, "geohash").when(F.col("l_suppkey") % 3 == 1, "mgrs").otherwise("isea4h").alias("grid_type"), (F.col("l_partkey") % 2 + 3).alias("grid_level"),
        F.when(F.col("l_returnflag") == "A", "completed").when(F.col("l_returnflag") == "N", "failed").otherwise("queued").alias("partition_status"),
        F.when(F.col("l_tax") > 0.06, "warn").when(F.col("l_linestatus") == "O", "pass").otherwise("fail").alias("quality_status"),
        F.when(F.col("l_discount") > 0.05, "completed").when(F.col("l_discount") < 0.02, "failed").otherwise("pending").alias("ingest_status"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"), (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 1000 + F.col("l_quantity").cast("long")).alias("pos"),
    )


def run_scenes(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    r = k % 200
    st = F.col("o_orderstatus")
    status = (
        F.when(r < 40, "completed").when(r < 60, "failed").when(r < 70, "cancelled").when(st == "F", "completed")
        .when(st == "P", F.when(r < 130, "running").otherwise("failed")).otherwise("queued")
    )
    c = lambda p, x: F.concat(F.lit(p), x)
    return o.select(
        c("R", r).alias("partition_run_id"), c("S", k).alias("scene_id"), c("D", k % 50).alias("dataset_id"), c("L", F.col("o_custkey") % 97).alias("load_batch_id"), status.alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"), k.alias("pos"), F.when(k % 4 > 0, c("v", k % 4)).alias("output_version"), F.col("o_totalprice").alias("price"),
    )


def register(name, sql):
    """Query of (units, run scenes)."""
    return lambda fn: query(name, sql)(lambda s, d: fn(units(s, d), run_scenes(s, d)))


# --- D: joins ------------------------------------------------------------------


@query(
    "d10_output_snapshot",
    """SELECT i.output_id, i.scene_id, b.band_type AS band_name, s.source_uri, c.west, CASE WHEN i.pos % 79 <> 0 THEN 64 END AS width
       FROM index_rows i JOIN asset_rows s ON s.source_asset_id = i.source_asset_id
       JOIN (SELECT DISTINCT asset_id, band_code FROM bands) sb ON sb.asset_id = i.source_asset_id AND sb.band_code = i.band_code
       LEFT JOIN (SELECT asset_id, band_code, min(band_type) AS band_type FROM bands GROUP BY 1, 2) b ON b.asset_id = i.source_asset_id AND b.band_code = i.band_code
       JOIN cell_rows c ON c.dataset_id = i.dataset_id AND c.space_code = i.space_code AND c.grid_level = i.grid_level
       WHERE (CASE WHEN i.pos % 5 = 0 THEN NULL ELSE 'x' END) IS NOT DISTINCT FROM (CASE WHEN i.pos % 5 = 0 THEN NULL WHEN i.pos % 7 = 0 THEN 'y' ELSE 'x' END)
         AND (i.pos % 5 = 0 OR i.pos % 7 <> 0)""",
)
def _(spark, sf_dir):
    t = rules.tables(spark, sf_dir)
    b = views.bands(spark, sf_dir).withColumnRenamed("asset_id", "source_asset_id")
    s = views.scenes(spark, sf_dir).select(F.col("asset_id").alias("source_asset_id"), "dataset_id")
    named = b.groupBy("source_asset_id", "band_code").agg(F.min("band_type").alias("band_name")).join(s, "source_asset_id")
    pos = F.col("pos")
    # The topology code belongs to the index; cells carry none, so an index with one finds no cell.
    idx = t["indexes"].withColumn("topology_code", F.when(pos % 5 != 0, F.when(pos % 7 == 0, "y")))
    tables = {
        "indexes": idx, "assets": t["assets"], "bands": named, "tiles": t["tiles"].withColumn("tile_uri", F.lit("u")),
        "cells": t["cells"].withColumn("topology_code", F.lit(None).cast("string")),
        "scene_bands": b.select(F.col("source_asset_id").alias("asset_id"), "band_code").distinct().withColumns(
            {"band_unit_id": F.concat_ws(":", "asset_id", "band_code"), "scene_id": F.concat(F.lit("S"), F.substring("asset_id", 2, 20))}
        ),
    }
    idx2 = idx.drop("scene_id")
    out = C.output_snapshot({**tables, "indexes": idx2})
    return out.select("output_id", "scene_id", "band_name", "source_uri", F.col("bbox")[0].alias("west"), F.col("width").cast("long").alias("width"))


@query("d11_asset_scene_map", "SELECT l_orderkey, l_linenumber, 'S' || l_orderkey AS scene_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def _(spark, sf_dir):
    s = views.scenes(spark, sf_dir).select("asset_id", "scene_id")
    rows = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("A"), "l_orderkey").alias("source_asset_id"))
    return C.with_scene(rows, s).select("l_orderkey", "l_linenumber", "scene_id")


query("d12_missing_tiles", "SELECT output_id FROM index_rows WHERE pos % 79 = 0")(lambda s, d: rules.Q.rule_output_reference_integrity(rules.tables(s, d)).select("output_id"))
query("d13_used_assets", "SELECT DISTINCT dataset_id, source_asset_id FROM index_rows")(lambda s, d: rules.Q.used_assets(rules.tables(s, d)).select("dataset_id", "source_asset_id"))


@query(
    "d14_orphan_counts",
    """SELECT 'unit_scene' AS relation, count(*) AS n FROM unit_rows u WHERE NOT EXISTS (SELECT 1 FROM scenes s WHERE s.scene_id = u.scene_id AND s.status = 'available')
       UNION ALL SELECT 'run_batch', count(*) FROM run_rows r WHERE NOT EXISTS (SELECT 1 FROM run_rows x WHERE x.load_batch_id = r.load_batch_id AND x.status = 'cancelled')
       UNION ALL SELECT 'scene_dataset', count(*) FROM scenes s WHERE NOT EXISTS (SELECT 1 FROM run_rows r WHERE r.dataset_id = s.dataset_id)
       UNION ALL SELECT 'run_unit', count(*) FROM run_rows r WHERE NOT EXISTS (SELECT 1 FROM unit_rows u WHERE u.scene_id = r.scene_id)
       UNION ALL SELECT 'grid_band', count(*) FROM unit_rows u WHERE NOT EXISTS (SELECT 1 FROM bands b WHERE b.asset_id = u.asset_id AND b.band_code = u.band_code AND b.band_type = 'spectral')""",
)
def _(spark, sf_dir):
    u, r, s, b = units(spark, sf_dir), run_scenes(spark, sf_dir), views.scenes(spark, sf_dir), views.bands(spark, sf_dir)
    return C.orphan_counts(
        [
            ("unit_scene", u, s.filter("status = 'available'"), {"scene_id": "scene_id"}),
            ("run_batch", r, r.filter("status = 'cancelled'"), {"load_batch_id": "load_batch_id"}),
            ("scene_dataset", s, r, {"dataset_id": "dataset_id"}),
            ("run_unit", r, u, {"scene_id": "scene_id"}),
            ("grid_band", u, b.filter("band_type = 'spectral'"), {"asset_id": "asset_id", "band_code": "band_code"}),
        ]
    )


@register("d15_latest_per_dataset", "SELECT dataset_id, arg_max(partition_run_id, (created_at, pos)) AS partition_run_id, arg_max(status, (created_at, pos)) AS status FROM run_rows GROUP BY 1")
def _(u, r):
    return L.latest_per(r, ["dataset_id"], [F.col("created_at"), F.col("pos")], ["partition_run_id", "status"])


@query(
    "d16_tile_st_code",
    """SELECT output_id, st_code FROM (SELECT t.output_id, i.st_code, row_number() OVER (PARTITION BY t.output_id ORDER BY (i.tile_output_id = t.output_id) DESC, i.created_at DESC, i.output_id) AS rn
       FROM (SELECT tile_output_id AS output_id, dataset_id, space_code FROM index_rows WHERE pos % 79 <> 0) t
       JOIN (SELECT output_id, dataset_id, space_code, st_code, acquisition_time AS created_at, CASE WHEN pos % 3 = 0 THEN 'lost' ELSE tile_output_id END AS tile_output_id FROM index_rows) i
       ON i.dataset_id = t.dataset_id AND i.space_code = t.space_code) WHERE rn = 1""",
)
def _(spark, sf_dir):
    i = rules.index_rows(spark, sf_dir)
    same = {"source_asset_id": F.lit("a"), "band_code": F.lit("b"), "grid_level": F.lit(3), "time_bucket": F.lit("t")}
    tiles = i.filter("pos % 79 <> 0").select("dataset_id", "output_version", "grid_type", "space_code", F.col("tile_output_id").alias("output_id")).withColumns(same)
    idx = i.select(
        "dataset_id", "output_version", "grid_type", "space_code", "output_id", "st_code", F.col("acquisition_time").alias("created_at"),
        F.when(F.col("pos") % 3 == 0, "lost").otherwise(F.col("tile_output_id")).alias("tile_output_id"),
    ).withColumns(same)
    return C.tile_st_code(tiles, idx).select("output_id", "st_code")


@query(
    "d17_enrich_errors",
    """SELECT i.output_id AS error_key, i.source_asset_id, i.band_code, i.tile_output_id AS tile_id, CASE WHEN i.pos % 79 <> 0 THEN true END AS tile_exists, i.scene_id, b.band_type AS band_name
       FROM index_rows i LEFT JOIN (SELECT asset_id, band_code, min(band_type) AS band_type FROM bands GROUP BY 1, 2) b ON b.asset_id = i.source_asset_id AND b.band_code = i.band_code
       WHERE i.pos % 89 = 0""",
)
def _(spark, sf_dir):
    t = rules.tables(spark, sf_dir)
    found = rules.Q.rule_time_bucket_consistency(t)
    half = F.crc32("index_id") % 2 == 0
    found = found.withColumns({"error_key": F.col("index_id"), "index_id": F.when(half, F.col("index_id"))})
    assets = views.scenes(spark, sf_dir).select(F.col("asset_id").alias("source_asset_id"), "scene_id")
    names = views.bands(spark, sf_dir).groupBy(F.col("asset_id").alias("source_asset_id"), "band_code").agg(F.min("band_type").alias("band_name"))
    out = C.enrich_errors(found, t["indexes"], t["tiles"], assets, names)
    return out.select("error_key", "source_asset_id", "band_code", "tile_id", "tile_exists", "scene_id", "band_name")


@register(
    "d18_member_or_all",
    """SELECT scene_id, partition_run_id FROM run_rows WHERE pos % 3 = 0 OR dataset_id IN ('D1', 'D2', 'D30')""",
)
def _(u, r):
    ids = F.when(F.col("pos") % 3 == 0, "[]").otherwise('["D1","D2","D30"]')
    return r.filter(C.member_or_all(ids, F.col("dataset_id"))).select("scene_id", "partition_run_id")


@register(
    "d19_names_in_order",
    """SELECT r.scene_id, p AS pos, CASE WHEN n % 7 = 0 THEN 'L' || n ELSE 'batch ' || n END AS name FROM
       (SELECT scene_id, 0 AS p, pos % 97 AS n FROM run_rows UNION ALL SELECT scene_id, 1, (pos + 13) % 97 FROM run_rows) r""",
)
def _(u, r):
    ids = r.select("scene_id", F.array(F.concat(F.lit("L"), F.col("pos") % 97), F.concat(F.lit("L"), (F.col("pos") + 13) % 97)).alias("ids"))
    number = F.substring("load_batch_id", 2, 10).cast("int")
    names = r.select("load_batch_id").distinct().filter(number % 7 != 0).withColumn("batch_name", F.concat(F.lit("batch "), number))
    return C.lookup_names(ids, "ids", names, "load_batch_id", "batch_name", "scene_id").withColumn("pos", F.col("pos").cast("long"))


_ASKED = "(SELECT DISTINCT load_batch_id FROM run_rows WHERE CAST(substr(load_batch_id, 2) AS INTEGER) % 2 = 0 UNION ALL SELECT 'L' || (1000 + CAST(substr(load_batch_id, 2) AS INTEGER)) FROM (SELECT DISTINCT load_batch_id FROM run_rows))"


def _asked(r):
    n = F.substring("load_batch_id", 2, 10).cast("int")
    one = r.select("load_batch_id").distinct()
    return one.filter(n % 2 == 0).unionByName(one.select(F.concat(F.lit("L"), n + 1000).alias("load_batch_id")))


@query("d20_eligible_scenes", f"SELECT r.scene_id, r.load_batch_id FROM run_rows r JOIN scenes s USING (scene_id) WHERE s.status = 'available' AND r.load_batch_id IN (SELECT load_batch_id FROM {_ASKED})")
def _(spark, sf_dir):
    r = run_scenes(spark, sf_dir)
    return C.eligible_scenes(_asked(r), r, views.scenes(spark, sf_dir))[0].select("scene_id", "load_batch_id")


@query("d20_unavailable_batches", f"SELECT load_batch_id FROM {_ASKED} EXCEPT SELECT r.load_batch_id FROM run_rows r JOIN scenes s USING (scene_id) WHERE s.status = 'available'")
def _(spark, sf_dir):
    r = run_scenes(spark, sf_dir)
    return C.eligible_scenes(_asked(r), r, views.scenes(spark, sf_dir))[1]


@register(
    "d21_already_ingested",
    """SELECT DISTINCT u.band_unit_id, u.grid_type, u.grid_level FROM unit_rows u JOIN run_rows r USING (partition_run_id, scene_id)
       WHERE u.partition_status = 'completed' AND u.ingest_status = 'completed' AND CAST(substr(r.load_batch_id, 2) AS INTEGER) % 4 = 1""",
)
def _(u, r):
    batches = r.filter(F.substring("load_batch_id", 2, 9).cast("int") % 4 == 1).select("load_batch_id").distinct()
    return C.already_ingested(u.select("band_unit_id").distinct(), u, r, batches)


@register("d21_already_done", "SELECT DISTINCT band_unit_id FROM unit_rows WHERE grid_type = 'geohash' AND grid_level = 3 AND partition_status = 'completed'")
def _(u, r):
    return C.already_done(u.select("band_unit_id").distinct(), u, "geohash", 3)


@register(
    "d22_pending_batches",
    """SELECT DISTINCT load_batch_id FROM run_rows r WHERE EXISTS (SELECT 1 FROM unit_rows u WHERE u.scene_id = r.scene_id AND NOT EXISTS (SELECT 1 FROM unit_rows d WHERE d.band_unit_id = u.band_unit_id AND d.ingest_status = 'completed'))""",
)
def _(u, r):
    batches = r.select("load_batch_id").distinct()
    of_batch = r.select("load_batch_id", "scene_id").join(u.select("scene_id", "band_unit_id"), "scene_id")
    return C.pending_batches(batches, of_batch, u)


@register(
    "d23_pending_configs",
    """SELECT DISTINCT dataset_id, grid_type, lv FROM (SELECT dataset_id, grid_type, CASE WHEN grid_level = 4 THEN 4 END AS lv FROM unit_rows) q WHERE NOT EXISTS
       (SELECT 1 FROM unit_rows u WHERE u.partition_status = 'completed' AND pos % 50 = 0 AND u.dataset_id = q.dataset_id AND u.grid_type = q.grid_type AND (CASE WHEN u.grid_level = 4 THEN 4 END) IS NOT DISTINCT FROM q.lv)""",
)
def _(u, r):
    x = u.withColumns({"lv": F.when(F.col("grid_level") == 4, F.col("grid_level")), "status": F.col("partition_status")})
    keys = ["dataset_id", "grid_type", "lv"]
    return C.pending_configs(x.select(*keys).distinct(), x.filter("pos % 50 = 0"), keys)


@register("d24_visible", "SELECT scene_id FROM run_rows WHERE dataset_id NOT IN (SELECT dataset_id FROM run_rows WHERE pos % 1000 = 3)")
def _(u, r):
    hidden = r.filter("pos % 1000 = 3").select("dataset_id", F.lit("guest").alias("role"))
    return C.visible(r, hidden, "guest").select("scene_id")


@query(
    "d25_having_scene",
    """SELECT DISTINCT dataset_id FROM unit_rows u WHERE EXISTS (SELECT 1 FROM scenes s WHERE s.dataset_id = u.dataset_id AND acq_time >= TIMESTAMP '1998-11-01' AND status = 'available')
       AND EXISTS (SELECT 1 FROM scenes s WHERE s.dataset_id = u.dataset_id AND acq_time <= TIMESTAMP '1995-01-20' AND status = 'available')""",
)
def _(spark, sf_dir):
    s = views.scenes(spark, sf_dir).filter("status = 'available'")
    return C.having_scene(units(spark, sf_dir).select("dataset_id").distinct(), s, "1998-11-01", "1995-01-20")


@query(
    "d26_nested_status",
    """SELECT s.dataset_id, s.scene_id, u.band_unit_id, u.grid_type, u.grid_level, u.partition_status, count(*) AS n FROM scenes s JOIN (SELECT DISTINCT scene_id, band_unit_id FROM unit_rows) b USING (scene_id)
       LEFT JOIN unit_rows u USING (band_unit_id) GROUP BY ALL""",
)
def _(spark, sf_dir):
    u = units(spark, sf_dir)
    bands = u.select("scene_id", "band_unit_id", "band_code").distinct()
    out = C.nest_status(views.scenes(spark, sf_dir).select("dataset_id", "scene_id"), bands, u.drop("scene_id", "dataset_id", "band_code"))
    return out.groupBy("dataset_id", "scene_id", "band_unit_id", "grid_type", "grid_level", "partition_status").agg(F.count("*").alias("n"))


_KEYED = "(SELECT scene_id, dataset_id, 'K' || (pos % 3000) AS scene_key, pos FROM scenes)"


@query("d27_reassign_conflicts", f"SELECT a.scene_id, b.scene_id AS existing_scene_id FROM {_KEYED} a JOIN {_KEYED} b ON b.dataset_id = 'D' || (a.pos % 50) AND b.scene_key = a.scene_key AND b.scene_id <> a.scene_id")
def _(spark, sf_dir):
    s = views.scenes(spark, sf_dir).select("scene_id", "dataset_id", F.concat(F.lit("K"), F.col("pos") % 3000).alias("scene_key"), "pos")
    moves = s.select("scene_id", F.concat(F.lit("D"), F.col("pos") % 50).alias("new_dataset_id"))
    return C.reassign_conflicts(s, moves).select("scene_id", "existing_scene_id")


# --- E: winners and summaries ----------------------------------------------------


def candidates(spark, sf_dir):
    """Stamped asset tasks at geohash level 2: many scenes compete in a cell, month and band."""
    a = covers.assets(spark, sf_dir)
    t = P.build_tasks(a, "geohash", 2)
    return P.stamp(t, "month").withColumns({"asset_path": F.col("asset_id"), "sample_mean_band1": F.when(F.col("sample_mean") % 5 == 0, 0.0).otherwise(F.col("sample_mean"))})


_CAND = f"""(SELECT scene_id, asset_id, space_code, strftime(acq_time, '%Y%m') AS time_bucket, band, acq_time, band_pos, CASE WHEN sample_mean % 5 = 0 THEN 0 ELSE sample_mean END AS m
    FROM ({duck.geohash_cover('(SELECT s.*, b.band_code AS band, b.pos AS band_pos, b.sample_mean FROM scenes s JOIN bands b USING (asset_id))', 2)}))"""
_KEY = "space_code, time_bucket, band"


def _winner(rule):
    def run(spark, sf_dir):
        out = facts.resolve_facts(candidates(spark, sf_dir), rule, ("asset_path",))
        return out.select("space_code", "time_bucket", "band", "winner_scene_id", "asset_path", "source_scene_count")

    return run


for _name, _rule, _order in (
    ("e1_latest_wins", "latest_wins", "(acq_time, scene_id)"),
    ("e2_best_quality_wins", "best_quality_wins", "(CASE WHEN m = 0 THEN -1e300 ELSE m END, acq_time, scene_id)"),
    ("e3_approved_output_wins", "quality_approved_output", "(acq_time, scene_id)"),
):
    query(
        _name,
        f"SELECT {_KEY}, arg_max(scene_id, {_order}) AS winner_scene_id, arg_max(asset_id, {_order}) AS asset_path, count(DISTINCT scene_id) AS source_scene_count FROM {_CAND} GROUP BY {_KEY}",
    )(_winner(_rule))


@query("e4_provenance", f"SELECT DISTINCT {_KEY}, scene_id AS candidate_scene_id FROM {_CAND}")
def _(spark, sf_dir):
    return facts.provenance(candidates(spark, sf_dir)).select("space_code", "time_bucket", "band", "candidate_scene_id")


_PICK = "SELECT asset_id, band_code, {f}(band_type, {o}) AS band_type, {f}(sample_mean, {o}) AS sample_mean FROM bands GROUP BY 1, 2"
_POS = "(pos, time_start, band_type)"


def _bands(spark, sf_dir):
    return views.bands(spark, sf_dir).withColumn("order", F.struct("pos", "time_start", "band_type"))


@query("e5_dedupe_assets", "SELECT asset_id, band_code, arg_max(band_type, (time_start, -pos)) AS band_type FROM bands GROUP BY 1, 2")
def _(spark, sf_dir):
    return facts.dedupe_assets(views.bands(spark, sf_dir), "time_start", "pos", ("asset_id", "band_code")).select("asset_id", "band_code", "band_type")


@query("e6_first_per_key", _PICK.format(f="arg_min", o=_POS))
def _(spark, sf_dir):
    return facts.first_per(_bands(spark, sf_dir), ["asset_id", "band_code"], "order").select("asset_id", "band_code", "band_type", "sample_mean")


@query("e7_last_per_key", _PICK.format(f="arg_max", o=_POS))
def _(spark, sf_dir):
    return facts.last_per(_bands(spark, sf_dir), ["asset_id", "band_code"], "order").select("asset_id", "band_code", "band_type", "sample_mean")


query("e8_summarize_xco2", "SELECT count(xco2) AS n, min(xco2) AS xco2_min, max(xco2) AS xco2_max, round(avg(xco2), 6) AS xco2_avg FROM obs")(lambda s, d: facts.summarize_xco2(views.obs(s, d)))


@query(
    "e9_summarize_rows",
    """SELECT 'rows' AS measure, '' AS key, count(*) AS n FROM index_rows UNION ALL SELECT 'cells', '', count(DISTINCT space_code) FROM index_rows
       UNION ALL SELECT 'st_codes', '', count(DISTINCT st_code) FROM index_rows UNION ALL SELECT 'by_band_code', band_code, count(*) FROM index_rows GROUP BY 2
       UNION ALL SELECT 'by_time_bucket', time_bucket, count(*) FROM index_rows GROUP BY 2""",
)
def _(spark, sf_dir):
    return facts.summarize_rows(rules.index_rows(spark, sf_dir), ("band_code", "time_bucket"))


@query("e10_rows_by_year", "SELECT 'by_year' AS measure, CAST(year(acq_time) AS VARCHAR) AS key, count(*) AS n FROM scenes GROUP BY 2")
def _(spark, sf_dir):
    return facts.count_by_each(views.scenes(spark, sf_dir).withColumn("year", F.year("acq_time")), ("year",))


@query(
    "e11_summarize_observations",
    """SELECT 'by_quality_flag' AS measure, coalesce(quality_flag, '') AS key, CAST(count(*) AS DOUBLE) AS value FROM obs GROUP BY 2 UNION ALL SELECT 'by_product_type', product_type, count(*) FROM obs GROUP BY 2
       UNION ALL SELECT 'by_satellite', satellite, count(*) FROM obs GROUP BY 2 UNION ALL SELECT 'by_time_bucket', strftime(acq_time, '%Y%m%d'), count(*) FROM obs GROUP BY 2
       UNION ALL SELECT 'rows', '', count(*) FROM obs UNION ALL SELECT 'xco2_min', '', round(min(xco2), 6) FROM obs UNION ALL SELECT 'xco2_max', '', round(max(xco2), 6) FROM obs UNION ALL SELECT 'xco2_avg', '', round(avg(xco2), 6) FROM obs""",
)
def _(spark, sf_dir):
    return facts.summarize_observations(views.obs(spark, sf_dir).withColumn("time_bucket", T.time_bucket("acq_time")))


_F = "count(DISTINCT band_unit_id) FILTER (WHERE {})"


@register(
    "e13_run_overview",
    f"""SELECT r.partition_run_id, d.dataset_count, d.scene_count, coalesce(b.band_count, 0) AS band_count, coalesce(b.p, 0) AS partitioned_count, coalesce(b.pf, 0) AS partition_failed_count, coalesce(b.q, 0) AS quality_pass_count,
        coalesce(b.qf, 0) AS quality_failed_count, coalesce(b.i, 0) AS ingested_count, coalesce(b.f, 0) AS ingest_failed_count FROM (SELECT DISTINCT partition_run_id FROM run_rows) r
        JOIN (SELECT partition_run_id, count(DISTINCT dataset_id) AS dataset_count, count(DISTINCT scene_id) AS scene_count FROM run_rows GROUP BY 1) d USING (partition_run_id)
        LEFT JOIN (SELECT partition_run_id, count(DISTINCT band_unit_id) AS band_count, {_F.format("partition_status='completed'")} AS p, {_F.format("partition_status='failed'")} AS pf, {_F.format("quality_status IN ('pass','warn')")} AS q,
          {_F.format("quality_status IN ('fail','error')")} AS qf, {_F.format("ingest_status='completed'")} AS i, {_F.format("ingest_status='failed'")} AS f FROM unit_rows GROUP BY 1) b USING (partition_run_id)""",
)
def _(u, r):
    return C.run_overview(r.select("partition_run_id").distinct(), r, u)


@query(
    "e14_dataset_overview",
    """SELECT d.dataset_id, count(s.scene_id) AS scene_count, count(s.scene_id) FILTER (WHERE s.status = 'available') AS ready_scene_count, count(s.scene_id) FILTER (WHERE s.status = 'failed') AS failed_scene_count,
       strftime(min(acq_time), '%Y%m%d') AS t0, strftime(max(acq_time), '%Y%m%d') AS t1, min(1 + pos % 77) AS resolution_m
       FROM (SELECT dataset_id FROM (SELECT DISTINCT dataset_id FROM scenes) UNION ALL SELECT 'E' || dataset_id FROM (SELECT DISTINCT dataset_id FROM scenes)) d LEFT JOIN scenes s USING (dataset_id) GROUP BY 1""",
)
def _(spark, sf_dir):
    out = _overview(spark, sf_dir)
    return out.select("dataset_id", "scene_count", "ready_scene_count", "failed_scene_count", F.date_format("time_start", "yyyyMMdd").alias("t0"), F.date_format("time_end", "yyyyMMdd").alias("t1"), "resolution_m")


def _overview(spark, sf_dir):
    s = views.scenes(spark, sf_dir).withColumn("resolution_m", F.col("pos") % 77 + 1)
    d = s.select("dataset_id").distinct()
    d = d.unionByName(d.select(F.concat(F.lit("E"), "dataset_id").alias("dataset_id")))
    return C.dataset_overview(d.withColumn("spatial_extent", F.array(*[F.lit(float(v)) for v in (-1, -2, 3, 4)])), s)


@query(
    "e15_spatial_extent",
    """SELECT dataset_id, min(min_lon) AS west, min(min_lat) AS south, max(max_lon) AS east, max(max_lat) AS north FROM scenes GROUP BY 1
       UNION ALL SELECT DISTINCT 'E' || dataset_id, CAST(-1 AS DOUBLE), CAST(-2 AS DOUBLE), CAST(3 AS DOUBLE), CAST(4 AS DOUBLE) FROM scenes""",
)
def _(spark, sf_dir):
    return _overview(spark, sf_dir).select("dataset_id", "west", "south", "east", "north")


_M = ", ".join(
    f"count(*) FILTER (WHERE grid_type = '{g}' AND {c}) AS {g}_{n}"
    for g in C.GRIDS
    for n, c in (("partition", "partition_status = 'completed'"), ("quality", "quality_status IN ('pass', 'warn')"), ("ingest", "ingest_status = 'completed'"))
)


@register("e16_grid_matrix", f"SELECT dataset_id, {_M}, count(DISTINCT band_unit_id) AS total FROM unit_rows GROUP BY 1")
def _(u, r):
    return C.grid_matrix(u.drop("dataset_id"), u.select("dataset_id", "band_unit_id").distinct())


@query(
    "e17_catalog_totals",
    """SELECT 'dataset_count' AS measure, count(DISTINCT dataset_id) AS n FROM scenes UNION ALL SELECT 'scene_count', count(*) FROM scenes
       UNION ALL SELECT 'ready_scene_count', count(*) FROM scenes WHERE status = 'available' UNION ALL SELECT 'failed_scene_count', count(*) FROM scenes WHERE status = 'failed'""",
)
def _(spark, sf_dir):
    s = views.scenes(spark, sf_dir)
    return C.catalog_totals(s.select("dataset_id").distinct(), s)


register("e18_batch_summary", "SELECT load_batch_id, count(*) AS scene_count, count(DISTINCT dataset_id) AS dataset_count FROM run_rows GROUP BY 1")(lambda u, r: C.batch_summary(r))
register(
    "e19_ingest_summary",
    "SELECT dataset_id, count(DISTINCT partition_run_id) AS runs, count(*) AS scenes, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed FROM run_rows GROUP BY 1",
)(lambda u, r: C.ingest_summary(r.select("dataset_id", "partition_run_id").distinct(), r))
register(
    "e20_ingest_collections",
    """SELECT partition_run_id, count(*) AS unit_count, count(*) FILTER (WHERE ingest_status = 'completed') AS ingested, count(DISTINCT scene_id) AS scene_count, count(DISTINCT (grid_type, grid_level)) AS grid_config_count,
       CASE WHEN count(*) = count(*) FILTER (WHERE ingest_status = 'completed') THEN 'completed' WHEN count(*) FILTER (WHERE ingest_status = 'completed') > 0 THEN 'partial' ELSE 'pending' END AS state FROM unit_rows GROUP BY 1""",
)(lambda u, r: C.ingest_collections(u))
register(
    "e21_band_summary",
    """SELECT count(*) AS bands, count(*) FILTER (WHERE p = 'completed') AS partitioned, count(*) FILTER (WHERE p = 'failed') AS partition_failed, count(*) FILTER (WHERE q IN ('pass', 'warn')) AS quality_passed,
       count(*) FILTER (WHERE q = 'fail') AS quality_failed, count(*) FILTER (WHERE i = 'completed') AS ingested, count(*) FILTER (WHERE i = 'failed') AS ingest_failed
       FROM (SELECT band_unit_id, arg_max(partition_status, pos) AS p, arg_max(quality_status, pos) AS q, arg_max(ingest_status, pos) AS i FROM unit_rows GROUP BY 1)""",
)(lambda u, r: C.band_summary(u, "pos"))
register("e22_source_batches", "SELECT DISTINCT dataset_id AS scene_id, load_batch_id FROM run_rows")(lambda u, r: C.source_batches(r.select(F.col("dataset_id").alias("scene_id"), "load_batch_id")))


@register("e23_attempt_overview", "SELECT r.scene_id AS task_id, CASE WHEN r.pos % 3 = 0 THEN 2 ELSE coalesce(n, 0) END AS asset_count FROM run_rows r LEFT JOIN (SELECT scene_id, count(*) AS n FROM unit_rows GROUP BY 1) u USING (scene_id)")
def _(u, r):
    listed = F.when(F.col("pos") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    out = C.attempt_overview(r.select(F.col("scene_id").alias("task_id"), listed.alias("assets")), u.withColumnRenamed("scene_id", "task_id"))
    return out.select("task_id", "asset_count")


_ROLL = """CASE WHEN bool_and(status = 'completed') THEN 'completed' WHEN bool_and(status = 'failed') THEN 'failed' WHEN bool_or(status = 'completed') AND bool_or(status IN ('failed', 'cancelled')) THEN 'partial_failure'
    WHEN bool_or(status = 'running') THEN 'running' WHEN bool_or(status IN ('pending', 'queued')) THEN 'queued' WHEN bool_and(status = 'cancelled') THEN 'cancelled' ELSE 'pending' END"""
register("e24_status_rollup", f"SELECT partition_run_id, {_ROLL} AS status, count(*) AS scene_count FROM run_rows GROUP BY 1")(lambda u, r: L.rollup_status(r, ["partition_run_id"]))


# --- pixels ------------------------------------------------------------------------


def pixel_windows(spark, sf_dir):
    """Two windows per asset path."""
    p = views.pixels(spark, sf_dir).select("asset_path").distinct()
    n = F.substring("asset_path", 2, 10).cast("int")
    w = p.withColumn("w", F.explode(F.array(F.lit(0), F.lit(1))))
    return w.select(
        "asset_path", "w", (n % 30 + F.col("w") * 5).cast("long").alias("window_col_off"), (n % 20 + F.col("w") * 9).cast("long").alias("window_row_off"), F.lit(28).alias("window_width"), F.lit(33).alias("window_height"),
        (n % 3 * 40).alias("canvas_col"), (F.col("w") * 20).alias("canvas_row"),
    )


_W = """(SELECT asset_path, w, n % 30 + w * 5 AS c0, n % 20 + w * 9 AS r0, n % 3 * 40 AS cc, w * 20 AS cr FROM (SELECT DISTINCT asset_path, CAST(substr(asset_path, 2) AS INTEGER) AS n FROM pixels), (VALUES (0), (1)) t(w))"""
_IN = f"pixels p JOIN {_W} w ON w.asset_path = p.asset_path AND p.col >= c0 AND p.col < c0 + 28 AND p.row >= r0 AND p.row < r0 + 33"


@query("e27_zonal_mean", f"SELECT p.asset_path, w, round(avg(CASE WHEN is_valid THEN value END), 6) AS sample_mean, count(CASE WHEN is_valid THEN value END) AS valid_pixels, count(*) AS pixels FROM {_IN} GROUP BY 1, 2")
def _(spark, sf_dir):
    out = X.zonal_stats(views.pixels(spark, sf_dir), pixel_windows(spark, sf_dir), ["asset_path", "w"])
    return out.withColumn("sample_mean", F.round("sample_mean", 6))


query("e28_pixel_counts", "SELECT asset_path, count(*) FILTER (WHERE is_valid) AS valid, count(*) FILTER (WHERE is_valid AND value <> 0) AS nonzero, count(*) AS total FROM pixels GROUP BY 1")(
    lambda s, d: X.pixel_counts(views.pixels(s, d))
)


@query(
    "e29_entity_tiles",
    f"""SELECT asset_path, band, space_code, count(*) AS pixels, count(*) FILTER (WHERE is_valid) AS valid_pixels, max(col) - min(col) + 1 AS width, max("row") - min("row") + 1 AS height,
        round(count(*) FILTER (WHERE is_valid) / count(*), 6) AS valid_ratio
        FROM ({duck.isea4h_cells("(SELECT *, CAST(col AS DOUBLE) * 0.5 - 20 AS lon, CAST(row AS DOUBLE) * 0.5 + 5 AS lat FROM pixels)", 'lon', 'lat', 6)}) GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE is_valid) > 0""",
)
def _(spark, sf_dir):
    lon, lat = F.col("col").cast("double") * 0.5 - 20, F.col("row").cast("double") * 0.5 + 5
    return X.entity_tiles(views.pixels(spark, sf_dir), lon, lat, "isea4h", 6)


@query("e30_mosaic", f'SELECT band, cr + p."row" - r0 AS canvas_row_no, cc + col - c0 AS canvas_col_no, arg_max(value, (p.asset_path, w, order_key, tie)) AS value FROM {_IN} WHERE value <> 0 AND is_valid GROUP BY 1, 2, 3')
def _(spark, sf_dir):
    return X.mosaic(views.pixels(spark, sf_dir), pixel_windows(spark, sf_dir), ["asset_path", "w", "order_key", "tie"])


@query(
    "e31_merge_grid_cells",
    """SELECT dataset_id, space_code, sum(n) AS tile_count, sum(n) AS index_count, bool_or(space_code LIKE 's%' AND band_code = 'b1') AND count(*) > 1 AS conflict FROM
       (SELECT dataset_id, space_code, band_code, count(*) AS n FROM index_rows GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    per = rules.index_rows(spark, sf_dir).groupBy("dataset_id", "space_code", "band_code").agg(F.count("*").alias("tile_count"), F.count("*").alias("index_count"))
    odd = F.col("space_code").startswith("s") & (F.col("band_code") == "b1")
    return C.merge_grid_cells(per.withColumn("geometry", F.when(odd, "other").otherwise("same")), ["dataset_id", "space_code"], "geometry")


query("e34_listing_count", "SELECT count(*) AS total FROM scenes WHERE status = 'failed'")(lambda s, d: C.count_of(views.scenes(s, d).filter("status = 'failed'")))

# --- G, H ----------------------------------------------------------------------------

register("g2_page", "SELECT scene_id, price FROM (SELECT scene_id, CASE WHEN pos % 9 <> 0 THEN price END AS price FROM run_rows) ORDER BY price DESC NULLS LAST, scene_id DESC LIMIT 50 OFFSET 100")(
    lambda u, r: C.page(r.select("scene_id", F.when(F.col("pos") % 9 != 0, F.col("price")).alias("price")), "price", ("price",), "scene_id", "desc", 50, 100)
)
register("g3_oldest_groups", "SELECT load_batch_id, strftime(min(created_at), '%Y%m%d') AS oldest, count(*) AS n_rows FROM run_rows GROUP BY 1 ORDER BY min(created_at), load_batch_id LIMIT 10")(
    lambda u, r: L.oldest_groups(r, 10, "load_batch_id").withColumn("oldest", F.date_format("oldest", "yyyyMMdd"))
)
register("g4_stable_order", "SELECT scene_id, dataset_id FROM run_rows")(
    lambda u, r: r.select("scene_id", "dataset_id").orderBy(F.length("scene_id"), "scene_id")
)
register("g6_newest_first", "SELECT scene_id FROM run_rows ORDER BY created_at DESC, scene_id DESC LIMIT 100")(
    lambda u, r: C.page(r, "created_at", ("created_at",), "scene_id", "desc", 100).select("scene_id")
)


@query(
    "h1_provenance_timeline",
    """SELECT 'load_batch' AS relation_type, load_batch_id AS relation_id, dataset_id, scene_id, status FROM run_rows UNION ALL SELECT 'partition_run', partition_run_id, dataset_id, scene_id, status FROM run_rows
       UNION ALL SELECT 'ingest_run', 'I' || partition_run_id, dataset_id, scene_id, ingest_status FROM unit_rows UNION ALL SELECT 'scene_reassignment', 'X' || pos, dataset_id, scene_id, status FROM run_rows WHERE pos % 10 = 0
       UNION ALL SELECT 'dataset_audit', strftime(created_at, '%Y-%m-%d'), dataset_id, NULL, x FROM run_rows, (VALUES ('create'), ('rename')) t(x) WHERE pos % 20 = 1""",
)
def _(spark, sf_dir):
    u, r = units(spark, sf_dir), run_scenes(spark, sf_dir)
    parts = {
        "load_batch": r.withColumn("relation_id", F.col("load_batch_id")), "partition_run": r.withColumn("relation_id", F.col("partition_run_id")),
        "ingest_run": u.withColumns({"relation_id": F.concat(F.lit("I"), "partition_run_id"), "status": F.col("ingest_status")}),
        "scene_reassignment": r.filter("pos % 10 = 0").withColumn("relation_id", F.concat(F.lit("X"), "pos")),
    }
    day = F.date_format("created_at", "yyyy-MM-dd")
    entry = lambda a: F.concat(F.lit('{"changed_at":"'), day, F.lit(f'","action":"{a}"}}'))
    audits = r.filter("pos % 20 = 1").select("dataset_id", F.concat(F.lit("["), entry("create"), F.lit(","), entry("rename"), F.lit("]")).alias("management_audit"))
    return C.provenance(parts, audits).drop("created_at")


@register("h2_outputs_and_scene_rows", "SELECT output_version, partition_run_id, NULL AS scene_id, 'partition_output' AS source_kind FROM (SELECT DISTINCT output_version, partition_run_id FROM run_rows) UNION ALL SELECT output_version, partition_run_id, scene_id, 'scene_partition' FROM run_rows")
def _(u, r):
    a = r.select("output_version", "partition_run_id").distinct()
    return C.union_view(a, r.select("output_version", "partition_run_id", "scene_id"), "partition_output", "scene_partition").select("output_version", "partition_run_id", "scene_id", "source_kind")


@register(
    "h3_difference",
    """SELECT scene_id, 'missing' AS side FROM (SELECT scene_id FROM run_rows EXCEPT SELECT scene_id FROM unit_rows WHERE partition_status = 'completed')
       UNION ALL SELECT scene_id, 'unexpected' FROM (SELECT scene_id FROM unit_rows WHERE partition_status = 'completed' EXCEPT SELECT scene_id FROM run_rows)""",
)
def _(u, r):
    return C.difference(r, u.filter("partition_status = 'completed'"), ["scene_id"])


register("h4_quality_targets", "SELECT DISTINCT partition_run_id, dataset_id, output_version FROM run_rows WHERE output_version IS NOT NULL")(lambda u, r: C.quality_targets(r))
register("h5_union_of_runs", "SELECT scene_id, count(*) AS n FROM (SELECT scene_id FROM run_rows WHERE pos % 2 = 0 UNION ALL SELECT scene_id FROM run_rows WHERE pos % 3 = 0) GROUP BY 1")(
    lambda u, r: r.filter("pos % 2 = 0").unionByName(r.filter("pos % 3 = 0")).groupBy("scene_id").agg(F.count("*").alias("n"))
)
