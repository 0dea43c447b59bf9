"""Rules in one pass, added rules, incremental evaluation and catalogue loads."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridloom.operators import catalogload as C
from gridloom.operators import quality as Q
from gridloom.streaming import observations as S

INDEX = (
    "dataset_id string, output_version string, output_id string, source_asset_id string, data_type string, time_bucket string, "
    "acquisition_time timestamp, attributes map<string, string>, st_code string"
)
DAY = datetime(2024, 5, 1)


def tables(spark):
    good = {"lon": "1", "lat": "2", "xco2": "400", "observation_id": "o", "quality_flag": "0"}
    rows = []
    for k in range(40):
        carbon = k % 2 == 0
        attributes = dict(good) if carbon else None
        if k % 8 == 0:
            attributes = {"center_lon": "200", "lat": "2", "xco2": "5000", "observation_id": "o", "quality_flag": " "}
        rows.append((f"d{k % 3}", "v1", f"i{k}", f"a{k}", "carbon" if carbon else "optical", "19990101" if k % 5 == 0 else "20240501", DAY, attributes, None if k % 7 == 0 else "s"))
    versions = [(f"d{k}", "v1", "carbon") for k in range(4)]
    return {"indexes": spark.createDataFrame(rows, INDEX), "versions": spark.createDataFrame(versions, "dataset_id string, output_version string, data_type string")}


LOCAL = sorted(Q.ROW_RULES)


def test_row_rules_in_one_scan_find_what_each_finds_alone(spark):
    t = tables(spark)
    alone = [fn(t) for code, fn, _, _ in Q.RULES if code in LOCAL]
    want = sorted(map(str, (r for df in alone for r in df.collect())))
    got = Q.evaluate(t, LOCAL)
    assert sorted(map(str, got.collect())) == want and len(want) > 20
    only = Q.row_findings(t["indexes"], LOCAL)._jdf.queryExecution().executedPlan().toString()
    assert only.count("Scan") == 1 and "Exchange" not in only
    none = Q.row_findings(t["indexes"].drop("attributes"), LOCAL).select("rule_code").distinct().collect()
    assert [r.rule_code for r in none] == ["time_bucket_consistency"]


def test_an_added_rule_runs(spark):
    def rule(t):
        return Q.finding(t["indexes"].filter("st_code is null"), "needs_code", "no_code", "an index row needs its code", index_id=F.col("output_id"))

    Q.register_rule("needs_code", rule, True, ("carbon", "optical"), ("xco2",))
    try:
        with pytest.raises(ValueError):
            Q.register_rule("needs_code", rule, False)
        found = Q.evaluate(tables(spark), ["needs_code"])
        assert {r.index_id for r in found.collect()} == {f"i{k}" for k in range(0, 40, 7)}
        datasets = spark.createDataFrame([("d0", "v1", "carbon", "xco2"), ("d1", "v1", "carbon", "ch4")], "dataset_id string, output_version string, data_type string, product_type string")
        snapshot = Q.rule_snapshot(Q.rules_table(spark).filter("rule_code = 'needs_code'"), datasets)
        assert [(r.dataset_id, r.status, r.finding_count) for r in Q.rule_status(found, snapshot).collect()] == [("d0", "fail", 2)]
    finally:
        Q.RULES.pop()
        Q.PRODUCT_TYPES.pop("needs_code")


def test_versions_are_evaluated_once(spark, tmp_path):
    t, schema = tables(spark), "dataset_id string, output_version string, status string"
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def load(arrived):
        return {name: df.join(arrived, list(Q.OUTPUT), "left_semi") for name, df in t.items()}

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        S.evaluate_incrementally(stream, load, out, checkpoint, LOCAL).awaitTermination()
        return sorted(map(str, spark.read.parquet(out).select(*Q.OUTPUT, *Q.FINDING).collect()))

    arrive = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
    arrive(("d0", "v1", "completed"), ("d1", "v1", "running"), ("d0", "v1", "completed"))
    want = lambda *names: sorted(map(str, Q.evaluate(load(spark.createDataFrame([(n, "v1") for n in names], "dataset_id string, output_version string")), LOCAL).collect()))
    assert run() == want("d0")
    arrive(("d1", "v1", "completed"), ("d0", "v1", "completed"))
    assert run() == want("d0", "d1")
    arrive(("d0", "v1", "completed"))
    assert run() == want("d0", "d1")
    arrive(("d3", "v1", "completed"))  # late, and with no row of its own
    assert run() == want("d0", "d1", "d3") and any("missing_carbon_indexes" in r for r in run())


# ------------------------------------------------------------------ catalogue


def a_load(spark, batch, checksum="c1", dataset="d1", scene="s1", label="new", loaded=None):
    attributes = {"k": label, label: "1"}
    return {
        "load_batches": spark.createDataFrame([(batch, label, loaded, attributes)], "load_batch_id string, batch_name string, loaded_at timestamp, attributes map<string, string>"),
        "datasets": spark.createDataFrame([(dataset, label, "active", attributes)], "dataset_id string, dataset_title string, status string, attributes map<string, string>"),
        "scenes": spark.createDataFrame([("key1", batch, scene, dataset, checksum, label, attributes)], "identity_key string, load_batch_id string, scene_id string, dataset_id string, checksum string, crs string, attributes map<string, string>"),
        "scene_assets": spark.createDataFrame([("key1", "a1", label)], "identity_key string, asset_id string, source_uri string"),
        "scene_bands": spark.createDataFrame([("key1", "a1", "b1", None)], "identity_key string, asset_id string, band_code string, attributes map<string, string>"),
    }


def test_catalogue_loads_are_whole_or_nothing(spark, tmp_path):
    root = str(tmp_path / "catalogue")
    assert all(df.count() == 0 for df in C.read_catalog(spark, root).values())
    first = C.load_catalog(spark, root, a_load(spark, "b1", loaded=DAY))
    assert {name: df.count() for name, df in first.items()} == dict.fromkeys(C.TABLES, 1)
    kept = {name: sorted(map(str, df.collect())) for name, df in first.items()}
    for bad in (a_load(spark, "b2", checksum="c2"), a_load(spark, "b2", dataset="d2"), a_load(spark, "b2") | {"scene_assets": spark.createDataFrame([("key9", "a1")], "identity_key string, asset_id string")}):
        with pytest.raises(C.CatalogConflict):
            C.load_catalog(spark, root, bad)
        assert {name: sorted(map(str, df.collect())) for name, df in C.read_catalog(spark, root).items()} == kept
    # Loaded again under another scene id: the scene, its asset and its band keep theirs.
    again = C.load_catalog(spark, root, a_load(spark, "b2", checksum=None, scene="other", label="later"))
    scene = again["scenes"].collect()
    assert [(r.scene_id, r.checksum, r.crs, r.status, r.attributes) for r in scene] == [("s1", None, "later", "loaded", {"k": "later", "new": "1", "later": "1"})]
    assert {r.scene_id for n in ("scene_assets", "scene_bands", "load_batch_scenes") for r in again[n].collect()} == {"s1"}
    assert {(r.load_batch_id, r.load_status) for r in again["load_batch_scenes"].collect()} == {("b1", "succeeded"), ("b2", "succeeded")}
    assert {(r.load_batch_id, r.loaded_at) for r in again["load_batches"].collect()} == {("b1", DAY), ("b2", None)}
    assert again["scene_bands"].first().attributes == {}
    once_more = C.load_catalog(spark, root, a_load(spark, "b1", label="last"))
    assert {(r.load_batch_id, r.loaded_at, r.batch_name) for r in once_more["load_batches"].collect()} == {("b1", DAY, "last"), ("b2", None, "later")}
