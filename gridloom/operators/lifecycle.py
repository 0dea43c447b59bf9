"""Gating, retry, publication and cleanup decisions as table operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of an error export, in order.
EXPORT_COLUMNS = (
    "quality_error_id", "quality_run_id", "rule_code", "scene_id", "scene_name", "source_asset_id", "band_code", "band_name",
    "tile_id", "index_id", "output_id", "row_number", "field", "error_code", "message", "context", "created_at",
)


def export_rows(errors: DataFrame, filters: dict | None = None) -> DataFrame:
    """Errors in export form: 17 text columns, JSON context, texts that a spreadsheet would run made safe."""
    df = errors
    for column, value in (filters or {}).items():
        df = df.filter(F.col(column) == value)
    cols = []
    for name in EXPORT_COLUMNS:
        c = F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
        if name == "context":
            c = F.coalesce(c, F.lit("{}"))
        cols.append(F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c).alias(name))
    return df.select(*cols)


def export_errors(errors: DataFrame, path: str, fmt: str = "csv", filters: dict | None = None) -> None:
    """Write the export as CSV (with header) or JSON lines, one file per task."""
    rows = export_rows(errors, filters)
    if fmt == "csv":
        # The byte order mark lets spreadsheets read the header as UTF-8.
        first = f"﻿{EXPORT_COLUMNS[0]}"
        rows.withColumnRenamed(EXPORT_COLUMNS[0], first).write.mode("errorifexists").option("header", True).csv(path)
    else:
        rows.write.mode("errorifexists").json(path)


# Error classes in order, with the words that tell them.
ERROR_CLASSES = (
    ("grid_limit", ("max_candidate_cells", "max_output_cells", "gridlimitexceeded")),
    ("source_missing", ("not found", "no such file", "no such key", "missing", "does not exist", "source missing")),
    ("transient", ("timed out", "timeout", "temporarily", "temporary", "connection reset", "connection refused", "network", "503", "502", "504")),
    ("validation", ("invalid", "validation", "bad request", "unsupported", "must be", "required")),
    ("permission", ("permission denied", "access denied", "forbidden", "unauthorized")),
)


def error_class(text: Column) -> Column:
    """Class of an error text; the first class with a word in it wins."""
    low = F.lower(text)
    hits = [(name, reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])) for name, words in ERROR_CLASSES]
    expr = F.when(hits[0][1], hits[0][0])
    for name, hit in hits[1:]:
        expr = expr.when(hit, name)
    return expr.otherwise("unknown")


def classify_errors(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(error_class(F.col(column)).alias("error_class")).agg(F.count("*").alias("n"))


def rollup_status(scenes: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """Status of a run from the statuses of its scenes."""
    is_ = lambda *s: F.col(status).isin(*s)
    every, some = (lambda *s: F.bool_and(is_(*s))), (lambda *s: F.bool_or(is_(*s)))
    value = (
        F.when(every("completed"), "completed")
        .when(every("failed"), "failed")
        .when(some("completed") & some("failed", "cancelled"), "partial_failure")
        .when(some("running"), "running")
        .when(some("pending", "queued"), "queued")
        .when(every("cancelled"), "cancelled")
        .otherwise("pending")
    )
    return scenes.groupBy(*keys).agg(value.alias("status"), F.count("*").alias("scene_count"))


def latest_per(df: DataFrame, keys: list[str], order: list[Column], take: list[str]) -> DataFrame:
    """The row of each key that is last in ``order``; combines before its shuffle."""
    best = F.max_by(F.struct(*take), F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in take])


def retry_units(attempts: DataFrame, mode: str = "failed", key: str = "run_id") -> DataFrame:
    """Band units of the last attempt of each run to be tried again: the failed ones, or all unfinished, of datasets that are not completed."""
    last = attempts.groupBy(key).agg(F.max("attempt").alias("attempt"))
    rows = attempts.join(last, [key, "attempt"], "left_semi").filter(~F.coalesce(F.col("dataset_status") == "completed", F.lit(False)))
    if mode == "failed":
        return rows.filter(F.col("status") == "failed")
    return rows.filter(F.coalesce(F.col("status") != "completed", F.lit(True)))


def retry_inputs(bands: DataFrame, assets: DataFrame, reported: DataFrame, retry: DataFrame):
    """Bands and assets of a new attempt: ``(bands, assets)``.

    Datasets with reported units (dataset_id, band_unit_id) keep the bands to be retried and the
    assets those lie in; datasets that reported none are taken whole.
    """
    told = reported.select("dataset_id").distinct()
    kept = bands.join(told, "dataset_id", "left_anti").unionByName(bands.join(told, "dataset_id", "left_semi").join(retry.select("dataset_id", "band_unit_id").distinct(), ["dataset_id", "band_unit_id"], "left_semi"))
    whole = assets.join(told, "dataset_id", "left_anti")
    part = assets.join(told, "dataset_id", "left_semi").join(kept.select("dataset_id", "source_asset_id").distinct(), ["dataset_id", "source_asset_id"], "left_semi")
    return kept, whole.unionByName(part)


def resolve_version(df: DataFrame, current: DataFrame, requested: str = "requested_version") -> DataFrame:
    """Add the output version meant by each row: the one asked for, else the dataset's current one."""
    now = current.select("dataset_id", F.col("current_output_version").alias("__current"))
    return df.join(now, "dataset_id", "left").withColumn("output_version", F.coalesce(requested, "__current")).drop("__current")


def complete_outputs(datasets: DataFrame, versions: DataFrame, results: DataFrame):
    """Finish output versions: fill counts, supersede older ones, switch the current pointer, reset quality.

    ``results`` has one row per finished (dataset, version) with its counts and
    completion time; the newest of a dataset becomes current.
    """
    names = ("tile_count", "index_count", "grid_cell_count")
    done = results.select("dataset_id", "output_version", *[F.col(c).alias(f"__{c}") for c in names], F.col("completed_at").alias("__at"))
    newest = results.groupBy("dataset_id").agg(F.max_by("output_version", F.struct("completed_at", "output_version")).alias("__new"))
    v = versions.join(done, ["dataset_id", "output_version"], "left").join(newest, "dataset_id", "left")
    finished = F.col("__at").isNotNull()
    status = (
        F.when(finished & (F.col("output_version") == F.col("__new")), "completed")
        .when((finished | (F.col("status") == "completed")) & F.col("__new").isNotNull(), "superseded")
        .otherwise(F.col("status"))
    )
    v = v.withColumns({"status": status, **{c: F.coalesce(f"__{c}", c) for c in names}}).drop("__at", "__new", *[f"__{c}" for c in names])
    d = datasets.join(newest, "dataset_id", "left")
    changed = F.col("__new").isNotNull()
    d = d.withColumns(
        {
            "current_output_version": F.coalesce("__new", "current_output_version"),
            "quality_status": F.when(changed, "pending").otherwise(F.col("quality_status")),
        }
    ).drop("__new")
    return d, v


def current_units(outputs: DataFrame) -> DataFrame:
    """Latest completed output of every band unit, so that redoing some bands leaves the others' outputs in place."""
    done = outputs.filter(F.col("status") == "completed")
    return latest_per(done, ["dataset_id", "band_unit_id"], [F.col("completed_at"), F.col("output_version")], ["output_version", "completed_at"])


def id_conflicts(df: DataFrame, key: str) -> DataFrame:
    """Ids given to rows of different content."""
    content = F.xxhash64(*[c for c in df.columns if c != key])
    pairs = df.select(key, content.alias("__h")).distinct()
    return pairs.groupBy(key).agg(F.count("*").alias("versions")).filter("versions > 1")


def plan_ingest(datasets: DataFrame, run_scenes: DataFrame, runs: DataFrame, partition_runs: DataFrame, unit_status: DataFrame, allow_warn: bool = False, manual: bool = False) -> DataFrame:
    """Scenes to ingest after quality, one row per run, band unit and scene.

    Only an accepted dataset status (warn where allowed), an active dataset, the
    current version (unless manual), completed scenes of completed partition
    runs, and units whose own partition is completed with pass or warn count.
    """
    ok = F.col("quality_status") == "pass"
    ok = ok | ((F.col("quality_status") == "warn") & (F.lit(allow_warn) | F.col("allow_warn")))
    gate = ok & (F.col("dataset_status") == "active")
    if not manual:
        gate = gate & F.col("auto_ingest") & F.col("current_output_version").isNotNull()
    open_sets = datasets.join(runs, "dataset_id").filter(gate)
    rows = run_scenes.filter((F.col("status") == "completed") & F.col("output_version").isNotNull()).join(open_sets, "dataset_id")
    if not manual:
        rows = rows.filter(F.col("output_version") == F.col("current_output_version"))
    rows = rows.join(completed_runs(partition_runs), "partition_run_id", "left_semi")
    units = unit_status.filter((F.col("partition_status") == "completed") & F.col("quality_status").isin("pass", "warn")).select("partition_run_id", "scene_id", "band_unit_id")
    rows = rows.join(units, ["partition_run_id", "scene_id"])
    return rows.select("partition_run_id", "band_unit_id", "dataset_id", "scene_id", "output_version", "quality_run_id").distinct()


def completed_runs(partition_runs: DataFrame) -> DataFrame:
    return partition_runs.filter(F.col("status") == "completed").select("partition_run_id")


def plan_manual_ingest(quality_runs: DataFrame, partition_runs: DataFrame, run_scenes: DataFrame, unit_status: DataFrame, selected: DataFrame):
    """Plan for chosen bands (partition_run_id, band_unit_id): ``(eligible, refused)``.

    A band is eligible when its run and scene are completed, its own partition
    is completed with pass or warn, it is not ingested yet, and its dataset and
    output version have a complete quality run with pass or warn; the newest of
    those is named, whatever failed after it.
    """
    good = quality_runs.filter(F.col("result_complete") & F.col("status").isin("pass", "warn"))
    # Rows without a completion time come last.
    order = [F.col("completed_at"), F.col("created_at"), F.col("quality_run_id")]
    good = latest_per(good, ["dataset_id", "output_version"], [F.coalesce(order[0], F.lit("0001-01-01").cast("timestamp")), *order[1:]], ["quality_run_id"])
    units = unit_status.filter((F.col("partition_status") == "completed") & F.col("quality_status").isin("pass", "warn") & (F.col("ingest_status") != "completed"))
    scenes = run_scenes.filter(F.col("status") == "completed").select("partition_run_id", "scene_id", "dataset_id", "output_version")
    key = ["partition_run_id", "band_unit_id"]
    rows = units.select(*key, "scene_id").join(selected, key, "left_semi").join(completed_runs(partition_runs), "partition_run_id", "left_semi")
    eligible = rows.join(scenes, ["partition_run_id", "scene_id"]).join(good, ["dataset_id", "output_version"])
    refused = selected.join(eligible.select(*key), key, "left_anti")
    return eligible.select(*key, "dataset_id", "scene_id", "output_version", "quality_run_id").distinct(), refused


def publication_eligibility(t: dict[str, DataFrame]) -> DataFrame:
    """First failing condition of each dataset's publication, or NULL where it may be published.

    Tables: ``datasets`` (current output and quality run), ``versions``,
    ``quality_runs``, ``approvals``, ``partition_runs``, ``ingest_runs`` and
    ``ingest_scenes``.  The newest ingest run of a completed partition run counts.
    """
    d = t["datasets"].select("dataset_id", "current_output_version", "current_quality_run_id")
    v = t["versions"].select("dataset_id", F.col("output_version").alias("current_output_version"), F.col("status").alias("v_status"))
    q = t["quality_runs"].select(
        F.col("quality_run_id").alias("current_quality_run_id"), F.col("dataset_id").alias("q_dataset"), F.col("output_version").alias("q_version"),
        F.col("status").alias("q_status"), "result_complete", "rule_set_version",
    )
    a = t["approvals"].select(F.col("quality_run_id").alias("current_quality_run_id"), F.col("rule_set_version").alias("a_version"))
    ingest_runs = t["ingest_runs"].join(completed_runs(t["partition_runs"]), "partition_run_id", "left_semi")
    last = latest_per(ingest_runs, ["dataset_id"], [F.col("created_at"), F.col("ingest_run_id")], ["ingest_run_id", "status"]).withColumnRenamed("status", "i_status")
    wrong = (F.col("status") != "completed") | ~F.col("output_version").eqNullSafe(F.col("current_output_version"))
    scenes = t["ingest_scenes"].join(last.select("ingest_run_id", "dataset_id"), "ingest_run_id").join(d.select("dataset_id", "current_output_version"), "dataset_id")
    scenes = scenes.groupBy("dataset_id").agg(F.count("*").alias("n_scenes"), F.count_if(wrong).alias("n_wrong"))
    rows = d.join(v, ["dataset_id", "current_output_version"], "left").join(q, "current_quality_run_id", "left")
    rows = rows.join(a, "current_quality_run_id", "left").join(last, "dataset_id", "left").join(scenes, "dataset_id", "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    reason = (
        F.when(F.col("current_output_version").isNull() | F.col("current_quality_run_id").isNull(), "no_current_output")
        .when(no(F.col("v_status") == "completed"), "output_not_completed")
        .when(no((F.col("q_dataset") == F.col("dataset_id")) & (F.col("q_version") == F.col("current_output_version")) & F.col("result_complete")), "quality_run_not_complete")
        .when((F.col("q_status") == "warn") & no(F.col("a_version") == F.col("rule_set_version")), "warn_not_approved")
        .when(no(F.col("q_status").isin("pass", "warn")), "quality_status")
        .when(no(F.col("i_status") == "completed"), "ingest_not_completed")
        .when(no(F.col("n_scenes") > 0) | (F.col("n_wrong") > 0), "ingest_of_other_version")
    )
    return rows.select("dataset_id", reason.isNull().alias("eligible"), reason.alias("reason"))


def check_targets(targets: DataFrame, bands: DataFrame, indexes: DataFrame) -> DataFrame:
    """Publication targets that are no band of the dataset, or are not partitioned, with the reason."""
    key = ["dataset_id", "source_asset_id", "band_code"]
    foreign = targets.join(bands.select(*key), key, "left_anti").withColumn("reason", F.lit("not_in_dataset"))
    owned = targets.join(bands.select(*key), key, "left_semi")
    idle = owned.join(indexes.select(*key), key, "left_anti").withColumn("reason", F.lit("not_partitioned"))
    return foreign.unionByName(idle)


def cleanup_candidates(versions: DataFrame, datasets: DataFrame, publications: DataFrame, objects: DataFrame, manifest: DataFrame, older_than: str) -> DataFrame:
    """Output versions that may be removed: not current, not published, not younger than the cutoff, with the expected prefix and a whole manifest.

    The later of ``completed_at`` and ``failed_at`` tells the age; a version without either is young.
    ``manifest`` and ``objects`` have dataset_id, output_version, object_key, byte_size and checksum:
    every manifest entry must name an object once, below the version's prefix, with that size and checksum.
    """
    key = ["dataset_id", "output_version"]
    current = datasets.select("dataset_id", F.col("current_output_version").alias("output_version"))
    rows = versions.join(current, key, "left_anti").join(publications.select(*key), key, "left_anti")
    prefix = F.concat_ws("/", F.lit("outputs"), "dataset_id", F.concat("output_version", F.lit("/")))
    ended = F.greatest("completed_at", "failed_at")  # nulls are passed over
    rows = rows.filter((F.col("object_prefix") == prefix) & (ended <= F.lit(older_than).cast("timestamp")))
    there = objects.select("object_key", F.col("byte_size").alias("__size"), F.col("checksum").alias("__sum")).distinct()
    entries = manifest.groupBy(*key, "object_key").agg(F.count("*").alias("__n"), F.max("byte_size").alias("byte_size"), F.max("checksum").alias("checksum")).join(there, "object_key", "left")
    whole = (F.col("__n") == 1) & F.startswith(F.col("object_key"), prefix) & F.coalesce((F.col("byte_size") == F.col("__size")) & (F.col("checksum") == F.col("__sum")), F.lit(False))
    checked = entries.groupBy(*key).agg(F.bool_and(whole).alias("__whole")).filter("__whole").select(*key)
    return rows.join(checked, key, "left_semi")


def claimable_groups(run_scenes: DataFrame, runs: DataFrame, now: Column, n: int | None) -> DataFrame:
    """Oldest (dataset, output version) groups with work: scenes queued in a queued or running run, or running in a running one without an update for five minutes."""
    stale = (F.col("status") == "running") & (F.col("run_status") == "running") & (F.col("updated_at") < now - F.expr("INTERVAL 5 MINUTES"))
    waiting = (F.col("status") == "queued") & F.col("run_status").isin("queued", "running")
    rows = run_scenes.join(runs.select("ingest_run_id", "dataset_id", F.col("status").alias("run_status")), "ingest_run_id").filter(waiting | stale)
    out = rows.groupBy("dataset_id", "output_version").agg(F.min("created_at").alias("oldest"), F.count("*").alias("n_rows"))
    return out.orderBy("oldest", "dataset_id", "output_version").limit(n) if n else out


def oldest_groups(df: DataFrame, n: int | None, key: str, created: str = "created_at") -> DataFrame:
    """The first groups by their oldest row."""
    out = df.groupBy(key).agg(F.min(created).alias("oldest"), F.count("*").alias("n_rows"))
    return out.orderBy("oldest", key).limit(n) if n else out


def filter_listing(df: DataFrame, keyword: str | None = None, in_columns: tuple = (), equal: dict | None = None, bounds: tuple | None = None) -> DataFrame:
    """Listing filters: a word in any of some columns (any case), equalities, time bounds on a column."""
    out = df
    if keyword:
        out = out.filter(reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c)), F.lit(keyword.lower())) for c in in_columns]))
    for column, value in (equal or {}).items():
        if value is not None:
            out = out.filter(F.col(column) == value)
    if bounds:
        column, t0, t1 = bounds
        if t0 is not None:
            out = out.filter(F.col(column) >= F.lit(t0).cast("timestamp"))
        if t1 is not None:
            out = out.filter(F.col(column) <= F.lit(t1).cast("timestamp"))
    return out


# The grids a status row can name.
GRIDS = ("geohash", "mgrs", "isea4h")


def backfill_status(
    run_scenes: DataFrame, versions: DataFrame, bands: DataFrame, quality_runs: DataFrame, ingest_scenes: DataFrame, status: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(status rows, rejects) after filling in rows for runs from before the status of a band unit on a grid was kept.

    A run's scene (partition_run_id, scene_id, dataset_id, status, grid_config as JSON, output_version,
    attempt_count, error_message, created_at) names its grid type and level in its configuration or,
    failing that, in its output version (``versions``); without a known type and a level it is a reject.
    Its band units are the ids listed in the configuration or, where that lists none, the scene's own
    (``bands``).  Quality is the newest run's of the version (``quality_runs``; unfinished ones come
    last), ingest the newest that lists the unit (``ingest_scenes``, band_unit_ids as JSON); both are
    ``pending`` without one.  Rows of ``status`` stay as they are; of several runs of a unit on a
    grid the earliest is taken.
    """
    config = F.from_json("grid_config", "grid_type string, requested_grid_level int, band_unit_ids array<string>")
    runs = run_scenes.withColumn("__c", config)
    has_version = F.coalesce(F.col("output_version"), F.lit("")) != ""
    known = versions.select("dataset_id", "output_version", F.col("grid_type").alias("__type"), F.col("requested_grid_level").alias("__level"))
    runs = runs.join(known, ["dataset_id", "output_version"], "left")
    text = F.col("__c.grid_type")
    grid = F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.coalesce("__type", F.lit("")))
    runs = runs.withColumns({"grid_type": grid, "grid_level": F.coalesce("__c.requested_grid_level", "__level").cast("int")}).drop("__type", "__level")
    named = F.col("grid_type").isin(*GRIDS) & F.col("grid_level").isNotNull()
    rejects = runs.filter(~named).select("partition_run_id", "scene_id", "dataset_id", "grid_type", "grid_level")
    listed = F.filter(F.coalesce("__c.band_unit_ids", F.array().cast("array<string>")), lambda b: b.isNotNull() & (b != ""))
    runs = runs.filter(named).withColumn("__ids", listed).drop("__c", "grid_config")
    first = runs.filter(F.size("__ids") > 0).withColumn("band_unit_id", F.explode("__ids")).drop("__ids")
    own = bands.filter("band_unit_id is not null").select("scene_id", "band_unit_id")
    units = first.unionByName(runs.filter(F.size("__ids") == 0).drop("__ids").join(own, "scene_id"))
    keys = ["band_unit_id", "grid_type"]
    units = units.join(status.select(*keys), keys, "left_anti")
    fields = ["dataset_id", "scene_id", "grid_level", "partition_run_id", "status", "output_version", "attempt_count", "error_message"]
    units = units.groupBy(*keys).agg(F.min_by(F.struct(*fields), F.struct("created_at", "partition_run_id", "scene_id")).alias("r")).select(*keys, "r.*")
    done = F.struct(F.col("completed_at").isNotNull(), "completed_at", "created_at")
    judged = quality_runs.groupBy("dataset_id", "output_version").agg(F.max_by("status", done).alias("__quality"))
    entered = ingest_scenes.withColumn("band_unit_id", F.explode(F.array_distinct(F.from_json("band_unit_ids", "array<string>"))))
    entered = entered.groupBy("scene_id", "output_version", "band_unit_id").agg(F.max_by("status", "updated_at").alias("__ingest"))
    made = units.join(judged, ["dataset_id", "output_version"], "left").join(entered, ["scene_id", "output_version", "band_unit_id"], "left")
    pending = F.lit("pending")
    made = made.select(
        "dataset_id", "scene_id", *keys, "grid_level", "partition_run_id", F.col("status").alias("partition_status"),
        F.when(has_version, F.coalesce("__quality", pending)).otherwise(pending).alias("quality_status"),
        F.when(has_version, F.coalesce("__ingest", pending)).otherwise(pending).alias("ingest_status"),
        "output_version", F.coalesce("attempt_count", F.lit(0)).cast("int").alias("attempt_no"), "error_message",
    )
    return status.unionByName(made, allowMissingColumns=True), rejects
