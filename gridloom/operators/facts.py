"""Winners, dedupes, provenance, upserts and sinks of fact tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FACT_KEY = ("grid_type", "grid_level", "space_code", "time_bucket", "band")
RULES = ("latest_wins", "best_quality_wins", "quality_approved_output")


def winner_score(rule: str, time: str, scene: str, mean: str | None, pos: str | None) -> Column:
    """Sort key of a candidate; the largest wins, the earliest row on a full tie."""
    if rule not in RULES:
        raise ValueError(f"unsupported quality rule: {rule}")
    fields = []
    if rule == "best_quality_wins":
        # A mean of exactly 0.0 counts as missing.
        fields.append(F.coalesce(F.nullif(F.col(mean), F.lit(0.0)), F.lit(float("-inf"))).alias("q"))
    fields += [F.col(time).alias("t"), F.col(scene).alias("s")]
    if pos:
        fields.append((-F.col(pos)).alias("p"))
    return F.struct(*fields)


def resolve_facts(
    rows: DataFrame,
    rule: str = "latest_wins",
    payload: tuple = ("acq_time", "asset_path", "st_code"),
    key: tuple = FACT_KEY,
    time: str = "acq_time",
    scene: str = "scene_id",
    mean: str | None = "sample_mean_band1",
    pos: str | None = None,
) -> DataFrame:
    """One winning row per cell, bucket and band, with the number of scenes that competed.

    The first aggregation is per key and scene, which spreads a crowded cell
    over many tasks; the second sees one row per scene and combines before its
    shuffle, so no task ever holds a whole cell.
    """
    score = winner_score(rule, time, scene, mean, pos)
    fields = F.struct(*[F.col(c) for c in payload])
    per_scene = rows.groupBy(*key, scene).agg(F.max_by(fields, score).alias("__row"), F.max(score).alias("__score"))
    won = per_scene.groupBy(*key).agg(
        F.max_by(F.struct(F.col(scene).alias("scene"), F.col("__row").alias("row")), F.col("__score")).alias("__won"),
        F.count("*").alias("source_scene_count"),
    )
    return won.select(
        *key,
        F.col("__won.scene").alias("winner_scene_id"),
        *[F.col(f"__won.row.{c}").alias(c) for c in payload],
        "source_scene_count",
        F.lit(rule).alias("quality_rule"),
    )


def provenance(rows: DataFrame, key: tuple = FACT_KEY, scene: str = "scene_id") -> DataFrame:
    """Distinct candidate scenes of every fact, one row each.

    Kept as rows: a cell with millions of candidates is no longer than any other table.
    """
    return rows.select(*key, F.col(scene).alias("candidate_scene_id")).distinct()


def _pick(df: DataFrame, keys: list[str], order: Column, largest: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if largest else F.min_by
    out = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("__row"))
    return out.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def dedupe_assets(df: DataFrame, time: str = "acq_time", pos: str = "pos", keys: tuple = ("scene_id", "band")) -> DataFrame:
    """Latest row per scene and band; among equal times the first."""
    return _pick(df, list(keys), F.struct(F.col(time), -F.col(pos)), True)


def first_per(df: DataFrame, keys: list[str], pos: str | Column = "pos") -> DataFrame:
    """First row of each key in position order."""
    return _pick(df, keys, F.col(pos) if isinstance(pos, str) else pos, False)


def last_per(df: DataFrame, keys: list[str], pos: str | Column = "pos") -> DataFrame:
    """Last row of each key in position order."""
    return _pick(df, keys, F.col(pos) if isinstance(pos, str) else pos, True)


# ---------------------------------------------------------------------------
# summaries

def summarize_xco2(df: DataFrame, by: tuple = (), value: str = "xco2") -> DataFrame:
    """Count, least, greatest and mean value; an empty input gives 0 and NULLs."""
    aggs = [
        F.count(value).alias("n"),
        F.min(value).alias("xco2_min"),
        F.max(value).alias("xco2_max"),
        F.round(F.avg(value), 6).alias("xco2_avg"),
    ]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def summarize_rows(df: DataFrame, by: tuple = ("band", "time_bucket")) -> DataFrame:
    """Rows, distinct cells and distinct ST codes, and the row count of every value of some columns.

    Long form (``measure, key, n``), one pass over the counts by grouping sets.
    """
    total = df.agg(
        F.count("*").alias("rows"),
        F.count_distinct("space_code").alias("cells"),
        F.count_distinct("st_code").alias("st_codes"),
    )
    totals = total.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(k).alias("measure"), F.lit("").alias("key"), F.col(k).alias("n")) for k in total.columns]
            )
        ).alias("r")
    ).select("r.*")
    return totals.unionByName(count_by_each(df, by))


def count_by_each(df: DataFrame, columns: tuple) -> DataFrame:
    """Row count of every value of each column, in one scan (``measure, key, n``)."""
    pairs = F.array(
        *[
            F.struct(F.lit(f"by_{c}").alias("measure"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("key"))
            for c in columns
        ]
    )
    return df.select(F.explode(pairs).alias("p")).groupBy("p.measure", "p.key").agg(F.count("*").alias("n"))


def summarize_observations(df: DataFrame) -> DataFrame:
    """Counts by flag, product, satellite and bucket, and min/max/mean to six places (``measure, key, value``)."""
    counts = count_by_each(df, ("quality_flag", "product_type", "satellite", "time_bucket"))
    stats = df.agg(
        F.count("*").cast("double").alias("rows"),
        F.round(F.min("xco2"), 6).alias("xco2_min"),
        F.round(F.max("xco2"), 6).alias("xco2_max"),
        F.round(F.avg("xco2"), 6).alias("xco2_avg"),
    )
    rows = stats.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(k).alias("measure"), F.lit("").alias("key"), F.col(k).alias("value")) for k in stats.columns]
            )
        ).alias("r")
    ).select("r.*")
    return counts.select("measure", "key", F.col("n").cast("double").alias("value")).unionByName(rows)


# ---------------------------------------------------------------------------
# upserts

def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target with the source's rows put in by key; the source must hold one row per key."""
    kept = target.join(source.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(source, allowMissingColumns=True)


#: Partition values that are put into the scan of the target as literals; more are joined.
LITERAL_PARTITIONS = 1000


def upsert_table(
    spark: SparkSession, path: str, source: DataFrame, keys: list[str], partition_by: list[str]
) -> None:
    """Upsert into a partitioned parquet table that holds one row per key.

    Only partitions that the source touches, or that hold an old row of one of its keys, are read
    and rewritten, so a row whose partition changes leaves its old place.  A source with several
    rows of a key is refused.  The merged partitions are staged beside the table and moved in by
    dynamic partition overwrite; a failure before the move leaves the table as it was, and a batch
    run again after a failure in the move gives the same rows.
    """
    repeated = source.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").limit(1)
    if not repeated.isEmpty():
        raise ValueError(f"the source holds several rows of a key: {repeated.first()}")
    if not table_exists(spark, path):
        source.write.partitionBy(*partition_by).parquet(path)
        return
    target = spark.read.parquet(path)
    touched = source.select(*[F.col(c).cast(target.schema[c].dataType).alias(c) for c in partition_by]).distinct()
    if not set(partition_by) <= set(keys):
        touched = touched.union(target.join(source.select(*keys), keys, "left_semi").select(*partition_by)).distinct()
    few = touched.limit(LITERAL_PARTITIONS + 1).collect()
    current = in_partitions(target, few, partition_by) if len(few) <= LITERAL_PARTITIONS else target.join(touched, partition_by, "left_semi")
    staged = f"{path.rstrip('/')}_staged/{uuid.uuid4().hex}"
    upsert(current, source, keys).write.partitionBy(*partition_by).parquet(staged)
    merged = spark.read.schema(target.schema).parquet(staged)
    emptied = _emptied(current, merged, partition_by)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
    for row in emptied:
        _delete(spark, "/".join([path.rstrip("/"), *(_folder(spark, c, row[c]) for c in partition_by)]))
    _delete(spark, staged)


def in_partitions(target: DataFrame, rows: list, partition_by: list[str]) -> DataFrame:
    """Rows of the listed partitions; the condition is made of literals, so other partitions are not opened."""
    if not rows:
        return target.filter(F.lit(False))
    if len(partition_by) == 1:
        c = partition_by[0]
        values = [r[c] for r in rows if r[c] is not None]
        condition = F.col(c).isin(values) if values else F.lit(False)
        return target.filter(condition | F.col(c).isNull() if len(values) < len(rows) else condition)
    one = lambda r: reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.lit(r[c])) for c in partition_by])
    return target.filter(reduce(lambda p, q: p | q, map(one, rows)))


def _emptied(before: DataFrame, after: DataFrame, partition_by: list[str]) -> list:
    """Partitions that had rows and have none now (a row per partition folder)."""
    left, right = before.select(*partition_by).distinct().alias("l"), after.select(*partition_by).distinct().alias("r")
    return left.join(right, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in partition_by], "left_anti").collect()


def _folder(spark: SparkSession, column: str, value) -> str:
    text = None if value is None else str(value)
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(column, text)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def merge_catalog(target: DataFrame, source: DataFrame, keys: list[str], policy: dict[str, str]) -> DataFrame:
    """Upsert with a rule per column.

    ``replace`` takes the source's value, ``coalesce`` the source's where it is
    not NULL, ``keep`` the target's where there is one, ``merge_map`` joins two
    maps with the source's entries on top.
    """
    t, s = target.alias("t"), source.alias("s")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    both = t.withColumn("__t", F.lit(True)).alias("t").join(s.withColumn("__s", F.lit(True)).alias("s"), on, "full")
    in_t, in_s = F.col("t.__t").isNotNull(), F.col("s.__s").isNotNull()
    cols = [F.when(in_s, F.col(f"s.{k}")).otherwise(F.col(f"t.{k}")).alias(k) for k in keys]
    for name in target.columns:
        if name in keys:
            continue
        old, new = F.col(f"t.{name}"), F.col(f"s.{name}")
        how = policy.get(name, "replace")
        if how == "coalesce":
            value = F.coalesce(new, old)
        elif how == "keep":
            value = F.when(in_t, old).otherwise(new)
        elif how == "merge_map":
            fresh = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
            value = F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(fresh, new))
        else:
            value = F.when(in_s, new).otherwise(old)
        cols.append(value.alias(name))
    return both.select(*cols)


def identity_conflicts(target: DataFrame, source: DataFrame, keys: list[str], checked: list[str]) -> DataFrame:
    """Source rows whose identity exists in the target with other values."""
    t = target.select(*keys, *[F.col(c).alias(f"stored_{c}") for c in checked])
    differs = None
    for c in checked:
        d = ~F.col(c).eqNullSafe(F.col(f"stored_{c}"))
        differs = d if differs is None else differs | d
    return source.select(*keys, *checked).join(t, keys).filter(differs)


def insert_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target plus the source rows whose key it lacks."""
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def reset_if_changed(
    target: DataFrame, source: DataFrame, keys: list[str], payload: list[str], reset: dict[str, object]
) -> DataFrame:
    """Submitted rows that keep their progress columns only when the payload is the same as stored."""
    old = target.select(
        *keys,
        *[F.col(c).alias(f"__p_{c}") for c in payload],
        *[F.col(c).alias(f"__r_{c}") for c in reset],
        F.lit(True).alias("__known"),
    )
    joined = source.select(*keys, *payload).join(old, keys, "left")
    same = F.coalesce(F.col("__known"), F.lit(False))
    for c in payload:
        same = same & F.col(c).eqNullSafe(F.col(f"__p_{c}"))
    return joined.select(
        *keys, *payload, *[F.when(same, F.col(f"__r_{c}")).otherwise(F.lit(v)).alias(c) for c, v in reset.items()]
    )


def requeue_units(status: DataFrame, request: DataFrame, keys: list[str], column: str = "status") -> DataFrame:
    """Requested units that failed or were cancelled go back to ``pending``."""
    asked = request.select(*keys).distinct().withColumn("__asked", F.lit(True))
    again = F.col("__asked").isNotNull() & F.col(column).isin("failed", "cancelled")
    return status.join(asked, keys, "left").withColumn(column, F.when(again, "pending").otherwise(F.col(column))).drop("__asked")


def propagate_status(status: DataFrame, updates: DataFrame, keys: list[str], column: str = "status") -> DataFrame:
    """Overwrite a status column from another table where it has a row for the key."""
    new = updates.select(*keys, F.col(column).alias("__new"))
    return status.join(new, keys, "left").withColumn(column, F.coalesce("__new", F.col(column))).drop("__new")


# Rank of each run status; terminal states share the highest.
STATUS_RANK = {
    "pending": 0, "queued": 1, "running": 2, "completed": 3, "partial_failure": 3, "failed": 3, "cancelled": 3,
}


def status_rank(status: Column) -> Column:
    pairs = [F.lit(v) for item in STATUS_RANK.items() for v in item]
    return F.element_at(F.create_map(*pairs), status)


def advance_status(runs: DataFrame, updates: DataFrame, keys: list[str], column: str = "status") -> DataFrame:
    """Take an update only when it does not move a run back."""
    new = updates.select(*keys, F.col(column).alias("__new"))
    take = F.col("__new").isNotNull() & (
        (status_rank(F.col("__new")) > status_rank(F.col(column))) | (F.col("__new") == F.col(column))
    )
    return runs.join(new, keys, "left").withColumn(column, F.when(take, F.col("__new")).otherwise(F.col(column))).drop("__new")


def verify_written(target: DataFrame, expected: DataFrame, keys: list[str], ring: str | None = None) -> DataFrame:
    """Stored against expected row counts per run and version; ``ok`` tells whether the write holds."""
    closed = F.count_if(F.element_at(F.col(ring), 1) != F.element_at(F.col(ring), -1)) if ring else F.lit(0)
    stored = target.groupBy(*keys).agg(F.count("*").alias("stored"), closed.alias("open_rings"))
    out = expected.join(stored, keys, "left")
    have = F.coalesce("stored", F.lit(0))
    return out.withColumns(
        {
            "stored": have.cast("long"),
            "open_rings": F.coalesce("open_rings", F.lit(0)).cast("long"),
            "ok": (have > 0) & (have >= F.col("expected")) & (F.coalesce("open_rings", F.lit(0)) == 0),
        }
    )


# ---------------------------------------------------------------------------
# sinks

def write_rows(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Rows as JSON lines or parquet; the commit protocol makes the write all or nothing."""
    df.write.mode("errorifexists").format(fmt).save(path)


def job_report(df: DataFrame, name: str) -> DataFrame:
    """One-row report of a partition job."""
    return df.agg(
        F.lit(name).alias("job"),
        F.count("*").alias("rows"),
        F.count_distinct("space_code").alias("cells"),
        F.count_distinct("scene_id").alias("scenes"),
        F.min("time_bucket").alias("first_bucket"),
        F.max("time_bucket").alias("last_bucket"),
    )


def sanitize(c: Column) -> Column:
    """A path segment: anything but letters, digits, dot, dash and underscore becomes ``_``."""
    return F.regexp_replace(c.cast("string"), r"[^A-Za-z0-9._-]+", "_")


def with_object_key(df: DataFrame, prefix: str, fields: dict[str, str], file: str, out: str = "object_key") -> DataFrame:
    """Add ``prefix/name=value/.../file`` in the order of ``fields``."""
    parts = [F.lit(prefix.rstrip("/"))]
    parts += [F.concat(F.lit(f"{name}="), sanitize(F.col(c))) for name, c in fields.items()]
    return df.withColumn(out, F.concat_ws("/", *parts, F.element_at(F.split(F.col(file), "/"), -1)))


def asset_uri_map(rows: DataFrame, root: str, dataset: str, sensor: str, version: str, pos: str) -> DataFrame:
    """Distinct asset paths with the object key they are stored under (first row of each path)."""
    firsts = first_per(rows.select("asset_path", "scene_id", "acq_time", pos), ["asset_path"], pos)
    keyed = firsts.withColumns(
        {
            "dataset": F.lit(dataset),
            "sensor": F.lit(sensor),
            "acq_date": F.date_format("acq_time", "yyyy-MM-dd"),
            "version": F.lit(version),
        }
    )
    names = {"dataset": "dataset", "sensor": "sensor", "acq_date": "acq_date", "scene_id": "scene_id", "version": "version"}
    return with_object_key(keyed, root, names, "asset_path", "asset_uri").select("asset_path", "asset_uri")
