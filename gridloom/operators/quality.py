"""Quality rules and file checks: each takes tables and returns a table of findings.

The managed rules run over every output version in the tables at once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import stage

# Version of the rule set, and the optional rules.
RULE_SET_VERSION = "2026.07.21-v8"
OPTIONAL_RULES = (
    "asset_crs", "optical_band_contract", "radar_band_contract",
    "carbon_schema", "carbon_coordinates", "carbon_xco2_range", "carbon_quality_flags",
)
# Variable bands that an optical product may carry.
AUXILIARY_BANDS = (
    "aerosol_qa", "bqa", "cloud_qa", "pixel_qa", "qa_pixel", "qa_radsat", "radsat_qa", "sr_aerosol", "sr_qa_aerosol",
)
# Fields a carbon observation must have.
CARBON_FIELDS = ("lat", "lon", "observation_id", "quality_flag", "xco2")

# Sentences of the findings by error code; reports of findings carry them, so they are part of the results.
# A leading or trailing space marks where a count, method or list of names joins the sentence.
MESSAGES = {
    "missing_st_code": " index rows have no ST code",
    "output_count_mismatch": "output version counts do not match normalized detail rows",
    "missing_tile_reference": "index references a missing tile",
    "missing_output_version": "quality target has no output version",
    "tile_grid_mismatch": "tile grid does not match output version",
    "tile_kind_mismatch": " output requires ",
    "detail_grid_mismatch": "{table} grid does not match output version",
    "invalid_bbox": "grid cell bbox must be [west, south, east, north] in WGS84 bounds",
    "missing_time_bucket": "index has no time bucket",
    "time_bucket_mismatch": "time bucket does not match acquisition date",
    "invalid_carbon_source": "carbon source must be an s3 NetCDF/HDF5 asset matching source_format",
    "invalid_cog_uri": "source asset must use an s3 COG URI",
    "invalid_checksum": "source asset checksum must be a SHA-256 hex digest",
    "source_object_unreadable": "source object does not exist or cannot be opened",
    "missing_crs": "source asset CRS is required",
    "invalid_crs": "source asset CRS is not a valid coordinate reference system",
    "crs_metadata_mismatch": "declared CRS does not match the source raster CRS",
    "window_out_of_bounds": "index window exceeds tile dimensions",
    "missing_band_metadata": "source asset has no normalized band metadata",
    "invalid_band_type": "band_type must be {expected} for {data_type} data",
    "missing_carbon_fields": "missing carbon fields: ",
    "invalid_coordinates": "carbon coordinates are outside WGS84 bounds",
    "xco2_out_of_range": "xco2 must be between 0 and 1000 ppm",
    "missing_quality_flag": "carbon quality_flag is required",
    "missing_carbon_indexes": "carbon output has no observation indexes",
}

OUTPUT = ("dataset_id", "output_version")
FINDING = (
    "rule_code", "error_code", "message", "source_asset_id", "band_code", "tile_id", "index_id", "output_id",
    "row_number", "field", "context",
)

Tables = dict[str, DataFrame]


def _values(rule: str, error: Column | str, message: Column | str, parts: dict) -> list[Column]:
    """The columns of a finding."""

    def value(name):
        if name == "rule_code":
            return F.lit(rule)
        v = {"error_code": error, "message": message, **parts}.get(name)
        v = F.lit(v) if not isinstance(v, Column) else v
        return v.cast("bigint" if name == "row_number" else "string")

    return [value(n).alias(n) for n in FINDING]


def finding(df: DataFrame, rule: str, error: Column | str, message: Column | str, **parts) -> DataFrame:
    """Rows of ``df`` as findings; ``parts`` are columns or texts of the finding."""
    return df.select(*OUTPUT, *_values(rule, error, message, parts))


def _missing(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


# ---------------------------------------------------------------------------
# shared rules

def rule_index_schema(t: Tables) -> DataFrame:
    bad = t["indexes"].filter(F.col("st_code").isNull()).groupBy(*OUTPUT).agg(F.count("*").alias("n"))
    text = F.concat(F.col("n").cast("string"), F.lit(MESSAGES["missing_st_code"]))
    return finding(bad, "index_schema", "missing_st_code", text, field="st_code")


def output_counts(t: Tables) -> DataFrame:
    """Tile, index and cell counts of every output version; 0 where there are none."""
    parts = []
    for name, column in (("tiles", "tile_count"), ("indexes", "index_count"), ("cells", "grid_cell_count")):
        parts.append(t[name].select(*OUTPUT, *[F.lit(int(c == column)).alias(c) for c in ("tile_count", "index_count", "grid_cell_count")]))
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy(*OUTPUT).agg(*[F.sum(c).alias(c) for c in ("tile_count", "index_count", "grid_cell_count")])


def rule_output_count_consistency(t: Tables) -> DataFrame:
    names = ("tile_count", "index_count", "grid_cell_count")
    actual = output_counts(t).select(*OUTPUT, *[F.col(c).alias(f"actual_{c}") for c in names])
    joined = t["versions"].join(actual, list(OUTPUT), "left")
    same = reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.coalesce(f"actual_{c}", F.lit(0))) for c in names]
    )
    return finding(
        joined.filter(~same), "output_count_consistency", "output_count_mismatch",
        MESSAGES["output_count_mismatch"],
    )


def rule_output_reference_integrity(t: Tables) -> DataFrame:
    refs = t["indexes"].filter(F.col("tile_output_id").isNotNull())
    known = t["tiles"].select(F.col("output_id").alias("tile_output_id"))
    lost = refs.join(known, "tile_output_id", "left_anti")
    return finding(
        lost, "output_reference_integrity", "missing_tile_reference", MESSAGES["missing_tile_reference"],
        index_id=F.col("output_id"), output_id=F.col("output_id"),
    )


def rule_grid_method_agreement(t: Tables) -> DataFrame:
    rule = "grid_method_agreement"
    kind = F.when((F.col("data_type") != "carbon") & (F.col("partition_method") == "entity"), "entity_file").otherwise("logical_reference")
    versions = t["versions"].select(
        *OUTPUT, F.col("grid_type").alias("v_grid"), F.col("requested_grid_level").alias("v_level"),
        F.col("partition_method").alias("v_method"), kind.alias("v_kind"),
    )
    outputs = reduce(DataFrame.union, [t[n].select(*OUTPUT).distinct() for n in ("tiles", "indexes", "cells")]).distinct()
    lone = outputs.join(versions, list(OUTPUT), "left_anti")
    out = [finding(lone, rule, "missing_output_version", MESSAGES["missing_output_version"])]
    other = (F.col("grid_type") != F.col("v_grid")) | (F.col("grid_level") != F.col("v_level"))
    tiles = t["tiles"].join(versions, list(OUTPUT))
    tile = {"tile_id": F.col("output_id"), "output_id": F.col("output_id")}
    out.append(finding(tiles.filter(other), rule, "tile_grid_mismatch", MESSAGES["tile_grid_mismatch"], **tile))
    text = F.concat(F.col("v_method"), F.lit(MESSAGES["tile_kind_mismatch"]), F.col("v_kind"))
    out.append(finding(tiles.filter(F.col("tile_kind") != F.col("v_kind")), rule, "tile_kind_mismatch", text, field="tile_kind", **tile))
    for name, table in (("indexes", "partition_indexes"), ("cells", "partition_grid_cells")):
        rows = t[name].join(versions, list(OUTPUT)).filter(other)
        out.append(finding(rows, rule, "detail_grid_mismatch", MESSAGES["detail_grid_mismatch"].format(table=table), output_id=F.col("output_id")))
    return reduce(DataFrame.unionByName, out)


def bbox_is_valid(bbox: Column) -> Column:
    """``[west, south, east, north]`` (texts or numbers): four numbers, in bounds, not inverted."""
    n = [F.get(bbox, F.lit(k)).try_cast("double") for k in range(4)]
    ok = (F.size(bbox) == 4) & (n[0] >= -180) & (n[0] < n[2]) & (n[2] <= 180) & (n[1] >= -90) & (n[1] < n[3]) & (n[3] <= 90)
    return F.coalesce(ok, F.lit(False))


def rule_cell_bbox_validity(t: Tables) -> DataFrame:
    bad = t["cells"].filter(~bbox_is_valid(F.col("bbox")))
    return finding(
        bad, "cell_bbox_validity", "invalid_bbox", MESSAGES["invalid_bbox"],
        output_id=F.col("output_id"), field="bbox",
    )


def _time_bucket_row() -> tuple:
    bucket = F.coalesce("time_bucket", F.lit(""))
    empty = bucket == ""
    wrong = F.coalesce(~F.startswith(bucket, F.date_format("acquisition_time", "yyyyMMdd")), F.lit(False))
    parts = {"index_id": F.col("output_id"), "output_id": F.col("output_id"), "field": "time_bucket"}
    return empty | wrong, F.when(empty, "missing_time_bucket").otherwise("time_bucket_mismatch"), F.when(empty, MESSAGES["missing_time_bucket"]).otherwise(MESSAGES["time_bucket_mismatch"]), parts


def rule_time_bucket_consistency(t: Tables) -> DataFrame:
    return _row_rule(t["indexes"], "time_bucket_consistency")


def used_assets(t: Tables) -> DataFrame:
    """Assets with an index in an output, once per output version."""
    used = t["indexes"].select(*OUTPUT, "source_asset_id").distinct()
    return t["assets"].join(used, ["dataset_id", "source_asset_id"])


def object_uri_ok(uri: Column) -> Column:
    return F.coalesce(F.trim(uri).rlike(r"^s3://[^/?#]+/+[^/?#]"), F.lit(False))


def rule_asset_readability(t: Tables) -> DataFrame:
    """Contract part: URI scheme, suffix against format, checksum; and objects an inspection could not open."""
    rule = "asset_readability"
    a = used_assets(t).withColumn("carbon", F.col("data_type") == "carbon")
    uri = F.coalesce("source_uri", F.lit(""))
    fmt = F.coalesce("source_format", F.lit(""))
    suffix_ok = F.when(fmt == "netcdf", F.lower(uri).rlike(r"\.(nc|nc4)$")).when(fmt == "hdf5", F.lower(uri).rlike(r"\.(h5|hdf|hdf5)$")).otherwise(False)
    cog = F.coalesce(F.nullif(F.col("cog_uri"), F.lit("")), uri)
    good = F.when(F.col("carbon"), suffix_ok & object_uri_ok(uri)).otherwise((fmt == "cog") & object_uri_ok(cog))
    a = a.withColumns({"good_uri": good, "good_sum": F.coalesce(F.col("checksum").rlike("^[0-9a-f]{64}$"), F.lit(False))})
    asset = {"source_asset_id": F.col("source_asset_id")}
    out = [
        finding(
            a.filter(~F.col("good_uri")), rule,
            F.when(F.col("carbon"), "invalid_carbon_source").otherwise("invalid_cog_uri"),
            F.when(F.col("carbon"), MESSAGES["invalid_carbon_source"]).otherwise(MESSAGES["invalid_cog_uri"]),
            field=F.when(F.col("carbon"), "source_uri").otherwise("cog_uri"), **asset,
        ),
        finding(a.filter(~F.col("good_sum")), rule, "invalid_checksum", MESSAGES["invalid_checksum"], field="checksum", **asset),
    ]
    if "inspections" in t:
        seen = t["inspections"].filter("readable").select("dataset_id", "source_asset_id")
        lost = a.filter("good_uri and good_sum").join(seen, ["dataset_id", "source_asset_id"], "left_anti")
        out.append(finding(lost, rule, "source_object_unreadable", MESSAGES["source_object_unreadable"], field="source_uri", **asset))
    return reduce(DataFrame.unionByName, out)


def normal_crs(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(c), r"\s+", ""))


def rule_asset_crs(t: Tables) -> DataFrame:
    """Declared reference system: present, of a known form, and equal to the one an inspection recorded."""
    rule = "asset_crs"
    a = used_assets(t).filter(F.col("data_type") != "carbon")
    declared = normal_crs(F.col("crs"))
    empty = _missing(F.col("crs"))
    valid = F.coalesce(declared.rlike(r"^(EPSG:\d{4,6}|OGC:CRS84|CRS:84)$"), F.lit(False))
    asset = {"source_asset_id": F.col("source_asset_id"), "field": "crs"}
    out = finding(
        a.filter(empty | ~valid), rule, F.when(empty, "missing_crs").otherwise("invalid_crs"),
        F.when(empty, MESSAGES["missing_crs"]).otherwise(MESSAGES["invalid_crs"]), **asset,
    )
    if "inspections" in t:
        seen = t["inspections"].filter("readable").select("dataset_id", "source_asset_id", F.col("crs").alias("actual"))
        both = a.filter(~empty & valid).join(seen, ["dataset_id", "source_asset_id"]).filter(declared != normal_crs(F.col("actual")))
        context = F.to_json(F.struct(F.col("crs").alias("declared"), F.col("actual")))
        out = out.unionByName(finding(both, rule, "crs_metadata_mismatch", MESSAGES["crs_metadata_mismatch"], context=context, **asset))
    return out


def rule_window_bounds(t: Tables) -> DataFrame:
    tiles = t["tiles"].select(F.col("output_id").alias("tile_output_id"), "width", "height")
    rows = t["indexes"].join(tiles, "tile_output_id")
    over = (F.col("window_col_off") + F.col("window_width") > F.col("width")) | (F.col("window_row_off") + F.col("window_height") > F.col("height"))
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("window_col_off", "window_row_off", "window_width", "window_height", "width", "height")])
    return finding(
        rows.filter(known & over), "window_bounds", "window_out_of_bounds", MESSAGES["window_out_of_bounds"],
        index_id=F.col("output_id"), output_id=F.col("output_id"), field="window",
    )


def _band_contract(t: Tables, rule: str, expected: str, auxiliary: tuple) -> DataFrame:
    data_type = rule.split("_")[0]
    a = used_assets(t).filter(F.col("data_type") == data_type)
    b = t["bands"].select("dataset_id", "source_asset_id", "band_code", "band_type")
    rows = a.join(b, ["dataset_id", "source_asset_id"], "left")
    empty = _missing(F.col("band_code"))
    spare = (F.col("band_type") == "variable") & F.lower(F.trim("band_code")).isin(*auxiliary) if auxiliary else F.lit(False)
    wrong = ~F.col("band_type").eqNullSafe(F.lit(expected)) & ~F.coalesce(spare, F.lit(False))
    context = F.when(~empty, F.to_json(F.struct("band_code", F.col("band_type").alias("actual"), F.lit(expected).alias("expected"))))
    return finding(
        rows.filter(empty | wrong), rule, F.when(empty, "missing_band_metadata").otherwise("invalid_band_type"),
        F.when(empty, MESSAGES["missing_band_metadata"]).otherwise(MESSAGES["invalid_band_type"].format(expected=expected, data_type=data_type)),
        source_asset_id=F.col("source_asset_id"), band_code=F.col("band_code"),
        field=F.when(empty, "band_code").otherwise("band_type"), context=context,
    )


def rule_optical_band_contract(t: Tables) -> DataFrame:
    return _band_contract(t, "optical_band_contract", "spectral", AUXILIARY_BANDS)


def rule_radar_band_contract(t: Tables) -> DataFrame:
    return _band_contract(t, "radar_band_contract", "polarization", ())


# ---------------------------------------------------------------------------
# carbon rules (attributes as MAP<STRING, STRING>)

# Attribute names and the older names they go by.
ATTRIBUTE_ALIASES = {"lon": "center_lon", "lat": "center_lat", "footprint": "footprint_geojson"}


def alias_attributes(df: DataFrame, column: str = "attributes") -> DataFrame:
    """Give older attribute names their present name where that is absent."""
    m = F.coalesce(F.col(column), F.create_map().cast("map<string,string>"))
    names = F.array(*[F.lit(n) for n in ATTRIBUTE_ALIASES])
    olds = F.array(*[F.try_element_at(m, F.lit(o)) for o in ATTRIBUTE_ALIASES.values()])
    added = F.map_filter(F.map_from_arrays(names, olds), lambda k, v: v.isNotNull() & ~F.map_contains_key(m, k))
    return df.withColumn(column, F.map_concat(m, added))


def with_carbon_values(rows: DataFrame) -> DataFrame:
    """Add the attributes that carbon rules read; NULL where the row is of another kind."""
    rows = alias_attributes(rows)
    get = lambda k: F.when(F.col("data_type") == "carbon", F.try_element_at("attributes", F.lit(k)))
    return rows.withColumns({"a_lon": get("lon").try_cast("double"), "a_lat": get("lat").try_cast("double"), "a_xco2": get("xco2").try_cast("double"), "a_flag": get("quality_flag")})


def _carbon(t: Tables) -> DataFrame:
    return with_carbon_values(t["indexes"].filter(F.col("data_type") == "carbon"))


def _index() -> dict:
    return {"source_asset_id": F.col("source_asset_id"), "index_id": F.col("output_id")}


def _parsable() -> Column:
    return F.col("a_lon").isNotNull() & F.col("a_lat").isNotNull() & F.col("a_xco2").isNotNull()


def _carbon_fields_row() -> tuple:
    lacking = F.array_except(F.array(*[F.lit(f) for f in CARBON_FIELDS]), F.map_keys("attributes"))
    return F.size(lacking) > 0, "missing_carbon_fields", F.concat(F.lit(MESSAGES["missing_carbon_fields"]), F.concat_ws(", ", lacking)), _index()


def _coordinates_row() -> tuple:
    bad = _parsable() & ~(F.col("a_lon").between(-180, 180) & F.col("a_lat").between(-90, 90))
    return bad, "invalid_coordinates", MESSAGES["invalid_coordinates"], _index()


def _xco2_row(low: float = 0.0, high: float = 1000.0) -> tuple:
    bad = _parsable() & ~((F.col("a_xco2") > low) & (F.col("a_xco2") < high))
    return bad, "xco2_out_of_range", MESSAGES["xco2_out_of_range"], _index()


def _flag_row() -> tuple:
    return _parsable() & _missing(F.col("a_flag")), "missing_quality_flag", MESSAGES["missing_quality_flag"], _index()


#: Rules that look at one index row at a time: whether it is bad, error code, message and parts of the finding.
ROW_RULES: dict[str, Callable[[], tuple]] = {
    "time_bucket_consistency": _time_bucket_row, "carbon_schema": _carbon_fields_row, "carbon_coordinates": _coordinates_row,
    "carbon_xco2_range": _xco2_row, "carbon_quality_flags": _flag_row,
}


def _row_rule(rows: DataFrame, rule: str, row: tuple | None = None) -> DataFrame:
    bad, error, message, parts = row or ROW_RULES[rule]()
    return finding(rows.filter(bad), rule, error, message, **parts)


def row_findings(indexes: DataFrame, codes: list[str]) -> DataFrame:
    """Findings of several row rules in one pass over the index rows: an array for each row, then its entries."""
    carbon = [c for c in codes if c.startswith("carbon_")]
    if carbon and "attributes" not in indexes.columns:  # no table of this run has observations
        codes, carbon = [c for c in codes if c not in carbon], []
    rows = with_carbon_values(indexes) if carbon else indexes
    found = []
    for code in codes:
        bad, error, message, parts = ROW_RULES[code]()
        if code in carbon:
            bad = (F.col("data_type") == "carbon") & bad
        found.append(F.when(bad, F.struct(*_values(code, error, message, parts))))
    if not found:
        return finding(indexes.filter(F.lit(False)), "", "", "")
    return rows.select(*OUTPUT, F.explode(F.array_compact(F.array(*found))).alias("f")).select(*OUTPUT, *[f"f.{n}" for n in FINDING])


def carbon_outputs_without_rows(t: Tables) -> DataFrame:
    rows = t["indexes"].filter(F.col("data_type") == "carbon").select(*OUTPUT).distinct()
    empty = t["versions"].filter("data_type = 'carbon'").join(rows, list(OUTPUT), "left_anti")
    return finding(empty, "carbon_schema", "missing_carbon_indexes", MESSAGES["missing_carbon_indexes"])


def rule_carbon_schema(t: Tables) -> DataFrame:
    return _row_rule(_carbon(t), "carbon_schema").unionByName(carbon_outputs_without_rows(t))


def rule_carbon_coordinates(t: Tables) -> DataFrame:
    return _row_rule(_carbon(t), "carbon_coordinates")


def rule_carbon_xco2_range(t: Tables, low: float = 0.0, high: float = 1000.0) -> DataFrame:
    return _row_rule(_carbon(t), "carbon_xco2_range", _xco2_row(low, high))


def rule_carbon_quality_flags(t: Tables) -> DataFrame:
    return _row_rule(_carbon(t), "carbon_quality_flags")


# ---------------------------------------------------------------------------
# registry, snapshot and status

RASTER, ALL_TYPES = ("optical", "radar", "product"), ("optical", "radar", "product", "carbon")

# Rules in order: code, function, data types, mandatory.
RULES: list[tuple[str, Callable[[Tables], DataFrame], tuple, bool]] = [
    ("index_schema", rule_index_schema, ALL_TYPES, True),
    ("output_count_consistency", rule_output_count_consistency, ALL_TYPES, True),
    ("output_reference_integrity", rule_output_reference_integrity, ALL_TYPES, True),
    ("grid_method_agreement", rule_grid_method_agreement, ALL_TYPES, True),
    ("cell_bbox_validity", rule_cell_bbox_validity, ALL_TYPES, True),
    ("time_bucket_consistency", rule_time_bucket_consistency, ALL_TYPES, True),
    ("asset_readability", rule_asset_readability, ALL_TYPES, True),
    ("window_bounds", rule_window_bounds, ALL_TYPES, True),
    ("asset_crs", rule_asset_crs, RASTER, False),
    ("optical_band_contract", rule_optical_band_contract, ("optical",), False),
    ("radar_band_contract", rule_radar_band_contract, ("radar",), False),
    ("carbon_schema", rule_carbon_schema, ("carbon",), False),
    ("carbon_coordinates", rule_carbon_coordinates, ("carbon",), False),
    ("carbon_xco2_range", rule_carbon_xco2_range, ("carbon",), False),
    ("carbon_quality_flags", rule_carbon_quality_flags, ("carbon",), False),
]


#: Product types of rules that do not hold for every product of their data types.
PRODUCT_TYPES: dict[str, tuple] = {}


def register_rule(code: str, fn: Callable[[Tables], DataFrame], mandatory: bool, data_types: tuple = ALL_TYPES, product_types: tuple | None = None) -> None:
    """Add a rule: a function from tables to findings, for some product types only where they are given."""
    if any(r[0] == code for r in RULES):
        raise ValueError("quality rule codes must be unique")
    RULES.append((code, fn, tuple(data_types), mandatory))
    if product_types is not None:
        PRODUCT_TYPES[code] = tuple(product_types)


def rules_table(spark: SparkSession) -> DataFrame:
    """The registry as a table: order, code, data types, product types (null: all), mandatory."""
    rows = [(k, code, list(types), list(PRODUCT_TYPES[code]) if code in PRODUCT_TYPES else None, mandatory) for k, (code, _, types, mandatory) in enumerate(RULES)]
    return spark.createDataFrame(rows, "rule_order int, rule_code string, data_types array<string>, product_types array<string>, mandatory boolean")


def rule_snapshot(rules: DataFrame, datasets: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """Rules that apply to each dataset (data_type, product_type): mandatory ones always, optional ones when enabled (all by default).

    A code to enable that is no optional rule is refused; blank ones are passed over.
    """
    if enabled is not None:
        enabled = [c.strip() for c in enabled if c and c.strip()]
        optional = {r.rule_code for r in rules.filter(~F.col("mandatory")).select("rule_code").collect()}  # the registry is a short list
        if strange := sorted(set(enabled) - optional):
            raise ValueError(f"unknown or non-optional quality rule: {strange[0]}")
    wanted = F.col("mandatory")
    if enabled is None:
        wanted = F.lit(True)
    elif enabled:
        wanted = wanted | F.col("rule_code").isin(list(enabled))
    # One row per rule and type; the registry is a short list.
    by_type = rules.filter(wanted).select("rule_order", "rule_code", "mandatory", F.col("product_types").alias("__products"), F.explode("data_types").alias("data_type"))
    product = F.col("product_type") if "product_type" in datasets.columns else F.lit(None).cast("string")
    applies = F.col("__products").isNull() | F.coalesce(F.array_contains("__products", F.coalesce(product, F.lit(""))), F.lit(False))
    return datasets.join(F.broadcast(by_type), "data_type").filter(applies).drop("__products")


def count_findings(findings: DataFrame) -> DataFrame:
    """Number of findings (``n``) of every output version and rule."""
    return findings.groupBy(*OUTPUT, "rule_code").agg(F.count("*").alias("n"))


def rule_status(findings: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Status of every applied rule: a finding fails a mandatory rule and warns on an optional one."""
    return status_of_counts(count_findings(findings), snapshot)


def status_of_counts(counts: DataFrame, snapshot: DataFrame) -> DataFrame:
    """:func:`rule_status` from counts of findings; several counts of one rule are added up."""
    counts = counts.groupBy(*OUTPUT, "rule_code").agg(F.sum("n").alias("n"))
    out = snapshot.join(counts, [*OUTPUT, "rule_code"], "left").withColumn("finding_count", F.coalesce("n", F.lit(0))).drop("n")
    status = F.when(F.col("finding_count") == 0, "pass").when(F.col("mandatory"), "fail").otherwise("warn")
    return out.withColumn("status", status)


def run_status(results: DataFrame, keys: tuple = OUTPUT) -> DataFrame:
    """Worst status of a run: error, fail, warn, pass."""
    has = lambda s: F.bool_or(F.col("status") == s)
    status = F.when(has("error"), "error").when(has("fail"), "fail").when(has("warn"), "warn").otherwise("pass")
    return results.groupBy(*keys).agg(status.alias("status"))


def apply_if_newest(datasets: DataFrame, runs: DataFrame, key: str = "dataset_id", sequence: str = "sequence", status: str = "status") -> DataFrame:
    """Dataset status from the run with the highest sequence, unless the dataset already holds a newer one."""
    last = runs.groupBy(key).agg(F.max_by(status, sequence).alias("__status"), F.max(sequence).alias("__seq"))
    newer = F.col("__seq") >= F.coalesce(sequence, F.lit(-1))
    out = datasets.join(last, key, "left")
    return out.withColumns(
        {status: F.when(newer, F.col("__status")).otherwise(F.col(status)), sequence: F.when(newer, F.col("__seq")).otherwise(F.col(sequence))}
    ).drop("__status", "__seq")


def evaluate(t: Tables, codes: list[str] | None = None) -> DataFrame:
    """Findings of all rules, or of some, over every output version in the tables.

    Rules of single index rows share one scan of the index table; the others join or count and keep
    scans of their own.  Rules added with :func:`register_rule` run like the built-in ones.
    """
    return reduce(DataFrame.unionByName, evaluate_parts(t, codes))


def evaluate_parts(t: Tables, codes: list[str] | None = None) -> list[DataFrame]:
    """The findings of :func:`evaluate` as tables that can be run one after the other."""
    wanted = [(code, fn) for code, fn, _, _ in RULES if codes is None or code in codes]
    local = [code for code, _ in wanted if code in ROW_RULES]
    parts = [fn(t) for code, fn in wanted if code not in ROW_RULES]
    if local:
        parts.append(row_findings(t["indexes"], local))
    if "carbon_schema" in local:
        parts.append(carbon_outputs_without_rows(t))
    return parts


def staged_counts(t: Tables, codes: list[str] | None = None) -> DataFrame:
    """Finding counts of all rules, or of some: every rule runs as a small job of its own and leaves its counts in the stage folder.

    One plan of all rules would hold the tables some eighty times, and the driver would keep every
    version of it while it runs.
    """
    return stage([count_findings(p) for p in evaluate_parts(t, codes)], "rule-counts")


def assert_totals(totals: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Runs whose recorded finding total is not the sum of their rule results."""
    have = results.groupBy(*keys).agg(F.sum("finding_count").alias("summed"))
    return totals.join(have, keys, "left").filter(~F.col("total").eqNullSafe(F.coalesce("summed", F.lit(0))))


# ---------------------------------------------------------------------------
# file checks: one row per check with status and count; offending rows come from the same conditions

# Fields of an index row and of an observation row.
INDEX_FIELDS = (
    "scene_id", "band", "asset_path", "acq_time", "grid_type", "grid_level", "space_code", "st_code", "time_bucket",
    "cell_min_lon", "cell_min_lat", "cell_max_lon", "cell_max_lat",
    "window_col_off", "window_row_off", "window_width", "window_height",
)
OBSERVATION_FIELDS = (
    "satellite", "product_type", "observation_id", "acq_time", "time_bucket", "grid_type", "grid_level", "space_code",
    "st_code", "xco2", "center_lon", "center_lat", "footprint_geojson", "source_uri",
)
XCO2_FILE_RANGE = (250.0, 650.0)
SAMPLE_ROWS = 20


def check_row(df: DataFrame, name: str, bad: Column, level: str = "FAIL") -> DataFrame:
    """``check, status, rows, bad_rows`` of one condition."""
    counts = df.agg(F.count("*").alias("rows"), F.count_if(bad).alias("bad_rows"))
    return counts.select(
        F.lit(name).alias("check"), F.when(F.col("bad_rows") > 0, level).otherwise("PASS").alias("status"), "rows", "bad_rows"
    )


def sample_rows(df: DataFrame, bad: Column, n: int = SAMPLE_ROWS, order: str | None = None) -> DataFrame:
    """The first offending rows, as many as a report shows."""
    rows = df.filter(bad)
    return (rows.orderBy(order) if order else rows).limit(n)


def check_rows(df: DataFrame) -> DataFrame:
    """There are rows."""
    counts = df.agg(F.count("*").alias("rows"))
    none = F.col("rows") == 0
    return counts.select(
        F.lit("rows").alias("check"), F.when(none, "FAIL").otherwise("PASS").alias("status"), "rows", none.cast("bigint").alias("bad_rows")
    )


def check_schema(df: DataFrame, required: tuple = INDEX_FIELDS, raw: str | None = None) -> DataFrame:
    """Required fields of every row.

    With ``raw`` (a ``MAP<STRING, STRING>`` of the row as read) a key must be
    present, and a present NULL is accepted; without it the columns must exist.
    """
    if raw is None:
        gone = [f for f in required if f not in df.columns]
        return check_row(df, "schema", F.lit(bool(gone)))
    lacking = F.array_except(F.array(*[F.lit(f) for f in required]), F.map_keys(raw))
    return check_row(df, "schema", F.coalesce(F.size(lacking) > 0, F.lit(True)))


def bad_time_bucket(acq: str = "acq_time", bucket: str = "time_bucket") -> Column:
    day = F.date_format(F.col(acq).try_cast("timestamp"), "yyyyMMdd")
    return ~F.coalesce(day == F.col(bucket), F.lit(False))


def check_time_bucket(df: DataFrame) -> DataFrame:
    """The bucket is the UTC day of the acquisition time."""
    return check_row(df, "time_bucket", bad_time_bucket())


def cell_bbox_reason() -> Column:
    """Why a cell box is bad: not numbers, out of range, or inverted; NULL for a good one."""
    w, s, e, n = (F.col(f"cell_{c}").try_cast("double") for c in ("min_lon", "min_lat", "max_lon", "max_lat"))
    numbers = w.isNotNull() & s.isNotNull() & e.isNotNull() & n.isNotNull()
    inside = w.between(-180, 180) & e.between(-180, 180) & s.between(-90, 90) & n.between(-90, 90)
    return F.when(~numbers, "non_numeric").when(~inside, "out_of_range").when((w >= e) | (s >= n), "inverted")


def check_cell_bbox(df: DataFrame) -> DataFrame:
    return check_row(df, "cell_bbox", cell_bbox_reason().isNotNull())


def logical_duplicates(df: DataFrame, kind: str = "tile_kind") -> DataFrame:
    """Scene and band pairs with more than one asset, entity rows left out."""
    rows = df.filter(F.col(kind) != "entity_file") if kind in df.columns else df
    pairs = rows.select("scene_id", "band", "asset_path").distinct()
    return pairs.groupBy("scene_id", "band").agg(F.count("*").alias("assets")).filter("assets > 1")


def check_logical_duplicates(df: DataFrame) -> DataFrame:
    return check_row(logical_duplicates(df), "logical_duplicates", F.lit(True), "WARN")


def check_assets(df: DataFrame, assets: DataFrame, target_crs: str = "EPSG:4326") -> DataFrame:
    """Windows inside the inspected asset, its CRS, and all-zero samples (``asset_path, width, height, crs, valid, nonzero``)."""
    joined = df.join(assets, "asset_path", "left")
    over = (F.col("window_col_off") + F.col("window_width") > F.col("width")) | (F.col("window_row_off") + F.col("window_height") > F.col("height"))
    used = assets.join(df.select("asset_path").distinct(), "asset_path", "left_semi")
    entity = F.col("tile_kind") == "entity_file" if "tile_kind" in df.columns else F.lit(False)
    bad = {"asset_present": F.col("width").isNull(), "window_bounds": over, "asset_crs": ~entity & (F.col("crs") != target_crs)}
    # One pass over the join counts all three.
    counts = joined.agg(F.count("*").alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in bad.items()])
    lines = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("bad_rows")) for n in bad]))
    rows = counts.select("rows", lines.alias("c")).select("c.check", F.when(F.col("c.bad_rows") > 0, "FAIL").otherwise("PASS").alias("status"), "rows", "c.bad_rows")
    return rows.unionByName(check_row(used, "all_zero", (F.col("valid") > 0) & (F.col("nonzero") == 0), "WARN"))


def bad_coordinates(lon: str = "center_lon", lat: str = "center_lat") -> Column:
    x, y = F.col(lon).try_cast("double"), F.col(lat).try_cast("double")
    return ~F.coalesce(x.between(-180, 180) & y.between(-90, 90), F.lit(False))


def check_coordinates(df: DataFrame, lon: str = "center_lon", lat: str = "center_lat") -> DataFrame:
    return check_row(df, "coordinates", bad_coordinates(lon, lat))


def bad_xco2(low: float = XCO2_FILE_RANGE[0], high: float = XCO2_FILE_RANGE[1]) -> Column:
    return ~F.coalesce(F.col("xco2").try_cast("double").between(low, high), F.lit(False))


def check_xco2(df: DataFrame, low: float = XCO2_FILE_RANGE[0], high: float = XCO2_FILE_RANGE[1]) -> DataFrame:
    """Values are numbers in range; with least, greatest and mean value."""
    x = F.col("xco2").try_cast("double")
    stats = df.agg(
        F.count("*").alias("rows"), F.count_if(bad_xco2(low, high)).alias("bad_rows"),
        F.min(x).alias("xco2_min"), F.max(x).alias("xco2_max"), F.round(F.avg(x), 6).alias("xco2_avg"),
    )
    return stats.select(F.lit("xco2_range").alias("check"), F.when(F.col("bad_rows") > 0, "FAIL").otherwise("PASS").alias("status"), "*")


def check_flags(df: DataFrame) -> DataFrame:
    """Flags with their counts; any but empty, 0 and 1 is a warning."""
    flag = F.coalesce(F.col("quality_flag").cast("string"), F.lit(""))
    return df.groupBy(flag.alias("quality_flag")).agg(F.count("*").alias("n")).withColumn(
        "status", F.when(F.col("quality_flag").isin("", "0", "1"), "PASS").otherwise("WARN")
    )


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def check_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return check_row(duplicates(df, keys), "duplicates", F.lit(True), "WARN")


def bad_footprint(column: str = "footprint_geojson") -> Column:
    kind = F.get_json_object(column, "$.type")
    return F.col(column).isNotNull() & ~F.coalesce(kind.isin("Point", "Polygon", "MultiPolygon"), F.lit(False))


def check_footprints(df: DataFrame, column: str = "footprint_geojson") -> DataFrame:
    return check_row(df, "footprints", bad_footprint(column), "WARN")


def check_years(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Product year against bucket, and expected years without rows (``expected`` has a column ``year``)."""
    year = F.year("acq_time").cast("string")
    out = check_row(df, "year_bucket", ~F.coalesce(year == F.col("time_bucket"), F.lit(False)))
    gone = expected.select("year").distinct().join(df.select(F.year("acq_time").alias("year")).distinct(), "year", "left_anti")
    return out.unionByName(check_row(gone, "missing_years", F.lit(True), "WARN"))


def summarize_checks(checks: DataFrame) -> DataFrame:
    """Numbers of passed, warned and failed checks, and the overall status."""
    n = lambda s: F.count_if(F.col("status") == s)
    overall = F.when(n("FAIL") > 0, "FAIL").when(n("WARN") > 0, "WARN").otherwise("PASS")
    return checks.agg(n("PASS").alias("passed"), n("WARN").alias("warned"), n("FAIL").alias("failed"), overall.alias("status"))


def quality_report(df: DataFrame, kind: str, assets: DataFrame | None = None, required: tuple | None = None) -> DataFrame:
    """All checks of an index or observation table; radar is checked like optical.

    Conditions of single rows are counted in one pass.  Where a required column
    is missing only ``rows`` and ``schema`` are reported.
    """
    carbon = kind == "carbon"
    required = required or (OBSERVATION_FIELDS if carbon else INDEX_FIELDS)
    gone = any(f not in df.columns for f in required)
    checks = [("rows", F.lit(False), "FAIL"), ("schema", F.lit(gone), "FAIL")]
    if carbon and not gone:
        flag = F.coalesce(F.col("quality_flag").cast("string"), F.lit(""))
        checks += [
            ("time_bucket", bad_time_bucket(), "FAIL"), ("coordinates", bad_coordinates(), "FAIL"), ("xco2_range", bad_xco2(), "FAIL"),
            ("flags", ~flag.isin("", "0", "1"), "WARN"), ("footprints", bad_footprint(), "WARN"),
        ]
    elif not gone:
        checks += [("time_bucket", bad_time_bucket(), "FAIL"), ("cell_bbox", cell_bbox_reason().isNotNull(), "FAIL")]
    bad = [F.count_if(c) if n != "rows" else (F.count("*") == 0).cast("bigint") for n, c, _ in checks]
    counts = df.agg(F.count("*").alias("rows"), *[b.alias(n + "_bad") for b, (n, _, _) in zip(bad, checks)])
    lines = F.array(*[F.struct(F.lit(n).alias("check"), F.lit(level).alias("level"), F.col(n + "_bad").alias("bad_rows")) for n, _, level in checks])
    rows = counts.select("rows", F.explode(lines).alias("c")).select(
        "c.check", F.when(F.col("c.bad_rows") > 0, F.col("c.level")).otherwise("PASS").alias("status"), "rows", "c.bad_rows"
    )
    parts = [rows]
    if carbon and not gone:
        parts.append(check_duplicates(df.filter(F.coalesce(F.col("observation_id").cast("string"), F.lit("")) != ""), ["observation_id"]))
    elif not gone:
        parts.append(check_logical_duplicates(df))
        if assets is not None:
            parts.append(check_assets(df, assets))
    return reduce(DataFrame.unionByName, parts).withColumn("kind", F.lit(kind))
