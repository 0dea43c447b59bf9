"""Deterministic ids: hashes over named identity fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separator between the parts of a hashed key; it cannot occur in the parts.
NUL = "\x00"


def _col(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def joined_hash(*parts) -> Column:
    """sha256 over the parts as text, separated by a NUL character; a NULL part counts as empty."""
    texts = [F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws(NUL, *texts), 256)


def output_version(dataset, task) -> Column:
    """First 32 hex digits of sha256(dataset NUL task)."""
    return F.substring(joined_hash(dataset, task), 1, 32)


# The fields of an output's identity, in the order in which they are hashed.
OUTPUT_FIELDS = (
    "dataset_id", "output_version", "source_asset_id", "band_code", "grid_type",
    "grid_level", "space_code", "topology_code", "time_bucket", "window_identity",
)


def identity_json(fields: dict) -> Column:
    """Compact JSON of the fields in the given order and in their own types; NULLs are written."""
    return F.to_json(F.struct(*[_col(v).alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def identity_hash(fields: dict) -> Column:
    return F.sha2(identity_json(fields), 256)


def output_id(**fields) -> Column:
    """Hash of an output's identity: ``OUTPUT_FIELDS`` as columns, each by its own name unless given.

    The level is a number, all others are text; only ``topology_code`` may be NULL.
    """
    unknown = set(fields) - set(OUTPUT_FIELDS)
    if unknown:
        raise ValueError(f"not part of an output's identity: {sorted(unknown)}")
    typed = {k: _col(fields.get(k, k)).cast("int" if k == "grid_level" else "string") for k in OUTPUT_FIELDS}
    return identity_hash(typed)


def with_output_ids(df: DataFrame, dataset: str = "dataset_id", task: str = "task_id", **fields) -> DataFrame:
    """Add ``output_version`` and ``output_id``."""
    df = df.withColumn("output_version", output_version(dataset, task))
    return df.withColumn("output_id", output_id(dataset_id=dataset, **fields))


def scene_identity(namespace, key) -> Column:
    return joined_hash(namespace, key)


def band_unit_id(*parts) -> Column:
    """``band-`` and 32 hex digits."""
    return F.concat(F.lit("band-"), F.substring(joined_hash(*parts), 1, 32))


def asset_id(uri) -> Column:
    return F.concat(F.lit("asset-"), F.substring(joined_hash(uri), 1, 32))


def with_identity(df: DataFrame, namespace: str, scene_key: str, uri: str, band: str) -> DataFrame:
    """Add scene, asset and band-unit identities."""
    df = df.withColumns({"scene_identity": scene_identity(namespace, scene_key), "asset_identity": asset_id(uri)})
    return df.withColumn("band_unit_id", band_unit_id("scene_identity", "asset_identity", band))


def idempotency_key(scalars: list, lists: list = ()) -> Column:
    """Key of a request: its scalar parts, then each list sorted and without repeats."""
    texts = [F.coalesce(_col(s).cast("string"), F.lit("")) for s in scalars]
    for v in lists:
        texts.append(F.concat_ws(",", F.array_sort(F.array_distinct(_col(v)))))
    return F.sha2(F.concat_ws(NUL, *texts), 256)
