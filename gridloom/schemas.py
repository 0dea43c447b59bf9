"""Declared schemas of the inputs."""

from __future__ import annotations

# A manifest row: one asset with its bands.
MANIFEST = (
    "data_type string, scene_id string, band string, bands array<string>, variable string, polarization string, acq_time string, "
    "source_uri string, sensor string, product_family string, product_type string, resolution string, corners array<array<double>>"
)
# A manifest object that wraps its rows.
MANIFEST_OBJECT = f"assets array<struct<{MANIFEST.replace(' string', ':string').replace(' array<', ':array<')}>>"

# An observation row as delivered; texts are parsed afterwards.
OBSERVATION = (
    "satellite string, observation_id string, sounding_id string, acq_time string, lon string, lat string, xco2 string, "
    "quality_flag string, footprint string, source_uri string, source_index string, metadata string"
)

# A load document: batch, datasets, scenes, assets, bands.
LOAD = (
    "load_batch_id string, batch_name string, datasets array<struct<dataset_code:string, dataset_title:string, data_type:string, "
    "scenes:array<struct<scene_key:string, acquisition_time:string, assets:array<struct<source_uri:string, checksum:string, "
    "bands:array<struct<band_code:string, band_name:string, band_type:string, source_band_index:int>>>>>>>>"
)

# An index row of a partition file.
INDEX_ROW = (
    "scene_id string, band string, asset_path string, acq_time string, grid_type string, grid_level int, space_code string, "
    "topology_code string, space_code_prefix string, st_code string, time_bucket string, cover_mode string, cell_min_lon double, "
    "cell_min_lat double, cell_max_lon double, cell_max_lat double, window_col_off bigint, window_row_off bigint, window_width bigint, "
    "window_height bigint, sample_mean_band1 double"
)
