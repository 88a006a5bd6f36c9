"""Operators on decoded fields (rows with arrays of values)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import headers as h
from . import meshes


def catalogued(messages: DataFrame) -> DataFrame:
    """messages with valid_time, level1, level2 and parameter_key; the end of an interval is its valid time."""
    valid = F.expr(f"coalesce(interval_end, {h.valid_time('reference_time', 'time_unit', 'forecast_time')})")
    key = F.struct("centre", "subcentre", "master_table", "local_table", "discipline", "category", "number", "product_template")
    limits = {f"{k}_limit": F.expr(h.limit(f"{k}_scale", f"{k}_value")) for k in ("lower", "upper")}
    return messages.withColumns({"valid_time": valid, "level1": F.expr(h.level("scale1", "value1")), "level2": F.expr(h.level("scale2", "value2")), "parameter_key": key} | limits)


def mesh_of(fields: DataFrame) -> DataFrame:
    """(uuid, cell, lat, lon) from fields of unstructured grids that hold the coordinates of their cells, in degrees or radians.

    Which field is which is decided by its parameter code, else by its range.
    """
    held = fields.where("grid_template = 101").select("uuid", "discipline", "category", "number", "values", F.struct("file", "file_offset", "field_no").alias("no"))
    ranged = held.withColumn("most", F.expr("aggregate(values, 0D, (m, v) -> CASE WHEN isnan(v) THEN m ELSE greatest(m, abs(v)) END)"))
    pairs = meshes.paired(ranged.drop("values"))
    named = lambda role: ranged.select(F.col("uuid").alias(f"{role}_uuid"), F.col("no").alias(f"{role}_at"), F.col("values").alias(f"{role}s"))
    both = pairs.join(named("lat"), (F.col("uuid") == F.col("lat_uuid")) & (F.col("lat_no") == F.col("lat_at"))).join(named("lon"), (F.col("uuid") == F.col("lon_uuid")) & (F.col("lon_no") == F.col("lon_at")))
    each = both.select("uuid", "lat_radians", "lon_radians", F.posexplode(F.arrays_zip("lats", "lons")).alias("cell", "at"))
    degrees = lambda role: F.when(F.col(f"{role}_radians"), F.degrees(f"at.{role}s")).otherwise(F.col(f"at.{role}s")).alias(role)
    return each.select("uuid", F.col("cell").cast("long").alias("cell"), degrees("lat"), degrees("lon"))


def mesh_cells(fields: DataFrame) -> DataFrame:
    """(file, file_offset, field_no, uuid, cell, value) of fields on unstructured grids; null where missing."""
    each = fields.where("grid_template = 101").select("file", "file_offset", "field_no", "uuid", F.posexplode("values").alias("cell", "raw"))
    return each.select("file", "file_offset", "field_no", "uuid", F.col("cell").cast("long").alias("cell"), F.when(~F.isnan("raw"), F.col("raw")).alias("value"))


def with_tiles(tile_cells: DataFrame, cells: DataFrame) -> DataFrame:
    """A stored map from pixels to cells (uuid, pixel, cell) joined to the values of every field on the mesh: each field costs one join."""
    named = cells.withColumnRenamed("uuid", "c_uuid").withColumnRenamed("cell", "c_cell")
    return tile_cells.join(named, (F.col("uuid") == F.col("c_uuid")) & (F.col("cell") == F.col("c_cell")), "left").drop("c_uuid", "c_cell")
