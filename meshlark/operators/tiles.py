"""Pixels of map tiles and of latitude-longitude boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import mercator_lat, tile_bounds


def _grid(requests: DataFrame) -> DataFrame:
    """requests with w and h defaulted to 256, a row for each pixel (px, py)."""
    sized = requests.withColumn("w", F.expr("CASE WHEN w IS NULL OR w <= 0 THEN 256 ELSE w END")).withColumn("h", F.expr("CASE WHEN h IS NULL OR h <= 0 THEN 256 ELSE h END"))
    rows = sized.withColumn("py", F.explode(F.expr("sequence(0, h - 1)")))
    return rows.withColumn("px", F.explode(F.expr("sequence(0, w - 1)")))


def tile_pixels(tiles: DataFrame) -> DataFrame:
    """tiles (z, x, y, w, h, ...) with px, py, lat, lon of each pixel's centre; latitudes are exact for each row."""
    _, west, _, east = tile_bounds("z", "x", "y")
    return _grid(tiles).withColumn("lat", F.expr(mercator_lat("(y + (py + 5e-1) / h) / pow(2e0, z)"))).withColumn("lon", F.expr(f"{west} + ({east} - {west}) * (px + 5e-1) / w"))


def tile_pixel_linear(tiles: DataFrame) -> DataFrame:
    """As tile_pixels, but with latitudes linear between the tile's edges."""
    south, west, north, east = tile_bounds("z", "x", "y")
    return _grid(tiles).withColumn("lat", F.expr(f"{north} + ({south} - {north}) * (py + 5e-1) / h")).withColumn("lon", F.expr(f"{west} + ({east} - {west}) * (px + 5e-1) / w"))


def region_pixels(regions: DataFrame) -> DataFrame:
    """regions (south, west, north, east, w, h, ...) with px, py, lat, lon; an east not beyond the west is a turn further."""
    span = "(CASE WHEN east - west <= 0 THEN east - west + 360 ELSE east - west END)"
    return _grid(regions).withColumn("lat", F.expr("north + (south - north) * (py + 5e-1) / h")).withColumn("lon", F.expr(f"west + {span} * (px + 5e-1) / w"))


def statistics(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, least, greatest, mean) of the values that aren't missing; the mean of values to 9 decimals, so that it doesn't depend on the order of rows."""
    exact = F.sum(F.col("value").cast("decimal(28,9)"))
    return samples.groupBy(*keys).agg(F.count("value").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"), (exact.cast("double") / F.count("value")).alias("mean"))
