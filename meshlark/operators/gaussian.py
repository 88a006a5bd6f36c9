"""Gaussian grids: latitudes, rows of differing width and the place of points in them."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import half_up, wrap360


@lru_cache(16)
def latitudes(n: int) -> tuple[float, ...]:
    """The 2n latitudes of a Gaussian grid from north to south: the roots of the Legendre polynomial of degree 2n."""
    if n <= 0:
        return ()
    roots, _ = np.polynomial.legendre.leggauss(2 * n)
    return tuple(np.degrees(np.arcsin(roots[::-1])).tolist())


def regional(n: int, rows: int, north: float) -> tuple[float, ...]:
    """The latitudes of a grid of fewer rows, whose first row is the one nearest to `north`."""
    every = latitudes(n)
    start = min(range(len(every)), key=lambda k: abs(every[k] - north))
    start = min(start, max(len(every) - rows, 0))
    return every[start : start + rows]


def layout(width: np.ndarray, west: float, east: float, di: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first longitude, step, last longitude) of rows of these widths between west and east; a step of 0 is a single column, a last longitude without bound a row around the globe.

    A step that is given counts; without one the grid goes around the globe if
    its widest row does. Fixed tolerance: a tenth of a step.
    """
    width = np.asarray(width, float)
    wide, span = np.maximum(width, 1), east - west
    if di and di > 0:
        step = np.full(width.shape, float(di))
        around = np.abs(step * width - 360) < np.maximum(1e-6, 0.1 * step)
    else:
        nominal = 360 / max(float(width.max(initial=0)), 1)
        around = np.full(width.shape, width.max(initial=0) > 1 and abs(span + nominal - 360) < max(1e-6, 0.1 * nominal)) & (width > 1)
        step = np.where(around, 360 / wide, span / np.maximum(width - 1, 1))
    single = width <= 1
    step = np.where(single, 0.0, step)
    return np.full(width.shape, float(west)), step, np.where(single, west, np.where(around, np.inf, east))


def row_offsets(rows: DataFrame, grid: list[str]) -> DataFrame:
    """rows (grid, j, width) with `first`, the place in storage of each row's first value."""
    run = Window.partitionBy(*grid).orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("first", (F.sum("width").over(run) - F.col("width")).cast("long"))


def locate(points: DataFrame, rows: DataFrame, id_col: str, west: float = 0.0) -> DataFrame:
    """(id, fi, fj, off) of points (id, lat, lon) on a grid of rows (j, width, first, lat); null outside.

    Rows go around the globe from `west`, unless rows has the columns west, step
    and east (see layout). Points meet the row north of them by an equi-join of
    latitude buckets, a quarter of a row's height each on average, so that a
    point meets one or two rows.
    """
    run = Window.orderBy("j")  # the rows of one grid
    known = rows if "step" in rows.columns else rows.withColumns({"west": F.lit(float(west)), "step": F.lit(360.0) / F.col("width"), "east": F.lit(float("inf"))})
    spans = known.select("j", F.col("lat").alias("above"), F.lead("lat").over(run).alias("below"), F.lead("j", 2).over(run).isNull().alias("last")).where("below IS NOT NULL")
    height = rows.agg(F.count("*").alias("n"), (F.max("lat") - F.min("lat")).alias("span")).first()
    size = max(float(height.span or 0) / (4 * max(height.n - 1, 1)), 1e-9)
    bucket = lambda lat: f"CAST(floor(({lat}) / {size!r}e0) AS BIGINT)"
    spread = spans.withColumn("bucket", F.explode(F.expr(f"sequence({bucket('below - 1e-9')}, {bucket('above + 1e-9')})")))
    p = points.select(id_col, F.col("lat").alias("p_lat"), "lon", F.expr(bucket("lat")).alias("bucket"))
    inside = F.expr("p_lat <= above + CASE WHEN j = 0 THEN 1e-9 ELSE 0e0 END AND (p_lat > below OR last AND p_lat >= below - 1e-9)")
    placed = p.join(spread, "bucket").where(inside).select(id_col, "lon", F.expr("greatest(least(j + (above - p_lat) / (above - below), j + 1e0), j * 1e0)").alias("fj"))
    named = known.select(F.col("j").alias("r_j"), "width", "first", "west", "step", "east")
    rowed = placed.join(named, F.expr(f"CAST({half_up('fj')} AS INT)") == F.col("r_j"))
    x = wrap360("lon", "west")
    fi = f"CASE WHEN step = 0 THEN (CASE WHEN abs({x} - west) <= 1e-9 THEN 0e0 END) WHEN east = double('Infinity') OR {x} <= east + 1e-9 THEN ({x} - west) / step END"
    found = rowed.withColumn("fi", F.expr(fi)).where("fi IS NOT NULL").select(F.col(id_col).alias("f_id"), "fi", "fj", F.expr(f"CAST(first + CAST({half_up('fi')} AS INT) % width AS BIGINT)").alias("off"))
    return points.select(id_col).join(found, F.col(id_col) == F.col("f_id"), "left").drop("f_id")
