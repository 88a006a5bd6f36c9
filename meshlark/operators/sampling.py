"""Resampling of gridded fields as joins and aggregates.

cells: key columns, i, j, value (null: missing), one row for each cell.
points: an id column, key columns, fx, fy (null: outside the grid).
Fields and points meet by equi-joins on (keys, i, j); whether a side is
broadcast is left to the planner, which knows the sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import cubic_weight, half_up


def _gathered(taps: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """taps with the value of the cell (keys, ti, tj), null where there is none."""
    named = cells.select(*(F.col(k).alias(f"c_{k}") for k in keys), F.col("i").alias("c_i"), F.col("j").alias("c_j"), "value")
    match = (F.col("ti") == F.col("c_i")) & (F.col("tj") == F.col("c_j"))
    for k in keys:
        match = match & (F.col(k) == F.col(f"c_{k}"))
    return taps.join(named, match, "left").drop("c_i", "c_j", *(f"c_{k}" for k in keys))


def nearest(points: DataFrame, cells: DataFrame, keys: list[str] = ()) -> DataFrame:
    """points with the value of the nearest cell; halves go away from zero."""
    keys = list(keys)
    taps = points.withColumn("ti", F.expr(f"CAST({half_up('fx')} AS INT)")).withColumn("tj", F.expr(f"CAST({half_up('fy')} AS INT)"))
    return _gathered(taps, cells, keys).drop("ti", "tj")


def bicubic_sql(values: list[str], near: str, dx: str = "dx", dy: str = "dy") -> str:
    """The Catmull-Rom value from 16 taps, row by row, in a fixed order of terms; the nearest value if a tap is missing."""
    wx = [cubic_weight(t) for t in (f"1 + {dx}", dx, f"1 - {dx}", f"2 - {dx}")]
    wy = [cubic_weight(t) for t in (f"1 + {dy}", dy, f"1 - {dy}", f"2 - {dy}")]
    weights = [f"({x} * {y})" for y in wy for x in wx]
    total = " + ".join(weights)
    summed = " + ".join(f"{v} * {w}" for v, w in zip(values, weights, strict=True))
    return f"(CASE WHEN {' OR '.join(f'{v} IS NULL' for v in values)} OR ({total}) = 0 THEN {near} ELSE ({summed}) / ({total}) END)"


#: Cells a side of the blocks that bicubic joins; with the taps of their border points SIDE a side.
BLOCK = 8
SIDE = BLOCK + 3


def _blocks(cells: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bu, bv, around): the values of the asked blocks (keys, bu, bv) and of their border as SIDE x SIDE places, row by row."""
    # a cell stands in its own block and in the border of the ones beside it
    both = lambda c: f"explode(array_distinct(array(CAST(floor(({c} - 2) / {BLOCK}) AS INT), CAST(floor(({c} + 1) / {BLOCK}) AS INT))))"
    held = cells.where("value IS NOT NULL AND i IS NOT NULL AND j IS NOT NULL").select(*keys, "i", "j", "value")
    dealt = held.withColumn("bu", F.expr(both("i"))).withColumn("bv", F.expr(both("j"))).join(asked.distinct(), [*keys, "bu", "bv"], "left_semi")
    entry = F.struct(F.expr(f"CAST((j - {BLOCK} * bv + 1) * {SIDE} + i - {BLOCK} * bu + 1 AS INT)").alias("place"), "value")
    listed = dealt.groupBy(*keys, "bu", "bv").agg(F.collect_list(entry).alias("held"))
    return listed.select(*keys, "bu", "bv", F.expr(f"transform(sequence(0, {SIDE * SIDE - 1}), k -> array_max(transform(filter(held, h -> h.place = k), h -> h.value)))").alias("around"))


def bicubic(points: DataFrame, cells: DataFrame, id_col: str, keys: list[str] = ()) -> DataFrame:
    """(keys, id, value): 4 by 4 Catmull-Rom resampling. A point moves once, to the block of cells that holds its taps."""
    keys = list(keys)
    placed = points.select(*keys, id_col, "fx", "fy", *(F.expr(f"CAST(floor(CAST(floor({c}) AS INT) / {BLOCK}) AS INT)").alias(n) for n, c in (("bu", "fx"), ("bv", "fy"))))
    met = placed.join(_blocks(cells, placed.select(*keys, "bu", "bv"), keys), [*keys, "bu", "bv"], "left")
    place = lambda x, y: f"({y} - {BLOCK} * bv + 1) * {SIDE} + {x} - {BLOCK} * bu + 1"
    tap = lambda k: place(f"CAST(floor(fx) AS INT) - 1 + {k % 4}", f"CAST(floor(fy) AS INT) - 1 + {k // 4}")
    near = place(f"CAST({half_up('fx')} AS INT)", f"CAST({half_up('fy')} AS INT)")
    taps = met.select(*keys, id_col, F.expr("fx - floor(fx)").alias("dx"), F.expr("fy - floor(fy)").alias("dy"), F.expr(f"get(around, {near})").alias("near"), *(F.expr(f"get(around, {tap(k)})").alias(f"v{k}") for k in range(16)))
    return taps.select(*keys, id_col, F.expr(bicubic_sql([f"v{k}" for k in range(16)], "near")).alias("value"))


def mode(points: DataFrame, cells: DataFrame, id_col: str, keys: list[str] = (), half: int = 1) -> DataFrame:
    """(keys, id, value): the most frequent value within `half` cells (at least 1) of the nearest; of equally frequent ones the least; null outside the grid."""
    keys, half = list(keys), max(half, 1)
    width = 2 * half + 1
    taps = (
        points.select(*keys, id_col, F.expr(f"CAST({half_up('fx')} AS INT)").alias("ci"), F.expr(f"CAST({half_up('fy')} AS INT)").alias("cj"), F.explode(F.expr(f"sequence(0, {width * width - 1})")).alias("tap"))
        .withColumn("ti", F.expr(f"ci - {half} + tap % {width}"))
        .withColumn("tj", F.expr(f"cj - {half} + CAST(floor(tap / {width}) AS INT)"))
    )
    counted = _gathered(taps, cells, keys).groupBy(*keys, id_col, "value").agg(F.count("*").alias("n"))
    best = F.max_by("value", F.when(F.col("value").isNotNull(), F.struct("n", -F.col("value"))))
    return counted.groupBy(*keys, id_col).agg(best.alias("value"))


def resample(points: DataFrame, cells: DataFrame, id_col: str, how: str = "nearest", keys: list[str] = (), half: int = 1) -> DataFrame:
    """(keys, id, value) by nearest, bicubic or mode; other names mean nearest."""
    if how == "bicubic":
        return bicubic(points, cells, id_col, keys)
    if how == "mode":
        return mode(points, cells, id_col, keys, half)
    return nearest(points, cells, keys).select(*keys, id_col, "value")
