"""Registered queries that write messages from the driver's tables and read them again, and their SQL.

Fields are runs of events: a run of `size` events is a field, the event's place
in it the cell, its value in eighths (so that 16 bits hold it exactly) the
value. The SQL never sees a message: it says what must come back.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dense, fields
from ..operators.tables import spread
from ..sources import encoder, grib

Query = Callable[[SparkSession, str], DataFrame]
NI, NJ = 30, 20


def _values(size: int) -> str:
    """(f, off, value) of every cell of every field, in natural order; null where there is no event or its number ends so."""
    cell = f"SELECT CAST(floor(event_id / {size}) AS BIGINT) AS f, CAST(event_id % {size} AS INT) AS off, CASE WHEN event_id % 97 = 13 THEN NULL ELSE CAST(floor(value * 8) AS BIGINT) % 32000 / 8e0 END AS value FROM events"
    return cell


def _fields(sql: Callable[[str], DataFrame], size: int) -> DataFrame:
    """(f, values): a row for each field."""
    held = sql(_values(size)).where("value IS NOT NULL").groupBy("f").agg(F.map_from_entries(F.collect_list(F.struct("off", "value"))).alias("m"))  # a field's cells, at most `size`
    every = sql(_values(size)).select("f").distinct()
    whole = every.join(held, "f", "left")
    return whole.select("f", F.expr(f"transform(sequence(0, {size} - 1), k -> try_element_at(m, k))").alias("values"))


def _whole(size: int) -> str:
    """DuckDB: (f, off, value) with a row for each cell, whether it has an event or not."""
    return f"SELECT n.f, CAST(c.off AS INT) AS off, v.value FROM (SELECT DISTINCT f FROM ({_values(size)}) a) n CROSS JOIN range({size}) AS c(off) LEFT JOIN ({_values(size)}) v ON v.f = n.f AND v.off = c.off"


def _grid(rows: DataFrame, **columns: object) -> DataFrame:
    return rows.withColumns({k: F.expr(v) if isinstance(v, str) else F.lit(v) for k, v in columns.items()})


def _latlon(rows: DataFrame) -> DataFrame:
    """On a grid of 30 x 20 points from 60 north, 5 east, in all 16 storage orders by turns."""
    return _grid(rows, grid_template=0, ni=NI, nj=NJ, scan="CAST(f % 16 AS INT) * 16", la1="CASE WHEN (f % 16) & 4 <> 0 THEN 581e-1 ELSE 60e0 END", la2="CASE WHEN (f % 16) & 4 <> 0 THEN 60e0 ELSE 581e-1 END", lo1="CASE WHEN (f % 16) & 8 <> 0 THEN 79e-1 ELSE 5e0 END", lo2="CASE WHEN (f % 16) & 8 <> 0 THEN 5e0 ELSE 79e-1 END", di=0.1, dj=0.1)


def _read(messages: DataFrame, key: str, payload: bool = True) -> DataFrame:
    return grib.parsed(messages.select(F.col(key).cast("string").alias("path"), F.col("message").alias("content")), payload)


def queries(sql_of: Callable[[SparkSession, str], Callable[[str], DataFrame]]) -> tuple[dict[str, Query], dict[str, str]]:
    """The queries and their SQL; sql_of gives a function from text to a table."""
    found: dict[str, Query] = {}
    text: dict[str, str] = {}
    cells = f"SELECT f, CAST(off % {NI} AS INT) AS i, CAST(off // {NI} AS INT) AS j, {{}} AS value FROM ({_whole(NI * NJ)}) w"

    def of_packing(packing: str) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            rows = _latlon(_fields(sql_of(spark, d), NI * NJ))
            back = _read(encoder.singles(rows, ["f"], packing), "f")
            return grib.cells(back).select(F.col("file").cast("long").alias("f"), "i", "j", "value")

        return run

    for packing in ("simple", "ieee32", "ieee64", "png", "complex", "spdiff1", "spdiff2", "ccsds"):
        found[f"file_{packing}"] = of_packing(packing)
        text[f"file_{packing}"] = cells.format("CAST(CAST(value AS FLOAT) AS DOUBLE)" if packing == "ieee32" else "value")

    def natural(spark: SparkSession, d: str) -> DataFrame:
        back = _read(encoder.singles(_latlon(_fields(sql_of(spark, d), NI * NJ)), ["f"], "complex"), "f")
        each = dense.in_natural_order(back, ["file"]).select("file", "nx", "ny", F.posexplode("natural").alias("off", "v"))
        return each.select(F.col("file").cast("long").alias("f"), "nx", "ny", "off", F.when(~F.isnan("v"), F.col("v")).alias("value"))

    found["natural_file"] = natural
    text["natural_file"] = f"SELECT f, CAST({NI} AS BIGINT) AS nx, CAST({NJ} AS BIGINT) AS ny, off, value FROM ({_whole(NI * NJ)}) w"

    # --- headers: a message for each customer

    columns = {
        "discipline": "CAST(c_custkey % 3 AS INT)", "centre": "CAST(c_custkey % 300 AS INT)", "subcentre": "CAST(c_nationkey AS INT)", "category": "CAST(c_custkey % 20 AS INT)", "number": "CAST(c_custkey % 200 AS INT)", "generating_process": "CAST(c_custkey % 9 AS INT)", "data_type": "CAST(c_custkey % 4 AS INT)", "production_status": "CAST(c_custkey % 2 AS INT)",
        "forecast_time": "c_custkey % 121 - 20", "surface1": "CAST(100 + c_custkey % 4 AS INT)", "scale1": "CAST(c_custkey % 5 AS INT) - 1", "value1": "c_custkey * 7 % 1000",
    }
    base = f"SELECT c_custkey AS id, {', '.join(f'{v} AS {k}' for k, v in columns.items())}, TIMESTAMP '2024-01-31 06:00:00' AS reference_time, array_of_values AS vals FROM customer"

    def headers(spark: SparkSession, d: str) -> DataFrame:
        rows = spread(sql_of(spark, d)(base.replace("array_of_values", "array(1e0, CASE WHEN c_custkey % 2 = 0 THEN 2e0 END)").replace(" AS vals", " AS `values`")), "id")
        rows = _grid(rows, time_unit="CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END", grid_template=0, ni=2, nj=1, scan=0, la1=50.0, lo1=5.0, la2=50.0, lo2=6.0, di=1.0, dj=1.0)
        heads = fields.catalogued(_read(encoder.singles(rows, ["id"], "ieee64"), "id", payload=False))
        key = F.concat_ws(".", *(F.col(f"parameter_key.{k}") for k in ("centre", "subcentre", "master_table", "local_table", "discipline", "category", "number", "product_template")))
        return heads.select(F.col("file").cast("long").alias("id"), *columns, "time_unit", "reference_time", "valid_time", "level1", F.col("level2").isNull().alias("no_second_level"), key.alias("parameter"), "grid_template", "ni", "nj", "points", "packed", "data_template", "bitmap_indicator", "la1", "lo1", "lo2", "di")

    found["file_headers"] = headers
    seconds = "(CASE WHEN id % 2 = 0 THEN 3600 ELSE 60 END)"
    text["file_headers"] = (
        f"SELECT id, {', '.join(columns)}, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS time_unit, reference_time, reference_time + to_seconds(forecast_time * {seconds}) AS valid_time, value1 / CASE scale1 WHEN -1 THEN 0.1e0 WHEN 0 THEN 1e0 WHEN 1 THEN 1e1 WHEN 2 THEN 1e2 ELSE 1e3 END AS level1, TRUE AS no_second_level, "
        "concat_ws('.', centre, subcentre, 0, 0, discipline, category, number, 0) AS parameter, 0 AS grid_template, CAST(2 AS BIGINT) AS ni, CAST(1 AS BIGINT) AS nj, CAST(2 AS BIGINT) AS points, CAST(CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS packed, 4 AS data_template, CASE WHEN id % 2 = 0 THEN 255 ELSE 0 END AS bitmap_indicator, 50e0 AS la1, 5e0 AS lo1, 6e0 AS lo2, 1e0 AS di "
        f"FROM ({base.replace(', array_of_values AS vals', '')}) b"
    )

    def bundles(spark: SparkSession, d: str) -> DataFrame:
        rows = _latlon(_fields(sql_of(spark, d), NI * NJ))
        rows = _grid(rows, b="CAST(floor(f / 3) AS BIGINT)", number="CAST(f % 3 AS INT)", forecast_time="f", packing="CASE f % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'ieee64' ELSE 'spdiff1' END")
        back = _read(encoder.encoded(rows, "b", "f"), "b")
        total = F.expr("aggregate(values, 0D, (t, v) -> CASE WHEN isnan(v) THEN t ELSE t + v END)")  # eighths: exact in any order
        return back.select(F.col("file").cast("long").alias("b"), "field_no", "file_offset", "number", "forecast_time", "data_template", total.alias("total"))

    found["file_bundles"] = bundles
    text["file_bundles"] = f"SELECT CAST(floor(f / 3) AS BIGINT) AS b, CAST(f % 3 AS INT) AS field_no, CAST(0 AS BIGINT) AS file_offset, CAST(f % 3 AS INT) AS number, f AS forecast_time, CASE f % 3 WHEN 0 THEN 0 WHEN 1 THEN 4 ELSE 3 END AS data_template, coalesce(sum(value), 0e0) AS total FROM ({_values(NI * NJ)}) v GROUP BY f"

    # --- renders. Pixels and places are worked out another way than in the library: hyperbolic functions, vectors, other forms of the projections

    tiles = [(5, 16, 11), (6, 33, 22)]
    size = 16
    pixels = (
        f"SELECT z, x, y, CAST(py AS INT) AS py, CAST(px AS INT) AS px, atan(sinh(pi() * (1 - 2 * (y + (py + 5e-1) / {size}) / pow(2e0, z)))) AS phi, (x + (px + 5e-1) / {size}) * 360 / pow(2e0, z) - 180 AS lon "
        f"FROM (VALUES {', '.join(map(str, tiles))}) t(z, x, y), range({size}) a(py), range({size}) b(px)"
    )
    grids: dict[str, tuple[dict[str, object], str]] = {
        "rotated": (
            {"grid_template": 1, "scan": 0, "la1": 2.0, "lo1": -3.0, "la2": -1.8, "lo2": 2.8, "di": 0.2, "dj": 0.2, "pole_lat": -43.0, "pole_lon": 10.0, "angle": 0.0},
            "SELECT *, CASE WHEN inside THEN (rlon + 3) / 2e-1 END AS fi, CASE WHEN inside THEN (2 - rlat) / 2e-1 END AS fj FROM (SELECT *, rlat <= 2 AND rlat >= -18e-1 AND rlon >= -3 AND rlon <= 28e-1 AS inside FROM (SELECT *, degrees(asin(-(cos(radians(-43)) * vx + sin(radians(-43)) * vz))) AS rlat, degrees(atan2(vy, cos(radians(-43)) * vz - sin(radians(-43)) * vx)) AS rlon FROM (SELECT *, cos(phi) * cos(radians(lon - 10)) AS vx, cos(phi) * sin(radians(lon - 10)) AS vy, sin(phi) AS vz FROM p) a) b) c",
        ),
        "mercator": ({"grid_template": 10, "scan": 0, "la1": 52.0, "lo1": 3.0, "lad": 45.0, "di": 25e3, "dj": 25e3}, "SELECT *, 6371229 * cos(radians(45)) * radians(lon - 3) / 25e3 AS fi, 6371229 * cos(radians(45)) * (asinh(tan(radians(52))) - asinh(tan(phi))) / 25e3 AS fj FROM p"),
        "polar": (
            {"grid_template": 20, "scan": 64, "la1": 44.0, "lo1": 4.0, "lad": 60.0, "lov": 10.0, "di": 30e3, "dj": 30e3, "south": False},
            f"SELECT *, (rho * sin(radians(lon - 10)) - rho0 * sin(radians(-6))) / 30e3 AS fi, {NJ - 1} - (rho0 * cos(radians(-6)) - rho * cos(radians(lon - 10))) / 30e3 AS fj FROM (SELECT *, 6371229 * (1 + sqrt(3e0) / 2) * cos(phi) / (1 + sin(phi)) AS rho, 6371229 * (1 + sqrt(3e0) / 2) * cos(radians(44)) / (1 + sin(radians(44))) AS rho0 FROM p) a",
        ),
        "lambert": (
            {"grid_template": 30, "scan": 64, "la1": 44.0, "lo1": 5.0, "lad": 46.0, "lov": 10.0, "latin1": 46.0, "latin2": 48.0, "di": 30e3, "dj": 30e3, "south": False},
            f"SELECT *, (rho * sin(n * radians(lon - 10)) - rho0 * sin(n * radians(-5))) / 30e3 AS fi, {NJ - 1} - (rho0 * cos(n * radians(-5)) - rho * cos(n * radians(lon - 10))) / 30e3 AS fj FROM (SELECT *, 6371229 * c / pow((1 + sin(phi)) / cos(phi), n) AS rho, 6371229 * c / pow((1 + sin(radians(44))) / cos(radians(44)), n) AS rho0 FROM (SELECT *, cos(radians(46)) * pow((1 + sin(radians(46))) / cos(radians(46)), n) / n AS c "
            "FROM (SELECT *, ln(cos(radians(46)) / cos(radians(48))) / (ln((1 + sin(radians(48))) / cos(radians(48))) - ln((1 + sin(radians(46))) / cos(radians(46)))) AS n FROM p) a) b) c",
        ),
    }

    def rendered(rows: DataFrame, how: str) -> DataFrame:
        messages = encoder.singles(rows, ["f"], "ieee64").select(F.col("f").cast("string").alias("path"), F.col("message").alias("content"))
        made = dense.rendered_files(messages, tiles, how, size)
        each = made.select(F.col("file").cast("long").alias("f"), "z", "x", "y", F.posexplode("pixels").alias("k", "v"))
        return each.select("f", "z", "x", "y", F.expr(f"CAST(floor(k / {size}) AS INT)").alias("py"), F.expr(f"CAST(k % {size} AS INT)").alias("px"), F.when(~F.isnan("v"), F.col("v")).alias("value"))

    def of_grid(columns: dict[str, object]) -> Query:
        return lambda spark, d: rendered(_grid(_fields(sql_of(spark, d), NI * NJ), ni=NI, nj=NJ, **columns), "nearest")

    out = "f, z, x, y, py, px, value"
    for name, (columns_of, placed) in grids.items():
        found[f"render_{name}"] = of_grid(columns_of)
        inside = "" if name == "rotated" else f" AND fi >= -5e-1 AND fi <= {NI} - 5e-1 AND fj >= -5e-1 AND fj <= {NJ} - 5e-1"
        text[f"render_{name}"] = f"WITH p AS ({pixels}), q AS ({placed}), v AS ({_values(NI * NJ)}), n AS (SELECT DISTINCT f FROM v) SELECT n.f, z, x, y, py, px, v.value FROM q CROSS JOIN n LEFT JOIN v ON v.f = n.f AND v.off = floor(fj + 5e-1) * {NI} + floor(fi + 5e-1) AND floor(fi + 5e-1) BETWEEN 0 AND {NI - 1} AND floor(fj + 5e-1) BETWEEN 0 AND {NJ - 1}{inside}"

    # a reduced Gaussian grid of 16 rows, whose latitudes are found here by halving on the Legendre recurrence
    widths = [12, 16, 20, 24, 28, 32, 32, 36]
    widths += widths[::-1]
    lats, first = _legendre_latitudes(16), [sum(widths[:k]) for k in range(16)]

    def reduced(spark: SparkSession, d: str) -> DataFrame:
        rows = _grid(_fields(sql_of(spark, d), sum(widths)), grid_template=40, ni=0, nj=16, gaussian_n=8, scan="CASE f % 4 WHEN 0 THEN 0 WHEN 1 THEN 64 WHEN 2 THEN 128 ELSE 80 END", la1=lats[0], la2=lats[-1], lo1="CASE WHEN f % 4 = 2 THEN 350e0 ELSE 0e0 END", lo2="CASE WHEN f % 4 = 2 THEN 0e0 ELSE 350e0 END")
        return rendered(rows.withColumn("widths", F.array(*map(F.lit, widths))), "nearest")

    found["render_reduced_gaussian"] = reduced
    rows = ", ".join(f"({j}, {lat!r}e0, {w}, {at})" for j, (lat, w, at) in enumerate(zip(lats, widths, first, strict=True)))
    text["render_reduced_gaussian"] = (
        f"WITH p AS ({pixels}), r(j, lat, width, first) AS (VALUES {rows}), q AS (SELECT *, row_number() OVER (PARTITION BY z, x, y, py, px ORDER BY abs(degrees(phi) - lat), j DESC) AS k FROM p, r), g AS (SELECT *, CAST(floor((lon + CASE WHEN lon < 0 THEN 360 ELSE 0 END) * width / 360 + 5e-1) AS INT) AS i FROM q WHERE k = 1), "
        f"v AS ({_values(sum(widths))}), n AS (SELECT DISTINCT f FROM v) SELECT {out} FROM (SELECT n.f, z, x, y, py, px, v.value FROM g CROSS JOIN n LEFT JOIN v ON v.f = n.f AND g.i < g.width AND v.off = g.first + g.i) w"
    )

    # --- the value at points, and how often each value is the commonest around them

    points = [(k, 57.5 + 0.07 * k, 4.5 + 0.11 * k) for k in range(40)]

    def at_points(how: str) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            back = _read(encoder.singles(_latlon(_fields(sql_of(spark, d), NI * NJ)), ["f"], "ieee64"), "f")
            got = dense.values_at(back, ["file"], points, how)
            return got.select(F.col("file").cast("long").alias("f"), "id", "in_grid", F.when(~F.isnan("value"), F.col("value")).alias("value"))

        return run

    spots = f"SELECT CAST(id AS BIGINT) AS id, lat <= 60 + 1e-9 AND lat >= 581e-1 - 1e-9 AND lon >= 5 AND lon <= 79e-1 + 1e-9 AS in_grid, floor((lon - 5) / 1e-1 + 5e-1) AS i, floor((60 - lat) / 1e-1 + 5e-1) AS j FROM (VALUES {', '.join(f'({k}, {a!r}e0, {b!r}e0)' for k, a, b in points)}) t(id, lat, lon)"
    found["values_at"] = at_points("nearest")
    text["values_at"] = f"WITH s AS ({spots}), v AS ({_values(NI * NJ)}), n AS (SELECT DISTINCT f FROM v) SELECT n.f, s.id, s.in_grid, v.value FROM s CROSS JOIN n LEFT JOIN v ON s.in_grid AND v.f = n.f AND v.off = j * {NI} + i"
    found["modes_at"] = at_points("mode")
    text["modes_at"] = (
        f"WITH s AS ({spots}), v AS ({_values(NI * NJ)}), n AS (SELECT DISTINCT f FROM v), t AS (SELECT n.f, s.id, v.value, count(*) AS k FROM s CROSS JOIN n CROSS JOIN range(-1, 2) a(dx) CROSS JOIN range(-1, 2) b(dy) JOIN v ON s.in_grid AND v.f = n.f AND i + dx BETWEEN 0 AND {NI - 1} AND j + dy BETWEEN 0 AND {NJ - 1} AND v.off = (j + dy) * {NI} + i + dx WHERE v.value IS NOT NULL GROUP BY n.f, s.id, v.value), "
        "b AS (SELECT f, id, value, row_number() OVER (PARTITION BY f, id ORDER BY k DESC, value) AS r FROM t) SELECT n.f, s.id, s.in_grid, b.value FROM s CROSS JOIN n LEFT JOIN b ON b.f = n.f AND b.id = s.id AND b.r = 1"
    )
    return found, text


def _legendre_latitudes(rows: int) -> list[float]:
    """The latitudes of a Gaussian grid of so many rows, from north, by halving between changes of sign."""

    def p(x: float) -> float:
        a, b = 1.0, x
        for k in range(2, rows + 1):
            a, b = b, ((2 * k - 1) * x * b - (k - 1) * a) / k
        return b

    steps = [math.cos(math.pi * k / 4000) for k in range(4001)]
    found = []
    for high, low in zip(steps, steps[1:], strict=False):
        if p(high) * p(low) < 0:
            for _ in range(80):
                mid = (high + low) / 2
                high, low = (high, mid) if p(high) * p(mid) <= 0 else (mid, low)
            found.append(math.degrees(math.asin((high + low) / 2)))
    return found
