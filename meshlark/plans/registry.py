"""The registered queries of the engine, and the same in DuckDB SQL.

The driver's tables hold no weather fields, so each operator runs on fields that
are derived from them: cells from events, points and headers from orders, packed
numbers from lineitem, tiles from nation, meshes from customer and supplier.
Results of trigonometry are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import headers as h
from ..operators import catalog, meshes, sampling, tiles, unpacking
from . import files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: The derived relations, in SQL that both engines read.
CELLS = "SELECT event_id AS off, CAST(event_id % 40 AS INT) AS i, CAST(floor(event_id / 40) AS INT) AS j, CASE WHEN event_id % 97 = 13 THEN NULL ELSE value END AS value FROM events"
POINTS = "SELECT o_orderkey AS id, 60 - (o_orderkey % 1000) * 5e-3 AS lat, 5 + (o_custkey % 400) * 5e-3 AS lon, (5 + (o_custkey % 400) * 5e-3 - 5) / 5e-2 AS fx, (60 - (60 - (o_orderkey % 1000) * 5e-3)) / 2e-2 AS fy FROM orders"
GLOBE = "SELECT o_orderkey AS id, 90 - ((o_orderkey * 7919) % 18001) / 1e2 AS lat, ((o_custkey * 104729) % 36000) / 1e2 - 180 AS lon FROM orders"
TILES = "SELECT n_nationkey AS id, 5 AS z, 10 + n_nationkey % 8 AS x, 8 + CAST(floor(n_nationkey / 8) AS INT) AS y, 16 AS w, 16 AS h FROM nation"
PACKED = "SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r, CAST(l_quantity AS INT) AS x FROM lineitem"
MESH = "SELECT 'm' AS uuid, c_custkey AS cell, degrees(asin(2 * (((c_custkey * 7919) % 10007) / 10007e0) - 1)) AS lat, ((c_custkey * 104729) % 36000) / 1e2 - 180 AS lon, c_custkey % 11 = 3 AS masked FROM customer"
SITES = "SELECT s_suppkey AS id, degrees(asin(2 * (((s_suppkey * 6007) % 9973) / 9973e0) - 1)) AS lat, ((s_suppkey * 7213) % 36000) / 1e2 - 180 AS lon FROM supplier"


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """text over the driver's tables, each read as it is named; only those that are named are opened."""
    import re

    names = "region nation customer supplier part orders lineitem events".split()
    found = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names if re.search(rf"\b{n}\b", text)}
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(names)})\b", r"\1 {\2}", text), **found)


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def both(name: str, base: str, columns: dict[str, str], rounded: bool = False, duck: dict[str, str] | None = None) -> None:
    """A query of expressions over a base relation; duck: what DuckDB spells otherwise."""
    text = {k: f"round({v}, 6) + 0e0" if rounded and k not in ("id", "off") else v for k, v in columns.items()}
    other = {k: f"round({v}, 6) + 0e0" if rounded and k not in ("id", "off") else v for k, v in (columns | (duck or {})).items()}
    _QUERIES[name] = lambda spark, d: _sql(spark, d, base).select(*(F.expr(v).alias(k) for k, v in text.items()))
    _SQL[name] = f"SELECT {', '.join(f'{v} AS {k}' for k, v in other.items())} FROM ({base}) AS base"


def _pair(names: tuple[str, ...], values: tuple[str, ...]) -> dict[str, str]:
    return dict(zip(names, values, strict=True))


# --- sampling


@query("gather_nearest", f"SELECT p.id, c.value FROM ({POINTS}) p LEFT JOIN ({CELLS}) c ON c.i = CAST(floor(p.fx + 0.5) AS INT) AND c.j = CAST(floor(p.fy + 0.5) AS INT)")
def _nearest(spark: SparkSession, d: str) -> DataFrame:
    return sampling.nearest(_sql(spark, d, POINTS), _sql(spark, d, CELLS)).select("id", "value")


_W = "CASE WHEN abs({0}) < 1 THEN ((1.5e0 * abs({0}) - 2.5e0) * abs({0})) * abs({0}) + 1 WHEN abs({0}) < 2 THEN ((-5e-1 * abs({0}) + 2.5e0) * abs({0}) - 4) * abs({0}) + 2 ELSE 0e0 END"


def _bicubic_sql(points: str, cells: str) -> str:
    wx = [f"({_W.format(f'({t})')})" for t in ("1 + dx", "dx", "1 - dx", "2 - dx")]
    wy = [f"({_W.format(f'({t})')})" for t in ("1 + dy", "dy", "1 - dy", "2 - dy")]
    w = [f"({x} * {y})" for y in wy for x in wx]
    total, top = " + ".join(w), " + ".join(f"v{k} * {w[k]}" for k in range(16))
    taps = ", ".join(f"max(CASE WHEN t = {k} THEN value END) AS v{k}" for k in range(16))
    return (
        f"WITH pts AS ({points}), cel AS ({cells}), tap AS (SELECT id, fx, fy, t, CAST(floor(fx) AS INT) - 1 + t % 4 AS ti, CAST(floor(fy) AS INT) - 1 + CAST(floor(t / 4) AS INT) AS tj FROM pts, range(16) AS r(t)), "
        f"g AS (SELECT id, fx, fy, {taps} FROM tap LEFT JOIN cel ON i = ti AND j = tj GROUP BY id, fx, fy), n AS (SELECT pts.id, c.value AS near FROM pts LEFT JOIN cel c ON c.i = CAST(floor(fx + 0.5) AS INT) AND c.j = CAST(floor(fy + 0.5) AS INT)), "
        f"m AS (SELECT g.*, n.near, fx - floor(fx) AS dx, fy - floor(fy) AS dy FROM g JOIN n USING (id)) SELECT id, CASE WHEN {' OR '.join(f'v{k} IS NULL' for k in range(16))} OR ({total}) = 0 THEN near ELSE ({top}) / ({total}) END AS value FROM m"
    )


@query("bicubic", _bicubic_sql(POINTS, CELLS))
def _bicubic(spark: SparkSession, d: str) -> DataFrame:
    return sampling.bicubic(_sql(spark, d, POINTS), _sql(spark, d, CELLS), "id")


_CLASSES = f"SELECT i, j, floor(value / 50) AS value FROM ({CELLS}) AS c"


@query(
    "mode_filter",
    f"WITH tap AS (SELECT id, CAST(floor(fx + 0.5) AS INT) - 1 + t % 3 AS ti, CAST(floor(fy + 0.5) AS INT) - 1 + CAST(floor(t / 3) AS INT) AS tj FROM ({POINTS}) p, range(9) AS r(t)), "
    f"n AS (SELECT id, value, count(*) AS n FROM tap LEFT JOIN ({_CLASSES}) c ON i = ti AND j = tj GROUP BY id, value), k AS (SELECT id, value, row_number() OVER (PARTITION BY id ORDER BY value IS NULL, n DESC, value) AS k FROM n) SELECT id, value FROM k WHERE k = 1",
)
def _mode(spark: SparkSession, d: str) -> DataFrame:
    return sampling.mode(_sql(spark, d, POINTS), _sql(spark, d, _CLASSES).withColumn("value", F.col("value").cast("double")), "id")


both("cubic_weight", "SELECT event_id AS id, (event_id % 500) / 1e2 - 25e-1 AS t FROM events", {"id": "id", "weight": f"round({g.cubic_weight('t')}, 9) + 0e0"}, duck={"weight": "round(CASE WHEN abs(t) < 1 THEN 1 - 25e-1 * t * t + 15e-1 * abs(t) * t * t WHEN abs(t) < 2 THEN 2 - 4 * abs(t) + 25e-1 * t * t - 5e-1 * abs(t) * t * t ELSE 0e0 END, 9) + 0e0"})


# --- tiles, boxes, single points

_TILE_LAT = "degrees(atan(sinh(pi() * (1 - 2 * ({}))))) "
both("tile_bounds", TILES, {"id": "id"} | _pair(("south", "west", "north", "east"), g.tile_bounds("z", "x", "y")), rounded=True, duck={"south": _TILE_LAT.format("(y + 1) / pow(2e0, z)"), "west": "360 * x / pow(2e0, z) - 180", "north": _TILE_LAT.format("y / pow(2e0, z)"), "east": "360 * (x + 1) / pow(2e0, z) - 180"})
_LAT = _TILE_LAT.format("(y + (py + 5e-1) / h) / pow(2e0, z)")
_TILE_SQL = f"SELECT id, py, px, round({_LAT}, 6) AS lat, round(x / pow(2e0, z) * 360 - 180 + (360 / pow(2e0, z)) * (px + 5e-1) / w, 6) AS lon FROM ({TILES}) t, range(16) AS a(py), range(16) AS b(px)"


@query("tile_build", _TILE_SQL)
def _tile_build(spark: SparkSession, d: str) -> DataFrame:
    return tiles.tile_pixels(_sql(spark, d, TILES)).selectExpr("id", "CAST(py AS BIGINT) AS py", "CAST(px AS BIGINT) AS px", "round(lat, 6) AS lat", "round(lon, 6) AS lon")


@query("tile_pixel", f"SELECT id, py, px, round(n + (s - n) * (py + 5e-1) / h, 6) AS lat FROM (SELECT *, {_TILE_LAT.format('y / pow(2e0, z)')} AS n, {_TILE_LAT.format('(y + 1) / pow(2e0, z)')} AS s FROM ({TILES}) t) u, range(16) AS a(py), range(16) AS b(px)")
def _tile_pixel(spark: SparkSession, d: str) -> DataFrame:
    return tiles.tile_pixel_linear(_sql(spark, d, TILES)).selectExpr("id", "CAST(py AS BIGINT) AS py", "CAST(px AS BIGINT) AS px", "round(lat, 6) AS lat")


_REGIONS = "SELECT n_nationkey AS id, 58e0 - n_nationkey / 1e1 AS south, 5e0 + n_nationkey / 1e1 AS west, 595e-1 - n_nationkey / 1e1 AS north, 65e-1 + n_nationkey / 1e1 AS east, CASE WHEN n_nationkey = 0 THEN 0 ELSE 12 END AS w, 10 AS h FROM nation"
_REGION_POINTS = f"SELECT id, py, px, west + (east - west) * (px + 5e-1) / ww AS lon, north + (south - north) * (py + 5e-1) / h AS lat FROM (SELECT *, CASE WHEN w <= 0 THEN 256 ELSE w END AS ww FROM ({_REGIONS}) r) q, range(10) AS a(py), range(256) AS b(px) WHERE px < ww"


@query("region_render", f"SELECT p.id, p.py, p.px, c.value FROM ({_REGION_POINTS}) p LEFT JOIN ({CELLS}) c ON c.i = CAST(floor((lon - 5) / 5e-2 + 0.5) AS INT) AND c.j = CAST(floor((60 - lat) / 2e-2 + 0.5) AS INT)")
def _region(spark: SparkSession, d: str) -> DataFrame:
    px = tiles.region_pixels(_sql(spark, d, _REGIONS)).withColumn("fx", F.expr("(lon - 5) / 5e-2")).withColumn("fy", F.expr("(60 - lat) / 2e-2"))
    return sampling.nearest(px, _sql(spark, d, CELLS)).selectExpr("id", "CAST(py AS BIGINT) AS py", "CAST(px AS BIGINT) AS px", "value")


_AT = g.locate_latlon("lat", "lon", "60e0", "5e0", "60e0 - 2e-2 * 99", "5e0 + 5e-2 * 39", "5e-2", "2e-2", "40", "100")


@query("value_at", f"SELECT p.id, fi IS NOT NULL AS in_grid, c.value FROM (SELECT id, {_AT[0]} AS fi, {_AT[1]} AS fj FROM ({POINTS}) q) p LEFT JOIN ({CELLS}) c ON c.i = CAST(floor(fi + 0.5) AS INT) AND c.j = CAST(floor(fj + 0.5) AS INT)")
def _value_at(spark: SparkSession, d: str) -> DataFrame:
    placed = _sql(spark, d, POINTS).select("id", F.expr(_AT[0]).alias("fx"), F.expr(_AT[1]).alias("fy"))
    return sampling.nearest(placed, _sql(spark, d, CELLS)).select("id", F.col("fx").isNotNull().alias("in_grid"), "value")


_STATS = f"SELECT CAST(floor(j / 10) AS INT) AS band, value FROM ({CELLS}) AS c"


@query("tile_stats", f"SELECT band, count(value) AS n, min(value) AS least, max(value) AS greatest, CAST(sum(CAST(value AS DECIMAL(28, 9))) AS DOUBLE) / count(value) AS mean FROM ({_STATS}) s GROUP BY band")
def _stats(spark: SparkSession, d: str) -> DataFrame:
    return tiles.statistics(_sql(spark, d, _STATS), ["band"])


#: What DuckDB holds each type in, as the library's SQL does in Spark.
_DUCK = {"int8": "TINYINT", "int16": "SMALLINT", "int32": "INT", "int64": "BIGINT", "uint8": "SMALLINT", "uint16": "INT", "uint32": "BIGINT", "uint64": "DECIMAL(20, 0)"}
for _kind in g.INTEGERS:
    _least, _most = g.INTEGERS[_kind]
    _scale = "1e1" if "8" in _kind or "16" in _kind else "1e17"
    _own = f"CASE WHEN value IS NULL THEN {_most if _least == 0 else -1} ELSE greatest({_least}, least({_most}, CAST(round((value - 100) * {_scale}) AS HUGEINT))) END"
    both(f"quantize_{_kind}", CELLS, {"off": "off", "q": g.quantized("value", _kind, float(_scale), 100.0, -1)}, duck={"q": f"CAST({_own} AS {_DUCK[_kind]})"})
both("render_float32", CELLS, {"off": "off", "value": "CAST(value AS FLOAT)"})


# --- storage order

_SCANNED = "SELECT event_id AS id, CAST(event_id % 40 AS INT) - 1 AS i, CAST(floor(event_id / 40) % 27 AS INT) - 1 AS j, CAST(floor(event_id / 1080) % 16 AS INT) * 16 AS scan FROM events"
# in DuckDB the flags are digits of a binary number, and a turned axis is the arithmetic a + flag * (n - 1 - 2 a)
_E, _N, _C, _T = "(scan // 128 % 2)", "(scan // 64 % 2)", "(scan // 32 % 2)", "(scan // 16 % 2)"
_SI, _SJ = f"(i + {_E} * (37 - 2 * i))", f"(j + {_N} * (24 - 2 * j))"
_BY_ROW, _BY_COLUMN = f"({_SJ} * 38 + {_SI} + {_T} * ({_SJ} % 2) * (37 - 2 * {_SI}))", f"({_SI} * 25 + {_SJ} + {_T} * ({_SI} % 2) * (24 - 2 * {_SJ}))"
both("scan_index", _SCANNED, {"id": "id", "off": g.storage_offset("i", "j", "38", "25", "scan")}, duck={"off": f"CASE WHEN i BETWEEN 0 AND 37 AND j BETWEEN 0 AND 24 THEN CASE {_C} WHEN 1 THEN {_BY_COLUMN} ELSE {_BY_ROW} END ELSE -1 END"})
_A = f"(CASE {_C} WHEN 1 THEN off // 25 ELSE off // 38 END)"
_B = f"(CASE {_C} WHEN 1 THEN off % 25 + {_T} * ({_A} % 2) * (24 - 2 * (off % 25)) ELSE off % 38 + {_T} * ({_A} % 2) * (37 - 2 * (off % 38)) END)"
_I, _J = f"(CASE {_C} WHEN 1 THEN {_A} ELSE {_B} END)", f"(CASE {_C} WHEN 1 THEN {_B} ELSE {_A} END)"
both("natural_order", "SELECT event_id AS id, CAST(event_id % 950 AS INT) AS off, CAST(floor(event_id / 950) % 16 AS INT) * 16 AS scan FROM events", {"id": "id"} | _pair(("i", "j"), g.natural_ij("off", "38", "25", "scan")), duck={"i": f"CAST({_I} + {_E} * (37 - 2 * {_I}) AS INT)", "j": f"CAST({_J} + {_N} * (24 - 2 * {_J}) AS INT)"})
both("scan_flags", _SCANNED, {"id": "id", "east": "(scan & 128) = 0", "north": "(scan & 64) <> 0", "by_column": "(scan & 32) <> 0", "turning": "(scan & 16) <> 0"}, duck={"east": f"{_E} = 0", "north": f"{_N} = 1", "by_column": f"{_C} = 1", "turning": f"{_T} = 1"})

_PL = "SELECT n_nationkey AS j, 20 + 4 * (CASE WHEN n_nationkey < 13 THEN n_nationkey ELSE 24 - n_nationkey END) AS width FROM nation"


@query("pl_prefix_sum", f"SELECT j, width, CAST(sum(width) OVER (ORDER BY j) - width AS BIGINT) AS first FROM ({_PL}) p")
def _prefix(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.gaussian import row_offsets

    return row_offsets(_sql(spark, d, _PL).withColumn("grid", F.lit(0)), ["grid"]).select("j", "width", "first")


_GAUSS = f"WITH rows AS (SELECT j, width, first, lat, lead(lat) OVER (ORDER BY j) AS next FROM (SELECT j, width, CAST(sum(width) OVER (ORDER BY j) - width AS BIGINT) AS first, 72e0 - 6 * j AS lat FROM ({_PL}) p) q), spot AS (SELECT id, lon, j + (lat - plat) / (lat - next) AS fj FROM (SELECT id, lon, lat AS plat FROM ({GLOBE}) g) s LEFT JOIN rows ON plat <= lat AND (plat > next OR j = 23 AND plat >= next)) "
_GAUSS += "SELECT spot.id, round(fj, 6) AS fj, round((lon - 360 * floor(lon / 360)) / (360e0 / width), 6) AS fi, CAST(r.first + (CAST(floor((lon - 360 * floor(lon / 360)) / (360e0 / width) + 0.5) AS INT) % width) AS BIGINT) AS off FROM spot LEFT JOIN rows r ON r.j = CAST(floor(fj + 0.5) AS INT)"


@query("gaussian_locate", _GAUSS)
def _gaussian(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.gaussian import locate, row_offsets

    rows = row_offsets(_sql(spark, d, _PL).withColumn("grid", F.lit(0)), ["grid"]).selectExpr("j", "width", "first", "72e0 - 6 * j AS lat")
    return locate(_sql(spark, d, GLOBE), rows, "id").selectExpr("id", "round(fj, 6) AS fj", "round(fi, 6) AS fi", "off")


# --- geometry

# the SQL works these out another way than the library: remainders, hyperbolic functions, vectors, half angles
_MOD = "((({0}) - ({1})) % 360 + 360) % 360 + ({1})"
both("wrap_lon", GLOBE, {"id": "id", "around": g.wrap360("lon * 3", "-20"), "centred": g.wrap180("lon * 3")}, rounded=True, duck={"around": _MOD.format("lon * 3", "-20"), "centred": _MOD.format("lon * 3", "-180")})
both(
    "latlon_bounds", "SELECT o_orderkey AS id, o_orderkey % 90 * 1e0 AS la1, o_custkey % 90 * 1e0 AS la2, o_orderkey % 360 * 1e0 AS lo1, o_custkey % 360 * 1e0 AS lo2, CAST(o_orderkey % 2 AS INT) * 128 AS scan FROM orders", {"id": "id"} | _pair(("south", "west", "north", "east"), g.latlon_bounds("la1", "lo1", "la2", "lo2", "scan")),
    duck={"south": "least(la1, la2)", "north": "greatest(la1, la2)", "west": "[lo1, lo2][1 + scan // 128]", "east": "[lo2, lo1][1 + scan // 128] + CASE WHEN [lo2, lo1][1 + scan // 128] < [lo1, lo2][1 + scan // 128] THEN 360 ELSE 0 END"},
)
_X = f"({_MOD.format('lon', '-20')})"
_IN = f"lat <= 60 + 1e-9 AND lat >= -30 - 1e-9 AND {_X} <= 70 + 1e-9"
both("locate_latlon", GLOBE, {"id": "id"} | _pair(("fi", "fj"), g.locate_latlon("lat", "lon", "60e0", "-20e0", "-30e0", "70e0", "25e-2", "5e-1", "361", "181")), rounded=True, duck={"fi": f"CASE WHEN {_IN} THEN least(4 * ({_X} + 20), 360e0) END", "fj": f"CASE WHEN {_IN} THEN least(greatest(2 * (60 - lat), 0e0), 180e0) END"})


def _metres(name: str, columns: tuple[str, str], x: str, y: str, nx: int, ny: int, more: str = "TRUE") -> None:
    """A query of places on a projected grid; x, y: cells from its north-west corner, as DuckDB works them out."""
    inside = f"{x} >= -5e-1 AND {x} <= {nx} - 5e-1 AND {y} >= -5e-1 AND {y} <= {ny} - 5e-1 AND {more}"
    both(name, GLOBE, {"id": "id"} | _pair(("fi", "fj"), columns), rounded=True, duck={"fi": f"CASE WHEN {inside} THEN {x} END", "fj": f"CASE WHEN {inside} THEN {y} END"})


_R = "6371229e0"
_metres("locate_mercator", g.locate_mercator("lat", "lon", "60e0", "-30e0", "20e0", "1e4", "1e4", "600", "900", "0"), f"({_R} * cos(radians(20)) * radians({_MOD.format('lon + 30', '-180')}) / 1e4)", f"({_R} * cos(radians(20)) * (asinh(tan(radians(60))) - asinh(tan(radians(lat)))) / 1e4)", 600, 900)
_RHO = f"({_R} * (1 + sqrt(3e0) / 2) * cos(radians({{0}})) / (1 + sin(radians({{0}}))))"
_metres("locate_polar", g.locate_polar("lat", "lon", "-20826e-3", "-125e0", "60e0", "-80e0", "19e3", "19e3", "700", "700", "64"), f"(({_RHO.format('lat')} * sin(radians(lon + 80)) - {_RHO.format('-20826e-3')} * sin(radians(-45))) / 19e3)", f"(699 - ({_RHO.format('-20826e-3')} * cos(radians(-45)) - {_RHO.format('lat')} * cos(radians(lon + 80))) / 19e3)", 700, 700, "lat >= -10")
_N38 = "sin(radians(385e-1))"
_CONE = f"({_R} * cos(radians(385e-1)) * pow((1 + {_N38}) / cos(radians(385e-1)), {_N38}) / {_N38} / pow((1 + sin(radians(greatest({{0}}, -89999e-3)))) / cos(radians(greatest({{0}}, -89999e-3))), {_N38}))"
_TURN = f"({_N38} * radians({_MOD.format('{0} - 2625e-1', '-180')}))"
_metres(
    "locate_lambert", g.locate_lambert("lat", "lon", "21138e-3", "2372806e-4 - 100", "2625e-1", 38.5, 38.5, "3e3", "3e3", "1799", "1059", "64"),
    f"(({_CONE.format('lat')} * sin({_TURN.format('lon')}) - {_CONE.format('21138e-3')} * sin({_TURN.format('1372806e-4')})) / 3e3)", f"(1058 - ({_CONE.format('21138e-3')} * cos({_TURN.format('1372806e-4')}) - {_CONE.format('lat')} * cos({_TURN.format('lon')})) / 3e3)", 1799, 1059,
)
_V = lambda pole: ("(cos(radians(lat)) * cos(radians(lon - {0})))".format(pole), "(cos(radians(lat)) * sin(radians(lon - {0})))".format(pole), "sin(radians(lat))")
_VX, _VY, _VZ = _V(10)
both("rotate_latlon", GLOBE, {"id": "id"} | _pair(("rlat", "rlon"), g.rotated("lat", "lon", "-43e0", "10e0")), rounded=True, duck={"rlat": f"90 - degrees(acos(greatest(-1e0, least(1e0, -(cos(radians(43)) * {_VX} - sin(radians(43)) * {_VZ})))))", "rlon": f"degrees(atan2({_VY}, cos(radians(43)) * {_VZ} + sin(radians(43)) * {_VX}))"})
_SX, _SY, _SZ = _V(2)
_TOP = f"(cos(radians(46)) * {_SX} + sin(radians(46)) * {_SZ})"
both("stretch_coords", GLOBE, {"id": "id"} | _pair(("slat", "slon"), g.stretched("lat", "lon", "46e0", "2e0", "24e-1")), rounded=True, duck={"slat": f"degrees(2 * atan(sqrt((1 + {_TOP}) / (1 - {_TOP})) / 24e-1)) - 90", "slon": f"degrees(atan2({_SY}, sin(radians(46)) * {_SX} - cos(radians(46)) * {_SZ}))"})
both("unit_vector", GLOBE, {"id": "id"} | _pair(("x", "y", "z"), g.unit_vector("lat", "lon")), rounded=True, duck={"x": "sin(radians(90 - lat)) * sin(radians(90 - lon))", "y": "sin(radians(90 - lat)) * cos(radians(90 - lon))", "z": "cos(radians(90 - lat))"})
both("chord_of_metres", GLOBE, {"id": "id", "d2": g.chord2("abs(lat) * 1e5")}, rounded=True, duck={"d2": f"2 - 2 * cos(abs(lat) * 1e5 / {_R})"})
_LONG = "(CASE WHEN shape = 2 THEN 6378160e0 WHEN shape IN (4, 5, 10) THEN 6378137e0 WHEN shape = 9 THEN 6377563.396e0 ELSE greatest(major, minor) END)"
_SHORT = "(CASE WHEN shape = 2 THEN 6356775e0 WHEN shape IN (4, 5, 10) THEN 6356752.314245e0 WHEN shape = 9 THEN 6356256.909e0 ELSE least(major, minor) END)"
_ECC = f"(sqrt({_LONG} * {_LONG} - {_SHORT} * {_SHORT}) / {_LONG})"
both(
    "earth_radius", "SELECT o_orderkey AS id, CAST(o_orderkey % 13 AS INT) AS shape, 6e6 + o_custkey AS radius, 6378e3 + o_custkey AS major, 6356e3 + o_orderkey % 50 AS minor FROM orders", {"id": "id", "metres": g.effective_radius("shape", "radius", "major", "minor")}, rounded=True,
    duck={"metres": f"CASE WHEN shape = 0 THEN 6367470e0 WHEN shape = 1 THEN radius WHEN shape = 8 THEN 6371200e0 WHEN shape = 11 THEN 695990000e0 WHEN shape IN (2, 3, 4, 5, 7, 9, 10) THEN sqrt({_LONG} * {_LONG} / 2 + {_SHORT} * {_SHORT} / 2 * atanh({_ECC}) / {_ECC}) ELSE {_R} END"},
)
both("bucket_of", GLOBE, {"id": "id"} | _pair(("lat_row", "lon_column"), g.bucket("lat", "lon", "45")), duck={"lat_row": "CAST(least(greatest(floor((90 - lat) / 4), 0), 44) AS INT)", "lon_column": f"CAST(floor(({_MOD.format('lon', '-180')} + 180) / 4) AS INT) % 90"})


# --- headers

_HEADERS = "SELECT o_orderkey AS id, o_orderdate AS ref, CAST(o_orderkey % 17 AS INT) AS unit, CAST(o_custkey % 48 AS INT) AS n, CAST(o_orderkey % 9 AS INT) - 2 AS scale, CASE WHEN o_custkey % 31 = 0 THEN 4294967295 ELSE o_custkey % 100000 END AS level, CAST(o_orderkey % 70 AS INT) AS template, CAST(o_custkey % 4 AS INT) AS bands FROM orders"
both("valid_time", _HEADERS, {"id": "id", "valid": h.valid_time("ref", "unit", "n")}, duck={"valid": h.valid_time("ref", "unit", "n", duck=True)})
both("surface_level", _HEADERS, {"id": "id", "level": h.level("CASE WHEN scale = 6 THEN -127 ELSE scale END", "level")}, rounded=True, duck={"level": "CASE WHEN scale <> 6 AND level < 4294967295 THEN level / CASE WHEN scale < 0 THEN 1e0 / list_product(list_transform(range(-scale), lambda k: 10)) ELSE coalesce(list_product(list_transform(range(scale), lambda k: 10)), 1e0) END END"})
both("probability_limit", _HEADERS, {"id": "id", "bound": h.limit("scale", "CASE WHEN level = 4294967295 THEN -2147483647 ELSE level - 50000 END")}, rounded=True, duck={"bound": "CASE WHEN level < 4294967295 THEN (level - 50000) / [1e-2, 1e-1, 1e0, 1e1, 1e2, 1e3, 1e4, 1e5, 1e6][scale + 3] END"})
both("ensemble_offset", _HEADERS, {"id": "id", "place": h.ensemble_at("template", "bands")}, duck={"place": "CASE WHEN template IN (1, 11, 60, 61) THEN 34 WHEN template IN (41, 43) THEN 36 WHEN template IN (45, 47) THEN 47 WHEN template IN (33, 34) AND bands > 0 THEN 23 + 11 * bands END"})
both("interval_offset", _HEADERS, {"id": "id", "place": h.interval_at("template")}, duck={"place": "CASE WHEN template = 8 THEN 34 WHEN template = 10 THEN 35 WHEN template IN (12, 42) THEN 36 WHEN template = 11 THEN 37 WHEN template = 43 THEN 39 WHEN template = 61 THEN 44 WHEN template IN (9, 46) THEN 47 WHEN template = 47 THEN 50 END"})
both("angle_scale", _HEADERS, {"id": "id", "divisor": h.angle_scale("n", "level")}, duck={"divisor": "coalesce(CAST(nullif(nullif(level, 4294967295), 0) AS DOUBLE) / nullif(n, 0), 1e6)"})
both("sign_magnitude", _HEADERS, {"id": "id", "v8": h.sign_magnitude("level % 256", 8), "v16": h.sign_magnitude("level % 65536", 16)}, duck={"v8": "(level % 128) * (1 - 2 * (level // 128 % 2))", "v16": "(level % 32768) * (1 - 2 * (level // 32768 % 2))"})
both("section_lengths", _HEADERS, {"id": "id", "ok": h.section_ok("bands + 1", "level % 30")}, duck={"ok": "level % 30 >= [21, 5, 14, 9][bands + 1]"})
_PARAMS = "SELECT CAST(p_partkey % 4 AS INT) AS category, p_size AS number, min(p_name) AS name FROM part GROUP BY 1, 2"
_MESSAGES = "SELECT o_orderkey AS id, CAST(o_custkey % 5 AS INT) AS category, CAST(o_orderkey % 50 AS INT) AS number FROM orders"


@query("param_resolve", f"SELECT m.id, p.name FROM ({_MESSAGES}) m LEFT JOIN ({_PARAMS}) p USING (category, number)")
def _params(spark: SparkSession, d: str) -> DataFrame:
    return catalog.resolved(_sql(spark, d, _MESSAGES), _sql(spark, d, _PARAMS), ["category", "number"], ["name"]).select("id", "name")


_LOG = "SELECT CAST(floor(event_id / 28) AS BIGINT) AS message, event_id AS place, CAST(CASE WHEN event_id % 28 < 7 THEN 1 + event_id % 28 ELSE 4 + (event_id % 28 - 7) % 4 END AS INT) AS number, event_type = 'error' AS reuse FROM events"
_RUN = "OVER (PARTITION BY message ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("sticky_sections", f"SELECT message, s7, {', '.join(f's{n}' for n in range(1, 7))} FROM (SELECT message, number, place AS s7, {', '.join(f'max(CASE WHEN number = {n}' + (' AND NOT reuse' if n == 6 else '') + f' THEN place END) {_RUN} AS s{n}' for n in range(1, 7))} FROM ({_LOG}) l) q WHERE number = 7")
def _sticky(spark: SparkSession, d: str) -> DataFrame:
    return catalog.sticky(_sql(spark, d, _LOG), ["message"], "place")


# --- packed values

both("simple_unpack", PACKED, {"k": "k", "r": "r", "value": f"round({unpacking.scaled('x', 2.5, -3, 2)}, 6)"}, duck={"value": "round((25e-1 + x / 8e0) / 100, 6)"})
both("bit_unpack", PACKED, {"k": "k", "r": "r", "a": unpacking.bits_at("x * 977", 5, 0, 20), "b": unpacking.bits_at("x * 977", 5, 1, 20), "c": unpacking.bits_at("x * 977", 5, 3, 20)}, duck={"a": "(x * 977) >> 15 & 31", "b": "(x * 977) >> 10 & 31", "c": "(x * 977) & 31"})


@query("log_inverse", f"SELECT k, r, round(exp(x / 1e1) - 1, 6) AS value FROM ({PACKED}) p")
def _log(spark: SparkSession, d: str) -> DataFrame:
    """Eight bits a value, a tenth for each step, one taken off: the kernel of template 61."""
    import struct

    import pyarrow as pa

    from ..sources import octets, packings

    body = struct.pack(">f", 0.0) + octets.signed_octets(0, 2) + octets.signed_octets(1, 2) + bytes([8]) + struct.pack(">f", 1.0)

    def run(batches):
        for b in batches:
            x = b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packings.values(61, body, octets.pack(x, 8), len(x), None))], ["k", "r", "value"])

    return _sql(spark, d, PACKED).mapInArrow(run, "k long, r int, value double").selectExpr("k", "r", "round(value, 6) AS value")


both("finalize_values", PACKED, {"k": "k", "r": "r", "value": f"CASE WHEN x IN (49, 50) THEN NULL ELSE round({unpacking.scaled('x', 273.25, 2, 1)}, 6) END"}, duck={"value": "CASE WHEN x < 49 THEN round(27325e-3 + x * 4e-1, 6) END"})
_BITS = "SELECT CAST(floor(event_id / 500) AS BIGINT) AS f, CAST(event_id % 500 AS INT) AS off, event_type <> 'error' AS bit, value FROM events"
_VALUES = f"SELECT f, row_number() OVER (PARTITION BY f ORDER BY off) - 1 AS ordinal, value FROM ({_BITS}) b WHERE bit"


@query("bitmap_expand", f"SELECT f, off, CASE WHEN bit THEN value END AS value FROM ({_BITS}) b")
def _bitmap(spark: SparkSession, d: str) -> DataFrame:
    return unpacking.expanded(_sql(spark, d, _BITS).drop("value"), _sql(spark, d, _VALUES), ["f"])


@query("bitmap_build", f"SELECT f, CAST(floor(off / 8) AS BIGINT) AS byte_no, CAST(sum(CASE WHEN bit THEN pow(2, 7 - off % 8) ELSE 0 END) AS INT) AS byte FROM ({_BITS}) b GROUP BY 1, 2")
def _bitmap_build(spark: SparkSession, d: str) -> DataFrame:
    return unpacking.bitmap_bytes(_sql(spark, d, _BITS), ["f"])


_GROUPS = "SELECT o_orderkey AS id, o_orderkey % 1000 AS ref, CAST(1 + o_custkey % 7 AS INT) AS len, CAST(o_custkey % 3 AS INT) AS width FROM orders"


@query("complex_groups", f"SELECT id, k, ref + CASE WHEN width = 0 THEN 0 ELSE (ref + k) % (width * 2) END AS x FROM ({_GROUPS}) g, range(7) AS r(k) WHERE k < len")
def _groups(spark: SparkSession, d: str) -> DataFrame:
    offset = F.expr("CASE WHEN width = 0 THEN 0 ELSE (ref + k) % (width * 2) END")
    rows = unpacking.group_values(_sql(spark, d, _GROUPS), ["id"], offset=offset)
    return rows.select("id", F.col("k").cast("long").alias("k"), "x")


@query("spdiff1", f"SELECT k, r, CAST(sum(CASE WHEN r = 1 THEN x ELSE x - 7 END) OVER (PARTITION BY k ORDER BY r) AS BIGINT) AS full_value FROM ({PACKED}) p")
def _spdiff1(spark: SparkSession, d: str) -> DataFrame:
    return unpacking.undifferenced(_sql(spark, d, PACKED), ["k"], ["r"], 1, least=-7).select("k", "r", F.col("full").alias("full_value"))


@query("spdiff2", f"SELECT k, r, CAST(x1 + sum(s) OVER (PARTITION BY k ORDER BY r) AS BIGINT) AS full_value FROM (SELECT k, r, x1, sum(CASE WHEN r = 1 THEN 0 WHEN r = 2 THEN x - x1 ELSE x - 7 END) OVER (PARTITION BY k ORDER BY r) AS s FROM (SELECT k, r, x, first_value(x) OVER (PARTITION BY k ORDER BY r) AS x1 FROM ({PACKED}) p) a) b")
def _spdiff2(spark: SparkSession, d: str) -> DataFrame:
    return unpacking.undifferenced(_sql(spark, d, PACKED), ["k"], ["r"], 2, least=-7).select("k", "r", F.col("full").alias("full_value"))


_FIELDS = "SELECT CAST(event_id % 50 AS INT) AS f, value FROM events"


@query("pack_parameters", f"SELECT f, min(value) AS reference, CAST(ceil(log2((max(value) - min(value)) / 4095e0)) AS INT) AS binary_scale FROM ({_FIELDS}) v GROUP BY f")
def _pack(spark: SparkSession, d: str) -> DataFrame:
    return unpacking.packing(_sql(spark, d, _FIELDS), ["f"], 12).select("f", "reference", F.col("binary").alias("binary_scale"))


# --- meshes

_ARRAYS = "SELECT CAST(floor(event_id / 4) AS BIGINT) AS uuid, event_id AS no, 0 AS discipline, CASE WHEN user_id % 3 = 0 THEN 191 ELSE 2 END AS category, CAST(event_id % 4 AS INT) AS number, CASE event_id % 4 WHEN 0 THEN 500e0 WHEN 1 THEN CASE WHEN user_id % 2 = 0 THEN 15e-1 ELSE 89e0 END WHEN 2 THEN CASE WHEN user_id % 2 = 0 THEN 31e-1 ELSE 179e0 END ELSE 359e0 END AS most FROM events"
_PAIRED = f"SELECT uuid, min(CASE WHEN category = 191 AND number = 1 THEN no END) AS c1, min(CASE WHEN category = 191 AND number = 2 THEN no END) AS c2, min(CASE WHEN most <= 1.5807963267948966e0 OR (most > 3.151592653589793e0 AND most <= 905e-1) THEN no END) AS r1, min(CASE WHEN (most > 1.5807963267948966e0 AND most <= 3.151592653589793e0) OR (most > 905e-1 AND most <= 3605e-1) THEN no END) AS r2 FROM ({_ARRAYS}) a GROUP BY uuid"


@query("mesh_pair", f"WITH c AS (SELECT uuid, c1 IS NOT NULL AND c2 IS NOT NULL AS coded, CASE WHEN c1 IS NOT NULL AND c2 IS NOT NULL THEN c1 ELSE r1 END AS lat_no, CASE WHEN c1 IS NOT NULL AND c2 IS NOT NULL THEN c2 ELSE r2 END AS lon_no FROM ({_PAIRED}) p) SELECT c.uuid, lat_no, lon_no, CASE WHEN coded THEN a.most <= 3.151592653589793e0 ELSE a.most <= 1.5807963267948966e0 END AS lat_radians, b.most <= 3.151592653589793e0 AS lon_radians FROM c JOIN ({_ARRAYS}) a ON a.no = lat_no JOIN ({_ARRAYS}) b ON b.no = lon_no")
def _mesh_pair(spark: SparkSession, d: str) -> DataFrame:
    return meshes.paired(_sql(spark, d, _ARRAYS))


_FIELD = "SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'x' ELSE 'm' END AS uuid, o_orderkey AS id, o_custkey AS cell FROM orders"


@query("mesh_attach", f"SELECT f.id, round(m.lat, 6) AS lat, round(m.lon, 6) AS lon FROM ({_FIELD}) f LEFT JOIN ({MESH}) m USING (uuid, cell)")
def _attach(spark: SparkSession, d: str) -> DataFrame:
    return meshes.attached(_sql(spark, d, _FIELD), _sql(spark, d, MESH)).selectExpr("id", "round(lat, 6) AS lat", "round(lon, 6) AS lon")


@query("mesh_ids", f"SELECT uuid, count(*) AS cells FROM ({_FIELD}) f GROUP BY uuid")
def _mesh_ids(spark: SparkSession, d: str) -> DataFrame:
    return meshes.mesh_ids(_sql(spark, d, _FIELD))


@query("bucket_histogram", f"SELECT {g.bucket('lat', 'lon', '12')[0]} AS lat_row, {g.bucket('lat', 'lon', '12')[1]} AS lon_column, count(*) AS n FROM ({MESH}) m GROUP BY 1, 2")
def _histogram(spark: SparkSession, d: str) -> DataFrame:
    return meshes.histogram(_sql(spark, d, MESH), 12).selectExpr("row AS lat_row", "column AS lon_column", "n")


def _near_sql(keep: str, sites: str = SITES, mesh: str = MESH) -> str:
    v = lambda t: ", ".join(f"{e} AS {t}{k}" for k, e in zip("xyz", g.unit_vector("lat", "lon"), strict=True))
    d2 = "(px - mx) * (px - mx) + (py - my) * (py - my) + (pz - mz) * (pz - mz)"
    return f"SELECT id, CASE WHEN {keep} THEN cell END AS cell FROM (SELECT id, cell, masked, d2, row_number() OVER (PARTITION BY id ORDER BY d2, cell) AS k FROM (SELECT id, cell, masked, {d2} AS d2 FROM (SELECT id, {v('p')} FROM ({sites}) s) p, (SELECT cell, masked, {v('m')} FROM ({mesh}) c) m) a) b WHERE k = 1"


for _name, _cap, _keep in (("mesh_nearest", None, "TRUE"), ("mesh_mask", None, "NOT masked"), ("mesh_nearest_capped", 150_000.0, f"d2 <= {g.chord2('150000e0')}")):

    def _near(spark: SparkSession, d: str, cap: float | None = _cap, masked: bool = _name == "mesh_mask") -> DataFrame:
        mesh = _sql(spark, d, MESH)
        return meshes.nearest_cells(_sql(spark, d, SITES), mesh if masked else mesh.drop("masked"), "id", 12, cap).select("id", "cell")

    query(_name, _near_sql(_keep))(_near)


_CELL_TILES = "SELECT n_nationkey AS id, 3 AS z, n_nationkey % 8 AS x, 1 + CAST(floor(n_nationkey / 8) AS INT) AS y, 4 AS w, 4 AS h FROM nation"


_CELL_PIXELS = f"SELECT CAST(id * 16 + py * 4 + px AS BIGINT) AS id, {_TILE_LAT.format('(y + (py + 5e-1) / h) / pow(2e0, z)')} AS lat, x / pow(2e0, z) * 360 - 180 + (360 / pow(2e0, z)) * (px + 5e-1) / w AS lon FROM ({_CELL_TILES}) t, range(4) AS a(py), range(4) AS b(px)"


@query("tile_cell_map", f"SELECT id AS pixel, cell FROM ({_near_sql('TRUE', _CELL_PIXELS)}) n")
def _cell_map(spark: SparkSession, d: str) -> DataFrame:
    px = tiles.tile_pixels(_sql(spark, d, _CELL_TILES)).withColumn("pixel", F.expr("CAST(id * 16 + py * w + px AS BIGINT)"))
    return meshes.nearest_cells(px, _sql(spark, d, MESH).drop("masked"), "pixel", 12).select("pixel", "cell")


_TWO = f"SELECT CASE WHEN cell % 3 = 0 THEN 'a' ELSE 'b' END AS uuid, cell, lat, lon, FALSE AS masked FROM ({MESH}) t"
_TWO_SITES = f"SELECT CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS uuid, id, lat, lon FROM ({SITES}) t"


@query("mesh_of_two", " UNION ALL ".join(_near_sql("TRUE", f"SELECT * FROM ({_TWO_SITES}) s WHERE uuid = '{u}'", f"SELECT * FROM ({_TWO}) m WHERE uuid = '{u}'") for u in "ab"))
def _of_two(spark: SparkSession, d: str) -> DataFrame:
    return meshes.nearest_cells(_sql(spark, d, _TWO_SITES), _sql(spark, d, _TWO), "id", 12).select("id", "cell")


@query("mesh_render", f"SELECT n.id AS pixel, f.f, f.value FROM ({_near_sql('TRUE', _CELL_PIXELS)}) n JOIN (SELECT event_id % 3 AS f, event_id // 3 AS cell, value FROM events) f ON f.cell = n.cell")
def _mesh_render(spark: SparkSession, d: str) -> DataFrame:
    """The map from pixels to cells is found once and joined to three fields on the mesh."""
    from ..operators import fields

    values = _sql(spark, d, "SELECT 'm' AS uuid, event_id % 3 AS f, CAST(floor(event_id / 3) AS BIGINT) AS cell, value FROM events")
    return fields.with_tiles(_cell_map(spark, d).withColumn("uuid", F.lit("m")), values).where("f IS NOT NULL").select("pixel", "f", "value")


# --- whole renders

_RENDER = f"SELECT n_nationkey AS id, 8 AS z, 131 + n_nationkey % 5 AS x, 74 + CAST(floor(n_nationkey / 5) AS INT) AS y, 16 AS w, 16 AS h FROM nation"


def _rendered(spark: SparkSession, d: str, how: str) -> DataFrame:
    px = tiles.tile_pixels(_sql(spark, d, _RENDER)).withColumn("pixel", F.expr("CAST(id AS BIGINT) * 256 + py * 16 + px"))
    fi, fj = g.locate_latlon("lat", "lon", "60e0", "5e0", "5e1", "5e0 + 5e-2 * 39", "5e-2", "2e-2", "40", "501")
    placed = px.select("pixel", F.expr(f"round({fi}, 6)").alias("fx"), F.expr(f"round({fj}, 6)").alias("fy"))
    return sampling.resample(placed, _sql(spark, d, CELLS), "pixel", how)


_PIXELS = f"SELECT CAST(id AS BIGINT) * 256 + py * 16 + px AS id, round({g.locate_latlon('lat', 'lon', '60e0', '5e0', '5e1', '5e0 + 5e-2 * 39', '5e-2', '2e-2', '40', '501')[0]}, 6) AS fx, round({g.locate_latlon('lat', 'lon', '60e0', '5e0', '5e1', '5e0 + 5e-2 * 39', '5e-2', '2e-2', '40', '501')[1]}, 6) AS fy FROM (SELECT id, py, px, {_LAT} AS lat, x / pow(2e0, z) * 360 - 180 + (360 / pow(2e0, z)) * (px + 5e-1) / w AS lon FROM ({_RENDER}) t, range(16) AS a(py), range(16) AS b(px)) q"


@query("tile_render", f"SELECT p.id AS pixel, c.value FROM ({_PIXELS}) p LEFT JOIN ({CELLS}) c ON c.i = CAST(floor(fx + 0.5) AS INT) AND c.j = CAST(floor(fy + 0.5) AS INT)")
def _tile_render(spark: SparkSession, d: str) -> DataFrame:
    return _rendered(spark, d, "nearest")


@query("tile_render_bicubic", f"SELECT id AS pixel, value FROM ({_bicubic_sql(_PIXELS, CELLS)}) r")
def _tile_bicubic(spark: SparkSession, d: str) -> DataFrame:
    return _rendered(spark, d, "bicubic")


_FILE_QUERIES, _FILE_SQL = files.queries(lambda spark, d: lambda text: _sql(spark, d, text))
_QUERIES |= _FILE_QUERIES
_SQL |= _FILE_SQL


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bicubic tiles over the field of events."""
    return _rendered(spark, sf_dir, "bicubic")
