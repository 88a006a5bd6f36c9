"""Grid geometry as SQL expression text: arguments and results are expressions, usable in selectExpr, F.expr or plain SQL.

Natural order is west to east in a row and north to south by rows; storage order
follows the scanning-mode flags of the file. All angles are in degrees.
"""

from __future__ import annotations

#: Radius (m) of the sphere that shape code 6 and every unusable shape stand for (fixed value).
RADIUS = 6371229.0


def wrap360(lon: str, base: str = "0") -> str:
    """lon shifted by whole turns into [base, base + 360)."""
    return f"(({lon}) - 360 * floor((({lon}) - ({base})) / 360))"


def wrap180(lon: str) -> str:
    """lon shifted by whole turns into [-180, 180)."""
    return f"(({lon}) - 360 * floor((({lon}) + 180) / 360))"


def clamp(x: str, low: str, high: str) -> str:
    """x held between low and high; null stays null."""
    return f"(CASE WHEN ({x}) < ({low}) THEN ({low}) WHEN ({x}) > ({high}) THEN ({high}) ELSE ({x}) END)"


def half_up(x: str) -> str:
    """x rounded to a whole number, halves away from zero."""
    return f"(CASE WHEN ({x}) < 0 THEN -floor(-({x}) + 5e-1) ELSE floor(({x}) + 5e-1) END)"


# --- storage order


def storage_offset(i: str, j: str, ni: str, nj: str, scan: str) -> str:
    """The place in storage of the cell (i, j) of a rectangular grid in natural order; -1 outside.

    Flags: 128 rows run east to west, 64 rows run south to north, 32 columns are
    contiguous, 16 every other row (or column) runs backwards.
    """
    si = f"(CASE WHEN (({scan}) & 128) <> 0 THEN ({ni}) - 1 - ({i}) ELSE ({i}) END)"
    sj = f"(CASE WHEN (({scan}) & 64) <> 0 THEN ({nj}) - 1 - ({j}) ELSE ({j}) END)"
    back_i = f"(CASE WHEN (({scan}) & 16) <> 0 AND {sj} % 2 = 1 THEN ({ni}) - 1 - {si} ELSE {si} END)"
    back_j = f"(CASE WHEN (({scan}) & 16) <> 0 AND {si} % 2 = 1 THEN ({nj}) - 1 - {sj} ELSE {sj} END)"
    return f"(CASE WHEN ({i}) < 0 OR ({i}) >= ({ni}) OR ({j}) < 0 OR ({j}) >= ({nj}) THEN -1 WHEN (({scan}) & 32) <> 0 THEN {si} * ({nj}) + {back_j} ELSE {sj} * ({ni}) + {back_i} END)"


def natural_ij(off: str, ni: str, nj: str, scan: str) -> tuple[str, str]:
    """(i, j) in natural order of the value at a place in storage; the inverse of storage_offset."""
    column = f"((({scan}) & 32) <> 0)"
    major, minor = f"CAST(floor(({off}) / (CASE WHEN {column} THEN ({nj}) ELSE ({ni}) END)) AS INT)", f"CAST(({off}) % (CASE WHEN {column} THEN ({nj}) ELSE ({ni}) END) AS INT)"
    size = f"(CASE WHEN {column} THEN ({nj}) ELSE ({ni}) END)"
    turned = f"(CASE WHEN (({scan}) & 16) <> 0 AND {major} % 2 = 1 THEN {size} - 1 - {minor} ELSE {minor} END)"
    si, sj = f"(CASE WHEN {column} THEN {major} ELSE {turned} END)", f"(CASE WHEN {column} THEN {turned} ELSE {major} END)"
    return f"(CASE WHEN (({scan}) & 128) <> 0 THEN ({ni}) - 1 - {si} ELSE {si} END)", f"(CASE WHEN (({scan}) & 64) <> 0 THEN ({nj}) - 1 - {sj} ELSE {sj} END)"


# --- regular latitude and longitude


def latlon_bounds(la1: str, lo1: str, la2: str, lo2: str, scan: str) -> tuple[str, str, str, str]:
    """(south, west, north, east) of a grid from its first and last stored point; east is at least west."""
    west = f"(CASE WHEN (({scan}) & 128) <> 0 THEN ({lo2}) ELSE ({lo1}) END)"
    east = f"(CASE WHEN (({scan}) & 128) <> 0 THEN ({lo1}) ELSE ({lo2}) END)"
    return (
        f"(CASE WHEN ({la1}) < ({la2}) THEN ({la1}) ELSE ({la2}) END)", west,
        f"(CASE WHEN ({la1}) < ({la2}) THEN ({la2}) ELSE ({la1}) END)", f"(CASE WHEN {east} < {west} THEN {east} + 360 ELSE {east} END)",
    )


def locate_latlon(lat: str, lon: str, north: str, west: str, south: str, east: str, di: str, dj: str, ni: str, nj: str, cyclic: bool = False) -> tuple[str, str]:
    """(fi, fj) of a point, null outside; 1e-9 beyond an edge counts as on it. cyclic: the grid goes round the globe."""
    x = wrap360(lon, west)
    outside = f"({lat}) > ({north}) + 1e-9 OR ({lat}) < ({south}) - 1e-9" + ("" if cyclic else f" OR {x} > ({east}) + 1e-9")
    fi = f"({x} - ({west})) / ({di})"
    fj = f"(({north}) - ({lat})) / ({dj})"
    fi = fi if cyclic else clamp(fi, "0e0", f"({ni}) - 1e0")
    return f"(CASE WHEN {outside} THEN NULL ELSE {fi} END)", f"(CASE WHEN {outside} THEN NULL ELSE {clamp(fj, '0e0', f'({nj}) - 1e0')} END)"


def rotated(lat: str, lon: str, pole_lat: str, pole_lon: str, angle: str = "0e0") -> tuple[str, str]:
    """(lat, lon) in a frame whose south pole lies at the given point; the frame's centre has longitude 0 before the angle is added."""
    d = f"radians(({lon}) - ({pole_lon}))"
    p, f = f"radians({pole_lat})", f"radians({lat})"
    sin_lat = clamp(f"-sin({p}) * sin({f}) - cos({p}) * cos({f}) * cos({d})", "-1e0", "1e0")
    east = f"cos({f}) * sin({d})"
    ahead = f"cos({p}) * sin({f}) - sin({p}) * cos({f}) * cos({d})"
    return f"degrees(asin({sin_lat}))", f"(degrees(atan2({east}, {ahead})) + ({angle}))"


def stretched(lat: str, lon: str, pole_lat: str, pole_lon: str, factor: str) -> tuple[str, str]:
    """(lat, lon) after turning the stretching pole to 90 north and stretching latitudes by the factor; null if it isn't positive."""
    d, p, f = f"radians(({lon}) - ({pole_lon}))", f"radians({pole_lat})", f"radians({lat})"
    s = clamp(f"sin({f}) * sin({p}) + cos({f}) * cos({p}) * cos({d})", "-1e0", "1e0")
    c2 = f"(({factor}) * ({factor}))"
    t = clamp(f"((1 - {c2}) + (1 + {c2}) * {s}) / ((1 + {c2}) + (1 - {c2}) * {s})", "-1e0", "1e0")
    east, ahead = f"cos({f}) * sin({d})", f"sin({p}) * cos({f}) * cos({d}) - cos({p}) * sin({f})"
    return f"(CASE WHEN ({factor}) > 0 THEN degrees(asin({t})) END)", f"(CASE WHEN ({factor}) > 0 THEN degrees(atan2({east}, {ahead})) END)"


# --- projections. Origins are the north-west corner: the first stored point moved by whole cells where rows or columns run the other way.


def _mercator_y(lat: str) -> str:
    return f"ln(tan(pi() / 4 + radians({lat}) / 2))"


def _placed(x: str, y: str, x0: str, y0: str, dx: str, dy: str, nx: str, ny: str, scan: str, more: str = "") -> tuple[str, str]:
    """(fi, fj) from projected metres; null if more than half a cell outside."""
    fi = f"((({x}) - ({x0})) / ({dx}) + (CASE WHEN (({scan}) & 128) <> 0 THEN ({nx}) - 1 ELSE 0 END))"
    fj = f"((({y0}) - ({y})) / ({dy}) + (CASE WHEN (({scan}) & 64) <> 0 THEN ({ny}) - 1 ELSE 0 END))"
    inside = f"{fi} >= -5e-1 AND {fi} <= ({nx}) - 5e-1 AND {fj} >= -5e-1 AND {fj} <= ({ny}) - 5e-1{more}"
    return f"(CASE WHEN {inside} THEN {fi} END)", f"(CASE WHEN {inside} THEN {fj} END)"


def locate_mercator(lat: str, lon: str, la1: str, lo1: str, lad: str, dx: str, dy: str, nx: str, ny: str, scan: str, radius: str = f"{RADIUS:.1f}e0") -> tuple[str, str]:
    """(fi, fj) on a Mercator grid, true to scale at lad."""
    r = f"(({radius}) * cos(radians({lad})))"
    return _placed(f"{r} * radians({wrap180(f'({lon}) - ({lo1})')})", f"{r} * {_mercator_y(lat)}", "0e0", f"{r} * {_mercator_y(la1)}", dx, dy, nx, ny, scan)


def locate_polar(lat: str, lon: str, la1: str, lo1: str, lad: str, lov: str, dx: str, dy: str, nx: str, ny: str, scan: str, south: bool = False, radius: str = f"{RADIUS:.1f}e0") -> tuple[str, str]:
    """(fi, fj) on a polar stereographic grid whose columns are parallel to the meridian lov; points far in the other hemisphere are outside."""
    sign = "-1e0" if south else "1e0"
    k = f"(({radius}) * (1 + sin(abs(radians({lad})))))"
    r = lambda a: f"{k} * tan(pi() / 4 - {sign} * radians({a}) / 2)"
    x = lambda a, o: f"{r(a)} * sin(radians(({o}) - ({lov})))"
    y = lambda a, o: f"-{sign} * {r(a)} * cos(radians(({o}) - ({lov})))"
    return _placed(x(lat, lon), y(lat, lon), x(la1, lo1), y(la1, lo1), dx, dy, nx, ny, scan, f" AND {sign} * ({lat}) >= -10")


def cone(latin1: float, latin2: float) -> tuple[float, float]:
    """(n, F) of the Lambert cone through one or two standard parallels."""
    import math

    a, b = math.radians(latin1), math.radians(latin2)
    half = lambda t: math.tan(math.pi / 4 + t / 2)
    n = math.sin(a) if abs(a - b) < 1e-12 else math.log(math.cos(a) / math.cos(b)) / math.log(half(b) / half(a))
    return n, math.cos(a) * half(a) ** n / n


def locate_lambert(lat: str, lon: str, la1: str, lo1: str, lov: str, latin1: float, latin2: float, dx: str, dy: str, nx: str, ny: str, scan: str, radius: str = f"{RADIUS:.1f}e0") -> tuple[str, str]:
    """(fi, fj) on a Lambert conformal grid."""
    n, f = cone(latin1, latin2)
    rho = lambda a: f"({radius}) * {f!r}e0 * pow(tan(pi() / 4 + radians(greatest({a}, -89999e-3)) / 2), -{n!r}e0)"
    turn = lambda o: f"radians({n!r}e0 * {wrap180(f'({o}) - ({lov})')})"
    x = lambda a, o: f"{rho(a)} * sin({turn(o)})"
    y = lambda a, o: f"-({rho(a)}) * cos({turn(o)})"
    return _placed(x(lat, lon), y(lat, lon), x(la1, lo1), y(la1, lo1), dx, dy, nx, ny, scan)


# --- the earth


def effective_radius(shape: str, radius: str, major: str, minor: str) -> str:
    """The radius (m) used for a shape code: the sphere's own, or that of the sphere with the ellipsoid's surface. Fixed values by code."""
    ball = f"(CASE {shape} WHEN 0 THEN 6367470e0 WHEN 1 THEN {radius} WHEN 6 THEN 6371229e0 WHEN 8 THEN 6371200e0 WHEN 11 THEN 695990000e0 END)"
    axis = lambda own, v: f"(CASE WHEN {shape} = 2 THEN {v[0]} WHEN {shape} IN (4, 5, 10) THEN {v[1]} WHEN {shape} = 9 THEN {v[2]} WHEN {shape} IN (3, 7) THEN {own} END)"
    a, b = axis(major, ("6378160e0", "6378137e0", "6377563.396e0")), axis(minor, ("6356775e0", "6356752.314245e0", "6356256.909e0"))
    long, short = f"greatest({a}, {b})", f"least({a}, {b})"
    e2 = f"(1 - ({short} * {short}) / ({long} * {long}))"
    e = f"sqrt({e2})"
    same_surface = f"{long} * sqrt(5e-1 * (1 + (1 - {e2}) * (5e-1 * ln((1 + {e}) / (1 - {e}))) / {e}))"
    return f"(CASE WHEN {ball} > 0 THEN {ball} WHEN {a} > 0 AND {b} > 0 THEN (CASE WHEN {a} = {b} THEN {a} ELSE {same_surface} END) ELSE 6371229e0 END)"


def unit_vector(lat: str, lon: str) -> tuple[str, str, str]:
    return f"(cos(radians({lat})) * cos(radians({lon})))", f"(cos(radians({lat})) * sin(radians({lon})))", f"sin(radians({lat}))"


def chord2(metres: str, radius: str = f"{RADIUS:.1f}e0") -> str:
    """The squared chord on the unit sphere of an arc in metres."""
    return f"(2 * sin(({metres}) / (2 * {radius})) * (2 * sin(({metres}) / (2 * {radius}))))"


def bucket(lat: str, lon: str, n_lat: str) -> tuple[str, str]:
    """The latitude and longitude bucket of a point, with n_lat rows from the north and twice as many columns from 180 west."""
    row = clamp(f"floor((90 - ({lat})) * ({n_lat}) / 180)", "0", f"({n_lat}) - 1")
    column = clamp(f"floor({wrap360(f'({lon}) + 180')} * (2 * ({n_lat})) / 360)", "0", f"2 * ({n_lat}) - 1")
    return f"CAST({row} AS INT)", f"CAST({column} AS INT)"


# --- tiles


def mercator_lat(y: str) -> str:
    """The latitude at a share y of the way from the north edge of the square web map to its south edge."""
    t = f"(pi() - 2 * pi() * ({y}))"
    return f"degrees(atan(5e-1 * (exp({t}) - exp(-{t}))))"


def tile_bounds(z: str, x: str, y: str) -> tuple[str, str, str, str]:
    """(south, west, north, east) of a map tile."""
    n = f"pow(2e0, {z})"
    return mercator_lat(f"(({y}) + 1) / {n}"), f"(({x}) / {n} * 360 - 180)", mercator_lat(f"({y}) / {n}"), f"((({x}) + 1) / {n} * 360 - 180)"


# --- sampling kernels and output types


def cubic_weight(t: str) -> str:
    """The Catmull-Rom weight at a distance."""
    a = f"abs({t})"
    return f"(CASE WHEN {a} < 1 THEN ((15e-1 * {a} - 25e-1) * {a}) * {a} + 1 WHEN {a} < 2 THEN ((-5e-1 * {a} + 25e-1) * {a} - 4) * {a} + 2 ELSE 0e0 END)"


#: Name: least and greatest value.
INTEGERS = {f"{'u' * u}int{b}": (0, 2**b - 1) if u else (-(2 ** (b - 1)), 2 ** (b - 1) - 1) for u in (0, 1) for b in (8, 16, 32, 64)}
_HOLDS = {"int8": "TINYINT", "int16": "SMALLINT", "int32": "INT", "int64": "BIGINT", "uint8": "SMALLINT", "uint16": "INT", "uint32": "BIGINT", "uint64": "DECIMAL(20,0)"}


def quantized(v: str, kind: str, scale: float, offset: float, missing: int, low: float = 0.0, high: float = 0.0) -> str:
    """round((v - offset) * scale) held to [low, high] (both 0: the type's bounds) and saturated; null gives `missing`, wrapped into the type."""
    least, most = INTEGERS[kind]
    size = most - least + 1
    sentinel = (missing - least) % size + least
    raw = f"((({v}) - {offset:.17e}) * {scale:.17e})"
    x = f"(CASE WHEN abs({raw}) >= 4503599627370496e0 THEN {raw} ELSE CAST({half_up(raw)} AS DOUBLE) END)"  # from 2^52 on doubles are whole
    held = x if low == high == 0 else clamp(x, f"{low:.17e}", f"{high:.17e}")
    to = _HOLDS[kind]
    whole = f"CAST({held} AS {to})"
    if kind == "uint64":  # a decimal of a double has its printed digits; two halves of 32 bits have all
        high = f"floor({held} / 4294967296e0)"
        whole = f"CAST(CAST(CAST({high} AS BIGINT) AS DECIMAL(20,0)) * 4294967296 + CAST({held} - {high} * 4294967296e0 AS BIGINT) AS DECIMAL(20,0))"
    return f"(CASE WHEN ({v}) IS NULL THEN CAST({sentinel} AS {to}) WHEN {held} >= {float(most):.17e} THEN CAST({most} AS {to}) WHEN {held} <= {float(least):.17e} THEN CAST({least} AS {to}) ELSE {whole} END)"
