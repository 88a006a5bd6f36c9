"""Where points lie on the grids of messages: arrays of latitudes and longitudes to columns and rows of the field in natural order.

The numpy counterpart of functions/geometry.py, for fields held as arrays. A
grid is a mapping of the header columns of grib.read (grid_template and what
its template has). Columns fx and rows fy are NaN outside the grid.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import lru_cache

import numpy as np

from ..functions.geometry import RADIUS
from ..sources.errors import Unsupported
from . import gaussian

#: Header columns that describe a grid.
COLUMNS = (
    "grid_template ni nj la1 lo1 la2 lo2 di dj scan pole_lat pole_lon angle lad lov latin1 latin2 south gaussian_n stretch_lat stretch_lon stretch shape radius major minor widths"
).split()
#: Templates whose columns depend on longitude and rows on latitude alone, unless rows differ in width.
PLAIN = (0, 10, 40)
GAUSSIAN = (40, 41, 42, 43)
KNOWN = (0, 1, 10, 20, 30, *GAUSSIAN, 50)
#: Axes (m) of the fixed shapes of the earth by code, and codes whose axes a message gives (fixed values).
BALLS = {0: 6367470.0, 6: 6371229.0, 8: 6371200.0, 11: 695990000.0}
AXES = {2: (6378160.0, 6356775.0), 4: (6378137.0, 6356752.314245), 5: (6378137.0, 6356752.314245), 10: (6378137.0, 6356752.314245), 9: (6377563.396, 6356256.909)}

Grid = Mapping[str, object]
Places = tuple[np.ndarray, np.ndarray]


def earth_radius(grid: Grid) -> float:
    """The radius (m) of the sphere, or of the sphere with the ellipsoid's surface."""
    shape = grid.get("shape")
    ball = grid.get("radius") if shape == 1 else BALLS.get(shape)
    if ball:
        return ball
    axes = (grid.get("major"), grid.get("minor")) if shape in (3, 7) else AXES.get(shape)
    if not axes or not all(a and a > 0 for a in axes):
        return RADIUS
    long, short = max(axes), min(axes)
    if long == short:
        return long
    e = np.sqrt(1 - (short / long) ** 2)
    return float(long * np.sqrt(0.5 * (1 + (1 - e * e) * np.arctanh(e) / e)))


def check(grid: Grid) -> None:
    """Raises Unsupported for grids that points can't be placed on here."""
    template = grid.get("grid_template") or 0
    if template == 101:
        raise Unsupported("unstructured grids are rendered by meshes.nearest_cells and fields.with_tiles, which take the cells' coordinates")
    if template not in KNOWN:
        raise Unsupported(f"grid template {template}")


def separable(grid: Grid) -> bool:
    return (grid.get("grid_template") or 0) in PLAIN and not grid.get("widths")


def axes(grid: Grid, lat: np.ndarray, lon: np.ndarray) -> Places:
    """(fx of longitudes, fy of latitudes) on a separable grid, each found beside a point that is inside by the other axis."""
    inside = _gaussian_rows(grid)[0][int(grid["nj"]) // 2] if grid.get("grid_template") == 40 else grid["la1"]
    return locate(grid, inside, lon)[0], locate(grid, lat, grid["lo1"])[1]


def locate(grid: Grid, lat: np.ndarray, lon: np.ndarray) -> Places:
    """(fx, fy) of points; lat and lon may be arrays that are broadcast to a common shape."""
    check(grid)
    template = grid.get("grid_template") or 0
    lat, lon = np.broadcast_arrays(np.asarray(lat, float), np.asarray(lon, float))
    if template == 50:  # coefficients have no place
        return np.full(lat.shape, np.nan), np.full(lat.shape, np.nan)
    if template in (1, 41, 43):
        lat, lon = rotated(lat, lon, grid["pole_lat"], grid["pole_lon"], grid["angle"])
    if template in (42, 43):
        lat, lon = stretched(lat, lon, grid["stretch_lat"], grid["stretch_lon"], grid["stretch"])
    if template in GAUSSIAN:
        return _on_gaussian(grid, lat, lon)
    if template in (0, 1):
        return _on_latlon(grid, lat, lon, centred=template == 1)
    return _on_projection(grid, lat, lon)


def rotated(lat: np.ndarray, lon: np.ndarray, pole_lat: float, pole_lon: float, angle: float) -> Places:
    """(lat, lon) in a frame whose south pole lies at the given point."""
    p, f, d = np.radians(pole_lat), np.radians(lat), np.radians(lon - pole_lon)
    sin = np.clip(-np.sin(p) * np.sin(f) - np.cos(p) * np.cos(f) * np.cos(d), -1, 1)
    ahead = np.cos(p) * np.sin(f) - np.sin(p) * np.cos(f) * np.cos(d)
    return np.degrees(np.arcsin(sin)), np.degrees(np.arctan2(np.cos(f) * np.sin(d), ahead)) + angle


def stretched(lat: np.ndarray, lon: np.ndarray, pole_lat: float, pole_lon: float, factor: float) -> Places:
    """(lat, lon) with the stretching pole turned to 90 north and latitudes stretched; NaN for a factor that isn't positive."""
    if not factor or not factor > 0:
        return np.full(lat.shape, np.nan), np.full(lat.shape, np.nan)
    p, f, d, c2 = np.radians(pole_lat), np.radians(lat), np.radians(lon - pole_lon), factor * factor
    s = np.clip(np.sin(f) * np.sin(p) + np.cos(f) * np.cos(p) * np.cos(d), -1, 1)
    t = np.clip(((1 - c2) + (1 + c2) * s) / ((1 + c2) + (1 - c2) * s), -1, 1)
    return np.degrees(np.arcsin(t)), np.degrees(np.arctan2(np.cos(f) * np.sin(d), np.sin(p) * np.cos(f) * np.cos(d) - np.cos(p) * np.sin(f)))


def _on_latlon(grid: Grid, lat: np.ndarray, lon: np.ndarray, centred: bool) -> Places:
    la1, lo1, la2, lo2, scan, ni, nj = (grid[k] for k in ("la1", "lo1", "la2", "lo2", "scan", "ni", "nj"))
    west, east = (lo2, lo1) if scan & 128 else (lo1, lo2)
    east += 360 * (east < west)
    x = lon - 360 * np.floor((lon - west) / 360)
    if centred:  # a frame's longitudes come from an arc tangent, so a point on the west edge may lie just under it
        x = np.where((x > east + 1e-9) & (x - 360 >= west - 1e-9), x - 360, x)
    north, south = max(la1, la2), min(la1, la2)
    di = grid["di"] or (east - west) / max(ni - 1, 1)
    dj = grid["dj"] or (north - south) / max(nj - 1, 1)
    out = (x > east + 1e-9) | (lat > north + 1e-9) | (lat < south - 1e-9) | np.isnan(x) | np.isnan(lat)
    place = lambda v, step, n: np.where(out, np.nan, np.clip(v / step if step else np.zeros(v.shape), 0, n - 1))
    return place(x - west, di, ni), place(north - lat, dj, nj)


def _on_gaussian(grid: Grid, lat: np.ndarray, lon: np.ndarray) -> Places:
    lats, first, step, last = _gaussian_rows(grid)
    if not len(lats):
        return np.full(lat.shape, np.nan), np.full(lat.shape, np.nan)
    up = -lats
    below = np.clip(np.searchsorted(up, -lat, "left"), 1, max(len(lats) - 1, 1))  # the first row at or south of the point
    if len(lats) == 1:
        fy = np.zeros(lat.shape)
    else:
        a, b = lats[below - 1], lats[below]
        fy = np.clip(below - 1 + (a - lat) / (a - b), 0, len(lats) - 1)
    out = (lat > lats[0] + 1e-9) | (lat < lats[-1] - 1e-9) | np.isnan(lat) | np.isnan(lon)
    row = np.where(out, 0, np.floor(fy + 0.5)).astype(np.int64)
    west, di, east = first[row], step[row], last[row]
    x = lon - 360 * np.floor((lon - west) / 360)
    single = di == 0
    fx = (x - west) / np.where(single, 1, di)
    around = np.isinf(east)
    width = np.round(360 / np.where(single, 360, di))
    fx = np.where(around & (fx >= width), fx - width, fx)
    out |= ~around & (x > east + 1e-9) | single & (np.abs(x - west) > 1e-9) & (np.abs(x - west - 360) > 1e-9)
    fx = np.where(single, 0, fx)
    return np.where(out, np.nan, fx), np.where(out, np.nan, fy)


def _gaussian_rows(grid: Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return rows_of(int(grid["gaussian_n"] or 0), int(grid["nj"]), grid["la1"], grid["la2"], grid["lo1"], grid["lo2"], grid.get("di"), grid["scan"], grid["ni"], tuple(grid.get("widths") or ()))


@lru_cache(64)
def rows_of(n: int, nj: int, la1: float, la2: float, lo1: float, lo2: float, di: float | None, scan: int, ni: int | None, widths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of a Gaussian grid, from north: latitude, first longitude, step (0: a single column) and last longitude (infinite: around the globe)."""
    lats = np.array(gaussian.regional(n, nj, max(la1, la2)))
    width = np.array(widths or [ni or 0] * nj, float)[: len(lats)]
    west, east = (lo2, lo1) if scan & 128 else (lo1, lo2)
    while east < west:
        east += 360
    first, step, last = gaussian.layout(width, west, east, di)
    return lats, first, step, last


def _on_projection(grid: Grid, lat: np.ndarray, lon: np.ndarray) -> Places:
    template, scan, ni, nj = (grid[k] for k in ("grid_template", "scan", "ni", "nj"))
    r = earth_radius(grid)
    turn = lambda o: o - 360 * np.floor((o + 180) / 360)
    if template == 10:
        y = lambda a: np.log(np.tan(np.pi / 4 + np.radians(a) / 2))
        k = r * np.cos(np.radians(grid["lad"]))
        with np.errstate(divide="ignore", invalid="ignore"):
            project = lambda a, o: (k * np.radians(turn(o - grid["lo1"])), k * y(a))
            return _cells(project, grid, lat, lon, ni, nj, scan)
    if template == 20:
        sign = -1.0 if grid["south"] else 1.0
        k = r * (1 + np.sin(abs(np.radians(grid["lad"]))))

        def polar(a: np.ndarray, o: np.ndarray) -> Places:
            rho, d = k * np.tan(np.pi / 4 - sign * np.radians(a) / 2), np.radians(o - grid["lov"])
            return rho * np.sin(d), -sign * rho * np.cos(d)

        fx, fy = _cells(polar, grid, lat, lon, ni, nj, scan)
        far = sign * lat < -10
        return np.where(far, np.nan, fx), np.where(far, np.nan, fy)
    from ..functions.geometry import cone

    n, f = cone(grid["latin1"], grid["latin2"])

    def conic(a: np.ndarray, o: np.ndarray) -> Places:
        rho = r * f * np.tan(np.pi / 4 + np.radians(np.maximum(a, -89.999)) / 2) ** -n
        d = np.radians(n * turn(o - grid["lov"]))
        return rho * np.sin(d), -rho * np.cos(d)

    return _cells(conic, grid, lat, lon, ni, nj, scan)


def _cells(project, grid: Grid, lat: np.ndarray, lon: np.ndarray, ni: int, nj: int, scan: int) -> Places:
    """Places from projected metres; NaN if more than half a cell outside."""
    x, y = project(lat, lon)
    x0, y0 = project(np.float64(grid["la1"]), np.float64(grid["lo1"]))
    with np.errstate(invalid="ignore", divide="ignore"):
        fx = (x - x0) / grid["di"] + (ni - 1) * bool(scan & 128)
        fy = (y0 - y) / grid["dj"] + (nj - 1) * bool(scan & 64)
        inside = (fx >= -0.5) & (fx <= ni - 0.5) & (fy >= -0.5) & (fy <= nj - 0.5)
    return np.where(inside, fx, np.nan), np.where(inside, fy, np.nan)


def natural(values: np.ndarray, grid: Grid) -> np.ndarray:
    """A stored field as rows from the north, west to east. Rows that differ in width are filled up with NaN; so is a reduced grid stored by columns, whose order isn't defined."""
    scan, widths = grid.get("scan") or 0, grid.get("widths")
    if not len(widths if widths is not None else ()):
        if (grid.get("grid_template") or 0) in (50, 101):
            return values[None]
        ni, nj = int(grid["ni"]), int(grid["nj"])
        field = values.reshape((ni, nj) if scan & 32 else (nj, ni))
        if scan & 16:
            field = field.copy()
            field[1::2] = field[1::2, ::-1]
        if scan & 32:
            field = field.T
        if scan & 128:
            field = field[:, ::-1]
        return field[::-1] if scan & 64 else field
    width = np.asarray(widths, np.int64)
    out = np.full((len(width), int(width.max(initial=0))), np.nan)
    if scan & 32:
        return out
    stored = width[::-1] if scan & 64 else width
    row = np.repeat(np.arange(len(stored)), stored)
    place = np.arange(int(stored.sum())) - np.repeat(np.cumsum(stored) - stored, stored)
    back = np.full(len(row), bool(scan & 128)) ^ ((row % 2 == 1) & bool(scan & 16))
    place = np.where(back, stored[row] - 1 - place, place)
    out[len(stored) - 1 - row if scan & 64 else row, place] = values[: len(row)]
    return out


def corner(grid: Grid) -> dict[str, float] | None:
    """The north-west point, signed steps and size of a regular latitude-longitude grid in natural order; None for others."""
    if (grid.get("grid_template") or 0) != 0:
        return None
    scan, ni, nj, di, dj = (grid[k] for k in ("scan", "ni", "nj", "di", "dj"))
    return {"nx": ni, "ny": nj, "lat0": grid["la1"] + (nj - 1) * dj * bool(scan & 64), "lon0": grid["lo1"] - (ni - 1) * di * bool(scan & 128), "dlat": -dj, "dlon": di}
