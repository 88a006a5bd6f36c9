"""Rendering of whole fields held as arrays: a row for each field and tile or set of points, numpy inside Arrow batches.

The joins of sampling.py suit scattered points and fields too large for one
array; for dense tiles (65,536 pixels of 16 taps each) this path moves one array
for each tile instead of a million rows. Both give the same values. All grids
that `places` knows are rendered; on others Unsupported is raised.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.pieces import pieces
from . import places

HOW = ("nearest", "bicubic", "mode")


def pixel_centres(z: int, x: int, y: int, w: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    """(latitudes of rows, longitudes of columns) of a map tile."""
    n = 2.0**z
    t = np.pi * (1 - 2 * (y + (np.arange(h) + 0.5) / h) / n)
    return np.degrees(np.arctan(np.sinh(t))), x / n * 360 - 180 + 360 / n * (np.arange(w) + 0.5) / w


def _nearest(x: np.ndarray) -> np.ndarray:
    return (np.sign(x) * np.floor(np.abs(x) + 0.5)).astype(np.int64)


def _at(field: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """field[rows x columns], NaN outside."""
    nj, ni = field.shape
    out = field[np.clip(rows, 0, nj - 1)[:, None], np.clip(columns, 0, ni - 1)[None]]
    out[(rows < 0) | (rows >= nj)] = np.nan
    out[:, (columns < 0) | (columns >= ni)] = np.nan
    return out


def _weights(d: np.ndarray) -> list[np.ndarray]:
    def w(t: np.ndarray) -> np.ndarray:
        a = np.abs(t)
        return np.where(a < 1, ((1.5 * a - 2.5) * a) * a + 1, np.where(a < 2, ((-0.5 * a + 2.5) * a - 4) * a + 2, 0.0))

    return [w(1 + d), w(d), w(1 - d), w(2 - d)]


def sampled(field: np.ndarray, fx: np.ndarray, fy: np.ndarray, how: str) -> np.ndarray:
    """A grid of samples at columns fx and rows fy (NaN: outside), nearest or bicubic."""
    ok_x, ok_y = ~np.isnan(fx), ~np.isnan(fy)
    x, y = np.where(ok_x, fx, -9), np.where(ok_y, fy, -9)
    near = _at(field, _nearest(y), _nearest(x))
    if how != "bicubic":
        return near
    a, b = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    wx, wy = _weights(x - a), _weights(y - b)
    # the kernel is a product: the four rows are gathered and weighed once for the columns in sight, then the columns
    left, right = (max(int(a[ok_x].min()) - 1, 0), min(int(a[ok_x].max()) + 3, field.shape[1])) if ok_x.any() else (0, 0)
    if left >= right or not ok_y.any():
        return near
    sight = np.arange(left, right)
    down = sum(_at(field, b - 1 + k, sight) * wy[k][:, None] for k in range(4))  # NaN where any of the four rows is missing
    out = sum(_columns(down, a - 1 + k - left) * wx[k][None] for k in range(4)) / (sum(wy)[:, None] * sum(wx)[None])
    return np.where(np.isnan(out), near, out)


def _columns(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = rows[:, np.clip(at, 0, rows.shape[1] - 1)]
    out[:, (at < 0) | (at >= rows.shape[1])] = np.nan
    return out


def sampled_at(field: np.ndarray, fx: np.ndarray, fy: np.ndarray, how: str, half: int = 1) -> np.ndarray:
    """Samples at places (fx, fy) of any shape, NaN outside; half: the reach of the mode's window, at least 1."""
    shape, nj, ni = fx.shape, *field.shape
    x, y = np.where(np.isnan(fx), -9e6, fx).reshape(-1), np.where(np.isnan(fy), -9e6, fy).reshape(-1)

    def at(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        got = field[np.clip(j, 0, nj - 1), np.clip(i, 0, ni - 1)]
        return np.where((i >= 0) & (i < ni) & (j >= 0) & (j < nj), got, np.nan)

    if how == "mode":
        return _commonest(at, _nearest(x), _nearest(y), max(half, 1)).reshape(shape)
    near = at(_nearest(x), _nearest(y))
    if how != "bicubic":
        return near.reshape(shape)
    a, b = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    wx, wy = _weights(x - a), _weights(y - b)
    total = sum(at(a - 1 + i, b - 1 + j) * (wx[i] * wy[j]) for j in range(4) for i in range(4)) / (sum(wx) * sum(wy))
    return np.where(np.isnan(total), near, total).reshape(shape)


def _commonest(at, i: np.ndarray, j: np.ndarray, half: int) -> np.ndarray:
    """The commonest value of the windows around cells, of equally common ones the least; NaN counts for nothing."""
    out = np.empty(len(i))
    side = np.arange(-half, half + 1)
    for a in range(0, len(i), 1 << 14):
        k = slice(a, a + (1 << 14))
        taps = np.sort(np.stack([at(i[k] + dx, j[k] + dy) for dy in side for dx in side]), axis=0)  # NaN last
        run = np.zeros(taps.shape, np.int32)
        for t in range(1, len(taps)):
            run[t] = np.where(taps[t] == taps[t - 1], run[t - 1] + 1, 0)
        run[np.isnan(taps)] = -1
        out[k] = np.take_along_axis(taps, run.argmax(axis=0)[None], axis=0)[0]
    return out


def _key(grid: places.Grid) -> tuple:
    """The grid as a key: equal grids share what is known of a tile."""
    return tuple((k, tuple(v) if isinstance(v, (list, np.ndarray)) else v) for k in places.COLUMNS if (v := grid.get(k)) is not None)


@lru_cache(32)
def _tile_places(key: tuple, z: int, x: int, y: int, w: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a tile's pixels lie: columns and rows of the field, by axes where the grid allows it."""
    grid = dict.fromkeys(places.COLUMNS) | dict(key)
    lats, lons = pixel_centres(z, x, y, w, h)
    if not places.separable(grid):
        return places.locate(grid, lats[:, None], lons[None])
    return places.axes(grid, lats, lons)


def tile(field: np.ndarray, grid: places.Grid, z: int, x: int, y: int, w: int, h: int, how: str, half: int = 1) -> np.ndarray:
    """The pixels, row by row, of a tile of a field in natural order."""
    w, h = w or 256, h or 256
    fx, fy = _tile_places(_key(grid), z, x, y, w, h)
    if fx.ndim == 1 and how != "mode":
        return sampled(field, fx, fy, how).reshape(-1)
    if fx.ndim == 1:
        fx, fy = np.broadcast_to(fx[None], (h, w)), np.broadcast_to(fy[:, None], (h, w))
        out = np.isnan(fx) | np.isnan(fy)
        fx, fy = np.where(out, np.nan, fx), np.where(out, np.nan, fy)
    return sampled_at(field, fx, fy, how, half).reshape(-1)


def _described(fields: DataFrame) -> list[str]:
    return [c for c in places.COLUMNS if c in fields.columns]


def _rows(batch: pa.RecordBatch, names: list[str], skip: int) -> Iterator[tuple[dict, np.ndarray]]:
    """The described columns of each row, and its field in natural order; the values come last."""
    columns = [batch.column(skip + k).to_pylist() for k in range(len(names))]
    values = batch.column(skip + len(names))
    for k in range(batch.num_rows):
        row = {n: c[k] for n, c in zip(names, columns, strict=True)}
        places.check(row)
        yield row, places.natural(np.asarray(values[k].values, np.float64), row)


def rendered(fields: DataFrame, keys: list[str], how: str = "bicubic", half: int = 1) -> DataFrame:
    """(keys, z, x, y, pixels): the pixels, row by row, of tiles of fields; NaN where there is no value.

    fields: keys, z, x, y, w, h, the field's header columns (those of
    places.COLUMNS that its grid has; without grid_template a regular
    latitude-longitude grid) and values; one row for each field and tile.
    """
    kinds = ", ".join(f"`{k}` {fields.schema[k].dataType.simpleString()}" for k in keys)
    names = ["z", "x", "y", "w", "h", *_described(fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels = [tile(field, r, r["z"], r["x"], r["y"], r["w"], r["h"], how, half) for r, field in _rows(batch, names, len(keys))]
            out = [batch.column(k) for k in range(len(keys))] + [batch.column(len(keys) + k).cast(pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(pixels, pa.list_(pa.float64()))], [*keys, "z", "x", "y", "pixels"])

    return fields.select(*keys, *names, "values").mapInArrow(run, f"{kinds}, z int, x int, y int, pixels array<double>")


def values_at(fields: DataFrame, keys: list[str], points: list[tuple[int, float, float]], how: str = "nearest", half: int = 1, most_points: int = 1_000_000) -> DataFrame:
    """(keys, id, in_grid, value): the value of every field at each of the stated points (id, lat, lon), NaN where it is missing; in_grid tells points outside. More than most_points are refused: look those up with sampling.py's joins."""
    if len(points) > most_points:
        raise ValueError(f"more than {most_points} points")
    kinds = ", ".join(f"`{k}` {fields.schema[k].dataType.simpleString()}" for k in keys)
    names = _described(fields)
    ids, lat, lon = (np.array([p[k] for p in points], kind) for k, kind in enumerate((np.int64, float, float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, (r, field) in enumerate(_rows(batch, names, len(keys))):
                fx, fy = places.locate(r, lat, lon)
                each = [batch.column(k).slice(n, 1).take(pa.array(np.zeros(len(ids), np.int64))) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*each, pa.array(ids), pa.array(~np.isnan(fx)), pa.array(sampled_at(field, fx, fy, how, half))], [*keys, "id", "in_grid", "value"])

    return fields.select(*keys, *names, "values").mapInArrow(run, f"{kinds}, id long, in_grid boolean, value double")


def in_natural_order(fields: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, nx, ny, natural): the values as rows from the north, west to east, rows of reduced grids filled up with NaN."""
    kinds = ", ".join(f"`{k}` {fields.schema[k].dataType.simpleString()}" for k in keys)
    names = _described(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, len(keys) + len(names))):
            found = [field for _, field in _rows(batch, names, len(keys))]
            sizes = [pa.array([f.shape[k] for f in found], pa.int64()) for k in (1, 0)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), *sizes, pa.array([f.reshape(-1) for f in found], pa.list_(pa.float64()))], [*keys, "nx", "ny", "natural"])

    return fields.select(*keys, *names, "values").mapInArrow(run, f"{kinds}, nx long, ny long, natural array<double>")


def rendered_files(files: DataFrame, tiles: list[tuple[int, int, int]], how: str = "bicubic", size: int = 256, most_tiles: int = 100_000, mode: str = "FAILFAST", half: int = 1) -> DataFrame:
    """(file, file_offset, field_no, z, x, y, pixels): the same tiles of every field of files (path, content).

    Decoding and rendering happen in one task, so only pixels leave it. tiles is
    the stated set of requests, refused above most_tiles. Fields that can't be
    rendered raise, or are left out if mode is DROPMALFORMED.
    """
    from ..sources import messages
    from ..sources.errors import Unsupported

    if len(tiles) > most_tiles:
        raise ValueError(f"more than {most_tiles} tiles")
    schema = "file string, file_offset long, field_no int, z int, x int, y int, pixels array<double>"
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
    names = ["file", "file_offset", "field_no", "z", "x", "y", "pixels"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for r in messages.rows(path, content.as_py(), True, mode):
                    try:
                        places.check(r)
                    except Unsupported:
                        if mode != "DROPMALFORMED":
                            raise
                        continue
                    field = places.natural(r["values"], r)
                    for a in range(0, len(tiles), 16):
                        part = tiles[a : a + 16]
                        pixels = [tile(field, r, *t, size, size, how, half) for t in part]
                        n = len(part)
                        columns = [[path] * n, [r["file_offset"]] * n, [r["field_no"]] * n, *(list(c) for c in zip(*part, strict=True)), pixels]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, schema)
