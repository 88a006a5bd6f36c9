"""Fields to GRIB messages."""

from __future__ import annotations

import datetime as dt
import math
import struct
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame

from . import octets, png
from .errors import GribError

NONE32 = b"\xff\xff\xff\xff"


class Grid(Protocol):
    """What a grid must tell to be written; other grids can be added by classes like LatLon."""

    template: int
    ni: int
    nj: int
    scan: int

    def body(self) -> bytes: ...


def _u(v: int, n: int) -> bytes:
    return int(v).to_bytes(n, "big")


def _angle(v: float) -> bytes:
    return octets.signed_octets(round(v * 1e6), 4)


_EARTH6 = b"\x06" + b"\xff" + NONE32 + (b"\xff" + NONE32) * 2


@dataclass(frozen=True)
class LatLon:
    """la1, lo1: the first stored point; la2, lo2: the last."""

    ni: int
    nj: int
    la1: float
    lo1: float
    la2: float
    lo2: float
    di: float
    dj: float
    scan: int = 0
    template: int = 0

    def body(self) -> bytes:
        return _EARTH6 + _u(self.ni, 4) + _u(self.nj, 4) + _u(0, 4) + NONE32 + _angle(self.la1) + _angle(self.lo1) + b"\x30" + _angle(self.la2) + _angle(self.lo2) + _u(round(self.di * 1e6), 4) + self._last() + bytes([self.scan])

    def _last(self) -> bytes:
        return _u(round(self.dj * 1e6), 4)


@dataclass(frozen=True)
class RotatedLatLon(LatLon):
    pole_lat: float = -90.0
    pole_lon: float = 0.0
    angle: float = 0.0
    template: int = 1

    def body(self) -> bytes:
        return super().body() + _angle(self.pole_lat) + _angle(self.pole_lon) + struct.pack(">f", self.angle)


@dataclass(frozen=True)
class Gaussian(LatLon):
    """A regular Gaussian grid of n latitudes between a pole and the equator; dj isn't used."""

    n: int = 0
    template: int = 40

    def _last(self) -> bytes:
        return _u(self.n or self.nj // 2, 4)


@dataclass(frozen=True)
class Mercator:
    ni: int
    nj: int
    la1: float
    lo1: float
    la2: float
    lo2: float
    lad: float
    di: float
    dj: float
    scan: int = 0
    template: int = 10

    def body(self) -> bytes:
        return _EARTH6 + _u(self.ni, 4) + _u(self.nj, 4) + _angle(self.la1) + _angle(self.lo1) + b"\x30" + _angle(self.lad) + _angle(self.la2) + _angle(self.lo2) + bytes([self.scan]) + _u(0, 4) + _u(round(self.di * 1e3), 4) + _u(round(self.dj * 1e3), 4)


@dataclass(frozen=True)
class Polar:
    ni: int
    nj: int
    la1: float
    lo1: float
    lad: float
    lov: float
    di: float
    dj: float
    scan: int = 0
    south: bool = False
    template: int = 20

    def body(self) -> bytes:
        return _EARTH6 + _u(self.ni, 4) + _u(self.nj, 4) + _angle(self.la1) + _angle(self.lo1) + b"\x30" + _angle(self.lad) + _angle(self.lov) + _u(round(self.di * 1e3), 4) + _u(round(self.dj * 1e3), 4) + bytes([128 * self.south, self.scan])


@dataclass(frozen=True)
class Lambert(Polar):
    latin1: float = 0.0
    latin2: float = 0.0
    template: int = 30

    def body(self) -> bytes:
        return super().body() + _angle(self.latin1) + _angle(self.latin2) + _angle(-90) + _angle(0)


@dataclass(frozen=True)
class Field:
    """values in natural order (rows from north, west to east), NaN where missing. time_unit None: hours."""

    grid: Grid
    values: np.ndarray
    reference_time: dt.datetime = dt.datetime(2000, 1, 1)
    discipline: int = 0
    centre: int = 255
    subcentre: int = 0
    category: int = 0
    number: int = 0
    process: int = 2
    data_type: int = 1
    production_status: int = 0
    time_unit: int | None = None
    forecast_time: int = 0
    surface: tuple[int, int, int] = (1, 0, 0)
    packing: str = "simple"  # simple, ieee32, ieee64, png, complex, spdiff1, spdiff2 or ccsds
    bits: int = 16
    reuse_bitmap: bool = False
    extra: dict = field(default_factory=dict)


def storage_order(grid: Grid) -> np.ndarray:
    """The natural place of each stored value."""
    if widths := getattr(grid, "widths", ()):
        if grid.scan & 32:
            raise GribError("reduced rows can't be stored by columns")
        first, out = np.cumsum([0, *widths]), []
        for k, j in enumerate(range(len(widths))[::-1] if grid.scan & 64 else range(len(widths))):
            row = np.arange(first[j], first[j + 1])
            out.append(row[::-1] if bool(grid.scan & 128) ^ bool(grid.scan & 16 and k % 2) else row)
        return np.concatenate(out)
    place = np.arange(grid.ni * grid.nj).reshape(grid.nj, grid.ni)
    if grid.scan & 128:
        place = place[:, ::-1]
    if grid.scan & 64:
        place = place[::-1]
    if grid.scan & 32:
        place = place.T
    if grid.scan & 16:
        place = place.copy()
        place[1::2] = place[1::2, ::-1]
    return place.reshape(-1)


def quantised(values: np.ndarray, bits: int) -> tuple[float, int, np.ndarray]:
    """(reference as a 32-bit float not above the least value, binary scale, whole numbers of `bits` bits)."""
    if not len(values):
        return 0.0, 0, np.zeros(0, np.int64)
    least = float(values.min())
    reference = np.float32(least)
    if reference > least:
        reference = np.nextafter(reference, np.float32(-np.inf))
    span = float(values.max()) - float(reference)
    most = (1 << bits) - 1
    binary = math.ceil(math.log2(span / most)) if span > 0 and bits else 0
    x = np.floor((values - float(reference)) / 2.0**binary + 0.5)
    return float(reference), binary, np.clip(x, 0, most).astype(np.int64)


def _section(number: int, body: bytes) -> bytes:
    return _u(len(body) + 5, 4) + bytes([number]) + body


def _data(f: Field) -> bytes:
    stored = np.asarray(f.values, np.float64)[storage_order(f.grid)]
    valid = ~np.isnan(stored)
    kept = stored[valid]
    if f.packing in ("ieee32", "ieee64"):
        kind = ">f4" if f.packing == "ieee32" else ">f8"
        template, body, payload = 4, bytes([1 if kind == ">f4" else 2]), kept.astype(kind).tobytes()
    elif f.packing in ("simple", "png"):
        bits = 8 if f.packing == "png" and f.bits <= 8 else 16 if f.packing == "png" else f.bits
        reference, binary, x = quantised(kept, bits)
        body = struct.pack(">f", reference) + octets.signed_octets(binary, 2) + b"\0\0"
        if len(kept) and kept.min() == kept.max() and float(reference) == kept[0]:
            bits = 0
        template, body = (41 if f.packing == "png" else 0), body + bytes([bits, 0])
        payload = b"" if not bits else png.encode(x, len(x), 1, bits) if f.packing == "png" and len(x) else octets.pack(x, bits)
    elif f.packing in ("complex", "spdiff1", "spdiff2", "ccsds"):
        template, body, payload = _further(f, kept)
    else:
        raise GribError(f"packing {f.packing}")
    five = _section(5, _u(len(kept), 4) + _u(template, 2) + body)
    six = _section(6, b"\xfe") if f.reuse_bitmap else _section(6, b"\xff") if valid.all() else _section(6, b"\0" + octets.bitmap(valid))
    return five + six + _section(7, payload)


#: Values of a group of complex packing.
GROUP = 32


def _further(f: Field, kept: np.ndarray) -> tuple[int, bytes, bytes]:
    """(template, template body, payload) of groups of GROUP values, of the same over differences, and of entropy coding."""
    reference, binary, x = quantised(kept, f.bits)
    head = struct.pack(">f", reference) + octets.signed_octets(binary, 2) + b"\0\0"
    if f.packing == "ccsds":
        from . import aec, aec_encoder

        c = aec.Config(max(f.bits, 1), 16, 128, aec.PREPROCESS | aec.MSB)
        return 42, head + bytes([c.bits, 0, c.flags, c.block]) + _u(c.rsi, 2), aec_encoder.encode(x, c) if len(x) else b""
    order = {"complex": 0, "spdiff1": 1, "spdiff2": 2}[f.packing]
    first, extra = b"", b""
    if order:
        d = x.copy()
        d[order:] = np.diff(x, order)
        least = int(d[order:].min()) if len(d) > order else 0
        d[order:] -= least
        d[:order] = 0
        first = b"".join(octets.signed_octets(int(v), 4) for v in [*x[:order], *[0] * max(order - len(x), 0), least])
        x, extra = d, bytes([order, 4])
    parts = [x[k : k + GROUP] for k in range(0, len(x), GROUP)] or [np.zeros(0, np.int64)]
    refs = np.array([int(p.min()) if len(p) else 0 for p in parts])
    widths = np.array([int(p.max() - p.min()).bit_length() if len(p) else 0 for p in parts])
    ref_bits, width_bits = int(refs.max()).bit_length(), int(widths.max()).bit_length()
    bits = np.concatenate([((p[:, None] - r) >> np.arange(w - 1, -1, -1) & 1).reshape(-1) for p, r, w in zip(parts, refs, widths, strict=True)])
    # one manner of splitting, nothing missing, groups of one length but for the last
    body = head + bytes([ref_bits, 0, 1, 0]) + b"\0" * 8 + _u(len(parts), 4) + bytes([0, width_bits]) + _u(GROUP, 4) + bytes([1]) + _u(len(parts[-1]), 4) + bytes([0])
    return (3 if order else 2), body + extra, first + octets.pack(refs, ref_bits) + octets.pack(widths, width_bits) + np.packbits(bits.astype(np.uint8)).tobytes()


def message(fields: list[Field]) -> bytes:
    """One physical message of one or more fields, which share its discipline, centre and reference time."""
    if not fields:
        raise GribError("a message without fields")
    first = fields[0]
    t = first.reference_time
    out = _section(1, _u(first.centre, 2) + _u(first.subcentre, 2) + b"\0\0\1" + _u(t.year, 2) + bytes([t.month, t.day, t.hour, t.minute, t.second, first.production_status, first.data_type]))
    for f in fields:
        widths = getattr(f.grid, "widths", ())
        points = sum(widths) or f.grid.ni * f.grid.nj
        if len(f.values) != points:
            raise GribError(f"{len(f.values)} values for {points} points")
        out += _section(3, b"\0" + _u(len(f.values), 4) + (b"\2\1" if widths else b"\0\0") + _u(f.grid.template, 2) + f.grid.body())
        surface, scale, value = f.surface
        out += _section(4, b"\0\0\0\0" + bytes([f.category, f.number, f.process, 0, 0, 0, 0, 0, 1 if f.time_unit is None else f.time_unit]) + octets.signed_octets(f.forecast_time, 4) + bytes([surface]) + octets.signed_octets(scale, 1) + _u(value, 4) + b"\xff\0" + NONE32)
        out += _data(f)
    return b"GRIB\0\0" + bytes([first.discipline, 2]) + _u(len(out) + 20, 8) + out + b"7777"


def file(groups: list[list[Field]]) -> bytes:
    """A file of a physical message for each group of fields."""
    if not groups:
        raise GribError("a file without messages")
    return b"".join(message(g) for g in groups)


@dataclass(frozen=True)
class ReducedGaussian(Gaussian):
    """Rows of differing width, from north."""

    widths: tuple[int, ...] = ()

    def body(self) -> bytes:
        whole = super().body()
        return whole[:16] + NONE32 + whole[20:49] + NONE32 + whole[53:] + b"".join(_u(w, 2) for w in (self.widths[::-1] if self.scan & 64 else self.widths))


def grid_of(r: dict) -> Grid:
    """The grid of a row with the header columns of grib.read that its template has."""
    template = int(r.get("grid_template") or 0)
    n = lambda k: int(r.get(k) or 0)
    ends = (n("ni"), n("nj"), r["la1"], r["lo1"])
    if template in (0, 1, 40):
        corners = (*ends, r.get("la2"), r.get("lo2"), r.get("di") or 0.0)
        if template == 0:
            return LatLon(*corners, r["dj"], n("scan"))
        if template == 1:
            return RotatedLatLon(*corners, r["dj"], n("scan"), pole_lat=r["pole_lat"], pole_lon=r["pole_lon"], angle=r.get("angle") or 0.0)
        widths = tuple(int(w) for w in (r["widths"] if r.get("widths") is not None else ()))
        return ReducedGaussian(*corners, 0.0, n("scan"), n=n("gaussian_n"), widths=widths) if widths else Gaussian(*corners, 0.0, n("scan"), n=n("gaussian_n"))
    if template == 10:
        return Mercator(*ends, r.get("la2") or 0.0, r.get("lo2") or 0.0, r["lad"], r["di"], r["dj"], n("scan"))
    if template == 20:
        return Polar(*ends, r["lad"], r["lov"], r["di"], r["dj"], n("scan"), bool(r.get("south")))
    if template == 30:
        return Lambert(*ends, r["lad"], r["lov"], r["di"], r["dj"], n("scan"), bool(r.get("south")), latin1=r["latin1"], latin2=r["latin2"])
    raise GribError(f"grid template {template} can't be written")


#: Header columns that a row to be written may have, with those of its grid; what is missing has the default of Field.
WRITABLE = {"discipline": "discipline", "centre": "centre", "subcentre": "subcentre", "category": "category", "number": "number", "generating_process": "process", "data_type": "data_type", "production_status": "production_status", "time_unit": "time_unit", "forecast_time": "forecast_time"}


def field_of(r: dict, packing: str, bits: int) -> Field:
    """A field from a row; values in natural order, NaN or null where missing."""
    more = {name: int(r[c]) for c, name in WRITABLE.items() if r.get(c) is not None}
    if r.get("surface1") is not None:
        more["surface"] = (int(r["surface1"]), int(r.get("scale1") or 0), int(r.get("value1") or 0))
    if r.get("reference_time") is not None:
        more["reference_time"] = r["reference_time"]
    return Field(grid_of(r), np.array([np.nan if v is None else v for v in r["values"]], np.float64), packing=r.get("packing") or packing, bits=bits, reuse_bitmap=bool(r.get("reuse_bitmap")), **more)


def singles(fields: DataFrame, keys: list[str], packing: str = "simple", bits: int = 16) -> DataFrame:
    """(keys, message): a physical message for each row, in the task that holds it."""
    import pyarrow as pa

    from .pieces import pieces

    at = fields.columns.index("values")
    kinds = ", ".join(f"`{k}` {fields.schema[k].dataType.simpleString()}" for k in keys)
    kept = [fields.columns.index(k) for k in keys]

    def run(batches):
        for batch in (piece for whole in batches for piece in pieces(whole, at)):
            made = [message([field_of(r, packing, bits)]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(made, pa.binary())], [*keys, "message"])

    return fields.mapInArrow(run, f"{kinds}, message binary")


def encoded(fields: DataFrame, group: str, order: str, packing: str = "simple", bits: int = 16) -> DataFrame:
    """(group, message): a physical message for each group of rows, in the order of a column.

    fields: values (natural order, NaN or null where missing), the header columns
    of the grid (any of grid_of) and of WRITABLE, surface1, scale1, value1,
    reference_time, and packing and reuse_bitmap where rows differ. A group is
    one message and so fits one task by its nature.
    """
    import pandas as pd

    kind = fields.schema[group].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [{k: None if v is pd.NaT or isinstance(v, float) and math.isnan(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for k, v in r.items()} for r in pdf.sort_values(order).to_dict("records")]
        return pd.DataFrame({group: [pdf[group].iloc[0]], "message": [message([field_of(r, packing, bits) for r in rows])]})

    return fields.groupBy(group).applyInPandas(run, f"`{group}` {kind}, message binary")
