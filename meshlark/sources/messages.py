"""Messages of a file: section walk, header columns and grid descriptions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np

from ..functions.headers import ENSEMBLE_AT, INTERVAL_AT, SECTION_LEAST
from . import packings
from .errors import BadMessage, GribError, Truncated, Unsupported
from .octets import bits_of, float32, signed, unsigned

#: Template number: (name, least octets of its description, where its scanning flags stand). Fixed values.
GRIDS = {0: ("latlon", 58, 57), 1: ("rotated_latlon", 70, 57), 10: ("mercator", 58, 45), 20: ("polar", 51, 50), 30: ("lambert", 67, 50), 40: ("gaussian", 58, 57), 41: ("rotated_gaussian", 70, 57), 42: ("stretched_gaussian", 70, 57), 43: ("stretched_rotated_gaussian", 82, 57), 50: ("spectral", 14, None), 101: ("unstructured", 21, None)}
NONE32 = 0xFFFFFFFF


def physical(data: bytes) -> Iterator[tuple[int, int]]:
    """(offset, length) of each physical message; what stands between messages is skipped."""
    at = 0
    while (at := data.find(b"GRIB", at)) >= 0:
        if at + 16 > len(data):
            raise Truncated("the indicator section ends too early")
        if data[at + 7] != 2:
            raise BadMessage(f"edition {data[at + 7]}")
        size = unsigned(data, at + 8, 8)
        if size < 20 or at + size > len(data):
            raise Truncated("a message ends too early")
        yield at, size
        at += size


def split(message: bytes) -> Iterator[dict[int, bytes | None]]:
    """The sections of each field of a physical message; a section holds for all fields until it is replaced."""
    held: dict[int, bytes | None] = {0: message[:16]}
    at, end, fields = 16, len(message) - 4, 0
    if message[end:] != b"7777":
        raise BadMessage("no end section")
    while at < end:
        if at + 5 > end:
            raise Truncated("a section ends too early")
        size, number = unsigned(message, at, 4), message[at + 4]
        if size < SECTION_LEAST.get(number, 1 << 62) or at + size > end:
            raise BadMessage(f"section {number} of {size} octets")
        section = message[at : at + size]
        at += size
        if number == 6 and section[5] == 254:
            if held.get(6) is None:
                raise BadMessage("a bitmap that stands for one that isn't there")
        else:
            held[number] = section
        if number == 7:
            if any(held.get(k) is None for k in (1, 3, 4, 5, 6)):
                raise BadMessage("a field without all of its sections")
            fields += 1
            yield dict(held)
    if not fields:
        raise BadMessage("a message without fields")


def _time(s: bytes, at: int) -> dt.datetime | None:
    """A checked time in seven octets."""
    if at + 7 > len(s):
        return None
    try:
        return dt.datetime(unsigned(s, at, 2), s[at + 2], s[at + 3], s[at + 4], s[at + 5], min(s[at + 6], 59)) + dt.timedelta(seconds=max(s[at + 6] - 59, 0)) if s[at + 6] <= 60 else None
    except ValueError:
        return None


def _reference_time(s: bytes) -> dt.datetime | None:
    """The reference time; parts beyond their range run over into the next."""
    y, mo, d, h, mi, se = unsigned(s, 12, 2), *s[14:19]
    y, mo = y + (mo - 1) // 12, (mo - 1) % 12 + 1
    return dt.datetime(y, mo, 1) + dt.timedelta(days=d - 1, hours=h, minutes=mi, seconds=se) if 1 <= y <= 9999 else None


def _places(template: int, s: bytes) -> tuple[int, int, int, int, int | None] | None:
    """Where generating process, unit and forecast time (and its octets) and the first surface stand. Fixed values."""
    if template <= 15 or template in (60, 61):
        return 11, 17, 18, 4, 22
    if 32 <= template <= 34:
        return 11, 17, 18, 4, None
    if 40 <= template <= 43:
        return 13, 19, 20, 4, 24
    if template == 44 and len(s) - 4 * unsigned(s, 5, 2) == 45:
        return 24, 30, 31, 2, 33
    if 44 <= template <= 47:
        return 24, 30, 31, 4, 35
    return None


def product(s: bytes) -> dict:
    """The product section by columns; what its template doesn't have is null (code tables: 255)."""
    template = unsigned(s, 7, 2)
    octet = lambda at, other=255: s[at] if at < len(s) else other
    out = {"product_template": template, "category": octet(9), "number": octet(10), "generating_process": 255, "time_unit": 0, "forecast_time": 0, "surface1": 255, "scale1": -127, "value1": NONE32, "surface2": 255, "scale2": -127, "value2": NONE32}
    if at := _places(template, s):
        process, unit, time, width, surface = at
        out |= {"generating_process": octet(process), "time_unit": octet(unit, 0), "forecast_time": signed(s, time, 4, 0) if width == 4 else unsigned(s, time, 2, 0)}
        if surface:
            for k, p in ((1, surface), (2, surface + 6)):
                out |= {f"surface{k}": octet(p), f"scale{k}": signed(s, p + 1, 1, -127), f"value{k}": unsigned(s, p + 2, 4, 0)}
    out |= {"derived": octet(34) if template in (2, 3, 4, 12, 13, 14) else 255, "percentile": octet(34) if template in (6, 10) else 255}
    likely = template in (5, 9)
    out |= {"probability_number": octet(34) if likely else 255, "probability_count": octet(35) if likely else 255, "probability_type": octet(36) if likely else 255}
    out |= {"lower_scale": signed(s, 37, 1, -127) if likely else -127, "lower_value": signed(s, 38, 4, 0) if likely else -0x7FFFFFFF, "upper_scale": signed(s, 42, 1, -127) if likely else -127, "upper_value": signed(s, 43, 4, 0) if likely else -0x7FFFFFFF}
    e = ENSEMBLE_AT.get(template)
    if template in (33, 34) and octet(22, 0):
        e = 34 + 11 * (octet(22, 0) - 1)
    out |= {"ensemble_type": octet(e) if e else 255, "perturbation": octet(e + 1, 0) if e else 0, "ensemble_size": octet(e + 2, 0) if e else 0}
    end, count, missing, first = INTERVAL_AT.get(template, (None,) * 4)
    ranges = []
    if end:
        for k in range(octet(count, 0)):
            p = first + 12 * k
            if p + 12 > len(s):
                break
            ranges.append({"process": s[p], "increment_type": s[p + 1], "unit": s[p + 2], "length": unsigned(s, p + 3, 4), "increment_unit": s[p + 7], "increment": unsigned(s, p + 8, 4)})
    out |= {"interval_end": _time(s, end) if end else None, "missing_in_process": unsigned(s, missing, 4, NONE32) if end else NONE32, "time_ranges": ranges}
    pairs = unsigned(s, 5, 2)
    if 9 + 4 * pairs > len(s):
        raise Truncated("the coordinate values end too early")
    out["hybrid"] = [float32(s, len(s) - 4 * (pairs - k)) for k in range(pairs)]
    return out


def _earth(b: bytes) -> dict:
    def scaled(at: int, unit: float) -> float:
        return 0.0 if b[at] == 255 or unsigned(b, at + 1, 4) == NONE32 else unsigned(b, at + 1, 4) * 10.0 ** -b[at] * unit

    shape, unit = b[0], 1000.0 if b[0] == 3 else 1.0
    return {"shape": shape, "radius": scaled(1, 1.0), "major": scaled(6, unit), "minor": scaled(11, unit)}


def grid(s: bytes) -> dict:
    """The grid section by columns; angles in degrees, lengths in metres."""
    template, b = unsigned(s, 12, 2), s[14:]
    out = {"grid_template": template, "points": unsigned(s, 6, 4), "ni": None, "nj": None, "la1": None, "lo1": None, "la2": None, "lo2": None, "di": None, "dj": None, "scan": None, "pole_lat": None, "pole_lon": None, "angle": None, "lad": None, "lov": None, "latin1": None, "latin2": None, "south": None, "gaussian_n": None, "stretch_lat": None, "stretch_lon": None, "stretch": None, "uuid": None, "mesh_number": None, "shape": None, "radius": None, "major": None, "minor": None, "widths": []}
    if template not in GRIDS:
        raise Unsupported(f"grid template {template}")
    name, least, scan = GRIDS[template]
    if len(b) < least:
        raise Truncated(f"the description of a {name} grid ends too early")
    if template == 50:
        return out
    if template == 101:
        return out | {"shape": b[0], "mesh_number": unsigned(b, 1, 3), "uuid": b[5:21].hex()}
    out |= _earth(b) | {"ni": unsigned(b, 16, 4), "nj": unsigned(b, 20, 4), "scan": b[scan] & 0xF0}
    micro = lambda at: signed(b, at, 4) / 1e6
    if template in (10, 20, 30):
        out |= {"la1": micro(24), "lo1": micro(28), "lad": micro(33)}
        if template == 10:
            return out | {"la2": micro(37), "lo2": micro(41), "di": unsigned(b, 50, 4) / 1e3, "dj": unsigned(b, 54, 4) / 1e3}
        out |= {"lov": micro(37), "di": unsigned(b, 41, 4) / 1e3, "dj": unsigned(b, 45, 4) / 1e3, "south": bool(b[49] & 128)}
        return out | ({"latin1": micro(51), "latin2": micro(55)} if template == 30 else {})
    basic, parts = unsigned(b, 24, 4), unsigned(b, 28, 4)
    unit = 1e6 if basic in (0, NONE32) or parts in (0, NONE32) else parts / basic
    angle = lambda at: signed(b, at, 4) / unit
    step = lambda at: None if unsigned(b, at, 4) == NONE32 else unsigned(b, at, 4) / unit
    out |= {"la1": angle(32), "lo1": angle(36), "la2": angle(41), "lo2": angle(45), "di": step(49)}
    if template in (0, 1):
        out["dj"] = step(53)
    else:
        out["gaussian_n"] = unsigned(b, 53, 4) or out["nj"] // 2
        size = s[10]
        if out["ni"] == NONE32:
            rows = s[14 + least : 14 + least + size * out["nj"]]
            if not size or len(rows) < size * out["nj"]:
                raise Truncated("the list of row widths ends too early")
            widths = [unsigned(rows, k * size, size) for k in range(out["nj"])]
            out |= {"ni": None, "widths": widths[::-1] if out["scan"] & 64 else widths}
    turned = {1: 58, 41: 58, 43: 58}.get(template)
    if turned:
        out |= {"pole_lat": angle(turned), "pole_lon": angle(turned + 4), "angle": float32(b, turned + 8)}
    spread = {42: 58, 43: 70}.get(template)
    if spread:
        out |= {"stretch_lat": angle(spread), "stretch_lon": angle(spread + 4), "stretch": unsigned(b, spread + 8, 4) / 1e6}
    return out


def header(sections: dict[int, bytes | None]) -> dict:
    """All header columns of a field."""
    s0, s1, s5 = sections[0], sections[1], sections[5]
    own = {"discipline": s0[6], "centre": unsigned(s1, 5, 2), "subcentre": unsigned(s1, 7, 2), "master_table": s1[9], "local_table": s1[10], "reference_significance": s1[11], "reference_time": _reference_time(s1), "production_status": s1[19], "data_type": s1[20], "local_use": sections.get(2)}
    own |= product(sections[4]) | grid(sections[3])
    return own | {"packed": unsigned(s5, 5, 4), "data_template": unsigned(s5, 9, 2), "bitmap_indicator": sections[6][5]}


def field_values(sections: dict[int, bytes | None], predefined: dict[int, bytes] | None = None) -> np.ndarray:
    """The values of a field in storage order, NaN where missing. predefined: bitmaps of indicators 1 to 253."""
    total, s6 = unsigned(sections[3], 6, 4), sections[6]
    bits = None
    if s6[5] == 0:
        bits = s6[6:]
    elif 1 <= s6[5] <= 253:
        bits = (predefined or {}).get(s6[5])
        if bits is None:
            raise Unsupported(f"the predefined bitmap {s6[5]}")
    if bits is not None:
        if len(bits) * 8 < total:
            raise Truncated("the bitmap ends too early")
        bits = bits_of(bits, total)
    s5 = sections[5]
    return packings.values(unsigned(s5, 9, 2), s5[11:], sections[7][5:], total, bits)


def rows(file: str, data: bytes, payload: bool, mode: str = "FAILFAST", predefined: dict[int, bytes] | None = None) -> Iterator[dict]:
    """A row for each field of a file. PERMISSIVE gives a row with the error for what can't be read, DROPMALFORMED leaves it out."""

    def bad(offset: int, e: GribError) -> Iterator[dict]:
        if mode == "FAILFAST":
            raise e
        if mode == "PERMISSIVE":
            yield {"file": file, "file_offset": offset, "error": f"{type(e).__name__}: {e}"}

    offset = 0
    try:
        for offset, size in physical(data):
            try:
                for n, sections in enumerate(split(data[offset : offset + size])):
                    try:
                        row = {"file": file, "file_offset": offset, "field_no": n} | header(sections)
                        if payload:
                            row["values"] = field_values(sections, predefined)
                        yield row
                    except GribError as e:
                        yield from bad(offset, e)
            except GribError as e:
                yield from bad(offset, e)
    except GribError as e:
        yield from bad(offset, e)
