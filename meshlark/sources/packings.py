"""Data sections as arrays of values: every packing on whole arrays, missing values as NaN."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import aec, octets, png
from .errors import BadStream, GribError, Truncated, Unsupported

#: Decoders of further templates: template number -> f(body, payload, count) -> whole numbers. JPEG 2000 can be added here.
PLUGINS: dict[int, Callable[[bytes, bytes, int], np.ndarray]] = {}


def _scale(body: bytes) -> tuple[float, float, int]:
    """(bias, unit, bits): a value is bias + x * unit."""
    if len(body) < 9:
        raise Truncated("the data representation ends too early")
    unit = 10.0 ** -octets.signed(body, 6, 2)
    return octets.float32(body, 0) * unit, 2.0 ** octets.signed(body, 4, 2) * unit, body[8]


def simple(body: bytes, payload: bytes, n: int) -> np.ndarray:
    bias, unit, bits = _scale(body)
    if bits == 0:
        return np.full(n, bias)
    if bits > 32 or n * bits > 8 * len(payload):
        raise BadStream("the payload doesn't fit its width")
    if bits in (8, 16, 32):  # whole octets: one pass from bytes to values
        x = np.frombuffer(payload, f">u{bits // 8}", n).astype(np.float64)
    else:
        x = octets.unpack(payload, bits, n).astype(np.float64)
    x *= unit
    x += bias
    return x


def _groups(body: bytes, payload: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, missing) of complex packing: references of groups plus what each place adds."""
    if len(body) < 36:
        raise BadStream("the data representation ends too early")
    bits, manage, groups = body[8], body[11], octets.unsigned(body, 20, 4)
    if groups == 0:
        if n:
            raise BadStream("values without groups")
        return np.zeros(0, np.int64), np.zeros(0, bool)
    at = 0

    def stream(width: int) -> np.ndarray:
        nonlocal at
        size = (groups * width + 7) // 8
        if width > 32 or at + size > len(payload):
            raise BadStream("a stream of groups ends too early")
        part = octets.unpack(payload[at : at + size], width, groups)
        at += size
        return part

    reference = stream(bits)
    width = body[24] + stream(body[25])
    length = octets.unsigned(body, 26, 4) + body[30] * stream(body[35])
    length[-1] = octets.unsigned(body, 31, 4)
    if (width > 32).any() or (length < 0).any() or int(length.sum()) != n or int((width * length).sum()) > 8 * (len(payload) - at):
        raise BadStream("groups that contradict the payload")
    wide, ref = np.repeat(width, length), np.repeat(reference, length)
    place = np.cumsum(wide) - wide
    x = octets.fields(payload[at:], place, wide) if n else np.zeros(0, np.int64)
    missing = np.zeros(n, bool)
    if manage:
        most = (np.int64(1) << wide) - 1
        missing = np.where(wide > 0, x == most, ref == (1 << bits) - 1)
        if manage == 2:
            missing |= (wide > 0) & (x == most - 1)
    return ref + x, missing


def complex_packing(body: bytes, payload: bytes, n: int) -> np.ndarray:
    bias, unit, _ = _scale(body)
    x, missing = _groups(body, payload, n)
    return np.where(missing, np.nan, bias + x * unit)


def spatial_differencing(body: bytes, payload: bytes, n: int) -> np.ndarray:
    """Differences run over the values that aren't missing; the first one or two places hold the values themselves."""
    if len(body) < 38:
        raise BadStream("the data representation ends too early")
    order, size = body[36], body[37]
    if order not in (1, 2) or not 1 <= size <= 4 or n < order or (order + 1) * size > len(payload):
        raise BadStream("differencing that isn't of first or second order")
    first = [octets.signed(payload, k * size, size) for k in range(order)]
    least = octets.signed(payload, order * size, size)
    bias, unit, _ = _scale(body)
    x, missing = _groups(body, payload[(order + 1) * size :], n)
    d = x[~missing]
    d[order:] += least
    d[:order] = first[: len(d)]
    if order == 2 and len(d) > 1:
        d[1] -= d[0]
        head, d[0] = d[0], 0
        d = head + np.cumsum(np.cumsum(d))
    else:
        d = np.cumsum(d)
    out = np.full(n, np.nan)
    out[~missing] = bias + d * unit
    return out


def ieee(body: bytes, payload: bytes, n: int) -> np.ndarray:
    kind = {1: ">f4", 2: ">f8"}.get(body[0] if body else 0)
    if kind is None:
        raise Unsupported("floats of this precision")
    if n * int(kind[2]) > len(payload):
        raise Truncated("the payload ends too early")
    return np.frombuffer(payload, kind, n).astype(np.float64)


def png_image(body: bytes, payload: bytes, n: int) -> np.ndarray:
    bias, unit, bits = _scale(body)
    if bits == 0:
        return np.full(n, bias)
    x, depth = png.decode(payload)
    if len(x) != n or bits > depth:
        raise BadStream("an image of another size")
    return bias + x * unit


def ccsds(body: bytes, payload: bytes, n: int) -> np.ndarray:
    bias, unit, bits = _scale(body)
    if bits == 0:
        return np.full(n, bias)
    if len(body) < 14:
        raise Truncated("the data representation ends too early")
    return bias + aec.decode(payload, n, aec.Config(bits, body[11], octets.unsigned(body, 12, 2), body[10])) * unit


def jpeg2000(body: bytes, payload: bytes, n: int) -> np.ndarray:
    bias, unit, bits = _scale(body)
    if bits == 0:
        return np.full(n, bias)
    if 40 not in PLUGINS:
        raise Unsupported("JPEG 2000 needs a decoder in PLUGINS[40]")
    return bias + np.asarray(PLUGINS[40](body, payload, n)) * unit


def spectral(body: bytes, payload: bytes, n: int) -> np.ndarray:
    """The first coefficient stands in the template, the others are packed."""
    if len(body) < 13:
        raise Truncated("the data representation ends too early")
    if n == 0:
        return np.zeros(0)
    return np.concatenate(([octets.float32(body, 9)], simple(body, payload, n - 1)))


def logarithmic(body: bytes, payload: bytes, n: int) -> np.ndarray:
    if len(body) < 13:
        raise Truncated("the data representation ends too early")
    return np.exp(simple(body, payload, n)) - octets.float32(body, 9)


DECODERS = {0: simple, 2: complex_packing, 3: spatial_differencing, 4: ieee, 40: jpeg2000, 41: png_image, 42: ccsds, 50: spectral, 61: logarithmic}


def values(template: int, body: bytes, payload: bytes, total: int, bits: np.ndarray | None) -> np.ndarray:
    """The values of a field in storage order; bits says which places have one."""
    decode = DECODERS.get(template)
    if decode is None:
        raise Unsupported(f"data representation template {template}")
    n = total if bits is None else int(bits.sum())
    try:
        packed = decode(body, payload, n)
    except GribError:
        raise
    except (IndexError, ValueError) as e:
        raise BadStream(str(e)) from e
    if bits is None:
        return packed
    out = np.full(total, np.nan)
    out[bits] = packed
    return out
