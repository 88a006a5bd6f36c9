"""Numbers and bit fields in big-endian octets."""

from __future__ import annotations

import numpy as np


def unsigned(data: bytes, at: int, n: int, default: int | None = None) -> int:
    """The unsigned number in n octets; past the end the default, if there is one."""
    if at + n > len(data):
        if default is None:
            raise IndexError(f"{n} octets at {at} of {len(data)}")
        return default
    return int.from_bytes(data[at : at + n], "big")


def signed(data: bytes, at: int, n: int, default: int | None = None) -> int:
    """The number in n octets whose highest bit is its sign."""
    if at + n > len(data) and default is not None:
        return default
    v, high = unsigned(data, at, n), 1 << (8 * n - 1)
    return -(v - high) if v & high else v


def signed_octets(value: int, n: int) -> bytes:
    if abs(value) >= 1 << (8 * n - 1):
        raise OverflowError(value)
    return (abs(value) | (1 << (8 * n - 1) if value < 0 else 0)).to_bytes(n, "big")


def float32(data: bytes, at: int) -> float:
    return float(np.frombuffer(data, ">f4", 1, at)[0])


def fields(data: bytes, starts: np.ndarray, widths: np.ndarray | int) -> np.ndarray:
    """The unsigned numbers of `widths` bits (0 to 32) that begin at the bits `starts`, highest bit first."""
    eight = np.ndarray((len(data) + 1,), ">u8", data + b"\0" * 8, 0, (1,))  # the eight octets from each place on
    starts, widths = np.asarray(starts, np.int64), np.asarray(widths, np.int64)
    shift = (64 - widths - (starts & 7)).astype(np.uint64)
    v = eight[starts >> 3].astype(np.uint64)
    return (v >> np.minimum(shift, 63) & ((np.uint64(1) << widths.astype(np.uint64)) - np.uint64(1))).astype(np.int64)


def unpack(data: bytes, width: int, count: int) -> np.ndarray:
    """`count` numbers of `width` bits each."""
    if not 0 <= width <= 32:
        raise ValueError(f"{width} bits")
    if count * width > 8 * len(data):
        raise ValueError("the payload is too short")
    if width == 0:
        return np.zeros(count, np.int64)
    if width in (8, 16, 32):
        return np.frombuffer(data, f">u{width // 8}", count).astype(np.int64)
    out = np.empty(count, np.int64)
    for a in range(0, count, 1 << 20):
        b = min(a + (1 << 20), count)
        first = a * width >> 3
        out[a:b] = fields(data[first : (b * width >> 3) + 1], np.arange(a, b, dtype=np.int64) * width - 8 * first, width)
    return out


def pack(values: np.ndarray, width: int) -> bytes:
    """The inverse of unpack, filled up with zero bits."""
    if width == 0:
        return b""
    bits = (np.asarray(values, np.int64)[:, None] >> np.arange(width - 1, -1, -1)) & 1
    return np.packbits(bits.astype(np.uint8).reshape(-1)).tobytes()


def bits_of(data: bytes, count: int) -> np.ndarray:
    """The first bits of data as booleans."""
    if count > 8 * len(data):
        raise ValueError("the bitmap is too short")
    return np.unpackbits(np.frombuffer(data, np.uint8), count=count).astype(bool)


def bitmap(valid: np.ndarray) -> bytes:
    return np.packbits(valid.astype(np.uint8)).tobytes()
