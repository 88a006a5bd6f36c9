"""PNG images as arrays of samples, with the standard library only."""

from __future__ import annotations

import zlib

import numpy as np

from .errors import BadStream, Unsupported

SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 6: 4}


def _chunks(data: bytes):
    if data[:8] != SIGNATURE:
        raise BadStream("no PNG image")
    at = 8
    while at + 12 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n


def _unfiltered(raw: bytes, rows: int, stride: int, step: int) -> np.ndarray:
    lines = np.frombuffer(raw, np.uint8, rows * (stride + 1)).reshape(rows, stride + 1)
    out = np.zeros((rows + 1, stride + step), np.uint8)  # a row of zeros above and a pixel of zeros before
    for k in range(rows):
        kind, line, above, here = int(lines[k, 0]), lines[k, 1:], out[k], out[k + 1]
        if kind == 0:
            here[step:] = line
        elif kind == 2:
            here[step:] = line + above[step:]
        elif kind == 1:
            for s in range(step):
                here[step + s :: step] = np.cumsum(line[s::step], dtype=np.uint8)
        elif kind in (3, 4):
            for i in range(stride):
                a, b, c = int(here[i]), int(above[i + step]), int(above[i])
                if kind == 3:
                    p = (a + b) // 2
                else:
                    e = a + b - c
                    p = min((abs(e - a), 0, a), (abs(e - b), 1, b), (abs(e - c), 2, c))[2]
                here[i + step] = (int(line[i]) + p) & 255
        else:
            raise BadStream("an unknown PNG filter")
    return out[1:, step:]


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """(samples row by row, bits of a sample): grey, or the channels of 8 bits of a pixel taken as one number."""
    head, packed = None, []
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            packed.append(body)
    if head is None:
        raise BadStream("a PNG image without a header")
    w, h, depth, colour, _, _, interlaced = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), *head[8:13]
    channels = _CHANNELS.get(colour)
    if channels is None or interlaced or (channels > 1 and depth != 8):
        raise Unsupported(f"PNG colour type {colour} of {depth} bits")
    stride, step = (w * channels * depth + 7) // 8, max(1, channels * depth // 8)
    rows = _unfiltered(zlib.decompress(b"".join(packed)), h, stride, step)
    if depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : w * depth].reshape(h, w, depth)
        return (bits @ (1 << np.arange(depth - 1, -1, -1))).reshape(-1).astype(np.int64), depth
    octets = rows.reshape(h * w, -1).astype(np.int64)
    size = octets.shape[1]
    return octets @ (256 ** np.arange(size - 1, -1, -1, dtype=np.int64)), 8 * size


def encode(values: np.ndarray, width: int, height: int, bits: int) -> bytes:
    """A grey image of 8 or 16 bits."""
    if bits not in (8, 16):
        raise Unsupported(f"PNG images of {bits} bits")
    rows = np.asarray(values).astype(f">u{bits // 8}").reshape(height, width).view(np.uint8).reshape(height, -1)
    raw = np.concatenate((np.zeros((height, 1), np.uint8), rows), axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    head = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([bits, 0, 0, 0, 0])
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
