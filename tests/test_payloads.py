import struct

import numpy as np
import pytest

from meshlark.sources import aec, octets, packings, png
from meshlark.sources.aec_encoder import encode
from meshlark.sources.errors import BadStream, Truncated, Unsupported

R = np.random.default_rng(5)


@pytest.mark.parametrize("width", range(33))
def test_bits_round_trip(width):
    x = R.integers(0, 1 << width, 777) if width else np.zeros(777, int)
    assert (octets.unpack(octets.pack(x, width), width, 777) == x).all()


def test_signs():
    assert octets.signed(b"\x80\x00\x00\x05", 0, 4) == -5
    assert octets.signed(b"\x80", 0, 1) == 0
    assert octets.signed(octets.signed_octets(-300, 2), 0, 2) == -300
    assert octets.signed(b"", 0, 1, -127) == -127


def head(reference, binary, decimal, bits):
    return struct.pack(">f", reference) + octets.signed_octets(binary, 2) + octets.signed_octets(decimal, 2) + bytes([bits, 0])


def test_simple():
    assert packings.simple(head(2.5, 0, 1, 0), b"", 3).tolist() == [0.25] * 3
    got = packings.simple(head(10, -1, 0, 12), octets.pack(np.array([0, 1, 4095]), 12), 3)
    assert got.tolist() == [10, 10.5, 10 + 4095 / 2]
    with pytest.raises(BadStream):
        packings.simple(head(10, 0, 0, 12), b"\0", 3)


def grouped(groups, bits=8, manage=0, order=b""):
    """A complex payload of groups (reference, width, values)."""
    n = len(groups)
    body = head(0, 0, 0, bits) + bytes([1, manage]) + b"\0" * 8 + n.to_bytes(4, "big") + bytes([0, 4]) + (0).to_bytes(4, "big") + b"\1" + len(groups[-1][2]).to_bytes(4, "big") + bytes([8]) + order
    refs, widths, lengths = zip(*[(r, w, len(v)) for r, w, v in groups], strict=True)
    stream = "".join(format(v, f"0{w}b") for _, w, vs in groups for v in vs if w)
    stream += "0" * (-len(stream) % 8)
    values = bytes(int(stream[k : k + 8], 2) for k in range(0, len(stream), 8))
    return body, octets.pack(np.array(refs), bits) + octets.pack(np.array(widths), 4) + octets.pack(np.array(lengths), 8) + values


def test_complex():
    body, payload = grouped([(5, 3, [0, 7, 2]), (9, 0, [0, 0]), (1, 5, [30, 31])])
    assert packings.complex_packing(body, payload, 7).tolist() == [5, 12, 7, 9, 9, 31, 32]
    body, payload = grouped([(5, 3, [0, 7, 6]), (255, 0, [0, 0])], manage=2)
    got = packings.complex_packing(body, payload, 5)
    assert got[0] == 5 and np.isnan(got[1:]).all()
    with pytest.raises(BadStream):
        packings.complex_packing(body, payload, 6)


@pytest.mark.parametrize("order", [1, 2])
def test_differencing(order):
    x = np.cumsum(R.integers(-3, 9, 40)) + 100
    d = np.diff(x, order)
    least = int(d.min())
    missing = [7, 20, 21]
    packed = [0] * order + [int(v - least) for v in d]
    for at in missing:
        packed.insert(at, 31)
    body, payload = grouped([(0, 5, packed)], manage=1, order=bytes([order, 2]))
    lead = b"".join(octets.signed_octets(int(v), 2) for v in [*x[:order], least])
    got = packings.spatial_differencing(body, lead + payload, 43)
    assert np.isnan(got[missing]).all()
    assert np.delete(got, missing).tolist() == x.tolist()


def test_other_templates():
    v = np.array([1.5, -2.25])
    assert packings.ieee(b"\1", v.astype(">f4").tobytes(), 2).tolist() == v.tolist()
    assert packings.ieee(b"\2", v.astype(">f8").tobytes(), 2).tolist() == v.tolist()
    with pytest.raises(Unsupported):
        packings.ieee(b"\3", b"", 0)
    s = packings.spectral(head(0, 0, 0, 8)[:9] + struct.pack(">f", 7.5), bytes([1, 2]), 3)
    assert s.tolist() == [7.5, 1, 2]
    log = packings.logarithmic(head(0, 0, 0, 8)[:9] + struct.pack(">f", 2), bytes([0, 1]), 2)
    assert np.allclose(log, np.exp([0, 1]) - 2)
    assert packings.jpeg2000(head(4, 0, 0, 0), b"", 2).tolist() == [4, 4]
    with pytest.raises(Unsupported):
        packings.jpeg2000(head(4, 0, 0, 8), b"", 2)
    with pytest.raises(Unsupported):
        packings.values(99, b"", b"", 1, None)


@pytest.mark.parametrize("bits", [8, 16])
def test_png(bits):
    x = R.integers(0, 1 << bits, 60)
    got, depth = png.decode(png.encode(x, 12, 5, bits))
    assert depth == bits and (got == x).all()
    assert packings.png_image(head(1, 0, 0, bits), png.encode(x, 60, 1, bits), 60).tolist() == (x + 1.0).tolist()


def test_png_filters():
    rows = R.integers(0, 256, (5, 6), dtype=np.uint8)
    raw, above = b"", np.zeros(6, np.uint8)
    for kind in range(5):
        line = rows[kind]
        left, corner = np.concatenate(([0], line[:-1])).astype(int), np.concatenate(([0], above[:-1])).astype(int)
        up = above.astype(int)
        e = left + up - corner
        paeth = np.where((abs(e - left) <= abs(e - up)) & (abs(e - left) <= abs(e - corner)), left, np.where(abs(e - up) <= abs(e - corner), up, corner))
        guess = [np.zeros(6, int), left, up, (left + up) // 2, paeth][kind]
        raw += bytes([kind]) + ((line.astype(int) - guess) & 255).astype(np.uint8).tobytes()
        above = line
    assert (png._unfiltered(raw, 5, 6, 1) == rows).all()


@pytest.mark.parametrize("bits,block,rsi,flags", [(8, 16, 4, 8), (12, 8, 128, 8), (16, 32, 128, 8 | 32), (16, 16, 3, 9), (24, 64, 2, 8 | 2), (32, 16, 8, 8), (10, 8, 4, 0), (10, 8, 4, 1), (4, 8, 4, 8 | 16), (2, 8, 100, 8 | 16)])
@pytest.mark.parametrize("kind", ["noise", "steps", "flat"])
@pytest.mark.parametrize("option", [None, "raw", "pairs"])
def test_entropy_coding(bits, block, rsi, flags, kind, option):
    c = aec.Config(bits, block, rsi, flags)
    n = block * rsi * 2 + 5
    low = -(1 << (bits - 1)) if flags & aec.SIGNED else 0
    if kind == "noise":
        x = R.integers(0, 1 << min(bits, 20), n) + low
    elif kind == "steps":
        x = np.clip(np.cumsum(R.integers(-1, 2, n)), 0, (1 << bits) - 1) + low
    else:
        x = np.full(n, low + 1)
    assert (aec.decode(encode(x, c, option), n, c) == x).all()


def test_entropy_coding_errors():
    with pytest.raises(Unsupported):
        aec.Config(6, 8, 4, aec.RESTRICTED)
    with pytest.raises(Unsupported):
        aec.Config(8, 7, 4, 0)
    with pytest.raises(Truncated):
        aec.decode(b"\x20", 64, aec.Config(8, 8, 4, 8))
    c = aec.Config(16, 8, 4, 8 | aec.MSB)
    assert aec.to_bytes(np.array([1, 258]), c) == b"\0\1\1\2"


@pytest.mark.parametrize("packing", ["simple", "complex", "spdiff1", "spdiff2", "ccsds"])
@pytest.mark.parametrize("kind", ["smooth", "noise", "flat", "short", "holes"])
def test_packings_that_are_written(packing, kind):
    from meshlark.sources import encoder as e
    from meshlark.sources import messages

    n = 3 if kind == "short" else 150
    v = {"smooth": np.round(50 * np.sin(np.arange(n) / 9)) / 8, "noise": R.integers(0, 4000, n) / 8, "flat": np.full(n, 2.5), "short": np.array([1.0, 7.5, 3.0]), "holes": R.integers(0, 4000, n) / 8}[kind].astype(float)
    if kind == "holes":
        v[R.random(n) < 0.3] = np.nan
    grid = e.LatLon(n, 1, 50, 5, 50, 9, 0.1, 0.1)
    (row,) = messages.rows("f", e.file([[e.Field(grid, v, packing=packing, bits=16)]]), True)
    assert np.array_equal(row["values"], v, equal_nan=True)
