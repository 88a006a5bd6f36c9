"""Adaptive entropy coding (CCSDS 121.0) on whole payloads.

Decoding has two passes. The first walks over the blocks and reads options only:
a run-length code ends at a set bit, so a block of n codes ends at the n-th set
bit from here on, which a table of set bits and of their running count tells
without a look at the codes. The second decodes all blocks of one option side by
side. The predictor is undone by running sums wherever no error was folded at
the range's ends, else for all reference intervals side by side, one sample
place at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import octets
from .errors import BadStream, Truncated, Unsupported

#: Option flags (fixed values).
SIGNED, THREE_BYTE, MSB, PREPROCESS, RESTRICTED, PAD_RSI = 1, 2, 4, 8, 16, 32
#: The run length that stands for all blocks up to the end of a segment of SEGMENT blocks, and the highest code of a sample pair.
TO_END, SEGMENT, MOST_PAIR = 5, 64, 90


@dataclass(frozen=True)
class Config:
    bits: int
    block: int
    rsi: int
    flags: int

    def __post_init__(self) -> None:
        if not 1 <= self.bits <= 32 or not 1 <= self.rsi <= 4096 or self.block % 2 or not 2 <= self.block <= 256:
            raise Unsupported(f"coding with {self}")
        if self.flags & RESTRICTED and 4 < self.bits <= 8:
            raise Unsupported("restricted coding of 5 to 8 bits")

    @property
    def id_bits(self) -> int:
        if self.bits > 16:
            return 5
        if self.bits > 8:
            return 4
        if self.flags & RESTRICTED and self.bits <= 4:
            return 1 if self.bits <= 2 else 2
        return 3

    @property
    def sample_bytes(self) -> int:
        return 1 if self.bits <= 8 else 2 if self.bits <= 16 else 3 if self.bits <= 24 and self.flags & THREE_BYTE else 4


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.size = data, 8 * len(data)
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.ones = np.flatnonzero(self.bits)

    def rank(self) -> memoryview:
        """The set bits before each place, and before the end."""
        out = np.zeros(self.size + 1, np.int32)
        np.cumsum(self.bits, out=out[1:])
        return memoryview(out)

    def small(self, width: int) -> bytes:
        """The number in the `width` bits from each place on, zeros behind the end."""
        out, padded = np.zeros(self.size + 1, np.uint8), np.concatenate((self.bits, np.zeros(width + 1, np.uint8)))
        for k in range(width):
            out = out << 1 | padded[k : k + self.size + 1]
        return out.tobytes()

    def fields(self, starts: np.ndarray, width: int) -> np.ndarray:
        """Numbers of `width` bits that begin at these places."""
        return octets.fields(self.data, starts, width)

    def runs(self, starts: np.ndarray, count: int) -> np.ndarray:
        """The zeros before each of the next `count` set bits from each start, a row for each."""
        first = np.searchsorted(self.ones, starts)
        ends = self.ones[first[:, None] + np.arange(count)]
        return np.diff(ends, axis=1, prepend=(starts - 1)[:, None]) - 1


def _pairs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two samples of pairs' codes: a code counts pairs by their sum, then by the second."""
    if (codes > MOST_PAIR).any():
        raise BadStream("a pair code that no encoder writes")
    total = ((np.sqrt(8 * codes + 1) - 1) / 2).astype(np.int64)
    second = codes - total * (total + 1) // 2
    return total - second, second


def _walk(bits: _Bits, c: Config, count: int) -> tuple[dict[tuple[int, int], tuple[list[int], list[int]]], list[tuple[int, int]], int]:
    """What the payload's options say: (option, reference) -> (first sample, place) of blocks, (sample, place) of reference samples, and the number of samples.

    Options: 1 and above split codes, 0 pairs, -1 uncoded blocks. Blocks of zeros are left out.
    """
    block, size, id_bits, width = c.block, c.block * c.rsi, c.id_bits, c.bits
    top, ahead, padded = (1 << id_bits) - 1, bool(c.flags & PREPROCESS), bool(c.flags & PAD_RSI)
    rank, ids, ends, end, total = bits.rank(), bits.small(id_bits), memoryview(bits.ones), bits.size, len(bits.ones)
    found: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
    references: list[tuple[int, int]] = []
    n = at = inside = 0
    try:
        while n < count:
            option = ids[at]
            at += id_bits
            reference = 1 if ahead and not inside else 0
            if option == top:
                kind, place, blocks, reference = -1, at, 1, 0
                at += block * width
            elif option:
                if reference:
                    references.append((n, at))
                    at += width
                kind, place, blocks, codes = option, at, 1, block - reference
                at = ends[rank[at] + codes - 1] + 1 + (option - 1) * codes
            else:
                kind = -1 if rank[at + 1] == rank[at] else 0  # the bit says whether pairs follow
                at += 1
                if reference:
                    references.append((n, at))
                    at += width
                place, blocks = at, 1
                if kind == 0:
                    at = ends[rank[at] + block // 2 - 1] + 1
                else:
                    at = ends[rank[at]] + 1
                    kind, blocks = -2, at - place
                    if blocks == TO_END:
                        done = inside // block
                        blocks = min(c.rsi - done, SEGMENT - done % SEGMENT)
                    elif blocks > TO_END:
                        blocks -= 1
                    if inside + blocks * block > size:
                        raise BadStream("a run of zero blocks beyond the interval")
            if at > end:
                raise Truncated("the coded payload ends inside a block")
            if kind > -2:
                held = found.get((kind, reference))
                if held is None:
                    held = found[kind, reference] = ([], [])
                held[0].append(n)
                held[1].append(place)
            n += blocks * block
            inside += blocks * block
            if inside == size:
                inside = 0
                if padded:
                    at = -(-at // 8) * 8
    except IndexError:
        raise Truncated(f"the coded payload of {total} set bits ends too early") from None
    return found, references, n


def _coded(data: bytes, count: int, c: Config) -> np.ndarray:
    """The coded samples of a payload: mapped errors, or samples without a predictor."""
    bits = _Bits(data)
    found, references, n = _walk(bits, c, count)
    out = np.zeros(n, np.int64)
    for (kind, reference), (first, place) in found.items():
        first, place = np.array(first), np.array(place)
        codes = c.block - reference
        to = first[:, None] + np.arange(reference, c.block)
        if kind == -1:
            out[to] = bits.fields((place[:, None] + np.arange(c.block) * c.bits).reshape(-1), c.bits).reshape(to.shape)
        elif kind:
            high = bits.runs(place, codes)
            if kind > 1:
                low = place + high.sum(axis=1) + codes
                high = high << (kind - 1) | bits.fields((low[:, None] + np.arange(codes) * (kind - 1)).reshape(-1), kind - 1).reshape(to.shape)
            out[to] = high
        else:
            one, two = _pairs(bits.runs(place, c.block // 2))
            out[first[:, None] + np.arange(0, c.block, 2)] = one  # the first of a block with a reference is overwritten by it
            out[first[:, None] + np.arange(1, c.block, 2)] = two
    if references:
        where, place = np.array(references).T
        out[where] = bits.fields(place, c.bits)
    return out


def _unpredicted(coded: np.ndarray, c: Config) -> np.ndarray:
    """Samples from mapped prediction errors; a row for each interval."""
    low, high = (-(1 << (c.bits - 1)), (1 << (c.bits - 1)) - 1) if c.flags & SIGNED else (0, (1 << c.bits) - 1)
    step = np.where(coded & 1, -((coded + 1) >> 1), coded >> 1)
    step[:, 0] = coded[:, 0]
    if c.flags & SIGNED:
        step[:, 0] = np.where(step[:, 0] > high, step[:, 0] - (1 << c.bits), step[:, 0])
    out = np.cumsum(step, axis=1)
    # errors up to the nearer end of the range have both signs; an interval that keeps to them is right as it is
    room = np.minimum(out[:, :-1] - low, high - out[:, :-1])
    rows = np.flatnonzero((coded[:, 1:] > 2 * room).any(axis=1))
    if len(rows):
        part, errors = out[rows], coded[rows]
        if len(rows) < 16:
            part = np.array([_folded(x.tolist(), y.tolist(), low, high) for x, y in zip(part, errors, strict=True)])
        for k in range(1, part.shape[1]) if len(rows) >= 16 else ():
            last, d = part[:, k - 1], errors[:, k]
            near, far = last - low, high - last
            room = np.minimum(near, far)
            part[:, k] = last + np.where(d <= 2 * room, step[rows, k], np.where(near <= far, d - room, room - d))
        out[rows] = part
    return out


def _folded(first: list[int], errors: list[int], low: int, high: int) -> list[int]:
    """The samples of one interval, one after the other."""
    v = first[0]
    out = [v]
    for d in errors[1:]:
        near, far = v - low, high - v
        room = near if near < far else far
        if d > 2 * room:
            v += d - room if near <= far else room - d
        else:
            v += -((d + 1) >> 1) if d & 1 else d >> 1
        out.append(v)
    return out


def decode(data: bytes, count: int, c: Config) -> np.ndarray:
    """The first `count` samples of a payload."""
    if count <= 0:
        return np.zeros(0, np.int64)
    coded, size = _coded(data, count, c), c.block * c.rsi
    if not c.flags & PREPROCESS:
        whole = coded[:count]
        return np.where(whole > (1 << (c.bits - 1)) - 1, whole - (1 << c.bits), whole) if c.flags & SIGNED else whole
    full = len(coded) // size * size
    parts = [_unpredicted(part, c).reshape(-1) for part in (coded[:full].reshape(-1, size), coded[full:].reshape(1, -1)) if part.size]
    return np.concatenate(parts)[:count]


def to_bytes(samples: np.ndarray, c: Config) -> bytes:
    """Samples in the octets that the flags ask for."""
    n = c.sample_bytes
    wide = (samples & ((1 << 8 * n) - 1)).astype(">u4" if c.flags & MSB else "<u4").view(np.uint8).reshape(-1, 4)
    return (wide[:, 4 - n :] if c.flags & MSB else wide[:, :n]).tobytes()
