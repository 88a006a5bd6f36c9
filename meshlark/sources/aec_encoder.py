"""A plain entropy encoder (CCSDS 121.0) that can write every block option."""

from __future__ import annotations

import numpy as np

from . import aec


class Writer:
    def __init__(self):
        self.bits = []

    def number(self, v, width):
        self.bits += [(v >> k) & 1 for k in range(width - 1, -1, -1)]

    def run(self, n):
        self.bits += [0] * n + [1]

    def data(self):
        return np.packbits(np.array(self.bits, np.uint8)).tobytes()


def mapped(x, c):
    """Mapped prediction errors of an interval; the first place keeps the sample."""
    low, high = (-(1 << (c.bits - 1)), (1 << (c.bits - 1)) - 1) if c.flags & aec.SIGNED else (0, (1 << c.bits) - 1)
    out = [int(x[0]) & ((1 << c.bits) - 1)]
    for last, v in zip(x, x[1:], strict=False):
        last, d = int(last), int(v) - int(last)
        room = min(last - low, high - last)
        out.append((2 * d if d >= 0 else -2 * d - 1) if abs(d) <= room else room + abs(d))
    return out


def encode(x, c, option=None):
    """option: None picks the shortest of split codes; or "raw", "pairs"."""
    w, size = Writer(), c.block * c.rsi
    top = (1 << c.id_bits) - 1
    for start in range(0, len(x), size):
        part = [int(v) for v in x[start : start + size]]
        part += [part[-1]] * (-len(part) % c.block)
        coded = mapped(part, c) if c.flags & aec.PREPROCESS else [v & ((1 << c.bits) - 1) for v in part]
        blocks = [coded[k : k + c.block] for k in range(0, len(coded), c.block)]
        k = 0
        while k < len(blocks):
            b, ref = blocks[k], 1 if c.flags & aec.PREPROCESS and k == 0 else 0
            rest = b[ref:]
            if not any(rest):
                n = 1
                while k + n < len(blocks) and n < 64 - k % 64 and not any(blocks[k + n]):
                    n += 1
                to_end = n == min(c.rsi - k, 64 - k % 64) and n > 4
                w.number(0, c.id_bits)
                w.number(0, 1)
                if ref:
                    w.number(b[0], c.bits)
                w.run(4 if to_end else n - 1 if n < 5 else n)
                k += n
                continue
            k += 1
            if option == "raw" or top == 1:
                w.number(top, c.id_bits)
                for v in b:
                    w.number(v, c.bits)
                continue
            pairs = [(b[i] if i >= ref else 0, b[i + 1]) for i in range(0, c.block, 2)]
            if option == "pairs" and all((p + q) * (p + q + 1) // 2 + q <= 90 for p, q in pairs):
                w.number(0, c.id_bits)
                w.number(1, 1)
                if ref:
                    w.number(b[0], c.bits)
                for p, q in pairs:
                    w.run((p + q) * (p + q + 1) // 2 + q)
                continue
            best = min(range(min(top - 1, c.bits)), key=lambda s: sum((v >> s) + 1 + s for v in rest))
            w.number(best + 1, c.id_bits)
            if ref:
                w.number(b[0], c.bits)
            for v in rest:
                w.run(v >> best)
            for v in rest:
                w.number(v & ((1 << best) - 1), best)
        if c.flags & aec.PAD_RSI:
            w.bits += [0] * (-len(w.bits) % 8)
    return w.data()
