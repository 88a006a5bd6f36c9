"""Operator 3: benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are reduced to their letters and digits, A-Z lower-cased. A benchmark
passage of n bytes that occurs with at most k = budget * n edits shares at least
n - q + 1 - k * q of its q-grams with the text, all on diagonals (place in the
text less place in the passage) that lie within k of each other. Shared q-grams
are therefore counted in overlapping bands of 2 (k + 1) diagonals, a bounded
number of pairs of places at a time; bands that reach the bound are verified by
an alignment of the diagonals around them, whose ends in the text are free. Items of more than PIECE bytes are searched in overlapping pieces, and
those of more than PART bytes in such shorter ones too: a part of an item that
has 3 / 2 * PART - 1 bytes holds one of them. The longest piece found counts.

The benchmark is the stated query set: it is read in blocks of at most
`block_bytes`, each of which is searched for in all documents.

Defined results: null and empty texts match nothing; items without letters or
digits are no passages; items too short for a q-gram are found only exactly;
an item that occurs several times in a text gives its best occurrence; rows
that repeat an id are each searched; an empty table on either side gives an
empty result; other columns are not read, or carried by `clean`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, blocks, carries, utf8, written

Q = 8
#: Edits that a passage may have, as a share of its bytes.
BUDGET = 0.1
#: Longer items are searched in pieces of this many bytes, one beginning every half of it, so that a part of a passage is found as well.
PIECE = 160
#: The same of the shorter pieces.
PART = 80
#: Bytes of items that are searched for at once; a worker's index takes some 100 times as many.
BLOCK_BYTES = 2 << 20
#: NULs between texts, so that no band holds diagonals of two.
GAP = 2 * PIECE
#: Places looked up, and pairs of places counted, at once.
PLACES, PAIRS = 1 << 20, 1 << 20
#: Passages aligned at once.
ALIGNED = 1024
_DROP = bytes(c for c in range(128) if not chr(c).isalnum())
_BITS = 22


def plain(text: bytes) -> bytes:
    """Letters and digits of the text; bytes beyond ASCII all stay."""
    return text.lower().translate(None, _DROP)


def _grams(joined: bytes) -> np.ndarray:
    """The Q = 8 bytes from each place on, as one number."""
    return np.ndarray((max(len(joined) - Q + 1, 0),), "<u8", joined, 0, (1,)).copy()


def aligned(passages: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The least edits that turn each passage (a column of bytes) into a part of its text (a column that is longer by W).

    A banded alignment of all columns side by side: place k of a passage meets
    places k to k + W of its text. Ends in the text are free.
    """
    wide = len(texts) - len(passages) + 1
    steps = np.arange(wide, dtype=np.int32)[:, None]
    row = np.zeros((wide, passages.shape[1]), np.int32)
    for k, c in enumerate(passages):
        new = row + (texts[k : k + wide] != c)
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        row = np.minimum.accumulate(new - steps, axis=0) + steps
    return row.min(axis=0)


def edits(passage: bytes, region: bytes, most: int) -> int:
    """The least edits that turn the passage into a part of the region, if at most `most` (else most + 1)."""
    # beyond the region's ends nothing matches, which costs as much as leaving a byte out
    text = np.full(most + len(region) + len(passage), -1, np.int16)
    text[most : most + len(region)] = np.frombuffer(region, np.uint8)
    return min(int(aligned(np.frombuffer(passage, np.uint8)[:, None], text[:, None])[0]), most + 1)


class Passages:
    """The q-grams of benchmark passages with their places."""

    def __init__(self, items: list[tuple[int, bytes]], budget: float = BUDGET) -> None:
        self.item, self.text, k, bound = [], [], [], []
        short: dict[int, dict[int, list[int]]] = {}
        for item, text in items:
            p = plain(text)
            if 0 < len(p) < Q:
                short.setdefault(len(p), {}).setdefault(int.from_bytes(p, "little"), []).append(item)
            starts = [(0, PIECE)] if len(p) <= PIECE else []
            for size in (PIECE, PART):
                starts += [(s, size) for s in sorted({*range(0, len(p) - size, size // 2), len(p) - size})] if len(p) > size else []
            for s, size in starts if len(p) >= Q else []:
                part = p[s : s + size]
                k.append(min(int(budget * len(part)), (len(part) - Q) // Q))  # so that the bound is at least 1
                bound.append(len(part) - Q + 1 - k[-1] * Q)
                self.item.append(item)
                self.text.append(part)
        self.short = [(size, np.array(sorted(of), np.uint64), [of[x] for x in sorted(of)]) for size, of in sorted(short.items())]
        self.ks, self.bounds, self.sizes = np.array(k, np.int64), np.array(bound, np.int64), np.array([len(t) for t in self.text], np.int64)
        grams = [_grams(t) for t in self.text]
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.passage = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])[order]
        self.place = (np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams]) if grams else np.zeros(0, np.int32))[order]
        self.grams, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self._slot(self.grams)] = True

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)

    def search(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text the items found in it: (item, edits, bytes of the passage)."""
        out: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        reduced = [plain(t) for t in texts]
        joined = (b"\0" * GAP).join(reduced) + b"\0" * Q
        starts = np.cumsum([0, *(len(t) + GAP for t in reduced[:-1])])
        around = np.frombuffer(b"\0" * GAP + joined + b"\0" * GAP, np.uint8)
        held = np.zeros(0, np.int64), np.zeros(0, np.int64)  # bands that more places may lie in, and their counts so far
        for a in range(0, len(joined) - Q + 1, PLACES):
            grams = _grams(joined[a : a + PLACES + Q - 1])
            for size, keys, items in self.short:
                low = grams & np.uint64((1 << 8 * size) - 1)
                found = np.minimum(np.searchsorted(keys, low), len(keys) - 1)
                at = np.flatnonzero(keys[found] == low)
                doc = np.searchsorted(starts, a + at, "right") - 1
                for d, x in {*zip(doc.tolist(), found[at].tolist(), strict=True)}:
                    out[d].update(dict.fromkeys(items[x], (0, size)))
            if not len(self.grams):
                continue
            at = np.flatnonzero(self.maybe[self._slot(grams)])
            found = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
            right = self.grams[found] == grams[at]
            at, found = at[right] + a, found[right]
            upto = np.cumsum(self.first[found + 1] - self.first[found])
            x = 0
            while x < len(at):  # one place at least, whose pairs are the places of one q-gram in the block of items
                y = max(x + 1, int(np.searchsorted(upto, (upto[x - 1] if x else 0) + PAIRS)))
                held = self._counted(held, at[x:y], found[x:y])
                keys, shared = held
                passage, begin = self._of(keys)
                done = begin + 2 * (self.ks[passage] + 1) + self.sizes[passage] < at[y - 1]
                self._verified(keys[done], shared[done], around, starts, out)
                held = keys[~done], shared[~done]
                x = y
        self._verified(*held, around, starts, out)
        return [[(i, e, n) for i, (e, n) in sorted(hits.items())] for hits in out]

    def _of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The passage of a band, and its first diagonal."""
        passage = keys >> 32
        return passage, ((keys & 0xFFFFFFFF) - 1) * (self.ks[passage] + 1) - PIECE

    def _counted(self, held: tuple[np.ndarray, np.ndarray], at: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bands held, and those of the q-grams at these places of the joined texts, with the number of places in each."""
        count = self.first[gram + 1] - self.first[gram]
        which = np.repeat(self.first[gram] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
        passage = self.passage[which].astype(np.int64)
        band = (np.repeat(at, count) - self.place[which] + PIECE) // (self.ks[passage] + 1) + 1
        key = passage << 32 | band
        both, more = np.unique(np.concatenate((key, key - 1)), return_counts=True)  # each diagonal lies in two overlapping bands
        keys, place = np.unique(np.concatenate((held[0], both)), return_inverse=True)
        return keys, np.bincount(place, np.concatenate((held[1], more)), len(keys)).astype(np.int64)

    def _verified(self, keys: np.ndarray, shared: np.ndarray, around: np.ndarray, starts: np.ndarray, out: list[dict[int, tuple[int, int]]]) -> None:
        """Aligns the passages of the bands that reach the bound, those of one length together. around: the joined texts with GAP NULs at both ends, which match nothing."""
        passage, begin = self._of(keys)
        reach = np.flatnonzero(shared >= self.bounds[passage])
        passage, begin = passage[reach], begin[reach]
        ks, sizes = self.ks[passage], self.sizes[passage]
        doc = np.searchsorted(starts, begin + 2 * (ks + 1) + PIECE, "right") - 1
        for size in np.unique(sizes)[::-1]:
            of = np.flatnonzero(sizes == size)
            k = int(ks[of[0]])
            for a in range(0, len(of), ALIGNED):
                some = [i for i in of[a : a + ALIGNED] if not ((best := out[doc[i]].get(self.item[passage[i]])) and (best[1] > size or best == (0, size)))]
                if not some:
                    continue
                # an alignment of at most k edits leaves the band's 2 (k + 1) diagonals by k at most
                texts = around[(begin[some] - k + GAP)[None] + np.arange(size + 4 * k + 2)[:, None]]
                found = aligned(np.frombuffer(b"".join(self.text[passage[i]] for i in some), np.uint8).reshape(len(some), size).T, texts)
                for i, e in zip(some, found.tolist(), strict=True):
                    item = self.item[passage[i]]
                    best = out[doc[i]].get(item)
                    if e <= k and (best is None or (-size, e) < (-best[1], best[0])):
                        out[doc[i]][item] = (e, int(size))


def _blocks_of(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of bounded size, one at a time on the driver."""
    block, size = [], 0
    for row in items.select(id_col, text_col).where(F.col(text_col).isNotNull()).orderBy(id_col).toLocalIterator():
        text = row[1].encode()
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], text))
        size += len(text)
    if block:
        yield block


def _searched(docs: DataFrame, columns: list[str], text_col: str, sent: Broadcast, budget: float) -> DataFrame:
    """The columns of docs and _op_matches, an array of (item_id, edits, passage_bytes)."""
    at = docs.columns.index(text_col)
    kept = [docs.columns.index(c) for c in columns]
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int64()), ("passage_bytes", pa.int64())]))

    def make():
        if not hasattr(sent, "passages"):  # one index for all tasks of a worker
            sent.passages = Passages(sent.value, budget)
        passages = sent.passages

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = utf8(batch.column(at))
            for a, b in blocks(texts):
                hits = [[{"item_id": i, "edits": e, "passage_bytes": n} for i, e, n in found] for found in passages.search(texts[a:b])]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(k) for k in kept] + [pa.array(hits, kind)], [*columns, "_op_matches"])

        return each

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return arrow_map(docs, make, f"{fields}, _op_matches array<struct<item_id: long, edits: long, passage_bytes: long>>")


def _by_block(benchmark: DataFrame, item_col: str, item_text: str, block_bytes: int, step: Callable[[Broadcast], DataFrame]) -> Iterator[DataFrame]:
    """step(block) for each block of items. Of several blocks each result is written before the next one is read, so that one block is held at a time."""
    found = _blocks_of(benchmark, item_col, item_text, block_bytes)
    block = next(found, [])
    while block is not None:
        after = next(found, None)
        sent = benchmark.sparkSession.sparkContext.broadcast(block)  # at most block_bytes and an item
        out = step(sent)
        if after is None:  # the last one stays lazy
            yield out
        else:
            yield written(out)
            sent.destroy()
        block = after


@carries
def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", budget: float = BUDGET, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item_id, edits, passage_bytes): a row for each document and item found in it."""
    rows = docs.select(id_col, text_col)
    parts = _by_block(benchmark, item_col, item_text, block_bytes, lambda sent: _searched(rows, [id_col], text_col, sent, budget).select(id_col, F.explode("_op_matches").alias("m")).select(id_col, "m.*"))
    return reduce(DataFrame.unionByName, parts)


@carries
def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", budget: float = BUDGET, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs in which no item is found, with their columns; no shuffle."""
    held = [docs]

    def step(sent: Broadcast) -> DataFrame:
        return _searched(held[0], docs.columns, text_col, sent, budget).where("size(_op_matches) = 0").drop("_op_matches")

    for out in _by_block(benchmark, item_col, item_text, block_bytes, step):
        held[0] = out
    return held[0]
