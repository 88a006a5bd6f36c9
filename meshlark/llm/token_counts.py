"""Operator 7: token counts by rank-synchronous merging of ragged arrays.

A text is cut into pre-tokens that no piece of the vocabulary can cross. The
pre-tokens of a batch lie one after the other in flat numpy arrays. In each
round every sequence applies its lowest-rank pair, all sequences at once, from
the left at all places up to the first where the new symbol makes a pair with a
neighbour that comes before the rest: this is what one place after the other
gives, whatever the vocabulary. Sequences without a pair leave. What survives is
counted. So long sequences take about a round for each rank they hold.

Defined results: null and empty texts have 0 bytes and 0 tokens; every row,
repeated ones too, gives one row; other columns are ignored, clashing names
included, as only the named id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import arrow_map

MARK = "▁"
#: Counts of so many pre-tokens are remembered by a worker.
REMEMBER = 400_000


class PieceMerger:
    """Counts the pieces that a BPE model with byte fallback makes of texts."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        ids = {model.id_to_piece(i): i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("pieces with a blank inside need other pre-tokens")
        score = {p: model.get_score(i) for p, i in ids.items()}
        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                if p[:k] in ids and p[k:] in ids:
                    pairs[ids[p[:k]], ids[p[k:]]] = (-score[p], i)
        rank = {s: n for n, s in enumerate(sorted({x[0] for x in pairs.values()}))}
        keys = np.array([a << 20 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.rank = np.array([rank[x[0]] for x in pairs.values()], np.int64)[order]
        self.made = np.array([x[1] for x in pairs.values()], np.int64)[order]
        self.none = len(rank)
        self.one = {p: i for p, i in ids.items() if len(p) == 1}
        inside = {c for p in ids if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\t\r" if c not in inside)
        self.cut = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]+" if alone else ""))
        self.seen: dict[str, int] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair in the table; -1 for none. Unknown symbols are negative."""
        key = a << 20 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), at, -1)

    def merged(self, tokens: list[str]) -> np.ndarray:
        """How many pieces each pre-token has."""
        counts = np.zeros(len(tokens), np.int64)
        get = self.one.get
        symbols = np.array([get(c, -len(c.encode())) for t in tokens for c in t], np.int64)
        if not len(symbols):
            return counts
        owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        unknown = symbols < 0
        counts += np.bincount(owner[unknown], -symbols[unknown], len(tokens)).astype(np.int64)
        counts += np.bincount(owner[~unknown], minlength=len(tokens))
        pair = np.full(len(symbols), -1)
        pair[:-1] = np.where(owner[:-1] == owner[1:], self._rank(symbols[:-1], symbols[1:]), -1)
        while True:
            rank = np.where(pair >= 0, self.rank[pair], self.none)
            begin = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(rank, begin)
            long = np.diff(begin, append=len(owner))
            alive = least < self.none
            if not alive.any():
                return counts
            keep = np.repeat(alive, long)
            symbols, owner, pair, rank = symbols[keep], owner[keep], pair[keep], rank[keep]
            found = np.flatnonzero(rank == np.repeat(least[alive], long[alive]))
            at = self._together(found, symbols, owner, pair, rank)
            symbols[at] = self.made[pair[at]]
            counts -= np.bincount(owner[at], minlength=len(counts))
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            symbols, owner, pair = symbols[stay], owner[stay], pair[stay]
            now = place[at]
            for p in (now, now[now > 0] - 1):
                last = p + 1 >= len(symbols)
                q = np.where(last, p, p + 1)
                pair[p] = np.where(~last & (owner[p] == owner[q]), self._rank(symbols[p], symbols[q]), -1)

    def _together(self, found: np.ndarray, symbols: np.ndarray, owner: np.ndarray, pair: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Of the places of the lowest pairs those that are merged before any merge makes a pair that comes first."""
        start = np.flatnonzero(np.diff(found, prepend=-9) > 1)
        within = np.arange(len(found)) - np.repeat(start, np.diff(start, append=len(found)))
        at = found[within % 2 == 0]  # of places that overlap every other one, from the left
        new = self.made[pair[at]]
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, len(symbols) - 1)
        joined = np.diff(at, prepend=-9) == 2  # what stands before is merged by then
        left = np.where(joined, np.roll(new, 1), symbols[before])
        pairs = (self._rank(left, new), (at > 0) & (owner[before] == owner[at])), (self._rank(new, symbols[after]), (at + 2 < len(symbols)) & (owner[after] == owner[at]))
        sooner = np.zeros(len(at), bool)
        for p, there in pairs:
            sooner |= there & (p >= 0) & (self.rank[p] <= rank[at])
        done = np.cumsum(sooner) - sooner
        first = np.diff(owner[at], prepend=-1) != 0
        return at[done == done[first][np.cumsum(first) - 1]]

    def count(self, texts: list[str]) -> list[int]:
        """The tokens of each text, as the library's encode gives them without added symbols."""
        cut = [self.cut.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.seen) > REMEMBER:
            self.seen.clear()
        new = list({t for tokens in cut for t in tokens if t not in self.seen})
        self.seen.update(zip(new, self.merged(new).tolist(), strict=True))
        out = [sum(map(self.seen.__getitem__, tokens)) for tokens in cut]
        for t in new:
            if len(t) > 64:
                del self.seen[t]
        return out


@lru_cache(2)
def merger_of(model_file: str) -> PieceMerger:
    """One merger for all tasks of a worker."""
    return PieceMerger(model_file)


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; over_limit: more than `limit` tokens."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        merger = merger_of(model_file)

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            counts: list[int] = []
            for k in range(0, len(texts), 256):
                counts += merger.count(texts[k : k + 256])
            sizes = [len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

        return each

    return arrow_map(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
