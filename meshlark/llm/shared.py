"""Helpers that several operators share: tables, tokens, materialisation."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.tables import written

#: Characters that end a word: blank and \t \n \v \f \r (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"

#: Texts of about so many bytes are handled by numpy at once; a longer text is handled alone.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with a function that is made once for each task and yields batches for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)

    return df.mapInArrow(run, schema)


def carries(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators that carry all columns of their first table: columns that begin with _op_, as helpers do, have other names meanwhile."""

    @wraps(f)
    def run(docs: DataFrame, *args, **more) -> DataFrame:
        other = {c: f"carried_{k}_{uuid.uuid4().hex}" for k, c in enumerate(docs.columns) if c.lower().startswith("_op_")}
        if not other:
            return f(docs, *args, **more)
        named = lambda x: other.get(x, x) if isinstance(x, str) else x
        out = f(docs.withColumnsRenamed(other), *map(named, args), **{k: named(v) for k, v in more.items()})
        return out.withColumnsRenamed({v: k for k, v in other.items()})

    return run


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(texts: list[bytes], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together."""
    start, size = 0, 0
    for i, x in enumerate(texts):
        if i > start and size + len(x) > most:
            yield start, i
            start, size = i, 0
        size += len(x) + 1
    if start < len(texts):
        yield start, len(texts)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LEAD = np.ones(256, bool)
LEAD[0x80:0xC0] = False  # the bytes that don't start a code point
#: Longer runs of bytes than this are hashed one at a time.
_LONG = 1024


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def hashed(joined: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: np.uint64 = np.uint64(0)) -> np.ndarray:
    """A 64-bit hash of the bytes from each start to its stop, another one for each seed.

    Eight bytes at a time are mixed in by a bijection of 64 bits, so that two runs
    share a hash by chance only (2^-64 a pair), however regular they are, and runs
    of one length up to eight bytes never do. Long runs go through blake2b.
    """
    eight = np.ndarray((len(joined) + 1,), "<u8", np.concatenate((joined, np.zeros(8, np.uint8))).data, 0, (1,))
    size = stop - start
    out = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seed)
    left = np.flatnonzero((size > 0) & (size <= _LONG))
    at = 0
    while len(left):
        rest = np.minimum(size[left] - at, 8).astype(np.uint64)
        part = eight[start[left] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest))
        out[left] = mix((out[left] + np.uint64(at)) ^ part)
        at += 8
        left = left[size[left] > at]
    key = seed.tobytes()
    for k in np.flatnonzero(size > _LONG):
        out[k] = int.from_bytes(blake2b(joined[start[k] : stop[k]].tobytes(), digest_size=8, key=key).digest(), "little")
    return out


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts together: the hash, start and end byte of each word, the first word of each text (and the end), and all bytes."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[joined]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    first = np.searchsorted(start, np.concatenate(([0], np.cumsum(size))))
    return hashed(joined, start, end), start, end, first, joined


_TURN = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def windows(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """The hash of every n consecutive words, at the place of the first; the last n - 1 places hold other values."""
    out = np.zeros(len(hashes), np.uint64)
    for k in range(n):
        out[: len(hashes) - k] += hashes[k:] * _TURN[k % 5]
        out = mix(out) if k == n - 1 else out ^ (out >> np.uint64(29))
    return out


def small_side(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """Writes a table that is joined to a larger one; broadcast only if its counted rows are at most most_rows."""
    from pyspark.sql import functions as F

    kept = written(df)
    return F.broadcast(kept) if kept.count() <= most_rows else kept


#: Keys with more than one in so many rows (and LEAST_HOT) are hot; there are at most as many of them.
HOT, LEAST_HOT = 1000, 1000


def spread_join(rows: DataFrame, keyed: DataFrame, on: str, count: str) -> DataFrame:
    """rows joined to keyed, a written table of a row for each key with the number of `rows` that have it in `count`.

    Hot keys go by a broadcast table of at most HOT rows, so that no task gets all rows of one.
    """
    from pyspark.sql import functions as F

    rows_of = keyed.agg(F.sum(count), F.max(count)).first()
    limit = max(LEAST_HOT, (rows_of[0] or 0) // HOT)
    if (rows_of[1] or 0) <= limit:
        return rows.join(keyed, on)
    hot = F.broadcast(keyed.where(F.col(count) > limit))
    rest = rows.join(hot.select(on), on, "left_anti").join(keyed.where(F.col(count) <= limit), on)
    return rest.unionByName(rows.join(hot, on))
