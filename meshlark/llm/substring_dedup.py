"""Operator 2: substring dedup by content-defined chunks.

A gear rolling hash of the last WINDOW bytes marks the ends of chunks wherever
it falls below a bound and hasn't for LEAST - 1 bytes, so that a run of one
letter ends once; ends depend on nearby bytes only, so an insertion shifts no
later chunk. Chunks average some 70 bytes and are cut at MOST. They are compared
by digests of 96 bits. The first document that holds a digest keeps it;
consecutive chunks of a document that are kept by others form a repeated
passage, which counts from `least_words` words on. Shared passages some chunk of
which the document itself keeps are told as well, marked as kept.

The chunks at a passage's ends hold other text too and don't count, and text of
few distinct words has a periodic hash, which may hold no end for long. So
wherever PASSAGE words hold no ends at least `least_words` words apart, as their
own bytes tell, the least hash of so many words among them goes the way of a
chunk. Which of equal ones is taken doesn't matter, as only hashes are compared:
no PASSAGE words that two documents hold byte for byte are missed.

Chunks are made once, into a table. Every digest's first holder is an aggregate,
combined before the shuffle, that is joined back to the chunks; digests of more
than a HOT share of all rows, of which there can be few, are joined as a
broadcast table, so that a line in each document gathers in no task.

Defined results: null and empty texts have no chunks; a passage that repeats
only inside one document stays; rows that repeat an id count as one document;
documents without an id keep nothing and lose nothing; very long texts are
chunked whole; an empty table gives an empty result; further columns are not
read, or carried by `cut_out`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import LEAD, arrow_map, blocks, carries, hashed, mix, utf8, words, written

#: Bytes that the hash sees, one place in how many ends a chunk by it alone, bytes without such a place before an end, and the longest chunk.
WINDOW, ONE_IN, LEAST, MOST = 16, 64, 8, 4096
#: Words of a passage that is never missed, and that a repeated passage counts from.
PASSAGE, LEAST_WORDS = 51, 33
#: A digest is hot above one row in so many (and 10,000 rows); there are at most as many of them.
HOT = 1000
_GEAR = np.random.default_rng(17).integers(0, 1 << 16, 256, dtype=np.uint16)
#: What tells the second part of a digest from the first.
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def gear_hash(joined: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash at each byte; it shifts at each step, so bytes further back than WINDOW have left it."""
    gear = _GEAR[joined]
    h = np.zeros(len(joined), np.uint16)
    for k in range(min(WINDOW, len(joined))):
        h[k:] += gear[: len(gear) - k] << np.uint16(k)
    return h


class Texts:
    """Texts one after the other: bytes, where each begins (and the end), code points and word starts before each byte, and ends by the hash."""

    def __init__(self, texts: list[bytes]) -> None:
        self.joined = np.frombuffer(b"".join(texts), np.uint8)
        self.bounds = np.cumsum([0, *map(len, texts)])
        h = gear_hash(self.joined)
        for b in self.bounds[1:-1]:  # the hash mustn't see the text before
            h[b : b + WINDOW] = gear_hash(self.joined[b : b + WINDOW])
        low = np.flatnonzero(h < 65536 // ONE_IN) + 1
        text = np.searchsorted(self.bounds, low - 1, "right")
        alone = np.ones(len(low), bool)
        alone[1:] = (np.diff(low) >= LEAST) | (np.diff(text) > 0)
        self.ends = np.zeros(len(self.joined) + 1, bool)
        self.ends[low[alone]] = True
        self.ends[:-1] &= LEAD[self.joined]  # only between characters
        self.lead = np.concatenate(([0], np.cumsum(LEAD[self.joined])))
        self.hashes, start, stop, first, _ = words(texts)
        self.owner = np.repeat(np.arange(len(texts)), np.diff(first))
        self.start, self.stop = start - self.owner, stop - self.owner  # words() puts a blank after each text
        self.first = first

    def rows(self, text: np.ndarray, start: np.ndarray, stop: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, place, word, d1, d2) of parts by their bytes: place holds where a part starts and stops in characters, word the number of words that begin before, in 32 bits each."""
        base = self.bounds[text]
        place = (self.lead[start] - self.lead[base]) << 32 | (self.lead[stop] - self.lead[base])
        word = (np.searchsorted(self.start, start) - self.first[text]) << 32 | (np.searchsorted(self.start, stop) - self.first[text])
        return text, place, word, one.view(np.int64), (two >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n consecutive words, at the place of the first, from running sums; of as many places as there are."""
    step = np.uint64(0x9E3779B97F4A7C15)
    up = np.full(len(hashes), step, np.uint64)
    down = np.full(len(hashes), pow(int(step), -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes * np.cumprod(up))))
    return mix((sums[n:] - sums[:-n]) * np.cumprod(down)[: len(sums) - n])


def chunks(t: Texts) -> tuple[np.ndarray, ...]:
    """(text, place, word, d1, d2) of every chunk."""
    ends = t.ends.copy()
    ends[t.bounds] = True
    ends[0] = False
    stop = np.flatnonzero(ends)
    start = np.concatenate(([0], stop[:-1])) if len(stop) else stop
    parts = -(-(stop - start) // MOST)
    if (parts > 1).any():
        stop = np.repeat(stop, parts)
        start = np.repeat(start, parts) + MOST * (np.arange(len(stop)) - np.repeat(np.cumsum(parts) - parts, parts))
        after = np.concatenate((LEAD[t.joined], [True]))
        while not after[start].all():
            start = start + ~after[start]
        stop = np.append(np.minimum(stop[:-1], start[1:]), stop[-1:])
    one = hashed(t.joined, start, stop)
    return t.rows(np.searchsorted(t.bounds, start, "right") - 1, start, stop, one, hashed(t.joined, start, stop, _OTHER))


def grams(t: Texts, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, ...]:
    """The same of the least_words words with the least hash in every PASSAGE words without ends least_words apart."""
    whole = np.flatnonzero(t.owner[: max(0, len(t.owner) - PASSAGE + 1)] == t.owner[PASSAGE - 1 :])
    at = np.flatnonzero(t.ends)
    left = np.append(at, len(t.joined))[np.searchsorted(at, t.start[whole] + WINDOW + LEAST - 1)]  # the bytes that an end depends on lie in the passage
    right = np.append(0, at)[np.searchsorted(at, t.stop[whole + PASSAGE - 1], "right")]
    few = whole[np.searchsorted(t.start, right) - np.searchsorted(t.start, left) < least_words]
    if not len(few):
        none = np.zeros(0, np.int64)
        return t.rows(none, none, none, none.view(np.uint64), none.view(np.uint64))
    h = _rolled(t.hashes, least_words)
    span = PASSAGE - least_words + 1
    # of equal hashes the one at a multiple of span, so that a run of one word gives few
    ranked = h & ~np.uint64(31) | (np.arange(len(h)) % span).astype(np.uint64)
    best = np.zeros(len(few), np.int64)
    for k in range(1, span):
        best = np.where(ranked[few + k] < ranked[few + best], k, best)
    k = np.unique(few + best)
    start, stop = t.start[k], t.stop[k + least_words - 1]
    return t.rows(t.owner[k], start, stop, h[k], hashed(t.joined, start, stop, _OTHER))


def chunked(docs: DataFrame, id_col: str, text_col: str, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc, place, word, d1, d2) of every chunk, and of the words compared where ends are few, of documents that have an id."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = utf8(batch.column(1))
            ids = batch.column(0)
            for a, b in blocks(texts):
                t = Texts(texts[a:b])
                text, *rest = map(np.concatenate, zip(chunks(t), grams(t, least_words), strict=True))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).take(pa.array(text)), *map(pa.array, rest)], ["doc", "place", "word", "d1", "d2"])

        return each

    return arrow_map(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), text_col), make, "doc long, place long, word long, d1 long, d2 int")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, start, stop, n_words, kept_in, kept): the passages that documents share.

    kept false: all of it is in earlier documents, the longest chunk in kept_in.
    kept true: this document is the first to hold some of it.
    """
    if not 1 < least_words <= PASSAGE:
        raise ValueError(f"least_words must be from 2 to {PASSAGE}")
    every = written(chunked(docs, id_col, text_col, least_words))
    held = every.groupBy("d1", "d2").agg(F.min("doc").alias("keeper"), F.max("doc").alias("last"), F.count("*").alias("n")).where("keeper < last")
    first = written(held.select("d1", "d2", "keeper", "n"))
    limit = max(10_000, every.count() // HOT)
    hot = first.where(F.col("n") > limit).drop("n")
    taken = every.join(first.where(F.col("n") <= limit).drop("n"), ["d1", "d2"])
    if not hot.isEmpty():
        taken = taken.unionByName(every.join(F.broadcast(hot), ["d1", "d2"]))  # at most HOT rows
    parts = lambda c, a, b: (F.shiftright(c, 32).alias(a), F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)).alias(b))
    placed = taken.select("doc", "keeper", *parts("place", "start", "stop"), *parts("word", "word", "upto")).repartition("doc")

    # runs of what others keep, and runs of all, in one pass over a document
    other = F.col("keeper") < F.col("doc")
    by_place = Window.partitionBy("doc").orderBy("start", "stop")
    before, upto_here = by_place.rowsBetween(Window.unboundedPreceding, -1), by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = {"all": F.col("start") > F.coalesce(F.max("stop").over(before), F.lit(-1)), "other": other & (F.col("start") > F.coalesce(F.max(F.when(other, F.col("stop"))).over(before), F.lit(-1)))}
    numbered = placed.withColumns({f"new_{k}": v.cast("int") for k, v in begins.items()}).withColumns({f"run_{k}": F.sum(f"new_{k}").over(upto_here) for k in begins})
    each = numbered.withColumn("r", F.explode(F.expr("CASE WHEN keeper < doc THEN array(struct(true AS whole, run_all AS run), struct(false AS whole, run_other AS run)) ELSE array(struct(true AS whole, run_all AS run)) END")))
    keeper = F.max_by("keeper", F.struct(F.col("stop") - F.col("start"), "start")).alias("by")
    runs = each.groupBy("doc", "r").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("word").alias("word"), F.max("upto").alias("upto"), F.max(F.col("keeper") == F.col("doc")).alias("kept"), keeper)
    both = runs.where(F.col("upto") - F.col("word") >= least_words).where("kept = r.whole")
    return both.select(F.col("doc").alias(id_col), F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), (F.col("upto") - F.col("word")).alias("n_words"), F.expr("CASE WHEN kept THEN doc ELSE by END").alias("kept_in"), "kept")


@carries
def cut_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """docs without the repeated passages of each text that another document keeps."""
    spans = written(repeats(docs, id_col, text_col, least_words).where("NOT kept")).groupBy(F.col(id_col).alias("_op_id")).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("_op_cuts"))
    joined = docs.join(spans, F.col(id_col) == F.col("_op_id"), "left")
    step = f"(a, s) -> named_struct('at', greatest(a.at, s.stop), 'out', concat(a.out, substring(`{text_col}`, a.at + 1, greatest(s.start - a.at, 0))))"
    new = f"aggregate(_op_cuts, named_struct('at', 0, 'out', ''), {step}, a -> concat(a.out, substring(`{text_col}`, a.at + 1)))"
    return joined.withColumn(text_col, F.expr(f"CASE WHEN _op_cuts IS NULL THEN `{text_col}` ELSE {new} END")).select(*docs.columns)
