"""Operator 10: quality rules with adaptive thresholds.

Each text gets counts of words, symbols, lines and repetitions. For every
language and source a quantile sketch of each rate is kept: the rates fall into
logarithmic buckets, and a sketch is the count of each bucket, so sketches of
parts are merged by adding counts, in any order, with the same result. Fences
on both sides are read off the sketches, on the logarithm of the rate: the upper
one stands SPREAD times as far above the 0.9 quantile as that above the median,
and a bucket's width (the sketch's own error) further; the lower one likewise
below the 0.1 quantile. A group's fences are drawn towards those of the merged
sketch of all groups as if PRIOR documents more had the latter. Where the upper
tail of a group is longer than all others' and its lower tail doesn't bear that
out, as when a tenth of a source is junk, the merged fence holds.

The fences are joined to the documents. A document is rejected if a rate lies
beyond a fence by more than two standard deviations of a count of its size, so
that chance in a short text doesn't count.

Defined results: null and empty texts have no words and fail the base rules;
a null language or source is a group of its own; repeated rows each count and
each give a row; an empty table gives an empty result; only the named columns
are read for the verdict, and others are carried only by `filtered`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import LEAD, arrow_map, blocks, carries, small_side, utf8, windows, words, written

#: The relative width of a bucket of the sketches.
GAMMA = 1.05
#: Rates below this have a bucket each.
EXACT = 32
#: Rate: what is counted, and for a thousand of what.
RULES = {"symbol_rate": ("n_symbols", "n_words"), "dup_line_rate": ("n_dup_lines", "n_lines"), "repeat_rate": ("n_repeat_words", "n_words"), "stutter_rate": ("n_stutters", "n_words"), "shout_rate": ("n_shouts", "n_words"), "capital_rate": ("n_capitals", "n_letters"), "length_rate": ("word_chars", "n_words")}
#: How far a fence stands from a quantile, in distances of the quantile to the median; the same for all rules.
SPREAD = 2.5
#: The documents with the merged fence that each group is given.
PRIOR = 10
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutters", "n_shouts", "n_capitals", "n_letters"]


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _SHOUT = _class(b"#*$%&|<>"), _class(b"!")
_CAPITAL, _LETTER = _class(bytes(range(65, 91))), _class(bytes([*range(65, 91), *range(97, 123)]))


def _per_text(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(marks)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """COUNTS of each text, for a block of texts."""
    hashes, start, end, first, joined = words(texts)
    bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))
    n = np.diff(first)
    lead = np.concatenate(([0], np.cumsum(LEAD[joined])))
    chars = np.concatenate(([0], np.cumsum(lead[end] - lead[start])))
    owner = np.repeat(np.arange(len(texts)), n)
    repeated = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) >= 5:
        whole = np.flatnonzero(owner[:-4] == owner[4:])
        key = windows(hashes)[whole] ^ (owner[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(whole), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = whole[twice]
        np.add.at(repeated, at, 1)
        np.add.at(repeated, at + 5, -1)
    covered = np.cumsum(repeated[:-1]) > 0
    stutter = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        stutter[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    dup, lines = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        if b"\n" in text:
            with_word = [x for x in text.split(b"\n") if x and not x.isspace()]
            lines[k], dup[k] = len(with_word), len(with_word) - len(set(with_word))
        else:
            lines[k] = n[k] > 0
    return {
        "n_words": n, "word_chars": chars[first[1:]] - chars[first[:-1]], "n_symbols": _per_text(_SYMBOL[joined], bounds), "n_dup_lines": dup,
        "n_repeat_words": _per_text(covered, first), "n_lines": lines, "n_stutters": _per_text(stutter, first), "n_shouts": _per_text(_SHOUT[joined], bounds),
        "n_capitals": _per_text(_CAPITAL[joined], bounds), "n_letters": _per_text(_LETTER[joined], bounds),
    }


def with_counts(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with COUNTS as further columns (named _op_q_..., as all helpers of these operators begin with _op_); without the text if it isn't to be kept."""
    columns = [c for c in docs.columns if keep_text or c != text_col]
    at = docs.columns.index(text_col)
    kept = [docs.columns.index(c) for c in columns]

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = utf8(batch.column(at))
            for a, b in blocks(texts):
                counts = measure(texts[a:b])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(k) for k in kept] + [pa.array(counts[c], pa.int64()) for c in COUNTS], [*columns, *(f"_op_q_{c}" for c in COUNTS)])

        return each

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns] + [f"_op_q_{c} long" for c in COUNTS]
    return arrow_map(docs, make, ", ".join(fields))


def rate_sql(rule: str, count: str = "{}", prefix: str = "_op_q_", div: str = "div") -> str:
    """The rate of a rule, in thousandths, from the columns of with_counts; count: an expression over the count."""
    part, whole = (prefix + c for c in RULES[rule])
    return f"1000 * ({count.format(part)}) {div} greatest({whole}, 1)"


#: What a count surely is at least and at most: two standard deviations of a count of its size off.
SURELY, AT_MOST = "greatest({0} - CAST(ceil(2 * sqrt({0})) AS BIGINT), 0)", "{0} + CAST(ceil(2 * sqrt({0})) AS BIGINT) + 1"


def bucket(rate: Column) -> Column:
    return F.when(rate < EXACT, rate).otherwise(F.floor(F.log(rate.cast("double")) / F.lit(math.log(GAMMA))) + 1000).cast("int")


def middle(at: Column) -> Column:
    """The rate that stands for a bucket."""
    return F.when(at < EXACT, at.cast("double")).otherwise(F.exp((at - 1000 + F.lit(0.5)) * F.lit(math.log(GAMMA))))


def sketches(counted: DataFrame, by: list[str]) -> DataFrame:
    """(by..., rule, bucket, n): the sketch of each group and rule. Sketches of parts are merged by summing n."""
    pairs = F.array(*(F.struct(F.lit(k).alias("rule"), bucket(v).alias("bucket")) for k, v in ((k, F.expr(rate_sql(k))) for k in RULES)))
    return counted.where("_op_q_n_words > 0").select(*by, F.explode(pairs).alias("p")).groupBy(*by, "p.rule", "p.bucket").agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by..., rule, rows, low, mid, high): the logarithms of one more than the 0.1, 0.5 and 0.9 quantiles of each group and rule."""
    keys = [*by, "rule"]
    run = Window.partitionBy(*keys).orderBy("bucket")  # a row for each bucket, some 300 for a rule
    at = sketch.withColumn("upto", F.sum("n").over(run)).withColumn("rows", F.sum("n").over(Window.partitionBy(*keys)))
    tenth = lambda k: F.log(1 + middle(F.min(F.when(F.col("upto") * 10 >= F.col("rows") * k, F.col("bucket")))))
    return at.groupBy(*keys).agg(F.max("rows").alias("rows"), tenth(1).alias("low"), tenth(5).alias("mid"), tenth(9).alias("high"))


#: The fences of a group by its own sketch, and with what the merged sketch says (m_upper, m_lower), as SQL over the columns of _quantiles.
UPPER, LOWER = f"high + {SPREAD} * (high - mid)", f"low - {SPREAD} * (mid - low)"
UPPER_OF = f"least((rows * ({UPPER}) + {PRIOR} * m_upper) / (rows + {PRIOR}), greatest(m_upper, mid + {SPREAD} * (mid - low)))"
LOWER_OF = f"(rows * ({LOWER}) + {PRIOR} * m_lower) / (rows + {PRIOR})"


def fence_sql(of: str, side: int) -> str:
    """The rate of a fence, between thousandths, which no rate hits; side: 1 upper, -1 lower."""
    return f"round(exp({of} + {side} * ln({GAMMA})) - 1, 3) + {side} * 0.0005"


def thresholds(counted: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group (null-safe keys _op_g_0, _op_g_1, ...) with the fences _op_hi_<rule> and _op_lo_<rule>."""
    sketch = written(sketches(counted, by))
    merged = _quantiles(sketch.groupBy("rule", "bucket").agg(F.sum("n").alias("n")), []).select("rule", F.expr(UPPER).alias("m_upper"), F.expr(LOWER).alias("m_lower"))
    own = _quantiles(sketch, by).join(F.broadcast(merged), "rule")  # a row for each rule: at most len(RULES)
    sides = own.select(*by, "rule", F.expr(fence_sql(UPPER_OF, 1)).alias("hi"), F.expr(fence_sql(LOWER_OF, -1)).alias("lo"))
    each = (F.max(F.when(F.col("rule") == k, F.col(s))).alias(f"_op_{s}_{k}") for k in RULES for s in ("hi", "lo"))
    return sides.groupBy(*by).agg(*each).select(*(F.col(c).alias(f"_op_g_{k}") for k, c in enumerate(by)), *(f"_op_{s}_{k}" for k in RULES for s in ("hi", "lo")))


def judged(counted: DataFrame, limits: DataFrame, by: list[str]) -> DataFrame:
    """counted with _op_base_failed and _op_kept."""
    base = F.expr("_op_q_n_words < 10 OR 100 * _op_q_n_repeat_words > 20 * _op_q_n_words")
    match = F.lit(True)
    for k, c in enumerate(by):
        match = match & counted[c].eqNullSafe(limits[f"_op_g_{k}"])
    beyond = " OR ".join(f"{rate_sql(k, SURELY)} > _op_hi_{k} OR {rate_sql(k, AT_MOST)} < _op_lo_{k}" for k in RULES)
    return counted.join(limits, match, "left").withColumn("_op_base_failed", base).withColumn("_op_kept", ~base & ~F.coalesce(F.expr(beyond), F.lit(False))).drop(*limits.columns)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(id, counts, base_failed, kept) of every row."""
    counted = written(with_counts(docs.select(id_col, *by, text_col), text_col, keep_text=False))
    found = judged(counted, small_side(thresholds(counted, list(by))), list(by))
    return found.select(id_col, *(F.col(f"_op_q_{c}").alias(c) for c in COUNTS), F.col("_op_base_failed").alias("base_failed"), F.col("_op_kept").alias("kept"))


@carries
def filtered(docs: DataFrame, text_col: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The rows of docs that are kept, with their columns: one pass for the sketches and one for the verdicts, no shuffle of texts."""
    limits = small_side(thresholds(written(with_counts(docs.select(*by, text_col), text_col, keep_text=False)), list(by)))
    return judged(with_counts(docs, text_col), limits, list(by)).where("_op_kept").select(*docs.columns)
