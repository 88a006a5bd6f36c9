"""Operator 1: mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to). A flow routes the words of the patterns to the quotas of the sources; each
further repetition of a pattern's words costs more than the one before, so the
cost is convex and words are repeated as late as possible. What flows through a
pattern is turned into documents: all of them for each full repetition, and for
the rest those whose seeded hash is least, found by histograms of the hash, so
that no window holds more than a sliver of a pattern.

Only sums for each pattern come to the driver; more than `most_patterns` are
refused with an error, never cut off.

Defined results: null and empty texts have no words and are never taken; a null
source is a source of its own, the last; a document without any source belongs
to the null source; rows that repeat id and text share a hash and are taken
alike; an empty table gives an empty result; further columns don't matter, but
for one named times, which `taken` replaces.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import WORD, carries, small_side, written

SEED = 20_240_601
WEIGHTS = (5.0, 2.0, 1.0)
#: The words of the mix, as a share of all words, and the most times that any word is taken.
SHARE, REPEATS = 1.5, 2


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> dict[str | None, float]:
    """The words each source is to give: by weight, at most `repeats` times its size, the excess reshared by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, open_ = share * sum(sizes.values()), list(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if unit * weight[s] > repeats * sizes[s]]
        if not above:
            return out | {s: unit * weight[s] for s in open_}
        for s in above:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def routed(patterns: dict[tuple, int], quotas: dict[str | None, int], repeats: int = REPEATS) -> dict[tuple, dict[str | None, int]]:
    """Words from each pattern to each of its sources: a flow as large as can be, of least repetition cost.

    A path may use a pattern's n-th repetition at cost n - 1. Augmenting all
    paths of cost 0, then of cost 1, and so on gives a flow of least cost, as
    rerouting between patterns and sources costs nothing.
    """
    keys, names = list(patterns), list(quotas)
    number = {s: len(keys) + k for k, s in enumerate(names)}
    flow: dict[tuple[int, int], int] = {}
    use, left = [0] * len(keys), {number[s]: q for s, q in quotas.items()}
    member: list[list[int]] = [[number[s] for s in p] for p in keys]
    takers: dict[int, set[int]] = {n: set() for n in left}  # patterns that send words to a source
    for turn in range(1, repeats + 1):
        while True:
            before: dict[int, int] = {k: -1 for k in range(len(keys)) if use[k] < turn * patterns[keys[k]]}
            queue, end = deque(before), None
            while queue and end is None:
                at = queue.popleft()
                for to in member[at] if at < len(keys) else takers[at]:
                    if to not in before:
                        before[to] = at
                        if to >= len(keys) and left[to] > 0:
                            end = to
                            break
                        queue.append(to)
            if end is None:
                break
            path = [end]
            while before[path[-1]] >= 0:
                path.append(before[path[-1]])
            path.reverse()
            amount = min(left[end], turn * patterns[keys[path[0]]] - use[path[0]], *(flow[b, a] for a, b in zip(path, path[1:], strict=False) if a >= len(keys)))
            for a, b in zip(path, path[1:], strict=False):
                if a < len(keys):
                    flow[a, b] = flow.get((a, b), 0) + amount
                    takers[b].add(a)
                else:
                    flow[b, a] -= amount
                    if not flow[b, a]:
                        takers[a].discard(b)
            use[path[0]] += amount
            left[end] -= amount
    return {p: {s: flow[k, number[s]] for s in p if flow.get((k, number[s]))} for k, p in enumerate(keys)}


def _marked(docs: DataFrame, id_col: str, text_col: str, sources: Column | None, seed: int) -> dict[str, Column]:
    """The helper columns of a document: _op_members (its sources), _op_size (words) and _op_h (its seeded hash)."""
    members = F.array(F.col("source")) if sources is None else sources
    members = F.when(F.size(members) > 0, F.array_distinct(members)).otherwise(F.array(F.lit(None).cast("string")))
    return {"_op_members": F.array_sort(members), "_op_size": word_count(F.col(text_col)), "_op_h": F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))}


def _planned(facts: DataFrame, weights: tuple[float, ...], share: float, repeats: int, most_patterns: int) -> tuple[DataFrame, dict[str | None, int], dict[str | None, float]]:
    """What each pattern gives: full repetitions, and the place in the order of hashes up to which documents are taken once more; the words of each source and the targets. facts: members, size, h."""
    spark = facts.sparkSession
    rows = facts.groupBy("members").agg(F.sum("size").alias("size")).limit(most_patterns + 1).collect()
    if len(rows) > most_patterns:
        raise ValueError(f"more than {most_patterns} membership patterns")
    patterns = {tuple(r.members): int(r.size or 0) for r in rows}
    sizes: dict[str | None, int] = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    # a document of several sources counts in full for each, but its words are in the corpus once
    goal = targets(sizes, weights, share * sum(patterns.values()) / max(sum(sizes.values()), 1), repeats)
    flow = routed(patterns, {s: round(t) for s, t in goal.items()}, repeats)
    plan = []
    for p, n in patterns.items():
        total = sum(flow[p].values())
        full = min(total // n, repeats) if n else 0
        plan.append((list(p), full, total - full * n))
    schema = "members array<string>, full int, rest long"
    table = spark.createDataFrame(plan, schema) if plan else spark.createDataFrame([], schema)
    cut = _cuts(facts, table)
    return cut.select(*(F.col(c).alias(f"_op_p_{c}") for c in cut.columns)), sizes, goal


def _timed(rows: DataFrame, cut: DataFrame, members: str, h: str, name: str) -> DataFrame:
    """rows with the times each is taken; they meet what their pattern gives by a broadcast, so that no text is moved."""
    h1, h2, low = _parts(F.col(h))
    b1, b2, last = (F.col(f"_op_p_{c}") for c in ("b1", "b2", "low"))
    extra = (h1 < b1) | ((h1 == b1) & ((h2 < b2) | ((h2 == b2) & (low <= last))))
    out = rows.join(F.broadcast(cut), F.col(members).eqNullSafe(F.col("_op_p_members")), "left")  # a row for each pattern: at most most_patterns
    return out.withColumn(name, F.col("_op_p_full") + F.coalesce(extra, F.lit(False)).cast("int")).drop(*cut.columns)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED, most_patterns: int = 50_000) -> tuple[DataFrame, dict[str | None, int], dict[str | None, float]]:
    """The documents with size, members (their sources) and times taken, the words of each source and the targets.

    sources: an array of the sources of a document; by default its column source.
    """
    marks = _marked(docs, id_col, text_col, sources, seed)
    facts = written(docs.select(F.col(id_col), *(c.alias(k.removeprefix("_op_")) for k, c in marks.items())))
    cut, sizes, goal = _planned(facts, weights, share, repeats, most_patterns)
    return _timed(facts, cut, "members", "h", "times").select(id_col, "members", "size", "h", "times"), sizes, goal


def _parts(h: Column) -> tuple[Column, Column, Column]:
    """The upper 12, the next 12 and the lower 40 bits."""
    return F.shiftrightunsigned(h, 52), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(4095)), h.bitwiseAND(F.lit((1 << 40) - 1))


def _cuts(facts: DataFrame, plan: DataFrame) -> DataFrame:
    """For each pattern the place in the order of hashes up to which documents are taken once more: b1, b2, low."""
    h1, h2, low = _parts(F.col("h"))

    def edge(rows: DataFrame, want: DataFrame, by: Column, name: str) -> DataFrame:
        """(members, name, left): the bin in which the running size reaches what is wanted, and what is left of that before it."""
        held = rows.groupBy(F.col("members").alias("m"), by.alias(name)).agg(F.sum("size").alias("size"))
        run = held.withColumn("upto", F.sum("size").over(Window.partitionBy("m").orderBy(name)))
        hit = run.join(F.broadcast(want), F.col("m").eqNullSafe(F.col("members"))).where("left > upto - size AND left <= upto")
        return hit.select("members", name, (F.col("left") - F.col("upto") + F.col("size")).alias("left"))

    first = small_side(edge(facts, plan.where("rest > 0").select("members", F.col("rest").alias("left")), h1, "b1"))
    in_first = _matching(facts, first.select("members", "b1")).where(h1 == F.col("b1")).drop("b1")
    second = small_side(edge(in_first, first.drop("b1"), h2, "b2"))
    in_second = _matching(in_first, second.select("members", "b2", "left")).where(h2 == F.col("b2"))
    run = in_second.withColumn("upto", F.sum("size").over(Window.partitionBy("members").orderBy("h").rangeBetween(Window.unboundedPreceding, 0)))
    last = small_side(run.where("2 * (upto - size) + size <= 2 * left").groupBy("members").agg(F.max(low).alias("low")))
    out = plan
    for part in (first.drop("left"), second.drop("left"), last):
        renamed = part.withColumnRenamed("members", "m")
        out = out.join(renamed, F.col("members").eqNullSafe(F.col("m")), "left").drop("m")
    return small_side(out.select("members", "full", F.when(F.col("rest") > 0, F.col("b1")).otherwise(-1).alias("b1"), F.coalesce("b2", F.lit(-1)).alias("b2"), F.coalesce("low", F.lit(-1)).alias("low")))


def _matching(facts: DataFrame, small: DataFrame) -> DataFrame:
    renamed = small.withColumnRenamed("members", "m")
    return facts.join(F.broadcast(renamed), F.col("members").eqNullSafe(F.col("m"))).drop("m")


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, source_size, target, taken, times) of every row, by its column source."""
    mix, sizes, goal = mixed(docs.select(id_col, text_col, "source"), id_col, text_col)
    spark = docs.sparkSession
    rows = [(s, n, goal[s]) for s, n in sizes.items()]
    by_source = spark.createDataFrame(rows, "source string, source_size long, target double")
    out = mix.join(F.broadcast(by_source), F.col("members")[0].eqNullSafe(F.col("source")), "left")  # at most a row for each pattern
    return out.select(id_col, "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


@carries
def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED, most_patterns: int = 50_000) -> DataFrame:
    """The rows of docs that the mix takes, with the number of times: a pass for the sums and one for the rows, no shuffle of texts."""
    marks = _marked(docs, id_col, text_col, None, seed)
    facts = written(docs.select(*(c.alias(k.removeprefix("_op_")) for k, c in marks.items())))
    cut, _, _ = _planned(facts, weights, share, repeats, most_patterns)
    timed = _timed(docs.withColumns(marks), cut, "_op_members", "_op_h", "_op_times").where("_op_times > 0 AND _op_size > 0")
    return timed.select(*(c for c in docs.columns if c != "times"), F.col("_op_times").alias("times"))
