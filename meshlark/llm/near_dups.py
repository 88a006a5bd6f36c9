"""Operator 4: near-duplicates by SuperMinHash, banding, verification and union-find.

1. Each text becomes its set of hashed word shingles, a digest of the set, and a
   SuperMinHash signature: every element walks a pseudo-random permutation of the
   slots and offers its j-th slot a value of rank j; the walk stops once no slot
   can fall further. Ranks of an element are correlated, so estimates vary less
   than with independent hashes.
2. Equal sets form classes; only one document of each class goes on.
3. Signatures are cut into bands; equal bands put classes into a bucket.
4. Small buckets give their pairs, no more in all than a fixed number for each
   class. A larger one is compared with a hub only, the class that meets the most others: what isn't linked to the
   hub can be linked to anything else only by sharing shingles outside the hub
   (or, if shorter than the hub, by the counts in `_corner`), so these shingles
   are the keys of new buckets, and the rest follows in rounds until no bucket
   holds two components. From the second round on, pairs that the small buckets
   leave of the budget go to further hubs: members that are compared with all
   others of their hub and then leave, so that many unlike copies of one text
   don't take a round for each. No pair of a bucket is lost, and pairs grow with
   the documents, not with the squares of the groups.
5. Links are confirmed on the full sets; components are joined by union-find.

A pair that meets the threshold is missed only if no band agrees: 4e-7 at
similarity 0.85 and 5e-5 at 0.8 with 25 bands of 5.

Defined results: null and empty texts, and texts without words, have no
shingles, are linked with nothing and are their own component; fewer words than
a shingle give one shingle; rows that repeat an id share its component; a row
without an id takes the component of its class if that has an id, else none;
further columns are carried by `deduplicated` only.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .shared import arrow_map, blocks, carries, mix, small_side, spread_join, utf8, windows, words, written

WIDTH = 5
BANDS, ROWS = 25, 5
SLOTS = BANDS * ROWS
#: Buckets of at most so many classes give all their pairs in any case.
SMALL = 16
#: Rows of one key that go to one task, about.
PART_ROWS = 1000
#: Classes link if PART * intersection >= whole * union; WHOLE is the usual threshold.
PART, WHOLE = 100, 85


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, text by text and sorted, and where each text's begin (and the end)."""
    hashes, _, _, first, _ = words([t.lower() for t in texts])  # bytes.lower changes A-Z only
    count = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), count)
    parts, owners = [], []
    if len(hashes) >= width:
        whole = np.flatnonzero(owner[: len(owner) - width + 1] == owner[width - 1 :])
        parts.append(windows(hashes, width)[whole])
        owners.append(owner[whole])
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for k in range(width - 1):
            there = count[few] > k
            short[there] = mix(short[there] * np.uint64(0xA0761D6478BD642F) + hashes[first[few[there]] + k] + np.uint64(k + 1))
        parts.append(short)
        owners.append(few)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    h, o = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[new], o[new]
    return h, np.searchsorted(o, np.arange(len(texts) + 1))


def superminhash(h: np.ndarray, begin: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """A row of `slots` values for each set; sets lie one after the other in h. Empty sets keep the highest value."""
    n = len(begin) - 1
    out = np.full((n, slots), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(n), np.diff(begin))
    low = np.uint64((1 << 24) - 1)
    order: np.ndarray | None = None
    for j in range(slots):
        if j:
            active = (out >> np.uint64(40)).max(axis=1) >= j  # some slot could still take a value of rank j
            active[np.diff(begin) == 0] = False
            stay = active[owner]
            if not stay.any():
                break
            if order is None:
                order = np.broadcast_to(np.arange(slots, dtype=np.uint8), (int(stay.sum()), slots)).copy()
                at = np.arange(len(order))
                order[at, k[stay]] = 0  # the swap of rank 0
                order[:, 0] = k[stay]
            elif not stay.all():
                order = order[stay]
            h, owner = h[stay], owner[stay]
        r = mix(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = (j + ((r & low) * np.uint64(slots - j) >> np.uint64(24)).astype(np.int64)).astype(np.int64)
        if order is None:
            slot = k
        else:
            at = np.arange(len(h))
            slot = order[at, k].astype(np.int64)
            order[at, k] = order[:, j]
            order[:, j] = slot
        np.minimum.at(flat, owner * slots + slot, np.uint64(j << 40) | (r >> np.uint64(24)))
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """The hash of each band of each signature."""
    n, slots = signature.shape
    parts = signature.reshape(n, bands, slots // bands)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
    for k in range(parts.shape[2]):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + parts[:, :, k])
    return key.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, n, digest, bands) of every row; th is a hash of the text."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = utf8(batch.column(2))
            for a, b in blocks(texts):
                h, begin = shingle_sets(texts[a:b])
                keys = band_keys(superminhash(h, begin))
                n = np.diff(begin)
                digest = [blake2b(h[begin[k] : begin[k + 1]].tobytes(), digest_size=16).digest() if n[k] else None for k in range(b - a)]
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * BANDS, BANDS), pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), bands], ["doc", "th", "n", "digest", "bands"])

        return each

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col)), make, "doc long, th long, n long, digest binary, bands array<long>")


def _parts(size: str) -> str:
    """Into how many parts the rows of a key are dealt, by their number."""
    return f"CAST(ceil({size} / {PART_ROWS}) AS INT)"


def _dealt(rows: DataFrame, by: str, size: str = "size") -> DataFrame:
    """rows with the part that each goes to; size: the number of rows of its key."""
    return rows.withColumn("part", F.expr(f"pmod(xxhash64({by}), {_parts(size)})"))


def _to_all(keyed: DataFrame, size: str = "size") -> DataFrame:
    """A copy of each row for every part of its key."""
    return keyed.withColumn("part", F.explode(F.expr(f"sequence(0L, {_parts(size)} - 1L)")))


def _compared(pairs: DataFrame, texts: DataFrame, whole: int) -> DataFrame:
    """pairs (a, b) with na, nb, both (the size of the intersection) and own, the shingles of b outside a that come first in the order of hashes, as many as decide.

    The text of a hub goes to as many tasks as its members fill.
    """
    pairs = written(pairs.select("a", "b", "hub"))
    met = written(pairs.groupBy("a").agg(F.count("*").alias("size")))
    dealt = _dealt(spread_join(pairs, met, "a", "size"), "b")
    ta = _to_all(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")).join(met, "a")).drop("size")
    tb = texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))
    joined = dealt.join(tb, "b").join(ta, ["a", "part"]).select("a", "b", "hub", "text_a", "text_b")

    def make():
        last: list = [None, None]

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            a, hub = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            of_a, of_b = utf8(batch.column(3)), utf8(batch.column(4))
            for x, y in blocks(of_b):
                h, begin = shingle_sets(of_b[x:y])
                na, nb, both, own = [], [], [], []
                for k in range(x, y):
                    if last[0] != a[k]:
                        last[:] = [a[k], shingle_sets([of_a[k]])[0]]
                    mine = h[begin[k - x] : begin[k - x + 1]]
                    there = np.isin(mine, last[1], assume_unique=True)
                    r = int(there.sum())
                    na.append(len(last[1]))
                    nb.append(len(mine))
                    both.append(r)
                    outside = mine[~there]
                    # a partner shares at least whole/PART of b's shingles with b, at most r of them inside a
                    need = max(1, -(-whole * len(mine) // PART) - r)
                    own.append(outside[: max(0, len(outside) - need + 1)].view(np.int64) if hub[k] else [])
                part = batch.slice(x, y - x)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(na, pa.int64()), pa.array(nb, pa.int64()), pa.array(both, pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["a", "b", "hub", "na", "nb", "shared", "own"])

        return each

    return arrow_map(joined, make, "a long, b long, hub boolean, na long, nb long, shared long, own array<long>")


def _linked(whole: int) -> str:
    return f"{PART} * shared >= {whole} * (na + nb - shared)"


def _corner(hub_pairs: DataFrame, whole: int) -> DataFrame | None:
    """Pairs of a hub's members, one of them not linked to it, that can be linked without sharing a shingle outside the hub; None if there are none.

    With p shingles outside the hub and q of the hub's missing, such a pair
    differs in at least p1 + p2 + |q1 - q2| shingles. That is few enough only if
    the partner is shorter than the hub, by what the first is too far from it.
    Both sides are dealt over the tasks by their numbers, not by the hub alone.
    """
    m = hub_pairs.select("a", F.col("b").alias("c"), F.col("nb").alias("n"), (F.col("nb") - F.col("shared")).alias("p"), (F.col("na") - F.col("shared")).alias("q"), (F.col("na") - F.col("nb")).alias("short"), F.expr(_linked(whole)).alias("linked"))
    slack = PART + whole, PART - whole
    span = written(m.groupBy("a").agg(F.max("short").alias("most_short"), F.max("n").alias("most_n"), F.count("*").alias("size")))
    spanned = spread_join(m, span, "a", "size")
    near = written(spanned.where(f"NOT linked AND {slack[0]} * (p + q - most_short) <= {slack[1]} * (n + most_n)").drop("most_short", "most_n"))
    if near.isEmpty():
        return None
    x, y = _dealt(near, "c").alias("x"), _to_all(spanned.where("short > 0")).alias("y")
    met = x.join(y, (F.col("x.a") == F.col("y.a")) & (F.col("x.part") == F.col("y.part")) & F.expr(f"x.c <> y.c AND {slack[0]} * (x.p + y.p + abs(x.q - y.q)) <= {slack[1]} * (x.n + y.n)"))
    return met.select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct()


def _pairs(members: DataFrame, whole: int) -> DataFrame:
    """The pairs of different components in buckets of members (key, cid, n, component, size) whose sizes allow a link."""
    x, y = _dealt(members, "cid").alias("x"), _to_all(members).alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & F.expr(f"x.cid < y.cid AND x.component <> y.component AND {PART} * least(x.n, y.n) >= {whole} * greatest(x.n, y.n)"))
    return met.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()


def _with_components(members: DataFrame, found: DataFrame | None) -> DataFrame:
    """members whose buckets hold more than one component, with component and the bucket's size."""
    if found is None:
        named = members.withColumn("component", F.col("cid"))
    else:
        named = written(members.join(found.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid")))
    mixed = written(named.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("key", "size"))
    return spread_join(named, mixed, "key", "size")


def _small(mixed: DataFrame, budget: int) -> int:
    """The size up to which buckets give all their pairs: SMALL, or more while the pairs of all buckets up to that size are at most `budget`, one for each class of the corpus."""
    sizes = mixed.groupBy("size").agg(F.expr("count(*) * (size - 1) div 2").alias("pairs"))
    upto = sizes.withColumn("total", F.sum("pairs").over(Window.orderBy("size"))).where(F.col("total") <= budget)  # a row for each size that occurs
    return max(SMALL, upto.agg(F.max("size")).first()[0] or 0)


def _hubs(big: DataFrame) -> DataFrame:
    """(a, b): each member b of a large bucket with the hub a of the bucket.

    A class meets as many others as its large buckets hold. A bucket takes the
    hub, of those of all large buckets its members are in, that meets the most.
    What is known of a bucket goes to as many tasks as its members fill.
    """
    met = big.groupBy("cid").agg(F.sum("size").alias("met"))
    ranked = _dealt(big.select("key", "cid", "size").join(met, "cid"), "cid")
    best = lambda rows, by: rows.groupBy(by).agg(F.max(F.struct("met", F.col("least"))).alias("best"))
    of_bucket = _to_all(best(ranked.withColumn("least", -F.col("cid")), "key").join(big.groupBy("key").agg(F.max("size").alias("size")), "key")).drop("size")
    dealt = _dealt(big.select("key", "cid", "size"), "cid")
    of_member = dealt.join(of_bucket, ["key", "part"]).select("cid", "best.met", "best.least").groupBy("cid").agg(F.max(F.struct("met", "least")).alias("best")).select("cid", "best.*")
    widened = _to_all(best(big.select("key", "cid").join(of_member, "cid"), "key").join(big.groupBy("key").agg(F.max("size").alias("size")), "key")).drop("size")
    return dealt.join(widened, ["key", "part"]).select((-F.col("best.least")).alias("a"), F.col("cid").alias("b")).where("a <> b").distinct()


def _further(hubs: DataFrame, mixed: DataFrame, most: int, whole: int) -> tuple[DataFrame, DataFrame] | None:
    """Further hubs (a, b) among the members b of each hub a, and the pairs (a, b) of them and the other members of a whose sizes and components allow a link; None if `most`, the number of pairs about, isn't enough for one.

    Every hub has as many of them, found by a hash; if its members are no more, all their pairs are there.
    """
    each = most // max(1, hubs.count())
    if each < 1:
        return None
    sized = written(hubs.groupBy("a").agg(F.count("*").alias("size")))
    told = mixed.select(F.col("cid").alias("b"), "n", "component").distinct()
    members = written(spread_join(hubs, sized, "a", "size").join(told, "b").select("a", "b", "n", "component", "size"))
    chosen = written(members.where(f"pmod(xxhash64(a, b), size) < {each}"))
    x, y = _dealt(members, "b").alias("x"), _to_all(chosen).alias("y")
    met = x.join(y, (F.col("x.a") == F.col("y.a")) & (F.col("x.part") == F.col("y.part")) & F.expr(f"x.component <> y.component AND {PART} * least(x.n, y.n) >= {whole} * greatest(x.n, y.n)"))
    return chosen.select("a", "b"), met.select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct()


def links(classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, whole: int = WHOLE) -> DataFrame:
    """(id, component) of the classes (cid, n, th, bands) that are linked to another."""
    spark = docs.sparkSession
    keyed = classes.select("cid", "n", F.explode("bands").alias("key"))
    shared_keys = written(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    members = written(spread_join(keyed, shared_keys, "key", "size").drop("size"))
    wanted = small_side(members.select("cid").distinct().join(classes.select("cid", "th"), "cid"))
    text = docs.select(F.col(id_col).cast("long").alias("cid"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    texts = written(text.join(wanted, ["cid", "th"]).dropDuplicates(["cid"]))
    budget = classes.count()
    found, edges, compared = None, None, None
    while True:
        mixed = written(_with_components(members, found))
        if mixed.isEmpty():
            break
        upto = _small(mixed, budget)
        hubs = written(_hubs(mixed.where(F.col("size") > upto)))
        if compared is not None and hubs.join(compared, ["a", "b"], "left_anti").isEmpty():
            # no hub is new to any member: the rounds would go on for ever, so what is left gives its pairs
            upto, hubs = mixed.agg(F.max("size")).first()[0], hubs.limit(0)
        small, further = _pairs(mixed.where(F.col("size") <= upto), whole), None
        if compared is not None and not hubs.isEmpty():
            small = written(small)
            further = _further(hubs, mixed, budget - small.count(), whole)
            if further is not None:
                small = small.union(further[1]).distinct()
        compared = hubs if compared is None else compared.union(hubs)
        small = small.withColumn("hub", F.lit(False))
        seen = written(_compared(small.union(hubs.withColumn("hub", F.lit(True))), texts, whole))
        hub_pairs = seen.where("hub")
        any_hub = not hub_pairs.isEmpty()
        more = seen.where(_linked(whole)).select("a", "b")
        corner = _corner(hub_pairs, whole) if any_hub else None
        if corner is not None:
            compared_too = written(_compared(corner.withColumn("hub", F.lit(False)), texts, whole))
            more = more.union(compared_too.where(_linked(whole)).select("a", "b"))
        more = written(more)
        if not more.isEmpty():
            edges = more if edges is None else edges.union(more)
            found = written(components(edges))
        if not any_hub:
            break
        if further is not None:
            hub_pairs = hub_pairs.join(further[0], ["a", "b"], "left_anti")
        next_ = hub_pairs.select("a", F.col("b").alias("cid"), F.col("nb").alias("n"), F.explode("own").alias("token")).select("cid", "n", F.xxhash64("a", "token").alias("key"))
        again = written(next_.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
        members = written(spread_join(next_, again, "key", "size").select("cid", "n", "key").distinct())
    return found if found is not None else spark.createDataFrame([], "id long, component long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: int = WHOLE) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row."""
    signed = written(signatures(docs, id_col, text_col))
    classes = written(signed.where("n > 0 AND doc IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc", "th", "n", "bands")).alias("r")).select("digest", F.col("r.doc").alias("cid"), "r.th", "r.n", "r.bands"))
    found = links(classes, docs, id_col, text_col, whole)
    of_class = classes.select("digest", "cid").join(found.withColumnRenamed("id", "cid"), "cid", "left").select("digest", F.coalesce("component", "cid").alias("component"))
    out = signed.select("doc", "n", "digest").join(of_class, "digest", "left").select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


@carries
def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: int = WHOLE) -> DataFrame:
    """The rows of docs without those whose group has a document of a lesser id; of rows that repeat an id one stays, rows without an id all stay."""
    kept = near_duplicates(docs, id_col, text_col, whole).where("kept").select(F.col(id_col).alias("_op_kept")).distinct()
    one = docs.where(F.col(id_col).isNotNull()).join(kept, F.col(id_col) == F.col("_op_kept"), "left_semi")
    return one.dropDuplicates([id_col]).unionByName(docs.where(F.col(id_col).isNull()))
