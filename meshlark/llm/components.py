"""Connected components of links between documents: union-find on one task's worth of links, alternating stars on tables beyond."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import spread_join, written

#: Up to so many links (some 300 MB) one task joins them.
FEW = 2_000_000


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v, m) for pairs (u, v): m is the least of u and all its v."""
    least = written(pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")))
    return spread_join(pairs, least, "u", "n").select("u", "v", "m")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of all links (u, v) of a task, by union-find on arrays; the least id is the root."""
    parts = [(np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches]
    u, v = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in (0, 1))
    ids = np.unique(np.concatenate((u, v)))
    u, v = np.searchsorted(ids, u), np.searchsorted(ids, v)
    root = np.arange(len(ids))
    while len(u):
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(root, up := root[root]):
            root = up
        u, v = root[u], root[v]
        apart = u != v
        u, v = u[apart], v[apart]
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ids[root], pa.int64())], ["id", "component"])


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """(id, component) for every id in links (a, b): the least id that can be reached.

    More than `few` links go by rounds on tables, with the same result: each
    round ties every node's larger neighbours to its least neighbour, then its
    smaller ones; the trees' heights fall by a constant factor a round. The
    centre of a large star is joined as a broadcast table, in no single task.
    Repeated links and links of a node with itself change nothing.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    if edges.count() <= few:
        return edges.coalesce(1).mapInArrow(_joined, "id long, component long")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = _least(large)
        small = least.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small)
        state = edges.agg(F.count("*"), F.expr("sum(CAST(pmod(xxhash64(u, v), 1000000007) AS LONG))")).first()
        if tuple(state) == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = tuple(state)
