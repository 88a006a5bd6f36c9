"""Unstructured meshes: coordinates by identifier, nearest cells, masks and maps from tiles to cells.

mesh: uuid, cell, lat, lon (and masked). Nearest cells are found by an equi-join
of cubes that the unit sphere is cut into, of an edge that leaves few cells in
each however many there are. A query first searches the cubes around its own;
what lies elsewhere is at least a cube's edge away, so queries that found nothing
so near search again in cubes of twice the edge, up to those that hold the whole
sphere, or up to the greatest distance asked for. The result is exact; of equally near cells the least number wins. Each round's open queries
are a table, so that no round computes the ones before again.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import RADIUS, bucket, chord2, unit_vector
from ..sources.errors import MissingMesh
from .tables import written


def paired(arrays: DataFrame) -> DataFrame:
    """(uuid, lat_no, lon_no, lat_radians, lon_radians): which field of a mesh holds its latitudes and which its longitudes.

    arrays: uuid, no (order of fields), discipline, category, number, most (the
    greatest absolute value). Fields coded as coordinates (0, 191, 1 and 2) come
    first; else the first fields whose range fits. Fixed bounds: a quarter and a
    half turn in radians (+0.01), 90 and 360 degrees (+0.5).
    """
    half = "3.141592653589793e0"
    coded = lambda n: F.min(F.expr(f"CASE WHEN discipline = 0 AND category = 191 AND number = {n} THEN no END"))
    kind = f"CASE WHEN most <= {half} / 2 + 1e-2 THEN 'lat' WHEN most <= {half} + 1e-2 THEN 'lon' WHEN most <= 905e-1 THEN 'lat' WHEN most <= 3605e-1 THEN 'lon' END"
    typed = arrays.withColumn("kind", F.expr(kind))
    found = typed.groupBy("uuid").agg(coded(1).alias("c1"), coded(2).alias("c2"), F.min(F.expr("CASE WHEN kind = 'lat' THEN no END")).alias("r1"), F.min(F.expr("CASE WHEN kind = 'lon' THEN no END")).alias("r2"))
    chosen = found.select("uuid", F.expr("c1 IS NOT NULL AND c2 IS NOT NULL").alias("coded"), F.expr("CASE WHEN c1 IS NOT NULL AND c2 IS NOT NULL THEN c1 ELSE r1 END").alias("lat_no"), F.expr("CASE WHEN c1 IS NOT NULL AND c2 IS NOT NULL THEN c2 ELSE r2 END").alias("lon_no")).where("lat_no IS NOT NULL AND lon_no IS NOT NULL")
    limit = arrays.select(F.col("uuid").alias("u"), F.col("no").alias("n"), "most")

    def radians(name: str, quarter: bool):
        other = limit.select(F.col("u").alias(f"u_{name}"), F.col("n").alias(f"n_{name}"), F.col("most").alias(f"most_{name}"))
        test = f"most_{name} <= {half} + 1e-2" if not quarter else f"(coded AND most_{name} <= {half} + 1e-2) OR (NOT coded AND most_{name} <= {half} / 2 + 1e-2)"
        return other, F.expr(test).alias(f"{name}_radians")

    lat, lat_test = radians("lat", True)
    lon, lon_test = radians("lon", False)
    joined = chosen.join(lat, (F.col("uuid") == F.col("u_lat")) & (F.col("lat_no") == F.col("n_lat"))).join(lon, (F.col("uuid") == F.col("u_lon")) & (F.col("lon_no") == F.col("n_lon")))
    return joined.select("uuid", "lat_no", "lon_no", lat_test, lon_test)


def attached(cells: DataFrame, mesh: DataFrame, require_mesh: bool = False) -> DataFrame:
    """cells (uuid, cell, value, ...) with the lat and lon of their mesh; null where the mesh isn't known, or an error if require_mesh."""
    if require_mesh:
        missing = cells.select("uuid").distinct().join(mesh.select("uuid").distinct(), "uuid", "left_anti").limit(5).collect()
        if missing:
            raise MissingMesh(f"no coordinates for the meshes {sorted(str(r.uuid) for r in missing)}")
    named = mesh.select(F.col("uuid").alias("m_uuid"), F.col("cell").alias("m_cell"), "lat", "lon")
    return cells.join(named, (F.col("uuid") == F.col("m_uuid")) & (F.col("cell") == F.col("m_cell")), "left").drop("m_uuid", "m_cell")


def mesh_ids(mesh: DataFrame) -> DataFrame:
    """(uuid, cells): the meshes that coordinates are known of."""
    return mesh.groupBy("uuid").agg(F.count("*").alias("cells"))


def histogram(mesh: DataFrame, n_lat: int) -> DataFrame:
    """(row, column, n): the cells of each bucket."""
    row, column = bucket("lat", "lon", str(n_lat))
    return mesh.groupBy(F.expr(row).alias("row"), F.expr(column).alias("column")).agg(F.count("*").alias("n"))


def bucket_rows(cells: int) -> int:
    """Latitude rows of buckets for a mesh of so many cells, some 8 cells a bucket, from 4 to 4096."""
    return int(min(max(round((cells / 16) ** 0.5), 4), 4096))


#: Cells of an evenly spread mesh in a square of the first cubes' edge: 1 point in 500 finds none so near and goes on to the next round.
CELLS_A_CUBE = 2

#: More points than these aren't broadcast: each asks for up to 27 cubes, which the planner doesn't see.
BROADCAST_POINTS = 10_000


def first_edge(cells: int, n_lat: int) -> float:
    """The first cubes' edge: that of a row of n_lat from pole to pole, or finer as the mesh is, so that what a point meets doesn't grow with it."""
    return max(min(2 * math.sin(math.pi / (2 * n_lat)), math.sqrt(4 * math.pi * CELLS_A_CUBE / max(cells, 1))), 1e-6)


def nearest_cells(points: DataFrame, mesh: DataFrame, id_col: str, n_lat: int, max_metres: float | None = None) -> DataFrame:
    """(id, cell, d2, masked): the nearest cell of each point by squared chord; cell is null if it is masked or further than max_metres.

    points: id, lat, lon, and uuid if mesh holds several meshes: then each point
    is answered from its own. n_lat sets the first cubes' greatest edge, a row of
    so many from pole to pole; larger meshes have finer ones. Points whose mesh
    has no cell give nulls.
    """
    x, y, z = unit_vector("lat", "lon")
    own = ["uuid"] if "uuid" in points.columns and "uuid" in mesh.columns else []
    masked = F.col("masked") if "masked" in mesh.columns else F.lit(False)
    cells = mesh.select(*own, "cell", F.expr(x).alias("mx"), F.expr(y).alias("my"), F.expr(z).alias("mz"), masked.alias("masked"))
    left = points.select(id_col, *own, F.expr(x).alias("px"), F.expr(y).alias("py"), F.expr(z).alias("pz"))
    most = mesh.groupBy(*own).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    edge, done, many = first_edge(most or 0, n_lat), None, left.count() > BROADCAST_POINTS
    limit = 2 * math.sin(min(max_metres / (2 * RADIUS), math.pi / 2)) if max_metres and max_metres > 0 else None
    cube = lambda v: F.floor(F.col(v) / F.lit(edge)).cast("int")
    while True:
        # cubes of edge 2 hold the sphere, and none further than the greatest distance matters
        last = edge >= 2 or limit is not None and edge >= limit
        around = left.withColumn("near", F.explode(F.expr("flatten(transform(sequence(-1, 1), a -> flatten(transform(sequence(-1, 1), b -> transform(sequence(-1, 1), c -> struct(a, b, c))))))")))
        asked = around.select(id_col, *own, "px", "py", "pz", *((cube(f"p{v}") + F.col(f"near.{n}")).alias(f"k{v}") for v, n in zip("xyz", "abc", strict=True)))
        # a cube that holds part of the sphere has its centre within half its diagonal of it
        away = F.sqrt(sum(((F.col(f"k{v}") + 0.5) * F.lit(edge)) ** 2 for v in "xyz"))
        asked = asked.where(F.abs(away - 1) <= 0.8661 * edge + 1e-9)
        if many:
            asked = asked.hint("merge")
        held = cells.select("*", *(cube(f"m{v}").alias(f"k{v}") for v in "xyz"))
        d2 = F.expr("(px - mx) * (px - mx) + (py - my) * (py - my) + (pz - mz) * (pz - mz)").alias("d2")
        met = asked.join(held, [*own, "kx", "ky", "kz"]).select(id_col, d2, "cell", "masked")
        best = met.groupBy(id_col).agg(F.min(F.struct("d2", "cell", "masked")).alias("b"))
        seen = left.join(best, id_col, "left")
        near = F.coalesce(F.col("b.d2") <= F.lit(edge * edge), F.expr("px + py + pz IS NULL"))  # a point that is nowhere has no nearest cell
        if last:
            now = seen.select(id_col, "b.cell", "b.d2", "b.masked")
            done = now if done is None else done.unionByName(now)
            break
        seen = written(seen.withColumn("settled", near))
        now = seen.where("settled").select(id_col, "b.cell", "b.d2", "b.masked")
        done = now if done is None else done.unionByName(now)
        left = seen.where("NOT settled").drop("b", "settled")
        left_over = left.count()
        if not left_over:
            break
        edge, many = edge * 2, left_over > BROADCAST_POINTS
    keep = "NOT masked" + (f" AND d2 <= {chord2(f'{max_metres!r}e0')}" if max_metres and max_metres > 0 else "")
    return done.select(id_col, F.expr(f"CASE WHEN {keep} THEN cell END").alias("cell"), "d2", "masked")


def with_distance(found: DataFrame) -> DataFrame:
    """found with the great-circle metres of d2."""
    return found.withColumn("metres", F.expr(f"2 * asin(least(sqrt(d2) / 2, 1e0)) * {RADIUS!r}e0"))
