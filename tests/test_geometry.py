"""Formulas against independent calculations, and operators against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.functions import geometry as g
from meshlark.functions import headers as h
from meshlark.operators import gaussian, meshes, sampling, unpacking

R = np.random.default_rng(9)


def one(spark, *texts):
    return tuple(spark.range(1).select(*(F.expr(t).alias(f"c{k}") for k, t in enumerate(texts))).first())


def test_wrapping_and_rounding(spark):
    assert one(spark, g.wrap360("-190e0"), g.wrap180("190e0"), g.wrap360("370e0", "-20")) == (170, -170, 10)
    assert one(spark, g.half_up("25e-1"), g.half_up("-25e-1"), g.half_up("-4e-1")) == (3, -3, 0)


@pytest.mark.parametrize("scan", range(0, 256, 16))
def test_storage_and_natural_order_are_inverse(spark, scan):
    ni, nj = 5, 4
    i, j = g.natural_ij("off", str(ni), str(nj), str(scan))
    rows = spark.range(ni * nj).select(F.col("id").alias("off")).select("off", F.expr(i).alias("i"), F.expr(j).alias("j")).withColumn("back", F.expr(g.storage_offset("i", "j", str(ni), str(nj), str(scan))))
    got = rows.collect()
    assert all(r.off == r.back for r in got) and len({(r.i, r.j) for r in got}) == ni * nj


def test_rotated_frame_is_centred(spark):
    lat, lon = one(spark, *g.rotated("47e0", "10e0", "-43e0", "10e0"))
    assert abs(lat) < 1e-9 and abs(lon) < 1e-9
    lat, lon = one(spark, *g.rotated("50e0", "20e0", "-90e0", "0e0"))
    assert abs(lat - 50) < 1e-9 and abs(lon - 20) < 1e-9
    west, east = one(spark, g.rotated("47e0", "9e0", "-43e0", "10e0")[1], g.rotated("47e0", "11e0", "-43e0", "10e0")[1])
    assert west < 0 < east


def test_first_points_of_projected_grids(spark):
    for scan, want in (("0", (0, 0)), ("64", (0, 9)), ("192", (9, 9))):
        for fi, fj in (
            g.locate_lambert("21e0", "-122e0", "21e0", "-122e0", "-95e0", 25.0, 45.0, "3e3", "3e3", "10", "10", scan),
            g.locate_polar("60e0", "-80e0", "60e0", "-80e0", "60e0", "-80e0", "19e3", "19e3", "10", "10", scan),
            g.locate_mercator("60e0", "5e0", "60e0", "5e0", "20e0", "1e4", "1e4", "10", "10", scan),
        ):
            got = one(spark, fi, fj)
            assert np.allclose(got, want, atol=1e-6), (scan, got)
    same = [one(spark, *g.locate_lambert("22e0", lon, "21e0", "-122e0", "265e0", 25.0, 45.0, "3e4", "3e4", "90", "90", "64")) for lon in ("-121e0", "239e0")]
    assert np.allclose(*same)
    north = one(spark, *g.locate_polar("61e0", "-80e0", "60e0", "-80e0", "60e0", "-80e0", "19e3", "19e3", "20", "20", "64"))
    assert north[1] < 19


def test_quantised_types(spark):
    q = lambda v, kind, **k: one(spark, g.quantized(v, kind, k.get("scale", 1.0), k.get("offset", 0.0), k.get("missing", -1), k.get("low", 0.0), k.get("high", 0.0)))[0]
    assert [q("300e0", "int8"), q("-300e0", "int8"), q("25e-1", "int8"), q("-25e-1", "int8")] == [127, -128, 3, -3]
    assert q("CAST(NULL AS DOUBLE)", "int8", missing=300) == 44 and q("CAST(NULL AS DOUBLE)", "uint16") == 65535
    assert q("1e30", "int64") == 2**63 - 1 and int(q("1e30", "uint64")) == 2**64 - 1 and q("-5e0", "uint8") == 0
    assert q("50e0", "int16", low=-10.0, high=10.0) == 10


def test_valid_time_runs_over_months(spark):
    t = lambda unit, n: one(spark, h.valid_time("TIMESTAMP'2024-01-31 06:00:00'", str(unit), str(n)))[0]
    assert str(t(3, 1)) == "2024-03-02 06:00:00" and str(t(4, -1)) == "2023-01-31 06:00:00" and str(t(11, 2)) == "2024-01-31 18:00:00"
    assert t(9, 1) is None and str(t(0, 90)) == "2024-01-31 07:30:00"


def test_earth(spark):
    r = one(spark, g.effective_radius("4", "0e0", "0e0", "0e0"))[0]
    assert abs(r - 6371007.18) < 0.1
    assert one(spark, g.effective_radius("1", "0e0", "0e0", "0e0"), g.effective_radius("0", "0e0", "0e0", "0e0")) == (6371229.0, 6367470.0)


def test_samplers_against_arrays(spark):
    ni, nj = 12, 9
    field = R.normal(size=(nj, ni))
    field[3, 4] = np.nan
    cells = spark.createDataFrame([(i, j, None if np.isnan(field[j, i]) else float(field[j, i])) for j in range(nj) for i in range(ni)], "i int, j int, value double")
    pts = [(k, float(R.uniform(-1, ni)), float(R.uniform(-1, nj))) for k in range(150)] + [(150, None, None)]
    points = spark.createDataFrame(pts, "id long, fx double, fy double")

    def at(x, y):
        return field[y, x] if 0 <= x < ni and 0 <= y < nj else np.nan

    def near(v):
        return int(math.floor(abs(v) + 0.5) * math.copysign(1, v))

    def w(t):
        t = abs(t)
        return 1.5 * t**3 - 2.5 * t**2 + 1 if t < 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0

    got = {r.id: r.value for r in sampling.bicubic(points, cells, "id").collect()}
    plain = {r.id: r.value for r in sampling.nearest(points, cells).collect()}
    for k, x, y in pts[:-1]:
        a, b = math.floor(x), math.floor(y)
        taps = [(at(a - 1 + i, b - 1 + j), w(x - (a - 1 + i)) * w(y - (b - 1 + j))) for j in range(4) for i in range(4)]
        n = at(near(x), near(y))
        want = n if any(np.isnan(v) for v, _ in taps) else sum(v * c for v, c in taps) / sum(c for _, c in taps)
        assert (got[k] is None and np.isnan(want)) or abs(got[k] - want) < 1e-9
        assert (plain[k] is None and np.isnan(n)) or plain[k] == n
    assert got[150] is None and plain[150] is None
    modes = sampling.mode(points.where("id = 150"), cells, "id").collect()
    assert modes[0].value is None


def test_nearest_cells_are_exact(spark):
    lat, lon = np.degrees(np.arcsin(R.uniform(-1, 1, 700))), R.uniform(-180, 180, 700)
    mesh = spark.createDataFrame([(k, float(a), float(b), k % 7 == 0) for k, (a, b) in enumerate(zip(lat, lon, strict=True))], "cell long, lat double, lon double, masked boolean")
    pa, po = [*np.degrees(np.arcsin(R.uniform(-1, 1, 200))), 90.0, -90.0, 89.9, 0.0], [*R.uniform(-180, 180, 200), 0.0, 10.0, 179.9, -180.0]
    points = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(pa, po, strict=True))], "id long, lat double, lon double")
    unit = lambda a, b: np.stack([np.cos(np.radians(a)) * np.cos(np.radians(b)), np.cos(np.radians(a)) * np.sin(np.radians(b)), np.sin(np.radians(a))], -1)
    best = ((unit(np.array(pa), np.array(po))[:, None] - unit(lat, lon)[None]) ** 2).sum(-1).argmin(1)
    for rows in (4, 20, 60):
        got = {r.id: r.cell for r in meshes.nearest_cells(points, mesh.drop("masked"), "id", rows).collect()}
        assert got == dict(enumerate(best.tolist()))
    from meshlark.sources.errors import MissingMesh

    pole = spark.createDataFrame([("p", 0, 90.0, 0.0), ("q", 5, -90.0, 0.0), ("q", 6, 0.0, 0.0)], "uuid string, cell long, lat double, lon double")
    both = points.withColumn("uuid", F.expr("CASE WHEN id % 2 = 0 THEN 'p' WHEN id % 3 = 0 THEN 'none' ELSE 'q' END"))
    got = {r.id: r.cell for r in meshes.nearest_cells(both, pole, "id", 40).collect()}  # each point from its own mesh
    q = unit(np.array([-90.0, 0.0]), np.zeros(2))
    want = {k: 0 if k % 2 == 0 else None if k % 3 == 0 else 5 + int(((unit(pa[k], po[k]) - q) ** 2).sum(-1).argmin()) for k in range(len(pa))}
    assert got == want
    near = {r.id: r.cell for r in meshes.nearest_cells(points, mesh.drop("masked"), "id", 60, 300_000.0).collect()}
    assert near == {k: int(c) if np.arccos(np.clip((unit(pa[k], po[k]) * unit(lat[c], lon[c])).sum(), -1, 1)) * 6371229 <= 300_000 else None for k, c in enumerate(best)}
    cells = spark.createDataFrame([("p", 0, 1.0), ("x", 0, 2.0)], "uuid string, cell long, value double")
    assert {r.uuid: r.lat for r in meshes.attached(cells, pole).collect()} == {"p": 90.0, "x": None} and meshes.attached(cells.where("uuid = 'p'"), pole, require_mesh=True).count() == 1
    with pytest.raises(MissingMesh):
        meshes.attached(cells, pole, require_mesh=True)
    assert {r.uuid: r.cells for r in meshes.mesh_ids(pole).collect()} == {"p": 1, "q": 2}
    held = {r.id: r.cell for r in meshes.nearest_cells(points, mesh, "id", 12).collect()}
    assert held == {k: None if c % 7 == 0 else c for k, c in enumerate(best.tolist())}


def test_bicubic_moves_a_point_once(spark):
    cells = spark.createDataFrame([(i, j, float(i + 100 * j)) for i in range(-12, 20) for j in range(-12, 20) if (i, j) != (5, 5)], "i int, j int, value double")
    pts = [(k, float(x), float(y)) for k, (x, y) in enumerate(R.uniform(-11, 18, (400, 2)))] + [(400, None, 1.0), (401, 500.0, 1.0), (402, 7.0, -8.0), (403, -0.5, 8.0)]
    points = spark.createDataFrame(pts, "id long, fx double, fy double")
    df = sampling.bicubic(points, cells, "id")
    got = {r.id: r.value for r in df.collect()}
    assert len(got) == 404 and got[400] is None and got[401] is None and got[402] == 7 - 800
    for k, x, y in pts[:400]:
        a, b = math.floor(x), math.floor(y)
        if a - 1 < -12 or b - 1 < -12 or a + 2 > 19 or b + 2 > 19 or a - 1 <= 5 <= a + 2 and b - 1 <= 5 <= b + 2:
            i, j = (int(math.copysign(math.floor(abs(v) + 0.5), v)) for v in (x, y))
            assert got[k] == (None if (i, j) == (5, 5) else i + 100 * j)
        else:
            assert abs(got[k] - (x + 100 * y)) < 1e-9  # the kernel keeps linear fields
    # a row for each point, not for each of its 16 taps, meets the cells
    assert "[tap#" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_cubes_are_as_fine_as_the_mesh(spark):
    ratio = [meshes.first_edge(n, 12) ** 2 * n / (4 * np.pi) for n in (10**4, 10**6, 10**8)]  # cells in a square of the edge
    assert np.allclose(ratio, meshes.CELLS_A_CUBE) and meshes.first_edge(0, 12) == meshes.first_edge(10, 12) == 2 * np.sin(np.pi / 24)
    n = 20_000
    lat, lon = np.degrees(np.arcsin(R.uniform(-1, 1, n))), R.uniform(-180, 180, n)
    mesh = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(lat, lon, strict=True))], "cell long, lat double, lon double")
    points = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(lat[:300] + 0.1, lon[:300] + 0.1, strict=True))] + [(300, None, 0.0)], "id long, lat double, lon double")
    unit = lambda a, b: np.stack([np.cos(np.radians(a)) * np.cos(np.radians(b)), np.cos(np.radians(a)) * np.sin(np.radians(b)), np.sin(np.radians(a))], -1)
    best = ((unit(lat[:300] + 0.1, lon[:300] + 0.1)[:, None] - unit(lat, lon)[None]) ** 2).sum(-1).argmin(1)
    found = meshes.nearest_cells(points, mesh, "id", 12)
    assert {r.id: r.cell for r in found.collect()} == dict(enumerate(best.tolist())) | {300: None}


@pytest.mark.parametrize("most", [0, 10_000])
def test_few_and_many_points_give_the_same(spark, monkeypatch, most):
    monkeypatch.setattr(meshes, "BROADCAST_POINTS", most)
    test_nearest_cells_are_exact(spark)


def test_differences_pass_over_missing_rows(spark):
    x = [5, None, 2, 3, None, 4]
    df = spark.createDataFrame([(0, k, v) for k, v in enumerate(x)], "f int, k int, x int")
    first = [r.full for r in unpacking.undifferenced(df, ["f"], ["k"], 1, least=1).orderBy("k").collect()]
    assert first == [5, None, 8, 12, None, 17]
    second = [r.full for r in unpacking.undifferenced(df, ["f"], ["k"], 2, least=1).orderBy("k").collect()]
    assert second == [5, None, 2, 3, None, 9]


def test_gaussian_latitudes():
    lats = gaussian.latitudes(32)
    assert len(lats) == 64 and abs(lats[0] - 87.8638) < 1e-4 and abs(lats[0] + lats[-1]) < 1e-12 and list(lats) == sorted(lats, reverse=True)
    assert gaussian.regional(32, 3, 60.0)[0] == min(lats, key=lambda v: abs(v - 60))


def test_gaussian_join_equals_arrays(spark):
    from meshlark.operators import places

    lats = gaussian.latitudes(8)
    for widths, lo1, lo2, rows in (([4, 8, 12, 16, 20, 20, 20, 20, 20, 20, 20, 20, 16, 12, 8, 4], 0.0, 342.0, 16), ([3, 5, 1, 4], 350.0, 30.0, 4)):
        grid = dict.fromkeys(places.COLUMNS) | {"grid_template": 40, "gaussian_n": 8, "nj": rows, "widths": widths, "la1": lats[0 if rows == 16 else 3], "la2": lats[-1 if rows == 16 else 6], "lo1": lo1, "lo2": lo2, "scan": 0}
        at, west, step, east = places.rows_of(8, rows, grid["la1"], grid["la2"], lo1, lo2, None, 0, None, tuple(widths))
        table = spark.createDataFrame([(j, w, sum(widths[:j]), float(at[j]), float(west[j]), float(step[j]), float(east[j])) for j, w in enumerate(widths)], "j int, width int, first long, lat double, west double, step double, east double")
        pts = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip([*R.uniform(-90, 90, 500), *at], [*R.uniform(-180, 360, 500), *[lo1] * rows], strict=True))]
        got = {r.id: r for r in gaussian.locate(spark.createDataFrame(pts, "id long, lat double, lon double"), table, "id").collect()}
        fx, fy = places.locate(grid, np.array([p[1] for p in pts]), np.array([p[2] for p in pts]))
        assert len(got) == len(pts) and (~np.isnan(fx)).sum() > 5
        for k, (x, y) in enumerate(zip(fx, fy, strict=True)):
            assert (got[k].fi is None and np.isnan(x)) or abs(got[k].fi - x) < 1e-6 and abs(got[k].fj - y) < 1e-6


@pytest.mark.parametrize("scan", [0, 64, 80, 112, 160])
def test_dense_rendering_equals_joins(spark, scan):
    from meshlark.operators import dense, tiles

    ni, nj = 20, 15
    stored = R.normal(size=ni * nj)
    stored[[17, 40, 133]] = np.nan
    la, lo = (60.0, 57.2), (5.0, 8.8)
    la1, la2 = la[::-1] if scan & 64 else la
    lo1, lo2 = lo[::-1] if scan & 128 else lo
    row = [(1, 7, 66, 37, 24, 16, ni, nj, la1, lo1, la2, lo2, 0.2, 0.2, scan, stored.tolist())]
    fields = spark.createDataFrame(row, "k int, z int, x int, y int, w int, h int, ni int, nj int, la1 double, lo1 double, la2 double, lo2 double, di double, dj double, scan int, values array<double>")
    i, j = g.natural_ij("off", str(ni), str(nj), str(scan))
    cells = fields.select(F.posexplode("values").alias("off", "raw")).select(F.expr(i).cast("int").alias("i"), F.expr(j).cast("int").alias("j"), F.when(~F.isnan("raw"), F.col("raw")).alias("value"))
    px = tiles.tile_pixels(fields.select("z", "x", "y", "w", "h")).withColumn("id", F.expr("py * 24 + px"))
    fi, fj = g.locate_latlon("lat", "lon", "60e0", "5e0", "572e-1", "88e-1", "2e-1", "2e-1", str(ni), str(nj))
    points = px.select("id", F.expr(fi).alias("fx"), F.expr(fj).alias("fy"))
    for how in ("nearest", "bicubic"):
        got = dense.rendered(fields, ["k"], how).first().pixels
        want = {r.id: r.value for r in sampling.resample(points, cells, "id", how).collect()}
        assert any(v is not None for v in want.values())
        assert all((want[k] is None and np.isnan(v)) or abs(want[k] - v) < 1e-9 for k, v in enumerate(got))
