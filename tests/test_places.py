"""Rendering and point lookup on every grid: against the SQL formulas, and by fields whose values tell their own place."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.functions import geometry as g
from meshlark.operators import dense, gaussian, places
from meshlark.sources import encoder as e
from meshlark.sources import grib
from meshlark.sources.errors import Unsupported

R = np.random.default_rng(17)
LAT, LON = R.uniform(-90, 90, 4000), R.uniform(-180, 360, 4000)
BASE = dict.fromkeys(places.COLUMNS)
GRIDS = {
    "mercator": BASE | {"grid_template": 10, "ni": 600, "nj": 900, "la1": 60.0, "lo1": -30.0, "lad": 20.0, "di": 1e4, "dj": 1e4, "scan": 0, "shape": 6},
    "polar": BASE | {"grid_template": 20, "ni": 700, "nj": 700, "la1": -20.826, "lo1": -125.0, "lad": 60.0, "lov": -80.0, "di": 19e3, "dj": 19e3, "scan": 64, "south": False, "shape": 6},
    "lambert": BASE | {"grid_template": 30, "ni": 1799, "nj": 1059, "la1": 21.138, "lo1": 237.28, "lov": 262.5, "latin1": 38.5, "latin2": 38.5, "di": 3e3, "dj": 3e3, "scan": 64, "shape": 6},
    "rotated": BASE | {"grid_template": 1, "ni": 81, "nj": 61, "la1": 15.0, "lo1": -20.0, "la2": -15.0, "lo2": 20.0, "di": 0.5, "dj": 0.5, "scan": 0, "pole_lat": -43.0, "pole_lon": 10.0, "angle": 0.0},
    "latlon": BASE | {"grid_template": 0, "ni": 361, "nj": 181, "la1": 60.0, "lo1": -20.0, "la2": -30.0, "lo2": 70.0, "di": 0.25, "dj": 0.5, "scan": 0},
}


@pytest.mark.parametrize("name", sorted(GRIDS))
def test_places_are_those_of_the_formulas(spark, name):
    grid = GRIDS[name]
    points = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(LAT, LON, strict=True))], "id int, lat double, lon double")
    size = (str(grid["ni"]), str(grid["nj"]), str(grid["scan"]))
    text = {
        "mercator": lambda: g.locate_mercator("lat", "lon", "60e0", "-30e0", "20e0", "1e4", "1e4", *size), "polar": lambda: g.locate_polar("lat", "lon", "-20826e-3", "-125e0", "60e0", "-80e0", "19e3", "19e3", *size),
        "lambert": lambda: g.locate_lambert("lat", "lon", "21138e-3", "23728e-2", "2625e-1", 38.5, 38.5, "3e3", "3e3", *size),
        "rotated": lambda: g.locate_latlon(*g.rotated("lat", "lon", "-43e0", "10e0"), "15e0", "-20e0", "-15e0", "20e0", "5e-1", "5e-1", *size[:2]), "latlon": lambda: g.locate_latlon("lat", "lon", "60e0", "-20e0", "-30e0", "70e0", "25e-2", "5e-1", *size[:2]),
    }[name]()
    want = points.select("id", *(F.expr(t) for t in text)).orderBy("id").collect()
    fx, fy = places.locate(grid, LAT, LON)
    assert (~np.isnan(fx)).sum() > 20
    for r, x, y in zip(want, fx, fy, strict=True):
        assert (r[1] is None and np.isnan(x)) or abs(r[1] - x) < 1e-6 and abs(r[2] - y) < 1e-6
    if name != "rotated" and places.separable(grid):
        ax, ay = places.axes(grid, LAT, LON)
        assert np.array_equal(np.where(np.isnan(ax) | np.isnan(ay), np.nan, ax), fx, equal_nan=True)


def grid_of(widths=None, ni=None, n=8, nj=None, lo1=0.0, lo2=None, di=None, la1=90.0, la2=-90.0, scan=0, template=40, **more):
    rows = nj or 2 * n
    return BASE | {"grid_template": template, "gaussian_n": n, "nj": rows, "ni": ni, "widths": widths or [], "la1": la1, "la2": la2, "lo1": lo1, "lo2": 360 - 360 / max(widths or [ni]) if lo2 is None else lo2, "di": di, "scan": scan} | more


def test_gaussian_rows():
    lats = gaussian.latitudes(8)
    reduced = grid_of(widths=[4, 8, 12, 16, 20, 20, 20, 20, 20, 20, 20, 20, 16, 12, 8, 4])
    fx, fy = places.locate(reduced, np.array([lats[0], lats[3], lats[5], lats[15], 89.9, lats[3]]), np.array([90.0, 22.5, 18.0, 270.0, 0.0, 359.0]))
    assert np.allclose(fx[:4], [1, 1, 1, 3]) and np.allclose(fy[:4], [0, 3, 5, 15]) and np.isnan(fx[4]) and abs(fx[5] - 359 / 22.5) < 1e-9
    regular = grid_of(ni=32)
    assert np.allclose(places.locate(regular, (lats[6] + lats[7]) / 2, 180.0), (16, 6.5))
    regional = grid_of(ni=5, nj=4, n=8, la1=lats[2], la2=lats[5], lo1=10.0, lo2=50.0, di=10.0)
    assert np.allclose(places.locate(regional, lats[3], 25.0), (1.5, 1)) and np.isnan(places.locate(regional, lats[3], 55.0)[0]) and np.isnan(places.locate(regional, lats[7], 25.0)[0])
    eastward = grid_of(widths=[3, 5], nj=2, la1=lats[2], la2=lats[3], lo1=350.0, lo2=10.0)
    assert np.allclose(places.locate(eastward, lats[2], 0.0), (1, 0)) and np.allclose(places.locate(eastward, lats[3], 5.0), (3, 1))
    turned = grid_of(ni=32, template=41, pole_lat=-90.0, pole_lon=0.0, angle=0.0)
    same = grid_of(ni=32, template=42, stretch_lat=90.0, stretch_lon=0.0, stretch=1.0)
    both = grid_of(ni=32, template=43, pole_lat=-90.0, pole_lon=0.0, angle=0.0, stretch_lat=90.0, stretch_lon=0.0, stretch=1.0)
    plain = places.locate(regular, LAT, LON)
    for other in (turned, both):
        fx, fy = places.locate(other, LAT, LON)
        near = ~np.isnan(fx) & ~np.isnan(plain[0])
        assert near.sum() > 3000 and np.allclose(fy[near], plain[1][near], atol=1e-6) and np.allclose(np.exp(2j * np.pi * fx[near] / 32), np.exp(2j * np.pi * (plain[0][near]) / 32), atol=1e-5)
    assert np.isnan(places.locate(same | {"stretch": 0.0}, LAT, LON)[0]).all() and np.isnan(places.locate({"grid_template": 50}, LAT, LON)[0]).all()
    for template in (101, 204):
        with pytest.raises(Unsupported):
            places.locate({"grid_template": template}, LAT, LON)


@pytest.mark.parametrize("scan", [0, 64, 128, 16, 64 | 128 | 16])
def test_reduced_rows_in_natural_order(scan):
    widths = [2, 4, 6, 4]
    rows = [[10 * j + i for i in range(w)] for j, w in enumerate(widths)]
    stored = []
    for k, row in enumerate(rows[::-1] if scan & 64 else rows):
        stored += row[::-1] if bool(scan & 128) ^ bool(scan & 16 and k % 2) else row
    got = places.natural(np.array(stored, float), {"widths": widths, "scan": scan})
    assert got.shape == (4, 6) and all(got[j, i] == 10 * j + i if i < w else np.isnan(got[j, i]) for j, w in enumerate(widths) for i in range(6))
    assert np.isnan(places.natural(np.array(stored, float), {"widths": widths, "scan": 32})).all()


def test_corner():
    for scan, want in ((0, (60.0, 5.0)), (64, (61.2, 5.0)), (128, (60.0, 3.8)), (192, (61.2, 3.8))):
        c = places.corner({"grid_template": 0, "ni": 13, "nj": 7, "la1": 60.0, "lo1": 5.0, "di": 0.1, "dj": 0.2, "scan": scan})
        assert np.allclose((c["lat0"], c["lon0"]), want) and c["dlat"] == -0.2 and (c["nx"], c["ny"]) == (13, 7)
    assert places.corner({"grid_template": 1}) is None


def test_earth_radii():
    assert places.earth_radius({"shape": 6}) == 6371229 and places.earth_radius({"shape": 1, "radius": 5.0}) == 5 and places.earth_radius({}) == 6371229
    assert abs(places.earth_radius({"shape": 4}) - 6371007.18) < 0.1 and abs(places.earth_radius({"shape": 7, "major": 6378137.0, "minor": 6356752.314245}) - 6371007.18) < 0.1


LATS8 = gaussian.latitudes(8)
ENCODED = {
    "rotated": e.RotatedLatLon(60, 40, 1.0, -1.5, -0.95, 1.45, 0.05, 0.05, pole_lat=-43.0, pole_lon=10.0), "mercator": e.Mercator(60, 45, 60.0, 0.0, 45.0, 20.0, 45.0, 2e4, 2e4), "polar": e.Polar(60, 60, 60.0, 5.0, 60.0, 10.0, 15e3, 15e3), "lambert": e.Lambert(60, 45, 55.0, 5.0, 50.0, 10.0, 15e3, 15e3, latin1=48.0, latin2=50.0),
    "gaussian": e.Gaussian(64, 16, round(LATS8[0], 6), 0.0, round(LATS8[-1], 6), 354.375, 5.625, 0, n=8), "latlon": e.LatLon(60, 40, 55.0, 5.0, 47.2, 16.8, 0.2, 0.2),
}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """A file of each grid; a value is its column, and a thousand times its row."""
    d = tmp_path_factory.mktemp("grids")
    for name, grid in ENCODED.items():
        j, i = np.mgrid[0 : grid.nj, 0 : grid.ni]
        (d / f"{name}.grib2").write_bytes(e.file([[e.Field(grid, (i + 1000.0 * j).reshape(-1), packing="ieee64")]]))
    return str(d)


def test_all_grids_are_rendered(spark, files):
    tiles = [(3, 4, 2), (4, 8, 5), (0, 0, 0)]
    read = grib.read(spark, files, payload=True)
    for how in dense.HOW:
        of_files = {(r.file.rpartition("/")[2][:-6], r.z, r.x, r.y): np.array(r.pixels) for r in dense.rendered_files(spark.read.format("binaryFile").load(files), tiles, how, 24).collect()}
        assert len(of_files) == len(ENCODED) * len(tiles)
        asked = read.withColumn("t", F.explode(F.array(*(F.struct(F.lit(z).alias("z"), F.lit(x).alias("x"), F.lit(y).alias("y")) for z, x, y in tiles)))).select("*", "t.*", F.lit(24).alias("w"), F.lit(24).alias("h"))
        for r in dense.rendered(asked, ["file"], how).collect():
            assert np.array_equal(of_files[r.file.rpartition("/")[2][:-6], r.z, r.x, r.y], r.pixels, equal_nan=True)
        heads = {r.file.rpartition("/")[2][:-6]: r.asDict() for r in grib.read(spark, files).collect()}
        for name, (z, x, y) in itertools.product(ENCODED, tiles):
            lats, lons = dense.pixel_centres(z, x, y, 24, 24)
            fx, fy = places.locate(heads[name], lats[:, None], lons[None])
            got, inside = of_files[name, z, x, y].reshape(24, 24), ~np.isnan(fx)
            assert np.isnan(got[~inside]).all()
            if how == "nearest":
                i, j = np.floor(fx[inside] + 0.5), np.floor(fy[inside] + 0.5)
                ok = (i < ENCODED[name].ni) & (j < ENCODED[name].nj)
                assert np.array_equal(got[inside][ok], (i + 1000 * j)[ok]) and np.isnan(got[inside][~ok]).all()
            elif how == "bicubic":
                deep = inside & (fx > 2) & (fx < ENCODED[name].ni - 3) & (fy > 2) & (fy < ENCODED[name].nj - 3)
                assert np.allclose(got[deep], (fx + 1000 * fy)[deep], atol=1e-6)  # the kernel keeps linear fields
        assert all(np.isfinite(np.concatenate([of_files[name, *t] for t in tiles])).sum() > 3 for name in ENCODED)


def test_values_at_points(spark, files):
    points = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(R.uniform(45, 62, 200), R.uniform(0, 25, 200), strict=True))]
    for how in dense.HOW:
        got = dense.values_at(grib.read(spark, files, payload=True), ["file"], points, how).collect()
        assert len(got) == 200 * len(ENCODED)
        heads = {r.file: r.asDict() for r in grib.read(spark, files).collect()}
        for r in got:
            fx, fy = places.locate(heads[r.file], points[r.id][1], points[r.id][2])
            assert r.in_grid == (not np.isnan(fx)) and (r.in_grid or np.isnan(r.value))
            if r.in_grid and how == "nearest" and not np.isnan(r.value):
                assert r.value == np.floor(fx + 0.5) + 1000 * np.floor(fy + 0.5)
    with pytest.raises(ValueError):
        dense.values_at(grib.read(spark, files, payload=True), ["file"], points, most_points=3)


def test_mode_against_counting():
    field = R.integers(0, 4, (12, 15)).astype(float)
    field[R.random(field.shape) < 0.2] = np.nan
    fx, fy = R.uniform(-2, 17, 300), R.uniform(-2, 14, 300)
    for half in (1, 2):
        got = dense.sampled_at(field, fx, fy, "mode", half)
        for x, y, v in zip(fx, fy, got, strict=True):
            i, j = int(np.sign(x) * np.floor(abs(x) + 0.5)), int(np.sign(y) * np.floor(abs(y) + 0.5))
            near = [field[b, a] for b in range(j - half, j + half + 1) for a in range(i - half, i + half + 1) if 0 <= a < 15 and 0 <= b < 12 and not np.isnan(field[b, a])]
            assert np.isnan(v) and not near or v == min(near, key=lambda q: (-near.count(q), q))


def test_unknown_grids_raise(spark, tmp_path):
    from tests.test_fields import Mesh

    (tmp_path / "m.grib2").write_bytes(e.file([[e.Field(Mesh(5, bytes(16)), np.arange(5.0))]]))
    binary = spark.read.format("binaryFile").load(str(tmp_path))
    with pytest.raises(Exception, match="unstructured"):
        dense.rendered_files(binary, [(0, 0, 0)]).collect()
    assert dense.rendered_files(binary, [(0, 0, 0)], mode="DROPMALFORMED").count() == 0


def test_natural_order_of_files(spark, files):
    got = {r.file.rpartition("/")[2][:-6]: r for r in dense.in_natural_order(grib.read(spark, files, payload=True), ["file"]).collect()}
    for name, grid in ENCODED.items():
        assert (got[name].nx, got[name].ny) == (grid.ni, grid.nj) and got[name].natural[:3] == [0, 1, 2] and got[name].natural[grid.ni] == 1000
