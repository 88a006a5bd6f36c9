import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from meshlark import cli
from meshlark.operators import fields, meshes
from meshlark.sources import encoder as e
from meshlark.sources import grib


class Mesh:
    """An own grid class for the encoder: an unstructured grid with an identifier."""

    template, nj, scan = 101, 1, 0

    def __init__(self, n, uuid):
        self.ni, self.uuid = n, uuid

    def body(self):
        return b"\x06\0\0\7\1" + self.uuid


def test_meshes_from_files(spark, tmp_path):
    r = np.random.default_rng(4)
    a, b = bytes(range(16)), bytes(range(16, 32))
    lat, lon = r.uniform(-80, 80, 50), r.uniform(-170, 170, 50)
    field = lambda m, v, **k: [e.Field(Mesh(50, m), v, packing="ieee64", **k)]
    groups = [field(a, np.radians(lat), category=191, number=1), field(a, np.radians(lon), category=191, number=2), field(b, lon), field(b, lat), field(a, np.arange(50.0), category=3)]
    (tmp_path / "m.grib2").write_bytes(e.file(groups))
    full = grib.read(spark, str(tmp_path), payload=True)
    mesh = fields.mesh_of(full).collect()
    for uuid in (a, b):
        got = sorted((x.cell, x.lat, x.lon) for x in mesh if x.uuid == uuid.hex())
        assert np.allclose([g[1:] for g in got], np.stack([lat, lon], 1))
    cells = fields.mesh_cells(full.where("category = 3"))
    placed = meshes.attached(cells, fields.mesh_of(full)).orderBy("cell").collect()
    assert np.allclose([x.lat for x in placed], lat) and [x.value for x in placed] == list(range(50))
    points = spark.createDataFrame([(k, float(x) + 0.01, float(y)) for k, (x, y) in enumerate(zip(lat, lon, strict=True))], "pixel long, lat double, lon double")
    stored = meshes.nearest_cells(points, fields.mesh_of(full).where(F.col("uuid") == a.hex()), "pixel", 4).withColumn("uuid", F.lit(a.hex()))
    values = {x.pixel: x.value for x in fields.with_tiles(stored, cells).collect()}
    assert sum(values[k] == k for k in values) >= 45


def test_catalogue_and_command_line(spark, tmp_path, capsys):
    v = np.arange(91.0)
    v[5] = np.nan
    f = e.Field(e.LatLon(13, 7, 60, 5, 58.8, 6.2, 0.1, 0.2), v, dt.datetime(2024, 1, 31), time_unit=3, forecast_time=1, surface=(103, 1, 20))
    path = tmp_path / "a.grib2"
    path.write_bytes(e.file([[f]]))
    (row,) = fields.catalogued(grib.read(spark, str(path))).collect()
    assert row.valid_time == dt.datetime(2024, 3, 2) and row.level1 == 2.0 and row.level2 is None and row.lower_limit is None
    cli.main(["inspect", str(path)])
    assert "category=0" in capsys.readouterr().out
    out = tmp_path / "tile.f4"
    cli.main(["tile", str(path), "7", "66", "37", "--size", "16", "--out", str(out)])
    assert "valid=" in capsys.readouterr().out and out.stat().st_size == 4 * 256


def test_rendering_files_equals_rendering_fields(spark, tmp_path):
    from meshlark.operators import dense

    v = np.random.default_rng(5).normal(size=91)
    v[[3, 40]] = np.nan
    g = e.LatLon(13, 7, 60, 5, 58.8, 6.2, 0.1, 0.2)
    (tmp_path / "a.grib2").write_bytes(e.file([[e.Field(g, v, packing="ieee64"), e.Field(g, v + 1, packing="ieee64")]]))
    tiles = [(7, 66, 37), (7, 65, 37), (7, 0, 0)]
    got = {(x.field_no, x.z, x.x, x.y): x.pixels for x in dense.rendered_files(spark.read.format("binaryFile").load(str(tmp_path)), tiles, size=16).collect()}
    full = grib.read(spark, str(tmp_path), payload=True)
    for z, x, y in tiles:
        asked = full.withColumns({"z": F.lit(z), "x": F.lit(x), "y": F.lit(y), "w": F.lit(16), "h": F.lit(16)})
        for r in dense.rendered(asked, ["field_no"]).collect():
            assert np.array_equal(got[r.field_no, z, x, y], r.pixels, equal_nan=True)
    assert len(got) == 6 and any(not np.isnan(p).all() for p in got.values()) and np.isnan(got[0, 7, 0, 0]).all()
