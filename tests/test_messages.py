import datetime as dt

import numpy as np
import pytest

from meshlark.sources import encoder as e
from meshlark.sources import grib, messages
from meshlark.sources.errors import BadMessage, GribError, Truncated

R = np.random.default_rng(3)


def latlon(scan=0):
    return e.LatLon(13, 7, 60, 5, 58.8, 6.2, 0.1, 0.2, scan)


def noisy(n=91):
    v = R.normal(280, 10, n)
    v[R.random(n) < 0.2] = np.nan
    return v


@pytest.mark.parametrize("scan", range(0, 256, 16))
@pytest.mark.parametrize("packing,near", [("simple", 0.01), ("ieee32", 1e-4), ("ieee64", 0), ("png", 0.01)])
def test_round_trip(scan, packing, near):
    g, v = latlon(scan), noisy()
    one = e.message([e.Field(g, v, packing=packing), e.Field(g, v * 2, packing=packing, reuse_bitmap=True)])
    rows = list(messages.rows("f", b"junk" + one + b"more" + one, True))
    assert [(r["file_offset"], r["field_no"]) for r in rows] == [(4, 0), (4, 1), (8 + len(one), 0), (8 + len(one), 1)]
    back = np.empty(91)
    back[e.storage_order(g)] = rows[1]["values"]
    assert np.allclose(back, v * 2, atol=2 * near + 1e-12, equal_nan=True)


def test_header():
    f = e.Field(latlon(), noisy(), dt.datetime(2024, 1, 31, 6), 0, 78, category=2, number=3, time_unit=0, forecast_time=-90, surface=(103, 1, 20))
    (r,) = messages.rows("f", e.message([f]), False)
    assert (r["reference_time"], r["centre"], r["category"], r["number"], r["time_unit"], r["forecast_time"]) == (dt.datetime(2024, 1, 31, 6), 78, 2, 3, 0, -90)
    assert (r["surface1"], r["scale1"], r["value1"], r["surface2"], r["ni"], r["nj"], r["la2"], r["dj"]) == (103, 1, 20, 255, 13, 7, 58.8, 0.2)


def test_grids():
    n = 12
    for g, want in (
        (e.RotatedLatLon(4, 3, 1, 2, -1, 5, 1, 1, pole_lat=-43, pole_lon=10, angle=5), {"grid_template": 1, "pole_lat": -43.0, "angle": 5.0}),
        (e.Mercator(4, 3, 60, -30, 50, -20, 20, 1e4, 2e4), {"grid_template": 10, "lad": 20.0, "dj": 2e4}),
        (e.Polar(4, 3, -20.8, 145, 60, -80, 19e3, 19e3, 64, True), {"grid_template": 20, "lov": -80.0, "south": True, "scan": 64}),
        (e.Lambert(4, 3, 21, -122, 38, -95, 3e3, 3e3, latin1=38.5, latin2=38.5), {"grid_template": 30, "latin2": 38.5}),
        (e.Gaussian(4, 3, 80, 0, -80, 270, 90, 0, n=2), {"grid_template": 40, "gaussian_n": 2, "di": 90.0}),
    ):
        (r,) = messages.rows("f", e.message([e.Field(g, np.zeros(n))]), True)
        assert {k: r[k] for k in want} == want and r["values"].tolist() == [0.0] * n


def test_broken_files():
    one = e.message([e.Field(latlon(), noisy())])
    assert list(messages.rows("f", b"", True)) == list(messages.rows("f", b"no message", True)) == []
    with pytest.raises(Truncated):
        list(messages.rows("f", one[:-1], True))
    with pytest.raises(BadMessage):
        list(messages.rows("f", one[:7] + b"\1" + one[8:], True))
    with pytest.raises(BadMessage):
        list(messages.rows("f", one[:-4] + b"7776", True))
    lonely = e.Field(latlon(), noisy(), reuse_bitmap=True)
    with pytest.raises(BadMessage):
        list(messages.rows("f", e.message([lonely]), True))
    found = list(messages.rows("f", e.message([lonely]) + one, True, "PERMISSIVE"))
    assert "error" in found[0] and "values" in found[1]
    assert len(list(messages.rows("f", e.message([lonely]) + one, True, "DROPMALFORMED"))) == 1
    for bad in ([], [e.Field(latlon(), np.zeros(3))]):
        with pytest.raises(GribError):
            e.message(bad)


def test_predefined_bitmap():
    v = np.arange(91.0)
    v[3] = np.nan
    one = e.message([e.Field(latlon(), v)])
    six = one.index(b"\x06\x00", 90) - 4
    size = int.from_bytes(one[six : six + 4], "big")
    bits = one[six + 6 : six + size]
    short = one[:six] + b"\0\0\0\6\6\7" + one[six + size :]
    short = short[:8] + len(short).to_bytes(8, "big") + short[16:]
    (r,) = messages.rows("f", short, True, predefined={7: bits})
    assert np.isnan(r["values"][3]) and abs(r["values"][4] - 4) < 0.01
    with pytest.raises(GribError):
        list(messages.rows("f", short, True))


def test_sources(spark, tmp_path):
    (tmp_path / "a.grib2").write_bytes(e.file([[e.Field(latlon(), noisy(), forecast_time=k)] for k in range(5)]))
    (tmp_path / "b.grib2").write_bytes(e.file([[e.Field(latlon(), noisy(), category=9), e.Field(latlon(64), noisy())]]))
    heads = grib.read(spark, str(tmp_path))
    assert heads.count() == 7 and heads.where("category = 9").count() == 1 and "values" not in heads.columns
    full = grib.read(spark, str(tmp_path), payload=True)
    c = grib.cells(full)
    assert c.count() == 7 * 91 and c.where("j = 0 AND i = 0").count() == 7
    grib.register(spark)
    by_format = spark.read.format("grib2").option("payload", "true").load(str(tmp_path))
    assert by_format.count() == 7 and by_format.where("size(values) = 91").count() == 7


def test_encoding_tables(spark, tmp_path):
    rows = [(1, k, 13, 7, 60.0, 5.0, 58.8, 6.2, 0.1, 0.2, 0, [float(x) for x in range(91)], dt.datetime(2024, 1, 1), 0, 1, k, 6) for k in range(3)]
    df = spark.createDataFrame(rows, "g int, k int, ni int, nj int, la1 double, lo1 double, la2 double, lo2 double, di double, dj double, scan int, values array<double>, reference_time timestamp, discipline int, category int, number int, forecast_time int")
    made = e.encoded(df, "g", "k").collect()
    found = list(messages.rows("f", bytes(made[0]["message"]), True))
    assert [r["number"] for r in found] == [0, 1, 2] and np.allclose(found[0]["values"], np.arange(91), atol=0.01)


def test_small_files_share_batches(spark):
    import itertools

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from meshlark.operators.tables import spread

    one = e.message([e.Field(latlon(), noisy())])
    rows = (r for k in range(2500) for r in messages.rows(str(k), one, False))
    sizes = [b.num_rows for b in grib._gathered(rows, to_arrow_schema(StructType.fromDDL(grib.HEADER)))]
    assert sizes == [1000, 1000, 500]
    files = spark.createDataFrame([(str(k), bytearray(one)) for k in range(30)], "path string, content binary")
    assert sorted(int(r.file) for r in grib.parsed(files.coalesce(1)).collect()) == list(range(30))
    values = [b for b in grib._gathered(itertools.chain(messages.rows("a", one, True), messages.rows("b", one, True)), to_arrow_schema(StructType.fromDDL(grib.WITH_VALUES)))]
    assert len(values) == 1 and [len(v) for v in values[0].column("values").to_pylist()] == [91, 91]
    assert spread(files.coalesce(1), "path").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_long_arrays_are_handled_in_pieces():
    import pyarrow as pa

    from meshlark.sources.pieces import pieces

    lists = [[1.0] * n for n in (3, 0, 4, 20, 1, 1)] + [None, [2.0]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(lists, pa.list_(pa.float64()))], ["k", "values"])
    got = [p.column("k").to_pylist() for p in pieces(batch, 1, 7)]
    assert got == [[0, 1, 2], [3], [4, 5, 6, 7]]
    assert [x for p in pieces(batch, 1, 7) for x in p.column("values").to_pylist()] == lists and list(pieces(batch.slice(0, 0), 1)) == []
    assert [p.column("k").to_pylist() for p in pieces(batch.slice(2, 4), 1, 7)] == [[2], [3], [4, 5]]
