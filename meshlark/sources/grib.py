"""GRIB files as DataFrames.

read() goes through Spark's binaryFile source and so reads any store that Spark
can; each task parses its files. Headers are read without payloads, so filters
on them come before any unpacking. register() makes the same available as
spark.read.format("grib2") for folders that all executors see.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import messages

_RANGES = "array<struct<process: int, increment_type: int, unit: int, length: long, increment_unit: int, increment: long>>"
HEADER = (
    "file string, file_offset long, field_no int, discipline int, centre int, subcentre int, master_table int, local_table int, reference_significance int, reference_time timestamp_ntz, production_status int, data_type int, local_use binary, "
    "product_template int, category int, number int, generating_process int, time_unit int, forecast_time long, surface1 int, scale1 int, value1 long, surface2 int, scale2 int, value2 long, derived int, percentile int, "
    "probability_number int, probability_count int, probability_type int, lower_scale int, lower_value long, upper_scale int, upper_value long, ensemble_type int, perturbation int, ensemble_size int, "
    f"interval_end timestamp_ntz, missing_in_process long, time_ranges {_RANGES}, hybrid array<double>, "
    "grid_template int, points long, ni long, nj long, la1 double, lo1 double, la2 double, lo2 double, di double, dj double, scan int, pole_lat double, pole_lon double, angle double, lad double, lov double, latin1 double, latin2 double, south boolean, "
    "gaussian_n long, stretch_lat double, stretch_lon double, stretch double, uuid string, mesh_number long, shape int, radius double, major double, minor double, widths array<int>, packed long, data_template int, bitmap_indicator int, error string"
)
WITH_VALUES = HEADER + ", values array<double>"


#: Values that are gathered in a batch before it goes to the JVM.
BATCH_VALUES = 1 << 20


def _lists(fields: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    """Arrays of values as one list column: a single field is passed on without a copy."""
    sizes = [0 if v is None else len(v) for v in fields]
    held = [v for v in fields if v is not None]
    flat = held[0] if len(held) == 1 else np.concatenate(held) if held else np.zeros(0)
    missing = pa.array([v is None for v in fields])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(flat, kind.value_type), kind, mask=missing)


def _batch(found: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    columns = [_lists([r.get("values") for r in found], f.type) if f.name == "values" else pa.array([r.get(f.name) for r in found], f.type) for f in schema]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _gathered(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of the rows of all files: a batch of so many columns costs as much as the rows of many small files."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("values", ()))
        if len(held) == 1000 or size >= BATCH_VALUES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def parsed(files: DataFrame, payload: bool = False, mode: str = "FAILFAST", predefined: dict[int, bytes] | None = None, single: bool = False) -> DataFrame:
    """A row for each field of files (path, content); single: values as 32-bit floats."""
    schema = (WITH_VALUES.replace("values array<double>", "values array<float>") if single else WITH_VALUES) if payload else HEADER
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _gathered((row for batch in batches for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for row in messages.rows(path, content.as_py(), payload, mode, predefined)), arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def read(spark: SparkSession, path: str, payload: bool = False, mode: str = "FAILFAST", predefined: dict[int, bytes] | None = None, single: bool = False) -> DataFrame:
    """A row for each field of the files at a path; payload: with the array of values in storage order, NaN where missing; single: as 32-bit floats."""
    return parsed(spark.read.format("binaryFile").load(path), payload, mode, predefined, single)


def cells(fields: DataFrame) -> DataFrame:
    """A row for each value of fields on rectangular grids: file, file_offset, field_no, off, i, j, value (null: missing)."""
    from ..functions.geometry import natural_ij

    i, j = natural_ij("off", "ni", "nj", "scan")
    each = fields.select("file", "file_offset", "field_no", "ni", "nj", "scan", F.posexplode("values").alias("off", "raw"))
    return each.select("file", "file_offset", "field_no", "off", F.expr(i).cast("int").alias("i"), F.expr(j).cast("int").alias("j"), F.when(~F.isnan("raw"), F.col("raw")).alias("value"))


class _Part(InputPartition):
    def __init__(self, path: str, offset: int, size: int) -> None:
        self.path, self.offset, self.size = path, offset, size


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.options, self.kind = options, schema

    def partitions(self) -> list[_Part]:
        """A partition for each physical message, from a walk over the indicator sections."""
        import glob
        import mmap
        import os

        path = self.options["path"]
        files = sorted(f for f in glob.glob(os.path.join(path, "*") if os.path.isdir(path) else path) if os.path.isfile(f))
        out = []
        for f in files:
            with open(f, "rb") as held, mmap.mmap(held.fileno(), 0, access=mmap.ACCESS_READ) as data:
                out += [_Part(f, at, size) for at, size in messages.physical(data)]
        return out or [_Part("", 0, 0)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        with open(part.path, "rb") as f:
            f.seek(part.offset)
            data = f.read(part.size)
        names = self.kind.fieldNames()
        arrow = to_arrow_schema(self.kind)
        found = [r | {"file_offset": part.offset} for r in messages.rows(part.path, data, "values" in names, self.options.get("mode", "FAILFAST"))]
        if found:
            yield _batch(found, arrow)


class GribSource(DataSource):
    """format("grib2") with options path, payload (true or false) and mode."""

    @classmethod
    def name(cls) -> str:
        return "grib2"

    def schema(self) -> str:
        return WITH_VALUES if self.options.get("payload", "false").lower() == "true" else HEADER

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GribSource)
