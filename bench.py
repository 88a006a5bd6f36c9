"""Times of the headline queries, as one JSON line; and the throughput of decoding and rendering whole fields."""

import json
import os
import tempfile
import time
from statistics import median

import numpy as np
from pyspark.sql import SparkSession

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["gather_nearest", "bicubic", "mode_filter", "region_render", "tile_render", "tile_render_bicubic", "locate_lambert", "rotate_latlon", "gaussian_locate", "simple_unpack", "bitmap_expand", "complex_groups", "spdiff1", "spdiff2", "valid_time", "param_resolve", "sticky_sections", "mesh_pair", "mesh_nearest", "tile_cell_map"]


def timed(run, times: int) -> float:
    took = []
    for _ in range(times):
        began = time.time()
        run()
        took.append(time.time() - began)
    return round(median(took), 3)


def fields(spark) -> dict[str, float]:
    """Points a second of decoding, pixels a second of rendering, over files of 1215 x 746 points (entropy coding: 200 x 100)."""
    from meshlark.operators import dense
    from meshlark.sources import encoder, grib

    out = {}

    def written(d: str, packing: str, ni: int, nj: int, files: int) -> int:
        g = encoder.LatLon(ni, nj, 58, -4, 58 - 0.02 * (nj - 1), -4 + 0.02 * (ni - 1), 0.02, 0.02)
        j, i = np.mgrid[0:nj, 0:ni]
        v = (280 + 10 * np.sin(i / 90) * np.cos(j / 70)).reshape(-1)
        v[::6] = np.nan
        data = encoder.file([[encoder.Field(g, v, packing=packing)]])
        for k in range(files):
            with open(f"{d}/{k}.grib2", "wb") as f:
                f.write(data)
        return files * ni * nj

    for packing, ni, nj, files in (("simple", 1215, 746, 128), ("complex", 1215, 746, 64), ("spdiff2", 1215, 746, 64), ("ccsds", 200, 100, 128)):
        with tempfile.TemporaryDirectory() as d:
            points = written(d, packing, ni, nj, files)
            for name, single in (("decode", False), ("decode_float32", True))[: 2 if packing == "simple" else 1]:
                decode = grib.read(spark, d, payload=True, single=single)
                s = timed(lambda: decode.write.format("noop").mode("overwrite").save(), 3)  # noqa: B023
                out[f"{name}_{'' if packing == 'simple' else packing + '_'}points_per_sec"] = round(points / s)
            if packing == "simple":
                tiles = [(5, 16 + k % 2, 10) for k in range(16)]
                binary = spark.read.format("binaryFile").load([f"{d}/{k}.grib2" for k in range(32)])
                s = timed(lambda: dense.rendered_files(binary, tiles).write.format("noop").mode("overwrite").save(), 3)
                out["bicubic_pixels_per_sec"] = round(32 * 16 * 65536 / s)
    return out


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "64").config("spark.sql.warehouse.dir", tempfile.mkdtemp()).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from meshlark.plans import registry

    found, took = registry.queries(), {}
    for name in HEADLINE:
        run = lambda: found[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        run()
        took[name] = timed(run, 3)
    more = fields(spark)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rpartition("sf")[2]} | more))
    spark.stop()


if __name__ == "__main__":
    main()
