"""python -m meshlark.cli inspect PATH | tile PATH Z X Y [--how bicubic] [--size 256] [--out FILE]"""

from __future__ import annotations

import argparse

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import dense, fields
from .sources import grib


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("what", choices=["inspect", "tile"])
    parser.add_argument("path")
    parser.add_argument("place", nargs="*", type=int, help="z x y")
    parser.add_argument("--how", default="bicubic", choices=["nearest", "bicubic", "mode"])
    parser.add_argument("--size", type=int, default=256)
    parser.add_argument("--field", type=int, default=0)
    parser.add_argument("--out")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("meshlark").config("spark.ui.enabled", "false").getOrCreate()
    if a.what == "inspect":
        heads = fields.catalogued(grib.read(spark, a.path)).orderBy("file", "file_offset", "field_no")
        for r in heads.select("file_offset", "field_no", "discipline", "category", "number", "reference_time", "valid_time", "level1", "grid_template", "ni", "nj", "points", "data_template").toLocalIterator():
            print(" ".join(f"{k}={v}" for k, v in r.asDict().items()))
        return
    z, x, y = a.place
    chosen = grib.read(spark, a.path, payload=True).orderBy("file", "file_offset", "field_no").limit(a.field + 1).orderBy(F.desc("file"), F.desc("file_offset"), F.desc("field_no")).limit(1)
    asked = chosen.withColumns({"z": F.lit(z), "x": F.lit(x), "y": F.lit(y), "w": F.lit(a.size), "h": F.lit(a.size)})
    pixels = np.array(dense.rendered(asked, ["file"], a.how).first().pixels, "<f4")
    if a.out:
        pixels.tofile(a.out)
    known = pixels[~np.isnan(pixels)]
    print(f"valid={len(known)} of {len(pixels)}" + (f" min={known.min():g} max={known.max():g} mean={known.mean(dtype=np.float64):g}" if len(known) else ""))


if __name__ == "__main__":
    main()
