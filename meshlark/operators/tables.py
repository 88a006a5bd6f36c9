"""Tables in the shared folder, for steps that would otherwise be computed again and again, or be lost with an executor."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; on one machine, where it may be unset, the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Writes df as Parquet below the shared folder and reads it again: later steps survive lost executors. discard() deletes it, at the latest when Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/meshlark-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(discard)
    _made.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt over all cores by a key: for costly steps on rows that a scan gives in few tasks, such as small files of one row group."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, key)


def discard() -> None:
    """Deletes all tables of written(), once what was read from them isn't needed any more."""
    while _made:
        spark, path = _made.pop()
        context = spark.sparkContext
        if context._jsc is None or context._jsc.sc().isStopped():
            continue
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
