"""Tables that are written once and read several times."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans.query import QueryError

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new place in the folder that driver and executors share; a local one only where all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise QueryError("name a folder that all executors share in spark.checkpoint.dir")
        base = tempfile.mkdtemp(prefix="ranklake-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def once(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, which goes when Python ends."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001, S110  the session may have gone before us; the others are tried
            pass


atexit.register(_remove)
