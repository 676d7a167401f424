"""Helpers shared by the corpus operators: scratch tables, shipping, slicing."""

from __future__ import annotations

import atexit
import ctypes
import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Python's bytes.split() and bytes.strip() without arguments use exactly these.
SPACE = " \t\n\x0b\x0c\r"

#: Rows of whole texts in an Arrow batch, where the session has Spark's default of 10,000.
BATCH_ROWS = 4000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Give the executors this package, whatever their Python path is; bound the Arrow batches of texts."""
    if spark.conf.get(ARROW_ROWS, "10000") == "10000":
        spark.conf.set(ARROW_ROWS, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    name = os.path.basename(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{name}.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, files in os.walk(os.path.join(root, name)):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    One of our own is made only where none is named and all runs on this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ranklake-"))
    return spark.sparkContext.getCheckpointDir()


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def remove_since(mark: int = 0, but: DataFrame | None = None) -> None:
    """Remove the scratch folders made since mark(), those of ``but`` left out; nothing else may read them."""
    gone = [e for e in _written[mark:] if e[1] != getattr(but, "_scratch", "")]
    _written[mark:] = [e for e in _written[mark:] if e not in gone]
    for spark, path in gone:
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # noqa: BLE001, S110  the session may have gone before us; the others are tried
            pass


def mark() -> int:
    return len(_written)


atexit.register(remove_since)


def drop(*tables: DataFrame) -> None:
    """Remove tables made by table() that nothing reads any more."""
    for df in tables:
        for entry in [e for e in _written if e[1] == getattr(df, "_scratch", None)]:
            _written.remove(entry)
            _remove(*entry)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/ranklake-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    This cuts the lineage like checkpoint() does, survives lost executors, is
    compressed, and is computed once.  The table is removed by drop(), by
    remove_since(), or when Python ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of Arrow batches that gives its worker's free memory back when its task ends."""

    @functools.wraps(run, assigned=("__name__", "__doc__"))
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes of text; a longer text stands alone."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(size):
        yield start, len(size)


def texts(column: pa.Array) -> pa.Array:
    """The column as strings with nulls as empty texts."""
    return pc.fill_null(column.cast(pa.string()), "")


def encoded(column: pa.Array) -> list[bytes]:
    """Each text in UTF-8; null is empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def lowered(b: bytes) -> bytes:
    """A-Z in lower case, nothing else changed."""
    return b.lower()


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def fresh(df: DataFrame, *wanted: str) -> str:
    """A column name that df does not have."""
    name = wanted[0] if wanted else "_x"
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def only(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Select the named inputs by themselves, so that other columns can't clash."""
    return df.select(*[(df[f"`{c}`"] if isinstance(c, str) else c).alias(k) for k, c in columns.items()])


def first_of_each(df: DataFrame, key: str) -> DataFrame:
    """Of the rows of one key that of the least hash of all its columns (map columns left out); null keys are one key."""
    name, at = fresh(df, "_at"), fresh(df, "_hash")
    hashed = [df[f"`{f.name}`"] for f in df.schema if not isinstance(f.dataType, T.MapType | T.VariantType)]
    order = Window.partitionBy(F.col(f"`{key}`")).orderBy(at)
    return df.withColumn(at, F.xxhash64(*hashed)).withColumn(name, F.row_number().over(order)).where(F.col(name) == 1).drop(name, at)


def pieces(rows: int, per: int, least: int = 1) -> int:
    return max(least, -(-rows // per))

