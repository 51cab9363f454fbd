"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

__all__ = ["bounded", "cut", "delete_at_exit", "discard", "fresh_path", "groups", "ids_and_text", "materialise", "shared_dir", "table"]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may go without (tests, a laptop): a temporary folder is
    then made and entered as the session's checkpoint folder. A cluster has no
    machine-local folder that all its executors see, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="bhashya-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete_at_exit(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors.

    The table is deleted with ``discard``, or else when the driver ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    delete_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    vars(out)["kept_at"] = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes materialised tables that nothing reads any more."""
    for t in tables:
        path = vars(t).pop("kept_at", None) if t is not None else None
        if path:
            fs, p = _file_system(t.sparkSession, path)
            fs.delete(p, True)


def ids_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator works on; further columns, of any name, are left out."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def cut(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Halves a batch until no part holds more than ``size`` bytes, or a row alone does."""
    if batch.nbytes <= size or batch.num_rows < 2:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from cut(batch.slice(0, half), size)
        yield from cut(batch.slice(half), size)


def bounded(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``size`` bytes (or one row), whatever Spark's own batches hold."""
    for b in batches:
        yield from cut(b, size)


def groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of about ``size`` bytes: large batches are cut, small ones joined."""
    held, n = [], 0
    for b in bounded(batches, size):
        if held and n + b.nbytes > size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
        held.append(b)
        n += b.nbytes
    if held:
        yield pa.Table.from_batches(held)
