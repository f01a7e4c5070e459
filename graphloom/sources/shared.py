"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master.startswith("local[") or master == "local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own_dir:
        _own_dir["dir"] = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, _own_dir["dir"], ignore_errors=True)
    return "file://" + _own_dir["dir"]


def put_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes a small file to the shared folder; returns its address."""
    address = f"{shared_dir(spark)}/graphloom/{uuid.uuid4().hex}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(address)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    stream.write(bytearray(data))
    stream.close()
    return address


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts its lineage.

    Unlike cached blocks or a local checkpoint it outlives any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.graphloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of materialize() that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.graphloom_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A broadcast hint if the (stored) table has at most so many rows, else df itself."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def files(spark: SparkSession, pattern: str) -> list[str]:
    """The addresses of the files that match a pattern, on any file system; none if there are none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [f.getPath().toString() for f in found or []]
