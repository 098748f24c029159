"""Tables that a job writes between its steps, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Only a local master may go without: then a temporary folder is made and named there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillrank-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def materialize(df: DataFrame, tag: str, partition_by: list[str] | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage so that a lost executor costs a re-read and not a recomputation, and gives
    the optimizer true file sizes, from which it decides whether a side may be broadcast.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if compression:
        writer = writer.option("compression", compression)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(path: str, spark: SparkSession) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may have ended before; its folder is then left to its owner
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def discard(*spent: DataFrame) -> None:
    """Delete tables that ``materialize`` gave and that no result still to be computed reads; other frames are left alone."""
    for df in spent:
        path = df.__dict__.get("_scratch")
        if path in _written:
            _delete(path, _written.pop(path))


def release() -> None:
    """Delete all that was written here so far; results that read it must be stored before. Runs at the end of the process, too."""
    while _written:
        _delete(*_written.popitem())


atexit.register(release)
