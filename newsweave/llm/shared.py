"""Places and plan cuts that every executor can see."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; where none is configured, one in the warehouse, or a temporary one on a single machine."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_newsweave"  # executors elsewhere do not see a temporary folder
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="newsweave-"))
    return sc.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, never used before."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared folder, so that a lost executor costs no recomputation."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def until_exit(spark: SparkSession, path: str) -> None:
    """Have a written path deleted when the session ends."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder for the session and read it back (columnar, so later reads can prune)."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def removed(spark: SparkSession, path: str) -> None:
    """Delete a written path that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared path and the path within it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)
