"""Where plans are cut: the checkpoint folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The shared checkpoint folder; where none is configured, one in the warehouse, or this machine's own if it is the only one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not sc.master.startswith("local"):
            configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_newsweave"
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="newsweave-"))
        # Spark made a folder of this session's own in it
        own = spark._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir())
        own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)
    return sc.getCheckpointDir().rstrip("/")


def new(spark: SparkSession, name: str) -> str:
    """A folder below it that is not in use; it goes when the session ends."""
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder, for the session, and read it back."""
    path = new(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a frame from `kept` that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
