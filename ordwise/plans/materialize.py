"""Cutting a plan: a frame written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, the session's own checkpoint folder (local mode only)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ordwise-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def release() -> None:
    """Remove what `materialize` wrote; also runs when the driver ends normally."""
    while _written:
        spark, path = _written.pop()
        try:
            if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
                return
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the JVM has gone already; the folder's owner cleans up
            return


def materialize(df: DataFrame) -> DataFrame:
    """The same rows, read back from files: what was decided while writing them never changes again."""
    path = f"{shared_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the frame's size."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
