"""Tables in the folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and the master is local."""
from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder, which goes when the driver ends; a result may read tables there until then."""
    path = f"{shared_dir(spark)}/plumbline/{spark.sparkContext.applicationId}"
    if path not in _OWN:
        _OWN.add(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        atexit.register(_remove, folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder)
    return path


def _remove(system, folder) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        system.delete(folder, True)


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet and read again, which cuts its lineage; and the path."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete materialized tables that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
