"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset and everything runs in one process (local tests) a temporary folder is used and kept for the session;
    on a cluster there is no folder that would do, so this raises.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("changeloom.shared.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="changeloom-")
        spark.conf.set("changeloom.shared.dir", found)
    return found.rstrip("/")


def remove_at_end(spark: SparkSession, path: str):
    """Have a folder removed when the application ends; gives its Hadoop path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return place


def new_path(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage and outlives executors.

    The table goes with ``dropped``, or when the application ends.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    place = remove_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = place
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made and that nothing reads any more."""
    for df in tables:
        df.written_at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(df.written_at, True)
