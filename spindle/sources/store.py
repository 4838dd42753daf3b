"""Tables between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one where that is unset and the master is local.

    On a cluster a local folder would be another one on each machine, so there it must be set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or f"file://{tempfile.gettempdir()}/spindle-store").rstrip("/")


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` as a table there, deleted when the driver ends: what follows begins with it, and a lost executor loses none of it."""
    spark = frame.sparkSession
    own = f"{root(spark)}/store-{spark.sparkContext.applicationId}"
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(own)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(frame.schema).parquet(path)


def proxies(spark: SparkSession, out: str) -> str:
    """A folder for files that executors write and the reports name: below ``out`` on a local master, else in the shared folder, which must be mounted."""
    if spark.sparkContext.master.split("[")[0] == "local":
        return f"{out}/proxies"
    shared = root(spark)
    if "://" in shared and not shared.startswith("file://"):
        raise ValueError("proxies are made by a tool that needs a mounted folder; spark.checkpoint.dir names none")
    return f"{shared.removeprefix('file://')}/proxies"
