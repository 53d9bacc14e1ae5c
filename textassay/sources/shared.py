"""Derived tables that several queries read, written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_kept: dict[tuple[str, ...], str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def state(spark: SparkSession, path: str) -> str:
    """Times, file counts and lengths of the tables in a folder; changes when one of them does."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for table in files.listStatus(root):
        summary = files.getContentSummary(table.getPath())
        found.append((table.getPath().getName(), table.getModificationTime(), summary.getFileCount(), summary.getLength()))
    return repr(sorted(found))


def kept(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """The table `name` derived from sf_dir, made by make() on first use in an application and again if sf_dir changes."""
    key = (spark.sparkContext.applicationId, sf_dir, state(spark, sf_dir), name)
    if key not in _kept:
        path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        make().write.parquet(path)
        _kept[key] = path
    return spark.read.parquet(_kept[key])
