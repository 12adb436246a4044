"""Session helpers shared by queries, benches and tests."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "roadweft", cpus: str = "8", memory: str = "12g", **conf: str) -> SparkSession:
    """A local session with adaptive execution and UTC time, for benches and tests."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "roadweft-scratch")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder that the cluster names in spark.checkpoint.dir.

    Where the setting is absent a local folder is chosen on a local master (tests, single machines);
    on a cluster that is an error.
    """
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def _located(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _located(spark, path)
    return files.exists(at)


def passing(spark: SparkSession, path: str) -> str:
    """``path``, which is deleted when the application ends."""
    files, at = _located(spark, path)
    files.deleteOnExit(at)
    return path


def materialize(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors.
    The table is deleted when the application ends. ``file_rows`` bounds a file's rows, hence those
    that a reader holds at once, where rows are large."""
    path = scratch(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(passing(df.sparkSession, path))


class Rounds:
    """The written table of a loop: what a round writes takes the place of what the last one wrote,
    so nothing else may read that."""

    def __init__(self, name: str) -> None:
        self.name, self.path = name, None

    def write(self, df: DataFrame) -> DataFrame:
        spark, last = df.sparkSession, self.path
        self.path = scratch(spark, self.name)
        df.write.parquet(self.path)
        if last:
            files, at = _located(spark, last)
            files.delete(at, True)
        return spark.read.schema(df.schema).parquet(passing(spark, self.path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
