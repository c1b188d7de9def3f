"""Cutting lineage between rounds of an iterative operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Only a local session may go without, and gets an own one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ecovista-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder}/ecovista/{spark.sparkContext.applicationId}"


def apart(df: DataFrame) -> DataFrame:
    """df, for joins in which both sides grow with the input: they are shuffled.  Left to itself, Spark broadcasts tables of
    some MB, and each of them comes to the driver whole, in every round anew."""
    return df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back; lost executors don't lose it.  Joins with it are shuffled (see `apart`),
    unless a hint of the join says otherwise."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return apart(spark.read.schema(df.schema).parquet(path))


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """The same, and the number of rows, counted while they are written."""
    seen = Observation()
    table = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return table, seen.get["n"]


def clear(spark: SparkSession) -> bool:
    """Delete all tables this application has cut; nothing that was read from them can be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
