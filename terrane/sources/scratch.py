"""Scratch tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_roots: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="terrane-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _sweep(spark: SparkSession, root: str) -> None:
    """At the end of the driver; a session that was stopped before leaves its folder to the cluster's cleaning."""
    if SparkContext._active_spark_context is not None and spark.sparkContext._jsc is not None:
        _remove(spark, root)


def table(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors.

    What drop_table() has not removed goes with the application's folder when the driver ends.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/terrane/{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_sweep, spark, root)
    path = f"{root}/{uuid.uuid4().hex}-{tag}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._terrane_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Remove a table() that no later plan reads."""
    if path := getattr(df, "_terrane_path", None):
        _remove(df.sparkSession, path)
