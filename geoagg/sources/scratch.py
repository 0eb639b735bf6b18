"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Lets Spark remove the shuffle files of a query when the query ends, not when the driver next collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; removed when the driver exits.

    Where the setting is absent (unit tests on one machine) it lies below the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    path = f"{base.rstrip('/')}/geo-{uuid.uuid4().hex}/{name}"
    atexit.register(_remove, spark, path.rpartition("/")[0])
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended before this hook ran
        return


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path.rpartition("/")[0]
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing will read any more."""
    for df in tables:
        _remove(df.sparkSession, df._scratch)
