"""Saved datasets: tile-clustered Parquet with a side file of options in a folder named after them, and the catalog of the names."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoagg.operators.index import tile
from geoagg.options import ClusterOptions

NAME = r"^cluster-([0-9]+)p-([0-9]{8})-([0-9]{6})-([^-]+)\.zst$"


def save(points: DataFrame, path: str, options: ClusterOptions, partitions: int | None = None) -> None:
    """Points sorted by tile, so that files and row groups cover small rectangles, and the options as one JSON row."""
    placed = points.withColumn("_tile", tile(2.0))
    ranged = placed.repartitionByRange(partitions, "_tile", "lng") if partitions else placed.repartitionByRange("_tile", "lng")
    ranged.sortWithinPartitions("_tile", "lng").drop("_tile").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/points")
    spark = points.sparkSession
    spark.createDataFrame([tuple(asdict(options).values())], "min_zoom int, max_zoom int, min_points int, radius double, node_size int, extent int").coalesce(1).write.mode("overwrite").json(f"{path}/options")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, ClusterOptions]:
    row = spark.read.schema("min_zoom int, max_zoom int, min_points int, radius double, node_size int, extent int").json(f"{path}/options").first()
    return spark.read.parquet(f"{path}/points"), ClusterOptions(**row.asDict())


def saved_name(rows: Column, at: Column, unique: Column) -> Column:
    """``cluster-<rows>p-<yyyymmdd>-<hhmmss>-<first 8 of unique>.zst``"""
    return F.concat(F.lit("cluster-"), rows.cast("string"), F.lit("p-"), F.date_format(at, "yyyyMMdd-HHmmss"), F.lit("-"), F.substring(unique, 1, 8), F.lit(".zst"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(name, file_size) of the datasets in a folder; a row a dataset, read from the file system by the driver."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [s for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []
    return spark.createDataFrame([(s.getPath().getName(), fs.getContentSummary(s.getPath()).getLength()) for s in there], "name string, file_size long")


def listed(files: DataFrame) -> DataFrame:
    """name, id, num_points, saved_at, file_size of the names in ``files`` (name, file_size) that follow the pattern, latest first."""
    part = lambda i: F.regexp_extract("name", NAME, i)
    at = F.try_to_timestamp(F.concat(part(2), part(3)), F.lit("yyyyMMddHHmmss"))
    rows = files.filter(F.col("name").rlike(NAME)).select("name", part(4).alias("id"), part(1).try_cast("long").alias("num_points"), at.alias("saved_at"), "file_size")
    return rows.filter(F.col("num_points").isNotNull() & F.col("saved_at").isNotNull()).orderBy(F.desc("saved_at"))


def named(files: DataFrame, key: str) -> DataFrame:
    """The dataset with just this id: ``listed`` with its ``name``, the latest if there are several."""
    return listed(files).filter(F.col("id") == key).limit(1)


def find(files: DataFrame, wanted: str) -> DataFrame:
    """The first name, in text order, that contains the id and ends as a dataset does."""
    return files.filter(F.col("name").contains(wanted) & F.col("name").endswith(".zst")).orderBy("name").limit(1)
