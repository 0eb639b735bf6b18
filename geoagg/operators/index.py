"""Bounds, tile statistics and splits: what a spatial index keeps, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dataset_bounds(points: DataFrame) -> DataFrame:
    return points.agg(F.min("lng").alias("min_x"), F.min("lat").alias("min_y"), F.max("lng").alias("max_x"), F.max("lat").alias("max_y"))


def tile(degrees: float = 5.0) -> Column:
    """A tile number of the raw coordinates, row by row from the south-west."""
    return (F.floor((F.col("lat").cast("double") + 90.0) / degrees) * F.lit(int(360 / degrees)) + F.floor((F.col("lng").cast("double") + 180.0) / degrees)).cast("long")


def tile_stats(points: DataFrame, degrees: float = 5.0) -> DataFrame:
    """Per tile: number of points, bounds, smallest and largest id."""
    return points.groupBy(tile(degrees).alias("tile")).agg(
        F.count("*").alias("n"), F.min("lng").alias("min_x"), F.min("lat").alias("min_y"), F.max("lng").alias("max_x"), F.max("lat").alias("max_y"), F.min("id").alias("min_id"), F.max("id").alias("max_id")
    )


def median_split(points: DataFrame, axis: str = "lng", group: str = "tile") -> DataFrame:
    """Per group the middle point on an axis (ties by id) and the sizes of the two halves beside it."""
    w = Window.partitionBy(group)
    ranked = points.withColumns({"rank": F.row_number().over(w.orderBy(axis, "id")) - 1, "n": F.count("*").over(w)})
    middle = F.floor((F.col("n") - 1) / 2)
    return ranked.filter(F.col("rank") == middle).select(group, F.col("id").alias("median_id"), F.col(axis).alias("split"), F.col("rank").cast("long").alias("left_n"), (F.col("n") - F.col("rank") - 1).cast("long").alias("right_n"))


def point_lookup(points: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of the wanted ids."""
    return points.join(ids, "id")
