"""Grid cells: the size rule, assignment, roll-up by cell, and the table of methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_factor(zoom: Column, rows: Column, max_zoom: int = 16) -> Column:
    """Cell width as a share of the radius."""
    share = zoom.cast("double") / float(max_zoom)
    base = F.when(zoom < max_zoom // 4, 1.1 - 0.75 * share).when(zoom < max_zoom // 2, 0.9 - 0.3 * share).when(zoom > max_zoom * 3 // 4, 0.7 - 0.2 * share).otherwise(0.75)
    return base * F.when(rows > 50_000, 1.1).when(rows < 5_000, 0.9).otherwise(1.0)


def cell_reach(zoom: Column, rows: Column, max_zoom: int = 16) -> Column:
    """Cells to search on each side."""
    parallel = (rows > 10_000) | ((rows > 5_000) & (zoom < max_zoom // 2))
    return F.when((zoom < max_zoom // 4) & ~parallel, 2).otherwise(1)


def method(zoom: Column, rows: Column, max_zoom: int = 16) -> Column:
    """The clustering method that a viewport of ``rows`` points would have been given; all give ordered greedy groups."""
    grid = (zoom < max_zoom // 4) | ((zoom < max_zoom // 2) & (rows > 10_000)) | (rows > 50_000)
    parallel = (rows > 10_000) | ((rows > 5_000) & (zoom < max_zoom // 2))
    return F.when(grid & parallel, "grid_parallel").when(grid, "grid").when(rows > 10_000, "sweep_parallel").otherwise("sweep")


def assign_cells(projected: DataFrame, size: float) -> DataFrame:
    """``projected`` with cell_x and cell_y of a grid from the origin of the world."""
    cell = lambda c: F.floor(F.col(c).cast("double") / size).cast("long")
    return projected.withColumns({"cell_x": cell("x"), "cell_y": cell("y")})


def cell_rollup(celled: DataFrame, metric: str) -> DataFrame:
    """Per cell: number of points, sum of a metric, mean position."""
    return celled.groupBy("cell_x", "cell_y").agg(
        F.count("*").alias("n"),
        F.sum(F.col(metric).cast("decimal(18,2)")).cast("double").alias("total"),
        F.avg(F.col("x").cast("double")).alias("mean_x"),
        F.avg(F.col("y").cast("double")).alias("mean_y"),
    )
