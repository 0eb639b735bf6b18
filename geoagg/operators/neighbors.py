"""Pairs of points within a radius: an equi-join on grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells are a little wider than the radius, so that rounding at a cell's edge never hides a neighbour one cell further.
SLACK = 1.001


def within(ax: Column, ay: Column, bx: Column, by: Column, radius: float) -> Column:
    """Distance at most ``radius``, in single precision; the plain difference on x is tested as well."""
    dx, dy = (bx - ax).cast("float"), (by - ay).cast("float")
    r = F.lit(radius).cast("float")
    return (F.abs(dx) <= r) & (((dx * dx).cast("float") + (dy * dy).cast("float")).cast("float") <= (r * r).cast("float"))


def celled(projected: DataFrame, radius: float) -> DataFrame:
    size = radius * SLACK
    return projected.withColumns({"cx": F.floor(F.col("x").cast("double") / size).cast("long"), "cy": F.floor(F.col("y").cast("double") / size).cast("long")})


def neighbor_pairs(projected: DataFrame, radius: float) -> DataFrame:
    """(id, other, ..): each pair within ``radius`` once, id < other. The smaller side of the join is copied to half its cells."""
    points = celled(projected.select("id", "x", "y"), radius)
    # each unordered pair of cells is visited from one side: right, and the row above; within a cell by id
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))])
    left = points.withColumn("s", F.explode(steps)).select(F.col("id").alias("id_a"), F.col("x").alias("xa"), F.col("y").alias("ya"), (F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy"), ((F.col("s.dx") == 0) & (F.col("s.dy") == 0)).alias("same"))
    right = points.select(F.col("id").alias("id_b"), F.col("x").alias("xb"), F.col("y").alias("yb"), "cx", "cy")
    met = left.join(right, ["cx", "cy"]).filter((~F.col("same") | (F.col("id_a") < F.col("id_b"))) & within(F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb"), radius))
    return met.select(F.least("id_a", "id_b").alias("id"), F.greatest("id_a", "id_b").alias("other"))


def neighbor_counts(projected: DataFrame, radius: float) -> DataFrame:
    """(id, neighbors): the number of other points within ``radius``, zero included."""
    pairs = neighbor_pairs(projected, radius)
    both = pairs.select(F.explode(F.array("id", "other")).alias("id")).groupBy("id").agg(F.count("*").alias("neighbors"))
    return projected.select("id").join(both, "id", "left").select("id", F.coalesce("neighbors", F.lit(0)).alias("neighbors"))
