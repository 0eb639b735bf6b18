"""Projection of points and viewport filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoagg.functions import projection as P
from geoagg.options import Bounds, ClusterOptions

#: Degrees by which the raw filter is wider than the projected one; float rounding is about 2e-5.
PAD = 1e-3


def with_projection(points: DataFrame, zoom: int, options: ClusterOptions = ClusterOptions()) -> DataFrame:
    """``points`` (id, lng, lat, ..) with pixel coordinates x and y at ``zoom``."""
    return points.withColumns({"x": P.project_x(F.col("lng"), zoom, options), "y": P.project_y(F.col("lat"), zoom, options)})


def raw_filter(bounds: Bounds) -> Column:
    """A filter on the stored coordinates that keeps all rows of ``bounds``: it reaches the Parquet scan.

    Latitudes are clamped before projection, so a bound at the clamp lets all rows beyond it in.
    """
    keep = (F.col("lng") >= bounds.min_x - PAD) & (F.col("lng") <= bounds.max_x + PAD)
    if bounds.max_y < 85.05:
        keep = keep & (F.col("lat") <= bounds.max_y + PAD)
    if bounds.min_y > -85.05:
        keep = keep & (F.col("lat") >= bounds.min_y - PAD)
    return keep


def projected_bounds(bounds: Bounds, zoom: int, options: ClusterOptions = ClusterOptions()) -> tuple[Column, Column, Column, Column]:
    """(min x, min y, max x, max y) in pixels; y grows to the south."""
    f = lambda v: F.lit(v).cast("float")
    return P.project_x(f(bounds.min_x), zoom, options), P.project_y(f(bounds.max_y), zoom, options), P.project_x(f(bounds.max_x), zoom, options), P.project_y(f(bounds.min_y), zoom, options)


def viewport(points: DataFrame, bounds: Bounds, zoom: int, options: ClusterOptions = ClusterOptions(), wrap: bool = False) -> DataFrame:
    """Projected points inside the closed rectangle. ``wrap``: a west bound beyond the east one crosses the date line."""
    if wrap and bounds.min_x > bounds.max_x:
        east = viewport(points, Bounds(bounds.min_x, bounds.min_y, 180.0, bounds.max_y), zoom, options)
        return east.unionByName(viewport(points, Bounds(-180.0, bounds.min_y, bounds.max_x, bounds.max_y), zoom, options))
    x0, y0, x1, y1 = projected_bounds(bounds, zoom, options)
    inside = F.col("x").between(x0, x1) & F.col("y").between(y0, y1)
    return with_projection(points.filter(raw_filter(bounds)), zoom, options).filter(inside)


def batch_viewports(points: DataFrame, views: DataFrame, cell: float = 10.0) -> DataFrame:
    """(view_id, id, lng, lat) for many rectangles (view_id, min_x, min_y, max_x, max_y in degrees), closed.

    A range join as an equi-join on grid cells of ``cell`` degrees: each view is listed under the cells it touches, each point
    lies in one; Spark broadcasts the views or shuffles both sides by cell as their sizes ask for.
    """
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell).cast("int"), F.floor(F.greatest(F.col(lo), F.col(hi)) / cell).cast("int"))
    listed = views.withColumn("cx", F.explode(cells("min_x", "max_x"))).withColumn("cy", F.explode(cells("min_y", "max_y")))
    placed = points.withColumns({"cx": F.floor(F.col("lng") / cell).cast("int"), "cy": F.floor(F.col("lat") / cell).cast("int")})
    met = placed.join(listed, ["cx", "cy"])
    return met.filter(F.col("lng").between(F.col("min_x"), F.col("max_x")) & F.col("lat").between(F.col("min_y"), F.col("max_y"))).drop("cx", "cy", "min_x", "min_y", "max_x", "max_y")


def batch_projected(points: DataFrame, views: DataFrame, zooms: tuple[int, ...], options: ClusterOptions = ClusterOptions()) -> DataFrame:
    """``batch_viewports`` for views with a ``zoom`` (one of ``zooms``): points with x and y at their view's zoom, inside its pixels."""
    at = lambda project, c: F.coalesce(*[F.when(F.col("zoom") == z, project(F.col(c), z, options)) for z in zooms])
    views = views.withColumns({"_x0": at(P.project_x, "min_x"), "_y0": at(P.project_y, "max_y"), "_x1": at(P.project_x, "max_x"), "_y1": at(P.project_y, "min_y")})
    # the filter in degrees is wider than the one in pixels, as in raw_filter
    south, north = F.when(F.col("min_y") <= -85.05, -90.0).otherwise(F.col("min_y") - PAD), F.when(F.col("max_y") >= 85.05, 90.0).otherwise(F.col("max_y") + PAD)
    views = views.withColumns({"min_x": F.col("min_x") - PAD, "max_x": F.col("max_x") + PAD, "min_y": south, "max_y": north})
    met = batch_viewports(points, views).withColumns({"x": at(P.project_x, "lng"), "y": at(P.project_y, "lat")})
    return met.filter(F.col("x").between(F.col("_x0"), F.col("_x1")) & F.col("y").between(F.col("_y0"), F.col("_y1"))).drop("_x0", "_y0", "_x1", "_y1")


def overlapping(a: DataFrame, b: DataFrame) -> Column:
    """Whether two rectangles (min_x .. max_y of either side) meet, edges included."""
    return (a["max_x"] >= b["min_x"]) & (a["min_x"] <= b["max_x"]) & (a["max_y"] >= b["min_y"]) & (a["min_y"] <= b["max_y"])


def density_sample(points: DataFrame, bounds: Bounds, zoom: int, every: int, options: ClusterOptions = ClusterOptions()) -> DataFrame:
    """One row (sampled, inside, ratio): the share of every ``every``-th point, by id, that lies in the viewport."""
    x0, y0, x1, y1 = projected_bounds(bounds, zoom, options)
    some = with_projection(points.filter(F.col("id") % every == 0), zoom, options)
    inside = F.count_if(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    return some.agg(F.count("*").alias("sampled"), inside.alias("inside")).withColumn("ratio", F.when(F.col("sampled") > 0, F.col("inside") / F.col("sampled")))


def scan_method(zoom: Column, rows: Column, ratio: Column, max_zoom: int = 16) -> Column:
    """The scan that the rule of thumb picks; Spark needs none of them, the name is for reports."""
    dense = F.when(ratio < 0.01, "index").when(ratio > 0.4, "parallel").otherwise("sequential")
    return F.when(zoom >= max_zoom - 2, "index").when(rows > 100_000, dense).otherwise("sequential")
