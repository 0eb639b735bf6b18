"""Roll-ups of grouped points: count, weighted centre, metric sums, metadata frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoagg.functions import projection as P
from geoagg.functions import texts
from geoagg.operators.greedy import MAX_GROUP, greedy_groups
from geoagg.operators.viewport import viewport
from geoagg.options import Bounds, ClusterOptions
from geoagg.sources.scratch import stored


#: Rows up to which the clusters' sizes are sent to all.
FEW_SIZES = 200_000


def members(points: DataFrame, bounds: Bounds, zoom: int, options: ClusterOptions = ClusterOptions(), order: str = "x", wrap: bool = False, max_group: int = MAX_GROUP, sized: bool = True) -> DataFrame:
    """The points of a viewport with x, y, cluster_id (the seed's id) and, if ``sized``, group_size and ``grouped`` (taken as a group,
    not left alone)."""
    inside = viewport(points.dropDuplicates(["id"]), bounds, zoom, options, wrap)
    groups = greedy_groups(inside, options.radius, options.min_points, order, max_group)
    # where few columns are read, the planner takes either side for small and would send all points through the driver
    out = inside.hint("merge").join(groups.hint("merge"), "id")
    if not sized:
        return out
    sizes = stored(groups.groupBy("cluster_id").agg(F.count("*").alias("group_size")), "sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= FEW_SIZES else sizes.hint("merge")
    return out.join(sizes, "cluster_id").withColumn("grouped", F.col("group_size") >= options.min_points)


def exact_sum(c: Column) -> Column:
    """A sum that does not depend on the order of the rows."""
    return F.sum(c.cast("decimal(24,6)")).cast("double")


def cluster_rows(grouped: DataFrame, zoom: int, metrics: list[str], options: ClusterOptions = ClusterOptions(), weight: str | None = None) -> DataFrame:
    """One row a cluster: id, count, lng, lat, children, and the sum of each metric (null: no point has it).

    ``weight``: a column with the number of points that a row stands for, for roll-ups of roll-ups.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    mean = lambda c: (F.sum(F.col(c).cast("double") * w) / F.sum(w)).cast("float")
    sums = [exact_sum(F.col(m)).alias(m) for m in metrics]
    out = grouped.groupBy("cluster_id").agg(F.sum(w).cast("long").alias("count"), mean("x").alias("x"), mean("y").alias("y"), F.array_sort(F.collect_list("id")).alias("children"), *sums)
    return out.select(F.col("cluster_id").alias("id"), "count", P.unproject_lng(F.col("x"), zoom, options).alias("lng"), P.unproject_lat(F.col("y"), zoom, options).alias("lat"), "children", *metrics)


def metadata_rows(grouped: DataFrame, metadata: dict[str, str]) -> DataFrame:
    """Long metadata of clusters: cluster_id, count, key, kind, type, value, freq.

    ``metadata``: column -> "s" (text), "n" (number) or "b" (truth value). ``kind`` "map": the share of the value among the points that
    have the key; "single": the value of a point left alone, freq 1. Points without the key do not count.
    """
    text = {"s": lambda c: c.cast("string"), "n": texts.shortest, "b": lambda c: c.cast("string")}
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(t).alias("type"), text[t](F.col(k)).alias("value")) for k, t in metadata.items()])
    # dealt by cluster once, before the rows are multiplied: both counts are taken where the rows lie
    dealt = grouped.select("cluster_id", "group_size", "grouped", *metadata).repartition("cluster_id")
    rows = dealt.select("cluster_id", "group_size", "grouped", F.explode(entries).alias("e")).select("cluster_id", "group_size", "grouped", "e.*").filter(F.col("value").isNotNull())
    counts = rows.groupBy("cluster_id", "group_size", "grouped", "key", "type", "value").agg(F.count("*").alias("n"))
    counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy("cluster_id", "key", "type")))  # a key has one type
    return counts.select("cluster_id", F.col("group_size").alias("count"), "key", F.when(F.col("grouped"), "map").otherwise("single").alias("kind"), "type", "value", (F.col("n") / F.col("total")).alias("freq"))


def nested_rollup(clusters: DataFrame, group: Column, metrics: list[str]) -> DataFrame:
    """Clusters as weighted points, rolled up again: group_id, count, lng and lat weighted by count, metric sums."""
    mean = lambda c: F.sum(F.col(c).cast("double") * F.col("count")) / F.sum("count")
    return clusters.groupBy(group.alias("group_id")).agg(F.sum("count").alias("count"), mean("lng").alias("lng"), mean("lat").alias("lat"), *[exact_sum(F.col(m)).alias(m) for m in metrics])
