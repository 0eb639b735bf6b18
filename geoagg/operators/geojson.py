"""GeoJSON features of cluster rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _geometry() -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(F.col("lng").cast("double"), F.col("lat").cast("double")).alias("coordinates"))


def _variants(names: list[Column], values: list[Column]) -> Column:
    pairs = [x for n, v in zip(names, values, strict=True) for x in (n, v.cast("variant"))]
    return F.create_map(*pairs)


def flat_features(clusters: DataFrame, metrics: list[str], metadata: DataFrame | None = None) -> DataFrame:
    """(id, feature): properties hold cluster, cluster_id and point_count or id, then metrics, then metadata; later names win."""
    is_cluster = F.col("count") > 1
    head = _variants([F.lit("cluster")], [is_cluster])
    own = F.when(is_cluster, _variants([F.lit("cluster_id"), F.lit("point_count")], [F.col("id"), F.col("count")])).otherwise(_variants([F.lit("id")], [F.col("id")]))
    values = _variants([F.lit(m) for m in metrics], [F.col(m) for m in metrics]) if metrics else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
    values = F.map_filter(values, lambda k, v: v.isNotNull() & ~F.is_variant_null(v))
    maps = [head, own, values]
    if metadata is not None:
        shares = metadata.filter(F.col("kind") == "map").groupBy("cluster_id", "key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "freq")))).alias("m")).select("cluster_id", "key", F.parse_json(F.to_json("m")).alias("v"))
        single = metadata.filter(F.col("kind") == "single")
        single = single.select("cluster_id", "key", F.when(F.col("type") == "n", F.col("value").cast("double").cast("variant")).when(F.col("type") == "b", F.col("value").cast("boolean").cast("variant")).otherwise(F.col("value").cast("variant")).alias("v"))
        rows = shares.unionByName(single).groupBy(F.col("cluster_id").alias("id")).agg(F.collect_list("key").alias("keys"), F.collect_list("v").alias("values"))
        clusters = clusters.join(rows, "id", "left")
        maps.append(F.when(F.col("keys").isNotNull(), F.map_from_arrays("keys", "values")).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))))
    # a column of its own: as an expression it would be built again for each of its entries
    clusters = clusters.select("id", "lng", "lat", F.concat(*[F.map_entries(m) for m in maps]).alias("entries"))
    # later names win: an entry stays if no later one has its name
    last = F.filter("entries", lambda e, i: F.size(F.filter("entries", lambda o, j: (j > i) & (o["key"] == e["key"]))) == 0)
    feature = F.struct(F.lit("Feature").alias("type"), _geometry().alias("geometry"), F.map_from_entries(last).alias("properties"))
    return clusters.select("id", F.to_json(feature).alias("feature"))


def service_features(clusters: DataFrame, metrics: list[str]) -> DataFrame:
    """(id, feature): the service's form, with cluster, point_count, id and nested metrics."""
    values = F.struct(*[F.col(m) for m in metrics]) if metrics else F.lit(None)
    properties = F.struct((F.col("count") > 1).alias("cluster"), F.col("count").alias("point_count"), F.col("id"), values.alias("metrics"))
    return clusters.select("id", F.to_json(F.struct(F.lit("Feature").alias("type"), _geometry().alias("geometry"), properties.alias("properties"))).alias("feature"))


def collection(features: DataFrame) -> DataFrame:
    """One row: the FeatureCollection text, for results that a client reads at once."""
    listed = F.concat_ws(",", F.array_sort(F.collect_list("feature")))
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), listed, F.lit("]}")).alias("collection"))
