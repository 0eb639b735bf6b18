"""Points computed from the tables, and generated ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _place(clump: str, jitter: str) -> tuple[Column, Column]:
    c, j = F.col(clump), F.col(jitter)
    lng = F.lit(-125.0) + ((c * 7919) % 55000) / F.lit(1000.0) + ((j * 7907) % 2000) / F.lit(1000.0)
    lat = F.lit(26.0) + ((c * 104729) % 20000) / F.lit(1000.0) + ((j * 7877) % 1600) / F.lit(1000.0)
    return lng.cast("float"), lat.cast("float")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lng, lat, metrics value and k, metadata event_type, k_meta (number), even, timestamp (text)."""
    lng, lat = _place("user_id", "event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").cast("long").alias("id"), lng.alias("lng"), lat.alias("lat"), "value", k.cast("double").alias("k"), "event_type", k.cast("double").alias("level"), (k % 2 == 0).alias("even"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")
    )


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lng, lat = _place("o_custkey", "o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("id"), lng.alias("lng"), lat.alias("lat"), F.col("o_totalprice").alias("value"), "o_orderstatus", "o_orderpriority")


def _uniform(seed: int) -> Column:
    """A number in [0, 1) from the row's id, the same in every run and on every engine."""
    return ((F.col("id") * 1103515245 + seed * 12345 + 1013904223) % 1000003) / F.lit(1000003.0)


#: Categories and regions of generated points, in turn.
CATEGORIES = ("retail", "food", "health", "office", "school", "park", "home")
REGIONS = ("north", "south", "east", "west", "central")


def _turn(values: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), (F.col("id") % len(values) + 1).cast("int"))


def _between(low: float, high: float, seed: int) -> Column:
    return (F.lit(low) + _uniform(seed) * (high - low)).cast("float")


def _attributes(seed: int) -> dict[str, Column]:
    """The metrics and the metadata of generated points."""
    # thirty days from a fixed instant, as a time without a zone, so that the text does not depend on the session
    at = F.expr("timestamp_ntz'2023-11-14 22:13:20'") + F.make_dt_interval(secs=F.floor(_uniform(seed + 6) * 2_592_000).cast("decimal(18,6)"))
    return {
        "value": _between(0.0, 100.0, seed + 2), "sales": _between(0.0, 1000.0, seed + 3), "size": _between(0.0, 50.0, seed + 4), "customers": _between(0.0, 500.0, seed + 5).cast("int").cast("float"),
        "category": _turn(CATEGORIES), "region": _turn(REGIONS), "elevation": _between(0.0, 3000.0, seed + 7), "timestamp": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    }


def uniform_points(spark: SparkSession, n: int, bounds=(-180.0, -90.0, 180.0, 90.0), seed: int = 42) -> DataFrame:
    """``n`` points spread over a rectangle, with metrics value, sales, size and customers and metadata category (7), region (5),
    elevation and timestamp."""
    x0, y0, x1, y1 = bounds
    columns = {"lng": _between(x0, x1, seed), "lat": _between(y0, y1, seed + 1), **_attributes(seed)}
    return spark.range(n).select("id", *[c.alias(k) for k, c in columns.items()])


#: Cities that points are dealt around.
CITIES = [("New York", 40.7128, -74.0060), ("Los Angeles", 34.0522, -118.2437), ("Chicago", 41.8781, -87.6298)]


def city_points(spark: SparkSession, n: int, miles: float = 50.0, seed: int = 42) -> DataFrame:
    """``n`` points dealt in turn around three cities, evenly within ``miles`` (69 miles a degree of latitude)."""
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("id") % len(CITIES) + 1).cast("int"))
    reach, angle = F.sqrt(_uniform(seed)) * (miles / 69.0), _uniform(seed + 1) * 2.0 * F.pi()
    lat = pick([c[1] for c in CITIES])
    place = {"city": pick([c[0] for c in CITIES]), "lng": pick([c[2] for c in CITIES]) + reach * F.cos(angle) / F.cos(F.radians(lat)), "lat": lat + reach * F.sin(angle)}
    return spark.range(n).select("id", *[c.alias(k) for k, c in {**place, **_attributes(seed)}.items()])
