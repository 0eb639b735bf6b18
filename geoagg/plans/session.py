"""Open datasets and the calls on them: create, load, list, clusters, summary."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoagg.operators import geojson, rollup, summary
from geoagg.options import SERVICE_OPTIONS, Bounds, ClusterOptions
from geoagg.sources import ingest, points, store


class Dataset:
    """Points with their options, metric columns and metadata columns."""

    def __init__(self, df: DataFrame, options: ClusterOptions, metrics: list[str], metadata: list[str]):
        self.df, self.options, self.metrics = df, options.normalized(), metrics
        self.metadata = ingest.metadata_types(df, metadata)
        self._grouped: dict[tuple, DataFrame] = {}

    def members(self, bounds: Bounds, zoom: int, **how) -> DataFrame:
        return rollup.members(self.df, bounds, zoom, self.options, **how)

    def grouped(self, bounds: Bounds, zoom: int) -> DataFrame:
        """``members``, computed once for all results of a viewport and held until another viewport is asked for."""
        if (bounds, zoom) not in self._grouped:
            self.close()
            self._grouped[bounds, zoom] = self.members(bounds, zoom).persist()
        return self._grouped[bounds, zoom]

    def close(self) -> None:
        """Gives back what the dataset holds."""
        while self._grouped:
            self._grouped.popitem()[1].unpersist()
        self.df.unpersist()

    def clusters(self, bounds: Bounds, zoom: int, **how) -> DataFrame:
        return rollup.cluster_rows(self.members(bounds, zoom, **how), zoom, self.metrics, self.options)

    def features(self, bounds: Bounds, zoom: int, flat: bool = True) -> DataFrame:
        grouped = self.grouped(bounds, zoom)
        rows = rollup.cluster_rows(grouped, zoom, self.metrics, self.options)
        return geojson.flat_features(rows, self.metrics, rollup.metadata_rows(grouped, self.metadata)) if flat else geojson.service_features(rows, self.metrics)

    def summary(self, bounds: Bounds, zoom: int) -> dict[str, DataFrame]:
        """The parts of the summary of a viewport; the groups are computed once for all of them."""
        grouped = self.grouped(bounds, zoom)
        rows, meta = rollup.cluster_rows(grouped, zoom, self.metrics, self.options), rollup.metadata_rows(grouped, self.metadata)
        return {"counts": summary.counts(rows), "metrics": summary.metric_stats(rows, self.metrics), "ranges": summary.numeric_range(meta), "times": summary.time_range(meta), "distributions": summary.distribution(meta)}


def lru_victim(opened: DataFrame) -> DataFrame:
    """(id) of the dataset that was used longest ago."""
    return opened.agg(F.min_by("id", F.struct("last_access", "id")).alias("id"))


def expired(opened: DataFrame, now: int, ttl: int = 1800) -> DataFrame:
    """(id) of the datasets unused for more than ``ttl`` seconds."""
    return opened.filter(F.lit(now) - F.col("last_access") > ttl).select("id")


class Session:
    """A registry of open datasets with a cap and a time to live, both also applied when one is created."""

    def __init__(self, spark: SparkSession, root: str, cap: int = 5, ttl: float = 1800.0, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.cap, self.ttl, self.clock = spark, root.rstrip("/"), cap, ttl, clock
        self._open: dict[str, Dataset] = {}
        self._used: dict[str, float] = {}

    def create(self, n: int, options: ClusterOptions = SERVICE_OPTIONS) -> str:
        """Generates, saves and opens ``n`` points; returns the dataset's id."""
        key = uuid.uuid4().hex[:8]
        name = self.spark.range(1).select(store.saved_name(F.lit(n), F.timestamp_seconds(F.lit(int(time.time()))), F.lit(key))).first()[0]
        store.save(points.uniform_points(self.spark, n), f"{self.root}/{name}", options.normalized())
        self.open(key)
        return key

    def list(self) -> DataFrame:
        """id, num_points, saved_at, file_size of the saved datasets, latest first."""
        return store.listed(store.listing(self.spark, self.root)).drop("name")

    def info(self, key: str) -> DataFrame:
        """The row of ``list`` for one dataset, or none."""
        return store.named(store.listing(self.spark, self.root), key).drop("name")

    def open(self, key: str, metrics: Sequence[str] | None = None, metadata: Sequence[str] | None = None) -> Dataset:
        self.sweep()
        if key not in self._open:
            found = store.named(store.listing(self.spark, self.root), key).first()
            if found is None:
                raise KeyError(f"no saved dataset has the id {key}")
            df, options = store.load(self.spark, f"{self.root}/{found['name']}")
            numeric = [c for c, t in df.dtypes if t in ("float", "double") and c not in ("lng", "lat")]
            texts = [c for c, t in df.dtypes if t in ("string", "boolean")]
            self._open[key] = Dataset(df, options, metrics or numeric, metadata or texts)
        self._used[key] = self.clock()
        while len(self._open) > self.cap:
            self._close(min(self._used, key=lambda k: (self._used[k], k)))
        return self._open[key]

    def sweep(self) -> Sequence[str]:
        """Closes what was unused for longer than the time to live."""
        old = [k for k, t in self._used.items() if self.clock() - t > self.ttl]
        for k in old:
            self._close(k)
        return old

    def opened(self) -> Sequence[str]:
        return sorted(self._open)

    def _close(self, key: str) -> None:
        self._open.pop(key).close()
        self._used.pop(key)
