"""Micro-batch appends of new points, each batch once, and windowed roll-ups by grid cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoagg.operators.grid import assign_cells
from geoagg.operators.viewport import with_projection


def append_points(stream: DataFrame, path: str, checkpoint: str):
    """Writes each micro-batch to its own folder, so that a batch that runs again replaces itself. Returns the query."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.dropDuplicates(["id"]).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_cells(stream: DataFrame, zoom: int, size: float, time: str = "ts", late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Points per grid cell and time window; late rows up to ``late`` still count."""
    celled = assign_cells(with_projection(stream, zoom), size)
    return celled.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), "cell_x", "cell_y").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "cell_x", "cell_y", "n")
