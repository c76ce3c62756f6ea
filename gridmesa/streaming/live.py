"""Streams of unit positions and building events against a map's finished fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridmesa.operators import grid


def region_traffic(positions: DataFrame, labels: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Counts by region and window of a stream of positions (map_id, x, y, ts): a stream-static join, then a windowed count with a watermark."""
    own = labels.where("label > 0").select("map_id", "x", "y", F.col("label").alias("region"))
    return positions.withWatermark("ts", late).join(own, ["map_id", "x", "y"]).groupBy(F.window("ts", window), "map_id", "region").agg(F.count("*").alias("n"))


def follow_buildings(events: DataFrame, cells: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """For each batch of building events (map_id, id, px, py, tw, th), the walk cells with those buildings stamped, handed to sink(cells, batch)."""
    return events.writeStream.foreachBatch(lambda batch, n: sink(grid.stamp_buildings(cells, batch), n)).option("checkpointLocation", checkpoint).start()
