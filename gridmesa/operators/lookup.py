"""Point lookups (regions, nearest objects, connectivity) as joins. A point outside the map, or on label 0, gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmesa.operators import geometry as geo


def to_walk(points: DataFrame, unit: str) -> DataFrame:
    """x and y in walk cells from pixels (8 to a cell, rounded down) or tiles (the top-left of four cells)."""
    cell = {"pixel": lambda c: F.floor(F.col(c) / 8).cast("int"), "walk": F.col, "tile": lambda c: F.col(c) * 4}[unit]
    return points.withColumns({"x": cell("x"), "y": cell("y")})


def region_of(points: DataFrame, labels: DataFrame, unit: str = "walk") -> DataFrame:
    """points with region."""
    own = labels.where("label > 0").select("map_id", "x", "y", F.col("label").alias("region"))
    return to_walk(points, unit).join(own, ["map_id", "x", "y"], "left")


def nearest_of(points: DataFrame, nearest: DataFrame, name: str) -> DataFrame:
    """points with the id of the nearest object, from a field at the points' resolution (map_id, x, y, id)."""
    return points.join(nearest.where("id >= 0").select("map_id", "x", "y", F.col("id").alias(name)), ["map_id", "x", "y"], "left")


def nearest_unwalkable_position(points: DataFrame, nearest: DataFrame, polygons: DataFrame, max_x: Column, max_y: Column) -> DataFrame:
    """points with (ux, uy): the nearest point of the nearest obstacle's ring, or of the map's edge if that is closer (left, top, right, bottom first)."""
    ring = nearest_of(points, nearest, "label").join(polygons, ["map_id", "label"], "left")
    x, y = F.col("x"), F.col("y")
    on = geo.nearest_on_ring(F.col("ring"), x, y)
    sides = [(x * x, 1, F.lit(0), y), (y * y, 2, x, F.lit(0)), ((max_x - x) * (max_x - x), 3, max_x, y), ((max_y - y) * (max_y - y), 4, x, max_y)]
    options = F.array(F.struct(on["d2"].alias("d"), F.lit(0).alias("k"), on["x"].alias("x"), on["y"].alias("y")), *[F.struct(d.cast("double").alias("d"), F.lit(k).alias("k"), a.cast("int").alias("x"), b.cast("int").alias("y")) for d, k, a, b in sides])
    best = F.array_min(F.filter(options, lambda o: o["d"].isNotNull()))
    return ring.select("map_id", "x", "y", best["x"].alias("ux"), best["y"].alias("uy"))


def connected(pairs: DataFrame, labels: DataFrame, reach: DataFrame) -> DataFrame:
    """pairs (map_id, id, sx, sy, tx, ty) with connected: both ends have regions, and one reaches the other."""
    end = lambda s: labels.where("label > 0").select("map_id", F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"), F.col("label").alias({"s": "a", "t": "b"}[s]))
    joined = pairs.join(end("s"), ["map_id", "sx", "sy"], "left").join(end("t"), ["map_id", "tx", "ty"], "left")
    return joined.join(reach.select("map_id", "a", "b", F.lit(True).alias("_r")), ["map_id", "a", "b"], "left").select("map_id", "id", "sx", "sy", "tx", "ty", F.coalesce("_r", F.lit(False)).alias("connected"))


def start_base(starts: DataFrame, nearest_base: DataFrame) -> DataFrame:
    """Each player's start (map_id, player, tx, ty) with the base nearest to its tile."""
    return starts.join(nearest_base.where("id >= 0").select("map_id", "tx", "ty", F.col("id").alias("base")), ["map_id", "tx", "ty"], "left")
