"""Statistics of how alike a map's start positions are. Deviations are of the population; any number of starts; null where there are too few."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _spread(name: str, column: str) -> list:
    return [F.round(F.avg(column), 6).alias(f"mean_{name}"), F.round(F.stddev_pop(column), 6).alias(f"std_{name}")]


def openness(starts: DataFrame) -> DataFrame:
    """Of the starts' regions (map_id, openness, area)."""
    return starts.groupBy("map_id").agg(*_spread("openness", "openness"), *_spread("area", "area"))


def pair_distances(distances: DataFrame, starts: DataFrame, reachable_only: bool = False) -> DataFrame:
    """Of the pairs of starts a < b. Unreached pairs (-1) count unless reachable_only."""
    s = starts.select("map_id", F.col("id").alias("a"))
    pairs = distances.join(s, ["map_id", "a"]).join(s.withColumnRenamed("a", "b"), ["map_id", "b"]).where("a < b")
    return (pairs.where("ground >= 0") if reachable_only else pairs).groupBy("map_id").agg(*_spread("ground", "ground"), *_spread("air", "air"))


def expansions(distances: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows from each start to each base that is no start."""
    s = starts.select("map_id", "id")
    return distances.join(s.withColumnRenamed("id", "a"), ["map_id", "a"]).join(s.withColumnRenamed("id", "b"), ["map_id", "b"], "left_anti")


def two_nearest(distances: DataFrame, starts: DataFrame) -> DataFrame:
    """Of each start's two nearest reachable expansions, and of their sum; a start with fewer counts only where it has one."""
    order = Window.partitionBy("map_id", "a").orderBy("ground", "b")
    near = expansions(distances, starts).where("ground >= 0").withColumn("k", F.row_number().over(order)).where("k <= 2")
    per = near.groupBy("map_id", "a").agg(F.max(F.when(F.col("k") == 1, F.col("ground"))).alias("first"), F.max(F.when(F.col("k") == 2, F.col("ground"))).alias("second"))
    return per.withColumn("both", F.col("first") + F.col("second")).groupBy("map_id").agg(*_spread("first", "first"), *_spread("second", "second"), *_spread("both", "both"))


def all_expansions(distances: DataFrame, starts: DataFrame) -> DataFrame:
    """The deviation over starts of each start's mean and deviation over expansions."""
    per = expansions(distances, starts).groupBy("map_id", "a").agg(F.avg("ground").alias("m"), F.stddev_pop("ground").alias("s"))
    return per.groupBy("map_id").agg(F.round(F.stddev_pop("m"), 6).alias("std_mean"), F.round(F.stddev_pop("s"), 6).alias("std_std"))


def choke_symmetry(paths: DataFrame) -> DataFrame:
    """(map_id, id, width_rms, dist_rms): of each pair's path of chokepoints (array of structs width, dist), the k-th from both ends; null for fewer than two."""
    n = F.size("chokes")
    row = paths.select("map_id", "id", n.alias("n"), "chokes", F.explode_outer(F.when(n >= 2, F.sequence(F.lit(0), F.floor(n / 2).cast("int") - 1))).alias("k"))
    other = F.get("chokes", F.col("n") - 1 - F.col("k"))
    diff = lambda f: F.pow((F.get("chokes", F.col("k"))[f] - other[f]).cast("double"), 2)
    return row.groupBy("map_id", "id").agg(F.round(F.sqrt(F.avg(diff("width"))), 6).alias("width_rms"), F.round(F.sqrt(F.avg(diff("dist"))), 6).alias("dist_rms"))
