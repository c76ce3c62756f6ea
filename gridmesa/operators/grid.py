"""Stencils over walk cells and tiles: each takes and returns rows keyed by (map_id, x, y).

Neighbours come from windows over one column or row of one map, so a task never holds more than that; maps spread out by map_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["map_id", "x", "y"]


def fresh(df: DataFrame) -> DataFrame:
    """df under new column identities, so that it can be cogrouped with a frame that it derives from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def dealt(df: DataFrame) -> DataFrame:
    """df in four tasks a core, for small rows of which much is made: their few files would be as few tasks, and adaptive execution joins small partitions again unless they have a number."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def by_map(df: DataFrame) -> DataFrame:
    """df with every map in one of eight tasks a core, so that frames dealt so are joined and grouped by map where they lie. As the partitions have a number, adaptive execution does not join them by their compressed size: cells compress well, and a task sorts them plain."""
    return df.repartition(8 * df.sparkSession.sparkContext.defaultParallelism, "map_id")


def _along_x():
    return Window.partitionBy("map_id", "y").orderBy("x")


def _along_y():
    return Window.partitionBy("map_id", "x").orderBy("y")


def _size(cells: DataFrame) -> DataFrame:
    """cells with the width w and height h of their map."""
    own = Window.partitionBy("map_id")
    return cells.withColumns({"w": F.max("x").over(own) + 1, "h": F.max("y").over(own) + 1})


def raw_walkability(cells: DataFrame) -> DataFrame:
    """Column raw becomes false in the four bottom rows, and in four more for the twenty leftmost and rightmost columns."""
    edge = (F.col("y") >= F.col("h") - 4) | ((F.col("y") >= F.col("h") - 8) & ((F.col("x") < 20) | (F.col("x") >= F.col("w") - 20)))
    return _size(cells).withColumn("raw", F.col("raw") & ~edge).drop("w", "h")


def distance_init(cells: DataFrame, walkable: str = "raw") -> DataFrame:
    """dt: 0 for unwalkable cells, 1 for walkable ones on the edge of the map, else -1."""
    border = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("w") - 1) | (F.col("y") == F.col("h") - 1)
    return _size(cells).withColumn("dt", F.when(~F.col(walkable), 0).when(border, 1).otherwise(-1)).drop("w", "h")


def clearance_filter(cells: DataFrame) -> DataFrame:
    """open: some 3 x 3 box of raw cells, centred on the cell or with it as a corner, is inside the map and fully walkable."""
    near_y, near_x = _along_y().rowsBetween(-1, 1), _along_x().rowsBetween(-1, 1)
    column = cells.withColumn("_c", F.bool_and("raw").over(near_y) & (F.count("*").over(near_y) == 3))
    full = column.withColumn("_f", F.bool_and("_c").over(near_x) & (F.count("*").over(near_x) == 3))
    beside = full.withColumn("_v", F.lag("_f", 1, False).over(_along_y()) | F.lead("_f", 1, False).over(_along_y()))
    out = beside.withColumn("open", F.col("_f") | F.lag("_v", 1, False).over(_along_x()) | F.lead("_v", 1, False).over(_along_x()))
    return out.drop("_c", "_f", "_v")


def thicken_thin_walls(cells: DataFrame) -> DataFrame:
    """walk: open, unless the next cell to the right is closed and in a wall of at most two raw cells among five."""
    wide = _along_x().rowsBetween(-2, 2)
    inside = (F.col("x") >= 2) & (F.col("x") < F.col("w") - 2)
    thin = _size(cells).withColumn("_thin", inside & ~F.col("open") & (F.sum(F.when(F.col("raw"), 0).otherwise(1)).over(wide) <= 2))
    return thin.withColumn("walk", F.col("open") & ~F.lead("_thin", 1, False).over(_along_x())).drop("_thin", "w", "h")


def tile_walkability(cells: DataFrame) -> DataFrame:
    """Tiles whose sixteen raw cells are all walkable."""
    return cells.groupBy("map_id", F.floor(F.col("x") / 4).cast("int").alias("tx"), F.floor(F.col("y") / 4).cast("int").alias("ty")).agg(F.bool_and("raw").alias("walkable"))


def _smoothed(cells: DataFrame, walk: str, along, at: str, applies: Column) -> DataFrame:
    """The border's first four cells: all behind a closed one close; else each stays open only if all behind it, up to the fourth, are."""
    w = [F.first(walk).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))] + [F.nth_value(walk, k).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for k in (2, 3, 4)]
    kept = {0: w[0] & w[1] & w[2] & w[3], 1: w[1] & w[2] & w[3], 2: w[2] & w[3], 3: w[3]}
    value = F.col(walk)
    for k, v in kept.items():
        value = F.when(applies & (F.col(at) == k), w[0] & v if k else v).otherwise(value)
    return cells.withColumn(walk, value)


def smooth_top(cells: DataFrame, walk: str = "walk") -> DataFrame:
    return _smoothed(_size(cells), walk, _along_y(), "y", (F.col("x") >= 1) & (F.col("x") <= F.col("w") - 2)).drop("w", "h")


def smooth_left(cells: DataFrame, walk: str = "walk") -> DataFrame:
    return _smoothed(_size(cells), walk, _along_x(), "x", F.col("y") <= F.col("h") - 2).drop("w", "h")


def fill_top_gap(cells: DataFrame, walk: str = "walk") -> DataFrame:
    """On the top row two open cells between closed ones close."""
    v = lambda k: F.lag(walk, -k).over(_along_x()) if k < 0 else F.lead(walk, k).over(_along_x())
    left = lambda k: F.lag(walk, k).over(_along_x())
    gap = F.col(walk) & ((~left(1) & v(1) & ~v(2)) | (~left(2) & left(1) & ~v(1)))
    return cells.withColumn(walk, F.col(walk) & ~((F.col("y") == 0) & F.coalesce(gap, F.lit(False))))


def fill_right_gap(cells: DataFrame, walk: str = "walk") -> DataFrame:
    """On the right column one open cell between closed ones closes."""
    gap = ~F.lag(walk, 1).over(_along_y()) & ~F.lead(walk, 1).over(_along_y())
    return _size(cells).withColumn(walk, F.col(walk) & ~((F.col("x") == F.col("w") - 1) & F.coalesce(gap, F.lit(False)))).drop("w", "h")


def building_cells(buildings: DataFrame, margin: int = 0) -> DataFrame:
    """The walk cells under each building's rectangle, widened by a margin: one row per cell, from exploded ranges instead of a range join."""
    x1, y1 = F.floor(F.col("px") / 8).cast("int") - 2 * F.col("tw"), F.floor(F.col("py") / 8).cast("int") - 2 * F.col("th")
    xs = buildings.select("map_id", y1.alias("_y"), "th", F.explode(F.sequence(x1 - margin, x1 + 4 * F.col("tw") + margin)).alias("x"))
    return xs.select("map_id", "x", F.explode(F.sequence(F.col("_y") - margin, F.col("_y") + 4 * F.col("th") + margin)).alias("y")).distinct()


def stamp_buildings(cells: DataFrame, buildings: DataFrame, walk: str = "walk") -> DataFrame:
    """walk becomes false under buildings and one cell around; dt becomes 0 under them. raw stays."""
    under = building_cells(buildings).withColumn("_under", F.lit(True))
    around = building_cells(buildings, 1).withColumn("_around", F.lit(True))
    out = cells.join(under, KEY, "left").join(around, KEY, "left")
    columns = {walk: F.col(walk) & F.col("_around").isNull()}
    if "dt" in cells.columns:
        columns["dt"] = F.when(F.col("_under"), 0).otherwise(F.col("dt"))
    return out.withColumns(columns).drop("_under", "_around")


def stamp_tiles(tiles: DataFrame, buildings: DataFrame) -> DataFrame:
    """walkable becomes false for every tile (map_id, tx, ty) that a building's rectangle of walk cells touches."""
    quarter = lambda c: F.floor(F.col(c) / 4).cast("int")
    under = building_cells(buildings).select("map_id", quarter("x").alias("tx"), quarter("y").alias("ty")).distinct().withColumn("_under", F.lit(True))
    return tiles.join(under, ["map_id", "tx", "ty"], "left").withColumn("walkable", F.col("walkable") & F.col("_under").isNull()).drop("_under")


def prepared(cells: DataFrame, buildings: DataFrame) -> DataFrame:
    """All preparation in its fixed order."""
    walk = thicken_thin_walls(clearance_filter(cells))
    return stamp_buildings(fill_right_gap(smooth_left(fill_top_gap(smooth_top(walk)))), buildings)


def reset_results(cells: DataFrame) -> DataFrame:
    """The six result grids, empty."""
    return cells.select(*KEY, *[F.lit(None).cast("int").alias(c) for c in ("region", "base", "choke", "obstacle", "tile_base", "tile_choke")])


def level_sets(start: np.ndarray) -> np.ndarray:
    """Chebyshev distance transform: start holds seeds (0 or 1) and -1; the least of seed plus distance."""
    far = start.shape[0] + start.shape[1] + 2
    dt = np.where(start < 0, far, start)
    while True:
        padded = np.pad(dt, 1, constant_values=far)
        least = np.minimum.reduce([padded[i : i + dt.shape[0], j : j + dt.shape[1]] for i in range(3) for j in range(3)])
        new = np.minimum(dt, least + 1)
        if (new == dt).all():
            return np.where(dt >= far, -1, dt)
        dt = new


def dense(pdf: pd.DataFrame, value: str, fill=0) -> np.ndarray:
    """x by y array of one map's cells."""
    out = np.full((int(pdf.x.max()) + 1, int(pdf.y.max()) + 1), fill, dtype=pdf[value].to_numpy().dtype if pdf[value].dtype != object else object)
    out[pdf.x, pdf.y] = pdf[value]
    return out


def distance_transform(cells: DataFrame, walkable: str = "raw") -> DataFrame:
    """(map_id, x, y, dt): steps to the nearest unwalkable cell, or to the map's edge plus one. One map at a time per task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[KEY].assign(dt=level_sets(dense(pdf, "dt"))[pdf.x, pdf.y].astype("int32"))

    return distance_init(cells, walkable).select(*KEY, "dt").groupBy("map_id").applyInPandas(run, "map_id string, x int, y int, dt int")


def tile_maximum(dt: DataFrame) -> DataFrame:
    return dt.groupBy("map_id", F.floor(F.col("x") / 4).cast("int").alias("tx"), F.floor(F.col("y") / 4).cast("int").alias("ty")).agg(F.max("dt").alias("dt"))


def region_maximum(tile_dt: DataFrame, labels: DataFrame) -> DataFrame:
    """Largest tile value of each region; a tile belongs to the region of its top-left cell. labels: map_id, x, y, label (0: none)."""
    corner = labels.where((F.col("x") % 4 == 0) & (F.col("y") % 4 == 0) & (F.col("label") > 0)).select("map_id", F.floor(F.col("x") / 4).cast("int").alias("tx"), F.floor(F.col("y") / 4).cast("int").alias("ty"), "label")
    return corner.join(tile_dt, ["map_id", "tx", "ty"]).groupBy("map_id", "label").agg(F.max("dt").alias("max_dt"))


def placeable(tiles: DataFrame, buildable: str = "buildable", tw: int = 4, th: int = 3) -> DataFrame:
    """placeable: the tw x th tiles right and down of the tile are inside the map and buildable. tiles: map_id, x, y."""
    right, down = _along_x().rowsBetween(0, tw - 1), _along_y().rowsBetween(0, th - 1)
    row = tiles.withColumn("_r", F.bool_and(buildable).over(right) & (F.count("*").over(right) == tw))
    return row.withColumn("placeable", F.bool_and("_r").over(down) & (F.count("*").over(down) == th)).drop("_r")


def grid_text(cells: DataFrame, value: str, delimiter: str = "") -> DataFrame:
    """(map_id, y, line): one text line per row of the map, cells in the order of x."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("x", F.col(value).cast("string").alias("v")))), lambda c: c["v"])
    return cells.groupBy("map_id", "y").agg(F.array_join(ordered, delimiter, "").alias("line"))
