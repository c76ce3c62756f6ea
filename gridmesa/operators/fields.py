"""Fields over cells: nearest objects, walk and ground distances, labels, obstacle contours. One map at a time in a task, many maps at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmesa.operators import kernels as k
from gridmesa.operators.grid import KEY, by_map, dense, fresh

CROSSING = 100_000


def component_labels(cells: DataFrame, of: str, eight: bool = True) -> DataFrame:
    """(map_id, x, y, label): components of the cells where column `of` holds, numbered from 1 by their first cell; 0 elsewhere."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[KEY].assign(label=k.components(dense(pdf, "_m", False).astype(bool), eight)[pdf.x, pdf.y].astype("int32"))

    return cells.withColumn("_m", F.col(of)).select(*KEY, "_m").groupBy("map_id").applyInPandas(run, "map_id string, x int, y int, label int")


def contour_marks(cells: DataFrame, walkable: str) -> DataFrame:
    """Walkable cells beside an obstacle (eight neighbours), found by exploding each obstacle's ring."""
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in k.STRAIGHT + k.DIAGONAL])).alias("d")
    beside = cells.where(~F.col(walkable)).select("map_id", "x", "y", around).select("map_id", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y")).distinct()
    return cells.where(walkable).select(*KEY).join(beside, KEY, "left_semi")


def obstacle_polygons(labels: DataFrame) -> DataFrame:
    """(map_id, label, ring): the outer contour of each label; pockets of up to 40 cells count as filled."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = k.fill_small_holes(dense(pdf, "label"))
        rows = [(pdf.map_id.iloc[0], int(i), [{"x": int(a), "y": int(b)} for a, b in k.contour(grid == i)]) for i in np.unique(grid[grid > 0])]
        return pd.DataFrame(rows, columns=["map_id", "label", "ring"])

    return labels.groupBy("map_id").applyInPandas(run, "map_id string, label int, ring array<struct<x:int,y:int>>")


def filled_labels(labels: DataFrame, most: int = 40) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[KEY].assign(label=k.fill_small_holes(dense(pdf, "label"), most)[pdf.x, pdf.y].astype("int32"))

    return labels.select(*KEY, "label").groupBy("map_id").applyInPandas(run, "map_id string, x int, y int, label int")


def nearest_objects(cells: DataFrame, seeds: DataFrame, walkable: str, crossing: int = CROSSING) -> DataFrame:
    """(map_id, x, y, id, dist): the seed (map_id, x, y, id) with the least cost, straight 8, diagonal 11, `crossing` more to enter an obstacle; ties to the least id."""

    def run(key, pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=["map_id", "x", "y", "id", "dist"])
        walk = dense(pdf, "_w", False).astype(bool)
        dist, near = k.unpacked(k.spread(k.seed_array(walk.shape, zip(own.x, own.y, own.id, strict=True)), np.ones_like(walk), 8, 11, penalty=crossing, walkable=walk))
        return pdf[KEY].assign(id=near[pdf.x, pdf.y].astype("int32"), dist=dist[pdf.x, pdf.y])

    return cells.withColumn("_w", F.col(walkable)).select(*KEY, "_w").groupBy("map_id").cogroup(fresh(seeds.select("map_id", "x", "y", "id")).groupBy("map_id")).applyInPandas(run, "map_id string, x int, y int, id int, dist long")


def ring_seeds(polygons: DataFrame) -> DataFrame:
    return polygons.select("map_id", F.col("label").alias("id"), F.explode("ring").alias("p")).select("map_id", "p.x", "p.y", "id").distinct()


def base_seeds(bases: DataFrame) -> DataFrame:
    """Bases at the centre of their 4 x 3 tiles."""
    return bases.select("map_id", (F.col("tx") * 4 + 8).alias("x"), (F.col("ty") * 4 + 6).alias("y"), "id")


def choke_seeds(chokes: DataFrame) -> DataFrame:
    """Chokepoints at their pixel centre."""
    return chokes.select("map_id", F.floor(F.col("cx") / 8).cast("int").alias("x"), F.floor(F.col("cy") / 8).cast("int").alias("y"), "id")


def tile_mode(nearest: DataFrame) -> DataFrame:
    """(map_id, tx, ty, id): the most frequent id among a tile's sixteen cells, nulls (-1) ignored; ties to the least id."""
    counted = nearest.where("id >= 0").groupBy("map_id", F.floor(F.col("x") / 4).cast("int").alias("tx"), F.floor(F.col("y") / 4).cast("int").alias("ty"), "id").agg(F.count("*").alias("n"))
    best = Window.partitionBy("map_id", "tx", "ty").orderBy(F.desc("n"), "id")
    return counted.withColumn("_p", F.row_number().over(best)).where("_p = 1").select("map_id", "tx", "ty", "id")


def area_distance(cells: DataFrame, boxes: DataFrame, walkable: str = "raw", bound: int = 400) -> DataFrame:
    """(map_id, box, x, y, dist): walk distance, 10 and 14, from each rectangle (map_id, box, x1, y1, x2, y2), no farther than `bound`."""

    def run(key, pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        walk = dense(pdf, "_w", False).astype(bool) if len(pdf) else None
        for r in own.itertuples() if len(pdf) else ():
            seeds = np.full(walk.shape, k.FAR)
            seeds[max(0, r.x1) : r.x2 + 1, max(0, r.y1) : r.y2 + 1] = 0
            dist, _ = k.unpacked(k.spread(seeds, walk, 10, 14, bound=bound))
            x, y = np.nonzero(dist >= 0)
            out.append(pd.DataFrame({"map_id": key[0], "box": r.box, "x": x.astype("int32"), "y": y.astype("int32"), "dist": dist[x, y]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["map_id", "box", "x", "y", "dist"])

    return by_map(cells.withColumn("_w", F.col(walkable)).select(*KEY, "_w")).groupBy("map_id").cogroup(fresh(by_map(boxes)).groupBy("map_id")).applyInPandas(run, "map_id string, box int, x int, y int, dist long")


def ground_distance(tiles: DataFrame, starts: DataFrame, walkable: str) -> DataFrame:
    """(map_id, start, x, y, dist): distance in pixels, 32 and 45, from each start tile (map_id, start, x, y), whether or not it is walkable; -1 unreached."""

    def run(key, pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        walk = dense(pdf, "_w", False).astype(bool) if len(pdf) else None
        for r in own.itertuples() if len(pdf) else ():
            dist, _ = k.unpacked(k.spread(k.seed_array(walk.shape, [(r.x, r.y, 0)]), walk, 32, 45))
            out.append(pdf[KEY].assign(start=r.start, dist=dist[pdf.x, pdf.y])[["map_id", "start", "x", "y", "dist"]])
        return pd.concat(out) if out else pd.DataFrame(columns=["map_id", "start", "x", "y", "dist"])

    return tiles.withColumn("_w", F.col(walkable)).select(*KEY, "_w").groupBy("map_id").cogroup(fresh(starts).groupBy("map_id")).applyInPandas(run, "map_id string, start int, x int, y int, dist long")


def border_segments(cells: DataFrame, walkable: str) -> DataFrame:
    """(map_id, side, start, stop): the runs of walkable cells along each side of the map, as gaps and islands."""
    own = Window.partitionBy("map_id")
    sized = cells.withColumns({"w": F.max("x").over(own), "h": F.max("y").over(own)})
    sides = F.explode(F.filter(F.array(*[F.when(test, F.struct(F.lit(s).alias("side"), at.alias("at"))) for s, test, at in (("left", F.col("x") == 0, F.col("y")), ("right", F.col("x") == F.col("w"), F.col("y")), ("top", F.col("y") == 0, F.col("x")), ("bottom", F.col("y") == F.col("h"), F.col("x")))]), lambda s: s.isNotNull())).alias("s")
    line = sized.where(walkable).select("map_id", sides).select("map_id", "s.side", "s.at")
    island = line.withColumn("_g", F.col("at") - F.row_number().over(Window.partitionBy("map_id", "side").orderBy("at")))
    return island.groupBy("map_id", "side", "_g").agg(F.min("at").alias("start"), F.max("at").alias("stop")).drop("_g")
