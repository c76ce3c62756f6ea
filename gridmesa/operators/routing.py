"""Distances and paths between cells. Queries of one map are spread over tasks by their source; each distinct source is solved once."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmesa.operators import kernels as k
from gridmesa.operators.grid import KEY, dense, fresh

PIXELS = 3.2  # per unit of 10 a tile


def _solved(tiles: DataFrame, queries: DataFrame, walkable: str, answer, schema: str, parts: int) -> DataFrame:
    part = F.pmod(F.xxhash64("sx", "sy"), F.lit(parts)).cast("int")
    grid = tiles.withColumn("_w", F.col(walkable)).select(*KEY, "_w").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(key, pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(pdf) and len(own):
            walk = dense(pdf, "_w", False).astype(bool)
            for (sx, sy), group in own.groupby(["sx", "sy"]):
                dist, _ = k.unpacked(k.spread(k.seed_array(walk.shape, [(sx, sy, 0)]), walk, 10, 14, corner_rule=True))
                rows += answer(key[0], walk, dist, group)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return grid.groupBy("map_id", "_part").cogroup(fresh(queries.withColumn("_part", part)).groupBy("map_id", "_part")).applyInPandas(run, schema)


def distances(tiles: DataFrame, queries: DataFrame, walkable: str, parts: int = 4) -> DataFrame:
    """(map_id, id, dist): queries (map_id, id, sx, sy, tx, ty); 10 a straight step, 14 a diagonal one, which two blocked sides forbid; -1 if there is none."""
    answer = lambda m, walk, dist, own: [(m, r.id, int(dist[r.tx, r.ty])) for r in own.itertuples()]
    return _solved(tiles, queries, walkable, answer, "map_id string, id int, dist long", parts)


def paths(tiles: DataFrame, queries: DataFrame, walkable: str, parts: int = 4) -> DataFrame:
    """(map_id, id, dist, path): the path holds both ends; of equal predecessors the least (x, y)."""
    path = lambda walk, dist, r: [{"x": int(x), "y": int(y)} for x, y in k.trace_path(dist, (r.tx, r.ty), walk, 10, 14, True)]
    answer = lambda m, walk, dist, own: [(m, r.id, int(dist[r.tx, r.ty]), path(walk, dist, r)) for r in own.itertuples()]
    return _solved(tiles, queries, walkable, answer, "map_id string, id int, dist long, path array<struct<x:int,y:int>>", parts)


def nearest_target(found: DataFrame) -> DataFrame:
    """Of each source's reached targets, the nearest; ties to the least id. found has map_id, sx, sy, id, dist."""
    best = found.where("dist >= 0").groupBy("map_id", "sx", "sy").agg(F.min(F.struct("dist", "id")).alias("b"))
    return best.select("map_id", "sx", "sy", F.col("b.id").alias("id"), F.col("b.dist").alias("dist"))


def gated(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """Queries whose ends lie in one component: an equi-join on the labels before any search. labels: map_id, x, y, label (0: none)."""
    ends = labels.where("label > 0")
    source = ends.select("map_id", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("label").alias("_s"))
    target = ends.select("map_id", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("label").alias("_t"))
    return queries.join(source, ["map_id", "sx", "sy"]).join(target, ["map_id", "tx", "ty"]).where("_s = _t").drop("_s", "_t")


def with_unreachable(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Every query, -1 for those that the gate or the search left out."""
    return queries.select("map_id", "id").join(found.select("map_id", "id", "dist"), ["map_id", "id"], "left").select("map_id", "id", F.coalesce("dist", F.lit(-1)).alias("dist"))


def graph_paths(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """(map_id, id, dist, path): exact shortest paths on a small undirected graph (map_id, a, b, w) for queries (map_id, id, s, t); ties to the lexicographically least path of nodes."""

    def run(key, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list] = {}
        for a, b, w in zip(own.a, own.b, own.w, strict=True):
            near.setdefault(a, []).append((b, w))
            near.setdefault(b, []).append((a, w))
        rows = []
        for s, group in asked.groupby("s"):
            best: dict[int, tuple] = {}
            heap = [(0, (int(s),))]
            while heap:
                d, path = heapq.heappop(heap)
                if path[-1] in best:
                    continue
                best[path[-1]] = (d, path)
                for b, w in near.get(path[-1], ()):
                    if b not in best:
                        heapq.heappush(heap, (d + int(w), (*path, int(b))))
            rows += [(key[0], r.id, *best.get(r.t, (-1, ()))) for r in group.itertuples()]
        return pd.DataFrame([(m, i, d, list(p)) for m, i, d, p in rows], columns=["map_id", "id", "dist", "path"])

    return edges.groupBy("map_id").cogroup(queries.groupBy("map_id")).applyInPandas(run, "map_id string, id int, dist long, path array<int>")


def choke_pairs(chokes: DataFrame) -> DataFrame:
    """(map_id, region, a, b): chokepoints a < b of one region; an equi-join on the region."""
    of = chokes.select("map_id", F.col("id").alias("choke"), F.explode(F.array("region_a", "region_b")).alias("region")).distinct()
    other = of.select("map_id", "region", F.col("choke").alias("b"))
    return of.withColumnRenamed("choke", "a").join(other, ["map_id", "region"]).where("a < b").select("map_id", "region", "a", "b")


def choke_graph(tiles: DataFrame, chokes: DataFrame, walkable: str) -> DataFrame:
    """(map_id, a, b, w): ground distance between chokepoints that share a region, both placed at (x, y); unreached pairs are left out."""
    place = lambda end: chokes.select("map_id", F.col("id").alias(end), F.col("x").alias(f"{'s' if end == 'a' else 't'}x"), F.col("y").alias(f"{'s' if end == 'a' else 't'}y"))
    pairs = choke_pairs(chokes).select("map_id", "a", "b").distinct().join(place("a"), ["map_id", "a"]).join(place("b"), ["map_id", "b"])
    found = distances(tiles, pairs.withColumn("id", (F.col("a") * 65536 + F.col("b")).cast("int")), walkable)
    return found.where("dist >= 0").select("map_id", F.shiftright("id", 16).alias("a"), (F.col("id") % 65536).alias("b"), F.col("dist").alias("w"))
