"""Where to wall a chokepoint: choices, tiles, rays and end points. Solvers are outside."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmesa.functions.distance import approx_dist
from gridmesa.operators import kernels as k
from gridmesa.operators.grid import fresh

WIDEST = 300


def narrowest(chokes: DataFrame) -> DataFrame:
    """(map_id, region, id): each region's chokepoint of least width, then id."""
    ends = chokes.select("map_id", "id", "width", F.explode(F.array("region_a", "region_b")).alias("region"))
    return ends.groupBy("map_id", "region").agg(F.min(F.struct("width", "id")).alias("b")).select("map_id", "region", F.col("b.id").alias("id"))


def widest(chokes: DataFrame, below: float = WIDEST) -> DataFrame:
    return chokes.where(F.col("width") < below).groupBy("map_id").agg(F.max(F.struct("width", -F.col("id"))).alias("b")).select("map_id", (-F.col("b.col2")).alias("id"))


def topmost(starts: DataFrame) -> DataFrame:
    """The start (map_id, id, cy) of least cy, then id."""
    return starts.groupBy("map_id").agg(F.min(F.struct("cy", "id")).alias("b")).select("map_id", F.col("b.id").alias("id"))


def classified_tiles(tiles: DataFrame, walk: DataFrame, chokes: DataFrame) -> DataFrame:
    """(map_id, choke, x, y, kind): tiles near each chokepoint (map_id, id, tx, ty, home): 'build' within 10, at home and buildable; 'outside' within 10, not at home and with four walkable centre cells; 'walk' within 14 with such cells. A tile may be of several kinds, and has a row for each.

    tiles: map_id, x, y, buildable, region; walk: map_id, x, y, walkable, by walk cell.
    """
    xs = chokes.select("map_id", F.col("id").alias("choke"), "tx", "ty", "home", F.explode(F.sequence(F.col("tx") - 14, F.col("tx") + 14)).alias("x"))
    near = xs.select("*", F.explode(F.sequence(F.col("ty") - 14, F.col("ty") + 14)).alias("y"))
    inner = walk.where((F.col("x") % 4).isin(1, 2) & (F.col("y") % 4).isin(1, 2)).groupBy("map_id", F.floor(F.col("x") / 4).cast("int").alias("x"), F.floor(F.col("y") / 4).cast("int").alias("y")).agg(F.bool_and("walkable").alias("open"))
    joined = near.join(tiles, ["map_id", "x", "y"]).join(inner, ["map_id", "x", "y"], "left")
    close = (F.abs(F.col("x") - F.col("tx")) <= 10) & (F.abs(F.col("y") - F.col("ty")) <= 10)
    home = F.col("region") == F.col("home")
    kinds = F.array(F.when(close & home & F.col("buildable"), "build"), F.when(close & ~home & F.col("open"), "outside"), F.when(F.col("open"), "walk"))
    return joined.select("map_id", "choke", "x", "y", F.explode(F.array_compact(kinds)).alias("kind"))


def extreme_tile(tiles: DataFrame, x: Column, y: Column, farthest: bool = False) -> DataFrame:
    """(map_id, x, y): the tile nearest to, or farthest from, a point; of equals the last, x first."""
    d = approx_dist(F.col("x") - x, F.col("y") - y)
    best = F.max(F.struct((d if farthest else -d).alias("d"), "x", "y"))
    return tiles.groupBy("map_id").agg(best.alias("b")).select("map_id", "b.x", "b.y")


def solver_program(tiles: DataFrame, gaps: dict[str, tuple[int, int, int, int]]) -> DataFrame:
    """(map_id, choke, line): the facts of an answer-set program: classified tiles, and for each building kind the gaps on its four sides."""
    fact = F.format_string("%sTile(%d, %d).", F.col("kind"), F.col("x"), F.col("y"))
    facts = tiles.select("map_id", "choke", fact.alias("line"))
    sides = ("left", "right", "top", "bottom")
    rows = [f"{side}Gap({kind}, {value})." for kind, own in sorted(gaps.items()) for side, value in zip(sides, own, strict=True)]
    fixed = tiles.select("map_id", "choke").distinct().select("map_id", "choke", F.explode(F.array(*[F.lit(r) for r in rows] or [F.lit("")])).alias("line"))
    return facts.unionByName(fixed)


def parsed_answer(answers: DataFrame, column: str = "answer") -> DataFrame:
    """(map_id, kind, x, y): the place(kind, x, y) atoms of a solver's answer."""
    atom = r"place\((\w+),\s*(\d+),\s*(\d+)\)"
    found = answers.select("map_id", F.explode(F.regexp_extract_all(column, F.lit(atom), F.lit(0))).alias("a"))
    part = lambda i: F.regexp_extract("a", atom, i)
    return found.select("map_id", part(1).alias("kind"), part(2).cast("int").alias("x"), part(3).cast("int").alias("y"))


def choke_radius(chokes: DataFrame) -> DataFrame:
    """(map_id, id, radius): width in tiles, threefold where the centre is not buildable."""
    return chokes.select("map_id", "id", (F.floor(F.col("width") / 32) * F.when(F.col("buildable"), 1).otherwise(3)).cast("int").alias("radius"))


def choke_grid(chokes: DataFrame, tiles: DataFrame, walk: DataFrame) -> DataFrame:
    """(map_id, choke, dx, dy, value): the square around each chokepoint (map_id, id, tx, ty, radius): walkable, by the tile's top-left walk cell, plus buildable; 4 outside the map.

    tiles: map_id, x, y, buildable; walk: map_id, x, y, walkable, by walk cell.
    """
    xs = chokes.select("map_id", F.col("id").alias("choke"), "tx", "ty", "radius", F.explode(F.sequence(-F.col("radius"), F.col("radius"))).alias("dx"))
    cells = xs.select("*", F.explode(F.sequence(-F.col("radius"), F.col("radius"))).alias("dy")).withColumns({"x": F.col("tx") + F.col("dx"), "y": F.col("ty") + F.col("dy")})
    corner = walk.where((F.col("x") % 4 == 0) & (F.col("y") % 4 == 0)).select("map_id", (F.col("x") / 4).cast("int").alias("x"), (F.col("y") / 4).cast("int").alias("y"), "walkable")
    known = tiles.join(corner, ["map_id", "x", "y"]).select("map_id", "x", "y", (F.col("walkable").cast("int") + F.col("buildable").cast("int")).alias("_v"))
    return cells.join(known, ["map_id", "x", "y"], "left").select("map_id", "choke", "dx", "dy", F.coalesce("_v", F.lit(4)).alias("value"))


def bresenham(x0: int, y0: int, x1: int, y1: int):
    """Integer points from (x0, y0) through (x1, y1) and on, without end."""
    dx, dy = abs(x1 - x0), -abs(y1 - y0)
    sx, sy = (1 if x1 > x0 else -1), (1 if y1 > y0 else -1)
    if dx == dy == 0:
        return
    error = dx + dy
    while True:
        yield x0, y0
        double = 2 * error
        if double >= dy:
            error += dy
            x0 += sx
        if double <= dx:
            error += dx
            y0 += sy


def _ray(grid: dict, start: tuple[int, int], towards: tuple[int, int]) -> tuple[int, int]:
    """The first buildable cell (2) of the line, or its last cell on the grid."""
    last = start
    for p in bresenham(*start, *towards):
        if grid.get(p, 4) == 4:
            return last
        last = p
        if grid[p] == 2:
            return p
    return last


def _flood(grid: dict, start: tuple[int, int]) -> set[tuple[int, int]]:
    value, seen, stack = grid.get(start), {start}, [start]
    while stack:
        x, y = stack.pop()
        for dx, dy in k.STRAIGHT:
            p = (x + dx, y + dy)
            if p not in seen and grid.get(p) == value:
                seen.add(p)
                stack.append(p)
    return seen


def _far_pair(cells: set[tuple[int, int]]) -> tuple[tuple[int, int], tuple[int, int]]:
    """From the centroid to the farthest cell, and from there to the farthest from it; ties to the least."""
    cx, cy = sum(x for x, _ in cells) / len(cells), sum(y for _, y in cells) / len(cells)
    a = min(cells, key=lambda p: (-((p[0] - cx) ** 2 + (p[1] - cy) ** 2), p))
    return a, min(cells, key=lambda p: (-((p[0] - a[0]) ** 2 + (p[1] - a[1]) ** 2), p))


def wall_ends(grid: DataFrame, sides: DataFrame) -> DataFrame:
    """(map_id, choke, kind, ax, ay, bx, by): from the centre of each choke grid (dx, dy, value) and its sides (map_id, choke, s1x, s1y, s2x, s2y, relative to the centre): on flat ground (2) or open ground the rays to both sides; on a ramp (1) the sides turn by 90 degrees, and the ends are the farthest pair of the buildable ground that the first ray meets."""

    def run(key, own: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        cells = {(int(a), int(b)): int(v) for a, b, v in zip(own.dx, own.dy, own.value, strict=True)}
        rows = []
        for r in two.itertuples():
            a, b = (int(r.s1x), int(r.s1y)), (int(r.s2x), int(r.s2y))
            kind = cells.get((0, 0), 4)
            if kind == 1:
                a, b = (-a[1], a[0]), (-b[1], b[0])
                met = next((p for p in (_ray(cells, (0, 0), a), _ray(cells, (0, 0), b)) if cells.get(p) == 2), None)
                ends = _far_pair(_flood(cells, met)) if met else (_ray(cells, (0, 0), a), _ray(cells, (0, 0), b))
            else:
                ends = (_ray(cells, (0, 0), a), _ray(cells, (0, 0), b))
            rows.append((key[0], int(r.choke), kind, *ends[0], *ends[1]))
        return pd.DataFrame(rows, columns=["map_id", "choke", "kind", "ax", "ay", "bx", "by"])

    return grid.groupBy("map_id", "choke").cogroup(fresh(sides).groupBy("map_id", "choke")).applyInPandas(run, "map_id string, choke int, kind int, ax int, ay int, bx int, by int")
