"""Queries over walk cells and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmesa.operators import grid
from gridmesa.plans import fixtures as fx
from gridmesa.plans.register import Register

REGISTER = Register()
_CELLS = f"WITH {fx.CELLS_SQL}"

#: Each stage of preparation as a CTE over the one before, by self-joins instead of the windows that the operators use.
_FULL = """full3 AS (SELECT c.x, c.y, bool_and(n.raw) AND count(*) = 9 AS f FROM cells c JOIN cells n ON abs(n.x - c.x) <= 1 AND abs(n.y - c.y) <= 1 GROUP BY c.x, c.y),
opened AS (SELECT c.x, c.y, c.raw, bool_or(n.f) AS open FROM cells c JOIN full3 n ON (n.x = c.x AND n.y = c.y) OR (abs(n.x - c.x) = 1 AND abs(n.y - c.y) = 1) GROUP BY c.x, c.y, c.raw)"""
_THIN = """thin AS (SELECT o.x, o.y FROM opened o JOIN opened n ON n.y = o.y AND abs(n.x - o.x) <= 2 WHERE o.x BETWEEN 2 AND 61 AND NOT o.open GROUP BY o.x, o.y HAVING count(*) FILTER (NOT n.raw) <= 2),
walked AS (SELECT o.x, o.y, o.open AND t.x IS NULL AS walk FROM opened o LEFT JOIN thin t ON t.x = o.x + 1 AND t.y = o.y)"""
_TOP = """s5 AS (SELECT c.x, c.y, CASE WHEN c.x BETWEEN 1 AND 62 AND c.y <= 3 THEN CASE c.y WHEN 0 THEN a.walk AND b.walk AND d.walk AND e.walk WHEN 1 THEN a.walk AND b.walk AND d.walk AND e.walk
  WHEN 2 THEN a.walk AND d.walk AND e.walk ELSE a.walk AND e.walk END ELSE c.walk END AS walk
  FROM walked c JOIN walked a ON a.x = c.x AND a.y = 0 JOIN walked b ON b.x = c.x AND b.y = 1 JOIN walked d ON d.x = c.x AND d.y = 2 JOIN walked e ON e.x = c.x AND e.y = 3)"""
_GAP = """gaps AS (SELECT a.x FROM s5 z JOIN s5 a ON a.y = 0 AND a.x = z.x + 1 JOIN s5 b ON b.y = 0 AND b.x = z.x + 2 JOIN s5 c ON c.y = 0 AND c.x = z.x + 3 WHERE z.y = 0 AND NOT z.walk AND a.walk AND b.walk AND NOT c.walk),
s6 AS (SELECT s.x, s.y, s.walk AND NOT (s.y = 0 AND (s.x IN (SELECT x FROM gaps) OR s.x - 1 IN (SELECT x FROM gaps))) AS walk FROM s5 s)"""
_LEFT = """s7 AS (SELECT c.x, c.y, CASE WHEN c.y <= 62 AND c.x <= 3 THEN CASE c.x WHEN 0 THEN a.walk AND b.walk AND d.walk AND e.walk WHEN 1 THEN a.walk AND b.walk AND d.walk AND e.walk WHEN 2 THEN a.walk AND d.walk AND e.walk ELSE a.walk AND e.walk END ELSE c.walk END AS walk
  FROM s6 c JOIN s6 a ON a.y = c.y AND a.x = 0 JOIN s6 b ON b.y = c.y AND b.x = 1 JOIN s6 d ON d.y = c.y AND d.x = 2 JOIN s6 e ON e.y = c.y AND e.x = 3)"""
_RIGHT = """s8 AS (SELECT s.x, s.y, s.walk AND NOT (s.x = 63 AND COALESCE(NOT a.walk AND NOT b.walk, FALSE)) AS walk FROM s7 s LEFT JOIN s7 a ON a.x = s.x AND a.y = s.y - 1 LEFT JOIN s7 b ON b.x = s.x AND b.y = s.y + 1)"""
_STAMP = """boxes AS (SELECT px // 8 - 2 * tw AS x1, py // 8 - 2 * th AS y1, px // 8 + 2 * tw AS x2, py // 8 + 2 * th AS y2 FROM buildings),
s9 AS (SELECT s.x, s.y, s.walk AND NOT EXISTS (SELECT 1 FROM boxes WHERE s.x BETWEEN x1 - 1 AND x2 + 1 AND s.y BETWEEN y1 - 1 AND y2 + 1) AS walk FROM s8 s)"""


def _walk(last: str, *stages: str) -> str:
    return f"{_CELLS}, {fx.BUILDINGS_SQL}, {', '.join([_FULL, _THIN, *stages])} SELECT x, y, walk FROM {last}"


def _stage(spark, sf, *steps):
    cells = grid.thicken_thin_walls(grid.clearance_filter(fx.walk_cells(spark, sf)))
    for step in steps:
        cells = step(cells)
    return cells.select("x", "y", "walk")


@REGISTER("s15_buildability", "SELECT CAST(p_partkey AS INTEGER) AS id, (p_size * 8) & 128 = 0 AS buildable FROM part")
def s15(spark, sf):
    from gridmesa.sources.chk import buildable

    return fx.read(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("id"), buildable(F.col("p_size") * 8).alias("buildable"))


@REGISTER("s16_raw_walkability", _CELLS + " SELECT x, y, raw AND NOT (y >= 60 OR (y >= 56 AND (x < 20 OR x >= 44))) AS raw FROM cells")
def s16(spark, sf):
    return grid.raw_walkability(fx.walk_cells(spark, sf)).select("x", "y", "raw")


@REGISTER("s22_grid_text", _CELLS + " SELECT y, string_agg(CASE WHEN raw THEN '1' ELSE '0' END, ',' ORDER BY x) AS line FROM cells GROUP BY y")
def s22(spark, sf):
    return grid.grid_text(fx.walk_cells(spark, sf).withColumn("v", F.col("raw").cast("int")), "v", ",").select("y", "line")


_INIT = "CASE WHEN NOT raw THEN 0 WHEN x IN (0, 63) OR y IN (0, 63) THEN 1 ELSE -1 END"


@REGISTER("o1_distance_init", f"{_CELLS} SELECT x, y, CAST({_INIT} AS INTEGER) AS dt FROM cells")
def o1(spark, sf):
    return grid.distance_init(fx.walk_cells(spark, sf)).select("x", "y", "dt")


@REGISTER("o2_clearance_filter", f"{_CELLS}, {_FULL} SELECT x, y, open FROM opened")
def o2(spark, sf):
    return grid.clearance_filter(fx.walk_cells(spark, sf)).select("x", "y", "open")


@REGISTER("o3_thin_walls", _walk("walked"))
def o3(spark, sf):
    return _stage(spark, sf)


@REGISTER("o4_tile_walkability", _CELLS + " SELECT x // 4 AS tx, y // 4 AS ty, bool_and(raw) AS walkable FROM cells GROUP BY 1, 2")
def o4(spark, sf):
    return grid.tile_walkability(fx.walk_cells(spark, sf)).select("tx", "ty", "walkable")


@REGISTER("o5_smooth_top", _walk("s5", _TOP))
def o5(spark, sf):
    return _stage(spark, sf, grid.smooth_top)


@REGISTER("o6_fill_top_gap", _walk("s6", _TOP, _GAP))
def o6(spark, sf):
    return _stage(spark, sf, grid.smooth_top, grid.fill_top_gap)


@REGISTER("o7_smooth_left", _walk("s7", _TOP, _GAP, _LEFT))
def o7(spark, sf):
    return _stage(spark, sf, grid.smooth_top, grid.fill_top_gap, grid.smooth_left)


@REGISTER("o8_fill_right_gap", _walk("s8", _TOP, _GAP, _LEFT, _RIGHT))
def o8(spark, sf):
    return _stage(spark, sf, grid.smooth_top, grid.fill_top_gap, grid.smooth_left, grid.fill_right_gap)


@REGISTER("o9_stamp_buildings", _walk("s9", _TOP, _GAP, _LEFT, _RIGHT, _STAMP))
def o9(spark, sf):
    return grid.prepared(fx.walk_cells(spark, sf), fx.buildings(spark, sf)).select("x", "y", "walk")


@REGISTER("o9_stamp_tiles", f"{_CELLS}, {fx.BUILDINGS_SQL}, {_STAMP[: _STAMP.index('s9')]} tiles AS (SELECT x // 4 AS tx, y // 4 AS ty, bool_and(raw) AS walkable FROM cells GROUP BY 1, 2) SELECT tx, ty, walkable AND NOT EXISTS (SELECT 1 FROM boxes WHERE tx * 4 + 3 >= x1 AND tx * 4 <= x2 AND ty * 4 + 3 >= y1 AND ty * 4 <= y2) AS walkable FROM tiles")
def o9_tiles(spark, sf):
    return grid.stamp_tiles(grid.tile_walkability(fx.walk_cells(spark, sf)), fx.buildings(spark, sf)).drop("map_id")


@REGISTER("o10_reset_results", _CELLS + " SELECT x, y, CAST(NULL AS INTEGER) AS region, CAST(NULL AS INTEGER) AS base, CAST(NULL AS INTEGER) AS choke, CAST(NULL AS INTEGER) AS obstacle, CAST(NULL AS INTEGER) AS tile_base, CAST(NULL AS INTEGER) AS tile_choke FROM cells")
def o10(spark, sf):
    return grid.reset_results(fx.walk_cells(spark, sf)).drop("map_id")


_DT = f"{_CELLS}, seeds AS (SELECT x, y, dt FROM (SELECT x, y, {_INIT} AS dt FROM cells) WHERE dt >= 0), dts AS (SELECT c.x, c.y, CAST(min(greatest(abs(c.x - s.x), abs(c.y - s.y)) + s.dt) AS INTEGER) AS dt FROM cells c CROSS JOIN seeds s GROUP BY 1, 2)"


@REGISTER("o50_distance_transform", _DT + " SELECT x, y, dt FROM dts")
def o50(spark, sf):
    return grid.distance_transform(fx.walk_cells(spark, sf)).select("x", "y", "dt")


@REGISTER("o51_tile_maximum", _DT + " SELECT x // 4 AS tx, y // 4 AS ty, max(dt) AS dt FROM dts GROUP BY 1, 2")
def o51(spark, sf):
    return grid.tile_maximum(grid.distance_transform(fx.walk_cells(spark, sf))).select("tx", "ty", "dt")


@REGISTER("o52_region_maximum", _DT + ", t AS (SELECT x // 4 AS tx, y // 4 AS ty, max(dt) AS dt FROM dts GROUP BY 1, 2) SELECT CAST(tx // 4 * 4 + ty // 4 + 1 AS INTEGER) AS label, max(dt) AS max_dt FROM t GROUP BY 1")
def o52(spark, sf):
    cells = fx.walk_cells(spark, sf)
    labels = cells.withColumn("label", (F.floor(F.col("x") / 16) * 4 + F.floor(F.col("y") / 16) + 1).cast("int"))
    return grid.region_maximum(grid.tile_maximum(grid.distance_transform(cells)), labels).select("label", "max_dt")


@REGISTER("o53_transform_prepared", None)
def o53(spark, sf):
    return grid.distance_transform(grid.prepared(fx.walk_cells(spark, sf), fx.buildings(spark, sf)), "walk").select("x", "y", "dt")


@REGISTER("o67_placeable", _CELLS + " SELECT c.x, c.y, bool_and(n.raw) AND count(*) = 12 AS placeable FROM cells c JOIN cells n ON n.x BETWEEN c.x AND c.x + 3 AND n.y BETWEEN c.y AND c.y + 2 GROUP BY c.x, c.y")
def o67(spark, sf):
    return grid.placeable(fx.walk_cells(spark, sf), "raw").select("x", "y", "placeable")
