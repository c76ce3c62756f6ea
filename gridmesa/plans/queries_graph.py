"""Queries over labels, fields, routes and region graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmesa.operators import fields, graph, lookup, routing
from gridmesa.plans import fixtures as fx
from gridmesa.plans.register import Register

REGISTER = Register()
_CELLS = f"WITH RECURSIVE {fx.CELLS_SQL}"


def _components_sql(name: str, of: str, eight: bool) -> str:
    """label by cell, from components of 4 x 4 blocks (blocks are uniform, so cells and blocks have the same components)."""
    near = "abs(p.bx - q.bx) <= 1 AND abs(p.by_ - q.by_) <= 1" if eight else "abs(p.bx - q.bx) + abs(p.by_ - q.by_) <= 1"
    return f"""{name}_b AS (SELECT DISTINCT x // 4 AS bx, y // 4 AS by_ FROM cells WHERE {of}), {name}_r(bx, by_, root) AS (SELECT bx, by_, bx * 16 + by_ FROM {name}_b UNION SELECT q.bx, q.by_, r.root FROM {name}_r r JOIN {name}_b p ON p.bx = r.bx AND p.by_ = r.by_ JOIN {name}_b q ON {near}),
{name}_m AS (SELECT bx, by_, min(root) AS root FROM {name}_r GROUP BY 1, 2), {name}_f AS (SELECT root, min(x * 64 + y) AS first FROM cells JOIN {name}_m ON bx = x // 4 AND by_ = y // 4 GROUP BY 1),
{name} AS (SELECT x, y, CAST(COALESCE(k, 0) AS INTEGER) AS label FROM cells LEFT JOIN (SELECT bx, by_, k FROM {name}_m JOIN (SELECT root, row_number() OVER (ORDER BY first) AS k FROM {name}_f) USING (root)) ON bx = x // 4 AND by_ = y // 4)"""


_OBSTACLES = _components_sql("obstacles", "NOT raw", True)
_REGIONS = _components_sql("regions", "raw", False)


def _obstacles(spark, sf):
    return fields.component_labels(fx.walk_cells(spark, sf).withColumn("blocked", ~F.col("raw")), "blocked")


def _regions(spark, sf):
    return fields.component_labels(fx.walk_cells(spark, sf), "raw", eight=False)


@REGISTER("o11_component_labels", f"{_CELLS}, {_OBSTACLES} SELECT x, y, label FROM obstacles")
def o11(spark, sf):
    return _obstacles(spark, sf).select("x", "y", "label")


@REGISTER("o12_contour_marks", f"{_CELLS} SELECT DISTINCT c.x, c.y FROM cells c JOIN cells n ON abs(n.x - c.x) <= 1 AND abs(n.y - c.y) <= 1 WHERE c.raw AND NOT n.raw")
def o12(spark, sf):
    return fields.contour_marks(fx.walk_cells(spark, sf), "raw").select("x", "y")


@REGISTER("o13_contour_rings")
def o13(spark, sf):
    return fields.obstacle_polygons(_obstacles(spark, sf)).select("label", "ring")


@REGISTER("o14_hole_fill", f"""{_CELLS}, {_OBSTACLES}, {_REGIONS}, pockets AS (SELECT label FROM regions WHERE label > 0 GROUP BY label HAVING count(*) <= 40 AND min(x) > 0 AND min(y) > 0 AND max(x) < 63 AND max(y) < 63),
around AS (SELECT r.label, min(o.label) AS a, max(o.label) AS b FROM regions r JOIN pockets USING (label) JOIN obstacles o ON abs(o.x - r.x) + abs(o.y - r.y) = 1 WHERE o.label > 0 GROUP BY 1)
SELECT o.x, o.y, CAST(CASE WHEN o.label = 0 AND a = b THEN a ELSE o.label END AS INTEGER) AS label FROM obstacles o JOIN regions r USING (x, y) LEFT JOIN around n ON n.label = r.label""")
def o14(spark, sf):
    return fields.filled_labels(_obstacles(spark, sf)).select("x", "y", "label")


@REGISTER("o28_border_segments", f"""{_CELLS}, s AS (SELECT 'left' AS side, y AS pos FROM cells WHERE x = 0 AND raw UNION ALL SELECT 'right', y FROM cells WHERE x = 63 AND raw UNION ALL SELECT 'top', x FROM cells WHERE y = 0 AND raw UNION ALL SELECT 'bottom', x FROM cells WHERE y = 63 AND raw),
g AS (SELECT side, pos, pos - row_number() OVER (PARTITION BY side ORDER BY pos) AS g FROM s) SELECT side, min(pos) AS start, max(pos) AS stop FROM g GROUP BY side, g""")
def o28(spark, sf):
    return fields.border_segments(fx.walk_cells(spark, sf), "raw").drop("map_id")


def _spread_sql(name: str, seeds: str, straight: int, diagonal: int, passable: str = "TRUE", extra: str = "0", corner: str = "TRUE", bound: str = "TRUE") -> str:
    """Shortest packed distances (distance * 2^24 + id) by recursion with keys."""
    moves = f"{name}_moves AS (SELECT CAST(a.i - 1 AS INTEGER) AS dx, CAST(b.i - 1 AS INTEGER) AS dy, CASE WHEN a.i <> 1 AND b.i <> 1 THEN {diagonal} ELSE {straight} END AS cost FROM range(3) a(i) CROSS JOIN range(3) b(i) WHERE a.i <> 1 OR b.i <> 1)"
    return f"""{moves}, {name}(x, y, c) USING KEY (x, y) AS (SELECT x, y, CAST(min(id) AS BIGINT) FROM ({seeds}) GROUP BY x, y UNION (SELECT n.x, n.y, min(d.c + (m.cost + {extra}) * CAST(16777216 AS BIGINT)) AS c FROM {name} d JOIN cells f ON f.x = d.x AND f.y = d.y JOIN {name}_moves m ON TRUE JOIN cells n ON n.x = d.x + m.dx AND n.y = d.y + m.dy
LEFT JOIN cells s1 ON s1.x = d.x + m.dx AND s1.y = d.y LEFT JOIN cells s2 ON s2.x = d.x AND s2.y = d.y + m.dy LEFT JOIN recurring.{name} p ON p.x = n.x AND p.y = n.y
WHERE {passable} AND {corner} AND {bound} AND (p.c IS NULL OR d.c + (m.cost + {extra}) * CAST(16777216 AS BIGINT) < p.c) GROUP BY n.x, n.y))"""


_CROSSING = "CASE WHEN f.raw AND NOT n.raw THEN 100000 ELSE 0 END"
_SEEDS = "SELECT CAST(n_nationkey * 37 % 64 AS INTEGER) AS x, CAST(n_nationkey * 53 % 64 AS INTEGER) AS y, n_nationkey AS id FROM nation"


def _seeds(spark, sf):
    n = F.col("n_nationkey")
    return fx.read(spark, sf, "nation").select(F.lit(fx.MAP).alias("map_id"), (n * 37 % 64).cast("int").alias("x"), (n * 53 % 64).cast("int").alias("y"), n.cast("int").alias("id"))


def _nearest(spark, sf):
    return fields.nearest_objects(fx.walk_cells(spark, sf), _seeds(spark, sf), "raw")


_NEAR = f"{_CELLS}, {_spread_sql('near', _SEEDS, 8, 11, extra=_CROSSING)}"


@REGISTER("o54_nearest_flood", f"{_NEAR} SELECT x, y, CAST(c % 16777216 AS INTEGER) AS id, c // 16777216 AS dist FROM near")
def o54(spark, sf):
    return _nearest(spark, sf).select("x", "y", "id", "dist")


@REGISTER("o55_nearest_obstacle", f"{_CELLS}, {_OBSTACLES}, {_spread_sql('near', 'SELECT x, y, label AS id FROM obstacles WHERE label > 0', 8, 11)} SELECT x, y, CAST(c % 16777216 AS INTEGER) AS id, c // 16777216 AS dist FROM near")
def o55(spark, sf):
    seeds = _obstacles(spark, sf).where("label > 0").withColumnRenamed("label", "id")
    return fields.nearest_objects(fx.walk_cells(spark, sf), seeds, "raw", crossing=0).select("x", "y", "id", "dist")


@REGISTER("o56_tile_mode", f"{_NEAR} SELECT tx, ty, id FROM (SELECT x // 4 AS tx, y // 4 AS ty, CAST(c % 16777216 AS INTEGER) AS id, count(*) AS n FROM near GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY tx, ty ORDER BY n DESC, id) = 1")
def o56(spark, sf):
    return fields.tile_mode(_nearest(spark, sf)).select("tx", "ty", "id")


@REGISTER("o57_area_distance", f"{_CELLS}, {_spread_sql('area', 'SELECT x, y, 0 AS id FROM cells WHERE x BETWEEN 20 AND 35 AND y BETWEEN 24 AND 35', 10, 14, 'n.raw', bound='d.c // 16777216 + m.cost <= 150')} SELECT 7 AS box, x, y, c // 16777216 AS dist FROM area")
def o57(spark, sf):
    boxes = spark.createDataFrame([(fx.MAP, 7, 20, 24, 35, 35)], "map_id string, box int, x1 int, y1 int, x2 int, y2 int")
    return fields.area_distance(fx.walk_cells(spark, sf), boxes, "raw", 150).drop("map_id")


@REGISTER("o58_ground_distance", f"{_CELLS}, {_spread_sql('ground', 'SELECT 5 AS x, 5 AS y, 0 AS id', 32, 45, 'n.raw')} SELECT x, y, COALESCE(c // 16777216, -1) AS dist FROM cells LEFT JOIN ground USING (x, y)")
def o58(spark, sf):
    starts = spark.createDataFrame([(fx.MAP, 1, 5, 5)], "map_id string, start int, x int, y int")
    return fields.ground_distance(fx.walk_cells(spark, sf), starts, "raw").select("x", "y", "dist")


_ROUTE = _spread_sql("route", "SELECT 5 AS x, 5 AS y, 0 AS id", 10, 14, "n.raw", corner="(m.dx = 0 OR m.dy = 0 OR s1.raw OR s2.raw)")
_ASKED = "asked AS (SELECT CAST(x * 64 + y AS INTEGER) AS id, x AS tx, y AS ty FROM points_q)"


def _queries(spark, sf):
    p = fx.points(spark, sf)
    return p.select("map_id", (F.col("x") * 64 + F.col("y")).alias("id"), F.lit(5).alias("sx"), F.lit(5).alias("sy"), F.col("x").alias("tx"), F.col("y").alias("ty"))


def _distances(spark, sf):
    return routing.distances(fx.walk_cells(spark, sf), _queries(spark, sf), "raw")


@REGISTER("q9_route_distance", f"{_CELLS}, {fx.POINTS_SQL}, {_ASKED}, {_ROUTE} SELECT id, COALESCE(c // 16777216, -1) AS dist, COALESCE(c // 16777216, -1) * 3.2::DOUBLE AS pixels FROM asked LEFT JOIN route ON x = tx AND y = ty")
def q9(spark, sf):
    d = _distances(spark, sf).select("id", "dist")
    return d.withColumn("pixels", F.col("dist") * routing.PIXELS)


@REGISTER("q10_nearest_target", f"{_CELLS}, {fx.POINTS_SQL}, {_ASKED}, {_ROUTE} SELECT 5 AS sx, 5 AS sy, id, c // 16777216 AS dist FROM asked JOIN route ON x = tx AND y = ty QUALIFY row_number() OVER (ORDER BY c, id) = 1")
def q10(spark, sf):
    return routing.nearest_target(_distances(spark, sf).join(_queries(spark, sf), ["map_id", "id"])).drop("map_id")


@REGISTER("q11_route_distances_all", f"{_CELLS}, {_ROUTE} SELECT CAST(x * 64 + y AS INTEGER) AS id, COALESCE(c // 16777216, -1) AS dist FROM cells LEFT JOIN route USING (x, y)")
def q11(spark, sf):
    cells = fx.walk_cells(spark, sf)
    asked = cells.select("map_id", (F.col("x") * 64 + F.col("y")).alias("id"), F.lit(5).alias("sx"), F.lit(5).alias("sy"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    return routing.distances(cells, asked, "raw").select("id", "dist")


@REGISTER("q12_route_path")
def q12(spark, sf):
    return routing.paths(fx.walk_cells(spark, sf), _queries(spark, sf), "raw").select("id", "dist", "path")


@REGISTER("q13_path_to_nearest")
def q13(spark, sf):
    asked = _queries(spark, sf)
    best = routing.nearest_target(_distances(spark, sf).join(asked, ["map_id", "id"])).select("map_id", "id")
    return routing.paths(fx.walk_cells(spark, sf), asked.join(best, ["map_id", "id"], "left_semi"), "raw").select("id", "dist", "path")


_GATE = f"{_CELLS}, {fx.POINTS_SQL}, {_ASKED}, {_REGIONS}, {_ROUTE}, gate AS (SELECT a.id, a.tx, a.ty FROM asked a JOIN regions t ON t.x = a.tx AND t.y = a.ty JOIN regions s ON s.x = 5 AND s.y = 5 WHERE s.label > 0 AND s.label = t.label)"


def _gated(spark, sf):
    return routing.gated(_queries(spark, sf), _regions(spark, sf))


@REGISTER("q14_ground_distance_gated", f"{_GATE} SELECT a.id, CASE WHEN g.id IS NULL THEN -1 ELSE COALESCE(c // 16777216, -1) END AS dist FROM asked a LEFT JOIN gate g USING (id) LEFT JOIN route r ON r.x = a.tx AND r.y = a.ty")
def q14(spark, sf):
    found = routing.distances(fx.walk_cells(spark, sf), _gated(spark, sf), "raw")
    return routing.with_unreachable(_queries(spark, sf), found).select("id", "dist")


@REGISTER("q15_nearest_tile_gated", f"{_GATE} SELECT 5 AS sx, 5 AS sy, id, c // 16777216 AS dist FROM gate JOIN route ON x = tx AND y = ty QUALIFY row_number() OVER (ORDER BY c, id) = 1")
def q15(spark, sf):
    gated = _gated(spark, sf)
    found = routing.distances(fx.walk_cells(spark, sf), gated, "raw")
    return routing.nearest_target(found.join(gated, ["map_id", "id"])).drop("map_id")


@REGISTER("q16_ground_distances_all", f"{_GATE} SELECT a.id, CASE WHEN g.id IS NULL THEN -1 ELSE COALESCE(c // 16777216, -1) END AS dist FROM asked a LEFT JOIN gate g USING (id) LEFT JOIN route r ON r.x = a.tx AND r.y = a.ty")
def q16(spark, sf):
    return q14(spark, sf)


@REGISTER("q17_shortest_path_gated")
def q17(spark, sf):
    found = routing.paths(fx.walk_cells(spark, sf), _gated(spark, sf), "raw")
    return _queries(spark, sf).select("map_id", "id").join(found, ["map_id", "id"], "left").select("id", F.coalesce("dist", F.lit(-1)).alias("dist"), F.coalesce("path", F.array()).alias("path"))


# --- point lookups


@REGISTER("q1_entities", f"{_CELLS}, {_REGIONS} SELECT label, count(*) AS cells, min(x) AS min_x, max(x) AS max_x FROM regions WHERE label > 0 GROUP BY label")
def q1(spark, sf):
    return _regions(spark, sf).where("label > 0").groupBy("label").agg(F.count("*").alias("cells"), F.min("x").alias("min_x"), F.max("x").alias("max_x"))


@REGISTER("q2_region_of_point", f"{_CELLS}, {fx.POINTS_SQL}, {_REGIONS} SELECT p.x, p.y, CASE WHEN label > 0 THEN label END AS region FROM points_q p LEFT JOIN regions USING (x, y)")
def q2(spark, sf):
    return lookup.region_of(fx.points(spark, sf), _regions(spark, sf)).select("x", "y", "region")


@REGISTER("q3_nearest_chokepoint", f"{_NEAR}, {fx.POINTS_SQL} SELECT p.x, p.y, CAST(c % 16777216 AS INTEGER) AS choke FROM points_q p LEFT JOIN near USING (x, y)")
def q3(spark, sf):
    return lookup.nearest_of(fx.points(spark, sf), _nearest(spark, sf), "choke").select("x", "y", "choke")


@REGISTER("q4_nearest_base", f"{_NEAR}, {fx.POINTS_SQL}, mode AS (SELECT tx, ty, id FROM (SELECT x // 4 AS tx, y // 4 AS ty, CAST(c % 16777216 AS INTEGER) AS id, count(*) AS n FROM near GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY tx, ty ORDER BY n DESC, id) = 1) SELECT p.x, p.y, id AS base FROM points_q p LEFT JOIN mode ON tx = x AND ty = y")
def q4(spark, sf):
    mode = fields.tile_mode(_nearest(spark, sf)).withColumnsRenamed({"tx": "x", "ty": "y"})
    return lookup.nearest_of(fx.points(spark, sf), mode, "base").select("x", "y", "base")


@REGISTER("q5_nearest_unwalkable_polygon", f"{_CELLS}, {fx.POINTS_SQL}, {_OBSTACLES}, {_spread_sql('near', 'SELECT x, y, label AS id FROM obstacles WHERE label > 0', 8, 11)} SELECT p.x, p.y, CAST(c % 16777216 AS INTEGER) AS label FROM points_q p LEFT JOIN near USING (x, y)")
def q5(spark, sf):
    seeds = _obstacles(spark, sf).where("label > 0").withColumnRenamed("label", "id")
    near = fields.nearest_objects(fx.walk_cells(spark, sf), seeds, "raw", crossing=0)
    return lookup.nearest_of(fx.points(spark, sf), near, "label").select("x", "y", "label")


@REGISTER("q6_nearest_unwalkable_position")
def q6(spark, sf):
    obstacles = _obstacles(spark, sf)
    near = fields.nearest_objects(fx.walk_cells(spark, sf), obstacles.where("label > 0").withColumnRenamed("label", "id"), "raw", crossing=0)
    return lookup.nearest_unwalkable_position(fx.points(spark, sf), near, fields.obstacle_polygons(obstacles), F.lit(63), F.lit(63)).drop("map_id")


@REGISTER("q7_start_location", f"{_NEAR}, mode AS (SELECT tx, ty, id FROM (SELECT x // 4 AS tx, y // 4 AS ty, CAST(c % 16777216 AS INTEGER) AS id, count(*) AS n FROM near GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY tx, ty ORDER BY n DESC, id) = 1) SELECT CAST(r_regionkey AS INTEGER) AS player, id AS base FROM region LEFT JOIN mode ON tx = r_regionkey * 3 % 16 AND ty = r_regionkey * 5 % 16")
def q7(spark, sf):
    r = F.col("r_regionkey")
    starts = fx.read(spark, sf, "region").select(F.lit(fx.MAP).alias("map_id"), r.cast("int").alias("player"), (r * 3 % 16).cast("int").alias("tx"), (r * 5 % 16).cast("int").alias("ty"))
    return lookup.start_base(starts, fields.tile_mode(_nearest(spark, sf))).select("player", "base")


@REGISTER("q8_is_connected", f"{_GATE} SELECT a.id, g.id IS NOT NULL AS connected FROM asked a LEFT JOIN gate g USING (id)")
def q8(spark, sf):
    labels = _regions(spark, sf)
    reach = labels.where("label > 0").select("map_id", F.col("label").alias("a"), F.col("label").alias("b")).distinct()
    return lookup.connected(_queries(spark, sf), labels, reach).select("id", "connected")


# --- the region graph

_EDGES = f"WITH RECURSIVE {fx.EDGES_SQL}, both_ways AS (SELECT a, b, w FROM edges UNION ALL SELECT b, a, w FROM edges)"
_REACH = "r(a, b) AS (SELECT CAST(n_nationkey AS INTEGER), CAST(n_nationkey AS INTEGER) FROM nation UNION SELECT r.a, e.b FROM r JOIN both_ways e ON e.a = r.b)"


def _nodes(spark, sf):
    n = F.col("n_nationkey")
    return fx.read(spark, sf, "nation").select(F.lit(fx.MAP).alias("map_id"), n.cast("int").alias("id"), (n * 37 % 64).cast("int").alias("x"), (n * 53 % 64).cast("int").alias("y"), (n * 7 % 17 + 3).cast("double").alias("clearance"))


_NODES = "nodes AS (SELECT CAST(n_nationkey AS INTEGER) AS id, CAST(n_nationkey * 37 % 64 AS INTEGER) AS x, CAST(n_nationkey * 53 % 64 AS INTEGER) AS y, CAST(n_nationkey * 7 % 17 + 3 AS DOUBLE) AS clearance FROM nation)"


def _chokes(spark, sf):
    """The graph's edges as chokepoints between regions."""
    e = fx.region_edges(spark, sf)
    x, y = ((F.col("a") * 37 + F.col("b") * 11) % 64).cast("int"), ((F.col("a") * 53 + F.col("b") * 29) % 64).cast("int")
    return e.select("map_id", (F.col("a") * 100 + F.col("b")).alias("id"), F.col("a").alias("region_a"), F.col("b").alias("region_b"), F.col("w").cast("double").alias("width"), x.alias("x"), y.alias("y"))


_CHOKES = "chokes AS (SELECT a * 100 + b AS id, a AS region_a, b AS region_b, w::DOUBLE AS width FROM edges)"


@REGISTER("o31_node_edge_dedup", "SELECT CAST(l_partkey % 9 AS INTEGER) AS a, CAST(l_suppkey % 7 AS INTEGER) AS b FROM lineitem UNION SELECT CAST(l_suppkey % 7 AS INTEGER), CAST(l_partkey % 9 AS INTEGER) FROM lineitem")
def o31(spark, sf):
    edges = fx.read(spark, sf, "lineitem").select(F.lit(fx.MAP).alias("map_id"), (F.col("l_partkey") % 9).cast("int").alias("a"), (F.col("l_suppkey") % 7).cast("int").alias("b"))
    return graph.symmetric(edges).drop("map_id")


_SEGMENTS = f"""WITH {fx.RINGS_SQL}, {_NODES}, u AS (SELECT n.id, n.x AS nx, n.y AS ny, s.label * 8 + s.i AS segment, s.x, s.y, s.x2, s.y2, CASE WHEN (x2 - s.x) ** 2 + (y2 - s.y) ** 2 = 0 THEN 0.0 ELSE ((n.x - s.x) * (x2 - s.x) + (n.y - s.y) * (y2 - s.y)) / ((x2 - s.x) ** 2 + (y2 - s.y) ** 2) END AS t FROM nodes n CROSS JOIN segments s),
d AS (SELECT id, nx, ny, segment, round((x + least(1.0, greatest(0.0, t)) * (x2 - x) - nx) ** 2 + (y + least(1.0, greatest(0.0, t)) * (y2 - y) - ny) ** 2, 6) AS d2, CAST(CASE WHEN t > 1 THEN x2 WHEN t > 0 THEN trunc(x + t * (x2 - x)) ELSE x END AS INTEGER) AS px, CAST(CASE WHEN t > 1 THEN y2 WHEN t > 0 THEN trunc(y + t * (y2 - y)) ELSE y END AS INTEGER) AS py FROM u)"""


def _segments(spark, sf):
    from gridmesa.operators.geometry import edges

    ring = fx.rings(spark, sf).select("map_id", "label", F.posexplode(edges(F.col("ring"))).alias("i", "e"))
    return ring.select("map_id", (F.col("label") * 8 + F.col("i")).alias("segment"), "e.*")


@REGISTER("o30_segment_clearance", f"{_SEGMENTS} SELECT id, round(sqrt(min(d2)), 6) AS clearance FROM d GROUP BY id")
def o30(spark, sf):
    return graph.clearances(_nodes(spark, sf), _segments(spark, sf)).drop("map_id")


@REGISTER("o40_choke_sides", f"""{_SEGMENTS}, k AS (SELECT *, row_number() OVER w AS k, first_value(px) OVER w AS s1x, first_value(py) OVER w AS s1y FROM d WINDOW w AS (PARTITION BY id ORDER BY d2, segment)),
o AS (SELECT *, k > 1 AND (px - nx) * (s1x - nx) <= 0 AND (py - ny) * (s1y - ny) <= 0 AS opposite FROM k WHERE k <= 10)
SELECT id, s1x, s1y, px AS s2x, py AS s2y FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE WHEN opposite THEN 0 ELSE 1 END, CASE WHEN opposite THEN k ELSE -k END) = 1""")
def o40(spark, sf):
    return graph.choke_sides(_nodes(spark, sf), _segments(spark, sf)).drop("map_id")


def _medial(spark, sf, steps):
    return graph.medial_graph(_nodes(spark, sf), fx.region_edges(spark, sf), steps).drop("map_id")


@REGISTER("o29_medial_nodes", f"{_CELLS}, {_OBSTACLES}, {_spread_sql('near', 'SELECT x, y, label AS id FROM obstacles WHERE label > 0', 8, 11)}, n AS (SELECT x, y, c % 16777216 AS id FROM near JOIN cells USING (x, y) WHERE raw) SELECT DISTINCT a.x, a.y FROM n a JOIN n b ON (b.x = a.x + 1 AND b.y = a.y OR b.x = a.x AND b.y = a.y + 1) AND b.id <> a.id")
def o29(spark, sf):
    cells = fx.walk_cells(spark, sf)
    near = fields.nearest_objects(cells, _obstacles(spark, sf).where("label > 0").withColumnRenamed("label", "id"), "raw", crossing=0)
    return graph.medial_nodes(near, cells, "raw").select("x", "y")


@REGISTER("o32_node_types")
def o32(spark, sf):
    return _medial(spark, sf, ("classify",)).select("id", "type")


@REGISTER("o33_leaf_pruning")
def o33(spark, sf):
    return _medial(spark, sf, ("prune",))


@REGISTER("o34_node_classification")
def o34(spark, sf):
    return _medial(spark, sf, ("prune", "classify"))


@REGISTER("o37_graph_contraction")
def o37(spark, sf):
    return _medial(spark, sf, ("prune", "classify", "contract"))


@REGISTER("o38_merge_regions", f"{_EDGES}, {_NODES}, near AS (SELECT a, b FROM both_ways WHERE (a + b) % 2 = 0), m(a, b) AS (SELECT id, id FROM nodes UNION SELECT m.a, e.b FROM m JOIN near e ON e.a = m.b) SELECT a AS id, b AS into_ FROM m JOIN nodes n ON n.id = m.b QUALIFY row_number() OVER (PARTITION BY a ORDER BY clearance DESC, b) = 1")
def o38(spark, sf):
    return graph.merged_regions(_nodes(spark, sf), fx.region_edges(spark, sf).where("(a + b) % 2 = 0")).select("id", F.col("into").alias("into_"))


def _lines(spark):
    return spark.createDataFrame([(fx.MAP, 0, 21, 63, 21), (fx.MAP, 42, 0, 42, 63)], "map_id string, s1x int, s1y int, s2x int, s2y int")


def _cut_labels(spark, sf):
    return graph.region_labels(fx.walk_cells(spark, sf), "raw", _lines(spark))


_CUT = """cr(x, y, root) USING KEY (x, y) AS (SELECT x, y, x * 64 + y FROM cells WHERE raw AND x <> 42 AND y <> 21 UNION (SELECT n.x, n.y, min(d.root) FROM cr d JOIN cells n ON abs(n.x - d.x) + abs(n.y - d.y) = 1 JOIN recurring.cr p ON p.x = n.x AND p.y = n.y WHERE n.raw AND n.x <> 42 AND n.y <> 21 AND d.root < p.root GROUP BY n.x, n.y))"""


@REGISTER("o42_regions_by_choke_lines", f"{_CELLS}, {_CUT} SELECT x, y, CAST(COALESCE(k, 0) AS INTEGER) AS label FROM cells LEFT JOIN (SELECT x, y, dense_rank() OVER (ORDER BY root) AS k FROM cr) USING (x, y)")
def o42(spark, sf):
    return _cut_labels(spark, sf).select("x", "y", "label")


@REGISTER("o43_region_cells", f"{_CELLS}, {_CUT} SELECT CAST(k AS INTEGER) AS label, count(*) AS cells FROM (SELECT dense_rank() OVER (ORDER BY root) AS k FROM cr) GROUP BY 1")
def o43(spark, sf):
    return _cut_labels(spark, sf).where("label > 0").groupBy("label").agg(F.count("*").alias("cells"))


def _typed(spark, sf):
    kind = F.when(F.col("id") % 3 == 0, graph.CHOKE).otherwise(graph.REGION)
    near = F.array((F.col("id") + 1).cast("int"), (F.col("id") + 2).cast("int"))
    return _nodes(spark, sf).withColumn("type", kind).withColumn("neighbours", F.when(F.col("id") % 2 == 0, near).otherwise(F.slice(near, 1, 1)))


@REGISTER("o44_build_regions", f"{_CELLS}, {_REGIONS}, {_NODES} SELECT label, x AS open_x, y AS open_y, clearance AS open_dist FROM nodes JOIN regions USING (x, y) WHERE id % 3 <> 0 AND label > 0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY clearance DESC, id) = 1")
def o44(spark, sf):
    return graph.build_regions(_typed(spark, sf), _regions(spark, sf)).drop("map_id")


def _sides(spark, sf):
    f = lambda a, m: (F.col(a) + F.col("id") * m % 5).cast("int")
    return _nodes(spark, sf).select("map_id", "id", f("x", 2).alias("s1x"), f("y", 3).alias("s1y"), f("x", 4).alias("s2x"), f("y", 7).alias("s2y"))


@REGISTER("o45_build_chokepoints", f"WITH {_NODES}, s AS (SELECT id, x + id * 2 % 5 AS s1x, y + id * 3 % 5 AS s1y, x + id * 4 % 5 AS s2x, y + id * 7 % 5 AS s2y FROM nodes WHERE id % 3 = 0) SELECT id, id + 1 AS region_a, CASE WHEN id % 2 = 0 THEN id + 2 END AS region_b, s1x, s1y, s2x, s2y, (s1x + s2x) // 2 AS cx, (s1y + s2y) // 2 AS cy, round(sqrt((s1x - s2x) ** 2 + (s1y - s2y) ** 2), 6) AS width, id % 2 = 0 AS usable FROM s")
def o45(spark, sf):
    return graph.build_chokepoints(_typed(spark, sf), _sides(spark, sf)).drop("map_id")


@REGISTER("o46_region_chokes", f"{_EDGES}, {_CHOKES} SELECT region, list(id ORDER BY id) AS chokes FROM (SELECT region_a AS region, id FROM chokes UNION SELECT region_b, id FROM chokes) GROUP BY region")
def o46(spark, sf):
    return graph.region_chokes(_chokes(spark, sf)).drop("map_id")


@REGISTER("o47_union_find", f"{_EDGES}, {_REACH} SELECT a AS id, min(b) AS component FROM r GROUP BY a")
def o47(spark, sf):
    nodes = _nodes(spark, sf).withColumn("clearance", (-F.col("id")).cast("double"))
    return graph.merged_regions(nodes, fx.region_edges(spark, sf)).select("id", F.col("into").alias("component"))


@REGISTER("o48_reachability", f"{_EDGES}, {_REACH} SELECT a, b FROM r")
def o48(spark, sf):
    return graph.reachability(_nodes(spark, sf), fx.region_edges(spark, sf)).drop("map_id")


@REGISTER("o49_coverage_points")
def o49(spark, sf):
    labels = _regions(spark, sf)
    return graph.coverage_points(labels, graph.build_regions(_typed(spark, sf), labels), apart=20).drop("map_id")


@REGISTER("o59_region_adjacency", f"{_EDGES} SELECT DISTINCT a, b FROM both_ways")
def o59(spark, sf):
    return graph.region_adjacency(_chokes(spark, sf)).drop("map_id")


@REGISTER("o60_graph_colouring")
def o60(spark, sf):
    return graph.largest_first_colours(_nodes(spark, sf), fx.region_edges(spark, sf)).drop("map_id")


@REGISTER("o61_hue_relaxation")
def o61(spark, sf):
    return graph.relaxed_hues(_nodes(spark, sf), fx.region_edges(spark, sf)).drop("map_id")


@REGISTER("q18_choke_pairs", f"{_EDGES}, {_CHOKES}, ends AS (SELECT region_a AS region, id FROM chokes UNION SELECT region_b, id FROM chokes) SELECT p.region, p.id AS a, q.id AS b FROM ends p JOIN ends q ON p.region = q.region AND p.id < q.id")
def q18(spark, sf):
    return routing.choke_pairs(_chokes(spark, sf)).drop("map_id")


@REGISTER("q18_choke_graph")
def q18b(spark, sf):
    return routing.choke_graph(fx.walk_cells(spark, sf), _chokes(spark, sf), "raw").drop("map_id")


def _graph_paths(spark, sf):
    asked = _nodes(spark, sf).select("map_id", "id", F.lit(0).alias("s"), F.col("id").alias("t"))
    return routing.graph_paths(fx.region_edges(spark, sf), asked)


@REGISTER("q19_hierarchical_path")
def q19(spark, sf):
    return _graph_paths(spark, sf).select("id", "dist", "path")


@REGISTER("q20_hierarchical_distance", f"{_EDGES}, sp(id, d) USING KEY (id) AS (SELECT 0, CAST(0 AS BIGINT) UNION (SELECT e.b, min(s.d + e.w) FROM sp s JOIN both_ways e ON e.a = s.id LEFT JOIN recurring.sp p ON p.id = e.b WHERE p.d IS NULL OR s.d + e.w < p.d GROUP BY e.b)) SELECT CAST(n_nationkey AS INTEGER) AS id, COALESCE(d, -1) AS dist FROM nation LEFT JOIN sp ON id = n_nationkey")
def q20(spark, sf):
    return _graph_paths(spark, sf).select("id", "dist")
