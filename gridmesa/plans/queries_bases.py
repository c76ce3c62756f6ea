"""Queries over base locations, balance statistics and walls."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmesa.operators import balance, bases, fields, grid, walls
from gridmesa.plans import fixtures as fx
from gridmesa.plans import queries_graph as qg
from gridmesa.plans.register import Register

REGISTER = Register()
_RES = f"WITH RECURSIVE {fx.CELLS_SQL}, {fx.RESOURCES_SQL}"
_NEAR = "near AS (SELECT p.id AS a, q.id AS b FROM resources p JOIN resources q ON p.map_id = q.map_id AND greatest(abs(p.tx - q.tx), abs(p.ty - q.ty)) + least(abs(p.tx - q.tx), abs(p.ty - q.ty)) * 3 // 8 <= 8)"
_CLUSTERS = f"""{_NEAR}, core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= 3), cc(a, b) AS (SELECT a, a FROM core UNION SELECT c.a, n.b FROM cc c JOIN near n ON n.a = c.b JOIN core k ON k.a = n.b),
named AS (SELECT a AS id, min(b) AS cluster FROM cc GROUP BY a), clusters AS (SELECT id, cluster FROM named UNION ALL SELECT n.b, min(k.cluster) FROM near n JOIN named k ON k.id = n.a WHERE n.b NOT IN (SELECT a FROM core) GROUP BY n.b)"""
_PLACE = """fits AS (SELECT c.x, c.y, bool_and(n.raw) AND count(*) = 12 AS placeable FROM cells c JOIN cells n ON n.x BETWEEN c.x AND c.x + 3 AND n.y BETWEEN c.y AND c.y + 2 GROUP BY c.x, c.y),
barred AS (SELECT DISTINCT map_id, x, CAST(unnest(range(ty - 5, ty + th + 3)) AS INTEGER) AS y FROM (SELECT map_id, CAST(unnest(range(tx - 6, tx + tw + 3)) AS INTEGER) AS x, ty, th FROM resources WHERE amount > 200)),
free AS (SELECT m.map_id, f.x, f.y, f.placeable AND b.x IS NULL AS placeable FROM fits f CROSS JOIN maps m LEFT JOIN barred b ON b.map_id = m.map_id AND b.x = f.x AND b.y = f.y)"""
#: A tile's label is that of the 64 x 64 fixture's cell of the same place.
_USABLE = f"""{qg._REGIONS}, members AS (SELECT r.*, cluster FROM resources r JOIN clusters USING (id)), firsts AS (SELECT map_id, cluster, max(amount) AS most, min(id) AS id FROM members GROUP BY 1, 2),
usable AS (SELECT f.map_id, f.cluster, label AS region FROM firsts f JOIN members m ON m.id = f.id JOIN regions ON x = tx AND y = ty WHERE most > 200 AND label > 0), rich AS (SELECT m.*, region FROM members m JOIN usable USING (map_id, cluster) WHERE amount > 200)"""
_SCORES = """gaps AS (SELECT r.map_id, cluster, x, y, type, greatest(0, tx - x - 3, x - tx - tw + 1) AS dx, greatest(0, ty - y - 2, y - ty - th + 1) AS dy FROM free JOIN regions USING (x, y) JOIN rich r ON placeable AND r.map_id = free.map_id AND region = label AND x >= tx - 10 AND x < tx + tw - 1 + 10 AND y >= ty - 10 AND y < ty + th - 1 + 10),
scores AS (SELECT map_id, cluster, x, y, CAST(sum((200 - (dx * dx + dy * dy)) * CASE WHEN type = 'geyser' THEN 3 ELSE 1 END) AS BIGINT) AS score FROM gaps GROUP BY 1, 2, 3, 4)"""
_BEST = """boxes AS (SELECT map_id, cluster, min(tx) - 10 AS x1, max(tx + tw - 1) + 10 AS x2, min(ty) - 10 AS y1, max(ty + th - 1) + 10 AS y2 FROM rich GROUP BY 1, 2),
sums AS (SELECT map_id, b.cluster, x, y, CAST(sum(score) AS BIGINT) AS score FROM boxes b JOIN scores s USING (map_id) WHERE s.cluster <= b.cluster AND x >= x1 AND x < x2 AND y >= y1 AND y < y2 GROUP BY 1, 2, 3, 4),
best AS (SELECT map_id, cluster, x AS tx, y AS ty, score FROM sums WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY map_id, cluster ORDER BY score DESC, x, y) = 1)"""


def _members(spark, sf):
    return bases.members(fx.resources(spark, sf))


def _tiles(spark, sf):
    return bases.exclusion(fx.on_every_map(spark, sf, grid.placeable(fx.walk_cells(spark, sf), "raw")), fx.resources(spark, sf))


def _labels(spark, sf):
    """Labels by walk cell, of the corners of tiles (and the cell below, on the top row)."""
    tiles = fx.on_every_map(spark, sf, qg._regions(spark, sf))
    rows = F.explode(F.when(F.col("y") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.col("y") * 4)))
    return tiles.select("map_id", (F.col("x") * 4).alias("x"), rows.alias("y"), "label")


def _scores(spark, sf):
    """(scores, members, usable)."""
    members, labels = _members(spark, sf), _labels(spark, sf)
    usable = bases.usable_clusters(members, labels)
    return bases.influence(_tiles(spark, sf), members, usable, labels), members, usable


def _bases(spark, sf):
    """A base for each nation, on walkable and other tiles of the fixture."""
    n = F.col("n_nationkey")
    return fx.read(spark, sf, "nation").select(F.lit(fx.MAP).alias("map_id"), n.cast("int").alias("id"), (n * 37 % 12).cast("int").alias("tx"), (n * 53 % 13).cast("int").alias("ty"))


_BASES = "bases AS (SELECT CAST(n_nationkey AS INTEGER) AS id, CAST(n_nationkey * 37 % 12 AS INTEGER) AS tx, CAST(n_nationkey * 53 % 13 AS INTEGER) AS ty FROM nation)"


@REGISTER("o65_neighbours", f"{_RES}, {_NEAR} SELECT a, b FROM near")
def o65(spark, sf):
    return bases.neighbours(fx.resources(spark, sf)).drop("map_id")


@REGISTER("o66_resource_clusters", f"{_RES}, {_CLUSTERS} SELECT id, cluster FROM clusters")
def o66(spark, sf):
    return bases.clusters(fx.resources(spark, sf)).drop("map_id")


@REGISTER("o68_resource_exclusion", f"{_RES}, {_PLACE} SELECT map_id, x, y, placeable FROM free")
def o68(spark, sf):
    return _tiles(spark, sf).select("map_id", "x", "y", "placeable")


@REGISTER("o68_blocking", f"{_RES} SELECT id, amount <= 200 AS is_blocking FROM resources")
def o68b(spark, sf):
    return bases.blocking(fx.resources(spark, sf)).drop("map_id")


@REGISTER("o69_usable_clusters", f"{_RES}, {_CLUSTERS}, {_USABLE} SELECT map_id, cluster, region FROM usable")
def o69(spark, sf):
    return bases.usable_clusters(_members(spark, sf), _labels(spark, sf))


@REGISTER("o70_influence", f"{_RES}, {_CLUSTERS}, {_PLACE}, {_USABLE}, {_SCORES} SELECT map_id, cluster, x, y, score FROM scores")
def o70(spark, sf):
    return _scores(spark, sf)[0]


@REGISTER("o71_best_tile", f"{_RES}, {_CLUSTERS}, {_PLACE}, {_USABLE}, {_SCORES}, {_BEST} SELECT map_id, cluster, tx, ty, score FROM best")
def o71(spark, sf):
    return bases.best_tiles(*_scores(spark, sf))


@REGISTER("o72_merge_near_bases")
def o72(spark, sf):
    scores, members, usable = _scores(spark, sf)
    return bases.merge_near(bases.best_tiles(scores, members, usable), scores)


@REGISTER("o73_match_starts")
def o73(spark, sf):
    starts = _bases(spark, sf).where("id % 3 = 1").select("map_id", F.col("id").alias("start"), (F.col("tx") + 1).alias("tx"), F.col("ty"))
    return bases.match_starts(_bases(spark, sf), starts).drop("map_id")


_BOX = qg._spread_sql("area", "SELECT x, y, 0 AS id FROM cells WHERE x BETWEEN 16 AND 31 AND y BETWEEN 20 AND 31", 10, 14, "n.raw", bound="d.c // 16777216 + m.cost <= 400")


def _small(spark, sf):
    """Resources scaled down onto the 16 x 16 tiles that the 64 x 64 walk cells make."""
    return fx.resources(spark, sf).withColumns({"tx": F.floor(F.col("tx") / 4).cast("int"), "ty": F.floor(F.col("ty") / 4).cast("int")})


def _attached(spark, sf):
    """Resources near one base on every map."""
    one = fx.resources(spark, sf).select("map_id").distinct().select("map_id", F.lit(1).alias("id"), F.lit(4).alias("tx"), F.lit(5).alias("ty"))
    return bases.attached(one, _small(spark, sf), fx.on_every_map(spark, sf, fx.walk_cells(spark, sf)))


_ATTACHED = f"{_RES}, {_BOX}, small AS (SELECT map_id, id, type, amount, tx // 4 AS tx, ty // 4 AS ty FROM resources), attached AS (SELECT map_id, 1 AS base, id, type, amount, c // 16777216 AS dist FROM small JOIN area ON x = tx * 4 + CASE WHEN type = 'geyser' THEN 8 ELSE 4 END AND y = ty * 4 + CASE WHEN type = 'geyser' THEN 4 ELSE 2 END)"


@REGISTER("o74_attach_resources", f"{_ATTACHED} SELECT map_id, base, id, dist FROM attached")
def o74(spark, sf):
    return _attached(spark, sf)


@REGISTER("o76_base_measures", f"{_ATTACHED} SELECT map_id, base, CAST(COALESCE(sum(amount) FILTER (type = 'mineral'), 0) AS BIGINT) AS minerals, CAST(COALESCE(sum(amount) FILTER (type = 'geyser'), 0) AS BIGINT) AS gas, count(*) FILTER (type = 'geyser') = 0 AS mineral_only FROM attached GROUP BY map_id, base")
def o76(spark, sf):
    return bases.measures(_attached(spark, sf), _small(spark, sf))


def _pairs(spark, sf):
    b = _bases(spark, sf)
    tiles = grid.tile_walkability(fx.walk_cells(spark, sf)).withColumnsRenamed({"tx": "x", "ty": "y"})
    ground = fields.ground_distance(tiles, b.select("map_id", F.col("id").alias("start"), F.col("tx").alias("x"), F.col("ty").alias("y")), "walkable")
    return bases.base_distances(b, ground)


_PAIRS = f"""WITH RECURSIVE {fx.CELLS_SQL}, {_BASES}, tiles AS (SELECT x // 4 AS x, y // 4 AS y, bool_and(raw) AS ok FROM cells GROUP BY 1, 2),
moves AS (SELECT CAST(a.i - 1 AS INTEGER) AS dx, CAST(b.i - 1 AS INTEGER) AS dy, CASE WHEN a.i <> 1 AND b.i <> 1 THEN 45 ELSE 32 END AS cost FROM range(3) a(i) CROSS JOIN range(3) b(i) WHERE a.i <> 1 OR b.i <> 1),
walk(a, x, y, c) USING KEY (a, x, y) AS (SELECT id, tx, ty, CAST(0 AS BIGINT) FROM bases UNION (SELECT d.a, n.x, n.y, min(d.c + m.cost) FROM walk d JOIN moves m ON TRUE JOIN tiles n ON n.x = d.x + m.dx AND n.y = d.y + m.dy LEFT JOIN recurring.walk p ON p.a = d.a AND p.x = n.x AND p.y = n.y WHERE n.ok AND (p.c IS NULL OR d.c + m.cost < p.c) GROUP BY 1, 2, 3)),
pairs AS (SELECT p.id AS a, q.id AS b, COALESCE(c, -1) AS ground, round(sqrt(((p.tx - q.tx) * 32) ** 2 + ((p.ty - q.ty) * 32) ** 2), 6) AS air FROM bases p CROSS JOIN bases q LEFT JOIN walk w ON w.a = p.id AND w.x = q.tx AND w.y = q.ty)"""


@REGISTER("o75_base_distances", f"{_PAIRS} SELECT a, b, ground, air FROM pairs")
def o75(spark, sf):
    return _pairs(spark, sf).drop("map_id")


@REGISTER("o75_islands", f"{_PAIRS} SELECT a AS id, count(*) FILTER (a <> b AND ground >= 0) = 0 AS is_island FROM pairs GROUP BY a")
def o75b(spark, sf):
    return bases.islands(_pairs(spark, sf)).drop("map_id")


@REGISTER("o77_base_centre", f"WITH {_BASES} SELECT id, tx * 32 + 64 AS px, ty * 32 + 48 AS py FROM bases")
def o77(spark, sf):
    return bases.centres(_bases(spark, sf)).select("id", "px", "py")


# --- balance


def _starts(spark, sf):
    return _bases(spark, sf).where("id % 3 = 0")


@REGISTER("b1_openness", "SELECT round(avg(v), 6) AS mean_openness, round(stddev_pop(v), 6) AS std_openness, round(avg(a), 6) AS mean_area, round(stddev_pop(a), 6) AS std_area FROM (SELECT n_nationkey * 7 % 17 AS v, n_nationkey * 31 % 101 * 1.5::DOUBLE AS a FROM nation)")
def b1(spark, sf):
    n = F.col("n_nationkey")
    return balance.openness(fx.read(spark, sf, "nation").select(F.lit(fx.MAP).alias("map_id"), (n * 7 % 17).alias("openness"), (n * 31 % 101 * 1.5).alias("area"))).drop("map_id")


_STATS = "round(avg({0}), 6) AS mean_{1}, round(stddev_pop({0}), 6) AS std_{1}"


@REGISTER("b2_start_pairs", f"{_PAIRS} SELECT {_STATS.format('ground', 'ground')}, {_STATS.format('air', 'air')} FROM pairs WHERE a < b AND a % 3 = 0 AND b % 3 = 0")
def b2(spark, sf):
    return balance.pair_distances(_pairs(spark, sf), _starts(spark, sf)).drop("map_id")


@REGISTER("b3_two_nearest_expansions", f"{_PAIRS}, k AS (SELECT a, ground, row_number() OVER (PARTITION BY a ORDER BY ground, b) AS k FROM pairs WHERE a % 3 = 0 AND b % 3 <> 0 AND ground >= 0), p AS (SELECT a, max(ground) FILTER (k = 1) AS f, max(ground) FILTER (k = 2) AS s FROM k WHERE k <= 2 GROUP BY a) SELECT {_STATS.format('f', 'first')}, {_STATS.format('s', 'second')}, {_STATS.format('f + s', 'both')} FROM p")
def b3(spark, sf):
    return balance.two_nearest(_pairs(spark, sf), _starts(spark, sf)).drop("map_id")


@REGISTER("b4_all_expansions", f"{_PAIRS}, p AS (SELECT a, avg(ground) AS m, stddev_pop(ground) AS s FROM pairs WHERE a % 3 = 0 AND b % 3 <> 0 GROUP BY a) SELECT round(stddev_pop(m), 6) AS std_mean, round(stddev_pop(s), 6) AS std_std FROM p")
def b4(spark, sf):
    return balance.all_expansions(_pairs(spark, sf), _starts(spark, sf)).drop("map_id")


@REGISTER("b5_choke_symmetry", """WITH e AS (SELECT p_partkey % 40 AS id, row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY p_partkey) - 1 AS k, count(*) OVER (PARTITION BY p_partkey % 40) AS n, p_size AS width, p_size * 7 % 31 AS dist FROM part),
d AS (SELECT a.id, (a.width - b.width) ** 2 AS w, (a.dist - b.dist) ** 2 AS d FROM e a JOIN e b ON a.id = b.id AND b.k = a.n - 1 - a.k WHERE a.k < a.n // 2)
SELECT CAST(id AS INTEGER) AS id, round(sqrt(avg(w)), 6) AS width_rms, round(sqrt(avg(d)), 6) AS dist_rms FROM (SELECT DISTINCT id FROM e) LEFT JOIN d USING (id) GROUP BY id""")
def b5(spark, sf):
    p = fx.read(spark, sf, "part")
    choke = F.struct("p_partkey", F.col("p_size").cast("int").alias("width"), (F.col("p_size") * 7 % 31).cast("int").alias("dist"))
    return balance.choke_symmetry(p.groupBy(F.lit(fx.MAP).alias("map_id"), (F.col("p_partkey") % 40).cast("int").alias("id")).agg(F.array_sort(F.collect_list(choke)).alias("chokes"))).drop("map_id")


# --- walls


@REGISTER("t1_narrowest_choke", f"{qg._EDGES}, {qg._CHOKES} SELECT region, id FROM (SELECT region_a AS region, id, width FROM chokes UNION ALL SELECT region_b, id, width FROM chokes) QUALIFY row_number() OVER (PARTITION BY region ORDER BY width, id) = 1")
def t1(spark, sf):
    return walls.narrowest(qg._chokes(spark, sf)).drop("map_id")


@REGISTER("t1_widest_choke", f"{qg._EDGES}, {qg._CHOKES} SELECT id FROM chokes WHERE width < 300 ORDER BY width DESC, id LIMIT 1")
def t1b(spark, sf):
    return walls.widest(qg._chokes(spark, sf)).drop("map_id")


@REGISTER("t2_topmost_start", f"WITH {qg._NODES} SELECT id FROM nodes ORDER BY y, id LIMIT 1")
def t2(spark, sf):
    return walls.topmost(qg._nodes(spark, sf).withColumn("cy", F.col("y"))).drop("map_id")


def _wall_tiles(spark, sf):
    t = fx.plane(spark, 16, 16)
    return t.withColumns({"buildable": (F.col("x") + F.col("y")) % 3 != 0, "region": F.when(F.col("x") < 8, 1).otherwise(2)})


_WALL_TILES = "tiles AS (SELECT CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y, (gx + gy) % 3 <> 0 AS buildable, CASE WHEN gx < 8 THEN 1 ELSE 2 END AS region FROM range(16) t(gx) CROSS JOIN range(16) u(gy))"
_KINDS = f"""WITH {fx.CELLS_SQL}, {_WALL_TILES}, inner_ AS (SELECT x // 4 AS x, y // 4 AS y, bool_and(raw) AS open FROM cells WHERE x % 4 IN (1, 2) AND y % 4 IN (1, 2) GROUP BY 1, 2),
near AS (SELECT *, abs(x - 8) <= 10 AND abs(y - 4) <= 10 AS close FROM tiles JOIN inner_ USING (x, y) WHERE abs(x - 8) <= 14 AND abs(y - 4) <= 14),
kinds AS (SELECT x, y, 'build' AS kind FROM near WHERE close AND region = 1 AND buildable UNION ALL SELECT x, y, 'outside' FROM near WHERE close AND region <> 1 AND open UNION ALL SELECT x, y, 'walk' FROM near WHERE open)"""


def _kinds(spark, sf):
    chokes = spark.createDataFrame([(fx.MAP, 1, 8, 4, 1)], "map_id string, id int, tx int, ty int, home int")
    return walls.classified_tiles(_wall_tiles(spark, sf), fx.walk_cells(spark, sf).withColumnRenamed("raw", "walkable"), chokes)


@REGISTER("t3_tile_classes", f"{_KINDS} SELECT x, y, kind FROM kinds")
def t3(spark, sf):
    return _kinds(spark, sf).select("x", "y", "kind")


@REGISTER("t4_can_build_here", f"WITH {fx.CELLS_SQL} SELECT c.x, c.y, bool_and(n.raw) AND count(*) = 6 AS placeable FROM cells c JOIN cells n ON n.x BETWEEN c.x AND c.x + 2 AND n.y BETWEEN c.y AND c.y + 1 GROUP BY c.x, c.y")
def t4(spark, sf):
    return grid.placeable(fx.walk_cells(spark, sf), "raw", 3, 2).select("x", "y", "placeable")


_APPROX = "greatest(abs(x - 9), abs(y - 7)) + least(abs(x - 9), abs(y - 7)) * 3 // 8"


@REGISTER("t5_extreme_tiles", f"WITH {_WALL_TILES}, b AS (SELECT * FROM tiles WHERE buildable) (SELECT 'near' AS which, x, y FROM b ORDER BY {_APPROX}, x DESC, y DESC LIMIT 1) UNION ALL (SELECT 'far', x, y FROM b ORDER BY {_APPROX} DESC, x DESC, y DESC LIMIT 1)")
def t5(spark, sf):
    own = _wall_tiles(spark, sf).where("buildable")
    pick = lambda name, far: walls.extreme_tile(own, F.lit(9), F.lit(7), far).select(F.lit(name).alias("which"), "x", "y")
    return pick("near", False).unionByName(pick("far", True))


#: Gaps in pixels on the left, right, top and bottom of a building kind.
GAPS = {"barracks": (16, 7, 8, 15), "supply": (10, 9, 10, 5)}


@REGISTER("t6_solver_program", f"{_KINDS} SELECT kind || 'Tile(' || x || ', ' || y || ').' AS line FROM kinds UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{s}Gap({kind}, {v}).')" for kind, own in GAPS.items() for s, v in zip(("left", "right", "top", "bottom"), own, strict=True)) + ") t(line)")
def t6(spark, sf):
    return walls.solver_program(_kinds(spark, sf), GAPS).select("line")


@REGISTER("t7_parsed_answer", "SELECT 'supply' AS kind, CAST(n_nationkey AS INTEGER) AS x, CAST(n_regionkey AS INTEGER) AS y FROM nation UNION ALL SELECT 'barracks', CAST(n_regionkey AS INTEGER), CAST(n_nationkey AS INTEGER) FROM nation")
def t7(spark, sf):
    answer = F.format_string("Answer: 1 place(supply,%d,%d) other(1) place(barracks, %d, %d)", "n_nationkey", "n_regionkey", "n_regionkey", "n_nationkey")
    return walls.parsed_answer(fx.read(spark, sf, "nation").select(F.lit(fx.MAP).alias("map_id"), answer.alias("answer"))).drop("map_id")


def _placed(spark, sf):
    n = F.col("n_nationkey")
    rows = fx.read(spark, sf, "nation").select(F.lit(fx.MAP).alias("map_id"), n.cast("int").alias("id"), (n * 37 % 16).cast("int").alias("tx"), (n * 53 % 16).cast("int").alias("ty"), (n * 13 % 97 + 32).cast("double").alias("width"), (n % 4 != 0).alias("buildable"))
    return rows


_RADIUS = "placed AS (SELECT CAST(n_nationkey AS INTEGER) AS id, CAST(n_nationkey * 37 % 16 AS INTEGER) AS tx, CAST(n_nationkey * 53 % 16 AS INTEGER) AS ty, CAST((n_nationkey * 13 % 97 + 32) // 32 * CASE WHEN n_nationkey % 4 <> 0 THEN 1 ELSE 3 END AS INTEGER) AS radius FROM nation)"


@REGISTER("t9_choke_radius", f"WITH {_RADIUS} SELECT id, radius FROM placed")
def t9(spark, sf):
    return walls.choke_radius(_placed(spark, sf)).drop("map_id")


_GRID = f"WITH {fx.CELLS_SQL}, {_WALL_TILES}, {_RADIUS}, walk AS (SELECT x // 4 AS x, y // 4 AS y, raw AS walkable FROM cells WHERE x % 4 = 0 AND y % 4 = 0)"


def _grid(spark, sf):
    placed = _placed(spark, sf)
    return walls.choke_grid(placed.join(walls.choke_radius(placed), ["map_id", "id"]), _wall_tiles(spark, sf), fx.walk_cells(spark, sf).withColumnRenamed("raw", "walkable"))


@REGISTER("t8_choke_grid", f"{_GRID} SELECT id AS choke, CAST(a.i - radius AS INTEGER) AS dx, CAST(b.i - radius AS INTEGER) AS dy, CAST(COALESCE(CAST(walkable AS INTEGER) + CAST(buildable AS INTEGER), 4) AS INTEGER) AS value FROM placed JOIN range(30) a(i) ON a.i <= 2 * radius JOIN range(30) b(i) ON b.i <= 2 * radius LEFT JOIN tiles t ON t.x = tx + a.i - radius AND t.y = ty + b.i - radius LEFT JOIN walk w ON w.x = t.x AND w.y = t.y")
def t8(spark, sf):
    return _grid(spark, sf).drop("map_id")


def _ends(spark, sf):
    sides = _placed(spark, sf).select("map_id", F.col("id").alias("choke"), (F.col("id") % 5 - 2).cast("int").alias("s1x"), (F.col("id") % 3 + 1).cast("int").alias("s1y"), (2 - F.col("id") % 5).cast("int").alias("s2x"), (-1 - F.col("id") % 3).cast("int").alias("s2y"))
    return walls.wall_ends(_grid(spark, sf), sides)


@REGISTER("t10_t13_wall_ends")
def t13(spark, sf):
    return _ends(spark, sf).drop("map_id")


@REGISTER("t15_route_comparison")
def t15(spark, sf):
    from gridmesa.operators import routing

    direct = qg._distances(spark, sf).select("id", F.col("dist").alias("direct"))
    gated = routing.distances(fx.walk_cells(spark, sf), qg._gated(spark, sf), "raw").select("id", F.col("dist").alias("gated"))
    return direct.join(gated, "id", "left").select("id", "direct", F.coalesce("gated", F.lit(-1)).alias("gated"))


@REGISTER("q21_analyze")
def q21(spark, sf):
    """Rows of every result table of the whole analysis."""
    from gridmesa.plans.analysis import analyze

    found = analyze(fx.walk_cells(spark, sf), fx.buildings(spark, sf), _small(spark, sf).withColumn("map_id", F.lit(fx.MAP)))
    rows = None
    for name, df in found.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("result"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows
