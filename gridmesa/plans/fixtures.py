"""Deterministic maps derived from the star-schema tables, for queries and benchmarks. Each has a DuckDB twin in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmesa.operators.grid import by_map, dealt

MAP = "m0"
SIDE = 64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def plane(spark: SparkSession, width: int = SIDE, height: int = SIDE, map_id: str = MAP) -> DataFrame:
    """Every (map_id, x, y) of a width x height grid."""
    return spark.range(width * height).select(F.lit(map_id).alias("map_id"), (F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))


def walk_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 x 64 walk cells in 4 x 4 blocks; a block is an obstacle where its line numbers sum to a multiple of 5. Read as tiles it serves the tile operators."""
    blocks = read(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 16).cast("int").alias("bx"), (F.col("l_orderkey") % 16).cast("int").alias("by")).agg(F.sum("l_linenumber").alias("s"))
    cells = plane(spark)
    joined = cells.join(F.broadcast(blocks), (F.floor(cells.x / 4) == blocks.bx) & (F.floor(cells.y / 4) == blocks.by), "left")  # 256 blocks at any scale
    return joined.select("map_id", "x", "y", F.coalesce(F.col("s") % 5 != 0, F.lit(True)).alias("raw"))


CELLS_SQL = """blocks AS (SELECT l_partkey % 16 AS bx, l_orderkey % 16 AS "by", SUM(l_linenumber) AS s FROM lineitem GROUP BY 1, 2),
cells AS (SELECT CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y, COALESCE(s % 5 <> 0, TRUE) AS raw FROM range(64) t(gx) CROSS JOIN range(64) u(gy) LEFT JOIN blocks ON bx = gx // 4 AND "by" = gy // 4)"""


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static buildings: pixel centre and size in tiles."""
    n = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(F.lit(MAP).alias("map_id"), n.cast("int").alias("id"), ((n * 37) % 64 * 8).cast("int").alias("px"), ((n * 53) % 64 * 8).cast("int").alias("py"), (1 + n % 3).cast("int").alias("tw"), (1 + n % 2).cast("int").alias("th"))


BUILDINGS_SQL = "buildings AS (SELECT CAST(n_nationkey AS INTEGER) AS id, CAST((n_nationkey * 37) % 64 * 8 AS INTEGER) AS px, CAST((n_nationkey * 53) % 64 * 8 AS INTEGER) AS py, CAST(1 + n_nationkey % 3 AS INTEGER) AS tw, CAST(1 + n_nationkey % 2 AS INTEGER) AS th FROM nation)"


#: Resources on one map.
PER_MAP = 120


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a resource: 120 to a map, in twelve groups over 64 x 64 tiles; ids are unique over all maps."""
    p = F.col("p_partkey")
    k, j = p % 12, F.floor(p % PER_MAP / 12)
    kind = F.when(j % 8 == 0, "geyser").otherwise("mineral")
    tx, ty = (k % 4 * 15 + 3 + F.col("p_size") % 6), (F.floor(k / 4) * 19 + 5 + j % 6)
    own = F.concat(F.lit("m"), F.floor(p / PER_MAP).cast("string")).alias("map_id")
    return read(spark, sf_dir, "part").select(own, p.cast("int").alias("id"), tx.cast("int").alias("tx"), ty.cast("int").alias("ty"), kind.alias("type"), (100 + F.col("p_size") * 30).cast("int").alias("amount"), F.when(kind == "geyser", 4).otherwise(2).cast("int").alias("tw"), F.when(kind == "geyser", 2).otherwise(1).cast("int").alias("th"))


RESOURCES_SQL = """resources AS (SELECT 'm' || p_partkey // 120 AS map_id, CAST(p_partkey AS INTEGER) AS id, CAST(k % 4 * 15 + 3 + p_size % 6 AS INTEGER) AS tx, CAST(k // 4 * 19 + 5 + j % 6 AS INTEGER) AS ty,
  CASE WHEN j % 8 = 0 THEN 'geyser' ELSE 'mineral' END AS type, CAST(100 + p_size * 30 AS INTEGER) AS amount, CASE WHEN j % 8 = 0 THEN 4 ELSE 2 END AS tw, CASE WHEN j % 8 = 0 THEN 2 ELSE 1 END AS th
  FROM (SELECT p_partkey, p_size, p_partkey % 12 AS k, p_partkey % 120 // 12 AS j FROM part)), maps AS (SELECT DISTINCT map_id FROM resources)"""


def on_every_map(spark: SparkSession, sf_dir: str, cells: DataFrame) -> DataFrame:
    """The same terrain (map_id ignored) on every map that has resources."""
    maps = by_map(resources(spark, sf_dir).select("map_id").distinct())
    return maps.crossJoin(F.broadcast(cells.drop("map_id")))  # 64 x 64 cells at any scale


def region_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An undirected weighted graph over nations, a < b."""
    l, o = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c, s = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    flows = l.join(o, l.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(s, F.col("l_suppkey") == s.s_suppkey)
    linked = flows.where((F.col("s_nationkey") < F.col("c_nationkey")) & ((F.col("s_nationkey") * 7 + F.col("c_nationkey") * 5) % 11 == 0))
    return linked.groupBy(F.col("s_nationkey").cast("int").alias("a"), F.col("c_nationkey").cast("int").alias("b")).agg(F.count("*").alias("w")).select(F.lit(MAP).alias("map_id"), "a", "b", "w")


EDGES_SQL = """edges AS (SELECT CAST(s_nationkey AS INTEGER) AS a, CAST(c_nationkey AS INTEGER) AS b, COUNT(*) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE s_nationkey < c_nationkey AND (s_nationkey * 7 + c_nationkey * 5) % 11 = 0 GROUP BY 1, 2)"""

#: Unit directions of a ring's eight corners, times 10, in counter-clockwise order.
CORNERS = [(10, 0), (7, 7), (0, 10), (-7, 7), (-10, 0), (-7, -7), (0, -10), (7, -7)]


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(map_id, label, ring): an octagon per part with a radius from its size, about (32, 32)."""
    radius = F.col("p_size") % 23 + 9
    corner = lambda i, dx, dy: F.struct((F.lit(32) + F.floor((radius + (F.col("p_partkey") * (i + 3)) % 5) * dx / 10)).cast("int").alias("x"), (F.lit(32) + F.floor((radius + (F.col("p_partkey") * (i + 3)) % 5) * dy / 10)).cast("int").alias("y"))
    return dealt(read(spark, sf_dir, "part").select("p_partkey", "p_size")).select(F.lit(MAP).alias("map_id"), F.col("p_partkey").cast("int").alias("label"), F.array(*[corner(i, dx, dy) for i, (dx, dy) in enumerate(CORNERS)]).alias("ring"))


RINGS_SQL = """corners AS (SELECT * FROM (VALUES {rows}) t(i, dx, dy)),
points AS (SELECT CAST(p_partkey AS INTEGER) AS label, CAST(i AS INTEGER) AS i, CAST(32 + floor((p_size % 23 + 9 + (p_partkey * (i + 3)) % 5) * dx / 10) AS INTEGER) AS x, CAST(32 + floor((p_size % 23 + 9 + (p_partkey * (i + 3)) % 5) * dy / 10) AS INTEGER) AS y
  FROM part CROSS JOIN corners),
segments AS (SELECT label, i, x, y, COALESCE(lead(x) OVER w, first_value(x) OVER w) AS x2, COALESCE(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM points WINDOW w AS (PARTITION BY label ORDER BY i))""".format(rows=", ".join(f"({i}, {dx}, {dy})" for i, (dx, dy) in enumerate(CORNERS)))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query cells: the distinct (user, event) remainders of all events."""
    return read(spark, sf_dir, "events").select(F.lit(MAP).alias("map_id"), (F.col("user_id") % 64).cast("int").alias("x"), (F.col("event_id") % 64).cast("int").alias("y")).distinct()


POINTS_SQL = "points_q AS (SELECT DISTINCT CAST(user_id % 64 AS INTEGER) AS x, CAST(event_id % 64 AS INTEGER) AS y FROM events)"
