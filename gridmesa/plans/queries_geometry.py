"""Queries over rings, points, segments and colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmesa.functions import colour, distance
from gridmesa.operators import geometry as geo
from gridmesa.plans import fixtures as fx
from gridmesa.plans.register import Register

REGISTER = Register()
_R = f"WITH {fx.RINGS_SQL}"
_TOP = 60
_AREAS = "areas AS (SELECT label, abs(sum(x * y2 - x2 * y)) / 2.0 AS area, bool_or(x = 0 OR y = 0 OR x = 60 OR y = 60) AS border FROM segments GROUP BY label)"


def _flat(df, *columns):
    """Exploded rings in order: label, i, x, y."""
    return df.select("label", F.posexplode(*columns).alias("i", "p")).select("label", "i", "p.x", "p.y")


@REGISTER("o15_touches_border", f"{_R}, {_AREAS} SELECT label, border FROM areas")
def o15(spark, sf):
    return fx.rings(spark, sf).select("label", geo.touches_border(F.col("ring"), F.lit(_TOP), F.lit(_TOP)).alias("border"))


@REGISTER("o16_area_filter", f"{_R}, {_AREAS} SELECT label FROM areas WHERE area > CASE WHEN border THEN 40 ELSE 140 END")
def o16(spark, sf):
    return fx.rings(spark, sf).where(geo.kept_by_area(F.col("ring"), F.lit(_TOP), F.lit(_TOP))).select("label")


@REGISTER("o17_ring_rotation", f"""{_R}, starts AS (SELECT label, CASE WHEN bool_or(i = 0 AND (x = 0 OR y = 0 OR x = 48 OR y = 48)) THEN COALESCE(min(i) FILTER (x > 4 AND y > 4 AND x < 48 AND y < 48), 0) ELSE 0 END AS k FROM points GROUP BY label)
SELECT label, CAST((i - k + 8) % 8 AS INTEGER) AS i, x, y FROM points JOIN starts USING (label)""")
def o17(spark, sf):
    top = F.lit(48)
    return _flat(fx.rings(spark, sf).withColumn("ring", geo.rotated_inside(F.col("ring"), top, top)), "ring")


@REGISTER("o18_simplify", None)
def o18(spark, sf):
    return _flat(geo.simplified(fx.rings(spark, sf)), "ring")


@REGISTER("o19_anchor", f"{_R} SELECT label, i, CAST(CASE WHEN x <= 2 THEN 0 WHEN x >= 48 THEN 50 ELSE x END AS INTEGER) AS x, CAST(CASE WHEN y <= 2 THEN 0 WHEN y >= 48 THEN 50 ELSE y END AS INTEGER) AS y FROM points")
def o19(spark, sf):
    return _flat(fx.rings(spark, sf).withColumn("ring", geo.anchored(F.col("ring"), F.lit(50), F.lit(50))), "ring")


@REGISTER("o20_simple_check", f"""{_R}, turns AS (SELECT a.label, bool_or(a.i + 1 < b.i AND NOT (a.i = 0 AND b.i = 7)
  AND ((a.x2 - a.x) * (b.y - a.y) - (a.y2 - a.y) * (b.x - a.x) > 0) <> ((a.x2 - a.x) * (b.y2 - a.y) - (a.y2 - a.y) * (b.x2 - a.x) > 0)
  AND ((b.x2 - b.x) * (a.y - b.y) - (b.y2 - b.y) * (a.x - b.x) > 0) <> ((b.x2 - b.x) * (a.y2 - b.y) - (b.y2 - b.y) * (a.x2 - b.x) > 0)) AS crossed FROM segments a JOIN segments b USING (label) GROUP BY 1) SELECT label, NOT crossed AS simple FROM turns""")
def o20(spark, sf):
    return geo.validity(fx.rings(spark, sf)).select("label", "simple")


@REGISTER("o21_scanline_fill", f"""{_R}, boxes AS (SELECT label, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM points GROUP BY label), columns_ AS (SELECT label, unnest(range(x1, x2 + 1)) AS x0, y1, y2 FROM boxes), cells AS (SELECT label, CAST(x0 AS INTEGER) AS x0, CAST(unnest(range(y1, y2 + 1)) AS INTEGER) AS y0 FROM columns_),
tested AS (SELECT label, x0, y0, bool_or((x2 - x) * (y0 - y) = (y2 - y) * (x0 - x) AND x0 BETWEEN least(x, x2) AND greatest(x, x2) AND y0 BETWEEN least(y, y2) AND greatest(y, y2)) AS edge,
  count(*) FILTER ((y > y0) <> (y2 > y0) AND x0 < (x2 - x) * (y0 - y) / (y2 - y)::DOUBLE + x) AS hits FROM cells JOIN segments USING (label) GROUP BY 1, 2, 3)
SELECT label, x0 AS x, y0 AS y FROM tested WHERE edge OR hits % 2 = 1""")
def o21(spark, sf):
    return geo.filled(fx.rings(spark, sf)).select("label", "x", "y")


@REGISTER("o22_bounding_box", f"{_R} SELECT label, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM points GROUP BY label")
def o22(spark, sf):
    return fx.rings(spark, sf).select("label", geo.bounding_box(F.col("ring")).alias("b")).select("label", "b.*")


@REGISTER("o23_area", f"{_R}, {_AREAS} SELECT label, CAST(area AS DOUBLE) AS area FROM areas")
def o23(spark, sf):
    return fx.rings(spark, sf).select("label", geo.area(F.col("ring")).alias("area"))


@REGISTER("o24_perimeter", f"{_R} SELECT label, round(sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)), 6) AS perimeter FROM segments GROUP BY label")
def o24(spark, sf):
    return fx.rings(spark, sf).select("label", F.round(geo.perimeter(F.col("ring")), 6).alias("perimeter"))


@REGISTER("o25_centroid", f"{_R} SELECT label, CAST(trunc(sum((x + x2) * (x * y2 - x2 * y)) / (3.0 * sum(x * y2 - x2 * y))) AS INTEGER) AS x, CAST(trunc(sum((y + y2) * (x * y2 - x2 * y)) / (3.0 * sum(x * y2 - x2 * y))) AS INTEGER) AS y FROM segments GROUP BY label")
def o25(spark, sf):
    return fx.rings(spark, sf).select("label", geo.centroid(F.col("ring")).alias("c")).select("label", "c.*")


_ONE = "CAST(label % 64 AS INTEGER) AS px, CAST(label * 7 % 64 AS INTEGER) AS py"


@REGISTER("o26_nearest_on_ring", f"""{_R}, q AS (SELECT *, {_ONE}, (x2 - x) ** 2 + (y2 - y) ** 2 AS size FROM segments),
u AS (SELECT *, CASE WHEN size = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, ((px - x) * (x2 - x) + (py - y) * (y2 - y)) / size)) END AS u FROM q),
p AS (SELECT label, i, x + u * (x2 - x) AS qx, y + u * (y2 - y) AS qy, px, py FROM u), d AS (SELECT label, i, qx, qy, round((qx - px) * (qx - px) + (qy - py) * (qy - py), 6) AS d2 FROM p)
SELECT label, d2, CAST(trunc(qx) AS INTEGER) AS x, CAST(trunc(qy) AS INTEGER) AS y FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY d2, i) = 1""")
def o26(spark, sf):
    px, py = (F.col("label") % 64).cast("int"), (F.col("label") * 7 % 64).cast("int")
    return fx.rings(spark, sf).select("label", geo.nearest_on_ring(F.col("ring"), px, py).alias("n")).select("label", "n.d2", "n.x", "n.y")


@REGISTER("o27_scale_polygon", f"{_R} SELECT label, i, CAST(x * 8 AS INTEGER) AS x, CAST(y * 8 AS INTEGER) AS y FROM points")
def o27(spark, sf):
    return _flat(fx.rings(spark, sf).withColumn("ring", geo.scaled(F.col("ring"))), "ring")


def _part(spark, sf):
    """Small integers from parts, as segments and points."""
    p, s = F.col("p_partkey"), F.col("p_size")
    columns = {"ax": p % 17, "ay": s % 13, "bx": p * 3 % 29, "by": s * 5 % 31, "px": p * 7 % 37, "py": s * 11 % 41}
    return fx.read(spark, sf, "part").select(p.cast("int").alias("id"), *[v.cast("int").alias(k) for k, v in columns.items()])


_PART = "WITH v AS (SELECT CAST(p_partkey AS INTEGER) AS id, CAST(p_partkey % 17 AS INTEGER) AS ax, CAST(p_size % 13 AS INTEGER) AS ay, CAST(p_partkey * 3 % 29 AS INTEGER) AS bx, CAST(p_size * 5 % 31 AS INTEGER) AS by_, CAST(p_partkey * 7 % 37 AS INTEGER) AS px, CAST(p_size * 11 % 41 AS INTEGER) AS py FROM part)"


@REGISTER("o35_significant_difference", _PART + " SELECT id, abs(px - py) > greatest(2.0, 0.31 * greatest(px, py)) AS differs FROM v")
def o35(spark, sf):
    return _part(spark, sf).select("id", distance.clearly_different(F.col("px"), F.col("py")).alias("differs"))


_APPROX = "greatest(abs(bx - ax), abs(by_ - ay)) + (least(abs(bx - ax), abs(by_ - ay)) * 3) // 8"


@REGISTER("o36_node_distance", f"{_PART} SELECT id, CAST({_APPROX} AS INTEGER) AS approx, {_APPROX} >= 7 AND px > py AS far FROM v")
def o36(spark, sf):
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    return _part(spark, sf).select("id", distance.approx_dist(dx, dy).alias("approx"), distance.far_enough(dx, dy, F.col("px"), F.col("py")).alias("far"))


@REGISTER("o39_project_on_segment", _PART + """, t AS (SELECT *, CASE WHEN (bx - ax) ** 2 + (by_ - ay) ** 2 = 0 THEN 0 ELSE ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay))::DOUBLE / ((bx - ax) ** 2 + (by_ - ay) ** 2) END AS t FROM v)
SELECT id, CAST(CASE WHEN t > 1 THEN bx WHEN t > 0 THEN trunc(ax + t * (bx - ax)::DOUBLE) ELSE ax END AS INTEGER) AS x, CAST(CASE WHEN t > 1 THEN by_ WHEN t > 0 THEN trunc(ay + t * (by_ - ay)::DOUBLE) ELSE ay END AS INTEGER) AS y FROM t""")
def o39(spark, sf):
    return _part(spark, sf).select("id", distance.project(*[F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")]).alias("p")).select("id", "p.*")


@REGISTER("o41_midpoint_extend", _PART + """ SELECT id, CAST(trunc((ax + bx) / 2.0) AS INTEGER) AS mx, CAST(trunc((ay + by_) / 2.0) AS INTEGER) AS my, CAST(trunc((ax + bx) / 2 + (ax - (ax + bx) / 2) * 1.1::DOUBLE) AS INTEGER) AS x1, CAST(trunc((ay + by_) / 2 + (ay - (ay + by_) / 2) * 1.1::DOUBLE) AS INTEGER) AS y1,
CAST(trunc((ax + bx) / 2 + (bx - (ax + bx) / 2) * 1.1::DOUBLE) AS INTEGER) AS x2, CAST(trunc((ay + by_) / 2 + (by_ - (ay + by_) / 2) * 1.1::DOUBLE) AS INTEGER) AS y2 FROM v""")
def o41(spark, sf):
    ends = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    return _part(spark, sf).select("id", distance.midpoint(*ends).alias("m"), distance.extended(*ends).alias("e")).select("id", F.col("m.x").alias("mx"), F.col("m.y").alias("my"), "e.*")


@REGISTER("o62_hsl_to_rgb", """WITH v AS (SELECT CAST(p_partkey AS INTEGER) AS id, (p_partkey % 97) / 97.0::DOUBLE AS h, 1.0::DOUBLE AS s, 0.75::DOUBLE AS l FROM part),
c AS (SELECT id, (1 - abs(2 * l - 1)) * s AS c, h * 6 AS k, l FROM v), d AS (SELECT id, c, c * (1 - abs(k - 2 * floor(k / 2) - 1)) AS d, floor(k) AS k, l - c / 2 AS m FROM c),
f AS (SELECT id, m, CASE k WHEN 0 THEN c WHEN 1 THEN d WHEN 4 THEN d WHEN 5 THEN c ELSE 0 END AS r, CASE k WHEN 0 THEN d WHEN 1 THEN c WHEN 2 THEN c WHEN 3 THEN d ELSE 0 END AS g, CASE k WHEN 2 THEN d WHEN 3 THEN c WHEN 4 THEN c WHEN 5 THEN d ELSE 0 END AS b FROM d)
SELECT id, CAST(floor((r + m) * 255 + 0.5) AS INTEGER) AS r, CAST(floor((g + m) * 255 + 0.5) AS INTEGER) AS g, CAST(floor((b + m) * 255 + 0.5) AS INTEGER) AS b FROM f""")
def o62(spark, sf):
    h = (F.col("p_partkey") % 97).cast("double") / 97.0
    return fx.read(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("id"), colour.hsl_to_rgb(h, F.lit(1.0), F.lit(0.75)).alias("c")).select("id", "c.*")


@REGISTER("o63_heat_ramp", """WITH t AS (SELECT CAST(p_partkey AS INTEGER) AS id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (p_size - 5.0::DOUBLE) / 35)) * 2 AS t FROM part)
SELECT id, CAST(floor(CASE WHEN t <= 1 THEN 1 ELSE 1 - (t - 1) END * 255 + 0.5) AS INTEGER) AS r, CAST(floor(CASE WHEN t <= 1 THEN t ELSE 1 END * 255 + 0.5) AS INTEGER) AS g, 0 AS b FROM t""")
def o63(spark, sf):
    return fx.read(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("id"), colour.heat(F.col("p_size").cast("double"), F.lit(5.0), F.lit(40.0)).alias("c")).select("id", "c.*")


@REGISTER("o64_palette", "SELECT CAST(p_partkey AS INTEGER) AS id, COALESCE((" + "[" + ", ".join(f"'{c}'" for c in colour.PALETTE) + "])[CAST(CASE WHEN p_size > 40 THEN NULL ELSE p_partkey % 8 END AS INTEGER) + 1], '#808080') AS colour FROM part")
def o64(spark, sf):
    index = F.when(F.col("p_size") <= 40, F.col("p_partkey").cast("int"))
    return fx.read(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("id"), colour.palette(index).alias("colour"))
