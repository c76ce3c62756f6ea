"""The whole analysis of a set of maps: from cells, buildings and resources to regions, chokepoints and bases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmesa.operators import bases, fields, geometry, graph, grid
from gridmesa.sources.cache import landed


def obstacles(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, polygons) of unwalkable components whose outline is large enough; cells of the others get label 0. cells: map_id, x, y, walk."""
    labels = landed(fields.component_labels(cells.withColumn("blocked", ~F.col("walk")), "blocked"))
    size = landed(cells.groupBy("map_id").agg(F.max("x").alias("max_x"), F.max("y").alias("max_y")))
    rings = landed(fields.obstacle_polygons(labels)).join(size, "map_id")
    kept = landed(rings.where(geometry.kept_by_area(F.col("ring"), F.col("max_x"), F.col("max_y"))))
    turned = landed(kept.withColumn("ring", geometry.rotated_inside(F.col("ring"), F.col("max_x"), F.col("max_y"))))
    smooth = landed(geometry.simplified(turned))
    anchored = landed(smooth.select("map_id", "label", geometry.anchored(F.col("ring"), F.col("max_x"), F.col("max_y")).alias("ring")))
    polygons = geometry.simplified(anchored, 1.0)
    known = kept.select("map_id", "label", F.lit(True).alias("_k"))
    return labels.join(known, ["map_id", "label"], "left").select("map_id", "x", "y", F.when(F.col("_k"), F.col("label")).otherwise(0).alias("label")), polygons


def medial(cells: DataFrame, labels: DataFrame, polygons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(graph, sides): the contracted graph of regions and chokepoints, and the sides of its chokepoints."""
    near = fields.nearest_objects(cells, labels.where("label > 0").select("map_id", "x", "y", F.col("label").alias("id")), "walk", crossing=0)
    numbered = graph.medial_nodes(near, cells, "walk").withColumn("id", F.row_number().over(Window.partitionBy("map_id").orderBy("x", "y")))
    edge = polygons.select("map_id", "label", F.posexplode(geometry.edges(F.col("ring"))).alias("i", "e"))
    segments = edge.select("map_id", (F.col("label") * 100_000 + F.col("i")).alias("segment"), "e.*")
    numbered, segments = landed(numbered), landed(segments)
    nodes = landed(numbered.join(graph.clearances(numbered, segments), ["map_id", "id"]))
    contracted = graph.medial_graph(nodes, graph.neighbour_edges(numbered))
    return contracted, graph.choke_sides(contracted.where(F.col("type") == graph.CHOKE), segments)


def analyze(cells: DataFrame, buildings: DataFrame, resources: DataFrame, buildable: DataFrame | None = None, starts: DataFrame | None = None) -> dict[str, DataFrame]:
    """All result tables by name. What several of them come from lands in shared tables: as one plan it would be planned again for each.

    cells: map_id, x, y, raw (walk cells); resources: map_id, id, tx, ty, type, amount, tw, th; buildable: map_id, x, y, buildable, by tile
    (without it, tiles that are walkable before buildings stand on them); starts: map_id, start, tx, ty.
    """
    walk = landed(grid.prepared(cells, buildings))
    labels, polygons = (landed(df) for df in obstacles(walk))
    contracted, sides = (landed(df) for df in medial(walk, labels, polygons))
    chokes = graph.build_chokepoints(contracted, sides)
    regions = landed(graph.region_labels(walk, "walk", chokes.where("usable")))
    opens = graph.build_regions(contracted, regions)
    open_tiles = grid.tile_walkability(cells)
    tiles = landed(grid.stamp_tiles(open_tiles, buildings).withColumnsRenamed({"tx": "x", "ty": "y"}))
    if buildable is None:
        buildable = open_tiles.select("map_id", F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("walkable").alias("buildable"))
    members = landed(bases.members(resources))
    usable = landed(bases.usable_clusters(members, regions))
    free = bases.exclusion(grid.placeable(buildable), resources)
    scores = landed(bases.influence(free, members, usable, regions))
    best = landed(bases.best_tiles(scores, members, usable))
    merged = landed(bases.merge_near(best, scores))
    sites = landed(bases.centres(merged.select("map_id", F.col("into").alias("id"), "tx", "ty").distinct()))
    ground = fields.ground_distance(tiles, sites.select("map_id", F.col("id").alias("start"), F.col("tx").alias("x"), F.col("ty").alias("y")), "walkable")
    distances = landed(bases.base_distances(sites, ground))
    near = landed(bases.attached(sites, resources, cells))
    founded = best.join(merged.where("cluster = into").select("map_id", "cluster"), ["map_id", "cluster"]).select("map_id", F.col("cluster").alias("id"), "tx", "ty")
    dt = landed(grid.distance_transform(walk, "walk"))
    out = {
        "walk": walk, "polygons": polygons, "graph": contracted, "chokepoints": chokes, "region_labels": regions, "regions": opens,
        "distance_transform": dt, "region_maxima": grid.region_maximum(grid.tile_maximum(dt), regions),
        "region_reach": graph.reachability(opens.select("map_id", F.col("label").alias("id")), _region_links(chokes, opens, contracted, regions)),
        "clusters": usable, "bases": sites, "base_distances": distances, "islands": bases.islands(distances), "base_resources": near,
        "base_measures": bases.measures(near, resources), "nearest_base": fields.nearest_objects(walk, fields.base_seeds(sites), "walk"),
        "nearest_obstacle": fields.nearest_objects(walk, fields.ring_seeds(polygons), "walk", crossing=0),
        "nearest_choke": fields.nearest_objects(walk, chokes.where("usable").select("map_id", F.col("cx").alias("x"), F.col("cy").alias("y"), "id"), "walk"),
        "cover": graph.coverage_points(regions, opens),
    }
    if starts is not None:
        out["starts"] = bases.match_starts(founded, starts)
    return out


def _region_links(chokes: DataFrame, opens: DataFrame, contracted: DataFrame, regions: DataFrame) -> DataFrame:
    """(map_id, a, b): labels of regions that a usable chokepoint joins."""
    under = contracted.join(regions, ["map_id", "x", "y"]).select("map_id", F.col("id"), "label")
    one = lambda c: under.select("map_id", F.col("id").alias(f"region_{c}"), F.col("label").alias(c))
    joined = chokes.where("usable").join(one("a"), ["map_id", "region_a"]).join(one("b"), ["map_id", "region_b"]).where("a > 0 AND b > 0 AND a != b").select("map_id", "a", "b")
    known = lambda c: opens.select("map_id", F.col("label").alias(c))
    return joined.join(known("a"), ["map_id", "a"]).join(known("b"), ["map_id", "b"]).select("map_id", "a", "b")
