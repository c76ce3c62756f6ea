"""Work that must not grow faster than its input, or that one small file must not leave to one task."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmesa.operators import bases
from gridmesa.operators import kernels as k
from gridmesa.plans import catalogue
from gridmesa.plans import fixtures as fx
from gridmesa.sources import chk

SF = "/root/testdata/sf0.001"


def _inside(ring, x, y):
    on, hits = False, 0
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        on |= cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by)
        hits += ((ay > y) != (by > y)) and ((cross > 0) == (by < ay))
    return on or hits % 2 == 1


def test_spans_are_the_cells_inside_each_once():
    rng = random.Random(1)
    rings = [[(rng.randint(-7, 7), rng.randint(-7, 7)) for _ in range(rng.choice([0, 1, 2, 3, 5, 9]))] for _ in range(150)]
    points = np.array([p for r in rings for p in r])
    found = [[] for _ in rings]
    for i, y, x1, x2 in zip(*k.spans(points[:, 0], points[:, 1], np.cumsum([0] + [len(r) for r in rings])), strict=True):
        found[i] += [(x, int(y)) for x in range(x1, x2 + 1)]
    for ring, cells in zip(rings, found, strict=True):
        assert sorted(cells) == [(x, y) for x in range(-7, 8) for y in range(-7, 8) if ring and _inside(ring, x, y)]


def test_rings_of_one_file_are_dealt_out(spark):
    assert fx.rings(spark, SF).rdd.getNumPartitions() == 16


def test_many_resources_at_few_places(spark):
    # As pairs they would be 160 million.
    rows = spark.range(20_000).select(F.lit("a").alias("map_id"), F.col("id").cast("int").alias("id"), (F.col("id") % 3 * 20).cast("int").alias("tx"), F.when(F.col("id") < 19_998, 0).otherwise(40).cast("int").alias("ty"))
    assert sorted(map(tuple, bases.clusters(rows).groupBy("cluster").count().collect())) == [(0, 6666), (1, 6666), (2, 6666)]


def test_clusters_by_places_are_those_by_pairs(spark):
    rng = random.Random(2)
    rows = [(m, i, rng.randint(0, 40), rng.randint(0, 40)) for m in "ab" for i in range(60)]
    near = {(p[:2], q[:2]) for p in rows for q in rows if p[0] == q[0] and (d := sorted((abs(p[2] - q[2]), abs(p[3] - q[3]))))[1] + d[0] * 3 // 8 <= 4}
    core = {p[:2] for p in rows if sum(a == p[:2] for a, _ in near) >= 3}
    name = {p: p[1] for p in core}
    for _ in rows:
        for a, b in near:
            if a in core and b in core:
                name[a] = min(name[a], name[b])
    border = {b: min(name[a] for a, c in near if c == b and a in core) for _, b in near if b not in core and any(c == b and a in core for a, c in near)}
    got = bases.clusters(spark.createDataFrame(rows, "map_id string, id int, tx int, ty int"), 4).collect()
    assert {(r.map_id, r.id): r.cluster for r in got} == name | border


@pytest.mark.parametrize("name", ["o65_neighbours", "o66_resource_clusters", "o69_usable_clusters", "o68_resource_exclusion", "o71_best_tile", "o70_influence", "o72_merge_near_bases", "o74_attach_resources", "o76_base_measures"])
def test_what_grows_with_the_maps_is_not_broadcast(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [map_id" not in plan


def test_doodads_of_keys_over_16_bits(spark, tmp_path):
    part = spark.range(65_400, 65_700).unionByName(spark.range(1_000_000, 1_000_200)).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(catalogue.ORACLES["s9_doodads"]).fetchall()
    assert sorted(map(tuple, catalogue.QUERIES["s9_doodads"](spark, str(tmp_path)).collect())) == sorted(want)


def _scanned(spark, maps):
    rows = [(m, i, name, len(p), bytearray(p)) for m, own in maps.items() for i, (name, p) in enumerate(own)]
    return spark.createDataFrame(rows, "map_id string, seq int, name string, size int, payload binary")


def test_terrain_lays_sections_over_one_another_without_grouping_tiles(spark):
    tiles = lambda *v: b"".join(t.to_bytes(2, "little") for t in v)
    dim, none = ("DIM ", tiles(2, 2)), ("DIM ", b"\x02")
    maps = {
        "early": [("MTXM", tiles(9, 9)), dim, ("MTXM", tiles(1, 2, 3, 4)), ("MTXM", tiles(5) + b"\x07")],
        "twice": [dim, ("MTXM", tiles(1, 2, 3, 4)), ("MTXM", tiles(8, 8, 8)), ("MTXM", tiles(5, 6, 7, 65535, 9)), ("MTXM", b""), ("DIM ", tiles(9, 9))],
        "partial": [dim, ("MTXM", tiles(1, 2, 3))],
        "short": [none, ("MTXM", tiles(1, 2, 3, 4))],
        "empty": [("DIM ", tiles(0, 2)), ("MTXM", tiles(1))],
        "bare": [("MTXM", tiles(1, 2, 3, 4))],
    }
    out = chk.terrain(_scanned(spark, maps))
    got = {}
    for r in out.collect():
        got.setdefault(r.map_id, {})[r.x, r.y] = r.tile
    assert got == {"early": {(0, 0): 5, (1, 0): 2, (0, 1): 3, (1, 1): 4}, "twice": {(0, 0): 5, (1, 0): 6, (0, 1): 7, (1, 1): 65535}}
    # A hash table of every tile of a task was most of its memory.
    assert not re.search(r"keys=\[map_id#\d+, i#", out._jdf.queryExecution().executedPlan().toString())


def test_pairs_of_one_map_are_dealt_out_and_ranked_only_if_near(spark):
    plan = catalogue.QUERIES["o40_choke_sides"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(_deal#\d+, 32\), REPARTITION_BY_NUM", plan) and "isnull(most" in plan


@pytest.mark.parametrize("name", ["o18_simplify", "o20_simple_check"])
def test_rings_reach_their_kernel_dealt_out(spark, name):
    assert "RoundRobinPartitioning(16)" in catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
