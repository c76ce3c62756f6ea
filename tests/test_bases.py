"""Base scoring by hand on small maps, and the rules of the medial graph on small graphs."""

import pandas as pd
import pytest

from gridmesa.operators import bases, graph, grid

TILES, LABELS = "map_id string, x int, y int, placeable boolean", "map_id string, x int, y int, label int"
MEMBERS = "map_id string, id int, cluster int, tx int, ty int, tw int, th int, type string, amount int"


@pytest.fixture(scope="module")
def scored(spark):
    """Scores on two maps of 30 x 30 tiles: region 1 left of tile 20, region 2 from there on."""
    maps = ("a", "b")
    tiles = spark.createDataFrame([(m, x, y, True) for m in maps for x in range(30) for y in range(30)], TILES)
    labels = spark.createDataFrame([(m, 4 * x, v, 1 if x < 20 else 2) for m in maps for x in range(30) for y in range(30) for v in ((0, 1) if y == 0 else (4 * y,))], LABELS)
    members = spark.createDataFrame(
        [
            ("a", 1, 1, 12, 12, 2, 1, "mineral", 1500),
            ("a", 2, 1, 12, 14, 2, 1, "mineral", 200),
            ("b", 3, 3, 12, 0, 4, 2, "geyser", 201),
            ("b", 4, 4, 2, 25, 2, 1, "mineral", 8),
        ],
        MEMBERS,
    )
    usable = bases.usable_clusters(members, labels)
    scores = bases.influence(tiles, members, usable, labels)
    return members, usable, scores


def test_poor_clusters_are_not_usable(scored):
    assert sorted(map(tuple, scored[1].collect())) == [("a", 1, 1), ("b", 3, 1)]


def test_influence_by_hand(scored):
    got = {(r.map_id, r.x, r.y): r.score for r in scored[2].collect()}
    # Side by side, the footprint's last column at 11 and the mineral at 12: a gap of 1.
    assert got["a", 8, 12] == 200 - 1 and got["a", 7, 12] == 200 - 4 and got["a", 9, 12] == 200
    # On the right side: the mineral's last column is 13.
    assert got["a", 13, 12] == 200 and got["a", 14, 12] == 200 - 1
    assert got["a", 9, 9] == 200 - 1 and got["a", 9, 10] == 200 and got["a", 9, 13] == 200 - 1
    # The box goes from 10 before the first to 9 past the last tile; tiles of the other region do not count.
    xs = [x for m, x, y in got if m == "a" and y == 12]
    assert (min(xs), max(xs)) == (2, 19)
    ys = [y for m, x, y in got if m == "a" and x == 9]
    assert (min(ys), max(ys)) == (2, 12 + 9)
    # The poor mineral adds nothing; geysers count threefold.
    assert got["a", 9, 14] == 200 - 4 and got["b", 9, 0] == 600 and got["b", 7, 0] == 3 * (200 - 4)


def test_later_clusters_see_earlier_scores(spark):
    members = spark.createDataFrame([("a", 1, 1, 10, 10, 2, 1, "mineral", 900), ("a", 2, 2, 16, 10, 2, 1, "mineral", 900)], MEMBERS)
    usable = spark.createDataFrame([("a", 1, 1), ("a", 2, 1)], "map_id string, cluster int, region int")
    scores = spark.createDataFrame([("a", 1, 9, 10, 50), ("a", 1, 14, 10, 40), ("a", 2, 14, 10, 20), ("a", 2, 20, 10, 55)], "map_id string, cluster int, x int, y int, score long")
    best = bases.best_tiles(scores, members, usable)
    assert sorted(map(tuple, best.collect())) == [("a", 1, 9, 10, 50), ("a", 2, 14, 10, 60)]


def test_near_bases_merge(spark):
    best = spark.createDataFrame([("a", 1, 10, 10, 9), ("a", 2, 14, 10, 9), ("a", 3, 40, 10, 9)], "map_id string, cluster int, tx int, ty int, score long")
    # The far side of the box, 14 + 5, is outside; a later cluster's scores do not count yet.
    scores = spark.createDataFrame([("a", 1, 12, 10, 5), ("a", 2, 12, 10, 5), ("a", 1, 18, 14, 9), ("a", 1, 19, 10, 99), ("a", 3, 18, 14, 99)], "map_id string, cluster int, x int, y int, score long")
    got = sorted(map(tuple, bases.merge_near(best, scores).collect()))
    assert got == [("a", 1, 12, 10, 1), ("a", 2, 12, 10, 1), ("a", 3, 40, 10, 3)]


def test_starts_are_taken_in_the_order_of_bases(spark):
    own = spark.createDataFrame([("a", 1, 10, 10), ("a", 2, 12, 10), ("a", 3, 60, 10)], "map_id string, id int, tx int, ty int")
    starts = spark.createDataFrame([("a", 7, 11, 10), ("a", 8, 13, 10)], "map_id string, start int, tx int, ty int")
    assert sorted(map(tuple, bases.match_starts(own, starts).collect())) == [("a", 1, 7), ("a", 2, 8), ("a", 3, -1)]


def test_buildings_close_tiles(spark):
    tiles = spark.createDataFrame([("a", x, y, True) for x in range(8) for y in range(8)], "map_id string, tx int, ty int, walkable boolean")
    one = spark.createDataFrame([("a", 1, 64, 64, 2, 2)], "map_id string, id int, px int, py int, tw int, th int")
    closed = {(r.tx, r.ty) for r in grid.stamp_tiles(tiles, one).collect() if not r.walkable}
    assert closed == {(x, y) for x in (1, 2, 3) for y in (1, 2, 3)}


def _types(clearance, places=None, edges=None):
    n = len(clearance)
    nodes = pd.DataFrame([(i, *(places[i] if places else (20 * i, 0)), c) for i, c in enumerate(clearance)], columns=["id", "x", "y", "clearance"])
    medial = graph.Medial(nodes, pd.DataFrame(edges or [(i, i + 1) for i in range(n - 1)], columns=["a", "b"]))
    medial.classify()
    return "".join({"none": ".", "region": "R", "choke": "c"}[medial.type[i]] for i in range(n))


def test_a_narrow_place_between_two_ends_is_a_chokepoint():
    assert _types([20, 12, 5, 12, 20]) == "R.c.R"


def test_of_two_chokepoints_in_a_row_the_narrower_stays():
    assert _types([20, 6, 9, 4, 20]) == "R..cR"
    assert _types([20, 4, 9, 6, 20]) == "Rc..R"


def test_a_shallow_minimum_needs_distance():
    # Neither different enough nor farther away than the region is wide.
    near = [(0, 0), (8, 0), (16, 0), (24, 0), (60, 0)]
    assert _types([20, 19, 18, 19, 20], near) == "R...R"
    # Distance alone is enough once it exceeds the region's clearance.
    far = [(0, 0), (20, 0), (40, 0), (60, 0), (80, 0)]
    assert _types([20, 19, 18, 19, 20], far) == "R.c.R"


def test_ties_count_as_minima_and_low_maxima_do_not_count():
    assert _types([20, 5, 5, 20]) == "Rc.R"
    assert _types([20, 3, 8, 3, 20]) == "Rc..R"
    assert _types([20, 3, 14, 3, 20]) == "RcRcR"


def test_a_chokepoint_close_to_a_junction_goes():
    places = [(0, 0), (30, 0), (34, 0), (34, 40), (74, 0)]
    assert _types([20, 4, 20, 20, 20], places, [(0, 1), (1, 2), (2, 3), (2, 4)]) == "R.RRR"
    places[1] = (20, 0)
    assert _types([20, 4, 20, 20, 20], places, [(0, 1), (1, 2), (2, 3), (2, 4)]) == "RcRRR"


def test_spiral_and_coverage(spark):
    assert list(graph._spiral(0, 0, 3)) == [(0, 0), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
    labels = spark.createDataFrame([("a", x, y, 1) for x in range(40) for y in range(40)], LABELS)
    opens = spark.createDataFrame([("a", 1, 20, 20)], "map_id string, label int, open_x int, open_y int")
    got = [(r.x, r.y) for r in graph.coverage_points(labels, opens, apart=12).orderBy("k").collect()]
    assert got[0] == (20, 20) and len(set(got)) == len(got)
    assert all(abs(x - a) + abs(y - b) > 12 for i, (x, y) in enumerate(got) for a, b in got[:i])
