import heapq
import random

import numpy as np
import pytest

from gridmesa.operators import geometry, graph, walls
from gridmesa.operators import kernels as k
from gridmesa.operators.grid import level_sets


def _dijkstra(passable, start, straight, diagonal, corner):
    best, heap = {start: 0}, [(0, start)]
    while heap:
        d, (x, y) = heapq.heappop(heap)
        if d > best[x, y]:
            continue
        for dx, dy in k.STRAIGHT + k.DIAGONAL:
            a, b = x + dx, y + dy
            if not (0 <= a < passable.shape[0] and 0 <= b < passable.shape[1]) or not passable[a, b]:
                continue
            if corner and dx and dy and not (passable[a, y] or passable[x, b]):
                continue
            c = d + (diagonal if dx and dy else straight)
            if c < best.get((a, b), 1 << 60):
                best[a, b] = c
                heapq.heappush(heap, (c, (a, b)))
    return best


@pytest.mark.parametrize("corner", [False, True])
def test_spread_equals_dijkstra(corner):
    rng = np.random.default_rng(1)
    for _ in range(20):
        passable = rng.random((9, 12)) > 0.35
        dist, _ = k.unpacked(k.spread(k.seed_array(passable.shape, [(4, 5, 0)]), passable, 10, 14, corner_rule=corner))
        best = _dijkstra(passable, (4, 5), 10, 14, corner)
        assert {(x, y): d for (x, y), d in np.ndenumerate(dist) if d >= 0} == best


def test_paths_cost_their_distance():
    rng = np.random.default_rng(2)
    passable = rng.random((15, 15)) > 0.3
    dist, _ = k.unpacked(k.spread(k.seed_array(passable.shape, [(0, 0, 0)]), passable, 10, 14, corner_rule=True))
    for target in zip(*np.nonzero(dist > 0), strict=True):
        path = k.trace_path(dist, tuple(map(int, target)), passable, 10, 14, True)
        cost = sum(14 if a != c and b != d else 10 for (a, b), (c, d) in zip(path, path[1:], strict=False))
        assert path[0] == (0, 0) and path[-1] == target and cost == dist[target]


def test_components_number_by_first_cell():
    mask = np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0], [1, 1, 0]], bool)
    assert k.components(mask).tolist() == [[1, 0, 1], [0, 1, 0], [0, 0, 0], [2, 2, 0]]
    assert k.components(mask, eight=False).max() == 4


def test_level_sets_are_lipschitz():
    rng = np.random.default_rng(3)
    start = np.where(rng.random((20, 20)) < 0.1, 0, -1)
    dt = level_sets(start)
    assert abs(np.diff(dt, axis=0)).max() <= 1 and abs(np.diff(dt, axis=1)).max() <= 1
    assert (dt[start == 0] == 0).all()


def test_small_pockets_fill_and_large_stay():
    labels = np.ones((12, 12), int)
    labels[3:5, 3:5] = 0
    assert (k.fill_small_holes(labels) == 1).all()
    labels[2:10, 2:10] = 0
    assert (k.fill_small_holes(labels)[2:10, 2:10] == 0).all()


def test_contour_walks_the_boundary():
    mask = np.zeros((6, 6), bool)
    mask[1:4, 1:5] = True
    ring = k.contour(mask)
    inner = {(2, 2), (2, 3)}
    assert set(ring) == {(x, y) for x, y in zip(*np.nonzero(mask), strict=True)} - inner
    assert k.contour(mask & (np.indices(mask.shape)[0] == 1) & (np.indices(mask.shape)[1] == 1)) == [(1, 1)]


def test_simplify_keeps_corners():
    ring = [(x, 0) for x in range(11)] + [(10, y) for y in range(1, 11)] + [(x, 10) for x in range(9, -1, -1)] + [(0, y) for y in range(9, 0, -1)]
    assert geometry.simplify(ring, 2.0) == [(0, 0), (10, 0), (10, 10), (0, 10)]
    assert geometry.is_simple([(0, 0), (4, 0), (4, 4), (0, 4)])
    assert not geometry.is_simple([(0, 0), (4, 4), (4, 0), (0, 4)])


def test_merged_regions_keep_the_clearest():
    import pandas as pd

    nodes = pd.DataFrame({"id": [1, 2, 3], "x": [0, 9, 18], "y": [0, 0, 0], "clearance": [10.0, 30.0, 10.0]})
    graph_ = graph.Medial(nodes, pd.DataFrame({"a": [1, 2], "b": [2, 3]}))
    graph_.type = dict.fromkeys(graph_.type, graph.REGION)
    graph_.merge()
    assert set(graph_.near) == {2}


def test_bresenham_reaches_its_aim():
    for _ in range(50):
        x, y = random.randint(-9, 9), random.randint(-9, 9)
        points = []
        for p in walls.bresenham(0, 0, x, y):
            points.append(p)
            if p == (x, y) or len(points) > 40:
                break
        assert not points or points[-1] == (x, y)
