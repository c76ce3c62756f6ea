"""Numpy kernels over one map's dense arrays (x by y). They know nothing of Spark."""

from __future__ import annotations

import numpy as np

FAR = np.int64(1) << 61
#: Distances are packed with the seed's id, so that the least packed value has the least distance and, among equals, the least id.
ID_BITS = 24
STRAIGHT, DIAGONAL = [(1, 0), (-1, 0), (0, 1), (0, -1)], [(1, 1), (1, -1), (-1, 1), (-1, -1)]


def shifted(a: np.ndarray, dx: int, dy: int, fill) -> np.ndarray:
    """out[x, y] = a[x - dx, y - dy], `fill` outside."""
    out = np.full_like(a, fill)
    w, h = a.shape
    out[max(0, dx) : w + min(0, dx), max(0, dy) : h + min(0, dy)] = a[max(0, -dx) : w + min(0, -dx), max(0, -dy) : h + min(0, -dy)]
    return out


def spread(seeds: np.ndarray, passable: np.ndarray, straight: int, diagonal: int, corner_rule: bool = False, penalty: int = 0, walkable: np.ndarray | None = None, bound: int | None = None) -> np.ndarray:
    """Shortest distances from packed seeds (FAR: none) over eight neighbours, relaxed until nothing changes.

    corner_rule: no diagonal step between two impassable side cells. penalty: added for a step from a walkable to an unwalkable cell.
    """
    dist = seeds.copy()
    extra = np.int64(penalty) << ID_BITS
    while True:
        new = dist
        for (dx, dy), cost in [(d, straight) for d in STRAIGHT] + [(d, diagonal) for d in DIAGONAL]:
            step = shifted(dist, dx, dy, FAR)
            ok = passable & (step < FAR)
            if corner_rule and dx and dy:
                ok &= shifted(passable, dx, 0, False) | shifted(passable, 0, dy, False)
            step = step + (np.int64(cost) << ID_BITS)
            if penalty:
                step = step + np.where(~walkable & shifted(walkable, dx, dy, False), extra, np.int64(0))
            if bound is not None:
                ok &= (step >> ID_BITS) <= bound
            new = np.where(ok & (step < new), step, new)
        if (new == dist).all():
            return dist
        dist = new


def seed_array(shape: tuple[int, int], points) -> np.ndarray:
    """points: (x, y, id); the least id wins a cell. Points outside are ignored."""
    out = np.full(shape, FAR)
    for x, y, i in points:
        if 0 <= x < shape[0] and 0 <= y < shape[1]:
            out[x, y] = min(out[x, y], np.int64(i))
    return out


def unpacked(dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance and id, -1 where unreached."""
    none = dist >= FAR
    return np.where(none, -1, dist >> ID_BITS), np.where(none, -1, dist & ((1 << ID_BITS) - 1))


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least member of each one's component, of 0 to n - 1 linked by pairs (u, v). Hooking and pointer jumping."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        differ = a != b
        if not differ.any():
            return parent
        np.minimum.at(parent, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while (parent[parent] != parent).any():
            parent = parent[parent]


def near_pairs(x: np.ndarray, y: np.ndarray, eps: int, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) of points within eps by the approximate distance, each with itself too, for points in the order of x: blocks of about `most` comparisons."""
    pairs, at = [], 0
    while at < len(x):
        first = int(np.searchsorted(x, x[at] - eps))
        end = min(len(x), at + max(1, most // (int(np.searchsorted(x, x[at] + eps, "right")) - first)))
        last = int(np.searchsorted(x, x[end - 1] + eps, "right"))
        dx, dy = np.abs(x[at:end, None] - x[first:last]), np.abs(y[at:end, None] - y[first:last])
        i, j = np.nonzero(np.maximum(dx, dy) + np.minimum(dx, dy) * 3 // 8 <= eps)
        pairs.append((i + at, j + first))
        at = end
    return tuple(np.concatenate(p) for p in zip(*pairs, strict=True))


def components(mask: np.ndarray, eight: bool = True) -> np.ndarray:
    """Labels 1, 2, ... of the mask's components in the order of their first cell, x first; 0 elsewhere."""
    w, h = mask.shape
    index = np.arange(w * h).reshape(w, h)
    pairs = []
    for dx, dy in [(1, 0), (0, 1)] + ([(1, 1), (1, -1)] if eight else []):
        a = index[: w - dx, max(0, -dy) : h - max(0, dy)]
        b = index[dx:, max(0, dy) : h + min(0, dy)]
        both = mask.ravel()[a] & mask.ravel()[b]
        pairs.append((a[both], b[both]))
    parent = roots(w * h, np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
    out = np.zeros(w * h, np.int64)
    out[mask.ravel()] = np.unique(parent[mask.ravel()], return_inverse=True)[1] + 1
    return out.reshape(w, h)


def trace_path(dist: np.ndarray, target: tuple[int, int], passable: np.ndarray, straight: int, diagonal: int, corner_rule: bool) -> list[tuple[int, int]]:
    """From the seed to the target along exact distances; of several predecessors the one with the least (x, y)."""
    if dist[target] < 0:
        return []
    path = [target]
    while dist[path[-1]] > 0:
        x, y = path[-1]
        options = []
        for dx, dy in STRAIGHT + DIAGONAL:
            a, b = x - dx, y - dy
            if 0 <= a < dist.shape[0] and 0 <= b < dist.shape[1] and dist[a, b] >= 0:
                cost = diagonal if dx and dy else straight
                if corner_rule and dx and dy and not (passable[a, y] or passable[x, b]):
                    continue
                if dist[a, b] + cost == dist[x, y]:
                    options.append((a, b))
        path.append(min(options))
    return path[::-1]


#: Directions of contour tracing, clockwise from east.
_AROUND = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]


def contour(mask: np.ndarray) -> list[tuple[int, int]]:
    """The outer boundary of a mask's one component as a closed walk over its cells, from its first cell."""
    start = tuple(int(v[0]) for v in np.nonzero(mask))
    w, h = mask.shape
    inside = lambda x, y: 0 <= x < w and 0 <= y < h and mask[x, y]
    path, at, heading = [start], start, 0
    first_move = None
    while True:
        for turn in range(8):
            k = (heading + 5 + turn) % 8
            cell = (at[0] + _AROUND[k][0], at[1] + _AROUND[k][1])
            if inside(*cell):
                break
        else:
            return path
        if at == start and first_move == k and len(path) > 1:
            return path[:-1]
        first_move = k if first_move is None else first_move
        at, heading = cell, k
        path.append(at)


def fill_small_holes(labels: np.ndarray, most: int = 40) -> np.ndarray:
    """Unlabelled pockets of at most `most` cells that one label encloses get that label."""
    pockets = components(labels == 0, eight=False)
    out = labels.copy()
    for p in range(1, pockets.max() + 1):
        own = pockets == p
        xs, ys = np.nonzero(own)
        if len(xs) > most or xs.min() == 0 or ys.min() == 0 or xs.max() == labels.shape[0] - 1 or ys.max() == labels.shape[1] - 1:
            continue
        ring = np.zeros_like(own)
        for dx, dy in STRAIGHT:
            ring |= shifted(own, dx, dy, False)
        around = np.unique(labels[ring & ~own])
        if len(around) == 1:
            out[own] = around[0]
    return out


def successors(offsets: np.ndarray) -> np.ndarray:
    """The index of each point's next one on its closed ring. offsets: of every ring's first point among all points, and the end."""
    after = np.arange(1, offsets[-1] + 1)
    some = offsets[1:] > offsets[:-1]
    after[offsets[1:][some] - 1] = offsets[:-1][some]
    return after


def spans(x: np.ndarray, y: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ring, row, x1, x2): the cells inside rings or on their edges as spans of rows, both ends included, each cell once; whole numbers throughout.

    A cell lies inside if an odd number of edges cross its row right of it. Of a crossing, this depends on the next whole number only.
    """
    ring = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    bx, by = x[after := successors(offsets)], y[after]
    low = np.minimum(y, by)
    rows = np.maximum(y, by) - low
    e = np.repeat(np.arange(len(x)), rows)
    row = low[e] + np.arange(len(e)) - np.repeat(np.cumsum(rows) - rows, rows)
    rise = by[e] - y[e]
    along = (bx - x)[e] * (row - y[e]) * np.sign(rise)
    left, right = x[e] + along // np.abs(rise), x[e] - -along // np.abs(rise)
    order = np.lexsort((right, row, ring[e]))
    even, odd = order[::2], order[1::2]
    on, flat = left == right, y == by
    parts = [
        (ring[e][even], row[even], right[even], right[odd] - 1),
        (ring[e][on], row[on], left[on], left[on]),
        (ring, y, np.where(flat, np.minimum(x, bx), x), np.where(flat, np.maximum(x, bx), x)),
    ]
    ring, row, x1, x2 = (np.concatenate(v) for v in zip(*parts, strict=True))
    some = np.flatnonzero(x1 <= x2)
    order = some[np.lexsort((x1[some], row[some], ring[some]))]
    ring, row, x1, x2 = ring[order], row[order], x1[order], x2[order]
    other = np.ones(len(order), bool)
    other[1:] = (ring[1:] != ring[:-1]) | (row[1:] != row[:-1])
    # The farthest end so far in the row: the row's number outweighs any end.
    base, width = x2.min(initial=0), int(x2.max(initial=0)) - int(x2.min(initial=0)) + 1
    reach = np.maximum.accumulate(np.cumsum(other) * width + x2 - base) % width + base
    starts = other.copy()
    starts[1:] |= x1[1:] > reach[:-1]
    ends = np.roll(starts, -1)
    return ring[starts], row[starts], x1[starts], reach[ends]
