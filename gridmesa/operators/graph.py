"""Regions, chokepoints and the graphs between them.

The medial graph of a map comes from the cells whose neighbours are nearest to different obstacles; pruning, classification
and contraction depend on order, so they run per map, over nodes in the order of their ids.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmesa.functions.distance import project
from gridmesa.operators import kernels as k
from gridmesa.operators.grid import KEY, dense, fresh

LEAST_REGION, LEAF_SLACK, NODE_DISTANCE, DIFFERENCE = 9.7, 0.9, 7, 0.31
#: Segments among which a chokepoint finds its sides.
SEGMENTS = 10
#: Groups that a map's segments are dealt out to.
DEALS = 256
NONE, REGION, CHOKE = "none", "region", "choke"


def unique_nodes(nodes: DataFrame) -> DataFrame:
    """One node per position, with the least id given there."""
    return nodes.groupBy("map_id", "x", "y").agg(F.min("id").alias("id"), F.max("clearance").alias("clearance"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once."""
    return edges.select("map_id", "a", "b").unionByName(edges.select("map_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def medial_nodes(nearest: DataFrame, cells: DataFrame, walkable: str) -> DataFrame:
    """(map_id, x, y): walkable cells with a right or lower neighbour nearest to another obstacle. nearest: map_id, x, y, id."""
    right, down = Window.partitionBy("map_id", "y").orderBy("x"), Window.partitionBy("map_id", "x").orderBy("y")
    compared = nearest.join(cells.where(walkable).select(*KEY), KEY).select(*KEY, "id", F.lead("id").over(right).alias("_r"), F.lead("x").over(right).alias("_rx"), F.lead("id").over(down).alias("_d"), F.lead("y").over(down).alias("_dy"))
    differs = ((F.col("_rx") == F.col("x") + 1) & (F.col("_r") != F.col("id"))) | ((F.col("_dy") == F.col("y") + 1) & (F.col("_d") != F.col("id")))
    return compared.where(differs).select(*KEY)


def neighbour_edges(nodes: DataFrame) -> DataFrame:
    """(map_id, a, b): nodes (map_id, id, x, y) in adjacent cells, a < b: an equi-join on the eight offsets."""
    offsets = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in k.STRAIGHT + k.DIAGONAL])).alias("o")
    from_ = nodes.select("map_id", F.col("id").alias("a"), "x", "y", offsets).select("map_id", "a", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
    return from_.join(nodes.select("map_id", F.col("id").alias("b"), "x", "y"), KEY).where("a < b").select("map_id", "a", "b")


def _paired(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """Every node with every segment of its map (map_id, segment, ax, ay, bx, by) and d2, the square of their distance; _deal is one of DEALS groups of segments, by which a map of many is dealt out, to each with all its nodes."""
    tasks = 8 * nodes.sparkSession.sparkContext.defaultParallelism
    dx, dy = (F.col("bx") - F.col("ax")).cast("double"), (F.col("by") - F.col("ay")).cast("double")
    size = dx * dx + dy * dy
    # What depends on the segment alone is made before the join: in a condition on the pairs it would stand many times over, in code too long to be compiled.
    sized = segments.withColumns({"_dx": dx, "_dy": dy, "_size": F.when(size == 0, 1.0).otherwise(size), "_deal": F.pmod(F.hash("segment"), F.lit(DEALS)).cast("int")})
    own = nodes.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1)))).repartition(tasks, "_deal")
    both = sized.repartition(tasks, "_deal").join(own.hint("merge"), ["map_id", "_deal"])
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("x") - F.col("ax")) * F.col("_dx") + (F.col("y") - F.col("ay")) * F.col("_dy")) / F.col("_size")))
    qx, qy = F.col("ax") + t * F.col("_dx") - F.col("x"), F.col("ay") + t * F.col("_dy") - F.col("y")
    return both.withColumn("d2", qx * qx + qy * qy)


def clearances(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """(map_id, id, clearance): distance to the nearest segment. Rounded as the least: of every pair it took most of the time."""
    return _paired(nodes.select("map_id", "id", "x", "y"), segments).groupBy("map_id", "id").agg(F.round(F.sqrt(F.round(F.min("d2"), 6)), 6).alias("clearance"))


def _near_segments(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """(map_id, id, x, y, segment, d2, px, py): pairs of which every node has its SEGMENTS nearest, and few others.

    The nearest of each group of segments being different ones, the SEGMENTS-th of them is no nearer than the SEGMENTS-th of all; nodes with fewer such keep all."""
    own = nodes.select("map_id", "id", "x", "y")
    least = _paired(own, segments).groupBy("map_id", "id", "_deal").agg(F.min("d2").alias("d2"))
    most = least.groupBy("map_id", "id").agg(F.get(F.sort_array(F.collect_list("d2")), F.lit(SEGMENTS - 1)).alias("most"))
    # Rounding to 6 places may bring ties from below.
    near = _paired(own.join(most, ["map_id", "id"], "left"), segments).where("most IS NULL OR d2 <= most * (1 + 1e-12) + 1e-6")
    p = project(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")])
    return near.select("map_id", "id", "x", "y", "segment", F.round("d2", 6).alias("d2"), p["x"].alias("px"), p["y"].alias("py"))


def choke_sides(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """(map_id, id, s1x, s1y, s2x, s2y): the projection on the nearest segment; then, among the SEGMENTS nearest, the first by distance on the opposite side in both axes, else the last."""
    by = Window.partitionBy("map_id", "id").orderBy("d2", "segment")
    near = _near_segments(nodes, segments).withColumn("k", F.row_number().over(by)).where(F.col("k") <= SEGMENTS)
    ranked = near.withColumns({"s1x": F.first("px").over(by), "s1y": F.first("py").over(by)})
    opposite = (F.col("k") > 1) & ((F.col("px") - F.col("x")) * (F.col("s1x") - F.col("x")) <= 0) & ((F.col("py") - F.col("y")) * (F.col("s1y") - F.col("y")) <= 0)
    second = F.coalesce(F.min(F.when(opposite, F.struct("k", "px", "py"))), F.max(F.struct("k", "px", "py")))
    out = ranked.groupBy("map_id", "id").agg(F.first("s1x").alias("s1x"), F.first("s1y").alias("s1y"), second.alias("s"))
    return out.select("map_id", "id", "s1x", "s1y", F.col("s.px").alias("s2x"), F.col("s.py").alias("s2y"))


class Medial:
    """One map's graph: positions, clearances, neighbours and types."""

    def __init__(self, nodes: pd.DataFrame, edges: pd.DataFrame):
        self.at = {int(r.id): (int(r.x), int(r.y)) for r in nodes.itertuples()}
        self.clearance = {int(r.id): float(r.clearance) for r in nodes.itertuples()}
        self.near: dict[int, set[int]] = {i: set() for i in self.at}
        for a, b in zip(edges.a, edges.b, strict=True):
            if a in self.near and b in self.near and a != b:
                self.near[int(a)].add(int(b))
                self.near[int(b)].add(int(a))
        self.type = dict.fromkeys(self.at, NONE)

    def prune(self) -> None:
        """Leaves go if their clearance is small or not clearly over their neighbour's; a node left alone with enough is a region."""
        queue = deque(sorted(i for i in self.near if len(self.near[i]) == 1))
        alone = {i for i in self.near if not self.near[i]}
        while queue:
            i = queue.popleft()
            if len(self.near.get(i, ())) != 1:
                continue
            (parent,) = self.near[i]
            if self.clearance[i] < LEAST_REGION or self.clearance[i] - LEAF_SLACK <= self.clearance[parent]:
                self._drop(i)
                if len(self.near[parent]) == 1:
                    queue.append(parent)
                elif not self.near[parent]:
                    alone.add(parent)
        for i in alone & set(self.near):
            if self.clearance[i] > LEAST_REGION:
                self.type[i] = REGION
            else:
                self._drop(i)

    def _drop(self, i: int) -> None:
        for j in self.near.pop(i):
            self.near[j].discard(i)
        del self.at[i], self.clearance[i], self.type[i]

    def _apart(self, i: int, j: int) -> int:
        dx, dy = sorted((abs(self.at[i][0] - self.at[j][0]), abs(self.at[i][1] - self.at[j][1])))
        return dy + dx * 3 // 8

    def _differs(self, i: int, j: int) -> bool:
        a, b = self.clearance[i], self.clearance[j]
        return abs(a - b) > max(2.0, DIFFERENCE * max(a, b))

    def classify(self) -> None:
        """From the first leaf of every component (or its first node), depth first: every junction and end is a region; where two paths lead on, local minima are chokepoints and high local maxima regions, as far as they differ from, or lie apart from, the last one marked on the way, the anchor: its node, and whether it was marked as a region."""
        anchor: dict[int, tuple[int, bool] | None] = {}
        replaced: dict[int, int] = {}
        for root in sorted(self.near, key=lambda i: (len(self.near[i]) != 1, i)):
            if root in anchor:
                continue
            anchor[root] = None
            stack = [root]
            while stack:
                i = stack.pop()
                now = self._mark(i, anchor[i], replaced)
                for j in sorted(self.near[i]):
                    if j not in anchor:
                        anchor[j] = now
                        stack.append(j)
                    else:
                        self._settle(self._marked(i, anchor[i]), self._marked(j, anchor[j]), replaced)

    def _marked(self, i: int, anchor: tuple[int, bool] | None) -> int | None:
        return i if self.type[i] != NONE or anchor is None else anchor[0]

    def _mark(self, i: int, anchor: tuple[int, bool] | None, replaced: dict[int, int]) -> tuple[int, bool] | None:
        """Decides on one node, and gives the anchor of those after it."""
        c, around = self.clearance[i], [self.clearance[j] for j in self.near[i]]
        last, region = anchor or (None, True)
        if len(around) != 2:
            if last is not None and self.type[last] == CHOKE and self._apart(i, last) < NODE_DISTANCE:
                self.type[last] = NONE
            self.type[i] = REGION
            # A larger region stays the anchor.
            return (i, True) if last is None or self.type[last] == CHOKE or c > self.clearance[last] else anchor
        if c <= min(around):
            if not region:
                better = c < self.clearance[last]
                if better:
                    self.type[last] = NONE
                    replaced[i] = last
            else:
                gap = self._apart(i, last) if last is not None else 0
                better = last is None or self._differs(i, last) or (gap >= NODE_DISTANCE and gap > self.clearance[last])
            kind = CHOKE
        elif c >= max(around) and c >= LEAST_REGION:
            if not region:
                better = self._differs(i, last)
            else:
                better = last is None or c > self.clearance[last]
                if better and last is not None and len(self.near[last]) == 2:
                    self.type[last] = NONE
            kind = REGION
        else:
            return anchor
        if not better:
            return anchor
        self.type[i] = kind
        return i, kind == REGION

    def _settle(self, a: int | None, b: int | None, replaced: dict[int, int]) -> None:
        """Where two walked paths meet: a chokepoint too close to a region goes, and the one that it had replaced returns; of two chokepoints the wider goes."""
        if a is None or b is None or a == b:
            return
        regions = [self.type[x] == REGION for x in (a, b)]
        if regions[0] != regions[1]:
            if self._apart(a, b) < NODE_DISTANCE:
                gone = b if regions[0] else a
                self.type[gone] = NONE
                if gone in replaced:
                    self.type[replaced[gone]] = CHOKE
        elif not regions[0]:
            self.type[b if self.clearance[a] < self.clearance[b] else a] = NONE

    def contract(self) -> None:
        """Only regions and chokepoints stay, joined through chains of other nodes."""
        marked = [i for i in sorted(self.near) if self.type[i] != NONE]
        joined: dict[int, set[int]] = {i: set() for i in marked}
        for i in marked:
            stack, seen = list(self.near[i]), {i}
            while stack:
                j = stack.pop()
                if j in seen:
                    continue
                seen.add(j)
                if self.type[j] != NONE:
                    joined[i].add(j)
                    joined[j].add(i)
                else:
                    stack += self.near[j]
        self.near = joined
        for d in (self.at, self.clearance, self.type):
            for i in set(d) - set(joined):
                del d[i]

    def merge(self) -> None:
        """Adjacent regions become the one with the larger clearance (the least id among equals)."""
        while True:
            pair = min(((i, j) for i in self.near for j in self.near[i] if i < j and self.type[i] == self.type[j] == REGION), default=None)
            if pair is None:
                return
            keep, gone = pair if self.clearance[pair[0]] >= self.clearance[pair[1]] else pair[::-1]
            for j in self.near[gone] - {keep}:
                self.near[keep].add(j)
                self.near[j].add(keep)
            self._drop(gone)

    def frame(self, map_id: str) -> pd.DataFrame:
        rows = [(map_id, i, *self.at[i], self.clearance[i], self.type[i], sorted(self.near[i])) for i in sorted(self.near)]
        return pd.DataFrame(rows, columns=["map_id", "id", "x", "y", "clearance", "type", "neighbours"])


STEPS = ("prune", "classify", "contract", "merge")


def medial_graph(nodes: DataFrame, edges: DataFrame, steps: tuple[str, ...] = STEPS) -> DataFrame:
    """(map_id, id, x, y, clearance, type, neighbours) after the given steps."""

    def run(key, own: pd.DataFrame, joined: pd.DataFrame) -> pd.DataFrame:
        graph = Medial(own, joined)
        for step in steps:
            getattr(graph, step)()
        return graph.frame(key[0])

    return nodes.select("map_id", "id", "x", "y", "clearance").groupBy("map_id").cogroup(fresh(edges.select("map_id", "a", "b")).groupBy("map_id")).applyInPandas(run, "map_id string, id int, x int, y int, clearance double, type string, neighbours array<int>")


def merged_regions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(map_id, id, into): regions joined by region-region edges; each component is named by its node of largest clearance, then least id."""

    def run(key, own: pd.DataFrame, joined: pd.DataFrame) -> pd.DataFrame:
        root = {int(i): int(i) for i in own.id}

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for a, b in zip(joined.a, joined.b, strict=True):
            root[find(int(a))] = find(int(b))
        best: dict[int, tuple] = {}
        for i, c in zip(own.id, own.clearance, strict=True):
            r = find(int(i))
            best[r] = min(best.get(r, (math.inf, 0)), (-float(c), int(i)))
        return pd.DataFrame([(key[0], int(i), best[find(int(i))][1]) for i in own.id], columns=["map_id", "id", "into"])

    return nodes.select("map_id", "id", "clearance").groupBy("map_id").cogroup(fresh(edges.select("map_id", "a", "b")).groupBy("map_id")).applyInPandas(run, "map_id string, id int, into int")


def reachability(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(map_id, a, b): nodes of one component, each with itself too."""
    named = merged_regions(nodes.select("map_id", "id", (-F.col("id")).cast("double").alias("clearance")), edges)
    return named.select("map_id", F.col("id").alias("a"), "into").join(named.select("map_id", F.col("id").alias("b"), "into"), ["map_id", "into"]).select("map_id", "a", "b")


def region_labels(cells: DataFrame, walkable: str, chokes: DataFrame) -> DataFrame:
    """(map_id, x, y, label): components of the walkable cells more than half a cell from every choke line (s1x, s1y, s2x, s2y); cells on a line stay 0."""

    def run(key, pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=["map_id", "x", "y", "label"])
        free = dense(pdf, "_w", False).astype(bool)
        xs, ys = np.indices(free.shape)
        for r in own.itertuples():
            dx, dy = r.s2x - r.s1x, r.s2y - r.s1y
            t = np.clip(((xs - r.s1x) * dx + (ys - r.s1y) * dy) / max(1, dx * dx + dy * dy), 0, 1)
            free &= (xs - r.s1x - t * dx) ** 2 + (ys - r.s1y - t * dy) ** 2 > 0.25 + 1e-9
        return pdf[KEY].assign(label=k.components(free, eight=False)[pdf.x, pdf.y].astype("int32"))

    return cells.withColumn("_w", F.col(walkable)).select(*KEY, "_w").groupBy("map_id").cogroup(chokes.groupBy("map_id")).applyInPandas(run, "map_id string, x int, y int, label int")


def build_regions(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """(map_id, label, open_x, open_y, open_dist): region nodes with the label under them; of several in one label, that of largest clearance."""
    under = graph.where(F.col("type") == REGION).join(labels.where("label > 0"), KEY)
    best = under.groupBy("map_id", "label").agg(F.max(F.struct("clearance", -F.col("id"), "x", "y")).alias("b"))
    return best.select("map_id", "label", F.col("b.x").alias("open_x"), F.col("b.y").alias("open_y"), F.col("b.clearance").alias("open_dist"))


def build_chokepoints(graph: DataFrame, sides: DataFrame) -> DataFrame:
    """Chokepoints with their first two neighbours, centre and width; those with fewer than two are flagged and not usable."""
    c = graph.where(F.col("type") == CHOKE).join(sides, ["map_id", "id"])
    width = F.sqrt(((F.col("s1x") - F.col("s2x")) * (F.col("s1x") - F.col("s2x")) + (F.col("s1y") - F.col("s2y")) * (F.col("s1y") - F.col("s2y"))).cast("double"))
    middle = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2).cast("int")
    return c.select("map_id", "id", F.get("neighbours", F.lit(0)).alias("region_a"), F.get("neighbours", F.lit(1)).alias("region_b"), "s1x", "s1y", "s2x", "s2y", middle("s1x", "s2x").alias("cx"), middle("s1y", "s2y").alias("cy"), F.round(width, 6).alias("width"), (F.size("neighbours") >= 2).alias("usable"))


def region_chokes(chokes: DataFrame) -> DataFrame:
    """(map_id, region, chokes): ids of each region's chokepoints, sorted."""
    ends = chokes.select("map_id", "id", F.explode(F.array("region_a", "region_b")).alias("region")).where("region IS NOT NULL")
    return ends.groupBy("map_id", "region").agg(F.sort_array(F.collect_set("id")).alias("chokes"))


def region_adjacency(chokes: DataFrame) -> DataFrame:
    """(map_id, a, b): regions that share a chokepoint, both ways."""
    return symmetric(chokes.select("map_id", F.col("region_a").alias("a"), F.col("region_b").alias("b")).where("a != b"))


def _spiral(x: int, y: int, turns: int):
    """Cells of a square spiral, down first and then counter-clockwise on the screen (y grows downwards), whose sides have 1, 1, 2, 2, 3, 3 ... steps, up to sides of turns - 1."""
    dx, dy = 0, 1
    for side in range(1, turns):
        for _ in range(2):
            for _ in range(side):
                yield x, y
                x, y = x + dx, y + dy
            dx, dy = dy, -dx


def coverage_points(labels: DataFrame, opens: DataFrame, apart: int = 56) -> DataFrame:
    """(map_id, label, k, x, y): the open point, then, outwards in a square spiral, each cell of the region over `apart` (dx + dy) from all chosen ones. The spiral ends when its sides would be as long, in cells, as the longer side of the region's box."""

    def run(key, pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in own.itertuples():
            cells = pdf[pdf.label == r.label]
            inside = set(zip(cells.x.tolist(), cells.y.tolist(), strict=True))
            chosen = [(int(r.open_x), int(r.open_y))]
            longest = max(int(cells.x.max() - cells.x.min()), int(cells.y.max() - cells.y.min()))
            for x, y in _spiral(*chosen[0], longest // 2 * 2):
                if (x, y) in inside and all(abs(x - a) + abs(y - b) > apart for a, b in chosen):
                    chosen.append((x, y))
            rows += [(key[0], int(r.label), i, x, y) for i, (x, y) in enumerate(chosen)]
        return pd.DataFrame(rows, columns=["map_id", "label", "k", "x", "y"])

    return labels.where("label > 0").groupBy("map_id").cogroup(fresh(opens).groupBy("map_id")).applyInPandas(run, "map_id string, label int, k int, x int, y int")


def largest_first_colours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(map_id, id, colour): recursive largest first: each colour starts at the node of most uncoloured neighbours and takes, among those not adjacent to it, the one with most neighbours adjacent to the colour."""

    def run(key, own: pd.DataFrame, joined: pd.DataFrame) -> pd.DataFrame:
        near = {int(i): set() for i in own.id}
        for a, b in zip(joined.a, joined.b, strict=True):
            near[int(a)].add(int(b))
            near[int(b)].add(int(a))
        colour, left, c = {}, set(near), 0
        while left:
            first = min(left, key=lambda i: (-len(near[i] & left), i))
            group, barred, free = {first}, near[first] & left, left - near[first] - {first}
            while free:
                following = min(free, key=lambda i: (-len(near[i] & barred), len(near[i] & free), i))
                group.add(following)
                barred |= near[following] & left
                free -= near[following] | {following}
            colour |= dict.fromkeys(group, c)
            left -= group
            c += 1
        return pd.DataFrame([(key[0], i, v) for i, v in sorted(colour.items())], columns=["map_id", "id", "colour"])

    return nodes.select("map_id", "id").groupBy("map_id").cogroup(fresh(edges.select("map_id", "a", "b")).groupBy("map_id")).applyInPandas(run, "map_id string, id int, colour int")


def relaxed_hues(nodes: DataFrame, edges: DataFrame, sweeps: int = 6, strength: float = 0.05) -> DataFrame:
    """(map_id, id, hue): hues from a hash of the id; in each sweep every node moves away from its neighbours' hues on the circle."""

    def run(key, own: pd.DataFrame, joined: pd.DataFrame) -> pd.DataFrame:
        hue = {int(i): (int(i) * 0.6180339887498949) % 1 for i in sorted(own.id)}
        near: dict[int, list[int]] = {i: [] for i in hue}
        for a, b in sorted(zip(joined.a, joined.b, strict=True)):
            near[int(a)].append(int(b))
            near[int(b)].append(int(a))
        for _ in range(sweeps):
            for i, others in near.items():
                for j in others:
                    gap = (hue[i] - hue[j] + 0.5) % 1 - 0.5
                    hue[i] = (hue[i] + strength * (math.copysign(0.5, gap) - gap)) % 1
        return pd.DataFrame([(key[0], i, round(h, 9)) for i, h in hue.items()], columns=["map_id", "id", "hue"])

    return nodes.select("map_id", "id").groupBy("map_id").cogroup(fresh(edges.select("map_id", "a", "b")).groupBy("map_id")).applyInPandas(run, "map_id string, id int, hue double")
