"""Distances and predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def approx_dist(dx: Column, dy: Column) -> Column:
    """An integer estimate of the length of (dx, dy): the larger part plus three eighths of the smaller, rounded down. One definition for all thresholds."""
    a, b = F.abs(dx), F.abs(dy)
    return F.greatest(a, b) + F.floor(F.least(a, b) * 3 / 8).cast("int")


def euclid(dx: Column, dy: Column) -> Column:
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def clearly_different(a: Column, b: Column) -> Column:
    """Two clearances differ by more than 2 and more than 31 % of the larger."""
    return F.abs(a - b) > F.greatest(F.lit(2.0), 0.31 * F.greatest(a, b))


def far_enough(dx: Column, dy: Column, clearance: Column, parent: Column) -> Column:
    """A node of its own: at least 7 from its parent, and with more clearance."""
    return (approx_dist(dx, dy) >= 7) & (clearance > parent)


def project(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The nearest point of segment ab to p, clamped to its ends and truncated to integers, as a struct x, y."""
    dx, dy = (bx - ax).cast("double"), (by - ay).cast("double")
    size = dx * dx + dy * dy
    t = F.when(size == 0, 0.0).otherwise(((px - ax) * dx + (py - ay) * dy) / F.when(size == 0, 1.0).otherwise(size))
    x = F.when(t > 1, bx).when(t > 0, (ax + t * dx).cast("int")).otherwise(ax)
    y = F.when(t > 1, by).when(t > 0, (ay + t * dy).cast("int")).otherwise(ay)
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))


def midpoint(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.struct(((ax + bx) / 2).cast("int").alias("x"), ((ay + by) / 2).cast("int").alias("y"))


def extended(ax: Column, ay: Column, bx: Column, by: Column, factor: float = 1.1) -> Column:
    """Segment ab stretched about its middle, truncated: a struct x1, y1, x2, y2."""
    cx, cy = (ax + bx) / 2, (ay + by) / 2
    end = lambda c, v: (c + (v - c) * factor).cast("int")
    return F.struct(end(cx, ax).alias("x1"), end(cy, ay).alias("y1"), end(cx, bx).alias("x2"), end(cy, by).alias("y2"))
