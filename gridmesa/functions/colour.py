"""Colours of regions and heat maps as column expressions, each channel 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _rgb(r: Column, g: Column, b: Column) -> Column:
    channel = lambda c: F.floor(c * 255 + 0.5).cast("int")
    return F.struct(channel(r).alias("r"), channel(g).alias("g"), channel(b).alias("b"))


def hsl_to_rgb(h: Column, s: Column, l: Column) -> Column:
    """The standard conversion by six sextants; h, s, l from 0 to 1."""
    chroma = (1 - F.abs(2 * l - 1)) * s
    sextant = (h - F.floor(h)) * 6
    second = chroma * (1 - F.abs(sextant - 2 * F.floor(sextant / 2) - 1))
    base = l - chroma / 2
    k = F.floor(sextant)
    order = [(0, 1, 2), (1, 0, 2), (2, 0, 1), (2, 1, 0), (1, 2, 0), (0, 2, 1)]  # place of red, green, blue among chroma, second, 0
    part = [chroma, second, F.lit(0.0)]

    def channel(i: int) -> Column:
        value = part[order[5][i]]
        for j in range(5):
            value = F.when(k == j, part[order[j][i]]).otherwise(value)
        return value + base

    return _rgb(channel(0), channel(1), channel(2))


#: Stops of the heat ramp: red, yellow, green.
HEAT = ((1.0, 0.0, 0.0), (1.0, 1.0, 0.0), (0.0, 1.0, 0.0))


def heat(value: Column, low: Column, high: Column) -> Column:
    """A ramp over three stops, clamped to its ends."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low))) * 2
    ramp = [F.when(t <= 1, a + (b - a) * t).otherwise(b + (c - b) * (t - 1)) for a, b, c in zip(*HEAT, strict=True)]
    return _rgb(*ramp)


PALETTE = ("#e6194b", "#3cb44b", "#ffe119", "#4363d8", "#f58231", "#911eb4", "#46f0f0", "#f032e6")
NO_OBJECT = "#808080"


def palette(index: Column, colours: tuple[str, ...] = PALETTE) -> Column:
    """A colour by the index modulo the palette's size; grey for null."""
    return F.coalesce(F.get(F.array(*[F.lit(c) for c in colours]), F.pmod(index, F.lit(len(colours))).cast("int")), F.lit(NO_OBJECT))
