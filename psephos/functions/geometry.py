"""Boxes, bands and rectangles, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(y1: Column, y2: Column, y: Column, h: Column) -> Column:
    """Part of a box's height that lies in the band [y1, y2)."""
    return F.greatest(F.lit(0), F.least(y2, y + h) - F.greatest(y1, y)) / (h + F.lit(1e-6))


def area_fraction(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    return (x1 - x0) * (y1 - y0) / (width * height + F.lit(1e-9))


def circularity(area: Column, perimeter: Column) -> Column:
    return F.when(perimeter > 0, 4 * F.pi() * area / (perimeter * perimeter)).otherwise(0.0)


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def visible(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """The part of a rectangle inside the page, null where there is none."""
    x0, y0 = F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0))
    x1, y1 = F.least(x + w, width), F.least(y + h, height)
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")))


def to_label(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Centre and size as fractions of the page, clamped to it."""
    unit = lambda c: clamp(c, F.lit(0.0), F.lit(1.0))
    return F.struct(unit((x + w / 2) / width).alias("cx"), unit((y + h / 2) / height).alias("cy"), unit(w / width).alias("w"), unit(h / height).alias("h"))


def quad_order(points: Column) -> Column:
    """Corners of a quad (array of x, y) as top left, top right, bottom right, bottom left."""
    by = lambda key: F.array_min(F.transform(points, lambda p: F.struct(key(p).alias("k"), p.x.alias("x"), p.y.alias("y"))))
    corners = (by(lambda p: p.x + p.y), by(lambda p: p.y - p.x), by(lambda p: -(p.x + p.y)), by(lambda p: p.x - p.y))
    return F.array(*[F.struct(c.x.alias("x"), c.y.alias("y")) for c in corners])


def corner_cosine(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Cosine of the angle at b."""
    dot = (ax - bx) * (cx - bx) + (ay - by) * (cy - by)
    size = F.sqrt(((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) * ((cx - bx) * (cx - bx) + (cy - by) * (cy - by)))
    return dot / (size + F.lit(1e-9))
