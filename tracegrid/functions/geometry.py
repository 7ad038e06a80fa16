"""Plane geometry on columns. Boxes are (x, y, width, height); segments are two points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]
Point = tuple[Column, Column]


def _zero() -> Column:
    return F.lit(0.0)


def box_of(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}").cast("double") for c in ("bx", "by", "bw", "bh"))


def distance2(a: Point, b: Point) -> Column:
    return (a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1])


def distance(a: Point, b: Point) -> Column:
    return F.sqrt(distance2(a, b))


def midpoint(a: Point, b: Point) -> Point:
    return (a[0] + b[0]) / 2, (a[1] + b[1]) / 2


def is_horizontal(a: Point, b: Point, tolerance: float = 0.5) -> Column:
    return F.abs(a[1] - b[1]) <= tolerance


def is_vertical(a: Point, b: Point, tolerance: float = 0.5) -> Column:
    return F.abs(a[0] - b[0]) <= tolerance


def point_box2(p: Point, box: Box) -> Column:
    """Squared distance of a point to a box, 0 inside."""
    x, y, w, h = box
    dx = F.greatest(x - p[0], p[0] - (x + w), _zero())
    dy = F.greatest(y - p[1], p[1] - (y + h), _zero())
    return dx * dx + dy * dy


def inside(p: Point, box: Box) -> Column:
    x, y, w, h = box
    return (p[0] >= x) & (p[0] <= x + w) & (p[1] >= y) & (p[1] <= y + h)


def strictly_inside(p: Point, box: Box) -> Column:
    x, y, w, h = box
    return (p[0] > x) & (p[0] < x + w) & (p[1] > y) & (p[1] < y + h)


def box_gap2(a: Box, b: Box) -> Column:
    """Squared distance of two boxes, 0 if they meet."""
    dx = F.greatest(a[0] - (b[0] + b[2]), b[0] - (a[0] + a[2]), _zero())
    dy = F.greatest(a[1] - (b[1] + b[3]), b[1] - (a[1] + a[3]), _zero())
    return dx * dx + dy * dy


def point_segment2(p: Point, a: Point, b: Point) -> Column:
    """Squared distance of a point to a segment."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    length2 = dx * dx + dy * dy
    t = F.when(length2 == 0, 0.0).otherwise(F.greatest(_zero(), F.least(F.lit(1.0), ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / F.nullif(length2, F.lit(0.0)))))
    return distance2(p, (a[0] + t * dx, a[1] + t * dy))


def corners(box: Box) -> list[Point]:
    x, y, w, h = box
    return [(x, y), (x + w, y), (x, y + h), (x + w, y + h)]


def segment_box2(a: Point, b: Point, box: Box, samples: int = 7) -> Column:
    """Squared distance of a segment to a box by samples: both ends and the midpoint to the box (3), and the
    box's corners to the segment as well (7)."""
    to_box = [point_box2(p, box) for p in (a, b, midpoint(a, b))]
    return F.least(*to_box, *([point_segment2(c, a, b) for c in corners(box)] if samples == 7 else []))


def clip(a: Point, b: Point, box: Box) -> tuple[Column, Column]:
    """Entry and exit of a segment in a box as shares of its length; entry > exit if it misses (Liang and Barsky)."""
    x, y, w, h = box
    enter, leave = [_zero()], [F.lit(1.0)]
    for d, lo, hi in ((b[0] - a[0], x - a[0], x + w - a[0]), (b[1] - a[1], y - a[1], y + h - a[1])):
        step = F.nullif(d, F.lit(0.0))
        outside = (lo > 0) | (hi < 0)
        enter.append(F.when(d == 0, F.when(outside, 2.0).otherwise(0.0)).when(d > 0, lo / step).otherwise(hi / step))
        leave.append(F.when(d == 0, F.when(outside, -1.0).otherwise(1.0)).when(d > 0, hi / step).otherwise(lo / step))
    return F.greatest(*enter), F.least(*leave)


def overlap_fraction(a: Point, b: Point, box: Box) -> Column:
    """The share of a segment that lies in a box."""
    enter, leave = clip(a, b, box)
    return F.greatest(_zero(), leave - enter)


def cosine(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Cosine of the angle of two directions, null if one has no length."""
    return (ax * bx + ay * by) / F.nullif(F.sqrt((ax * ax + ay * ay) * (bx * bx + by * by)), F.lit(0.0))
