"""Spatial predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bbox_overlap(a: list[Column], b: list[Column]) -> Column:
    """Boxes (x0, y0, x1, y1); touching counts; a null box overlaps everything."""
    hit = (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])
    return F.coalesce(hit, F.lit(True))


def tile_aabb(box: Column, axes: str) -> Column:
    """(min_x, max_x, min_z, max_z) of a 12-number box on the XY, XnY, XZ or XnZ plane; null if short or all zero."""
    half = lambda k: F.abs(box[3 + k]) + F.abs(box[6 + k]) + F.abs(box[9 + k])
    k = 1 if axes.endswith("Y") else 2
    sign = -1 if "n" in axes else 1
    cx, cz = box[0], sign * box[k]
    out = F.struct((cx - half(0)).alias("min_x"), (cx + half(0)).alias("max_x"), (cz - half(k)).alias("min_z"), (cz + half(k)).alias("max_z"))
    return F.when((F.size(box) >= 12) & F.exists(box, lambda v: v != 0), out)


def point_in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule over an array of points x, y; edges flatter than 1e-12 are left out."""
    n = F.size(ring)

    def crosses(p: Column, i: Column) -> Column:
        q = F.element_at(ring, (i + 1) % n + 1)
        at = p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / (q["y"] - p["y"])
        return F.when((F.abs(q["y"] - p["y"]) > 1e-12) & ((p["y"] > y) != (q["y"] > y)) & (x < at), 1).otherwise(0)

    return (n >= 3) & (F.aggregate(F.transform(ring, crosses), F.lit(0), lambda a, b: a + b) % 2 == 1)


def point_in_obb(x: Column, y: Column, z: Column, box: Column) -> Column:
    """In an oriented box (centre and three half axes): all coordinates in the axes within 1 + 1e-6; a flat box holds nothing."""
    d = [x - box[0], y - box[1], z - box[2]]
    ax = [[box[3 + 3 * a + k] for k in range(3)] for a in range(3)]
    det3 = lambda u, v, w: u[0] * (v[1] * w[2] - v[2] * w[1]) - u[1] * (v[0] * w[2] - v[2] * w[0]) + u[2] * (v[0] * w[1] - v[1] * w[0])
    det = det3(*ax)
    inside = [F.abs(det3(*[d if j == a else ax[j] for j in range(3)]) / det) <= 1 + 1e-6 for a in range(3)]
    return F.when(F.abs(det) < 1e-15, False).otherwise(inside[0] & inside[1] & inside[2])


#: How far apart on an axis two shapes may lie and still touch; a fixed value.
TOUCH = 1e-9


def _least(values: list[Column]) -> Column:
    return F.least(*values) if len(values) > 1 else values[0]


def _greatest(values: list[Column]) -> Column:
    return F.greatest(*values) if len(values) > 1 else values[0]


def _normals(points: list, closed: bool = True) -> list:
    """The normal of each side of a polygon."""
    ends = [*points[1:], points[0]] if closed else points[1:]
    return [(p[1] - q[1], q[0] - p[0]) for p, q in zip(points, ends, strict=False)]


def convex_overlap(p: list, q: list, eps: float = TOUCH) -> Column:
    """Whether two convex shapes, each a list of corners (x, y), share a point; touching counts.

    By separating axes: they do unless their shadows on the normal of a side, or on the x or y axis, lie apart.
    A point or a segment is a shape like others; the two axes decide where sides are parallel or have no length.
    """
    out = F.lit(True)
    sides = [n for shape in (p, q) if len(shape) > 1 for n in _normals(shape, len(shape) > 2)]
    for ax, ay in [(F.lit(1), F.lit(0)), (F.lit(0), F.lit(1)), *sides]:
        u, v = ([ax * x + ay * y for x, y in shape] for shape in (p, q))
        out = out & (_least(u) <= _greatest(v) + eps) & (_least(v) <= _greatest(u) + eps)
    return out


def segments_intersect(a, b, c, d, eps: float = TOUCH) -> Column:
    """Segments a-b and c-d, each end (x, y); touching counts."""
    return convex_overlap([a, b], [c, d], eps)


def point_in_rect(x, y, r, eps: float = TOUCH) -> Column:
    return x.between(r[0] - eps, r[2] + eps) & y.between(r[1] - eps, r[3] + eps)


def point_in_triangle(p, a, b, c, eps: float = TOUCH) -> Column:
    """The border counts."""
    return convex_overlap([p], [a, b, c], eps)


def rect_intersects_triangle(r, a, b, c, eps: float = TOUCH) -> Column:
    """The box (x0, y0, x1, y1) and the triangle share a point."""
    return convex_overlap([(r[0], r[1]), (r[2], r[1]), (r[2], r[3]), (r[0], r[3])], [a, b, c], eps)
