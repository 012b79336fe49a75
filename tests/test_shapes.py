"""Predicates, thinning and holes against plain Python."""

import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from lapgrid import fixtures
from lapgrid.functions import geo, predicates
from lapgrid.operators import grid, outlines
from lapgrid.plans.grid_queries import N, filled


def _clip(poly, axis, bound, keep):
    """Sutherland-Hodgman against one half plane, in exact numbers."""
    out = []
    for p, q in zip(poly, poly[1:] + poly[:1], strict=True):
        a, b = keep * (p[axis] - bound), keep * (q[axis] - bound)
        if a >= 0:
            out.append(p)
        if (a > 0 > b) or (a < 0 < b):
            t = Fraction(a) / Fraction(a - b)
            out.append(tuple(p[k] + t * (q[k] - p[k]) for k in (0, 1)))
    return out


def _rect_meets(rect, shape):
    for axis, bound, keep in ((0, rect[0], 1), (1, rect[1], 1), (0, rect[2], -1), (1, rect[3], -1)):
        shape = _clip(shape, axis, bound, keep) if shape else shape
    return bool(shape)


def _cross_point(a, b, c, d):
    """Exact parametric test of two segments."""
    r, s, w = (b[0] - a[0], b[1] - a[1]), (d[0] - c[0], d[1] - c[1]), (c[0] - a[0], c[1] - a[1])
    x = lambda p, q: p[0] * q[1] - p[1] * q[0]
    if x(r, s):
        return 0 <= Fraction(x(w, s), x(r, s)) <= 1 and 0 <= Fraction(x(w, r), x(r, s)) <= 1
    if x(w, r) or x(w, s):
        return False
    return all(max(min(a[k], b[k]), min(c[k], d[k])) <= min(max(a[k], b[k]), max(c[k], d[k])) for k in (0, 1))


def test_convex_predicates_brute_force(spark):
    rng = random.Random(3)
    n = lambda: rng.randint(0, 6)
    rows = [(i, *[n() for _ in range(6)], *sorted((n(), n())), *sorted((n(), n()))) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, ax int, ay int, bx int, by int, cx int, cy int, x0 int, x1 int, y0 int, y1 int")
    a, b, c = ((F.col(f"{k}x"), F.col(f"{k}y")) for k in "abc")
    r = [F.col(k) for k in ("x0", "y0", "x1", "y1")]
    out = df.select("i", predicates.segments_intersect(a, b, c, (r[0], r[1])).alias("s"), predicates.rect_intersects_triangle(r, a, b, c).alias("t"), predicates.point_in_triangle((r[0], r[1]), a, b, c).alias("p"))
    for g in out.collect():
        _, ax, ay, bx, by, cx, cy, x0, x1, y0, y1 = rows[g["i"]]
        tri = [(ax, ay), (bx, by), (cx, cy)]
        assert g["s"] == _cross_point(tri[0], tri[1], tri[2], (x0, y0)), rows[g["i"]]
        assert g["t"] == _rect_meets((x0, y0, x1, y1), tri), rows[g["i"]]
        assert g["p"] == _rect_meets((x0, y0, x0, y0), tri), rows[g["i"]]


def test_touch_tolerance(spark):
    near = spark.createDataFrame([(1.0 + 5e-10,), (1.0 + 5e-9,)], "x double")
    one = [F.lit(v) for v in (0.0, 0.0, 1.0, 1.0)]
    got = near.select(predicates.point_in_rect(F.col("x"), F.lit(0.5), one).alias("r"), predicates.rect_intersects_triangle(one, (F.col("x"), F.lit(0.0)), (F.col("x") + 1, F.lit(0.0)), (F.col("x") + 1, F.lit(1.0))).alias("t")).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False)]


def test_bilinear_inverse_of_any_quad(spark):
    """Forward in plain Python, back by the operator; parallel sides, a trapezium, a parallelogram and a skew one."""
    quads = [((0, 0), (4, 0), (0, 3), (4, 3)), ((0, 0), (6, 0), (1, 3), (4, 3)), ((0, 0), (4, 1), (1, 3), (5, 4)), ((0, 0), (5, 1), (-1, 4), (6, 6)), ((1e6, 2e6), (1e6 + 9, 2e6 + 1), (1e6 - 1, 2e6 - 8), (1e6 + 7, 2e6 - 9))]
    rng = random.Random(4)
    rows = []
    for q in quads:
        for u, v in [(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), *[(rng.random(), rng.random()) for _ in range(20)]]:
            x, y = (sum(w * p[k] for w, p in zip(((1 - u) * (1 - v), u * (1 - v), (1 - u) * v, u * v), q, strict=True)) for k in (0, 1))
            rows.append((u, v, x, y, *[float(c) for p in q for c in p]))
    df = spark.createDataFrame(rows, "u double, v double, x double, y double, " + ", ".join(f"{c}{k} double" for c in ("tl", "tr", "bl", "br") for k in (0, 1)))
    back = geo.bilinear_inverse(F.col("x"), F.col("y"), *[[F.col(f"{c}0"), F.col(f"{c}1")] for c in ("tl", "tr", "bl", "br")])
    for r in df.select("u", "v", back.alias("b")).collect():
        assert abs(r["b"]["x"] - r["u"]) < 1e-6 and abs(r["b"]["y"] - r["v"]) < 1e-6


def thinned(on):
    """Two sub-rounds over all pixels at once, until nothing goes."""
    ring = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]
    while True:
        before = set(on)
        for first in (True, False):
            gone = set()
            for x, y in on:
                b = [(x + a, y + c) in on for a, c in ring]
                n, e, s, w = b[0], b[2], b[4], b[6]
                turns = sum(not b[i] and b[(i + 1) % 8] for i in range(8))
                free = not (n and e and s) and not (e and s and w) if first else not (n and e and w) and not (n and s and w)
                if 2 <= sum(b) <= 6 and turns == 1 and free:
                    gone.add((x, y))
            on = on - gone
        if on == before:
            return on


def test_skeleton_brute_force(spark, sf):
    px = filled(fixtures.view(spark, sf, "rects"), 5).select("x", "y")
    on = {(r["x"], r["y"]) for r in px.collect()}
    got = {(r["x"], r["y"]) for r in grid.thin(px).collect()}
    assert got == thinned(on) and 0 < len(got) < len(on)


def test_interior_holes_brute_force(spark, sf):
    px = filled(fixtures.view(spark, sf, "rects")).select("x", "y").union(spark.sql("SELECT explode(sequence(10L, 20L)) AS x, 10L AS y UNION ALL SELECT explode(array(10L, 20L)), y FROM (SELECT explode(sequence(10L, 16L)) AS y) UNION ALL SELECT explode(sequence(10L, 20L)), 16L"))
    on = {(r["x"], r["y"]) for r in px.collect()}
    free, holes = {(x, y) for x in range(N) for y in range(N)} - on, []
    while free:
        todo, region = [free.pop()], set()
        while todo:
            x, y = todo.pop()
            region.add((x, y))
            for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if p in free:
                    free.remove(p)
                    todo.append(p)
        if len(region) >= 3 and all(0 < x < N - 1 and 0 < y < N - 1 for x, y in region):
            holes.append(region)
    got = {}
    for r in grid.interior_holes(px, N, N, 3).collect():
        got.setdefault(r["comp"], set()).add((r["x"], r["y"]))
    assert holes and sorted(map(sorted, got.values())) == sorted(map(sorted, holes))


def _far(p, a, b):
    ux, uy, vx, vy = b[0] - a[0], b[1] - a[1], p[0] - a[0], p[1] - a[1]
    n = math.hypot(ux, uy)
    return abs(ux * vy - uy * vx) / n if n else math.hypot(vx, vy)


def simplified(ring, share):
    """Recursive Douglas-Peucker of a closed ring cut at its first point and the one farthest from it."""
    pts = ring + ring[:1]
    eps = max(share * sum(math.dist(a, b) for a, b in zip(pts, pts[1:], strict=False)), 1.0)
    cut = max(range(len(pts)), key=lambda i: (math.dist(pts[i], pts[0]) ** 2, -i))

    def between(a, b):
        if b - a < 2:
            return set()
        i = max(range(a + 1, b), key=lambda i: (_far(pts[i], pts[a], pts[b]), -i))
        return {i} | between(a, i) | between(i, b) if _far(pts[i], pts[a], pts[b]) > eps else set()

    return {0, cut} | between(0, cut) | between(cut, len(ring))


def test_simplify_brute_force(spark):
    rng = random.Random(9)
    made = {k: [(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(rng.choice((3, 8, 40)))] for k in range(30)}
    df = spark.createDataFrame([(k, i, x, y) for k, ring in made.items() for i, (x, y) in enumerate(ring)], "ring_id long, ord long, x long, y long")
    for share in (0.0, 0.02):
        got = {}
        for r in outlines.simplify(df, share).collect():
            got.setdefault(r["ring_id"], set()).add(r["ord"])
        assert got == {k: simplified(ring, share) for k, ring in made.items()}


def test_rings_close_and_enclose(spark):
    """A square with a hole, a single pixel touching it by a corner, and a comb: each ring's steps are unit steps and areas add up to the pixels."""
    on = {(x, y) for x in range(5, 12) for y in range(5, 12)} - {(8, 8), (8, 9)} | {(12, 12)} | {(x, 30) for x in range(20)} | {(x, y) for x in range(0, 20, 2) for y in range(31, 40)}
    ring = outlines.rings(spark.createDataFrame(sorted(on), "x long, y long"))
    by = {}
    for r in ring.orderBy("ring_id", "ord").collect():
        by.setdefault(r["ring_id"], []).append((r["ord"], r["x"], r["y"]))
    for pts in by.values():
        assert [p[0] for p in pts] == list(range(len(pts)))
        assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(pts, pts[1:] + pts[:1], strict=True))
    kinds = outlines.ring_kinds(ring).collect()
    assert sum(r["area"] for r in kinds) == len(on) and sorted(r["area"] for r in kinds if not r["outer"]) == [-2.0] and len(kinds) == 4
