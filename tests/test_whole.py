"""Queries that take the whole table: against brute force and against what a cut of the input would leave out."""

import random

from lapgrid import catalog, fixtures
from lapgrid.operators import mesh, spatial


def _inside(p, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > p[1]) != (by > p[1]) and p[0] < ax + (p[1] - ay) * (bx - ax) / (by - ay):
            odd = not odd
    return odd


def test_points_in_rings_brute_force(spark):
    comb = [(0, 0), (90, 0), (90, 50), (70, 50), (70, 10), (50, 10), (50, 50), (30, 50), (30, 10), (10, 10), (10, 50), (0, 50)]
    rings = {7: comb, 61: [(-40, -40), (35, -25), (120, 60), (-10, 45)], 2000: [(5, 5), (5, 6), (6, 6)]}
    points = [(i, x, y) for i, (x, y) in enumerate((x, y) for x in range(-45, 125, 7) for y in range(-45, 65, 6))]
    r = spark.createDataFrame([(k, v, x, y) for k, ring in rings.items() for v, (x, y) in enumerate(ring)], "ring_id long, v int, x long, y long")
    p = spark.createDataFrame(points, "point_id long, x long, y long")
    want = {(i, k) for i, x, y in points for k, ring in rings.items() if _inside((x, y), ring)}
    for cell in (4, 16, 256):
        got = [tuple(t) for t in spatial.points_in_rings(p, spatial.ring_edges(r, "ring_id", "v"), "ring_id", cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_every_ring_meets_points(spark, sf):
    rings, points = {}, [(r["point_id"], r["x"], r["y"]) for r in fixtures.view(spark, sf, "centers").collect()]
    for r in fixtures.view(spark, sf, "rings").orderBy("ring_id", "v").collect():
        rings.setdefault(r["ring_id"], []).append((r["x"], r["y"]))
    want = {(i, k) for k, ring in rings.items() for i, x, y in points if _inside((x, y), ring)}
    assert {k for _, k in want if k >= 60}
    assert {tuple(t) for t in catalog.QUERIES["j3_points_in_all_polygons"](spark, sf).collect()} == want
    hole = {i for i, k in want if k % 2}
    assert {t[0] for t in catalog.QUERIES["f4_inside_any_outer_not_hole"](spark, sf).collect()} == {i for i, k in want if k % 2 == 0} - hole


def _d2(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = min(max(((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n, 0.0), 1.0) if n else 0.0
    return (p[0] - a[0] - t * dx) ** 2 + (p[1] - a[1] - t * dy) ** 2


def _nearest(points, edges, key="layout"):
    return {p["point_id"]: min(_d2((p["x"], p["y"]), (e["ax"], e["ay"]), (e["bx"], e["by"])) for e in edges if e[key] == p[key]) for p in points}


def test_nearest_edge_brute_force(spark):
    rnd = random.Random(5)
    at = lambda: rnd.choice([rnd.randint(-3, 3) * 8, rnd.randint(-90, 90), rnd.randint(300, 330)])
    edges = [(k % 2, float(x), float(y), float(x + dx), float(y + dy)) for k in range(24) for x, y in [(at(), at())] for dx, dy in [rnd.choice([(0, 0), (0, 40), (-24, 0), (-16, 16), (75, -33)])]]
    points = [(i, i % 2, float(at()), float(at())) for i in range(150)] + [(150, 1, 5000.0, -4000.0), (151, 9, 0.0, 0.0)]
    e = spark.createDataFrame(edges, "layout long, ax double, ay double, bx double, by double")
    p = spark.createDataFrame(points, "point_id long, layout long, x double, y double")
    want = _nearest([r for r in p.collect() if r["layout"] != 9], e.collect())
    got = spatial.nearest_edge(p, e, "layout", 8).collect()
    assert len(got) == len(want) and all(abs(r["d2"] - want[r["point_id"]]) <= 1e-6 * max(1.0, want[r["point_id"]]) for r in got)


def test_nearest_edge_of_the_whole_track(spark, sf):
    lines = {}
    for r in fixtures.view(spark, sf, "track").orderBy("layout", "idx").collect():
        lines.setdefault(r["layout"], []).append((r["x"], r["y"]))
    edges = [{"layout": k, "ax": a[0], "ay": a[1], "bx": b[0], "by": b[1]} for k, v in lines.items() for a, b in zip(v, v[1:] + v[:1], strict=True)]
    points = [{"point_id": r["point_id"], "layout": r["point_id"] % 4, "x": r["x"] % 2000, "y": r["y"] % 1500} for r in fixtures.view(spark, sf, "centers").collect()]
    want, got = _nearest(points, edges), catalog.QUERIES["j19_nearest_edge_of_all"](spark, sf).collect()
    assert len(got) == len(want) and all(abs(r["d2"] - want[r["point_id"]]) <= 1e-3 for r in got)


def test_every_ring_is_filled(spark, sf):
    rings = {}
    for r in fixtures.view(spark, sf, "rings").orderBy("ring_id", "v").collect():
        rings.setdefault(r["ring_id"], []).append((r["x"] // 16, r["y"] // 16))
    below = {k for k, v in rings.items() if min(map(min, v)) < 0}
    runs = {}
    for k, y, x0, x1 in catalog.QUERIES["r1_fill_all_polygons"](spark, sf).collect():
        runs.setdefault(k, set()).update((x, y) for x in range(x0, x1 + 1))
    assert below and set(runs) == set(rings)
    for k in sorted(below)[:15] + sorted(set(rings) - below)[:5]:
        xs, ys = zip(*rings[k], strict=True)
        box = [(x, y) for x in range(min(xs) - 1, max(xs) + 2) for y in range(min(ys) - 1, max(ys) + 2)]
        assert runs[k] == {(x, y) for x, y in box if _inside((x + 0.5, y + 0.5), rings[k])}


def test_every_gate_is_paired(spark, sf):
    sides = {}
    for r in fixtures.view(spark, sf, "objects").where("type LIKE 'timing%'").collect():
        sides.setdefault(r["object_id"] // 4, set()).add(r["type"])
    got = {n: (left, right) for n, left, right in catalog.QUERIES["j21_gate_pairs_of_all"](spark, sf).collect()}
    assert got == {n: ("timing_left" in s, "timing_right" in s) for n, s in sides.items()}
    assert len(set(got.values())) == 3


def _split(items, limit, most, piece=""):
    if len(items) <= limit or not most:
        return {i: (piece, len(items) > limit) for i, _, _ in items}
    xs, ys = [x for _, x, _ in items], [y for _, _, y in items]
    axis = 1 if max(xs) - min(xs) >= max(ys) - min(ys) else 2
    items, half = sorted(items, key=lambda t: (t[axis], t[0])), len(items) // 2
    return _split(items[:half], limit, most - 1, piece + "0") | _split(items[half:], limit, most - 1, piece + "1")


def test_median_split_brute_force(spark):
    rnd = random.Random(3)
    items = [(i * 7 - 300, rnd.choice([5, 5, 5, rnd.randint(-50, 50)]), rnd.choice([-2, rnd.randint(0, 9)])) for i in range(400)]
    df = spark.createDataFrame(items, "item_id long, x long, y long")
    for limit, most in ((30, 10), (10, 3)):
        got = {i: (p, t) for i, p, t in mesh.median_split(df, limit, most, near=4, parts=3).collect()}
        assert got == _split(items, limit, most) and any(t for _, t in got.values()) == (most == 3)


def test_pieces_are_within_the_limit(spark, sf):
    got = catalog.QUERIES["m4_median_split_to_limit"](spark, sf)
    assert got.count() == fixtures.view(spark, sf, "rects").count()
    assert not got.where("too_large").count() and max(r["count"] for r in got.groupBy("piece").count().collect()) <= 20


def test_pick_box_meets_in_cells(spark):
    rnd = random.Random(8)
    boxes = [(i, i % 2, x, y, x + rnd.randint(1, 50), y + rnd.randint(1, 9)) for i in range(40) for x, y in [(rnd.randint(-80, 80), rnd.randint(-80, 80))]]
    points = [(i, i % 3, rnd.randint(-90, 120), rnd.randint(-90, 90)) for i in range(400)]
    b = spark.createDataFrame(boxes, "box_id long, g long, x0 long, y0 long, x1 long, y1 long")
    picked = mesh.pick_box(spark.createDataFrame(points, "point_id long, g long, x long, y long"), b, "g")
    want = {i: min([c for c, h, x0, y0, x1, y1 in boxes if h == g and x0 <= x <= x1 and y0 <= y <= y1] or [g]) for i, g, x, y in points if g < 2}
    assert {i: c for i, c in picked.collect()} == want
    plan = picked._jdf.queryExecution().optimizedPlan().toString()
    assert "_cx" in plan and "_cy" in plan  # not all pairs of a group
