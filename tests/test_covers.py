"""Clip boxes against a greedy cover on rasters, score terms against their definitions, skeleton graphs against plain walks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapgrid.operators import clip_cover, grid, skeleton


def raster(rng, n, most=14):
    m = np.zeros((n, n), dtype=bool)
    for _ in range(most):
        x, y = rng.randrange(n), rng.randrange(n)
        m[y : y + rng.randint(2, 12), x : x + rng.randint(2, 25)] = True
    return m


def pixels(masks):
    return [(k, int(x), int(y)) for k, m in masks.items() for y, x in np.argwhere(m)]


def terms(m, depth, bx, by, w, h, thick):
    box = m[by : by + h, bx : bx + w]
    ring = np.concatenate([box[0], box[:, -1], box[-1][::-1], box[:, 0][::-1]])
    segments = int(np.sum(ring & ~np.roll(ring, 1))) or int(ring.any())
    border = int(ring.sum())
    core = 0.0
    if depth is not None:
        d = depth[by : by + h, bx : bx + w]
        core = (d[:thick].sum() + d[-thick:].sum() + d[:, :thick].sum() + d[:, -thick:].sum()) / (thick * (w + h))
    return int(box.sum()), border, segments, -1.0 * border if segments % 2 == 0 else -2.5 * border, core


def clamp(v, most):
    return max(0, min(v, most))


def brute_cover(mask, depth, n, w, h, overlap, points):
    rx, ry = int(overlap * w), int(overlap * h)
    left = np.zeros_like(mask)
    for y, x in np.argwhere(mask):
        left[max(0, y - ry) : y + ry + 1, max(0, x - rx) : x + rx + 1] = True
    out, thick, area = [], max(1, min(round(min(w, h) * 0.02), 12)), w * h
    for nth in range(6):
        at = np.argwhere(left)
        if not len(at):
            break
        r = overlap * (1.0 if nth == 0 else max(0.15, 1.0 - 0.18 * nth))
        sx, sy = max(1, round((1 - r) * w / 2)), max(1, round((1 - r) * h / 2))
        places = []
        for k, s, margin, most in ((1, sx, int(r * w), n - w), (0, sy, int(r * h), n - h)):
            lo = clamp(at[:, k].min() - margin, most)
            hi = max(lo, clamp(at[:, k].max() + 1 + margin, most))
            places.append({*range(lo, hi + 1, s), hi})
        boxes = {(x, y) for x in places[0] for y in places[1]}
        dx, dy = int(0.18 * w), int(0.18 * h)
        for y, x in at[:: max(1, len(at) // points)]:
            boxes |= {(clamp(x - w // 2 + a, n - w), clamp(y - h // 2 + b, n - h)) for a in (-dx, 0, dx) for b in (-dy, 0, dy)}
        for x, y in out:
            boxes |= {(clamp(x + a * sx, n - w), clamp(y + b * sy, n - h)) for a in (-2, -1, 0, 1, 2) for b in (-2, -1, 0, 1, 2)}
        known, mine = {b: terms(mask, depth, *b, w, h, thick) for b in boxes}, []
        while left.any():
            ranked = []
            for (x, y), (fill, _, _, evenodd, core) in known.items():
                gain = int(left[y : y + h, x : x + w].sum())
                if not gain:
                    continue
                shares = [max(0, w - abs(x - a)) * max(0, h - abs(y - b)) / area for a, b in mine]
                enough = [s for s in shares if s > 0 and s >= r]
                over = min((s for s in enough if s <= 0.85), default=r)
                s = gain / (1.0 + (0.35 if nth == 0 else 0.18) * max(over - r, 0.0) + 0.25 * core) + 0.10 * fill / area + 0.02 * evenodd / area
                if fill / area < 0.03:
                    s -= 0.25 * area * (0.03 - fill / area)
                ranked.append((bool(enough) or not mine, s, gain, -y, -x))
            if not ranked:
                break
            strict = [(s, y, x) for ok, s, _, y, x in ranked if ok]
            _, y, x = max(strict) if strict else max((g, y, x) for _, _, g, y, x in ranked)
            mine.append((-x, -y))
            left[-y : -y + h, -x : -x + w] = False
        out += mine
    return list(dict.fromkeys(out)), left


@pytest.mark.parametrize("deep", [False, True])
def test_cover_is_the_greedy_one(spark, deep):
    rng = random.Random(7 + deep)
    n, w, h = 60, 30, 24
    masks = {k: raster(rng, n, most) for k, most in ((1, 3), (2, 4), (5, 1))}
    depth = {k: np.where(m, 1.0 + (np.indices(m.shape).sum(axis=0) % 5), 0.0) for k, m in masks.items()} if deep else None
    px = spark.createDataFrame(pixels(masks), "mask_id long, x long, y long")
    d = spark.createDataFrame([(k, x, y, float(depth[k][y, x])) for k, x, y in pixels(masks)], "mask_id long, x long, y long, depth double") if deep else None
    got = clip_cover.clip_boxes(grid.to_runs(px, "mask_id"), n, n, w, h, 0.1, d, points=20).orderBy("mask_id", "ord").collect()
    for k, m in masks.items():
        want, left = brute_cover(m, depth and depth[k], n, w, h, 0.1, 20)
        mine = [(r["x0"], r["y0"]) for r in got if r["mask_id"] == k]
        assert mine == want and not left.any() and all(r["x1"] - r["x0"] == w and r["y1"] - r["y0"] == h for r in got)


def test_cover_edges(spark):
    none = spark.createDataFrame([], "mask_id long, x long, y long")
    assert clip_cover.clip_boxes(grid.to_runs(none, "mask_id"), 50, 50, 10, 10, 0.1).count() == 0
    full = spark.createDataFrame([(None, x, y) for x in range(10) for y in range(10)] + [(3, 0, 0), (4, 49, 49)], "mask_id long, x long, y long").where("mask_id IS NOT NULL")
    got = clip_cover.clip_boxes(grid.to_runs(full, "mask_id"), 50, 50, 50, 50, 0.2).collect()
    assert sorted(tuple(r)[2:] for r in got) == [(0, 0, 50, 50)] * 2


def test_strided_sample(spark):
    rng = random.Random(2)
    masks = {k: raster(rng, 40, k) for k in (1, 4, 9)}
    px = spark.createDataFrame(pixels(masks), "m long, x long, y long")
    for cap in (1, 7, 10_000):
        got = {tuple(r) for r in grid.strided_sample(grid.to_runs(px, "m"), cap, "m").collect()}
        assert got == {(k, int(x), int(y)) for k, m in masks.items() for y, x in np.argwhere(m)[:: max(1, int(m.sum()) // cap)]}


# -- skeleton graphs -----------------------------------------------------------

def around(p, on):
    return [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (p[0] + a, p[1] + b) in on]


def walked(on):
    """Edges by walking every chain from both ends, and closed loops."""
    name = lambda p: p[1] * (1 << 32) + p[0]
    slant = lambda p, q: int(p[0] != q[0] and p[1] != q[1])
    near = {p: around(p, on) for p in on}
    nodes, out, seen = {p for p in on if len(near[p]) != 2}, set(), set()
    for a in nodes:
        for first in near[a]:
            before, here, steps, slants = a, first, 1, slant(a, first)
            while here not in nodes:
                seen.add(here)
                after = next(q for q in near[here] if q != before)
                before, here, steps, slants = here, after, steps + 1, slants + slant(here, after)
            e = (name(a), name(here), name(first), name(before), steps, slants)
            if e[0] < e[1] or (e[0] == e[1] and e[2] < e[3]):
                out.add(e)
    left = on - nodes - seen
    while left:
        start = min(left, key=name)
        loop, before, here, slants = {start}, start, near[start][0], slant(start, near[start][0])
        while here != start:
            loop.add(here)
            after = next(q for q in near[here] if q != before)
            before, here, slants = here, after, slants + slant(here, after)
        left -= loop
        out.add((name(start), name(start), *sorted(map(name, near[start])), len(loop), slants))
    return sorted(out)


def pruned(on, least):
    on = set(on)
    while True:
        near = {p: around(p, on) for p in on}
        gone = set()
        for end in (p for p in on if len(near[p]) == 1):
            path, here = [end], near[end][0]
            while len(near[here]) == 2:
                path.append(here)
                here = next(q for q in near[here] if q not in path)
            if len(near[here]) == 1:
                path.append(here)
            if len(path) < least:
                gone |= set(path)
        if not gone:
            return on
        on -= gone


def frames(rng, n, size, extra=()):
    on = set(extra)
    for _ in range(n):
        x, y, w, h = rng.randrange(size), rng.randrange(size), rng.randint(2, 14), rng.randint(2, 14)
        on |= {(x + i, y + j) for i in range(w + 1) for j in (0, h)} | {(x + i, y + j) for i in (0, w) for j in range(h + 1)}
    return on


LOOSE = [*((100 + i, i) for i in range(30)), (200, 5), (210, 1), (211, 1), *((130, i) for i in range(40)), (131, 41), *((131 + i, 20) for i in range(1, 6)), *((120 + i, 60) for i in range(9))]


def test_junction_graph(spark):
    rng = random.Random(3)
    for on in (frames(rng, 10, 50, LOOSE), frames(rng, 3, 60), {(5, 5)}):
        df = spark.createDataFrame(sorted(on), "x long, y long")
        assert sorted(tuple(r) for r in skeleton.junction_graph(df).collect()) == walked(on)
    assert skeleton.junction_graph(df.limit(0)).count() == 0


def test_prune(spark):
    on = frames(random.Random(5), 5, 60, LOOSE)
    df = spark.createDataFrame(sorted(on), "x long, y long")
    for least in (1, 8, 35):
        want = pruned(on, least)
        assert {tuple(r) for r in skeleton.prune(df, least).select("x", "y").collect()} == want
    assert len(pruned(on, 35)) < len(pruned(on, 8)) < len(on)
    assert skeleton.prune(df.where(F.lit(False)), 5).count() == 0
