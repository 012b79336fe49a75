"""Queries over sparse rasters.  The canvas is 256 x 256."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid
from .register import Register

R = Register()
N = 256
_RECT_PX = "rpx AS (SELECT DISTINCT tag, x, y FROM (SELECT tag, y, unnest(range(x0, x1 + 1)) AS x FROM (SELECT tag, x0, x1, unnest(range(y0, y1 + 1)) AS y FROM rects)))"
_CANVAS = f"cv AS (SELECT a.i AS x, b.i AS y FROM range(0, {N}) a(i), range(0, {N}) b(i))"


def filled(rects, tag=None):
    r = rects if tag is None else rects.where(F.col("tag") == tag)
    # Equal boxes are filled once.
    return r.select("tag", "x0", "y0", "x1", "y1").distinct().select("tag", "x0", "x1", F.explode(F.sequence("y0", "y1")).alias("y")).select("tag", F.explode(F.sequence("x0", "x1")).alias("x"), "y").distinct()


R.query("a1_mask_merge", "SELECT tag, x, y, round(least(sum(prob), 1), 6) AS prob FROM pixels GROUP BY tag, x, y", "pixels")(
    lambda px: grid.merge_masks(px, "prob", "sum", "tag").withColumn("prob", F.round("prob", 6)))
R.query("a2_layout_union", "SELECT x, y, max(prob) AS prob FROM pixels GROUP BY x, y", "pixels")(lambda px: grid.merge_masks(px, "prob"))
R.query("a3_ordered_paint", "SELECT DISTINCT tag, x, y FROM (SELECT *, row_number() OVER (PARTITION BY clip, tag, x, y ORDER BY ord DESC) AS r FROM pixels) WHERE r = 1 AND NOT exclude", "pixels")(
    lambda px: grid.paint(px, "ord", "exclude"))
R.query("a4_priority_composite", "SELECT x, y, max(tag) AS tag FROM pixels GROUP BY x, y", "pixels")(grid.composite)
R.query("a5_coverage", f"""WITH p AS (SELECT DISTINCT tag, x, y FROM (SELECT *, row_number() OVER (PARTITION BY clip, tag, x, y ORDER BY ord DESC) AS r FROM pixels) WHERE r = 1 AND NOT exclude),
 a AS (SELECT tag, round(100e0 * count(*) / {N * N}, 6) AS raw FROM p GROUP BY tag), b AS (SELECT tag, round(100e0 * count(*) / {N * N}, 6) AS final FROM (SELECT max(tag) AS tag FROM p GROUP BY x, y) GROUP BY tag)
SELECT a.tag, raw, coalesce(final, 0) AS final FROM a LEFT JOIN b ON a.tag = b.tag""", "pixels")(
    lambda px: (lambda p: grid.coverage(p, grid.composite(p), N, N))(grid.paint(px, "ord", "exclude")))
R.query("a24_edit_tiles", "SELECT DISTINCT x // 8 AS col, y // 8 AS row FROM pixels", "pixels")(lambda px: grid.edit_tiles(px, 8))
R.query("a31_tag_counts", "SELECT tag, count(DISTINCT x * 1000 + y) AS n FROM pixels GROUP BY tag", "pixels")(
    lambda px: px.select("tag", "x", "y").distinct().groupBy("tag").agg(F.count("*").alias("n")))
R.query("u1_mask_difference", "SELECT DISTINCT x, y FROM pixels WHERE tag = 1 AND (x, y) NOT IN (SELECT (x, y) FROM pixels WHERE tag = 3)", "pixels")(
    lambda px: px.where("tag = 1").select("x", "y").subtract(px.where("tag = 3").select("x", "y")))
R.query("u1_mask_intersection", "SELECT DISTINCT x, y FROM pixels WHERE tag = 1 AND (x, y) IN (SELECT (x, y) FROM pixels WHERE tag = 3)", "pixels")(
    lambda px: px.where("tag = 1").select("x", "y").intersect(px.where("tag = 3").select("x", "y")))
R.query("k4_strided_sample", """WITH p AS (SELECT DISTINCT x, y FROM pixels), n AS (SELECT *, row_number() OVER (ORDER BY y, x) - 1 AS r, count(*) OVER () AS n FROM p)
SELECT x, y FROM n WHERE r % greatest(n // 500, 1) = 0""", "pixels")(
    lambda px: grid.strided_sample(grid.to_runs(px), 500))
R.query("runs_of_mask", f"WITH {_RECT_PX} SELECT tag, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY tag, y ORDER BY x) AS g FROM rpx) GROUP BY tag, y, g", "rects")(
    lambda r: grid.to_runs(filled(r), "tag"))
R.query("g1_dilate_rect", f"WITH {_RECT_PX} SELECT DISTINCT x + dx AS x, y + dy AS y FROM rpx, range(-2, 3) a(dx), range(-2, 3) b(dy) WHERE tag = 5 AND x + dx BETWEEN 0 AND {N - 1} AND y + dy BETWEEN 0 AND {N - 1}", "rects")(
    lambda r: grid.dilate(filled(r, 5), "rect", 2, N, N))
_DISC = " OR ".join(f"(dy = {d} AND abs(dx) <= {h})" for d, h in grid.half_widths("disc", 3))
R.query("g14_near_zone", f"WITH {_RECT_PX} SELECT DISTINCT x + dx AS x, y + dy AS y FROM rpx, range(-3, 4) a(dx), range(-3, 4) b(dy) WHERE tag = 4 AND ({_DISC}) AND x + dx BETWEEN 0 AND {N - 1} AND y + dy BETWEEN 0 AND {N - 1}", "rects")(
    lambda r: grid.dilate(filled(r, 4), "disc", 3, N, N))
_ERODE = f"""s AS (SELECT x, y FROM rpx WHERE tag = 5), {_CANVAS}, z AS (SELECT * FROM cv EXCEPT SELECT x, y FROM s), g AS (SELECT DISTINCT x + dx AS x, y + dy AS y FROM z, range(-1, 2) a(dx), range(-1, 2) b(dy)),
 er AS (SELECT * FROM s EXCEPT SELECT * FROM g)"""
R.query("g2_erode", f"WITH {_RECT_PX}, {_ERODE} SELECT x, y FROM er", "rects")(lambda r: grid.erode(filled(r, 5), "rect", 1, N, N))
R.query("g3_open", f"WITH {_RECT_PX}, {_ERODE} SELECT DISTINCT x + dx AS x, y + dy AS y FROM er, range(-1, 2) a(dx), range(-1, 2) b(dy) WHERE x + dx BETWEEN 0 AND {N - 1} AND y + dy BETWEEN 0 AND {N - 1}", "rects")(
    lambda r: grid.opened(filled(r, 5), "rect", 1, N, N))
R.query("g3_close", f"""WITH {_RECT_PX}, d AS (SELECT DISTINCT x + dx AS x, y + dy AS y FROM rpx, range(-1, 2) a(dx), range(-1, 2) b(dy) WHERE tag = 5 AND x + dx BETWEEN 0 AND {N - 1} AND y + dy BETWEEN 0 AND {N - 1}), {_CANVAS},
 z AS (SELECT * FROM cv EXCEPT SELECT * FROM d), g AS (SELECT DISTINCT x + dx AS x, y + dy AS y FROM z, range(-1, 2) a(dx), range(-1, 2) b(dy)) SELECT * FROM d EXCEPT SELECT * FROM g""", "rects")(
    lambda r: grid.closed(filled(r, 5), "rect", 1, N, N))
_CC = """s AS (SELECT x, y FROM rpx WHERE tag = 5), ru AS (SELECT y, min(x) AS x0, max(x) AS x1, y * 4294967296 + min(x) AS id FROM (SELECT *, x - row_number() OVER (PARTITION BY y ORDER BY x) AS g FROM s) GROUP BY y, g),
 e AS (SELECT a.id AS a, b.id AS b FROM ru a JOIN ru b ON abs(a.y - b.y) = 1 AND a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1),
 re(a, b) AS (SELECT id, id FROM ru UNION SELECT re.a, e.b FROM re JOIN e ON re.b = e.a), rc AS (SELECT a, min(b) AS comp FROM re GROUP BY a),
 cc AS (SELECT s.y * 4294967296 + s.x AS id, comp FROM s JOIN ru ON s.y = ru.y AND s.x BETWEEN ru.x0 AND ru.x1 JOIN rc ON rc.a = ru.id)"""
R.query("g4_components", f"WITH {_RECT_PX}, {_CC} SELECT comp, count(*) AS n, min(id % 4294967296) AS x0, min(id // 4294967296) AS y0, max(id % 4294967296) AS x1, max(id // 4294967296) AS y1 FROM cc GROUP BY comp", "rects")(
    lambda r: grid.label_components(filled(r, 5)).groupBy("comp").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")))
R.query("k2_largest_region", f"WITH {_RECT_PX}, {_CC} SELECT comp, count(*) AS n FROM cc GROUP BY comp ORDER BY n DESC, comp LIMIT 1", "rects")(
    lambda r: grid.label_components(filled(r, 5)).groupBy("comp").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "comp").limit(1))
R.query("g5_flood", f"WITH {_RECT_PX}, {_CC} SELECT id % 4294967296 AS x, id // 4294967296 AS y FROM cc WHERE comp IN (SELECT comp FROM cc WHERE (id % 4294967296) % 50 = 0)", "rects")(
    lambda r: (lambda p: grid.flood(p.where("x % 50 = 0"), p))(filled(r, 5).select("x", "y")))
R.query("g7_distance", f"WITH {_RECT_PX} SELECT x + dx AS x, y + dy AS y, min(dx * dx + dy * dy) AS d2 FROM rpx, range(-4, 5) a(dx), range(-4, 5) b(dy) WHERE tag = 5 AND dx * dx + dy * dy <= 16 AND x + dx BETWEEN 0 AND {N - 1} AND y + dy BETWEEN 0 AND {N - 1} GROUP BY 1, 2", "rects")(
    lambda r: grid.distance2(filled(r, 5), N, N, 4))
R.query("g8_gap_close", f"""WITH {_RECT_PX}, d AS (SELECT tag = 5 AS road, x + dx AS x, y + dy AS y, min(dx * dx + dy * dy) AS d2 FROM rpx, range(-6, 7) a(dx), range(-6, 7) b(dy) WHERE dx * dx + dy * dy <= 36 AND tag IN (3, 5) AND x + dx BETWEEN 0 AND {N - 1} AND y + dy BETWEEN 0 AND {N - 1} GROUP BY 1, 2, 3),
 m AS (SELECT a.x, a.y FROM d a JOIN d b ON a.x = b.x AND a.y = b.y AND a.road AND NOT b.road WHERE sqrt(a.d2) + sqrt(b.d2) <= 6 AND (a.x, a.y) NOT IN (SELECT (x, y) FROM rpx WHERE tag IN (3, 5)))
SELECT x, y FROM rpx WHERE tag = 5 UNION SELECT x, y FROM m""", "rects")(
    lambda r: (lambda a, b: grid.close_gap(a, b, a.union(b), 6, N, N))(filled(r, 5), filled(r, 3)))
_OUTLINE_PX = "rpx AS (SELECT DISTINCT x, y FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM (SELECT x0, x1, y0, y1, unnest(range(y0, y1 + 1)) AS y FROM rects)) WHERE x = x0 OR x = x1 OR y = y0 OR y = y1)"


def outlines(rects):
    r = rects.select("x0", "x1", "y0", "y1", F.explode(F.sequence("y0", "y1")).alias("y")).select("*", F.explode(F.sequence("x0", "x1")).alias("x"))
    return r.where("x = x0 OR x = x1 OR y = y0 OR y = y1").select("x", "y").distinct()


R.query("g6_interior_holes", f"""WITH {_OUTLINE_PX}, {_CANVAS}, z AS (SELECT * FROM cv EXCEPT SELECT x, y FROM rpx),
 zr AS (SELECT y, min(x) AS x0, max(x) AS x1, y * 4294967296 + min(x) AS id FROM (SELECT *, x - row_number() OVER (PARTITION BY y ORDER BY x) AS g FROM z) GROUP BY y, g),
 ze AS (SELECT a.id AS a, b.id AS b FROM zr a JOIN zr b ON abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
 out(id) AS (SELECT id FROM zr WHERE y IN (0, {N - 1}) OR x0 = 0 OR x1 = {N - 1} UNION SELECT b FROM out JOIN ze ON a = id),
 hr AS (SELECT * FROM zr WHERE id NOT IN (SELECT id FROM out)),
 hc(a, b) AS (SELECT id, id FROM hr UNION SELECT hc.a, ze.b FROM hc JOIN ze ON hc.b = ze.a),
 hp AS (SELECT y, unnest(range(x0, x1 + 1)) AS x, comp FROM hr JOIN (SELECT a, min(b) AS comp FROM hc GROUP BY a) ON a = id)
SELECT x, y, comp FROM hp WHERE comp IN (SELECT comp FROM hp GROUP BY comp HAVING count(*) >= 3)""", "rects")(lambda r: grid.interior_holes(outlines(r), N, N, 3))
R.query("a19_majority_neighbour", f"""WITH {_RECT_PX}, {_CC}, lb AS (SELECT x, y, max(tag) AS tag FROM rpx WHERE tag < 5 GROUP BY x, y),
 g AS (SELECT DISTINCT id % 4294967296 + dx AS x, id // 4294967296 + dy AS y, comp FROM cc, range(-1, 2) a(dx), range(-1, 2) b(dy)), h AS (SELECT * FROM g WHERE (x, y, comp) NOT IN (SELECT (id % 4294967296, id // 4294967296, comp) FROM cc)),
 n AS (SELECT comp, tag, count(*) AS n FROM h JOIN lb USING (x, y) GROUP BY comp, tag)
SELECT comp, tag, n AS contacts FROM (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY n DESC, tag) AS r FROM n) WHERE r = 1""", "rects")(
    lambda r: grid.majority_neighbour(grid.label_components(filled(r, 5)), grid.composite(filled(r).where("tag < 5")), N, N))
R.query("g15_resize", f"WITH lb AS (SELECT x, y, max(tag) AS tag FROM pixels GROUP BY x, y) SELECT t.x, t.y, tag FROM (SELECT a.i AS x, b.i AS y FROM range(0, 100) a(i), range(0, 300) b(i)) t JOIN lb ON lb.x = floor((t.x + 0.5) * 2.56) AND lb.y = floor((t.y + 0.5) * {N} / 300)", "pixels")(
    lambda px: grid.resize(grid.composite(px), 2.56, N / 300, 100, 300))
R.query("g16_tile_patch", "SELECT DISTINCT x, y FROM pixels WHERE tag = CASE WHEN x // 64 = 1 AND y // 64 = 2 THEN 4 ELSE 2 END", "pixels")(
    lambda px: grid.patch_tile(px.where("tag = 2"), px.where("tag = 4"), 1, 2, 64))
R.query("g18_degrees", "WITH p AS (SELECT DISTINCT x, y FROM pixels WHERE tag = 2) SELECT a.x, a.y, count(b.x) AS degree FROM p a LEFT JOIN p b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND (a.x <> b.x OR a.y <> b.y) GROUP BY a.x, a.y", "pixels")(
    lambda px: grid.degrees(px.where("tag = 2")))
R.query("g17_skeleton", None, "rects")(lambda r: grid.thin(filled(r, 5)))
R.query("r3_boundary_edges", f"WITH {_RECT_PX}, s AS (SELECT x, y FROM rpx WHERE tag = 5), k AS (SELECT * FROM (VALUES (0, 0, -1), (1, 1, 0), (2, 0, 1), (3, -1, 0)) v(side, a, b)) SELECT x, y, side FROM s, k WHERE (x + a, y + b) NOT IN (SELECT (x, y) FROM s)", "rects")(
    lambda r: grid.boundary_edges(filled(r, 5)))
