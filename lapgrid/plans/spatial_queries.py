"""Queries over spatial joins, tile trees and placed objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import objects as ob
from ..operators import spatial, tiles, track
from .grid_queries import N
from .register import Register

R = Register()


def _other(rects, where):
    return rects.where(where).selectExpr("rect_id AS b_id", "tag AS b_tag", "x0 AS bx0", "y0 AS by0", "x1 AS bx1", "y1 AS by1")


_BOX, _RBOX = ["x0", "y0", "x1", "y1"], ["bx0", "by0", "bx1", "by1"]
_AREA = "(least(x1, bx1) - greatest(x0, bx0)) * (least(y1, by1) - greatest(y0, by0))"
R.query("j1_tile_polygon_overlap", "SELECT tile_id FROM tiles t WHERE x0 IS NULL OR EXISTS (SELECT 1 FROM rects r WHERE r.tag = 3 AND t.x0 <= r.x1 * 4 AND t.x1 >= r.x0 * 4 AND t.y0 <= r.y1 * 4 AND t.y1 >= r.y0 * 4)", "tiles", "rects")(
    lambda t, r: spatial.boxes_hit(t.where("x0 IS NOT NULL"), r.where("tag = 3").selectExpr("x0 * 4 AS bx0", "y0 * 4 AS by0", "x1 * 4 AS bx1", "y1 * 4 AS by1"), _BOX, _RBOX, 128).select("tile_id").distinct().union(t.where("x0 IS NULL").select("tile_id")))
R.query("j20_box_overlap", """SELECT a.rect_id, b.rect_id AS b_id, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS area
 FROM rects a JOIN rects b ON a.rect_id < b.rect_id AND a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0
 WHERE 2 * (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) >= (a.x1 - a.x0) * (a.y1 - a.y0)""", "rects")(
    lambda r: spatial.box_pairs(r, "rect_id", 16, F.expr(f"2 * {_AREA} >= (x1 - x0) * (y1 - y0)")).select("rect_id", F.col("b_rect_id").alias("b_id"), F.expr(_AREA).alias("area")))
_ALL_EDGES = "ed AS (SELECT a.ring_id, a.x AS ax, a.y AS ay, b.x AS ex, b.y AS ey FROM rings a JOIN rings b ON a.ring_id = b.ring_id AND b.v = (a.v + 1) % 16)"
_ALL_IN = "SELECT point_id, ring_id FROM centers p JOIN ed ON (ay > p.y) <> (ey > p.y) AND p.x < ax + (p.y - ay) * (ex - ax)::DOUBLE / (ey - ay) GROUP BY point_id, ring_id HAVING count(*) % 2 = 1"


def _in_all(p, r):
    return spatial.points_in_rings(p, spatial.ring_edges(r, "ring_id", "v"), "ring_id", 256)


for _name in ("j3_points_in_polygons", "j3_points_in_all_polygons"):  # one query under its two names
    R.query(_name, f"WITH {_ALL_EDGES} {_ALL_IN}", "centers", "rings")(_in_all)
for _name in ("f4_inside_outer_not_hole", "f4_inside_any_outer_not_hole"):
    R.query(_name, f"WITH {_ALL_EDGES}, m AS ({_ALL_IN}) SELECT DISTINCT point_id FROM m WHERE ring_id % 2 = 0 AND point_id NOT IN (SELECT point_id FROM m WHERE ring_id % 2 = 1)", "centers", "rings")(
        lambda p, r: spatial.inside_outer_not_hole(p, spatial.ring_edges(r, "ring_id", "v"), "ring_id", F.col("ring_id") % 2 == 1, 256))
_ALL_SMALL = "sr AS (SELECT ring_id, v, floor(x / 16)::BIGINT AS x, floor(y / 16)::BIGINT AS y FROM rings)"
for _name in ("r1_polygon_fill", "r1_fill_all_polygons"):
    R.query(_name, f"""WITH {_ALL_SMALL}, ed AS (SELECT a.ring_id, a.x AS ax, a.y AS ay, b.x AS ex, b.y AS ey FROM sr a JOIN sr b ON a.ring_id = b.ring_id AND b.v = (a.v + 1) % 16 WHERE a.y <> b.y),
 sc AS (SELECT ring_id, y, ax + (y + 0.5e0 - ay) * (ex - ax) / (ey - ay) AS pos, ax, ex FROM (SELECT *, unnest(range(least(ay, ey), greatest(ay, ey))) AS y FROM ed)),
 pr AS (SELECT *, row_number() OVER w AS r, lead(pos) OVER w AS nxt FROM sc WINDOW w AS (PARTITION BY ring_id, y ORDER BY pos, ax, ex))
SELECT ring_id, y, ceil(pos - 0.5)::BIGINT AS x0, (ceil(nxt - 0.5) - 1)::BIGINT AS x1 FROM pr WHERE r % 2 = 1 AND ceil(pos - 0.5) <= ceil(nxt - 0.5) - 1""", "rings")(
        lambda r: spatial.fill_rings(spatial.ring_edges(r.select("ring_id", "v", F.floor(F.col("x") / 16).alias("x"), F.floor(F.col("y") / 16).alias("y")), "ring_id", "v"), "ring_id"))


def _circuit(t):
    """Edges (layout, ax, ay, bx, by) of the closed track, by a join on (layout, index modulo n)."""
    n = t.groupBy("layout").agg(F.count("*").alias("n"))
    nxt = t.join(n, "layout").select("layout", F.pmod(F.col("idx") - 1, F.col("n")).cast("int").alias("idx"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return t.select("layout", "idx", F.col("x").alias("ax"), F.col("y").alias("ay")).join(nxt, ["layout", "idx"]).drop("idx")


for _name in ("j19_nearest_edge", "j19_nearest_edge_of_all"):
    R.query(_name, """WITH ed AS (SELECT layout, x AS ax, y AS ay, lead(x, 1, fx) OVER w AS ex, lead(y, 1, fy) OVER w AS ey FROM (SELECT *, first_value(x) OVER (PARTITION BY layout ORDER BY idx) AS fx, first_value(y) OVER (PARTITION BY layout ORDER BY idx) AS fy FROM track) WINDOW w AS (PARTITION BY layout ORDER BY idx)),
 p AS (SELECT point_id, point_id % 4 AS layout, x % 2000 AS x, y % 1500 AS y FROM centers),
 j AS (SELECT point_id, p.layout, x, y, ax, ay, ex, ey, CASE WHEN ax = ex AND ay = ey THEN 0e0 ELSE least(greatest(((x - ax) * (ex - ax) + (y - ay) * (ey - ay))::DOUBLE / ((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)), 0), 1) END AS t FROM p JOIN ed ON p.layout = ed.layout)
SELECT point_id, layout, round(min(pow(x - ax - t * (ex - ax), 2) + pow(y - ay - t * (ey - ay), 2)), 3) AS d2 FROM j GROUP BY point_id, layout""", "centers", "track")(
        lambda c, t: spatial.nearest_edge(c.select("point_id", (F.col("point_id") % 4).alias("layout"), (F.col("x") % 2000).alias("x"), (F.col("y") % 1500).alias("y")), _circuit(t), "layout").select("point_id", "layout", F.round("d2", 3).alias("d2")))
R.query("j18_overzoom", """WITH h AS (SELECT DISTINCT 3 + point_id % 6 AS z, (x * 7) % (1 << (3 + point_id % 6)::INT) AS x, (y * 7) % (1 << (3 + point_id % 6)::INT) AS y FROM centers), w AS (SELECT DISTINCT 9 AS z, x % 512 AS x, y % 512 AS y FROM centers),
 a AS (SELECT w.z, w.x, w.y, u.i AS up FROM w, range(0, 9) u(i)), m AS (SELECT a.z, a.x, a.y, h.z AS hz, h.x AS hx, h.y AS hy, row_number() OVER (PARTITION BY a.x, a.y ORDER BY h.z DESC) AS r FROM a JOIN h ON h.z = a.z - a.up AND h.x = a.x >> a.up::INT AND h.y = a.y >> a.up::INT)
SELECT z, x, y, hz, hx, hy FROM m WHERE r = 1""", "centers")(
    lambda c: spatial.overzoom(c.select(F.lit(9).alias("z"), (F.col("x") % 512).alias("x"), (F.col("y") % 512).alias("y")).distinct(), c.selectExpr("cast(3 + point_id % 6 AS int) AS z", "(x * 7) % shiftleft(1L, cast(3 + point_id % 6 AS int)) AS x", "(y * 7) % shiftleft(1L, cast(3 + point_id % 6 AS int)) AS y"), 8))
_LABEL = "lb AS (SELECT x, y, max(tag) AS tag FROM (SELECT tag, y, unnest(range(x0, x1 + 1)) AS x FROM (SELECT tag, x0, x1, unnest(range(y0, y1 + 1)) AS y FROM rects)) GROUP BY x, y)"


def _label(rects):
    from .grid_queries import filled
    return filled(rects).groupBy("x", "y").agg(F.max("tag").alias("tag"))


R.query("j7_surface_flags", f"WITH {_LABEL} SELECT object_id, tag, coalesce(tag = 4, false) AS on_road, coalesce(tag IN (3, 4), false) AS on_paved, tag IS NULL AS on_invalid FROM objects o LEFT JOIN lb ON lb.x = o.x AND lb.y = o.y", "objects", "rects")(
    lambda o, r: ob.surface_flags(o, _label(r), 4, [3, 4]).select("object_id", "tag", "on_road", "on_paved", "on_invalid"))
R.query("a16_pass_rates", f"""WITH {_LABEL}, f AS (SELECT layout, type, CASE type WHEN 'hotlap' THEN coalesce(tag = 4, false) WHEN 'pit' THEN coalesce(tag IN (3, 4), false) ELSE true END AS ok FROM objects o LEFT JOIN lb ON lb.x = o.x AND lb.y = o.y)
SELECT layout, type, count(*) AS total, count(*) FILTER (ok) AS passed, round(count(*) FILTER (ok) / count(*), 6) AS rate FROM f GROUP BY layout, type""", "objects", "rects")(
    lambda o, r: ob.pass_rates(ob.surface_flags(o, _label(r), 4, [3, 4]), {"hotlap": "on_road", "pit": "on_paved"}))
R.query("a17_best_attempt", "WITH a AS (SELECT layout, 1 + object_id % 2 AS attempt, round(avg(CASE WHEN x > 90 THEN 1e0 ELSE 0e0 END), 6) AS rate FROM objects GROUP BY 1, 2) SELECT layout, attempt, rate FROM (SELECT *, row_number() OVER (PARTITION BY layout ORDER BY CASE WHEN attempt = 1 AND rate >= 0.65 THEN 1 ELSE 0 END DESC, rate DESC, attempt DESC) AS r FROM a) WHERE r = 1", "objects")(
    lambda o: ob.best_attempt(o.groupBy("layout", (1 + F.col("object_id") % 2).alias("attempt")).agg(F.round(F.avg(F.when(F.col("x") > 90, 1.0).otherwise(0.0)), 6).alias("rate")), 0.65))
R.query("j6_snap_to_valid", f"""WITH {_LABEL}, v AS (SELECT x, y FROM lb WHERE tag = 4), o AS (SELECT object_id, x, y FROM objects WHERE type = 'pit'),
 c AS (SELECT object_id, v.x AS sx, v.y AS sy, row_number() OVER (PARTITION BY object_id ORDER BY pow(o.x - v.x, 2) + pow(o.y - v.y, 2), v.y, v.x) AS r FROM o JOIN v ON abs(o.x - v.x) <= 12 AND abs(o.y - v.y) <= 12 AND pow(o.x - v.x, 2) + pow(o.y - v.y, 2) <= 144)
SELECT o.object_id, sx, sy FROM o LEFT JOIN c ON c.object_id = o.object_id AND r = 1""", "objects", "rects")(
    lambda o, r: spatial.snap_to_valid(o.where("type = 'pit'").select("object_id", "x", "y"), _label(r).where("tag = 4").select("x", "y"), 12))
R.query("t4_next_names", "SELECT layout, type, count(*) AS next FROM objects GROUP BY layout, type", "objects")(ob.next_names)
R.query("j21_gate_pairs", "SELECT x AS n, bool_or(type = 'timing_left') AS has_left, bool_or(type = 'timing_right') AS has_right FROM objects WHERE type LIKE 'timing%' GROUP BY x", "objects")(
    lambda o: ob.gate_pairs(o.select(F.col("x").alias("n"), "type")))
R.query("j21_gate_pairs_of_all", "SELECT object_id // 4 AS n, bool_or(type = 'timing_left') AS has_left, bool_or(type = 'timing_right') AS has_right FROM objects WHERE type LIKE 'timing%' GROUP BY object_id // 4", "objects")(
    lambda o: ob.gate_pairs(o.select(F.expr("object_id div 4").alias("n"), "type")))
R.query("w24_stable_names", "SELECT rect_id, tag, row_number() OVER (PARTITION BY tag ORDER BY rect_id) - 1 AS number FROM rects", "rects")(lambda r: ob.stable_names(r.select("rect_id", "tag"), "tag", "rect_id").withColumn("number", F.col("number").cast("long")))
R.query("a18_validate", "SELECT layout, array_to_string(list_filter([CASE WHEN count(*) FILTER (type = 'hotlap') <> 1 THEN 'one hotlap' END, CASE WHEN count(*) FILTER (type = 'pit') = 0 THEN 'a pit' END, CASE WHEN count(*) FILTER (type = 'timing_left') <> count(*) FILTER (type = 'timing_right') THEN 'paired gates' END], lambda e: e IS NOT NULL), '; ') AS errors FROM objects GROUP BY layout", "objects")(ob.validate)
R.query("a8_group_boxes", "SELECT group_id, min(x0) - 5 AS x0, min(y0) - 5 AS y0, max(x1) + 5 AS x1, max(y1) + 5 AS y1 FROM rects GROUP BY group_id", "rects")(
    lambda r: r.groupBy("group_id").agg(*[(f(c) + d).alias(c) for f, c, d in ((F.min, "x0", -5), (F.min, "y0", -5), (F.max, "x1", 5), (F.max, "y1", 5))]))
R.query("a11_axis_vote", """WITH h AS (SELECT k, name, count(*) AS hits FROM tiles t JOIN (VALUES (0, 'XY'), (1, 'XnY'), (2, 'XZ'), (3, 'XnZ')) m(k, name) ON t.x0 IS NOT NULL JOIN rects r ON r.tag = 3 AND t.x0 <= r.x1 AND t.x1 >= r.x0
 AND CASE k WHEN 0 THEN t.y0 WHEN 1 THEN -t.y1 WHEN 2 THEN floor(t.x0 / 2) - 60 ELSE -(floor(t.x0 / 2) + 40) END <= r.y1 AND CASE k WHEN 0 THEN t.y1 WHEN 1 THEN -t.y0 WHEN 2 THEN floor(t.x0 / 2) + 40 ELSE -(floor(t.x0 / 2) - 60) END >= r.y0 GROUP BY k, name)
SELECT name, hits FROM h ORDER BY hits DESC, k LIMIT 1""", "tiles", "rects")(
    lambda t, r: spatial.axis_vote(t.where("x0 IS NOT NULL").withColumns({"z0": F.expr("CAST(floor(x0 / 2) AS bigint) - 60"), "z1": F.expr("CAST(floor(x0 / 2) AS bigint) + 40")}), _other(r, "tag = 3"), 64))
R.query("u3_box_dedupe", """SELECT min(rect_id) AS rect_id FROM (SELECT rect_id, (x0 % 12) / 240e0 + rect_id * 1e-11 AS a, (y0 % 12) / 240e0 AS b, (x1 - x0) / 240e0 AS c, (y1 - y0) / 240e0 AS d FROM rects)
 GROUP BY round(a, 6), round(b, 6), round(c, 6), round(d, 6)""", "rects")(
    lambda r: spatial.dedupe_boxes(r.selectExpr("rect_id", "(x0 % 12) / 240e0 + rect_id * 1e-11D AS a", "(y0 % 12) / 240e0 AS b", "(x1 - x0) / 240e0 AS c", "(y1 - y0) / 240e0 AS d"), "rect_id", ["a", "b", "c", "d"]))
R.query("u4_independent_tags", "SELECT DISTINCT tag FROM rects EXCEPT SELECT DISTINCT tag FROM pixels WHERE tag < 3", "rects", "pixels")(
    lambda r, p: r.select("tag").distinct().subtract(p.where("tag < 3").select("tag").distinct()))

_TREE = "clo(ancestor, tile_id) AS (SELECT parent_id, tile_id FROM tiles WHERE parent_id IS NOT NULL UNION ALL SELECT t.parent_id, c.tile_id FROM clo c JOIN tiles t ON t.tile_id = c.ancestor WHERE t.parent_id IS NOT NULL)"
_OVER = "(x0 IS NULL OR (x0 <= 620 AND x1 >= 300 AND y0 <= 480 AND y1 >= 200))"
_PLAN = f"""ti AS (SELECT *, {_OVER} AS lap, can_refine AND EXISTS (SELECT 1 FROM tiles k WHERE k.parent_id = tiles.tile_id) AS open FROM tiles), st AS (SELECT *, has_mesh AND (level >= 19 OR NOT open OR (level >= 17 AND NOT lap)) AS stop FROM ti),
 wk(tile_id, level, has_mesh, open, stop) AS (SELECT tile_id, level, has_mesh, open, stop FROM st WHERE parent_id IS NULL UNION ALL SELECT s.tile_id, s.level, s.has_mesh, s.open, s.stop FROM wk JOIN st s ON s.parent_id = wk.tile_id AND NOT wk.stop AND wk.open)"""


def _plan(t):
    return tiles.load_plan(t.withColumn("overlaps", F.expr(_OVER)), 17, 19)


R.query("l1_load_plan", f"WITH {_PLAN} SELECT tile_id, level FROM wk WHERE stop", "tiles")(_plan)
R.query("a20_plan_histogram", f"WITH {_PLAN} SELECT level, count(*) AS n FROM wk WHERE stop GROUP BY level", "tiles")(lambda t: _plan(t).groupBy("level").agg(F.count("*").alias("n")))
R.query("j16_plan_conflicts", f"WITH {_TREE}, pl AS (SELECT tile_id FROM tiles WHERE has_mesh AND x0 % 3 = 0) SELECT ancestor, tile_id FROM clo WHERE ancestor IN (SELECT tile_id FROM pl) AND tile_id IN (SELECT tile_id FROM pl)", "tiles")(
    lambda t: tiles.plan_conflicts(t.where("has_mesh AND x0 % 3 = 0"), tiles.descendants(t)))
R.query("l7_descendants", f"WITH {_TREE} SELECT ancestor, count(*) AS n FROM clo GROUP BY ancestor", "tiles")(lambda t: tiles.descendants(t).groupBy("ancestor").agg(F.count("*").alias("n")))
R.query("l6_covered_by", "WITH ch AS (SELECT tile_id FROM tiles WHERE level = 19 AND tile_id NOT IN ('c3', 'c10')), nn AS (SELECT tile_id FROM tiles n WHERE level = 17 AND can_refine AND NOT EXISTS (SELECT 1 FROM tiles k WHERE k.parent_id = n.tile_id AND k.tile_id NOT IN (SELECT tile_id FROM ch))), rr AS (SELECT tile_id FROM tiles n WHERE level = 15 AND can_refine AND NOT EXISTS (SELECT 1 FROM tiles k WHERE k.parent_id = n.tile_id AND k.tile_id NOT IN (SELECT tile_id FROM nn))) SELECT tile_id FROM ch UNION SELECT tile_id FROM nn UNION SELECT tile_id FROM rr UNION SELECT 'root' WHERE (SELECT count(*) FROM rr) = (SELECT count(*) FROM tiles WHERE level = 15)", "tiles")(
    lambda t: tiles.covered_by(t, t.where("level = 19 AND tile_id NOT IN ('c3', 'c10')")))
R.query("k5_refinement_order", "SELECT level, tile_id, row_number() OVER (PARTITION BY level ORDER BY tile_id) AS place FROM tiles WHERE has_mesh", "tiles")(
    lambda t: t.where("has_mesh").selectExpr("level", "tile_id", "cast(row_number() OVER (PARTITION BY level ORDER BY tile_id) AS bigint) AS place"))
R.query("j17_object_to_tile", "SELECT rect_id, tile_id FROM rects JOIN tiles ON tile_id = 'c' || rect_id", "rects", "tiles")(
    lambda r, t: r.select("rect_id", F.regexp_extract(F.concat(F.lit("c"), "rect_id", F.lit(".glb.001")), r"^(.*?)\.glb", 1).alias("tile_id")).join(t.select("tile_id"), "tile_id").select("rect_id", "tile_id"))
R.query("j10_manual_over_auto", """WITH m AS (SELECT DISTINCT clip, x, y FROM pixels WHERE exclude AND clip % 3 = 0), a AS (SELECT DISTINCT clip, x, y FROM pixels WHERE NOT exclude)
SELECT clip, x, y, true AS manual FROM m UNION ALL SELECT clip, x, y, false FROM a WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.clip = a.clip)""", "pixels")(
    lambda p: ob.manual_first(p.where("exclude AND clip % 3 = 0").select("clip", "x", "y").distinct(), p.where("NOT exclude").select("clip", "x", "y").distinct(), "clip"))
R.query("j9_prompt_fallback", "WITH h AS (SELECT DISTINCT clip, tag FROM pixels WHERE prob > 0.85 AND x < 24) SELECT clip, coalesce(min(CASE WHEN tag = 0 THEN 0 END), min(tag)) AS prompt FROM h GROUP BY clip", "pixels")(
    lambda p: (lambda h: h.where("tag = 0").select("clip", F.lit(0).alias("prompt")).union(h.join(h.where("tag = 0"), "clip", "left_anti").groupBy("clip").agg(F.min("tag").alias("prompt"))))(p.where("prob > 0.85 AND x < 24").select("clip", "tag").distinct()))
R.query("f9_score_threshold", "SELECT ord FROM pixels JOIN (VALUES (0, 0.2), (1, 0.4), (2, 0.6), (3, 0.8), (4, 0.9)) v(tag, least) USING (tag) WHERE prob >= least::DOUBLE", "pixels")(
    lambda p: p.join(F.broadcast(p.sparkSession.sql("SELECT * FROM VALUES (0, 0.2D), (1, 0.4D), (2, 0.6D), (3, 0.8D), (4, 0.9D) AS v(tag, least)")), "tag").where("prob >= least").select("ord"))
