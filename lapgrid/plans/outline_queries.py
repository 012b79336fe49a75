"""Queries over outlines, placed objects as a whole, refinement of tile trees, and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators import objects as ob
from ..operators import outlines, spatial, tiles
from ..sources import files
from .grid_queries import N, filled
from .register import Register
from .spatial_queries import _ALL_EDGES, _OVER, _PLAN, _TREE
from .surface_queries import _LABEL, _dilated, label_of

R = Register()

# -- outlines --------------------------------------------------------------

_WALK = """s AS (SELECT DISTINCT x, y FROM (SELECT x0, x1, y, unnest(range(x0, x1 + 1)) AS x FROM (SELECT x0, x1, unnest(range(y0, y1 + 1)) AS y FROM rects WHERE tag = 5))),
 sd AS (SELECT * FROM (VALUES (0, 1, 0, 0, -1, 0, 0), (1, 0, 1, 1, 0, 1, 0), (2, -1, 0, 0, 1, 1, 1), (3, 0, -1, -1, 0, 0, 1)) v(side, ax, ay, ox, oy, cx, cy)),
 ed AS (SELECT s.x, s.y, side, s.x + ax AS px, s.y + ay AS py, s.x + ax + ox AS qx, s.y + ay + oy AS qy, (s.y * 4294967296 + s.x) * 4 + side AS id, s.x + cx AS vx, s.y + cy AS vy FROM s, sd WHERE (s.x + ox, s.y + oy) NOT IN (SELECT (x, y) FROM s)),
 su AS (SELECT id, vx, vy, CASE WHEN (px, py) NOT IN (SELECT (x, y) FROM s) THEN (y * 4294967296 + x) * 4 + (side + 1) % 4 WHEN (qx, qy) NOT IN (SELECT (x, y) FROM s) THEN (py * 4294967296 + px) * 4 + side ELSE (qy * 4294967296 + qx) * 4 + (side + 3) % 4 END AS nx FROM ed),
 wk(start, id, k) AS (SELECT id, id, 0 FROM su UNION ALL SELECT start, su.nx, k + 1 FROM wk JOIN su USING (id) WHERE su.nx <> start),
 ri AS (SELECT start, min(id) AS ring_id FROM wk GROUP BY start)"""
R.query("r4_ordered_rings", f"WITH {_WALK} SELECT start AS ring_id, k::BIGINT AS ord, vx AS x, vy AS y FROM wk JOIN ri USING (start) JOIN su USING (id) WHERE start = ring_id", "rects")(
    lambda r: outlines.rings(filled(r, 5)))
R.query("r3_ring_kinds", f"""WITH {_WALK}, c AS (SELECT start AS ring_id, k, vx AS x, vy AS y FROM wk JOIN ri USING (start) JOIN su USING (id) WHERE start = ring_id)
SELECT ring_id, count(*) AS n, (sum(x * y2 - x2 * y) / 2)::DOUBLE AS area, sum(x * y2 - x2 * y) > 0 AS "outer" FROM (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM c WINDOW w AS (PARTITION BY ring_id ORDER BY k)) GROUP BY ring_id HAVING abs(sum(x * y2 - x2 * y)) >= 4""", "rects")(
    lambda r: outlines.ring_kinds(outlines.rings(filled(r, 5)), 2.0).select("ring_id", "n", F.col("area").cast("double").alias("area"), "outer"))
R.query("r5_simplified_rings", None, "rings")(lambda r: outlines.simplify(r.select("ring_id", F.col("v").cast("long").alias("ord"), "x", "y"), 0.01))
R.query("j12_hole_to_outer", f"""WITH {_ALL_EDGES}, hc AS (SELECT ring_id AS hole_id, sum(x) / 16e0 AS x, sum(y) / 16e0 AS y FROM rings WHERE ring_id % 2 = 1 GROUP BY ring_id),
 ar AS (SELECT ring_id, abs(sum(ax * ey - ex * ay)) AS area FROM ed WHERE ring_id % 2 = 0 GROUP BY ring_id),
 ins AS (SELECT hole_id, ring_id FROM hc JOIN ed ON ring_id % 2 = 0 AND (ay > y) <> (ey > y) AND x < ax + (y - ay) * (ex - ax)::DOUBLE / (ey - ay) GROUP BY hole_id, ring_id HAVING count(*) % 2 = 1),
 be AS (SELECT hole_id, ring_id AS outer_id FROM (SELECT *, row_number() OVER (PARTITION BY hole_id ORDER BY area DESC, ring_id) AS k FROM ins JOIN ar USING (ring_id)) WHERE k = 1)
SELECT hole_id, outer_id FROM hc LEFT JOIN be USING (hole_id)""", "rings")(
    lambda r: outlines.holes_to_outers(r, F.col("ring_id") % 2 == 1, 256))

# -- tile trees ------------------------------------------------------------

_BOXES = "bx AS (SELECT x0 * 4 AS bx0, y0 * 4 AS by0, x1 * 4 AS bx1, y1 * 4 AS by1 FROM rects WHERE tag = 3 AND group_id < 3)"
_HITS = "(x0 IS NULL OR EXISTS (SELECT 1 FROM bx WHERE x0 <= bx1 AND x1 >= bx0 AND y0 <= by1 AND y1 >= by0))"
_BOX_PLAN = f"{_BOXES}, " + _PLAN.replace(_OVER, _HITS)


def _boxes(r):
    return r.where("tag = 3 AND group_id < 3").selectExpr("x0 * 4 AS x0", "y0 * 4 AS y0", "x1 * 4 AS x1", "y1 * 4 AS y1")


R.query("l3_refine_step", "WITH k AS (SELECT parent_id AS tile_id, count(*) AS kids FROM tiles GROUP BY parent_id), t AS (SELECT tiles.*, can_refine AND kids > 0 IS TRUE AS open FROM tiles LEFT JOIN k USING (tile_id)), w(start_id, tile_id, stop) AS (SELECT p.tile_id, c.tile_id, c.has_mesh OR NOT c.open FROM t p JOIN t c ON c.parent_id = p.tile_id WHERE p.open UNION ALL SELECT start_id, c.tile_id, c.has_mesh OR NOT c.open FROM w JOIN t c ON c.parent_id = w.tile_id WHERE NOT stop) SELECT start_id, tile_id FROM w WHERE stop", "tiles")(
    lambda t: tiles.refine_step(t, t.select("tile_id")))
R.query("l5_plan_report", f"WITH {_TREE}, pl AS (SELECT tile_id FROM tiles WHERE has_mesh AND x0 % 3 = 0), cf AS (SELECT count(*) AS n FROM clo WHERE ancestor IN (SELECT tile_id FROM pl) AND tile_id IN (SELECT tile_id FROM pl)) SELECT count(*) AS n_tiles, (SELECT n FROM cf) AS n_conflicts, (SELECT n FROM cf) = 0 AS valid FROM pl", "tiles")(
    lambda t: tiles.plan_report(t.where("has_mesh AND x0 % 3 = 0"), t))
R.query("l8_plan_for_boxes", f"WITH {_BOX_PLAN} SELECT tile_id, level FROM wk WHERE stop", "tiles", "rects")(lambda t, r: tiles.plan_for_boxes(t, _boxes(r), 17, 19, 128))
R.query("l8_plan_is_valid", f"WITH {_BOX_PLAN} SELECT count(*) AS n_tiles, 0::BIGINT AS n_conflicts, true AS valid FROM wk WHERE stop", "tiles", "rects")(
    lambda t, r: tiles.plan_report(tiles.plan_for_boxes(t, _boxes(r), 17, 19, 128), t))

# -- placed objects --------------------------------------------------------

_NEAR = 4
_FLAGS = f"""{_LABEL}, rd AS (SELECT x, y FROM lb WHERE tag = 4), nr AS ({_dilated("rd", "disc", _NEAR)}),
 fl AS (SELECT o.*, coalesce(tag = 4, false) AS on_road, tag IS NULL AS on_invalid, nr.x IS NOT NULL AS near_road FROM objects o LEFT JOIN lb ON lb.x = o.x AND lb.y = o.y LEFT JOIN nr ON nr.x = o.x AND nr.y = o.y),
 ok AS (SELECT *, CASE WHEN type IN ('hotlap', 'start') THEN on_road WHEN type = 'pit' THEN near_road AND NOT on_road AND NOT on_invalid ELSE true END AS ok FROM fl)"""
_SNAP = """vt AS (SELECT 'road' AS k, x, y FROM rd UNION ALL SELECT 'pit', x, y FROM nr SEMI JOIN (SELECT x, y FROM lb WHERE tag <> 4) USING (x, y)),
 sn AS (SELECT object_id, vt.x AS sx, vt.y AS sy, row_number() OVER (PARTITION BY object_id ORDER BY pow(o.x - vt.x, 2) + pow(o.y - vt.y, 2), vt.y, vt.x) AS r FROM {0} o JOIN vt ON vt.k = CASE WHEN type = 'pit' THEN 'pit' ELSE 'road' END AND abs(o.x - vt.x) <= 12 AND abs(o.y - vt.y) <= 12 AND pow(o.x - vt.x, 2) + pow(o.y - vt.y, 2) <= 144 WHERE NOT ok)"""


def _flagged(o, r):
    return ob.flagged(o, label_of(r), 4, [3, 4], _NEAR, N, N)


R.query("f11_near_road", f"WITH {_FLAGS} SELECT object_id, on_road, on_invalid, near_road FROM fl", "objects", "rects")(
    lambda o, r: _flagged(o, r).select("object_id", "on_road", "on_invalid", "near_road"))
R.query("j6_snap_by_type", f"WITH {_FLAGS}, {_SNAP.format('ok')} SELECT o.object_id, layout, type, coalesce(sx, o.x) AS x, coalesce(sy, o.y) AS y, sx IS NOT NULL AS snapped FROM ok o LEFT JOIN sn ON sn.object_id = o.object_id AND r = 1", "objects", "rects")(
    lambda o, r: ob.snap_misplaced(_flagged(o, r), label_of(r), 4, _NEAR, 12, N, N))
R.query("o1_chosen_candidates", f"""WITH {_FLAGS}, att AS (SELECT *, 1 + object_id // 2 % 3 AS attempt FROM ok), ra AS (SELECT layout, attempt, round(avg(CASE WHEN ok THEN 1e0 ELSE 0e0 END), 6) AS rate FROM att GROUP BY layout, attempt),
 bt AS (SELECT layout, attempt FROM (SELECT *, row_number() OVER (PARTITION BY layout ORDER BY CASE WHEN attempt = 1 AND rate >= 0.9 THEN 1 ELSE 0 END DESC, rate DESC, attempt DESC) AS k FROM ra) WHERE k = 1), ch AS (SELECT att.* FROM att JOIN bt USING (layout, attempt)), {_SNAP.format('ch')}
SELECT o.object_id, layout, type, coalesce(sx, o.x) AS x, coalesce(sy, o.y) AS y, sx IS NOT NULL AS snapped FROM ch o LEFT JOIN sn ON sn.object_id = o.object_id AND r = 1""", "objects", "rects")(
    lambda o, r: ob.snap_misplaced(ob.choose_attempt(_flagged(o, r).withColumn("attempt", F.expr("1 + object_id div 2 % 3")), 0.9), label_of(r), 4, _NEAR, 12, N, N))
R.query("o2_all_objects", "SELECT layout, count(*) AS n, array_to_string(list_filter([CASE WHEN count(*) FILTER (type = 'hotlap') <> 1 THEN 'one hotlap' END, CASE WHEN count(*) FILTER (type = 'pit') = 0 THEN 'a pit' END, CASE WHEN count(*) FILTER (type = 'timing_left') <> count(*) FILTER (type = 'timing_right') THEN 'paired gates' END], lambda e: e IS NOT NULL), '; ') AS errors FROM objects GROUP BY layout", "objects")(
    lambda o: (lambda made: made[0].groupBy("layout").agg(F.count("*").alias("n")).join(made[1], "layout"))(ob.all_objects(*[o.where(w) for w in ("type = 'hotlap'", "type = 'pit'", "type = 'start'", "type LIKE 'timing%'")])))
_NAMED = "nm AS (SELECT layout, type, CASE WHEN type LIKE 'timing%' THEN 'AC_TIME_' || object_id % 1000 || '_L' ELSE 'x' END AS name FROM objects)"
R.query("t4_next_object_name", f"""WITH {_NAMED}, g AS (SELECT layout, max(split_part(name, '_', 3)::BIGINT) + 1 AS n FROM nm WHERE type LIKE 'timing%' GROUP BY layout)
SELECT layout, type, CASE type WHEN 'hotlap' THEN 'AC_HOTLAP_START_' WHEN 'pit' THEN 'AC_PIT_' ELSE 'AC_START_' END || count(*) AS name FROM nm WHERE type NOT LIKE 'timing%' GROUP BY layout, type
UNION ALL SELECT layout, 'timing_left', 'AC_TIME_' || n || '_L' FROM g UNION ALL SELECT layout, 'timing_right', 'AC_TIME_' || n || '_R' FROM g""", "objects")(
    lambda o: ob.next_object_names(o.select("layout", "type", F.when(F.col("type").startswith("timing"), F.concat(F.lit("AC_TIME_"), F.col("object_id") % 1000, F.lit("_L"))).otherwise("x").alias("name"))))
R.query("a18_validate_walls", """WITH w AS (SELECT group_id AS layout, CASE WHEN rect_id % 11 = 0 THEN 'odd' WHEN rect_id % 40 < 2 THEN 'outer' ELSE 'inner' END AS type, rect_id % 9 AS n FROM rects),
 g AS (SELECT layout, count(*) FILTER (type = 'odd') AS t, count(*) FILTER (n < 2) AS s, count(*) FILTER (type = 'outer') AS o FROM w GROUP BY layout)
SELECT layout, array_to_string(list_filter([CASE WHEN t > 0 THEN t || ' walls of an unknown type' END, CASE WHEN s > 0 THEN s || ' walls of under two points' END, CASE WHEN o <> 1 THEN 'one outer wall, not ' || o END], lambda e: e IS NOT NULL), '; ') AS errors FROM g""", "rects")(
    lambda r: ob.validate_walls(r.selectExpr("group_id AS layout", "rect_id AS wall_id", "CASE WHEN rect_id % 11 = 0 THEN 'odd' WHEN rect_id % 40 < 2 THEN 'outer' ELSE 'inner' END AS type", "rect_id % 9 AS n_points"), ["outer", "inner", "tree", "building"]))


# -- sinks -----------------------------------------------------------------

def _folder(df, tag):
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None) or (tempfile.mkdtemp(prefix="spark-sink-") if spark.sparkContext.master.startswith("local[") else spark.conf.get("spark.sql.warehouse.dir"))
    return f"{named.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@R.query("s13_written_by_tag", "SELECT tag, count(*) AS n, sum(x0)::BIGINT AS s FROM (SELECT tag, x0 FROM rects WHERE tag <> 2 UNION ALL SELECT tag, x0 + 1000 FROM rects WHERE tag = 2) GROUP BY tag", "rects")
def written_by_tag(rects):
    """All tags are written, then one of them again with other values; the rest stays."""
    path, rows = _folder(rects, "by-tag"), rects.select("tag", "rect_id", "x0")
    files.write_by_tag(rows, path)
    files.write_by_tag(rows.where("tag = 2").withColumn("x0", F.col("x0") + 1000), path)
    return rects.sparkSession.read.parquet(path).groupBy("tag").agg(F.count("*").alias("n"), F.sum("x0").alias("s"))


@R.query("s17_quarantine", "SELECT 'good' AS kind, count(*) FILTER (rect_id % 10 <> 0) AS n, (sum(x0) FILTER (rect_id % 10 <> 0))::BIGINT AS s FROM rects UNION ALL SELECT 'bad', count(*) FILTER (rect_id % 10 = 0), 0 FROM rects", "rects")
def quarantine(rects):
    """Every tenth line is cut short."""
    path = _folder(rects, "lines")
    rects.select(F.when(F.col("rect_id") % 10 == 0, F.concat(F.lit('{"x0": '), "rect_id")).otherwise(F.to_json(F.struct("rect_id", "x0"))).alias("value")).write.text(path)
    good, bad = files.split_bad_records(rects.sparkSession, path, "rect_id long, x0 long")
    return good.agg(F.lit("good").alias("kind"), F.count("*").alias("n"), F.sum("x0").alias("s")).unionByName(bad.agg(F.lit("bad").alias("kind"), F.count("*").alias("n"), F.lit(0).cast("long").alias("s")))


@R.query("s14_label_grid", f"WITH {_LABEL} SELECT tag, count(*) AS n, sum(x)::BIGINT AS sx, {N} AS width, 22.5::DOUBLE AS top FROM lb WHERE y >= 128 GROUP BY tag", "rects")
def label_grid(rects):
    """Written twice, the second time over the first; the meta row is read beside the pixels."""
    path, lb = _folder(rects, "label-grid"), label_of(rects)
    for rows in (lb, lb.where("y >= 128")):
        files.write_label_grid(rows, path, N, N, {"left": 113.0, "right": 113.5, "top": 22.5, "bottom": 22.0}, {"sand": 1, "road": 5})
    px, meta = files.read_label_grid(rects.sparkSession, path)
    return px.groupBy("tag").agg(F.count("*").alias("n"), F.sum("x").alias("sx")).crossJoin(meta.select(F.col("width").cast("int").alias("width"), "top"))


R.query("j2_rects_on_triangles", "SELECT rect_id FROM rects r WHERE tag <> 4 AND EXISTS (SELECT 1 FROM rects t WHERE t.tag = 4 AND r.x1 >= t.x0 AND r.y1 >= t.y0 AND greatest(r.x0 - t.x0, 0)::DOUBLE / (t.x1 - t.x0) + greatest(r.y0 - t.y0, 0)::DOUBLE / (t.y1 - t.y0) <= 1)", "rects")(
    lambda r: spatial.rects_on_triangles(r.where("tag <> 4").select("rect_id", "x0", "y0", "x1", "y1"), r.where("tag = 4").selectExpr("x0 AS ax", "y0 AS ay", "x1 AS bx", "y0 AS by", "x0 AS cx", "y1 AS cy"), 32).select("rect_id"))
R.query("j24_tileset_origin", """WITH f AS (SELECT group_id AS set_id, rect_id AS ord, CASE WHEN group_id % 3 = 0 OR rect_id % 4 <> 1 THEN NULL ELSE x0 END AS cx, y0, tag, CASE WHEN group_id % 6 = 3 OR rect_id % 2 = 0 THEN NULL ELSE x1 END AS tx, y1 FROM rects),
 c AS (SELECT set_id, arg_min(cx, ord) FILTER (cx IS NOT NULL) AS x, arg_min(y0, ord) FILTER (cx IS NOT NULL) AS y, arg_min(tag, ord) FILTER (cx IS NOT NULL) AS z, arg_min(tx, ord) FILTER (tx IS NOT NULL) AS u, arg_min(y1, ord) FILTER (tx IS NOT NULL) AS v FROM f GROUP BY set_id)
SELECT set_id, coalesce(x, u)::DOUBLE AS x, CASE WHEN x IS NULL THEN v ELSE y END::DOUBLE AS y, CASE WHEN x IS NULL THEN CASE WHEN u IS NULL THEN NULL ELSE 7 END ELSE z END::DOUBLE AS z FROM c""", "rects")(
    lambda r: tiles.tileset_origin(r.selectExpr(
        "group_id AS set_id", "rect_id AS ord", "CASE WHEN group_id % 3 = 0 OR rect_id % 4 <> 1 THEN NULL ELSE array(cast(x0 AS double), cast(y0 AS double), cast(tag AS double)) END AS center",
        "CASE WHEN group_id % 6 = 3 OR rect_id % 2 = 0 THEN NULL ELSE concat(array_repeat(0D, 12), array(cast(x1 AS double), cast(y1 AS double), 7D, 1D)) END AS transform")))
R.query("c31_frame_mode", "SELECT rect_id, CASE tag WHEN 1 THEN 'enu' WHEN 2 THEN CASE WHEN rect_id % 2 = 0 THEN 'tileset_local' ELSE 'error' END ELSE CASE WHEN rect_id % 2 = 0 THEN 'tileset_local' ELSE 'enu' END END AS mode FROM rects", "rects")(
    lambda r: r.select("rect_id", tiles.frame_mode(F.expr("CASE tag WHEN 1 THEN 'enu' WHEN 2 THEN 'tileset_local' ELSE 'auto' END"), F.col("rect_id") % 2 == 0).alias("mode")))
