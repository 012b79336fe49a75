"""Queries over further aggregates, ordered operators and SQL functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sql_functions
from ..operators import tiles, track
from ..operators.rounds import numbered
from .grid_queries import N, filled
from .register import Register

R = Register()
C = F.col

R.query("a6_polygon_groups", "SELECT tag, group_id, count(*) AS n, min(rect_id) AS first FROM rects GROUP BY tag, group_id", "rects")(
    lambda r: r.groupBy("tag", "group_id").agg(F.count("*").alias("n"), F.min("rect_id").alias("first")))
R.query("a7_first_by_tag", "SELECT tag, count(*) AS n, arg_min(group_id, rect_id) AS first_group FROM rects GROUP BY tag", "rects")(
    lambda r: r.groupBy("tag").agg(F.count("*").alias("n"), F.min_by("group_id", "rect_id").alias("first_group")))
R.query("a10_vertex_mean", "SELECT ring_id, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM rings GROUP BY ring_id", "rings")(lambda r: r.groupBy("ring_id").agg(F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy")))
R.query("a12_constant_axis", "SELECT group_id, CASE WHEN max(x0) - min(x0) <= max(y0) - min(y0) THEN 'x' ELSE 'y' END AS axis, round(CASE WHEN max(x0) - min(x0) <= max(y0) - min(y0) THEN avg(x0) ELSE avg(y0) END, 6) AS mean FROM rects GROUP BY group_id", "rects")(
    lambda r: r.groupBy("group_id").agg((F.max("x0") - F.min("x0") <= F.max("y0") - F.min("y0")).alias("isx"), F.avg("x0").alias("ax"), F.avg("y0").alias("ay")).select("group_id", F.when(C("isx"), "x").otherwise("y").alias("axis"), F.round(F.when(C("isx"), C("ax")).otherwise(C("ay")), 6).alias("mean")))
R.query("a15_pit_count", "SELECT layout, x, CASE WHEN count(*) FILTER (type = 'pit') = 0 THEN 12 ELSE count(*) FILTER (type = 'pit') END AS pits FROM objects GROUP BY layout, x", "objects")(
    lambda o: o.groupBy("layout", "x").agg(F.count_if(C("type") == "pit").alias("p")).select("layout", "x", F.when(C("p") == 0, 12).otherwise(C("p")).alias("pits")))
R.query("a25_cover_check", "WITH p AS (SELECT DISTINCT x, y FROM pixels WHERE tag = 1) SELECT count(*) AS target, count(*) FILTER (EXISTS (SELECT 1 FROM rects r WHERE p.x BETWEEN r.x0 AND r.x1 AND p.y BETWEEN r.y0 AND r.y1)) AS covered FROM p", "pixels", "rects")(
    lambda p, r: (lambda t, f: t.join(f, ["x", "y"], "left").agg(F.count("*").alias("target"), F.count("f").alias("covered")))(p.where("tag = 1").select("x", "y").distinct(), filled(r).select("x", "y", F.lit(1).alias("f")).distinct()))
R.query("u2_uncovered", "SELECT DISTINCT x, y FROM pixels p WHERE tag = 1 AND NOT EXISTS (SELECT 1 FROM rects r WHERE p.x BETWEEN r.x0 AND r.x1 AND p.y BETWEEN r.y0 AND r.y1)", "pixels", "rects")(
    lambda p, r: p.where("tag = 1").select("x", "y").distinct().join(filled(r).select("x", "y").distinct(), ["x", "y"], "left_anti"))
R.query("u5_drivable_zone", "SELECT DISTINCT x, y FROM pixels p WHERE EXISTS (SELECT 1 FROM rects r WHERE r.tag = 1 AND p.x BETWEEN r.x0 AND r.x1 AND p.y BETWEEN r.y0 AND r.y1) AND NOT EXISTS (SELECT 1 FROM rects r WHERE r.tag = 2 AND p.x BETWEEN r.x0 AND r.x1 AND p.y BETWEEN r.y0 AND r.y1)", "pixels", "rects")(
    lambda p, r: p.select("x", "y").distinct().join(filled(r, 1).select("x", "y"), ["x", "y"], "left_semi").join(filled(r, 2).select("x", "y"), ["x", "y"], "left_anti"))
R.query("a26_layout_merge", "SELECT type, count(*) AS n, array_to_string(list_sort(list(DISTINCT layout)), ',') AS layouts FROM objects GROUP BY type", "objects")(
    lambda o: o.groupBy("type").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("layout")), ",").alias("layouts")))
R.query("a27_hole_ratio", f"SELECT round(1 - count(*) / {N * N}e0, 6) AS ratio, 1 - count(*) / {N * N}e0 > 0.001 AS holes FROM (SELECT DISTINCT x, y FROM pixels WHERE tag = 1)", "pixels")(
    lambda p: p.where("tag = 1").select("x", "y").distinct().agg((1 - F.count("*") / float(N * N)).alias("r")).select(F.round("r", 6).alias("ratio"), (C("r") > 0.001).alias("holes")))
R.query("a28_height_range", "SELECT g.n_regionkey AS region, coalesce(min(y0), 0) AS lo, coalesce(max(y1), 20) AS hi FROM nation g LEFT JOIN rects r ON r.group_id = g.n_nationkey AND r.tag = 2 AND r.x0 < 3 GROUP BY 1", "nation", "rects")(
    lambda g, r: g.join(r.where("tag = 2 AND x0 < 3"), C("group_id") == C("n_nationkey"), "left").groupBy(C("n_regionkey").alias("region")).agg(F.coalesce(F.min("y0"), F.lit(0)).alias("lo"), F.coalesce(F.max("y1"), F.lit(20)).alias("hi")))
R.query("a29_materials", "SELECT p_type AS material, arg_min(p_name, p_partkey) AS texture FROM part GROUP BY p_type", "part")(lambda p: p.groupBy(C("p_type").alias("material")).agg(F.min_by("p_name", "p_partkey").alias("texture")))
R.query("k1_sorted_masks", "SELECT rect_id, (x0 * y1) % 101 AS score, row_number() OVER (ORDER BY (x0 * y1) % 101 DESC, rect_id) - 1 AS place FROM rects", "rects")(
    lambda r: numbered(r.selectExpr("rect_id", "(x0 * y1) % 101 AS score"), "place", F.desc("score"), "rect_id"))
R.query("k3_tile_sample", """WITH p(tile_id, has_mesh, path) AS (SELECT tile_id, has_mesh, [tile_id] FROM tiles WHERE parent_id IS NULL UNION ALL SELECT t.tile_id, t.has_mesh, list_append(p.path, t.tile_id) FROM p JOIN tiles t ON t.parent_id = p.tile_id)
SELECT tile_id, row_number() OVER (ORDER BY path) - 1 AS place FROM p WHERE has_mesh ORDER BY path LIMIT 30""", "tiles")(
    lambda t: tiles.depth_first(t, 30).withColumn("place", C("place").cast("long")))
R.query("u7_tile_dedupe", "SELECT min(tile_id) AS tile_id FROM tiles WHERE x0 IS NOT NULL GROUP BY x0, y0", "tiles")(lambda t: t.where("x0 IS NOT NULL").groupBy("x0", "y0").agg(F.min("tile_id").alias("tile_id")).select("tile_id"))
R.query("u8_outside_batches", "SELECT layout, count(*) AS n FROM objects WHERE object_id NOT IN (SELECT object_id FROM objects WHERE x % 3 = 0) GROUP BY layout", "objects")(
    lambda o: o.join(o.where("x % 3 = 0").select("object_id"), "object_id", "left_anti").groupBy("layout").agg(F.count("*").alias("n")))
R.query("j11_face_corners", "SELECT a.ring_id, a.v, a.x AS x0, b.x AS x1, c.x AS x2 FROM rings a JOIN rings b ON a.ring_id = b.ring_id AND b.v = (a.v + 1) % 16 JOIN rings c ON a.ring_id = c.ring_id AND c.v = (a.v + 2) % 16", "rings")(
    lambda r: r.select("ring_id", "v", C("x").alias("x0")).join(r.select("ring_id", ((C("v") + 15) % 16).alias("v"), C("x").alias("x1")), ["ring_id", "v"]).join(r.select("ring_id", ((C("v") + 14) % 16).alias("v"), C("x").alias("x2")), ["ring_id", "v"]))
R.query("j23_layout_check", "SELECT n_nationkey AS layout, CASE WHEN n_nationkey % 4 = 0 THEN 'not named' ELSE 'absent' END AS reason FROM nation WHERE n_nationkey NOT IN (SELECT group_id FROM rects WHERE tag = 3 AND x0 < 20)", "nation", "rects")(
    lambda n, r: n.join(r.where("tag = 3 AND x0 < 20"), C("group_id") == C("n_nationkey"), "left_anti").select(C("n_nationkey").alias("layout"), F.when(C("n_nationkey") % 4 == 0, "not named").otherwise("absent").alias("reason")))
R.query("f10_ring_quality", "SELECT a.ring_id FROM rings a JOIN rings b ON a.ring_id = b.ring_id AND b.v = (a.v + 1) % 16 GROUP BY a.ring_id HAVING count(*) >= 3 AND abs(sum(a.x * b.y - b.x * a.y)) / 2 >= 500000", "rings")(
    lambda r: track.ring_measures(r, "ring_id", "v").where("n >= 3 AND abs(area) >= 500000").select("ring_id"))
R.query("c16_ring_chain", "SELECT ring_id, v, round(x / 16000e0 * 1008, 6) AS mx, round(x / 16000e0 * 6100, 6) AS ox, round(100 + x / 16000e0 * 6100 * 0.5, 6) AS gx FROM rings", "rings")(
    lambda r: r.groupBy("ring_id").agg(F.sort_array(F.collect_list(F.struct("v", (C("x") / 16000.0).alias("u")))).alias("ring")).select("ring_id", F.explode(F.transform("ring", lambda p: F.struct(p["v"].alias("v"), F.round(p["u"] * 1008, 6).alias("mx"), F.round(p["u"] * 6100, 6).alias("ox"), F.round(100 + p["u"] * 6100 * 0.5, 6).alias("gx")))).alias("p")).select("ring_id", "p.*"))
R.query("c25_band_to_u8", "SELECT ord, (CASE WHEN max(x * 3) OVER (PARTITION BY clip) > 255 THEN floor(x * 3 / (max(x * 3) OVER (PARTITION BY clip)) * 255) ELSE x * 3 END)::INT AS u8 FROM pixels", "pixels")(
    lambda p: (lambda m: p.select("ord", F.when(m > 255, F.floor(C("x") * 3 / m * 255)).otherwise(C("x") * 3).cast("int").alias("u8")))(F.max(C("x") * 3).over(Window.partitionBy("clip"))))
R.query("c30_fit_to_view", "SELECT layout, idx, round(10 + (x - min(x) OVER w) * 180e0 / greatest(max(x) OVER w - min(x) OVER w, max(y) OVER w - min(y) OVER w), 6) AS vx FROM track WINDOW w AS (PARTITION BY layout)", "track")(
    lambda t: (lambda b: t.join(b, "layout").select("layout", "idx", F.round(10 + (C("x") - C("a")) * 180.0 / C("s"), 6).alias("vx")))(t.groupBy("layout").agg(F.min("x").alias("a"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("s"))))
R.query("c29_fractional_position", """WITH n AS (SELECT layout, count(*) AS n FROM track GROUP BY layout), q AS (SELECT point_id, point_id % 4 AS layout, x / 10007e0 AS f FROM centers), p AS (SELECT point_id, q.layout, n, (f * n + 7) - floor((f * n + 7) / n) * n AS pos FROM q JOIN n ON n.layout = q.layout)
SELECT point_id, round(a.x + (pos - floor(pos)) * (b.x - a.x), 4) AS x FROM p JOIN track a ON a.layout = p.layout AND a.idx = floor(pos) % n JOIN track b ON b.layout = p.layout AND b.idx = (floor(pos) + 1) % n""", "centers", "track")(
    lambda c, t: (lambda p: p.join(t.select("layout", C("idx").alias("i"), C("x").alias("xa")), ["layout", "i"]).join(t.select("layout", C("idx").alias("j"), C("x").alias("xb")), ["layout", "j"]).select("point_id", F.round(C("xa") + C("r") * (C("xb") - C("xa")), 4).alias("x")))(
        c.select("point_id", (C("point_id") % 4).alias("layout"), (C("x") / 10007.0).alias("f")).join(t.groupBy("layout").agg(F.count("*").alias("n")), "layout").withColumn("pos", F.pmod(C("f") * C("n") + 7, C("n").cast("double")))
        .select("point_id", "layout", (F.floor("pos") % C("n")).cast("int").alias("i"), ((F.floor("pos") + 1) % C("n")).cast("int").alias("j"), (C("pos") - F.floor("pos")).alias("r"))))
R.query("w16_hotlap_index", "WITH n AS (SELECT layout, count(*) AS n FROM track GROUP BY layout) SELECT n.layout, coalesce(arg_min(t.idx, (50 - t.idx + n) % n), ((50 - greatest(10, n // 20)) % n + n) % n)::INT AS idx FROM n LEFT JOIN track t ON t.layout = n.layout AND t.x % 97 = 0 AND t.idx <> 50 GROUP BY n.layout, n", "track")(
    lambda t: t.groupBy("layout").agg(F.count("*").alias("n"), F.min(F.when((C("x") % 97 == 0) & (C("idx") != 50), F.struct(C("idx"))) ).alias("_")).join(t, "layout").withColumn("d", F.when((C("x") % 97 == 0) & (C("idx") != 50), F.pmod(50 - C("idx"), C("n")))).groupBy("layout", "n").agg(F.min_by("idx", "d").alias("i"), F.count("d").alias("k"))
    .select("layout", F.when(C("k") > 0, C("i")).otherwise(F.pmod(50 - F.greatest(F.lit(10), F.floor(C("n") / 20)), C("n"))).cast("int").alias("idx")))
R.query("w18_turn_labels", "SELECT layout, idx, 'T' || row_number() OVER (PARTITION BY layout ORDER BY (idx - 20 + 100000) % 500, idx) AS label FROM track WHERE x % 10 = 0", "track")(
    lambda t: t.where("x % 10 = 0").select("layout", "idx", F.concat(F.lit("T"), F.row_number().over(Window.partitionBy("layout").orderBy(F.pmod(C("idx") - 20 + 100000, F.lit(500)), "idx"))).alias("label")))
R.query("w21_camera_spread", "WITH n AS (SELECT layout, count(*) AS n FROM track GROUP BY layout), k AS (SELECT layout, n, unnest(range(0, 8)) AS i FROM n), p AS (SELECT *, trunc(i * (n / 8))::BIGINT % n AS at FROM k) SELECT p.layout, i::INT AS cam, t.x, t.y, f.x AS fx, f.y AS fy FROM p JOIN track t ON t.layout = p.layout AND t.idx = p.at JOIN track f ON f.layout = p.layout AND f.idx = (p.at + n // 50) % n", "track")(
    lambda t: (lambda k: k.join(t.select("layout", C("idx").alias("at"), "x", "y"), ["layout", "at"]).join(t.select("layout", C("idx").alias("to"), C("x").alias("fx"), C("y").alias("fy")), ["layout", "to"]).select("layout", "cam", "x", "y", "fx", "fy"))(
        t.groupBy("layout").agg(F.count("*").alias("n")).withColumn("cam", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("at", ((C("cam") * (C("n") / 8)).cast("int") % C("n")).cast("int")).withColumn("to", ((C("at") + F.floor(C("n") / 50)) % C("n")).cast("int"))))


def packed(items, cap: int):
    """(group_id, rect_id, batch): items in order; a new batch where the running size would pass the cap and the batch isn't empty."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g, batch, used, out = g.sort_values("rect_id"), 0, 0, []
        for s in g["size"]:
            if used and used + s > cap:
                batch, used = batch + 1, 0
            used += s
            out.append(batch)
        return g.assign(batch=out)[["group_id", "rect_id", "batch"]]

    return items.groupBy("group_id").applyInPandas(fold, "group_id int, rect_id long, batch int")


R.query("w22_capped_batches", """WITH q AS (SELECT group_id, rect_id, (x1 - x0) * (y1 - y0) AS size, row_number() OVER (PARTITION BY group_id ORDER BY rect_id) AS i FROM rects),
 f(group_id, rect_id, i, used, batch) AS (SELECT group_id, rect_id, i, size, 0 FROM q WHERE i = 1 UNION ALL SELECT q.group_id, q.rect_id, q.i, CASE WHEN f.used > 0 AND f.used + q.size > 200 THEN q.size ELSE f.used + q.size END, CASE WHEN f.used > 0 AND f.used + q.size > 200 THEN f.batch + 1 ELSE f.batch END FROM f JOIN q ON q.group_id = f.group_id AND q.i = f.i + 1)
SELECT group_id, rect_id, batch FROM f""", "rects")(lambda r: packed(r.select("group_id", "rect_id", ((C("x1") - C("x0")) * (C("y1") - C("y0"))).alias("size")), 200))
R.query("l2_minimum_level_plan", """WITH ti AS (SELECT *, can_refine AND EXISTS (SELECT 1 FROM tiles k WHERE k.parent_id = tiles.tile_id) AS open FROM tiles), wk(tile_id, level, has_mesh, open) AS (SELECT tile_id, level, has_mesh, open FROM ti WHERE parent_id IS NULL UNION ALL SELECT s.tile_id, s.level, s.has_mesh, s.open FROM wk JOIN ti s ON s.parent_id = wk.tile_id AND wk.open AND NOT (wk.has_mesh AND wk.level >= 17))
SELECT tile_id, level FROM wk WHERE has_mesh AND (level >= 17 OR NOT open)""", "tiles")(lambda t: tiles.load_plan(t.withColumn("overlaps", F.lit(False)), 17, 19))


def _with_functions(df, view, query):
    sql_functions.register(df.sparkSession)
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(query)


R.query("v1_sql_functions", "SELECT point_id, round(((degrees(atan2(x - 5000, 5000 - y)) % 360) + 360) % 360, 6) AS bearing, x <= 6000 AND y <= 6000 AND x >= 10 AND y >= 10 AS hit FROM centers", "centers")(
    lambda c: _with_functions(c, "lg_v1", "SELECT point_id, round(bearing_deg(x - 5000, y - 5000), 6) AS bearing, boxes_touch(x, y, x, y, 10, 10, 6000, 6000) AS hit FROM lg_v1"))
R.query("v3_tile_ancestors", "SELECT point_id, 6 - u.i::INT AS z, (x % 64) >> u.i::INT AS x, (y % 64) >> u.i::INT AS y FROM centers, range(0, 7) u(i)", "centers")(
    lambda c: _with_functions(c, "lg_v3", "SELECT c.point_id, a.z, a.x, a.y FROM lg_v3 c, LATERAL tile_ancestors(6, c.x % 64, c.y % 64) a"))
R.query("s4_tileset_scan", "SELECT n_regionkey AS region, depth::INT AS depth, count(*) AS tiles FROM (SELECT n_regionkey, 0 AS depth FROM nation GROUP BY n_regionkey UNION ALL SELECT n_regionkey, 1 FROM nation UNION ALL SELECT n_regionkey, 2 FROM nation JOIN supplier ON s_nationkey = n_nationkey) GROUP BY 1, 2", "nation", "supplier")(
    lambda n, s: _with_functions(
        n.join(s, C("s_nationkey") == C("n_nationkey"), "left").groupBy("n_regionkey", "n_nationkey").agg(F.collect_list(F.when(C("s_suppkey").isNotNull(), F.struct(F.lit(1.5).alias("geometricError"), F.struct(F.concat("s_suppkey", F.lit(".b3dm")).alias("uri")).alias("content")))).alias("children"))
        .groupBy("n_regionkey").agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct(F.lit(9.0).alias("geometricError"), "children")).alias("children")).alias("root"))).alias("doc")),
        "lg_s4", "SELECT d.n_regionkey AS region, t.depth, count(*) AS tiles FROM lg_s4 d, LATERAL flatten_tileset(d.doc) t GROUP BY 1, 2"))
