"""Queries over file scans, meshes and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators import mesh, spatial
from ..sources import files
from ..streaming import progress
from . import track_queries
from .register import Register

R = Register()


def _mask_documents(rings):
    ring = rings.groupBy("ring_id", "tag").agg(F.sort_array(F.collect_list(F.struct("v", "x", "y"))).alias("r"))
    pts = F.transform("r", lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))
    m = ring.select((F.col("ring_id") % 7).alias("clip"), F.struct(
        F.col("ring_id").alias("n"), F.concat(F.lit("t"), "tag").alias("tag"), (F.col("ring_id") % 10 / 10).alias("prob"),
        F.struct(F.array(pts).alias("include"), F.array(F.slice(pts, 1, F.when(F.col("ring_id") % 2 == 0, 2).otherwise(5))).alias("exclude")).alias("polygons")).alias("m"))
    return m.groupBy("clip").agg(F.to_json(F.struct(F.sort_array(F.collect_list("m")).alias("masks"))).alias("json"))


R.query("s1_mask_polygons", """WITH m AS (SELECT ring_id, ring_id % 7 AS clip, 't' || min(tag) AS tag, ring_id % 10 / 10 AS prob, row_number() OVER (PARTITION BY ring_id % 7 ORDER BY ring_id) - 1 AS mask_index FROM rings GROUP BY ring_id)
SELECT clip, mask_index::INT AS mask_index, 'include' AS kind, tag, round(prob, 6) AS prob, 16 AS points FROM m UNION ALL SELECT clip, mask_index::INT, 'exclude', tag, round(prob, 6), 5 FROM m WHERE ring_id % 2 = 1""", "rings")(
    lambda r: files.parse_mask_polygons(_mask_documents(r)).select("clip", "mask_index", "kind", "tag", F.round("prob", 6).alias("prob"), F.size("ring").alias("points")))


def _blobs(docs):
    h = lambda n: F.lpad(F.hex(n.cast("long")), 8, "0")
    le = lambda n: F.unhex(F.concat(*[F.substring(h(n), k, 2) for k in (7, 5, 3, 1)]))
    fill = (F.col("n_chars") % 64).cast("int")
    body = F.concat(F.encode(F.repeat(F.lit("."), fill), "UTF-8"), F.when(F.col("doc_id") % 7 == 3, F.encode(F.lit("none"), "UTF-8")).otherwise(F.encode(F.lit("glTF"), "UTF-8")), F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    magic = F.encode(F.when(F.col("doc_id") % 7 == 1, "bad!").otherwise("b3dm"), "UTF-8")
    size = F.length(body) + 28 + F.when(F.col("doc_id") % 7 == 2, 1).otherwise(0)
    tables = F.when(F.col("doc_id") % 7 == 4, F.lit(99_999_999)).otherwise(fill)
    whole = F.concat(magic, le(F.lit(1)), le(size), le(tables), le(F.lit(0)), le(F.lit(0)), le(F.lit(0)), body)
    return docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 == 5, F.substring(whole, 1, 20)).otherwise(whole).alias("content"))


R.query("s6_b3dm", """SELECT doc_id AS id, CASE doc_id % 7 WHEN 1 THEN 'bad magic' WHEN 2 THEN 'length differs' WHEN 3 THEN 'no model' WHEN 4 THEN 'tables exceed the file' WHEN 5 THEN 'truncated header' END AS error,
 CASE WHEN doc_id % 7 IN (0, 6) THEN 28 + n_chars % 64 END AS glb_offset, CASE WHEN doc_id % 7 IN (0, 6) THEN 4 + octet_length(encode(text)) END::BIGINT AS glb_bytes FROM documents""", "documents")(lambda d: files.parse_b3dm(_blobs(d)))
R.query("s9_position_log", "SELECT session_id AS file, seq AS line, round(t, 6) AS t, round(lat, 9) AS lat, round(lon, 9) AS lon FROM telemetry WHERE seq % 11 <> 5", "telemetry")(
    lambda t: files.parse_position_log(
        t.select(F.col("session_id").alias("file"), F.col("seq").alias("line"), F.when(F.col("seq") % 11 == 5, F.concat_ws(",", "lon", F.lit("n/a"), "t")).otherwise(F.concat_ws(",", "lon", "lat", "t")).alias("value"))
        .union(t.select("session_id", F.lit(0).cast("long"), F.lit("﻿Longitude, latitude ,TimeStamp")).distinct()).union(t.select("session_id", F.lit(-1).cast("long"), F.lit("# made by")).distinct())
    ).select("file", "line", F.round("t", 6).alias("t"), F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon")))
R.query("s10_mask_names", "SELECT ord, 'clip-' || clip AS base, CASE WHEN x % 2 = 0 THEN 't' || tag END AS tag, (y::INT) AS mask_index, round(prob / 10, 6) AS prob FROM pixels", "pixels")(
    lambda p: p.select("ord", F.concat(F.lit("clip-"), "clip", F.when(F.col("x") % 2 == 0, F.concat(F.lit("_t"), "tag")).otherwise(""), F.lit("_mask"), "y", F.lit("_prob("), F.round(F.col("prob") / 10, 6), F.lit(").png")).alias("name")).transform(
        files.parse_mask_names).select("ord", "base", "tag", "mask_index", F.round("prob", 6).alias("prob")))
R.query("s12_camera_file", "SELECT layout AS file, 'CAM_' || (idx // 4) AS section, 'K' || (idx % 4) AS key, x || ', ' || y AS value FROM track WHERE idx % 4 > 0", "track")(
    lambda t: files.parse_camera_file(t.select(F.col("layout").alias("file"), F.col("idx").alias("line"), F.when(F.col("idx") % 4 == 0, F.concat(F.lit("[CAM_"), F.expr("idx div 4"), F.lit("]"))).otherwise(F.concat(F.lit("K"), F.col("idx") % 4, F.lit(" = "), "x", F.lit(", "), "y")).alias("value"))))
R.query("s16_pending_tags", "SELECT DISTINCT tag FROM rects WHERE tag IN (SELECT tag FROM pixels) AND tag NOT IN (SELECT tag FROM pixels WHERE x = 7 AND tag < 3)", "rects", "pixels")(
    lambda r, p: files.pending(r.select("tag").distinct(), p.where("x = 7 AND tag < 3").select("tag"), p.select("tag")))

R.query("r7_lattice", "SELECT rect_id AS box_id, i::INT AS i, j::INT AS j, x0 + i * 3 AS x, y0 + j * 3 AS y FROM (SELECT *, unnest(range(0, ceil((y1 - y0) / 3)::BIGINT)) AS j FROM (SELECT *, unnest(range(0, ceil((x1 - x0) / 3)::BIGINT)) AS i FROM rects))", "rects")(
    lambda r: mesh.lattice(r.withColumnRenamed("rect_id", "box_id"), 3))


def _vertices(rects):
    corner = F.explode(F.array(*[F.struct(F.lit(k).alias("v"), F.col(a).alias("x"), F.col(b).alias("z")) for k, (a, b) in enumerate([("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")])]))
    return rects.select(F.col("rect_id").alias("mesh_id"), corner.alias("c"), "tag").select("mesh_id", "c.v", "c.x", (F.col("tag") * 10 + F.col("c.v")).alias("y"), "c.z")


def _faces(rects):
    f = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.lit(a).alias("i0"), F.lit(b).alias("i1"), F.lit(c).alias("i2")) for k, (a, b, c) in enumerate([(0, 1, 2), (0, 2, 3), (2, 1, 0), (1, 1, 3)])]))
    return rects.select(F.col("rect_id").alias("mesh_id"), f.alias("f")).select("mesh_id", "f.*")


R.query("f13_face_area", "SELECT rect_id AS mesh_id, f, round(CASE WHEN f = 3 THEN 0 ELSE sqrt(pow((x1 - x0) * (y1 - y0), 2) + pow(y1 - y0, 2) + pow(x1 - x0, 2) * CASE f WHEN 1 THEN 9 ELSE 1 END) / 2 END, 4) AS area FROM rects, range(0, 4) r(f)", "rects")(
    lambda r: mesh.face_area(mesh.faces_with_corners(_faces(r), _vertices(r))).select("mesh_id", "f", F.round("area", 4).alias("area")))
R.query("a22_distinct_faces", "SELECT rect_id AS mesh_id, f::INT AS f FROM rects, range(0, 2) r(f)", "rects")(lambda r: mesh.distinct_faces(_faces(r)).select("mesh_id", "f"))
R.query("a22_weld", """WITH near AS (SELECT a.rect_id AS a, b.rect_id AS b FROM rects a JOIN rects b ON a.group_id = b.group_id AND abs(a.x0 - b.x0) <= 9 AND pow(a.x0 - b.x0, 2) + pow(a.y0 - b.y0, 2) + pow(a.x1 - b.x1, 2) <= 81),
 reach(a, b) AS (SELECT a, b FROM near UNION SELECT r.a, e.b FROM reach r JOIN near e ON r.b = e.a)
SELECT a AS v, min(b) AS "to" FROM reach GROUP BY a""", "rects")(
    lambda r: mesh.weld(r.select(F.col("group_id").alias("mesh_id"), F.col("rect_id").alias("v"), F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("x1").alias("z")), 9).select("v", "to"))
R.query("m8_orphan_vertices", "SELECT rect_id AS mesh_id, 3 AS v FROM rects WHERE rect_id % 2 = 0", "rects")(lambda r: mesh.orphan_vertices(_vertices(r), _faces(r).where("mesh_id % 2 = 1 OR f = 0")).select("mesh_id", "v"))
R.query("j13_vertical_projection", """WITH p AS (SELECT point_id, x % 256 AS x, y % 256 AS z FROM centers),
 t AS (SELECT rect_id, tag * 10 AS h0, tag * 10 + 1 AS h1, tag * 10 + 2 AS h2, x0, y0, x1, y0 AS z1, x1 AS x2, y1 AS z2 FROM rects),
 b AS (SELECT point_id, h0, h1, h2, ((z1 - z2) * (x - x2) + (x2 - x1) * (z - z2))::DOUBLE / ((z1 - z2) * (x0 - x2) + (x2 - x1) * (y0 - z2)) AS a, ((z2 - y0) * (x - x2) + (x0 - x2) * (z - z2))::DOUBLE / ((z1 - z2) * (x0 - x2) + (x2 - x1) * (y0 - z2)) AS b FROM p JOIN t ON x BETWEEN x0 AND x1 AND z BETWEEN y0 AND z2)
SELECT point_id, round(max(a * h0 + b * h1 + (1 - a - b) * h2), 6) AS h FROM b WHERE a >= 0 AND b >= 0 AND a + b <= 1 GROUP BY point_id""", "centers", "rects")(
    lambda c, r: mesh.project_down(c.select("point_id", (F.col("x") % 256).alias("x"), (F.col("y") % 256).alias("z")), mesh.faces_with_corners(_faces(r).where("f = 0"), _vertices(r)), 16).select("point_id", F.round("h", 6).alias("h")))
R.query("j22_objects_on_terrain", """WITH p AS (SELECT object_id AS point_id, x, y AS z FROM objects),
 t AS (SELECT tag * 10 AS h0, tag * 10 + 1 AS h1, tag * 10 + 2 AS h2, x0, y0, x1, y0 AS z1, x1 AS x2, y1 AS z2 FROM rects),
 b AS (SELECT point_id, h0, h1, h2, ((z1 - z2) * (x - x2) + (x2 - x1) * (z - z2))::DOUBLE / ((z1 - z2) * (x0 - x2) + (x2 - x1) * (y0 - z2)) AS a, ((z2 - y0) * (x - x2) + (x0 - x2) * (z - z2))::DOUBLE / ((z1 - z2) * (x0 - x2) + (x2 - x1) * (y0 - z2)) AS b FROM p JOIN t ON x BETWEEN x0 AND x1 AND z BETWEEN y0 AND z2),
 h AS (SELECT point_id, min(a * h0 + b * h1 + (1 - a - b) * h2) AS h FROM b WHERE a >= 0 AND b >= 0 AND a + b <= 1 GROUP BY point_id)
SELECT p.point_id, round(coalesce(h - 2, 100), 6)::DOUBLE AS y, h IS NOT NULL AS hit FROM p LEFT JOIN h ON h.point_id = p.point_id""", "objects", "rects")(
    lambda o, r: mesh.drop_to_terrain(o.select(F.col("object_id").alias("point_id"), "x", F.lit(100.0).alias("y"), F.col("y").alias("z")), mesh.faces_with_corners(_faces(r).where("f = 0"), _vertices(r)), 16, 2.0)
    .select("point_id", F.round("y", 6).alias("y"), "hit"))


@R.query("a23_mesh_quality", """SELECT rect_id AS mesh_id, c.k AS "check", CASE c.k WHEN 'y_range' THEN CASE tag WHEN 1 THEN 0.25 ELSE 3 END WHEN 'degenerate' THEN rect_id % 2 ELSE 4 END::DOUBLE AS value,
 CASE c.k WHEN 'y_range' THEN tag <> 1 WHEN 'degenerate' THEN rect_id % 2 = 0 WHEN 'vertex_count' THEN x1 % 3 <> 0 ELSE true END AS ok
FROM rects, (VALUES ('exists'), ('faces'), ('y_range'), ('vertex_count'), ('degenerate')) c(k)""", "rects")
def mesh_quality(rects):
    """Every mesh, of which some are flat, some lack a vertex and half have a degenerate face."""
    # The height of a vertex is 10 * tag + v.
    v = _vertices(rects).withColumn("y", F.when(F.col("y") - F.col("v") == 10, F.when(F.col("v") == 3, 0.25).otherwise(0.0)).otherwise(F.col("y").cast("double")))
    f = _faces(rects).withColumn("i1", F.when((F.col("f") == 3) & (F.col("mesh_id") % 2 == 0), 2).otherwise(F.col("i1")))
    stated = rects.select(F.col("rect_id").alias("mesh_id"), F.expr("CASE WHEN x1 % 3 = 0 THEN 5 ELSE 4 END").alias("n_vertices"))
    return mesh.quality_report(stated, v, f)


R.query("a21_mesh_budget", "SELECT rect_id AS mesh_id, (x1 * 40 + y1 * 20)::BIGINT AS bytes FROM rects", "rects")(lambda r: mesh.budget(r.select(F.col("rect_id").alias("mesh_id"), F.col("x1").alias("n_vertices"), F.col("y1").alias("n_faces"))))
R.query("m4_median_split", """WITH a AS (SELECT tag, count(*) AS n, max(x0) - min(x0) >= max(y0) - min(y0) AS wide FROM rects GROUP BY tag) SELECT rect_id AS item_id,
 CASE WHEN row_number() OVER (ORDER BY CASE WHEN (SELECT max(x0) - min(x0) >= max(y0) - min(y0) FROM rects) THEN x0 ELSE y0 END, rect_id) <= floor(count(*) OVER () / 2) THEN '0' ELSE '1' END AS piece FROM rects""", "rects")(
    lambda r: mesh.median_split(r.select(F.col("rect_id").alias("item_id"), F.col("x0").alias("x"), F.col("y0").alias("y")), 1, 1).select("item_id", "piece"))


def _cuts(limit: int, most: int) -> str:
    """Rounds t0, t1, .. of cuts at the middle of the wider axis."""
    cut = "CASE WHEN n > {0} THEN piece || CASE WHEN row_number() OVER (PARTITION BY piece ORDER BY CASE WHEN wide THEN x ELSE y END, item_id) <= n // 2 THEN '0' ELSE '1' END ELSE piece END"
    w = "OVER (PARTITION BY piece)"
    rounds = [f"t{k + 1} AS MATERIALIZED (SELECT item_id, x, y, {cut.format(limit)} AS piece FROM (SELECT *, count(*) {w} AS n, max(x) {w} - min(x) {w} >= max(y) {w} - min(y) {w} AS wide FROM t{k}))" for k in range(most)]
    return ",\n ".join(["t0 AS (SELECT rect_id AS item_id, x0 AS x, y0 AS y, '' AS piece FROM rects)", *rounds])


R.query("m4_median_split_to_limit", f"WITH {_cuts(20, 10)} SELECT item_id, piece, count(*) OVER (PARTITION BY piece) > 20 AS too_large FROM t10", "rects")(
    lambda r: mesh.median_split(r.select(F.col("rect_id").alias("item_id"), F.col("x0").alias("x"), F.col("y0").alias("y")), 20))


def _folder(df, tag):
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None) or (tempfile.mkdtemp(prefix="spark-stream-") if spark.sparkContext.master.startswith("local[") else spark.conf.get("spark.sql.warehouse.dir"))
    return f"{named.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


_EVENTS = """s AS (SELECT run, ord, value, max(CASE WHEN ord % 5 = 0 THEN ord END) OVER (PARTITION BY run ORDER BY ord) AS h, lag(ord) OVER (PARTITION BY run ORDER BY ord) AS p FROM log_lines),
 ev AS (SELECT run, ord, h || 'a' AS stage, least((ord * 17) % 120, 100)::INT AS pct FROM s WHERE ord % 5 <> 0 UNION ALL SELECT run, ord, (ord - 5) || 'a', 100 FROM s WHERE ord % 5 = 0 AND ord > 0)"""


def _events(lines):
    path = _folder(lines, "progress")
    lines.write.parquet(f"{path}/in")
    stream = lines.sparkSession.readStream.schema(lines.schema).parquet(f"{path}/in")
    return progress.run_to_table(progress.progress_events(stream), path)


R.query("x1_progress_stream", f"WITH {_EVENTS} SELECT run, ord, coalesce(stage, '') AS stage, pct FROM ev", "log_lines")(_events)
R.query("x2_progress_throttle", f"""WITH {_EVENTS}, q AS (SELECT *, row_number() OVER (PARTITION BY run, stage ORDER BY ord) AS i FROM ev),
 f(run, stage, i, ord, pct, last, kept) AS (SELECT run, stage, i, ord, pct, pct, true FROM q WHERE i = 1 UNION ALL SELECT q.run, q.stage, q.i, q.ord, q.pct, CASE WHEN abs(q.pct - f.last) >= 20 THEN q.pct ELSE f.last END, abs(q.pct - f.last) >= 20 FROM f JOIN q ON q.run = f.run AND q.stage = f.stage AND q.i = f.i + 1)
SELECT run, ord, stage, pct FROM f WHERE kept""", "log_lines")(lambda lines: progress.throttled(_events(lines), 20))
R.query("x3_run_close", f"""WITH {_EVENTS}, l AS (SELECT run, stage, arg_max(pct, ord) AS pct FROM ev GROUP BY run, stage)
SELECT run, stage, CASE WHEN run % 3 = 0 OR pct = 100 THEN 'complete' ELSE 'error' END AS status FROM l""", "log_lines")(
    lambda lines: progress.close_runs(_events(lines), lines.select("run", (F.col("run") % 3).alias("code")).distinct()))


def _segments(points):
    path = _folder(points, "segments")
    points.write.parquet(f"{path}/in")
    return progress.run_to_table(progress.segment_stream(points.sparkSession.readStream.schema(points.schema).parquet(f"{path}/in")), path)


R.query("x4_segment_stream", None, "telemetry")(_segments)
R.sql["x4_segment_stream"] = track_queries.R.sql["w1_segments"]
R.query("r2_triangle_fill", "SELECT rect_id AS f, x, y FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM rects)) WHERE (x - x0) * (y1 - y0) + (y - y0) * (x1 - x0) <= (x1 - x0) * (y1 - y0)", "rects")(
    lambda r: mesh.fill_triangles(r.selectExpr("rect_id AS f", "x0 AS ax", "y0 AS ay", "x1 AS bx", "y0 AS by", "x0 AS cx", "y1 AS cy")))
R.query("r8_wall_quads", "SELECT a.ring_id, a.x AS ax, a.y AS ay, p::INT AS part, b.x AS x1, CASE WHEN p = 0 THEN b.x ELSE a.x END AS x2 FROM rings a JOIN rings b ON a.ring_id = b.ring_id AND b.v = (a.v + 1) % 16, range(0, 2) r(p)", "rings")(
    lambda r: mesh.wall_quads(spatial.ring_edges(r, "ring_id", "v"), "ring_id", 0.0, 3.0).select("ring_id", "ax", "ay", "part", "x1", "x2"))
R.query("j8_tileset_pick", "SELECT point_id, coalesce(min(rect_id) FILTER (c.x % 240 BETWEEN x0 AND x1 AND c.y % 240 BETWEEN y0 AND y1), min(rect_id)) AS box_id FROM centers c JOIN rects r ON r.group_id = c.group_id GROUP BY point_id", "centers", "rects")(
    lambda c, r: mesh.pick_box(c.select("point_id", "group_id", (F.col("x") % 240).alias("x"), (F.col("y") % 240).alias("y")), r.select("group_id", F.col("rect_id").alias("box_id"), "x0", "y0", "x1", "y1"), "group_id"))
