"""Queries over clip covers, skeleton graphs, merged fragments and projected meshes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clip_cover, grid, mesh, objects, sampling, skeleton, tiles, tilesets
from .register import Register

R = Register()
SHEET, CLIP, STEP, OVERLAP = 128, 64, 16, 0.1


def _sheet_runs(sheets):
    rows = sheets.select("mask_id", F.explode(F.sequence("y0", "y1")).alias("y"), "x0", "x1").distinct()
    return grid.join_runs(rows, "mask_id")


def _lattice(sheets):
    at = F.explode(F.sequence(F.lit(0), F.lit(SHEET - CLIP), F.lit(STEP)))
    return sheets.select("mask_id").distinct().withColumn("bx", at).withColumn("by", at)


# The cover is a sequence of rounds, which tests/test_covers.py holds against a greedy cover on rasters.
R.query("r9_clip_boxes", None, "sheets")(lambda s: clip_cover.clip_boxes(_sheet_runs(s), SHEET, SHEET, CLIP, CLIP, OVERLAP, points=30))

R.query("r10_score_terms", f"""WITH px AS MATERIALIZED (SELECT DISTINCT mask_id, x, y FROM (SELECT mask_id, y, unnest(range(x0, x1 + 1)) AS x FROM (SELECT mask_id, x0, x1, unnest(range(y0, y1 + 1)) AS y FROM sheets))),
 bx AS (SELECT mask_id, a.i AS bx, b.i AS "by" FROM (SELECT DISTINCT mask_id FROM sheets), range(0, {SHEET - CLIP + 1}, {STEP}) a(i), range(0, {SHEET - CLIP + 1}, {STEP}) b(i)),
 fill AS (SELECT b.mask_id, bx, "by", count(*) AS fill FROM bx b JOIN px p ON p.mask_id = b.mask_id AND p.x BETWEEN bx AND bx + {CLIP - 1} AND p.y BETWEEN "by" AND "by" + {CLIP - 1} GROUP BY ALL),
 ring AS (SELECT i AS pos, CASE i // {CLIP} WHEN 0 THEN i WHEN 1 THEN {CLIP - 1} WHEN 2 THEN {3 * CLIP - 1} - i ELSE 0 END AS dx,
   CASE i // {CLIP} WHEN 0 THEN 0 WHEN 1 THEN i - {CLIP} WHEN 2 THEN {CLIP - 1} ELSE {4 * CLIP - 1} - i END AS dy FROM range(0, {4 * CLIP}) r(i)),
 hit AS (SELECT b.mask_id, bx, "by", pos, p.x IS NOT NULL AS hit FROM bx b CROSS JOIN ring LEFT JOIN px p ON p.mask_id = b.mask_id AND p.x = bx + dx AND p.y = "by" + dy),
 turn AS (SELECT *, coalesce(lag(hit) OVER w, last_value(hit) OVER (PARTITION BY mask_id, bx, "by" ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS before FROM hit WINDOW w AS (PARTITION BY mask_id, bx, "by" ORDER BY pos)),
 n AS (SELECT mask_id, bx, "by", count(*) FILTER (hit) AS border, count(*) FILTER (hit AND NOT before) AS starts FROM turn GROUP BY ALL)
SELECT n.mask_id, n.bx::INT AS bx, n."by"::INT AS "by", coalesce(fill, 0) AS fill, border, CASE WHEN border > 0 THEN greatest(starts, 1) ELSE 0 END AS segments,
  CASE WHEN (CASE WHEN border > 0 THEN greatest(starts, 1) ELSE 0 END) % 2 = 0 THEN -1e0 ELSE -2.5e0 END * border AS evenodd FROM n LEFT JOIN fill f ON f.mask_id = n.mask_id AND f.bx = n.bx AND f."by" = n."by" """, "sheets")(
    lambda s: clip_cover.score_terms(_lattice(s), _sheet_runs(s), CLIP, CLIP).drop("core"))


def _frames(plots):
    """Outlines of rectangles, one pixel wide."""
    rows = plots.select(F.explode(F.array("y0", "y1")).alias("y"), "x0", "x1").select(F.explode(F.sequence("x0", "x1")).alias("x"), "y")
    cols = plots.select(F.explode(F.array("x0", "x1")).alias("x"), "y0", "y1").select("x", F.explode(F.sequence("y0", "y1")).alias("y"))
    return rows.unionByName(cols).distinct()


_FRAMES = """px AS MATERIALIZED (SELECT DISTINCT x, y FROM (SELECT unnest([x0, x1]) AS x, y FROM (SELECT x0, x1, unnest(range(y0, y1 + 1)) AS y FROM plots WHERE tag < 3)
   UNION ALL SELECT x, unnest([y0, y1]) AS y FROM (SELECT y0, y1, unnest(range(x0, x1 + 1)) AS x FROM plots WHERE tag < 3)))"""
# Walks along every chain, from each of its ends; loops without a junction are what no walk has met.
R.query("g20_junction_graph", f"""WITH {_FRAMES}, nb AS MATERIALIZED (SELECT p.y * 4294967296 + p.x AS u, q.y * 4294967296 + q.x AS v, (abs(i.d * j.d))::BIGINT AS slant FROM px p, range(-1, 2) i(d), range(-1, 2) j(d), px q WHERE (i.d <> 0 OR j.d <> 0) AND q.x = p.x + i.d AND q.y = p.y + j.d),
 dg AS MATERIALIZED (SELECT u, count(*) AS n FROM nb GROUP BY u), nodes AS MATERIALIZED (SELECT u FROM dg WHERE n <> 2),
 walk(a, first, before, here, steps, slants) AS (SELECT u, v, u, v, 1::BIGINT, slant FROM nb WHERE u IN (SELECT u FROM nodes)
   UNION ALL SELECT a, first, here, nb.v, steps + 1, slants + nb.slant FROM walk JOIN dg ON dg.u = here AND dg.n = 2 JOIN nb ON nb.u = here AND nb.v <> before),
 met AS (SELECT DISTINCT here FROM walk), loose AS MATERIALIZED (SELECT u, v, slant FROM nb WHERE u IN (SELECT u FROM dg WHERE n = 2) AND u NOT IN (SELECT here FROM met)),
 reach(u, r) AS (SELECT DISTINCT u, u FROM loose UNION SELECT reach.u, loose.v FROM reach JOIN loose ON reach.r = loose.u),
 comp AS (SELECT u, min(r) AS c FROM reach GROUP BY u)
SELECT a, here AS b, first, before AS last, steps, slants FROM walk JOIN nodes ON here = u WHERE a < here OR (a = here AND first < before)
UNION ALL SELECT c, c, min(v) FILTER (l.u = c), max(v) FILTER (l.u = c), (count(*) // 2)::BIGINT, (sum(slant) // 2)::BIGINT FROM loose l JOIN comp ON comp.u = l.u GROUP BY c""", "plots")(
    lambda p: skeleton.junction_graph(_frames(p.where("tag < 3"))))
# A pruning in rounds; tests/test_covers.py walks every branch.
R.query("g19_pruned", None, "plots")(lambda p: skeleton.prune(_frames(p), 9))


def _corners(rects, y):
    corner = F.explode(F.array(*[F.struct(F.lit(k).alias("v"), F.col(a).alias("x"), F.col(b).alias("z")) for k, (a, b) in enumerate([("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")])]))
    return rects.select("*", corner.alias("c")).select("*", "c.v", "c.x", "c.z").withColumn("y", y)


def _quads(rects):
    f = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.lit(a).alias("i0"), F.lit(b).alias("i1"), F.lit(c).alias("i2")) for k, (a, b, c) in enumerate([(0, 1, 2), (0, 2, 3)])]))
    return rects.select("*", f.alias("q")).select("*", "q.*")


def _merged(plots):
    v = _corners(plots, F.col("rect_id") % 3).select("tag", F.col("rect_id").alias("mesh_id"), "v", "x", "y", "z")
    return mesh.merge_fragments(v, _quads(plots).select("tag", F.col("rect_id").alias("mesh_id"), "f", "i0", "i1", "i2"), 3.5)


_MERGED = """r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY rect_id) - 1 AS k FROM plots),
 v AS MATERIALIZED (SELECT tag, 4 * k + i AS v, [x0, x1, x1, x0][i + 1] AS x, rect_id % 3 AS y, [y0, y0, y1, y1][i + 1] AS z FROM r, range(0, 4) c(i)),
 near AS MATERIALIZED (SELECT a.tag, a.v AS a, b.v AS b FROM v a JOIN v b ON a.tag = b.tag AND a.x // 4 - b.x // 4 BETWEEN -1 AND 1 AND abs(a.x - b.x) < 4 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 12.25),
 reach(tag, a, b) AS (SELECT tag, a, b FROM near UNION SELECT e.tag, e.a, n.b FROM reach e JOIN near n ON e.tag = n.tag AND e.b = n.a),
 w AS MATERIALIZED (SELECT tag, a AS v, min(b) AS "to" FROM reach GROUP BY tag, a)"""
R.query("m7_merged_faces", f"""WITH {_MERGED}, f AS (SELECT tag, 2 * k + j AS f, 4 * k AS p0, 4 * k + 1 + j AS p1, 4 * k + 2 + j AS p2 FROM r, range(0, 2) c(j)),
 t AS (SELECT f.tag, f, a."to" AS i0, b."to" AS i1, c."to" AS i2, list_sort([a."to", b."to", c."to"]) AS s FROM f JOIN w a ON a.tag = f.tag AND a.v = p0 JOIN w b ON b.tag = f.tag AND b.v = p1 JOIN w c ON c.tag = f.tag AND c.v = p2)
SELECT tag, f, i0, i1, i2 FROM (SELECT *, row_number() OVER (PARTITION BY tag, s ORDER BY f) AS n FROM t WHERE i0 <> i1 AND i1 <> i2 AND i0 <> i2) WHERE n = 1""", "plots")(lambda p: _merged(p)[1])
R.query("m7_merged_vertices", f"""WITH {_MERGED} SELECT v.tag, v.v, x, y, z FROM v JOIN w ON w.tag = v.tag AND w.v = v.v AND w."to" = w.v""", "plots")(lambda p: _merged(p)[0])

# Terrain: one triangle of each plot of two classes; vertices: points in strips of 100, joined to the next and the seventh after.
_MOVES = [(2, 0), (-2, 0), (0, 2), (0, -2), (6, 0), (-6, 0), (0, 6), (0, -6)]


def _strips(centers, plots):
    side = plots.agg((F.max("x0") + 1).alias("side"))
    v = centers.join(F.broadcast(side)).select(F.expr("CAST(floor(point_id / 100) AS bigint)").alias("mesh_id"), F.col("point_id").alias("v"), (F.col("x") % F.col("side")).cast("double").alias("x"), (F.col("y") % F.col("side")).cast("double").alias("z"))
    e = v.select("mesh_id", "v", F.explode(F.array(F.lit(1), F.lit(7))).alias("d")).select("mesh_id", "v", (F.col("v") + F.col("d")).alias("w"))
    return v, e.where("floor(w / 100) = mesh_id").join(v.select("mesh_id", F.col("v").alias("w")).hint("merge"), ["mesh_id", "w"], "left_semi")


def _terrain(plots):
    p = plots.where("tag > 3")
    corners = _corners(p, F.col("tag") * 10 + F.col("v")).select(F.col("rect_id").alias("mesh_id"), "v", "x", "y", "z")
    return mesh.faces_with_corners(_quads(p).where("f = 0").select(F.col("rect_id").alias("mesh_id"), "f", "i0", "i1", "i2"), corners)


def _projected(c, p):
    v, e = _strips(c, p)
    return v, mesh.project_mesh(v, e, _terrain(p), 16, _MOVES)


_PROJECTED = f"""v AS MATERIALIZED (SELECT point_id // 100 AS mesh_id, point_id AS v, x % side AS x, y % side AS z FROM centers, (SELECT max(x0) + 1 AS side FROM plots)),
 t AS (SELECT x0, y0, x1, y1, tag * 10 AS h FROM plots WHERE tag > 3), moves(k, dx, dz) AS (VALUES (0, 0, 0), {', '.join(f'({k + 1}, {a}, {b})' for k, (a, b) in enumerate(_MOVES))}),
 q AS (SELECT v, k, x + dx AS px, z + dz AS pz FROM v, moves),
 b AS (SELECT v, k, h, (x1 - px)::DOUBLE / (x1 - x0) AS a0, (pz - y0)::DOUBLE / (y1 - y0) AS a2 FROM q JOIN t ON px BETWEEN x0 AND x1 AND pz BETWEEN y0 AND y1),
 hit AS (SELECT v, k, max(h + (1 - a0 - a2) + 2 * a2) AS h FROM b WHERE a0 + a2 <= 1 + 1e-12 GROUP BY v, k),
 s0 AS MATERIALIZED (SELECT v.*, m.h, CASE WHEN m.k = 0 THEN 1 WHEN m.k > 0 THEN 2 END AS phase FROM v LEFT JOIN (SELECT v, arg_min(h, k) AS h, min(k) AS k FROM hit GROUP BY v) m ON m.v = v.v),
 e AS MATERIALIZED (SELECT a.v, b.v AS w FROM v a JOIN v b ON a.mesh_id = b.mesh_id AND abs(a.v - b.v) IN (1, 7)),
 """ + ",\n ".join(f"s{k + 1} AS MATERIALIZED (SELECT mesh_id, s.v, x, z, coalesce(s.h, m.h) AS h, CASE WHEN s.h IS NULL AND m.h IS NOT NULL THEN {3 + k} ELSE phase END AS phase FROM s{k} s LEFT JOIN (SELECT e.v, avg(n.h) AS h FROM e JOIN s{k} n ON n.v = e.w AND n.h IS NOT NULL GROUP BY e.v) m ON m.v = s.v)" for k in range(3))
R.query("m1_projected_mesh", f"WITH {_PROJECTED} SELECT mesh_id, v, x::DOUBLE AS x, round(h, 6) AS y, z::DOUBLE AS z, phase FROM s3 WHERE h IS NOT NULL", "centers", "plots")(
    lambda c, p: _projected(c, p)[1].withColumn("y", F.round("y", 6)))
R.query("m1_projection_counts", f"WITH {_PROJECTED} SELECT mesh_id, count(*) AS total, count(*) FILTER (phase = 1) AS direct, count(*) FILTER (phase = 2) AS beside, count(*) FILTER (phase > 2) AS filled, count(*) FILTER (phase IS NULL) AS orphans FROM s3 GROUP BY mesh_id", "centers", "plots")(
    lambda c, p: mesh.projection_counts(*_projected(c, p)))
R.query("j14_beside", f"WITH {_PROJECTED} SELECT v AS point_id, round(arg_min(h, k), 6) AS h FROM hit WHERE k > 0 GROUP BY v", "centers", "plots")(
    lambda c, p: mesh.project_beside(_strips(c, p)[0].withColumnRenamed("v", "point_id"), _terrain(p), 16, _MOVES).withColumn("h", F.round("h", 6)))
R.query("m2_plain_projection", f"WITH {_PROJECTED} SELECT mesh_id, v.v, x::DOUBLE AS x, round(h, 6) AS y, z::DOUBLE AS z FROM v JOIN hit ON hit.v = v.v AND k = 0", "centers", "plots")(
    lambda c, p: mesh.project_plain(_strips(c, p)[0], _terrain(p), 16).withColumn("y", F.round("y", 6)))


# The whole tree, every node with a mesh, refined from its root over the boxes of one class of plots.
_HULL = "hull AS (SELECT min(x0) - (max(x1) - min(x0)) * 0.1e0 AS hx0, max(x1) + (max(x1) - min(x0)) * 0.1e0 AS hx1, min(y0) - (max(y1) - min(y0)) * 0.1e0 AS hy0, max(y1) + (max(y1) - min(y0)) * 0.1e0 AS hy1 FROM plots WHERE tag = 3)"
R.query("l4_refine_by_mask", f"""WITH {_HULL}, a(tile_id, waits) AS (SELECT tile_id, true FROM tiles WHERE parent_id IS NULL
 UNION ALL SELECT c.tile_id, c.can_refine AND c.level < 19 AND (c.x0 IS NULL OR (c.x0 <= hx1 AND c.x1 >= hx0 AND c.y0 <= hy1 AND c.y1 >= hy0)) FROM a JOIN tiles c ON c.parent_id = a.tile_id, hull WHERE a.waits)
SELECT tile_id, 'loaded' AS status FROM a WHERE NOT waits OR tile_id NOT IN (SELECT parent_id FROM tiles WHERE parent_id IS NOT NULL)""", "tiles", "plots")(
    lambda t, p: tiles.refine_by_mask(t.withColumn("has_mesh", F.lit(True)), t.where("parent_id IS NULL"), p.where("tag = 3").select("x0", "y0", "x1", "y1"), 19))


# Files are nations, nodes their suppliers, the root the first; the two last nodes point to files 2k + 1 and 2k + 2, of nation 24 to file 2, which is above it.
_FILES = """SELECT concat('/sets/n', s_nationkey, '/tileset.json') AS file, s_suppkey AS node, CASE WHEN k = 1 THEN cast(NULL AS bigint) ELSE root END AS parent,
   CASE WHEN k = 1 THEN cast(NULL AS string) WHEN k = n AND s_nationkey = 24 THEN '../n2/./tileset.json' WHEN k > n - 2 THEN concat('../n', 2 * s_nationkey + 1 + n - k, '/tileset.json') ELSE concat('t', s_suppkey, '.b3dm') END AS uri, k % 3 <> 0 AS has_mesh, k < 4 AS can_refine
 FROM (SELECT s_nationkey, s_suppkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS root, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)"""


def _files(supplier):
    return supplier.sparkSession.sql(_FILES.replace("FROM supplier", "FROM {supplier}"), supplier=supplier)


_TOP = "(SELECT min(file) AS file FROM nodes)"
R.query("s4_redirects", f"""WITH nodes AS MATERIALIZED ({_FILES}), n AS MATERIALIZED (SELECT *, CASE WHEN uri LIKE '%.json' THEN '/sets/' || regexp_extract(uri, 'n[0-9]+') || '/tileset.json' END AS target FROM nodes),
 w(file, way, above, seen) AS (SELECT file, '', NULL::VARCHAR, [file] FROM {_TOP}
   UNION ALL SELECT target, way || n.file || '#' || node || '>', way || n.file || '#' || node, list_append(seen, target) FROM w JOIN n ON n.file = w.file WHERE target IN (SELECT file FROM n) AND NOT list_contains(seen, target))
SELECT way || n.file || '#' || node AS tile_id, CASE WHEN parent IS NULL THEN above ELSE way || n.file || '#' || parent END AS parent_id, n.file, node,
  CASE WHEN target IS NULL THEN 'ok' WHEN target NOT IN (SELECT file FROM n) THEN 'missing' WHEN list_contains(seen, target) THEN 'cycle' ELSE 'ok' END AS status FROM w JOIN n ON n.file = w.file""", "supplier")(
    lambda s: (lambda n: tilesets.assemble(n, n.agg(F.min("file").alias("file"))))(_files(s)))
R.query("s5_virtual_root", f"""WITH nodes AS ({_FILES}), e AS (SELECT file FROM nodes GROUP BY file HAVING count(*) = 1 AND NOT bool_or(has_mesh))
SELECT file || '#' || node AS tile_id, CASE WHEN parent IS NULL THEN 'root' ELSE file || '#' || parent END AS parent_id, has_mesh, can_refine FROM nodes WHERE file NOT IN (SELECT file FROM e) UNION ALL SELECT 'root', NULL, false, true""", "supplier")(
    lambda s: tilesets.under_virtual_root(_files(s)))


def _surfaces(rings):
    """Rings with a hole of half their size around the same centre."""
    part = F.explode(F.array(F.lit(0), F.lit(1)))
    half = lambda c, k: F.when(F.col("part") == 0, F.col(c)).otherwise((F.col(c) + (F.col("ring_id") * k % 1000) * 16) / 2).cast("double")
    return rings.withColumn("part", part).select(F.col("ring_id").alias("poly"), "part", "v", half("x", 97).alias("x"), half("y", 61).alias("z"))


def _fans(surfaces):
    """Triangles over vertices v, v + 1 and v + 6 of each outer ring."""
    at = lambda k: surfaces.where("part = 0").select("poly", ((F.col("v") + 16 - k) % 16).alias("f"), F.col("x").alias(f"x{min(k, 2)}"), F.col("z").alias(f"z{min(k, 2)}"))
    return at(0).join(at(1), ["poly", "f"]).join(at(6), ["poly", "f"])


_SURFACES = """sf AS MATERIALIZED (SELECT ring_id AS poly, p AS part, v, CASE p WHEN 0 THEN x ELSE (x + (ring_id * 97 % 1000) * 16) / 2 END::DOUBLE AS x, CASE p WHEN 0 THEN y ELSE (y + (ring_id * 61 % 1000) * 16) / 2 END::DOUBLE AS z FROM rings, range(0, 2) r(p)),
 ed AS MATERIALIZED (SELECT a.poly, a.part, a.x AS ax, a.z AS az, b.x AS bx, b.z AS bz FROM sf a JOIN sf b ON a.poly = b.poly AND a.part = b.part AND b.v = (a.v + 1) % 16)"""
_INSIDE = "count(*) FILTER (part = 0) % 2 = 1 AND count(*) FILTER (part = 1) % 2 = 0"
R.query("r6_sampling_grid", f"""WITH {_SURFACES}, bb AS (SELECT poly, min(x) AS lx, max(x) AS hx, min(z) AS lz, max(z) AS hz FROM sf WHERE part = 0 GROUP BY poly),
 la AS (SELECT poly, i, j, lx + i * 170e0 AS x, lz + j * 170e0 AS z FROM (SELECT *, unnest(range(0, ceil((hz - lz) / 170)::BIGINT + 1)) AS j FROM (SELECT *, unnest(range(0, ceil((hx - lx) / 170)::BIGINT + 1)) AS i FROM bb))),
 ins AS (SELECT la.poly, i, j, la.x, la.z FROM la JOIN ed ON ed.poly = la.poly AND (az > la.z) <> (bz > la.z) AND ax + (la.z - az) * (bx - ax) / (bz - az) > la.x GROUP BY la.poly, i, j, la.x, la.z HAVING {_INSIDE})
SELECT poly, part, v, NULL::BIGINT AS i, NULL::BIGINT AS j, x, z FROM sf
UNION ALL SELECT poly, NULL, NULL, i, j, x, z FROM ins WHERE NOT EXISTS (SELECT 1 FROM sf WHERE sf.poly = ins.poly AND round_even(sf.x / 17, 0) = round_even(ins.x / 17, 0) AND round_even(sf.z / 17, 0) = round_even(ins.z / 17, 0))""", "rings")(
    lambda r: sampling.sampling_grid(_surfaces(r), 170.0))
R.query("f14_faces_by_centroid", f"""WITH {_SURFACES}, fa AS (SELECT a.poly, a.v AS f, a.x AS x0, a.z AS z0, b.x AS x1, b.z AS z1, c.x AS x2, c.z AS z2 FROM sf a JOIN sf b ON b.poly = a.poly AND b.part = 0 AND b.v = (a.v + 1) % 16 JOIN sf c ON c.poly = a.poly AND c.part = 0 AND c.v = (a.v + 6) % 16 WHERE a.part = 0),
 m AS (SELECT *, (x0 + x1 + x2) / 3 AS mx, (z0 + z1 + z2) / 3 AS mz FROM fa)
SELECT m.poly, f, x0, z0, x1, z1, x2, z2 FROM m JOIN ed ON ed.poly = m.poly AND (az > mz) <> (bz > mz) AND ax + (mz - az) * (bx - ax) / (bz - az) > mx GROUP BY ALL HAVING {_INSIDE}""", "rings")(
    lambda r: (lambda s: sampling.faces_inside(_fans(s), s, 256.0))(_surfaces(r)))


def _documents(orders):
    """Documents by customer, with damage by order key: names, vectors and directions that are missing or wrong."""
    docs = orders.groupBy(F.col("o_custkey").alias("layout")).agg(F.min("o_orderkey").alias("k")).select(
        (F.col("layout")).alias("layout"), F.when(F.col("k") % 3 == 0, "clockwise").when(F.col("k") % 3 == 1, "counterclockwise").when(F.col("k") % 2 == 0, "left").alias("direction"))
    none = docs.select((-F.col("layout") - 1).alias("layout"), "direction").where("layout % 10 = 0")
    k = F.col("o_orderkey")
    vector = lambda m: F.when(k % m == 0, F.lit(None)).when(k % m == 1, F.array(k.cast("double"))).when(k % m == 2, F.array(k.cast("double"), F.lit(None))).otherwise(F.array(k.cast("double"), F.lit(1.0)))
    objs = orders.select(F.col("o_custkey").alias("layout"), k.alias("place"), F.when(k % 11 == 0, "").when(k % 11 != 1, "o").alias("name"), vector(17).alias("position"), vector(19).alias("orientation"), F.col("o_orderstatus").alias("type"))
    return docs.unionByName(none), objs


_VECTOR = "CASE WHEN k % {m} < 2 THEN '{c} must have two values' WHEN k % {m} = 2 THEN '{c} has a value that is no number' END"
R.query("a18_document_errors", f"""WITH d AS (SELECT o_custkey AS layout, min(o_orderkey) AS k FROM orders GROUP BY o_custkey), b AS (SELECT layout, k, true AS real FROM d UNION ALL SELECT -layout - 1, k, false FROM d WHERE (-layout - 1) % 10 = 0),
 o AS (SELECT o_custkey AS layout, o_orderkey AS k, o_orderstatus AS type FROM orders),
 e AS (SELECT layout, NULL::BIGINT AS place, CASE WHEN k % 3 = 2 THEN 'unknown direction' END AS error FROM b UNION ALL SELECT layout, NULL, 'no objects' FROM b WHERE NOT real
  UNION ALL SELECT d.layout, NULL, 'no object of type ' || t FROM d, (VALUES ('F'), ('O'), ('P')) v(t) WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.layout = d.layout AND o.type = t)
  UNION ALL SELECT layout, k, CASE WHEN k % 11 < 2 THEN 'no name' END FROM o UNION ALL SELECT layout, k, {_VECTOR.format(m=17, c='position')} FROM o UNION ALL SELECT layout, k, {_VECTOR.format(m=19, c='orientation')} FROM o)
SELECT layout, place, error FROM e WHERE error IS NOT NULL""", "orders")(lambda o: objects.document_errors(*_documents(o), ["F", "O", "P"]))
