"""Queries over gates counted from a start line, and over rings and poses in a local frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import local_frame, start_line
from ..operators.rounds import cut
from .function_queries import _E, _N, _X, _Y, _Z
from .grid_queries import N
from .register import Register
from .surface_queries import _BENDS, _LABEL, _MARGIN, _MOST, _SMALL, _TANGENT, _TOL, _reach, road_of, small

R = Register()
_LEAST, _STEPS, _CELL = 20.0, 199, 16

# -- start lines -----------------------------------------------------------

# The first start object of each layout is its start line; even layouts are driven clockwise.
_WAYS = f"""{_SMALL}, {_TANGENT}, {_BENDS},
 sp AS (SELECT layout, arg_min(x, object_id) AS x, arg_min(y, object_id) AS y, layout % 2 = 0 AS clockwise FROM objects WHERE type = 'start' GROUP BY layout),
 ss AS (SELECT sp.layout, sp.clockwise, arg_min(t.idx, (pow(sp.x - t.x, 2) + pow(sp.y - t.y, 2)) * 100000 + t.idx) AS start FROM sp JOIN tk t ON t.layout = sp.layout GROUP BY sp.layout, sp.clockwise),
 ar AS (SELECT a.layout, sum(a.x * b.y - b.x * a.y) > 0 AS winds FROM tk a JOIN nn ON nn.layout = a.layout JOIN tk b ON b.layout = a.layout AND b.idx = (a.idx + 1) % n GROUP BY a.layout),
 wy AS MATERIALIZED (SELECT ss.layout, ss.start, nn.n, CASE WHEN winds = clockwise THEN 1 ELSE -1 END AS sign FROM ss JOIN nn ON nn.layout = ss.layout JOIN ar ON ar.layout = ss.layout),
 bq AS (SELECT b.layout, s, (e + 1) % n AS ex FROM (SELECT layout, min(s) AS s, max(e) AS e FROM (SELECT *, sum(nw) OVER (PARTITION BY layout ORDER BY s) AS b FROM v) GROUP BY layout, b HAVING max(e) - min(s) + 1 >= 2) b JOIN nn ON nn.layout = b.layout),
 tu AS MATERIALIZED (SELECT bq.layout, s, ex, n, sign, start, row_number() OVER (PARTITION BY bq.layout ORDER BY ((sign * (ex - start)) % n + n) % n, s) AS turn FROM bq JOIN wy ON wy.layout = bq.layout)"""
_GATES = f"""{_LABEL}, rd AS MATERIALIZED (SELECT x, y FROM lb WHERE tag >= 3), {_WAYS},
 gp AS (SELECT *, ((sign * (nx - ex)) % n + n) % n AS steps FROM (SELECT *, lead(s) OVER (PARTITION BY layout ORDER BY turn) AS nx FROM tu) WHERE nx IS NOT NULL),
 gl AS (SELECT layout, turn, d, ((ex + sign * d) % n + n) % n AS idx FROM (SELECT *, unnest(CASE WHEN steps > 1 THEN range(1, steps) ELSE [0::BIGINT] END) AS d FROM gp)),
 pc AS MATERIALIZED (SELECT layout, 0 AS number, start AS idx FROM wy UNION ALL SELECT gl.layout, turn, first(gl.idx ORDER BY round(curv, 9), d) FROM gl JOIN q ON q.layout = gl.layout AND q.idx = gl.idx GROUP BY gl.layout, turn),
 pt AS MATERIALIZED (SELECT * FROM tg WHERE (layout, idx) IN (SELECT (layout, idx) FROM pc)), {_reach('pt')},
 en AS (SELECT pt.layout, pt.idx, x, y, tx, ty, max(x - side * (edge + margin) * ty) FILTER (side = 1) AS lx, max(y + side * (edge + margin) * tx) FILTER (side = 1) AS ly,
   max(x - side * (edge + margin) * ty) FILTER (side = -1) AS rx, max(y + side * (edge + margin) * tx) FILTER (side = -1) AS ry FROM pt JOIN re ON re.layout = pt.layout AND re.idx = pt.idx GROUP BY pt.layout, pt.idx, x, y, tx, ty),
 ew AS (SELECT *, round(sqrt(pow(lx - rx, 2) + pow(ly - ry, 2)), 6) < {_LEAST} AS near FROM en),
 gt AS MATERIALIZED (SELECT ew.layout, 'AC_TIME_' || number || CASE k WHEN 1 THEN '_L' ELSE '_R' END AS name, CASE k WHEN 1 THEN 'timing_left' ELSE 'timing_right' END AS type,
   round(CASE WHEN near THEN x - k * {_LEAST / 2}::DOUBLE * ty WHEN k = 1 THEN lx ELSE rx END, 1) AS x, round(CASE WHEN near THEN y + k * {_LEAST / 2}::DOUBLE * tx WHEN k = 1 THEN ly ELSE ry END, 1) AS y,
   round(sign * tx, 4) + 0e0 AS tx, round(sign * ty, 4) + 0e0 AS ty FROM ew JOIN pc ON pc.layout = ew.layout AND pc.idx = ew.idx JOIN wy ON wy.layout = ew.layout, (VALUES (1), (-1)) s(k))"""


def _repair(gate: str) -> str:
    """SQL: CTE fx (layout, name, nx, ny) of the gates that stand on the road."""
    return f"""gr AS (SELECT g.layout, g.name, g.x, g.y FROM {gate} g JOIN rd ON rd.x = round_even(g.x, 0) AND rd.y = round_even(g.y, 0)),
 gf AS (SELECT gr.layout, gr.name, gr.x, gr.y, arg_min(t.idx, (pow(gr.x - t.x, 2) + pow(gr.y - t.y, 2)) * 100000 + t.idx) AS idx FROM gr JOIN tk t ON t.layout = gr.layout GROUP BY gr.layout, gr.name, gr.x, gr.y),
 gd AS (SELECT gf.layout, gf.name, tg.x AS lx, tg.y AS ly, tx, ty, CASE WHEN (gf.x - tg.x) * -ty + (gf.y - tg.y) * tx >= 0 THEN 1 ELSE -1 END AS side FROM gf JOIN tg ON tg.layout = gf.layout AND tg.idx = gf.idx),
 gm AS (SELECT *, round_even(lx - ty * side * d, 0)::BIGINT AS px, round_even(ly + tx * side * d, 0)::BIGINT AS py FROM gd, range(1, {_STEPS + 1}) k(d)),
 gs AS (SELECT layout, name, lx, ly, tx, ty, side, min(d) AS d, arg_min(CASE WHEN px BETWEEN 0 AND {N - 1} AND py BETWEEN 0 AND {N - 1} THEN {_MARGIN} ELSE 0 END, d) AS more FROM gm WHERE NOT EXISTS (SELECT 1 FROM rd WHERE rd.x = px AND rd.y = py) GROUP BY layout, name, lx, ly, tx, ty, side),
 fx AS (SELECT layout, name, round(lx + -ty * side * (d + more), 1) AS nx, round(ly + tx * side * (d + more), 1) AS ny FROM gs)"""


def _starts(objects):
    first = objects.where("type = 'start'").groupBy("layout").agg(F.min_by(F.struct("x", "y"), "object_id").alias("p"))
    return first.select("layout", "p.x", "p.y", (F.col("layout") % 2 == 0).alias("clockwise"))


def _chain(line, objects):
    line = small(line)
    return line, *start_line.surveyed(line, _starts(objects), 3, 0.5, 2, 2, _CELL)


@R.query("w14_gates_from_start", f"WITH {_GATES} SELECT * FROM gt", "track", "objects", "rects")
def gates_from_start(line, objects, rects):
    line, curved, bends, ways = _chain(line, objects)
    g = start_line.gates_from_start(line, cut(start_line.gate_places(curved, bends, ways)), ways, road_of(rects), _MOST, _TOL, _MARGIN, _LEAST, N, N)
    return g.withColumns({"tx": F.col("tx") + 0.0, "ty": F.col("ty") + 0.0})


@R.query("w15_gate_repair", f"""WITH {_LABEL}, rd AS MATERIALIZED (SELECT x, y FROM lb WHERE tag >= 3), {_SMALL}, {_TANGENT},
 ga AS (SELECT layout, object_id AS name, x, y FROM objects WHERE type IN ('timing_left', 'timing_right')), {_repair('ga')}
SELECT ga.layout, ga.name, coalesce(nx, ga.x)::DOUBLE AS x, coalesce(ny, ga.y)::DOUBLE AS y, nx IS NOT NULL AS moved FROM ga LEFT JOIN fx ON fx.layout = ga.layout AND fx.name = ga.name""", "objects", "track", "rects")
def gate_repair(objects, line, rects):
    gate = objects.where("type IN ('timing_left', 'timing_right')").select("layout", F.col("object_id").alias("name"), "x", "y")
    return start_line.repaired(gate, small(line), road_of(rects), float(_MARGIN), _STEPS, _CELL, N, N).select("layout", "name", "x", "y", "moved")


R.query("w16_hotlap_of_bends", f"""WITH {_WAYS}, hb AS (SELECT layout, first(ex ORDER BY ((sign * (start - ex)) % n + n) % n) AS hi FROM tu WHERE ex <> start GROUP BY layout)
SELECT wy.layout, coalesce(hi, ((start - sign * greatest(10, n // 20)) % n + n) % n)::INT AS idx FROM wy LEFT JOIN hb ON hb.layout = wy.layout""", "track", "objects")(
    lambda t, o: start_line.hotlap_places(*_chain(t, o)[2:]))
R.query("w18_turn_labels_of_bends", f"WITH {_WAYS} SELECT layout, s AS enter, ex::INT AS exit, 'T' || turn AS label FROM tu", "track", "objects")(
    lambda t, o: start_line.turns(*_chain(t, o)[2:]).select("layout", "enter", "exit", "label"))


@R.query("o3_rebuilt_objects", f"""WITH {_GATES}, {_repair('gt')},
 hb AS (SELECT layout, first(ex ORDER BY ((sign * (start - ex)) % n + n) % n) AS hi FROM tu WHERE ex <> start GROUP BY layout),
 hp AS (SELECT wy.layout, sign, coalesce(hi, ((start - sign * greatest(10, n // 20)) % n + n) % n)::INT AS idx FROM wy LEFT JOIN hb ON hb.layout = wy.layout)
SELECT hp.layout, 'AC_HOTLAP_START_0' AS name, 'hotlap_start' AS type, x::DOUBLE AS x, y::DOUBLE AS y, round(sign * tx, 4) + 0e0 AS tx, round(sign * ty, 4) + 0e0 AS ty FROM hp JOIN tg ON tg.layout = hp.layout AND tg.idx = hp.idx
UNION ALL SELECT gt.layout, gt.name, type, coalesce(nx, gt.x), coalesce(ny, gt.y), tx, ty FROM gt LEFT JOIN fx ON fx.layout = gt.layout AND fx.name = gt.name
UNION ALL SELECT o.layout, type || '_' || object_id, type, o.x::DOUBLE, o.y::DOUBLE, 0e0, 0e0 FROM objects o JOIN wy ON wy.layout = o.layout WHERE type IN ('pit', 'start')""", "track", "objects", "rects")
def rebuilt(line, objects, rects):
    names = {"hotlap": "hotlap_start"}
    kind = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in names.items()], F.col("type"))
    placed = objects.select("layout", F.concat_ws("_", "type", "object_id").alias("name"), kind.alias("type"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty"))
    out = start_line.rebuild(small(line), _starts(objects), road_of(rects), placed, 3, 0.5, 2, 2, _MOST, _TOL, _MARGIN, _LEAST, _CELL, N, N)
    return out.withColumns({"tx": F.col("tx") + 0.0, "ty": F.col("ty") + 0.0})


# -- local frames ----------------------------------------------------------

_LAT0, _LON0 = 22.71, 113.86
#: Column-major, as all matrices here.
_INVERSE = [2.0, 1.0, 0.0, 0.0, -1.0, 3.0, 0.5, 0.0, 0.25, 0.0, 2.0, 0.0, 10.0, 20.0, 30.0, 1.0]
_OWN = [f"({_INVERSE[r]}::DOUBLE * {_X} + {_INVERSE[4 + r]}::DOUBLE * {_Y} + {_INVERSE[8 + r]}::DOUBLE * {_Z} + {_INVERSE[12 + r]}::DOUBLE)" for r in range(3)]
_MODE = "CASE doc_id % 4 WHEN 1 THEN 'tileset_local' WHEN 2 THEN 'error' ELSE 'enu' END"


def _frames(ids):
    """A frame for each document: every fourth of them in its tile set's axes, every fourth without one."""
    own = F.array(*map(F.lit, _INVERSE))
    return ids.select("doc_id").distinct().selectExpr("doc_id", f"{_MODE} AS mode", f"{_LAT0}D AS lat0", f"{_LON0}D AS lon0", "0D AS h0").withColumn("inverse", F.when(F.col("mode") == "tileset_local", own))


def _documents(rings, x: str, y: str, crs: str):
    """Ring rows as documents' rings."""
    corner = F.sort_array(F.collect_list(F.struct("v", F.expr(x).alias("x"), F.expr(y).alias("y"))))
    g = rings.groupBy("ring_id").agg(corner.alias("r")).withColumn("doc_id", F.col("ring_id") % 40)
    return g.select("doc_id", F.col("ring_id").alias("ord"), F.expr(crs).alias("crs"), F.transform("r", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))


@R.query("c32_rings_to_local", f"""WITH p AS (SELECT ring_id % 40 AS doc_id, ring_id AS ord, v, {_LON0}e0 + x / 1e6 AS lon, {_LAT0}e0 + y / 1e6 AS lat, 0e0 AS acc FROM rings),
 m AS (SELECT *, CASE WHEN doc_id % 5 = 3 THEN 'crs' WHEN doc_id % 4 = 2 THEN 'frame' END AS error, doc_id % 4 = 1 AS own FROM p)
SELECT ord, v::INT AS v, NULL AS error, round(CASE WHEN own THEN {_OWN[0]} ELSE {_E} END, 2) + 0e0 AS x, round(CASE WHEN own THEN {_OWN[1]} ELSE {_N} END, 2) + 0e0 AS z FROM m WHERE error IS NULL
UNION ALL SELECT DISTINCT ord, NULL, error, NULL, NULL FROM m WHERE error IS NOT NULL""", "rings")
def rings_to_local(rings):
    docs = _documents(rings, f"{_LON0}D + x / 1e6D", f"{_LAT0}D + y / 1e6D", "CASE WHEN doc_id % 5 = 3 THEN 'EPSG:32649' WHEN doc_id % 5 = 1 THEN 'EPSG:4326' END")
    out = local_frame.rings_to_local(docs, _frames(docs))
    return out.select("ord", "error", F.posexplode_outer("points").alias("v", "p")).select("ord", "v", "error", (F.round("p.x", 2) + 0.0).alias("x"), (F.round("p.z", 2) + 0.0).alias("z"))


@R.query("c20_crs_repair", f"""WITH p AS (SELECT ring_id % 40 AS doc_id, ring_id AS ord, v, x, y FROM rings),
 s AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'geographic' WHEN doc_id % 5 = 2 OR doc_id % 4 = 2 THEN 'unknown' ELSE 'converted' END AS status FROM p),
 k AS (SELECT 6378137e0 AS a, 0.00669437999014133e0 AS e2, 0.00673949674227643e0 AS ep, 0.00167922038638370e0 AS e1),
 m AS (SELECT ord, v, 300000e0 + x - 500000 AS dx, (2512000e0 + y) / 0.9996 / (a * (1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256)) AS mu, k.* FROM s, k WHERE status = 'converted'),
 f AS (SELECT *, mu + (3 * e1 / 2 - 27 * e1 ** 3 / 32) * sin(2 * mu) + (21 * e1 ** 2 / 16 - 55 * e1 ** 4 / 32) * sin(4 * mu) + 151 * e1 ** 3 / 96 * sin(6 * mu) + 1097 * e1 ** 4 / 512 * sin(8 * mu) AS phi FROM m),
 g AS (SELECT *, ep * cos(phi) ** 2 AS c, tan(phi) ** 2 AS t, a / sqrt(1 - e2 * sin(phi) ** 2) AS n, a * (1 - e2) / (1 - e2 * sin(phi) ** 2) ** 1.5 AS r FROM f),
 h AS (SELECT *, dx / (n * 0.9996) AS d FROM g)
SELECT ord, v::INT AS v, 'converted' AS status, round(111 + degrees((d - (1 + 2 * t + c) * d ** 3 / 6 + (5 - 2 * c + 28 * t - 3 * c ** 2 + 8 * ep + 24 * t ** 2) * d ** 5 / 120) / cos(phi)), 5) AS lon,
 round(degrees(phi - n * tan(phi) / r * (d ** 2 / 2 - (5 + 3 * t + 10 * c - 4 * c ** 2 - 9 * ep) * d ** 4 / 24 + (61 + 90 * t + 298 * c + 45 * t ** 2 - 252 * ep - 3 * c ** 2) * d ** 6 / 720)), 5) AS lat FROM h
UNION ALL SELECT ord, v::INT, status, round(CASE status WHEN 'geographic' THEN {_LON0}e0 + x / 1e6 ELSE 300000e0 + x END, 6), round(CASE status WHEN 'geographic' THEN {_LAT0}e0 + y / 1e6 ELSE 2512000e0 + y END, 6) FROM s WHERE status <> 'converted'""", "rings")
def crs_repair(rings):
    """A third of the documents is stored in degrees already; the rest in UTM, some of it without a code or a frame."""
    docs = _documents(rings, f"CASE WHEN ring_id % 40 % 3 = 0 THEN {_LON0}D + x / 1e6D ELSE 300000D + x END", f"CASE WHEN ring_id % 40 % 3 = 0 THEN {_LAT0}D + y / 1e6D ELSE 2512000D + y END", "CASE WHEN doc_id % 5 <> 2 THEN 'EPSG:32649' END")
    out = local_frame.repair_crs(docs, _frames(docs))
    return out.select("ord", "status", F.posexplode("ring").alias("v", "p")).select("ord", "v", "status", *[F.when(F.col("status") == "converted", F.round(f"p.{c}", 5)).otherwise(F.round(f"p.{c}", 6)).alias(n) for c, n in (("x", "lon"), ("y", "lat"))])


_CORNERS = {"tl": (113.86, 22.72), "tr": (113.88, 22.721), "bl": (113.861, 22.70), "br": (113.881, 22.702)}


def _bilinear(i: int, u: str, v: str) -> str:
    a, b, c, d = (f"{_CORNERS[k][i]}::DOUBLE" for k in ("tl", "tr", "bl", "br"))
    return f"((1 - {u}) * (1 - {v}) * {a} + {u} * (1 - {v}) * {b} + (1 - {u}) * {v} * {c} + {u} * {v} * {d})"


@R.query("o4_object_poses", f"""WITH o AS (SELECT object_id, object_id % 20 AS doc_id, CASE WHEN object_id % 20 % 3 = 0 THEN 'A' ELSE 'B' || layout END AS layout, type || '_' || object_id AS name, x, y, (object_id % 7 - 3)::DOUBLE AS dx, (object_id % 5 - 2)::DOUBLE AS dy FROM objects),
 k AS (SELECT doc_id, count(DISTINCT layout) > 1 AS several FROM o GROUP BY doc_id),
 p AS (SELECT o.*, unnest([0e0, 10e0]) AS far FROM o WHERE doc_id % 4 <> 2),
 w AS (SELECT *, {_bilinear(0, '((x + dx * far) / 256)', '((y + dy * far) / 256)')} AS lon, {_bilinear(1, '((x + dx * far) / 256)', '((y + dy * far) / 256)')} AS lat, 0e0 AS acc FROM p),
 l AS (SELECT *, CASE WHEN doc_id % 4 = 1 THEN {_OWN[0]} ELSE {_E} END AS lx, CASE WHEN doc_id % 4 = 1 THEN {_OWN[1]} ELSE {_N} END AS lz FROM w),
 b AS (SELECT a.doc_id, a.layout, a.name, a.lx AS x, a.lz AS z, f.lx - a.lx AS dx, f.lz - a.lz AS dz FROM l a JOIN l f ON f.object_id = a.object_id AND f.far = 10 WHERE a.far = 0)
SELECT b.doc_id, layout, CASE WHEN several THEN layout || '__' ELSE '' END || name AS name, round(x, 2) + 0e0 AS x, -2e0 AS y, round(z, 2) + 0e0 AS z,
 CASE WHEN sqrt(dx * dx + dz * dz) > 1e-9 THEN round(dx / sqrt(dx * dx + dz * dz), 4) + 0e0 END AS hx, CASE WHEN sqrt(dx * dx + dz * dz) > 1e-9 THEN round(dz / sqrt(dx * dx + dz * dz), 4) + 0e0 END AS hz FROM b JOIN k ON k.doc_id = b.doc_id""", "objects")
def object_poses(objects):
    o = objects.select((F.col("object_id") % 20).alias("doc_id"), F.when(F.col("object_id") % 20 % 3 == 0, "A").otherwise(F.concat(F.lit("B"), "layout")).alias("layout"), F.concat_ws("_", "type", "object_id").alias("name"),
                       F.col("x").alias("px"), F.col("y").alias("py"), (F.col("object_id") % 7 - 3).cast("double").alias("dx"), (F.col("object_id") % 5 - 2).cast("double").alias("dy"))
    corner = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")).alias(k) for k, (x, y) in _CORNERS.items()]
    images = o.select("doc_id").distinct().select("doc_id", F.lit(256).alias("width"), F.lit(256).alias("height"), *corner)
    r = lambda c, k: (F.round(c, k) + 0.0).alias(c)
    return local_frame.object_poses(o, images, _frames(o), -2.0).select("doc_id", "layout", "name", r("x", 2), "y", r("z", 2), r("hx", 4), r("hz", 4))
