"""Queries over repairs of label rasters, track widths and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates, grid, surface, track
from .grid_queries import N, filled
from .register import Register
from .track_queries import _CURVE

R = Register()
_LABEL = "lb AS (SELECT x, y, max(tag) AS tag FROM (SELECT tag, y, unnest(range(x0, x1 + 1)) AS x FROM (SELECT tag, x0, x1, unnest(range(y0, y1 + 1)) AS y FROM rects)) GROUP BY x, y)"
_CANVAS = f"cv AS (SELECT a.i AS x, b.i AS y FROM range(0, {N}) a(i), range(0, {N}) b(i))"


def _dilated(source: str, kind: str, r: int) -> str:
    """SQL: pixels of a CTE grown by a kernel, on the canvas."""
    rows = " OR ".join(f"(dy = {d} AND abs(dx) <= {h})" for d, h in grid.half_widths(kind, r))
    return f"SELECT DISTINCT x + dx AS x, y + dy AS y FROM {source}, range(-{r}, {r + 1}) a(dx), range(-{r}, {r + 1}) b(dy) WHERE ({rows}) AND x + dx BETWEEN 0 AND {N - 1} AND y + dy BETWEEN 0 AND {N - 1}"


def _eroded(name: str, source: str, kind: str, r: int) -> str:
    """SQL: two CTEs that shrink a CTE; the border of the canvas does not erode."""
    return f"{name}_un AS (SELECT x, y FROM cv EXCEPT SELECT x, y FROM {source}), {name} AS (SELECT x, y FROM {source} EXCEPT ({_dilated(name + '_un', kind, r)}))"


def _regions(name: str, source: str) -> str:
    """SQL: CTEs ending in ``name`` (x, y, comp), regions in eight directions."""
    return f"""{name}_r AS (SELECT y, min(x) AS x0, max(x) AS x1, y * 4294967296 + min(x) AS id FROM (SELECT x, y, x - row_number() OVER (PARTITION BY y ORDER BY x) AS g FROM {source}) GROUP BY y, g),
 {name}_e AS (SELECT a.id AS a, b.id AS b FROM {name}_r a JOIN {name}_r b ON abs(a.y - b.y) = 1 AND a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1),
 {name}_c(a, b) AS (SELECT id, id FROM {name}_r UNION SELECT c.a, e.b FROM {name}_c c JOIN {name}_e e ON c.b = e.a),
 {name} AS (SELECT y, unnest(range(x0, x1 + 1)) AS x, comp FROM {name}_r JOIN (SELECT a, min(b) AS comp FROM {name}_c GROUP BY a) ON a = id)"""


def label_of(rects):
    return filled(rects).groupBy("x", "y").agg(F.max("tag").alias("tag"))


R.query("g9_absorb_narrow", f"""WITH {_LABEL}, {_CANVAS}, s AS (SELECT x, y FROM lb WHERE tag = 3), rd AS (SELECT x, y FROM lb WHERE tag = 5), {_eroded("er", "s", "disc", 2)},
 op AS ({_dilated("er", "disc", 2)}), wide AS ({_dilated("op", "rect", 2)}), nar AS (SELECT * FROM s EXCEPT SELECT * FROM wide), {_regions("nc", "nar")},
 near AS ({_dilated("rd", "disc", 1)}), mv AS (SELECT x, y FROM nc WHERE comp IN (SELECT comp FROM nc JOIN near USING (x, y)))
SELECT x, y, CASE WHEN tag = 3 AND (x, y) IN (SELECT (x, y) FROM mv) THEN 5 ELSE tag END AS tag FROM lb""", "rects")(
    lambda r: surface.absorb_narrow(label_of(r), 3, 5, 2, 1, N, N))
R.query("g10_absorb_orphans", f"""WITH {_LABEL}, rd AS (SELECT x, y FROM lb WHERE tag = 5), s AS (SELECT x, y FROM lb WHERE tag = 3), {_regions("kc", "s")}, near AS ({_dilated("rd", "disc", 2)}),
 orp AS (SELECT * FROM kc WHERE comp NOT IN (SELECT comp FROM kc JOIN near USING (x, y))),
 rg AS (SELECT DISTINCT x + dx AS x, y + dy AS y, comp FROM orp, range(-1, 2) a(dx), range(-1, 2) b(dy)),
 ct AS (SELECT comp, tag, count(*) AS n FROM rg JOIN lb USING (x, y) WHERE tag <> 3 GROUP BY comp, tag), bt AS (SELECT comp, tag FROM (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY n DESC, tag) AS r FROM ct) WHERE r = 1)
SELECT lb.x, lb.y, coalesce(bt.tag, lb.tag) AS tag FROM lb LEFT JOIN orp ON lb.tag = 3 AND orp.x = lb.x AND orp.y = lb.y LEFT JOIN bt ON bt.comp = orp.comp WHERE orp.comp IS NULL OR bt.tag IS NOT NULL""", "rects")(
    lambda r: surface.absorb_orphans(label_of(r), 3, 5, 2, N, N))

_GAP_ROUNDS, _last = [], "lb"
for _k, (_how, _tag) in enumerate([(h, t) for h in ("close", "grow") for t in (5, 4, 2)]):
    _src = f"g{_k}_s AS (SELECT x, y FROM {_last} WHERE tag = {_tag}), g{_k}_d AS MATERIALIZED ({_dilated(f'g{_k}_s', 'disc', 2)})"
    if _how == "close":
        _src += ", " + _eroded(f"g{_k}_f", f"g{_k}_d", "disc", 2)
    _new = f"g{_k}_f" if _how == "close" else f"g{_k}_d"
    _GAP_ROUNDS.append(f"{_src}, g{_k} AS MATERIALIZED (SELECT x, y, tag FROM {_last} UNION ALL SELECT x, y, {_tag} FROM {_new} SEMI JOIN zn USING (x, y) ANTI JOIN {_last} USING (x, y))")
    _last = f"g{_k}"
_GAPS = f"""WITH {_LABEL.replace('FROM rects))', 'FROM rects WHERE tag IN (2, 4, 5)))')}, {_CANVAS}, zn AS (SELECT x, y FROM cv WHERE x BETWEEN 30 AND 200 AND y BETWEEN 20 AND 220), {", ".join(_GAP_ROUNDS)}
SELECT x, y, tag FROM {_last} UNION ALL SELECT x, y, 1 FROM zn ANTI JOIN {_last} USING (x, y)"""
R.query("g11_fill_gaps", _GAPS, "rects")(
    lambda r: surface.fill_gaps(label_of(r.where("tag IN (2, 4, 5)")), r.sparkSession.range(30, 201).selectExpr("id AS x", "explode(sequence(20L, 220L)) AS y"), [5, 4, 2], 2, 1, N, N))
R.query("u6_fill_zone", f"WITH {_LABEL}, zn AS (SELECT x, y FROM lb WHERE tag IN (3, 4, 5) EXCEPT SELECT x, y FROM lb WHERE tag = 4 AND x % 2 = 0) SELECT x, y, tag FROM lb WHERE (x, y) IN (SELECT (x, y) FROM zn)", "rects")(
    lambda r: (lambda lb: surface.clip_to(lb, surface.fill_zone(lb.where("tag IN (3, 4, 5)"), lb.where("tag = 4 AND x % 2 = 0"))))(label_of(r)))


# -- widths and gates ------------------------------------------------------

_MOST, _TOL, _MARGIN = 24, 3, 6
_SMALL = "tk AS (SELECT layout, idx, x // 9 AS x, y // 7 AS y FROM track)"
_TANGENT = """nn AS (SELECT layout, count(*) AS n FROM tk GROUP BY layout),
 tg AS (SELECT a.layout, a.idx, a.x, a.y, (f.x - b.x) / sqrt(pow(f.x - b.x, 2) + pow(f.y - b.y, 2)) AS tx, (f.y - b.y) / sqrt(pow(f.x - b.x, 2) + pow(f.y - b.y, 2)) AS ty FROM tk a JOIN nn ON nn.layout = a.layout
   JOIN tk b ON b.layout = a.layout AND b.idx = ((a.idx - 3) % n + n) % n JOIN tk f ON f.layout = a.layout AND f.idx = (a.idx + 3) % n WHERE f.x <> b.x OR f.y <> b.y)"""


def _reach(points: str) -> str:
    """SQL: CTE re (layout, idx, side, edge, margin).  A ray is a text, one letter for each step: r road, o off the road, x off the canvas."""
    return f"""rp AS (SELECT layout, idx, side, d, round_even(x - side * d * ty, 0)::BIGINT AS px, round_even(y + side * d * tx, 0)::BIGINT AS py FROM {points}, (VALUES (1), (-1)) s(side), range(0, {_MOST + _MARGIN + 1}) k(d)),
 rt AS (SELECT layout, idx, side, string_agg(CASE WHEN px NOT BETWEEN 0 AND {N - 1} OR py NOT BETWEEN 0 AND {N - 1} THEN 'x' WHEN rd.x IS NULL THEN 'o' ELSE 'r' END, '' ORDER BY d) AS t FROM rp LEFT JOIN rd ON rd.x = px AND rd.y = py GROUP BY layout, idx, side),
 rm AS (SELECT *, CASE WHEN t LIKE 'r%' THEN regexp_extract(substr(t, 2, {_MOST}), '^r*') ELSE regexp_extract(substr(t, 2, {_MOST}), '^o{{0,{_TOL}}}r+') END AS run, substr(t, 2, {_MOST}) AS m FROM rt),
 re0 AS (SELECT layout, idx, side, t, CASE WHEN t NOT LIKE 'r%' AND run = '' THEN
     CASE WHEN regexp_matches(m, '^o{{{_TOL + 1}}}') THEN 0 WHEN contains(m, 'x') THEN strpos(m, 'x') ELSE {_MOST} END
   ELSE least(length(run) + 1, {_MOST}) END AS edge FROM rm),
 re AS (SELECT layout, idx, side, edge::INT AS edge, (CASE WHEN strpos(substr(t, (edge + 2)::INT, {_MARGIN}), 'r') > 0 THEN strpos(substr(t, (edge + 2)::INT, {_MARGIN}), 'r') - 1 ELSE {_MARGIN} END)::INT AS margin FROM re0)"""


def small(line):
    return line.select("layout", "idx", F.expr("x div 9").alias("x"), F.expr("y div 7").alias("y"))


def road_of(rects):
    return label_of(rects).where("tag >= 3").select("x", "y")


@R.query("w11_road_edges", f"WITH {_LABEL}, rd AS (SELECT x, y FROM lb WHERE tag >= 3), {_SMALL}, {_TANGENT}, {_reach('tg')} SELECT layout, idx, side, edge, margin FROM re", "track", "rects")
def road_edges(line, rects):
    return gates.edges(gates.with_tangent(small(line)), road_of(rects), _MOST, _TOL, _MARGIN, N, N).select("layout", "idx", "side", "edge", F.col("margin").cast("int").alias("margin"))


@R.query("w12_safe_width", f"""WITH {_LABEL}, rd AS (SELECT x, y FROM lb WHERE tag >= 3), {_SMALL}, {_TANGENT}, {_reach('tg')}
SELECT layout, idx, round(max(x - side * (edge + margin) * ty) FILTER (side = 1), 3) AS left_x, round(max(y - (edge + margin) * tx) FILTER (side = -1), 3) AS right_y, sum(edge + margin)::DOUBLE AS width FROM tg JOIN re USING (layout, idx) GROUP BY layout, idx""", "track", "rects")
def safe_width(line, rects):
    points = gates.with_tangent(small(line)).where("tx IS NOT NULL")
    w = gates.widths(points, gates.edges(points, road_of(rects), _MOST, _TOL, _MARGIN, N, N))
    return w.select("layout", "idx", F.round("left.x", 3).alias("left_x"), F.round("right.y", 3).alias("right_y"), "width")


_BENDS = f"""{_CURVE.replace("track", "tk").replace("n AS (SELECT", "n AS MATERIALIZED (SELECT", 1)},
 h AS (SELECT *, idx - row_number() OVER (PARTITION BY layout ORDER BY idx) AS g FROM q WHERE curv > 0.5),
 u AS (SELECT layout, min(idx) AS s, max(idx) AS e FROM h GROUP BY layout, g),
 v AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY layout ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 2 THEN 0 ELSE 1 END AS nw FROM u),
 bd AS (SELECT layout, row_number() OVER (PARTITION BY layout ORDER BY s) - 1 AS number, (e + 1) % n AS idx FROM (SELECT layout, min(s) AS s, max(e) AS e FROM (SELECT *, sum(nw) OVER (PARTITION BY layout ORDER BY s) AS b FROM v) GROUP BY layout, b HAVING max(e) - min(s) + 1 >= 2) JOIN n USING (layout))"""


@R.query("w13_gates_at_exits", f"""WITH {_LABEL}, rd AS (SELECT x, y FROM lb WHERE tag >= 3), {_SMALL}, {_TANGENT}, {_BENDS}, ex AS (SELECT tg.*, number FROM tg JOIN bd ON bd.layout = tg.layout AND bd.idx = tg.idx), {_reach('ex')}
SELECT layout, 'AC_TIME_' || number || CASE side WHEN 1 THEN '_L' ELSE '_R' END AS name, CASE side WHEN 1 THEN 'timing_left' ELSE 'timing_right' END AS type, round(x - side * edge * ty, 1) AS x, round(y + side * edge * tx, 1) AS y, round(tx, 4) AS tx, round(ty, 4) AS ty
FROM ex JOIN re USING (layout, idx)""", "track", "rects")
def gates_at_exits(line, rects):
    """The whole chain from the points of a line: curvature, bends, exits, widths, gates."""
    return gates.rederive(small(line), road_of(rects), 3, 0.5, 2, 2, _MOST, _TOL, N, N)[1]


R.query("w25_rederived_bends", f"WITH tk AS (SELECT layout, idx, x, y FROM track WHERE layout <> 2 OR idx < 9), {_BENDS} SELECT layout, count(*) AS bends FROM bd WHERE layout <> 2 GROUP BY layout", "track", "rects")(
    lambda t, r: gates.rederive(t.where("layout <> 2 OR idx < 9"), road_of(r), 3, 0.5, 2, 2, _MOST, _TOL, N, N)[0].groupBy("layout").agg(F.count("*").alias("bends")))
R.query("w17_snap_and_heading", f"""WITH tk AS (SELECT layout, idx, x, y FROM track), {_TANGENT}, p AS (SELECT point_id, point_id % 4 AS layout, x % 2000 AS x, y % 1500 AS y FROM centers),
 ne AS (SELECT p.point_id, p.layout, arg_min(t.idx, (pow(p.x - t.x, 2) + pow(p.y - t.y, 2)) * 100000 + t.idx) AS idx FROM p JOIN tk t ON t.layout = p.layout GROUP BY p.point_id, p.layout)
SELECT point_id, layout, idx, x, y, round(CASE WHEN point_id % 3 = 0 THEN -1 ELSE 1 END * tx, 6) + 0e0 AS hx, round(CASE WHEN point_id % 3 = 0 THEN -1 ELSE 1 END * ty, 6) + 0e0 AS hy FROM ne JOIN tg USING (layout, idx)""", "centers", "track")(
    lambda c, t: gates.snapped(c.select("point_id", (F.col("point_id") % 4).alias("layout"), (F.col("x") % 2000).alias("x"), (F.col("y") % 1500).alias("y")), t, 64, F.col("point_id") % 3 != 0).select("point_id", "layout", "idx", "x", "y", (F.round("hx", 6) + 0.0).alias("hx"), (F.round("hy", 6) + 0.0).alias("hy")))


# -- walls and obstacles ---------------------------------------------------

def _wall(lb):
    canvas = lb.sparkSession.range(0, N).selectExpr("id AS x", f"explode(sequence(0L, {N - 1}L)) AS y")
    return surface.wall_region(canvas, lb.where("tag IN (3, 4, 5)"), lb, lb.where("tag = 3 AND x % 2 = 0"), lb.where("tag = 5"), 2, N, N)


# No SQL: a flood over the whole canvas with two erosions and regions in one statement is more than DuckDB finishes.
R.query("g12_wall_region", None, "rects")(lambda r: _wall(label_of(r)))
R.query("g13_obstacle_regions", f"""WITH {_LABEL}, {_CANVAS}, wl AS (SELECT x, y FROM lb WHERE x BETWEEN 20 AND 200 AND tag = 4), wd AS ({_dilated("wl", "rect", 6)}),
 o1 AS (SELECT x, y FROM lb WHERE tag = 5 AND (x, y) IN (SELECT (x, y) FROM wd)), {_eroded("e1", "o1", "rect", 3)}, p1 AS ({_dilated("e1", "rect", 3)}), {_regions("c1", "p1")},
 o3 AS (SELECT x, y FROM lb WHERE tag = 3 AND (x, y) IN (SELECT (x, y) FROM wd)), {_eroded("e3", "o3", "rect", 3)}, p3 AS ({_dilated("e3", "rect", 3)}), {_regions("c3", "p3")}
SELECT 5 AS tag, comp, x, y FROM c1 WHERE comp IN (SELECT comp FROM c1 GROUP BY comp HAVING count(*) > 60) UNION ALL SELECT 3, comp, x, y FROM c3 WHERE comp IN (SELECT comp FROM c3 GROUP BY comp HAVING count(*) > 60)""", "rects")(
    lambda r: (lambda lb: surface.obstacle_regions(lb, [5, 3], lb.where("x BETWEEN 20 AND 200 AND tag = 4"), lb.where("tag = 2"), 6, 61, N, N))(label_of(r)))

# -- places along a track --------------------------------------------------

_PLACED = """p AS (SELECT point_id, point_id % 4 AS layout, x % 2000 AS x, y % 1500 AS y FROM centers),
 ne AS (SELECT p.point_id, p.layout, arg_min(t.idx, (pow(p.x - t.x, 2) + pow(p.y - t.y, 2)) * 100000 + t.idx) AS idx FROM p JOIN track t ON t.layout = p.layout GROUP BY p.point_id, p.layout),
 cu AS (SELECT layout, idx, coalesce(sum(d) OVER (PARTITION BY layout ORDER BY idx), 0) AS cum FROM (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d FROM track WINDOW w AS (PARTITION BY layout ORDER BY idx))),
 pl AS (SELECT point_id, layout, idx, cum FROM ne JOIN cu USING (layout, idx))"""


def _points(c):
    return c.select("point_id", (F.col("point_id") % 4).alias("layout"), (F.col("x") % 2000).alias("x"), (F.col("y") % 1500).alias("y"))


R.query("j5_place_on_line", f"WITH {_PLACED} SELECT point_id, layout, idx, round(cum, 3) AS cum FROM pl", "centers", "track")(
    lambda c, t: track.place_on_line(_points(c), t, 64).select("point_id", "layout", "idx", F.round("cum", 3).alias("cum")))
R.query("m5_split_along", f"""WITH {_PLACED}, r AS (SELECT *, row_number() OVER (PARTITION BY layout ORDER BY cum, point_id) - 1 AS r, count(*) OVER (PARTITION BY layout) AS n FROM pl),
 t AS (SELECT layout, cum AS cut FROM r WHERE r IN (trunc(n * 1 / 4), trunc(n * 2 / 4), trunc(n * 3 / 4)))
SELECT a.point_id, a.layout, (SELECT count(*) FROM t WHERE t.layout = a.layout AND t.cut < a.cum)::INT AS part FROM pl a""", "centers", "track")(
    lambda c, t: track.split_along(_points(c), t, 4, 64))
