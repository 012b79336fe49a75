"""Queries over telemetry and ordered lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import telemetry, track
from .register import Register

R = Register()


@R.query("a13_lap_stats", """
SELECT session_id, lap, count(*) AS n, round(CASE WHEN count(et) >= 2 THEN max(et) - min(et) ELSE max(t) - min(t) END, 6) AS seconds,
  printf('%02d:%02d.%03d', floor(round(max(et) - min(et), 6) * 1000 + 0.5)::BIGINT // 60000, (floor(round(max(et) - min(et), 6) * 1000 + 0.5)::BIGINT // 1000) % 60, floor(round(max(et) - min(et), 6) * 1000 + 0.5)::BIGINT % 1000) AS text,
  round(avg(sats), 6) AS sats, round(avg(acc), 6) AS acc FROM telemetry WHERE session_id IS NOT NULL GROUP BY session_id, lap""", "telemetry")
def lap_stats(points):
    # Every lap with one point alone would take its time from t, which is 0 as well.
    return telemetry.lap_stats(points)


_JUMP = "2 * 6371000e0 * asin(sqrt(pow(sin(radians(n.lat - r.lat) / 2), 2) + cos(radians(r.lat)) * cos(radians(n.lat)) * pow(sin(radians(n.lon - r.lon) / 2), 2)))"


@R.query("w1_segments", f"""WITH
 p AS (SELECT *, row_number() OVER (PARTITION BY session_id, lap ORDER BY seq) AS i FROM telemetry),
 r(session_id, lap, i, seq, frag, t, lat, lon, seg, size) AS (SELECT session_id, lap, i, seq, frag, t, lat, lon, 0, 1 FROM p WHERE i = 1
  UNION ALL SELECT n.session_id, n.lap, n.i, n.seq, n.frag, n.t, n.lat, n.lon,
    CASE WHEN (n.frag <> r.frag OR abs(n.t - r.t) > 2 OR {_JUMP} > 30) AND r.size > 1 THEN r.seg + 1 ELSE r.seg END,
    CASE WHEN (n.frag <> r.frag OR abs(n.t - r.t) > 2 OR {_JUMP} > 30) AND r.size > 1 THEN 1 ELSE r.size + 1 END
   FROM r JOIN p n ON n.session_id = r.session_id AND n.lap = r.lap AND n.i = r.i + 1),
 c AS (SELECT *, count(*) OVER (PARTITION BY session_id, lap, seg) AS many FROM r)
SELECT session_id, lap, seq, seg::BIGINT AS segment FROM c WHERE many > 1""", "telemetry")
def segments(points):
    return telemetry.segments(points).select("session_id", "lap", "seq", "segment")


@R.query("w2_thin", f"""WITH
 p AS (SELECT *, row_number() OVER (PARTITION BY session_id, lap ORDER BY seq) AS i FROM telemetry),
 r(session_id, lap, i, seq, lat, lon, kept) AS (SELECT session_id, lap, i, seq, lat, lon, true FROM p WHERE i = 1
  UNION ALL SELECT n.session_id, n.lap, n.i, n.seq, CASE WHEN {_JUMP} >= 5 THEN n.lat ELSE r.lat END, CASE WHEN {_JUMP} >= 5 THEN n.lon ELSE r.lon END, {_JUMP} >= 5
   FROM r JOIN p n ON n.session_id = r.session_id AND n.lap = r.lap AND n.i = r.i + 1)
SELECT session_id, lap, seq FROM r WHERE kept""", "telemetry")
def thin(points):
    return telemetry.thin(points, 5.0).select("session_id", "lap", "seq")


@R.query("a30_session_extent", "SELECT session_id, round(avg(lat), 9) AS ref_lat, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM telemetry GROUP BY session_id", "telemetry")
def extent(points):
    return telemetry.session_extent(points)


@R.query("w3_arc_length", """SELECT layout, idx, round(coalesce(sum(d) OVER (PARTITION BY layout ORDER BY idx), 0), 4) AS cum FROM
 (SELECT *, sqrt(pow(x - lag(x) OVER (PARTITION BY layout ORDER BY idx), 2) + pow(y - lag(y) OVER (PARTITION BY layout ORDER BY idx), 2)) AS d FROM track)""", "track")
def arc(line):
    return track.arc_length(line).select("layout", "idx", F.round("cum", 4).alias("cum"))


@R.query("w4_resample", """WITH
 a AS (SELECT layout, idx, x, y, coalesce(sum(d) OVER (PARTITION BY layout ORDER BY idx), 0) AS cum FROM (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d FROM track WINDOW w AS (PARTITION BY layout ORDER BY idx))),
 b AS (SELECT *, lead(cum) OVER w AS nxt, lead(x) OVER w AS x2, lead(y) OVER w AS y2, max(cum) OVER (PARTITION BY layout) AS total FROM a WINDOW w AS (PARTITION BY layout ORDER BY idx)),
 t AS (SELECT DISTINCT layout, total, greatest(trunc(total / 2500)::INT, 10) AS n FROM b),
 s AS (SELECT layout, total, n, unnest(range(0, n)) AS k FROM t)
SELECT s.layout, s.k::INT AS idx, round(b.x + (s.k * s.total / s.n - b.cum) / (b.nxt - b.cum) * (b.x2 - b.x), 3) AS x, round(b.y + (s.k * s.total / s.n - b.cum) / (b.nxt - b.cum) * (b.y2 - b.y), 3) AS y
FROM s JOIN b ON s.layout = b.layout AND s.k * s.total / s.n >= b.cum AND s.k * s.total / s.n < b.nxt""", "track")
def resample(line):
    r = track.resample(line, 2500.0)
    return r.select("layout", "idx", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@R.query("w5_smooth", """WITH n AS (SELECT layout, count(*) AS n FROM track GROUP BY layout), o AS (SELECT unnest(range(-4, 5)) AS o)
SELECT a.layout, a.idx, round(sum(((3 * 16 + 12 - 1) - 5 * o * o) * 3e0 / (7 * 9 * 11) * b.x), 4) AS x, round(sum(((3 * 16 + 12 - 1) - 5 * o * o) * 3e0 / (7 * 9 * 11) * b.y), 4) AS y
FROM track a JOIN n ON a.layout = n.layout CROSS JOIN o JOIN track b ON b.layout = a.layout AND b.idx = ((a.idx + o) % n + n) % n GROUP BY a.layout, a.idx""", "track")
def smooth(line):
    return track.smooth(line, 9).select("layout", "idx", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


_CURVE = """n AS (SELECT layout, count(*) AS n FROM track GROUP BY layout),
 q AS (SELECT a.layout, a.idx, n.n, abs(atan2((a.x - b.x) * (f.y - a.y) - (a.y - b.y) * (f.x - a.x), (a.x - b.x) * (f.x - a.x) + (a.y - b.y) * (f.y - a.y))) AS curv FROM track a JOIN n ON n.layout = a.layout
   JOIN track b ON b.layout = a.layout AND b.idx = ((a.idx - 3) % n + n) % n JOIN track f ON f.layout = a.layout AND f.idx = (a.idx + 3) % n)"""


@R.query("w6_curvature", f"WITH {_CURVE} SELECT layout, idx, round(curv, 6) AS curv FROM q", "track")
def curve(line):
    return track.curvature(line, 3).select("layout", "idx", F.round("curv", 6).alias("curv"))


@R.query("w9_bends", f"""WITH {_CURVE},
 h AS (SELECT *, idx - row_number() OVER (PARTITION BY layout ORDER BY idx) AS g FROM q WHERE curv > 0.5),
 u AS (SELECT layout, min(idx) AS s, max(idx) AS e FROM h GROUP BY layout, g),
 v AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY layout ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 2 THEN 0 ELSE 1 END AS nw FROM u),
 m AS (SELECT layout, b, min(s) AS s, max(e) AS e FROM (SELECT *, sum(nw) OVER (PARTITION BY layout ORDER BY s) AS b FROM v) GROUP BY layout, b HAVING max(e) - min(s) + 1 >= 2)
SELECT m.layout, row_number() OVER (PARTITION BY m.layout ORDER BY m.s)::INT AS bend, m.s AS start, m.e AS "end", arg_max(q.idx, round(q.curv, 9) * 1e6 - q.idx / 1e6) AS peak, round(sum(q.curv), 4) AS total, ((m.e + 1) % max(q.n))::INT AS exit
FROM m JOIN q ON q.layout = m.layout AND q.idx BETWEEN m.s AND m.e GROUP BY m.layout, m.b, m.s, m.e""", "track")
def bends(line):
    return track.bend_islands(track.curvature(line, 3), 0.5, gap=2, least=2)


@R.query("w10_tangent", """WITH n AS (SELECT layout, count(*) AS n FROM track GROUP BY layout)
SELECT a.layout, a.idx, round((f.x - b.x) / nullif(sqrt(pow(f.x - b.x, 2) + pow(f.y - b.y, 2)), 0), 6) + 0e0 AS tx, round((f.y - b.y) / nullif(sqrt(pow(f.x - b.x, 2) + pow(f.y - b.y, 2)), 0), 6) + 0e0 AS ty
FROM track a JOIN n ON n.layout = a.layout JOIN track b ON b.layout = a.layout AND b.idx = ((a.idx - 3) % n + n) % n JOIN track f ON f.layout = a.layout AND f.idx = (a.idx + 3) % n""", "track")
def tangents(line):
    return track.tangent(line).select("layout", "idx", (F.round("tx", 6) + 0.0).alias("tx"), (F.round("ty", 6) + 0.0).alias("ty"))


@R.query("a9_ring_measures", """SELECT ring_id, round(sum(x * y2 - x2 * y) / 2, 1) AS area, round(sum(sqrt(pow(x2 - x, 2) + pow(y2 - y, 2))), 4) AS perimeter, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM
 (SELECT a.ring_id, a.x, a.y, b.x AS x2, b.y AS y2 FROM rings a JOIN rings b ON a.ring_id = b.ring_id AND b.v = (a.v + 1) % 16) GROUP BY ring_id""", "rings")
def measures(rings):
    m = track.ring_measures(rings, "ring_id", "v")
    return m.select("ring_id", F.round("area", 1).alias("area"), F.round("perimeter", 4).alias("perimeter"), F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@R.query("w19_circular_runs", """WITH f AS (SELECT layout, idx, x % 3 = 0 AS flag FROM track),
 s AS (SELECT a.layout, sum(CASE WHEN a.flag AND NOT b.flag THEN 1 ELSE 0 END) AS runs FROM f a JOIN (SELECT layout, count(*) AS n FROM f GROUP BY layout) n ON n.layout = a.layout
   JOIN f b ON b.layout = a.layout AND b.idx = (a.idx - 1 + n.n) % n.n GROUP BY a.layout)
SELECT layout, runs::BIGINT AS runs FROM s""", "track")
def runs(line):
    return track.circular_runs(line.select("layout", "idx", (F.col("x") % 3 == 0).alias("flag")))


@R.query("f12_drop_repeats", """WITH a AS (SELECT layout, idx, (x // 300) * 300 AS x, (y // 400) * 400 AS y FROM track),
 k AS (SELECT * FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM a WINDOW w AS (PARTITION BY layout ORDER BY idx)) WHERE px IS NULL OR px <> x OR py <> y),
 e AS (SELECT *, first_value(x) OVER (PARTITION BY layout ORDER BY idx) AS fx, first_value(y) OVER (PARTITION BY layout ORDER BY idx) AS fy, max(idx) OVER (PARTITION BY layout) AS last, min(idx) OVER (PARTITION BY layout) AS first FROM k)
SELECT layout, idx FROM e WHERE NOT (idx = last AND idx <> first AND x = fx AND y = fy)""", "track")
def repeats(line):
    coarse = line.select("layout", "idx", F.expr("(x div 300) * 300").alias("x"), F.expr("(y div 400) * 400").alias("y"))
    return track.drop_repeats(coarse, 0.001).select("layout", "idx")


@R.query("w20_equal_count_split", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY layout ORDER BY x, idx) - 1 AS r, count(*) OVER (PARTITION BY layout) AS n FROM track),
 t AS (SELECT layout, x AS cut FROM r WHERE r IN (trunc(n * 1 / 4), trunc(n * 2 / 4), trunc(n * 3 / 4)))
SELECT a.layout, a.idx, (SELECT count(*) FROM t WHERE t.layout = a.layout AND t.cut < a.x)::INT AS part FROM track a""", "track")
def split(line):
    return track.equal_count_split(line, "x", 4).select("layout", "idx", F.col("part").cast("int").alias("part"))


@R.query("j4_nearest_line_point", """SELECT c.point_id, c.layout, arg_min(t.idx, (pow(c.x - t.x, 2) + pow(c.y - t.y, 2)) * 100000 + t.idx) AS idx, min((c.x - t.x) * (c.x - t.x) + (c.y - t.y) * (c.y - t.y)) AS d2
 FROM (SELECT point_id, point_id % 4 AS layout, x % 2000 AS x, y % 1500 AS y FROM centers) c JOIN track t ON t.layout = c.layout GROUP BY c.point_id, c.layout""", "centers", "track")
def nearest(points, line):
    p = points.select("point_id", (F.col("point_id") % 4).alias("layout"), (F.col("x") % 2000).alias("x"), (F.col("y") % 1500).alias("y"))
    return track.nearest_on_line(p, line, 64)


@R.query("a14_track_length", """SELECT layout, round(sum(d) * 0.1, 4) AS length_m, min(x) - 50 AS x0, min(y) - 50 AS y0, max(x) + 50 AS x1, max(y) + 50 AS y1 FROM
 (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d FROM track WINDOW w AS (PARTITION BY layout ORDER BY idx)) GROUP BY layout""", "track")
def length(line):
    return track.arc_length(line).groupBy("layout").agg(F.round(F.max("cum") * 0.1, 4).alias("length_m"), (F.min("x") - 50).alias("x0"), (F.min("y") - 50).alias("y0"), (F.max("x") + 50).alias("x1"), (F.max("y") + 50).alias("y1"))
