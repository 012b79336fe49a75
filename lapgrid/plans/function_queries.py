"""Queries over the scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures
from ..functions import geo, predicates, text
from .register import Register, r6

R = Register()
C = F.col
D = lambda c: F.col(c).cast("double")


def flat(struct, *fields):
    return [struct[f].alias(f"w_{f}") for f in fields]


_T = [0.5, 0.0, 100.0, 0.0, -0.25, 500.0]
_TL, _TR, _BL, _BR = (0.0, 1000.0), (1100.0, 950.0), (50.0, -20.0), (1200.0, 30.0)

R.columns("c1_pixel_to_geo", "centers", lambda: [C("point_id"), r6(geo.pixel_to_geo(C("x"), C("y"), _T)["x"], "gx"), r6(geo.pixel_to_geo(C("x"), C("y"), _T)["y"], "gy")],
          "point_id, round(0.5 * (x + 0.5) + 100, 6)::DOUBLE AS gx, round(-0.25 * (y + 0.5) + 500, 6)::DOUBLE AS gy")
R.columns("c2_geo_to_pixel", "centers", lambda: [C("point_id"), geo.geo_to_pixel(C("x"), C("y"), _T)["x"].alias("px"), geo.geo_to_pixel(C("x"), C("y"), _T)["y"].alias("py")],
          "point_id, floor((x - 100) / 0.5)::BIGINT AS px, floor((y - 500) / -0.25)::BIGINT AS py")
R.columns("c3_window_from_bounds", "rects", lambda: [C("rect_id"), *flat(geo.window_from_bounds(C("x0"), C("y0"), C("x1"), C("y1"), [1.0, 0.0, 0.0, 0.0, -1.0, 240.0], F.lit(200), F.lit(180)), "x0", "y0", "x1", "y1")],
          "rect_id, least(greatest(x0, 0), 199) AS w_x0, least(greatest(240 - y1, 0), 179) AS w_y0, greatest(least(x1 + 1, 200), least(greatest(x0, 0), 199) + 1) AS w_x1, greatest(least(240 - y0 + 1, 180), least(greatest(240 - y1, 0), 179) + 1) AS w_y1")
R.columns("c4_gsd_cm", "centers", lambda: [C("point_id"), r6(geo.gsd_cm(F.lit(0.00001), F.lit(-0.00001), C("y") / 200, C("x") % 2 == 0), "gsd")],
          "point_id, round(CASE WHEN x % 2 = 0 THEN (0.00001::DOUBLE * 111000 * cos(radians(y / 200)) + 0.00001::DOUBLE * 111000) / 2 * 100 ELSE 0.001::DOUBLE END, 6) AS gsd")
R.columns("c5_pixel_size", "rects", lambda: [C("rect_id"), r6(geo.pixel_size_m(C("x0") / 10, C("y0") / 10, C("x1") / 10, C("y1") / 10, F.lit(100), F.lit(50), C("tag") > 2), "size_m")],
          """rect_id, round(CASE WHEN tag > 2 THEN ((x1 / 10 - x0 / 10) / 100 * 111320 * cos(radians((y1 / 10 + y0 / 10) / 2)) + (y1 / 10 - y0 / 10) / 50 * 111320) / 2
             ELSE ((x1 / 10 - x0 / 10) / 100 + (y1 / 10 - y0 / 10) / 50) / 2 END, 6) AS size_m""")
R.columns("c6_looks_geographic", "rects", lambda: [C("rect_id"), geo.looks_geographic_box(C("x0"), C("y0") - 100, C("x1"), C("y1") - 100).alias("geographic")],
          "rect_id, x0 >= -180 AND x1 <= 180 AND y0 - 100 >= -90 AND y1 - 100 <= 90 AS geographic")
R.columns("c7_canvas", "centers", lambda: [C("point_id"), r6(geo.geo_to_canvas(C("x"), C("y"), 0.0, 0.0, 10007.0, 10009.0, 1024, 768)["x"], "u"), r6(geo.geo_to_canvas(C("x"), C("y"), 0.0, 0.0, 10007.0, 10009.0, 1024, 768)["y"], "v"),
          r6(geo.canvas_to_geo(C("x") % 1024, C("y") % 768, 0.0, 0.0, 10007.0, 10009.0, 1024, 768)["x"], "gx"), r6(geo.canvas_to_geo(C("x") % 1024, C("y") % 768, 0.0, 0.0, 10007.0, 10009.0, 1024, 768)["y"], "gy")],
          """point_id, round(x / 10007e0 * 1024, 6) AS u, round((10009 - y) / 10009e0 * 768, 6) AS v, round((x % 1024) / 1024 * 10007e0, 6) AS gx, round(10009e0 - (y % 768) / 768 * 10009e0, 6) AS gy""")
R.columns("c8_bilinear_forward", "centers", lambda: [C("point_id"), r6(geo.bilinear_forward(C("x") / 10007, C("y") / 10009, _TL, _TR, _BL, _BR)["x"], "gx"), r6(geo.bilinear_forward(C("x") / 10007, C("y") / 10009, _TL, _TR, _BL, _BR)["y"], "gy")],
          """point_id, round((x / 10007) * (1 - y / 10009) * 1100e0 + (1 - x / 10007) * (y / 10009) * 50e0 + (x / 10007) * (y / 10009) * 1200e0, 6) AS gx,
             round((1 - x / 10007) * (1 - y / 10009) * 1000e0 + (x / 10007) * (1 - y / 10009) * 950e0 - (1 - x / 10007) * (y / 10009) * 20e0 + (x / 10007) * (y / 10009) * 30e0, 6) AS gy""")
for _name, _inv in (("c9_bilinear_inverse", "bilinear_inverse"), ("c10_bilinear_newton", "bilinear_inverse_newton")):
    def _roundtrip(inv=_inv):
        f = getattr(geo, inv)
        p = geo.bilinear_forward(C("x") / 10007, C("y") / 10009, _TL, _TR, _BL, _BR)
        q = f(p["x"], p["y"], _TL, _TR, _BL, _BR)
        return [C("point_id"), F.round(q["x"], 4).alias("u"), F.round(q["y"], 4).alias("v")]
    R.columns(_name, "centers", _roundtrip, "point_id, round(x / 10007, 4) AS u, round(y / 10009, 4) AS v")
_ECEF = "(6378137e0 / sqrt(1 - 0.0066943799901413165e0 * sin(radians(lat)) * sin(radians(lat))))"
R.columns("c11_geodetic_to_ecef", "telemetry", lambda: [C("session_id"), C("seq"), F.round(geo.geodetic_to_ecef(C("lat"), C("lon"), C("acc"))["x"], 3).alias("ex"), F.round(geo.geodetic_to_ecef(C("lat"), C("lon"), C("acc"))["z"], 3).alias("ez")],
          f"session_id, seq, round(({_ECEF} + acc) * cos(radians(lat)) * cos(radians(lon)), 3) AS ex, round(({_ECEF} * (1 - 0.0066943799901413165e0) + acc) * sin(radians(lat)), 3) AS ez")


def _back():
    g = geo.geodetic_to_ecef(C("lat"), C("lon"), C("acc"))
    b = geo.ecef_to_geodetic(g["x"], g["y"], g["z"])
    return [C("session_id"), C("seq"), r6(b["lat"], "lat2"), r6(b["lon"], "lon2"), F.round(b["h"], 5).alias("h2")]


R.columns("c12_ecef_to_geodetic", "telemetry", _back, "session_id, seq, round(lat, 6) AS lat2, round(lon, 6) AS lon2, round(acc, 5) AS h2")


def _enu():
    g = geo.geodetic_to_ecef(C("lat"), C("lon"), C("acc"))
    p = geo.ecef_to_enu(g["x"], g["y"], g["z"], 22.71, 113.86, 0.0)
    return [C("session_id"), C("seq"), (F.round(p["e"], 3) + 0.0).alias("e"), F.round(p["n"], 3).alias("n"), F.round(p["u"], 3).alias("u")]


_X = f"(({_ECEF} + acc) * cos(radians(lat)) * cos(radians(lon)))"
_Y = f"(({_ECEF} + acc) * cos(radians(lat)) * sin(radians(lon)))"
_Z = f"(({_ECEF} * (1 - 0.0066943799901413165e0) + acc) * sin(radians(lat)))"
_OX, _OY, _OZ = (x.replace("acc", "0").replace("lat", "22.71e0").replace("lon", "113.86e0") for x in (_X, _Y, _Z))
_LA, _LO = "radians(22.71e0)", "radians(113.86e0)"
_E = f"(-sin({_LO}) * ({_X} - {_OX}) + cos({_LO}) * ({_Y} - {_OY}))"
_N = f"(-sin({_LA}) * cos({_LO}) * ({_X} - {_OX}) - sin({_LA}) * sin({_LO}) * ({_Y} - {_OY}) + cos({_LA}) * ({_Z} - {_OZ}))"
_U = f"(cos({_LA}) * cos({_LO}) * ({_X} - {_OX}) + cos({_LA}) * sin({_LO}) * ({_Y} - {_OY}) + sin({_LA}) * ({_Z} - {_OZ}))"
R.columns("c13_ecef_to_enu", "telemetry", _enu, f"session_id, seq, round({_E}, 3) + 0e0 AS e, round({_N}, 3) AS n, round({_U}, 3) AS u")
R.columns("c14_mat4", "centers", lambda: (lambda m: [C("point_id"), F.round(geo.mat4_apply(geo.mat4_invert(m), geo.mat4_apply(m, D("x"), D("y"), F.lit(7.0))["x"], geo.mat4_apply(m, D("x"), D("y"), F.lit(7.0))["y"], geo.mat4_apply(m, D("x"), D("y"), F.lit(7.0))["z"])["x"], 3).alias("x2"),
          F.round(geo.mat4_apply(m, D("x"), D("y"), F.lit(7.0))["x"], 3).alias("mx")])(F.array(*[F.lit(float(v)) for v in (2, 1, 0, 0, -1, 3, 0.5, 0, 0.25, 0, 2, 0, 10, 20, 30, 1)])),
          "point_id, round(x::DOUBLE, 3) AS x2, round(2e0 * x - y + 0.25 * 7 + 10, 3)::DOUBLE AS mx")
R.columns("c15_geo_to_local", "telemetry", lambda: (lambda p: [C("session_id"), C("seq"), (F.round(p["x"], 3) + 0.0).alias("lx"), (F.round(p["y"], 3) + 0.0).alias("ly"), (F.round(p["z"], 3) + 0.0).alias("lz")])(geo.geo_to_local_xyz(C("lat"), C("lon"), C("acc"), 22.71, 113.86, 0.0)),
          f"session_id, seq, round({_E}, 3) + 0e0 AS lx, round({_U}, 3) + 0e0 AS ly, round({_N}, 3) + 0e0 AS lz")
R.columns("c17_box_to_window", "rects", lambda: [C("rect_id"), *flat(geo.box_to_window(C("x0") / 256, C("y0") / 256, C("x1") / 256, C("y1") / 256, F.lit(1008), F.lit(998)), "x0", "y0", "x1", "y1")],
          "rect_id, trunc(x0 / 256 * 1008)::INT AS w_x0, trunc(y0 / 256 * 998)::INT AS w_y0, greatest(trunc(x1 / 256 * 1008)::INT, trunc(x0 / 256 * 1008)::INT + 1) AS w_x1, greatest(trunc(y1 / 256 * 998)::INT, trunc(y0 / 256 * 998)::INT + 1) AS w_y1")
R.columns("c18_scaled_size", "centers", lambda: [C("point_id"), geo.scaled_size(C("x"), F.lit(0.165)).alias("scaled")], "point_id, trunc(x * 0.165e0)::INT AS scaled")
# The checking SQL has the other well-known inverse, by footpoint latitude and powers of the distance from the central meridian.
R.columns("c19_utm_to_wgs84", "centers", lambda: (lambda p: [C("point_id"), F.round(p["lon"], 5).alias("lon"), F.round(p["lat"], 5).alias("lat")])(geo.utm_to_wgs84(300000.0 + 40.0 * C("x"), 401.0 * C("y"), 49)), "point_id, lon, lat")
R.sql["c19_utm_to_wgs84"] = fixtures.ctes("centers") + """,
 k AS (SELECT 6378137e0 AS a, 0.00669437999014133e0 AS e2, 0.00673949674227643e0 AS ep, 0.00167922038638370e0 AS e1),
 m AS (SELECT point_id, 300000e0 + 40 * x - 500000 AS dx, 401e0 * y / 0.9996 / (a * (1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256)) AS mu, k.* FROM centers, k),
 f AS (SELECT *, mu + (3 * e1 / 2 - 27 * e1 ** 3 / 32) * sin(2 * mu) + (21 * e1 ** 2 / 16 - 55 * e1 ** 4 / 32) * sin(4 * mu) + 151 * e1 ** 3 / 96 * sin(6 * mu) + 1097 * e1 ** 4 / 512 * sin(8 * mu) AS phi FROM m),
 g AS (SELECT *, ep * cos(phi) ** 2 AS c, tan(phi) ** 2 AS t, a / sqrt(1 - e2 * sin(phi) ** 2) AS n, a * (1 - e2) / (1 - e2 * sin(phi) ** 2) ** 1.5 AS r FROM f),
 h AS (SELECT *, dx / (n * 0.9996) AS d FROM g)
SELECT point_id, round(111 + degrees((d - (1 + 2 * t + c) * d ** 3 / 6 + (5 - 2 * c + 28 * t - 3 * c ** 2 + 8 * ep + 24 * t ** 2) * d ** 5 / 120) / cos(phi)), 5) AS lon,
 round(degrees(phi - n * tan(phi) / r * (d ** 2 / 2 - (5 + 3 * t + 10 * c - 4 * c ** 2 - 9 * ep) * d ** 4 / 24 + (61 + 90 * t + 298 * c + 45 * t ** 2 - 252 * ep - 3 * c ** 2) * d ** 6 / 720)), 5) AS lat FROM h"""
R.columns("c21_haversine", "telemetry", lambda: [C("session_id"), C("seq"), F.round(geo.haversine_m(C("lat"), C("lon"), F.lit(22.7), F.lit(113.9)), 4).alias("d")],
          "session_id, seq, round(2 * 6371000e0 * asin(sqrt(pow(sin(radians(22.7e0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(22.7e0)) * pow(sin(radians(113.9e0 - lon) / 2), 2))), 4) AS d")
R.columns("c22_shift_by_metres", "telemetry", lambda: (lambda p: [C("session_id"), C("seq"), F.round(p["lat"], 9).alias("lat2"), F.round(p["lon"], 9).alias("lon2")])(geo.shift_by_metres(C("lat"), C("lon"), F.lit(12.5), F.lit(-3.0), F.lit(22.7))),
          "session_id, seq, round(lat - 3 / 111111e0, 9) AS lat2, round(lon + 12.5 / (111111e0 * cos(radians(22.7e0))), 9) AS lon2")
R.columns("c23_bearing", "centers", lambda: [C("point_id"), r6(geo.bearing_deg(C("x") - 5000, C("y") - 5000), "bearing")],
          "point_id, round(((degrees(atan2(x - 5000, 5000 - y)) % 360) + 360) % 360, 6) AS bearing")
R.columns("c26_brightness", "pixels", lambda: [C("ord"), geo.luma_visible(C("x") % 40, C("y") % 40, F.lit(3)).alias("visible"), geo.is_black(C("x") % 40, C("y") % 40, F.lit(3)).alias("black")],
          "ord, 0.299e0 * (x % 40) + 0.587e0 * (y % 40) + 0.114e0 * 3 > 10 AS visible, greatest(x % 40, y % 40, 3) < 20 AS black")
R.columns("c27_closest_point", "centers", lambda: (lambda p: [C("point_id"), r6(p["t"], "t"), F.round(p["d2"], 3).alias("d2")])(geo.closest_point_on_segment(C("x"), C("y"), F.lit(100.0), F.lit(200.0), F.lit(9000.0), F.lit(7000.0))),
          """point_id, round(least(greatest(((x - 100) * 8900e0 + (y - 200) * 6800e0) / (8900e0 * 8900 + 6800e0 * 6800), 0), 1), 6) AS t,
          round(pow(x - (100 + 8900 * least(greatest(((x - 100) * 8900e0 + (y - 200) * 6800e0) / (8900e0 * 8900 + 6800e0 * 6800), 0), 1)), 2) + pow(y - (200 + 6800 * least(greatest(((x - 100) * 8900e0 + (y - 200) * 6800e0) / (8900e0 * 8900 + 6800e0 * 6800), 0), 1)), 2), 3) AS d2""")
R.columns("c28_lap_time", "telemetry", lambda: [C("session_id"), C("seq"), geo.lap_time_text(C("t") * 7).alias("text")],
          "session_id, seq, printf('%02d:%02d.%03d', (floor(t * 7 * 1000 + 0.5)::BIGINT // 60000), (floor(t * 7 * 1000 + 0.5)::BIGINT // 1000) % 60, floor(t * 7 * 1000 + 0.5)::BIGINT % 1000) AS text")

R.columns("t1_tile_level", "tiles", lambda: [C("tile_id"), text.tile_level(F.concat(C("tile_id"), F.lit("_L"), C("level"), F.lit("_0.b3dm"))).alias("lv")], "tile_id, level::INT AS lv")
R.columns("t2_collision_name", "rects", lambda: [C("rect_id"), text.collision_name(F.element_at(F.array(*map(F.lit, (" Sand ", "grass", "ROAD2", "road", "water"))), C("tag")), C("group_id")).alias("name")],
          "rect_id, CASE tag WHEN 1 THEN '1SAND_' || group_id WHEN 2 THEN '1GRASS_' || group_id WHEN 3 THEN '1ROAD2_' || group_id WHEN 4 THEN '1ROAD_' || group_id END AS name")
R.columns("t3_infer_type", "objects", lambda: [C("object_id"), text.infer_type(F.element_at(F.array(*map(F.lit, ("AC_PIT_0", "AC_START_1", "AC_TIME_0_L", "AC_TIME_0_R", "X"))), (C("x") % 5 + 1).cast("int")), C("type"), ["hotlap"]).alias("kind")],
          "object_id, CASE WHEN type = 'hotlap' THEN type ELSE ['pit', 'start', 'timing_left', 'timing_right', 'unknown'][x % 5 + 1] END AS kind")
R.columns("t5_safe_name", "log_lines", lambda: [C("run"), C("ord"), text.safe_name(C("value")).alias("safe")],
          "run, ord, CASE WHEN regexp_replace(regexp_replace(value, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') = '' THEN 'unnamed' ELSE regexp_replace(regexp_replace(value, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') END AS safe")
R.columns("t6_display_names", "objects", lambda: [C("object_id"), F.element_at(text.display_names(F.concat(F.lit("Road:r"), C("x"), F.lit(";KERB:k"), C("y"))), "kerb").alias("kerb")], "object_id, 'k' || y AS kerb")
R.columns("t7_batch_type", "objects", lambda: [C("object_id"), text.batch_type(F.concat(F.lit("x_"), F.when(C("x") % 3 == 0, "collision").when(C("x") % 3 == 1, "game_objects").otherwise("t"))).alias("batch")],
          "object_id, CASE x % 3 WHEN 0 THEN 'collision' WHEN 1 THEN 'game_objects' ELSE 'terrain' END AS batch")
R.columns("t8_layout_of_file", "objects", lambda: [C("object_id"), text.layout_of_file(F.concat(F.lit("track"), F.when(C("y") % 2 == 0, F.concat(F.lit("_go_L"), C("layout"))).otherwise(""), F.lit(".kn5"))).alias("lay")],
          "object_id, CASE WHEN y % 2 = 0 THEN 'L' || layout ELSE 'shared' END AS lay")
R.columns("t9_fenced_payload", "objects", lambda: [C("object_id"), F.get_json_object(text.fenced_payload(F.concat(F.lit("```json\n{\"a\": "), C("x"), F.lit("}\n```"))), "$.a").alias("a")], "object_id, x::VARCHAR AS a")
R.columns("t10_progress_line", "log_lines", lambda: [C("run"), C("ord"), text.progress_percent(C("value")).alias("pct"), text.progress_message(C("value")).alias("msg"), text.stage_header(C("value")).alias("stage")],
          """run, ord, CASE WHEN ord % 5 <> 0 THEN least((ord * 17) % 120, 100)::INT END AS pct, CASE WHEN ord % 5 <> 0 THEN regexp_extract(value, '^@@PROGRESS@@ [0-9]+ (.*)$', 1) END AS msg,
             CASE WHEN ord % 5 = 0 THEN ord || 'a' END AS stage""")
R.columns("t11_eta_text", "telemetry", lambda: [C("session_id"), C("seq"), text.eta_text(C("t"), (C("seq") % 100) / 100).alias("eta")],
          """session_id, seq, CASE WHEN seq % 100 / 100 <= 0.005 OR seq % 100 / 100 >= 0.99 THEN '' WHEN floor(t * (1 - (seq % 100) / 100) / ((seq % 100) / 100) + 0.5) < 60
             THEN printf('~%ds', floor(t * (1 - (seq % 100) / 100) / ((seq % 100) / 100) + 0.5)::BIGINT)
             ELSE printf('~%dm%02ds', floor(t * (1 - (seq % 100) / 100) / ((seq % 100) / 100) + 0.5)::BIGINT // 60, floor(t * (1 - (seq % 100) / 100) / ((seq % 100) / 100) + 0.5)::BIGINT % 60) END AS eta""")
R.columns("t12_texture_path", "objects", lambda: [C("object_id"), text.texture_extension(F.element_at(F.array(*map(F.lit, ("png", "JPEG", "targa", "open_exr", "TIFF", "hdr", "bmp", "webp"))), (C("x") % 8 + 1).cast("int"))).alias("ext"), text.png_path(F.concat(F.lit("a/b"), C("x"), F.lit(".JPG"))).alias("path")],
          "object_id, ['png', 'jpg', 'tga', 'exr', 'tiff', 'hdr', 'bmp', 'png'][x % 8 + 1] AS ext, 'a/b' || x || '.png' AS path")
R.columns("t13_clip_of_path", "objects", lambda: (lambda s: [C("object_id"), s["tag"].alias("tag"), s["clip"].alias("clip")])(text.clip_of_path(F.concat(F.lit("out/"), C("type"), F.lit("/"), F.when(C("x") % 2 == 0, "clip_").otherwise(""), C("x"), F.lit("_blender.json")))),
          "object_id, type AS tag, 'clip_' || x AS clip")
R.columns("t14_describe_track", "objects", lambda: [C("object_id"), text.describe_track(C("type"), C("x") - 100).alias("text")], "object_id, CASE WHEN x > 100 THEN type || ', ' || (x - 100) || ' m long' ELSE type END AS text")

_BOX = lambda p: [C(f"{p}x0"), C(f"{p}y0"), C(f"{p}x1"), C(f"{p}y1")]
R.columns("f1_bbox_overlap", "rects", lambda: [C("rect_id"), predicates.bbox_overlap(_BOX(""), [F.lit(v) for v in (60, 60, 120, 110)]).alias("hit")], "rect_id, x0 <= 120 AND x1 >= 60 AND y0 <= 110 AND y1 >= 60 AS hit")
R.columns("f2_tile_aabb", "rects", lambda: [C("rect_id"), *flat(predicates.tile_aabb(F.array(*[D(c) for c in ("x0", "y0", "tag")], *[D(c) for c in ("tag", "group_id", "x1", "tag", "tag", "tag", "tag", "tag", "y1")]), "XnZ"), "min_x", "max_x", "min_z", "max_z")],
          "rect_id, (x0 - 3 * tag)::DOUBLE AS w_min_x, (x0 + 3 * tag)::DOUBLE AS w_max_x, (-tag - (x1 + tag + y1))::DOUBLE AS w_min_z, (-tag + (x1 + tag + y1))::DOUBLE AS w_max_z")
_HEX = [(1000.0, 1000.0), (9000.0, 500.0), (9500.0, 6000.0), (5000.0, 3000.0), (4000.0, 9500.0), (700.0, 8000.0)]
R.columns("f3_point_in_polygon", "centers", lambda: [C("point_id"), predicates.point_in_polygon(D("x"), D("y"), F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in _HEX])).alias("inside")],
          "point_id, (" + " + ".join(f"CASE WHEN ({a[1]} > y) <> ({b[1]} > y) AND x < {a[0]} + (y - {a[1]}) * ({b[0]} - {a[0]}) / ({b[1]}e0 - {a[1]}) THEN 1 ELSE 0 END" for a, b in zip(_HEX, _HEX[1:] + _HEX[:1], strict=True)) + ") % 2 = 1 AS inside")
R.columns("f5_point_in_obb", "centers", lambda: [C("point_id"), predicates.point_in_obb(D("x"), D("y"), F.lit(1.0), F.array(*[F.lit(v) for v in (5000.0, 5000.0, 0.0, 3000.0, 1000.0, 0.0, -500.0, 1500.0, 0.0, 0.0, 0.0, 2.0)])).alias("inside")],
          "point_id, abs((1500e0 * (x - 5000) + 500e0 * (y - 5000)) / 5000000) <= 1 + 1e-6 AND abs((3000e0 * (y - 5000) - 1000e0 * (x - 5000)) / 5000000) <= 1 + 1e-6 AS inside")


def _tri():
    return [(C("x0"), C("y0")), (C("x1") + C("tag"), C("y0") + 2), (C("x0") + 1, C("y1") + 3)]


R.columns("f7_point_in_triangle", "rects", lambda: [C("rect_id"), predicates.point_in_triangle((C("x0") + C("rect_id") % 7, C("y0") + C("rect_id") % 5), *_tri()).alias("inside")],
          """rect_id, ((x1 + tag - x0) * (rect_id % 5) - 2 * (rect_id % 7) >= 0
             AND (1 - (x1 + tag - x0)) * (rect_id % 5 - 2) - (y1 + 3 - y0 - 2) * (rect_id % 7 - (x1 + tag - x0)) >= 0
             AND (-1) * (rect_id % 5 - (y1 + 3 - y0)) - (-(y1 + 3 - y0)) * (rect_id % 7 - 1) >= 0)
             OR ((x1 + tag - x0) * (rect_id % 5) - 2 * (rect_id % 7) <= 0
             AND (1 - (x1 + tag - x0)) * (rect_id % 5 - 2) - (y1 + 3 - y0 - 2) * (rect_id % 7 - (x1 + tag - x0)) <= 0
             AND (-1) * (rect_id % 5 - (y1 + 3 - y0)) - (-(y1 + 3 - y0)) * (rect_id % 7 - 1) <= 0) AS inside""")
R.columns("f6_segments_intersect", "rects", lambda: [C("rect_id"), predicates.segments_intersect((C("x0"), C("y0")), (C("x1"), C("y1")), (F.lit(0), F.lit(120)), (F.lit(240), F.lit(120))).alias("hit")],
          "rect_id, y0 <= 120 AND y1 >= 120 AS hit")
R.columns("f8_rect_triangle", "rects", lambda: [C("rect_id"), predicates.rect_intersects_triangle([F.lit(v) for v in (100, 100, 140, 140)], (C("x0"), C("y0")), (C("x1"), C("y0")), (C("x0"), C("y1"))).alias("hit")],
          "rect_id, x0 <= 140 AND y0 <= 140 AND x1 >= 100 AND y1 >= 100 AND (greatest(100 - x0, 0)::DOUBLE / (x1 - x0) + greatest(100 - y0, 0)::DOUBLE / (y1 - y0) <= 1) AS hit")
