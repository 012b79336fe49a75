"""Start lines and local frames by plain Python and on hand-made cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lapgrid.operators import local_frame, start_line

LINE = "layout long, idx int, x double, y double"
BEND = "layout long, bend int, start int, end int, exit int"


def _ring(n, turn=1, r=100.0):
    return [(r + r * math.cos(turn * 2 * math.pi * i / n), r + r * math.sin(turn * 2 * math.pi * i / n)) for i in range(n)]


def test_driving_direction(spark):
    # Where y points down, growing angles wind clockwise.
    line = spark.createDataFrame([(k, i, *p) for k, turn in ((0, 1), (1, -1)) for i, p in enumerate(_ring(40, turn))], LINE)
    starts = spark.createDataFrame([(0, 200.0, 101.0, True), (1, 200.0, 101.0, True)], "layout long, x double, y double, clockwise boolean")
    got = {r["layout"]: (r["start"], r["n"], r["sign"]) for r in start_line.driving(line, start_line.snap_starts(starts, line, 8)).collect()}
    assert got == {0: (0, 40, 1), 1: (0, 40, -1)}


@pytest.mark.parametrize("sign", [1, -1])
def test_places_against_a_walk(spark, sign):
    rng, n, start = random.Random(5), 90, 17
    curv = [rng.choice([0.1, 0.2, 0.3]) for _ in range(n)]
    bends = [(b, s, e, (e + 1) % n) for b, (s, e) in enumerate([(3, 8), (16, 16), (30, 41), (42, 50), (80, 89)], 1)]
    ways = spark.createDataFrame([(0, start, n, sign), (7, 2, 300, sign)], "layout long, start int, n long, sign int")
    bend = spark.createDataFrame([(0, *b) for b in bends], BEND)
    curved = spark.createDataFrame([(0, i, c) for i, c in enumerate(curv)], "layout long, idx int, curv double")
    order = sorted(bends, key=lambda b: (sign * (b[3] - start)) % n)
    want = {(0, 0): start, (7, 0): 2}
    for k, (a, b) in enumerate(zip(order, order[1:], strict=False), 1):
        at, seen = (a[3] + sign) % n, []
        while at != b[1] and a[3] != b[1]:
            seen.append(at)
            at = (at + sign) % n
        want[0, k] = min(seen, key=lambda i: curv[i]) if seen else a[3]
    assert {(r["layout"], r["number"]): r["idx"] for r in start_line.gate_places(curved, bend, ways).collect()} == want
    assert [r["enter"] for r in start_line.turns(bend, ways).orderBy("turn").collect()] == [b[1] for b in order]
    back = min((b[3] for b in bends if b[3] != start), key=lambda e: (sign * (start - e)) % n)
    assert {r["layout"]: r["idx"] for r in start_line.hotlap_places(bend, ways).collect()} == {0: back, 7: (2 - sign * 15) % 300}


def test_gates_move_off_the_road(spark):
    line = spark.createDataFrame([(0, i, float(i), 50.0) for i in range(100)] + [(1, i, 5.0, 5.0) for i in range(9)], LINE)
    road = spark.createDataFrame([(x, y) for x in range(100) for y in range(46, 100)] + [(5, 5)], "x long, y long")
    gate = spark.createDataFrame([(0, "up", 40.0, 48.0), (0, "down", 40.0, 52.0), (0, "off", 40.0, 10.0), (0, "on the line", 30.0, 50.0), (1, "no way", 5.0, 5.0)], "layout long, name string, x double, y double")
    got = {r["name"]: (r["x"], r["y"], r["moved"]) for r in start_line.repaired(gate, line, road, 3.0, 199, 16, 100, 100).collect()}
    # Downward all is road up to the border of the canvas, which is taken without a margin.
    assert got == {"up": (40.0, 42.0, True), "down": (40.0, 100.0, True), "off": (40.0, 10.0, False), "on the line": (30.0, 100.0, True), "no way": (5.0, 5.0, False)}
    short = start_line.repaired(gate, line, road, 3.0, 20, 16, 100, 100).where("name = 'down'").first()
    assert (short["y"], short["moved"]) == (52.0, False)
    none = start_line.repaired(gate, line, road.where("false"), 3.0, 199, 16, 100, 100)
    assert none.where("moved").count() == 0 and none.count() == 5
    assert start_line.repaired(gate.where("false"), line, road, 3.0, 199, 16, 100, 100).count() == 0


RING = "doc_id long, ord long, crs string, ring array<struct<x: double, y: double>>"
FRAME = "doc_id long, mode string, lat0 double, lon0 double, h0 double, inverse array<double>"
SHIFT = [float(v) for v in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 5, 6, 7, 1)]


def _frames(spark):
    return spark.createDataFrame([(1, "enu", 10.0, 20.0, 0.0, None), (2, "tileset_local", 10.0, 20.0, 0.0, SHIFT), (3, "error", 10.0, 20.0, 0.0, None), (4, "tileset_local", 10.0, 20.0, 0.0, None)], FRAME)


def test_ring_errors(spark):
    at = [(20.0, 10.0), (None, 10.0), (20.001, 10.001)]
    rows = [(1, 1, None, at), (1, 2, "EPSG:32649", at), (2, 3, "EPSG:4326", at), (3, 4, None, at), (4, 5, None, at), (9, 6, None, at), (1, 7, None, []), (1, 8, None, None), (1, 9, None, [(None, None)])]
    rings = spark.createDataFrame(rows, RING)
    out = {r["ord"]: r for r in local_frame.rings_to_local(rings, _frames(spark)).collect()}
    assert {k: r["error"] for k, r in out.items()} == {1: None, 2: "crs", 3: None, 4: "frame", 5: "frame", 6: "frame"}
    a, b = out[1]["points"]
    assert abs(a["x"]) < 1e-6 and abs(a["z"]) < 1e-6 and a["y"] == 0.0
    assert 105 < b["x"] < 112 and 109 < b["z"] < 112
    # A pure shift of earth-centred places: x and y become x and z.
    x, y = (6378137.0 / math.sqrt(1 - 0.0066943799901413165 * math.sin(math.radians(10)) ** 2) * math.cos(math.radians(10)) * f(math.radians(20)) for f in (math.cos, math.sin))
    assert out[3]["points"][0]["x"] == pytest.approx(x + 5, abs=1e-6) and out[3]["points"][0]["z"] == pytest.approx(y + 6, abs=1e-6)
    assert {r["error"] for r in local_frame.rings_to_local(rings.where("ord = 1"), _frames(spark), "const", math.nan).collect()} == {"height"}
    assert local_frame.rings_to_local(rings.where("ord = 1"), _frames(spark), "const", 4.5).first()["points"][0]["y"] == 4.5
    with pytest.raises(ValueError):
        local_frame.rings_to_local(rings, _frames(spark), "up")


def test_repair_of_stored_rings(spark):
    utm, deg = [(500000.0, 1105578.589)], [(20.0, 10.0)]
    rows = [(1, 0, "EPSG:32634", []), (1, 1, "EPSG:32634", utm), (1, 2, "EPSG:32634", deg), (2, 0, "EPSG:32734", [(500000.0, 8894421.411)]), (3, 0, "EPSG:32634", utm), (4, 0, "EPSG:4326", deg), (5, 0, None, utm), (6, 0, None, [])]
    frames = _frames(spark).withColumn("mode", F.expr("CASE WHEN doc_id = 2 THEN 'enu' ELSE mode END"))
    out = local_frame.repair_crs(spark.createDataFrame(rows, RING), frames)
    got = {(r["doc_id"], r["ord"]): r for r in out.collect()}
    assert {k: r["status"] for k, r in got.items()} == {(1, 0): "converted", (1, 1): "converted", (1, 2): "converted", (2, 0): "converted", (3, 0): "unknown", (4, 0): "geographic", (5, 0): "unknown", (6, 0): "empty"}
    # Central meridian of zone 34 is 21 degrees east.
    p, q = got[1, 1]["ring"][0], got[2, 0]["ring"][0]
    assert p["x"] == pytest.approx(21.0, abs=1e-9) and p["y"] == pytest.approx(-q["y"], abs=1e-8) and 9.9 < p["y"] < 10.1
    assert got[1, 1]["points"][0]["x"] > 100_000 and got[1, 0]["points"] is None and got[4, 0]["ring"] == [tuple(deg[0])]
    assert {r["status"]: r["documents"] for r in local_frame.repair_counts(out).collect()} == {"converted": 2, "unknown": 2, "geographic": 1, "empty": 1}


def test_poses(spark):
    schema = "doc_id long, layout string, name string, px double, py double, dx double, dy double"
    rows = [(1, "A", "p", 50.0, 50.0, 1.0, 0.0), (1, None, "q", 50.0, 50.0, None, None), (1, "A", "lost", None, 50.0, 1.0, 0.0), (2, "A", "r", 50.0, 50.0, 0.0, 0.0), (3, "A", "s", 50.0, 50.0, 0.0, 1.0), (1, "A", "t", 50.0, 50.0, 0.0, -2.0)]
    corners = [(20.0 - 0.01, 10.01), (20.01, 10.01), (20.0 - 0.01, 9.99), (20.01, 9.99)]
    images = spark.createDataFrame([(d, 100, 100, *corners) for d in (1, 2, 3)], "doc_id long, width int, height int, " + ", ".join(f"{c} struct<x: double, y: double>" for c in ("tl", "tr", "bl", "br")))
    out = {r["name"]: r for r in local_frame.object_poses(spark.createDataFrame(rows, schema), images, _frames(spark), -2.0).collect()}
    assert set(out) == {"A__p", "Default__q", "A__t", "r"}
    p = out["A__p"]
    assert (round(p["x"], 6), p["y"], round(p["z"], 6)) == (0.0, -2.0, 0.0) and p["hx"] == pytest.approx(1.0, abs=1e-6) and abs(p["hz"]) < 1e-3
    assert out["Default__q"]["hx"] is None and out["r"]["hx"] is None and out["A__t"]["hz"] == pytest.approx(1.0, abs=1e-6)
