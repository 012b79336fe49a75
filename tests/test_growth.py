"""Copies meet once, and what an explode makes is not broadcast: the rows that joins put out, and the joins' kinds."""

import random

import numpy as np
from pyspark.sql import functions as F

from lapgrid import catalog
from lapgrid.operators import mesh, rounds, spatial, start_line, telemetry, tiles, track
from lapgrid.plans import grid_queries
from lapgrid.streaming import progress


def joins(df):
    """(kind, rows put out) of the joins of a DataFrame's final plan, after it has been collected."""
    df.collect()
    out = []

    def walk(p):
        name = p.nodeName()
        if "Join" in name:
            rows = p.metrics().get("numOutputRows")
            out.append((name, rows.get().value() if rows.isDefined() else 0))
        inner = [p.executedPlan()] if name == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in name else [p.children().apply(i) for i in range(p.children().size())]
        for c in inner:
            walk(c)

    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_corners_are_not_broadcast(spark, sf):
    for name in ("f13_face_area", "a23_mesh_quality"):
        # Of a mesh's report only what is aggregated first may be broadcast.
        df = catalog.QUERIES[name](spark, sf)
        n = df.sparkSession.read.parquet(f"{sf}/customer.parquet").count()
        kinds = joins(df)
        assert [k for k, rows in kinds if rows > 5 * n] and not [k for k, rows in kinds if rows > 5 * n and "Broadcast" in k], kinds


def test_copies_of_points_and_triangles_meet_once(spark):
    points = spark.range(600).select(F.col("id").alias("point_id"), (F.col("id") % 3).alias("x"), F.lit(1).alias("z"))
    tri = {"x0": 0, "y0": 5, "z0": 0, "x1": 9, "y1": 5, "z1": 0, "x2": 0, "y2": 5, "z2": 9}
    tris = spark.range(400).select(F.col("id").alias("f"), *[F.lit(v).alias(k) for k, v in tri.items()])
    for how in ("max", "min"):
        df = mesh.project_down(points, tris, 4, how)
        kinds = joins(df)
        assert max(rows for _, rows in kinds) == 600 and not [k for k, _ in kinds if "Broadcast" in k]
        assert sorted(tuple(r) for r in df.collect()) == [(i, 5.0) for i in range(600)]


def _boxes(spark, n):
    """n boxes on five places, of which two overlap by half."""
    at = F.col("id") % 5
    x0 = F.when(at == 1, 2).otherwise(at * 20)
    return spark.range(n).select(F.col("id").alias("rect_id"), x0.alias("x0"), F.lit(0).alias("y0"), (x0 + 6).alias("x1"), F.lit(6).alias("y1"))


def test_copies_of_boxes_meet_once(spark):
    r = _boxes(spark, 300)
    other = r.toDF("b_id", "bx0", "by0", "bx1", "by1")
    tri = r.where("rect_id % 5 > 1").selectExpr("x0 AS ax", "y0 AS ay", "x1 AS bx", "y0 AS by", "x0 AS cx", "y1 AS cy")
    hit = spatial.boxes_hit(r, other.where("b_id % 5 = 1").drop("b_id"), ["x0", "y0", "x1", "y1"], ["bx0", "by0", "bx1", "by1"], 4)
    assert max(n for _, n in joins(hit)) <= 300
    assert sorted(x[0] for x in hit.select("rect_id").collect()) == [i for i in range(300) if i % 5 < 2]
    touched = spatial.rects_on_triangles(r, tri, 4)
    assert max(n for _, n in joins(touched)) <= 300
    assert sorted(x[0] for x in touched.select("rect_id").collect()) == [i for i in range(300) if i % 5 > 1]
    tiles = r.select("x0", "y0", F.lit(900).alias("z0"), "x1", "y1", F.lit(901).alias("z1"))
    vote = spatial.axis_vote(tiles, other.drop("b_id"), 4)
    assert max(n for _, n in joins(vote)) < 300 and [tuple(x) for x in vote.collect()] == [("XY", 60 * 60 * 7)]
    pairs = spatial.box_pairs(r, "rect_id", 4, F.expr("least(x1, bx1) - greatest(x0, bx0) >= 3"))
    assert max(n for _, n in joins(pairs)) <= 300
    same = lambda a, b: a % 5 == b % 5 or {a % 5, b % 5} == {0, 1}
    assert sorted((x["rect_id"], x["b_rect_id"]) for x in pairs.collect()) == [(a, b) for a in range(300) for b in range(a + 1, 300) if same(a, b)]


def test_pairs_of_boxes_are_opened_by_many_tasks(spark):
    """Few bytes make many pairs: they are spread, and no condition is interpreted for each key of a list."""
    r = spark.range(3000).selectExpr("id AS rect_id", "id % 60 * 20 AS x0", "0L AS y0", "id % 60 * 20 + 6 AS x1", "6L AS y1")
    df = spatial.box_pairs(r, "rect_id", 16, F.lit(True))
    tasks = {t[0]: t[1] for t in df.groupBy(F.spark_partition_id()).count().collect()}
    assert sum(tasks.values()) == 60 * 50 * 49 // 2 and max(tasks.values()) < 60 * 50 * 49 // 4, tasks
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_long_lists_of_equal_boxes(spark, monkeypatch):
    monkeypatch.setattr(spatial, "KEYS", 3, raising=False)
    got = sorted((t[0], t[1]) for t in spatial.box_pairs(_boxes(spark, 40), "rect_id", 4, F.expr("x0 <= bx0")).select("rect_id", "b_rect_id").collect())
    same = lambda a, b: a % 5 == b % 5 or (a % 5, b % 5) == (0, 1)
    assert got == [(a, b) for a in range(40) for b in range(a + 1, 40) if same(a, b)]


def test_nearest_line_point_by_cells(spark):
    """A dense clump, a curve and far points: brute force, and no join as large as points times line."""
    line = [(0, i, 3 + i % 13, 2 + i * 7 % 11) for i in range(400)] + [(1, i, i * 5, (i * i) % 97) for i in range(200)] + [(0, 400 + i, -900 + 7 * i, 400) for i in range(50)]
    points = [(i, i % 3, i * 37 % 1500 - 700, i * 53 % 900 - 300) for i in range(240)] + [(240, 0, None, 5), (241, 1, 10, 1), (242, 1, 10, 1)]
    df = track.nearest_on_line(spark.createDataFrame(points, "point_id long, layout int, x long, y long"), spark.createDataFrame(line, "layout int, idx int, x long, y long"), 16)
    kinds = joins(df)
    want = []
    for p, l, x, y in points:
        if l < 2:
            d = min(((x - a) ** 2 + (y - b) ** 2, i) for m, i, a, b in line if m == l) if x is not None else (None, None)
            want.append((p, l, d[1], d[0]))
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(want, key=repr)
    assert max(n for _, n in kinds) < 10_000, kinds


def test_nearest_line_point_copies(spark):
    points = spark.range(500).select(F.col("id").alias("point_id"), F.lit(0).alias("layout"), F.lit(4).alias("x"), (F.col("id") % 2).alias("y"))
    line = spark.range(300).select(F.lit(0).alias("layout"), F.col("id").cast("int").alias("idx"), F.lit(5).alias("x"), F.lit(0).alias("y"))
    df = track.nearest_on_line(points, line, 16)
    assert max(n for _, n in joins(df)) <= 500
    assert sorted(tuple(r) for r in df.collect()) == [(i, 0, 0, 1 + i % 2) for i in range(500)]


def test_nearest_edges_are_joined_by_sorting(spark, monkeypatch):
    """Cells of points or edges are not broadcast, however small their tables are; equal ones meet once."""
    kinds = []
    monkeypatch.setattr(spatial, "cut", lambda df: kinds.extend(joins(df)) or rounds.cut(df))
    monkeypatch.setattr(spatial, "FEW", 0, raising=False)
    points = spark.range(2000).selectExpr("id AS point_id", "0 AS layout", "id % 20 * 3 AS x", "id div 20 % 5 AS y")
    edges = spark.range(600).selectExpr("0 AS layout", "id % 30 * 2 AS ax", "7L AS ay", "id % 30 * 2 + 40 AS bx", "9L AS by")
    got = spatial.nearest_edge(points, edges, "layout").collect()
    assert not [k for k, rows in kinds if rows > 100 and "Broadcast" in k] and max(rows for _, rows in kinds) <= 100 * 30 * 2, kinds
    near = lambda px, py: min((px - ax - t * 40) ** 2 + (py - 7 - t * 2) ** 2 for ax in range(0, 60, 2) for t in [min(max(((px - ax) * 40 + (py - 7) * 2) / 1604, 0), 1)])
    assert len(got) == 2000 and all(abs(r["d2"] - near(r["point_id"] % 20 * 3, r["point_id"] // 20 % 5)) < 1e-9 for r in got)


def test_gates_at_one_point_share_a_ray(spark):
    road = spark.range(20).select(F.col("id").alias("x"), F.lit(10).alias("y")).union(spark.range(20).select(F.col("id").alias("x"), F.lit(11).alias("y")))
    line = spark.range(20).select(F.lit(0).alias("layout"), F.col("id").cast("int").alias("idx"), F.col("id").alias("x"), F.lit(10).alias("y"))
    gate = spark.range(400).select(F.lit(0).alias("layout"), F.col("id").alias("name"), F.lit(8).alias("x"), (10 + F.col("id") % 3).alias("y"))
    df = start_line.repaired(gate, line, road, 1.0, 30, 16, 32, 32)
    assert max(n for _, n in joins(df)) <= 400
    assert {(r["name"] % 3, r["x"], r["y"], r["moved"]) for r in df.collect()} == {(0, 8.0, 13.0, True), (1, 8.0, 13.0, True), (2, 8.0, 12.0, False)}


def _fan(spark):
    """Sixty copies of a large ring and of a small one within it, each with its own key, the small ones odd; points on a lattice."""
    corner = [(0, 0), (400, 0), (400, 400), (0, 400)], [(100, 100), (190, 100), (190, 190), (100, 190)]
    rings = spark.createDataFrame([(2 * i + k, v, x, y) for i in range(60) for k, c in enumerate(corner) for v, (x, y) in enumerate(c)], "ring_id long, v int, x long, y long")
    points = spark.range(2500).select(F.col("id").alias("point_id"), (F.col("id") % 50 * 10).alias("x"), (F.expr("id div 50") * 10).alias("y"))
    return points, rings


def test_pairs_of_points_and_rings_are_made_once(spark):
    points, rings = _fan(spark)
    inside = lambda i, lo, hi: lo <= i % 50 * 10 < hi and lo <= i // 50 * 10 < hi
    want = {(i, 2 * r) for i in range(2500) for r in range(60) if inside(i, 0, 400)} | {(i, 2 * r + 1) for i in range(2500) for r in range(60) if inside(i, 100, 190)}
    for most in (512, 1):
        df = spatial.points_in_rings(points, spatial.ring_edges(rings, "ring_id", "v"), "ring_id", 32, most)
        got = [tuple(r) for r in df.collect()]
        assert len(got) == len(want) and set(got) == want
        if most > 1:
            # No crossing is counted over a shuffle of pairs.
            assert sum(n for _, n in joins(df)) < 1.5 * len(want)


def test_points_meet_rings_in_lists(spark):
    """A join puts out a list of a cell's points for a ring, not each of their pairs."""
    points, rings = _fan(spark)
    df = spatial.points_in_rings(points, spatial.ring_edges(rings, "ring_id", "v"), "ring_id", 64)
    n = 60 * (1600 + 81)
    assert df.count() == n and sum(rows for _, rows in joins(df)) < n / 10


def test_points_outside_holes_list_no_pairs(spark):
    points, rings = _fan(spark)
    df = spatial.inside_outer_not_hole(points, spatial.ring_edges(rings, "ring_id", "v"), "ring_id", F.col("ring_id") % 2 == 1, 32)
    inside = lambda i, lo, hi: lo <= i % 50 * 10 < hi and lo <= i // 50 * 10 < hi
    assert max(n for _, n in joins(df)) <= 2500
    assert sorted(r[0] for r in df.collect()) == [i for i in range(2500) if inside(i, 0, 400) and not inside(i, 100, 190)]


def test_tags_go_into_joins_once(spark, sf):
    for name, distincts in (("u4_independent_tags", 2), ("s16_pending_tags", 3)):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Aggregate [tag") >= distincts, plan


def test_copies_of_a_plans_boxes_meet_once(spark, monkeypatch):
    monkeypatch.setattr(tiles, "load_plan", lambda t, base, target: t.select("tile_id", "overlaps"))
    t = spark.createDataFrame([("a", 0, 0, 9, 9), ("b", 0, 0, 9, 9), ("c", 50, 50, 60, 60), ("d", None, None, None, None)], "tile_id string, x0 long, y0 long, x1 long, y1 long")
    b = spark.range(400).select(F.lit(3).alias("x0"), F.lit(3).alias("y0"), F.lit(40).alias("x1"), F.lit(40).alias("y1"))
    df = tiles.plan_for_boxes(t, b, 1, 2, 8)
    assert max(n for _, n in joins(df)) < 60
    assert {tuple(r) for r in df.collect()} == {("a", True), ("b", True), ("c", False), ("d", True)}


def test_bends_meet_their_points_by_index(spark):
    curved = spark.range(600).select(F.lit(0).alias("layout"), F.col("id").cast("int").alias("idx"), F.lit(600).alias("n"), F.when(F.col("id") % 6 < 2, 1.0 + F.col("id") % 2).otherwise(0.0).alias("curv"))
    df = track.bend_islands(curved, 0.5)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and (">=" in x or "<=" in x)], plan
    assert sorted((r["start"], r["end"], r["peak"], r["total"], r["exit"]) for r in df.collect()) == [(i, i + 1, i + 1, 3.0, i + 2) for i in range(0, 600, 6)]


def test_laps_and_stages_pass_one_after_another(spark):
    """Short groups cost no call each; what was kept last is carried over batches of Arrow."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        p = spark.range(120).selectExpr("id div 40 AS session_id", "cast(id div 20 AS int) AS lap", "id AS seq", "22.71 + 0.00002D * id AS lat", "113.86D AS lon")
        thin, quiet = telemetry.thin(p, 5.0), progress.throttled(spark.range(60).selectExpr("id div 30 AS run", "id AS ord", "cast(id div 10 AS string) AS stage", "cast(id * 7 % 100 AS int) AS pct"), 20)
        for df in (thin, quiet):
            assert "FlatMapGroups" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(r["seq"] for r in thin.collect()) == [20 * lap + i for lap in range(6) for i in range(0, 20, 3)]
        want, last = [], None
        for i in range(60):
            if i % 10 == 0 or abs(i * 7 % 100 - last) >= 20:
                want.append(i)
                last = i * 7 % 100
        assert sorted(r["ord"] for r in quiet.collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_streams_keep_many_runs_in_a_group(spark, tmp_path):
    """Two micro-batches: a run's stage and a lap's open segment outlast the first; runs share groups."""
    lines = spark.range(200).selectExpr("id % 100 AS run", "id div 100 AS ord", "CASE WHEN id < 100 THEN '=== Stage 1a: x' ELSE '@@PROGRESS@@ 30 y' END AS value")
    points = spark.range(200).selectExpr("1L AS session_id", "cast(id % 100 AS int) AS lap", "id div 100 AS seq", "0D AS t", "0L AS frag", "1D AS lat", "1D AS lon")
    got = []
    for name, df, made, at in (("a", lines, progress.progress_events, "ord"), ("b", points, progress.segment_stream, "seq")):
        for k in (0, 1):
            df.where(f"{at} = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = made(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
        assert "floor" in stream._jdf.queryExecution().analyzed().toString().lower()
        got.append(sorted(tuple(r) for r in progress.run_to_table(stream, str(tmp_path / f"{name}-out")).collect()))
    assert got == [[(i, 1, "1a", 30) for i in range(100)], [(1, i, s, 0) for i in range(100) for s in (0, 1)]]


def test_weld_shuffles_no_pairs_of_points(spark, monkeypatch):
    """Dense points give the graph no more links than there are points that go to several blocks; the result is that of all pairs."""
    links = []
    monkeypatch.setattr(mesh, "components", lambda ids, near: links.append(near.count()) or rounds.components(ids, near))
    r = random.Random(7)
    rows = [(m, 4000 * m + i, r.randrange(-60, 60), r.randrange(3), r.randrange(-60, 60)) for m in range(3) for i in range(700)]
    got = {(a, v): to for a, v, to in mesh.weld(spark.createDataFrame(rows, "mesh_id long, v long, x long, y long, z long"), 3.5).collect()}
    to = {(a, v): v for a, v, *_ in rows}
    near = [(p, q) for i, p in enumerate(rows) for q in rows[:i] if p[0] == q[0] and sum((s - t) ** 2 for s, t in zip(p[2:], q[2:], strict=True)) <= 12.25]
    while True:
        moved = False
        for p, q in near:
            low = min(to[p[:2]], to[q[:2]])
            moved |= to[p[:2]] != low or to[q[:2]] != low
            to[p[:2]] = to[q[:2]] = low
        if not moved:
            break
    assert got == to and len(set(to.values())) > 30
    assert links[0] < len(rows) / 2 < len(near)


def test_clusters_measure_pairs_in_pieces(monkeypatch):
    cells = [np.array([0, 1, 1, 9, -2, 0]), np.zeros(6, dtype=np.int64), np.array([0, 0, 0, 0, 0, 0])]
    xyz = [np.array([0.9, 1.1, 1.9, 9.0, -1.5, 0.5]), np.zeros(6), np.zeros(6)]
    for most in (1, 2, 100):
        monkeypatch.setattr(mesh, "_PAIRS", most)
        one = mesh._clusters(np.array([0, 0, 0, 0, 0, 1]), cells, xyz, 1.0)
        assert one[0] == one[1] == one[2] and len(set(one.tolist())) == 4


def test_rebuilt_objects_read_their_line_and_road_once(spark, monkeypatch):
    plans = []

    def seen(real, *places):
        return lambda *args: plans.extend(args[i]._jdf.queryExecution().optimizedPlan().toString() for i in places) or real(*args)

    monkeypatch.setattr(start_line, "gates_from_start", seen(start_line.gates_from_start, 0, 3))
    monkeypatch.setattr(start_line, "repaired", seen(start_line.repaired, 1, 2))
    catalog.QUERIES["o3_rebuilt_objects"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 4 and not [p for p in plans if "Generate" in p or "Window" in p], plans


def test_equal_boxes_are_filled_once(spark):
    boxes = spark.range(300).select(F.lit(1).alias("tag"), *[F.lit(v).alias(c) for c, v in (("x0", 0), ("y0", 0), ("x1", 20), ("y1", 20))])
    df = grid_queries.filled(boxes)
    assert df.count() == 441
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # Below the first explode the boxes are already distinct.
    last = max(i for i, x in enumerate(plan) if "Generate" in x)
    assert any("Aggregate" in x for x in plan[last:]), plan
