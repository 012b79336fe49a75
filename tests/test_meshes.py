"""Welding, projection, tile sets, refinement by mask and sampling on small hand-made cases and by brute force."""

import random

import pytest

from lapgrid.operators import mesh, objects, sampling, tiles, tilesets
from lapgrid.operators.rounds import numbered


def test_weld_across_cell_borders(spark):
    rng = random.Random(4)
    rows = [(m, v, *(rng.choice([0, 1, 2, 3]) + rng.choice([-0.03, -0.001, 0.0, 0.001, 0.049, 0.05, 0.3]) for _ in range(3))) for m in (1, 2) for v in range(90)]
    rows += [(3, 0, 0.9999, 0.0, 0.0), (3, 1, 1.0001, 0.0, 0.0), (3, 2, 1.0001, 0.0, 0.0), (3, 3, 2.0, 0.0, 0.0)]
    got = {(r["mesh_id"], r["v"]): r["to"] for r in mesh.weld(spark.createDataFrame(rows, "mesh_id long, v long, x double, y double, z double"), 0.05).collect()}
    root = {(m, v): v for m, v, *_ in rows}
    changed = True
    while changed:
        changed = False
        for m, v, *a in rows:
            for n, w, *b in rows:
                if m == n and sum((p - q) * (p - q) for p, q in zip(a, b, strict=True)) <= 0.05 * 0.05 and root[m, v] < root[n, w]:
                    root[n, w], changed = root[m, v], True
    assert got == root and got[3, 1] == 0 and got[3, 3] == 3 and len(set(root.values())) < len(set(range(90)))


def test_merge_fragments(spark):
    v = spark.createDataFrame([("a", 1, 0, 0.0, 0.0, 0.0), ("a", 1, 1, 1.0, 0.0, 0.0), ("a", 1, 2, 0.0, 0.0, 1.0), ("a", 5, 0, 1.01, 0.0, 0.0), ("a", 5, 1, 0.0, 0.0, 1.02), ("a", 5, 2, 0.0, 0.01, 0.0), ("b", 2, 0, 0.0, 0.0, 0.0)], "tag string, mesh_id long, v long, x double, y double, z double")
    f = spark.createDataFrame([("a", 1, 0, 0, 1, 2), ("a", 5, 0, 0, 1, 2), ("a", 5, 1, 0, 0, 1)], "tag string, mesh_id long, f long, i0 long, i1 long, i2 long")
    points, faces = mesh.merge_fragments(v, f, 0.05)
    assert sorted((r["tag"], r["v"]) for r in points.collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    assert [tuple(r) for r in faces.collect()] == [("a", 0, 0, 1, 2)]


def test_projection_phases(spark):
    """A triangle under (0..4, 0..4): inside, beside it by an offset, by a neighbour, by a neighbour's neighbour, and unreachable."""
    tri = spark.createDataFrame([(0, 0.0, 5.0, 0.0, 4.0, 5.0, 0.0, 0.0, 5.0, 4.0), (1, 0.0, 3.0, 0.0, 4.0, 3.0, 0.0, 0.0, 3.0, 4.0)], "f long, " + ", ".join(f"{c}{k} double" for k in range(3) for c in "xyz"))
    v = spark.createDataFrame([(1, 0, 1.0, 1.0), (1, 1, -0.1, 1.0), (1, 2, -3.0, 1.0), (1, 3, -6.0, 1.0), (1, 4, -9.0, 1.0), (1, 5, -12.0, 1.0), (2, 0, 50.0, 50.0)], "mesh_id long, v long, x double, z double")
    e = spark.createDataFrame([(1, 1, 2), (1, 3, 2), (1, 3, 4), (1, 4, 5), (1, 4, 4)], "mesh_id long, v long, w long")
    out = mesh.project_mesh(v, e, tri, 2)
    assert sorted((r["mesh_id"], r["v"], r["x"], r["y"], r["phase"]) for r in out.collect()) == [(1, 0, 1.0, 5.0, 1), (1, 1, -0.1, 5.0, 2), (1, 2, -3.0, 5.0, 3), (1, 3, -6.0, 5.0, 4), (1, 4, -9.0, 5.0, 5)]
    assert sorted(tuple(r) for r in mesh.projection_counts(v, out).collect()) == [(1, 6, 1, 1, 3, 1), (2, 1, 0, 0, 0, 1)]
    assert [r["v"] for r in mesh.project_plain(v, tri, 2).collect()] == [0]


def test_redirects(spark):
    rows = [("/a/top.json", 1, None, None), ("/a/top.json", 2, 1, "b/x.JSON"), ("/a/top.json", 3, 1, "./b/x.json"), ("/a/top.json", 4, 1, "gone.json"), ("/a/b/x.json", 1, None, "t.b3dm"), ("/a/b/x.json", 2, 1, "../top.json"), ("/a/b/x.json", 3, 1, "/c.json"), ("/c.json", 9, None, "t.glb")]
    nodes = spark.createDataFrame(rows, "file string, node long, parent long, uri string")
    out = {r["tile_id"]: (r["parent_id"], r["status"]) for r in tilesets.assemble(nodes, spark.createDataFrame([("/a/top.json",)], "file string")).collect()}
    top, x = "/a/top.json#", ">/a/b/x.json#"
    assert out[f"{top}1"] == (None, "ok") and out[f"{top}4"] == (f"{top}1", "missing")
    assert out[f"{top}3{x}1"] == (f"{top}3", "ok") and out[f"{top}3{x}2"] == (f"{top}3{x}1", "cycle") and out[f"{top}3{x}3>/c.json#9"] == (f"{top}3{x}3", "ok")
    # The path differs by case only, so there is no such file.
    assert out[f"{top}2"] == (f"{top}1", "missing") and len(out) == 8


def test_virtual_root(spark):
    rows = [("a", 1, None, True, True), ("a", 2, 1, False, False), ("b", 1, None, False, True), ("c", 1, None, True, False)]
    out = tilesets.under_virtual_root(spark.createDataFrame(rows, "file string, node long, parent long, has_mesh boolean, can_refine boolean")).collect()
    assert sorted((r["tile_id"], r["parent_id"]) for r in out) == [("a#1", "root"), ("a#2", "a#1"), ("c#1", "root"), ("root", None)]


def test_refinement_keeps_what_the_budget_leaves(spark):
    rows = [("t", None, 0, 0, 0, 100, 100)] + [(f"t{i}", "t", 1, i * 50, 0, i * 50 + 50, 100) for i in (0, 1)] + [(f"t{i}{j}", f"t{i}", 2, i * 50, j * 50, i * 50 + 50, j * 50 + 50) for i in (0, 1) for j in (0, 1)]
    tree = spark.createDataFrame([(*r[:3], True, r[2] < 2, *r[3:]) for r in rows], "tile_id string, parent_id string, level int, has_mesh boolean, can_refine boolean, x0 long, y0 long, x1 long, y1 long")
    start = spark.createDataFrame([("t",)], "tile_id string")
    mask = spark.createDataFrame([(5, 5, 40, 40)], "x0 long, y0 long, x1 long, y1 long")
    run = lambda m, **k: sorted(tuple(r) for r in tiles.refine_by_mask(tree, start, m, 2, **k).collect())
    assert run(mask) == [("t00", "loaded"), ("t01", "loaded"), ("t1", "loaded")]
    assert run(mask, budget=1) == [("t0", "open"), ("t1", "loaded")] and run(mask, budget=0) == [("t", "open")]
    assert run(mask.limit(0)) == [("t", "loaded")]


def test_sampling_grid(spark):
    square = [(1, 0, k, *p) for k, p in enumerate([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)])]
    hole = [(1, 1, k, *p) for k, p in enumerate([(3.0, 3.0), (7.0, 3.0), (7.0, 7.0), (3.0, 7.0)])]
    thin = [(2, 0, 0, 0.0, 0.0), (2, 0, 1, 5.0, 5.0)]
    of = lambda rows: spark.createDataFrame(rows, "poly long, part int, v int, x double, z double")
    got = sampling.sampling_grid(of(square + hole + thin), 2.0).collect()
    border = [(r["x"], r["z"]) for r in got if r["i"] is None]
    assert sorted(border) == sorted(r[3:] for r in square + hole)
    inner = {(r["x"], r["z"]) for r in got if r["i"] is not None}
    assert inner == {(x, z) for x in (0.0, 2.0, 4.0, 6.0, 8.0) for z in (0.0, 2.0, 4.0, 6.0, 8.0) if not (3 <= x < 7 and 3 <= z < 7)} - {(0.0, 0.0)}
    with pytest.raises(ValueError):
        sampling.sampling_grid(of(square), 0)
    faces = spark.createDataFrame([(1, 0, 0.0, 0.0, 2.0, 0.0, 0.0, 2.0), (1, 1, 4.0, 4.0, 6.0, 4.0, 4.0, 6.0), (1, 2, 9.0, 9.0, 20.0, 9.0, 9.0, 20.0)], "poly long, f long, " + ", ".join(f"{c}{k} double" for k in range(3) for c in "xz"))
    assert [r["f"] for r in sampling.faces_inside(faces, of(square + hole), 4.0).collect()] == [0]


def test_document_errors(spark):
    docs = spark.createDataFrame([(1, "clockwise"), (2, "left"), (3, None)], "layout long, direction string")
    objs = spark.createDataFrame([(1, 0, "a", [1.0, 2.0], [0.0, 1.0], "hotlap"), (2, 0, "", [1.0], None, "pit"), (2, 1, None, [1.0, None], [0.0, 1.0], "hotlap"), (9, 0, None, None, None, None)], "layout long, place long, name string, position array<double>, orientation array<double>, type string")
    got = sorted(((r["layout"], -1 if r["place"] is None else r["place"], r["error"]) for r in objects.document_errors(docs, objs, ["hotlap"]).collect()))
    assert got == [(2, -1, "unknown direction"), (2, 0, "no name"), (2, 0, "orientation must have two values"), (2, 0, "position must have two values"), (2, 1, "no name"), (2, 1, "position has a value that is no number"), (3, -1, "no objects"), (3, -1, "unknown direction")]


def test_numbered(spark):
    df = spark.range(1000).selectExpr("id", "id * 7919 % 101 AS s")
    got = sorted(tuple(r) for r in numbered(df, "place", df["s"].desc(), "id").collect())
    place = {i: p for p, (_, i) in enumerate(sorted((-(i * 7919 % 101), i) for i in range(1000)))}
    assert got == [(i, i * 7919 % 101, place[i]) for i in range(1000)]


def test_quality_report_and_terrain(spark):
    v = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 4.0, 1.0, 0.0), (1, 2, 0.0, 0.0, 4.0), (2, 0, 0.0, 0.0, 0.0)], "mesh_id long, v long, x double, y double, z double")
    f = spark.createDataFrame([(1, 0, 0, 1, 2), (1, 1, 0, 1, 1), (1, 2, 0, 1, 9), (1, 3, 7, 8, 9)], "mesh_id long, f long, i0 long, i1 long, i2 long")
    stated = spark.createDataFrame([(1, 3), (2, 2), (3, 0), (4, None)], "mesh_id long, n_vertices long")
    got = {(r["mesh_id"], r["check"]): (r["value"], r["ok"]) for r in mesh.quality_report(stated, v, f).collect()}
    assert len(got) == 20 and {k: o for (m, k), (_, o) in got.items() if m == 1} == {"exists": True, "faces": True, "y_range": True, "vertex_count": True, "degenerate": False}
    assert got[1, "degenerate"] == (3.0, False) and got[2, "y_range"] == (0.0, False) and got[2, "vertex_count"] == (1.0, False) and got[2, "faces"] == (0.0, False)
    assert got[3, "exists"] == (0.0, False) and got[3, "y_range"] == (None, False) and got[3, "vertex_count"] == (0.0, True) and got[4, "vertex_count"] == (0.0, False)
    tris = spark.createDataFrame([(0, 0.0, 5.0, 0.0, 4.0, 5.0, 0.0, 0.0, 5.0, 4.0), (1, 0.0, 3.0, 0.0, 4.0, 3.0, 0.0, 0.0, 3.0, 4.0)], "f long, " + ", ".join(f"{c}{k} double" for k in range(3) for c in "xyz"))
    p = spark.createDataFrame([(1, 1.0, 0.0, 1.0), (2, 9.0, -7.0, 9.0)], "point_id long, x double, y double, z double")
    assert {r["point_id"]: (r["y"], r["hit"]) for r in mesh.drop_to_terrain(p, tris, 2, 2.0).collect()} == {1: (1.0, True), 2: (-7.0, False)}
