"""Meshes as vertices (mesh_id, v, x, y, z) and triangles (mesh_id, f, i0, i1, i2)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rounds import components, cut


def lattice(boxes: DataFrame, step: int) -> DataFrame:
    """Quads (box_id, i, j, x, y) of ceil(width / step) x ceil(height / step) cells over boxes (box_id, x0, y0, x1, y1)."""
    n = lambda a, b: F.ceil((F.col(b) - F.col(a)) / step).cast("int")
    q = boxes.withColumns({"nx": n("x0", "x1"), "ny": n("y0", "y1")}).where("nx > 0 AND ny > 0")
    q = q.withColumn("i", F.explode(F.expr("sequence(0, nx - 1)"))).withColumn("j", F.explode(F.expr("sequence(0, ny - 1)")))
    return q.select("box_id", "i", "j", (F.col("x0") + F.col("i") * step).alias("x"), (F.col("y0") + F.col("j") * step).alias("y"))


def faces_with_corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Each triangle with its corners x0..z2: one join on (mesh_id, v), then one aggregation.

    Vertices often come from an explode, whose estimate is the size of what is exploded; the hint keeps them from being broadcast by it.
    """
    corner = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"i{k}").alias("v")) for k in range(3)]))
    j = faces.select("mesh_id", "f", corner.alias("c")).select("mesh_id", "f", "c.k", "c.v").join(vertices.hint("merge"), ["mesh_id", "v"])
    picks = [F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in range(3) for c in "xyz"]
    return j.groupBy("mesh_id", "f").agg(*picks)


def face_area(f: DataFrame) -> DataFrame:
    """Adds area, of triangles in space."""
    u = [F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"]
    v = [F.col(f"{c}2") - F.col(f"{c}0") for c in "xyz"]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return f.withColumn("area", F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2)


def project_down(points: DataFrame, tris: DataFrame, cell: int, how: str = "max") -> DataFrame:
    """Height (point_id, h) of the highest or lowest triangle above or below each point (point_id, x, z); points without one are left out.

    Places and triangles that occur several times meet once; each point takes the height of its place.
    """
    lo, hi = (lambda c: F.least(*[F.col(f"{c}{k}") for k in range(3)])), (lambda c: F.greatest(*[F.col(f"{c}{k}") for k in range(3)]))
    t = tris.select(*[f"{a}{i}" for a in "xyz" for i in range(3)]).distinct().withColumn("cx", F.explode(F.sequence(F.floor(lo("x") / cell), F.floor(hi("x") / cell)))).withColumn("cz", F.explode(F.sequence(F.floor(lo("z") / cell), F.floor(hi("z") / cell))))
    p = points.select(F.col("x").alias("px"), F.col("z").alias("pz")).distinct().withColumns({"cx": F.floor(F.col("px") / cell), "cz": F.floor(F.col("pz") / cell)})
    # Cells of triangles, and often the points, come from an explode, too.
    j = p.join(t.hint("merge"), ["cx", "cz"])
    c = {k: F.col(k) for k in ("px", "pz", *(f"{a}{i}" for a in "xyz" for i in range(3)))}
    det = (c["z1"] - c["z2"]) * (c["x0"] - c["x2"]) + (c["x2"] - c["x1"]) * (c["z0"] - c["z2"])
    a = ((c["z1"] - c["z2"]) * (c["px"] - c["x2"]) + (c["x2"] - c["x1"]) * (c["pz"] - c["z2"])) / det
    b = ((c["z2"] - c["z0"]) * (c["px"] - c["x2"]) + (c["x0"] - c["x2"]) * (c["pz"] - c["z2"])) / det
    j = j.where(det != 0).withColumns({"a": a, "b": b}).where("a >= 0 AND b >= 0 AND a + b <= 1")
    h = F.col("a") * c["y0"] + F.col("b") * c["y1"] + (1 - F.col("a") - F.col("b")) * c["y2"]
    heights = j.groupBy("px", "pz").agg((F.max if how == "max" else F.min)(h).alias("h"))
    at = points.select("point_id", F.col("x").alias("px"), F.col("z").alias("pz"))
    return at.hint("merge").join(heights, ["px", "pz"]).select("point_id", "h")


#: Cells along a side of a block of ``weld``, rows of a group of blocks, about, and pairs of points measured at once.
_BLOCK, _ROWS, _PAIRS = 16, 1 << 16, 1 << 20


def _places(values: np.ndarray) -> np.ndarray:
    """Whole numbers moved together: neighbours at most two apart stay so, all others become three apart."""
    u, at = np.unique(values, return_inverse=True)
    # Differences as unsigned numbers, which hold any gap.
    gap = np.minimum(np.diff(u.astype(np.uint64)), np.uint64(3)).astype(np.int64)
    return np.concatenate([[0], np.cumsum(gap)])[at]


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """parent, each entry a root, after joining a[i] with b[i]."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def _clusters(mesh_id: np.ndarray, cells: list[np.ndarray], xyz: list[np.ndarray], distance: float) -> np.ndarray:
    """A number for each point, the same for those joined by steps of at most the distance within their mesh."""
    # Meshes are three apart on the first axis.
    x = _places(cells[0])
    axes = [x + mesh_id * (x.max() + 3), _places(cells[1]), _places(cells[2])]
    axes[0] = _places(axes[0])
    sizes = [a.max() + 3 for a in axes]
    code = ((axes[0] + 2) * (sizes[1] + 2) + axes[1] + 2) * (sizes[2] + 2) + axes[2] + 2
    order = np.argsort(code, kind="stable")
    codes, first, count = np.unique(code[order], return_index=True, return_counts=True)
    p = [a[order] for a in xyz]
    parent = np.arange(len(codes))
    steps = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0)]
    # The nearest cells first, as what they join need not be measured again.
    for i, j, k in sorted(steps, key=lambda s: sum(c * c for c in s)):
        to = codes + (i * (sizes[1] + 2) + j) * (sizes[2] + 2) + k
        at = np.minimum(np.searchsorted(codes, to), len(codes) - 1)
        a = np.flatnonzero((codes[at] == to) & (parent != parent[at]))
        b = at[a]
        ends = np.cumsum(count[a] * count[b])
        for lo in range(0, int(ends[-1]) if len(ends) else 0, _PAIRS):
            t = np.arange(lo, min(lo + _PAIRS, int(ends[-1])))
            pair = np.searchsorted(ends, t, side="right")
            t -= ends[pair] - count[a[pair]] * count[b[pair]]
            u, v = first[a[pair]] + t // count[b[pair]], first[b[pair]] + t % count[b[pair]]
            near = np.unique(pair[sum((c[v] - c[u]) * (c[v] - c[u]) for c in p) <= distance * distance])
            parent = _unite(parent, a[near], b[near])
    out = np.empty(len(code), dtype=np.int64)
    out[order] = np.repeat(parent, count)
    return out


def weld(vertices: DataFrame, distance: float) -> DataFrame:
    """(mesh_id, v, to): the smallest vertex that a vertex is joined to by steps of at most ``distance`` within its mesh.

    Vertices of one place are one point.  Points go to the blocks that a ball of half the distance around them touches, so two points within
    the distance share one, and several blocks make a group.  A group joins its own points: cells have a side of distance / sqrt(3), so all points of a cell
    are joined, and those of cells up to two away are measured.  Out come a point's smallest fellow at home and in each other block
    it goes to; only these fellows are the graph whose components are sought in rounds, and neither pairs of points nor of cells are shuffled.
    """
    side = distance / math.sqrt(3) * (1 - 1e-12)
    spot = cut(vertices.where(" AND ".join(f"{c} IS NOT NULL" for c in ("mesh_id", "x", "y", "z"))).groupBy("mesh_id", "x", "y", "z").agg(F.min("v").alias("v")))
    block, reach = side * _BLOCK, distance / 2 * (1 + 1e-9)
    p = spot.withColumns({f"c{c}": F.floor(F.col(c) / side) for c in "xyz"} | {f"h{c}": F.floor(F.col(c) / block) for c in "xyz"})
    for c in "xyz":
        p = p.withColumn(f"b{c}", F.explode(F.sequence(F.least(f"h{c}", F.floor((F.col(c) - reach) / block)), F.greatest(f"h{c}", F.floor((F.col(c) + reach) / block)))))
    groups = max(1, math.ceil(spot.count() * 2 / _ROWS))
    home = F.expr("bx = hx AND by = hy AND bz = hz")
    p = p.select(F.pmod(F.xxhash64("mesh_id", "bx", "by", "bz"), F.lit(groups)).alias("g"), "mesh_id", "v", "x", "y", "z", "cx", "cy", "cz", home.alias("home"))

    names, kinds = spot.columns, dict(spot.dtypes)

    def join(g: pd.DataFrame) -> pd.DataFrame:
        one = _clusters(pd.factorize(g["mesh_id"])[0], [g[f"c{c}"].to_numpy() for c in "xyz"], [g[c].to_numpy(dtype=float) for c in "xyz"], distance)
        return g.assign(w=g["v"].groupby(one).transform("min"))[[*names, "w", "home"]]

    found = cut(p.groupBy("g").applyInPandas(join, ", ".join(f"{c} {kinds[c]}" for c in names) + f", w {kinds['v']}, home boolean"))
    at = found.where("home").drop("home")
    meet = found.where("NOT home").select("mesh_id", "v", F.col("w").alias("b")).join(at.select("mesh_id", "v", F.col("w").alias("a")), ["mesh_id", "v"]).where("a <> b")
    links = cut(meet.select(F.struct("mesh_id", F.col("a").alias("v")).alias("a"), F.struct("mesh_id", F.col("b").alias("v")).alias("b")).distinct())
    ids = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    comp = components(ids, links).select("id.mesh_id", F.col("id.v").alias("w"), F.col("comp.v").alias("to"))
    to = at.join(comp, ["mesh_id", "w"], "left").select("mesh_id", "x", "y", "z", F.coalesce("to", "w").alias("to"))
    return vertices.join(to, ["mesh_id", "x", "y", "z"]).select("mesh_id", "v", "to")


def merge_fragments(vertices: DataFrame, faces: DataFrame, distance: float) -> tuple[DataFrame, DataFrame]:
    """The fragments of each tag as one mesh: vertices (tag, v, x, y, z) and faces (tag, f, i0, i1, i2).

    Fragments (tag, mesh_id) are put one after another, their numbers moved on by what came before (v and f of a fragment count from 0);
    vertices within the distance become one, the smallest; faces that fall flat go, and of faces on the same three vertices the first stays.
    """
    one = ["tag", "mesh_id"]
    before = lambda df, name: df.groupBy(*one).agg(F.count("*").alias("n")).select(*one, (F.sum("n").over(Window.partitionBy("tag").orderBy("mesh_id")) - F.col("n")).alias(name))
    at = cut(before(vertices, "vo").join(before(faces, "fo"), one, "left"))
    v = cut(vertices.join(at, one).select(F.col("tag").alias("mesh_id"), (F.col("v") + F.col("vo")).alias("v"), "x", "y", "z"))
    f = faces.join(at, one).select(F.col("tag").alias("mesh_id"), (F.col("f") + F.col("fo")).alias("f"), *[(F.col(f"i{k}") + F.col("vo")).alias(f"i{k}") for k in range(3)])
    to = cut(weld(v, distance))
    for k in range(3):
        f = f.join(to.select("mesh_id", F.col("v").alias(f"i{k}"), F.col("to").alias("_to")), ["mesh_id", f"i{k}"]).drop(f"i{k}").withColumnRenamed("_to", f"i{k}")
    kept = v.join(to.where("v = to").select("mesh_id", "v"), ["mesh_id", "v"])
    return kept.withColumnRenamed("mesh_id", "tag").select("tag", "v", "x", "y", "z"), distinct_faces(f).withColumnRenamed("mesh_id", "tag")


#: Where a ray is tried again beside a point that has missed, in this order.
OFFSETS = [(0.05, 0.0), (-0.05, 0.0), (0.0, 0.05), (0.0, -0.05), (0.15, 0.0), (-0.15, 0.0), (0.0, 0.15), (0.0, -0.15)]


def project_beside(points: DataFrame, tris: DataFrame, cell: int, offsets: list[tuple[float, float]] = OFFSETS) -> DataFrame:
    """(point_id, h): the height at the first offset that hits a triangle; points (point_id, x, z) without a hit are left out."""
    moves = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(a)).alias("dx"), F.lit(float(b)).alias("dz")) for k, (a, b) in enumerate(offsets)]))
    probe = points.withColumn("m", moves).select(F.struct(F.col("point_id").alias("p"), F.col("m.k").alias("k")).alias("point_id"), (F.col("x") + F.col("m.dx")).alias("x"), (F.col("z") + F.col("m.dz")).alias("z"))
    return project_down(probe, tris, cell).groupBy(F.col("point_id.p").alias("point_id")).agg(F.min_by("h", "point_id.k").alias("h"))


def project_mesh(vertices: DataFrame, edges: DataFrame, tris: DataFrame, cell: int, offsets: list[tuple[float, float]] = OFFSETS, passes: int = 3) -> DataFrame:
    """(mesh_id, v, x, y, z, phase): vertices (mesh_id, v, x, z) put on the terrain, those never reached left out.

    phase 1: the highest triangle at the vertex's own place; 2: at the first offset that hits, the vertex keeping its x and z; 3 and on: the mean height of
    the neighbours over edges (mesh_id, v, w) that have one by the end of the pass before, for so many passes.
    """
    key = F.struct("mesh_id", "v").alias("point_id")
    points = cut(vertices.select(key, "x", "z"))
    hit = project_down(points, tris, cell).withColumn("phase", F.lit(1))
    state = cut(points.join(hit, "point_id", "left"))
    more = project_beside(state.where("h IS NULL").select("point_id", "x", "z"), tris, cell, offsets).withColumnRenamed("h", "h2")
    state = cut(state.join(more, "point_id", "left").select("point_id", "x", "z", F.coalesce("h", "h2").alias("h"), F.when(F.col("h").isNotNull(), 1).when(F.col("h2").isNotNull(), 2).alias("phase")))
    a, b = F.struct("mesh_id", "v").alias("point_id"), F.struct("mesh_id", F.col("w").alias("v")).alias("of")
    both = cut(edges.where("v <> w").select(a, b).unionByName(edges.where("v <> w").select(b.alias("point_id"), a.alias("of"))).distinct())
    for k in range(passes):
        if not state.where("h IS NULL").limit(1).count():
            break
        near = both.join(state.where("h IS NOT NULL").select(F.col("point_id").alias("of"), "h"), "of").groupBy("point_id").agg(F.avg("h").alias("m"))
        state = cut(state.join(near, "point_id", "left").select("point_id", "x", "z", F.coalesce("h", "m").alias("h"), F.when(F.col("h").isNull() & F.col("m").isNotNull(), 3 + k).otherwise(F.col("phase")).alias("phase")))
    return state.where("h IS NOT NULL").select("point_id.mesh_id", "point_id.v", "x", F.col("h").alias("y"), "z", "phase")


def projection_counts(vertices: DataFrame, projected: DataFrame) -> DataFrame:
    """(mesh_id, total, direct, beside, filled, orphans) of a projection."""
    n = projected.groupBy("mesh_id").agg(F.count_if(F.col("phase") == 1).alias("direct"), F.count_if(F.col("phase") == 2).alias("beside"), F.count_if(F.col("phase") > 2).alias("filled"))
    j = vertices.groupBy("mesh_id").agg(F.count("*").alias("total")).join(n, "mesh_id", "left").na.fill(0, ["direct", "beside", "filled"])
    return j.withColumn("orphans", F.col("total") - F.col("direct") - F.col("beside") - F.col("filled"))


def project_plain(vertices: DataFrame, tris: DataFrame, cell: int) -> DataFrame:
    """(mesh_id, v, x, y, z): vertices that hit the terrain straight below or above; misses are removed."""
    points = vertices.select(F.struct("mesh_id", "v").alias("point_id"), "x", "z")
    return points.join(project_down(points, tris, cell), "point_id").select("point_id.mesh_id", "point_id.v", "x", F.col("h").alias("y"), "z")


def distinct_faces(faces: DataFrame) -> DataFrame:
    """Faces with three different vertices, one for each vertex set, the smallest f."""
    k = faces.withColumn("_k", F.sort_array(F.array("i0", "i1", "i2"))).where("i0 <> i1 AND i1 <> i2 AND i0 <> i2")
    return k.groupBy("mesh_id", "_k").agg(F.min(F.struct("f", "i0", "i1", "i2")).alias("m")).select("mesh_id", "m.*")


def orphan_vertices(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    used = faces.select("mesh_id", F.explode(F.array("i0", "i1", "i2")).alias("v")).distinct()
    return vertices.join(used, ["mesh_id", "v"], "left_anti")


def drop_to_terrain(points: DataFrame, tris: DataFrame, cell: int, above: float) -> DataFrame:
    """Points (point_id, x, y, z, ..) set ``above`` over the terrain; adds hit.

    Up is -y, so the ground is the smallest y of the triangles that a point's vertical line meets.  A point that meets none stays.
    """
    ground = project_down(points, tris, cell, "min").select("point_id", F.col("h").alias("_h"))
    j = points.join(ground, "point_id", "left")
    return j.withColumns({"hit": F.col("_h").isNotNull(), "y": F.coalesce(F.col("_h") - above, F.col("y").cast("double"))}).drop("_h")


def quality_report(meshes: DataFrame, vertices: DataFrame, faces: DataFrame, least_range: float = 0.5, least_area: float = 1e-10) -> DataFrame:
    """(mesh_id, check, value, ok), five rows for each of meshes (mesh_id, n_vertices).

    exists: it has vertices; faces: it has faces; y_range: its heights differ by ``least_range`` or more; vertex_count: it has as many
    vertices as stated; degenerate: how many of its faces have an area under ``least_area`` or lack a corner.
    """
    v = vertices.groupBy("mesh_id").agg(F.count("*").alias("n_v"), (F.max("y") - F.min("y")).alias("range"))
    sound = face_area(faces_with_corners(faces, vertices)).groupBy("mesh_id").agg(F.count_if(F.col("area") >= least_area).alias("sound"))
    f = faces.groupBy("mesh_id").agg(F.count("*").alias("n_f"))
    j = meshes.join(v, "mesh_id", "left").join(f, "mesh_id", "left").join(sound, "mesh_id", "left").fillna(0, ["n_v", "n_f", "sound"])
    bad = F.col("n_f") - F.col("sound")
    checks = {
        "exists": (F.col("n_v"), F.col("n_v") > 0), "faces": (F.col("n_f"), F.col("n_f") > 0), "y_range": (F.col("range"), F.coalesce(F.col("range") >= least_range, F.lit(False))),
        "vertex_count": (F.col("n_v"), F.coalesce(F.col("n_v") == F.col("n_vertices"), F.lit(False))), "degenerate": (bad, bad == 0)}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), value.cast("double").alias("value"), ok.alias("ok")) for k, (value, ok) in checks.items()]))
    return j.select("mesh_id", rows.alias("r")).select("mesh_id", "r.*")


def budget(meshes: DataFrame) -> DataFrame:
    """Bytes of meshes (mesh_id, n_vertices, n_faces): 40 a vertex, 20 a face."""
    return meshes.select("mesh_id", (F.col("n_vertices") * 40 + F.col("n_faces") * 20).alias("bytes"))


def _narrowed(rows: DataFrame, states: list[dict], value: str, lo: str, hi: str, parts: int) -> list[dict]:
    """The states with [lo, hi] of value narrowed to the range of counts that holds the k-th row: one row for each piece reaches the driver."""
    at = F.least(F.floor((F.col(value) - F.col(lo)) / (F.col(hi) - F.col(lo)) * parts), F.lit(parts - 1))
    bins = rows.groupBy("piece", "k", at.alias("b")).agg(F.count("*").alias("n"), F.min(value).alias("a"), F.max(value).alias("z"))
    bins = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("piece").orderBy("b")))
    found = {r["piece"]: r for r in bins.where("upto >= k AND upto - n < k").collect()}
    return [s | {lo: found[s["piece"]]["a"], hi: found[s["piece"]]["z"], "n": found[s["piece"]]["n"], "k": s["k"] - found[s["piece"]]["upto"] + found[s["piece"]]["n"]} if s["piece"] in found else s for s in states]


def median_split(items: DataFrame, limit: int, most: int = 10, near: int = 10_000, parts: int = 1024) -> DataFrame:
    """(item_id, piece, too_large): pieces over the limit are cut at the sorted middle of their wider axis, up to so many times; too_large
    marks those still over it.  items: item_id, x, y.

    The middle of each piece is found by counts in ever finer ranges, of the axis and then of item_id among equal values; only the
    rows of a deciding range, at most ``near`` unless they are all equal, are ranked.  The driver holds one row for each open piece, 2^(most - 1) at most.
    """
    spark, types = items.sparkSession, dict(items.dtypes)
    schema = f"piece string, wide boolean, lo double, hi double, ilo {types['item_id']}, ihi {types['item_id']}, n long, k long"
    p = cut(items.select("item_id", "x", "y", F.lit("").alias("piece")))
    v = F.when(F.col("wide"), F.col("x")).otherwise(F.col("y")).cast("double")
    for _ in range(most):
        ends = [f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))]
        open_ = p.groupBy("piece").agg(F.count("*").alias("n"), F.min("item_id").alias("ilo"), F.max("item_id").alias("ihi"), *ends).where(F.col("n") > limit).collect()
        if not open_:
            break
        states = []
        for r in open_:
            wide = r["hix"] - r["lox"] >= r["hiy"] - r["loy"]
            c = "x" if wide else "y"
            states.append({"piece": r["piece"], "wide": wide, "lo": float(r[f"lo{c}"]), "hi": float(r[f"hi{c}"]), "ilo": r["ilo"], "ihi": r["ihi"], "n": r["n"], "k": r["n"] // 2})

        def joined(some: list[dict], how: str = "inner") -> DataFrame:
            of = spark.createDataFrame([tuple(s.values()) for s in some], schema)
            return p.join(F.broadcast(of), "piece", how).withColumn("v", v)  # noqa: B023

        for value, lo, hi in (("v", "lo", "hi"), ("item_id", "ilo", "ihi")):
            while wait := [s for s in states if s["n"] > near and s[lo] < s[hi] and (value == "v" or s["lo"] == s["hi"])]:
                rows = joined(wait).where("v BETWEEN lo AND hi AND item_id BETWEEN ilo AND ihi")
                rest = {s["piece"]: s for s in _narrowed(rows, wait, value, lo, hi, parts)}
                states = [rest.get(s["piece"], s) for s in states]
        q = joined(states, "left")
        inside = (F.col("v").between(F.col("lo"), F.col("hi"))) & (F.col("item_id").between(F.col("ilo"), F.col("ihi")))
        inside = F.coalesce(inside, F.lit(False))
        below = (F.col("v") < F.col("lo")) | ((F.col("v") == F.col("lo")) & (F.col("item_id") < F.col("ilo")))
        plain = q.where(~inside).withColumn("side", F.when(F.col("k").isNull(), "").when(below, "0").otherwise("1"))
        r = F.row_number().over(Window.partitionBy("piece").orderBy("v", "item_id"))
        ranked = q.where(inside).withColumn("_r", r).withColumn("side", F.when(F.col("_r") <= F.col("k"), "0").otherwise("1")).drop("_r")
        p = cut(plain.unionByName(ranked).select("item_id", "x", "y", F.concat("piece", "side").alias("piece")))
    sizes = p.groupBy("piece").agg((F.count("*") > limit).alias("too_large"))
    return p.join(sizes, "piece").select("item_id", "piece", "too_large")


def fill_triangles(tris: DataFrame) -> DataFrame:
    """Pixels (f, x, y) inside or on triangles (f, ax, ay, bx, by, cx, cy) with whole corners, by three edge functions over each box."""
    lo, hi = (lambda c: F.least(*[F.col(p + c) for p in "abc"])), (lambda c: F.greatest(*[F.col(p + c) for p in "abc"]))
    t = tris.withColumn("y", F.explode(F.sequence(lo("y"), hi("y")))).withColumn("x", F.explode(F.sequence(lo("x"), hi("x"))))
    e = [F.expr(f"({q}x - {p}x) * (y - {p}y) - ({q}y - {p}y) * (x - {p}x)") for p, q in ("ab", "bc", "ca")]
    return t.where(((e[0] >= 0) & (e[1] >= 0) & (e[2] >= 0)) | ((e[0] <= 0) & (e[1] <= 0) & (e[2] <= 0))).select("f", "x", "y")


def wall_quads(edges: DataFrame, key: str, bottom: float, top: float) -> DataFrame:
    """Two triangles for each edge (key, ax, ay, bx, by), from bottom to top: (key, ax, ay, part, x0, z0, h0 .. x2, z2, h2)."""
    corners = [[("a", bottom), ("b", bottom), ("b", top)], [("a", bottom), ("b", top), ("a", top)]]
    part = lambda k, c: F.struct(F.lit(k).alias("part"), *[x for i, (e, h) in enumerate(c) for x in (F.col(f"{e}x").alias(f"x{i}"), F.col(f"{e}y").alias(f"z{i}"), F.lit(h).alias(f"h{i}"))])
    return edges.withColumn("t", F.explode(F.array(*[part(k, c) for k, c in enumerate(corners)]))).select(key, "ax", "ay", "t.*")


def pick_box(points: DataFrame, boxes: DataFrame, key: str, cell: int = 16) -> DataFrame:
    """(point_id, box_id): of the boxes of a point's group the first that holds it, else the first.  Points and boxes meet in cells; the first of a group comes from an aggregate."""
    at = lambda c: F.floor(F.col(c) / cell)
    first = boxes.groupBy(key).agg(F.min("box_id").alias("first"))
    b = boxes.withColumn("_cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("_cy", F.explode(F.sequence(at("y0"), at("y1"))))
    holds = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    held = points.select("point_id", key, "x", "y", at("x").alias("_cx"), at("y").alias("_cy")).join(b, [key, "_cx", "_cy"]).where(holds).groupBy("point_id").agg(F.min("box_id").alias("held"))
    return points.select("point_id", key).join(first, key).join(held, "point_id", "left").select("point_id", F.coalesce("held", "first").alias("box_id"))
