"""Joins in the plane.  Both sides are dealt to the cells of a grid, so a range join becomes an equi-join on cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates
from .rounds import cut


def _cells(df: DataFrame, box: list[str], cell: int) -> DataFrame:
    lo = lambda c: F.floor(F.col(c) / cell)
    d = df.withColumn("_cx", F.explode(F.sequence(lo(box[0]), lo(box[2]))))
    return d.withColumn("_cy", F.explode(F.sequence(lo(box[1]), lo(box[3]))))


def box_join(left: DataFrame, right: DataFrame, lbox: list[str], rbox: list[str], cell: int, how: str = "inner", exact: Column | None = None, spread: int | None = None) -> DataFrame:
    """Pairs whose boxes overlap or touch; column names must differ.  A pair is kept in its lowest shared cell, so no distinct is needed.

    ``spread``: a number of partitions for the cells, which are else dealt by their bytes.
    """
    a, b = _cells(left, lbox, cell), _cells(right, rbox, cell).withColumnsRenamed({"_cx": "_rx", "_cy": "_ry"})
    a = a.repartition(spread, "_cx", "_cy") if spread else a
    on = (F.col("_cx") == F.col("_rx")) & (F.col("_cy") == F.col("_ry"))
    hit = (F.col(lbox[0]) <= F.col(rbox[2])) & (F.col(lbox[2]) >= F.col(rbox[0])) & (F.col(lbox[1]) <= F.col(rbox[3])) & (F.col(lbox[3]) >= F.col(rbox[1]))
    first = (F.col("_cx") == F.floor(F.greatest(lbox[0], rbox[0]) / cell)) & (F.col("_cy") == F.floor(F.greatest(lbox[1], rbox[1]) / cell))
    return a.join(b, on & hit & first).drop("_cx", "_cy", "_rx", "_ry") if how == "inner" else a.join(b.hint("merge"), on & hit if exact is None else on & hit & exact, how).drop("_cx", "_cy")


def boxes_hit(left: DataFrame, right: DataFrame, lbox: list[str], rbox: list[str], cell: int, exact: Column | None = None) -> DataFrame:
    """The rows of left whose box overlaps or touches any box of right (and meets the exact test, over columns of lbox and of right).

    Equal boxes of left and equal rows of right meet once, and a box is done with at its first hit in a cell.
    """
    hit = box_join(left.select(*lbox).distinct(), right.distinct(), lbox, rbox, cell, "left_semi", exact).distinct()
    return left.join(hit, lbox, "left_semi")


def rects_overlapping(rects: DataFrame, boxes: DataFrame, key: str = "tile_id") -> DataFrame:
    """The key of the rectangles (x0, y0, x1, y1) that overlap any box (bx0, by0, bx1, by1).

    Both go to cells of their own size class (a power of two), so a large rectangle fills few cells; a rectangle meets the boxes of each class in
    cells of the larger class of the two.
    """
    def sized(df: DataFrame, box: list[str], name: str) -> DataFrame:
        side = F.greatest(F.col(box[2]) - F.col(box[0]), F.col(box[3]) - F.col(box[1]), F.lit(1))
        return df.withColumn(name, F.ceil(F.log2(side)).cast("int"))

    a, b = sized(rects, ["x0", "y0", "x1", "y1"], "ka"), sized(boxes, ["bx0", "by0", "bx1", "by1"], "kb")
    classes = lambda df, k: F.broadcast(df.select(k).distinct())
    # A size class is the exponent of a number, so there are at most about 64 of them.
    a = a.join(classes(b, "kb")).withColumn("k", F.greatest("ka", "kb"))
    b = b.join(classes(rects.transform(lambda d: sized(d, ["x0", "y0", "x1", "y1"], "ka")), "ka")).withColumn("k", F.greatest("ka", "kb"))

    def cells_of(df: DataFrame, box: list[str]) -> DataFrame:
        at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("k")))
        return df.withColumn("cx", F.explode(F.sequence(at(box[0]), at(box[2])))).withColumn("cy", F.explode(F.sequence(at(box[1]), at(box[3]))))

    j = cells_of(a, ["x0", "y0", "x1", "y1"]).join(cells_of(b, ["bx0", "by0", "bx1", "by1"]), ["ka", "kb", "k", "cx", "cy"])
    hit = (F.col("x0") <= F.col("bx1")) & (F.col("x1") >= F.col("bx0")) & (F.col("y0") <= F.col("by1")) & (F.col("y1") >= F.col("by0"))
    return j.where(hit).select(key).distinct()


def ring_edges(ring: DataFrame, key: str, order: str) -> DataFrame:
    """(key, ax, ay, bx, by) of closed rings."""
    w = Window.partitionBy(key).orderBy(order)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(every))
    return ring.select(key, F.col("x").alias("ax"), F.col("y").alias("ay"), nxt("x").alias("bx"), nxt("y").alias("by"))


#: A ring's edges in one band of cells travel as one list up to this length; longer ones are dealt in several.
LIST = 512


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _odd(edges: Column, x: Column, y: Column) -> Column:
    """How many edges of a list lie right of a place."""
    right = lambda e: x < e["ax"] + (y - e["ay"]) * (e["bx"] - e["ax"]) / (e["by"] - e["ay"])
    return F.size(F.filter(edges, lambda e: F.when((e["ay"] > y) != (e["by"] > y), right(e)).otherwise(False)))


def _ring_cells(edges: DataFrame, key: str, cell: float, most: int) -> DataFrame:
    """(key, _b, _c, _n, _e, _full): the cells of band _b and column _c that a ring reaches.

    _full: no edge touches the cell and it lies inside, so that all its points do.  Otherwise _e lists the edges of the band that may be right of its points.  A ring
    with more than ``most`` edges in a band (_n) has several rows for a cell, none of them full.  Cells that no edge touches outside are left out.
    """
    band = lambda c: F.floor(c / cell)
    e = edges.withColumn("_b", F.explode(F.sequence(band(F.least("ay", "by")), band(F.greatest("ay", "by")))))
    # The columns that an edge touches in a band: found once for each edge, not anew in each cell.
    pad, y0 = cell * 1e-6, F.col("_b") * cell
    low, high = F.greatest(F.least("ay", "by"), y0), F.least(F.greatest("ay", "by"), y0 + cell)
    at = lambda y: F.col("ax") + (y - F.col("ay")) * (F.col("bx") - F.col("ax")) / F.when(F.col("ay") != F.col("by"), F.col("by") - F.col("ay"))
    p, q = F.coalesce(at(low), "ax"), F.coalesce(at(high), "bx")
    e = e.select(key, "_b", F.struct("ax", "ay", "bx", "by").alias("e"), F.struct(F.ceil((F.least(p, q) - pad) / cell - 1).alias("a"), F.floor((F.greatest(p, q) + pad) / cell).alias("b")).alias("t"))
    # Few bytes that are much work: a number of partitions that is asked for is not coalesced by size.
    e = e.repartition(_parts(edges), key, "_b")
    w = Window.partitionBy(key, "_b")
    ends = {"_n": F.count("*").over(w), "_left": F.min(F.least("e.ax", "e.bx")).over(w), "_right": F.max(F.greatest("e.ax", "e.bx")).over(w)}
    part = F.pmod(F.xxhash64("e"), F.ceil(F.col("_n") / most)).alias("_part")
    e = e.withColumns(ends).groupBy(key, "_b", "_n", "_left", "_right", part).agg(F.collect_list("e").alias("_e"), F.collect_set("t").alias("_t"))
    # Between two touched columns no edge passes, so one place tells of all cells of a gap; beyond the first and the last it is outside.
    touched = F.array_sort(F.array_distinct(F.flatten(F.transform("_t", lambda t: F.sequence(t["a"], t["b"])))))
    e = e.withColumn("_t", F.when(F.col("_n") <= most, touched).otherwise(F.sequence(band(F.col("_left")), band(F.col("_right")))))
    gaps = F.zip_with("_t", F.slice("_t", 2, F.size("_t")), lambda p, q: F.struct((p + 1).alias("a"), (q - 1).alias("b")))
    inside = F.filter(gaps, lambda g: (g["a"] <= g["b"]) & (_odd(F.col("_e"), (g["a"] + 0.5) * cell, y0 + cell / 2) % 2 == 1))
    named = lambda c, full: F.struct(c.alias("c"), F.lit(full).alias("full"))
    e = e.withColumn("_c", F.explode(F.concat(F.transform("_t", lambda c: named(c, False)), F.flatten(F.transform(inside, lambda g: F.transform(F.sequence(g["a"], g["b"]), lambda c: named(c, True)))))))
    e = e.select(key, "_b", F.col("_c.c").alias("_c"), "_n", "_e", F.col("_c.full").alias("_full"))
    listed = F.filter("_e", lambda e: (e["ay"] != e["by"]) & (F.greatest(e["ax"], e["bx"]) >= F.col("_c") * cell - pad))
    return cut(e.select(key, "_b", "_c", "_n", F.when(~F.col("_full"), listed).alias("_e"), "_full"))


#: Points of one cell travel in lists of so many.
POINTS = 128
#: Up to so many edges of a ring in a cell are written out in the test of a point, as columns; a longer list is interpreted for each pair.
SLOTS = 8
#: A cell's rings are dealt to so many tasks, each of which gets the cell's points.
SHARES = 4


def _finer(points: DataFrame, cell: float, wanted: int = 512) -> float:
    """The side of cells, ``cell`` at most, in which a point has about so many others beside it."""
    n = points.groupBy(F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)).agg(F.count("*").alias("n")).agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("n")).first()["n"]
    return cell / 2.0 ** max(0, math.floor(math.log((n or 1) / wanted, 4)))


def points_in_rings(points: DataFrame, edges: DataFrame, key: str, cell: int, most: int = LIST) -> DataFrame:
    """(point_id, key) for points inside rings, by the parity of edges right of a point.

    Points and rings meet in cells, finer where points are dense.  A cell's points come in lists, which are opened when they have met a ring: a cell that a ring fills
    takes all its points; in the cells of its border each point is tested against the edges listed there, so a pair is made once and no crossing is shuffled.  Only rings
    with more than ``most`` edges in a band count theirs in parts.
    """
    side = _finer(points, cell)
    cells = _ring_cells(edges, key, side, most)
    at = [F.floor(F.col("y") / side).alias("_b"), F.floor(F.col("x") / side).alias("_c")]
    nth = F.row_number().over(Window.partitionBy("_b", "_c").orderBy("point_id"))
    listed = points.select("point_id", "x", "y", *at).withColumn("_p", F.floor((nth - 1) / POINTS)).groupBy("_b", "_c", "_p").agg(F.collect_list(F.struct("point_id", "x", "y")).alias("_l"))
    listed = cut(listed.select("_b", "_c", "_l"))

    def met(rings: DataFrame, lists: DataFrame) -> DataFrame:
        # Few bytes that make many pairs: the number of partitions is asked for.
        rings = rings.withColumn("_s", F.pmod(F.xxhash64(key), F.lit(SHARES))).repartition(4 * _parts(edges), "_b", "_c", "_s")
        return rings.join(lists.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).withColumn("_s", F.col("_s").cast("long")).hint("merge"), ["_b", "_c", "_s"])

    full = met(cells.where("_full").select(key, "_b", "_c"), listed.select("_b", "_c", F.col("_l.point_id").alias("_l"))).select(F.explode("_l").alias("point_id"), key)
    border = cells.where(~F.col("_full") & (F.col("_n") <= most)).select(key, "_b", "_c", "_e")
    few, many = border.where(F.size("_e") <= SLOTS), border.where(F.size("_e") > SLOTS)
    # A slot without an edge has one of no height, which nothing crosses.
    slots = [F.coalesce(F.get("_e", F.lit(i))[c], F.lit(0)).alias(f"_{c}{i}") for i in range(SLOTS) for c in ("ax", "ay", "bx", "by")]
    few = met(few, listed).select(key, "_l", *slots).select(key, *[F.col(f"_{c}{i}") for i in range(SLOTS) for c in ("ax", "ay", "bx", "by")], F.explode("_l").alias("_p"))
    x, y, odd = F.col("_p.x"), F.col("_p.y"), F.lit(False)
    for i in range(SLOTS):
        ax, ay, bx, by = (F.col(f"_{c}{i}") for c in ("ax", "ay", "bx", "by"))
        odd = odd != F.when((ay > y) != (by > y), x < ax + (y - ay) * (bx - ax) / (by - ay)).otherwise(False)
    tested = few.where(odd).select("_p.point_id", key)
    longer = met(many, listed).select(key, "_e", F.explode("_l").alias("_p")).where(_odd(F.col("_e"), x, y) % 2 == 1).select("_p.point_id", key)
    p = points.select("point_id", "x", "y", *at).repartition(_parts(edges), "_b", "_c")
    parts = p.join(cells.where(F.col("_n") > most).hint("merge"), ["_b", "_c"]).select("point_id", key, _odd(F.col("_e"), F.col("x"), F.col("y")).alias("_odd")).where("_odd > 0").groupBy("point_id", key).agg(F.sum("_odd").alias("_odd"))
    return full.unionByName(tested).unionByName(longer).unionByName(parts.where("_odd % 2 = 1").select("point_id", key))


def inside_outer_not_hole(points: DataFrame, edges: DataFrame, key: str, hole: Column, cell: int) -> DataFrame:
    """(point_id) of the points inside some ring that is no hole and inside no hole; ``hole`` is over the key.

    No pair is listed: a cell that a hole fills is done with, and one that an outer ring fills needs no other.  Points of the rest look for one ring of each kind.
    """
    cells = _ring_cells(edges, key, cell, LIST).withColumn("_hole", hole)
    state = cut(cells.groupBy("_b", "_c").agg(
        F.bool_or(F.col("_full") & F.col("_hole")).alias("_gone"), F.bool_or(F.col("_full") & ~F.col("_hole")).alias("_held"), F.bool_or(~F.col("_hole")).alias("_some")).where("NOT _gone AND _some").select("_b", "_c", "_held"))
    at = points.select("point_id", "x", "y", F.floor(F.col("y") / cell).alias("_b"), F.floor(F.col("x") / cell).alias("_c")).repartition(_parts(edges), "_b", "_c").join(state.hint("merge"), ["_b", "_c"])
    border = cut(cells.where("NOT _full").join(state, ["_b", "_c"], "left_semi").select("_b", "_c", "_n", "_e", "_hole", key))
    some = border.where(F.col("_n") <= LIST).withColumnsRenamed({"_b": "_rb", "_c": "_rc"})
    met = (F.col("_b") == F.col("_rb")) & (F.col("_c") == F.col("_rc")) & (_odd(F.col("_e"), F.col("x"), F.col("y")) % 2 == 1)
    # Rings listed in parts are met by pairs.
    long = at.join(border.where(F.col("_n") > LIST).hint("merge"), ["_b", "_c"]).groupBy("point_id", "_hole", key).agg(F.sum(_odd(F.col("_e"), F.col("x"), F.col("y"))).alias("_odd")).where("_odd % 2 = 1")
    holes, outers = some.where("_hole"), some.where("NOT _hole")
    out = at.join(holes.select("_rb", "_rc", "_e").hint("merge"), met, "left_anti").join(long.where("_hole").select("point_id"), "point_id", "left_anti")
    found = out.where("NOT _held").join(outers.select("_rb", "_rc", "_e").hint("merge"), met, "left_semi").select("point_id")
    other = out.where("NOT _held").join(long.where("NOT _hole").select("point_id"), "point_id", "left_semi").select("point_id")
    return out.where("_held").select("point_id").unionByName(found).unionByName(other).distinct()


def fill_rings(edges: DataFrame, key: str) -> DataFrame:
    """Runs (key, y, x0, x1) of pixels whose centre is inside, by paired crossings of each scanline; coordinates are whole."""
    lo, hi = F.least("ay", "by"), F.greatest("ay", "by")
    e = edges.where("ay <> by").withColumn("y", F.explode(F.sequence(lo, hi - 1)))
    at = F.col("ax") + (F.col("y") + 0.5 - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    w = Window.partitionBy(key, "y").orderBy("at", "ax", "bx")
    c = e.withColumn("at", at).withColumns({"r": F.row_number().over(w), "next": F.lead("at").over(w)}).where("r % 2 = 1")
    return c.select(key, "y", F.ceil(F.col("at") - 0.5).alias("x0"), (F.ceil(F.col("next") - 0.5) - 1).alias("x1")).where("x0 <= x1")


#: Up to so many cells are sent to all tasks, to leave out the edges that no point of a round can need.
FEW = 50_000


def _finer_edges(places: DataFrame, edges: DataFrame, key: str, cell: float) -> float:
    """The side of cells, ``cell`` at most, whose pairs of a place and an edge cost about what the edges' own rows cost, a row as much as eight pairs."""
    long = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))
    at = lambda c: F.floor(c / cell)
    e = edges.groupBy(key, at((F.col("ax") + F.col("bx")) / 2).alias("i"), at((F.col("ay") + F.col("by")) / 2).alias("j")).agg(F.count("*").alias("n"), F.sum(long).alias("long"))
    p = places.groupBy(key, at(F.col("x")).alias("i"), at(F.col("y")).alias("j")).agg(F.count("*").alias("m"))
    s = e.join(p.hint("merge"), [key, "i", "j"], "left").agg(F.sum("n").alias("n"), F.sum("long").alias("long"), F.sum(F.col("n").cast("double") * F.col("m")).alias("pairs")).first()
    if not s["n"] or not s["pairs"]:
        return cell
    reach, first = s["long"] / s["n"] * 1.3, cell
    # A segment crosses about 1 + reach / cell cells.
    while s["pairs"] * (cell / first) ** 2 * (1 + reach / cell) > 8 * s["n"] * (1 + reach / cell) and cell > first / 1024:
        cell /= 2
    return cell


def _edge_cells(edges: DataFrame, cell: float) -> DataFrame:
    """Edges with each cell (_c, _r) that they cross or touch."""
    pad = 1e-6
    lo = lambda c: F.floor((c - pad) / cell)
    hi = lambda c: F.floor((c + pad) / cell)
    e = edges.withColumn("_c", F.explode(F.sequence(lo(F.least("ax", "bx")), hi(F.greatest("ax", "bx")))))
    # Where the edge enters and leaves its column of cells.
    slope = F.when(F.col("ax") == F.col("bx"), None).otherwise((F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax")))
    at = lambda x: F.least(F.greatest(F.col("ay") + slope * (x - F.col("ax")), F.least("ay", "by")), F.greatest("ay", "by"))
    y0, y1 = at(F.col("_c") * cell - pad), at((F.col("_c") + 1) * cell + pad)
    low, high = F.when(slope.isNull(), F.least("ay", "by")).otherwise(F.least(y0, y1)), F.when(slope.isNull(), F.greatest("ay", "by")).otherwise(F.greatest(y0, y1))
    return e.withColumn("_r", F.explode(F.sequence(lo(low), hi(high))))


def nearest_edge(points: DataFrame, edges: DataFrame, key: str, cell: int = 32) -> DataFrame:
    """For each point (point_id, group, x, y) the squared distance to the nearest edge of its group; null where the point or all the edges have no place.

    Equal points and equal edges meet once.  Edges go to the cells they cross, finer where points and edges are many.  A place first meets the edges of its own cell and
    of those within a sixteenth of a cell, then those of the nine cells around it that the best so far lets through; it is decided by an edge nearer than what it has seen
    around it.  The rest go on with cells twice as wide, so a point far from all edges takes a few rounds more.  Cells are joined by sorting: their rows are many times
    those of their tables, so a table's size says nothing of what a broadcast would hold.
    """
    from ..functions.geo import closest_point_on_segment

    x, y = F.col("x"), F.col("y")
    d = closest_point_on_segment(x, y, F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))["d2"]
    every = cut(edges.select(key, "ax", "ay", "bx", "by").distinct())
    edges = every.dropna()
    rest = cut(points.select(key, "x", "y").dropna().distinct().join(edges.select(key).distinct(), key, "left_semi").withColumn("d2", F.lit(None).cast("double")))
    left, done, cell = rest.count(), None, float(cell)
    if left:
        cell = _finer_edges(rest, edges, key, cell)
    seen = cell / 16
    while left:
        # How far a place is from the cells before (-1) and after (1) its own.
        c, r = F.floor(x / cell), F.floor(y / cell)
        gap = lambda v, at, k: {-1: v - at * cell, 0: F.lit(0.0), 1: (at + 1) * cell - v}[k]  # noqa: E731, B023
        near = [(i, j, gap(x, c, i) * gap(x, c, i) + gap(y, r, j) * gap(y, r, j)) for i in (0, -1, 1) for j in (0, -1, 1)]
        most = F.least(F.lit(seen * seen), F.col("d2"))
        cells = F.array_compact(F.array(*[F.when(far <= most, F.struct((c + i).alias("_c"), (r + j).alias("_r"))) for i, j, far in near]))
        probe = rest.select(key, "x", "y", "d2", F.explode(cells).alias("_n")).select(key, "x", "y", "d2", "_n._c", "_n._r").repartition(_parts(edges), key, "_c", "_r")
        e = _edge_cells(edges, cell)
        if left <= FEW:
            e = e.join(F.broadcast(probe.select(key, "_c", "_r").distinct()), [key, "_c", "_r"], "left_semi")
        best = probe.join(e.hint("merge"), [key, "_c", "_r"], "left").groupBy(key, "x", "y").agg(F.least(F.min("d2"), F.min(d)).alias("d2"))
        # All edges within ``seen`` or up to the own cell's border have been met.
        border = F.least(*[gap(v, at, k) for v, at in ((x, c), (y, r)) for k in (-1, 1)])
        got = cut(best.withColumn("_done", F.coalesce(F.col("d2") <= F.greatest(F.lit(seen), border) * F.greatest(F.lit(seen), border), F.lit(False))))
        found, rest = got.where("_done").drop("_done"), got.where("NOT _done").drop("_done")
        done = found if done is None else done.unionByName(found)
        left = rest.count()
        seen, cell = (cell, cell) if seen < cell else (cell * 2, cell * 2)
    points = points.select("point_id", key, "x", "y").join(every.select(key).distinct(), key, "left_semi")
    if done is None:
        return points.select("point_id", key, F.lit(None).cast("double").alias("d2")).distinct()
    return points.join(done.hint("merge"), [key, "x", "y"], "left").groupBy("point_id", key).agg(F.min("d2").alias("d2"))


def overzoom(wanted: DataFrame, have: DataFrame, most: int) -> DataFrame:
    """For each wanted map tile (z, x, y) the deepest existing tile that holds it: an equi-join on its ancestors."""
    a = wanted.withColumn("up", F.explode(F.sequence(F.lit(0), F.least(F.col("z"), F.lit(most)))))
    a = a.select("z", "x", "y", (F.col("z") - F.col("up")).alias("hz"), F.expr("shiftright(x, up)").alias("hx"), F.expr("shiftright(y, up)").alias("hy"))
    h = have.select(F.col("z").alias("hz"), F.col("x").alias("hx"), F.col("y").alias("hy")).distinct()
    return a.join(h, ["hz", "hx", "hy"]).groupBy("z", "x", "y").agg(F.max(F.struct("hz", "hx", "hy")).alias("h")).select("z", "x", "y", "h.hz", "h.hx", "h.hy")


def snap_to_valid(points: DataFrame, valid: DataFrame, radius: int) -> DataFrame:
    """Points on a valid pixel stay; others go to the nearest within radius, ties by y then x; none near: null."""
    ok = points.join(valid, ["x", "y"], "left_semi").select("object_id", F.col("x").alias("sx"), F.col("y").alias("sy"))
    bad = points.join(valid, ["x", "y"], "left_anti")
    cell = radius
    p = bad.select("object_id", F.col("x").alias("px"), F.col("y").alias("py"))
    near = F.explode(F.expr(f"flatten(transform(sequence(-1L, 1L), i -> transform(sequence(-1L, 1L), j -> struct(floor(px / {cell}) + i AS cx, floor(py / {cell}) + j AS cy))))"))
    p = p.withColumn("c", near).select("object_id", "px", "py", "c.cx", "c.cy")
    v = valid.select("x", "y", F.floor(F.col("x") / cell).alias("vx"), F.floor(F.col("y") / cell).alias("vy"))
    d2 = (F.col("px") - F.col("x")) * (F.col("px") - F.col("x")) + (F.col("py") - F.col("y")) * (F.col("py") - F.col("y"))
    best = p.join(v, (F.col("cx") == F.col("vx")) & (F.col("cy") == F.col("vy")) & (d2 <= radius * radius)).groupBy("object_id").agg(F.min(F.struct(d2.alias("d2"), "y", "x")).alias("b"))
    moved = bad.select("object_id").join(best, "object_id", "left").select("object_id", F.col("b.x").alias("sx"), F.col("b.y").alias("sy"))
    return ok.unionByName(moved)


#: Maps from a tile's three axes to the plane of the boxes: the second axis, and its sign.
AXIS_MAPS = {"XY": ("y", 1), "XnY": ("y", -1), "XZ": ("z", 1), "XnZ": ("z", -1)}


def axis_vote(tiles: DataFrame, boxes: DataFrame, cell: int, maps: dict[str, tuple[str, int]] = AXIS_MAPS) -> DataFrame:
    """name, hits: of the axis maps the one under which most pairs of a tile (x0, y0, z0, x1, y1, z1) and a box (bx0, by0, bx1, by1) overlap, the first on ties.

    Every tile goes through all maps in one join.  Equal boxes meet once and are counted as often as they occur."""
    def mapped(i: int, name: str, axis: str, sign: int) -> Column:
        lo, hi = (F.col(f"{axis}0"), F.col(f"{axis}1")) if sign > 0 else (-F.col(f"{axis}1"), -F.col(f"{axis}0"))
        return F.struct(F.lit(-i).alias("o"), F.lit(name).alias("name"), F.col("x0").alias("mx0"), lo.alias("my0"), F.col("x1").alias("mx1"), hi.alias("my1"))

    every = tiles.select(F.explode(F.array(*[mapped(i, n, *m) for i, (n, m) in enumerate(maps.items())])).alias("m")).select("m.*")
    every = every.groupBy(*every.columns).agg(F.count("*").alias("_n"))
    side = ["bx0", "by0", "bx1", "by1"]
    some = boxes.groupBy(*side).agg(F.count("*").alias("_m"))
    hits = box_join(every, some, ["mx0", "my0", "mx1", "my1"], side, cell).groupBy("o", "name").agg(F.sum(F.col("_n") * F.col("_m")).alias("hits"))
    return hits.agg(F.max(F.struct("hits", "o", "name")).alias("m")).select("m.name", "m.hits")


def dedupe_boxes(boxes: DataFrame, key: str, columns: list[str], digits: int = 6) -> DataFrame:
    """The key of the first of the boxes that are equal when rounded to so many decimals."""
    return boxes.groupBy(*[F.round(c, digits) for c in columns]).agg(F.min(key).alias(key)).select(key)


def rects_on_triangles(rects: DataFrame, triangles: DataFrame, cell: int) -> DataFrame:
    """The rectangles (x0, y0, x1, y1, others) that touch any triangle (ax, ay, bx, by, cx, cy): boxes meet in cells, then the exact test."""
    t = triangles.select("ax", "ay", "bx", "by", "cx", "cy", F.least("ax", "bx", "cx").alias("tx0"), F.least("ay", "by", "cy").alias("ty0"), F.greatest("ax", "bx", "cx").alias("tx1"), F.greatest("ay", "by", "cy").alias("ty1"))
    c = F.col
    exact = predicates.rect_intersects_triangle([c("x0"), c("y0"), c("x1"), c("y1")], (c("ax"), c("ay")), (c("bx"), c("by")), (c("cx"), c("cy")))
    return boxes_hit(rects, t, ["x0", "y0", "x1", "y1"], ["tx0", "ty0", "tx1", "ty1"], cell, exact).distinct()


#: Keys of equal boxes travel in lists of so many; a pair of lists is opened at once.
KEYS = 128


def box_pairs(boxes: DataFrame, key: str, cell: int, keep: Column) -> DataFrame:
    """(key, b_<key>, x0 .. y1, bx0 .. by1): pairs of boxes (key, x0, y0, x1, y1), the smaller key first, that overlap or touch and that ``keep`` lets through.

    Equal boxes meet once, as one; only pairs that are kept are opened to the keys of both.  Few bytes make very many pairs, so both joins ask for their number of partitions.
    """
    box, other = ["x0", "y0", "x1", "y1"], ["bx0", "by0", "bx1", "by1"]
    # A box often occurs many times: its keys travel in lists, in their order.
    nth = F.row_number().over(Window.partitionBy(*box).orderBy(key))
    keys = cut(boxes.select(key, *box).withColumn("_p", F.floor((nth - 1) / KEYS)).groupBy(*box, "_p").agg(F.collect_list(key).alias("_a"), F.min(key).alias("_low"), F.max(key).alias("_high")).drop("_p"))
    one = keys.select(*box).distinct()
    met = box_join(one, one.toDF(*other).hint("merge"), box, other, cell, spread=_parts(boxes)).where(keep)
    met = met.join(keys.drop("_high").hint("merge"), box).repartition(4 * _parts(boxes), *other)
    met = met.join(keys.select(F.col("_a").alias("_b"), F.col("_high"), *[F.col(a).alias(b) for a, b in zip(box, other, strict=True)]).hint("merge"), other).where("_high > _low")
    # Both lists are opened before the keys are compared: a condition inside a list would be interpreted for each element.
    met = met.select("_b", *box, *other, F.explode("_a").alias(key)).select(key, *box, *other, F.explode("_b").alias(f"b_{key}"))
    return met.where(F.col(f"b_{key}") > F.col(key)).select(key, f"b_{key}", *box, *other)
