"""Outlines of masks: ordered rings, their kind, holes and simplification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import grid, spatial
from .rounds import cut

#: By side (top, right, bottom, left): the way along the edge with the mask on the right, the way outward, and the start corner.
ALONG = [(1, 0), (0, 1), (-1, 0), (0, -1)]
OUT = [(0, -1), (1, 0), (0, 1), (-1, 0)]
START = [(0, 0), (1, 0), (1, 1), (0, 1)]


def _by_side(pairs: list[tuple[int, int]], axis: int):
    return F.element_at(F.array(*[F.lit(p[axis]) for p in pairs]), F.col("side") + 1)


def _successors(px: DataFrame) -> DataFrame:
    """(id, to, vx, vy): each boundary edge, the next one along the outline, and its start corner; regions join in four directions."""
    on = px.select("x", "y").distinct()
    e = grid.boundary_edges(px).withColumns({"ax": F.col("x") + _by_side(ALONG, 0), "ay": F.col("y") + _by_side(ALONG, 1)})
    e = e.withColumns({"dx": F.col("ax") + _by_side(OUT, 0), "dy": F.col("ay") + _by_side(OUT, 1)})
    for a in "ad":
        e = e.join(on.select(F.col("x").alias(f"{a}x"), F.col("y").alias(f"{a}y"), F.lit(True).alias(f"{a}_on")), [f"{a}x", f"{a}y"], "left")
    edge = lambda x, y, side: (y * (1 << 32) + x) * 4 + side
    left, right = (F.col("side") + 3) % 4, (F.col("side") + 1) % 4
    nxt = F.when(F.col("a_on").isNull(), edge(F.col("x"), F.col("y"), right)).when(F.col("d_on").isNull(), edge(F.col("ax"), F.col("ay"), F.col("side"))).otherwise(edge(F.col("dx"), F.col("dy"), left))
    return e.select(edge(F.col("x"), F.col("y"), F.col("side")).alias("id"), nxt.alias("to"), (F.col("x") + _by_side(START, 0)).alias("vx"), (F.col("y") + _by_side(START, 1)).alias("vy"))


def rings(px: DataFrame, most: int = 40) -> DataFrame:
    """(ring_id, ord, x, y): the corners of each outline of a mask in order, the mask on the right hand.

    Edges know their successor by two joins.  Pointer doubling then finds the smallest edge of each loop, and a second time
    the number of steps to it, so a loop of n edges takes about 2 log n rounds of joins, wherever its edges lie.
    """
    edges = cut(_successors(px))
    s = edges.select("id", "to", F.least("id", "to").alias("ring"))
    for _ in range(most):
        t = s.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("ring").alias("r"))
        s = cut(s.join(t, "to").select("id", F.col("far").alias("to"), F.least("ring", "r").alias("ring"), (F.col("r") < F.col("ring")).alias("new")))
        if not s.where("new").limit(1).count():
            break
        s = s.drop("new")
    else:
        raise RuntimeError(f"a ring is longer than 2^{most}")
    owned = edges.join(s.select("id", "ring"), "id")
    # Steps to the ring's first edge, which points to itself.
    d = cut(owned.select("id", F.when(F.col("id") == F.col("ring"), F.col("id")).otherwise(F.col("to")).alias("to"), F.when(F.col("id") == F.col("ring"), 0).otherwise(1).cast("long").alias("steps"), "ring", "vx", "vy"))
    for _ in range(most):
        t = d.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("steps").alias("more"))
        d = cut(d.join(t, "to").select("id", F.col("far").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), "ring", "vx", "vy"))
        if not d.where("to <> ring").limit(1).count():
            break
    n = d.groupBy("ring").agg(F.count("*").alias("n"))
    return d.join(n, "ring").select(F.col("ring").alias("ring_id"), ((F.col("n") - F.col("steps")) % F.col("n")).alias("ord"), F.col("vx").alias("x"), F.col("vy").alias("y"))


def ring_kinds(ring: DataFrame, least: float = 0.0) -> DataFrame:
    """(ring_id, n, area, outer): outlines of at least so many pixels; with y down an outer ring has a positive signed area, a hole a negative one."""
    nxt = ring.select("ring_id", F.col("ord").alias("o"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    n = ring.groupBy("ring_id").agg(F.count("*").alias("n"))
    j = ring.join(n, "ring_id").withColumn("o", (F.col("ord") + 1) % F.col("n")).join(nxt, ["ring_id", "o"])
    a = j.groupBy("ring_id").agg(F.max("n").alias("n"), (F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y")) / 2).alias("area"))
    return a.where(F.abs("area") >= least).withColumn("outer", F.col("area") > 0)


def simplify(ring: DataFrame, share: float, most: int = 64) -> DataFrame:
    """The corners (ring_id, ord, x, y) kept by Douglas-Peucker: the tolerance is a share of the perimeter, at least 1.

    A closed ring is cut at its first corner and the one farthest from it.  All segments of all rings are split in the
    same round: each takes its farthest corner if that is beyond the tolerance, until none is.  Ties go to the smaller place.
    """
    w = Window.partitionBy("ring_id").orderBy("ord")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    n = ring.groupBy("ring_id").agg(F.count("*").alias("n"), F.min_by(F.struct("x", "y"), "ord").alias("first"))
    closed = ring.unionByName(n.select("ring_id", F.col("n").alias("ord"), "first.x", "first.y")).join(n.select("ring_id", "n", "first"), "ring_id")
    off = F.pow(F.col("x") - F.col("first.x"), 2) + F.pow(F.col("y") - F.col("first.y"), 2)
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    closed = closed.withColumns({"off": off, "step": step})
    facts = closed.groupBy("ring_id").agg(F.greatest(share * F.sum("step"), F.lit(1.0)).alias("eps"), F.max(F.struct("off", -F.col("ord"))).alias("m"))
    p = closed.join(facts, "ring_id").withColumn("kept", F.col("ord").isin(0) | (F.col("ord") == F.col("n")) | (F.col("ord") == -F.col("m.col2")))
    p = cut(p.select("ring_id", "ord", "n", "x", "y", "eps", "kept"))
    here = F.when(F.col("kept"), F.struct("ord", "x", "y"))
    for _ in range(most):
        s = p.withColumns({"a": F.last(here, True).over(back), "b": F.first(here, True).over(ahead)}).where("NOT kept")
        ux, uy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
        size = F.sqrt(ux * ux + uy * uy)
        vx, vy = F.col("x") - F.col("a.x"), F.col("y") - F.col("a.y")
        far = F.when(size > 0, F.abs(ux * vy - uy * vx) / size).otherwise(F.sqrt(vx * vx + vy * vy))
        new = s.withColumn("far", far).groupBy("ring_id", F.col("a.ord").alias("a")).agg(F.max(F.struct("far", -F.col("ord"))).alias("m"), F.max("eps").alias("eps")).where("m.far > eps")
        new = cut(new.select("ring_id", (-F.col("m.col2")).alias("ord"), F.lit(True).alias("more")))
        if not new.limit(1).count():
            return p.where("kept AND ord < n").select("ring_id", "ord", "x", "y")
        p = cut(p.join(new, ["ring_id", "ord"], "left").withColumn("kept", F.col("kept") | F.coalesce("more", F.lit(False))).drop("more"))
    raise RuntimeError(f"not simple after {most} rounds")


def holes_to_outers(ring: DataFrame, hole, cell: int) -> DataFrame:
    """(hole_id, outer_id): for each hole (rings for which ``hole`` holds) the outer ring of largest area around its vertex mean; null if none.  ring: ring_id, v, x, y."""
    outers, holes = ring.where(~hole), ring.where(hole)
    centre = holes.groupBy(F.col("ring_id").alias("point_id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    edges = spatial.ring_edges(outers, "ring_id", "v")
    area = edges.groupBy("ring_id").agg(F.abs(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).alias("area"))
    inside = spatial.points_in_rings(centre, edges, "ring_id", cell).join(area, "ring_id")
    best = inside.groupBy("point_id").agg(F.max(F.struct("area", -F.col("ring_id"))).alias("m")).select("point_id", (-F.col("m.col2")).alias("outer_id"))
    return centre.join(best, "point_id", "left").select(F.col("point_id").alias("hole_id"), "outer_id")
