"""Graphs of one-pixel skeletons: dead ends pruned, chains of pixels contracted to edges between junctions.

A pixel's id is y * 2^32 + x.  Neighbours are the eight around it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grid
from .grid import XY
from .rounds import components, cut


def pixel_id(x: str = "x", y: str = "y"):
    return F.col(y).cast("long") * (1 << 32) + F.col(x).cast("long")


def neighbours(px: DataFrame) -> DataFrame:
    """(u, v, slant) for each ordered pair of set pixels side by side; slant is 1 where they touch by a corner only."""
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]))
    p = px.select(*XY).distinct()
    sent = p.withColumn("k", step).select(pixel_id().alias("u"), (F.col("x") + F.col("k.a")).alias("x"), (F.col("y") + F.col("k.b")).alias("y"), F.abs(F.col("k.a") * F.col("k.b")).cast("long").alias("slant"))
    return sent.join(p, XY).select("u", pixel_id().alias("v"), "slant")


def junction_graph(px: DataFrame, most: int = 40) -> DataFrame:
    """(a, b, first, last, steps, slants): the edges between pixels of a degree other than 2, with a <= b.

    An edge is a chain of pixels of degree 2 (or none); first and last are the pixels beside its two ends, steps its moves
    from pixel to pixel, slants those over a corner.  A loop at one junction has a = b.  A closed loop without a junction
    is one edge from its smallest pixel to itself.  Each way along a chain is a list of darts (u, v), ranked by pointer doubling:
    a chain of n pixels takes about log n rounds of one join; where a round ends no further list,
    the rest are closed loops.
    """
    near = cut(neighbours(px))
    degree = near.groupBy("u").agg(F.count("*").alias("degree"))
    chain = cut(degree.where("degree = 2").select(F.col("u").alias("v")))
    darts = near.join(chain.withColumn("on", F.lit(True)), "v", "left")
    # The dart after (u, v) leaves v for its other neighbour.
    after = near.join(chain.select(F.col("v").alias("u")), "u", "left_semi").select(F.col("u").alias("v"), F.col("v").alias("w"))
    inner = darts.where("on").join(after, "v").where("u <> w")
    ends = darts.where("on IS NULL").select("u", "v", F.col("u").alias("eu"), F.col("v").alias("ev"), F.lit(1).cast("long").alias("steps"), F.col("slant").alias("slants"), F.lit(True).alias("done"))
    d = cut(inner.select("u", "v", F.col("v").alias("eu"), F.col("w").alias("ev"), F.lit(1).cast("long").alias("steps"), F.col("slant").alias("slants"), F.lit(False).alias("done")).unionByName(ends))
    open_darts = d.where("NOT done").count()
    for _ in range(most):
        if not open_darts:
            break
        # A dart that is not done has counted the moves up to its pointer's start and goes on with what that one knows.
        t = d.select(F.col("u").alias("eu"), F.col("v").alias("ev"), F.col("eu").alias("fu"), F.col("ev").alias("fv"), F.col("steps").alias("more"), F.col("slants").alias("more_slants"), F.col("done").alias("far"))
        moved = d.where("NOT done").join(t, ["eu", "ev"]).select("u", "v", F.col("fu").alias("eu"), F.col("fv").alias("ev"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("slants") + F.col("more_slants")).alias("slants"), F.col("far").alias("done"))
        d = cut(d.where("done").unionByName(moved))
        left = d.where("NOT done").count()
        if left == open_darts:
            break
        open_darts = left
    else:
        raise RuntimeError(f"a chain is longer than 2^{most}")
    start = d.where("done").join(chain.select(F.col("v").alias("u")), "u", "left_anti")
    edges = start.select(F.col("u").alias("a"), F.col("ev").alias("b"), F.col("v").alias("first"), F.col("eu").alias("last"), "steps", "slants")
    edges = edges.where("a < b OR (a = b AND first < last)")
    loose = d.where("NOT done").select("u", "v").join(near, ["u", "v"])
    loops = cut(components(loose.select(F.col("u").alias("id")).distinct(), loose.select(F.col("u").alias("a"), F.col("v").alias("b"))))
    ring = loose.join(loops, loose["u"] == loops["id"]).groupBy("comp").agg(
        (F.count("*") / 2).cast("long").alias("steps"), (F.sum("slant") / 2).cast("long").alias("slants"), F.min(F.when(F.col("u") == F.col("comp"), F.col("v"))).alias("first"), F.max(F.when(F.col("u") == F.col("comp"), F.col("v"))).alias("last"))
    return edges.unionByName(ring.select(F.col("comp").alias("a"), F.col("comp").alias("b"), "first", "last", "steps", "slants"))


def prune(px: DataFrame, least: int, most: int = 200) -> DataFrame:
    """The pixels without dead ends of fewer than ``least`` pixels, pruned until none is left.

    A dead end is a region of pixels of degree 1 and 2 that holds one of degree 1: a path from an end up to a junction, which stays,
    or to another end.  All short ones of a round go at once.  Single pixels stay.
    """
    p = cut(px.select(*XY).distinct())
    for _ in range(most):
        degree = cut(grid.degrees(p))
        thin = cut(grid.label_components(degree.where("degree IN (1, 2)")))
        dead = thin.join(degree, XY).groupBy("comp").agg(F.count("*").alias("n"), F.min("degree").alias("d")).where((F.col("d") == 1) & (F.col("n") < least)).select("comp")
        gone = cut(thin.join(dead, "comp", "left_semi").select(*XY))
        if not gone.limit(1).count():
            return p
        p = cut(p.join(gone, XY, "left_anti"))
    raise RuntimeError(f"still pruning after {most} rounds")
