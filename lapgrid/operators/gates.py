"""Widths, edges and gates of a track (layout, idx, x, y) on a road mask (x, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import track
from .track import KEY


def edges(points: DataFrame, road: DataFrame, most: int, tolerance: int, margin: int, width: int, height: int) -> DataFrame:
    """(layout, idx, side, edge, margin): how far the road reaches to the left (side 1) and right (-1) of each point (layout, idx, x, y, tx, ty).

    Each side is a ray of whole steps, listed as rows and met with the road by one equi-join; running maxima say
    where road has been seen.  The edge is the first step off the road after road, or the first step off the canvas, or
    ``most``; more than ``tolerance`` steps before any road give 0.  The margin is how far beyond the edge the
    ray can go, up to ``margin``, and one short of other road.
    """
    side = F.explode(F.array(F.lit(1), F.lit(-1)))
    ray = points.where("tx IS NOT NULL").withColumn("side", side).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(most + margin))))
    pixel = lambda c, n: F.bround(F.col(c).cast("double") + n * F.col("side") * F.col("d")).cast("long")
    ray = ray.select(KEY, "idx", "side", "d", pixel("x", -F.col("ty")).alias("px"), pixel("y", F.col("tx")).alias("py"))
    ray = ray.join(road.select(F.col("x").alias("px"), F.col("y").alias("py"), F.lit(True).alias("on")).distinct(), ["px", "py"], "left")
    inside = F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1)
    ray = ray.select(KEY, "idx", "side", "d", inside.alias("inside"), F.coalesce("on", F.lit(False)).alias("on"))
    each = Window.partitionBy(KEY, "idx", "side")
    upto = each.orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    march = F.col("d").between(1, most)
    first = lambda when: F.min(F.when(march & when, F.col("d"))).over(each)
    ray = ray.withColumn("found", F.max("on").over(upto))
    ray = ray.withColumns({"left_at": first(F.col("inside") & ~F.col("on") & F.col("found")), "out_at": first(~F.col("inside")), "late": first(F.col("inside") & ~F.col("found") & (F.col("d") > tolerance))})
    # Of what ends a ray the nearest counts.
    edge = F.least(F.coalesce("left_at", F.lit(most)), F.coalesce("out_at", F.lit(most)))
    ray = ray.withColumn("edge", F.when(F.col("late") < F.least(edge, F.coalesce("out_at", F.lit(most + 1))), 0).otherwise(F.when(F.col("late") == edge, 0).otherwise(edge)))
    met = F.min(F.when(F.col("on") & F.col("inside") & (F.col("d") > F.col("edge")) & (F.col("d") <= F.col("edge") + margin), F.col("d")))
    return ray.groupBy(KEY, "idx", "side", "edge").agg(met.alias("met")).select(KEY, "idx", "side", "edge", F.coalesce(F.col("met") - F.col("edge") - 1, F.lit(margin)).alias("margin"))


def with_tangent(line: DataFrame) -> DataFrame:
    return line.join(track.tangent(line).hint("merge"), [KEY, "idx"])


def widths(points: DataFrame, reach: DataFrame) -> DataFrame:
    """(layout, idx, left, right, width): end points of the cross-section, margins included, and their distance."""
    j = points.join(reach, [KEY, "idx"])
    far = F.col("edge") + F.col("margin")
    end = F.struct((F.col("x") - F.col("side") * far * F.col("ty")).alias("x"), (F.col("y") + F.col("side") * far * F.col("tx")).alias("y"))
    g = j.groupBy(KEY, "idx").agg(F.max(F.when(F.col("side") == 1, end)).alias("left"), F.max(F.when(F.col("side") == -1, end)).alias("right"), F.sum(far).alias("width"))
    return g.select(KEY, "idx", "left", "right", F.col("width").cast("double").alias("width"))


def gates_at_exits(line: DataFrame, bends: DataFrame, road: DataFrame, most: int, tolerance: int, width: int, height: int) -> DataFrame:
    """(layout, name, type, x, y, tx, ty): a left and a right gate at each bend's exit, numbered from 0 in order of bends.

    Only the exits are measured.  A point whose neighbours coincide has no direction and gives no gate, though its number is used.
    """
    exits = bends.select(KEY, (F.col("bend") - 1).alias("number"), F.col("exit").alias("idx"))
    points = with_tangent(line).where("tx IS NOT NULL").join(exits.select(KEY, "idx").distinct(), [KEY, "idx"], "left_semi")
    ends = widths(points, edges(points, road, most, tolerance, 0, width, height)).join(points.select(KEY, "idx", "tx", "ty"), [KEY, "idx"]).join(exits, [KEY, "idx"])
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(t).alias("type"), F.col(c).alias("at")) for s, t, c in (("L", "timing_left", "left"), ("R", "timing_right", "right"))]))
    g = ends.withColumn("g", sides)
    return g.select(KEY, F.concat(F.lit("AC_TIME_"), "number", F.lit("_"), "g.s").alias("name"), "g.type", F.round("g.at.x", 1).alias("x"), F.round("g.at.y", 1).alias("y"), F.round("tx", 4).alias("tx"), F.round("ty", 4).alias("ty"))


def rederive(line: DataFrame, road: DataFrame, k: int, threshold: float, gap: int, least: int, most: int, tolerance: int, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """Bends and gates of an edited centerline; a layout with fewer than ten points gives neither."""
    enough = line.groupBy(KEY).agg(F.count("*").alias("n")).where("n >= 10").select(KEY)
    usable = line.join(enough, KEY, "left_semi")
    bends = track.bend_islands(track.curvature(usable, k), threshold, gap, least)
    return bends, gates_at_exits(usable, bends, road, most, tolerance, width, height)


def snapped(objects: DataFrame, line: DataFrame, cell: int, forward: Column | None = None) -> DataFrame:
    """(point_id, layout, idx, x, y, hx, hy): each object on its nearest line point, headed along the line; ``forward`` false heads against it."""
    near = track.nearest_on_line(objects, line, cell).select("point_id", KEY, "idx")
    sign = F.lit(1) if forward is None else F.when(forward, 1).otherwise(-1)
    j = near.join(with_tangent(line), [KEY, "idx"]).join(objects.drop("x", "y"), ["point_id", KEY])
    return j.select("point_id", KEY, "idx", "x", "y", (sign * F.col("tx")).alias("hx"), (sign * F.col("ty")).alias("hy"))
