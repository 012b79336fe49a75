"""Gates, hot laps and turn names counted from a start line on a closed line (layout, idx, x, y).

A start is one row of a layout: (layout, start, clockwise), the index of the line point and the stated driving direction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import gates, track
from .rounds import cut
from .track import KEY


def snap_starts(starts: DataFrame, line: DataFrame, cell: int) -> DataFrame:
    """(layout, start, clockwise) of start positions (layout, x, y, clockwise); one position for each layout."""
    near = track.nearest_on_line(starts.withColumn("point_id", F.col(KEY)), line, cell)
    return starts.select(KEY, "clockwise").join(near.select(KEY, F.col("idx").alias("start")), KEY)


def driving(line: DataFrame, starts: DataFrame) -> DataFrame:
    """(layout, start, n, sign): sign is 1 where driving follows the index, that is where the line winds as stated, else -1.

    Where y points down a positive area is clockwise; an area of 0 counts as counter-clockwise.
    """
    size = track.ring_measures(line, KEY, "idx").select(KEY, "n", (F.col("area") > 0).alias("winds"))
    return starts.join(size, KEY).select(KEY, "start", "n", F.when(F.col("winds") == F.col("clockwise"), 1).otherwise(-1).alias("sign"))


def surveyed(line: DataFrame, starts: DataFrame, k: int, threshold: float, gap: int, least: int, cell: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The line with its curvature, its bends, and the ways of ``driving`` from start positions (layout, x, y, clockwise).

    Each is written once, as all that follows reads them several times.
    """
    curved = cut(track.curvature(line, k))
    return curved, cut(track.bend_islands(curved, threshold, gap, least)), cut(driving(line, snap_starts(starts, line, cell)))


def _ahead(a: Column, b: Column) -> Column:
    """Steps from index a to index b in driving direction."""
    return F.pmod(F.col("sign") * (b - a), F.col("n"))


def turns(bends: DataFrame, ways: DataFrame) -> DataFrame:
    """Bends (layout, bend, start, end, exit) in the order they are left after the start line: layout, turn (from 1), label, enter, exit.

    A bend left at the start line itself is the first; ties keep the order of bends.
    """
    b = bends.select(KEY, "bend", F.col("start").alias("enter"), "exit").join(ways, KEY)
    order = Window.partitionBy(KEY).orderBy(_ahead(F.col("start"), F.col("exit")), "bend")
    return b.withColumn("turn", F.row_number().over(order)).select(KEY, "turn", F.concat(F.lit("T"), "turn").alias("label"), "enter", "exit")


def hotlap_places(bends: DataFrame, ways: DataFrame) -> DataFrame:
    """(layout, idx): the last bend exit before the start line; without one, max(10, n div 20) points before it."""
    back = F.when(_ahead(F.col("exit"), F.col("start")) > 0, F.struct(_ahead(F.col("exit"), F.col("start")), "exit"))
    near = bends.select(KEY, "exit").join(ways, KEY).groupBy(KEY).agg(F.min(back)["exit"].alias("at"))
    before = F.pmod(F.col("start") - F.col("sign") * F.greatest(F.lit(10), F.floor(F.col("n") / 20)), F.col("n"))
    return ways.join(near, KEY, "left").select(KEY, F.coalesce("at", before).cast("int").alias("idx"))


def gate_places(curved: DataFrame, bends: DataFrame, ways: DataFrame) -> DataFrame:
    """(layout, number, idx): gate 0 at the start line, gate k at the least curvature between turn k's exit and turn k + 1's start.

    Every point between the two counts, ties to the first in driving direction; where none lies between, the exit.
    Each gap lists its points, which meet the line by an equi-join; a gap is at most one lap.
    """
    after = Window.partitionBy(KEY).orderBy("turn")
    gaps = turns(bends, ways).withColumn("next", F.lead("enter").over(after)).where("next IS NOT NULL").join(ways, KEY)
    gaps = gaps.withColumn("steps", _ahead(F.col("exit"), F.col("next")))
    between = F.when(F.col("steps") > 1, F.sequence(F.lit(1).cast("long"), F.col("steps").cast("long") - 1)).otherwise(F.array(F.lit(0).cast("long")))
    listed = gaps.withColumn("d", F.explode(between)).select(KEY, F.col("turn").alias("number"), "d", F.pmod(F.col("exit") + F.col("sign") * F.col("d"), F.col("n")).cast("int").alias("idx"))
    best = listed.join(curved.select(KEY, "idx", "curv"), [KEY, "idx"]).groupBy(KEY, "number").agg(F.min_by("idx", F.struct(F.round("curv", 9), "d")).alias("idx"))
    return ways.select(KEY, F.lit(0).alias("number"), F.col("start").cast("int").alias("idx")).unionByName(best)


def gates_from_start(line: DataFrame, places: DataFrame, ways: DataFrame, road: DataFrame, most: int, tolerance: int, margin: int, least: float, width: int, height: int) -> DataFrame:
    """(layout, name, type, x, y, tx, ty): a left and a right gate at each place, the margin beyond the road, headed in driving direction.

    Ends nearer than ``least`` are set least / 2 to either side of the line.  A point without a direction gives no gate,
    though its number is used.
    """
    points = gates.with_tangent(line).where("tx IS NOT NULL").join(places.select(KEY, "idx").distinct(), [KEY, "idx"], "left_semi")
    ends = gates.widths(points, gates.edges(points, road, most, tolerance, margin, width, height))
    j = ends.join(points, [KEY, "idx"]).join(places, [KEY, "idx"]).join(ways.select(KEY, "sign"), KEY)
    apart = F.sqrt(F.pow(F.col("left.x") - F.col("right.x"), 2) + F.pow(F.col("left.y") - F.col("right.y"), 2))
    # The distance of ends is a sum of whole steps; rounding keeps it from falling short by the tangent's last bit.
    near = F.round(apart, 6) < least

    def side(letter: str, kind: str, end: str, s: int) -> Column:
        x = F.when(near, F.col("x") - s * least / 2 * F.col("ty")).otherwise(F.col(f"{end}.x"))
        y = F.when(near, F.col("y") + s * least / 2 * F.col("tx")).otherwise(F.col(f"{end}.y"))
        return F.struct(F.lit(letter).alias("letter"), F.lit(kind).alias("type"), x.alias("x"), y.alias("y"))

    g = j.withColumn("g", F.explode(F.array(side("L", "timing_left", "left", 1), side("R", "timing_right", "right", -1))))
    return g.select(
        KEY, F.concat(F.lit("AC_TIME_"), "number", F.lit("_"), "g.letter").alias("name"), "g.type", F.round("g.x", 1).alias("x"), F.round("g.y", 1).alias("y"),
        F.round(F.col("sign") * F.col("tx"), 4).alias("tx"), F.round(F.col("sign") * F.col("ty"), 4).alias("ty"))


def repaired(gate: DataFrame, line: DataFrame, road: DataFrame, margin: float, most: int, cell: int, width: int, height: int) -> DataFrame:
    """Gates (layout, name, x, y, ..) with those that stand on the road moved off it; adds moved.

    A gate on the road marches outward from its nearest line point, on its own side, to the first step off the road, and the
    margin beyond; a step off the canvas is taken as it is.  Where ``most`` steps are all road, or the line has no direction,
    the gate stays.  Only gates on the road are measured, and gates at one line point and on one side share a ray.
    """
    pixel = lambda x, y: (F.bround(x.cast("double")).cast("long").alias("px"), F.bround(y.cast("double")).cast("long").alias("py"))
    mask = road.select(F.col("x").alias("px"), F.col("y").alias("py"), F.lit(True).alias("on")).distinct()
    at = gate.select(KEY, F.col("name").alias("point_id"), "x", "y", *pixel(F.col("x"), F.col("y")))
    on = at.where(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1)).join(mask, ["px", "py"], "left_semi").select(KEY, "point_id", "x", "y")
    feet = track.nearest_on_line(on, line, cell).select(KEY, "point_id", "idx")
    l = gates.with_tangent(line).where("tx IS NOT NULL").select(KEY, "idx", F.col("x").cast("double").alias("lx"), F.col("y").cast("double").alias("ly"), "tx", "ty")
    side = F.when((F.col("x") - F.col("lx")) * -F.col("ty") + (F.col("y") - F.col("ly")) * F.col("tx") >= 0, 1).otherwise(-1)
    j = cut(on.join(feet, [KEY, "point_id"]).join(l.hint("merge"), [KEY, "idx"]).withColumn("side", side))
    j = j.select(KEY, "point_id", "idx", "side", "lx", "ly", (-F.col("ty") * F.col("side")).alias("ox"), (F.col("tx") * F.col("side")).alias("oy"))
    ray = j.drop("point_id").distinct().withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(most))))
    ray = ray.select(KEY, "idx", "side", "d", *pixel(F.col("lx") + F.col("ox") * F.col("d"), F.col("ly") + F.col("oy") * F.col("d")))
    ray = ray.withColumn("inside", F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1)).join(mask, ["px", "py"], "left")
    # The first step off the road and whether it is on the canvas, as one number.
    stop = F.min(F.col("d") * 2 + F.when(F.col("inside"), 1).otherwise(0))
    end = ray.where("NOT inside OR on IS NULL").groupBy(KEY, "idx", "side").agg(stop.alias("e"))
    far = F.floor(F.col("e") / 2) + F.when(F.col("e") % 2 == 1, margin).otherwise(0.0)
    new = j.join(end, [KEY, "idx", "side"]).select(KEY, F.col("point_id").alias("name"), F.round(F.col("lx") + F.col("ox") * far, 1).alias("nx"), F.round(F.col("ly") + F.col("oy") * far, 1).alias("ny"))
    out = gate.join(new, [KEY, "name"], "left")
    moved = {"moved": F.col("nx").isNotNull(), "x": F.coalesce("nx", F.col("x").cast("double")), "y": F.coalesce("ny", F.col("y").cast("double"))}
    return out.withColumns(moved).drop("nx", "ny")


def rebuild(
    line: DataFrame, starts: DataFrame, road: DataFrame, others: DataFrame, k: int, threshold: float, gap: int, least_bend: int,
    most: int, tolerance: int, margin: int, least: float, cell: int, width: int, height: int,
) -> DataFrame:
    """(layout, name, type, x, y, tx, ty): all objects of the layouts that have a start position (layout, x, y, clockwise).

    A hot lap on the last bend exit before the start line, gates from the start line, repaired, and the other objects
    (same columns) of those layouts; hot laps and gates among the others are replaced.  The line and the road, each made
    by more than one pass over its table, are written once for all steps.
    """
    line, road = cut(line), cut(road)
    curved, bends, ways = surveyed(line, starts, k, threshold, gap, least_bend, cell)
    made = cut(gates_from_start(line, cut(gate_places(curved, bends, ways)), ways, road, most, tolerance, margin, least, width, height))
    made = repaired(made, line, road, float(margin), 199, cell, width, height).drop("moved")
    lap = hotlap_places(bends, ways).join(gates.with_tangent(line), [KEY, "idx"]).join(ways.select(KEY, "sign"), KEY)
    lap = lap.select(
        KEY, F.lit("AC_HOTLAP_START_0").alias("name"), F.lit("hotlap_start").alias("type"), F.bround(F.col("x").cast("double")).alias("x"), F.bround(F.col("y").cast("double")).alias("y"),
        F.round(F.col("sign") * F.col("tx"), 4).alias("tx"), F.round(F.col("sign") * F.col("ty"), 4).alias("ty"))
    kept = others.where("type NOT IN ('hotlap_start', 'timing_left', 'timing_right')").join(ways.select(KEY), KEY, "left_semi")
    return lap.unionByName(made).unionByName(kept.select(*lap.columns))
