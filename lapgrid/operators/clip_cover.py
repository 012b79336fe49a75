"""Clip boxes that cover masks: a greedy set cover in rounds, one box of each mask a round, with the terms of its score.

Masks are runs (mask_id, y, x0, x1) on canvases of one size; boxes are (mask_id, bx, by), the upper left corner of a clip of w x h
pixels.  Every mask's cover is a sequence, as each box must overlap one chosen before; the masks advance side by side.  Pixels never meet
boxes: runs do, in bands of rows, and after the first count only the runs a round takes away meet the boxes around them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grid
from .rounds import cut

BOX = ["mask_id", "bx", "by"]
#: Shares of the clip by which boxes around a sampled pixel are moved, and weights of the score's terms.
SHIFT, CORE_WEIGHT, FILL_WEIGHT, PERIMETER_WEIGHT, ODD, THIN, THIN_WEIGHT = 0.18, 0.25, 0.10, 0.02, 2.5, 0.03, 0.25


def dilated(runs: DataFrame, rx: int, ry: int, width: int, height: int) -> DataFrame:
    """The masks grown by a rectangle, as runs."""
    wide = runs.select("mask_id", F.explode(F.sequence(F.greatest(F.col("y") - ry, F.lit(0)), F.least(F.col("y") + ry, F.lit(height - 1)))).alias("y"),
                       F.greatest(F.col("x0") - rx, F.lit(0)).alias("x0"), F.least(F.col("x1") + rx, F.lit(width - 1)).alias("x1"))
    return grid.join_runs(wide.distinct(), "mask_id")


def pixels_in(boxes: DataFrame, runs: DataFrame, w: int, h: int) -> DataFrame:
    """(mask_id, bx, by, n): set pixels in each box that has some.  A run lies in one band of h rows, a box in two."""
    b = boxes.select(*BOX, F.explode(F.array_distinct(F.array(F.floor(F.col("by") / h), F.floor((F.col("by") + h - 1) / h)))).alias("band"))
    r = runs.select("mask_id", "y", "x0", "x1", F.floor(F.col("y") / h).alias("band"))
    j = b.join(r, ["mask_id", "band"]).where((F.col("y") >= F.col("by")) & (F.col("y") < F.col("by") + h) & (F.col("x0") < F.col("bx") + w) & (F.col("x1") >= F.col("bx")))
    return j.groupBy(*BOX).agg(F.sum(F.least("x1", F.col("bx") + w - 1) - F.greatest("x0", "bx") + 1).cast("long").alias("n"))


def _sides(boxes: DataFrame, lines: DataFrame, at: str, along: str, size: int, far: int, first: str, last: str) -> DataFrame:
    """(mask_id, bx, by, segments, hits, corners) over a box's two sides along one axis, from runs of that axis."""
    side = boxes.select(*BOX, F.explode(F.array(F.col(at), F.col(at) + far - 1)).alias("line"))
    j = side.join(lines, ["mask_id", "line"]).where((F.col(first) < F.col(along) + size) & (F.col(last) >= F.col(along)))
    end = F.col(along) + size - 1
    return j.groupBy(*BOX).agg(
        F.count("*").alias("segments"), F.sum(F.least(last, end) - F.greatest(first, along) + 1).cast("long").alias("hits"),
        F.sum((F.col(first) <= F.col(along)).cast("long") + (F.col(last) >= end).cast("long")).alias("corners"))


def perimeter(boxes: DataFrame, runs: DataFrame, w: int, h: int) -> DataFrame:
    """(mask_id, bx, by, border, segments): pixels of the mask on each box's border (corners count twice) and the runs they form on the way around it."""
    columns = grid.to_runs(grid.from_runs(runs, "mask_id").select("mask_id", F.col("y").alias("x"), F.col("x").alias("y")), "mask_id")
    a = _sides(boxes, runs.select("mask_id", F.col("y").alias("line"), "x0", "x1"), "by", "bx", w, h, "x0", "x1")
    b = _sides(boxes, columns.select("mask_id", F.col("y").alias("line"), F.col("x0").alias("y0"), F.col("x1").alias("y1")), "bx", "by", h, w, "y0", "y1")
    # Two sides meet at a set corner, so their segments are one; on a border that is all set nothing is left but one ring.
    both = a.unionByName(b.withColumn("corners", F.lit(0).cast("long"))).groupBy(*BOX).agg(*[F.sum(c).alias(c) for c in ("segments", "hits", "corners")])
    return both.select(*BOX, F.col("hits").alias("border"), F.greatest(F.col("segments") - F.col("corners"), F.lit(1)).cast("long").alias("segments"))


def range_sums(values: DataFrame, asked: DataFrame, line: list[str], ids: list[str]) -> DataFrame:
    """(ids, total): the sum of values (line, at, value) with lo <= at <= hi on the asked line, by one sweep over each line."""
    probe = F.explode(F.array(F.struct((F.col("lo") - 1).alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("hi").alias("at"), F.lit(1).alias("sign"))))
    q = asked.select(*line, *ids, probe.alias("p")).select(*line, F.col("p.at").cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(0.0).alias("value"), F.col("p.sign").alias("sign"), F.struct(*ids).alias("who"))
    v = values.select(*line, F.col("at").cast("long").alias("at"), F.lit(0).alias("kind"), F.col("value").cast("double").alias("value"), F.lit(0).alias("sign"), F.lit(None).cast(q.schema["who"].dataType).alias("who"))
    upto = F.sum("value").over(Window.partitionBy(*line).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    swept = v.unionByName(q).withColumn("upto", upto).where("kind = 1")
    return swept.groupBy("who").agg(F.sum(F.col("sign") * F.col("upto")).alias("total")).select("who.*", "total")


def core_cut(boxes: DataFrame, depth: DataFrame, w: int, h: int, thick: int) -> DataFrame:
    """(mask_id, bx, by, core): the sum of depth (mask_id, x, y, depth) over strips along the four sides; corners count twice."""
    strip = F.explode(F.sequence(F.lit(0), F.lit(2 * thick - 1)))
    row = boxes.withColumn("k", strip).select(*BOX, F.lit("y").alias("axis"), F.when(F.col("k") < thick, F.col("by") + F.col("k")).otherwise(F.col("by") + h - 2 * thick + F.col("k")).alias("line"), F.col("bx").alias("lo"), (F.col("bx") + w - 1).alias("hi"))
    col = boxes.withColumn("k", strip).select(*BOX, F.lit("x").alias("axis"), F.when(F.col("k") < thick, F.col("bx") + F.col("k")).otherwise(F.col("bx") + w - 2 * thick + F.col("k")).alias("line"), F.col("by").alias("lo"), (F.col("by") + h - 1).alias("hi"))
    values = depth.select("mask_id", F.lit("y").alias("axis"), F.col("y").alias("line"), F.col("x").alias("at"), F.col("depth").alias("value")).unionByName(
        depth.select("mask_id", F.lit("x").alias("axis"), F.col("x").alias("line"), F.col("y").alias("at"), F.col("depth").alias("value")))
    asked = row.unionByName(col).withColumn("box_mask", F.col("mask_id"))
    out = range_sums(values, asked, ["mask_id", "axis", "line"], ["box_mask", "bx", "by"])
    return out.groupBy("box_mask", "bx", "by").agg(F.sum("total").alias("core")).withColumnRenamed("box_mask", "mask_id")


def score_terms(boxes: DataFrame, runs: DataFrame, w: int, h: int, depth: DataFrame | None = None) -> DataFrame:
    """Boxes with fill (pixels of the mask inside), border, segments, evenodd (0 to less, odd counts of segments worse) and core."""
    fill = pixels_in(boxes, runs, w, h).withColumnRenamed("n", "fill")
    out = boxes.select(*BOX).join(fill, BOX, "left").join(perimeter(boxes, runs, w, h), BOX, "left")
    thick = max(1, min(round(min(w, h) * 0.02), 12))
    core = F.lit(0.0)
    if depth is not None:
        out = out.join(core_cut(boxes, depth, w, h, thick), BOX, "left")
        core = F.coalesce("core", F.lit(0.0)) / (thick * (w + h))
    border, segments = F.coalesce("border", F.lit(0)).cast("long"), F.coalesce("segments", F.lit(0)).cast("long")
    evenodd = F.when(segments % 2 == 0, -1.0 * border).otherwise(-ODD * border)
    return out.select(*BOX, F.coalesce("fill", F.lit(0)).cast("long").alias("fill"), border.alias("border"), segments.alias("segments"), evenodd.alias("evenodd"), core.alias("core"))


def score(gain: Column, fill: Column, evenodd: Column, core: Column, excess: Column, excess_weight: float, area: int) -> Column:
    """New pixels over the cost of cutting through cores and of overlap beyond the least, with small terms for filling and border, less for boxes that hardly touch."""
    cost = 1.0 + excess_weight * excess + CORE_WEIGHT * core
    plain = gain / cost + FILL_WEIGHT * fill / area + PERIMETER_WEIGHT * evenodd / area
    share = fill / area
    return F.when(share < THIN, plain - THIN_WEIGHT * area * (THIN - share)).otherwise(plain)


def candidates(uncovered: DataFrame, chosen: DataFrame | None, width: int, height: int, w: int, h: int, overlap: float, points: int) -> DataFrame:
    """(mask_id, bx, by): places on a lattice of half steps, around every k-th uncovered pixel in row order, and a step or half a step from chosen boxes.

    A step leaves the least overlap; k makes about ``points`` pixels of each mask."""
    sx, sy = max(1, round((1 - overlap) * w / 2)), max(1, round((1 - overlap) * h / 2))
    mx, my = int(overlap * w), int(overlap * h)
    on = lambda c, most: F.greatest(F.lit(0), F.least(c, F.lit(most)))
    ends = uncovered.groupBy("mask_id").agg(*[f(c).cast("int").alias(n) for n, f, c in (("xa", F.min, "x0"), ("xb", F.max, "x1"), ("ya", F.min, "y"), ("yb", F.max, "y"))])

    def places(a: str, b: str, margin: int, most: int, step: int) -> Column:
        lo = on(F.col(a) - margin, most)
        hi = F.greatest(lo, on(F.col(b) + 1 + margin, most))
        return F.explode(F.array_distinct(F.concat(F.sequence(lo, hi, F.lit(step)), F.array(hi))))

    lattice = ends.withColumn("bx", places("xa", "xb", mx, width - w, sx)).withColumn("by", places("ya", "yb", my, height - h, sy)).select(*BOX)
    sample = grid.strided_sample(uncovered, points, "mask_id")
    moves = lambda some: F.explode(F.array(*[F.lit(d) for d in some]))
    dx, dy = int(SHIFT * w), int(SHIFT * h)
    around = sample.withColumn("dx", moves((-dx, 0, dx))).withColumn("dy", moves((-dy, 0, dy))).select(
        "mask_id", on(F.col("x") - w // 2 + F.col("dx"), width - w).cast("int").alias("bx"), on(F.col("y") - h // 2 + F.col("dy"), height - h).cast("int").alias("by"))
    out = lattice.unionByName(around)
    if chosen is not None:
        steps = chosen.withColumn("dx", moves((0, sx, -sx, 2 * sx, -2 * sx))).withColumn("dy", moves((0, sy, -sy, 2 * sy, -2 * sy)))
        out = out.unionByName(steps.select("mask_id", on(F.col("bx") + F.col("dx"), width - w).cast("int").alias("bx"), on(F.col("by") + F.col("dy"), height - h).cast("int").alias("by")))
    return out.distinct()


def _pass(uncovered: DataFrame, boxes: DataFrame, w: int, h: int, overlap: float, excess_weight: float, most_overlap: float, rounds: int, chosen: DataFrame | None, nth: int):
    """The greedy cover of what is uncovered, from candidates with their terms; gives what is left and all boxes chosen so far."""
    area = w * h
    gain = pixels_in(boxes, uncovered, w, h).withColumnRenamed("n", "gain")
    # ok: overlaps a box of this pass enough, or there is none yet; over: the least overlap that is enough and not too much.
    state = cut(boxes.join(gain, BOX).withColumns({"ok": F.lit(True), "over": F.lit(None).cast("double")}))
    for k in range(rounds):
        excess = F.greatest(F.coalesce("over", F.lit(overlap)) - overlap, F.lit(0.0))
        rank = score(F.col("gain"), F.col("fill"), F.col("evenodd"), F.col("core"), excess, excess_weight, area)
        order = [(-F.col("by")).alias("ny"), (-F.col("bx")).alias("nx")]
        best = state.groupBy("mask_id").agg(F.max(F.when(F.col("ok"), F.struct(rank.alias("s"), *order))).alias("strict"), F.max(F.struct(F.col("gain").cast("double").alias("s"), *order)).alias("any"))
        new = cut(best.select("mask_id", F.coalesce("strict", "any").alias("b")).select("mask_id", (-F.col("b.nx")).alias("bx"), (-F.col("b.ny")).alias("by"), F.lit(nth).alias("pass"), F.lit(k).alias("round")))
        if not new.limit(1).count():
            return uncovered, chosen
        chosen = new if chosen is None else cut(chosen.unionByName(new))
        at = new.select("mask_id", F.col("bx").alias("cx"), F.col("by").alias("cy"))
        near = uncovered.join(at, "mask_id", "left")
        hit = F.coalesce((F.col("y") >= F.col("cy")) & (F.col("y") < F.col("cy") + h) & (F.col("x0") < F.col("cx") + w) & (F.col("x1") >= F.col("cx")), F.lit(False))
        lost = near.where(hit).select("mask_id", "y", F.greatest("x0", "cx").alias("x0"), F.least("x1", F.col("cx") + w - 1).alias("x1"))
        piece = lambda a, b: F.struct(a.cast("long").alias("x0"), b.cast("long").alias("x1"))
        pieces = F.when(hit, F.array(piece(F.col("x0"), F.col("cx") - 1), piece(F.col("cx") + w, F.col("x1")))).otherwise(F.array(piece(F.col("x0"), F.col("x1"))))
        rest = near.select("mask_id", "y", F.explode(pieces).alias("p")).select("mask_id", "y", "p.x0", "p.x1").where("x0 <= x1")
        s = state.join(at, "mask_id", "left")
        ow, oh = (F.greatest(F.lit(0), size - F.abs(F.col(b) - F.col(c))) for size, b, c in ((w, "bx", "cx"), (h, "by", "cy")))
        shared = F.coalesce(ow * oh / area, F.lit(0.0))
        enough = (shared > 0) & (shared >= overlap)
        s = s.withColumns({"ok": enough if k == 0 else F.col("ok") | enough, "over": F.least("over", F.when(enough & (shared <= most_overlap), shared))})
        touched = s.where((ow > 0) & (oh > 0)).select(*BOX)
        s = s.join(pixels_in(touched, lost, w, h), BOX, "left").withColumn("gain", F.col("gain") - F.coalesce("n", F.lit(0))).drop("n", "cx", "cy")
        uncovered, state = cut(rest), cut(s.where("gain > 0"))
    raise RuntimeError(f"a mask needs more than {rounds} boxes")


def clip_boxes(
    runs: DataFrame, width: int, height: int, w: int, h: int, overlap: float, depth: DataFrame | None = None,
    passes: int = 6, points: int = 240, most_overlap: float = 0.85, rounds: int = 5000,
) -> DataFrame:
    """(mask_id, ord, x0, y0, x1, y1): boxes (ends exclusive) that cover each mask, grown by the overlap's share of a clip.

    Each round takes a mask's best box by score among those that share at least ``overlap`` of their area with a box of the same pass (the
    first of a pass is free); where no such box gains, the one that gains most.  Ties go to the upper, then left one.  Candidates are made once a pass; up to ``passes`` of them
    go on with what is left, each with a looser overlap.  Boxes chosen twice count once.  The clip must fit the canvas.
    """
    runs = cut(runs.select("mask_id", "y", F.col("x0").cast("long").alias("x0"), F.col("x1").cast("long").alias("x1")))
    left, chosen = cut(dilated(runs, int(overlap * w), int(overlap * h), width, height)), None
    for nth in range(passes):
        if not left.limit(1).count():
            break
        loose = overlap * (1.0 if nth == 0 else max(0.15, 1.0 - 0.18 * nth))
        boxes = cut(candidates(left, chosen, width, height, w, h, loose, points))
        terms = score_terms(boxes, runs, w, h, depth)
        left, chosen = _pass(left, terms, w, h, loose, 0.35 if nth == 0 else 0.18, most_overlap, rounds, chosen, nth)
    if chosen is None:
        return runs.select("mask_id", F.lit(0).alias("ord"), *[F.lit(0).alias(c) for c in ("x0", "y0", "x1", "y1")]).limit(0)
    first = chosen.groupBy(*BOX).agg(F.min(F.col("pass") * rounds + F.col("round")).alias("ord"))
    return first.select("mask_id", "ord", F.col("bx").alias("x0"), F.col("by").alias("y0"), (F.col("bx") + w).alias("x1"), (F.col("by") + h).alias("y1"))
