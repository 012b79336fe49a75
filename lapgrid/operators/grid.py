"""Sparse rasters: one row per set pixel (x, y), often with a tag, or horizontal runs (y, x0, x1)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import components, cut

XY = ["x", "y"]


# -- merging ---------------------------------------------------------------

def merge_masks(px: DataFrame, value: str, how: str = "union", *keys: str) -> DataFrame:
    """Per pixel the largest value, or the sum clipped to 1."""
    agg = F.max(value) if how == "union" else F.least(F.sum(value), F.lit(1.0))
    return px.groupBy(*keys, *XY).agg(agg.alias(value))


def paint(px: DataFrame, order: str, exclude: str) -> DataFrame:
    """(tag, x, y) set after painting each clip in order, excludes erasing what came before, then joining clips."""
    last = px.groupBy("clip", "tag", *XY).agg(F.max_by(~F.col(exclude), F.col(order)).alias("on"))
    return last.where("on").select("tag", *XY).distinct()


def composite(px: DataFrame) -> DataFrame:
    """(x, y, tag): the highest tag that covers a pixel."""
    return px.groupBy(*XY).agg(F.max("tag").alias("tag"))


def coverage(raw: DataFrame, label: DataFrame, width: int, height: int) -> DataFrame:
    """Percent of the canvas per tag, before and after compositing."""
    pct = lambda c: F.round(100.0 * c / (width * height), 6)
    a = raw.select("tag", *XY).distinct().groupBy("tag").agg(pct(F.count("*")).alias("raw"))
    b = label.groupBy("tag").agg(pct(F.count("*")).alias("final"))
    return a.join(b, "tag", "left").select("tag", "raw", F.coalesce("final", F.lit(0.0)).alias("final"))


def edit_tiles(px: DataFrame, size: int) -> DataFrame:
    return px.select(F.expr(f"x div {size}").alias("col"), F.expr(f"y div {size}").alias("row")).distinct()


def patch_tile(mask: DataFrame, tile: DataFrame, col: int, row: int, size: int) -> DataFrame:
    """The mask with one square tile replaced."""
    inside = (F.expr(f"x div {size}") == col) & (F.expr(f"y div {size}") == row)
    return mask.where(~inside).select(*XY).union(tile.where(inside).select(*XY)).distinct()


def resize(label: DataFrame, sx: float, sy: float, width: int, height: int) -> DataFrame:
    """Nearest-neighbour resize: target pixel t takes source pixel floor((t + 0.5) * s)."""
    lo = lambda c, s: F.greatest(F.ceil(F.col(c) / s - 0.5), F.lit(0))
    hi = lambda c, s, n: F.least(F.ceil((F.col(c) + 1) / s - 0.5) - 1, F.lit(n - 1))
    t = label.withColumns({"xa": lo("x", sx), "xb": hi("x", sx, width), "ya": lo("y", sy), "yb": hi("y", sy, height)}).where("xa <= xb AND ya <= yb")
    t = t.withColumn("tx", F.explode(F.sequence("xa", "xb")))
    return t.withColumn("ty", F.explode(F.sequence("ya", "yb"))).select(F.col("tx").alias("x"), F.col("ty").alias("y"), "tag")


# -- runs ------------------------------------------------------------------

def to_runs(px: DataFrame, *keys: str) -> DataFrame:
    """Runs of neighbouring pixels of a row."""
    w = Window.partitionBy(*keys, "y").orderBy("x")
    g = px.select(*keys, *XY).distinct().withColumn("_g", F.col("x") - F.row_number().over(w))
    return g.groupBy(*keys, "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_g")


def from_runs(runs: DataFrame, *keys: str) -> DataFrame:
    return runs.select(*keys, F.explode(F.sequence("x0", "x1")).alias("x"), "y")


def join_runs(runs: DataFrame, *keys: str) -> DataFrame:
    """Runs of a row that touch or overlap become one."""
    w = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    before = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = runs.withColumn("_n", F.coalesce((F.col("x0") > before + 1).cast("int"), F.lit(1))).withColumn("_g", F.sum("_n").over(w))
    return r.groupBy(*keys, "y", "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_g")


def strided_sample(runs: DataFrame, cap: int, *keys: str) -> DataFrame:
    """(keys, x, y): every k-th pixel of each mask in row-major order, k = pixels div cap, at least 1.

    Pixels before a row come from the counts of rows, pixels before a run from its row alone; only sampled pixels are listed.
    """
    size = F.col("x1") - F.col("x0") + 1
    row = runs.groupBy(*keys, "y").agg(F.sum(size).alias("_n"))
    above = Window.partitionBy(*keys).orderBy("y")
    row = row.select(*keys, "y", (F.sum("_n").over(above) - F.col("_n")).alias("_above"))
    total = runs.groupBy(*keys).agg(F.greatest(F.floor(F.sum(size) / cap), F.lit(1)).alias("_k"))
    before = F.sum(size).over(Window.partitionBy(*keys, "y").orderBy("x0")) - size
    r = runs.withColumn("_before", before).join(row, [*keys, "y"])
    r = (r.join(total, list(keys)) if keys else r.crossJoin(F.broadcast(total))).withColumn("_at", F.col("_above") + F.col("_before"))
    first = F.col("x0") + F.pmod(-F.col("_at"), F.col("_k"))
    return r.where(first <= F.col("x1")).select(*keys, F.explode(F.sequence(first, F.col("x1").cast("long"), F.col("_k"))).alias("x"), "y")


# -- morphology ------------------------------------------------------------

def half_widths(kind: str, r: int) -> list[tuple[int, int]]:
    """(dy, half width) of each kernel row: a square, or a disc whose rows reach round(r sqrt(1 - (dy / r)^2))."""
    if kind == "rect":
        return [(d, r) for d in range(-r, r + 1)]
    return [(d, round(r * math.sqrt(1 - (d / r) ** 2)) if r else 0) for d in range(-r, r + 1)]


def _kernel(kind: str, r: int) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(h).alias("h")) for d, h in half_widths(kind, r)]))


def dilate_runs(runs: DataFrame, kind: str, r: int, width: int, height: int) -> DataFrame:
    """Each run widens by each kernel row, is clipped to the canvas, and runs are joined; pixels never multiply by the kernel's area."""
    k = runs.withColumn("k", _kernel(kind, r))
    wide = k.select((F.col("y") + F.col("k.d")).alias("y"), F.greatest(F.col("x0") - F.col("k.h"), F.lit(0)).alias("x0"), F.least(F.col("x1") + F.col("k.h"), F.lit(width - 1)).alias("x1"))
    return join_runs(wide.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x0") <= F.col("x1"))).distinct())


def complement_runs(runs: DataFrame, width: int, height: int) -> DataFrame:
    """The gaps between runs of pixels of the canvas, and its empty rows."""
    rows = runs.sparkSession.range(height).select(F.col("id").alias("y"))
    w = Window.partitionBy("y").orderBy("x0")
    gaps = runs.select("y", F.coalesce(F.lag("x1").over(w) + 1, F.lit(0)).alias("x0"), (F.col("x0") - 1).alias("x1"))
    tail = rows.join(runs.groupBy("y").agg(F.max("x1").alias("m")), "y", "left").select("y", F.coalesce(F.col("m") + 1, F.lit(0)).alias("x0"), F.lit(width - 1).alias("x1"))
    return gaps.unionByName(tail).where("x0 <= x1")


def subtract_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """What a holds and b doesn't, by a sweep over the ends of both in each row."""
    ends = lambda runs, in_a, in_b: runs.select("y", F.explode(F.array(*[F.struct(x.alias("x"), F.lit(s * in_a).alias("a"), F.lit(s * in_b).alias("b")) for x, s in ((F.col("x0"), 1), (F.col("x1") + 1, -1))])).alias("e")).select("y", "e.*")
    e = ends(a, 1, 0).unionByName(ends(b, 0, 1)).groupBy("y", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy("y").orderBy("x")
    s = e.select("y", F.col("x").alias("x0"), (F.lead("x").over(w) - 1).alias("x1"), F.sum("a").over(w).alias("a"), F.sum("b").over(w).alias("b"))
    return join_runs(s.where("a > 0 AND b = 0").select("y", "x0", "x1"))


def erode_runs(runs: DataFrame, kind: str, r: int, width: int, height: int) -> DataFrame:
    return subtract_runs(runs, dilate_runs(complement_runs(runs, width, height), kind, r, width, height))


def dilate(px: DataFrame, kind: str, r: int, width: int, height: int) -> DataFrame:
    return from_runs(dilate_runs(to_runs(px), kind, r, width, height)).select(*XY)


def complement(px: DataFrame, width: int, height: int) -> DataFrame:
    """Unset pixels of the canvas."""
    return from_runs(complement_runs(to_runs(px), width, height)).select(*XY)


def erode(px: DataFrame, kind: str, r: int, width: int, height: int) -> DataFrame:
    """Pixels whose whole kernel, as far as it is on the canvas, is set: the canvas border does not erode.  All on runs."""
    return from_runs(erode_runs(to_runs(px), kind, r, width, height)).select(*XY)


def opened(px: DataFrame, kind: str, r: int, width: int, height: int) -> DataFrame:
    return from_runs(dilate_runs(erode_runs(to_runs(px), kind, r, width, height), kind, r, width, height)).select(*XY)


def closed(px: DataFrame, kind: str, r: int, width: int, height: int) -> DataFrame:
    return from_runs(erode_runs(dilate_runs(to_runs(px), kind, r, width, height), kind, r, width, height)).select(*XY)


# -- regions ---------------------------------------------------------------

def label_components(px: DataFrame, diagonal: bool = True) -> DataFrame:
    """(x, y, comp): connected pixels by runs; comp is the smallest run id y * 2^32 + x0 of the region."""
    runs = cut(to_runs(px).withColumn("id", F.col("y") * (1 << 32) + F.col("x0")))
    s = 1 if diagonal else 0
    a, b = runs.select("y", "x0", "x1", F.col("id").alias("a")), runs.select((F.col("y") - 1).alias("yb"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("id").alias("b"))
    edges = a.join(b, (F.col("y") == F.col("yb")) & (F.col("u0") <= F.col("x1") + s) & (F.col("u1") + s >= F.col("x0"))).select("a", "b")
    return from_runs(runs.join(components(runs, edges), "id"), "comp").select(*XY, "comp")


def flood(seed: DataFrame, passable: DataFrame) -> DataFrame:
    """The seed and the passable pixels joined to it in eight directions."""
    both = label_components(seed.select(*XY).union(passable.select(*XY)).distinct())
    return both.join(both.join(seed.select(*XY).distinct(), XY).select("comp").distinct(), "comp", "left_semi").select(*XY)


def interior_holes(px: DataFrame, width: int, height: int, least: int) -> DataFrame:
    """Unset regions (four directions) that don't touch the border, of at least so many pixels."""
    c = label_components(complement(px, width, height), diagonal=False)
    border = c.where((F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == width - 1) | (F.col("y") == height - 1)).select("comp").distinct()
    size = c.groupBy("comp").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return c.join(border, "comp", "left_anti").join(size, "comp").select(*XY, "comp")


def majority_neighbour(regions: DataFrame, label: DataFrame, width: int, height: int) -> DataFrame:
    """For each region (x, y, comp) the tag with most contacts in the one-pixel ring around it, ties to the smallest tag; none: no row."""
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]))
    ring = regions.withColumn("k", step).select((F.col("x") + F.col("k.a")).alias("x"), (F.col("y") + F.col("k.b")).alias("y"), "comp").distinct()
    ring = ring.join(regions.select(*XY, "comp"), [*XY, "comp"], "left_anti")
    n = ring.join(label, XY).groupBy("comp", "tag").agg(F.count("*").alias("n"))
    return n.groupBy("comp").agg(F.max(F.struct("n", (-F.col("tag")).alias("t"))).alias("m")).select("comp", (-F.col("m.t")).alias("tag"), F.col("m.n").alias("contacts"))


def distance2(px: DataFrame, width: int, height: int, most: int) -> DataFrame:
    """Squared distance of canvas pixels to the nearest set pixel, where it is at most ``most``: columns first, then rows."""
    near = px.select(*XY).distinct().withColumn("d", F.explode(F.sequence(F.lit(-most), F.lit(most)))).select("x", (F.col("y") + F.col("d")).alias("y"), F.abs("d").alias("g"))
    col = near.where((F.col("y") >= 0) & (F.col("y") < height)).groupBy(*XY).agg(F.min("g").alias("g"))
    row = col.withColumn("d", F.explode(F.sequence(F.lit(-most), F.lit(most)))).select((F.col("x") + F.col("d")).alias("x"), "y", (F.col("d") * F.col("d") + F.col("g") * F.col("g")).alias("d2"))
    return row.where((F.col("x") >= 0) & (F.col("x") < width)).groupBy(*XY).agg(F.min("d2").alias("d2")).where(F.col("d2") <= most * most)


def close_gap(road: DataFrame, others: DataFrame, taken: DataFrame, gap: int, width: int, height: int) -> DataFrame:
    """Road with the free pixels whose distances to road and to the others add up to at most gap."""
    a = distance2(road, width, height, gap).withColumnRenamed("d2", "a")
    b = distance2(others, width, height, gap).withColumnRenamed("d2", "b")
    more = a.join(b, XY).where(F.sqrt("a") + F.sqrt("b") <= gap).join(taken.select(*XY).distinct(), XY, "left_anti").select(*XY)
    return road.select(*XY).union(more).distinct()


def degrees(px: DataFrame) -> DataFrame:
    """(x, y, degree): how many of the eight neighbours are set."""
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]))
    p = px.select(*XY).distinct()
    sent = p.withColumn("k", step).select((F.col("x") + F.col("k.a")).alias("x"), (F.col("y") + F.col("k.b")).alias("y")).groupBy(*XY).agg(F.count("*").alias("degree"))
    return p.join(sent, XY, "left").select(*XY, F.coalesce("degree", F.lit(0)).alias("degree"))


def thin(px: DataFrame, most: int = 200) -> DataFrame:
    """One-pixel skeleton by the parallel thinning of Zhang and Suen (1984): two sub-rounds until nothing goes."""
    ring = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(1 << i).alias("bit")) for i, (a, b) in enumerate(ring)]))

    def half(p: DataFrame, first: bool) -> DataFrame:
        code = p.withColumn("k", step).select((F.col("x") - F.col("k.a")).alias("x"), (F.col("y") - F.col("k.b")).alias("y"), "k.bit").groupBy(*XY).agg(F.sum("bit").cast("int").alias("code"))
        q = p.join(code, XY, "left").withColumn("code", F.coalesce("code", F.lit(0)))
        b = [F.shiftright("code", i).bitwiseAND(F.lit(1)) for i in range(8)]
        turns = sum((((1 - b[i]) * b[(i + 1) % 8]) for i in range(8)), F.lit(0))
        n, e, s, w = b[0], b[2], b[4], b[6]
        free = ((n * e * s == 0) & (e * s * w == 0)) if first else ((n * e * w == 0) & (n * s * w == 0))
        return q.where(~(F.bit_count("code").between(2, 6) & (turns == 1) & free)).select(*XY)

    p = cut(px.select(*XY).distinct())
    n = p.count()
    for _ in range(most):
        p = cut(half(half(p, True), False))
        m = p.count()
        if m == n:
            return p
        n = m
    raise RuntimeError(f"still thinning after {most} rounds")


def boundary_edges(px: DataFrame) -> DataFrame:
    """Unit edges (x, y, side) between a set pixel and an unset one; side 0 top, 1 right, 2 bottom, 3 left."""
    p = px.select(*XY).distinct()
    out = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate([(0, -1), (1, 0), (0, 1), (-1, 0)])]))
    e = p.withColumn("k", out).select(*XY, "k.side", (F.col("x") + F.col("k.a")).alias("nx"), (F.col("y") + F.col("k.b")).alias("ny"))
    return e.join(p.select(F.col("x").alias("nx"), F.col("y").alias("ny")), ["nx", "ny"], "left_anti").select(*XY, "side")
