"""Sample points of surfaces and the faces over them.

Surfaces are rings (poly, part, v, x, z): part 0 is the outer ring, others are holes; rings close by themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edges_of(rings: DataFrame) -> DataFrame:
    """(poly, part, ax, az, bx, bz): the edges of rings with three vertices or more; a ring is short, a surface may be many."""
    w = Window.partitionBy("poly", "part").orderBy("v")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(every))
    e = rings.select("poly", "part", F.col("x").alias("ax"), F.col("z").alias("az"), nxt("x").alias("bx"), nxt("z").alias("bz"), F.count("*").over(every).alias("n"))
    return e.where("n > 2").drop("n")


def sampling_grid(rings: DataFrame, density: float) -> DataFrame:
    """(poly, part, v, i, j, x, z): the vertices of each surface's rings, with part and v, and the lattice points inside it and outside its holes, with i and j.

    The lattice starts at the outer ring's lower corner.  Its rows cut the edges; between cuts, in order of x, a row is in or out of the outer
    ring and of each hole, so only inner points are ever listed.  A lattice point that falls on a vertex, when both are rounded to a tenth of the
    density, is left out.
    """
    if density <= 0:
        raise ValueError("the density must be positive")
    edges = edges_of(rings)
    low = edges.where("part = 0").groupBy("poly").agg(F.min("ax").alias("lx"), F.min("az").alias("lz"), F.max("ax").alias("hx"))
    e = edges.where("az <> bz").join(low, "poly")
    # A row cuts an edge from its lower end up to, not with, its upper end.
    row = lambda c: F.ceil((c - F.col("lz")) / density)
    e = e.withColumns({"j0": row(F.least("az", "bz")), "j1": row(F.greatest("az", "bz")) - 1}).where("j1 >= 0 AND j0 <= j1")
    e = e.withColumn("j", F.explode(F.sequence(F.greatest("j0", F.lit(0)), "j1"))).withColumn("z", F.col("lz") + F.col("j") * density)
    cuts = e.select("poly", "part", "j", "z", "lx", "hx", (F.col("ax") + (F.col("z") - F.col("az")) * (F.col("bx") - F.col("ax")) / (F.col("bz") - F.col("az"))).alias("at"))
    own = F.row_number().over(Window.partitionBy("poly", "j", "part").orderBy("at"))
    cuts = cuts.withColumn("turn", F.when(own % 2 == 1, 1).otherwise(-1))
    line = Window.partitionBy("poly", "j").orderBy("at", "part")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    spans = cuts.select("poly", "j", "z", "lx", "hx", "at", F.lead("at").over(line).alias("end"), F.sum(F.when(F.col("part") == 0, F.col("turn")).otherwise(0)).over(upto).alias("outer"), F.sum(F.when(F.col("part") != 0, F.col("turn")).otherwise(0)).over(upto).alias("holes"))
    column = lambda c: F.ceil((F.col(c) - F.col("lx")) / density)
    inside = spans.where("outer > 0 AND holes = 0").withColumns({"i0": column("at"), "i1": column("end") - 1}).where("i0 <= i1")
    points = inside.select("poly", F.explode(F.sequence("i0", "i1")).alias("i"), "j", "z", "lx").select("poly", "i", "j", (F.col("lx") + F.col("i") * density).cast("double").alias("x"), F.col("z").cast("double").alias("z"))
    snap = [F.bround(F.col(c) / (density * 0.1)).cast("long").alias(f"k{c}") for c in "xz"]
    corners = rings.join(low.select("poly"), "poly", "left_semi")
    free = points.select("*", *snap).join(corners.select("poly", *snap).distinct(), ["poly", "kx", "kz"], "left_anti")
    none = lambda c: F.lit(None).cast("long").alias(c)
    border = corners.select("poly", F.col("part").cast("long").alias("part"), F.col("v").cast("long").alias("v"), none("i"), none("j"), F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z"))
    return border.unionByName(free.select("poly", none("part"), none("v"), "i", "j", "x", "z"))


def inside_own(points: DataFrame, rings: DataFrame, cell: float) -> DataFrame:
    """The points (poly, point_id, x, z) inside their own surface's outer ring and outside its holes; points and edges meet in bands of z."""
    band = lambda c: F.floor(c / cell)
    e = edges_of(rings).where("az <> bz").withColumn("b", F.explode(F.sequence(band(F.least("az", "bz")), band(F.greatest("az", "bz")))))
    j = points.withColumn("b", band(F.col("z"))).join(e, ["poly", "b"])
    right = (F.col("ax") + (F.col("z") - F.col("az")) * (F.col("bx") - F.col("ax")) / (F.col("bz") - F.col("az"))) > F.col("x")
    odd = j.where(((F.col("az") > F.col("z")) != (F.col("bz") > F.col("z"))) & right).groupBy("poly", "point_id", "part").agg(F.count("*").alias("n")).where("n % 2 = 1")
    held = odd.groupBy("poly", "point_id").agg(F.bool_or(F.col("part") == 0).alias("outer"), F.bool_or(F.col("part") != 0).alias("hole")).where("outer AND NOT hole")
    return points.join(held.select("poly", "point_id"), ["poly", "point_id"], "left_semi")


def faces_inside(faces: DataFrame, rings: DataFrame, cell: float) -> DataFrame:
    """The faces (poly, f, x0, z0 .. x2, z2) whose centroid is inside their surface and out of its holes."""
    middle = faces.select("poly", F.col("f").alias("point_id"), ((F.col("x0") + F.col("x1") + F.col("x2")) / 3.0).alias("x"), ((F.col("z0") + F.col("z1") + F.col("z2")) / 3.0).alias("z"))
    return faces.join(inside_own(middle, rings, cell).select("poly", F.col("point_id").alias("f")), ["poly", "f"], "left_semi")
