"""Level-of-detail tile trees (tile_id, parent_id, level, has_mesh, can_refine, box)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spatial
from .rounds import cut


def descendants(tiles: DataFrame, most: int = 64) -> DataFrame:
    """(ancestor, tile_id) of every tile and each of its ancestors, by a frontier that climbs one level a round."""
    up = cut(tiles.where("parent_id IS NOT NULL").select("tile_id", "parent_id"))
    front = out = up.select(F.col("parent_id").alias("ancestor"), "tile_id")
    for _ in range(most):
        front = cut(front.join(up.select(F.col("tile_id").alias("ancestor"), F.col("parent_id").alias("above")), "ancestor").select(F.col("above").alias("ancestor"), "tile_id"))
        if not front.limit(1).count():
            return out
        out = out.union(front)
    raise RuntimeError(f"the tree is deeper than {most}")


def load_plan(tiles: DataFrame, base: int, target: int, most: int = 64) -> DataFrame:
    """(tile_id, level) to load, given a column ``overlaps``.

    Down: a tile stops at the target level, without children to refine to, or at
    the base level without overlap; otherwise its children are walked.  A tile
    without a mesh is walked only if it can refine.  Up: a mesh tile of whose
    subtree nothing is loaded is loaded itself.
    """
    kids = tiles.groupBy("parent_id").agg(F.count("*").alias("kids")).select(F.col("parent_id").alias("tile_id"), "kids")
    t = tiles.join(kids, "tile_id", "left").withColumn("open", F.col("can_refine") & (F.coalesce("kids", F.lit(0)) > 0))
    stop = F.col("has_mesh") & ((F.col("level") >= target) | ~F.col("open") | ((F.col("level") >= base) & ~F.col("overlaps")))
    t = cut(t.select("tile_id", "parent_id", "level", "has_mesh", "open", stop.alias("stop")))
    front = t.where("parent_id IS NULL")
    walked = front
    for _ in range(most):
        go = front.where("NOT stop AND open").select(F.col("tile_id").alias("parent_id"))
        front = cut(t.join(go, "parent_id", "left_semi"))
        if not front.limit(1).count():
            break
        walked = walked.unionByName(front)
    walked = cut(walked)
    loaded = walked.where("stop")
    # Ancestors of loaded tiles are served; of the mesh tiles left, the deepest without anything below are loaded.
    fall = walked.where("NOT stop AND has_mesh")
    above = descendants(walked)
    for level in [r["level"] for r in fall.select("level").distinct().orderBy(F.desc("level")).collect()]:
        served = above.join(loaded.select("tile_id"), "tile_id", "left_semi").select(F.col("ancestor").alias("tile_id")).distinct()
        loaded = cut(loaded.unionByName(fall.where(F.col("level") == level).join(served, "tile_id", "left_anti")))
    return loaded.select("tile_id", "level")


def plan_conflicts(plan: DataFrame, closure: DataFrame) -> DataFrame:
    """(ancestor, tile_id) pairs that are both in a plan; a valid plan has none."""
    ids = plan.select("tile_id")
    return closure.join(ids, "tile_id", "left_semi").join(ids.withColumnRenamed("tile_id", "ancestor"), "ancestor", "left_semi").select("ancestor", "tile_id")


def covered_by(tiles: DataFrame, chosen: DataFrame, most: int = 64) -> DataFrame:
    """Tiles that are chosen, or can refine and have all children covered: bottom up, a level a round."""
    t = cut(tiles.select("tile_id", "parent_id", "can_refine"))
    n = t.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.count("*").alias("n"))
    done = cut(chosen.select("tile_id").distinct())
    for _ in range(most):
        full = t.join(done, "tile_id", "left_semi").groupBy("parent_id").agg(F.count("*").alias("m")).join(n, "parent_id").where("m = n").select(F.col("parent_id").alias("tile_id"))
        new = cut(full.join(t.where("can_refine"), "tile_id", "left_semi").join(done, "tile_id", "left_anti"))
        if not new.limit(1).count():
            return done
        done = cut(done.union(new))
    raise RuntimeError(f"the tree is deeper than {most}")


def refine_step(tiles: DataFrame, start: DataFrame, most: int = 64) -> DataFrame:
    """(start_id, tile_id): below each starting tile the first tiles with a mesh, or tiles that lead no further; a level a round."""
    kids = tiles.groupBy("parent_id").agg(F.count("*").alias("kids")).select(F.col("parent_id").alias("tile_id"), "kids")
    t = cut(tiles.join(kids, "tile_id", "left").select("tile_id", "parent_id", "has_mesh", (F.col("can_refine") & (F.coalesce("kids", F.lit(0)) > 0)).alias("open")))
    front, found = t.join(start.select("tile_id"), "tile_id", "left_semi").where("open").select(F.col("tile_id").alias("start_id"), F.col("tile_id").alias("parent_id")), None
    for _ in range(most):
        below = cut(front.join(t, "parent_id").select("start_id", "tile_id", (F.col("has_mesh") | ~F.col("open")).alias("stop")))
        hit = below.where("stop").select("start_id", "tile_id")
        found = hit if found is None else found.unionByName(hit)
        front = below.where("NOT stop").select("start_id", F.col("tile_id").alias("parent_id"))
        if not front.limit(1).count():
            return found
    raise RuntimeError(f"the tree is deeper than {most}")


def plan_report(plan: DataFrame, tiles: DataFrame) -> DataFrame:
    """(n_tiles, n_conflicts, valid): a valid plan holds no tile together with one of its ancestors."""
    n = plan.agg(F.count("*").alias("n_tiles"))
    bad = plan_conflicts(plan, descendants(tiles)).agg(F.count("*").alias("n_conflicts"))
    return n.crossJoin(bad).withColumn("valid", F.col("n_conflicts") == 0)


def plan_for_boxes(tiles: DataFrame, boxes: DataFrame, base: int, target: int, cell: int) -> DataFrame:
    """The load plan where tiles overlap boxes (x0, y0, x1, y1); a tile without a box overlaps."""
    b = boxes.select(*[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    placed = tiles.where("x0 IS NOT NULL").select("tile_id", "x0", "y0", "x1", "y1")
    hit = spatial.boxes_hit(placed, b, ["x0", "y0", "x1", "y1"], ["bx0", "by0", "bx1", "by1"], cell).select("tile_id").distinct().withColumn("hit", F.lit(True))
    t = tiles.join(hit, "tile_id", "left").withColumn("overlaps", F.col("x0").isNull() | F.coalesce("hit", F.lit(False))).drop("hit")
    return load_plan(t, base, target)


def tileset_origin(files: DataFrame) -> DataFrame:
    """(set_id, x, y, z) of each tileset: the box centre of its first file (smallest ord) that has a finite one, else the translation of its first transform.

    files: set_id, ord, center (array of three or null), transform (array of sixteen by columns, or null).
    """
    finite = lambda a, n: (F.size(a) == n) & F.forall(a, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    moved = F.slice(F.col("transform"), 13, 3)
    g = files.groupBy("set_id").agg(F.min_by("center", F.when(finite(F.col("center"), 3), F.col("ord"))).alias("c"), F.max(finite(F.col("center"), 3)).alias("any"), F.min_by(moved, F.when(F.col("transform").isNotNull(), F.col("ord"))).alias("t"))
    at = F.when(F.col("any"), F.col("c")).otherwise(F.col("t"))
    return g.select("set_id", *[F.get(at, F.lit(k)).alias(n) for k, n in enumerate("xyz")])


def frame_mode(forced: Column, has_transform: Column) -> Column:
    """enu or tileset_local: as forced, where tileset_local needs a transform and gives ``error`` without one; else local if there is a transform."""
    return (
        F.when(forced == "enu", "enu").when((forced == "tileset_local") & ~has_transform, "error").when(forced == "tileset_local", "tileset_local")
        .when(has_transform, "tileset_local").otherwise("enu")
    )


def depth_first(tiles: DataFrame, first: int, most: int = 64) -> DataFrame:
    """(tile_id, place): the first mesh tiles in depth-first order from the roots, children by id; paths grow level by level."""
    level = cut(tiles.where("parent_id IS NULL").select("tile_id", "has_mesh", F.array("tile_id").alias("path")))
    every = level
    for _ in range(most):
        level = cut(tiles.join(level.select(F.col("tile_id").alias("parent_id"), "path"), "parent_id").select("tile_id", "has_mesh", F.concat("path", F.array("tile_id")).alias("path")))
        if not level.limit(1).count():
            break
        every = every.unionByName(level)
    else:
        raise RuntimeError(f"a tree is deeper than {most}")
    top = every.where("has_mesh").orderBy("path").limit(first)
    return top.select("tile_id", (F.row_number().over(Window.orderBy("path")) - 1).alias("place"))


def refine_by_mask(tiles: DataFrame, loaded: DataFrame, mask: DataFrame, target: int, pad: float = 0.1, budget: int = 5000, most: int = 64) -> DataFrame:
    """(tile_id, status): the tiles loaded after refining those over a mask down to a level.

    In rounds, each loaded tile that may refine, lies below the target level and overlaps the mask gives way to all its next mesh tiles
    (``refine_step``): those over the mask's box, padded by a share of its size, may be refined on, the others are only loaded, so nothing is
    left uncovered.  A tile without a box overlaps.  mask: boxes (x0, y0, x1, y1); the first round tests the boxes themselves, later ones the padded
    box around them.  A tile that leads nowhere stays.  Each refined tile is a step; when the budget of steps ends, by level, then tile_id, tiles
    that still wait are kept with status ``open``, the others are ``loaded``.
    """
    hull = mask.agg(F.min("x0").alias("mx0"), F.max("x1").alias("mx1"), F.min("y0").alias("my0"), F.max("y1").alias("my1"))
    px, py = (F.col("mx1") - F.col("mx0")) * pad, (F.col("my1") - F.col("my0")) * pad
    hull = cut(hull.select((F.col("mx0") - px).alias("hx0"), (F.col("mx1") + px).alias("hx1"), (F.col("my0") - py).alias("hy0"), (F.col("my1") + py).alias("hy1")))
    over = F.col("x0").isNull() | ((F.col("x0") <= F.col("hx1")) & (F.col("x1") >= F.col("hx0")) & (F.col("y0") <= F.col("hy1")) & (F.col("y1") >= F.col("hy0")))
    # One row, so the join is a filter.
    t = cut(tiles.join(F.broadcast(hull)).select("tile_id", "parent_id", "level", "has_mesh", "can_refine", "x0", "y0", "x1", "y1", F.coalesce(over, F.lit(False)).alias("over")))
    b = mask.select(*[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    start = t.join(loaded.select("tile_id").distinct(), "tile_id", "left_semi")
    hit = spatial.rects_overlapping(start.where("x0 IS NOT NULL"), b).unionByName(start.where("x0 IS NULL").select("tile_id")).withColumn("hit", F.lit(True))
    state = cut(start.join(hit, "tile_id", "left").select("tile_id", "level", (F.coalesce("hit", F.lit(False)) & F.col("can_refine") & (F.col("level") < target)).alias("waits")))
    for _ in range(most):
        waiting = state.where("waits").orderBy("level", "tile_id").limit(budget)
        now = cut(waiting.select("tile_id"))
        steps = now.count()
        if not steps:
            return state.select("tile_id", F.when(F.col("waits"), "open").otherwise("loaded").alias("status"))
        budget -= steps
        plan = cut(refine_step(t, now))
        gone = plan.select(F.col("start_id").alias("tile_id")).distinct()
        new = plan.select("tile_id").distinct().join(t, "tile_id").select("tile_id", "level", (F.col("over") & F.col("can_refine") & (F.col("level") < target)).alias("waits"))
        tried = now.withColumn("tried", F.lit(True))
        kept = state.join(gone, "tile_id", "left_anti").join(tried, "tile_id", "left").select("tile_id", "level", (F.col("waits") & F.col("tried").isNull()).alias("waits"))
        state = cut(kept.unionByName(new.join(kept.select("tile_id"), "tile_id", "left_anti")))
    raise RuntimeError(f"the tree is deeper than {most}")
