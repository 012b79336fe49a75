"""Repairs of a label raster (x, y, tag), built on the morphology and regions of grid.py."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grid
from .grid import XY
from .rounds import cut


def absorb_narrow(label: DataFrame, feature: int, road: int, radius: int, near: int, width: int, height: int) -> DataFrame:
    """The label raster with narrow parts of a feature near the road made road.

    Narrow is what an opening by a disc removes and what lies more than two pixels from its result, so edges of
    thick parts don't count; of these regions (eight directions) those go that come within ``near`` of the road.
    """
    own = cut(label.where(F.col("tag") == feature).select(*XY))
    thick = grid.dilate(grid.opened(own, "disc", radius, width, height), "rect", 2, width, height)
    narrow = cut(grid.label_components(own.join(thick, XY, "left_anti")))
    beside = grid.dilate(label.where(F.col("tag") == road), "disc", near, width, height)
    moved = narrow.join(narrow.join(beside, XY, "left_semi").select("comp").distinct(), "comp", "left_semi").select(*XY, F.lit(True).alias("moved"))
    return label.join(moved, XY, "left").select(*XY, F.when((F.col("tag") == feature) & F.col("moved"), road).otherwise(F.col("tag")).alias("tag"))


def absorb_orphans(label: DataFrame, feature: int, road: int, near: int, width: int, height: int) -> DataFrame:
    """The label raster with regions of a feature that don't come within ``near`` of the road given to the tag they touch most.

    All regions are judged on the same snapshot; ties go to the smaller tag; a region that touches nothing is cleared.
    """
    regions = cut(grid.label_components(label.where(F.col("tag") == feature)))
    beside = grid.dilate(label.where(F.col("tag") == road), "disc", near, width, height)
    held = regions.join(beside, XY, "left_semi").select("comp").distinct()
    orphans = cut(regions.join(held, "comp", "left_anti"))
    to = grid.majority_neighbour(orphans, label.where(F.col("tag") != feature), width, height).select("comp", F.col("tag").alias("to"))
    given = orphans.join(to, "comp", "left").select(*XY, F.coalesce("to", F.lit(0)).alias("to"))
    out = label.join(given, XY, "left").select(*XY, F.when(F.col("tag") == feature, F.coalesce("to", "tag")).otherwise(F.col("tag")).alias("tag"))
    return out.where("tag <> 0")


def fill_gaps(label: DataFrame, zone: DataFrame, tags: list[int], radius: int, default: int, width: int, height: int) -> DataFrame:
    """The label raster with the unlabelled pixels of a zone filled.

    By the closing of each tag, first tag first; then by the dilation of each tag in the same order; what is left gets the
    default.  Each round sees what earlier ones have filled.
    """
    zone, filled = zone.select(*XY).distinct(), cut(label)
    for grow in (grid.closed, grid.dilate):
        for tag in tags:
            grown = grow(filled.where(F.col("tag") == tag), "disc", radius, width, height)
            new = grown.join(zone, XY, "left_semi").join(filled, XY, "left_anti").select(*XY, F.lit(tag).alias("tag"))
            filled = cut(filled.unionByName(new))
    return filled.unionByName(zone.join(filled, XY, "left_anti").select(*XY, F.lit(default).alias("tag")))


def fill_zone(drivable: DataFrame, independent: DataFrame) -> DataFrame:
    """Drivable pixels without those of independent tags."""
    return drivable.select(*XY).distinct().join(independent.select(*XY).distinct(), XY, "left_anti")


def clip_to(label: DataFrame, zone: DataFrame) -> DataFrame:
    return label.join(zone.select(*XY).distinct(), XY, "left_semi")


def largest_region(px: DataFrame) -> DataFrame:
    """The pixels of the region with most of them, ties to the smallest id."""
    c = cut(grid.label_components(px))
    best = c.groupBy("comp").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", -F.col("comp"))).alias("m")).select((-F.col("m.col2")).alias("comp"))
    return c.join(F.broadcast(best), "comp", "left_semi").select(*XY)


def wall_region(visible: DataFrame, drivable: DataFrame, other: DataFrame, obstacles: DataFrame, road: DataFrame, radius: int, width: int, height: int) -> DataFrame:
    """The region an outer wall encloses: what can be reached from the road over visible pixels that are drivable or of no
    class (not in ``other``) and no obstacle, closed, then shrunk, its largest part."""
    free = visible.select(*XY).distinct().join(other.select(*XY), XY, "left_anti").unionByName(visible.select(*XY).join(drivable.select(*XY), XY, "left_semi")).distinct()
    passable = free.join(obstacles.select(*XY), XY, "left_anti")
    passable = cut(passable)
    runs = cut(grid.to_runs(grid.flood(road.join(passable, XY, "left_semi"), passable)))
    # Each step reads its input more than once, so each is written; all on runs.
    grown = cut(grid.dilate_runs(runs, "disc", radius, width, height))
    closed = cut(grid.erode_runs(grown, "disc", radius, width, height))
    return largest_region(grid.from_runs(grid.erode_runs(closed, "disc", radius, width, height)))


def obstacle_regions(label: DataFrame, types: list[int], wall: DataFrame, road: DataFrame, reach: int, least: int, width: int, height: int) -> DataFrame:
    """(tag, comp, x, y): regions of each type within ``reach`` of the wall region and off the road, opened by a 7 x 7 square, of at least so many pixels."""
    near, out = cut(grid.dilate(wall, "rect", reach, width, height)), None
    for tag in types:
        own = label.where(F.col("tag") == tag).select(*XY).join(near, XY, "left_semi").join(road.select(*XY), XY, "left_anti")
        c = cut(grid.label_components(grid.opened(own, "rect", 3, width, height)))
        big = c.groupBy("comp").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("comp")
        part = c.join(big, "comp").select(F.lit(tag).alias("tag"), "comp", *XY)
        out = part if out is None else out.unionByName(part)
    return out
