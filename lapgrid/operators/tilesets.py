"""Tile sets over many files: nodes that point to another file, and blocks without a common top file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rounds import cut


def resolve_uri(base: Column, uri: Column) -> Column:
    """The path of a uri as seen from a file: beside it, with . and .. worked out; one that starts with / stays."""
    parts = F.split(F.when(uri.startswith("/"), uri).otherwise(F.concat(F.regexp_replace(base, r"[^/]*$", ""), uri)), "/")
    none = F.array().cast("array<string>")
    step = lambda at, s: F.when(s == "..", F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0)))).when(s.isin("", "."), at).otherwise(F.array_append(at, s))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, none, step), "/"))


def assemble(nodes: DataFrame, top: DataFrame, most: int = 64) -> DataFrame:
    """(tile_id, parent_id, file, node, status): one tree from files whose nodes may point to other files.

    nodes: (file, node, parent, uri), parent null for a file's root; a uri that ends in .json is a redirect: the other file's
    root hangs below the node.  A file is hung in once for each node that points to it, so a tile_id is the way from the top:
    ``file#node`` joined by ``>``.  status of a redirect: ``ok``, ``missing`` where there is no such file, ``cycle`` where the file is already on its
    way from the top, and then nothing hangs below; of other nodes ``ok``.  A level of files a round, each one join on resolved paths.
    """
    n = cut(nodes.select("file", "node", "parent", F.when(F.lower("uri").endswith(".json"), resolve_uri(F.col("file"), F.col("uri"))).alias("target")))
    files = n.where("parent IS NULL").select("file", F.col("node").alias("root"))
    front = cut(top.select("file").join(files, "file").select("file", F.lit("").alias("way"), F.lit(None).cast("string").alias("above"), F.array("file").alias("seen")))
    out = None
    name = lambda way, file, node: F.concat(way, file, F.lit("#"), F.col(node).cast("string"))
    for _ in range(most):
        here = front.join(n, "file")
        there = files.select(F.col("file").alias("target"), F.lit(True).alias("known"))
        here = here.join(there, "target", "left")
        status = F.when(F.col("target").isNull(), "ok").when(F.col("known").isNull(), "missing").when(F.array_contains("seen", F.col("target")), "cycle").otherwise("ok")
        here = cut(here.select(name(F.col("way"), F.col("file"), "node").alias("tile_id"), F.when(F.col("parent").isNull(), F.col("above")).otherwise(name(F.col("way"), F.col("file"), "parent")).alias("parent_id"), "file", "node", "target", "seen", status.alias("status")))
        rows = here.select("tile_id", "parent_id", "file", "node", "status")
        out = rows if out is None else out.unionByName(rows)
        front = here.where("target IS NOT NULL AND status = 'ok'").select(F.col("target").alias("file"), F.concat("tile_id", F.lit(">")).alias("way"), F.col("tile_id").alias("above"), F.concat("seen", F.array("target")).alias("seen"))
        if not front.limit(1).count():
            return out
    raise RuntimeError(f"files are nested deeper than {most}")


def under_virtual_root(nodes: DataFrame) -> DataFrame:
    """(tile_id, parent_id, has_mesh, can_refine) of blocks (file, node, parent, has_mesh, can_refine) hung under a root of their own, which can refine.

    A block whose root has neither a mesh nor children is left out."""
    name = lambda node: F.concat("file", F.lit("#"), F.col(node).cast("string"))
    empty = nodes.groupBy("file").agg(F.count("*").alias("n"), F.bool_or("has_mesh").alias("m")).where("n = 1 AND NOT m").select("file")
    kept = nodes.join(empty, "file", "left_anti").select(name("node").alias("tile_id"), F.when(F.col("parent").isNull(), "root").otherwise(name("parent")).alias("parent_id"), "has_mesh", "can_refine")
    root = nodes.sparkSession.range(1).select(F.lit("root").alias("tile_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(False).alias("has_mesh"), F.lit(True).alias("can_refine"))
    return root.unionByName(kept)
