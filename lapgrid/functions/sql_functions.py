"""The library's functions for SQL users: temporary SQL functions, which Catalyst inlines, and a table function for nested tile trees."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .geo import EARTH_RADIUS, M_PER_DEG_SHIFT

SCALARS = {
    "haversine_m(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE)": (
        "DOUBLE", f"2 * {EARTH_RADIUS} * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))"),
    "bearing_deg(dx DOUBLE, dy DOUBLE)": ("DOUBLE", "pmod(degrees(atan2(dx, -dy)), 360.0D)"),
    "metres_north(metres DOUBLE)": ("DOUBLE", f"metres / {M_PER_DEG_SHIFT}D"),
    "boxes_touch(ax0 DOUBLE, ay0 DOUBLE, ax1 DOUBLE, ay1 DOUBLE, bx0 DOUBLE, by0 DOUBLE, bx1 DOUBLE, by1 DOUBLE)": (
        "BOOLEAN", "coalesce(ax0 <= bx1 AND ax1 >= bx0 AND ay0 <= by1 AND ay1 >= by0, true)"),
    "progress_percent(line STRING)": ("INT", "if(line RLIKE '@@PROGRESS@@ -?[0-9]+', least(greatest(cast(regexp_extract(line, '@@PROGRESS@@ (-?[0-9]+)', 1) AS INT), 0), 100), NULL)"),
}
TABLES = {
    "tile_ancestors(tz INT, tx BIGINT, ty BIGINT)": (
        "TABLE(z INT, x BIGINT, y BIGINT)", "SELECT tz - up, shiftright(tx, up), shiftright(ty, up) FROM (SELECT explode(sequence(0, tz)) AS up)"),
}


@udtf(returnType="tile_id: string, parent_id: string, depth: int, content: string, geometric_error: double, can_refine: boolean")
class FlattenTileset:
    """Rows of the nodes of a nested tileset document; ids are paths of child numbers."""

    def eval(self, text: str):
        stack = [(json.loads(text or "{}").get("root"), "0", None, 0, "REPLACE")]
        while stack:
            node, tile_id, parent, depth, inherited = stack.pop()
            if not isinstance(node, dict):
                continue
            kids, refine = node.get("children") or [], node.get("refine", inherited)
            content = node.get("content") or {}
            error = node.get("geometricError")
            yield tile_id, parent, depth, content.get("uri") or content.get("url"), None if error is None else float(error), refine == "REPLACE" and bool(kids)
            stack += [(k, f"{tile_id}.{i}", tile_id, depth + 1, refine) for i, k in enumerate(kids)]


def register(spark: SparkSession) -> None:
    for head, (kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    for head, (kind, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("flatten_tileset", FlattenTileset)
