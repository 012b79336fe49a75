"""Inputs of the operators, derived from the benchmark tables.

Each derivation is one SELECT in the SQL that Spark and DuckDB share, so the
checking SQL of a query can start from the same rows.  Everything is integer
exact or a single rounding.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "conversations")

#: name -> SELECT over tables and earlier derivations.
VIEWS = {
    "telemetry": """
        SELECT session_id, seq, 0.1e0 * seq + 5e0 * gap AS t, frag, cast(floor(seq / 20) AS int) AS lap,
          22.71e0 + cast(0.00002 AS double) * seq + CASE WHEN value > 200 THEN 0.001e0 ELSE 0e0 END AS lat, 113.86e0 AS lon,
          0.1e0 * (seq % 20) AS et, 6 + event_id % 10 AS sats, value / 100 AS acc
        FROM (SELECT user_id AS session_id, event_id, value,
            cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bigint) AS seq,
            cast(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS bigint) AS frag,
            cast(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS bigint) AS gap
          FROM events)""",
    "pixels": """
        SELECT l_suppkey AS clip, cast(l_linenumber - 1 AS int) % 5 AS tag, l_partkey % 256 AS x, l_orderkey % 256 AS y,
          l_discount * 10 AS prob, l_orderkey * 8 + l_linenumber AS ord, l_returnflag = 'R' AS exclude FROM lineitem""",
    "rects": """
        SELECT c_custkey AS rect_id, c_nationkey AS group_id, (c_custkey * 37) % 240 AS x0, (c_custkey * 53) % 240 AS y0,
          (c_custkey * 37) % 240 + 3 + c_custkey % 13 AS x1, (c_custkey * 53) % 240 + 3 + c_nationkey % 9 AS y1,
          CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END AS tag
        FROM customer""",
    "plots": """
        SELECT c_custkey AS rect_id, tag, x0, y0, x0 + 3 + c_custkey % 13 AS x1, y0 + 3 + c_nationkey % 9 AS y1
        FROM (SELECT c_custkey, c_nationkey, (c_custkey * 7919) % side AS x0, (c_custkey * 104729) % side AS y0,
            CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END AS tag
          FROM customer CROSS JOIN (SELECT 17 * cast(ceil(sqrt(count(*))) AS bigint) + 1 AS side FROM customer) s)""",
    "sheets": """
        SELECT cast(floor(c_custkey / 100) AS bigint) AS mask_id, (c_custkey * 37) % 112 AS x0, (c_custkey * 53) % 112 AS y0,
          (c_custkey * 37) % 112 + 3 + c_custkey % 13 AS x1, (c_custkey * 53) % 112 + 1 + c_nationkey % 4 AS y1 FROM customer""",
    "centers": """
        SELECT c_custkey AS point_id, c_nationkey AS group_id, (c_custkey * 7919) % 10007 AS x, (c_custkey * 104729) % 10009 AS y FROM customer""",
    "tiles": """
        SELECT cast('root' AS string) AS tile_id, cast(NULL AS string) AS parent_id, 0 AS level, false AS has_mesh, true AS can_refine, cast(NULL AS bigint) AS x0, cast(NULL AS bigint) AS y0, cast(NULL AS bigint) AS x1, cast(NULL AS bigint) AS y1
        UNION ALL SELECT concat('r', r_regionkey), 'root', 15, false, true, min((c_custkey * 37) % 1000 - 10), min((c_custkey * 53) % 1000 - 10), max((c_custkey * 37) % 1000 + 10), max((c_custkey * 53) % 1000 + 10)
          FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_regionkey
        UNION ALL SELECT concat('n', n_nationkey), concat('r', min(n_regionkey)), 17, true, n_nationkey % 7 <> 3, min((c_custkey * 37) % 1000 - 10), min((c_custkey * 53) % 1000 - 10), max((c_custkey * 37) % 1000 + 10), max((c_custkey * 53) % 1000 + 10)
          FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey
        UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey), 19, true, false, (c_custkey * 37) % 1000 - 10, (c_custkey * 53) % 1000 - 10, (c_custkey * 37) % 1000 + 10, (c_custkey * 53) % 1000 + 10 FROM customer""",
    "objects": """
        SELECT o_orderkey AS object_id, o_custkey % 3 AS layout, o_orderkey % 256 AS x, o_custkey % 256 AS y,
          CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'hotlap' WHEN '2' THEN 'pit' WHEN '3' THEN 'start' WHEN '4' THEN 'timing_left' ELSE 'timing_right' END AS type
        FROM orders""",
    "track": """
        SELECT p_partkey % 4 AS layout, cast(row_number() OVER (PARTITION BY p_partkey % 4 ORDER BY p_partkey) - 1 AS int) AS idx,
          (p_partkey * 11) % 2000 + p_size AS x, (p_partkey * 17) % 1500 + 2 * p_size AS y FROM part""",
    "log_lines": """
        SELECT conv_id AS run, turn AS ord,
          CASE WHEN turn % 5 = 0 THEN concat('=== Stage ', turn, 'a: step') ELSE concat('@@PROGRESS@@ ', (turn * 17) % 120, ' ', role) END AS value FROM conversations""",
    "rings": """
        SELECT vec_id AS ring_id, label % 5 AS tag, i AS v, ((vec_id * 97) % 1000) * 16 + dx * r AS x, ((vec_id * 61) % 1000) * 16 + dy * r AS y
        FROM (SELECT vec_id, label, i, dx, dy, 20 + cast(floor(abs(cast(e AS double)) * 1000) AS bigint) % 60 AS r FROM ring_values)""",
}
#: The sixteen directions of a ring, scaled by 16, counter-clockwise.
DIRECTIONS = [(16, 0), (15, 6), (11, 11), (6, 15), (0, 16), (-6, 15), (-11, 11), (-15, 6), (-16, 0), (-15, -6), (-11, -11), (-6, -15), (0, -16), (6, -15), (11, -11), (15, -6)]
_DIR = ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(DIRECTIONS))
VIEWS = {"ring_values": f"SELECT vec_id, label, d.i, d.dx, d.dy, embedding[d.i + {{base}}] AS e FROM embeddings CROSS JOIN (VALUES {_DIR}) AS d(i, dx, dy)"} | VIEWS
NEEDS = {"rings": ["ring_values"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derivation as a DataFrame."""
    text = VIEWS[name].replace("{base}", "0")
    used = {n: view(spark, sf_dir, n) for n in NEEDS.get(name, [])} | {n: table(spark, sf_dir, n) for n in TABLES if f" {n}" in f"{text}\n".replace("\n", " ")}
    for n in used:
        text = _rename(text, n)
    return spark.sql(text, **used)


def _rename(text: str, n: str) -> str:
    """Table n as a parameter of spark.sql, so no view of the session's is made or replaced."""
    return re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)


def ctes(*names: str) -> str:
    """The derivations as the start of a WITH clause for the checking SQL."""
    order = [m for n in names for m in [*NEEDS.get(n, []), n]]
    return "WITH RECURSIVE " + ",\n ".join(f"{n} AS ({VIEWS[n].replace('{base}', '1')})" for n in dict.fromkeys(order))
