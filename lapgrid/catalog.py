"""All queries over the library's own operators, with the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import cover_queries, function_queries, grid_queries, more_queries, outline_queries, source_queries, spatial_queries, start_queries, surface_queries, track_queries

_PARTS = [function_queries, track_queries, grid_queries, spatial_queries, source_queries, more_queries, surface_queries, outline_queries, cover_queries, start_queries]
QUERIES: dict = {name: q for part in _PARTS for name, q in part.R.queries.items()}
SQL: dict[str, str] = {name: s for part in _PARTS for name, s in part.R.sql.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["a5_coverage"](spark, sf_dir)
