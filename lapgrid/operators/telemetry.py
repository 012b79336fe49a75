"""Lap statistics, thinning and segments of position logs (session_id, lap, seq, t, frag, lat, lon, et, sats, acc)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def lap_stats(points: DataFrame) -> DataFrame:
    """Per session and lap: points, time (range of elapsed with two values or more, else of t), its text, mean satellites and accuracy."""
    g = points.groupBy("session_id", F.greatest("lap", F.lit(0)).alias("lap")).agg(
        F.count("*").alias("n"), F.count("et").alias("n_et"), (F.max("et") - F.min("et")).alias("by_et"), (F.max("t") - F.min("t")).alias("by_t"),
        F.avg("sats").alias("sats"), F.avg("acc").alias("acc"))
    seconds = F.when(F.col("n_et") >= 2, F.col("by_et")).otherwise(F.col("by_t"))
    return g.select("session_id", "lap", "n", F.round(seconds, 6).alias("seconds"), geo.lap_time_text(F.round(seconds, 6)).alias("text"),
                    F.round("sats", 6).alias("sats"), F.round("acc", 6).alias("acc"))


def segments(points: DataFrame, max_gap: float = 2.0, max_jump: float = 30.0) -> DataFrame:
    """Adds segment, counted from 0 per session and lap; points of segments of one are dropped.

    A point is flagged if the fragment changes, time jumps or place jumps.  A cut
    needs two points in the open segment, so in a run of flags every other one,
    from the first, takes effect; a lap's first point counts as flagged.
    """
    w = Window.partitionBy("session_id", "lap").orderBy("seq")
    jump = geo.haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    flag = F.coalesce((F.col("frag") != F.lag("frag").over(w)) | (F.abs(F.col("t") - F.lag("t").over(w)) > max_gap) | (jump > max_jump), F.lit(True))
    p = points.withColumn("_flag", flag)
    p = p.withColumn("_run", F.sum(F.when(F.col("_flag"), 0).otherwise(1)).over(w))
    pos = F.sum(F.col("_flag").cast("int")).over(Window.partitionBy("session_id", "lap", "_run").orderBy("seq"))
    p = p.withColumn("_cut", (F.col("_flag") & (pos % 2 == 1)).cast("int"))
    p = p.withColumn("segment", F.sum("_cut").over(w) - 1)
    p = p.withColumn("_n", F.count("*").over(Window.partitionBy("session_id", "lap", "segment")))
    return p.where("_n > 1").drop("_flag", "_run", "_cut", "_n")


def thin(points: DataFrame, metres: float) -> DataFrame:
    """Keeps a lap's first point and each that is at least so far from the last kept one.  The order is inherently sequential within a lap."""
    if metres <= 0:
        return points

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, la0, lo0 = None, 0.0, 0.0
        for b in batches:
            keys = zip(b["session_id"].to_pylist(), b["lap"].to_pylist(), strict=True)
            la, lo = (np.radians(b[c].to_numpy(zero_copy_only=False).astype(float)).tolist() for c in ("lat", "lon"))
            kept = []
            for i, key in enumerate(keys):
                if key == at:
                    s = math.sin((la[i] - la0) / 2) ** 2 + math.cos(la0) * math.cos(la[i]) * math.sin((lo[i] - lo0) / 2) ** 2
                    if 2 * geo.EARTH_RADIUS * math.atan2(math.sqrt(s), math.sqrt(1 - s)) < metres:
                        continue
                kept.append(i)
                at, la0, lo0 = key, la[i], lo[i]
            yield b.take(pa.array(kept, pa.int64()))

    # Sorted laps pass one after another: a task holds one batch and the last point kept, and a short lap costs no call of its own.
    laps = points.repartition("session_id", "lap").sortWithinPartitions("session_id", "lap", "seq")
    return laps.mapInArrow(keep, points.schema)


def session_extent(points: DataFrame) -> DataFrame:
    """Mean latitude and bounds of each session."""
    return points.groupBy("session_id").agg(F.round(F.avg("lat"), 9).alias("ref_lat"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))
