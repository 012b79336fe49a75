"""Progress of runs as a stream of log lines (run, ord, value), and throttling of updates."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import geo

STATES = "run long, ord long, stage string, pct int"
#: So many neighbouring runs, or laps of a session, share one group of a stream and its state: a call for each group costs more than its rows.
TOGETHER = 64


def _rows(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    """The rows of a group, in order of the last column; what is missing is None."""
    lists = [[None if v != v else v for b in bs for v in b.tolist()] for bs in zip(*[[g[c] for c in columns] for g in batches], strict=True)]
    return iter(sorted(zip(*lists, strict=True), key=lambda r: (r[-1] is None, r[-1])))


def progress_events(lines: DataFrame) -> DataFrame:
    """A row for each progress line with the stage it belongs to; a new stage header closes the stage before with 100.

    The state of a run is its current stage and last percentage.  Lines of a run
    that arrive together are taken in order of ord.
    """

    def update(_key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs = {r: (s, p) for r, s, p in zip(*state.get, strict=True)} if state.exists else {}
        out = []
        for run, value, ord_ in _rows(batches, ["run", "value", "ord"]):
            stage, pct = runs.get(run, ("", 0))
            head = re.match(r"=== Stage ([0-9]+[a-z]?):", value)
            line = re.search(r"@@PROGRESS@@ (-?\d+)", value)
            if head:
                if stage:
                    out.append((run, ord_, stage, 100))
                stage, pct = head[1], 0
            elif line:
                pct = min(max(int(line[1]), 0), 100)
                out.append((run, ord_, stage, pct))
            runs[run] = stage, pct
        state.update(([*runs], [s for s, _ in runs.values()], [p for _, p in runs.values()]))
        yield pd.DataFrame(out, columns=["run", "ord", "stage", "pct"])

    return lines.withColumn("_runs", F.floor(F.col("run") / TOGETHER)).groupBy("_runs").applyInPandasWithState(update, STATES, "runs array<long>, stages array<string>, pcts array<int>", "append", GroupStateTimeout.NoTimeout)


def throttled(events: DataFrame, least: int) -> DataFrame:
    """Of events (run, ord, stage, pct) those that change by ``least`` or more from the last one let through; a stage's first always passes."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, 0
        for b in batches:
            keep = []
            for i, (run, stage, pct) in enumerate(zip(*[b[c].to_pylist() for c in ("run", "stage", "pct")], strict=True)):
                if (run, stage) != at or abs(pct - last) >= least:
                    keep.append(i)
                    at, last = (run, stage), pct
            yield b.take(pa.array(keep, pa.int64()))

    # Sorted stages pass one after another, so that a task holds one batch and the last event let through.
    return events.repartition("run", "stage").sortWithinPartitions("run", "stage", "ord").mapInArrow(fold, events.schema)


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over what there is, into Parquet, and reads that."""
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def close_runs(events: DataFrame, codes: DataFrame) -> DataFrame:
    """(run, stage, status): a run that ended with code 0 completes all its stages; otherwise the stages under 100 failed."""
    last = events.groupBy("run", "stage").agg(F.max_by("pct", "ord").alias("pct"))
    j = last.join(codes, "run")
    return j.select("run", "stage", F.when((F.col("code") == 0) | (F.col("pct") == 100), "complete").otherwise("error").alias("status"))


def segment_stream(points: DataFrame, max_gap: float = 2.0, max_jump: float = 30.0) -> DataFrame:
    """Telemetry segments on a stream, by the same cut rules as in batch: (session_id, lap, seq, segment).

    The state of a lap is its last point, the open segment's number and size,
    and that segment's first point until a second one confirms it.
    """
    state_schema = "laps array<int>, segment array<int>, size array<int>, held array<long>, t array<double>, frag array<long>, lat array<double>, lon array<double>"

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        laps = {r[0]: r[1:] for r in zip(*state.get, strict=True)} if state.exists else {}
        out = []
        for lap, at, af, alat, alon, seq in _rows(batches, ["lap", "t", "frag", "lat", "lon", "seq"]):
            segment, size, held, t, frag, lat, lon = laps.get(lap, (0, 0, -1, 0.0, 0, 0.0, 0.0))
            if size:
                s = math.sin(math.radians(alat - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(alat)) * math.sin(math.radians(alon - lon) / 2) ** 2
                jump = 2 * geo.EARTH_RADIUS * math.atan2(math.sqrt(s), math.sqrt(1 - s))
                if size > 1 and (af != frag or abs(at - t) > max_gap or jump > max_jump):
                    segment, size = segment + 1, 0
            size += 1
            if size == 1:
                held = seq
            else:
                out += [(key[0], lap, held, segment)] if size == 2 else []
                out.append((key[0], lap, seq, segment))
            laps[lap] = segment, size, int(held), float(at), int(af), float(alat), float(alon)
        state.update(([*laps], *map(list, zip(*laps.values(), strict=True))))
        yield pd.DataFrame(out, columns=["session_id", "lap", "seq", "segment"])

    group = points.withColumn("_laps", F.floor(F.col("lap") / TOGETHER)).groupBy("session_id", "_laps")
    return group.applyInPandasWithState(update, "session_id long, lap int, seq long, segment long", state_schema, "append", GroupStateTimeout.NoTimeout)
