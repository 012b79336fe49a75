"""Group work that a hot key can't hold up, and names that meet no column of the input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front of those that a column of df has in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def with_group(rows: DataFrame, keys: list[str], by: list[str], aggs: dict[str, tuple[Column, str]], where: str = "true") -> DataFrame:
    """Each row with the aggregates of its group, where these meet a condition.

    A group is dealt by a hash of the columns ``by`` over as many parts as there are shuffle partitions, so that no
    task gets a whole hot one: the parts are aggregated, their results merged (one row for each part), and each
    part's rows meet the result in a join on key and part, for which they are shuffled once.  aggs: name -> (column
    of a row, one of min, max and sum).  Rows with a null key are left out.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int"))
    some = dealt.groupBy(*keys, "_part").agg(*[getattr(F, how)(c).alias(name) for name, (c, how) in aggs.items()])
    whole = some.groupBy(*keys).agg(*[getattr(F, how)(name).alias(name) for name, (_, how) in aggs.items()]).where(where)
    back = some.select(*keys, "_part").join(whole, keys)
    return dealt.join(back, [*keys, "_part"]).drop("_part")


def kth_largest(df: DataFrame, column: str, k: int, parts: int = 1024):
    """The k-th largest value, by counting in ever finer ranges; nothing but the counts reaches the driver."""
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(column)).head()
    if not n or k <= 0:
        return None
    if k >= n:
        return lo
    while lo < hi:
        step = (hi - lo) / parts
        part = F.least(F.floor((F.col(column) - lo) / step), F.lit(parts - 1)) if step > 0 else F.lit(0)
        rows = df.where(F.col(column).between(lo, hi)).groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect()
        for r in sorted(rows, key=lambda r: -r["p"]):
            if k <= r["n"]:
                lo, hi = r["a"], r["b"]
                break
            k -= r["n"]
    return lo


def mapped(df: DataFrame, source: str, new: dict[str, T.DataType], work: Callable[[], Callable[[pa.Array], list[pa.Array]]], rows: int = 512) -> DataFrame:
    """The columns of df and new ones, which a task's ``work()`` makes from a column, at most ``rows`` rows at a time.

    Columns named like a new one are replaced, others keep their values.
    """
    keep = [c for c in df.columns if c.lower() not in {n.lower() for n in new}]
    # Plain names on the way, as a name may hold a dot or be there twice.
    given = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{source}`").alias("source"))
    schema = T.StructType([*given.schema.fields[:-1], *[T.StructField(f"new{i}", t) for i, t in enumerate(new.values())]])

    def batches(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for b in some:
            # Small pieces, so that a batch of long texts is not held in several forms at once.
            for part in (b.slice(i, rows) for i in range(0, b.num_rows, rows)):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *step(part.column(part.num_columns - 1))], names=schema.names)

    return given.mapInArrow(batches, schema).toDF(*keep, *new)
