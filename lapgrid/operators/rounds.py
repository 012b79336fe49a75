"""Bounded rounds of DataFrame steps, each cut off by a written table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where unset, a fresh local one, or the warehouse on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.applicationId not in _OWN:
        local = sc.master.startswith("local[") or sc.master == "local"
        _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-rounds-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_rounds"
    return _OWN[sc.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written as a table to the folder that the cluster shares; it goes when the session's JVM ends.

    A table has its true size.  A checkpoint keeps the estimate of its plan, and that of a join is a product, so over rounds of joins
    estimates would grow to numbers of millions of digits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def iterate(df: DataFrame, step: Callable[[DataFrame, int], DataFrame], changed: str, most: int = 1000) -> DataFrame:
    """Repeats step until no row has the boolean column ``changed`` set."""
    df = cut(df)
    for k in range(most):
        df = cut(step(df, k))
        if not df.where(changed).limit(1).count():
            return df
    raise RuntimeError(f"no fixed point after {most} rounds")


def components(nodes: DataFrame, edges: DataFrame, most: int = 100) -> DataFrame:
    """(id, comp): the smallest id reachable over edges (a, b), by propagation of the smallest label with pointer jumping."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())

    def step(label: DataFrame, _k: int) -> DataFrame:
        near = both.join(label.select(F.col("id").alias("b"), F.col("comp").alias("m")), "b").groupBy("a").agg(F.min("m").alias("m"))
        s = label.join(near, label["id"] == near["a"], "left").select("id", F.col("comp").alias("old"), F.least("comp", F.coalesce("m", "comp")).alias("comp"))
        jump = label.select(F.col("id").alias("comp"), F.col("comp").alias("j"))
        return s.join(jump, "comp", "left").select("id", F.least("comp", F.coalesce("j", "comp")).alias("comp"), (F.least("comp", F.coalesce("j", "comp")) < F.col("old")).alias("changed"))

    return iterate(nodes.select("id", F.col("id").alias("comp")), step, "changed", most).select("id", "comp")


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """df with each row's place in the order, from 0: a sort by ranges, and one count for each of its partitions, no window over all rows."""
    at = F.monotonically_increasing_id()
    s = cut(df.orderBy(*order).withColumn("_at", at))
    part, row = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = s.groupBy(part).agg(F.count("*").alias("_n"))
    # One row for each partition of the sort.
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return s.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + row).drop("_at", "_part", "_before")
