"""Tables that cut lineage, written to the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Words are runs of anything but space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of a row group, which a writing task holds in memory.
ROWS_BYTES = 16 << 20
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where unset, a fresh local one, or the warehouse on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-lapgrid-")
        else:
            _OWN[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return _OWN[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


class Scratch:
    """Parquet tables of one operator call.  drop() removes one that no later step reads; the others, on which results rest, go when the session's JVM ends."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag, self.paths = spark, tag, {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, f"{self.tag}-{name}")
        df.write.option("parquet.block.size", ROWS_BYTES).parquet(path)
        files, where = self._at(path)
        files.deleteOnExit(where)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _, path = self.paths.pop(id(df), (None, None))
            if path:
                files, where = self._at(path)
                files.delete(where, True)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
