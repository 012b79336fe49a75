"""A training corpus from documents, in five stages; each stage's result is written and read again.

Null and empty texts pass all stages (a text that line dedup empties is a copy
of kept lines, and goes).  Repeated rows are repeated documents, of which the near-duplicate stage
keeps one.  Columns that documents has beyond its own keep their values,
whatever their names, up to the last stage, which returns the mix (doc_id, source, sizes, target
and words taken) of the documents that are left.  Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapgrid.llm import decontaminate, line_dedup, mixing, near_dup, toxicity
from lapgrid.llm.scratch import Scratch, documents


DOCUMENT = ["doc_id", "text"]


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is not among the given ones.  A null id is never among them."""
    return docs.join(ids.where("doc_id IS NOT NULL").select("doc_id"), "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs.select("doc_id", "text"), documents(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return docs.where(~toxicity.is_toxic(F.col("text"), model))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(docs.select(*DOCUMENT, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    left = out.where("n_removed = 0 OR text <> ''")
    now = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return left.select(*[now.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; of rows with one id, one."""
    scratch = Scratch(spark, "pipeline")
    found = scratch.table(near_dup.near_duplicates(docs), "components")
    # Written first, so that Spark knows their size when it chooses the join.
    left = without(docs, scratch.table(found.where(~F.col("kept")).select("doc_id").distinct(), "dropped"))
    twice = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if not twice.limit(1).count():
        return left
    again = left.join(twice.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("r"))
    return without(left, twice).unionByName(again.select("r.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, documents(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target and taken, the words of each document in the mix."""
    return mixing.mix(docs.select("doc_id", "source", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("source_mix", mix_sources),
]
#: Hashes and trained weights take part, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "corpus"), documents(spark, sf_dir)
    for name, stage in STAGES:
        after = scratch.table(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = after
    return docs
