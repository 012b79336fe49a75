"""Quality by importance resampling: two hashed n-gram models and a Gumbel top-k.

Unigrams and bigrams of lower-cased words are hashed into BUCKETS.  The raw
model counts those of all documents, the target model those of documents
labelled good (at most TARGET of them, those with the smallest id hashes, a
bound on what is broadcast).  A document's log weight is the log ratio of its
probabilities under the two models: the sum over all its n-grams, of a text of
any length.  Adding Gumbel noise, seeded by doc_id,
and taking the k largest keys samples k documents without replacement in
proportion to their weights.  k defaults to the labelled share of good
documents times the number of documents.  The k-th key is found by counting
keys in ever finer ranges, so nothing is sorted or gathered whole.

Null and empty texts have log weight 0.  Ties at the k-th key, such as repeated
rows, are all kept.  Without good labels both models are the same.  An empty
table gives an empty result.  Columns beyond doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, documents
from .spread import kth_largest

BUCKETS = 10_000
TARGET = 50_000
SEED = 23
_MUL = np.uint64(0x9E3779B97F4A7C15)


def ngrams(text: str | None) -> np.ndarray:
    """Buckets of the unigrams and bigrams of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    two = h[:-1] * _MUL + h[1:]
    two = (two ^ (two >> np.uint64(31))) * _MUL
    return (np.concatenate([h, two]) >> np.uint64(20)).astype(np.int64) % BUCKETS


def counts(docs: DataFrame) -> DataFrame:
    """(bucket, raw, target): n-grams of all documents and of those with good = true."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for t, good in zip(b["text"], b["good"], strict=True):
                c = np.bincount(ngrams(t), minlength=BUCKETS)
                raw += c
                if good:
                    target += c
        yield pd.DataFrame({"bucket": np.arange(BUCKETS), "raw": raw, "target": target})

    parts = docs.select("text", "good").mapInPandas(work, "bucket int, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratio(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET)
    marked = docs.select("doc_id", "text").join(F.broadcast(good.withColumn("good", F.lit(True))), "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False)))
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in counts(marked).collect():
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if target.sum() == BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight and key, the log weight plus Gumbel noise."""

    @F.pandas_udf("double")
    def weight(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            i = ngrams(t)
            out.append(float(ratio[i].sum()))
        return pd.Series(out, dtype="float64")

    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 12).cast("double") + 0.5) / float(1 << 52)
    w = docs.select("doc_id", F.round(weight(F.col("text")), 9).alias("log_weight"), u.alias("u"))
    return w.select("doc_id", "log_weight", F.round(F.col("log_weight") - F.log(-F.log("u")), 9).alias("key"))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, key and kept for every document."""
    scratch = Scratch(docs.sparkSession, "resample")
    if share is None:
        share = labels.where("quality IS NOT NULL").agg(F.avg(F.col("quality").cast("double"))).head()[0]
    share = 1.0 if share is None else share
    scored = scratch.table(weigh(docs, log_ratio(docs, labels), seed), "scored")
    least = kth_largest(scored, "key", round(share * scored.count()))
    return scored.withColumn("kept", F.lit(False) if least is None else F.col("key") >= least)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
