"""Toxicity: cumulative-link ordinal regression over sparse word and word-prefix features.

Labels say toxic or not; severity grades come from them by rule.  Features are
words and word prefixes that toxic labelled documents hold significantly more
often (z score of the log odds).  A clean document has grade 0; a toxic one has
grade 1, 2 or 3 by the terciles of its number of words that are toxic by a lexicon selected
on the other half of the labelled documents, so no document is graded by words that it helped to choose.
One weight vector
is shared by all grades and only the ordered thresholds differ:
P(grade > k) = sigmoid(w.x - theta_k), x = log(1 + count); the number of words is
one more feature, so that long texts need more hits.  The result has the
expected severity, the sum of these probabilities, and is_toxic,
P(grade > 0) >= 0.5.

Words are split at space and the ASCII controls 9 to 13, lower-cased, and stripped of ASCII punctuation,
by one function for selection, training and scoring.  Training uses at most SAMPLE labelled documents of each class, those with the
smallest hashes of their ids, and at most FEATURES features, those with the largest z scores; classes are weighed back to their true shares.
Selection of features is a Spark aggregation; what reaches the driver is at
most FEATURES names and the hits of 2 * SAMPLE documents.  Every document is
scored, over its whole text.

Null or empty text: no features, severity by the thresholds alone.  Repeated
rows get the same score; labels of a repeated doc_id count once, toxic if any
is, and of documents that share a labelled id one is trained on, the one with the smallest text hash.
Null labels are skipped.  Without labels of both classes nothing is toxic
and severity is 0.  An empty table gives an empty result.  Columns of the input named like a result are replaced, others keep their values.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, documents
from .spread import unused

SAMPLE = 6000
FEATURES = 20_000
Z = 4.0
PREFIXES = (3, 4, 5, 6, 7)
GRADES = 3
_EDGES = "".join(chr(c) for c in range(33, 127) if unicodedata.category(chr(c))[0] in "PS")
_MEMO = 50_000


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a text, as UTF-8."""
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def features_of(word: bytes) -> list[str]:
    w = word.decode("utf-8", "surrogatepass").strip(_EDGES)
    return ["w:" + w] + [f"p:{w[:n]}" for n in PREFIXES if len(w) > n] if w else []


def _hits(texts: pd.Series, known: dict[str, int]):
    """For each text the counts of known features, as a dict of index to count; the last index has the number of words."""
    memo: dict[bytes, list[int]] = {}
    for t in texts:
        found: dict[int, int] = {}
        words = words_of(t)
        for raw, n in Counter(words).items():
            if (ix := memo.get(raw)) is None:
                if len(memo) > _MEMO:
                    memo.clear()
                ix = memo[raw] = [known[f] for f in features_of(raw) if f in known]
            for i in ix:
                found[i] = found.get(i, 0) + n
        found[len(known)] = len(words)
        yield found


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """text, toxic, weight and fold (0 or 1) of at most ``size`` documents of each class."""
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = []
    for c, n in totals.items():
        ids = one.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
        parts.append(ids.withColumn("weight", F.lit(n / min(n, size))))
    if not parts:
        return docs.selectExpr("text", "0 AS toxic", "1e0 AS weight", "0 AS fold").limit(0)
    ids = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    one = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic", "weight").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return one.select("text", "toxic", "weight", F.pmod(F.hash("doc_id"), F.lit(2)).alias("fold"))


def select_features(sample: DataFrame, z: float, most: int) -> list[str]:
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return []

    def distinct(batches):
        for toxic, text in ((y, t) for b in batches for y, t in zip(b["toxic"], b["text"], strict=True)):
            # One document at a time: a batch of them has too many features to hold.
            if found := sorted({f for w in set(words_of(text)) for f in features_of(w)}):
                yield pd.DataFrame({"toxic": np.full(len(found), toxic, dtype=np.int32), "f": found})

    seen = sample.select("toxic", "text").mapInPandas(distinct, "toxic int, f string").groupBy("f").agg(F.sum("toxic").alias("a"), F.count("*").alias("both"))
    a, c = F.col("a") + 0.5, F.col("both") - F.col("a") + 0.5
    odds = F.log(a / (n[1] - F.col("a") + 0.5)) - F.log(c / (n[0] - F.col("both") + F.col("a") + 0.5))
    score = odds / F.sqrt(1 / a + 1 / c)
    top = seen.where("a >= 3").withColumn("z", score).where(F.col("z") >= z).orderBy(F.desc("z"), "f").limit(most)
    return [r["f"] for r in top.select("f").collect()]


def fit_ordinal(rows, y, weight, width: int, steps: int = 400, rate: float = 0.05, l2: float = 1e-4, enough: float = 1e-4):
    """Weights and ordered thresholds by full-batch Adam on the weighted log likelihood.  rows: dicts of index to count.

    Only the weight of the length, the last, may be negative.  It ends when ten steps gain less than a share ``enough`` of the loss."""
    r = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    c = np.fromiter((i for x in rows for i in x), dtype=np.int64)
    v = np.log1p(np.fromiter((n for x in rows for n in x.values()), dtype=np.float64))
    w, cuts = np.zeros(width), np.concatenate([[1.0], np.zeros(GRADES - 1)])  # first cut, then logs of the gaps
    m1, m2 = np.zeros(width + GRADES), np.zeros(width + GRADES)
    total, losses = weight.sum(), []
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -35, 35)))
    for t in range(1, steps + 1):
        eta = np.bincount(r, v * w[c], minlength=len(rows))
        gaps = np.exp(cuts[1:])
        theta = cuts[0] + np.concatenate([[0], np.cumsum(gaps)])
        up = np.hstack([np.ones((len(rows), 1)), sig(eta[:, None] - theta), np.zeros((len(rows), 1))])  # P(grade >= k)
        p = np.maximum(up[np.arange(len(rows)), y] - up[np.arange(len(rows)), y + 1], 1e-12)
        losses.append(-(weight * np.log(p)).sum() / total + l2 / 2 * (w * w).sum())
        if t > 40 and min(losses[:-10]) - min(losses[-10:]) < enough * min(losses[-10:]):
            break
        d = up * (1 - up)
        g_eta = -weight * (d[np.arange(len(rows)), y] - d[np.arange(len(rows)), y + 1]) / p / total
        g_theta = np.zeros(GRADES + 2)
        np.add.at(g_theta, y, weight * d[np.arange(len(rows)), y] / p / total)
        np.add.at(g_theta, y + 1, -weight * d[np.arange(len(rows)), y + 1] / p / total)
        g_theta = g_theta[1:-1]
        g_cuts = np.concatenate([[g_theta.sum()], [g_theta[k:].sum() * gaps[k - 1] for k in range(1, GRADES)]])
        g = np.concatenate([np.bincount(c, v * g_eta[r], minlength=width) + l2 * w, g_cuts])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
        w, cuts = w - step[:width], cuts - step[width:]
        w[:-1] = np.maximum(w[:-1], 0)
    return w, cuts[0] + np.concatenate([[0], np.cumsum(np.exp(cuts[1:]))])


def train(docs: DataFrame, labels: DataFrame, sample_size: int = SAMPLE, z: float = Z, most: int = FEATURES):
    """(features, weights, thresholds), or None without labels of both classes."""
    sample = Scratch(docs.sparkSession, "toxic").table(labelled_sample(docs, labels, sample_size), "sample")
    names = select_features(sample, z, most)
    if not names:
        return None
    known = {f: i for i, f in enumerate(names)}
    other = [{f: i for i, f in enumerate(select_features(sample.where(F.col("fold") == 1 - k), z, most)) if f[0] == "w"} for k in (0, 1)]

    def hits(batches):
        for b in (b.iloc[i : i + 256] for b in batches for i in range(0, len(b), 256)):
            found, held = list(_hits(b["text"], known)), [list(_hits(b["text"], o)) for o in other]
            toxic_words = [sum(held[f][k].values()) - held[f][k][len(other[f])] for k, f in enumerate(b["fold"])]
            yield pd.DataFrame({"toxic": b["toxic"].to_numpy(), "weight": b["weight"].to_numpy(), "words": toxic_words, "ix": [list(x) for x in found], "n": [list(x.values()) for x in found]})

    got = sample.mapInPandas(hits, "toxic int, weight double, words long, ix array<int>, n array<int>").collect()
    got.sort(key=lambda r: (r["toxic"], r["words"], r["ix"], r["n"]))
    rows = [dict(zip(r["ix"], r["n"], strict=True)) for r in got]
    toxic, weight, words = (np.array([r[c] for r in got]) for c in ("toxic", "weight", "words"))
    cut = np.quantile(words[toxic == 1], [1 / 3, 2 / 3])
    grade = np.where(toxic == 1, 1 + (words > cut[0]) + (words > cut[1]), 0)
    w, theta = fit_ordinal(rows, grade, weight, len(names) + 1)
    return names, w, theta


def _above(model) -> Callable[[Column], Column]:
    """A column function: P(grade > k) for each k."""
    names, w, theta = model
    known = {f: i for i, f in enumerate(names)}
    logs, theta = [math.log1p(n) for n in range(256)], np.asarray(theta)

    @F.pandas_udf("array<double>")
    def above(texts: pd.Series) -> pd.Series:
        out = []
        for found in _hits(texts, known):
            eta = sum(w[i] * (logs[n] if n < 256 else math.log1p(n)) for i, n in found.items())
            out.append(list(1 / (1 + np.exp(-np.clip(eta - theta, -35, 35)))))
        return pd.Series(out)

    return above


def is_toxic(text: Column, model) -> Column:
    """Whether a text is toxic; false without a model."""
    return F.lit(False) if model is None else F.element_at(_above(model)(text), 1) >= 0.5


def score(docs: DataFrame, model) -> DataFrame:
    """The columns of docs, and p_toxic, expected_severity and is_toxic."""
    if model is None:
        return docs.withColumns({"p_toxic": F.lit(0.0), "expected_severity": F.lit(0.0), "is_toxic": F.lit(False)})
    (above,) = unused(docs, "above")
    scored = docs.withColumn(above, _above(model)(F.col("text")))
    p = F.round(F.element_at(above, 1), 9)
    total = F.round(F.aggregate(above, F.lit(0.0), lambda a, x: a + x), 9)
    return scored.withColumns({"p_toxic": p, "expected_severity": total, "is_toxic": F.element_at(above, 1) >= 0.5}).drop(above)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return toxicity(docs, documents(spark, sf_dir, "labels")).select("doc_id", "p_toxic", "expected_severity", "is_toxic")
