r"""Line dedup: a suffix array over line ids by prefix doubling finds repeated runs of lines; later copies go.

A document is the sequence of its lines that hold a word.  Lines that occur
once are left out at the start, and so are stretches of repeated lines with
fewer than MIN_WORDS words in all, as no long repeat touches either.  The
remaining suffixes are ranked by their first line, then, in rounds that each
double the length, by pairs of ranks: rank k orders suffixes by their first
2^k lines.  Ranking is distributed: distinct pairs with their counts are
range-partitioned, and offsets come from the partitions' totals.  A pair that
occurs once leaves the race.

Suffixes whose common prefix has MIN_WORDS or more form an interval of the
array, named by two overlapping ranks of the shortest prefix with enough words;
likewise for the shortest stretch that ends at each
line.  Every line of a maximal repeated run lies in one or the other, so the
stretches of an interval other than its first, in order of doc_id, text hash
and line, cover exactly the later copies, and their lines are deleted.  An
interval may hold any number of suffixes: it is dealt in parts (spread.py).

Lines without a word are no part of runs and stay, unless no word is left:
then the text becomes empty.  A null text stays null.  Rows with equal doc_id
and text count as one document, and null ids come first.  Repeats within a
document count like any other.  Lines are equal if 128 bits of hash are.  An
empty table gives an empty result.  Other columns keep their values, whatever
their names; n_lines and n_removed replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch, documents
from .spread import unused, with_group

MIN_WORDS = 50
DOC = ["doc_id", "th"]


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, i, line, h, g, w): place among lines with a word, line number, two halves of its hash, and words."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, reps = [], []
            for text in b["text"]:
                n = 0
                for k, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
                    if w := len(line.split()):
                        h, g = divmod(xxhash.xxh3_128_intdigest(line), 2**64)
                        rows.append((n, k, h - 2**63, g - 2**63, w))
                        n += 1
                reps.append(n)
            out = pd.DataFrame(rows, columns=["i", "line", "h", "g", "w"])
            for c in ("th", "doc_id"):
                out.insert(0, c, b[c].repeat(reps).reset_index(drop=True))
            yield out

    return docs.mapInPandas(work, "doc_id long, th long, i int, line int, h long, g long, w int")


def ranked(pairs: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """Adds r: how many suffixes have a smaller key.  pairs: distinct keys with n, the number of suffixes."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.table(pairs.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()), "ranks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("part").agg(F.sum("n").alias("t")).select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    r = F.coalesce(F.sum("n").over(within), F.lit(0)) + F.col("base")
    return dealt.join(F.broadcast(base), "part").withColumn("r", r).drop("part", "base")


def _by_document(rows: DataFrame, work, schema: str) -> DataFrame:
    """Runs work on frames of whole documents, rows in order of i."""

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            a, t = b["doc_id"].to_numpy(), b["th"].to_numpy()
            same = (t == t[-1]) & ((a == a[-1]) | (pd.isna(a) & pd.isna(a[-1])))
            cut = len(b) - int(np.argmin(same[::-1])) if not same.all() else 0
            if held and cut:
                held.append(b.iloc[:cut])
                yield work(pd.concat(held, ignore_index=True))
                held = []
            elif held and not cut:
                p = held[-1].iloc[-1]
                if p["th"] != t[0] or not (p["doc_id"] == a[0] or (pd.isna(p["doc_id"]) and pd.isna(a[0]))):
                    yield work(pd.concat(held, ignore_index=True))
                    held = []
            elif cut:
                yield work(b.iloc[:cut].reset_index(drop=True))
            held.append(b.iloc[cut:])
        if held:
            yield work(pd.concat(held, ignore_index=True))

    return rows.repartition(*DOC).sortWithinPartitions(*DOC, "i").mapInPandas(whole, schema)


def _islands(g: pd.DataFrame) -> np.ndarray:
    """Number of the stretch of neighbouring lines that each row is in."""
    d = g["doc_id"].astype("Int64")
    new = (g["th"].diff() != 0) | (g["i"].diff() != 1) | ((d != d.shift()) | (d.isna() != d.shift().isna())).fillna(False).astype(bool)
    new.iloc[0] = True
    return np.cumsum(new.to_numpy())


def _stretches(min_words: int):
    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.copy()
        isl, cum = _islands(g), np.cumsum(g["w"].to_numpy(dtype=np.int64))
        start, end = np.searchsorted(isl, isl, "left"), np.searchsorted(isl, isl, "right")
        zero = np.concatenate([[0], cum])
        at = np.arange(len(g))
        to = np.searchsorted(cum, zero[at] + min_words, "left") + 1  # one after the last line of the shortest prefix
        fro = np.searchsorted(zero, cum[at] - min_words, "right") - 1  # the first line of the shortest stretch that ends here
        g["island"] = start - at + g["i"].to_numpy()
        g["fwd"] = np.where(to <= end, to - at, 0).astype(np.int32)
        g["bwd"] = np.where(fro >= start, at + 1 - fro, 0).astype(np.int32)
        enough = zero[end] - zero[start] >= min_words
        return g[enough][["doc_id", "th", "island", "i", "line", "r", "fwd", "bwd"]]

    return work


def _named(levels: int):
    def work(g: pd.DataFrame) -> pd.DataFrame:
        out, at = [], np.arange(len(g))
        ranks = np.stack([g[f"r{k}"].to_numpy(dtype=np.float64) for k in range(levels)])
        for kind, length, first in (("f", g["fwd"].to_numpy(), at), ("b", g["bwd"].to_numpy(), at + 1 - g["bwd"].to_numpy())):
            ok = length > 0
            k = np.zeros(len(g), dtype=np.int64)
            k[ok] = np.floor(np.log2(length[ok])).astype(np.int64)
            ok &= k < levels
            s, n, k = first[ok], length[ok], k[ok]
            a, b = ranks[k, s], ranks[k, s + n - (1 << k)]
            there = ~(np.isnan(a) | np.isnan(b))
            s, n, a, b = s[there], n[there], a[there].astype(np.int64), b[there].astype(np.int64)
            f = g[["doc_id", "th", "i"]].iloc[s].reset_index(drop=True)
            out.append(f.assign(kind=kind, n=n, a=a, b=b, line=g["line"].to_numpy()[s], last=g["line"].to_numpy()[s + n - 1]))
        return pd.concat(out, ignore_index=True)

    return work


def repeated_stretches(docs: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """(doc_id, th, line, last): stretches of lines of which an equal stretch comes earlier."""
    lines = scratch.table(_lines(docs.select("doc_id", "th", "text")), "lines")
    counts = lines.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1")
    first = ranked(counts, ["h", "g"], scratch).select("h", "g", "r")
    rows = _by_document(
        lines.join(first, ["h", "g"]).select(*DOC, "i", "line", "w", "r").dropDuplicates([*DOC, "i"]), _stretches(min_words),
        "doc_id long, th long, island int, i int, line int, r long, fwd int, bwd int")
    rows = scratch.table(rows.withColumnRenamed("r", "r0"), "rows")
    scratch.drop(lines)
    longest = rows.agg(F.max(F.greatest("fwd", "bwd"))).head()[0] or 0
    k = 0
    while 2 ** (k + 1) <= longest:
        ahead = Window.partitionBy(*DOC, "island").orderBy("i")
        nxt = rows.withColumn("ahead", F.lead(f"r{k}", 2**k).over(ahead))
        pairs = nxt.where(F.col(f"r{k}").isNotNull() & F.col("ahead").isNotNull()).groupBy(f"r{k}", "ahead").agg(F.count("*").alias("n")).where("n > 1")
        order = ranked(pairs, [f"r{k}", "ahead"], scratch).select(f"r{k}", "ahead", F.col("r").alias(f"r{k + 1}"))
        after = scratch.table(nxt.join(order, [f"r{k}", "ahead"], "left").drop("ahead"), "rows")
        scratch.drop(rows)
        rows, k = after, k + 1
    found = scratch.table(_by_document(rows, _named(k + 1), "doc_id long, th long, i int, kind string, n int, a long, b long, line int, last int"), "named")
    scratch.drop(rows)
    name = ["kind", "n", "a", "b"]
    place = F.struct("doc_id", "th", "i")
    many = with_group(found, name, [*DOC, "i"], {"first": (place, "min"), "many": (F.lit(1), "sum")}, "many > 1")
    return many.where(~place.eqNullSafe(F.col("first"))).select(*DOC, "line", "last").distinct()


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The columns of docs with later copies of repeated runs cut out of text, and n_lines and n_removed (lines with a word)."""
    scratch = Scratch(docs.sparkSession, "linededup")
    th, g_id, g_th, spans, done = unused(docs, "th", "g_id", "g_th", "spans", "done")
    keyed = docs.withColumn(th, F.xxhash64("text"))
    gone = repeated_stretches(docs.select("doc_id", "text", F.xxhash64("text").alias("th")), min_words, scratch)
    gone = scratch.table(gone.groupBy(*DOC).agg(F.collect_list(F.struct("line", "last")).alias(spans)), "gone").withColumnsRenamed({"doc_id": g_id, "th": g_th})
    # Texts are shuffled at every size alike; the cuts have no bound that would let them be broadcast.
    joined = keyed.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col(g_id)) & (F.col(th) == F.col(g_th)), "left")

    @F.pandas_udf("text string, n_lines long, n_removed long")
    def cut(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, s in zip(text, spans, strict=True):
            if t is None:
                out.append((None, 0, 0))
                continue
            lines = t.split("\n")
            word = [bool(x.encode("utf-8", "surrogatepass").split()) for x in lines]
            if s is None or not len(s):
                out.append((t, sum(word), 0))
                continue
            drop = {k for a in s for k in range(a["line"], a["last"] + 1) if word[k]}
            left = [x for k, x in enumerate(lines) if k not in drop]
            n = sum(word)
            out.append(("\n".join(left) if len(drop) < n else "", n, len(drop)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_removed"])

    # So marked, it is not called once more for each condition put on its result.
    made = joined.withColumn(done, cut.asNondeterministic()("text", spans))
    kept = [F.col(f"{done}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return made.select(*kept, f"{done}.n_lines", f"{done}.n_removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir).select("doc_id", "text"))


SQL = rf"""
WITH l AS (SELECT doc_id, x.t AS t, x.k AS k FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda t, k: {{'t': t, 'k': k - 1}})) AS x FROM documents)),
 n AS (SELECT doc_id, t, k, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i,
   len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w FROM l WHERE regexp_matches(t, '[^\x20\x09-\x0D]')),
 c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS cum FROM n),
 f AS (SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.i < a.i + {MIN_WORDS} AND b.cum - a.cum + a.w >= {MIN_WORDS} GROUP BY 1, 2),
 b AS (SELECT a.doc_id, max(b.i) AS s, a.i AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i <= a.i AND b.i > a.i - {MIN_WORDS} AND a.cum - b.cum + b.w >= {MIN_WORDS} GROUP BY 1, 3),
 r AS (SELECT 'f' AS kind, * FROM f UNION ALL SELECT 'b', * FROM b),
 t AS (SELECT kind, r.doc_id, s, e, string_agg(t, chr(10) ORDER BY i) AS x FROM r JOIN c ON r.doc_id = c.doc_id AND i BETWEEN s AND e GROUP BY 1, 2, 3, 4),
 o AS (SELECT doc_id, s, e, row_number() OVER (PARTITION BY kind, x ORDER BY doc_id, s) AS copy FROM t),
 g AS (SELECT DISTINCT n.doc_id, n.k FROM n JOIN o ON n.doc_id = o.doc_id AND n.i BETWEEN s AND e AND copy > 1),
 z AS (SELECT doc_id, count(*) AS n FROM n GROUP BY 1), y AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
 k AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY k) AS t FROM l ANTI JOIN g USING (doc_id, k) GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL WHEN y.n > 0 AND y.n = z.n THEN '' ELSE k.t END AS text,
  coalesce(z.n, 0)::BIGINT AS n_lines, coalesce(y.n, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN z USING (doc_id) LEFT JOIN y USING (doc_id) LEFT JOIN k USING (doc_id)
"""
