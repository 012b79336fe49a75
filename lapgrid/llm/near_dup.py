"""MinHash near-duplicates: a Hamming join of b-bit signatures over several indexes, then exact confirmation.

A document's set is its distinct five-word shingles (lower-cased A-Z; with
fewer words, the whole sequence; without words nothing), as 64-bit hashes.  Equal sets
form classes first, so copies cost one row each and meet no join.  A signature
keeps 16 bits of each of 4 * CHUNKS minima.  It is split into CHUNKS parts of
four symbols: two signatures that differ in at most 2 * CHUNKS - 1 symbols
have, by the pigeonhole principle, a part with at most one error.  Each part is
therefore indexed four times, each time with another symbol left out, which
enumerates the errors allowed in a part and finds every such pair.

Pairs are confirmed on full sets, and never listed for a whole bucket at once:
the members of a bucket first meet its smallest member, the hub; with the
components so far, hubs whose members are one component are closed; the members
of the others are compared block by block inside tasks, only between components
and within the signature distance, by signatures alone at first; full sets travel
only with members that have such a partner, and only links that connect something new
are emitted.  Components come from repeated
propagation of the smallest id with pointer jumping, in written rounds.

A null or empty text has no set and is linked with nothing.  Rows with the same
doc_id are one document: it is linked if any of its rows is.  A row without
doc_id keeps component_id null and is kept.  An empty table gives an empty result.
Very long texts are hashed whole, one at a time.  Columns beyond doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, documents

SHINGLE = 5
CHUNKS = 8
LANES = 4
BLOCK = 1024
#: Hashes of full sets in a block, about; one larger set is a block's whole content at most once.
HASHES = 1 << 19
SLICE = 128
_RNG = np.random.Generator(np.random.PCG64(20240229))
_ADD = _RNG.integers(0, 2**64, (64 * LANES, 1), dtype=np.uint64)
_MUL = _RNG.integers(0, 2**64, (64 * LANES, 1), dtype=np.uint64) | np.uint64(1)
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = 0x0001000100010001


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = min(width, len(words))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(words) - w + 1
    out = _mix(h[:n] + np.uint64(w))
    for j in range(1, w):
        out = _mix(out * _C1 + h[j : n + j])
    return np.unique(out)


def signature(s: np.ndarray, chunks: int) -> np.ndarray:
    """``chunks`` integers of four 16-bit symbols each."""
    k = chunks * LANES
    low = np.full(k, np.uint64(2**64 - 1))
    for i in range(0, len(s), 4096):
        m = (s[None, i : i + 4096] ^ _ADD[:k]) * _MUL[:k]
        m ^= m >> np.uint64(29)
        low = np.minimum(low, (m * _C2).min(axis=1))
    sym = _mix(low) & np.uint64(0xFFFF)
    return (sym.reshape(chunks, LANES) << (np.arange(LANES, dtype=np.uint64) * np.uint64(16))).sum(axis=1, dtype=np.uint64)


def signatures(docs: DataFrame, chunks: int, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, two fingerprints of the set, and the signature."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A slice of texts at a time, so that a batch is not held as Python strings as well.
        for b in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            n, f1, f2, sigs = [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, width)
                n.append(len(s))
                f1.append(_mix(s + _C1).sum(dtype=np.uint64).view(np.int64))
                f2.append(_mix(s ^ _C3).sum(dtype=np.uint64).view(np.int64))
                sigs.append(signature(s, chunks).view(np.int64) if len(s) else np.zeros(0, dtype=np.int64))
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), _lists(sigs)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "f1", "f2", "sig"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(work, "doc_id long, n_shingles long, f1 long, f2 long, sig array<long>")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrays of 64-bit integers as one list column, without Python integers."""
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *arrays])))


def distance(a: Column, b: Column, chunks: int) -> Column:
    """Number of symbols in which two signatures differ."""
    total = F.lit(0)
    for i in range(chunks):
        x = a[i].bitwiseXOR(b[i])
        for s in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, s))
        total = total + F.bit_count(x.bitwiseAND(F.lit(_LOW)))
    return total


def buckets(reps: DataFrame, chunks: int) -> DataFrame:
    """(slot, key, doc_id): each signature in every index, with one symbol of one part left out."""
    keys = []
    for c in range(chunks):
        for i in range(LANES):
            mask = ((1 << 64) - 1) ^ (0xFFFF << (16 * i))
            keys.append(F.struct(F.lit(c * LANES + i).cast("short").alias("slot"), F.col("sig")[c].bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key")))
    return reps.select("doc_id", F.explode(F.array(*keys)).alias("k")).select("k.slot", "k.key", "doc_id")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, component_id) of every document in a link (a, b): the smallest id reachable."""
    edges = scratch.table(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    label = scratch.table(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("doc_id"), F.least("a", "m").alias("c")), "label")
    while True:
        seen = edges.join(label.select(F.col("doc_id").alias("b"), F.col("c").alias("cb")), "b").groupBy("a").agg(F.min("cb").alias("m"))
        near = label.join(seen, label["doc_id"] == seen["a"]).select("doc_id", "c", F.least("c", "m").alias("n"))
        # One jump: the label of the label.
        to = label.select(F.col("doc_id").alias("n"), F.col("c").alias("cn"))
        step = scratch.table(near.join(to, "n", "left").select("doc_id", F.least("n", F.coalesce("cn", "n")).alias("c"), F.col("c").alias("old")), "label")
        moved = step.where("c < old").limit(1).count()
        scratch.drop(label)
        label = step
        if not moved:
            scratch.drop(edges)
            return label.select("doc_id", F.col("c").alias("component_id"))


def open_groups(index: DataFrame, comps: DataFrame, sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """(hub, doc_id, c, blocks): for each hub with members of its buckets in different components c, all members, and how many blocks to deal
    them into, by their number and the sum of their sets (doc_id, n_shingles in ``sizes``).

    Buckets with one hub are mostly those of one family of texts, so a member is sent once for all of them.  Both sides of the
    last join are tables, not aggregates dealt by its key, so Spark may split a hub that holds a large share of the rows.
    """
    c = index.select("hub", "doc_id").distinct().join(comps, "doc_id", "left").join(sizes, "doc_id").select("hub", "doc_id", F.coalesce("component_id", "doc_id").alias("c"), "n_shingles")
    c = scratch.table(c, "members")
    spread = c.groupBy("hub").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("hashes"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("n > 2 AND lo < hi")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("hashes") / HASHES)).cast("int")
    return c.drop("n_shingles").join(scratch.table(spread.select("hub", blocks.alias("blocks")), "hubs"), "hub")


def _lanes(x: np.ndarray) -> np.ndarray:
    for s in (8, 4, 2, 1):
        x = x | (x >> np.uint64(s))
    return np.bitwise_count(x & np.uint64(_LOW))


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets, by products of 0/1 matrices over what both sides hold."""
    lv, rv = np.concatenate(left), np.concatenate(right)
    li, ri = np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right])
    common = np.intersect1d(lv, rv)
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    lc, rc = np.searchsorted(common, lv), np.searchsorted(common, rv)
    lo, ro = common[np.minimum(lc, len(common) - 1)] == lv, common[np.minimum(rc, len(common) - 1)] == rv
    lc, li, rc, ri = lc[lo], li[lo], rc[ro], ri[ro]
    ls, rs = np.argsort(lc, kind="stable"), np.argsort(rc, kind="stable")
    lc, li, rc, ri = lc[ls], li[ls], rc[rs], ri[rs]
    for at in range(0, len(common), 4096):
        (l0, l1), (r0, r1) = np.searchsorted(lc, [at, at + 4096]), np.searchsorted(rc, [at, at + 4096])
        a, b = np.zeros((len(left), 4096), dtype=np.float32), np.zeros((len(right), 4096), dtype=np.float32)
        a[li[l0:l1], lc[l0:l1] - at] = 1
        b[ri[r0:r1], rc[r0:r1] - at] = 1
        out += (a @ b.T).astype(np.int64)
    return out


def _dealt(rows: DataFrame) -> DataFrame:
    """Members of open groups, dealt by hash into blocks of about BLOCK rows and HASHES hashes; a member once for each pair of blocks (p, q) that it is in."""
    big = rows.withColumn("mine", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return big.withColumns({"p": F.least("mine", "other"), "q": F.greatest("mine", "other")}).drop("blocks", "other")


def _near(g: pd.DataFrame, limit: int):
    """Places of the two sides of a block pair, and pairs of them in different components, within the distance and without the hub."""
    hub, p, q = g["hub"].iloc[0], g["p"].iloc[0], g["q"].iloc[0]
    mine, ids, c = g["mine"].to_numpy(), g["doc_id"].to_numpy(), g["c"].to_numpy()
    x, y = np.flatnonzero((mine == p) & (ids != hub)), np.flatnonzero((mine == q) & (ids != hub))
    if not len(x) or not len(y):
        return x, y, np.zeros((0, 2), dtype=np.int64)
    sig = np.stack(g["sig"].to_numpy()).view(np.uint64)
    far = np.zeros((len(x), len(y)), dtype=np.uint16)
    for k in range(sig.shape[1]):
        far += _lanes(sig[x, k][:, None] ^ sig[y, k][None, :])
    todo = (far <= limit) & (c[x][:, None] != c[y][None, :])
    if p == q:
        todo &= ids[x][:, None] < ids[y][None, :]
    return x, y, np.argwhere(todo)


def block_links(rows: DataFrame, sigs: DataFrame, docs: DataFrame, limit: int, share: int, width: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) inside open groups, between components.

    Each pair of blocks is compared in one task's group, first by signature alone.  Only members with a partner within
    the distance go on, and only they bring their full sets along.  Of the links
    found there as many are given as connect the same documents.
    """
    key = ["hub", "p", "q"]

    def candidates(g: pd.DataFrame) -> pd.DataFrame:
        x, y, at = _near(g, limit)
        return g.iloc[np.unique(np.concatenate([x[at[:, 0]], y[at[:, 1]]]))][["hub", "p", "q", "mine", "doc_id", "c", "sig"]]

    # The rows are few bytes but much work, so their tasks are not merged by size.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = _dealt(rows.join(sigs.select("doc_id", "sig"), "doc_id")).repartition(tasks, *key)
    some = scratch.table(members.groupBy(*key).applyInPandas(candidates, "hub long, p int, q int, mine int, doc_id long, c long, sig array<long>"), "near")
    sets = scratch.table(full_sets(docs, some.select("doc_id"), width, scratch), "sets")

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("doc_id")
        x, y, at = _near(g, limit)
        if not len(at):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        ids, held = g["doc_id"].to_numpy(), [np.asarray(v) for v in g["s"]]
        sets = [[held[i] for i in x], [held[i] for i in y]]
        size = [np.array([len(v) for v in f]) for f in sets]
        if len(at) > 1000:
            both = _shared(*sets)[at[:, 0], at[:, 1]]
        else:
            both = np.array([len(np.intersect1d(sets[0][i], sets[1][j], assume_unique=True)) for i, j in at])
        at = at[100 * both >= share * (size[0][at[:, 0]] + size[1][at[:, 1]] - both)]
        root: dict = {}

        def find(v):
            while root.setdefault(v, v) != v:
                root[v] = v = root[root[v]]
            return v

        out = []
        for i, j in zip(ids[x[at[:, 0]]].tolist(), ids[y[at[:, 1]]].tolist(), strict=True):
            u, v = find(i), find(j)
            if u != v:
                root[max(u, v)] = min(u, v)
                out.append((i, j))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    found = some.join(sets, "doc_id").groupBy(*key).applyInPandas(compare, "a long, b long")
    out = scratch.table(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "more")
    scratch.drop(some, sets)
    return out


def full_sets(docs: DataFrame, ids: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(doc_id, s): the sorted set of each of the given documents, one row for each text.

    The ids are written first, so that Spark knows their true size when it chooses how to join; few are sent to the texts.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([shingle_set(t, width).view(np.int64) for t in b.column(1).to_pylist()])], names=["doc_id", "s"])

    wanted = scratch.table(ids.distinct(), "wanted")
    return docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").mapInArrow(sets, "doc_id long, s array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, share: int, scratch: Scratch, width: int = SHINGLE) -> DataFrame:
    """Of pairs (a, b) of documents, those with 100 * intersection >= share * union of their full sets, as a table."""
    table = scratch.table(full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), width, scratch), "sets")
    j = pairs.join(table.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b").join(table.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    j = j.select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).cast("long").alias("sizes"))
    out = scratch.table(j.where(100 * F.col("both") >= share * (F.col("sizes") - F.col("both"))).select("a", "b").distinct(), "links")
    scratch.drop(table)
    return out


def near_duplicates(docs: DataFrame, share: int = 80, chunks: int = CHUNKS + 2, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row; links join sets with 100 * intersection >= share * union."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    limit = 2 * chunks - 1  # the distance up to which the indexes find every pair
    sig = scratch.table(signatures(docs, chunks, width), "sig")
    live = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = scratch.table(live.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig")), "classes")
    reps = classes.select(F.col("rep").alias("doc_id"), "sig", "n_shingles")
    every = buckets(reps, chunks)
    hubs = every.groupBy("slot", "key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("far")).where("hub < far").drop("far")
    index = scratch.table(every.join(hubs, ["slot", "key"]), "index")

    pairs = index.where("hub < doc_id").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    s = reps.select("doc_id", "sig", "n_shingles")
    pairs = pairs.join(s.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb")), "b").join(s.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), "a")
    stars = scratch.table(pairs.where(distance(F.col("sa"), F.col("sb"), chunks) <= limit).select("a", "b"), "stars")
    links = confirmed(stars, docs, share, scratch, width)

    rows = scratch.table(open_groups(index, components(links, scratch), reps.select("doc_id", "n_shingles"), scratch), "open")
    scratch.drop(index, stars)
    more = block_links(rows, reps, docs, limit, share, width, scratch)
    scratch.drop(rows)

    # Rows that share a doc_id join the classes of their texts.
    twice = live.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    key = ["f1", "f2", "n_shingles"]
    same = live.join(twice, "doc_id").join(classes.select(*key, "rep"), key).select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b")).where("a < b")
    comps = components(links.union(more).union(same), scratch)

    of_class = classes.join(comps, classes["rep"] == comps["doc_id"], "left").select(*key, F.coalesce("component_id", "rep").alias("of_class")).where(
        (F.col("copies") > 1) | F.col("component_id").isNotNull())
    out = sig.join(of_class, key, "left")
    component = F.coalesce("of_class", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), share=85, chunks=CHUNKS)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= 85 * (x.n + y.n - common)),
 e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(m.b, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = d.doc_id
"""
