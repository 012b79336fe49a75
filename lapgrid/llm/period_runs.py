r"""Periodic runs of words: a suffix automaton whose link tree is recoloured by link-cut access.

The link tree of the automaton holds every substring once; the strings that end
with word i are the path from the state of the prefix up to i to the root.
Reading the words in order, access(i) makes that path one preferred path with
colour i.  The segments it takes over carry the end of their last occurrence: a
segment of colour e whose longest string has n words says that those n words
also end at e.  Where the distance d = i - e is at most n this is a square, and
it reaches as far left as n does; where the next word breaks the period, the
stretch of n + d words up to i is a run, whose smallest period is d (a smaller
one would have given a later e).  Preferred paths are splay trees, so a text of
n words takes O(n log n) amortised steps, whatever it repeats.

A run has at least ``least`` words and ``times`` periods.  So each window of
``least * (times - 2) / times + 1`` words in it is found again one period further or
back; words in no such repeated window lie in no run, and the
automaton is built over each of the stretches that the others leave.

Words are what space and the ASCII controls 9 to 13 leave.  ``collapsed`` joins by one space the words that
lie in no run after its first period.

Texts are taken whole, each by itself in the task that read it: no shuffle, no hot key; memory is linear in the
longest text.  Null, empty or blank text: no words, no runs, an empty collapsed text.  Repeated
rows, ties and null doc_ids are handled each for itself.  An empty table gives an empty result.
Columns of the input named like a result are replaced, others keep their values.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import WORD, documents
from .spread import mapped, unused

LEAST = 24
TIMES = 3
_RUN = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
_STEP = 0x9E3779B97F4A7C15


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix link and longest length of each state (0 is the root, and no link), and the state of each prefix."""
    goes: list[dict[int, int]] = [{}]
    link, size, prefix, last = [-1], [0], [], 0
    for c in words:
        new = len(goes)
        goes.append({})
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in goes[p]:
            goes[p][c] = new
            p = link[p]
        if p < 0:
            link.append(0)
        else:
            q = goes[p][c]
            if size[q] == size[p] + 1:
                link.append(q)
            else:
                # q also stands for longer strings: the short ones get a state of their own.
                own = new + 1
                link.append(own)
                goes.append(goes[q].copy())
                size.append(size[p] + 1)
                link.append(link[q])
                link[q] = own
                while p >= 0 and goes[p].get(c) == q:
                    goes[p][c] = own
                    p = link[p]
        prefix.append(new)
        last = new
    link[0] = 0
    return link, size, prefix


class Paths:
    """A tree's preferred paths as splay trees in order of depth; each path has a colour, kept at the root of its splay tree."""

    def __init__(self, parent: list[int]):
        self.up, n = list(parent), len(parent)  # splay parent, or the tree parent of a path's top
        self.low, self.high, self.colour = [0] * n, [0] * n, [-1] * n

    def _rotate(self, x: int) -> None:
        up, low, high = self.up, self.low, self.high
        p = up[x]
        g = up[p]
        if low[p] == x:
            b = low[p] = high[x]
            high[x] = p
        else:
            b = high[p] = low[x]
            low[x] = p
        if b:
            up[b] = p
        up[p], up[x] = x, g
        if g:
            if low[g] == p:
                low[g] = x
            elif high[g] == p:
                high[g] = x
        self.colour[x] = self.colour[p]

    def splay(self, x: int) -> None:
        up, low, high = self.up, self.low, self.high
        while True:
            p = up[x]
            if not p or (low[p] != x and high[p] != x):
                return
            g = up[p]
            if g and (low[g] == p or high[g] == p):
                self._rotate(p if (low[g] == p) == (low[p] == x) else x)
            self._rotate(x)

    def access(self, v: int, colour: int) -> list[tuple[int, int]]:
        """Makes root to v one path of the colour; gives the deepest node and the colour of each path segment taken over."""
        up, high, colours = self.up, self.high, self.colour
        x, last, taken = v, 0, []
        while x:
            self.splay(x)
            old = colours[x]
            if old >= 0:
                taken.append((x, old))
            if deeper := high[x]:
                colours[deeper] = old
            high[x] = last
            last, x = x, up[x]
        self.splay(v)
        colours[v] = colour
        return taken


def runs_of(words: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    link, size, prefix = automaton(words)
    paths, n, out = Paths(link), len(words), []
    for i, state in enumerate(prefix):
        for x, end in paths.access(state, i):
            d, reach = i - end, size[x]
            if reach >= (times - 1) * d and reach + d >= least and (i + 1 == n or words[i + 1] != words[i + 1 - d]):
                out.append((i + 1 - reach - d, reach + d, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(words: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """(begin, end) of the stretches of at least ``least`` words that windows found more than once cover."""
    width, n = least * (times - 2) // times + 1, len(words)
    if n < least:
        return []
    codes = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(_STEP)
    codes ^= codes >> np.uint64(29)
    h = codes[: n - width + 1].copy()
    for j in range(1, width):
        h = h * np.uint64(_STEP) + codes[j : n - width + 1 + j]
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return []
    at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    begins = np.flatnonzero(twice[at] == h)
    cuts = np.flatnonzero(np.diff(begins) > width)
    first, last = begins[np.concatenate([[0], cuts + 1])], begins[np.append(cuts, len(begins) - 1)] + width
    return [(a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True) if b - a >= least]


def collapse(text: bytes, least: int = LEAST, times: int = TIMES) -> tuple[list[tuple[int, int, int]], bytes]:
    """The runs of a text, and its words outside the repeats of all runs."""
    words = text.split()
    if len(words) < least:
        return [], b" ".join(words)
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
    if len(number) == len(words):
        return [], b" ".join(words)
    runs = [(a + s, n, d) for a, b in stretches(ids, least, times) for s, n, d in runs_of(ids[a:b].tolist(), least, times)]
    if not runs:
        return [], b" ".join(words)
    keep = np.ones(len(words), dtype=bool)
    for s, n, d in runs:
        keep[s + d : s + n] = False
    return runs, b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def period_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The columns of docs, ``runs`` (array of start, length, period; word numbers from 0) and ``collapsed``.  times must be 2 or more."""
    if times < 2 or least < times:
        raise ValueError("a run has at least two periods")

    def work():
        def step(texts: pa.Array) -> list[pa.Array]:
            done = [collapse(t or b"", least, times) for t in texts.cast(pa.binary()).to_pylist()]
            flat = np.array([r for runs, _ in done for r in runs], dtype=np.int64).reshape(-1, 3)
            struct = pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], names=["start", "length", "period"])
            offsets = np.concatenate([[0], np.cumsum([len(runs) for runs, _ in done])]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), struct), pa.array([c for _, c in done], pa.binary()).cast(pa.string())]

        return step

    return mapped(docs, "text", {"runs": _RUN, "collapsed": T.StringType()}, work)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents, of which about a tenth, chosen by the crc32 of the doc_id, become periodic from some word on."""
    h, g, words = unused(docs, "h", "g", "words")
    crc = docs.withColumn(h, F.crc32(F.col("doc_id").cast("string").cast("binary")))
    cut = crc.withColumns({g: F.floor(F.col(h) / 10), words: F.when(F.col(h) % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))})
    n = F.size(words)
    a = F.col(g) % n
    p = 1 + F.floor((n - a) / (3 + F.col(g) % 8))
    word = lambda i: F.element_at(words, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int"))
    periodic = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")
    return cut.withColumn("text", F.when(n > 0, periodic).otherwise(F.col("text"))).drop(h, g, words)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period; of equal ones the first."""
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(runs, F.try_element_at(runs, F.lit(1)), lambda a, b: F.when(more(a, b), b).otherwise(a))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = period_runs(with_planted_runs(documents(spark, sf_dir).select("doc_id", "text")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    found = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("r"),
                       F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "r.start", "r.length", "r.period", F.expr("r.length * 1000 div r.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
