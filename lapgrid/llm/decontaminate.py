"""Benchmark decontamination by greedy string tiling, which also catches reordered passages.

Tokens are lower-cased words without ASCII punctuation, coded as numbers by the
benchmark's own vocabulary, so equal codes are equal tokens.  Seeds are
running (Karp-Rabin) hashes of five tokens; a document that shares enough seeds with a
benchmark item to cover it is compared with it.  The longest match between unmarked
tokens becomes a tile (of equally long ones the first in the document, then in
the item), its tokens are marked, and so on until none of five tokens is left.
The longest length is found by bisection over running hashes of the part of
the document that has seeds, and all tiles of that length are taken in one sweep, so pairs of
matching places are never listed, and a text that repeats one word costs no more than others.
A document contaminates an item if its tiles cover at least COVERAGE of the item's tokens, in any order.

Items travel to the documents, never the reverse: equal texts count as one
item, the benchmark is dealt by hash into blocks, whose number doubles until
the largest is within BLOCK_BYTES (or a single item), and each block is
one pass over all documents, whose result is written before the next begins.

An item of fewer than five tokens is met as a whole: by a document with a line of
just these tokens.  An item without tokens matches nothing.  Null texts hold no
tokens.  Repeated documents give repeated rows; repeated items give a row for
each item_id.  Empty tables on either side give an empty result.  Very long texts are tiled
whole, one at a time.  Finding reads only doc_id and text; ``clean`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, documents

SEED = 5
COVERAGE = 0.5
BLOCK_BYTES = 16 << 20
_PUNCTUATION = bytes.maketrans(string.punctuation.encode() + string.ascii_uppercase.encode(), b" " * len(string.punctuation) + string.ascii_lowercase.encode())
_MUL, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)
_MUL, _INVERSE = np.uint64(_MUL), np.uint64(pow(_MUL, -1, 2**64))


def tokens(text: str | bytes | None) -> list[bytes]:
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return raw.translate(_PUNCTUATION).split()


def running(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all prefixes of a list of codes, and the powers that take one prefix from another."""
    power = np.ones(len(codes) + 1, dtype=np.uint64)
    np.multiply.accumulate(np.full(len(codes), _MUL), out=power[1:])
    value = (codes.astype(np.uint64) + np.uint64(7)) * _MIX
    value = (value ^ (value >> np.uint64(32))) * _MIX
    # With p the inverse powers a prefix is a sum: sum(value[i] * p[i]); a window is a difference, scaled back.
    inverse = np.ones(len(codes) + 1, dtype=np.uint64)
    np.multiply.accumulate(np.full(len(codes), _INVERSE), out=inverse[1:])
    prefix = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(value * inverse[:-1], out=prefix[1:])
    return prefix, power


def windows(hashes: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """The hash of every window of n codes."""
    prefix, power = hashes
    if n >= len(prefix):
        return np.zeros(0, dtype=np.uint64)
    return (prefix[n:] - prefix[:-n]) * power[: len(prefix) - n]


def _free(marked: np.ndarray, n: int) -> np.ndarray:
    """Places from which n codes are unmarked."""
    used = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(used[n:] == used[:-n])


def tile(doc: np.ndarray, item: np.ndarray, width: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (document place, item place, length), longest first, without overlap on either side.  Negative codes match nothing."""
    doc_hash, item_hash = running(doc), running(item)
    doc_marked, item_marked, tiles = doc < 0, item < 0, []

    def shared(n: int):
        """Free places of windows of n codes that occur free on the other side too, with their hashes."""
        if n > min(len(doc), len(item)):
            return None
        d, i = _free(doc_marked, n), _free(item_marked, n)
        dh, ih = windows(doc_hash, n)[d], windows(item_hash, n)[i]
        there = np.isin(dh, ih)
        return (d[there], dh[there], i, ih) if there.any() else None

    most = len(item)
    while most >= width:
        low, high, found = width - 1, most, None  # a match of length low is there, or low is too short
        while low < high:
            mid = (low + high + 1) // 2
            if (hit := shared(mid)) is None:
                high = mid - 1
            else:
                low, found = mid, hit
        if found is None:
            break
        n, (d, dh, i, ih) = low, found
        order = np.argsort(ih, kind="stable")
        i, ih = i[order], ih[order]
        each = np.unique(dh)
        bounds = zip(np.searchsorted(ih, each, "left").tolist(), np.searchsorted(ih, each, "right").tolist(), strict=True)
        at = {h: list(span) for h, span in zip(each.tolist(), bounds, strict=True)}
        end = -1
        for place, h in zip(d.tolist(), dh.tolist(), strict=True):
            if place < end:
                continue
            span = at[h]
            while span[0] < span[1]:
                k = int(i[span[0]])
                span[0] += 1
                if not item_marked[k : k + n].any() and (doc[place : place + n] == item[k : k + n]).all():
                    tiles.append((place, k, n))
                    end = place + n
                    doc_marked[place:end] = item_marked[k : k + n] = True
                    break
        most = n - 1
    return tiles


class _Index:
    """The vocabulary and the seeds of a block of item texts."""

    def __init__(self, texts: list[str]):
        self.codes: dict[bytes, int] = {}
        self.items, self.short = [], {}
        seeds, owners = [], []
        for k, text in enumerate(texts):
            words = tokens(text)
            self.items.append(np.array([self.codes.setdefault(w, len(self.codes)) for w in words], dtype=np.int64))
            if 0 < len(words) < SEED:
                self.short.setdefault(tuple(words), []).append(k)
            h = windows(running(self.items[-1]), SEED)
            seeds.append(h)
            owners.append(np.full(len(h), k, dtype=np.int64))
        all_seeds, all_owners = np.concatenate([*seeds, np.zeros(0, np.uint64)]), np.concatenate([*owners, np.zeros(0, np.int64)])
        order = np.argsort(all_seeds, kind="stable")
        self.owners = all_owners[order]
        self.seeds, self.first = np.unique(all_seeds[order], return_index=True)
        self.last = np.append(self.first[1:], len(all_seeds))
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self.seeds >> np.uint64(44)] = True
        self.size = np.array([len(c) for c in self.items], dtype=np.int64)

    def tiles(self, text: str | None, coverage: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(item number, item length, tiles) of each item that the text may cover so much of."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = tokens(raw)
        if self.short:
            for line in {tuple(t) for x in raw.split(b"\n") if 0 < len(t := tokens(x)) < SEED}:
                for k in self.short.get(line, ()):
                    yield k, len(line), [(0, 0, len(line))]
        codes = np.fromiter(map(self.codes.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        in_five = np.cumsum(codes >= 0)
        whole = np.flatnonzero(in_five[SEED - 1 :] - np.concatenate([[0], in_five[:-SEED]]) == SEED) if len(codes) >= SEED else np.zeros(0, np.int64)
        if not len(whole):
            return
        h = windows(running(codes), SEED)[whole]
        some = self.maybe[h >> np.uint64(44)]
        whole, h = whole[some], h[some]
        place = np.searchsorted(self.seeds, h)
        known = self.seeds[np.minimum(place, len(self.seeds) - 1)] == h if len(self.seeds) else np.zeros(len(h), bool)
        whole, place = whole[known], np.unique(place[known])
        if not len(place):
            return
        # Each shared seed of an item covers five of its tokens at most.
        n = self.last[place] - self.first[place]
        owner = self.owners[np.repeat(self.first[place] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        items, hits = np.unique(owner, return_counts=True)
        near = np.zeros(len(codes) + 1, dtype=np.int64)
        np.add.at(near, whole, 1)
        np.add.at(near, whole + SEED, -1)
        inside = np.cumsum(near[:-1]) > 0
        # Only places with seeds can hold tiles; a mark stands between parts that aren't neighbours.
        part = np.where(inside, codes, -1)
        part = part[inside | np.concatenate([[False], inside[:-1]])]
        for k in items[hits * SEED >= coverage * self.size[items]].tolist():
            yield k, int(self.size[k]), tile(part, self.items[k])


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[DataFrame]:
    """The distinct item texts, in blocks within the given size or of one item."""
    items = benchmark.select("text").where("text IS NOT NULL").distinct()
    blocks = 1
    while True:
        block = F.pmod(F.xxhash64("text"), F.lit(blocks))
        held = items.groupBy(block.alias("b")).agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).collect()
        if all(r["n"] == 1 or r["bytes"] <= block_bytes for r in held):
            break
        blocks *= 2
    for r in sorted(held, key=lambda r: r["b"]) or [{"b": 0}]:
        yield items if blocks == 1 else items.where(block == r["b"])


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest) for each document and item that it covers enough."""
    spark = docs.sparkSession
    scratch, found = Scratch(spark, "tiles"), None
    schema = "doc_id long, item string, coverage double, n_tiles long, longest long"
    for block in _blocks(benchmark, block_bytes):
        texts = spark.sparkContext.broadcast([r["text"] for r in block.collect()])

        def work(batches: Iterator[pd.DataFrame], texts=texts) -> Iterator[pd.DataFrame]:
            index, names = _Index(texts.value), {}
            for b in batches:
                rows = []
                for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                    for k, n, tiles in index.tiles(text, coverage):
                        c = sum(t[2] for t in tiles) / n
                        if tiles and c >= coverage:
                            if k not in names:
                                names[k] = hashlib.md5(texts.value[k].encode("utf-8", "surrogatepass")).hexdigest()
                            rows.append((doc_id, names[k], round(c, 6), len(tiles), max(t[2] for t in tiles)))
                yield pd.DataFrame(rows, columns=["doc_id", "item", "coverage", "n_tiles", "longest"]).astype({"doc_id": "Int64"})

        part = scratch.table(docs.select("doc_id", "text").mapInPandas(work, schema), "found")
        texts.destroy()
        found = part if found is None else found.unionByName(part)
    ids = benchmark.select("item_id", F.md5("text").alias("item"))
    return found.join(ids, "item").select("doc_id", "item_id", "coverage", "n_tiles", "longest")


def _covers(texts, coverage: float):
    """A column function: whether a text covers one of the broadcast items enough."""
    index = []

    @F.pandas_udf("boolean")
    def covers(batch: pd.Series) -> pd.Series:
        if not index:
            index.append(_Index(texts.value))
        return pd.Series([any(tiles and sum(t[2] for t in tiles) / n >= coverage for _, n, tiles in index[0].tiles(text, coverage)) for text in batch], dtype=bool)

    return covers


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that cover no item enough, in one pass for each block and without a shuffle."""
    spark = docs.sparkSession
    scratch, blocks = Scratch(spark, "clean"), list(_blocks(benchmark, block_bytes))
    for n, block in enumerate(blocks):
        texts = spark.sparkContext.broadcast([r["text"] for r in block.collect()])
        left = docs.where(~_covers(texts, coverage)(F.col("text")))
        if n + 1 < len(blocks):
            # Written, so that one block at a time is held.
            left = scratch.table(left, "left")
            texts.destroy()
            if n:
                scratch.drop(docs)
        docs = left
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
