r"""BPE encoding and decoding: merge rounds over many words at once, in flat numpy arrays.

A text is cut at special tokens, then at white space, then into words by the vocabulary's byte-level
pattern.  Words not met before by the task are encoded together: the symbols of
all of them lie in one flat array; each round looks up every adjacent pair by
binary search in the sorted pair keys (left * size + right), takes each word's
lowest rank, and replaces all of that word's pairs of this rank at once, from
the left where they overlap.  Words without a pair leave the array.  A trained
vocabulary makes a token before any merge that uses it, so a round equals the
usual one-by-one merging.  Decoding joins the tokens' bytes and reads them as
UTF-8, with U+FFFD for what is none.

The vocabulary is a tokenizers JSON file (byte-level BPE without normaliser,
prefix space or dropout; anything else is refused), read on the driver; its
tables are bounded by the file and travel with the job.  Truncation and padding
of the file are not applied.  Rows keep their place: no shuffle, so no hot key;
a task holds one batch of rows, at most SLICE characters (or one text) in work,
and memos of at most MEMO words and pieces (or those of one slice), which are caches and change no result.

Null or empty text: no ids, decoded to an empty text.  Null ids decode to an empty
text, unknown ids to nothing.  Repeated rows, ties and null doc_ids are encoded each for
itself; very long texts and words are encoded whole (a word with many different pairs takes as
many rounds).  An empty table gives an empty result.  Columns of the input named like a result
are replaced, others keep their values.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .scratch import documents
from .spread import mapped

#: White space and what follows it up to the next white space.  No word of PATTERN reaches over such a unit's end, or looks further.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_UNIT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
SLICE = 1_000_000
MEMO = 600_000
VOCABULARY = "byte_bpe_50k.json"
# The byte-level pattern, and letters and numbers (first to last) that this regex module knows but the
# Unicode version of the tokenizers library does not.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
LATER = (
    "558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1 ab6c-ab6d "
    "107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f 12475-1247f 12550-12686 "
    "16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 "
    "1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff "
    "2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where printable, else the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Sorted pair keys with rank and merged id of each, byte symbols, bytes of each id, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True) or spec["normalizer"] or odd:
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        ids, chars = model["vocab"], byte_characters()
        byte_of = {c: b for b, c in enumerate(chars)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has special tokens with conditions")
        self.size = 1 + max([*ids.values(), *self.special.values()])
        self.tokens = [b""] * self.size
        for t, i in ids.items():
            self.tokens[i] = bytes(byte_of[c] for c in t)
        for t, i in self.special.items():
            self.tokens[i] = t.encode()
        self.symbols = np.array([ids[c] for c in chars], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], dtype=np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)  # by rank
        self.ranks = np.argsort(keys, kind="stable")
        self.keys = keys[self.ranks]

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        none = len(self.merged)
        flat = self.symbols[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_ids, done_words = [], []
        while len(flat):
            key = flat[:-1] * self.size + flat[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(flat), none)
            rank[:-1] = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], none)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(flat))))
            ended = low == none
            if ended.any():
                done_ids.append(flat[ended])
                done_words.append(word[ended])
                flat, word, rank, low = flat[~ended], word[~ended], rank[~ended], low[~ended]
            hits = np.flatnonzero(rank == low)
            if len(hits):
                # Of overlapping pairs (a a a) every second one, from the left.
                n = np.arange(len(hits))
                run = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(hits) != 1]), n, 0))
                hits = hits[(n - run) % 2 == 0]
                flat[hits] = self.merged[rank[hits]]
                flat, word = np.delete(flat, hits + 1), np.delete(word, hits + 1)
        if not done_ids:
            return [b""] * len(words)
        ids, word = np.concatenate(done_ids).astype("<u4"), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        data, ends = ids[order].tobytes(), 4 * np.cumsum(np.bincount(word, minlength=len(words)))
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encoder(self) -> Callable[[list[str]], list[bytes]]:
        """A function from texts to their ids as bytes, with a memo of its own."""
        later = "".join(f"\\U{int(a, 16):08x}-\\U{int(b, 16):08x}" for a, b in (r.split("-") for r in LATER.split()))
        plain, newer = regex.compile(PATTERN), regex.compile(f"[{later}]")
        exact = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{later}])").replace(r"\p{L}++", rf"(?:(?![{later}])\p{{L}})++").replace(r"\p{N}++", rf"(?:(?![{later}])\p{{N}})++"))
        special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        marks = {t: i.to_bytes(4, "little") for t, i in self.special.items()}
        memo: dict[str, bytes] = {}  # of units and of words

        def words_of(unit: str) -> list[str]:
            return (plain if unit.isascii() or not newer.search(unit) else exact).findall(unit)

        def learn(new: set[str]) -> None:
            """Adds units to the memo, by way of their words; one of letters alone after a blank is a word."""
            whole = {u for u in new if u.isalpha() or (u[0] == " " and u[1:].isalpha())}
            cut = {u: words_of(u) for u in new - whole}
            words = list((whole | set(chain.from_iterable(cut.values()))) - memo.keys())
            memo.update(zip(words, self.merge_words([w.encode() for w in words]), strict=True))
            for u, w in cut.items():
                memo[u] = b"".join(map(memo.__getitem__, w))

        def encode(texts: list[str]) -> list[bytes]:
            cut = [special.split(t) if special else [t] for t in texts]  # ordinary text at even places, special tokens between
            found = [[_UNIT.findall(p) if i % 2 == 0 else p for i, p in enumerate(parts)] for parts in cut]
            new = set().union(*(u for parts in found for u in parts[::2])) - memo.keys()
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = set().union(*(u for parts in found for u in parts[::2]))
            learn(new)
            return [b"".join(marks[u] if i % 2 else b"".join(map(memo.__getitem__, u)) for i, u in enumerate(parts)) for parts in found]

        return encode

    def decode(self, ids: bytes) -> str:
        n = np.frombuffer(ids, dtype="<u4")
        return b"".join([self.tokens[i] for i in n[n < self.size].tolist()]).decode("utf-8", "replace")


def load(path: str | None = None) -> Vocabulary:
    """The vocabulary at a path; without one, that of the public tokenizers installed beside Spark."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return Vocabulary(path)


def _slices(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in order, at most SLICE characters or one text at a time; null reads as empty."""
    some, size = [], 0
    for t in texts:
        t = t or ""
        if some and size + len(t) > SLICE:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of docs and ``ids``, an array of integers."""
    vocabulary = load(path)

    def work():
        encoder = vocabulary.encoder()

        def step(texts: pa.Array) -> list[pa.Array]:
            got = [e for some in _slices(texts.to_pylist()) for e in encoder(some)]
            offsets = np.concatenate([[0], np.cumsum([len(g) // 4 for g in got])]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(got), dtype="<u4").astype(np.int32)))]

        return step

    return mapped(docs, "text", {"ids": T.ArrayType(T.IntegerType())}, work)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of tokens, which have ``ids``, and ``decoded``."""
    vocabulary = load(path)
    work = lambda: lambda ids: [pa.array([vocabulary.decode(np.array([i for i in x or () if i is not None], dtype="<i4").tobytes()) for x in ids.to_pylist()], pa.string())]
    return mapped(tokens, "ids", {"decoded": T.StringType()}, work)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of docs, and n_tokens, ids_sha256 and decoded_sha256 of each text encoded and decoded again."""
    vocabulary = load(path)

    def work():
        encoder = vocabulary.encoder()

        def step(texts: pa.Array) -> list[pa.Array]:
            rows = []
            for some in _slices(texts.to_pylist()):
                for e in encoder(some):
                    rows.append((len(e) // 4, hashlib.sha256(e).hexdigest(), hashlib.sha256(vocabulary.decode(e).encode()).hexdigest()))
            n, ids, back = zip(*rows, strict=True) if rows else ((), (), ())
            return [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]

        return step

    return mapped(docs, "text", {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}, work)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
