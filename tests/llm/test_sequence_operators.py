"""Period runs, conversation repair and BPE against their definitions, by brute force and the tokenizers library."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lapgrid.llm import bpe, conversation_repair, period_runs

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

WORD = r"[^\x20\x09-\x0D]+"
COLS = "doc_id long, text string, runs string, collapsed string, ids string, h int, `a.b` string, _source string"


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "r", "c", "i", 1, "dot", "s") for d, t in rows], COLS)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a b"), (5, "x " * 40_000), (6, "x y " * 30), (6, "x y " * 30), (None, "x y z " * 20), (7, "é ü " * 30), (8, "one  two\x0bthree " * 12)]


# -- period runs ---------------------------------------------------------------

def brute_runs(w, least=24, times=3):
    """Maximal stretches of each period, of which the smallest period counts."""
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, times * q) and not any(all(w[k] == w[k + d] for k in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "times"), [(24, 3), (6, 3), (2, 2), (12, 4)])
def test_runs_of_random_words(least, times):
    rng = random.Random(least)
    for _ in range(200):
        kinds, w = rng.choice([1, 2, 3, 30]), []
        while len(w) < rng.choice([5, 40, 120]):
            block = [rng.randrange(kinds) for _ in range(rng.randint(1, 9))]
            w += block * rng.choice([1, 1, 2, 3, 5, 9]) + [rng.randrange(kinds)] * rng.randint(0, 1)
        want = brute_runs(w, least, times)
        assert period_runs.runs_of(w, least, times) == want
        assert period_runs.collapse(" ".join(map(str, w)).encode(), least, times)[0] == want


def test_automaton_has_every_substring_once():
    rng = random.Random(9)
    for _ in range(50):
        w = [rng.randrange(3) for _ in range(rng.randint(1, 30))]
        link, size, prefix = period_runs.automaton(w)
        assert sum(size[v] - size[link[v]] for v in range(1, len(size))) == len({tuple(w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1)})
        assert [size[v] for v in prefix] == list(range(1, len(w) + 1))


def test_access_gives_last_occurrences():
    """Segments taken over by access(i), from longest to shortest, carry the last end of their suffixes before i."""
    rng = random.Random(4)
    for _ in range(40):
        w = [rng.randrange(2) for _ in range(rng.randint(1, 25))]
        link, size, prefix = period_runs.automaton(w)
        paths = period_runs.Paths(link)
        for i, state in enumerate(prefix):
            reach = dict((e, size[x]) for x, e in reversed(paths.access(state, i)))
            for n in range(1, i + 2):
                ends = [e for e in range(n - 1, i) if w[e - n + 1 : e + 1] == w[i - n + 1 : i + 1]]
                if ends:
                    assert reach[max(ends)] >= n


def brute_period_row(doc_id, text):
    w = re.findall(WORD, text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + size for s, size, q in runs)]
    milli = best[1] and 1000 * best[1] // best[2]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(kept)))


def test_period_query_by_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [r for r in ODD if r[0] != 5]
    for i in range(10, 260):
        block = [f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 12))]
        parts = [" ".join(block * rng.choice([1, 1, 3, 5])) for _ in range(rng.randint(1, 5))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    docs_of(spark, rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in period_runs.query(spark, str(tmp_path)).collect()), key=repr)
    want = sorted((brute_period_row(*r) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in want) > 60 and got == want


def test_period_query_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 4000").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in period_runs.query(spark, sf).collect()}
    assert all(got[d] == brute_period_row(d, t) for d, t in docs) and len(got) >= len(docs) > 50


def test_period_edges(spark):
    out = period_runs.period_runs(docs_of(spark, ODD))
    assert out.columns == ["doc_id", "text", "ids", "h", "a.b", "_source", "runs", "collapsed"]
    rows = out.collect()
    assert len(rows) == len(ODD) and all(r["a.b"] == "dot" and r["_source"] == "s" for r in rows)
    by = {(r["doc_id"]): r for r in rows}
    assert [by[i]["collapsed"] for i in (1, 2, 3, 4)] == ["", "", "", "a b"] and not any(by[i]["runs"] for i in (1, 2, 3, 4))
    assert [tuple(r) for r in by[5]["runs"]] == [(0, 40_000, 1)] and by[5]["collapsed"] == "x"
    assert [tuple(r) for r in by[6]["runs"]] == [(0, 60, 2)] and by[None]["collapsed"] == "x y z" and by[7]["collapsed"] == "é ü"
    assert period_runs.period_runs(docs_of(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError):
        period_runs.period_runs(docs_of(spark, ODD), times=1)


# -- conversation repair -------------------------------------------------------

def every_edit(initials, forced, extra):
    """The least (cost, audit) of all edit strings with at most two inserts in a row."""
    out = []

    def go(i, roles, cost, audit, inserted):
        if i == len(initials):
            if re.fullmatch("(s?(ua)+)?", roles):
                out.append((cost, audit))
        else:
            go(i + 1, roles, cost + 3, audit + "D", 0)
            if not forced[i]:
                go(i + 1, roles + initials[i], cost + extra[i], audit + "K", 0)
                for t in "ua":
                    go(i + 1, roles + t, cost + 2 + extra[i], audit + "R", 0)
        if inserted < 2:
            for t in "ua":
                go(i, roles + t, cost + 2, audit + "I", inserted + 1)

    go(0, "", 0, "", 0)
    return min(out)


def by_states(initials, forced, extra):
    """The same by the grammar's states, row by row."""
    def inserted(best):
        best = dict(best)
        for _ in range(3):
            for s, (c, a) in list(best.items()):
                t, new = 3 if s == 2 else 2, (c + 2, a + "I")
                best[t] = min(best.get(t, new), new)
        return best

    best = {0: (0, "")}
    for c, dead, more in zip(initials, forced, extra, strict=True):
        after = {}
        for s, (k, a) in inserted(best).items():
            t = 3 if s == 2 else 2
            ways = [(s, (k + 3, a + "D"))]
            if not dead:
                ways.append((t, (k + 2 + more, a + "R")))
                if c == ("a" if s == 2 else "u"):
                    ways.append((t, (k + more, a + "K")))
                if c == "s" and s == 0:
                    ways.append((1, (k + more, a + "K")))
            for x, v in ways:
                after[x] = min(after.get(x, v), v)
        best = after
    best = inserted(best)
    return min(best[x] for x in (0, 3) if x in best)


def random_rows(rng, most):
    initials = "".join(rng.choice(rng.choice(["suat", "ua", "uuuuua", "s", "a"])) for _ in range(rng.randint(0, most)))
    forced = [rng.random() < 0.2 for _ in initials]
    return initials, forced, [0 if f else int(rng.random() < 0.3) for f in forced]


def test_alignment_is_the_least_of_all_edits():
    rng = random.Random(1)
    for n in range(150):
        rows = random_rows(rng, 3 if n % 10 else 4)
        assert conversation_repair.align(*rows) == every_edit(*rows) == by_states(*rows), rows


@pytest.mark.parametrize("block", [1, 2, 3, 7, 256])
def test_alignment_in_blocks(monkeypatch, block):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(120):
        rows = random_rows(rng, 60)
        assert conversation_repair.align(*rows) == by_states(*rows), rows


def brute_repair(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *(" " if x is None else x for x in r[1:])))
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    seen, kind = set(), []
    for _, r, x in rows:
        last = re.sub(r"[\x20\x09-\x0D]+$", "", x)[-1:]
        kind.append("blank" if not re.search(WORD, x) else "duplicate" if (r, x) in seen else "" if last in ".!?" else "truncated")
        seen.add((r, x))
    initials = "".join(r[:1] or " " for _, r, _ in rows)
    cost, audit = by_states(initials, [k in ("blank", "duplicate") for k in kind], [int(k == "truncated") for k in kind])
    out, i = [], 0
    for op in audit:
        due = ("assistant" if out and out[-1][0][:1] == "u" else "user")
        if op != "D":
            out.append((due, "") if op == "I" else (due, rows[i][2]) if op == "R" else rows[i][1:])
        i += op != "I"
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kind.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, out)


def test_repair_by_brute_force(spark):
    rng = random.Random(6)
    texts = ["Yes.", "No", None, "", " \n", "Why? ", "end.\n\n", "é!", "x" * 100_000]
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(texts)) for c in [None, *range(80)] for _ in range(rng.randint(1, 9))]
    rows += [(81, t, ("user", "assistant")[t % 2], f"word {t}.") for t in range(700) if t % 13]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, turns string, first int")
    out = {r["conv_id"]: (*tuple(r)[1:-1], [tuple(t) for t in r["repaired"]]) for r in conversation_repair.repair(df).collect()}
    assert out == {c: brute_repair([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert conversation_repair.repair(df.limit(0)).count() == 0


def test_damage_and_query_on_edges(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Word {c} {t}. More!") for c in range(30) for t in range(6)] + [(None, None, None, None), (99, None, "user", None)]
    lone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((lone, 0, "user", "gone."))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for c in {r[0] for r in rows}:
        left = []
        for k, t, role, text in (r for r in rows if r[0] == c):
            role, text = role or " ", text or " "
            kind = zlib.crc32(f"{' ' if k is None else k}:{' ' if t is None else t}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            left += [(t, "user" if kind == 4 else role, text)] * ((kind != 0) + (kind == 3))
        *counts, out = brute_repair(left)
        want[c] = (*counts, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest())
    got = {r["conv_id"]: tuple(r)[1:] for r in conversation_repair.query(spark, str(tmp_path)).collect()}
    assert got == want and got[lone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# -- BPE -----------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load()


def same(vocabulary, encode, library, texts):
    for t, got in zip(texts, encode(texts), strict=True):
        ids = np.frombuffer(got, "<u4").tolist()
        assert ids == library.encode(t, add_special_tokens=False).ids, t
        assert vocabulary.decode(got) == library.decode(ids, skip_special_tokens=False) == t


def test_bpe_of_odd_texts(vocabulary, library):
    rng = random.Random(1)
    alphabet = [chr(c) for c in range(0x3000)] + list("aaaa    \n\n\t'''sdtmlrve<|endoftext|>") * 60 + ["<|endoftext|>", "\U0001e6c0", "՘", "֋", "\U0001246f", "\U00033000", "a" * 50, " " * 9] * 40
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    same(vocabulary, vocabulary.encoder(), library, texts + ["", "a" * 50_001, "ab" * 5000, "<|endoftext|>" * 3, " <|endoftext|> x", "x" * 200 + "\n" * 200])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_bpe_of_any_text(texts):
    library, v = test_bpe_of_any_text.tools
    same(v, v.encoder(), library, texts)


test_bpe_of_any_text.tools = (tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), bpe.load())


def test_later_letters_are_no_letters(vocabulary, library):
    """Code points that the two libraries class differently, at each end of their ranges."""
    encode = vocabulary.encoder()
    points = [int(x, 16) for r in bpe.LATER.split() for x in r.split("-")]
    same(vocabulary, encode, library, [f"a{chr(c)}b 1{chr(c)}2 .{chr(c)}, {chr(c)}" for c in points] + [chr(c + d) + "x" for c in points for d in (-1, 1)])


def test_bpe_decodes_any_ids(vocabulary, library):
    rng = random.Random(3)
    for _ in range(2000):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(0, 9))]
        assert vocabulary.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_bpe_memo_changes_nothing(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 40)
    rng = random.Random(5)
    encode = vocabulary.encoder()
    for _ in range(30):
        same(vocabulary, encode, library, [" ".join(f"word{rng.randrange(99)}," for _ in range(30)) for _ in range(3)])


def test_bpe_operator_and_query(spark, sf, library, tmp_path):
    docs = docs_of(spark, ODD)
    out = bpe.decode(bpe.encode(docs))
    assert out.columns == ["doc_id", "text", "runs", "collapsed", "h", "a.b", "_source", "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == len(ODD) and all(r["decoded"] == (r["text"] or "") and r["a.b"] == "dot" for r in rows)
    assert all(r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids for r in rows)
    assert bpe.digests(docs.limit(0)).count() == 0 and bpe.encode(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None,), ([1, None, 60_000],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(odd).collect()] == ["", '"']
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.query(spark, sf).collect()}
    for d, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect():
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[d] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.encode()))


def test_bpe_refuses_other_vocabularies(tmp_path):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.load(str(tmp_path / "v.json"))
    with pytest.raises(ValueError):
        bpe.load(public_tokenizers.path("word_bpe_49k.json"))
