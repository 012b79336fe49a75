"""Edge cases, brute force and round trips.  Each operator meets nulls, empty and long texts, ties, repeats, an empty table and extra columns."""

import hashlib
import itertools
import math
import random
import re
import time
from collections import defaultdict

import pytest
from oracle import check
from pyspark.sql import functions as F

from lapgrid.llm.scratch import Scratch
from lapgrid.llm import chat_format, decontaminate, line_dedup, mixing, near_dup, pii, quality_rules, registry, resample, spread, toxicity, warc

COLS = "doc_id long, text string, lang string, source string, n_chars long, size long, s string, target double, th long, key string, words string"


def docs_of(spark, rows):
    """rows: (doc_id, text[, lang, source]); the other columns clash with names that operators use inside."""
    full = [(r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "a")), 1, 5, "x", 1.5, 7, "k", "w") for r in rows]
    return spark.createDataFrame(full, COLS)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    base = " ".join(f"v{i}" for i in range(120))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, base), (6, base), (6, base), (None, base), (7, base.replace("v60", "zz")), (8, "a b"), (9, "A  B"), (10, "é ü", None, None), (11, base, "en", None)]
    return docs_of(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLS)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, sf, name):
    check(registry.QUERIES[name](spark, sf), registry.SQL[name], sf)


# -- chat formatting -----------------------------------------------------------

def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\[INST]", "[", None, "", "<", "[/INST]\\</s>", "line\nline [TURN] x[SEP]", "x" * 50_000]
    roles = ["user", "assistant", "system", "tool", None]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(40) for t in range(rng.randint(1, 6))] + [(None, 1, "user", "x"), (50, None, "user", "b"), (50, None, "user", "a")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    out = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_chats(df)).collect()}
    assert len(out) == len({r[0] for r in rows})
    for c, got in out.items():
        mine = sorted([(-1 if t is None else t, r or "", x or "") for k, t, r, x in rows if k == c])
        assert got["n_turns"] == len(mine)
        assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert (got["loss_chars"], got["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_state_machine(spark):
    rows = [(1, 0, "user"), (1, 1, "assistant"), (2, 0, "assistant"), (3, 0, "user"), (3, 1, "user"), (4, 0, "system"), (4, 1, "user"), (4, 2, "assistant"), (5, 0, "user")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r["first_error"] for r in chat_format.format_chats(df).collect()}
    assert out == {1: None, 2: 0, 3: 1, 4: None, 5: 1}
    assert chat_format.format_chats(df.limit(0)).count() == 0


# -- near duplicates -----------------------------------------------------------

def brute_components(rows, share):
    sets, ids = [], []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
        ids.append(i)
    root = {i: i for i in ids if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if ids[a] is None or ids[b] is None or not sets[a] or not sets[b]:
                continue
            n = len(sets[a] & sets[b])
            if 100 * n >= share * len(sets[a] | sets[b]):
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return {i: find(i) for i in root}


def test_near_duplicates_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice((4, 30, 80, 160)))]
        for _ in range(rng.choice((1, 3, 25))):
            w = list(base)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(900, None), (901, ""), (None, rows[0][1]), (3, rows[3][1]), (3, rows[40][1])]
    out = near_dup.near_duplicates(docs_of(spark, rows), share=80).collect()
    want = brute_components(rows, 80)
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["component_id"] == r["doc_id"])


def test_near_duplicates_edges(spark, odd, empty):
    out = {r["doc_id"]: r for r in near_dup.near_duplicates(odd).collect()}
    assert out[8]["component_id"] == out[9]["component_id"] == 8 and out[7]["component_id"] == 5 and not out[6]["kept"]
    assert near_dup.near_duplicates(empty).count() == 0


def test_block_comparison_agrees_with_sets():
    import numpy as np

    rng = np.random.default_rng(1)
    a = [np.unique(rng.integers(0, 9000, rng.integers(1, 3000))) for _ in range(7)]
    b = [np.unique(rng.integers(0, 9000, rng.integers(1, 3000))) for _ in range(5)]
    assert (near_dup._shared(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


# -- toxicity ------------------------------------------------------------------

def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    held = F.abs(F.hash("doc_id")) % 5 == 0
    model = toxicity.train(docs, labels.where(~held))
    assert list(model[2]) == sorted(model[2])
    r = toxicity.score(docs, model).join(labels.where(held), "doc_id").groupBy().agg(
        F.avg(F.when(F.col("toxic") == 1, F.col("is_toxic").cast("int"))).alias("recall"), F.avg(F.when(F.col("toxic") == 0, F.col("is_toxic").cast("int"))).alias("false")).head()
    assert r["recall"] > 0.85 and r["false"] < 0.01


def test_toxicity_edges(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity(odd, labels).where("is_toxic").count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).count() == odd.count()
    assert toxicity.toxicity(empty, labels).count() == 0
    # Labelled texts without a feature: null, empty, blank, punctuation alone.
    bare = docs_of(spark, [(1, None), (2, ""), (3, " \n"), (4, "?! ..."), (5, "vile nasty " * 9), (6, "a fine day"), (6, "")] + [(i, f"vile nasty {i}") for i in range(10, 30)] + [(i, f"fine day {i}") for i in range(40, 90)])
    for toxic in ({1, 2, 3, 4}, {1, 3, 5, *range(10, 30)}, {2, 5}, set()):
        marked = spark.createDataFrame([(i, int(i in toxic)) for i in range(1, 90)], "doc_id long, toxic int")
        got = toxicity.toxicity(bare, marked).collect()
        assert len(got) == bare.count() and all(r["is_toxic"] is not None for r in got)
        if toxic >= set(range(10, 30)):
            assert {r["doc_id"] for r in got if r["is_toxic"]} >= set(range(10, 30)) and not any(r["is_toxic"] for r in got if r["doc_id"] >= 40)


def test_ordinal_fit_is_at_the_maximum():
    """The fitted model's numeric gradient is flat, its thresholds are in order, and a planted model is found again."""
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [{0: int(rng.integers(0, 6)), 1: int(rng.integers(0, 6)), 2: 50} for _ in range(3000)]
    eta = np.array([1.5 * math.log1p(x[0]) + 0.5 * math.log1p(x[1]) for x in rows])
    y = (rng.random(3000)[:, None] < 1 / (1 + np.exp(-(eta[:, None] - [1.0, 2.0, 3.0])))).sum(axis=1)
    w, theta = toxicity.fit_ordinal(rows, y, np.ones(3000), 3, l2=0.0, steps=2000, enough=1e-7)
    off = w[2] * math.log1p(50)
    assert list(theta) == sorted(theta) and w[0] == pytest.approx(1.5, abs=0.25) and w[1] == pytest.approx(0.5, abs=0.25)
    x = np.array([[math.log1p(r[k]) for k in range(3)] for r in rows])

    def loss(w, theta):
        up = np.hstack([np.ones((3000, 1)), 1 / (1 + np.exp(-((x @ w)[:, None] - theta))), np.zeros((3000, 1))])
        k = np.arange(3000)
        return -np.log(up[k, y] - up[k, y + 1]).mean()

    assert np.all(np.abs(np.array([1.0, 2.0, 3.0]) - (theta - off)) < 0.4)
    for i in range(3):
        for d in (-0.01, 0.01):
            assert loss(w, theta + d * (np.arange(3) == i)) > loss(w, theta) - 1e-5 and loss(w + d * (np.arange(3) == i), theta) > loss(w, theta) - 2e-5


def test_toxicity_scores_brute_force(spark):
    """p_toxic and the expected severity from the model's own numbers, over whole texts, split at ASCII spaces alone."""
    model = (["w:bad", "p:wor", "w:foo\u00a0bar"], [1.0, 0.5, 2.0, -0.1], [1.0, 1.5, 2.5])
    texts = ["bad Bad, (worse) word", "fine", None, "", "foo\u00a0bar foo bar", "x " * 400_000 + "bad", "bad " * 700, "w\u0130 BAD!"]
    out = {r["doc_id"]: r for r in toxicity.score(docs_of(spark, list(enumerate(texts))).withColumn("p_toxic", F.lit("own")), model).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        bare = [w.strip("".join(c for c in map(chr, range(33, 127)) if not c.isalnum())) for w in words]
        n = [sum(w == "bad" for w in bare), sum(w[:3] == "wor" and len(w) > 3 for w in bare), sum(w == "foo\u00a0bar" for w in bare), len(words)]
        eta = sum(a * math.log1p(b) for a, b in zip(model[1], n, strict=True))
        p = [1 / (1 + math.exp(-(eta - t))) for t in model[2]]
        assert (out[i]["p_toxic"], out[i]["expected_severity"]) == (pytest.approx(p[0], abs=1e-8), pytest.approx(sum(p), abs=1e-8)), i
        assert out[i]["is_toxic"] == (p[0] >= 0.5)


def test_toxicity_trains_once_on_a_repeated_document(spark):
    rows = [(1, f"foul{i % 3} text") for i in range(5000)] + [(10 + i, f"foul{i % 7} rude words") for i in range(40)] + [(100 + i, "kind words") for i in range(40)]
    labels = spark.createDataFrame([(1, 1)] * 1000 + [(i, int(i < 100)) for i in list(range(10, 50)) + list(range(100, 140))], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs_of(spark, rows), labels, 6000).collect()
    assert len(sample) == 81 and {r["fold"] for r in sample} == {0, 1}
    got = toxicity.toxicity(docs_of(spark, rows), labels).where("is_toxic").select("doc_id").distinct().collect()
    assert {r["doc_id"] for r in got} >= set(range(10, 50)) and not {r["doc_id"] for r in got} & set(range(100, 140))


# -- mixing --------------------------------------------------------------------

def water_fill(sizes):
    w = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    total, capped = 1.5 * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        level = (total - sum(2 * sizes[i] for i in capped)) / sum(w[i] for i in free)
        more = {i for i in free if level * w[i] > 2 * sizes[i]}
        if not more:
            return [2 * s if i in capped else level * w[i] for i, s in enumerate(sizes)]
        capped |= more


def test_mixing_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 300)), "en", rng.choice(["a", "b", "c", "é", "Z", None])) for i in range(600)] + [(1, None, "en", "a"), (2, "x y", "en", "b"), (2, "x y", "en", "b")]
    out = mixing.mix(docs_of(spark, rows)).collect()
    assert len(out) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, mixing.mix(docs_of(spark, rows)).collect()), key=repr)
    by = defaultdict(list)
    for r in out:
        by[r["source"]].append(r)
    names = sorted([s for s in by if s is not None]) + [None]
    want = water_fill([sum(r["size"] for r in by[s]) for s in names])
    for s, t in zip(names, want, strict=True):
        assert by[s][0]["target"] == pytest.approx(t)
        assert sum(r["taken"] for r in by[s]) == pytest.approx(t, rel=0.02)


def test_sainte_lague_quotients(spark):
    rng = random.Random(2)
    t = [rng.uniform(1, 5000) for _ in range(40)]
    total, block = sum(t), 37
    df = spark.createDataFrame([(i, 0, x) for i, x in enumerate(t)], "sid int, shard long, target double")
    got = {r["sid"]: r["quota"] for r in mixing.apportion(df, block, total, Scratch(spark, "test")).collect()}
    won = [0] * len(t)
    for _ in range(round(total / block)):
        i = max(range(len(t)), key=lambda i: t[i] / (2 * won[i] + 1))
        won[i] += 1
    assert got == dict(enumerate(won))


def test_mixing_edges(odd, empty):
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.mix(empty).count() == 0


# -- WARC ----------------------------------------------------------------------

def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u", "<p>é</p>"), (4, "u", "<p>é</p>"), (None, "u", "<p>é</p>"), (5, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 3000)]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, archive int, digest string").repartition(2)
    index, folder = warc.archive_pages(pages)
    out = warc.read_records(index, folder).collect()
    got = sorted([(r["page_id"], r["record_type"], r["refers_to"]) for r in out], key=repr)
    assert got == sorted([(1, "response", None), (2, "response", None), (3, "revisit", 2), (4, "revisit", 1), (4, "revisit", 1), (None, "revisit", 1), (5, "response", None)], key=repr)
    texts = {r["page_id"]: r["payload"].decode() for r in out if r["record_type"] == "response"}
    assert texts == {1: rows[0][2], 2: "", 5: rows[-1][2]}
    assert warc.archive_pages(pages.limit(0))[0].count() == 0


def test_warc_inflates_members_and_refuses_cuts():
    import io
    import zlib

    def member(b):
        z = zlib.compressobj(1, wbits=31)
        return z.compress(b) + z.flush()

    r = [warc._record("response", k, "u", b"x" * k, k, "D") for k in (1, 2, 300_000)]
    whole = member(r[0] + r[1]) + member(r[2])
    assert list(warc._records(warc._inflated(io.BytesIO(whole), "f"), "f")) == r
    with pytest.raises(ValueError):
        list(warc._records(warc._inflated(io.BytesIO(whole[:-20]), "f"), "f"))


# -- line dedup ----------------------------------------------------------------

def brute_lines(rows, least):
    """Removes every line of a run of at least so many words of which an equal run starts earlier."""
    seqs = {}
    for i, t in rows:
        seqs[i] = [(k, x) for k, x in enumerate((t or "").split("\n")) if x.split()]
    places = [(i, k) for i in sorted(seqs) for k in range(len(seqs[i]))]
    gone = set()
    for n, (i, k) in enumerate(places):
        for j, m in places[:n]:
            e = 0
            while k + e < len(seqs[i]) and m + e < len(seqs[j]) and seqs[i][k + e][1] == seqs[j][m + e][1]:
                e += 1
            if sum(len(x.split()) for _, x in seqs[i][k : k + e]) >= least:
                gone |= {(i, seqs[i][k + d][0]) for d in range(e)}
    return gone


def test_line_dedup_brute_force(spark):
    rng = random.Random(7)
    lines = [" ".join(f"l{i}w{k}" for k in range(rng.choice((1, 3, 9, 30)))) for i in range(9)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 9)))) for i in range(40)]
    out = {r["doc_id"]: r for r in line_dedup.line_dedup(docs_of(spark, rows), min_words=12).collect()}
    gone = brute_lines(rows, 12)
    for i, t in rows:
        parts = t.split("\n")
        left = [x for k, x in enumerate(parts) if (i, k) not in gone]
        some = any(x.split() for x in left) or not any(k == i for k, _ in gone)
        assert out[i]["text"] == ("\n".join(left) if some else ""), i
        assert out[i]["n_removed"] == sum(1 for a, _ in gone if a == i)


def test_line_dedup_edges(spark, odd, empty):
    out = line_dedup.line_dedup(odd).collect()
    assert len(out) == odd.count() and set(odd.columns) < set(out[0].asDict())
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r["text"])
    assert by[1] == [None] and by[5] == [""] and by[None][0].startswith("v0") and by[3] == [" \n\t "]
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_keeps_columns_of_any_name(spark):
    line = " ".join(f"w{i}" for i in range(60))
    cols = ["th", "cut", "g_id", "g_th", "_cut", "h", "g", "i", "line", "last", "spans", "done", "first", "many", "_part", "a.b", "n_lines", "TH2"]
    df = spark.createDataFrame([(i, f"own{i}\n{line}", *[f"{c}{i}" for c in cols]) for i in range(3)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in cols))
    out = {r["doc_id"]: r for r in line_dedup.line_dedup(df).collect()}
    assert [out[i]["text"] for i in range(3)] == [f"own0\n{line}", "own1", "own2"]
    for i in range(3):
        assert all(out[i][c] == f"{c}{i}" for c in cols if c != "n_lines") and (out[i]["n_lines"], out[i]["n_removed"]) == (2, int(i > 0))


def test_group_parts_give_whole_groups(spark):
    """A hot key's rows get the aggregates of the whole group, from any number of parts."""
    rows = [(("hot", "b", "c")[min(i % 100 // 90, 1) + (i % 1000 == 999)], i) for i in range(4000)] + [(None, 1)]
    df = spark.createDataFrame(rows, "k string, v long")
    out = spread.with_group(df, ["k"], ["v"], {"lo": (F.col("v"), "min"), "hi": (F.col("v"), "max"), "n": (F.lit(1), "sum")}, "n > 5").collect()
    for k in ("hot", "b"):
        mine = [v for x, v in rows if x == k]
        assert sorted(r["v"] for r in out if r["k"] == k) == mine and {(r["lo"], r["hi"], r["n"]) for r in out if r["k"] == k} == {(min(mine), max(mine), len(mine))}
    assert {r["k"] for r in out} == {"hot", "b"}


# -- personal data -------------------------------------------------------------

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_pii(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and luhn, 10 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_brute_force(spark, empty):
    rng = random.Random(11)
    alphabet = ["a", "Z", "@", ".", "-", "_", " ", "1", "0", "25", "4111 1111 1111 1111", "+1", "(", ")", "192.168.0.1", "\n", "é", "\U0001f600", "x@y.z"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["a.b@c_d@e.f", "1.2.3.4.5.6.7.8", "0" * 30_000, "a" * 30_000, "1 " * 20_000, "41111111 11111111-", None, ""]
    df = docs_of(spark, list(enumerate(texts)))
    for r in pii.find_pii(df).collect():
        got = [(b["s"], b["k"], b["e"]) for b in r["base"]]
        assert got == brute_pii(texts[r["doc_id"]] or ""), texts[r["doc_id"]]
        assert {(b["s"], b["k"], b["e"]) for b in r["spans"]} >= set(got)
    assert pii.find_pii(empty).count() == 0


def test_pii_learns_reliabilities(spark):
    rows = [(i, f"call phone (202) 555-01{i % 90 + 10} or mail user{i} (at) mail (dot) com and +1 (202) 555-01{i % 90 + 10}") for i in range(200)]
    out = pii.find_pii(docs_of(spark, rows)).collect()
    assert all(len(r["spans"]) > len(r["base"]) == 1 for r in out)


def test_pii_of_many_matches(spark):
    """100,000 addresses in one text, in linear time; places as Python finds them."""
    text = "x@y.zz +1 (202) 555-0112 " * 100_000
    began = time.time()
    r = pii.find_pii(docs_of(spark, [(1, text)])).selectExpr("size(base) AS n", "base[0] AS a", "base[199999] AS b", "aggregate(base, 0L, (a, x) -> a + x.s * 3L + x.e) AS sum").head()
    want = brute_pii(text)
    assert (r["n"], r["sum"]) == (len(want), sum(3 * s + e for s, _, e in want)) and (r["b"]["s"], r["b"]["k"], r["b"]["e"]) == want[-1]
    assert time.time() - began < 90


def test_pii_adds_only_what_meets_no_base_span(spark):
    rng = random.Random(13)
    parts = ["202-555-0112", "+1 202-555-0112", "joe (at) mail.com", "joe@mail.com", "1:2:3:4:5:6:7:8", "192.168.100.20", " ", "x", "call phone ", "mail: "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice((3, 12, 900)))) for _ in range(120)]
    df = docs_of(spark, list(enumerate(texts)))
    everything = {r["doc_id"]: r["spans"] for r in pii.candidates(df).collect()}
    counts = defaultdict(int)
    for spans in everything.values():
        for x in spans:
            counts[pii.KINDS[x["k"]], x["votes"]] += 1
    w = pii.fit_classifier(dict(counts), pii.fit_em(dict(counts)))
    p = lambda x: 1 / (1 + math.exp(-sum(w.get(f, 0.0) for f in pii.features(pii.KINDS[x["k"]], x["votes"]))))
    some = 0
    for r in pii.find_pii(df).collect():
        base = {(x["s"], x["k"], x["e"]) for x in everything[r["doc_id"]] if x["base"]}
        added = {(x["s"], x["k"], x["e"]) for x in everything[r["doc_id"]] if not x["base"] and p(x) >= pii.ADD}
        added = {c for c in added if not any(b[0] < c[2] and c[0] < b[2] for b in base)}
        assert {tuple(b) for b in r["base"]} == base and [tuple(x) for x in r["spans"]] == sorted(base | added)
        some += len(added)
    assert some


def test_pii_expectation_maximisation():
    """Posteriors found from votes alone are those of the rates that the votes were made with: right in 95, 90 and 60 of 100."""
    rates, counts, real_of = (0.95, 0.9, 0.6), {}, {}
    for real in (True, False):
        for right in itertools.product((True, False), repeat=3):
            n = math.prod(p if ok else 1 - p for p, ok in zip(rates, right, strict=True)) * 100_000
            votes = "".join("y" if ok == real else "n" for ok in right) + "-"
            counts["ip", votes] = counts.get(("ip", votes), 0) + n
            real_of[votes] = real_of.get(votes, 0) + (n if real else 0)
    post = pii.fit_em(counts)
    assert all(post[k, v] == pytest.approx(real_of[v] / counts[k, v], abs=0.05) for k, v in counts)
    looks = {(k, v + look): n / 2 for (k, v), n in counts.items() for look in ("mss", "xww")}
    assert all(pii.fit_em(looks)[k, v] == pytest.approx(post[k, v[:4]], abs=1e-6) for k, v in looks)
    # One hand-computed step of the posterior, by Bayes' rule from the start rates.
    one = pii.fit_em({("ip", "yyn-"): 1}, rounds=1)["ip", "yyn-"]
    real, fake = 0.5 * 0.6 * 0.6 * 0.15 * 0.25, 0.5 * 0.15 * 0.15 * 0.6 * 0.25
    assert one == pytest.approx(real / (real + fake))


# -- decontamination -----------------------------------------------------------

def test_tiling_catches_reordered_passages(spark, odd, empty):
    item = " ".join(f"b{i}" for i in range(40))
    w = item.split()
    shuffled = " ".join(["x"] * 9 + w[20:] + ["y"] * 5 + w[:20] + ["z"] * 9)
    half = " ".join(w[:15]) + " " + " ".join(f"c{i}" for i in range(50))
    bench = spark.createDataFrame([(1, item, "e"), (2, None, "e"), (3, "b0, b1", "e"), (4, item, "e"), (5, " ?! ", "e")], "item_id long, text string, doc_id string")
    docs = docs_of(spark, [(1, shuffled), (2, half), (3, item.upper().replace(" ", ", ")), (4, None), (None, item), (5, "b0 b1 b2"), (6, "first\nB0 (b1)\nlast")])
    for size in (decontaminate.BLOCK_BYTES, 100):
        got = {(r["doc_id"], r["item_id"]): (r["coverage"], r["n_tiles"]) for r in decontaminate.contaminated(docs, bench, block_bytes=size).collect()}
        assert got == {(d, i): c for i in (1, 4) for d, c in ((1, (1.0, 2)), (3, (1.0, 1)), (None, (1.0, 1)))} | {(6, 3): (1.0, 1)}
        left = decontaminate.clean(docs, bench, block_bytes=size)
        assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {2, 4, 5}
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.clean(odd, bench.limit(0)).count() == odd.count()


def test_blocks_are_within_their_size(spark):
    texts = [f"item {i} " + "x" * 50 for i in range(12)] + ["long " * 300] + ["same text"] * 500
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    blocks = [[r["text"] for r in b.collect()] for b in decontaminate._blocks(bench, 400)]
    assert sorted(t for b in blocks for t in b) == sorted(set(texts))
    assert all(len(b) == 1 or sum(map(len, b)) <= 400 for b in blocks)


def greedy_tiles(a, b, width=5):
    """Greedy string tiling straight from its definition."""
    used_a, used_b, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] >= 0 and i + n not in used_a and j + n not in used_b:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < width:
            return out
        out.append((i, j, n))
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))


def test_tiling_brute_force():
    import numpy as np

    rng = random.Random(4)
    for k in range(150):
        letters = rng.choice((1, 2, 4, 30))
        a, b = [rng.randrange(-(k % 2), letters) for _ in range(rng.randrange(45))], [rng.randrange(letters) for _ in range(rng.randrange(1, 25))]
        assert decontaminate.tile(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)) == greedy_tiles(a, b), (a, b)


def test_contamination_brute_force(spark):
    rng = random.Random(14)
    items = [" ".join(f"t{rng.randrange(12)}" for _ in range(rng.randrange(5, 25))) for _ in range(12)]
    texts = [" ".join(rng.choice([rng.choice(items), f"u{rng.randrange(9)}", f"t{rng.randrange(12)}"])[: rng.choice((9, 40, 999))] for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["coverage"], r["n_tiles"], r["longest"]) for r in decontaminate.contaminated(docs_of(spark, list(enumerate(texts))), bench).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            code = {w: k for k, w in enumerate(dict.fromkeys(x.split()))}
            tiles = greedy_tiles([code.get(w, -1) for w in t.split()], [code[w] for w in x.split()])
            c = sum(n for _, _, n in tiles) / len(x.split())
            if c >= decontaminate.COVERAGE:
                want[d, i] = (round(c, 6), len(tiles), max(n for _, _, n in tiles))
    assert got == want and want


def test_tiling_of_long_repetition(spark):
    """A text of 500,000 equal words against an item of 200."""
    bench = spark.createDataFrame([(1, "a " * 200), (2, "a b " * 3000)], "item_id long, text string")
    docs = docs_of(spark, [(1, "a " * 500_000), (2, "a b " * 250_000)])
    began = time.time()
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 1): 1.0, (2, 2): 1.0} and time.time() - began < 60


# -- importance resampling -----------------------------------------------------

def test_kth_largest(spark):
    rng = random.Random(8)
    v = [round(rng.gauss(0, 1), 2) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    for k in (1, 17, 1500, 2999, 3000, 5000):
        assert resample.kth_largest(df, "v", k, parts=8) == sorted(v, reverse=True)[min(k, 3000) - 1]
    assert resample.kth_largest(df.limit(0), "v", 3) is None


def test_resampling_prefers_good_documents(spark, odd, empty):
    """On labels that took no part in the fit."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    held = F.abs(F.hash("doc_id")) % 5 == 0
    out = resample.resample(spark.read.parquet(f"{d}/documents.parquet"), labels.where(~held))
    r = out.join(labels.where(held), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {x["quality"]: x["kept"] for x in r}
    assert kept[1] > 0.95 and kept[0] < 0.2
    assert resample.resample(odd, labels.limit(0)).count() == odd.count()
    assert resample.resample(empty, labels).count() == 0


def test_resampling_brute_force(spark):
    """Models, weights, Gumbel keys and the k largest, in plain Python; a long text weighs by all its n-grams."""
    rng = random.Random(12)
    good, bad = [f"g{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    texts = [" ".join(rng.choice(good if i % 3 else bad) for _ in range(rng.choice((1, 5, 40, 3000)))) for i in range(90)] + [None, "", "  "]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(45)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in resample.resample(docs_of(spark, list(enumerate(texts))), labels, share=0.4).collect()}

    def grams(t):
        w = [x.lower() for x in (t or "").split()]
        return [int(resample.ngrams(x)[0]) for x in w] + [int(resample.ngrams(f"{x} {y}")[2]) for x, y in zip(w, w[1:], strict=False)]

    raw, target = defaultdict(int), defaultdict(int)
    for i, t in enumerate(texts):
        for g in grams(t):
            raw[g] += 1
            target[g] += i < 45 and i % 3 > 0
    all_raw, all_target = sum(raw.values()) + resample.BUCKETS, sum(target.values()) + resample.BUCKETS
    u = {r["doc_id"]: r["u"] for r in spark.range(len(texts)).withColumnRenamed("id", "doc_id").selectExpr(
        "doc_id", f"(cast(shiftrightunsigned(xxhash64({resample.SEED}, doc_id), 12) AS double) + 0.5) / {1 << 52} AS u").collect()}
    for i, t in enumerate(texts):
        want = sum(math.log((target[g] + 1) / all_target) - math.log((raw[g] + 1) / all_raw) for g in grams(t))
        assert out[i]["log_weight"] == pytest.approx(want, abs=1e-6)
        assert out[i]["key"] == pytest.approx(want - math.log(-math.log(u[i])), abs=1e-6)
    k = round(0.4 * len(texts))
    assert {i for i in out if out[i]["kept"]} == set(sorted(out, key=lambda i: -out[i]["key"])[:k])


# -- quality rules -------------------------------------------------------------

def test_quality_rules_edges(spark, odd, empty):
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(odd).collect()}
    assert out[1]["n_words"] == 0 and out[1]["base_failed"] and not out[1]["kept"]
    assert out[4]["n_words"] == 30_000 and out[4]["n_repeat_words"] == 30_000
    assert out[5]["kept"] and out[10]["n_words"] == 1
    assert quality_rules.quality_rules(empty).count() == 0


def test_fences_adapt_to_the_source(spark):
    """The same text stays in a source where symbols are common and goes in one where they are not."""
    rng = random.Random(6)
    words = [f"word{i}" for i in range(400)]
    plain = lambda: " ".join(rng.choice(words) for _ in range(80))
    coded = lambda: " ".join(rng.choice(words) + ("#" if rng.random() < 0.4 else "") for _ in range(80))
    rows = [(i, plain(), "en", "prose") for i in range(600)] + [(1000 + i, coded(), "en", "code") for i in range(600)]
    same = " ".join(w + ("#" if k % 3 == 0 else "") for k, w in enumerate(rng.sample(words, 80)))
    one = " ".join(rng.sample(words, 80)) + "#"
    rows += [(2000, same, "en", "prose"), (2001, same, "en", "code"), (2002, one, "en", "prose"), (2003, same, None, None)]
    df = docs_of(spark, rows)
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(df, blend=10).collect()}
    assert not out[2000]["kept"] and out[2000]["broken"] == "symbols" and out[2001]["kept"]
    assert out[2002]["kept"], "one symbol is within the error of a count"
    assert all(out[r[0]]["kept"] for r in rows[:1200])
    f = {r["source"]: r for r in quality_rules.fences(quality_rules.sketch(quality_rules.text_stats(df))).collect()}
    assert f["prose"]["hi_symbols"] < f["code"]["hi_symbols"] and None in f


def test_most_fences_differ_between_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    f = quality_rules.fences(quality_rules.sketch(quality_rules.text_stats(docs))).collect()
    for c in ("hi_dup_lines", "hi_repeats", "hi_word_length", "lo_word_length"):
        assert len({r[c] for r in f}) > len(f) / 2, c


def test_quality_rules_separate_labelled_documents(spark):
    """Of documents that pass the base rule, the fences drop the bad ones and keep the good ones."""
    d = "/root/testdata/sf0.1"
    out = quality_rules.quality_rules(spark.read.parquet(f"{d}/documents.parquet")).where("NOT base_failed")
    kept = {r["quality"]: r["k"] for r in out.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[0] < 0.02 and kept[1] > 0.995


def test_sketches_merge(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    s = quality_rules.text_stats(docs)
    halves = [quality_rules.sketch(s.where(f"doc_id % 2 = {k}")) for k in (0, 1)]
    merged = halves[0].union(halves[1]).groupBy("lang", "source", "metric", "bucket", "top").agg(F.sum("n").alias("n"))
    assert merged.exceptAll(quality_rules.sketch(s)).count() == 0
