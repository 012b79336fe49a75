import math
import random
import re

import corpus_pipeline as p
from oracle import check
from pyspark.sql import functions as F
from test_operators import brute_components, brute_lines, greedy_tiles

from lapgrid.llm import decontaminate, mixing, toxicity
from lapgrid.llm.scratch import documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, is_toxic boolean, n_removed string, `a.b` string"


def fixture(spark, folder):
    """documents with copies, repeated lines, toxic words, benchmark passages, ties, nulls and clashing names; labels and benchmark."""
    rng = random.Random(31)
    words = [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    footer, item = " ".join(f"footer{i}" for i in range(55)), " ".join(f"quiz{i}" for i in range(30))
    texts = [prose(rng.choice((8, 60, 150))) for _ in range(70)]
    texts += [prose(20) + " vile nasty " + prose(20) + " vile" for _ in range(25)]
    texts += [prose(30) + "\n" + footer + "\n" + prose(10) for _ in range(6)] + [footer, "\n" + footer + "\n"]
    texts += [prose(10) + " " + item + " " + prose(10), " ".join(item.split()[15:] + ["x"] + item.split()[:15]), item.upper()]
    texts += [texts[1], texts[3].replace("w1", "v1", 1), None, "", " \n"]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), None if t is None else len(t), "th", True, "n", "dot") for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, *rows[5][1:])]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(70 <= i < 90)) for i in range(95)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, prose(12))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def brute_toxic(text, model):
    names, w, theta = model
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    n = [sum(f in toxicity.features_of(x.encode()) for x in words) for f in names] + [len(words)]
    return sum(a * math.log1p(b) for a, b in zip(w, n, strict=True)) >= theta[0]


def brute_contaminated(text, items):
    for item in items:
        code = {x: k for k, x in enumerate(dict.fromkeys(item))}
        tiles = greedy_tiles([code.get(x.decode(), -1) for x in decontaminate.tokens(text)], [code[x] for x in item])
        if sum(n for _, _, n in tiles) >= decontaminate.COVERAGE * len(item):
            return True
    return False


def test_run_brute_force(spark, tmp_path):
    """Each stage in plain Python on what the one before it kept; the mix by SQL."""
    folder = f"file://{tmp_path}"
    docs = fixture(spark, folder)
    model = toxicity.train(docs.select("doc_id", "text"), documents(spark, folder, "labels").select("doc_id", "toxic"))
    rows = [tuple(r) for r in docs.collect()]
    rows = [r for r in rows if not brute_toxic(r[1], model)]
    assert len(rows) < docs.count() - 20

    # Null ids come first in line dedup; equal rows are one document there.
    key = lambda r: (-1 if r[0] is None else r[0])
    gone = brute_lines(sorted({(key(r), r[1]) for r in rows}, key=str), 50)
    cut = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        left = [x for k, x in enumerate(lines) if (key(r), k) not in gone]
        if len(left) == len(lines):
            cut.append(r)
        elif any(x.split() for x in left):
            text = "\n".join(left)
            cut.append((r[0], text, *r[2:4], len(text), *r[5:]))
    assert len(cut) < len(rows)

    component = brute_components([(r[0], r[1]) for r in cut], 80)
    one = [r for r in cut if r[0] is None or component[r[0]] == r[0]]
    one = list({r[0]: r for r in one if r[0] is not None}.values()) + [r for r in one if r[0] is None]
    assert len(one) < len(cut)

    items = [decontaminate.tokens(r["text"]) for r in documents(spark, folder, "benchmark").collect() if r["text"]]
    clean = [r for r in one if not brute_contaminated(r[1], [[x.decode() for x in i] for i in items])]
    assert len(clean) == len(one) - 3

    at = documents(spark, folder)
    for want, (name, stage) in zip((rows, cut, one, clean), p.STAGES[:-1], strict=True):
        at = stage(spark, at, folder)
        assert at.columns == docs.columns and sorted(map(tuple, at.collect()), key=repr) == sorted(want, key=repr), name
    at.write.parquet(f"{folder}/left/documents.parquet")
    mixed = p.run(spark, folder)
    assert mixed.count() == len(clean)
    check(mixed.select("doc_id", "size", "source_size", "target", "taken"), mixing.SQL, f"{tmp_path}/left", tables=["documents"])


def test_stages_keep_columns_and_shrink(spark, sf):
    docs = documents(spark, sf)
    n = docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == documents(spark, sf).columns, name
        assert docs.count() <= n
        n = docs.count()
    mixed = p.mix_sources(spark, docs, sf)
    assert mixed.count() == n and mixed.where("taken > 2 * size").count() == 0


def test_near_duplicate_stage_keeps_one(spark, sf):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text, "en", "a", 1), (2, text, "en", "b", 1), (3, text.replace("w40", "q"), "en", "b", 1), (4, "other words", "en", "a", 1), (4, "other words", "en", "a", 1), (None, text, "en", "a", 1), (5, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = sorted((r["doc_id"] for r in p.drop_near_duplicates(spark, docs, sf).collect()), key=repr)
    assert out == [1, 4, 5, None]


def test_lines_are_cut(spark, sf):
    line = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"own{i}\n{line}", "en", "a", 1) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r for r in p.drop_repeated_lines(spark, docs, sf).collect()}
    assert line in out[0]["text"] and out[3]["text"] == "own3" and out[3]["n_chars"] == 4


def test_empty_documents(spark, sf):
    docs = documents(spark, sf).where(F.lit(False))
    for _, stage in p.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_lines_are_cut_once(spark, sf):
    """The condition on cut texts doesn't call the cutting function anew, which would keep two more Python workers in each executor."""
    plan = p.drop_repeated_lines(spark, documents(spark, sf), sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1, plan
