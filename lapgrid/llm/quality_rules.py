"""Quality rules with thresholds that adapt to each language and source.

Every document gets exact counts from built-in functions.  Ratios of those
counts, as integers in SCALE parts, go into mergeable histogram sketches: a
value keeps its BITS leading bits, so a quantile is at most 1/128 off, and two
sketches merge by adding counts.  Documents that fail the base rule are left
out.  Repeated lines and words are absent from most texts, so their sketches
hold only documents that have some.

A group's quartiles are those of its own sketch and of its language's, weighted
by size: a group of n documents counts n, its language BLEND, and the language
itself is blended with everything in the same way, so small groups lean on
larger ones smoothly.  Fences lie SPREAD interquartile ranges outside the
quartiles; no value of them is fixed.  A count breaks its fence only by more than
ERRORS standard errors of a count of that size, so a single hit in a
text proves nothing where the quartiles are zero, and copies that fill a source
don't make outliers of its other texts.  The fences are joined back.

Nulls: a null text has no words and fails the base rule; null languages and
sources are groups of their own.  Texts of any length are counted whole.  Repeated
rows and ties count as often as they occur.  An empty table gives an empty
result.  Columns of the input other than doc_id, text, lang and source are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch, documents

#: metric -> (numerator, denominator, scale of the ratio, whether only documents with some count, whether there is a lower fence).
METRICS = {
    "symbols": ("n_symbols", "word_chars", 1_000_000, False, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1_000_000, True, False),
    "repeats": ("n_repeat_words", "n_words", 1_000_000, True, False),
    "word_length": ("word_chars", "n_words", 1_000, False, True),
}
BITS = 8
BLEND = 100
SPREAD = 6
ERRORS = 4


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text.  Arrays are bound by one-element transforms, so each is built once."""
    stats = F.expr(r"""
      transform(array(struct(coalesce(text, '') AS t)), d ->
        transform(array(struct(array_remove(split(d.t, '[\\x20\\x09-\\x0D]+'), '') AS w)), x ->
          named_struct(
            'n_words', cast(size(x.w) AS bigint),
            'word_chars', cast(length(array_join(x.w, '')) AS bigint),
            'n_symbols', cast(length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '')) AS bigint),
            'lines', transform(array(filter(split(d.t, '\n'), l -> l RLIKE '[^\\x20\\x09-\\x0D]')), l ->
              struct(cast(size(l) AS bigint) AS n, cast(size(l) - size(array_distinct(l)) AS bigint) AS dup))[0],
            'n_repeat_words', CASE WHEN size(x.w) < 4 THEN 0L ELSE
              transform(array(transform(sequence(0, size(x.w) - 3), i -> xxhash64(x.w[i], x.w[i + 1], x.w[i + 2]))), h ->
                if(size(array_distinct(h)) = size(h), 0L,
                  transform(array(sort_array(transform(h, (v, i) -> struct(v AS h, i AS p)))), s ->
                    transform(array(array_sort(flatten(filter(
                        zip_with(s, slice(s, 2, size(s)), (a, b) -> if(a.h = b.h, array(a.p, b.p), NULL)),
                        y -> y IS NOT NULL)))), p ->
                      3L + aggregate(zip_with(slice(p, 1, size(p) - 1), slice(p, 2, size(p)), (a, b) -> least(3, b - a)),
                        0L, (acc, g) -> acc + g))[0])[0]))[0] END))[0])[0]
    """)
    return docs.select("doc_id", "lang", "source", stats.alias("s")).select(
        "doc_id", "lang", "source", "s.n_words", "s.word_chars", "s.n_symbols",
        F.col("s.lines.n").alias("n_lines"), F.col("s.lines.dup").alias("n_dup_lines"), "s.n_repeat_words",
    )


def bucket(value):
    """The value with all but its BITS leading bits cleared, and the smallest one beyond all that share them."""
    low = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    head = F.call_function("shiftright", value, low)
    return F.call_function("shiftleft", head, low).alias("bucket"), F.call_function("shiftleft", head + 1, low).alias("top")


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketch(stats: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, top, n): the mergeable sketches of all groups in one aggregation."""
    rows = F.array(*[
        F.when(F.col(a) > 0 if some else F.lit(True), F.struct(F.lit(m).alias("metric"), *bucket(F.expr(f"{a} * {scale} div greatest({b}, 1)"))))
        for m, (a, b, scale, some, _) in METRICS.items()
    ])
    return (
        stats.where(~base_failed()).select("lang", "source", F.explode(rows).alias("r")).where("r IS NOT NULL")
        .groupBy("lang", "source", "r.metric", "r.bucket", "r.top").agg(F.count("*").alias("n"))
    )


def quantiles(sketches: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Size and quartiles for each key and metric, from cumulative counts over its buckets (a few thousand at most); columns start with name."""
    merged = sketches.groupBy(*keys, "metric", "bucket", "top").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "metric")
    upto = F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    counted = merged.withColumn("upto", upto).withColumn("total", F.sum("n").over(w))
    return counted.groupBy(*[F.col(k).alias(f"{name}_{k}") for k in [*keys, "metric"]]).agg(
        F.max("total").alias(f"{name}_n"),
        *[F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col(edge))).alias(f"{name}_q{q}") for q, edge in ((1, "bucket"), (3, "top"))],
    )


def fences(stats_sketch: DataFrame, blend: int = BLEND, spread: int = SPREAD) -> DataFrame:
    """One row per (lang, source): hi_<metric>, and lo_<metric> where there is a lower fence."""
    own, lang, every = (quantiles(stats_sketch, keys, name) for keys, name in ((["lang", "source"], "o"), (["lang"], "l"), ([], "e")))
    j = (
        own.join(lang, F.col("o_lang").eqNullSafe(F.col("l_lang")) & (F.col("o_metric") == F.col("l_metric")))
        .join(every, F.col("o_metric") == F.col("e_metric"))
    )
    leaned = lambda n, q, larger: (F.col(n) * F.col(q) + blend * larger) / (F.col(n) + blend)
    q1, q3 = (leaned("o_n", f"o_q{q}", leaned("l_n", f"l_q{q}", F.col(f"e_q{q}"))) for q in (1, 3))
    j = j.select(F.col("o_lang").alias("lang"), F.col("o_source").alias("source"), F.col("o_metric").alias("metric"), q1.alias("q1"), q3.alias("q3"))
    aggs = []
    for m, (*_, lower) in METRICS.items():
        only = lambda c: F.max(F.when(F.col("metric") == m, c))  # noqa: B023, E731
        aggs.append(only(F.col("q3") + spread * (F.col("q3") - F.col("q1"))).alias(f"hi_{m}"))
        if lower:
            aggs.append(only(F.col("q1") - spread * (F.col("q3") - F.col("q1"))).alias(f"lo_{m}"))
    return j.groupBy("lang", "source").agg(*aggs)


def _breaks(errors: int) -> dict[str, str]:
    """metric -> SQL, for Spark and DuckDB alike, of whether a document is outside its fences."""
    out = {}
    for m, (a, b, scale, _, lower) in METRICS.items():
        at = lambda side: f"{side}_{m} * {b} / {scale}e0"  # noqa: B023, E731
        out[m] = f"{a} - {at('hi')} > {errors} * sqrt({at('hi')} + 1)"
        if lower:
            out[m] += f" OR {at('lo')} - {a} > {errors} * sqrt(greatest({at('lo')}, 0) + 1)"
        out[m] = f"coalesce({out[m]}, false)"
    return out


def quality_rules(docs: DataFrame, blend: int = BLEND, spread: int = SPREAD, errors: int = ERRORS) -> DataFrame:
    """Counts, base_failed, the names of the adaptive rules that a document breaks, and kept."""
    stats = Scratch(docs.sparkSession, "rules").table(text_stats(docs), "stats")
    limits = fences(sketch(stats), blend, spread).withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    joined = stats.join(limits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    broken = F.array_join(F.array(*[F.when(F.expr(bad), F.lit(m)) for m, bad in _breaks(errors).items()]), ",")
    out = joined.withColumn("base_failed", base_failed()).withColumn("broken", broken)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("broken") == "")).alias("kept"), "broken",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


_SQL_METRICS = "UNION ALL ".join(
    f"SELECT lang, source, '{m}' AS metric, {a} * {scale} // greatest({b}, 1) AS v FROM stats WHERE NOT base_failed {f'AND {a} > 0 ' if some else ''}"
    for m, (a, b, scale, some, _) in METRICS.items()
)
_LOW = f"greatest(length(bin(v)) - {BITS}, 0)"
_QUARTILES = f"count(*) AS n, quantile_disc((v >> {_LOW}) << {_LOW}, 0.25) AS q1, quantile_disc(((v >> {_LOW}) + 1) << {_LOW}, 0.75) AS q3"
_LEANED = ", ".join(f"(o.n * o.q{q} + {BLEND} * ((l.n * l.q{q} + {BLEND} * e.q{q}) / (l.n + {BLEND}))) / (o.n + {BLEND}) AS q{q}" for q in (1, 3))
_FENCES = ", ".join(
    f"max(q3 + {SPREAD} * (q3 - q1)) FILTER (metric = '{m}') AS hi_{m}" + (f", max(q1 - {SPREAD} * (q3 - q1)) FILTER (metric = '{m}') AS lo_{m}" if lower else "")
    for m, (*_, lower) in METRICS.items()
)
_BROKEN = ", ".join(f"CASE WHEN {bad} THEN '{m}' END" for m, bad in _breaks(ERRORS).items())
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 win AS (SELECT k, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c
   FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)),
 hit AS (SELECT k, p FROM (SELECT k, p, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM win) WHERE n > 1),
 rep AS (SELECT k, count(DISTINCT q) AS n FROM (SELECT k, unnest([p, p + 1, p + 2]) AS q FROM hit) GROUP BY k),
 ln AS (SELECT k, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM
   (SELECT k, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY k),
 stats AS (SELECT d.k, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(ln.n, 0) AS n_lines, coalesce(ln.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    (len(w) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(w)) AS base_failed
   FROM d LEFT JOIN ln USING (k) LEFT JOIN rep USING (k)),
 vals AS ({_SQL_METRICS}),
 e AS (SELECT metric, {_QUARTILES} FROM vals GROUP BY metric),
 l AS (SELECT lang, metric, {_QUARTILES} FROM vals GROUP BY lang, metric),
 o AS (SELECT lang, source, metric, {_QUARTILES} FROM vals GROUP BY lang, source, metric),
 f AS (SELECT o.lang, o.source, o.metric, {_LEANED}
   FROM o JOIN l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric JOIN e ON o.metric = e.metric),
 g AS (SELECT lang, source, {_FENCES} FROM f GROUP BY lang, source),
 r AS (SELECT stats.*, array_to_string(list_filter([{_BROKEN}], lambda x: x IS NOT NULL), ',') AS broken
   FROM stats LEFT JOIN g ON stats.lang IS NOT DISTINCT FROM g.lang AND stats.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken = '' AS kept, broken FROM r
"""
