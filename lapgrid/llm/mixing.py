"""Mixing sources to target weights: Sainte-Lague apportionment of equal blocks of words.

Sources in code-point order (null last) weigh WEIGHTS in turn and share
SHARE of all words; a target stops at MOST times its source's size and the
excess is shared anew by weight.  The closed form: with sources ordered by
cap / weight, those are capped whose cap lies below the share left to them.

A source is cut by a hash of its documents into shards of about SHARD_WORDS words, so
a hot source spreads over many tasks.  Each shard is a tape of its documents in
seeded order, cut into blocks of BLOCK words (the last may be shorter).  All shards
compete for the blocks by the highest quotients target / (2 k + 1): two
divisors bound the seats of each, only those between are listed, and the last quotient that wins is found
by counting in ever finer ranges, not by a sort.  A shard whose quota is q of b blocks
takes each block q div b times and q mod b of them once more.  Which these are says a seeded
permutation, block -> (block * step + shift) mod b with step prime to b, so every
document knows from its own place how many of its words are taken, and no table of blocks is made.
No document exceeds MOST times its size.

Null or empty texts have size 0, take nothing and are kept in the result.
Repeated rows are documents of their own; order within a shard is by a seeded
hash of doc_id and text, then doc_id, then size.  Texts of any length are
counted whole.  Other columns are ignored, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import SPACE, Scratch, documents
from .spread import kth_largest

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SHARD_WORDS = 500_000
BLOCK = 32
SEED = 17
#: Steps of the permutation of blocks; primes, so that one divides a number of blocks only if it is a factor.
STEPS = (7919, 104729, 15485863)


def n_words(text):
    """How many words a text has, by counting its pieces between separators."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: sid, source, source_size, target."""
    every = Window.partitionBy()
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("sid") % len(weights) + 1).cast("long"))
    by_ratio = every.orderBy(F.col("source_size") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "all_size": F.sum("source_size").over(every), "all_w": F.sum("w").over(every),
        "before_size": F.coalesce(F.sum("source_size").over(by_ratio), F.lit(0)),
        "before_w": F.coalesce(F.sum("w").over(by_ratio), F.lit(0)),
    })
    left = (F.col("all_size") * F.lit(float(share)) - most * F.col("before_size")) * F.col("w")
    s = s.withColumn("capped", left > (most * F.col("source_size")) * (F.col("all_w") - F.col("before_w")))
    s = s.withColumns({
        "capped_size": F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))).over(every), F.lit(0)),
        "free_w": F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(every),
    })
    level = (F.col("all_size") * F.lit(float(share)) - most * F.col("capped_size")) / F.when(F.col("free_w") > 0, F.col("free_w"))
    target = F.when(F.col("capped"), (most * F.col("source_size")).cast("double")).otherwise(F.col("w") * level)
    return s.select("sid", "source", "source_size", target.alias("target"))


def apportion(shards: DataFrame, block: int, total: float, scratch: Scratch) -> DataFrame:
    """The shards with an integer quota of blocks each, by the highest quotients target / (2 k + 1); ties go by sid, then shard."""
    n = shards.count()
    seats = round(total / block)
    if not n or total <= 0:
        return shards.withColumn("quota", F.lit(0).cast("long"))
    # With divisor total / (seats - n) rounding hands out at most, with total / (seats + n) at least, the seats there are.
    low = F.floor(F.col("target") * max(seats - n, 0) / total + 0.5)
    high = F.floor(F.col("target") * (seats + n) / total + 0.5)
    s = shards.withColumns({"low": low, "high": high})
    open_seats = int(seats - (s.agg(F.sum("low")).head()[0] or 0))
    seat = F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("k")
    claims = s.where("high > low").select("sid", "shard", "target", seat).withColumn("quotient", F.col("target") / (2 * F.col("k") + 1))
    claims = scratch.table(claims.withColumn("place", -(F.col("sid") * F.lit(1 << 32) + F.col("shard"))), "claims")
    last = kth_largest(claims, "quotient", open_seats)
    if last is None:
        return s.withColumn("quota", F.col("low")).drop("low", "high")
    tied = claims.where(F.col("quotient") == last)
    last_place = kth_largest(tied, "place", open_seats - claims.where(F.col("quotient") > last).count())
    won = claims.where((F.col("quotient") > last) | ((F.col("quotient") == last) & (F.col("place") >= last_place)))
    extra = won.groupBy("sid", "shard").agg(F.count("*").alias("extra"))
    return s.join(extra, ["sid", "shard"], "left").withColumn("quota", F.col("low") + F.coalesce("extra", F.lit(0))).drop("low", "high", "extra")


def _number(*columns: Column | str) -> Column:
    """A number below 2^31 from the MD5 hash of the columns, as other engines have it too."""
    texts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("~")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts)), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit((1 << 31) - 1))


def _taken(block: int) -> str:
    """SQL for the words taken of a document at words [at, at + size) of a tape of b blocks with quota q."""
    step = f"CASE {' '.join(f'WHEN b % {p} <> 0 THEN {p}L' for p in STEPS[:-1])} ELSE {STEPS[-1]}L END"
    return f"""if(size = 0 OR quota IS NULL OR quota = 0, 0L, transform(array(struct((len + {block - 1}) div {block} AS b)), x ->
      transform(array({step.replace('b %', 'x.b %')}), step -> aggregate(sequence(at div {block}, (at + size - 1) div {block}), 0L, (a, k) -> a +
        (least(at + size, (k + 1) * {block}) - greatest(at, k * {block})) *
        (quota div x.b + if((k * step + shift) % x.b < quota % x.b, 1L, 0L))))[0])[0])"""


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document."""
    scratch = Scratch(docs.sparkSession, "mix")
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _number(F.lit(seed), "doc_id", "text").alias("h"))
    sized = scratch.table(sized, "sizes")
    sources = scratch.table(targets(sized, weights, share, most), "sources")
    total = sources.agg(F.sum("target")).head()[0] or 0.0

    cut = sources.withColumn("n_shards", F.expr(f"greatest(cast(ceil(source_size / {SHARD_WORDS}) AS int), 1)")).withColumnRenamed("source", "s_source")
    put = sized.join(cut, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source").withColumn("shard", F.col("h") % F.col("n_shards"))
    tape = Window.partitionBy("sid", "shard").orderBy("h", "doc_id", "size")
    put = put.withColumn("at", F.sum("size").over(tape.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    put = scratch.table(put, "tape")
    shards = put.groupBy("sid", "shard").agg(F.sum("size").alias("len"), (F.max("target") * F.sum("size") / F.max("source_size")).alias("target")).where("len > 0")
    quotas = apportion(shards, block, total, scratch).select(
        "sid", "shard", "len", F.expr(f"least(quota, {most} * ((len + {block - 1}) div {block}))").alias("quota"), _number(F.lit(seed), "sid", "shard").alias("shift"))
    quotas = scratch.table(quotas, "quotas")
    out = put.join(quotas, ["sid", "shard"], "left").select("doc_id", "source", "size", "source_size", "target", F.expr(_taken(block)).alias("taken"))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir).select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


_WEIGHT = "CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END"
_HASH = "(('0x' || substr(md5({}), 1, 8))::BIGINT & 2147483647)"
_STEP = f"CASE {' '.join(f'WHEN b % {p} <> 0 THEN {p}' for p in STEPS[:-1])} ELSE {STEPS[-1]} END"
SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
   {_HASH.format(f"concat_ws(':', '{SEED}', coalesce(doc_id::VARCHAR, '~'), coalesce(text, '~'))")} AS h FROM documents),
 s AS (SELECT *, {_WEIGHT} AS w FROM (SELECT source, sum(size)::BIGINT AS source_size,
   row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS sid FROM d GROUP BY source)),
 -- A source is capped if it is even when only those with a smaller size / weight are.
 c AS (SELECT a.sid, ({SHARE} * (SELECT sum(source_size) FROM s) - {MOST} * coalesce(sum(b.source_size), 0)) * any_value(a.w)
     > {MOST} * any_value(a.source_size) * ((SELECT sum(w) FROM s) - coalesce(sum(b.w), 0)) AS capped
   FROM s a LEFT JOIN s b ON (b.source_size / b.w, b.sid) < (a.source_size / a.w, a.sid) GROUP BY a.sid),
 t AS (SELECT s.*, CASE WHEN capped THEN ({MOST} * source_size)::DOUBLE ELSE w * (({SHARE}::DOUBLE * sum(source_size) OVER ()
   - {MOST} * coalesce(sum(source_size) FILTER (capped) OVER (), 0)) / sum(w) FILTER (NOT capped) OVER ()) END AS target FROM s JOIN c USING (sid)),
 p AS (SELECT doc_id, size, source_size, target, sid, h % greatest(ceil(source_size / {SHARD_WORDS})::INT, 1) AS shard, h
   FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
 q AS (SELECT *, sum(size) OVER (PARTITION BY sid, shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS pos FROM p),
 z AS (SELECT sid, shard, sum(size)::BIGINT AS len, max(target) * sum(size)::BIGINT / max(source_size) AS target FROM p GROUP BY ALL HAVING sum(size) > 0),
 seats AS (SELECT sid, shard, target / (2 * k + 1) AS quotient FROM (SELECT *, unnest(range(0, ({MOST} * len // {BLOCK} + 2)::BIGINT)) AS k FROM z)),
 won AS (SELECT sid, shard, count(*) AS n FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, sid, shard) AS place FROM seats)
   WHERE place <= (SELECT round(sum(target) / {BLOCK}) FROM t) GROUP BY ALL),
 g AS (SELECT z.sid, z.shard, (len + {BLOCK - 1}) // {BLOCK} AS b, least(coalesce(n, 0), {MOST} * ((len + {BLOCK - 1}) // {BLOCK})) AS quota,
   {_HASH.format(f"concat_ws(':', '{SEED}', z.sid::VARCHAR, z.shard::VARCHAR)")} AS shift FROM z LEFT JOIN won USING (sid, shard)),
 k AS (SELECT q.*, b, quota, shift, unnest(range(pos // {BLOCK}, (pos + size - 1) // {BLOCK} + 1)) AS k FROM q JOIN g USING (sid, shard) WHERE size > 0)
SELECT doc_id, size, source_size, target, sum((least(pos + size, (k + 1) * {BLOCK}) - greatest(pos, k * {BLOCK}))
   * (quota // b + CASE WHEN (k * ({_STEP}) + shift) % b < quota % b THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k GROUP BY doc_id, size, source_size, target, sid, shard, pos
UNION ALL SELECT doc_id, size, source_size, target, 0 FROM q WHERE size = 0
"""
