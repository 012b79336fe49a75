r"""Personal data by weak supervision, in built-in functions.

Base spans are the leftmost matches of four patterns that pass their checks.
Look-behinds and possessive loops keep the patterns linear on long runs without
changing what they match.  Looser patterns add candidates: obfuscated
addresses, IPv6, phone numbers without a plus, digit runs that fail the checks.

Labelers vote yes, no or nothing on every candidate: the strict pattern and its
checks, a gazetteer (top-level domains, issuer prefixes, address ranges), the
words before the span, and its layout.  Vote patterns are counted by kind and by
the look of the span, three letters for its length and the characters around
it; these counts, at most 4 x 3^4 x 4^3 rows, are what reaches the driver.  On them
expectation-maximisation estimates each labeler's reliability from the votes,
and a logistic span classifier is trained on the expected labels, with kind, votes and look
as features, so that it judges by more than the votes.  It is then applied as a
column expression.  Base spans always stay; a looser one is added
if the classifier gives it ADD or more and it meets no base span.

Work is linear in the matches of a text: places and overlaps come from running
sums and maxima, built in pieces of PIECE (an array that grows one by one is copied each time).

Offsets are code points, ends exclusive.  A null text is empty.  Repeated rows
get the same result.  An empty table gives an empty result.  Columns beyond doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, documents

KINDS = ("email", "ip", "card", "phone")
ADD = 0.7
ROUNDS = 50
PIECE = 256

STRICT = {
    "email": r"(?=[A-Za-z0-9._%+-])(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9A-Fa-f])(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?=[(0-9])(?<![0-9+])(?<![0-9][\x20().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\x20.-]?[0-9])",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_LUHN = r"""aggregate(transform(split(reverse(regexp_replace(m, '[^0-9]', '')), ''), (u, i) ->
  if(i % 2 = 0, cast(u AS int), cast(u AS int) * 2 - if(cast(u AS int) > 4, 9, 0))), 0, (a, x) -> a + x) % 10 = 0"""
_DIGITS = "length(regexp_replace(m, '[^0-9]', ''))"
#: A base match is dropped unless this holds.
CHECKS = {
    "email": "true",
    "ip": rf"m RLIKE '^{_PART}(?:\\.{_PART}){{3}}$'",
    "card": f"{_DIGITS} BETWEEN 14 AND 19 AND {_LUHN}",
    "phone": f"{_DIGITS} BETWEEN 10 AND 15",
}
#: kind -> (votes yes, votes no) for each labeler; over m, the matched text, and before, the characters ahead of it in lower case.
GAZETTEER = {
    "email": (r"lower(m) RLIKE '[.)\\]]\\s?(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$'", r"lower(m) RLIKE '\\.(?:png|jpg|gif|js|css)$'"),
    "ip": (r"m RLIKE '^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\\.'", r"m RLIKE '^0' OR m RLIKE '^[0-9]\\.[0-9]\\.[0-9]\\.[0-9]$'"),
    "card": (r"regexp_replace(m, '[^0-9]', '') RLIKE '^(?:4|5[1-5]|2[2-7]|3[47]|6)'", r"regexp_replace(m, '[^0-9]', '') RLIKE '^[017]'"),
    "phone": (r"m RLIKE '^\\+(?:1|3[0-4]|39|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])'", r"m RLIKE '^\\(?[01]'"),
}
CONTEXT = {
    "email": (r"before RLIKE '(?:mail|contact|kontakt|correo|write|:)\\W*$'", r"before RLIKE '(?:version|git|ssh)\\W*$'"),
    "ip": (r"before RLIKE '(?:\\bip|address|host|server|from|login)\\W*$'", r"before RLIKE '(?:version|section|release|\\bv|chapter)\\W*$'"),
    "card": (r"before RLIKE '(?:card|visa|master|amex|account|iban|karte|carte|tarjeta)\\W*$'", r"before RLIKE '(?:order|isbn|token|serial|number|\\bid|=)\\W*$'"),
    "phone": (r"before RLIKE '(?:phone|tel|call|mobile|fax|contact|telefon)\\W*$'", r"before RLIKE '(?:order|isbn|serial|version|\\bid)\\W*$'"),
}
LAYOUT = {
    "email": (r"length(m) BETWEEN 6 AND 80", r"length(m) > 200"),
    "ip": (r"length(m) >= 11", r"length(m) < 8"),
    "card": (r"m RLIKE '^[0-9]{4}([ -]?)[0-9]{4}\\1[0-9]{4}\\1[0-9]{2,4}$'", rf"m RLIKE '^([0-9])\\1+$' OR {_DIGITS} < 13"),
    "phone": (r"m RLIKE '[ ().-]'", rf"m RLIKE '([0-9])\\1{{5}}'"),
}
LABELERS = ("strict", "gazetteer", "context", "layout")


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _before(values: str, zero: str, step: str) -> str:
    """SQL for an array of ints: of all values before each, the sum or whatever else ``step`` makes of (a, x) from zero."""
    grown = f"concat(r, array(aggregate(array(x), element_at(r, -1), (a, x) -> {step})))"
    return f"""transform(array({values}), v ->
      transform(array(transform(sequence(0, greatest(size(v) - 1, 0) div {PIECE}), j -> slice(v, j * {PIECE} + 1, {PIECE}))), pieces ->
        transform(array(aggregate(transform(pieces, p -> aggregate(p, {zero}, (a, x) -> {step})), array({zero}), (r, x) -> {grown})), heads ->
          flatten(zip_with(pieces, slice(heads, 1, size(pieces)), (p, h) -> slice(aggregate(p, array(h), (r, x) -> {grown}), 1, size(p)))))[0])[0])[0]"""


def _matches(pattern: str, gate: str) -> str:
    """SQL for all matches of a pattern in d.t, from the matches and the gaps around them: array of (s, e, m, before, after).

    ``before`` is the text ahead of the match, at most 24 characters and no further back than the start of the match before it,
    in lower case; ``after`` the next character.  Both come from the gaps, as each substring of a whole text would be sought from its start.
    """
    p = _sql(pattern)
    ends = _before("zip_with(slice(f.g, 1, size(f.m)), f.m, (g, m) -> length(g) + length(m))", "0", "a + x")
    return f"""if({gate}, transform(array(struct(split(d.t, {p}, -1) AS g, regexp_extract_all(d.t, {p}, 0) AS m)), f ->
        transform(zip_with(f.m, {ends}, (m, at) -> struct(m AS m, at AS at)), (x, i) -> struct(
          x.at + length(f.g[i]) AS s, x.at + length(f.g[i]) + length(x.m) AS e, x.m AS m,
          lower(right(concat(coalesce(get(f.m, i - 1), ''), f.g[i]), 24)) AS before,
          left(concat(left(f.g[i + 1], 1), left(coalesce(get(f.m, i + 1), ''), 1)), 1) AS after)))[0],
      cast(array() AS array<struct<s: int, e: int, m: string, before: string, after: string>>))"""


#: Letters for the length of m and for the characters before and after it.
LOOK = r"""concat(
  CASE WHEN length(m) < 10 THEN 's' WHEN length(m) < 16 THEN 'm' WHEN length(m) < 24 THEN 'l' ELSE 'x' END,
  CASE WHEN before = '' OR before RLIKE '\\s$' THEN 's' WHEN before RLIKE '[\\p{L}\\p{N}]$' THEN 'w' WHEN before RLIKE '[:=#]$' THEN 'k' ELSE 'p' END,
  CASE WHEN after = '' OR after RLIKE '^\\s' THEN 's' WHEN after RLIKE '^[\\p{L}\\p{N}]' THEN 'w' WHEN after RLIKE '^[.,;]' THEN 'e' ELSE 'p' END)"""


def _vote(yes: str, no: str) -> str:
    return f"(CASE WHEN {no} THEN 'n' WHEN {yes} THEN 'y' ELSE '-' END)"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (s, e, kind number, base, votes), votes one letter for each labeler, then the look."""
    gates = {
        ("email", True): "contains(d.t, '@')", ("email", False): "d.t RLIKE '[\\\\[(]at[\\\\])]'",
        ("phone", True): "contains(d.t, '+')", ("ip", False): f"contains(d.t, ':') AND d.t RLIKE {_sql(LOOSE['ip'])}",
    }
    lists = []
    for k, kind in enumerate(KINDS):
        for strict, pattern in ((True, STRICT[kind]), (False, LOOSE.get(kind))):
            if pattern is None:
                continue
            found = _matches(pattern, gates.get((kind, strict), f"d.t RLIKE {_sql(pattern)}"))
            check = CHECKS[kind] if strict else "false"
            own = f"if({check}, 'y', '{'n' if strict else '-'}')"
            votes = ", ".join([own] + [_vote(*group[kind]) for group in (GAZETTEER, CONTEXT, LAYOUT)])
            lists.append(f"""transform({found}, c -> transform(array(c.m), m -> transform(array(c.before), before -> transform(array(c.after), after ->
                struct(c.s AS s, c.e AS e, {k} AS k, {check} AS base, concat({votes}, {LOOK}) AS votes))[0])[0])[0])""")
    every = f"transform(array(struct(coalesce(text, '') AS t)), d -> flatten(array({', '.join(lists)})))[0]"
    return docs.select("doc_id", F.expr(every).alias("spans"))


def fit_em(counts: dict[tuple[str, str], int], rounds: int = ROUNDS):
    """Dawid-Skene on counted vote patterns, by kind.  counts: (kind, votes and look) -> n.  Gives P(real) for each pattern, by its votes alone."""
    given, counts = counts, {}
    for (k, v), n in given.items():
        counts[k, v[: len(LABELERS)]] = counts.get((k, v[: len(LABELERS)]), 0) + n
    prior = dict.fromkeys({k for k, _ in counts}, 0.5)
    # P(vote | real) and P(vote | not), started in favour of the labelers.
    rate = {(k, i, real): {"y": 0.6 if real else 0.15, "n": 0.15 if real else 0.6, "-": 0.25} for k in prior for i in range(len(LABELERS)) for real in (True, False)}
    post = {}
    for _ in range(rounds):
        for (k, v), _n in counts.items():
            a = math.log(prior[k]) + sum(math.log(rate[k, i, True][x]) for i, x in enumerate(v))
            b = math.log(1 - prior[k]) + sum(math.log(rate[k, i, False][x]) for i, x in enumerate(v))
            post[k, v] = 1 / (1 + math.exp(min(b - a, 500)))
        for k in prior:
            mine = [(v, n, post[kk, v]) for (kk, v), n in counts.items() if kk == k]
            total = sum(n for _, n, _ in mine)
            prior[k] = (sum(n * p for _, n, p in mine) + 1) / (total + 2)
            for i in range(len(LABELERS)):
                for real in (True, False):
                    w = {x: (2.0 if (x == "y") == real and x != "-" else 1.0) for x in "yn-"}
                    for v, n, p in mine:
                        w[v[i]] += n * (p if real else 1 - p)
                    rate[k, i, real] = {x: c / sum(w.values()) for x, c in w.items()}
    return {(k, v): post[k, v[: len(LABELERS)]] for k, v in given}


def features(kind: str, votes: str) -> list[str]:
    """The kind, the votes, and the look both alone and with the kind."""
    look = [f"{i}:{x}" for i, x in enumerate(votes[len(LABELERS):])]
    return ["1", f"k:{kind}"] + [f"{name}:{x}" for name, x in zip(LABELERS, votes, strict=False) if x != "-"] + look + [f"{kind}:{x}" for x in look]


def fit_classifier(counts: dict[tuple[str, str], int], post: dict, steps: int = 300, rate: float = 0.5) -> dict[str, float]:
    """Logistic regression of the expected labels on kind and votes, weighted by how often a pattern occurs."""
    w: dict[str, float] = {}
    total = sum(counts.values())
    for _ in range(steps):
        g: dict[str, float] = {}
        for (k, v), n in sorted(counts.items()):
            fs = features(k, v)
            err = n / total * (1 / (1 + math.exp(-sum(w.get(f, 0.0) for f in fs))) - post[k, v])
            for f in fs:
                g[f] = g.get(f, 0.0) + err
        for f, x in g.items():
            w[f] = w.get(f, 0.0) - rate * (x + 1e-3 * w.get(f, 0.0))
    return w


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of base spans in order) and spans (those and the added ones), each (s, kind number, e)."""
    found = Scratch(docs.sparkSession, "pii").table(candidates(docs), "spans")
    patterns = found.where("size(spans) > 0").select(F.explode("spans").alias("x")).groupBy("x.k", "x.votes").agg(F.count("*").alias("n")).collect()
    counts = {(KINDS[r["k"]], r["votes"]): r["n"] for r in patterns}
    w = fit_classifier(counts, fit_em(counts)) if counts else {}
    yes = {kv for kv in counts if 1 / (1 + math.exp(-sum(w.get(f, 0.0) for f in features(*kv)))) >= ADD}
    added = F.create_map(*[F.lit(x) for k, v in sorted(yes) for x in (f"{KINDS.index(k)}{v}", True)]) if yes else None
    pick = "transform(filter(spans, x -> {}), x -> struct(x.s AS s, x.k AS k, x.e AS e))"
    base = F.expr(f"sort_array({pick.format('x.base')})")
    if added is None:
        return found.select("doc_id", base.alias("base"), base.alias("spans"))
    # In order of starts, a candidate meets a base span if one before it ends later than it starts, or one after it starts before it ends.
    none = 2**31 - 1
    more = pick.format("NOT x.base AND try_element_at(yes, concat(x.k, x.votes)) IS NOT NULL")
    both = "sort_array(concat(transform(base, b -> struct(b.s AS s, b.e AS e, true AS base, b.k AS k)), transform(more, c -> struct(c.s AS s, c.e AS e, false AS base, c.k AS k))))"
    ends = _before("transform(z, x -> if(x.base, x.e, 0))", "0", "greatest(a, x)")
    starts = "reverse(" + _before(f"reverse(transform(z, x -> if(x.base, x.s, {none})))", str(none), "least(a, x)") + ")"
    alone = f"""transform(array({both}), z -> transform(filter(
        zip_with(z, zip_with({ends}, {starts}, (e, s) -> struct(e, s)), (x, n) -> if(x.base OR n.e > x.s OR n.s < x.e, NULL, x)),
        x -> x IS NOT NULL), x -> struct(x.s AS s, x.k AS k, x.e AS e)))[0]"""
    out = found.select("doc_id", "spans", base.alias("base"), added.alias("yes")).select("doc_id", "base", F.expr(more).alias("more"))
    spans = f"CASE WHEN size(more) = 0 THEN base WHEN size(base) = 0 THEN sort_array(array_distinct(more)) ELSE sort_array(array_distinct(concat(base, {alone}))) END"
    return out.select("doc_id", "base", F.expr(spans).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir).select("doc_id", "text"))
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    joined = lambda c: F.expr(f"array_join(transform({c}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')")
    return found.select(
        "doc_id", *[F.expr(f"cast(size(filter(base, x -> x.k = {k})) AS bigint)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
