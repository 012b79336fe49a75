r"""Chat formatting: a state machine over roles, and segments with loss flags from a declarative template.

A template is data: for each role the text before and after a turn and whether
the turn's text counts for the loss; ``moves`` says which role may follow which.
Control strings inside texts are made harmless and stay recoverable: a
backslash is doubled, and a backslash goes after the first character of
each control string, so unescaping drops every backslash that leads another
character.  All of it is built-in functions.

Rows of a conversation are put in order by turn, then role, then text (nulls
first), so ties have one result.  A null role or text counts as empty; a role
that the template lacks is written with its name and breaks the state machine.
Null conversation ids form one conversation.  Conversations are formatted
whole, valid or not; ``first_error`` is the index of the first turn out of
order.  A conversation is one row here, as its digests need all of it; very long texts are
written whole.  An empty table gives an empty result.  Columns beyond the four, whatever their names, are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import documents

TEMPLATE = {
    "begin": "<s>",
    "roles": {
        "system": ("[SYS] ", " [/SYS]", False),
        "user": ("[INST] ", " [/INST]", False),
        "assistant": ("[ANS] ", "</s>", True),
    },
    "other": ("[TURN] ", "[SEP]", " [/TURN]"),
    "moves": {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
    "final": ["assistant"],
}


def controls(template: dict) -> list[str]:
    """Every string with a meaning of its own, without outer blanks."""
    marks = [template["begin"], *template["other"], *(m for r in template["roles"].values() for m in r[:2])]
    return list(dict.fromkeys(m.strip() for m in marks))


def escape(text: Column, template: dict) -> Column:
    starts = "|".join(re.escape(c).replace("/", "\\/") for c in controls(template))
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"(?s)(?={starts})(.)", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _segments(turn: Column, template: dict) -> Column:
    """Three (text, loss) segments of one turn."""
    role, body = turn["role"], escape(turn["text"], template)
    o, sep, c = template["other"]
    out = [F.concat(F.lit(o), escape(role, template), F.lit(sep)), F.lit(False), F.lit(c)]
    for name, (before, after, loss) in template["roles"].items():
        mine = role == name
        out = [F.when(mine, F.lit(v)).otherwise(x) for v, x in zip((before, loss, after), out, strict=True)]
    seg = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
    return F.array(seg(out[0], F.lit(False)), seg(body, out[1]), seg(out[2], F.lit(False)))


def first_error(roles: Column, template: dict) -> Column:
    """Index of the first turn that the state machine refuses; the number of turns if it stops in a state that is not final; else null."""
    pairs = [(f"{a}>{b}", b) for a, nexts in template["moves"].items() for b in nexts]
    moves = F.create_map(*[F.lit(x) for p in pairs for x in p])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("bad"))

    def step(s: Column, role: Column) -> Column:
        to = F.try_element_at(moves, F.concat(s["state"], F.lit(">"), role))
        bad = F.coalesce(s["bad"], F.when(to.isNull(), s["i"]))
        return F.struct(F.coalesce(to, role).alias("state"), (s["i"] + 1).alias("i"), bad.alias("bad"))

    end = lambda s: F.coalesce(s["bad"], F.when(~s["state"].isin(template["final"]), s["i"]))
    return F.aggregate(roles, start, step, end)


def format_chats(rows: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, valid, first_error, segments (array of text and loss) and formatted, one row per conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    begin = F.array(F.struct(F.lit(template["begin"]).alias("text"), F.lit(False).alias("loss")))
    parts = F.concat(begin, F.flatten(F.transform("turns", lambda t: _segments(t, template))))
    bad = first_error(F.transform("turns", lambda t: t["role"]), template)
    out = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), bad.alias("first_error"), parts.alias("segments"))
    return out.select(
        "conv_id", "n_turns", F.col("first_error").isNull().alias("valid"), "first_error", "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_turns(formatted: Column, template: dict = TEMPLATE) -> Column:
    """Array of (role, text) parsed from a formatted text."""
    o, sep, c = (re.escape(x) for x in template["other"])
    known = template["roles"]
    opens = "|".join(re.escape(b) for b, _, _ in known.values())
    closes = "|".join([re.escape(a) for _, a, _ in known.values()] + [c])
    pattern = F.lit(f"(?s)({opens}|{o}.*?{sep})(.*?)(?:{closes})")
    name = {b: r for r, (b, _, _) in known.items()}

    def turn(head: Column, body: Column) -> Column:
        other = F.regexp_replace(head, f"(?s)^{o}(.*){sep}$", "$1")
        role = unescape(other)
        for before, r in name.items():
            role = F.when(head == before, F.lit(r)).otherwise(role)
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.zip_with(F.regexp_extract_all(formatted, pattern, F.lit(1)), F.regexp_extract_all(formatted, pattern, F.lit(2)), turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digests(chats: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    back = chats.select("conv_id", "valid", "first_error", read_turns(F.col("formatted"), template).alias("turns"),
                        loss_text(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
        "valid", "first_error",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("""SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text
        FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)""")
    return digests(format_chats(documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)))


_EXTRA = " + ".join([r"(length(x) - length(replace(x, '\', '')))"] + [f"(length(x) - length(replace(x, '{c}', ''))) // {len(c)}" for c in controls(TEMPLATE)])
_MARKS = " ".join(f"WHEN '{r}' THEN {len(b) + len(a)}" for r, (b, a, _) in TEMPLATE["roles"].items())
SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS x FROM conversations
   UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
 n AS (SELECT *, length(x) + {_EXTRA} + CASE role {_MARKS} ELSE 0 END AS chars,
   coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, x), 'start') AS before,
   row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, x) - 1 AS i,
   count(*) OVER (PARTITION BY conv_id) AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || x || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(x)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(chars))::BIGINT AS formatted_chars,
  min(CASE WHEN before || '>' || role NOT IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') THEN i
           WHEN i = size - 1 AND role <> 'assistant' THEN size END) IS NULL AS valid,
  min(CASE WHEN before || '>' || role NOT IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') THEN i
           WHEN i = size - 1 AND role <> 'assistant' THEN size END)::INT AS first_error
FROM n GROUP BY conv_id
"""
