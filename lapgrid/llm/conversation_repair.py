r"""Repair of conversation structure: Wagner-Fischer alignment of turns to every feasible length of an alternating grammar.

The repaired roles must read ``(s?(ua)+)?`` by their initials.  Edits, with
initial and cost: Keep (0), Rerole to user or assistant (2), Delete (3, and the
only edit of a blank or duplicate row), Insert an empty user or assistant turn
(2); a truncated row that stays adds 1.  The cheapest edits win; of equally
cheap ones, those whose initials, the audit, are least in ASCII order.

Targets of one ending are suffixes of one alternating string, so one table,
filled from the last row backwards, holds the costs for all lengths: cell (i, r)
aligns the rows from i on with the last r symbols.  An incumbent, found by one
greedy pass, bounds every cell's distance from the diagonal (Ukkonen): r can
exceed the rows left by at most cost / 2 and fall behind by at most cost / 3.
The audits of all lengths of the least cost are traced back and compared.  A
leading system turn is one kept row before the alternating part.

A conversation is one row after one shuffle by conv_id, as the digest of its repair needs all of
it; its texts stay in the JVM, only initials, faults and fingerprints of rows meet the aligner.  Long ones are
aligned in blocks of BLOCK rows, from each grammar state to each, and the blocks'
best audits are joined: a block's cheapest least audit between two states is
part of the whole's (equally cheap audits over the same rows are never prefixes
of each other), so the result is exact and time grows with the rows.

Nulls in role, text and turn: role and text read as one space (so a row with null text is blank); null
turns come first.  Ties in turn are ordered by role, then text.  Repeated rows
are duplicates.  Null conv_ids form one conversation.  Empty texts are blank;
very long texts are only read by regular expressions and one fingerprint.  An empty table gives an empty result.
Columns beyond conv_id, turn, role and text, whatever their names, are not read and not returned.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import documents

BLOCK = 256
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_FAR = 1 << 40
#: Grammar states: nothing yet, after s, after u, after a.  Which initial each waits for.
_NEXT = "uuau"


def _incumbent(initials: str, forced: list[bool], extra: list[int]) -> int:
    """The cost of a greedy alignment, with what it may take to enter and leave by any state."""
    cost, due = 0, "u"
    for c, dead, more in zip(initials, forced, extra, strict=True):
        if dead:
            cost += DELETE
            continue
        if c not in "ua":
            cost += REROLE
        elif c != due:
            cost, due = cost + INSERT, c
        cost, due = cost + more, "a" if due == "u" else "u"
    return cost + 4 * INSERT


class _Table:
    """Costs of aligning the rows from i on with the last r symbols of an alternating string that ends in ``end``."""

    def __init__(self, initials: str, forced: list[bool], extra: list[int], end: str, most: int):
        m = len(initials)
        self.rows = (initials, forced, extra)
        self.symbol = "au" if end == "u" else "ua"  # the first of r symbols, by r % 2
        self.width = m + most // INSERT + 1
        below = [_FAR] * (self.width + 2)
        for r in range(self.width + 1):
            below[r] = INSERT * r
        self.cost = [below]
        for i in range(m - 1, -1, -1):
            here = [_FAR] * (self.width + 2)
            left = m - i
            for r in range(max(0, left - most // DELETE), min(self.width, left + most // INSERT) + 1):
                best = below[r] + DELETE
                if r:
                    best = min(best, here[r - 1] + INSERT)
                    if not forced[i]:
                        best = min(best, below[r - 1] + extra[i] + (0 if initials[i] == self.symbol[r % 2] else REROLE))
                here[r] = best
            self.cost.append(here)
            below = here
        self.cost.reverse()

    def trace(self, i: int, r: int) -> str:
        """The least audit among the cheapest from cell (i, r)."""
        initials, forced, extra = self.rows
        out = []
        while i < len(initials) or r:
            c = self.cost[i][r]
            if i < len(initials) and c == self.cost[i + 1][r] + DELETE:
                out.append("D")
                i += 1
            elif r and c == self.cost[i][r - 1] + INSERT:
                out.append("I")
                r -= 1
            else:
                out.append("K" if c == self.cost[i + 1][r - 1] + extra[i] and initials[i] == self.symbol[r % 2] else "R")
                i, r = i + 1, r - 1
        return "".join(out)


def _block(initials: str, forced: list[bool], extra: list[int], enter: list[int], leave: list[int]) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) -> (cost, audit) of some rows in a row."""
    most, m, out = _incumbent(initials, forced, extra), len(initials), {}
    tables = {x: _Table(initials, forced, extra, "u" if x == 2 else "a", most) for x in leave if x > 1}
    heads = [i for i in range(m) if initials[i] == "s" and not forced[i]] if 0 in enter else []
    for x in leave:
        for e in enter:
            found: list[tuple[int, int, int]] = []  # cost, row of the system turn that is kept or -1, length of the alternating part
            if x > 1:
                t = tables[x]
                # Lengths whose first symbol is the one that the state waits for; none only where the state is the end itself.
                odd = (x == 2) != (e == 2)
                ways = [(-1, e)] + [(i, 1) for i in heads if e == 0]
                for i, state in ways:
                    cost, before = t.cost[i + 1], 0 if i < 0 else DELETE * i + extra[i]
                    found += [(cost[r] + before, i, r) for r in range(odd, t.width + 1, 2) if (r or state == x) and cost[r] < _FAR]
            elif e == x:
                out[e, x] = (DELETE * m, "D" * m)
            elif e == 0 and x == 1:
                some = [(DELETE * (m - 1) + extra[i], "D" * i + "K" + "D" * (m - i - 1)) for i in heads]
                if some:
                    out[e, x] = min(some)
            if found:
                least = min(found)[0]
                audits = (("D" * i + "K" if i >= 0 else "") + tables[x].trace(i + 1, r) for c, i, r in found if c == least)
                out[e, x] = (least, min(audits))
    return out


def align(initials: str, forced: list[bool], extra: list[int]) -> tuple[int, str]:
    """The least cost, and its least audit, of making the rows' initials read ``(s?(ua)+)?``."""
    m, best = len(initials), {0: (0, "")}
    for at in range(0, m, BLOCK):
        end = min(at + BLOCK, m)
        pieces = _block(initials[at:end], forced[at:end], extra[at:end], sorted(best), [0, 1, 2, 3] if end < m else [0, 3])
        after: dict[int, tuple[int, str]] = {}
        for (e, x), (cost, audit) in pieces.items():
            new = (best[e][0] + cost, best[e][1] + audit)
            after[x] = min(after.get(x, new), new)
        best = after
    return min(best[x] for x in (0, 3) if x in best)


def plan(initials: str, audit: str) -> list[dict]:
    """The repaired turns: the row each comes from (-1 if inserted) and its new role, null where kept."""
    out, state, i = [], 0, 0
    for op in audit:
        if op == "D":
            i += 1
            continue
        due = _NEXT[state]
        out.append({"row": -1 if op == "I" else i, "role": None if op == "K" else {"u": "user", "a": "assistant"}[due]})
        state = 1 if op == "K" and initials[i] == "s" else 2 if due == "u" else 3
        i += op != "I"
    return out


_REPAIRED = "blank long, duplicate long, truncated long, cost long, audit string, plan array<struct<row:int,role:string>>"


def _repaired(initials: pd.Series, faults: pd.Series, keys: pd.Series) -> pd.DataFrame:
    rows = []
    for first, fault, key in zip(initials, faults, keys, strict=True):
        seen: set = set()
        kind = []
        for f, k in zip(fault, key, strict=True):
            kind.append("blank" if f == 1 else "duplicate" if k in seen else "truncated" if f == 2 else "")
            seen.add(k)
        roles = "".join(c or " " for c in first)
        cost, audit = align(roles, [k in ("blank", "duplicate") for k in kind], [TRUNCATED * (k == "truncated") for k in kind])
        rows.append((*(kind.count(k) for k in ("blank", "duplicate", "truncated")), cost, audit, plan(roles, audit)))
    return pd.DataFrame(rows, columns=["blank", "duplicate", "truncated", "cost", "audit", "plan"])


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired (array of role and text), a row for each conversation."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    turn = F.struct("turn", role.alias("role"), text.alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    fault = lambda t: F.when(~F.rlike(t["text"], F.lit(r"[^\x20\x09-\x0D]")), 1).when(~F.rlike(t["text"], F.lit(r"[.!?][\x20\x09-\x0D]*\z")), 2).otherwise(0)
    chats = chats.select(
        "conv_id", "turns", F.transform("turns", lambda t: F.substring(t["role"], 1, 1)).alias("first"), F.transform("turns", fault).alias("faults"),
        F.transform("turns", lambda t: F.md5(F.concat(F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]))).alias("keys"),
        F.array_distinct(F.filter(F.transform("turns", lambda t: t["turn"]), lambda t: t.isNotNull())).alias("at"),
    )
    steps = F.zip_with(F.slice("first", 1, F.size("first") - 1), F.slice("first", 2, F.size("first")), lambda a, b: F.concat(a, b))
    illegal = F.when(F.size("first") > 1, F.size(F.filter(steps, lambda s: ~s.isin("su", "ua", "au")))).otherwise(0)
    gaps = F.when(F.size("at") > 0, F.array_max("at") - F.array_min("at") + 1 - F.size("at")).otherwise(0)
    done = chats.select("conv_id", "turns", gaps.cast("long").alias("gaps"), illegal.cast("long").alias("illegal"), F.pandas_udf(_repaired, _REPAIRED)("first", "faults", "keys").alias("r"))

    def turn_of(p: Column) -> Column:
        row = F.try_element_at("turns", p["row"] + 1)
        kept = p["row"] >= 0
        return F.struct(F.coalesce(p["role"], F.when(kept, row["role"])).alias("role"), F.when(kept, row["text"]).otherwise("").alias("text"))

    return done.select("conv_id", "gaps", "r.blank", "r.duplicate", "r.truncated", "illegal", "r.cost", "r.audit", F.transform("r.plan", turn_of).alias("repaired"))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with planted damage, by crc32 of ``conv_id:turn`` modulo 20."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    hit = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role")
    body = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text")
    return hit.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select("conv_id", "turn", role, body)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = repair(damaged(rows))
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = out.select(F.col("conv_id").alias("id"), *counts, "audit", F.sha2(lines, 256).alias("sha"))
    ids = rows.select("conv_id").distinct()
    return ids.join(found, ids["conv_id"].eqNullSafe(found["id"]), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def _sql() -> str:
    """The cheapest edits row by row over the four grammar states; a state is (cost, audit, repaired text)."""
    add = lambda s, cost, op, line: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{op}', 'o': {s}.o || {line}}}"
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    u, a = "'user:' || chr(10)", "'assistant:' || chr(10)"
    closed = ["b0 AS c0", "b1 AS c1", f"{least('b2', add('b0', 2, 'I', u), add('b1', 2, 'I', u), add('b3', 2, 'I', u))} AS c2",
              f"{least('b3', add('b2', 2, 'I', a), add('b0', 4, 'II', u + ' || ' + a), add('b1', 4, 'II', u + ' || ' + a))} AS c3"]
    no = "{'c': 1000000000, 'a': '', 'o': ''}"
    keep = lambda s, c: f"CASE WHEN dead OR f <> '{c}' THEN {no} ELSE {add(s, 'more', 'K', chr(39) * 2 + ' || role || chr(58) || text || chr(10)')} END"
    rerole = lambda s, name: f"CASE WHEN dead THEN {no} ELSE {add(s, '2 + more', 'R', f'{chr(39)}{name}:{chr(39)} || text || chr(10)')} END"
    drop = lambda s: add(s, 3, "D", "''")
    from_u = ["c0", "c1", "c3"]
    step = [f"{drop('c0')} AS b0", f"{least(drop('c1'), keep('c0', 's'))} AS b1",
            f"{least(drop('c2'), *[keep(s, 'u') for s in from_u], *[rerole(s, 'user') for s in from_u])} AS b2",
            f"{least(drop('c3'), keep('c2', 'a'), rerole('c2', 'assistant'))} AS b3"]
    return rf"""
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS t),
 raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
   coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
 hit AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)),
   lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 AS k FROM raw, bits),
 d AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
   CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE k WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
   FROM hit WHERE k <> 0),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
 q AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
   NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, substr(role, 1, 1) AS f, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
 e AS MATERIALIZED (SELECT *, blank OR dup AS dead, (cut AND NOT blank AND NOT dup)::INT AS more FROM q),
 n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, sum(blank::INT)::BIGINT AS blank,
   sum((dup AND NOT blank)::INT)::BIGINT AS duplicate, sum(more)::BIGINT AS truncated,
   sum((before IS NOT NULL AND before || f NOT IN ('su', 'ua', 'au'))::INT)::BIGINT AS illegal, count(*) AS m FROM e GROUP BY conv_id),
 r AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'o': ''}} AS b0, {no} AS b1, {no} AS b2, {no} AS b3 FROM n
   UNION ALL
   SELECT conv_id, i, {', '.join(step)} FROM (SELECT e.conv_id, e.i, role, text, f, dead, more, {', '.join(closed)}
     FROM r JOIN e ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND e.i = r.i + 1)),
 z AS (SELECT conv_id, gaps, blank, duplicate, truncated, illegal, {least('c0', 'c3')} AS z FROM (
   SELECT n.*, {', '.join(closed)} FROM r JOIN n ON n.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = n.m))
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(z.c, 0)::BIGINT AS cost, coalesce(z.a, '') AS audit,
  sha256(CASE WHEN coalesce(z.o, '') = '' THEN '' ELSE substr(z.o, 1, length(z.o) - 1) END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN z ON i.conv_id IS NOT DISTINCT FROM z.conv_id
"""


SQL = _sql()
