"""Conversation structure repair: the cheapest edits that give system? (user assistant)+, by cost-to-go and a greedy walk."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import bound_batches, cut
from nearfield.operators.shared import row_numbers

#: Rows and bytes of a conversation that is settled in one go; of longer ones, the rows and about the bytes of a segment.
SEGMENT, SEGMENT_BYTES = 1024, 8 << 20
#: Bytes of segments' plans that are sent to every task at most.
SENT_BYTES = 16 << 20
#: Characters that a task holds before it passes rows on.
HELD = 1 << 20

# Costs of the edits, in order of their letters; what a kept or changed row adds if it is cut short.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5

#: Grammar states: nothing yet, after system, after user, after assistant. A conversation may end in the first and last.
#: Where a role's initial leads (-1: nowhere), and the one role that may be inserted or put in each state.
LEADS = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
FREE, FREE_ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
NOWHERE = (-1, -1, -1, -1)
FINE, BLANK, DUPLICATE, CUT = range(4)
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"

Vector = tuple[float, ...]


def with_inserts(v: list[float]) -> Vector:
    """Costs to go when turns may be inserted first: two at most are worth it."""
    once = [min(v[s], INSERT + v[FREE[s]]) for s in range(4)]
    return tuple(min(v[s], INSERT + once[FREE[s]]) for s in range(4))


#: Costs to go behind the last row.
END = with_inserts([0, math.inf, math.inf, 0])


def costs_to_go(rows: list[tuple[str, int]], end: Vector) -> list[Vector]:
    """For each place before, between and behind ``rows`` (role's initial, fault) the least cost from each state."""
    out, v = [end], end
    for initial, fault in reversed(rows):
        w = [DELETE + x for x in v]
        if fault not in (BLANK, DUPLICATE):
            more, leads = TRUNCATED * (fault == CUT), LEADS.get(initial, NOWHERE)
            for s in range(4):
                w[s] = min(w[s], REROLE + more + v[FREE[s]])
                if leads[s] >= 0:
                    w[s] = min(w[s], KEEP + more + v[leads[s]])
        v = with_inserts(w)
        out.append(v)
    out.reverse()
    return out


def walk(rows: list[tuple[str, int]], cost: list[Vector], state: int, last: bool) -> tuple[list[tuple[str, int, int]], int]:
    """(letter, row, state before) of each edit from ``state`` on, and the state behind. Of the edits on a cheapest way the
    letter that comes first in ASCII is taken: a letter leads to one state, so this gives the least string."""
    edits, i = [], 0
    while i < len(rows) or last and state not in (0, 3):
        c = cost[i][state]
        if i < len(rows):
            initial, fault = rows[i]
            more, to = TRUNCATED * (fault == CUT), LEADS.get(initial, NOWHERE)[state]
            after = cost[i + 1]
            if c == DELETE + after[state]:
                edits.append(("D", i, state))
                i += 1
                continue
        if c == INSERT + cost[i][FREE[state]]:
            edits.append(("I", i, state))
            state = FREE[state]
        elif to >= 0 and c == KEEP + more + after[to]:
            edits.append(("K", i, state))
            state, i = to, i + 1
        else:
            edits.append(("R", i, state))
            state, i = FREE[state], i + 1
    return edits, state


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, present: rows damaged by a checksum of conversation and turn, for tests of ``repair``.

    Null roles and texts become one space, as do nulls in what the checksum is of. A dropped row stays as one that is not present.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv), F.lit(":"), space(turn))) % 20
    new = F.when(kind == 1, "").when(kind == 2, F.translate(space(text), ".!?", "")).otherwise(space(text))
    rows = df.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(space(role)).alias("role"), new.alias("text"), (kind != 0).alias("present"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return rows.drop("copy")


PIECE = (
    "piece long, whole boolean, n long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "first string, last string, low long, high long, distinct long, turns array<struct<role: string, text: string>>"
)


def _piece(rows: list[dict]) -> dict:
    """What becomes of a conversation, or of a segment whose rows know their duplicates and how it goes on."""
    head = rows[0]
    rows = [r for r in rows if r["present"]]
    faults, seen = [], set()
    for r in rows:
        ends = r["text"].rstrip(WHITE)[-1:]
        if not ends:
            faults.append(BLANK)
        elif r["again"] or (r["again"] is None and (r["role"], r["text"]) in seen):
            faults.append(DUPLICATE)
        else:
            faults.append(FINE if ends in ".!?" else CUT)
            if r["again"] is None:
                seen.add((r["role"], r["text"]))
    short = [(r["role"][:1], f) for r, f in zip(rows, faults, strict=True)]
    end = tuple(head["ends"]) if head["ends"] else END
    cost = costs_to_go(short, end)
    edits, behind = walk(short, cost, head["entry"], head["final"])
    turns = []
    for letter, i, state in edits:
        if letter == "K":
            turns.append({"role": rows[i]["role"], "text": rows[i]["text"]})
        elif letter != "D":
            turns.append({"role": FREE_ROLE[state], "text": rows[i]["text"] if letter == "R" else ""})
    numbers = [r["turn"] for r in rows if r["turn"] is not None]
    return {
        "piece": head["segment"], "whole": head["whole"], "n": len(rows), **{name: faults.count(k) for k, name in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT, "truncated"))},
        "illegal": sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(short, short[1:])),
        "cost": int(cost[0][head["entry"]] - (0 if head["final"] else end[behind])), "audit": "".join(e[0] for e in edits),
        "first": short[0][0] if short else None, "last": short[-1][0] if short else None,
        "low": numbers[0] if numbers else None, "high": numbers[-1] if numbers else None, "distinct": len(set(numbers)), "turns": turns,
    }


def in_runs(batches: Iterable[pa.RecordBatch], by: list[str]) -> Iterator[list[dict]]:
    """Consecutive rows that agree in ``by``, also over the edges of batches."""
    held, now = [], None
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[c] for c in by)
            if held and key != now:
                yield held
                held = []
            now = key
            held.append(row)
    if held:
        yield held


def _mapped(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[dict]], fields: object) -> DataFrame:
    """Rows that ``fn`` makes of a partition's batches, passed on before they grow large."""
    from pyspark.sql.pandas.types import to_arrow_schema

    layout = to_arrow_schema(df.sparkSession.createDataFrame([], fields).schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in fn(batches):
            rows.append(row)
            size += 200 + sum(len(t["text"]) + 50 for t in row.get("turns") or ())
            if size > HELD:
                yield pa.RecordBatch.from_pylist(rows, schema=layout)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=layout)

    return df.mapInArrow(run, fields)


def _pieces(rows: DataFrame) -> DataFrame:
    """A piece for each run of key and segment; ``rows`` lie together and in order."""
    fields = rows.select("key", "conv_id").schema
    for f in rows.sparkSession.createDataFrame([], PIECE).schema:
        fields = fields.add(f)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for own in in_runs(batches, ["key", "segment"]):
            yield {"key": own[0]["key"], "conv_id": own[0]["conv_id"], **_piece(own)}

    return _mapped(rows, run, fields)


def _plan(rows: DataFrame) -> DataFrame:
    """key, segment, ends, entry, final of each segment of the long conversations ``rows`` (key, segment, pos, role, text, present, again).

    A segment is first a matrix of least costs from state to state; these are put together from the last segment back,
    a row at a time, for the costs to go behind each segment. With these every segment says where each state leads, and
    these steps are followed from the first segment on.
    """
    bare = F.rtrim(F.translate("text", WHITE, " " * len(WHITE)))
    fault = F.when(bare == "", BLANK).when(F.col("again"), DUPLICATE).when(F.substring(bare, -1, 1).isin(".", "!", "?"), FINE).otherwise(CUT)
    short = rows.select("key", "segment", F.when(F.col("present"), F.struct("pos", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))).alias("r"))
    segments = cut(short.groupBy("key", "segment").agg(F.sort_array(F.collect_list("r")).alias("rows")))  # SEGMENT rows at most
    pairs = lambda r: [(x["initial"], x["fault"]) for x in r["rows"]]

    def matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for r in batch.to_pylist():
                to = [costs_to_go(pairs(r), tuple(0.0 if s == t else math.inf for s in range(4)))[0] for t in range(4)]
                yield {"key": r["key"], "segment": r["segment"], "least": [float(to[t][s]) for s in range(4) for t in range(4)]}

    def backwards(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        now, end = None, END
        for batch in batches:
            for r in batch.to_pylist():
                end = END if r["key"] != now else end
                yield {"key": r["key"], "segment": r["segment"], "ends": [float(x) for x in end], "final": r["key"] != now}
                now, end = r["key"], tuple((np.reshape(r["least"], (4, 4)) + end).min(1))

    def steps(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for r in batch.to_pylist():
                cost = costs_to_go(pairs(r), tuple(r["ends"]))
                yield {"key": r["key"], "segment": r["segment"], "ends": r["ends"], "final": r["final"], "to": [walk(pairs(r), cost, s, False)[1] for s in range(4)]}

    def forwards(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        now, state = None, 0
        for batch in batches:
            for r in batch.to_pylist():
                state = 0 if r["key"] != now else state
                yield {"key": r["key"], "segment": r["segment"], "ends": r["ends"], "final": r["final"], "entry": state}
                now, state = r["key"], r["to"][state]

    kind = "key string, segment long"
    least = _mapped(segments, matrices, f"{kind}, least array<double>").repartition("key").sortWithinPartitions("key", F.desc("segment"))
    ends = cut(_mapped(least, backwards, f"{kind}, ends array<double>, final boolean"))
    to = _mapped(segments.join(ends, ["key", "segment"]), steps, f"{kind}, ends array<double>, final boolean, to array<int>")
    return cut(_mapped(to.repartition("key").sortWithinPartitions("key", "segment"), forwards, f"{kind}, ends array<double>, final boolean, entry int"))


def repair(df: DataFrame) -> DataFrame:
    """Pieces of repaired conversations: conv_id, key, piece, whole, counts, cost, audit and ``turns`` (role, text) in order.

    ``df`` has conv_id, turn (long), role, text (neither null) and present; rows that are not only name their conversation. A
    conversation's rows are taken by turn, nulls first, those of one turn by role and the md5 of their text. Null ids are
    one conversation. A row is blank, a duplicate of an earlier one in role and text, cut short (its last character
    that isn't white space is none of ``.!?``) or fine, the first that holds. Edits keep a row, give it the role of user or
    assistant, delete it, or insert an empty turn of these; the cheapest that leave roles with the initials s? (ua)+, or
    nothing, are taken, of equal ones those with the letters (K, R, D, I) that come first in ASCII. A role without such an initial must go or change.

    Conversations of at most ``SEGMENT`` rows and ``SEGMENT_BYTES`` bytes are one piece and settled where their rows meet.
    Longer ones are cut into segments that are settled each for itself, once ``_plan`` has found what they must know of
    each other, and give a piece each; no task sees all rows of one. An empty table gives none.
    """
    bound_batches(df.sparkSession)
    rows = df.withColumns({"key": F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")), "mark": F.md5("text")})
    size = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("b"))
    per = F.greatest(F.lit(1), F.least(F.lit(SEGMENT), F.floor(F.col("n") * SEGMENT_BYTES / F.greatest("b", F.lit(1))))).cast("long")
    long = cut(size.filter((F.col("n") > SEGMENT) | (F.col("b") > SEGMENT_BYTES)).select("key", per.alias("per")))
    found = long.agg(F.count("*").alias("n"), F.sum(F.octet_length("key") + 16).alias("b")).first()
    near = (lambda x: F.broadcast(x)) if (found["b"] or 0) <= SENT_BYTES else (lambda x: x)
    fixed = {"segment": F.lit(0).cast("long"), "ends": F.lit(None).cast("array<double>"), "entry": F.lit(0), "final": F.lit(True), "whole": F.lit(True), "again": F.lit(None).cast("boolean")}
    columns = ["key", "conv_id", *[c for c in fixed], "turn", "role", "text", "present"]
    short = rows.join(near(long), "key", "left_anti") if found["n"] else rows
    together = short.repartition("key").sortWithinPartitions("key", "turn", "role", "mark")
    out = _pieces(together.withColumns(fixed).select(*columns))
    if not found["n"]:
        return out
    cutup = row_numbers(rows.join(near(long), "key").withColumn("tie", F.monotonically_increasing_id()), ["key"], ["turn", "role", "mark", "tie"], "pos")
    cutup = cutup.withColumns({"segment": F.floor((F.col("pos") - 1) / F.col("per")), "other": F.xxhash64("role", "text")})
    cutup = cut(cutup.select("key", "conv_id", "segment", "pos", "turn", "role", "text", "present", "mark", "other"))
    slim = cutup.filter("present").select("key", "mark", "other", "role", "segment", "pos")
    first = cut(slim.groupBy("key", "mark", "other", "role").agg(F.min("pos").alias("first"), F.max("pos").alias("second")).filter("first < second").drop("second"))
    # Written, so that adaptive execution can split a line that is very common in one conversation.
    again = slim.join(first, ["key", "mark", "other", "role"]).filter("pos > first").select("key", "segment", "pos", F.lit(True).alias("again"))
    cutup = cut(cutup.drop("mark", "other").join(again, ["key", "segment", "pos"], "left").withColumn("again", F.coalesce("again", F.lit(False))))
    planned = cutup.join(_plan(cutup), ["key", "segment"]).withColumn("whole", F.lit(False))
    return out.unionByName(_pieces(planned.repartition("key", "segment").sortWithinPartitions("key", "segment", "pos").select(*columns)))


def turns(pieces: DataFrame) -> DataFrame:
    """conv_id, piece, nth, role, text of the repaired turns, in order of piece and nth."""
    return pieces.select("conv_id", "piece", F.posexplode("turns").alias("nth", "t")).select("conv_id", "piece", "nth", "t.role", "t.text")


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
MOST = (1 << 63) - 1


def report(pieces: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

    A digest is of a text in order, so the pieces of a long conversation pass through one task, a piece at a time.
    """
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    gaps = F.least(F.coalesce(wide("high") - wide("low") + 1 - wide("distinct"), F.lit(0).cast("decimal(20,0)")), F.lit(MOST).cast("decimal(20,0)")).cast("long")
    whole = pieces.filter("whole").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join(line, "\n"), 256).alias("repaired_sha256"))
    parts = pieces.filter("NOT whole").repartition("key").sortWithinPartitions("key", "piece")
    fields = pieces.select("conv_id").schema
    for f in pieces.sparkSession.createDataFrame([], REPORT).schema:
        fields = fields.add(f)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        now, out = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                p = batch.slice(at, 1).to_pylist()[0]
                if out is None or p["key"] != now:
                    if out:
                        yield closed(out)
                    now, out = p["key"], {"conv_id": p["conv_id"], "hash": hashlib.sha256(), "any": False, "last": None, "low": None, "high": None, "distinct": 0, "audit": []} | dict.fromkeys(COUNTS, 0)
                add(out, p)
        if out:
            yield closed(out)

    def add(out: dict, p: dict) -> None:
        for c in COUNTS:
            out[c] += p[c]
        if p["n"]:
            out["illegal"] += out["last"] is not None and out["last"] + p["first"] not in ("su", "ua", "au")
            out["last"] = p["last"]
        if p["low"] is not None:
            out["distinct"] += p["distinct"] - (out["high"] == p["low"])
            out["low"] = p["low"] if out["low"] is None else out["low"]
            out["high"] = p["high"]
        out["audit"].append(p["audit"])
        for t in p["turns"]:
            out["hash"].update(("\n" * out["any"] + t["role"] + ":" + t["text"]).encode("utf-8", "surrogatepass"))
            out["any"] = True

    def closed(out: dict) -> dict:
        gap = 0 if out["low"] is None else min(MOST, out["high"] - out["low"] + 1 - out["distinct"])
        return {"conv_id": out["conv_id"], "gaps": gap, **{c: out[c] for c in COUNTS}, "audit": "".join(out["audit"]), "repaired_sha256": out["hash"].hexdigest()}

    return whole.unionByName(_mapped(parts, run, fields))


COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def op12(df: DataFrame) -> DataFrame:
    return report(repair(damage(df)))


def sql() -> str:
    lead = lambda s: f"CASE initial WHEN 's' THEN {LEADS['s'][s]} WHEN 'u' THEN {LEADS['u'][s]} WHEN 'a' THEN {LEADS['a'][s]} ELSE -1 END"
    step = lambda v, c, a, o: f"{{'c': {v}.c + {c}, 'a': '{a}' || {v}.a, 'o': list_concat({o}, {v}.o)}}"
    none = "CAST([] AS VARCHAR[])"
    whole = [
        f"list_min([{step(f'v[{s + 1}]', DELETE, 'D', none)}, {step(f'v[{FREE[s] + 1}]', f'{REROLE} + more', 'R', f'''['{FREE_ROLE[s]}:' || text]''')}, "
        f"CASE WHEN {lead(s)} >= 0 THEN {step(f'v[({lead(s)}) + 1]', f'{KEEP} + more', 'K', '[role || chr(58) || text]')} END])"
        for s in range(4)
    ]
    must = [step(f"v[{s + 1}]", DELETE, "D", none) for s in range(4)]
    ins = lambda v, w: ", ".join(f"list_min([{v}[{s + 1}], {step(f'{w}[{FREE[s] + 1}]', INSERT, 'I', f'''['{FREE_ROLE[s]}:']''')}])" for s in range(4))
    end = lambda c, a, o: f"{{'c': CAST({c} AS BIGINT), 'a': '{a}', 'o': CAST([{o}] AS VARCHAR[])}}"
    ends = ", ".join((end(0, "", ""), end(2 * INSERT, "II", "'user:', 'assistant:'"), end(INSERT, "I", "'assistant:'"), end(0, "", "")))
    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda s: [CAST(ascii(s) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(0, CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE k <> 0),
p AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, role[1] AS initial, lag(role[1]) OVER w AS before, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)),
q AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate FROM p),
r AS (SELECT *, NOT blank AND NOT duplicate AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS truncated FROM q),
x AS (SELECT conv_id, i, role, text, initial, blank OR duplicate AS must, CASE WHEN truncated THEN {TRUNCATED} ELSE 0 END AS more FROM r),
z AS (SELECT conv_id, max(i) AS i, [{ends}] AS v FROM x GROUP BY conv_id
  UNION ALL SELECT conv_id, i - 1, [{ins("w", "y")}] FROM (SELECT conv_id, i, w, [{ins("w", "w")}] AS y FROM
    (SELECT z.conv_id, z.i, CASE WHEN must THEN [{", ".join(must)}] ELSE [{", ".join(whole)}] END AS w FROM z JOIN x ON x.conv_id IS NOT DISTINCT FROM z.conv_id AND x.i = z.i))),
c AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
  count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(v[1].c, 0) AS cost, coalesce(v[1].a, '') AS audit, sha256(coalesce(array_to_string(v[1].o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM o.conv_id AND z.i = 0
"""
