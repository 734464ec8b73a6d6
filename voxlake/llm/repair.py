"""Conversation structure repair: cheapest edits to a legal turn order, by Hirschberg's divide and conquer over four states."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import returning_memory, small_batches, stored, table
from voxlake.operators.scans import numbered

#: Characters that count as white space.
WHITE = " \t\n\x0b\x0c\r"
#: Rows of a fragment of a conversation (a power of two).
FRAGMENT_BITS = 16
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
FAR = 1 << 60

# States: nothing written, a system turn, a user turn, an assistant turn. A user turn may follow all but a user turn.
USER, ASSISTANT = {0: 2, 1: 2, 3: 2}, {2: 3}
#: What ends a conversation in each state: inserted turns and their cost.
ENDING = {0: ("", 0), 1: ("II", 2 * INSERT), 2: ("I", INSERT), 3: ("", 0)}


def _insert(state: int, times: int) -> int:
    for _ in range(times):
        state = USER.get(state) or ASSISTANT[state]
    return state


def _moves(kind: str) -> list[list[tuple[int, int, str]]]:
    """For each state after a row of this kind: (state before, cost, edits), the cheapest and then ASCII-least edits for each pair of states.

    kind: the role's initial s, u, a or o (any other), upper case if the row's text is cut off; x: a row that has to go.
    """
    best: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(before: int, after: int | None, cost: int, edits: str) -> None:
        if after is not None:
            best[before, after] = min(best.get((before, after), (FAR, "")), (cost, edits))

    for state, n in product(range(4), range(3)):
        now, paid, done = _insert(state, n), n * INSERT, "I" * n
        offer(state, now, paid + DELETE, done + "D")
        if kind == "x":
            continue
        cut = CUT_OFF if kind.isupper() else 0
        keep = {"s": {0: 1}, "u": USER, "a": ASSISTANT}.get(kind.lower(), {})
        offer(state, keep.get(now), paid + cut, done + "K")
        for role in (USER, ASSISTANT):
            offer(state, role.get(now), paid + cut + REROLE, done + "R")
    return [[(p, *best[p, q]) for p in range(4) if (p, q) in best] for q in range(4)]


MOVES = {kind: _moves(kind) for kind in "suaoSUAOx"}
#: The same moves by the state before, for walking back.
BACK = {kind: [[(q, c) for q in range(4) for r, c, _ in moves[q] if r == p] for p in range(4)] for kind, moves in MOVES.items()}
EDITS = {(kind, p, q): e for kind, moves in MOVES.items() for q in range(4) for p, _, e in moves[q]}


def forward(kinds: str, state: int) -> tuple[list[int], list[int]]:
    """Costs of reaching each state behind the rows, and the ASCII order of the least cheapest edits that do.

    Edits of the same rows that end in different states differ, and none is the beginning of another (each ends with the
    edit of the last row), so the order of what is before a row decides, and only then the row's own edits.
    """
    costs, ranks = [FAR] * 4, [0] * 4
    costs[state] = 0
    for kind in kinds:
        found = [min(((costs[p] + c, ranks[p], e) for p, c, e in into if costs[p] < FAR), default=(FAR, 4, "")) for into in MOVES[kind]]
        order = sorted(range(4), key=lambda q: found[q][1:])
        costs = [f[0] for f in found]
        ranks = [order.index(q) for q in range(4)]
    return costs, ranks


def backward(kinds: str, costs: list[int]) -> list[int]:
    """Costs from each state before the rows, given those behind them."""
    for kind in reversed(kinds):
        costs = [min((costs[q] + c for q, c in out), default=FAR) for out in BACK[kind]]
    return costs


def crossing(costs: list[int], ranks: list[int], rest: list[int]) -> int:
    """The state where cheapest edits with the least beginning cross."""
    least = min(c + r for c, r in zip(costs, rest))
    return min((q for q in range(4) if costs[q] + rest[q] == least), key=lambda q: ranks[q])


def reconstruct(kinds: str, before: int, after: int) -> list[tuple[int, str]]:
    """(state before, edits) of each row on the cheapest, then ASCII-least way between two states; linear space."""
    out, todo = [], [(0, len(kinds), before, after)]
    while todo:
        lo, hi, p, q = todo.pop()
        if hi - lo == 1:
            out.append((p, EDITS[kinds[lo], p, q]))
        elif hi > lo:
            mid = (lo + hi) // 2
            goal = [0 if s == q else FAR for s in range(4)]
            s = crossing(*forward(kinds[lo:mid], p), backward(kinds[mid:hi], goal))
            todo += [(mid, hi, s, q), (lo, mid, p, s)]
    return out


def _written(state: int, edits: str) -> str:
    """The edits with the roles they write: u and a for inserted turns, U and A for new roles, K and D as they are."""
    out = ""
    for e in edits:
        if e in "IR":
            role = "u" if state in USER else "a"
            out += role if e == "I" else role.upper()
        else:
            out += e
        if e in "IR":
            state = _insert(state, 1)
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that crc32(conv_id:turn) % 20 states; nulls count as one space, in that text too."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = conversations.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(name) % 20).alias("fate")).filter("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_")).drop("_")


def with_faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, pos, turn, role, text), narrow: conv_id, pos, turn, initial of the role (s, u, a or o) and first fault (blank, duplicate, truncated or null)."""
    end = F.right(F.rtrim(F.col("text"), F.lit(WHITE)), F.lit(1))
    initial = F.left("role", F.lit(1))
    narrow = rows.select("conv_id", "pos", "turn", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), end.alias("end"), F.md5(F.concat_ws(":", F.length("role"), "role", "text")).alias("said"))
    first = narrow.groupBy(F.col("conv_id").alias("c"), F.col("said").alias("t")).agg(F.min("pos").alias("first"))
    narrow = narrow.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("t")))
    fault = F.when(F.col("end") == "", "blank").when(F.col("pos") > F.col("first"), "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated")
    return narrow.select("conv_id", "pos", "turn", "initial", fault.alias("fault"))


def _each(fn, schema: str):
    """mapInArrow with a plain function of a row's values that gives a tuple."""
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fn(*r) for r in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_types(schema))], names=names)

    return run


def _types(schema: str) -> list[pa.DataType]:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return [kinds[f.split(" ")[1]] for f in schema.split(", ")]


def summarise(conv_id, fragment, first, kinds, initials):
    """A fragment as a matrix: costs and orders of the states behind it, for each state before it; illegal neighbours inside."""
    both = [forward(kinds, p) for p in range(4)]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return conv_id, fragment, first, kinds, illegal, initials[0], initials[-1], [c for b in both for c in b[0]], [r for b in both for r in b[1]]


def meet(conv_id, fragments, firsts, lasts, illegal, costs, orders):
    """The states between a conversation's fragments, its least cost and its illegal neighbours."""
    at, rank = [0, FAR, FAR, FAR], [0] * 4
    ahead = [(at, rank)]
    for cost, order in zip(costs, orders):
        found = [min((at[p] + cost[4 * p + q], rank[p], order[4 * p + q]) for p in range(4)) for q in range(4)]
        place = sorted(range(4), key=lambda q: found[q][1:])
        at, rank = [min(f[0], FAR) for f in found], [place.index(q) for q in range(4)]
        ahead.append((at, rank))
    rest = [ENDING[s][1] for s in range(4)]
    states, total = [crossing(at, rank, rest)], min(c + r for c, r in zip(at, rest))
    for (at, rank), cost in zip(ahead[-2::-1], costs[::-1]):
        rest = [min(cost[4 * p + q] + rest[q] for q in range(4)) for p in range(4)]
        states.append(crossing(at, rank, rest))
    between = sum(a + b not in ("su", "ua", "au") for a, b in zip(lasts, firsts[1:]))
    return conv_id, fragments, states[::-1], total, sum(illegal) + between


def edits_of(conv_id, fragment, first, kinds, before, after, is_last):
    """A fragment's audit, and for each row what is written."""
    steps = reconstruct(kinds, before, after)
    audit, written = "".join(e for _, e in steps), [_written(p, e) for p, e in steps]
    if is_last and ENDING[after][0]:
        audit += ENDING[after][0]
        written[-1] += _written(after, ENDING[after][0])
    return conv_id, fragment, first, audit, written


def digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id and SHA-256 of the repaired `role:text` lines: rows (conv_id, pos, role, text) and their edits (conv_id, pos, written) stream in order.

    A conversation's digest is sequential, so its rows pass through one task, a batch of them in memory at a time.
    """
    none = F.lit(None).cast("string")
    both = rows.select("conv_id", "pos", F.lit(1).alias("kind"), "role", "text").unionByName(edits.select("conv_id", "pos", F.lit(0).alias("kind"), F.col("written").alias("role"), none.alias("text")))
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "kind").select("conv_id", "kind", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, lines, edit = None, None, 0, ""
        for batch in returning_memory(batches):
            done: list[tuple] = []
            for conv_id, kind, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    edit = role
                    if digest is None or now != conv_id:
                        if digest is not None:
                            done.append((now, digest.hexdigest()))
                        now, digest, lines = conv_id, hashlib.sha256(), 0
                    continue
                for e in edit:
                    if e == "D":
                        continue
                    line = {"u": "user:", "a": "assistant:", "U": f"user:{text}", "A": f"assistant:{text}", "K": f"{role}:{text}"}[e]
                    digest.update((("\n" if lines else "") + line).encode())
                    lines += 1
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["conv_id", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    return ordered.mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame, fragment_bits: int = FRAGMENT_BITS) -> tuple[DataFrame, DataFrame]:
    """Repair conversations (conv_id, turn, role, text): a report for each (see repaired()), and the edits of each row (conv_id, pos, written) with the rows.

    Rows are taken by turn, null first, ties by role and text. Each is a letter for what may be done with it; fragments of
    at most 2**fragment_bits letters become matrices of costs and orders. Per conversation the fragments' matrices give the
    states at which the cheapest, ASCII-least edits cross from one to the next, and each fragment then divides itself:
    forward and backward cost vectors of four states meet in the middle, and either half is done in turn.
    """
    rows = numbered(small_batches(rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")), "conv_id", ["turn", "role", "text"])
    found = stored(with_faults(rows), "faults")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    seen = F.array_sort(F.collect_list(F.struct("pos", letter.alias("k"), "initial")))
    text = lambda c: F.array_join(F.transform(F.col("seen"), lambda x: x[c]), "")
    fragments = found.groupBy("conv_id", F.shiftright("pos", fragment_bits).alias("fragment")).agg(seen.alias("seen"), F.min("pos").alias("first"))
    shape = "conv_id long, fragment long, first long, kinds string, illegal long, opening string, closing string, costs array<long>, orders array<long>"
    fragments = stored(fragments.select("conv_id", "fragment", "first", text("k").alias("kinds"), text("initial").alias("initials")).mapInArrow(_each(summarise, shape), shape), "fragments")
    parts = fragments.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("fragment", "opening", "closing", "illegal", "costs", "orders"))).alias("p"))
    shape = "conv_id long, fragments array<long>, states array<long>, cost long, illegal long"

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [meet(c, *([x[k] for x in p] for k in ("fragment", "opening", "closing", "illegal", "costs", "orders"))) for c, p in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_types(shape))], names=[f.split(" ")[0] for f in shape.split(", ")])

    crossings = stored(parts.mapInArrow(met, shape), "crossings")
    between = crossings.select("conv_id", "states", F.posexplode("fragments").alias("i", "fragment"), (F.size("fragments") - 1).alias("top"))
    between = between.select(F.col("conv_id").alias("c"), F.col("fragment").alias("f"), F.expr("states[i]").alias("before"), F.expr("states[i + 1]").alias("after"), F.col("i").eqNullSafe(F.col("top")).alias("is_last"))
    shape2 = "conv_id long, fragment long, first long, audit string, written array<string>"
    done = fragments.join(between, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("fragment") == F.col("f"))).select("conv_id", "fragment", "first", "kinds", "before", "after", "is_last")
    done = stored(done.mapInArrow(_each(edits_of, shape2), shape2), "edits")
    edits = done.select("conv_id", "first", F.posexplode("written").alias("i", "written")).select("conv_id", (F.col("first") + F.col("i")).alias("pos"), "written")
    audits = done.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fragment", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    is_fault = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    report = found.groupBy("conv_id").agg(gaps.alias("gaps"), is_fault("blank"), is_fault("duplicate"), is_fault("truncated"))
    for more in (crossings.select("conv_id", "illegal", "cost"), audits, digests(rows, edits)):
        more = more.withColumnRenamed("conv_id", "c")
        report = report.join(more, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    return report, edits


def repaired(conversations: DataFrame, fragment_bits: int = FRAGMENT_BITS) -> DataFrame:
    """One row for each conv_id of conversations, which are damaged first: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A null conv_id is a conversation like any other; null turns come first and count for no gap; a repeated row is a
    duplicate; very long texts are taken whole (the digest of role and text tells repeats); further columns are ignored;
    a conversation without rows after the damage has zeros, an empty audit and the digest of nothing; an empty table gives none.
    """
    every = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    report, _ = repair(damaged(conversations), fragment_bits)
    found = every.join(report, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("id", "conv_id")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_structure_repair(spark, sf_dir):
    return repaired(table(spark, sf_dir, "conversations"))


def _sql() -> str:
    """DuckDB: crc32 bit by bit, faults by windows, and a recursion over a conversation's rows that keeps whole edits and texts for each state."""
    far = "{'c': 1000000000000::BIGINT, 'a': '', 'r': ''}"

    def then(state: str, cost: str, edits: str, lines: str) -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edits}', 'r': {state}.r || {lines}}}"

    nl = "chr(10)"
    user, assistant = f"{nl} || 'user:'", f"{nl} || 'assistant:'"
    inserted = {2: ["s2", *(then(f"s{p}", "3", "I", user) for p in (0, 1, 3)), then("s2", "6", "II", f"{assistant} || {user}")], 3: ["s3", then("s2", "3", "I", assistant), *(then(f"s{p}", "6", "II", f"{user} || {assistant}") for p in (0, 1, 3))]}
    gone = lambda s: then(s, "4", "D", "''")
    some = lambda when, value: f"CASE WHEN {when} THEN {value} ELSE {far} END"
    keep = lambda s, i: some(f"stays AND initial = '{i}'", then(s, "cut", "K", f"{nl} || role || ':' || text"))
    anew = lambda s, role: some("stays", then(s, "cut + 3", "R", f"{role} || text"))
    after = [gone("s0"), f"list_min([{gone('s1')}, {keep('s0', 's')}])", f"list_min([{gone('u2')}, {', '.join(keep(s, 'u') for s in ('s0', 's1', 'u3'))}, {', '.join(anew(s, user) for s in ('s0', 's1', 'u3'))}])", f"list_min([{gone('u3')}, {keep('u2', 'a')}, {anew('u2', assistant)}])"]
    white = r"[\x20\x09-\x0D]"
    return rf"""
WITH named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
crc AS (
  WITH RECURSIVE go AS (
    SELECT DISTINCT s, 0 AS i, 4294967295::UBIGINT AS c FROM named
    UNION ALL
    SELECT s, i + 1, CASE WHEN i % 9 = 0 THEN xor(c, ascii(substr(s, i // 9 + 1, 1))::UBIGINT) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END FROM go WHERE i < 9 * length(s))
  SELECT s, xor(c, 4294967295::UBIGINT) % 20 AS fate FROM go WHERE i = 9 * length(s)),
damaged AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM named JOIN crc USING (s), unnest(CASE fate WHEN 3 THEN [1, 2] ELSE [1] END) WHERE fate <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?]{white}*\z') THEN 'truncated' END AS fault,
    left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS former FROM placed),
rows AS (SELECT *, fault IS NULL OR fault = 'truncated' AS stays, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS cut FROM faults),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE n > 1 AND former || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n FROM rows GROUP BY conv_id),
walk AS (
  WITH RECURSIVE go AS (
    SELECT conv_id, 0::BIGINT AS n, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS s0, {far} AS s1, {far} AS s2, {far} AS s3 FROM counts
    UNION ALL
    SELECT conv_id, n, {', '.join(f'{x} AS s{i}' for i, x in enumerate(after))}
    FROM (SELECT g.conv_id, r.n, r.role, r.text, r.initial, r.stays, r.cut, s0, s1, list_min([{', '.join(inserted[2])}]) AS u2, list_min([{', '.join(inserted[3])}]) AS u3
          FROM go g JOIN rows r ON r.conv_id IS NOT DISTINCT FROM g.conv_id AND r.n = g.n + 1))
  SELECT conv_id, n, list_min([s0, s3, {then('s2', '3', 'I', assistant)}, {then('s1', '6', 'II', f'{user} || {assistant}')}]) AS best FROM go)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  CAST(coalesce(w.best.c, 0) AS BIGINT) AS cost, coalesce(w.best.a, '') AS audit, sha256(coalesce(substr(w.best.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM o.conv_id AND w.n = c.n
"""


OP12_SQL = _sql()
