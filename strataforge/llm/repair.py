"""Repair of damaged conversations by A* search on the edit lattice.

A node of the lattice is a row of the conversation that comes next and a state of the automaton of legal role orders.
Edits lead on: keep, rerole, delete, insert. The heuristic is the suffix sum of what no repair avoids: a deletion for each
row that is blank or a duplicate, a charge for each truncated one (which costs that when it stays, more when it goes). It
is consistent, so the first visit of a node is its cheapest, and with the edits so far as the second part of the key it is
also the one whose audit comes first.

Rows are sorted by conversation and turn over ranges, so a conversation's rows lie together and are read in one pass. What
a range holds of a conversation is cut into pieces of at most ``PIECE`` rows. Most conversations are one piece and are done
there. Of the others each piece is searched from each state to each state; the pieces' 4 x 4 costs are then chained, which
gives the repair of the whole: no task holds a conversation. Only the digest of a conversation is made by one task, as a
stream, since SHA-256 can't be cut.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.numbering import ROWS
from . import common

#: Rows of a piece, at most.
PIECE = 512
KEEP, RETYPE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, RETYPE: 2, DELETE: 3, INSERT: 2}
#: Costs of a truncated row that stays.
CUT = 1
#: The automaton of (s?(ua)+)?: nothing yet, system, user, assistant. A state, a role's initial -> the next state.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that an inserted or a reroled row takes in a state.
TURN = {NONE: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
FINAL = (NONE, ASSISTANT)
#: What is inserted after the last row, by state.
CLOSE = {NONE: "", SYSTEM: INSERT * 2, USER: INSERT, ASSISTANT: ""}
LEGAL = frozenset(("su", "ua", "au"))
_WHITE = " \t\n\x0b\x0c\r"
_FAR = 1 << 60


def faults(rows: Sequence[tuple[str, str]], before: frozenset = frozenset()) -> list[str | None]:
    """The first fault of each (role, text): blank, duplicate, truncated or none. before: digests of what came earlier."""
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(_WHITE)
        mark = _digest(role, text) if before else (role, text)
        fault = "blank" if not body else "duplicate" if mark in seen or mark in before else None if body[-1] in ".!?" else "truncated"
        seen.add(mark)
        out.append(fault)
    return out


def _digest(role: str, text: str) -> bytes:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()


def search(initials: Sequence[str], marks: Sequence[str | None], start: int, whole: bool) -> dict[int, tuple[int, str]]:
    """A* from a state before the first row. State after the last row -> (cost, audit) of the best edits.

    whole: edits may go on after the last row and must end in a final state; only that state is returned.
    """
    n = len(marks)
    gone = [m in ("blank", "duplicate") for m in marks]
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (COST[DELETE] if gone[i] else CUT if marks[i] else 0)
    heap = [(rest[0], "", 0, 0, start)]
    done, ends = set(), {}
    while heap:
        _, audit, cost, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        onward = TURN[state]
        if i == n:
            if not whole or state in FINAL:
                ends[state] = cost, audit
                if whole:
                    break
            else:
                heapq.heappush(heap, (cost + COST[INSERT], audit + INSERT, cost + COST[INSERT], n, NEXT[state, onward[0]]))
            continue
        steps = [(DELETE, i + 1, state, 0), (INSERT, i, NEXT[state, onward[0]], 0)]
        if not gone[i]:
            cut = CUT if marks[i] else 0
            steps.append((RETYPE, i + 1, NEXT[state, onward[0]], cut))
            if (state, initials[i]) in NEXT:
                steps.append((KEEP, i + 1, NEXT[state, initials[i]], cut))
        for edit, j, to, more in steps:
            if (j, to) not in done:
                g = cost + COST[edit] + more
                heapq.heappush(heap, (g + rest[j], audit + edit, g, j, to))
    return ends


def applied(rows: Sequence[tuple[str, str]], audit: str, state: int = NONE) -> list[tuple[str, str]]:
    """The (role, text) that the edits leave, from a state on."""
    out, i = [], 0
    for edit in audit:
        if edit == DELETE:
            i += 1
            continue
        role, text = rows[i] if edit == KEEP else (TURN[state], "" if edit == INSERT else rows[i][1])
        i += edit != INSERT
        state = NEXT[state, role[0]]
        out.append((role, text))
    return out


def _initials(rows) -> list[str]:
    return [role[:1] for role, _ in rows]


def _illegal(initials: Sequence[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def _turns(turns: Sequence[int | None]) -> list[int]:
    return sorted({t for t in turns if t is not None})


_LINES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
_ROWS = T.ArrayType(T.StructType([T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
_LONG, _STRING = T.LongType(), T.StringType()
_RESULT = [(c, _LONG) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", _STRING)]
_PIECE = [("at", _LONG), ("open", T.BooleanType()), *_RESULT, ("turns", _LINES), ("rows", _ROWS)]
_SEARCHED = [("at", _LONG), ("size", _LONG), ("blank", _LONG), ("duplicate", _LONG), ("truncated", _LONG), ("illegal", _LONG), ("first", _STRING), ("last", _STRING), ("least", _LONG), ("most", _LONG), ("distinct", _LONG), ("costs", T.ArrayType(_LONG)), ("ranks", T.ArrayType(_LONG)), ("audits", T.ArrayType(_STRING)), ("rows", _ROWS)]
_CHOICE = [("at", _LONG), ("piece", _LONG), ("pieces", _LONG), ("enter", _LONG), ("leave", _LONG), ("gaps", _LONG), ("illegal", _LONG), ("cost", _LONG)]


def _schema(first: Sequence[T.StructField], rest) -> T.StructType:
    return T.StructType([*first, *[T.StructField(name, kind) for name, kind in rest]])


def _count(marks, fault: str) -> int:
    return sum(m == fault for m in marks)


def _done(turns, rows) -> dict:
    marks, initials, held = faults(rows), _initials(rows), _turns(turns)
    ((cost, audit),) = search(initials, marks, NONE, True).values()
    return {
        "gaps": held[-1] - held[0] + 1 - len(held) if held else 0, "blank": _count(marks, "blank"), "duplicate": _count(marks, "duplicate"), "truncated": _count(marks, "truncated"),
        "illegal": _illegal(initials), "cost": cost, "audit": audit, "turns": [{"role": r, "text": t} for r, t in applied(rows, audit)],
    }


def _batched(records: Iterator[tuple[int, dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for weight, record in records:
        held.append(record)
        size += weight + 200
        if size > 4_000_000:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _cut(schema: T.StructType):
    """Sorted rows of a range -> pieces; conversations that lie wholly inside are repaired at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            key, conv, held, size, number, part = None, None, [], 0, 0, TaskContext.get().partitionId()
            begun = False  # whether the held rows go on from an earlier piece; the first conversation may

            def piece(open_: bool):
                nonlocal number
                base = {"conv_id": conv, "conv": key, "at": part << 33 | number, "open": open_}
                number += 1
                here = [(t, r, x) for t, r, x, there in held if there]
                if open_:
                    return size, base | {"rows": [{"turn": t, "role": r, "text": x} for t, r, x in here]}
                return size, base | _done([t for t, _, _ in here], [(r, x) for _, r, x in here])

            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("conv", "conv_id", "turn", "role", "text", "present")]
                for k, c, *row in zip(*columns, strict=True):
                    if k != key:
                        if held:
                            yield piece(begun)
                        begun, held, size = key is None, [], 0
                        key, conv = k, c
                    elif len(held) == PIECE:
                        yield piece(True)
                        begun, held, size = True, [], 0
                    held.append(row)
                    size += len(row[2])
            if held:
                yield piece(True)

        yield from _batched(pieces(), _arrow(schema))

    return run


def _searched(schema: T.StructType):
    """Pieces with what was seen before them -> their costs and audits from each state to each state."""

    def one(conv, conv_id, at, rows, before) -> dict:
        turns, pairs = _turns([r["turn"] for r in rows]), [(r["role"], r["text"]) for r in rows]
        marks, initials = faults(pairs, frozenset(before or (b"",))), _initials(pairs)
        ways = {(a, b): way for a in range(4) for b, way in search(initials, marks, a, False).items()}
        order = {audit: i for i, audit in enumerate(sorted({audit for _, audit in ways.values()}))}
        every = [ways.get((a, b)) for a in range(4) for b in range(4)]
        return {
            "conv": conv, "conv_id": conv_id, "at": at, "size": len(rows), "blank": _count(marks, "blank"), "duplicate": _count(marks, "duplicate"), "truncated": _count(marks, "truncated"),
            "illegal": _illegal(initials), "first": initials[0] if rows else None, "last": initials[-1] if rows else None, "least": turns[0] if turns else None, "most": turns[-1] if turns else None,
            "distinct": len(turns), "costs": [w[0] if w else _FAR for w in every], "ranks": [order[w[1]] if w else 0 for w in every], "audits": [w[1] if w else "" for w in every], "rows": rows,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                for i in range(batch.num_rows):  # a row at a time: each holds up to PIECE texts
                    row = [batch.column(c)[i].as_py() for c in ("conv", "conv_id", "at", "rows", "before")]
                    yield sum(len(r["text"]) for r in row[3]), one(*row)

        yield from _batched(found(), _arrow(schema))

    return run


def _chained(schema: T.StructType):
    """The pieces' costs of a conversation, in order -> the states in which the best repair enters and leaves each piece."""

    def run(key, table):
        table = table.sort_by("at")
        data = {c: table.column(c).to_pylist() for c in ("at", "costs", "ranks", "size", "first", "last", "least", "most", "distinct", "illegal")}
        best, back = {NONE: (0, 0)}, []  # state -> (cost, place of its audit among the states')
        for costs, ranks in zip(data["costs"], data["ranks"], strict=True):
            ways = {}
            for b in range(4):
                each = [((best[a][0] + costs[4 * a + b], best[a][1], ranks[4 * a + b]), a) for a in best if costs[4 * a + b] < _FAR]
                if each:
                    ways[b] = min(each)
            order = {way: i for i, way in enumerate(sorted((w[0][1:] for w in ways.values())))}
            best = {b: (w[0][0], order[w[0][1:]]) for b, w in ways.items()}
            back.append({b: w[1] for b, w in ways.items()})
        _, _, state = min((cost + len(CLOSE[s]) * COST[INSERT], rank, s) for s, (cost, rank) in best.items())
        n, out, at_end = len(back), [], state
        for i in range(n - 1, -1, -1):
            enter = back[i][state]
            out.append((enter, state))
            state = enter
        out.reverse()
        gaps, illegal, last, most, least, distinct = [0] * n, [], None, None, None, 0
        for i in range(n):
            pairs = data["illegal"][i]
            if data["size"][i]:
                pairs += last is not None and last + data["first"][i] not in LEGAL
                last = data["last"][i]
            illegal.append(int(pairs))
            if data["least"][i] is not None:
                distinct += data["distinct"][i] - (data["least"][i] == most)
                least, most = data["least"][i] if least is None else least, data["most"][i]
        gaps[0] = most - least + 1 - distinct if most is not None else 0
        costs = [data["costs"][i][4 * a + b] + (len(CLOSE[at_end]) * COST[INSERT] if i == n - 1 else 0) for i, (a, b) in enumerate(out)]
        columns = [[table.column("conv")[0].as_py()] * n, data["at"], list(range(n)), [n] * n, [a for a, _ in out], [b for _, b in out], gaps, illegal, costs]
        return pa.table(dict(zip(schema.names, columns, strict=True)), schema=_arrow(schema))

    return run


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """Pieces of repaired conversations: conv_id, conv (a key), piece (0, 1, ...), pieces, counts, cost, audit, turns.

    Counts and costs of a conversation's pieces add up, audits and turns join. ``present`` marks the rows that are there
    (default: all); a conversation of others only is one empty piece. Null roles and texts are one space; null turns come
    first, rows of a turn go by role, text's beginning and digest; null conversations are one; repeated rows are
    duplicates, however many; an empty table gives no piece; other columns play no part.
    """
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    role_, text_ = F.coalesce(F.col(role), F.lit(" ")), F.coalesce(F.col(text), F.lit(" "))
    key = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))
    named = rows.select(F.col(conv).alias("conv_id"), key.alias("conv"), F.col(turn).cast("long").alias("turn"), role_.alias("role"), text_.alias("text"), there.alias("present"))
    spark = rows.sparkSession
    order = ["conv", "turn", "role", F.substring("text", 1, 64), F.md5("text"), "tie"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS))
    ranged = named.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    ids = [T.StructField("conv", T.StringType()), T.StructField("conv_id", rows.schema[conv].dataType)]
    schema = _schema(ids, _PIECE)
    pieces = common.materialise(ranged.mapInArrow(_cut(schema), schema), "pieces")
    closed = pieces.where("NOT open").select("conv_id", "conv", F.lit(0).cast("long").alias("piece"), F.lit(1).cast("long").alias("pieces"), *[c for c, _ in _RESULT], "turns")
    # conversations that reach a range's border, or are long
    cut = pieces.where("open").select("conv", "conv_id", "at", "rows")
    mark = F.transform("rows", lambda r: F.unhex(F.md5(F.concat(F.length(r["role"]).cast("string"), F.lit(":"), r["role"], r["text"]))))
    marks = cut.select("conv", "at", F.explode(F.array_distinct(mark)).alias("mark"))
    first = marks.groupBy("conv", "mark").agg(F.min("at").alias("first"))
    before = marks.join(first, ["conv", "mark"]).where("at > first").groupBy("conv", "at").agg(F.collect_list("mark").alias("before"))
    schema = _schema(ids, _SEARCHED)
    searched = cut.join(before, ["conv", "at"], "left").select("conv", "conv_id", "at", "rows", "before")
    searched = common.materialise(searched.mapInArrow(_searched(schema), schema), "searched")
    schema = _schema(ids[:1], _CHOICE)
    chosen = searched.drop("rows", "audits", "conv_id").groupBy("conv").applyInArrow(_chained(schema), schema)
    met = searched.drop("illegal").join(chosen, ["conv", "at"])
    end = F.when(F.col("piece") == F.col("pieces") - 1, F.element_at(F.array(*[F.lit(CLOSE[s]) for s in range(4)]), (F.col("leave") + 1).cast("int"))).otherwise("")
    audit = F.concat(F.element_at("audits", (4 * F.col("enter") + F.col("leave") + 1).cast("int")), end)
    edited = _edited(F.col("rows"), audit, F.col("enter"))
    counts = [c for c, _ in _RESULT if c != "audit"]
    opened = met.select("conv_id", "conv", "piece", "pieces", *counts, audit.alias("audit"), edited.alias("turns"))
    return closed.unionByName(opened)


@F.udf(_LINES)
def _edited(rows, audit, enter):
    return applied([(r["role"], r["text"]) for r in rows], audit, enter)


_SUMS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _streamed(schema: T.StructType):
    """Sorted pieces of conversations -> a row per conversation; a conversation's texts pass, they are not held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole():
            record, digest, audits = None, None, []
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                    if record is None or row["conv"] != record["conv"]:
                        if record:
                            yield 0, record | {"audit": "".join(audits), "repaired_sha256": digest.hexdigest()}
                        record, digest, audits, begun = {"conv": row["conv"], "conv_id": row["conv_id"]} | dict.fromkeys(_SUMS, 0), hashlib.sha256(), [], False
                    for c in _SUMS:
                        record[c] += row[c]
                    audits.append(row["audit"])
                    for t in row["turns"]:
                        digest.update((("\n" if begun else "") + t["role"] + ":" + t["text"]).encode("utf-8", "surrogatepass"))
                        begun = True
            if record:
                yield 0, record | {"audit": "".join(audits), "repaired_sha256": digest.hexdigest()}

        yield from _batched(whole(), _arrow(schema))

    return run


def digests(pieces: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    columns = ["conv_id", *_SUMS, "audit", "repaired_sha256"]
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    single = pieces.where("pieces = 1").withColumn("repaired_sha256", F.sha2(line, 256)).select(*columns)
    schema = _schema([pieces.schema["conv"], pieces.schema["conv_id"]], [*_RESULT, ("repaired_sha256", _STRING)])
    long = pieces.where("pieces > 1").repartition("conv").sortWithinPartitions("conv", "piece").mapInArrow(_streamed(schema), schema)
    return single.unionByName(long.select(*columns))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by the crc32 of conversation and turn; ``present`` is false where a row is dropped."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), (kind != 0).alias("present"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("time", "times")


def op12_repair(spark, sf_dir):
    rows = damaged(common.table(spark, sf_dir, "conversations"))
    return digests(repair(rows, present=F.col("present")))


def _more(way: str, cost: int, edit: str) -> str:
    """A way (ten digits of cost, then the audit) with one edit more; null stays null."""
    return f"lpad(CAST(CAST(left({way}, 10) AS BIGINT) + {cost} AS VARCHAR), 10, '0') || substr({way}, 11) || '{edit}'"


def _step_sql(cut: str) -> dict[str, str]:
    """The states' best ways after a row, from those before it with insertions made (n, s, u, a)."""
    keep = lambda way, initial: f"CASE WHEN free AND initial = '{initial}' THEN {_more(way, cut, KEEP)} END"
    turn = lambda way: f"CASE WHEN free THEN {_more(way, f'2 + {cut}', RETYPE)} END"
    gone = lambda way: _more(way, COST[DELETE], DELETE)
    return {
        "n": gone("n"), "s": f"least({gone('s')}, {keep('n', 's')})",
        "u": f"least({', '.join([gone('u'), *[f(w) for w in 'nsa' for f in (lambda w: keep(w, 'u'), turn)]])})", "a": f"least({gone('a')}, {keep('u', 'a')}, {turn('u')})",
    }


_STEP = _step_sql("cut")
_INSERTED = f"SELECT *, least(a0, {_more('u', 2, INSERT)}) AS a FROM (SELECT *, least(u0, {_more('n', 2, INSERT)}, {_more('s', 2, INSERT)}, {_more('a0', 2, INSERT)}) AS u FROM {{}})"
_NEXT_SQL = "CASE WHEN state = 'u' THEN 'a' ELSE 'u' END"

#: CRC-32 by its polynomial; the best way to each state by recursion over rows, then the rows that the audit leaves.
OP12_SQL = f"""
WITH RECURSIVE bits(b, k, v) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
kinds AS (SELECT named.*, xor(list_reduce(list_transform(range(1, length(id) + 1), lambda p: CAST(ascii(substr(id, p, 1)) AS BIGINT)), lambda a, c: xor(a >> 8, t[1 + xor(a & 255, c)]), 4294967295::BIGINT), 4294967295) % 20 AS kind FROM named, crc),
broken AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, count(*) OVER (PARTITION BY conv_id) AS size FROM broken),
marked AS MATERIALIZED (SELECT *, left(role, 1) AS initial, NOT blank AND NOT duplicate AS free, CASE WHEN NOT blank AND NOT duplicate AND body NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS cut
  FROM (SELECT *, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate FROM (SELECT *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS body FROM placed))),
ways(conv_id, i, n, s, u0, a0) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '0000000000', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM marked
  UNION ALL
  SELECT w.conv_id, m.i, {_STEP["n"]}, {_STEP["s"]}, {_STEP["u"]}, {_STEP["a"]}
  FROM ({_INSERTED.format("ways")}) w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1),
best AS MATERIALIZED (SELECT w.conv_id, CAST(left(least(n, a), 10) AS BIGINT) AS cost, substr(least(n, a), 11) AS audit FROM ({_INSERTED.format("ways")}) w JOIN (SELECT DISTINCT conv_id, size FROM placed) p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.size = w.i),
walk(conv_id, audit, k, i, state, line) AS (
  SELECT conv_id, audit, 0, 0::BIGINT, '', NULL::VARCHAR FROM best
  UNION ALL
  SELECT w.conv_id, w.audit, w.k + 1, CASE WHEN edit = 'I' THEN w.i ELSE w.i + 1 END,
         CASE edit WHEN 'D' THEN state WHEN 'K' THEN m.initial ELSE {_NEXT_SQL} END,
         CASE edit WHEN 'D' THEN NULL WHEN 'K' THEN m.role || ':' || m.text ELSE CASE WHEN {_NEXT_SQL} = 'u' THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE m.text END END
  FROM (SELECT *, substr(audit, k + 1, 1) AS edit FROM walk WHERE k < length(audit)) w LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS text FROM walk GROUP BY conv_id),
pairs AS (SELECT conv_id, coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS bad, * EXCLUDE (conv_id) FROM marked),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, CAST(sum(cut) AS BIGINT) AS truncated, count(*) FILTER (bad) AS illegal FROM pairs GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""
