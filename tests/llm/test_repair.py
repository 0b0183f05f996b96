import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from strataforge.llm import repair

ROWS = "conv_id long, turn long, role string, text string, conv string, at long, tie long, rows string, open boolean, present_ boolean"


def every_audit(rows, marks):
    """All (cost, audit, result) of edits with at most two insertions in a place."""
    extra = [()] + [x for n in (1, 2) for x in itertools.product("ua", repeat=n)]
    options = []
    for (role, text), mark in zip(rows, marks, strict=True):
        own = [(3, "D", [])]
        if mark not in ("blank", "duplicate"):
            cut = mark == "truncated"
            own += [(0 + cut, "K", [(role, text)]), (2 + cut, "R", [("user", text)]), (2 + cut, "R", [("assistant", text)])]
        options.append([(2 * len(x) + c, "I" * len(x) + a, [({"u": "user", "a": "assistant"}[y], "") for y in x] + out) for x in extra for c, a, out in own])
    options.append([(2 * len(x), "I" * len(x), [({"u": "user", "a": "assistant"}[y], "") for y in x]) for x in extra])
    for way in itertools.product(*options):
        out = [t for _, _, o in way for t in o]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)):
            yield sum(c for c, _, _ in way), "".join(a for _, a, _ in way), out


def marks_of(rows):
    out = []
    for i, (role, text) in enumerate(rows):
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not last else "duplicate" if (role, text) in rows[:i] else None if last[-1] in ".!?" else "truncated")
    return out


def expected(rows):
    """rows: (turn, role, text) in order -> the contract's columns."""
    pairs = [(r, t) for _, r, t in rows]
    marks, turns = marks_of(pairs), {t for t, _, _ in rows if t is not None}
    cost, audit, out = min(every_audit(pairs, marks), key=lambda x: x[:2]) if len(rows) < 4 else dynamic(pairs, marks)
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(pairs))
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[marks.count(m) for m in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def dynamic(rows, marks):
    """The same by a table over rows and the role orders allowed so far, with all ways to go on."""
    best = {"": (0, "", [])}  # what may follow is told by "", "s", "u" or "a"
    go = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    name = {"u": "user", "a": "assistant"}

    def better(table, key, way):
        if key not in table or way[:2] < table[key][:2]:
            table[key] = way

    def inserted(table):
        for _ in range(2):
            for s, (c, a, o) in list(table.items()):
                for x in "ua":
                    if (s, x) in go:
                        better(table, x, (c + 2, a + "I", [*o, (name[x], "")]))
        return table

    for (role, text), mark in zip(rows, marks, strict=True):
        new = {}
        for s, (c, a, o) in inserted(best).items():
            better(new, s, (c + 3, a + "D", o))
            if mark not in ("blank", "duplicate"):
                cut = mark == "truncated"
                if (s, role[:1]) in go:
                    better(new, role[:1], (c + cut, a + "K", [*o, (role, text)]))
                for x in "ua":
                    if (s, x) in go:
                        better(new, x, (c + 2 + cut, a + "R", [*o, (name[x], text)]))
        best = new
    return min((way for s, way in inserted(best).items() if s in ("", "a")), key=lambda w: w[:2])


def random_rows(rng, n, conv):
    texts = ["Yes.", "No!", "cut off", "why?  ", " \n", "", "a. b", "Ünï."]
    return [(conv, rng.choice([None, *range(-2, 2 * n)]), rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", "useless"]), rng.choice(texts)) for _ in range(n)]


def ordered(rows):
    at = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3][:64].encode(), hashlib.md5(r[3].encode()).hexdigest())
    return [r[1:] for r in sorted(rows, key=at)]


def test_search_equals_all_edits():
    rng = random.Random(5)
    for i in range(150):
        rows = [r[2:] for r in random_rows(rng, i % 4, 1)]
        marks = marks_of(rows)
        assert repair.faults(rows) == marks
        cost, audit, out = min(every_audit(rows, marks), key=lambda x: x[:2])
        ((c, a),) = repair.search([r[:1] for r, _ in rows], marks, repair.NONE, True).values()
        assert (c, a) == (cost, audit) and repair.applied(rows, a) == out and dynamic(rows, marks) == (cost, audit, out)


def test_heuristic_is_exact_where_nothing_else_is_wrong():
    rows = [("user", "Hi."), ("assistant", "Yes."), ("user", ""), ("user", "and"), ("assistant", "Go.")]
    assert repair.search([r[0] for r, _ in rows], repair.faults(rows), repair.NONE, True) == {repair.ASSISTANT: (4, "KKDKK")}


@pytest.mark.parametrize("piece", [1, 3, 512])
def test_whole_operator(spark, monkeypatch, piece):
    """Conversations over many ranges and pieces: the same as the table over the whole conversation."""
    monkeypatch.setattr(repair, "PIECE", piece)
    monkeypatch.setattr(repair, "ROWS", 40)
    rng = random.Random(piece)
    rows = [r for c in range(40) for r in random_rows(rng, rng.choice([1, 2, 5, 9]), c)] + random_rows(rng, 120, None) + random_rows(rng, 150, 77)
    df = spark.createDataFrame([(*r, "c", 1, 2, "r", True, False) for r in rows], ROWS).repartition(7)
    got = {r.conv_id: tuple(r)[1:] for r in repair.digests(repair.repair(df)).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert got == {c: expected(ordered(own)) for c, own in by.items()}


def test_odd_tables(spark):
    long = "word " * 200_000
    odd = [(None, None, None, None), (1, None, "user", long), (1, None, "user", long), (2, 1, None, "a."), (3, 9223372036854775807, "user", "b."), (4, 1, "user", "c."), (4, 1, "user", "c."), (4, 1, "user", "c.")]
    df = spark.createDataFrame([(*r, "c", 1, 2, "r", True, i == 5) for i, r in enumerate(odd)], ROWS)
    got = {r.conv_id: r for r in repair.digests(repair.repair(df)).collect()}
    assert (got[None].blank, got[None].cost, got[None].audit, got[None].repaired_sha256) == (1, 3, "D", hashlib.sha256(b"").hexdigest())
    assert (got[1].duplicate, got[1].truncated, got[1].cost, got[1].audit) == (1, 1, 6, "DD") and got[2].audit == "D"
    assert (got[4].duplicate, got[4].illegal, got[4].cost, got[4].audit) == (2, 2, 8, "KDDI")
    none = {r.conv_id: r for r in repair.digests(repair.repair(df, present=F.col("present_"))).collect()}
    assert none[2].audit == "" and none[2].cost == 0 and none[2].repaired_sha256 == hashlib.sha256(b"").hexdigest() and none[3].gaps == 0
    assert repair.repair(df.limit(0)).count() == 0


def test_equal_rows_fill_many_ranges(spark, monkeypatch):
    """A conversation of one row, repeated: no range takes it all, and every row but the first is a duplicate."""
    monkeypatch.setattr(repair, "ROWS", 500)
    df = spark.range(6000).select(F.lit(1).alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), F.lit("Same.").alias("text"))
    pieces = repair.repair(df)
    assert pieces.count() >= 12 and pieces.selectExpr("max(length(audit))").first()[0] <= repair.PIECE + 2
    row = repair.digests(pieces).first()
    assert (row.duplicate, row.illegal, row.cost, row.audit) == (5999, 5999, 17999, "K" + "D" * 5999 + "I")


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        space = lambda v: " " if v is None else str(v)
        kind, role, text = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20, space(role), space(text)
        out += [] if kind == 0 else [(conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (2 if kind == 3 else 1)
    return out


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    by = {c: [] for c, *_ in rows}
    for r in brute_damage(rows):
        by[r[0]].append(r)
    got = {r.conv_id: tuple(r)[1:] for r in repair.op12_repair(spark, sf).collect()}
    assert got == {c: expected(ordered(own)) for c, own in by.items()}
    assert any(v[5] for v in got.values())


def test_sql_says_the_same(spark):
    db, sf = duckdb.connect(), "/root/testdata/sf0.01"
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = repair.op12_repair(spark, sf)
    want = sorted(map(str, db.execute(repair.OP12_SQL).df()[got.columns].itertuples(index=False, name=None)))
    assert sorted(str(tuple(r)) for r in got.collect()) == want
