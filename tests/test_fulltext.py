import random
import sqlite3
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataforge.operators import fulltext


def terms(texts):
    """What SQLite's full-text module makes of texts."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(c)")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    db.executemany("INSERT INTO t(rowid, c) VALUES (?, ?)", list(enumerate(texts)))
    out = [[] for _ in texts]
    for term, row in db.execute("SELECT term, doc FROM v ORDER BY doc, offset"):
        out[row].append(term)
    return out


def test_every_letter_and_mark_folds_as_in_sqlite(spark):
    letters = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] in "LMNSP"]
    texts = [f"a{c}b {c} {c}{c}" for c in letters] + ["x".join(letters[i : i + 50]) for i in range(0, len(letters), 50)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.w for r in df.select("id", fulltext.tokens(F.col("text")).alias("w")).collect()}
    assert [got[i] for i in range(len(texts))] == terms(texts)
    assert [fulltext.fold_phrase(t) for t in texts[::7]] == terms(texts[::7])


def test_characters_of_the_further_planes():
    rng = random.Random(1)
    texts = [f"a{chr(rng.randrange(0x20000, 0x110000))}b" for _ in range(2000)]
    assert [fulltext.fold_phrase(t) for t in texts] == terms(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=60))
def test_numbers_come_back(values):
    data, ends = fulltext.encoded(np.array(values, np.uint64))
    assert fulltext.decoded(data.tobytes()).tolist() == values and (not values or ends[-1] == len(data))


def plain(docs, phrase):
    n = len(phrase)
    return {i: c for i, d in enumerate(docs) if (c := sum(d[j : j + n] == phrase for j in range(len(d) - n + 1)))}


@pytest.mark.parametrize("size", [1, 3, 512])
def test_phrases_from_blocks(monkeypatch, size):
    monkeypatch.setattr(fulltext, "DOCS", size)
    rng = random.Random(size)
    docs = [[rng.choice("a b c d e the of rare".split()[: rng.choice([2, 5, 8])]) for _ in range(rng.choice([0, 1, 7, 40]))] for _ in range(120)]
    blocks = {}
    for token, n, first, last, *coded in fulltext.inverted(docs):
        at, counts, places = fulltext.postings(*coded)
        assert (len(at), at[0], at[-1]) == (n, first, last) and counts.sum() == len(places) and n <= size
        blocks.setdefault(token, []).append((first, last, *coded))
    for phrase in (["a"], ["the", "of"], ["a", "a", "b"], ["none", "a"], ["a", "b", "c"], ["rare", "rare"], ["b", "a", "b", "a"]):
        assert fulltext.frequencies(blocks, phrase) == plain(docs, phrase), phrase


def test_far_blocks_are_not_decoded(monkeypatch):
    monkeypatch.setattr(fulltext, "DOCS", 4)
    docs = [["the"]] * 100 + [["the", "rare"]] + [["the"]] * 100
    blocks, seen = {}, []
    for token, _, first, last, *coded in fulltext.inverted(docs):
        blocks.setdefault(token, []).append((first, last, *coded))
    whole = fulltext.postings
    monkeypatch.setattr(fulltext, "postings", lambda *c: seen.append(1) or whole(*c))
    assert fulltext.frequencies(blocks, ["the", "rare"]) == {100: 1} and len(seen) == 2 and len(blocks["the"]) == 51


TEXTS = ["Replace the servo fuse E-042, servo", "servo E 042 and e-042", "pressure valve", "E-043 042", "señal e-042 réplica", "", "ŝervo fuse ē‑042", None] + [f"filler words here {i}" for i in range(9)]


def ranked(texts, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(content)")
    db.executemany("INSERT INTO t(rowid, content) VALUES (?, ?)", [(i, t) for i, t in texts if t is not None])
    return db.execute("SELECT rowid, rank FROM t WHERE t MATCH ? ORDER BY rank, rowid", (query,)).fetchall()


def same(got, want):
    return [r.id for r in got] == [i for i, _ in want] and all(abs(r["rank"] - w) < 1e-9 for r, (_, w) in zip(got, want, strict=True))


def test_bm25_is_that_of_sqlite_and_stays_so(spark, monkeypatch):
    monkeypatch.setattr(fulltext, "TOKENS", 12)
    texts = [(i, t) for i, t in enumerate(TEXTS) if t is not None]
    rows = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in texts], "id long, content string, token string, segment string, n int").repartition(3)
    index = fulltext.build(rows, ["id"])
    for query, phrases in (('"E-042"', ["E-042"]), ('"servo" "E-042"', ["servo", "E-042"]), ('"the servo fuse"', ["the servo fuse"]), ('"nowhere"', ["nowhere"])):
        assert same(index.bm25([fulltext.fold_phrase(p) for p in phrases], 30).collect(), ranked(texts, query))
    assert {r.id: r.frequency for r in index.holding(["e", "042"]).collect()} == {0: 1, 1: 2, 4: 1, 6: 1}
    # statistics follow deletions and additions
    gone = rows.where("id IN (1, 2, 10)")
    index.delete(gone)
    index.delete(gone)
    left = [(i, t) for i, t in texts if i not in (1, 2, 10)]
    assert same(index.bm25([["e", "042"]], 30).collect(), ranked(left, '"E-042"')) and index.statistics()[0] == len(left)
    index.add(spark.createDataFrame([(50, "E-042 again and again", "a", "b", 1)], rows.schema))
    assert same(index.bm25([["e", "042"]], 30).collect(), ranked([*left, (50, "E-042 again and again")], '"E-042"'))
    plan = index.bm25([["e", "042"]], 30)._jdf.queryExecution().toString()
    assert "content" not in plan and "translate" not in plan


def test_odd_rows(spark):
    rows = spark.createDataFrame([(None, "a b"), (1, None), (1, "a b"), (1, "a b"), (2, "b " * 30_000 + "a b")], "id long, content string")
    index = fulltext.build(rows, ["id"])
    assert sorted((str(r.id), r.frequency) for r in index.holding(["a", "b"]).collect()) == [("1", 1), ("1", 1), ("2", 1), ("None", 1)]
    assert index.statistics() == (5, 30_008)
    index.delete(rows.where("id IS NULL"))
    assert index.statistics()[0] == 4 and index.holding(["a", "b"]).count() == 3
    empty = fulltext.build(rows.limit(0), ["id"])
    assert empty.holding(["a"]).count() == 0 and empty.bm25([["a"]], 3).count() == 0 and empty.statistics() == (0, 0)
