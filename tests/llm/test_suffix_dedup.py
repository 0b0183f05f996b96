import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from strataforge.llm import suffix_dedup as sd

DOCS = "doc_id long, text string, lang string, key string, data string, own string, row int, bits string, slice long"


def brute(texts, length):
    """For each text (n_bytes, n_removed, n_spans, sha256 of what remains)."""
    windows = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if windows[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def corpus(rng, n, length):
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(60)]
    passages = [" ".join(rng.choices(words, k=length // 2)) for _ in range(6)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 3 * length))) for _ in range(n)]
    for i in range(n):
        for _ in range(rng.choice([0, 0, 2, 3])):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            at = rng.randrange(len(texts[i]) + 1)
            texts[i] = texts[i][:at] + p[a : a + rng.randint(1, 2 * length)] + texts[i][at:]
    texts += [texts[0], texts[1], texts[1], "x" * (3 * length), "ab" * length, "\0" * (length + 1), "\0" * (length - 1) + "q", "", "z" * (length - 1)]
    return texts


@pytest.mark.parametrize("length", [3, 12, 50, 200, 300])
def test_collection_equals_brute_force(tmp_path, length):
    rng = random.Random(length)
    strings = sorted({t.encode() for t in corpus(rng, 25, length)} - {b""})
    strings = [s for s in strings if len(s) >= length]
    times = [rng.choice([1, 1, 1, 2]) for _ in strings]
    windows = Counter()
    for s, n in zip(strings, times, strict=True):
        for i in range(len(s) - length + 1):
            windows[s[i : i + length]] += n
    got = sd.Collection(strings, length, str(tmp_path)).repeated(times, length)
    for s, found in zip(strings, got, strict=True):
        assert found.tolist() == [windows[s[i : i + length]] > 1 for i in range(len(s) - length + 1)]


def test_transform_is_that_of_the_sorted_suffixes(tmp_path):
    strings = [b"banana", b"bananas", b"nab", b"a"]
    c = sd.Collection(strings, 200, str(tmp_path))
    bwt, lcp = c.build()
    docs = [(s, p) for s in strings for p in range(c.width) if p < len(s)]
    entries = [((b"", d), None) for d in range(len(docs))]
    whole = []
    for d, (s, p) in enumerate(docs):
        for start in range(p, len(s), c.width):
            whole.append((s[start:] + b"\0" * (-(len(s) - start) % c.width), d, s[start - c.width : start] if start > p else None))
    whole.sort(key=lambda x: (x[0], x[1]))
    prefix = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    n = len(docs)
    assert len(bwt) == n + len(whole) and len(entries) == n
    assert [int(x) for x in lcp[n + 1 :]] == [prefix(a[0], b[0]) for a, b in zip(whole, whole[1:], strict=False)]
    before = [int(c.values[x]).to_bytes(c.width, "big") if x else None for x in bwt[n:]]
    assert before == [x[2] for x in whole]


def test_anchors_do_not_depend_on_the_other_texts(monkeypatch):
    monkeypatch.setattr(sd, "_BLOCK", 700)
    rng = random.Random(1)
    texts = [t.encode() for t in corpus(rng, 30, 60)]
    together = sd.anchors(texts, 60)
    apart = [np.concatenate(x) for x in zip(*[sd.anchors([t], 60) for t in texts], strict=True)]
    for a, b in zip(together[1:], apart[1:], strict=True):
        assert a.tolist() == b.tolist()
    # runs of a text follow one another and cover all its windows
    for i, t in enumerate(texts):
        own = together[0] == i
        assert together[2][own].sum() == max(len(t) - 59, 0) and together[1][own].tolist() == (np.cumsum(together[2][own]) - together[2][own]).tolist()


@pytest.mark.parametrize(("length", "crowd"), [(40, 8 << 20), (40, 60), (200, 8 << 20), (200, 400)])
def test_whole_operator(spark, monkeypatch, length, crowd):
    """A small ``crowd`` has every anchor halved, down to single windows."""
    monkeypatch.setattr(sd, "ANCHOR_BYTES", crowd)
    monkeypatch.setattr(sd, "SHARD_BYTES", 4000)
    texts = corpus(random.Random(length), 60, length)
    rows = [(i if i % 7 else None, t, "en", "k", "d", "o", 1, "b", 2) for i, t in enumerate(texts)] + [(-1, None, None, None, None, None, None, None, None)]
    got = sd.digests(spark.createDataFrame(rows, DOCS).repartition(5), length).collect()
    want = brute([(r[1] or "").encode() for r in rows], length)
    assert sorted(map(str, map(tuple, got))) == sorted(str((r[0], *w)) for r, w in zip(rows, want, strict=True))
    assert any(w[2] > 1 for w in want) and any(w[1] == 0 and w[0] > length for w in want)


def test_columns_stay_and_tables_may_be_empty(spark):
    text = "wörter " * 60
    df = spark.createDataFrame([(1, text, "a", "k", "d", "o", 1, "b", 2), (2, text, "a", "k", "d", "o", 1, "b", 2), (3, None, "a", "k", "d", "o", 1, "b", 2)], DOCS)
    got = sd.remove_repeats(df)
    assert got.columns == [*df.columns, "kept", "spans"] and {r.doc_id: bytes(r.kept) for r in got.collect()} == {1: b"", 2: b"", 3: b""}
    assert sd.remove_repeats(df.limit(0)).count() == 0 and sd.digests(df.where("doc_id = 3")).first().n_removed == 0


def test_long_text(spark):
    rng = random.Random(3)
    long = "".join(rng.choices("abcdefgh ", k=1_200_000))
    passage = long[600_000:600_500]
    df = spark.createDataFrame([(1, long, *"aaaa", 1, "b", 2), (2, f"before {passage} after", *"aaaa", 1, "b", 2)], DOCS)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in sd.digests(df).collect()}
    assert got == {1: (500, 1), 2: (500, 1)}


def test_sql_says_the_same(spark):
    db, sf = duckdb.connect(), "/root/testdata/sf0.001"
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = sorted(map(str, db.execute(sd.OP11_SQL).df()[columns].itertuples(index=False, name=None)))
    assert sorted(str(tuple(r)) for r in sd.op11_suffix_dedup(spark, sf).select(*columns).collect()) == want
