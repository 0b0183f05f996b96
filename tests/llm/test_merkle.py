import hashlib
import zlib

import duckdb
from pyspark.sql import functions as F

from strataforge.llm import common, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, path string, root string, i long, g long, hash string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def of(r, more=0):
    values = [r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def trail(level, i, fanout):
    """(root, [(before, after)]) of node i of a list of digests."""
    path = []
    while len(level) > 1:
        begin = i // fanout * fanout
        run = level[begin : begin + fanout]
        path.append(("".join(run[: i - begin]), "".join(run[i - begin + 1 :])))
        level, i = [sha("".join(level[k : k + fanout])) for k in range(0, len(level), fanout)], i // fanout
    return level[0], path


def brute(rows, fanout):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    order = sorted(by, key=lambda lang: (lang is not None, (lang or "").encode()))
    leaves = {lang: sorted(((r[0] is not None, r[0] or 0), of(r), r) for r in by[lang]) for lang in order} if all(r[4] is not None for r in rows) else {lang: sorted(by[lang], key=lambda r: ((r[0] is not None, r[0] or 0), of(r))) for lang in order}
    leaves = {lang: [x[-1] if len(x) == 3 else x for x in rows_] for lang, rows_ in leaves.items()}
    subroots = [trail([of(r) for r in leaves[lang]], 0, fanout)[0] for lang in order]
    out = []
    for at, lang in enumerate(order):
        root, above = trail(subroots, at, fanout)
        for i, r in enumerate(leaves[lang]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            path = trail([of(x) for x in leaves[lang]], i, fanout)[1] + above
            acc = of(r, 1 if bad else 0)
            for before, after in path:
                acc = sha(before + acc + after)
            out.append((r[0], of(r), subroots[at], root, sha("".join(b + a for b, a in path)), acc, acc == root))
    return out


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=str)


def run(spark, rows, fanout=2):
    df = spark.createDataFrame([(*r, "x", "y", "z", 1, 2, "h") for r in rows], DOCS)
    return rows_of(merkle.verified(df, common.crc_mod("doc_id", 7) == 0, fanout))


def test_every_proof_is_that_of_brute_force(spark):
    langs = ["de", "en", "é", "Z", "", None, "\U0001f600", "￿"]
    rows = [(i, f"text {i} ü" * (i % 4), langs[i % 17 % len(langs)], None if i % 5 == 0 else f"s{i}", i) for i in range(150)]
    for fanout in (2, 3):
        assert run(spark, rows, fanout) == sorted(brute(rows, fanout), key=str)


def test_odd_tables(spark):
    odd = [(None, None, None, None, 4), (None, "", None, None, 4), (7, "a" * 300_000, "en", "s", 1), (7, "b", "en", "s", 1), (8, "same", "en", "s", 4), (8, "same", "en", "s", 4), (8, "same", "en", "s", 4)]
    assert run(spark, odd) == sorted(brute(odd, 2), key=str)
    assert run(spark, []) == [] and run(spark, odd[:1])[0][4] == sha("")
    # n_chars that are null stay null, so nothing is tampered with
    assert all(r[-1] for r in run(spark, [(i, "t", "en", "s", None) for i in range(40)]))
    # equal rows are leaves of their own
    same = [(1, "t", "en", "s", 1)] * 9
    assert run(spark, same) == sorted(brute(same, 2), key=str)


def test_sql_says_the_same(spark):
    db = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = db.execute(merkle.OP13_SQL).df()
    got = merkle.op13_merkle(spark, sf)
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert rows_of(got) == sorted((tuple(r) for r in want[columns].itertuples(index=False)), key=str)


def test_no_window_over_a_group_of_leaves(spark):
    rows = spark.range(20_000).select(F.lit("en").alias("lang"), (F.col("id") % 3).alias("doc_id"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("leaf"))
    assert merkle.manifest(rows).select("root").distinct().count() == 1
