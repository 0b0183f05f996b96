import random
import sqlite3

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataforge.operators import catalog, chunking, export, headers, numbering, search


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. ?!\n😀", max_size=300), st.integers(2, 40), st.data())
def test_chunks(text, size, data):
    overlap = data.draw(st.integers(0, size // 2))
    chunks = chunking.chunk_text(text, size, overlap)
    assert all(c and c == c.strip() and len(c) <= size and c in text for c in chunks)
    assert (not chunks) == (not text.strip())
    kept = "".join(chunks)
    assert set(text) - set(" \n") <= set(kept)


def test_chunk_boundaries():
    assert chunking.chunk_text("x" * 512) == ["x" * 512]
    assert [len(c) for c in chunking.chunk_text("x" * 513)] == [512, 65]
    # a paragraph end wins over a nearer sentence end
    text = "a" * 300 + "\n\n" + "b" * 100 + ". " + "c" * 300
    assert chunking.chunk_text(text)[0] == "a" * 300
    assert chunking.chunk_text("a" * 400 + "? " + "b" * 400)[0] == "a" * 400 + "?"
    assert chunking.chunk_text(None) == chunking.chunk_text(" \n\t") == []


def test_keyword_terms_and_scores(spark):
    assert search.keyword_terms(" grease  the\tpump ") == ["grease", "the", "pump"]
    assert search.keyword_terms("x pump y") == ["pump"]
    assert search.keyword_terms(" Q ") == ["Q"] and search.keyword_terms(" ") == [""]
    assert search.score_steps(8)[1] == 0.1237 and search.score_steps(8)[7] == 0.8662
    cases = [("Alarm P_17%: swap the seal.", "p_17%", 1.0), ("Alarm P917x", "p_17%", 0.0), ("Oil the PUMP daily.", "pump seal", 0.495), ("A seal for that pump.", "pump seal", 0.99), ("No match here", "p17", 0.0), ("anything", " ", 1.0)]
    for content, query, wanted in cases:
        assert spark.range(1).select(search.keyword_score(F.lit(content), query).alias("s")).first().s == wanted


def test_keyword_search_ranks_all_candidates(spark):
    rows = spark.createDataFrame([(i, "the valve" if i == 900 else "the pump") for i in range(1000)], "id long, content string")
    assert [r.id for r in search.keyword_search(rows, "the valve", 3, "id").collect()] == [900, 0, 1]
    got = search.keyword_batch(rows, ["the valve", "pump"], 2, "id").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r.score) for r in got] == [(0, 900, 1.0), (0, 0, 0.495), (1, 0, 1.0), (1, 1, 1.0)]


def test_many_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BATCH", 7)
    rng = random.Random(6)
    words = ["pump", "pumps", "um", "a", "the valve", "valve", "É", "x.y", "", "p_1", "%"]
    rows = [(i, " ".join(rng.choices([*words, "PUMP", "seal", "é"], k=rng.randint(0, 6))), "l", "h", 1) for i in range(80)] + [(80, None, "l", "h", 1)]
    df = spark.createDataFrame(rows, "id long, content string, low string, hit string, terms int")
    queries = [" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(25)] + [" ", "pump pump zz"]
    got = {}
    for r in search.keyword_batch(df, queries, 4, "id").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    for i, q in enumerate(queries):
        want = search.keyword_search(df.where("content IS NOT NULL"), q, 4, "id").collect()
        assert sorted(got.get(i, [])) == [(n, r.id, r.score) for n, r in enumerate(want, 1)], q
    phrases = spark.createDataFrame([(i, q.strip().lower()) for i, q in enumerate(queries)] + [(99, None), (None, "pump")], "item long, phrase string")
    hits = sorted((str(r.item), r.id) for r in search.phrase_hits(df, phrases, "item", "phrase", "content").collect())
    assert hits == sorted((str(p.item), i) for p in phrases.collect() if p.phrase is not None for i, t, *_ in rows if t is not None and p.phrase in t.lower())
    assert search.phrase_hits(df, phrases.limit(0), "item", "phrase", "content").count() == 0


def test_vector_queries_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5), 1.0], 0, 0) for i in range(90)], "id long, embedding array<double>, distance int, place int").drop("distance")
    asked = rows.where("id % 3 = 0").selectExpr("id AS query_id", "embedding AS query")
    one = sorted(map(str, search.semantic_batch(rows, asked, 4, "id").select("query_id", "rank", "id").collect()))
    monkeypatch.setattr(search, "BATCH", 8)
    assert sorted(map(str, search.semantic_batch(rows, asked, 4, "id").select("query_id", "rank", "id").collect())) == one and len(one) == 120


def test_numbers_within_groups(spark, monkeypatch):
    monkeypatch.setattr(numbering, "ROWS", 50)
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]) if i % 3 else "hot", rng.choice([None, *range(20)]), i, 1, 2) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, o long, id long, at int, part int").repartition(5)
    got = numbering.numbered(df, ["g"], ["o", "id"], "number", "total").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        by.setdefault(r[0], []).append(r[2])
    assert {(r.g, r.id): (r.number, r.total) for r in got} == {(g, i): (n, len(own)) for g, own in by.items() for n, i in enumerate(own, 1)}
    assert numbering.numbered(df.limit(0), ["g"], ["o"], "number").count() == 0
    # equal rows are numbered too, in any order, and lie in several ranges
    same = spark.range(0, 400, 1, 4).selectExpr("1 AS g", "1 AS o")
    assert sorted(r.n for r in numbering.numbered(same, ["g"], ["o"], "n").collect()) == list(range(1, 401))
    assert numbering.ranged(same, "g", "o", name="k").selectExpr("shiftright(k, 33) AS p").groupBy("p").count().selectExpr("max(count)").first()[0] < 200
    assert [r.n for r in numbering.numbered(df, [], [F.desc("id")], "n").orderBy("n").limit(2).collect()] == [1, 2]


def test_semantic_search(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [2.0, 0.0]), (5, [-1.0, 0.0])], "id long, embedding array<float>")
    assert [(r.id, r.score) for r in search.semantic_search(rows, [1.0, 0.0], 9, "id").collect()] == [(1, 1.0), (4, 1.0), (5, -1.0)]


def test_repeated_lines(spark):
    pages = spark.createDataFrame([("d", i, f"ACME manual page {i}\nbody {'abcde'[i]}") for i in range(1, 5)] + [("e", 1, "ACME manual page 1\nx"), ("e", 2, " ")], "doc_id string, page_number int, text string")
    joined = headers.join_pages(pages)
    got = {r.doc_id: r.text for r in headers.remove_repeated_lines(joined).collect()}
    assert got["d"] == "body b\n\nbody c\n\nbody d\n\nbody e"
    assert got["e"] == "[Page 1]\nACME manual page 1\nx"
    marked = {r.doc_id: r.text for r in headers.remove_repeated_lines(joined, keep_page_markers=True).collect()}
    assert marked["d"].startswith("[Page 1]\nbody b\n\n[Page 2]")
    assert "Exchange" not in headers.remove_repeated_lines(spark.createDataFrame([("d", 3, "x")], "doc_id string, pages int, text string"))._jdf.queryExecution().executedPlan().toString()


def test_sqlite_file(tmp_path):
    docs = [("a", "pump.txt", "txt", 2), ("b", "crane.md", "md", 1)]
    texts = ["Alarm P-17: swap the seal of the pump.", "Alarm P-18: look at the valve.", "The crane lifts two tons."]
    data = export.build_sqlite(docs, [(1, "a", 0, texts[0]), (2, "a", 1, texts[1]), (3, "b", 0, texts[2])], "now")
    (tmp_path / "x.db").write_bytes(data)
    db = sqlite3.connect(tmp_path / "x.db")
    assert db.execute("SELECT id, file_type, chunk_count FROM documents ORDER BY id").fetchall() == [("a", "txt", 2), ("b", "md", 1)]
    assert db.execute("SELECT id, content FROM chunks ORDER BY id").fetchall() == list(enumerate(texts, 1))
    assert dict(db.execute("SELECT key, value FROM meta").fetchall()) == {"generated_at": "now", "generator": export.GENERATOR, "fts": "fts5"}
    lookup = "SELECT filename, chunk_index FROM chunks_fts JOIN chunks ON chunks.id = chunks_fts.rowid JOIN documents ON documents.id = document_id WHERE chunks_fts MATCH ?"
    assert db.execute(lookup, ('"p 18"',)).fetchall() == [("pump.txt", 1)] and db.execute(lookup, ('"seal crane"',)).fetchall() == []
    (tmp_path / "y.db").write_bytes(export.build_sqlite([], [], "now"))
    assert sqlite3.connect(tmp_path / "y.db").execute("SELECT count(*) FROM documents").fetchone() == (0,)


def test_bundles_in_parts(spark, monkeypatch):
    monkeypatch.setattr(export, "PART", 60)
    monkeypatch.setattr(numbering, "ROWS", 9)
    rows = [("a", i, f"f{i}.txt", f"Text {i} é" * (i % 3) if i % 4 else None, 0) for i in range(40)] + [("b", 1, "b.txt", None, 0), (None, 1, "n.txt", "of none", 0), ("c", 2, "c.txt", "", 0)]
    sections = spark.createDataFrame(rows, "tenant string, p int, f string, md string, size int").repartition(4)
    whole = {r.tenant: r.markdown for r in export.markdown_bundle(sections, "tenant", F.concat(F.lit("of "), "tenant"), "p", "f", "md").collect() if r.tenant}
    pieces = export.bundle_pieces(sections, "tenant", F.concat(F.lit("of "), "tenant"), "p", "f", "md")
    assert pieces.where("tenant = 'a'").count() == 41
    parts = sorted((r for r in export.bundle_parts(pieces, "tenant").collect() if r.tenant), key=lambda r: (r.tenant, r.offset))
    got = {}
    for r in parts:
        assert r.offset == len(got.setdefault(r.tenant, b"")) and r.size == len(r.content) and (r.size <= 60 or r.size < 120)
        got[r.tenant] += bytes(r.content)
    assert {t: b.decode() for t, b in got.items()} == whole and set(whole) == {"a", "c"} and sum(r.tenant == "a" for r in parts) > 8


def test_files_read_back(spark):
    docs = spark.createDataFrame([("t", "d1", "pump.txt", "txt", 1), ("t", "d2", "x.md", "md", 0), ("u", "d3", "y.md", "md", 0)], "owner string, document_id string, filename string, file_type string, position int")
    chunks = spark.createDataFrame([("t", "d1", 0, "P-18 é"), ("t", "d1", 1, "p 18"), ("t", "d2", 0, "P18"), ("u", "d3", 0, "none")], "owner string, document_id string, chunk_index int, content string")
    got = export.sqlite_contents(export.sqlite_files(docs, chunks, "owner", "now"), "owner", '"p 18"').collect()
    assert sorted(map(tuple, got)) == [("t", 1, "d2", "x.md", 0, "P18", False), ("t", 2, "d1", "pump.txt", 0, "P-18 é", True), ("t", 3, "d1", "pump.txt", 1, "p 18", True), ("u", 1, "d3", "y.md", 0, "none", False)]


def test_running_sums(spark, monkeypatch):
    monkeypatch.setattr(numbering, "ROWS", 30)
    rows = [("g" if i % 2 else None, i, i % 7, 0) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, o int, v int, before int").repartition(6)
    got = {(r.g, r.o): r.s for r in numbering.numbered(df, ["g"], ["o"], "n", sums={"s": "v"}).collect()}
    assert got == {(g, o): sum(v for h, p, v, _ in rows if h == g and p < o) for g, o, _, _ in rows}


def test_keys():
    key = catalog.new_key("admin")
    assert len(catalog.key_hash(key)) == 64 and key != catalog.new_key("admin")
    for bad in ("", "Ab", "a b"):
        try:
            catalog.check_slug(bad)
            raise AssertionError(bad)
        except ValueError:
            pass


def test_semantic_batch_equals_single_queries(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3 if i % 9 else 2)]) for i in range(300)]
    rows += [(300, None), (301, [0.0, 0.0, 0.0]), (302, [1.0, None, 0.0]), (303, [1e-3, 0.0, 0.0]), (304, [1e200, 1e200, 0.0])]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = [(7, [1.0, 0.5, 0.0]), (8, [0.0, 0.0, 0.0]), (9, [0.5, -1.0]), (10, None)]
    got = search.semantic_batch(vectors, spark.createDataFrame(asked, "query_id long, query array<double>"), 6, "id").collect()
    assert {r.query_id for r in got} == {7, 9}
    for q, v in (asked[0], asked[2]):
        want = search.semantic_search(vectors.where(F.size("embedding") == len(v)), v, 6, "id").collect()
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [r.id for r in want]
