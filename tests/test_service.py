import io
import sqlite3
import zipfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataforge import store
from strataforge.operators import catalog
from strataforge.operators.catalog import Denied
from strataforge.service import Engine
from strataforge.sources import files
from strataforge.streaming.ingest import watch

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx():
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    row = lambda *c: "<w:tr>" + "".join(map(cell, c)) + "</w:tr>"
    body = f"<w:p><w:r><w:t>First </w:t></w:r><w:r><w:t>line</w:t></w:r></w:p><w:tbl>{row('Code', '')}{row('E-1', 'Fuse')}{row('', '')}</w:tbl>"
    return zipped(f"<w:document {_W}><w:body>{body}</w:body></w:document>")


def zipped(document):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", document)
    return out.getvalue()


def uploads(spark, *rows):
    return spark.createDataFrame([(n, len(d), bytearray(d)) for n, d in rows], "filename string, size long, content binary")


def test_file_texts():
    assert files.csv_text(b'a,,c\n1,2,"x\ny"\n , ,\n3') == "a: 1; : 2; c: x\ny\na: 3"
    assert files.csv_text(b"only,one row") == "only,one row"
    assert files.docx_text(docx()) == "First line\n\nCode: E-1; Fuse"
    assert files._table(files.ET.fromstring(f"<w:tbl {_W}>" + "<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>" for t in ("a", "", "b")) + "</w:tr></w:tbl>")) == "a |  | b"
    spaced = f"<w:document {_W}><w:body><w:p><w:r><w:t>  lead and trail  </w:t></w:r></w:p><w:p><w:r><w:t> </w:t></w:r></w:p><w:p><w:r><w:t>b</w:t></w:r></w:p></w:body></w:document>"
    assert files.docx_text(zipped(spaced)) == "lead and trail\n\nb"
    assert files.csv_text(b"{x},b\n1,{2}") == "{x}: 1; b: {2}" and files.csv_text(b"a,b\n\n") == ""


def test_parse_files(spark):
    pages = lambda data: data.decode().split("|")
    rows = [("1", "a.txt", 4, bytearray(b"hi\xff")), ("2", "b.exe", 1, bytearray(b"x")), ("3", "c.docx", 9, bytearray(b"broken")), ("4", "d.pdf", 9, bytearray(b"one  two|| three-\nfour")), ("5", "e.md", 99 << 20, bytearray(b"x"))]
    got = {r.document_id: r for r in files.parse_files(spark.createDataFrame(rows, "document_id string, filename string, size long, content binary"), read_pdf=pages).collect()}
    assert got["1"].text == "hi�" and got["4"].text == "one two\n\nthreefour"  # markers of most pages count as repeated lines
    assert "unsupported" in got["2"].error and got["3"].error and got["5"].error == "file too large"


def test_life_of_a_tenant(spark, tmp_path):
    def embed(texts):
        return [[float(t.lower().count(c)) + 0.01 for c in "aeiou"] for t in texts]

    engine = Engine(spark, str(tmp_path / "store"), embed=embed)
    a, b = engine.create_tenant("Acme", "acme"), engine.create_tenant("Other", "other")
    with pytest.raises(ValueError):
        engine.create_tenant("Again", "acme")
    reader = engine.create_key(a["key"], "bot", "retrieval")
    assert engine.list_keys(a["key"]).count() == 2
    for call, status in ((lambda: engine.list_keys(reader), 403), (lambda: engine.me("nope"), 401), (lambda: engine.me(None), 401)):
        with pytest.raises(Denied) as e:
            call()
        assert e.value.status == status
    done = engine.upload_batch(a["key"], uploads(spark, ("faq.txt", b"E-042: replace the servo fuse."), ("blank.md", b" \n"), ("x.exe", b"?"), ("t.docx", docx())), "vector, markdown,sqlite")
    assert {r.filename: r.status for r in done.collect()} == {"faq.txt": "ready", "blank.md": "failed", "t.docx": "ready"}
    engine.upload(b["key"], uploads(spark, ("b.txt", b"E-042 elsewhere")), "vector")
    with pytest.raises(ValueError):
        engine.upload(b["key"], uploads(spark, ("b.exe", b"?")), "vector")
    with pytest.raises(ValueError):
        engine.upload(b["key"], uploads(spark, ("b.txt", b"?")), "pdf")
    assert (engine.me(reader)["document_count"], engine.me(reader)["chunk_count"]) == (3, 2)
    hit = engine.retrieve(reader, "e-042", "keyword").collect()
    assert [(r.source_filename, r.relevance_score) for r in hit] == [("faq.txt", 1.0)]
    assert engine.retrieve(reader, "replace the servo fuse", top_k=1).first().source_filename == "faq.txt"
    doc = engine.list_documents(reader).where(F.col("filename") == "faq.txt").first().id
    name, md = engine.export(a["key"], doc, "markdown")
    assert name == "faq.md" and md.decode().startswith("# faq\n")
    name, text = engine.export_markdown(a["key"])
    assert name == "acme-documents.md" and text.startswith("# Acme — Document Library\n\n\n# ")
    name, data = engine.export_sqlite(a["key"])
    (tmp_path / name).write_bytes(data)
    assert sqlite3.connect(tmp_path / name).execute("SELECT count(*), min(id), max(id) FROM chunks").fetchone() == (2, 1, 2)
    assert engine.health()["status"] == "ok" and Engine(spark, str(tmp_path / "store"), embed=embed).table("tenants").count() == 2
    engine.delete_document(a["key"], doc)
    held = "".join(str(pq.read_table(p).to_pylist()) for p in (tmp_path / "store").rglob("*.parquet"))
    assert "servo fuse" not in held and "elsewhere" in held and not list((tmp_path / "store" / "_staging").iterdir())
    assert engine.retrieve(reader, "e-042", "keyword").count() == 0 and engine.list_documents(reader).count() == 2
    assert engine.retrieve(b["key"], "e-042", "keyword").count() == 1
    with pytest.raises(KeyError):
        engine.export(a["key"], doc, "markdown")


def test_states_and_crashes(spark, tmp_path):
    seen = []

    def embed(texts):
        seen.append(len(texts))
        raise RuntimeError("no embedder today")

    engine = Engine(spark, str(tmp_path / "store"), embed=embed)
    key = engine.create_tenant("Acme", "acme")["key"]
    with pytest.raises(Exception, match="no embedder today"):
        engine.upload(key, uploads(spark, ("a.txt", b"some words")), "vector")
    rows = engine.table("documents").orderBy("revision").collect()
    assert [(r.status, r.revision) for r in rows] == [("processing", 0), ("failed", 2)] and "no embedder" in rows[1].error_message
    assert [r.status for r in engine.list_documents(key).collect()] == ["failed"]
    batch = uploads(spark, ("b.txt", b"other words"))
    for _ in range(2):
        engine.upload_batch(key, batch, "markdown", "batch 1").count()
    assert engine.list_documents(key).count() == 2 and engine.table("chunks").count() == 1
    # an upload that was cut short runs again from the start
    tenant = rows[0].tenant_id
    engine.store.replace("documents", tenant, lambda held: held.where("filename = 'b.txt' AND revision = 0"))
    assert [r.status for r in engine.upload_batch(key, batch, "markdown", "batch 1").collect()] == ["ready"] and engine.table("chunks").count() == 1
    # rows of a writer that died before its version are not read, and go
    engine.store._write("documents", tenant, engine.table("documents"))
    assert engine.list_documents(key).count() == 1 and engine.store.clean("documents") == 1 and engine.list_documents(key).count() == 1


def test_an_upload_inside_a_deletion(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "store"))
    key = engine.create_tenant("Acme", "acme")["key"]
    engine.upload(key, uploads(spark, ("a.txt", b"first words"), ("b.txt", b"second words")), "markdown")
    doc = engine.list_documents(key).where("filename = 'a.txt'").first().id
    write, others = engine.store._write, []

    def meanwhile(name, part, rows):
        """Between reading a tenant's rows and making the next version of them another engine starts and uploads."""
        folder = write(name, part, rows)
        if not others and name == "chunks":
            others.append(Engine(spark, str(tmp_path / "store")))
            others[0].upload(key, uploads(spark, ("c.txt", b"third words")), "markdown")
        return folder

    monkeypatch.setattr(engine.store, "_write", meanwhile)
    engine.delete_document(key, doc)
    assert others and sorted(r.filename for r in engine.list_documents(key).collect()) == ["b.txt", "c.txt"]
    assert sorted(r.content for r in engine.table("chunks").collect()) == ["second words", "third words"] and engine.table("artifacts").count() == 2
    assert engine.retrieve(key, "words", "keyword").count() == 2


def test_two_deletions_at_once(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "store"))
    key = engine.create_tenant("Acme", "acme")["key"]
    engine.upload(key, uploads(spark, *[(f"{c}.txt", c.encode() * 9) for c in "abc"]), "markdown")
    ids = {r.filename: r.id for r in engine.list_documents(key).collect()}
    other, write, done = Engine(spark, str(tmp_path / "store")), engine.store._write, []

    def meanwhile(name, part, rows):
        folder = write(name, part, rows)
        if not done:
            done.append(other.delete_document(key, ids["b.txt"]))
        return folder

    monkeypatch.setattr(engine.store, "_write", meanwhile)
    engine.delete_document(key, ids["a.txt"])
    assert [r.filename for r in engine.list_documents(key).collect()] == ["c.txt"] and [r.content for r in engine.table("chunks").collect()] == ["c" * 9]


def test_versions_of_a_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FOLDERS", 4)
    held = store.Store(spark, str(tmp_path / "s"), {"t": T._parse_datatype_string("id int, v string")})
    for i in range(9):
        held.append("t", "p", spark.createDataFrame([(i, "x")], "id int, v string"))
    version, folders = held.version("t", "p")
    assert sorted(r.id for r in held.read("t").collect()) == list(range(9)) and len(folders) < 6 and version > 9
    with pytest.raises(store.Conflict):
        held._commit("t", "p", version, [])
    assert held.read("t", "none").count() == 0 and held.clean("t") == 0


def test_a_caller_is_found_by_one_part(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    keys = [engine.create_tenant(f"T{i}", f"t-{i}")["key"] for i in range(6)]
    read = []
    whole = engine.store._rows
    engine.store._rows = lambda name, folders: read.append((name, list(folders))) or whole(name, folders)
    assert engine.me(keys[3])["slug"] == "t-3"
    assert [(n, len({f.split("/")[1].split("-")[0] for f in folders})) for n, folders in read] == [("api_keys", 1), ("tenants", 1), ("documents", 0)]
    with pytest.raises(ValueError, match="taken"):
        engine.create_tenant("Again", "t-3")


def test_a_store_of_an_earlier_release(spark, tmp_path):
    """Folders by tenant, no versions, documents without a choice of formats."""
    root = tmp_path / "store"
    old = Engine(spark, str(tmp_path / "new"))
    key = old.create_tenant("Acme", "acme")["key"]
    old.upload(key, uploads(spark, ("a.txt", b"old words")), "markdown")
    for name in ("tenants", "api_keys", "documents", "chunks", "artifacts"):
        rows = old.table(name).drop("output_formats", "revision")
        (rows.write.partitionBy("tenant_id") if "tenant_id" in rows.columns else rows.write).parquet(str(root / name))
    for _ in range(2):
        engine = Engine(spark, str(root))
        assert engine.store.layout() == store.LAYOUT
        # both rows of the document have revision 0 now; one of them counts
        assert [r.output_formats for r in engine.list_documents(key).collect()] == [["vector"]]
        assert engine.me(key)["document_count"] == 1 and engine.list_keys(key).count() == 1 and not list((root / "documents").glob("tenant_id=*"))
    with pytest.raises(ValueError, match="taken"):
        engine.create_tenant("Again", "acme")


def test_seed_tells_what_it_made(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    told = engine.seed("O'Neill", "oneill")
    assert told.count("INSERT INTO api_keys") == 2 and "'O''Neill', 'oneill'" in told
    admin, reader = (line.split()[-1] for line in told.splitlines()[-2:])
    assert engine.list_keys(admin).count() == 2 and engine.me(reader)["slug"] == "oneill" and catalog.key_hash(admin) in told


def test_watching_a_folder(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    key = engine.create_tenant("Acme", "acme")["key"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_text("first file")
    for name in ("two.md", "skip.bin"):
        watch(engine, key, str(tmp_path / "in"), str(tmp_path / "cp"), available_now=True).awaitTermination(120)
        (tmp_path / "in" / name).write_text("more")
    watch(engine, key, str(tmp_path / "in"), str(tmp_path / "cp"), available_now=True).awaitTermination(120)
    assert sorted(r.filename for r in engine.list_documents(key).collect()) == ["one.txt", "two.md"]
