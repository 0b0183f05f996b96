"""Markdown and SQLite exports."""

from __future__ import annotations

import itertools
import sqlite3
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import work
from . import numbering

GENERATOR = "strataforge"
#: Bytes of a part of a bundle or of a database file, about; rows that a task holds as objects of Python.
PART, ROWS = 4 << 20, 2000

# Tables that users of the files read.
_SCHEMA = """
CREATE TABLE documents (id TEXT PRIMARY KEY, filename TEXT NOT NULL, file_type TEXT NOT NULL, chunk_count INTEGER NOT NULL);
CREATE TABLE chunks (id INTEGER PRIMARY KEY, document_id TEXT NOT NULL REFERENCES documents (id), chunk_index INTEGER NOT NULL, content TEXT NOT NULL);
CREATE TABLE meta (key TEXT PRIMARY KEY, value TEXT);
"""


def _index(db: sqlite3.Connection, generated_at: str) -> None:
    """The full-text index of the chunks, where the library has it, and what the file says of itself."""
    try:
        db.execute("CREATE VIRTUAL TABLE chunks_fts USING fts5(content, content='chunks', content_rowid='id')")
        db.execute("INSERT INTO chunks_fts(chunks_fts) VALUES ('rebuild')")
        fts = "fts5"
    except sqlite3.OperationalError:
        fts = "none"
    db.executemany("INSERT INTO meta VALUES (?, ?)", [("generated_at", generated_at), ("generator", GENERATOR), ("fts", fts)])
    db.commit()


def build_sqlite(documents: list[tuple], chunks: list[tuple], generated_at: str) -> bytes:
    """Bytes of a database file with documents, numbered chunks and, where the library has it, a full-text index."""
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder, "export.db")
        db = sqlite3.connect(path)
        try:
            db.executescript(_SCHEMA)
            db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", documents)
            db.executemany("INSERT INTO chunks VALUES (?, ?, ?, ?)", chunks)
            _index(db, generated_at)
        finally:
            db.close()
        return path.read_bytes()


def numbered_chunks(chunks: DataFrame, tenant: str, *order: str) -> DataFrame:
    """``chunks`` with the row id that they have in their tenant's export: 1, 2, ... in ``order``."""
    # chunks are cut once: numbering reads its rows several times
    return numbering.numbered(work.materialise(chunks, "chunks"), [tenant], order, "row_id")


class _Export:
    """A database file that is built from a stream of rows: they wait in a second file and are put in order by SQLite, on disk."""

    def __init__(self):
        self.folder = tempfile.TemporaryDirectory()
        self.path = Path(self.folder.name, "export.db")
        self.db = sqlite3.connect(self.path)
        self.db.execute("ATTACH ? AS held", (str(Path(self.folder.name, "held.db")),))
        self.db.executescript("PRAGMA main.journal_mode = OFF; PRAGMA held.journal_mode = OFF;" + _SCHEMA)
        self.db.execute("CREATE TABLE held.d (place INTEGER PRIMARY KEY, id TEXT, filename TEXT, file_type TEXT)")
        self.db.execute("CREATE TABLE held.c (n INTEGER PRIMARY KEY, id TEXT, chunk_index INTEGER, content TEXT)")
        self.documents = 0

    def add(self, rows: list[tuple]) -> None:
        """Rows (kind, document, filename, file_type, chunk_index, content): documents (kind 0) in order, chunks in any."""
        documents = [r[1:4] for r in rows if r[0] == 0]
        self.db.executemany("INSERT INTO held.d (id, filename, file_type) VALUES (?, ?, ?)", documents)
        self.db.executemany("INSERT INTO held.c (id, chunk_index, content) VALUES (?, ?, ?)", (r[1:2] + r[4:] for r in rows if r[0] == 1))
        self.documents += len(documents)

    def finish(self, generated_at: str) -> None:
        self.db.execute("INSERT INTO documents SELECT d.id, filename, file_type, coalesce(n, 0) FROM held.d d LEFT JOIN (SELECT id, count(*) AS n FROM held.c GROUP BY id) c ON c.id = d.id ORDER BY place")
        # chunks of no document are left out
        self.db.execute("INSERT INTO chunks SELECT row_number() OVER (ORDER BY place, chunk_index, n), c.id, chunk_index, content FROM held.c c JOIN held.d d ON d.id = c.id ORDER BY 1")
        _index(self.db, generated_at)

    def close(self) -> None:
        self.db.close()
        self.folder.cleanup()


def _sqlite_built(documents: DataFrame, chunks: DataFrame, tenant: str, generated_at: str, size: int | None) -> DataFrame:
    """(tenant, offset, content): each tenant's file in parts of ``size`` bytes, or whole."""
    kind, nothing = documents.schema[tenant].dataType.simpleString(), lambda t: F.lit(None).cast(t)
    rows = documents.select(tenant, F.lit(0).alias("kind"), "document_id", "position", "filename", "file_type", nothing("int").alias("chunk_index"), nothing("string").alias("content"))
    rows = rows.unionByName(chunks.select(tenant, F.lit(1).alias("kind"), "document_id", nothing(documents.schema["position"].dataType).alias("position"), nothing("string").alias("filename"), nothing("string").alias("file_type"), F.col("chunk_index").cast("int").alias("chunk_index"), "content"))
    fields = ["kind", "document_id", "filename", "file_type", "chunk_index", "content"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, made, typed = None, None, None

        def sent() -> Iterator[pa.RecordBatch]:
            try:
                if not made.documents:
                    return
                made.finish(generated_at)
                made.db.close()
                with made.path.open("rb") as f:
                    at = 0
                    while data := f.read(size or -1):
                        yield pa.RecordBatch.from_arrays([pa.array([owner], typed), pa.array([at], pa.int64()), pa.array([data], pa.binary())], names=[tenant, "offset", "content"])
                        at += len(data)
            finally:
                made.close()

        for batch in batches:
            typed = batch.schema.field(tenant).type
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                owners = some.column(tenant).to_pylist()
                held = list(zip(*[some.column(c).to_pylist() for c in fields], strict=True))
                for own, group in itertools.groupby(range(len(held)), owners.__getitem__):
                    if made is None or own != owner:
                        if made is not None:
                            yield from sent()
                        owner, made = own, _Export()
                    made.add([held[i] for i in group])
        if made is not None:
            yield from sent()

    dealt = rows.repartition(tenant).sortWithinPartitions(tenant, "kind", "position", "document_id")
    return dealt.select(tenant, *fields).mapInArrow(build, f"{tenant} {kind}, offset long, content binary")


def sqlite_parts(documents: DataFrame, chunks: DataFrame, tenant: str, generated_at: str) -> DataFrame:
    """(tenant, offset, content): one database file per tenant, in parts of some ``PART`` bytes with the places of their first bytes.

    documents: tenant, document_id, filename, file_type, position; chunks: tenant, document_id, chunk_index, content. One
    task builds a tenant's file, on disk, from a stream of rows: its memory does not grow with the tenant.
    """
    return _sqlite_built(documents, chunks, tenant, generated_at, PART)


def sqlite_files(documents: DataFrame, chunks: DataFrame, tenant: str, generated_at: str) -> DataFrame:
    """(tenant, content): the files of ``sqlite_parts`` as one value each, which has to fit in a task's memory."""
    return _sqlite_built(documents, chunks, tenant, generated_at, None).drop("offset")


def sqlite_contents(files: DataFrame, tenant: str, phrase: str | None = None) -> DataFrame:
    """(tenant, row_id, document_id, filename, chunk_index, content, found): the chunks that database files hold, read back.

    files: of ``sqlite_files`` or ``sqlite_parts``. found: whether the file's own full-text index finds ``phrase`` (a query of
    SQLite's) in the chunk; null without one. Files are written to a task's disk and read from there.
    """
    kind = files.schema[tenant].dataType.simpleString()
    schema = f"{tenant} {kind}, row_id long, document_id string, filename string, chunk_index int, content string, found boolean"
    types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_()]
    found = "c.id IN (SELECT rowid FROM chunks_fts WHERE chunks_fts MATCH ?)" if phrase else "NULL"
    ask = f"SELECT c.id, c.document_id, d.filename, c.chunk_index, c.content, {found} FROM chunks c CROSS JOIN documents d ON d.id = c.document_id ORDER BY c.id"

    def opened(path: Path, owner, typed) -> Iterator[pa.RecordBatch]:
        db = sqlite3.connect(path)
        try:
            rows = db.execute(ask, (phrase,) if phrase else ())
            while some := rows.fetchmany(ROWS):
                columns = [pa.array([owner] * len(some), typed)]
                for values, t in zip(zip(*some, strict=True), types, strict=True):
                    columns.append(pa.array([None if v is None else bool(v) for v in values] if t == pa.bool_() else values, t))
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])
        finally:
            db.close()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            path, owner, typed, begun = Path(folder, "export.db"), None, None, False
            for batch in batches:
                typed = batch.schema.field(tenant).type
                for own, offset, data in zip(batch.column(tenant), batch.column("offset"), batch.column("content"), strict=True):
                    first = offset.as_py() == 0
                    if first and begun:
                        yield from opened(path, owner, typed)
                    owner, begun = own.as_py(), True
                    with path.open("wb" if first else "ab") as f:
                        f.write(data.as_buffer())
            if begun:
                yield from opened(path, owner, typed)

    if "offset" in files.columns:
        placed = files.select(tenant, "offset", "content").repartition(tenant).sortWithinPartitions(tenant, "offset")
    else:
        placed = files.select(tenant, F.lit(0).cast("long").alias("offset"), "content")
    return placed.mapInArrow(read, schema)


def bundle_pieces(sections: DataFrame, tenant: str, title: Column, position: str, filename: str, content: str) -> DataFrame:
    """(tenant, piece, pieces, offset, text): what ``markdown_bundle`` joins, one row a piece, with its first byte's place.

    A heading, the names of documents without content, the others' content, by position and name; each piece holds what
    parts it from the one before. Pieces are numbered and their sizes added up over ranges: no task has a tenant's all.
    """
    none = F.col(content).isNull()
    named = sections.select(F.col(tenant).alias("tenant"), title.alias("title"), F.col(position).alias("position"), F.col(filename).alias("name"), F.col(content).alias("content"), F.when(none, 1).otherwise(2).alias("kind"))
    counts = named.groupBy("tenant").agg(F.count("content").alias("have"), F.count_if(F.col("kind") == 1).alias("lack"), F.first("title").alias("title")).where("have > 0")
    heads = counts.select("tenant", F.lit(None).cast(sections.schema[position].dataType).alias("position"), F.lit(None).cast("string").alias("name"), F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit(" — Document Library\n")).alias("content"), F.lit(0).alias("kind"))
    every = heads.unionByName(named.join(counts.select(F.col("tenant").alias("t")), F.col("tenant").eqNullSafe(F.col("t")), "left_semi").drop("title"))
    placed = numbering.numbered(every.where("kind = 1").drop("content"), ["tenant"], ["position", "name"], "n", "of")
    first, last = F.col("n") == 1, F.col("n") == F.col("of")
    note = F.concat(F.when(first, F.lit("\n\n> Not included (uploaded without the markdown output): ")).otherwise(", "), F.lit("`"), "name", F.lit("`"), F.when(last, F.lit("\n")).otherwise(""))
    told = placed.select("tenant", "position", "name", note.alias("content"), "kind")
    body = every.where("kind <> 1").withColumn("content", F.when(F.col("kind") == 2, F.concat(F.lit("\n\n"), "content")).otherwise(F.col("content")))
    sized = body.unionByName(told).withColumn("size", F.octet_length("content"))
    out = numbering.numbered(sized, ["tenant"], ["kind", "position", "name"], "piece", "pieces", {"offset": "size"})
    return out.select(F.col("tenant").alias(tenant), "piece", "pieces", "offset", F.col("content").alias("text"))


def bundle_parts(pieces: DataFrame, tenant: str) -> DataFrame:
    """(tenant, offset, size, content): bundles as parts of some ``PART`` bytes (or one piece), made by many tasks.

    A tenant's parts, in order of their offsets, are its bundle; each part may be written at its offset.
    """
    kind = pieces.schema[tenant].dataType.simpleString()
    schema = f"{tenant} {kind}, offset long, size long, content binary"

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, begin, held, size = None, 0, [], 0

        def part() -> pd.DataFrame:
            return pd.DataFrame([{tenant: owner, "offset": begin, "size": size, "content": b"".join(held)}])

        for batch in batches:
            for t, offset, text in zip(batch[tenant], batch["offset"], batch["text"], strict=True):
                data = text.encode()
                if held and (t != owner or offset != begin + size or size + len(data) > PART):
                    yield part()
                    held, size = [], 0
                if not held:
                    owner, begin = t, int(offset)
                held.append(data)
                size += len(data)
        if held:
            yield part()

    # pieces that lie together are joined; where they do not, there are more parts
    return pieces.repartitionByRange(tenant, "piece").sortWithinPartitions(tenant, "piece").select(tenant, "offset", "text").mapInPandas(joined, schema)


def markdown_bundle(sections: DataFrame, tenant: str, title: Column, position: str, filename: str, content: str) -> DataFrame:
    """(tenant, markdown): one bundle per tenant, sections in order; documents without content are named as missing.

    Tenants without a section have no bundle.
    """
    item = F.struct(F.col(position).alias("p"), F.col(filename).alias("f"), F.col(content).alias("c"))
    all_ = sections.groupBy(tenant).agg(F.sort_array(F.collect_list(item)).alias("s"), F.first(title).alias("title"))
    have, missing = F.filter("s", lambda x: x["c"].isNotNull()), F.filter("s", lambda x: x["c"].isNull())
    names = F.array_join(F.transform(missing, lambda x: F.concat(F.lit("`"), x["f"], F.lit("`"))), ", ")
    note = F.when(F.size(missing) > 0, F.array(F.concat(F.lit("> Not included (uploaded without the markdown output): "), names, F.lit("\n")))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.concat(F.lit("# "), F.col("title"), F.lit(" — Document Library\n")))
    parts = F.concat(head, note, F.transform(have, lambda x: x["c"]))
    return all_.where(F.size(have) > 0).select(tenant, F.array_join(parts, "\n\n").alias("markdown"))
