"""Registered queries of files, stored tables and the values that callers see, over files made of the driver's tables."""

from __future__ import annotations

import io
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as P

from .. import work
from ..config import DEFAULTS
from ..functions import text as T
from ..operators import catalog, chunking
from ..service import Engine
from ..sources import files, pdf
from . import queries as Q

_KINDS = "CASE doc_id % 5 WHEN 0 THEN 'txt' WHEN 1 THEN 'MD' WHEN 2 THEN 'csv' WHEN 3 THEN 'exe' ELSE 'txt' END"
_CSV = "'Code,,Note' || chr(10) || doc_id || ',x,\"' || replace(text, '\"', '\"\"') || '\"' || chr(10)"
_TYPES = ", ".join("." + t for t in T.FILE_TYPES)


def file_dispatch(spark, sf):
    """Files of several kinds, one kind unknown, every fifth one too large."""
    csv = F.concat(F.lit("Code,,Note\n"), F.col("doc_id").cast("string"), F.lit(',x,"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"\n'))
    rows = Q._docs(spark, sf).select(
        F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("in/f."), F.expr(_KINDS)).alias("filename"), F.when(F.col("doc_id") % 5 == 4, DEFAULTS.max_file_bytes + 1).otherwise(10).cast("long").alias("size"),
        F.encode(F.when(F.col("doc_id") % 5 == 2, csv).otherwise(F.col("text")), "UTF-8").alias("content"),
    )
    return files.parse_files(rows).select("document_id", "text", "error")


def _docx(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents as DOCX files: a paragraph a line, then a table."""
    run = lambda t: f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>'
    cell = lambda t: f"<w:tc><w:p>{run(t)}</w:p></w:tc>"
    for batch in batches:
        out = []
        for key, text, lang in zip(batch["doc_id"], batch["text"], batch["lang"], strict=True):
            body = "".join(f"<w:p>{run(line[: len(line) // 2])}{run(line[len(line) // 2 :])}</w:p>" for line in text.split("\n"))
            rows = "".join("<w:tr>" + "".join(map(cell, r)) + "</w:tr>" for r in (("Code", "", "Language"), (str(key), "x", lang or ""), ("", "", "")))
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}<w:tbl>{rows}</w:tbl></w:body></w:document>')
            out.append(held.getvalue())
        yield pd.DataFrame({"document_id": batch["doc_id"].astype(str), "filename": "f.docx", "size": 1, "content": out})


_FILES = "document_id string, filename string, size long, content binary"
_PLAIN = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"  # XML has no such characters


def docx_round_trip(spark, sf):
    rows = Q._docs(spark, sf).select("doc_id", F.regexp_replace("text", _PLAIN, "").alias("text"), "lang")
    return files.parse_files(rows.mapInPandas(_docx, _FILES)).select("document_id", "text")


#: Words of a line, lines of a page.
WORDS, LINES = 12, 40


def _pdf(rows: list[list[str]]) -> bytes:
    """Pages of lines as a PDF file."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"]
    for page in rows:
        data = zlib.compress(b"BT /F1 10 Tf 12 TL 40 760 Td " + b" ".join(b"(%s) Tj T*" % line.encode() for line in page) + b" ET")
        objects += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (len(objects) + 2), b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(data), data)]
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 3 0 R >> >> >>" % (len(rows), b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(rows))))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out) + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, table, len(objects) + 1, len(out))


@F.pandas_udf(P.ArrayType(P.StringType()))
def _printed(words: pd.Series) -> pd.Series:
    def one(own) -> list[str]:
        lines = [" ".join(own[i : i + WORDS]) for i in range(0, len(own), WORDS)]
        return pdf.pages(_pdf([lines[i : i + LINES] for i in range(0, len(lines), LINES)]))

    return pd.Series([one(list(w)) for w in words])


def pdf_round_trip(spark, sf):
    """The words of documents printed as PDF pages and read again, a row a page."""
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    docs = Q._docs(spark, sf).select("doc_id", "text").repartition(chunking.spread_over(Q._docs(spark, sf)))  # one file may hold them all
    return docs.select("doc_id", F.posexplode(_printed(words)).alias("page", "text")).select("doc_id", (F.col("page") + 1).alias("page"), "text")


_PDF_SQL = f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, i, array_to_string(w[i * {WORDS} + 1:(i + 1) * {WORDS}], ' ') AS t FROM (SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w) / {WORDS}.0) AS BIGINT))) AS i FROM w))
SELECT doc_id, CAST(i // {LINES} + 1 AS INTEGER) AS page, string_agg(t, chr(10) ORDER BY i) AS text FROM l GROUP BY doc_id, i // {LINES}"""


# ------------------------------------------------------------ stored tables

_AT = datetime(2024, 1, 2, 3, 4)


def _engine(spark, sf) -> Engine:
    """A store into which all documents, every fifth of them blank, were uploaded as text files by one tenant."""
    engine = Engine(spark, f"{work.shared_dir(spark)}/store-{uuid.uuid4().hex}", now=lambda: _AT)
    key = engine.create_tenant("Tables", "tables")["key"]
    text = F.when(F.col("doc_id") % 5 == 0, "  \n\t ").otherwise(F.col("text"))
    rows = Q._docs(spark, sf).select("filename", F.encode(text, "UTF-8").alias("content")).withColumn("size", F.octet_length("content").cast("long"))
    engine.upload_batch(key, rows, "markdown")
    return engine


def engine_documents(spark, sf):
    return catalog.latest(_engine(spark, sf).table("documents")).select("filename", "file_type", "file_size_bytes", "status", "chunk_count", "error_message", F.array_join("output_formats", ",").alias("formats"))


def engine_chunks(spark, sf):
    engine = _engine(spark, sf)
    docs = catalog.latest(engine.table("documents")).select(F.col("id").alias("document_id"), "filename")
    return engine.table("chunks").join(docs, "document_id").select("filename", "chunk_index", "content")


def engine_artifacts(spark, sf):
    return _engine(spark, sf).table("artifacts").select("filename", "format", "size_bytes", F.sha2("content", 256).alias("sha256"))


_BLANK_SQL = "SELECT doc_id, source, lang, CASE WHEN doc_id % 5 = 0 THEN '  ' || chr(10) || chr(9) || ' ' ELSE text END AS text FROM documents"


def document_revisions(spark, sf):
    """Rows as uploads write them, the first in the middle of the work; the highest revision counts."""
    # documents are cut once: three sets of rows are made of them
    docs = work.materialise(Q._stored(spark, sf).select("doc_id", "status", "chunk_count"), "stored")
    rows = docs.select("doc_id", F.lit("processing").alias("status"), F.lit(0).alias("chunk_count"), F.lit(0).alias("revision"))
    rows = rows.unionByName(docs.where("status <> 'processing'").withColumn("revision", F.lit(1)))
    return catalog.latest(rows.unionByName(docs.where("doc_id % 11 = 3").select("doc_id", F.lit("failed").alias("status"), F.lit(0).alias("chunk_count"), F.lit(2).alias("revision"))), "doc_id")


def retrievable_documents(spark, sf):
    return Q._stored(spark, sf).where("status = 'ready'").select("doc_id", "filename")


def key_permissions(spark, sf):
    """What each key may do: uploads, and the number of calls in all."""
    calls = (*sorted(catalog.ADMIN_ONLY), "retrieve", "list", "me")
    may = [catalog.permitted(F.col("scope"), c) for c in calls]
    return Q._keys(spark, sf).select("id", "scope", catalog.permitted(F.col("scope"), "upload").alias("may_upload"), sum((F.when(m, 1).otherwise(0) for m in may), F.lit(0)).cast("long").alias("calls"))


def point_lookup(spark, sf):
    return Q._tenants(spark, sf).where(F.col("id") == 7).select("id", "name", "slug", "is_active")


# ------------------------------------------------------------ values that callers see


def display_values(spark, sf):
    score = F.col("o_totalprice") / 200_000 - 0.1
    return Q._t(spark, sf, "orders").select("o_orderkey", T.readable_size((F.col("o_totalprice") * F.col("o_orderkey")).cast("long")).alias("size"), T.per_cent(score).alias("per_cent"))


def generated_stamps(spark, sf):
    return Q._t(spark, sf, "events").select("event_id", T.stamp(F.col("ts")).alias("stamp"))


def error_messages(spark, sf):
    return Q._docs(spark, sf).select("doc_id", T.error_message(F.col("text")).alias("message"), F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("bytes"), (F.decode(F.encode("text", "UTF-8"), "UTF-8") == F.col("text")).alias("same"))


def lookup_without_index(spark, sf):
    """What a user of an exported file without a full-text index asks: part of the text, in any case."""
    return Q._chunks(spark, sf).where(F.lower("content").contains("threat")).select("doc_id", "chunk_index")


QUERIES = {
    f.__name__: f
    for f in (
        file_dispatch, docx_round_trip, pdf_round_trip, engine_documents, engine_chunks, engine_artifacts, document_revisions, retrievable_documents, key_permissions, point_lookup, display_values,
        generated_stamps, error_messages, lookup_without_index,
    )
}

_LINES_SQL = f"list_filter(list_transform(string_split(regexp_replace(text, '{_PLAIN}', '', 'g'), chr(10)), lambda l: trim(l, {Q._WHITE_SQL})), lambda l: l <> '')"
_SIZE = "CAST(trunc(o_totalprice * o_orderkey) AS BIGINT)"
ORACLES = {
    "file_dispatch": f"""SELECT CAST(doc_id AS VARCHAR) AS document_id,
      CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN 'Code: ' || doc_id || '; : x' || CASE WHEN trim(text, {Q._WHITE_SQL}) <> '' THEN '; Note: ' || text ELSE '' END END AS text,
      CASE doc_id % 5 WHEN 3 THEN 'unsupported file type; supported: {_TYPES}' WHEN 4 THEN 'file too large' END AS error FROM documents""",
    "docx_round_trip": f"SELECT CAST(doc_id AS VARCHAR) AS document_id, array_to_string(list_append({_LINES_SQL}, 'Code: ' || doc_id || '; x; Language: ' || lang), chr(10) || chr(10)) AS text FROM documents",
    "pdf_round_trip": _PDF_SQL,
    "engine_documents": f"""{Q._CHUNKS_SQL}, n AS (SELECT doc_id, count(*) AS c FROM chunks GROUP BY doc_id), d AS ({_BLANK_SQL})
      SELECT source || '-' || d.doc_id || '.txt' AS filename, 'txt' AS file_type, CAST(strlen(text) AS BIGINT) AS file_size_bytes, CASE WHEN d.doc_id % 5 = 0 OR c IS NULL THEN 'failed' ELSE 'ready' END AS status,
        CAST(CASE WHEN d.doc_id % 5 = 0 THEN 0 ELSE coalesce(c, 0) END AS INTEGER) AS chunk_count, CASE WHEN d.doc_id % 5 = 0 OR c IS NULL THEN 'the file holds no text' END AS error_message, 'markdown' AS formats FROM d LEFT JOIN n ON d.doc_id = n.doc_id""",
    "engine_chunks": f"{Q._CHUNKS_SQL} SELECT source || '-' || doc_id || '.txt' AS filename, chunk_index, content FROM chunks WHERE doc_id % 5 <> 0",
    "engine_artifacts": f"SELECT replace(filename, '.txt', '.md') AS filename, 'markdown' AS format, CAST(strlen(md) AS INTEGER) AS size_bytes, sha256(md) AS sha256 FROM (SELECT filename, {Q._MARKDOWN_SQL} AS md FROM ({Q._DOCS_SQL}) WHERE doc_id % 5 <> 0 AND trim(text, {Q._WHITE_SQL}) <> '')",
    "document_revisions": f"""{Q._CHUNKS_SQL}, n AS (SELECT doc_id, count(*) AS c FROM chunks GROUP BY doc_id)
      SELECT d.doc_id, CASE WHEN d.doc_id % 11 = 3 THEN 'failed' ELSE {Q._STATUS_SQL.replace("doc_id", "d.doc_id")} END AS status, CAST(CASE WHEN d.doc_id % 11 = 3 OR d.doc_id % 7 = 3 THEN 0 ELSE coalesce(c, 0) END AS INTEGER) AS chunk_count,
        CAST(CASE WHEN d.doc_id % 11 = 3 THEN 2 WHEN d.doc_id % 7 = 3 THEN 0 ELSE 1 END AS INTEGER) AS revision FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id""",
    "retrievable_documents": f"SELECT doc_id, filename FROM ({Q._DOCS_SQL}) WHERE {Q._STATUS_SQL} = 'ready'",
    "key_permissions": f"SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'admin' ELSE 'retrieval' END AS scope, c_custkey % 2 = 0 AS may_upload, CAST(CASE WHEN c_custkey % 2 = 0 THEN {len(catalog.ADMIN_ONLY) + 3} ELSE 3 END AS BIGINT) AS calls FROM customer",
    "point_lookup": f"SELECT id, n_name AS name, slug, is_active FROM ({Q._TENANTS_SQL}) JOIN nation ON n_nationkey = id WHERE id = 7",
    "display_values": f"SELECT o_orderkey, CASE WHEN {_SIZE} < 1024 THEN {_SIZE} || ' B' WHEN {_SIZE} < 1048576 THEN CAST(floor({_SIZE} / 1024 + 0.5) AS BIGINT) || ' KB' ELSE printf('%.1f MB', {_SIZE} / 1048576) END AS size, CAST(least(100, greatest(0, floor((o_totalprice / 200000 - 0.1) * 100 + 0.5))) AS INTEGER) AS per_cent FROM orders",
    "generated_stamps": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M UTC') AS stamp FROM events",
    "error_messages": "SELECT doc_id, substr(text, 1, 1000) AS message, CAST(strlen(text) AS BIGINT) AS bytes, true AS same FROM documents",
    "lookup_without_index": f"{Q._CHUNKS_SQL} SELECT doc_id, chunk_index FROM chunks WHERE content ILIKE '%threat%'",
}
