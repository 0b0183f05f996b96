"""Registered queries of the library's operators over the driver's tables, each with DuckDB SQL where SQL can express it.

Documents stand for uploads: source is the tenant, ``source-doc_id.txt`` the file name, doc_id the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as T
from ..operators import ann, catalog, chunking, export, fulltext, headers, numbering, search

KEYWORD, MULTI, DUPLICATE, BLANK, WILD = "threat", "the and threat tion zzz", "the the zzz", " ", "e%%% _a"
BATCH = ("threat", "the and that", "de la que", "und der die das", "a", "% of", "tion ing zzz qqq")
PHRASES = (("of", "the"), ("and",))
STAMP = "2024-01-02 03:04 UTC"
LINES_PER_PAGE = 4


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark, sf) -> DataFrame:
    name = F.concat_ws("-", F.col("source"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return _t(spark, sf, "documents").select("doc_id", "source", "lang", "text", name.alias("filename"))


def _chunks(spark, sf) -> DataFrame:
    return chunking.chunked(_docs(spark, sf), "doc_id", "source")


# ------------------------------------------------------------ SQL parts


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WHITE_SQL = " || ".join(f"chr({ord(c)})" for c in T.WHITE)
_DOCS_SQL = "SELECT doc_id, source, lang, text, source || '-' || doc_id || '.txt' AS filename FROM documents"
_SEPS = ("chr(10) || chr(10)", "chr(10)", "' .'", "' ?'", "' !'")


def _chunk_sql(size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap) -> str:
    half = size // 2

    def end(start: str) -> str:
        back = f"reverse(substr(text, {start} + {half} + 1, {size - half}))"
        found = ", ".join(f"CASE WHEN instr({back}, {s}) > 0 THEN length({back}) - instr({back}, {s}) + 1 END" for s in _SEPS)
        return f"CASE WHEN {start} + {size} < n THEN {start} + {half} + coalesce({found}, {size - half}) ELSE n END"

    return f"""
RECURSIVE steps(doc_id, source, text, n, step, s, e) AS (
  SELECT doc_id, source, text, n, 0, 0, {end("0")} FROM (SELECT doc_id, source, text, length(text) AS n FROM documents WHERE trim(text, {_WHITE_SQL}) <> '')
  UNION ALL
  SELECT doc_id, source, text, n, step + 1, s2, {end("s2")} FROM (SELECT *, e - {overlap} AS s2 FROM steps WHERE e < n)),
pieces AS (SELECT doc_id, source, step, trim(substr(text, s + 1, e - s), {_WHITE_SQL}) AS content FROM steps),
chunks AS (SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS INTEGER) AS chunk_index, content FROM pieces WHERE content <> '')
"""


_CHUNKS_SQL = f"WITH {_chunk_sql()}"


def _score_sql(query: str, content: str = "content") -> str:
    terms = [t.lower() for t in search.keyword_terms(query)]
    matched = " + ".join(f"CASE WHEN contains(lower({content}), {_q(t)}) THEN 1 ELSE 0 END" for t in terms)
    cases = " ".join(f"WHEN {i} THEN CAST({s!r} AS DOUBLE)" for i, s in enumerate(search.score_steps(len(terms))))
    return f"CASE WHEN contains(lower({content}), {_q(query.strip().lower())}) THEN CAST(1.0 AS DOUBLE) ELSE CASE {matched} {cases} END END"


def _any_sql(query: str, content: str = "content") -> str:
    return "(" + " OR ".join(f"contains(lower({content}), {_q(t.lower())})" for t in search.keyword_terms(query)) + ")"


def _keyword(query: str, source: str | None = None):
    def run(spark, sf):
        rows = _chunks(spark, sf)
        if source is not None:
            rows = chunking.chunked(_docs(spark, sf).where(F.col("source") == source), "doc_id", "source")
        return search.keyword_search(rows, query, DEFAULTS.max_top_k, "doc_id", "chunk_index").select("doc_id", "chunk_index", "content", "score")

    scope = f" AND source = {_q(source)}" if source is not None else ""
    sql = f"{_CHUNKS_SQL} SELECT doc_id, chunk_index, content, {_score_sql(query)} AS score FROM chunks WHERE {_any_sql(query)}{scope} ORDER BY score DESC, doc_id, chunk_index LIMIT {DEFAULTS.max_top_k}"
    return run, sql


# ------------------------------------------------------------ chunks and documents


def chunk_documents(spark, sf):
    return _chunks(spark, sf).select("doc_id", "chunk_index", "content")


def chunk_counts_by_doc(spark, sf):
    docs = chunking.with_chunks(_docs(spark, sf).repartition(chunking.spread_over(_docs(spark, sf))))
    return docs.select("doc_id", F.size("chunks").cast("long").alias("chunk_count"), F.coalesce(F.aggregate("chunks", F.lit(0), lambda s, c: s + F.length(c)), F.lit(0)).cast("long").alias("characters"))


def _stored(spark, sf) -> DataFrame:
    """Documents as the catalogue holds them; every seventh is still processing."""
    docs = chunking.with_chunks(_docs(spark, sf).select("doc_id", "source", "filename", "text"))
    state = F.when(F.col("doc_id") % 7 == 3, "processing").otherwise(catalog.status(F.col("text"), F.col("chunks")))
    return docs.select(F.col("source").alias("tenant_id"), "doc_id", "filename", state.alias("status"), F.size("chunks").alias("chunk_count"))


def tenant_dashboard(spark, sf):
    return catalog.dashboard(_stored(spark, sf))


def document_list_desc(spark, sf):
    return numbering.numbered(_docs(spark, sf).select("source", "doc_id", "filename"), ["source"], [F.desc("doc_id")], "position", "total")


def document_status(spark, sf):
    blank = F.when(F.col("doc_id") % 5 == 0, "  \n\t ").otherwise(F.col("text"))
    docs = chunking.with_chunks(_docs(spark, sf).withColumn("text", blank))
    return docs.select("doc_id", catalog.status(F.col("text"), F.col("chunks")).alias("status"))


# ------------------------------------------------------------ search


def keyword_phrase_benchmark(spark, sf):
    phrases = _t(spark, sf, "benchmark").select("item_id", F.lower(T.strip(F.col("text"))).alias("phrase"))
    return search.phrase_hits(_docs(spark, sf).select("doc_id", "text"), phrases, "item_id", "phrase", "text").select("item_id", "doc_id", F.lit(1.0).alias("score"))


def keyword_batch_topk(spark, sf):
    found = search.keyword_batch(_chunks(spark, sf), BATCH, 5, "doc_id", "chunk_index")
    return found.select("query_id", "rank", "doc_id", "chunk_index", "score")


def _batch_sql() -> str:
    parts = [f"SELECT CAST({i} AS INTEGER) AS query_id, doc_id, chunk_index, {_score_sql(q)} AS score FROM chunks WHERE {_any_sql(q)}" for i, q in enumerate(BATCH)]
    return f"{_CHUNKS_SQL}, hits AS ({' UNION ALL '.join(parts)}) SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index) AS INTEGER) AS rank, doc_id, chunk_index, score FROM hits) WHERE rank <= 5"


def _query_vector(spark, sf) -> list[float]:
    row = _t(spark, sf, "embeddings").where("vec_id = 0").select(search.doubles(F.col("embedding")).alias("v")).first()
    return list(row.v)


def _semantic(where: str | None, k: int):
    def run(spark, sf):
        rows = _t(spark, sf, "embeddings")
        rows = rows.where(where) if where else rows
        found = search.semantic_search(rows, _query_vector(spark, sf), k, "vec_id")
        return found.select("vec_id", F.round("distance", 6).alias("distance"), "score")

    cos = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
    sql = f"WITH d AS (SELECT e.vec_id, 1 - {cos} AS distance FROM (SELECT * FROM embeddings {'WHERE ' + where if where else ''}) e, (SELECT * FROM embeddings WHERE vec_id = 0) q WHERE e.embedding IS NOT NULL) SELECT vec_id, round(distance, 6) AS distance, round(1 - distance, 4) AS score FROM d WHERE NOT isnan(distance) ORDER BY d.distance, vec_id LIMIT {k}"
    return run, sql


def semantic_batch_topk(spark, sf):
    rows = _t(spark, sf, "embeddings")
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.semantic_batch(rows, queries, 5, "vec_id").select("query_id", "rank", "vec_id", "score")


def semantic_ann_topk(spark, sf):
    """Approximate: an index of all rows, asked by every hundredth; recall is that of the audit."""
    rows = _t(spark, sf, "embeddings")
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return ann.nearest(ann.build(rows, "vec_id"), queries, 5).withColumnRenamed("key", "vec_id")


def semantic_skip_null(spark, sf):
    rows = _t(spark, sf, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 3 != 1, F.col("embedding")))
    found = search.semantic_search(rows, _query_vector(spark, sf), 10, "vec_id")
    return found.select("vec_id", "score")


def fts_tokens(spark, sf):
    words = fulltext.tokens(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


def fts_postings(spark, sf):
    index = _docs(spark, sf).select("doc_id", F.posexplode(fulltext.tokens(F.col("text"))).alias("pos", "token"))
    return index.groupBy("token").agg(F.count("*").alias("occurrences"), F.countDistinct("doc_id").alias("documents"), F.min("pos").cast("long").alias("first_pos"))


def fts_phrase(spark, sf):
    return fulltext.build(_docs(spark, sf), ["doc_id"], "text").holding(PHRASES[0])


def fts_bm25_topk(spark, sf):
    return fulltext.build(_docs(spark, sf), ["doc_id"], "text").bm25(PHRASES, 20).select("doc_id", F.round("rank", 6).alias("rank"))


def fts_bm25_deleted(spark, sf):
    """The same after every third document has been deleted from the index."""
    docs = _docs(spark, sf)
    index = fulltext.build(docs, ["doc_id"], "text")
    index.delete(docs.where("doc_id % 3 = 1"))
    return index.bm25(PHRASES, 20).select("doc_id", F.round("rank", 6).alias("rank"))


#: DuckDB's own folding, which shares no table with ours.
_FOLD_SQL = "strip_accents(lower(text))"
_WORDS_SQL = f"SELECT doc_id, list_filter(string_split_regex({_FOLD_SQL}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS w FROM documents"


def _freq_sql(phrase) -> str:
    n = len(phrase)
    want = "[" + ", ".join(map(_q, phrase)) + "]"
    return f"len(list_filter(range(1, len(w) + 1), lambda i: w[i:i + {n - 1}] = {want}))"


def _bm25_sql(where_docs: str = "true") -> str:
    f = ", ".join(f"CAST({_freq_sql(p)} AS DOUBLE) AS f{i}" for i, p in enumerate(PHRASES))
    d = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(PHRASES)))
    term = " + ".join(f"(CASE WHEN 2 * d{i} < n THEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) ELSE 1e-6 END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / a))" for i in range(len(PHRASES)))
    where = " AND ".join(f"f{i} > 0" for i in range(len(PHRASES)))
    return f"WITH t AS ({_WORDS_SQL} WHERE {where_docs}), f AS (SELECT doc_id, len(w) AS size, {f} FROM t), g AS (SELECT count(*) AS n, avg(size) AS a, {d} FROM f), r AS (SELECT doc_id, -({term}) AS v FROM f, g WHERE {where}) SELECT doc_id, round(v, 6) AS rank FROM r ORDER BY v, doc_id LIMIT 20"


# ------------------------------------------------------------ text


def text_dehyphenate(spark, sf):
    broken = F.regexp_replace("text", "ti", "t-\ni")
    return _docs(spark, sf).select("doc_id", T.dehyphenate(broken).alias("text"))


def text_table_rows(spark, sf):
    wide = F.replace("text", F.lit(", "), F.lit(",      "))
    return _docs(spark, sf).select("doc_id", T.table_rows(F.regexp_replace(wide, r"\. ", ".  ")).alias("text"))


def text_blank_collapse(spark, sf):
    return _docs(spark, sf).select("doc_id", T.collapse_blank_lines(F.concat(F.lit(" \n"), F.replace("text", F.lit("\n"), F.lit("\n\n\n\n\n")), F.lit("\n "))).alias("text"))


def text_line_fingerprints(spark, sf):
    lines = _docs(spark, sf).select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.groupBy(T.line_fingerprint(F.col("line")).alias("fingerprint")).agg(F.count("*").alias("n"))


def _pages(spark, sf) -> DataFrame:
    """Documents cut into pages of LINES_PER_PAGE lines, each with a running header."""
    lines = F.split("text", "\n", -1)
    starts = F.sequence(F.lit(0), F.size("lines") - 1, F.lit(LINES_PER_PAGE))
    pages = _docs(spark, sf).select("doc_id", "source", lines.alias("lines")).select("doc_id", "source", F.posexplode(F.transform(starts, lambda s: F.array_join(F.slice("lines", s + 1, LINES_PER_PAGE), "\n"))).alias("i", "body"))
    return pages.select("doc_id", (F.col("i") + 1).alias("page_number"), F.concat(F.lit("Report of "), F.col("source"), F.lit(" page "), (F.col("i") + 1).cast("string"), F.lit("\n"), F.col("body")).alias("text"))


_PAGES_SQL = f"""
pages AS (SELECT doc_id, i + 1 AS page_number, 'Report of ' || source || ' page ' || (i + 1) || chr(10) || array_to_string(lines[i * {LINES_PER_PAGE} + 1:(i + 1) * {LINES_PER_PAGE}], chr(10)) AS text
  FROM (SELECT doc_id, source, lines, unnest(range(0, CAST(ceil(len(lines) / {LINES_PER_PAGE}.0) AS BIGINT))) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents))),
joined AS (SELECT doc_id, count(*) AS pages, string_agg('[Page ' || page_number || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY page_number) AS text FROM pages GROUP BY doc_id)
"""


def page_markers(spark, sf):
    return headers.join_pages(_pages(spark, sf)).select("doc_id", "pages", "text")


def header_footer_removed(spark, sf):
    return headers.remove_repeated_lines(headers.join_pages(_pages(spark, sf)))


_HEADER_SQL = f"""WITH {_PAGES_SQL},
lines AS (SELECT doc_id, pages, pos, ls[pos] AS line, regexp_replace(trim(ls[pos], {_WHITE_SQL}), '\\p{{Nd}}+', '#', 'g') AS print
  FROM (SELECT doc_id, pages, ls, unnest(range(1, len(ls) + 1)) AS pos FROM (SELECT doc_id, pages, string_split(text, chr(10)) AS ls FROM joined))),
noise AS (SELECT doc_id, print FROM lines WHERE pages >= 3 AND length(print) > 5 GROUP BY doc_id, print HAVING count(*) >= 0.6 * min(pages)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS t FROM lines l WHERE NOT EXISTS (SELECT 1 FROM noise n WHERE n.doc_id = l.doc_id AND n.print = l.print) GROUP BY doc_id)
SELECT j.doc_id, CASE WHEN j.doc_id IN (SELECT doc_id FROM noise) THEN coalesce(k.t, '') ELSE j.text END AS text FROM joined j LEFT JOIN kept k ON j.doc_id = k.doc_id"""


def _linear(table: str, key: str, columns: tuple[str, ...]):
    def run(spark, sf):
        rows = _t(spark, sf, table)
        return rows.select(key, T.linearise(list(columns), [F.col(c).cast("string") for c in columns]).alias("line"))

    parts = ", ".join(f"CASE WHEN trim(CAST({c} AS VARCHAR), {_WHITE_SQL}) <> '' THEN '{c}: ' || CAST({c} AS VARCHAR) END" for c in columns)
    return run, f"SELECT {key}, nullif(concat_ws('; ', {parts}), '') AS line FROM {table}"


_EXT = "CASE doc_id % 6 WHEN 0 THEN '.TXT' WHEN 1 THEN '.pdf' WHEN 2 THEN '.exe' WHEN 3 THEN '' WHEN 4 THEN '.tar.csv' ELSE '.Docx' END"


def file_type_gate(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.concat(F.col("source"), F.lit("/a b"), F.expr(_EXT)).alias("name"), (F.col("doc_id") * 1_000_000).alias("size"))
    return rows.select("doc_id", T.file_type(F.col("name")).alias("file_type"), T.is_accepted(F.col("name"), F.col("size"), DEFAULTS.max_file_bytes).alias("accepted"))


_ASK = "CASE doc_id % 4 WHEN 0 THEN ' SQLITE , vector' WHEN 1 THEN 'markdown,markdown' WHEN 2 THEN 'sqlite,markdown,vector,' ELSE 'vector' END"


def output_formats_canonical(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.expr(_ASK).alias("asked"))
    return rows.select("doc_id", F.array_join(T.output_formats(F.col("asked")), ",").alias("formats"))


_NAME = "CASE doc_id % 5 WHEN 0 THEN 'robot arm/spec v' || doc_id || '.pdf' WHEN 1 THEN '' WHEN 2 THEN 'größe' || doc_id || '.x.md' WHEN 3 THEN '.hidden' ELSE source || '+' || doc_id || '.txt' END"


def export_stems(spark, sf):
    return _docs(spark, sf).select("doc_id", F.expr(_NAME).alias("name")).select("doc_id", T.export_stem(F.col("name")).alias("stem"))


# ------------------------------------------------------------ exports


def markdown_render(spark, sf):
    return _docs(spark, sf).select("doc_id", T.markdown(F.col("filename"), T.file_type(F.col("filename")), F.col("text"), F.lit(STAMP)).alias("markdown"))


_MARKDOWN_SQL = f"'# ' || regexp_replace(filename, '\\.txt$', '') || chr(10) || chr(10) || '> Source: `' || filename || '` (txt)  ' || chr(10) || '> Generated: {STAMP}' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || trim(text, {_WHITE_SQL}) || chr(10)"


def _sections(spark, sf) -> DataFrame:
    """Every fourth document has no Markdown artifact."""
    docs = _docs(spark, sf)
    body = T.markdown(F.col("filename"), T.file_type(F.col("filename")), F.col("text"), F.lit(STAMP))
    artifacts = docs.where("doc_id % 4 <> 1").select(F.col("doc_id").alias("of"), body.alias("md"))
    return docs.select("source", "doc_id", "filename").join(artifacts, F.col("doc_id") == F.col("of"), "left")


def markdown_bundle(spark, sf):
    return export.markdown_bundle(_sections(spark, sf), "source", F.col("source"), "doc_id", "filename", "md")


def markdown_bundle_pieces(spark, sf):
    """The bundles piece by piece, with each piece's place in bytes."""
    pieces = export.bundle_pieces(_sections(spark, sf), "source", F.col("source"), "doc_id", "filename", "md")
    return pieces.select("source", "piece", "pieces", "offset", F.octet_length("text").cast("long").alias("size_bytes"), F.sha2("text", 256).alias("sha256"))


def markdown_missing(spark, sf):
    return _sections(spark, sf).where("md IS NULL").select("source", "doc_id", "filename")


_BUNDLE_SQL = f"""WITH d AS ({_DOCS_SQL}), s AS (SELECT source, doc_id, filename, CASE WHEN doc_id % 4 <> 1 THEN {_MARKDOWN_SQL} END AS md FROM d)
SELECT source, '# ' || source || ' — Document Library' || chr(10) || coalesce(chr(10) || chr(10) || '> Not included (uploaded without the markdown output): ' || string_agg('`' || filename || '`', ', ' ORDER BY doc_id) FILTER (md IS NULL) || chr(10), '') || chr(10) || chr(10) || string_agg(md, chr(10) || chr(10) ORDER BY doc_id) AS markdown
FROM s GROUP BY source HAVING count(md) > 0"""

_PIECES_SQL = f"""WITH d AS ({_DOCS_SQL}), s AS (SELECT source, doc_id, filename, CASE WHEN doc_id % 4 <> 1 THEN {_MARKDOWN_SQL} END AS md FROM d),
h AS (SELECT source FROM s GROUP BY source HAVING count(md) > 0),
m AS (SELECT source, doc_id, filename, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY source) AS of FROM s WHERE md IS NULL),
p AS (SELECT source, 0 AS kind, NULL AS doc_id, '# ' || source || ' — Document Library' || chr(10) AS t FROM h
  UNION ALL SELECT source, 1, doc_id, CASE WHEN n = 1 THEN chr(10) || chr(10) || '> Not included (uploaded without the markdown output): ' ELSE ', ' END || '`' || filename || '`' || CASE WHEN n = of THEN chr(10) ELSE '' END FROM m WHERE source IN (SELECT source FROM h)
  UNION ALL SELECT source, 2, doc_id, chr(10) || chr(10) || md FROM s WHERE md IS NOT NULL)
SELECT source, row_number() OVER w AS piece, count(*) OVER (PARTITION BY source) AS pieces, CAST(sum(strlen(t)) OVER w - strlen(t) AS BIGINT) AS offset, strlen(t) AS size_bytes, sha256(t) AS sha256
FROM p WINDOW w AS (PARTITION BY source ORDER BY kind, doc_id ROWS UNBOUNDED PRECEDING)"""


def sqlite_export_rows(spark, sf):
    return export.numbered_chunks(_chunks(spark, sf), "source", "doc_id", "chunk_index").select("source", "row_id", "doc_id", "chunk_index", "content")


def sqlite_export_bytes(spark, sf):
    docs = _docs(spark, sf).select("source", F.col("doc_id").cast("string").alias("document_id"), "filename", F.lit("txt").alias("file_type"), F.col("doc_id").alias("position"))
    chunks = _chunks(spark, sf).select("source", F.col("doc_id").cast("string").alias("document_id"), "chunk_index", "content")
    parts = export.sqlite_parts(docs, chunks, "source", STAMP)
    return parts.groupBy("source").agg(F.sum(F.length("content")).cast("long").alias("size_bytes"))


def sqlite_export_contents(spark, sf):
    """The exported files read back, with what their own full-text index finds."""
    docs = _docs(spark, sf).select("source", F.col("doc_id").cast("string").alias("document_id"), "filename", F.lit("txt").alias("file_type"), F.col("doc_id").alias("position"))
    chunks = _chunks(spark, sf).select("source", F.col("doc_id").cast("string").alias("document_id"), "chunk_index", "content")
    return export.sqlite_contents(export.sqlite_parts(docs, chunks, "source", STAMP), "source", '"' + " ".join(PHRASES[0]) + '"')


def fts_export_join(spark, sf):
    """What a user's lookup in the exported file gives: index, chunks and documents joined."""
    hits = fulltext.build(_chunks(spark, sf), ["doc_id", "chunk_index"]).holding(PHRASES[0])
    return hits.join(_docs(spark, sf).select("doc_id", "filename"), "doc_id").select("filename", "doc_id", "chunk_index")


# ------------------------------------------------------------ catalogue


def delete_cascade(spark, sf):
    gone = _docs(spark, sf).where("doc_id % 10 = 4").select("doc_id")
    left = catalog.without(_chunks(spark, sf), gone, "doc_id")
    return left.groupBy("doc_id").agg(F.count("*").alias("chunks"))


def _keys(spark, sf) -> DataFrame:
    rows = _t(spark, sf, "customer")
    return rows.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("tenant_id"), catalog.hashed(F.concat(F.lit("key-"), "c_name")).alias("key_hash"), F.when(F.col("c_custkey") % 2 == 0, "admin").otherwise("retrieval").alias("scope"), (F.col("c_custkey") % 5 != 0).alias("is_active"))


def _tenants(spark, sf) -> DataFrame:
    return _t(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), T.slugify(F.col("n_name")).alias("slug"), (F.col("n_nationkey") % 4 != 0).alias("is_active"))


def api_key_hashes(spark, sf):
    return _keys(spark, sf).select("id", "key_hash")


def auth_lookup(spark, sf):
    return catalog.valid_keys(_keys(spark, sf), _tenants(spark, sf)).select("id", "key_hash", "scope", "slug")


def slug_conflicts(spark, sf):
    new = _t(spark, sf, "supplier").select("s_suppkey", T.slugify(F.when(F.col("s_suppkey") % 3 == 0, F.lit("  nation 7 ")).otherwise(F.col("s_name"))).alias("slug"))
    return catalog.conflicts(new, _tenants(spark, sf), "slug").select("s_suppkey", "slug")


_SLUG_SQL = "regexp_replace(regexp_replace(lower(trim({})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_TENANTS_SQL = f"SELECT n_nationkey AS id, {_SLUG_SQL.format('n_name')} AS slug, n_nationkey % 4 <> 0 AS is_active FROM nation"


def flagship(spark, sf):
    return _keyword(KEYWORD)[0](spark, sf)


_KEYWORDS = {
    "keyword_single_term": _keyword(KEYWORD), "keyword_multi_term": _keyword(MULTI), "keyword_literal_wildcards": _keyword(WILD), "keyword_short_token": _keyword("a"),
    "keyword_tenant_scoped": _keyword("the", "src0"), "keyword_blank_query": _keyword(BLANK), "keyword_duplicate_terms": _keyword(DUPLICATE),
}
_SEMANTICS = {"semantic_topk": _semantic(None, 20), "semantic_scoped": _semantic("label = 3", 10)}
_LINES = {
    "csv_linearise_part": _linear("part", "p_partkey", ("p_name", "p_brand", "p_type", "p_size")),
    "csv_linearise_customer": _linear("customer", "c_custkey", ("c_name", "c_nationkey", "c_mktsegment")),
}

_PAIRED = _KEYWORDS | _SEMANTICS | _LINES
QUERIES = {k: run for k, (run, _) in _PAIRED.items()} | {
    f.__name__: f
    for f in (
        chunk_documents, chunk_counts_by_doc, tenant_dashboard, document_list_desc, document_status, keyword_phrase_benchmark, keyword_batch_topk, semantic_batch_topk, semantic_ann_topk, semantic_skip_null,
        fts_tokens, fts_postings, fts_phrase, fts_bm25_topk, fts_bm25_deleted, fts_export_join, text_dehyphenate, text_table_rows, text_blank_collapse, text_line_fingerprints, page_markers, header_footer_removed,
        file_type_gate, output_formats_canonical, export_stems, markdown_render, markdown_bundle, markdown_bundle_pieces, markdown_missing, sqlite_export_rows, sqlite_export_bytes, sqlite_export_contents, delete_cascade, api_key_hashes, auth_lookup, slug_conflicts,
    )
}

_STATUS_SQL = f"CASE WHEN doc_id % 7 = 3 THEN 'processing' WHEN trim(text, {_WHITE_SQL}) <> '' THEN 'ready' ELSE 'failed' END"
_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
ORACLES = {k: sql for k, (_, sql) in _PAIRED.items()} | {
    "chunk_documents": f"{_CHUNKS_SQL} SELECT doc_id, chunk_index, content FROM chunks",
    "chunk_counts_by_doc": f"{_CHUNKS_SQL} SELECT d.doc_id, count(c.content) AS chunk_count, CAST(coalesce(sum(length(c.content)), 0) AS BIGINT) AS characters FROM documents d LEFT JOIN chunks c ON d.doc_id = c.doc_id GROUP BY d.doc_id",
    "tenant_dashboard": f"{_CHUNKS_SQL}, n AS (SELECT doc_id, count(*) AS c FROM chunks GROUP BY doc_id) SELECT source AS tenant_id, count(*) AS document_count, CAST(coalesce(sum(CASE WHEN {_STATUS_SQL.replace('doc_id', 'd.doc_id')} = 'ready' THEN c END), 0) AS BIGINT) AS chunk_count FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id GROUP BY source",
    "document_list_desc": f"SELECT source, doc_id, filename, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS position, count(*) OVER (PARTITION BY source) AS total FROM ({_DOCS_SQL})",
    "document_status": f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR trim(text, {_WHITE_SQL}) = '' THEN 'failed' ELSE 'ready' END AS status FROM documents",
    "keyword_phrase_benchmark": f"SELECT item_id, doc_id, CAST(1.0 AS DOUBLE) AS score FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(trim(b.text, {_WHITE_SQL})))",
    "keyword_batch_topk": _batch_sql(),
    "semantic_batch_topk": f"WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, 1 - {_COS} AS distance FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d) SELECT query_id, rank, vec_id, round(1 - distance, 4) AS score FROM r WHERE rank <= 5",
    "semantic_skip_null": f"SELECT vec_id, round(c, 4) AS score FROM (SELECT e.vec_id, {_COS} AS c FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.vec_id % 3 <> 1) ORDER BY 1 - c, vec_id LIMIT 10",
    "fts_tokens": f"SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM ({_WORDS_SQL})",
    "fts_postings": f"SELECT token, count(*) AS occurrences, count(DISTINCT doc_id) AS documents, CAST(min(pos) AS BIGINT) AS first_pos FROM (SELECT doc_id, unnest(w) AS token, unnest(range(0, len(w))) AS pos FROM ({_WORDS_SQL})) GROUP BY token",
    "fts_phrase": f"SELECT doc_id, frequency FROM (SELECT doc_id, {_freq_sql(PHRASES[0])} AS frequency FROM ({_WORDS_SQL})) WHERE frequency > 0",
    "fts_bm25_topk": _bm25_sql(),
    "fts_bm25_deleted": _bm25_sql("doc_id % 3 <> 1"),
    "fts_export_join": f"{_CHUNKS_SQL}, t AS (SELECT doc_id, chunk_index, list_filter(string_split_regex({_FOLD_SQL.replace('text', 'content')}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS w FROM chunks) SELECT filename, t.doc_id, chunk_index FROM t JOIN ({_DOCS_SQL}) d ON t.doc_id = d.doc_id WHERE {_freq_sql(PHRASES[0])} > 0",
    "text_dehyphenate": "SELECT doc_id, regexp_replace(replace(text, 'ti', 't-' || chr(10) || 'i'), '([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])', '\\1\\2', 'g') AS text FROM documents",
    "text_table_rows": f"SELECT doc_id, array_to_string(list_transform(string_split(replace(replace(text, ', ', ',      '), '. ', '.  '), chr(10)), lambda l: CASE WHEN regexp_matches(l, '\\S\\s{{4,}}\\S') THEN regexp_replace(trim(l, {_WHITE_SQL}), '\\s{{3,}}', ' | ', 'g') ELSE regexp_replace(l, ' {{2,}}', ' ', 'g') END), chr(10)) AS text FROM documents",
    "text_blank_collapse": f"SELECT doc_id, trim(regexp_replace(' ' || chr(10) || replace(text, chr(10), repeat(chr(10), 5)) || chr(10) || ' ', '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), {_WHITE_SQL}) AS text FROM documents",
    "text_line_fingerprints": f"SELECT regexp_replace(trim(line, {_WHITE_SQL}), '\\p{{Nd}}+', '#', 'g') AS fingerprint, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1",
    "page_markers": f"WITH {_PAGES_SQL} SELECT doc_id, pages, text FROM joined",
    "header_footer_removed": _HEADER_SQL,
    "file_type_gate": f"SELECT doc_id, file_type, file_type IN ('csv', 'docx', 'md', 'pdf', 'txt') AND doc_id * 1000000 <= {DEFAULTS.max_file_bytes} AS accepted FROM (SELECT doc_id, lower(regexp_extract({_EXT}, '\\.([^.]*)$', 1)) AS file_type FROM documents)",
    "output_formats_canonical": f"SELECT doc_id, array_to_string(list_filter(['vector', 'markdown', 'sqlite'], lambda f: list_contains(list_transform(string_split({_ASK}, ','), lambda p: lower(trim(p))), f)), ',') AS formats FROM documents",
    "export_stems": "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'spec_v' || doc_id WHEN 1 THEN 'document' WHEN 2 THEN 'größe' || doc_id || '.x' WHEN 3 THEN '.hidden' ELSE source || '_' || doc_id END AS stem FROM documents",
    "markdown_render": f"SELECT doc_id, {_MARKDOWN_SQL} AS markdown FROM ({_DOCS_SQL})",
    "markdown_bundle": _BUNDLE_SQL,
    "markdown_bundle_pieces": _PIECES_SQL,
    "sqlite_export_contents": f"{_CHUNKS_SQL}, t AS (SELECT *, list_filter(string_split_regex({_FOLD_SQL.replace('text', 'content')}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS w FROM chunks) SELECT t.source, row_number() OVER (PARTITION BY t.source ORDER BY t.doc_id, chunk_index) AS row_id, CAST(t.doc_id AS VARCHAR) AS document_id, filename, chunk_index, content, {_freq_sql(PHRASES[0])} > 0 AS found FROM t JOIN ({_DOCS_SQL}) d ON d.doc_id = t.doc_id",
    "markdown_missing": f"SELECT source, doc_id, filename FROM ({_DOCS_SQL}) WHERE doc_id % 4 = 1",
    "sqlite_export_rows": f"{_CHUNKS_SQL} SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id, chunk_index) AS row_id, doc_id, chunk_index, content FROM chunks",
    "delete_cascade": f"{_CHUNKS_SQL} SELECT doc_id, count(*) AS chunks FROM chunks WHERE doc_id % 10 <> 4 GROUP BY doc_id",
    "api_key_hashes": "SELECT c_custkey AS id, sha256('key-' || c_name) AS key_hash FROM customer",
    "auth_lookup": f"SELECT c_custkey AS id, sha256('key-' || c_name) AS key_hash, CASE WHEN c_custkey % 2 = 0 THEN 'admin' ELSE 'retrieval' END AS scope, slug FROM customer JOIN ({_TENANTS_SQL}) t ON c_nationkey = t.id WHERE t.is_active AND c_custkey % 5 <> 0",
    "slug_conflicts": f"SELECT s_suppkey, slug FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'nation-7' ELSE {_SLUG_SQL.format('s_name')} END AS slug FROM supplier) WHERE slug IN (SELECT slug FROM ({_TENANTS_SQL}))",
}
