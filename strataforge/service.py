"""The engine's calls over stored tables: tenants, keys, uploads, search, exports, deletion.

Tables are those of ``store``: versions of Parquet folders, in parts. Documents, chunks and artifacts have a part a tenant,
so a tenant's calls read its rows only; keys lie by the first digits of their hash, so that a caller is found by one part.
Each method that acts for a tenant takes the caller's key.

A document's row is written when work on it begins (``processing``) and again, with a higher revision, when it ends; the
highest revision counts. Deletion writes a tenant's rows anew as the next version; an upload at the same time stays, and
an engine may start at any time. What a crash leaves is never read (``Store.clean`` takes it away).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas, work
from .config import DEFAULTS, Settings
from .functions import text as T
from .operators import catalog, chunking, export, search
from .sources import files
from .store import Conflict, Store

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
#: Digits of a hash or an id that name a part.
DIGITS = 2


class Engine:
    """embed: gives vectors of texts; needed for vector output and semantic search. now: the clock."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings = DEFAULTS, embed: Embedder | None = None, now: Callable[[], datetime] = lambda: datetime.now(UTC).replace(tzinfo=None)):
        self.spark, self.root, self.settings, self.embed, self.now = spark, root.rstrip("/"), settings, embed, now
        # documents of earlier releases, which had no formats to choose from, were all for vector search
        defaults = {"documents": {"output_formats": F.array(F.lit("vector")), "revision": F.lit(0)}}
        bloom = {"parquet.bloom.filter.enabled#key_hash": "true"}
        self.store = Store(spark, self.root, schemas.TABLES, defaults, {"api_keys": bloom})
        self.store.upgraded(self._parts)

    def _parts(self, name: str, rows: DataFrame) -> dict[str, DataFrame]:
        """The parts of a store of an earlier layout, whose keys and tenants were tables of their own."""
        if name == "api_keys":
            for tenant, own in self._by(rows, F.col("tenant_id")).items():
                if not self.store.version("tenant_keys", tenant)[0]:
                    self.store.append("tenant_keys", tenant, own)
        if name == "tenants":
            for r in rows.select("slug", "id").collect():  # as many as tenants
                self._claim(r.slug, r.id)
        return self._by(rows, F.substring("id", 1, DIGITS) if name == "tenants" else F.substring("key_hash", 1, DIGITS) if name == "api_keys" else F.col("tenant_id"))

    @staticmethod
    def _by(rows: DataFrame, part) -> dict[str, DataFrame]:
        return {r[0]: rows.where(part == r[0]) for r in rows.select(part.alias("part")).distinct().collect()}

    def _claim(self, slug: str, tenant: str) -> bool:
        """A slug belongs to the tenant whose file is created first."""
        try:
            self.store.create(f"{self.root}/slugs/{slug}", tenant)
        except Conflict:
            return False
        return True

    def health(self) -> dict:
        """``ok`` if every table can be read, else ``degraded``, and what each says."""
        checks = {}
        for name in schemas.TABLES:
            try:
                self.table(name).limit(1).count()
                checks[name] = "ok"
            except Exception as e:  # whatever it is, the call reports it
                checks[name] = f"error: {type(e).__name__}"
        return {"status": "ok" if set(checks.values()) == {"ok"} else "degraded", "checks": checks}

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def _append(self, name: str, part: str, rows: DataFrame) -> None:
        self.store.append(name, part, rows)

    def _rows(self, name: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, schemas.TABLES[name])

    def _caller(self, key: str | None, call: str):
        digest = catalog.key_hash(key or "")
        keys = self.store.read("api_keys", digest[:DIGITS]).where(F.col("key_hash") == digest)
        found = catalog.at_most_one(keys) if key else None
        tenants = self.store.read("tenants", found.tenant_id[:DIGITS]) if found else self._rows("tenants", [])
        return catalog.authenticate(keys, tenants, key, call)

    def _own(self, name: str, tenant: str) -> DataFrame:
        rows = self.store.read(name, tenant)
        return catalog.latest(rows) if name == "documents" else rows

    # tenants and keys

    def create_tenant(self, name: str, slug: str) -> dict:
        """A tenant and its first admin key, which is shown only here."""
        catalog.check_name(name), catalog.check_slug(slug)
        tenant = str(uuid.uuid4())
        if not self._claim(slug, tenant):
            raise ValueError(f"slug {slug} is taken")
        self._append("tenants", tenant[:DIGITS], self._rows("tenants", [(tenant, name, slug, True, self.now())]))
        return {"id": tenant, "name": name, "slug": slug, "key": self._new_key(tenant, "default admin key", "admin")}

    def seed(self, name: str, slug: str) -> str:
        """A tenant to try things with, told as the statements that would make it and the keys that open it."""
        made = self.create_tenant(name, slug)
        reader, now = self._new_key(made["id"], "Test retrieval key", "retrieval"), self.now().isoformat()
        quoted = lambda v: "'" + str(v).replace("'", "''") + "'"
        rows = [(uuid.uuid4(), made["id"], catalog.key_hash(key), label, scope) for key, label, scope in ((made["key"], "Test admin key", "admin"), (reader, "Test retrieval key", "retrieval"))]
        statements = [f"INSERT INTO tenants (id, name, slug, is_active, created_at)\nVALUES ({', '.join(map(quoted, (made['id'], name, slug)))}, true, {quoted(now)});"]
        statements += [f"INSERT INTO api_keys (id, tenant_id, key_hash, label, scope, is_active, created_at)\nVALUES ({', '.join(map(quoted, r))}, true, {quoted(now)});" for r in rows]
        return "\n\n".join([*statements, f"Tenant:        {name} ({slug})\nAdmin key:     {made['key']}\nRetrieval key: {reader}"])

    def _new_key(self, tenant: str, label: str, scope: str) -> str:
        key = catalog.new_key(scope)
        digest = catalog.key_hash(key)
        row = self._rows("api_keys", [(str(uuid.uuid4()), tenant, digest, label, scope, True, self.now())])
        self._append("tenant_keys", tenant, row)
        self._append("api_keys", digest[:DIGITS], row)
        return key

    def create_key(self, key: str, label: str, scope: str) -> str:
        return self._new_key(self._caller(key, "create_key").tenant_id, catalog.check_name(label), scope)

    def list_keys(self, key: str) -> DataFrame:
        return self._own("tenant_keys", self._caller(key, "list_keys").tenant_id).where("is_active").select("id", "label", "scope", "created_at")

    def me(self, key: str) -> dict:
        caller = self._caller(key, "me")
        row = catalog.dashboard(self._own("documents", caller.tenant_id)).first()
        return {"id": caller.tenant_id, "slug": caller.slug, "name": caller.tenant_name, "document_count": row.document_count if row else 0, "chunk_count": row.chunk_count if row else 0}

    # documents

    def _formats(self, output: str) -> list[str]:
        asked = [x.strip().lower() for x in output.split(",") if x.strip()]
        if not asked:
            raise ValueError("No output format")
        if unknown := [x for x in asked if x not in T.FORMATS]:
            raise ValueError(f"Unknown output format: {', '.join(unknown)}")
        if "vector" in asked and self.embed is None:
            raise ValueError("vector output needs an embedder")
        return [f for f in T.FORMATS if f in asked]

    def upload(self, key: str, uploads: DataFrame, output: str = "vector") -> DataFrame:
        """Ingest files (filename, size, content); unsupported or too large ones raise."""
        caller, formats = self._caller(key, "upload"), self._formats(output)
        if bad := uploads.where(~T.is_accepted(F.col("filename"), F.col("size"), self.settings.max_file_bytes)).select("filename").head(1):
            raise ValueError(f"unsupported or too large: {bad[0].filename}")
        return self._ingest(caller.tenant_id, uploads, formats)

    def upload_batch(self, key: str, uploads: DataFrame, output: str = "vector", upload: str | None = None) -> DataFrame:
        """Ingest files; unsupported and too large ones are skipped. An ``upload`` with a name happens once, however often called."""
        caller, formats = self._caller(key, "upload_batch"), self._formats(output)
        if upload is not None:
            before = self._own("documents", caller.tenant_id).where(F.col("upload") == upload).select("id", "status")
            if before.count():
                if before.where("status = 'processing'").isEmpty():
                    return self._uploaded(caller.tenant_id, upload)
                self._drop(caller.tenant_id, before.select("id"))  # it was cut short: once more from the start
        return self._ingest(caller.tenant_id, uploads.where(T.is_accepted(F.col("filename"), F.col("size"), self.settings.max_file_bytes)), formats, upload)

    def _uploaded(self, tenant: str, upload: str) -> DataFrame:
        return self._own("documents", tenant).where(F.col("upload") == upload)

    def _ingest(self, tenant: str, uploads: DataFrame, formats: list[str], upload: str | None = None) -> DataFrame:
        upload = upload or uuid.uuid4().hex
        stage = f"{self.root}/_staging/{uuid.uuid4().hex}"
        try:
            self._work(tenant, uploads, formats, upload, stage)
        except Exception as e:
            begun = self._uploaded(tenant, upload).where("status = 'processing'")
            self._append("documents", tenant, begun.withColumns({"status": F.lit("failed"), "error_message": F.lit(str(e)[:1000]), "revision": F.lit(2)}))
            raise
        finally:
            self.store.delete(stage)
        return self._uploaded(tenant, upload)

    def _work(self, tenant: str, uploads: DataFrame, formats: list[str], upload: str, stage: str) -> None:
        # names are given once and stored; everything below reads them from there
        uploads.select("filename", "size", "content").withColumn("document_id", F.expr("uuid()")).write.parquet(f"{stage}/files")
        raw = self.spark.read.parquet(f"{stage}/files")
        kind, given = T.file_type(F.col("filename")), F.array(*map(F.lit, formats))
        begun = F.lit(self.now())
        self._append("documents", tenant, raw.select(
            F.col("document_id").alias("id"), F.lit(tenant).alias("tenant_id"), "filename", kind.alias("file_type"), F.col("size").cast("long").alias("file_size_bytes"), F.lit("processing").alias("status"),
            given.alias("output_formats"), F.lit(0).alias("chunk_count"), F.lit(None).cast("string").alias("error_message"), begun.alias("created_at"), F.lit(upload).alias("upload"), F.lit(0).alias("revision"),
        ))
        parsed = chunking.with_chunks(files.parse_files(raw, self.settings), settings=self.settings)
        parsed.write.parquet(f"{stage}/parsed")
        parsed, now = self.spark.read.parquet(f"{stage}/parsed"), begun
        state = catalog.status(F.col("text"), F.col("chunks"))
        why = F.when(F.col("error").isNotNull(), T.error_message(F.col("error"))).when(T.is_blank(F.coalesce("text", F.lit(""))), "the file holds no text").when(F.size("chunks") == 0, "no chunks")
        docs = parsed.join(raw.select("document_id", "size"), "document_id").select(
            F.col("document_id").alias("id"), F.lit(tenant).alias("tenant_id"), "filename", kind.alias("file_type"), F.col("size").cast("long").alias("file_size_bytes"),
            state.alias("status"), given.alias("output_formats"), F.when(state == "ready", F.size("chunks")).otherwise(0).alias("chunk_count"), why.alias("error_message"), now.alias("created_at"), F.lit(upload).alias("upload"), F.lit(1).alias("revision"),
        )
        ready = parsed.where(state == "ready")
        parts = ready.select("document_id", F.posexplode("chunks").alias("chunk_index", "content"))
        vector = F.lit(None).cast("array<float>")
        if "vector" in formats:
            embed = self.embed

            @F.pandas_udf("array<float>")
            def embedded(texts):
                import pandas as pd

                return pd.Series([[float(x) for x in v] for v in embed(list(texts))])

            vector = embedded(F.col("content"))
        chunk_id = F.sha2(F.concat_ws(":", "document_id", F.col("chunk_index").cast("string")), 256)
        self._append("chunks", tenant, parts.select(chunk_id.alias("id"), F.lit(tenant).alias("tenant_id"), "document_id", "chunk_index", "content", vector.alias("embedding"), now.alias("created_at")))
        stem, made = T.export_stem(F.col("filename")), self.now()
        artifacts = []
        if "markdown" in formats:
            body = T.markdown(F.col("filename"), T.file_type(F.col("filename")), F.col("text"), F.lit(made.strftime("%Y-%m-%d %H:%M UTC")))
            artifacts.append(ready.select("document_id", F.lit("markdown").alias("format"), F.concat(stem, F.lit(".md")).alias("filename"), F.encode(body, "UTF-8").alias("content")))
        if "sqlite" in formats:
            one = ready.select("document_id", "filename", T.file_type(F.col("filename")).alias("file_type"), F.lit(0).alias("position"), F.col("document_id").alias("one"))
            made_files = export.sqlite_files(one, parts.withColumn("one", F.col("document_id")), "one", made.isoformat())
            artifacts.append(made_files.join(ready.select("document_id", stem.alias("stem")), F.col("one") == F.col("document_id")).select("document_id", F.lit("sqlite").alias("format"), F.concat("stem", F.lit(".db")).alias("filename"), "content"))
        for a in artifacts:
            self._append("artifacts", tenant, a.select(F.expr("uuid()").alias("id"), F.lit(tenant).alias("tenant_id"), "document_id", "format", "filename", "content", F.octet_length("content").alias("size_bytes"), now.alias("created_at")))
        self._append("documents", tenant, docs)

    def list_documents(self, key: str) -> DataFrame:
        """Newest first."""
        return self._own("documents", self._caller(key, "list").tenant_id).orderBy(F.desc("created_at"), "id")

    def delete_document(self, key: str, document_id: str) -> None:
        """The document, its chunks and its artifacts; rewrites the tenant's rows, and no text stays."""
        tenant = self._caller(key, "delete").tenant_id
        if catalog.at_most_one(self._own("documents", tenant).where(F.col("id") == document_id)) is None:
            raise KeyError(document_id)
        self._drop(tenant, self._rows("tenants", [(document_id, None, None, None, None)]).select("id"))

    def _drop(self, tenant: str, gone: DataFrame) -> None:
        """Without the documents ``gone`` (id); their own rows go last, so that a deletion cut short can be repeated."""
        for name, column in (("artifacts", "document_id"), ("chunks", "document_id"), ("documents", "id")):
            self.store.replace(name, tenant, lambda rows, column=column: catalog.without(rows, gone, column, "id"))

    # search

    def retrieve(self, key: str, query: str, mode: str = "semantic", top_k: int | None = None) -> DataFrame:
        """(snippet_id, content, source_filename, relevance_score) of the best chunks of ready documents."""
        tenant, k = self._caller(key, "retrieve").tenant_id, self.settings.limit(top_k)
        if not query:
            raise ValueError("the query is empty")
        docs = self._own("documents", tenant).where("status = 'ready'").select(F.col("id").alias("document_id"), "filename")
        rows = self._own("chunks", tenant).join(docs, "document_id")
        if mode == "keyword":
            found = search.keyword_search(rows, query, k, "document_id", "chunk_index")
        elif mode == "semantic":
            if self.embed is None:
                raise ValueError("semantic search needs an embedder")
            found = search.semantic_search(rows, self.embed([query])[0], k, "document_id", "chunk_index")
        else:
            raise ValueError("mode is semantic or keyword")
        return found.select(F.col("id").alias("snippet_id"), "content", F.col("filename").alias("source_filename"), F.col("score").alias("relevance_score"))

    # exports

    def export(self, key: str, document_id: str, format: str):
        """(filename, content) of one artifact."""
        tenant = self._caller(key, "export").tenant_id
        if format not in ("markdown", "sqlite"):
            raise ValueError("format is markdown or sqlite")
        row = catalog.at_most_one(self._own("artifacts", tenant).where((F.col("document_id") == document_id) & (F.col("format") == format)).select("filename", "content"))
        if row is None:
            raise KeyError(document_id)
        return row.filename, bytes(row.content)

    def _ready(self, tenant: str) -> DataFrame:
        return self._own("documents", tenant).where("status = 'ready'").select("tenant_id", F.col("id").alias("document_id"), "filename", "file_type", F.col("created_at").cast("long").alias("position"))

    def export_sqlite(self, key: str) -> tuple[str, bytes]:
        caller = self._caller(key, "export_sqlite")
        rows = export.sqlite_files(self._ready(caller.tenant_id), self._own("chunks", caller.tenant_id).select("tenant_id", "document_id", "chunk_index", "content"), "tenant_id", self.now().isoformat()).collect()
        if not rows:
            raise KeyError("no documents")
        return f"{caller.slug}-documents.db", bytes(rows[0].content)

    def export_markdown_parts(self, key: str) -> tuple[str, DataFrame]:
        """(name, parts): the bundle as parts (offset, size, content), made by many tasks; in order of their offsets they are the file."""
        caller = self._caller(key, "export_markdown")
        texts = self._own("artifacts", caller.tenant_id).where("format = 'markdown'").select("document_id", F.decode("content", "UTF-8").alias("md"))
        sections = self._ready(caller.tenant_id).join(texts, "document_id", "left")
        pieces = export.bundle_pieces(sections, "tenant_id", F.lit(caller.tenant_name), "position", "filename", "md")
        return f"{caller.slug}-documents.md", export.bundle_parts(pieces, "tenant_id").drop("tenant_id")

    def export_markdown(self, key: str) -> tuple[str, str]:
        """The bundle as one value, for callers that want one; parts arrive one by one."""
        name, parts = self.export_markdown_parts(key)
        text = b"".join(bytes(r.content) for r in work.materialise(parts, "bundle").orderBy("offset").toLocalIterator()).decode()
        if not text:
            raise KeyError("no documents with Markdown output")
        return name, text
