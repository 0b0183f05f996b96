"""Tenants, keys and documents: lookups, uniqueness, deletion, dashboards."""

from __future__ import annotations

import hashlib
import re
import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPES = ("admin", "retrieval")
#: Which calls need an admin key; the others take any valid key.
ADMIN_ONLY = frozenset(("upload", "upload_batch", "delete", "export", "export_sqlite", "export_markdown", "create_key", "list_keys"))
_PREFIX = {"admin": "adm_", "retrieval": "ret_"}


class Denied(PermissionError):
    """status: 401 without a valid key, 403 without the right scope."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def new_key(scope: str) -> str:
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {', '.join(SCOPES)}")
    return _PREFIX[scope] + secrets.token_urlsafe(32)


def key_hash(key: str) -> str:
    return hashlib.sha256(key.encode()).hexdigest()


def hashed(key: Column) -> Column:
    return F.sha2(key, 256)


def check_slug(slug: str) -> str:
    if not 1 <= len(slug) <= 100 or not re.fullmatch(r"[a-z0-9\-]+", slug):
        raise ValueError("a slug has 1 to 100 of a-z, 0-9 and hyphen")
    return slug


def check_name(name: str) -> str:
    if not 1 <= len(name) <= 255:
        raise ValueError("a name has 1 to 255 characters")
    return name


def at_most_one(df: DataFrame):
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("more than one row found")
    return rows[0] if rows else None


def valid_keys(keys: DataFrame, tenants: DataFrame) -> DataFrame:
    """Active keys of active tenants."""
    live = tenants.where("is_active").select(F.col("id").alias("tenant_id"), "slug", F.col("name").alias("tenant_name"))
    return keys.where("is_active").join(live, "tenant_id")


def authenticate(keys: DataFrame, tenants: DataFrame, key: str | None, call: str = "retrieve"):
    """The key's row, with its tenant's slug and name."""
    found = at_most_one(valid_keys(keys.where(F.col("key_hash") == key_hash(key)), tenants)) if key else None
    if found is None:
        raise Denied(401, "missing or invalid key")
    if call in ADMIN_ONLY and found.scope != "admin":  # as ``permitted`` has it
        raise Denied(403, "this call needs an admin key")
    return found


def conflicts(new: DataFrame, old: DataFrame, column: str) -> DataFrame:
    """Rows of ``new`` whose value ``old`` has already."""
    return new.join(old.select(column), column, "left_semi")


def without(rows: DataFrame, gone: DataFrame, column: str, gone_column: str | None = None) -> DataFrame:
    """Rows that a deletion leaves."""
    return rows.join(gone.select(F.col(gone_column or column).alias(column)), column, "left_anti")


def latest(rows: DataFrame, key: str = "id", revision: str = "revision") -> DataFrame:
    """Of each key the row with the highest revision."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), revision).alias("last"))
    return last.select("last.*")


def permitted(scope: Column, call: str) -> Column:
    """Whether a key of a scope may make a call."""
    return F.lit(call not in ADMIN_ONLY) | (scope == "admin")


def dashboard(documents: DataFrame, tenant: str = "tenant_id") -> DataFrame:
    """(tenant, document_count, chunk_count): all documents, chunks of the ready ones."""
    ready = F.sum(F.when(F.col("status") == "ready", F.col("chunk_count").cast("long")))
    return documents.groupBy(tenant).agg(F.count("*").alias("document_count"), F.coalesce(ready, F.lit(0).cast("long")).alias("chunk_count"))


def status(text: Column, chunks: Column) -> Column:
    """ready, or failed for a text that is blank or gives no chunk."""
    return F.when((F.size(chunks) > 0) & text.isNotNull(), "ready").otherwise("failed")
