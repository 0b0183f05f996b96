"""Schemas of the stored tables."""

from pyspark.sql import types as P

_KINDS = {
    "string": P.StringType(), "boolean": P.BooleanType(), "timestamp": P.TimestampType(), "int": P.IntegerType(), "long": P.LongType(), "binary": P.BinaryType(),
    "strings": P.ArrayType(P.StringType()), "floats": P.ArrayType(P.FloatType()),
}


def _of(columns: str) -> P.StructType:
    return P.StructType([P.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in columns.split(","))])


TENANTS = _of("id string, name string, slug string, is_active boolean, created_at timestamp")
API_KEYS = _of("id string, tenant_id string, key_hash string, label string, scope string, is_active boolean, created_at timestamp")
DOCUMENTS = _of("id string, tenant_id string, filename string, file_type string, file_size_bytes long, status string, output_formats strings, chunk_count int, error_message string, created_at timestamp, upload string, revision int")
CHUNKS = _of("id string, tenant_id string, document_id string, chunk_index int, content string, embedding floats, created_at timestamp")
ARTIFACTS = _of("id string, tenant_id string, document_id string, format string, filename string, content binary, size_bytes int, created_at timestamp")
#: Keys are stored twice: by the first digits of their hash, to be looked up, and by tenant, to be listed.
TABLES = {"tenants": TENANTS, "api_keys": API_KEYS, "tenant_keys": API_KEYS, "documents": DOCUMENTS, "chunks": CHUNKS, "artifacts": ARTIFACTS}
