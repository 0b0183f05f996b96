"""What the operators of this subpackage share: work tables, table access, words."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..work import materialise, shared_dir, unused

__all__ = ["WORD", "crc_mod", "materialise", "next_name", "perhaps", "shared_dir", "slices", "table", "unused", "words_of"]

#: A word: a run of anything but ASCII white space. ``bytes.split()`` splits at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def slices(texts, chars: int = 4_000_000) -> Iterator[slice]:
    """Consecutive parts of a batch of texts, of about ``chars`` characters or one text each.

    Spark hands out batches of at most 64 MB (``spark.sql.execution.arrow.maxBytesPerBatch``); what is made of a text takes
    a multiple of its size, so functions work through a batch part by part. No setting of the session is touched.
    """
    begin, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) + 100 if t else 100
        if held and held + n > chars:
            yield slice(begin, i)
            begin, held = i, 0
        held += n
    if held:
        yield slice(begin, len(texts))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8, A-Z lower-cased (null: none)."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n`` (null id: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


_named: dict[int, int] = {}


def next_name() -> int:
    """Inside a task: a number that no other row of the stage has; a task that runs again gives the same ones."""
    context = TaskContext.get()
    task = context.taskAttemptId()
    if task not in _named:
        _named.clear()
    _named[task] = _named.get(task, -1) + 1
    return context.partitionId() << 32 | _named[task]


#: Bits of the filter of ``perhaps``, and bits of each of its rows.
_FILTER, _ROW = 1 << 25, 1 << 15


def perhaps(rows: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """``rows`` with ``flag``: false where their key is surely not among ``keys``.

    What is broadcast is a bit map of fixed size (4 MB); with very many keys it tells less, never anything wrong. A null key
    is a key.
    """
    bit, row, bits = unused([*rows.columns, flag], "bit", "row", "bits")
    place = F.pmod(F.xxhash64(key), F.lit(_FILTER))
    held = keys.select(place.alias(bit)).groupBy(F.floor(F.col(bit) / _ROW).cast("int").alias(row)).agg(F.bitmap_construct_agg(F.col(bit) % _ROW).alias(bits))
    placed = rows.withColumn(bit, place).withColumn(row, F.floor(F.col(bit) / _ROW).cast("int")).join(F.broadcast(held), row, "left")
    byte = F.conv(F.hex(F.expr(f"substring({bits}, cast(({bit} % {_ROW}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    told = F.col(bits).isNotNull() & (byte.bitwiseAND(F.expr(f"shiftleft(1, cast({bit} % 8 as int))")) != 0)
    return placed.withColumn(flag, told).drop(row, bits, bit)
