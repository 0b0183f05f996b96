"""Splitting texts into overlapping, sentence-aware chunks."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import work
from ..config import DEFAULTS, Settings

#: Where a chunk may end, the first kind found wins. Fixed values.
BREAKS = ("\n\n", "\n", ". ", "? ", "! ")


class _Breaks:
    """Places where a text may be cut: for each kind of break, the ends of all its occurrences, looked up by bisection."""

    def __init__(self, text: str):
        self.kinds = [(len(b), list(self._ends(text, b))) for b in BREAKS]

    @staticmethod
    def _ends(text: str, b: str) -> Iterator[int]:
        at = text.find(b)
        while at >= 0:
            yield at + len(b)
            at = text.find(b, at + 1)  # occurrences may overlap

    def last_end(self, low: int, high: int) -> int | None:
        """End of the last break that lies within low and high, of the first kind that has one there."""
        for width, ends in self.kinds:
            found = bisect_right(ends, high)
            if found and ends[found - 1] >= low + width:
                return ends[found - 1]
        return None


def spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of the windows over a text; each but the last ends after the last break of its second half, if any."""
    breaks = _Breaks(text) if len(text) > size else None
    window = (0, len(text)) if breaks is None else (0, breaks.last_end(size // 2, size) or size)
    yield window
    while window[1] < len(text):
        low = window[1] - overlap
        high = low + size
        window = (low, len(text)) if high >= len(text) else (low, breaks.last_end(low + size // 2, high) or high)
        yield window


def chunk_text(text: str | None, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap) -> list[str]:
    """Chunks of at most ``size`` characters that share ``overlap`` of them; chunks of white space are left out."""
    windows = spans(text, size, overlap) if text and not text.isspace() else ()
    return [chunk for low, high in windows if (chunk := text[low:high].strip())]


def with_chunks(docs: DataFrame, text: str = "text", settings: Settings = DEFAULTS) -> DataFrame:
    """``docs`` with an array column ``chunks``; a null or blank text has none."""
    size, overlap = settings.chunk_size, settings.chunk_overlap

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in work.parts(batch.column(text)):  # a part leaves before the next one is made
                made = pa.array([chunk_text(t, size, overlap) for t in part.to_pylist()], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(part)) for c in batch.columns), made], names=[*batch.schema.names, "chunks"])
                at += len(part)

    kinds = T.StructType([*(f for f in docs.schema.fields if f.name != "chunks"), T.StructField("chunks", T.ArrayType(T.StringType()))])
    return docs.select(*[F.col(f"`{f.name}`") for f in kinds.fields[:-1]]).mapInArrow(split, kinds)


def chunked(docs: DataFrame, *keys: str, text: str = "text", settings: Settings = DEFAULTS) -> DataFrame:
    """One row per chunk: ``keys``, chunk_index, content. Texts are dealt out first: one file may hold them all."""
    spread = docs.select(*keys, text).repartition(spread_over(docs))
    return with_chunks(spread, text, settings).select(*keys, F.posexplode("chunks").alias("chunk_index", "content"))


def spread_over(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
