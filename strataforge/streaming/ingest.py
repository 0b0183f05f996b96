"""Files that arrive in a folder, ingested as they come."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..service import Engine


def watch(engine: Engine, key: str, path: str, checkpoint: str, output: str = "markdown", available_now: bool = False) -> StreamingQuery:
    """Ingest new files of ``path`` for the key's tenant; unsupported and too large ones are skipped.

    A batch is named by its checkpoint and number: a batch that runs again is not ingested again.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    source = engine.spark.readStream.schema(schema).format("binaryFile").load(path)
    rows = source.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"), "content")
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: engine.upload_batch(key, batch, output, f"{checkpoint}#{number}").count())
    return (writer.trigger(availableNow=True) if available_now else writer).start()
