"""Work tables in the folder that all executors share, names for helper columns, and Arrow batches part by part."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; on a local master without it, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark, "_strataforge_dir", None)
    if own is None:
        own = spark._strataforge_dir = tempfile.mkdtemp(prefix="strataforge-")
    return own


def materialise(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(columns, *names: str) -> list[str]:
    """Names for helper columns that no column bears, whatever its case."""
    held, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


#: Bytes of a part of a batch, about; a value may be larger.
PART = 1 << 20


def parts(values: pa.Array, size: int = PART) -> Iterator[pa.Array]:
    """Consecutive parts of a batch of texts, or of lists of words, of about ``size`` bytes, or one value each."""
    kind = values.type
    held, each = (pc.list_value_length(values), 10) if pa.types.is_list(kind) or pa.types.is_large_list(kind) else (pc.binary_length(values), 1)
    total = np.cumsum(pc.fill_null(held, 0).to_numpy(zero_copy_only=False).astype(np.int64) * each + 100)
    begin = 0
    while begin < len(total):
        end = max(int(np.searchsorted(total, (total[begin - 1] if begin else 0) + size, side="right")), begin + 1)
        yield values.slice(begin, end - begin)
        begin = end


def mapped(batches: Iterator[pa.Array], f: Callable, kind: pa.DataType) -> Iterator[pa.Array]:
    """``f`` of each value of Arrow batches. Batches have up to 64 MB: Python has the values of a part at a time, the rest stays in Arrow."""
    for batch in batches:
        done = [pa.array([f(v) for v in part.to_pylist()], kind) for part in parts(batch)]
        yield pa.concat_arrays(done) if done else pa.array([], kind)
