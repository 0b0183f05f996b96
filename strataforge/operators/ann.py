"""Approximate nearest vectors: an inverted file over a trained coarse quantiser.

Centroids are fitted on a bounded sample (``SAMPLE`` rows by hash of their key); every row is put in the list of its
nearest centroid. Lists are folders of the written index, so a search reads the lists that it probes. The number of probes
starts at ``FIRST`` and is doubled until an audit passes: for ``AUDITED`` of the queries all rows are searched too, and the
share of their exact neighbours that the probes find is the recall. With as many probes as lists the search is exact.

Lists are cut into pieces by a hash of the key and queries of a list into blocks, so no list, however crowded, and no
query set, however large, is one task's; tasks multiply a piece with a block and pass on each query's k best of the piece.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import work
from . import search

#: Rows on which centroids are fitted, rounds of fitting, most lists.
SAMPLE, ROUNDS, LISTS = 65_536, 12, 4096
#: Rows of a piece of a list, queries of a block.
PIECE, BLOCK = 20_000, 2048
#: Probes of the first search, queries of an audit, share of exact neighbours that must be found.
FIRST, AUDITED, RECALL = 2, 128, 0.9


@dataclass(frozen=True)
class Index:
    """centroids: unit vectors, a row a list; pieces: how many pieces each list has; path: rows (key, vector, list, piece)."""

    spark: SparkSession
    path: str
    schema: T.StructType
    centroids: np.ndarray
    pieces: tuple[int, ...]
    rows: int

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def _unit(x: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        return np.where(norm > 0, x / norm, 0)


def centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; a centroid that loses all its rows takes the row that fits worst."""
    sample = _unit(sample)
    lists = min(lists, len(sample))
    held = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        best = np.concatenate([np.stack([(c := part @ held.T).argmax(1), c.max(1)], 1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
        own, near = best[:, 0].astype(int), best[:, 1]
        sums = np.zeros_like(held)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        sums[empty] = sample[np.argsort(near, kind="stable")[: len(empty)]]
        held = _unit(sums)
    return held


def _nearest(held: np.ndarray, probes: int):
    """Vectors -> numbers of their nearest centroids, best first."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def lists(batch: pd.Series) -> pd.Series:
        out = []
        for begin in range(0, len(batch), 4096):
            c = _unit(np.stack([np.asarray(v, np.float64) for v in batch.iloc[begin : begin + 4096]])) @ held.T
            out += np.argsort(-c, axis=1, kind="stable")[:, :probes].astype(np.int32).tolist()
        return pd.Series(out)

    return lists


def _usable(rows: DataFrame, key: str, vector: str, size: int | None = None) -> DataFrame:
    """(key, vector as doubles) of the rows whose vector is not null, has no null or non-finite part and is not zero."""
    named = rows.select(F.col(key).alias("key"), search.doubles(F.col(vector)).alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    named = named.where(F.col("vector").isNotNull()).where(fine)
    return named if size is None else named.where(F.size("vector") == size)


def build(rows: DataFrame, key: str, vector: str = "embedding", lists: int | None = None) -> Index:
    """The index of every usable row. All vectors must have one size; a null, zero or non-finite vector takes no part.

    lists: by default the power of two near the square root of the number of rows, ``LISTS`` at most.
    """
    spark = rows.sparkSession
    usable = _usable(rows, key, vector)
    sizes = usable.select(F.size("vector").alias("n")).agg(F.min("n"), F.max("n"), F.count("*")).first()
    if sizes[2] and sizes[0] != sizes[1]:
        raise ValueError("vectors of several sizes need an index each")
    lists = lists or min(LISTS, 1 << max(0, round(np.log2(max(1, sizes[2])) / 2)))
    sample = usable.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vector").collect()
    held = centroids(np.array([r[0] for r in sample], np.float64), lists) if sample else np.zeros((1, 1))
    path = f"{work.shared_dir(spark)}/lists-{uuid.uuid4().hex}"
    placed = work.materialise(usable.withColumn("list", _nearest(held, 1)("vector")[0]), "placed")
    counts = {r[0]: r[1] for r in placed.groupBy("list").count().collect()}  # a row a list
    pieces = tuple(-(-counts.get(i, 0) // PIECE) for i in range(len(held)))
    piece = F.pmod(F.xxhash64("key"), F.element_at(F.array(*[F.lit(max(p, 1)) for p in pieces]), F.col("list") + 1)).cast("int")
    dealt = placed.withColumn("piece", piece).repartition(max(1, min(sum(pieces), 100_000)), "list", "piece")
    dealt.write.partitionBy("list", "piece").parquet(path)
    schema = T.StructType([T.StructField("key", rows.schema[key].dataType), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("list", T.IntegerType()), T.StructField("piece", T.IntegerType())])
    return Index(spark, path, schema, held, pieces, sizes[2])


def _best(k: int):
    """A piece of a list and a block of queries -> each query's rows that may be among its k nearest of the piece."""

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({c: pd.Series(dtype=object) for c in ("query", "key", "vector", "asked")})
        near = _unit(np.stack(rows["vector"].map(np.asarray).to_list()))
        out = []
        for begin in range(0, len(queries), 256):
            part = queries.iloc[begin : begin + 256]
            c = _unit(np.stack(part["asked"].map(np.asarray).to_list())) @ near.T
            least = np.partition(c, max(c.shape[1] - k, 0), 1)[:, max(c.shape[1] - k, 0)] - search.SLACK
            q, r = np.nonzero(c >= least[:, None])
            out.append(pd.DataFrame({"query": part["query"].to_numpy()[q], "key": rows["key"].to_numpy()[r], "vector": rows["vector"].to_numpy()[r], "asked": part["asked"].to_numpy()[q]}))
        return pd.concat(out)

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    measured = found.withColumn("distance", 1 - search.cosine(F.col("vector"), F.col("asked"))).drop("vector", "asked")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "key"))
    return measured.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "key", "distance")


def _crossed(index: Index, pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of each query in its lists. pairs: (query, asked, list), the lists that a query probes."""
    pieces = F.element_at(F.array(*[F.lit(p) for p in index.pieces]), F.col("list") + 1)
    spread = pairs.withColumn("pieces", pieces).where("pieces > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    # as many blocks of queries as a list is asked by
    asked = pairs.groupBy("list").count().select("list", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    spread = spread.join(asked, "list").withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int"))
    rows = index.vectors().join(asked, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    schema = T.StructType([T.StructField("query", pairs.schema["query"].dataType), T.StructField("key", index.schema["key"].dataType), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("vector", "asked")]])
    keys = ("list", "piece", "block")
    found = rows.select(*keys, "key", "vector").groupBy(*keys).cogroup(spread.select(*keys, "query", "asked").groupBy(*keys))
    return _ranked(found.applyInPandas(lambda key, a, b: _best(k)(a, b), schema), k)


def _probed(index: Index, queries: DataFrame, probes: int) -> DataFrame:
    return queries.withColumn("list", F.explode(_nearest(index.centroids, probes)("asked"))).select("query", "asked", "list")


def _questions(queries: DataFrame, query_id: str, query: str, size: int) -> DataFrame:
    return _usable(queries, query_id, query, size).select(F.col("key").alias("query"), F.col("vector").alias("asked"))


def exact(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """The exact k nearest rows of ``queries`` (query, asked): all lists are probed."""
    every = F.explode(F.sequence(F.lit(0), F.lit(len(index.centroids) - 1)))
    return _crossed(index, queries.withColumn("list", every), k).select("query", "key")


def recall(index: Index, queries: DataFrame, wanted: DataFrame, k: int, probes: int) -> float:
    """Of ``wanted``, the exact neighbours of ``queries``, the share that so many probes find."""
    near = _crossed(index, _probed(index, queries, probes), k)
    return near.join(wanted, ["query", "key"], "left_semi").count() / max(1, wanted.count())


def nearest(index: Index, queries: DataFrame, k: int, query_id: str = "query_id", query: str = "query", least: float = RECALL) -> DataFrame:
    """(query_id, rank, key, score, probes, recall): the k nearest rows of each query that the probed lists hold.

    recall is that of the audit which let the probes pass: over ``AUDITED`` of the queries, by hash. Queries that are null,
    zero, not finite or of another size give no rows; ties go to the smaller key; with few rows or probes of all lists, all
    is exact and the recall 1.
    """
    spark, lists = index.spark, len(index.centroids)
    asked = work.materialise(_questions(queries, query_id, query, index.centroids.shape[1]), "asked")
    some = work.materialise(asked.orderBy(F.xxhash64("query"), "query").limit(AUDITED), "audited")
    probes, share = min(FIRST, lists), 1.0
    wanted = work.materialise(exact(index, some, k), "exact") if probes < lists and index.rows else some
    while probes < lists and index.rows:
        share = recall(index, some, wanted, k, probes)
        if share >= least:
            break
        probes, share = min(2 * probes, lists), 1.0
    found = _crossed(index, _probed(index, asked, probes), k)
    score = F.round(1 - F.col("distance"), 4).alias("score")
    return found.select(F.col("query").alias(query_id), "rank", "key", score, F.lit(probes).alias("probes"), F.lit(float(share)).alias("recall"))

