"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a budget of words. Whole passes over the source fill most of it; what remains is filled by a subset of
its documents, chosen by exact length: documents are counted by length, a proportional share of every length is taken, a
bounded-knapsack dynamic programme over (length, count) fills the rest to the word, and seeded hashes say which documents
of a length are the chosen ones.

Nothing is gathered by source except one row per source and distinct length. Documents of a length are ranked inside hash
buckets, so a source or a length that holds a third of all rows is spread over as many tasks as there are buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Words that the dynamic programme fills exactly, at most; the proportional share leaves less than this.
CAPACITY = 1 << 16
#: Hash buckets in which the documents of one source and length are ranked.
BUCKETS = 1024
#: Sources are settings of a mix, not data: more than this many is an error.
MAX_SOURCES = 1_000_000
#: Copies of one row that one task makes, at most.
COPIES = 1000
#: Rows that one task makes, about.
TASK_ROWS = 200_000


def water_fill(sizes: Sequence[int], weights: Sequence[float], budget: float, ceiling: float) -> list[float]:
    """Share ``budget`` by weight; a target stops at ``ceiling`` times its size, its excess going to the others by weight."""
    limits = [ceiling * x for x in sizes]
    targets: list[float | None] = [None] * len(sizes)
    while True:
        free = [i for i, t in enumerate(targets) if t is None]
        left, total = budget - sum(t for t in targets if t is not None), sum(weights[i] for i in free)
        above = [i for i in free if left * weights[i] / total > limits[i]] if total > 0 else []
        if not above:
            for i in free:
                targets[i] = left * weights[i] / total if total > 0 else 0.0
            return [float(t) for t in targets]
        for i in above:
            targets[i] = limits[i]


def bounded_knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many items of each length to take so that their sum is the largest one not above ``budget``.

    A bit set of reachable sums per length; counts are split into powers of two, so a length with many items costs
    logarithmically many shifts. Walking the sets back gives the counts.
    """
    taken = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return taken
    full, sets, steps = (1 << (budget + 1)) - 1, 1, []
    for i, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        if not 0 < length <= budget:
            continue
        left, part = min(count, budget // length), 1
        while left > 0:
            k = min(part, left)
            steps.append((i, k, sets))
            sets |= (sets << (k * length)) & full
            left, part = left - k, part * 2
        if sets >> budget & 1:
            break
    at = sets.bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += k
            at -= k * int(lengths[i])
    return taken


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Documents to take of each length, so that their words come as near to ``budget`` from below as the programme finds."""
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    take = np.floor(counts * (budget / total)).astype(np.int64)
    left = budget - int((lengths * take).sum())
    # the fractions that rounding dropped, longest first, until the programme can fill the rest
    for i in np.argsort(-lengths, kind="stable"):
        if left <= CAPACITY or lengths[i] == 0:
            break
        k = min(int(counts[i] - take[i]), (left - CAPACITY // 2) // int(lengths[i]), 1)
        if k > 0:
            take[i] += k
            left -= k * int(lengths[i])
    while left > CAPACITY:  # few long lengths with many documents each
        i = int(np.argmax(np.where((take < counts) & (lengths > 0) & (lengths <= left), lengths, 0)))
        k = min(int(counts[i] - take[i]), left // max(int(lengths[i]), 1))
        if k <= 0 or lengths[i] == 0:
            break
        take[i] += k
        left -= k * int(lengths[i])
    order = np.argsort(lengths, kind="stable")
    take[order] += bounded_knapsack(lengths[order], (counts - take)[order], min(left, CAPACITY))
    return take


def choose(docs: DataFrame, key, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, ceiling: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """key, doc_id, size, source_size, target, n, passes, extra: what a mix takes of the ``n`` rows that share a ``key``.

    key: a column of longs; rows that share it must share id, source and size. Each of them is taken ``passes`` times, and
    ``extra`` of them once more.
    """
    spark = docs.sparkSession
    rows = docs.select(
        key.alias("key"),
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(common.WORD)).cast("long"), F.lit(0).cast("long")).alias("size"),
    )
    # rows that are equal are one row with a count, so that no bucket below holds very many of them
    slim = rows.groupBy("key", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64(F.lit(seed), "key", F.col("doc_id").cast("string"), "size"))
    slim = common.materialise(slim, "mix-sizes")
    by_length = slim.groupBy("source", "size").agg(F.sum("n").alias("n"))
    rows = by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r.words) for r in rows]
    given = [float(weights[i % len(weights)]) for i in range(len(rows))]
    targets = water_fill(sizes, given, share * sum(sizes), ceiling) if rows else []
    plan = spark.createDataFrame(
        [(r.source, s, t, min(int(t // s), ceiling) if s else 0, max(0, round(t - min(int(t // s), ceiling) * s)) if s else 0) for r, s, t in zip(rows, sizes, targets, strict=True)],
        "source string, source_size long, target double, passes long, rest long",
    )
    plan = F.broadcast(plan) if len(rows) <= 10_000 else plan

    @F.pandas_udf("array<struct<size:long,k:long>>")
    def chosen(lengths: pd.Series, rest: pd.Series) -> pd.Series:
        out = []
        for pairs, budget in zip(lengths, rest, strict=True):
            a = np.array(sorted((p["size"], p["n"]) for p in pairs), np.int64).reshape(-1, 2)
            take = fit(a[:, 0], a[:, 1], int(budget))
            out.append([{"size": int(s), "k": int(k)} for s, k in zip(a[:, 0], take, strict=True) if k])
        return pd.Series(out)

    # one row per source; its array holds one entry per distinct length
    lengths = by_length.groupBy("source").agg(F.collect_list(F.struct("size", "n")).alias("lengths"))
    quota = (
        lengths.join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        .select("source", F.inline(chosen("lengths", "rest")))
    )
    # the k smallest hashes of a length: whole buckets, then the places inside the bucket where k is reached
    cell = ["source", "size", "b"]
    ranked = slim.withColumn("b", F.shiftrightunsigned("h", 54).cast("int"))
    counts = ranked.groupBy(*cell).agg(F.sum("n").alias("c"))
    cells = counts.withColumn("before", F.sum("c").over(Window.partitionBy("source", "size").orderBy("b")) - F.col("c"))
    q = quota.select(F.col("source").alias("s"), F.col("size").alias("z"), "k")
    cells = cells.join(q, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).where("before < k").select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("b").alias("c"), "k", "before")
    inside = Window.partitionBy(*cell).orderBy("h", "doc_id", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranked.withColumn("r", F.sum("n").over(inside) - F.col("n"))
    hit = ranked.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("b") == F.col("c")), "left")
    extra = F.when(F.col("k").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.col("n"), F.col("k") - F.col("before") - F.col("r")))).cast("long")
    out = hit.select("key", "doc_id", F.col("source").alias("of"), "size", "n", extra.alias("extra"))
    return out.join(plan, F.col("of").eqNullSafe(F.col("source"))).select("key", "doc_id", "size", "source_size", "target", "n", "passes", "extra")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, ceiling: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken: what a mix of ``share`` of all words takes of every document.

    Sources by code point, null last, have ``weights`` in turn. ``taken`` is the document's words times the passes over
    it. Defined cases: a null or empty text has size 0 and is taken with 0 words; null sources form one source; a null id
    is an id; repeated rows are documents of their own; an empty table gives an empty result; other columns are ignored.
    """
    key = F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col))
    groups = choose(docs, key, weights, share, ceiling, seed, id_col, text_col, source_col)
    each = groups.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    times = F.col("passes") + F.when(F.col("i") <= F.col("extra"), 1).otherwise(0)
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"))


def repeat_rows(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; rows that are equal in all columns stand in for one another.

    Defined cases: as for ``mix_sources``; a document without words stays out; columns are kept, whatever their names.
    """
    key, other, row, times, slot = common.unused(docs.columns, "key", "other", "row", "times", "slot")
    # equal rows become one with a number before any text moves
    firsts = docs.select(F.xxhash64(*docs.columns).alias(key), F.struct(*docs.columns).alias(row)).groupBy(key).agg(F.first(row).alias(row))
    total = F.col("n") * F.col("passes") + F.least("n", "extra")
    groups = choose(docs, F.xxhash64(*docs.columns), **settings).where("size > 0").select(F.col("key").alias(other), total.alias(times)).where(F.col(times) > 0)
    groups = common.materialise(groups, "times")
    met = firsts.join(groups, F.col(key) == F.col(other)).select(row, times)
    most, every = groups.agg(F.max(times), F.sum(times)).first()
    if (most or 0) > COPIES:
        # copies of one row are made by many tasks, whose number goes by the rows that they make
        tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-every // TASK_ROWS))
        met = met.withColumn(slot, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / COPIES)))).repartition(tasks, slot, times)
        met = met.withColumn(times, F.least(F.lit(COPIES), F.col(times) - F.col(slot) * COPIES))
    return met.select(row, F.explode(F.array_repeat(F.lit(0), F.col(times).cast("int")))).select(f"{row}.*")


def op1_mixing(spark, sf_dir):
    return mix_sources(common.table(spark, sf_dir, "documents"))
