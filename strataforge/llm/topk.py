"""Exact top-k search by block-at-a-time pruning.

Vectors are terms with integer weights. They lie in document-range blocks (runs of vectors in an order that keeps like
vectors together); each block has the largest and the smallest weight of every term and a forward index, its rows. For a
query, the sum over terms of the larger of weight times maximum and weight times minimum bounds every score in the block.
Blocks are scored in the order of their bounds until a bound falls below the k-th score found so far; ties are scored.

Blocks are held in shelves, shelves that follow one another in pages. A query first searches the shelf it lies in, which
gives a k-th score to begin with; the bounds of the pages then say into which pages it must look, and there the bounds of
the shelves say which of them it must visit. Queries travel in groups, so a task holds one shelf and one group, whatever
the numbers of vectors and queries are.
"""

from __future__ import annotations

import math
import pickle
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import numbering
from . import common

SHELF, BLOCK, GROUP, PAGE = 4096, 64, 512, 256
#: Bytes of the upper bounds that may be broadcast.
UPPER = 64 << 20
#: Below the largest double; digits that hold every score of finite doubles, with room for sums.
_HUGE, _DIGITS = 1 << 1023, 660


def _pack(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays))


def _unpack(data: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def integers(v: np.ndarray, scale: int = 1) -> np.ndarray:
    """Whole doubles (times ``scale``) as integers: 64-bit ones while doubles hold them exactly, else Python's."""
    if scale == 1 and np.abs(v).max(initial=0) < 2.0**53:
        return v.astype(np.int64)
    return np.array([math.floor(Fraction(x) * scale) for x in v.tolist()], dtype=object)


def _floats(a: np.ndarray) -> np.ndarray:
    if a.dtype != object:
        return a.astype(np.float64)
    near = lambda x: float(x) if abs(x) < _HUGE else math.inf if x > 0 else -math.inf
    return np.array([near(x) for x in a.ravel().tolist()], np.float64).reshape(a.shape)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows; exact: doubles while they hold them, else Python's integers."""
    most = np.abs(_floats(a)).max(initial=0) * np.abs(_floats(b)).max(initial=0) * max(a.shape[-1], 1)
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(object) @ b.astype(object).T


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """(queries, blocks): sums of term maxima, as doubles that are not below the true bound (rounding included)."""
    q, high, low = _floats(queries), _floats(high), _floats(low)
    with np.errstate(invalid="ignore", over="ignore"):
        out = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        out += np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T * (2.0**-52 * (q.shape[1] + 4))
    return np.where(np.isnan(out), np.inf, out)


def below(score: int | None) -> float:
    """A double that is not above an integer score; without one, below all."""
    if score is None or score <= -_HUGE:
        return -math.inf
    return math.nextafter(float(min(score, _HUGE - 1)), -math.inf)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    return np.lexsort((ids, -scores))[:k]


def search(query_ids, queries, floors, ids, rows, k: int):
    """Block at a time over one shelf -> (ids, scores) of at most k per query. floors: scores to reach, or None."""
    starts = np.arange(0, len(ids), BLOCK)
    upper = bounds(queries, np.maximum.reduceat(rows, starts), np.minimum.reduceat(rows, starts))
    exact = np.abs(_floats(queries)).max(initial=0) * np.abs(_floats(rows)).max(initial=0) * rows.shape[1] < 2.0**53
    forward = rows.astype(np.float64) if exact else rows
    out = []
    for q, (qid, query, kth) in enumerate(zip(query_ids.tolist(), queries, floors, strict=True)):
        order = np.argsort(-upper[q], kind="stable")
        query = query.astype(np.float64) if exact else query
        got_ids, got = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(order), 8):
            now = order[at : at + 8]
            now = now[upper[q][now] >= below(kth)]
            if not len(now):
                break
            where = (now[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            where = where[where < len(ids)]
            where = where[ids[where] != qid]
            scores = (forward[where] @ query).astype(np.int64) if exact else products(forward[where], query[None])[:, 0]
            keep = (scores >= kth).astype(bool) if kth is not None else np.ones(len(scores), bool)
            got_ids, got = np.concatenate([got_ids, ids[where][keep]]), np.concatenate([got, scores[keep]])
            top = best(got_ids, got, k)
            got_ids, got = got_ids[top], got[top]
            if len(got) == k:
                kth = int(got[-1]) if kth is None else max(kth, int(got[-1]))
        out.append((got_ids, got))
    return out


def _shelves(batches):
    """Sorted rows (vec_id, v, scale) -> shelves (shelf, dim, n, data, high, low) of vectors of one length.

    data: ids, rows, and which rows are the first of their equals; equal rows follow one another, over shelves too.
    """
    held: dict[int, tuple[list, list, list]] = {}
    last: dict[int, tuple] = {}

    def close(dim):
        ids, rows, first = held.pop(dim)
        rows = np.stack(rows)
        data = _pack(np.array(ids, np.int64), rows, np.array(first, bool))
        return {"shelf": common.next_name(), "dim": dim, "n": len(ids), "data": data, "extremes": _pack(rows.max(0), rows.min(0))}

    for b in batches:
        out = []
        for vec_id, v, scale in zip(b["vec_id"], b["v"], b["scale"], strict=True):
            v = integers(np.asarray(v, np.float64), scale)
            ids, rows, first = held.setdefault(len(v), ([], [], []))
            before = last.get(len(v))
            first.append(before is None or before[0] != vec_id or not np.array_equal(before[1], v))
            last[len(v)] = (vec_id, v)
            ids.append(vec_id)
            rows.append(v)
            if len(ids) >= SHELF:
                out.append(close(len(v)))
        if out:
            yield pd.DataFrame(out)
    if held:
        yield pd.DataFrame([close(d) for d in list(held)])


def _groups(every: int, k: int):
    """Each shelf's own queries, with the k-th score that their own shelf gives."""

    def make(batches):
        for b in batches:
            out = []
            for dim, data in zip(b["dim"], b["data"], strict=True):
                ids, rows, first = _unpack(data)
                own = np.flatnonzero((ids % every == 0) & first)
                if not len(own):
                    continue
                found = search(ids[own], rows[own], [None] * len(own), ids, rows, k)
                floors = [int(s[-1]) if len(s) == k else None for _, s in found]
                for at in range(0, len(own), GROUP):
                    part = own[at : at + GROUP]
                    data = _pack(ids[part], rows[part], floors[at : at + GROUP])
                    out.append({"dim": dim, "queries": data})
            if out:
                yield pd.DataFrame(out)

    return make


def _route(batches):
    """(queries, page of named bounds) -> one row per name with the queries that it may serve."""
    for b in batches:
        for queries, page in zip(b["queries"], b["page"], strict=True):
            ids, rows, floors = _unpack(queries)
            out = []
            high, low = zip(*(_unpack(x["extremes"]) for x in page), strict=True)
            upper, least = bounds(rows, np.stack(high), np.stack(low)), np.array([below(f) for f in floors])
            for i, x in enumerate(page):
                go = np.flatnonzero(upper[:, i] >= least)
                if len(go):
                    out.append((x["name"], _pack(ids[go], rows[go], [floors[g] for g in go])))
            yield pd.DataFrame(out, columns=["name", "queries"])


def _bounded(batches):
    """Pages -> the bounds of all that they hold."""
    for b in batches:
        both = [[_unpack(x["extremes"]) for x in page] for page in b["page"]]
        yield pd.DataFrame({"dim": b["dim"], "page": b["id"], "extremes": [_pack(np.max([h for h, _ in e], 0), np.min([w for _, w in e], 0)) for e in both]})


def _beyond(score: int) -> str:
    """Empty for a score that fits a long; else digits whose order is that of the scores beyond the same end."""
    if -(1 << 63) <= score < 1 << 63:
        return ""
    return f"{score if score > 0 else score + 10**_DIGITS:0{_DIGITS}d}"


def _visit(k: int):
    def make(batches):
        for b in batches:
            for queries, data in zip(b["queries"], b["data"], strict=True):
                qids, qrows, floors = _unpack(queries)
                ids, rows, _ = _unpack(data)
                found = search(qids, qrows, floors, ids, rows, k)
                sizes = [len(i) for i, _ in found]
                name = lambda r: xxhash.xxh64_intdigest(str(r.tolist()) if r.dtype == object else r.tobytes()) >> 1
                scores = [int(x) for _, s in found for x in s]
                yield pd.DataFrame({
                    "query_id": np.repeat(qids, sizes), "key": np.repeat([name(r) for r in qrows], sizes), "vec_id": np.concatenate([i for i, _ in found]),
                    "score": np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in scores], np.int64), "beyond": pd.Series([_beyond(x) for x in scores], dtype=object),
                })

    return make


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of every query, ties to the smaller vec_id.

    Components become floor(scale * x) of x as double. Queries: ids divisible by query_every. Defined cases: rows whose
    id is null, or whose vector is null or empty or holds null or non-finite components, take no part; rows that bear the
    query's id are its own and no candidates; other repeated rows are candidates each; a query listed twice with the same
    vector is one query; vectors of different lengths don't meet; rows are ranked by the exact score, however large, and
    a score that does not fit a long is given as the long nearest to it; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    # doubles of 2 ** 52 or more are whole; a product beyond all doubles is left to Python
    fits = F.forall(x, lambda y: F.abs(y * scale) < float("inf"))
    whole = F.transform(x, lambda y: F.when(F.abs(y * scale) < 2.0**52, F.floor(y * scale).cast("double")).otherwise(y * scale))
    rows = vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.when(fits, whole).otherwise(x).alias("v"), F.when(fits, 1).otherwise(scale).alias("scale"))
    # like vectors together: by the term of the largest weight, then by that weight
    top = F.array_max(F.transform("v", F.abs))
    rows = rows.withColumn("term", F.array_position(F.transform("v", F.abs), top)).withColumn("peak", F.get(F.col("v"), (F.col("term") - 1).cast("int")))
    ordered = rows.repartitionByRange("term", "peak", "vec_id").sortWithinPartitions("term", "peak", "vec_id", "v").select("vec_id", "v", "scale")
    shelves = common.materialise(ordered.mapInPandas(_shelves, "shelf long, dim int, n long, data binary, extremes binary"), "shelves")
    groups = common.materialise(shelves.select("dim", "data").mapInPandas(_groups(query_every, k), "dim int, queries binary"), "query-groups")
    # shelves that follow one another hold like vectors: PAGE of them make a page, PAGE pages a list of pages, each with its bounds
    numbers = numbering.numbered(shelves.select("dim", "shelf"), ["dim"], ["shelf"], "at").select("shelf", F.expr(f"(at - 1) div {PAGE}").alias("p"))
    paged = shelves.select("dim", "shelf", "extremes").join(numbers, "shelf").groupBy("dim", "p").agg(F.collect_list(F.struct(F.col("shelf").alias("name"), "extremes")).alias("page"))
    paged = common.materialise(paged.withColumn("id", F.xxhash64("dim", "p")), "pages")
    upper = paged.select("dim", "id", "page").mapInPandas(_bounded, "dim int, page long, extremes binary")
    lists = common.materialise(upper.groupBy("dim", F.pmod("page", F.lit(max(1, -(-paged.count() // PAGE)))).alias("l")).agg(F.collect_list(F.struct(F.col("page").alias("name"), "extremes")).alias("page")), "lists")
    size = lists.agg(F.sum(F.aggregate("page", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["extremes"])))).first()[0] or 0
    asked = groups.join(F.broadcast(lists) if size < UPPER else lists, "dim")
    onward = asked.select("queries", "page").mapInPandas(_route, "name long, queries binary").withColumnRenamed("name", "id")
    routed = onward.join(paged.select("id", "page"), "id").select("queries", "page").mapInPandas(_route, "name long, queries binary").withColumnRenamed("name", "shelf")
    met = routed.join(shelves.select("shelf", "data"), "shelf").select("queries", "data")
    found = met.mapInPandas(_visit(k), "query_id long, key long, vec_id long, score long, beyond string")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark, sf_dir):
    return top_k(common.table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
