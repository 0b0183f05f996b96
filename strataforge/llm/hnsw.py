"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Vectors of one label are dealt out to shards by hash. Each shard builds a graph of layers; a layer links every vector to
near and diverse neighbours. Each pair of shards of a label is searched once, the graph of the smaller number with the
vectors of the other, and each shard with its own vectors; recall is audited in each search. Greedy descent goes through
the upper layers, then a beam in the lowest. A vector whose beam is full of partners may have more: its own beam is doubled
until it is not. In each search probes, turned from vectors of the shard to the least cosine, and a seeded sample of the
queries are compared with brute force, all their partners counted; while the recall of either is short, all beams are
doubled. A beam as wide as the shard is a comparison with all of it. Found pairs are verified by cosine in double
precision, counted where they are found, and united to components.

A task keeps the graph of one shard and takes the other shards' vectors one after another, so a graph is moved and read
once; shards of a label ask each other in a ring, each about half of the others.

Searches run in lockstep: all queries of a shard advance together on numpy arrays. Equal vectors are one vector with a
multiplicity. A search returns a spanning forest and a count a vector, so a group of near copies costs rows in proportion
to its size, though its pairs are all looked at.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .simhash import forest

#: Vectors of a shard, links of a vector (twice that in the lowest layer), beams, audited vectors and least recall.
SHARD, LINKS, BUILD_BEAM, BEAM, AUDIT, RECALL = 4096, 12, 32, 32, 96, 0.98
_SPARE = 1e-5


def _beam_search(vectors, links, queries, entries, width):
    """Lockstep beam search in one layer -> (ids, similarities), (queries, width), padded with -1."""
    n, count = len(vectors), len(queries)
    width = min(width, n)
    ids = np.full((count, width), -1, np.int64)
    sims = np.full((count, width), -np.inf, np.float32)
    opened = np.zeros((count, width), bool)
    seen = np.zeros((count, n), bool)
    rows = np.arange(count)[:, None]
    start = np.where(entries >= 0, entries, entries[:, :1])[:, :width]
    start = np.sort(start, axis=1)
    start = np.where(np.concatenate([np.zeros((count, 1), bool), start[:, 1:] == start[:, :-1]], 1), -1, start)
    k = start.shape[1]
    ids[:, :k] = start
    sims[:, :k] = np.where(start >= 0, np.einsum("qkd,qd->qk", vectors[start], queries), -np.inf)
    np.put_along_axis(seen, np.maximum(start, 0), True, 1)
    live = np.arange(count)
    while len(live):
        todo = np.where(opened[live] | (ids[live] < 0), -np.inf, sims[live])
        wide = min(4, width)
        best = np.argpartition(-todo, wide - 1, axis=1)[:, :wide] if wide < width else np.broadcast_to(np.arange(width), (len(live), width))
        ok = np.isfinite(np.take_along_axis(todo, best, 1))
        on = ok.any(1)
        live, best, ok = live[on], best[on], ok[on]
        if not len(live):
            break
        mine = live[:, None]
        opened[mine, best] |= ok
        near = np.where(ok[:, :, None], links[np.maximum(ids[mine, best], 0)], -1).reshape(len(live), -1)
        near = np.sort(near, axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~seen[mine, np.maximum(near, 0)]
        r, c = np.nonzero(fresh)
        seen[live[r], near[r, c]] = True
        got = np.full(near.shape, -np.inf, np.float32)
        got[r, c] = np.einsum("kd,kd->k", vectors[near[r, c]], queries[live[r]])
        all_sims = np.concatenate([sims[live], got], 1)
        all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], 1)
        all_open = np.concatenate([opened[live], np.zeros(near.shape, bool)], 1)
        keep = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[live], sims[live], opened[live] = (np.take_along_axis(x, keep, 1) for x in (all_ids, all_sims, all_open))
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), rows


def _diverse(vectors, cand, sims, count):
    """Of each row's candidates, ``count`` that are nearer to the row's vector than to one another; then the nearest rest."""
    order = np.argsort(-sims, axis=1, kind="stable")[:, : 4 * count]
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    valid = np.isfinite(sims) & (cand >= 0)
    v = vectors[np.maximum(cand, 0)]
    mutual = v @ v.transpose(0, 2, 1)
    kept = np.zeros(cand.shape, bool)
    total = np.zeros(len(cand), np.int64)
    for c in range(cand.shape[1]):
        near = np.where(kept, mutual[:, c, :], -np.inf).max(1)
        take = valid[:, c] & (near < sims[:, c]) & (total < count)
        kept[:, c] = take
        total += take
    rank = np.where(valid, np.where(kept, 0, 1), 2)
    order = np.argsort(rank, axis=1, kind="stable")[:, :count]
    out = np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(cand, order, 1), -1)
    return np.pad(out, ((0, 0), (0, count - out.shape[1])), constant_values=-1)


class Graph:
    """Layers over unit vectors (float32 for the walk); ``layers[0]`` holds all of them."""

    def __init__(self, vectors: np.ndarray, seed: int = 5):
        self.vectors = v = vectors.astype(np.float32)
        n = len(v)
        level = np.minimum(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS), 6).astype(int)
        self.layers = []
        for at in range(int(level.max(initial=0)), -1, -1):
            members = np.flatnonzero(level >= at)
            # those of upper layers first: they are where searches enter
            members = members[np.argsort(-level[members], kind="stable")]
            if len(members):
                self.layers.insert(0, self._layer(members, 2 * LINKS if at == 0 else LINKS))

    def _layer(self, members: np.ndarray, width: int) -> np.ndarray:
        v, n, done = self.vectors, len(self.vectors), 0
        links = np.full((n, width), -1, np.int32)
        while done < len(members):
            batch = members[done : done + max(16, min(512, done))]
            among = v[batch] @ v[batch].T
            np.fill_diagonal(among, -np.inf)
            k = min(BUILD_BEAM, len(batch))
            inside = np.argpartition(-among, k - 1, axis=1)[:, :k]
            cand, sims = batch[inside], np.take_along_axis(among, inside, 1)
            if done:
                entries = self.enter(v[batch], members[:1])
                ids, found, _ = _beam_search(v, links, v[batch], np.where(np.isin(entries, members[:done]), entries, members[0]), BUILD_BEAM)
                cand, sims = np.concatenate([cand, ids], 1), np.concatenate([sims, found], 1)
            chosen = _diverse(v, cand, sims, width // 2)
            links[batch, : width // 2] = chosen
            src, dst = np.repeat(batch, width // 2), chosen.ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            self._back(links, dst, src, width)
            done += len(batch)
        return links

    def _back(self, links, node, new, width):
        """Links from ``node`` back to ``new``; a full node keeps its diverse ones."""
        if not len(node):
            return
        sim = np.einsum("kd,kd->k", self.vectors[node], self.vectors[new])
        order = np.lexsort((-sim, node))
        node, new = node[order], new[order]
        start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        place = np.arange(len(node)) - np.repeat(start, np.diff([*start, len(node)]))
        target = node[start]
        more = np.full((len(target), width), -1, np.int64)
        row = np.repeat(np.arange(len(target)), np.diff([*start, len(node)]))
        ok = place < width
        more[row[ok], place[ok]] = new[ok]
        cand = np.sort(np.concatenate([links[target], more], 1), axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        for at in range(0, len(target), 512):
            t, c = target[at : at + 512], cand[at : at + 512]
            s = np.where(c >= 0, np.einsum("tcd,td->tc", self.vectors[np.maximum(c, 0)], self.vectors[t]), -np.inf)
            links[t] = _diverse(self.vectors, c, s, width)

    def enter(self, queries: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where the queries enter the layer below those that stand: greedy descent."""
        at = np.broadcast_to(first[:1], (len(queries), 1))
        for links in self.layers[::-1]:
            at = _beam_search(self.vectors, links, queries, at, 4)[0]
        return at

    def search(self, queries: np.ndarray, width: int, own: np.ndarray | None = None):
        upper, self.layers = self.layers, self.layers[1:]
        root = np.flatnonzero((upper[-1] >= 0).any(1))[:1] if (upper[-1] >= 0).any() else np.zeros(1, np.int64)
        entries = self.enter(queries, root)
        self.layers = upper
        if own is not None:
            entries = np.concatenate([own[:, None], entries], 1)
        ids, sims, _ = _beam_search(self.vectors, upper[0], queries, entries, width)
        return ids, sims


def _scan(exact: np.ndarray, queries: np.ndarray, rows: np.ndarray, least: float):
    """All pairs of the queries ``rows``, by comparison with all vectors, a block at a time."""
    for at in range(0, len(rows), 512):
        q, m = np.nonzero(queries[rows[at : at + 512]] @ exact.T >= least)
        yield rows[at : at + 512][q], m


def _probes(exact: np.ndarray, least: float) -> np.ndarray:
    """A seeded sample of the vectors, each turned in a direction of chance until its cosine is just ``least``."""
    rng = np.random.default_rng(len(exact))
    x = exact[rng.permutation(len(exact))[:AUDIT]]
    side = rng.normal(size=x.shape)
    side -= np.einsum("kd,kd->k", side, x)[:, None] * x
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-300)
    cosine = min(1.0, least + _SPARE)
    return x * cosine + side * np.sqrt(1 - cosine**2)


def _met(wanted: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of the wanted vectors (queries, vectors) the beams hold."""
    held = np.zeros_like(wanted)
    r, c = np.nonzero(ids >= 0)
    held[r, ids[r, c]] = True
    return wanted & held


def near_pairs(graph: Graph, exact: np.ndarray, queries: np.ndarray, least: float, own: np.ndarray | None = None):
    """Blocks of pairs (query, member) with cosine >= least.

    A beam that is full of partners says that there may be more: it is doubled until it holds others too. The beam of the
    other queries is widened until it holds RECALL of the audited ones' partners. Most vectors have no partner, so that a
    sample may say little; probes with a partner of the least cosine are audited first, in each search. How near a vector
    without partners is to others is not asked: in many dimensions its nearest ones are no nearer than the rest, and no
    beam finds them.
    """
    n, count = len(exact), len(queries)
    sample = np.random.default_rng(count).permutation(count)[:AUDIT]
    wanted = queries[sample] @ exact.T >= least
    if own is not None:
        wanted[np.arange(len(sample)), own[sample]] = False
    probes = _probes(exact, least)
    planted = probes @ exact.T >= least
    width = BEAM
    while width < n:
        ids, sims = graph.search(probes.astype(np.float32), width)
        open_ = ~(sims >= least - _SPARE).all(1)
        # a probe each counts alike, so that a crowd does not make up for the lone
        share = _met(planted, ids).sum(1)[open_] / np.maximum(planted.sum(1)[open_], 1)
        if share.sum() < RECALL * len(share):
            width *= 2
            continue
        parts = [graph.search(queries[at : at + 512].astype(np.float32), width, None if own is None else own[at : at + 512]) for at in range(0, count, 512)]
        ids, sims = (np.concatenate([p[i] for p in parts]) for i in range(2))
        near = (sims >= least - _SPARE) & (ids >= 0)
        full = near.all(1)
        asked = wanted & ~full[sample, None]
        if _met(asked, ids[sample]).sum() >= RECALL * asked.sum():
            break
        width *= 2
    else:
        yield from _scan(exact, queries, np.arange(count), least)
        return
    rows, place, crowded = np.arange(count), dict(zip(sample.tolist(), range(len(sample)), strict=True)), False
    while True:
        q, c = np.nonzero(near & ~full[:, None])
        m, q = ids[q, c], rows[q]
        keep = np.einsum("kd,kd->k", queries[q], exact[m]) >= least
        yield q[keep], m[keep]
        if crowded and own is not None:  # in a crowd a link may be found from one side only
            back = np.full(n, -1)
            back[own] = np.arange(count)
            yield back[m[keep]], own[q[keep]]
        rows, width, crowded = rows[full], 2 * width, True
        if not len(rows):
            return
        if width >= n:  # a beam of all vectors
            yield from _scan(exact, queries, rows, least)
            return
        step = max(1, 512 * BEAM // width)  # wide beams take fewer at a time
        parts = [graph.search(queries[r].astype(np.float32), width, None if own is None else own[r]) for r in np.split(rows, range(step, len(rows), step))]
        ids, sims = (np.concatenate([p[i] for p in parts]) for i in range(2))
        near = (sims >= least - _SPARE) & (ids >= 0)
        full = near.all(1)
        audited = [i for i, r in enumerate(rows.tolist()) if r in place and not full[i]]
        asked = wanted[[place[int(rows[i])] for i in audited]]
        if _met(asked, ids[audited]).sum() < RECALL * asked.sum():
            full[:] = True  # the crowd's audit: wider, all of them


def search_shard(graph: Graph, exact: np.ndarray, queries: np.ndarray, least: float, own: np.ndarray | None = None):
    """The pairs of ``near_pairs`` in two arrays."""
    q, m = zip(*near_pairs(graph, exact, queries, least, own), strict=True)
    return np.concatenate(q), np.concatenate(m)


def _pack(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays))


def _unpack(data: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    x = np.stack(frame["v"].to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("least", kind="stable")
    x, ids, copies = _matrix(frame), frame["least"].to_numpy(np.int64), frame["copies"].to_numpy(np.int64)
    graph = Graph(x)
    return pd.DataFrame([{"grp": frame["grp"].iloc[0], "shard": frame["shard"].iloc[0], "shards": frame["shards"].iloc[0], "vectors": _pack(ids, x, copies), "graph": _pack(graph.layers)}])


def linked(found, n: int, copies: np.ndarray, both_ways: bool) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of pairs -> the least place that each of n reaches, and the copies of its partners.

    both_ways: a pair may be found from either side, and counts once.
    """
    pairs = [np.minimum(i, j) * n + np.maximum(i, j) for i, j in found]
    codes = np.concatenate([*pairs, np.zeros(0, np.int64)])
    codes = np.unique(codes) if both_ways else codes
    i, j = codes // n, codes % n
    i, j = i[i != j], j[i != j]
    return forest(n, [(i, j)]), (np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)).astype(np.int64)


def _search(least: float):
    """Rows of shards, each followed by those of the shards that ask it -> links."""

    def make(batches):
        shard, g, x, own, copies = None, None, None, None, None
        for b in batches:
            for grp, s, vectors, graph in zip(b["grp"], b["shard"], b["vectors"], b["graph"], strict=True):
                if graph is not None:
                    shard, (own, x, copies) = (grp, s), _unpack(vectors)
                    g = Graph.__new__(Graph)
                    g.vectors, (g.layers,) = x.astype(np.float32), _unpack(graph)
                    ids = own
                    root, n = linked(near_pairs(g, x, x, least, np.arange(len(x))), len(x), copies, True)
                else:
                    if shard != (grp, s):
                        raise RuntimeError("a shard's vectors came without its graph")
                    qids, qx, more = _unpack(vectors)
                    ids, every = np.concatenate([own, qids]), np.concatenate([copies, more])
                    root, n = linked(((q + len(x), m) for q, m in near_pairs(g, x, qx, least)), len(ids), every, False)
                met = np.flatnonzero(n)
                yield pd.DataFrame({"a": ids[met], "b": ids[root[met]], "n": n[met]})

    return make


def near_duplicates(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; links join rows of one label with cosine >= least.

    Defined cases: rows whose label, id or vector is null, and vectors that are empty, zero or hold null or non-finite
    components, link with nothing and are their own component; equal vectors of one label link; rows that repeat an id
    with one vector count as copies of each other; vectors of different lengths don't meet; an empty table gives an
    empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col).cast("array<double>")
    inf = float("inf")
    top = F.array_max(F.transform(x, F.abs))
    good = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < inf)) & (top > 0)
    good = F.coalesce(good, F.lit(False))
    # scaled by the largest component, so that no square overflows or vanishes; bound first, or it is sought for each component
    scaled = F.transform(F.array(top), lambda t: F.transform(x, lambda y: y / t))[0]
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(good, F.xxhash64(F.col(label_col).cast("string"), F.size(x))).alias("grp"), F.when(good, scaled).alias("v"))
    rows = rows.withColumn("h", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    live = rows.where("v IS NOT NULL")
    # h names a vector within its label; 64 bits are taken as unequal
    classes = live.groupBy("grp", "h").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("v").alias("v"))
    classes = common.materialise(classes, "vectors")
    shards = classes.groupBy("grp").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    dealt = classes.join(shards, "grp").withColumn("shard", F.pmod(F.shiftright("h", 7), F.col("shards")).cast("int"))
    built = dealt.select("grp", "shards", "shard", "least", "copies", "v").groupBy("grp", "shard").applyInPandas(_build, "grp long, shard int, shards int, vectors binary, graph binary")
    built = common.materialise(built, "hnsw", compression="none")
    # in the ring of a label's shards each asks those up to half way round before it; of two that face each other, the first asks
    half = F.floor(F.col("shards") / 2)
    last = F.when((F.col("shards") % 2 == 0) & (F.col("shard") >= half), half - 1).otherwise(half)
    steps = F.when(last > 0, F.sequence(F.lit(1).cast("long"), last)).otherwise(F.array().cast("array<long>"))
    asking = built.select("grp", "shards", F.col("shard").alias("other"), "vectors", F.explode(steps).alias("step"))
    asking = asking.select("grp", F.pmod(F.col("other") - F.col("step"), F.col("shards")).cast("int").alias("shard"), F.col("other"), "vectors", F.lit(None).cast("binary").alias("graph"))
    own = built.select("grp", "shard", F.lit(-1).alias("other"), "vectors", "graph")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), built.count())
    met = own.unionByName(asking).repartition(tasks, "grp", "shard").sortWithinPartitions("grp", "shard", "other")
    pairs = common.materialise(met.mapInPandas(_search(least), "a long, b long, n long"), "hnsw-pairs")
    found = components(pairs.select("a", "b"))
    counted = pairs.groupBy("a").agg(F.sum("n").alias("n"))
    named = classes.join(found, classes["least"] == found["node"], "left").select("grp", "h", "least", "copies", F.coalesce("root", "least").alias("root"))
    named = named.join(counted, named["least"] == counted["a"], "left").select("grp", "h", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.col("root").alias("component_id"))
    out = rows.select("vec_id", "grp", "h").join(named, ["grp", "h"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op6_hnsw(spark, sf_dir):
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
