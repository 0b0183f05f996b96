"""SimHash near-duplicates found by a Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank, so that neighbours share bits. Runs of neighbours become nodes that keep
the bits all their members agree on (mask and pattern); runs of nodes become upper nodes. Two nodes whose agreed bits
already differ in more places than allowed are dropped with everything below them; what survives is opened level by level
until fingerprints meet fingerprints.

The index is dealt out so that no task needs all fingerprints: within ``distance`` differing bits, two fingerprints agree
in at least one of ``distance + 1`` bit bands (pigeonhole), so each band value has an index of its own. A band value that
very many fingerprints share is dealt out again by the bands of the remaining bits. Copies meet before that: one row per
distinct fingerprint enters. Every index returns a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

FANOUT = 16
#: Pairs of nodes opened at once, at most.
OPEN = 1 << 21
#: A band value with more fingerprints than this is dealt out again by the remaining bits, so often; rows of a task, about.
DENSE, DEALS, TASK = 20_000, 3, 50_000


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of every word shingle; no words: 0."""
    words = common.words_of(text)
    if not words:
        return 0
    n = max(len(words) - width + 1, 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[width - 1 :].tolist() if len(words) >= width else [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, ends, strict=True)), ">u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(width: int):
    def make(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return F.pandas_udf(make, "long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit pattern in the Gray sequence: the prefix parity of its bits."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class GrayIndex:
    """Fingerprints of one or more groups, sorted by group and Gray rank, under nodes of FANOUT children of one group."""

    def __init__(self, group: np.ndarray, prints: np.ndarray):
        self.order = np.lexsort((gray_rank(prints), group))
        pattern, group = prints[self.order], group[self.order]
        # a level: (pattern, mask, first child, end of children)
        ones = np.full(len(pattern), np.uint64(0xFFFFFFFFFFFFFFFF))
        at = np.arange(len(pattern))
        self.levels = [(pattern, ones, at, at + 1)]
        while len(pattern):
            new = np.concatenate([[True], group[1:] != group[:-1]])
            start = np.flatnonzero(new)
            inside = np.arange(len(group)) - np.repeat(start, np.diff([*start, len(group)]))
            first = np.flatnonzero(inside % FANOUT == 0)
            any_, all_ = np.bitwise_or.reduceat(pattern, first), np.bitwise_and.reduceat(pattern, first)
            mask = ~(any_ ^ all_) & np.bitwise_and.reduceat(ones, first)
            self.levels.append((all_ & mask, mask, first, np.concatenate([first[1:], [len(group)]])))
            pattern, ones, group = all_ & mask, mask, group[first]
            if len(start) == len(first):
                break

    def pairs(self, distance: int):
        """Yields arrays (i, j) of places in the given arrays: all pairs of one group within ``distance``."""
        if len(self.levels) < 2:
            return
        roots = np.arange(len(self.levels[-1][0]))
        stack = [(len(self.levels) - 1, roots[k : k + OPEN // 256], roots[k : k + OPEN // 256]) for k in range(0, len(roots), OPEN // 256)]
        while stack:
            level, a, b = stack.pop()
            pattern, mask, first, end = self.levels[level]
            if level == 0:
                yield self.order[a], self.order[b]
                continue
            below, bmask = self.levels[level - 1][0], self.levels[level - 1][1]
            na, nb = end[a] - first[a], end[b] - first[b]
            size = na * nb
            whole = np.repeat(np.arange(len(a)), size)
            k = np.arange(len(whole)) - np.repeat(np.cumsum(size) - size, size)
            x, y = first[a][whole] + k // nb[whole], first[b][whole] + k % nb[whole]
            ahead = (a[whole] != b[whole]) | ((x < y) if level == 1 else (x <= y))
            x, y = x[ahead], y[ahead]
            near = _bits((below[x] ^ below[y]) & bmask[x] & bmask[y]) <= distance
            x, y = x[near], y[near]
            step = OPEN // (FANOUT * FANOUT) if level > 1 else OPEN
            stack += [(level - 1, x[i : i + step], y[i : i + step]) for i in range(0, len(x), step)]


def forest(n: int, pairs) -> np.ndarray:
    """Least place reachable from each of n places, over arrays of pairs."""
    root = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _bands(bits: list[int], n: int) -> list[list[int]]:
    return [[int(x) for x in part] for part in np.array_split(np.array(bits), n)]


def _band_key(fp, bits: list[int]):
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _index_groups(distance: int):
    def search(frame: pd.DataFrame) -> pd.DataFrame:
        group = pd.factorize(frame["key"])[0]
        prints = frame["fp"].to_numpy(np.int64).view(np.uint64)
        root = forest(len(frame), GrayIndex(group, prints).pairs(distance))
        linked = np.flatnonzero(root != np.arange(len(root)))
        fps = frame["fp"].to_numpy()
        return pd.DataFrame({"a": fps[linked], "b": fps[root[linked]]})

    return search


def links(prints: DataFrame, distance: int = 4, dense: int | None = None) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) that connect all fingerprints within ``distance`` bits of each other.

    Keys that more than ``dense`` fingerprints share are dealt again by bands of the bits not yet used, up to DEALS times;
    a key that is crowded even then (its fingerprints agree in half their bits) is one index. Keys meet in tasks of about
    TASK rows, so tasks grow in number with the table, not in size.
    """
    dense = DENSE if dense is None else dense
    rows = prints.select("fp", F.lit(0).alias("case"), F.lit(0).cast("long").alias("key"))
    cases: list[list[int]] = [[]]  # the bits that a case has used
    done = None
    for deal in range(DEALS):
        bands = [_bands([x for x in range(64) if x not in used], distance + 1) for used in cases]
        each = F.array()
        for i, of in enumerate(bands):
            keys = [F.struct(F.lit(i * (distance + 1) + j).alias("case"), F.xxhash64("key", F.lit(j), _band_key(F.col("fp"), bits)).alias("key")) for j, bits in enumerate(of)]
            each = F.when(F.col("case") == i, F.array(*keys)).otherwise(each) if len(bands) > 1 else F.array(*keys)
        cases = [used + bits for used, of in zip(cases, bands, strict=True) for bits in of]
        dealt = rows.select("fp", F.explode(each).alias("k")).select("fp", "k.case", "k.key")
        if deal == DEALS - 1:
            done = dealt.select("fp", "key") if done is None else done.unionByName(dealt.select("fp", "key"))
            break
        crowded = common.materialise(dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > dense).select(F.col("key").alias("crowd")), "simhash-crowds")
        calm = dealt.join(crowded, F.col("key") == F.col("crowd"), "left_anti").select("fp", "key")
        done = calm if done is None else done.unionByName(calm)
        if crowded.isEmpty():
            break
        rows = dealt.join(crowded, F.col("key") == F.col("crowd"), "left_semi")
    done = common.materialise(done, "simhash-dealt")
    tasks = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-done.count() // TASK))
    return done.withColumn("task", F.pmod(F.xxhash64("key"), F.lit(tasks)).cast("int")).groupBy("task").applyInPandas(_index_groups(distance), "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links) of every document.

    Defined cases: null, empty and white texts have fingerprint zero, linked like any other; fewer words than a shingle
    are one shingle; repeated rows stay and share a component; a null id never names a component unless all its members
    are null; an empty table gives an empty result; other columns are ignored.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), _fingerprints(width)(F.col(text_col)).alias("fp"))
    slim = common.materialise(slim, "simhash")
    classes = common.materialise(slim.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    found = components(links(classes.select("fp"), distance))
    rooted = classes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    # one row per distinct fingerprint; a fingerprint that very many documents share is split by skewed-join handling
    out = slim.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_rows(docs: DataFrame, distance: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash of one row of each component: the one with the least doc_id, null ids last, then the least hash."""
    row = F.struct(F.col(id_col).isNull().alias("bare"), F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"))
    slim = docs.select(_fingerprints(width)(F.col(text_col)).alias("fp"), row.alias("row"))
    classes = common.materialise(slim.groupBy("fp").agg(F.min("row").alias("row")), "simhash-firsts")
    found = components(links(classes.select("fp"), distance))
    rooted = classes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select("row", F.coalesce("root", "fp").alias("root"))
    return rooted.groupBy("root").agg(F.min("row").alias("row")).select("row.doc_id", "row.text_hash")


def op4_simhash(spark, sf_dir):
    return near_duplicates(common.table(spark, sf_dir, "documents"))
